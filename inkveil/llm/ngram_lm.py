"""Stupid-backoff scores of documents against the corpus they are in.

Three relations: exploded n-grams of orders 1 to 3, count tables partitioned by hash, and
sums by document.  Documents are cut into groups of bounded size where they are read, so no
key can make a group heavy.  A group explodes its n-grams, adds up equal ones and sends
each partition of the count tables one row with its sorted hashes and counts; the partition
sums them over all groups and joins the totals to each group's hashes; a group sums the
terms of its documents.  N-grams so cross the network in columns, once per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, buffers, chunks, mix, word_bounds, word_hashes
from .mixing import word_count

BACKOFF = 0.4
ORDER = 3
_STEP = [U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)]


def grams(texts) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the word, pair and triple that end at each word (0 where a text has none), and the first word of each text."""
    buf, off = buffers(texts)
    hs, firsts, n = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for i, j in chunks(off):
        low = LOWER[buf[off[i] : off[j]]]
        ws, we, first = word_bounds(low, off[i : j + 1] - off[i])
        hs.append(word_hashes(low, ws, we))
        firsts.append(first[1:] + n)
        n += len(ws)
    h, first = np.concatenate(hs), np.concatenate(firsts)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = [h]
    for k in range(1, ORDER):
        more = np.zeros(n, U)
        with np.errstate(over="ignore"):
            more[1:] = mix(out[-1][:-1] * _STEP[k - 1] + h[1:])
        more[place < k] = 0
        out.append(more)
    return out, first


def _small(counts: np.ndarray) -> bytes:
    """A byte of width, then the counts in the least width that holds them, compressed."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() < 1 << (8 * int(k[2])))
    return bytes([int(kind[2])]) + pa.compress(counts.astype(kind).tobytes(), "zstd", asbytes=True)


def _counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], n * data[0], "zstd", asbytes=True), f"<u{data[0]}").astype(np.int64)


def _sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte place by byte place: the high places are zeros."""
    gaps = np.diff(keys, prepend=U(0)).astype("<u8")
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _keys(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U)


def _pack(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        for r in rows:
            out.write_batch(r)
    return sink.getvalue().to_pybytes()


def _open(data) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _explode(table: pa.Table):
    """Of each order the distinct n-grams of a group, sorted, and the place of each word's n-gram in them (-1 for none); and the first word of each text."""
    orders, first = grams(table.column("text"))
    out = []
    while orders:
        x = orders.pop(0)
        full = x != 0
        keys, place = np.unique(x[full], return_inverse=True)
        here = np.full(len(x), -1, np.int32)
        here[full] = place
        out.append((keys, here))
    return out, first


def _in_groups(batches, group_bytes: int):
    """(number, rows) of groups of about ``group_bytes`` of text, by place in the input."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        off = buffers(batch.column(1))[1]
        for i, j in chunks(off, group_bytes):
            held.append(batch.slice(i, j - i))
            size += int(off[j] - off[i])
            if size >= group_bytes // 2:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def documents_in_groups(docs: DataFrame, group_bytes: int) -> DataFrame:
    """(g, data): the rows of ``docs`` in packed groups."""

    def run(batches):
        for g, rows in _in_groups(batches, group_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([_pack(rows)], pa.binary())], names=["g", "data"])

    return docs.mapInArrow(run, "g long, data binary")


def exploded(docs: DataFrame, group_bytes: int, bits: int) -> DataFrame:
    """(part, g, n, keys, counts): the n-grams of each group, of each order in 2**bits hash ranges."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits) if bits else np.zeros(0, U)

    def run(batches):
        for g, rows in _in_groups(batches, group_bytes):
            for k, (keys, here) in enumerate(_explode(pa.Table.from_batches(rows))[0]):
                counts = np.bincount(here[here >= 0], minlength=len(keys))
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((full + (k << bits)).astype(np.int32)), pa.array(np.full(len(full), g)), pa.array(np.diff(at)[full]),
                        pa.array([_sorted(keys[at[b] : at[b + 1]]) for b in full], pa.binary()), pa.array([_small(counts[at[b] : at[b + 1]]) for b in full], pa.binary()),
                    ],
                    names=["part", "g", "n", "keys", "counts"],
                )

    return docs.mapInArrow(run, "part int, g long, n long, keys binary, counts binary")


def joined_counts(grams_: DataFrame) -> DataFrame:
    """(g, part, n, totals): each group's n-grams joined to the count table of their hash range."""

    def run(t: pa.Table) -> pa.Table:
        sizes = t.column("n").to_pylist()
        keys = np.concatenate([_keys(x.as_py(), n) for x, n in zip(t.column("keys"), sizes)])
        table, place = np.unique(keys, return_inverse=True)
        del keys
        sums = np.bincount(place, weights=np.concatenate([_counts(x.as_py(), n) for x, n in zip(t.column("counts"), sizes)]), minlength=len(table)).astype(np.int64)
        ends = np.cumsum(sizes)
        return pa.table({"g": t.column("g"), "part": t.column("part"), "n": t.column("n"), "totals": pa.array([_small(sums[place[e - n : e]]) for e, n in zip(ends, sizes)], pa.binary())})

    return grams_.groupBy("part").applyInArrow(run, "g long, part int, n long, totals binary")


def score(docs: DataFrame, group_bytes: int = 12 << 20, part_grams: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, log10_score, per_word, n_triples_seen, n_pairs_seen, n_unseen of every row of ``docs``.

    With counts c of all other rows and N their words, P1(w) is c(w) / N, or 0.4 / N for a
    word of no other row; P2(w | v) is c(v w) / c(v), or else 0.4 P1(w); P3(w | u v) is
    c(u v w) / c(u v), or else 0.4 P2(w | v).  A word is scored with the longest history of
    up to two words that its text has.  Words are runs without white space, ASCII letters in
    lower case.  Scores are rounded to 6 places.  Null and empty texts have 0 words and
    scores of 0; a null doc_id stays null; repeated rows are texts of their own, counted in
    each other's scores; a text longer than ``group_bytes`` is a group of its own; other
    columns are ignored; an empty table gives no rows.  ``group_bytes`` and ``part_grams``
    are to fit a worker's memory; they change no score.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(word_count()).alias("n")).first()["n"] or 0
    bits = max(0, -(-total // part_grams) - 1).bit_length()
    groups = documents_in_groups(docs, group_bytes)

    def rate(left: pa.Table, back: pa.Table) -> pa.Table:
        t = _open(left.column("data")[0].as_buffer())
        orders, first = _explode(t)
        n = np.diff(first)
        back = back.sort_by("part")
        totals = np.concatenate([np.zeros(0, np.int64), *(_counts(x.as_py(), k) for x, k in zip(back.column("totals"), back.column("n").to_pylist()))])
        if len(totals) != sum(len(keys) for keys, _ in orders):
            raise RuntimeError("the totals do not fit the n-grams asked for")
        doc = np.repeat(np.arange(len(n)), n)
        c, at, start = [], [here >= 0 for _, here in orders], 0
        for (keys, here), some in zip(orders, at):
            # Counts in all other rows; 0 where there is no n-gram.
            _, inverse, own = np.unique(doc[some] * np.int64(max(len(keys), 1)) + here[some], return_inverse=True, return_counts=True)
            c.append(np.zeros(len(here), np.int64))
            c[-1][some] = totals[start + here[some]] - own[inverse]
            start += len(keys)
        before = lambda c: np.concatenate([[0], c[:-1]])[: len(c)]
        rest = np.maximum(total - n[doc], 1)
        p = np.where(c[0] > 0, c[0], BACKOFF) / rest
        for k in range(1, ORDER):
            p = np.where(c[k] > 0, c[k] / np.maximum(before(c[k - 1]), 1), np.where(at[k], BACKOFF, 1.0) * p)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(n)).astype(float)
        log = add(np.log10(p))
        whole = lambda x: pa.array(add(x).astype(np.int64))
        return pa.table({
            "doc_id": t.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "log10_score": pa.array(np.round(log, 6)), "per_word": pa.array(np.round(log / np.maximum(n, 1), 6)),
            "n_triples_seen": whole(c[2] > 0), "n_pairs_seen": whole(c[1] > 0), "n_unseen": whole(c[0] <= 0),
        })

    told = joined_counts(exploded(docs, group_bytes, bits))
    schema = "doc_id long, n_words long, log10_score double, per_word double, n_triples_seen long, n_pairs_seen long, n_unseen long"
    return groups.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(rate, schema)


#: The same scores over one row per n-gram; documents have distinct ids here.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM w),
e AS (SELECT doc_id, i, a[i] AS g1, CASE WHEN i > 1 THEN a[i-1] || ' ' || a[i] END AS g2, CASE WHEN i > 2 THEN a[i-2] || ' ' || a[i-1] || ' ' || a[i] END AS g3,
  CASE WHEN i > 1 THEN a[i-1] END AS h1, CASE WHEN i > 2 THEN a[i-2] || ' ' || a[i-1] END AS h2 FROM p),
o AS (SELECT doc_id, g1 AS g, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT doc_id, g2, count(*) FROM e WHERE g2 IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, g3, count(*) FROM e WHERE g3 IS NOT NULL GROUP BY ALL),
c AS (SELECT g, sum(n) AS n FROM o GROUP BY g),
l AS (SELECT o.doc_id, o.g, c.n - o.n AS n FROM o JOIN c USING (g)),
t AS (SELECT doc_id, len(a) AS n_words, greatest((SELECT sum(len(a)) FROM w) - len(a), 1) AS rest FROM w),
s AS (SELECT e.doc_id, e.i, x3.n AS c3, x2.n AS c2, x1.n AS c1, y2.n AS d2, y1.n AS d1, t.rest FROM e JOIN t USING (doc_id)
  JOIN l x1 ON x1.doc_id = e.doc_id AND x1.g = e.g1 LEFT JOIN l x2 ON x2.doc_id = e.doc_id AND x2.g = e.g2 LEFT JOIN l x3 ON x3.doc_id = e.doc_id AND x3.g = e.g3
  LEFT JOIN l y1 ON y1.doc_id = e.doc_id AND y1.g = e.h1 LEFT JOIN l y2 ON y2.doc_id = e.doc_id AND y2.g = e.h2),
q AS (SELECT *, CASE WHEN c1 > 0 THEN c1 ELSE 0.4 END / rest::DOUBLE AS p1 FROM s),
r AS (SELECT *, CASE WHEN c2 > 0 THEN c2::DOUBLE / d1 WHEN i > 1 THEN 0.4::DOUBLE * p1 ELSE p1 END AS p2 FROM q),
f AS (SELECT *, CASE WHEN c3 > 0 THEN c3::DOUBLE / d2 WHEN i > 2 THEN 0.4::DOUBLE * p2 ELSE p2 END AS p3 FROM r)
SELECT t.doc_id, t.n_words::BIGINT AS n_words, round(coalesce(sum(log10(p3)), 0), 6) AS log10_score, round(coalesce(sum(log10(p3)), 0) / greatest(t.n_words, 1), 6) AS per_word,
  count_if(coalesce(c3, 0) > 0)::BIGINT AS n_triples_seen, count_if(coalesce(c2, 0) > 0)::BIGINT AS n_pairs_seen, count_if(coalesce(c1, 1) <= 0)::BIGINT AS n_unseen
FROM t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id, t.n_words
"""
