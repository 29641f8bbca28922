"""MinHash near-duplicate detection with tensored banding.

A plain LSH index of T tables of K min-hashes needs T*K of them.  Here two collections of
``m`` half-keys of K/2 min-hashes each are drawn, and table (i, j) is keyed by half-key i of
the left and j of the right collection: m*m tables from 2*m*K/2 min-hashes, about the square
root.  At similarity s a pair shares no table with a probability below
2 * (1 - s**half)**m: 0.0001 at the threshold 0.75 with the defaults (m 12, half 2).

Work runs on one representative per distinct shingle set.  In the first round each bucket
links its members to its smallest one, which is linear in the rows; links are confirmed on
full sets and joined into components.  The second round takes the buckets that still hold several
components and confirms every pair across them, large buckets slice by slice; a pair within one component
changes no component and is left out.  Pairs are confirmed only where size and odd sketch allow a
link: the sketch holds the parity of the shingles that fall on each of 1024 bits, so two
sketches differ in at most as many bits as the sets differ in shingles, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, buffers, chunks, cut, mix, word_bounds, word_hashes

_SHIFT = [U(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts, words: int = 5):
    """For ranges of texts: (first row, list of sorted distinct shingle hashes of each)."""
    buf, off = buffers(texts)
    with np.errstate(over="ignore"):
        for i, j in chunks(off):
            o = off[i : j + 1] - off[i]
            low = LOWER[buf[off[i] : off[j]]]
            ws, we, first = word_bounds(low, o)
            h = word_hashes(low, ws, we)
            n = len(h)
            roll = np.zeros(max(n - words + 1, 0), U)
            for k in range(words if len(roll) else 0):
                roll += h[k : n - words + 1 + k] * (_SHIFT[k % 5] + U(2 * (k // 5)))
            roll = mix(roll)
            sets = []
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= words:
                    sets.append(np.unique(roll[a : b - words + 1]))
                elif b > a:
                    x = U(b - a)
                    for w in h[a:b]:
                        x = x * U(0x2545F4914F6CDD1D) + w
                    sets.append(mix(np.array([x ^ U(0x5851F42D4C957F2D)], U)))
                else:
                    sets.append(np.zeros(0, U))
            yield i, sets


#: Longs of an odd sketch.
SKETCH = 16


def odd_sketch(flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, SKETCH) longs: parity of the set elements that fall on each bit."""
    bit = (mix(flat * U(0xC2B2AE3D27D4EB4F)) & U(SKETCH * 64 - 1)).astype(np.int64)
    odd = np.bincount(row * (SKETCH * 64) + bit, minlength=n * SKETCH * 64).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(n, SKETCH)


def signatures(docs: DataFrame, words: int = 5, m: int = 12, half: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (128 bits of the set), left and right half-keys, sketch."""

    def sign(batches):
        rng = np.random.default_rng(seed)
        mul = rng.integers(1, 1 << 63, 2 * m * half, dtype=np.uint64) * U(2) + U(1)
        xor = rng.integers(0, 1 << 63, 2 * m * half, dtype=np.uint64)
        for batch in batches:
            n_all, ks, halves, sketches = [], [], [], []
            for _, sets in shingle_sets(batch.column("text"), words):
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), 2 * m), U)
                k12 = np.zeros((len(sets), 2), U)
                if len(full):
                    with np.errstate(over="ignore"):
                        flat = np.concatenate(sets)
                        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                        k12[full, 0] = np.add.reduceat(mix(flat * U(0xD1342543DE82EF95)), at)
                        k12[full, 1] = np.add.reduceat(mix(flat ^ U(0xAF251AF3B0F025B5)), at)
                        for c in range(2 * m):
                            key = np.full(len(full), U(c + 1))
                            for r in range(half):
                                f = c * half + r
                                low = np.minimum.reduceat((flat ^ xor[f]) * mul[f], at)
                                key = mix(key * U(0x9E3779B97F4A7C15) + low)
                            keys[full, c] = key
                n_all.append(sizes)
                sketches.append(odd_sketch(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)))
                ks.append(k12)
                halves.append(keys)
            if not n_all:
                continue
            n, k12, keys = np.concatenate(n_all), np.concatenate(ks).view(np.int64), np.concatenate(halves).view(np.int64)
            row = np.arange(0, (len(n) + 1) * m, m, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(row, np.ascontiguousarray(x).ravel()) for x in (keys[:, :m], keys[:, m:])]
            sketch = np.concatenate(sketches)
            lists.append(pa.ListArray.from_arrays(np.arange(0, (len(n) + 1) * SKETCH, SKETCH, dtype=np.int32), sketch.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(k12[:, 0].copy()), pa.array(k12[:, 1].copy()), *lists],
                names=["doc_id", "n_shingles", "k1", "k2", "left", "right", "sketch"],
            )

    schema = "doc_id long, n_shingles long, k1 long, k2 long, left array<long>, right array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, schema)


def _tables(m: int, left: str, right: str) -> Column:
    """The m*m table keys of a row."""
    return F.expr(f"flatten(transform(sequence(0, {m - 1}), i -> transform(sequence(0, {m - 1}), j -> xxhash64(i, j, {left}[i], {right}[j]))))")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets reach the threshold."""

    def check(batches):
        for batch in batches:
            both = [[s for _, sets in shingle_sets(batch.column(c), words) for s in sets] for c in ("tx", "ty")]
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(*both)):
                if len(a) and len(b) and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    small, large = (a, b) if len(a) <= len(b) else (b, a)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    common = int((large[at] == small).sum())
                    keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], names=["x", "y"])

    some = texts.join(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    some = cut(some.select("doc_id", "text"))
    tx = some.select(F.col("doc_id").alias("x"), F.col("text").alias("tx"))
    ty = some.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
    return pairs.join(ty, "y").join(tx, "x").select("x", "y", "tx", "ty").mapInArrow(check, "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): c is the smallest vertex that can be reached from v.

    Labels spread to neighbours and jump to the label of their label, all in joins; each
    turn is written to the checkpoint folder, and the number of turns grows with the
    logarithm of the longest path.  A large component's rows that look up one label are dealt
    anew by the skew handling of the join, as nothing after it needs them in place.
    """
    both = cut(edges.select(F.col("x").alias("v"), F.col("y").alias("u")).union(edges.select(F.col("y"), F.col("x"))))
    label = cut(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")))
    while True:
        near = both.join(label.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy("v").agg(F.min("cu").alias("m"))
        step = label.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("n"))
        jump = label.select(F.col("v").alias("n"), F.col("c").alias("j"))
        turn = cut(step.join(jump, "n").select("v", "old", F.least("n", "j").alias("c")))
        label = turn.select("v", "c")
        if turn.filter("c < old").isEmpty():
            return label


def joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """The components (v, c) of a graph after edges (x, y) are added: only components that these meet are joined anew."""
    of = lambda end: label.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
    ends = more.join(of("x"), "x", "left").join(of("y"), "y", "left").select("x", "y", F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("b"))
    ends = cut(ends)
    merged = components(ends.filter("a != b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct())
    # Vertices that no edge met before are components of their own.
    known = label.unionByName(ends.select(F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("a").alias("c")), F.struct(F.col("y").alias("v"), F.col("b").alias("c")))).alias("e")).select("e.*").filter("v = c").distinct().join(label.select("v"), "v", "left_anti"))
    return known.join(merged.select(F.col("v").alias("c"), F.col("c").alias("d")), "c", "left").select("v", F.coalesce("d", "c").alias("c"))


def _can_link(percent: int) -> Column:
    """Whether the sizes and sketches of a and b allow a link; the link itself is confirmed on the sets."""
    differ = "+".join(f"bit_count(a.s{i} ^ b.s{i})" for i in range(SKETCH))
    # 100 * common >= percent * union bounds the symmetric difference by this share of na + nb.
    return F.expr(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) AND ({differ}) * {100 + percent} <= (a.n + b.n) * {100 - percent}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, m: int = 12, half: int = 2, slice_rows: int = 8192) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...).

    Null and empty texts, and texts of white space, have no shingles and are linked with
    nothing; shorter texts than ``words`` are one shingle; very long ones are whole sets.
    Other columns are ignored.  Rows that repeat a doc_id are one vertex, whatever their
    texts, and are all returned; with a null doc_id a row is its own component (null) and
    kept.  An empty table gives no rows.  ``slice_rows`` bounds the rows of a bucket that a
    task compares with all of it; it changes no result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = cut(signatures(docs, words, m, half))
    real = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(real.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    named = cut(sig.join(classes, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep"))
    # A vertex may have several sets: a doc_id that repeats with other texts.
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    sketch = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    reps = cut(reps.select(F.col("doc_id").alias("r"), F.col("n_shingles").alias("n"), "left", "right", *sketch))
    lean = reps.drop("left", "right")
    rows = reps.select("r", F.explode(_tables(m, "left", "right")).alias("key"))
    shared = cut(rows.groupBy("key").agg(F.min("r").alias("x"), F.max("r").alias("most")).filter("x < most").select("key", "x"))
    member = cut(rows.join(shared, "key").select("key", "r", "x"))

    def links(pairs: DataFrame) -> DataFrame:
        a, b = lean.withColumnRenamed("r", "x").alias("a"), lean.withColumnRenamed("r", "y").alias("b")
        able = pairs.join(a, "x").join(b, "y").filter(_can_link(percent)).select("x", "y").distinct()
        return cut(_confirm(cut(able), docs, words, percent))

    def mixed(label: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, and the slices their comparisons are dealt in."""
        named = member.select("key", "r").join(label.select(F.col("v").alias("r"), "c"), "r", "left").withColumn("c", F.coalesce("c", "r"))
        named = cut(named)
        some = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo < hi AND size > 2")
        return cut(named.join(some.select("key", F.ceil(F.col("size") / slice_rows).cast("int").alias("slices")), "key"))

    tried = cut(member.filter("r > x").select("x", F.col("r").alias("y")).distinct())
    several = named.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("most")).filter("x < most")
    same_id = cut(named.join(several, "doc_id").filter("rep > x").select("x", F.col("rep").alias("y")).distinct())
    found = links(tried).union(same_id)
    label = components(found)

    rest = mixed(label)
    rest = cut(rest.join(lean, "r"))
    # A large bucket is dealt in slices, each compared with the whole bucket by a task of its own.
    a = rest.withColumnRenamed("r", "x").withColumn("slice", F.expr("cast(pmod(xxhash64(x), slices) as int)")).alias("a")
    b = rest.withColumnRenamed("r", "y").withColumn("slice", F.expr("explode(sequence(0, slices - 1))")).alias("b")
    across = a.join(b, F.expr("a.key = b.key AND a.slice = b.slice AND x < y AND a.c != b.c") & _can_link(percent)).select("x", "y").distinct()
    across = cut(across.join(tried, ["x", "y"], "left_anti"))
    more = cut(_confirm(across, docs, words, percent))
    if not more.isEmpty():
        label = joined(label, more)

    out = named.join(label.select(F.col("v").alias("rep"), "c"), "rep", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("c", "rep", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
