"""Language identification with a string kernel.

Texts are sets of hashed byte n-grams (blended spectrum, n 1 to 4) of their letters in lower
case; k(x, y) = |x & y| / sqrt(|x| |y|).  Nystroem landmarks turn the kernel into features on
which one-versus-rest ridge regression is solved.  Scoring is the product of a batch's sparse
presence matrix, landmarks and coefficients; the last two are fixed, so their product is
taken once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, buffers, chunks, fold_upper

BITS = 16
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


#: Texts of one presence matrix.
ROWS = 64


def presence(texts):
    """For blocks of texts: (grams, starts, sizes, letters): the distinct n-gram numbers of all, row by row, where each
    row starts, its number of n-grams, and whether it has a letter."""
    buf, off = buffers(texts)
    flags = np.zeros(ROWS << BITS, bool)
    for i, j in chunks(off):
        raw = buf[off[i] : off[j]]
        low = _KEEP[fold_upper(raw)]
        ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low < 123))])
        code, grams = np.zeros(len(low), np.uint32), []
        for n in range(4):
            code = (code[: len(low) - n] if n else code) * np.uint32(263) + low[n:].astype(np.uint32) if len(low) > n else np.zeros(0, np.uint32)
            grams.append(((code + np.uint32(n)) * _MUL[n]) >> np.uint32(32 - BITS))
        o = off[i : j + 1] - off[i]
        for r in range(0, j - i, ROWS):
            at = o[r : r + ROWS + 1]
            size = np.diff(at)
            row = np.repeat(np.arange(len(size), dtype=np.int64) << BITS, size)
            left = np.repeat(at[1:], size) - np.arange(at[0], at[-1])  # bytes to the end of the text
            for n, g in enumerate(grams):
                inside = left > n
                flags[row[inside] | g[at[0] + np.flatnonzero(inside)]] = True
            found = np.flatnonzero(flags[: len(size) << BITS])
            flags[found] = False
            starts = np.searchsorted(found, np.arange(len(size) + 1) << BITS)
            letters = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
            for k in np.flatnonzero(~letters & (size > 0)):
                letters[k] = any(map(str.isalpha, raw[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")))
            yield found & ((1 << BITS) - 1), starts[:-1], np.diff(starts), letters


def product(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The presence matrix times the weights."""
    # The row of zeros at the end keeps empty rows, whose sums are not theirs, inside the array.
    sums = np.add.reduceat(np.concatenate([weights[grams], np.zeros((1, weights.shape[1]), weights.dtype)]), starts, axis=0) if len(starts) else np.zeros((0, weights.shape[1]))
    return np.where(sizes[:, None] > 0, sums, 0)


def fit(texts, langs, landmarks: int = 256, ridge: float = 0.01, seed: int = 3):
    """(languages, weights): row g of the weights is what n-gram g adds to each language."""
    rows = [g[s : s + n] if letter else None for g, starts, sizes, letters in presence(texts) for s, n, letter in zip(starts, sizes, letters)]
    rows = [(x, y) for x, y in zip(rows, langs) if x is not None]
    names = sorted({y for _, y in rows})
    if not rows:
        return [], np.zeros((1 << BITS, 0), np.float32)
    rng = np.random.default_rng(seed)
    chosen = np.sort(rng.permutation(len(rows))[:landmarks])
    marks = np.zeros((1 << BITS, len(chosen)), np.float32)
    for k, c in enumerate(chosen):
        marks[rows[c][0], k] = 1 / np.sqrt(len(rows[c][0]))
    near = np.stack([marks[x].sum(0) / np.sqrt(len(x)) for x, _ in rows])
    value, vector = np.linalg.eigh(near[chosen].astype(np.float64))
    root = vector[:, value > 1e-8] / np.sqrt(value[value > 1e-8])
    phi = near @ root
    goal = np.array([[float(y == n) for n in names] for _, y in rows])
    coef = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ goal)
    return names, (marks @ (root @ coef)).astype(np.float32)


def sample(docs: DataFrame, per_lang: int, most: int, most_bytes: int):
    """About ``per_lang`` texts of each language, drawn by a hash; at most ``most`` and ``most_bytes`` in all."""
    learn = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 != 2")
    # A text that repeats is one candidate, so that its copies don't come together.
    learn = learn.withColumn("t", F.xxhash64("text"))
    drawn = F.pmod(F.xxhash64(F.lit(1), "t"), F.lit(1 << 30)) / float(1 << 30)
    count = learn.groupBy("lang").agg(F.approx_count_distinct("t").alias("n")).withColumn("share", F.lit(float(per_lang)) / F.col("n"))
    # More languages than this leave some without a sample; the most frequent come first.
    count = count.orderBy(F.desc("n"), "lang").limit(max(1, most // per_lang))
    rows = learn.join(F.broadcast(count.select("lang", "share")), "lang").filter(drawn < F.col("share"))
    return bounded_sample(rows.select("t", "lang", "text"), ["t", "lang"], most, most_bytes)


def identify(docs: DataFrame, per_lang: int = 250, landmarks: int = 256, most: int = 20_000, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Learns from about ``per_lang`` texts of each language among the rows whose
    crc32(doc_id) mod 4 is not 2, a sample of at most ``most`` texts and ``most_bytes``, of texts
    up to a 64th of that.  A
    null text or one without a letter is ``und`` with score 0, as is every text where nothing
    can be learnt; a tie goes to the first language by code point; a null doc_id is not held
    out and not learnt from; null languages are not learnt; very long texts are scored whole;
    repeated rows are all returned; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = sample(docs, per_lang, most, most_bytes)
    names, weights = fit(pa.array(rows["text"], pa.string()), rows["lang"], landmarks)

    def run(batches):
        label = np.array([*names, "und"], object)
        for batch in batches:
            langs, scores = [np.zeros(0, object)], [np.zeros(0)]
            for grams, starts, sizes, letters in presence(batch.column(2)):
                best, score = np.full(len(sizes), len(names)), np.zeros(len(sizes))
                if names:
                    s = product(grams, starts, sizes, weights) / np.sqrt(np.maximum(sizes, 1))[:, None]
                    p = np.exp(8.0 * (s - s.max(1, keepdims=True)))
                    best = np.where(letters, s.argmax(1), best)
                    score = np.where(letters, 1 / p.sum(1), 0.0)
                langs.append(label[best])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"), F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
