"""Toxicity by a convolutional text classifier in numpy.

Words (runs of letters and digits, in lower case) and their beginnings of 5 and 7 bytes have
64-bit hashes; every hash that occurs in at least ``least`` sampled texts has an embedding
that is learnt, and a word is the sum of its three.  Embeddings start from the log-odds of
their hash, so that few labels are enough.  Filters of widths 1 to 3 slide over a text, each
gives its maximum in each quarter of it, and a logistic layer weighs them.  Every language, told by function words in
the text itself, has a threshold of its own fitted on rows that the gradient didn't see;
scores are shifted so that it lies at 0.7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, bounded_sample, buffers, chunks, fold_upper, word_bounds, word_hashes

SEP = np.ones(256, bool)
SEP[48:58] = SEP[97:123] = SEP[128:] = False
WIDTHS = (1, 2, 3)
DIM, FILTERS = 8, 8
#: Parts of a text that are pooled on their own, so that one stray word and several are told apart.
PARTS = 4
#: Rows without a word after each text: no window reaches the next text and no part is empty.
PAD = max(*WIDTHS, PARTS)
STARTS = (5, 7)
BITS = 20
#: Function words that tell a language; fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with as be by this from are",
    "de": "der die das und ist nicht mit sich auf von zu dem den ein eine im als",
    "fr": "le la les et des est une dans qui pour que pas sur du au par un",
    "es": "el los las del que con para una por es se su lo como y no",
}
LANGS = (*FUNCTION_WORDS, "other")


def words(texts):
    """For ranges of texts: (words, 3) hashes of words and their beginnings, 0 for none, and the first word of each text."""
    buf, off = buffers(texts)
    for i, j in chunks(off):
        low = fold_upper(buf[off[i] : off[j]])
        ws, we, first = word_bounds(low, off[i : j + 1] - off[i], SEP)
        h = np.zeros((len(ws), 1 + len(STARTS)), U)
        if len(ws):
            h[:, 0] = word_hashes(low, ws, we)
            for k, size in enumerate(STARTS, 1):
                longer = np.flatnonzero(we - ws > size)
                h[longer, k] = word_hashes(low, ws[longer], ws[longer] + size) ^ U(k)
        yield h, first


def _hash_of(word: str) -> np.uint64:
    return next(iter(words(pa.array([word]))))[0][0, 0]


class Model:
    """Embedding rows by hash (row 0 is zero), filters, logistic layer, thresholds."""

    def __init__(self, vocab: np.ndarray, emb: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.hash = np.concatenate([[U(0)], vocab])
        self.emb = emb.astype(np.float32)
        # taps[w][k]: what the k-th word of a window of width w + 1 adds to each filter.
        self.taps = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.taps:
            t[:, 0] = np.abs(t[:, 0]) * np.where(np.arange(FILTERS) % 4 == 3, -1, 1)  # dimension 0 starts as log-odds
        self.bias = np.full((len(WIDTHS), FILTERS), -0.1, np.float32)
        self.out = np.where(np.arange(FILTERS) % 4 == 3, -0.05, 0.1) * np.ones((len(WIDTHS), 1), np.float32)
        self.shift = -2.0
        self.table = np.zeros(1 << BITS, np.int32)
        self.table[(vocab & U((1 << BITS) - 1)).astype(np.int64)[::-1]] = np.arange(len(vocab), 0, -1)
        self.cut = np.zeros(len(LANGS))
        self.lang = np.full(len(self.hash), len(LANGS) - 1, np.int64)
        by = {int(h): i for i, h in enumerate(self.hash)}
        for k, name in enumerate(FUNCTION_WORDS):
            for w in FUNCTION_WORDS[name].split():
                if (i := by.get(int(_hash_of(w)))) is not None:
                    self.lang[i] = k

    def rows(self, h: np.ndarray) -> np.ndarray:
        r = self.table[(h & U((1 << BITS) - 1)).astype(np.int64)]
        return np.where(self.hash[r] == h, r, 0)

    def values(self, x: np.ndarray) -> list[np.ndarray]:
        """Every filter at every place, for each width."""
        out = []
        for t in self.taps:
            c = x @ t[0]
            for k in range(1, len(t)):
                c[:-k] += x[k:] @ t[k]
            out.append(c)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        """Logits of (texts, PARTS, widths, filters) maxima."""
        return (np.maximum(pooled + self.bias, 0) * self.out).sum((1, 2, 3)) + self.shift

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text."""
        logits, langs = [np.zeros(0)], [np.zeros(0, np.int64)]
        for h, first in words(texts):
            n = len(first) - 1
            r = self.rows(h)
            votes = np.bincount(np.repeat(np.arange(n), np.diff(first)) * len(LANGS) + self.lang[r[:, 0]], minlength=n * len(LANGS)).reshape(n, -1)[:, :-1]
            langs.append(np.where(votes.max(1) > 0, votes.argmax(1), len(LANGS) - 1))
            r, first = padded(r, first)
            at = self.values(sum(self.emb[r[:, k]] for k in range(r.shape[1])))
            pooled = np.stack([np.maximum.reduceat(c, parts(first)[:-1], axis=0) for c in at], 1)
            logits.append(self.logits(pooled.reshape(n, PARTS, len(WIDTHS), FILTERS)))
        return np.concatenate(logits), np.concatenate(langs)

    def probability(self, texts) -> np.ndarray:
        logit, lang = self.score(texts)
        return 1 / (1 + np.exp(-np.clip(logit - self.cut[lang] + np.log(0.7 / 0.3), -30, 30)))


def padded(r: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of texts with PAD rows of no word after each, and the new starts."""
    n = len(first) - 1
    out = np.zeros((len(r) + PAD * n, r.shape[1]), r.dtype)
    out[np.arange(len(r)) + PAD * np.repeat(np.arange(n), np.diff(first))] = r
    return out, first + PAD * np.arange(n + 1)


def parts(first: np.ndarray) -> np.ndarray:
    """Starts of the parts of padded texts."""
    at = first[:-1, None] + np.diff(first)[:, None] * np.arange(PARTS) // PARTS
    return np.append(at.ravel(), first[-1])


def _start(docs: list[np.ndarray], y: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of at least ``least`` texts, the most frequent ``most`` of them, and the z value of their log-odds."""
    sets = [np.unique(d[d > 0]) for d in docs]
    vocab, df = np.unique(np.concatenate([*sets, np.zeros(0, U)]), return_counts=True)
    pos = np.zeros(len(vocab))
    for s, t in zip(sets, y):
        if t:
            pos[np.searchsorted(vocab, s)] += 1
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((df - pos + 0.5) / (n0 + 1))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (df - pos + 0.5))
    func = np.isin(vocab, np.array([_hash_of(w) for ws in FUNCTION_WORDS.values() for w in ws.split()], U))
    keep = np.flatnonzero((df >= least) | func)
    keep = np.sort(keep[np.lexsort((vocab[keep], -df[keep] - (func[keep] << 40)))][:most])
    return vocab[keep], z[keep]


def train(texts, toxic: np.ndarray, tune: np.ndarray, weight=None, least: int = 3, most: int = 1 << 17, epochs: int = 6, rate: float = 0.02, drop: float = 0.3, seed: int = 11) -> Model:
    """Fits the network on the rows not in ``tune``, and the thresholds on those that are.

    ``weight`` is the number of labelled rows that a sampled row stands for.
    """
    weight = np.ones(len(toxic)) if weight is None else weight
    learn = np.flatnonzero(~tune)
    y = toxic[learn].astype(np.float32)
    # The driver holds the words of the sample once, first as hashes and then as rows of the embedding.
    docs = [h[a:b] for h, first in words(texts.take(pa.array(learn))) for a, b in zip(first[:-1], first[1:])]
    vocab, z = _start(docs, y, least, most)
    rng = np.random.default_rng(seed)
    emb = np.column_stack([np.sign(z) * np.clip(np.abs(z) - 2, 0, 6) / 3, rng.normal(0, 0.02, (len(vocab), DIM - 1))])
    m = Model(vocab, np.concatenate([np.zeros((1, DIM)), emb]), seed)
    idx = []
    for i in range(len(docs)):
        idx.append(m.rows(docs[i]))
        docs[i] = None
    params = [*m.taps, m.bias, m.out]
    seen, seen_emb = [np.full_like(p, 1e-4) for p in params], np.full((len(m.emb), 1), 1e-4, np.float32)
    gain = np.where(y > 0, np.sqrt(max((1 - y).sum(), 1) / max(y.sum(), 1)), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(idx))
        for batch in np.array_split(order, max(1, len(order) // 32)) if len(order) else []:
            r, first = padded(np.concatenate([idx[d] for d in batch]), np.concatenate([[0], np.cumsum([len(idx[d]) for d in batch])]))
            r = np.where(rng.random(len(r))[:, None] < drop, 0, r)  # words left out at random
            x = sum(m.emb[r[:, k]] for k in range(r.shape[1]))
            at = m.values(x)
            cuts = parts(first)
            best = [np.stack([a + c[a:b].argmax(0) for a, b in zip(cuts[:-1], cuts[1:])]) for c in at]
            pooled = np.stack([np.take_along_axis(c, i, 0) for c, i in zip(at, best)], 1)
            pre = pooled + m.bias
            p = 1 / (1 + np.exp(-np.clip(m.logits(pooled.reshape(len(batch), PARTS, *pooled.shape[1:])), -30, 30)))
            g = ((p - y[batch]) * gain[batch] / len(batch)).astype(np.float32)
            each = np.repeat(g, PARTS)[:, None, None]
            into = each * m.out * (pre > 0)
            grads = [np.zeros_like(t) for t in m.taps] + [into.sum(0), (each * np.maximum(pre, 0)).sum(0)]
            touched, amount = [], []
            for v, t in enumerate(m.taps):
                for k in range(len(t)):
                    place = np.minimum(best[v] + k, len(x) - 1)
                    grads[v][k] = np.einsum("bf,bfd->df", into[:, v], x[place])
                    rows_ = r[place].reshape(-1, r.shape[1])
                    touched.append(rows_)
                    amount.append((into[:, v, :, None] * t[k].T).reshape(-1, DIM))
            rows_, amount = np.concatenate(touched), np.concatenate(amount)
            words_, where = np.unique(rows_, return_inverse=True)
            back = np.zeros((len(words_), DIM), np.float32)
            for c in range(rows_.shape[1]):
                np.add.at(back, where.reshape(rows_.shape)[:, c], amount)
            m.shift -= rate * g.sum()
            for q, s, d in zip(params, seen, grads):
                d = d + 1e-4 * q
                s += d * d
                q -= rate * d / np.sqrt(s)
            seen_emb[words_] += (back * back).mean(1, keepdims=True)
            m.emb[words_] -= rate * back / np.sqrt(seen_emb[words_])
            m.emb[0] = 0
    _calibrate(m, texts, toxic, tune, weight)
    return m


def _best_cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the greatest F1; ties go to the middle of the widest gap."""
    order = np.argsort(-logit)
    hit, all_ = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (y * weight).sum())
    edge = np.append(logit[order][1:], logit[order][-1] - 2)
    gap = logit[order] - edge
    f1[gap <= 0] = 0  # equal scores are not parted
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = good[gap[good].argmax()]
    return float((logit[order][k] + edge[k]) / 2)


def _calibrate(m: Model, texts, toxic: np.ndarray, tune: np.ndarray, weight: np.ndarray, least: int = 12) -> None:
    logit, lang = m.score(texts)
    rows = tune if toxic[tune].sum() >= 3 else np.ones(len(toxic), bool)
    if not toxic[rows].sum():
        m.cut[:] = 1e9 if not len(toxic) else logit.max() + 1
        return
    m.cut[:] = _best_cut(logit[rows], toxic[rows], weight[rows])
    for k in range(len(LANGS)):
        own = rows & (lang == k)
        if toxic[own].sum() >= least:
            m.cut[k] = _best_cut(logit[own], toxic[own], weight[own])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 64 << 20) -> Model:
    """Trains on about ``sample`` labelled texts of at most ``sample_bytes``, a third of them toxic where there are so many.

    They are drawn by a hash of doc_id among the labels whose crc32(doc_id) mod 3 is not 1.
    """
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    learn = learn.filter("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 != 1")
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    share = [min(1.0, part / max(count.get(k, 0), 1)) for k, part in ((0, sample * 2 / 3), (1, sample / 3))]
    level = F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    drawn = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < level)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = bounded_sample(rows, ["doc_id", "toxic"], 2 * sample, sample_bytes).sort_values("doc_id")
    tune = np.array([hash_of(i) for i in rows["doc_id"]], dtype=int) % 9 < 3
    toxic, texts = rows["toxic"].to_numpy(int) == 1, pa.array(rows["text"], pa.string())
    del rows
    return train(texts, toxic, tune, np.where(toxic, 1 / share[1], 1 / share[0]))


def hash_of(doc_id: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode()) // 3


def score_texts(docs: DataFrame, model: Model, row: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, and with ``row`` the whole row of ``docs`` as a struct, of every row of ``docs``."""
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if row else []

    def run(batches):
        for batch in batches:
            p = model.probability(batch.column(2))
            rest = [batch.column(k) for k in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.7).astype(np.int32)), *rest], names=["doc_id", "held_out", "score", "predicted", *["row" for _ in rest]])

    held = F.coalesce(F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), *more)
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return rows.mapInArrow(run, schema + (f", row {rows.schema['row'].dataType.simpleString()}" if row else ""))


def detect_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) are learnt from only where crc32(doc_id) mod 3 is not 1, and
    at most about ``sample`` of them and 64 MB of text, of texts up to 1 MB; an id that repeats
    is one of them.
    Null texts count as empty and are scored; a null
    doc_id is not held out and not learnt from; null labels are not learnt from; without a
    toxic label nothing is predicted toxic; very long texts are scored whole; repeated rows
    are all returned; other columns are ignored; an empty table gives no rows.
    """
    return score_texts(docs, fit(docs, labels, sample))
