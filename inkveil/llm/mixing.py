"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in the order of a hash, are one stream of words cut into blocks.
A source gives whole rounds of its stream and then a number of blocks, drawn by a seeded
permutation of the block numbers (swap-or-not).  The tree deals the blocks of all sources to the output
shards: each node draws how many of each source go left, without replacement, so that every
shard is a random sample and all quotas are met exactly.  Shards take disjoint ranges of the
permuted blocks and order them by a hash of their own.  Only blocks within a shard's quota
are taken, so what a row gives is the sum of its pieces of blocks in the shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
#: Rounds of the permutation of a source's blocks.
ROUNDS = 24


@dataclass
class Share:
    """What one source gives: ``rounds`` of its whole stream, ``drawn`` blocks and ``rest`` words of one more."""

    source: str | None
    rows: int
    size: int
    target: float
    blocks: int = 0
    rounds: int = 0
    drawn: int = 0
    rest: int = 0
    left: int = 0


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        scale = (total - sum(out[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * scale > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else weights[i] * scale
        free = free - full if full else set()
    return out


def plan(totals: list[tuple[str | None, int, int]], share: float = 1.5, most: float = 2.0, weights=WEIGHTS, block: int = 128) -> list[Share]:
    """Targets and block quotas of (source, rows, words); sources by code point, null last."""
    totals = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    targets = water_fill([t[2] for t in totals], [weights[i % len(weights)] for i in range(len(totals))], share * sum(t[2] for t in totals), most)
    out = []
    for (source, rows, size), target in zip(totals, targets):
        s = Share(source, rows, size, target, blocks=-(-size // block))
        if size:
            words = min(round(target), int(most * size))
            s.rounds = min(words // size, int(most))
            left = words - s.rounds * size
            s.left = left
            s.drawn, s.rest = left // block, left % block
        out.append(s)
    return out


def permuted(block: str, blocks: str = "blocks") -> str:
    """SQL of a block's place in the permutation of its source's blocks, by the ``keys`` of the source.

    Swap-or-not: each round pairs x with key - x and swaps the pair or not by a hash of the
    greater one, which permutes the numbers below ``blocks`` whatever their count.
    """
    other = f"pmod(k - x, {blocks})"
    return f"aggregate(keys, {block}, (x, k) -> CASE WHEN (xxhash64(k, greatest(x, {other})) & 1) = 1 THEN {other} ELSE x END)"


def _even_out(spark, shares: list[Share], keys: list[list[int]], block: int) -> None:
    """A stream's last block may be short; if it is drawn, others make up for it."""
    short = [k for k, s in enumerate(shares) if s.blocks * block > s.size]
    if not short:
        return
    data = [(k, shares[k].blocks, keys[k]) for k in short]
    last = spark.createDataFrame(data, "i int, blocks long, keys array<long>").select("i", F.expr(permuted("blocks - 1")).alias("at"))
    for i, at in last.collect():
        s = shares[i]
        if at < s.drawn:
            s.drawn, s.rest = divmod(min(s.left + s.blocks * block - s.size, s.blocks * block), block)
        elif at == s.drawn and s.rest > block - (s.blocks * block - s.size):
            # Only its words can be taken; what is missing is less than a block.
            s.rest = block - (s.blocks * block - s.size)


def split_quotas(quotas: list[int], shards: int, seed: int = 17) -> np.ndarray:
    """(shards, sources) block counts; each node draws its left part without replacement."""
    unit = max(1, -(-sum(quotas) // 500_000_000))  # the sampler's bound: larger counts are dealt in units
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(counts: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = counts * unit
            return
        half = n // 2
        left = rng.multivariate_hypergeometric(counts, int(counts.sum()) * half // n, method="marginals")
        deal(left, first, half)
        deal(counts - left, first + half, n - half)

    whole = np.array([q // unit for q in quotas], np.int64)
    if whole.sum():
        deal(whole, 0, shards)
    for s, q in enumerate(quotas):  # what doesn't fill a unit
        out[s % shards, s] += q - int(whole[s]) * unit
    return out


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(rows: DataFrame, cells: list[str], size: str, order: list, whole: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``__stop``, the sum of ``size`` up to and with a row of its source, and the sums of ``whole`` over the source.

    The order is that of ``cells``, of which the first is the source, and within one that of
    ``order``.  Prefix sums are taken in the cells and shifted by the cells before, so that no
    task holds a whole source.
    """
    source = Window.partitionBy(cells[0])
    per = rows.groupBy(*cells).agg(F.sum(size).alias("__w"), *[F.sum(c).alias(f"__all{c}") for c in whole])
    before = (F.sum("__w").over(source.orderBy(*cells[1:])) - F.col("__w")).alias("__before")
    per = cut(per.select(*[F.col(c).alias(f"{c}2") for c in cells], before, *[F.sum(f"__all{c}").over(source).alias(f"__all{c}") for c in whole]))
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(cells[0]).eqNullSafe(F.col(f"{cells[0]}2"))
    for c in cells[1:]:
        same = same & (F.col(c) == F.col(f"{c}2"))
    rows = rows.withColumn("__in", F.sum(size).over(inside)).join(per, same)
    return rows.withColumn("__stop", F.col("__before") + F.col("__in")).drop(*[f"{c}2" for c in cells], "__before", "__in")


def streams(rows: DataFrame, share: float, most: float, block: int, seed: int, shards: int, per_bucket: int = 1024, most_sources: int = 100_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with the range [start, stop) of their source's stream and the source's plan.

    Prefix sums are taken in hashed buckets of a source; ``ties`` order rows of one doc_id and
    size.  The totals of the sources are planned on the driver; more than ``most_sources`` are
    refused rather than left out.
    """
    rows = rows.withColumn("__p", F.xxhash64(F.lit(seed), "doc_id", "size"))
    lean = rows.select(F.col("source").cast("string").alias("source"), "size", "__p")
    sums = lean.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    shares = plan([(r["source"], r["rows"], r["size"]) for r in sums], share, most, block=block)
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 1 << 62, (len(shares), ROUNDS)).tolist()
    _even_out(rows.sparkSession, shares, keys, block)
    dealt = split_quotas([s.rounds * s.blocks + s.drawn + (s.rest > 0) for s in shares], shards, seed)
    data = [(s.source, s.size, float(s.target), s.blocks, s.rounds, s.drawn, s.rest, s.left, -(-s.rows // per_bucket), [int(x) for x in np.cumsum(d)], k) for s, d, k in zip(shares, dealt.T, keys)]
    small = rows.sparkSession.createDataFrame(data, "__s string, source_size long, target double, blocks long, rounds long, drawn long, rest long, left long, buckets long, ends array<long>, keys array<long>")
    rows = rows.join(F.broadcast(small), F.col("source").cast("string").eqNullSafe(F.col("__s")))
    place = F.expr("cast(floor((shiftrightunsigned(__p, 34)) / double(1073741824) * buckets) as long)")
    rows = rows.withColumn("__b", place)
    rows = running(rows, ["__s", "__b"], "size", [F.expr("shiftrightunsigned(__p, 1)"), "doc_id", "size", *ties])
    return rows.withColumnRenamed("__stop", "stop").withColumn("start", F.col("stop") - F.col("size")).drop("__p", *ties)


def _pieces(block: int) -> Column:
    """array<b, turn, from, to, shard> of a row: what each of its blocks gives in each round, and the shard that the tree deals it to."""
    blocks = f"transform(sequence(start div {block}, (stop - 1) div {block}), b -> named_struct('b', b, 'at', {permuted('b')}))"
    # A block's number among all that a source gives; the shards' quotas say which are taken, and by whom.
    number, total = "(turn * blocks + x.at)", "element_at(ends, -1)"
    limit = f"CASE WHEN {number} < {total} - if(rest > 0, 1, 0) THEN {block} WHEN {number} < {total} THEN rest ELSE 0 END"
    shard = f"cast(size(filter(ends, e -> e <= {number})) as int)"
    one = f"named_struct('b', x.b, 'turn', turn, 'from', greatest(start, x.b * {block}), 'to', least(stop, x.b * {block} + {limit}), 'shard', {shard})"
    every = f"flatten(transform({blocks}, x -> transform(sequence(0L, rounds), turn -> {one})))"
    return F.expr(f"CASE WHEN size > 0 THEN filter({every}, p -> p.to > p.from) END")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = 17, shards: int = 16) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard_words of every row of ``docs``.

    ``shard_words`` has the words of the row in each output shard; taken is their sum.
    Size is the number of words (null and empty texts: 0, taken 0).  The null source is one
    source, the last.  A source's taken words miss its target by less than a block; targets
    stop at ``most`` times the source, and no row gives more than that times its size.
    Repeated rows are taken each on its own; the draw depends on the rows alone, so reruns
    agree; other columns are ignored; an empty table gives no rows.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")))
    rows = _drawn(streams(rows, share, most, block, seed, shards), block, shards)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "shard_words")


def _drawn(rows: DataFrame, block: int, shards: int) -> DataFrame:
    """``rows`` of ``streams`` with ``shard_words`` and ``taken``, their sum: what the draw takes of a row."""
    rows = rows.withColumn("__pieces", _pieces(block))
    # One pass over the pieces of a row, which are so built once.
    add = "transform(n, (w, s) -> if(s = p.shard, w + p.to - p.from, w))"
    words = F.expr(f"aggregate(coalesce(__pieces, array()), array_repeat(0L, {shards}), (n, p) -> {add})")
    return rows.withColumn("shard_words", words).withColumn("taken", F.expr("aggregate(shard_words, 0L, (n, w) -> n + w)"))


def pieces(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = 17, shards: int = 16) -> DataFrame:
    """The mix itself: shard, place, doc_id, source, first_word, n_words, one row per piece of a block.

    Pieces of a block stay in one shard; ``place`` orders a shard by a hash of the block and
    then by the stream.  Rows without words have no piece.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")))
    rows = streams(rows, share, most, block, seed, shards).filter("size > 0")
    rows = rows.withColumn("p", F.explode(_pieces(block)))
    place = F.xxhash64(F.lit(seed + 1), "source", "p.b", "p.turn").alias("place")
    return rows.select("p.shard", place, "doc_id", "source", F.expr("p.from - start").alias("first_word"), F.expr("p.to - p.from").alias("n_words"))


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = 17, shards: int = 16, per_bucket: int = 1024) -> DataFrame:
    """Whole rows of ``docs``: the draw of ``mix``, rounded to whole rows within each source.

    A row comes as often as the tree's draw takes all its words.  The words that it takes of
    rows in part go to whole ones of these, first those of which it takes most (by eighths,
    then by a hash), until they are used up; the last is taken if more than half of it is
    covered, so a source misses its drawn words by half of one row at most; a source of which
    no row were left keeps the first.  Texts without words come with whole rounds alone; repeated
    rows are taken each on its own; columns of any name pass through; an empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64("text").alias("__t"), row)
    rows = _drawn(streams(rows, share, most, block, seed, shards, per_bucket, ties=("__t",)), block, shards)
    some = "(size > 0 AND taken % size > 0)"
    rows = rows.select(
        "__row", "__s", "size", "start",
        F.expr("CASE WHEN size > 0 THEN taken div size WHEN blocks > 0 THEN least(rounds, element_at(ends, -1) div blocks) ELSE 0L END").alias("__copies"),
        F.expr("CASE WHEN size > 0 THEN taken div size ELSE 0L END").alias("__full"),
        F.expr(f"CASE WHEN {some} THEN taken % size ELSE 0L END").alias("__part"),
        F.expr(f"CASE WHEN {some} THEN size ELSE 0L END").alias("__size"),
        F.expr(f"CASE WHEN {some} THEN 8 - taken % size * 8 div size ELSE 9L END").alias("__class"),
        F.xxhash64(F.lit(seed + 2), "start").alias("__p"),
        F.expr(f"pmod(xxhash64({seed + 3}, start), buckets)").alias("__b"),
    )
    rows = running(rows, ["__s", "__class", "__b"], "__size", ["__p", "start"], ("__full", "__part"))
    again = "__part > 0 AND (2 * __stop - __size < 2 * __all__part OR (__all__full = 0 AND __stop = __size))"
    copies = F.expr(f"__copies + CASE WHEN {again} THEN 1L ELSE 0L END").alias("__n")
    return rows.select("__row", copies).filter("__n > 0").select("__row", F.expr("explode(sequence(1L, __n))")).select("__row.*")
