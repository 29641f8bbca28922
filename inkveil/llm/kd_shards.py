"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

Each node of the tree splits at the weighted median of its widest dimension (extent as a
share of the whole table's), so that leaves hold about the same bytes.  Medians come from
histograms of at most ``bins`` sums per node, refined where the median lies; only those sums
reach the driver, however many rows there are.  Points are written once; a row's place in
the tree follows from the splits found so far, at most one per shard.

Equal texts are one point.  Points of more than ``heavy`` of a shard are few (at most
shards / heavy) and known to the driver, which gives each to a side and sets the median of
the light points so that the sides come out even.  Only equal texts that outweigh a whole
shard are parted, along a hash of their ids at one place, so they fill as few shards as the
law allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, literal_table

_RANGE = 1 << 30
_KEYS = 1 << 62
_TIES = 1 << 32
_DIMS = range(4)


def _points(docs: DataFrame, shards: int, heavy: float, often: float) -> tuple[DataFrame, dict, int]:
    """Points (doc_id, size, text_crc32, c0 to c3, tie, atom), the atoms by number, and the number of rows."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    name = lambda c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(_RANGE)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data, F.octet_length(data)).alias("t"),
        (name("source") if "source" in docs.columns else F.lit(-1).cast("long")).alias("c1"),
        (name("lang") if "lang" in docs.columns else F.lit(-1).cast("long")).alias("c2"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("c3"),
    )
    rows = cut(rows)
    whole = rows.agg(F.sum("size").alias("w"), F.count("*").alias("n")).first()
    weight, count = whole["w"] or 0, whole["n"]
    groups = rows.groupBy("t").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("size").alias("c0"), *[F.min(c).alias(c) for c in ("c1", "c2", "c3")])
    groups = cut(groups.filter((F.col("n") > 1) | (F.col("w") > heavy * weight / shards)))
    # At most shards / heavy + 1 / often groups are known, whatever the number of rows.
    known = groups.filter((F.col("w") > heavy * weight / shards) | (F.col("n") > often * count)).collect()
    known = [(k, r.asDict(), r["w"] * shards > weight and r["n"] > 1) for k, r in enumerate(sorted(known, key=lambda r: r["t"]))]
    atoms = {k: r for k, r, parted in known if not parted and r["w"] > heavy * weight / shards}
    data = [(r["t"], r["c1"], r["c2"], r["c3"], parted, k if k in atoms else None) for k, r, parted in known]
    some = literal_table(docs.sparkSession, data, "t long, k1 long, k2 long, k3 long, parted boolean, atom int")
    rows = rows.join(F.broadcast(some), "t", "left")
    # Rows of known groups need no partner; a hash of their own keeps them from one task.
    rows = rows.withColumn("j", F.when(F.col("parted").isNotNull(), F.xxhash64("t", "doc_id")).otherwise(F.col("t")))
    light = groups.select(F.col("t").alias("j"), *[F.col(f"c{d}").alias(f"g{d}") for d in (1, 2, 3)])
    both = rows.join(light.join(F.broadcast(some.select(F.col("t").alias("j"))), "j", "left_anti"), "j", "left")
    coords = [F.coalesce(f"k{d}", f"g{d}", f"c{d}").alias(f"c{d}") for d in (1, 2, 3)]
    tie = F.when(F.col("parted"), F.xxhash64("t", "doc_id")).otherwise(F.col("t"))
    points = both.select("doc_id", "size", "text_crc32", F.col("size").alias("c0"), *coords, F.pmod(tie, F.lit(_TIES)).alias("tie"), "atom")
    return cut(points), atoms, count


def _place(value, low, span):
    return (value - low) / span * float(_RANGE - 1)


def _keyed(points: DataFrame, base: list[int], span: list[float]) -> DataFrame:
    """``points`` with k0 to k3: a coordinate, scaled to 30 bits, above 32 bits of the tie-breaker."""
    place = lambda d: F.floor(_place(F.col(f"c{d}"), F.lit(base[d]), F.lit(span[d]))).cast("long")
    return points.select("*", *[(place(d) * F.lit(_TIES) + F.col("tie")).alias(f"k{d}") for d in _DIMS])


def _walk(turns: list[dict], leaf, node: int = 0, level: int = 0) -> Column:
    """The tree found so far as one expression of a row: ``leaf`` of the node that its keys lead to.

    ``turns`` has for each level the splits by node: dimension, least key of the right side, node of the right side.
    """
    if level == len(turns):
        return leaf(node)
    on = _walk(turns, leaf, node, level + 1)
    if node not in turns[level]:
        return on
    dim, at, right = turns[level][node]
    return F.when(F.col(f"k{dim}") >= F.lit(at), _walk(turns, leaf, right, level + 1)).otherwise(on)


def _side(atoms: list[tuple[int, int]], below, goal: float, total: float) -> tuple[set[int], float]:
    """Which atoms (key, weight) go left, and the light weight that goes with them.

    They part where the median of all points lies; where one side's atoms alone outweigh it,
    the atom that mends most changes sides until none does.
    """
    order = sorted(range(len(atoms)), key=lambda k: atoms[k])
    left, weight, heavy = set(), 0, sum(w for _, w in atoms)
    for k in order:
        key, w = atoms[k]
        if weight + w / 2 + below(key) > goal:
            break
        left.add(k)
        weight += w
    while (over := max(weight - goal, heavy - weight - (total - goal))) > 0:
        out = weight > goal
        k = min((k for k in order if (k in left) == out), key=lambda k: abs(over - atoms[k][1]))  # noqa: B023
        if abs(over - atoms[k][1]) >= over:
            break
        left ^= {k}
        weight += -atoms[k][1] if out else atoms[k][1]
    return left, goal - weight


def tree_shards(docs: DataFrame, shards: int = 16, bins: int = 4096, tolerance: float = 1e-3, heavy: float = 0.01, often: float = 1e-3) -> tuple[DataFrame, int]:
    """Points with their ``shard``, the leaf of the tree, and the number of rows."""
    points, atoms, count = _points(docs, shards, heavy, often)
    whole = points.agg(*[f(f"c{d}").alias(f"{n}{d}") for d in _DIMS for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    base = [whole[f"lo{d}"] or 0 for d in _DIMS]
    span = [float(max((whole[f"hi{d}"] or 0) - base[d], 1)) for d in _DIMS]
    points = _keyed(points, base, span)
    light, turns = points.filter("atom IS NULL"), []
    width, home = {0: shards}, dict.fromkeys(atoms, 0)  # width: first shard of a node: number of its shards
    while any(n > 1 for n in width.values()):
        ends = [f(f"c{d}").alias(f"{n}{d}") for d in _DIMS for f, n in ((F.min, "lo"), (F.max, "hi"))]
        part = {r["node"]: r.asDict() for r in light.withColumn("node", _walk(turns, F.lit)).groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}
        state = {}
        for n, k in width.items():
            own = [a for a in atoms if home[a] == n]
            r = part.get(n, {"w": 0})
            if k < 2 or not (own or r["w"]):
                continue
            values = {d: [*(atoms[a][f"c{d}"] for a in own), *([r[f"lo{d}"], r[f"hi{d}"]] if r["w"] else [])] for d in _DIMS}
            dim = max(_DIMS, key=lambda d: (max(values[d]) - min(values[d])) / span[d])  # noqa: B023
            total = r["w"] + sum(atoms[a]["w"] for a in own)
            state[n] = {"dim": dim, "own": own, "lo": 0, "hi": _KEYS, "before": 0, "light": r["w"], "w": total, "goal": total * (k // 2) / k, "at": None}
        first = True
        while todo := {n: s for n, s in state.items() if s["at"] is None}:
            step = {n: -(-(s["hi"] - s["lo"]) // bins) for n, s in todo.items()}
            span_of = {n: (f"k{s['dim']}", s["lo"], s["hi"]) for n, s in todo.items()}
            bins_of = {n: f"CASE WHEN {k} >= {lo}L AND {k} < {hi}L THEN ({k} - {lo}L) div {step[n]}L + {n * bins}L END" for n, (k, lo, hi) in span_of.items()}
            cell = _walk(turns, lambda n: F.expr(bins_of.get(n, "cast(NULL AS long)")))  # noqa: B023
            sums = light.withColumn("cell", cell).groupBy("cell").agg(F.sum("size").alias("w")).collect()
            sums = [(*divmod(r["cell"], bins), r["w"]) for r in sums if r["cell"] is not None]
            for n, s in todo.items():
                bars = sorted((b, w) for m, b, w in sums if m == n)
                if first:
                    d = s["dim"]
                    places = [(int(_place(atoms[a][f"c{d}"], base[d], span[d])) * _TIES + atoms[a]["t"] % _TIES, atoms[a]["w"]) for a in s["own"]]
                    below = lambda key: sum(w for b, w in bars if b < key // step[n])  # noqa: B023, E731
                    left, s["goal"] = _side(places, below, s["goal"], s["w"])
                    home |= {a: n if k in left else n + width[n] // 2 for k, a in enumerate(s["own"])}
                if s["goal"] <= 0 or s["goal"] >= s["light"]:
                    s["at"] = 0 if s["goal"] <= 0 else _KEYS
                    continue
                have = s["before"]
                for b, w in bars:
                    if have + w >= s["goal"]:
                        start = s["lo"] + b * step[n]
                        if step[n] <= 1 or w <= tolerance * s["w"]:
                            s["at"] = start if s["goal"] - have <= have + w - s["goal"] else start + step[n]
                        else:
                            s["before"], s["lo"], s["hi"] = have, start, min(start + step[n], s["hi"])
                        break
                    have += w
                else:
                    s["at"] = s["hi"]
            first = False
        turns.append({n: (s["dim"], s["at"], n + width[n] // 2) for n, s in state.items()})
        width = {m: k for n, k in width.items() for m, k in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, k),))}
    homes = [home.get(a, "NULL") for a in range(max(home, default=-1) + 1)]
    own = F.expr(f"get(array({', '.join(map(str, homes))}), atom)") if homes else F.lit(None)
    points = points.withColumn("shard", F.coalesce(own.cast("int"), _walk(turns, F.lit)))
    return points.drop("atom", *[f"k{d}" for d in _DIMS]), count


def shard_documents(docs: DataFrame, shards: int = 16, per_bucket: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    The law is ``bytes``: shards of nearly equal size, as far as single texts and groups of
    equal texts allow.  Equal texts share a shard unless together they outweigh one.  Null
    texts count as empty (size 1, checksum 0); null metadata come first in their dimension;
    repeated rows all have a slot; very long texts are weighed alone; other columns are
    ignored; an empty table gives no rows.  Slots are numbered in hashed buckets and shifted
    by the buckets before, so that no task holds a whole shard.
    """
    rows, n = tree_shards(docs, shards)
    bucket = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(max(1, n // (shards * per_bucket)))).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "tie", bucket.alias("bucket"))
    count = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "tie", "text_crc32"))
    out = rows.withColumn("local", local).join(count.withColumn("before", before).drop("n"), ["shard", "bucket"])
    slot = (F.col("before") + F.col("local") - 1).cast("long").alias("slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
