"""Benchmark decontamination by canonical templates.

Numbers, names (capitalised words inside a sentence; a run of them counts as one) and units
after numbers become typed placeholders, all other words lose their case and outer
punctuation.  Windows of ``WINDOW`` template words of documents and of benchmark items are
hashed and joined.  A document holds an item if its windows cover enough of the item's, and
if the values in the slots can be renamed: one to one over the whole document, or slot by slot
in one occurrence, where a number may stand for any and a name keeps one partner.  A question
with new numbers is caught, however many variants of it a text holds; two texts that only
share a form with inconsistent names are not.  Items whose typed windows are few or say too
little are searched as plain lower-case words too.  The first word of an item has no type, as
it may be capitalised for its place alone; in documents a window may so begin at any word of
a name, read as it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, buffers, chunks, cut, fold_upper, mix, word_bounds, word_hashes

WINDOW = 8
#: Shorter items are searched as one window of their own length, down to this.
SHORTEST = 3
BITS = 24
# Units of measure and money.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal ms s sec min h hr hrs d kb mb gb tb hz khz mhz ghz w kw mw v a pa kpa j kj cal kcal k c f "
    "inch inches foot feet yard yards mile miles meter meters metre metres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros usd eur gbp"
).split()
_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[97:123] = _CORE[128:] = True
NUM, NAME, UNIT = (U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03))
_HOLDERS = np.array([NUM, NAME, UNIT], U)
_ODD = [U((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(WINDOW)]


def _unit_hashes() -> np.ndarray:
    out = [word_hashes(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u)]))[0] for u in UNITS]
    return np.sort(np.array(out, U))


def templates(raw: np.ndarray, off: np.ndarray, units: np.ndarray):
    """Of a range of texts: template hash, value hash and text number of the template words; whether a word begins a template word, value hash, text number and whether it is in a name of all words."""
    low = fold_upper(raw) if len(raw) else raw
    ws, we, first = word_bounds(low, off)
    empty = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
    core = np.flatnonzero(_CORE[low])
    if not len(core) or not len(ws):
        return empty
    li, ri = np.searchsorted(core, ws), np.searchsorted(core, we) - 1
    doc = np.searchsorted(off, ws, "right") - 1
    # Does a sentence end at this word: '.', '!' or '?' anywhere in it, or a line break after it.
    stop = np.concatenate([[0], np.cumsum((raw == 46) | (raw == 33) | (raw == 63))])
    line = np.concatenate([[0], np.cumsum(raw == 10)])
    last = np.where(ri >= li, core[np.maximum(ri, 0)] + 1, ws)
    ends = stop[we] > stop[last]
    starts = np.ones(len(ws), bool)
    starts[1:] = ends[:-1] | (line[ws[1:]] > line[we[:-1]]) | (doc[1:] != doc[:-1])
    # A word of punctuation alone is no template word but may end the sentence before it.
    full = ri >= li
    group = np.cumsum(full) - 1
    if not full.any():
        return empty
    opened = np.zeros(int(full.sum()), bool)
    opened[0] = True
    carried = np.bincount(group[~full & (group >= 0)], weights=ends[~full & (group >= 0)], minlength=len(opened)) > 0
    opened = starts[full]
    opened[1:] |= carried[:-1]
    a, b, doc = core[li[full]], core[ri[full]] + 1, doc[full]
    h = word_hashes(low, a, b)
    digit = np.concatenate([[0], np.cumsum((low >= 48) & (low < 58))])
    lower = np.concatenate([[0], np.cumsum(((raw >= 97) & (raw < 123)) | ((raw >= 0x9F) & (raw < 0xC0)))])
    letters = np.concatenate([[0], np.cumsum((low >= 97) | (raw >= 128))])
    lead = raw[a]
    second = raw[np.minimum(a + 1, len(raw) - 1)]
    upper = ((lead >= 65) & (lead < 91)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    number = (digit[b] > digit[a]) & (letters[b] - letters[a] <= 2)
    name = upper & ~opened & (lower[b] > lower[a]) & ~number
    unit = np.zeros(len(h), bool)
    unit[1:] = number[:-1] & (doc[1:] == doc[:-1])
    at = np.searchsorted(units, h)
    unit &= units[np.minimum(at, len(units) - 1)] == h
    shape = np.where(number, NUM, np.where(name, NAME, np.where(unit, UNIT, h)))
    once = np.ones(len(h), bool)
    once[1:] = ~(name[1:] & name[:-1] & (doc[1:] == doc[:-1]))
    return shape[once], h[once], doc[once], once, h, doc, name


def _hash(shape: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Hashes of rows of ``size`` template words, given as a column for each word."""
    with np.errstate(over="ignore"):
        h = np.full(len(shape[0]), U(size + 64 * exact))
        for k in range(size):
            h += mix(shape[k] ^ _ODD[k % WINDOW])
    return mix(h)


def _windows(shape: np.ndarray, doc: np.ndarray, size: int, exact: bool = False):
    """Hashes of the windows of ``size`` template words, and where they start."""
    n = len(shape) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = _hash([shape[k : n + k] for k in range(size)], size, exact)
    inside = doc[:n] == doc[size - 1 :]
    if not exact:
        held = np.concatenate([[0], np.cumsum(np.isin(shape, _HOLDERS))])
        # Windows of placeholders alone say nothing.
        inside &= 2 * (size - (held[size:] - held[:n])) >= min(size, 6)
    at = np.flatnonzero(inside)
    return h[at], at


def _named_windows(shape: np.ndarray, value: np.ndarray, doc: np.ndarray, once, words, names, size: int):
    """Windows that begin at a word of a name, read as a plain word: hashes, template words they begin in, whether the name goes on, shapes and values."""
    none = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, size), U), np.zeros((0, size), U)
    j = np.flatnonzero(names)
    m = np.cumsum(once)[j] - 1
    # Does the name go on after the word: then its rest is a name of its own.
    more = np.zeros(len(j), np.int64)
    if len(j):
        more = (np.append(~once[1:], False)[j]).astype(np.int64)
    fits = m + size - 1 - more < len(shape)
    j, m, more = j[fits], m[fits], more[fits]
    inside = doc[np.minimum(m + size - 1 - more, len(doc) - 1)] == doc[m] if len(j) else np.zeros(0, bool)
    j, m, more = j[inside], m[inside], more[inside]
    if not len(j):
        return none
    kinds, values = [words[j]], [words[j]]
    for k in range(1, size):
        at = m + k - more
        rest = (more == 1) & (k == 1)
        kinds.append(np.where(rest, NAME, shape[at]))
        values.append(np.where(rest, words[np.minimum(j + 1, len(words) - 1)], value[at]))
    plain = sum((~np.isin(x, _HOLDERS)).astype(np.int64) for x in kinds)
    ok = 2 * plain >= min(size, 6)
    kinds, values = [x[ok] for x in kinds], [x[ok] for x in values]
    return _hash(kinds, size, False), m[ok], more[ok], np.stack(kinds, 1), np.stack(values, 1)


_SCHEMA = "id long, exact boolean, size int, window long, place int, n_windows int, kinds array<long>, slots array<long>, at array<int>"


def _rows(table: DataFrame, key: str, sizes: tuple[list[int], list[int]] | None, bits: bytes | None) -> DataFrame:
    """Windows of a table's texts: of the sizes given, typed and exact, or of each text's own; only those whose bit is set."""

    def run(batches):
        units = _unit_hashes()
        mask = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        set_bits = lambda h: np.ones(len(h), bool) if mask is None else mask[(h & U((1 << BITS) - 1)).astype(np.int64)]
        for batch in batches:
            ids = np.array(batch.column(0).to_numpy(zero_copy_only=False))
            buf, off = buffers(batch.column(1))
            out = [[] for _ in range(9)]

            def add(*row):
                for col, x in zip(out, row):
                    col.append(x)

            for i, j in chunks(off):
                shape, value, doc, once, words, wdoc, names = templates(buf[off[i] : off[j]], off[i : j + 1] - off[i], units)
                count, wcount = (np.bincount(d, minlength=j - i) if len(d) else np.zeros(j - i, int) for d in (doc, wdoc))
                begin, wbegin = (np.concatenate([[0], np.cumsum(c)]) for c in (count, wcount))
                typed = np.zeros(j - i, int)
                for size in range(SHORTEST, WINDOW + 1) if sizes is None else sizes[0]:
                    h, at = _windows(shape, doc, size)
                    many = np.zeros(j - i, int)
                    if sizes is None:
                        own = np.minimum(count[doc[at]], WINDOW) == size
                        h, at = h[own], at[own]
                        many = np.bincount(doc[at], minlength=j - i)
                        typed += many
                    hit = set_bits(h)
                    for w, p in zip(h[hit].view(np.int64).tolist(), at[hit].tolist()):
                        d = int(doc[p])
                        slot = np.flatnonzero(np.isin(shape[p : p + size], _HOLDERS))
                        add(int(ids[i + d]), False, size, w, p - int(begin[d]), int(many[d]), shape[p + slot].view(np.int64).tolist(), value[p + slot].view(np.int64).tolist(), slot.tolist())
                    if sizes is not None:
                        h, at, more, kinds, values = _named_windows(shape, value, doc, once, words, names, size)
                        for k in np.flatnonzero(set_bits(h)).tolist():
                            # A name that goes on is one word here and two in the item, so the place is one less.
                            d = int(doc[at[k]])
                            slot = np.flatnonzero(np.isin(kinds[k], _HOLDERS))
                            add(int(ids[i + d]), False, size, int(h[k : k + 1].view(np.int64)[0]), int(at[k] - more[k] - begin[d]), 0, kinds[k][slot].view(np.int64).tolist(), values[k][slot].view(np.int64).tolist(), slot.tolist())
                # Items of which few typed windows are left.
                thin = (typed <= 2) | (typed < count - WINDOW + 1)
                for size in range(SHORTEST, WINDOW + 1) if sizes is None else sizes[1]:
                    h, at = _windows(words, wdoc, size, True)
                    many = np.zeros(j - i, int)
                    if sizes is None:
                        own = (np.minimum(wcount[wdoc[at]], WINDOW) == size) & thin[wdoc[at]]
                        h, at = h[own], at[own]
                        many = np.bincount(wdoc[at], minlength=j - i)
                    hit = set_bits(h)
                    for w, p in zip(h[hit].view(np.int64).tolist(), at[hit].tolist()):
                        d = int(wdoc[p])
                        add(int(ids[i + d]), True, size, w, p - int(wbegin[d]), int(many[d]), [], [], [])
            types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "exact", "size", "window", "place", "n_windows", "kinds", "slots", "at"])

    rows = table.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, _SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, agreement: float = 0.8) -> DataFrame:
    """doc_id, item_id, matched, n_windows, coverage, n_slots, agreement of documents that hold an item.

    One row per document and item where at least ``coverage`` of the item's windows occur
    and at least ``agreement`` of its slot values keep one partner.  Null ids and texts,
    empty texts and items of fewer than three words match nothing; rows that repeat
    an id count as one text; other columns are ignored; empty tables give no rows.  What the
    scan of the documents is told about the benchmark is a bit map of fixed size, so items
    may be many; its false hits fall out in the join.
    """
    items = cut(_rows(benchmark, "item_id", None, None))
    # An item's own window size is min(length, WINDOW); places start at 0, so a short item has one window.
    slots = items.select(F.pmod("window", F.lit(1 << BITS)).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[slots] = True
    used = sorted((x["exact"], x["size"]) for x in items.select("exact", "size").distinct().collect())
    hits = _rows(docs, "doc_id", tuple([n for e, n in used if e == form] for form in (False, True)), np.packbits(bitmap).tobytes())
    right = items.select(F.col("id").alias("item_id"), "exact", "window", F.col("place").alias("ip"), "n_windows", F.col("kinds").alias("ikinds"), F.col("slots").alias("islots"), F.col("at").alias("iplaces")).distinct()
    both = hits.select(F.col("id").alias("doc_id"), "exact", "window", "place", "slots").join(right, ["exact", "window"])
    both = both.withColumn("shift", F.col("place") - F.col("ip"))
    both = cut(both.select("doc_id", "item_id", "exact", "shift", "ip", "n_windows", "ikinds", "islots", "iplaces", "slots").distinct())
    cover = both.groupBy("doc_id", "item_id", "exact").agg(F.countDistinct("ip").alias("matched"), F.max("n_windows").alias("n_windows"))
    cover = cover.filter(F.col("matched") >= F.lit(coverage) * F.col("n_windows"))
    agree = _agreement(both.withColumn("o", F.lit(0)), False)
    # Places of an item whose shifts differ by less than half its length are one occurrence with an edit in it.
    shifts = both.groupBy("doc_id", "item_id", "exact", "shift").agg(F.max("n_windows").alias("n"))
    by = Window.partitionBy("doc_id", "item_id", "exact").orderBy("shift")
    new = F.coalesce(2 * (F.col("shift") - F.lag("shift").over(by)) >= F.col("n") + WINDOW - 1, F.lit(True)).cast("int")
    shifts = shifts.withColumn("new", new).withColumn("o", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("n", "new")
    placed = both.join(shifts, ["doc_id", "item_id", "exact", "shift"])
    whole = placed.groupBy("doc_id", "item_id", "exact", "o").agg(F.countDistinct("ip").alias("matched"), F.max("n_windows").alias("n_windows"))
    whole = whole.filter(F.col("matched") >= F.lit(coverage) * F.col("n_windows")).select("doc_id", "item_id", "exact", "o")
    # An occurrence without slots agrees.
    held = whole.join(_agreement(placed, True), ["doc_id", "item_id", "exact", "o"], "left").groupBy("doc_id", "item_id", "exact").agg(F.max(F.coalesce("agreement", F.lit(1.0))).alias("best"))
    out = cover.join(agree.drop("o"), ["doc_id", "item_id", "exact"], "left").join(held, ["doc_id", "item_id", "exact"], "left")
    out = out.select("doc_id", "item_id", "exact", "matched", "n_windows", (F.col("matched") / F.col("n_windows")).alias("coverage"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.greatest(F.coalesce("agreement", F.lit(1.0)), F.coalesce("best", F.lit(0.0))).alias("agreement"))
    out = out.filter(F.col("agreement") >= agreement)
    # One row for an item found in both forms: the one that covers more, then the typed one.
    rest = ["matched", "n_windows", "coverage", "n_slots", "agreement"]
    best = out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*rest), F.struct("coverage", ~F.col("exact"))).alias("x"))
    return best.select("doc_id", "item_id", *[F.col(f"x.{c}").alias(c) for c in rest])


def _agreement(both: DataFrame, by_slot: bool) -> DataFrame:
    """doc_id, item_id, o, n_slots, agreement: the share of values, or of values and slots, that keep one partner."""
    key = ["doc_id", "item_id", "exact", "o"]
    z = both.select(*key, "ip", F.explode(F.arrays_zip("ikinds", "islots", "slots", "iplaces") if by_slot else F.arrays_zip("islots", "slots")).alias("z"))
    # Within an occurrence a number or unit is a slot of its own: two that are equal in the item need not be in the copy.
    item = F.when(F.col("z.ikinds") == F.lit(int(NAME.view(np.int64))), F.col("z.islots")).otherwise(F.xxhash64(F.col("ip") + F.col("z.iplaces"), "z.islots")) if by_slot else F.col("z.islots")
    own = F.when(F.col("z.ikinds") == F.lit(int(NAME.view(np.int64))), F.col("z.slots")).otherwise(F.xxhash64(F.col("ip") + F.col("z.iplaces"), "z.slots")) if by_slot else F.col("z.slots")
    pairs = z.select(*key, item.alias("i"), own.alias("d"), (F.col("z.islots") == F.col("z.slots")).alias("equal")).distinct()
    # A value keeps one partner if, of the values it meets, one is met throughout: the number of pairs is the number of values.
    sums = pairs.groupBy(*key).agg(F.countDistinct("i").alias("ni"), F.countDistinct("d").alias("nd"), F.count("*").alias("np"), F.sum(F.expr("if(equal, 1, 0)")).alias("same"))
    return sums.select(*key, F.col("ni").alias("n_slots"), F.greatest(F.least("ni", "nd") / F.col("np"), F.col("same") / F.col("ni")).alias("agreement"))
