"""Joins of texts with sensitive terms, and the three passes built on them.

Texts are (request_id, box_id, group_id, norm, x_min, y_min, x_max, y_max); terms are
(request_id, tag, term, is_name, in_lookup).  ``request_id`` is an equality key of every join;
what can be ruled out natively never reaches the Arrow scores, and all scores of a pair are
taken in one call.  ``keys`` adds the tag where each tag is matched on its own.  The boxes of
a request are those of one image, so neighbours and runs are found in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import can_partial, can_ratio, fuzz_partial_ratio, fuzz_ratio, max_edits, member_score, pair_scores, run_spells
from inkveil.operators.settle import settle

MAX_RUN = 5
#: Thresholds of single boxes, of boxes cut from the same block as a hit, and of words.
SINGLE, SIBLING, WORD = 85, 63, 90


def fuzzy_band(norm: Column, term: Column, least: float = 0.45) -> Column:
    """Whether the lengths let a text and a term resemble each other."""
    a, b = F.length(norm), F.length(term)
    return (a >= 3) & (b > 0) & (a >= F.lit(least) * b) & (b >= F.lit(least) * a)


def word_band(word: Column, term: Column) -> Column:
    """Whether the lengths let a ratio be above 90: within 9 : 11."""
    a, b = F.length(word), F.length(term)
    return (a > 0) & (b > 0) & (11 * a > 9 * b) & (11 * b > 9 * a)


def edit_band(norm: Column, term: Column) -> Column:
    """Whether a text and a one-word name are long enough, and their lengths within the edits allowed."""
    a, b = F.length(norm), F.length(term)
    return (F.instr(term, " ") == 0) & (a >= 3) & (b >= 3) & (F.abs(a - b) <= max_edits(F.least(a, b)))


def few_edits(norm: Column, term: Column) -> Column:
    edits = max_edits(F.least(F.length(norm), F.length(term)))
    return edit_band(norm, term) & (F.levenshtein(norm, term) <= edits)


def _words(norm: Column) -> Column:
    return F.filter(F.split(norm, r"\s+"), lambda w: w != "")


def has_number(norm: Column, term: Column) -> Column:
    """Whether a word of four digits or more is part of a term."""
    return F.exists(_words(norm), lambda w: w.rlike("^[0-9]{4,}$") & F.contains(term, w))


def _pairs(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Texts with the distinct terms of their request."""
    flags = [F.max(c).alias(c) for c in ("is_name", "in_lookup") if c in terms.columns]
    once = terms.groupBy(*keys, "term").agg(*flags) if flags else terms.select(*keys, "term").distinct()
    for c, default in (("is_name", False), ("in_lookup", True)):
        if c not in once.columns:
            once = once.withColumn(c, F.lit(default))
    return texts.join(once, "request_id")


def scored(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box_id, group_id, fuzzy, near, word, name): which rules a box meets with some term.

    ``fuzzy`` and ``near`` are the partial ratio at the two thresholds, with the guard for
    short texts; ``word`` is a nearly equal word; ``name`` a few edits from a name.
    """
    norm, term = F.col("norm"), F.col("term")
    pairs = _pairs(texts, terms, keys)
    part = F.col("in_lookup") & fuzzy_band(norm, term) & can_partial(norm, term, SIBLING)
    word = F.col("in_lookup") & F.exists(_words(norm), lambda w: word_band(w, term) & can_ratio(w, term, WORD))
    pairs = pairs.select(*keys, "box_id", "group_id", "norm", "term", part.alias("p"), word.alias("w"), (F.col("is_name") & few_edits(norm, term)).alias("name")).filter("p OR w OR name")
    pairs = pairs.withColumn("s", pair_scores("norm", "term", "p", "w"))
    sure = (F.length(norm) > 5) | (F.col("s.whole") >= 70)
    rules = {"fuzzy": F.col("p") & sure & (F.col("s.part") > SINGLE), "near": F.col("p") & sure & (F.col("s.part") > SIBLING), "word": F.col("s.word") > WORD, "name": F.col("name")}
    return pairs.groupBy(*keys, "box_id", "group_id").agg(*[F.max(c).alias(n) for n, c in rules.items()])


def fuzzy_hits(texts: DataFrame, terms: DataFrame, keys: list[str], threshold: float = SINGLE, least: float = 0.45) -> DataFrame:
    """Boxes whose text is part of a term or holds it; texts of up to five letters must also resemble it whole."""
    norm, term = F.col("norm"), F.col("term")
    pairs = _pairs(texts, terms, keys).filter(F.col("in_lookup") & fuzzy_band(norm, term, least) & can_partial(norm, term, threshold))
    pairs = pairs.filter(fuzz_partial_ratio("norm", "term") > threshold)
    return pairs.filter((F.length("norm") > 5) | (fuzz_ratio("norm", "term") >= 70)).select(*keys, "box_id").distinct()


def token_hits(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with a word that nearly equals a term."""
    words = texts.withColumn("norm", F.explode(_words(F.col("norm"))))
    pairs = _pairs(words, terms, keys).filter(F.col("in_lookup") & word_band(F.col("norm"), F.col("term")) & can_ratio(F.col("norm"), F.col("term"), WORD))
    return pairs.filter(fuzz_ratio("norm", "term") > WORD).select(*keys, "box_id").distinct()


def name_hits(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes a few edits away from a one-word name term; native throughout."""
    pairs = _pairs(texts, terms, keys).filter(F.col("is_name") & few_edits(F.col("norm"), F.col("term")))
    return pairs.select(*keys, "box_id").distinct()


def sibling_hits(texts: DataFrame, terms: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes cut from the same block as a hit, at a lower threshold."""
    groups = hits.join(texts.select("request_id", "box_id", "group_id"), ["request_id", "box_id"]).select(*keys, "group_id").distinct()
    near = texts.join(groups.select("request_id", "group_id").distinct(), ["request_id", "group_id"])
    found = fuzzy_hits(near, terms, keys, threshold=SIBLING).join(texts.select("request_id", "box_id", "group_id"), ["request_id", "box_id"])
    return found.join(groups, [*keys, "group_id"], "left_semi").select(*keys, "box_id")


def near_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name): pairs of two lists within the edits allowed, by an equality join.

    A name of length n is cut into one segment more than its edits; a word within the edits
    holds one of them unchanged, shifted by at most the edits.
    """
    edits = lambda n: f"CASE WHEN {n} <= 3 THEN 0 WHEN {n} <= 5 THEN 1 WHEN {n} <= 9 THEN 2 ELSE 3 END"
    cut = lambda n, i: f"cast(floor({i} * {n} / ({edits(n)} + 1)) as int)"
    own = F.expr(f"transform(sequence(0, {edits('length(name)')}), i -> named_struct('n', length(name), 'i', i, 's', substring(name, {cut('length(name)', 'i')} + 1, {cut('length(name)', '(i + 1)')} - {cut('length(name)', 'i')})))")
    size = "length(word)"
    starts = f"sequence(greatest(0, {cut('n', 'i')} - 3), least({cut('n', 'i')} + 3, greatest(0, {size} - 1)))"
    piece = f"named_struct('n', n, 'i', i, 's', substring(word, p + 1, {cut('n', '(i + 1)')} - {cut('n', 'i')}))"
    lengths = f"filter(sequence(greatest(3, {size} - 3), {size} + 3), n -> abs(n - {size}) <= {edits(f'least(n, {size})')})"
    other = F.expr(f"array_distinct(flatten(transform({lengths}, n -> flatten(transform(sequence(0, {edits('n')}), i -> transform({starts}, p -> {piece}))))))")
    a = words.select("word").distinct().filter("length(word) >= 3").select("word", F.explode(other).alias("k")).select("word", "k.*")
    b = names.select("name").distinct().filter("length(name) >= 3").select("name", F.explode(own).alias("k")).select("name", "k.*")
    return a.join(b, ["n", "i", "s"]).select("word", "name").distinct().filter(few_edits(F.col("word"), F.col("name")))


def by_length(words: DataFrame, terms: DataFrame, band, reach: float) -> DataFrame:
    """Pairs (norm, term) whose lengths are in a band, joined by the length of the term, which the band
    bounds by ``reach`` times the length of the text."""
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length("norm") * reach).cast("int"))), lambda n: band(F.length("norm"), n))
    return words.withColumn("__n", F.explode(sizes)).join(terms.withColumn("__n", F.length("term")), "__n").drop("__n")


def _lines(boxes: DataFrame, overlap: float, gap: float) -> DataFrame:
    """(request_id, bs, next): the boxes of each request in order, and the nearest box to the right of each."""
    text = F.col("norm") if "norm" in boxes.columns else F.lit("")
    cols = ["box_id", *[F.col(c).cast("double").alias(c) for c in ("x_min", "y_min", "x_max", "y_max")], text.alias("norm")]
    per = boxes.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("bs"))

    def nearest(a):
        def right(b):
            height, low = a.y_max - a.y_min, F.least(a.y_max - a.y_min, b.y_max - b.y_min)
            shared = F.least(a.y_max, b.y_max) - F.greatest(a.y_min, b.y_min)
            return (b.x_min > a.x_min) & (low > 0) & (shared >= F.lit(overlap) * low) & (b.x_min - a.x_max <= F.lit(gap) * height)

        return F.array_min(F.transform(F.filter("bs", right), lambda b: F.struct(b.x_min.alias("x"), b.box_id.alias("id")))).id

    return per.withColumn("next", F.transform("bs", nearest))


def next_boxes(boxes: DataFrame, overlap: float = 0.4, gap: float = 2.0) -> DataFrame:
    """(request_id, box_id, next_id): the nearest box to the right on the same line."""
    pairs = _lines(boxes, overlap, gap).select("request_id", F.explode(F.arrays_zip(F.col("bs.box_id").alias("box_id"), F.col("next").alias("next_id"))).alias("p"))
    return pairs.select("request_id", "p.box_id", "p.next_id").filter("next_id IS NOT NULL")


def runs(texts: DataFrame, overlap: float = 0.4, gap: float = 2.0) -> DataFrame:
    """(request_id, start_id, hop, box_ids, combined): each box with a text, followed by up to four neighbours."""
    rows = _lines(texts, overlap, gap).withColumn("at", F.map_from_arrays("bs.box_id", F.arrays_zip(F.col("next").alias("next"), F.col("bs.norm").alias("norm"))))
    step = lambda path: F.element_at(F.col("at"), F.element_at(path, -1)).next
    path = lambda a: F.aggregate(F.sequence(F.lit(1), F.lit(MAX_RUN - 1)), F.array(a.box_id), lambda p, _: F.when(step(p).isNull(), p).otherwise(F.concat(p, F.array(step(p)))))
    rows = rows.select("request_id", "at", F.explode(F.transform(F.filter("bs", lambda a: a.norm != ""), path)).alias("path")).filter("size(path) > 1")
    rows = rows.select("request_id", "path", F.transform("path", lambda b: F.element_at(F.col("at"), b).norm).alias("norms"), F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("hop"))
    upto = F.col("hop") + 1
    combined = F.array_join(F.filter(F.slice("norms", F.lit(1), upto), lambda n: n != ""), " ")
    return rows.select("request_id", F.get("path", F.lit(0)).alias("start_id"), "hop", F.slice("path", F.lit(1), upto).alias("box_ids"), combined.alias("combined"))


def splittable(terms: DataFrame) -> DataFrame:
    """Terms that can be spread over several boxes: of several words, or long with a digit."""
    return terms.filter("instr(term, ' ') > 0 OR (length(term) >= 6 AND term rlike '[0-9]')")


def first_runs(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_id, hop, box_ids): the shortest run from each start that spells a term."""
    every = runs(texts).filter(F.length("combined") >= 4)
    pairs = every.join(splittable(terms).select(*keys, "term").distinct(), "request_id").filter(F.length("combined") >= F.lit(0.6) * F.length("term"))
    # A whole or tail ratio of 85 needs 0.739 of the term's characters, a part of 90 its own bound.
    common = F.length("term") - F.length(F.call_function("translate", F.col("term"), F.col("combined"), F.lit("")))
    part = (F.length("combined") <= F.lit(1.3) * F.length("term")) & can_partial(F.col("combined"), F.col("term"), 90)
    pairs = pairs.filter((common >= F.lit(0.739) * F.length("term")) | part).filter(run_spells("combined", "term"))
    return pairs.groupBy(*keys, "start_id").agg(F.min("hop").alias("hop"), F.min_by("box_ids", "hop").alias("box_ids"))


def member_hits(boxes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes (keys, box_id, norm) that resemble one of their terms, or hold a number of it."""
    own = boxes.filter("norm <> ''").join(members.select(*keys, "term").distinct(), keys).filter("term <> ''")
    norm, term, bare = F.col("norm"), F.col("term"), F.replace(F.col("norm"), F.lit(" "), F.lit(""))
    # A text inside a term, or around one, scores 100.
    sure = has_number(norm, term) | F.contains(term, norm) | F.contains(norm, term)
    own = own.withColumn("sure", sure).filter(F.col("sure") | can_partial(norm, term, 85) | can_partial(bare, term, 85))
    score = member_score(F.when(~F.col("sure"), norm), term)
    return own.filter(F.col("sure") | (score >= 85)).select(*keys, "box_id").distinct()


def run_hits(texts: DataFrame, terms: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of the shortest matching run from each start that themselves resemble a member term."""
    boxes = first_runs(texts, terms, keys).select(*keys, F.explode("box_ids").alias("box_id")).distinct()
    return member_hits(boxes.join(texts.select("request_id", "box_id", "norm"), ["request_id", "box_id"]), members, keys)


def detect(texts: DataFrame, terms: DataFrame, by_tag: bool = False) -> DataFrame:
    """Hits (request_id[, tag], box_id): single boxes, then their siblings, then runs of boxes."""
    keys = ["request_id", "tag"] if by_tag else ["request_id"]
    texts, terms = settle(texts), settle(terms)
    rules = scored(texts, terms, keys).withColumn("one", F.col("fuzzy") | F.col("word") | F.col("name"))
    # Boxes of a block are siblings; a block without a number is nobody's.
    blocks = rules.groupBy(*keys, "group_id").agg(F.collect_set(F.when(F.col("one"), F.col("box_id"))).alias("ones"), F.collect_set(F.when(F.col("near"), F.col("box_id"))).alias("nears"))
    found = F.when((F.size("ones") > 0) & F.col("group_id").isNotNull(), F.array_union("ones", "nears")).otherwise(F.col("ones"))
    near = blocks.select(*keys, F.explode(found).alias("box_id"))
    lookup = terms.filter("in_lookup") if "in_lookup" in terms.columns else terms
    return near.union(run_hits(texts, lookup, terms, keys)).distinct()
