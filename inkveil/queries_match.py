"""Queries of the matching passes and the plans on them, with SQL for every step."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkveil.functions.blocks import tokens
from inkveil.functions.image import decode, pixel_background
from inkveil.functions.text import fuzz_partial_ratio, normalize_list
from inkveil.operators import geometry, match
from inkveil.plans import api
from inkveil.queries import _LCS, _MON, _NORM, _OH, _PIX, _FORMS, _noisy, _pixels, query, t
from inkveil.sources import golden, requests

# -- pieces of SQL -------------------------------------------------------------------------


def ratio_sql(a: str, b: str) -> str:
    return f"(200.0::DOUBLE * {_LCS.format(a, b)} / (length({a}) + length({b})))"


def partial_sql(pairs: str, name: str = "pr") -> str:
    """CTEs that end in ``name`` (a, b, part): the best window ratio of the distinct (a, b) of ``pairs``."""
    return f"""{name}_p AS (SELECT DISTINCT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM ({pairs}) WHERE a <> '' AND b <> ''),
{name}_d AS (SELECT a, b, s, l FROM {name}_p UNION SELECT a, b, l, s FROM {name}_p WHERE length(a) = length(b)),
{name}_w AS (SELECT DISTINCT s, substr(l, greatest(k, 0) + 1, least(k + length(s), length(l)) - greatest(k, 0)) AS w, l FROM {name}_d, unnest(range(1 - length(s), length(l))) AS u(k)),
{name}_l AS (SELECT s, w, {ratio_sql('s', 'w')} AS r FROM (SELECT DISTINCT s, w FROM {name}_w)),
{name} AS (SELECT d.a, d.b, max(x.r) AS part FROM {name}_d d JOIN {name}_w y ON y.s = d.s AND y.l = d.l JOIN {name}_l x ON x.s = y.s AND x.w = y.w GROUP BY 1, 2)"""


def _edits_sql(a: str, b: str) -> str:
    low = f"least(length({a}), length({b}))"
    return f"(CASE WHEN {low} <= 3 THEN 0 WHEN {low} <= 5 THEN 1 WHEN {low} <= 9 THEN 2 ELSE 3 END)"


def match_sql(keys: str = "request_id") -> str:
    """CTEs from tx (request_id, box_id, group_id, norm, x_min..y_max) and tm (request_id, tag, term, is_name) to
    fz, near, tk, nm (single boxes), sib (siblings), rn (runs), fr (first matching runs), rh (members of runs)."""
    on = " AND ".join(f"{{0}}.{k.strip()} = {{1}}.{k.strip()}" for k in keys.split(","))
    k = lambda a: ", ".join(f"{a}.{x.strip()}" for x in keys.split(","))
    same = lambda a, b: on.format(a, b)
    bare = lambda c: f"replace({c}, ' ', '')"
    return f"""
pa AS (SELECT DISTINCT {k('m')}, x.request_id AS rid, x.box_id, x.group_id, x.norm AS a, m.term AS b, m.is_name FROM tx x JOIN tm m ON m.request_id = x.request_id),
fb AS (SELECT * FROM pa WHERE length(a) >= 3 AND length(b) > 0 AND length(a) >= 0.45 * length(b) AND length(b) >= 0.45 * length(a)),
{partial_sql('SELECT a, b FROM fb', 'p1')},
fs AS (SELECT f.*, p1.part FROM fb f JOIN p1 ON p1.a = f.a AND p1.b = f.b WHERE part > 63 AND (length(f.a) > 5 OR {ratio_sql('f.a', 'f.b')} >= 70)),
fz AS (SELECT DISTINCT {keys}, box_id FROM fs WHERE part > 85),
tk AS (SELECT DISTINCT {keys}, box_id FROM (SELECT * REPLACE (unnest(string_split_regex(a, '\\s+')) AS a) FROM pa) WHERE length(a) > 0 AND length(b) > 0 AND 11 * length(a) > 9 * length(b) AND 11 * length(b) > 9 * length(a) AND {ratio_sql('a', 'b')} > 90),
nm AS (SELECT DISTINCT {keys}, box_id FROM pa WHERE is_name AND NOT contains(b, ' ') AND length(a) >= 3 AND length(b) >= 3 AND abs(length(a) - length(b)) <= {_edits_sql('a', 'b')} AND levenshtein(a, b) <= {_edits_sql('a', 'b')}),
one AS (SELECT * FROM fz UNION SELECT * FROM tk UNION SELECT * FROM nm),
og AS (SELECT DISTINCT {k('o')}, x.group_id FROM one o JOIN tx x ON x.request_id = o.request_id AND x.box_id = o.box_id),
sib AS (SELECT DISTINCT {k('f')}, f.box_id FROM fs f JOIN og ON {same('og', 'f')} AND og.group_id = f.group_id),
nx AS (SELECT a.request_id, a.box_id, arg_min(b.box_id, b.x_min * 100000 + b.box_id) AS next_id FROM tx a JOIN tx b ON a.request_id = b.request_id AND b.x_min > a.x_min AND least(a.y_max - a.y_min, b.y_max - b.y_min) > 0
  AND least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min) >= 0.4 * least(a.y_max - a.y_min, b.y_max - b.y_min) AND b.x_min - a.x_max <= 2.0 * (a.y_max - a.y_min) GROUP BY 1, 2),
r0 AS (SELECT request_id, box_id AS start_id, box_id AS cur, [box_id] AS ids, norm AS combined FROM tx WHERE norm <> ''),
{", ".join(f"r{h} AS (SELECT r.request_id, start_id, n.next_id AS cur, list_append(ids, n.next_id) AS ids, trim(combined || ' ' || x.norm) AS combined FROM r{h - 1} r JOIN nx n ON n.request_id = r.request_id AND n.box_id = r.cur JOIN tx x ON x.request_id = r.request_id AND x.box_id = n.next_id)" for h in range(1, 5))},
rn AS ({" UNION ALL ".join(f"SELECT request_id, start_id, {h} AS hop, ids, combined FROM r{h}" for h in range(1, 5))}),
rp AS (SELECT DISTINCT {k('m')}, r.request_id AS rid, r.start_id, r.hop, r.ids, r.combined AS c, m.term AS b FROM rn r JOIN (SELECT DISTINCT {keys}, term FROM tm WHERE contains(term, ' ') OR (length(term) >= 6 AND regexp_matches(term, '[0-9]'))) m ON m.request_id = r.request_id WHERE length(combined) >= 4 AND length(combined) >= 0.6 * length(term)),
{partial_sql('SELECT c AS a, b FROM rp WHERE length(c) <= 1.3 * length(b)', 'p2')},
rt AS (SELECT DISTINCT c, b, i, array_to_string(string_split(c, ' ')[i:], ' ') AS tail FROM (SELECT DISTINCT c, b FROM rp), unnest(range(1, len(string_split(c, ' ')) + 1)) AS u(i)),
rm AS (SELECT DISTINCT c, b FROM rt WHERE length(tail) >= 0.6 * length(b) AND ({ratio_sql('tail', 'b')} >= 85 OR ((i = 1 OR length({bare('tail')}) >= 0.85 * length(b)) AND {ratio_sql(bare('tail'), 'b')} >= 85)) UNION SELECT a, b FROM p2 WHERE part >= 90 AND length(a) <= 1.3 * length(b)),
fr AS (SELECT {keys}, start_id, min(hop) AS hop, arg_min(ids, hop) AS box_ids FROM rp JOIN rm ON rm.c = rp.c AND rm.b = rp.b GROUP BY {keys}, start_id),
mb AS (SELECT DISTINCT {k('q')}, q.box_id, x.norm AS a, m.term AS b FROM (SELECT DISTINCT {keys}, unnest(box_ids) AS box_id FROM fr) q JOIN tx x ON x.request_id = q.request_id AND x.box_id = q.box_id JOIN (SELECT DISTINCT {keys}, term FROM tm) m ON {same('m', 'q')} WHERE x.norm <> '' AND m.term <> ''),
{partial_sql(f"SELECT a, b FROM mb UNION SELECT {bare('a')}, b FROM mb", 'p3')},
rh AS (SELECT DISTINCT {k('mb')}, box_id FROM mb LEFT JOIN p3 u ON u.a = mb.a AND u.b = mb.b LEFT JOIN p3 v ON v.a = {bare('mb.a')} AND v.b = mb.b
  WHERE u.part >= 85 OR v.part >= 85 OR len(list_filter(string_split_regex(mb.a, '\\s+'), lambda w: regexp_full_match(w, '[0-9]{{4,}}') AND contains(mb.b, w))) > 0)"""


# -- small tables: a request for each supplier ------------------------------------------------

_BASE = "(SELECT s_suppkey AS k, lower(n_name) AS w, CAST(96000000 + s_suppkey AS VARCHAR) AS num FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
#: box, block, normalised text, left, top
_LAYOUT = [
    (0, 0, "translate(w, 'eo', 'c0')", 0, 0), (1, 0, "substr(w, 1, 4)", 50, 0), (2, 1, "substr(num, 1, 4)", 100, 0), (3, 1, "substr(num, 5)", 150, 0), (4, 2, "concat(w, ' ward')", 0, 100),
    (5, 3, "concat('siemens', k % 10)", 0, 200), (6, 4, "'xanna'", 0, 300), (7, 4, "translate(w, 'ai', 'xy')", 0, 340), (8, 5, "''", 50, 200), (9, 5, "'annag'", 100, 340),
]
_TERMS = [
    ("PatientName", "concat(w, ' anna')", True), ("PatientName", "concat('anna ', w)", True), ("PatientName", "w", True), ("PatientName", "'anna'", True),
    ("PatientName", "concat(replace(w, ' ', ''), 'anna')", False), ("PatientName", "concat('anna', replace(w, ' ', ''))", False), ("PatientName", "replace(w, ' ', '')", False),
    ("PatientID", "num", False), ("InstitutionName", "'siemens ag'", False), ("InstitutionName", "'siemensag'", False),
]
_TX = "tx AS (" + " UNION ALL ".join(f"SELECT k AS request_id, {b} AS box_id, {g} AS group_id, {e} AS norm, {x}.0::DOUBLE AS x_min, {y}.0::DOUBLE AS y_min, {x + 40}.0::DOUBLE AS x_max, {y + 20}.0::DOUBLE AS y_max FROM {_BASE}" for b, g, e, x, y in _LAYOUT) + ")"
_TM = "tm AS (SELECT request_id, tag, term, bool_or(is_name) AS is_name FROM (" + " UNION ALL ".join(f"SELECT k AS request_id, '{tag}' AS tag, {e} AS term, {str(n).lower()} AS is_name FROM {_BASE}" for tag, e, n in _TERMS) + ") GROUP BY 1, 2, 3)"


def _suppliers(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("w"))
    return t(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("k"), "w", (F.col("s_suppkey") + 96000000).cast("string").alias("num"))


def _small(spark, d):
    """Texts and terms of the layout above."""
    s = _suppliers(spark, d)
    boxes = F.array(*[F.struct(F.lit(b).alias("box_id"), F.lit(g).alias("group_id"), F.expr(e).alias("norm"), *[F.lit(float(v)).alias(n) for n, v in (("x_min", x), ("y_min", y), ("x_max", x + 40), ("y_max", y + 20))]) for b, g, e, x, y in _LAYOUT])
    terms = F.array(*[F.struct(F.lit(tag).alias("tag"), F.expr(e).alias("term"), F.lit(n).alias("is_name")) for tag, e, n in _TERMS])
    texts = s.select(F.col("k").alias("request_id"), F.explode(boxes).alias("b")).select("request_id", "b.*")
    terms = s.select(F.col("k").alias("request_id"), F.explode(terms).alias("t")).select("request_id", "t.*")
    return texts, terms.groupBy("request_id", "tag", "term").agg(F.max("is_name").alias("is_name")).withColumn("in_lookup", F.lit(True))


def _with(keys: str = "request_id") -> str:
    return f"WITH {_TX}, {_TM}, {match_sql(keys)}"


@query(f"WITH {partial_sql('SELECT noisy AS a, p_name AS b FROM (SELECT DISTINCT translate(w, $$eo$$, $$c0$$) AS noisy FROM (SELECT unnest(string_split(p_name, $$ $$)) AS w FROM part)) CROSS JOIN (SELECT DISTINCT p_name FROM part WHERE p_partkey <= 60) WHERE length(noisy) >= 3 AND length(noisy) >= 0.45 * length(p_name) AND length(p_name) >= 0.45 * length(noisy)')} SELECT a AS noisy, b AS term, part AS score FROM pr")
def partial_ratio_scores(spark, d):
    """noisy words against the names of the first parts in the length band."""
    a, _ = _noisy(spark, d)
    names = t(spark, d, "part").filter("p_partkey <= 60").select(F.col("p_name").alias("term")).distinct()
    pairs = match.by_length(a.withColumnRenamed("noisy", "norm").filter("length(norm) >= 3"), names, lambda m, n: (m >= F.lit(0.45) * n) & (n >= F.lit(0.45) * m), 1 / 0.45)
    return pairs.select(F.col("norm").alias("noisy"), "term", fuzz_partial_ratio("norm", "term").alias("score"))


@query(f"{_with()} SELECT * FROM fz")
def fuzzy_hits(spark, d):
    """J1, P7, F4, A15."""
    return match.fuzzy_hits(*_small(spark, d), ["request_id"])


@query(f"{_with()} SELECT * FROM tk")
def token_hits(spark, d):
    """J2, F6."""
    return match.token_hits(*_small(spark, d), ["request_id"])


@query(f"{_with()} SELECT * FROM nm")
def name_hits(spark, d):
    """J3, P8, F5."""
    return match.name_hits(*_small(spark, d), ["request_id"])


@query(f"{_with('request_id, tag')} SELECT f.request_id, f.tag, f.box_id, bool_or(f.part > 85) AS fuzzy, true AS near FROM fs f GROUP BY 1, 2, 3")
def scored_pairs(spark, d):
    """Both thresholds in one pass, for each tag."""
    found = match.scored(*_small(spark, d), ["request_id", "tag"]).filter("near")
    return found.select("request_id", "tag", "box_id", "fuzzy", "near")


@query(f"{_with()} SELECT * FROM sib")
def sibling_hits(spark, d):
    """J4."""
    texts, terms = _small(spark, d)
    one = match.fuzzy_hits(texts, terms, ["request_id"]).union(match.token_hits(texts, terms, ["request_id"])).union(match.name_hits(texts, terms, ["request_id"]))
    return match.sibling_hits(texts, terms, one.distinct(), ["request_id"])


@query(f"{_with()} SELECT request_id, start_id, hop, box_ids FROM fr")
def first_runs(spark, d):
    """J6, J7, J8, P5, P9, F7, F8, W5."""
    return match.first_runs(*_small(spark, d), ["request_id"])


@query(f"{_with()} SELECT * FROM rh")
def run_hits(spark, d):
    """J6 to J9, U-6."""
    texts, terms = _small(spark, d)
    return match.run_hits(texts, terms, terms, ["request_id"])


@query(f"{_with('request_id, tag')} SELECT * FROM one UNION SELECT * FROM sib UNION SELECT * FROM rh")
def detect_by_tag(spark, d):
    """J10, U-2: all passes for each tag on its own."""
    return match.detect(*_small(spark, d), by_tag=True)


# -- whole plans: raw boxes and tags of each supplier's request --------------------------------

_DAY = "(DATE '1950-01-15' + CAST(s_suppkey % 9000 AS INT))"
_RAW = f"(SELECT s_suppkey AS k, n_name AS w, {_DAY} AS dt, CAST(s_suppkey + 96000000 AS VARCHAR) AS num FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
_NOISY_WORD = "translate(w, 'EO', 'C0')"
_CH = f"(300 / (length({_NOISY_WORD} || ',' || num) - 0.8::DOUBLE * (length({_NOISY_WORD}) - length(replace({_NOISY_WORD}, ' ', '')))))"
_PLACE = f"(SELECT *, length({_NOISY_WORD}) - 0.8::DOUBLE * (length({_NOISY_WORD}) - length(replace({_NOISY_WORD}, ' ', ''))) AS e0, {_CH} AS ch, greatest(3, CAST(trunc({_CH} * 0.9::DOUBLE) AS INT)) AS pad FROM {_RAW})"
_CUT = f"""(SELECT k AS request_id, 0 AS box_id, 0 AS group_id, {_NOISY_WORD} AS text, CAST(0 AS DOUBLE) AS x_min, 0.0::DOUBLE AS y_min, CAST(least(300, CAST(trunc(e0 * ch) AS INT) + pad) AS DOUBLE) AS x_max, 20.0::DOUBLE AS y_max FROM {_PLACE}
UNION ALL SELECT k, 1, 0, num, CAST(greatest(0, CAST(trunc((e0 + 1) * ch - greatest(0.0::DOUBLE, least(CAST(pad AS DOUBLE), (e0 + 1) * ch - (e0 * ch + pad)))) AS INT)) AS DOUBLE), 0.0, CAST(least(300, CAST(trunc((e0 + 1 + length(num)) * ch) AS INT) + pad) AS DOUBLE), 20.0 FROM {_PLACE}
UNION ALL SELECT k, 2, 1, strftime(dt, '%d'), 60.0, 60.0, 100.0, 80.0 FROM {_RAW} UNION ALL SELECT k, 3, 2, strftime(dt, '%m'), 120.0, 60.0, 160.0, 80.0 FROM {_RAW}
UNION ALL SELECT k, 4, 3, strftime(dt, '%Y'), 180.0, 60.0, 220.0, 80.0 FROM {_RAW} UNION ALL SELECT k, 5, 4, 'SIEMENS', 240.0, 160.0, 280.0, 180.0 FROM {_RAW})"""
_RAW_TX = f"tx AS (SELECT *, {_OH.format(_NORM.format('text'))} AS norm FROM {_CUT})"
_DAYS = " UNION ".join(
    f"SELECT k, {form} AS variant FROM (SELECT k, {m}[month(dt)] AS mm, {day} AS dd, {year} AS yy FROM {_RAW})"
    for m in _MON
    for day in ("CAST(day(dt) AS VARCHAR)", "strftime(dt, '%d')")
    for year, forms in (("strftime(dt, '%Y')", _FORMS), ("strftime(dt, '%y')", _FORMS[:2]))
    for form in forms
)
_WORD = _OH.format(_NORM.format("w"))
_VALUES = f"""SELECT k, 'PatientName' AS tag, unnest([{_WORD}, 'anna', 'anna ' || {_WORD}, {_WORD} || ' anna']) AS term, true AS is_name FROM {_RAW}
UNION ALL SELECT k, 'PatientBirthDate', unnest([strftime(dt, '%d%m%Y'), strftime(dt, '%m%d%Y'), strftime(dt, '%Y%m%d')]), false FROM {_RAW} UNION ALL SELECT k, 'PatientBirthDate', variant, false FROM ({_DAYS})
UNION ALL SELECT k, 'PatientID', num, false FROM {_RAW}"""
_RAW_TM = f"tm AS (WITH v AS ({_VALUES}) SELECT k AS request_id, tag, term, bool_or(is_name) AS is_name FROM (SELECT k, tag, term, is_name FROM v UNION ALL SELECT k, tag, replace(term, ' ', ''), false FROM v) WHERE term <> '' GROUP BY 1, 2, 3)"


def _requests(spark, d):
    """A request per supplier: nation, a date and a number as tags, and noisy boxes of the same."""
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    key, word = F.col("s_suppkey"), F.upper("n_name")
    day, number = F.date_add(F.lit("1950-01-15").cast("date"), (key % 9000).cast("int")), (key + 96000000).cast("string")
    s = t(spark, d, "supplier").join(nation, "s_nationkey").select(key.alias("request_id"), word.alias("word"), day.alias("day"), number.alias("number"))
    tags = [("PatientName", F.concat("word", F.lit("^anna"))), ("PatientBirthDate", F.date_format("day", "yyyyMMdd")), ("PatientID", F.col("number"))]
    tags = F.array(*[F.struct(F.lit(i).alias("tag_pos"), F.lit(n).alias("tag"), v.alias("value")) for i, (n, v) in enumerate(tags)])
    texts = F.array(F.concat(F.translate("word", "EO", "C0"), F.lit(","), F.col("number")), F.date_format("day", "dd"), F.date_format("day", "MM"), F.date_format("day", "yyyy"), F.lit("SIEMENS"))
    boxes = s.select("request_id", F.posexplode(texts).alias("box_id", "text"))
    x = F.when(F.col("box_id") == 0, 0).otherwise(F.col("box_id") * 60)
    y = F.when(F.col("box_id").isin(0, 4), F.col("box_id") * 40).otherwise(60)
    box = ((x, "x_min"), (y, "y_min"), (x + F.when(F.col("box_id") == 0, 300).otherwise(40), "x_max"), (y + 20, "y_max"))
    return boxes.select("*", *[c.cast("double").alias(n) for c, n in box]), s.select("request_id", F.explode(tags).alias("t")).select("request_id", "t.*")


@query(f"WITH {_RAW_TM} SELECT request_id, tag, term, is_name, true AS in_lookup FROM tm")
def build_terms(spark, d):
    """F22, P4, J11, A16, U-1, U-3, U-4."""
    return api.build_terms(_requests(spark, d)[1])


@query(f"WITH {_RAW_TX} SELECT request_id, box_id, group_id, text, norm, x_min, y_min, x_max, y_max FROM tx")
def prepare_boxes(spark, d):
    """Boxes split, numbered in order, normalised."""
    return api.prepare(_requests(spark, d)[0]).select("request_id", "box_id", "group_id", "text", "norm", "x_min", "y_min", "x_max", "y_max")


@query(f"WITH {_RAW_TX}, {_RAW_TM}, {match_sql()} SELECT tx.request_id, tx.box_id, group_id, text, x_min, y_min, x_max, y_max FROM tx JOIN (SELECT * FROM one UNION SELECT * FROM sib UNION SELECT * FROM rh) h ON h.request_id = tx.request_id AND h.box_id = tx.box_id")
def detect_sensitive(spark, d):
    """Masked boxes of every supplier's request."""
    boxes, tags = _requests(spark, d)
    return api.sensitive_boxes(boxes, tags).select("request_id", "box_id", "group_id", "text", "x_min", "y_min", "x_max", "y_max")


_POS = "CASE tag WHEN 'PatientName' THEN 0 WHEN 'PatientBirthDate' THEN 1 ELSE 2 END"


@query(f"WITH {_RAW_TX}, {_RAW_TM}, {match_sql('request_id, tag')} SELECT request_id, list(tag ORDER BY {_POS}) AS detected_tags FROM (SELECT DISTINCT request_id, tag FROM (SELECT * FROM one UNION SELECT * FROM sib UNION SELECT * FROM rh)) GROUP BY 1")
def report_sensitive(spark, d):
    """Tags found in every supplier's request."""
    return api.report_tags(*_requests(spark, d))


class Reader:
    """Stands for text recognition: a text that tells the image's shade, one that tells nothing, one outside the image."""

    def detect(self, image):
        return [f"patient {image[0, 0, 0]}", "nothing", "outside"], [[1, 1, 20, 8], [1, 1, 5, 5], [100, 100, 120, 110]]


_SHADE = "CAST(trunc((least(greatest(k % 256, 32), 160) - 32) / 128.0::DOUBLE * 255) AS INT)"
_PLAN = f"(SELECT s_suppkey AS k, {_SHADE.replace('k %', 's_suppkey %')} AS shade, s_suppkey % 7 = 0 AS bad, CAST(s_suppkey % 4 AS INT) AS kind FROM supplier)"


def _plan_requests(spark, d):
    """A request per supplier of an even image: with a tag that is on it, none, one that is not, and one read outside it."""
    key = F.col("s_suppkey")
    level = (key % 256).cast("int")
    shade = ((F.least(F.greatest(level, F.lit(32)), F.lit(160)) - 32) / F.lit(128.0) * 255).cast("int").cast("string")
    values = F.array(F.concat(F.lit('{"PatientID":"patient '), shade, F.lit('","PatientSex":"O"}')), F.lit("{}"), F.lit('{"PatientID":"zzzzqqqq"}'), F.concat(F.lit('{"InstitutionName":"outside","PatientID":"patient '), shade, F.lit('"}')))
    pixels = F.unhex(F.repeat(F.lpad(F.hex(level), 2, "0"), 400))
    columns = {
        "request_id": key, "image": F.when(key % 7 == 0, F.substring(pixels, 1, 399)).otherwise(pixels), "content_type": F.lit("image/raw"), "filename": F.lit(None).cast("string"),
        "sensitive_data_list": F.element_at(values, (key % 4 + 1).cast("int")), "sop_instance_uid": F.concat(F.lit("1."), key.cast("string")), "rows": F.lit(10), "columns": F.lit(40), "bits_allocated": F.lit(8), "samples_per_pixel": F.lit(1),
        **{c: F.lit(None).cast("double") for c in ("rescale_slope", "rescale_intercept")}, "window_center": F.lit(96.0), "window_width": F.lit(128.0), "is_monochrome1": F.lit(False),
        **{c: F.lit(None).cast("string") for c in ("palette_color_lut", "transfer_syntax_uid", "photometric_interpretation")},
    }
    return t(spark, d, "supplier").select(*[c.alias(n) for n, c in columns.items()])


_STATUS = "CASE WHEN kind <> 1 AND bad THEN 400 ELSE 200 END AS status, CASE WHEN kind <> 1 AND bad THEN 'Failed to decode image' END AS error, CASE WHEN kind = 1 OR NOT bad THEN '1.' || k END AS sop_instance_uid"


@query(f"""SELECT k AS request_id, {_STATUS}, CASE WHEN kind = 1 THEN 'No sensitive data list provided' WHEN bad THEN NULL WHEN kind IN (0, 3) THEN '1 sensitive data detected' ELSE 'No sensitive data detected' END AS message,
CASE WHEN kind IN (0, 3) AND NOT bad THEN '[{{"stationName":"*","color":"' || printf('%02x%02x%02x', shade, shade, shade) || '","rectangles":["0 0 22 10"]}}]' END AS masks FROM {_PLAN}""")
def deidentify_requests(spark, d):
    """From request rows to masks; a box outside the image is not counted."""
    rows = api.deidentify(_plan_requests(spark, d), Reader())
    return rows.select("request_id", "status", "error", "sop_instance_uid", "message", F.to_json("masks").alias("masks"))


@query(f"""SELECT k AS request_id, {_STATUS}, CASE WHEN kind = 1 THEN 'No sensitive data list provided' WHEN bad THEN NULL WHEN kind = 0 THEN '1 sensitive tags detected' WHEN kind = 3 THEN '2 sensitive tags detected' ELSE 'No sensitive data detected' END AS message,
CASE WHEN kind <> 1 AND NOT bad THEN CASE kind WHEN 0 THEN 'PatientID' WHEN 3 THEN 'InstitutionName PatientID' ELSE '' END END AS tags FROM {_PLAN}""")
def report_requests(spark, d):
    """From request rows to the tags found."""
    rows = api.report(_plan_requests(spark, d), Reader())
    return rows.select("request_id", "status", "error", "sop_instance_uid", "message", F.array_join("detected_tags", " ").alias("tags"))


# -- tokenizer, requests, images ---------------------------------------------------------------

#: A text of each shape, in Spark's words and in DuckDB's, and its tokens; {d} and {m} are two digits, {y} four, {n} the key.
_SHAPES = [
    ("ANONYME,FILLE{n}", ["ANONYME", "FILLE{n}"]), ("12345 / DUPONT{n}", ["12345", "DUPONT{n}"]), ("{d}/{m}/{y}", ["{d}/{m}/{y}"]), ("{y} / {m}/ {d}", ["{y} / {m}/ {d}"]),
    ("AB{d}.0 / {d}-{m}-{y}", ["AB{d}.0", "{d}-{m}-{y}"]), ("JEAN,ALBERT,9765{d}{m}.{y}{m}{d}", ["JEAN", "ALBERT", "9765{d}{m}", "{y}{m}{d}"]), ("N(..{d}/{m}/{y}", ["N(..{d}/{m}/{y}"]),
    ("H.U.G. 3C {n}", ["H.U.G. 3C {n}"]), ("JEAN.ALBERT", ["JEAN", "ALBERT"]), ("{d}.{m}.{y}", ["{d}.{m}.{y}"]), (",,{n} , ,", ["{n}"]), ("WARD....NAME{n}", ["WARD", "NAME{n}"]), ("", []), ("A/B", ["A", "B"]),
]


def _filled(text: str, concat: bool) -> str:
    """A shape as an SQL expression over dd, mm, yy and nn."""
    parts = [p for p in text.replace("{d}", "\0dd\0").replace("{m}", "\0mm\0").replace("{y}", "\0yy\0").replace("{n}", "\0nn\0").split("\0")]
    out = [f"'{p}'" if i % 2 == 0 else p for i, p in enumerate(parts) if i % 2 or p] or ["''"]
    return f"concat({', '.join(out)})" if concat else " || ".join(out)


_ORDER_DAY = "(SELECT o_orderkey AS k, strftime(CAST(o_orderdate AS DATE), '%d') AS dd, strftime(CAST(o_orderdate AS DATE), '%m') AS mm, strftime(CAST(o_orderdate AS DATE), '%Y') AS yy, CAST(o_orderkey AS VARCHAR) AS nn FROM orders)"


@query(f"SELECT k, CASE k % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN [{', '.join(_filled(w, False) for w in want)}]{'' if want else '::VARCHAR[]'}" for i, (_, want) in enumerate(_SHAPES)) + f" END AS found FROM {_ORDER_DAY}")
def find_fields(spark, d):
    """Commas, slashes, dots, dates, initials."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), *[F.date_format(F.to_date("o_orderdate"), f).alias(n) for f, n in (("dd", "dd"), ("MM", "mm"), ("yyyy", "yy"))], F.col("o_orderkey").cast("string").alias("nn"))
    text = F.expr(f"CASE k % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {_filled(s, True)}" for i, (s, _) in enumerate(_SHAPES)) + " END")
    return o.select("k", F.transform(tokens(text), lambda p: p.token).alias("found"))


_KINDS = ["image/jpeg", "image/raw", "text/plain", "application/octet-stream", "IMAGE/PNG"]
_LISTS = ['{"PatientID":"1"}', "{}", "not json", '["a"]', "null"]
_ACCEPTS = ["application/json", "application/json; version=1", "application/json;version = 2"]
_CHOICE = "(SELECT o_orderkey AS k, {kinds}[CAST(o_orderkey % 5 AS INT) + 1] AS ct, {lists}[CAST(o_custkey % 5 AS INT) + 1] AS js, CAST(o_orderkey % 3 AS INT) + 1 AS av FROM orders)".format(kinds=_KINDS, lists=_LISTS)
_GOOD = "ct IN ('image/jpeg', 'image/raw', 'application/octet-stream')"


@query(f"""SELECT k AS request_id, CASE WHEN NOT ({_GOOD}) OR js NOT LIKE '{{%' THEN 400 WHEN av = 3 THEN 406 ELSE 200 END AS status,
CASE WHEN NOT ({_GOOD}) THEN 'Unsupported file type.' WHEN js = 'not json' THEN 'Invalid JSON' WHEN js NOT LIKE '{{%' THEN 'sensitive_data_list must be a JSON object' WHEN av = 3 THEN 'Unsupported version' END AS error FROM {_CHOICE}""")
def check_requests(spark, d):
    """S1, S2, S3, S5."""
    pick = lambda values, c, n: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % n + 1).cast("int"))
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), pick(_KINDS, "o_orderkey", 5).alias("content_type"), pick(_LISTS, "o_custkey", 5).alias("sensitive_data_list"), pick(_ACCEPTS, "o_orderkey", 3).alias("accept"))
    return requests.check(rows).select("request_id", "status", "error")


@query("SELECT event_id, 0 + i AS tag_pos, tag, value FROM (SELECT event_id, unnest([0, 1, 2]) AS i, unnest(['z' || event_id % 3, 'b', 'a']) AS tag, unnest([event_type, '', CAST(event_id AS VARCHAR)]) AS value FROM events)")
def ordered_tag_map(spark, d):
    """S3: keys keep the caller's order, and a repeated key its first place and last value."""
    text = F.format_string('{"z%d": "old", "b": "", "a": "%d", "z%d": "%s"}', F.col("event_id") % 3, "event_id", F.col("event_id") % 3, "event_type")
    return requests.tag_rows(t(spark, d, "events").select("event_id", text.alias("j")), "event_id", "j")


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN '{"message":"m' || o_orderkey || '","sop_instance_uid":"1.2"}' ELSE '{"message":"m' || o_orderkey || '"}' END AS response FROM orders""")
def responses(spark, d):
    """Null fields are left out."""
    key = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(key.alias("request_id"), F.concat(F.lit("m"), key.cast("string")).alias("message"), F.when(key % 2 == 0, "1.2").alias("sop_instance_uid"))
    return requests.to_response(rows, ["message", "sop_instance_uid"])


@query("SELECT p_partkey, 'd' || p_size || '__' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.json' ELSE '.dat.json' END AS name FROM part")
def golden_names(spark, d):
    """P16."""
    path = F.concat(F.lit("d"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "\\").otherwise("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".dcm").otherwise(".dat"))
    return t(spark, d, "part").select("p_partkey", requests.golden_name(path).alias("name"))


@query("""WITH v AS (SELECT l_orderkey AS request_id, CAST(l_partkey % 256 AS INT) AS a, CAST(l_suppkey % 256 AS INT) AS b, l_linenumber AS n FROM (SELECT DISTINCT ON (l_orderkey) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber)),
s AS (SELECT *, [CAST(trunc((least(greatest(x, 32), 160) - 32) / 128.0::DOUBLE * 255) AS INT) FOR x IN [a, b, 255 - a, 200]] AS y FROM v)
SELECT request_id, CASE WHEN request_id % 7 = 0 THEN NULL ELSE array_to_string([repeat(printf('%02X', x), 3) FOR x IN y], '') END AS pixels, CASE WHEN request_id % 7 = 0 THEN 'Failed to decode image' END AS decode_error FROM s""")
def decode_images(spark, d):
    """Images of 2 x 2 pixels, some of a wrong size."""
    first = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("f"))
    a, b = (F.col("f.l_partkey") % 256).cast("int"), (F.col("f.l_suppkey") % 256).cast("int")
    image = F.unhex(F.concat(*[F.lpad(F.hex(v), 2, "0") for v in (a, b, 255 - a, F.lit(200))]))
    rows = first.select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_orderkey") % 7 == 0, F.substring(image, 1, 3)).otherwise(image).alias("image"), F.lit(2).alias("rows"), F.lit(2).alias("columns"), F.lit(8).alias("bits_allocated"), F.lit(1).alias("samples_per_pixel"), F.lit(96.0).alias("window_center"), F.lit(128.0).alias("window_width"))
    return decode(rows).select("request_id", F.hex("pixels.data").alias("pixels"), "decode_error")


@query(f"WITH p AS ({_PIX}), m AS (SELECT box_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM p GROUP BY 1), q AS (SELECT p.*, sqrt((r-mr)*(r-mr) + (g-mg)*(g-mg) + (b-mb)*(b-mb)) <= 30 AS c FROM p JOIN m USING (box_id)) SELECT box_id, CAST(floor(coalesce(avg(r) FILTER (c), avg(r))) AS BIGINT) AS r, CAST(floor(coalesce(avg(g) FILTER (c), avg(g))) AS BIGINT) AS g, CAST(floor(coalesce(avg(b) FILTER (c), avg(b))) AS BIGINT) AS b FROM q GROUP BY 1")
def image_backgrounds(spark, d):
    """A2, A3, F30, U4 on images: the kernel that the plans use."""
    images = _pixels(spark, d).groupBy("box_id").agg(F.collect_list(F.array("b", "g", "r")).alias("p"))
    return images.select("box_id", pixel_background("p").alias("c")).select("box_id", "c.*")


@query("SELECT o_orderkey, CAST(least(greatest(CAST(trunc(o_totalprice - 32) AS INT), 0), 500) AS INT) AS x1, CAST(least(greatest(CAST(o_custkey % 700 AS INT) - 32, 0), 400) AS INT) AS y1 FROM (SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS o_totalprice FROM orders)")
def clip_boxes(spark, d):
    """boxes moved back out of a border and cut to the image."""
    x, y = F.col("o_totalprice") / 1000, F.col("o_custkey") % 700
    box = geometry.clip_box(x, y, x + 10, y + 10, F.lit(500), F.lit(400), 32)
    return t(spark, d, "orders").select("o_orderkey", box[0].alias("x1"), box[1].alias("y1"))


@query("SELECT p_partkey, CASE WHEN least(p_size * 60, p_partkey % 3000 + 1) >= 1500 THEN 1.0::DOUBLE ELSE 1500.0::DOUBLE / least(p_size * 60, p_partkey % 3000 + 1) END AS factor FROM part")
def scale_factors(spark, d):
    """the factor an image is enlarged by."""
    return t(spark, d, "part").select("p_partkey", geometry.scale_factor(F.col("p_size") * 60, F.col("p_partkey") % 3000 + 1).alias("factor"))


@query("SELECT p_partkey, list_transform(range(1, least(len(w), CAST(p_size % 3 AS INT)) + 1), lambda i: w[i] || i) AS both FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)")
def zip_shortest(spark, d):
    """Texts and boxes by place, as many as both have."""
    rows = t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.slice(F.array(F.lit("1"), F.lit("2")), F.lit(1), (F.col("p_size") % 3).cast("int")).alias("n"))
    return rows.select("p_partkey", F.transform(geometry.zip_shortest("w", "n"), lambda s: F.concat(s.w, s.n)).alias("both"))


@query(f"SELECT p_partkey, list_transform(string_split(p_name, ' ') || [p_brand], lambda x: {_OH.format(_NORM.format('x'))}) AS norms FROM part")
def normalize_lists(spark, d):
    """F2."""
    return t(spark, d, "part").select("p_partkey", normalize_list(F.concat(F.split("p_name", " "), F.array("p_brand"))).alias("norms"))


@query("SELECT s_suppkey, x, y FROM (SELECT s_suppkey, s_suppkey::DOUBLE AS x, CAST(s_suppkey % 7 AS DOUBLE) AS y FROM supplier WHERE s_suppkey % 3 = 0)")
def valid_boxes(spark, d):
    """Arrays of four numbers are boxes, others are left out."""
    key = F.col("s_suppkey").cast("double")
    values = F.array(key, (F.col("s_suppkey") % 7).cast("double"), key + 4, F.when(F.col("s_suppkey") % 3 != 2, F.lit(9.0)))
    values = F.when(F.col("s_suppkey") % 3 == 1, F.slice(values, F.lit(1), F.lit(3))).otherwise(values)
    rows = t(spark, d, "supplier").select("s_suppkey", geometry.box_of(values).alias("b")).filter("b IS NOT NULL")
    return rows.select("s_suppkey", F.col("b.x_min").alias("x"), F.col("b.y_min").alias("y"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 86400), '%Y%m%d_%H%M%S') AS name FROM orders")
def folder_names(spark, d):
    """F19."""
    moment = F.timestamp_add("SECOND", (F.col("o_orderkey") % 86400).cast("int"), F.to_date("o_orderdate").cast("timestamp"))
    return t(spark, d, "orders").select("o_orderkey", golden.folder_name(moment).alias("name"))


@query("""SELECT s_suppkey AS request_id, CASE kind WHEN 0 THEN printf('%02X%02X%02X', 50 + i, 30 + i, 10 + i) WHEN 1 THEN printf('%02X%02X%02X', 255, 1, CAST(trunc((10 + i) * 257 / 65535.0::DOUBLE * 255) AS INT)) WHEN 3 THEN '000000' END AS pixels,
CASE kind WHEN 2 THEN true WHEN 4 THEN true ELSE false END AS failed, kind = 4 AS needs_codec FROM (SELECT s_suppkey, CAST(s_suppkey % 5 AS INT) AS kind, CAST(least(s_suppkey % 4, 2) AS INT) AS i FROM supplier)""")
def decode_palettes(spark, d):
    """Palettes of 8 and 16 bits, broken, and of one channel; a frame that needs a codec."""
    key, kind = F.col("s_suppkey"), (F.col("s_suppkey") % 5).cast("int")
    palettes = F.array(*map(F.lit, ('{"red":[10,11,12],"green":[30,31,32],"blue":[50,51,52]}', '{"red":[2570,2827,3084],"green":[257,257,257],"blue":[65535,65535,65535]}', "{broken", '{"red":[1]}', "")))
    rows = t(spark, d, "supplier").select(
        key.alias("request_id"), F.unhex(F.lpad(F.hex(key % 4), 2, "0")).alias("image"), F.lit(1).alias("rows"), F.lit(1).alias("columns"), F.lit(8).alias("bits_allocated"), F.lit(1).alias("samples_per_pixel"),
        F.nullif(F.get(palettes, kind), F.lit("")).alias("palette_color_lut"), F.when(kind == 4, "1.2.840.10008.1.2.4.50").alias("transfer_syntax_uid"),
    )
    out = decode(rows)
    return out.select("request_id", F.hex("pixels.data").alias("pixels"), F.col("pixels").isNull().alias("failed"), F.coalesce(F.col("decode_error") == "codec unavailable", F.lit(False)).alias("needs_codec"))
