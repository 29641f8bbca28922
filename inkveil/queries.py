"""The registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkveil.functions import expand
from inkveil.functions.blocks import split_blocks, weight
from inkveil.functions.image import palette_colors, shade
from inkveil.functions.text import fuzz_ratio, normalize_ascii, normalize_text
from inkveil.operators import color, evaluate, geometry, match
from inkveil.plans import api

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: (l_orderkey, l_linenumber) repeats in the data; boxes need a key.
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"


def lines(spark, d):
    values = ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in values])


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_OH = "regexp_replace(regexp_replace({0}, '([a-z])0([a-z])', '\\1o\\2', 'g'), '([a-z])0([a-z])', '\\1o\\2', 'g')"
_UNICODE = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT c_custkey AS k, {_OH.format(_NORM.format('c_name'))} AS norm FROM customer UNION ALL SELECT p_partkey, {_OH.format(_NORM.format('p_name'))} FROM part")
def normalize_names(spark, d):
    """F1 on ASCII columns, native."""
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), normalize_ascii(F.col("c_name")).alias("norm"))
    return a.union(t(spark, d, "part").select("p_partkey", normalize_ascii(F.col("p_name"))))


@query(f"SELECT doc_id, {_OH.format(_UNICODE.format('text'))} AS norm FROM documents")
def normalize_docs(spark, d):
    """F1 on whole texts of four languages."""
    return t(spark, d, "documents").select("doc_id", normalize_text("text").alias("norm"))


_MON = ["['january','february','march','april','may','june','july','august','september','october','november','december']", "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']", "['janvier','fevrier','mars','avril','mai','juin','juillet','aout','septembre','octobre','novembre','decembre']", "['jan','fev','mar','avr','mai','jun','jul','aou','sep','oct','nov','dec']"]
_FORMS = ["dd||' '||mm||' '||yy", "mm||' '||dd||' '||yy", "yy||' '||mm||' '||dd", "yy||mm||dd", "yy||mm||' '||dd", "yy||' '||mm||dd"]
_DATES = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders)"
_NUMERIC = ", ".join(f"strftime(dt, '{f}')" for f in ("%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d-%m-%Y"))
_TEXT = " UNION ".join(
    f"SELECT dt, {form} AS variant FROM (SELECT dt, {m}[month(dt)] AS mm, {day} AS dd, {year} AS yy FROM {_DATES})"
    for m in _MON
    for day in ("CAST(day(dt) AS VARCHAR)", "strftime(dt, '%d')")
    for year, forms in (("strftime(dt, '%Y')", _FORMS), ("strftime(dt, '%y')", _FORMS[:2]))
    for form in forms
)


@query(f"SELECT dt, unnest([{_NUMERIC}]) AS variant FROM {_DATES} UNION {_TEXT}")
def expand_dates(spark, d):
    """All spellings of the distinct order dates."""
    days = t(spark, d, "orders").select(F.to_date("o_orderdate").alias("dt")).distinct()
    value = F.date_format("dt", "yyyyMMdd")
    return days.select("dt", F.explode(expand.date_variants(expand.dicom_date(value))).alias("variant"))


_AGE = "(SELECT o_orderkey, lpad(CAST(o_orderkey % 130 AS VARCHAR), 3, '0') || ['Y','M','D','W'][CAST(o_orderkey % 4 AS INT) + 1] AS age, DATE '1950-03-31' + CAST(o_orderkey % 9000 AS INT) AS b, CAST(o_orderdate AS DATE) AS s FROM orders)"
_AGEM = "((((year(s) - year(b)) * 12 + month(s) - month(b) - CASE WHEN day(s) < day(b) THEN 1 ELSE 0 END) % 12) + 12) % 12"


@query(f"""WITH a AS (SELECT *, CAST(substr(age, 1, 3) AS INT) AS n, lower(substr(age, 4, 1)) AS u, {_AGEM} AS m FROM {_AGE})
SELECT DISTINCT o_orderkey, v AS variant FROM (SELECT o_orderkey, unnest(CASE WHEN u = 'y' THEN [n || u, substr(age, 1, 3) || u, n || 'ans', n || 'y' || m || 'm', n || 'a' || m || 'm'] ELSE [n || u, substr(age, 1, 3) || u] END) AS v FROM a)""")
def expand_ages(spark, d):
    """F17, F18, U3."""
    o = t(spark, d, "orders")
    unit = F.element_at(F.array(*map(F.lit, "YMDW")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    age = F.concat(F.lpad((F.col("o_orderkey") % 130).cast("string"), 3, "0"), unit)
    birth = F.date_add(F.lit("1950-03-31").cast("date"), (F.col("o_orderkey") % 9000).cast("int"))
    return o.select("o_orderkey", F.explode(expand.age_variants(age, birth, F.to_date("o_orderdate"))).alias("variant"))


_PNAME = "split_part(p_name, ' ', 1) || '^' || coalesce(nullif(split_part(p_name, ' ', 2), ''), 'x') || ',' || p_brand"


@query(f"""WITH n AS (SELECT p_partkey, {_OH.format(_NORM.format("split_part(p_name, ' ', 1)"))} AS l, [{_OH.format(_NORM.format("coalesce(nullif(split_part(p_name, ' ', 2), ''), 'x')"))}, {_OH.format(_NORM.format('p_brand'))}] AS f FROM part), x AS (SELECT p_partkey, l, unnest(f) AS f FROM n)
SELECT p_partkey, f AS variant FROM x UNION SELECT p_partkey, l FROM x WHERE l <> '' UNION SELECT p_partkey, f || ' ' || l FROM x WHERE l <> '' UNION SELECT p_partkey, l || ' ' || f FROM x WHERE l <> ''""")
def expand_names(spark, d):
    """On Last^First,First."""
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    name = F.concat(word(0), F.lit("^"), F.coalesce(F.nullif(word(1), F.lit("")), F.lit("x")), F.lit(","), F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", F.explode(expand.name_variants(name, normalize_ascii)).alias("variant"))


@query("""SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['female','femme','fille','feminin'] WHEN 1 THEN ['male','homme','garcon','masculin'] WHEN 2 THEN ['other','autre','non-binary','nonbinary','non binaire'] ELSE ['x'] END) AS variant FROM events""")
def expand_sex(spark, d):
    """F21, J12, U3."""
    code = F.element_at(F.array(*map(F.lit, "FMOX")), (F.col("event_id") % 4 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", F.explode(expand.sex_variants(code)).alias("variant"))


@query(f"""WITH v AS (SELECT p_partkey AS k, {_OH.format(_NORM.format('p_name'))} AS term FROM part UNION SELECT p_partkey, {_OH.format(_NORM.format('p_type'))} FROM part UNION SELECT p_partkey, {_OH.format(_NORM.format('p_brand'))} FROM part)
SELECT k, term FROM v WHERE term <> '' UNION SELECT k, replace(term, ' ', '') FROM v WHERE term <> ''""")
def lookup_terms(spark, d):
    """F22, U-1, U-3, U-4: distinct terms and their twins without spaces."""
    p = t(spark, d, "part")
    values = F.array(*[normalize_ascii(F.col(c)) for c in ("p_name", "p_type", "p_brand")])
    return p.select(F.col("p_partkey").alias("k"), F.explode(F.filter(expand.with_stripped(F.array_distinct(values)), lambda x: x != "")).alias("term"))


_NOISY = "(SELECT DISTINCT translate(w, 'eo', 'c0') AS noisy FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"
_WORDS = "(SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"
_EDITS = "CASE WHEN least(length(noisy), length(w)) <= 3 THEN 0 WHEN least(length(noisy), length(w)) <= 5 THEN 1 WHEN least(length(noisy), length(w)) <= 9 THEN 2 ELSE 3 END"


def _noisy(spark, d):
    words = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.select(F.translate("w", "eo", "c0").alias("noisy")).distinct(), words


@query(f"SELECT noisy, w FROM {_NOISY} CROSS JOIN {_WORDS} WHERE length(noisy) >= 3 AND length(w) >= 3 AND abs(length(noisy) - length(w)) <= {_EDITS} AND levenshtein(noisy, w) <= {_EDITS}")
def name_edit_join(spark, d):
    """Noisy words and the names they may be."""
    a, b = _noisy(spark, d)
    return match.near_names(a.withColumnRenamed("noisy", "word"), b.withColumnRenamed("w", "name")).toDF("noisy", "w")


_LCS = """list_last(list_reduce(list_prepend(list_transform(range(len({1})+1), lambda i: 0), list_transform(string_split({0},''), lambda x: [unicode(x)::BIGINT])), lambda prev, xr: list_reduce(list_prepend([0::BIGINT], list_transform(range(1,len({1})+1), lambda j: [j])), lambda acc, jj: list_append(acc, CASE WHEN unicode({1}[jj[1]])=xr[1] THEN prev[jj[1]]+1 ELSE greatest(prev[jj[1]+1], acc[-1]) END))))"""


@query(f"SELECT noisy, w, 200.0 * l / (length(noisy) + length(w)) AS score FROM (SELECT noisy, w, {_LCS.format('noisy', 'w')} AS l FROM {_NOISY} CROSS JOIN {_WORDS} WHERE length(noisy) > 0 AND length(w) > 0 AND 11 * length(noisy) > 9 * length(w) AND 11 * length(w) > 9 * length(noisy))")
def token_ratio_scores(spark, d):
    """Scores of the pairs in the length band."""
    a, b = _noisy(spark, d)
    pairs = match.by_length(a.withColumnRenamed("noisy", "norm"), b.withColumnRenamed("w", "term"), lambda m, n: (11 * m > 9 * n) & (11 * n > 9 * m), 11 / 9)
    return pairs.select(F.col("norm").alias("noisy"), F.col("term").alias("w"), fuzz_ratio("norm", "term").alias("score"))


_BLOCKS = f"SELECT l_orderkey AS request_id, l_linenumber AS box_id, l_returnflag || 'NAME' || l_linenumber || ',' || l_linestatus || ' WARD' AS text, 10 * l_linenumber AS x, 10 * l_linenumber + CAST(l_quantity AS INT) * 5 + 40 AS x2, CAST(l_orderkey % 50 AS INT) AS y FROM {_LINES}"


@query(f"""WITH b AS ({_BLOCKS}), c AS (SELECT *, instr(text, ',') - 1 AS p, length(text) AS n, (x2 - x) / (length(text) - 0.8::DOUBLE) AS ch FROM b),
e AS (SELECT *, greatest(3, CAST(trunc(ch * 0.9::DOUBLE) AS INT)) AS pad, x + p * ch AS e0, x + (p + 1) * ch AS s1, x + (n - 0.8::DOUBLE) * ch AS e1 FROM c)
SELECT request_id, box_id AS group_id, 0 AS part_no, substr(text, 1, p) AS text, CAST(greatest(x, x - pad) AS DOUBLE) AS x_min, CAST(least(x2, CAST(trunc(e0) AS INT) + pad) AS DOUBLE) AS x_max FROM e
UNION ALL SELECT request_id, box_id, 1, substr(text, p + 2), CAST(greatest(x, CAST(trunc(s1 - greatest(0.0::DOUBLE, least(CAST(pad AS DOUBLE), s1 - (e0 + pad)))) AS INT)) AS DOUBLE), CAST(least(x2, CAST(trunc(e1) AS INT) + pad) AS DOUBLE) FROM e""")
def split_geometry(spark, d):
    """Two fields split at a comma, with their boxes."""
    li = lines(spark, d)
    text = F.concat("l_returnflag", F.lit("NAME"), F.col("l_linenumber").cast("string"), F.lit(","), "l_linestatus", F.lit(" WARD"))
    x = 10 * F.col("l_linenumber")
    y = (F.col("l_orderkey") % 50).cast("int")
    boxes = li.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("box_id"), text.alias("text"), x.alias("x_min"), y.alias("y_min"), (x + F.col("l_quantity").cast("int") * 5 + 40).alias("x_max"), (y + 20).alias("y_max"))
    return split_blocks(boxes).select("request_id", "group_id", "part_no", "text", "x_min", "x_max")


@query("SELECT doc_id, length(text) - 0.8 * (length(text) - length(replace(text, ' ', ''))) AS w FROM documents")
def text_weight(spark, d):
    """A7, F12."""
    return t(spark, d, "documents").select("doc_id", weight(F.col("text")).alias("w"))


_BOX = f"SELECT l_orderkey AS request_id, l_linenumber AS box_id, CAST(((l_linenumber * 7) % 5) * 45 + l_linenumber % 3 AS DOUBLE) AS x_min, CAST((l_linenumber % 2) * 12 AS DOUBLE) AS y_min, CAST(((l_linenumber * 7) % 5) * 45 + l_linenumber % 3 + 30 AS DOUBLE) AS x_max, CAST((l_linenumber % 2) * 12 + 20 AS DOUBLE) AS y_max, CAST(1000 + l_partkey % 9000 AS VARCHAR) AS norm FROM {_LINES}"
_NEXT = "SELECT a.request_id, a.box_id, arg_min(b.box_id, b.x_min * 1000 + b.box_id) AS next_id FROM bx a JOIN bx b ON a.request_id = b.request_id AND b.x_min > a.x_min AND least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min) >= 0.4 * least(a.y_max - a.y_min, b.y_max - b.y_min) AND b.x_min - a.x_max <= 2.0 * (a.y_max - a.y_min) GROUP BY 1, 2"


def _boxes(spark, d):
    n = F.col("l_linenumber")
    x, y = (n * 7) % 5 * 45 + n % 3, n % 2 * 12
    coords = [c.cast("double").alias(k) for c, k in ((x, "x_min"), (y, "y_min"), (x + 30, "x_max"), (y + 20, "y_max"))]
    return lines(spark, d).select(F.col("l_orderkey").alias("request_id"), n.alias("box_id"), *coords, (1000 + F.col("l_partkey") % 9000).cast("string").alias("norm"))


@query(f"WITH bx AS ({_BOX}) {_NEXT}")
def next_box_on_line(spark, d):
    """J5, W3, F32, O5."""
    return match.next_boxes(_boxes(spark, d))


@query(f"""WITH bx AS ({_BOX}), e AS ({_NEXT}), r1 AS (SELECT b.request_id, b.box_id AS start_id, e.next_id AS cur, 1 AS hop, b.norm || ' ' || n.norm AS combined FROM bx b JOIN e USING (request_id, box_id) JOIN bx n ON n.request_id = b.request_id AND n.box_id = e.next_id),
r2 AS (SELECT r.request_id, start_id, e.next_id AS cur, 2 AS hop, combined || ' ' || n.norm AS combined FROM r1 r JOIN e ON e.request_id = r.request_id AND e.box_id = r.cur JOIN bx n ON n.request_id = r.request_id AND n.box_id = e.next_id),
r3 AS (SELECT r.request_id, start_id, e.next_id AS cur, 3 AS hop, combined || ' ' || n.norm AS combined FROM r2 r JOIN e ON e.request_id = r.request_id AND e.box_id = r.cur JOIN bx n ON n.request_id = r.request_id AND n.box_id = e.next_id),
r4 AS (SELECT r.request_id, start_id, e.next_id AS cur, 4 AS hop, combined || ' ' || n.norm AS combined FROM r3 r JOIN e ON e.request_id = r.request_id AND e.box_id = r.cur JOIN bx n ON n.request_id = r.request_id AND n.box_id = e.next_id)
SELECT request_id, start_id, hop, combined FROM r1 UNION ALL SELECT request_id, start_id, hop, combined FROM r2 UNION ALL SELECT request_id, start_id, hop, combined FROM r3 UNION ALL SELECT request_id, start_id, hop, combined FROM r4""")
def run_expand(spark, d):
    """J6, W5."""
    return match.runs(_boxes(spark, d)).select("request_id", "start_id", "hop", "combined")


@query("SELECT o_orderkey, w AS token FROM (SELECT o_orderkey, o_custkey, unnest([CAST(o_custkey % 100000 + 1000 AS VARCHAR), CAST(o_orderkey % 1000 AS VARCHAR), 'a' || o_orderkey]) AS w FROM orders) WHERE regexp_full_match(w, '[0-9]{4,}') AND contains('id' || (o_custkey + 1000) || 'x', w)")
def member_filter_digits(spark, d):
    """J9, rule 3: long digit tokens inside a term."""
    o = t(spark, d, "orders")
    words = F.array((F.col("o_custkey") % 100000 + 1000).cast("string"), (F.col("o_orderkey") % 1000).cast("string"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")))
    rows = o.select("o_orderkey", F.concat(F.lit("id"), (F.col("o_custkey") + 1000).cast("string"), F.lit("x")).alias("term"), F.explode(words).alias("token"))
    return rows.filter(match.has_number(F.col("token"), F.col("term"))).select("o_orderkey", "token")


@query("SELECT l_orderkey AS request_id, list(l_returnflag || l_linenumber ORDER BY l_linenumber DESC) AS detected_tags FROM " + _LINES + " WHERE l_discount > 0.04 GROUP BY 1")
def detected_tags_ordered(spark, d):
    """Found tags in the caller's order."""
    rows = lines(spark, d).filter("l_discount > 0.04").select(F.col("l_orderkey").alias("request_id"), (-F.col("l_linenumber")).alias("tag_pos"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("tag"))
    return api.in_order(rows)


_GOLD = "SELECT o_orderkey AS image_id, 0 AS golden_id, 0 AS x1, 0 AS y1, 40 + CAST(o_custkey % 20 AS INT) AS x2, 30 AS y2 FROM orders"
_DET = f"SELECT l_orderkey AS image_id, l_linenumber AS detected_id, CAST(l_partkey % 50 AS INT) AS x1, CAST(l_suppkey % 35 AS INT) AS y1, CAST(l_partkey % 50 AS INT) + 10 + CAST(l_quantity AS INT) AS x2, CAST(l_suppkey % 35 AS INT) + 15 AS y2 FROM {_LINES}"


def _rects(spark, d):
    o, li = t(spark, d, "orders"), lines(spark, d)
    golden = o.select(F.col("o_orderkey").alias("image_id"), F.lit(0).alias("golden_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), (40 + (F.col("o_custkey") % 20).cast("int")).alias("x2"), F.lit(30).alias("y2"))
    x, y = (F.col("l_partkey") % 50).cast("int"), (F.col("l_suppkey") % 35).cast("int")
    return golden, li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("detected_id"), x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_quantity").cast("int")).alias("x2"), (y + 15).alias("y2"))


@query(f"SELECT * FROM (SELECT g.image_id, golden_id, detected_id, greatest(g.x1, d.x1) AS cx1, greatest(g.y1, d.y1) AS cy1, least(g.x2, d.x2) AS cx2, least(g.y2, d.y2) AS cy2 FROM ({_GOLD}) g JOIN ({_DET}) d ON g.image_id = d.image_id) WHERE cx1 < cx2 AND cy1 < cy2")
def rect_overlap(spark, d):
    """J14."""
    return evaluate.overlaps(*_rects(spark, d))


@query(f"SELECT d.* FROM ({_DET}) d WHERE NOT EXISTS (SELECT 1 FROM ({_GOLD}) g WHERE g.image_id = d.image_id AND greatest(g.x1, d.x1) < least(g.x2, d.x2) AND greatest(g.y1, d.y1) < least(g.y2, d.y2))")
def false_positive_anti(spark, d):
    """J15."""
    return evaluate.false_positives(*_rects(spark, d)).select("image_id", "detected_id", "x1", "y1", "x2", "y2")


_CELLS = f"""WITH g AS ({_GOLD}), c AS (SELECT * FROM (SELECT g.image_id, greatest(g.x1, d.x1) AS a1, greatest(g.y1, d.y1) AS b1, least(g.x2, d.x2) AS a2, least(g.y2, d.y2) AS b2 FROM g JOIN ({_DET}) d ON g.image_id = d.image_id) WHERE a1 < a2 AND b1 < b2),
xs AS (SELECT image_id, x, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS nx FROM (SELECT image_id, a1 AS x FROM c UNION SELECT image_id, a2 FROM c)), ys AS (SELECT image_id, y, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS ny FROM (SELECT image_id, b1 AS y FROM c UNION SELECT image_id, b2 FROM c)),
cov AS (SELECT image_id, sum((nx - x) * (ny - y)) AS covered FROM (SELECT DISTINCT xs.image_id, x, nx, y, ny FROM xs JOIN ys ON xs.image_id = ys.image_id JOIN c ON c.image_id = xs.image_id AND c.a1 <= x AND c.a2 >= nx AND c.b1 <= y AND c.b2 >= ny) GROUP BY 1), f AS (SELECT g.image_id, golden_id, CAST(coalesce(covered, 0) AS DOUBLE) / (x2 * y2) AS fraction FROM g LEFT JOIN cov USING (image_id))"""


@query(f"{_CELLS} SELECT image_id, golden_id, fraction FROM f")
def coverage_fraction(spark, d):
    """Against the SQL cell decomposition."""
    return evaluate.coverage(*_rects(spark, d))


@query(f"{_CELLS}, h AS (SELECT image_id, count(*) FILTER (fraction >= 0.9) AS matched, count(*) FILTER (fraction < 0.9) AS missed FROM f GROUP BY 1), x AS (SELECT d.image_id, count(*) AS extra FROM ({_DET}) d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.image_id = d.image_id AND greatest(g.x1, d.x1) < least(g.x2, d.x2) AND greatest(g.y1, d.y1) < least(g.y2, d.y2)) GROUP BY 1) SELECT coalesce(h.image_id, x.image_id) AS image_id, coalesce(matched, 0) AS matched, coalesce(missed, 0) AS missed, coalesce(extra, 0) AS extra, coalesce(missed, 0) = 0 AS ok FROM h FULL JOIN x ON h.image_id = x.image_id")
def verdicts(spark, d):
    """A11."""
    return evaluate.verdict(*_rects(spark, d))


@query("""WITH g AS (SELECT DISTINCT p_size AS image_id, p_brand AS tag FROM part WHERE p_partkey % 3 <> 0), d AS (SELECT DISTINCT p_size AS image_id, p_brand AS tag FROM part WHERE p_partkey % 3 <> 1), b AS (SELECT coalesce(g.image_id, d.image_id) AS image_id, coalesce(g.tag, d.tag) AS tag, g.tag AS gt, d.tag AS dt FROM g FULL JOIN d ON g.image_id = d.image_id AND g.tag = d.tag)
SELECT image_id, coalesce(list(tag ORDER BY tag) FILTER (gt IS NOT NULL AND dt IS NOT NULL), []) AS matched, coalesce(list(tag ORDER BY tag) FILTER (dt IS NULL), []) AS missing, coalesce(list(tag ORDER BY tag) FILTER (gt IS NULL), []) AS extra FROM b GROUP BY 1""")
def tag_compare(spark, d):
    """J16, U-5, O3."""
    p = t(spark, d, "part").select(F.col("p_size").alias("image_id"), F.col("p_brand").alias("tag"), "p_partkey")
    return evaluate.compare_tags(p.filter("p_partkey % 3 <> 0").drop("p_partkey"), p.filter("p_partkey % 3 <> 1").drop("p_partkey"))


_PIX = "SELECT l_orderkey AS box_id, CAST(CASE WHEN l_linenumber % 5 = 0 THEN 10 ELSE 200 + l_partkey % 20 END AS DOUBLE) AS r, CAST(l_suppkey % 256 AS DOUBLE) AS g, CAST(CAST(l_quantity AS BIGINT) * 5 AS DOUBLE) AS b FROM lineitem"


def _pixels(spark, d):
    r = F.when(F.col("l_linenumber") % 5 == 0, F.lit(10)).otherwise(200 + F.col("l_partkey") % 20)
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("box_id"), r.cast("double").alias("r"), (F.col("l_suppkey") % 256).cast("double").alias("g"), (F.col("l_quantity").cast("long") * 5).cast("double").alias("b"))


@query(f"SELECT box_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM ({_PIX}) GROUP BY 1")
def median_colors(spark, d):
    """A2."""
    return color.median_color(_pixels(spark, d), ["box_id"])


@query(f"WITH p AS ({_PIX}), m AS (SELECT box_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM p GROUP BY 1), q AS (SELECT p.*, sqrt((r-mr)*(r-mr) + (g-mg)*(g-mg) + (b-mb)*(b-mb)) <= 30 AS c FROM p JOIN m USING (box_id)) SELECT box_id, CAST(floor(coalesce(avg(r) FILTER (c), avg(r))) AS BIGINT) AS r, CAST(floor(coalesce(avg(g) FILTER (c), avg(g))) AS BIGINT) AS g, CAST(floor(coalesce(avg(b) FILTER (c), avg(b))) AS BIGINT) AS b FROM q GROUP BY 1")
def background_colors(spark, d):
    """A3, F30, U4."""
    return color.background_color(_pixels(spark, d), ["box_id"])


@query("WITH b AS (SELECT l_orderkey AS request_id, l_linenumber AS ord, lower(printf('%02x%02x%02x', l_partkey % 2 * 255, 128, 0)) AS color, l_linenumber || ' 0 4 4' AS rectangle FROM " + _LINES + ") SELECT request_id, color, list(rectangle ORDER BY ord) AS rectangles, min(ord) AS first_ord FROM b GROUP BY 1, 2")
def mask_groups(spark, d):
    """A1, A4, P14, F14."""
    li = lines(spark, d)
    rows = li.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("ord"), geometry.hex_color(F.col("l_partkey") % 2 * 255, F.lit(128), F.lit(0)).alias("color"), geometry.rectangle(F.col("l_linenumber"), F.lit(0), F.col("l_linenumber") + 4, F.lit(4)).alias("rectangle"))
    return color.group_by_color(rows)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, greatest(0.0::DOUBLE, l_quantity / 3.0::DOUBLE - 2) AS x1, greatest(0.0::DOUBLE, CAST(l_linenumber AS DOUBLE) / 3.0::DOUBLE - 2) AS y1, (l_quantity + 50) / 3.0::DOUBLE + 2 AS x2, (l_linenumber + 20) / 3.0::DOUBLE + 2 AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(trunc(x1) AS INT) || ' ' || CAST(trunc(y1) AS INT) || ' ' || CAST(trunc(x2 - x1) AS INT) || ' ' || CAST(trunc(y2 - y1) AS INT) AS rectangle FROM b""")
def format_rects(spark, d):
    """P11, P12, P13, F14."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    box = geometry.grow(*geometry.rescale([q, n, q + 50, n + 20], F.lit(3.0)))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.rectangle(*box).alias("rectangle"))


@query("WITH e AS (SELECT event_id, value * 2.0 - 10 AS v FROM events), w AS (SELECT event_id, (least(greatest(v, 0.0), 128.0) - 0.0) / 128.0 * 255 AS y FROM e) SELECT event_id, CAST(trunc(y) AS INT) AS shade, CAST(trunc(255 - y) AS INT) AS inverted FROM w")
def window_level_lut(spark, d):
    """F23 with slope 2, intercept -10, centre 64, width 128, as it is and inverted."""
    lut = lambda inverted: F.get(shade(F.array("value"), F.lit(2.0), F.lit(-10.0), F.lit(64.0), F.lit(128.0), F.lit(inverted)), F.lit(0))
    return t(spark, d, "events").select("event_id", lut(False).alias("shade"), lut(True).alias("inverted"))


@query("SELECT event_id, CASE WHEN hi > lo THEN CAST(trunc((value - lo) / (hi - lo) * 255) AS INT) ELSE 0 END AS shade FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)")
def minmax_stretch(spark, d):
    """A5: an image of each user's values, in its own range."""
    none = [F.lit(None).cast("double")] * 4
    images = t(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "value")).alias("v"))
    images = images.withColumn("shade", shade(F.col("v.value"), *none, F.lit(False)))
    return images.select(F.explode(F.arrays_zip(F.col("v.event_id").alias("event_id"), "shade")).alias("x")).select("x.event_id", "x.shade")


@query("SELECT l_orderkey, l_linenumber, [255, 128, 64, 0][i] AS red, CAST(trunc([0, 300, 65535, 257][i] / 65535.0::DOUBLE * 255) AS INT) AS wide FROM (SELECT l_orderkey, l_linenumber, CAST(least(greatest(l_partkey % 7 - 1, 0), 3) AS INT) + 1 AS i FROM lineitem)")
def palette_lookup(spark, d):
    """Index clipped to the palette, of 8 and of 16 bits."""
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    narrow, wide = ints(255, 128, 64, 0), ints(0, 300, 65535, 257)
    index = F.array((F.col("l_partkey") % 7 - 1).cast("int"))
    first = lambda p: F.get(F.get(palette_colors(index, p, p, p), F.lit(0)), F.lit(0))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", first(narrow).alias("red"), first(wide).alias("wide"))


@query("WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, " + ", ".join(f"v[CAST(least(len(v) - 1, trunc({p}.0::DOUBLE / 100.0::DOUBLE * len(v))) AS INT) + 1] AS p{p}" for p in (50, 95, 99)) + " FROM s")
def latency_percentiles(spark, d):
    """A12."""
    return evaluate.latency_percentiles(t(spark, d, "events"), ["event_type"], "value")


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1")
def status_histogram(spark, d):
    """A13."""
    return evaluate.status_histogram(t(spark, d, "events"), "event_type")


@query("SELECT user_id, count(*) AS n, sum(value) AS total_s, count(*) / nullif(sum(value), 0) AS per_second FROM (SELECT user_id, CAST(event_id % 7 AS DOUBLE) AS value FROM events) GROUP BY 1")
def throughput(spark, d):
    """A14."""
    rows = t(spark, d, "events").select("user_id", (F.col("event_id") % 7).cast("double").alias("s"))
    return evaluate.throughput(rows, "s", ["user_id"])


@query("SELECT event_id, 0 AS tag_pos, 'k' AS tag, CAST(props->>'k' AS VARCHAR) AS value FROM events WHERE json_exists(props, '$.k')")
def json_tag_map(spark, d):
    """S3: tag rows from a JSON object."""
    return api.tag_rows(t(spark, d, "events").select("event_id", "props"), "event_id", "props")




@query("SELECT o_orderkey, CAST(o_custkey % 100 AS INT) AS x1, CAST(o_orderkey % 90 AS INT) AS y1, CAST(o_custkey % 100 AS INT) + 7 AS x2, CAST(o_orderkey % 90 AS INT) + 9 AS y2 FROM orders")
def parse_rects(spark, d):
    """P15."""
    rect = F.concat_ws(" ", (F.col("o_custkey") % 100).cast("string"), (F.col("o_orderkey") % 90).cast("string"), F.lit("7"), F.lit("9"))
    return t(spark, d, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(geometry.parse_rectangle(rect), ("x1", "y1", "x2", "y2"))])


@query("SELECT s_suppkey, CAST(least(s_suppkey % 13, 20 + s_suppkey % 5) AS INT) AS x1, CAST(least(s_suppkey % 7, 9) AS INT) AS y1, CAST(greatest(s_suppkey % 13, 20 + s_suppkey % 5) AS INT) AS x2, CAST(greatest(s_suppkey % 7, 9) AS INT) AS y2 FROM supplier")
def polygon_boxes(spark, d):
    """A9."""
    a, b, y = (F.col("s_suppkey") % 13).cast("double") + 0.0, (20 + F.col("s_suppkey") % 5).cast("double") + 0.5, (F.col("s_suppkey") % 7).cast("double") + 0.25
    points = F.array(F.array(a, y), F.array(b, y), F.array(b, F.lit(9.75)), F.array(a, F.lit(9.75)))
    return t(spark, d, "supplier").select("s_suppkey", *[c.alias(n) for c, n in zip(geometry.polygon_bounds(points), ("x1", "y1", "x2", "y2"))])
