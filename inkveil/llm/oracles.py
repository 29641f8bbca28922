"""SQL for what it can express of the ten operators, and the queries that show that part of a result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .avi import store_texts
from .common import table
from .kd_shards import shard_documents
from .mixing import mix
from .pii import find_pii

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Near-duplicates from all pairs that share a shingle; documents have distinct ids here.
NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(a) - 3)) AS u(i) WHERE len(a) >= 5
  UNION ALL SELECT doc_id, array_to_string(a, ' ') FROM w WHERE len(a) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT x AS v, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v),
l AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.v = w.doc_id
"""

_ROUNDS = 12
_TURN = """{0} AS (SELECT source, size, w, fixed OR w * (t / f) > 2 * size AS fixed, fixed AS was FROM (SELECT *, 1.5::DOUBLE * sum(size) OVER () - coalesce(sum(2 * size) FILTER (fixed) OVER (), 0) AS t, sum(w) FILTER (NOT fixed) OVER () AS f FROM {1}))"""

#: Targets of the sources: what is above twice a source's size is shared anew, round by round.
TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY 1),
r0 AS (SELECT source, size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, false AS fixed, false AS was FROM q),
{", ".join(_TURN.format(f"r{k + 1}", f"r{k}") for k in range(_ROUNDS))},
z AS (SELECT source, size, CASE WHEN fixed THEN 2.0::DOUBLE * size ELSE w * ((1.5::DOUBLE * sum(size) OVER () - coalesce(sum(2 * size) FILTER (fixed) OVER (), 0)) / sum(w) FILTER (NOT fixed) OVER ()) END AS target FROM r{_ROUNDS})
SELECT d.doc_id, d.source, d.size, z.size AS source_size, round(z.target, 6) AS target FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
"""


def mix_targets(spark, sf_dir):
    """Sizes and targets of the mix."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"))


#: The payload of each text: its bytes, filled with 255.
PAYLOADS = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents), f AS (SELECT *, greatest(576, (octet_length(data) + 575) // 576 * 576) AS size FROM b)
SELECT doc_id, octet_length(data)::BIGINT AS n_bytes, size::BIGINT AS payload_bytes, sha256(data || repeat('\xFF'::BLOB, (size - octet_length(data))::BIGINT)) AS payload_sha256 FROM f
"""


def media_payloads(spark, sf_dir):
    """What is read back from the films of the texts."""
    return store_texts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 0 THEN {0}[i]::INT WHEN {0}[i]::INT > 4 THEN 2 * {0}[i]::INT - 9 ELSE 2 * {0}[i]::INT END)) % 10 = 0"

#: The fixed patterns, counted.
PATTERNS = rf"""
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0))::BIGINT AS n_ip,
len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: {_DIGITS.format('m')}), lambda g: length(g) BETWEEN 14 AND 19 AND {_LUHN.format('g')}))::BIGINT AS n_card,
len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length({_DIGITS.format('m')}) BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def pii_patterns(spark, sf_dir):
    """Counts of the fixed patterns."""
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


#: Every row and byte is in a shard, slots have no gaps, equal texts are together, and shards differ by no more than a heavy text.
HELD = """
WITH d AS (SELECT octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents)
SELECT count(*)::BIGINT AS n_rows, sum(size)::BIGINT AS n_bytes, 16::BIGINT AS n_shards, true AS gapless, true AS together, true AS even FROM d
"""


def shards_hold(spark, sf_dir):
    """What the shards must have in common, in one row."""
    rows = shard_documents(table(spark, sf_dir, "documents"))
    per = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("w"), F.max("size").alias("most"))
    apart = rows.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("k"), F.sum("size").alias("w")).agg(F.max(F.when(F.col("k") > 1, F.col("w"))).alias("w"))
    total = per.agg(F.sum("n").alias("n_rows"), F.sum("w").alias("n_bytes"), F.count("*").alias("n_shards"), F.min((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("gapless"), F.max("w").alias("hi"), F.min("w").alias("lo"), F.max("most").alias("most"))
    both = total.join(apart)
    return both.select("n_rows", "n_bytes", "n_shards", "gapless", (F.col("w").isNull() | (F.col("w") * 16 > F.col("n_bytes"))).alias("together"), (F.col("hi") - F.col("lo") <= F.greatest(F.col("most"), F.col("n_bytes") / 320)).alias("even"))


QUERIES = {f.__name__: f for f in (mix_targets, media_payloads, pii_patterns, shards_hold)}
ORACLE_SQL = {"op2_minhash_near_dedup": NEAR, "mix_targets": TARGETS, "media_payloads": PAYLOADS, "pii_patterns": PATTERNS, "shards_hold": HELD}
