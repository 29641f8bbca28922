"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .avi import clips, encode_texts, store_texts
from .common import table
from .decontaminate import contaminated
from .html_text import extract
from .kd_shards import shard_documents
from .langid import identify
from .mixing import mix
from .near_dedup import near_duplicates
from .ngram_lm import SQL as BACKOFF_SQL
from .ngram_lm import score
from .oracles import ORACLE_SQL as SHOWN_SQL
from .oracles import QUERIES as SHOWN
from .pii import find_pii
from .toxicity import detect_toxicity


def op1_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op4_avi_mjpeg(spark, sf_dir):
    return store_texts(table(spark, sf_dir, "documents"))


def avi_clips(spark, sf_dir):
    """Timed clips of every document's film."""
    return clips(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_stupid_backoff(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    return detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_kd_shards(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_langid(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


_ALL = (op1_decontaminate, op2_minhash_near_dedup, op3_mix_sources, op4_avi_mjpeg, op5_stupid_backoff, op6_html_text, op7_toxicity, op8_kd_shards, op9_langid, op10_pii)
QUERIES = {f.__name__: f for f in (*_ALL, avi_clips)} | SHOWN

#: Ops 1, 6, 7 and 9 are not SQL; of ops 3, 4, 8 and 10 queries of their own show the part that is.
ORACLE_SQL: dict[str, str] = {"op5_stupid_backoff": BACKOFF_SQL} | SHOWN_SQL
