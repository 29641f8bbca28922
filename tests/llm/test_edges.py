"""Awkward tables for every operator, and results on whole tables against brute force or held-out labels."""

import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.llm import avi, common, decontaminate, entries, html_text, kd_shards, langid, mixing, pii, toxicity

DATA = "/root/testdata"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_empty_tables(spark, none):
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i"), (2, None)], "doc_id long, text string")
    assert not decontaminate.contaminated(none, bench).collect() and not decontaminate.contaminated(some, bench).collect() and not decontaminate.contaminated(none, some.toDF("item_id", "text")).collect()
    assert not html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect()
    assert not toxicity.detect_toxicity(none, labels).collect()
    assert [(r.predicted, r.doc_id) for r in toxicity.detect_toxicity(some, labels).orderBy("doc_id").collect()] == [(0, 1), (0, 2)]
    assert not mixing.pieces(none).collect() and not mixing.mix_documents(none).collect() and not avi.encode_texts(none).collect()


def test_names_that_clash(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, 5, 6, 7), (1, text, 5, 6, 7)], "doc_id long, text string, item_id int, window int, toxic int")
    bench = spark.createDataFrame([(9, text, 1, 2), (9, text, 1, 2)], "item_id long, text string, doc_id int, id int")
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 9, 1.0)]
    labels = spark.createDataFrame([(1, 1, "x", 0.5), (1, 0, "x", 0.5)], "doc_id long, toxic int, text string, score double")
    assert toxicity.detect_toxicity(docs, labels).count() == 2
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "old", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert [r.text for r in html_text.extract(pages).collect()] == ["a"]


def test_ties(spark):
    # Two items with the same text are both held; scores of equal texts are equal; a tie of languages goes to the first.
    text = "the small grey cat sat down on the old red mat by the door"
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(8, text), (9, text)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 8), (1, 9), (2, 8), (2, 9)}
    many = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.when(F.col("id") % 2 == 0, "fr").otherwise("de").alias("lang"))
    got = langid.identify(many).collect()
    assert len({(r.lang_pred, round(r.score, 9)) for r in got}) == 1 and got[0].lang_pred in ("de", "fr")
    labels = many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert len({(r.score, r.predicted) for r in toxicity.detect_toxicity(many, labels).collect()}) == 1


def test_samples_are_bounded(spark):
    rows = [(k, "x" * 1000) for k in range(50)] + [(50, "y" * 5000), (51, None), (3, "x" * 1000), (3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = common.bounded_sample(df, ["doc_id"], 100, 64 * 1000)
    assert len(got) == 51 and got["doc_id"].is_unique and 50 not in set(got["doc_id"])
    assert len(common.bounded_sample(df, ["doc_id"], 7, 64 * 1000)) == 7
    few = common.bounded_sample(df, ["doc_id"], 100, 64 * 200)
    assert set(few["text"].fillna("")) <= {"", "z"} and common.bounded_sample(df.limit(0), ["doc_id"], 9, 99).empty


def test_very_long_texts(spark):
    word = "lorem ipsum dolor sit amet "
    long = word * 200_000 + "a.b@mail.example.com"
    docs = spark.createDataFrame([(1, long, "la"), (2, word * 3, "la")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert (got[1].n_email, got[1].n_spans, got[2].n_spans) == (1, 1, 0) and got[1].spans == f"email:{len(word) * 200_000}:{len(long)}"
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"la"}
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.detect_toxicity(docs, labels).collect()} == {0}
    assert html_text.main_text(f"<nav>x</nav><article><p>{long}</p></article>") == long
    assert mixing.pieces(docs.withColumn("source", F.lit(None).cast("string"))).agg(F.sum("n_words")).first()[0] == round(1.5 * (1_000_001 + 15))


def test_exact_passages_of_a_whole_table(spark):
    """Items of eight words or more that a document holds word for word, and nothing else, are found."""
    docs, bench = (spark.read.parquet(f"{DATA}/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in (t or "").lower().split()) if w) + " "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    held = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if len(t.split()) >= decontaminate.WINDOW and t in plain(r.text)}
    assert held and {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == held


def test_articles_of_a_whole_table(spark):
    """The marked article of every page, taken by its marks; and the same by density where the marks are missing."""
    for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", inner, flags=re.S)))
        want = " ".join(html.unescape(plain).split())
        assert html_text.main_text(r.html) == want
        assert html_text.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == want


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = langid.identify(docs).filter("held_out").join(docs.filter("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.detect_toxicity(docs, labels).filter("held_out").join(labels.filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").collect()
    seen = Counter((r.toxic, r.predicted) for r in rows)
    assert seen[1, 1] >= 0.88 * (seen[1, 0] + seen[1, 1]) and seen[0, 1] <= 0.01 * (seen[0, 0] + seen[0, 1])


def test_tree_decides_what_is_taken(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows, dealt, split = mixing.mix(docs).collect(), [], mixing.split_quotas
    # What a shard holds is its quota of blocks of 128 words, but for a source's last words and last block.
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: dealt.append(split(*a)) or dealt[-1])
    assert mixing.mix(docs).collect() == rows
    for s, quota in enumerate(dealt[0].sum(1)):
        held = sum(r.shard_words[s] for r in rows)
        assert quota * 128 - 2 * 128 * dealt[0].shape[1] <= held <= quota * 128
    # A smaller quota takes less, and no quota nothing.
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a) // 2)
    taken, half = sum(r.taken for r in mixing.mix(docs).collect()), dealt[0] // 2
    assert half.sum() * 128 - 2 * 128 * half.shape[1] <= taken <= half.sum() * 128
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a) * 0)
    assert all(r.taken == 0 for r in mixing.mix(docs).collect())


def test_clips_query(spark):
    rows = entries.QUERIES["avi_clips"](spark, f"{DATA}/sf0.001").collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.clip)):
        assert r.error is None and r.first == first.get(r.doc_id, 0) and r.start_s * avi.FPS == pytest.approx(r.first, abs=1e-3)
        first[r.doc_id] = r.last + 1
    size = {r.doc_id: max(1, -(-len((r.text or "").encode()) // 576)) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    assert first == size


def test_tree_of_shards_is_no_chain_of_joins(spark):
    """Splits are compared within a row: a plan of a broadcast for each filled the driver's memory."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    plan = kd_shards.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Broadcast") <= 4 and plan.count("Join") <= 4 and "Generate" not in plan


def test_walk_leads_to_the_node_of_the_keys(spark):
    turns = [{0: (0, 5, 2)}, {0: (1, -1, 1), 2: (0, 1 << 62, 3)}]
    rows = spark.createDataFrame([(4, -2), (4, -1), (5, -2), (5, 9)], "k0 long, k1 long")
    assert [r[0] for r in rows.select(kd_shards._walk(turns, F.lit)).collect()] == [0, 1, 2, 2]
    assert [r[0] for r in rows.select(kd_shards._walk([], F.lit)).collect()] == [0] * 4
