"""Each stage of the pipeline on its own input, against its operator or brute force, with awkward rows and names."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipe
from inkveil.llm import decontaminate, mixing, near_dedup, toxicity

from test_operators import words

EXTRA = ("score", "predicted", "held_out", "row", "size", "target", "blocks", "start", "stop", "taken", "kept", "component_id", "shard", "law", "__copies", "item_id", "window", "n_words")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(("ka", "mo", "ti", "ru", "le", "sa")) for _ in range(rng.randint(2, 4)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    item = text(30)
    # Long clean texts are among the labelled ones, as the classifier learns from them that length is not toxic.
    texts = [text() + " moron scum moron" * 3 if k % 5 == 0 else text(2_000 if k % 5 == 1 else 60) for k in range(200)]
    twin = text(80)
    more = [(300, twin), (301, twin), (302, twin + " end"), (303, text(20) + " " + item + " " + text(20)), (304, None), (305, ""), (306, "   "), (307, "one two"), (308, text(12_000)), (309, texts[1]), (309, texts[1]), (None, text()), (None, text())]
    rows = [(i, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], *[f"{c}{k}" for c in EXTRA]) for k, (i, t) in enumerate([*enumerate(texts), *more])]
    place = tmp_path_factory.mktemp("tables")
    names = ["doc_id long", "text string", "lang string", "source string", *[f"`{c}` string" for c in EXTRA]]
    spark.createDataFrame(rows, ", ".join(names)).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_stages_are_named():
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_drop_toxic(spark, docs, folder):
    got = pipe.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns
    score = toxicity.detect_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r.doc_id for r in score.collect() if r.predicted}
    assert toxic == {k for k in range(200) if k % 5 == 0}
    assert bag(got) == Counter({r: n for r, n in bag(docs).items() if r[0] not in toxic})


def test_drop_copies(spark, docs, folder):
    got = pipe.drop_copies(spark, docs, folder)
    assert got.columns == docs.columns
    rows, sets = docs.collect(), {}
    for r in rows:
        w = words(r.text)
        if r.doc_id is not None:
            sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    copies = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {301, 302, 309} <= copies
    kept = Counter(r.doc_id for r in got.collect())
    assert kept == Counter({**{i: 1 for i in sets if i not in copies}, None: 2})
    assert not bag(got) - bag(docs)
    assert near_dedup.near_duplicates(got).filter("NOT kept").isEmpty()


def test_rows_that_repeat_an_id(spark, folder):
    rows = [(1, None), (1, "b c"), (1, "b c"), (2, "x y z"), (2, "x y z"), (None, "b c"), (None, "b c")]
    got = pipe.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert bag(got) == Counter({(1, None): 1, (2, "x y z"): 1, (None, "b c"): 2})


def test_drop_benchmark(spark, docs, folder):
    got = pipe.drop_benchmark(spark, docs, folder)
    assert got.columns == docs.columns
    found = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert found == {303} and bag(got) == Counter({r: n for r, n in bag(docs).items() if r[0] != 303})


def test_mix_sources(spark, docs, folder):
    got = pipe.mix_sources(spark, docs, folder)
    assert got.columns == docs.columns and set(bag(got)) <= set(bag(docs))
    assert bag(got) == bag(pipe.mix_sources(spark, docs.repartition(5), folder))
    # Each source comes near its target, and no row more than twice.
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    sizes = Counter()
    for r in got.collect():
        sizes[r.source] += len(words(r.text))
    most = max(len(words(r.text)) for r in docs.collect())
    assert all(abs(sizes[s] - n) <= most / 2 + 1 for s, n in target.items())
    assert all(n <= 2 * bag(docs)[r] for r, n in bag(got).items())


def test_shard(spark, docs, folder):
    got = pipe.shard(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())


def test_empty_stages(spark, docs, folder):
    for name, stage in pipe.STAGES:
        assert not stage(spark, docs.limit(0), folder).collect(), name


def test_run(spark, folder):
    got = pipe.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert got and not ids & {301, 302, 303, 309} and not ids & {k for k in range(200) if k % 5 == 0}
    # The mix leaves out the end of a source that weighs less than its size, and nothing else goes.
    stages, table = dict(pipe.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("toxicity", "near_dedup", "decontamination", "mixing"):
        table = stages[name](spark, table, folder)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in table.collect())


def test_mixing_decides_what_is_sharded(spark, docs, folder):
    """What the mix takes twice or not at all has two slots or none."""
    mixed = pipe.mix_sources(spark, docs, folder)
    with_mix, without = (Counter((r.doc_id, r.text_crc32) for r in pipe.shard(spark, d, folder).collect()) for d in (mixed, docs))
    assert with_mix == Counter((r.doc_id, r.c) for r in mixed.selectExpr("doc_id", "crc32(cast(coalesce(text, '') AS binary)) AS c").collect())
    assert any(with_mix[k] > n for k, n in without.items()) and any(with_mix[k] < n for k, n in without.items())
