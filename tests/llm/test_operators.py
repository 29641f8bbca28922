"""Edge cases and brute force for the ten operators on one small table."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from inkveil.llm import avi, decontaminate, html_text, kd_shards, langid, mixing, near_dedup, ngram_lm, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, node long, media string, size long"


def _rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("an", "er", "ti", "on", "le")) for _ in range(rng.randint(1, 4)))
    long = " ".join(word() for _ in range(20_000))
    texts = [None, "", "   ", "one two", "One TWO", long, long, long + " tail"]
    base = [word() for _ in range(60)]
    texts += [" ".join(base), " ".join([*base[:30], "changed", *base[31:]]), " ".join(base[:15]), "x 1 2 idiot éÉ ñ"]
    texts += [" ".join(word() for _ in range(40)) + " call +1 (743) 555-3824 or a.b@mail.example.com" for _ in range(8)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], 0, 1, 2, "m", 3) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id", "en", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def test_near_duplicates(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(_rows())
    sets = {}
    for r in _rows():
        w = words(r[1])
        if r[0] is not None:
            sets[r[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles, r.kept) == (comp[r.doc_id], len(sets[r.doc_id]), comp[r.doc_id] == r.doc_id)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_repeated_ids_join_their_texts(spark):
    rng = random.Random(4)
    a, b = (" ".join(str(rng.randint(0, 999)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "some thing else"), (5, None), (5, "some thing else")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (5, 4, False)}


def test_slices_change_nothing(spark):
    rng = random.Random(6)
    base = [str(rng.randint(0, 9999)) for _ in range(80)]
    # Texts on either side of the threshold around one base, in large buckets.
    rows = [(k, " ".join(base[:j] + [f"n{k}"] + base[j + rng.choice((0, 5, 24, 30)) :])) for k, j in enumerate(rng.choices(range(60), k=200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({tuple(r) for r in near_dedup.near_duplicates(df, slice_rows=n).collect()} for n in (8192, 7))
    assert one == many and len({r[2] for r in one}) > 1


def test_near_duplicates_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter((a, b) for h in holders.values() if len(h) > 1 for k, b in enumerate(sorted(h)) for a in sorted(h)[:k])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_odd_sketch_never_rules_out_a_link():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 40))
    x, y = np.unique(a), np.unique(np.concatenate([a[40:], b]))
    s = near_dedup.odd_sketch(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2)
    assert sum(int(v).bit_count() for v in (s[0] ^ s[1]).view(np.uint64)) <= len(np.setxor1d(x, y))


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(_rows())
    total = sum(len(words(r[1])) for r in _rows())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size and abs(sum(r.taken for r in rows) - rows[0].target) <= 128
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    taken = sum(r.taken for r in got)
    assert mixing.pieces(docs).groupBy().sum("n_words").first()[0] == taken


def test_mix_is_dealt_through_the_tree(spark, docs):
    got = mixing.mix(docs, shards=5).collect()
    assert all(len(r.shard_words) == 5 and sum(r.shard_words) == r.taken for r in got)
    by = {}
    for r in mixing.pieces(docs, shards=5).collect():
        by[r.shard] = by.get(r.shard, 0) + r.n_words
    assert by == {k: n for k in range(5) if (n := sum(r.shard_words[k] for r in got))}
    other = mixing.mix(docs, seed=18, shards=5).collect()
    assert sorted(r.shard_words for r in other) != sorted(r.shard_words for r in got)


def test_blocks_are_permuted(spark):
    places, keys = [], np.random.default_rng(5).integers(0, 1 << 62, mixing.ROUNDS)
    for n in (1, 2, 7, 1000):
        df = spark.range(n).selectExpr("id AS b", f"{n}L AS blocks", f"array({','.join(f'{k}L' for k in keys)}) AS keys")
        places = [r[0] for r in df.orderBy("b").selectExpr(mixing.permuted("b")).collect()]
        assert sorted(places) == list(range(n))
    # A fixed stride has one difference between neighbours.
    assert len({(b - a) % 1000 for a, b in zip(places, places[1:])}) > 500


def test_mix_documents(spark):
    size = {"a": [5] * 12, "b": [3000, *[10] * 300], "c": [700] * 4, "d": [40], "e": [7] * 9}
    rows = [(1000 * k + i, " ".join(["w"] * n), s) for k, s in enumerate(size) for i, n in enumerate(size[s])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 0.8, 1.5):
        target = {r.source: r.target for r in mixing.mix(df, share=share).collect()}
        taken, times = dict.fromkeys(size, 0), {}
        for r in mixing.mix_documents(df, share=share).collect():
            taken[r.source] += len(r.text.split())
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert all(taken.values()) and max(times.values()) <= 2
        for s, n in size.items():
            assert abs(taken[s] - target[s]) <= max(n) / 2 + 1 or taken[s] in n


def test_water_fill_and_quotas():
    assert mixing.water_fill([10, 100, 100], [3, 1, 2], 315, 2) == pytest.approx([20, 295 / 3, 590 / 3])
    dealt = mixing.split_quotas([7, 0, 1000], 16)
    assert dealt.sum(0).tolist() == [7, 0, 1000] and dealt.sum(1).max() - dealt.sum(1).min() <= 4


def test_avi(docs):
    rows = {r.doc_id: r for r in avi.store_texts(docs).collect()}
    for i, t, *_ in _rows():
        data = (t or "").encode()
        pay = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
    assert rows[5].feature == rows[6].feature and rows[5].media_sha256 == rows[6].media_sha256
    frames = np.random.default_rng(1).integers(0, 256, (9, 24, 24), dtype=np.uint8)
    media = avi.write_avi(frames)
    assert (avi.read_avi(media)[0] == frames).all()
    a, n = avi.parse_avi(media)[0][3]
    assert (avi.decode_jpeg(media[a : a + n]) == frames[3]).all()
    still = np.concatenate([np.zeros((6, 24, 24), np.uint8), np.full((5, 24, 24), 200, np.uint8)])
    assert avi.shots(still) == [(0, 5), (6, 10)]
    with pytest.raises(avi.BadMedia):
        avi.parse_avi(b"RIFF0000WAVE")


def test_lm(docs):
    got = ngram_lm.score(docs, group_bytes=4000, part_grams=5000).collect()
    assert len(got) == len(_rows()) and {r.n_words for r in got if r.doc_id in (0, 1, 2)} == {0}
    lists = [words(r[1]) for r in _rows()]
    count = lambda w: Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    own = [count(w) for w in lists]
    whole = sum(own, Counter())
    total = sum(map(len, lists))

    def p(row, gram):
        c = whole[gram] - own[row][gram]
        if len(gram) == 1:
            return (c or 0.4) / max(total - len(lists[row]), 1)
        return c / (whole[gram[:-1]] - own[row][gram[:-1]]) if c else 0.4 * p(row, gram[1:])

    want = [(r[0], round(sum(math.log10(p(i, tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w))), 4)) for i, (r, w) in enumerate(zip(_rows(), lists))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, round(r.log10_score, 4) + 0.0 if r.n_words else 0)) for r in got)


def test_html():
    page = "<html><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>T</h1><p>a &amp; <b>b<br>c  d</p><p>" + "word " * 40 + "</article><footer>f</footer>"
    assert html_text.main_text(page) == "T a & b c d " + " ".join(["word"] * 40)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""


def test_html_without_links():
    paras = [f"{w} " * 40 for w in ("one", "two", "three", "four")]
    body = "".join(f"<p>{p}</p>" for p in paras)
    whole = " ".join(" ".join(p.split()) for p in paras)
    assert html_text.main_text(f"<body><div>Home About</div><div><h1>T</h1>{body}</div><div>All rights</div></body>") == "T " + whole
    assert html_text.main_text(f"<body><div>Home</div><article>{body}<p>end</p></article><div>All rights</div></body>") == whole + " end"
    halves = ["".join(f"<p>{p}</p>" for p in paras[k : k + 2]) for k in (0, 2)]
    assert html_text.main_text(f"<div>Home</div><div><section>{halves[0]}</section><h2>Next</h2><section>{halves[1]}</section></div><div>Legal</div>").replace("Next ", "") == whole
    assert html_text.main_text(f"<div>Home</div><div>{paras[0]}<br>{paras[1]}</div><div>Legal</div>") == " ".join(whole.split()[:80])
    assert html_text.main_text(f"<h1>T</h1><p>{paras[0]}</p><p>short</p><div>Legal</div>") == "T " + " ".join(paras[0].split()) + " short"


def test_html_hints():
    text = " ".join(["word"] * 60)
    side = "<div class='sidebar'>side</div><div id='site-footer'>foot</div>"
    for wrap in ("div class='layout has-sidebar'", "div id='page' class='site no-sidebar'", "section class='elementor-widget'", "div class='post no-comments'", "div class='social'"):
        for inner in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"):
            assert html_text.main_text(f"<body><{wrap}>{inner}</{wrap.split()[0]}>{side}</body>") == text
    page = f"<article><header class='entry-header'><h1>Title</h1></header><h2 class='section-header'>Part</h2><p>{text}</p><div class='share'>send</div></article>"
    assert html_text.main_text(page + "<div class='comments'><article class='comment-body'>" + "me too " * 200 + "</article></div>") == "Title Part " + text


def test_html_of_great_depth():
    text = " ".join(["word"] * 60)

    def seconds(n):
        pages = (f"{'<div>' * n}<p>{text}</p>{'</div>' * n}", "<b></i>" * n + f"<p>{text}</p>", "<article>" * n + f"<p>{text}</p>", "<p>" + "<i>" * n + text)
        start = time.perf_counter()
        for page in pages:
            assert html_text.main_text(page) == text
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_pages(spark):
    df = spark.createDataFrame([(1, None, "<p>x y</p>", 5), (None, "u", None, 6)], "page_id long, url string, html string, n_chars int")
    assert {(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()} == {(1, "x y", 3), (None, "", 0)}


def test_toxicity(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("the", "of", "a", "cat", "sun")) for _ in range(30)) + (" moron scum" if i % 5 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.detect_toxicity(df, labels).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) == (r.score >= 0.7) for r in got if r.held_out)
    assert len(toxicity.detect_toxicity(docs, labels.filter("false")).collect()) == len(_rows())


def test_langid(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[3].lang_pred in ("en", "fr") and 0 <= got[5].score <= 1


def test_shards(docs):
    got = kd_shards.shard_documents(docs, shards=4).collect()
    assert len(got) == len(_rows())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 0} == {(1, 0)}


def test_equal_texts_share_a_shard(spark):
    rows = [(k, f"w{k} " * 50) for k in range(600)] + [(1000 + k, "copy " * 30) for k in range(50)] + [(2000 + k, "other " * 40) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "concat('s', doc_id % 3) AS source", "'en' AS lang", "1 AS size", "2 AS node", "3 AS atom")
    got = kd_shards.shard_documents(df, shards=8).collect()
    weight = Counter()
    for r in got:
        weight[r.shard] += r.size
    assert max(weight.values()) <= 1.03 * min(weight.values()) and len(weight) == 8
    assert all(len({r.shard for r in got if lo <= r.doc_id < lo + 1000}) == 1 for lo in (1000, 2000))
    # Copies that outweigh a shard are parted, into as few shards as that takes.
    hot = spark.createDataFrame(rows[:200] + [(5000 + k, "hot " * 100) for k in range(100)], "doc_id long, text string")
    got = kd_shards.shard_documents(hot, shards=4).collect()
    share = sum(r.size for r in got) / 4
    least = sum(r.size for r in got if r.doc_id >= 5000) / share
    assert len({r.shard for r in got if r.doc_id >= 5000}) <= math.ceil(least) + 1
    assert all(abs(sum(r.size for r in got if r.shard == k) / share - 1) < 0.02 for k in range(4))


def test_pii():
    text = "a.b@mail.example.com 1.2.3.4 999.1.1.1 +1 (743) 555-3824; 4550997810720808"
    kinds = [pii.KINDS[y] for _, _, y in pii.base_spans(text)]
    assert kinds == ["email", "ip", "phone", "card"]
    spans = pii.all_spans('token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" x', [], pii.train())
    assert [pii.KINDS[y] for _, _, y in spans] == ["secret"]


def test_field_on_fresh_sentences():
    weights, rng = pii.train(), random.Random(99)
    hit, extra, missed = Counter(), Counter(), Counter()
    for _ in range(400):
        text, gold = pii._sentence(rng)
        got = set(pii.all_spans(text, pii.base_spans(text), weights))
        hit.update(y for *_, y in got & set(gold))
        extra.update(y for *_, y in got - set(gold))
        missed.update(y for *_, y in set(gold) - got)
    for y in range(len(pii.KINDS)):
        assert hit[y] >= 0.9 * (hit[y] + missed[y]) and hit[y] >= 0.9 * (hit[y] + extra[y])


def test_field_on_lines_of_its_own():
    found = lambda t: [pii.KINDS[y] for *_, y in pii.all_spans(t, pii.base_spans(t), pii.train())]
    assert found("call (743) 555-3824 today") == ["phone"] and found("ssn 123-45-6789.") == ["ssn"]
    assert found("secret: 3f786850e387550fdab836ed7e6dc881de23001b") == ["secret"]
    for clean in ("IBAN DE44 5001 0517 5407 3249 31 ok", "pay to GB29NWBK60161331926819 now", "commit 3f786850e387550fdab836ed7e6dc881de23001b fixed", "order 2024-05-06 no 12345", "", "x" * 200_000):
        assert found(clean) == []


def test_decontamination(spark, docs):
    item = "A train leaves at 5 km from the town and Mary Ann walks 7 km to meet it there today"
    other = item.replace("5", "12").replace("7", "30").replace("Mary Ann", "Bob")
    clash = item.replace("Mary Ann", "Bob")
    df = spark.createDataFrame([(1, f"x y. {item} z"), (2, other), (3, "nothing of the kind here at all my friend"), (4, None), (None, item), (5, clash)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(1, 9), (2, 9), (5, 9)}


def test_variants_in_one_text(spark):
    item = "A train leaves at 5 km from the town and Mary Ann walks 7 km to meet it there today"
    copy = lambda a, b, who: item.replace("5", a).replace("7", b).replace("Mary Ann", who)
    boxes = "In the yard there are 2 boxes and 2 cats and someone has to count all of them"
    fewer = "In the yard there are 2 boxes and 3 cats and someone has to count all of them"
    loud = "At noon Anna met the baker and then Anna met the smith and then Anna met the cook of the town"
    mixed = loud.replace("Anna", "Otto", 1).replace("Anna", "Emil", 1).replace("Anna", "Karl", 1)
    rows = [(1, f"{copy('12', '30', 'Bob')}. {copy('13', '31', 'Tom')}."), (2, boxes.replace("2 b", "3 b").replace("2 c", "4 c")), (3, fewer.replace("3", "2")), (4, mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, boxes), (7, fewer), (6, loud)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 9), (2, 8), (2, 7), (3, 8), (3, 7)}


def test_short_items(spark):
    items = ["Calculate 15 * 23", "What is 12 km + 7 km?", "What is the capital of France?", "Mary Ann Smith lives here now"]
    rows = [f"Question {k}: {t} and more words" for k, t in enumerate(items)]
    rows += ["Question 8: What is the capital of Peru?", "Actually Lima is the capital of Peru", "we saw Bob with Mary Ann Lee lives here now", "Calculate 16 * 23", "What is 13 km + 8 m?"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()]
    assert sorted(got) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (6, 3)]


def test_long_item_of_few_template_words(spark):
    item = "red " + "- " * 40 + "fox runs far"
    df = spark.createDataFrame([(1, f"so the {item} away"), (2, "red fox")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(1, 9)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not mixing.mix(empty).collect() and not avi.store_texts(empty).collect() and not pii.find_pii(empty).collect() and not langid.identify(empty).collect()
    assert not ngram_lm.score(empty).collect() and not near_dedup.near_duplicates(empty).collect() and not kd_shards.shard_documents(empty).collect()


def test_enough_tables():
    import inspect

    m, half = (inspect.signature(near_dedup.near_duplicates).parameters[k].default for k in ("m", "half"))
    assert 2 * (1 - 0.75**half) ** m <= 1.05e-4
    assert inspect.signature(near_dedup.signatures).parameters["m"].default == m


def test_mix_documents_follows_the_draw(spark, docs, monkeypatch):
    """Whole rows come as often as the tree's draw takes them, but for rows that it takes in part."""
    drawn = Counter()
    for r in mixing.mix(docs).filter("size > 0").collect():
        drawn[r.doc_id, r.size, r.source] += r.taken
    rows = Counter((r.doc_id, len(words(r.text)), r.source) for r in docs.collect())
    got = Counter((r.doc_id, len(words(r.text)), r.source) for r in mixing.mix_documents(docs).collect())
    assert all(abs(got[k] - drawn[k] / k[1]) < n for k, n in rows.items() if k[1])
    most = Counter()
    for k in rows:
        most[k[2]] = max(most[k[2]], k[1])
    for s in most:
        assert abs(sum(n * k[1] for k, n in got.items() if k[2] == s) - sum(n for k, n in drawn.items() if k[2] == s)) <= most[s] / 2
    # The tree decides: with half of its quotas less is taken, and without them nothing.
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a) // 2)
    half = Counter((r.doc_id, len(words(r.text)), r.source) for r in mixing.mix_documents(docs).collect())
    assert sum(n * k[1] for k, n in half.items()) < 0.6 * sum(n * k[1] for k, n in got.items())
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a) * 0)
    assert not mixing.mix_documents(docs).collect()
