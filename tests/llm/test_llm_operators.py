"""Small cases for every operator: edge rows, brute force, round trips and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenloom.llm import op1_ordinal_toxicity as op1
from provenloom.llm import op2_rans_tokens as op2
from provenloom.llm import op3_simhash_decontam as op3
from provenloom.llm import op4_line_spread as op4
from provenloom.llm import op5_html_blocks as op5
from provenloom.llm import op6_language_evidence as op6
from provenloom.llm import op7_nn_descent as op7
from provenloom.llm import op8_ngram_jaccard as op8
from provenloom.llm import op9_ppm_scoring as op9
from provenloom.llm import op10_entropy_mixing as op10
from provenloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs(spark, *texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "extra") for i, t in enumerate(texts)], DOCS)


EDGE = [None, "", " \n\t ", "one", "same words here again and again", "same words here again and again", "long word " * 40_000]


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n)]


# --- 1


def test_toxicity_learns_and_scores_edge_rows(spark):
    r = random.Random(1)
    base = words(300, 2)
    texts = [" ".join(r.choice(base) for _ in range(60)) + (" vile scumbag" * (1 + i % 3) if i % 4 == 0 else "") for i in range(200)]
    d = docs(spark, *texts, *EDGE)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(100)] + [(0, 1, "x"), (None, 1, "x"), (9999, 0, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    model = op1.fit(d, labels)
    got = {x["doc_id"]: x for x in op1.score(d, model).collect()}
    assert all(got[i]["toxic"] == (i % 4 == 0) for i in range(100, 200))
    assert not any(got[i]["toxic"] for i in range(200, 200 + len(EDGE)))
    assert list(model.thresholds) == sorted(model.thresholds)
    assert got[8]["severity"] > got[1]["severity"]


def test_toxicity_without_labels_rejects_nothing(spark):
    d = docs(spark, "a b", None)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r["toxic"] for r in op1.score(d, op1.fit(d, none)).collect())
    assert op1.score(d.limit(0), op1.fit(d, none)).count() == 0


# --- 2


def test_rans_round_trip_segments_and_checksums():
    r = np.random.default_rng(1)
    ids = (r.zipf(1.3, 300_000) % op2.VOCABULARY).astype(np.uint16)
    coder = op2.Coder(op2.scaled(np.bincount(ids, minlength=op2.VOCABULARY)))
    for part in (ids, ids[:1], ids[:1000]):
        data = coder.encode(part)
        assert (coder.decode(data) == part).all()
    data = coder.encode(ids)
    assert (np.concatenate([coder.decode(data, k) for k in range(-(-len(ids) // (2048 * 64)))]) == ids).all()
    broken = bytearray(data)
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))


def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    texts = [*EDGE, "Don't STOP: 3²+x <|endoftext|> Ünïcode’s ﬁ é ǅ Σας\x1c end", "a%%% B*** c'll 'S"]
    got = {r["doc_id"]: r for r in op2.digest(docs(spark, *texts)).collect()}
    library, start = Tokenizer.from_file(op2.vocabulary_path()), 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert op2.digest(docs(spark, "x").limit(0)).count() == 0


# --- 3


def test_decontamination_finds_planted_windows(spark):
    item, other = words(30, 3), words(25, 4)
    near = item[:15] + ["changed"] + item[16:]
    texts = [" ".join(words(50, 5) + item + words(9, 6)), " ".join(item).upper() + "!", " ".join(words(80, 7)), " ".join(near), " ".join(other), " ".join(item[:12]), *EDGE]
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, ", ".join(other), 0), (3, None, 0), (4, "one", 0)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op3.leaks(docs(spark, *texts), bench).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 1.0, (4, 2): 1.0, (9, 4): 1.0}
    loose = spark.createDataFrame([(None, texts[0], 1), (None, "far " + " ".join(other) + " off", 2), (7, "she said one two three", 3), (7, "she said one two three", 3), (8, "one two", 4)], "doc_id long, text string, copy int")
    few = bench.union(spark.createDataFrame([(5, "one, two three", 0)], bench.schema))
    rows = sorted(((r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in op3.leaks(loose, few).collect()), key=repr)
    assert rows == sorted([(None, 1, 50, 1.0), (None, 2, 1, 1.0), (7, 4, 2, 1.0), (7, 5, 2, 1.0), (8, 4, 0, 1.0)], key=repr)
    assert op3.leaks(docs(spark, "x").limit(0), bench).count() == 0 and op3.leaks(docs(spark, "x"), bench.limit(0)).count() == 0


def test_decontamination_between_the_threshold_and_one(spark):
    items = [words(60, 100 + i) for i in range(40)]
    texts, expected = [], {}
    for i, item in enumerate(items):
        near = list(item)
        near[(7 * i) % 50 + 5] = "changed"
        texts.append(" ".join(words(20, 900 + i) + near + words(20, 950 + i)))
        expected[i] = 51 / 61  # all shingles of one item weigh the same; five of 56 are lost and five others come in
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["similarity"]) for r in op3.leaks(docs(spark, *texts), bench).collect()}
    assert got == {i: (i, round(v, 6)) for i, v in expected.items()}


def test_multi_index_meets_all_within_radius():
    masks = set(op3.flips())
    r = random.Random(8)
    for _ in range(500):
        a, b = r.getrandbits(64), 0
        for bit in r.sample(range(64), op3.RADIUS):
            b |= 1 << bit
        assert any(((b >> (8 * k)) & 255) in masks for k in range(8)), a


# --- 4


def test_line_spread(spark):
    rows = [(i, f"Common line\nown {i}\n\n  Common line ", f"s{i}", "x") for i in range(6)] + [(6, "Common line", None, "x"), (7, None, "s1", "x"), (8, "", "s1", "x"), (9, "rare\nrare", "s2", "x")]
    got = {r["doc_id"]: r for r in op4.clean(spark.createDataFrame(rows, "doc_id long, text string, source string, line string")).collect()}
    assert got[0]["text"] == "own 0\n" and got[0]["n_removed"] == 2 and got[6]["text"] == "" and got[7]["text"] is None and got[8]["text"] == "" and got[9]["text"] == "rare\nrare"


# --- 5


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site name of the day</header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies for the best of the web and for all of you, as it is the law of the land and of the sea.</div>
    <article><h1>Head &amp; line</h1><p><b>The first of the blocks is in the middle of a page and it is long enough to be of use to all of us, as it was for the others.</b><br>More
    of it.<p>Short.</p><aside class=ad>Buy the best of the best</aside></article><div id="comments"><p>The comment of a reader that is long and in the way of the text, as it often is on the web for all.</p></div>
    <footer>&copy; the owner</footer></body>"""
    assert op5.main_text(page) == (
        "Head & line\n\nThe first of the blocks is in the middle of a page and it is long enough to be of use to all of us, as it was for the others. More of it.\n\nShort."
    )
    assert op5.main_text(None) == "" and op5.main_text("<p>") == "" and op5.main_text("<!-- open") == ""


PROSE = "The first of the blocks is in the middle of a page and it is long enough to be of use to all of us, as it was for the others in the house by the sea."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p title=it's>{PROSE}</p><p>{PROSE} Two.</p><p>{PROSE} Three.</p></article>", f"{PROSE}\n\n{PROSE} Two.\n\n{PROSE} Three."),
        (f"<main>x</main><div><p>{PROSE}</p><p>{PROSE} Two.</p></div>", f"x\n\n{PROSE}\n\n{PROSE} Two."),
        (f"<article><div class='share-holder-report'><p>{PROSE}</p></div><div class=story-tags-body><p>{PROSE} Two.</p></div></article>", f"{PROSE}\n\n{PROSE} Two."),
        (f"<div class='layout with-sidebar'><article><p>{PROSE}</p></article><div class=sidebar><p>{PROSE}</p></div></div>", PROSE),
        ("<div><p>" + "Длинный абзац о том, как дом стоял у реки и что люди говорили о нём, когда шли по дороге. " * 3 + "</p></div>", ("Длинный абзац о том, как дом стоял у реки и что люди говорили о нём, когда шли по дороге. " * 3).strip()),
        ("<div><p>" + "Uzun bir paragraf evin nehir yanında durduğunu anlatır. " * 4 + "</p></div>", ("Uzun bir paragraf evin nehir yanında durduğunu anlatır. " * 4).strip()),
        (f"<p>{PROSE} Let <math>x = 2</math> be.</p>", f"{PROSE} Let x = 2 be."),
        (f"<div><nav><a href=a>{PROSE}</a></nav><p>{PROSE}</p><div id=comments><p>{PROSE} I agree.</p></div></div>", PROSE),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert op5.main_text(page) == text


def test_pages_keep_rows_and_edge_cases(spark, tmp_path):
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    rows = [(1, "u", long, 1), (1, "u", long, 1), (None, None, None, 2), (3, "u", "", 3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    for name, x in (("all", d), ("none", d.limit(0))):
        x.write.parquet(f"{tmp_path}/{name}/pages.parquet")
    got = sorted(((r["page_id"], r["n_chars"]) for r in op5.op5_html_blocks(spark, f"{tmp_path}/all").collect()), key=repr)
    n = 5000 * len(PROSE) + 2 * 4999
    assert got == sorted([(1, n), (1, n), (None, 0), (3, 0)], key=repr)
    assert op5.op5_html_blocks(spark, f"{tmp_path}/none").count() == 0


def test_undecided_blocks_follow_their_neighbours():
    assert op5.second_pass([None, True, None, None, False, None], [False] * 6) == [True, True, True, False, False, False]
    assert op5.second_pass([None], [False]) == [False]


# --- 6


def test_language_evidence(spark):
    texts = {"en": "the house of the old man and the sea is by the road", "fr": "la maison du vieil homme et de la mer est sur la route"}
    train = spark.createDataFrame([(i, texts[k], k) for i, k in enumerate(["en", "fr"] * 20)], "doc_id long, text string, lang string")
    langs, model = op6.fit(train)
    rows = [(i, f"http://www.a.fr/{i}", f'<html lang="fr"><p>{texts["fr"]}</p>') for i in range(9)] + [(9, "http://www.a.fr/9", "<p>12345</p>"), (10, None, None), (11, "http://b.com/en/x", f"<p>{texts['en']}</p>")]
    got = {r["page_id"]: r for r in op6.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), langs, model).collect()}
    assert len(got) == 12 and got[0]["lang"] == "fr" and got[9]["lang"] == "fr" and got[11]["lang"] == "en" and got[10]["lang"] in langs
    assert op6.identify(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0), langs, model).count() == 0


def test_language_model_is_right_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    langs, model = op6.fit(d.where("doc_id % 2 = 0"))
    rows = [r for r in d.where("doc_id % 2 = 1").collect() if r["text"] and len(r["text"]) > 100]
    right = sum(langs[int(model[op6.trigrams(r["text"])].sum(axis=0).argmax())] == r["lang"] for r in rows)
    print(f"held-out languages right: {right} of {len(rows)}")
    assert right >= 0.9 * len(rows)
    many = spark.createDataFrame([(i, f"word{i} text", f"l{i}") for i in range(100)], "doc_id long, text string, lang string")
    assert len(op6.fit(many)[0]) == 100


# --- 7


def test_neighbours_reach_recall(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((1200, 16))
    rows = [(i, v[i].tolist(), "x") for i in range(1200)] + [(1200, None, "x"), (1201, [0.0] * 16, "x"), (1202, [1.0, None] + [0.0] * 14, "x"), (1203, [float("nan")] * 16, "x"), (1204, [1.0], "x"), (3, v[3].tolist(), "x")]
    vectors = op7.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    got = op7.search(vectors.where("id % 20 = 0").select("id"), op7.build(vectors), vectors, 20).collect()
    hits, stored = 0, v.astype(float)
    for q in range(0, 1200, 20):
        s = stored @ stored[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {x["vec_id"] for x in got if x["query_id"] == q})
    assert hits / 1200 >= 0.9 and len(got) == 1200
    few = op7.usable(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>, score string"))
    assert op7.search(few.where("id % 20 = 0").select("id"), op7.build(few), few, 20).count() == 4


@pytest.mark.parametrize("lengths", ["a few long", "heavy tail"])
def test_neighbours_of_unequal_lengths_reach_recall(spark, lengths):
    r = np.random.default_rng(5)
    v = r.standard_normal((1200, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if lengths == "a few long":
        v[[7, 307, 607, 907]] *= np.array([[100.0], [200.0], [500.0], [1000.0]])
    else:
        v *= r.lognormal(0, 2, (1200, 1))
    vectors = op7.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    got = op7.search(vectors.where("id % 20 = 0").select("id"), op7.build(vectors), vectors, 20).collect()
    hits = 0
    for q in range(0, 1200, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {x["vec_id"] for x in got if x["query_id"] == q})
    print(f"recall with {lengths}: {hits / 1200:.4f}")
    assert hits / 1200 >= 0.9 and len(got) == 1200


def test_neighbours_of_equal_vectors_are_the_least_ids(spark):
    r = np.random.default_rng(9)
    v = r.standard_normal((1600, 16))
    v[300:1300] = v[300]
    vectors = op7.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    got = op7.search(vectors.where("id % 20 = 0").select("id"), op7.build(vectors), vectors, 20).collect()
    assert len(got) == 80 * 20
    right = 0
    for q in range(300, 1300, 20):
        s = (v @ v[q]).round(9)
        expected = [i for i in np.lexsort((np.arange(1600), -s)) if i != q][:20]
        right += [x["vec_id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == expected
    print(f"queries among equal vectors with the right ids in order: {right} of 50")
    assert right == 50
    same = op7.usable(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>"))
    got = op7.search(same.where("id = 20").select("id"), op7.build(same), same, 20).orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == list(range(20))


def test_a_search_keeps_no_more_than_its_beam(spark, monkeypatch):
    v = np.random.default_rng(4).standard_normal((900, 16))
    vectors = op7.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    graph, queries, kept, real = op7.materialise(op7.build(vectors), "ann-test"), vectors.where("id % 100 = 0").select("id"), [], op7.materialise

    def counted(df, name):
        out = real(df, name)
        if name == "ann-beam":
            kept.append(out.count())
        return out

    monkeypatch.setattr(op7, "materialise", counted)
    got = [tuple(r) for r in op7.search(queries, graph, vectors, 20).orderBy("query_id", "rank").collect()]
    assert len(got) == 9 * 20 and max(kept) <= 9 * op7.BEAM
    monkeypatch.setattr(op7, "ASKED_BYTES", 0)  # queries too many to be sent
    assert [tuple(r) for r in op7.search(queries, graph, vectors, 20).orderBy("query_id", "rank").collect()] == got


# --- 8


def brute(texts, width, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return {i: (len(s), group[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, width, num):
    r, texts = random.Random(num), list(EDGE)
    for k in range(12):
        base = words(r.randint(5, 160), k)
        for _ in range(12):
            t = list(base)
            for _ in range(r.randint(0, 7)):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 2)] = words(1, r.random())
            texts.append(" ".join(t))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in op8.link(docs(spark, *texts), width, num, 100).collect()}
    assert got == brute(texts, width, num, 100)


def agreements(a, b, num):
    """In how many tokens two sets agree that one of them has for its own class, and how many are needed."""
    content, at, need, own = op8.bucket_rows([a, b], num, 100)
    have = [{int(c): (int(k), bool(o)) for c, k, o in zip(content[at == i], need[at == i], own[at == i], strict=True)} for i in (0, 1)]
    met = [c for c in have[0] if c in have[1] and (have[0][c][1] or have[1][c][1])]
    return len(met), min((min(have[0][c][0], have[1][c][0]) for c in met), default=1)


@pytest.mark.parametrize("num", [80, 90])
def test_jaccard_tokens_of_linked_sets_agree_and_of_unlike_sets_do_not(num):
    """Sets that link agree in enough tokens, whatever their sizes; sets that have a third in common are no candidates."""
    r = np.random.default_rng(num)
    fresh = lambda n: r.integers(0, 1 << 62, n).astype(np.uint64)
    for n in (1, 2, 5, 9, 17, 40, 90, 200, 350, 700, 1500, 3000):
        for _ in range(8):
            a = np.unique(fresh(n))
            gone = int(r.integers(0, n * (100 - num) // 100 + 1))
            added = max(0, ((n - gone) * 100 - num * n) // num)
            b = np.unique(np.concatenate([a[gone:], fresh(int(r.integers(0, added + 1)) if r.random() < 0.5 else added)]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= num * (len(a) + len(b) - both)
            k, least = agreements(a, b, num)
            assert k >= least
            if n >= 200:
                common = fresh(n * 45 // 100)  # similarity 0.29
                k, least = agreements(*(np.unique(np.concatenate([common, fresh(n - len(common))])) for _ in range(2)), num)
                assert k < least


def test_jaccard_of_documents_with_common_passages(spark, monkeypatch):
    """Documents that share a passage make no family, and the links among long ones of other sizes are exact."""
    seen, plain = {}, op8.materialise

    def noted(df, name):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(op8, "materialise", noted)
    monkeypatch.setattr(op8, "discard", lambda *steps: None)
    passage, r = words(140, 5), random.Random(6)
    texts = [" ".join(passage + words(200, 100 + k)) for k in range(60)]
    pairs = []
    for k in range(8):
        t = words(400, 300 + k)
        at = r.randrange(200)
        pairs += [" ".join(t), " ".join(t[:at] + words(r.randint(1, 60), k) + t[at + r.randint(1, 40) :]), " ".join(t[: r.randint(300, 360)])]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in op8.link(docs(spark, *texts, *pairs), 5, 80, 100).collect()}
    assert got == brute(texts + pairs, 5, 80, 100)
    assert seen["jaccard-carriers"].count() <= len(pairs) + len(texts) // 10 and seen["jaccard-beside"].count() <= len(pairs)


def test_jaccard_of_a_cluster_that_does_not_link_with_its_leader(spark, monkeypatch):
    """Copies of a text that is too far from the leader of its family come under that text: their pairs aren't listed, and links to others stay."""
    seen, plain = {}, op8.materialise

    def noted(df, name):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(op8, "materialise", noted)
    monkeypatch.setattr(op8, "discard", lambda *steps: None)
    base, r, texts = words(200, 1), random.Random(3), []
    other = base[:160] + words(40, 2)
    between = base[:160] + base[160:180] + words(40, 2)[20:]

    def changed(text, n, seed):
        t = list(text)
        for k in range(n):
            t[r.randrange(len(t))] = words(1, 1000 * seed + k)[0]
        return " ".join(t)

    texts += [changed(base, 1, k) for k in range(1, 50)] + [" ".join(base)]
    texts += [changed(other, 1, k) for k in range(100, 130)] + [" ".join(other)] + [changed(other, 6, k) for k in range(200, 206)]
    without = brute(texts, 5, 80, 100)
    assert without[0][1] != without[60][1]
    for more in ([], [" ".join(between)]):  # a text that links with both makes them one
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in op8.link(docs(spark, *texts, *more), 5, 80, 100).collect()}
        assert got == brute(texts + more, 5, 80, 100)
        assert seen["jaccard-judged"].where("not linked").count() >= 30 and seen["jaccard-nearer"].where("linked").count() >= 30
        assert seen["jaccard-beside"].count() <= len(texts)


def test_jaccard_sorts_once_and_passes_texts_in_small_batches(spark, monkeypatch):
    """Tasks of the token step and of the keys beside a leader hold one sorted side; batches of texts are bounded, and the session's setting stays."""
    key, seen, plain = "spark.sql.execution.arrow.maxBytesPerBatch", {}, op8.materialise

    def noted(df, name):
        seen[name] = (spark.conf.get(key), df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(op8, "materialise", noted)
    before = spark.conf.get(key)
    words = [f"w{k}" for k in range(120)]
    op8.link(docs(spark, *[" ".join(words[:k] + ["x", "y"] * (k % 2) + words[k + 1 :]) for k in range(0, 60, 3)]), 3, 90, 100).count()
    assert spark.conf.get(key) == before
    for name in ("jaccard-rows", "jaccard-usual", "jaccard-judged", "jaccard-links"):
        assert int(seen[name][0]) <= 8_000_000
    assert seen["jaccard-rows"][1].count("Join") == 0 and seen["jaccard-rows"][1].count("RepartitionByExpression") == 1
    assert seen["jaccard-met"][1].count("Window") and "jaccard-often" not in seen


def test_jaccard_links_through_rows_without_id(spark):
    base = words(100, 1)
    one, two, bridge = list(base), list(base), list(base)
    one[10] = two[90] = "changed"
    texts = [" ".join(one), " ".join(two), " ".join(bridge)]
    expected = brute(texts, 3, 90, 100)
    assert brute(texts[:2], 3, 90, 100) == {0: (98, 0), 1: (98, 1)} and expected[1] == (98, 0)
    rows = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (None, "alone in the world"), (3, None), (None, None), (4, texts[0].upper()), (4, "x y z")]
    d = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, fp int, row int, content int")
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in op8.link(d, 3, 90, 100).collect()), key=repr)
    assert got == sorted([(1, 98, 1), (2, 98, 1), (None, 98, 1), (None, 98, 1), (None, 2, None), (3, 0, 3), (None, 0, None), (4, 98, 1), (4, 1, 4)], key=repr)
    assert op8.link(d.limit(0), 3, 90, 100).count() == 0


def test_parities_never_exceed_the_difference(spark):
    r, rows = np.random.default_rng(4), []
    for _ in range(60):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(r.integers(0, len(a))) // 3 :], r.integers(0, 1 << 62, int(r.integers(0, n // 3 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        rows.append((op8.parities(a).tolist(), op8.parities(b).tolist(), len(a), len(b), 100 * common >= 80 * (len(a) + len(b) - common)))
    d = spark.createDataFrame(rows, "a array<long>, b array<long>, m int, n int, linked boolean")
    got = d.select("linked", op8.may_link(F.col("a"), F.col("b"), F.col("m"), F.col("n"), 80, 100).alias("may")).collect()
    assert all(x["may"] for x in got if x["linked"]) and any(x["linked"] for x in got) and not all(x["may"] for x in got)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, i) for i in range(51, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {i: 50 for i in range(50, 60)}


# --- 9


def test_ppm_matches_a_plain_model(spark):
    texts = ["abracadabra abra", "Cadabra abra é", None, "", "abra cadabra!", "zebra", "abracadabra abra", "brazen abbot"]
    got = {r["doc_id"]: r for r in op9.score(docs(spark, *texts)).collect()}
    counts = [{} for _ in range(op9.ORDER + 1)]
    pad = bytes([op9.PAD]) * op9.ORDER
    for i, t in enumerate(texts):
        if not op9.held_out(i):
            b = pad + op9.folded(t) + bytes([op9.END])
            for p in range(op9.ORDER, len(b)):
                for o in range(op9.ORDER + 1):
                    node = counts[o].setdefault(b[p - o : p], {})
                    node[b[p]] = node.get(b[p], 0) + 1

    def p(context, s, skip=frozenset(), o=op9.ORDER):
        if o < 0:
            return 1 / (op9.SYMBOLS - len(skip))
        left = {k: v for k, v in counts[o].get(context[len(context) - o :] if o else b"", {}).items() if k not in skip}
        if not left:
            return p(context, s, skip, o - 1)
        n = sum(left.values())
        return (2 * left[s] - 1) / (2 * n) if s in left else len(left) / (2 * n) * p(context, s, skip | left.keys(), o - 1)

    assert math.isclose(sum(p(pad, s) for s in range(256) if s != op9.PAD), 1)
    for i, t in enumerate(texts):
        b = pad + op9.folded(t) + bytes([op9.END])
        assert math.isclose(got[i]["score"], sum(math.log10(p(b[k - op9.ORDER : k], b[k])) for k in range(op9.ORDER, len(b))), rel_tol=1e-5)
        assert got[i]["held_out"] == op9.held_out(i)
    assert op9.adaptive("abababab") > 2 * op9.adaptive("abab")
    assert op9.score(docs(spark, "x").limit(0)).count() == 0


# --- 10


def test_mixing_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "b", "c", "d", None]), "x") for i in range(600)] + [(600, None, "a", "x"), (601, "w w", "e", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = op10.mix(d).collect()
    again = {x["doc_id"]: x["copies"] for x in op10.mix(d.repartition(7)).collect()}
    total = sum(x["size"] for x in got)
    by = {}
    for x in got:
        assert 0 <= x["copies"] <= 2 and again[x["doc_id"]] == x["copies"]
        by.setdefault(x["source"], []).append(x)
    assert math.isclose(sum(v[0]["target"] for v in by.values()), 1.5 * total)
    for v in by.values():
        assert abs(sum(x["size"] * x["copies"] for x in v) - v[0]["target"]) <= 40 and v[0]["target"] <= 2 * v[0]["source_size"]
    assert op10.mix(d.limit(0)).count() == 0


def test_mixing_splits_rows_that_are_alike(spark):
    d = spark.createDataFrame([(1, "w " * 10, "a")] * 100 + [(i, "w w w", s) for i in range(2, 40) for s in ("b", "c")], "doc_id long, text string, source string")
    got = op10.mix(d).collect()
    assert len(got) == 176
    for name in "abc":
        mine = [x for x in got if x["source"] == name]
        assert abs(sum(x["size"] * x["copies"] for x in mine) - mine[0]["target"]) <= 5 and all(x["copies"] <= 2 for x in mine)


def test_mixing_reaches_targets_from_unequal_priors(spark):
    d = spark.createDataFrame([(i, "w " * 10, s, 0.5 if i % 2 else 4.0) for i in range(200) for s in ("a", "b")], "doc_id long, text string, source string, q double")
    got = op10.mix(d, weights=(3.0, 1.0), prior="q").collect()
    for name in "ab":
        mine = [x for x in got if x["source"] == name]
        assert abs(sum(x["size"] * x["copies"] for x in mine) - mine[0]["target"]) <= 10
        rates = {x["doc_id"] % 2: x["rate"] for x in mine}
        assert math.isclose(rates[0], min(2.0, 8 * rates[1]), rel_tol=1e-9)


def test_word_counts(spark):
    x = spark.createDataFrame([(" a\tb\n\nc ",), ("",), (None,), (" ",)], "t string")
    assert [r[0] for r in x.select(op10.words(F.col("t"))).collect()] == [3, 0, 0, 1]
