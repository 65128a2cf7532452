"""Empty tables, very long texts, repeated rows, null ids and ties, operator by operator; plain versions where there was none."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from provenloom.llm import op1_ordinal_toxicity as op1
from provenloom.llm import op4_line_spread as op4
from provenloom.llm import op6_language_evidence as op6
from provenloom.llm import op7_nn_descent as op7
from provenloom.llm import op9_ppm_scoring as op9
from provenloom.llm import op10_entropy_mixing as op10

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HUGE = "long word again " * 30_000


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


# --- 1


def test_scores_and_fit_of_the_ordinal_model_by_hand():
    model = op1.OrdinalModel({"vile": 0, "^vile": 1}, np.array([1.5, -0.25]), np.array([1.0, 2.5]))
    s = 1.5 * math.log1p(2)
    assert math.isclose(model.score("Vile, vile and fine"), s)
    p = [1 / (1 + math.exp(-(s - t))) for t in (1.0, 2.5)]
    assert np.allclose(model.exceed(np.array([s])), [p])
    # at the optimum no small step lowers the penalised likelihood
    r = np.random.default_rng(3)
    x, true = r.integers(0, 3, (300, 4)).astype(float), np.array([1.0, -1.0, 0.5, 0.0])
    grades = (x @ true + r.logistic(size=300) > 0.5).astype(int) + (x @ true + r.logistic(size=300) > 2.5)
    rows, cols = np.nonzero(x)
    w, t = op1.fit_cumulative_link(rows, cols, x[rows, cols], grades, 4, steps=4000)

    def loss(w, t):
        cut = np.concatenate([[-np.inf], t, [np.inf]])
        s = x @ w
        return -np.log(op1.sigmoid(cut[grades + 1] - s) - op1.sigmoid(cut[grades] - s)).sum() + op1.L2 * (w @ w) / 2

    least = loss(w, t)
    for k in range(4):
        for step in (-0.02, 0.02):
            assert loss(w + step * np.eye(4)[k], t) > least
    assert t[0] < t[1]


def test_a_doc_id_on_many_rows_is_learned_once(spark):
    rows = [(i, f"plain words {i}" + (" vile" * 3 if i % 2 else ""), "s") for i in range(40)] + [(1, "vile vile", "s")] * 200
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = op1.fit(docs(spark, *rows), labels, least_docs=1, least_gain=0.0)
    assert {"vile", "plain", "words"} <= set(model.vocabulary)
    got = {r["doc_id"]: r["toxic"] for r in op1.score(docs(spark, (1, "so vile", "s"), (2, "plain words", "s"), (3, HUGE, "s")), model).collect()}
    assert got == {1: True, 2: False, 3: False}


# --- 4


def test_lines_by_sites_counted_plainly(spark):
    r = random.Random(8)
    lines = [f"line {k}" for k in range(12)] + ["", " ", "\tline 3 "]
    rows = [(i % 50 if i % 7 else None, "\n".join(r.choice(lines) for _ in range(r.randint(1, 9))), r.choice([None, *"abcdefgh"])) for i in range(120)]
    rows += [rows[0], rows[0], (900, HUGE + "\nline 1\n" + "x\n" * 20_000, "z"), (901, None, "z"), (902, "", "z")]
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites[line.strip(" \t\r\x0b\x0c")].add(s)
    bad = {x for x, s in sites.items() if x and len(s) >= op4.SITES}
    want = []
    for i, t, _ in rows:
        cut = [] if t is None else t.split("\n")
        kept = [x for x in cut if x.strip(" \t\r\x0b\x0c") not in bad]
        want.append((i, None if t is None else "\n".join(kept), len(cut), len(cut) - len(kept)))
    d = docs(spark, *rows)
    assert bad and sorted(map(tuple, op4.clean(d).collect()), key=repr) == sorted(want, key=repr)
    assert op4.clean(d.limit(0)).count() == 0


# --- 6


def test_pages_alike_get_one_answer_each(spark):
    english, german = "the of and to in that is was he for it with as his on be at by had not " * 20, "der die und den von zu mit sich des auf für ist nicht ein als auch es an werden aus " * 20
    d = spark.createDataFrame([(i, (german if i % 2 else english), "de" if i % 2 else "en", "s", 0) for i in range(20)], DOCS)
    langs, model = op6.fit(d)
    rows = [(1, "http://a.example/", f"<p>{english}</p>")] * 3 + [(2, "http://b.example/", f"<html lang=de><p>{german * 60}</p>"), (None, None, None), (4, "http://a.example/", "<p>" * 50_000)]
    got = op6.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), langs, model).collect()
    assert len(got) == len(rows)
    answers = [r.asDict() for r in got]
    same = [a for a in answers if a["page_id"] == 1]
    assert len(same) == 3 and same[0] == same[1] == same[2] and "en" in same[0].values()
    assert "de" in next(a for a in answers if a["page_id"] == 2).values()


# --- 7, 9, 10


def test_no_vectors_no_neighbours(spark):
    none = op7.usable(spark.createDataFrame([(0, None), (20, [0.0, 0.0])], "vec_id long, embedding array<double>"))
    assert op7.search(none.where("id % 20 = 0").select("id"), op7.build(none), none, 20).count() == 0


def test_long_texts_and_null_ids_are_scored(spark):
    rows = [(None, "a text of no id", "s"), (None, None, "s"), (5, HUGE, "s"), (6, "short words again", "s"), (6, "short words again", "s")]
    got = op9.score(docs(spark, *rows)).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 2, 5: 1, 6: 2}
    long = next(r for r in got if r["doc_id"] == 5)
    assert long["n_tokens"] == 90_001 and long["score"] < 0
    assert len({tuple(r) for r in got if r["doc_id"] == 6}) == 1


@pytest.mark.parametrize("prior", [None, 0.5])
def test_long_texts_are_mixed_whole(spark, prior):
    rows = [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(60)] + [(100, HUGE, "c"), (101, None, None), (102, "", "c")]
    kwargs = {} if prior is None else {"prior": prior_column(prior)}
    got = op10.mix(docs(spark, *rows), **kwargs).collect()
    assert {r["doc_id"]: r["size"] for r in got}[100] == 90_000 and all(r["copies"] <= 2 for r in got)
    assert op10.mix(docs(spark, *rows).limit(0)).count() == 0


def prior_column(low):
    from pyspark.sql import functions as F

    return F.when(F.col("doc_id") < 10, low).otherwise(1.0)


# --- the pipeline


def written(spark, folder, rows):
    docs(spark, *rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_the_pipeline_on_no_documents(spark, tmp_path):
    written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_on_long_texts_without_labels_or_items(spark, tmp_path):
    other = " ".join(f"w{k}" for k in range(50_000))
    written(spark, tmp_path, [(1, HUGE, "a"), (2, HUGE, "b"), (3, other, "a"), (4, other + " end", "a"), (5, None, None)])
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept <= {1, 3, 5} and {1, 3} & kept
