"""Verification of quotes case by case and against a plain version, and the steps from chunks to records."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenloom.operators import extract, merge, records, rules, verify
from provenloom.sources import documents as sources
from provenloom.streaming import ingest

PAGES = [
    (1, "Цена договора на ремонт здания составляет 7 315 420,50 (семь миллионов триста пятнадцать тысяч) рублей 50 копеек, включая НДС."),
    (2, "Работы ведутся со дня подписания по 18 декабря 2027 года. Стороны признают незаконность отказа по договору без письменного предупреждения."),
    (3, "За просрочку поставщик платит штраф в размере 4 (четырёх) процентов цены договора."),
    (4, "Гарантийный срок на результат работ длится 36 (тридцать шесть) месяцев с подписания акта."),
]
CASES = [
    ("word for word", "Цена договора на ремонт здания составляет 7 315 420,50", 1, "exact"),
    ("on another page", "штраф в размере 4 (четырёх) процентов цены договора", 1, "exact"),
    ("no page given", "Гарантийный срок на результат работ", None, "exact"),
    ("brackets left out", "Цена договора на ремонт здания составляет 7 315 420,50 рублей 50 копеек", 1, "fuzzy"),
    ("misread letters", "Гарантийный срок на резульат рабт длится 36 (тридцать шесть) месяцев", 4, "fuzzy"),
    ("no kopecks", "Цена договора на ремонт здания составляет 7 315 420", 1, "exact"),
    ("another amount", "Цена договора на ремонт здания составляет 9 999 999,00", 1, "mismatch"),
    ("one digit", "Цена договора на ремонт здания составляет 7 315 920,50", 1, "mismatch"),
    ("another month", "Работы ведутся со дня подписания по 18 ноября 2027 года", 2, "mismatch"),
    ("a word for a longer one that holds it", "Стороны признают закон отказа по договору без письменного предупреждения", 2, "mismatch"),
    ("an added end", "Гарантийный срок на результат работ длится 36 (тридцать шесть) месяцев, аванс запрещён", 4, "mismatch"),
    ("told in other words", "Исполнитель отвечает за качество три года", 4, "not_found"),
    ("of another document", "Оператор хранит персональные данные клиентов на территории страны", 1, "not_found"),
    ("too short", "Цена", 1, "not_found"),
]


@pytest.fixture(scope="module")
def checked(spark):
    pages = spark.createDataFrame([(1, n, t) for n, t in PAGES], "doc_id long, page_no int, text string")
    quotes = spark.createDataFrame([(1, i, q, p) for i, (_, q, p, _) in enumerate(CASES)], "doc_id long, quote_id long, quote string, page_no int")
    checks = verify.check(quotes, pages)
    return {r["quote_id"]: r for r in checks.collect()}, verify.counters(checks, quotes).first()


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_quote_matrix(checked, i):
    got = checked[0][i]
    assert got["method"] == CASES[i][3] and got["verified"] == (CASES[i][3] in ("exact", "fuzzy"))


def test_counters(checked):
    n = checked[1]
    methods = [c[3] for c in CASES]
    assert (n["total"], n["unverified"], n["mismatches"]) == (len(CASES), methods.count("mismatch") + methods.count("not_found"), methods.count("mismatch"))
    assert n["page_corrections"] == 2  # the one on another page and the one without a page


def test_words_are_compared_as_words():
    assert verify.words_supported(["закон"], "это закон") and not verify.words_supported(["закон"], "незаконность")
    assert verify.words_supported(["резульат"], "результат, работ") and not verify.words_supported(["ноября"], "18 декабря")
    assert not verify.words_supported(["слово"], "")
    for w in ("abcd", "abxd", "wxyz", "abcdef"):
        for t in ("abcd", "abce", "zzzz", "bcda"):
            assert verify.words_supported([w], t) == (w == t or SequenceMatcher(None, w, t, autojunk=False).ratio() >= 0.75)


def test_ties_go_to_the_least_value(spark):
    d = spark.createDataFrame([(1, "bb", 5), (1, "aa", 5), (1, "c", 1)], "k long, v string, o long")
    assert merge.vote_text(d, ["k"], "v", "o").first()["v"] == merge.first_longest(d, ["k"], "v", "o").first()["v"] == "aa"
    same = d.where("v <> 'c'")
    assert merge.merge_values(same, ["k"], "v", "o").first()["v"] == "aa"


def test_similar_equals_the_full_comparison():
    texts = ["наличие лицензии на работы", "наличие лицензии на работу", "наличие допуска", "", "x" * 50, "x" * 60, "совсем другое требование к участнику"]
    for a in texts:
        for b in texts:
            short, long = sorted((len(a), len(b)))
            full = a == b or short >= 40 and (a.startswith(b) or b.startswith(a)) or long - short <= 0.5 * long and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.86
            assert merge.similar(a, b) == full


def test_anchored_amounts_know_their_place(spark):
    t = "Цена контракта: по смете.\nЦена контракта: 12 500,00 руб. и обеспечение 3,00 руб. Цена контракта: обеспечение 900,00 руб."
    pages = spark.createDataFrame([(1, 1, t)], "doc_id long, page_no int, text string")
    got = rules.anchored_amounts(pages, ("цена контракта:",), ("обеспечен",)).collect()
    assert [(str(r["amount"]), r["pos"]) for r in got] == [("12500.00", 1), ("12500.00", t.index("Цена контракта: 12") + 1)]
    around = rules.money_contexts(pages).orderBy("pos").collect()
    assert [str(r["amount"]) for r in around] == ["12500.00", "3.00", "900.00"] and all(t[r["pos"] - 1 :].startswith(r["raw"]) and "\n" not in r["context"] for r in around)


def test_penalties_of_a_document_are_said_once(spark):
    s = "Поставщик платит штраф в размере {} за каждый день просрочки поставки товара по договору. "
    text = s.format("5 000,00 руб.") * 3 + "".join(s.format(f"{i} %").replace("Поставщик", f"Поставщик {i}") for i in range(20))
    got = rules.document_penalties(spark.createDataFrame([(1, 1, text)], "doc_id long, page_no int, text string")).orderBy("sentence_no").collect()
    assert len(got) == 12 and [r["sentence_no"] for r in got][:2] == [0, 3] and got[0]["party"] == "исполнитель"


def test_results_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "store")
    r = spark.createDataFrame([("k1-aa", '{"a":1}'), ("k1-aa", '{"a":1}'), ("k2-ab", '{"b":2}')], "key string, result string")
    sources.put(r, path)
    sources.put(r, path)
    assert sorted(x["key"] for x in spark.read.parquet(path).collect()) == ["k1-aa", "k2-ab"]


def test_pages_choose_text_and_scale(spark):
    d = spark.createDataFrame([("thin", "recognised text", 612.0, 792.0), ("x" * 200, "y" * 300, 20000.0, 20000.0), (None, "z", 1.0, 1.0)], "t string, o string, w double, h double")
    got = d.select(sources.choose_ocr(F.col("t"), F.col("o")).alias("c"), sources.safe_scale(F.col("w"), F.col("h")).alias("s")).collect()
    assert got[0]["c"] == "recognised text" and got[1]["c"] == "x" * 200
    assert got[0]["s"] == 220 / 72 and 20000 * got[1]["s"] * 20000 * got[1]["s"] <= sources.MAX_PIXELS * 1.001


def test_schema_is_strict_and_answers_are_held_to_it(spark):
    schema = T.StructType.fromDDL("a string, b struct<c:double>, d array<struct<e:boolean>>")
    assert extract.strict_schema(schema)["required"] == ["a", "b", "d"] and not extract.strict_schema(schema)["properties"]["b"]["additionalProperties"]
    chunks = spark.createDataFrame([(1, i) for i in range(5)], "doc_id long, chunk_no int")
    answers = ['{"a":"x","b":{"c":1},"d":[]}', '{"a":1,"b":{"c":1},"d":[]}', "no", None, '```json\n{"a":"x","b":{},"d":[{"e":1}]}\n```']
    given = spark.createDataFrame([(1, i, a, "timeout" if a is None else None) for i, a in enumerate(answers)], "doc_id long, chunk_no int, json string, error string")
    got = {r["chunk_no"]: r for r in extract.replay_strictly(chunks, given, schema).collect()}
    assert [got[i]["error"] for i in range(5)] == [None, "llm_response_invalid", "llm_response_invalid", "timeout", "llm_response_invalid"]
    assert got[1]["details"] == ["a: expected string"] and got[4]["details"] == ["b.c: missing", "d.0.e: expected boolean"] and got[0]["facts"]["a"] == "x"


def test_synthesis_falls_back_to_the_template(spark):
    x = spark.createDataFrame([(1, "t1", ["r"]), (2, "t2", []), (3, "t3", [])], "doc_id long, template string, risks array<string>")
    w = spark.createDataFrame([(1, "written", ["w"]), (2, None, None)], "doc_id long, summary string, risks array<string>")
    got = {r["doc_id"]: r for r in records.synthesis(x, w).collect()}
    assert (got[1]["summary"], got[1]["risks"], got[1]["warnings"]) == ("written", ["w"], [])
    assert got[2]["summary"] == "t2" and len(got[2]["warnings"]) == 1 and got[3]["summary"] == "t3" and got[3]["warnings"] == []


def test_stream_keeps_the_first_row_of_a_content(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 3}", "2026-01-01 00:00:00") for i in range(9)], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = ingest.deduplicated(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "at")
    ingest.run(stream, lambda b: b, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["text 0", "text 1", "text 2"]


def test_joins_of_what_grows_with_the_input_are_shuffled(spark):
    pages = spark.range(60).selectExpr("id as doc_id", "1 as page_no", "concat(repeat('the same words over and over ', 40), id) as text")
    claims = spark.range(60).selectExpr("id as doc_id", "'q' as quote_id", "concat('words over and over ', id) as quote", "2 as page_no")
    checks = verify.check(claims, pages)
    both = verify.counters(checks, claims)
    assert [(r["total"], r["unverified"], r["page_corrections"]) for r in both.where("doc_id < 2").collect()] == [(1, 0, 1)] * 2
    for x in (checks, both):
        assert "BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString()  # the files' bytes are few, whatever they hold
