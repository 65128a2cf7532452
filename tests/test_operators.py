"""Promises of the operators, case by case."""

import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenloom.functions import dates, numbers, text
from provenloom.operators import chunking, extract, merge, rules, verify
from provenloom.sources import documents as sources
from provenloom.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "value"),
    [("12 480 350,00", "12480350.00"), ("2 850 000", "2850000.00"), ("1.234.567,89", "1234567.89"), ("15.5", "15.50"), ("сумма", None)],
)
def test_parse_amount(spark, raw, value):
    assert one(spark, raw, numbers.parse_amount) == (Decimal(value) if value else None)


@pytest.mark.parametrize(
    ("raw", "value"),
    [("2026-09-15", (2026, 9, 15)), ("15.09.2026", (2026, 9, 15)), ("до 5 марта 2026 года", (2026, 3, 5)), ("32.13.2026", None), ("в течение 45 дней", None)],
)
def test_parse_date(spark, raw, value):
    assert one(spark, raw, dates.parse_date) == (datetime.date(*value) if value else None)


@pytest.mark.parametrize(("raw", "law"), [("по Закону № 44-ФЗ", "44-ФЗ"), ("в рамках 223 ФЗ", "223-ФЗ"), ("закон 144-ФЗ", "не определено"), ("223-ФЗ, 223-ФЗ и 44-ФЗ", "223-ФЗ")])
def test_law(spark, raw, law):
    assert one(spark, raw, rules.detect_law) == law


def test_page_text_joins_hyphenated_words(spark):
    assert one(spark, " при­мер пере-\r\nнос  слов \n\n\n\nконец ", text.normalize_page) == "пример перенос слов\n\nконец"


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")


def test_security_skips_the_bid_security(spark):
    found = rules.security(pages(spark, "Обеспечение исполнения контракта и обеспечение заявки: 100,00 руб.", "Размер обеспечения\nисполнения контракта: 500,00 (пятьсот) руб."))
    assert found.first()["amount"] == Decimal("500.00")


def test_price_anchor_order_beats_page_order(spark):
    found = rules.price(pages(spark, "НМЦК 5,00 руб.", "Начальная (максимальная) цена контракта 7,00 руб."))
    assert found.first()["amount"] == Decimal("7.00")


def test_nearest_deadline(spark):
    found = rules.anchored_date(pages(spark, "Дата окончания подачи заявок: 3 июля 2026 года, вскрытие 01.07.2026"))
    assert found.first()["value"] == datetime.date(2026, 7, 3)


def test_word_starts_matter_for_penalties(spark):
    assert rules.penalties(pages(spark, "Оштрафовать нельзя, и это предложение достаточно длинное.")).count() == 0


def test_chunks_hold_all_text_and_mark_pages(spark):
    x = chunking.chunks(pages(spark, "a" * 700, "  ", "b" * 700, "c" * 2500), 1000, 100, 100).orderBy("chunk_no").collect()
    whole = "".join(r["text"] for r in x)
    assert whole.count("[СТРАНИЦА 3]") >= 1 and whole.count("c") >= 2500 and all(r["pages"] == sorted(set(r["pages"])) for r in x)


def test_vote_tie_takes_the_longest(spark):
    x = spark.createDataFrame([(1, 1, "ab"), (1, 2, "abc"), (1, 3, " ")], "k int, o int, v string")
    assert merge.vote_text(x, ["k"], "v", "o").first()["v"] == "abc"


def test_greedy_dedupe_keeps_the_longer(spark):
    x = spark.createDataFrame([(1, 1, "Опыт выполнения аналогичных работ"), (1, 2, "Опыт выполнения аналогичных работ!"), (1, 3, "Лицензия")], "k int, o int, v string")
    assert [r["o"] for r in merge.fuzzy_dedupe(x, ["k"], "v", ["o"]).orderBy("kept_no").collect()] == [2, 3]


PAGE = "Цена контракта составляет 12 480 350,00 рублей, в том числе НДС 20 процентов. Срок выполнения работ до 20 декабря 2026 года."


@pytest.mark.parametrize(
    ("quote", "method"),
    [
        ("цена контракта составляет 12 480 350,00 рублей", "exact"), ("Цена контракта составляет 12 480 350,00 рублой", "fuzzy"), ("Цена контракта составляет 13 480 350,00 рублей", "mismatch"),
        ("Поставщик обязан застраховать весь груз", "not_found"), ("цена", "not_found"),
    ],
)
def test_quote_cascade(spark, quote, method):
    q = spark.createDataFrame([(1, 1, quote, 2)], "doc_id long, quote_id int, quote string, page_no int")
    assert verify.check(q, pages(spark, PAGE, "Другая страница")).first()["method"] == method


def test_payload_accepts_objects_only(spark):
    assert one(spark, '```json\n{"a": 1}\n```', extract.payload) == '{"a": 1}'
    assert one(spark, "[1, 2]", extract.payload) is None and one(spark, "nothing", extract.payload) is None


def test_corrupt_results_are_misses(spark):
    docs = sources.keyed(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string"), F.lit("p"), F.lit("m/1"))
    store = docs.select("key", F.when(F.col("text") == "a", "{}").otherwise("{broken").alias("result"))
    hits, misses = sources.plan_work(docs, store)
    assert [r["doc_id"] for r in hits.collect()] == [1] and misses.count() == 1


def test_admission(spark):
    x = spark.createDataFrame([("a.pdf", b" %PDF-1.7"), ("a.txt", b"%PDF-"), ("b.PDF", b"<html>"), ("c.pdf", b"")], "path string, content binary")
    got = [r["e"] for r in x.select(sources.admission_error(F.col("path"), F.col("content")).alias("e")).collect()]
    assert got == [None, "unsupported_file_type", "pdf_parse_error", "unsupported_file_type"]


def test_stream_equals_batch(spark, tmp_path):
    schema = "doc_id long, page_no int, text string"
    pages(spark, "НМЦК 5,00 руб.", "НМЦК 6,00 руб.").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    ingest.run(stream, rules.money_hits, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cents=st.integers(0, 10**13), style=st.integers(0, 2))
def test_amount_round_trip(spark, cents, style):
    from provenloom.plans.render import spelled

    value = Decimal(cents) / 100
    x = spark.createDataFrame([(value, style)], "v decimal(18,2), s int")
    assert x.select(numbers.parse_amount(spelled(F.col("v"), F.col("s"))).alias("x")).first()["x"] == value


def test_whole_documents_are_packed(spark, tmp_path):
    import hashlib

    from provenloom.plans.queries import QUERIES

    docs = {1: "a" * 400 + "\n" + "b" * 2500 + "\n\n" + "c" * 300, 2: "short\n \nlines", 3: "d" * 1000 + "\n" + "e" * 1001}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in docs.items():
        chunks, size = [], 0
        for page, line in enumerate(t.split("\n"), 1):
            for at in range(0, len(line) if line.strip() else 0, 1000):
                part = f"[СТРАНИЦА {page}]\n" + line[at : at + 1000]
                if not chunks or size + len(part) > 1000:
                    chunks.append([])
                    size = 0
                chunks[-1].append(part)
                size += len(part)
        expected += [(i, n, len(x), hashlib.md5(x.encode()).hexdigest()) for n, c in enumerate(chunks) for x in ["\n\n".join(c)]]
    got = QUERIES["chunk_pack_whole"](spark, str(tmp_path)).drop("pages").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    letters = sum(n for i, _, n, _ in expected if i == 1)
    assert letters > 3200


def test_similar_prefix_joins_on_beginnings(spark, tmp_path):
    from provenloom.plans.queries import QUERIES

    head = "the same forty characters at the beginning"
    t = [head, head + " and more", head + " and other", "Short", "short", "short one", None, "", "x" + head, head[:39], head[:40].upper()]
    rows = [(1, i, x) for i, x in enumerate(t)] + [(2, 0, head)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    # the query also holds each turn cut at 60 characters, as turn + 1000
    held = [(c, n, None if x is None else x.lower()) for c, i, x in rows for n, x in ((i, x), (i + 1000, x and x[:60]))]
    same = lambda a, b: a is not None and b is not None and (a == b or (min(len(a), len(b)) >= 40 and (a.startswith(b) or b.startswith(a))))
    expected = sorted((c, i, j) for c, i, a in held for k, j, b in held if c == k and i < j and same(a, b))
    x = QUERIES["similar_prefix"](spark, str(tmp_path))
    assert sorted(map(tuple, x.collect())) == expected and len(expected) > 3
    keys = next(line for line in x._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
    assert "conv_id" in keys and "head" in keys.split("], [")[0]


def test_fuzzy_dedupe_is_dealt_over_all_tasks(spark):
    rows = spark.createDataFrame([(k, i, f"text {k} {i}") for k in range(40) for i in range(3)], "k long, i int, text string")
    got = merge.fuzzy_dedupe(rows, ["k"], "text", ["i"])
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert got.select("k").distinct().count() == 40
