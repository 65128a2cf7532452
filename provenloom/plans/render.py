"""Notices rendered from the relational tables, so that recovered facts can be held against the columns they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import MONTHS
from ..operators.clients import Answer, Passing, Refused
from ..sources.documents import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def amount(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def spelled(c: Column, style: Column) -> Column:
    """12345.67 as '12 345,67', the same with no-break spaces, or '12.345,67'."""
    plain = F.format_number(c, 2)
    return F.when(style == 0, F.translate(plain, ",.", " ,")).when(style == 1, F.translate(plain, ",.", " ,")).otherwise(F.translate(plain, ",.", ".,"))


def in_words(c: Column) -> Column:
    return F.concat(F.dayofmonth(c).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(c)), F.lit(" "), F.year(c).cast("string"), F.lit(" года"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages (doc_id, page_no, text) for each order.

    Page 1 has a price whose label breaks over lines and whose amount is spelled out in brackets; page 2 a heading trap
    with a bid security before the contract security, two deadlines of which the nearer one counts, and a fine.
    """
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    price, style = amount("o_totalprice"), F.col("o_orderkey") % 3
    law = F.element_at(F.array(*map(F.lit, ("44-ФЗ", "223-ФЗ", "ГК РФ"))), (style + 1).cast("int"))
    first = F.concat(
        F.lit("Извещение о закупке № "), F.lpad(F.col("o_orderkey").cast("string"), 19, "0"), F.lit(" по "), law, F.lit(".\nНачальная (максимальная) цена\nконтракта: "),
        spelled(price, style), F.lit(" (сумма прописью) руб., в том числе НДС.\nЗаказчик: Учреждение номер "), F.col("o_custkey").cast("string"),
        F.lit(" города\nМесто поставки: склад\nСрок поставки товара: "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" дней. Далее по графику."),
    )
    second = F.concat(
        F.lit("Обеспечение исполнения контракта и обеспечение заявки. Обеспечение заявки: "), spelled(amount("o_totalprice") + 1, F.lit(0)),
        F.lit(" руб.\nРазмер обеспечения исполнения контракта: "), spelled(amount("o_totalprice") + 2, F.lit(0)),
        F.lit(" руб. Дата окончания подачи заявок: "), in_words(F.col("o_orderdate")), F.lit(", протокол "), F.date_format(F.date_add("o_orderdate", 9), "dd.MM.yyyy"),
        F.lit(". За нарушение поставщик платит штраф в размере "), spelled(amount("o_totalprice") + 3, F.lit(0)), F.lit(" руб. Участник закупки должен иметь опыт аналогичных поставок."),
    )
    both = F.array(F.struct(F.lit(1).alias("page_no"), first.alias("text")), F.struct(F.lit(2).alias("page_no"), second.alias("text")))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(both).alias("p")).select("doc_id", "p.*")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (doc_id, page_no, text) for each customer in three wordings: one price, none at all, and two that differ.

    The price is the absolute balance and 100; the deadline is in digits or words; a last page has fines in some.
    """
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name"), "c_custkey")
    k = F.col("c_custkey")
    price = (F.abs(amount("c_acctbal")) + 100).cast("decimal(18,2)")
    day = F.date_add(F.lit("2026-01-10").cast("date"), (k % 200).cast("int"))
    named = F.concat(F.lit("Предмет закупки: поставка бумаги партии "), k.cast("string"), F.lit("\nИНН 7700000000\nНаименование заказчика: Учреждение "), F.col("c_name"), F.lit("\nАдрес: город\nПроводится по 44-ФЗ.\n"))
    one = F.concat(F.lit("НМЦК: "), spelled(price, k % 3), F.lit(" рублей, НДС не облагается."))
    two = F.concat(one, F.lit("\nЦена контракта составляет "), spelled(price + 5, F.lit(0)), F.lit(" руб."))
    first = F.concat(named, F.when(k % 3 == 0, one).when(k % 3 == 1, F.lit("Цена не указана.")).otherwise(two))
    until = F.concat(F.lit("Окончание подачи заявок: "), F.when(k % 2 == 0, F.date_format(day, "dd.MM.yyyy")).otherwise(in_words(day)), F.lit(". Участник закупки должен иметь опыт аналогичных поставок не менее двух лет."))
    fines = F.lit("За просрочку поставщик уплачивает пени 1/300 ключевой ставки за день. За отказ заказчик платит штраф 5 000 руб. за каждый случай.")
    pages = F.array(F.struct(F.lit(1).alias("page_no"), first.alias("text")), F.struct(F.lit(2).alias("page_no"), until.alias("text")), F.struct(F.lit(3).alias("page_no"), fines.alias("text")))
    return c.select(k.alias("doc_id"), F.explode(F.slice(pages, F.lit(1), F.when(k % 4 == 0, 2).otherwise(3))).alias("p")).select("doc_id", "p.*")


class Scripted:
    """An extractor that answers by the number in its prompt, for tests and queries: some answers fail, pass, or don't fit."""

    def __init__(self) -> None:
        self.failed: set[int] = set()

    def answer(self, prompt: str) -> Answer:
        k = int(prompt.rsplit(" ", 1)[1])
        if k % 11 == 0:
            raise Refused("llm_refused")
        if k % 13 == 0 or (k % 7 == 0 and k not in self.failed):
            self.failed.add(k)
            raise Passing
        self.failed.discard(k)
        vat = "вероятно" if k % 5 == 0 else "включён"
        text = f'{{"law": "{"44-ФЗ" if k % 2 else "223-ФЗ"}", "price": {{"amount": {k}.5, "vat": "{vat}"}}}}'
        return Answer(f"```json\n{text}\n```" if k % 3 == 0 else text, len(prompt), len(text))

    def close(self) -> None:
        self.failed.clear()
