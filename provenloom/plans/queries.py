"""Queries over the given tables and the SQL that says the same.

Some render notices from orders and recover the facts, so that the SQL reads them from the columns; the others apply an
operator to the given texts and rows. Results are flat; arrays are joined into strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numbers, text
from ..functions import vocab as V
from ..operators import assemble, chunking, clients, extract, merge, records, rules, verify
from ..sources import documents as sources
from ..sources.store import register
from ..streaming import assembly, ingest
from .render import Scripted, amount, in_words, notices, spelled, table, tenders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    few = docs.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism
    return sources.text_pages(sources.spread(docs, "doc_id") if few else docs)


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS page_no FROM documents)"


# --- numbers and dates


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS amount FROM orders")
def money_roundtrip(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Цена: "), spelled(amount("o_totalprice"), F.col("o_orderkey") % 3), F.lit(" (прописью) рублей"))
    return table(s, d, "orders").select("o_orderkey", numbers.first_money(t)[0]["amount"].cast("decimal(18,2)").alias("amount"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS amount, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def amount_spellings(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.parse_amount(spelled(amount("l_extendedprice"), F.col("l_linenumber") % 3)).cast("decimal(18,2)").alias("amount"))
    return x.groupBy("l_orderkey", "l_linenumber", "amount").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE AS value FROM orders")
def date_roundtrip(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(in_words(F.col("o_orderdate")))
    return table(s, d, "orders").select("o_orderkey", dates.parse_date(F.concat(F.lit("до "), t)).alias("value"))


@query("SELECT o_orderkey, try_strptime((day(o_orderdate) + 20) || '.' || month(o_orderdate) || '.' || year(o_orderdate), '%-d.%-m.%Y')::DATE AS value FROM orders")
def invalid_dates(s: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(".", (F.dayofmonth("o_orderdate") + 20).cast("string"), F.month("o_orderdate").cast("string"), F.year("o_orderdate").cast("string"))
    return table(s, d, "orders").select("o_orderkey", dates.from_digits(t).alias("value"))


@query("SELECT o_orderkey, 2::BIGINT AS n_dates, o_orderdate::DATE AS in_words, (o_orderdate::DATE + 9) AS in_digits FROM orders")
def date_hits(s: SparkSession, d: str) -> DataFrame:
    x = rules.date_hits(notices(s, d)).groupBy(F.col("doc_id").alias("o_orderkey"))
    return x.agg(F.count("*").alias("n_dates"), F.max(F.when(F.col("hit_no") == 1, F.col("value"))).alias("in_words"), F.max(F.when(F.col("hit_no") == 0, F.col("value"))).alias("in_digits"))


@query("SELECT o_orderkey, 4::BIGINT AS n_amounts, (o_totalprice::DECIMAL(18,2) + 3)::DECIMAL(18,2) AS largest FROM orders")
def money_hits(s: SparkSession, d: str) -> DataFrame:
    x = rules.money_hits(notices(s, d)).groupBy(F.col("doc_id").alias("o_orderkey"))
    return x.agg(F.count("*").alias("n_amounts"), F.max("amount").cast("decimal(18,2)").alias("largest"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice::DECIMAL(18,2) END AS amount FROM orders")
def raw_amounts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", numbers.to_decimal(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))).cast("decimal(18,2)").alias("amount"))


# --- anchored facts


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS price FROM orders")
def anchored_price(s: SparkSession, d: str) -> DataFrame:
    return rules.price(notices(s, d)).select(F.col("doc_id").alias("o_orderkey"), F.col("amount").cast("decimal(18,2)").alias("price"))


@query("SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) + 2)::DECIMAL(18,2) AS security FROM orders")
def anchored_security(s: SparkSession, d: str) -> DataFrame:
    return rules.security(notices(s, d)).select(F.col("doc_id").alias("o_orderkey"), F.col("amount").cast("decimal(18,2)").alias("security"))


@query("SELECT o_orderkey, o_orderdate::DATE AS deadline FROM orders")
def anchored_deadline(s: SparkSession, d: str) -> DataFrame:
    return rules.anchored_date(notices(s, d)).select(F.col("doc_id").alias("o_orderkey"), F.col("value").alias("deadline"))


@query("""SELECT l_orderkey, count(DISTINCT l_extendedprice::DECIMAL(18,2))::BIGINT AS n,
  string_agg(DISTINCT (l_extendedprice::DECIMAL(18,2))::VARCHAR, '; ' ORDER BY (l_extendedprice::DECIMAL(18,2))::VARCHAR) AS listed FROM lineitem GROUP BY l_orderkey""")
def price_candidates(s: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("Цена контракта составляет "), spelled(amount("l_extendedprice"), F.lit(0)), F.lit(" руб."))
    sold = sources.spread(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    found = rules.price_candidates(sold.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), page.alias("text")))
    listed = F.array_join(F.array_sort(F.transform("amounts", lambda a: a.cast("decimal(18,2)").cast("string"))), "; ")
    return found.select(F.col("doc_id").alias("l_orderkey"), F.size("amounts").cast("long").alias("n"), listed.alias("listed"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '44-ФЗ' WHEN 1 THEN '223-ФЗ' ELSE 'не определено' END AS law, lpad(o_orderkey::VARCHAR, 19, '0') AS number, 'включён' AS vat FROM orders")
def law_and_number(s: SparkSession, d: str) -> DataFrame:
    x = extract.offline(notices(s, d))
    return x.select(F.col("doc_id").alias("o_orderkey"), "law", F.col("procurement_number").alias("number"), "vat")


@query("SELECT o_orderkey, 'Учреждение номер ' || o_custkey || ' города' AS customer, 'Срок поставки товара: ' || (o_orderkey % 90 + 1) || ' дней.' AS duration FROM orders")
def labels_and_terms(s: SparkSession, d: str) -> DataFrame:
    x = notices(s, d)
    both = rules.label_value(x, V.CUSTOMER_ANCHORS).withColumnRenamed("value", "customer").join(rules.duration_text(x).withColumnRenamed("value", "duration"), "doc_id")
    return both.select(F.col("doc_id").alias("o_orderkey"), "customer", "duration")


@query("""SELECT o_orderkey, 'штраф' AS kind, 'исполнитель' AS party, replace(replace(replace(format('{:,.2f}', (o_totalprice::DECIMAL(18,2) + 3)::DOUBLE), ',', ' '), '.', ','), ' ', ' ') || ' руб.' AS amount_text FROM orders""")
def penalty_facts(s: SparkSession, d: str) -> DataFrame:
    return rules.penalties(notices(s, d)).select(F.col("doc_id").alias("o_orderkey"), "kind", "party", "amount_text")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'штраф' WHEN 1 THEN 'пеня' WHEN 2 THEN 'пеня' ELSE 'штраф' END AS kind,
  CASE l_linenumber % 4 WHEN 0 THEN 'исполнитель' WHEN 1 THEN 'заказчик' WHEN 2 THEN 'обе стороны' ELSE 'не указано' END AS party, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def penalty_kinds(s: SparkSession, d: str) -> DataFrame:
    texts = ("Подрядчик платит штраф", "Заказчик уплачивает пени за просрочку", "Поставщик и заказчик платят 1/300 ключевой ставки", "Неустойка взимается сразу")
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", rules.classify_penalty(t).alias("kind"), rules.party(t).alias("party"))
    return x.groupBy("l_orderkey", "l_linenumber", "kind", "party").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'лицензии и допуски' WHEN 1 THEN 'опыт' WHEN 2 THEN 'квалификация персонала' WHEN 3 THEN 'материально-техническая база'
  WHEN 4 THEN 'финансовые гарантии' WHEN 5 THEN 'требования к товару или работам' ELSE 'прочее' END AS category, p_partkey % 2 = 0 AS mandatory FROM part""")
def requirement_categories(s: SparkSession, d: str) -> DataFrame:
    texts = ("лицензия на работы", "опыт работ", "специалисты с дипломом", "оборудование и машины", "банковская гарантия", "товар по гост", "иное условие")
    t = F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 7 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" рекомендуется"))
    return table(s, d, "part").select("p_partkey", rules.categorize(t).alias("category"), rules.mandatory(t).alias("mandatory"))


@query("SELECT o_orderkey, 1::BIGINT AS n, 'опыт' AS category FROM orders")
def requirements_found(s: SparkSession, d: str) -> DataFrame:
    return rules.requirements(notices(s, d)).groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("category").alias("category"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'договор: 1/300 ставки' END AS calculation, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE (o_orderkey % 50) || '%' END AS amount_text FROM orders""")
def penalty_formula(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 2 == 0, "договор: 1/300  ставки").otherwise(F.concat(F.lit("договор: "), (F.col("o_orderkey") % 50).cast("string"), F.lit("% цены")))
    return table(s, d, "orders").select("o_orderkey", rules.calculation(t).alias("calculation"), numbers.amount_text(t).alias("amount_text"))


# --- text


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(173), ''),
  '([\p{L}\p{N}\p{M}_])[-‐‑][\s]*\n[\s]*([\p{L}\p{N}\p{M}_])', '\1\2', 'g'), '[ \t\x{00A0}\x{202F}]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM documents""")
def normalize_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.normalize_page(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(replace(translate(text, '«»“”„‟‘’‚–—‐‑−ёЁ', repeat(chr(34), 6) || repeat(chr(39), 3) || '-----еЕ'), chr(173), '')), '\s+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '«Ёлка»—‘x’ ' || text ELSE text END AS text FROM documents)""")
def normalize_quotes(s: SparkSession, d: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("«Ёлка»—‘x’ "), F.col("text"))).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", text.normalize_quote(marked).alias("norm"))


@query(r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d[\d .,]*\d|\d')) AS m FROM documents), t AS (SELECT doc_id, regexp_replace(m, '\D', '', 'g') AS token FROM f)
  SELECT DISTINCT doc_id, token FROM t WHERE length(token) >= 3""")
def digit_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.explode(text.digit_tokens(F.col("text"))).alias("token"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(10), ' '), '([.;])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x FROM documents)
  SELECT doc_id, count(*)::BIGINT AS n, max(length(trim(regexp_replace(x, '\s+', ' ', 'g'))))::BIGINT AS longest FROM p WHERE trim(x) <> '' GROUP BY doc_id""")
def sentence_split(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"), V.SENTENCE_END_LATIN)).alias("x"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("x")).cast("long").alias("longest"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_./-]+')) AS w FROM documents)
  SELECT doc_id, count(*)::BIGINT AS n FROM w WHERE CASE WHEN regexp_matches(w, '[0-9]') THEN length(w) >= 3 ELSE length(w) >= 4 END GROUP BY doc_id""")
def significant_words(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", F.size(text.significant_words(F.col("text"))).cast("long").alias("n"))
    return x.where("n > 0")


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents), h AS (SELECT *, left(t, 200) AS h FROM s),
  p AS (SELECT *, 200 - instr(reverse(h), ' ') AS apos, instr(reverse(h), ' ') AS sp FROM h)
  SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(CASE WHEN sp > 0 AND apos > 100 THEN left(h, apos) ELSE h END, '[ ,;:-]+$', '') || '…' END AS short FROM p""")
def cut_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.cut(F.col("text"), 200).alias("short"))


@query("""SELECT o_orderkey, replace(replace(format('{:,.2f}', o_totalprice::DECIMAL(18,2)::DOUBLE), ',', ' '), '.', ',') || ' руб.' AS money FROM orders""")
def money_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", text.money_text(amount("o_totalprice")).alias("money"))


# --- pages, limits, chunks


@query(f"WITH {LINES} SELECT doc_id, page_no, text, CASE WHEN trim(text) <> '' THEN 'text_layer' ELSE 'empty' END AS source FROM l")
def page_rows(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d)


@query(f"""WITH {LINES} SELECT doc_id, count(*)::BIGINT AS pages, sum(length(text))::BIGINT AS chars, CASE WHEN bool_or(trim(text) <> '') THEN 'text_layer' ELSE 'empty' END AS source_summary FROM l GROUP BY doc_id""")
def document_stats(s: SparkSession, d: str) -> DataFrame:
    return sources.document_stats(lines(s, d)).drop("ocr_pages")


@query(f"""WITH {LINES}, r AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_no) AS total FROM l)
  SELECT doc_id, count(*)::BIGINT AS pages, sum(length(text))::BIGINT AS chars, min(CASE WHEN total > 2000 THEN page_no END) AS first_over,
  CASE WHEN count(*) > 20 OR max(total) > 2000 THEN 'document_too_long' WHEN sum(length(text)) = 0 THEN 'empty_document' END AS error FROM r GROUP BY doc_id""")
def document_limits(s: SparkSession, d: str) -> DataFrame:
    return sources.limits(lines(s, d), 20, 2000)


@query(f"""WITH RECURSIVE {LINES}, cut AS (SELECT doc_id, page_no, text, unnest(range(0, greatest(length(text), 1), 1000)) AS off FROM l WHERE trim(text) <> ''),
  b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, off) AS i, least(length(text) - off, 1000) + length('[СТРАНИЦА ' || page_no || ']') + 1 AS n FROM cut),
  f AS (SELECT doc_id, i, 0 AS chunk, n AS size FROM b WHERE i = 1 UNION ALL
        SELECT b.doc_id, b.i, CASE WHEN f.size + b.n > 1000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size + b.n > 1000 THEN b.n ELSE f.size + b.n END FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1)
  SELECT doc_id, chunk AS chunk_no, (sum(n) + 2 * (count(*) - 1))::BIGINT AS n_chars FROM (SELECT f.doc_id, f.chunk, b.n FROM f JOIN b ON f.doc_id = b.doc_id AND f.i = b.i) GROUP BY ALL""")
def chunk_pack(s: SparkSession, d: str) -> DataFrame:
    x = chunking.chunks(lines(s, d), 1000, 0, 1_000_000)
    return x.select("doc_id", F.col("chunk_no"), F.length("text").cast("long").alias("n_chars"))


def packed_sql(limit: int, overlap: int) -> str:
    """The fold over the blocks of lines as a recursive query: f (doc_id, i, page_no, block, chunk, text, size, pages) has a row for each block."""
    return f"""WITH RECURSIVE {LINES}, cut AS (SELECT doc_id, page_no, text, unnest(range(0, greatest(length(text), 1), {limit})) AS off FROM l WHERE trim(text) <> ''),
  b AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, off) AS i, '[СТРАНИЦА ' || page_no || ']' || chr(10) || substr(text, off + 1, {limit}) AS block FROM cut),
  e AS (SELECT *, substr(block, strpos(block, chr(10)) + 1) AS body, right(substr(block, strpos(block, chr(10)) + 1), {overlap}) AS t FROM b),
  v AS (SELECT doc_id, i, page_no, block, CASE WHEN {overlap} = 0 THEN '' WHEN length(body) <= {overlap} THEN block ELSE split_part(block, chr(10), 1) || chr(10) || '(продолжение предыдущего фрагмента)' || chr(10)
    || CASE WHEN strpos(t, '. ') BETWEEN 1 AND {overlap // 2} THEN substr(t, strpos(t, '. ') + 2) ELSE t END END AS tail FROM e),
  f AS (SELECT doc_id, i, page_no, tail, 0 AS chunk, block AS text, length(block) AS size, [page_no] AS pages FROM v WHERE i = 1 UNION ALL
    SELECT v.doc_id, v.i, v.page_no, v.tail, CASE WHEN f.size + length(v.block) > {limit} THEN f.chunk + 1 ELSE f.chunk END,
      CASE WHEN f.size + length(v.block) <= {limit} THEN f.text || chr(10) || chr(10) || v.block WHEN f.tail = '' THEN v.block ELSE f.tail || chr(10) || chr(10) || v.block END,
      CASE WHEN f.size + length(v.block) > {limit} THEN length(f.tail) ELSE f.size END + length(v.block),
      CASE WHEN f.size + length(v.block) <= {limit} THEN list_append(f.pages, v.page_no) WHEN f.tail = '' THEN [v.page_no] ELSE [f.page_no, v.page_no] END
    FROM f JOIN v ON v.doc_id = f.doc_id AND v.i = f.i + 1),
  c AS (SELECT doc_id, chunk AS chunk_no, arg_max(text, i) AS text, arg_max(pages, i) AS p FROM f GROUP BY ALL),
  d AS (SELECT doc_id, chunk_no, text, CASE WHEN list_min(p) = list_max(p) THEN list_min(p)::VARCHAR ELSE list_min(p) || '–' || list_max(p) END AS pages, max(chunk_no) OVER (PARTITION BY doc_id) + 1 AS n FROM c)"""


@query(packed_sql(1000, 0) + " SELECT doc_id, chunk_no, length(text)::BIGINT AS n_chars, md5(text) AS md5, pages FROM d")
def chunk_pack_whole(s: SparkSession, d: str) -> DataFrame:
    """chunk_pack with what the chunks hold and the pages that they come from."""
    x = chunking.chunks(lines(s, d), 1000, 0, 1_000_000)
    return x.select("doc_id", "chunk_no", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"), text.pages_label(F.col("pages")).alias("pages"))


@query(packed_sql(2000, 200) + " SELECT doc_id, chunk_no, text, pages, greatest(n - 12, 0)::INTEGER AS dropped FROM d WHERE chunk_no < 12")
def chunk_overlap(s: SparkSession, d: str) -> DataFrame:
    x = chunking.chunks(lines(s, d), 2000, 200, 12)
    return x.select("doc_id", "chunk_no", "text", text.pages_label(F.col("pages")).alias("pages"), "dropped")


# --- merge


@query("""WITH v AS (SELECT conv_id, trim(role) AS role, turn FROM conversations WHERE trim(role) <> ''), c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM v GROUP BY ALL)
  SELECT conv_id, arg_min(role, (-n, -length(role), f, role)) AS role, max(n)::BIGINT AS votes FROM c GROUP BY conv_id""")
def vote_text(s: SparkSession, d: str) -> DataFrame:
    return merge.vote_text(table(s, d, "conversations"), ["conv_id"], "role", "turn")


@query("SELECT conv_id, arg_min(text, (-length(text), turn, text)) AS text FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id")
def first_longest(s: SparkSession, d: str) -> DataFrame:
    return merge.first_longest(table(s, d, "conversations"), ["conv_id"], "text", "turn")


@query("""WITH c AS (SELECT l_orderkey, l_quantity::DECIMAL(18,2) AS v, count(*) AS n, min(round(l_extendedprice * 100)::BIGINT) AS f FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, arg_min(v, (-n, f, v)) AS amount, count(*)::BIGINT AS n_distinct, string_agg(v::VARCHAR, '; ' ORDER BY v) AS listed FROM c GROUP BY l_orderkey""")
def merge_money(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select("l_orderkey", amount("l_quantity").alias("amount"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("ord"))
    x = merge.merge_values(x, ["l_orderkey"], "amount", "ord")
    return x.select("l_orderkey", "amount", "n_distinct", F.array_join(F.transform("listed", lambda a: a.cast("string")), "; ").alias("listed"))


@query("""WITH c AS (SELECT l_orderkey, l_shipdate::DATE AS v, count(*) AS n, min(l_partkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, arg_min(v, (-n, f, v)) AS value, count(*)::BIGINT AS n_distinct, string_agg(v::VARCHAR, '; ' ORDER BY v) AS listed FROM c GROUP BY l_orderkey""")
def merge_dates(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("value"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"))
    x = merge.merge_values(x, ["l_orderkey"], "value", "ord")
    return x.select("l_orderkey", "value", "n_distinct", F.array_join(F.transform("listed", lambda a: a.cast("string")), "; ").alias("listed"))


@query("""WITH k AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source, lower(text)[:70] ORDER BY doc_id) AS n FROM documents),
  r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM k WHERE n = 1) SELECT source, doc_id FROM r WHERE n <= 15""")
def first_by_key(s: SparkSession, d: str) -> DataFrame:
    return rules.first_by_key(table(s, d, "documents"), ["source"], "text", ["doc_id"], 15).select("source", "doc_id")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dedupe(s: SparkSession, d: str) -> DataFrame:
    return sources.keyed(table(s, d, "documents"), F.lit("offline"), F.lit("rules")).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query()
def fuzzy_dedupe(s: SparkSession, d: str) -> DataFrame:
    return merge.fuzzy_dedupe(table(s, d, "conversations"), ["conv_id"], "text", ["turn"]).select("conv_id", "kept_no", "turn")


@query("""WITH n AS (SELECT conv_id, turn, lower(text) AS t FROM conversations UNION ALL SELECT conv_id, turn + 1000, lower(left(text, 60)) FROM conversations)
  SELECT a.conv_id, a.turn AS first_turn, b.turn AS second_turn FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn < b.turn
  AND (a.t = b.t OR (least(length(a.t), length(b.t)) >= 40 AND (starts_with(a.t, b.t) OR starts_with(b.t, a.t))))""")
def similar_prefix(s: SparkSession, d: str) -> DataFrame:
    """Turns, and turns cut at 60 characters as chunks cut them, that stand for each other."""
    c = table(s, d, "conversations")
    n = c.select("conv_id", "turn", F.lower("text").alias("t")).unionByName(c.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lower(F.left("text", F.lit(60))).alias("t")))
    n = n.withColumn("head", F.left("t", F.lit(merge.PREFIX)))  # equal in every pair that passes
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.turn") < F.col("b.turn")) & merge.same_by_prefix(F.col("a.t"), F.col("b.t"))
    return a.join(b, on).select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("first_turn"), F.col("b.turn").alias("second_turn"))


# --- verification


def passages(s: SparkSession, d: str) -> DataFrame:
    """Quotes (doc_id, quote_id, quote, page_no): the whole text of each turn, claimed one page too far."""
    c = table(s, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("quote_id"), F.col("text").alias("quote"), (F.col("turn") + 1).cast("int").alias("page_no"))


def turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "text")


NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
QUOTES = f"q AS (SELECT conv_id AS doc_id, turn AS quote_id, (turn + 1)::INTEGER AS claimed, {NORM.format('text')} AS needle FROM conversations), p AS (SELECT conv_id AS doc_id, turn::INTEGER AS page_no, {NORM.format('text')} AS norm FROM conversations)"


@query(f"""WITH {QUOTES} SELECT q.doc_id, q.quote_id, arg_min(p.page_no, (p.page_no <> q.claimed, p.page_no)) AS found_page FROM q JOIN p ON q.doc_id = p.doc_id AND contains(p.norm, q.needle)
  WHERE length(q.needle) >= 8 GROUP BY q.doc_id, q.quote_id""")
def quote_exact(s: SparkSession, d: str) -> DataFrame:
    return verify.exact(passages(s, d).distinct(), turns(s, d))


@query(f"""WITH {QUOTES}, f AS (SELECT q.doc_id, q.quote_id, any_value(q.claimed) AS claimed, arg_min(p.page_no, (p.page_no <> q.claimed, p.page_no)) AS page FROM q JOIN p ON q.doc_id = p.doc_id AND contains(p.norm, q.needle)
  WHERE length(q.needle) >= 8 GROUP BY q.doc_id, q.quote_id) SELECT doc_id, count(*)::BIGINT AS found, count(*) FILTER (WHERE page <> claimed)::BIGINT AS page_fixes FROM f GROUP BY doc_id""")
def quote_page_fixes(s: SparkSession, d: str) -> DataFrame:
    q = passages(s, d)
    x = verify.exact(q, turns(s, d)).join(q.select("doc_id", "quote_id", "page_no"), ["doc_id", "quote_id"])
    return x.groupBy("doc_id").agg(F.count("*").alias("found"), F.count_if(F.col("found_page") != F.col("page_no")).alias("page_fixes"))


@query()
def quote_check(s: SparkSession, d: str) -> DataFrame:
    """Quotes whose letters are partly mistaken (every 'th' read as 'ht' in odd turns), by the whole cascade."""
    q = passages(s, d).withColumn("quote", F.when(F.col("quote_id") % 2 == 1, F.regexp_replace("quote", "th", "ht")).otherwise(F.col("quote")))
    return verify.check(q, turns(s, d)).select("doc_id", "quote_id", "method", "verified", "page_no", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT o_orderkey, [o_custkey::VARCHAR, (o_orderkey * 10)::VARCHAR] AS q, [(o_orderkey * 100)::VARCHAR, (o_custkey % 100)::VARCHAR] AS p FROM orders)
  SELECT o_orderkey, list_bool_and(list_transform(q, lambda x: list_bool_or(list_transform(p, lambda y: contains(y, x) OR contains(x, y))))) AS supported FROM a""")
def quote_numbers(s: SparkSession, d: str) -> DataFrame:
    st = lambda c: c.cast("string")
    q = F.array(st(F.col("o_custkey")), st(F.col("o_orderkey") * 10))
    p = F.array(st(F.col("o_orderkey") * 100), st(F.col("o_custkey") % 100))
    return table(s, d, "orders").select("o_orderkey", verify.numbers_supported(q, p).alias("supported"))


# --- assembly


@query("""WITH t AS (SELECT l_orderkey, sum((l_extendedprice * (1 + l_tax) * (1 - l_discount))::DECIMAL(18,2)) AS total, list(l_extendedprice::DECIMAL(18,2)) AS parts FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey, abs(o_totalprice::DECIMAL(18,2) - total) > 0.01 AS disagrees, coalesce(list_bool_or(list_transform(parts, lambda x: abs(x - o_totalprice::DECIMAL(18,2)) <= 0.01)), false) AS confirmed
  FROM orders JOIN t ON o_orderkey = l_orderkey""")
def price_agreement(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(amount(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount")))).alias("total"), F.collect_list(amount("l_extendedprice")).alias("parts")
    )
    x = table(s, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select("o_orderkey", (~numbers.within(amount("o_totalprice"), F.col("total"))).alias("disagrees"), assemble.confirmed(amount("o_totalprice"), F.col("parts")).alias("confirmed"))


FLAGS = """f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(38,2) END AS price, o_orderkey % 3 = 0 AS ok, o_orderkey % 5 = 0 AS failed, o_orderkey % 4 <> 0 AS dates,
  o_orderkey % 6 AS req, o_orderkey % 2 AS pen, o_orderkey % 11 AS quotes, o_orderkey % 3 AS bad, CASE WHEN o_orderkey % 8 = 0 THEN (o_totalprice + 1)::DECIMAL(38,2) WHEN o_orderkey % 8 < 5 THEN o_totalprice::DECIMAL(38,2) END AS rule,
  o_orderkey % 3 AS cand, o_orderkey % 5 AS conflicts, o_orderkey % 9 AS ocr, o_orderkey % 10 = 0 AS offline FROM orders)"""


def _flags(s: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(s, d, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, p.cast("decimal(38,2)")).alias("price"), (k % 3 == 0).alias("ok"), (k % 5 == 0).alias("failed"), (k % 4 != 0).alias("dates"), (k % 6).alias("req"), (k % 2).alias("pen"),
        (k % 11).alias("quotes"), (k % 3).alias("bad"), F.when(k % 8 == 0, (p + 1).cast("decimal(38,2)")).when(k % 8 < 5, p.cast("decimal(38,2)")).alias("rule"), (k % 3).alias("cand"), (k % 5).alias("conflicts"),
        (k % 9).alias("ocr"), (k % 10 == 0).alias("offline"),
    )


@query(f"""WITH {FLAGS}, c AS (SELECT k, offline, 1.0 - CASE WHEN price IS NULL THEN 0.25 ELSE 0 END - CASE WHEN price IS NOT NULL AND NOT ok THEN 0.10 ELSE 0 END - CASE WHEN price IS NOT NULL AND failed THEN 0.10 ELSE 0 END
  - CASE WHEN NOT dates THEN 0.15 ELSE 0 END - CASE WHEN req = 0 THEN 0.10 ELSE 0 END - CASE WHEN pen = 0 THEN 0.10 ELSE 0 END - CASE WHEN price IS NOT NULL AND rule IS NOT NULL AND abs(price - rule) > 0.01 THEN 0.30 ELSE 0 END
  - CASE WHEN cand > 1 THEN 0.10 ELSE 0 END - least(0.15, 0.05 * conflicts) - CASE WHEN ocr > 0 THEN 0.05 ELSE 0 END AS c FROM f),
  z AS (SELECT k, greatest(0.0, least(1.0, CASE WHEN offline THEN least(c, 0.6) ELSE c END))::DOUBLE AS confidence FROM c)
  SELECT k AS o_orderkey, round(confidence, 2) AS confidence, CASE WHEN round(confidence, 2) >= 0.8 THEN 'ok' WHEN round(confidence, 2) >= 0.55 THEN 'warn' ELSE 'bad' END AS band FROM z""")
def confidence(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = _flags(s, d).withColumn(
        "confidence", assemble.confidence(c("price"), c("ok"), c("failed"), c("dates"), c("req"), c("pen"), F.lit(0), F.lit(0), c("rule"), c("cand"), c("conflicts"), c("ocr"), c("offline"))
    )
    return x.select("o_orderkey", "confidence", assemble.band(c("confidence")).alias("band"))


@query(f"""WITH {FLAGS} SELECT k AS o_orderkey, concat_ws(',', CASE WHEN price IS NULL THEN 'price_missing' END, CASE WHEN price IS NOT NULL AND NOT ok THEN 'price_unconfirmed' END,
  CASE WHEN price IS NOT NULL AND rule IS NOT NULL AND abs(price - rule) > 0.01 THEN 'price_disagrees' END, CASE WHEN rule IS NOT NULL AND NOT failed THEN 'security_unconfirmed' END, CASE WHEN req = 0 THEN 'no_requirements' END,
  CASE WHEN pen = 0 THEN 'no_penalties' END, CASE WHEN NOT dates THEN 'no_dates' END, CASE WHEN cand > 1 THEN 'several_prices' END, CASE WHEN bad > 0 THEN 'quotes_unverified' END, CASE WHEN conflicts > 0 THEN 'quotes_mismatched' END,
  CASE WHEN ocr > 0 THEN 'pages_corrected' END) AS warnings FROM f""")
def quality_warnings(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    codes = assemble.warning_codes(c("price"), c("ok"), c("rule"), c("rule"), c("failed"), c("req"), c("pen"), c("dates"), c("cand"), c("bad"), c("conflicts"), c("ocr"))
    return _flags(s, d).select("o_orderkey", F.array_join(codes, ",").alias("warnings"))


def benchmark_parts(s: SparkSession, d: str) -> DataFrame:
    """Quotes of no known document: each passage of the benchmark (quote_id 3 * item_id), its first half and its second."""
    b = table(s, d, "benchmark").withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    parts = F.array(F.col("text"), F.expr("left(text, half)"), F.expr("substring(text, half + 1)"))
    return b.select("item_id", F.posexplode(parts).alias("part", "quote")).select((F.col("item_id") * 3 + F.col("part")).alias("quote_id"), "quote")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, page_no, {NORM.format('text')} AS norm FROM l WHERE text IS NOT NULL),
  b AS (SELECT item_id * 3 AS id, text, length(text) // 2 AS half FROM benchmark),
  q AS (SELECT id + part AS quote_id, {NORM.format("CASE part WHEN 0 THEN text WHEN 1 THEN text[:half] ELSE text[half + 1:] END")} AS needle FROM b, (VALUES (0), (1), (2)) AS v(part))
  SELECT DISTINCT q.quote_id, p.doc_id, p.page_no FROM q JOIN p ON contains(p.norm, q.needle) WHERE length(q.needle) >= 8""")
def passage_occurrences(s: SparkSession, d: str) -> DataFrame:
    """Every line of every document in which a passage of the benchmark, or half of one, stands word for word."""
    return verify.occurrences(benchmark_parts(s, d), lines(s, d))


@query()
def passage_check(s: SparkSession, d: str) -> DataFrame:
    """Passages of the benchmark, partly misread (every 'th' read as 'ht' in odd ones), by the whole cascade over the lines of all documents."""
    q = benchmark_parts(s, d).withColumn("quote", F.when(F.col("quote_id") % 2 == 1, F.regexp_replace("quote", "th", "ht")).otherwise(F.col("quote")))
    return verify.check(q, lines(s, d), ()).select("quote_id", "method", "verified", "doc_id", "page_no", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT conv_id, turn, {NORM.format('text')} AS norm FROM conversations),
  q AS (SELECT conv_id, turn, norm, CASE WHEN turn % 3 = 1 THEN 'zz' || reverse(norm) WHEN turn % 3 = 2 THEN norm || ' 987654' ELSE norm END AS needle FROM t),
  f AS (SELECT q.conv_id, q.turn, arg_min(t.turn, (t.turn <> q.turn + 1, t.turn)) FILTER (WHERE length(q.needle) >= 8 AND contains(t.norm, q.needle)) AS page,
    max(length(q.norm) + CASE WHEN contains(t.norm, q.norm || ' ') THEN 1 ELSE 0 END) FILTER (WHERE contains(t.norm, q.norm)) AS held FROM q JOIN t ON q.conv_id = t.conv_id GROUP BY ALL)
  SELECT conv_id, count(*)::BIGINT AS total, count(*) FILTER (WHERE page IS NULL)::BIGINT AS unverified,
  count(*) FILTER (WHERE turn % 3 = 2 AND page IS NULL AND held >= 8 AND held >= 0.75 * length(needle))::BIGINT AS mismatches,
  count(*) FILTER (WHERE page <> turn + 1)::BIGINT AS page_corrections FROM q LEFT JOIN f USING (conv_id, turn) GROUP BY conv_id""")
def evidence_counters(s: SparkSession, d: str) -> DataFrame:
    """Turns quoted as they are, backwards, and with a number that no page has; all claimed one page too far."""
    q = passages(s, d).withColumn("quote", text.normalize_quote(F.col("quote")))
    k = F.col("quote_id") % 3
    q = q.withColumn("quote", F.when(k == 1, F.concat(F.lit("zz"), F.reverse("quote"))).when(k == 2, F.concat("quote", F.lit(" 987654"))).otherwise(F.col("quote")))
    return verify.counters(verify.check(q, turns(s, d)), q).withColumnRenamed("doc_id", "conv_id")


@query("""SELECT o_orderkey, 'Предмет закупки: заказ ' || o_orderkey || '. Заказчик: клиент ' || o_custkey || '. Закупка проводится по 44-ФЗ. Начальная (максимальная) цена контракта — '
  || replace(replace(format('{:,.2f}', o_totalprice::DECIMAL(18,2)::DOUBLE), ',', ' '), '.', ',') || ' руб., НДС включён. Требований к участникам найдено: 3.' AS summary FROM orders""")
def template_summary(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(s, d, "orders").select("o_orderkey", assemble.summary(
        F.concat(F.lit("заказ "), F.col("o_orderkey").cast("string")), F.concat(F.lit("клиент "), F.col("o_custkey").cast("string")), F.lit("44-ФЗ"), none, amount("o_totalprice"), F.lit("включён"),
        F.lit(0).cast("decimal(18,2)"), none, none, F.lit(3), F.lit(0),
    ).alias("summary"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_returnflag = 'R')
  SELECT l_orderkey, string_agg('Штраф для исполнителя: ' || l_partkey || ' руб. — строка ' || l_linenumber, ' | ' ORDER BY n) AS risks FROM r WHERE n <= 3 GROUP BY l_orderkey""")
def top_risks(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "штраф").otherwise("пеня")
    item = F.struct("l_linenumber", "l_partkey", kind.alias("kind"), F.lit("исполнитель").alias("party"), F.concat(F.col("l_partkey").cast("string"), F.lit(" руб.")).alias("amount_text"), F.concat(F.lit("строка "), F.col("l_linenumber").cast("string")).alias("trigger"))
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("p"))
    return x.select("l_orderkey", F.array_join(assemble.risks(F.col("p"), F.lit(0).cast("decimal(18,2)"), F.lit(None).cast("string")), " | ").alias("risks")).where("risks <> ''")


# --- payloads, store, choices


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (json_extract_string(props, '$.k'))::BIGINT END AS k, event_id % 5 <> 0 AS valid FROM events")
def json_payload(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.col("props"))
    body = extract.payload(raw)
    return table(s, d, "events").select("event_id", F.from_json(body, "k long")["k"].alias("k"), body.isNotNull().alias("valid"))


@query("""SELECT doc_id, chunk_no, subject, error FROM (SELECT doc_id, 0 AS chunk_no, CASE WHEN doc_id % 3 = 0 THEN 'тема ' || doc_id END AS subject,
  CASE doc_id % 3 WHEN 1 THEN 'timeout' WHEN 2 THEN 'llm_response_invalid' END AS error FROM documents)""")
def replayed_answers(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", F.lit(0).alias("chunk_no"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("тема "), F.col("doc_id").cast("string")).alias("subject")))).when(F.col("doc_id") % 3 == 2, "no answer")
    given = x.select("*", answer.alias("json"), F.when(F.col("doc_id") % 3 == 1, "timeout").alias("error"))
    return extract.replay(x, given).select("doc_id", "chunk_no", F.col("facts.subject").alias("subject"), "error")


@query("SELECT o_custkey, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END)::BIGINT AS input_tokens, sum(CASE WHEN o_custkey % 2 = 0 THEN o_orderkey END)::BIGINT AS output_tokens FROM orders GROUP BY o_custkey")
def usage_sums(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    calls = table(s, d, "orders").select("o_custkey", F.when(k % 3 == 0, k).alias("input_tokens"), F.when(F.col("o_custkey") % 2 == 0, k).alias("output_tokens"))
    return extract.usage(calls, ["o_custkey"], "input_tokens", "output_tokens")


@query("""WITH d AS (SELECT doc_id, 'v1-offline-rules_1-' || substr(sha256(text), 1, 32) AS key FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT key FROM d WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)
  SELECT (SELECT count(*) FROM d JOIN s USING (key))::BIGINT AS hits, (SELECT count(DISTINCT key) FROM d WHERE key NOT IN (SELECT key FROM s))::BIGINT AS misses""")
def store_plan(s: SparkSession, d: str) -> DataFrame:
    docs = sources.keyed(table(s, d, "documents"), F.lit("offline"), F.lit("rules/1"))
    stored = docs.where("doc_id % 3 = 0").select("key", F.when(F.col("doc_id") % 2 == 0, '{"ok":1}').otherwise("{broken").alias("result"))
    hits, misses = sources.plan_work(docs, stored)
    both = hits.select(F.lit(True).alias("hit")).unionByName(misses.select(F.lit(False).alias("hit")))
    return both.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("""SELECT substr(sha256(text), 31, 2) AS part, count(DISTINCT sha256(text))::BIGINT AS results, min(doc_id)::BIGINT AS least FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1""")
def store_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Results of all documents put into a store by two writers, every fifth one spoilt, and what the store then has."""
    register(s)
    path = f"{sources.shared_folder(s)}/store-{uuid.uuid4().hex}"
    docs = sources.keyed(table(s, d, "documents").where("text IS NOT NULL"), F.lit("offline"), F.lit("rules/1"))
    least = docs.where("doc_id % 5 <> 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    both = docs.join(least, "key", "left").select("doc_id", "key", F.when(F.col("doc_id") % 5 == 0, '{"least": ').otherwise(F.to_json(F.struct("least"))).alias("result"))
    for writer in (both.where("doc_id % 2 = 0"), both):
        writer.select("key", "result").write.format("results").mode("append").save(path)
    x = s.read.format("results").load(path)
    return x.groupBy("part").agg(F.count("*").alias("results"), F.min(F.get_json_object("result", "$.least").cast("long")).alias("least"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'offline' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'openai' ELSE 'gemini' END AS provider,
  CASE s_suppkey % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'rus' WHEN 2 THEN 'eng+rus' ELSE 'deu' END AS lang FROM supplier""")
def choices(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    configured = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("gemini"), F.lit("anthropic"))).when(k == 2, F.array(F.lit("gemini"), F.lit("openai"))).otherwise(F.array(F.lit("gemini")))
    asked = F.when(k == 0, "fra").when(k == 1, "rus+fra").when(k == 2, "eng+rus").otherwise("fra")
    there = F.when(k == 3, F.array(F.lit("ita"), F.lit("deu"))).otherwise(F.array(F.lit("rus"), F.lit("eng")))
    return table(s, d, "supplier").select("s_suppkey", extract.resolve_provider(configured).alias("provider"), extract.resolve_languages(asked, there).alias("lang"))


@query("""SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS price, (o_totalprice::DECIMAL(18,2) + 2)::DECIMAL(18,2) AS security, o_orderdate::DATE AS deadline,
  CASE o_orderkey % 3 WHEN 0 THEN '44-ФЗ' WHEN 1 THEN '223-ФЗ' ELSE 'не определено' END AS law, lpad(o_orderkey::VARCHAR, 19, '0') AS procurement_number, 1::BIGINT AS n_requirements, 1::BIGINT AS n_penalties FROM orders""")
def offline_extraction(s: SparkSession, d: str) -> DataFrame:
    x = extract.offline(notices(s, d))
    return x.select(F.col("doc_id").alias("o_orderkey"), F.col("price").cast("decimal(18,2)").alias("price"), F.col("security").cast("decimal(18,2)").alias("security"), "deadline", "law", "procurement_number", "n_requirements", "n_penalties")


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS price, true AS confirmed, 0.6::DOUBLE AS confidence, 'warn' AS band FROM orders")
def offline_records(s: SparkSession, d: str) -> DataFrame:
    """From pages to a scored record by rules alone."""
    x = extract.offline(notices(s, d))
    c, no = F.col, F.lit(False)
    x = x.withColumn("confirmed", assemble.confirmed(c("price"), c("price_candidates")))
    conf = assemble.confidence(c("price"), c("confirmed"), no, c("deadline").isNotNull(), c("n_requirements"), c("n_penalties"), F.lit(0), F.lit(0), c("price"), F.size("price_candidates"), F.lit(0), F.lit(0), F.lit(True))
    x = x.withColumn("confidence", conf)
    return x.select(c("doc_id").alias("o_orderkey"), c("price").cast("decimal(18,2)").alias("price"), "confirmed", "confidence", assemble.band(c("confidence")).alias("band"))


# --- records


def chunk_facts(s: SparkSession, d: str) -> DataFrame:
    """A chunk (doc_id, chunk_no, facts) for each turn, in the form of a model's answer."""
    n, role = F.length("text"), F.col("role")
    proof = lambda q: F.struct((F.col("turn") + 1).cast("int").alias("page"), q.alias("quote"))
    none = F.struct(F.lit(0).alias("page"), F.lit("").alias("quote"))
    nothing = F.struct(F.lit("").alias("iso_date"), F.lit("").alias("raw_text"), none.alias("evidence"))
    money = F.struct((n % 3 * 100).cast("double").alias("amount"), F.lit("rub").alias("currency"), F.lit("включён").alias("vat"), F.when(n % 3 == 0, "по смете").otherwise("").alias("raw_text"), none.alias("evidence"))
    unset = F.struct(F.lit(0.0).alias("amount"), F.lit("").alias("currency"), F.lit("").alias("vat"), F.lit("").alias("raw_text"), none.alias("evidence"))
    day = F.struct(F.when(n % 2 == 0, F.concat(F.lit("2026-01-0"), (n % 5 + 1).cast("string"))).otherwise("").alias("iso_date"), F.when(n % 7 == 0, "скоро").otherwise("").alias("raw_text"), none.alias("evidence"))
    asked = F.array(F.struct(F.col("text").alias("text"), F.lit("опыт").alias("category"), F.lit(True).alias("mandatory"), proof(F.col("text")).alias("evidence")))
    facts = F.struct(
        role.alias("subject"), F.concat(F.lit(" "), role, F.lit(" ")).alias("customer"), F.lit("").alias("procurement_number"), F.when(n % 2 == 0, "44-ФЗ").otherwise("не определено").alias("law"), money.alias("price"), unset.alias("contract_security"),
        day.alias("application_deadline"), nothing.alias("contract_start"), nothing.alias("contract_end"), role.alias("duration_text"), F.array().alias("stages"), asked.alias("requirements"), F.array().alias("penalties"),
    )
    return table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_no"), facts.cast(T.StructType.fromDDL(extract.SCHEMA)).alias("facts"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) % 3 * 100 AS amount, CASE WHEN length(text) % 2 = 0 THEN '2026-01-0' || (length(text) % 5 + 1) END AS iso, length(text) % 2 = 0 AS law, length(text) % 7 = 0 AS raw FROM conversations),
  r AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM c GROUP BY ALL), s AS (SELECT conv_id, arg_min(role, (-n, -length(role), f)) AS subject, arg_min(role, (-length(role), f)) AS duration_text FROM r GROUP BY conv_id),
  m AS (SELECT conv_id, amount, count(*) AS n, min(turn) AS f FROM c WHERE amount > 0 GROUP BY ALL),
  p AS (SELECT conv_id, arg_min(amount, (-n, f))::DOUBLE AS price, CASE WHEN count(*) > 1 THEN 'Фрагменты документа называют разные значения на цену контракта: ' || string_agg(amount || '.00', ', ' ORDER BY amount) || '. Выбрано наиболее частое, при равенстве — из более раннего фрагмента.' END AS said FROM m GROUP BY conv_id),
  i AS (SELECT conv_id, iso, count(*) AS n, min(turn) AS f FROM c WHERE iso IS NOT NULL GROUP BY ALL),
  e AS (SELECT conv_id, arg_min(iso, (-n, f)) AS deadline, CASE WHEN count(*) > 1 THEN 'Фрагменты документа называют разные значения на даты окончания подачи заявок: ' || string_agg(iso, ', ' ORDER BY iso) || '. Выбрано наиболее частое, при равенстве — из более раннего фрагмента.' END AS said FROM i GROUP BY conv_id),
  w AS (SELECT conv_id, CASE WHEN bool_or(law) THEN '44-ФЗ' END AS law, bool_or(raw) AS raw FROM c GROUP BY conv_id)
  SELECT s.conv_id, s.subject, s.duration_text, w.law, coalesce(p.price, 0) AS price, coalesce(e.deadline, CASE WHEN raw THEN '' END) AS deadline, nullif(concat_ws(' | ', p.said, e.said), '') AS conflicts
  FROM s JOIN w USING (conv_id) LEFT JOIN p USING (conv_id) LEFT JOIN e USING (conv_id)""")
def merged_chunks(s: SparkSession, d: str) -> DataFrame:
    x = records.merge_chunks(chunk_facts(s, d))
    return x.select(
        F.col("doc_id").alias("conv_id"), "subject", "duration_text", "law", F.coalesce("price.amount", F.lit(0.0)).alias("price"), F.col("application_deadline.iso_date").alias("deadline"),
        F.nullif(F.array_join("conflicts", " | "), F.lit("")).alias("conflicts"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '44-ФЗ' WHEN 1 THEN '223-ФЗ' ELSE 'не определено' END AS law, o_totalprice::DECIMAL(18,2) AS price, (o_totalprice::DECIMAL(18,2) + 2)::DECIMAL(18,2) AS security, 'включён' AS vat, true AS confirmed,
  o_orderdate::DATE AS deadline, 1::BIGINT AS requirements, 1::BIGINT AS penalties, 5::BIGINT AS quotes, 0::BIGINT AS unverified, 'исполнитель' AS party, true AS proved, 0.6::DOUBLE AS confidence, '' AS warnings FROM orders""")
def assembled_records(s: SparkSession, d: str) -> DataFrame:
    """Notices through all steps: extraction by rules with quotes, reduction, quotes checked against the pages, final record."""
    n = sources.settled(notices(s, d), "notices")
    found = sources.settled(extract.offline(n), "findings")
    facts = sources.settled(records.merge_chunks(extract.offline_struct(n, found).select("doc_id", F.lit(0).alias("chunk_no"), "facts")), "facts")
    x = records.record(facts, found.withColumn("amounts", F.concat("price_candidates", F.array("security"))), n, True)
    return x.select(
        F.col("doc_id").alias("o_orderkey"), "law", F.col("price.amount").cast("decimal(18,2)").alias("price"), F.col("contract_security.amount").cast("decimal(18,2)").alias("security"), F.col("price.vat").alias("vat"),
        F.col("price.confirmed").alias("confirmed"), F.col("application_deadline.date").alias("deadline"), F.size("requirements").cast("long").alias("requirements"), F.size("penalties").cast("long").alias("penalties"),
        F.col("total").alias("quotes"), "unverified", F.col("penalties")[0]["value"]["party"].alias("party"), F.col("penalties")[0]["verified"].alias("proved"), "confidence", F.array_join("warnings", ",").alias("warnings"),
    )


@query("""SELECT conv_id, count(*)::BIGINT AS chunks, count(*) FILTER (WHERE turn % 2 = 1)::BIGINT AS answered,
  coalesce(string_agg('Фрагмент ' || (turn + 1) || ' (страницы ' || turn || ') не разобран: timeout', ' | ' ORDER BY turn) FILTER (WHERE turn % 2 = 0), '') AS warnings,
  CASE WHEN count(*) FILTER (WHERE turn % 2 = 1) = 0 THEN 'Не удалось разобрать ни один фрагмент документа. timeout' END AS error FROM conversations GROUP BY conv_id""")
def chunk_failures(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), F.col("turn").cast("string").alias("pages_label"), F.when(F.col("turn") % 2 == 0, "timeout").alias("error"))
    x = records.failures(c)
    return x.select(F.col("doc_id").alias("conv_id"), "chunks", "answered", F.array_join("warnings", " | ").alias("warnings"), "error")


@query(r"""SELECT conv_id, turn::INTEGER AS page_no, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM conversations""")
def prompt_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Turns as marked pages of a prompt, and the pages read back from it."""
    c = table(s, d, "conversations")
    page = F.concat(F.lit("[СТРАНИЦА "), F.col("turn").cast("string"), F.lit("]\n"), F.col("text"))
    x = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda t: t["p"]), "\n\n").alias("text"))
    asked = records.prompt(x.select("doc_id", F.lit(0).alias("chunk_no"), "text", F.lit("1").alias("pages_label"), F.lit(2).alias("n_chunks")), F.lit("notice.pdf"))
    return records.prompt_pages(asked).select(F.col("doc_id").alias("conv_id"), "page_no", "text")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'b.c: expected number' WHEN 2 THEN 'a: missing,b: missing,d: missing' ELSE 'd.1.e: expected boolean' END AS errors FROM events""")
def answer_errors(s: SparkSession, d: str) -> DataFrame:
    """Answers with the right shape, a wrong type, missing fields, and a wrong type in the second item of a list."""
    k = F.col("event_id") % 4
    flag = F.when(k == 3, '"x"').otherwise("false")
    whole = F.concat(F.lit('{"a":"'), F.col("event_id").cast("string"), F.lit('","b":{"c":'), F.when(k == 1, '"1"').otherwise("1.5"), F.lit('},"d":[{"e":true},{"e":'), flag, F.lit("}]}"))
    schema = T.StructType.fromDDL("a string, b struct<c:double>, d array<struct<e:boolean>>")
    return table(s, d, "events").select("event_id", F.array_join(extract.validation_errors(F.when(k == 2, F.col("props")).otherwise(whole), schema), ",").alias("errors"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'llm_refused' WHEN k % 13 = 0 THEN 'llm_unavailable' WHEN k % 5 = 0 THEN 'llm_response_invalid' END AS error,
  CASE WHEN k % 11 = 0 THEN 1 WHEN k % 13 = 0 THEN 3 WHEN k % 7 = 0 THEN 2 ELSE 1 END::INTEGER AS attempts FROM o)
  SELECT k AS o_orderkey, error, attempts, CASE WHEN error = 'llm_response_invalid' THEN '["price.vat: not an allowed value"]' END AS details, CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 1 THEN '44-ФЗ' ELSE '223-ФЗ' END END AS law,
  CASE WHEN error IS NULL THEN k + 0.5 END::DOUBLE AS amount FROM a""")
def scripted_answers(s: SparkSession, d: str) -> DataFrame:
    """A prompt for each order, asked of an extractor that fails, passes after a repeat, and answers beside the schema."""
    prompts = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("chunk_no"), F.concat(F.lit("Заказ "), F.col("o_orderkey").cast("string")).alias("prompt"))
    schema = extract.with_domains(T.StructType.fromDDL("law string, price struct<amount:double,vat:string>"), extract.DOMAINS)
    x = clients.checked(clients.ask(prompts, Scripted, wait=0.0), schema)
    return x.select(F.col("doc_id").alias("o_orderkey"), "error", "attempts", F.col("details")["errors"].alias("details"), F.col("facts.law").alias("law"), F.col("facts.price.amount").alias("amount"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS asked, c_custkey % 3 AS keys FROM customer)
  SELECT k AS c_custkey, CASE asked WHEN 0 THEN CASE keys WHEN 0 THEN 'offline' WHEN 1 THEN 'openai' ELSE 'anthropic' END WHEN 1 THEN 'offline' WHEN 2 THEN CASE WHEN keys = 1 THEN 'gemini' END WHEN 3 THEN CASE WHEN keys = 2 THEN 'anthropic' END END AS provider,
  CASE WHEN asked = 2 AND keys <> 1 OR asked = 3 AND keys <> 2 THEN 'provider_not_configured' WHEN asked = 4 THEN 'unknown_provider' END AS error, CASE WHEN asked = 0 AND keys = 0 THEN 'offline_for_want_of_keys' END AS note FROM c""")
def provider_choice(s: SparkSession, d: str) -> DataFrame:
    """Who answers, by who is asked for and whose keys are there; a blank key is none."""
    k = F.col("c_custkey")
    asked = F.element_at(F.array(*map(F.lit, ("auto", "offline", "gemini", "anthropic", "oracle"))), (k % 5 + 1).cast("int"))
    key = lambda n: F.when(k % 3 == n, F.concat(F.lit("key "), k.cast("string"))).otherwise("  ")
    keys = F.create_map(F.lit("gemini"), key(1), F.lit("openai"), key(1), F.lit("anthropic"), key(2))
    return table(s, d, "customer").select("c_custkey", extract.chosen_provider(asked, keys).alias("c")).select("c_custkey", "c.*")


@query("""SELECT 'notice ' || doc_id || '.PDF' AS name, round(n_chars / 1024)::BIGINT AS size_kb, CASE WHEN lang = 'de' THEN 'Bekanntmachung ' || doc_id ELSE 'notice ' || doc_id END AS title FROM documents WHERE doc_id % 2 = 0""")
def sample_listing(s: SparkSession, d: str) -> DataFrame:
    """The listing of a folder that holds a file for each document, PDFs for even ids; German ones have titles."""
    x = table(s, d, "documents")
    number = F.col("doc_id").cast("string")
    files = x.select(F.concat(F.lit("s3://samples/../a/notice "), number, F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".pdf.txt")).alias("path"), F.col("n_chars").alias("length"))
    titles = x.where("lang = 'de'").select(F.concat(F.lit("notice "), number, F.lit(".PDF")).alias("name"), F.concat(F.lit("Bekanntmachung "), number).alias("title"))
    return sources.listing(files, titles)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(18,3) + (l_linenumber % 4) * 0.006::DECIMAL(18,3) AS claimed FROM lineitem),
  f AS (SELECT DISTINCT l_orderkey, l_extendedprice::DECIMAL(18,2) AS amount FROM lineitem WHERE l_partkey % 2 = 1),
  near AS (SELECT DISTINCT c.l_orderkey, c.claimed FROM c JOIN f ON f.l_orderkey = c.l_orderkey AND abs(f.amount - c.claimed) <= 0.01)
  SELECT c.l_orderkey, count(*)::BIGINT AS n, count(near.claimed)::BIGINT AS confirmed FROM c LEFT JOIN near ON near.l_orderkey = c.l_orderkey AND near.claimed = c.claimed GROUP BY c.l_orderkey""")
def amounts_confirmed(s: SparkSession, d: str) -> DataFrame:
    """Amounts of lines, some a little off, confirmed by the amounts of the same order's lines with odd parts."""
    x = table(s, d, "lineitem")
    claims = x.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("decimal(18,3)") + (F.col("l_linenumber") % 4) * F.lit("0.006").cast("decimal(18,3)")).cast("decimal(18,3)").alias("claimed"))
    found = x.where("l_partkey % 2 = 1").select("l_orderkey", amount("l_extendedprice").alias("amount"))
    near = assemble.near_amounts(claims, found, ["l_orderkey"], "claimed", "amount")
    return near.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("confirmed"))


@query("""WITH c AS (SELECT c_custkey AS k, (abs(c_acctbal::DECIMAL(18,2)) + 100)::DECIMAL(18,2) AS price, c_custkey % 3 AS way, c_custkey % 4 = 0 AS short FROM customer)
  SELECT k AS c_custkey, CASE WHEN way <> 1 THEN price::VARCHAR END AS price, CASE WHEN way <> 1 THEN 'true' END AS confirmed, '44-ФЗ' AS law, 'поставка бумаги партии ' || k AS subject, CASE WHEN way = 1 THEN NULL ELSE 'не включён' END AS vat,
  (DATE '2026-01-10' + (k % 200)::INTEGER)::VARCHAR AS deadline, CASE WHEN short THEN 2 ELSE 3 END::VARCHAR AS pages, 'offline' AS provider, concat_ws('|',
  CASE WHEN way = 1 THEN 'Цена контракта не найдена — проверьте документ вручную.' END, CASE WHEN short THEN 'Меры ответственности не найдены — это редкость для закупочной документации.' END,
  CASE WHEN way = 2 THEN 'В документе несколько разных сумм у формулировки цены контракта: ' || replace(format('{:,.2f}', price::DOUBLE), ',', ' ') || ', ' || replace(format('{:,.2f}', (price + 5)::DOUBLE), ',', ' ') || '. Проверьте, какая из них относится к предмету закупки.' END) AS warnings FROM c""")
def record_json(s: SparkSession, d: str) -> DataFrame:
    """Notices in three wordings through all steps into one JSON object each, and what it holds."""
    n = sources.settled(tenders(s, d), "tenders")
    found = sources.settled(extract.offline(n), "findings")
    facts = sources.settled(records.merge_chunks(extract.offline_struct(n, found).select("doc_id", F.lit(0).alias("chunk_no"), "facts")), "facts")
    amounts = rules.money_hits(n).groupBy("doc_id").agg(F.collect_set("amount").alias("amounts"))
    findings = found.join(sources.shuffled(amounts), "doc_id", "left").select("doc_id", "price", "price_candidates", "amounts", "law", "procurement_number")
    whole = n.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("characters"))
    number = F.col("doc_id").cast("string")
    about = whole.select("doc_id", F.concat(F.lit("tender "), number, F.lit(".pdf")).alias("filename"), F.sha2(number, 256).alias("sha256"), "pages", "characters", F.lit("text_layer").alias("text_source"), F.array().cast("array<int>").alias("ocr_pages"))
    runs = whole.select("doc_id", F.lit("offline").alias("provider"), F.lit(None).cast("string").alias("model"), F.lit(1).alias("chunks"), F.lit(0).alias("llm_calls"), *[F.lit(None).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_ms")], F.lit(False).alias("cached"))
    x = records.report(records.record(facts, findings, n, True), about, runs)
    at = lambda path: F.get_json_object("json", path)
    return x.select(
        F.col("doc_id").alias("c_custkey"), at("$.price.amount").alias("price"), at("$.price.confirmed_by_rules").alias("confirmed"), at("$.law").alias("law"), at("$.subject").alias("subject"), at("$.price.vat").alias("vat"),
        at("$.timeline.application_deadline.date").alias("deadline"), at("$.document.pages").alias("pages"), at("$.meta.provider").alias("provider"), F.array_join(F.from_json(at("$.warnings"), "array<string>"), "|").alias("warnings"),
    )


# --- streams


def streamed(s: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """All that a stream gives until its source has no more, as a table."""
    out = f"{sources.shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{out}/rows")


@query("SELECT sha256(text) AS sha256, count(*) FILTER (WHERE false)::BIGINT AS repeats, max(length(text))::BIGINT AS chars FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """Documents read as a stream, once for each content within the watermark."""
    came = assembly.table_stream(s, d, "documents.parquet").where("text IS NOT NULL").withColumn("at", F.timestamp_seconds(F.pmod("doc_id", F.lit(600)) + 1_000_000_000))
    x = streamed(s, ingest.deduplicated(came, "at").select("sha256", "text"), "ingest")
    return x.groupBy("sha256").agg((F.count("*") - 1).alias("repeats"), F.max(F.length("text")).cast("long").alias("chars"))


@query(f"""WITH {LINES}, a AS (SELECT doc_id, page_no - 1 AS k, CASE WHEN trim(text, ' ' || chr(9) || chr(13)) = '' THEN 'empty' WHEN (doc_id + page_no) % 7 = 0 THEN 'llm_timeout' END AS error, page_no FROM l)
  SELECT doc_id, count(*)::BIGINT AS chunks, count(*) FILTER (WHERE error IS NULL)::BIGINT AS answered,
  coalesce(string_agg('Фрагмент ' || (k + 1) || ' (страницы ' || page_no || ') не разобран: ' || error, '|' ORDER BY k) FILTER (WHERE error IS NOT NULL), '') AS warnings,
  CASE WHEN count(*) FILTER (WHERE error IS NULL) = 0 THEN 'Не удалось разобрать ни один фрагмент документа. ' || arg_min(error, k) END AS error FROM a GROUP BY doc_id""")
def stream_records(s: SparkSession, d: str) -> DataFrame:
    """A stream of answers, one or two for each line of each document and some of them errors, gathered until documents are complete."""
    came = assembly.table_stream(s, d, "documents.parquet").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("t"))
    x = came.select("doc_id", F.size("t").alias("n_chunks"), F.posexplode("t").alias("chunk_no", "line"))
    page = F.col("chunk_no") + 1
    failed = F.when(F.trim(F.translate("line", "\t\r", "  ")) == "", "empty").when((F.col("doc_id") + page) % 7 == 0, "llm_timeout")
    # every third answer is given twice, first as an error
    said = F.when((page % 3 == 0) & failed.isNull(), F.array(F.lit("llm_rate_limited"), failed)).otherwise(F.array(failed))
    x = x.select("doc_id", "chunk_no", "n_chunks", page.cast("string").alias("pages_label"), F.explode(said).alias("error"), F.timestamp_seconds(F.pmod("doc_id", F.lit(600)) + 1_000_000_000).alias("at"))
    rows = assembly.finished(streamed(s, assembly.assembled(x, "at"), "assembly"))
    return rows.select("doc_id", "chunks", "answered", F.array_join("warnings", "|").alias("warnings"), "error")
