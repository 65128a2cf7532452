"""Language identification by Bayesian fusion of evidence.

For each page and language: log prior of the host + tempered log likelihood of the text + log P(declared markup language |
language) + log P(address suffix | language). The text model is a naive Bayes model of letter trigrams (hashed to
2**16 bins), fitted on up to FIT_ROWS labelled documents (those with the least hash of id and text; a language has a row at least, so there are no more than that). What the declaration and
the suffix are worth, and the priors, come from grouped sums over all pages of a first posterior (text alone):
hosts are smoothed towards their domain and domains towards all pages, each with the weight of KAPPA pages.

Defined cases: null or empty html has a flat text likelihood; a missing declaration or suffix is a value of its own; null
urls share one empty host; unknown languages in declarations are values like others; repeated rows and ids are rows of
their own; without labelled documents the language is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table

FIT_ROWS = 4_000
BINS = 1 << 16
TEMPER = 0.2
KAPPA = 5.0
MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.S | re.I)
LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(text: str | None) -> np.ndarray:
    """Bins of the byte trigrams of the text's words in lower case, words set apart by one space."""
    flat = " " + " ".join(LETTERS.findall(text or "")).lower() + " "
    b = np.frombuffer(flat.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35)) if len(b) > 2 else np.empty(0, np.uint32)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log P(bin | language), one column for each language."""
    sound = docs.where("lang is not null and text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    chosen = materialise(sound.select("key").orderBy("key").limit(fit_rows), "lang-sample")  # keys alone are ordered; the texts stay where they are
    sample = sound.select("key", "text", "lang").join(F.broadcast(chosen.distinct()), "key")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                n = np.bincount(np.concatenate([trigrams(t) for t in texts]), minlength=BINS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bin": at, "n": n[at]})

    sums = sample.mapInPandas(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique(), key=lambda x: (-sums.loc[sums["lang"] == x, "n"].sum(), x))
    counts = np.full((BINS, len(langs)), 0.1)
    for k, lang in enumerate(langs):
        mine = sums[sums["lang"] == lang]
        counts[mine["bin"].to_numpy(), k] += mine["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else counts.astype(np.float32)


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, url, host, domain, suffix, declared, fit array of log likelihoods by language) of each page."""

    @F.pandas_udf("array<double>")
    def likelihood(html: pd.Series) -> pd.Series:
        return pd.Series([(TEMPER * model[trigrams(MARKUP.sub(" ", h or ""))].sum(axis=0, dtype=np.float64)).tolist() for h in html])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce(F.regexp_extract("html", r"(?is)<html\b([^>]*)>", 1), F.lit("")), r"""(?i)\blang\s*=\s*["']?([A-Za-z]{2,8})""", 1))
    parts = F.split("host", r"\.")
    folder = F.regexp_extract("url", r"^[^/]*//[^/]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    out = pages.select("page_id", "url", host.alias("host"), declared.alias("declared"), F.coalesce(F.lower(folder), F.lit("")).alias("folder"), likelihood("html").alias("fit"))
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    return out.select("page_id", "url", "host", domain.alias("domain"), F.concat_ws("/", F.element_at(parts, -1), "folder").alias("suffix"), F.coalesce("declared", F.lit("")).alias("declared"), "fit")


def normalised(logs: Column) -> Column:
    """Probabilities from an array of logs."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, url, lang, probability, text_lang, declared) of every row of pages (page_id, url, html)."""
    if not langs:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"))
    k = range(len(langs))
    seen = materialise(evidence(pages, langs, model).withColumn("p", normalised(F.col("fit"))), "lang-evidence")
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in k]

    def sides(by: str) -> DataFrame:
        return seen.groupBy(by).agg(*sums)

    total = seen.agg(*sums, F.count("*").alias("n")).first()
    mass = [(total[f"n{i}"] or 0.0) + 1.0 for i in k]
    prior = [m / sum(mass) for m in mass]

    def worth(by: str) -> DataFrame:
        """log P(value | language), smoothed towards the value's share of all pages."""
        share = sum(F.col(f"n{i}") for i in k) / float(max(1, total["n"]))
        return sides(by).select(F.col(by), F.array(*[F.log((F.col(f"n{i}") + KAPPA * share) / (mass[i] + KAPPA)) for i in k]).alias(f"{by}_fit"))

    def smoothed(by: str, above: list[Column]) -> list[Column]:
        n = sum(F.col(f"n{i}") for i in k)
        return [(F.col(f"n{i}") + KAPPA * above[i]) / (n + KAPPA) for i in k]

    domains = sides("domain").select("domain", F.array(*smoothed("domain", [F.lit(p) for p in prior])).alias("up"))
    hosts = seen.groupBy("host", "domain").agg(*sums).join(domains, "domain")
    hosts = materialise(hosts.select("host", F.transform(F.array(*smoothed("host", [F.col("up")[i] for i in k])), lambda x: F.log(x)).alias("host_fit")), "lang-hosts")
    declared, suffix = materialise(worth("declared"), "lang-declared"), materialise(worth("suffix"), "lang-suffix")
    x = seen
    for side, by in ((hosts, "host"), (declared, "declared"), (suffix, "suffix")):
        x = x.join(small(side, side.count()), by)
    logs = F.array(*[F.col("fit")[i] + F.col("host_fit")[i] + F.col("declared_fit")[i] + F.col("suffix_fit")[i] for i in k])
    names = F.array(*map(F.lit, langs))
    x = x.withColumn("q", normalised(logs))
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return x.select("page_id", "url", best(F.col("q")).alias("lang"), F.array_max("q").alias("probability"), best(F.col("p")).alias("text_lang"), "declared")


def op6_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, model = fit(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), langs, model)
