"""Amounts as exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import MONEY, PERCENT, SPACES

TOLERANCE = "0.01"


def parse_amount(c: Column) -> Column:
    """An amount in any spelling as DECIMAL(38,2), null where it isn't one; of several points the last is the decimal one."""
    plain = F.translate(F.translate(c, " " + SPACES, ""), ",", ".")
    return F.regexp_replace(plain, r"\.(?=.*\.)", "").try_cast("decimal(38,2)")


def to_decimal(c: Column) -> Column:
    """A double as DECIMAL(38,2) by its shortest spelling, ties to even."""
    return F.bround(c.cast("string").try_cast("decimal(38,6)"), 2).cast("decimal(38,2)")


def within(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(3,2)")  # a wide type would round finer amounts


def first_money(c: Column) -> Column:
    """array of one struct(raw, amount, pos, end): the first amount of money in a text; raw is empty where there is none.

    The pattern runs once over the text; explode() the array, so that no rule of the optimiser repeats it for each field.
    """
    raw = F.array(F.regexp_extract(c, MONEY, 0))

    def hit(r: Column) -> Column:
        pos = F.when(r == "", 0).otherwise(F.instr(c, r))
        return F.struct(r.alias("raw"), parse_amount(F.regexp_extract(r, MONEY, 1)).alias("amount"), pos.alias("pos"), (pos + F.length(r) - 1).alias("end"))

    return F.transform(raw, hit)


def all_money(c: Column) -> Column:
    """Array of struct(raw, amount) of all amounts of money in a text, in order."""
    raws = F.regexp_extract_all(c, F.lit(MONEY), F.lit(0))
    return F.transform(raws, lambda r: F.struct(r.alias("raw"), parse_amount(F.regexp_extract(r, MONEY, 1)).alias("amount")))


def amount_text(c: Column) -> Column:
    """The first amount of money, or else the first percentage, as spelled."""
    return F.coalesce(F.nullif(F.regexp_extract(c, MONEY, 0), F.lit("")), F.nullif(F.regexp_extract(c, PERCENT, 0), F.lit("")))
