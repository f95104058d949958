"""Scalar functions of the scoring model as columns; all of them compile to JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearscore.functions.config import MCC_DEFAULT, NEIGHBOURS, REJECT_AT


def num(v: float) -> Column:
    """A double literal: a plain one would be a decimal and lose digits."""
    return F.lit(float(v)).cast("double")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, num(0)), num(1))


def round4(x: Column) -> Column:
    """To four places, halves away from zero, by multiplying: round(x, 4) takes another path near halves."""
    return F.round(x * num(10000)) / num(10000)


def scaled(x: Column, most: float) -> Column:
    return round4(clamp01(x / num(most)))


def timestamp(text: Column) -> Column:
    """The first 19 characters as a local time; zone and fraction are ignored; null if they are no time."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def day_of_week(at: Column) -> Column:
    """Monday 0 to Sunday 6; 2 without a time, as the published arithmetic gives for an empty date."""
    return F.coalesce(F.weekday(at), F.lit(2))


def minutes_between(now: Column, last: Column) -> Column:
    """Minutes from last to now; without now 0; without last more than any limit."""
    minutes = (F.unix_timestamp(now) - F.unix_timestamp(last)).cast("double") / num(60)
    return F.when(now.isNull(), num(0)).when(last.isNull(), num(1e12)).otherwise(minutes)


def mcc_key(mcc: Column) -> Column:
    """The code without leading zeros; an empty one is code 0, and what is no code is null."""
    digits = F.when(mcc == "", F.lit("0")).when(mcc.rlike("^[0-9]{1,9}$"), mcc.cast("int").cast("string"))
    return digits


def mcc_risk(mcc: Column, table: dict[str, float]) -> Column:
    """A map literal: the table is bounded by the number of codes, so a lookup needs no join."""
    pairs = [x for k, v in sorted(table.items()) for x in (F.lit(k), num(v))]
    found = F.try_element_at(F.create_map(*pairs), mcc_key(mcc)) if pairs else F.lit(None).cast("double")
    return F.coalesce(found, num(MCC_DEFAULT))


def known(merchant: Column, merchants: Column, most: int) -> Column:
    """Whether the merchant is among the first `most`; a missing id or list is not."""
    return F.coalesce(F.array_contains(F.slice(merchants, 1, most), merchant), F.lit(False))


def relu(x: Column) -> Column:
    return F.greatest(x, num(0))


def sigmoid(x: Column) -> Column:
    return num(1) / (num(1) + F.exp(-x))


def confidence(p: Column) -> Column:
    return F.abs(p - num(0.5)) * num(2)


def fraud_count(n: Column) -> Column:
    """0 to NEIGHBOURS; what lies outside is 0."""
    return F.when((n >= 0) & (n <= NEIGHBOURS), n).otherwise(F.lit(0)).cast("int")


def approved(n: Column) -> Column:
    return n < REJECT_AT


def fraud_score(n: Column) -> Column:
    """n fifths, exact to one place."""
    return n / num(NEIGHBOURS)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as a signed long, in 32-bit halves so that ANSI mode never overflows."""
    m32, low_prime = F.lit(0xFFFFFFFF).cast("long"), F.lit(0x1B3).cast("long")
    digits = F.hex(text.cast("binary"))
    octets = F.when(F.length(digits) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    )

    def step(h: Column, octet: Column) -> Column:
        lo = h["lo"].bitwiseXOR(octet)
        times = lo * low_prime
        hi = h["hi"] * low_prime + F.shiftright(times, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(m32).alias("hi"), times.bitwiseAND(m32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(octets, start, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)
