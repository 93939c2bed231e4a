"""Numbers as words, as column expressions that also work inside lambdas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\$?-?\d[\d,]*(?:\.\d+)?%?$"

# The names of numbers.
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def _names(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _below_hundred(n: Column) -> Column:
    tens = F.element_at(_names(TENS), F.greatest(F.floor(n / 10) - 1, F.lit(1)).cast("int"))
    small = F.element_at(_names(ONES), F.least(n + 1, F.lit(20)).cast("int"))
    unit = F.element_at(_names(ONES), (n % 10 + 1).cast("int"))
    return F.when(n < 20, small).when(n % 10 == 0, tens).otherwise(F.concat_ws(" ", tens, unit))


def _below_thousand(n: Column) -> Column:
    hundred = F.concat(F.element_at(_names(ONES), F.floor(n / 100).cast("int") + 1), F.lit(" hundred"))
    rest = n % 100
    return F.when(n < 100, _below_hundred(n)).when(rest == 0, hundred).otherwise(F.concat_ws(" ", hundred, _below_hundred(rest)))


def int_words(n: Column) -> Column:
    """Words for a whole number up to 999,999 either side of zero; larger ones stay digits."""
    n = n.cast("long")
    size = F.abs(n)
    low = size % 1000
    thousands = F.concat(_below_thousand(F.floor(size / 1000) % 1000), F.lit(" thousand"))
    words = F.when(size < 1000, _below_thousand(low)).when(size >= 1_000_000, size.cast("string")).when(low == 0, thousands).otherwise(F.concat_ws(" ", thousands, _below_thousand(low)))
    return F.when(n < 0, F.concat(F.lit("minus "), words)).otherwise(words)


def number_words(token: Column) -> Column:
    """Words for a token that matches NUMBER: currency and commas go, decimals are read digit by digit."""
    core = F.translate(token, "$,%", "")
    whole, digits = F.split_part(core, F.lit("."), F.lit(1)), F.split_part(core, F.lit("."), F.lit(2))
    # More digits than a long holds stay as they are.
    spelled = F.when(F.length(whole) > 18, whole).otherwise(int_words(F.expr("bigint(0)") + F.when(F.length(whole) <= 18, whole).cast("long")))
    read = F.array_join(F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: F.element_at(_names(ONES[:10]), d.cast("int") + 1)), " ")
    out = F.when(F.contains(core, F.lit(".")), F.concat_ws(" ", spelled, F.lit("point"), read)).otherwise(spelled)
    return F.when(F.endswith(token, F.lit("%")), F.concat(out, F.lit(" percent"))).otherwise(out)
