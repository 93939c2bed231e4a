"""Sentence ends, affixes of words, merging of punctuation marks and capitals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .normalize import PUNCTUATION

# Sentence ends, abbreviations of Latin-script languages, attached marks.
ENDS = (".", "?", "!", "。", "？", "！")
ABBREVIATIONS = (
    "mr", "mrs", "ms", "mx", "dr", "prof", "rev", "hon", "sr", "jr", "st", "mt", "gen", "col", "capt", "lt", "sgt", "maj", "cmdr",
    "vs", "etc", "approx", "dept", "mme", "mlle", "ste", "sra", "srta", "dna", "hr", "nr", "abb", "sig", "dott",
)
TRAILING = ".,!?;:-…。？！、，；："
TERMINAL = ".!?…。？！"

_EDGE = PUNCTUATION + " \t\n\r\x0b\x0c"
# All white space of Unicode, and the separators below it: trimming by a list costs far less than a pattern does.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_WHITE))


def ends_sentence(token: Column) -> Column:
    """Whether a token closes a sentence; initials and abbreviations with a full stop don't."""
    bare = strip(token)
    last = F.right(bare, F.lit(1))
    stem = F.trim(F.substring(bare, F.lit(1), F.greatest(F.char_length(bare) - 1, F.lit(0))), F.lit(_EDGE))
    initial = (F.char_length(stem) <= 2) & stem.rlike(r"^\p{IsLatin}$") & ~stem.isin("ª", "º")
    stop = F.when(stem == "", True).when(initial, False).otherwise(~F.lower(stem).isin(*ABBREVIATIONS))
    return F.coalesce(F.when(~last.isin(*ENDS), False).when(last != ".", True).otherwise(stop), F.lit(False))


def affixes(token: Column) -> Column:
    """struct(lead, core, trail): leading white space, the word, attached marks. A token of marks is its own core."""
    lead = F.substring(token, F.lit(1), F.char_length(token) - F.char_length(F.ltrim(token, F.lit(_WHITE))))
    bare = strip(token)
    core = F.rtrim(bare, F.lit(TRAILING))
    own = core == ""
    return F.struct(lead.alias("lead"), F.when(own, bare).otherwise(core).alias("core"), F.when(own, "").otherwise(F.substring(bare, F.char_length(core) + 1, F.char_length(bare))).alias("trail"))


def merged_mark(original: Column, predicted: Column, confidence: Column, threshold: float = 0.9, demote: bool = False) -> Column:
    """The mark to write: a predicted end is added, an existing end stays unless a confident model may take it away."""
    has_end = (original != "") & F.contains(F.lit(TERMINAL), F.right(original, F.lit(1)))
    wants_end = predicted.isin(".", "?")
    plain = F.when(predicted == "0", "").otherwise(predicted)
    taken = F.when(confidence >= threshold, plain).otherwise(original) if demote else original
    return F.when(has_end & ~wants_end, taken).when(has_end, original).when(wants_end, predicted).when(original != "", original).otherwise(plain)


def capital(core: Column) -> Column:
    """The first letter in upper case, the rest untouched."""
    head = F.regexp_extract(core, r"^([^\p{L}]*)", 1)
    n = F.char_length(head)
    return F.concat(head, F.upper(F.substring(core, n + 1, F.lit(1))), F.substring(core, n + 2, F.char_length(core)))


def recase(words: DataFrame, partition: list[str], order: list[str], column: str = "word") -> DataFrame:
    """Capitals at sentence starts. The state is the last token before that has a core or marks."""
    parts = words.withColumn("_a", affixes(F.col(column)))
    whole = F.concat("_a.core", "_a.trail")
    parts = parts.withColumn("_end", F.when(whole != "", ends_sentence(whole)))
    before = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_starts", F.coalesce(F.last("_end", ignorenulls=True).over(before), F.lit(True)))
    core = F.when(F.col("_starts"), capital(F.col("_a.core"))).otherwise(F.col("_a.core"))
    return parts.withColumn(column, F.concat("_a.lead", core, "_a.trail")).drop("_a", "_end", "_starts")


def apply_labels(words: DataFrame, partition: list[str], order: list[str], threshold: float = 0.9, demote: bool = False) -> DataFrame:
    """Rewrite `word` from `label` and `confidence`, then recase. A word without either is an error."""
    checked = words.withColumn("label", F.when(F.col("label").isNull() | F.col("confidence").isNull(), F.raise_error(F.lit("a label and a confidence are needed for every word"))).otherwise(F.col("label")))
    a = affixes(F.col("word"))
    mark = merged_mark(a["trail"], F.col("label"), F.col("confidence"), threshold, demote)
    written = F.when(a["core"].rlike(r"[\p{L}\p{N}]"), F.concat(a["lead"], a["core"], mark)).otherwise(F.col("word"))
    return recase(checked.withColumn("word", written), partition, order)


def windows(n: Column, window: int = 200, stride: int = 150) -> Column:
    """Overlapping windows over n items: array of struct(start, stop, keep_from, keep_to); kept interiors tile 0..n."""
    margin = max(0, (window - stride) // 2)
    last = F.greatest(F.ceil((n - window) / stride), F.lit(0)).cast("int")
    start = lambda k: k * stride
    one = lambda k: F.struct(
        start(k).alias("start"),
        F.least(start(k) + window, n).cast("int").alias("stop"),
        F.when(k == 0, 0).otherwise(start(k) + margin).alias("keep_from"),
        F.when(k == last, n).otherwise(start(k) + window - margin).cast("int").alias("keep_to"),
    )
    return F.transform(F.sequence(F.lit(0), last), one)


def window_spans(n: int, window: int = 200, stride: int = 150) -> list[tuple[int, int, int, int]]:
    """The same windows for one file, for code that runs beside a model: start, stop, keep_from, keep_to."""
    margin = max(0, (window - stride) // 2)
    last = max(-(-(n - window) // stride), 0)
    return [(k * stride, min(k * stride + window, n), k * stride + margin if k else 0, n if k == last else k * stride + window - margin) for k in range(last + 1)] if n else []
