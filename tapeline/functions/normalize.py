"""Text normalization for scoring: tokens of references and hypotheses, and looser keys for matching phrases."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import NUMBER, number_words

# Hesitations that may be dropped, annotations, ASCII punctuation.
FILLERS = ("um", "uh", "erm", "er", "hmm", "mm", "mhm", "uh-huh", "mm-hmm", "huh", "eh", "ah", "oh", "hm")
ANNOTATION = r"[\[\(\{][^\]\)\}]*[\]\)\}]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: White space of every script, and the separators that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Line ends beyond \n and \r\n count too.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


@dataclass(frozen=True)
class Rules:
    """How text becomes tokens. Digits are spelled out on the hypothesis side only, unless spell_reference."""

    lowercase: bool = True
    strip_annotations: bool = True
    split_hyphens: bool = True
    drop_fillers: bool = False
    spell_hypothesis: bool = True
    spell_reference: bool = False
    keep_apostrophes: bool = True


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """NFKC form. Only text beyond ASCII travels to Python; the rest crosses as nulls."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.when(plain, text), _nfkc(F.when(~plain, text)))


def strip_annotations(text: Column) -> Column:
    return F.regexp_replace(text, ANNOTATION, " ")


def words_of(text: Column) -> Column:
    """Runs between white space; none for blank text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def clean_token(token: Column, keep_apostrophes: bool = True) -> Column:
    """The word pieces of one token, without stray quotes at their edges."""
    straight = F.translate(token, "’", "'")
    bare = F.regexp_replace(straight, r"[^\p{L}\p{N}_']+" if keep_apostrophes else r"[^\p{L}\p{N}_]+", " ")
    return F.filter(F.transform(F.split(bare, " "), lambda p: F.trim(p, F.lit("'"))), lambda p: p != "")


def _pieces(text: Column, keep_apostrophes: bool) -> Column:
    """The word pieces of a whole text, as clean_token gives them for its words, by one pass and one split."""
    straight = F.translate(text, "’", "'")
    bare = F.regexp_replace(straight, r"[^\p{L}\p{N}_']+" if keep_apostrophes else r"[^\p{L}\p{N}_]+", " ")
    if keep_apostrophes:
        bare = F.when(F.contains(bare, F.lit("'")), F.regexp_replace(bare, "(?<![^ ])'+|'+(?![^ ])", "")).otherwise(bare)
    bare = F.trim(bare)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


def tokens(text: Column, rules: Rules = Rules(), reference: bool = True, compatible_form: bool = False) -> Column:
    """Scoring tokens as an array. compatible_form: the text is in NFKC form already (needed inside lambdas).

    Only texts with digits, on the side that spells them, are taken word by word.
    """
    out = text if compatible_form else compatible(text)
    if rules.strip_annotations:
        out = strip_annotations(out)
    if rules.lowercase:
        out = F.lower(out)
    if rules.split_hyphens:
        out = F.regexp_replace(out, "[-–—]", " ")
    spell = rules.spell_reference if reference else rules.spell_hypothesis

    def kept(found: Column) -> Column:
        return F.filter(found, lambda p: ~p.isin(*FILLERS)) if rules.drop_fillers else found

    plain = kept(_pieces(out, rules.keep_apostrophes))
    if not spell:
        return plain
    each = lambda t: F.when(t.rlike(NUMBER), F.split(number_words(t), " ")).otherwise(kept(clean_token(t, rules.keep_apostrophes)))
    return F.when(out.rlike("[0-9]"), F.flatten(F.transform(words_of(out), each))).otherwise(plain)


def lines_of_tokens(text: Column, rules: Rules = Rules(), reference: bool = True) -> Column:
    """One token array for each line that has tokens: the units that resampling draws."""
    lines = F.split(compatible(text), LINE_END)
    return F.filter(F.transform(lines, lambda line: tokens(line, rules, reference, compatible_form=True)), lambda x: F.size(x) > 0)


def phrase_key(text: Column) -> Column:
    """Lower case, without ASCII punctuation, single spaces: equal for variants of a stock phrase."""
    return F.array_join(words_of(F.translate(F.lower(text), PUNCTUATION, "")), " ")


def basic(text: Column) -> Column:
    """The plain normalizer: lower case and single spaces."""
    return F.array_join(words_of(F.lower(text)), " ")


def without_spaces(text: Column) -> Column:
    """For scripts written without word breaks."""
    return F.regexp_replace(text, SPACE + "+", "")


# Languages scored by characters only.
UNSEGMENTED = ("zh", "ja", "yue", "th", "lo", "my", "km")


def is_unsegmented(language: Column) -> Column:
    return F.coalesce(language.isin(*UNSEGMENTED), F.lit(False))
