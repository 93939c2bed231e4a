"""Context carried from file to file: in batch by order, in streams by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.text import context_tail


def prompts(files: DataFrame, key: str = "asset", order: str = "seq") -> DataFrame:
    """files with the prompt for each: the tail of the text before it, and that text's language. The first has none."""
    by = W.partitionBy(key).orderBy(order)
    return files.withColumns({"prompt": F.lag(context_tail(F.col("text"))).over(by), "previous_language": F.lag("language").over(by)})


OUTPUT = "asset string, seq long, prompt string, previous_language string"


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each file gets what the one before left; tails come as a column, made before the state."""
    tail, language = state.get if state.exists else (None, None)
    for batch in batches:
        rows = batch.sort_values("seq", kind="stable")
        known = rows[["tail", "language"]].astype(object).where(rows[["tail", "language"]].notna(), None)
        before = [(tail, language), *known.itertuples(index=False, name=None)]
        tail, language = before[-1]
        yield pd.DataFrame({"asset": key[0], "seq": rows["seq"].to_numpy(), "prompt": [t for t, _ in before[:-1]], "previous_language": [x for _, x in before[:-1]]})
    state.update((tail, language))


def prompts_stream(files: DataFrame) -> DataFrame:
    """A stream of (asset, seq, text, language) with prompts, one state of a tail and a language for each asset."""
    tails = files.select("asset", "seq", "language", context_tail(F.col("text")).alias("tail"))
    return tails.groupBy("asset").applyInPandasWithState(_carry, OUTPUT, "tail string, language string", "append", "NoTimeout")


def windowed_words(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Word counts by event-time window for streams of (ts, words); rows later than `delay` are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.sum("words").alias("words"))
