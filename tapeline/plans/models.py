"""Plugs for models that run outside the engine: decoders, punctuators, translators, normalizers. Tests use deterministic stubs.

Each plug takes a factory that is called once per task, so weights load once, and works on Arrow or pandas batches. What
a model says is stored before it is used twice: no call is repeated, and an answer that varies is one answer.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.punctuation import affixes, apply_labels, window_spans
from ..functions.text import json_object
from ..operators.pairing import matched_replies
from ..schema import SEGMENT


class Decoder(Protocol):
    def transcribe(self, path: str, prompt: str | None = None) -> tuple[str | None, list[dict]]:
        """Language and segments (dicts of the segment columns but file and seg)."""


class Classifier(Protocol):
    def predict(self, windows: list[list[str]]) -> list[tuple[list[str], list[float]]]:
        """Labels and confidences of the words of each window."""


log = logging.getLogger(__name__)


def stored(rows: DataFrame) -> DataFrame:
    """rows, computed once: in the checkpoint folder where the session has one, else kept on executors' disks."""
    if rows.sparkSession.sparkContext.getCheckpointDir():
        return rows.checkpoint()
    return rows.persist(StorageLevel.DISK_ONLY)


def decode(media: DataFrame, factory: Callable[[], Decoder]) -> DataFrame:
    """Segments of every path, numbered. A path that yields nothing has no rows."""
    names = [f.name for f in SEGMENT.fields]

    def run(batches: Iterator[pd.DataFrame]):
        decoder = factory()
        for batch in batches:
            rows = [{"file": path, "seg": i, **s} for path in batch["path"] for i, s in enumerate(decoder.transcribe(path)[1])]
            yield pd.DataFrame(rows, columns=names)

    return media.select("path").mapInPandas(run, SEGMENT)


def guarded_transcribe(decoder: Decoder, path: str, prompt: str | None, language: str | None) -> tuple[str | None, list[dict]]:
    """Decode with a prompt; again without it if nothing came, or if the last file's and this one's languages are known and differ."""
    found, segments = decoder.transcribe(path, prompt)
    if prompt is not None and (not segments or (language and found and found != language)):
        return decoder.transcribe(path, None)
    return found, segments


_SENTENCE, _WORD = re.compile(r"(?s).*?[.?!] (.*)"), re.compile(r"(?s)[^ ]* (.*)")


def carried_tail(text: str, limit: int = 100) -> str | None:
    """What a file leaves to the next one's prompt, where it is decoded: the same as the column context_tail."""
    bare = text.strip()
    if len(bare) > limit:
        window = bare[-limit:]
        cut = _SENTENCE.match(window) or _WORD.match(window)
        bare = cut[1].strip() if cut else window
    return bare or None


def decode_in_order(media: DataFrame, factory: Callable[[], Decoder], carry_context: bool = False) -> DataFrame:
    """Segments of media (asset, seq, path): the files of an asset one after the other, in one task.

    With carry_context each file is decoded with the tail of the one before as prompt, and again without it where
    that looks harmful. A file without segments leaves no tail, and its language.
    """
    names = [f.name for f in SEGMENT.fields]

    def run(batches: Iterator[pd.DataFrame]):
        decoder, asset, tail, language = factory(), None, None, None
        for batch in batches:
            rows = []
            for one in batch.itertuples(index=False):
                if one.asset != asset:
                    asset, tail, language = one.asset, None, None
                found, segments = guarded_transcribe(decoder, one.path, tail, language) if carry_context else decoder.transcribe(one.path)
                rows += [{"file": one.path, "seg": i, **s} for i, s in enumerate(segments)]
                tail, language = carried_tail("".join(s["text"] for s in segments)), found
            yield pd.DataFrame(rows, columns=names)

    return media.select("asset", "seq", "path").repartition("asset").sortWithinPartitions("asset", "seq").drop("seq").mapInPandas(run, SEGMENT)


def label_words(cores: list[str], classifier: Classifier, window: int, stride: int, batch_size: int) -> tuple[list[str], list[float]]:
    """Labels of the words of a file from overlapping windows, batch_size of them in a call. Each word keeps the label of the window where it lies inside."""
    labels, confidences = [], []
    spans = window_spans(len(cores), window, stride)
    for k in range(0, len(spans), batch_size):
        part = spans[k : k + batch_size]
        answers = classifier.predict([cores[a:b] for a, b, _, _ in part])
        if len(answers) != len(part):
            raise ValueError("one answer for each window is needed")
        for (a, b, keep_from, keep_to), (names, sure) in zip(part, answers, strict=True):
            if len(names) != b - a or len(sure) != b - a:
                raise ValueError("one label and one confidence for each word are needed")
            labels += names[keep_from - a : keep_to - a]
            confidences += sure[keep_from - a : keep_to - a]
    return labels, confidences


def punctuate(words: DataFrame, factory: Callable[[], Classifier], threshold: float = 0.9, demote: bool = False, window: int = 200, stride: int = 150, batch_size: int = 16, required: bool = False, failures: Accumulator | None = None) -> DataFrame:
    """words (file, pos, word, ...) with marks and capitals.

    The model loads once a task and sees a file in overlapping windows. Files whose classifier fails or miscounts stay as they are: they
    are logged, and counted in `failures`; with `required`, they are errors.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields) + ", _core string, label string, confidence double"

    def run(batches: Iterator[pd.DataFrame]):
        classifier, held = None, []

        def close():
            nonlocal classifier
            rows = pd.concat(held)
            try:
                if classifier is None:
                    classifier = factory()
                labels, confidences = label_words(rows["_core"].tolist(), classifier, window, stride, batch_size)
            except Exception as problem:
                if required:
                    raise
                log.warning("%s stays without labels: %s", rows["file"].iloc[0], problem)
                if failures is not None:
                    failures.add(1)
                labels, confidences = [None] * len(rows), [None] * len(rows)
            return rows.assign(label=labels, confidence=confidences)

        for batch in batches:
            for _, rows in batch.groupby((batch["file"] != batch["file"].shift()).cumsum(), sort=False):
                if held and held[0]["file"].iloc[0] != rows["file"].iloc[0]:
                    yield close()
                    held = []
                held.append(rows)
        if held:
            yield close()

    cored = words.withColumn("_core", affixes(F.col("word"))["core"])
    labeled = stored(cored.repartition("file").sortWithinPartitions("file", "pos").mapInPandas(run, schema).drop("_core"))
    fine = labeled.where(F.col("label").isNotNull())
    failed = labeled.where(F.col("label").isNull()).select(*words.columns)
    return apply_labels(fine, ["file"], ["pos"], threshold, demote).select(*words.columns).unionByName(failed)


def normalized(texts: DataFrame, column: str, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """texts with a column put through an external normalizer, loaded once a task; nulls stay null."""
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]):
        normalize = factory()
        for batch in batches:
            made = pa.array([None if t is None else normalize(t) for t in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if n == column else batch.column(n) for n in names], names)

    return texts.mapInArrow(run, texts.schema)


def reattach(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments with rewritten words put back in their places, and text made of them anew. Times don't change."""
    packed = words.groupBy("file", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("start", "end", "word", "probability").alias("w")))).alias("_p"))
    both = segments.join(packed, ["file", "seg"], "left")
    new = F.transform("_p", lambda x: x["w"])
    has = F.col("_p").isNotNull()
    return both.withColumn("text", F.when(has, F.array_join(F.transform("_p", lambda x: x["w"]["word"]), "")).otherwise(F.col("text"))).withColumn("words", F.when(has, new).otherwise(F.col("words"))).select(*segments.columns)


def reply_items(reply: Column) -> Column:
    """The items of a translator's reply: array of struct(id, text); null if it isn't JSON."""
    return F.from_json(json_object(reply), "translations array<struct<id:int,text:string>>")["translations"]


def translate(sentences: DataFrame, ask: Callable[[list[str]], str], batch: int = 20, retries: int = 1) -> DataFrame:
    """sentences (file, sentence, text) with translated text; those that no reply covers, also alone, are dropped.

    ask: numbered texts to the reply's JSON.
    """
    numbered = sentences.withColumns({"batch": F.concat_ws("#", "file", F.floor(F.col("sentence") / batch)), "i": (F.col("sentence") % batch + 1).cast("int")})

    def replies(rows: DataFrame) -> DataFrame:
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("i")
            return pd.DataFrame({"batch": group["batch"].iloc[:1], "raw": [ask(group["text"].tolist())]})

        raw = stored(rows.groupBy("batch").applyInPandas(one, "batch string, raw string"))  # each call is made once
        return raw.select("batch", F.posexplode(reply_items(F.col("raw"))).alias("seq", "r")).select("batch", "seq", F.col("r.id").alias("id"), F.col("r.text").alias("reply"))

    done = stored(matched_replies(numbered, replies(numbered)))
    found, missing = done.where(F.col("reply").isNotNull()), done.where(F.col("reply").isNull()).drop("reply")
    for _ in range(retries):
        alone = missing.withColumns({"batch": F.concat_ws("#", "batch", F.col("i").cast("string")), "i": F.lit(1)})
        again = stored(matched_replies(alone, replies(alone)))
        found, missing = found.unionByName(again.where(F.col("reply").isNotNull())), again.where(F.col("reply").isNull()).drop("reply")
    return found.withColumn("text", F.col("reply")).select(*sentences.columns)
