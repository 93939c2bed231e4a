"""Column layouts of timed transcripts, tags, subtitle cues and score tables."""

from pyspark.sql import types as T

WORD = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("word", T.StringType()), T.StructField("probability", T.DoubleType())])

SEGMENT = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("seg", T.IntegerType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("avg_logprob", T.DoubleType()),
        T.StructField("no_speech_prob", T.DoubleType()),
        T.StructField("compression_ratio", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("words", T.ArrayType(WORD)),
    ]
)

INFO = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("model", T.StringType()),
        *(T.StructField(n, T.DoubleType()) for n in ("probability", "avg_logprob", "no_speech_prob", "compression_ratio", "temperature", "min_word_probability", "mean_word_probability")),
    ]
)

TAG = T.StructType(
    [
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("tag", T.StringType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("source_media", T.StringType()),
        T.StructField("track", T.StringType()),
        T.StructField("additional_info", INFO),
        T.StructField("frame_info", T.StringType()),
    ]
)

TAG_MESSAGE = T.StructType([T.StructField("type", T.StringType()), T.StructField("data", TAG)])

EXCERPT = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("id", "film", "srt_project_doc", "primary_category")),
        T.StructField("secondary_categories", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.StringType()) for n in ("start", "end", "cue_range", "scene", "why")),
        T.StructField("watch_vocab", T.ArrayType(T.StringType())),
    ]
)

EXCERPT_FILE = T.StructType([T.StructField("meta", T.StructType([T.StructField("purpose", T.StringType()), T.StructField("categories", T.MapType(T.StringType(), T.StringType())), T.StructField("notes", T.StringType())])), T.StructField("excerpts", T.ArrayType(EXCERPT))])
