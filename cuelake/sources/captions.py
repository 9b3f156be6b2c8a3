"""Caption files and project documents as DataFrames. Whole files are rows; cues come from split and explode, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.time import parse_timestamp
from cuelake.operators.cues import in_order

WORD = T.ArrayType(
    T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("startTime", T.DoubleType()), T.StructField("endTime", T.DoubleType()), T.StructField("confidence", T.DoubleType())]
    )
)
CUE = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("index", T.IntegerType()),
            T.StructField("startTime", T.DoubleType()),
            T.StructField("endTime", T.DoubleType()),
            T.StructField("text", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("words", WORD),
        ]
    )
)
PROJECT = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("appName", T.StringType()),
                    T.StructField("schemaVersion", T.IntegerType()),
                    T.StructField("exportedAt", T.StringType()),
                    T.StructField("videoFileName", T.StringType()),
                    T.StructField("videoDuration", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("subtitles", CUE),
        T.StructField("formatting", T.MapType(T.StringType(), T.StringType())),
        T.StructField("transcriptionSettings", T.MapType(T.StringType(), T.StringType())),
    ]
)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, content) of whole text files; the media is the file's name without its extension."""
    name = F.regexp_extract("_metadata.file_path", "([^/]+)\\.[^./]+$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("media_id"), F.col("value").alias("content"))


def parse_captions(df: DataFrame, kind: str, content: str = "content", strict: bool = False) -> DataFrame:
    """``df`` with a row for each block of its SubRip ("srt") or WebVTT ("vtt") content: block, start_time, end_time, text, warning.

    Blocks are parted by blank lines. The first line with an arrow is the timing, all lines after it the text, WebVTT settings are
    dropped; notes, style blocks and blocks of one line in SubRip are skipped. A block without a valid timing has nulls and a
    warning, or fails the query if ``strict``.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(content), "^\\uFEFF", ""), "\\r\\n?", "\n")
    if kind == "vtt":
        text = F.regexp_replace(text, "^\\s*WEBVTT[^\\n]*(\\n|$)", "")
    blocks = F.split(F.trim(F.regexp_replace(text, "^\\s+|\\s+$", "")), "\\n[ \\t]*\\n\\s*")
    rows = df.select(*[c for c in df.columns if c != content], F.posexplode(blocks).alias("block", "_block"))
    lines = F.filter(F.split("_block", "\n", -1), lambda x: F.trim(x) != "")
    rows = rows.withColumn("_lines", lines).where(F.size("_lines") >= (2 if kind == "srt" else 1))
    at = F.array_position(F.transform("_lines", lambda x: x.contains("-->")), True)
    rows = rows.withColumn("_at", at.cast("int"))
    if kind == "vtt":
        rows = rows.where(~F.col("_lines")[0].rlike("^(NOTE|STYLE|REGION)\\b") & (F.col("_at") > 0))
    sides = F.split(F.get("_lines", F.col("_at") - 1), "-->")
    side = lambda k: parse_timestamp(F.split(F.trim(F.get(sides, F.lit(k))), "\\s+")[0])
    rows = rows.withColumns({"start_time": F.when(F.col("_at") > 0, side(0)), "end_time": F.when(F.col("_at") > 0, side(1))})
    bad = F.col("start_time").isNull() | F.col("end_time").isNull()
    why = F.when(F.col("_at") == 0, "no timing line").when(bad, "malformed timing")
    if strict:
        why = F.when(bad, F.raise_error(F.concat(F.lit("malformed timing in block "), F.col("block").cast("string"))))
    rows = rows.withColumns({c: F.when(~bad, F.col(c)) for c in ("start_time", "end_time")})
    body = F.array_join(F.slice("_lines", F.col("_at") + 1, F.size("_lines")), "\n")
    return rows.withColumns({"text": F.when(~bad, body), "warning": why}).drop("_block", "_lines", "_at")


def cues(parsed: DataFrame) -> DataFrame:
    """Valid rows of ``parse_captions`` as cues: media_id, ord, start_time, end_time, text, index."""
    rows = parsed.where("warning IS NULL").withColumnRenamed("block", "ord").drop("warning")
    return rows.withColumn("index", F.row_number().over(in_order()))


def read_captions(spark: SparkSession, path: str, kind: str, strict: bool = False) -> DataFrame:
    return cues(parse_captions(files(spark, path), kind, strict=strict))


def parse_projects(df: DataFrame, app: str, content: str = "content") -> DataFrame:
    """``df`` with project (null if it cannot be read) and errors. Validation of the cues themselves is no structural error."""
    parsed = F.from_json(F.col(content), PROJECT, {"mode": "PERMISSIVE"})
    rows = df.withColumn("project", parsed)
    meta = F.col("project.metadata")
    rules = [
        F.when(F.col("project").isNull() | (meta.isNull() & F.col("project.subtitles").isNull()), "not a project document"),
        F.when(~meta["appName"].eqNullSafe(F.lit(app)), "unknown application"),
        F.when(~meta["schemaVersion"].eqNullSafe(F.lit(1)), "unsupported schema version"),
        F.when(F.col("project.subtitles").isNull(), "no cue list"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*rules)))


def project_cues(projects: DataFrame) -> DataFrame:
    """Cues of readable projects: rows without numbers and text are dropped, missing ids are ``imported-n``."""
    rows = projects.where(F.size("errors") == 0).select("media_id", F.posexplode("project.subtitles").alias("ord", "c"))
    rows = rows.where(F.col("c.startTime").isNotNull() & F.col("c.endTime").isNotNull() & F.col("c.text").isNotNull())
    name = F.coalesce("c.id", F.concat(F.lit("imported-"), (F.col("ord") + 1).cast("string")))
    whole = F.filter("c.words", lambda w: w["text"].isNotNull() & w["startTime"].isNotNull() & w["endTime"].isNotNull())
    words = F.transform(whole, lambda w: F.struct(w["text"].alias("text"), w["startTime"].alias("start_time"), w["endTime"].alias("end_time"), w["confidence"].alias("confidence")))
    out = rows.select("media_id", "ord", name.alias("id"), F.col("c.startTime").alias("start_time"), F.col("c.endTime").alias("end_time"), "c.text", "c.confidence", words.alias("words"))
    return out.withColumn("index", F.row_number().over(in_order()))


def project_documents(rows: DataFrame, app: str) -> DataFrame:
    """(media_id, content): a project document of each media's cues, keys as in ``PROJECT``."""
    cue = F.struct(F.col("index"), F.col("start_time").alias("startTime"), F.col("end_time").alias("endTime"), F.col("text"))
    listed = F.array_sort(F.collect_list(cue))
    meta = F.struct(F.lit(app).alias("appName"), F.lit(1).alias("schemaVersion"))
    return rows.groupBy("media_id").agg(listed.alias("subtitles")).select("media_id", F.to_json(F.struct(meta.alias("metadata"), "subtitles")).alias("content"))


def write_files(df: DataFrame, path: str, content: str = "content") -> None:
    """One folder a media with its text in it, written by Spark's committer."""
    df.select("media_id", F.col(content).alias("value")).write.mode("overwrite").partitionBy("media_id").text(path)


def canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``fingerprint``: SHA-256 of a JSON of the columns in name order, nulls left out."""
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
