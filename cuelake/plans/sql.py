"""Everything that has no built-in function, by name in SQL, and the cue view."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.text import nfkc
from cuelake.operators import formatting, metrics
from cuelake.sources.captions import parse_captions
from cuelake.tables import cue_view


@F.udtf(returnType=T.StructType([T.StructField("op", T.StringType()), T.StructField("reference_at", T.IntegerType()), T.StructField("candidate_at", T.IntegerType())]))
class AlignTokens:
    """SELECT * FROM align_tokens(reference, candidate): the steps of a least-cost alignment."""

    def eval(self, reference: list, candidate: list):
        yield from metrics.align(reference or [], candidate or [])


@F.udtf(returnType=T.StructType([T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())]))
class SplitReadable:
    """SELECT * FROM split_readable(text, seconds): the pieces of a text that fit a caption."""

    def eval(self, text: str, seconds: float):
        yield from enumerate(formatting.parts(" ".join((text or "").split()), seconds or 0.0, formatting.Preferences()))


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Functions nfkc, wrap_lines, phrase_repeats and the table functions above; with a folder, the view ``cue``."""
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("wrap_lines", lambda t, n: None if t is None else formatting.lines(" ".join(t.split()), n), T.StringType())
    sizes = " ".join(f"WHEN at > {n} AND at + {n - 1} <= size(t) AND slice(t, greatest(at - {n}, 1), {n}) = slice(t, at, {n}) THEN {n}" for n in (5, 4, 3, 2))
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION phrase_repeats(t ARRAY<STRING>) RETURNS INT RETURN aggregate(
        filter(transform(sequence(3, greatest(size(t), 3)), at -> struct(at, CASE {sizes} ELSE 0 END AS size)), x -> x.size > 0),
        struct(0 AS free, 0 AS said), (now, x) -> CASE WHEN x.at < now.free THEN now ELSE struct(x.at + x.size AS free, now.said + x.size AS said) END, now -> now.said)"""
    )
    spark.udtf.register("align_tokens", AlignTokens)
    spark.udtf.register("split_readable", SplitReadable)
    if sf_dir:
        cue_view(spark, sf_dir).createOrReplaceTempView("cue")


def captions_view(spark: SparkSession, files, kind: str, name: str = "captions") -> None:
    """The parsed blocks of caption files as a view."""
    parse_captions(files, kind).createOrReplaceTempView(name)
