"""Column expressions that several operators of this subpackage share. JVM side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of the contracts' words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space, in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def free_name(taken) -> str:
    """A column name that none of ``taken`` is, whatever the case of its letters."""
    low, name = {c.lower() for c in taken}, "_result"
    while name in low:
        name += "_"
    return name


def with_fields(found: DataFrame, keep) -> DataFrame:
    """The columns ``keep`` and the fields of the struct that is the last column of ``found``."""
    fields = found.schema[-1].dataType.names
    if both := {c.lower() for c in keep} & {c.lower() for c in fields}:
        raise ValueError(f"columns {sorted(both)} are results; rename them first")
    return found.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{found.columns[-1]}`")[c].alias(c) for c in fields])
