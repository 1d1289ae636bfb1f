"""Record files as a stream: every new file of a folder is framed, parsed and handed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.sources import iso2709 as I


def read_stream(spark: SparkSession, path: str, kind: str = "bib", mode: str = "permissive", files_at_once: int = 100) -> DataFrame:
    """Records of the files that arrive; a broken record is a row with errors, or fails the query if mode is strict."""
    text = spark.readStream.option("lineSep", "\x1d").option("maxFilesPerTrigger", files_at_once).text(path)
    return I.parse(I.frames(text).where(F.octet_length("raw") > 1), kind, mode)


def latest_transaction() -> Column:
    """005 as a timestamp, null where it is none."""
    return F.try_to_timestamp(F.substring(E.control_value("005"), 1, 14), F.lit("yyyyMMddHHmmss"))


def first_versions(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Records without those whose control number came before; state is dropped once 005 is older than the watermark."""
    rows = records.withColumns({"at": latest_transaction(), "number": E.control_value("001")}).where("number IS NOT NULL AND at IS NOT NULL")
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["number"])


def counts_by_day(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Records of each day of 005 and record type."""
    rows = records.withColumn("at", latest_transaction()).where("at IS NOT NULL").withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 day").alias("day"), F.col("leader.record_type").alias("record_type")).count()
