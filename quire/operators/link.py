"""Linked-script joins within records: $6 and 880, on nested rows or on one row for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.functions import scalars as S


def linkage_of(field: Column) -> Column:
    """The parsed $6 of a field (its first one), or null."""
    return S.linkage(E.value_of(field, "6"))


def occurrence_of(field: Column) -> Column:
    return linkage_of(field)["occurrence"]


# nested: no shuffle -------------------------------------------------------------------------------------------


def linked_fields(field: Column) -> Column:
    """All 880 fields with the field's occurrence number (their tag part is not compared)."""
    return E.let(occurrence_of(field), lambda at: F.filter(E.fields_of("880"), lambda f: F.coalesce(occurrence_of(f) == at, F.lit(False))))


def linked_field(field: Column) -> Column:
    return F.get(linked_fields(field), 0)


def original_field(field: Column) -> Column:
    """The first field that an 880 stands for: tag and occurrence both agree; null for any other field."""
    found = E.let(linkage_of(field), lambda at: F.filter("fields", lambda f: F.coalesce((f["tag"] == at["tag"]) & (occurrence_of(f) == at["occurrence"]), F.lit(False))))
    return F.when(field["tag"] == "880", F.get(found, 0))


def field_pairs(tag: str) -> Column:
    """Every field of a tag with its first linked 880, or null."""
    return F.transform(E.fields_of(tag), lambda f: F.struct(f.alias("field"), linked_field(f).alias("linked")))


linked_field_pairs = field_pairs


def linked_by_occurrence(occurrence: str) -> Column:
    """Every field, 880 included, with an occurrence number."""
    return F.filter("fields", lambda f: F.coalesce(occurrence_of(f) == occurrence, F.lit(False)))


# relational: equi-joins on the long table ---------------------------------------------------------------------


def links(long: DataFrame) -> DataFrame:
    """(rec_id, tag, occ, linked_tag, occurrence) of the fields with a parsable first $6; the filter reaches the scan."""
    at = S.linkage(F.col("value"))
    rows = long.where("code = '6' AND code_occ = 0").select("rec_id", "tag", "occ", at.alias("l")).where("l IS NOT NULL")
    return rows.select("rec_id", "tag", "occ", F.col("l.tag").alias("linked_tag"), F.col("l.occurrence").alias("occurrence"))


def linked_pairs(long: DataFrame) -> DataFrame:
    """(rec_id, tag, occ, linked_occ): each field other than an 880 with every 880 of its occurrence number."""
    at = links(long)
    left = at.where("tag <> '880'").select("rec_id", "tag", "occ", "occurrence")
    right = at.where("tag = '880'").select("rec_id", F.col("occ").alias("linked_occ"), "occurrence")
    return left.join(right, ["rec_id", "occurrence"]).drop("occurrence")


def first_linked(long: DataFrame, tag: str) -> DataFrame:
    """Every field of a tag, left outer, with its first linked 880."""
    heads = long.where((F.col("tag") == tag) & (F.col("sf_pos") == 0)).select("rec_id", "tag", "occ")
    pairs = linked_pairs(long).where(F.col("tag") == tag).groupBy("rec_id", "tag", "occ").agg(F.min("linked_occ").alias("linked_occ"))
    return heads.join(pairs, ["rec_id", "tag", "occ"], "left")


def originals(long: DataFrame) -> DataFrame:
    """(rec_id, occ, original_tag, original_occ): every 880 with the first field that it stands for."""
    at = links(long)
    right = at.select("rec_id", F.col("tag").alias("linked_tag"), F.col("occ").alias("original_occ"), "occurrence")
    rows = at.where("tag = '880'").select("rec_id", "occ", "linked_tag", "occurrence").join(right, ["rec_id", "linked_tag", "occurrence"])
    return rows.groupBy("rec_id", "occ", F.col("linked_tag").alias("original_tag")).agg(F.min("original_occ").alias("original_occ"))


def occurrence_rank(long: DataFrame) -> DataFrame:
    """The first value of every tag and code of a record."""
    order = Window.partitionBy("rec_id", "tag", "code").orderBy("occ", "sf_pos")
    return long.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
