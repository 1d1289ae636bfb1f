"""The long table: one row for each subfield (and each control value, with a null code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.schema import CONTROL, FIELD


def to_long(records: DataFrame) -> DataFrame:
    """Two generators in one scan and no shuffle; code_occ numbers the values of one code in a field."""
    lead = F.transform("control", lambda c: F.struct(c["tag"].alias("tag"), F.lit(None).cast("int").alias("tag_rank"), c["occ"].alias("occ"), F.lit(None).cast("string").alias("ind1"), F.lit(None).cast("string").alias("ind2"), F.lit(None).cast("int").alias("sf_pos"), F.lit(None).cast("string").alias("code"), F.lit(0).alias("code_occ"), c["value"].alias("value")))
    rest = F.flatten(
        F.transform(
            "fields",
            lambda f: F.transform(
                f["subfields"],
                lambda s, i: F.struct(f["tag"].alias("tag"), f["tag_rank"].alias("tag_rank"), f["occ"].alias("occ"), f["ind1"].alias("ind1"), f["ind2"].alias("ind2"), i.alias("sf_pos"), s["code"].alias("code"), F.size(F.filter(F.slice(f["subfields"], F.lit(1), i), lambda t: t["code"] == s["code"])).alias("code_occ"), s["value"].alias("value")),
            ),
        )
    )
    return records.select("rec_id", "kind", F.inline(F.concat(lead, rest)))


def from_long(long: DataFrame) -> DataFrame:
    """(rec_id, control, fields) again: one shuffle by record."""
    data = F.col("code").isNotNull()
    control = F.struct("tag", "occ", "value")
    field = F.struct("tag_rank", "occ", "tag", "ind1", "ind2", "sf_pos", "code", "value")
    rows = long.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.when(~data, control))).alias("control"), F.array_sort(F.collect_list(F.when(data, field))).alias("f"))
    heads = F.array_distinct(F.transform("f", lambda x: F.struct(x["tag_rank"].alias("tag_rank"), x["occ"].alias("occ"), x["tag"].alias("tag"), x["ind1"].alias("ind1"), x["ind2"].alias("ind2"))))
    whole = F.transform(
        heads,
        lambda h: F.struct(
            h["tag"].alias("tag"), h["tag_rank"].alias("tag_rank"), h["occ"].alias("occ"), h["ind1"].alias("ind1"), h["ind2"].alias("ind2"),
            F.transform(F.filter("f", lambda x: (x["tag_rank"] == h["tag_rank"]) & (x["occ"] == h["occ"])), lambda x: F.struct(x["code"].alias("code"), x["value"].alias("value"))).alias("subfields"),
        ),
    )
    return rows.select("rec_id", F.col("control").cast(f"array<{CONTROL}>").alias("control"), whole.cast(f"array<{FIELD}>").alias("fields"))


def write_long(long: DataFrame, path: str) -> None:
    """Partitioned by kind and sorted by tag and code within files, so that row groups can be skipped."""
    long.repartitionByRange("kind", "tag", "code").sortWithinPartitions("kind", "tag", "code").write.partitionBy("kind").parquet(path)


def control_first(long: DataFrame) -> DataFrame:
    """Rows in the order that readers and writers give them."""
    return long.orderBy("rec_id", F.col("code").isNotNull(), "tag_rank", "occ", "sf_pos")


