"""What the operators share: column shielding, shared-folder tables, size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that stands for a null doc_id inside the operators.
NULL_ID = -(1 << 63)
#: A side is broadcast up to this many bytes (rows times a row's width); beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.sparkContext.__dict__.setdefault("_quire_dir", "file://" + tempfile.mkdtemp(prefix="quire-"))
    return at.rstrip("/")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    spark = table.sparkSession
    for at in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are no longer referenced."""
    import gc
    import time

    for _ in range(2):  # the second time for what the first one's finalisers let go
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def small(df: DataFrame, width: int) -> DataFrame:
    """df (a stored table), marked for broadcast if its rows times width stay under BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Sets the session's Arrow batch size to what an operator needs: whole texts come in few rows, so that the JVM's and the workers' buffers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def may_be_in(key, keys: DataFrame, bits: int = 1 << 26):
    """Whether a hash (bigint column) may be among keys (its one column): false only where it is not.

    A bitmap of fixed size (8 MB) is broadcast, so rows that cannot meet the keys need not be shuffled to a join with them.
    """
    spot = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    words = keys.groupBy(F.shiftright(spot, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    bitmap = np.zeros(max(1, bits // 64), np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def may(spots: pa.Array) -> pa.Array:
        at = spots.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return may(F.pmod(key, F.lit(bits)))


class Shield:
    """A table under positional names, so that clashing or repeated column names can do no harm.

    The columns asked for are found by exact name first, by case-insensitive name else; one that is
    absent is null.  ``rows`` has every column as in0, in1, ...; ``restore`` gives the names back.
    """

    def __init__(self, docs: DataFrame, **types: str):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"in{i}" for i in range(len(self.names))])
        self.at = {}
        for name in types:
            exact = [i for i, x in enumerate(self.names) if x == name] or [i for i, x in enumerate(self.names) if x.lower() == name]
            self.at[name] = f"in{exact[0]}" if exact else None
        self.types = types

    def col(self, name: str):
        at = self.at[name]
        return (F.col(at) if at else F.lit(None)).cast(self.types[name])

    def picked(self) -> DataFrame:
        return self.rows.select(*[self.col(n).alias(n) for n in self.types])

    def keyed(self) -> DataFrame:
        """doc_id (null as NULL_ID), text_hash (tells texts of one id apart) and text."""
        return self.rows.select(self.key("doc_id"), self.key("text_hash"), self.col("text").alias("text"))

    def key(self, name: str):
        return (F.coalesce(self.col("doc_id"), F.lit(NULL_ID)) if name == "doc_id" else F.xxhash64(self.col("text"))).alias(name)

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*[f"in{i}" for i in range(len(self.names))]).toDF(*self.names)


def shield(docs: DataFrame) -> Shield:
    return Shield(docs, doc_id="bigint", text="string")


def null_id(column):
    return F.nullif(column, F.lit(NULL_ID))
