"""Records derived from the driver's tables, row by row and without Python: the input of the queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.schema import ERROR, LEADER

LANGS = ("eng", "ger", "fre", "spa")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, where a table of few row groups has fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def leader(record_type: Column | str = "a", level: Column | str = "m", status: Column | str = "n", coding: Column | str = "a", encoding: Column | str = " ", form: Column | str = "a") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = {"record_length": 0, "record_status": status, "record_type": record_type, "bibliographic_level": level, "control_record_type": " ", "character_coding": coding, "indicator_count": 2, "subfield_code_count": 2, "data_base_address": 0, "encoding_level": encoding, "cataloging_form": form, "multipart_level": " ", "reserved": "4500"}
    return F.struct(*[lit(v).alias(n) for n, v in values.items()]).cast(LEADER)


def record(rows: DataFrame, rec_id: Column, kind: str, lead: Column, control: list[tuple[str, Column]], fields: list[Column]) -> DataFrame:
    """A record table from columns: control fields and fields (arrays of fields) whose value is null are left out."""
    listed = F.filter(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(0).alias("occ"), v.cast("string").alias("value")) for t, v in control]), lambda c: c["value"].isNotNull())
    whole = F.struct(
        rec_id.cast("bigint").alias("rec_id"), F.lit(kind).alias("kind"), F.lit("testkit").alias("source"), F.lit(None).cast("bigint").alias("rec_index"), F.lit(None).cast("bigint").alias("byte_offset"),
        lead.alias("leader"), E.regroup_control(listed).alias("control"), E.regroup(F.flatten(F.array(*fields))).alias("fields"), F.array().cast(f"array<{ERROR}>").alias("errors"),
    )
    return spread(rows).select(F.inline(F.array(whole)))  # a generator: what reads a record does not build it again


def one(tag: str, ind1: str, ind2: str | Column, *subs: tuple[str, Column], when: Column | None = None) -> Column:
    """An array of the one field, or of none."""
    made = F.array(E.field(tag, ind1, ind2, E.subfields(*subs)))
    return made if when is None else F.when(when, made).otherwise(F.slice(made, 1, 0))


def isbn(k: Column) -> Column:
    """978 and nine digits of k with the check digit; every fifth is spoiled."""
    body = F.concat(F.lit("978"), F.lpad(k.cast("string"), 9, "0"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda n, i: n + F.when(i % 2 == 1, 1).otherwise(3) * F.substring(body, i, F.lit(1)).cast("int"))
    check = (10 - total % 10) % 10
    return F.concat(body, F.when(k % 5 == 0, (check + 1) % 10).otherwise(check).cast("string"))


def bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliographic record for each part."""
    part = table(spark, sf_dir, "part")
    k, name, brand, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    s = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    text = lambda n: (k % n).cast("string")
    year = (1990 + k % 35).cast("string")
    lang = F.when(k % 13 == 0, "   ").otherwise(F.element_at(F.array(*[F.lit(x) for x in LANGS]), (k % 4 + 1).cast("int")))
    c008 = s("240101", "s", F.when(k % 11 == 0, "0000").otherwise(year), "    ", "xxu", " " * 17, lang, " d")
    topics = F.transform(F.split(kind, " "), lambda w, i: E.field("650", " ", F.when(i == 0, "0").otherwise("1"), F.concat(F.array(E.subfield("a", w)), F.when(k % 3 == 0, F.array(E.subfield("x", s("History ", i.cast("string"))))).otherwise(F.array().cast("array<struct<code string,value string>>")))))
    date = F.when(k % 10 == 3, s("c", year)).when(k % 10 == 7, "[19--?]").otherwise(year)
    return record(
        part, k, "bib",
        leader(F.when(k % 7 == 0, "c").when(k % 7 == 1, "g").otherwise("a"), F.when(k % 5 == 0, "s").otherwise("m")),
        [("001", k), ("008", c008)],
        [
            one("020", " ", " ", ("a", isbn(k))),
            one("100", "1", " ", ("a", s("Author ", text(50))), ("d", s("19", F.lpad(text(90), 2, "0"), "-")), when=k % 6 != 0),
            one("110", "2", " ", ("a", s("Corporation ", text(12))), when=k % 6 == 0),
            one("245", "1", "0", ("6", F.when(k % 4 == 0, "880-01")), ("a", name), ("c", s("by ", brand))),
            one("700", "1", " ", ("a", s("Contributor ", text(17))), ("d", F.when(k % 2 == 0, s("b. ", year)))),
            one("260", " ", " ", ("a", s("City ", text(10))), ("b", F.when(k % 3 != 0, s("Publisher ", text(20)))), ("c", date), when=k % 2 == 0),
            one("264", " ", "1", ("a", s("Town ", text(10))), ("b", s("Press ", text(20))), ("c", date), when=(k % 2 == 1) & (k % 9 != 0)),
            one("300", " ", " ", ("a", s(F.col("p_size").cast("string"), " pages"))),
            one("490", "0", " ", ("a", brand), when=k % 3 == 1),
            one("504", " ", " ", ("a", s("Bibliography ", text(8)))),
            one("500", " ", " ", ("a", s("Note ", text(7)))),
            topics,
            one("651", " ", "0", ("a", s("Place ", text(9))), when=k % 4 == 1),
            one("700", "1", " ", ("a", s("Editor ", text(23))), when=k % 3 == 0),
            one("852", " ", " ", ("a", s("Library ", text(5))), ("b", s("Branch ", text(3)))),
            one("880", "1", "0", ("6", F.lit("245-01/$1")), ("a", s("Ω ", name)), when=k % 4 == 0),
        ],
    )


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each part with the rarer fields, and with a fault of each kind in every so many."""
    k = F.col("p_partkey")
    s = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    every = lambda n, x: F.when(k % n == 0, x)
    odd = E.field("246", F.when(k % 19 == 0, "\x07").otherwise("1"), " ", F.array(F.struct(F.when(k % 13 == 0, " ").otherwise("a").alias("code"), F.lit("Other title").alias("value"))))
    filler = F.transform(F.sequence(F.lit(1), F.when(k % 50 == 0, 11).otherwise(1)), lambda _: E.field("599", " ", " ", E.subfields(("a", F.when(k % 50 == 0, F.lit("y" * 9_900)).otherwise("y")))))
    return record(
        table(spark, sf_dir, "part"), k, "bib",
        leader("a", "m", F.when(k % 5 == 0, "q").otherwise("n"), F.when(k % 4 == 0, " ").otherwise("a")),
        [("001", F.when(k % 7 != 0, k)), ("008", F.when(k % 11 != 0, F.lit("240101s1999    xxu" + " " * 17 + "eng d")))],
        [
            one("010", " ", " ", ("a", s("lccn", k.cast("string"))), when=k % 2 == 0),
            one("022", " ", " ", ("a", s("1234-", F.lpad((k % 1000).cast("string"), 4, "0"))), when=k % 3 == 0),
            one("024", " ", " ", ("a", s("other", k.cast("string"))), when=k % 4 == 1),
            one("086", " ", " ", ("a", s("D ", k.cast("string"))), when=k % 5 == 1),
            one("130", "0", " ", ("a", s("Uniform ", F.col("p_brand"))), when=k % 6 == 1),
            one("222", " ", "0", ("a", s("Key title ", k.cast("string"))), when=k % 3 == 1),
            one("245", "1", F.when(k % 6 == 0, "x").otherwise("0"), ("a", F.col("p_name"))),
            F.array(odd),
            one("500", " ", " ", ("a", F.coalesce(every(3, F.lit("\x1b(Babc")), F.lit("plain")))),
            one("501", " ", " ", ("a", F.coalesce(every(8, F.lit("éàü")), F.lit("plain")))),
            one("520", " ", " ", ("a", F.coalesce(every(9, F.lit("x" * 10_000)), F.lit("short")))),
            F.array(E.field("650", F.when(k % 10 == 3, "5").otherwise(" "), "0", E.subfields(("a", F.lit("Topic"))))),
            filler,
        ],
    )


def broken(frames: DataFrame) -> DataFrame:
    """Every third record cut short by a byte, every third with a bad length."""
    raw = F.col("raw")
    return frames.withColumn("raw", F.when(F.col("rec_id") % 3 == 0, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).when(F.col("rec_id") % 3 == 1, F.concat(F.lit(b"x"), F.substring(raw, F.lit(2), F.octet_length(raw)))).otherwise(raw))


def folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; in local mode, where it is unset, in one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.sparkContext.__dict__.setdefault("_quire_files", "file://" + tempfile.mkdtemp(prefix="quire-"))
    return f"{at.rstrip('/')}/files-{uuid.uuid4().hex}"


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One authority record for each customer: personal names, and every third a corporate one."""
    rows = table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    s = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    kinds, levels = (F.array(*[F.lit(x) for x in t]) for t in ("abcdefg", "abcdn"))
    c008 = s("240101", "n||", F.element_at(kinds, (k % 7 + 1).cast("int")), " " * 23, F.element_at(levels, (k % 5 + 1).cast("int")), " " * 6)
    return record(
        rows, k, "authority", leader("z", " ", encoding=F.when(k % 2 == 0, "n").otherwise(" "), form=F.when(k % 6 == 0, "i").otherwise("a")),
        [("001", k), ("008", c008)],
        [
            one("110", "2", " ", ("a", name), ("x", F.when(k % 2 == 0, F.lit("History"))), ("v", F.when(k % 4 == 0, F.lit("Maps"))), when=k % 3 == 0),
            one("100", "1", " ", ("a", name), ("d", F.lit("1950-")), when=k % 3 != 0),
            one("400", "1", " ", ("a", s("Variant of ", name)), when=k % 2 == 0),
            one("499", " ", " ", ("a", F.lit("Odd tracing")), when=k % 10 == 0),
            one("510", "2", " ", ("a", s("See also ", (k % 9).cast("string"))), when=k % 4 == 0),
            one("670", " ", " ", ("a", s("Source ", F.col("c_mktsegment")))),
            one("671", " ", " ", ("a", F.lit("Not found")), when=k % 5 == 0),
            one("680", " ", " ", ("a", s("Scope ", F.col("c_mktsegment"))), when=k % 2 == 1),
            one("700", "1", "7", ("a", s("Linked ", (k % 6).cast("string"))), when=k % 6 == 0),
        ],
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One holdings record for each supplier."""
    rows = table(spark, sf_dir, "supplier")
    k, name = F.col("s_suppkey"), F.col("s_name")
    s = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    pick = lambda text, n: F.substring(F.lit(text), (k % n + 1).cast("int"), F.lit(1))
    c008 = s("240101", pick("01234", 5), pick("ufglmpe?", 8), "        ", pick("1234 ", 5), " " * 15)
    return record(
        rows, k, "holdings", leader(pick("xyvu", 4), " "),
        [("001", k), ("008", c008)],
        [
            one("852", "0", " ", ("a", s("Lib ", (k % 4).cast("string"))), ("b", s("Branch ", (k % 3).cast("string"))), ("h", name)),
            one("853", " ", " ", ("8", F.lit("1")), ("a", F.lit("v."))),
            one("854", " ", " ", ("a", F.lit("suppl.")), when=k % 2 == 0),
            one("863", " ", " ", ("8", F.lit("1.1")), ("a", (k % 12).cast("string"))),
            one("866", " ", " ", ("a", s("v.1-", (k % 12).cast("string")))),
            one("090", " ", " ", ("a", s("LOCAL ", k.cast("string"))), when=k % 3 == 0),
            one("050", " ", "4", ("a", s("QA ", k.cast("string")))),
            one("500", " ", " ", ("a", F.lit("Holding note"))),
            one("505", " ", " ", ("a", F.lit("Second note")), when=k % 2 == 1),
            one("876", " ", " ", ("a", s("item ", k.cast("string"))), when=k % 2 == 0),
        ],
    )
