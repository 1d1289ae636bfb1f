"""MODS, MARC-8, errors, readers of bytes and files in memory, graphs."""

from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from quire import testkit
from quire.functions import marc8, mods
from quire.functions import expr as E
from quire.operators.unbibframe import _Walk
from quire.sources import iso2709 as I
from tests.test_records import GOOD, SF


def test_mods_collections_and_documents_that_cannot_be_read(spark):
    two = '<modsCollection xmlns="http://www.loc.gov/mods/v3"><mods><titleInfo><title>One &amp; all</title></titleInfo></mods><mods><titleInfo type="uniform"><title>Two</title></titleInfo><note/></mods></modsCollection>'
    rows = spark.createDataFrame([(1, two), (2, "<mods><titleInfo>"), (3, "<other/>"), (4, None)], "id int, xml string")
    got = {r.id: r.r for r in rows.select("id", mods.mods_records(F.col("xml")).alias("r")).collect()}
    assert [[(f.tag, f.subfields[0].value) for f in x.fields] for x in got[1]] == [[("245", "One & all")], [("246", "Two")]]
    assert [[e.code for e in got[i][0].errors] for i in (2, 3)] == [["E106"], ["E106"]] and got[4] is None


@pytest.mark.parametrize(
    ("mods_type", "code"),
    [("text", "a"), (" cartographic ", "e"), ("notated music", "c"), ("sound recording-musical", "i"), ("still image", "k"), ("moving image", "g"), ("computer resource", "m"), ("mixed material", "p"), ("unheard of", "a")],
)
def test_mods_resource_types(mods_type, code):
    assert mods.records_of(f"<mods><typeOfResource>{mods_type}</typeOfResource></mods>")[0]["leader"]["record_type"] == code


def test_mods_names_and_identifiers():
    name = lambda kind, role: f'<name type="{kind}"><namePart>N</namePart><role><roleTerm>{role}</roleTerm></role></name>'
    xml = "<mods>" + name("personal", "creator") * 2 + name("corporate", "creator") + name("conference", "editor") + "".join(f'<identifier type="{t}">1</identifier>' for t in ("lccn", "issn", "doi", "odd")) + "</mods>"
    fields = mods.records_of(xml)[0]["fields"]
    assert [f["tag"] for f in fields] == ["100", "700", "110", "711", "010", "022", "024", "024"]
    assert [f["ind1"] for f in fields[-2:]] == ["7", "8"] and fields[-2]["subfields"][1] == {"code": "2", "value": "doi"}


@pytest.mark.parametrize("text", ["plain", "Łodka øre", "жук и Жук", "αβγ Ω", "שלום", "H₂O x²", "سلام"])
def test_marc8_round_trips(text):
    assert marc8.decode(marc8.encode(text)) == text


def test_marc8_states():
    acute = "\u0301"
    assert marc8.decode(b"a\xe2e") == "\u00e1e"  # the mark stays before its letter, and composes with the one before
    assert marc8.decode(b"b\xe2e") == f"b{acute}e"
    assert marc8.decode(b"x\x1b") == "x\ufffd" and marc8.decode(b"\x1b$1!0!\x1bsok") == "\ufffdok"
    assert marc8.decode(b"\x1b(Q\x44\x1bs.") == "ё." and marc8.decode(b"a\x01\x0ab") == "a\nb" and marc8.decode(b"\xbb") == "\ufffd"
    assert marc8.encode("中ó") == b"??" and marc8.encode("Ł") == b"\x1b)E\xa1\x1bs"  # composed letters are not taken apart


def test_records_of_bytes_and_files():
    for source in (GOOD * 3, io.BytesIO(GOOD * 3)):
        got = list(I.records_of(source))
        assert [x["control"][0]["value"] for x in got] == ["x1"] * 3 and got[0]["errors"] == []
    with pytest.raises(I.MarcError):
        list(I.records_of(GOOD + b"x" * 30))


def test_errors_can_be_selected_filtered_and_exploded(spark):
    rows = spark.createDataFrame([(1, bytearray(GOOD)), (2, bytearray(GOOD[:-1])), (3, bytearray(b"x" + GOOD[1:]))], "rec_id long, raw binary")
    frames = rows.select("rec_id", F.lit("s").alias("source"), F.lit(None).cast("bigint").alias("rec_index"), F.lit(None).cast("bigint").alias("byte_offset"), "raw")
    got = I.parse(frames)
    assert [r.rec_id for r in got.where(F.size("errors") > 0).orderBy("rec_id").collect()] == [2, 3]
    assert [r.code for r in got.select("rec_id", F.explode("errors.code").alias("code")).orderBy("rec_id").collect()] == ["E005", "E001"]
    assert got.select("rec_id", "errors").count() == 3 and got.where(E.control_value("001") == "x1").count() == 2


def test_an_empty_graph_is_a_bare_record():
    got = _Walk([]).record()
    assert got["fields"] == [] and [c["tag"] for c in got["control"]] == ["008"] and len(got["control"][0]["value"]) == 40


def test_testkit_reads_as_many_partitions_as_there_are_cores(spark):
    assert testkit.bib(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
