"""Reading, salvaging, writing and converting single records made by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quire import testkit
from quire.functions import codecs as C
from quire.functions import expr as E
from quire.functions import scalars as S
from quire.plans import dsl as D
from quire.sources import iso2709 as I
from quire.sources import marc

SF = "/root/testdata/sf0.001"


def make(fields, leader="nam a", kind_extra=""):
    """A record's bytes from (tag, body) pairs, bodies without their terminators."""
    directory, data = b"", b""
    for tag, body in fields:
        body = body.encode() + b"\x1e"
        directory += tag.encode() + b"%04d%05d" % (len(body), len(data))
        data += body
    base = 24 + len(directory) + 1
    return b"%05d" % (base + len(data) + 1) + leader.encode() + b"22" + b"%05d" % base + b" a 4500" + directory + b"\x1e" + data + b"\x1d"


GOOD = make([("001", "x1"), ("700", "1 \x1faOne"), ("650", " 0\x1faTopic\x1fxSub\x1faAgain"), ("700", "1 \x1faTwo é")])


def codes(raw, **options):
    return [e["code"] for e in I.parse_bytes(raw, mode="permissive", **options)["errors"]]


def test_tags_are_grouped_in_order_of_first_appearance():
    got = I.parse_bytes(GOOD)
    assert [(f["tag"], f["tag_rank"], f["occ"]) for f in got["fields"]] == [("700", 0, 0), ("700", 0, 1), ("650", 1, 0)]
    assert got["control"] == [{"tag": "001", "occ": 0, "value": "x1"}]
    assert [s["value"] for s in got["fields"][2]["subfields"]] == ["Topic", "Sub", "Again"]


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        (b"x" + GOOD[1:], "E001"),
        (b"00010" + GOOD[5:], "E001"),
        (GOOD[:12] + b"x0000" + GOOD[17:], "E003"),
        (GOOD[:12] + b"00010" + GOOD[17:], "E003"),
        (GOOD[:12] + b"99999" + GOOD[17:], "E004"),
        (GOOD[:10] + b"x" + GOOD[11:], "E002"),
        (GOOD[:-3], "E005"),
        (GOOD[:-1] + b"x", "E006"),
        (GOOD[:27] + b"x" + GOOD[28:], "E101"),
    ],
)
def test_strict_reading_fails_with_the_code(raw, code):
    with pytest.raises(I.MarcError) as error:
        I.parse_bytes(raw)
    assert error.value.code == code


def test_salvage():
    assert codes(GOOD) == [] and codes(GOOD[:-1] + b"x") == []
    assert "E005" in codes(GOOD[:-6])
    assert codes(GOOD[:27] + b"x" + GOOD[28:]) == ["E101"]
    assert codes(make([("245", "10aX")])) == ["E106"] and I.parse_bytes(make([("245", "10aX")]), mode="permissive")["fields"] == []
    assert codes(make([("245", "x0\x1faX")]), validation="strict_marc") == ["E201"]
    assert codes(make([("245", "10\x1f\x01X")]), validation="strict_marc") == ["E202"]
    assert codes(make([("245", "10\x1faX")]).replace(b"aX", b"a\xff"), validation="strict_marc") == ["E301"]
    assert I.parse_bytes(b"123") is None
    with pytest.raises(I.MarcError):
        I.parse_bytes(GOOD, kind="authority", mode="permissive")


def test_the_fast_reader_agrees_with_the_salvaging_one(spark):
    odd = [GOOD, GOOD[:-1], b"x" * 30, make([("00A", "  \x1faX")]), make([("245", "10")]), make([("245", "10\x1fa\x1fb")]), make([]), GOOD.replace(b"One", b"O\xffe"), make([("LDR", "x"), ("245", "1 \x1faT")]), make([("001", ""), ("001", "b")])]
    rows = [(i, "s", None, None, bytearray(r)) for i, r in enumerate(odd)]
    frames = spark.createDataFrame(rows, "rec_id bigint, source string, rec_index bigint, byte_offset bigint, raw binary")
    fast = {r.rec_id: r for r in I.parse(frames).collect()}
    slow = {r.rec_id: r.p for r in frames.select("rec_id", I.parse_slow(F.col("raw")).alias("p")).collect()}
    assert len(fast) == len(odd)
    for i in slow:
        assert (fast[i].leader, fast[i].control, fast[i].fields) == (slow[i].leader, slow[i].control, slow[i].fields), i


def test_files_round_trip(spark, tmp_path):
    records = testkit.bib(spark, SF)
    marc.write(records, str(tmp_path / "out"))
    want = sorted((r.control[0].value, r.fields) for r in records.select("control", "fields").collect())
    for framing in ("terminator", "length"):
        got = marc.read(spark, str(tmp_path / "out"), framing=framing)
        assert sorted((r.control[0].value, r.fields) for r in got.select("control", "fields").collect()) == want
    assert marc.format_of("a/b.mrc") == "marc" and marc.format_of("a.xml") is None
    with pytest.raises(ValueError):
        marc.read(spark, "x.xml")


def test_streamed_files(spark, tmp_path):
    from quire.streaming import files

    marc.write(testkit.bib(spark, SF).limit(20), str(tmp_path / "in"))
    stream = files.read_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.table("streamed").count() == 20


def test_repeated_codes_collapse_in_plain_json_only(spark):
    frame = spark.createDataFrame([(1, "s", None, None, bytearray(GOOD))], "rec_id bigint, source string, rec_index bigint, byte_offset bigint, raw binary")
    row = I.parse(frame).select(C.to_json().alias("j"), C.to_marcjson().alias("m"), C.to_csv().alias("c")).first()
    assert json.loads(row.j)[4]["650"]["subfields"] == {"a": "Again", "x": "Sub"}
    assert json.loads(row.m)[4]["650"]["subfields"] == [{"a": "Topic"}, {"x": "Sub"}, {"a": "Again"}]
    assert row.c.splitlines()[:3] == ["tag,ind1,ind2,subfield_code,value", "001,,,x1", "700,1, ,a,One"]


def test_scalars(spark):
    rows = spark.createDataFrame([("0-306-40615-2",), ("080442957X",), ("080442957x",), ("9780306406157",), ("9780306406158",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(S.isbn_valid(F.col("s"))).collect()] == [True, True, False, True, False, False, False]
    years = spark.createDataFrame([("c1925",), ("[19--?]",), ("c19",), ("12345",), ("",)], "s string")
    assert [r[0] for r in years.select(S.year_of(F.col("s"))).collect()] == [1925, None, 1900, 1234, None]
    links = spark.createDataFrame([("245-01",), ("245-01/(3/r",), ("880-123/$1",), ("245-01\n",), ("x",)], "s string")
    got = [r[0] for r in links.select(S.linkage(F.col("s"))).collect()]
    assert [None if g is None else (g.tag, g.occurrence, g.script, g.is_reverse) for g in got] == [("245", "01", None, False), ("245", "01", "(3", True), ("880", "123", "$1", False), None, None]


def test_the_query_language_has_no_look_around():
    assert D.java_pattern("a$") == "(?U)a\\z" and D.java_pattern("[$]") == "(?U)[$]"
    for pattern in ("(?=a)", "(?<!a)", r"(a)\1"):
        with pytest.raises(ValueError):
            D.SubfieldPatternQuery("245", "a", pattern)
    assert E.CONTROL
