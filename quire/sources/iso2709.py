"""ISO 2709: records as bytes.

Clean records are read and written by Column expressions on the JVM.  Only records that fail a cheap test of
cleanness go to the salvaging reader, which recovers what it can and says what it could not.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions import expr as E
from quire.functions import scalars as S
from quire.schema import CONTROL, ERROR, FIELD, INDICATOR_RULES, LEADER, SLUGS

RS, FT, SD = b"\x1d", b"\x1e", b"\x1f"
LONGEST_RECORD, LONGEST_FIELD = 99_999, 9_999
PARSED = f"struct<leader {LEADER}, control array<{CONTROL}>, fields array<{FIELD}>, errors array<{ERROR}>>"
KIND_TYPES = {"authority": "z", "holdings": "xyvu"}
_LEADER_NUMBER = re.compile(r"\+?[0-9]+\Z")
_PARTS = S._PLACES


# the salvaging reader -----------------------------------------------------------------------------------------


class MarcError(Exception):
    """What is wrong with a record; ``info`` has the columns of the error struct."""

    def __init__(self, code: str, message: str, **info):
        super().__init__(f"{code} {SLUGS.get(code, '')}: {message}")
        self.info = {"code": code, "slug": SLUGS.get(code), "message": message, **info}

    @property
    def code(self) -> str:
        return self.info["code"]


class _Reader:
    """One record: what was found in it, and where reading stands."""

    def __init__(self, raw: bytes, kind: str, mode: str, validation: str, index: int | None, offset: int | None):
        self.raw, self.kind, self.strict, self.checked = raw, kind, mode.lower() in ("strict", "failfast"), validation == "strict_marc"
        self.index, self.offset, self.errors, self.number = index, offset, [], None

    def error(self, code: str, message: str, at: int | None = None, **info) -> MarcError:
        near = None if at is None else self.raw[max(0, at - 16) : at + 16]
        return MarcError(code, message, record_index=self.index, byte_offset=None if at is None else (self.offset or 0) + at, record_byte_offset=at, record_control_number=self.number, bytes_near=near, **info)

    def note(self, error: MarcError) -> None:
        if self.strict:
            raise error
        self.errors.append(error.info)

    def leader(self) -> dict:
        text, out = self.raw[:24].decode("latin-1"), {}
        for name, at, size in _PARTS:
            part = text[at : at + size]
            if name in S._NUMBERS:
                if not _LEADER_NUMBER.match(part):
                    raise self.error({"record_length": "E001", "data_base_address": "E003"}.get(name, "E002"), f"{name} is no number: {part!r}", at, found=part.encode())
                part = int(part)
            out[name] = part
        for bad, code, name in ((out["record_length"] < 24, "E001", "record_length"), (out["data_base_address"] < 24, "E003", "data_base_address"), (out["data_base_address"] > out["record_length"], "E004", "data_base_address")):
            if bad:
                raise self.error(code, f"{name} is {out[name]}", 0 if name == "record_length" else 12, found=str(out[name]).encode())
        return out

    def read(self) -> dict:
        leader = self.leader()
        if self.checked and (bad := bad_leader(leader, self.kind)):
            self.note(self.error("E002", bad, 0))
        allowed = KIND_TYPES.get(self.kind)
        if allowed and leader["record_type"] not in allowed:
            raise self.error("E106", f"record type {leader['record_type']!r} is not one of {allowed}", 6, found=leader["record_type"].encode())
        length, base = leader["record_length"], leader["data_base_address"]
        raw = self.raw[:length]
        self.cut_short = len(raw) < length
        if self.cut_short:
            self.note(self.error("E005", "the record is shorter than its leader says", len(raw), expected_length=length, actual_length=len(raw)))
        elif raw[-1:] != RS and self.strict:
            raise self.error("E006", "no record terminator", len(raw) - 1, found=raw[-1:])
        control, fields = [], []
        for tag, at, body in self.entries(raw, base):
            try:
                if is_control(tag):
                    value = self.control_value(tag, body, at)
                    if tag == "001" and self.number is None:
                        self.number = value
                    control.append((tag, value))
                else:
                    fields.append((tag, *self.data_field(tag, body, at)))
            except MarcError as error:
                self.note(error)
        return {"leader": leader, "control": _grouped_control(control), "fields": grouped(fields), "errors": self.errors}

    def entries(self, raw: bytes, base: int) -> Iterator[tuple[str, int, bytes]]:
        at, data = 24, raw[base:]
        while at < min(base, len(raw)) and raw[at : at + 1] != FT:
            entry = raw[at : min(at + 12, base)]
            if len(entry) < 12:
                self.note(self.error("E101", "the directory ends within an entry", at, found=entry))
                return
            tag, size, start = entry[:3], entry[3:7], entry[7:12]
            if not tag.isascii() or not (size + start).isdigit():
                code = "E106" if self.cut_short and self.kind == "bib" else "E101"
                self.note(self.error(code, "no directory entry", at, found=entry, expected="3 ASCII characters and 9 digits"))
            else:
                name, first, last = tag.decode(), int(start), int(start) + int(size)
                if name != "LDR":
                    if last > len(data):
                        self.note(self.error("E106", "the field lies past the data", at, field_tag=name, expected_length=last, actual_length=len(data)))
                    if first < len(data) or last <= len(data):
                        yield name, base + first, data[first:last]
            at += 12

    def text(self, raw: bytes, at: int, tag: str) -> str:
        try:
            return raw.decode("utf-8", "strict" if self.checked else "replace")
        except UnicodeDecodeError as x:
            raise self.error("E301", "the text is not UTF-8", at + x.start, field_tag=tag, found=raw[x.start : x.start + 1]) from x

    def control_value(self, tag: str, body: bytes, at: int) -> str:
        return self.text(body.rstrip(FT + SD) if self.kind == "authority" else body[:-1], at, tag)

    def data_field(self, tag: str, body: bytes, at: int) -> tuple[str, str, list[tuple[str, str]]]:
        least = {"authority": 2, "holdings": 3}.get(self.kind, 2)
        if len(body) < least:
            raise self.error("E106", "the field has no indicators", at, field_tag=tag, found=body, expected_length=least, actual_length=len(body))
        for i in (0, 1):
            if self.checked:
                rule = INDICATOR_RULES.get(tag, (" 0123456789",) * 2)[i]
                if body[i : i + 1] not in (b" ", *(b"%d" % d for d in range(10))) or chr(body[i]) not in rule:
                    raise self.error("E201", "bad indicator", at + i, field_tag=tag, indicator_position=i, found=body[i : i + 1], expected=f"one of {rule!r}")
        subs, p = [], 2
        while p < len(body) and body[p] != 0x1E:
            if body[p] != 0x1F:
                if self.kind == "bib":
                    raise self.error("E106", "a subfield delimiter was expected", at + p, field_tag=tag, found=body[p : p + 1])
                p += 1
                continue
            p += 1
            if p >= len(body):
                break
            code = body[p]
            if self.checked and not 33 <= code <= 126:
                raise self.error("E202", "bad subfield code", at + p, field_tag=tag, subfield_code=chr(code), found=bytes([code]))
            p += 1
            ends = [x for x in (body.find(SD, p), body.find(FT, p)) if x >= 0]
            end = min(ends, default=len(body))
            subs.append((chr(code), self.text(body[p:end], at + p, tag)))
            p = end
        return chr(body[0]), chr(body[1]), subs


def is_control(tag: str) -> bool:
    return len(tag) == 3 and tag.isdigit() and tag[:2] == "00"


def bad_leader(leader: dict, kind: str) -> str | None:
    """What the strict rules say against a leader."""
    from quire.functions.validate import LEADER_RULES

    for name, allowed in LEADER_RULES[kind].items():
        if leader[name] not in allowed:
            return f"{name} {leader[name]!r} is not one of {allowed!r}"
    return next((f"{n} is not 2" for n in ("indicator_count", "subfield_code_count") if leader[n] != 2), None)


def _grouped_control(pairs: list[tuple[str, str]]) -> list[dict]:
    by: dict[str, list[str]] = {}
    for tag, value in pairs:
        by.setdefault(tag, []).append(value)
    return [{"tag": t, "occ": i, "value": v} for t, values in by.items() for i, v in enumerate(values)]


def grouped(fields: list[tuple[str, str, str, list[tuple[str, str]]]]) -> list[dict]:
    """Fields grouped by tag, tags in the order in which they first appear."""
    by: dict[str, list] = {}
    for tag, *rest in fields:
        by.setdefault(tag, []).append(rest)
    return [
        {"tag": t, "tag_rank": rank, "occ": occ, "ind1": i1, "ind2": i2, "subfields": [{"code": c, "value": v} for c, v in subs]}
        for rank, (t, group) in enumerate(by.items())
        for occ, (i1, i2, subs) in enumerate(group)
    ]


def parse_bytes(raw: bytes, kind: str = "bib", mode: str = "strict", validation: str = "structural", index: int | None = None, offset: int | None = None) -> dict | None:
    """leader, control, fields and errors of one record; None where there are under 24 bytes; MarcError where it can't be read."""
    return None if len(raw) < 24 else _Reader(raw, kind, mode, validation, index, offset).read()


def salvage(raw: bytes, kind: str, mode: str, validation: str, index: int | None = None, offset: int | None = None) -> dict | None:
    """As parse_bytes, but a record that can't be read is one with an error alone (where the mode is not strict)."""
    try:
        return parse_bytes(raw, kind, mode, validation, index, offset)
    except MarcError as error:
        if mode.lower() in ("strict", "failfast"):
            raise
        return {"leader": None, "control": [], "fields": [], "errors": [error.info]}


def _arrow(ddl: str) -> pa.DataType:
    return to_arrow_type(T._parse_datatype_string(ddl))


def parse_slow(raw: Column, kind: str = "bib", mode: str = "permissive", validation: str = "structural") -> Column:
    """PARSED of each binary value, by the salvaging reader."""

    target = _arrow(PARSED)

    @F.arrow_udf(PARSED)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else salvage(x, kind, mode, validation) for x in column.to_pylist()], target)

    return run.asNondeterministic()(raw)  # so that it stays a column of its own, never a part of a filter or a generator


# the fast reader ----------------------------------------------------------------------------------------------


def _bytes(raw: Column, at: int | Column, size: int | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(raw, lit(at), lit(size))


def is_clean(raw: Column) -> Column:
    """Whether the fast reader gives what the salvaging one would; any doubt says no."""
    head = _bytes(raw, 1, 24).cast("string")
    size, base = head.substr(1, 5).try_cast("int"), head.substr(13, 5).try_cast("int")
    directory = _bytes(raw, 25, base - 25).cast("string")
    data = _bytes(raw, base + 1, size).cast("string")
    return F.coalesce(
        F.is_valid_utf8(raw.cast("string"))
        & head.rlike(r"^[0-9]{5}[ -~]{5}[0-9]{7}[ -~]{7}\z")
        & (size == F.octet_length(raw))
        & (base >= 25)
        & (base < size)
        & (_bytes(raw, base, 1) == F.lit(FT))
        & directory.rlike(r"^(?:(?!LDR)[!-~]{3}[0-9]{9})*+\z")
        # control fields without marks, data fields of two indicators and whole subfields, then the end
        & data.rlike("^(?:[^\x1d-\x1f]*+\x1e|[ -~]{2}(?:\x1f[!-~][^\x1d-\x1f]*+)*+\x1e)*+\x1d\\z"),
        F.lit(False),
    )


def parse_fast(raw: Column) -> Column:
    """struct(leader, control, fields, whole) of a clean record; whole: every entry fits a field exactly."""
    head = _bytes(raw, 1, 24).cast("string")
    base, size = head.substr(13, 5).try_cast("int"), head.substr(1, 5).try_cast("int")
    directory = _bytes(raw, 25, base - 25).cast("string")

    def entry(i: Column) -> Column:
        at = i * 12
        length, start = F.substring(directory, at + 4, F.lit(4)).cast("int"), F.substring(directory, at + 8, F.lit(5)).cast("int")
        return F.struct(F.substring(directory, at + 1, F.lit(3)).alias("tag"), length.alias("length"), start.alias("start"), _bytes(raw, base + 1 + start, length).cast("string").alias("body"))

    def made(entries: Column) -> Column:
        fits = F.forall(entries, lambda e: (e["length"] > 0) & (base + e["start"] + e["length"] < size) & (F.locate("\x1e", e["body"]) == F.length(e["body"])) & (E.is_control_tag(e["tag"]) | e["body"].rlike("^[ -~]{2}(?:\x1f|\x1e)")))
        control = F.transform(F.filter(entries, lambda e: E.is_control_tag(e["tag"])), lambda e: F.struct(e["tag"].alias("tag"), F.lit(0).alias("occ"), e["body"].substr(F.lit(1), F.length(e["body"]) - 1).alias("value")))
        data = F.transform(
            F.filter(entries, lambda e: ~E.is_control_tag(e["tag"])),
            lambda e: F.struct(
                e["tag"].alias("tag"), F.lit(0).alias("tag_rank"), F.lit(0).alias("occ"), e["body"].substr(1, 1).alias("ind1"), e["body"].substr(2, 1).alias("ind2"),
                F.transform(F.slice(F.split(e["body"].substr(F.lit(3), F.length(e["body"]) - 3), "\x1f"), F.lit(2), F.lit(10_000)), lambda s: F.struct(s.substr(1, 1).alias("code"), s.substr(F.lit(2), F.length(s)).alias("value"))).alias("subfields"),
            ),
        )
        return F.struct(S.parse_leader(_bytes(raw, 1, 24)).alias("leader"), E.regroup_control(control).alias("control"), E.let(data, E.regroup).alias("fields"), fits.alias("whole"))

    count = ((base - 25) / 12).cast("int")
    return E.let(F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), entry)).otherwise(F.array().cast("array<struct<tag string, length int, start int, body string>>")), made)


def parse(frames: DataFrame, kind: str = "bib", mode: str = "permissive", validation: str = "structural", keep_raw: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Framed bytes (rec_id, source, rec_index, byte_offset, raw) as records; one scan, no shuffle; keep: other columns that stay.

    Strict: a record that can't be read fails the job.  Permissive: it is a row with its errors.  Tails of
    under 24 bytes are the end of a file and give no row.
    """
    frames = frames.where(F.octet_length("raw") >= 24)
    if kind == "bib" and validation == "structural":
        rows = E.once(frames, q_fast=F.when(is_clean(F.col("raw")), parse_fast(F.col("raw"))))
        rows = E.once(rows, q_ok=F.coalesce(F.col("q_fast.whole"), F.lit(False)), q_doubt=F.when(~F.coalesce(F.col("q_fast.whole"), F.lit(False)), F.col("raw")))
        rows = rows.withColumn("q_slow", parse_slow(F.col("q_doubt"), kind, mode, validation))
        pick = lambda name: F.when(F.col("q_ok"), F.col(f"q_fast.{name}")).otherwise(F.col(f"q_slow.{name}"))
        errors = F.coalesce(F.col("q_slow.errors"), F.array().cast(f"array<{ERROR}>"))
    else:
        rows = frames.withColumn("q_slow", parse_slow(F.col("raw"), kind, mode, validation))
        pick = lambda name: F.col(f"q_slow.{name}")
        errors = F.col("q_slow.errors")
    out = ["rec_id", F.lit(kind).alias("kind"), "source", "rec_index", "byte_offset", *[pick(n).alias(n) for n in ("leader", "control", "fields")], errors.alias("errors")]
    return rows.select(*out, *(["raw"] if keep_raw else []), *keep)


def parse_from_bytes(raw: Column, kind: str = "bib", mode: str = "strict", validation: str = "structural") -> Column:
    """PARSED of single values, bytes after the record's length ignored."""
    return parse_slow(raw, kind, mode, validation)


# writing ------------------------------------------------------------------------------------------------------


def encode_field(f: Column) -> Column:
    """A data field's bytes, terminator included, as text."""
    return F.concat(f["ind1"], f["ind2"], F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit("\x1f"), s["code"], s["value"])), ""), F.lit("\x1e"))


def _entry(tag: Column, body: Column) -> Column:
    return F.struct(tag.alias("tag"), body.alias("body"), F.octet_length(body).alias("n"))


def _number(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def encode(kind: str = "bib", leader: str | Column = "leader", control: str | Column = "control", fields: str | Column = "fields") -> Column:
    """struct(raw, error): the record as bytes with its directory and lengths, or E404 where it does not fit.

    Bibliographic records leave out control fields with tags from 010 on.
    """
    leader, control, fields = (F.col(x) if isinstance(x, str) else x for x in (leader, control, fields))
    kept = F.filter(control, lambda c: c["tag"] < "010") if kind == "bib" else control
    parts = F.concat(F.transform(kept, lambda c: _entry(c["tag"], F.concat(c["value"], F.lit("\x1e")))), F.transform(fields, lambda f: _entry(f["tag"], encode_field(f))))

    def made(p: Column) -> Column:
        data = F.array_join(p["body"], "")
        base, start = F.size(p) * 12 + 25, F.struct(F.lit(0).alias("at"), F.lit("").alias("d"))
        directory = F.aggregate(p, start, lambda s, e: F.struct((s["at"] + e["n"]).alias("at"), F.concat(s["d"], e["tag"], _number(e["n"], 4), _number(s["at"], 5)).alias("d")))["d"]
        length = base + F.octet_length(data) + 1
        text = F.concat(S.leader_text(leader.withField("record_length", length).withField("data_base_address", base)), directory, F.lit("\x1e"), data, F.lit("\x1d"))
        error = (
            F.when(F.exists(p, lambda e: ~e["tag"].rlike(r"^[\x00-\x7f]{3}\z")), "E404 tag is not three ASCII characters")
            .when(F.exists(p, lambda e: e["n"] > LONGEST_FIELD), "E404 field too long")
            .when(length > LONGEST_RECORD, "E404 record too long")
            .when(F.length(leader["reserved"]) != 4, "E002 reserved part of the leader")
        )
        return F.struct(F.when(error.isNull(), text.cast("binary")).alias("raw"), error.alias("error"))

    return E.let(parts, made)


def encoded(records: DataFrame, kind: str = "bib", mode: str = "strict", keep: tuple[str, ...] = ()) -> DataFrame:
    """(rec_id, raw, error) and the columns of keep.  Strict: a record that does not fit fails the job."""
    rows = records.select("rec_id", *keep, E.let(encode(kind), lambda x: x).alias("e")).select("rec_id", *keep, "e.raw", "e.error")
    return rows.withColumn("raw", F.when(F.col("error").isNull(), F.col("raw")).otherwise(F.raise_error("error").cast("binary"))) if mode == "strict" else rows


# framing ------------------------------------------------------------------------------------------------------


def frames(text: DataFrame) -> DataFrame:
    """(rec_id, source, rec_index, byte_offset, raw) from a ``text`` scan split at 0x1D; files split at any byte.

    In a stream rec_id is a hash of file and bytes, as rows have no numbers there.
    """
    raw = F.concat(F.col("value").cast("binary"), F.lit(RS))
    number = F.xxhash64("_metadata.file_path", "value") if text.isStreaming else F.monotonically_increasing_id()
    return text.select(number.alias("rec_id"), F.col("_metadata.file_path").alias("source"), F.lit(None).cast("bigint").alias("rec_index"), F.lit(None).cast("bigint").alias("byte_offset"), raw.alias("raw"))


def boundaries(frames_: DataFrame) -> DataFrame:
    """(source, rec_index, byte_offset, length): one window for each file."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("rec_id")
    before = F.sum(F.octet_length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return frames_.select("source", F.row_number().over(order).cast("bigint").alias("rec_index"), F.coalesce(before, F.lit(0)).alias("byte_offset"), F.octet_length("raw").alias("length"))


def positioned(frames_: DataFrame) -> DataFrame:
    """Frames with rec_index (from 1) and byte_offset within each file."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("rec_id")
    before = F.sum(F.octet_length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return frames_.withColumns({"rec_index": F.row_number().over(order).cast("bigint"), "byte_offset": F.coalesce(before, F.lit(0)).cast("bigint")})


def by_length(source: bytes | BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of records framed by their leaders, one in memory at a time; a bad length ends the stream with MarcError E001."""
    at = 0
    with io.BytesIO(source) if isinstance(source, bytes) else source as stream:
        while len(lead := stream.read(24)) == 24:
            head = lead[:5].decode("latin-1")
            if not _LEADER_NUMBER.match(head) or int(head) < 24:
                raise MarcError("E001", f"record length {head!r}", byte_offset=at)
            yield at, lead + stream.read(int(head) - 24)
            at += int(head)


def records_of(source: bytes | BinaryIO, kind: str = "bib", mode: str = "strict", validation: str = "structural") -> Iterator[dict]:
    """Records of bytes in memory or of an open file, without Spark: leader, control, fields and errors of each."""
    for index, (offset, raw) in enumerate(by_length(source), 1):
        yield salvage(raw, kind, mode, validation, index, offset)


def capped(records: DataFrame, most: int = 10_000) -> DataFrame:
    """Records until a file's errors exceed the cap; the record that does so gets E099 and is the last."""
    if not most:
        return records
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("rec_id")
    n = F.sum(F.size("errors")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fatal = F.from_json(F.lit('{"code":"E099","slug":"fatal_reader_error","message":"more errors than allowed"}'), ERROR)
    rows = records.withColumn("q_n", n).withColumn("q_before", F.col("q_n") - F.size("errors")).where(F.col("q_before") <= most)
    return rows.withColumn("errors", F.when(F.col("q_n") > most, F.concat("errors", F.array(fatal))).otherwise(F.col("errors"))).drop("q_n", "q_before")
