"""Scalar functions on text: ISBN, years, linkage, leader bytes, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import LEADER, LEADER_CODES


def isbn_normalize(text: Column) -> Column:
    return F.translate(text, "- ", "")


def _digit(text: Column, at: Column) -> Column:
    return F.try_to_number(F.substring(text, at, F.lit(1)), F.lit("9")).cast("int")


def isbn10_valid(text: Column) -> Column:
    """Ten characters, digits but for a last upper-case X, weighted sum divisible by 11."""
    s = isbn_normalize(text)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda n, i: n + (11 - i) * F.when(F.substring(s, i, F.lit(1)) == "X", 10).otherwise(_digit(s, i)))
    return F.coalesce(F.when(s.rlike(r"^[0-9]{9}[0-9X]\z"), total % 11 == 0), F.lit(False))


def isbn13_valid(text: Column) -> Column:
    """Thirteen digits with prefix 978 or 979, weights 1 and 3, sum divisible by 10."""
    s = isbn_normalize(text)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda n, i: n + F.when(i % 2 == 1, 1).otherwise(3) * _digit(s, i))
    return F.coalesce(F.when(s.rlike(r"^97[89][0-9]{10}\z"), total % 10 == 0), F.lit(False))


def isbn_valid(text: Column) -> Column:
    n = F.length(isbn_normalize(text))
    return F.when(n == 10, isbn10_valid(text)).when(n == 13, isbn13_valid(text)).otherwise(False)


def year_of(text: Column) -> Column:
    """The first four digits in a row; else the digits at the very end, filled up with zeros on the right."""
    run = F.nullif(F.regexp_extract(text, "([0-9]{4})", 1), F.lit(""))
    tail = F.rpad(F.nullif(F.regexp_extract(text, r"([0-9]{1,3})\z", 1), F.lit("")), 4, "0")
    return F.coalesce(run, tail).cast("int")


def publication_statement(place: Column, publisher: Column, date: Column) -> Column:
    """``place : publisher, date`` without the parts that are missing."""
    head = F.nullif(F.concat_ws(" : ", place, publisher), F.lit(""))
    return F.concat_ws(", ", head, date)


def linkage(text: Column) -> Column:
    """$6 as struct(tag, occurrence, script, is_reverse), null where it is no linkage."""
    pattern = r"^(?U)(\d{3})-(\d{2,3})(?:/([(\$][A-Za-z0-9]))?(?:/r)?\z"
    part = lambda i: F.regexp_extract(text, pattern, i)
    found = F.struct(part(1).alias("tag"), part(2).alias("occurrence"), F.nullif(part(3), F.lit("")).alias("script"), text.endswith("/r").alias("is_reverse"))
    return F.when(text.rlike(pattern), found)


def occurrence_lax(text: Column) -> Column:
    """The text after the first hyphen up to a slash, or null."""
    return F.when(text.contains("-"), F.split_part(F.substring(text, F.instr(text, "-") + 1, F.length(text)), F.lit("/"), F.lit(1)))


_PLACES = (("record_length", 0, 5), ("record_status", 5, 1), ("record_type", 6, 1), ("bibliographic_level", 7, 1), ("control_record_type", 8, 1), ("character_coding", 9, 1), ("indicator_count", 10, 1), ("subfield_code_count", 11, 1), ("data_base_address", 12, 5), ("encoding_level", 17, 1), ("cataloging_form", 18, 1), ("multipart_level", 19, 1), ("reserved", 20, 4))
_NUMBERS = {"record_length", "indicator_count", "subfield_code_count", "data_base_address"}


def parse_leader(raw: Column) -> Column:
    """The leader struct of 24 bytes of Latin-1 text (binary), null numbers where they are none."""
    text = F.decode(raw, "ISO-8859-1")

    def part(name: str, at: int, size: int) -> Column:
        piece = F.substring(text, at + 1, size)
        return (F.when(piece.rlike(r"^\+?[0-9]+\z"), piece.try_cast("int")) if name in _NUMBERS else piece).alias(name)

    return F.struct(*[part(*p) for p in _PLACES]).cast(LEADER)


def leader_text(leader: Column) -> Column:
    """The 24 characters of a leader struct."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(*[pad(leader[n], size) if n in _NUMBERS else leader[n] for n, _, size in _PLACES])


def leader_error(leader: Column) -> Column:
    """The code of the first error that reading a leader finds, or null."""
    return (
        F.when(leader["record_length"].isNull() | (leader["record_length"] < 24), "E001")
        .when(leader["data_base_address"].isNull() | (leader["data_base_address"] < 24), "E003")
        .when(leader["indicator_count"].isNull() | leader["subfield_code_count"].isNull(), "E002")
        .when(leader["data_base_address"] > leader["record_length"], "E004")
    )


def describe_leader_value(position: int, value: Column) -> Column:
    """The label of a code at a leader position, null where there is none."""
    table = LEADER_CODES.get(position)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value) if table else F.lit(None).cast("string")


def leader_value_valid(position: int, value: Column) -> Column:
    """Whether a code is in a position's set; positions without a set take anything."""
    return value.isin(*LEADER_CODES[position]) if position in LEADER_CODES else F.lit(True)


def encoding_of(leader_char: Column) -> Column:
    return F.when(leader_char == " ", "marc8").when(leader_char == "a", "utf8")


def decode_utf8(raw: Column) -> Column:
    """Strict UTF-8: null where the bytes are not valid."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def detect_encoding(text: Column) -> Column:
    """MARC-8 where there is an escape sequence, UTF-8 where there is a character beyond ASCII, else null."""
    return F.when(text.rlike("(?s)\\x1b."), "marc8").when(F.octet_length(text) > F.length(text), "utf8")


SCRIPTS = (("zh", "\\x{4E00}-\\x{9FFF}"), ("ja", "\\x{3040}-\\x{30FF}"), ("ko", "\\x{AC00}-\\x{D7AF}"), ("ar", "\\x{0600}-\\x{06FF}"), ("he", "\\x{0590}-\\x{05FF}"), ("ru", "\\x{0400}-\\x{04FF}"), ("el", "\\x{0370}-\\x{03FF}"))


def script_language(text: Column) -> Column:
    """The language suggested by the first character in a known script."""
    first = F.regexp_extract(text, "([" + "".join(r for _, r in SCRIPTS) + "])", 1)
    out = F.lit(None).cast("string")
    for lang, block in reversed(SCRIPTS):
        out = F.when(first.rlike(f"[{block}]"), lang).otherwise(out)
    return out
