"""MARC-8: decoding and encoding of values with the public code tables.

Plain ASCII is decoded on the JVM; only values with escapes, control or high bytes go, in Arrow batches, to the state
machine.  The tables hold ASCII, extended Latin, basic and part of extended Cyrillic, Greek, Hebrew, basic Arabic, sub- and
superscripts and Greek symbols.  The East Asian set has no table here: each of its characters gives U+FFFD.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "�"


def _run(first: int, text: str) -> dict[int, str]:
    """Codes from first on; a tilde leaves one out."""
    return {first + i: c for i, c in enumerate(text) if c != "~"}


_LATIN = {i: chr(i) for i in range(0x20, 0x7F)}
_MARKS = {0xE0 + i: c for i, c in enumerate(map(chr, (0x309, 0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x30C, 0x30A, 0xFE20, 0xFE21, 0x315, 0x30B, 0x310, 0x327, 0x328, 0x323, 0x324, 0x325, 0x333, 0x332, 0x326, 0x31C, 0x32E, 0xFE22, 0xFE23)))} | {0xFE: "̓"}
_EXTENDED_LATIN = {0x88: "\u0098", 0x89: "\u009c", 0x8D: "‍", 0x8E: "‌"} | _run(0xA1, "ŁØĐÞÆŒʹ·♭®±ƠƯʼ~ʻłøđþæœʺı£ð~ơư~~°ℓ℗©♯¿¡ß€") | _MARKS
_SETS: dict[int, dict[int, str]] = {
    0x42: _LATIN,
    0x45: _EXTENDED_LATIN,
    0x4E: _run(0x21, "!\"#$%&'()*+,-./0123456789:;<=>?юабцдефгхийклмнопярстужвьызшэщчъЮАБЦДЕФГХИЙКЛМНОПЯРСТУЖВЬЫЗШЭЩЧ"),
    0x51: _run(0x40, "ґђѓєёѕіїјљњћќўџ") | _run(0x60, "ҐЂЃЄЁЅІЇЈЉЊЋЌЎЏ"),
    0x53: _run(0x41, "ΑΒ~ΓΔΕϚϜΖΗΘΙΚΛΜΝΞΟΠϞΡΣ~ΤΥΦΧΨΩϠ") | _run(0x61, "αβϐγδεϛϝζηθικλμνξοπϟρσςτυφχψωϡ"),
    0x32: _run(0x21, "!\"#$%&'()*+,-./0123456789:;<=>?") | _run(0x60, "".join(map(chr, range(0x5D0, 0x5EB)))),
    0x33: _run(0x41, "".join(map(chr, range(0x621, 0x63B)))) | _run(0x60, "".join(map(chr, range(0x640, 0x653)))),
    0x34: {},
    0x62: {0x28: "₍", 0x29: "₎", 0x2B: "₊", 0x2D: "₋"} | {0x30 + i: chr(0x2080 + i) for i in range(10)},
    0x70: {0x28: "⁽", 0x29: "⁾", 0x2B: "⁺", 0x2D: "⁻"} | {0x30 + i: "⁰¹²³⁴⁵⁶⁷⁸⁹"[i] for i in range(10)},
    0x67: {0x61: "α", 0x62: "β", 0x63: "γ"},
    0x31: {},
}
for _at in (0x4E, 0x51, 0x53, 0x32, 0x33):
    _SETS[_at].setdefault(0x20, " ")
_ENTER = {0x42: b"\x1bs", 0x45: b"\x1b)E", 0x62: b"\x1bb", 0x70: b"\x1bp", 0x67: b"\x1bg"}
_ORDER = (0x42, 0x45, 0x4E, 0x51, 0x53, 0x32, 0x33, 0x62, 0x70, 0x67)
_CODES: dict[str, tuple[int, int]] = {c: (at, code) for at in reversed(_ORDER) for code, c in _SETS[at].items()}


def decode(raw: bytes) -> str:
    """Text of MARC-8 bytes, in composed form.

    A mark is put where its byte is, before its letter, as the catalogues' common readers give it.
    """
    low, high, out, marks, i = 0x42, 0x45, [], [], 0
    while i < len(raw):
        byte = raw[i]
        if byte == 0x1B:
            kind, i = raw[i + 1] if i + 1 < len(raw) else -1, i + 2
            if kind in (0x28, 0x29, 0x24):
                if i >= len(raw):
                    kind = -1
                elif kind == 0x28:
                    low = raw[i] if raw[i] in _SETS else low
                elif kind == 0x29:
                    high = raw[i] if raw[i] in _SETS else high
                elif raw[i] == 0x31:
                    low = 0x31
                elif i + 1 < len(raw):
                    low, i = raw[i + 1] if raw[i + 1] in _SETS else low, i + 1
                i += 1
            elif kind in (0x73, 0x67, 0x62, 0x70):
                low = 0x42 if kind == 0x73 else kind
            if kind < 0:
                out.append(UNKNOWN)
                break
            continue
        if byte < 0x20 or byte == 0x7F:
            if byte in (0x0A, 0x0D):
                out.append(chr(byte))
            i += 1
            continue
        at = high if byte >= 0xA0 else low
        if at == 0x31:
            whole = i + 2 < len(raw)
            if whole:
                out.append(UNKNOWN)
            i += 3 if whole else 1
            continue
        c = _SETS[at].get(byte)
        if c is None:
            out.append(UNKNOWN)
        elif at == 0x45 and byte in _MARKS:
            marks.append(c)
        else:
            out += [*marks, c]
            marks = []
        i += 1
    return unicodedata.normalize("NFC", "".join([*out, *marks]))


def encode(text: str) -> bytes:
    """MARC-8 bytes of a text; what no set has is a question mark, and the text ends in the basic set."""
    out, now = bytearray(), 0x42
    for c in text:
        at, code = _CODES.get(c, (None, 0x3F))
        if at is not None and at != now:
            out += _ENTER.get(at, b"\x1b(" + bytes([at]))
            now = at
        out.append(code)
    return bytes(out + (b"\x1bs" if now != 0x42 else b""))


def decode_marc8(raw: Column) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x) for x in column.to_pylist()], pa.string())

    return _either(raw, raw.cast("string"), run.asNondeterministic())


def encode_marc8(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encode(x) for x in column.to_pylist()], pa.binary())

    return _either(text, text.cast("binary"), run.asNondeterministic())


def _either(value: Column, plain: Column, slow) -> Column:
    """plain where all is printable ASCII, else slow."""
    simple = F.coalesce(F.is_valid_utf8(value.cast("string")) & value.cast("string").rlike(r"^[ -~]*\z"), value.isNull())
    return F.coalesce(slow(F.when(~simple, value)), F.when(simple, plain))


def decode_bytes(raw: Column, leader_coding: Column) -> Column:
    """Text by the leader's coding: blank is MARC-8, a is UTF-8 (E301 where it is not), anything else is E301."""
    as_utf8 = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.raise_error(F.lit("E301 utf8_invalid")))
    return F.when(leader_coding == " ", decode_marc8(raw)).when(leader_coding == "a", as_utf8).otherwise(F.raise_error(F.lit("E301 utf8_invalid: no such coding")))


def encode_string(text: Column, leader_coding: Column) -> Column:
    return F.when(leader_coding == " ", encode_marc8(text)).when(leader_coding == "a", text.cast("binary"))
