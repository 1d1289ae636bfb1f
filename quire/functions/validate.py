"""Validation: leaders, structure, indicators and encodings, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.functions import scalars as S
from quire.schema import INDICATOR_RULES

#: kind -> leader part -> the characters allowed
LEADER_RULES = {
    "bib": {"record_status": "acdnp", "record_type": "acdefgijkmoprtvz", "bibliographic_level": "abcdims", "control_record_type": " a", "character_coding": " a", "encoding_level": " 1234578uz", "cataloging_form": " acinu", "multipart_level": " abc"},
    "authority": {"record_status": "acdnosx", "record_type": "z", "encoding_level": "no", "cataloging_form": " ciu"},
    "holdings": {"record_status": "cdn", "record_type": "uvxy", "encoding_level": "12345muz", "cataloging_form": " in"},
}
_SUBJECT_SOURCES = dict(zip("01234567", ("LCSH", "LCSH (conflict)", "MeSH", "NAL", "Source not specified", "Canadian subjects", "RVM", "Source in $2")))
_MORE = dict.fromkeys("# ", "No additional information") | {"2": "Analytical entry"}
_PERSON = {"0": "Forename", "1": "Surname", "3": "Family name"}
_BODY = {"1": "Jurisdiction", "2": "Name in direct order"}
_MEETING = {"0": "Inverted name", **_BODY}
#: tag -> labels of the first and second indicator
INDICATOR_LABELS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "100": (_PERSON, {}), "110": (_BODY, {}), "111": (_MEETING, {}), "130": ({}, {}),
    "240": ({"0": "Not printed", "1": "Printed"}, {}),
    "245": ({"0": "No title added entry", "1": "Title added entry"}, {}),
    "490": ({"0": "Not traced", "1": "Traced"}, {}),
    "600": (_PERSON, _SUBJECT_SOURCES | {"6": "RVM (répertoire de vedettes-matière)"}),
    "610": (_BODY, _SUBJECT_SOURCES), "611": (_MEETING, _SUBJECT_SOURCES), "650": ({}, _SUBJECT_SOURCES), "651": ({}, _SUBJECT_SOURCES),
    "700": (_PERSON, _MORE), "710": (_BODY, _MORE), "711": ({**_MEETING, "0": "Inverted"}, _MORE), "740": ({}, _MORE),
}


def _text_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def leader_problem(kind: str = "bib", leader: str = "leader") -> Column:
    """The first leader part with a value that its kind does not allow, or null."""
    at = F.col(leader)
    out = F.when(F.lit(False), F.lit(""))
    for name, allowed in LEADER_RULES[kind].items():
        out = out.when(~at[name].isin(*allowed) | at[name].isNull(), name)
    for name in ("indicator_count", "subfield_code_count"):
        out = out.when(at[name].isNull() | (at[name] != 2), name)
    return out.when(at["data_base_address"] > 99_999, "data_base_address")


def indicators_valid(tag: Column, ind1: Column, ind2: Column) -> Column:
    """Whether both indicators are allowed; tags without rules allow anything."""
    rules = _text_map({f"{t}{i}": allowed for t, pair in INDICATOR_RULES.items() for i, allowed in enumerate(pair, 1)})

    def good(i: int, value: Column) -> Column:
        allowed = F.try_element_at(rules, F.concat(tag, F.lit(str(i))))
        return allowed.isNull() | allowed.contains(value)

    return good(1, ind1) & good(2, ind2)


def field_valid(f: Column) -> Column:
    return indicators_valid(f["tag"], f["ind1"], f["ind2"])


def indicator_meaning(tag: Column, position: int, value: Column) -> Column:
    """The label of an indicator's value, or null."""
    return F.try_element_at(_text_map({t + v: label for t, pair in INDICATOR_LABELS.items() for v, label in pair[position - 1].items()}), F.concat(tag, value))


def indicator_meanings(tag: str, position: int) -> dict[str, str]:
    return dict(INDICATOR_LABELS.get(tag, ({}, {}))[position - 1])


def expected(tag: str, position: int) -> str | None:
    """The rule in words."""
    rule = INDICATOR_RULES.get(tag)
    if rule is None:
        return None
    allowed = rule[position - 1]
    return "blank (undefined)" if allowed == " #" else f"a digit {allowed[0]}-{allowed[-1]}" if allowed == "0123456789" else "one of " + ", ".join(map(repr, allowed))


def record_problem(kind: str = "bib") -> Column:
    """The first thing wrong with a record's leader or structure, or null."""
    printable = lambda c: c.rlike(r"^[^\x00-\x1f\x7f]\z")
    return (
        F.when(leader_problem(kind).isNotNull(), F.concat(F.lit("leader "), leader_problem(kind)))
        .when(E.control_value("001").isNull(), "no 001")
        .when(E.control_value("008").isNull(), "no 008")
        .when(F.exists("control", lambda c: ~c["tag"].rlike(r"^[0-9]{3}\z")) | F.exists("fields", lambda f: ~f["tag"].rlike(r"^[0-9]{3}\z")), "tag")
        .when(F.exists("fields", lambda f: ~printable(f["ind1"]) | ~printable(f["ind2"])), "indicator")
        .when(F.exists("fields", lambda f: F.exists(f["subfields"], lambda s: ~s["code"].rlike(r"^[!-~]\z"))), "subfield code")
    )


def is_valid(kind: str = "bib") -> Column:
    return record_problem(kind).isNull()


def directory_problem() -> Column:
    """Whether a record is too large for ISO 2709, or null."""
    body = lambda f: F.aggregate(f["subfields"], F.lit(3), lambda n, s: n + 2 + F.octet_length(s["value"]))
    sizes = F.concat(F.transform("control", lambda c: F.octet_length(c["value"]) + 1), F.transform("fields", body))
    total = F.aggregate(sizes, F.lit(26), lambda n, x: n + x + 12)
    return F.when(F.exists(sizes, lambda x: x > 9_999), "field").when(total > 99_999, "record").when(F.size(sizes) * 12 + 25 > 99_999, "directory")


def _values() -> Column:
    return F.concat(F.col("control")["value"], F.flatten(F.transform("fields", lambda f: f["subfields"]["value"])))


def _differs(value: Column, leader_coding: Column) -> Column:
    high = F.octet_length(value) - F.length(F.regexp_replace(value, r"[^\x00-\x7f]", ""))
    escaped = value.contains("\x1b")
    return F.when(leader_coding == "a", escaped & (high == 0)).when(leader_coding == " ", (high * 10 > F.octet_length(value)) & (high > 0)).otherwise(False)


def encoding_report() -> Column:
    """struct(declared, inconsistent, detected): the leader's encoding, how many values look otherwise, what they look like."""
    coding = F.col("leader.character_coding")
    odd = F.filter(_values(), lambda v: _differs(v, coding))
    found = F.array_distinct(F.array_compact(F.transform(odd, S.detect_encoding)))
    return F.struct(S.encoding_of(coding).alias("declared"), F.size(odd).alias("inconsistent"), found.alias("detected"))


def encoding_mixed() -> Column:
    return encoding_report()["inconsistent"] > 0
