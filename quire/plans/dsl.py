"""The field query language, compiled to Column predicates.

A query is a test on one field.  ``matching`` keeps a record's fields, ``any_field`` filters records, and
``where_long`` gives the same test on the long table, where Parquet can push the tag, code and value down.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.schema import SUBJECT_TAGS

_FORBIDDEN = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|\(\?>|[*+?}]\+")


def java_pattern(pattern: str) -> str:
    """A pattern of the query language for Java: $ is the end of the text, classes know Unicode.

    Look-around, back-references, atomic groups and possessive quantifiers are not in the language (ValueError).
    """
    if _FORBIDDEN.search(re.sub(r"\\\\", "", pattern)):
        raise ValueError(f"not in the query language: {pattern!r}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append("\\z" if pattern[i : i + 2] == "\\z" else pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append("\\z" if c == "$" and not inside else c)
        i += 1
    return "(?U)" + "".join(out)


def _has_code(code: str):
    return lambda s: s["code"] == code


@dataclass(frozen=True)
class FieldQuery:
    """Tag, indicators and required codes; what is not set matches anything."""

    tag_: str | None = None
    ind1: str | None = None
    ind2: str | None = None
    codes: tuple[str, ...] = ()

    def tag(self, tag: str) -> FieldQuery:
        return replace(self, tag_=tag)

    def indicator1(self, value: str | None) -> FieldQuery:
        return replace(self, ind1=value)

    def indicator2(self, value: str | None) -> FieldQuery:
        return replace(self, ind2=value)

    def has_subfield(self, code: str) -> FieldQuery:
        return self.has_subfields(code)

    def has_subfields(self, *codes: str) -> FieldQuery:
        return replace(self, codes=tuple(dict.fromkeys(self.codes + codes)))

    def tag_range(self, first: str, last: str) -> TagRangeQuery:
        return TagRangeQuery(first, last, self.ind1, self.ind2, self.codes)

    def _tag_test(self, tag: Column) -> list[Column]:
        return [] if self.tag_ is None else [tag == self.tag_]

    def test(self, f: Column) -> Column:
        tests = self._tag_test(f["tag"])
        tests += [f[n] == v for n, v in (("ind1", self.ind1), ("ind2", self.ind2)) if v is not None]
        tests += [F.exists(f["subfields"], _has_code(c)) for c in self.codes]
        return _all(tests)

    def where_long(self, long: DataFrame) -> DataFrame:
        """(rec_id, tag, occ) of the fields that match."""
        tests = self._tag_test(F.col("tag")) + [F.col(n) == v for n, v in (("ind1", self.ind1), ("ind2", self.ind2)) if v is not None]
        rows = long.where(F.col("code").isNotNull()).where(_all(tests))
        if len(self.codes) == 1:
            return rows.where((F.col("code") == self.codes[0]) & (F.col("code_occ") == 0)).select("rec_id", "tag", "occ")
        if self.codes:
            rows = rows.where(F.col("code").isin(*self.codes))
            found = rows.groupBy("rec_id", "tag", "occ").agg(F.count_distinct("code").alias("n"))
            return found.where(F.col("n") == len(self.codes)).drop("n")
        return rows.where("sf_pos = 0").select("rec_id", "tag", "occ")


@dataclass(frozen=True)
class TagRangeQuery(FieldQuery):
    """Tags between first and last (as text, both included) in place of one tag."""

    def __init__(self, first: str, last: str, ind1: str | None = None, ind2: str | None = None, codes: tuple[str, ...] = ()):
        for name, value in (("tag_", None), ("ind1", ind1), ("ind2", ind2), ("codes", codes), ("first", first), ("last", last)):
            object.__setattr__(self, name, value)

    def tag_in_range(self, tag: Column) -> Column:
        return tag.between(self.first, self.last)

    def _tag_test(self, tag: Column) -> list[Column]:
        return [self.tag_in_range(tag)]


@dataclass(frozen=True)
class _FirstValueQuery:
    """A test on the first value of a code; a field without the code never matches, negated or not."""

    tag_: str
    code: str
    text: str
    negate: bool = False

    def _says(self, value: Column) -> Column:
        raise NotImplementedError

    def test(self, f: Column) -> Column:
        value = E.value_of(f, self.code)
        return (f["tag"] == self.tag_) & F.coalesce(self._says(value) != F.lit(self.negate), F.lit(False))

    def where_long(self, long: DataFrame) -> DataFrame:
        said = self._says(F.col("value"))
        rows = long.where((F.col("tag") == self.tag_) & (F.col("code") == self.code) & (F.col("code_occ") == 0))
        return rows.where(~said if self.negate else said).select("rec_id", "tag", "occ")


@dataclass(frozen=True)
class SubfieldPatternQuery(_FirstValueQuery):
    """The first value of a code holds a match of a pattern."""

    def __post_init__(self):
        java_pattern(self.text)

    def _says(self, value: Column) -> Column:
        return value.rlike(java_pattern(self.text))

    @classmethod
    def negated(cls, tag: str, code: str, pattern: str) -> SubfieldPatternQuery:
        return cls(tag, code, pattern, True)


@dataclass(frozen=True)
class SubfieldValueQuery(_FirstValueQuery):
    """The first value of a code equals a text, or holds it (part)."""

    part: bool = False

    def _says(self, value: Column) -> Column:
        return value.contains(self.text) if self.part else value == self.text

    @classmethod
    def partial(cls, tag: str, code: str, text: str) -> SubfieldValueQuery:
        return cls(tag, code, text, False, True)

    @classmethod
    def negated(cls, tag: str, code: str, text: str) -> SubfieldValueQuery:
        return cls(tag, code, text, True)

    @classmethod
    def partial_negated(cls, tag: str, code: str, text: str) -> SubfieldValueQuery:
        return cls(tag, code, text, True, True)


Query = FieldQuery | _FirstValueQuery


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def matching(query: Query, fields: str | Column = "fields") -> Column:
    """The record's fields that match, in the record's order."""
    return F.filter(fields, lambda f: query.test(f))


def any_field(query: Query, fields: str | Column = "fields") -> Column:
    """Whether a record has a field that matches."""
    return F.exists(fields, lambda f: query.test(f))


def records_with(records: DataFrame, long: DataFrame, query: Query) -> DataFrame:
    """Whole records with a field that matches, found in the long table."""
    return records.join(query.where_long(long).select("rec_id").distinct(), "rec_id", "left_semi")


def records_without(records: DataFrame, long: DataFrame, query: Query) -> DataFrame:
    return records.join(query.where_long(long).select("rec_id").distinct(), "rec_id", "left_anti")


def fields_by_indicator(tag: str, ind1: str | None = None, ind2: str | None = None) -> Column:
    return matching(FieldQuery(tag, ind1, ind2))


def fields_in_range(first: str, last: str) -> Column:
    return matching(TagRangeQuery(first, last))


names_in_range = fields_in_range


def fields_with_subfields(tag: str, *codes: str) -> Column:
    return matching(FieldQuery(tag).has_subfields(*codes))


def subjects_with_subdivision(code: str, value: str) -> Column:
    return F.filter(E.fields_of_any(SUBJECT_TAGS), lambda f: F.coalesce(E.value_of(f, code) == value, F.lit(False)))


def subjects_with_note(text: str) -> Column:
    return F.filter(E.fields_of_any(SUBJECT_TAGS), lambda f: F.coalesce(E.value_of(f, "x").contains(text), F.lit(False)))


def isbns_matching(pattern: str) -> Column:
    return matching(SubfieldPatternQuery("020", "a", pattern))
