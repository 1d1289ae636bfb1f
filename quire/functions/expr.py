"""Column building blocks over the nested record columns ``leader``, ``control`` and ``fields``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.schema import CONTROL, FIELD


def fields_of(tag: str, fields: str | Column = "fields") -> Column:
    """All fields of a tag."""
    return F.filter(fields, lambda f: f["tag"] == tag)


def first_of(tag: str, fields: str | Column = "fields") -> Column:
    """The first field of a tag, or null."""
    return F.get(fields_of(tag, fields), 0)


def fields_of_any(tags: Iterable[str], fields: str | Column = "fields") -> Column:
    """Fields of several tags, tag by tag in the order given."""
    listed = F.array(*[F.lit(t) for t in tags])
    fields = F.col(fields) if isinstance(fields, str) else fields
    return let(fields, lambda fs: F.flatten(F.transform(listed, lambda t: F.filter(fs, lambda f: f["tag"] == t))))


def values_of(field: Column, *codes: str) -> Column:
    """All values of the codes, in the field's order."""
    return F.filter(field["subfields"], lambda s: s["code"].isin(*codes))["value"]


def value_of(field: Column, code: str) -> Column:
    """The first value of a code, or null."""
    return F.get(values_of(field, code), 0)


def each_value(fields: Column, code: str) -> Column:
    """The first value of a code of every field that has one."""
    return F.array_compact(F.transform(fields, lambda f: value_of(f, code)))


def control_value(tag: str) -> Column:
    """The first value of a control field, or null."""
    return F.get(F.filter("control", lambda c: c["tag"] == tag), 0)["value"]


def first_matching(fields: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(fields, test), 0)


def publication_264() -> Column:
    """The first 264 whose second indicator is 1."""
    return first_matching(fields_of("264"), lambda f: f["ind2"] == "1")


def text_008(first: int, length: int) -> Column:
    """Characters of the first 008 (0-based), null where it is too short."""
    at = control_value("008")
    return F.when(F.length(at) >= first + length, F.substring(at, first + 1, length))


def char_at(tag: str, position: int) -> Column:
    """One character of a control field, or null."""
    return F.nullif(F.substring(control_value(tag), position + 1, 1), F.lit(""))


def join_values(field: Column) -> Column:
    return F.array_join(field["subfields"]["value"], " ")


def format_field(field: Column, style: str = "record") -> Column:
    """A field as text: the ``record`` style drops $6 and marks subject subdivisions, ``plain`` joins all values."""
    if style == "plain":
        return join_values(field)
    subject = field["tag"].startswith("6")
    shown = F.filter(field["subfields"], lambda s: s["code"] != "6")
    return F.trim(F.array_join(F.transform(shown, lambda s: F.when(subject & s["code"].isin("v", "x", "y", "z"), F.concat(F.lit(" -- "), s["value"])).otherwise(F.concat(F.lit(" "), s["value"]))), ""))


def display(field: Column) -> Column:
    """The ``=TAG  12$aText`` form, blanks shown as backslashes."""
    mark = lambda c: F.replace(c, F.lit(" "), F.lit("\\"))
    return F.concat(F.lit("="), field["tag"], F.lit("  "), mark(field["ind1"]), mark(field["ind2"]), F.array_join(F.transform(field["subfields"], lambda s: F.concat(F.lit("$"), s["code"], s["value"])), ""))


def by_code(field: Column) -> Column:
    """Values grouped by code, codes in order: array of (code, values)."""


    def grouped(subs: Column) -> Column:
        codes = F.array_sort(F.array_distinct(subs["code"]))
        return F.transform(codes, lambda c: F.struct(c.alias("code"), F.filter(subs, lambda s: s["code"] == c)["value"].alias("values")))

    return let(field["subfields"], grouped)


def subfield(code: str, value: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), value.cast("string").alias("value"))


def subfields(*pairs: tuple[str, Column]) -> Column:
    """Subfields whose value is not null."""
    return F.filter(F.array(*[subfield(c, v) for c, v in pairs]), lambda s: s["value"].isNotNull())


def field(tag: str, ind1: str | Column, ind2: str | Column, subs: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(tag).alias("tag"), F.lit(0).alias("tag_rank"), F.lit(0).alias("occ"), lit(ind1).alias("ind1"), lit(ind2).alias("ind2"), subs.alias("subfields"))


def regroup(fields: Column) -> Column:
    """Fields grouped by tag in the order tags first appear, with tag_rank and occ set anew."""


    def grouped(fields: Column) -> Column:
        return F.flatten(
            F.transform(
                F.array_distinct(fields["tag"]),
                lambda t, rank: F.transform(
                    F.filter(fields, lambda f: f["tag"] == t),
                    lambda f, occ: F.struct(t.alias("tag"), rank.alias("tag_rank"), occ.alias("occ"), f["ind1"].alias("ind1"), f["ind2"].alias("ind2"), f["subfields"].alias("subfields")),
                ),
            )
        )

    return let(fields, grouped).cast(f"array<{FIELD}>")


def regroup_control(values: Column) -> Column:
    """Control fields grouped by tag in first-seen order, with occ set anew."""


    def grouped(values: Column) -> Column:
        return F.flatten(F.transform(F.array_distinct(values["tag"]), lambda t: F.transform(F.filter(values, lambda c: c["tag"] == t), lambda c, occ: F.struct(t.alias("tag"), occ.alias("occ"), c["value"].alias("value")))))

    return let(values, grouped).cast(f"array<{CONTROL}>")


def is_control_tag(tag: Column) -> Column:
    return tag.rlike(r"^00[0-9]\z")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once."""
    return F.aggregate(F.from_json(F.lit("[]"), "array<int>"), value, lambda x, _: x, then)


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with the values as columns that later expressions read rather than compute again (a generator is not inlined)."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))
