"""Edits: each returns a new ``fields`` or ``control`` column, or a new field, and leaves the old one alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.schema import CONTROL, FIELD, SUBFIELD

Test = Callable[[Column], Column]
NO_FIELDS = f"array<{FIELD}>"


def _with(f: Column, subfields: Column) -> Column:
    return f.withField("subfields", subfields)


# subfields of a field -----------------------------------------------------------------------------------------


def add_subfield(f: Column, code: str, value: Column | str) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return _with(f, F.concat(f["subfields"], F.array(E.subfield(code, value))))


def delete_subfield(f: Column, code: str) -> Column:
    """Without the first subfield of a code."""
    at = F.array_position(f["subfields"]["code"], code) - 1
    return _with(f, F.filter(f["subfields"], lambda _, i: i != at))


def remove_subfields(f: Column, code: str) -> Column:
    return remove_subfields_where(f, lambda s: s["code"] == code)


def remove_subfields_where(f: Column, test: Test) -> Column:
    return _with(f, F.filter(f["subfields"], lambda s: ~F.coalesce(test(s), F.lit(False))))


def set_subfields(f: Column, code: str, value: str) -> Column:
    return set_subfields_where(f, lambda s: s["code"] == code, value)


def set_subfields_where(f: Column, test: Test, value: str) -> Column:
    return _with(f, F.transform(f["subfields"], lambda s: F.when(test(s), s.withField("value", F.lit(value))).otherwise(s)))


def clear_subfields(f: Column) -> Column:
    return _with(f, F.array().cast(f"array<{SUBFIELD}>"))


def subfields_from_flat(flat: Column) -> Column:
    """[code, value, code, value, ...] as subfields."""
    return F.transform(F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2)), lambda i: F.struct(F.get(flat, i).alias("code"), F.get(flat, i + 1).alias("value")))


# fields of a record -------------------------------------------------------------------------------------------


def add_fields(*made: Column, fields: str = "fields") -> Column:
    """Appends to each tag's group."""
    return E.regroup(F.concat(F.col(fields), F.array(*made)))


def add_ordered(made: Column, fields: str = "fields") -> Column:
    """Inserts before the first field of a greater tag."""

    def put(at: Column) -> Column:
        return F.when(at == 0, F.concat(F.col(fields), F.array(made))).otherwise(F.concat(F.slice(fields, F.lit(1), at - 1), F.array(made), F.slice(F.col(fields), at, F.size(fields))))

    greater = F.transform(fields, lambda f: f["tag"] > made["tag"])
    return E.regroup(E.let(F.array_position(greater, True).cast("int"), put))


def add_grouped(made: Column, fields: str = "fields") -> Column:
    """After the last field of the same tag; in order if there is none."""
    return F.when(F.exists(fields, lambda f: f["tag"] == made["tag"]), add_fields(made, fields=fields)).otherwise(add_ordered(made, fields))


def remove_tag(*tags: str, fields: str = "fields") -> Column:
    return remove_where(lambda f: f["tag"].isin(*tags), fields)


def remove_where(test: Test, fields: str = "fields") -> Column:
    return E.regroup(F.filter(fields, lambda f: ~F.coalesce(test(f), F.lit(False))))


def remove_at(tag: str, occurrence: int = 0, fields: str = "fields") -> Column:
    return remove_where(lambda f: (f["tag"] == tag) & (f["occ"] == occurrence), fields)


def remove_equal(made: Column, fields: str = "fields") -> Column:
    """Without the first field that equals another in all but its place; unchanged if there is none."""
    same = F.transform(fields, lambda f: (f["tag"] == made["tag"]) & (f["ind1"] == made["ind1"]) & (f["ind2"] == made["ind2"]) & (f["subfields"] == made["subfields"]))
    at = F.array_position(same, True) - 1
    return E.regroup(F.filter(fields, lambda _, i: i != at))


def update_where(test: Test, change: Test, fields: str = "fields") -> Column:
    return F.transform(fields, lambda f: F.when(test(f), change(f)).otherwise(f))


def set_values(tag: str, code: str, value: str, fields: str = "fields") -> Column:
    return set_values_where(lambda f: f["tag"] == tag, code, value, fields)


def set_values_where(test: Test, code: str, value: str, fields: str = "fields") -> Column:
    return update_where(test, lambda f: set_subfields(f, code, value), fields)


def replace_at(tag: str, occurrence: int, made: Column, fields: str = "fields") -> Column:
    return E.regroup(update_where(lambda f: (f["tag"] == tag) & (f["occ"] == occurrence), lambda f: made.withField("tag_rank", f["tag_rank"]).withField("occ", f["occ"]), fields))


def no_fields() -> Column:
    return F.array().cast(NO_FIELDS)


# control fields -----------------------------------------------------------------------------------------------


def add_control(tag: str, value: Column | str, control: str = "control") -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return E.regroup_control(F.concat(F.col(control), F.array(F.struct(F.lit(tag).alias("tag"), F.lit(0).alias("occ"), value.cast("string").alias("value")))))


def set_control_at(tag: str, occurrence: int, value: str, control: str = "control") -> Column:
    return F.transform(control, lambda c: F.when((c["tag"] == tag) & (c["occ"] == occurrence), c.withField("value", F.lit(value))).otherwise(c))


def no_control() -> Column:
    return F.array().cast(f"array<{CONTROL}>")


def set_leader(position: int, text: str, leader_text: Column) -> Column:
    """The leader's 24 characters with some replaced."""
    return F.overlay(leader_text, F.lit(text), F.lit(position + 1), F.lit(len(text)))


def same_record(control: Column, fields: Column, other_control: Column, other_fields: Column) -> Column:
    """Equal control and data fields; leaders are not compared."""
    return control.eqNullSafe(other_control) & fields.eqNullSafe(other_fields)
