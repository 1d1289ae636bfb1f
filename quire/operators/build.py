"""Builders: records from the columns of any table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import testkit
from quire.functions import expr as E


@dataclass
class FieldBuilder:
    """A data field; subfields whose value is null are left out, and so is a field without any or whose condition fails."""

    tag: str
    ind1: str | Column = " "
    ind2: str | Column = " "
    pairs: list[tuple[str, Column]] = field(default_factory=list)
    condition: Column | None = None

    def subfield(self, code: str, value: Column | str) -> FieldBuilder:
        self.pairs.append((code, value if isinstance(value, Column) else F.lit(value)))
        return self

    def when(self, condition: Column) -> FieldBuilder:
        self.condition = condition
        return self

    def build(self) -> Column:
        made = F.array(E.field(self.tag, self.ind1, self.ind2, E.subfields(*self.pairs)))
        made = F.filter(made, lambda f: F.size(f["subfields"]) > 0)
        return made if self.condition is None else F.when(self.condition, made).otherwise(F.slice(made, 1, 0))


@dataclass
class RecordBuilder:
    """A record for each row of a table; kind: bib, authority or holdings."""

    kind: str = "bib"
    lead: Column | None = None
    controls: list[tuple[str, Column]] = field(default_factory=list)
    made: list[Column] = field(default_factory=list)

    def leader(self, **parts: str | Column) -> RecordBuilder:
        self.lead = testkit.leader(**parts)
        return self

    def control_field(self, tag: str, value: Column | str) -> RecordBuilder:
        self.controls.append((tag, value if isinstance(value, Column) else F.lit(value)))
        return self

    def field(self, built: FieldBuilder) -> RecordBuilder:
        self.made.append(built.build())
        return self

    def build(self, rows: DataFrame, rec_id: Column) -> DataFrame:
        lead = self.lead if self.lead is not None else testkit.leader({"authority": "z", "holdings": "x"}.get(self.kind, "a"), "m" if self.kind == "bib" else " ")
        return testkit.record(rows, rec_id, self.kind, lead, self.controls, self.made or [F.array().cast("array<struct<tag string,tag_rank int,occ int,ind1 string,ind2 string,subfields array<struct<code string,value string>>>>")])


def authority_builder() -> RecordBuilder:
    return RecordBuilder("authority")


def holdings_builder() -> RecordBuilder:
    return RecordBuilder("holdings")
