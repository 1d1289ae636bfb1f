"""Reading MODS: documents as records.  XML of free nesting needs a parser, so whole Arrow batches go to one."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.schema import CONTROL, ERROR, FIELD, LEADER
from quire.sources.iso2709 import MarcError, _arrow, _grouped_control, grouped

MADE = f"struct<leader {LEADER}, control array<{CONTROL}>, fields array<{FIELD}>, errors array<{ERROR}>>"
_LEADER = {"record_length": 0, "record_status": "n", "record_type": "a", "bibliographic_level": "m", "control_record_type": " ", "character_coding": "a", "indicator_count": 2, "subfield_code_count": 2, "data_base_address": 0, "encoding_level": " ", "cataloging_form": "a", "multipart_level": " ", "reserved": "4500"}
#: typeOfResource to the leader's record type; anything else is language material
RESOURCE_TYPES = {
    "cartographic": "e", "notated music": "c", "sound recording": "i", "sound recording-musical": "i", "sound recording-nonmusical": "i", "still image": "k",
    "moving image": "g", "software, multimedia": "m", "computer resource": "m", "three dimensional object": "r", "mixed material": "p",
}
#: elements whose text is the $a of one field: tag, indicators
_PLAIN = {"abstract": ("520", "  "), "note": ("500", "  "), "genre": ("655", " 7"), "tableOfContents": ("505", "0 "), "targetAudience": ("521", "  ")}
#: children whose text makes a field each: (parent, child) to tag, indicators, code
_INNER = {
    ("subject", "topic"): ("650", " 0", "a"), ("subject", "geographic"): ("651", " 0", "a"), ("subject", "temporal"): ("650", " 0", "y"),
    ("location", "url"): ("856", "40", "u"), ("location", "physicalLocation"): ("852", "  ", "a"), ("location", "shelfLocator"): ("852", "  ", "h"),
}
_TITLE_CODES = {"title": "a", "subTitle": "b", "partNumber": "n", "partName": "p"}
_IDENTIFIERS = {"isbn": ("020", "  "), "issn": ("022", "  "), "lccn": ("010", "  ")}
_RELATED = {"host": "773", "preceding": "780", "succeeding": "785", "series": "830"}


def resource_type_code(text: Column) -> Column:
    """The leader's record type of a typeOfResource."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RESOURCE_TYPES.items() for x in p]), F.trim(text)), F.lit("a"))


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _text(element: ET.Element) -> str:
    return element.text or ""


def _children(element: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (x for x in element if _name(x) in names)


def _last(element: ET.Element, *path: str) -> str | None:
    """The last text that is not empty at a path."""
    found = [element]
    for name in path:
        found = [x for e in found for x in _children(e, name)]
    return next((t for t in map(_text, reversed(found)) if t), None)


class _Made:
    """The record that a document becomes."""

    def __init__(self) -> None:
        self.leader, self.control, self.fields, self.main = dict(_LEADER), [], [], set()

    def add(self, tag: str, indicators: str, *subfields: tuple[str, str | None]) -> None:
        subs = [(c, v) for c, v in subfields if v]
        if subs:
            self.fields.append((tag, indicators[0], indicators[1], subs))

    def title_info(self, e: ET.Element) -> None:
        other = e.get("type") in ("alternative", "abbreviated", "translated", "uniform")
        self.add("246" if other else "245", "1 " if other else "00", *[(_TITLE_CODES[_name(x)], _text(x)) for x in _children(e, *_TITLE_CODES)])

    def name(self, e: ET.Element) -> None:
        parts = [(x.get("type"), _text(x)) for x in _children(e, "namePart")]
        names, dates = [t for kind, t in parts if t and kind != "date"], [t for kind, t in parts if t and kind == "date"]
        role = _last(e, "role", "roleTerm")
        kind = {"corporate": "10", "conference": "11"}.get(e.get("type"), "00")
        if names:
            first = role == "creator" and kind not in self.main
            if first:
                self.main.add(kind)
            self.add(("1" if first else "7") + kind, "1 " if kind == "00" else "2 ", ("a", " ".join(names)), ("d", dates[-1] if dates else None), ("e", role))

    def type_of_resource(self, e: ET.Element) -> None:
        if _text(e):
            self.leader["record_type"] = RESOURCE_TYPES.get(_text(e).strip(), "a")

    def origin_info(self, e: ET.Element) -> None:
        date = None
        for x in _children(e, "dateIssued", "dateCreated"):
            if _text(x) and (date is None or _name(x) == "dateIssued"):
                date = _text(x)
        self.add("260", "  ", ("a", _last(e, "place", "placeTerm")), ("b", _last(e, "publisher")), ("c", date))
        self.add("250", "  ", ("a", _last(e, "edition")))

    def physical_description(self, e: ET.Element) -> None:
        self.add("300", "  ", *[(code, _last(e, name)) for name, code in (("extent", "a"), ("form", "b"), ("dimensions", "c"))])

    def identifier(self, e: ET.Element) -> None:
        kind, text = e.get("type"), _text(e)
        if kind == "local" and text:
            self.control.append(("001", text))
        elif kind in _IDENTIFIERS:
            self.add(*_IDENTIFIERS[kind], ("a", text))
        elif kind in ("doi", "hdl", "uri"):
            self.add("024", "7 ", ("a", text), ("2", text and kind))
        elif kind != "local":
            self.add("024", "8 ", ("a", text))

    def language(self, e: ET.Element) -> None:
        for x in _children(e, "languageTerm"):
            self.add("041", "  ", ("a", _text(x)))

    def classification(self, e: ET.Element) -> None:
        scheme, text = e.get("authority"), _text(e)
        if scheme in ("lcc", "ddc"):
            self.add("050" if scheme == "lcc" else "082", " 4" if scheme == "lcc" else "04", ("a", text))
        else:
            self.add("084", "  ", ("a", text), ("2", text and scheme))

    def related_item(self, e: ET.Element) -> None:
        tag = _RELATED.get(e.get("type"), "787")
        self.add(tag, "  " if tag == "830" else "0 ", ("a" if tag == "830" else "t", _last(e, "titleInfo", "title")))

    def record_info(self, e: ET.Element) -> None:
        for x in e:
            if _name(x) == "recordIdentifier":
                self.control += [(t, v) for t, v in (("001", _text(x)), ("003", x.get("source"))) if v]
            elif _name(x) == "recordContentSource":
                self.add("040", "  ", ("a", _text(x)))
            elif _name(x) == "languageOfCataloging":
                for term in _children(x, "languageTerm"):
                    self.add("040", "  ", ("b", _text(term)))

    def access_condition(self, e: ET.Element) -> None:
        self.add("506" if e.get("type") in ("restriction on access", "restrictionOnAccess") else "540", "  ", ("a", _text(e)))

    def read(self, mods: ET.Element) -> dict:
        for e in mods:
            name = _name(e)
            if name in _ELEMENTS:
                _ELEMENTS[name](self, e)
            elif name in _PLAIN:
                self.add(*_PLAIN[name], ("a", _text(e)))
            else:
                for x in e:
                    if at := _INNER.get((name, _name(x))):
                        self.add(*at[:2], (at[2], _text(x)))
        return {"leader": self.leader, "control": _grouped_control(self.control), "fields": grouped(self.fields), "errors": []}


_ELEMENTS: dict[str, Callable[[_Made, ET.Element], None]] = {
    "titleInfo": _Made.title_info, "name": _Made.name, "typeOfResource": _Made.type_of_resource, "originInfo": _Made.origin_info, "physicalDescription": _Made.physical_description,
    "identifier": _Made.identifier, "language": _Made.language, "classification": _Made.classification, "relatedItem": _Made.related_item, "recordInfo": _Made.record_info, "accessCondition": _Made.access_condition,
}


def records_of(xml: str) -> list[dict]:
    """The records of a ``mods`` or ``modsCollection`` document; MarcError E106 where it cannot be read or has none."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as x:
        raise MarcError("E106", f"MODS cannot be read: {x}") from x
    found = [e for e in root.iter() if _name(e) == "mods"]
    if not found:
        raise MarcError("E106", "no mods element")
    return [_Made().read(e) for e in found]


def _salvaged(xml: str) -> list[dict]:
    try:
        return records_of(xml)
    except MarcError as error:
        return [{"leader": None, "control": [], "fields": [], "errors": [error.info]}]


def from_mods(xml: Column) -> Column:
    """struct(leader, control, fields, errors) of the first ``mods``; a document that cannot be read has an error alone."""
    target = _arrow(MADE)

    @F.arrow_udf(MADE)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _salvaged(x)[0] for x in column.to_pylist()], target)

    return run.asNondeterministic()(xml)


def mods_records(xml: Column) -> Column:
    """Every record of a document, as an array."""
    target = pa.list_(_arrow(MADE))

    @F.arrow_udf(f"array<{MADE}>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _salvaged(x) for x in column.to_pylist()], target)

    return run.asNondeterministic()(xml)


def read_mods(spark, path: str) -> DataFrame:
    """All records of MODS files without name space prefixes, split across tasks by element."""
    raw = spark.read.text(path, lineSep="</mods>").select(F.regexp_extract(F.concat("value", F.lit("</mods>")), r"(?s)(<mods[ >].*</mods>)", 1).alias("xml")).where("xml <> ''")
    return raw.select(F.monotonically_increasing_id().alias("rec_id"), from_mods(F.col("xml")).alias("r")).select("rec_id", "r.*")
