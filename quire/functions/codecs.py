"""Text forms of records: CSV, JSON, MARC-in-JSON, MARCXML, Dublin Core and MODS, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.functions import scalars as S
from quire.schema import FIELD

MARCXML_NS = "http://www.loc.gov/MARC21/slim"
_DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


# CSV ----------------------------------------------------------------------------------------------------------


def csv_value(value: Column) -> Column:
    """Quoted if there is a comma, a quote or a line feed."""
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


CSV_HEADER = "tag,ind1,ind2,subfield_code,value"


def _csv_lines(test) -> Column:
    keep = (lambda x: F.lit(True)) if test is None else (lambda x: F.coalesce(test(x["tag"]), F.lit(False)))
    control = F.transform(F.filter("control", keep), lambda c: F.concat(c["tag"], F.lit(",,,"), csv_value(c["value"])))

    def lines(f: Column) -> Column:
        head = F.concat_ws(",", f["tag"], csv_value(f["ind1"]), csv_value(f["ind2"]))
        rows = F.transform(f["subfields"], lambda s: F.concat_ws(",", head, csv_value(s["code"]), csv_value(s["value"])))
        return F.when(F.size(f["subfields"]) == 0, F.array(F.concat(head, F.lit(",")))).otherwise(rows)

    return F.concat(control, F.flatten(F.transform(F.filter("fields", keep), lines)))


def to_csv(test=None) -> Column:
    """A record as CSV with a header; test: a predicate on tags."""
    return F.concat(F.array_join(F.concat(F.array(F.lit(CSV_HEADER)), _csv_lines(test)), "\n"), F.lit("\n"))


def csv_lines(records: DataFrame, test=None) -> DataFrame:
    """(rec_id, line) for a sink that puts the header first."""
    return records.select("rec_id", F.explode(_csv_lines(test)).alias("line"))


# JSON ---------------------------------------------------------------------------------------------------------


def _quoted(value: Column) -> Column:
    return F.substring(F.to_json(F.array(value)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(value))) - 2)


def _object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _member(key: Column, value: Column) -> Column:
    return F.concat(_quoted(key), F.lit(":"), value)


def _json_fields(subfields) -> Column:
    return F.transform("fields", lambda f: _object(F.array(_member(f["tag"], _object(F.array(_member(F.lit("ind1"), _quoted(f["ind1"])), _member(F.lit("ind2"), _quoted(f["ind2"])), _member(F.lit("subfields"), subfields(f["subfields"]))))))))


def _json_control() -> Column:
    return F.transform("control", lambda c: _object(F.array(_member(c["tag"], _quoted(c["value"])))))


def _json_leader() -> Column:
    return _member(F.lit("leader"), _quoted(S.leader_text(F.col("leader"))))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _last_of_each(subfields: Column) -> Column:
    """One member for each code, in order of codes; of repeated codes the last value counts."""
    codes = F.array_sort(F.array_distinct(subfields["code"]))
    return _object(F.transform(codes, lambda c: _member(c, _quoted(F.element_at(F.filter(subfields, lambda s: s["code"] == c), -1)["value"]))))


def to_json() -> Column:
    """An array of leader, control fields and fields, whose subfields are an object (repeated codes collapse)."""
    return _array(F.concat(F.array(_object(F.array(_json_leader()))), _json_control(), _json_fields(_last_of_each)))


def _each_subfield(subfields: Column) -> Column:
    return _array(F.transform(subfields, lambda s: _object(F.array(_member(s["code"], _quoted(s["value"]))))))


def to_marcjson() -> Column:
    """The array form whose subfields are a list of objects of one member, in order."""
    return _array(F.concat(F.array(_object(F.array(_json_leader()))), _json_control(), _json_fields(_each_subfield)))


def to_dict_json() -> Column:
    """{"leader": ..., "fields": [...]}: MARC-in-JSON."""
    return _object(F.array(_json_leader(), _member(F.lit("fields"), _array(F.concat(_json_control(), _json_fields(_each_subfield))))))


_PARSED_FIELD = "array<map<string,string>>"


def from_json(text: Column) -> Column:
    """struct(leader, control, fields) of any of the JSON forms; members that are none of them are passed over.

    Objects of subfields come in order of codes, lists in their own order; tags that are not of three bytes are
    left out; null where the text is no JSON.
    """
    items = F.coalesce(F.from_json(F.get_json_object(text, "$.fields"), _PARSED_FIELD), F.from_json(text, _PARSED_FIELD))
    leader = F.coalesce(F.get_json_object(text, "$.leader"), F.get(F.filter(F.transform(items, lambda m: m["leader"]), lambda x: x.isNotNull()), 0))

    def parts(all_items: Column) -> Column:
        pairs = F.filter(F.flatten(F.transform(all_items, F.map_entries)), lambda p: (p["key"] != "leader") & (F.octet_length(p["key"]) == 3))
        plain = F.filter(pairs, lambda p: ~F.startswith(F.ltrim(p["value"]), F.lit("{")))
        control = F.transform(plain, lambda p: F.struct(p["key"].alias("tag"), F.lit(0).alias("occ"), p["value"].alias("value")))

        def field(p: Column) -> Column:
            listed = F.from_json(F.get_json_object(p["value"], "$.subfields"), "array<map<string,string>>")
            single = F.from_json(F.get_json_object(p["value"], "$.subfields"), "map<string,string>")
            entries = F.when(F.startswith(F.get_json_object(p["value"], "$.subfields"), F.lit("[")), F.flatten(F.transform(listed, F.map_entries))).otherwise(F.array_sort(F.map_entries(single)))
            ind = lambda n: F.coalesce(F.get_json_object(p["value"], f"$.{n}"), F.lit(" ")).alias(n)
            return F.struct(p["key"].alias("tag"), F.lit(0).alias("tag_rank"), F.lit(0).alias("occ"), ind("ind1"), ind("ind2"), F.transform(entries, lambda e: F.struct(e["key"].alias("code"), e["value"].alias("value"))).alias("subfields"))

        data = F.transform(F.filter(pairs, lambda p: F.startswith(F.ltrim(p["value"]), F.lit("{"))), field)
        return F.struct(S.parse_leader(leader.cast("binary")).alias("leader"), E.regroup_control(control).alias("control"), E.regroup(data).alias("fields"))

    return F.when(items.isNotNull(), E.let(items, parts))


# XML ----------------------------------------------------------------------------------------------------------


def xml_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _plain(text: Column) -> Column:
    """Element text: only what XML itself demands is escaped."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _joined(items: Column) -> Column:
    return F.array_join(items, "")


def to_marcxml() -> Column:
    """One ``record`` element with its declaration and name space."""
    control = F.transform("control", lambda c: F.concat(F.lit('<controlfield tag="'), xml_escape(c["tag"]), F.lit('">'), _plain(c["value"]), F.lit("</controlfield>")))
    subs = lambda f: _joined(F.transform(f["subfields"], lambda s: F.concat(F.lit('<subfield code="'), xml_escape(s["code"]), F.lit('">'), _plain(s["value"]), F.lit("</subfield>"))))
    data = F.transform("fields", lambda f: F.concat(F.lit('<datafield tag="'), xml_escape(f["tag"]), F.lit('" ind1="'), xml_escape(f["ind1"]), F.lit('" ind2="'), xml_escape(f["ind2"]), F.lit('">'), subs(f), F.lit("</datafield>")))
    return F.concat(F.lit(f'{_DECLARATION}<record xmlns="{MARCXML_NS}"><leader>'), _plain(S.leader_text(F.col("leader"))), F.lit("</leader>"), _joined(control), _joined(data), F.lit("</record>"))


_XML_RECORD = "leader string, controlfield array<struct<_tag string, _VALUE string>>, datafield array<struct<_tag string, _ind1 string, _ind2 string, subfield array<struct<_code string, _VALUE string>>>>"
_XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def without_namespaces(xml: Column) -> Column:
    """Without xmlns attributes and prefixes of element names."""
    return F.regexp_replace(F.regexp_replace(xml, r"""\s+xmlns(?::[A-Za-z0-9_.-]+)?\s*=\s*(?:"[^"]*"|'[^']*')""", ""), r"<(/?)[A-Za-z_][A-Za-z0-9_.-]*:", "<$1")


def _from_xml_row(x: Column) -> Column:
    value = lambda v: F.coalesce(v, F.lit(""))
    control = F.transform(F.coalesce(x["controlfield"], F.array().cast("array<struct<_tag string, _VALUE string>>")), lambda c: F.struct(c["_tag"].alias("tag"), F.lit(0).alias("occ"), value(c["_VALUE"]).alias("value")))
    data = F.transform(
        F.coalesce(x["datafield"], F.array().cast("array<struct<_tag string, _ind1 string, _ind2 string, subfield array<struct<_code string, _VALUE string>>>>")),
        lambda f: F.struct(
            f["_tag"].alias("tag"), F.lit(0).alias("tag_rank"), F.lit(0).alias("occ"), F.coalesce(f["_ind1"], F.lit(" ")).alias("ind1"), F.coalesce(f["_ind2"], F.lit(" ")).alias("ind2"),
            F.transform(F.coalesce(f["subfield"], F.array().cast("array<struct<_code string, _VALUE string>>")), lambda s: F.struct(s["_code"].alias("code"), value(s["_VALUE"]).alias("value"))).alias("subfields"),
        ),
    )
    return F.struct(S.parse_leader(x["leader"].cast("binary")).alias("leader"), E.regroup_control(control).alias("control"), E.regroup(data).cast(f"array<{FIELD}>").alias("fields"))


def from_marcxml(xml: Column) -> Column:
    """struct(leader, control, fields) of the first ``record``; null where there is none."""
    body = F.regexp_extract(without_namespaces(xml), r"(?s)(<record[ >].*?</record>)", 1)
    return F.when(body != "", E.let(F.from_xml(body, _XML_RECORD, _XML_OPTIONS), _from_xml_row))


def read_marcxml(spark, path: str) -> DataFrame:
    """All records of MARCXML files without name space prefixes, split across tasks by element."""
    rows = spark.read.format("xml").option("rowTag", "record").options(**_XML_OPTIONS).schema(_XML_RECORD).load(path)
    made = E.let(F.struct("leader", "controlfield", "datafield"), _from_xml_row)
    return rows.select(F.monotonically_increasing_id().alias("rec_id"), made.alias("r")).select("rec_id", "r.*")


def marcxml_records(xml: Column) -> Column:
    """Every record of a collection, as an array; none gives an empty one."""
    return F.transform(F.regexp_extract_all(without_namespaces(xml), F.lit(r"(?s)(<record[ >].*?</record>)"), F.lit(1)), lambda body: E.let(F.from_xml(body, _XML_RECORD, _XML_OPTIONS), _from_xml_row))


# Dublin Core --------------------------------------------------------------------------------------------------

DC = ("title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights")


def _a(*tags: str) -> Column:
    return F.flatten(F.array(*[E.each_value(E.fields_of(t), "a") for t in tags]))


def _all_values(tag: str, *codes: str) -> Column:
    return F.flatten(F.transform(E.fields_of(tag), lambda f: E.values_of(f, *codes)))


def _words(values: Column) -> Column:
    return F.filter(F.flatten(F.transform(values, lambda v: F.split(v, r"\s+"))), lambda w: w != "")


def dublin_core() -> Column:
    """The fifteen elements, each an array of texts."""
    prefix = lambda p, v: F.transform(v, lambda x: F.concat(F.lit(p), x))
    number = E.control_value("001")
    found = {
        "title": F.transform(E.fields_of("245"), lambda f: F.array_join(E.values_of(f, "a", "b", "c"), " ")),
        "creator": _a("100", "110"),
        "subject": _a("600", "610", "650"),
        "description": _a("520", "500"),
        "publisher": _all_values("260", "a"),
        "contributor": _a("700", "710"),
        "date": _all_values("260", "c"),
        "format": _a("300"),
        "identifier": F.concat(prefix("ISBN: ", _a("020")), prefix("Control#: ", F.array_compact(F.array(number)))),
        "language": _words(_all_values("041", "a")),
        "coverage": _a("651"),
        "rights": _a("540"),
    }
    empty = F.array().cast("array<string>")
    title = F.filter(found["title"], lambda t: t != "")
    return F.struct(*[(title if n == "title" else found.get(n, empty)).alias(n) for n in DC])


def dublin_core_xml(dc: Column) -> Column:
    line = lambda n: _joined(F.transform(dc[n], lambda v: F.concat(F.lit(f"    <dc:{n}>"), xml_escape(v), F.lit(f"</dc:{n}>\n"))))
    head = _DECLARATION + '\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/">\n  <rdf:Description>\n'
    return F.concat(F.lit(head), *[line(n) for n in DC], F.lit("  </rdf:Description>\n</rdf:RDF>\n"))


def to_dublin_core_xml() -> Column:
    return E.let(dublin_core(), dublin_core_xml)


# MODS ---------------------------------------------------------------------------------------------------------

RESOURCE_TYPES = {**dict.fromkeys("acdt", "text"), **dict.fromkeys("ef", "cartographic"), **dict.fromkeys("gk", "still image"), **dict.fromkeys("ij", "sound recording"), "m": "computer resource", "p": "mixed material", "r": "three dimensional object"}


def _tag(name: str, value: Column, indent: int = 4, attributes: str = "") -> Column:
    """A line with an element; null where the value is."""
    return F.concat(F.lit(" " * indent + f"<mods:{name}{attributes}>"), xml_escape(value), F.lit(f"</mods:{name}>\n"))


def _some(*lines: Column) -> Column:
    """The lines that are not null, joined."""
    return F.concat_ws("", *lines)


def _block(name: str, body: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"  <mods:{name}{attributes}>\n"), body, F.lit(f"  </mods:{name}>\n"))


def _each(tag: str, make) -> Column:
    return F.array_join(F.transform(E.fields_of(tag), make), "")


def _lines(f: Column, code: str, make) -> Column:
    return _joined(F.transform(E.values_of(f, code), make))


def _named(name: str):
    return lambda v: _tag(name, v)


def _names(tag: str, kind: str) -> Column:
    role = lambda text: F.concat(F.lit("    <mods:role><mods:roleTerm>"), xml_escape(text), F.lit("</mods:roleTerm></mods:role>\n"))

    def one(f: Column) -> Column:
        part = lambda c: E.value_of(f, c)
        roles = F.coalesce(part("e"), F.lit("creator")) if tag == "100" else part("e")
        dates = [_tag("namePart", part("d"), attributes=' type="date"')] if kind == "personal" else []
        return F.when(part("a").isNotNull(), _block("name", _some(_tag("namePart", part("a")), *dates, role(roles)), f' type="{kind}"'))

    return _each(tag, one)


def to_mods() -> Column:
    """A MODS document."""
    a = lambda f: E.value_of(f, "a")
    number = E.control_value("001")
    place = lambda v: F.concat(F.lit("    <mods:place><mods:placeTerm>"), xml_escape(v), F.lit("</mods:placeTerm></mods:place>\n"))
    wrapped = lambda tag, name: _each(tag, lambda f: F.when(a(f).isNotNull(), _block("subject", _tag(name, a(f)))))
    code = lambda w: F.concat(F.lit('    <mods:languageTerm type="code" authority="iso639-2b">'), w, F.lit("</mods:languageTerm>\n"))
    language = F.transform(_all_values("041", "a"), lambda v: _block("language", _joined(F.transform(_words(F.array(v)), code))))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RESOURCE_TYPES.items() for x in p]), F.col("leader.record_type")), F.lit("unknown"))
    return _some(
        F.lit(f'{_DECLARATION}\n<mods xmlns="http://www.loc.gov/mods/v3" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink">\n'),
        _each("245", lambda f: _block("titleInfo", _some(_tag("title", a(f)), _tag("subTitle", E.value_of(f, "b"))))),
        *[_names(t, k) for t, k in (("100", "personal"), ("700", "personal"), ("110", "corporate"), ("710", "corporate"))],
        _tag("typeOfResource", kind, 2),
        _each("260", lambda f: _block("originInfo", _some(_lines(f, "a", place), _lines(f, "b", lambda v: _tag("publisher", v)), _lines(f, "c", lambda v: _tag("dateIssued", v))))),
        _each("300", lambda f: _block("physicalDescription", _some(*[_lines(f, c, _named(n)) for c, n in (("a", "extent"), ("b", "form"), ("c", "dimensions"))]))),
        _each("520", lambda f: _tag("abstract", a(f), 2)),
        _each("500", lambda f: _tag("note", a(f), 2)),
        wrapped("650", "topic"),
        wrapped("651", "geographic"),
        _each("020", lambda f: _tag("identifier", a(f), 2, ' type="isbn"')),
        _each("022", lambda f: _tag("identifier", a(f), 2, ' type="issn"')),
        _tag("identifier", number, 2, ' type="local"'),
        _joined(language),
        F.lit("</mods>\n"),
    )
