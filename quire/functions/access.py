"""Accessors of records: titles, names, subjects, publication data, authority and holdings views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.functions import scalars as S
from quire.schema import HEADING_TAGS, LINK_HEADS, NAME_TAGS, NARROW_SUBJECT_TAGS, SUBJECT_TAGS


def _first(tag: str, code: str = "a") -> Column:
    return E.value_of(E.first_of(tag), code)


def _leader(name: str, *values: str) -> Column:
    return F.col(f"leader.{name}").isin(*values)


# bibliographic ------------------------------------------------------------------------------------------------


def title() -> Column:
    return _first("245")


def title_with_responsibility() -> Column:
    return F.struct(_first("245").alias("title"), _first("245", "c").alias("responsibility"))


def author() -> Column:
    return _first("100")


def authors() -> Column:
    return E.each_value(E.fields_of("700"), "a")


def corporate_author() -> Column:
    return _first("110")


def publisher() -> Column:
    return F.coalesce(_first("260", "b"), E.value_of(E.publication_264(), "b"))


def place_of_publication() -> Column:
    return F.coalesce(_first("260"), E.value_of(E.publication_264(), "a"))


def _year_008() -> Column:
    year = E.text_008(7, 4)
    return F.when(year.rlike(r"^[0-9]{4}\z") & (year != "0000"), year)


def publication_date() -> Column:
    return F.coalesce(_first("260", "c"), E.value_of(E.publication_264(), "c"), _year_008())


def publication_info() -> Column:
    """struct(place, publisher, date) of the first 260 if there is one at all, else of the first 264 _1."""
    at = F.coalesce(E.first_of("260"), E.publication_264())
    return F.when(at.isNotNull(), F.struct(E.value_of(at, "a").alias("place"), E.value_of(at, "b").alias("publisher"), E.value_of(at, "c").alias("date")))


def publication_year() -> Column:
    return F.coalesce(S.year_of(publication_info()["date"]), _year_008().cast("int"))


pubyear = publication_year


def publication_statement() -> Column:
    at = publication_info()
    return F.nullif(S.publication_statement(at["place"], at["publisher"], at["date"]), F.lit(""))


def isbn() -> Column:
    return _first("020")


def isbns() -> Column:
    return E.each_value(E.fields_of("020"), "a")


def issn() -> Column:
    return _first("022")


def issn_title() -> Column:
    return _first("222")


def issnl() -> Column:
    """024 $a (sic)."""
    return _first("024")


def subjects() -> Column:
    return E.each_value(E.fields_of_any(SUBJECT_TAGS), "a")


def language() -> Column:
    return F.nullif(E.text_008(35, 3), F.lit("   "))


def control_number() -> Column:
    return E.control_value("001")


def lccn() -> Column:
    return _first("010")


def physical_description() -> Column:
    return _first("300")


def series() -> Column:
    return _first("490")


def uniform_title() -> Column:
    return _first("130")


def sudoc() -> Column:
    return _first("086")


def location() -> Column:
    return E.each_value(E.fields_of("852"), "a")


def notes() -> Column:
    """$a of 500 to 599, in order of tags."""
    some = F.filter("fields", lambda f: f["tag"].between("500", "599"))
    ranked = F.array_sort(F.transform(some, lambda f: F.struct(f["tag"].alias("t"), f["occ"].alias("o"), E.value_of(f, "a").alias("v"))))
    return F.array_compact(ranked["v"])


def is_book() -> Column:
    return _leader("record_type", "a") & _leader("bibliographic_level", "m")


def is_serial() -> Column:
    return _leader("bibliographic_level", "s")


def is_music() -> Column:
    return _leader("record_type", "c", "d")


def is_audiovisual() -> Column:
    return _leader("record_type", "g")


def get_fields(*tags: str) -> Column:
    """Fields of the tags in the order given; of all tags if none is."""
    return E.fields_of_any(tags) if tags else F.col("fields")


def field_or_error(tag: str) -> Column:
    """The first field of a tag; a record without one raises E105."""
    return F.coalesce(E.first_of(tag), F.raise_error(F.concat(F.lit(f"E105 field_not_found: {tag} in "), F.coalesce(control_number(), F.lit("?")))))


def linked_880() -> Column:
    return E.fields_of("880")


def added_entries() -> Column:
    return E.fields_of_any(("700", "710", "711", "730"))


def all_subject_fields() -> Column:
    return E.fields_of_any(NARROW_SUBJECT_TAGS)


def all_names() -> Column:
    return E.fields_of_any(NAME_TAGS)


def authors_with_dates() -> Column:
    """(a, d) of the first 100 and of each 700 that has both."""
    of = F.array_compact(F.concat(F.array(E.first_of("100")), E.fields_of("700")))
    return F.filter(F.transform(of, lambda f: F.struct(E.value_of(f, "a").alias("name"), E.value_of(f, "d").alias("dates"))), lambda x: x["name"].isNotNull() & x["dates"].isNotNull())


def field_at(tag: str, occurrence: int) -> Column:
    return F.get(E.fields_of(tag), occurrence)


# authority ----------------------------------------------------------------------------------------------------


def heading() -> Column:
    return F.coalesce(*[E.first_of(t) for t in HEADING_TAGS])


def heading_type() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in HEADING_TAGS.items() for x in p]), heading()["tag"])


def heading_text() -> Column:
    return E.value_of(heading(), "a")


def _starts(*digits: str, but: tuple[str, ...] = ()) -> Column:
    return F.filter("fields", lambda f: F.substring(f["tag"], 1, 1).isin(*digits) & ~f["tag"].isin(*but, ""))


def see_from_tracings() -> Column:
    return _starts("4")


def see_also_tracings() -> Column:
    return _starts("5")


def authority_notes() -> Column:
    return _starts("6", but=("650", "651", "655"))


def linking_entries() -> Column:
    return _starts("7")


def source_data_found() -> Column:
    return E.fields_of("670")


def source_data_not_found() -> Column:
    """671 (sic)."""
    return E.fields_of("671")


def _coded(tag: str, position: int, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), E.char_at(tag, position))


KINDS = dict(zip("abcdefg", ("EstablishedHeading", "ReferenceUntracted", "ReferenceTraced", "Subdivision", "NodeLabel", "EstablishedHeadingAndSubdivision", "ReferenceAndSubdivision")))
LEVELS = {"a": "FullyEstablished", "b": "Memorandum", "c": "Provisional", "d": "Preliminary", "n": "NotApplicable"}


def kind_of_record() -> Column:
    return _coded("008", 9, KINDS)


def level_of_establishment() -> Column:
    return _coded("008", 33, LEVELS)


def is_established() -> Column:
    return F.coalesce(E.char_at("008", 9).isin("a", "f"), F.lit(False))


def is_reference() -> Column:
    return F.coalesce(E.char_at("008", 9).isin("b", "c", "g"), F.lit(False))


def see_from_headings() -> Column:
    return E.fields_of_any("4" + x for x in LINK_HEADS)


def see_also_headings() -> Column:
    return E.fields_of_any("5" + x for x in LINK_HEADS)


def relationship_fields() -> Column:
    return E.fields_of_any("7" + x for x in LINK_HEADS)


def authority_references() -> Column:
    return F.concat(see_from_headings(), see_also_headings(), relationship_fields())


def related_heading() -> Column:
    """The first see-also heading, whatever the field asked about."""
    return F.get(see_also_headings(), 0)


def subdivisions(field: Column) -> Column:
    return F.array_compact(F.array(*[E.value_of(field, c) for c in "xzyv"]))


def scope_note() -> Column:
    return _first("680")


preferred_heading, variant_headings, broader_related_headings = heading, see_from_tracings, see_also_tracings


# holdings -----------------------------------------------------------------------------------------------------

HOLDINGS_TYPES = {"x": "SinglePartItem", "y": "SerialItem", "v": "MultipartItem"}
STATUSES = {"0": "Other", "1": "ReceivedAndComplete", "2": "OnOrder", "3": "ReceivedAndIncomplete"}
METHODS = {"u": "Unknown", "f": "Free", "g": "Gift", "l": "LegalDeposit", "m": "Membership", "p": "Purchase", "e": "Exchange"}
COMPLETENESS = {"1": "Complete", "2": "Incomplete", "3": "Scattered", "4": "NotApplicable"}
PARTS = {"captions": ("853", "854", "855"), "enumeration": ("863", "864", "865"), "textual_holdings": ("866", "867", "868"), "item_information": ("876", "877", "878")}


def locations() -> Column:
    return E.fields_of("852")


def part(name: str, of: str = "basic") -> Column:
    """Captions, enumeration, textual holdings or item information of the basic unit, supplements or indexes."""
    return E.fields_of(PARTS[name][("basic", "supplements", "indexes").index(of)])


def holdings_type() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in HOLDINGS_TYPES.items() for x in p]), F.col("leader.record_type")), F.lit("Unknown"))


def acquisition_status() -> Column:
    return _coded("008", 6, STATUSES)


def method_of_acquisition() -> Column:
    return _coded("008", 7, METHODS)


def completeness() -> Column:
    return _coded("008", 16, COMPLETENESS)


def is_serial_holdings() -> Column:
    return _leader("record_type", "y")


def is_multipart() -> Column:
    return _leader("record_type", "v")


def call_number() -> Column:
    return F.coalesce(_first("090"), _first("050"))


def holding_location() -> Column:
    return _first("852", "b")


def holding_notes() -> Column:
    return E.each_value(E.fields_of_any(str(t) for t in range(500, 510)), "a")
