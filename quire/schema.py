"""The canonical record schema and the literal code tables."""

from __future__ import annotations

LEADER = (
    "struct<record_length int, record_status string, record_type string, bibliographic_level string, control_record_type string, "
    "character_coding string, indicator_count int, subfield_code_count int, data_base_address int, encoding_level string, "
    "cataloging_form string, multipart_level string, reserved string>"
)
SUBFIELD = "struct<code string, value string>"
FIELD = f"struct<tag string, tag_rank int, occ int, ind1 string, ind2 string, subfields array<{SUBFIELD}>>"
CONTROL = "struct<tag string, occ int, value string>"
ERROR = (
    "struct<code string, slug string, message string, record_index bigint, byte_offset bigint, record_byte_offset bigint, field_tag string, "
    "indicator_position int, subfield_code string, found binary, expected string, record_control_number string, expected_length bigint, "
    "actual_length bigint, bytes_near binary>"
)
RECORD = f"rec_id bigint, kind string, source string, rec_index bigint, byte_offset bigint, leader {LEADER}, control array<{CONTROL}>, fields array<{FIELD}>, errors array<{ERROR}>"
LONG = "rec_id bigint, kind string, tag string, tag_rank int, occ int, ind1 string, ind2 string, sf_pos int, code string, code_occ int, value string"
TRIPLE = "rec_id bigint, seq int, s string, s_kind string, p string, o string, o_kind string, lang string, datatype string"

def _tags(century: str, rest: str) -> tuple[str, ...]:
    return tuple(century + x for x in rest.split())


SUBJECT_TAGS = _tags("6", "00 10 11 30 48 50 51 53 54 55 56 57 58 62 90 91 96 97 98 99")
NARROW_SUBJECT_TAGS = SUBJECT_TAGS[:7] + ("655",)
NAME_TAGS = ("100", "600", "610", "611", "700", "710", "711")
LINK_HEADS = ("00", "10", "11", "30", "48", "50", "51", "55")
HEADING_TAGS = {"100": "PersonalName", "110": "CorporateName", "111": "MeetingName", "130": "UniformTitle", "148": "ChronologicalTerm", "150": "TopicalTerm", "151": "GeographicName", "155": "GenreFormTerm"}

SLUGS = {
    "E001": "record_length_invalid", "E002": "leader_invalid", "E003": "base_address_invalid", "E004": "base_address_not_found", "E005": "truncated_record",
    "E006": "end_of_record_not_found", "E007": "io_error", "E099": "fatal_reader_error", "E101": "directory_invalid", "E105": "field_not_found",
    "E106": "invalid_field", "E201": "invalid_indicator", "E202": "bad_subfield_code", "E301": "utf8_invalid", "E401": "marcxml_invalid",
    "E402": "marcjson_invalid", "E404": "record_too_large_for_iso2709", "W001": "bad_subfield_code_warning",
}

#: Leader positions with closed code sets: code=label, separated by semicolons ("_" stands for a blank).
_LEADER_CODES = {
    5: "a=Increase in encoding level;c=Corrected or revised;d=Deleted;n=New;p=Increase in encoding level from prepublication",
    6: "a=Language material;c=Notated music;d=Manuscript notated music;e=Cartographic material;f=Manuscript cartographic material;g=Projected medium;"
    "i=Nonmusical sound recording;j=Musical sound recording;k=Two-dimensional nonprojectable graphic;m=Computer file;o=Kit;p=Mixed materials;"
    "r=Three-dimensional artifact or naturally occurring object;t=Manuscript language material",
    7: "a=Monographic component part;b=Serial component part;c=Collection;d=Subunit;i=Integrating resource;m=Monograph/Item;s=Serial",
    8: "#=No specified type;a=Archival",
    9: "_=MARC-8;a=UCS/Unicode",
    17: "_=Full level;1=Full level, material not examined;2=Less-than-full level, material not examined;3=Abbreviated level;4=Core level;"
    "5=Partial (preliminary) level;7=Minimal level;8=Prepublication level;u=Unknown;z=Not applicable",
    18: "_=Non-ISBD;a=AACR 2;c=ISBD punctuation omitted;i=ISBD punctuation included;n=Non-ISBD punctuation omitted;u=Unknown",
    19: "_=Not specified or not applicable;a=Set;b=Part with independent title;c=Part with dependent title",
}
LEADER_CODES: dict[int, dict[str, str]] = {at: {x[0].replace("_", " "): x[2:] for x in text.split(";")} for at, text in _LEADER_CODES.items()}
LEADER_FIELDS = {5: "record_status", 6: "record_type", 7: "bibliographic_level", 8: "control_record_type", 9: "character_coding", 17: "encoding_level", 18: "cataloging_form", 19: "multipart_level"}

_FREE, _BLANK = "", " #"
_NOTES = _tags("5", "00 01 02 04 05 06 08 11 20 21 22 24 25 26 30 33 35 38 41 46 47 50 52 55 56 61 62 63 65 67 70 80 81 83 86 88")
_DIGITS = "0123456789"
#: tag -> the characters allowed as first and second indicator
INDICATOR_RULES: dict[str, tuple[str, str]] = {
    **dict.fromkeys(_tags("0", "10 20 24 28 30 35 37 40") + _NOTES + _tags("8", "00 10 11 30 40 56"), (_BLANK, _BLANK)),
    **{t: ("013", _BLANK) for t in ("100",)},
    "110": ("12", _BLANK),
    "111": ("012", _BLANK),
    "130": (_DIGITS, _BLANK),
    "240": ("01", _DIGITS),
    "245": ("01", _DIGITS),
    "490": ("01", _BLANK),
    "600": ("013", "01234567"),
    "610": ("12", "01234567"),
    "611": ("012", "01234567"),
    "650": (_BLANK, "01234567"),
    "651": (_BLANK, "01234567"),
    "700": ("013", "# 2"),
    "710": ("12", "# 2"),
    "711": ("012", "# 2"),
    "740": (_DIGITS, "# 2"),
}
