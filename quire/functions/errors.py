"""Error structs as JSON and as readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
CLASSES = {
    "E001": "RecordLengthInvalid", "E002": "InvalidLeader", "E003": "BaseAddressInvalid", "E004": "BaseAddressNotFound", "E005": "TruncatedRecord", "E006": "EndOfRecordNotFound",
    "E007": "IoError", "E099": "FatalReaderError", "E101": "DirectoryInvalid", "E105": "FieldNotFound", "E106": "InvalidField", "E201": "InvalidIndicator", "E202": "BadSubfieldCode",
    "E301": "EncodingError", "E401": "XmlError", "E402": "JsonError", "E404": "WriterError",
}
_PLACES = ("record_index", "byte_offset", "record_byte_offset", "field_tag", "indicator_position", "subfield_code", "expected", "record_control_number", "expected_length", "actual_length")


def error_class(error: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p]), error["code"])


def error_json(error: Column) -> Column:
    """One JSON object; what an error does not carry is null, bytes are in hexadecimal under names of their own."""
    parts = [F.lit(SCHEMA_VERSION).alias("schema_version"), error_class(error).alias("class"), error["code"].alias("code"), error["slug"].alias("slug"), F.lit("error").alias("severity")]
    parts += [error[n].alias(n) for n in _PLACES]
    parts += [F.lower(F.hex(error[n])).alias(f"{n}_hex") for n in ("found", "bytes_near")] + [error["message"].alias("message")]
    return F.when(error.isNotNull(), F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def error_detail(error: Column) -> Column:
    """The class and place of an error, then what is known of it line by line."""
    where = F.concat_ws(", ", F.concat(F.lit("record "), error["record_index"].cast("string")), F.concat(F.lit("001 "), error["record_control_number"]), F.concat(F.lit("field "), error["field_tag"]))
    lines = [F.concat(F.lit(f"\n  {label:18}"), error[n].cast("string")) for label, n in (("offset:", "byte_offset"), ("record-relative:", "record_byte_offset"), ("indicator:", "indicator_position"), ("subfield:", "subfield_code"), ("expected:", "expected"), ("expected length:", "expected_length"), ("actual length:", "actual_length"), ("message:", "message"))]
    lines += [F.concat(F.lit(f"\n  {label:18}"), F.lower(F.hex(error[n]))) for label, n in (("found:", "found"), ("bytes near:", "bytes_near"))]
    return F.concat(error_class(error), F.when(where != "", F.concat(F.lit(" at "), where)).otherwise(""), F.concat_ws("", *lines))
