"""The tables of the library, with declared types: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_F = T.StructField
_INT, _SHORT, _BYTE, _STR = T.IntegerType(), T.ShortType(), T.ByteType(), T.StringType()

CORPUS = T.StructType(
    [
        _F("a_number", _INT),
        _F("terms", T.ArrayType(_STR)),
        _F("name", _STR),
        _F("xrefs", T.ArrayType(_INT)),
        _F("dead", T.BooleanType())
    ]
)
XREFS = T.StructType(
    [
        _F("source", _INT),
        _F("target", _INT),
        _F("y_line_idx", _SHORT),
        _F("link_type", _STR),
        _F("paren", _STR),
        _F("raw_text", _STR),
        _F("stratum", _STR)
    ]
)
SEQ_META = T.StructType([_F("a_number", _INT), _F("keywords", _STR), _F("n_y_lines", _SHORT)])
SPLITS = T.StructType([_F("u", _INT), _F("v", _INT), _F("stratum", _STR), _F("label", _BYTE), _F("lt8_any", _BYTE)])
RELATIONS = T.StructType([_F("program", _INT), _F("calls", _INT)])
AUDIT = T.StructType(
    [
        _F("u", _INT),
        _F("v", _INT),
        _F("source", _INT),
        _F("target", _INT),
        *(_F(c, _STR) for c in ("paren", "raw_text", "name_source", "name_target", "hand_label"))
    ]
)
AUDIT_KEY = T.StructType([_F("u", _INT), _F("v", _INT), _F("stratum", _STR), _F("link_type", _STR)])
