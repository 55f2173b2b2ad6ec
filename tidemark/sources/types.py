"""Column types: SQL spellings, names to show, Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Spelling -> name. Unsigned and small integers are kept in the next type that holds them.
_NAMES = {
    "boolean": "boolean bool",
    "int8": "tinyint",
    "int16": "smallint int2 int16",
    "int32": "int integer int4 mediumint int32",
    "int64": "bigint int8 int64 signed hugeint int128 int256",
    "uint8": "uint8 utinyint",
    "uint16": "uint16 usmallint",
    "uint32": "uint32",
    "uint64": "uint64 ubigint unsigned uhugeint uint128 uint256",
    "float32": "float real float4 float32",
    "float64": "double float8 float64",
    "date": "date date32",
    "timestamp": "timestamp datetime datetime64 timestamptz",
    "time": "time",
    "string": "varchar char character text tinytext mediumtext longtext string fixedstring nvarchar clob",
    "binary": "binary varbinary blob bytea bytes tinyblob mediumblob longblob",
}
_SPELLED = {word: name for name, words in _NAMES.items() for word in words.split()}
_UNSIGNED = {"int8": "uint8", "int16": "uint16", "int32": "uint32", "int64": "uint64"}
_SPARK = {
    "boolean": T.BooleanType(), "int8": T.IntegerType(), "int16": T.IntegerType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.IntegerType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.LongType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "time": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(),
}


class UnsupportedType(ValueError):
    """The spelling names no column type."""


def type_name(spelling: str) -> str:
    """The name of the type a SQL spelling means, as SHOW COLUMNS has it; lengths are passed over."""
    s = re.sub(r"\s+", " ", spelling.strip().lower())
    s = re.sub(r"\s+(with(out)? time zone|precision)$", "", s)
    m = re.fullmatch(r"(decimal|numeric|dec)(?: unsigned)?(?: ?\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", s)
    if m:
        return f"decimal({m[2] or 38},{m[3] or (0 if m[2] else 10)})"
    m = re.fullmatch(r"(char|character) varying(?: ?\(.*\))?|character large object|char large object", s)
    if m:
        return "string"
    m = re.fullmatch(r"(\w+)(?: ?\([^)]*\))?( unsigned)?( integer)?", s)
    name = _SPELLED.get(m[1]) if m else None
    if m and m[2] and name:
        name = _UNSIGNED.get(name, name if name.startswith(("float", "uint")) else None)
    if not name:
        raise UnsupportedType(f"unsupported SQL data type: {spelling.strip()}")
    return name


def spark_type(name: str) -> T.DataType:
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", name)
    return T.DecimalType(int(m[1]), int(m[2])) if m else _SPARK[name]


def name_of(kind: T.DataType) -> str:
    """The name of a Spark type that a table can have."""
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    for name in ("boolean", "int32", "int64", "float32", "float64", "date", "timestamp", "string", "binary"):
        if _SPARK[name] == kind:
            return name
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return "int32"
    if isinstance(kind, T.TimestampNTZType):
        return "timestamp"
    raise UnsupportedType(f"unsupported data type: {kind.simpleString()}")
