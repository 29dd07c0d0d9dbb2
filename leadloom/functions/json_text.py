"""Columns of nested types as indented JSON text, in which only quotes, backslashes and control characters are escaped."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
ESCAPES = SHORT | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in SHORT}


def quoted(c: Column) -> Column:
    table = F.array(*(F.struct(F.lit(a).alias("char"), F.lit(b).alias("escape")) for a, b in ESCAPES.items()))
    escaped = F.reduce(table, c, lambda s, e: F.replace(s, e["char"], e["escape"]))
    return F.concat(F.lit('"'), F.when(c.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(c), F.lit('"'))


def number(c: Column) -> Column:
    """A double with the digits that Spark gives it, always with a point or an exponent; the exponent is used under 0.0001 and from 10^16 on."""
    digits = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(digits.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    mantissa = F.regexp_replace(F.split_part(digits, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(digits, F.lit("E"), F.lit(2)).try_cast("int")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    scientific = F.contains(digits, F.lit("E"))
    return F.when(~scientific, digits).when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent)


def _block(items: Column, marks: str, level: int, indent: int) -> Column:
    """Items (an array of texts) between two brackets, each on its line."""
    pad = "\n" + " " * indent * (level + 1)
    body = F.concat(F.lit(marks[0] + pad), F.array_join(items, "," + pad), F.lit("\n" + " " * indent * level + marks[1]))
    return F.when(F.size(items) == 0, marks).otherwise(body)


def indented(c: Column, kind: T.DataType, sparse: Collection[str] = (), indent: int = 2, level: int = 0, path: str = "") -> Column:
    """A column of the given type as JSON: structs with their fields in order, arrays, maps from texts in their order, texts, booleans, numbers, nulls. Other types raise TypeError.
    Structs at the paths in ``sparse`` (field names joined by dots; '' is the top) leave out their null fields; elsewhere these are null."""
    deeper = {"sparse": sparse, "indent": indent, "level": level + 1}
    if isinstance(kind, T.StructType):
        field = lambda f: F.concat(F.lit('"' + "".join(ESCAPES.get(x, x) for x in f.name) + '": '), indented(c[f.name], f.dataType, path=f"{path}.{f.name}".lstrip("."), **deeper))
        items = [F.when(c[f.name].isNotNull(), field(f)) if path in sparse else field(f) for f in kind.fields]
        items = F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")
        text = _block(items, "{}", level, indent)
    elif isinstance(kind, T.ArrayType):
        text = _block(F.transform(c, lambda x: indented(x, kind.elementType, path=path, **deeper)), "[]", level, indent)
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        text = _block(F.transform(F.map_entries(c), lambda e: F.concat(quoted(e["key"]), F.lit(": "), indented(e["value"], kind.valueType, path=path, **deeper))), "{}", level, indent)
    elif isinstance(kind, T.StringType):
        text = quoted(c)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        text = c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(c.cast("double"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(c.isNotNull(), text).otherwise("null")
