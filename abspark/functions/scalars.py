"""Column helpers that keep warehouse-style null, text and cast rules on Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

# What trims away (ASCII blanks and the Unicode space characters).
WHITESPACE = (
    " \t\n\v\f\r\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: texts a lenient cast to double accepts.
NUMBER_TEXT = (
    r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
)
# Byte units.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def all_of(predicates: Iterable[Column | None]) -> Column:
    """Conjunction of the predicates; None stands for no restriction."""
    given = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def safe_divide(a: Column, b: Column) -> Column:
    """NULL instead of an error when the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def strict_greatest(*cols: Column) -> Column:
    """greatest() that is NULL as soon as one argument is NULL."""
    return F.when(all_of([c.isNotNull() for c in cols]), F.greatest(*cols))


def strict_least(*cols: Column) -> Column:
    return F.when(all_of([c.isNotNull() for c in cols]), F.least(*cols))


def full_trim(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_double(text: Column) -> Column:
    """Text to double; anything that is not a plain number (like '1.0d') is NULL."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def float_text(x: Column) -> Column:
    """A double as text without a needless fraction: 25.0 reads '25', 1.0E7 '10000000'.
    Very large or very small values stay in exponent form."""
    plain = x.cast("string")
    wide = F.regexp_replace(
        F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), "0+$", ""),
        r"\.$",
        "",
    )
    size = F.abs(x)
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(
            F.contains(plain, F.lit("E")) & (size >= 1e-4) & (size < 1e15),
            wide,
        )
        .otherwise(F.regexp_replace(plain, r"\.0$", ""))
    )


def field_type(schema: StructType, path: str) -> DataType | None:
    """Type found at a dotted path, or None. Arrays are stepped into."""
    current: DataType = schema
    for part in path.split("."):
        if isinstance(current, ArrayType):
            current = current.elementType
        if not isinstance(current, StructType) or part not in current.fieldNames():
            return None
        current = current[part].dataType
    return current


def text_of(value: Column, dtype: DataType | None) -> Column:
    """Cast to text with the float rule above."""
    if isinstance(dtype, (FloatType, DoubleType)):
        return float_text(value.cast("double"))
    return value.cast("string")


def normalize_path(path: str) -> str:
    """Drop blanks around the dots of a dotted path."""
    return re.sub(r"\s*\.\s*", ".", path)


def variant_path(path: str) -> str:
    """Path into a parsed JSON value with one step per dotted segment. Such a path can quote
    one kind of quotes only."""
    steps = []
    for part in path.split("."):
        if '"' not in part:
            steps.append(f'["{part}"]')
        elif "'" not in part:
            steps.append(f"['{part}']")
        else:
            raise ValueError(f"no JSON path can name the key {part!r}")
    return "$" + "".join(steps)


def json_path(path: str) -> str | None:
    """The same as a path into JSON text, whose keys hold no quotes and no question marks
    beside brackets; None where that cannot be said."""
    steps = []
    for part in path.split("."):
        if not re.search(r"['?]", part):
            steps.append(f"['{part}']")
        elif "[" not in part:
            steps.append(f".{part}")
        else:
            return None
    return "$" + "".join(steps)


def scalar_only(found: Column, parsed: Column, bag: Column, path: str) -> Column:
    """``found`` is the text at a path of a JSON bag that was parsed; objects and arrays
    become NULL. A string that merely starts with a brace or bracket is kept, and a number
    with a fraction reads as it is written, which the parsed value does not know (1.0): both
    take another look, but only for such texts."""
    first = F.left(found, F.lit(1))
    kind = F.schema_of_variant(F.try_variant_get(parsed, variant_path(path), "variant"))
    text = F.when(first.isin("{", "["), F.when(kind == "STRING", found))
    raw = json_path(path)
    if raw is not None:
        looks_number = first.isin("-", *"0123456789")
        text = text.when(
            looks_number & ~kind.isin("STRING", "BIGINT"), F.get_json_object(bag, raw)
        )
    return text.otherwise(found)


def json_scalar(bag: Column, path: str) -> Column:
    """Text of the scalar at a dotted path of a JSON bag, or NULL."""
    parsed = F.try_parse_json(bag)
    found = F.try_variant_get(parsed, variant_path(path), "string")
    return scalar_only(found, parsed, bag, path)


def first_with_key(params: Column, key: str) -> Column:
    """First element of a key/value array with that key, or NULL."""
    return F.get(F.filter(params, lambda p: p["key"] == F.lit(key)), F.lit(0))


def param_text(value: Column) -> Column:
    """Text of a parameter value struct: string, else int, float, double."""
    return F.coalesce(
        value["string_value"],
        value["int_value"].cast("string"),
        float_text(value["float_value"].cast("double")),
        float_text(value["double_value"].cast("double")),
    )


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit that keeps the number at 1 or more, two decimals."""
    size = n.cast("double")
    power = reduce(
        lambda acc, i: F.when(size >= float(1024**i), F.lit(i)).otherwise(acc),
        range(1, len(BYTE_UNITS)),
        F.lit(0),
    )
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), power + 1)
    scaled = F.round(size / F.pow(F.lit(1024.0), power), 2)
    return F.when(n.isNull() | (n == 0), F.lit("0 B")).otherwise(
        F.concat(float_text(scaled), F.lit(" "), unit)
    )


def json_text(value: Column, dtype: DataType | None) -> Column:
    """Compact JSON text: structs are serialised, JSON strings are re-emitted without
    the blanks between tokens."""
    if isinstance(dtype, StructType):
        return F.to_json(value)
    return F.to_json(F.try_parse_json(value))
