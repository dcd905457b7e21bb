"""Raw JSON text read strictly: where a field that is read has another type than asked, the whole value counts as unreadable."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.functions.text import once

#: Of a shape: names to "string", "bigint", "boolean", "json" (anything, kept as it is), "text" (anything, as text: strings without quotes, else JSON), ["string"] or a shape. A null or missing field is null.
Shape = dict

_ABSENT = ("STRING", "VOID")  # what may stand in place of a string


def _type(shape) -> str:
    if isinstance(shape, dict):
        return "STRUCT<" + ", ".join(f"{k}: {_type(v)}" for k, v in shape.items()) + ">"
    if isinstance(shape, list):
        return "ARRAY<VARIANT>"
    return {"string": "VARIANT", "json": "VARIANT", "text": "STRING"}.get(shape, shape.upper())


def _is_string(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).isin(*_ABSENT), F.lit(True))


def _fits(x: Column, shape: Shape) -> Column:
    """Strings are read as variants, as the parser would take anything for a string; the other types it checks itself."""
    out = F.lit(True)
    for k, v in shape.items():
        if v == "string":
            out = out & _is_string(x[k])
        elif isinstance(v, list):
            out = out & F.coalesce(F.forall(x[k], _is_string), F.lit(True))
        elif isinstance(v, dict):
            out = out & _fits(x[k], v)
    return out


def _text(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


def _plain(x: Column, shape: Shape) -> Column:
    fields = []
    for k, v in shape.items():
        if v == "string":
            own = _text(x[k])
        elif isinstance(v, list):
            own = F.transform(x[k], lambda e: F.coalesce(_text(e), F.lit("")))
        elif isinstance(v, dict):
            own = F.when(x[k].isNotNull(), _plain(x[k], v))
        else:
            own = x[k]
        fields.append(own.alias(k))
    return F.struct(*fields)


def strict(raw: Column, shape: Shape) -> Column:
    """The JSON object as a struct of the shape; null where it is no JSON object or doesn't fit."""
    asked = _type({**shape, "_bad": "string"}).replace("_bad: VARIANT", "_bad: STRING")
    x = F.from_json(raw, asked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return once(x, lambda v: F.when(v.isNotNull() & v["_bad"].isNull() & _fits(v, shape), _plain(v, shape)))


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return once(F.to_json(F.array(text)), lambda inside: F.substring(inside, F.lit(2), F.length(inside) - 2))


_DECODER = json.JSONDecoder()


def fields_at(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """Name, start and end of each value of the object that begins at ``at``."""
    at += 1
    while True:
        while text[at] in " \t\r\n,":
            at += 1
        if text[at] == "}":
            return
        name, at = _DECODER.raw_decode(text, at)
        while text[at] in " \t\r\n:":
            at += 1
        _, end = _DECODER.raw_decode(text, at)
        yield name, at, end
        at = end


@F.pandas_udf(T.StringType())
def raw_value(lines: pd.Series, names: pd.Series) -> pd.Series:
    """The text of a field's value as it stands in the line; null where it isn't found. Built-ins give JSON written anew only."""

    def own(line: str | None, name: str) -> str | None:
        if line is None:
            return None
        text, found = line.strip(), None
        try:
            for x, a, b in fields_at(text, 0):
                found = text[a:b] if x == name else found
        except (ValueError, IndexError):
            pass
        return found

    return pd.Series([own(*x) for x in zip(lines, names)], dtype=object)


def written_field(raw: Column, name: str, text: Column) -> Column:
    """For ``raw_field``: anew, the JSON text of the object's field where Spark, writing it anew, finds it in the line as it stands; other, where Python has to look.

    text: the field as the parser gives it for a string (see "text" in ``Shape``): a string's characters, any other value's JSON. A line without needless white
    space, as agents write them, has a string quoted behind the field's name, or the JSON. Where a field inside another one could be mistaken for it, the name has to stand there once.
    """
    key = f'"{name}"'
    has = lambda x: F.contains(raw, F.concat(F.lit(key), x))
    once_there = F.octet_length(F.substring_index(raw, key, 1)) + F.octet_length(F.substring_index(raw, key, -1)) + len(key) == F.octet_length(raw)
    quotes = reduce(lambda x, y: x | y, [has(F.lit(x)) for x in (':"', " ", "\t", "\r", "\n")])

    def found(x: Column) -> Column:
        value, first = x["text"], F.substring(x["text"], 1, 1)
        json_like = first.isin(*'[{-0123456789') | value.isin("true", "false", "null")
        said = F.when((~json_like | once_there) & has(F.concat(F.lit(":"), x["quoted"])), x["quoted"])
        ends = has(F.concat(F.lit(":"), value, F.lit(","))) | has(F.concat(F.lit(":"), value, F.lit("}")))
        plain = F.when(json_like & (~quotes | once_there) & ends, value)
        return once(F.when(value.isNotNull(), F.coalesce(said, plain)), lambda y: F.struct(y.alias("anew"), (y.isNull() & (value.isNotNull() | F.contains(raw, F.lit(key)) | F.contains(raw, F.lit("\\u00")))).alias("other")))

    return once(F.struct(text.alias("text"), quoted(text).alias("quoted")), found)


def raw_field(raw: Column, name: str, written: Column) -> Column:
    """The JSON text of a field of the object as it stands in the line, null as ``null``; no value where the field is missing. written: a column with ``written_field``."""
    return F.when(written["other"], raw_value(F.when(written["other"], raw), F.lit(name))).otherwise(written["anew"])
