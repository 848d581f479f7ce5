"""Reading values out of a VARIANT record body."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LAST_KEY = "~skein-end-7f3a~"


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row. Catalyst repeats a projected expression in
    every predicate that uses it; a one-element ``explode`` is a step it does not merge, and it
    stays inside whole-stage code generation."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _one_object(text: Column) -> Column:
    """Whether a text is one JSON object with nothing behind it; the parser itself ignores what
    follows the first value. A text whose first closing brace is its last character needs no
    second look. Otherwise the text, set in front of a last key, must leave that key in place."""
    framed = F.concat(F.lit('{"line":'), text, F.lit(f',"{_LAST_KEY}":0}}'))
    return text.rlike(r"\A\s*\{") & (
        (F.instr(text, "}") >= F.length(F.rtrim(text)))
        | (F.json_object_keys(framed) == F.array(F.lit("line"), F.lit(_LAST_KEY)))
    )


def parse_objects(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add VARIANT column ``name``: the JSON object in column ``text``, or NULL when the text is
    not exactly one JSON object."""
    return bind(df, name, F.when(_one_object(F.col(text)), F.try_parse_json(text)))


def quotable(key: str) -> bool:
    """Whether a path can name the key: it is quoted there, and the path language knows no escapes."""
    return key != "" and "?" not in key and not ("'" in key and '"' in key)


def json_path(keys: list[str]) -> str:
    """A VARIANT path; every key is quoted, so it may hold dots and ``@``."""
    return "$" + "".join(f'["{key}"]' if "'" in key else f"['{key}']" for key in keys)


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def brackets(value: Column) -> Column:
    """How many lists and objects a value holds at most: no nesting goes deeper."""
    text = F.try_variant_get(value, "$", "string")
    return F.length(text) - F.length(F.translate(text, "[{", ""))


# Fixed value: lists inside lists are opened so often before their depth is measured.
_SHALLOW = 3


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value, an array<variant>, where the value is computed a single time, however often it
    is used: as the variable of a loop over a one-element array."""
    return F.aggregate(F.array(value), F.array().cast("array<variant>"), lambda _, v: use(v))


def opened(items: Column) -> Column:
    """The elements of a list; lists among them are opened up until none is left."""

    def more(flat: Column) -> Column:
        return F.exists(flat, lambda x: as_array(x).isNotNull())

    # The state of the loops is the list alone: what a struct holds would be copied in each step.
    def step(flat: Column, _: Column) -> Column:
        inside = F.flatten(F.transform(flat, lambda x: F.coalesce(as_array(x), F.array(x))))
        return F.when(more(flat), inside.cast("array<variant>")).otherwise(flat)

    few = F.aggregate(F.array(*[F.lit(i) for i in range(_SHALLOW)]), items.cast("array<variant>"), step)

    def rest(flat: Column) -> Column:
        # Only here the text of what is left is looked at: it bounds the number of steps.
        depth = F.aggregate(flat, F.lit(0), lambda n, x: n + F.coalesce(brackets(x), F.lit(0)))
        return F.aggregate(F.sequence(F.lit(1), depth), flat, step)

    return once(few, lambda flat: F.when(more(flat), rest(flat)).otherwise(flat))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def string_at(body: Column, keys: list[str]) -> Column:
    """The value at nested ``keys`` if it is a JSON string, else NULL."""
    value = F.try_variant_get(body, json_path(keys), "variant")
    return F.when(is_string(value), F.try_variant_get(body, json_path(keys), "string"))
