"""The values that a dotted field name has in a VARIANT record.

A name may be laid out as nested objects, as keys with dots in them, or both. At each object the
longest key that exists is taken, whatever it holds, and the rest of the name goes on from there.
A list on the way stands for each of its elements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions.variants import as_array, as_object, json_path, once, opened, quotable

# Names of so few segments are read by paths, which a stored table can prune by; the number of paths
# doubles with each segment, so longer names are walked instead. Both find the same value.
DIRECT_SEGMENTS = 3


def is_direct(segments: list[str]) -> bool:
    return len(segments) <= DIRECT_SEGMENTS and all(map(quotable, segments))


def direct(value: Column, segments: list[str], type_: str, reserved: tuple[str, ...] = ()) -> Column:
    """The field as ``type_``, not looking into lists; NULL where it is missing or of another type."""

    def at(keys: list[str], as_type: str) -> Column:
        return F.try_variant_get(value, json_path(keys), as_type)

    def below(keys: list[str], rest: list[str]) -> Column:
        if not rest:
            return at(keys, type_)
        found = F.lit(None).cast(type_)
        for n in range(1, len(rest) + 1):
            key = ".".join(rest[:n])
            if not keys and key in reserved:
                continue
            longer = [*keys, key]
            there = at(longer, "variant")
            if n < len(rest):
                found = F.when(there.isNotNull(), below(longer, rest[n:])).otherwise(found) if n > 1 else below(longer, rest[n:])
            else:
                # Mostly one of the layouts is there, so the typed value decides without a second look.
                found = F.coalesce(at(longer, type_), F.when(there.isNull(), found))
        return found

    return below([], segments)


def walked(value: Column, segments: list[str], reserved: tuple[str, ...] = ()) -> Column:
    """All values of the field, as an array<variant> in which no element is a list; empty where it is missing.

    The walk is one loop over the segments. Its state are the places that are still on the way, each
    with the number of segments behind it; the step of a segment moves the places that stand before it.
    """
    n = len(segments)
    steps = []
    for i in range(n):
        keys = [(".".join(segments[i:j]), j) for j in range(n, i, -1)]
        keys = [F.struct(F.lit(k).alias("key"), F.lit(j).alias("to")) for k, j in keys if i or k not in reserved]
        if keys:
            steps.append(F.struct(F.lit(i).alias("behind"), F.array(*keys).alias("keys")))
    if not steps:
        return F.array().cast("array<variant>")

    def taken(element: Column, keys: Column) -> Column:
        """The places one key further, none or one."""
        # A one-element array holds the members, so that the object is opened once.
        return F.flatten(
            F.transform(
                F.array(as_object(element)),
                lambda members: F.transform(
                    F.slice(F.filter(keys, lambda k: F.map_contains_key(members, k["key"])), 1, 1),
                    lambda k: F.struct(k["to"].alias("behind"), F.try_element_at(members, k["key"]).alias("v")),
                ),
            )
        )

    def moved(places: Column, step: Column) -> Column:
        def on(place: Column) -> Column:
            inside = F.flatten(F.transform(elements(place["v"]), lambda e: F.coalesce(taken(e, step["keys"]), none)))
            return F.when(place["behind"] == step["behind"], inside).otherwise(F.array(place))

        return F.flatten(F.transform(places, on)).cast(_PLACES)

    none = F.array().cast(_PLACES)
    start = F.array(F.struct(F.lit(0).alias("behind"), value.alias("v"))).cast(_PLACES)
    ends = F.aggregate(F.array(*steps), start, moved, lambda places: F.filter(places, lambda p: p["behind"] == n))
    return F.flatten(F.transform(ends, lambda p: elements(p["v"])))


_PLACES = "array<struct<behind:int,v:variant>>"


def elements(value: Column) -> Column:
    """A list's elements, lists among them opened, and any other value by itself."""
    return once(as_array(value), lambda items: F.when(items.isNull(), F.array(value)).otherwise(opened(items)))


def list_on_the_way(value: Column, segments: list[str], reserved: tuple[str, ...] = ()) -> Column:
    """Whether any layout of the name has a list before its last key."""

    def layouts(rest: list[str]) -> list[list[str]]:
        cuts = [[".".join(rest[:n]), *tail] for n in range(1, len(rest)) for tail in layouts(rest[n:])]
        return [*cuts, [".".join(rest)]]

    found = F.lit(False)
    for n in range(1, len(segments)):
        for keys in layouts(segments[:n]):
            if keys[0] not in reserved:
                found = found | F.try_variant_get(value, json_path(keys), "array<variant>").isNotNull()
    return found
