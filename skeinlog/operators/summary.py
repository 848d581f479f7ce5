"""The field catalog in one pass: what each field holds, without a row for each value.

A task walks its records once and keeps one entry for each field, family, dataset and host: the
number of values, the number of events, and the few smallest values. Entries of two tasks merge by
adding the numbers and keeping the smallest of both, so only entries are shuffled. A task whose
entries grow too many (ids used as keys) hands on what it has and begins anew.

A value is one leaf: objects are opened to dotted names, list elements stand under their list's
name, nulls are left out. An event counts at the family of its first value of a field, where the
members of an object come in the order of their names.

Numbers are shown as they are written. Whole numbers beyond 64 bits count as ``double``.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from json.encoder import encode_basestring as quoted

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.instants import SECONDS_SHAPE, iso_text
from skeinlog.operators.predicates import RESERVED

# Fixed value: how many example values a field shows.
EXAMPLES = 3
MAX_ENTRIES = 100_000  # of one task at a time
_GROUPS = 64

_ENTRY = "field string, family string, dataset string, host string, n bigint, docs bigint, smallest array<string>"
_NAMES = [part.split()[0] for part in _ENTRY.split(", ")]
_KEYS = ["field", "family", "dataset", "host"]
_DATE = re.compile(SECONDS_SHAPE, re.ASCII).match


class _Float(str):
    """A number with a fraction or an exponent, as it is written."""


def family_of(value) -> str:
    kind = type(value)
    if kind is str:
        return "date" if _DATE(value) else "keyword"
    if kind is bool:
        return "boolean"
    if kind is int:
        return "long" if -(1 << 63) <= value < 1 << 63 else "double"
    return "double"


def shown(value) -> str:
    """The JSON text of a leaf."""
    kind = type(value)
    return quoted(value) if kind is str else ("true" if value else "false") if kind is bool else str(value)


def leaf_values(record: dict, max_depth: int | None = None) -> Iterator[tuple[str, object]]:
    """(dotted name, value) of every leaf, members by name and list elements in order."""
    # The members still to come, the next one last.
    open_ = [(name, record[name], 1) for name in sorted(record, reverse=True) if name and name not in RESERVED]
    while open_:
        name, value, depth = open_.pop()
        kind = type(value)
        if kind is dict or kind is list:
            if max_depth is not None and depth > max_depth:
                raise ValueError("a record is nested deeper than max_depth; raise max_depth")
            if kind is dict:
                open_ += [(f"{name}.{key}", value[key], depth + 1) for key in sorted(value, reverse=True)]
            else:
                open_ += [(name, element, depth + 1) for element in reversed(value)]
        elif value is not None:
            yield name, value


class Entries:
    """What a task has found so far."""

    def __init__(self) -> None:
        self.found: dict[tuple, list] = {}  # (field, family, dataset, host) -> [n, docs, smallest]

    def add(self, key: tuple, text: str, n: int = 1, docs: int = 0) -> None:
        entry = self.found.get(key)
        if entry is None:
            self.found[key] = [n, docs, [text]]
            return
        entry[0] += n
        entry[1] += docs
        smallest = entry[2]
        if (len(smallest) < EXAMPLES or text < smallest[-1]) and text not in smallest:
            smallest.append(text)
            smallest.sort()
            del smallest[EXAMPLES:]

    def add_event(self, dataset: str, host: str, leaves: Iterator[tuple[str, object]]) -> None:
        seen = set()
        for field, value in leaves:
            first = field not in seen
            seen.add(field)
            self.add((field, family_of(value), dataset, host), shown(value), 1, int(first))

    def add_texts(self, dataset: str, host: str, fields: list[tuple[str, str]], events: int) -> None:
        """The same texts in so many events."""
        seen = set()
        for field, text in fields:
            if text is not None:
                docs = 0 if field in seen else events
                seen.add(field)
                self.add((field, family_of(text), dataset, host), quoted(text), events, docs)

    def batch(self) -> pa.RecordBatch:
        rows = [(*key, *entry) for key, entry in self.found.items()]
        self.found = {}
        columns = [[_clean(v) for v in column] for column in zip(*rows)] if rows else [[]] * len(_NAMES)
        kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def _clean(value):
    """Half of a surrogate pair, which JSON can write, has no UTF-8."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode()
    return [_clean(v) for v in value] if isinstance(value, list) else value


def _entries(max_depth: int | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, read = Entries(), json.JSONDecoder(parse_float=_Float, strict=False).decode
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            rows = zip(columns["dataset"], columns["host"], columns["message"], columns["is_object"])
            for dataset, host, message, is_object in rows:
                if is_object:
                    entries.add_event(dataset, host, leaf_values(read(message), max_depth))
                if message is not None:
                    entries.add(("message", family_of(message), dataset, host), quoted(message), 1, 1)
                if len(entries.found) > MAX_ENTRIES:
                    yield entries.batch()
            # Most envelopes are alike, so they are counted before they are looked at.
            labels = [tuple(map(tuple, pairs or ())) for pairs in columns["labels"]]
            tags = [tuple(t for t in ts or () if t is not None) for ts in columns["tags"]]
            alike = Counter(zip(columns["dataset"], columns["host"], columns["path"], columns["created"], labels, tags))
            for (dataset, host, path, created, pairs, marks), events in alike.items():
                fields = [("event.dataset", dataset), ("host.name", host), ("log.file.path", path), ("event.created", created)]
                fields += [(f"labels.{name}", text) for name, text in pairs] + [("tags", mark) for mark in marks]
                entries.add_texts(dataset, host, fields + _constant(columns), events)
            times = Counter(zip(columns["dataset"], columns["host"], columns["time"]))
            for (dataset, host, time), events in times.items():
                entries.add_texts(dataset, host, [("@timestamp", time)], events)
        yield entries.batch()

    return step


def _constant(columns: dict[str, list]) -> list[tuple[str, str]]:
    """The envelope texts that are the same in all events of this package."""
    return [(field, columns[name][0]) for field, name in (("agent.type", "type"), ("agent.version", "version"), ("ecs.version", "ecs"))]


def summarize(events: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``field, family, dataset, host, n, docs, smallest``: the merged entries of all events. ``smallest``
    are the JSON texts of the smallest values. One pass over the events."""
    read = events.select(
        F.col("event.dataset").alias("dataset"), F.col("host.name").alias("host"), "message",
        F.col("body").isNotNull().alias("is_object"), iso_text(F.col("`@timestamp`")).alias("time"),
        F.col("log.file.path").alias("path"), iso_text(F.col("event.created")).alias("created"),
        F.map_entries("labels").alias("labels"), "tags", "agent.type", "agent.version", F.col("ecs.version").alias("ecs"),
    )
    pairs = F.transform("labels", lambda e: F.array(e["key"], e["value"]))
    partial = read.withColumn("labels", pairs).mapInArrow(_entries(max_depth), _ENTRY)
    # A field that every task has is merged in groups first.
    group = F.pmod(F.xxhash64("smallest"), F.lit(_GROUPS)).alias("_group")
    return _merged(_merged(partial, *_KEYS, group), *_KEYS).select(*_NAMES)


def _merged(entries: DataFrame, *keys) -> DataFrame:
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("smallest")))), 1, EXAMPLES)
    return entries.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), smallest.alias("smallest"))


def examples(entries: DataFrame) -> DataFrame:
    """``field, examples``: the smallest values of each field over all families, datasets and hosts."""
    found = entries.withColumn("n", F.lit(0)).withColumn("docs", F.lit(0))
    group = F.pmod(F.xxhash64("smallest"), F.lit(_GROUPS)).alias("_group")
    return _merged(_merged(found, "field", group), "field").select("field", F.col("smallest").alias("examples"))
