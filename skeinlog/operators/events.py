"""Records to events: the envelope, the event time, the tags and the labels.

An events DataFrame has the columns ``event, host, agent, log, ecs`` (structs), ``labels`` (map),
``tags`` (array or NULL), ``@timestamp``, ``message``, ``body`` (VARIANT or NULL) and the order
columns ``_blk, _mid``. The body never overrides a column of the envelope.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog import __version__
from skeinlog.functions import instants
from skeinlog.functions.patterns import grok_regex, java_regex
from skeinlog.functions.variants import json_path, string_at
from skeinlog.operators.predicates import RESERVED
from skeinlog.plans.profile import EventTime, LabelFilter, LogInput, Profile, field_refs

# Fixed values of the envelope.
ECS_VERSION = "8.11"
AGENT_TYPE = "skeinlog"
JSON_FAILURE_TAG = "_jsonparsefailure"

EVENT_ORDER = ("@timestamp", "host.name", "log.file.path", "_blk", "_mid")


def tags_column(inp: LogInput) -> Column:
    """The configured tags, and the failure tag on a JSON line without an object."""
    fixed = [F.lit(tag) for tag in dict.fromkeys(inp.tags)]
    given = F.array(*fixed) if fixed else F.lit(None).cast("array<string>")
    if inp.framing.codec != "json" or JSON_FAILURE_TAG in inp.tags:
        return given
    failed = F.array(*fixed, F.lit(JSON_FAILURE_TAG))
    return F.when(F.col("body").isNull(), failed).otherwise(given)


def event_time(time: EventTime, collected: Column) -> Column:
    """The record's own time, or the collection time where there is none to read."""
    body, message = F.col("body"), F.col("value")
    if time.field is not None:
        if time.field == "message":
            found = instants.iso_time(message)
        elif time.field in RESERVED:
            found = F.lit(None).cast("timestamp")
        else:
            found = instants.iso_time(string_at(body, [time.field]))
    elif time.pattern is not None:
        regex = java_regex(time.pattern)
        text = F.regexp_extract(message, regex.pattern, 1 if regex.groups else 0)
        found = instants.formatted_time(text, time.format)
    else:
        # The shape of an ISO time excludes every JSON value but a text.
        own = F.try_variant_get(body, json_path(["timestamp"]), "string")
        found = F.coalesce(instants.iso_time(own), instants.leading_time(message))
    return F.coalesce(found, collected)


def _reference(refs: list[str], labels: dict[str, Column], dataset: str, profile: str) -> Column:
    """What ``[a][b]`` names, if it is a text: an envelope value, a label or a body field."""
    known = {
        ("type",): F.lit(dataset),
        ("event", "dataset"): F.lit(dataset),
        ("host", "name"): F.col("host"),
        ("log", "file", "path"): F.col("path"),
        ("message",): F.col("value"),
        ("labels", "profile"): F.lit(profile),
        ("agent", "type"): F.lit(AGENT_TYPE),
        ("agent", "version"): F.lit(__version__),
        ("ecs", "version"): F.lit(ECS_VERSION),
    }
    if tuple(refs) in known:
        return known[tuple(refs)]
    if len(refs) == 2 and refs[0] == "labels":
        return labels.get(refs[1], F.lit(None).cast("string"))
    if refs[0] in RESERVED:
        return F.lit(None).cast("string")
    return string_at(F.col("body"), refs)


def captures(source: Column, pattern: str) -> dict[str, Column]:
    """Named captures of the first match. A macro never captures an empty text, so an empty
    result means no match, and one pass over the text is enough."""
    regex = grok_regex(pattern)
    only_macros = "(?P<" not in pattern
    found = {}
    for name, group in regex.names.items():
        text = F.regexp_extract(source, regex.pattern, group)
        if only_macros:
            found[name] = F.nullif(text, F.lit(""))
        else:
            found[name] = F.when(source.rlike(regex.pattern), text)
    return found


def label_columns(filters: tuple[LabelFilter, ...], dataset: str, profile: str) -> dict[str, Column]:
    """Label name to Column, over the columns host, path, value and body. A later capture
    replaces an earlier one."""
    labels: dict[str, Column] = {"profile": F.lit(profile)}
    for item in filters:
        condition = item.condition_parts()
        applies = None
        if condition is not None:
            refs, wanted = condition
            if refs == ["type"]:
                if wanted != dataset:
                    continue  # decided while the plan is built
            else:
                applies = _reference(refs, labels, dataset, profile).eqNullSafe(wanted)
        for source, pattern in item.grok:
            if source in ("path", "message"):
                text = F.col("path" if source == "path" else "value")
            else:
                refs = field_refs(source)
                if not refs:
                    continue
                text = _reference(refs, labels, dataset, profile)
            for name, value in captures(text, pattern).items():
                if applies is not None:
                    value = F.when(applies, value)
                labels[name] = F.coalesce(value, labels[name]) if name in labels else value
    return labels


def to_events(records: DataFrame, profile: Profile, inp: LogInput, collected=None) -> DataFrame:
    """Wrap the records of one input. ``collected`` is the collection time: a datetime, a Column
    (``F.current_timestamp()`` in a stream) or None for the time the plan is built."""
    if collected is None or isinstance(collected, datetime):
        collected = F.lit(collected or datetime.now().astimezone())
    if "body" not in records.columns:
        records = records.withColumn("body", F.lit(None).cast("variant"))
    labels = label_columns(profile.filters, inp.type, profile.name)
    names = F.array(*[F.lit(n) for n in labels])
    pairs = F.map_from_arrays(names, F.array(*[c.cast("string") for c in labels.values()]))
    if len(labels) > 1:
        pairs = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return records.select(
        F.struct(F.lit(inp.type).alias("dataset"), collected.alias("created")).alias("event"),
        F.struct(F.col("host").alias("name")).alias("host"),
        F.struct(F.lit(AGENT_TYPE).alias("type"), F.lit(__version__).alias("version")).alias("agent"),
        F.struct(F.struct(F.col("path").alias("path")).alias("file")).alias("log"),
        F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"),
        pairs.alias("labels"),
        tags_column(inp).alias("tags"),
        event_time(inp.time, collected).alias("@timestamp"),
        F.col("value").alias("message"),
        "body",
        F.col("blk").alias("_blk"),
        F.col("mid").alias("_mid"),
    )
