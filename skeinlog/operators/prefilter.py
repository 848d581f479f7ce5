"""Cheap conditions on files and raw lines that hold for every matching event.

They only save work: a query returns the same events with and without them. A condition is made
only where that can be shown; everything else is left to the exact predicate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import instants
from skeinlog.operators.carry import carry_forward
from skeinlog.operators.events import AGENT_TYPE, ECS_VERSION, captures, label_columns
from skeinlog.operators.predicates import RESERVED, Query, TextField
from skeinlog.plans.profile import LabelFilter, LogInput, Profile


# ---------------------------------------------------------------- hosts, inputs, files


def path_labels(profile: Profile, inp: LogInput) -> dict[str, Column]:
    """Labels that only the file path decides: exactly one capture of one filter writes them."""
    writers: dict[str, list[LabelFilter]] = {}
    for item in profile.filters:
        for source, pattern in item.grok:
            single = LabelFilter(((source, pattern),), item.condition)
            for name in label_columns((single,), inp.type, profile.name):
                if name != "profile":
                    writers.setdefault(name, []).append(single)
    found = {}
    for name, items in writers.items():
        condition = items[0].condition_parts()
        by_type = condition is None or condition[0] == ["type"]
        if len(items) == 1 and items[0].grok[0][0] == "path" and by_type:
            found[name] = label_columns(tuple(items), inp.type, profile.name)[name]
    return found


def file_condition(query: Query, profile: Profile, inp: LogInput):
    """A function ``(host, path) -> Column`` that drops files no event of which can match, or
    None. What is not known from the file itself never drops it."""
    labels = path_labels(profile, inp)

    def condition(host: Column, path: Column) -> Column:
        known = {
            "host.name": host,
            "log.file.path": path,
            "event.dataset": F.lit(inp.type),
            "labels.profile": F.lit(profile.name),
            "agent.type": F.lit(AGENT_TYPE),
            "ecs.version": F.lit(ECS_VERSION),
        }
        kept = F.lit(True)
        for needed in query.required:
            if needed.field in known:
                if needed.field == "labels.profile" and _writes_profile(profile):
                    continue
                kept = kept & needed.column(lambda f: TextField(known[f]))
            elif needed.field.startswith("labels.") and needed.field[7:] in labels:
                label = _on_path(profile, inp, needed.field[7:], path)
                kept = kept & (label.isNull() | needed.column(lambda _: TextField(label)))
        return kept

    return condition


def _writes_profile(profile: Profile) -> bool:
    return any("profile" in pattern for item in profile.filters for _, pattern in item.grok)


def _on_path(profile: Profile, inp: LogInput, name: str, path: Column) -> Column:
    """The path label computed from the scan's own path expression, so it prunes at listing."""
    for item in profile.filters:
        condition = item.condition_parts()
        if condition is not None and condition[1] != inp.type:
            continue
        for source, pattern in item.grok:
            if source == "path":
                captured = captures(path, pattern)
                if name in captured:
                    return captured[name]
    return F.lit(None).cast("string")


# ---------------------------------------------------------------- time window


@dataclass(frozen=True)
class Window:
    """Two instants that all matching events lie between, None where it is open. Written times are
    compared by their whole seconds in UTC."""

    since: datetime | None = None
    until: datetime | None = None

    @classmethod
    def of(cls, query: Query) -> Window:
        """The window of the bounds that a query requires."""
        bounds = [(c.kind[0], c.instant()) for c in query.required]
        since = [at for side, at in bounds if at is not None and side == "g"]
        until = [at for side, at in bounds if at is not None and side == "l"]
        return cls(max(since, default=None), min(until, default=None))

    def __bool__(self) -> bool:
        return (self.since or self.until) is not None

    def seconds(self) -> tuple[str, str]:
        """The first and the last second as text; any second lies between the ends of an open side."""
        texts = [at and at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") for at in (self.since, self.until)]
        return texts[0] or "", texts[1] or "~"

    def holds(self, second: Column) -> Column:
        return second.between(*self.seconds())

    def may_hold(self, head: str) -> bool:
        """The decision of :func:`text_in_window` on a Python text."""
        lead = _UTC_LEAD.match(head)
        first, last = self.seconds()
        return lead is None or first <= lead.group(1) <= last


# The same shape as instants.LEADING_TIME, where the zone is UTC or not written.
_UTC_LEAD = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})[.,]\d+(?:Z|[+-]00:?00|(?![+-]\d{2}:?\d{2}|\d))", re.ASCII)


def json_in_window(value: Column, window: Window, key: str = "timestamp") -> Column:
    """False only for a line whose top-level ``key`` is one UTC time outside the window. A line
    with escapes, with the key twice, below other braces or in another form is kept."""
    name = re.escape(key)
    shape = (
        rf'\A\s*\{{[^{{}}\[\]\\]*"{name}"\s*:\s*"'
        r'(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,]\d+)?(?:Z|[+-]00:?00)?"'
    )
    second = F.regexp_extract(value, shape, 1)
    plain = ~F.contains(value, F.lit("\\"))
    once = F.length(value) - F.length(F.replace(value, F.lit(f'"{key}"'), F.lit(""))) == len(key) + 2
    return ~((second != "") & ~window.holds(second) & plain & once)


def text_in_window(value: Column, window: Window) -> Column:
    """False only for a record that leads with a UTC time outside the window."""
    lead = F.regexp_extract(value, instants.LEADING_TIME, 1)
    utc = lead.rlike(r"(?:\.|,)\d+(?:Z|[+-]00:?00)?\z")
    return ~(utc & ~window.holds(F.substr(lead, F.lit(1), F.lit(19))))


def lines_in_window(lines: DataFrame, window: Window) -> DataFrame:
    """Unframed text lines inside the window: the decision of a line that leads with a date and time
    holds for the lines behind it, blank ones included; lines before the first are kept, and so is
    what stands behind a time with another zone or without a fraction."""
    dated = F.col("value").rlike(rf"\A{instants.SECONDS_SHAPE}")
    decision = F.when(text_in_window(F.col("value"), window), "in").otherwise("out")
    carried = carry_forward(lines, F.when(dated, decision))
    kept = carried.where(F.coalesce(F.col("_current") == "in", F.lit(True)))
    return kept.select(*lines.columns)


# ---------------------------------------------------------------- conditions of a query


def needed_window(query: Query, collected: datetime) -> Window | None:
    """The window that a record's own time must lie in, or None. A record whose time cannot be read
    takes the collection time, so there is none where the window holds that time."""
    window = Window.of(query)
    at = collected if collected.tzinfo else collected.replace(tzinfo=timezone.utc)
    second = at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    first, last = window.seconds()
    return window if window and not first <= second <= last else None


def literals(query: Query, inp: LogInput) -> list[str]:
    """Texts that a matching raw JSON line contains, unless it has a backslash."""
    found = [c.literal() for c in query.required] if inp.framing.codec == "json" else []
    return [text for text in found if text is not None]


def line_condition(query: Query, inp: LogInput, collected: datetime) -> Column | None:
    """The raw-line condition of a query, or None."""
    value, kept = F.col("value"), []
    window = needed_window(query, collected)
    if window is not None and inp.framing.codec == "plain" and inp.time.automatic:
        kept.append(text_in_window(value, window))
    own_field = inp.time.pattern is None and inp.time.field not in RESERVED
    if window is not None and inp.framing.codec == "json" and own_field:
        kept.append(json_in_window(value, window, inp.time.field or "timestamp"))
    kept += [F.contains(value, F.lit(t)) | F.contains(value, F.lit("\\")) for t in literals(query, inp)]
    return reduce(Column.__and__, kept) if kept else None


def record_window(query: Query, inp: LogInput, collected: datetime) -> Window | None:
    """The window that decides about multi-line records by their first lines, or None."""
    if inp.framing.codec != "multiline" or not inp.time.automatic:
        return None
    return needed_window(query, collected)
