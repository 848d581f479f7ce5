"""

Every query runs one operator of the library over whole given tables, read as log lines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions.instants import iso_text
from skeinlog import __version__
from skeinlog.operators import catalog, framing, sinks, summary
from skeinlog.operators.demux import demux
from skeinlog.operators.events import to_events
from skeinlog.operators.predicates import BodyFields, compile_query, predicate
from skeinlog.operators.prefilter import Window, lines_in_window
from skeinlog.plans.discovery import discover_fields
from skeinlog.plans.profile import Framing, LogInput, Profile, profile_from_dict
from skeinlog.plans.search import (
    differences,
    files_to_read,
    lines_to_events,
    search,
    search_events,
)
from skeinlog.session import prepare
from skeinlog.sources import tables
from skeinlog.sources.tables import save
from skeinlog.sources.inventory import discover, input_files, missing_hosts
from skeinlog.sources.lines import last_lines
from skeinlog.sources.records import range_records
from skeinlog.streaming.tail import open_records, tail, write_stream

COLLECTED = datetime(2025, 6, 1, tzinfo=timezone.utc)
TYPES = ("click", "error", "purchase", "signup", "view")
JSON_INPUT = LogInput("events", ("*.json",), framing=Framing("json"))
PROFILE = Profile("shop", ("h0", "h1", "h2", "h3"), (JSON_INPUT,), "/logs")

QueryFunction = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFunction] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the function's name, with its SQL."""

    def register(function: QueryFunction) -> QueryFunction:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        _QUERIES[function.__name__] = run
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- helpers


def _events(spark: SparkSession, sf_dir: str, record=None, profile: Profile = PROFILE) -> DataFrame:
    lines = tables.event_lines(spark, sf_dir, record)
    return to_events(framing.frame_json(lines), profile, profile.inputs[0], COLLECTED)


def _body(path: str, type_: str):
    return F.try_variant_get("body", f"$.{path}", type_)


def _time():
    return iso_text(F.col("`@timestamp`")).alias("event_time")


def _shown(events: DataFrame) -> DataFrame:
    return events.select(
        _body("event_id", "bigint").alias("event_id"),
        F.col("host.name").alias("host_name"),
        _time(),
    )


def _search(filter_: dict, record=None) -> QueryFunction:
    return lambda spark, sf_dir: _shown(search_events(_events(spark, sf_dir, record), filter_))


# The event time as the library renders it: no fraction when it is zero.
_TIME = (
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
    "(case when strftime(ts, '%f') = '000000' then '' else '.' || strftime(ts, '%f') end) || '+00:00'"
)
_K = "try_cast(json_extract_string(props, '$.k') as double)"


def _shown_sql(where: str) -> str:
    return (
        f"select event_id, 'h' || (user_id % 4) as host_name, {_TIME} as event_time "
        f"from events where {where}"
    )


# ---------------------------------------------------------------- predicates and search


@query(_shown_sql(f"event_type = 'error' and {_K} >= 50"))
def search_flagship(spark, sf_dir):
    return _search(
        {
            "bool": {
                "filter": [
                    {"term": {"event_type": "error"}},
                    {"range": {"props.k": {"gte": 50}}},
                ]
            }
        }
    )(spark, sf_dir)


@query(_shown_sql("true"))
def search_match_all(spark, sf_dir):
    return _search({"match_all": {}})(spark, sf_dir)


@query(_shown_sql("event_type = 'error'"))
def search_term(spark, sf_dir):
    return _search({"query": {"term": {"event_type": {"value": "error"}}}})(spark, sf_dir)


@query(_shown_sql(f"{_K} = 42"))
def search_term_number_in_text(spark, sf_dir):
    return _search({"term": {"props.k": 42.0}})(spark, sf_dir)


@query(_shown_sql("event_type in ('click', 'view')"))
def search_terms(spark, sf_dir):
    return _search({"terms": {"event_type": ["click", "view", "none"]}})(spark, sf_dir)


@query(_shown_sql("false"))
def search_terms_empty(spark, sf_dir):
    return _search({"terms": {"event_type": []}})(spark, sf_dir)


@query(_shown_sql(f"{_K} >= 50 and {_K} < 90"))
def search_range_numeric_string(spark, sf_dir):
    return _search({"range": {"props.k": {"gte": 50, "lt": "90"}}})(spark, sf_dir)


@query(_shown_sql("event_type >= 'e' and event_type < 's'"))
def search_range_text(spark, sf_dir):
    return _search({"range": {"event_type": {"gte": "e", "lt": "s"}}})(spark, sf_dir)


@query(_shown_sql("ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-20 10:00:00'"))
def search_range_time(spark, sf_dir):
    bounds = {"gte": "2024-01-05T00:00:00Z", "lt": "2024-01-20T12:00:00+02:00"}
    return _search({"range": {"@timestamp": bounds}})(spark, sf_dir)


@query(_shown_sql("ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-20 00:00:00'"))
def search_range_date(spark, sf_dir):
    return _search({"range": {"@timestamp": {"gte": "2024-01-05", "lte": "2024-01-20"}}})(
        spark, sf_dir
    )


@query(_shown_sql("ts >= timestamp '2024-01-05 00:00:00.5'"))
def search_range_time_in_body(spark, sf_dir):
    return _search({"range": {"timestamp": {"gte": "2024-01-05T00:00:00.5"}}})(spark, sf_dir)


@query(
    _shown_sql(
        f"(event_type = 'error' or {_K} >= 80) and not (user_id % 4 = 1) and not (value < 10)"
    )
)
def search_bool_mix(spark, sf_dir):
    return _search(
        {
            "bool": {
                "must": {
                    "bool": {
                        "should": [
                            {"term": {"event_type": "error"}},
                            {"range": {"props.k": {"gte": 80}}},
                        ]
                    }
                },
                "must_not": [{"term": {"host.name": "h1"}}, {"range": {"value": {"lt": 10}}}],
            }
        }
    )(spark, sf_dir)


@query(_shown_sql("event_type = 'error'"))
def search_should_optional(spark, sf_dir):
    return _search(
        {
            "bool": {
                "filter": [{"term": {"event_type": "error"}}],
                "should": [{"range": {"props.k": {"gte": 80}}}],
            }
        }
    )(spark, sf_dir)


@query(_shown_sql(f"event_type = 'error' and ({_K} >= 80 or value > 50)"))
def search_should_required(spark, sf_dir):
    return _search(
        {
            "bool": {
                "filter": [{"term": {"event_type": "error"}}],
                "should": [
                    {"range": {"props.k": {"gte": 80}}},
                    {"range": {"value": {"gt": 50}}},
                ],
                "minimum_should_match": "1",
            }
        }
    )(spark, sf_dir)


def _without_k_on_even():
    k = F.when(F.col("event_id") % 2 == 1, F.col("k"))
    return F.struct(
        tables.utc_text(F.col("ts")).alias("timestamp"), "event_id", F.struct(k.alias("k")).alias("props")
    )


@query(_shown_sql(f"event_id % 2 = 0 or {_K} <> 42"))
def search_must_not_missing(spark, sf_dir):
    return _search({"bool": {"must_not": {"term": {"props.k": 42}}}}, _without_k_on_even())(
        spark, sf_dir
    )


@query(
    "select d.doc_id, l.quality is not null as has_quality, length(d.text) > 0 and d.doc_id % 3 = 2 "
    "as has_list, true as has_object from documents d left join labels l using (doc_id)"
)
def search_exists(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    labels = tables.read(spark, sf_dir, "labels")
    # A list that is empty, holds only null, or holds a value; a quality that may be null.
    listed = (
        F.when(F.col("doc_id") % 3 == 0, "[]")
        .when(F.col("doc_id") % 3 == 1, "[null]")
        .otherwise("[null,1]")
    )
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("null"))
    line = F.concat(
        F.lit('{"doc_id":'), F.col("doc_id"), F.lit(',"quality":'), quality,
        F.lit(',"list":'), listed, F.lit(',"o":{}}'),
    )
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("host"), F.lit("/docs").alias("path"), "doc_id", line.alias("line")
    )
    records = framing.frame_json(tables.as_lines(rows, F.col("line"), "doc_id"))
    fields = BodyFields()

    def has(field: str):
        return F.coalesce(predicate({"exists": {"field": field}}, fields), F.lit(False))

    return records.select(
        _body("doc_id", "bigint").alias("doc_id"),
        has("quality").alias("has_quality"),
        has("list").alias("has_list"),
        has("o").alias("has_object"),
    )


def _pages(spark, sf_dir) -> DataFrame:
    rows = tables.read(spark, sf_dir, "pages").select(
        F.concat(F.lit("h"), F.col("page_id") % 3).alias("host"),
        F.concat(F.lit("/logs/"), F.regexp_extract("url", "//([^/]*)", 1), F.lit(".log")).alias("path"),
        "page_id",
        F.to_json(F.struct("page_id", "url")).alias("line"),
    )
    records = framing.frame_json(tables.as_lines(rows, F.col("line"), "page_id"))
    return to_events(records, PROFILE, JSON_INPUT, COLLECTED)


def _page_rows(events: DataFrame) -> DataFrame:
    return events.select(_body("page_id", "bigint").alias("page_id"), _body("url", "string").alias("url"))


@query("select page_id, url from pages where regexp_matches(url, '(?s)^.*\\.example\\..*/en/.?[0-9].*$')")
def search_wildcard(spark, sf_dir):
    # [0-9] is a class in a value that has wildcards.
    events = _pages(spark, sf_dir)
    wanted = [{"wildcard": {"url": p}} for p in ("*.example.*/en/[0-9]*", "*.example.*/en/?[0-9]*")]
    return _page_rows(search_events(events, {"bool": {"should": wanted}}))


@query("select page_id, url from pages where starts_with(url, 'https://m.')")
def search_prefix(spark, sf_dir):
    return _page_rows(search_events(_pages(spark, sf_dir), {"prefix": {"url": "https://m."}}))


@query(
    "select conv_id, list_contains(list(role), 'system') as has_system, "
    "bool_or(role like 'a%') as has_a, max(turn) >= 3 as has_late from conversations group by conv_id"
)
def search_any_element(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations")
    conversations = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns")
    )
    rows = conversations.select(
        F.lit("h0").alias("host"), F.lit("/logs/chat.json").alias("path"), "conv_id",
        F.to_json(F.struct("conv_id", F.col("turns.role").alias("roles"), F.col("turns.turn").alias("nr"))).alias("line"),
    )
    records = framing.frame_json(tables.as_lines(rows, F.col("line"), "conv_id"))
    fields = BodyFields()
    return records.select(
        _body("conv_id", "bigint").alias("conv_id"),
        predicate({"term": {"roles": "system"}}, fields).alias("has_system"),
        predicate({"wildcard": {"roles": "a*"}}, fields).alias("has_a"),
        predicate({"range": {"nr": {"gte": 3}}}, fields).alias("has_late"),
    )


@query(
    "select conv_id, bool_or(role = 'user' ) as has_user, "
    "bool_or(text like '%a%') as has_text from conversations group by conv_id"
)
def search_list_of_objects(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations")
    conversations = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    rows = conversations.select(
        F.lit("h0").alias("host"), F.lit("/logs/chat.json").alias("path"), "conv_id",
        F.to_json(F.struct("conv_id", F.struct("turns").alias("chat"))).alias("line"),
    )
    records = framing.frame_json(tables.as_lines(rows, F.col("line"), "conv_id"))
    fields = BodyFields()
    return records.select(
        _body("conv_id", "bigint").alias("conv_id"),
        F.coalesce(predicate({"term": {"chat.turns.role": "user"}}, fields), F.lit(False)).alias("has_user"),
        F.coalesce(predicate({"wildcard": {"chat.turns.text": "*a*"}}, fields), F.lit(False)).alias("has_text"),
    )


@query(_shown_sql(f"{_K} >= 50"))
def search_flat_dotted(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    record = F.struct(
        tables.utc_text(F.col("ts")).alias("timestamp"),
        "event_id",
        F.when(even, F.col("k")).alias("props.sub.k"),
        F.when(~even, F.struct(F.col("k").alias("sub.k"))).alias("props"),
    )
    return _search({"range": {"props.sub.k": {"gte": 50}}}, record)(spark, sf_dir)


@query(_shown_sql("event_type = 'error'") + " order by ts, 'h' || (user_id % 4), event_id limit 50")
def search_limit_earliest(spark, sf_dir):
    events = _events(spark, sf_dir)
    return _shown(search_events(events, {"term": {"event_type": "error"}}, 50, "earliest"))


@query(
    "select least(50, count(*)) as n, 0 as wrong from events where event_type = 'error'"
)
def search_limit_any(spark, sf_dir):
    events = _events(spark, sf_dir)
    found = search_events(events, {"term": {"event_type": "error"}}, 50, "any")
    wrong = F.when(_body("event_type", "string") == "error", 0).otherwise(1)
    return found.agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong"))


# ---------------------------------------------------------------- profiles: several inputs


def _typed_profile(**options) -> Profile:
    spec = {
        "hosts": ["h0", "h1", "h2", "h3"],
        "base_dir": "/logs",
        "inputs": [{"type": t, "path": [f"{t}.json"], "codec": "json"} for t in TYPES],
        **options,
    }
    return profile_from_dict("shop", spec)


def _typed_events(spark, sf_dir, profile: Profile, query_=None, prefilter=True, record=None) -> DataFrame:
    lines = tables.event_lines(spark, sf_dir, record)
    parts = [
        lines_to_events(
            lines.where((F.col("path") == f"/logs/{inp.type}.json") & F.col("host").isin(*profile.hosts)),
            profile, inp, COLLECTED, query_, prefilter,
        )
        for inp in profile.inputs
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "select event_id, event_type as dataset, 'h' || (user_id % 4) as host_name from events "
    "where event_type = 'click' and user_id % 4 in (0, 2)"
)
def scope_host_type(spark, sf_dir):
    scoped = _typed_profile().scope("click", ["h0,h2"])
    events = _typed_events(spark, sf_dir, scoped)
    return events.select(
        _body("event_id", "bigint").alias("event_id"),
        F.col("event.dataset").alias("dataset"),
        F.col("host.name").alias("host_name"),
    )


_AUDITS = {
    "time": {"range": {"@timestamp": {"gte": "2024-01-05T00:00:00Z", "lte": "2024-01-20T00:00:00Z"}}},
    "term": {"bool": {"filter": [{"term": {"event_type": "error"}}, {"term": {"host.name": "h1"}}]}},
    "number": {"bool": {"filter": [{"term": {"props.k": "42"}}, {"term": {"user.id": 7}}]}},
    "dataset": {"bool": {"filter": [{"term": {"event.dataset": "view"}}, {"exists": {"field": "value"}}]}},
}


@query(
    "select 'time' as name, 0 as differing, count(*) as matches from events "
    "where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20' union all "
    "select 'term', 0, count(*) from events where event_type = 'error' and user_id % 4 = 1 union all "
    f"select 'number', 0, count(*) from events where {_K} = 42 and user_id = 7 union all "
    "select 'dataset', 0, count(*) from events where event_type = 'view'"
)
def prefilter_audit(spark, sf_dir):
    profile = _typed_profile()
    rows = []
    for name, filter_ in _AUDITS.items():
        compiled = compile_query(filter_)
        runs = [
            search_events(_typed_events(spark, sf_dir, profile, compiled, on), compiled)
            for on in (True, False)
        ]
        differing = differences(*runs).agg(F.count("*").alias("differing"))
        matches = runs[0].agg(F.count("*").alias("matches"))
        rows.append(
            matches.select(F.lit(name).alias("name"), differing.scalar().alias("differing"), "matches")
        )
    return reduce(DataFrame.unionByName, rows)


@query(
    "select event_id from events where event_type = 'view' and user_id % 4 = 3 "
    "and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25'"
)
def prefilter_search(spark, sf_dir):
    filter_ = compile_query(
        {
            "bool": {
                "filter": [
                    {"term": {"event.dataset": "view"}},
                    {"term": {"host.name": "h3"}},
                    {"term": {"event_type": "view"}},
                    {"range": {"@timestamp": {"gte": "2024-01-05T00:00:00Z", "lt": "2024-01-25T00:00:00Z"}}},
                ]
            }
        }
    )
    events = _typed_events(spark, sf_dir, _typed_profile(), filter_)
    return search_events(events, filter_).select(_body("event_id", "bigint").alias("event_id"))


# ---------------------------------------------------------------- framing

_DOC_LINES = (
    "select doc_id, i - 1 as mid, l as value from (select doc_id, "
    "unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i "
    "from documents)"
)


@query(_DOC_LINES)
def frame_plain(spark, sf_dir):
    lines = framing.frame_plain(tables.document_lines(spark, sf_dir))
    return lines.select(tables.doc_id().alias("doc_id"), "mid", "value")


# Every seventh line is cut, every eleventh is blank, every thirteenth is not an object.
_BROKEN = "case when event_id % 7 = 0 then 0 when event_id % 13 = 0 then 0 else 1 end"


def _broken_lines(spark, sf_dir) -> DataFrame:
    lines = tables.event_lines(spark, sf_dir)
    at = F.col("mid")
    value = (
        F.when(at % 11 == 0, F.lit("  "))
        .when(at % 7 == 0, F.substr("value", F.lit(1), F.length("value") - 5))
        .when(at % 13 == 0, F.concat(F.lit("["), "value", F.lit("]")))
        .otherwise(F.col("value"))
    )
    return lines.withColumn("value", value)


@query(
    f"select event_id as mid, {_BROKEN} as parsed, case when {_BROKEN} = 1 then event_type end "
    "as event_type from events where event_id % 11 <> 0"
)
def frame_json(spark, sf_dir):
    return framing.frame_json(_broken_lines(spark, sf_dir)).select(
        "mid",
        F.when(F.col("body").isNull(), 0).otherwise(1).alias("parsed"),
        _body("event_type", "string").alias("event_type"),
    )


def _records_sql(record_number: str) -> str:
    """Gap-and-island over the lines, as SQL window functions."""
    return (
        f"with lines as ({_DOC_LINES}), "
        "marked as (select *, regexp_matches(value, '^[A-Z]') as hit from lines), "
        f"numbered as (select *, {record_number} as record from marked) "
        "select doc_id, min(mid) as mid, string_agg(value, chr(10) order by mid) as value "
        "from numbered group by doc_id, record"
    )


_PREVIOUS = _records_sql(
    "sum(case when hit then 1 else 0 end) over (partition by doc_id order by mid)"
)
_NEXT = _records_sql(
    "sum(case when hit then 0 else 1 end) over (partition by doc_id order by mid) "
    "- (case when hit then 0 else 1 end)"
)
_BY_CAPITAL = Framing("multiline", pattern="^[A-Z]", negate=True)
_CAPITAL_NEXT = Framing("multiline", pattern="^[A-Z]", what="next")


def _framed(spark, sf_dir, how: Framing, split_every=None) -> DataFrame:
    lines = tables.document_lines(spark, sf_dir, split_every)
    return framing.frame_multiline(lines, how).select(tables.doc_id().alias("doc_id"), "mid", "value")


@query(_PREVIOUS)
def frame_multiline_previous(spark, sf_dir):
    return _framed(spark, sf_dir, _BY_CAPITAL)


@query(_NEXT)
def frame_multiline_next(spark, sf_dir):
    return _framed(spark, sf_dir, _CAPITAL_NEXT)


@query(_PREVIOUS)
def frame_multiline_over_splits(spark, sf_dir):
    return _framed(spark, sf_dir, _BY_CAPITAL, 5)


@query(_NEXT)
def frame_multiline_next_over_splits(spark, sf_dir):
    return _framed(spark, sf_dir, _CAPITAL_NEXT, 3)


@query(_PREVIOUS)
def frame_multiline_shuffled(spark, sf_dir):
    lines = tables.document_lines(spark, sf_dir, 5).repartition("value")
    records = framing.frame_multiline(lines, _BY_CAPITAL, scan_order=False)
    return records.select(tables.doc_id().alias("doc_id"), "mid", "value")


@query(
    f"select doc_id, mid // 2 as mid, '/logs/f' || (mid // 2 % 3) || '.log' as file, value from ({_DOC_LINES}) "
    f"union all select doc_id, -1 - mid // 2, '/logs/f' || (mid // 2 % 3) || '.log', '==> /etc/other <==' "
    f"from ({_DOC_LINES}) where mid % 11 = 5"
)
def demux_capture(spark, sf_dir):
    """Each document is a capture that switches between three files at every second line; some
    lines look like the header of a file nobody follows."""
    lines = tables.document_lines(spark, sf_dir)
    header = F.concat(F.lit("==> /logs/f"), (F.floor(F.col("mid") / 2) % 3).cast("string"), F.lit(".log <=="))
    switch = F.col("mid") % 2 == 0
    pieces = F.array(
        F.when(switch & (F.col("mid") > 0), F.lit("")),
        F.when(switch, header),
        F.col("value"),
        F.when(F.col("mid") % 11 == 5, F.lit("==> /etc/other <==")),
    )
    capture = (
        lines.select("host", "path", "mid", F.posexplode(pieces).alias("at", "text"))
        .where("text is not null")
        .select(
            "host", "path",
            F.floor(F.col("mid") / 9).cast("long").alias("blk"),
            (F.col("mid") * 4 + F.col("at")).alias("mid"),
            F.col("text").alias("value"),
        )
    )
    files = demux(capture, [f"/logs/f{i}.log" for i in range(3)])
    line = F.floor(F.col("mid") / 8).cast("long")
    return files.select(
        tables.doc_id().alias("doc_id"),
        F.when(F.col("mid") % 4 == 3, -1 - line).otherwise(line).alias("mid"),
        "file",
        "value",
    )


@query(
    f"with lines as ({_DOC_LINES}), d as (select *, mid % 5 = 2 as is_lead from lines), "
    "s as (select d.*, date_diff('second', timestamp '1970-01-01', timestamp '2026-01-01') + doc_id * 60 + mid as secs from d), "
    "c as (select *, max(case when is_lead then secs end) over (partition by doc_id order by mid) as shown from s) "
    "select doc_id, mid, value from c where shown is null or "
    "(shown >= date_diff('second', timestamp '1970-01-01', timestamp '2026-01-01 01:00:00') and "
    "shown <= date_diff('second', timestamp '1970-01-01', timestamp '2026-01-01 10:00:00'))"
)
def window_text_lines(spark, sf_dir):
    """Lines 2, 7, 12, … of a document lead with a time; the decision carries to those behind."""
    lines = tables.document_lines(spark, sf_dir, 4)
    seconds = F.unix_timestamp(F.lit("2026-01-01 00:00:00")) + tables.doc_id() * 60 + F.col("mid")
    time = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss,SSS'Z '")
    stamped = lines.withColumn(
        "value", F.when(F.col("mid") % 5 == 2, F.concat(time, "value")).otherwise(F.col("value"))
    )
    kept = lines_in_window(stamped, Window(*(datetime(2026, 1, 1, hour, tzinfo=timezone.utc) for hour in (1, 10))))
    text = F.when(F.col("mid") % 5 == 2, F.substr("value", F.lit(26))).otherwise(F.col("value"))
    return kept.select(tables.doc_id().alias("doc_id"), "mid", text.alias("value"))


_LONG = "a.b.c.d.e.f.it's.h"
_STOPS_SQL = "event_id % 4 <> 3"


def _long_record():
    """A name of eight segments in four layouts; in the last one its longest key leads nowhere."""
    value = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    nested = F.concat(F.lit('{"b":{"c":{"d":{"e":{"f":{"it\'s":{"h":'), value, F.lit("}}}}}}}"))
    layout = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"a":'), nested))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('"a.b":{"c.d":[1,{"e.f":{"it\'s.h":'), value, F.lit("}}]}")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(f'"{_LONG}":'), value, F.lit(',"a":{"b":"other"}')))
        .otherwise(F.concat(F.lit('"a.b":{"c":"stops"},"a":'), nested))
    )
    return F.concat(F.lit('{"timestamp":"'), tables.utc_text(F.col("ts")), F.lit('","event_id":'), F.col("event_id"), F.lit(","), layout, F.lit("}"))


def _search_lines(spark, sf_dir, record, filter_) -> DataFrame:
    lines = tables.as_lines(tables.event_rows(spark, sf_dir), record, "event_id")
    events = to_events(framing.frame_json(lines), PROFILE, PROFILE.inputs[0], COLLECTED)
    return _shown(search_events(events, filter_))


@query(_shown_sql(f"event_type in ('error', 'view') and {_STOPS_SQL}"))
def search_long_path(spark, sf_dir):
    either = [{"term": {_LONG: "error"}}, {"prefix": {_LONG: "vi"}}]
    return _search_lines(spark, sf_dir, _long_record(), {"bool": {"should": either}})


@query(_shown_sql(f"event_id % 4 = 3"))
def search_long_path_missing(spark, sf_dir):
    return _search_lines(spark, sf_dir, _long_record(), {"bool": {"must_not": {"exists": {"field": _LONG}}}})


@query(_shown_sql(f"event_type = 'error' or {_K} >= 90"))
def search_deep_lists(spark, sf_dir):
    """Values six lists deep, also in lists of objects."""
    record = F.concat(
        F.lit('{"timestamp":"'), tables.utc_text(F.col("ts")), F.lit('","event_id":'), F.col("event_id"),
        F.lit(',"n":[[],[[["["],[[["'), F.col("event_type"), F.lit('"]]]]],"x"],"o":[[{"p":[[{"k":[[[[[['), F.coalesce("k", F.lit("null")),
        F.lit("]]]]]]}]]}]]}"),
    )
    either = [{"term": {"n": "error"}}, {"range": {"o.p.k": {"gte": 90}}}]
    return _search_lines(spark, sf_dir, record, {"bool": {"should": either}})


# ---------------------------------------------------------------- enrichment


@query(
    f"select event_id, {_TIME} as event_time, event_type as dataset, 'h' || (user_id % 4) as host_name, "
    "'/logs/' || event_type || '.json' as file_path, 'shop' as profile, 'skeinlog' as agent, "
    "'8.11' as ecs, '2025-06-01T00:00:00+00:00' as created, 'a,b' as tags from events"
)
def envelope(spark, sf_dir):
    inputs = [{"type": t, "path": [f"{t}.json"], "codec": "json", "tags": ["a", "b"]} for t in TYPES]
    events = _typed_events(spark, sf_dir, _typed_profile(inputs=inputs))
    return events.select(
        _body("event_id", "bigint").alias("event_id"),
        _time(),
        F.col("event.dataset").alias("dataset"),
        F.col("host.name").alias("host_name"),
        F.col("log.file.path").alias("file_path"),
        F.col("labels")["profile"].alias("profile"),
        F.col("agent.type").alias("agent"),
        F.col("ecs.version").alias("ecs"),
        iso_text(F.col("event.created")).alias("created"),
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    f"select event_id as mid, case when {_BROKEN} = 1 then 'web' else 'web,_jsonparsefailure' end as tags, "
    f"case when {_BROKEN} = 1 then {_TIME} else '2025-06-01T00:00:00+00:00' end as event_time "
    "from events where event_id % 11 <> 0"
)
def tags_parse_failure(spark, sf_dir):
    inp = LogInput("events", ("*.json",), framing=Framing("json"), tags=("web",))
    events = to_events(framing.frame_json(_broken_lines(spark, sf_dir)), PROFILE, inp, COLLECTED)
    return events.select(F.col("_mid").alias("mid"), F.array_join("tags", ",").alias("tags"), _time())


def _text_events(spark, sf_dir, text, spec: dict) -> DataFrame:
    """Events written as text lines, framed as plain."""
    profile = profile_from_dict(
        "shop", {"hosts": ["h0"], "inputs": [{"type": "t", "path": ["*"], **spec}]}
    )
    lines = tables.as_lines(tables.event_rows(spark, sf_dir), text, "event_id")
    inp = profile.inputs[0]
    return to_events(framing.frame(lines, inp.framing), profile, inp, COLLECTED)


@query(
    f"select event_id as mid, case when event_id % 5 = 0 then '2025-06-01T00:00:00+00:00' else {_TIME} end "
    "as event_time from events"
)
def event_time_auto(spark, sf_dir):
    """Leading ISO times with comma or dot, with Z, an offset or no zone; some without fraction,
    which is no event time."""
    ts = F.col("ts")
    kind = F.col("event_id") % 5
    offset = F.date_format(ts + F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:30'")
    stamp = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'Z'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 3, offset)
        .otherwise(tables.utc_text(ts))
    )
    events = _text_events(spark, sf_dir, F.concat(stamp, F.lit(" | "), "event_type"), {})
    return events.select(F.col("_mid").alias("mid"), _time())


@query(
    f"select event_id as mid, case when event_id % 3 = 0 then '2025-06-01T00:00:00+00:00' else {_TIME} end "
    "as event_time from events"
)
def event_time_field(spark, sf_dir):
    """The declared field decides alone: without it the automatic ``timestamp`` is not used."""
    written = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSSSSS"), F.lit("+00:00"))
    at = F.when(F.col("event_id") % 3 != 0, written)
    line = F.to_json(F.struct(F.lit("2020-01-01T00:00:00Z").alias("timestamp"), at.alias("when")))
    events = _text_events(spark, sf_dir, line, {"codec": "json", "timestamp": {"field": "when"}})
    return events.select(F.col("_mid").alias("mid"), _time())


@query(
    "select event_id as mid, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as event_time from events"
)
def event_time_pattern(spark, sf_dir):
    local = F.col("ts") + F.expr("interval 2 hours")
    zone = F.when(F.col("event_id") % 2 == 0, F.lit("+0200")).otherwise(F.lit("+02:00"))
    line = F.concat(F.lit("["), F.date_format(local, "dd/MMM/yyyy:HH:mm:ss "), zone, F.lit("] "), "event_type")
    spec = {"timestamp": {"pattern": r"\[([^\]]+)\]", "format": "%d/%b/%Y:%H:%M:%S %z"}}
    events = _text_events(spark, sf_dir, line, spec)
    return events.select(F.col("_mid").alias("mid"), _time())


def _labelled(spark, sf_dir, *filters: dict) -> DataFrame:
    return _typed_events(spark, sf_dir, _typed_profile(filters=list(filters)))


def _labels(events: DataFrame, *names: str) -> DataFrame:
    shown = [F.try_element_at("labels", F.lit(n)).alias(n) for n in names]
    return events.select(_body("event_id", "bigint").alias("event_id"), *shown)


@query("select event_id, event_type as kind from events")
def grok_path(spark, sf_dir):
    return _labels(_labelled(spark, sf_dir, {"grok": {"path": r"logs/%{DATA:kind}\.json"}}), "kind")


@query(
    "select event_id, regexp_extract(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'T(\\d+):(\\d+)', 1) as hour, "
    "regexp_extract(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'T(\\d+):(\\d+)', 2) as minute from events"
)
def grok_message(spark, sf_dir):
    pattern = '"timestamp":"[^T]*T%{INT:hour}:%{INT:minute}:'
    return _labels(_labelled(spark, sf_dir, {"grok": {"message": pattern}}), "hour", "minute")


@query("select event_id, json_extract_string(props, '$.k') as k, cast(null as varchar) as uid from events")
def grok_field(spark, sf_dir):
    """A body field that is a text feeds a label; one that is a number does not."""
    grok = {"[props][k]": "%{GREEDYDATA:k}", "[user][id]": "%{INT:uid}"}
    return _labels(_labelled(spark, sf_dir, {"grok": grok}), "k", "uid")


@query(
    "select event_id, case when json_extract_string(props, '$.k') = '42' then 'answer' "
    "when event_type = 'error' then 'error' end as mark from events"
)
def grok_conditional(spark, sf_dir):
    """The later filter replaces the label of the earlier one."""
    filters = (
        {"if": '[type] == "error"', "grok": {"path": r"%{WORD:mark}\.json"}},
        {"if": "[props][k] == '42'", "grok": {"message": '"(?P<mark>k)"'}},
    )
    labels = _labels(_labelled(spark, sf_dir, *filters), "mark")
    return labels.withColumn("mark", F.when(F.col("mark") == "k", "answer").otherwise(F.col("mark")))


# ---------------------------------------------------------------- field discovery

# One event as the line that is its record, and as (field, family, value) rows. Values are JSON texts
# without the quotes around them.
_LEAF_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_LEAF_K = "(case when user_id % 4 = 3 then null else json_extract_string(props, '$.k') end)"
_LEAF_LINE = (
    f"""'{{"timestamp":"' || {_LEAF_TS} || '","event_id":' || event_id || ',"user":{{"id":' || user_id || '}},"event_type":"' || event_type """
    """|| '","tagged":{"names":["' || event_type || '","x",null]}' || """
    f"""(case when {_LEAF_K} is null then ',"props":{{"k":null}}' when event_type = 'error' then ',"props":{{"k":' || {_LEAF_K} || '}}' """
    f"""else ',"props":{{"k":"' || {_LEAF_K} || '"}}' end) || (case when event_id % 2 = 0 then ',"even":true}}' else '}}' end)"""
)
_LEAVES_SQL = (
    "select event_id, event_type as dataset, 'h' || (user_id % 4) as host, f.field, f.family, f.v, "
    "case when f.family in ('keyword', 'date') then '\"' || f.v || '\"' else f.v end as j from events, "
    "lateral (values "
    f"('timestamp', 'date', {_LEAF_TS}), "
    "('event_id', 'long', cast(event_id as varchar)), "
    "('user.id', 'long', cast(user_id as varchar)), "
    "('event_type', 'keyword', event_type), "
    "('tagged.names', 'keyword', event_type), ('tagged.names', 'keyword', 'x'), "
    f"('props.k', case when event_type = 'error' then 'long' else 'keyword' end, {_LEAF_K}), "
    "('even', 'boolean', case when event_id % 2 = 0 then 'true' end), "
    f"('@timestamp', 'date', {_TIME}), ('message', 'keyword', replace({_LEAF_LINE}, '\"', '\\\"')), "
    "('event.dataset', 'keyword', event_type), ('event.created', 'date', '2025-06-01T00:00:00+00:00'), "
    "('host.name', 'keyword', 'h' || (user_id % 4)), ('agent.type', 'keyword', 'skeinlog'), "
    f"('agent.version', 'keyword', '{__version__}'), ('log.file.path', 'keyword', '/logs/' || event_type || '.json'), "
    "('ecs.version', 'keyword', '8.11'), ('labels.profile', 'keyword', 'shop')"
    ") f(field, family, v) where f.v is not null"
)


def _leaf_record():
    """``props.k`` is a number in one dataset and a text elsewhere, and missing on host h3;
    ``even`` is rare; ``tagged.names`` is a list."""
    k = F.when(F.col("host") != "h3", F.col("k"))
    error = F.col("event_type") == "error"
    return F.concat(
        F.lit('{"timestamp":"'), tables.utc_text(F.col("ts")), F.lit('","event_id":'), F.col("event_id"),
        F.lit(',"user":{"id":'), F.col("user_id"), F.lit('},"event_type":"'), F.col("event_type"),
        F.lit('","tagged":{"names":["'), F.col("event_type"), F.lit('","x",null]}'),
        F.when(k.isNull(), F.lit(',"props":{"k":null}'))
        .when(error, F.concat(F.lit(',"props":{"k":'), k, F.lit("}")))
        .otherwise(F.concat(F.lit(',"props":{"k":"'), k, F.lit('"}'))),
        F.when(F.col("event_id") % 2 == 0, F.lit(',"even":true}')).otherwise(F.lit("}")),
    )


def _leaf_events(spark, sf_dir) -> DataFrame:
    rows = tables.event_rows(spark, sf_dir)
    lines = tables.as_lines(rows, _leaf_record(), "event_id")
    profile = _typed_profile()
    parts = [
        to_events(
            framing.frame_json(lines.where(F.col("path") == f"/logs/{inp.type}.json")),
            profile, inp, COLLECTED,
        )
        for inp in profile.inputs
    ]
    return reduce(DataFrame.unionByName, parts)


def _summary(spark, sf_dir) -> DataFrame:
    return summary.summarize(_leaf_events(spark, sf_dir))


@query(
    "select dataset, host, field, family, v as value, count(*) as n "
    f"from ({_LEAVES_SQL}) group by all"
)
def leaves(spark, sf_dir):
    rows = catalog.leaves(_leaf_events(spark, sf_dir))
    value = F.regexp_replace("json", '^"|"$', "").alias("value")
    return rows.groupBy("dataset", "host", "field", "family", value).agg(F.count("*").alias("n"))


@query(f"select field, family, count(*) as n from ({_LEAVES_SQL}) group by all")
def type_families(spark, sf_dir):
    return catalog.leaves(_leaf_events(spark, sf_dir)).groupBy("field", "family").agg(F.count("*").alias("n"))


_COUNTS_SQL = (
    "select field, family, dataset, host, count(*) as n, count(distinct event_id) as docs "
    f"from ({_LEAVES_SQL}) group by all"
)


@query(_COUNTS_SQL)
def field_catalog(spark, sf_dir):
    return catalog.count_fields(_summary(spark, sf_dir))


@query(_COUNTS_SQL)
def field_catalog_from_leaves(spark, sf_dir):
    """The same from a row for each value."""
    return catalog.count_leaves(catalog.leaves(_leaf_events(spark, sf_dir)))


@query(
    "select field, family, string_agg(distinct dataset, ',' order by dataset) as datasets, "
    f"string_agg(distinct host, ',' order by host) as hosts, count(*) as n from ({_LEAVES_SQL}) group by all"
)
def field_types(spark, sf_dir):
    types = catalog.field_types(_summary(spark, sf_dir))
    return types.select(
        "field", "family", F.array_join("datasets", ",").alias("datasets"),
        F.array_join("hosts", ",").alias("hosts"), "n",
    )


_COVERAGE_SQL = (
    f"with l as ({_LEAVES_SQL}), d as (select event_type as dataset, count(*) as docs from events group by all), "
    "f as (select field, dataset, count(*) as n, count(distinct event_id) as k from l group by all) "
    "select field, round(sum(n) / sum(docs), 4) as coverage, round(sum(k) / sum(docs), 4) as doc_coverage "
    "from f join d using (dataset) group by all"
)
_EXAMPLES_SQL = (
    "select field, string_agg(j, ',' order by j) as examples from (select field, j, "
    f"row_number() over (partition by field order by j) as r from (select distinct field, j from ({_LEAVES_SQL}))) "
    "where r <= 3 group by all"
)
_DRIFT_SQL = (
    "select field, string_agg(distinct host, ',' order by host) as hosts "
    f"from ({_LEAVES_SQL}) group by all having count(distinct host) < (select count(distinct user_id % 4) from events)"
)


@query(_COVERAGE_SQL)
def field_coverage(spark, sf_dir):
    return catalog.coverage(_summary(spark, sf_dir))


@query(_EXAMPLES_SQL)
def field_examples(spark, sf_dir):
    return summary.examples(_summary(spark, sf_dir)).select("field", F.array_join("examples", ",").alias("examples"))


@query(_DRIFT_SQL)
def field_host_drift(spark, sf_dir):
    drift = catalog.host_drift(_summary(spark, sf_dir))
    return drift.select("field", F.array_join("hosts", ",").alias("hosts"))


_INDICES_SQL = (
    f"with l as ({_LEAVES_SQL}) select field, family, case when (select count(distinct family) from l m where m.field = l.field) = 1 "
    "and count(distinct dataset) = (select count(distinct event_type) from events) then '' "
    "else string_agg(distinct dataset, ',' order by dataset) end as indices from l group by field, family"
)


@query(
    f"select i.field, i.family, i.indices, true as searchable, coverage, doc_coverage, d.field is not null as conflict, "
    f"(select count(*) from events) as docs_sampled from ({_INDICES_SQL}) i join ({_COVERAGE_SQL}) c on c.field = i.field "
    f"left join ({_DRIFT_SQL}) d on d.field = i.field"
)
def field_caps(spark, sf_dir):
    """The whole report, taken apart again; its examples are those of ``field_examples``."""
    found = save(_summary(spark, sf_dir), tables.scratch(spark))
    report = catalog.field_caps(found, summary.examples(found))
    families = "map<string, struct<searchable: boolean, indices: array<string>>>"
    schema = (
        f"fields map<string, {families}>, sample struct<docs_sampled: long, host_conflicts: array<string>, "
        "coverage: map<string, double>, doc_coverage: map<string, double>>"
    )
    rows = report.select(F.from_json("value", schema).alias("r")).select("r.sample", F.explode("r.fields").alias("field", "families"))
    return rows.select("field", "sample", F.explode("families").alias("family", "caps")).select(
        "field", "family", F.coalesce(F.array_join("caps.indices", ","), F.lit("")).alias("indices"), "caps.searchable",
        F.col("sample.coverage")[F.col("field")].alias("coverage"), F.col("sample.doc_coverage")[F.col("field")].alias("doc_coverage"),
        F.array_contains("sample.host_conflicts", F.col("field")).alias("conflict"), "sample.docs_sampled",
    )


@query(
    f"select c.field, coverage, doc_coverage, examples, d.field is not null as conflict from ({_COVERAGE_SQL}) c "
    f"join ({_EXAMPLES_SQL}) e on e.field = c.field left join ({_DRIFT_SQL}) d on d.field = c.field"
)
def field_report_lines(spark, sf_dir):
    """The report as a JSON line for each field."""
    found = save(_summary(spark, sf_dir), tables.scratch(spark))
    lines = catalog.field_lines(catalog.field_table(found, summary.examples(found)))
    read = lines.select(F.parse_json("value").alias("r"))
    shown = F.transform(F.variant_get("r", "$.examples", "array<variant>"), lambda v: F.to_json(v))
    return read.select(
        F.variant_get("r", "$.field", "string").alias("field"), F.variant_get("r", "$.coverage", "double").alias("coverage"),
        F.variant_get("r", "$.doc_coverage", "double").alias("doc_coverage"), F.array_join(shown, ",").alias("examples"),
        F.variant_get("r", "$.host_conflict", "boolean").alias("conflict"),
    )


@query(
    "select event_id as mid, 'u' || user_id as host, value from (select *, row_number() over "
    "(partition by user_id order by event_id desc) as r from (select event_id, user_id, event_type || ' ' || props as value from events)) where r <= 5"
)
def sample_last_lines(spark, sf_dir):
    rows = tables.event_rows(spark, sf_dir).withColumn("host", F.concat(F.lit("u"), F.col("user_id")))
    rows = rows.withColumn("path", F.lit("/logs/user.log"))
    lines = tables.as_lines(rows, F.concat("event_type", F.lit(" "), "props"), "event_id")
    return last_lines(lines, 5).select("mid", "host", "value")


# ---------------------------------------------------------------- inventory


def _url_files(spark, sf_dir) -> DataFrame:
    """The pages as files: the host of the URL is a directory below the base directory."""
    url = F.regexp_replace("url", r"^\w+://|[?#].*$", "")
    return tables.read(spark, sf_dir, "pages").select(
        F.concat(F.lit("h"), F.col("page_id") % 3).alias("host"),
        F.concat(F.lit("/logs/"), url).alias("path"),
        F.length("html").cast("long").alias("length"),
    )


_FILE_PROFILE = {
    "hosts": ["h0", "h1", "h2", "h8", "h9"],
    "base_dir": "/logs",
    "inputs": [
        {"type": "english", "path": ["*.example.*/en/*"], "exclude": ["*.org/*", "www.*1"]},
        {"type": "short", "path": ["*/en/??", "/logs/*/fr/[0-9]?"]},
        {"type": "none", "path": ["*.gz"]},
    ],
    "filters": [{"if": '[type] == "short"', "grok": {"path": "/%{WORD:lang}/[^/]*$"}}],
}
_FILES = (
    "select page_id, 'h' || (page_id % 3) as host, "
    "regexp_replace(url, '^\\w+://|[?#].*$', '', 'g') as f from pages"
)
_LISTED = (
    f"with p as ({_FILES}), found as ("
    "select host, 'english' as type, f as file from p where regexp_matches(f, '^[^/.][^/]*\\.example\\.[^/]*/en/[^/.][^/]*$') "
    "and not regexp_matches(f, '^.*\\.org/.*$') and not regexp_matches(f, '^www\\..*1$') union all "
    "select host, 'short', f from p where regexp_matches(f, '^[^/.][^/]*/en/[^/.][^/]$') union all "
    "select host, 'short', '/logs/' || f from p where regexp_matches(f, '^[^/.][^/]*/fr/[0-9][^/]$')) "
)


@query(
    _LISTED + "select h.host, t.type, coalesce(string_agg(file, ' ' order by file), '') as files, count(file) as n "
    "from (values ('h0'), ('h1'), ('h2'), ('h8'), ('h9')) h(host) cross join "
    "(values ('english'), ('short'), ('none')) t(type) left join found using (host, type) group by all"
)
def inventory(spark, sf_dir):
    rows = discover(_url_files(spark, sf_dir), profile_from_dict("web", _FILE_PROFILE))
    return rows.select(
        "host", "type", F.array_join("files", " ").alias("files"), F.size("files").cast("long").alias("n")
    )


@query("select * from (values ('h8'), ('h9')) t(host)")
def inventory_missing_hosts(spark, sf_dir):
    rows = missing_hosts(_url_files(spark, sf_dir), profile_from_dict("web", _FILE_PROFILE))
    return rows.select("host")


@query(
    _LISTED + "select host, type, file from found where host = 'h1' and "
    "(type <> 'short' or regexp_extract(file, '/(\\w+)/[^/]*$', 1) = 'fr')"
)
def prune_files(spark, sf_dir):
    """The files a search would open: the host and a label from the path decide."""
    profile = profile_from_dict("web", _FILE_PROFILE)
    wanted = {"bool": {"filter": [{"term": {"host.name": "h1"}}, {"prefix": {"labels.lang": "f"}}]}}
    rows = files_to_read(_url_files(spark, sf_dir), profile, compile_query(wanted))
    return rows.select("host", "type", F.col("listed_as").alias("file"))


# ---------------------------------------------------------------- sinks and files


@query(
    f"select event_id, {_TIME} as event_time, 'h' || (user_id % 4) as host_name, "
    "json_extract_string(props, '$.k') as k, 'events' as dataset, 'shop' as profile, "
    "'2025-06-01T00:00:00+00:00' as created from events"
)
def ndjson_roundtrip(spark, sf_dir):
    """The body's own ``host`` and ``message`` never replace the envelope."""
    record = F.struct(
        tables.utc_text(F.col("ts")).alias("timestamp"), "event_id", F.struct("k").alias("props"),
        F.lit("other").alias("host"), F.lit("other").alias("message"),
    )
    lines = sinks.to_ndjson(_events(spark, sf_dir, record))
    schema = (
        "event_id bigint, `@timestamp` string, host struct<name: string>, props struct<k: string>, "
        "event struct<dataset: string, created: string>, labels map<string, string>"
    )
    parsed = lines.select(F.from_json("value", schema).alias("e"))
    return parsed.select(
        "e.event_id",
        F.col("e.@timestamp").alias("event_time"),
        F.col("e.host.name").alias("host_name"),
        F.col("e.props.k").alias("k"),
        F.col("e.event.dataset").alias("dataset"),
        F.col("e.labels")["profile"].alias("profile"),
        F.col("e.event.created").alias("created"),
    )


@query(
    _shown_sql(f"event_type = 'error' and {_K} >= 50 and ts >= timestamp '2024-01-05'")
)
def event_table_search(spark, sf_dir):
    """Store the events of all datasets, then search the stored table."""
    path = tables.scratch(spark)
    sinks.write_event_table(_typed_events(spark, sf_dir, _typed_profile()), path)
    filter_ = {
        "bool": {
            "filter": [
                {"term": {"event.dataset": "error"}},
                {"range": {"props.k": {"gte": 50}}},
                {"range": {"@timestamp": {"gte": "2024-01-05T00:00:00Z"}}},
            ]
        }
    }
    return _shown(search_events(sinks.read_event_table(spark, path), filter_))


def _write_logs(spark, sf_dir, root: str, mode: str = "append", part: int | None = None, name: str = "events") -> None:
    """The events as JSON log files below one directory per host."""
    rows = tables.event_rows(spark, sf_dir)
    if part is not None:
        rows = rows.where(F.col("event_id") % 2 == part)
    for host in PROFILE.hosts:
        lines = rows.where(F.col("host") == host).select(F.to_json(tables.event_object()).alias("value"))
        lines.write.mode(mode).text(f"{root}/{host}/logs/{name}")


_FILES_PROFILE = profile_from_dict(
    "shop",
    {
        "hosts": ["h0", "h1", "h2", "h3", "h9"],
        "base_dir": "/logs",
        "inputs": [
            {"type": "events", "path": ["events/part-*"], "codec": "json", "start_position": "beginning"}
        ],
    },
)


@query(_shown_sql("event_type = 'error' and user_id % 4 in (1, 2) and ts < timestamp '2024-01-20'"))
def search_files(spark, sf_dir):
    """The whole search over log files, with pruning and raw-line conditions."""
    root = tables.scratch(spark)
    _write_logs(spark, sf_dir, root)
    filter_ = {
        "bool": {
            "filter": [
                {"term": {"event_type": "error"}},
                {"terms": {"host.name": ["h1", "h2"]}},
                {"range": {"@timestamp": {"lt": "2024-01-20T00:00:00Z"}}},
            ]
        }
    }
    return _shown(search(spark, root, _FILES_PROFILE, filter_, collected=COLLECTED).events)


_RECORD_PROFILE = profile_from_dict(
    "shop",
    {
        "hosts": ["h0", "h1", "h2", "h3"],
        "base_dir": "/logs",
        "inputs": [
            {"type": "events", "path": ["events/part-*"], "codec": {"multiline": {"pattern": r"^\d{4}-", "negate": True}}}
        ],
        "filters": [{"grok": {"message": r"#%{INT:id}\n  type %{WORD:kind}"}}],
    },
)


def _write_records(spark, sf_dir, root: str) -> None:
    """The events as text records of three lines, in files of several hosts."""
    rows = tables.event_rows(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'Z'")
    text = F.concat(stamp, F.lit(" #"), "event_id", F.lit("\n  type "), "event_type", F.lit("\n  props "), "props")
    for host in _RECORD_PROFILE.hosts:
        rows.where(F.col("host") == host).select(text.alias("value")).write.text(f"{root}/{host}/logs/events")


def _shown_records(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("labels")["id"].cast("long").alias("event_id"), F.col("labels")["kind"].alias("kind"), F.col("host.name").alias("host_name"),
        F.element_at(F.split("message", "\n"), -1).alias("last_line"), _time(),
    )


_RECORDS_FOUND = (
    f"select event_id, event_type as kind, 'h' || (user_id % 4) as host_name, '  props ' || props as last_line, {_TIME} as event_time from events "
)


@query(_RECORDS_FOUND + "where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09' and event_type <> 'view'")
def search_files_multiline(spark, sf_dir):
    """Multi-line records of files in a time window: each file is read once, and records outside the
    window are let go by their first line."""
    root = tables.scratch(spark)
    _write_records(spark, sf_dir, root)
    window = {"range": {"@timestamp": {"gte": "2024-01-05T00:00:00Z", "lt": "2024-01-09T00:00:00Z"}}}
    filter_ = {"bool": {"filter": window, "must_not": {"term": {"labels.kind": "view"}}}}
    return _shown_records(search(spark, root, _RECORD_PROFILE, filter_, collected=COLLECTED).events)


@query(_RECORDS_FOUND)
def frame_multiline_ranges(spark, sf_dir):
    """All records of files that are cut into many small byte ranges."""
    root = tables.scratch(spark)
    _write_records(spark, sf_dir, root)
    inp = _RECORD_PROFILE.inputs[0]
    files = input_files(spark, root, _RECORD_PROFILE, inp)
    records = range_records(files, inp.framing, range_bytes=20_000)
    return _shown_records(to_events(records, _RECORD_PROFILE, inp, COLLECTED))


@query(
    "select 4 as files, (select count(*) from events where event_type = 'error' and user_id % 4 in (1, 2)) as matches, 'h9' as missing"
)
def search_summary(spark, sf_dir):
    """What a search reports beside its events: the files it opens, the matches, the hosts without files."""
    root = tables.scratch(spark)
    rows = tables.event_rows(spark, sf_dir)
    for host in PROFILE.hosts:
        lines = rows.where(F.col("host") == host).select(F.to_json(tables.event_object()).alias("value"))
        lines.repartition(2).write.text(f"{root}/{host}/logs/events")
    filter_ = {"bool": {"filter": [{"term": {"event_type": "error"}}, {"wildcard": {"host.name": "h[12]*"}}]}}
    found = search(spark, root, _FILES_PROFILE, filter_, collected=COLLECTED)
    found.events.write.format("noop").mode("overwrite").save()  # the count is there after a run
    missing = found.missing.agg(F.array_join(F.array_sort(F.collect_list("host")), ",").alias("missing"))
    return found.files.agg(F.count("*").alias("files")).select(
        "files", F.lit(found.matches.get["matches"]).alias("matches"), missing.scalar().alias("missing")
    )


@query(f"select event_id, {_TIME} as event_time, 'h' || (user_id % 4) as host_name from events")
def ndjson_appended(spark, sf_dir):
    """Events appended to JSON lines in two runs."""
    path = tables.scratch(spark)
    events = _events(spark, sf_dir)
    for part in (0, 1):
        sinks.write_ndjson(events.where(_body("event_id", "bigint") % 2 == part), path)
    found = spark.read.schema("event_id bigint, `@timestamp` string, host struct<name: string>").json(path)
    return found.select("event_id", F.col("@timestamp").alias("event_time"), F.col("host.name").alias("host_name"))


@query(
    "select event_id, case event_id % 3 when 0 then '042' when 1 then '007' else '2024-01-01' end as dataset, "
    f"'0' || (user_id % 4) as host_name from events where event_id % 3 <> 1"
)
def event_table_names(spark, sf_dir):
    """Datasets and hosts whose names look like numbers or dates, stored and searched."""
    path = tables.scratch(spark)
    events = _events(spark, sf_dir)
    kind = _body("event_id", "bigint") % 3
    name = F.when(kind == 0, "042").when(kind == 1, "007").otherwise("2024-01-01")
    events = events.withColumns({
        "event": F.struct(name.alias("dataset"), F.col("event.created").alias("created")),
        "host": F.struct(F.replace("host.name", F.lit("h"), F.lit("0")).alias("name")),
    })
    sinks.write_event_table(events, path)
    found = search_events(sinks.read_event_table(spark, path), {"terms": {"event.dataset": ["042", "2024-01-01"]}})
    return found.select(
        _body("event_id", "bigint").alias("event_id"), F.col("event.dataset").alias("dataset"), F.col("host.name").alias("host_name")
    )


@query(
    "with ranked as (select *, row_number() over (partition by user_id % 4, event_id % 8 order by event_id desc) as r from events), "
    "taken as (select 'h' || user_id % 4 as host, event_id, event_type from ranked where r <= 20) "
    "select host, 'message' as field, 'keyword' as family, count(*) as n from taken group by all "
    "union all select host, 'event_id', 'long', count(event_id) from taken group by all "
    "union all select host, 'event_type', 'keyword', count(event_type) from taken group by all"
)
def discover_sampled_files(spark, sf_dir):
    """Discovery with a sample over log files, those of every second host gzipped."""
    root = tables.scratch(spark)
    rows = tables.event_rows(spark, sf_dir).withColumn("part", F.col("event_id") % 8)
    for i, host in enumerate(("h0", "h1", "h2", "h3")):
        lines = rows.where(F.col("user_id") % 4 == i).select("part", "event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"))
        lines = lines.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value")
        lines.write.partitionBy("part").option("compression", "gzip" if i % 2 else "none").text(f"{root}/{host}/logs/events")
    inputs = [{"type": "events", "path": ["events/*/part-*"], "codec": "json"}]
    profile = profile_from_dict("shop", {"hosts": ["h0", "h1", "h2", "h3"], "base_dir": "/logs", "inputs": inputs})
    found = discover_fields(spark, root, profile, sample=20).catalog
    return found.where(F.col("field").isin("message", "event_id", "event_type")).select("host", "field", "family", "n")


@query(_shown_sql("true"))
def stream_follow(spark, sf_dir):
    """Follow the log files in two runs from one checkpoint: the second finds only new lines."""
    root = tables.scratch(spark)
    for part in (0, 1):
        _write_logs(spark, sf_dir, f"{root}/in", part=part)
        events = tail(spark, f"{root}/in", _FILES_PROFILE)
        run = write_stream(events, f"{root}/out", f"{root}/checkpoint", available_now=True)
        run.awaitTermination()
    schema = "event_id bigint, `@timestamp` string, host struct<name: string>"
    found = spark.read.schema(schema).json(f"{root}/out")
    return found.select(
        "event_id", F.col("host.name").alias("host_name"), F.col("@timestamp").alias("event_time")
    )


@query(
    f"select event_id, 'events' as dataset, 'h1' as host_name, {_TIME} as event_time from events where user_id % 4 = 1 "
    f"union all select event_id, 'late', 'h1', {_TIME} from events where user_id % 4 = 1 and event_id % 2 = 1"
)
def stream_scoped(spark, sf_dir):
    """Two inputs in one stream, of one of the hosts: one from the beginning without what it excludes, and
    one that starts at the end of the files that are there. The second run goes on in small batches."""
    root = tables.scratch(spark)
    profile = profile_from_dict(
        "shop",
        {
            "hosts": list(PROFILE.hosts), "base_dir": "/logs",
            "inputs": [
                {"type": "events", "path": ["events*/part-*"], "exclude": ["events_old/*"], "codec": "json", "start_position": "beginning"},
                {"type": "late", "path": ["late/part-*"], "codec": "json", "start_position": "end"},
            ],
        },
    )
    for part in (0, 1):
        for name in ("events", "late", "events_old"):
            _write_logs(spark, sf_dir, f"{root}/in", part=part, name=name)
        events = tail(spark, f"{root}/in", profile, hosts="h1", progress=f"{root}/progress", maxBytesPerTask=1 << 20)
        write_stream(events, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    schema = "event_id bigint, `@timestamp` string, host struct<name: string>, event struct<dataset: string>"
    found = spark.read.schema(schema).json(f"{root}/out")
    return found.select(
        "event_id", F.col("event.dataset").alias("dataset"), F.col("host.name").alias("host_name"), F.col("@timestamp").alias("event_time")
    )


@query(
    "with docs as (select doc_id, '#doc ' || doc_id || chr(10) || text as t from documents), "
    "lines as (select doc_id, unnest(string_split(t, chr(10))) as value, "
    "generate_subscripts(string_split(t, chr(10)), 1) as i from docs), "
    "numbered as (select *, sum(case when regexp_matches(value, '^(?:[A-Z]|#doc )') then 1 else 0 end) "
    "over (partition by doc_id order by i) as record from lines), "
    "records as (select string_agg(value, chr(10) order by i) as value from numbered group by doc_id, record) "
    "select value, count(*) as n from records group by value"
)
def stream_multiline(spark, sf_dir):
    """Multi-line records of followed files, and the records still open when the run ends."""
    root = tables.scratch(spark)
    marked = F.concat(F.lit("#doc "), "doc_id", F.lit("\n"), "text").alias("value")
    tables.read(spark, sf_dir, "documents").select(marked).write.text(f"{root}/in/h0/logs/docs")
    profile = profile_from_dict(
        "docs",
        {
            "hosts": ["h0"],
            "base_dir": "/logs",
            "inputs": [
                {
                    "type": "docs",
                    "path": ["docs/part-*"],
                    "start_position": "beginning",
                    "codec": {"multiline": {"pattern": "^(?:[A-Z]|#doc )", "negate": True}},
                }
            ],
        },
    )
    events = tail(spark, f"{root}/in", profile, progress=f"{root}/progress", maxBytesPerTask=1 << 20)
    write_stream(events, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    closed = spark.read.schema("message string").json(f"{root}/out").select(F.col("message").alias("value"))
    still_open = open_records(spark, f"{root}/in", profile, "docs", f"{root}/progress").select("value")
    return closed.unionByName(still_open).groupBy("value").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- training-data operators


def _add_llm() -> None:
    """The queries of the llm folder and of the pipeline, where they are there at all."""
    try:
        from skeinlog.llm import queries as llm
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith("skeinlog.llm"):
            raise
        return
    found = dict(llm.QUERIES)
    try:
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline":
            raise
    for name, function in found.items():
        _QUERIES[name] = lambda spark, sf_dir, f=function: f(prepare(spark), sf_dir)
    _SQL.update(llm.ORACLE_SQL)


_add_llm()


# ---------------------------------------------------------------- driver contract


def entry(spark: SparkSession) -> DataFrame:
    return _QUERIES["search_flagship"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, QueryFunction]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
