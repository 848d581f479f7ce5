import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skeinlog.functions.instants import iso_text, java_date_pattern
from skeinlog.functions.patterns import grok_regex, path_glob, value_glob
from skeinlog.operators.events import to_events
from skeinlog.operators.framing import frame
from skeinlog.operators.sinks import read_event_table, to_ndjson, write_event_table
from skeinlog.plans.profile import ProfileError, profile_from_dict, profiles_from_dict
from skeinlog.plans.search import search_events

NOW = datetime(2026, 8, 1, 12, 0, 0, 250000, tzinfo=timezone.utc)
NOW_TEXT = "2026-08-01T12:00:00.250000+00:00"


def profile(filters=(), **options):
    inp = {"type": "t", "path": ["*"], **options}
    return profile_from_dict("p", {"hosts": ["h1"], "inputs": [inp], "filters": list(filters)})


@pytest.fixture
def events_of(lines_of):
    def make(values, filters=(), path="/logs/a.log", **options):
        job = profile(filters, **options)
        records = frame(lines_of(values, path=path), job.inputs[0].framing)
        return to_events(records, job, job.inputs[0], NOW)

    return make


def ndjson(events):
    return [json.loads(r.value) for r in to_ndjson(events).collect()]


def times(events):
    return [r[0] for r in events.orderBy("_mid").select(iso_text(F.col("`@timestamp`"))).collect()]


def test_envelope_of_a_plain_line(events_of):
    [event] = ndjson(events_of(["hello"]))
    version = event["agent"].pop("version")
    assert version
    assert event == {
        "@timestamp": NOW_TEXT,
        "message": "hello",
        "event": {"dataset": "t", "created": NOW_TEXT},
        "host": {"name": "h1"},
        "agent": {"type": "skeinlog"},
        "log": {"file": {"path": "/logs/a.log"}},
        "labels": {"profile": "p"},
        "ecs": {"version": "8.11"},
    }


def test_body_is_merged_but_never_over_the_envelope(events_of):
    line = '{"message":"m","host":"x","tags":["y"],"a":{"b":[1,null]},"c":null,"host.name":"flat"}'
    [event] = ndjson(events_of([line], codec="json"))
    assert event["message"] == line
    assert event["host"] == {"name": "h1"}
    assert "tags" not in event
    assert event["a"] == {"b": [1, None]} and event["c"] is None
    found = events_of([line], codec="json")
    assert search_events(found, {"term": {"host.name": "h1"}}).count() == 1
    assert search_events(found, {"term": {"host.name": "flat"}}).count() == 0


def test_tags(events_of):
    lines = ['{"a":1}', "broken"]
    got = [e.get("tags") for e in ndjson(events_of(lines, codec="json").orderBy("_mid"))]
    assert got == [None, ["_jsonparsefailure"]]
    tagged = events_of(lines, codec="json", tags=["x", "x"])
    assert [e["tags"] for e in ndjson(tagged.orderBy("_mid"))] == [["x"], ["x", "_jsonparsefailure"]]
    assert search_events(tagged, {"term": {"tags": "_jsonparsefailure"}}).count() == 1
    assert search_events(tagged, {"exists": {"field": "tags"}}).count() == 2


def test_automatic_time(events_of):
    lines = [
        "2026-07-23T00:04:42,571Z | INFO",
        "2026-07-23T00:04:42.5 text",
        "2026-07-23T02:04:42.571+02:00 text",
        "2026-07-23T02:04:42.571+0200 text",
        "2026-07-23T00:04:42Z no fraction",
        "2026-02-30T00:04:42,571Z no such day",
        " 2026-07-23T00:04:42,571Z not leading",
    ]
    assert times(events_of(lines)) == [
        "2026-07-23T00:04:42.571000+00:00",
        "2026-07-23T00:04:42.500000+00:00",
        "2026-07-23T00:04:42.571000+00:00",
        "2026-07-23T00:04:42.571000+00:00",
        NOW_TEXT,
        NOW_TEXT,
        NOW_TEXT,
    ]
    values = ["2026-07-23T00:04:42Z", " 2026-07-23 00:04:42,5 ", "2026-07-23", "2026-07-23T00:04", "x", 5]
    bodies = [json.dumps({"timestamp": v}) for v in values] + ['{"a":{"timestamp":"2026-07-23"}}']
    assert times(events_of(bodies, codec="json")) == [
        "2026-07-23T00:04:42+00:00",
        "2026-07-23T00:04:42.500000+00:00",
        "2026-07-23T00:00:00+00:00",
        "2026-07-23T00:04:00+00:00",
        NOW_TEXT,
        NOW_TEXT,
        NOW_TEXT,
    ]


def test_declared_time(events_of):
    lines = ['{"timestamp":"2020-01-01","when":"2026-07-23T00:00:01Z"}', '{"timestamp":"2020-01-01"}']
    by_field = events_of(lines, codec="json", timestamp={"field": "when"})
    assert times(by_field) == ["2026-07-23T00:00:01+00:00", NOW_TEXT]
    spec = {"pattern": r"\[([^\]]+)\]", "format": "%d/%b/%Y:%H:%M:%S %z"}
    lines = [f"[24/Jul/2026:00:14:45 {z}] x" for z in ("+0000", "+02:00", "Z", "")] + ["none"]
    assert times(events_of(lines, timestamp=spec)) == [
        "2026-07-24T00:14:45+00:00",
        "2026-07-23T22:14:45+00:00",
        "2026-07-24T00:14:45+00:00",
        NOW_TEXT,
        NOW_TEXT,
    ]
    compact = {"pattern": r"^\S+", "format": "%Y%m%dT%H%M%S.%f"}
    assert times(events_of(["20260724T001445.25 x"], timestamp=compact)) == [
        "2026-07-24T00:14:45.250000+00:00"
    ]
    short = {"pattern": r"^\S+", "format": "%y-%m-%d"}
    assert times(events_of(["99-07-04", "26-7-4"], timestamp=short)) == [
        "1999-07-04T00:00:00+00:00",
        "2026-07-04T00:00:00+00:00",
    ]


def test_time_formats_spark_cannot_parse_are_errors():
    with pytest.raises(ValueError, match="%A"):
        java_date_pattern("%A %d")


ROUTE = {"if": '[type] == "t"', "grok": {"path": r"route-%{DATA:route}\.log"}}


def labels(events):
    return [r.labels for r in events.orderBy("_mid").select("labels").collect()]


def test_labels(events_of):
    assert labels(events_of(["x"], [ROUTE], path="/logs/route-00-a.log")) == [
        {"profile": "p", "route": "00-a"}
    ]
    assert labels(events_of(["x"], [ROUTE], path="/logs/other.log")) == [{"profile": "p"}]
    other = {**ROUTE, "if": "[type] == 'u'"}
    assert labels(events_of(["x"], [other], path="/logs/route-00-a.log")) == [{"profile": "p"}]
    two = {"grok": {"message": r"user=%{WORD:user} n=%{INT:n}(?: opt=(?P<opt>\w*))?"}}
    assert labels(events_of(["id user=bob n=42", "user=é n=7 opt=", "no"], [two])) == [
        {"profile": "p", "user": "bob", "n": "42", "opt": ""},
        {"profile": "p", "user": "é", "n": "7", "opt": ""},
        {"profile": "p"},
    ]


def test_labels_from_the_body(events_of):
    grok = {"grok": {"[a][b]": "%{GREEDYDATA:x}", "[n]": "%{INT:n}"}}
    cond = {"if": '[a][b] == "v2"', "grok": {"message": '"(?P<x>n)"'}}
    lines = ['{"a":{"b":"v1"},"n":5}', '{"a":{"b":"v2"},"n":"6"}', '{"a":3}']
    assert labels(events_of(lines, [grok, cond], codec="json")) == [
        {"profile": "p", "x": "v1"},
        {"profile": "p", "x": "n", "n": "6"},
        {"profile": "p"},
    ]


def test_event_table_reads_only_what_a_search_needs(spark, events_of, tmp_path):
    lines = [
        json.dumps({"timestamp": f"2026-07-23T00:00:{i:02d}Z", "response": {"code": str(i)}, "big": "x" * 50})
        for i in range(20)
    ]
    path = str(tmp_path / "table")
    events = events_of(lines, codec="json")
    write_event_table(events, path)
    stored = read_event_table(spark, path)
    filter_ = {
        "bool": {
            "filter": [
                {"term": {"event.dataset": "t"}},
                {"term": {"host.name": "h1"}},
                {"range": {"response.code": {"gte": 10}}},
                {"range": {"@timestamp": {"lt": "2026-07-23T00:00:15Z"}}},
            ]
        }
    }
    found = search_events(stored, filter_)
    assert sorted(map(json.dumps, ndjson(found))) == sorted(
        map(json.dumps, ndjson(search_events(events, filter_)))
    )
    plan = found.select("_mid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "LessThan(@timestamp" in plan.replace("`", "")
    scan = plan[plan.index("ReadSchema") :]
    assert "body:struct<" in scan and "message" not in scan


def test_globs():
    import re

    def hit(pattern, text):
        return re.search(pattern.replace(r"\z", r"\Z"), text) is not None

    assert hit(path_glob("/logs/*.log"), "/logs/a.log")
    assert not hit(path_glob("/logs/*.log"), "/logs/x/a.log")
    assert not hit(path_glob("/logs/*"), "/logs/.hidden")
    assert hit(path_glob("/l?gs/[ab]*.log*"), "/logs/a.log.1")
    assert not hit(path_glob("/logs/[!a]*"), "/logs/a")
    assert hit(value_glob("route-system*"), "route-system/x\n.log")
    assert not hit(value_glob("a*"), "ba")
    with pytest.raises(ValueError, match="unknown grok macro"):
        grok_regex("%{IPV4:ip}")


GOOD = {"hosts": ["h"], "inputs": [{"type": "t", "path": "*.log"}]}


@pytest.mark.parametrize(
    "change",
    [
        {"hosts": None},
        {"hosts": [{"user": "u"}]},
        {"hosts": ["a b"]},
        {"inputs": [{"path": ["*"]}]},
        {"inputs": [{"type": "t", "path": []}]},
        {"inputs": [{"type": "t", "path": ["$(x)"]}]},
        {"inputs": [{"type": "t", "path": "*", "codec": "xml"}]},
        {"inputs": [{"type": "t", "path": "*", "codec": {"multiline": {}}}]},
        {"inputs": [{"type": "t", "path": "*", "codec": {"multiline": {"pattern": "a", "what": "x"}}}]},
        {"inputs": [{"type": "t", "path": "*", "start_position": "middle"}]},
        {"inputs": [{"type": "t", "path": "*", "timestamp": {"pattern": "a"}}]},
        {"inputs": [{"type": "t", "path": "*", "timestamp": {"field": "a", "pattern": "b", "format": "%Y"}}]},
        {"inputs": [{"type": "t", "path": "*", "timestamp": {"zone": "a"}}]},
        {"filters": [{"if": "[a] != 'x'", "grok": {}}]},
        {"filters": [{"grok": []}]},
        {"base_dir": 5},
    ],
)
def test_bad_profiles_are_errors(change):
    profile_from_dict("p", GOOD)
    with pytest.raises(ProfileError):
        profile_from_dict("p", {**GOOD, **change})


def test_scope():
    job = profile_from_dict("p", {**GOOD, "hosts": [{"host": "a"}, {"host": "b"}, "c"]})
    assert job.scope(hosts=["a,c"]).hosts == ("a", "c")
    assert job.scope(hosts=["b", "a"]).hosts == ("a", "b")
    assert job.scope("t").inputs == job.inputs
    for bad in ({"type_": "u"}, {"hosts": "a,x"}):
        with pytest.raises(ProfileError):
            job.scope(**bad)
    with pytest.raises(ProfileError):
        profiles_from_dict({"profiles": {}})
