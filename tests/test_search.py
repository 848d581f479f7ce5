import json
from datetime import datetime, timezone

import pytest

from skeinlog.operators.predicates import QueryError, compile_query
from skeinlog.operators.prefilter import Window, lines_in_window, literals, text_in_window
from skeinlog.plans.profile import Framing, LogInput, ProfileError, profile_from_dict
from skeinlog.plans.search import audit_prefilter, search
from skeinlog.sources.inventory import discover, list_files

NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)
BY_TIME = {"multiline": {"pattern": r"^\d{4}-\d{2}-\d{2}T", "negate": True}}
SPEC = {
    "hosts": ["h1", "h2", "h9"],
    "base_dir": "/opt/logs",
    "inputs": [
        {"type": "system", "path": ["route-system*"], "codec": BY_TIME},
        {"type": "route", "path": ["route-*.log*"], "exclude": ["route-system*"], "codec": BY_TIME},
        {"type": "audit", "path": ["audit/*.json*"], "codec": "json", "tags": ["web"]},
        {"type": "extra", "path": ["/var/extra/*.txt"]},
    ],
    "filters": [
        {"if": '[type] == "route"', "grok": {"path": r"route-%{DATA:route_id}\.log"}},
        {"if": '[type] == "audit"', "grok": {"[ig][routeId]": "%{GREEDYDATA:route_id}"}},
    ],
}
PROFILE = profile_from_dict("lab", SPEC)


def record(second, **more):
    return json.dumps({"timestamp": f"2026-07-23T00:00:{second:02d}.500Z", **more})


# Lines that fool a careless raw filter.
TRICKY = [
    '{"broken": "2026',
    '{"timestamp": "2026-07-23T00:00:07.000Z", "cut": ',
    '{"meta":{"timestamp":"2026-01-01T00:00:00Z"},"timestamp":"2026-07-23T00:00:07.100Z"}',
    '{"meta":{"timestamp":"2026-07-23T00:00:07Z"}}',
    '{"timestamp":"2026-07-23T02:00:07.200+02:00","z":1}',
    '{"timestamp":"24/Jul/2026:00:14:45","z":2}',
    '{"time\\u0073tamp":"2026-07-23T00:00:07.300Z","n":{"timestamp":"2020-01-01T00:00:00Z"}}',
    '{"timestamp":"2020-01-01T00:00:00Z","timestamp":"2026-07-23T00:00:07.400Z"}',
    '{"n":5e2,"w":"a\\/b","flag":true,"u":"caf\\u00e9"}',
    '{"n":500,"w":"a/b","flag":"TRUE","u":"café"}',
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")

    def put(host, path, *lines):
        file = top / host / path.lstrip("/")
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("".join(line + "\n" for line in lines))

    for i, host in enumerate(("h1", "h2")):
        rows = [
            record(s + i, response={"statusCode": str(200 + 100 * (s % 4))}, ig={"routeId": f"r{s % 3}"})
            for s in range(0, 20, 2)
        ]
        put(host, "/opt/logs/audit/access.json", *rows, *TRICKY, " ")
        put(
            host, "/opt/logs/route-00-proxy.log",
            "2026-07-23T00:00:01,100Z | first", "[CONT] body", "", "[CONT] tail",
            "2026-07-23T00:00:09,900Z | second", "2026-07-23T00:00:11Z no fraction",
        )
        put(host, "/opt/logs/route-01-other.log", "2026-07-23T00:00:05,000Z | other")
        put(host, "/opt/logs/route-system.log", "2026-07-23T00:00:02,000Z | system")
        put(host, "/opt/logs/route-system-2026-07-22.0.log", "2026-07-22T00:00:02,000Z | rotated")
    put("h1", "/var/extra/a b+c.txt", "plain", "2026-07-23T00:00:03,000Z plain")
    put("h1", "/opt/logs/audit/deep/skipped.json", record(1))
    put("h5", "/opt/logs/route-system.log", "not in the profile")
    return str(top)


def found(spark, root, filter_, **options):
    result = search(spark, root, PROFILE, filter_, collected=NOW, **options)
    return [(r[0], r[1]) for r in result.events.select("host.name", "message").collect()], result


def test_search_merges_hosts_and_inputs_in_time_order(spark, root):
    result = search(spark, root, PROFILE, {"match_all": {}}, collected=NOW)
    rows = result.events.select("@timestamp", "host.name", "event.dataset").collect()
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    counts = {}
    for r in rows:
        counts[r[1], r[2]] = counts.get((r[1], r[2]), 0) + 1
    assert counts == {
        ("h1", "audit"): 20, ("h2", "audit"): 20, ("h1", "route"): 4, ("h2", "route"): 4,
        ("h1", "system"): 2, ("h2", "system"): 2, ("h1", "extra"): 2,
    }
    assert result.matches.get == {"matches": 54}
    assert [r.host for r in result.missing.collect()] == ["h9"] and not result.ok()


def test_multiline_records_stay_whole(spark, root):
    rows, _ = found(spark, root, {"wildcard": {"message": "*body*tail"}}, hosts="h1")
    assert rows == [("h1", "2026-07-23T00:00:01,100Z | first\n[CONT] body\n\n[CONT] tail")]


def test_discover(spark, root):
    rows = discover(list_files(spark, root, PROFILE), PROFILE).collect()
    got = {(r.host, r.type): r.files for r in rows}
    assert len(got) == 12
    assert got["h1", "system"] == ["route-system-2026-07-22.0.log", "route-system.log"]
    assert got["h1", "route"] == ["route-00-proxy.log", "route-01-other.log"]
    assert got["h1", "audit"] == ["audit/access.json"]
    assert got["h1", "extra"] == ["/var/extra/a b+c.txt"]
    assert got["h2", "extra"] == [] and got["h9", "audit"] == []


def test_scoping_and_errors(spark, root):
    rows, result = found(spark, root, {"match_all": {}}, type_="audit", hosts=["h2"])
    assert {h for h, _ in rows} == {"h2"} and len(rows) == 20
    assert result.missing.count() == 0
    with pytest.raises(ProfileError):
        search(spark, root, PROFILE, {"match_all": {}}, hosts="nope")
    with pytest.raises(ProfileError):
        search(spark, root, PROFILE, {"match_all": {}}, type_="nope")
    with pytest.raises(QueryError):
        search(spark, root, PROFILE, {"match": {"a": "b"}})


def test_limits(spark, root):
    everything = search(spark, root, PROFILE, {"match_all": {}}, collected=NOW).events
    first = [r[0] for r in everything.select("@timestamp").limit(5).collect()]
    earliest = search(
        spark, root, PROFILE, {"match_all": {}}, limit=5, limit_mode="earliest", collected=NOW
    ).events
    assert [r[0] for r in earliest.select("@timestamp").collect()] == first
    some = search(spark, root, PROFILE, {"match_all": {}}, limit=5, collected=NOW).events.collect()
    assert len(some) == 5 and [r["@timestamp"] for r in some] == sorted(r["@timestamp"] for r in some)
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            search(spark, root, PROFILE, {"match_all": {}}, limit=bad)


def files_scanned(df):
    """Number of files Spark opened, from the metrics of the executed scans."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        total = 0
        if name.startswith("Scan"):
            metric = node.metrics().get("numFiles")
            total += metric.get().value() if metric.isDefined() else 0
        if name.startswith("AdaptiveSparkPlan"):
            total += walk(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in name:
            total += walk(node.plan())
        children = node.children()
        return total + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_files_are_pruned_before_reading(spark, root):
    everything, host, label = (
        search(spark, root, PROFILE, q, collected=NOW, type_="route", limit=99)
        for q in (
            {"match_all": {}},
            {"term": {"host.name": "h1"}},
            {"bool": {"filter": [{"wildcard": {"labels.route_id": "00-*"}}, {"term": {"host.name": "h1"}}]}},
        )
    )
    assert [r.files.count() for r in (everything, host, label)] == [4, 2, 1]
    scanned = [files_scanned(r.events) for r in (everything, host, label)]
    assert scanned == [4, 2, 1]


AUDITS = [
    {"term": {"tags": "_jsonparsefailure"}},
    {"term": {"labels.route_id": "r1"}},
    {"range": {"@timestamp": {"gte": "2026-07-23T02:00:06+02:00", "lt": "2026-07-23T00:00:08Z"}}},
    {"range": {"@timestamp": {"gte": "2026-07-23T00:00:10Z"}}},
    {"term": {"n": 500}},
    {"term": {"flag": "TRUE"}},
    {"term": {"w": "a/b"}},
    {"term": {"ig.routeId": "r2"}},
    {"bool": {"filter": [{"term": {"event.dataset": "audit"}}, {"term": {"response.statusCode": 400}}]}},
]


@pytest.mark.parametrize("filter_", AUDITS, ids=lambda q: json.dumps(q)[:60])
def test_prefilters_change_nothing(spark, root, filter_):
    job = PROFILE.scope("audit", "h1")
    assert audit_prefilter(spark, root, job, filter_, NOW).collect() == []
    rows, _ = found(spark, root, filter_, type_="audit", hosts="h1")
    assert rows, "the audit would prove nothing"


def test_prefilters_change_nothing_on_text(spark, root):
    window = {"range": {"@timestamp": {"gte": "2026-07-23T00:00:02Z", "lt": "2026-07-23T00:00:08Z"}}}
    filter_ = {"bool": {"should": [window, {"term": {"labels.route_id": "00-proxy"}}]}}
    for query in (window, filter_, {"bool": {"must_not": {"term": {"event.dataset": "extra"}}}}):
        assert audit_prefilter(spark, root, PROFILE, query, NOW).collect() == []


def test_declared_time_is_not_filtered_by_another_field(spark, root):
    spec = {
        **SPEC,
        "inputs": [
            {"type": "audit", "path": ["audit/*.json*"], "codec": "json", "timestamp": {"field": "z"}},
            {"type": "route", "path": ["route-0*"], "timestamp": {"pattern": r"\d+:\d+:\d+", "format": "%H:%M:%S"}},
        ],
        "filters": [],
    }
    job = profile_from_dict("lab", spec)
    for filter_ in AUDITS[2:4]:
        assert audit_prefilter(spark, root, job, filter_, NOW).collect() == []


def test_two_writers_of_a_label_do_not_prune(spark, root):
    spec = {
        **SPEC,
        "filters": [*SPEC["filters"], {"grok": {"message": r"\| %{WORD:route_id}"}}],
    }
    job = profile_from_dict("lab", spec)
    filter_ = {"term": {"labels.route_id": "second"}}
    result = search(spark, root, job, filter_, type_="route", collected=NOW)
    assert result.events.count() == 2
    assert audit_prefilter(spark, root, job, filter_, NOW).collect() == []


def test_windows_and_terms_of_a_query():
    both = compile_query(
        {
            "bool": {
                "filter": [
                    {"range": {"@timestamp": {"gte": "2026-07-23T16:38:00.5+02:00", "lt": "2026-07-23T14:39:00"}}},
                    {"term": {"a": "word"}},
                    {"bool": {"should": [{"term": {"b": "no"}}, {"term": {"c": "no"}}]}},
                ],
                "must_not": {"term": {"d": "no"}},
            }
        }
    )
    assert Window.of(both).seconds() == ("2026-07-23T14:38:00", "2026-07-23T14:39:00")
    inp = LogInput("t", framing=Framing("json"))
    assert literals(both, inp) == ["word"]
    assert literals(both, LogInput("t")) == []
    assert not Window.of(compile_query({"range": {"@timestamp": {"gte": "2026-07-23"}}}))


FIVE = datetime(2026, 7, 23, 0, 0, 5, tzinfo=timezone.utc)


def test_window_on_unframed_lines(lines_of):
    lines = [
        "before any time", "2026-07-23T00:00:01,100Z first", "[CONT]", "", "tail",
        "2026-07-23T00:00:09,900Z second", "[CONT] two",
    ]
    kept = lines_in_window(lines_of(lines), Window(FIVE)).orderBy("mid")
    assert [r.value for r in kept.collect()] == [lines[0], *lines[5:]]
    kept = lines_in_window(lines_of(lines), Window(None, FIVE)).orderBy("mid")
    assert [r.value for r in kept.collect()] == lines[:5]


def test_window_keeps_lines_whose_time_it_cannot_read(lines_of):
    lines = [
        "2026-07-23T02:00:06,100+02:00 inside, other zone", "2026-07-23T00:00:01,100Z outside", "tail",
        "2026-07-23T00:00:01 no fraction", "tail",
    ]
    kept = lines_in_window(lines_of(lines), Window(FIVE)).orderBy("mid")
    assert [r.value for r in kept.collect()] == [lines[0], *lines[3:]]


def test_a_host_that_cannot_be_read_is_reported(spark, root, monkeypatch):
    from skeinlog.sources import inventory

    listed = inventory.listing_problem

    def problem(session, uri):
        return "AccessControlException: Permission denied" if "/h2" in uri else listed(session, uri)

    monkeypatch.setattr(inventory, "listing_problem", problem)
    rows, result = found(spark, root, {"match_all": {}}, type_="audit")
    assert {h for h, _ in rows} == {"h1"} and len(rows) == 20
    assert sorted((r.host, r.reason.split()[0]) for r in result.missing.collect()) == [("h2", "AccessControlException:"), ("h9", "no")]
    monkeypatch.setattr(inventory, "listing_problem", lambda *_: "IOException: gone")
    with pytest.raises(OSError, match="no host can be read"):
        search(spark, root, PROFILE, {"match_all": {}})


def test_what_the_store_says_about_a_directory(spark, root):
    from skeinlog.sources.inventory import listing_problem

    assert listing_problem(spark, f"{root}/h1") is None and listing_problem(spark, f"{root}/h9") is None
    assert "nosuchscheme" in listing_problem(spark, "nosuchscheme://x/y")
