import json
from datetime import datetime, timezone

import pytest

from skeinlog.operators import catalog as C
from skeinlog.operators import summary as S
from skeinlog.operators.events import to_events
from skeinlog.operators.framing import frame_json
from skeinlog.plans.discovery import discover_fields
from skeinlog.plans.profile import profile_from_dict

NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)
SPEC = {
    "hosts": ["h1", "h2", "h9"],
    "base_dir": "/logs",
    "inputs": [
        {"type": "a", "path": ["*.json"], "codec": "json"},
        {"type": "b", "path": ["*.log"], "codec": {"multiline": {"pattern": "^2026", "negate": True}}},
    ],
}
PROFILE = profile_from_dict("p", SPEC)


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fields")
    records = {
        "h1": [{"n": i, "s": "200", "list": [1, 2.5], "only": {"h1": True}} for i in range(4)]
        + [{"n": "text", "at": "2026-07-23T00:00:00Z", "day": "2026-07-23", "none": None, "empty": {}}],
        "h2": [{"n": i, "s": "404"} for i in range(5)],
    }
    for host, rows in records.items():
        folder = root / host / "logs"
        folder.mkdir(parents=True)
        (folder / "x.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        (folder / "y.log").write_text("2026-01-01 first\n more\n" + "2026 next\n tail\n" * 3)
    return discover_fields(spark, str(root), PROFILE, sample=5, collected=NOW)


def test_report(found):
    report = json.loads(found.report.first().value)
    fields, sample = report["fields"], report["sample"]
    base = {"metadata_field": False, "searchable": True, "aggregatable": False}
    assert report["indices"] == ["a", "b"]
    assert fields["@timestamp"] == {"date": base}
    assert fields["n"] == {"long": {**base, "indices": ["a"]}, "keyword": {**base, "indices": ["a"]}}
    assert set(fields["list"]) == {"long", "double"}
    assert set(fields["at"]) == {"date"} and set(fields["day"]) == {"keyword"}
    assert set(fields["only.h1"]) == {"boolean"}
    assert "none" not in fields and "empty" not in fields
    # Five lines per host and file: the text files give two whole records each, not half a one.
    assert sample["docs_sampled"] == 14
    assert sample["hosts"] == ["h1", "h2"]
    assert sample["coverage"]["list"] == 0.8 and sample["doc_coverage"]["list"] == 0.4
    assert sample["coverage"]["s"] == 0.9 and sample["coverage"]["message"] == 1.0
    assert sample["examples"]["s"] == ["200", "404"]
    assert len(sample["examples"]["message"]) == 3
    assert sample["examples"]["only.h1"] == [True]
    conflicts = sample["host_conflicts"]
    assert {"only.h1", "list", "at", "day"} <= set(conflicts) and "n" not in conflicts
    assert [r.host for r in found.missing.collect()] == ["h9"]


def test_depth_is_never_cut_silently(bodies):
    deep = {"leaf": 1}
    for _ in range(20):
        deep = {"k": deep}
    rows = bodies([deep]).select(C.body_leaves(C.F.col("body"), 64)[0]["field"].alias("f"))
    assert rows.first().f == ".".join(["k"] * 20 + ["leaf"])
    short = bodies([deep]).select(C.F.inline(C.body_leaves(C.F.col("body"), 5)))
    with pytest.raises(Exception, match="max_depth"):
        short.select(C.family(C.F.col("v"), C.F.col("kind"))).collect()


def test_examples_are_the_smallest_distinct_values(spark):
    rows = [("f", [f'"{i % 50:03d}"']) for i in range(2000)] + [("g", ["1"]), ("g", ["1"])]
    frame = spark.createDataFrame(rows, "field string, smallest array<string>").repartition(7)
    got = {r.field: r.examples for r in S.examples(frame).collect()}
    assert got == {"f": ['"000"', '"001"', '"002"'], "g": ["1"]}


def test_a_record_may_be_deeper_than_any_fixed_depth(spark, tmp_path):
    deep = 1
    for _ in range(90):
        deep = {"k": [deep]}
    file = tmp_path / "h1/logs/deep.json"
    file.parent.mkdir(parents=True)
    file.write_text(json.dumps({"deep": deep}) + "\n")
    got = discover_fields(spark, str(tmp_path), PROFILE, type_="a", hosts=["h1"])
    fields = json.loads(got.report.first()[0])["fields"]
    assert ".".join(["deep"] + ["k"] * 90) in fields


def test_a_sample_decodes_compressed_files(spark, tmp_path):
    import gzip

    folder = tmp_path / "h1/logs"
    folder.mkdir(parents=True)
    profile = profile_from_dict("p", {**SPEC, "inputs": [
        {"type": "a", "path": ["*.json", "*.json.gz"], "codec": "json"},
        {"type": "b", "path": ["*.log.gz"], "codec": {"multiline": {"pattern": "^2026", "negate": True}}},
    ]})
    for name, opener in (("x.json", open), ("y.json.gz", gzip.open)):
        with opener(folder / name, "wt") as out:
            out.writelines(json.dumps({f"{name[0]}{i // 3}": i}) + "\n" for i in range(6))
    with gzip.open(folder / "z.log.gz", "wt") as out:
        out.write("2026 one\n more\n2026 two\n end\n")
    got = discover_fields(spark, str(tmp_path), profile, hosts=["h1"], sample=3)
    counts = {(r.dataset, r.field): r for r in got.catalog.collect()}
    assert {f for t, f in counts if t == "a" and f[1:] in ("0", "1")} == {"x1", "y1"}
    assert counts["a", "x1"].n == counts["a", "y1"].n == 3
    assert counts["b", "message"].n == 1  # the record before it lost its first line to the sample


ODD = [
    {"n": 5.0, "m": 1e3, "big": 1 << 70, "edge": (1 << 63) - 1, "neg": -(1 << 63), "f": [1, 2.5, "2026-07-23T00:00:00Z", None, [True, []]]},
    {"a.b": "x", "a": {"b": 1, "": "empty"}, "": "no name", "host": "reserved", "t": "tab\t and \"quotes\" é"},
    {"o": [{"k": 1}, {"k": "s", "l": [[{"m": 1}], {"m": 2}]}], "nul": None, "e": {}, "el": [], "d": "2026-07-23 01:02:03"},
    {"s": "a", "n": 7}, {"s": "a b", "n": 7}, {"s": "ab"}, {"s": ""},
]


def test_one_pass_equals_the_leaves(lines_of):
    lines = lines_of([*map(json.dumps, ODD), "no json", '{"dup": 1, "dup": "2"}', '{"half": "\\ud800"}', "2026-07-23T00:00:01,5Z text"])
    inp = PROFILE.inputs[0]
    events = to_events(frame_json(lines), PROFILE, inp, NOW)
    for limit in (S.MAX_ENTRIES, 3):
        S.MAX_ENTRIES, before = limit, S.MAX_ENTRIES
        entries = S.summarize(events)
        rows = C.leaves(events)
        got = sorted(tuple(r) for r in C.count_fields(entries).collect())
        assert got == sorted(tuple(r) for r in C.count_leaves(rows).select("field", "family", "dataset", "host", "n", "docs").collect())
        S.MAX_ENTRIES = before
    smallest = {}
    for r in rows.select("field", "json").distinct().collect():
        smallest.setdefault(r.field, set()).add(r.json)
    shown = {r.field: r.examples for r in S.examples(entries).collect()}
    numbers = {"n", "m", "big", "f"}  # shown as they are written, where a parsed value has one form
    assert {f: v for f, v in shown.items() if f not in numbers} == {f: sorted(v)[:3] for f, v in smallest.items() if f not in numbers}
    assert shown["n"] == ["5.0", "7"] and shown["s"] == ['""', '"a b"', '"a"']


def test_a_depth_limit_is_an_error(lines_of):
    events = to_events(frame_json(lines_of(['{"a":{"b":{"c":1}}}'])), PROFILE, PROFILE.inputs[0], NOW)
    assert S.summarize(events, 3).where("field = 'a.b.c'").count() == 1
    with pytest.raises(Exception, match="max_depth"):
        S.summarize(events, 1).collect()


def test_report_lines(found):
    rows = [json.loads(r.value) for r in C.field_lines(C.field_table(found.catalog, S.examples(found.catalog))).collect()]
    assert [r["field"] for r in rows] == sorted(r["field"] for r in rows)
    [n] = [r for r in rows if r["field"] == "n"]
    assert set(n["capabilities"]) == {"long", "keyword"} and n["capabilities"]["long"]["indices"] == ["a"] and not n["host_conflict"]
