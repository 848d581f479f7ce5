import random
import re

import pytest
from pyspark.sql import functions as F

from skeinlog.operators.demux import demux
from skeinlog.operators.framing import frame, frame_json, frame_multiline, frame_plain
from skeinlog.plans.profile import Framing, profile_from_dict
from skeinlog.sources.lines import input_lines, last_lines, raw_files


def values(records):
    return [r.value for r in records.orderBy("host", "path", "blk", "mid").collect()]


def test_plain_keeps_blank_lines(lines_of):
    assert values(frame_plain(lines_of(["a", "", " b"]))) == ["a", "", " b"]


JSON_LINES = {
    '{"a":1}': True,
    ' {"a":{"b":[1]}} \r': True,
    "{}": True,
    '{"x":"}"}': True,
    '{"a":1,"a":2}': True,
    '{"a":1} junk': False,
    '{"a":1}}': False,
    '{"a":1},{"b":2}': False,
    '{"a":1},"b":{"c":2}': False,
    '{"a":{}},2]': False,
    "[1]": False,
    '"s"': False,
    '{"a":1': False,
    "not json": False,
}


def test_json_takes_exactly_one_object(lines_of):
    rows = frame_json(lines_of([*JSON_LINES, "", " \t "])).select(
        "value", F.to_json("body").alias("body")
    )
    got = {r.value: r.body for r in rows.collect()}
    assert {v: b is not None for v, b in got.items()} == JSON_LINES
    assert got['{"a":1,"a":2}'] == '{"a":2}'


def joined(lines, how):
    """The same rule, line by line."""
    records, open_record = [], []
    for line in lines:
        trigger = bool(re.search(how.pattern, line)) != how.negate
        if how.what == "next":
            open_record.append(line)
            if not trigger:
                records, open_record = [*records, open_record], []
        elif trigger:
            open_record.append(line)
        else:
            records, open_record = ([*records, open_record] if open_record else records), [line]
    return ["\n".join(r) for r in ([*records, open_record] if open_record else records)]


@pytest.mark.parametrize(
    "how",
    [
        Framing("multiline", pattern="^2026", negate=True),
        Framing("multiline", pattern=r"\\$", what="next"),
        Framing("multiline", pattern="never", negate=True),
    ],
)
def test_multiline_over_many_file_splits(spark, log_root, how):
    root, put = log_root
    rng = random.Random(5)
    files = {}
    for host, name, n in (("h1", "a.log", 1500), ("h1", "b.log", 8), ("h2", "a.log", 1200)):
        lines = []
        for i in range(n):
            kind = rng.random()
            lines.append(f"2026 {i}" if kind < 0.3 else "" if kind < 0.4 else "é" * rng.randrange(30))
            lines[-1] += "\\" if rng.random() < 0.3 else ""
        if name == "a.log":  # one record longer than several splits
            lines[200:900] = [f"long {i} \\" for i in range(700)]
        files[host, f"/logs/{name}"] = lines
        put(host, f"/logs/{name}", "\n".join(lines) + "\n")
    profile = profile_from_dict(
        "p", {"hosts": ["h1", "h2"], "base_dir": "/logs", "inputs": [{"type": "t", "path": ["*.log"]}]}
    )
    lines = input_lines(raw_files(spark, root, profile), root, profile, profile.inputs[0])
    assert lines.select("host", "path", "blk").distinct().count() > 6
    orders = (frame(lines, how), frame_multiline(lines.repartition(5), how, scan_order=False))
    for records in orders:
        got = {}
        for row in records.orderBy("host", "path", "blk", "mid").collect():
            got.setdefault((row.host, row.path), []).append(row.value)
        assert got == {file: joined(text, how) for file, text in files.items()}


def test_multiline_joins_without_shuffling_the_lines(spark, log_root):
    root, put = log_root
    put("h1", "/logs/a.log", "2026 a\n b\n" * 10)
    profile = profile_from_dict(
        "p", {"hosts": ["h1"], "base_dir": "/logs", "inputs": [{"type": "t", "path": ["*"]}]}
    )
    lines = input_lines(raw_files(spark, root, profile), root, profile, profile.inputs[0])
    plan = frame(lines, Framing("multiline", pattern="^2026", negate=True))
    text = plan._jdf.queryExecution().executedPlan().toString()
    # The one exchange carries the border records of files that have several splits.
    assert text.count("Exchange") == 1 and "is_first" in text


KNOWN = ["/logs/a", "/logs/b"]
CAPTURE = [
    "before",
    "==> /logs/a <==",
    "a1",
    "",
    "",
    "==> /logs/b <==",
    "b1",
    "==> /etc/shadow <==",
    "",
    "==> /logs/a <==",
    "a2",
    "",
]
ROUTED = [
    ("/logs/a", "before"),
    ("/logs/a", "a1"),
    ("/logs/a", ""),
    ("/logs/b", "b1"),
    ("/logs/b", "==> /etc/shadow <=="),
    ("/logs/a", "a2"),
    ("/logs/a", ""),
]


@pytest.mark.parametrize("split", [1, 2, 3, 100])
def test_demux_with_any_split(lines_of, split):
    capture = lines_of(CAPTURE).withColumn("blk", F.floor(F.col("mid") / split))
    rows = demux(capture, KNOWN).orderBy("mid").collect()
    assert [(r.file, r.value) for r in rows] == ROUTED


def test_demux_of_one_file_has_no_header(lines_of):
    rows = demux(lines_of(["x", "", "y"]), ["/logs/only"]).orderBy("mid").collect()
    assert [(r.file, r.value) for r in rows] == [("/logs/only", v) for v in ("x", "", "y")]


def test_last_lines_per_file(lines_of):
    both = lines_of([str(i) for i in range(9)]).unionByName(lines_of(["z"], path="/logs/z"))
    assert values(last_lines(both, 3)) == ["6", "7", "8", "z"]
    plan = last_lines(both, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # rows are cut before the shuffle
