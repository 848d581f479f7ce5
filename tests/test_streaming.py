import json
import os
import random

import pytest

from skeinlog.plans.profile import profile_from_dict
from skeinlog.streaming.follow import _Follower, _Range, _read_lines
from skeinlog.streaming.tail import open_records, tail, write_stream


def job(**options):
    inp = {"type": "t", "path": ["*.log*"], "start_position": "beginning", **options}
    return profile_from_dict("p", {"hosts": ["h1", "h2"], "base_dir": "/logs", "inputs": [inp]})


@pytest.fixture
def run(spark, log_root, tmp_path):
    """Run the follower until it has caught up; returns (host, path, message) so far."""
    root, put = log_root
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def go(profile, **options):
        query = write_stream(tail(spark, root, profile, **options), out, checkpoint, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
        rows = [json.loads(r.value) for r in spark.read.text(out).collect()]
        return sorted((e["host"]["name"], e["log"]["file"]["path"], e["message"]) for e in rows)

    go.put, go.root, go.progress = put, root, str(tmp_path / "progress")
    return go


def test_appends_restart_and_rotation(run):
    run.put("h1", "/logs/a.log", "one\n\ntwo\npart")
    run.put("h2", "/logs/a.log", "other\n")
    run.put("h2", "/logs/a.txt", "not followed\n")
    first = run(job(), maxBytesPerTask=3)
    assert first == [
        ("h1", "/logs/a.log", ""),
        ("h1", "/logs/a.log", "one"),
        ("h1", "/logs/a.log", "two"),
        ("h2", "/logs/a.log", "other"),
    ]
    run.put("h1", "/logs/a.log", "ial\n")
    os.rename(f"{run.root}/h1/logs/a.log", f"{run.root}/h1/logs/a.log.1")
    run.put("h1", "/logs/a.log", "new\n")
    run.put("h2", "/logs/b.log", "late é\n")
    added = [
        ("h1", "/logs/a.log", "new"),
        ("h1", "/logs/a.log.1", "partial"),
        ("h2", "/logs/b.log", "late é"),
    ]
    assert run(job()) == sorted(first + added)
    assert run(job()) == sorted(first + added)


def test_multiline_state_over_batches(run, spark):
    profile = job(codec={"multiline": {"pattern": "^2026", "negate": True}})
    long_record = "".join(f" line {i}\n" for i in range(30))
    run.put("h1", "/logs/a.log", "2026 one\n a\n2026 two\n" + long_record + "2026 three\n b\n")
    one_two = [
        ("h1", "/logs/a.log", "2026 one\n a"),
        ("h1", "/logs/a.log", "2026 two\n" + long_record.rstrip("\n")),
    ]
    assert run(profile, maxBytesPerTask=40, progress=run.progress) == one_two
    run.put("h1", "/logs/a.log", " c\n2026 four\n")
    assert run(profile, progress=run.progress) == sorted([*one_two, ("h1", "/logs/a.log", "2026 three\n b\n c")])
    rest = open_records(spark, run.root, profile, "t", run.progress).collect()
    assert [(r.host, r.path, r.value) for r in rest] == [("h1", "/logs/a.log", "2026 four")]


def test_multiline_next(run):
    profile = job(codec={"multiline": {"pattern": r"\\$", "what": "next"}})
    run.put("h1", "/logs/a.log", "a\\\nb\nc\nd\\\n")
    assert [m for _, _, m in run(profile, maxBytesPerTask=2)] == ["a\\\nb", "c"]
    run.put("h1", "/logs/a.log", "e\n")
    assert [m for _, _, m in run(profile)] == ["a\\\nb", "c", "d\\\ne"]


def test_start_at_the_end_scope_and_filter(run):
    run.put("h1", "/logs/a.log", '{"n":1}\n')
    profile = job(codec="json", start_position="end")
    options = {"hosts": "h1", "filter_": {"range": {"n": {"gte": 3}}}}
    assert run(profile, **options) == []
    run.put("h1", "/logs/a.log", '{"n":2}\n{"n":3}\n')
    run.put("h2", "/logs/a.log", '{"n":4}\n')
    assert run(profile, **options) == [("h1", "/logs/a.log", '{"n":3}')]


def test_any_cut_of_the_bytes_gives_every_line_once(tmp_path):
    rng = random.Random(4)
    lines = ["é" * rng.randrange(6) + str(i) for i in range(60)] + ["", "", "x"]
    data = ("\n".join(lines) + "\nopen end").encode()
    file = tmp_path / "f"
    file.write_bytes(data)
    starts = [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line.encode()) + 1)
    for _ in range(20):
        cuts = sorted({0, len(data), *rng.sample(range(len(data)), 9)})
        got = []
        for a, b in zip(cuts, cuts[1:]):
            for batch in _read_lines(_Range(str(file), "h", "/f", a, b)):
                got += [(r["mid"], r["value"]) for r in batch.to_pylist()]
        assert got == list(zip(starts, lines))


def test_a_batch_is_planned_within_its_bytes(tmp_path):
    for name in ("a", "b"):
        folder = tmp_path / "h" / name
        folder.parent.mkdir(exist_ok=True)
        folder.write_bytes(b"0123456789\n" * 10)
    reader = _Follower({"path": str(tmp_path), "maxBytesPerBatch": "120", "maxBytesPerTask": "50"})
    start = reader.initialOffset()
    seen = []
    while True:
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        if not parts:
            break
        assert sum(p.end - p.start for p in parts) <= 120
        assert all(p.end - p.start <= 50 for p in parts)
        seen += parts
        start = end
    assert sum(p.end - p.start for p in seen) == 220


def test_the_bytes_of_a_batch_are_shared_over_the_files(tmp_path):
    from skeinlog.streaming.follow import _Follower

    for name, size in (("a.log", 9000), ("b.log", 100), ("c.log", 2000)):
        (tmp_path / "h1").mkdir(exist_ok=True)
        (tmp_path / "h1" / name).write_text("x" * (size - 1) + "\n")
    follower = _Follower({"path": str(tmp_path), "maxBytesPerBatch": "1000"})
    follower.initialOffset()
    assert follower.latestOffset()["files"] == {"h1/a.log": 450, "h1/b.log": 100, "h1/c.log": 450}


def planned(reader, start, end):
    return sorted((p.path, p.start, p.end) for p in reader.partitions(start, end))


@pytest.mark.parametrize("identity", [None, "content"])
def test_a_file_is_known_by_its_identity(tmp_path, identity):
    """Renamed, replaced by a longer one, cut, and grown from a few bytes: also where there is no inode."""
    folder = tmp_path / "h"
    folder.mkdir()

    def put(name, text):
        (folder / name).write_bytes(text.encode())

    put("a.log", "a1\n" * 500)
    put("b.log", "b\n")
    put("c.log", "c1\n" * 20)
    options = {"path": str(tmp_path), **({"identity": identity} if identity else {})}
    reader = _Follower(options)
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert planned(reader, start, first) == [("/a.log", 0, 1500), ("/b.log", 0, 2), ("/c.log", 0, 60)]
    os.rename(folder / "a.log", folder / "a.log.1")  # goes on under its new name
    with open(folder / "a.log.1", "a") as out:
        out.write("a2\n")
    put("a.log", "new\n" * 900)  # a longer file under the old name
    with open(folder / "b.log", "a") as out:
        out.write("b2\n" * 1000)
    os.remove(folder / "c.log")
    put("c.log", "other\n")
    second = reader.latestOffset()
    wanted = [("/a.log", 0, 3600), ("/a.log.1", 1500, 1503), ("/b.log", 2, 3002), ("/c.log", 0, 6)]
    assert planned(reader, first, second) == wanted
    # A reader that begins again knows the files by the offset alone.
    again = _Follower(options)
    assert planned(again, first, again.latestOffset()) == wanted
    assert planned(reader, second, reader.latestOffset()) == []


def test_the_first_batch_is_bounded_also_after_a_restart(tmp_path):
    folder = tmp_path / "in" / "h"
    folder.mkdir(parents=True)
    (folder / "a").write_bytes(b"0123456789\n" * 100)
    options = {"path": str(tmp_path / "in"), "maxBytesPerBatch": "200", "progress": str(tmp_path / "progress")}
    reader = _Follower(options)
    at, total = reader.initialOffset(), 0
    for _ in range(20):
        end = reader.latestOffset()
        grown = sum(p.end - p.start for p in reader.partitions(at, end))
        assert grown <= 200
        total, at, reader = total + grown, end, _Follower(options)
    assert total == 1100


def test_hosts_and_excludes_are_not_listed_or_read(run):
    for host in ("h1", "h2", "h3"):
        run.put(host, "/logs/a.log", f"{host}\n")
        run.put(host, "/logs/skip.log", "excluded\n")
    run.put("h1", "/other/b.log", "absolute\n")
    profile = profile_from_dict("p", {"hosts": ["h1", "h2"], "base_dir": "/logs", "inputs": [
        {"type": "t", "path": ["*.log"], "exclude": ["sk*"], "start_position": "beginning"},
        {"type": "u", "path": ["/other/*.log"], "exclude": ["b*"], "start_position": "beginning"},
    ]})
    assert run(profile, hosts="h1") == [("h1", "/logs/a.log", "h1"), ("h1", "/other/b.log", "absolute")]


def test_scope_of_the_reader(tmp_path):
    for name in ("h1/logs/a.log", "h1/logs/b.log", "h2/logs/a.log", "h1/logs/.hidden.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    scope = [{"include": r"\A/logs/[^/]*\.log\Z", "base": "/logs/", "exclude": [r"\Ab"]}]
    reader = _Follower({"path": str(tmp_path), "hosts": '["h1", "h9"]', "scope": json.dumps(scope)})
    assert reader._sizes() == {"h1/logs/a.log": 2}


RULE = {"pattern": "^2026", "negate": True, "what": "previous", "delimiter": "\n"}


def records(reader, start, end):
    return [r["value"] for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("what", ["previous", "next"])
@pytest.mark.parametrize("budget", [1, 30, 10_000])
def test_offsets_stand_at_borders_of_records(tmp_path, what, budget):
    rng = random.Random(budget)
    rule = RULE if what == "previous" else {"pattern": r"\\$", "negate": False, "what": "next", "delimiter": "\n"}
    file = tmp_path / "h" / "a"
    file.parent.mkdir()
    file.touch()
    reader = _Follower({"path": str(tmp_path), "rule": json.dumps(rule), "maxBytesPerBatch": str(budget), "maxBytesPerTask": "7"})
    at, got, lines = reader.initialOffset(), [], []
    for _ in range(25):
        for _ in range(rng.randrange(6)):
            tail_ = "\\" if what == "next" and rng.random() < 0.6 else ""
            lines.append(rng.choice(["2026 ", "", "é", "x" * rng.randrange(60)]) + str(len(lines)) + tail_)
        file.write_text("".join(line + "\n" for line in lines) + "cut off")
        end = reader.latestOffset()
        got += records(reader, at, end)
        at = end
    for _ in range(3000):
        end = reader.latestOffset()
        if end == at:
            break
        got += records(reader, at, end)
        at = end
    from skeinlog.plans.profile import Framing
    from tests.test_framing import joined

    framing = Framing("multiline", pattern=rule["pattern"], negate=rule["negate"], what=what)
    wanted = joined(lines, framing)
    still_open = what == "previous" or lines[-1].endswith("\\")
    assert got == (wanted[:-1] if still_open else wanted)


def test_renamed_and_resting_records_are_closed(tmp_path, monkeypatch):
    import skeinlog.streaming.follow as F

    clock = [1000.0]
    monkeypatch.setattr(F.time, "time", lambda: clock[0])
    file = tmp_path / "h" / "a.log"
    file.parent.mkdir()
    file.write_text("2026 one\n a\n2026 two\n b\n")
    reader = _Follower({"path": str(tmp_path), "rule": json.dumps(RULE), "flushAfterMs": "5000"})
    offsets = [reader.initialOffset()]

    def step(after=0.0):
        clock[0] += after
        offsets.append(reader.latestOffset())
        return records(reader, offsets[-2], offsets[-1])

    assert step() == ["2026 one\n a"]
    assert step(2) == [] and step(4) == ["2026 two\n b"] and step(9) == []
    with open(file, "a") as out:
        out.write(" late\n more\n2026 three\n")
    assert step() == [" late\n more"]  # what a flush has cut off begins a record
    os.rename(file, tmp_path / "h" / "a.log.1")
    file.write_text("2026 new\n")
    assert step() == ["2026 three"]
    assert step(6) == ["2026 new"] and step() == []


def test_a_multiline_stream_keeps_no_state(run, spark):
    run.put("h1", "/logs/a.log", "2026 one\n")
    events = tail(spark, run.root, job(codec={"multiline": {"pattern": "^2026", "negate": True}}))
    plan = events._jdf.queryExecution().analyzed().toString()
    assert "WithState" not in plan and "Exchange" not in plan and "MapInArrow" not in plan
