import io
import random

import pyarrow as pa

import pytest

from skeinlog.operators.prefilter import Window
from skeinlog.plans.profile import Framing, profile_from_dict
from skeinlog.plans.search import read_events, search
from skeinlog.sources.inventory import input_files
from skeinlog.sources.records import RANGE_BYTES, LineRule, cuttable, range_records, read_range
from tests.test_framing import joined
from tests.test_search import FIVE, NOW

RULES = [
    Framing("multiline", pattern="^2026", negate=True),
    Framing("multiline", pattern=r"\\$", what="next"),
    Framing("multiline", pattern="never", negate=True),
    Framing("multiline", pattern="never"),
    Framing("multiline", pattern="é+", what="next", negate=True),
    Framing("multiline", delimiter="\r\n", pattern=r"^\s", what="previous"),
]


class File:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        found = self.data[at : at + n]
        self.read += len(found)
        return found


def text_lines(rng, n):
    lines = []
    for i in range(n):
        kind = rng.random()
        line = f"2026 {i}" if kind < 0.3 else "" if kind < 0.5 else " " * rng.randrange(2) + "é" * rng.randrange(9)
        lines.append(line + ("\\" if rng.random() < 0.3 else ""))
    return lines


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_ranges_give_each_record_once_wherever_they_are_cut(rule):
    rng = random.Random(7)
    for ended in (True, False):
        for n in (0, 1, 2, 7, 40):
            lines = text_lines(rng, n)
            if lines and not lines[-1]:
                lines[-1] = "end"
            data = rule.delimiter.join(lines) + (rule.delimiter if ended and lines else "")
            data = data.encode()
            for step in (1, 2, 3, 5, 17, 64, 10_000):
                got = []
                for start in range(0, len(data), step):
                    file = File(data)
                    got += list(read_range(file, start, min(start + step, len(data)), LineRule.of(rule), block=rng.choice([4, 16, 1000])))
                assert [at for at, _ in got] == sorted({at for at, _ in got})
                wanted = [r.replace("\n", rule.delimiter) for r in joined(lines, rule)]
                assert [text for _, text in got] == wanted, (step, lines)


def test_a_record_longer_than_blocks_and_ranges():
    lines = ["2026 a", *["x" * 5000] * 50, "2026 b"]
    data = "\n".join(lines).encode()
    got = [r for s in range(0, len(data), 999) for r in read_range(File(data), s, s + 999, LineRule.of(RULES[0]), block=100)]
    assert [t for _, t in got] == ["\n".join(lines[:-1]), "2026 b"]


def test_bytes_that_are_no_text():
    got = list(read_range(File(b"2026 \xff\xfe\n\xc3\n2026 b\n"), 0, 17, LineRule.of(RULES[0])))
    assert [t for _, t in got] == ["2026 ��\n�", "2026 b"]


def test_a_window_decides_by_the_first_line():
    data = "\n".join(
        [
            "2026-07-23T00:00:01,100Z early", "late mention 2026-07-23T00:00:09,100Z", "2026-07-23T00:00:06,100Z inside", "tail",
            "2026-07-23T02:00:01,100+02:00 other zone", "2026-07-23T00:00:01 no fraction", "2026-07-23T00:00:01.5+0000 early too",
        ]
    ).encode()
    rule = LineRule.of(Framing("multiline", pattern=r"^\d{4}-", negate=True))
    got = list(read_range(File(data), 0, len(data), rule, Window(FIVE).may_hold))
    assert [t[:28] for _, t in got] == ["2026-07-23T00:00:06,100Z ins", "2026-07-23T02:00:01,100+02:0", "2026-07-23T00:00:01 no fract"]


def test_delimiters_that_overlap_are_not_cut():
    assert cuttable(Framing(delimiter="\r\n")) and cuttable(Framing()) and not cuttable(Framing(delimiter="--"))


MULTI = {"type": "t", "path": ["*.log*"], "codec": {"multiline": {"pattern": r"^\d{4}-\d{2}-\d{2}T", "negate": True}}}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    import gzip

    top = tmp_path_factory.mktemp("records")
    rng = random.Random(2)
    wanted = {}
    for host in ("h1", "h2"):
        for name in ("a.log", "b c.log", "packed.log.gz"):
            lines = ["no time yet"]
            for i in range(400):
                lines.append(f"2026-07-23T00:00:{i % 60:02d},{i:03d}Z {host} {name} {i}")
                lines += ["  at line é" * rng.randrange(4) for _ in range(rng.randrange(6))]
            file = top / host / "logs" / name
            file.parent.mkdir(parents=True, exist_ok=True)
            opened = gzip.open(file, "wt") if name.endswith("gz") else open(file, "w")
            with opened as out:
                out.write("\n".join(lines) + "\n")
            wanted[host, f"/logs/{name}"] = joined(lines, Framing("multiline", pattern=r"^\d{4}-\d{2}-\d{2}T", negate=True))
    profile = profile_from_dict("p", {"hosts": ["h1", "h2", "h9"], "base_dir": "/logs", "inputs": [MULTI]})
    return str(top), profile, wanted


def test_files_of_many_ranges(spark, logs):
    root, profile, wanted = logs
    files = input_files(spark, root, profile, profile.inputs[0], lambda host, path: ~path.endswith(".gz"))
    for step in (1 << 20, 700):
        got = {}
        for r in range_records(files, profile.inputs[0].framing, range_bytes=step).orderBy("host", "path", "blk", "mid").collect():
            got.setdefault((r.host, r.path), []).append(r.value)
        assert got == {k: v for k, v in wanted.items() if not k[1].endswith("gz")}


def test_events_of_seekable_and_compressed_files(spark, logs):
    root, profile, wanted = logs
    rows = read_events(spark, root, profile, NOW).select("host.name", "log.file.path", "message").collect()
    assert sorted(map(tuple, rows)) == sorted((h, p, m) for (h, p), records in wanted.items() for m in records)


def test_search_in_a_window_joins_only_what_may_match(spark, logs):
    root, profile, wanted = logs
    window = {"range": {"@timestamp": {"gte": "2026-07-23T00:00:10Z", "lt": "2026-07-23T00:00:12Z"}}}
    runs = [
        search(spark, root, profile, window, prefilter=on, collected=NOW).events.select("host.name", "log.file.path", "message").collect()
        for on in (True, False)
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 6 * 14
    plan = search(spark, root, profile, window, collected=NOW).events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") == 1


def test_small_ranges_share_a_task_and_read_little_beyond(spark, tmp_path, monkeypatch):
    from skeinlog.sources import records

    data = "".join(f"2026 {i}\n  more\n" for i in range(2000)).encode()
    (tmp_path / "a.log").write_bytes(data)
    files = spark.createDataFrame([("h1", "/a.log", len(data), f"file://{tmp_path}/a.log")], "host string, path string, length long, uri string")
    found = range_records(files, RULES[0], range_bytes=100)
    assert found.rdd.getNumPartitions() == 1
    rows = found.orderBy("mid").collect()
    assert [r.value for r in rows] == [f"2026 {i}\n  more" for i in range(2000)]
    assert all(r.blk == r.mid // 100 * 100 for r in rows)

    blocks = []
    monkeypatch.setattr(records, "read_range", lambda file, start, end, rule, keep, block: blocks.append(block) or ())
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, read, schema: read, raising=False)
    read = range_records(files, RULES[0], range_bytes=20_000)
    one = {"host": "h1", "path": "/a.log", "uri": f"file://{tmp_path}/a.log", "start": 0, "end": len(data)}
    list(read(iter([pa.RecordBatch.from_pylist([one])])))
    assert len(blocks) == -(-len(data) // 20_000) and max(blocks) < 50_000


def test_a_large_range_is_a_task_of_its_own(spark):
    files = spark.createDataFrame([("h1", "/a.log", 5 * RANGE_BYTES + 1, "file:///none")], "host string, path string, length long, uri string")
    assert range_records(files, RULES[0]).rdd.getNumPartitions() == 6
