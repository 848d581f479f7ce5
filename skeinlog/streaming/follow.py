"""A streaming source of lines that are appended to files.

Spark's own file stream takes a file once and ignores what is appended later. This source keeps a
byte offset per file. A line belongs to the byte range that holds its line end, so any split of
the bytes gives every line exactly once, and a last line without its end waits for the next batch.

A file is known by its identity, not by its name: on a local disk by its inode, elsewhere by a hash of
its first bytes and how many these are. So a renamed file goes on where it was, and a new file under an
old name, longer or not, is read from its start. First bytes are read of files that are new or have
grown only.

With a line rule the source gives multi-line records. The offset of a file then stands at the start of
its open record, so a batch is made of whole records: its tasks read byte ranges as a batch job does, and
there is no state and no shuffle. The open record is closed by the line that begins the next one, when the
file is renamed, or after ``flushAfterMs`` without a new byte.

A batch reads at most ``maxBytesPerBatch``, the first one too, and a longer record in a batch of its own. After a restart this holds where
``progress`` names a folder in which the source keeps what it planned last; Spark doesn't tell a source
the committed offset before it asks for the next.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "appended_lines"
SCHEMA = "host string, path string, blk bigint, mid bigint, value string"
HEAD_BYTES = 1024

_BLOCK = 4 << 20


@dataclass
class _Range(InputPartition):
    file: str
    host: str
    path: str
    start: int
    end: int
    opens: bool = False


class AppendedLines(DataSource):
    """Options: ``path`` (root with one directory per host), ``hosts`` (a JSON list, default all),
    ``scope`` (a JSON list of ``include`` and ``exclude`` regular expressions, see :class:`Scope`, default
    all files), ``startingPosition`` (beginning or end), ``maxBytesPerBatch`` (default 1 GiB),
    ``maxBytesPerTask`` (default 64 MiB), ``progress`` (a folder, default none), ``identity``
    (``content`` also on local disks), ``rule`` (a JSON object: pattern, negate, what and delimiter of
    multi-line records, default lines) and ``flushAfterMs`` (default never)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follower(self.options)


@dataclass(frozen=True)
class Scope:
    """Files whose path below the host matches ``include`` and whose name, the path without ``base``,
    matches none of ``exclude``."""

    include: str
    base: str = ""
    exclude: tuple[str, ...] = ()

    def holds(self, path: str) -> bool:
        if not re.search(self.include, path):
            return False
        shown = path.removeprefix(self.base)
        return not any(re.search(pattern, shown) for pattern in self.exclude)


class _Follower(DataSourceStreamReader):
    """Offset: ``{"files": {file: byte}, "ids": {file: identity}}``."""

    def __init__(self, options):
        self.root = options["path"]
        hosts = options.get("hosts")
        self.hosts = json.loads(hosts) if hosts else None
        self.scopes = [Scope(**s) for s in json.loads(options.get("scope", "[]"))]
        self.from_end = options.get("startingPosition", "beginning") == "end"
        self.per_batch = int(options.get("maxBytesPerBatch", 1 << 30))
        self.per_task = int(options.get("maxBytesPerTask", 64 << 20))
        self.by_content = options.get("identity") == "content"
        self.progress = options.get("progress")
        self.rule = line_rule(json.loads(options["rule"])) if options.get("rule") else None
        self.flush_after = int(options.get("flushAfterMs", 0))
        self.planned: dict | None = self._recalled()

    # ---- what there is

    def _sizes(self) -> dict[str, int]:
        """Size of every followed file, by its path below the root. Only the hosts in question are listed."""
        store, base = store_of(self.root)
        tops = [base] if self.hosts is None else [f"{base}/{host}" for host in self.hosts]
        sizes = {}
        for top in tops:
            for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
                name = info.path[len(base) :].lstrip("/")
                below_host = "/" + name.partition("/")[2]
                hidden = name.rsplit("/", 1)[-1].startswith((".", "_"))
                wanted = not self.scopes or any(s.holds(below_host) for s in self.scopes)
                if info.type == fs.FileType.File and not hidden and wanted:
                    sizes[name] = info.size
        return sizes

    def _head(self, name: str, n: int) -> str:
        """A hash of the first ``n`` bytes of a file; empty if there are fewer."""
        store, base = store_of(self.root)
        try:
            with store.open_input_file(f"{base}/{name}") as file:
                data = file.read_at(n, 0)
        except FileNotFoundError:
            return ""
        return hashlib.blake2b(data, digest_size=12).hexdigest() if len(data) == n else ""

    def _is(self, name: str, size: int, identity: str) -> bool:
        """Whether a file has this identity of content."""
        kind, _, rest = identity.partition(":")
        n, _, digest = rest.partition(":")
        return kind == "head" and size >= int(n) and self._head(name, int(n)) == digest

    def _identity(self, name: str, size: int) -> str:
        store, base = store_of(self.root)
        if isinstance(store, fs.LocalFileSystem) and not self.by_content:
            import os

            try:
                return f"inode:{os.stat(f'{base}/{name}').st_ino}"
            except OSError:
                return ""
        n = min(size, HEAD_BYTES)
        return f"head:{n}:{self._head(name, n)}" if n else ""

    def _identities(self, sizes: dict[str, int]) -> dict[str, str]:
        """Each file's identity. One that a file had before stays while its first bytes do."""
        before = self.planned or {"files": {}, "ids": {}}
        found = {}
        for name, size in sizes.items():
            known = before["ids"].get(name, "")
            if known.startswith("head:") and (size == before.get("sizes", {}).get(name) or self._is(name, size, known)):
                found[name] = known
                continue
            own = self._identity(name, size)
            if own.startswith("head:"):
                # A renamed file: it goes by an identity that its old name has lost.
                lost = [i for n, i in before["ids"].items() if n not in sizes and i]
                own = next((i for i in lost if self._is(name, size, i)), own)
            found[name] = own
        return found

    def _starts(self, start: dict, end: dict) -> dict[str, int]:
        """Where each file of ``end`` is read from. A file that is known under any name goes on; others,
        and files that got shorter, are read from their start."""
        by_id = {i: start["files"][n] for n, i in start["ids"].items() if i and n in start["files"]}
        found = {}
        for name, size in end["files"].items():
            identity, old = end["ids"].get(name, ""), start["ids"].get(name, "")
            at = by_id.get(identity) if identity else start["files"].get(name, 0)
            if at is None and old.startswith("head:") and self._is(name, size, old):
                at = start["files"].get(name)  # the file was shorter when its identity was taken
            found[name] = at if at is not None and at <= size else 0
        return found

    # ---- what Spark asks for

    def initialOffset(self) -> dict:
        self.planned = None
        sizes = self._sizes()
        ids = self._identities(sizes)
        self.planned = {"files": sizes if self.from_end else {}, "ids": ids if self.from_end else {}}
        return self.planned

    def latestOffset(self) -> dict:
        """What a batch may read up to: the sizes now, within the bytes of one batch beyond the
        batch planned before."""
        sizes = self._sizes()
        ids, now = self._identities(sizes), dict(sizes)
        if self.planned is not None:
            starts = self._starts(self.planned, {"files": sizes, "ids": ids})
            left = self.per_batch
            # The least grown first: what a file does not need of its share goes to the others.
            for i, name in enumerate(sorted(sizes, key=lambda n: (sizes[n] - starts[n], n))):
                grown = min(sizes[name] - starts[name], left // (len(sizes) - i))
                sizes[name] = starts[name] + grown
                left -= grown
        offset = {"files": sizes, "ids": ids}
        if self.rule is not None:
            offset["opens"] = self._at_borders(sizes, ids, now)
        self.planned = {**offset, "sizes": now, "since": self._since(now)}
        self._remember()
        return offset

    def _since(self, now: dict[str, int]) -> dict[str, list]:
        """For each file its size and since when, in milliseconds, it has had it."""
        before, clock = (self.planned or {}).get("since", {}), int(time.time() * 1000)
        return {n: before[n] if before.get(n, [None])[0] == size else [size, clock] for n, size in now.items()}

    def _at_borders(self, sizes: dict[str, int], ids: dict[str, str], now: dict[str, int]) -> list[str]:
        """Move the ends in ``sizes`` to borders of records. Returns the files whose next line begins a
        record, whatever it is, as their open record was closed without a successor."""
        from skeinlog.sources.records import complete_end, last_border, next_border

        before = self.planned or {"files": {}, "ids": {}}
        starts, since = self._starts(before, {"files": now, "ids": ids}), self._since(now)
        store, base = store_of(self.root)
        opens = []
        for name, limit in sizes.items():
            at, whole = starts[name], limit == now[name]
            if at >= now[name]:
                sizes[name] = at
                opens += [name] if name in before.get("opens", ()) else []
                continue
            # What is left of a renamed file gets no successor; nor, by intention, what has rested long enough.
            renamed = name not in before["files"] and ids[name] in before["ids"].values()
            rested = self.flush_after and time.time() * 1000 - since[name][1] >= self.flush_after
            try:
                with store.open_input_file(f"{base}/{name}") as file:
                    end = last_border(file, at, limit, self.rule)
                    if end <= at and not whole:
                        end = next_border(file, at, limit, now[name], self.rule)
                    if whole and (renamed or rested):
                        flushed = complete_end(file, max(at, end), limit, self.rule.delimiter)
                        opens += [name] if flushed > end else []
                        end = max(end, flushed)
            except FileNotFoundError:
                end = at
            sizes[name] = end
            if end == at and name in before.get("opens", ()) and name not in opens:
                opens.append(name)
        return opens

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        if self.planned is None:
            self.planned = end
        ranges = []
        for name, at in self._starts(start, end).items():
            host, _, rest = name.partition("/")
            stop = end["files"][name]
            while at < stop:
                cut = min(at + self.per_task, stop)
                opens = at == start["files"].get(name) and name in start.get("opens", ())
                ranges.append(_Range(f"{self.root.rstrip('/')}/{name}", host, "/" + rest, at, cut, opens))
                at = cut
        return ranges

    def commit(self, end: dict) -> None:
        if self.planned is None:
            self.planned = end

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _read_lines(partition) if self.rule is None else _read_records(partition, self.rule)

    # ---- over a restart

    def _remember(self) -> None:
        if self.progress:
            store, base = store_of(self.progress)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/planned.new") as out:
                out.write(json.dumps(self.planned).encode())
            store.move(f"{base}/planned.new", f"{base}/planned")

    def _recalled(self) -> dict | None:
        if not self.progress:
            return None
        store, base = store_of(self.progress)
        try:
            with store.open_input_file(f"{base}/planned") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None


def line_rule(spec: dict):
    from skeinlog.sources.records import LineRule

    return LineRule(spec["pattern"], spec["negate"], spec["what"], spec["delimiter"].encode())


def _read_records(part: _Range, rule) -> Iterator[pa.RecordBatch]:
    """The records that begin in the range; all of them are closed before the batch ends."""
    from skeinlog.sources.records import read_range, record_batches

    store, path = store_of(part.file)
    try:
        file = store.open_input_file(path)
    except FileNotFoundError:
        return  # rotated away since the batch was planned
    with file:
        found = read_range(file, part.start, part.end, rule, opens=part.opens)
        yield from record_batches(found, part.host, part.path, part.start)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    store, base = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    return store, base.rstrip("/")


def _line_start(file, at: int) -> int:
    """The byte behind the last line end before ``at``."""
    while at > 0:
        low = max(0, at - (64 << 10))
        found = file.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def _read_lines(part: _Range) -> Iterator[pa.RecordBatch]:
    """Lines whose end lies in ``[start, end)``; ``mid`` is the byte a line starts at. ``blk`` is
    the start of the range, so the order columns work as in a batch scan."""
    store, path = store_of(part.file)
    try:
        file = store.open_input_file(path)
    except FileNotFoundError:
        return  # rotated away since the batch was planned
    with file:
        begin = at = _line_start(file, part.start)
        rest = b""
        while at < part.end:
            data = file.read_at(min(_BLOCK, part.end - at), at)
            if not data:
                return
            at += len(data)
            data = rest + data
            cut = data.rfind(b"\n") + 1
            rest = data[cut:]
            if cut:
                lines = data[: cut - 1].split(b"\n")
                raw = pa.array(lines, pa.binary())
                sizes = pc.add(pc.binary_length(raw).cast(pa.int64()), 1)
                ends = pc.cumulative_sum(sizes)
                starts = pc.add(pc.subtract(ends, sizes), begin)
                try:
                    text = raw.cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(part.host, n),
                        pa.repeat(part.path, n),
                        pa.repeat(pa.scalar(part.start, pa.int64()), n),
                        starts,
                        text,
                    ],
                    names=["host", "path", "blk", "mid", "value"],
                )
                begin += cut


def follow(spark: SparkSession, root: str, **options) -> DataFrame:
    """The streaming lines table below ``root``."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream.format(FORMAT)
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(root)
