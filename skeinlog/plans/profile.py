"""The job description: which hosts, which files, how to frame them and what to extract."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any, NoReturn

from skeinlog.functions.instants import java_date_pattern
from skeinlog.functions.patterns import grok_regex, java_regex

# The accepted option words.
CODECS = ("plain", "json", "multiline")
JOINS = ("previous", "next")
STARTS = ("beginning", "end")

_CONDITION = re.compile(r"""\s*(?P<refs>(?:\[\w+\])+)\s*==\s*(?P<q>['"])(?P<value>.*?)(?P=q)\s*""")
_FILE_GLOB = re.compile(r"[A-Za-z0-9._*?/\[\]-]+")


class ProfileError(ValueError):
    """The job description is wrong; the message names the place."""


@dataclass(frozen=True)
class Framing:
    """How lines become records."""

    codec: str = "plain"
    delimiter: str = "\n"
    pattern: str | None = None
    negate: bool = False
    what: str = "previous"


@dataclass(frozen=True)
class EventTime:
    """Where the event time comes from; all None means automatic detection."""

    field: str | None = None
    pattern: str | None = None
    format: str | None = None

    @property
    def automatic(self) -> bool:
        return self.field is None and self.pattern is None


@dataclass(frozen=True)
class LogInput:
    """One set of files with one framing; its ``type`` is the dataset name."""

    type: str
    path: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    framing: Framing = Framing()
    tags: tuple[str, ...] = ()
    time: EventTime = EventTime()
    start_position: str = "end"


@dataclass(frozen=True)
class LabelFilter:
    """Captures from a source (path, message or ``[a][b]``) into labels, under a condition."""

    grok: tuple[tuple[str, str], ...] = ()
    condition: str | None = None

    def condition_parts(self) -> tuple[list[str], str] | None:
        if self.condition is None:
            return None
        found = _CONDITION.fullmatch(self.condition)
        if not found:
            raise ProfileError(f"filter condition must be [field] == \"value\": {self.condition!r}")
        return field_refs(found["refs"]), found["value"]


@dataclass(frozen=True)
class Profile:
    name: str
    hosts: tuple[str, ...] = ()
    inputs: tuple[LogInput, ...] = ()
    base_dir: str = "."
    filters: tuple[LabelFilter, ...] = field(default=())

    def input(self, type_: str) -> LogInput:
        for item in self.inputs:
            if item.type == type_:
                return item
        raise ProfileError(f"profile {self.name!r} has no input of type {type_!r}")

    def scope(self, type_: str | None = None, hosts: Any = None) -> Profile:
        """Only the named host(s) and input type. An unknown name is an error, never an empty
        result. Hosts may be one text with commas or a list of such texts."""
        inputs = self.inputs
        if type_ is not None:
            inputs = tuple(i for i in self.inputs if i.type == type_)
            if not inputs:
                self.input(type_)
        kept = self.hosts
        if hosts is not None:
            texts = [hosts] if isinstance(hosts, str) else list(hosts)
            named = [name.strip() for text in texts for name in text.split(",") if name.strip()]
            if named:
                unknown = sorted(set(named) - set(self.hosts))
                if unknown:
                    raise ProfileError(f"profile {self.name!r} has no host {', '.join(unknown)}")
                kept = tuple(h for h in self.hosts if h in named)
        return Profile(self.name, kept, inputs, self.base_dir, self.filters)


def field_refs(text: str) -> list[str]:
    """``[a][b]`` as ['a', 'b']."""
    return re.findall(r"\[(\w+)\]", text)


# ---------------------------------------------------------------- reading job descriptions

# A reader takes a loaded value and the name of its place and returns what it stands for. Small
# readers are put together to those of whole mappings.
Reader = Callable[[Any, str], Any]


@dataclass(frozen=True)
class Option:
    """One key of a mapping. Without it, or with null, ``default`` is read instead; a key without a
    default has to be there."""

    reader: Reader
    default: Any = None
    needed: bool = False


def fail(place: str, problem: str) -> NoReturn:
    raise ProfileError(f"{place}: {problem}")


def text(value: Any, place: str) -> str:
    return value if isinstance(value, str) and value else fail(place, f"a text is needed, not {value!r}")


def switch(value: Any, place: str) -> bool:
    return bool(value)


def word(*allowed: str) -> Reader:
    return lambda value, place: value if value in allowed else fail(place, f"{value!r} is none of {', '.join(allowed)}")


def fits(reader: Reader, test: Callable[[Any], Any], problem: str = "") -> Reader:
    """The reader, for values that pass the test: one that returns false or raises ValueError fails."""

    def read(value: Any, place: str) -> Any:
        found = reader(value, place)
        try:
            passed = test(found)
        except (ValueError, re.error) as error:
            fail(place, f"{found!r}: {error}")
        return found if passed else fail(place, f"{problem}: {found!r}")

    return read


def each(reader: Reader, single: bool = False) -> Reader:
    """A list; with ``single`` one value may stand for a list of it."""

    def read(value: Any, place: str) -> tuple:
        items = [value] if single and isinstance(value, str) else value
        if not isinstance(items, list):
            fail(place, "a list is needed")
        return tuple(reader(item, f"{place}[{i}]") for i, item in enumerate(items))

    return read


def entries(key: Reader, value: Reader) -> Reader:
    """A mapping of any keys, as pairs."""

    def read(spec: Any, place: str) -> tuple:
        return tuple((key(k, place), value(v, f"{place}.{k}")) for k, v in _keys(spec, place).items())

    return read


def record(make: Callable, options: dict[str, Option], closed: bool = False) -> Reader:
    """A mapping of known keys, given to ``make`` by name. Other keys are an error if ``closed``."""

    def read(spec: Any, place: str) -> Any:
        given = _keys(spec, place)
        unknown = [str(k) for k in given if k not in options]
        if closed and unknown:
            fail(place, f"unknown: {', '.join(unknown)}; there are {', '.join(options)}")
        found = {}
        for key, option in options.items():
            value = given.get(key)
            if value is None and option.needed:
                fail(place, f"{key} is missing")
            value = option.default if value is None else value
            found[key] = None if value is None else option.reader(value, f"{place}.{key}")
        try:
            return make(**found)
        except (ValueError, re.error) as error:
            return fail(place, str(error))

    return read


def either(test: Callable[[Any], bool], first: Reader, second: Reader) -> Reader:
    return lambda value, place: (first if test(value) else second)(value, place)


def _keys(spec: Any, place: str) -> dict:
    return spec if isinstance(spec, dict) else fail(place, "a mapping is needed")


def _is_text(value: Any) -> bool:
    return isinstance(value, str)


def _time(field: str | None, pattern: str | None, format: str | None) -> EventTime:
    if (pattern is None) != (format is None):
        raise ValueError("pattern and format belong together")
    if field is not None and pattern is not None:
        raise ValueError("the time is either a field or a pattern with format")
    return EventTime(field, pattern, format)


def _input(codec: Framing, timestamp: EventTime | None, path: tuple[str, ...], **rest: Any) -> LogInput:
    if not path:
        raise ValueError("at least one path glob is needed")
    return LogInput(path=path, framing=codec, time=timestamp or EventTime(), **rest)


def _filter(grok: tuple[tuple[str, str], ...], **rest: Any) -> LabelFilter:
    made = LabelFilter(grok, rest["if"])
    made.condition_parts()
    return made


# A broken expression is an error here, not in a task.
_REGEX = fits(text, lambda p: java_regex(p) is not None)
_GROK = fits(text, lambda p: grok_regex(p) is not None)
_FORMAT = fits(text, lambda f: java_date_pattern(f) is not None)
_GLOB = fits(text, _FILE_GLOB.fullmatch, "a path glob has characters that are not allowed")
_HOST_NAME = fits(text, re.compile(r"[A-Za-z0-9._:-]+").fullmatch, "not a host name")

_DELIMITER = {"delimiter": Option(text, "\n")}
_JOIN = {"pattern": Option(_REGEX, needed=True), "negate": Option(switch, False), "what": Option(word(*JOINS), "previous")}
_CODEC = {
    name: record(partial(Framing, name), _DELIMITER | (_JOIN if name == "multiline" else {})) for name in CODECS
}


def _codec(spec: Any, place: str) -> Framing:
    """A codec by name, or as a mapping of the name to its options."""
    named = {spec: {}} if isinstance(spec, str) else _keys(spec, place)
    if len(named) != 1:
        fail(place, "exactly one codec is needed")
    [(name, options)] = named.items()
    return _CODEC[word(*CODECS)(name, place)](options or {}, f"{place}.{name}")


_TIME = record(_time, {"field": Option(text), "pattern": Option(_REGEX), "format": Option(_FORMAT)}, closed=True)
_INPUT = record(
    _input,
    {
        "type": Option(text, needed=True),
        "path": Option(each(_GLOB, single=True), needed=True),
        "exclude": Option(each(text, single=True), []),
        "codec": Option(_codec, "plain"),
        "tags": Option(each(text, single=True), []),
        "timestamp": Option(_TIME),
        "start_position": Option(word(*STARTS), "end"),
    },
)
_FILTER = record(_filter, {"grok": Option(entries(text, _GROK), {}), "if": Option(text)})
# A host is a name or a mapping; how to log in to it is no concern of these jobs.
_HOST = either(_is_text, _HOST_NAME, record(lambda host: host, {"host": Option(_HOST_NAME, needed=True)}))
_PROFILE = {
    "hosts": Option(each(_HOST), needed=True),
    "inputs": Option(each(_INPUT), needed=True),
    "base_dir": Option(lambda value, place: text(value or ".", place), "."),
    "filters": Option(each(_FILTER), []),
}


def profile_from_dict(name: str, spec: dict[str, Any]) -> Profile:
    """Check a loaded profile mapping and build the job description."""
    return record(partial(Profile, name), _PROFILE)(spec, f"profile {name!r}")


def profiles_from_dict(config: dict[str, Any]) -> dict[str, Profile]:
    """All profiles of a loaded configuration, by name."""
    [found] = record(lambda profiles: [profiles], {"profiles": Option(_keys, needed=True)})(config, "configuration")
    if not found:
        fail("configuration", "no profiles")
    return {name: profile_from_dict(name, spec) for name, spec in found.items()}
