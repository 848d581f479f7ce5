"""Globs, Python regular expressions and grok patterns as Java regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

# The grok macros and the expression each one stands for.
GROK_MACROS = {
    "DATA": ".+?",
    "GREEDYDATA": ".+",
    "WORD": r"\w+",
    "INT": r"\d+",
    "NOTSPACE": r"\S+",
}

# Java flags that give Python's meaning: U = Unicode classes, d = only \n ends a line.
_FLAGS = "(?Ud)"


def has_wildcard(text: str) -> bool:
    return "*" in text or "?" in text


def _char_class(body: str, negated: bool) -> str:
    safe = "".join(c if c.isalnum() or c in "-_" else "\\" + c for c in body)
    return f"[{'^' if negated else ''}{safe}]"


def _glob_tokens(glob: str):
    """Yield ('*' | '?' | 'class' | 'char', text, negated) for each glob element."""
    at = 0
    while at < len(glob):
        char = glob[at]
        if char in "*?":
            yield char, char, False
        elif char == "[":
            body_at = at + 1
            negated = body_at < len(glob) and glob[body_at] == "!"
            body_at += negated
            close = glob.find("]", body_at + 1)  # a ']' in first place is a member
            if close < 0:
                yield "char", char, False
            else:
                yield "class", glob[body_at:close], negated
                at = close
        else:
            yield "char", char, False
        at += 1


def value_glob(glob: str) -> str:
    """Whole-value wildcard: ``*`` and ``?`` cross every character, newlines included."""
    out = []
    for kind, text, negated in _glob_tokens(glob):
        if kind == "*":
            out.append(".*")
        elif kind == "?":
            out.append(".")
        elif kind == "class":
            out.append(_char_class(text, negated))
        else:
            out.append(re.escape(text))
    return r"(?s)\A" + "".join(out) + r"\z"


# One character of a file name, plain and inside a URI, where some are escaped.
_NAME_CHAR = "[^/]"
_URI_CHAR = "(?:%[C-F][0-9A-F](?:%[89AB][0-9A-F])+|%[0-7][0-9A-F]|[^/%])"


def _path_body(glob: str, any_char: str) -> str:
    out, at_segment_start = [], True
    for kind, text, negated in _glob_tokens(glob):
        if kind != "char" and at_segment_start:
            out.append(r"(?!\.)")
        if kind == "*":
            out.append("[^/]*")
        elif kind == "?":
            out.append(any_char)
        elif kind == "class":
            out.append("(?!/)" + _char_class(text, negated))
        else:
            out.append(re.escape(text))
        at_segment_start = kind == "char" and text == "/"
    return "".join(out)


def path_glob(glob: str) -> str:
    """Shell file glob: wildcards stop at ``/`` and skip names that start with a dot."""
    return r"\A" + _path_body(glob, _NAME_CHAR) + r"\z"


def uri_globs(globs: list[str], above: str) -> str:
    """The same for file URIs: any of the absolute globs, below one directory under ``above``."""
    body = "|".join(_path_body(glob, _URI_CHAR) for glob in globs)
    return re.escape(above) + f"/[^/]+(?:{body})" + r"\z"


@dataclass(frozen=True)
class JavaRegex:
    """A regular expression for Spark plus the group number of every named capture."""

    pattern: str
    names: dict[str, int]
    groups: int


def java_regex(python_pattern: str) -> JavaRegex:
    """Java takes no underscore in a group name, so named groups become plain ones; Python
    numbers both kinds alike, which keeps the positions valid."""
    compiled = re.compile(python_pattern)
    plain = re.sub(r"(?<!\\)\(\?P<\w+>", "(", python_pattern)
    plain = re.sub(
        r"(?<!\\)\(\?P=(\w+)\)", lambda m: f"(?:\\{compiled.groupindex[m.group(1)]})", plain
    )
    plain = plain.replace(r"\Z", r"\z")
    return JavaRegex(_FLAGS + plain, dict(compiled.groupindex), compiled.groups)


def grok_regex(pattern: str) -> JavaRegex:
    """``%{MACRO:name}`` becomes a named capture; the other text is a regular expression."""

    def capture(token: re.Match[str]) -> str:
        macro, name = token.groups()
        if macro not in GROK_MACROS:
            raise ValueError(f"unknown grok macro {macro!r} for {name!r}")
        return f"(?P<{name}>{GROK_MACROS[macro]})"

    return java_regex(re.sub(r"%\{(\w+):(\w+)\}", capture, pattern))
