"""Reading and rendering event times."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of a written time.
ZONE = r"(?:Z|[+-]\d{2}(?::?\d{2})?)"
SECONDS_SHAPE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
ISO_FULL = rf"\A{SECONDS_SHAPE}(?:\.\d+)?{ZONE}?\z"
ISO_MINUTE = rf"\A\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}{ZONE}?\z"
ISO_DATE = r"\A\d{4}-\d{2}-\d{2}\z"
# A text line that leads with a time: comma or dot before the fraction, which is required.
LEADING_TIME = rf"\A(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}[.,]\d+(?:Z|[+-]\d{{2}}:?\d{{2}})?)"
_HAS_ZONE = rf"{ZONE}\z"
# The usual form, which needs no rewriting before it is read.
_USUAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"

# Strptime directive -> (letter, width) of the Java date pattern.
STRPTIME_LETTERS = {
    "d": ("d", 2),
    "H": ("H", 2),
    "I": ("h", 2),
    "M": ("m", 2),
    "S": ("s", 2),
    "m": ("M", 2),
    "j": ("D", 3),
}
# Directives that have one Java spelling.
STRPTIME_WORDS = {"b": "MMM", "B": "MMMM", "Y": "yyyy", "y": "yy", "f": "SSSSSS", "p": "a"}


def _dotted(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit("."))


def _zoned(text: Column) -> Column:
    """A time without a zone is UTC, whatever the session's zone is. A date is ten characters,
    so a zone sign can only stand behind it."""
    return F.when(F.substr(text, F.lit(11)).rlike(_HAS_ZONE), text).otherwise(
        F.concat(text, F.lit("Z"))
    )


def iso_instant(text: Column) -> Column:
    """A full ISO date-time as TIMESTAMP, anything else NULL."""
    dotted = _dotted(text)
    return F.when(text.rlike(_USUAL), F.try_to_timestamp(text)).when(
        dotted.rlike(ISO_FULL), F.try_to_timestamp(_zoned(dotted))
    )


def iso_time(text: Column) -> Column:
    """Like :func:`iso_instant`, and also minutes without seconds and bare dates."""
    dotted = _dotted(text)
    minute = F.regexp_replace(dotted, r"\A(.{16})", "$1:00")
    return (
        F.when(text.rlike(_USUAL), F.try_to_timestamp(text))
        .when(dotted.rlike(ISO_FULL), F.try_to_timestamp(_zoned(dotted)))
        .when(dotted.rlike(ISO_DATE), F.try_to_timestamp(F.concat(dotted, F.lit("T00:00:00Z"))))
        .when(dotted.rlike(ISO_MINUTE), F.try_to_timestamp(_zoned(minute)))
    )


def leading_time(message: Column) -> Column:
    return iso_instant(F.regexp_extract(message, LEADING_TIME, 1))


def iso_text(ts: Column) -> Column:
    """ISO text in UTC; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    )


def parse_bound(text: str) -> datetime | None:
    """The instant of a full ISO bound in a query, or None."""
    dotted = text.strip().replace(",", ".")
    if not re.match(ISO_FULL.replace(r"\z", r"\Z"), dotted):
        return None
    try:
        at = datetime.fromisoformat(dotted)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def java_date_pattern(fmt: str) -> tuple[str, bool]:
    """A strptime format as a Java date pattern, with ``@@`` in the place of the zone, and
    whether it has a zone. A directive Spark cannot parse is an error."""
    out, zoned, at = [], False, 0
    while at < len(fmt):
        char = fmt[at]
        if char != "%":
            out.append(f"'{char}'" if char.isalpha() or char in "[]{}#" else char.replace("'", "''"))
            at += 1
            continue
        name = fmt[at + 1 : at + 2]
        at += 2
        if name in STRPTIME_LETTERS:
            letter, width = STRPTIME_LETTERS[name]
            # Digits directly beside digits need a fixed width; otherwise one digit will do too.
            beside = fmt[at : at + 1] == "%" or (at > 3 and fmt[at - 4] == "%")
            out.append(letter * (width if beside else 1))
        elif name in STRPTIME_WORDS:
            out.append(STRPTIME_WORDS[name])
        elif name == "z":
            out.append("@@")
            zoned = True
        elif name == "%":
            out.append("%")
        else:
            raise ValueError(f"time format directive %{name} cannot be parsed by Spark: {fmt!r}")
    return "".join(out), zoned


def formatted_time(text: Column, fmt: str) -> Column:
    """A time written in a declared strptime format; no zone means UTC."""
    pattern, zoned = java_date_pattern(fmt)
    trimmed = F.trim(text)
    if zoned:
        spellings = [pattern.replace("@@", zone) for zone in ("Z", "XXX", "XX")]
        parsed = F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(p)) for p in spellings])
    else:
        parsed = F.try_to_timestamp(F.concat(trimmed, F.lit(" +0000")), F.lit(pattern + " Z"))
    if "%y" in fmt:  # two-digit years 69-99 belong to the last century
        parsed = F.when(F.year(parsed) >= 2069, parsed - F.expr("interval 100 years")).otherwise(parsed)
    return parsed
