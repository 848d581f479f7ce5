"""Take apart the ordered output of one follower over several files.

The follower prints ``==> path <==`` when its output switches files, with one blank line in front
of every header but the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.operators.carry import CHUNK, carry_forward

_HEADER = r"(?d)\A==> (.*) <==\z"


def demux(captures: DataFrame, known: list[str]) -> DataFrame:
    """Lines of the single files from a lines table whose ``path`` names the capture.

    Only a header of a ``known`` file switches; a log line that merely looks like one is content.
    Lines before any header belong to the first known file. The column ``file`` names the file.
    The work is split as in :func:`carry_forward`.
    """
    named = F.regexp_extract("value", _HEADER, 1)
    header = F.when(F.col("value").rlike(_HEADER) & named.isin(*known), named)
    lines = carry_forward(captures.select(*CHUNK, "mid", "value"), header)
    separator = (F.col("value") == "") & F.col("_next_marked")
    return lines.where(F.col("_mark").isNull() & ~separator).select(
        *CHUNK, "mid", F.coalesce("_current", F.lit(known[0])).alias("file"), "value"
    )
