"""Quality classification by regularised quadratic discriminant analysis.

A text becomes a short vector of transformed statistics (logarithms of counts, log-odds of shares).
Each class has a mean and a covariance over all its labelled texts; the covariance is shrunk
towards the classes' common one and towards a multiple of the identity. The log density of a class
is read off the Mahalanobis length through its Cholesky factor, which is computed once and travels
with the job. The score is the logistic function of the difference of the two log densities and
priors, divided by ``TEMPER``, as the statistics are less independent than Gaussians assume.

Sums of the statistics and their products are added up per task and class, then over all tasks, so
that nothing that grows with the rows reaches the driver or one task. Each text is read once.

Defined results: a null or empty text has the statistics of an empty text and gets a score. With
one class among the labels every score is that class; with none every score is 0.5. Labels that
are neither 0 nor 1 do not count; a document labelled twice counts for both. Only doc_id and text are
read, and the result has its own columns only.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.common import arrow_step, crc32_fold

COMMON, IDENTITY, TEMPER, THRESHOLD = 0.1, 0.02, 2.0, 0.3
# Kinds of characters.
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _OTHER = range(7)
_KINDS = 7
STATISTICS = 16


def kind_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for point in range(len(table)):
        c = chr(point)
        if c.isspace():
            table[point] = _SPACE
        elif c in ".,;:?":
            table[point] = _STOP
        else:
            category = unicodedata.category(c)
            if category == "Lu":
                table[point] = _UPPER
            elif category[0] == "L":
                table[point] = _LOWER
            elif category[0] == "N":
                table[point] = _DIGIT
            elif category[0] in "PS":
                table[point] = _SYMBOL
    return table


def statistics(text: str | None, kinds: np.ndarray) -> list[float]:
    """The text's vector; every entry is finite for every text."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds[codes]
    n = len(codes)
    count = np.bincount(kind, minlength=_KINDS)
    words = text.split()
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [line for line in text.split("\n") if line]
    same = kind[1:] == kind[:-1]
    after_letter = (kind[:-1] <= _UPPER) if n else np.zeros(0, bool)
    doubled = (codes[1:] == codes[:-1]) & (kind[1:] >= _STOP) if n else np.zeros(0, bool)

    def odds(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))

    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        odds(count[_UPPER], count[_UPPER] + count[_LOWER]),
        odds(count[_DIGIT], n),
        odds(count[_STOP], n),
        odds(count[_SYMBOL], n),
        odds(count[_OTHER], n),
        odds(count[_SPACE], n),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        odds(len(set(words)), len(words)),
        float(np.log1p(len(lines))),
        odds(len(set(lines)), len(lines)),
        odds(int(doubled.sum()), n),
        odds(int((after_letter & (kind[1:] == _SYMBOL)).sum()) if n else 0, len(words)),
        odds(int(same.sum()), n),
    ]


class Discriminant:
    """Means, Cholesky factors and log weights of the classes."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        """moments: for a class the number of rows, the sums and the sums of products."""
        self.classes = sorted(moments)
        total = sum(n for n, _, _ in moments.values())
        spread = {c: products - np.outer(sums, sums) / n for c, (n, sums, products) in moments.items()}
        common = sum(spread.values()) / total if moments else None
        self.parts = []
        for c in self.classes:
            n, sums, _ = moments[c]
            mixed = (1 - COMMON) * spread[c] / n + COMMON * common
            # Shrinking towards the common variances keeps every factor regular, also for one row.
            scale = np.diag(np.maximum(np.diag(common), 1e-3))
            factor = np.linalg.cholesky((1 - IDENTITY) * mixed + IDENTITY * scale)
            weight = np.log(n / total) - np.log(np.diag(factor)).sum()
            self.parts.append((sums / n, np.linalg.inv(factor), weight))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(rows), float(self.classes[0]) if self.classes else 0.5)
        logs = [w - 0.5 * (((rows - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, w in self.parts]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / TEMPER, -500, 500)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics), a row for each row of docs. All that follows reads these few numbers,
    and no text moves."""
    shared = docs.sparkSession.sparkContext.broadcast(kind_table())  # a byte for each code point

    def step(batches):
        for batch in batches:
            rows = [statistics(t, shared.value) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "statistics": rows}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_step(rows, step, "doc_id long, statistics array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def train(labelled: DataFrame) -> Discriminant:
    """labelled: columns statistics and quality."""

    def step(batches):
        sums = np.zeros((2, 1 + STATISTICS + STATISTICS * STATISTICS))
        for batch in batches:
            rows, marks = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for quality in (0, 1):
                own = rows[marks == quality]
                sums[quality] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for quality in (0, 1):
            if sums[quality, 0]:
                n = sums.shape[1]
                yield {"quality": [quality] * n, "place": list(range(n)), "value": sums[quality]}

    rows = labelled.where("quality in (0, 1)").select("statistics", F.col("quality").cast("int"))
    partial = arrow_step(rows, step, "quality int, place int, value double")
    found = partial.groupBy("quality", "place").agg(F.sum("value").alias("value")).collect()
    moments = {}
    for c in {r.quality for r in found}:
        values = np.zeros(1 + STATISTICS + STATISTICS * STATISTICS)
        for r in found:
            if r.quality == c:
                values[r.place] = r.value
        products = values[1 + STATISTICS :].reshape(STATISTICS, STATISTICS)
        moments[c] = (int(values[0]), values[1 : 1 + STATISTICS], products)
    return Discriminant(moments)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(statistics, quality) of documents that are not held out."""
    return with_labels(measured(docs), labels)


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The same of measured rows."""
    ours = rows.where("doc_id is not null").where(crc32_fold(F.col("doc_id")) != 0)
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    return ours.join(marks, F.col("doc_id") == F.col("_id")).select("statistics", "quality")


def rate(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of docs."""
    return rate_measured(measured(docs), model, threshold)


def rate_measured(rows: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The same of measured rows."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))  # two small matrices

    def step(batches):
        model = Discriminant.__new__(Discriminant)
        model.__dict__.update(shared.value)
        for batch in batches:
            scores = model.scores(_matrix(batch.column(1)))
            yield {"doc_id": batch.column(0), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    return arrow_step(rows.select("doc_id", "statistics"), step, "doc_id long, score double, predicted int")
