"""Which fields events have: names, type families, datasets, hosts, coverage and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.instants import SECONDS_SHAPE, iso_text
from skeinlog.functions.variants import as_array, as_object, bind, brackets
from skeinlog.operators.predicates import RESERVED

# Fixed value: records are opened so often before their depth is measured.
_SHALLOW = 4

_LEAVES = "array<struct<field:string,v:variant,kind:string>>"


def _leaf(field, value: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(
        name.alias("field"), value.alias("v"), F.schema_of_variant(value).alias("kind")
    )


def _text_leaf(field, text: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    kind = F.when(text.isNull(), "VOID").otherwise("STRING")
    return F.struct(name.alias("field"), text.cast("variant").alias("v"), kind.alias("kind"))


def _envelope_leaves() -> Column:
    texts = {
        "@timestamp": iso_text(F.col("`@timestamp`")),
        "message": F.col("message"),
        "event.dataset": F.col("event.dataset"),
        "event.created": iso_text(F.col("event.created")),
        "host.name": F.col("host.name"),
        "agent.type": F.col("agent.type"),
        "agent.version": F.col("agent.version"),
        "log.file.path": F.col("log.file.path"),
        "ecs.version": F.col("ecs.version"),
    }
    labels = F.transform(
        F.map_entries("labels"),
        lambda e: _text_leaf(F.concat(F.lit("labels."), e["key"]), e["value"]),
    )
    tags = F.transform(F.col("tags"), lambda tag: _text_leaf("tags", tag))
    fixed = F.array(*[_text_leaf(name, text) for name, text in texts.items()])
    return F.concat(fixed, labels, F.coalesce(tags, F.array().cast(_LEAVES)))


def _is_object(leaf: Column) -> Column:
    return leaf["kind"].startswith("OBJECT")


def _is_list(leaf: Column) -> Column:
    return leaf["kind"].startswith("ARRAY")


def _one_down(leaves: Column) -> Column:
    """Objects become their members, lists their elements under the same name."""

    def opened(leaf: Column) -> Column:
        members = F.transform(
            F.map_entries(as_object(leaf["v"])),
            lambda e: _leaf(F.concat(leaf["field"], F.lit("."), e["key"]), e["value"]),
        )
        elements = F.transform(as_array(leaf["v"]), lambda v: _leaf(leaf["field"], v))
        return F.when(_is_object(leaf), members).when(_is_list(leaf), elements).otherwise(F.array(leaf))

    return F.flatten(F.transform(leaves, opened))


def body_leaves(body: Column, max_depth: int | None, reserved: tuple[str, ...] = RESERVED) -> Column:
    """The leaves of a body. The steps down are one loop inside the expression, which does
    nothing more once no object or list is left; without ``max_depth`` it is as long as the record
    needs."""

    def state(leaves: Column) -> Column:
        more = F.exists(leaves, lambda x: _is_object(x) | _is_list(x))
        return F.struct(leaves.alias("leaves"), more.alias("more"))

    top = F.transform(
        F.map_entries(F.map_filter(as_object(body), lambda k, _: ~k.isin(*reserved, ""))),
        lambda e: _leaf(e["key"], e["value"]),
    ).cast(_LEAVES)

    def down(acc: Column, _: Column) -> Column:
        return F.when(acc["more"], state(_one_down(acc["leaves"]).cast(_LEAVES))).otherwise(acc)

    steps = _SHALLOW if max_depth is None else max_depth
    reached = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(top), down)
    if max_depth is not None:
        return reached["leaves"]

    def rest(acc: Column) -> Column:
        # Only a deep record has its brackets counted: no nesting goes deeper.
        return F.aggregate(F.sequence(F.lit(1), brackets(body)), acc, down, lambda end: end["leaves"])

    # A one-element array, so that the first steps are made once.
    return F.flatten(F.transform(F.array(reached), lambda acc: F.when(acc["more"], rest(acc)).otherwise(acc["leaves"])))


def family(value: Column, kind: Column) -> Column:
    """The type family of a leaf value, as field capabilities name it. A value that still is an
    object or a list lies deeper than the flattening went, which must not pass unseen."""
    text = F.try_variant_get(value, "$", "string")
    too_deep = F.raise_error("a record is nested deeper than max_depth; raise max_depth")
    return (
        F.when((kind == "STRING") & text.rlike(rf"\A{SECONDS_SHAPE}"), "date")
        .when(kind == "STRING", "keyword")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "long")
        .when(kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), "double")
        .when(kind.rlike("^(?:OBJECT|ARRAY)"), too_deep)
        .otherwise("keyword")
    )


def leaves(events: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row per leaf value: ``dataset, host, field, family, json, first`` where ``first`` marks
    the first value of a field in its event. Nulls are left out, as ``exists`` does. One pass over
    the events, no shuffle."""
    everything = F.concat(
        _envelope_leaves(),
        F.coalesce(body_leaves(F.col("body"), max_depth), F.array().cast(_LEAVES)),
    )
    narrow = bind(
        events.select(
            "*", F.col("event.dataset").alias("dataset"), F.col("host.name").alias("_host")
        ),
        "_leaves",
        F.filter(everything, lambda x: x["kind"] != "VOID"),
    )
    numbered = F.transform(
        F.col("_leaves"),
        lambda x, i: F.struct(
            x["field"].alias("field"),
            x["v"].alias("v"),
            x["kind"].alias("kind"),
            (F.array_position(F.col("_leaves.field"), x["field"]) == i + 1).alias("first"),
        ),
    )
    return narrow.select("dataset", F.col("_host").alias("host"), F.inline(numbered)).select(
        "dataset",
        "host",
        "field",
        family(F.col("v"), F.col("kind")).alias("family"),
        F.to_json("v").alias("json"),
        "first",
    )


def count_fields(entries: DataFrame) -> DataFrame:
    """The catalog: ``field, family, dataset, host, n, docs``. ``n`` counts values, ``docs``
    counts a field's events at the family its first value has. See ``operators.summary``."""
    return entries.select("field", "family", "dataset", "host", "n", "docs")


def count_leaves(leaf_rows: DataFrame) -> DataFrame:
    """The catalog from a row for each value. Partial sums shrink the rows to the number of fields
    before the shuffle."""
    return leaf_rows.groupBy("field", "family", "dataset", "host").agg(
        F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("docs")
    )


def docs_per_dataset(catalog: DataFrame) -> DataFrame:
    """Every event has one ``event.dataset``, so its count is the number of events."""
    return (
        catalog.where("field = 'event.dataset'")
        .groupBy("dataset")
        .agg(F.sum("n").alias("dataset_docs"))
    )


def field_types(catalog: DataFrame) -> DataFrame:
    """``field, family, datasets, hosts, n`` with sorted lists."""
    return catalog.groupBy("field", "family").agg(
        F.array_sort(F.collect_set("dataset")).alias("datasets"),
        F.array_sort(F.collect_set("host")).alias("hosts"),
        F.sum("n").alias("n"),
    )


def coverage(catalog: DataFrame) -> DataFrame:
    """``coverage``: values per event of the datasets that have the field (list elements count
    one by one, so it can exceed 1). ``doc_coverage``: the share of those events with the field."""
    per_dataset = catalog.groupBy("field", "dataset").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    return (
        per_dataset.join(docs_per_dataset(catalog), "dataset")
        .groupBy("field")
        .agg(
            F.round(F.sum("n") / F.sum("dataset_docs"), 4).alias("coverage"),
            F.round(F.sum("docs") / F.sum("dataset_docs"), 4).alias("doc_coverage"),
        )
    )


def host_drift(catalog: DataFrame, sampled_hosts: DataFrame | None = None) -> DataFrame:
    """Fields not seen on every sampled host. ``sampled_hosts`` (column host) may add hosts that
    were reached but gave no event."""
    hosts = catalog.select("host")
    if sampled_hosts is not None:
        hosts = hosts.unionByName(sampled_hosts.select("host"))
    total = hosts.agg(F.count_distinct("host").alias("hosts")).select("hosts")
    seen = catalog.groupBy("field").agg(
        F.array_sort(F.collect_set("host")).alias("hosts"),
        F.count_distinct("host").alias("n_hosts"),
    )
    return seen.where(F.col("n_hosts") < total.scalar()).select("field", "hosts")


# ---------------------------------------------------------------- report


def field_table(catalog: DataFrame, example_rows: DataFrame, sampled_hosts: DataFrame | None = None) -> DataFrame:
    """The report as a row for each field: ``field, families, coverage, doc_coverage, examples, drifts``.
    A family has its datasets unless the field has one family and that is in every dataset."""
    types = field_types(catalog).select("field", F.struct("family", "datasets").alias("f"))
    types = types.groupBy("field").agg(F.array_sort(F.collect_list("f")).alias("families"))  # six at most
    drift = host_drift(catalog, sampled_hosts).select("field", F.lit(True).alias("drifts"))
    uniform = (F.size("families") == 1) & (F.col("families")[0]["datasets"] == _datasets(catalog).scalar())
    types = types.withColumn("uniform", uniform)
    named = F.transform("families", lambda f: F.struct(f["family"], F.when(~F.col("uniform"), f["datasets"]).alias("datasets")))
    rows = types.join(coverage(catalog), "field").join(example_rows, "field", "left").join(drift, "field", "left")
    return rows.select(
        "field", named.alias("families"), "coverage", "doc_coverage", "examples", F.coalesce("drifts", F.lit(False)).alias("drifts")
    )


def _datasets(catalog: DataFrame) -> DataFrame:
    return docs_per_dataset(catalog).agg(F.array_sort(F.collect_list("dataset")).alias("datasets"))


def _capabilities() -> Column:
    return F.map_from_entries(
        F.transform(
            "families",
            lambda f: F.struct(
                f["family"],
                F.struct(
                    F.lit(False).alias("metadata_field"),
                    F.lit(True).alias("searchable"),
                    F.lit(False).alias("aggregatable"),
                    f["datasets"].alias("indices"),
                ),
            ),
        )
    )


def _values(texts: Column) -> Column:
    return F.transform(texts, lambda text: F.parse_json(text))


def field_lines(table: DataFrame) -> DataFrame:
    """The report as a JSON line for each field, by name, however many fields there are."""
    line = F.struct(
        "field", _capabilities().alias("capabilities"), "coverage", "doc_coverage",
        _values(F.col("examples")).alias("examples"), F.col("drifts").alias("host_conflict"),
    )
    return table.orderBy("field").select(F.to_json(line).alias("value"))


def field_caps(
    catalog: DataFrame, example_rows: DataFrame, sampled_hosts: DataFrame | None = None
) -> DataFrame:
    """One row with column ``value``: the field-capabilities report as one JSON object, which is made in
    one task. :func:`field_lines` has the same for any number of fields."""
    hosts = catalog.select("host")
    if sampled_hosts is not None:
        hosts = hosts.unionByName(sampled_hosts.select("host"))
    host_row = hosts.agg(F.array_sort(F.collect_set("host")).alias("hosts"))
    docs = docs_per_dataset(catalog).agg(F.sum("dataset_docs").alias("docs"))
    rows = field_table(catalog, example_rows, sampled_hosts).withColumn("caps", _capabilities())

    def by_field(column: str) -> Column:
        pairs = F.collect_list(F.struct("field", column))
        in_order = lambda a, b: F.when(a["field"] < b["field"], -1).otherwise(1)
        return F.map_from_entries(F.array_sort(pairs, in_order))

    shown = F.transform(
        F.array_sort(F.collect_list(F.struct("field", "examples"))), lambda e: F.struct(e["field"], _values(e["examples"]))
    )
    report = rows.agg(
        by_field("caps").alias("fields"),
        by_field("coverage").alias("coverage"),
        by_field("doc_coverage").alias("doc_coverage"),
        F.map_from_entries(shown).alias("examples"),
        F.array_sort(F.collect_list(F.when(F.col("drifts"), F.col("field")))).alias("conflicts"),
    )
    return report.select(
        F.to_json(
            F.struct(
                _datasets(catalog).scalar().alias("indices"),
                "fields",
                F.struct(
                    docs.scalar().alias("docs_sampled"),
                    host_row.scalar().alias("hosts"),
                    "coverage",
                    "doc_coverage",
                    "examples",
                    F.col("conflicts").alias("host_conflicts"),
                ).alias("sample"),
            )
        ).alias("value")
    )
