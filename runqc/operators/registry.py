"""Experiment registry: search, diff, apply, dedup, completeness, validation, events."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runqc.functions.common import is_present, messages

# Counters compared between a discovered run and the registry.
COUNTERS = ["pod5_files", "fast5_files", "fastq_files", "bam_files"]

# Completeness weights by field.
COMPLETENESS = [  # field, weight, kind
    ("id", 10, "string"),
    ("name", 10, "string"),
    ("source", 10, "string"),
    ("sample", 15, "string"),
    ("device_type", 8, "string"),
    ("flowcell_type", 7, "string"),
    ("chemistry", 10, "string"),
    ("basecall_model", 10, "string"),
    ("flowcell_id", 5, "string"),
    ("sampled", 10, "number"),
    ("mean_qscore", 8, "number"),
    ("n50", 7, "number"),
]

# Accepted sources and the identifier format.
SOURCES = ["local", "ont-open-data", "sra", "ena"]
PUBLIC_SOURCE = "ont-open-data"
ID_FORMAT = r"^exp-[a-f0-9]{8}$"


# -- search -------------------------------------------------------------------

def search_document(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive match anywhere in the row rendered as JSON."""
    return df.where(F.lower(F.to_json(F.struct(*df.columns))).contains(text.lower()))


def search_fields(df: DataFrame, text: str, fields: Sequence[str]) -> DataFrame:
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f).cast("string")).contains(text.lower()), F.lit(False))
    return df.where(hit)


def search_exact(df: DataFrame, **fields) -> DataFrame:
    """Conjunction of equalities; a field given as None does not filter."""
    for name, value in fields.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def find_by_id(df: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """Exact id, else a partial match when it is the only one."""
    hits = df.where(F.col(id_col).contains(text)).withColumn("_exact", (F.col(id_col) == text).cast("int"))
    # Two rows settle whether the match is unique.
    best = hits.orderBy(F.desc("_exact"), id_col).limit(2)
    marks = best.agg(F.max("_exact").alias("e"), F.count("*").alias("n"))
    s = marks.select(F.struct("e", "n")).scalar()
    return best.where(F.when(s["e"] == 1, F.col("_exact") == 1).otherwise(s["n"] == 1)).drop("_exact")


def listing(df: DataFrame, status: str | None = None, tag: str | None = None, source: str | None = None) -> DataFrame:
    df = search_exact(df, status=status, source=source)
    return df if tag is None else df.where(F.array_contains("tags", tag))


def batch(
    df: DataFrame, incomplete: bool = False, unanalysed: bool = False, source: str | None = None, limit: int | None = None,
    analyses: str = "analyses", id_col: str = "id",
) -> DataFrame:
    """Experiments for a batch run: not ``good`` by ``completeness_status`` (the ``status`` of ``completeness``), without
    analyses, of one source; filters add up.

    ``limit`` keeps the first by id. An experiment whose analyses are NULL or empty is unanalysed.
    """
    if incomplete:
        df = df.where(~F.col("completeness_status").eqNullSafe("good"))
    if unanalysed:
        df = df.where(F.coalesce(F.size(analyses), F.lit(0)) <= 0)
    if source is not None:
        df = df.where(F.col("source") == source)
    return df if limit is None else df.orderBy(id_col).limit(limit)


def lookup(df: DataFrame, column: str, path: str, form: str = "string") -> Column:
    """Value at the dotted ``path`` inside a document column: JSON text, VARIANT, or a struct.

    A step that is absent, or that leads into something that is no document, gives NULL; so do texts that are no JSON
    and values that ``form`` cannot hold. In a struct, maps are entered by key. Text documents keep their values as
    they are written, nested documents come as JSON.
    """
    kind, steps = df.schema[column].dataType, path.split(".")
    if isinstance(kind, (T.StringType, T.VariantType)):
        value = F.try_parse_json(column) if isinstance(kind, T.StringType) else F.col(column)
        if any("'" in s or not s for s in steps):
            raise ValueError(f"not a path: {path}")
        return F.try_variant_get(value, "$" + "".join(f"['{s}']" for s in steps), form)
    value = F.col(column)
    for step in steps:
        if isinstance(kind, T.StructType) and step in kind.names:
            value, kind = value.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(step)), kind.valueType
        else:
            return F.lit(None).cast(form)
    return value.try_cast(form)


def any_tag(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    return df.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


# -- identity, dedup, diff ----------------------------------------------------

def fingerprint(fields: Sequence[str], length: int = 16) -> Column:
    """Truncated SHA-256 of the pipe-joined fields; NULL counts as empty."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def deduplicate(df: DataFrame, key: str, arrival: str, path: str) -> DataFrame:
    """First record per key with the number of records and of distinct paths seen for it."""
    payload = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*payload), arrival).alias("r"), F.count("*").alias("records"))
    counted = all_paths(df, key, arrival, path).groupBy(key).agg(F.count("*").alias("n_paths"))
    return first.join(counted, key, "left").select(key, "r.*", "records", "n_paths")


def all_paths(df: DataFrame, key: str, arrival: str, path: str) -> DataFrame:
    """Distinct paths per key with the first arrival of each, as rows."""
    return df.where(F.col(path).isNotNull()).groupBy(key, path).agg(F.min(arrival).alias("first_seen"))


def new_rows(discovered: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return discovered.join(current.select(key), key, "left_anti")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union where ``first`` wins for every key both sides hold."""
    extra = second.join(first.select(key), key, "left_anti")
    return first.unionByName(extra, allowMissingColumns=True)


def diff(discovered: DataFrame, current: DataFrame, key: str = "path", counters: Sequence[str] = COUNTERS) -> DataFrame:
    """new / updated / unchanged / removed per key with the changed counters (NULL reads as 0)."""
    d = discovered.select(F.col(key), *[F.coalesce(c, F.lit(0)).alias(f"new_{c}") for c in counters], F.lit(1).alias("_d"))
    c = current.select(F.col(key), *[F.coalesce(c, F.lit(0)).alias(f"old_{c}") for c in counters], F.lit(1).alias("_c"))
    both = d.join(c, key, "full")
    changed = messages(*[
        F.when(
            F.col(f"new_{n}") != F.col(f"old_{n}"),
            F.struct(F.lit(n).alias("field"), F.col(f"old_{n}").alias("old"), F.col(f"new_{n}").alias("new")),
        )
        for n in counters
    ])
    kind = (
        F.when(F.col("_c").isNull(), "new")
        .when(F.col("_d").isNull(), "removed")
        .when(F.size(changed) > 0, "updated")
        .otherwise("unchanged")
    )
    paired = F.col("_c").isNotNull() & F.col("_d").isNotNull()
    return both.select(key, kind.alias("change_type"), F.when(paired, changed).alias("changes"))


def diff_summary(changes: DataFrame) -> DataFrame:
    kinds = ["new", "updated", "removed", "unchanged"]
    return changes.agg(
        F.count_if(F.col("change_type") != "removed").alias("total_discovered"),
        F.count_if(F.col("change_type") != "new").alias("current_in_registry"),
        *[F.count_if(F.col("change_type") == k).alias(f"{k}_count") for k in kinds],
    )


# Fixed value: why a run was archived.
GONE = "directory_not_found"


def apply_proposal(discovered: DataFrame, current: DataFrame, key: str = "path", counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Next registry snapshot: inserts, counter updates, and removed runs archived, never deleted."""
    d = discovered.select(key, *[F.col(c).alias(f"_n_{c}") for c in counters], F.lit(True).alias("_d"))
    c = current.withColumn("_c", F.lit(True))
    both = c.join(d, key, "full")
    gone, fresh = F.col("_d").isNull(), F.col("_c").isNull()
    return both.select(
        key,
        F.when(fresh, "discovered").when(gone, "archived").otherwise(F.col("status")).alias("status"),
        F.when(gone, GONE).otherwise(F.lit(None)).alias("archived_reason"),
        *[F.when(gone, F.col(n)).otherwise(F.coalesce(f"_n_{n}", F.lit(0))).alias(n) for n in counters],
    )


def fill_missing(base: DataFrame, extracted: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fill empty fields from ``extracted`` (base wins) and list the fields that were filled."""
    e = extracted.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    joined = base.join(e, key, "left")
    empty = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) == ""
    filled = messages(*[F.when(empty(f) & F.col(f"_e_{f}").isNotNull(), F.lit(f)) for f in fields])
    rest = [c for c in base.columns if c not in fields and c != key]
    return joined.select(
        key, *rest,
        *[F.when(empty(f), F.coalesce(F.col(f"_e_{f}"), F.col(f))).otherwise(F.col(f)).alias(f) for f in fields],
        filled.alias("changes"),
    )


def deep_merge(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Recursive merge of structs and maps, the update winning wherever it holds a value."""
    from pyspark.sql import types as T

    def merge(b: Column, u: Column, bt: T.DataType) -> Column:
        if isinstance(bt, T.StructType):
            inner = F.struct(*[merge(b[f.name], u[f.name], f.dataType).alias(f.name) for f in bt.fields])
            return F.when(b.isNull() & u.isNull(), F.lit(None)).otherwise(inner)
        if isinstance(bt, T.MapType):
            kept = F.map_filter(b, lambda k, _: ~F.coalesce(F.map_contains_key(u, k), F.lit(False)))
            return F.when(b.isNull(), u).when(u.isNull(), b).otherwise(F.map_concat(kept, u))
        return F.coalesce(u, b)

    joined = base.alias("b").join(updates.alias("u"), F.col(f"b.{key}") == F.col(f"u.{key}"), "full")
    fields = [f for f in base.schema.fields if f.name != key]
    return joined.select(
        F.coalesce(f"b.{key}", f"u.{key}").alias(key),
        *[merge(F.col(f"b.{f.name}"), F.col(f"u.{f.name}"), f.dataType).alias(f.name) for f in fields],
    )


def related(experiments: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges to experiments with the same sample, the same flow cell or a shared tag.

    Three memberships (kind, value) per experiment. Groups are kept as groups: an edge list would
    be quadratic in the largest group, so the result is one row per member and group with the
    group's size; ``related_of`` lists the neighbours of chosen experiments.
    """
    member = F.explode(F.array_distinct(F.concat(
        F.array(
            F.struct(F.lit("sample").alias("kind"), F.col("sample").alias("value")),
            F.struct(F.lit("flowcell").alias("kind"), F.col("flowcell").alias("value")),
        ),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                    lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))),
    )))
    rows = experiments.select(F.col(id_col).alias("id"), member.alias("m")).select("id", "m.kind", "m.value")
    rows = rows.where(F.col("value").isNotNull() & (F.col("value") != ""))
    sizes = rows.groupBy("kind", "value").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return rows.join(sizes, ["kind", "value"])


def related_of(experiments: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    """Neighbours of each chosen experiment, once each, with the strongest reason.

    Sample beats flow cell beats tag. The choice is a short list; its memberships are joined to
    everyone's, one equi join in place of an OR condition.
    """
    groups = related(experiments, id_col).drop("group_size")
    mine = groups.join(chosen.select(F.col(id_col).alias("id")), "id").withColumnRenamed("id", "of_id")
    order = F.when(F.col("kind") == "sample", 0).when(F.col("kind") == "flowcell", 1).otherwise(2)
    return (
        groups.join(mine, ["kind", "value"]).where(F.col("id") != F.col("of_id"))
        .groupBy("of_id", "id").agg(F.min_by("kind", order).alias("reason"))
    )


# -- quality of the registry itself -------------------------------------------

def completeness(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, int, str]] = COMPLETENESS) -> DataFrame:
    """Weighted score with missing and present fields; good from 80 %, warning from 50 %."""
    best = sum(w for _, w, _ in rules)
    here = {f: is_present(f, kind) if f in df.columns else F.lit(False) for f, _, kind in rules}
    score = sum((F.when(here[f], w).otherwise(0) for f, w, _ in rules), F.lit(0))
    pct = F.round(F.col("score") * 100.0 / best).cast("int")
    return df.select(
        *keys,
        score.alias("score"),
        messages(*[F.when(~here[f], F.lit(f)) for f, _, _ in rules]).alias("missing"),
        messages(*[F.when(here[f], F.lit(f)) for f, _, _ in rules]).alias("present"),
    ).withColumn("percentage", pct).withColumn(
        "status", F.when(F.col("percentage") >= 80, "good").when(F.col("percentage") >= 50, "warning").otherwise("poor")
    )


#: Structured documents that took the place of single legacy numbers.
STRUCTURED = ("quality_metrics", "read_counts", "length_metrics")
LEGACY = ("mean_quality", "total_reads", "n50")


def _absent(df: DataFrame, name: str) -> Column:
    """True where a field holds nothing: no such column, NULL, an empty text, list or map, or a text of an empty document."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(True)
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(name) <= 0, F.lit(True))
    if kind.startswith("struct"):
        return F.col(name).isNull()
    return F.coalesce(F.regexp_replace(F.col(name).cast("string"), r"\s", "").isin("", "{}", "[]", "null"), F.lit(True))


def _rules(df: DataFrame) -> list[tuple[str, str, Column, str | None]]:
    """(level, finding, condition, column whose value is quoted) of everything that is checked in an experiment."""
    no = {c: _absent(df, c) for c in ("id", "name", "source", "sample", "device_type", "https_url", "browser_url", "schema_version", *STRUCTURED)}
    value = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    unknown = no["source"] | F.coalesce(value("source") == "unknown", F.lit(False))
    public = F.coalesce(value("source") == PUBLIC_SOURCE, F.lit(False))
    numbers = reduce(Column.__or__, [is_present(c, "number") for c in LEGACY if c in df.columns], F.lit(False))
    return [
        ("error", "id: absent", no["id"], None),
        ("warning", "id: other form", ~no["id"] & ~value("id").rlike(ID_FORMAT), "id"),
        ("error", "name: absent", no["name"], None),
        ("error", "source: absent or unknown", unknown, None),
        ("warning", "source: not a listed one", ~unknown & ~value("source").isin(SOURCES), "source"),
        ("warning", "https_url: absent though public", public & no["https_url"], None),
        ("warning", "browser_url: absent though public", public & no["browser_url"], None),
        ("warning", "sample, device_type: both absent", no["sample"] & no["device_type"], None),
        ("warning", "metrics: legacy numbers only", numbers & reduce(Column.__and__, [no[c] for c in STRUCTURED]), None),
        ("warning", "schema_version: absent", no["schema_version"], None),
    ]


def validate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors and warnings of every experiment row, by the table of rules; a row without errors is valid.

    A column that the table lacks is absent in all rows. A structured document that is empty counts as absent.
    """
    found = lambda level: messages(*[
        F.when(here, F.lit(text) if quoted is None else F.concat(F.lit(f"{text}: "), F.col(quoted).cast("string")))
        for of, text, here, quoted in _rules(df) if of == level
    ])
    return df.select(*keys, found("error").alias("errors"), found("warning").alias("warnings")).withColumn("is_valid", F.size("errors") == 0)


def schema_validate(df: DataFrame, keys: Sequence[str], schema: Mapping[str, Mapping]) -> DataFrame:
    """Rule-dict validation of string rows.

    Rules per field: type (int, float, bool, str), required, min, max, min_length, max_length,
    pattern, choices, items (type of the members of an array column), validator (a callable from
    Column to a condition that must hold).
    """
    castable: dict[str, str] = {"int": "bigint", "float": "double", "bool": "boolean"}
    checks: list[Column] = []
    for name, rule in schema.items():
        if name not in df.columns:
            if rule.get("required"):
                checks.append(F.lit(f"Required field '{name}' is missing"))
            continue
        value = F.col(name)
        is_array = dict(df.dtypes)[name].startswith("array")
        there = value.isNotNull()
        if rule.get("required"):
            checks.append(F.when(~there, F.lit(f"Required field '{name}' is missing")))
        kind = rule.get("type")
        typed_ok = there
        if kind in castable:
            typed = value.try_cast(castable[kind])
            checks.append(F.when(there & typed.isNull(), F.lit(f"Field '{name}' has wrong type: expected {kind}")))
            typed_ok = typed.isNotNull()
        number = value.try_cast("double") if not is_array else F.lit(None).cast("double")
        size = F.size(value) if is_array else F.length(value.cast("string"))
        bounds = {
            "min": (number < F.lit(rule.get("min")), "value below min"),
            "max": (number > F.lit(rule.get("max")), "value above max"),
            "min_length": (size < F.lit(rule.get("min_length")), "length below min"),
            "max_length": (size > F.lit(rule.get("max_length")), "length above max"),
        }
        for bound, (broken, text) in bounds.items():
            if bound in rule:
                checks.append(F.when(typed_ok & broken, F.lit(f"Field '{name}' {text} {rule[bound]}")))
        if "pattern" in rule:
            checks.append(F.when(typed_ok & ~value.rlike(f"^(?:{rule['pattern']})"), F.lit(f"Field '{name}' does not match pattern")))
        if "choices" in rule:
            checks.append(F.when(typed_ok & ~value.isin(list(rule["choices"])), F.concat(
                F.lit(f"Field '{name}' has invalid value: "), value.cast("string"))))
        if "items" in rule and is_array and rule["items"] in castable:
            bad = F.exists(value, lambda x: x.try_cast(castable[rule["items"]]).isNull())
            checks.append(F.when(there & bad, F.lit(f"Field '{name}' has an item of wrong type")))
        if "validator" in rule:
            test: Callable[[Column], Column] = rule["validator"]
            checks.append(F.when(typed_ok & ~test(value), F.lit(f"Field '{name}' failed validation")))
    unknown = [c for c in df.columns if c not in schema and c not in keys]
    return df.select(
        *keys,
        messages(*checks).alias("errors"),
        messages(*[F.when(F.col(c).isNotNull(), F.lit(f"Unknown field: {c}")) for c in unknown]).alias("warnings")
        if unknown else F.array().cast("array<string>").alias("warnings"),
    ).withColumn("is_valid", F.size("errors") == 0)


def apply_defaults(df: DataFrame, schema: Mapping[str, Mapping]) -> DataFrame:
    for name, rule in schema.items():
        if "default" in rule:
            fallback = F.lit(rule["default"])
            df = df.withColumn(name, F.coalesce(F.col(name), fallback) if name in df.columns else fallback)
    return df


def audit(validated: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Long form roll-up (section, name, n): validity, completeness status, missing fields."""
    both = validated.join(scored, key)
    section = F.explode(F.concat(
        F.array(
            F.struct(F.lit("validity").alias("section"), F.when(F.col("is_valid"), "valid").otherwise("invalid").alias("name")),
            F.struct(F.lit("status").alias("section"), F.col("status").alias("name")),
        ),
        F.transform("missing", lambda f: F.struct(F.lit("missing").alias("section"), f.alias("name"))),
    ))
    return both.select(section.alias("s")).groupBy("s.section", "s.name").agg(F.count("*").alias("n"))


def needing_attention(scored: DataFrame, below: int = 80) -> DataFrame:
    """Experiments under a completeness, worst first, with all their missing fields."""
    return scored.where(F.col("percentage") < below).orderBy("percentage")


def registry_stats(df: DataFrame) -> DataFrame:
    """Overall totals and one row per source, status and device, in one scan."""
    dims = [F.col("source"), F.col("status"), F.col("device")]
    g = df.groupingSets([[], [dims[0]], [dims[1]], [dims[2]]], *dims).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        F.count_distinct("flowcell").alias("unique_flowcells"),
        F.count_distinct(F.col("dev")).alias("unique_devices"),
        F.count_if(F.coalesce(F.col("pct_signal_positive") != 0, F.lit(False))).alias("with_qc_data"),
    )
    level = F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "status").otherwise("device")
    value = F.coalesce(F.col("source"), F.col("status"), F.col("device"), F.lit("all"))
    return g.select(level.alias("level"), value.alias("value"), "n", "unique_flowcells", "unique_devices", "with_qc_data")


# -- events and statistics ----------------------------------------------------

def latest_event(events: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Newest event per key. An aggregation, not a sort: map-side combined, safe on hot keys."""
    newest = F.max_by(F.struct(*payload), F.struct(*order))
    return events.groupBy(*keys).agg(newest.alias("e")).select(*keys, "e.*")


def sync_statistics(stats: DataFrame, events: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Overwrite statistics with the newest event's values where it has them; add missing rows."""
    e = events.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    joined = stats.join(e, key, "full")
    rest = [c for c in stats.columns if c not in fields and c != key]
    return joined.select(key, *rest, *[F.coalesce(f"_e_{f}", f).alias(f) for f in fields])


def replace_end_reasons(distribution: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Swap the distribution of every experiment that has a newer end-reason event."""
    kept = distribution.join(events.select(key).distinct(), key, "left_anti")
    return kept.unionByName(events.select(*distribution.columns))


def history(events: DataFrame, key: str, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Numbered event history, newest first; ``limit`` keeps the newest per experiment."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    numbered = events.withColumn("position", F.row_number().over(w))
    return numbered if limit is None else numbered.where(F.col("position") <= limit)


def provenance(events: DataFrame, key: str, order: Sequence[str], document: str) -> DataFrame:
    """Every event with what it ran and how it ended, out of its JSON ``document``; no window, so one row in, one row out.

    Adds command, agent, machine (text), duration_seconds (double), exit_code (int), outputs (array of paths; NULL if
    none are named) and outcome: ``ok`` for exit code 0, ``failed`` for another, NULL without one.
    """
    at = lambda path, form="string": lookup(events, document, path, form)
    code = at("exit_code", "int")
    return events.select(
        key, *order, at("command").alias("command"), at("agent").alias("agent"), at("machine").alias("machine"),
        at("duration_seconds", "double").alias("duration_seconds"), code.alias("exit_code"),
        at("outputs", "array<string>").alias("outputs"), F.when(code == 0, "ok").when(code.isNotNull(), "failed").alias("outcome"),
    )


def artifact_versions(artifacts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Next free version per artifact: highest ``v<n>`` seen plus one, 1 when there is none."""
    number = F.regexp_extract("version", r"^v(\d+)$", 1)
    value = F.when(number != "", number.cast("int"))
    return artifacts.groupBy(*keys).agg((F.coalesce(F.max(value), F.lit(0)) + 1).alias("next_version"))


def context(experiments: DataFrame, stats: DataFrame, events: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """Everything known per experiment; each side is aggregated to the key before its join."""
    seen = events.groupBy(key).agg(
        F.count("*").alias("n_events"), F.max("ts").alias("last_event"),
        F.max_by("analysis", F.struct("ts", "event_id")).alias("last_analysis"),
    )
    mix = reasons.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end_reason", "n"))),
                                 lambda r: F.concat_ws("=", r["end_reason"], r["n"].cast("string"))), ",").alias("end_reasons")
    )
    return experiments.join(stats, key, "left").join(seen, key, "left").join(mix, key, "left").na.fill(0, ["n_events"])
