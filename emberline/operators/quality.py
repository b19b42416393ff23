"""Contracts over tables. Every check gives violations (check, key, message); strict() raises if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks its contract."""


def strict(violations: DataFrame, shown: int = 20) -> None:
    """Raise with the first few violations."""
    first = violations.limit(shown).collect()
    if first:
        raise ContractError("; ".join(f"{r['check']} {r['key']}: {r['message']}" for r in first))


def violations(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """One row per row and failed test; a test that is null holds."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(True)), n) for n, t in tests.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(failed).alias("check")).select("check", "key", F.concat(F.lit("violates "), "check").alias("message"))


def _as(rows: DataFrame, check: str, key: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), key.cast("string").alias("key"), F.lit(f"violates {check}").alias("message"))


def repeated_keys(rows: DataFrame, keys: list[str], check: str = "repeated_key") -> DataFrame:
    return _as(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), check, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def exactly_one(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Wanted keys with no row or with more than one."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return _as(wanted.select(key).distinct().join(n, key, "left").where("coalesce(__n, 0) <> 1"), "exactly_one", F.col(key))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    k = F.concat_ws("|", *[F.col(x).cast("string") for x in keys])
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return _as(left.join(right, keys, "left_anti"), "missing_key", k).unionByName(_as(right.join(left, keys, "left_anti"), "unexpected_key", k))


def subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _as(a.select(key).distinct().join(b.select(key), key, "left_anti"), "not_in_superset", F.col(key))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _as(a.select(key).distinct().join(b.select(key), key, "left_semi"), "in_both", F.col(key))


def expected_counts(rows: DataFrame, group: str, expected: DataFrame) -> DataFrame:
    """Groups whose count differs from ``expected`` (group, expected)."""
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return _as(expected.join(n, group, "full_outer").where("not (coalesce(__n, 0) <=> coalesce(expected, 0))"), "expected_count", F.col(group))


def freeze_checks(events: DataFrame, members: DataFrame) -> DataFrame:
    """Unique ids, one configuration, the same universe, and as many members as each event records."""
    configurations = members.select("configuration_id").unionByName(events.select("configuration_id")).distinct()
    many = configurations.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = members.groupBy("event_id").agg(F.count(F.lit(1)).alias("__n"))
    return (
        repeated_keys(events, ["event_id"], "repeated_event").unionByName(repeated_keys(members, ["detection_id"], "repeated_detection")).unionByName(same_keys(events, members, ["event_id"]))
        .unionByName(_as(many, "one_configuration", F.col("n"))).unionByName(_as(events.join(n, "event_id").where("detection_count <> __n"), "member_count", F.col("event_id")))
    )


def detection_checks(rows: DataFrame) -> DataFrame:
    good = violations(rows, "detection_id", {"latitude_range": F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "longitude_range": F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "timestamp_present": F.col("ts").isNotNull(), "power_not_negative": F.col("frp") >= 0})
    return good.unionByName(repeated_keys(rows, ["detection_id"], "repeated_detection"))


def grain_checks(rows: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Missing, extra and repeated cells of the full grain of the dimensions (each a table of one small column)."""
    keys = list(dimensions)
    grain = None
    for name, values in dimensions.items():
        grain = values.select(name) if grain is None else grain.crossJoin(F.broadcast(values.select(name)))
    return same_keys(grain, rows, keys).unionByName(repeated_keys(rows, keys, "repeated_cell"))


def observability_checks(matrix: DataFrame, inventory: DataFrame) -> DataFrame:
    """Usable within total, chosen scenes in the inventory, status in step with the counts."""
    key = F.concat_ws("|", F.col("event_id").cast("string"), "combination_id", "rule_id")
    rows = matrix.withColumn("__key", key)
    tests = {
        "pre_usable_within_total": F.col("pre_usable") <= F.col("pre_scenes"), "post_usable_within_total": F.col("post_usable") <= F.col("post_scenes"),
        "status_agrees": (F.col("status") == "usable_both") == ((F.col("pre_usable") > 0) & (F.col("post_usable") > 0)), "chosen_if_usable": (F.col("pre_usable") > 0) == F.col("pre_scene").isNotNull(),
    }
    chosen = rows.select("__key", F.explode(F.array_compact(F.array("pre_scene", "post_scene"))).alias("scene_id"))
    return violations(rows, "__key", tests).unionByName(_as(chosen.join(inventory.select("scene_id").distinct(), "scene_id", "left_anti"), "chosen_scene_known", F.col("__key")))


def metric_checks(metrics: DataFrame, key: str) -> DataFrame:
    c = F.col
    return violations(metrics, key, {
        "common_within_aoi": c("common_px") <= c("aoi_px"), "common_within_pre": c("common_px") <= c("pre_px"), "common_within_post": c("common_px") <= c("post_px"),
        "fraction_is_ratio": F.abs(c("valid_overlap_fraction") - c("common_px") / c("aoi_px")) <= 1e-9, "percentiles_ordered": (c("dnbr_p10") <= c("dnbr_median") + 1e-9) & (c("dnbr_median") <= c("dnbr_p95") + 1e-9),
    })


def selection_checks(selection: DataFrame) -> DataFrame:
    c = F.col
    chosen = c("selected_combination").isNotNull()
    return violations(selection, "event_id", {"pair_complete": ~chosen | (c("pre_scene").isNotNull() & c("post_scene").isNotNull()), "rule_named": ~chosen | c("minimum_rule").isin("A", "B", "C", "D"), "combination_form": ~chosen | c("selected_combination").rlike(r"^b\d{4}_pre\d+_post\d+$")})


def public_checks(rows: DataFrame, key: str, ranges: dict[str, tuple[float, float]], enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """Types are the schema's; ranges and enums are checked, keys are unique and null nowhere."""
    tests = {f"{c}_range": F.col(c).between(*r) for c, r in ranges.items()} | {f"{c}_code": F.col(c).isin(*v) for c, v in enums.items()} | {"key_present": F.col(key).isNotNull()}
    return violations(rows, key, tests).unionByName(repeated_keys(rows, [key]))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): created, deleted, changed or unchanged, null-safe."""
    a, b = before.select(key, F.col(value).alias("__a"), F.lit(True).alias("__x")), after.select(key, F.col(value).alias("__b"), F.lit(True).alias("__y"))
    change = F.when(F.col("__x").isNull(), "created").when(F.col("__y").isNull(), "deleted").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def reconcile_files(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, verdict) of files against their manifest: orphans on both sides, hash, size and count mismatches."""
    a = raw.select("path", F.col("sha256").alias("h1"), F.col("size_bytes").alias("s1"), F.col("record_count").alias("n1"), F.lit(True).alias("__x"))
    b = manifest.select("path", F.col("sha256").alias("h2"), F.col("size_bytes").alias("s2"), F.col("record_count").alias("n2"), F.lit(True).alias("__y"))
    verdict = F.when(F.col("__y").isNull(), "not_in_manifest").when(F.col("__x").isNull(), "no_file").when(~F.col("h1").eqNullSafe(F.col("h2")), "hash_differs").when(~F.col("s1").eqNullSafe(F.col("s2")), "size_differs").when(~F.col("n1").eqNullSafe(F.col("n2")), "count_differs").otherwise("matches")
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"))


def identical_contents(raw: DataFrame) -> DataFrame:
    """(sha256, paths) of contents that more than one file has."""
    return raw.groupBy("sha256").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def lineage_checks(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose id is not the hash of their source, file and row number, whose file is unknown, or whose row number is out of range."""
    joined = rows.join(files.select(F.col("path").alias("raw_file"), F.col("sha256").alias("__h"), F.col("record_count").alias("__n")), "raw_file", "left")
    own = F.concat(F.lit("firms-"), F.sha2(F.concat_ws("\x00", "firms_source", "raw_sha256", F.col("source_row_number").cast("string")), 256))
    return violations(joined, "detection_id", {"file_known": F.col("__h").isNotNull(), "file_hash": F.col("__h") == F.col("raw_sha256"), "row_in_range": F.col("source_row_number").between(1, F.col("__n")), "id_recomputed": F.col("detection_id") == own})


def reconcile_metrics(expected: DataFrame, actual: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """(keys, metric, status, absolute, relative): pass, fail or not_comparable within each metric's tolerance."""
    names = list(tolerances)
    long = lambda d, n: d.select(*keys, *[F.col(m).cast("double").alias(m) for m in names]).unpivot([F.col(k) for k in keys], names, "metric", n)
    allowed = F.coalesce(*[F.when(F.col("metric") == m, F.lit(float(t))) for m, t in tolerances.items()])
    gap = F.abs(F.col("actual") - F.col("expected"))
    status = F.when(gap.isNull(), "not_comparable").when(gap <= allowed, "pass").otherwise("fail")
    return long(expected, "expected").join(long(actual, "actual"), [*keys, "metric"], "full_outer").select(*keys, "metric", status.alias("status"), gap.alias("absolute"), F.try_divide(gap, F.abs("expected")).alias("relative"))


def mode_agreement(metrics: DataFrame, key: str, mode: str, columns: list[str], tolerance: float = 0.05) -> DataFrame:
    """(key, agreement) of two modes' metrics: agree if every difference is within the tolerance."""
    modes = metrics.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in columns], *[F.count(c).alias(f"__{c}") for c in columns])
    whole = F.lit(True)
    near = F.lit(True)
    for c in columns:
        whole = whole & (F.col(f"__{c}") == 2)
        near = near & (F.col(c) <= tolerance)
    return modes.select(key, F.when((F.col("n") < 2) | ~whole, "not_comparable").when(near, "agree").otherwise("disagree").alias("agreement"))


def text_claims(rows: DataFrame, key: str, text: str, positive: str, negative: str) -> DataFrame:
    """(key, sentence): sentences with a positive pattern and no negation."""
    sentences = rows.select(key, F.explode(F.split(text, r"[.!?;:\n]")).alias("sentence"))
    return sentences.where(F.col("sentence").rlike(positive) & ~F.col("sentence").rlike(negative)).select(key, F.trim("sentence").alias("sentence"))


def private_texts(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, hits): how often a private pattern occurs in a text, where it does."""
    return rows.select(key, F.regexp_count(text, F.lit(pattern)).alias("hits")).where("hits > 0")


def forbidden_columns(schema: T.StructType, names: set[str], at: str = "") -> list[str]:
    """Paths of the forbidden field names anywhere in a schema."""
    found = []
    for f in schema.fields:
        path = f"{at}{f.name}"
        kind = f.dataType
        if f.name.lower() in names:
            found.append(path)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.MapType):
            kind = kind.valueType
        if isinstance(kind, T.StructType):
            found += forbidden_columns(kind, names, f"{path}.")
    return found


def forbidden_json_keys(rows: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """(key, name) of forbidden keys at any depth of JSON text."""
    hits = F.array_compact(F.array(*[F.when(F.col(json).rlike(f'"{n}"\\s*:'), n) for n in names]))
    return rows.select(key, F.explode(hits).alias("name"))
