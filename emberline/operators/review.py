"""Comparing reviewers, deriving triage, and following review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The compared fields, by weight, and the surfaces that compete with a scar.
MATERIAL = ("visible_burn_scar", "event_association", "mode_agreement")
NONMATERIAL = ("scar_confidence", "competing_land_change", "observation_limitation", "confidence_after")
FIELDS = MATERIAL + NONMATERIAL
STRONG_SURFACES = ("agriculture_or_harvest", "mixed", "unknown")
WEAK_SURFACES = ("soil_exposure", "vegetation_phenology", "moisture_or_flooding", "water", "urban_or_construction")


def _names(tests: dict[str, Column]) -> Column:
    """Sorted names of the tests that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()])))


def reviewer_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(event_id, a, b, agreements, material, nonmaterial, reason_codes, needs_adjudication) of two slots; no consensus is drawn."""
    left = a.select("event_id", F.struct(*FIELDS).alias("a"))
    right = b.select("event_id", F.struct(*FIELDS).alias("b"))
    rows = left.join(right, "event_id")
    same = lambda f: F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    x, y = F.col("a.event_association"), F.col("b.event_association")
    parted = ~x.eqNullSafe(y) & (((x == "indeterminate") != (y == "indeterminate")) | F.array_contains(F.array(F.lit("likely,unlikely"), F.lit("unlikely,likely")), F.concat_ws(",", x, y)))
    reasons = _names({
        "interreview_mode_disagreement": (F.col("a.mode_agreement") == "disagree") | (F.col("b.mode_agreement") == "disagree"), "interreview_visible_disagreement": ~same("visible_burn_scar"),
    })
    out = rows.withColumns({
        "agreements": F.create_map(*[x for f in FIELDS for x in (F.lit(f), same(f))]), "material": _names({f: ~same(f) for f in MATERIAL}), "nonmaterial": _names({f: ~same(f) for f in NONMATERIAL}), "reason_codes": reasons, "association_parted": F.coalesce(parted, F.lit(False)),
    })
    return out.withColumn("needs_adjudication", (F.size("material") > 0) | (F.size("reason_codes") > 0))


def triage(reviews: DataFrame, pairs: DataFrame | None = None, peers: DataFrame | None = None, adjudications: DataFrame | None = None) -> DataFrame:
    """(event_id, needs_adjudication, adjudication_codes, expert_priority, expert_codes, status), from structured fields alone."""
    rows = reviews
    empty = F.expr("cast(array() as array<string>)")
    if pairs is not None:
        rows = rows.join(pairs.select("event_id", "material", "nonmaterial", "reason_codes", F.col("needs_adjudication").alias("__pair")), "event_id", "left")
    else:
        rows = rows.withColumns({"material": empty, "nonmaterial": empty, "reason_codes": empty, "__pair": F.lit(False)})
    rows = rows.join(peers.select("event_id", F.col("scar_confidence").alias("__peer"), F.lit(True).alias("__has_peer")), "event_id", "left") if peers is not None else rows.withColumns({"__peer": F.lit(None).cast("string"), "__has_peer": F.lit(False)})
    if adjudications is not None:
        rows = rows.join(adjudications.select("event_id", "specialist_question_code", "material_disagreement_resolved", "resolution_status"), "event_id", "left")
    else:
        rows = rows.withColumns({"specialist_question_code": F.lit(""), "material_disagreement_resolved": F.lit(True), "resolution_status": F.lit("")})
    c, some = F.col, lambda a: F.size(F.coalesce(F.col(a), empty)) > 0
    asked = _names({
        "ambiguous_observation": c("visible_burn_scar") == "ambiguous", "low_confidence": c("scar_confidence") == "low", "indeterminate_association": c("event_association") == "indeterminate",
        "mode_disagreement": c("mode_agreement") == "disagree", "structured_reviewer_request": c("reviewer_requested_adjudication"), "material_interreview_disagreement": c("__pair") & some("material"),
    })
    codes = F.array_sort(F.array_distinct(F.concat(asked, F.coalesce("reason_codes", empty))))
    surface, strong = c("competing_land_change"), c("competing_land_change").isin(*STRONG_SURFACES)
    required = F.coalesce((c("specialist_question_code") != "") & (c("resolution_status") == "complete") & ~c("material_disagreement_resolved"), F.lit(False))
    expert = _names({
        "confidence_changed_between_passes": c("confidence_after") != c("scar_confidence"), "persistent_interreview_confidence_difference": c("__has_peer") & ~c("__peer").eqNullSafe(c("scar_confidence")),
        "persistent_nonmaterial_interreview_difference": some("nonmaterial"), "determined_association_with_strong_competitor": c("event_association").isin("likely", "possible") & strong, "adjudication_requires_specialist_question": required,
    })
    named = F.array_compact(F.array(
        F.when(strong, F.concat(F.lit("strong_competing_surface="), surface)), F.when(surface.isin(*WEAK_SURFACES), F.concat(F.lit("competing_surface="), surface)),
        F.when(c("observation_limitation") != "none", F.concat(F.lit("observation_limitation="), c("observation_limitation"))),
    ))
    out = rows.withColumns({"adjudication_codes": codes, "expert_codes": F.array_sort(F.concat(expert, named)), "__required": required})
    priority = F.when(c("__required"), "required").when(F.size("expert_codes") > 0, "recommended").otherwise("none")
    out = out.withColumns({"needs_adjudication": F.size("adjudication_codes") > 0, "expert_priority": priority})
    status = F.when(c("expert_priority") == "required", "pending_expert_review").when(c("needs_adjudication"), "pending_adjudication").when(c("expert_priority") == "recommended", "pending_expert_review").otherwise("pending")
    return out.select("event_id", "needs_adjudication", "adjudication_codes", "expert_priority", "expert_codes", status.alias("status"))


def with_status(items: DataFrame, reviews: DataFrame, key: str, default: str = "pending") -> DataFrame:
    """Every item with its review status, the default where there is no review."""
    return items.join(reviews.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit(default)))


def status_counts(rows: DataFrame, codes: list[str]) -> DataFrame:
    """(status, items) for every code, zeros kept."""
    all_codes = rows.sparkSession.createDataFrame([(c,) for c in codes], "status string")
    return all_codes.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("items"))


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new): one row per field that differs, null-safe."""
    side = lambda d, n: d.select(key, F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields]).alias(n))
    rows = side(before, "old").join(side(after, "new"), key).select(key, F.explode(F.arrays_zip("old", "new")).alias("z"))
    return rows.where(~F.col("z.old.v").eqNullSafe(F.col("z.new.v"))).select(key, F.col("z.old.field").alias("field"), F.col("z.old.v").alias("old"), F.col("z.new.v").alias("new"))


def review_queue(items: DataFrame, metrics: DataFrame, key: str, metric_columns: list[str], answers: list[str]) -> DataFrame:
    """One row per item with its primary metrics and blank answer columns."""
    return items.join(metrics.select(key, *metric_columns), key, "left").withColumns({a: F.lit("") for a in answers})


def export_layout(reviews: DataFrame, fields: list[str], notes: list[str]) -> DataFrame:
    """An older layout: answers blank unless the review is complete, notes joined."""
    done = F.col("status") == "complete"
    return reviews.select("event_id", "status", *[F.when(done, F.coalesce(F.col(f), F.lit(""))).otherwise("").alias(f) for f in fields], F.concat_ws(" | ", *[F.nullif(F.col(n), F.lit("")) for n in notes]).alias("notes"))


def state_violations(reviews: DataFrame, enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """(check, key, message) of review rows: codes, coherence, what each status needs, revisions and times."""
    c = F.col
    tests = {f"{f}_code": c(f).isNotNull() & (c(f) != "") & ~c(f).isin(*codes) for f, codes in enums.items()}
    tests |= {
        "reviewed_needs_reviewer": (c("status") == "complete") & (F.coalesce("reviewer", F.lit("")) == ""), "reviewed_needs_time": (c("status") == "complete") & c("reviewed_at").isNull(),
        "pending_is_blank": (c("status") == "pending") & (F.coalesce("visible_burn_scar", F.lit("")) != ""), "revision_positive": c("revision") < 1, "scar_needs_confidence": (c("visible_burn_scar") == "yes") & (F.coalesce("scar_confidence", F.lit("")) == ""),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()]))
    return reviews.select(F.col("event_id").cast("string").alias("key"), F.explode(found).alias("check")).select("check", "key", F.concat(F.lit("violates "), "check").alias("message"))


def provenance_violations(reviews: DataFrame) -> DataFrame:
    """(check, key, message): a human review names no model, a model review names one."""
    c = F.col
    tests = {"human_with_model": (c("profile") == "human") & (F.coalesce("model", F.lit("")) != ""), "model_without_name": (c("profile") == "model") & (F.coalesce("model", F.lit("")) == ""), "unknown_profile": ~c("profile").isin("human", "model") | c("profile").isNull()}
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()]))
    return reviews.select(F.col("event_id").cast("string").alias("key"), F.explode(found).alias("check")).select("check", "key", F.concat(F.lit("violates "), "check").alias("message"))


def payload_hash(*fields: str) -> Column:
    """Hash of the named fields as JSON in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def assignment_violations(assignments: DataFrame, fields: list[str]) -> DataFrame:
    """(check, key, message): stored payload hashes that no longer match, and slots with a repeated order."""
    changed = assignments.where(~F.col("payload_sha256").eqNullSafe(payload_hash(*fields))).select(F.lit("payload_hash").alias("check"), F.concat_ws(":", "slot", "event_id").alias("key"))
    repeated = assignments.groupBy("slot", "order").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_order").alias("check"), F.concat_ws(":", F.col("slot"), F.col("order").cast("string")).alias("key"))
    return changed.unionByName(repeated).withColumn("message", F.concat(F.lit("violates "), "check"))


def evidence_warnings(rows: DataFrame, key: str) -> DataFrame:
    """(key, warnings): ordered names of what weakens an event's evidence."""
    tests = {"fallback_used": F.bool_or("fallback_required"), "few_scenes": F.min("scenes") < 2, "low_overlap": F.min("overlap") < 0.7, "partial_coverage": F.min("coverage") < 0.95, "residual_cloud": F.max("cloud") > 0.3}
    return rows.groupBy(key).agg(*[t.alias(n) for n, t in tests.items()]).select(key, F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit(False)), n) for n in tests])).alias("warnings"))


def window_bounds(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, scene_ids) used per side."""
    return scenes.groupBy(*keys).agg(F.min("acquired_at").alias("first"), F.max("acquired_at").alias("last"), F.array_join(F.array_sort(F.collect_set("scene_id")), ",").alias("scene_ids"))
