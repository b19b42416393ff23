"""Reviews, contracts, reconciliation and keyed updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import quality, raster, review, sampling, scenes
from emberline.plans.base import DETECTIONS, Book, detections
from emberline.plans.raster_plans import PIXELS, _changes
from emberline.plans.scene_plans import SCENES, _matrix, scene_candidates
from emberline.runtime import read_table
from emberline.sources import files

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

_slot = """SELECT doc_id AS event_id, CASE WHEN {q} = 0 THEN 'no' WHEN {t} = 1 THEN 'ambiguous' ELSE 'yes' END AS visible_burn_scar, CASE {k} % 4 WHEN 0 THEN 'likely' WHEN 1 THEN 'unlikely' WHEN 2 THEN 'possible' ELSE 'indeterminate' END AS event_association,
  CASE WHEN {k} % 9 = 0 THEN 'disagree' ELSE 'agree' END AS mode_agreement, CASE {k} % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS scar_confidence, CASE {k} % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'mixed' WHEN 2 THEN 'water' WHEN 3 THEN 'unknown' ELSE 'soil_exposure' END AS competing_land_change,
  CASE WHEN {k} % 6 = 0 THEN 'cloud' ELSE 'none' END AS observation_limitation, CASE {k} % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence_after, {k} % 13 = 0 AS reviewer_requested_adjudication FROM labels"""
_a = _slot.format(q="quality", t="toxic", k="doc_id")
_b = _slot.format(q="CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END", t="toxic", k="(doc_id + doc_id % 3)")
SLOTS = f"ra AS ({_a}), rb AS ({_b})"


def slot(spark, sf_dir, second=False):
    k = F.col("doc_id") + (F.col("doc_id") % 3 if second else 0)
    q = F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")) if second else F.col("quality")
    pick = lambda mod, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.least(k % mod, F.lit(len(names) - 1)) + 1).cast("int"))
    return read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("event_id"), F.when(q == 0, "no").when(F.col("toxic") == 1, "ambiguous").otherwise("yes").alias("visible_burn_scar"), pick(4, "likely", "unlikely", "possible", "indeterminate").alias("event_association"),
        F.when(k % 9 == 0, "disagree").otherwise("agree").alias("mode_agreement"), pick(3, "high", "medium", "low").alias("scar_confidence"), pick(5, "none", "mixed", "water", "unknown", "soil_exposure").alias("competing_land_change"),
        F.when(k % 6 == 0, "cloud").otherwise("none").alias("observation_limitation"), pick(7, "high", "medium", "low").alias("confidence_after"), (k % 13 == 0).alias("reviewer_requested_adjudication"),
    )


_fields = ["visible_burn_scar", "event_association", "mode_agreement"]
_minor = ["scar_confidence", "competing_land_change", "observation_limitation", "confidence_after"]
_diff = lambda names: "list_sort(list_filter([" + ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in names) + "], lambda x: x IS NOT NULL))"
PAIRS = f"""{SLOTS}, pair AS (SELECT a.event_id, {_diff(_fields)} AS material, {_diff(_minor)} AS nonmaterial, list_filter([CASE WHEN a.mode_agreement = 'disagree' OR b.mode_agreement = 'disagree' THEN 'interreview_mode_disagreement' END,
  CASE WHEN a.visible_burn_scar <> b.visible_burn_scar THEN 'interreview_visible_disagreement' END], lambda x: x IS NOT NULL) AS reasons FROM ra a JOIN rb b USING (event_id))"""


@BOOK.query(f"WITH {PAIRS} SELECT event_id, array_to_string(material, ',') AS material, array_to_string(nonmaterial, ',') AS nonmaterial, array_to_string(reasons, ',') AS reason_codes, len(material) > 0 OR len(reasons) > 0 AS needs_adjudication FROM pair")
def review_pairs(spark, sf_dir):
    out = review.reviewer_pairs(slot(spark, sf_dir), slot(spark, sf_dir, True))
    return out.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("material", "nonmaterial", "reason_codes")], "needs_adjudication")


_triage = f"""WITH {PAIRS}, t AS (
  SELECT a.*, list_sort(list_distinct(list_concat(list_filter([CASE WHEN a.visible_burn_scar = 'ambiguous' THEN 'ambiguous_observation' END, CASE WHEN a.scar_confidence = 'low' THEN 'low_confidence' END, CASE WHEN a.event_association = 'indeterminate' THEN 'indeterminate_association' END,
      CASE WHEN a.mode_agreement = 'disagree' THEN 'mode_disagreement' END, CASE WHEN a.reviewer_requested_adjudication THEN 'structured_reviewer_request' END, CASE WHEN len(material) > 0 THEN 'material_interreview_disagreement' END], lambda x: x IS NOT NULL), reasons))) AS codes,
    list_sort(list_filter([CASE WHEN a.confidence_after <> a.scar_confidence THEN 'confidence_changed_between_passes' END, CASE WHEN b.scar_confidence <> a.scar_confidence THEN 'persistent_interreview_confidence_difference' END, CASE WHEN len(nonmaterial) > 0 THEN 'persistent_nonmaterial_interreview_difference' END,
      CASE WHEN a.event_association IN ('likely', 'possible') AND a.competing_land_change IN ('mixed', 'unknown') THEN 'determined_association_with_strong_competitor' END, CASE WHEN a.competing_land_change IN ('mixed', 'unknown') THEN 'strong_competing_surface=' || a.competing_land_change END,
      CASE WHEN a.competing_land_change IN ('water', 'soil_exposure') THEN 'competing_surface=' || a.competing_land_change END, CASE WHEN a.observation_limitation <> 'none' THEN 'observation_limitation=' || a.observation_limitation END], lambda x: x IS NOT NULL)) AS expert
  FROM ra a JOIN pair USING (event_id) JOIN rb b USING (event_id))
SELECT event_id, len(codes) > 0 AS needs_adjudication, array_to_string(codes, ',') AS adjudication_codes, CASE WHEN len(expert) > 0 THEN 'recommended' ELSE 'none' END AS expert_priority, array_to_string(expert, ',') AS expert_codes,
  CASE WHEN len(codes) > 0 THEN 'pending_adjudication' WHEN len(expert) > 0 THEN 'pending_expert_review' ELSE 'pending' END AS status FROM t"""


def _triaged(spark, sf_dir):
    a, b = slot(spark, sf_dir), slot(spark, sf_dir, True)
    return review.triage(a, review.reviewer_pairs(a, b), b)


@BOOK.query(_triage)
def triage(spark, sf_dir):
    return _triaged(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("adjudication_codes", "expert_codes")})


@BOOK.query(f"WITH c AS ({_triage}) SELECT s AS status, (SELECT count(*) FROM c WHERE status = s) AS items FROM (SELECT unnest(['pending', 'pending_adjudication', 'pending_expert_review', 'complete']) AS s)")
def status_counts(spark, sf_dir):
    return review.status_counts(_triaged(spark, sf_dir), ["pending", "pending_adjudication", "pending_expert_review", "complete"])


@BOOK.query(f"""WITH {SLOTS} SELECT d.doc_id AS event_id, CASE WHEN a.event_id IS NULL THEN 'pending' WHEN a.event_id % 4 = 0 THEN 'complete' ELSE 'started' END AS status FROM documents d LEFT JOIN ra a ON a.event_id = d.doc_id""")
def item_status(spark, sf_dir):
    items = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    reviews = slot(spark, sf_dir).withColumn("status", F.when(F.col("event_id") % 4 == 0, "complete").otherwise("started"))
    return review.with_status(items, reviews, "event_id")


@BOOK.query(f"""WITH {SLOTS} SELECT event_id, unnest(['visible_burn_scar', 'event_association', 'scar_confidence']) AS field, unnest([a.visible_burn_scar, a.event_association, a.scar_confidence]) AS old, unnest([b.visible_burn_scar, b.event_association, b.scar_confidence]) AS new
  FROM ra a JOIN rb b USING (event_id) QUALIFY old IS DISTINCT FROM new""".replace("SELECT event_id, unnest", "SELECT * FROM (SELECT event_id, unnest").replace(" QUALIFY old IS DISTINCT FROM new", ") WHERE old IS DISTINCT FROM new"))
def field_changes(spark, sf_dir):
    return review.field_changes(slot(spark, sf_dir), slot(spark, sf_dir, True), "event_id", ["visible_burn_scar", "event_association", "scar_confidence"])


@BOOK.query(f"""WITH {SLOTS} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'complete' ELSE 'started' END AS status, CASE WHEN event_id % 4 = 0 THEN visible_burn_scar ELSE '' END AS visible_burn_scar, CASE WHEN event_id % 4 = 0 THEN scar_confidence ELSE '' END AS scar_confidence,
  mode_agreement || ' | ' || observation_limitation AS notes FROM ra""")
def export_layout(spark, sf_dir):
    rows = slot(spark, sf_dir).withColumn("status", F.when(F.col("event_id") % 4 == 0, "complete").otherwise("started"))
    return review.export_layout(rows, ["visible_burn_scar", "scar_confidence"], ["mode_agreement", "observation_limitation"])


@BOOK.query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'complete' ELSE 'pending' END AS status, CASE WHEN quality = 1 THEN 'yes' ELSE '' END AS v, CASE WHEN doc_id % 7 = 0 THEN 'odd' WHEN doc_id % 2 = 0 THEN 'high' ELSE '' END AS c, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'r1' END AS reviewer, doc_id % 6 AS revision FROM labels),
t AS (SELECT doc_id, unnest([CASE WHEN c NOT IN ('', 'high') THEN 'scar_confidence_code' END, CASE WHEN status = 'complete' AND reviewer = '' THEN 'reviewed_needs_reviewer' END, CASE WHEN status = 'complete' AND doc_id % 4 = 0 THEN 'reviewed_needs_time' END, CASE WHEN status = 'pending' AND v <> '' THEN 'pending_is_blank' END,
  CASE WHEN revision < 1 THEN 'revision_positive' END, CASE WHEN v = 'yes' AND c = '' THEN 'scar_needs_confidence' END]) AS "check" FROM r) SELECT "check", CAST(doc_id AS VARCHAR) AS key, 'violates ' || "check" AS message FROM t WHERE "check" IS NOT NULL""")
def review_contract(spark, sf_dir):
    k = F.col("doc_id")
    rows = read_table(spark, sf_dir, "labels").select(
        k.alias("event_id"), F.when(k % 3 == 0, "complete").otherwise("pending").alias("status"), F.when(F.col("quality") == 1, "yes").otherwise("").alias("visible_burn_scar"), F.when(k % 7 == 0, "odd").when(k % 2 == 0, "high").otherwise("").alias("scar_confidence"),
        F.when(k % 5 == 0, "").otherwise("r1").alias("reviewer"), F.when(k % 4 != 0, F.lit("2025-01-01").cast("timestamp")).alias("reviewed_at"), (k % 6).alias("revision"),
    )
    return review.state_violations(rows, {"scar_confidence": ("high", "medium", "low")})


@BOOK.query("""WITH o AS (SELECT o_orderkey AS path, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), l AS (SELECT l_orderkey AS path, count(*) AS n FROM lineitem GROUP BY 1), n AS (SELECT path, CASE WHEN n > 4 THEN v + 1 ELSE v END AS v FROM (SELECT o_orderkey AS path, o_totalprice AS v FROM orders) JOIN l USING (path))
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (path)""")
def snapshot_diff(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("v"))
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    after = orders.join(lines, "path").select("path", F.when(F.col("n") > 4, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return quality.snapshot_diff(orders.where("path % 7 <> 0"), after, "path", "v")


_man = """man AS (SELECT o_orderkey AS path, sha256(o_orderpriority) AS sha256, o_custkey AS size_bytes, CAST(5 AS BIGINT) AS record_count FROM orders WHERE o_orderkey % 10 <> 0),
raw AS (SELECT o_orderkey AS path, sha256(CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE o_orderpriority END) AS sha256, o_custkey + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 5 END AS record_count FROM orders WHERE o_orderkey % 11 <> 0)"""


@BOOK.query(f"""WITH {_man} SELECT coalesce(r.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'not_in_manifest' WHEN r.path IS NULL THEN 'no_file' WHEN r.sha256 <> m.sha256 THEN 'hash_differs' WHEN r.size_bytes <> m.size_bytes THEN 'size_differs' WHEN r.record_count <> m.record_count THEN 'count_differs' ELSE 'matches' END AS verdict
  FROM raw r FULL JOIN man m USING (path)""")
def file_reconciliation(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = read_table(spark, sf_dir, "orders")
    manifest = orders.where(k % 10 != 0).select(k.alias("path"), F.sha2("o_orderpriority", 256).alias("sha256"), F.col("o_custkey").alias("size_bytes"), F.lit(5).cast("long").alias("record_count"))
    raw = orders.where(k % 11 != 0).select(k.alias("path"), F.sha2(F.when(k % 9 == 0, "x").otherwise(F.col("o_orderpriority")), 256).alias("sha256"), (F.col("o_custkey") + F.when(k % 8 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k % 7 == 0, 4).otherwise(5).cast("long").alias("record_count"))
    return quality.reconcile_files(raw, manifest)


@BOOK.query("SELECT h AS sha256, string_agg(p, ',' ORDER BY p) AS paths FROM (SELECT sha256(text) AS h, CAST(doc_id AS VARCHAR) AS p FROM documents) GROUP BY 1 HAVING count(*) > 1")
def identical_contents(spark, sf_dir):
    raw = read_table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("path"))
    return quality.identical_contents(raw).withColumn("paths", F.array_join("paths", ","))


@BOOK.query("""WITH e AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS price, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1), a AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 + CASE WHEN l_linenumber = 3 THEN 0.00001 ELSE 0 END)) AS price, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(count(*) FILTER (l_quantity > 2) AS DOUBLE) END AS n FROM lineitem GROUP BY 1),
l AS (SELECT k, 'price' AS metric, abs(a.price - e.price) AS gap, e.price AS x, 0.3 AS tol FROM e JOIN a USING (k) UNION ALL SELECT k, 'n', abs(a.n - e.n), e.n, 0.0 FROM e JOIN a USING (k))
SELECT k, metric, CASE WHEN gap IS NULL THEN 'not_comparable' WHEN gap <= tol THEN 'pass' ELSE 'fail' END AS status, round(gap, 4) AS absolute, round(gap / x, 8) AS relative FROM l""")
def metric_reconcile(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey"))
    price = F.col("l_extendedprice")
    expected = lines.groupBy("k").agg(F.sum(price).alias("price"), F.count(F.lit(1)).alias("n"))
    actual = lines.groupBy("k").agg(F.sum(price * (1 + F.when(F.col("l_linenumber") == 3, 0.00001).otherwise(0.0))).alias("price"), F.count_if(F.col("l_quantity") > 2).alias("n")).withColumn("n", F.when(F.col("k") % 5 != 0, F.col("n")))
    out = quality.reconcile_metrics(expected, actual, ["k"], {"price": 0.3, "n": 0.0})
    return out.withColumns({"absolute": F.round("absolute", 4), "relative": F.round("relative", 8)})


@BOOK.query(f"""WITH {PIXELS}, m AS (SELECT zone, side, median(nbr) AS a, avg(nbr) AS b FROM px WHERE zone <> 3 OR side = 1 GROUP BY ALL) SELECT zone, CASE WHEN count(*) < 2 THEN 'not_comparable' WHEN max(a) - min(a) <= 0.01 AND max(b) - min(b) <= 0.01 THEN 'agree' ELSE 'disagree' END AS agreement FROM m GROUP BY 1""")
def mode_agreement(spark, sf_dir):
    from emberline.plans.raster_plans import pixels

    rows = pixels(spark, sf_dir).where("zone <> 3 or side = 1").groupBy("zone", "side").agg(F.median("nbr").alias("a"), F.avg("nbr").alias("b"))
    return quality.mode_agreement(rows, "zone", "side", ["a", "b"], 0.01)


_POS, _NEG = "(^|[ ,])(the|der|los)([ ,]|$)", "(^|[ ,])(and|und|en)([ ,]|$)"


@BOOK.query(f"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?;:\\n]')) AS sentence FROM documents) SELECT doc_id, trim(sentence) AS sentence FROM s WHERE regexp_matches(sentence, '{_POS}') AND NOT regexp_matches(sentence, '{_NEG}')""")
def claim_scan(spark, sf_dir):
    return quality.text_claims(read_table(spark, sf_dir, "documents"), "doc_id", "text", _POS, _NEG)


@BOOK.query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[a-z0-9.-]+')) AS hits FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[a-z0-9.-]+')")
def private_scan(spark, sf_dir):
    out = quality.private_texts(read_table(spark, sf_dir, "documents"), "doc_id", "text", r"[A-Za-z0-9._-]+@[a-z0-9.-]+")
    return out.withColumn("hits", F.col("hits").cast("long"))


@BOOK.query("SELECT event_id, unnest(list_filter([CASE WHEN regexp_matches(props, '\"k\"\\s*:') THEN 'k' END, CASE WHEN regexp_matches(props, '\"geometry\"\\s*:') THEN 'geometry' END], lambda x: x IS NOT NULL)) AS name FROM events")
def forbidden_keys(spark, sf_dir):
    return quality.forbidden_json_keys(read_table(spark, sf_dir, "events"), "event_id", "props", ["k", "geometry"])


@BOOK.query(f"""WITH {DETECTIONS}, d AS (SELECT *, CASE WHEN detection_id LIKE '%7' THEN -frp ELSE frp END AS f, CASE WHEN detection_id LIKE '%13' THEN 95.0 ELSE lat END AS la, CASE WHEN detection_id LIKE '%00' THEN 'd00000001' ELSE detection_id END AS id FROM det),
v AS (SELECT 'power_not_negative' AS "check", id AS key FROM d WHERE f < 0 UNION ALL SELECT 'latitude_range', id FROM d WHERE la > 90 UNION ALL SELECT 'repeated_detection', id FROM d GROUP BY id HAVING count(*) > 1) SELECT "check", key, 'violates ' || "check" AS message FROM v""")
def detection_contract(spark, sf_dir):
    d = detections(spark, sf_dir)
    i = F.col("detection_id")
    rows = d.withColumns({"frp": F.when(i.endswith("7"), -F.col("frp")).otherwise(F.col("frp")), "lat": F.when(i.endswith("13"), 95.0).otherwise(F.col("lat"))}).withColumn("detection_id", F.when(i.endswith("00"), "d00000001").otherwise(i))
    return quality.detection_checks(rows)


@BOOK.query(f"""WITH {SCENES}, m AS (SELECT event_id, combination_id, rule_id FROM matrix WHERE NOT (event_id % 10 = 3 AND rule_id = 'B') UNION ALL SELECT event_id, combination_id, rule_id FROM matrix WHERE event_id % 20 = 1 AND rule_id = 'C'),
v AS (SELECT 'missing_key' AS "check", event_id, combination_id, rule_id FROM matrix WHERE event_id % 10 = 3 AND rule_id = 'B' UNION ALL SELECT 'repeated_cell', event_id, combination_id, rule_id FROM m GROUP BY ALL HAVING count(*) > 1)
SELECT "check", CAST(event_id AS VARCHAR) || '|' || combination_id || '|' || rule_id AS key, 'violates ' || "check" AS message FROM v""")
def grain_contract(spark, sf_dir):
    matrix = _matrix(spark, sf_dir).select("event_id", "combination_id", "rule_id")
    rows = matrix.where("not (event_id % 10 = 3 and rule_id = 'B')").unionByName(matrix.where("event_id % 20 = 1 and rule_id = 'C'"))
    return quality.grain_checks(rows, {"event_id": matrix.select("event_id").distinct(), "combination_id": matrix.select("combination_id").distinct(), "rule_id": scenes.rules_frame(spark).select("rule_id")})


@BOOK.query(f"""WITH {SCENES}, r AS (SELECT *, event_id % 9 = 0 AS spoiled FROM matrix), v AS (
  SELECT unnest([CASE WHEN spoiled AND pre_usable > 0 THEN 'pre_usable_within_total' END, CASE WHEN spoiled AND pre_usable > 0 AND post_usable > 0 THEN NULL END, CASE WHEN pre_scene IS NOT NULL AND CAST(substr(pre_scene, 2) AS BIGINT) % 40 = 0 THEN 'chosen_scene_known' END, CASE WHEN post_scene IS NOT NULL AND CAST(substr(post_scene, 2) AS BIGINT) % 40 = 0 THEN 'chosen_scene_known' END]) AS "check",
    CAST(event_id AS VARCHAR) || '|' || combination_id || '|' || rule_id AS key FROM r) SELECT "check", key, 'violates ' || "check" AS message FROM v WHERE "check" IS NOT NULL""")
def observability_contract(spark, sf_dir):
    matrix = _matrix(spark, sf_dir)
    rows = matrix.withColumn("pre_scenes", F.when((F.col("event_id") % 9 == 0) & (F.col("pre_usable") > 0), F.lit(0)).otherwise(F.col("pre_scenes")))
    known = scene_candidates(spark, sf_dir).select("scene_id").where(F.substring("scene_id", 2, 20).cast("long") % 40 != 0)
    return quality.observability_checks(rows, known)


@BOOK.query(f"""WITH {PIXELS}, z AS (SELECT zone, count(*) AS aoi, count(dnbr) AS common, quantile_cont(dnbr, 0.1) AS p10, median(dnbr) AS md FROM chg GROUP BY 1)
SELECT unnest(list_filter([CASE WHEN zone % 3 = 0 THEN 'fraction_is_ratio' END, CASE WHEN zone % 4 = 1 AND p10 < md - 1e-9 THEN 'percentiles_ordered' END], lambda x: x IS NOT NULL)) AS "check", CAST(zone AS VARCHAR) AS key FROM z""")
def metric_contract(spark, sf_dir):
    stats = raster.zonal_statistics(_changes(spark, sf_dir), ["zone"])
    spoiled = stats.withColumns({"valid_overlap_fraction": F.when(F.col("zone") % 3 == 0, F.col("valid_overlap_fraction") + 0.01).otherwise(F.col("valid_overlap_fraction")), "dnbr_median": F.when(F.col("zone") % 4 == 1, F.col("dnbr_p10") - 0.001).otherwise(F.col("dnbr_median"))})
    return quality.metric_checks(spoiled, "zone").select("check", "key")


@BOOK.query("""SELECT 'expected_count' AS "check", CAST(l_orderkey AS VARCHAR) AS key FROM (SELECT l_orderkey, count(*) AS n, max(l_linenumber) + CASE WHEN l_orderkey % 10 = 4 THEN 1 ELSE 0 END AS e FROM lineitem GROUP BY 1) WHERE n <> e
  UNION ALL SELECT 'expected_count', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def count_contract(spark, sf_dir):
    """Lines of every order against the number its last line states, spoiled for some; orders without lines are off as well."""
    lines = read_table(spark, sf_dir, "lineitem")
    stated = lines.groupBy("l_orderkey").agg((F.max("l_linenumber") + F.when(F.col("l_orderkey") % 10 == 4, 1).otherwise(0)).cast("long").alias("expected"))
    without = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(lines.select("l_orderkey").distinct(), "l_orderkey", "left_anti").withColumn("expected", F.lit(1).cast("long"))
    return quality.expected_counts(lines, "l_orderkey", stated.unionByName(without)).select("check", "key")


@BOOK.query("""SELECT 'missing_key' AS "check", CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'not_in_superset', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0)
  UNION ALL SELECT 'in_both', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'exactly_one', CAST(c_custkey AS VARCHAR) FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) <> 1""")
def key_contract(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    customers, orders = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    checks = [
        quality.same_keys(customers, orders, ["k"]), quality.subset(t("lineitem").select(F.col("l_orderkey").alias("k")), t("orders").where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("k")), "k"),
        quality.disjoint(t("supplier").select(F.col("s_suppkey").alias("k")), t("nation").select(F.col("n_nationkey").cast("long").alias("k")), "k"), quality.exactly_one(customers, orders, "k"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("check", "key")


@BOOK.query("""WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 0 THEN 'machine' WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'model' END AS profile, CASE WHEN c_custkey % 3 = 0 THEN 'm1' ELSE '' END AS model FROM customer)
SELECT unnest(list_filter([CASE WHEN profile = 'human' AND model <> '' THEN 'human_with_model' END, CASE WHEN profile = 'model' AND model = '' THEN 'model_without_name' END, CASE WHEN profile = 'machine' THEN 'unknown_profile' END], lambda x: x IS NOT NULL)) AS "check", CAST(k AS VARCHAR) AS key FROM r""")
def provenance_contract(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select(k.alias("event_id"), F.when(k % 8 == 0, "machine").when(k % 2 == 0, "human").otherwise("model").alias("profile"), F.when(k % 3 == 0, "m1").otherwise("").alias("model"))
    return review.provenance_violations(rows).select("check", "key")


@BOOK.query("""WITH d AS (SELECT slot, 'c' || CAST(c_custkey AS VARCHAR) AS event_id FROM customer, (VALUES ('A'), ('B')) t(slot)), h AS (SELECT *, sha256('round1' || chr(0) || 'p1' || chr(0) || slot || chr(0) || '77' || chr(0) || event_id) AS digest FROM d),
r AS (SELECT slot, event_id, row_number() OVER (PARTITION BY slot ORDER BY digest, event_id) AS n FROM h)
SELECT 'payload_hash' AS "check", slot || ':' || event_id AS key, 'violates payload_hash' AS message FROM r WHERE n % 50 = 0 UNION ALL SELECT 'repeated_order', slot || ':' || CAST(n - 1 AS VARCHAR), 'violates repeated_order' FROM r WHERE n % 50 = 0""")
def assignment_contract(spark, sf_dir):
    items = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("event_id"))
    rows = sampling.blind_order(items, ["A", "B"], 77, "round1", "p1").withColumn("payload_sha256", review.payload_hash("slot", "order", "event_id"))
    spoiled = rows.withColumn("order", F.when(F.col("order") % 50 == 0, F.col("order") - 1).otherwise(F.col("order")))
    return review.assignment_violations(spoiled, ["slot", "order", "event_id"])


@BOOK.query(f"""WITH {SCENES}, w AS (SELECT event_id, bool_or(combination_id <> 'b0500_pre30_post45' AND status = 'usable_both') AS f, min(pre_usable) < 2 AS s, min(pre_coverage) < 0.95 AS c FROM matrix WHERE rule_id = 'A' GROUP BY 1)
SELECT event_id, array_to_string(list_filter([CASE WHEN f THEN 'fallback_used' END, CASE WHEN s THEN 'few_scenes' END, CASE WHEN c THEN 'partial_coverage' END], lambda x: x IS NOT NULL), ',') AS warnings FROM w""")
def evidence_warnings(spark, sf_dir):
    m = _matrix(spark, sf_dir).where("rule_id = 'A'")
    rows = m.select("event_id", ((F.col("combination_id") != "b0500_pre30_post45") & (F.col("status") == "usable_both")).alias("fallback_required"), F.col("pre_usable").alias("scenes"), F.lit(1.0).alias("overlap"), F.col("pre_coverage").alias("coverage"), F.lit(0.0).alias("cloud"))
    return review.evidence_warnings(rows, "event_id").withColumn("warnings", F.array_join("warnings", ","))


@BOOK.query(f"""WITH {SCENES} SELECT event_id, role, CAST(CAST(min(acquired_at) AS DATE) AS VARCHAR) AS first, CAST(CAST(max(acquired_at) AS DATE) AS VARCHAR) AS last, array_to_string(list_sort(list_distinct(list(scene_id))), ',') AS scene_ids FROM cand GROUP BY ALL""")
def window_bounds(spark, sf_dir):
    out = review.window_bounds(scene_candidates(spark, sf_dir), ["event_id", "role"])
    return out.withColumns({c: F.col(c).cast("date").cast("string") for c in ("first", "last")})


@BOOK.query(f"""WITH {PIXELS} SELECT c_custkey, round(md, 6) AS dnbr_median, '' AS answer FROM customer LEFT JOIN (SELECT zone, median(dnbr) AS md FROM chg GROUP BY 1) ON zone = c_custkey""")
def work_queue(spark, sf_dir):
    metrics = raster.zonal_statistics(_changes(spark, sf_dir), ["zone"]).select(F.col("zone").cast("long").alias("c_custkey"), F.round("dnbr_median", 6).alias("dnbr_median"))
    return review.review_queue(read_table(spark, sf_dir, "customer").select("c_custkey"), metrics, "c_custkey", ["dnbr_median"], ["answer"])


@BOOK.query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_totalprice * 2 FROM orders WHERE o_custkey % 10 = 0 AND o_orderkey % 2 = 0""")
def keyed_replace(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = orders.where("o_custkey % 10 = 0 and o_orderkey % 2 = 0").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return files.keyed_replace(orders, new, orders.where("o_custkey % 10 = 0"), ["o_custkey"])


_ledger = "led AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'v1' ELSE 'v2' END AS version FROM orders WHERE o_orderkey % 3 = 0)"


def _ledger_of(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = read_table(spark, sf_dir, "orders").select(k.alias("k"))
    ledger = orders.where("k % 3 = 0").select("k", F.when(F.col("k") % 9 == 0, "failed").otherwise("completed").alias("status"), F.when(F.col("k") % 4 == 0, "v1").otherwise("v2").alias("version"))
    return orders, ledger


@BOOK.query(f"WITH {_ledger} SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT k FROM led WHERE version = 'v2')")
def pending_work(spark, sf_dir):
    return files.pending(*_ledger_of(spark, sf_dir), "k", "v2")


@BOOK.query(f"WITH {_ledger} SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS pending FROM orders LEFT JOIN (SELECT * FROM led WHERE version = 'v2') ON k = o_orderkey")
def run_report(spark, sf_dir):
    return files.run_report(*_ledger_of(spark, sf_dir), "k", "v2")


@BOOK.query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def cache_reuse(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    signed = lambda d: d.withColumn("signature", files.signature("o_orderkey", "o_totalprice", "o_orderpriority")).select("o_orderkey", "signature")
    cache = signed(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    return files.reusable(signed(orders), cache, "o_orderkey").select("o_orderkey")


@BOOK.query("SELECT sha256(string_agg(k, chr(10) ORDER BY k)) AS sha256 FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders)")
def set_fingerprint(spark, sf_dir):
    return files.set_fingerprint(read_table(spark, sf_dir, "orders"), "o_custkey")


@BOOK.query(f"WITH {DETECTIONS} SELECT detection_id, printf('evt-%04d', row_number() OVER (ORDER BY detection_id)) AS public_id, round(lon, 6) AS longitude, round(lat, 6) AS latitude FROM det")
def public_rows(spark, sf_dir):
    from emberline.operators.ranking import blocked

    det = detections(spark, sf_dir)
    ranked = blocked(det.select("detection_id", "lon", "lat"), [], F.substring("detection_id", 1, 6), [F.col("detection_id")], rank="r")
    return ranked.select("detection_id", F.format_string("evt-%04d", F.col("r") + 1).alias("public_id"), F.round("lon", 6).alias("longitude"), F.round("lat", 6).alias("latitude"))


@BOOK.query("SELECT event_id, event_type, value FROM events WHERE contains(lower(event_type), 'ch') AND value > 100")
def event_filter(spark, sf_dir):
    return read_table(spark, sf_dir, "events").where(F.contains(F.lower("event_type"), F.lit("ch")) & (F.col("value") > 100)).select("event_id", "event_type", "value")
