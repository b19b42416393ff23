"""Pixels: indices, composites, zonal statistics, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import polygons, raster, scenes
from emberline.plans.base import DETECTIONS, Book, detections
from emberline.plans.event_plans import _rounded
from emberline.runtime import read_table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

PIXELS = """pos AS (SELECT vec_id, label, unnest(embedding) AS e0, unnest(range(64)) AS p FROM embeddings),
px AS (SELECT vec_id AS scene_id, label AS zone, vec_id % 2 AS side, vec_id % 3 AS period, CAST(p // 8 AS INTEGER) AS row, CAST(p % 8 AS INTEGER) AS col, CAST(p AS INTEGER) AS p, 0.5 + CAST(e0 AS DOUBLE) AS b8, 0.5 - CAST(e0 AS DOUBLE) / 2 AS b12,
  CASE WHEN (vec_id + p) % 29 <> 0 THEN (vec_id * 7 + p * 13) % 100 / 100.0 END AS cs_cdf, CASE WHEN b8 + b12 <> 0 THEN (b8 - b12) / (b8 + b12) END AS nbr FROM pos),
ok AS (SELECT *, coalesce(cs_cdf >= 0.3, false) AS ok FROM px),
comp AS (SELECT zone, side, row, col, median(b8) FILTER (ok) AS b8, median(b12) FILTER (ok) AS b12 FROM ok GROUP BY ALL),
chg AS (SELECT a.zone, a.row, a.col, (a.b8 - a.b12) / (a.b8 + a.b12) AS pre_nbr, (b.b8 - b.b12) / (b.b8 + b.b12) AS post_nbr, pre_nbr - post_nbr AS dnbr FROM comp a JOIN comp b USING (zone, row, col) WHERE a.side = 0 AND b.side = 1)"""


def pixels(spark, sf_dir):
    p, v = F.col("p"), F.col("vec_id")
    base = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    b8, b12 = F.lit(0.5) + F.col("e").cast("double"), F.lit(0.5) - F.col("e").cast("double") / 2
    return base.select(
        v.alias("scene_id"), F.col("label").alias("zone"), (v % 2).alias("side"), (v % 3).alias("period"), F.floor(p / 8).cast("int").alias("row"), (p % 8).cast("int").alias("col"), "p", b8.alias("b8"), b12.alias("b12"),
        F.when((v + p) % 29 != 0, (v * 7 + p * 13) % 100 / 100.0).alias("cs_cdf"),
    ).withColumn("nbr", raster.nbr(F.col("b8"), F.col("b12")))


def _changes(spark, sf_dir):
    comp = raster.median_composite(raster.masked(pixels(spark, sf_dir), 0.3), ["zone", "side"], ["b8", "b12"])
    return raster.change(comp.where("side = 0"), comp.where("side = 1"), ["zone"])


@BOOK.query(f"""WITH {PIXELS} SELECT scene_id, row, col, round(nbr, 6) AS nbr, round(CASE WHEN greatest(b8, 0) + greatest(b12, 0) > 0.02 THEN (greatest(b8, 0) - greatest(b12, 0)) / (greatest(b8, 0) + greatest(b12, 0)) END, 6) AS guarded, coalesce(cs_cdf >= 0.3, false) AS valid, p % 12 IN (4, 5, 6, 7, 11) AS clear FROM px""")
def nbr_pixels(spark, sf_dir):
    b8, b12 = F.col("b8"), F.col("b12")
    return pixels(spark, sf_dir).select("scene_id", "row", "col", F.round("nbr", 6).alias("nbr"), F.round(raster.guarded_nbr(b8, b12), 6).alias("guarded"), raster.valid_pixel(0.3).alias("valid"), raster.clear_class(F.col("p") % 12).alias("clear"))


@BOOK.query(f"WITH {PIXELS} SELECT zone, row, col, round(pre_nbr, 6) AS pre_nbr, round(post_nbr, 6) AS post_nbr, round(dnbr, 6) AS dnbr FROM chg")
def nbr_dnbr(spark, sf_dir):
    return _rounded(_changes(spark, sf_dir))


@BOOK.query(f"WITH {PIXELS} SELECT zone, side, row, col, round(b8, 6) AS b8, round(b12, 6) AS b12 FROM comp")
def median_composite(spark, sf_dir):
    return _rounded(raster.median_composite(raster.masked(pixels(spark, sf_dir), 0.3), ["zone", "side"], ["b8", "b12"]))


@BOOK.query(f"""WITH {PIXELS} SELECT zone, count(*) AS aoi_px, count(dnbr) AS common_px, round(avg(dnbr), 6) AS dnbr_mean, round(quantile_cont(dnbr, 0.1), 6) AS dnbr_p10, round(median(dnbr), 6) AS dnbr_median, round(quantile_cont(dnbr, 0.95), 6) AS dnbr_p95,
  round(count(*) FILTER (dnbr > 0.1) / count(dnbr), 6) AS fraction_gt_010, count(*) FILTER (dnbr > 0.27) * 400.0 / 1e4 AS area_ha_gt_027, round(count(dnbr) / count(*), 6) AS valid_overlap_fraction FROM chg GROUP BY zone""")
def zonal_stats(spark, sf_dir):
    return _rounded(raster.zonal_statistics(_changes(spark, sf_dir), ["zone"]).select("zone", "aoi_px", "common_px", "dnbr_mean", "dnbr_p10", "dnbr_median", "dnbr_p95", "fraction_gt_010", "area_ha_gt_027", "valid_overlap_fraction"))


@BOOK.query(f"""WITH {PIXELS}, s AS (SELECT scene_id, zone, count(*) AS n, count(*) FILTER (ok) AS good, median(nbr) FILTER (ok) AS m FROM ok GROUP BY ALL), r AS (SELECT *, good / n + CASE WHEN scene_id % 50 = 7 THEN 0.9 ELSE 0 END AS f FROM s)
SELECT scene_id, CASE WHEN f > 1 + 1e-9 THEN 'rejected' WHEN good = 0 THEN 'no_common_pixels' WHEN f < 0.7 THEN 'insufficient_overlap' ELSE 'usable_overlap' END AS status, CASE WHEN f <= 1 + 1e-9 AND good > 0 AND f >= 0.7 THEN round(m, 6) END AS median FROM r""")
def gated_metrics(spark, sf_dir):
    ok = raster.valid_pixel(0.3)
    rows = pixels(spark, sf_dir).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("common_px"), F.median(F.when(ok, F.col("nbr"))).alias("median"))
    rows = rows.withColumn("valid_overlap_fraction", F.col("common_px") / F.col("n") + F.when(F.col("scene_id") % 50 == 7, 0.9).otherwise(0.0))
    return raster.gated_metrics(rows, ["median"], 0.7).select("scene_id", "status", F.round("median", 6).alias("median"))


@BOOK.query(f"""WITH {PIXELS}, c AS (SELECT scene_id FROM ok GROUP BY 1 HAVING count(*) FILTER (ok) / count(*) >= 0.68), m AS (SELECT period, row, col, median(CASE WHEN ok THEN nbr END) AS nbr FROM ok JOIN c USING (scene_id) GROUP BY ALL)
SELECT period, row, col, round(nbr, 6) AS nbr, round(lag(nbr) OVER (PARTITION BY row, col ORDER BY period) - nbr, 6) AS drop FROM m""")
def period_medians(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("nbr", F.when(raster.valid_pixel(0.3), F.col("nbr")))
    return _rounded(raster.period_differences(raster.period_median(rows, 0.68)))


@BOOK.query(f"""WITH {PIXELS}, l AS (SELECT unnest(['b8', 'b12', 'cs_cdf']) AS band, unnest([b8, b12, cs_cdf]) AS v FROM px WHERE cs_cdf IS NOT NULL) SELECT band, round(quantile_cont(v, 0.02), 6) AS low, round(quantile_cont(v, 0.98), 6) AS high FROM l GROUP BY 1""")
def global_stretch(spark, sf_dir):
    return _rounded(raster.global_stretch(pixels(spark, sf_dir).withColumn("cs_cdf", F.col("cs_cdf").cast("double")), ["b8", "b12", "cs_cdf"]))


@BOOK.query(f"WITH {PIXELS} SELECT scene_id, row, col, CAST(round(255 * sqrt(least(1.0, greatest(0.0, (b8 - 0.2) / 0.6)))) AS INTEGER) AS v FROM px")
def byte_stretch(spark, sf_dir):
    return pixels(spark, sf_dir).select("scene_id", "row", "col", raster.to_byte(F.col("b8"), F.lit(0.2), F.lit(0.8), 2.0).alias("v"))


@BOOK.query(f"""WITH {PIXELS} SELECT scene_id, count(*) AS pixels, count(cs_cdf) AS joint_px, round(avg(cs_cdf), 6) AS score_mean, round(median(cs_cdf), 6) AS score_median, round(count(*) FILTER (cs_cdf >= 0.5) / count(cs_cdf), 6) AS clear_050, round(count(*) FILTER (cs_cdf >= 0.65) / count(cs_cdf), 6) AS clear_065 FROM px GROUP BY 1""")
def scene_statistics(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("cs_cdf", F.col("cs_cdf").cast("double"))
    return _rounded(scenes.scene_statistics(rows, ["scene_id"], (0.5, 0.6, 0.65)).select("scene_id", "pixels", "joint_px", "score_mean", "score_median", "clear_050", "clear_065"))


@BOOK.query(f"WITH {PIXELS} SELECT zone, row, col, min_by(scene_id, scene_id) AS scene_id, round(min_by(nbr, scene_id), 6) AS nbr FROM px WHERE cs_cdf >= 0.6 GROUP BY ALL")
def latest_clear(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("nbr", F.when(raster.valid_pixel(0.6), F.col("nbr"))).withColumn("priority", F.col("scene_id"))
    return _rounded(raster.latest_clear(rows, ["zone"], "priority"))


@BOOK.query(f"""WITH {PIXELS}, m AS (SELECT zone, row, col, min(scene_id) AS scene_id FROM px WHERE cs_cdf >= 0.6 GROUP BY ALL) SELECT zone, scene_id, pixels, round(pixels / sum(pixels) OVER (PARTITION BY zone), 6) AS share FROM (SELECT zone, scene_id, count(*) AS pixels FROM m GROUP BY ALL)""")
def mosaic_shares(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("nbr", F.when(raster.valid_pixel(0.6), F.col("nbr"))).withColumn("priority", F.col("scene_id"))
    return _rounded(raster.source_shares(raster.latest_clear(rows, ["zone"], "priority"), ["zone"]))


@BOOK.query(f"""WITH {PIXELS}, s AS (SELECT zone, period, scene_id, count(*) FILTER (cs_cdf >= 0.5) / count(*) AS clear FROM px GROUP BY ALL) SELECT zone, period, coalesce(min(scene_id) FILTER (clear >= 0.53), max_by(scene_id, (clear, scene_id))) AS scene_id FROM s GROUP BY ALL""")
def clear_scene_choice(spark, sf_dir):
    rows = pixels(spark, sf_dir).groupBy("zone", "period", "scene_id").agg((F.count_if(F.col("cs_cdf") >= 0.5) / F.count(F.lit(1))).alias("clear")).withColumn("priority", F.col("scene_id"))
    return raster.first_clear_scene(rows, ["zone", "period"], 0.53)


@BOOK.query("SELECT o_custkey, o_orderpriority, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def latest_per_key(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return raster.latest_per_key(rows, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").drop("o_orderdate")


_mask = f"""WITH RECURSIVE {PIXELS}, mask AS (SELECT scene_id, row, col, nbr, b8, printf('%09d:%09d', row, col) AS pixel FROM px WHERE nbr > 0.1),
nb AS (SELECT a.scene_id, a.pixel AS src, b.pixel AS dst FROM mask a JOIN mask b ON a.scene_id = b.scene_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.pixel <> b.pixel),
sp AS (SELECT scene_id, pixel, pixel AS seen FROM mask UNION SELECT sp.scene_id, nb.dst, sp.seen FROM sp JOIN nb ON nb.scene_id = sp.scene_id AND nb.src = sp.pixel),
lab AS (SELECT scene_id, pixel, min(seen) AS patch FROM sp GROUP BY ALL), pat AS (SELECT m.*, patch FROM mask m JOIN lab USING (scene_id, pixel))"""


def _mask_rows(spark, sf_dir):
    return pixels(spark, sf_dir).where("nbr > 0.1").select("scene_id", "row", "col", "nbr")


@BOOK.query(f"""{_mask}, s AS (SELECT scene_id, patch, count(*) AS pixels, avg(row) AS centre_row, median(nbr) AS median, count(*) / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)) AS box_fill FROM pat GROUP BY ALL)
SELECT scene_id, patch, pixels, round(centre_row, 6) AS centre_row, round(median, 6) AS median, round(box_fill, 6) AS box_fill, pixels * 400.0 / 1e4 AS area_ha, row_number() OVER (PARTITION BY scene_id ORDER BY pixels DESC, patch DESC) = 1 AS is_main FROM s""")
def raster_components(spark, sf_dir):
    patches = raster.components(_mask_rows(spark, sf_dir), ["scene_id"])
    return _rounded(raster.patch_statistics(patches, ["scene_id"], "nbr").select("scene_id", "patch", "pixels", "centre_row", "median", "box_fill", "area_ha", "is_main"))


@BOOK.query(f"""{_mask}, seed AS (SELECT scene_id, row, col FROM px WHERE (row * 8 + col + scene_id) % 11 = 0), t AS (SELECT DISTINCT p.scene_id, patch FROM pat p JOIN seed USING (scene_id, row, col)), s AS (SELECT scene_id, patch, count(*) AS pixels FROM pat JOIN t USING (scene_id, patch) GROUP BY ALL)
SELECT scene_id, patch, pixels, row_number() OVER (PARTITION BY scene_id ORDER BY pixels DESC, patch DESC) = 1 AS is_main FROM s""")
def seeded_patches(spark, sf_dir):
    patches = raster.components(_mask_rows(spark, sf_dir), ["scene_id"])
    seeds = pixels(spark, sf_dir).where((F.col("row") * 8 + F.col("col") + F.col("scene_id")) % 11 == 0)
    return raster.seeded_patches(patches, seeds, ["scene_id"])


@BOOK.query(f"""WITH {PIXELS}, m AS (SELECT scene_id, row, col FROM px WHERE nbr > 0.25) SELECT g.scene_id, g.row, g.col FROM px g WHERE EXISTS (SELECT 1 FROM m WHERE m.scene_id = g.scene_id AND (m.row - g.row) ** 2 + (m.col - g.col) ** 2 <= 4) AND NOT EXISTS (SELECT 1 FROM m WHERE m.scene_id = g.scene_id AND m.row = g.row AND m.col = g.col)""")
def dilate_ring(spark, sf_dir):
    grid = pixels(spark, sf_dir)
    return raster.ring(grid.where("nbr > 0.25"), grid.select("scene_id", "row", "col"), ["scene_id"], 2)


@BOOK.query(f"""WITH {PIXELS}, m AS (SELECT scene_id, row, col FROM px WHERE nbr > 0.25), r AS (SELECT g.scene_id, g.cs_cdf FROM px g WHERE EXISTS (SELECT 1 FROM m WHERE m.scene_id = g.scene_id AND (m.row - g.row) ** 2 + (m.col - g.col) ** 2 <= 4) AND NOT EXISTS (SELECT 1 FROM m WHERE m.scene_id = g.scene_id AND m.row = g.row AND m.col = g.col))
SELECT count(*) FILTER (cs_cdf IS NULL) * 400.0 / 1e4 AS nodata_ha FROM r""")
def ring_nodata(spark, sf_dir):
    grid = pixels(spark, sf_dir)
    return raster.nodata_area(raster.ring(grid.where("nbr > 0.25"), grid.select("scene_id", "row", "col", "cs_cdf"), ["scene_id"], 2), "cs_cdf")


@BOOK.query(f"""WITH {PIXELS}, m AS (SELECT scene_id, row, col FROM px WHERE nbr > 0.0) SELECT scene_id, row, col FROM m WHERE (SELECT count(*) FROM m n WHERE n.scene_id = m.scene_id AND abs(n.row - m.row) + abs(n.col - m.col) = 1) < 4""")
def mask_border(spark, sf_dir):
    return raster.border(pixels(spark, sf_dir).where("nbr > 0.0").select("scene_id", "row", "col"), ["scene_id"])


@BOOK.query()
def hull_area(spark, sf_dir):
    return raster.hull_areas(raster.components(_mask_rows(spark, sf_dir), ["scene_id"]), ["scene_id", "patch"])


_cells = f"""WITH RECURSIVE {PIXELS}, mask AS (SELECT scene_id, row, col, printf('%09d:%09d', row, col) AS pixel FROM px WHERE nbr > 0.1),
nb AS (SELECT a.scene_id, a.pixel AS src, b.pixel AS dst FROM mask a JOIN mask b ON a.scene_id = b.scene_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
sp AS (SELECT scene_id, pixel, pixel AS seen FROM mask UNION SELECT sp.scene_id, nb.dst, sp.seen FROM sp JOIN nb ON nb.scene_id = sp.scene_id AND nb.src = sp.pixel),
lab AS (SELECT scene_id, pixel, min(seen) AS patch FROM sp GROUP BY ALL), big AS (SELECT scene_id, patch, count(*) AS n FROM lab GROUP BY ALL HAVING count(*) >= 4),
own AS (SELECT scene_id, patch, row, col FROM mask JOIN lab USING (scene_id, pixel) JOIN big USING (scene_id, patch)),
free AS (SELECT scene_id, patch, r, c, r * 10 + c AS k FROM big, range(-1, 9) a(r), range(-1, 9) b(c) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.scene_id = big.scene_id AND o.patch = big.patch AND o.row = r AND o.col = c)),
fl AS (SELECT scene_id, patch, r, c, k AS seen FROM free UNION SELECT f.scene_id, f.patch, f.r, f.c, fl.seen FROM fl JOIN free f ON f.scene_id = fl.scene_id AND f.patch = fl.patch AND abs(f.r - fl.r) + abs(f.c - fl.c) = 1 AND fl.seen < f.k),
bg AS (SELECT scene_id, patch, piece, count(*) AS n FROM (SELECT scene_id, patch, r, c, min(seen) AS piece FROM fl GROUP BY ALL) GROUP BY ALL),
ho AS (SELECT scene_id, patch, count(*) FILTER (n >= 2) AS holes, coalesce(sum(n) FILTER (n < 2), 0) AS closed FROM bg WHERE piece <> -11 GROUP BY ALL),
pe AS (SELECT o.scene_id, o.patch, count(*) AS sides FROM own o JOIN free f ON f.scene_id = o.scene_id AND f.patch = o.patch AND abs(f.r - o.row) + abs(f.c - o.col) = 1 GROUP BY ALL)"""


@BOOK.query(f"""{_cells} SELECT scene_id, patch, n / 25.0 AS area_ha, (n + coalesce(closed, 0)) / 25.0 AS outline_ha, sides * 20.0 AS perimeter_m, coalesce(holes, 0) AS holes FROM big JOIN pe USING (scene_id, patch) LEFT JOIN ho USING (scene_id, patch)""")
def patch_outlines(spark, sf_dir):
    patches = raster.components(_mask_rows(spark, sf_dir), ["scene_id"], diagonal=False)
    return _rounded(raster.outline_areas(raster.outline_edges(patches, ["scene_id"]), ["scene_id"], 20.0, 4 / 25 - 1e-9, 2 / 25 - 1e-9))


@BOOK.query("""WITH d AS (SELECT s_suppkey AS polygon, 500 + s_suppkey * 37 % 400 + 0.37 AS cx, 300 + s_suppkey * 53 % 200 + 0.29 AS cy, 6.0 + s_suppkey % 5 AS a, 9.0 + s_suppkey % 7 AS b FROM supplier),
g AS (SELECT polygon, c AS col, r AS row, abs(c - cx) / a + abs(r - cy) / b AS outer_d, abs(c - cx) / (a / 3) + abs(r - cy) / (b / 2) AS hole_d FROM d, range(450, 950) x(c), range(250, 550) y(r) WHERE abs(c - cx) <= a AND abs(r - cy) <= b)
SELECT polygon, row, col FROM g WHERE outer_d <= 1 AND hole_d > 1""")
def polygon_support(spark, sf_dir):
    k = F.col("s_suppkey")
    rings = read_table(spark, sf_dir, "supplier").select(k.alias("polygon"), (500 + k * 37 % 400 + 0.37).alias("cx"), (300 + k * 53 % 200 + 0.29).alias("cy"), (6.0 + k % 5).alias("a"), (9.0 + k % 7).alias("b"))
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), F.lit(i == 1).alias("is_hole"), (F.col("a") / (1, 3)[i]).alias("w"), (F.col("b") / (1, 2)[i]).alias("h")) for i in (0, 1)]))
    rings = rings.withColumn("s", half).select("polygon", "cx", "cy", "s.*")
    corner = lambda n, dx, dy: [(F.col("cx") + dx * F.col("w")).alias(f"x{n}"), (F.col("cy") + dy * F.col("h")).alias(f"y{n}")]
    turns = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]
    edges = rings.withColumn("e", F.explode(F.array(*[F.struct(F.lit(i).alias("edge"), *corner(1, *p), *corner(2, *q)) for i, (p, q) in enumerate(zip(turns, turns[1:]))]))).select("polygon", "ring", "is_hole", "e.*")
    return polygons.pixels_in_polygons(edges, 0.0, 0.0, 1.0)


@BOOK.query(f"WITH {PIXELS} SELECT zone, row, col, round(dnbr, 6) AS dnbr FROM chg WHERE dnbr > 0.05 AND post_nbr < 0.05")
def scar_candidates(spark, sf_dir):
    return _rounded(raster.scar_candidates(_changes(spark, sf_dir), ["zone"], 0.05, 0.05))


@BOOK.query(f"WITH {PIXELS} SELECT scene_id, CAST(row // 2 AS BIGINT) AS row, CAST(col // 2 AS BIGINT) AS col, round(avg(b8), 6) AS b8 FROM px GROUP BY ALL")
def block_means(spark, sf_dir):
    return _rounded(raster.block_mean(pixels(spark, sf_dir), ["scene_id"], ["b8"]))


@BOOK.query(f"""WITH {PIXELS}, d AS (SELECT scene_id, row, col, floor(b8 * 10000) + CASE WHEN scene_id % 2 = 0 THEN 1000 ELSE 0 END AS dn FROM px), q AS (SELECT scene_id, quantile_cont(dn, 0.05) AS p5 FROM d WHERE dn > 0 GROUP BY 1)
SELECT scene_id, row, col, round(greatest(0.0, (dn - CASE WHEN p5 >= 4000 THEN 1000 ELSE 0 END) / 10000), 6) AS reflectance FROM d JOIN q USING (scene_id)""")
def scene_reflectance(spark, sf_dir):
    rows = pixels(spark, sf_dir).select("scene_id", "row", "col", (F.floor(F.col("b8") * 10000) + F.when(F.col("scene_id") % 2 == 0, 1000).otherwise(0)).cast("double").alias("dn"))
    return _rounded(raster.reflectance(rows, "scene_id", "dn", evidence=4000.0).select("scene_id", "row", "col", "reflectance"))


_linked = f"""{DETECTIONS}, ev AS (SELECT detection_id AS event_id, x_m, y_m, ts AS start_ts FROM det),
tile AS (SELECT user_id AS patch, CAST(500000 + (user_id % 40) * 1700 + i * 300 AS DOUBLE) AS x_m, CAST(940000 + (user_id // 40) * 1700 + 700 AS DOUBLE) AS y_m, TIMESTAMP '2024-01-05' + to_days(CAST(user_id % 7 AS INTEGER)) AS a, TIMESTAMP '2024-01-12' + to_days(CAST(user_id % 7 AS INTEGER)) AS b FROM (SELECT DISTINCT user_id FROM events), range(4) t(i))"""


@BOOK.query(f"WITH {_linked} SELECT patch, event_id, round(min(sqrt((t.x_m - e.x_m) ** 2 + (t.y_m - e.y_m) ** 2)), 6) AS distance_m FROM tile t JOIN ev e ON abs(t.x_m - e.x_m) <= 1000 AND abs(t.y_m - e.y_m) <= 1000 AND start_ts BETWEEN a AND b WHERE sqrt((t.x_m - e.x_m) ** 2 + (t.y_m - e.y_m) ** 2) <= 1000 GROUP BY ALL")
def linked_patches(spark, sf_dir):
    u = F.col("user_id")
    day = (u % 7).cast("int")
    tiles = read_table(spark, sf_dir, "events").select("user_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        u.alias("patch"), (500000 + (u % 40) * 1700 + F.col("i") * 300).cast("double").alias("x_m"), (940000 + F.floor(u / 40) * 1700 + 700).cast("double").alias("y_m"),
        F.date_add(F.lit("2024-01-05").cast("date"), day).cast("timestamp").alias("period_start"), F.date_add(F.lit("2024-01-12").cast("date"), day).cast("timestamp").alias("period_end"),
    )
    events = detections(spark, sf_dir).select(F.col("detection_id").alias("event_id"), "x_m", "y_m", F.col("ts").alias("start_ts"))
    return _rounded(raster.linked_patches(tiles, events, 1000.0, ["patch"]))


@BOOK.query(f"""WITH {PIXELS}, g AS (SELECT row, col, avg(b8) AS value FROM px GROUP BY ALL), pt AS (SELECT event_id, greatest(0.0, least(7.0, user_id % 97 / 12.0)) AS fr, greatest(0.0, least(7.0, event_id % 89 / 11.0 - 0.3)) AS fc FROM events),
spot AS (SELECT *, least(CAST(floor(fr) AS INTEGER), 6) AS r0, least(CAST(floor(fc) AS INTEGER), 6) AS c0 FROM pt)
SELECT event_id, round(sum(value * (CASE WHEN g.row = r0 THEN 1 - (fr - r0) ELSE fr - r0 END) * (CASE WHEN g.col = c0 THEN 1 - (fc - c0) ELSE fc - c0 END)), 6) AS value FROM spot JOIN g ON g.row BETWEEN r0 AND r0 + 1 AND g.col BETWEEN c0 AND c0 + 1 GROUP BY 1""")
def bilinear_samples(spark, sf_dir):
    grid = pixels(spark, sf_dir).groupBy("row", "col").agg(F.avg("b8").alias("value"))
    points = read_table(spark, sf_dir, "events").select("event_id", (F.lit(0.0) - F.col("user_id") % 97 / 12.0).alias("lat"), (F.col("event_id") % 89 / 11.0 - 0.3).alias("lon"))
    return _rounded(raster.bilinear(points, grid, "event_id", 0.0, 0.0, 1.0))


@BOOK.query(f"""WITH {DETECTIONS}, m AS (SELECT DISTINCT firms_source AS k, x_m, y_m FROM det),
near AS (SELECT k, x_m, y_m, CAST(floor((y_m - 940000) / 500) AS BIGINT) + a.i AS row, CAST(floor((x_m - 500000) / 500) AS BIGINT) + b.i AS col FROM m, range(-3, 4) a(i), range(-3, 4) b(i))
SELECT DISTINCT k, row, col FROM near WHERE sqrt((x_m - 500000 - col * 500.0) ** 2 + (y_m - 940000 - row * 500.0) ** 2) <= 1000""")
def aoi_support(spark, sf_dir):
    members = detections(spark, sf_dir).select(F.col("firms_source").alias("k"), "x_m", "y_m").distinct()
    return raster.support_pixels(raster.pixels_around(members, ["k"], 1000.0, 500.0, 500000.0, 940000.0), members, ["k"], 1000.0)


@BOOK.query(f"""{_mask}, s AS (SELECT scene_id, patch, count(*) AS pixels, count(*) / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)) AS box_fill, max(nbr) - min(nbr) AS span FROM pat GROUP BY ALL), k AS (SELECT *, pixels * 0.04 * (1 + least(1.0, span * 500 / 200)) * CASE WHEN scene_id % 3 = 0 THEN 1.5 ELSE 1.0 END * CASE WHEN box_fill > 0.8 THEN 0.5 ELSE 1.0 END AS score FROM s WHERE pixels >= 4)
SELECT scene_id, patch, round(score, 6) AS score FROM k ORDER BY round(score, 6) DESC, scene_id, patch LIMIT 12""")
def candidate_scores(spark, sf_dir):
    patches = raster.components(_mask_rows(spark, sf_dir), ["scene_id"])
    spans = patches.groupBy("scene_id", "patch").agg((F.max("nbr") - F.min("nbr")).alias("span"))
    rows = raster.patch_statistics(patches, ["scene_id"], "nbr").where("pixels >= 4").join(spans, ["scene_id", "patch"])
    score = raster.candidate_score(F.col("area_ha"), F.col("span") * 500, F.when(F.col("scene_id") % 3 == 0, 1).otherwise(0), F.col("box_fill"))
    return rows.select("scene_id", "patch", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "scene_id", "patch").limit(12)


