"""Pixel tables: indices, composites, zonal statistics, patches, rings and their links to events.

A pixel is a row (scene or event, row, col, values). Arithmetic that needs two bands or two dates is
an equality join on the pixel; neighbourhoods are equality joins on shifted coordinates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.components import label_components
from emberline.operators.proximity import _near_cells
from emberline.operators.quantiles import quantiles
from emberline.runtime import cut, fill

#: Land cover classes that count as clear where a scene has no score (fixed values).
CLEAR_CLASSES = (4, 5, 6, 7, 11)
#: Thresholds at which change is reported as area.
CHANGE_THRESHOLDS = (0.10, 0.20, 0.27, 0.44)


def nbr(b8: Column, b12: Column) -> Column:
    """Normalised difference; null where a band is or the sum is 0."""
    return F.try_divide(b8 - b12, b8 + b12)


def guarded_nbr(b8: Column, b12: Column, least: float = 0.02) -> Column:
    """The same over bands clipped at 0, null where the sum is too small to trust."""
    a, b = F.greatest(b8, F.lit(0.0)), F.greatest(b12, F.lit(0.0))
    return F.when(a + b > least, (a - b) / (a + b))


def valid_pixel(threshold: float) -> Column:
    return F.coalesce(F.col("b8").isNotNull() & F.col("b12").isNotNull() & (F.col("cs_cdf") >= threshold), F.lit(False))


def clear_class(scl: Column) -> Column:
    return scl.isin(*CLEAR_CLASSES)


def masked(pixels: DataFrame, threshold: float) -> DataFrame:
    """Bands of pixels that are not valid become null; the pixels stay."""
    ok = valid_pixel(threshold)
    return pixels.withColumns({"b8": F.when(ok, F.col("b8")), "b12": F.when(ok, F.col("b12"))})


def reflectance(pixels: DataFrame, scene: str, value: str, offset: float = 1000.0, scale: float = 10000.0, evidence: float = 1000.0) -> DataFrame:
    """``reflectance`` of digital numbers; the offset is taken off where a scene's 5th percentile of them, ``evidence`` or more, shows it was added."""
    low = pixels.where(F.col(value) > 0).groupBy(scene).agg(F.percentile(value, F.lit(0.05)).alias("__p5"))
    return pixels.join(low, scene, "left").withColumn("reflectance", F.greatest(F.lit(0.0), (F.col(value) - F.when(F.col("__p5") >= evidence, offset).otherwise(0.0)) / scale)).drop("__p5")


def block_mean(pixels: DataFrame, keys: list[str], values: list[str], size: int = 2) -> DataFrame:
    """Means of size x size blocks."""
    return pixels.groupBy(*keys, F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(*[F.avg(v).alias(v) for v in values])


def median_composite(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Per pixel the median of each band over scenes; an index is computed from these, never averaged itself."""
    return pixels.groupBy(*keys, "row", "col").agg(*[F.median(b).alias(b) for b in bands])


def change(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, pre_nbr, post_nbr, dnbr) on pixels that both sides have; dnbr is null unless both are valid."""
    side = lambda d, n: d.select(*keys, "row", "col", nbr(F.col("b8"), F.col("b12")).alias(n))
    return side(pre, "pre_nbr").join(side(post, "post_nbr"), [*keys, "row", "col"]).withColumn("dnbr", F.col("pre_nbr") - F.col("post_nbr"))


def zonal_statistics(changes: DataFrame, keys: list[str], pixel_m: float = 20.0) -> DataFrame:
    """Counts, linear percentiles, and area above each threshold."""
    d, n = F.col("dnbr"), F.count("dnbr")
    q = F.percentile(d, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)]))
    over = [x for t in CHANGE_THRESHOLDS for x in (F.try_divide(F.count_if(d > t), n).alias(f"fraction_gt_{round(t * 100):03d}"), (F.count_if(d > t) * pixel_m**2 / 1e4).alias(f"area_ha_gt_{round(t * 100):03d}"))]
    out = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("aoi_px"), F.count("pre_nbr").alias("pre_px"), F.count("post_nbr").alias("post_px"), n.alias("common_px"), F.avg(d).alias("dnbr_mean"), F.min(d).alias("dnbr_min"), F.max(d).alias("dnbr_max"), q.alias("q"), *over)
    return out.select("*", *[F.get("q", F.lit(i)).alias(f"dnbr_{p}") for i, p in enumerate(("p10", "p25", "median", "p75", "p90", "p95"))], F.try_divide("common_px", "aoi_px").alias("valid_overlap_fraction")).drop("q")


def clipped_fraction(raw: Column, tolerance: float = 1e-9) -> tuple[Column, Column, Column]:
    """Value clipped within the tolerance only, whether it was clipped, whether it must be rejected."""
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    bad = F.coalesce(F.isnan(raw) | (raw < -tolerance) | (raw > 1 + tolerance), F.lit(False))
    return F.when(~bad & raw.isNotNull(), value), F.coalesce(~bad & (value != raw), F.lit(False)), bad


def percentiles_ordered(columns: list[str]) -> Column:
    ok = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        ok = ok & (F.col(a) <= F.col(b) + 1e-9)
    return F.coalesce(ok, F.lit(False))


def gated_metrics(metrics: DataFrame, columns: list[str], least_overlap: float = 0.5) -> DataFrame:
    """``status`` of every row, and metrics nulled unless it is usable_overlap."""
    value, clipped, bad = clipped_fraction(F.col("valid_overlap_fraction"))
    status = F.when(bad, "rejected").when(F.col("common_px") == 0, "no_common_pixels").when(value < least_overlap, "insufficient_overlap").otherwise("usable_overlap")
    out = metrics.withColumns({"status": status, "was_clipped": clipped})
    return out.withColumns({c: F.when(F.col("status") == "usable_overlap", F.col(c)) for c in columns})


def period_median(pixels: DataFrame, least_clear: float = 0.05) -> DataFrame:
    """(period, row, col, nbr): median index per period over scenes that are clear enough."""
    clear = pixels.groupBy("scene_id").agg(F.avg(F.col("nbr").isNotNull().cast("double")).alias("c")).where(F.col("c") >= least_clear).select("scene_id")
    return pixels.join(clear, "scene_id", "left_semi").groupBy("period", "row", "col").agg(F.median("nbr").alias("nbr"))


def period_differences(periods: DataFrame) -> DataFrame:
    """``periods`` plus drop: the index of the period before minus this one."""
    w = Window.partitionBy("row", "col").orderBy("period")
    return periods.withColumn("drop", F.lag("nbr").over(w) - F.col("nbr"))


def global_stretch(pixels: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(band, low, high): one pair of percentiles a band over all pixels valid in every band."""
    whole = pixels.where(" and ".join(f"{b} is not null" for b in bands))
    return quantiles(whole.select(*bands).unpivot([], bands, "band", "v"), ["band"], {"low": ("v", low, "linear"), "high": ("v", high, "linear")})


def to_byte(value: Column, low: Column, high: Column, gamma: float = 1.0) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(value - low, high - low)))
    return F.round(255 * F.pow(share, F.lit(1.0 / gamma))).cast("int")


def components(mask: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """``mask`` (keys, row, col) plus patch: the smallest pixel of its 8-connected patch, or 4-connected without ``diagonal``."""
    pixel = F.format_string("%09d:%09d", F.col("row"), F.col("col"))
    nodes = mask.withColumn("pixel", pixel)
    here = nodes.select(*keys, F.col("pixel").alias("src"), "row", "col")
    ahead = here.withColumn("__o", F.explode(F.expr("array(struct(0 as dr, 1 as dc), struct(1 as dr, 0 as dc)" + (", struct(1 as dr, -1 as dc), struct(1 as dr, 1 as dc))" if diagonal else ")"))))
    ahead = ahead.select(*keys, "src", (F.col("row") + F.col("__o.dr")).alias("row"), (F.col("col") + F.col("__o.dc")).alias("col"))
    edges = ahead.join(nodes.select(*keys, F.col("pixel").alias("dst"), "row", "col"), [*keys, "row", "col"]).select(*keys, "src", "dst")
    return label_components(nodes, edges, "pixel", "patch", keys=keys)


def patch_statistics(patches: DataFrame, keys: list[str], value: str, pixel_m: float = 20.0) -> DataFrame:
    """Area, centroid, median, fill of the bounding box, and the main patch of each key."""
    rows = patches.groupBy(*keys, "patch").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"), F.median(value).alias("median"),
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"),
    )
    box = (F.col("row1") - F.col("row0") + 1) * (F.col("col1") - F.col("col0") + 1)
    largest = rows.groupBy(*keys).agg(F.max(F.struct("pixels", "patch")).alias("m")).select(*keys, F.col("m.patch").alias("main"))
    return rows.join(largest, keys).withColumns({"area_ha": F.col("pixels") * pixel_m**2 / 1e4, "box_fill": F.col("pixels") / box, "is_main": F.col("patch") == F.col("main")}).drop("main")


def largest_patches(patches: DataFrame, keys: list[str], least_ha: float, most: int, pixel_m: float = 20.0) -> DataFrame:
    """(keys, patch, area_ha, place): the ``most`` largest patches of each key, down to ``least_ha``."""
    area = (F.count(F.lit(1)) * pixel_m**2 / 1e4).alias("area_ha")
    sizes = patches.groupBy(*keys, "patch").agg(area).where(F.col("area_ha") >= least_ha)
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area_ha"), "patch"))).where(F.col("place") <= most)


def dilate(mask: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Distinct (keys, row, col) within a disk around the mask's pixels, the pixels included."""
    disk = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in disk])
    return mask.select(*keys, "row", "col", F.explode(offsets).alias("o")).select(*keys, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()


def ring(mask: DataFrame, grid: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Pixels of ``grid`` within ``radius`` of the mask but not in it."""
    at = [*keys, "row", "col"]
    return grid.join(dilate(mask, keys, radius), at, "left_semi").join(mask.select(*at), at, "left_anti")


def border(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with fewer than four edge neighbours in the mask; the outside of the window is not mask."""
    at = [*keys, "row", "col"]
    steps = F.expr("array(struct(0 as dr, 1 as dc), struct(0 as dr, -1 as dc), struct(1 as dr, 0 as dc), struct(-1 as dr, 0 as dc))")
    told = mask.select(*at, F.explode(steps).alias("o")).select(*keys, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    inside = told.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n = 4").select(*at)
    return mask.join(inside, at, "left_anti")


def outline_edges(patches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, patch, ring, edge, r0, c0, r1, c1, next): the sides around 4-connected patches, chained to rings.

    A side that two pixels of a patch share cancels. The others run with the patch on their right; where
    two of them leave a corner, the ring turns left, so that it stays with one piece of background and
    never touches itself. A ring is named by its smallest side.
    """
    own = [*keys, "patch"]
    side = lambda name, r, c, *ends: F.struct(F.format_string(f"{name}%09d:%09d", r, c).alias("edge"), *[e.alias(n) for n, e in zip(("r0", "c0", "r1", "c1"), ends)])
    r, c, r1, c1 = F.col("row").cast("int"), F.col("col").cast("int"), (F.col("row") + 1).cast("int"), (F.col("col") + 1).cast("int")
    four = F.array(side("h", r, c, r, c, r, c1), side("v", r, c1, r, c1, r1, c1), side("h", r1, c, r1, c1, r1, c), side("v", r, c, r1, c, r, c))
    sides = patches.select(*own, F.explode(four).alias("s")).groupBy(*own, "s.edge").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s")).where("n = 1")
    sides = cut(sides.select(*own, "s.*"))
    after = sides.select(*own, F.col("edge").alias("next"), F.col("r0").alias("r1"), F.col("c0").alias("c1"), (F.col("r1") - F.col("r0")).alias("dr"), (F.col("c1") - F.col("c0")).alias("dc"))
    left = (F.col("dr") == F.col("c0") - F.col("c1")) & (F.col("dc") == F.col("r1") - F.col("r0"))
    chained = sides.join(after, [*own, "r1", "c1"]).groupBy(*own, "edge", "r0", "c0", "r1", "c1").agg(F.min(F.struct((~left).alias("other"), "next")).alias("n"))
    chained = cut(chained.select(*own, "edge", "r0", "c0", "r1", "c1", F.col("n.next").alias("next")))
    links = chained.select(*own, F.col("edge").alias("src"), F.col("next").alias("dst"))
    return label_components(chained, links, "edge", "ring", keys=own)


def ring_positions(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` (keys, patch, ring, edge, next) plus position: the place of each side in its ring, from 0 at its smallest side, by pointer jumping."""
    own = [*keys, "patch"]
    back = edges.where("next <> ring").select(*own, F.col("next").alias("edge"), F.col("edge").alias("to"), F.lit(1).cast("long").alias("position"))
    at = cut(back.unionByName(edges.where("edge = ring").select(*own, "edge", F.lit(None).cast("string").alias("to"), F.lit(0).cast("long").alias("position"))))
    while not at.where("to is not null").isEmpty():
        further = at.select(*own, F.col("edge").alias("to"), F.col("to").alias("beyond"), F.col("position").alias("more"))
        at = cut(at.join(further, [*own, "to"], "left").select(*own, "edge", F.col("beyond").alias("to"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position")))
    return edges.join(at.drop("to"), [*own, "edge"])


def outline_areas(edges: DataFrame, keys: list[str], pixel_m: float = 20.0, least_ha: float = 1.0, least_hole_ha: float = 0.5) -> DataFrame:
    """(keys, patch, area_ha, outline_ha, perimeter_m, holes): shoelace sums per ring.

    ``area_ha`` is that of the pixels, ``outline_ha`` that of the outline with the holes of at least
    ``least_hole_ha`` left open; patches below ``least_ha`` of pixels are dropped.
    """
    own, ha = [*keys, "patch"], pixel_m**2 / 1e4
    rings = edges.groupBy(*own, "ring").agg((F.sum(F.col("c0") * F.col("r1") - F.col("c1") * F.col("r0")) / 2 * ha).alias("a"), F.count(F.lit(1)).alias("n"))
    kept = (F.col("a") > 0) | (-F.col("a") >= least_hole_ha)
    out = rings.groupBy(*own).agg(F.sum("a").alias("area_ha"), F.sum(F.when(kept, F.col("a"))).alias("outline_ha"), (F.sum("n") * pixel_m).alias("perimeter_m"), F.count_if((F.col("a") < 0) & kept).alias("holes"))
    return out.where(F.col("area_ha") >= least_ha)


def _hull_area(points: list[tuple[float, float]]) -> float:
    points = sorted(set(points))
    if len(points) < 3:
        return 0.0

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(points) + chain(points[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, [*hull[1:], hull[0]]))) / 2


def hull_areas(patches: DataFrame, keys: list[str], per: int = 20_000) -> DataFrame:
    """(keys, hull_px): area of the convex hull of each patch's pixel squares. Only the ends of each pixel row leave Spark's own operators."""
    ends = cut(patches.groupBy(*keys, "row").agg(F.min("col").alias("a"), F.max("col").alias("b")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema.fields if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, own in pdf.groupby(keys, sort=False):
            corners = [(r + d, c) for r, a, b in zip(own.row, own.a, own.b) for d in (0, 1) for c in (a, b + 1)]
            rows.append((*key, _hull_area(corners)))
        return pd.DataFrame(rows, columns=[*keys, "hull_px"])

    # Many small patches, of about ``per`` pixel rows, share a task's call; a patch is never split.
    share = F.pmod(F.xxhash64(*keys), F.lit(fill(ends.count(), per, 256)))
    return ends.withColumn("share", share).groupBy("share").applyInPandas(run, f"{kinds}, hull_px double")


def linked_patches(pixels: DataFrame, events: DataFrame, metres: float, keys: list[str]) -> DataFrame:
    """(keys, event_id, distance_m): patches with a pixel within ``metres`` of an event that began inside the patch's period."""
    cell = lambda c: F.floor(F.col(c) / metres)
    p = pixels.withColumns({"cx": cell("x_m"), "cy": cell("y_m")})
    e = events.select("event_id", F.col("x_m").alias("ex"), F.col("y_m").alias("ey"), F.col("start_ts").alias("et"))
    e = e.withColumns({"cx": F.floor(F.col("ex") / metres), "cy": F.floor(F.col("ey") / metres)})
    for c in ("cx", "cy"):
        e = e.withColumn(c, _near_cells(c))
    near = p.join(e, ["cx", "cy"]).withColumn("d", F.hypot(F.col("x_m") - F.col("ex"), F.col("y_m") - F.col("ey")))
    return near.where((F.col("d") <= metres) & F.col("et").between(F.col("period_start"), F.col("period_end"))).groupBy(*keys, "event_id").agg(F.min("d").alias("distance_m"))


def seeded_patches(patches: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Patches that touch a seed pixel, with the largest marked main."""
    touched = patches.join(seeds.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi").select(*keys, "patch").distinct()
    sizes = patches.join(touched, [*keys, "patch"], "left_semi").groupBy(*keys, "patch").agg(F.count(F.lit(1)).alias("pixels"))
    best = sizes.groupBy(*keys).agg(F.max_by("patch", F.struct("pixels", "patch")).alias("main"))
    return sizes.join(best, keys).withColumn("is_main", F.col("patch") == F.col("main")).drop("main")


def scar_candidates(changes: DataFrame, keys: list[str], drop: float = 0.27, later: float = 0.10) -> DataFrame:
    """Pixels in the zone whose index fell by more than ``drop`` and is below ``later`` afterwards."""
    return changes.where((F.col("dnbr") > drop) & (F.col("post_nbr") < later)).select(*keys, "row", "col", "dnbr")


def latest_per_key(rows: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """One row per key: the newest, ties by the larger id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(newest), F.desc(tie))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def latest_clear(pixels: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Per pixel the first clear scene by priority."""
    best = pixels.where("nbr is not null").groupBy(*keys, "row", "col").agg(F.min(F.struct(F.col(priority).alias("p"), "scene_id", "nbr")).alias("b"))
    return best.select(*keys, "row", "col", F.col("b.scene_id").alias("scene_id"), F.col("b.nbr").alias("nbr"))


def source_shares(mosaic: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return mosaic.groupBy(*keys, "scene_id").agg(n.alias("pixels")).withColumn("share", F.col("pixels") / F.sum("pixels").over(Window.partitionBy(*keys)))


def first_clear_scene(scenes: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The first scene by priority that is clear enough, else the clearest."""
    return scenes.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(F.col("clear") >= target, F.col("scene_id")), F.when(F.col("clear") >= target, F.struct("priority", "scene_id"))), F.max_by("scene_id", F.struct("clear", "scene_id"))).alias("scene_id"))


def bilinear(points: DataFrame, grid: DataFrame, key: str, west: float, north: float, step: float) -> DataFrame:
    """(key, value): grid values at points, edges clamped. ``grid`` is (row, col, value)."""
    size = grid.agg(F.max("row").alias("mr"), F.max("col").alias("mc"))
    at = points.crossJoin(size).withColumns({"fr": F.greatest(F.lit(0.0), F.least(F.col("mr").cast("double"), (north - F.col("lat")) / step)), "fc": F.greatest(F.lit(0.0), F.least(F.col("mc").cast("double"), (F.col("lon") - west) / step))})  # one row
    at = at.withColumns({"r0": F.least(F.floor("fr"), F.greatest(F.lit(0), F.col("mr") - 1)), "c0": F.least(F.floor("fc"), F.greatest(F.lit(0), F.col("mc") - 1))})
    dr, dc = F.col("fr") - F.col("r0"), F.col("fc") - F.col("c0")
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((dr if a else 1 - dr) * (dc if b else 1 - dc)).alias("w")) for a in (0, 1) for b in (0, 1)])
    spread = at.select(key, "r0", "c0", F.explode(four).alias("k")).select(key, (F.col("r0") + F.col("k.a")).alias("row"), (F.col("c0") + F.col("k.b")).alias("col"), F.col("k.w").alias("w"))
    return spread.join(grid, ["row", "col"]).groupBy(key).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def relief(points: DataFrame, grid: DataFrame, key: str, west: float, north: float, step: float, half: int = 15, spacing: float = 1.0) -> DataFrame:
    """(key, relief): range of the sampled values in a square of points around each point."""
    k = F.sequence(F.lit(-half), F.lit(half))
    around = points.withColumn("i", F.explode(k)).withColumn("j", F.explode(k)).select(key, F.struct(key, "i", "j").alias("__p"), (F.col("lon") + F.col("j") * spacing * step).alias("lon"), (F.col("lat") + F.col("i") * spacing * step).alias("lat"))
    return bilinear(around, grid, "__p", west, north, step).groupBy(F.col(f"__p.{key}").alias(key)).agg((F.max("value") - F.min("value")).alias("relief"))


def pixels_around(members: DataFrame, keys: list[str], buffer_m: float, step: float, west: float, south: float) -> DataFrame:
    """(keys, row, col, x_m, y_m): the pixels whose centre can lie within ``buffer_m`` of a member, on the grid from (west, south)."""
    reach = lambda c, o: F.explode(F.sequence(F.ceil((F.col(c) - buffer_m - o) / step), F.floor((F.col(c) + buffer_m - o) / step)))
    places = members.select(*keys, "x_m", "y_m").distinct()
    cells = places.withColumn("row", reach("y_m", south)).select(*keys, "x_m", "row").distinct().withColumn("col", reach("x_m", west)).select(*keys, "row", "col").distinct()
    return cells.withColumns({"x_m": west + F.col("col") * step, "y_m": south + F.col("row") * step})


def support_pixels(grid: DataFrame, members: DataFrame, keys: list[str], buffer_m: float) -> DataFrame:
    """Grid pixels whose centre lies within ``buffer_m`` of any member point, by cells of that size."""
    cell = lambda c: F.floor(F.col(c) / buffer_m)
    m = members.select(*keys, F.col("x_m").alias("mx"), F.col("y_m").alias("my")).withColumns({"cx": F.floor(F.col("mx") / buffer_m), "cy": F.floor(F.col("my") / buffer_m)})
    for c in ("cx", "cy"):
        m = m.withColumn(c, _near_cells(c))
    near = grid.withColumns({"cx": cell("x_m"), "cy": cell("y_m")}).join(m, [*keys, "cx", "cy"]).where(F.hypot(F.col("x_m") - F.col("mx"), F.col("y_m") - F.col("my")) <= buffer_m)
    return near.select(*keys, "row", "col").distinct()


def candidate_score(area: Column, relief_m: Column, linked: Column, box_fill: Column) -> Column:
    """Area weighed by relief, by corroborating events, and against shapes that fill their box like fields."""
    return area * (1 + F.least(F.lit(1.0), relief_m / 200)) * F.when(linked > 0, 1.5).otherwise(1.0) * F.when(box_fill > 0.8, 0.5).otherwise(1.0)


def nodata_area(zone: DataFrame, value: str, pixel_m: float = 20.0) -> DataFrame:
    return zone.agg((F.count_if(F.col(value).isNull()) * pixel_m**2 / 1e4).alias("nodata_ha"))
