"""Reading messy detection files and registries, and writing deterministic outputs."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.clean import trimmed_float
from emberline.runtime import cut
from emberline.sources.stores import digests, numbered_lines, publish

# The fields of a detection file and the headers they may go by.
FIELDS = {
    "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "lng"), "acq_date": ("acq_date", "acquisition_date", "date"), "acq_time": ("acq_time", "acquisition_time", "time"),
    "satellite": ("satellite", "platform"), "instrument": ("instrument", "sensor"), "confidence": ("confidence", "conf"), "frp": ("frp", "fire_radiative_power"),
}
OPTIONAL = {"daynight": ("daynight", "day_night"), "version": ("version",), "type": ("type",)}


def header_key(name: str) -> str:
    """A header's runs of letters and digits in lower case, joined by underscores; marks and punctuation fall away."""
    return "_".join(re.findall("[a-z0-9]+", name.lower()))


def resolve_header(headers: list[str]) -> tuple[dict[str, int], str | None]:
    """Positions of the fields in a header, or why it is rejected: empty, repeated, ambiguous or missing columns."""
    keys = [header_key(h) for h in headers]
    if not headers or "" in keys:
        return {}, "empty header"
    repeated = sorted({k for k in keys if keys.count(k) > 1})
    if repeated:
        return {}, "repeated: " + ", ".join(repeated)
    places, missing = {}, []
    for field, names in {**FIELDS, **OPTIONAL}.items():
        have = [n for n in names if n in keys]
        if len(have) > 1:
            return {}, f"ambiguous: {field}"
        if have:
            places[field] = keys.index(have[0])
        elif field in FIELDS:
            missing.append(field)
    return (places, None) if not missing else ({}, "missing: " + ", ".join(missing))


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes, looks_like_html) of whole files, of any size."""
    start = F.lower(F.ltrim(F.decode("head", "UTF-8")))
    return digests(spark, path).select("path", "sha256", "size_bytes", (start.startswith("<html") | start.startswith("<!doctype html")).alias("looks_like_html"))


def scan_detection_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, files). Bad files are reported with their error, never abort the scan.

    The distinct header lines, few and short, are resolved on the driver; rows are split once in
    Spark and pick their fields by their own file's header. ``source_row_number`` counts from 1
    within a file; ``detection_id`` hashes file, content hash and row number. Files are read by
    byte ranges, so one of any size is many tasks' work.
    """
    numbered = cut(numbered_lines(spark, path))  # read several times below
    heads = numbered.where("n = 0").select("path", F.col("value").alias("header"))
    known = []
    for r in heads.select("header").distinct().collect():  # a line per distinct header
        places, error = resolve_header([h.strip('"') for h in r["header"].split(",")])
        known.append((r["header"], error, len(r["header"].split(",")), {k: v for k, v in places.items()}))
    table = spark.createDataFrame(known, "header string, error string, width int, places map<string,int>")
    contents = file_table(spark, path)
    heads = heads.join(table, "header")
    counts = numbered.groupBy("path").agg((F.count(F.lit(1)) - 1).alias("record_count"))
    files = contents.join(heads, "path", "left").join(counts, "path", "left").select(
        "path", "sha256", "size_bytes", F.coalesce("record_count", F.lit(0)).alias("record_count"), (F.col("error").isNull() & F.col("header").isNotNull() & ~F.col("looks_like_html")).alias("schema_valid"),
        F.when(F.col("looks_like_html"), "html body").when(F.col("header").isNull(), "empty file").otherwise(F.col("error")).alias("error"), F.sha2(F.regexp_replace("header", ",", "\x00"), 256).alias("schema_sha256"),
    )
    widest = max((width for _, _, width, _ in known), default=1)
    parts = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(widest))))
    cells = numbered.where("n > 0").join(heads.where("error is null"), "path").join(contents.select("path", "sha256"), "path").withColumn("c", parts)
    values = F.array(*[F.col(f"c.c{i}") for i in range(widest)])
    field = lambda f: F.coalesce(F.get(values, F.element_at("places", F.lit(f))), F.lit("")).alias(f)
    ident = F.concat(F.lit("firms-"), F.sha2(F.concat_ws("\x00", "path", "sha256", F.col("n").cast("string")), 256))
    rows = cells.select(ident.alias("detection_id"), *[field(f) for f in (*FIELDS, *OPTIONAL)], F.col("path").alias("raw_file"), F.col("sha256").alias("raw_sha256"), F.col("n").cast("long").alias("source_row_number"))
    return rows, files


# The fields of a fragment manifest and the states it may have.
MANIFEST = T.StructType([
    T.StructField(n, k) for n, k in (
        ("acquired_at_utc", T.StringType()), ("source", T.StringType()), ("start_date", T.DateType()), ("end_date", T.DateType()), ("area", T.StringType()), ("bbox", T.ArrayType(T.DoubleType())),
        ("url_sanitized", T.StringType()), ("sha256", T.StringType()), ("size_bytes", T.LongType()), ("record_count", T.LongType()), ("raw_file", T.StringType()), ("raw_filename", T.StringType()),
        ("schema_version", T.StringType()), ("status", T.StringType()), ("error_message", T.StringType()),
    )
])
STATES = ("downloaded", "imported", "error")


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """JSON documents: one a file, or one a line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_manifests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Fragment manifests plus ``absent``: the required fields that a document does not have (a null is there)."""
    docs = spark.read.text(path, wholetext=not lines)
    given = F.json_object_keys("value")
    return docs.select(F.from_json("value", MANIFEST).alias("m"), F.array_except(F.array(*[F.lit(n) for n in MANIFEST.names]), F.coalesce(given, F.array().cast("array<string>"))).alias("absent")).select("m.*", "absent")


def manifest_violations(manifests: DataFrame, secret: str | None = None) -> DataFrame:
    """(check, key, message) of manifests against their contract."""
    from emberline.operators.quality import violations

    c = F.col
    tests = {
        "all_fields": F.size("absent") == 0, "status_code": F.coalesce(c("status").isin(*STATES), F.lit(False)), "source_named": F.coalesce(F.trim("source") != "", F.lit(False)),
        "bbox_has_four": F.coalesce(F.size("bbox") == 4, F.lit(False)), "interval_order": c("start_date") <= c("end_date"),
    }
    good = F.coalesce(c("status").isin("downloaded", "imported"), F.lit(False))
    tests["hash_form"] = F.coalesce(F.nullif(c("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$"), ~good)
    done = {"size_not_negative": c("size_bytes") >= 0, "count_not_negative": c("record_count") >= 0}
    tests |= {n: ~good | F.coalesce(t, F.lit(False)) for n, t in done.items()} | {"error_described": (c("status") != "error") | F.coalesce(c("error_message") != "", F.lit(False))}
    if secret:
        whole = F.to_json(F.struct(*[F.col(x) for x in MANIFEST.names]))
        tests["no_secret"] = ~(F.contains(whole, F.lit(secret)) | F.contains(whole, F.lit(quote(secret, safe=""))))
    return violations(manifests.withColumn("__key", F.concat_ws("|", "source", c("start_date").cast("string"))), "__key", tests)


def split_availability(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows of read_availability, and (data_id, problem) of the others; rows without an id are left out, as the format allows."""
    named = rows.where(F.coalesce(F.col("data_id") != "", F.lit(False)))
    problem = F.when(F.col("min_date").isNull() | F.col("max_date").isNull(), "no_date").when(F.col("min_date") > F.col("max_date"), "inverted_interval")
    return named.where(problem.isNull()), named.select("data_id", problem.alias("problem")).where("problem is not null")


def read_availability(spark: SparkSession, path: str) -> DataFrame:
    """(data_id, min_date, max_date) of a CSV; ids in capitals."""
    raw = spark.read.option("header", True).schema("data_id string, min_date string, max_date string").csv(path)
    return raw.select(F.upper(F.trim("data_id")).alias("data_id"), F.col("min_date").try_cast("date").alias("min_date"), F.col("max_date").try_cast("date").alias("max_date"))


_RING = T.ArrayType(T.ArrayType(T.DoubleType()))
BOUNDARY = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("crs", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StringType())]))),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StringType()), T.StructField("coordinates", T.StringType()),
])


def read_boundaries(spark: SparkSession, path: str, name: str | None = None, lines: bool = False) -> DataFrame:
    """(feature, crs, coordinates) of GeoJSON features: a collection, a feature or a bare geometry; polygons become multipolygons.

    ``name`` picks the feature with that label, accents and case aside; a file with one feature needs none.
    ``crs`` is null where the file states none, which callers must reject or set.
    """
    from emberline.functions.clean import label_key

    docs = read_documents(spark, path, BOUNDARY, lines)
    # "type" of a bare geometry is the document's own; nested objects arrive as JSON text.
    bare = F.to_json(F.struct("type", F.from_json("coordinates", F.lit("array<array<array<double>>>")).alias("coordinates")))
    features = F.coalesce("features", F.array(F.struct(F.lit("Feature").alias("type"), F.col("properties"), F.coalesce("geometry", bare).alias("geometry"))))
    rows = docs.select("crs", F.posexplode(features).alias("i", "f")).select("crs", F.coalesce(F.element_at("f.properties", F.lit("name")), F.col("i").cast("string")).alias("feature"), F.col("f.geometry").alias("g"))
    kind = F.get_json_object("g", "$.type")
    raw = F.get_json_object("g", "$.coordinates")
    coordinates = F.when(kind == "MultiPolygon", F.from_json(raw, F.lit("array<array<array<array<double>>>>"))).when(kind == "Polygon", F.array(F.from_json(raw, F.lit("array<array<array<double>>>"))))
    out = rows.select("feature", "crs", coordinates.alias("coordinates"))
    return out.where(label_key(F.col("feature")) == label_key(F.lit(name))) if name is not None else out


def read_incidents(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Incidents, their anchors, sources and area claims, from one nested JSON registry."""
    anchor = "struct<anchor_id:string,latitude:double,longitude:double>"
    source = "struct<source_id:string,title:string,url:string>"
    claim = "struct<source_id:string,hectares:double>"
    docs = read_documents(spark, path, f"incidents array<struct<incident_id:string,name:string,anchors:array<{anchor}>,sources:array<{source}>,claims:array<{claim}>>>", lines)
    rows = docs.select(F.explode("incidents").alias("i")).select("i.*")
    part = lambda c: rows.select("incident_id", F.explode(c).alias("x")).select("incident_id", "x.*")
    return {"incidents": rows.select("incident_id", "name"), "anchors": part("anchors"), "sources": part("sources"), "claims": part("claims")}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Frozen events of a CSV as text columns, which event_violations() checks before they are typed."""
    return spark.read.option("header", True).csv(path)


def event_violations(rows: DataFrame, configuration: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """(check, key, message) of frozen events: one configuration, ids there and unique, intervals in order, numbers finite, flags true or false."""
    from emberline.functions import clean
    from emberline.operators.quality import repeated_keys, violations

    start, end = (clean.zoned_timestamp(F.col(c)) for c in ("start_timestamp_utc", "end_timestamp_utc"))
    tests = {"one_configuration": F.coalesce(F.col("configuration_id") == configuration, F.lit(False)), "id_present": F.coalesce(F.trim("event_id") != "", F.lit(False)), "interval_in_order": F.coalesce(start <= end, F.lit(False))}
    tests |= {f"{c}_is_number": clean.number(F.col(c)).isNotNull() for c in numbers} | {f"{c}_is_flag": clean.strict_bool(F.col(c)).isNotNull() for c in flags}
    return violations(rows, "event_id", tests).unionByName(repeated_keys(rows.where("trim(event_id) <> ''"), ["event_id"], "repeated_event"))


def read_key_set(spark: SparkSession, path: str, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """The distinct ids of a CSV, and (check, key, message) of empty and repeated ones."""
    from emberline.operators.quality import repeated_keys, violations

    rows = spark.read.option("header", True).csv(path).select(F.coalesce(F.trim(key), F.lit("")).alias(key))
    broken = violations(rows, key, {"id_present": F.col(key) != ""}).unionByName(repeated_keys(rows.where(F.col(key) != ""), [key], "repeated_id"))
    return rows.where(F.col(key) != "").distinct(), broken


def csv_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as text in a fixed order: null empty, true/false, doubles trimmed to 8 digits, nested as JSON."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def cell(c: str) -> Column:
        k = kinds[c]
        if isinstance(k, T.ArrayType | T.MapType | T.StructType):
            return F.coalesce(F.to_json(F.col(c)), F.lit(""))
        if isinstance(k, T.DoubleType | T.FloatType):
            return trimmed_float(F.col(c).cast("double"))
        if isinstance(k, T.TimestampType):
            return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return rows.select(*[cell(c).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str], mode: str = "errorifexists") -> None:
    """Deterministic CSV parts, in one total order over all parts."""
    csv_cells(rows.repartitionByRange(*[F.col(o) for o in order]).sortWithinPartitions(*order), columns).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_json_report(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report of one row with its keys sorted."""
    row.select(*sorted(row.columns)).coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def geojson_lines(rows: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """(value): one GeoJSON point feature a line, properties as listed, coordinates to six digits."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(rows: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    rows.repartitionByRange(*[F.col(o) for o in order]).sortWithinPartitions(*order).write.mode(mode).json(path)


def fingerprint(rows: DataFrame) -> tuple[int, int, int]:
    """Row count and two order-free sums of hashes of all values; a repeated row counts each time."""
    columns = [F.col(c) for c in sorted(rows.columns)]
    total = lambda *more: F.coalesce(F.sum(F.xxhash64(*columns, *more).cast("decimal(38,0)")), F.lit(0))
    r = rows.agg(F.count(F.lit(1)).alias("n"), total().alias("a"), total(F.lit(1)).alias("b")).first()
    return r["n"], int(r["a"]), int(r["b"])


def set_tree(rows: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """(sha256, leaves, ids): the root of a hash tree over the distinct ids, for sets of any size.

    A leaf holds the ids whose own hash begins with the same ``digits`` hex digits; its hash is that of
    its sorted ids, one a line, and the root hashes the leaves' prefixes and hashes in order. A leaf has
    a share of 16 ** -digits of the ids, the root at most 16 ** digits lines.
    """
    ids = rows.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct()
    leaves = ids.groupBy(F.substring(F.sha2("id", 256), 1, digits).alias("leaf")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "leaf", "h"))), "\n")
    return leaves.agg(F.sha2(lines, 256).alias("sha256"), F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids"))


def set_fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """(sha256): hash of the sorted distinct ids, one a line, for sets that fit a cell; for any size use set_tree()."""
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "\n"), 256).alias("sha256"))


def write_once(rows: DataFrame, path: str) -> str:
    """Write, or accept what is there if it has the same rows; anything else is an error. Of writers at once one wins."""
    spark = rows.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if publish(rows, path):
            return "written"
        old = spark.read.parquet(path)
    if sorted(old.columns) == sorted(rows.columns) and fingerprint(old) == fingerprint(rows):
        return "same"
    raise ValueError(f"{path} holds other rows")


def hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes) of an output folder."""
    return file_table(spark, path).select("path", "sha256", "size_bytes").orderBy("path")


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, verdict) of the files of a folder against a manifest (path, sha256, size_bytes) taken before."""
    from emberline.operators.quality import reconcile_files

    uncounted = lambda d: d.select("path", "sha256", "size_bytes", F.lit(None).cast("long").alias("record_count"))
    return reconcile_files(uncounted(file_table(spark, path)), uncounted(manifest))


def keyed_replace(existing: DataFrame, new: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``existing`` without the rows of ``keys``, plus ``new``."""
    return existing.join(keys.select(*on).distinct(), on, "left_anti").unionByName(new)


def pending(work: DataFrame, ledger: DataFrame, key: str, version: str) -> DataFrame:
    """Work not yet completed or failed under this version."""
    return work.join(ledger.where((F.col("version") == version) & F.col("status").isin("completed", "failed")), key, "left_anti")


def run_report(work: DataFrame, ledger: DataFrame, key: str, version: str) -> DataFrame:
    own = ledger.where(F.col("version") == version).select(key, "status").distinct()
    rows = work.select(key).distinct().join(own, key, "left")
    return rows.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("pending"))


def signature(*fields: str) -> Column:
    """Hash of all inputs of a result; the result may be reused only if it is equal."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"}), 256)


def reusable(inputs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Cached results whose key and signature both match."""
    return cache.join(inputs.select(key, "signature"), [key, "signature"], "left_semi")


def typed_empty(spark: SparkSession, schema: str, path: str) -> None:
    """A table of no rows that keeps its columns."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
