"""Normalising text fields of detection files, as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "missing", words that mean true.
MISSING_TOKENS = ("", "na", "n/a", "nan", "none", "null", "no data")
TRUE_WORDS = ("true", "1", "yes", "si", "sí")


def missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING_TOKENS)


def number(c: Column) -> Column:
    """A finite double, or null."""
    v = F.when(~missing(c), F.trim(c).try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    return F.coalesce(number(latitude).between(-90, 90) & number(longitude).between(-180, 180), F.lit(False))


def acquisition_date(c: Column) -> Column:
    """yyyy-MM-dd, yyyy/MM/dd or yyyyMMdd, with or without a time behind T or a space; null if none fits."""
    text = F.replace(F.regexp_extract(F.trim(c), "^([^T ]*)", 1), F.lit("/"), F.lit("-"))
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    plain = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
    return F.when(~missing(c), F.coalesce(dashed, plain))


def acquisition_time(c: Column) -> Column:
    """HH:mm:ss text of HH:MM[:SS], one to four digits (hours and minutes) or six digits; null if none fits."""
    text = F.trim(c)
    digits = F.when(text.rlike(r"^\d{1,4}$"), F.concat(F.lpad(text, 4, "0"), F.lit("00"))).when(text.rlike(r"^\d{6}$"), text)
    part = lambda i: F.lpad(F.regexp_extract(text, r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$", i), 2, "0")
    clock = F.when(text.rlike(r"^\d{1,2}:\d{1,2}(:\d{1,2})?$"), F.concat(part(1), part(2), part(3)))
    six = F.coalesce(digits, clock)
    ok = (F.substring(six, 1, 2) < "24") & (F.substring(six, 3, 2) < "60") & (F.substring(six, 5, 2) < "60")
    return F.when(~missing(c) & ok, F.concat_ws(":", F.substring(six, 1, 2), F.substring(six, 3, 2), F.substring(six, 5, 2)))


def acquisition_timestamp(date: Column, time: Column) -> Column:
    """UTC timestamp, null if either part is."""
    day, clock = acquisition_date(date), acquisition_time(time)
    return F.when(day.isNotNull() & clock.isNotNull(), F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")))


def zoned_timestamp(c: Column) -> Column:
    """A timestamp whose text names its zone (Z or an offset), cut to seconds; null otherwise."""
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.date_trunc("SECOND", F.try_to_timestamp(F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2"))))


def text(c: Column, upper: bool = False) -> Column:
    return F.when(missing(c), "").otherwise(F.upper(F.trim(c)) if upper else F.lower(F.trim(c)))


def confidence(c: Column) -> tuple[Column, Column]:
    """Normalised text (a number in its shortest form, or a lower-case class) and the number, null for classes."""
    n = number(c)
    short = F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    return F.when(missing(c), "").when(n.isNotNull(), short).otherwise(F.lower(F.trim(c))), n


def day_night(c: Column) -> Column:
    code = F.upper(F.trim(c))
    return F.when(code.isin("D", "DAY"), "D").when(code.isin("N", "NIGHT"), "N").otherwise("")


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def strict_bool(c: Column) -> Column:
    """True or false for these words alone; null is a violation."""
    word = F.lower(F.trim(c))
    return F.when(word == "true", True).when(word == "false", False)


def label_key(c: Column) -> Column:
    """Accent- and case-free label with single spaces, for exact matches."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"), r"\s+", " "))


def buffer_key(c: Column) -> Column:
    """b0500, b1000 ... of 500, '500m', 'B0500' ...; null if there is no number."""
    digits = F.regexp_extract(F.lower(c.cast("string")), r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("b"), F.lpad(digits.cast("int").cast("string"), 4, "0")))


def role_key(c: Column) -> Column:
    word = F.regexp_replace(F.lower(F.trim(c)), "[-_ ]", "")
    return F.when(word.startswith("pre"), "pre").when(word.startswith("post"), "post")


def window_key(c: Column) -> Column:
    """pre30_post45 of any spelling of the two windows; null if either is missing."""
    word = F.regexp_replace(F.lower(F.trim(c)), "[-_ ]", "")
    pre, post = F.regexp_extract(word, r"pre(\d+)", 1), F.regexp_extract(word, r"post(\d+)", 1)
    return F.when((pre != "") & (post != ""), F.concat(F.lit("pre"), pre, F.lit("_post"), post))


def combination_key(buffer: Column, window: Column) -> Column:
    return F.concat_ws("_", buffer_key(buffer), window_key(window))


def combination_parts(c: Column) -> tuple[Column, Column, Column, Column]:
    """Buffer metres, pre days, post days and span of b0500_pre30_post45."""
    part = lambda p: F.regexp_extract(c, p, 1).try_cast("int")
    pre, post = part(r"pre(\d+)"), part(r"post(\d+)")
    return part(r"b(\d+)"), pre, post, pre + post


def redact_url(c: Column, secret: str) -> Column:
    """Without the secret, raw or percent-encoded."""
    from urllib.parse import quote

    for s in dict.fromkeys([secret, quote(secret, safe="")]):
        c = F.replace(c, F.lit(s), F.lit("[redacted]"))
    return c


def redact_query(c: Column) -> Column:
    """URL query values of key-like parameters masked."""
    return F.regexp_replace(c, r"(?i)([?&](?:key|token|secret|api_key|utm_source)=)[^&]*", "$1[redacted]")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")


def redact_diagnostic(c: Column) -> Column:
    """Error text without tokens, project ids or coordinate lists."""
    out = F.regexp_replace(c, r"(?i)(token|key|secret|password)\s*[=:]\s*\S+", "$1=[redacted]")
    out = F.regexp_replace(out, r"projects/[A-Za-z0-9_-]+", "projects/[redacted]")
    return F.regexp_replace(out, r"\[\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+\s*\]", "[redacted geometry]")


def path_class(c: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The class of the first pattern that a path matches."""
    out = F.lit(other)
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def json_cell(c: Column, fallback: str = "[]") -> tuple[Column, Column]:
    """A JSON cell in compact form with sorted keys, ``fallback`` where it is no JSON, and whether it was."""
    # The parser stops at the end of a value; wrapped, a cell with anything after it loses or adds a key.
    whole = F.concat(F.lit('{"v":'), c, F.lit(',"e":0}'))
    parsed = F.when(F.json_object_keys(whole) == F.array(F.lit("v"), F.lit("e")), F.try_variant_get(F.try_parse_json(whole), "$.v", "variant"))
    return F.coalesce(F.to_json(parsed), F.lit(fallback)), parsed.isNotNull()


def general_float(c: Column, digits: int = 15) -> Column:
    """A number in its shortest form of at most ``digits`` significant digits, as %g writes it; empty for null or non-finite.

    Python rounds the exact binary value, as C does; Java's formatter rounds its shortest decimal form once more.
    """

    @F.pandas_udf("string")
    def shown(v: pd.Series) -> pd.Series:
        return pd.Series([f"{x + 0.0:.{digits}g}" if math.isfinite(x) else "" for x in v.tolist()], dtype=object)

    return shown(c.cast("double"))


def trimmed_float(c: Column, digits: int = 8) -> Column:
    """Fixed digits without trailing zeros; empty for null or non-finite."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), shown).otherwise("")


def date_chunks(start: Column, end: Column, days: int) -> Column:
    """Array of (start, end) spans of at most ``days`` that cover start..end; to explode."""
    return F.transform(
        F.when(start <= end, F.sequence(start, end, F.expr(f"interval {days} days"))).otherwise(F.expr("cast(array() as array<date>)")),
        lambda s: F.struct(s.alias("chunk_start"), F.least(end, F.date_add(s, days - 1)).alias("chunk_end")),
    )


def overlap_hours(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> tuple[Column, Column, Column]:
    """Start, end and hours of what two intervals share; nulls if they share nothing."""
    lo, hi = F.greatest(start_a, start_b), F.least(end_a, end_b)
    some = lo <= hi
    return F.when(some, lo), F.when(some, hi), F.when(some, (F.unix_micros(hi) - F.unix_micros(lo)) / 3.6e9)


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9
