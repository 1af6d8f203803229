"""Scalar expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from connlens.schemas import ORIGIN_TEXTS

SCAN_TIME = "yyyyMMdd_HHmmss"
FILE_TIME = r"(\d{8}_\d{6})"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- times ---------------------------------------------------------------

def epoch_to_timestamp(c: str | Column) -> Column:
    """Epoch seconds, as text or number, to a timestamp; decimals keep every microsecond."""
    return F.timestamp_seconds(column(c).try_cast("decimal(20,6)"))


def text_to_timestamp(c: str | Column) -> Column:
    return F.try_to_timestamp(column(c))


def scan_time(c: str | Column) -> Column:
    """Time written in a scan id; null when the id has another form."""
    return F.try_to_timestamp(column(c), F.lit(SCAN_TIME))


def file_time(c: str | Column) -> Column:
    """First ``yyyyMMdd_HHmmss`` group in a file name, parsed."""
    return scan_time(F.regexp_extract(column(c), FILE_TIME, 1))


def scan_id_of(c: str | Column) -> Column:
    return F.date_format(column(c), SCAN_TIME)


def display_time(c: str | Column) -> Column:
    return F.upper(F.date_format(column(c), "dd MMM yyyy HH:mm"))


def plain_time(c: str | Column) -> Column:
    return F.date_format(column(c), "yyyy-MM-dd HH:mm:ss")


def iso_time(c: str | Column, suffix: str = "") -> Column:
    return F.concat(F.date_format(column(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(suffix))


def seconds_between(a: str | Column, b: str | Column) -> Column:
    return F.abs(F.unix_micros(column(a)) - F.unix_micros(column(b))) / F.lit(1e6)


def zoned_time(c: str | Column) -> Column:
    """ISO text with its offset, so that it reads back as the same instant in any session zone."""
    return F.date_format(column(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


# --- texts ---------------------------------------------------------------

def file_name(path: str | Column) -> Column:
    return F.regexp_extract(column(path), r"([^/]+)/*$", 1)


def file_stem(path: str | Column) -> Column:
    return F.regexp_extract(column(path), r"([^/]+?)([.][^./]*)?/*$", 1)


def is_ipv6(ip: str | Column) -> Column:
    return F.contains(column(ip), F.lit(":"))


def dash_to_null(c: str | Column, dtype: str = "string") -> Column:
    """``-`` and blanks become null, the rest is cast; bad numbers become null too."""
    text = F.nullif(F.trim(column(c)), F.lit("-"))
    return text if dtype == "string" else text.try_cast(dtype)


def split_class(c: str | Column) -> tuple[Column, Column]:
    """``category.subcategory`` cut at the first dot; a text without a dot is both parts."""
    parts = F.split(column(c), "[.]", 2)
    first = parts.getItem(0)
    return first, F.coalesce(F.get(parts, F.lit(1)), first)


# --- vectors -------------------------------------------------------------

def vector_from_text(c: str | Column) -> Column:
    """``[a, b, ...]`` to array<double>; null when empty or when any element is no number."""
    parsed = F.from_json(F.trim(column(c)), "array<double>")
    bad = (F.size(parsed) < 1) | F.exists(parsed, lambda x: x.isNull())
    return F.when(~bad, parsed)


def vector_to_text(c: str | Column) -> Column:
    """``[a, b, ...]``; a missing number is written as NaN."""
    cells = F.transform(column(c), lambda x: F.coalesce(x.cast("string"), F.lit("NaN")))
    return F.concat(F.lit("["), F.array_join(cells, ", "), F.lit("]"))


def fit_width(c: str | Column, width: int) -> Column:
    """Pad with zeros or cut so that every vector has ``width`` elements."""
    return F.slice(F.concat(column(c), F.array_repeat(F.lit(0.0), width)), 1, width)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(column(a), column(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(column(a), column(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


# --- numbers -------------------------------------------------------------

def missing(c: str | Column) -> Column:
    """Null or NaN."""
    return column(c).isNull() | F.isnan(column(c))


def zero_if_missing(c: str | Column) -> Column:
    return F.coalesce(F.nanvl(column(c), F.lit(0.0)), F.lit(0.0))


def ratio(n: Column, d: Column, scale: float = 1.0) -> Column:
    """``scale * n / d`` with 0 for an empty denominator."""
    return F.when(d > 0, F.lit(float(scale)) * n / d).otherwise(F.lit(0.0))


def lookup(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), default)


# --- case tables ---------------------------------------------------------

def severity(rate: str | Column, high: float = 50.0, medium: float = 20.0) -> Column:
    r = column(rate)
    return F.when(r > high, "high").when(r > medium, "medium").otherwise("low")


def score_band(score: str | Column, high: float = -0.5, moderate: float = 0.0) -> Column:
    s = column(score)
    return F.when(s < high, "high").when(s <= moderate, "moderate").when(s > moderate, "normal")


def origin_of_name(name: str | Column) -> Column:
    """Origin type told by a capture file's prefix."""
    n = column(name)
    return F.when(n.startswith("capture_"), "timed_capture").when(n.startswith("uploaded_"), "upload").otherwise("unknown")


def filled(template: str | None, fields: dict[str, Column]) -> Column:
    """A text with the named fields put in for their braces; null where a field is."""
    if template is None:
        return F.lit(None).cast("string")
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] * bool(text) + ([fields[name]] if name else [])
    return F.concat(*parts)


def origin_text(origin: Column, interface: Column, seconds: Column, original: Column, documented: Column) -> tuple[Column, Column]:
    """Short and long description of where a capture came from."""
    fields = {
        "iface": F.coalesce(interface, F.lit("unknown")), "file": F.coalesce(original, F.lit("unknown")),
        "seconds": F.coalesce(seconds, F.lit(0)).cast("string"), "origin": origin,
    }
    named = F.coalesce(origin, F.lit("unknown"))
    out = []
    for which in (2, 3):
        text = F.lit(None).cast("string")
        # Later rows are tried after earlier ones.
        for row in reversed(ORIGIN_TEXTS):
            fits = (documented == F.lit(row[0])) & (F.lit(True) if row[1] is None else named == row[1])
            text = F.when(fits, filled(row[which], fields)).otherwise(text)
        out.append(text)
    return out[0], out[1]
