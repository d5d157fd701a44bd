"""Column functions without Python workers: text, URLs, dates, numbers, JSON and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(x: Column, default: str = "unknown") -> Column:
    """STR-01: lower case, runs of other than a-z and 0-9 become one dash, none at the ends."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit(default))


def norm_text(x: Column) -> Column:
    """STR-02: upper case A-Z, digits and single blanks only."""
    return F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " "))


def norm_contains(haystack: Column, needle: Column) -> Column:
    """STR-03: containment of normalised text; an empty or null needle is in nothing."""
    return normal_contains(norm_text(haystack), needle)


def normal_contains(normal: Column, needle: Column) -> Column:
    """STR-03 where the haystack is normalised already, as a column that many needles are looked for in."""
    n = norm_text(needle)
    return F.coalesce(F.contains(normal, n) & (n != ""), F.lit(False))


def clean_title(x: Column) -> Column:
    """STR-04: without leading bracketed tags, hashtags and punctuation at the ends."""
    untagged = F.regexp_replace(x, r"^(\s*(\[[^\]]*\]|\([^)]*\))\s*)+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(untagged, r"#[A-Za-z0-9_]+", ""), r"\s+", " "), r"^[\s|,.:;-]+|[\s|,.:;-]+$", "")


def title_number(x: Column, word: str) -> Column:
    """STR-05: the number after a word such as day, week or stage."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.lower(x), rf"{word}[ -]?([0-9]{{1,2}})", 1), F.lit("")), F.lit("99")).cast("int")


def short_code(x: Column, n: int = 6) -> Column:
    """STR-08: the first n characters in upper case, then without blanks."""
    return F.replace(F.upper(F.substring(x, 1, n)), F.lit(" "), F.lit(""))


def html_escape(x: Column) -> Column:
    """STR-09."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def append_note(note: Column, more: Column) -> Column:
    """STR-10: more after note and a bar, or alone after none."""
    return F.concat(F.coalesce(F.concat(note, F.lit(" | ")), F.lit("")), more)


def canonical_url(x: Column, dropped: tuple[str, ...] = ("ref", "utm_source")) -> Column:
    """URL-01: https, host without www., path without .html and end slash, no fragment, kept parameters in order."""
    host = F.regexp_replace(F.lower(F.regexp_extract(x, r"^[a-z]+://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"^[a-z]+://[^/?#]+([^?#]*)", 1), r"\.html$", ""), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(x, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*dropped))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_tail(x: Column) -> Column:
    """URL-02: the last path segment's digits."""
    return F.nullif(F.regexp_extract(x, r"/([0-9]+)(?:\.html)?(?:[?#].*)?$", 1), F.lit(""))


def tolerant_timestamp(x: Column) -> Column:
    """DAT-01: null instead of an error."""
    return F.try_to_timestamp(x)


def iso_duration_seconds(x: Column) -> Column:
    """DAT-02: PT1H42M30S in seconds."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(x, rf"([0-9]+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def clock_seconds(x: Column) -> Column:
    """DAT-03: h:mm:ss or mm:ss in seconds."""
    return F.aggregate(F.split(x, ":"), F.lit(0), lambda total, part: total * 60 + part.cast("int"))


def seconds_clock(x: Column) -> Column:
    """DAT-03: seconds as h:mm:ss."""
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(F.floor(x / 3600).cast("string"), F.lit(":"), two(F.floor(x % 3600 / 60)), F.lit(":"), two(x % 60))


def epoch_auto_unit(x: Column) -> Column:
    """DAT-04: seconds since 1970 from seconds or milliseconds."""
    return F.when(x > 10**11, F.floor(x / 1000)).otherwise(x)


def multi_format_date(x: Column, *formats: str) -> Column:
    """DAT-05: the first format that parses."""
    return F.coalesce(*(F.try_to_date(x, f) for f in formats)) if hasattr(F, "try_to_date") else F.coalesce(*(F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats))


def rate(part: Column, whole: Column, digits: int = 5) -> Column:
    """NUM-02: a ratio, null where there is no evidence."""
    return F.round(F.try_divide(part, F.nullif(whole, F.lit(0))), digits)


def clamp(x: Column, low: float, high: float) -> Column:
    """NUM-03."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def band(x: Column, high: float, medium: float) -> Column:
    """NUM-04: high, medium or low; null stays null."""
    return F.when(x >= high, "high").when(x >= medium, "medium").when(x.isNotNull(), "low")


def poly_hash(x: Column, modulus: int = 360) -> Column:
    """NUM-05: the rolling hash of a text's characters."""
    return F.aggregate(F.transform(F.split(x, ""), F.ascii), F.lit(0), lambda h, c: (h * 31 + c) % modulus)


def map_top2(scores: Column) -> Column:
    """MAP-01: the entries of the two largest values, ties by key."""
    entries = F.map_entries(scores)
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.slice(F.array_sort(entries, order), 1, 2)


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """ARR-03: intersection over union of two boxes with x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    both = side("x0", "x1") * side("y0", "y1")
    area = lambda v: (v["x1"] - v["x0"]) * (v["y1"] - v["y0"])
    return F.try_divide(both, area(a) + area(b) - both)


def first_reason(cases: list[tuple[Column, str]]) -> Column:
    """FLT-07/12/17: the reason of the first case that holds, null if none."""
    return F.coalesce(*(F.when(case, F.lit(reason)) for case, reason in cases))


def all_reasons(cases: list[tuple[Column, str]], separator: str = "; ") -> Column:
    """FLT-16: the reasons of all cases that hold, joined."""
    return F.concat_ws(separator, *(F.when(case, F.lit(reason)) for case, reason in cases))


def dot(a: Column, b: Column) -> Column:
    """SIM-01: the inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
