"""DQ-01: rule reports of many checks from few scans, and identities whose history is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WARN, ERROR = "WARN", "ERROR"
# What the name of a team without an organisation holds.
UNSIGNED = ("mix team", "mix squad", "unsigned", "academy", "amateur", " tbd")


def report(parts: list[tuple[DataFrame, dict[str, tuple[str, Column]]]]) -> DataFrame:
    """name, n and severity (OK where n is 0) of every check of every part, whatever its outcome.

    A part is a table with checks, each a severity and the sum of what is wrong, as an aggregate: the table is read once for
    all of its checks. An empty table passes all.
    """
    out = None
    for df, checks in parts:
        sums = df.agg(*(F.coalesce(bad.cast("long"), F.lit(0)).alias(name) for name, (_, bad) in checks.items()))
        each = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("n"), F.lit(severity).alias("severity")) for name, (severity, _) in checks.items()))
        rows = sums.select(F.explode(each).alias("c")).select("c.name", "c.n", F.when(F.col("c.n") == 0, "OK").otherwise(F.col("c.severity")).alias("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out


def verdict(found: DataFrame, strict: bool = False) -> DataFrame:
    """ok, warnings, errors and result of a report, one row: FAIL with an error, with strict also with a warning."""
    count = lambda s: F.count_if(F.col("severity") == s)
    sums = found.agg(count("OK").alias("ok"), count(WARN).alias("warnings"), count(ERROR).alias("errors"))
    failed = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return sums.withColumn("result", F.when(failed, "FAIL").otherwise("PASS"))


def known(df: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str) -> DataFrame:
    """df with `name`: whether the dimension has the row's key (a null key is not known)."""
    there = dim.select(F.col(dim_key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(there, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def looks_unsigned(name: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))
    hit = F.lit(False)
    for marker in UNSIGNED:
        hit = hit | F.contains(padded, F.lit(marker))
    return hit


def identities(sightings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """ER-06: what is known of each id after all its sightings (key, name, region, external, authority) in order.

    The last name counts, earlier ones are listed in `previous` in the order in which they were given up, each once; an id
    without a name at first is named by itself. The first region but `Unknown` stays: another one that is reported later
    only sets `conflict`. status is unsigned once a name looks so. The first external id and authority stay; verified is
    the place of the first sighting with an external id. Rows with a null key are left out; order must tell rows apart.
    """
    w = Window.partitionBy(key).orderBy(*order)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    seen = sightings.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w))
    named = F.when((F.col("_n") == 1) & blank("name").isNull(), F.col(key).cast("string")).otherwise(blank("name"))
    seen = seen.withColumns({"_name": named, "_region": blank("region"), "_external": blank("external"), "_authority": blank("authority")})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.first(F.when(F.col("_region") != "Unknown", F.col("_region")), ignorenulls=True).over(before)
    seen = seen.withColumns({"_before": F.last("_name", ignorenulls=True).over(before), "_kept": own})
    given_up = F.when(F.col("_name") != F.col("_before"), F.struct("_n", F.col("_before").alias("name")))
    facts = seen.groupBy(key).agg(
        F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("_n"))).alias("name"),
        F.array_sort(F.collect_list(given_up)).alias("changes"),
        F.coalesce(F.min_by("_region", F.when(F.col("_region") != "Unknown", F.col("_n"))), F.lit("Unknown")).alias("region"),
        F.coalesce(F.bool_or(F.col("_region") != F.col("_kept")), F.lit(False)).alias("conflict"),
        F.when(F.bool_or(looks_unsigned(F.col("name"))), "unsigned").otherwise("active").alias("status"),
        F.min_by("_external", F.when(F.col("_external").isNotNull(), F.col("_n"))).alias("external"),
        F.min_by("_authority", F.when(F.col("_authority").isNotNull(), F.col("_n"))).alias("authority"),
        F.min(F.when(F.col("_external").isNotNull(), F.col("_n"))).alias("verified"),
    )
    previous = F.array_distinct(F.transform("changes", lambda c: c["name"]))
    return facts.select(key, "name", previous.alias("previous"), "region", "conflict", "status", "external", "authority", "verified")
