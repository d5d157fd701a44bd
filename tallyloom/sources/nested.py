"""Documents whose structure isn't fixed: walks over nested JSON, embedded state, the flat subset of YAML."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How deep a walk and a search for one object go, and how many items of a list the search looks into.
WALK_DEPTH, DIG_DEPTH, DIG_ITEMS = 12, 6, 20

#: Where pages embed their state, in the order in which they are tried.
EMBEDDED = (
    r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>',
    r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
    r"(?s)window\.__PRELOADED_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
    r'(?s)<script[^>]+type="application/json"[^>]*>(\{.*?\})</script>',
)


def _nodes(value: object, depth: int, path: str, most_items: int | None) -> Iterator[tuple[str, int, dict]]:
    """Every object of a value with its path and depth, parents first; without recursion, so depth is no limit of the stack."""
    open_ = [(value, 0, path)]
    while open_:
        node, at, where = open_.pop()
        if at > depth:
            continue
        if isinstance(node, dict):
            yield where, at, node
            open_ += [(v, at + 1, f"{where}.{k}") for k, v in reversed(node.items())]
        elif isinstance(node, list):
            items = node if most_items is None else node[:most_items]
            open_ += [(v, at + 1, f"{where}[{i}]") for i, v in reversed(list(enumerate(items)))]


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text or "null")
    except ValueError:
        return None


def walk_json(df: DataFrame, key: str, document: str, wanted: tuple[tuple[str, ...], ...], max_depth: int = WALK_DEPTH) -> DataFrame:
    """SRC-12: `key`, path, depth and node (JSON) of every object of `document` that has, without regard to case, a key of
    each of the tuples `wanted`; objects deeper than max_depth aren't looked at. Broken or null documents give no rows."""
    groups = [{k.lower() for k in group} for group in wanted]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own, text in zip(pdf[key], pdf[document], strict=True):
                for path, depth, node in _nodes(_parsed(text), max_depth, "$", None):
                    have = {k.lower() for k in node}
                    if all(have & g for g in groups):
                        rows.append((own, path, depth, json.dumps(node, sort_keys=True, separators=(",", ":"))))
            yield pd.DataFrame(rows, columns=[key, "path", "depth", "node"])

    return df.where(F.col(key).isNotNull()).select(key, document).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, path string, depth int, node string")


def dig_json(document: Column, wanted: tuple[str, ...], max_depth: int = DIG_DEPTH) -> Column:
    """SRC-11: the first object, parents first, of a JSON text that has any of the keys `wanted`; null if there is none."""
    keys = set(wanted)

    @F.pandas_udf("string")
    def dig(texts: pd.Series) -> pd.Series:
        first = lambda t: next((json.dumps(n, sort_keys=True, separators=(",", ":")) for _, _, n in _nodes(_parsed(t), max_depth, "$", DIG_ITEMS) if keys & set(n)), None)
        return texts.map(first)

    return dig(document)


def embedded_state(html: Column, wanted: tuple[str, ...]) -> Column:
    """SRC-11: the first object with any of the keys in a page's embedded state, over all places that EMBEDDED names."""
    blobs = F.flatten(F.array(*(F.coalesce(F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.array().cast("array<string>")) for p in EMBEDDED)))
    return dig_json(F.concat(F.lit("["), F.array_join(F.filter(blobs, lambda b: F.try_parse_json(b).isNotNull()), ","), F.lit("]")), wanted, DIG_DEPTH + 1)


def flat_yaml(files: DataFrame, name: str, text: str) -> DataFrame:
    """SRC-07: `name`, line, key, item (number within a list, null for a scalar), value, kind and error of each entry.

    The subset is `key: value`, and `key:` with `- item` lines below it. kind is null, boolean, integer, number or string;
    quotes around a value go. A line that fits neither form, an item without a list and an indented key have `error`
    instead of a value: no typo is dropped. Comments and blank lines are skipped.
    """
    lines = files.select(name, F.posexplode(F.split(text, "\r?\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", r"\s+$", ""))
    quoted = F.contains("raw", F.lit('"')) | F.contains("raw", F.lit("'"))
    lines = lines.where((F.trim("raw") != "") & ~F.startswith(F.trim("raw"), F.lit("#")))
    lines = lines.withColumn("bare", F.when(quoted, bare).otherwise(F.trim(F.regexp_replace(bare, r"\s#.*$", ""))))
    is_item, has_key = F.startswith("bare", F.lit("- ")), F.contains("bare", F.lit(":"))
    indented = F.rlike("raw", F.lit(r"^\s"))
    key = F.when(~is_item & has_key & ~indented, F.trim(F.regexp_extract("bare", r"^([^:]*):", 1)))
    value = F.when(is_item, F.trim(F.substring("bare", 3, 1 << 30))).otherwise(F.trim(F.regexp_extract("bare", r"^[^:]*:(.*)$", 1)))
    w = Window.partitionBy(name).orderBy("line")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"key": key, "value": value, "is_item": is_item})
    # The key that an item belongs to is the last one, if that has no value of its own.
    last = F.last(F.when(F.col("key").isNotNull(), F.struct("key", (F.col("value") == "").alias("open"))), ignorenulls=True).over(up_to)
    marked = marked.withColumn("last", last)
    error = F.when(F.col("is_item") & ~F.coalesce(F.col("last.open"), F.lit(False)), "item without a list").when(~F.col("is_item") & ~has_key, "neither key nor item").when(~F.col("is_item") & indented, "indented key")
    marked = marked.withColumn("error", error).withColumn("key", F.when(F.col("error").isNull(), F.coalesce("key", "last.key")))
    item = F.row_number().over(Window.partitionBy(name, "key", "is_item").orderBy("line")) - 1
    marked = marked.withColumn("item", F.when(F.col("is_item") & F.col("error").isNull(), item))
    lowered = F.lower("value")
    kind = (
        F.when(lowered.isin("null", "~"), "null").when(lowered.isin("true", "false", "yes", "no"), "boolean").when(F.rlike("value", F.lit(r"^[+-]?\d+$")), "integer")
        .when(F.rlike("value", F.lit(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$")), "number").otherwise("string")
    )
    scalar = F.col("is_item") | (F.col("value") != "")
    plain = F.when(kind == "string", F.regexp_replace("value", r"""^(['"])(.*)\1$""", "$2")).when(kind != "null", F.col("value"))
    out = marked.withColumn("kind", F.when(F.col("error").isNull(), F.when(scalar, kind).otherwise("list"))).withColumn("value", F.when(F.col("error").isNull() & scalar, plain))
    return out.select(name, "line", "key", "item", "value", "kind", "error")


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    """PRJ-01: the column of that name, or the default where the table has none; a null in the column stays null."""
    return F.col(name) if name in df.columns else default
