"""Documents of open structure, flat configuration, paged sources and columns that may be missing."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.sources import nested, paged, sinks
from tallyloom.sources.scratch import shared_path
from tallyloom.sources.tables import enabled_entries, list_files, parse_feed, parse_lines, scan_or_empty


def _nested_customers(t):
    """A JSON document per customer: orders within years within the customer, so that their depth isn't one path."""
    order = F.struct(F.col("o_orderkey").alias("ID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("startDate"))
    years = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sort_array(F.collect_list(order)).alias("orders"))
    docs = years.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("y", "orders"))).alias("years"))
    return docs.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("id"), "years")).alias("doc"))


@query("json_walk", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) - 1 AS i, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) - 1 AS y FROM orders)
  SELECT o_custkey, '$.years[' || y || '].orders[' || i || ']' AS path, 4 AS depth, '{"ID":' || o_orderkey || ',"startDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS node FROM o""")
def json_walk(t):
    """SRC-12: every object that has an id and a date, wherever it lies."""
    return nested.walk_json(_nested_customers(t), "o_custkey", "doc", (("id", "key"), ("startdate", "start_date", "date")))


@query("json_dig", """SELECT o_custkey, arg_min(o_orderkey, (year(o_orderdate), o_orderkey)) AS first_order FROM orders GROUP BY 1""")
def json_dig(t):
    """SRC-11: the first match-like object of the state that a page embeds, past a script that isn't JSON."""
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__">{broken</script><script>window.__INITIAL_STATE__ = '), "doc", F.lit(";</script></html>"))
    node = nested.embedded_state(page, ("ID", "teams"))
    return _nested_customers(t).select("o_custkey", F.get_json_object(node, "$.ID").cast("long").alias("first_order"))


@query("flat_yaml", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation)
  SELECT r_name AS name, 1::INTEGER AS line, 'region' AS key, NULL::INTEGER AS item, r_regionkey::VARCHAR AS value, 'integer' AS kind, NULL::VARCHAR AS error FROM region
  UNION ALL SELECT r_name, 2, 'open', NULL, 'yes', 'boolean', NULL FROM region UNION ALL SELECT r_name, 3, 'share', NULL, r_regionkey || '.5', 'number', NULL FROM region
  UNION ALL SELECT r_name, 4, 'note', NULL, r_name || ': # kept', 'string', NULL FROM region UNION ALL SELECT r_name, 5, 'nations', NULL, NULL, 'list', NULL FROM region
  UNION ALL SELECT r_name, (6 + i)::INTEGER, 'nations', i::INTEGER, n_name, 'string', NULL FROM n JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT DISTINCT r_name, (6 + k)::INTEGER, NULL, NULL, NULL, NULL, 'indented key' FROM n JOIN region ON r_regionkey = n_regionkey""")
def flat_yaml(t):
    """SRC-07: a configuration per region: scalars of every kind, a list, and a line that doesn't fit."""
    names = t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: F.concat(F.lit("  - "), n["n_name"])), "\n").alias("items"))
    region = F.col("r_regionkey").cast("string")
    text = F.concat(F.lit("# one region\nregion: "), region, F.lit("  # a number\nopen: yes\nshare: "), region, F.lit(".5\nnote: '"), "r_name", F.lit(": # kept'\nnations:\n"), "items", F.lit("\n  stray: 1\n"))
    files = t.region.join(names, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), text.alias("text"))
    return nested.flat_yaml(files, "name", "text")


def _fixture(url: str) -> tuple[int, str | None, str | None]:
    """A transport that answers from the URL alone: resource k has 7 k items, the sixth one is away."""
    parts, asked = urlparse(url), parse_qs(urlparse(url).query)
    k, offset, limit = int(parts.path.rsplit("/", 1)[-1]), int(asked["offset"][0]), int(asked["limit"][0])
    if k == 6:
        return 503, None, "unavailable"
    return 200, json.dumps({"items": [{"id": k * 1000 + i} for i in range(offset, min(7 * k, offset + limit))]}), None


@query("paged_source", "SELECT 'r' || n_nationkey AS resource, i::INTEGER AS page, n_nationkey * 1000 + i * 10 + j AS id FROM nation, (SELECT unnest(range(20)) AS i), (SELECT unnest(range(10)) AS j) WHERE i * 10 + j < 7 * n_nationkey AND n_nationkey <> 6")
def paged_source(t):
    """SRC-10: all pages of every resource through a transport that needs no network."""
    resources = t.nation.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("resource"), F.concat(F.lit("https://api.example/"), F.col("n_nationkey").cast("string")).alias("url"))
    return paged.items_of(paged.read_pages(resources, _fixture, page_size=10), "id long")


@query("paged_account", "SELECT 'r' || n_nationkey AS resource, CASE WHEN n_nationkey = 6 THEN 1 ELSE 7 * n_nationkey // 10 + 1 END::BIGINT AS requests, (n_nationkey = 6)::BIGINT AS errors, greatest(0, 10 - CASE WHEN n_nationkey = 6 THEN 1 ELSE 7 * n_nationkey // 10 + 1 END)::BIGINT AS \"left\" FROM nation")
def paged_account(t):
    """SRC-10, AGG-31: the requests that this took, and what is left of a budget of ten."""
    resources = t.nation.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("resource"), F.concat(F.lit("https://api.example/"), F.col("n_nationkey").cast("string")).alias("url"))
    return paged.account(paged.read_pages(resources, _fixture, page_size=10), "2024-01-01", 10).drop("day")


@query("safe_column", "SELECT s_suppkey, s_acctbal AS balance, 'none' AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def safe_column(t):
    """PRJ-01: one projection of tables that lack some of its columns."""
    of = lambda df, key, balance: df.select(F.col(key).alias("s_suppkey"), nested.column_or(df, balance, F.lit(None)).alias("balance"), nested.column_or(df, "c_mktsegment", F.lit("none")).alias("segment"))
    return of(t.supplier, "s_suppkey", "s_acctbal").unionByName(of(t.customer, "c_custkey", "c_acctbal"))


@query("published_history", """WITH d AS (SELECT o_orderpriority, year(o_orderdate)::VARCHAR AS day, count(*)::BIGINT AS n FROM orders GROUP BY ALL) SELECT day, o_orderpriority, n, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY day)::BIGINT AS so_far FROM d""")
def published_history(t):
    """SNK-07: a history of snapshots, one appended per period and one of them twice, and what had come together by then."""
    counts = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("n"))
    path = shared_path(t.spark, "history")
    periods = [r["day"] for r in counts.where("day is not null").select("day").distinct().orderBy("day").collect()]  # a few years
    for day in [*periods, *periods[:1]]:
        sinks.append_snapshot(counts.where(F.col("day") == day).drop("day"), path, day)
    each = scan_or_empty(t.spark, path, "o_orderpriority string, n long, day string")
    return each.withColumn("so_far", F.sum("n").over(Window.partitionBy("o_orderpriority").orderBy("day")))


_ORGANISER = """WITH raw AS (SELECT s_suppkey, s_name, n_name, s_acctbal, s_suppkey % 5 AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query("normalise_records", f"""{_ORGANISER} SELECT 'team-' || s_suppkey AS id, CASE WHEN k = 0 THEN 'team-' || s_suppkey ELSE s_name END AS name, CASE WHEN k = 1 THEN 'unknown' ELSE lower(n_name) END AS region, CASE WHEN k = 2 THEN 0 ELSE 5 END::INTEGER AS players, CASE k WHEN 3 THEN 'finished' WHEN 4 THEN 'ongoing' ELSE 'unknown' END AS status FROM raw""")
def normalise_records(t):
    """PRJ-04: raw team records, in which any field may be missing or of another shape, as normalised rows."""
    raw = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey") % 5
    roster = F.when(k != 2, F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(i.alias("nickname"))))
    doc = F.to_json(F.struct(F.concat(F.lit("team-"), F.col("s_suppkey").cast("string")).alias("team_id"), F.when(k != 0, F.col("s_name")).alias("name"), F.struct(F.when(k != 1, F.col("n_name")).alias("region")).alias("profile"), roster.alias("roster"), F.when(k == 3, "FINISHED").when(k == 4, "ongoing").alias("status")))
    parsed = raw.select(F.from_json(doc, "team_id string, name string, profile struct<region: string>, roster array<struct<nickname: string>>, status string").alias("r"))
    return parsed.select(
        F.col("r.team_id").alias("id"), F.coalesce("r.name", "r.team_id").alias("name"), F.coalesce(F.lower("r.profile.region"), F.lit("unknown")).alias("region"),
        F.coalesce(F.size("r.roster"), F.lit(0)).alias("players"), F.coalesce(F.lower("r.status"), F.lit("unknown")).alias("status"),
    )


@query("jsonl_scan", """SELECT c_custkey, i::INTEGER AS line, (c_custkey * 10 + i)::DOUBLE / 2 AS t, CASE WHEN i = 0 THEN c_mktsegment END AS hero FROM customer, (SELECT unnest([0, 3]) AS i)""")
def jsonl_scan(t):
    """SRC-05: a log per customer of an observation, a broken one, a blank line and one with a field missing."""
    k = F.col("c_custkey") * 10
    log = F.concat(F.lit('{"t": '), (k / 2).cast("string"), F.lit(', "hero": "'), "c_mktsegment", F.lit('"}\n{"t": 1, "hero"\n  \n{"t": '), ((k + 3) / 2).cast("string"), F.lit("}\n"))
    return parse_lines(t.customer.withColumn("log", log), "c_custkey", "log", "t double, hero string")


@query("feed_entries", "SELECT n_regionkey AS region, n_nationkey AS id, n_name AS title FROM nation WHERE n_regionkey <> 3")
def feed_entries(t):
    """SRC-09: a feed per region; one that isn't XML has no entries."""
    entry = F.concat(F.lit("<entry><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><title>"), "n_name", F.lit("</title></entry>"))
    feeds = t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.collect_list(entry), "").alias("entries"))
    feed = F.when(F.col("region") == 3, "<feed><entry>").otherwise(F.concat(F.lit("<feed>"), "entries", F.lit("</feed>")))
    return parse_feed(feeds.withColumn("feed", feed), "region", "feed", "id: int, title: string")


@query("registry_scan", """SELECT 'n' || n_nationkey AS id, lower(n_name) AS name, r_name AS registry FROM nation JOIN region ON r_regionkey = n_regionkey
  WHERE n_nationkey % 4 <> 0 AND n_nationkey % 7 <> 3""")
def registry_scan(t):
    """SRC-08: the entries of each registry document that are enabled (as they are unless they say not) and no placeholders."""
    own = F.when(F.col("n_nationkey") % 7 == 3, F.concat(F.lit("PLACEHOLDER-"), "n_nationkey")).otherwise(F.concat(F.lit("n"), "n_nationkey"))
    enabled = F.when(F.col("n_nationkey") % 4 == 0, False).when(F.col("n_nationkey") % 4 == 1, True)
    entry = F.struct(own.alias("id"), F.lower("n_name").alias("name"), enabled.alias("enabled"))
    documents = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("doc"))
    found = documents.select(F.col("r_name").alias("registry"), F.explode(F.from_json("doc", "entries array<struct<id:string,name:string,enabled:boolean>>")["entries"]).alias("e"))
    return enabled_entries(found.select("e.*", "registry"), "id", "enabled").select("id", "name", "registry")


@query("folder_listing")  # rows only: SQL has no folder to list
def folder_listing(t):
    """SRC-13: the table files of the folder by name, without their contents."""
    return list_files(t.spark, t.folder, "*.parquet").select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name"), (F.col("length") > 0).alias("full")).distinct()
