"""Scalar functions, text search, entity resolution and similarity on the driver tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tallyloom.functions import scalar as sc
from tallyloom.operators import fuzzy, matching, search, vectors
from tallyloom.plans.registry import query
from tallyloom.sources.tables import first_match, unwrap_js


@query("json_props_scan", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props_scan(t):
    return t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("js_wrapped_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def js_wrapped_json(t):
    script = F.concat(F.lit("window.DATA = "), "props", F.lit(";\n"))
    return t.events.select("event_id", F.from_json(unwrap_js(script), "k BIGINT")["k"].alias("k"))


@query("html_embedded_extract", r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), nullif(regexp_extract(url, '/([a-z][a-z])/', 1), '')) AS lang, nullif(regexp_extract(html, 'track\(([0-9]+)\)', 1), '') AS tracked FROM pages""")
def html_embedded_extract(t):
    return t.pages.select("page_id", first_match(F.col("html"), "<title>([^<]*)</title>").alias("title"), F.coalesce(first_match(F.col("html"), '<html lang="([a-z]+)"'), first_match(F.col("url"), "/([a-z][a-z])/")).alias("lang"), first_match(F.col("html"), r"track\(([0-9]+)\)").alias("tracked"))


@query("cache_key_hash", "SELECT page_id, substr(sha256(url), 1, 20) AS key FROM pages")
def cache_key_hash(t):
    return t.pages.select("page_id", F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 20).alias("key"))


@query("slugify", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug FROM part")
def slugs(t):
    return t.part.select("p_partkey", sc.slugify(F.col("p_name")).alias("slug"))


@query("norm_text", "SELECT page_id, trim(regexp_replace(regexp_replace(upper(url), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM pages")
def norm_texts(t):
    return t.pages.select("page_id", sc.norm_text(F.col("url")).alias("norm"))


@query("norm_contains", "SELECT p_partkey, contains(trim(regexp_replace(regexp_replace(upper(p_name), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 'PART') AS found FROM part")
def norm_contains_rows(t):
    return t.part.select("p_partkey", sc.norm_contains(F.col("p_name"), F.lit("part")).alias("found"))


@query("clean_title", r"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('[NEW] (x) ' || c_name || ' #tag |', '^(\s*(\[[^\]]*\]|\([^)]*\))\s*)+', ''), '#[A-Za-z0-9_]+', '', 'g'), '\s+', ' ', 'g'), '^[\s|,.:;-]+|[\s|,.:;-]+$', '', 'g') AS title FROM customer""")
def clean_titles(t):
    return t.customer.select("c_custkey", sc.clean_title(F.concat(F.lit("[NEW] (x) "), "c_name", F.lit(" #tag |"))).alias("title"))


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN 'Stage ' || (p_size % 4) || ' Week ' || p_size || ' Day-3' WHEN 1 THEN p_name || ' [DAY ' || p_size || '] ' || p_type WHEN 2 THEN 'week' || (p_partkey % 53) || ' / ' || p_brand ELSE p_name || ' weekly ' || p_brand END"
_FIELD = "nullif(regexp_extract(lower({t}), '{w}[ -]?([0-9]{{1,2}})', 1), '')::INTEGER"


@query("parse_title_fields", f"SELECT p_partkey, {', '.join(_FIELD.format(t=_TITLE, w=w) + f' AS {w}' for w in ('stage', 'week', 'day'))} FROM part")
def parse_title_fields(t):
    """STR-05: stage, week and day wherever they stand in a title, null where they don't."""
    text = lambda c: F.col(c).cast("string")
    kind = F.col("p_partkey") % 4
    title = (
        F.when(kind == 0, F.concat(F.lit("Stage "), (F.col("p_size") % 4).cast("string"), F.lit(" Week "), text("p_size"), F.lit(" Day-3")))
        .when(kind == 1, F.concat("p_name", F.lit(" [DAY "), text("p_size"), F.lit("] "), "p_type"))
        .when(kind == 2, F.concat(F.lit("week"), (F.col("p_partkey") % 53).cast("string"), F.lit(" / "), "p_brand"))
        .otherwise(F.concat("p_name", F.lit(" weekly "), "p_brand"))
    )
    return t.part.select("p_partkey", *(sc.title_number(title, w).alias(w) for w in ("stage", "week", "day")))


@query("split_rejoin", "SELECT n_nationkey, array_to_string(list_transform(string_split(n_name || ' | ' || n_regionkey, '|'), lambda x: trim(x)), ' — ') AS joined FROM nation")
def split_rejoin(t):
    return t.nation.select("n_nationkey", F.array_join(F.transform(F.split(F.concat_ws(" | ", "n_name", F.col("n_regionkey").cast("string")), r"\|"), lambda x: F.trim(x)), " — ").alias("joined"))


@query("line_regex_explode", r"SELECT doc_id, count(*)::BIGINT AS lines, (count(*) FILTER (regexp_matches(line, '[0-9]')))::BIGINT AS numbered FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def line_regex_explode(t):
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike("[0-9]")).alias("numbered"))


@query("short_code", "SELECT c_custkey, replace(upper(substr(c_mktsegment || ' x', 1, 6)), ' ', '') AS code FROM customer")
def short_codes(t):
    return t.customer.select("c_custkey", sc.short_code(F.concat("c_mktsegment", F.lit(" x"))).alias("code"))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def html_escapes(t):
    return t.pages.select("page_id", F.md5(sc.html_escape(F.col("html")).cast("binary")).alias("escaped"))


@query("append_note", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END || ' | ', '') || lang AS note FROM documents LEFT JOIN labels USING (doc_id)")
def append_notes(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", sc.append_note(F.when(F.col("quality") == 1, "good"), F.col("lang")).alias("note"))


@query("shape_predicate", "SELECT p_partkey, regexp_matches(p_brand, '^Brand#[0-9]{2}$') AS shaped FROM part")
def shape_predicate(t):
    return t.part.select("p_partkey", F.col("p_brand").rlike("^Brand#[0-9]{2}$").alias("shaped"))


@query("canonical_url", r"""SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '\.html$', ''), '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS url FROM (SELECT *, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('ref', 'utm_source')) AS q FROM pages)""")
def canonical_urls(t):
    return t.pages.select("page_id", sc.canonical_url(F.col("url")).alias("url"))


@query("url_tail_id", r"SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)(?:\.html)?(?:[?#].*)?$', 1), '') AS tail FROM pages")
def url_tail_id(t):
    return t.pages.select("page_id", sc.url_tail(F.col("url")).alias("tail"))


@query("tolerant_timestamp", "SELECT event_id, floor(epoch(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'not a time' ELSE ts::VARCHAR END AS TIMESTAMP)))::BIGINT AS t FROM events")
def tolerant_timestamps(t):
    text = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return t.events.select("event_id", F.unix_timestamp(sc.tolerant_timestamp(text)).alias("t"))


@query("iso_duration_seconds", "SELECT p_partkey, (p_size * 60 + 30)::INTEGER AS seconds FROM part")
def iso_durations(t):
    return t.part.select("p_partkey", sc.iso_duration_seconds(F.concat(F.lit("PT"), F.col("p_size").cast("string"), F.lit("M30S"))).alias("seconds"))


@query("hms_to_seconds", "SELECT p_partkey, (3600 + p_size * 60 + 5)::INTEGER AS seconds FROM part")
def hms_to_seconds(t):
    return t.part.select("p_partkey", sc.clock_seconds(F.concat(F.lit("1:"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(":05"))).alias("seconds"))


@query("seconds_to_clock", "SELECT event_id, (event_id // 3600)::VARCHAR || ':' || lpad((event_id % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS clock FROM events")
def seconds_to_clock(t):
    return t.events.select("event_id", sc.seconds_clock(F.col("event_id")).alias("clock"))


@query("epoch_auto_unit", "SELECT event_id, floor(epoch(ts))::BIGINT AS t FROM events")
def epoch_auto_units(t):
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", sc.epoch_auto_unit(F.when(F.col("event_id") % 2 == 0, s * 1000 + 7).otherwise(s)).alias("t"))


@query("multi_format_date", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def multi_format_dates(t):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return t.orders.select("o_orderkey", sc.multi_format_date(text, "yyyy-MM-dd", "dd/MM/yyyy").cast("string").alias("day"))


@query("iso_date_prefix", "SELECT event_id, substr(ts::VARCHAR, 1, 10) AS day FROM events")
def iso_date_prefix(t):
    return t.events.select("event_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("day"))


@query("staleness_flag", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-01-01')::INTEGER AS age, o_orderdate::DATE < DATE '1998-01-01' - 365 AS stale FROM orders")
def staleness_flag(t):
    age = F.date_diff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", age.alias("age"), (age > 365).alias("stale"))


@query("rolling_cutoff", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' - 30 AND DATE '1997-01-01' + 30")
def rolling_cutoff(t):
    now = F.lit("1997-01-01").cast("date")
    return t.orders.where(F.to_date("o_orderdate").between(F.date_sub(now, 30), F.date_add(now, 30))).select("o_orderkey")


@query("tolerant_cast", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'n/a' END AS INTEGER) AS size FROM part")
def tolerant_cast(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").try_cast("int").alias("size"))


@query("clamp_pct", "SELECT event_id, round(least(greatest(value * 2 - 50, 0), 100), 4) AS pct FROM events")
def clamp_pct(t):
    return t.events.select("event_id", F.round(sc.clamp(F.col("value") * 2 - 50, 0.0, 100.0), 4).alias("pct"))


@query("poly_hash", "SELECT n_nationkey, list_reduce(list_prepend(0, list_transform(string_split(n_name, ''), lambda c: ascii(c)::INTEGER)), lambda h, c: (h * 31 + c) % 360)::INTEGER AS hue FROM nation")
def poly_hashes(t):
    return t.nation.select("n_nationkey", sc.poly_hash(F.col("n_name")).alias("hue"))


@query("bucket_region", "SELECT event_id, least(7, floor(value / 100 * 8))::BIGINT AS bucket FROM events")
def bucket_region(t):
    return t.events.select("event_id", F.least(F.lit(7), F.floor(F.col("value") / 100 * 8)).alias("bucket"))


@query("box_iou", """SELECT p_partkey, round(i / (100 + p_size * 10 - i), 5) AS iou FROM (SELECT p_partkey, p_size, greatest(0, least(10, 5 + p_size) - 5) * 10.0 AS i FROM part)""")
def box_ious(t):
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), v, strict=True))
    a = box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    b = box(F.lit(5.0), F.lit(0.0), F.lit(5.0) + F.col("p_size"), F.lit(10.0))
    return t.part.select("p_partkey", F.round(sc.box_iou(a, b), 5).alias("iou"))


@query("map_top2", """WITH s AS (SELECT user_id, event_type, round(max(value), 4) AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS k FROM s)
  SELECT user_id, max(event_type) FILTER (k = 1) AS top, max(event_type) FILTER (k = 2) AS second FROM r GROUP BY 1""")
def map_top2_rows(t):
    s = t.events.groupBy("user_id", "event_type").agg(F.round(F.max("value"), 4).alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    top = sc.map_top2(F.col("m"))
    return s.select("user_id", F.get(top, F.lit(0))["key"].alias("top"), F.get(top, F.lit(1))["key"].alias("second"))


@query("json_merge_patch", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type AS kind FROM events")
def json_merge_patch(t):
    patched = F.map_concat(F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "kind"), F.create_map(F.lit("kind"), F.col("event_type")))
    return t.events.select("event_id", patched["k"].cast("long").alias("k"), patched["kind"].alias("kind"))


@query("json_get_default", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS other FROM events")
def json_get_default(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"), F.coalesce(F.get_json_object("props", "$.other"), F.lit("none")).alias("other"))


@query("ci_key_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def ci_key_get(t):
    lowered = F.transform_keys(F.from_json(F.replace("props", F.lit('"k"'), F.lit('"K"')), "map<string,string>"), lambda k, v: F.lower(k))
    return t.events.select("event_id", lowered["k"].alias("k"))


@query("alias_cascade", """WITH a AS (SELECT n_nationkey, lower(n_name) AS name FROM nation), q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN substr(lower(n_name), 1, 8) ELSE 'x' || n_nationkey END AS alias FROM customer JOIN nation ON n_nationkey = c_nationkey),
  p AS (SELECT alias, min(n_nationkey) AS k, count(*) AS n FROM (SELECT DISTINCT alias FROM q) JOIN a ON starts_with(name, alias) GROUP BY 1)
  SELECT c_custkey, coalesce(a.n_nationkey, CASE WHEN p.n = 1 THEN p.k END) AS nation, CASE WHEN a.n_nationkey IS NOT NULL THEN 'exact' WHEN p.n = 1 THEN 'prefix' END AS how FROM q LEFT JOIN a ON a.name = alias LEFT JOIN p ON p.alias = q.alias""")
def alias_cascade(t):
    """ER-01: exact, then a prefix that only one name has; ambiguity is none."""
    names = t.nation.select("n_nationkey", F.lower("n_name").alias("name"))
    customers = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    alias = F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).when(F.col("c_custkey") % 3 == 1, F.substring(F.lower("n_name"), 1, 8)).otherwise(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")))
    q = customers.select("c_custkey", alias.alias("alias"))
    # Every prefix of every name, so that a prefix match is an equi-join.
    prefixes = names.select("n_nationkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("alias"))
    unique = prefixes.groupBy("alias").agg(F.min("n_nationkey").alias("by_prefix"), F.count("*").alias("n")).where("n = 1")
    rows = q.join(names.select(F.col("name").alias("alias"), F.col("n_nationkey").alias("exact")), "alias", "left").join(unique, "alias", "left")
    return rows.select("c_custkey", F.coalesce("exact", "by_prefix").alias("nation"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_prefix").isNotNull(), "prefix").alias("how"))


@query("shared_key_refusal", "SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) = 1 THEN s_nationkey END AS owner FROM supplier")
def shared_key_refusal(t):
    return t.supplier.select("s_suppkey", F.when(F.count("*").over(Window.partitionBy("s_nationkey")) == 1, F.col("s_nationkey")).alias("owner"))


_STRIP = "q AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(CASE c_custkey % 4 WHEN 0 THEN 'at ' || n_name || ' now' WHEN 1 THEN n_name || '/' || r_name WHEN 2 THEN r_name ELSE c_mktsegment END), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _strips(t):
    """A text per customer that names a nation, a nation and its region, a region or none."""
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("at "), "n_name", F.lit(" now"))).when(kind == 1, F.concat_ws("/", "n_name", "r_name")).when(kind == 2, F.col("r_name")).otherwise(F.col("c_mktsegment"))
    return rows.select("c_custkey", text.alias("strip"))


@query("contains_unique_match", f"""WITH {_STRIP}, n AS (SELECT n_nationkey AS id, trim(regexp_replace(upper(n_name), '[^A-Z0-9 ]', ' ', 'g')) AS name FROM nation UNION ALL SELECT 100 + r_regionkey, upper(r_name) FROM region),
  h AS (SELECT c_custkey, count(*) AS k, min(id) AS id, max(CASE WHEN t = name THEN id END) AS exact FROM q JOIN n ON contains(t, name) GROUP BY 1)
  SELECT q.c_custkey, coalesce(exact, CASE WHEN k = 1 THEN id END)::INTEGER AS id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN k = 1 THEN 'contains' ELSE 'none' END AS method, CASE WHEN exact IS NOT NULL OR k = 1 THEN NULL WHEN k > 1 THEN 'ambiguous' ELSE 'far' END AS reason FROM q LEFT JOIN h USING (c_custkey)""")
def contains_unique_match(t):
    """ER-03 without its fuzzy step: the whole name, or the one catalog name that the text contains."""
    names = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name")))
    found = matching.match_names(_strips(t), "strip", names, least_chars=3, codes=False, contained=True, fuzzy=False)
    return found.select("c_custkey", "id", "method", "reason")


@query("map_match")  # rows only: matching blocks have no SQL; tests hold it against a plain version
def map_match(t):
    """ER-03: exact, contained in the text, then the most similar name by a margin."""
    names = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return matching.match_names(_strips(t), "strip", names, least_chars=3, codes=False, contained=True).select("c_custkey", "id", "quality", "method", "reason")


@query("team_match")  # rows only: matching blocks have no SQL; tests hold it against a plain version
def team_match(t):
    """ER-02: exact, code, a word that is a code, then the most similar name by a margin."""
    teams = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"))
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 2000).cast("string"), 9, "0"))).when(kind == 1, F.concat(F.lit("S"), (F.col("p_size") * 3).cast("string"))).when(kind == 2, F.concat(F.lit("vs S"), F.col("p_size").cast("string"), F.lit(" live"))).otherwise(F.col("p_type"))
    return matching.match_names(t.part.select("p_partkey", text.alias("strip")), "strip", teams).select("p_partkey", "id", "quality", "method", "reason")


@query("identity_precedence", "SELECT e.event_id, coalesce(c.c_custkey, s.s_suppkey, -1) AS identity FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON c.c_custkey = e.user_id LEFT JOIN supplier s ON s.s_suppkey = e.user_id")
def identity_precedence(t):
    c = t.customer.where("c_acctbal > 5000").select("c_custkey")
    rows = t.events.join(c, F.col("c_custkey") == F.col("user_id"), "left").join(t.supplier.select("s_suppkey"), F.col("s_suppkey") == F.col("user_id"), "left")
    return rows.select("event_id", F.coalesce("c_custkey", "s_suppkey", F.lit(-1)).alias("identity"))


_PAIR = """v AS (SELECT o_orderkey, o_orderpriority || ' ' || c_name || ' ' || c_mktsegment AS text, o_orderpriority, o_orderstatus, o_totalprice, c_nationkey, n_name, n_regionkey, r_name, c_acctbal, (o_orderkey * 7) % 97 AS hours, CASE WHEN o_orderkey % 11 > 0 THEN floor(o_totalprice / 100)::BIGINT END AS seconds
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_HIT = [
    ("o_orderpriority = '1-URGENT'", 40, "official"), ("o_orderpriority <> '1-URGENT'", -30, "unofficial"), ("contains(upper(text), 'BUILDING')", 15, "team a"), ("contains(upper(text), 'MACHINERY')", 15, "team b"),
    ("contains(upper(text), 'HOUSEHOLD')", 15, "competition"), ("contains(upper(text), 'MEDIUM') OR contains(upper(text), 'LOW')", 10, "title"), ("n_regionkey = 2", 10, "region"), ("c_nationkey % 2 = 0", 5, "language"),
    ("contains(upper(text), 'FURNITURE')", 10, "room"), ("hours / 10.0 <= 0.5", 20, "time close"), ("hours / 10.0 > 0.5 AND hours / 10.0 <= 12", 8, "same day"), ("hours / 10.0 > 48", -25, "time conflict"),
    ("o_orderstatus = 'P'", 15, "both live"), ("seconds >= 1200", 5, "long enough"), ("seconds < 1200", -15, "too short"),
]


@query("additive_score_reasons", f"""WITH {_PAIR} SELECT o_orderkey, ({' + '.join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in _HIT)})::INTEGER AS score, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{w:+d} {n}' END" for c, w, n in _HIT)}) AS reasons FROM v""")
def additive_score_reasons(t):
    """ER-07: the fifteen signed weights of a broadcast against a match, orders standing for their pairs."""
    v = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    v = v.withColumn("text", sc.norm_text(F.concat_ws(" ", "o_orderpriority", "c_name", "c_mktsegment")))
    context = {
        "official": F.col("o_orderpriority") == "1-URGENT", "team_a": F.lit("building"), "team_b": F.lit("machinery"), "competition": F.lit("household"), "room": F.lit("furniture"),
        "same_region": F.col("n_regionkey") == 2, "same_language": F.col("c_nationkey") % 2 == 0, "both_live": F.col("o_orderstatus") == "P",
        "seconds": F.when(F.col("o_orderkey") % 11 > 0, F.floor(F.col("o_totalprice") / 100)),
    }
    score, reasons = matching.additive_score(matching.broadcast_rules(F.col("text"), ("medium", "low"), (F.col("o_orderkey") * 7) % 97 / 10, context))
    return v.select("o_orderkey", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query("keyword_score", "SELECT doc_id, (contains(text, 'License')::INTEGER * 5 + contains(text, 'token')::INTEGER * 3 + (n_chars > 1000)::INTEGER)::INTEGER AS score FROM documents")
def keyword_score(t):
    has = lambda w: F.contains("text", F.lit(w)).cast("int")
    return t.documents.select("doc_id", (has("License") * 5 + has("token") * 3 + (F.col("n_chars") > 1000).cast("int")).alias("score"))


@query("classify_exactly_one", "SELECT label, count(*)::BIGINT AS n FROM (SELECT CASE WHEN max(value) > 99 THEN 'confirmed' WHEN max(value) > 95 THEN 'likely' WHEN count(*) > 50 THEN 'busy' ELSE 'other' END AS label FROM events GROUP BY user_id) GROUP BY 1")
def classify_exactly_one(t):
    u = t.events.groupBy("user_id").agg(F.max("value").alias("v"), F.count("*").alias("n"))
    return u.groupBy(F.when(F.col("v") > 99, "confirmed").when(F.col("v") > 95, "likely").when(F.col("n") > 50, "busy").otherwise("other").alias("label")).agg(F.count("*").alias("n"))


@query("split_by_confidence", "SELECT CASE WHEN value >= 90 THEN 'link' WHEN value >= 50 THEN 'review' ELSE 'reject' END AS sink, count(*)::BIGINT AS n FROM events GROUP BY 1")
def split_by_confidence(t):
    return t.events.groupBy(F.when(F.col("value") >= 90, "link").when(F.col("value") >= 50, "review").otherwise("reject").alias("sink")).agg(F.count("*").alias("n"))


@query("search_substring_rank", "SELECT doc_id, pos FROM (SELECT doc_id, instr(lower(text), 'license')::INTEGER AS pos FROM documents) WHERE pos > 0 ORDER BY pos, doc_id LIMIT 14")
def search_substring_rank(t):
    return t.documents.select("doc_id", F.instr(F.lower("text"), F.lit("license")).alias("pos")).where("pos > 0").orderBy("pos", "doc_id").limit(14)


_INDEX = """i AS (SELECT 'part' AS kind, p_partkey AS id, lower(p_name) AS title, lower(p_type) AS tags, lower(p_brand) AS extra FROM part UNION ALL SELECT 'supplier', s_suppkey, lower(s_name), lower(n_name), '' FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'customer', c_custkey, lower(c_name), lower(c_mktsegment), '' FROM customer)"""


@query("search_fuzzy_topk", f"""WITH {_INDEX}, s AS (SELECT kind, id, 3 * levenshtein(title, 'part 100') + 2 * levenshtein(tags, 'promo') + CASE WHEN contains(extra, '1') THEN 0 ELSE 2 END AS distance FROM i)
  SELECT kind, id, distance::INTEGER AS distance FROM s ORDER BY distance, kind, id LIMIT 14""")
def search_fuzzy_topk(t):
    """ER-11: one ranking over entries of several kinds, their fields weighing three, two and one; the best 14."""
    entry = lambda df, kind, key, title, tags, extra: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lower(title).alias("title"), F.lower(tags).alias("tags"), F.lower(extra).alias("extra"))
    suppliers = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    index = entry(t.part, "part", "p_partkey", "p_name", "p_type", "p_brand").unionByName(entry(suppliers, "supplier", "s_suppkey", "s_name", "n_name", F.lit(""))).unionByName(entry(t.customer, "customer", "c_custkey", "c_name", "c_mktsegment", F.lit("")))
    distance = 3 * F.levenshtein("title", F.lit("part 100")) + 2 * F.levenshtein("tags", F.lit("promo")) + F.when(F.contains("extra", F.lit("1")), 0).otherwise(2)
    return index.select("kind", "id", distance.alias("distance")).orderBy("distance", "kind", "id").limit(14)


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query("search_many_terms", f"""WITH i AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS label, p_type AS terms, p_brand AS sub FROM part UNION ALL
    SELECT 'supplier', s_suppkey, s_name, n_name, '' FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment, '' FROM customer),
  h AS (SELECT kind, id, 6 AS weight, unnest({_TOKENS.format("label")}) AS token FROM i UNION ALL SELECT kind, id, 3, unnest({_TOKENS.format("terms")}) FROM i UNION ALL SELECT kind, id, 1, unnest({_TOKENS.format("sub")}) FROM i),
  a AS (SELECT s_suppkey AS query, unnest({_TOKENS.format("n_name || ' ' || p_name || ' ' || p_brand || ' customer'")}) AS token FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = s_suppkey),
  s AS (SELECT query, kind, id, sum(weight)::BIGINT AS score FROM a JOIN h USING (token) GROUP BY ALL)
  SELECT query, rank::INTEGER AS rank, kind, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, kind, id) AS rank FROM s) WHERE rank <= 14""")
def search_many_terms(t):
    """ER-11: search texts from the tables, a supplier's nation with a part's name and brand, over entries of three kinds."""
    entry = lambda df, kind, key, label, terms, sub: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(label).alias("label"), F.col(terms).alias("terms"), sub.alias("sub"))
    suppliers = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    entries = entry(t.part, "part", "p_partkey", "p_name", "p_type", F.col("p_brand"))
    entries = entries.unionByName(entry(suppliers, "supplier", "s_suppkey", "s_name", "n_name", F.lit(""))).unionByName(entry(t.customer, "customer", "c_custkey", "c_name", "c_mktsegment", F.lit("")))
    texts = suppliers.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query"), F.concat_ws(" ", "n_name", "p_name", "p_brand", F.lit("customer")).alias("text"))
    return search.top_entries(entries, texts)


@query("unmatched_candidates", r"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE word NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM conversations) GROUP BY 1")
def unmatched_candidates(t):
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    known = words(t.conversations).distinct()
    return words(t.benchmark).groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left_anti")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", vectors.doubles("embedding").alias("v"))


_CENTRES = "c AS (SELECT label, list(x ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
#: The searches' stated query set.
_ASKED = "vec_id % 50 = 0"


@query("cosine_similarity", f"WITH {_CENTRES} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS sim FROM embeddings JOIN c USING (label)")
def cosine_similarity(t):
    """SIM-01: every vector with its label's mean."""
    v = _vectors(t)
    return v.join(vectors.centroids(v), "label").select(F.col("id").alias("vec_id"), F.round(sc.cosine(F.col("v"), F.col("centre")), 6).alias("sim"))


@query("knn_topk", f"WITH s AS (SELECT q.vec_id, r.vec_id AS other, round(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings r ON q.{_ASKED} AND r.vec_id <> q.vec_id) SELECT vec_id, other, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS k FROM s) WHERE k <= 3")
def knn_topk(t):
    found = vectors.top_k(_vectors(t).where("id % 50 = 0"), _vectors(t), 3)
    return found.select(F.col("query_id").alias("vec_id"), F.col("id").alias("other"), "rank")


@query("best_variant_per_class", f"SELECT q.vec_id, r.label, round(max(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[])), 6) AS best FROM embeddings q JOIN embeddings r ON q.{_ASKED} AND r.vec_id <> q.vec_id GROUP BY ALL")
def best_variant_per_class(t):
    return vectors.best_per_class(_vectors(t).where("id % 50 = 0"), _vectors(t)).withColumnRenamed("query_id", "vec_id")


@query("leave_one_out", f"WITH s AS (SELECT q.vec_id, q.label, arg_max(r.label, (round(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9), -r.vec_id)) AS guess FROM embeddings q JOIN embeddings r ON q.{_ASKED} AND r.vec_id <> q.vec_id GROUP BY ALL) SELECT label, count(*)::BIGINT AS n, (count(*) FILTER (guess = label))::BIGINT AS hits FROM s GROUP BY 1")
def leave_one_out(t):
    """AGG-25: how often the nearest of all other vectors has a query's own label."""
    asked = _vectors(t).where("id % 50 = 0")
    guess = vectors.top_k(asked, _vectors(t), 1).select(F.col("query_id").alias("id"), F.col("label").alias("guess"))
    return asked.select("id", "label").join(guess, "id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("guess") == F.col("label")).alias("hits"))


@query("worst_check_verdict", r"""SELECT doc_id, CASE greatest(CASE WHEN n_chars < 50 THEN 2 WHEN n_chars < 200 THEN 1 ELSE 0 END, CASE WHEN a < 0.5 THEN 2 WHEN a < 0.7 THEN 1 ELSE 0 END) WHEN 2 THEN 'REJECT' WHEN 1 THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict
  FROM (SELECT doc_id, n_chars, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / nullif(length(text), 0) AS a FROM documents)""")
def worst_check_verdict(t):
    a = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.nullif(F.length("text"), F.lit(0))
    worst = F.greatest(F.when(F.col("n_chars") < 50, 2).when(F.col("n_chars") < 200, 1).otherwise(0), F.when(a < 0.5, 2).when(a < 0.7, 1).otherwise(0))
    return t.documents.select("doc_id", F.element_at(F.array(*map(F.lit, ("ACCEPT", "REVIEW", "REJECT"))), worst + 1).alias("verdict"))


@query("benchmark_contamination", r"""WITH b AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark))),
  d AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents)))
  SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM d JOIN b USING (g) GROUP BY ALL""")
def benchmark_contamination(t):
    """DQ-09: shared runs of eight words, known by a 64-bit hash. The benchmark's are broadcast while they are few."""

    def grams(df, key):
        w = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
        run = lambda i: F.xxhash64(*(F.get(F.col("w"), i + j) for j in range(8)))
        # A condition within the row: a filter on the words would cut each text a second time.
        runs = F.when(F.size("w") >= 8, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 8), run)))
        return df.select(key, w.alias("w")).select(key, F.explode(runs).alias("g"))

    known = grams(t.benchmark, "item_id")
    if known.count() <= 1_000_000:  # two numbers each: 16 MB
        known = F.broadcast(known)
    return grams(t.documents, "doc_id").join(known, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("leader_cluster", """WITH RECURSIVE o AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
  r AS (SELECT label, n, vec_id, vec_id AS leader, [{'id': vec_id, 'v': v}] AS led FROM o WHERE n = 1
    UNION ALL SELECT label, n, vec_id, coalesce(hit, vec_id), CASE WHEN hit IS NULL THEN list_append(led, {'id': vec_id, 'v': v}) ELSE led END
    FROM (SELECT o.label, o.n, o.vec_id, o.v, r.led, list_filter(r.led, lambda x: list_inner_product(x.v, o.v) >= 0.3)[1].id AS hit FROM r JOIN o ON o.label = r.label AND o.n = r.n + 1)) SELECT vec_id, leader FROM r""")
def leader_cluster(t):
    return vectors.leaders(_vectors(t), 0.3).select(F.col("id").alias("vec_id"), "leader")


def _picks_sql(picks: int) -> str:
    """Each pick's distances and choice as one more pair of tables."""
    parts = ["d1 AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, 'inf'::DOUBLE AS far FROM embeddings)", "p1 AS (SELECT label, min(vec_id) AS vec_id, arg_min(v, vec_id) AS v FROM d1 GROUP BY label)"]
    for k in range(2, picks + 1):
        parts.append(f"d{k} AS (SELECT d.label, d.vec_id, d.v, least(far, round(list_sum(list_transform(range(1, len(d.v) + 1), lambda i: (d.v[i] - p.v[i]) ** 2)), 9)) AS far FROM d{k - 1} d JOIN p{k - 1} p USING (label))")
        parts.append(f"p{k} AS (SELECT label, arg_max(vec_id, (far, -vec_id)) AS vec_id, arg_max(v, (far, -vec_id)) AS v FROM d{k} GROUP BY label)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT label, vec_id, {k}::INTEGER AS rank FROM p{k}" for k in range(1, picks + 1))


@query("diverse_pick", _picks_sql(5))
def diverse_pick(t):
    return vectors.farthest_first(_vectors(t), 5).select("label", F.col("id").alias("vec_id"), "rank")


@query("udf_ratio")  # rows only: difflib's ratio has no SQL
def udf_ratio(t):
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.round(ratio("n_name", "r_name"), 4).alias("ratio"))


@query("fuzzy_match_margin")  # rows only: difflib's ratio has no SQL
def fuzzy_match_margin(t):
    """ER-02: the best name if it is near enough (0.72) and by a margin (0.08) nearer than the next, else none."""
    asked = t.nation.select(F.col("n_nationkey").alias("asked"), F.substring(F.lower("n_name"), 2, 20).alias("text"))
    found = fuzzy.fuzzy_best(asked, t.nation.select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("id")), matching.FUZZY, matching.MARGIN)
    return asked.join(found, "text").select("asked", F.col("id").alias("found"), "reason")


@query("udaf_consensus", "SELECT user_id, median(value) AS middle FROM events GROUP BY 1")
def udaf_consensus(t):
    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())

    return t.events.groupBy("user_id").agg(middle("value").alias("middle"))


@query("udtf_parse_lines", "SELECT doc_id, i::INTEGER - 1 AS line, length(l)::INTEGER AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def udtf_parse_lines(t):
    @udtf(returnType="line int, chars int")
    class Lines:
        def eval(self, text: str) -> Iterator[tuple[int, int]]:
            for i, line in enumerate((text or "").split("\n")):
                yield i, len(line)

    t.spark.udtf.register("tallyloom_lines", Lines)
    t.documents.createOrReplaceTempView("tallyloom_documents")
    return t.spark.sql("SELECT doc_id, line, chars FROM tallyloom_documents, LATERAL tallyloom_lines(text)")
