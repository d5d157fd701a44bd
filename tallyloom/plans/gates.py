"""Gates, precedence cases, projections and data-quality checks on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.scalar import all_reasons, band, first_reason
from tallyloom.operators import quality
from tallyloom.plans.registry import query

_NOW = "1998-01-01"


@query("rolling_window_bypass", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate >= DATE '{_NOW}' - INTERVAL 400 DAY")
def rolling_window_bypass(t):
    at = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return t.orders.where((F.col("o_orderstatus") == "F") | at.isNull() | (F.col("o_orderdate") >= F.expr(f"date '{_NOW}' - interval 400 days"))).select("o_orderkey")


@query("in_window_precedence", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'live' WHEN o_orderdate >= DATE '{_NOW}' - INTERVAL 90 DAY THEN 'recent' WHEN o_orderdate >= DATE '{_NOW}' - INTERVAL 365 DAY THEN 'past-year' ELSE 'old' END AS membership FROM orders""")
def in_window_precedence(t):
    d, since = F.col("o_orderdate"), lambda n: F.expr(f"date '{_NOW}' - interval {n} days")
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "live").when(d >= since(90), "recent").when(d >= since(365), "past-year").otherwise("old").alias("membership"))


@query("hard_floor_refusal", "SELECT doc_id, CASE WHEN text LIKE '%Shorts%' THEN 'shorts' WHEN n_chars < 100 THEN 'too-short' END AS refusal FROM documents")
def hard_floor_refusal(t):
    return t.documents.select("doc_id", first_reason([(F.contains("text", F.lit("Shorts")), "shorts"), (F.col("n_chars") < 100, "too-short")]).alias("refusal"))


@query("likeness_gate", "SELECT doc_id, ((lang = 'en')::INTEGER * 3 + (n_chars > 500)::INTEGER * 2 - (n_chars > 20000)::INTEGER * 4) AS score FROM documents WHERE ((lang = 'en')::INTEGER * 3 + (n_chars > 500)::INTEGER * 2 - (n_chars > 20000)::INTEGER * 4) >= 3")
def likeness_gate(t):
    score = (F.col("lang") == "en").cast("int") * 3 + (F.col("n_chars") > 500).cast("int") * 2 - (F.col("n_chars") > 20000).cast("int") * 4
    return t.documents.select("doc_id", score.alias("score")).where("score >= 3")


@query("first_hit_reject_reason", "SELECT event_id, CASE WHEN value < 5 THEN 'marker' WHEN event_type = 'error' THEN 'replay' WHEN value > 95 THEN 'anchor' END AS reason FROM events")
def first_hit_reject_reason(t):
    return t.events.select("event_id", first_reason([(F.col("value") < 5, "marker"), (F.col("event_type") == "error", "replay"), (F.col("value") > 95, "anchor")]).alias("reason"))


@query("keyword_scene_class", r"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\blicensed\b') THEN 'licence' WHEN regexp_matches(lower(text), '\b(idiot|stupid)\b') THEN 'insult' WHEN regexp_matches(lower(text), '\bthe\b') THEN 'english' ELSE 'other' END AS scene FROM documents")
def keyword_scene_class(t):
    x = F.lower("text")
    return t.documents.select("doc_id", F.when(x.rlike(r"\blicensed\b"), "licence").when(x.rlike(r"\b(idiot|stupid)\b"), "insult").when(x.rlike(r"\bthe\b"), "english").otherwise("other").alias("scene"))


@query("top2_margin_unknown", """WITH s AS (SELECT user_id, event_type, round(max(value), 6) AS v FROM events GROUP BY ALL), r AS (SELECT *, lead(v) OVER w AS second, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY user_id ORDER BY v DESC, event_type))
  SELECT user_id, CASE WHEN v < 60 OR v - coalesce(second, 0) < 2 THEN 'UNKNOWN' ELSE event_type END AS read, CASE WHEN v < 60 THEN 'no-match' WHEN v - coalesce(second, 0) < 2 THEN 'ambiguous' END AS reject FROM r WHERE k = 1""")
def top2_margin_unknown(t):
    s = t.events.groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.desc("v"), "event_type")
    top = s.withColumn("second", F.lead("v").over(w)).withColumn("k", F.row_number().over(w)).where("k = 1")
    reject = first_reason([(F.col("v") < 60, "no-match"), (F.col("v") - F.coalesce("second", F.lit(0)) < 2, "ambiguous")])
    return top.withColumn("reject", reject).select("user_id", F.when(F.col("reject").isNotNull(), "UNKNOWN").otherwise(F.col("event_type")).alias("read"), "reject")


@query("authorize_reason_code", """SELECT o_orderkey, CASE WHEN reason IS NULL THEN 'approved' ELSE 'review' END AS state, reason FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'metadata' WHEN c_custkey IS NULL THEN 'unregistered' WHEN c_acctbal < 0 THEN 'unlikely' END AS reason
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey)""")
def authorize_reason_code(t):
    known = t.customer.where("c_mktsegment <> 'BUILDING'")
    reason = first_reason([(F.col("o_totalprice") < 1000, "metadata"), (F.col("c_custkey").isNull(), "unregistered"), (F.col("c_acctbal") < 0, "unlikely")])
    rows = t.orders.join(known, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", reason.alias("reason"))
    return rows.select("o_orderkey", F.when(F.col("reason").isNull(), "approved").otherwise("review").alias("state"), "reason")


@query("forall_slots_strong", "SELECT l_orderkey, count(*) >= 3 AND bool_and(l_quantity >= 10) AS promoted FROM lineitem GROUP BY 1")
def forall_slots_strong(t):
    return t.lineitem.groupBy("l_orderkey").agg(((F.count("*") >= 3) & F.bool_and(F.col("l_quantity") >= 10)).alias("promoted"))


@query("prefix_fixture_kind", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'explicit' WHEN starts_with(p_brand, 'Brand#1') THEN 'fixture' END AS kind FROM part")
def prefix_fixture_kind(t):
    return t.part.select("p_partkey", F.coalesce(F.when(F.col("p_size") == 1, "explicit"), F.when(F.startswith("p_brand", F.lit("Brand#1")), "fixture")).alias("kind"))


@query("null_safe_not_equal", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, -1) <> 0")
def null_safe_not_equal(t):
    return t.documents.join(t.labels, "doc_id", "left").where(F.coalesce("quality", F.lit(-1)) != 0).select("doc_id")


@query("quarantine_reasons", "SELECT event_id, concat_ws('; ', CASE WHEN value < 5 THEN 'low value' END, CASE WHEN event_type = 'error' THEN 'error' END) AS reasons FROM events WHERE value < 5 OR event_type = 'error'")
def quarantine_reasons(t):
    cases = [(F.col("value") < 5, "low value"), (F.col("event_type") == "error", "error")]
    return t.events.where(cases[0][0] | cases[1][0]).select("event_id", all_reasons(cases).alias("reasons"))


@query("first_refusal_code", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'E_RUNNING' WHEN o_totalprice < 2000 THEN 'E_SMALL' WHEN o_orderpriority LIKE '5%' THEN 'E_LOW' END AS code FROM orders")
def first_refusal_code(t):
    return t.orders.select("o_orderkey", first_reason([(F.col("o_orderstatus") == "P", "E_RUNNING"), (F.col("o_totalprice") < 2000, "E_SMALL"), (F.startswith("o_orderpriority", F.lit("5")), "E_LOW")]).alias("code"))


@query("facet_text_filter", "SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND contains(lower(p_name), '1')")
def facet_text_filter(t):
    facet = t.part.agg(F.min("p_type").alias("p_type"))
    return t.part.join(F.broadcast(facet), "p_type", "left_semi").where(F.contains(F.lower("p_name"), F.lit("1"))).select("p_partkey")  # one row


@query("array_exists_filter", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity = 50)")
def array_exists_filter(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") == 50).alias("has")).where("has").select("l_orderkey")


@query("clean_predicate", "SELECT l_orderkey, avg(l_quantity) >= 25 AND (min(l_discount) IS NULL OR min(l_discount) >= 0.02) AS clean FROM lineitem GROUP BY 1")
def clean_predicate(t):
    least = F.min("l_discount")
    return t.lineitem.groupBy("l_orderkey").agg(((F.avg("l_quantity") >= 25) & (least.isNull() | (least >= 0.02))).alias("clean"))


_SECRETS = (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"[A-Za-z0-9_-]{24,}", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+")


@query("secret_scan", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::INTEGER AS n{i}" for i, p in enumerate(_SECRETS)) + " FROM documents")
def secret_scan(t):
    # A text without a pattern's fixed part isn't searched; a run that must be long is tried from its start only.
    fixed = ("AKIA", "_", "", "@")
    faster = (_SECRETS[0], _SECRETS[1], r"(?<![A-Za-z0-9_-])" + _SECRETS[2], _SECRETS[3].replace("+@", "++@"))
    count = lambda p, part: F.when(F.contains("text", F.lit(part)), F.regexp_count("text", F.lit(p))).when(F.col("text").isNotNull(), 0)
    return t.documents.select("doc_id", *(count(p, part).alias(f"n{i}") for i, (p, part) in enumerate(zip(faster, fixed, strict=True))))


@query("redact_tokens", f"SELECT doc_id, md5(regexp_replace(text, '{_SECRETS[3]}', '[mail]', 'g')) AS redacted FROM documents")
def redact_tokens(t):
    return t.documents.select("doc_id", F.md5(F.regexp_replace("text", _SECRETS[3], "[mail]").cast("binary")).alias("redacted"))


@query("rename_project", "SELECT c_custkey AS \"customerKey\", c_name AS \"customerName\", c_mktsegment AS \"marketSegment\" FROM customer")
def rename_project(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment").withColumnsRenamed({"c_custkey": "customerKey", "c_name": "customerName", "c_mktsegment": "marketSegment"})


@query("status_map_project", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'scheduled' ELSE 'live' END AS lifecycle FROM orders")
def status_map_project(t):
    names = F.create_map(*map(F.lit, ("F", "finished", "O", "scheduled", "P", "live")))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("live")).alias("lifecycle"))


@query("row_hash_audit", "SELECT c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS hash FROM customer")
def row_hash_audit(t):
    return t.customer.select("c_custkey", F.sha2(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").cast("binary"), 256).alias("hash"))


@query("json_default_fill", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_default_fill(t):
    p = F.from_json("props", "k BIGINT, missing STRING")
    return t.events.select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("missing"))


@query("interval_dim_normalise", "SELECT n_nationkey, lower(n_name) AS region, coalesce(nullif(n_regionkey, 0), n_nationkey)::INTEGER AS ends FROM nation WHERE n_name IS NOT NULL")
def interval_dim_normalise(t):
    return t.nation.where("n_name is not null").select("n_nationkey", F.lower("n_name").alias("region"), F.coalesce(F.nullif("n_regionkey", F.lit(0)), F.col("n_nationkey")).alias("ends"))


@query("status_precedence_case", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'review' ELSE 'unlabelled' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def status_precedence_case(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "review").otherwise("unlabelled").alias("status"))


@query("union_targets", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, NULL::DOUBLE AS price FROM customer UNION ALL SELECT 'part', p_partkey, p_name, p_retailprice FROM part")
def union_targets(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@query("winner_side_case", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' END AS side FROM lineitem")
def winner_side_case(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "b").alias("side"))


@query("provenance_struct", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'unknown' ELSE 'label' END AS source, quality AS value, CASE WHEN quality IS NULL THEN 'no label' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_struct(t):
    none = F.col("quality").isNull()
    field = F.struct(F.col("quality").alias("value"), F.when(none, "unknown").otherwise("label").alias("source"), F.when(none, "no label").alias("reason"))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", field.alias("f")).select("doc_id", "f.source", "f.value", "f.reason")


@query("unified_lifecycle", """SELECT 'order' AS kind, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS steps FROM orders UNION ALL SELECT 'document', doc_id, CASE WHEN quality IS NULL THEN 1 ELSE 2 END FROM documents LEFT JOIN labels USING (doc_id)""")
def unified_lifecycle(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("steps"))
    b = t.documents.join(t.labels, "doc_id", "left").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.when(F.col("quality").isNull(), 1).otherwise(2).alias("steps"))
    return a.unionByName(b)


@query("explode_slots", "SELECT vec_id, i::INTEGER - 1 AS slot, round(x::DOUBLE, 6) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def explode_slots(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("slot", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("confidence_band", "SELECT event_id, CASE WHEN value >= 90 THEN 'high' WHEN value >= 75 THEN 'medium' ELSE 'low' END AS band FROM events")
def confidence_band(t):
    return t.events.select("event_id", band(F.col("value"), 90, 75).alias("band"))


_CHECKS = [
    ("lineitem_duplicates", "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", "WARN", lambda t: t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
    ("orphan_lines", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)", "ERROR", lambda t: t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")),
    ("empty_orders", "SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "WARN", lambda t: t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")),
    ("bad_discount", "SELECT count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1", "ERROR", lambda t: t.lineitem.where("l_discount not between 0 and 1")),
    ("unknown_status", "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')", "ERROR", lambda t: t.orders.where("o_orderstatus not in ('F', 'O', 'P')")),
]


@query("dq_report", " UNION ALL ".join(f"SELECT '{n}' AS name, n::BIGINT AS n, CASE WHEN n = 0 THEN 'OK' ELSE '{s}' END AS severity FROM ({q}) x(n)" for n, q, s, _ in _CHECKS))
def dq_report(t):
    """DQ-01: one row per check, whatever its outcome."""
    out = None
    for name, _, severity, bad in _CHECKS:
        one = bad(t).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.when(F.col("n") == 0, "OK").otherwise(severity).alias("severity"))
        out = one if out is None else out.unionByName(one)
    return out


_LINES = """l AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_tax = 0) AS untaxed, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) AS no_part,
    count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS no_supplier, count(*) FILTER (l_linestatus = 'O') AS open, max(l_extendedprice) AS top, arg_min(l_quantity, (l_shipdate, l_linenumber, l_quantity)) AS first_quantity FROM lineitem GROUP BY 1),
  r AS (SELECT k, count(*) AS repeated FROM (SELECT l_orderkey AS k, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
  o AS (SELECT * FROM orders FULL JOIN l ON o_orderkey = l.k LEFT JOIN r ON l.k = r.k)"""
# Twelve checks, each a name, a severity and its number over the orders with their lines (o) or a dimension.
_TWELVE = [
    ("orders_without_lines", "WARN", "SELECT count(*) FROM o WHERE n IS NULL"),
    ("returned_untaxed", "WARN", "SELECT sum(untaxed) FROM o"),
    ("repeated_line_numbers", "WARN", "SELECT sum(repeated) FROM o"),
    ("open_order_no_open_line", "WARN", "SELECT count(*) FROM o WHERE o_orderstatus = 'O' AND coalesce(open, 0) = 0"),
    ("unknown_part", "ERROR", "SELECT sum(no_part) FROM o"),
    ("line_bad_reference", "ERROR", "SELECT sum(no_supplier + CASE WHEN o_orderkey IS NULL THEN n ELSE 0 END) FROM o"),
    ("order_unknown_customer", "ERROR", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    ("total_below_a_line", "WARN", "SELECT count(*) FROM o WHERE o_totalprice < top"),
    ("customer_unknown_nation", "ERROR", "SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
    ("supplier_unknown_nation", "WARN", "SELECT count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
    ("nation_unknown_region", "WARN", "SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)"),
    ("opening_line_below_five", "WARN", "SELECT count(*) FROM o WHERE first_quantity < 5"),
]
_TWELVE_SQL = f"WITH {_LINES}, q AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, coalesce(({q}), 0)::BIGINT AS n, '{s}' AS bad" for n, s, q in _TWELVE) + "), f AS (SELECT name, n, CASE WHEN n = 0 THEN 'OK' ELSE bad END AS severity FROM q)"


def _twelve(t):
    """The orders, each with what its lines come to (both sides are kept), and the dimensions: every fact is read once."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = quality.known(lines, "l_partkey", t.part, "p_partkey", "has_part")
    lines = quality.known(lines, "l_suppkey", t.supplier, "s_suppkey", "has_supplier")
    opening = F.min(F.struct("l_shipdate", "l_linenumber", "l_quantity"))
    # Dealt by order alone: both groupings hold without another shuffle.
    numbered = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0)).alias("untaxed"), F.count_if(~F.col("has_part")).alias("no_part"),
        F.count_if(~F.col("has_supplier")).alias("no_supplier"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.max("l_extendedprice").alias("top"), opening.alias("opening"),
    )
    per = numbered.groupBy("l_orderkey").agg(
        *(F.sum(c).alias(c) for c in ("n", "untaxed", "no_part", "no_supplier", "open")), F.count_if(F.col("n") > 1).alias("repeated"), F.max("top").alias("top"), F.min("opening").alias("opening"),
    )
    orders = quality.known(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_custkey", t.customer, "c_custkey", "has_customer")
    both = orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    there = F.col("o_orderkey").isNotNull()
    sums = {
        "orders_without_lines": F.count_if(F.col("n").isNull()),
        "returned_untaxed": F.sum("untaxed"),
        "repeated_line_numbers": F.sum("repeated"),
        "open_order_no_open_line": F.count_if((F.col("o_orderstatus") == "O") & (F.coalesce("open", F.lit(0)) == 0)),
        "unknown_part": F.sum("no_part"),
        "line_bad_reference": F.sum(F.col("no_supplier") + F.when(there, 0).otherwise(F.col("n"))),
        "order_unknown_customer": F.count_if(there & ~F.col("has_customer")),
        "total_below_a_line": F.count_if(F.col("o_totalprice") < F.col("top")),
        "opening_line_below_five": F.count_if(F.col("opening.l_quantity") < 5),
    }
    severity = {name: s for name, s, _ in _TWELVE}
    dims = [
        ("customer_unknown_nation", quality.known(t.customer, "c_nationkey", t.nation, "n_nationkey", "known")),
        ("supplier_unknown_nation", quality.known(t.supplier, "s_nationkey", t.nation, "n_nationkey", "known")),
        ("nation_unknown_region", quality.known(t.nation, "n_regionkey", t.region, "r_regionkey", "known")),
    ]
    parts = [(both, {name: (severity[name], bad) for name, bad in sums.items()})]
    return quality.report(parts + [(df, {name: (severity[name], F.count_if(~F.col("known")))}) for name, df in dims])


@query("dq_twelve", f"{_TWELVE_SQL} SELECT * FROM f")
def dq_twelve(t):
    """DQ-01: twelve checks of orders, lines and their references, facts and lines read once."""
    return _twelve(t)


@query("dq_verdict", f"""{_TWELVE_SQL}, v AS (SELECT count(*) FILTER (severity = 'OK') AS ok, count(*) FILTER (severity = 'WARN') AS warnings, count(*) FILTER (severity = 'ERROR') AS errors FROM f)
  SELECT ok, warnings, errors, CASE WHEN errors + warnings > 0 THEN 'FAIL' ELSE 'PASS' END AS result FROM v""")
def dq_verdict(t):
    """DQ-01: the outcome in strict mode, in which warnings fail too."""
    return quality.verdict(_twelve(t), strict=True)


@query("validate_rows_first_error", """SELECT l_orderkey, CASE WHEN count(*) < 2 THEN 'too-few' WHEN count(DISTINCT l_partkey) <> count(*) THEN 'repeated' WHEN bool_or(l_quantity > 49) THEN 'range' END AS error FROM lineitem GROUP BY 1""")
def validate_rows_first_error(t):
    c = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.max("l_quantity").alias("q"))
    return c.select("l_orderkey", first_reason([(F.col("n") < 2, "too-few"), (F.col("parts") != F.col("n"), "repeated"), (F.col("q") > 49, "range")]).alias("error"))


@query("audit_proposed_changes", "SELECT p_partkey, p_size AS current, CASE WHEN p_size > 45 THEN 45 ELSE p_size END AS proposed, CASE WHEN p_retailprice < 1000 THEN 'locked' END AS blocked FROM part WHERE p_size > 45")
def audit_proposed_changes(t):
    return t.part.where("p_size > 45").select("p_partkey", F.col("p_size").alias("current"), F.least("p_size", F.lit(45)).alias("proposed"), F.when(F.col("p_retailprice") < 1000, "locked").alias("blocked"))


@query("parse_warnings", "SELECT l_orderkey, count(*)::BIGINT AS lines, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_suppkey)")
def parse_warnings(t):
    c = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"))
    return c.where("lines != suppliers")


@query("grade_with_reasons", """SELECT c_nationkey, CASE WHEN avg(c_acctbal) < 3000 THEN 'fail' WHEN count(*) < 50 THEN 'warn' ELSE 'ok' END AS grade, concat_ws(',', CASE WHEN avg(c_acctbal) < 3000 THEN 'balance' END, CASE WHEN count(*) < 50 THEN 'few' END) AS reasons FROM customer GROUP BY 1""")
def grade_with_reasons(t):
    g = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n"))
    low, few = F.col("a") < 3000, F.col("n") < 50
    return g.select("c_nationkey", F.when(low, "fail").when(few, "warn").otherwise("ok").alias("grade"), all_reasons([(low, "balance"), (few, "few")], ",").alias("reasons"))


@query("schema_evolution_union", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def schema_evolution_union(t):
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return old.unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("registry_verification", """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'skipped' WHEN n IS NULL THEN 'not_found' WHEN n < 100 THEN 'error' ELSE 'verified' END AS verdict FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_suppkey = s_suppkey""")
def registry_verification(t):
    seen = t.lineitem.where("l_quantity > 40").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t.supplier.join(seen, "s_suppkey", "left").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "skipped").when(F.col("n").isNull(), "not_found").when(F.col("n") < 100, "error").otherwise("verified").alias("verdict"))
