"""Joins, aggregates, sorts and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators.joins import complete_dimension, reconcile, unpivot_sides
from tallyloom.operators.merge import keep_first
from tallyloom.plans.registry import query
from tallyloom.sources.tables import TABLES


@query("scan_all_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {n}" for n in TABLES))
def scan_all_tables(t):
    out = None
    for name in TABLES:
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("join_inner_equi", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def join_inner_equi(t):
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_name", "n_name")


@query("join_three_way", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def join_three_way(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("join_distinct", "SELECT DISTINCT p_brand, o_orderstatus FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey")
def join_distinct(t):
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("p_brand", "o_orderstatus").distinct()


@query("join_left_outer", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 48")
def join_left_outer(t):
    return t.orders.join(t.lineitem.where("l_quantity > 48"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_partkey")


@query("join_left_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_left_anti(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("join_left_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_left_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_full_outer", """SELECT coalesce(c.k, s.k) AS nationkey, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c
  FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k""")
def join_full_outer(t):
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "full_outer")


@query("ref_integrity_violations", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)")
def ref_integrity_violations(t):
    return t.lineitem.where("l_partkey is not null").join(t.part.where("p_size > 1"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("l_orderkey", "l_partkey")


@query("dim_lookup_default", "SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s_name, l_suppkey::VARCHAR) AS name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def dim_lookup_default(t):
    return t.lineitem.join(t.supplier.where("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce("s_name", F.col("l_suppkey").cast("string")).alias("name"))


@query("or_join_unpivot", """SELECT DISTINCT e.event_id, c.c_custkey FROM events e JOIN customer c ON (e.user_id = c.c_custkey OR e.event_id % 150 = c.c_custkey)""")
def or_join_unpivot(t):
    sides = unpivot_sides(t.events.withColumn("other", F.col("event_id") % 150), ["user_id", "other"], "c_custkey", ["event_id"]).distinct()
    return sides.join(t.customer, "c_custkey").select("event_id", "c_custkey")


@query("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS part_a, b.l_partkey AS part_b FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber, l_returnflag) WHERE a.l_partkey < b.l_partkey")
def join_multi_key(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("part_a"))
    return a.join(a.withColumnRenamed("part_a", "part_b"), ["l_orderkey", "l_linenumber", "l_returnflag"]).where("part_a < part_b").drop("l_returnflag")


@query("complete_missing_dim", """SELECT p_partkey, p_size FROM part WHERE p_size <= 25 UNION ALL SELECT DISTINCT l_partkey, 99 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def complete_missing_dim(t):
    dim = t.part.where("p_size <= 25").select("p_partkey", "p_size")
    return complete_dimension(dim, t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", {"p_size": F.lit(99)})


@query("reconcile_warnings", """SELECT k AS nationkey, unnest(list_filter([CASE WHEN c IS NULL THEN 'only_suppliers' END, CASE WHEN s IS NULL THEN 'only_customers' END, CASE WHEN c > 20 * s THEN 'few_suppliers' END], lambda x: x IS NOT NULL)) AS code
  FROM (SELECT coalesce(a.k, b.k) AS k, c, s FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_acctbal > 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k)""")
def reconcile_warnings(t):
    a = t.customer.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("c"))
    b = t.supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("s"))
    return reconcile(a, b, ["nationkey"], [(F.col("a.c").isNull(), "only_suppliers"), (F.col("b.s").isNull(), "only_customers"), (F.col("a.c") > 20 * F.col("b.s"), "few_suppliers")])


@query("tri_state_agreement", "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL ELSE (d.n_chars > 500) = (l.quality = 1) END AS agrees FROM documents d LEFT JOIN labels l USING (doc_id)")
def tri_state_agreement(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", ((F.col("n_chars") > 500) == (F.col("quality") == 1)).alias("agrees"))


@query("url_id_antijoin", r"SELECT page_id FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) NOT IN (SELECT doc_id::VARCHAR FROM documents)")
def url_id_antijoin(t):
    ids = t.documents.select(F.col("doc_id").cast("string").alias("id"))
    return t.pages.withColumn("id", F.regexp_extract("url", "/([0-9]+)", 1)).join(ids, "id", "left_anti").select("page_id")


@query("reachable_vs_unseen", """SELECT p_partkey, l_orderkey AS best, l_quantity AS seen, CASE WHEN l_orderkey IS NULL THEN 'never' ELSE 'reachable' END AS state FROM part LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem WHERE l_quantity > 40) WHERE n = 1) ON l_partkey = p_partkey""")
def reachable_vs_unseen(t):
    best = keep_first(t.lineitem.where("l_quantity > 40"), ["l_partkey"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey"])
    rows = t.part.join(best, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select("p_partkey", F.col("l_orderkey").alias("best"), F.col("l_quantity").alias("seen"), F.when(F.col("l_orderkey").isNull(), "never").otherwise("reachable").alias("state"))


@query("having_duplicates", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def having_duplicates(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("min_by_companion", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def min_by_companion(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("counts_by_state", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def counts_by_state(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("count_distinct_by_group", "SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1")
def count_distinct_by_group(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))


@query("sum_by_group", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL")
def sum_by_group(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))


@query("max_scalar", "SELECT max(o_orderkey) AS top FROM orders")
def max_scalar(t):
    return t.orders.agg(F.max("o_orderkey").alias("top"))


@query("event_rollup", """SELECT user_id, count(*)::BIGINT AS n, (count(*) FILTER (value > 50))::BIGINT AS high, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id""")
def event_rollup(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("state_histogram_pivot", """SELECT month(o_orderdate)::INTEGER AS month, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS F, (count(*) FILTER (o_orderstatus = 'O'))::BIGINT AS O, (count(*) FILTER (o_orderstatus = 'P'))::BIGINT AS P, 0::BIGINT AS X FROM orders GROUP BY 1""")
def state_histogram_pivot(t):
    return t.orders.groupBy(F.month("o_orderdate").alias("month")).pivot("o_orderstatus", ["F", "O", "P", "X"]).count().na.fill(0)


@query("health_rates_median", """WITH f AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS whole, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT count(*)::BIGINT AS frames, (count(*) FILTER (whole))::BIGINT AS whole, round((count(*) FILTER (whole)) / count(*), 4) AS whole_rate, (SELECT median(l_quantity) FROM lineitem) AS median_quantity FROM f""")
def health_rates_median(t):
    frames = t.lineitem.groupBy("l_orderkey").agg(F.every(F.col("l_linestatus") == "F").alias("whole"))
    counts = frames.agg(F.count("*").alias("frames"), F.count_if("whole").alias("whole")).withColumn("whole_rate", F.round(F.col("whole") / F.col("frames"), 4))
    return counts.join(F.broadcast(t.lineitem.agg(F.median("l_quantity").alias("median_quantity"))))  # one row


@query("median_filter_clause", "SELECT l_returnflag, median(l_quantity) FILTER (l_linestatus = 'F') AS median_f, median(l_quantity) FILTER (l_linestatus = 'O') AS median_o FROM lineitem GROUP BY 1")
def median_filter_clause(t):
    return t.lineitem.groupBy("l_returnflag").agg(*(F.median(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))).alias(f"median_{s.lower()}") for s in "FO"))


@query("coverage_funnel", """SELECT count(*)::BIGINT AS discovered, count(l.k)::BIGINT AS located, count(f.k)::BIGINT AS processed FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o_orderkey
  LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') f ON f.k = o_orderkey""")
def coverage_funnel(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_linestatus") == "F").cast("int")).alias("done"))
    return t.orders.join(per, "o_orderkey", "left").agg(F.count("*").alias("discovered"), F.count("done").alias("located"), F.count_if(F.col("done") == 1).alias("processed"))


_LABEL = """SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'none' WHEN bool_or(l_quantity >= 45) THEN 'high' WHEN bool_or(l_quantity >= 20) THEN 'medium' ELSE 'low' END AS label
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""


@query("coverage_label_precedence", f"SELECT label, count(*)::BIGINT AS n FROM ({_LABEL}) GROUP BY 1")
def coverage_label_precedence(t):
    top = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q"))
    label = F.when(F.col("q").isNull(), "none").when(F.col("q") >= 45, "high").when(F.col("q") >= 20, "medium").otherwise("low")
    return t.orders.join(top, "o_orderkey", "left").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("ledger_state_set", """SELECT c_custkey, array_to_string(list_filter([CASE WHEN bool_or(o_orderstatus = 'F') THEN 'done' END, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'open' END, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'partial' END], lambda x: x IS NOT NULL), ',') AS states
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def ledger_state_set(t):
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    states = F.array_compact(F.array(*(F.when(F.bool_or(F.col("o_orderstatus") == s), F.lit(n)) for s, n in (("F", "done"), ("O", "open"), ("P", "partial")))))
    return rows.groupBy("c_custkey").agg(F.array_join(states, ",").alias("states"))


@query("exclusion_reason", """SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_linestatus <> 'F' THEN 'not-reviewed' WHEN l_quantity < 2 THEN 'source' WHEN l_discount >= 0.09 THEN 'override' ELSE 'exported' END AS reason FROM lineitem) GROUP BY 1""")
def exclusion_reason(t):
    reason = F.when(F.col("l_linestatus") != "F", "not-reviewed").when(F.col("l_quantity") < 2, "source").when(F.col("l_discount") >= 0.09, "override").otherwise("exported")
    return t.lineitem.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("consensus_vote", """WITH v AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s DESC, event_type) AS k FROM v)
  SELECT user_id, event_type AS candidate, n::BIGINT AS votes, CASE WHEN n >= 20 THEN event_type END AS winner FROM r WHERE k = 1""")
def consensus_vote(t):
    votes = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("votes"), F.round(F.sum("value"), 4).alias("s"))
    top = keep_first(votes, ["user_id"], [F.desc("votes"), F.desc("s"), "event_type"])
    return top.select("user_id", F.col("event_type").alias("candidate"), "votes", F.when(F.col("votes") >= 20, F.col("event_type")).alias("winner"))


@query("vote_dedup", """SELECT l_orderkey, l_returnflag, count(*)::BIGINT AS votes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_quantity DESC, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1 GROUP BY ALL""")
def vote_dedup(t):
    return keep_first(t.lineitem, ["l_orderkey", "l_linenumber", "l_returnflag"], [F.desc("l_quantity"), "l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("votes"))


@query("invalidate_duplicates", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 THEN NULL ELSE l_partkey END AS winner FROM lineitem")
def invalidate_duplicates(t):
    n = F.count("*").over(Window.partitionBy("l_orderkey", "l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.when(n == 1, F.col("l_partkey")).alias("winner"))


@query("segment_consensus", """WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM v)
  SELECT o_custkey, o_orderpriority AS label, n::BIGINT AS agreeing, total::BIGINT AS total, round(n / total, 4) AS agreement FROM r WHERE k = 1""")
def segment_consensus(t):
    votes = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("agreeing"))
    votes = votes.withColumn("total", F.sum("agreeing").over(Window.partitionBy("o_custkey")))
    top = keep_first(votes, ["o_custkey"], [F.desc("agreeing"), "o_orderpriority"])
    return top.select("o_custkey", F.col("o_orderpriority").alias("label"), "agreeing", "total", F.round(F.col("agreeing") / F.col("total"), 4).alias("agreement"))


@query("validation_confusion", """SELECT lang, (count(*) FILTER (p AND quality = 1))::BIGINT AS tp, (count(*) FILTER (p AND quality = 0))::BIGINT AS fp, (count(*) FILTER (NOT p AND quality = 1))::BIGINT AS fn, (count(*) FILTER (NOT p AND quality = 0))::BIGINT AS tn
  FROM (SELECT lang, quality, n_chars > 300 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY lang""")
def validation_confusion(t):
    rows = t.labels.join(t.documents, "doc_id").select("lang", (F.col("quality") == 1).alias("y"), (F.col("n_chars") > 300).alias("p"))
    p, y = F.col("p"), F.col("y")
    return rows.groupBy("lang").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))


@query("readiness_ladder", """SELECT p_brand, CASE WHEN count(l_orderkey) = 0 THEN 'missing' WHEN max(l_quantity) < 30 THEN 'weak' WHEN count(DISTINCT l_returnflag) < 3 THEN 'partial' ELSE 'ready' END AS state, count(l_orderkey)::BIGINT AS samples
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_discount >= 0.05 GROUP BY p_brand""")
def readiness_ladder(t):
    rows = t.part.join(t.lineitem.where("l_discount >= 0.05"), F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_brand").agg(F.count("l_orderkey").alias("samples"), F.max("l_quantity").alias("q"), F.count_distinct("l_returnflag").alias("flags"))
    return rows.select("p_brand", F.when(F.col("samples") == 0, "missing").when(F.col("q") < 30, "weak").when(F.col("flags") < 3, "partial").otherwise("ready").alias("state"), "samples")


@query("avg_nonnull_round", "SELECT c_custkey, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 7) AS mean FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def avg_nonnull_round(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))), 7).alias("mean"))


@query("best_of_inference", """SELECT o_custkey, a::BIGINT AS a, b::BIGINT AS b, CASE WHEN a > b THEN 'a' WHEN b > a THEN 'b' END AS winner, list_filter([1, 3, 5, 7], lambda n: n >= 2 * greatest(a, b) - 1)[1]::INTEGER AS best_of
  FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1)""")
def best_of_inference(t):
    c = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    need = 2 * F.greatest("a", "b") - 1
    return c.select("o_custkey", "a", "b", F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b").alias("winner"), F.get(F.filter(F.array(*map(F.lit, (1, 3, 5, 7))), lambda n: n >= need), F.lit(0)).alias("best_of"))


@query("bool_or_bool_and_status", """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'live' WHEN bool_or(o_orderstatus = 'F') AND bool_and(o_orderstatus <> 'P') THEN 'completed' ELSE 'upcoming' END AS status FROM orders GROUP BY 1""")
def bool_or_bool_and_status(t):
    s = F.col("o_orderstatus")
    status = F.when(F.bool_or(s == "P"), "live").when(F.bool_or(s == "F") & F.bool_and(s != "P"), "completed").otherwise("upcoming")
    return t.orders.groupBy("o_custkey").agg(status.alias("status"))


_ORDERED = """SELECT l_orderkey, list(p_brand ORDER BY f) AS played FROM (SELECT l_orderkey, p_brand, min((l_linenumber, l_partkey)) AS f FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY 1"""


def _ordered(t):
    first = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey", "p_brand").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("f"))
    return first.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "p_brand"))), lambda s: s["p_brand"]).alias("played"))


@query("ordered_distinct_union", f"SELECT l_orderkey, array_to_string(played, ',') AS played FROM ({_ORDERED})")
def ordered_distinct_union(t):
    return _ordered(t).withColumn("played", F.array_join("played", ","))


@query("array_except_swaps", f"SELECT l_orderkey, array_to_string(played[3:], ',') AS swaps FROM ({_ORDERED}) WHERE len(played) > 2")
def array_except_swaps(t):
    return _ordered(t).where(F.size("played") > 2).select("l_orderkey", F.array_join(F.array_except("played", F.slice("played", 1, 2)), ",").alias("swaps"))


@query("daily_quota", "SELECT ts::DATE::VARCHAR AS day, event_type, count(*)::BIGINT AS used FROM events GROUP BY ALL")
def daily_quota(t):
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("used"))


@query("share_of_total", "SELECT c_mktsegment, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM customer GROUP BY 1")
def share_of_total(t):
    c = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


@query("ratio_to_max", "SELECT p_brand, count(*)::BIGINT AS n, round(count(*) / max(count(*)) OVER (), 4) AS ratio FROM part GROUP BY 1")
def ratio_to_max(t):
    c = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return c.withColumn("ratio", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))), 4))


@query("groups_by_size", "SELECT c_nationkey, count(*)::BIGINT AS n, max(c_custkey) AS newest FROM customer GROUP BY 1")
def groups_by_size(t):
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_custkey").alias("newest")).orderBy(F.desc("n"), "c_nationkey")


@query("usage_by_group", "SELECT source, sum(n_chars)::BIGINT AS chars, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def usage_by_group(t):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))


@query("topn_examples_per_group", """SELECT user_id, count(*)::BIGINT AS n, array_to_string(list_sort(list(event_id))[1:12], ',') AS examples FROM events WHERE value < 20 GROUP BY 1""")
def topn_examples_per_group(t):
    low = t.events.where("value < 20").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    ids = F.array_sort(F.collect_list(F.when(F.col("k") <= 12, F.col("event_id"))))
    return low.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("examples"))


@query("multi_count_distinct", "SELECT count(DISTINCT l_orderkey)::BIGINT AS orders, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem")
def multi_count_distinct(t):
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("approx_distinct")  # rows only: a sketch's estimate depends on the engine
def approx_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


@query("order_by_coalesce", "SELECT p_partkey, coalesce(nullif(p_size, 1), 999)::INTEGER AS rank FROM part")
def order_by_coalesce(t):
    return t.part.select("p_partkey", F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(999)).alias("rank")).orderBy("rank", "p_partkey")


@query("sort_nulls_last", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::VARCHAR END AS at FROM orders")
def sort_nulls_last(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("string")).alias("at")).orderBy(F.desc_nulls_last("at"), "o_orderkey")


@query("custom_rank_sort", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank FROM orders")
def custom_rank_sort(t):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.withColumn("rank", rank).orderBy("rank", F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "rank")


@query("topk_recent", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_recent(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("topk_per_group", "SELECT p_type, p_partkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def topk_per_group(t):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("p_type", "p_partkey", "rank")


@query("max_by_struct", "SELECT p_brand, arg_max(p_partkey, (p_size, p_retailprice, p_partkey)) AS best FROM part GROUP BY 1")
def max_by_struct(t):
    return t.part.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", "p_retailprice", "p_partkey")).alias("best"))


@query("claim_next", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def claim_next(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("union_all_sources", "SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all_sources(t):
    return t.customer.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("kind")))


@query("distinct_ids", "SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_ids(t):
    return t.lineitem.select("l_suppkey").distinct()


@query("intersect_keys", "SELECT user_id AS id FROM events INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def intersect_keys(t):
    return t.events.select(F.col("user_id").alias("id")).intersect(t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id")))


@query("except_keys", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def except_keys(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("id")))


@query("array_subset", "SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS settled FROM orders GROUP BY 1")
def array_subset(t):
    return t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).select("o_custkey", F.forall("s", lambda x: x.isin("F", "O")).alias("settled"))


@query("dedup_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_keep_first(t):
    return keep_first(t.events, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("merge_key_signature", "SELECT l_orderkey, l_returnflag, l_orderkey || '|' || l_returnflag || '|' || p AS signature FROM (SELECT l_orderkey, l_returnflag, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS p FROM lineitem GROUP BY ALL)")
def merge_key_signature(t):
    parts = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(parts.alias("p")).select("l_orderkey", "l_returnflag", F.concat_ws("|", "l_orderkey", "l_returnflag", "p").alias("signature"))


@query("content_hash_dedup", "SELECT md5(text) AS hash, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def content_hash_dedup(t):
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("extra_rollup", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extra_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("extra_cube", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("extra_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def extra_grouping_sets(t):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[s], [p], []], s, p).agg(F.count("*").alias("n"))


@query("extra_rank_family", """SELECT p_partkey, rank() OVER w::INTEGER AS r, dense_rank() OVER w::INTEGER AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def extra_rank_family(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("extra_rows_range_frames", """SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING)::BIGINT AS rows3, (count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW))::BIGINT AS near FROM orders""")
def extra_rows_range_frames(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", F.sum("o_orderkey").over(w.rowsBetween(-2, 0)).alias("rows3"), F.count("*").over(w.rangeBetween(-100, 0)).alias("near"))


@query("extra_ntile_percent_rank", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey)::INTEGER AS quartile, round(percent_rank() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey), 6) AS pr FROM part")
def extra_ntile_percent_rank(t):
    w = Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")
    return t.part.select("p_partkey", F.ntile(4).over(w).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("extra_cross_join", "SELECT r_name, l_returnflag FROM region CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem)")
def extra_cross_join(t):
    return t.region.select("r_name").join(t.lineitem.select("l_returnflag").distinct())


@query("extra_percentile", "SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1")
def extra_percentile(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.9).alias("p90"))
