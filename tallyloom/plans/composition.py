"""Approved snapshots, appearances, composition statistics and the records that follow from them.

Stand-ins on the driver tables: an order is a played map (undecided with status P), a return flag within it a team, a
brand a hero, a line a snapshot row that is approved with line status F and quantity 2 or more, and overridden by a row of
the same order and line number with a discount of 0.09 or more. The winner is the flag of the order's highest price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalar import rate
from tallyloom.plans.registry import query
from tallyloom.sources.tables import Tables

#: Heroes of a full composition.
FULL = 2
#: Shares by map of what one task reads of the lines: a share is sorted several times, so its memory must not grow with the table.
SHARES = 8

_APPROVED = "l_linestatus = 'F' AND l_quantity >= 2"
_GATE = f"""gate AS (SELECT * FROM lineitem l WHERE {_APPROVED} AND (l_discount >= 0.09 OR NOT EXISTS (
  SELECT 1 FROM lineitem o WHERE o.l_discount >= 0.09 AND o.l_orderkey = l.l_orderkey AND o.l_linenumber = l.l_linenumber)))"""
_WINNERS = """winners AS (SELECT l_orderkey, arg_max(l_returnflag, (l_extendedprice, l_partkey, l_suppkey, l_linenumber)) AS winner
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY l_orderkey)"""
_APPEARANCES = f"""{_GATE}, {_WINNERS}, appearances AS (
  SELECT l_orderkey, l_returnflag, list_sort(list_distinct(list(p_brand))) AS heroes,
         any_value(CASE WHEN winner IS NULL THEN NULL WHEN winner = l_returnflag THEN 'win' ELSE 'loss' END) AS result
  FROM gate JOIN part ON p_partkey = l_partkey LEFT JOIN winners USING (l_orderkey) GROUP BY l_orderkey, l_returnflag)"""


def gated(t: Tables) -> DataFrame:
    """FLT-01: approved rows that no override hides; an override itself stays."""
    overrides = t.lineitem.where("l_discount >= 0.09").select("l_orderkey", "l_linenumber").distinct()
    approved = t.lineitem.where(_APPROVED)
    plain = approved.where("l_discount < 0.09").join(overrides, ["l_orderkey", "l_linenumber"], "left_anti")
    return approved.where("l_discount >= 0.09").select(plain.columns).unionByName(plain)


def winners(t: Tables) -> DataFrame:
    """The winning team of every decided map."""
    decided = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    best = F.max_by("l_returnflag", F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"))
    return t.lineitem.join(decided, "l_orderkey").groupBy("l_orderkey").agg(best.alias("winner"))


def appearances(t: Tables) -> DataFrame:
    """AGG-01/JOIN-07: one row per map and team with its heroes and the result: win, loss or, undecided, null.

    One exchange of the lines by map serves the override flag, the winner and, but for the join of the heroes' names, the
    collapse; the winner travels with the rows instead of being joined back. It has SHARES partitions for each of the scan.
    """
    decided = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "P").alias("decided"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    lines = lines.repartition(SHARES * lines.rdd.getNumPartitions(), "l_orderkey").join(decided, "l_orderkey", "left")
    best = F.max(F.when(F.col("decided"), F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"))).over(Window.partitionBy("l_orderkey"))
    manual = F.max(F.col("l_discount") >= 0.09).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    rows = lines.withColumns({"winner": best["l_returnflag"], "manual": manual}).where(_APPROVED).where("l_discount >= 0.09 OR NOT coalesce(manual, false)")
    named = rows.select("l_orderkey", "l_returnflag", "l_partkey", "winner").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    teams = named.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set("p_brand")).alias("heroes"), F.max("winner").alias("winner"))
    result = F.when(F.col("winner").isNull(), None).when(F.col("winner") == F.col("l_returnflag"), "win").otherwise("loss")
    return teams.withColumn("result", result).drop("winner")


@query("approved_gate", f"WITH {_GATE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM gate")
def approved_gate(t):
    return gated(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")


@query("appearances", f"WITH {_APPEARANCES} SELECT l_orderkey, l_returnflag, array_to_string(heroes, '+') AS heroes, result FROM appearances")
def appearance_rows(t):
    return appearances(t).withColumn("heroes", F.array_join("heroes", "+"))


@query("comp_frequency", f"""WITH {_APPEARANCES} SELECT array_to_string(heroes, '+') AS comp, count(*)::BIGINT AS appearances, any_value(total)::BIGINT AS total
  FROM (SELECT *, count(*) OVER () AS total FROM appearances) WHERE len(heroes) = {FULL} GROUP BY 1""")
def comp_frequency(t):
    a = appearances(t)
    full = a.where(F.size("heroes") == FULL).groupBy(F.array_join("heroes", "+").alias("comp")).agg(F.count("*").alias("appearances"))
    return full.join(F.broadcast(a.agg(F.count("*").alias("total"))))  # one row


@query("comp_win_rate", f"""WITH {_APPEARANCES} SELECT array_to_string(heroes, '+') AS comp, count(*)::BIGINT AS appearances,
  (count(*) FILTER (result = 'win'))::BIGINT AS wins, (count(*) FILTER (result = 'loss'))::BIGINT AS losses, count(result)::BIGINT AS decided,
  round((count(*) FILTER (result = 'win')) / nullif(count(result), 0), 5) AS win_rate
  FROM appearances WHERE len(heroes) = {FULL} GROUP BY 1""")
def comp_win_rate(t):
    full = appearances(t).where(F.size("heroes") == FULL)
    counts = full.groupBy(F.array_join("heroes", "+").alias("comp")).agg(F.count("*").alias("appearances"), F.count_if(F.col("result") == "win").alias("wins"), F.count_if(F.col("result") == "loss").alias("losses"), F.count("result").alias("decided"))
    return counts.withColumn("win_rate", rate(F.col("wins"), F.col("decided"))).orderBy(F.desc("appearances"), "comp")


@query("hero_pick_rates", f"""WITH {_APPEARANCES}, picks AS (SELECT hero, count(*) AS picks, count(*) FILTER (result = 'win') AS wins, count(result) AS decided
    FROM (SELECT unnest(heroes) AS hero, result FROM appearances) GROUP BY hero),
  swaps AS (SELECT hero, count(*) AS swaps FROM (SELECT DISTINCT l_orderkey, l_linenumber, p_brand AS hero FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.09) GROUP BY hero)
  SELECT hero, coalesce(picks, 0)::BIGINT AS picks, coalesce(swaps, 0)::BIGINT AS swaps, round(wins / nullif(decided, 0), 5) AS win_rate, round(swaps / nullif(picks, 0), 5) AS swap_rate
  FROM picks FULL JOIN swaps USING (hero)""")
def hero_pick_rates(t):
    picks = appearances(t).select(F.explode("heroes").alias("hero"), "result").groupBy("hero").agg(F.count("*").alias("picks"), F.count_if(F.col("result") == "win").alias("wins"), F.count("result").alias("decided"))
    swaps = t.lineitem.where("l_discount >= 0.09").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("hero")).distinct().groupBy("hero").agg(F.count("*").alias("swaps"))
    both = picks.join(swaps, "hero", "full_outer")
    return both.select("hero", F.coalesce("picks", F.lit(0)).alias("picks"), F.coalesce("swaps", F.lit(0)).alias("swaps"), rate(F.col("wins"), F.col("decided")).alias("win_rate"), rate(F.col("swaps"), F.col("picks")).alias("swap_rate"))


@query("team_hero_pools", f"""WITH {_APPEARANCES}, p AS (SELECT l_returnflag, hero, count(DISTINCT l_orderkey) AS maps FROM (SELECT l_returnflag, l_orderkey, unnest(heroes) AS hero FROM appearances) GROUP BY ALL)
  SELECT l_returnflag, count(*)::BIGINT AS heroes, string_agg(hero || ':' || maps, ',' ORDER BY maps DESC, hero) AS pool FROM p GROUP BY l_returnflag""")
def team_hero_pools(t):
    each = appearances(t).select("l_returnflag", "l_orderkey", F.explode("heroes").alias("hero")).groupBy("l_returnflag", "hero").agg(F.count_distinct("l_orderkey").alias("maps"))
    pool = F.sort_array(F.collect_list(F.struct((-F.col("maps")).alias("order"), "hero", "maps")))
    text = F.array_join(F.transform("pool", lambda p: F.concat(p["hero"], F.lit(":"), p["maps"].cast("string"))), ",")
    return each.groupBy("l_returnflag").agg(F.count("*").alias("heroes"), pool.alias("pool")).withColumn("pool", text)


@query("team_map_records", f"""WITH {_WINNERS} SELECT l_returnflag, month(o_orderdate)::INTEGER AS map, (count(*) FILTER (winner = l_returnflag))::BIGINT AS wins, (count(*) FILTER (winner <> l_returnflag))::BIGINT AS losses,
  (count(*) FILTER (winner IS NULL))::BIGINT AS undecided FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) JOIN orders ON o_orderkey = l_orderkey LEFT JOIN winners USING (l_orderkey) GROUP BY ALL""")
def team_map_records(t):
    sides = t.lineitem.select("l_orderkey", "l_returnflag").distinct()
    rows = sides.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.month("o_orderdate").alias("map")), "l_orderkey").join(winners(t), "l_orderkey", "left")
    return rows.groupBy("l_returnflag", "map").agg(F.count_if(F.col("winner") == F.col("l_returnflag")).alias("wins"), F.count_if(F.col("winner") != F.col("l_returnflag")).alias("losses"), F.count_if(F.col("winner").isNull()).alias("undecided"))


@query("map_stats_zero_fill", "SELECT p_partkey, p_type, count(l_orderkey)::BIGINT AS played FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY ALL")
def map_stats_zero_fill(t):
    played = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("played"))
    return t.part.select("p_partkey", "p_type").join(played, "p_partkey", "left").withColumn("played", F.coalesce("played", F.lit(0)))


@query("mode_stats_rollup", """WITH m AS (SELECT p_partkey, p_type, count(l_orderkey) AS played FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY ALL)
  SELECT p_type, sum(played)::BIGINT AS played, (count(*) FILTER (played = 0))::BIGINT AS never FROM m GROUP BY p_type""")
def mode_stats_rollup(t):
    return map_stats_zero_fill(t).groupBy("p_type").agg(F.sum("played").alias("played"), F.count_if(F.col("played") == 0).alias("never"))


@query("provisional_block", "SELECT l.l_orderkey, count(*)::BIGINT AS children FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_linestatus <> 'F') GROUP BY ALL")
def provisional_block(t):
    blocked = t.lineitem.where("l_linestatus <> 'F'").select("l_orderkey").distinct()
    return t.lineitem.join(blocked, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("children"))


@query("withheld_reasons", "SELECT l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS lines, count(*)::BIGINT AS n FROM lineitem WHERE l_linestatus <> 'F' GROUP BY ALL")
def withheld_reasons(t):
    bad = t.lineitem.where("l_linestatus <> 'F'")
    return bad.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("lines"), F.count("*").alias("n"))


@query("manual_supersedes", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM (SELECT *, max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM lineitem)
  WHERE m = 0 OR l_discount >= 0.09""")
def manual_supersedes(t):
    manual = F.max((F.col("l_discount") >= 0.09).cast("int")).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    return t.lineitem.withColumn("m", manual).where("m = 0 OR l_discount >= 0.09").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")


@query("conditional_counts_per_parent", """SELECT o_orderkey, count(l_orderkey)::BIGINT AS lines, (count(*) FILTER (l_linestatus = 'F'))::BIGINT AS confirmed, (count(*) FILTER (l_linestatus = 'O'))::BIGINT AS uncertain
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def conditional_counts(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_linestatus") == "F").alias("confirmed"), F.count_if(F.col("l_linestatus") == "O").alias("uncertain"))
    return t.orders.select("o_orderkey").join(per, "o_orderkey", "left").na.fill(0, ["lines", "confirmed", "uncertain"])


@query("score_vs_winners", f"""WITH {_WINNERS}, s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS stated, count(winner) AS won FROM orders LEFT JOIN winners ON l_orderkey = o_orderkey GROUP BY o_custkey)
  SELECT o_custkey, stated::BIGINT AS stated, won::BIGINT AS won FROM s WHERE stated <> won""")
def score_vs_winners(t):
    rows = t.orders.join(winners(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    return rows.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("stated"), F.count("winner").alias("won")).where("stated <> won")
