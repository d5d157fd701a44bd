"""Rounds, stints and phases: point-in-interval queries, ordinal assignment, ladders and small exhaustive fits."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import scalar as sc
from tallyloom.operators import sequence as seq
from tallyloom.operators import fit, roles, vectors
from tallyloom.operators.joins import asof_join, range_join
from tallyloom.plans.registry import query
from tallyloom.plans.temporal import _E, _events
from tallyloom.plans.texts import _CENTRES, _vectors
from tallyloom.sources.tables import scan_or_empty

#: A round of two hours starts at each multiple of six hours; the hour before it is its setup.
_ROUND, _PLAY, _SETUP, _EDGE = 21600, 7200, 3600, 600


@query("scan_or_empty", "SELECT 'missing' AS name, 0::BIGINT AS n UNION ALL SELECT 'region', count(*)::BIGINT FROM region")
def scan_or_empty_counts(t):
    out = None
    for name, file in (("missing", "no_such_table"), ("region", "region")):
        one = scan_or_empty(t.spark, f"{t.folder}/{file}.parquet", "r_regionkey int, r_name string").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _rounds(t):
    """One row per round between the first and the last event."""
    ends = _events(t).agg(F.floor(F.min("t") / _ROUND).alias("a"), F.floor(F.max("t") / _ROUND).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("round")).select("round", (F.col("round") * _ROUND).alias("start"), (F.col("round") * _ROUND + _PLAY).alias("stop"))


@query("phase_classify", f"""WITH {_E}, p AS (SELECT event_id, event_type, t % {_ROUND} AS o FROM e) SELECT event_id, CASE WHEN event_type = 'error' THEN 'replay' WHEN o <= {_EDGE} THEN 'post-start' WHEN o <= {_PLAY} AND o > {_PLAY - _EDGE} THEN 'post-round'
  WHEN o <= {_PLAY} THEN 'combat' WHEN o >= {_ROUND - _SETUP} THEN 'setup' ELSE 'out-of-round' END AS phase FROM p""")
def phase_classify(t):
    """FLT-10: within a round its edges don't count; between rounds only the setup has a name."""
    e = _events(t)
    rounds = _rounds(t)
    inside = range_join(e, rounds, "t", "start", "stop", _ROUND, how="left")
    phase = F.when(F.col("event_type") == "error", "replay").when(F.col("t") - F.col("start") <= _EDGE, "post-start").when(F.col("stop") - F.col("t") < _EDGE, "post-round").when(F.col("start").isNotNull(), "combat")
    return inside.select("event_id", F.coalesce(phase, F.when(F.col("t") % _ROUND >= _ROUND - _SETUP, "setup"), F.lit("out-of-round")).alias("phase"))


@query("grace_recheck", f"""WITH {_E}, n AS (SELECT event_id, event_type, t, t - t % {_ROUND} AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM e) SELECT event_id, t - start > 1800 OR coalesce(nx, t + 1800) - t >= 1800 AS stands FROM n WHERE t - start <= {_PLAY}""")
def grace_recheck(t):
    """FLT-11: what begins within the grace time after a round's start must still stand as long."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _events(t).withColumn("next", F.lead("t").over(w)).withColumn("one", F.lit(1))
    rounds = _rounds(t).withColumn("one", F.lit(1)).select("one", F.col("start").alias("begins"))
    # A round's number is a key that both sides have, so the as-of join isn't one partition.
    keyed = e.withColumn("round", F.floor(F.col("t") / _ROUND))
    rounds = rounds.withColumn("round", F.floor(F.col("begins") / _ROUND))
    found = asof_join(keyed, rounds, ["round"], "t", "begins", ["one"]).where(F.col("t") - F.col("found_begins") <= _PLAY)
    return found.select("event_id", ((F.col("t") - F.col("found_begins") > 1800) | (F.coalesce("next", F.col("t") + 1800) - F.col("t") >= 1800)).alias("stands"))


_STINTS = "st AS (SELECT user_id, event_type, t AS start, lead(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS stop FROM e)"


@query("comp_at_time", f"""WITH {_E}, {_STINTS}, d AS (SELECT 1704067200 + range * 86400 AS m FROM range(1, 29)), j AS (SELECT m, user_id, event_type, row_number() OVER (PARTITION BY m, user_id ORDER BY start DESC, event_type) AS k FROM d JOIN st ON start <= m + 15 AND (stop IS NULL OR stop >= m) AND start >= m - 86400)
  SELECT m::BIGINT AS moment, user_id, event_type FROM j WHERE k = 1""")
def comp_at_time(t):
    """JOIN-14: what stands at a time, begun at most a day before and at most 15 s after; the latest begun wins."""
    w = Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")
    stints = _events(t).select("user_id", "event_type", F.col("t").alias("start"), F.lead("t").over(w).alias("stop"))
    stints = stints.withColumns({"a": F.col("start") - 15, "b": F.least(F.coalesce("stop", F.col("start") + 86400), F.col("start") + 86400)})
    days = t.spark.range(1, 29).select((F.col("id") * 86400 + 1704067200).alias("moment"))
    at = range_join(days, stints, "moment", "a", "b", 86400).select("moment", "user_id", "event_type", "start")
    k = F.row_number().over(Window.partitionBy("moment", "user_id").orderBy(F.desc("start"), "event_type"))
    return at.withColumn("k", k).where("k = 1").select("moment", "user_id", "event_type")


@query("ordinal_block_assign", """WITH b AS (SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS blocks FROM orders), m AS (SELECT l.c_custkey, (l.c_nationkey % 12) + 1 AS maps FROM customer l)
  SELECT o_orderkey, CASE WHEN blocks = maps THEN n END::INTEGER AS map FROM b JOIN m ON c_custkey = o_custkey""")
def ordinal_block_assign(t):
    """WIN-05: blocks get ordinals only where there are as many as maps; else none does."""
    p = Window.partitionBy("o_custkey")
    blocks = t.orders.select("o_custkey", "o_orderkey", F.dense_rank().over(p.orderBy("o_orderdate", "o_orderkey")).alias("n"), F.count("*").over(p).alias("blocks"))
    maps = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 12 + 1).alias("maps"))
    return blocks.join(maps, "o_custkey").select("o_orderkey", F.when(F.col("blocks") == F.col("maps"), F.col("n")).alias("map"))


@query("first_increasing_run", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS k, l_quantity <= lag(l_quantity) OVER w AS down FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
  i AS (SELECT *, sum(coalesce(down, false)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM r) SELECT l_orderkey, count(*)::BIGINT AS length FROM i WHERE run = 0 GROUP BY 1""")
def first_increasing_run(t):
    """WIN-25: how long the quantities rise from the first line on."""
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    down = F.col("l_quantity") <= seq.previous("l_quantity", ["l_orderkey"], order)
    rows = seq.islands(t.lineitem.withColumn("down", down), ["l_orderkey"], order, F.col("down"), "run")
    return rows.where("run = 0").groupBy("l_orderkey").agg(F.count("*").alias("length"))


@query("absorb_short_runs", f"""WITH RECURSIVE {_E}, c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS ch FROM e),
  i AS (SELECT *, sum(ch::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c), o AS (SELECT user_id, run, min(event_type) AS v, min(t) AS first_at, count(*) AS n FROM i GROUP BY user_id, run),
  r AS (SELECT user_id, run, v AS value, first_at, n, 1 AS g FROM o WHERE run = 1
    UNION ALL SELECT o.user_id, o.run, CASE WHEN o.n < 3 OR o.v = r.value THEN r.value ELSE o.v END, o.first_at, o.n, g + (o.n >= 3 AND o.v <> r.value)::INTEGER FROM r JOIN o ON o.user_id = r.user_id AND o.run = r.run + 1)
  SELECT user_id, min(value) AS value, min(first_at) AS first_at, sum(n)::BIGINT AS length FROM r GROUP BY user_id, g""")
def absorb_short_runs(t):
    """WIN-07: runs of fewer than three reads join the run before them."""

    runs = seq.run_lengths(_events(t), ["user_id"], ["t", "event_id"], "event_type", "t")
    return seq.absorbed(runs, "user_id", "event_type", "first_at", "length", 3, "run")


@query("bisection_order", """WITH RECURSIVE s(depth, lo, hi) AS (SELECT 0, 0, 64 UNION ALL SELECT depth + 1, CASE WHEN o = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN o = 0 THEN (lo + hi) // 2 ELSE hi END FROM s, (SELECT unnest([0, 1]) AS o) WHERE hi - lo > 2)
  SELECT ((lo + hi) // 2)::INTEGER AS middle, depth::INTEGER AS depth FROM s""")
def bisection_order(t):
    """WIN-20: the middles of ever finer halves, the coarsest first."""
    return t.spark.sql("""WITH RECURSIVE s(depth, lo, hi) AS (SELECT 0, 0, 64 UNION ALL SELECT depth + 1, CASE WHEN o = 0 THEN lo ELSE cast((lo + hi) div 2 AS int) END, CASE WHEN o = 0 THEN cast((lo + hi) div 2 AS int) ELSE hi END
      FROM s CROSS JOIN (SELECT explode(array(0, 1)) AS o) WHERE hi - lo > 2) SELECT cast((lo + hi) div 2 AS int) AS middle, cast(depth AS int) AS depth FROM s""")


@query("candidate_fit_min_by", "WITH c AS (SELECT user_id, event_type, o AS lag_s, sum(abs(value - o)) AS cost FROM events, (SELECT unnest([10, 30, 50, 70]) AS o) GROUP BY ALL) SELECT user_id, event_type, arg_min(lag_s, (round(cost, 4), lag_s))::INTEGER AS fit FROM c GROUP BY ALL")
def candidate_fit_min_by(t):
    """SIM-08: of a stated ladder of candidates that of least cost, the smaller at a tie."""
    tried = t.events.withColumn("o", F.explode(F.array(*map(F.lit, (10, 30, 50, 70)))))
    cost = tried.groupBy("user_id", "event_type", "o").agg(F.round(F.sum(F.abs(F.col("value") - F.col("o"))), 4).alias("cost"))
    return cost.groupBy("user_id", "event_type").agg(F.min_by("o", F.struct("cost", "o")).alias("fit"))


@query("grid_fit", f"""WITH p AS (SELECT DISTINCT user_id, value AS x FROM events WHERE event_type = 'purchase' AND value BETWEEN 0 AND 150),
  t AS (SELECT a.user_id, a.x - m.m * ((b.x - a.x) / k.k) AS start, (b.x - a.x) / k.k AS pitch FROM p a JOIN p b ON a.user_id = b.user_id AND b.x > a.x, range(1, 5) k(k), range(5) m(m)),
  h AS (SELECT DISTINCT user_id, round(start, 6) AS start, round(pitch, 6) AS pitch FROM t WHERE pitch BETWEEN {fit.PITCH_LEAST * 12.0} AND {fit.PITCH_MOST * 12.0}),
  g AS (SELECT * FROM h WHERE start - 6.0 >= {0.0 - 12.0 * fit.BEYOND} AND start + 4 * pitch + 6.0 <= {150.0 + 12.0 * fit.BEYOND}),
  e AS (SELECT g.user_id, start, pitch, place, min(abs(x - (start + place * pitch))) AS off, any_value(pitch) * {fit.OFF} AS reach FROM g, range(5) r(place), p WHERE p.user_id = g.user_id GROUP BY ALL),
  f AS (SELECT user_id, start, pitch, count(*) AS support, round(sum(off), 6) AS residual FROM e WHERE off <= reach GROUP BY ALL HAVING count(*) >= 2)
  SELECT user_id, support, residual, start, pitch FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY support DESC, residual, start, pitch) = 1""")
def grid_fit(t):
    """SIM-08: the five-place grid that most of a user's purchases lie on, over all that two of them give."""
    return fit.grid_fit(t.events.where("event_type = 'purchase'"), "user_id", "value", 12.0, 0.0, 150.0)


@query("pearson_similarity", f"""WITH {_CENTRES}, z AS (SELECT vec_id, embedding::DOUBLE[] AS x, centre AS p, list_avg(embedding::DOUBLE[]) AS mx, list_avg(centre) AS mp FROM embeddings JOIN c USING (label))
  SELECT vec_id, round(list_cosine_similarity(list_transform(x, lambda v: v - mx), list_transform(p, lambda v: v - mp)), 5) AS r FROM z""")
def pearson_similarity(t):
    """SIM-01: the cosine of the vectors less their means, each with its label's mean vector."""
    v = _vectors(t)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    rows = v.join(vectors.centroids(v), "label").withColumns({"mx": mean("v"), "mp": mean("centre")})
    centred = lambda c, m: F.transform(c, lambda x: x - F.col(m))
    return rows.select(F.col("id").alias("vec_id"), F.round(sc.cosine(centred("v", "mx"), centred("centre", "mp")), 5).alias("r"))


_SIMS = "WITH s AS (SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS other_label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query("near_duplicate_pairs", f"{_SIMS} SELECT vec_id, other, sim FROM s WHERE label = other_label AND sim >= 0.35 AND vec_id < other")
def near_duplicate_pairs(t):
    """SIM-05: all pairs of vectors of one class that are too near to each other."""
    return vectors.similar_pairs(_vectors(t), 0.35).withColumnRenamed("id", "vec_id")


@query("confusable_pairs", f"{_SIMS} SELECT vec_id, arg_max(other, (sim, other)) AS other, max(sim) AS sim FROM s WHERE label <> other_label GROUP BY vec_id HAVING max(sim) >= 0.3")
def confusable_pairs(t):
    """SIM-05: vectors that are near to one of another class, with the nearest."""
    return vectors.nearest_of_other_classes(_vectors(t), 0.3).withColumnRenamed("id", "vec_id")


@query("role_assignment", """WITH c AS (SELECT user_id, event_type, round(sum(value), 3) AS s FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY ALL), x AS (SELECT a.user_id, round(a.s * 1 + b.s * 2 + d.s * 3, 3) AS total, a.event_type || ',' || b.event_type || ',' || d.event_type AS roles
  FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type <> b.event_type JOIN c d ON a.user_id = d.user_id AND d.event_type NOT IN (a.event_type, b.event_type)) SELECT user_id, arg_max(roles, (total, roles)) AS roles FROM x GROUP BY 1""")
def role_assignment(t):
    """ARR-02: of all orders of a user's three kinds that of the largest weighted sum; a stated, bounded number of orders."""
    kinds = ("click", "purchase", "view")
    sums = t.events.where(F.col("event_type").isin(*kinds)).groupBy("user_id").agg(*(F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 3).alias(k) for k in kinds)).dropna()
    options = F.array(*(F.struct(F.round(sum(F.col(k) * (i + 1) for i, k in enumerate(order)), 3).alias("total"), F.lit(",".join(order)).alias("roles")) for order in permutations(kinds)))
    return sums.select("user_id", F.array_max(options)["roles"].alias("roles"))


_ROLES = ("Tank",) * 2 + ("Damage",) * 5 + ("Support",) * 5
_SLOT_READS = f"""c AS (SELECT vec_id, i // 12 AS slot, 'h' || lpad((i % 12)::VARCHAR, 2, '0') AS value, [{", ".join(f"'{r}'" for r in _ROLES)}][i % 12 + 1] AS role,
    round(embedding[i + 1]::DOUBLE * 2 + 0.4, 6) AS score FROM embeddings, range(60) r(i) WHERE embedding[i + 1] IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, slot ORDER BY score DESC, value) AS n, score - lead(score) OVER (PARTITION BY vec_id, slot ORDER BY score DESC, value) AS margin FROM c),
  reads AS (SELECT vec_id, slot, CASE WHEN score >= 0.55 AND margin >= 0.03 THEN value END AS value, score FROM k WHERE n = 1)"""

# One slot after the other, with all choices that are still legal.
_STEPS = " ".join(
    f"""p{i + 1} AS (SELECT p.vec_id, v || [value] AS v, s || [score] AS s, r || [role] AS r, total + score AS total FROM p{i} p
    JOIN a ON p.vec_id = a.vec_id AND a.slot = {i} AND NOT list_contains(v, value)
    WHERE len(list_filter(r || [role], lambda x: x = role)) <= CASE role WHEN 'Tank' THEN 1 ELSE 2 END),"""
    for i in range(1, 5)
)


@query("role_line_ups", f"""WITH {_SLOT_READS},
  a AS (SELECT vec_id, slot, value, role, score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id, slot, role ORDER BY score DESC, value) <= 4),
  p1 AS (SELECT vec_id, [value] AS v, [score] AS s, [role] AS r, 0.0::DOUBLE + score AS total FROM a WHERE slot = 0),
  {_STEPS}
  best AS (SELECT * FROM p5 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(total, 9) DESC, v) = 1),
  o AS (SELECT b.vec_id, i AS slot, v[i + 1] AS pick, r[i + 1] AS role, s[i + 1] AS score, reads.value AS seen, reads.score AS seen_score FROM best b, range(5) t(i), reads WHERE reads.vec_id = b.vec_id AND reads.slot = i),
  z AS (SELECT *, CASE WHEN pick = seen THEN 'direct' WHEN seen IS NOT NULL THEN 'role-corrected' WHEN score >= 0.3 THEN 'role-inferred' ELSE 'unresolved' END AS source FROM o),
  y AS (SELECT vec_id, CASE WHEN bool_or(source = 'role-corrected' AND seen_score >= 0.55) THEN 'overruled' WHEN bool_or(source = 'unresolved') THEN 'incomplete' END AS anomaly,
    avg(score) FILTER (source <> 'unresolved') AS confidence FROM z GROUP BY 1)
  SELECT vec_id, slot::INTEGER AS slot, CASE WHEN source = 'unresolved' THEN 'UNKNOWN' ELSE pick END AS value, role, source, anomaly IS NULL AS valid, anomaly, score, round(confidence, 6) AS confidence FROM z JOIN y USING (vec_id)""")
def role_line_ups(t):
    """ARR-02: a vector scores twelve values for each of five slots; the best line-up of one tank, two damage and two support."""
    at = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).where("i < 60 and x is not null")
    value = F.concat(F.lit("h"), F.lpad((F.col("i") % 12).cast("string"), 2, "0"))
    role = F.get(F.array(*map(F.lit, _ROLES)), F.col("i") % 12)
    scored = at.select("vec_id", F.floor(F.col("i") / 12).cast("int").alias("slot"), value.alias("value"), role.alias("role"), F.round(F.col("x").cast("double") * 2 + 0.4, 6).alias("score"))
    w = Window.partitionBy("vec_id", "slot").orderBy(F.desc("score"), "value")
    ranked = scored.withColumns({"n": F.row_number().over(w), "margin": F.col("score") - F.lead("score").over(w)}).where("n = 1")
    reads = ranked.select("vec_id", "slot", F.when((F.col("score") >= 0.55) & (F.col("margin") >= 0.03), F.col("value")).alias("value"), "score")
    found = roles.line_ups(reads, scored, "vec_id")
    return found.withColumn("confidence", F.round("confidence", 6))
