"""Temporal joins and sequence analytics on events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import sequence as seq
from tallyloom.operators import stints
from tallyloom.operators.joins import asof_join, range_join
from tallyloom.plans.registry import query

_SEC = "floor(epoch(ts))::BIGINT"
_E = f"e AS (SELECT event_id, user_id, event_type, value, {_SEC} AS t FROM events)"


def _events(t):
    return t.events.select("event_id", "user_id", "event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))


_SPANS = "s AS (SELECT event_id AS span_id, user_id AS span_user, t AS start, t + 3600 AS stop FROM e WHERE event_type = 'purchase')"


@query("range_join_bucketed", f"WITH {_E}, {_SPANS} SELECT event_id, span_id FROM e JOIN s ON user_id = span_user AND t BETWEEN start AND stop")
def range_join_bucketed(t):
    e = _events(t)
    spans = e.where("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), "user_id", F.col("t").alias("start"), (F.col("t") + 3600).alias("stop"))
    return range_join(e, spans, "t", "start", "stop", 3600, ("user_id",)).select("l.event_id", "r.span_id")


@query("range_join_exclusions", f"WITH {_E}, {_SPANS} SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE user_id = span_user AND t BETWEEN start AND stop)")
def range_join_exclusions(t):
    e = _events(t)
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("start"), (F.col("t") + 3600).alias("stop"))
    return range_join(e, spans, "t", "start", "stop", 3600, ("user_id",), "left_anti").select("event_id")


_WEEKS = "w AS (SELECT range AS week, 1704067200 + range * 604800 AS start, 1704067200 + range * 604800 + 604799 AS stop FROM range(5))"


@query("interval_join_narrowing", f"""WITH {_E}, {_WEEKS}, j AS (SELECT event_id, week, (week % 2 = user_id % 2)::INTEGER AS m FROM e JOIN w ON t BETWEEN start - 86400 AND stop + 86400),
  n AS (SELECT *, max(m) OVER (PARTITION BY event_id) AS top FROM j) SELECT event_id, week::BIGINT AS week FROM n WHERE m = top""")
def interval_join_narrowing(t):
    """JOIN-12: candidates that match more narrowly replace the others, where there are any."""
    first = 1704067200
    weeks = t.spark.range(5).select(F.col("id").alias("week"), (first + F.col("id") * 604800 - 86400).alias("start"), (first + F.col("id") * 604800 + 604799 + 86400).alias("stop"))
    joined = range_join(_events(t), weeks, "t", "start", "stop", 604800).select("event_id", "week", (F.col("week") % 2 == F.col("user_id") % 2).cast("int").alias("m"))
    return joined.withColumn("top", F.max("m").over(Window.partitionBy("event_id"))).where("m = top").select("event_id", "week")


@query("asof_backward", f"WITH {_E}, p AS (SELECT user_id, t, max(event_id) AS round FROM e WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, p.round FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.t >= p.t")
def asof_backward(t):
    e = _events(t)
    rounds = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("start"), F.col("event_id").alias("round"))
    return asof_join(e, rounds, ["user_id"], "t", "start", ["round"]).select("event_id", "round")


@query("nearest_within_tolerance", f"""WITH {_E}, p AS (SELECT user_id, event_id AS other, t AS pt FROM e WHERE event_type = 'purchase'), c AS (SELECT event_id, other, abs(e.t - pt) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(e.t - pt), pt, other DESC) AS k FROM e JOIN p ON e.user_id = p.user_id AND abs(e.t - pt) <= 7200 WHERE event_type = 'click')
  SELECT e.event_id, c.d::BIGINT AS distance FROM e LEFT JOIN c ON c.event_id = e.event_id AND k = 1 WHERE e.event_type = 'click'""")
def nearest_within_tolerance(t):
    """JOIN-15: the nearer of the rows before and after, if near enough."""
    e = _events(t)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("at"), F.col("event_id").alias("other"))
    before = asof_join(e.where("event_type = 'click'"), p, ["user_id"], "t", "at", ["other"]).withColumnsRenamed({"found_at": "b"}).drop("other")
    both = asof_join(before, p, ["user_id"], "t", "at", ["other"], forward=True)
    near = F.least(F.col("t") - F.col("b"), F.col("found_at") - F.col("t"))
    return both.select("event_id", F.when(near <= 7200, near).alias("distance"))


@query("ordered_track", f"WITH {_E} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::INTEGER AS n FROM e WHERE value >= 50")
def ordered_track(t):
    return _events(t).where("value >= 50").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("n"))


@query("change_points_lag", f"WITH {_E} SELECT event_id, event_type, p AS previous_value FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e) WHERE p <> event_type")
def change_points_lag(t):
    return seq.change_points(_events(t), ["user_id"], ["t", "event_id"], "event_type").select("event_id", "event_type", "previous_value")


def _gap_sql(op: str) -> str:
    return f"""WITH {_E}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) {op} 21600 AS new FROM e), i AS (SELECT *, sum(coalesce(new, false)::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM g)
  SELECT user_id, min(t) AS first_at, max(t) AS last_at, count(*)::BIGINT AS n FROM i GROUP BY user_id, island"""


def _gaps(t, closed: bool):
    e = _events(t)
    gap = F.col("t") - seq.previous("t", ["user_id"], ["t", "event_id"])
    marked = seq.islands(e.withColumn("new", gap >= 21600 if closed else gap > 21600), ["user_id"], ["t", "event_id"], F.col("new"))
    return marked.groupBy("user_id", "island").agg(F.min("t").alias("first_at"), F.max("t").alias("last_at"), F.count("*").alias("n")).drop("island")


@query("gap_blocks", _gap_sql(">"))
def gap_blocks(t):
    return _gaps(t, closed=False)


@query("gap_blocks_ge", _gap_sql(">="))
def gap_blocks_ge(t):
    return _gaps(t, closed=True)


@query("session_window_blocks", _gap_sql(">").replace("min(t) AS first_at, max(t) AS last_at, ", ""))
def session_window_blocks(t):
    e = _events(t).withColumn("at", F.timestamp_seconds("t"))
    return e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n")).drop("session_window")


@query("stints_islands", f"""WITH {_E}, c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS ch FROM e), r AS (SELECT *, sum(ch::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c)
  SELECT user_id, min(event_type) AS event_type, min(t) AS first_at, max(t) AS last_at, count(*)::BIGINT AS length FROM r GROUP BY user_id, run""")
def stints_islands(t):
    return seq.run_lengths(_events(t), ["user_id"], ["t", "event_id"], "event_type", "t").drop("run")


@query("run_length_encode", f"""WITH {_E}, c AS (SELECT *, (value >= 50) IS DISTINCT FROM lag(value >= 50) OVER (PARTITION BY user_id ORDER BY t, event_id) AS ch FROM e), r AS (SELECT *, sum(ch::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c),
  g AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n)::BIGINT AS longest, count(*)::BIGINT AS runs FROM g GROUP BY 1""")
def run_length_encode(t):
    runs = seq.run_lengths(_events(t).withColumn("high", F.col("value") >= 50), ["user_id"], ["t", "event_id"], "high", "t")
    return runs.groupBy("user_id").agg(F.max("length").alias("longest"), F.count("*").alias("runs"))


@query("longest_run", f"""WITH {_E}, c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS ch FROM e), r AS (SELECT *, sum(ch::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c)
  SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1""")
def longest_run(t):
    return seq.run_lengths(_events(t), ["user_id"], ["t", "event_id"], "event_type", "t").groupBy("user_id").agg(F.max("length").alias("longest"))


def _row(kind: str, run: str, other: str, reason: str) -> str:
    return f"{{'kind': {kind}, 'value': {run}.v, 'other': {other}, 't': {run}.a, 'stop': {run}.b, 'reads': {run}.n, 'mean': {run}.s / {run}.n, 'least': {run}.l, 'margin': {run}.m / {run}.n, 'reason': {reason}}}"


#: The state machine row by row: h is what is held, k0 the rival before a read and k1 after it.
_STINTS = f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, t / 8640::DOUBLE AS t, event_type AS v, value / 100 AS s, abs(value - 50) / 100 AS m, row_number() OVER (PARTITION BY user_id ORDER BY t, event_type, value) AS n, count(*) OVER (PARTITION BY user_id) AS n_all FROM e),
  r AS (
    SELECT DISTINCT user_id, 0::BIGINT AS n, n_all, NULL::STRUCT(v VARCHAR, a DOUBLE, b DOUBLE, n BIGINT, s DOUBLE, l DOUBLE, m DOUBLE) AS h, NULL::STRUCT(v VARCHAR, a DOUBLE, b DOUBLE, n BIGINT, s DOUBLE, l DOUBLE, m DOUBLE) AS k,
      []::STRUCT(kind VARCHAR, "value" VARCHAR, other VARCHAR, t DOUBLE, stop DOUBLE, reads BIGINT, mean DOUBLE, least DOUBLE, margin DOUBLE, reason VARCHAR)[] AS outs FROM o
    UNION ALL
    SELECT user_id, n, n_all, CASE WHEN same THEN {{'v': h.v, 'a': h.a, 'b': t, 'n': h.n + 1, 's': h.s + s, 'l': least(h.l, s), 'm': h.m + m}} WHEN doubt = 'ok' THEN k1 ELSE h END,
      CASE WHEN same OR doubt = 'ok' OR lasting THEN NULL ELSE k1 END,
      list_filter([CASE WHEN same AND k0 IS NOT NULL THEN {_row("'rejected-swap'", "k0", "h.v", "'returned'")} END, CASE WHEN NOT same AND h IS NOT NULL AND k0.v <> v THEN {_row("'rejected-swap'", "k0", "h.v", "'interrupted'")} END,
        CASE WHEN doubt = 'ok' AND h IS NOT NULL THEN {_row("'stint'", "h", "NULL", "NULL")} END, CASE WHEN doubt = 'ok' AND h IS NOT NULL THEN {_row("'swap'", "k1", "h.v", "NULL")} END, CASE WHEN lasting THEN {_row("'rejected-swap'", "k1", "h.v", "doubt")} END], lambda x: x IS NOT NULL)
    FROM (SELECT *, coalesce(h IS NOT NULL AND doubt <> 'ok' AND k1.n >= 5 AND k1.b - k1.a > 3, false) AS lasting FROM (
      SELECT *, CASE WHEN k1 IS NULL THEN NULL WHEN NOT strong AND k1.n < 3 THEN 'few-reads' WHEN NOT strong AND k1.b - k1.a < 3 THEN 'short-span' WHEN k1.m / k1.n < 0.05 THEN 'small-margin' ELSE 'ok' END AS doubt FROM (
        SELECT *, coalesce(k1.n >= 2 AND k1.b - k1.a >= 2 AND k1.l >= 0.8, false) AS strong FROM (
          SELECT *, CASE WHEN same THEN NULL WHEN k0 IS NULL OR k0.v <> v OR (h IS NOT NULL AND t - k0.b > 20) THEN {{'v': v, 'a': t, 'b': t, 'n': 1::BIGINT, 's': s, 'l': s, 'm': m}}
            ELSE {{'v': v, 'a': k0.a, 'b': t, 'n': k0.n + 1, 's': k0.s + s, 'l': least(k0.l, s), 'm': k0.m + m}} END AS k1 FROM (
            SELECT o.*, r.h, r.k AS k0, coalesce(r.h.v = o.v, false) AS same FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)))))),
  x AS (SELECT user_id, unnest(outs) AS x FROM r
    UNION ALL SELECT user_id, CASE WHEN h IS NOT NULL THEN {_row("'rejected-swap'", "k", "h.v", "'unresolved'")} ELSE {_row("'unestablished'", "k", "NULL", "'few-reads'")} END FROM r WHERE n = n_all AND k IS NOT NULL
    UNION ALL SELECT user_id, {_row("'stint'", "h", "NULL", "NULL")} FROM r WHERE n = n_all AND h IS NOT NULL)
  SELECT user_id, x.kind, x."value", x.other, round(x.t, 6) AS t, round(x.stop, 6) AS "end", x.reads, round(x.mean, 6) AS mean, round(x.least, 6) AS least, round(x.margin, 6) AS margin, x.reason FROM x"""


@query("stint_events", _STINTS)
def stint_events(t):
    """WIN-06: what each user holds, with every confirmed and rejected change; a day counts as ten seconds."""
    e = _events(t).select("user_id", (F.col("t") / 8640.0).alias("t"), F.col("event_type").alias("value"), (F.col("value") / 100).alias("score"), (F.abs(F.col("value") - 50) / 100).alias("margin"), F.create_map("event_type", F.col("value") / 100).alias("scores"))
    found = stints.stints(e, "user_id")
    return found.drop("early", "stands").withColumns({c: F.round(c, 6) for c in ("t", "end", "mean", "least", "margin")})


def _run(kind: str, run: str, other: str, reason: str) -> str:
    """A settled run as an output row; of a stint also whether it is early and stands."""
    stint = kind == "'stint'"
    early = f"coalesce({run}.a - {run}.rs <= 30, false)" if stint else "NULL::BOOLEAN"
    stands = f"({early} IS FALSE OR {run}.b >= {run}.rs + 60 OR coalesce({run}.re < {run}.rs + 60, false))" if stint else "NULL::BOOLEAN"
    return f"{_row(kind, run, other, reason)[:-1]}, 'early': {early}, 'stands': {stands}}}"


_RUN = "STRUCT(v VARCHAR, a DOUBLE, b DOUBLE, n BIGINT, s DOUBLE, l DOUBLE, m DOUBLE, o DOUBLE, c BIGINT, su BOOLEAN, rs DOUBLE, re DOUBLE)"
_OUTS = """STRUCT(kind VARCHAR, "value" VARCHAR, other VARCHAR, t DOUBLE, stop DOUBLE, reads BIGINT, mean DOUBLE, least DOUBLE, margin DOUBLE, reason VARCHAR, early BOOLEAN, stands BOOLEAN)[]"""
#: As _STINTS, with what the held value scores in each read (over), the setups (su) and the latest round (rs, re) of the slot's map.
_STINT_ROUNDS = f"""WITH RECURSIVE {_E},
  q AS (SELECT event_id, user_id, user_id // 10 AS grp, t / 8640::DOUBLE AS t, event_type, value, CASE event_type WHEN 'purchase' THEN 'b' WHEN 'error' THEN 'c' ELSE 'a' END AS v,
    {{'a': value * 7 % 100 / 100, 'b': value * 13 % 100 / 100, 'c': value * 29 % 100 / 100}} AS sc FROM e),
  setups AS (SELECT grp, t AS a, t + 3 AS b FROM q WHERE event_type = 'signup' AND value > 100),
  rounds AS (SELECT grp, t AS rs, lead(t) OVER (PARTITION BY grp ORDER BY t, event_id) - 5 AS re FROM q WHERE event_type = 'purchase' AND value > 180),
  p AS (SELECT q.*, CASE v WHEN 'a' THEN sc.a WHEN 'b' THEN sc.b ELSE sc.c END AS s, abs(value - 50) / 100 AS m, rs, re FROM q ASOF LEFT JOIN rounds ON q.grp = rounds.grp AND q.t >= rounds.rs),
  o AS (SELECT p.*, EXISTS (SELECT 1 FROM setups WHERE setups.grp = p.grp AND a - 2 <= p.t AND p.t <= b + 2) AS su,
    row_number() OVER (PARTITION BY user_id ORDER BY t, v, s, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS n_all FROM p),
  r AS (
    SELECT DISTINCT user_id, grp, 0::BIGINT AS n, n_all, NULL::{_RUN} AS h, NULL::{_RUN} AS k, []::{_OUTS} AS outs FROM o
    UNION ALL
    SELECT user_id, grp, n, n_all,
      CASE WHEN same THEN {{'v': h.v, 'a': h.a, 'b': t, 'n': h.n + 1, 's': h.s + s, 'l': least(h.l, s), 'm': h.m + m, 'o': h.o, 'c': h.c, 'su': h.su, 'rs': h.rs, 're': h.re}} WHEN doubt = 'ok' THEN k1 ELSE h END,
      CASE WHEN same OR doubt = 'ok' OR lasting THEN NULL ELSE k1 END,
      list_filter([
        CASE WHEN same AND k0 IS NOT NULL THEN {_run("'rejected-swap'", "k0", "h.v", "'returned'")} END,
        CASE WHEN NOT same AND h IS NOT NULL AND k0.v <> v THEN {_run("'rejected-swap'", "k0", "h.v", "'interrupted'")} END,
        CASE WHEN doubt = 'ok' AND h IS NOT NULL THEN {_run("'stint'", "h", "NULL", "NULL")} END,
        CASE WHEN doubt = 'ok' AND h IS NOT NULL THEN {_run("CASE WHEN k1.su THEN 'setup-change' ELSE 'swap' END", "k1", "h.v", "NULL")} END,
        CASE WHEN lasting THEN {_run("'rejected-swap'", "k1", "h.v", "doubt")} END], lambda x: x IS NOT NULL)
    FROM (SELECT *, coalesce(h IS NOT NULL AND doubt <> 'ok' AND k1.n >= 5 AND k1.b - k1.a > 3, false) AS lasting FROM (
      SELECT *, CASE WHEN k1 IS NULL THEN NULL WHEN NOT strong AND k1.n < 3 THEN 'few-reads' WHEN NOT strong AND k1.b - k1.a < 3 THEN 'short-span'
        WHEN k1.m / k1.n < 0.05 THEN 'small-margin' WHEN k1.c > 0 AND k1.o / k1.c < 0.04 THEN 'not-displaced' ELSE 'ok' END AS doubt FROM (
        SELECT *, coalesce(k1.n >= 2 AND k1.b - k1.a >= 2 AND k1.l >= 0.8, false) AS strong FROM (
          SELECT *, CASE WHEN same THEN NULL
            WHEN k0 IS NULL OR k0.v <> v OR (h IS NOT NULL AND t - k0.b > 20)
              THEN {{'v': v, 'a': t, 'b': t, 'n': 1::BIGINT, 's': s, 'l': s, 'm': m, 'o': coalesce(over, 0), 'c': (over IS NOT NULL)::BIGINT, 'su': su, 'rs': rs, 're': re}}
            ELSE {{'v': v, 'a': k0.a, 'b': t, 'n': k0.n + 1, 's': k0.s + s, 'l': least(k0.l, s), 'm': k0.m + m, 'o': k0.o + coalesce(over, 0), 'c': k0.c + (over IS NOT NULL)::BIGINT, 'su': k0.su, 'rs': k0.rs, 're': k0.re}}
            END AS k1 FROM (
            SELECT o.*, r.h, r.k AS k0, coalesce(r.h.v = o.v, false) AS same, o.s - CASE r.h.v WHEN 'a' THEN o.sc.a WHEN 'b' THEN o.sc.b WHEN 'c' THEN o.sc.c END AS over
            FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)))))),
  x AS (SELECT user_id, grp, unnest(outs) AS x FROM r
    UNION ALL SELECT user_id, grp, CASE WHEN h IS NOT NULL THEN {_run("'rejected-swap'", "k", "h.v", "'unresolved'")} ELSE {_run("'unestablished'", "k", "NULL", "'few-reads'")} END FROM r WHERE n = n_all AND k IS NOT NULL
    UNION ALL SELECT user_id, grp, {_run("'stint'", "h", "NULL", "NULL")} FROM r WHERE n = n_all AND h IS NOT NULL)
  SELECT user_id, grp, x.kind, x."value", x.other, round(x.t, 6) AS t, round(x.stop, 6) AS "end", x.reads, round(x.mean, 6) AS mean, round(x.least, 6) AS least,
    round(x.margin, 6) AS margin, x.reason, x.early, x.stands FROM x"""


@query("stint_rounds", _STINT_ROUNDS)
def stint_rounds(t):
    """WIN-06, FLT-11: users are slots, ten of them a map; a day counts as ten seconds. Each read scores all three values.

    Large signups of a map's users open a setup of three seconds, its largest purchases begin a round each, which ends five
    seconds before the next. So changes in setups, values that don't displace the held one and early stints all occur.
    """
    value = F.when(F.col("event_type") == "purchase", "b").when(F.col("event_type") == "error", "c").otherwise("a")
    scores = F.create_map(*(x for k, by in (("a", 7), ("b", 13), ("c", 29)) for x in (F.lit(k), F.col("value") * by % 100 / 100)))
    e = _events(t).withColumn("grp", F.floor(F.col("user_id") / 10)).withColumn("at", F.col("t") / 8640.0)
    reads = e.select("grp", "user_id", F.col("at").alias("t"), value.alias("kind"), F.abs(F.col("value") - 50).alias("off"), scores.alias("scores"))
    reads = reads.select("grp", "user_id", "t", F.col("kind").alias("value"), F.col("scores")[F.col("kind")].alias("score"), (F.col("off") / 100).alias("margin"), "scores")
    setups = e.where("event_type = 'signup' and value > 100").select("grp", F.col("at").alias("start"), (F.col("at") + 3).alias("end"))
    following = F.lead("at").over(Window.partitionBy("grp").orderBy("at", "event_id"))
    rounds = e.where("event_type = 'purchase' and value > 180").select("grp", F.col("at").alias("start"), (following - 5).alias("end"))
    found = stints.stints(reads, ["grp", "user_id"], setups, rounds, within=["grp"])
    return found.withColumns({c: F.round(c, 6) for c in ("t", "end", "mean", "least", "margin")})


@query("dense_windows", f"""WITH {_E}, m AS (SELECT user_id, event_id AS mark, t AS start FROM e WHERE event_type = 'purchase' AND value > 100)
  SELECT e.event_id, mark, t - start <= {32 * 8640} AS settling, t - start >= {28 * 8640} AS recheck FROM e JOIN m ON e.user_id = m.user_id AND t >= start AND t <= start + {62 * 8640}""")
def dense_windows(t):
    """STM-03: the events from a user's large purchase to 62 seconds after it (a day being ten), in the window right after it,
    in that of the recheck, or both. streaming.around() is the same on streams."""
    e = _events(t)
    marks = e.where("event_type = 'purchase' and value > 100").select("user_id", F.col("event_id").alias("mark"), F.col("t").alias("start"), (F.col("t") + 62 * 8640).alias("stop"))
    found = range_join(e, marks, "t", "start", "stop", 62 * 8640, keys=("user_id",))
    since = F.col("t") - F.col("start")
    return found.select("event_id", "mark", (since <= 32 * 8640).alias("settling"), (since >= 28 * 8640).alias("recheck"))


@query("emblem_rounds", f"""WITH RECURSIVE {_E}, a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
  f AS (SELECT user_id, n, n * 5::DOUBLE AS t, first_value(event_type) OVER (PARTITION BY user_id, n * 5 // 60 ORDER BY n) AS kind FROM a),
  c AS (SELECT user_id, n, t, dense_rank() OVER (PARTITION BY user_id ORDER BY born) AS id FROM (SELECT *, min(n) OVER (PARTITION BY user_id, kind) AS born FROM f)),
  m AS (SELECT user_id, n, t, CASE WHEN lag(id) OVER w IS NULL OR lead(id) OVER w IS NULL THEN id ELSE list_sort([lag(id) OVER w, id, lead(id) OVER w])[2] END AS id FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n)),
  g AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY n) AS k FROM (SELECT *, id IS DISTINCT FROM lag(id) OVER (PARTITION BY user_id ORDER BY n) AS new FROM m)),
  s AS (SELECT user_id, k, min(id) AS id, min(t) AS a, max(t) AS b, count(*) AS reads FROM g GROUP BY user_id, k),
  r AS (SELECT user_id, k, id, a, b, 1 AS part FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.k, CASE WHEN s.reads < 4 THEN r.id ELSE s.id END, s.a, s.b, part + (s.reads >= 4)::INTEGER FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1),
  z AS (SELECT user_id, part, any_value(id) AS id, min(a) AS a, max(b) AS b FROM r GROUP BY user_id, part),
  y AS (SELECT *, sum(setup::INTEGER) OVER (PARTITION BY user_id ORDER BY a) AS block FROM (SELECT *, id = first_value(id) OVER (PARTITION BY user_id ORDER BY a) AS setup FROM z)),
  u AS (SELECT user_id, 'setup' AS part, a, b FROM y WHERE setup UNION ALL SELECT user_id, 'round', min(a), max(b) FROM y WHERE NOT setup GROUP BY user_id, block HAVING max(b) - min(a) >= 45)
  SELECT user_id, part, row_number() OVER (PARTITION BY user_id, part ORDER BY a)::INTEGER AS number, a AS start, b AS "end" FROM u""")
def emblem_rounds(t):
    """WIN-07: rounds and setups of each user, whose events are frames five seconds apart with their kind as the emblem."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) * 5.0
    # The kind of a minute's first frame stands for the minute.
    kind = F.first("event_type").over(Window.partitionBy("user_id", F.floor(F.col("at") / 60)).orderBy("at"))
    frames = _events(t).withColumn("at", at).withColumn("kind", kind)
    emblem = F.array(*(F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in ("view", "click", "purchase", "signup", "error")))
    return stints.rounds_of(stints.emblem_segments(frames.select("user_id", F.col("at").alias("t"), emblem.alias("emblem")), "user_id"), "user_id")


@query("median3_smooth", f"WITH {_E} SELECT event_id, list_sort([lag(floor(value)) OVER w, floor(value), lead(floor(value)) OVER w])[2] AS smooth FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id) QUALIFY lag(value) OVER w IS NOT NULL AND lead(value) OVER w IS NOT NULL")
def median3_smooth(t):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    v = F.floor("value").cast("double")
    three = _events(t).withColumn("v", v).select("event_id", F.lag("v").over(w).alias("a"), "v", F.lead("v").over(w).alias("c")).where("a is not null and c is not null")
    return three.select("event_id", F.array_sort(F.array("a", "v", "c"))[1].alias("smooth"))


@query("first_value_reference", f"WITH {_E} SELECT event_id, round(abs(value - first_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id)), 4) AS diff FROM e")
def first_value_reference(t):
    first = F.first("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return _events(t).select("event_id", F.round(F.abs(F.col("value") - first), 4).alias("diff"))


@query("interval_clip_explode", f"WITH {_E}, x AS (SELECT event_id, greatest(t - 1800, t // 3600 * 3600) AS a, least(t + 1800, t // 3600 * 3600 + 3600) AS b FROM e) SELECT event_id, a::BIGINT AS start, b::BIGINT AS stop FROM x WHERE b > a")
def interval_clip_explode(t):
    hour = F.floor(F.col("t") / 3600) * 3600
    return _events(t).select("event_id", F.greatest(F.col("t") - 1800, hour).alias("start"), F.least(F.col("t") + 1800, hour + 3600).alias("stop")).where("stop > start")


@query("merge_intervals", f"""WITH {_E}, p AS (SELECT user_id, t AS a, t + 7200 AS b, max(t + 7200) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
  i AS (SELECT *, sum((a > coalesce(reach, a) + 600)::INTEGER) OVER (PARTITION BY user_id ORDER BY a) AS g FROM p) SELECT user_id, min(a) AS start, max(b) AS stop, count(*)::BIGINT AS parts FROM i GROUP BY user_id, g""")
def merge_intervals(t):
    e = _events(t).select("user_id", F.col("t").alias("start"), (F.col("t") + 7200).alias("stop"))
    return seq.merge_intervals(e, ["user_id"], "start", "stop", 600)


@query("consecutive_runs_k", f"""WITH {_E}, c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS ch FROM e), r AS (SELECT *, sum(ch::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c)
  SELECT user_id, min(event_type) AS event_type, count(*)::BIGINT AS length FROM r GROUP BY user_id, run HAVING count(*) >= 3""")
def consecutive_runs_k(t):
    return seq.run_lengths(_events(t), ["user_id"], ["t", "event_id"], "event_type", "t").where("length >= 3").select("user_id", "event_type", "length")


@query("running_sum_budget", """SELECT doc_id FROM (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents) WHERE before < total - 60000""")
def running_sum_budget(t):
    return seq.evict_until_budget(t.documents, ["source"], ["doc_id"], "n_chars", 60000, F.floor(F.col("doc_id") / 5000)).select("doc_id")


@query("tolerant_runs", f"""WITH {_E}, h AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e WHERE value >= 30), i AS (SELECT *, sum((coalesce(gap, 0) > 43200)::INTEGER) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM h)
  SELECT user_id, min(t) - 300 AS start, max(t) + 300 AS stop, count(*)::BIGINT AS n FROM i GROUP BY user_id, g""")
def tolerant_runs(t):
    e = _events(t).where("value >= 30")
    gap = F.coalesce(F.col("t") - seq.previous("t", ["user_id"], ["t", "event_id"]), F.lit(0))
    marked = seq.islands(e.withColumn("new", gap > 43200), ["user_id"], ["t", "event_id"], F.col("new"))
    return marked.groupBy("user_id", "island").agg((F.min("t") - 300).alias("start"), (F.max("t") + 300).alias("stop"), F.count("*").alias("n")).drop("island")


@query("monotone_accept", f"""WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e),
  r AS (SELECT user_id, n, event_id, value, t, value AS high, t AS late, true AS ok FROM o WHERE n = 1
    UNION ALL SELECT o.user_id, o.n, o.event_id, o.value, o.t, CASE WHEN o.value >= high AND o.t >= late THEN o.value ELSE high END, CASE WHEN o.value >= high AND o.t >= late THEN o.t ELSE late END, o.value >= high AND o.t >= late
    FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, event_id, value, t::DOUBLE AS t FROM r WHERE ok""")
def monotone_accept(t):
    e = _events(t).select("user_id", "event_id", "value", F.col("t").cast("double").alias("t"))
    return seq.monotone(e, "user_id", "event_id", ("value", "t"))


@query("ffill_segments", f"WITH {_E} SELECT event_id, last_value(CASE WHEN value >= 70 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS named FROM e")
def ffill_segments(t):
    e = _events(t).withColumn("read", F.when(F.col("value") >= 70, F.col("event_type")))
    return seq.forward_fill(e, ["user_id"], ["t", "event_id"], "read", "named").select("event_id", "named")


@query("boundary_guard", f"WITH {_E} SELECT event_id FROM (SELECT *, min(t) OVER p AS a, max(t) OVER p AS b FROM e WINDOW p AS (PARTITION BY user_id)) WHERE t - a >= 86400 AND b - t >= 86400")
def boundary_guard(t):
    p = Window.partitionBy("user_id")
    return _events(t).withColumns({"a": F.min("t").over(p), "b": F.max("t").over(p)}).where("t - a >= 86400 and b - t >= 86400").select("event_id")


@query("temporal_split_deadzone", f"WITH {_E} SELECT event_id, CASE WHEN f < 0.7 THEN 'build' WHEN f > 0.75 THEN 'holdout' END AS part FROM (SELECT *, (t - min(t) OVER p) / nullif(max(t) OVER p - min(t) OVER p, 0) AS f FROM e WINDOW p AS (PARTITION BY user_id)) WHERE f < 0.7 OR f > 0.75")
def temporal_split_deadzone(t):
    p = Window.partitionBy("user_id")
    f = F.try_divide(F.col("t") - F.min("t").over(p), F.nullif(F.max("t").over(p) - F.min("t").over(p), F.lit(0)))
    return _events(t).withColumn("f", f).where("f < 0.7 or f > 0.75").select("event_id", F.when(F.col("f") < 0.7, "build").otherwise("holdout").alias("part"))


@query("even_spread_sample", f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id FROM r WHERE n <= 10 OR k * 10 // n <> (k - 1) * 10 // n OR k = 0")
def even_spread_sample(t):
    p = Window.partitionBy("user_id")
    r = _events(t).withColumns({"k": F.row_number().over(p.orderBy("t", "event_id")) - 1, "n": F.count("*").over(p)})
    return r.where("n <= 10 or k = 0 or cast(k * 10 as bigint) div n <> cast((k - 1) * 10 as bigint) div n").select("event_id")


@query("round_robin_sample", f"""WITH {_E}, b AS (SELECT *, least(7, (t - 1704067200) // 324000) AS region FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, region ORDER BY value DESC, event_id) AS rn FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn, region, event_id) AS pick FROM r)
  SELECT user_id, event_id FROM o WHERE pick <= 8""")
def round_robin_sample(t):
    b = _events(t).withColumn("region", F.least(F.lit(7), F.floor((F.col("t") - 1704067200) / 324000)))
    r = b.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "region").orderBy(F.desc("value"), "event_id")))
    return r.withColumn("pick", F.row_number().over(Window.partitionBy("user_id").orderBy("rn", "region", "event_id"))).where("pick <= 8").select("user_id", "event_id")


@query("step_runs", "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d) SELECT l_orderkey, min(l_linenumber) AS first_at, max(l_linenumber) AS last_at FROM i GROUP BY l_orderkey, g")
def step_runs(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    g = F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return d.withColumn("g", g).groupBy("l_orderkey", "g").agg(F.min("l_linenumber").alias("first_at"), F.max("l_linenumber").alias("last_at")).drop("g")


@query("span_capped_batches", f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM e),
  r AS (SELECT user_id, n, t, t AS start, 1 AS batch FROM o WHERE n = 1
    UNION ALL SELECT o.user_id, o.n, o.t, CASE WHEN o.t - r.t > 21600 OR o.t - start > 86400 THEN o.t ELSE start END, batch + (o.t - r.t > 21600 OR o.t - start > 86400)::INTEGER FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
  SELECT user_id, min(t) AS first_at, max(t) AS last_at, count(*)::BIGINT AS n FROM r GROUP BY user_id, batch""")
def span_capped_batches(t):
    return seq.span_capped(_events(t), "user_id", "t", 21600, 86400)


@query("latest_group_rows", "SELECT o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS k FROM orders) WHERE k = 1")
def latest_group_rows(t):
    return t.orders.withColumn("k", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate")))).where("k = 1").select("o_orderkey")


@query("chronological_ordinal", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS n FROM orders WHERE o_orderstatus <> 'P'")
def chronological_ordinal(t):
    return t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n"))


@query("latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_key(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("lead_end_offset", f"WITH {_E} SELECT event_id, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS ends FROM e")
def lead_end_offset(t):
    return _events(t).select("event_id", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("ends"))


@query("latest_map_earliest_per_team", """WITH m AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1) SELECT o_custkey, l_returnflag, arg_min(l_partkey, (l_shipdate, l_partkey, l_linenumber)) AS part FROM m JOIN lineitem ON l_orderkey = k GROUP BY ALL""")
def latest_map_earliest_per_team(t):
    m = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey"))
    return m.join(t.lineitem, "l_orderkey").groupBy("o_custkey", "l_returnflag").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_partkey", "l_linenumber")).alias("part"))


@query("tumbling_counts", "SELECT (floor(epoch(ts))::BIGINT // 3600 * 3600)::BIGINT AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def tumbling_counts(t):
    return t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count("*").alias("n")).select(F.unix_timestamp("window.start").alias("start"), "n")


@query("sliding_counts", "SELECT (floor(epoch(ts))::BIGINT // 1800 * 1800 - o * 1800)::BIGINT AS start, count(*)::BIGINT AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1")
def sliding_counts(t):
    return t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")).agg(F.count("*").alias("n")).select(F.unix_timestamp("window.start").alias("start"), "n")


@query("sample_ladder", "SELECT c_nationkey, unnest(range(0, count(*) + 1, 25))::BIGINT AS at FROM customer GROUP BY 1")
def sample_ladder_rows(t):
    from tallyloom.sources.tables import sample_ladder

    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("stop")).withColumn("start", F.lit(0).cast("long"))
    return sample_ladder(c, "start", "stop", 25).select("c_nationkey", "at")
