"""SIM-08: an evenly spaced grid fitted to points by consensus, over all hypotheses that two points give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Places of a grid; the least and largest pitch in widths of a box; how far, in pitches, a point may lie off its place;
# how far, in widths, the outer boxes may stand out of the region.
PLACES, PITCH_LEAST, PITCH_MOST, OFF, BEYOND = 5, 1.00, 2.20, 0.34, 0.6


#: Pairs of points that a share of a key makes, or those of one point.
PAIRS = 200


def _best(points: pd.Series, starts: pd.Series, pitches: pd.Series) -> pd.DataFrame:
    """Of each row the best grid over its sorted points: less (the negative support), residual, start and pitch."""
    out = []
    for x, start, pitch in zip(points, starts, pitches, strict=True):
        x, start, pitch = (np.asarray(a, float) for a in (x, start, pitch))
        at = start[:, None] + np.arange(PLACES) * pitch[:, None]
        i = np.searchsorted(x, at)
        off = np.minimum(np.abs(x[np.maximum(i - 1, 0)] - at), np.abs(x[np.minimum(i, len(x) - 1)] - at))
        held = off <= (pitch * OFF)[:, None]
        less, residual = -held.sum(1), np.round(np.where(held, off, 0.0).sum(1), 6)
        b = np.lexsort((pitch, start, residual, less))[0]
        out.append((int(less[b]), float(residual[b]), float(start[b]), float(pitch[b])))
    return pd.DataFrame(out, columns=["less", "residual", "start", "pitch"])


def grid_fit(points: DataFrame, key: str, at: str, box: float, low: float, high: float) -> DataFrame:
    """`key`, support, residual, start and pitch of the best grid of PLACES places for each key's points in [low, high].

    Every two points of a key, one to four places apart, at each place, are a hypothesis if the pitch suits the width `box`
    of the boxes and the grid stays in the region. A place is supported by its nearest point if that is within OFF pitches.
    The most places count, then the least sum of their distances, then the smallest start (six digits each). Keys with fewer
    than two supported places have no row; equal points count once; null points don't count.

    A key's distinct points travel as one list, its first points in shares of some PAIRS pairs; hypotheses are made, fitted
    and reduced to the best within a row, so that none is shuffled: what is grows with the points and, for a key of many,
    with its shares.
    """
    own = points.where(F.col(key).isNotNull() & F.col(at).between(low, high)).select(F.col(key).alias("_key"), F.col(at).cast("double").alias("x")).distinct()
    lists = own.groupBy("_key").agg(F.array_sort(F.collect_list("x")).alias("points"))
    of = F.greatest(F.lit(1), F.floor(PAIRS / F.size("points"))).cast("int")  # first points of a share
    shares = lists.select("_key", "points", F.explode(F.sequence(F.lit(1), F.size("points"), of)).alias("share"), of.alias("of"))
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shares.repartition(spread, "_key", "share").select("_key", "points", F.slice("points", F.col("share"), F.col("of")).alias("xs"))
    whole = lambda n, start=0: F.array(*map(F.lit, range(start, n)))
    fits = lambda p: p.between(PITCH_LEAST * box, PITCH_MOST * box)
    pitches = lambda x: F.flatten(F.transform(F.filter("points", lambda y: (y > x) & (y - x <= (PLACES - 1) * PITCH_MOST * box)), lambda y: F.filter(F.transform(whole(PLACES, 1), lambda k: (y - x) / k), fits)))
    tried = F.flatten(F.transform("xs", lambda x: F.flatten(F.transform(pitches(x), lambda p: F.transform(whole(PLACES), lambda m: F.struct(F.round(x - m * p, 6).alias("start"), F.round(p, 6).alias("pitch")))))))
    inside = lambda g: (g["start"] - box / 2 >= low - box * BEYOND) & (g["start"] + (PLACES - 1) * g["pitch"] + box / 2 <= high + box * BEYOND)
    grids = dealt.select("_key", "points", F.filter(tried, inside).alias("grids"))
    kind = own.schema["_key"].dataType.simpleString()

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["starts"].map(len) > 0].reset_index(drop=True)
            yield _best(pdf["points"], pdf["starts"], pdf["pitches"]).assign(_key=pdf["_key"])

    rows = grids.select("_key", "points", F.col("grids.start").alias("starts"), F.col("grids.pitch").alias("pitches"))
    found = rows.mapInPandas(fitted, f"_key {kind}, less long, residual double, start double, pitch double").where("less <= -2")
    best = found.groupBy("_key").agg(F.min(F.struct("less", "residual", "start", "pitch")).alias("b"))
    return best.select(F.col("_key").alias(key), (-F.col("b.less")).alias("support"), "b.residual", "b.start", "b.pitch")
