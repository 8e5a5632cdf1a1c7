"""Implausible measurements of a source, judged by that source's own habit.

For every (source, label) series the logarithm of the value is decomposed robustly: trend = running median of
the medians of periods, season = median by weekday of what remains, residual = the rest. Residuals beyond the
limits of the generalised extreme studentised deviate test (with median and MAD in place of mean and deviation)
are outliers; a value is a spike if it lies `factor` times beyond everything that is no outlier, so every spike is one.
Stuck values (runs) and values out of range are separate checks.

Rows are shuffled once, by (series, chunk of ids), so a series that holds a third of all rows is many tasks' work.
Before a series is decomposed it is counted into cells (period, weekday, 1/64 of the logarithm), a number that its values'
range bounds and not its rows; the decomposition works on the cells of many series at a time. Runs are found within chunks;
only the pieces at a chunk's edges meet those of its neighbours, two for a chunk. What was found of a series goes
back to its chunks, where its rows still are.

Defined results: null values and blank sources are never flagged; repeated rows count once; rows without a day form
a period of their own and have no season; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.chars import sender_key
from tallyforge.functions.labels import nearest_labels
from tallyforge.operators.timestamps import written_day
from tallyforge.session import spread

BIN, MOST_BINS = 0.25, 400
#: Cells for each unit of the natural logarithm, and days of a period.
CELLS, PERIOD = 64, 28
#: Most distinct spellings whose canonical labels are broadcast; more are joined by a shuffle.
FEW_LABELS = 200_000

def t_quantile(p: float, df: float) -> float:
    """Student's t quantile by the Cornish-Fisher expansion."""
    z = NormalDist().inv_cdf(p)
    return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)


def esd_limit(n: int, i: int, alpha: float) -> float:
    """Critical value for the i-th most extreme of n values; infinite where too few remain."""
    left = n - i - 1
    if left < 3:
        return math.inf
    t = t_quantile(1 - alpha / (2 * (n - i + 1)), left)
    return (n - i) * t / math.sqrt((left + t * t) * (n - i + 1))


def grouped_median(group: np.ndarray, x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, their lower weighted medians, their weights)."""
    order = np.lexsort((x, group))
    g, v, c = group[order], x[order], np.cumsum(weight[order])
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    before = np.concatenate(([0], c))[first]
    total = np.concatenate((before[1:], c[-1:])) - before if len(first) else before
    at = np.searchsorted(c, before + (total + 1) // 2, side="left")
    return g[first], v[at], total


def others_of(series: np.ndarray, period: np.ndarray, dow: np.ndarray, x: np.ndarray, n: np.ndarray, alpha: float) -> np.ndarray:
    """Which cells hold no outlier of their series; cells of one series stand together, `series` counts from 0."""
    count = int(series.max()) + 1 if len(series) else 0
    # trend: median of a period, its two neighbours and the series' own median, which steadies periods of few rows
    key = np.unique(np.stack((series, period), axis=1), axis=0, return_inverse=True)
    pair, inverse = key[0], key[1].reshape(-1)
    _, m, _ = grouped_median(inverse, x, n)
    owner = pair[:, 0]
    whole = grouped_median(owner, m, np.ones(len(m), np.int64))[1] if len(m) else m
    near = np.full((len(m), 4), np.inf)
    near[:, 0] = m
    same = owner[1:] == owner[:-1]
    near[1:, 1][same] = m[:-1][same]
    near[:-1, 2][same] = m[1:][same]
    near[:, 3] = whole[owner]
    near.sort(axis=1)
    size = np.isfinite(near).sum(axis=1)
    r = x - near[np.arange(len(m)), (size + 1) // 2 - 1][inverse]
    # season: median by weekday where there are rows enough
    g = series * 8 + dow
    groups, med, total = grouped_median(g, r, n)
    at = np.searchsorted(groups, g)
    r = np.abs(r - np.where((total[at] >= 8) & (dow > 0), med[at], 0.0))
    _, mad, size = grouped_median(series, r, n)
    scale = np.maximum(1.4826 * mad, 0.05)
    bins = np.minimum(np.floor(r / scale[series] / BIN), MOST_BINS).astype(np.int64)
    # generalised ESD on the histogram: i = values at least so extreme; fewer than half can be outliers
    order = np.lexsort((-bins, series))
    so, bo, c = series[order], bins[order], np.cumsum(n[order])
    end = np.flatnonzero(np.concatenate(((so[1:] != so[:-1]) | (bo[1:] != bo[:-1]), [True]))) if len(so) else np.zeros(0, np.int64)
    start = np.concatenate(([0], np.cumsum(size)))[:count]
    i = c[end] - start[so[end]]
    cut = np.full(count, MOST_BINS + 1)
    for k in np.flatnonzero((i * 2 < size[so[end]]) & (bo[end] * BIN >= 1.5)):
        j = so[end[k]]
        if bo[end[k]] * BIN >= _limit(int(size[j]), int(i[k]), alpha):
            cut[j] = min(cut[j], bo[end[k]])
    return bins < cut[series]


@lru_cache(maxsize=100_000)
def _limit(n: int, i: int, alpha: float) -> float:
    return esd_limit(n, i, alpha)


def habits(cells: DataFrame, key: list[str], alpha: float) -> DataFrame:
    """Series with their cells (source, label, chunks, cells[period, dow, n, lo, hi]) -> what the source otherwise reports of the label.

    (source, label, chunks, lo, hi, n_others, kinds, main, n_rest): range, number and kinds of the values that are no outliers, the
    commonest of them, and how many are not it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = np.array([len(c) for c in b["cells"]], dtype=np.int64)
            flat = [x for c in b["cells"] for x in c]
            col = lambda k, t: np.array([x[k] for x in flat], dtype=t)  # noqa: B023, E731
            lo, hi, n = col("lo", np.int64), col("hi", np.int64), col("n", np.int64)
            x = (np.log(lo.astype(float)) + np.log(hi.astype(float))) / 2 if len(flat) else np.zeros(0)
            series = np.repeat(np.arange(len(b)), sizes)
            # series without a cell keep their place but take no part
            used, dense = np.unique(series, return_inverse=True)
            keep = others_of(dense, col("period", np.int64), col("dow", np.int64), x, n, alpha)
            out = {k: np.zeros(len(b), np.int64) for k in ("lo", "hi", "n_others", "kinds", "main", "n_rest")}
            s, a, z, w = series[keep], lo[keep], hi[keep], n[keep]
            out["lo"][:] = np.iinfo(np.int64).max
            np.minimum.at(out["lo"], s, a)
            np.maximum.at(out["hi"], s, z)
            np.add.at(out["n_others"], s, w)
            both = np.unique(np.stack((np.concatenate((s, s)), np.concatenate((a, z))), axis=1), axis=0)
            np.add.at(out["kinds"], both[:, 0], 1)
            one = a == z
            pairs, inverse = np.unique(np.stack((s[one], a[one]), axis=1), axis=0, return_inverse=True)
            times = np.bincount(inverse.reshape(-1), w[one], len(pairs)).astype(np.int64)
            order = np.lexsort((pairs[:, 1], times))
            most = np.zeros(len(b), np.int64)
            most[pairs[order, 0]], out["main"][pairs[order, 0]] = times[order], pairs[order, 1]
            out["n_rest"] = out["n_others"] - most
            yield pd.DataFrame({"source": b["source"], "label": b["label"], "chunks": b["chunks"], **out})

    return cells.select(*key, "chunks", "cells").mapInPandas(run, "source string, label string, chunks array<long>, lo long, hi long, n_others long, kinds long, main long, n_rest long")


def spikes(facts: DataFrame, factor: float = 3.0, alpha: float = 0.05, least_others: int = 4, run: int = 10, least: int = 1, chunk: int = 50_000, sources: DataFrame | None = None) -> DataFrame:
    """(source, label, row, part, value, day) without repeated rows -> (row, part, why): why is range, spike or stuck.

    `day` may be null. `sources`: the sources that are judged; None judges all. `least` must be above zero.
    """
    key = ["source", "label"]
    here = [*key, "chunk"]
    f = facts.where("source <> '' and value is not null and row is not null")
    slot = F.coalesce(F.floor(F.datediff("day", F.lit("1970-01-01")) / PERIOD), F.lit(-1_000_000)) * 8 + F.coalesce(F.dayofweek("day"), F.lit(0))
    f = f.select(*key, "row", "part", "value", slot.alias("slot"), F.floor(F.col("row") / chunk).alias("chunk")).repartition(*here)
    # cells, pieces and rows below all read this one window with all its columns, so that they share one exchange
    w = Window.partitionBy(*here).orderBy("row", "part", "slot")
    c = f.withColumn("new", F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(1))).withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    # cells of a series, counted first within its chunks, then over them
    x = F.floor(F.ln(F.col("value").cast("double")) * CELLS)
    grid = [*key, "period", "dow", "q"]
    cell = c.withColumns({"period": F.floor(F.col("slot") / 8), "dow": F.pmod("slot", F.lit(8)), "q": F.when(F.col("value") >= least, x)})
    cell = cell.groupBy(*grid).agg(F.count("piece").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.collect_set("chunk").alias("chunks"))
    shape = F.when(F.col("q").isNotNull(), F.struct(F.col("period"), F.col("dow"), F.col("n"), F.col("lo"), F.col("hi")))
    series = cell.groupBy(*key).agg(F.collect_list(shape).alias("cells"), F.array_distinct(F.flatten(F.collect_list("chunks"))).alias("chunks"))
    habit = habits(series, key, alpha)
    if sources is not None:
        habit = habit.join(sources.select("source"), "source", "left_semi")
    habit = habit.withColumn("chunk", F.explode("chunks")).drop("chunks")
    # runs: whole within a chunk, or of pieces at the edges of neighbouring chunks
    pieces = c.groupBy(*here, "piece").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    pieces = pieces.withColumn("last", F.col("piece") == F.max("piece").over(Window.partitionBy(*here)))
    edge = F.col("last") | (F.col("piece") == 1)
    wp = Window.partitionBy(*key).orderBy("chunk", "piece")
    joined = (F.col("piece") == 1) & F.lag("last").over(wp) & (F.lag("value").over(wp) == F.col("value"))
    edges = pieces.where(edge).withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(wp.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("n", F.sum("n").over(Window.partitionBy(*key, "island")))
    runs = pieces.where(~edge & (F.col("n") >= run)).select(*here, "piece").unionByName(edges.where(F.col("n") >= run).select(*here, "piece"))
    runs = runs.groupBy(*here).agg(F.collect_set("piece").alias("runs"))
    j = c.join(habit.join(runs, here, "left"), here)
    enough = F.col("n_others") >= least_others
    v = F.col("value")
    spike = enough & (v >= least) & ((v > factor * F.col("hi")) | (v * factor < F.col("lo")))
    # the series must vary otherwise: kinds of values, and rows that are not this one
    varies = enough & (F.col("kinds") >= 3) & ((v != F.col("main")) | (F.col("n_rest") >= least_others))
    stuck = F.array_contains("runs", F.col("piece")) & varies
    why = F.array_compact(F.array(F.when(v < least, "range"), F.when(spike, "spike"), F.when(stuck, "stuck")))
    return j.select("row", "part", F.explode(why).alias("why"))


def implausible_counts(extracted: DataFrame, blocks: DataFrame, chant_list: DataFrame, chant_variants: DataFrame, least_messages: int = 25, **kw) -> DataFrame:
    """(msg_id, seq, why) of counts that the block's sender cannot plausibly have reported; senders with fewer than `least_messages` messages have none.

    A row's day is its envelope_date in whatever notation, else the day of its batch. A repeated block id counts once.
    """
    day = F.coalesce(F.date_add(F.lit("1970-01-01").cast("date"), written_day(F.col("envelope_date"))), F.to_date("ingested_at"))
    b = spread(blocks.select("id", "sender", "envelope_date", "ingested_at")).select(F.col("id").alias("row"), sender_key(F.col("sender")).alias("source"), day.alias("day")).where("row is not null")
    b = b.groupBy("row").agg(F.min(F.when(F.col("source") != "", F.col("source"))).alias("source"), F.min("day").alias("day"))
    busy = b.where("source is not null").groupBy("source").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_messages).select("source")
    e = extracted.where("count is not null and msg_id is not null").select(F.col("msg_id").alias("row"), F.col("seq").alias("part"), F.coalesce("chant", F.lit("")).alias("chant"), F.col("count").alias("value"))
    typed = e.select("chant").distinct()
    canon = chant_list.where("chant is not null").select(F.col("chant").alias("spelling"), F.col("chant").alias("canonical"))
    # of the known spellings only those in another script add anything
    known = canon.unionByName(chant_variants.where(F.col("key").rlike(r"[^\x00-\x7f]")).select(F.col("key").alias("spelling"), "canonical")).distinct().collect()
    labels = nearest_labels(typed.withColumnRenamed("chant", "label"), [(r.spelling, r.canonical) for r in known]).select(F.col("label").alias("chant"), F.coalesce("canonical", F.lit("")).alias("label"))
    if typed.count() <= FEW_LABELS:
        labels = F.broadcast(labels)
    facts = e.repartition("row").distinct().join(b, "row").join(labels, "chant")
    return spikes(facts.select("source", "label", "row", "part", "value", "day"), sources=busy, **kw).select(F.col("row").alias("msg_id"), F.col("part").alias("seq"), "why")
