"""Histograms and split candidates.

Histograms are sums over (node, feature, bin), added up within tasks first; their
size depends on knots and codes and not on rows. Candidates come from them
in two ways: ``split_table`` as window expressions, and ``best_split`` on the
driver while a tree grows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.columns import FLAT, score_const, score_linear
from tessera.operators.encoders import Encoder, Encoders, numbers
from tessera.sources.frame import Kind

SUMS = ("g", "h", "gz", "hz", "hzz")


def with_bins(df: DataFrame, encoders: Encoders) -> DataFrame:
    """df with arrays bins and zs, one entry per feature.

    Equal to each encoder's bins() and z(); as a vectorised map, since the
    expressions of many features outgrow the limits of generated code.
    """
    found = list(encoders)
    names = df.columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            bins, zs = np.zeros((n, len(found)), np.int32), np.zeros((n, len(found)))
            for i, e in enumerate(found):
                x = numbers(batch.column(e.value))
                if e.kind is Kind.BOUNDED:
                    bins[:, i] = x
                    continue
                gone = np.isnan(x)
                bins[:, i] = np.where(gone, -1, np.searchsorted(np.array(e.knots), x, side="right"))
                lo, hi = e.knots[0], e.knots[-1]
                if hi > lo:
                    zs[:, i] = np.where(gone, 0.0, np.clip((x - lo) / (hi - lo), 0, 1))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(found))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (bins, zs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, "bins", "zs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, bins array<int>, zs array<double>")


def histogram(df: DataFrame, node: Column) -> DataFrame:
    """node, feature, bin and the sums g, h, gz, hz, hzz and n.

    Each task adds up its rows in arrays of nodes x features x bins; only these
    sums are shuffled.
    """
    rows = df.select(node.cast("int").alias("node"), "g", "h", "bins", "zs")
    parts = rows.mapInArrow(_cells, "node int, feature int, bin int, g double, h double, gz double, hz double, hzz double, n long")
    return parts.groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in (*SUMS, "n")))


def _cells(batches):
    sums: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
        z = batch.column("zs").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        g, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "h"))
        nodes, node = np.unique(batch.column("node").to_numpy(zero_copy_only=False), return_inverse=True)
        z = np.where(bins >= 0, z, 0.0)  # a missing number has no z
        for f in range(bins.shape[1]):
            width = int(bins[:, f].max()) + 2
            at = node * width + bins[:, f] + 1
            some = np.flatnonzero(np.bincount(at))
            zf = z[:, f]
            found = np.stack([np.bincount(at, w)[some] for w in (g, h, g * zf, h * zf, h * zf * zf, None)], axis=1)
            for k, row in zip(some.tolist(), found):
                key = (int(nodes[k // width]), f, k % width - 1)
                sums[key] = sums[key] + row if key in sums else row
    if sums:
        keys, values = np.array(list(sums), np.int32), np.array(list(sums.values()))
        columns = [*keys.T, *values.T[:5], values[:, 5].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["node", "feature", "bin", *SUMS, "n"])


def split_table(hist: DataFrame, knots: int, penalty: float, min_rows: int, leaf_aware: bool) -> DataFrame:
    """All threshold candidates of a numeric feature, from its histogram rows.

    feature, t, default_left, gain, n_left, n_right. Left of threshold t are
    bins 0 to t; rows without a value go to either side in turn.
    """
    all_bins = hist.select("node", "feature").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(knots))))
    full = all_bins.join(hist.filter("bin >= 0"), ["node", "feature", "bin"], "left").fillna(0)
    gone = hist.filter("bin < 0").select("node", "feature", *(F.col(c).alias(f"m_{c}") for c in ("g", "h", "n")))
    full = full.join(F.broadcast(gone), ["node", "feature"], "left").fillna(0)
    whole = W.partitionBy("node", "feature")
    running = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    names = (*SUMS, "n")
    sums = full.select("node", "feature", F.col("bin").alias("t"), "m_g", "m_h", "m_n", *(F.sum(c).over(running).alias(f"l_{c}") for c in names), *(F.sum(c).over(whole).alias(f"t_{c}") for c in names))
    sums = sums.filter(F.col("t") < knots).withColumn("default_left", F.explode(F.array(F.lit(True), F.lit(False))))
    left = {c: F.col(f"l_{c}") for c in names}
    right = {c: F.col(f"t_{c}") - F.col(f"l_{c}") for c in names}
    for c in ("g", "h", "n"):
        left[c] = left[c] + F.when(F.col("default_left"), F.col(f"m_{c}")).otherwise(0)
        right[c] = right[c] + F.when(F.col("default_left"), F.lit(0)).otherwise(F.col(f"m_{c}"))
    parent = {c: F.col(f"t_{c}") + (F.col(f"m_{c}") if c in ("g", "h") else 0) for c in SUMS}

    def score(s: dict[str, Column]) -> Column:
        return score_linear(s["g"], s["h"], s["gz"], s["hz"], s["hzz"], penalty) if leaf_aware else score_const(s["g"], s["h"], penalty)

    out = sums.select("node", "feature", "t", "default_left", left["n"].alias("n_left"), right["n"].alias("n_right"), (score(left) + score(right) - score(parent)).alias("gain"))
    return out.filter((F.col("n_left") >= min_rows) & (F.col("n_right") >= min_rows))


def category_split_table(hist: DataFrame, penalty: float, min_rows: int) -> DataFrame:
    """All prefix candidates of a categorical feature, in the order of G / max(H, 1)."""
    order = F.col("g") / F.greatest(F.col("h"), F.lit(1.0))
    whole = W.partitionBy("node", "feature")
    running = whole.orderBy(order, "bin").rowsBetween(W.unboundedPreceding, 0)
    s = hist.select(
        "node", "feature", F.row_number().over(whole.orderBy(order, "bin")).alias("size"), F.count(F.lit(1)).over(whole).alias("codes"), F.collect_list("bin").over(running).alias("left_set"),
        *(F.sum(c).over(running).alias(f"l_{c}") for c in ("g", "h", "n")), *(F.sum(c).over(whole).alias(f"t_{c}") for c in ("g", "h", "n")),
    )
    gain = score_const(F.col("l_g"), F.col("l_h"), penalty) + score_const(F.col("t_g") - F.col("l_g"), F.col("t_h") - F.col("l_h"), penalty) - score_const(F.col("t_g"), F.col("t_h"), penalty)
    out = s.select("node", "feature", "size", "codes", "left_set", F.col("l_n").alias("n_left"), (F.col("t_n") - F.col("l_n")).alias("n_right"), gain.alias("gain"))
    return out.filter((F.col("size") < F.col("codes")) & (F.col("n_left") >= min_rows) & (F.col("n_right") >= min_rows))


# --------------------------------------------------------------- on the driver


@dataclass
class Split:
    """Where a node sends its rows."""

    feature: int
    gain: float
    default_left: bool
    threshold: float | None = None
    left_set: list[int] = field(default_factory=list)

    def goes_left(self, value: Column) -> Column:
        if self.threshold is None:
            return F.coalesce(value.isin(self.left_set), F.lit(self.default_left))
        return F.when(value.isNull(), F.lit(self.default_left)).otherwise(value < self.threshold)

    def value_goes_left(self, value) -> bool:
        if value is None:
            return self.default_left
        return value in self.left_set if self.threshold is None else value < self.threshold


def _scores(s: np.ndarray, penalty: float, leaf_aware: bool) -> np.ndarray:
    """s has the sums g, h, gz, hz, hzz in its last axis."""
    g, h, gz, hz, hzz = np.moveaxis(s[..., :5], -1, 0)
    const = g * g / (h + penalty)
    if not leaf_aware:
        return const
    a, d = h + penalty, hzz + penalty
    det = a * d - hz * hz
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(det <= FLAT, const, (d * g * g - 2 * hz * g * gz + a * gz * gz) / det)


def _best_numeric(rows: dict[int, np.ndarray], e: Encoder, config) -> tuple[float, dict] | None:
    k = len(e.knots)
    bins = np.array([rows.get(b, np.zeros(6)) for b in range(k + 1)])
    gone = rows.get(-1, np.zeros(6)).copy()
    gone[2:5] = 0
    left, total = np.cumsum(bins, axis=0)[:-1], bins.sum(axis=0)
    side = np.array([1.0, 0.0])[None, :, None]  # missing left first
    l = left[:, None, :] + side * gone
    r = (total - left)[:, None, :] + (1 - side) * gone
    aware = config.leaf_aware
    gain = (_scores(l, config.penalty, aware) + _scores(r, config.penalty, aware) - _scores(total + gone, config.penalty, aware)).astype(np.float32)
    able = (l[..., 5] >= config.min_leaf_rows) & (r[..., 5] >= config.min_leaf_rows)
    if not able.any():
        return None
    at = int(np.argmax(np.where(able, gain, -np.inf)))  # the first of equal gains
    t, side_ = divmod(at, 2)
    return float(gain.flat[at]), {"threshold": e.knots[t], "default_left": side_ == 0}


def _best_categorical(rows: dict[int, np.ndarray], config) -> tuple[float, dict] | None:
    if len(rows) < 2:
        return None
    order = sorted(rows, key=lambda c: (rows[c][0] / max(rows[c][1], 1.0), c))
    s = np.array([rows[c] for c in order])
    left, total = np.cumsum(s, axis=0)[:-1], s.sum(axis=0)
    right = total - left
    gain = (_scores(left, config.penalty, False) + _scores(right, config.penalty, False) - _scores(total, config.penalty, False)).astype(np.float32)
    able = (left[:, 5] >= config.min_leaf_rows) & (right[:, 5] >= config.min_leaf_rows)
    if not able.any():
        return None
    at = int(np.argmax(np.where(able, gain, -np.inf)))
    return float(gain[at]), {"left_set": order[: at + 1], "default_left": True}


def best_split(hist: dict[int, dict[int, np.ndarray]], encoders: Encoders, config) -> Split | None:
    """The best candidate over features; the first feature of equal gains."""
    best = None
    for i, e in enumerate(encoders):
        rows = hist.get(i, {})
        found = _best_categorical(rows, config) if e.kind is Kind.BOUNDED else _best_numeric(rows, e, config)
        if found and found[0] > 0 and (best is None or found[0] > best.gain):
            best = Split(feature=i, gain=found[0], **found[1])
    return best
