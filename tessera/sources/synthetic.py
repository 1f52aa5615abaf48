"""A generated benchmark table, the same for any partitioning.

A 64-bit xorshift generator drives it. A step is linear over bits, so any number
of steps is one 64 x 64 bit matrix: each task jumps to its first row, and rows
advance side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.frame import LABEL, RID, WEIGHT, Kind, Schema

N_NUMERIC, N_BOUNDED, N_HIGH = 10, 10, 5
VOCABULARY, IDS = 8, 5000
PER_NORMAL = 6
PER_ROW = N_NUMERIC * PER_NORMAL + N_BOUNDED + N_HIGH + 1 + N_NUMERIC + N_BOUNDED
ALL = (1 << 64) - 1


class Rng:
    """xorshift64 with shifts 13, 7 and 17; the seed's lowest bit is set."""

    def __init__(self, seed: int):
        self.state = (seed | 1) & ALL

    def next_u64(self) -> int:
        x = self.state
        x ^= (x << 13) & ALL
        x ^= x >> 7
        x ^= (x << 17) & ALL
        self.state = x
        return x

    def next_uniform(self) -> np.float32:
        return np.float32(self.next_u64() >> 40) / np.float32(1 << 24)

    def next_normal(self) -> np.float32:
        total = np.float32(0)
        for _ in range(PER_NORMAL):
            total += self.next_uniform()
        return (total - np.float32(3)) * np.float32(2**0.5)

    def below(self, n: int) -> int:
        return self.next_u64() % n


def _advance(x: np.ndarray) -> np.ndarray:
    # fixed values: the shifts of the generator
    x = x ^ (x << np.uint64(13))
    x = x ^ (x >> np.uint64(7))
    return x ^ (x << np.uint64(17))


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix's columns for the bits that are set, added up without carry."""
    out = np.zeros_like(x)
    for bit in range(64):
        out ^= matrix[bit] * ((x >> np.uint64(bit)) & np.uint64(1))
    return out


def jump_matrix(steps: int) -> np.ndarray:
    """Column b is where bit b goes in that many steps."""
    out = np.uint64(1) << np.arange(64, dtype=np.uint64)
    square = _advance(out)
    while steps:
        if steps & 1:
            out = _apply(square, out)
        square = _apply(square, square)
        steps >>= 1
    return out


def row_states(seed: int, first: int, n: int) -> np.ndarray:
    """Generator states before the draws of rows first, first + 1, ..."""
    start = np.array([(seed | 1) & ALL], np.uint64)
    states = _apply(jump_matrix(IDS * PER_NORMAL + PER_ROW * first), start)
    while len(states) < n:
        states = np.concatenate([states, _apply(jump_matrix(PER_ROW * len(states)), states)])
    return states[:n]


def draws(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """i and uniform: the generator's first n numbers of [0, 1), each task from its own place."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            states = _apply(jump_matrix(int(ids[0]) + 1), np.array([(seed | 1) & ALL], np.uint64))
            while len(states) < len(ids):  # a range's batch has successive ids
                states = np.concatenate([states, _apply(jump_matrix(len(states)), states)])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((states[: len(ids)] >> np.uint64(40)).astype(float) / (1 << 24))], names=["i", "uniform"])

    return spark.range(n).mapInArrow(run, "i long, uniform double")


def schema() -> Schema:
    names = [f"num_{i}" for i in range(N_NUMERIC)] + [f"bcat_{i}" for i in range(N_BOUNDED)] + [f"hcat_{i}" for i in range(N_HIGH)]
    return Schema(names, [Kind.NUMERIC] * N_NUMERIC + [Kind.BOUNDED] * N_BOUNDED + [Kind.HIGH_CARD] * N_HIGH)


def _risks(seed: int) -> np.ndarray:
    rng = Rng(seed)
    return np.array([rng.next_normal() * np.float32(0.9) for _ in range(IDS)], np.float32)


def make_rows(seed: int, first: int, n: int, risks: np.ndarray) -> dict[str, np.ndarray | list]:
    f32 = np.float32
    state = row_states(seed, first, n)

    def draw() -> np.ndarray:
        nonlocal state
        state = _advance(state)
        return state

    def uniform() -> np.ndarray:
        return (draw() >> np.uint64(40)).astype(f32) / f32(1 << 24)

    def normal() -> np.ndarray:
        total = np.zeros(n, f32)
        for _ in range(PER_NORMAL):
            total += uniform()
        return (total - f32(3)) * f32(2**0.5)

    # fixed values: the order of draws, and the coefficients of the log-odds
    num = [normal() for _ in range(N_NUMERIC)]
    bounded = [(draw() % np.uint64(VOCABULARY)).astype(np.int64) for _ in range(N_BOUNDED)]
    high = [(draw() % np.uint64(IDS)).astype(np.int64) for _ in range(N_HIGH)]
    s = np.full(n, f32(-3.2))
    s += f32(0.8) * (num[0] * num[0] - f32(1))
    s += f32(1.1) * num[1] * np.where(bounded[0] % 2 == 0, f32(1), f32(-1))
    s += f32(0.6) * num[2]
    s += np.where(bounded[1] < 2, f32(1.3), f32(0))
    s += risks[high[0]]
    label = uniform() < f32(1) / (f32(1) + np.exp(-s))
    out: dict = {RID: np.arange(first, first + n)}
    for i, v in enumerate(num):
        out[f"num_{i}"] = (v.astype(float), uniform() < f32(0.03))
    for i, v in enumerate(bounded):
        out[f"bcat_{i}"] = (v, uniform() < f32(0.02))
    for i, v in enumerate(high):
        out[f"hcat_{i}"] = v
    out[LABEL], out[WEIGHT] = label.astype(np.int32), np.ones(n)
    return out


def make_synthetic(spark: SparkSession, n_rows: int, seed: int) -> DataFrame:
    """rid, 25 features, label and unit weights."""
    types = {Kind.NUMERIC: "double", Kind.BOUNDED: "long", Kind.HIGH_CARD: "long"}
    columns = ", ".join(f"{f.name} {types[f.kind]}" for f in schema())

    def run(batches):
        risks = _risks(seed)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            rows = make_rows(seed, int(ids[0]), len(ids), risks)  # a range's batch has successive ids
            arrays = [pa.array(v[0], mask=v[1]) if isinstance(v, tuple) else pa.array(v) for v in rows.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=list(rows))

    return spark.range(n_rows).mapInArrow(run, f"{RID} long, {columns}, {LABEL} int, {WEIGHT} double")
