"""Encoders: knots, vocabularies and out-of-fold target encodings.

Training rows get out-of-fold encodings; ``transform`` uses the maps of all
training rows. The two are separate paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.columns import ENTRY, bin_of, entry, hat_basis, ratio, znorm
from tessera.sources.frame import LABEL, RID, WEIGHT, Kind, Schema, round_half_away, with_row_numbers
from tessera.sources.staging import Stage

#: Vocabulary sizes up to which a dictionary is a literal in the plan; a larger one is joined.
LITERAL_CODES = 1_000
#: Values that the search for order statistics names per column, and then per range; and what it collects.
BOUNDS, MORE_BOUNDS, COLLECTED = 512, 64, 100_000


# --------------------------------------------------------------- knots


def knot_ranks(n: int, k: int) -> list[int]:
    """0-based ranks of the values that become knots."""
    k = max(k, 2)
    return [round_half_away(i / (k - 1) * (n - 1)) for i in range(k)] if n else []


def quantile_knots(df: DataFrame, columns: dict[str, Column], k: int, weight: Column | None = None) -> dict[str, list[float]]:
    """Knots of several columns: exact order statistics, with repeats left out.

    A column without values gets the knot 0.
    """
    found = order_statistics(df, columns, lambda n: knot_ranks(n, k), weight)
    return {name: xs or [0.0] for name, xs in found.items()}


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks_of: Callable[[int], list[int]], weight: Column | None = None) -> dict[str, list[float]]:
    """The distinct values at the 0-based ranks that ranks_of names for a column's count.

    A row counts ``weight`` times (a whole number). Null, NaN and infinite values
    are no values.

    Values are counted in passes and never shuffled. A sketch names BOUNDS values
    of each column; counts of what lies on and between them place the wanted
    ranks. Where a rank lies between, more bounds are named there, until what is
    left is at most COLLECTED values, which are counted and come to the driver.
    """
    if not columns:
        return {}
    names = list(columns)
    finite = [F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for x in (c.cast("double") for c in columns.values())]
    rows = df.select(*(x.alias(f"x{i}") for i, x in enumerate(finite)), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    one = rows.agg(*(f for i in range(len(names)) for f in (F.coalesce(F.sum(F.when(F.col(f"x{i}").isNotNull(), F.col("w"))), F.lit(0)), F.percentile_approx(f"x{i}", _shares(BOUNDS))))).first()
    wanted = [sorted(set(ranks_of(n))) if n else [] for n in one[::2]]
    bounds = [np.unique(xs or []) for xs in one[1::2]]
    while True:
        places = _placed(rows, bounds, wanted)
        between = sorted({(i, code) for i, found in enumerate(places) for code, _ in found if code % 2 == 0})
        size = sum(n for found in places for n in {code: n for code, (_, n) in found if code % 2 == 0}.values())
        inside = rows.mapInArrow(_between(bounds, between), "feature int, code int, x double, n long")
        if size <= COLLECTED:
            break
        for r in inside.groupBy("feature", "code").agg(F.percentile_approx("x", _shares(MORE_BOUNDS)).alias("xs")).collect():
            bounds[r.feature] = np.union1d(bounds[r.feature], r.xs)
    left: dict[tuple[int, int], list] = {}
    for r in inside.groupBy("feature", "code", "x").agg(F.sum("n").alias("n")).collect() if between else []:
        left.setdefault((r.feature, r.code), []).append((r.x, r.n))
    out = {}
    for i, (name, found) in enumerate(zip(names, places)):
        values = set()
        for code, (rank, _) in found:
            if code % 2:
                values.add(float(bounds[i][code // 2]))
            else:
                values.add(_at_rank(sorted(left[i, code]), rank))
        out[name] = sorted(values)
    return out


def _shares(n: int) -> list[float]:
    return [k / (n + 1) for k in range(1, n + 1)]


def _at_rank(counted: list[tuple[float, int]], rank: int) -> float:
    for x, n in counted:
        if rank < n:
            return x
        rank -= n
    raise AssertionError("a rank beyond all values")


def _codes(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 i + 1 for the bound i itself, 2 i for what lies below it and above the one before."""
    at = np.searchsorted(bounds, x)
    on = bounds[np.minimum(at, len(bounds) - 1)] == x if len(bounds) else np.zeros(len(x), bool)
    return 2 * at + on


def _known(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    x = numbers(batch.column(f"x{i}"))
    some = ~np.isnan(x)
    return x[some], batch.column("w").to_numpy(zero_copy_only=False)[some]


def _placed(rows: DataFrame, bounds: list[np.ndarray], wanted: list[list[int]]) -> list[list[tuple[int, tuple[int, int]]]]:
    """Per column and wanted rank: the code it falls in, with the rank there and the code's count."""

    def count(batches):
        sums = [np.zeros(2 * len(b) + 1) for b in bounds]
        for batch in batches:
            for i, b in enumerate(bounds):
                x, w = _known(batch, i)
                sums[i] += np.bincount(_codes(x, b), w, len(sums[i]))
        for i, own in enumerate(sums):
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(own[some].astype(np.int64))], names=["feature", "code", "n"])

    counts = [np.zeros(2 * len(b) + 1, np.int64) for b in bounds]
    for r in rows.mapInArrow(count, "feature int, code int, n long").groupBy("feature", "code").agg(F.sum("n").alias("n")).collect():
        counts[r.feature][r.code] = r.n
    out = []
    for ranks, own in zip(wanted, counts):
        ends = np.cumsum(own)
        codes = np.searchsorted(ends, ranks, side="right").tolist()
        out.append([(c, (r - int(ends[c] - own[c]), int(own[c]))) for c, r in zip(codes, ranks)])
    return out


def _between(bounds: list[np.ndarray], wanted: list[tuple[int, int]]):
    """The values with one of the wanted codes; a task's repeats of a value are one row."""
    of = [np.array([c for k, c in wanted if k == i], np.int64) for i in range(len(bounds))]

    def run(batches):
        for batch in batches:
            for i, b in enumerate(bounds):
                if not len(of[i]):
                    continue
                x, w = _known(batch, i)
                code = _codes(x, b)
                yes = np.isin(code, of[i])
                values, first, where = np.unique(x[yes], return_index=True, return_inverse=True)
                n = np.bincount(where, w[yes], len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(code[yes][first].astype(np.int32)), pa.array(values), pa.array(n)], names=["feature", "code", "x", "n"])

    return run


# --------------------------------------------------------------- rates and target encodings


def rate(df: DataFrame) -> Column:
    """The weighted share of label 1, as an aggregate; 0 without weight."""
    return ratio(F.sum(F.col(WEIGHT) * F.col(LABEL)), F.sum(WEIGHT), 0.0)


def weighted_rate(df: DataFrame) -> float:
    return df.agg(rate(df)).first()[0]


def target_encoding(df: DataFrame, code: str, alpha: float, prior: float) -> DataFrame:
    """code, enc, cnt: the smoothed rate and the rows of each code but null."""
    sums = df.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.sum(F.col(WEIGHT) * F.col(LABEL)).alias("wy"), F.sum(WEIGHT).alias("w"), F.count(F.lit(1)).alias("cnt"))
    return sums.select("code", ratio(F.col("wy") + alpha * prior, F.col("w") + alpha, prior).alias("enc"), "cnt")


def fold_encodings(df: DataFrame, code: str, alpha: float, prior: float, folds: int) -> DataFrame:
    """code, fold, enc, cnt: what rows of a fold get, from all other folds.

    One pass: sums per code and fold, then the code's total without its own
    fold. A code seen in one fold only has no rows left and gets the prior.
    """
    fold = F.pmod(F.col(RID), F.lit(max(folds, 2))).cast("int")
    sums = df.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code"), fold.alias("fold")).agg(F.sum(F.col(WEIGHT) * F.col(LABEL)).alias("wy"), F.sum(WEIGHT).alias("w"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("code")  # a row per fold
    left = {c: F.sum(c).over(whole) - F.col(c) for c in ("wy", "w", "n")}
    rest = sums.select("code", "fold", *(v.alias(c) for c, v in left.items()))
    enc = F.when(F.col("n") == 0, F.lit(prior)).otherwise(ratio(F.col("wy") + alpha * prior, F.col("w") + alpha, prior))
    return rest.select("code", "fold", enc.alias("enc"), F.col("n").alias("cnt"))


def out_of_fold(df: DataFrame, code: str, alpha: float, prior: float, folds: int, enc: str, cnt: str) -> DataFrame:
    """df with the out-of-fold encoding and ln(1 + count) of a category."""
    found = fold_encodings(df, code, alpha, prior, folds).select(F.col("code").alias("_code"), F.col("fold").alias("_fold"), F.col("enc").alias("_enc"), F.col("cnt").alias("_cnt"))
    fold = F.pmod(F.col(RID), F.lit(max(folds, 2))).cast("int")
    joined = df.join(found, (F.col(code) == F.col("_code")) & (fold == F.col("_fold")), "left")
    return joined.withColumn(enc, F.coalesce("_enc", F.lit(prior))).withColumn(cnt, F.log1p(F.coalesce("_cnt", F.lit(0)).cast("double"))).drop("_code", "_fold", "_enc", "_cnt")


def full_encoding(df: DataFrame, table: DataFrame, code: str, prior: float, enc: str, cnt: str) -> DataFrame:
    """df with the encoding from all training rows; null or unseen: prior and 0."""
    found = table.select(F.col("code").alias("_code"), F.col("enc").alias("_enc"), F.col("cnt").alias("_cnt"))
    joined = df.join(found, F.col(code) == F.col("_code"), "left")
    return joined.withColumn(enc, F.coalesce("_enc", F.lit(prior))).withColumn(cnt, F.log1p(F.coalesce("_cnt", F.lit(0)).cast("double"))).drop("_code", "_enc", "_cnt")


def encoding_knots(df: DataFrame, table: DataFrame, code: str, prior: float, k: int, enc: str, cnt: str) -> dict[str, list[float]]:
    """Knots of a category's encoding and ln(1 + count) over the rows of df.

    All rows of a code have one value, so the table of codes serves, each code
    counted as often as it has rows; rows without a code have the prior and 0.
    """
    bare = df.filter(F.col(code).isNull()).agg(F.lit(prior).alias("enc"), F.lit(0).cast("long").alias("cnt"), F.count(F.lit(1)).alias("n"))
    counted = table.select("enc", "cnt", F.col("cnt").alias("n")).unionByName(bare)
    return quantile_knots(counted, {enc: F.col("enc"), cnt: F.log1p(F.col("cnt").cast("double"))}, k, F.col("n"))


# --------------------------------------------------------------- vocabularies


def vocabulary(df: DataFrame, code: str) -> DataFrame:
    """code and id, numbered by first appearance; numbers are given by ranges, not in one task."""
    first = df.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.min(RID).alias("first"))
    return with_row_numbers(first, "first", "code", name="id").select("code", F.col("id").cast("int").alias("id"))


def joined_id(df: DataFrame, table: DataFrame, code: str, n: int, name: str) -> DataFrame:
    """df with the id of a code as ``code_id`` gives it, from a vocabulary of any size."""
    found = table.select(F.col("code").alias("_code"), F.col("id").alias("_id"))
    joined = df.join(found, F.col(code) == F.col("_code"), "left")
    return joined.withColumn(name, F.when(F.col(code).isNull(), F.lit(n)).otherwise(F.coalesce("_id", F.lit(n + 1)))).drop("_code", "_id")


def code_id(code: Column, codes: list) -> Column:
    """The id of a code: its place in the vocabulary; null: after it; unseen: after that."""
    n = len(codes)
    if not codes:
        return F.when(code.isNull(), F.lit(0)).otherwise(F.lit(1))
    pairs = [x for i, c in enumerate(codes) for x in (F.lit(c), F.lit(i))]
    known = F.try_element_at(F.create_map(*pairs), code)
    return F.when(code.isNull(), F.lit(n)).otherwise(F.coalesce(known, F.lit(n + 1)))


# --------------------------------------------------------------- fitted encoders


@dataclass
class Encoder:
    """What was learned of one feature, and its slots in the basis."""

    name: str
    kind: Kind
    offset: int = 0
    knots: list[float] = field(default_factory=list)
    codes: list = field(default_factory=list)  # empty where the vocabulary is a table
    n_codes: int = 0
    prior: float = 0.0
    count_knots: list[float] = field(default_factory=list)
    use_count: bool = False

    @property
    def size(self) -> int:
        if self.kind is Kind.BOUNDED:
            return self.n_codes + 2
        return len(self.knots) + 1 + (len(self.count_knots) + 1 if self.use_count else 0)

    @property
    def value(self) -> str:
        """The column that routes rows: number, code id or encoded rate."""
        return {Kind.NUMERIC: self.name, Kind.BOUNDED: f"{self.name}__id", Kind.HIGH_CARD: f"{self.name}__enc"}[self.kind]

    @property
    def count(self) -> str:
        return f"{self.name}__cnt"

    def basis(self) -> Column:
        """The feature's entries of the basis."""
        if self.kind is Kind.BOUNDED:
            return F.array(entry(F.col(self.value) + self.offset, 1.0))
        hats = hat_basis(F.col(self.value), self.knots, self.offset)
        if self.kind is Kind.HIGH_CARD and self.use_count:
            return F.concat(hats, hat_basis(F.col(self.count), self.count_knots, self.offset + len(self.knots) + 1))
        return hats

    def bins(self) -> Column:
        """The histogram bin of the routing value; -1 for missing numbers."""
        return F.col(self.value) if self.kind is Kind.BOUNDED else bin_of(F.col(self.value), self.knots)

    def z(self) -> Column:
        return F.lit(0.0) if self.kind is Kind.BOUNDED else znorm(F.col(self.value), self.knots)

    def entries(self, values: np.ndarray, counts: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The basis of many rows as (slots, weights) pairs; a slot may come twice."""
        if self.kind is Kind.BOUNDED:
            yield values.astype(np.int64) + self.offset, np.ones(len(values))
            return
        yield from hats(values, self.knots, self.offset)
        if self.kind is Kind.HIGH_CARD and self.use_count:
            yield from hats(counts, self.count_knots, self.offset + len(self.knots) + 1)


def hats(x: np.ndarray, knots: list[float], offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """hat_basis for many numbers; NaN is missing."""
    at, n = np.array(knots), len(knots)
    j = np.clip(np.searchsorted(at, x, side="right") - 1, 0, max(n - 2, 0))
    after = np.minimum(j + 1, n - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        t = np.clip(np.where(after > j, (x - at[j]) / (at[after] - at[j]), 0.0), 0, 1)
    gone = np.isnan(x)
    yield np.where(gone, n, j) + offset, np.where(gone, 1.0, 1 - t)
    yield np.where(gone, n, after) + offset, np.where(gone, 0.0, t)


def present(x: np.ndarray, knots: list[float]) -> Iterator[np.ndarray]:
    """Which of the two pairs of ``hats`` are entries of hat_basis, zeros between knots included."""
    inner = (x > knots[0]) & (len(knots) > 1)  # false for NaN
    yield ~inner | (x < knots[-1])
    yield inner


def numbers(column: pa.Array) -> np.ndarray:
    """A column as doubles; null is NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


class Encoders:
    """Fitted encoders in feature order, and the tables of codes: rates, or ids of large vocabularies."""

    def __init__(self, schema: Schema, encoders: list[Encoder], tables: dict[str, DataFrame]):
        self.schema, self.encoders, self.tables = schema, encoders, tables
        at = 0
        for e in encoders:
            e.offset = at
            at += e.size
        self.size = at

    def __iter__(self):
        return iter(self.encoders)

    def __getitem__(self, i: int) -> Encoder:
        return self.encoders[i]

    @property
    def values(self) -> list[str]:
        """The columns that transform adds or uses."""
        counts = [e.count for e in self.encoders if e.kind is Kind.HIGH_CARD]
        return [*(e.value for e in self.encoders), *counts]

    def layout(self) -> list[tuple[str, int, int]]:
        return [(e.name, e.offset, e.size) for e in self.encoders]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a routing column per feature, from the maps of all training rows."""
        for e in self.encoders:
            if e.kind is Kind.BOUNDED and e.name in self.tables:
                df = joined_id(df, self.tables[e.name], e.name, e.n_codes, e.value)
            elif e.kind is Kind.BOUNDED:
                df = df.withColumn(e.value, code_id(F.col(e.name), e.codes))
            elif e.kind is Kind.HIGH_CARD:
                df = full_encoding(df, self.tables[e.name], e.name, e.prior, e.value, e.count)
        return df

    def expand(self) -> Column:
        """The sparse basis row: (slot, value) entries over all features."""
        return F.concat(*(e.basis() for e in self.encoders)).cast(ENTRY) if self.encoders else F.array().cast(ENTRY)

    def expanded(self, df: DataFrame) -> DataFrame:
        """rid, idx, val: the entries of ``expand`` as rows, for transformed rows.

        A vectorised map, since the expression of many features outgrows the
        limits of generated code.
        """
        bare = Encoders(self.schema, self.encoders, {})

        def run(batches):
            for batch in batches:
                rid, out = batch.column(RID).to_numpy(zero_copy_only=False), []
                for e in bare:
                    x = numbers(batch.column(e.value))
                    if e.kind is Kind.BOUNDED:
                        out.append((rid, x.astype(np.int64) + e.offset, np.ones(len(x))))
                        continue
                    bases = [(x, e.knots, e.offset)]
                    if e.kind is Kind.HIGH_CARD and e.use_count:
                        bases.append((numbers(batch.column(e.count)), e.count_knots, e.offset + len(e.knots) + 1))
                    for basis in bases:
                        for (slot, weight), there in zip(hats(*basis), present(*basis[:2])):
                            out.append((rid[there], slot[there], weight[there]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2])], names=[RID, "idx", "val"])

        return df.select(RID, *dict.fromkeys(self.values)).mapInArrow(run, f"{RID} long, idx int, val double")


def fit_encoders(train: DataFrame, schema: Schema, config, stage: Stage) -> tuple[Encoders, DataFrame]:
    """Encoders, and the training rows with routing columns (out-of-fold)."""
    prior = weighted_rate(train)
    tables, oof, knots = {}, train, {}
    for name in schema.of(Kind.HIGH_CARD):
        tables[name] = stage.put(target_encoding(train, name, config.alpha, prior), f"codes-{name}")
        oof = out_of_fold(oof, name, config.alpha, prior, config.n_folds, f"{name}__enc", f"{name}__cnt")
        knots |= encoding_knots(train, tables[name], name, prior, config.hc_knots, f"{name}__enc", f"{name}__cnt")
    knots |= quantile_knots(train, {n: F.col(n) for n in schema.of(Kind.NUMERIC)}, config.knots)
    encoders = []
    for f in schema:
        if f.kind is Kind.NUMERIC:
            encoders.append(Encoder(f.name, f.kind, knots=knots[f.name]))
        elif f.kind is Kind.BOUNDED:
            found = stage.put(vocabulary(train, f.name), f"vocabulary-{f.name}")
            n, codes = found.count(), []
            if n > LITERAL_CODES:
                tables[f.name] = found
                oof = joined_id(oof, found, f.name, n, f"{f.name}__id")
            else:
                codes = [r.code for r in found.orderBy("id").collect()]
                oof = oof.withColumn(f"{f.name}__id", code_id(F.col(f.name), codes))
            encoders.append(Encoder(f.name, f.kind, codes=codes, n_codes=n))
        else:
            encoders.append(Encoder(f.name, f.kind, knots=knots[f"{f.name}__enc"], count_knots=knots[f"{f.name}__cnt"], prior=prior, use_count=config.hc_use_count))
    return Encoders(schema, encoders, tables), stage.put(oof, "encoded")
