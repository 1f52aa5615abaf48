"""Encoders, splits, leaves, model and metrics: exact values, brute force, invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import hat_basis
from tessera.functions.linear import SymMatrix, cholesky_solve
from tessera.operators import encoders as E
from tessera.operators import leaves as L
from tessera.operators import metrics as M
from tessera.operators import splits as T
from tessera.operators.config import Config
from tessera.operators.gradients import base_score, with_gradients
from tessera.operators.model import Model, fit, hat, prepare, train
from tessera.sources import synthetic
from tessera.sources.frame import Kind, Schema, class_weights, ingest, raw_row, row_slice, temporal_split, with_row_numbers
from tessera.sources.staging import Stage

# ------------------------------------------------------------------ rows


def rows(spark, values, names="rid long, x double, label int, weight double"):
    return spark.createDataFrame(values, names)


def test_schema_and_ingest(spark):
    with pytest.raises(ValueError):
        Schema(["a"], [])
    with pytest.raises(ValueError):
        Schema(["a", "a"], [Kind.NUMERIC] * 2)
    schema = Schema(["x", "c"], [Kind.NUMERIC, Kind.BOUNDED])
    df = spark.createDataFrame([(1.0, -9, 1), (float("nan"), 4, 0), (None, None, 0)], "x double, c long, y int")
    got = [tuple(r) for r in ingest(df, schema, "y", missing_category=-9).collect()]
    assert got == [(1.0, None, 1, 1.0), (None, 4, 0, 1.0), (None, None, 0, 1.0)]
    for bad in (Schema(["c", "x"], [Kind.NUMERIC, Kind.HIGH_CARD]), Schema(["zz"], [Kind.NUMERIC])):
        with pytest.raises(ValueError):
            ingest(df, bad, "y")
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        ingest(df.withColumn("y", F.lit(2)), schema, "y").collect()


def test_row_numbers_split_and_slice(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("t"), F.lit(0).alias("x"))
    numbered = with_row_numbers(df, "t")
    assert sorted((r.rid, r.t) for r in numbered.collect()) == [(i, i) for i in range(1000)]
    head, tail = temporal_split(numbered, 0.8)
    assert (head.count(), tail.count()) == (800, 200)
    assert temporal_split(numbered, 1.5)[1].count() == 0
    assert {r.rid for r in row_slice(numbered, 3, 6).collect()} == {3, 4, 5}
    schema = Schema(["t"], [Kind.NUMERIC])
    assert raw_row(numbered, schema, 17) == {"t": 17} and raw_row(numbered, schema, 5000) is None
    assert with_row_numbers(df.limit(0), "t").count() == 0


def test_class_weights(spark):
    df = class_weights(rows(spark, [(0, 1.0, 1, 7.0), (1, 1.0, 0, 7.0)]), 4.0)
    assert sorted((r.label, r.weight) for r in df.collect()) == [(0, 1.0), (1, 4.0)]


# ------------------------------------------------------------------ generator


def test_generator_values():
    rng = synthetic.Rng(7)
    assert [rng.next_u64() for _ in range(3)] == [7575888327, 8070950887952051652, 13931920357059763743]
    for seed in (42, 43):
        rng = synthetic.Rng(seed)
        assert [rng.next_u64() for _ in range(2)] == [46537075435, 12685210767805585150]


def test_jumps_equal_steps():
    rng = synthetic.Rng(5)
    for _ in range(12345):
        rng.next_u64()
    x = synthetic._apply(synthetic.jump_matrix(12345), np.array([5], np.uint64))
    assert int(x[0]) == rng.state


def test_synthetic_table(spark):
    df = synthetic.make_synthetic(spark, 20_000, 42).repartition(7)
    n, pos = df.agg(F.count(F.lit(1)), F.sum("label")).first()
    assert n == 20_000 and abs(pos - 2690) <= 3
    for rid, label, num, bcat, hcat in (
        (0, 0, (-0.67185950, 1.81167042, -1.79104805), (4, 1, 2, 7), (4258, 3370, 4184, 2206, 1856)),
        (1, 0, (0.38755071, 1.37722576, -0.08472528), (0, 1, 6, 1), (1541, 3465, 1319, 2233, 4981)),
    ):
        r = df.filter(F.col("rid") == rid).first()
        assert r.label == label and np.allclose([r.num_0, r.num_1, r.num_2], num, atol=1e-6)
        assert (r.bcat_0, r.bcat_1, r.bcat_2, r.bcat_3) == bcat and (r.hcat_0, r.hcat_1, r.hcat_2, r.hcat_3, r.hcat_4) == hcat
    gone = df.agg(F.avg(F.col("num_3").isNull().cast("int")), F.avg(F.col("bcat_3").isNull().cast("int"))).first()
    assert 0.02 < gone[0] < 0.04 and 0.012 < gone[1] < 0.03


# ------------------------------------------------------------------ encoders


def brute_knots(xs, k):
    xs = sorted(x for x in xs if x is not None and math.isfinite(x))
    if not xs:
        return [0.0]
    return sorted({xs[math.floor(i / (k - 1) * (len(xs) - 1) + 0.5)] for i in range(k)})


def test_knots(spark):
    rng = np.random.default_rng(0)
    cases = {
        "a": [float(i) for i in range(10)],
        "b": [1.0] * 4 + [2.0] + [1.0] * 5,
        "c": [None] * 10,
        "d": [float("inf"), float("nan"), 3.0, -1.0, None, -float("inf"), 2.0, 2.0, 5.0, 5.0],
        "e": rng.normal(size=10).tolist(),
    }
    df = spark.createDataFrame(list(zip(*cases.values())), ", ".join(f"{c} double" for c in cases))
    for k in (2, 4, 16):
        got = E.quantile_knots(df, {c: F.col(c) for c in cases}, k)
        assert got == {c: brute_knots(xs, k) for c, xs in cases.items()}
    assert E.quantile_knots(df, {"a": F.col("a")}, 4)["a"] == [0.0, 3.0, 6.0, 9.0]
    sines = spark.range(1000).select(F.sin(F.col("id") * 0.01).alias("x"))
    got = E.quantile_knots(sines, {"x": F.col("x")}, 16)["x"]
    assert all(a < b for a, b in zip(got, got[1:]))


def entries(spark, x, knots, offset):
    row = spark.createDataFrame([(x,)], "x double").select(hat_basis(F.col("x"), knots, offset).alias("e")).first()
    return [(e.idx, e.val) for e in row.e]


def test_hat_basis(spark):
    assert entries(spark, 1.25, [0.0, 1.0, 2.0, 3.0], 0) == [(1, 0.75), (2, 0.25)]
    assert entries(spark, None, [0.0, 1.0, 2.0], 10) == [(13, 1.0)]
    assert entries(spark, -5.0, [0.0, 1.0], 3) == [(3, 1.0)] and entries(spark, 9.0, [0.0, 1.0], 3) == [(4, 1.0)]
    assert entries(spark, 1.0, [0.0, 1.0, 2.0], 0) == [(1, 1.0), (2, 0.0)]
    assert entries(spark, 7.0, [4.0], 2) == [(2, 1.0)] and entries(spark, None, [4.0], 2) == [(3, 1.0)]


def test_vectorised_and_local_basis_agree_with_the_expression(spark):
    knots = [-1.0, 0.5, 0.75, 2.0]
    xs = [None, -3.0, -1.0, 0.0, 0.5, 0.6, 1.9, 2.0, 4.0]
    for ks in (knots, [0.3]):
        x = np.array([np.nan if v is None else v for v in xs])
        dense = np.zeros((len(xs), 6))
        for slot, value in E.hats(x, ks, 1):
            dense[np.arange(len(xs)), slot] += value
        for i, v in enumerate(xs):
            for found in (entries(spark, v, ks, 1), hat(v, ks, 1)):
                own = np.zeros(6)
                for slot, value in found:
                    own[slot] += value
                assert np.allclose(own, dense[i])


def test_target_encoding(spark):
    df = rows(spark, [(i, 5, int(i < 3), 1.0) for i in range(5)] + [(9, None, 1, 1.0)], "rid long, c long, label int, weight double")
    assert [tuple(r) for r in E.target_encoding(df, "c", 20.0, 0.1).collect()] == [(5, pytest.approx(0.2), 5)]
    assert E.weighted_rate(df) == pytest.approx(4 / 6)
    assert E.weighted_rate(df.limit(0)) == 0.0


def test_unique_ids_get_the_prior(spark):
    df = rows(spark, [(i, i, i % 2, 1.0) for i in range(500)], "rid long, c long, label int, weight double")
    got = E.out_of_fold(df, "c", 0.0, 0.5, 5, "enc", "cnt").select("enc", "cnt").distinct().collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0)]


def test_out_of_fold_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(i, None if rng.random() < 0.1 else int(rng.integers(6)), int(rng.random() < 0.3), float(rng.integers(1, 4))) for i in range(300)]
    df = rows(spark, data, "rid long, c long, label int, weight double")
    got = {r.rid: (r.enc, r.cnt) for r in E.out_of_fold(df, "c", 3.0, 0.25, 4, "enc", "cnt").collect()}
    for rid, c, _, _ in data:
        other = [(y, w) for r, d, y, w in data if d == c and r % 4 != rid % 4] if c is not None else []
        enc = (sum(y * w for y, w in other) + 3.0 * 0.25) / (sum(w for _, w in other) + 3.0) if other else 0.25
        assert got[rid] == (pytest.approx(enc), pytest.approx(math.log1p(len(other))))


def test_vocabulary_and_codes(spark):
    df = rows(spark, [(0, "b", 0, 1.0), (1, None, 0, 1.0), (2, "a", 0, 1.0), (3, "b", 0, 1.0)], "rid long, c string, label int, weight double")
    assert sorted((r.id, r.code) for r in E.vocabulary(df, "c").collect()) == [(0, "b"), (1, "a")]
    probe = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    assert [r[0] for r in probe.select(E.code_id(F.col("c"), ["b", "a"])).collect()] == [1, 2, 3]
    assert [r[0] for r in probe.select(E.code_id(F.col("c"), [])).collect()] == [1, 0, 1]


def test_fit_layout_and_slots(spark):
    df = synthetic.make_synthetic(spark, 3000, 9)
    found, encoded = E.fit_encoders(df, synthetic.schema(), Config(), Stage(spark, "test"))
    top = encoded.select(F.explode(found.expand()).alias("e")).agg(F.max("e.idx"), F.min("e.idx")).first()
    assert 0 <= top[1] <= top[0] < found.size == sum(s for _, _, s in found.layout())
    scored = found.transform(df.limit(5)).select(F.size(found.expand()).alias("n")).collect()
    assert all(25 <= r.n <= 50 for r in scored)


# ------------------------------------------------------------------ splits


def direct_score(g, h, z, aware, penalty=1.0):
    G, H = g.sum(), h.sum()
    if not aware:
        return G * G / (H + penalty)
    gz, hz, hzz = (g * z).sum(), (h * z).sum(), (h * z * z).sum()
    det = (H + penalty) * (hzz + penalty) - hz * hz
    if det <= 1e-12:
        return G * G / (H + penalty)
    return np.array([G, gz]) @ np.linalg.solve([[H + penalty, hz], [hz, hzz + penalty]], [G, gz])


@pytest.mark.parametrize("aware", [False, True])
def test_numeric_splits_match_brute_force(spark, aware):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(1500) < 0.1, np.nan, rng.normal(size=1500))
    y = (rng.random(1500) < np.where(x > 0, 0.7, 0.1)).astype(int)
    data = [(i, None if np.isnan(a) else float(a), int(b), 1.0) for i, (a, b) in enumerate(zip(x, y))]
    df = rows(spark, data)
    config = Config(leaf_aware=aware, min_leaf_rows=20, knots=8)
    found, encoded = E.fit_encoders(df, Schema(["x"], [Kind.NUMERIC]), config, Stage(spark, "test"))
    _, p0 = base_score(df)
    hist = T.histogram(T.with_bins(with_gradients(encoded, p0), found), F.lit(0))
    knots = np.array(found[0].knots)
    g, h = p0 - y, np.full(len(y), p0 * (1 - p0))
    gone = np.isnan(x)
    z = np.where(gone, 0, np.clip((x - knots[0]) / (knots[-1] - knots[0]), 0, 1))
    expected = {}
    for t, k in enumerate(knots):
        for missing_left in (True, False):
            left = np.where(gone, missing_left, x < k)
            if min(left.sum(), (~left).sum()) >= 20:
                score = [direct_score(g[s], h[s], z[s], aware) for s in (left, ~left, np.ones(len(y), bool))]
                expected[t, missing_left] = score[0] + score[1] - score[2]
    table = {(r.t, r.default_left): r.gain for r in T.split_table(hist, len(knots), 1.0, 20, aware).collect()}
    assert table.keys() == expected.keys()
    assert all(table[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())
    local = {0: {r.bin: np.array([r.g, r.h, r.gz, r.hz, r.hzz, r.n], float) for r in hist.collect()}}
    best = T.best_split(local, found, config)
    assert best.gain == pytest.approx(max(expected.values()), rel=1e-5)


def test_categorical_split_and_ties():
    config = Config(min_leaf_rows=1)
    enc = [E.Encoder("c", Kind.BOUNDED, codes=[1, 2, 3]), E.Encoder("d", Kind.BOUNDED, codes=[1, 2, 3])]
    hist = {0: np.array([3.0, 2, 0, 0, 0, 5]), 1: np.array([-2.0, 0.5, 0, 0, 0, 5]), 2: np.array([0.5, 1, 0, 0, 0, 5])}
    best = T.best_split({0: hist, 1: hist}, enc, config)
    assert best.feature == 0 and best.left_set == [1] and best.default_left
    assert T.best_split({0: {0: hist[0]}}, enc, config) is None
    assert not best.value_goes_left(4) and best.value_goes_left(1)


def test_missing_goes_left_when_there_is_none():
    enc = [E.Encoder("x", Kind.NUMERIC, knots=[0.0, 1.0, 2.0])]
    hist = {b: np.array([(-1.0) ** (b > 1), 1, 0, 0, 0, 10]) for b in (1, 2, 3)}
    best = T.best_split({0: hist}, enc, Config(min_leaf_rows=1))
    assert best.default_left and best.threshold == 1.0 and best.value_goes_left(None)


def test_linear_score_by_hand(spark):
    from tessera.functions.columns import score_const, score_linear

    row = spark.range(1).select(score_const(F.lit(3.0), F.lit(2.0), 1.0), score_linear(F.lit(3.0), F.lit(2.0), F.lit(2.0), F.lit(1.0), F.lit(0.75), 1.0)).first()
    assert row[0] == 3.0 and row[1] == pytest.approx(63 / 17)


# ------------------------------------------------------------------ linear algebra and leaves


def test_solver():
    assert np.allclose(cholesky_solve([[4, 1], [1, 3]], [1, 2]), [1 / 11, 7 / 11])
    eye = SymMatrix(3)
    eye.add_diag(2.0)
    assert np.allclose(cholesky_solve(eye, [2, 4, 6]), [1, 2, 3]) and eye.get(0, 0) == 2.0
    assert cholesky_solve([[1, 2], [2, 1]], [1, 1]) is None
    assert cholesky_solve([[float("nan")]], [1]) is None


def test_leaf_equals_a_ridge_logistic_regression(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, 2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x))).astype(int)
    df = rows(spark, [(i, float(a), int(b), 1.0 + 2 * int(b)) for i, (a, b) in enumerate(zip(x, y))])
    config = Config(knots=5, irls_iters=25)
    found, encoded = E.fit_encoders(df, Schema(["x"], [Kind.NUMERIC]), config, Stage(spark, "test"))
    s0, _ = base_score(df)
    leaf = L.fit_leaves(encoded.withColumn("leaf", F.lit(0)), found, s0, config)[0]
    dense = F.transform(F.sequence(F.lit(0), F.lit(found.size - 2)), lambda i: F.aggregate(found.expand(), F.lit(0.0), lambda a, e: a + F.when(e["idx"] == i, e["val"]).otherwise(0.0)))
    total = df.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(weightCol="weight", regParam=1.0 / total, elasticNetParam=0, standardization=False, tol=1e-12, maxIter=500)
    fit = lr.fit(encoded.select(array_to_vector(dense).alias("features"), "label", "weight"))
    assert fit.intercept == pytest.approx(s0 + leaf.bias, abs=1e-3)
    assert np.allclose(fit.coefficients.toArray(), [leaf.weights[i] for i in range(5)], atol=1e-3)
    slots = L.active_slots(encoded.withColumn("leaf", F.lit(0)), found).first().slots
    assert sorted(leaf.weights) == slots == [0, 1, 2, 3, 4]  # no row lacks a number


def test_constant_leaf(spark):
    df = rows(spark, [(i, 0.0, int(i % 4 == 0), 1.0) for i in range(1000)]).withColumn("leaf", F.lit(0))
    r = L.leaf_rates(df, 0.0).first()
    assert L.sigmoid(r.bias) == pytest.approx(0.25) and r.n == 1000
    assert L.Leaf(1.0, {2: 3.0}).dot([(2, 0.5), (9, 7.0)]) == 2.5


# ------------------------------------------------------------------ model


@pytest.fixture(scope="module")
def fitted(spark):
    df = Stage(spark, "test").put(synthetic.make_synthetic(spark, 40_000, 7).repartition(4), "rows")
    head, tail = temporal_split(df, 0.75)
    return train(head, synthetic.schema(), Config()), head, tail


def test_model_beats_chance(fitted):
    model, _, tail = fitted
    scored = model.transform(tail)
    m = M.evaluate(scored).first()
    base = scored.agg(F.avg("label")).first()[0]
    assert m.pr_auc > 1.5 * base and m.roc_auc > 0.7 and m.lift_at_10 > 2.0


def test_leaves_cut_the_rows_once(fitted):
    model, head, _ = fitted
    assert 2 <= len(model.leaves) <= 16 and model.tree.leaves == len(model.leaves)
    assert sorted(n.leaf for n in model.tree.nodes if n.split is None) == list(range(len(model.leaves)))
    scored = model.transform(head)
    assert scored.count() == head.count() and scored.filter("leaf_id is null or score <= 0 or score >= 1").count() == 0


def test_scorers_agree_and_missing_rows_score(spark, fitted):
    model, _, tail = fitted
    first = tail.agg(F.min("rid")).first()[0]
    some = row_slice(tail, first, first + 300)
    local = model.local(some)
    assert all(len(local.codes[name]) <= 300 for name in model.encoders.tables)
    for r in model.transform(some).collect():
        assert local.predict(r.asDict()) == pytest.approx(r.score, abs=1e-9)
    odd = {f.name: (float("nan") if f.kind is Kind.NUMERIC else 10**9) for f in synthetic.schema()}
    odd["bcat_0"] = None
    assert 0 < local.predict(odd) < 1
    with pytest.raises(ValueError):
        local.predict({"num_0": "text"})
    took = M.single_row_latency(local, [odd] * 20)
    assert 0 < took["p50"] <= took["p99"] and M.single_row_latency(local, []) == {"p50": 0, "p99": 0, "mean": 0}


def test_model_is_kept_and_streams(spark, fitted, tmp_path):
    from tessera.streaming.scoring import score_stream

    model, _, tail = fitted
    model.save(spark, str(tmp_path / "model"))
    again = Model.load(spark, str(tmp_path / "model"))
    some = tail.limit(500)
    some.write.parquet(str(tmp_path / "in"))
    some = spark.read.parquet(str(tmp_path / "in"))
    expected = {r.rid: r.score for r in model.transform(some).collect()}
    assert {r.rid: r.score for r in again.transform(some).collect()} == pytest.approx(expected)
    stream = spark.readStream.schema(some.schema).parquet(str(tmp_path / "in"))
    score_stream(again, stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert {r.rid: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()} == pytest.approx(expected)


def test_one_leaf_and_one_class(spark):
    df = rows(spark, [(i, float(i), 1, 1.0) for i in range(30)])
    model = train(df, Schema(["x"], [Kind.NUMERIC]), Config(num_leaves=1))
    assert len(model.leaves) == 1
    assert model.transform(df).agg(F.min("score")).first()[0] > 0.99


# ------------------------------------------------------------------ metrics


def scored(spark, scores, labels):
    return spark.createDataFrame([(i, float(s) if s is not None else None, y) for i, (s, y) in enumerate(zip(scores, labels))], "rid long, score double, label int").repartition(3)


@pytest.mark.parametrize(
    ("scores", "labels", "roc", "ap"),
    [
        ([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0], 1.0, 1.0),
        ([0.1, 0.4, 0.35, 0.8, 0.4, 0.4], [0, 0, 1, 1, 1, 0], 2 / 3, 0.7),
        ([0.5] * 1000, [int(i % 5 == 0) for i in range(1000)], 0.5, 0.2),
        ([0.1, 0.2], [0, 0], 0.5, 0.0),
        ([0.1, 0.2], [1, 1], 0.5, 1.0),
        ([], [], 0.5, 0.0),
    ],
)
def test_ranking(spark, scores, labels, roc, ap):
    df = scored(spark, scores, labels)
    assert M.roc_auc(df).first()[0] == pytest.approx(roc) and M.pr_auc(df).first()[0] == pytest.approx(ap)


def brute_lift(scores, labels, share):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    k = min(max(math.floor(len(scores) * share + 0.5), 1), len(scores))
    return sum(labels[i] for i in order[:k]) / k / (sum(labels) / len(labels))


def test_lift(spark):
    labels = [1] * 100 + [0] * 900
    assert M.lift_at(scored(spark, [0.9] * 100 + [0.1] * 900, labels), 0.1).first()[0] == pytest.approx(10)
    rng = np.random.default_rng(1)
    scores, labels = np.round(rng.random(400), 1).tolist(), [int(x) for x in rng.random(400) < 0.3]
    for share in (0.001, 0.01, 0.1, 0.33, 1.0):
        assert M.lift_at(scored(spark, scores, labels), share).first()[0] == pytest.approx(brute_lift(scores, labels, share))
    assert M.lift_at(scored(spark, [], []), 0.1).first()[0] == 0.0
    assert M.lift_at(scored(spark, [0.3], [0]), 0.1).first()[0] == 0.0


def test_calibration(spark):
    df = scored(spark, [0.999999, 1e-6, None], [1, 0, 1])
    assert M.log_loss(df.filter("score is not null")).first()[0] < 1e-4
    got = [tuple(r) for r in M.reliability(scored(spark, [0.05, 0.15, 0.151, 1.0], [0, 1, 0, 1]), 10).orderBy("bin").collect()]
    assert got[0] == (0, 1, 0.05, 0.0) and got[1] == (1, 2, pytest.approx(0.1505), 0.5)
    assert got[9] == (9, 1, 1.0, 1.0) and got[5] == (5, 0, 0.0, 0.0) and len(got) == 10
    assert M.roc_auc(df).first()[0] == 1.0
    assert [r.rid for r in M.order_desc(scored(spark, [0.1, 0.5, 0.5], [0, 1, 0])).collect()] == [1, 2, 0]


# ------------------------------------------------------------------ quality on the synthetic table


@pytest.fixture(scope="module")
def compared(spark):
    """Average precision of three models on 60,000 rows, and the report of the first."""
    df = Stage(spark, "test").put(synthetic.make_synthetic(spark, 60_000, 99).repartition(4), "rows")
    head, tail = temporal_split(df, 0.75)
    ready = prepare(head, synthetic.schema(), Config())
    settings = {"linear": Config(), "constant": Config(linear_leaves=False), "aware": Config(num_leaves=8, leaf_aware=True)}
    return {name: M.evaluate(fit(ready, config).transform(tail)).first() for name, config in settings.items()}


def test_linear_leaves_rank_no_worse_than_constant_ones(compared):
    assert compared["linear"].pr_auc - compared["constant"].pr_auc >= -0.01


def test_half_the_leaves_do_with_leaf_aware_splits(compared):
    assert compared["aware"].pr_auc - compared["constant"].pr_auc > -0.05


def test_full_model_ranks_well(compared):
    assert compared["linear"].roc_auc > 0.70 and compared["linear"].lift_at_10 > 2.0


# ------------------------------------------------------------------ sizes


def test_order_statistics_narrow_down_to_the_values(spark, monkeypatch):
    monkeypatch.setattr(E, "BOUNDS", 4)
    monkeypatch.setattr(E, "MORE_BOUNDS", 2)
    monkeypatch.setattr(E, "COLLECTED", 20)
    rng = np.random.default_rng(6)
    data = [(float(x), float(y), int(w)) for x, y, w in zip(rng.normal(size=3000), rng.integers(0, 9, 3000), rng.integers(0, 4, 3000))]
    df = spark.createDataFrame(data, "x double, y double, w long").repartition(4)
    got = E.order_statistics(df, {"x": F.col("x"), "y": F.col("y")}, lambda n: E.knot_ranks(n, 16), F.col("w"))
    for k, name in enumerate("xy"):
        xs = sorted(x for row in data for x in [row[k]] * row[2])
        assert got[name] == sorted({xs[r] for r in E.knot_ranks(len(xs), 16)})


def test_large_vocabularies_are_joined(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(E, "LITERAL_CODES", 50)
    rng = np.random.default_rng(8)
    data = [(i, None if i % 97 == 0 else int(rng.integers(400)), float(i % 13), int(rng.random() < 0.2), 1.0) for i in range(4000)]
    df = rows(spark, data, "rid long, c long, x double, label int, weight double")
    schema = Schema(["c", "x"], [Kind.BOUNDED, Kind.NUMERIC])
    model = train(df, schema, Config(num_leaves=3, irls_iters=3))
    e = model.encoders[0]
    assert e.n_codes > 300 and not e.codes and model.encoders.tables["c"].count() == e.n_codes
    ids = {r.code: r.id for r in model.encoders.tables["c"].collect()}
    first = {}
    for rid, c, *_ in data:
        first.setdefault(c, rid)
    first.pop(None)
    assert [c for c, _ in sorted(first.items(), key=lambda x: x[1])] == sorted(ids, key=ids.get)
    probe = rows(spark, [(0, 10**9, 1.0, 0, 1.0), (1, None, 1.0, 0, 1.0), (2, data[1][1], 1.0, 0, 1.0)], "rid long, c long, x double, label int, weight double")
    model.save(spark, str(tmp_path / "model"))
    again, local = Model.load(spark, str(tmp_path / "model")), model.local(probe)
    for r in model.transform(probe).collect():
        assert local.predict(r.asDict()) == pytest.approx(r.score)
    assert {r.rid: r.score for r in again.transform(probe).collect()} == pytest.approx({r.rid: r.score for r in model.transform(probe).collect()})


def test_normal_equations_add_up_over_their_slots():
    rng = np.random.default_rng(1)
    x = rng.random((50, 6)) * (rng.random((50, 6)) < 0.3)
    whole = np.zeros((6, 6))
    total = None
    for lo in range(0, 50, 7):
        part = x[lo : lo + 7]
        slots = np.flatnonzero((part != 0).any(axis=0))
        own = L.Normal(slots, part[:, slots].T @ part[:, slots], part[:, slots].sum(axis=0))
        total = own if total is None else total + own
    whole[np.ix_(total.slots, total.slots)] = total.a
    assert np.allclose(whole, x.T @ x) and np.allclose(total.b, x.sum(axis=0)[total.slots])


def test_settings_share_what_they_have_in_common(spark, monkeypatch):
    from tessera.operators import growth
    from tessera.operators.model import fit_all

    df = rows(spark, [(i, float(i % 40), int(i % 40 > 30 or i % 7 == 0 and i % 40 > 10), 1.0) for i in range(4000)])
    ready = prepare(df, Schema(["x"], [Kind.NUMERIC]), Config())
    configs = [Config(num_leaves=k, linear_leaves=linear) for k, linear in ((2, True), (3, True), (60, True), (80, True), (3, False))]
    alone = [fit(ready, c) for c in configs]
    looks, passes = [], []
    seen, parts = growth.histogram, L._normal_parts
    monkeypatch.setattr(growth, "histogram", lambda *a: looks.append(1) or seen(*a))
    monkeypatch.setattr(L, "_normal_parts", lambda *a: passes.append(1) or parts(*a))
    fit(ready, configs[3])
    most = len(looks)
    looks.clear(), passes.clear()
    together = fit_all(ready, configs)
    assert len(looks) == most and len(passes) <= Config().irls_iters
    assert together[2] is together[3] and len(together[0].leaves) == 2
    for a, b in zip(alone, together):
        assert a.tree.nodes == b.tree.nodes
        for x, y in zip(a.leaves, b.leaves):
            assert x.bias == pytest.approx(y.bias, abs=1e-6) and x.weights == pytest.approx(y.weights, abs=1e-6)


def test_a_leaf_of_one_label_moves_its_intercept_only(spark, monkeypatch):
    df = rows(spark, [(i, float(i), int(i < 300), 1.0 + i % 3) for i in range(600)])
    found, encoded = E.fit_encoders(df, Schema(["x"], [Kind.NUMERIC]), Config(), Stage(spark, "test"))
    placed = encoded.withColumn("leaf", (F.col("rid") >= 300).cast("int"))
    monkeypatch.setattr(L, "_normal_parts", lambda *a: pytest.fail("a pass over rows"))
    for y, leaf in zip((1, 0), L.fit_leaves(placed, found, 0.3, Config())):
        x = np.ones((300, 5))  # Newton on an intercept and four slots that share it
        x[:, 1:] = np.random.default_rng(y).dirichlet(np.ones(4), 300)
        w = np.array([math.log((1 - 1e-6) / 1e-6) * (1 if y else -1) - 0.3, 0, 0, 0, 0])
        for _ in range(8):
            p = 1 / (1 + np.exp(-(0.3 + x @ w)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0, 1, 1, 1, 1]), x.T @ (p - y) + w * [0, 1, 1, 1, 1])
        assert leaf.bias == pytest.approx(w[0], rel=1e-6) and np.allclose(w[1:], 0, atol=1e-6) and not leaf.weights


def test_local_entries_are_those_of_many():
    for knots in ([-1.0, 0.5, 0.75, 2.0], [0.3], [0.0, 1e-300, 1.0]):
        for x in (None, float("nan"), -9.0, *knots, 0.1, 0.7499999, 1.5, 3, 1e300, float("inf"), float("-inf")):
            many = [(int(s[0]), float(w[0])) for s, w in E.hats(np.array([np.nan if x is None else x], float), knots, 4)]
            assert hat(x, knots, 4) == many


def test_scores_stay_between_0_and_1(spark):
    from tessera.operators.model import LocalScorer

    df = rows(spark, [(i, float(i), i % 2, 1.0) for i in range(100)])
    model = train(df, Schema(["x"], [Kind.NUMERIC]), Config(num_leaves=1))
    for bias in (50.0, -50.0, 900.0, -900.0):
        for weights in ({}, {0: 1e-9}):
            model.leaves[0] = L.Leaf(bias, weights)
            local = LocalScorer(model, {}).predict({"x": 1.0})
            assert 0 < local < 1
            for r in model.transform(df).collect():
                assert 0 < r.score < 1 and abs(r.score - local) < 1e-12


def test_a_step_that_overshoots_is_shortened(spark):
    """A rare label at one end: whole Newton steps grow without end."""
    n = 20_000
    df = rows(spark, [(i, float(i), float(i * 7919 % n), int(i >= n - n // 400), 1.0) for i in range(n)], "rid long, x double, z double, label int, weight double")
    config = Config(num_leaves=1)
    model = train(df, Schema(["x", "z"], [Kind.NUMERIC] * 2), config)
    found, local = model.transform(df).collect(), model.local(df)
    assert max(abs(local.predict(r.asDict()) - r.score) for r in found[::7] + found[-50:]) < 1e-12
    loss = -sum(math.log(r.score if r.label else 1 - r.score) for r in found) + config.penalty / 2 * sum(w * w for w in model.leaves[0].weights.values())
    share = (n // 400) / n
    assert loss < 0.4 * -n * (share * math.log(share) + (1 - share) * math.log(1 - share))


def test_shares_of_a_step_end_with_one_that_is_short_enough():
    found = E.Encoders(Schema(["a", "b"], [Kind.NUMERIC, Kind.BOUNDED]), [E.Encoder("a", Kind.NUMERIC, knots=[0.0, 1.0]), E.Encoder("b", Kind.BOUNDED, n_codes=1)], {})
    step = np.array([-1.0, 2.0, -5.0, 0.5, 0.0, 0.25, -3.0])
    assert L.reach(step, found) == 1 + 5 + 3
    assert L.judged(step, step / 9, found) is None
    for d in (2.0, 9.0, 1e6, 1e300):
        judged = L.judged(step, step / 9 * d, found)
        assert judged.shares[0] == 1 and judged.shares[-1] == 0 and (judged.shares[-2] <= math.log(1 + d) / d or len(judged.shares) == L.LEAST_SHARE + 2)
