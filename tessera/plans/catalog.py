"""Named queries over the driver's tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import hat_basis, score_const, score_linear
from tessera.operators import encoders as E
from tessera.operators import gradients as G
from tessera.operators import leaves as L
from tessera.operators import metrics as M
from tessera.operators import splits as T
from tessera.operators.config import Config
from tessera.operators.model import LocalScorer, Model, train
from tessera.plans import experiments, oracle
from tessera.sources import synthetic
from tessera.sources.frame import LABEL, RID, WEIGHT, Kind, Schema, class_weights, ingest, row_slice, temporal_split, with_row_numbers
from tessera.sources.staging import Stage

SCHEMA = Schema(["qty", "price", "disc", "tax", "flagstat", "ok3", "part", "supp"], [Kind.NUMERIC] * 4 + [Kind.BOUNDED] * 2 + [Kind.HIGH_CARD] * 2)
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
TRAIN_SHARE = 0.75

_frames: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def _there(spark: SparkSession, rows: DataFrame) -> bool:
    """Whether the files of a written table still are."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    paths = [hadoop.Path(f) for f in rows.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths[:1])


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows of lineitem as a modelling table, and its split; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _frames or not _there(spark, _frames[key][0]):
        items = with_row_numbers(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), *ORDER)
        raw = items.select(
            RID, F.col("l_quantity").alias("qty"), F.when(F.col("l_orderkey") % 31 != 0, F.col("l_extendedprice")).alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
            F.concat("l_returnflag", "l_linestatus").alias("flagstat"), (F.col("l_orderkey") % 3).alias("ok3"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
            (((F.col("l_quantity") > 30) & (F.col("l_orderkey") % 3 == 0)) | (F.col("l_partkey") % 17 == 3)).alias("y"),
        )
        rows = Stage(spark, "frame").put(ingest(raw, SCHEMA, "y", keep=(RID,)), "rows")
        _frames[key] = (rows, *temporal_split(rows, TRAIN_SHARE))
    return _frames[key]


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)[1]


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)[2]


# --------------------------------------------------------------- rows


def temporal_split_counts(spark, sf_dir):
    one = [df.agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos")).select(F.lit(name).alias("part"), "n", "pos") for name, df in zip(("train", "valid"), tables(spark, sf_dir)[1:])]
    return one[0].unionByName(one[1])


def class_weights_(spark, sf_dir):
    return class_weights(_training(spark, sf_dir), 3.0).groupBy(LABEL, WEIGHT).agg(F.count(F.lit(1)).alias("n"))


def row_slice_(spark, sf_dir):
    return row_slice(tables(spark, sf_dir)[0], 100, 400).select(RID, "qty", "price", "flagstat", "ok3", "part", "supp", LABEL)


# --------------------------------------------------------------- encoders


def _knot_rows(spark, knots: dict[str, list[float]]) -> DataFrame:
    return spark.createDataFrame([(f, i, x) for f, xs in knots.items() for i, x in enumerate(xs)], "feature string, i int, knot double")


def _price_knots(spark, sf_dir) -> list[float]:
    return E.quantile_knots(_training(spark, sf_dir), {"price": F.col("price")}, 16)["price"]


def quantile_knots_numeric(spark, sf_dir):
    return _knot_rows(spark, E.quantile_knots(_training(spark, sf_dir), {n: F.col(n) for n in SCHEMA.of(Kind.NUMERIC)}, 16))


def quantile_knots_highcard(spark, sf_dir):
    rows = _training(spark, sf_dir)
    prior, found = E.weighted_rate(rows), {}
    for code in SCHEMA.of(Kind.HIGH_CARD):
        found |= E.encoding_knots(rows, E.target_encoding(rows, code, 20.0, prior), code, prior, 16, f"{code}_enc", f"{code}_cnt")
    return _knot_rows(spark, found).withColumn("knot", F.round("knot", 8))


def weighted_rate(spark, sf_dir):
    rows = class_weights(_training(spark, sf_dir), 3.0)
    return rows.agg(F.round(E.rate(rows), 10).alias("rate"))


def target_encoding(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return E.target_encoding(rows, "part", 20.0, E.weighted_rate(rows)).select("code", F.round("enc", 8).alias("enc"), "cnt")


def target_encoding_oof(spark, sf_dir):
    rows = _training(spark, sf_dir)
    out = E.out_of_fold(rows, "part", 20.0, E.weighted_rate(rows), 5, "enc", "cnt")
    return out.select(RID, F.round("enc", 8).alias("enc"), F.round("cnt", 8).alias("cnt"))


def target_encoding_unique_ids(spark, sf_dir):
    rows = _training(spark, sf_dir)
    out = E.out_of_fold(rows.withColumn("own", F.col(RID)), "own", 0.0, E.weighted_rate(rows), 5, "enc", "cnt")
    return out.groupBy(F.round("enc", 8).alias("enc"), "cnt").agg(F.count(F.lit(1)).alias("n"))


def _probe(column: str, unseen: Column) -> Column:
    return F.when(F.col(RID) % 7 == 0, F.lit(None)).when(F.col(RID) % 11 == 0, unseen).otherwise(F.col(column))


def target_encode_unseen(spark, sf_dir):
    rows = _training(spark, sf_dir)
    prior = E.weighted_rate(rows)
    probe = _valid(spark, sf_dir).select(RID, _probe("part", -F.col("part")).alias("part"))
    out = E.full_encoding(probe, E.target_encoding(rows, "part", 20.0, prior), "part", prior, "enc", "cnt")
    return out.select(RID, F.round("enc", 8).alias("enc"), F.round("cnt", 8).alias("cnt"))


def vocab_first_seen(spark, sf_dir):
    return E.vocabulary(_training(spark, sf_dir), "flagstat")


def _coded(spark, sf_dir) -> DataFrame:
    codes = [r.code for r in E.vocabulary(_training(spark, sf_dir), "flagstat").orderBy("id").collect()]
    return _valid(spark, sf_dir).select(RID, E.code_id(_probe("flagstat", F.lit("??")), codes).alias("id"))


def bounded_codes_valid(spark, sf_dir):
    return _coded(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def numeric_basis(spark, sf_dir):
    hats = hat_basis(F.col("price"), _price_knots(spark, sf_dir), 0)
    return _valid(spark, sf_dir).select(RID, F.inline(hats)).withColumn("val", F.round("val", 8))


def onehot_basis(spark, sf_dir):
    return _coded(spark, sf_dir).select(RID, F.col("id").alias("idx"), F.lit(1.0).alias("val"))


def _encoders(spark, sf_dir, schema: Schema = SCHEMA) -> E.Encoders:
    return E.fit_encoders(_training(spark, sf_dir), schema, Config(), Stage(spark, "catalog"))[0]


def basis_layout(spark, sf_dir):
    return spark.createDataFrame(_encoders(spark, sf_dir).layout(), "feature string, first_slot int, slots int")


def basis_expand_row(spark, sf_dir):
    """The basis of all validation rows over all features."""
    found = _encoders(spark, sf_dir)
    return found.expanded(found.transform(_valid(spark, sf_dir))).withColumn("val", F.round("val", 6))


# --------------------------------------------------------------- gradients and splits


def base_score(spark, sf_dir):
    return G.base_score_table(_training(spark, sf_dir)).select(F.round("p0", 10).alias("p0"), F.round("s0", 10).alias("s0"))


def grad_hess(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return G.with_gradients(rows, G.base_score(rows)[1]).groupBy(LABEL, F.round("g", 10).alias("g"), F.round("h", 10).alias("h")).agg(F.count(F.lit(1)).alias("n"))


def _root_histogram(spark, sf_dir, name: str, kind: Kind = Kind.NUMERIC) -> tuple[DataFrame, E.Encoders]:
    rows = _training(spark, sf_dir)
    found = _encoders(spark, sf_dir, Schema([name], [kind]))
    binned = T.with_bins(G.with_gradients(found.transform(rows), G.base_score(rows)[1]), found)
    return T.histogram(binned, F.lit(0)), found


def hist_numeric(spark, sf_dir):
    hist, _ = _root_histogram(spark, sf_dir, "price")
    return hist.select("bin", *(F.round(c, 4).alias(c) for c in T.SUMS), "n")


def _candidates(spark, sf_dir, name: str, aware: bool) -> tuple[DataFrame, list[float]]:
    hist, found = _root_histogram(spark, sf_dir, name)
    return T.split_table(hist, len(found[0].knots), 1.0, 50, aware), found[0].knots


def split_numeric_const(spark, sf_dir):
    return _candidates(spark, sf_dir, "price", False)[0].select("t", "default_left", "n_left", "n_right", F.round("gain", 4).alias("gain"))


def split_numeric_leafaware(spark, sf_dir):
    return _candidates(spark, sf_dir, "price", True)[0].select("t", "default_left", "n_left", "n_right", F.round("gain", 4).alias("gain"))


def split_categorical(spark, sf_dir):
    hist, _ = _root_histogram(spark, sf_dir, "flagstat", Kind.BOUNDED)
    out = T.category_split_table(hist, 1.0, 50)
    return out.select("size", F.concat_ws(",", F.transform("left_set", lambda x: x.cast("string"))).alias("left_set"), "n_left", "n_right", F.round("gain", 4).alias("gain"))


def parent_scores(spark, sf_dir):
    hist, _ = _root_histogram(spark, sf_dir, "price")
    s = hist.agg(*(F.sum(c).alias(c) for c in T.SUMS))
    g, h, gz, hz, hzz = (F.col(c) for c in T.SUMS)
    return s.select(F.round(score_const(g, h, 1.0), 4).alias("constant_score"), F.round(score_linear(g, h, gz, hz, hzz, 1.0), 4).alias("aware_score"))


def _best_row(spark, sf_dir) -> DataFrame:
    table, knots = _candidates(spark, sf_dir, "qty", False)
    best = table.withColumn("gain", F.round("gain", 4)).orderBy(F.desc("gain"), "t", F.desc("default_left")).limit(1)
    return best.select(F.element_at(F.array(*(F.lit(k) for k in knots)), F.col("t") + 1).alias("threshold"), "default_left", "gain")


def best_split_root(spark, sf_dir):
    return _best_row(spark, sf_dir)


def _stump(spark, sf_dir) -> Model:
    schema = Schema(["qty"], [Kind.NUMERIC])
    return train(_training(spark, sf_dir), schema, Config(num_leaves=2, linear_leaves=False))


def stump_partition(spark, sf_dir):
    model = _stump(spark, sf_dir)
    split = model.tree.nodes[0].split
    rows = _training(spark, sf_dir)
    return rows.groupBy(split.goes_left(F.col("qty")).alias("goes_left")).agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos"))


def stump_predict_constant_leaf(spark, sf_dir):
    return _stump(spark, sf_dir).transform(_valid(spark, sf_dir)).select(RID, F.round("score", 8).alias("score"))


# --------------------------------------------------------------- leaves and models


def irls_one_feature(spark, sf_dir):
    rows = _training(spark, sf_dir)
    schema = Schema(["qty"], [Kind.NUMERIC])
    found, _ = E.fit_encoders(rows, schema, Config(knots=2), Stage(spark, "catalog"))
    s0, _ = G.base_score(rows)
    leaf = L.fit_leaves(rows.withColumn("leaf", F.lit(0)), found, s0, Config())[0]
    return spark.createDataFrame([tuple(round(x, 6) for x in (leaf.bias, leaf.weights.get(0, 0.0), leaf.weights.get(1, 0.0)))], "bias double, w_low double, w_high double")


_models: dict[tuple, Model] = {}


def _model(spark, sf_dir) -> Model:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models or not all(_there(spark, t) for t in _models[key].encoders.tables.values()):
        _models[key] = train(_training(spark, sf_dir), SCHEMA, Config())
    return _models[key]


def tree_nodes(spark, sf_dir):
    return _node_rows(spark, _model(spark, sf_dir))


def _node_rows(spark, model: Model) -> DataFrame:
    rows = []
    for i, n in enumerate(model.tree.nodes):
        s = n.split
        rows.append((i, model.encoders[s.feature].name if s else None, s.threshold if s else None, ",".join(map(str, s.left_set)) if s and s.threshold is None else None, s.default_left if s else None, n.left, n.right, n.leaf))
    return spark.createDataFrame(rows, "node int, feature string, threshold double, left_set string, default_left boolean, left_child int, right_child int, leaf_id int")


def tree_leaf_counts(spark, sf_dir):
    return _leaf_counts(_model(spark, sf_dir).transform(_training(spark, sf_dir)))


def _leaf_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos"))


def linear_leaf_predict(spark, sf_dir):
    return _model(spark, sf_dir).transform(_valid(spark, sf_dir)).select(RID, "leaf_id", F.round("score", 6).alias("score"))


def unseen_row_predict(spark, sf_dir):
    odd = spark.createDataFrame([(0, None, None, None, None, "??", -5, -1, -1), (1, None, 1.0, None, 0.5, None, None, None, None)], "rid long, qty double, price double, disc double, tax double, flagstat string, ok3 long, part long, supp long")
    return _model(spark, sf_dir).transform(odd).select(RID, "leaf_id", F.round("score", 6).alias("score"))


def _predict(model: Model, names: list[str]):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            codes = {name: {r[name]: tuple(r[f"{name}__known"].values()) for r in rows if r[f"{name}__known"]} for name in names}
            local = LocalScorer(model, codes)
            yield pa.RecordBatch.from_arrays([pa.array([local.predict(r) for r in rows], pa.float64()), batch.column("score")], names=["local", "score"])

    return run


def scorer_paths_agree(spark, sf_dir):
    """Whether the local scorer and transform agree on all validation rows; tasks run the local scorer."""
    model, rows = _model(spark, sf_dir), _valid(spark, sf_dir)
    slim = Model(E.Encoders(model.schema, list(model.encoders), {}), model.tree, model.leaves, model.s0)
    names = list(model.encoders.tables)
    known = model.with_codes(model.transform(rows)).select(*SCHEMA.names, *(f"{name}__known" for name in names), "score")
    both = known.mapInArrow(_predict(slim, names), "local double, score double")
    gap, inside = F.max(F.abs(F.col("local") - F.col("score"))), F.bool_and((F.col("local") > 0) & (F.col("local") < 1))
    return both.agg(F.count(F.lit(1)).cast("int").alias("n"), (F.coalesce(gap, F.lit(0.0)) < 1e-5).alias("agree"), F.coalesce(inside, F.lit(True)).alias("in_range"))


GROWN = Schema(["qty", "price", "flagstat"], [Kind.NUMERIC, Kind.NUMERIC, Kind.BOUNDED])


def best_split_features(spark, sf_dir):
    """The root's best split over several features, from one histogram."""
    rows = _training(spark, sf_dir)
    found = _encoders(spark, sf_dir, GROWN)
    binned = T.with_bins(G.with_gradients(found.transform(rows), G.base_score(rows)[1]), found)
    hist: dict = {}
    for r in T.histogram(binned, F.lit(0)).collect():  # features x bins
        hist.setdefault(r.feature, {})[r.bin] = np.array([r.g, r.h, r.gz, r.hz, r.hzz, r.n], float)
    best = T.best_split(hist, found, Config())
    row = (found[best.feature].name, best.threshold, ",".join(map(str, best.left_set)) or None, best.default_left, round(best.gain, 2))
    return spark.createDataFrame([row], "feature string, threshold double, left_set string, default_left boolean, gain double")


def _grown(spark, sf_dir) -> Model:
    return train(_training(spark, sf_dir), GROWN, Config(num_leaves=4, linear_leaves=False))


def grown_nodes(spark, sf_dir):
    """The nodes of a tree of four leaves."""
    return _node_rows(spark, _grown(spark, sf_dir))


def grown_leaf_counts(spark, sf_dir):
    return _leaf_counts(_grown(spark, sf_dir).transform(_training(spark, sf_dir)))


def grown_predict(spark, sf_dir):
    """Validation rows by the constant leaves of a tree of four leaves."""
    return _grown(spark, sf_dir).transform(_valid(spark, sf_dir)).select(RID, "leaf_id", F.round("score", 8).alias("score"))


def linear_leaf_predict_two_knots(spark, sf_dir):
    """Validation rows by the linear leaves of a tree of two leaves over one feature."""
    model = train(_training(spark, sf_dir), Schema(["qty"], [Kind.NUMERIC]), Config(num_leaves=2, knots=2))
    return model.transform(_valid(spark, sf_dir)).select(RID, "leaf_id", F.round("score", 6).alias("score"))


# --------------------------------------------------------------- metrics


def _scored(spark, sf_dir) -> DataFrame:
    return tables(spark, sf_dir)[0].select(RID, LABEL, ((F.col("qty") / 50.0 + F.col("part") % 7) / 8.0).alias("score"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 8).alias(c) if t == "double" else c for c, t in df.dtypes))


def log_loss(spark, sf_dir):
    return _rounded(M.log_loss(_scored(spark, sf_dir)))


def roc_auc(spark, sf_dir):
    return _rounded(M.roc_auc(_scored(spark, sf_dir)))


def pr_auc(spark, sf_dir):
    return _rounded(M.pr_auc(_scored(spark, sf_dir)))


def lift_at_1pct(spark, sf_dir):
    return _rounded(M.lift_at(_scored(spark, sf_dir), 0.01))


def lift_at_10pct(spark, sf_dir):
    return _rounded(M.lift_at(_scored(spark, sf_dir), 0.10))


def order_desc(spark, sf_dir):
    """All rows by falling score, then by number: the place of each."""
    return M.places_desc(_scored(spark, sf_dir)).select(RID, "place")


def reliability_bins(spark, sf_dir):
    return _rounded(M.reliability(_scored(spark, sf_dir), 10))


def metrics_bundle(spark, sf_dir):
    return _rounded(M.evaluate(_scored(spark, sf_dir)))


# --------------------------------------------------------------- generator and experiments


def generator_draws(spark, sf_dir):
    return synthetic.draws(spark, 42, 5_000)


def synthetic_profile(spark, sf_dir):
    rows = synthetic.make_synthetic(spark, 20_000, 42)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos"), F.sum(F.col("num_0").isNull().cast("int")).alias("missing_num_0"), F.sum(F.col("bcat_0").isNull().cast("int")).alias("missing_bcat_0"), F.countDistinct("hcat_0").alias("ids"))


def ablation_leaf_kind(spark, sf_dir):
    return _rounded(experiments.leaf_kinds(_training(spark, sf_dir), _valid(spark, sf_dir), SCHEMA))


def sweep_k_gain(spark, sf_dir):
    return _rounded(experiments.sweep(_training(spark, sf_dir), _valid(spark, sf_dir), SCHEMA))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the first three quarters of lineitem, score and evaluate the rest."""
    model = train(_training(spark, sf_dir), SCHEMA, replace(Config(), num_leaves=8))
    return M.evaluate(model.transform(_valid(spark, sf_dir)))


QUERIES = (
    temporal_split_counts, class_weights_, row_slice_, quantile_knots_numeric, quantile_knots_highcard, weighted_rate, base_score, grad_hess, target_encoding, target_encoding_oof,
    target_encoding_unique_ids, target_encode_unseen, vocab_first_seen, bounded_codes_valid, numeric_basis, onehot_basis, basis_layout, basis_expand_row, hist_numeric, split_numeric_const,
    split_numeric_leafaware, split_categorical, parent_scores, best_split_root, stump_partition, stump_predict_constant_leaf, tree_leaf_counts, tree_nodes, irls_one_feature, linear_leaf_predict,
    unseen_row_predict, scorer_paths_agree, generator_draws, order_desc, best_split_features, grown_nodes, grown_leaf_counts, grown_predict, linear_leaf_predict_two_knots, log_loss, roc_auc, pr_auc, lift_at_1pct, lift_at_10pct, reliability_bins, metrics_bundle, synthetic_profile, ablation_leaf_kind, sweep_k_gain,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__.rstrip("_"): f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
