"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier in numpy over the distinct words of a text. It learns from
confirmed toxic texts and unlabelled ones: the risk on the unlabelled side is
corrected by the class prior, and a negative estimate is turned back (the
non-negative risk), so that toxic texts among the unlabelled don't count as
clean. The prior and the final offset come from the labels of training rows.

A row is held out when crc32(doc_id as text) mod 5 is 0; its label is never
read. Score inputs are words only.

Bounds: the classifier is fitted on at most ``MAX_POSITIVE`` confirmed texts and
``MAX_UNLABELLED`` unlabelled ones, and its offset on as many labelled clean
ones as positive; all are the rows of the least hashes of their doc_ids. The
prior counts all training labels, and every text is scored as a whole.

Defined cases: null text is empty and gets the score of no words. Null doc_ids
are scored, held_out is false for them, and nothing is learned from them. Rows
that share a doc_id share its label; one of their texts, that of the least hash,
is learned from. A doc_id that is labelled both ways counts as toxic; null labels don't count. Without labels of both kinds there is nothing
to learn: all scores are the prior (0 if there is none). An empty table stays
empty. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import chunks, documents, separators, utf8, word_hashes

MAX_POSITIVE, MAX_UNLABELLED = 5_000, 10_000
FOLDS = 5
LOG_WORDS = 20
MIN_TEXTS = 5  # a word must be in so many texts of the sample
LEEWAY = 1.0  # standard errors over the greatest that chance gives
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
HASHER = 61


def word_ids(texts: pa.Array):
    """The distinct words of each text, as numbers below 2 ** LOG_WORDS."""
    sep = separators(SEPARATORS)
    buf, offs = utf8(texts)
    for lo, hi in chunks(offs):
        h, first = word_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], sep, HASHER)
        h = (h >> np.uint64(64 - LOG_WORDS)).astype(np.int32)
        for i in range(hi - lo):
            yield np.unique(h[first[i] : first[i + 1]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Classifier:
    """weights over words, and an offset and slope that turn margins to scores."""

    def __init__(self, prior: float):
        self.prior = prior
        self.weights = np.zeros(1 << LOG_WORDS, np.float32)
        self.offset = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        self.slope = 1.0

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[t].sum(dtype=np.float64) for t in texts])

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def _matrix(texts: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a 0/1 matrix laid end to end, with their bounds; unknown words left out."""
    kept = [c[c >= 0] for c in (column[t] for t in texts)]
    return np.concatenate([*kept, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(k) for k in kept])])


def _dot(w: np.ndarray, cols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(w[cols])])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _back(rows: np.ndarray, cols: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(cols, np.repeat(rows, np.diff(bounds)), n)


def telling_words(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Words whose share of texts differs between the two sides beyond chance.

    The bound on the difference, in standard errors, grows with the number of
    words tested, so that hardly any passes by luck.
    """
    counts = np.zeros((2, 1 << LOG_WORDS))
    for side, texts in enumerate((positive, unlabelled)):
        for t in texts:
            counts[side, t] += 1
    n = np.array([len(positive), len(unlabelled)])
    tested = (counts.sum(axis=0) >= MIN_TEXTS).sum()
    share = counts / n[:, None]
    both = (counts.sum(axis=0) + 1) / (n.sum() + 2)
    error = np.sqrt(both * (1 - both) * (1 / n).sum())
    bound = np.sqrt(2 * np.log(max(tested, 2))) + LEEWAY
    return np.flatnonzero((counts.sum(axis=0) >= MIN_TEXTS) & (np.abs(share[0] - share[1]) > bound * error))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], clean: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, decay: float = 2e-3) -> Classifier:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    model = Classifier(prior)
    if not positive or not unlabelled or not clean or not 0 < prior < 1:
        return model
    known = telling_words(positive, unlabelled)
    if not len(known):
        return model
    column = np.full(1 << LOG_WORDS, -1, np.int64)
    column[known] = np.arange(len(known))
    p, u = _matrix(positive, column), _matrix(unlabelled, column)
    n = len(known)
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        fp, fu = _dot(w, *p) + b, _dot(w, *u) + b
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        # loss of label 1: -log s, of label 0: -log(1 - s)
        negative = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
        dp_plus, dp_minus, du_minus = prior * (sp - 1) / len(sp), -prior * sp / len(sp), su / len(su)
        if negative >= 0:
            gp, gu = dp_plus + dp_minus, du_minus
        else:  # the estimate can't be below zero: step back on that part only
            gp, gu = -dp_minus, -du_minus
        grad = np.append(_back(gp, *p, n) + _back(gu, *u, n) + decay * w / n**0.5, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:n]
        b -= move[n]
    model.weights[known] = w
    model.offset = b
    _calibrate(model, positive, clean)
    return model


def _calibrate(model: Classifier, positive: list[np.ndarray], clean: list[np.ndarray]) -> None:
    """The offset that errs least on labelled training rows, at their prior."""
    f = np.concatenate([model.margins(positive), model.margins(clean)])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(clean))])
    weight = np.where(y == 1, model.prior / len(positive), (1 - model.prior) / len(clean))
    order = np.argsort(f, kind="stable")
    f, y, weight = f[order], y[order], weight[order]
    # cutting before place i: the clean ones from i on and the toxic ones before i are wrong
    wrong = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, 0))]) + np.concatenate([np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[f[0] - 1], (f[1:] + f[:-1]) / 2, [f[-1] + 1]])
    wrong[1:-1][f[1:] == f[:-1]] = np.inf
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cut = float(edges[best[len(best) // 2]])
    spread = float(np.std(f)) or 1.0
    model.slope = 3.0 / spread
    model.offset = -model.slope * cut


def _sample(ids: DataFrame, n: int, rows: int) -> DataFrame:
    """The n of those rows that have the least hashes.

    Each task passes on what is below a bound that some 4 n of all rows are
    below, so that the last sort gets no more from many tasks than from few.
    """
    if rows > 8 * n:
        ids = ids.filter(F.xxhash64("doc_id") < F.lit(4 * n * 2**64 // rows - 2**63))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _words(batches):
    for batch in batches:
        words = [w.tobytes() for w in word_ids(batch.column("text"))]
        digests = [xxhash.xxh3_64_intdigest(w) >> 1 for w in words]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), pa.array(digests, pa.int64()), pa.array(words, pa.binary())], names=["doc_id", "kind", "digest", "words"])


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learns from the training rows of docs and labels."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = documents(docs).select("doc_id").filter("doc_id is not null").filter(~held_out(F.col("doc_id"))).distinct()
    known = ids.join(marked, "doc_id", "left")
    rows, n, toxic = known.agg(F.count(F.lit(1)), F.count("toxic"), F.count_if(F.col("toxic") == 1)).first()
    model = Classifier(toxic / n if n else 0.0)
    if not 0 < toxic < n:
        return model
    # where all rows are labelled, any of them stand in for unlabelled ones, labels unread
    unlabelled = known if n == rows else known.filter("toxic is null")
    picked = (
        _sample(known.filter("toxic = 1"), MAX_POSITIVE, toxic)
        .withColumn("kind", F.lit(1))
        .unionByName(_sample(known.filter("toxic = 0"), MAX_POSITIVE, n - toxic).withColumn("kind", F.lit(0)))
        .unionByName(_sample(unlabelled, MAX_UNLABELLED, rows if n == rows else rows - n).withColumn("kind", F.lit(2)))
        .select("doc_id", "kind")
    )
    # the bound on the picked rows bounds what is broadcast and, with a text per id, what comes to the driver
    words = documents(docs).join(F.broadcast(picked), "doc_id").mapInArrow(_words, "doc_id long, kind int, digest long, words binary")
    table = words.groupBy("doc_id", "kind").agg(F.min(F.struct("digest", "words")).alias("least")).select("kind", "least.words").toArrow()
    found: dict[int, list] = {0: [], 1: [], 2: []}
    # sorted, so that the fit doesn't depend on the order in which tasks end
    for kind, own in sorted(zip(table.column("kind").to_pylist(), table.column("words").to_pylist())):
        found[kind].append(np.frombuffer(own, np.int32))
    return train(found[1], found[2], found[0], model.prior)


def toxicity_score(docs: DataFrame, labels: DataFrame) -> Column:
    """The score of a row of docs, by its column text; no other column goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(list(word_ids(text))))

    return score(F.col("text").cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with the two columns; columns of these names are replaced."""
    rows = docs.drop(score, predicted)
    return rows.withColumn(score, toxicity_score(docs, labels)).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = documents(docs).select("doc_id", toxicity_score(docs, labels).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    return docs.filter(toxicity_score(docs, labels) < 0.5)
