"""Benchmark decontamination by winnowing.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased. A
window is 13 successive words of an item; an item of fewer words, but not none,
is one window. A document's word inside any occurrence of a window is hit.

How it runs: both sides keep the minimum k-gram hash of each sliding run of w
k-grams, with k + w - 1 the length of the shortest window of a class, so that
every shared window shares a fingerprint. Windows of 13 words are one class;
each shorter item length is a class of its own. The documents' fingerprints are
first tested against a bitmap of the items' (64 MB at most; past that more pass
the test, with the same result), and those left are joined with them. Each fingerprint carries the
hashes of the words around it; a joined pair is extended over these, and a run
as long as a window is a hit. Runs are united per document.

Defined cases: null has no words. An item with a null item_id hits words and is
not listed among the items; rows that share an item_id are texts of one item.
Rows of documents are told apart by their place in the scan, so null or
repeated doc_ids are harmless. No items: no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Stage, bitmap, chunks, filter_bits, grams, in_bitmap, mix, separators, small_batches, utf8, winnow, without, word_hashes

WINDOW, GRAM = 13, 5
SALTS = 32  # tasks among which the documents of one fingerprint are dealt
#: All ASCII but 0-9, A-Z and a-z.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
HASHER = 81


def _class(length: int) -> tuple[int, int]:
    """k and w for windows of that many words."""
    k = min(GRAM, length)
    return k, length - k + 1


def _fingerprints(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each class: the window length, fingerprints and their places."""
    for length in lengths:
        if len(words) >= length:
            k, w = _class(length)
            h = grams(words, k, length)
            at = winnow(h, w)
            yield length, h[at], at


def _around(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The words that windows over the k-gram at each place can reach; 0: none."""
    k, w = _class(length)
    reach = w - 1
    padded = np.concatenate([np.zeros(reach, np.uint64), words, np.zeros(reach, np.uint64)])
    return padded[at[:, None] + np.arange(2 * reach + k)]


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sep = separators(SEPARATORS)
    buf, offs = utf8(batch.column("text"))
    for lo, hi in chunks(offs):
        words, first = word_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], sep, HASHER)
        words = words | np.uint64(1)  # 0 marks a place outside
        for i in range(hi - lo):
            yield lo + i, words[first[i] : first[i + 1]]


def _item_prints(batches):
    for batch in batches:
        ids = batch.column("item_id")
        for row, words in _rows_of(batch):
            length = min(len(words), WINDOW)
            if not length:
                continue
            # an item's repeated words make repeated fingerprints with other surroundings: all stay
            for n, h, at in _fingerprints(words, [length]):
                around = np.ascontiguousarray(_around(words, at, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[row].as_py()] * len(h), pa.int64()), pa.array([n] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array([x.tobytes() for x in around], pa.binary())],
                    names=["item_id", "length", "print", "item_words"],
                )


def _map_place(h: np.ndarray, log_bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - log_bits)).astype(np.int64)


def _map_places(log_bits: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_map_place(batch.column("print").to_numpy().view(np.uint64), log_bits))], names=["place"])

    return run


def _doc_prints(lengths: list[int], log_bits: int, shared):
    def run(batches):
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            found: list = [None] * batch.num_rows
            for row, words in _rows_of(batch):
                counts[row] = len(words)
                prints = []
                for n, h, at in _fingerprints(words, lengths):
                    yes = in_bitmap(shared.value, _map_place(h, log_bits))
                    if yes.any():
                        # a document's places with the same words around go as one
                        same: dict[tuple[int, bytes], list[int]] = {}
                        around = np.ascontiguousarray(_around(words, at[yes], n))
                        for p, a, x in zip(h[yes].view(np.int64).tolist(), at[yes].tolist(), around):
                            same.setdefault((p, x.tobytes()), []).append(a)
                        prints += [{"length": n, "print": p, "at": a, "doc_words": x} for (p, x), a in same.items()]
                found[row] = prints
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("doc_id"), pa.array(counts), pa.array(found, pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("at", pa.list_(pa.int64())), ("doc_words", pa.binary())])))],
                names=["doc", "doc_id", "n_words", "prints"],
            )

    return run


def _extend(batches):
    """The run of equal words around each pair of k-grams, if a window fits in."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column("length").to_numpy(zero_copy_only=False)
        ours, theirs = batch.column("doc_words").to_pylist(), batch.column("item_words").to_pylist()
        places = batch.column("at")
        docs, items = batch.column("doc"), batch.column("item_id")
        for length in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == length)
            k, w = _class(length)
            a = np.frombuffer(b"".join(ours[i] for i in of), np.uint64).reshape(len(of), -1)
            b = np.frombuffer(b"".join(theirs[i] for i in of), np.uint64).reshape(len(of), -1)
            same = (a == b) & (a != 0)
            left = np.cumprod(same[:, : w - 1][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, w - 1 + k :], axis=1).sum(axis=1)
            good = same[:, w - 1 : w - 1 + k].all(axis=1) & (left + k + right >= length)
            pick = of[good]
            own = places.take(pa.array(pick))
            times = np.diff(own.offsets.to_numpy())
            pick, before, size = np.repeat(pick, times), np.repeat(left[good], times), np.repeat((left + k + right)[good], times)
            start = own.flatten().to_numpy(zero_copy_only=False) - before
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(pick)), items.take(pa.array(pick)), pa.array(start), pa.array(start + size)], names=["doc", "item_id", "lo", "hi"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items, contaminated.

    items: the ids of the items whose windows occur, as sorted strings.
    """
    spark = small_batches(docs).sparkSession
    stage = Stage(spark, "winnow")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    theirs = stage.put(items.mapInArrow(_item_prints, "item_id long, length int, print long, item_words binary").distinct(), "items")

    lengths = sorted(r[0] for r in theirs.select("length").distinct().collect())  # 13 at most
    log_bits = filter_bits(theirs.count())
    shared = spark.sparkContext.broadcast(bitmap(theirs.select("print").mapInArrow(_map_places(log_bits), "place long"), log_bits))

    texts = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = "prints array<struct<length:int,print:long,at:array<long>,doc_words:binary>>"
    ours = stage.put(texts.mapInArrow(_doc_prints(lengths, log_bits, shared), f"doc long, doc_id long, n_words long, {prints}"), "documents")

    # a short item can be in most documents: its rows go to SALTS tasks
    salted = ours.select("doc", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"), F.inline("prints"))
    pairs = salted.join(theirs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["length", "print", "salt"])
    hits = pairs.select("doc", "length", "at", "doc_words", "item_id", "item_words").mapInArrow(_extend, "doc long, item_id long, lo long, hi long")
    # a passage met through several fingerprints or items is one run
    runs = hits.groupBy("doc", "lo", "hi").agg(F.collect_set("item_id").alias("ids"))
    per_doc = runs.groupBy("doc").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("lo", "hi"))),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
            lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(r["lo"], a["end"]))).alias("n"), F.greatest(a["end"], r["hi"]).alias("end")),
            lambda a: a["n"],
        ).alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("ids"))), lambda x: x.cast("string"))).alias("items"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return ours.select("doc", "doc_id", "n_words").join(per_doc, "doc", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated; rows that share a doc_id go together."""
    dirty = contamination(docs, benchmark).filter("contaminated").select("doc_id").distinct()
    dirty = Stage(docs.sparkSession, "contaminated").put(dirty, "ids")
    return without(docs, F.col("doc_id").cast("long"), dirty)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )
