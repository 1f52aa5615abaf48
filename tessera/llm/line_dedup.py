"""Line deduplication with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys
of at least ``min_chars`` code points that at least ``min_docs`` documents hold
lose all their lines, but for those of the largest doc_id among them.

How it runs: the first scan sets two filters, one of hashes seen once and one
of hashes seen twice; the filters of all tasks merge by segment. A bit that two
keys or two tasks set is a "twice" bit, so no repeated key is missed. The
second scan shuffles only the hashes that the second filter suspects; there
128-bit hashes are counted exactly and the document that keeps the line is
chosen. Documents that lose lines are joined with these; a filter of their ids
lets all others pass without a shuffle. The filter has one bit per ``BYTES_PER_BIT`` bytes of text and at most
2 ** MAX_BITS (64 MB), which bounds what is broadcast; past that more
suspects are shuffled and the result is the same.

Defined cases: a null or empty text is one empty line. A null doc_id is one
document, smaller than any other. Rows that share a doc_id are one document in
the count, and each row loses its lines alike. An empty table stays empty.
Other columns are kept as they are; a column named like a result column
(n_lines, n_dropped) is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import SPACES, Stage, fresh, mix, shuffle_partitions, small_batches, split_by

MIN_CHARS, MIN_DOCS = 40, 5
HASHES = 4
BYTES_PER_BIT = 32
MIN_BITS, MAX_BITS = 16, 29
SEGMENT_BITS = 16
ENDS = SPACES.decode()


def _line_key(line: str, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key; None if the key is too short."""
    key = line.strip(ENDS)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """The distinct keys of a text."""
    if not text or len(text) < min_chars:
        return []
    return list({k for k in (_line_key(x, min_chars) for x in text.split("\n")) if k is not None})


def _bits(keys: list[bytes], log_bits: int) -> np.ndarray:
    """HASHES places in the filter for each key, all in one segment."""
    h = np.frombuffer(b"".join(keys), np.uint64)[::2].copy()
    low = np.uint64((1 << min(SEGMENT_BITS, log_bits)) - 1)
    segment = (h >> np.uint64(20)) & np.uint64((1 << log_bits) - 1) & ~low
    out = np.empty((len(h), HASHES), np.uint64)
    for i in range(HASHES):
        out[:, i] = segment | (mix(h + np.uint64(i)) & low)
    return out


class TwoFilters:
    """Bloom filters of hashes seen once and seen twice."""

    def __init__(self, log_bits: int):
        self.log_bits = log_bits
        self.once = np.zeros(1 << (log_bits - 3), np.uint8)
        self.twice = np.zeros(1 << (log_bits - 3), np.uint8)

    def add(self, keys: list[bytes]) -> None:
        if not keys:
            return
        places, counts = np.unique(_bits(keys, self.log_bits).ravel(), return_counts=True)
        byte, bit = places >> np.uint64(3), np.left_shift(np.uint8(1), (places & np.uint64(7)).astype(np.uint8))
        again = (counts > 1) | (self.once[byte] & bit > 0)
        np.bitwise_or.at(self.twice, byte[again], bit[again])
        np.bitwise_or.at(self.once, byte, bit)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = 1 << (min(SEGMENT_BITS, self.log_bits) - 3)
        once, twice = self.once.reshape(-1, size), self.twice.reshape(-1, size)
        for k in np.flatnonzero(once.any(axis=1)).tolist():
            yield k, zlib.compress(once[k].tobytes(), 1), zlib.compress(twice[k].tobytes(), 1)


def suspected(keys: list[bytes], log_bits: int, twice: np.ndarray) -> np.ndarray:
    places = _bits(keys, log_bits)
    bit = np.left_shift(np.uint8(1), (places & np.uint64(7)).astype(np.uint8))
    return (twice[places >> np.uint64(3)] & bit > 0).all(axis=1)


def _build(log_bits: int, min_chars: int):
    def run(batches):
        filters = TwoFilters(log_bits)
        for batch in batches:
            # rows of one document count once; a repeat across batches only adds a suspect
            seen: dict = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = _keys(text, min_chars)
                if found:
                    seen.setdefault(doc, set()).update(found)
            filters.add([k for keys in seen.values() for k in keys])
        rows = list(filters.segments())
        for lo in range(0, len(rows), 64):
            segment, once, twice = zip(*rows[lo : lo + 64])
            yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["segment", "once", "twice"])

    return run


def _merge(batches):
    """One row per segment: the bits that were set twice, in a task or by two."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, *packed in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
            old = found.get(segment)
            found[segment] = (once, twice) if old is None else (old[0] | once, old[1] | twice | (old[0] & once))
    rows = [(k, zlib.compress(twice.tobytes(), 1)) for k, (_, twice) in found.items() if twice.any()]
    if rows:
        segment, twice = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(twice, pa.binary())], names=["segment", "twice"])


def _suspects(log_bits: int, min_chars: int, shared):
    def run(batches):
        twice = shared.value
        for batch in batches:
            docs, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = _keys(text, min_chars)
                docs += [doc] * len(found)
                keys += found
            if keys:
                yes = np.flatnonzero(suspected(keys, log_bits, twice)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in yes], pa.int64()), pa.array([keys[i] for i in yes], pa.binary())], names=["doc_id", "key"])

    return run


def _drop(names: list[str], text: str, drops: str, min_chars: int):
    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for value, keys in zip(batch.column(text).to_pylist(), batch.column(drops).to_pylist()):
                parts = (value or "").split("\n")
                gone = set(keys or ())
                left = [x for x in parts if _line_key(x, min_chars) not in gone] if gone else parts
                texts.append("\n".join(left) if gone else value)
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            new = {text: pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return run


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the repeated lines gone from text, plus n_lines and n_dropped."""
    spark = small_batches(docs).sparkSession
    stage = Stage(spark, "lines")
    rows = docs.drop("n_lines", "n_dropped")
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_bits = min(max((total // BYTES_PER_BIT).bit_length(), MIN_BITS), MAX_BITS)

    built = texts.mapInArrow(_build(log_bits, min_chars), "segment int, once binary, twice binary")
    merged = built.repartition(shuffle_partitions(spark), "segment").mapInArrow(_merge, "segment int, twice binary")
    twice = np.zeros(1 << (log_bits - 3), np.uint8)
    size = 1 << (min(SEGMENT_BITS, log_bits) - 3)
    for segment, packed in merged.collect():  # at most 2 ** MAX_BITS bits in all
        twice[segment * size : (segment + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
    shared = spark.sparkContext.broadcast(twice)

    suspects = stage.put(texts.mapInArrow(_suspects(log_bits, min_chars, shared), "doc_id long, key binary"), "suspects")
    holders = suspects.distinct()
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    groups = holders.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("keep")).filter(F.col("n") >= min_docs)
    drops = holders.join(groups, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keep.doc_id")))
    drops = drops.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    gone, owner = fresh(rows, "drops", "owner")
    drops = stage.put(drops.select(F.col("doc_id").alias(owner), F.col("keys").alias(gone)), "drops")
    stage.keep("drops")
    key = F.col("doc_id").cast("long")
    some, whole = split_by(rows, key, drops.select(owner))
    # a sort-merge join at every size: the lists grow with the corpus, so none is broadcast
    joined = some.join(drops.hint("merge"), key.eqNullSafe(F.col(owner)), "left").drop(owner)
    names = [*rows.columns, "n_lines", "n_dropped"]
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema) + ", n_lines long, n_dropped long"
    text = F.col("text").cast("string")
    n_lines = F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(1)).cast("long")
    whole = whole.withColumn("text", text).select(*(f"`{c}`" for c in rows.columns), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return whole.union(joined.mapInArrow(_drop(names, "text", gone, min_chars), schema))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
