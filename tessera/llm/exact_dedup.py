"""Exact deduplication with a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z. A digest is the SHA-256
of the normalised text. Beside it goes a print of the content, its length and its
XXH3 of 128 bits, which a hit is verified against. Of equal texts the row with
the largest doc_id stays.

How it runs: one scan of the texts makes digests and prints. Each batch adds up
its own equal texts before they are shuffled, so a text held by a third of all
rows sends a row per batch. Each bucket of the digest space is read as one run
and has an index of its own, so memory is the distinct digests of one bucket.
Once a bucket is read, digests of one row are deleted: what is left alive are the
groups of two rows or more, and only these are put out. A last join gives each
row its group; it is a plain equi-join, whose skew AQE splits.

Defined cases: a null text is the empty text. A null doc_id is smaller than
any other. Rows that repeat both doc_id and text are told apart by their place
in the scan, so just one row of a group stays. An empty table gives an empty
result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Stage, documents, fresh, shuffle_partitions, utf8

LEAST = -(2**63)


class CuckooIndex:
    """Digests that can be inserted, found, replaced and deleted.

    The filter holds 16-bit fingerprints in buckets of four; a digest lies in
    one of two buckets, the second found from the first and the fingerprint.
    Each filter slot has the stored key and value beside it: a fingerprint that
    matches is only a hit when the stored key equals the digest and the content's
    print; texts of one digest and two prints are two keys. When an insert
    finds no slot after ``kicks`` moves, the table doubles and is filled again
    from the stored keys, so nothing is ever dropped.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 64, kicks: int = 200):
        self.kicks = kicks
        self.size = 0
        self.resizes = 0
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.entries: list = [None] * (buckets * self.SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.prints[slot] == mark and self.entries[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._slot(key)
        return None if slot < 0 else self.entries[slot][1]

    def insert(self, key: bytes, value) -> None:
        """Adds a live digest, or gives it a new value."""
        slot = self._slot(key)
        if slot >= 0:
            self.entries[slot] = (key, value)
            return
        self.size += 1
        left = self._place((key, value))
        while left is not None:
            left = self._grow(left)

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.entries[slot] = 0, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return (e for e in self.entries if e is not None)

    def _place(self, entry):
        """Puts the entry in; returns what is left over after all kicks."""
        mark, one, two = self._places(entry[0])
        bucket = one
        for turn in range(self.kicks):
            for b in (one, two) if turn == 0 else (bucket,):
                for slot in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.entries[slot] = mark, entry
                        return None
            slot = bucket * self.SLOTS + (turn * 7 + mark) % self.SLOTS
            (self.prints[slot], mark), (self.entries[slot], entry) = (mark, self.prints[slot]), (entry, self.entries[slot])
            bucket = self._other(bucket, mark)
        return entry

    def _grow(self, left):
        stored = [*self.items(), left]
        self.resizes += 1
        self._clear(2 * (self.mask + 1))
        lost = [x for x in map(self._place, stored) if x is not None]
        while lost:
            stored = [*self.items(), *lost]
            self._clear(2 * (self.mask + 1))
            lost = [x for x in map(self._place, stored) if x is not None]
        return None


def content_key(content: bytes) -> bytes:
    """The digest of a normalised text, then the print of its content."""
    return hashlib.sha256(content).digest() + len(content).to_bytes(8, "little") + xxhash.xxh3_128_digest(content)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = utf8(batch.column("text"))
        raw, at = memoryview(buf), offs.tolist()
        keys = [content_key(bytes(raw[a:b]).lower()) for a, b in zip(at, at[1:])]
        out = {"doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.binary())}
        if "uid" in batch.schema.names:
            out["uid"] = batch.column("uid")
        yield pa.RecordBatch.from_pydict(out)


def _better(a: tuple, b: tuple) -> tuple:
    """The later of two (has id, id, place), with the counts added up."""
    return (*max(a[:3], b[:3]), a[3] + b[3])


def _local_groups(buckets: int):
    def run(batches):
        for batch in batches:
            found: dict = {}
            for uid, doc, key in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "key"))):
                new = (doc is not None, LEAST if doc is None else doc, uid, 1)
                old = found.get(key)
                found[key] = new if old is None else _better(old, new)
            values = list(found.values())
            bucket = [int.from_bytes(k[28:32], "little") % buckets for k in found]
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([v[i] for v in values], kind) for i, kind in enumerate(kinds)]
            names = ["bucket", "key", "has_id", "keep_id", "keep_uid", "group_size"]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(list(found), pa.binary()), *columns], names=names)

    return run


def _live(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    """The groups of a bucket, once digests that only one row has are deleted."""
    for key in [k for k, v in index.items() if v[3] == 1]:
        index.delete(key)
    entries = list(index.items())
    for lo in range(0, len(entries), 10_000):
        part = entries[lo : lo + 10_000]
        keep_id = pa.array([v[1] if v[0] else None for _, v in part], pa.int64())
        keep_uid, size = (pa.array([v[i] for _, v in part], pa.int64()) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), keep_id, keep_uid, size], names=["key", "keep_id", "keep_uid", "group_size"])


def _index_groups(batches):
    """One index at a time, for each bucket of the digest space in rows sorted by bucket."""
    index, of = CuckooIndex(), None
    for batch in batches:
        for bucket, key, *value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "has_id", "keep_id", "keep_uid", "group_size"))):
            if bucket != of:
                yield from _live(index)
                index, of = CuckooIndex(), bucket
            old = index.get(key)
            index.insert(key, tuple(value) if old is None else _better(old, tuple(value)))
    yield from _live(index)


def exact_groups(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    ``uid`` names a column of docs that tells rows apart; it is returned as
    ``uid``. Without it, the place in the scan serves.
    """
    stage = Stage(docs.sparkSession, "exact")
    texts = documents(docs) if uid is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(uid).alias("uid"))
    digests = texts.mapInArrow(_digest, "doc_id long, key binary" + (", uid long" if uid else ""))
    digests = stage.put(digests if uid else digests.withColumn("uid", F.monotonically_increasing_id()), "digests")
    buckets = shuffle_partitions(docs.sparkSession)
    local = digests.mapInArrow(_local_groups(8 * buckets), "bucket int, key binary, has_id boolean, keep_id long, keep_uid long, group_size long")
    dealt = local.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    groups = dealt.mapInArrow(_index_groups, "key binary, keep_id long, keep_uid long, group_size long")
    shared, size = F.col("keep_uid").isNotNull(), F.coalesce("group_size", F.lit(1).cast("long"))
    return digests.join(groups, "key", "left").select(
        *(["uid"] if uid else []),
        "doc_id",
        F.when(shared, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        size.alias("group_size"),
        (~shared | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    (uid,) = fresh(docs, "uid")
    rows = Stage(docs.sparkSession, "exact-rows").put(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    kept = exact_groups(rows, uid).filter("kept").select(F.col("uid").alias(uid))
    return rows.join(kept, uid, "left_semi").drop(uid)
