"""Best-two-fit packing of tokenised documents into sequences.

A document is its tokens and one end token; one that is longer than a sequence
is cut into full pieces and a last one. Pieces are packed whole.

How it runs. Pieces of one length are alike, so the plan is made from the count
of pieces per length: at most ``capacity`` numbers, whatever the corpus. A bin
is filled greedily with the longest pieces that fit; then its smallest piece is
replaced by two unpacked ones that fit its expanded gap more tightly, if there
are such. The bin so found is repeated as often as the counts allow, so the plan
has a few entries per length. Each task numbers its pieces of a length; counts
per task give the numbers an offset, and a piece finds its place in the plan by
its length and number. Nothing but the counts and the plan leaves the tasks.

Tokens come from the whole text. It is cut where the tokenizer can't join (white
space, and between ASCII letters or digits and ASCII signs); each distinct part
is encoded once per worker process and kept. That the parts' tokens are those of
the whole text is tested. Texts with a special token's name are encoded whole.

Defined cases: a null or empty text is the end token alone. Ids may be null or
repeated: each row is a document. An empty table stays empty. Other columns are
not read.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import CHUNK, SPACES, Stage, chunks, documents, separators, span_hashes, utf8

CAPACITY, END = 4096, 1
SEED = 31
#: Distinct parts of text whose tokens a worker process keeps.
KEPT_PARTS = 1_000_000
KEPT_BYTES = 32 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --------------------------------------------------------------- tokens


def _laid_out(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans of buf, one after another."""
    ends = np.cumsum(size)
    return buf[np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class PartEncoder:
    """Tokens of texts, from the tokens of their distinct parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.space = separators(SPACES)
        # 0: letters, digits and all that is not ASCII or may not be cut from its neighbours; 1: signs
        self.sign = separators(bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")))
        self.plain = separators(bytes(b for b in range(128) if chr(b).isalnum()))
        self._empty()

    def _empty(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted hashes of parts, and their numbers
        self.number = np.empty(0, np.int32)
        # by number: bounds of the part's tokens in ids, and of its bytes in raw
        self.ids, self.ids_end = np.empty(0, np.uint32), np.zeros(1, np.int32)
        self.raw, self.raw_end = np.empty(0, np.uint8), np.zeros(1, np.int32)

    def parts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts of rows laid end to end."""
        if not len(buf):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        space, sign, plain = self.space[buf], self.sign[buf], self.plain[buf]
        edge = np.empty(len(buf) + 1, bool)
        edge[0] = edge[-1] = True
        cut = space[1:] != space[:-1]
        cut |= plain[:-1] & sign[1:]
        cut |= sign[:-1] & plain[1:]
        edge[1:-1] = cut
        edge[offs] = True
        at = np.flatnonzero(edge)
        word = ~space[at[:-1]]
        return at[:-1][word], at[1:][word]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in order, and where those of each row start (one entry more).

        Parts are looked up by hash, and each one's bytes are compared with those
        of the part found; where they differ, a part's own tokens are used.
        """
        starts, ends = self.parts(buf, offs)
        keys = span_hashes(buf, starts, ends, SEED)
        distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(slot, len(self.keys) - 1)] == distinct
        if not known.all():
            self._learn(buf, distinct[~known], slot[~known], starts[first[~known]], ends[first[~known]])
            slot = np.searchsorted(self.keys, distinct)
        number = self.number[slot][where]
        at, table = self.ids_end[number].astype(np.int64), self.ids
        size = self.ids_end[number + 1] - at
        wrong = self._unlike(buf, starts, ends, number)
        if len(wrong):
            own = [self._tokens(bytes(memoryview(buf)[starts[i] : ends[i]])) for i in wrong.tolist()]
            size[wrong] = [len(x) for x in own]
            at[wrong] = len(table) + np.cumsum(size[wrong]) - size[wrong]
            table = np.concatenate([table, *(np.array(x, np.uint32) for x in own)])
        total = np.concatenate([[0], np.cumsum(size)])
        ids = table[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offs)]

    def _unlike(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The parts whose bytes are not those kept under their number."""
        size, at = ends - starts, self.raw_end[number].astype(np.int64)
        unlike = size != self.raw_end[number + 1] - at
        some = np.flatnonzero(~unlike)
        differ = _laid_out(buf, starts[some], size[some]) != _laid_out(self.raw, at[some], size[some])
        if differ.any():
            unlike[some[np.searchsorted(np.cumsum(size[some]), np.flatnonzero(differ), "right")]] = True
        return np.flatnonzero(unlike)

    def _tokens(self, part: bytes) -> list[int]:
        return self.tokenizer.encode(part.decode(), add_special_tokens=False).ids

    def _learn(self, buf: np.ndarray, keys: np.ndarray, slot: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = memoryview(buf)
        found = self.tokenizer.encode_batch_fast([bytes(raw[a:b]).decode() for a, b in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)
        new = [f.ids for f in found]
        sizes = np.array([len(x) for x in new], np.int64)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.uint32, int(sizes.sum()))])
        self.raw = np.concatenate([self.raw, _laid_out(buf, starts, ends - starts)])
        numbers = np.arange(len(keys), dtype=np.int32) + np.int32(len(self.keys))
        self.ids_end = np.concatenate([self.ids_end, (self.ids_end[-1] + np.cumsum(sizes)).astype(np.int32)])
        self.raw_end = np.concatenate([self.raw_end, (self.raw_end[-1] + np.cumsum(ends - starts)).astype(np.int32)])
        self.keys, self.number = np.insert(self.keys, slot, keys), np.insert(self.number, slot, numbers)

    def trim(self) -> None:
        if len(self.keys) > KEPT_PARTS or len(self.raw) > KEPT_BYTES:
            self._empty()

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The tokens of each text."""
        buf, offs = utf8(column)
        for lo, hi in chunks(offs, 4 * CHUNK):
            part = buf[offs[lo] : offs[hi]]
            raw = part.tobytes()
            if any(s in raw for s in self.special):
                for i in range(lo, hi):
                    text = buf[offs[i] : offs[i + 1]].tobytes().decode()
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            self.trim()
            ids, first = self.encode(part, offs[lo : hi + 1] - offs[lo])
            for i in range(hi - lo):
                yield ids[first[i] : first[i + 1]]


def worker_encoder(path: str) -> PartEncoder:
    """One encoder per worker process, kept between its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_tessera_encoders", types.ModuleType("_tessera_encoders"))
    if not hasattr(kept, path):
        setattr(kept, path, PartEncoder(path))
    return getattr(kept, path)


def _cut(path: str, capacity: int, end: int):
    def run(batches):
        encoder = worker_encoder(path)
        part = TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            docs, rows = batch.column("doc_id").to_pylist(), []
            for doc, ids in zip(docs, encoder.texts(batch.column("text"))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc, k, start, len(own), zlib.crc32(own.tobytes()), part, int(numbers[len(own)])))
                    numbers[len(own)] += 1
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


# --------------------------------------------------------------- the plan


class Left:
    """Lengths with pieces left, and the greatest one that fits."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self.lengths = np.flatnonzero(self.counts).tolist()

    def greatest(self, room: int, used: dict[int, int]) -> int:
        """The greatest length up to room that has pieces besides those used; 0: none."""
        from bisect import bisect_right

        i = bisect_right(self.lengths, room) - 1
        while i >= 0 and self.counts[self.lengths[i]] <= used.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def take(self, bin_: dict[int, int], times: int) -> None:
        for length, n in bin_.items():
            self.counts[length] -= n * times
            if not self.counts[length]:
                self.lengths.remove(length)


def _two_that_fit(left: Left, room: int, more_than: int, used: dict[int, int]) -> tuple[int, int]:
    """Two unpacked lengths whose sum is the greatest up to room, if over more_than."""
    best, pair = more_than, (0, 0)
    lengths = [x for x in left.lengths if left.counts[x] > used.get(x, 0)]
    lo, hi = 0, len(lengths) - 1
    while lo <= hi and best < room:
        total = lengths[lo] + lengths[hi]
        if total > room:
            hi -= 1
            continue
        if total > best and (lo != hi or left.counts[lengths[lo]] - used.get(lengths[lo], 0) > 1):
            best, pair = total, (lengths[hi], lengths[lo])
        lo += 1
    return pair


def make_plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as {length: pieces}, each with the number of times it is made."""
    left = Left(counts)
    plan = []
    while left.lengths:
        bin_: dict[int, int] = {}
        gap = capacity
        while gap and (length := left.greatest(gap, bin_)):
            # of one length, as many as fit go in at once
            n = int(min(gap // length, left.counts[length] - bin_.get(length, 0)))
            bin_[length] = bin_.get(length, 0) + n
            gap -= n * length
        if gap:
            small = min(bin_)
            used = dict(bin_)
            pair = _two_that_fit(left, gap + small, small, used)
            if pair[0]:
                bin_[small] -= 1
                if not bin_[small]:
                    del bin_[small]
                for length in pair:
                    bin_[length] = bin_.get(length, 0) + 1
        times = int(min(left.counts[length] // n for length, n in bin_.items()))
        left.take(bin_, times)
        plan.append((bin_, times))
    return plan


def plan_table(plan: list[tuple[dict[int, int], int]], counts: np.ndarray) -> dict[int, np.ndarray]:
    """Per length: first number, pieces per bin, first sequence, first offset."""
    table: dict[int, list] = {}
    done = np.zeros(len(counts), np.int64)
    sequence = 0
    for bin_, times in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            table.setdefault(length, []).append((int(done[length]), n, sequence, offset))
            done[length] += n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in table.items()}


def _place(shared):
    def run(batches):
        table = shared.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == length)
                rows = table[length]
                row = rows[np.searchsorted(rows[:, 0], number[of], "right") - 1]
                k = number[of] - row[:, 0]
                sequence[of] = row[:, 2] + k // row[:, 1]
                offset[of] = row[:, 3] + k % row[:, 1] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    stage = Stage(spark, "packing")
    pieces = stage.put(documents(docs).mapInArrow(_cut(vocabulary or default_vocabulary(), capacity, end), PIECES), "pieces")
    by_task = stage.put(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        counts[length] = n
    shared = spark.sparkContext.broadcast(plan_table(make_plan(counts, capacity), counts))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per task
    before = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    # a row per task and length: it grows with the corpus, so it is never broadcast
    placed = pieces.join(before.hint("merge"), ["part", "length"])
    return placed.mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
