"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier (in
a smaller doc_id, or earlier in the same document) is removed. Overlaps count,
and strings are judged on the input.

How it runs. A suffix array over all texts can't be spread over machines, so it
is made sparse: of each run of 69 successive 32-byte grams the one with the
least hash is an anchor, and any 100 bytes hold an anchor at the same place
wherever they occur. What a repeated string around an anchor can reach is its
context, 68 bytes to either side.

1. One scan finds anchors. Equal contexts within a batch go as one; the later
   ones are repeats as a whole. The first ones are dealt out by anchor. An anchor
   with FREQUENT kinds of context in a batch isn't: it is set down as frequent.
2. Per anchor, contexts that equal an earlier one (by their XXH3) are repeats as
   a whole. Anchors with one kind of context are done, those with several need
   bytes.
3. A second scan sends the bytes of the first context of each kind, and those of
   all contexts of frequent anchors. (Which ones are needed is a Bloom filter of at most 2 ** MAX_BITS bits; past its capacity
   more contexts are sent, with the same result.)
4. A window of 100 bytes round an anchor starts 0 to 34 or 35 to 68 bytes before
   it. Contexts are dealt out twice, each time by the bytes that all windows of
   such a range have in common, so groups that share less fall apart. Where more
   than CROWD contexts of frequent anchors share a key, their range is halved, and again, until the
   groups are small or the range is one window; contexts that are equal within
   the narrower range go as one. In each group the suffixes that start at anchors
   are sorted; a stack scan of the common-prefix lengths gives the interval tree.
   For each interval the left extensions are told apart; where they differ, the
   members that share enough to the left are a maximal repeat, put out with all
   occurrences. All but the first are cut.
5. Cuts are united per document and joined to the texts they fall in; a filter
   lets all other texts pass without a shuffle.

Defined cases: a null text is empty. A null doc_id comes before any other. Rows
that share a doc_id are documents of their own, in the order of a hash of their
text; rows that also share the text are one document, and each gets its result.
An empty table stays empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import CHUNK, Rolling, Stage, bitmap, filter_bits, in_bitmap, mix, shuffle_partitions, sliding, small_batches, split_by, utf8

LENGTH = 100
GRAM = 32
MIN_BITS, MAX_BITS = 20, 29
ROLLING = 41


class Shape:
    """The sizes that follow from the length of a repeat."""

    def __init__(self, length: int):
        if length < 2 * GRAM:
            raise ValueError(f"length must be at least {2 * GRAM}")
        self.length = length
        self.width = length - GRAM + 1  # grams in a window
        self.reach = length - GRAM  # bytes of a context on either side of the anchor
        self.half = self.reach // 2


# --------------------------------------------------------------- anchors


def _anchors(raw: np.ndarray, shape: Shape, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's anchors; worked on in overlapping parts."""
    n = len(raw)
    if n < shape.length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    margin = shape.width + GRAM
    hashes, places = [], []
    for lo in range(0, n, CHUNK):
        a, b = max(0, lo - margin), min(n, lo + CHUNK + margin)
        part = raw[a:b]
        if len(part) < shape.length:
            continue
        h = rolling.windows(part)
        least = sliding(h, shape.width, np.minimum)
        pad = np.zeros(shape.width - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), shape.width, np.maximum) == h)
        own = (at + a >= lo) & (at + a < lo + CHUNK)
        hashes.append(h[at[own]])
        places.append(at[own] + a)
    return np.concatenate(hashes), np.concatenate(places)


def _context_hashes(raw: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    lo, hi = np.maximum(at - shape.reach, 0), np.minimum(at + shape.length, len(raw))
    text = memoryview(raw)
    out = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64)
    return mix(out ^ (at - lo).astype(np.uint64))  # a cut at an end of the text is part of the context


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    buf, offs = utf8(batch.column("text"))
    for i in range(batch.num_rows):
        yield i, buf[offs[i] : offs[i + 1]]


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal runs in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] > hi[:-1]
    last = np.append(first[1:], True)
    return lo[first], hi[last]


#: Rows on the way: anchors or places of a bucket, packed; frequent anchors, packed, with twin 1; or cuts of a document.
PACKED = "bucket int, rank long, twin int, packed binary, lo array<int>, hi array<int>"
CUTS = "rank long, twin int, lo array<int>, hi array<int>"


def _record(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


ENTRY = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("rank", "<i8"), ("twin", "<i4"), ("at", "<i4"), ("after", "<u2")])


def _planes(values: np.ndarray) -> bytes:
    """Bytes by their place in the numbers: high ones are mostly zero and so go small."""
    return np.ascontiguousarray(np.frombuffer(values.tobytes(), np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).tobytes(), kind)


def _pack(entries: np.ndarray) -> bytes:
    entries = entries[np.argsort(entries["rank"], kind="stable")]
    step = np.diff(entries["rank"], prepend=np.int64(0))
    return entries["anchor"].tobytes() + entries["context"].tobytes() + _planes(step) + _planes(entries["twin"]) + _planes(entries["at"]) + _planes(entries["after"])


def _unpack(raw: bytes) -> np.ndarray:
    out = np.empty(len(raw) // ENTRY.itemsize, ENTRY)
    n, lo = len(out), 0
    for name, kind in (("anchor", "<u8"), ("context", "<u8"), ("rank", "<i8"), ("twin", "<i4"), ("at", "<i4"), ("after", "<u2")):
        part = raw[lo : lo + n * np.dtype(kind).itemsize]
        lo += len(part)
        out[name] = np.frombuffer(part, kind) if kind == "<u8" else np.cumsum(_unplanes(part, kind, n)) if name == "rank" else _unplanes(part, kind, n)
    return out


def _by_document(rank: np.ndarray, twin: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cuts, one row per document, with equal and touching ones united."""
    if not len(rank):
        return
    order = np.lexsort((lo, twin, rank))
    rank, twin, lo, hi = rank[order], twin[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (twin[1:] != twin[:-1])]))
    runs = [_merged(a, b) for a, b in zip(np.split(lo, first[1:]), np.split(hi, first[1:]))]
    yield _record(CUTS, rank=rank[first], twin=twin[first], lo=[r[0] for r in runs], hi=[r[1] for r in runs])


def _split_first(entries: np.ndarray, shape: Shape) -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
    """The first entry of each kind of context, and the whole later contexts as cuts."""
    e = entries[np.lexsort((entries["at"], entries["twin"], entries["rank"], entries["context"], entries["anchor"]))]
    first = np.ones(len(e), bool)
    first[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["context"][1:] != e["context"][:-1])
    of = e[np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))]
    later = e[(e["rank"] != of["rank"]) | (e["twin"] != of["twin"]) | (e["at"] != of["at"])]
    at = later["at"].astype(np.int64)
    before = np.minimum(at, shape.reach)
    long = before + later["after"] >= shape.length
    cuts = _by_document(later["rank"][long], later["twin"][long], (at - before)[long], (at + later["after"])[long])
    return e[first], cuts


def _passed(cuts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in cuts:
        # dealt out by document, so that cuts spread over all tasks
        place = _where(c.column("rank").to_numpy(), c.column("twin").to_numpy(), np.zeros(c.num_rows, np.int64))
        columns = [pa.array((place >> np.uint64(33)).astype(np.int32)), c.column("rank"), c.column("twin"), pa.nulls(c.num_rows, pa.binary()), c.column("lo"), c.column("hi")]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "rank", "twin", "packed", "lo", "hi"])


def _scan(buckets: int, shape: Shape):
    def flush(parts):
        firsts, cuts = _split_first(np.concatenate(parts), shape)
        yield from _passed(cuts)
        anchors, where, count = np.unique(firsts["anchor"], return_inverse=True, return_counts=True)
        frequent = anchors[count >= FREQUENT]
        if len(frequent):
            yield _record(PACKED, bucket=[int(frequent[0] >> np.uint64(40)) % buckets], twin=[1], packed=[frequent.tobytes()])
            firsts = firsts[count[where] < FREQUENT]
        bucket = (firsts["anchor"] >> np.uint64(40)).astype(np.int64) % buckets
        firsts = firsts[np.argsort(bucket, kind="stable")]
        size = np.bincount(bucket, minlength=buckets)
        ends = np.cumsum(size)
        some = np.flatnonzero(size).tolist()
        yield _record(PACKED, bucket=some, packed=[_pack(firsts[ends[b] - size[b] : ends[b]]) for b in some])

    def run(batches):
        rolling = Rolling(ROLLING, GRAM)
        parts, held = [], 0
        for batch in batches:
            ranks, twins = batch.column("rank").to_pylist(), batch.column("twin").to_pylist()
            for i, raw in _texts(batch):
                h, at = _anchors(raw, shape, rolling)
                if not len(at):
                    continue
                e = np.empty(len(at), ENTRY)
                e["anchor"], e["context"] = h, _context_hashes(raw, at, shape)
                e["rank"], e["twin"], e["at"] = ranks[i], twins[i], at
                e["after"] = np.minimum(len(raw) - at, shape.length)
                parts.append(e)
                held += len(e)
                if held >= 1 << 20:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _kinds(shape: Shape):
    """Per anchor: cuts for the contexts seen before, and what still needs bytes."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            entries = pc.and_(pc.is_valid(batch.column("packed")), pc.is_null(batch.column("twin")))
            passed = batch.filter(pc.invert(entries))
            if passed.num_rows:
                yield passed
            batch = batch.filter(entries)
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                found.setdefault(bucket, []).append(packed)
        for bucket in list(found):
            firsts, cuts = _split_first(np.concatenate([_unpack(p) for p in found.pop(bucket)]), shape)
            yield from _passed(cuts)
            new = np.ones(len(firsts) + 1, bool)
            new[1:-1] = firsts["anchor"][1:] != firsts["anchor"][:-1]
            need = firsts[~(new[:-1] & new[1:])]  # anchors with one kind of context are done
            if len(need):
                yield _record(PACKED, bucket=[bucket], packed=[_where(need["rank"], need["twin"], need["at"]).tobytes()])

    return run


def _filter_place(key: np.ndarray, log_bits: int) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - log_bits)).astype(np.int64)


def _frequent_places(log_bits: int):
    def run(batches):
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_filter_place(np.frombuffer(packed, np.uint64), log_bits))], names=["place"])

    return run


def _where(rank: np.ndarray, twin: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(rank.astype(np.uint64) ^ (twin.astype(np.uint64) << np.uint64(32))) ^ at.astype(np.uint64))


def _places(where: np.ndarray, log_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Three places in the filter for each key: segment and bit in it."""
    segment = ((where >> np.uint64(20)) & np.uint64((1 << (log_bits - 16)) - 1)).astype(np.int64)
    for i in range(3):
        yield segment, (mix(where + np.uint64(i + 1)) & np.uint64(0xFFFF)).astype(np.int64)


def _filter_bits(log_bits: int):
    """The needed places as bits of a filter, by segments of 2 ** 16 bits."""

    def run(batches):
        mine = np.zeros((1 << (log_bits - 16), 1 << 13), np.uint8)
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                for segment, bit in _places(np.frombuffer(packed, np.uint64), log_bits):
                    np.bitwise_or.at(mine.ravel(), segment * (1 << 13) + (bit >> 3), np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)))
        for s in np.flatnonzero(mine.any(axis=1)).tolist():
            yield _record("segment int, bits binary", segment=[s], bits=[zlib.compress(mine[s].tobytes(), 1)])

    return run


def _merge_bits(batches):
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, bits in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist()):
            bits = np.frombuffer(zlib.decompress(bits), np.uint8)
            found[s] = bits if s not in found else found[s] | bits
    for s, bits in found.items():
        yield _record("segment int, bits binary", segment=[s], bits=[zlib.compress(bits.tobytes(), 1)])


#: Rows on the way: contexts of a bucket, packed, to be counted (open) or not; or cuts of a document.
CONTEXTS = "bucket int, open int, packed binary, rank long, twin int, lo array<int>, hi array<int>"
#: A context on the way: its key, its range of window starts, where its anchor is, and how its bytes split there.
HEAD = np.dtype([("key", "<u8"), ("rank", "<i8"), ("twin", "<i4"), ("at", "<i4"), ("before", "<u2"), ("size", "<u2"), ("least", "<u2"), ("most", "<u2")])
#: Contexts that share a key and are looked at by one task.
CROWD = 4_096
#: Kinds of context round an anchor, among a million of a task, from which it counts as frequent.
FREQUENT = 1_024


def _key(common: bytes, least: int, most: int) -> int:
    return xxhash.xxh3_64_intdigest(common + bytes((least >> 8, least & 255, most >> 8, most & 255)))


def _packed_contexts(heads: list[tuple] | np.ndarray, parts: list[bytes], buckets: int, open_: int) -> Iterator[pa.RecordBatch]:
    head = np.array(heads, HEAD)
    bucket = ((head["key"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    for b in np.unique(bucket).tolist():
        own = np.flatnonzero(bucket == b).tolist()
        packed = len(own).to_bytes(4, "little") + head[own].tobytes() + b"".join(parts[i] for i in own)
        yield _record(CONTEXTS, bucket=[b], open=[open_], packed=[zlib.compress(packed, 1)])


def _unpacked_contexts(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, HEAD, n, 4), raw[4 + n * HEAD.itemsize :]


def _first_ones(heads: list[tuple], parts: list[bytes], length: int) -> tuple[list[tuple], list[bytes], Iterator[pa.RecordBatch]]:
    """The first of contexts that are equal within their range, and the later ones as cuts."""
    firsts: dict[tuple, tuple] = {}
    cut = []
    for new, part in zip(heads, parts):
        kind = (new[6], new[4], part)
        old = firsts.get(kind)
        if old is None or new[1:4] < old[1:4]:
            firsts[kind] = new
            old, new = new, old
        if new is not None and new[1:4] != old[1:4] and len(part) >= length:
            cut.append((new[1], new[2], new[3] - new[4], new[3] - new[4] + len(part)))
    return list(firsts.values()), [k[2] for k in firsts], _cuts_on(cut)


def _cuts_on(cut: list[tuple]) -> Iterator[pa.RecordBatch]:
    if cut:
        for c in _passed(_by_document(*(np.array(x, np.int64) for x in zip(*cut)))):
            yield _record(CONTEXTS, **{name: c.column(name).to_pylist() for name in ("bucket", "rank", "twin", "lo", "hi")})


def _contexts(shape: Shape, log_bits: int, buckets: int, shared, frequent_bits: int, frequent):
    """The contexts that are needed, for each half of the window starts; those of frequent anchors are open."""

    def flush(heads, parts, open_):
        if open_:
            heads, parts, cuts = _first_ones(heads, parts, shape.length)
            yield from cuts
        if heads:
            yield from _packed_contexts(heads, parts, buckets, open_)

    def run(batches):
        rolling = Rolling(ROLLING, GRAM)
        needed = shared.value
        reach, half, length = shape.reach, shape.half, shape.length
        heads, parts, held = ([], []), ([], []), 0
        for batch in batches:
            ranks, twins = batch.column("rank").to_pylist(), batch.column("twin").to_pylist()
            for i, raw in _texts(batch):
                h, at = _anchors(raw, shape, rolling)
                if not len(at):
                    continue
                yes = np.ones(len(at), bool)
                for segment, bit in _places(_where(np.full(len(at), ranks[i]), np.full(len(at), twins[i]), at), log_bits):
                    yes &= needed[segment * (1 << 13) + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1 > 0
                many = in_bitmap(frequent.value, _filter_place(h, frequent_bits))
                yes |= many
                text = raw.tobytes() if yes.any() else b""
                for p, open_ in zip(at[yes].tolist(), many[yes].tolist()):
                    for least, most in ((0, half), (half + 1, reach)):
                        if p < least or p + length - most > len(text):
                            continue
                        a = max(p - most, 0)
                        part = text[a : p + length - least]
                        heads[open_].append((_key(text[p - least : p + length - most], least, most), ranks[i], twins[i], p, p - a, len(part), least, most))
                        parts[open_].append(part)
                        held += len(part)
                if held >= 16 << 20:
                    for open_ in (0, 1):
                        yield from flush(heads[open_], parts[open_], open_)
                    heads, parts, held = ([], []), ([], []), 0
        for open_ in (0, 1):
            yield from flush(heads[open_], parts[open_], open_)

    return run


def _key_counts(batches):
    for batch in batches:
        for packed in batch.column("packed").to_pylist():
            keys, n = np.unique(_unpacked_contexts(packed)[0]["key"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def _crowd_places(log_bits: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_filter_place(batch.column("key").to_numpy().view(np.uint64), log_bits))], names=["place"])

    return run


def _narrowed(head: tuple, body: bytes, length: int) -> Iterator[tuple[tuple, bytes]]:
    """A context for each half of its window starts."""
    _, rank, twin, at, before, _, least, most = head
    middle = (least + most) // 2
    for lo, hi in ((least, middle), (middle + 1, most)):
        end = before + length - hi  # of the bytes that all these windows have
        if before < lo or end > len(body):
            continue
        a = max(before - hi, 0)
        part = body[a : before + length - lo]
        yield (_key(body[before - lo : end], lo, hi), rank, twin, at, before - a, len(part), lo, hi), part


def _split_crowds(shape: Shape, log_bits: int, buckets: int, shared):
    """Contexts with a crowded key, narrowed to halves of their window starts; all others are done."""

    def run(batches):
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                head, body = _unpacked_contexts(packed)
                ends = np.cumsum(head["size"].astype(np.int64))
                many = in_bitmap(shared.value, _filter_place(head["key"], log_bits)) & (head["least"] < head["most"])
                rest = np.flatnonzero(~many).tolist()
                if rest:
                    yield from _packed_contexts(head[rest], [body[ends[i] - head["size"][i] : ends[i]] for i in rest], buckets, 0)
                narrow = [x for i in np.flatnonzero(many).tolist() for x in _narrowed(head[i].item(), body[ends[i] - head["size"][i] : ends[i]], shape.length)]
                heads, parts, cuts = _first_ones([x for x, _ in narrow], [x for _, x in narrow], shape.length)
                yield from cuts
                if heads:
                    yield from _packed_contexts(heads, parts, buckets, 1)

    return run


# --------------------------------------------------------------- enhanced suffix array


class Repeats:
    """Maximal repeats of at least ``length`` bytes that run over given anchors.

    Member i has a context: left[i], the bytes before its anchor in reverse, and
    right[i], the bytes from the anchor on. Members are given in the order of
    their starts. ``groups`` yields (left length, right length, members).
    """

    def __init__(self, lefts: list[bytes], rights: list[bytes], length: int):
        self.lefts, self.rights, self.length = lefts, rights, length

    def groups(self) -> Iterator[tuple[int, int, list[int]]]:
        if len(self.rights) == 2:  # a tree of one interval
            left, right = _shared(*self.lefts), _shared(*self.rights)
            if left + right >= self.length:
                yield left, right, [0, 1]
            return
        order = sorted(range(len(self.rights)), key=self.rights.__getitem__)
        common = self._common(order, self.rights)
        for size, lo, hi, children in _intervals(common, GRAM):
            yield from self._left(order[lo:hi], size, [order[a:b] for a, b in children])

    def _common(self, order: list[int], strings: list[bytes]) -> list[int]:
        return _common_prefixes([strings[i] for i in order])

    def _left(self, members: list[int], right: int, children: list[list[int]]) -> Iterator[tuple[int, int, list[int]]]:
        """The repeats with that right extension: intervals of the left extensions."""
        least = self.length - right
        if len(members) < 2 or least > max(len(self.lefts[i]) for i in members):
            return
        child = {i: k for k, part in enumerate(children) for i in part}
        order = sorted(members, key=self.lefts.__getitem__)
        common = self._common(order, self.lefts)
        for size, lo, hi, inner in _intervals(common, max(least, 0)):
            group = order[lo:hi]
            # right-diverse too: else the same members extend further, and the child yields them
            if len({child.get(i, -1 - i) for i in group}) > 1:
                yield size, right, sorted(group)


def _common_prefixes(strings: list[bytes]) -> list[int]:
    """Lengths of the common prefixes of neighbours in a sorted list."""
    if len(strings) < 2:
        return []
    width = max(1, *map(len, strings))
    out = np.empty(len(strings) - 1, np.int64)
    for lo in range(0, len(strings) - 1, 4096):
        part = strings[lo : lo + 4097]
        table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(len(part), width)
        sizes = np.array([len(s) for s in part])
        differ = table[1:] != table[:-1]
        run = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[lo : lo + len(part) - 1] = np.minimum(run, np.minimum(sizes[1:], sizes[:-1]))
    return out.tolist()


def _intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """The interval tree of a sorted list, by a stack scan of its common prefixes.

    Yields (prefix length, lo, hi, child intervals) for each interval of two or
    more neighbours that share a prefix of ``least`` or more, children first.
    """
    stack: list[list] = []  # prefix length, lo, children
    for i, size in enumerate([*common, -1], 1):
        lo, last = i - 1, None
        while stack and stack[-1][0] > size:
            prefix, lo, children = stack.pop()
            if last is not None:
                children.append(last)
            if prefix >= least:
                yield prefix, lo, i, children
            last = (lo, i)
        if size < 0:
            return
        if stack and stack[-1][0] == size:
            if last is not None:
                stack[-1][2].append(last)
        else:
            stack.append([size, lo, [] if last is None else [last]])


def _repeat_cuts(length: int):
    def run(batches):
        heads, bodies = [], []
        for batch in batches:
            done = batch.filter(pc.is_null(batch.column("packed")))
            if done.num_rows:
                yield done.select(["rank", "twin", "lo", "hi"])
            for packed in batch.column("packed").drop_null().to_pylist():
                head, body = _unpacked_contexts(packed)
                heads.append(head)
                bodies.append(body)
        if not heads:
            return
        head, body = np.concatenate(heads), b"".join(bodies)
        del heads, bodies
        ends = np.cumsum(head["size"].astype(np.int64))
        order = np.lexsort((head["at"], head["twin"], head["rank"], head["key"]))
        head, ends = head[order], ends[order]
        same = np.zeros(len(head), bool)  # rows repeated in the input
        same[1:] = (head[1:] == head[:-1])
        head, ends = head[~same], ends[~same]
        starts = ends - head["size"]
        key = head["key"]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at, before = head["at"].tolist(), head["before"].tolist()
        starts, ends = starts.tolist(), ends.tolist()
        who, lo, hi = [], [], []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)]):
            if b - a < 2:
                continue
            lefts = [body[starts[i] : starts[i] + before[i]][::-1] for i in range(a, b)]
            rights = [body[starts[i] + before[i] : ends[i]] for i in range(a, b)]
            # longer repeats come first: of a member's repeats only those that reach further left add a cut
            furthest = [-1] * (b - a)
            for left, right, members in Repeats(lefts, rights, length).groups():
                for m in members[1:]:
                    if left > furthest[m]:
                        furthest[m] = left
                        who.append(a + m)
                        lo.append(at[a + m] - left)
                        hi.append(at[a + m] + right)
                if len(who) > 1 << 16:
                    yield from _by_document(head["rank"][who], head["twin"][who], np.array(lo, np.int64), np.array(hi, np.int64))
                    who, lo, hi = [], [], []
        if who:
            yield from _by_document(head["rank"][who], head["twin"][who], np.array(lo, np.int64), np.array(hi, np.int64))

    return run


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


# --------------------------------------------------------------- results


def _apply(batches):
    for batch in batches:
        sums, removed, spans, texts, sizes = [], [], [], [], []
        los, his = batch.column("los").to_pylist(), batch.column("his").to_pylist()
        for i, raw in _texts(batch):
            lo, hi = _merged(*(np.array([x for part in (side[i] or ()) for x in part], np.int64) for side in (los, his)))
            left = raw.tobytes()
            if len(lo):
                left = b"".join(left[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]))
            sizes.append(len(raw))
            removed.append(len(raw) - len(left))
            spans.append(len(lo))
            sums.append(hashlib.sha256(left).hexdigest())
            texts.append(left)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _uncrowded(contexts: DataFrame, shape: Shape, buckets: int, stage: Stage) -> DataFrame:
    """The contexts, with crowded keys narrowed down, and the cuts that showed on the way."""
    contexts = stage.put(contexts, "contexts-0")
    done = []
    for turn in range(1, shape.length.bit_length() + 1):  # a range of one window can't be halved
        open_ = contexts.filter("open = 1 and packed is not null")
        counts = open_.select("packed").mapInArrow(_key_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        crowded = stage.put(counts.filter(F.col("n") > CROWD).select("key"), f"crowded-{turn}")
        n = crowded.count()
        if not n:
            break
        done.append(contexts.filter("open is null or open = 0"))
        log_bits = filter_bits(n)
        shared = contexts.sparkSession.sparkContext.broadcast(bitmap(crowded.mapInArrow(_crowd_places(log_bits), "place long"), log_bits))
        contexts = stage.put(open_.mapInArrow(_split_crowds(shape, log_bits, buckets, shared), CONTEXTS), f"contexts-{turn}")
    return reduce(DataFrame.unionByName, [*done, contexts])


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes left.

    kept is binary: a cut may fall inside a character.
    """
    spark, shape = small_batches(docs).sparkSession, Shape(length)
    stage = Stage(spark, "suffix")
    buckets = shuffle_partitions(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rank"), F.hash(text).alias("twin"), text.alias("text"))
    ranked = texts.select("rank", "twin", "text")

    scanned = ranked.mapInArrow(_scan(4 * buckets, shape), PACKED)
    kinds = stage.put(scanned.repartition(buckets, "bucket").mapInArrow(_kinds(shape), PACKED), "kinds")
    often = kinds.filter("packed is not null and twin = 1").select("packed")
    count = often.agg(F.sum(F.length("packed"))).first()[0] or 0
    frequent_bits = filter_bits(count // 8)
    frequent = spark.sparkContext.broadcast(bitmap(often.mapInArrow(_frequent_places(frequent_bits), "place long"), frequent_bits))
    need = kinds.filter("packed is not null and twin is null").select("packed")
    count = need.agg(F.sum(F.length("packed"))).first()[0] or 0
    log_bits = min(max((2 * count).bit_length(), MIN_BITS), MAX_BITS)  # 16 to 32 bits for each
    bits = "segment int, bits binary"
    filters = need.mapInArrow(_filter_bits(log_bits), bits).repartition(buckets, "segment").mapInArrow(_merge_bits, bits)
    needed = np.zeros(1 << (log_bits - 3), np.uint8)
    for segment, packed in filters.collect():  # at most 2 ** MAX_BITS bits
        needed[segment << 13 : (segment + 1) << 13] = np.frombuffer(zlib.decompress(packed), np.uint8)
    shared = spark.sparkContext.broadcast(needed)

    contexts = _uncrowded(ranked.mapInArrow(_contexts(shape, log_bits, 4 * buckets, shared, frequent_bits, frequent), CONTEXTS), shape, 4 * buckets, stage)
    found = stage.put(contexts.repartition(buckets, "bucket").mapInArrow(_repeat_cuts(length), CUTS), "repeats")

    cuts = kinds.filter("lo is not null").select("rank", "twin", "lo", "hi").unionByName(found)
    cuts = stage.put(cuts.groupBy("rank", "twin").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")), "cuts")
    stage.keep("cuts")
    some, whole = split_by(texts, F.struct("rank", "twin"), cuts.select(F.struct("rank", "twin").alias("key")))
    # a sort-merge join at every size: the cuts grow with the corpus, so none is broadcast
    out = some.join(cuts.hint("merge"), ["rank", "twin"], "left").select("doc_id", "text", "los", "his")
    out = out.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    raw, none = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.lit(0).cast("long")
    whole = whole.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return whole.union(out)


def suffix_report(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).drop("kept")
