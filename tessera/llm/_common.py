"""Shared helpers: Arrow text access and vectorised hashing.

Text is handled as UTF-8 bytes in numpy. Every byte of a non-ASCII character is
0x80 or more, so classes of ASCII characters can be tested bytewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import Stage, shuffle_partitions

__all__ = [
    "CHUNK", "Rolling", "SPACES", "Stage", "bitmap", "chunks", "documents", "filter_bits", "fresh",
    "grams", "in_bitmap", "maybe_among", "mix", "separators", "shuffle_partitions", "sliding",
    "small_batches", "span_hashes", "split_by", "utf8", "winnow", "without", "word_hashes",
]

#: Bytes of text that numpy works on at a time.
CHUNK = 1 << 18
#: Spans of more bytes are hashed one at a time.
LONG = 64
#: ASCII white space of the word and line rules: space and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "128", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "1m"}
#: A-Z to a-z, other bytes as they are.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


# --------------------------------------------------------------- tables


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that moves long texts in small batches.

    A batch of Spark's usual size holds tens of megabytes of text, several times
    over, in each task. Settings that the session has of its own stay.
    """
    conf = df.sparkSession.conf
    for key, value in SMALL_BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df


def documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text as string; other columns play no part."""
    small_batches(df)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Bits of a filter of ids: at least and at most (64 MB).
MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 29
FILTER_HASHES, BITS_PER_ID = 2, 16
#: Bits of one bitmap of Spark's.
BITMAP_BITS = 8 * 4096


def filter_bits(n: int) -> int:
    """The binary logarithm of a filter's size for n keys."""
    return min(max((BITS_PER_ID * n).bit_length(), MIN_FILTER_BITS), MAX_FILTER_BITS)


def bitmap(places: DataFrame, log_bits: int) -> np.ndarray:
    """The bits at the places in the column ``place``, on the driver: 2 ** MAX_FILTER_BITS at most."""
    maps = places.groupBy(F.expr(f"place div {BITMAP_BITS}").alias("map")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits"))
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    for k, own in maps.collect():
        bits[k * BITMAP_BITS // 8 : (k + 1) * BITMAP_BITS // 8] = np.frombuffer(own, np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def filter_places(key: Column, log_bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 64 - log_bits) for k in range(FILTER_HASHES)]


def maybe_among(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of values against the single column of ``keys`` (a written table).

    It is true for each of them and for few others, null being a value like any.
    The filter has BITS_PER_ID bits per key and at most 2 ** MAX_FILTER_BITS;
    past that it is true for more, so users of it must confirm.
    """
    log_bits = filter_bits(keys.count())
    places = keys.select(F.explode(F.array(*filter_places(F.col(keys.columns[0]), log_bits))).alias("place"))
    shared = keys.sparkSession.sparkContext.broadcast(bitmap(places, log_bits))

    @F.arrow_udf("boolean")
    def test(first: pa.Array, second: pa.Array) -> pa.Array:
        one, two = (in_bitmap(shared.value, x.to_numpy(zero_copy_only=False)) for x in (first, second))
        return pa.array(one & two)

    return lambda key: test(*filter_places(key, log_bits))


def split_by(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df that may have one of the keys, and those that surely have none.

    Only the first need meet ``keys``: the others are never shuffled.
    """
    test = maybe_among(keys)(key)
    return df.filter(test), df.filter(~test)


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is none of ``keys``, a written table of one column."""
    some, none = split_by(df, key, keys)
    (name,) = fresh(df, "key")
    # keys grow with the corpus, so none are broadcast; hashing a part's keys spares the texts a sort
    left = some.join(keys.toDF(name).hint("shuffle_hash"), key.eqNullSafe(F.col(name)), "left_anti")
    return none.union(left)


# --------------------------------------------------------------- Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def long_array(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


# --------------------------------------------------------------- hashing


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of buf[starts:ends], eight bytes at a time through ``mix``.

    A span of eight bytes or less can't collide with one of its length. Spans
    longer than LONG bytes go to XXH3.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(_mix_int(seed)))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        h = mix(h ^ (eights[at] & FIRST_BYTES[np.minimum(left, 8)]))
        more = left > 8
        out[live[~more]] = h[~more]
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    raw = memoryview(buf)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[int(starts[i]) : int(ends[i])], seed)
    return out


class Rolling:
    """Polynomial hashes of all windows of a width, modulo 2 ** 64.

    They choose places and deal them out. Strings can be built that collide, so
    nobody may take equal hashes for equal bytes.
    """

    def __init__(self, seed: int, width: int):
        self.table = np.array([_mix_int(seed * 1000 + b) for b in range(256)], dtype=np.uint64)
        self.base = _mix_int(seed * 1000 + 777) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.width = width
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.up = _powers(self.base, n)
        self.down = _powers(self.inverse, n)

    def windows(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) + 1 > len(self.up):
            self._grow(max(len(buf) + 1, 2 * len(self.up)))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=sums[1:])
        return mix((sums[self.width :] - sums[: -self.width]) * self.down[: len(buf) - self.width + 1])


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64, by doubling."""
    out = np.ones(1, np.uint64)
    step = base % 2**64
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % 2**64
    return out[:n]


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def word_spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in rows laid end to end."""
    inside = ~sep[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offs] = True
    at = np.flatnonzero(edge)
    word = inside[at[:-1]] if len(buf) else np.empty(0, bool)
    return at[:-1][word], at[1:][word]


def word_hashes(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and the first word of each row (one entry more).

    A row longer than CHUNK is worked on in parts that end at a separator.
    """
    if len(buf) <= 2 * CHUNK or len(offs) > 2:
        starts, ends = word_spans(buf, offs, sep)
        return span_hashes(LOWER[buf], starts, ends, seed), np.searchsorted(starts, offs)
    out, lo = [], 0
    while lo < len(buf):
        hi = min(lo + CHUNK, len(buf))
        while hi < len(buf):  # on to the next separator
            ahead = np.flatnonzero(sep[buf[hi : hi + CHUNK]])
            if len(ahead):
                hi += int(ahead[0])
                break
            hi = min(hi + CHUNK, len(buf))
        part = buf[lo:hi]
        starts, ends = word_spans(part, np.array([0, len(part)]), sep)
        out.append(span_hashes(LOWER[part], starts, ends, seed))
        lo = hi
    words = np.concatenate(out)
    return words, np.array([0, len(words)])


def grams(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of every k successive words; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] ^ np.uint64(_mix_int(seed * 100 + k))
    for j in range(1, k):
        out = mix(out) ^ words[j : j + n]
    return mix(out)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each window of that width."""
    out, n = values, 1
    while 2 * n <= width:
        out = best(out[:-n], out[n:])
        n *= 2
    if n < width:
        out = best(out[: n - width], out[width - n :])
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the minimum of some window of that width; all of a tie.

    Fewer hashes than the width are one window.
    """
    if not len(hashes):
        return np.empty(0, np.int64)
    width = min(width, len(hashes))
    least = sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)
