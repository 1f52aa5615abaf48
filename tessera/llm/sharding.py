"""Shards along a Hilbert curve, for pruning files by several dimensions.

Law: ``rows``. Shard sizes in rows are at most one apart.

How it runs, with DataFrame functions only. Metadata columns are turned into
numbers that keep their order (strings by 7 bytes after those that all share) and
quantised at their own quantiles into 2 ** BITS cells. The cell's index on the
Hilbert curve, worked out once per cell, orders the rows, then the text's checksum and the id, so equal texts of equal
metadata lie side by side. A range partitioning sorts; a count per partition
gives each row its place in the whole, and runs of places are the shards. No
task gets more than a range of rows, and ranges split within a hot value, down
to rows that are the same in all they have.

Defined cases: a null text has no bytes. Null metadata sorts first. Null and
repeated doc_ids are rows like any. An empty table stays empty. Fewer rows than
shards leave shards empty. Columns that are not used as dimensions play no part.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import Stage, shuffle_partitions, small_batches

SHARDS, BITS = 24, 4
MAX_BROADCAST_BITS = 18  # a table of at most so many cells, 4 MB, is broadcast
DIMENSIONS = ("source", "lang", "size", "doc_id")


def _number(value: Column, shared: int) -> Column:
    """A number in the order of strings: 7 bytes after those that all of them share."""
    first = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), shared + 1, 7)), 14, "0")
    return F.conv(first, 16, 10).cast("double")


def _shared_bytes(least: str | None, greatest: str | None) -> int:
    """How many first bytes all strings between these two share."""
    return len(os.path.commonprefix([(least or "").encode(), (greatest or "").encode()]))


def _cell(value: Column, bounds: list[float]) -> Column:
    """The number of bounds below the value; null: 0."""
    return sum((F.coalesce((value > F.lit(float(b))).cast("int"), F.lit(0)) for b in bounds), F.lit(0))


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell, by its coordinates of ``bits`` bits.

    A fold over (bit, axis) pairs undoes the curve's exchanges and inversions,
    a Gray code follows, and the bits are interleaved.
    """
    n = len(cells)

    def step(x: Column, s: Column) -> Column:
        low, axis = s["q"] - 1, s["axis"]
        own, zero = F.element_at(x, axis + 1), F.element_at(x, 1)
        swap = zero.bitwiseXOR(own).bitwiseAND(low)
        return F.when(own.bitwiseAND(s["q"]) != 0, F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))).otherwise(
            F.transform(x, lambda v, k: F.when(((k == 0) | (k == axis)) & (axis != 0), v.bitwiseXOR(swap)).otherwise(v))
        )

    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("axis")) for b in range(bits - 1, 0, -1) for i in range(n)))
    undone = F.aggregate(steps, F.array(*(c.cast("int") for c in cells)), step)

    def gray(x: Column) -> Column:
        # each coordinate with all before it, then the last one's higher bits on all
        folded = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(x, 1, k), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
        turn = F.aggregate(
            F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.lit(0), lambda t, q: F.when(F.element_at(folded, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )
        return F.transform(folded, lambda v: v.bitwiseXOR(turn))

    order = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("axis")) for b in range(bits - 1, -1, -1) for i in range(n)))
    return F.aggregate(
        order,
        F.struct(gray(undone).alias("x"), F.lit(0).cast("long").alias("index")),
        lambda a, o: F.struct(a["x"].alias("x"), (a["index"] * 2 + F.when(F.element_at(a["x"], o["axis"] + 1).bitwiseAND(o["q"]) != 0, 1).otherwise(0)).alias("index")),
        lambda a: a["index"],
    )


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index."""
    spark = small_batches(docs).sparkSession
    stage = Stage(spark, "hilbert")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    kinds = dict(docs.dtypes)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        *((size if d == "size" else F.col(d) if kinds[d] == "string" else F.col(d).cast("double")).alias(f"d{i}") for i, d in enumerate(dimensions)),
    )
    rows = stage.put(rows, "rows")

    n = len(dimensions)
    strings = [i for i, d in enumerate(dimensions) if d != "size" and kinds[d] == "string"]
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *(f(f"d{i}").alias(f"{name}{i}") for i in strings for f, name in ((F.min, "min"), (F.max, "max")))).first()
    values = [_number(F.col(f"d{i}"), _shared_bytes(ends[f"min{i}"], ends[f"max{i}"])) if i in strings else F.col(f"d{i}") for i in range(n)]
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.agg(*(F.percentile_approx(v, cuts).alias(f"d{i}") for i, v in enumerate(values))).first()
    cell = sum((F.shiftleft(_cell(v, found[i] or []).cast("long"), bits * i) for i, v in enumerate(values)), F.lit(0).cast("long"))
    rows = rows.select("doc_id", "size", "text_crc32", cell.alias("cell"))
    # the curve is a function of the cell: worked out once for each of at most 2 ** (bits * n) cells
    axes = [F.shiftright("cell", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(n)]
    curve = rows.select("cell").distinct().repartition(min(shuffle_partitions(spark), 32), "cell").select("cell", hilbert_index(axes, bits).alias("curve"))
    curve = stage.put(curve, "curve")
    placed = rows.join(F.broadcast(curve) if bits * n <= MAX_BROADCAST_BITS else curve, "cell").drop("cell")

    # the range partitioning is written with its partition's number, so all that follows sees one order
    order = ["curve", "text_crc32", "doc_id", "size"]
    ranged = placed.repartitionByRange(shuffle_partitions(spark), *order).withColumn("range", F.spark_partition_id())
    ranged = stage.put(ranged, "ranged")
    stage.keep("ranged")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    total = ends["n"]

    place = F.col("before") + F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1
    out = ranged.join(F.broadcast(counts), "range").withColumn("place", place)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        out.withColumn("shard", shard)
        .withColumn("slot", (F.col("place") - first).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
