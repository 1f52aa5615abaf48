"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct shingles of ``words`` successive words (A-Z
lower-cased, words cut at ASCII white space); a text of fewer words is one
shingle. Documents whose sets have a Jaccard similarity of ``threshold`` or more
are linked; a group is a connected component of links.

How it runs. Documents with the same set are one class, so copies never meet
each other. The SuperMinHash signatures of classes are cut into bands. The band
count is set so that a pair at the threshold is missed with a probability of at
most ``MISS``.

1. The centre of a bucket is the member that meets most others over all bands.
   Each class is tested against the centre that it shares most bands with. Links
   are confirmed on the full sets: a centre's set goes once to each SPOKES of
   its members. Components follow.
2. In each bucket that still holds several components, members outside the
   centre's component (strangers) are compared with all others of other
   components, in cells of BLOCK strangers by BLOCK members: by signature
   (SIGMAS standard deviations of leeway) and by 16-bit prints of the full sets,
   which never miss a link. Pairs that are left are confirmed on the full sets
   too. Pairs within one component need no test, as no component depends on them.
3. Components again, over all confirmed links.

Components are found by union-find within tasks, then by large-star and
small-star rounds between them; every round is written to the shared folder.

Defined cases: null text, or text without words: an empty set, linked with
nothing. A null doc_id is greater than any other: a component of only such
documents has a null id and keeps its rows. Rows that share a doc_id are
documents of their own; each row with the component's id is kept. An empty
table stays empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import SPACES, Stage, chunks, documents, grams, mix, separators, shuffle_partitions, split_by, utf8, without, word_hashes

SLOTS = 128
MISS = 1e-7
SIGMAS = 6.5
BLOCK = 1024  # members of a bucket that are compared with as many others at a time
SPOKES = 16  # members that meet one copy of their centre's set
MAX_TURNS = 100  # of the search for components; a path of n links takes some log(n)
HASHER, SHINGLE = 101, 7


def rows_per_band(threshold: float) -> int:
    """The most rows a band can have, at the permitted chance to miss a pair."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (SLOTS // r) <= MISS]
    return max(fit, default=1)


def least_matches(threshold: float) -> int:
    """Equal signature slots that a pair at the threshold all but surely has."""
    return max(1, int(SLOTS * threshold - SIGMAS * (SLOTS * threshold * (1 - threshold)) ** 0.5))


# --------------------------------------------------------------- sets and signatures


def shingle_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's distinct shingles as sorted hashes."""
    sep = separators(SPACES)
    buf, offs = utf8(batch.column("text"))
    for lo, hi in chunks(offs):
        h, first = word_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], sep, HASHER)
        for i in range(hi - lo):
            own = h[first[i] : first[i + 1]]
            yield lo + i, np.unique(grams(own, min(words, max(len(own), 1)), SHINGLE))


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of SLOTS numbers for non-empty sets.

    Each element walks a random permutation of the slots; step j offers j plus
    a random fraction to the slot it meets. All elements take a step together,
    and a set is done when its greatest slot is below the next step: later steps
    offer more. Numbers are held as j * 2**32 plus the fraction's 32 bits.
    """
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    flat = out.ravel()
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets)
    low = np.uint64(0xFFFFFFFF)
    half = np.uint64(32)
    walk = None
    for j in range(SLOTS):
        r = mix(element + np.uint64(j * 0x632BE59BD9B4E019 % 2**64))
        pick = j + (((r >> half) * np.uint64(SLOTS - j)) >> half).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            if walk is None:  # only now, as most sets are done after the first step
                walk = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(element), 1))
                rows = np.arange(len(element))
                walk[rows, first], walk[:, 0] = 0, first
            rows = np.arange(len(element))
            slot = walk[rows, pick].astype(np.int64)
            walk[rows, pick] = walk[:, j]
            walk[:, j] = slot
        np.minimum.at(flat, owner * SLOTS + slot, np.uint64(j << 32) | (r & low))
        open_ = out.max(axis=1) >= np.uint64((j + 1) << 32)
        if not open_.any():
            break
        stay = open_[owner]
        owner, element, first = owner[stay], element[stay], slot[stay]
        if walk is not None:
            walk = walk[stay]
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    bands = SLOTS // rows
    out = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            key = mix(key ^ signatures[:, i])
        out[:, b] = key
    return out


def short_signatures(signatures: np.ndarray) -> np.ndarray:
    """One byte per slot, to estimate similarity with."""
    return (mix(signatures) >> np.uint64(56)).astype(np.uint8)


def _sign(words: int, rows: int):
    def signed(sets: list[np.ndarray]) -> tuple[list, list]:
        s = super_minhash(sets)
        return [x.view(np.int64) for x in band_keys(s, rows)], [x.tobytes() for x in short_signatures(s)]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size, digest, bands, short = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n
            seen, todo, held = set(), [], 0
            for row, s in shingle_sets(batch, words):
                size[row] = len(s)
                if not len(s):
                    continue
                digest[row] = key = xxhash.xxh3_128_digest(s.tobytes())
                if key in seen:  # a copy's signature is the same
                    continue
                seen.add(key)
                todo.append((row, s))
                held += len(s)
                if held > 200_000:
                    for (r, _), b, t in zip(todo, *signed([x for _, x in todo])):
                        bands[r], short[r] = b, t
                    todo, held = [], 0
            if todo:
                for (r, _), b, t in zip(todo, *signed([x for _, x in todo])):
                    bands[r], short[r] = b, t
            columns = [pa.array(size), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_shingles", "digest", "bands", "short"])

    return run


# --------------------------------------------------------------- components


def _local_forest(batches):
    """Union-find over a task's links; each node with its least node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(parent)]
    rows = [r for r in rows if r[0] != r[1]]
    for lo in range(0, len(rows), 10_000):
        part = rows[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """node and root (the least node reachable) for every node that has a link."""
    star = stage.put(links.select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct(), f"{name}-0")
    before = None
    for turn in range(1, MAX_TURNS + 1):
        # large star: what is greater than a node goes to the least of its neighbours
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: what is smaller than a node, and the node itself, goes to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        star = stage.put(small, f"{name}-{turn}")
        now = star.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        stage.drop(f"{name}-{turn - 1}")
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {MAX_TURNS} turns")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


# --------------------------------------------------------------- links


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            yes = [_linked(*(np.frombuffer(side[i].as_buffer(), np.uint64) for side in (a, b)), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    one = sets.select(F.col("cls").alias("b"), F.col("members").alias("set_b")).hint("merge")
    two = sets.select(F.col("cls").alias("a"), F.col("members").alias("set_a")).hint("merge")
    return pairs.join(one, "b").join(two, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")


def _confirm_stars(percent: int):
    """The links of centres with the members after them, in rows sorted by centre and part."""

    def run(batches):
        key = centre = None
        for batch in batches:
            table = {c: batch.column(c).to_pylist() for c in ("a", "part", "spoke")}
            sets, yes = batch.column("members"), np.zeros(batch.num_rows, bool)
            for i, (a, part, spoke) in enumerate(zip(table["a"], table["part"], table["spoke"])):
                own = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if not spoke:
                    key, centre = (a, part), own.copy()
                elif key != (a, part):
                    raise AssertionError("a centre's set is missing")
                else:
                    yes[i] = _linked(centre, own, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes))

    return run


def _star_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between centres and members; a centre goes to each part of its members."""
    spokes = sets.filter("centre is not null").select(F.col("centre").alias("a"), "part", F.lit(True).alias("spoke"), F.col("cls").alias("b"), "members")
    centres = sets.filter("parts is not null").select(F.col("cls").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("spoke"), F.col("cls").alias("b"), "members")
    dealt = spokes.union(centres).repartition(shuffle_partitions(sets.sparkSession), "a", "part").sortWithinPartitions("a", "part", "spoke")
    return dealt.mapInArrow(_confirm_stars(percent), "a long, b long")


def prints(members: np.ndarray) -> bytes:
    """The distinct 16-bit prints of a set: common members have common prints."""
    return np.unique((members >> np.uint64(48)).astype(np.uint16)).tobytes()


def _cross_pairs(least: int, percent: int):
    """Pairs of a cell: its strangers with members of other components that can be links.

    A cell has a block of strangers and a block of members. Sizes, then
    signatures, then prints are tested. The last test is sound: no more members
    are common than prints of one set, counted with their members, are met by
    the other; its bound is so close that nearly all pairs it leaves are links.
    """

    def pairs(ours, theirs):
        for cls_i, comp_i, size_i, short_i, fp_i in zip(*ours):
            cls, comp, size, short, fp = theirs
            other = np.flatnonzero((comp != comp_i) & (100 * np.minimum(size, size_i) >= percent * np.maximum(size, size_i)))
            if not len(other):
                continue
            near = other[(short[other] == short_i).sum(axis=1) >= least]
            if not len(near):
                continue
            mine = np.zeros(1 << 16, bool)
            mine[fp_i] = True
            for j in near.tolist():
                lost = len(fp[j]) - int(mine[fp[j]].sum())  # at least so many of j's members are not i's
                common = min(size[j] - lost, size_i)
                if 100 * common >= percent * (size_i + size[j] - common):
                    yield (int(cls_i), int(cls[j])) if cls_i < cls[j] else (int(cls[j]), int(cls_i))

    def columns(rows):
        cls, comp, size, short, fp = zip(*rows)
        return np.array(cls), np.array(comp), np.array(size), np.frombuffer(b"".join(short), np.uint8).reshape(len(rows), -1), [np.frombuffer(x, np.uint16) for x in fp]

    def emit(cell):
        if not all(cell):
            return
        found = sorted(set(pairs(*map(columns, cell))))
        for lo in range(0, len(found), 10_000):
            part = found[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])

    def run(batches):
        cell: tuple[list, list] = ([], [])
        key = None
        for batch in batches:
            table = batch.to_pydict()
            for *own, side, cls, comp, size, short, fp in zip(*(table[c] for c in ("bucket", "row", "col", "side", "cls", "comp", "n_shingles", "short", "prints"))):
                if own != key:
                    yield from emit(cell)
                    cell, key = ([], []), own
                cell[side].append((cls, comp, size, short, fp))
        yield from emit(cell)

    return run


def _cells(inside: DataFrame) -> DataFrame:
    """Members dealt to the cells of their bucket, a block of strangers by a block of members.

    Strangers stand in a row of cells, all members in a column; two blocks of
    strangers meet in one of their two cells only, above the diagonal or on it.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    # side 0: strangers, one cell per column; side 1: strangers below the diagonal are met from the other side
    row = F.transform(every, lambda k: F.struct(own.alias("row"), k.alias("col"), F.lit(0).alias("side")))
    col = F.transform(every, lambda k: F.struct(k.alias("row"), own.alias("col"), F.lit(1).alias("side")))
    upper = F.filter(col, lambda c: ~F.col("stranger") | (c["row"] <= c["col"]))
    cells = F.when(F.col("stranger"), F.concat(row, upper)).otherwise(upper)
    out = inside.withColumn("cell", F.explode(cells)).select("bucket", "cell.*", "cls", "comp", "n_shingles", "short", "prints")
    return out.repartition(shuffle_partitions(inside.sparkSession), "bucket", "row", "col").sortWithinPartitions("bucket", "row", "col")


def near_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "minhash")
    percent = round(100 * threshold)
    signed = documents(docs).mapInArrow(_sign(words, rows_per_band(threshold)), "doc_id long, n_shingles long, digest binary, bands array<long>, short binary")
    signed = stage.put(signed, "signed")

    # one class per set; its number is fixed by being written
    classes = signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands", True).alias("bands"), F.first("short", True).alias("short"))
    classes = stage.put(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    buckets = stage.put(classes.select("cls", F.explode("bands").alias("bucket")), "buckets")
    # the member that meets most others over all bands is at the centre of its bucket
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = stage.put(buckets.join(sizes, "bucket"), "crowd")
    stage.drop("buckets")
    meets = crowd.groupBy("cls").agg(F.sum("n").alias("meets"))
    ranked = crowd.join(meets, "cls")
    first = ranked.groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("cls")).alias("minus"))).alias("best")).select("bucket", (-F.col("best.minus")).alias("first"))
    members = stage.put(crowd.join(first, "bucket"), "members")
    stage.drop("crowd")

    shared = members.filter("cls <> first").groupBy("cls", "first").agg(F.count(F.lit(1)).alias("n"))
    stars = shared.groupBy("cls").agg(F.max(F.struct("n", (-F.col("first")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("a"), F.col("cls").alias("b"))
    parts = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("parts"))
    stars = stage.put(stars.join(parts, "a"), "stars")

    # full sets of the classes that share a bucket, from one row of each
    wanted = members.select("cls").distinct().join(classes.select("cls", "digest", "rep"), "cls")
    wanted = wanted.join(stars.select(F.col("b").alias("cls"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")), "cls", "left")
    wanted = stage.put(wanted.join(stars.select(F.col("a").alias("cls"), "parts").distinct(), "cls", "left"), "wanted")
    own = documents(docs).filter("text is not null")
    some, _ = split_by(own, F.col("doc_id"), stage.put(wanted.select("rep"), "reps"))
    texts = some.join(wanted.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id")
    kinds = "cls long, centre long, part int, parts int, members binary, prints binary"
    sets = texts.select("cls", "centre", "part", "parts", "digest", "text").mapInArrow(_wanted_sets(words), kinds)
    lost = wanted.filter("rep is null")  # only null ids hold these sets: found by the digest itself
    bare = lost.limit(1).count()
    if bare:
        found = own.filter("doc_id is null").select("text").mapInArrow(_digests_of(words), "digest binary, members binary, prints binary")
        sets = sets.unionByName(found.join(lost, "digest").select("cls", "centre", "part", "parts", "members", "prints"))
    if bare or signed.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # else each set comes once
        sets = sets.dropDuplicates(["cls"])
    sets = stage.put(sets, "sets")
    stage.drop("wanted", "reps")

    links = stage.put(_star_links(sets, percent), "links-1")
    comps = stage.put(components(links, stage, "forest-1"), "components-1")

    # second round: buckets that still hold several components
    labelled = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "first", "n", "cls", F.coalesce("root", "cls").alias("comp"))
    labelled = stage.put(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("cls") == F.col("first"), F.col("comp"))).alias("main")).filter("lo <> hi")
    inside = labelled.join(mixed.select("bucket", "main"), "bucket").withColumn("stranger", F.col("comp") != F.col("main"))
    inside = inside.join(classes.select("cls", "n_shingles", "short"), "cls").join(sets.select("cls", "prints").hint("merge"), "cls")
    crossed = _cells(inside).mapInArrow(_cross_pairs(least_matches(threshold), percent), "a long, b long").distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossed = stage.put(crossed.join(tried, ["a", "b"], "left_anti"), "crossed")
    more = stage.put(_confirmed(crossed, sets, percent), "links-2")
    comps = components(links.unionByName(more), stage, "forest-2")

    by_class = classes.select("cls", "digest", "rep").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    by_class = stage.put(by_class, "by-class")
    stage.keep("signed", "by-class")
    least = by_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = by_class.join(least, "root").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _digests_of(words: int):
    def run(batches):
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch, words)]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [digests, [s.tobytes() for s in sets], [prints(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["digest", "members", "prints"])

    return run


def _wanted_sets(words: int):
    """The set of a row, if it is the one the class stands for (ids can repeat)."""

    def run(batches):
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch, words)]
            raw = [s.tobytes() for s in sets]
            same = [xxhash.xxh3_128_digest(s) == d for s, d in zip(raw, batch.column("digest").to_pylist())]
            names = ["cls", "centre", "part", "parts"]
            table = [*(batch.column(c) for c in names), pa.array(raw, pa.binary()), pa.array([prints(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(table, names=[*names, "members", "prints"]).filter(pa.array(same, pa.bool_()))

    return run


def near_dedup(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay, one document of each group."""
    gone = near_groups(docs, words, threshold).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    gone = Stage(docs.sparkSession, "near-gone").put(gone, "ids")
    return without(docs, F.col("doc_id").cast("long"), gone)
