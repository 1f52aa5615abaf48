import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests_support import thue_morse
from tessera.llm._common import span_hashes
from tessera.llm.decontaminate import contamination_report, decontaminate
from tessera.llm.exact_dedup import CuckooIndex, exact_dedup, exact_groups
from tessera.llm.line_dedup import line_dedup, line_report
from tessera.llm.minhash_dedup import components, least_matches, near_dedup, near_groups, rows_per_band, super_minhash
from tessera.llm.suffix_dedup import Repeats, suffix_dedup, suffix_report


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ------------------------------------------------------------------ exact


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    return sorted((d, max(groups[lower(t)]), len(groups[lower(t)]), d == max(groups[lower(t)]), sha(lower(t))) for d, t in rows)


def test_exact_matches_brute_force(frame, corpus):
    got = sorted(map(tuple, exact_groups(frame(corpus, clash=True)).collect()))
    assert got == brute_exact(corpus)


def test_exact_nulls_and_repeated_rows(frame):
    rows = exact_groups(frame([(None, "A"), (1, "a"), (1, "a"), (None, "b"), (2, None), (3, "")])).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == Counter(
        [(None, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (None, None, 1, True), (2, 3, 2, False), (3, 3, 2, True)]
    )
    assert exact_dedup(frame([(None, "A"), (1, "a"), (1, "a")], clash=True)).count() == 1
    assert exact_groups(frame([])).count() == 0


def test_cuckoo_index_keeps_all_through_resizes_and_deletes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    index = CuckooIndex(buckets=2, kicks=8)
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.resizes > 3 and index.size == 3000
    assert all(index.get(k) == i for i, k in enumerate(keys))
    for k in keys[::3]:
        assert index.delete(k) and not index.delete(k)
    assert [index.get(k) for k in keys] == [None if i % 3 == 0 else i for i in range(3000)]
    index.insert(keys[1], "new")
    assert index.get(keys[1]) == "new" and index.size == 2000 == len(list(index.items()))
    # same fingerprint and buckets, another key: a hit needs the stored key
    twin = keys[1][:10] + bytes(22)
    assert index.get(twin) is None


def test_texts_of_one_digest_are_told_apart_by_their_content(monkeypatch):
    from tessera.llm import exact_dedup as module

    class Weak:
        def __init__(self, content):
            self.content = content

        def digest(self):
            return bytes(32)

    monkeypatch.setattr(module.hashlib, "sha256", Weak)
    texts = [b"one", b"two", b"one", b"three"]
    batch = pa.RecordBatch.from_pydict({"uid": list(range(4)), "doc_id": [5, 6, 7, 8], "key": [module.content_key(t) for t in texts]})
    (local,) = module._local_groups(4)([batch])
    out = [r for b in module._index_groups([local]) for r in b.to_pylist()]
    assert [(r["keep_id"], r["keep_uid"], r["group_size"]) for r in out] == [(7, 2, 2)]


def test_index_holds_one_bucket_at_a_time(monkeypatch):
    from tessera.llm import exact_dedup as module

    made, held = [], []

    class Counted(module.CuckooIndex):
        def __init__(self):
            super().__init__()
            made.append(self)

    def live(index):
        held.append(index.size)
        return iter(())

    monkeypatch.setattr(module, "CuckooIndex", Counted)
    monkeypatch.setattr(module, "_live", live)
    keys = [module.content_key(str(i).encode()) for i in range(4000)]
    batch = pa.RecordBatch.from_pydict({"uid": list(range(4000)), "doc_id": list(range(4000)), "key": keys})
    (local,) = module._local_groups(20)([batch])
    assert list(module._index_groups(local.sort_by("bucket").to_batches() if isinstance(local, pa.Table) else [local.sort_by("bucket")])) == []
    assert sum(held) == 4000 and max(held) < 300 and len(made) == 21


# ------------------------------------------------------------------ lines

ENDS = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_docs=5):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(line.strip(ENDS)) >= 40:
                holders[lower(line.strip(ENDS))].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(h := holders.get(lower(x.strip(ENDS)), ())) >= min_docs and max(h) != d)]
        out[d] = (len(lines), len(lines) - len(left), sha("\n".join(left)))
    return out


def test_lines_match_brute_force(frame, corpus):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_report(frame(corpus, clash=True)).collect()}
    assert got == brute_lines(corpus)
    assert sum(v[1] for v in got.values()) > 10


def test_lines_edges(frame):
    line = "x" * 40
    rows = [(None, line)] + [(i, line + "\n" + line) for i in range(4)] + [(3, "other\n" + line)]
    got = sorted((r.doc_id is not None, r.doc_id, r.text) for r in line_dedup(frame(rows, clash=True)).collect())
    assert got[0] == (False, None, "")
    assert [g[2] for g in got[1:4]] == ["", "", ""]
    assert sorted(g[2] for g in got[4:]) == ["other\n" + line, line + "\n" + line]
    assert line_report(frame([])).count() == 0


# ------------------------------------------------------------------ filters


def test_without_drops_the_keys_and_nothing_else(spark, frame):
    from pyspark.sql import functions as F

    from tessera.llm._common import Stage, maybe_among, without

    rows = [(i, f"t{i}") for i in range(3000)] + [(None, "null"), (7, "again")]
    gone = [i for i in range(0, 3000, 7)] + [None]
    keys = Stage(spark, "test").put(spark.createDataFrame([(g,) for g in gone], "doc_id long"), "keys")
    left = without(frame(rows, clash=True), F.col("doc_id"), keys)
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(3000) if i % 7] and left.columns == frame([], clash=True).columns
    # few others meet the keys
    among = frame(rows).filter(maybe_among(keys)(F.col("doc_id"))).collect()
    assert {r.doc_id for r in among} >= set(gone) and len(among) < len(gone) + 150
    none = Stage(spark, "test").put(keys.limit(0), "none")
    assert without(frame(rows), F.col("doc_id"), none).count() == len(rows)


# ------------------------------------------------------------------ suffixes


def brute_suffix(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                cut[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, x in zip(raw, cut) if not x)
        spans = sum(1 for i, x in enumerate(cut) if x and not (i and cut[i - 1]))
        out[d] = (len(raw), len(raw) - len(kept), spans, sha(kept))
    return out


def suffix_result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_report(df).collect()}


def test_suffix_matches_brute_force(frame, corpus):
    assert suffix_result(frame(corpus, clash=True)) == brute_suffix([(d, t or "") for d, t in corpus])


@pytest.mark.parametrize("seed", range(4))
def test_suffix_on_random_overlaps(frame, seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abé "), int(rng.integers(80, 260)))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            b = base[int(rng.integers(len(base)))]
            lo = int(rng.integers(0, len(b) // 2))
            parts.append(b[lo : lo + int(rng.integers(20, 260))])
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, "a" * 99), (103, "a" * 100)]
    assert suffix_result(frame(rows)) == brute_suffix(rows)


@pytest.mark.parametrize("size", [256, 1024, 4096])
def test_words_that_power_sums_take_as_equal(spark, frame, size):
    one, two = thue_morse(size)
    rows = [(1, one), (2, two), (3, f"x {one} y"), (4, f"x {two} y"), (5, one[64:] + two[:64])]
    assert suffix_result(frame(rows)) == brute_suffix(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(frame(rows), words=4).collect()}
    assert got == brute_near(rows, 4)
    items = [(7, one), (8, two[:64])]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination_report(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contamination(rows, items)


def test_span_hashes_differ_by_bytes_and_length():
    rng = np.random.default_rng(7)
    spans = {bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in (*range(1, 20), 63, 64, 65, 200) for _ in range(300)}
    spans |= {b"\0" * n for n in range(1, 80)}
    spans = sorted(spans)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    buf = np.frombuffer(b"".join(spans), np.uint8)
    assert len(np.unique(span_hashes(buf, starts, ends, 3))) == len(spans)
    # the place in the buffer plays no part
    moved = span_hashes(np.frombuffer(b"zzz" + b"".join(spans), np.uint8), starts + 3, ends + 3, 3)
    assert (moved == span_hashes(buf, starts, ends, 3)).all() and (moved != span_hashes(buf, starts, ends, 4)).all()


def test_texts_of_several_mib(spark, frame):
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(40_000)])
    long = " ".join(rng.choice(vocabulary, 500_000))  # 3 MiB
    again = long[:1_400_000] + " " + " ".join(rng.choice(vocabulary, 30)) + long[1_400_000:]
    rows = [(1, long), (2, again), (3, long[700_000:700_400]), (4, None)]
    assert suffix_result(frame(rows)) == brute_suffix(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(frame(rows), words=4).collect()}
    assert got == brute_near(rows, 4)
    items = [(1, long[1_000_000:1_000_300]), (2, long[-200:])]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination_report(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contamination(rows, items)


@pytest.mark.parametrize("crowd", [1, 3, 20])
def test_crowded_groups_are_split(frame, corpus, monkeypatch, crowd):
    from tessera.llm import suffix_dedup as module

    monkeypatch.setattr(module, "CROWD", crowd)
    scan = module._scan

    def scan_with_frequent_anchors(buckets, shape):
        def run(batches):
            module.FREQUENT = 2  # in the worker that runs it
            yield from scan(buckets, shape)(batches)

        return run

    monkeypatch.setattr(module, "_scan", scan_with_frequent_anchors)
    uncrowded, narrowed = module._uncrowded, []

    def spied(*args):
        out = uncrowded(*args)
        narrowed.append(out.filter("open = 0").count())
        return out

    monkeypatch.setattr(module, "_uncrowded", spied)
    rng = np.random.default_rng(crowd)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh é"), n))

    # shared strings a little under and over 100 bytes, in ever new surroundings
    passages = [noise(n) for n in (40, 70, 90, 110, 160, 300)]
    rows = [(i, noise(int(rng.integers(0, 150))) + passages[i % 6][: int(rng.integers(60, 301))] + noise(int(rng.integers(0, 150)))) for i in range(240)]
    rows += [(300 + i, t) for i, t in corpus]
    assert suffix_result(frame(rows)) == brute_suffix([(d, t or "") for d, t in rows])
    assert narrowed[0] > 0


def test_suffix_edges(frame):
    x = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = suffix_dedup(frame([(None, x), (1, x), (1, x), (2, None), (3, "short")])).collect()
    assert Counter((r.doc_id, r.n_removed, r.n_spans) for r in rows) == Counter([(None, 0, 0), (1, len(x), 1), (1, len(x), 1), (2, 0, 0), (3, 0, 0)])
    assert suffix_report(frame([])).count() == 0


def test_interval_tree_gives_all_maximal_repeats():
    texts = [("ba", "xyz12"), ("ca", "xyz12"), ("ba", "xyz34"), ("q", "none")]
    lefts = [a[::-1].encode() for a, _ in texts]
    rights = [b"R" * 32 + (b + "!" * 40).encode() for _, b in texts]
    found = {(left, right, tuple(m)) for left, right, m in Repeats(lefts, rights, 33).groups()}
    assert (1, 32 + 45, (0, 1)) in found  # share "a" before and all after
    assert (2, 32 + 3, (0, 2)) in found  # share "ba" before and "xyz"
    assert (1, 32 + 3, (0, 1, 2)) in found


# ------------------------------------------------------------------ near-copies


def brute_near(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_rows(rng):
    rows = []
    for i in range(12):
        base = [f"v{rng.integers(5000)}" for _ in range(int(rng.integers(20, 90)))]
        rows.append(base)
        for _ in range(int(rng.integers(1, 9))):
            copy = list(rows[-1] if rng.random() < 0.4 else base)  # chains and stars
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = f"v{rng.integers(5000)}"
            rows.append(copy)
    order = rng.permutation(len(rows))
    return [(int(i), " ".join(rows[j])) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", range(3))
def test_near_groups_match_brute_force(frame, seed):
    rows = near_rows(np.random.default_rng(seed)) + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "\n")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(frame(rows, clash=True), words=4).collect()}
    assert got == brute_near(rows, 4)
    assert len({v[1] for v in got.values()}) < len(rows)


def test_near_edges(frame):
    rows = near_groups(frame([(None, "a b c"), (None, "a b c"), (5, "x y"), (5, "x y"), (5, "z z"), (6, "A b c"), (None, "only null"), (None, None)])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter(
        [(None, 6, False), (None, 6, False), (5, 5, True), (5, 5, True), (5, 5, True), (6, 6, True), (None, None, True), (None, None, True)]
    )
    assert near_groups(frame([])).count() == 0
    assert near_dedup(frame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], clash=True)).count() == 2


def test_super_minhash_estimates_similarity_and_equals_its_definition():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for common in (0, 500, 900):
        a, b = pool[:1000], np.concatenate([pool[:common], pool[2000 : 3000 - common]])
        s = super_minhash([a, b, a[:3]])
        j = common / (2000 - common)
        assert abs((s[0] == s[1]).mean() - j) < 0.15
        assert (s < np.iinfo(np.uint64).max).all()
    # one element offers 0, 1, 2, ... to a permutation of the slots
    assert sorted((super_minhash([pool[:1]])[0] >> np.uint64(32)).tolist()) == list(range(128))


def test_bands_miss_no_more_than_promised():
    for t in (0.5, 0.8, 0.9):
        r = rows_per_band(t)
        assert (1 - t**r) ** (128 // r) <= 1e-7
    assert 60 < least_matches(0.8) < 80


def test_thousands_of_mutual_strangers_in_a_bucket_meet_in_cells(spark):
    from tessera.llm import minhash_dedup as module

    rng = np.random.default_rng(4)
    n = 5000
    short = rng.integers(0, 256, (n, 128)).astype(np.uint8)
    prints = [np.unique(rng.integers(0, 1 << 16, 40)).astype(np.uint16) for _ in range(n)]
    twins = rng.permutation(n)[:400].reshape(-1, 2)
    for a, b in twins.tolist():
        short[b], prints[b] = short[a], prints[a]
    rows = [("k", n, i, 1 if i < 50 else i, i >= 50, 40, short[i].tobytes(), prints[i].tobytes()) for i in range(n)]
    rows += [("other", 2, n, n, False, 40, short[0].tobytes(), prints[0].tobytes()), ("other", 2, n + 1, n + 1, True, 40, short[0].tobytes(), prints[0].tobytes())]
    df = spark.createDataFrame([(1 if r[0] == "k" else 2, *r[1:]) for r in rows], "bucket long, n long, cls long, comp long, stranger boolean, n_shingles long, short binary, prints binary")
    cells = module._cells(df)
    sizes = cells.groupBy("bucket", "row", "col", "side").count().collect()
    assert max(r["count"] for r in sizes) < 1.3 * module.BLOCK and len(sizes) > 20
    found = [(r.a, r.b) for r in cells.mapInArrow(module._cross_pairs(least_matches(0.8), 80), "a long, b long").collect()]
    one_component = {(a, b) for a, b in (sorted(t) for t in twins.tolist()) if b < 50}
    assert sorted(found) == sorted({tuple(sorted(t)) for t in twins.tolist()} - one_component | {(n, n + 1)})


def test_components_of_chains_and_stars(spark):
    from tessera.llm._common import Stage

    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 150)] + [(200, 199)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.root for r in components(df, Stage(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 150)}, 200: 199}


# ------------------------------------------------------------------ benchmark


def brute_contamination(docs, items):
    def split(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))

    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        ids = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_matches_brute_force(spark, frame, corpus):
    items = [(1, corpus[0][1]), (2, corpus[3][1][:200]), (10, "A, b!"), (11, "w1 w2 w3"), (12, None), (13, "..."), (2, "w5 w9"), (None, corpus[5][1]), (14, "w7"), (15, "É" * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination_report(frame(corpus, clash=True), bench).collect()}
    assert got == brute_contamination(corpus, items)
    left = decontaminate(frame(corpus, clash=True), bench)
    assert {r.doc_id for r in left.collect()} == {d for d, v in got.items() if not v[4]}


def test_contamination_edges(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination_report(frame([(1, "a b")]), none).collect()] == [(2, 0, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination_report(frame([]), some).count() == 0
    rows = contamination_report(frame([(None, "a b"), (1, "x"), (1, "z a b")]), some).collect()
    assert Counter((r.doc_id, r.n_hit) for r in rows) == Counter([(None, 2), (1, 0), (1, 2)])
