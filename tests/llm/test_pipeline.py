"""The pipeline's stages against brute force, each on its own input."""

import os
import re
import sys
from collections import defaultdict

import pytest

import corpus_pipeline

sys.path.insert(0, os.path.dirname(__file__))
from tests_support import brute_near_ids  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        found.append(docs)
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_return_the_columns_of_documents(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark, steps):
    from tessera.llm.toxicity import score_toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in score_toxicity(steps[0], labels).filter("predicted = 0").collect()}
    assert set(texts(steps[1])) == clean


def test_lines_go_and_documents_stay(steps):
    before, after = texts(steps[1]), texts(steps[2])
    holders = defaultdict(set)
    for d, t in before.items():
        for line in (t or "").split("\n"):
            holders[lower(line.strip(" \t\n\x0b\x0c\r"))].add(d)
    for d, t in before.items():
        left = []
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) < 40 or len(holders[key]) < 5 or max(holders[key]) == d:
                left.append(line)
        assert (after[d] or "") == "\n".join(left)
    assert all(r.n_chars == len(r.text or "") for r in steps[2].collect())


def test_one_of_each_group_of_near_copies_stays(steps):
    assert set(texts(steps[3])) == brute_near_ids(texts(steps[2]), 5, 80)
    assert texts(steps[3]).items() <= texts(steps[2]).items()


def test_contaminated_documents_go(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.text))
        n = min(len(w), 13)
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    clean = set()
    for d, t in texts(steps[3]).items():
        w, hit = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            clean.add(d)
    assert set(texts(steps[4])) == clean


def test_all_that_is_left_is_packed(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(texts(steps[4]))
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096


def test_run_gives_the_rows_of_the_last_stage(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, steps[5].drop("sequence_id", "offset").collect()))
