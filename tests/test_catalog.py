"""Catalogue queries without SQL, against brute force on the smallest tables."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators.model import hat
from tessera.plans import catalog
from tessera.sources.frame import Kind

DATA = "/root/testdata/sf0.001"


def test_all_rows_are_expanded_over_all_features(spark):
    train, valid = (df.collect() for df in catalog.tables(spark, DATA)[1:])
    found = catalog._encoders(spark, DATA)
    prior = sum(r.label for r in train) / len(train)
    sums = {c: defaultdict(lambda: [0, 0]) for c in catalog.SCHEMA.of(Kind.HIGH_CARD)}
    for r in train:
        for c, s in sums.items():
            s[r[c]][0] += r.label
            s[r[c]][1] += 1
    expected = defaultdict(lambda: defaultdict(float))
    for r in valid:
        for e in found:
            if e.kind is Kind.BOUNDED:
                place = len(e.codes) if r[e.name] is None else e.codes.index(r[e.name]) if r[e.name] in e.codes else len(e.codes) + 1
                parts = [(e.offset + place, 1.0)]
            elif e.kind is Kind.NUMERIC:
                parts = hat(r[e.name], e.knots, e.offset)
            else:
                y, n = sums[e.name].get(r[e.name], (0, 0))
                parts = hat((y + 20.0 * prior) / (n + 20.0), e.knots, e.offset) + hat(math.log1p(n), e.count_knots, e.offset + len(e.knots) + 1)
            for slot, value in parts:
                expected[r.rid][slot] += value
    got = defaultdict(lambda: defaultdict(float))
    for r in catalog.queries()["basis_expand_row"](spark, DATA).collect():
        got[r.rid][r.idx] += r.val
    assert len(valid) > 300 and got.keys() == expected.keys()
    for rid, slots in expected.items():
        for slot in slots.keys() | got[rid].keys():
            assert got[rid].get(slot, 0.0) == pytest.approx(slots.get(slot, 0.0), abs=1e-6)


def test_scorers_are_compared_on_all_rows(spark):
    n = catalog.tables(spark, DATA)[2].agg(F.count(F.lit(1))).first()[0]
    assert n > 500 and catalog.queries()["scorer_paths_agree"](spark, DATA).collect() == [(n, True, True)]
