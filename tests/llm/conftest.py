import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for results or inside.
CLASHES = ("uid", "bucket", "digest", "key", "keep_id", "kept", "drops", "owner", "n_hit", "items", "bad_id", "cls", "component_id", "group_size", "block")


@pytest.fixture
def frame(spark):
    def make(rows, clash=False):
        """rows of (doc_id, text); with clash, columns with the names of results."""
        table = [(d, t, "en" if t else None, "s1" if (d or 0) % 2 else None, len(t) if t is not None else None) for d, t in rows]
        df = spark.createDataFrame(table, SCHEMA).repartition(3)
        if clash:
            from pyspark.sql import functions as F

            for name in CLASHES:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def corpus():
    """Rows with copies, near-copies, shared lines, nulls, empties and a long text."""
    rng = random.Random(5)
    shared = words(rng, 14)
    rows = []
    for i in range(60):
        lines = [words(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "  " + shared.upper() if i % 8 else shared + "\t")
        rows.append((i, "\n".join(lines)))
    for i in range(60, 80):
        rows.append((i, rows[i % 7][1] if i % 2 else rows[i % 7][1].replace("w1", "w7", 1)))
    rows += [(80, None), (81, ""), (82, "\n\n"), (83, "É" * 50 + "\n" + shared), (84, rows[3][1].upper()), (85, words(rng, 40_000)), (86, "a b"), (87, "a b")]
    return rows
