import hashlib
import random

import pytest

#: Rows that every operator must take: nulls in any column, empty and blank texts, one very long text, ties and repeats.
HARD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \t\n ", "en", "s"), (None, "a text without an id", "en", "s"), (None, None, None, None),
    (4, "the cat sat on the mat and the dog lay by the door", "en", "s"), (4, "the cat sat on the mat and the dog lay by the door", "en", "s"), (5, "THE CAT sat on the mat and the dog lay by the door", None, "s"),
    (6, "word " * 30_000, "en", "s"), (7, "x" * 40_000, "en", "s"), (8, "naïve façade – 日本語 😀 \x00 end", "fr", "s"), (9, "1 2 3", "de", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(seed: int, n: int, words: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join(hashlib.md5(str(int(rng.paretovariate(0.7)) % words).encode()).hexdigest()[: 2 + int(rng.random() * 6)] for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows, with extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, SCHEMA)
    return df.withColumns({c: F.lit(0) for c in ("score", "node", "comp", "u", "n", "row", "g", "block", "start", "_rank", "length", "stats", "marks", "rest", "train")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(10)] + [(None, 1, 1), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


def mixture(spark, seed: int = 1, n: int = 120):
    """Prose with copies, near copies, shared passages and repeats."""
    rng = random.Random(seed)
    base = [prose(i, rng.choice([3, 30, 80, 200])) for i in range(n)]
    passage = prose(99, 70)
    out = list(base)
    for t in base[:40]:
        w = t.split()
        for _ in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(rng.randrange(0, max(1, len(v) // 20) + 1)):
                v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    out += [f"{prose(1000 + i, 60)} {passage} {prose(2000 + i, 50)}" for i in range(8)] + [base[0]] * 5 + ["ab" * 300, "ab" * 301, "z" * 500]
    rows = [(i, t, "en", "s") for i, t in enumerate(out)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def mixed(spark):
    return mixture(spark).repartition(3).cache()
