import random

import pytest

WORDS = "river stone light garden window market letter winter summer silver branch candle harbor valley meadow copper basket pillar thunder lantern".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, u long, v long, n string, h string, `task` string, rank string, ids string, w int, score string, item string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def rows(pairs):
    return [(i, t, "en", f"s{k % 3}", None if t is None else len(t), "x", 1, 2, "n", "h", "t", "r", "i", 3, "sc", "it") for k, (i, t) in enumerate(pairs)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long, tied and repeated texts, and columns with names that operators use themselves."""
    base = prose(1, 300)
    near = base.replace("river", "brook", 1)
    long = prose(2, 30_000)
    pairs = [(1, base), (2, near), (3, base), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, "One  TWO"), (9, long), (10, long + " end"), (11, prose(3, 40)), (11, prose(3, 40)), (12, "Ä ß “quoted” 日本 text"), (13, "a\n\nb  c\td"), (14, prose(4, 200)), (15, base.upper())]
    return spark.createDataFrame(rows(pairs), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
