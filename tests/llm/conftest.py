import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with names that the operators use themselves.
CLASHING = ["id", "th", "z", "n", "key", "h", "start", "end", "tokens", "w", "s", "keep", "words", "score_", "component"]


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, clashing=False):
        full = [(x[0], x[1], *(x[2] if len(x) > 2 else ("en", "src1")), None if x[1] is None else len(x[1])) for x in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            from pyspark.sql import functions as F

            for name in CLASHING:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


def prose(seed: int, n: int, sep: str = " ") -> str:
    import random

    rng = random.Random(seed)
    return sep.join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Nulls, blanks, a very long text, repeated rows, one id with two texts, a null id, texts of every short length."""
    long = prose(1, 30_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, prose(2, 60)), (5, prose(2, 60)), (5, prose(2, 60)), (6, prose(3, 40)), (6, prose(4, 40)), (None, prose(2, 60)), (None, None), (7, long), (8, long + " tail")]
    return rows + [(100 + k, prose(5, k)) for k in range(1, 25)] + [(200, "é ß 漢字 🙂 " * 12), (201, " x　y")]
