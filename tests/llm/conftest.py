import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# words of invented prose, enough for distinct texts
SYLLABLES = "an be co du el fa go hi in ja ke lo mu na or pe qui ro su ta".split()


def prose(seed: int, n: int) -> str:
    """n pseudo-random words."""
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""
    def build(rows, extra=True):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F
            for c in ("rid", "size", "node", "row", "label", "score", "range", "hash", "base", "kind", "_c", "n"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty texts, ties, repeated rows and a very long text."""
    long = prose(99, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (None, prose(5, 80)), (None, None), (4, prose(1, 120)), (4, prose(1, 120)),
            (4, prose(2, 60)), (5, prose(1, 120)), (6, long), (7, "one"), (8, "one two"), (9, "é ß 中文 🙂 ñ"),
            (10, "a" * 5000), (11, prose(1, 120).upper())]
