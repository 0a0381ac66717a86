import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t, True) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) or (id, text, lang, source)."""
    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Random prose over syllables, the same for the same seed."""
    def make(seed, n, syllables=("ka", "lo", "mi", "ne", "ru", "ta", "so", "pi")):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder with tables written from DataFrames."""
    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
