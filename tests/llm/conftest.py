import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, syllables: str = "ka lo mi tu re sa vo ne pi da") -> str:
    rng = random.Random(seed)
    parts = syllables.split()
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; ids from 0, or (id, text) pairs; extra columns clash with names that operators use inside."""

    def make(texts, extra=False):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("score", "part", "digest", "bucket", "chunk", "id", "start", "label", "lang_pred", "held_out", "rank")})
        return df

    return make
