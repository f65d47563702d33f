import random

import pytest

#: Column names that the operators use inside.
CLASH = ["h", "norm", "keep_id", "group_size", "id", "block", "n", "label", "v", "copies", "score", "_mean", "_source", "_copies", "_d", "_dir", "_above", "_theirs", "_score", "_gone_id", "_kept_id", "a.b"]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of the given (id, text[, source]) rows with extra columns whose names clash."""

    def make(rows, id_col="doc_id", text_col="text"):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, f"{id_col} long, {text_col} string, lang string, source string, n_chars long")
        return df.select("*", *(F.lit(7).alias(c) for c in CLASH if c not in df.columns))

    return make


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(3)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(60)]


@pytest.fixture(scope="session")
def corpus(words):
    """Texts with exact and near copies, shared passages, nulls, empties, one long text and repeated rows."""
    rnd = random.Random(4)
    pick = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = pick(20)
    texts = [None, "", "   \t\n", "one", "one two", "One  TWO", "été 中文 naïve", " lead and trail ", "a" * 5000]
    base = pick(60)
    for k in range(12):
        near = list(base)
        for _ in range(k // 3):
            near[rnd.randrange(len(near))] = rnd.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 4
    for k in range(10):
        texts.append(" ".join(pick(15) + passage + pick(k)))
    texts += [" ".join(pick(rnd.randint(1, 40))) for _ in range(20)]
    texts.append(" ".join(pick(3000) + passage))
    rnd.shuffle(texts)
    rows = [(k * 3 % 101 if k < 100 else k, t) for k, t in enumerate(texts)]
    return rows
