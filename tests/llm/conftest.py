import random

import pytest

CLASHING = ("kept", "score", "n", "h", "row", "gid", "token", "tokens", "cuts", "bands", "lang_pred", "n_words", "bucket", "shard", "key", "hi", "lo", "cluster")


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=3, rows=60):
    """Texts with exact copies, near copies and passages that several texts share."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(rows)]
    passage = prose(rng, 70)
    for i in range(5, 15):
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + passage + texts[i][at:]
    for i in range(20, 30):
        near = list(texts[20])
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = "new"
        texts[i] = near
    texts[31] = list(texts[30])
    return [(n, " ".join(t)) for n, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty, blank, very long and repeated texts, and columns with names used inside."""
    long = " ".join(prose(random.Random(1), 60_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one two", "en"), (5, long, "en"), (6, long, None), (6, long, None)]
    rows += [(None, "null id " * 40, "de"), (7, "!!! 123 ###", "de"), (8, "mañana\x85über straße", "de"), (9, None, None)]
    rows = [(*r, "src", len(r[1]) if r[1] else None, *[i] * len(CLASHING)) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")
