import random

import pytest

import corpus_pipeline as C
from shelfmark.llm import queries

from .conftest import prose
from .test_jaccard_join import plain


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    """Clean prose in two languages, bad rows, near copies, and a passage that several documents share."""
    rng = random.Random(8)
    stems = ("the of and that with was house tree".split(), "der und nicht ein ich mit haus baum".split())
    say = lambda lang, n: [rng.choice(stems[lang]) + rng.choice(["", "a", "er", "in", "on"]) + rng.choice(["", "s", "t", "el"]) for _ in range(n)]
    rows, labels = [], []
    for n in range(120):
        words = say(n % 2, 90 + n % 7)
        rows.append([n, " ".join(words), ("en", "de")[n % 2], "s"])
        labels.append((n, 1))
    for n in range(120, 160):
        rows.append([n, " ".join(w + "###" for w in say(0, 90)), "en", "s"])
        labels.append((n, 0))
    shared = say(0, 60)
    for n in range(100, 110):
        rows[n][1] = " ".join(rows[n][1].split()[:70] + shared)
    for n in range(160, 170):
        near = rows[4][1].split()
        near[n - 160 + 5] = "changed"
        rows.append([n, " ".join(near), "en", "s"])
    rows += [[200, None, None, None], [201, "", "en", "s"], [None, " ".join(say(1, 80)), "de", "s"], [202, "12 34 " * 3 + " ".join(map(str, range(1000, 1100))), None, "s"]]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_follow_each_other(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    seen = {}
    for name, apply in C.STAGES[:-1]:
        docs = C.stage(apply(spark, docs, corpus_dir), "test-stage")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    clean = {*range(120), *range(160, 170), None}
    assert clean <= set(seen["quality_rules"]) <= clean | {202}
    assert set(seen["known_language"]) == clean
    before = {d: t for d, t in seen["known_language"].items() if d is not None}
    component = plain(before.items())
    assert set(seen["near_duplicates"]) == {d for d, (_, c) in component.items() if d == c} | {None}
    assert {4} == set(seen["near_duplicates"]) & {4, *range(160, 170)}
    for d, text in seen["repeated_passages"].items():
        old = seen["near_duplicates"][d]
        assert text == (" ".join(old.split()[:70]) + " " if d in range(101, 110) else old)
    packed = C.STAGES[-1][1](spark, docs, corpus_dir).collect()
    assert sorted(r.doc_id or -1 for r in packed) == sorted(d or -1 for d in seen["repeated_passages"])
    # the order in which files of one size are listed decides which rows share a batch
    settled = lambda rows: sorted((r.doc_id or -1, r.n_tokens, r.bucket, r.padded_length, r.padding) for r in rows)
    batches = lambda rows: sorted((r.bucket, r.batch_id, r.slot) for r in rows)
    again = C.run(spark, corpus_dir).collect()
    assert settled(again) == settled(packed) and batches(again) == batches(packed)


def test_stages_take_empty_tables(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet").limit(0)
    for _, apply in C.STAGES:
        out = apply(spark, docs, corpus_dir)
        assert out.count() == 0


def test_every_query_of_this_part_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries.QUERIES) < set(names)
    assert "pipeline" in names
    assert prose
