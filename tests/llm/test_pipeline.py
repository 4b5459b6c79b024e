"""The pipeline against a brute-force version of each stage on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from turnstone.llm import mixing, queries

from . import test_operators as ops


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ops.sample(), ops.DOCS).repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: [tuple(r) for r in df.collect()]
    seen = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = seen[name] = spark.read.parquet(f"{folder}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    kept = rows(seen["quality_rules"])
    failed = lambda t: len(ops.WORDS.findall(t or "")) < 20
    assert kept and not any(failed(r[1]) for r in kept) and not Counter(kept) - Counter(ops.sample())

    fps = [ops.brute_fingerprint(r[1]) for r in kept]
    root = ops.brute_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    single = rows(seen["near_dedup"])
    assert Counter(root[ops.brute_fingerprint(r[1])] for r in single) == Counter(set(root.values())) and not Counter(single) - Counter(kept)

    cleaned = rows(seen["substring_dedup"])
    assert Counter((r[0], r[1]) for r in cleaned) == Counter((x[0], x[4]) for x in ops.brute_repeats(single).elements())
    assert all(r[4] == len(r[1]) for r, in zip(cleaned) if r[:2] not in {x[:2] for x in single})

    mixed = Counter(rows(seen["source_mixing"]))
    again = Counter(tuple(r)[:5] for r in mixing.mixed(seen["substring_dedup"]).collect())
    assert mixed == again and set(mixed) <= set(cleaned)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    assert Counter((r.doc_id, tuple(r.ids)) for r in seen["bpe_encoding"].collect()) == Counter((r[0], tuple(library.encode(r[1], add_special_tokens=False).ids)) for r in mixed.elements())


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and got.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


# ---- cases that every stage states ----

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = ["a.b", "kept", "n_words", "copy", "rate", "block", "fp", "_body", "__body", "key", "rest", "row", "shuffle_key", "base_failed", "KEPT2", "TEXT2", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, name, stage):
    got = stage(spark, spark.createDataFrame([], ops.DOCS), "")
    assert got.collect() == [] and (name == "bpe_encoding" or got.columns == COLUMNS)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_pass_further_columns_unseen(spark, name, stage):
    rows = [(i, ops.prose(i, 200), "en", "s", 1, *[f"{c} {i}" for c in CLASHES]) for i in range(6)]
    got = stage(spark, spark.createDataFrame(rows, [*COLUMNS, *CLASHES]), "")
    assert got.columns == [*COLUMNS, *CLASHES]
    found = got.collect()
    assert found and all(r[len(COLUMNS) + i] == f"{c} {r.doc_id}" for r in found for i, c in enumerate(CLASHES))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_in_any_column(spark, name, stage):
    full = (5, ops.prose(5, 100), "en", "s", 9)
    rows = [full, full, (None,) * 5] + [tuple(None if i == j else x for j, x in enumerate((10 + i, ops.prose(20 + i, 100), "fr", "t", 9))) for i in range(5)]
    got = stage(spark, spark.createDataFrame(rows, ops.DOCS), "").collect()
    assert len(got) > 0
    if name == "near_dedup":  # the repeated row once, both null texts as one group
        assert len(got) == 6
    if name == "quality_rules":
        assert all(r.text for r in got)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_very_long_texts(spark, name, stage):
    long = ops.prose(1, 40_000, 9_000)
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", len(long) + 4), (3, "x" * 400_000, "en", "s", 400_000), (4, ops.prose(4, 60), "en", "s", 1)]
    got = {r.doc_id: r for r in stage(spark, spark.createDataFrame(rows, ops.DOCS), "").collect()}
    if name == "substring_dedup":
        assert got[1].text == long and got[2].text == "end"  # all other words of the second are covered by windows of the first
    elif name == "near_dedup":
        assert set(got) == {1, 3, 4}
    elif name == "bpe_encoding":
        assert len(got) == 4 and got[1].n_tokens > 40_000
