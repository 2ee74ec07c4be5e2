"""Each pipeline stage against a plain form of its decisions, on small tables."""
import random
from collections import Counter

import pytest
from test_llm_match import slow_components, slow_repeats
from test_llm_text import slow_counts

import corpus_pipeline
from tavola.llm import packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of every stage, written and read again as the next one's input."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_keep_the_columns_of_documents(stages):
    names = list(stages)
    assert names == ["documents", "language_id", "quality_rules", "ngram_join", "repeats", "packing"]
    for name in names[1:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_language_stage_keeps_clear_documents(stages):
    before, after = stages["documents"].collect(), {r.doc_id for r in stages["language_id"].collect()}
    assert len(after) >= 0.97 * len(before)
    assert all(r.doc_id not in after for r in before if not any(c.isalpha() for c in r.text or ""))


def test_quality_stage_equals_the_rules(stages):
    before, after = stages["language_id"].collect(), {r.doc_id for r in stages["quality_rules"].collect()}
    for r in before:
        n_words, _, _, _, repeated = slow_counts(r.text)
        assert (r.doc_id in after) == (n_words >= 50 and 100 * repeated <= 50 * n_words)


def test_one_of_each_group_stays(stages):
    before = stages["quality_rules"].collect()
    classes = slow_components([r.doc_id for r in before], [r.text for r in before], 5, 80)
    assert {r.doc_id for r in stages["ngram_join"].collect()} == {c for _, _, c in classes}


def test_no_passage_stands_twice(stages):
    before = sorted(stages["ngram_join"].collect(), key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in stages["repeats"].collect()}
    wanted = slow_repeats([r.text for r in before], corpus_pipeline.PASSAGE_BYTES)
    for r, (_, _, _, kept) in zip(before, wanted):
        text = kept.decode(errors="ignore")
        assert after[r.doc_id].text == text and after[r.doc_id].n_chars == len(text)


def test_packing_and_run(spark, stages):
    want = packing.pack(stages["repeats"], corpus_pipeline.TOKENIZER)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    tokens = lambda df: sum(r.length for r in df.collect())
    assert Counter(map(tuple, want.select("doc_id", "doc_tokens").distinct().collect())) == Counter(
        map(tuple, stages["packing"].select("doc_id", "doc_tokens").distinct().collect()))
    run = corpus_pipeline.run(spark, FOLDER)
    assert tokens(run) == tokens(want) == tokens(stages["packing"]) and set(key) <= set(run.columns)


def test_odd_rows_pass_all_stages(spark, docs_of):
    rnd = random.Random(1)
    words = ["house", "garden", "river", "stone", "light", "winter", "morning", "table"]
    long = [" ".join(rnd.choices(words, k=80)) for _ in range(4)]
    docs = docs_of([*long, long[0], None, "", "x", long[1], long[2]], ids=[1, 2, 3, 4, 5, 6, 7, 8, None, 3],
                   lang=["en"] * 10, source=[None, "a", "a", None, "b", "b", None, "a", "a", "a"], component_id=["old"] * 10)
    got = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, "")
        assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect() if r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 4)]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0


def test_rows_of_one_id_stay_by_their_own_group(docs_of):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    two, own, other, last = (" ".join(rnd.choices(words, k=80)) for _ in range(4))
    near = two + " end"
    docs = docs_of([two, near, own, other, last, last, two], ids=[2, 5, 5, 7, 7, 7, None])
    got = corpus_pipeline.near_duplicate_stage(docs.sparkSession, docs, "")
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == sorted(
        [(2, two), (5, own), (7, other), (7, last)])
    assert [r.text for r in got.collect() if r.doc_id is None] == [two]
