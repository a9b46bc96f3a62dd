"""Each stage of the pipeline against brute force, and on hard cases."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_corpus_operators import bag, linked_by_hand  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_the_columns(spark, empty, tmp_path):
    docs = cases.documents(spark, empty)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
        assert docs.count() <= before.count() and (docs.count() > 0) != empty


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = [r for r in cases.pairs(cases.documents(spark)) if re.search(r"\S", r[1] or "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    groups = {}
    rows = [(i if i is not None else 10 ** 6, t) for i, t in rows]
    for d, _, c in linked_by_hand(rows, 5, 80):
        groups.setdefault(c, set()).add(d)
    assert bag((r["doc_id"] if r["doc_id"] is not None else 10 ** 6,) for r in kept) == bag((min(g),) for g in groups.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.collect()
    texts = dict(cases.pairs(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= set(texts)
    assert all(len(r["ids"]) == r["n_tokens"] > 0 for r in rows)
