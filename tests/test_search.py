"""The document index against a scan, and what a search reads of it."""

import random

import pytest

from opslake.operators import search, vectors


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["the", "tide", "Tide", "coil", "ünder", "x1", "rare"]
    rows = [(i, " ".join(rng.choices(words, [30, 3, 2, 3, 2, 1, 0.1], k=rng.randint(0, 12))) or None, rng.choice(["a", "b", None]),
             rng.choice([None, 1.0, 2.5, 7.0])) for i in range(300)] + [(400, "rare tide; coil", "a", 7.0)]
    return spark.createDataFrame(rows, "id long, body string, kind_tag string, size_num double").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    search.index_write(docs, path, ["body", "kind_tag", "size_num"], folders=4, files=2)
    return search.DocumentIndex(spark, path)


@pytest.mark.parametrize("criteria", [
    {"body": "tide coil"}, {"body": "THE rare"}, {"body": "nowhere"}, {"kind_tag": "a", "body": "tide"}, {"kind_tag": ["a", "b"]},
    {"size_num": (2, 7), "kind_tag": "b"}, {"size_num": (8, 9)}])
def test_index_finds_what_a_scan_finds(docs, index, criteria):
    got = [r.id for r in index.search(criteria, limit=7, offset=1).collect()]
    assert got == [r.id for r in vectors.doc_search(docs, criteria, limit=7, offset=1).collect()]


def test_a_search_opens_only_the_folders_of_its_terms(index):
    plan = index.search({"body": "rare tide"}, limit=None)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,rare)" in plan and "EqualTo(term,tide)" in plan
    assert plan.count("PartitionFilters: [isnotnull(folder") == 2


def test_many_searches(spark, docs, index):
    wanted = {1: ["tide", "coil"], 2: ["the"], 3: ["rare", "tide", "coil"], 4: ["tide", "nowhere"], 5: ["x1", "x1"]}
    rows = [(q, "body", t) for q, terms in wanted.items() for t in terms]
    got = sorted((r.query_id, r.id) for r in index.search_many(spark.createDataFrame(rows, "query_id int, field string, term string")).collect())
    want = sorted((q, r.id) for q, terms in wanted.items() for r in vectors.doc_search(docs, {"body": " ".join(terms)}, limit=1000).collect())
    assert got == want
