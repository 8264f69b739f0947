"""The pipeline and the registered queries on the smallest tables."""

import collections
import os
import random

import duckdb
import pytest

import corpus_pipeline
from triplewright.llm.queries import ORACLES, QUERIES
from triplewright.plans.workspace import Workspace

from .corpora import SCHEMA, corpus, rows, words
from .test_documents import check_packing
from .test_pairs import expected_components, expected_dedup

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


FIRST_BAD = 10_000


def bad_texts():
    """Texts that pass the base rules and that only their many signs tell from the others."""
    r = random.Random(6)
    return [" ".join(f"b{r.randrange(400)}###" for _ in range(r.choice((70, 130)))) for _ in range(90)]


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    """The first 40 documents are good, two of three bad ones are known."""
    folder = str(tmp_path_factory.mktemp("tables"))
    found = [(i, 1) for i in range(200)] + [(FIRST_BAD + i, 0) for i in range(90) if i % 3]
    spark.createDataFrame(found, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def passes_base_rules(text):
    found = words(text)
    grams = collections.Counter(zip(found, found[1:], found[2:]))
    covered = {i + j for i, g in enumerate(zip(found, found[1:], found[2:])) if grams[g] > 1 for j in range(3)}
    return len(found) >= 50 and 100 * len(covered) <= 50 * len(found)


def test_stages_against_brute_force(spark, labels):
    data = rows(corpus(9, 120))
    clean = {r[0] for r in data if passes_base_rules(r[1])}
    data += [(FIRST_BAD + i, *r[1:]) for i, r in enumerate(rows(bad_texts()))]
    ws, docs = Workspace(spark), spark.createDataFrame(data, SCHEMA)
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.save(stage(spark, docs, labels), name)
        held[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = {r.doc_id: r.text for r in held["quality_rules"]}
    assert all(passes_base_rules(r[1]) for r in data if r[0] >= FIRST_BAD)  # what rejects them is learned
    assert set(kept) == clean
    first = [d for d, _, c in expected_components(sorted(kept.items())) if d == c]
    stay = {r.doc_id: r.text for r in held["near_duplicates"]}
    assert stay == {d: kept[d] for d in first}
    counts = {d: (n, gone) for d, n, gone, _ in expected_dedup(sorted(stay.items()))}
    left = {r.doc_id: r for r in held["substring_dedup"]}
    assert sorted(left) == sorted(stay)
    for d, r in left.items():
        assert len(words(r.text)) == counts[d][0] - counts[d][1] and r.n_chars == len(r.text)
        assert counts[d][1] or r.text == stay[d]
    taken = {}
    for r in held["source_mixing"]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    assert all(n <= 2 * len(words(left[d].text)) for d, n in taken.items())
    total = sum(len(words(r.text)) for r in held["substring_dedup"])
    assert abs(sum(taken.values()) - 1.5 * total) < 0.03 * total
    assert {r.doc_id for r in held["best_fit_packing"]} == set(taken)
    check_packing(held["best_fit_packing"], 2048)


def test_near_duplicates_by_row(spark, labels):
    """Rows of one id with different texts, repeated rows, and columns named like those used inside."""
    one, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    found = [(0, other, 1, "x"), (1, one, 2, "x"), (1, other, 3, "x"), (1, one, 1, "y"), (1, one, 1, "x"), (2, one + " z", 1, "x"),
             (3, "", 1, "x"), (3, "", 0, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (None, one, 1, "x"), (None, one, 1, "x")]
    docs = spark.createDataFrame(found, "doc_id long, text string, turn int, text_hash string")
    kept = corpus_pipeline.near_duplicates(spark, docs, labels)
    assert kept.columns == docs.columns
    expected = [(0, other, 1, "x"), (1, one, 1, "x"), (3, "", 0, "x"), (3, None, 1, "x"), (4, "", 1, "x"),
                (None, one, 1, "x"), (None, one, 1, "x")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_and_odd_documents(spark, labels):
    odd = [(1, None), (1, None), (None, "x"), (2, "a b " * 60), (2, "a b " * 60), (None, None)]
    for found in ([], [(a, b, None, None, None) for a, b in odd]):
        docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, labels).collect()


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert found
    check_packing(found, 2048)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    found = QUERIES[name](spark, FOLDER)
    answer = sorted(map(tuple, found.select(*sorted(found.columns)).collect()), key=repr)
    assert answer
    if name in ORACLES:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "labels", "benchmark"):
            con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
        cursor = con.execute(ORACLES[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(found.columns)
        order = [names.index(c) for c in sorted(names)]
        assert answer == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
