"""The n-gram join and substring dedup against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from triplewright.llm import ngram_join, substring
from triplewright.plans.workspace import Workspace

from .corpora import SCHEMA, corpus, rows, words


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(lowered(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected_components(found):
    parent = {d: d for d, _ in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in found]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(x), root(d)) for d, x in sets)


def expected_dedup(found):
    out, first = [], {}
    for doc, text in found:
        w = words(text)
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            first[key] = min(doc, first.get(key, doc))
    for doc, text in found:
        w = words(text)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < doc:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_ngram_join(spark, texts):
    data = rows(texts)
    found = ngram_join.jaccard_components(spark.createDataFrame(data, SCHEMA), Workspace(spark))
    assert sorted(map(tuple, found.collect())) == expected_components([(r[0], r[1]) for r in data])


def test_ngram_join_at_the_border(spark):
    """Pairs just at and just below the similarity, and a chain of links."""
    def text(first, count):
        return " ".join(f"w{i}" for i in range(first, first + count))

    found = [(0, text(0, 74)), (1, text(10, 74)), (2, text(20, 74)), (3, text(1000, 74)), (4, text(1011, 74)),
             (5, text(0, 74)), (6, text(2000, 25)), (7, text(2000, 32)), (8, text(3000, 25)), (9, text(3000, 33))]
    answer = ngram_join.jaccard_components(spark.createDataFrame(found, "doc_id long, text string"), Workspace(spark))
    expected = expected_components(found)
    assert sorted(map(tuple, answer.collect())) == expected
    assert [c for _, _, c in expected] == [0, 0, 0, 3, 4, 0, 6, 6, 8, 9]


def test_ngram_join_of_a_large_group(spark):
    """Near copies of one text, most pairs of which do not link, and many exact copies."""
    base = [f"b{i}" for i in range(120)]
    found = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1:])) for i, j in ((i, i * 7 % 120) for i in range(1, 150))]
    found += [(500 + i, " ".join(base)) for i in range(300)]
    answer = ngram_join.jaccard_components(spark.createDataFrame(found, "doc_id long, text string"), Workspace(spark))
    assert {r.component_id for r in answer.collect()} == {1}


def test_matrix_alone_finds_all_links(spark, texts, monkeypatch):
    """Without the first links every component is one set, and the matrix must find them all."""
    monkeypatch.setattr(ngram_join, "_typical_links", lambda profiles, *_: profiles.sparkSession.createDataFrame(
        [], "src long, dst long"))
    data = rows(texts)
    found = ngram_join.jaccard_components(spark.createDataFrame(data, SCHEMA), Workspace(spark))
    assert sorted(map(tuple, found.collect())) == expected_components([(r[0], r[1]) for r in data])


def test_ngram_join_shuffles_no_texts_that_link_with_nothing(spark, texts, monkeypatch):
    """The texts kept for the second pass are those that may link, and are not joined with the sets to be told apart."""
    kept = []

    def watched(docs, sets, on, n):
        found = may_match(docs, sets, on, n)
        kept.append((found._jdf.queryExecution().executedPlan().toString(), found.count(), docs.count()))
        return found

    may_match = ngram_join.may_match
    monkeypatch.setattr(ngram_join, "may_match", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = rows([*texts, *(" ".join(f"own{i}w{j}" for j in range(40)) for i in range(300))])
        data += data[:60]
        found = ngram_join.jaccard_components(spark.createDataFrame(data, SCHEMA), Workspace(spark))
        assert sorted(map(tuple, found.collect())) == expected_components([(r[0], r[1]) for r in data])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (plan, passed, total), = kept
    assert "SortMergeJoin" not in plan and passed < total - 200


def test_substring_dedup(spark, texts):
    data = rows(texts)
    found = substring.dedup_substrings(spark.createDataFrame(data, SCHEMA), Workspace(spark))
    assert sorted(map(tuple, found.collect())) == expected_dedup([(r[0], r[1]) for r in data])


def test_substring_dedup_of_periodic_texts(spark):
    found = [(0, "a b " * 60), (1, "b a " * 60), (2, "a " * 49), (3, "a " * 120), (4, "a " * 50), (5, "x " + "a " * 80)]
    answer = substring.dedup_substrings(spark.createDataFrame(found, "doc_id long, text string"), Workspace(spark))
    assert sorted(map(tuple, answer.collect())) == expected_dedup(found)


def test_rows_with_one_id_or_none(spark):
    long = " ".join(f"w{i}" for i in range(80))
    found = [(1, long), (1, long), (1, "z " + long), (2, long), (None, long)]
    frame = spark.createDataFrame(found, "doc_id long, text string")
    removed = sorted((r.doc_id or 0, r.n_removed) for r in substring.dedup_substrings(frame, Workspace(spark)).collect())
    assert removed == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 80)]
    parts = [r.component_id for r in ngram_join.jaccard_components(frame, Workspace(spark)).collect()]
    assert parts == [1] * 5


def test_rows_of_one_id_in_different_components(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    found = [(0, other), (1, one), (1, other), (0, one + " z"), (2, ""), (2, None)]
    frame = spark.createDataFrame(found, "doc_id long, text string").select("*", F.xxhash64("text").alias("h"))
    texts = {(r.doc_id, r.h): r.text for r in frame.collect()}
    answer = ngram_join.jaccard_rows(frame, Workspace(spark)).collect()
    parts = {(r.doc_id, texts[r.doc_id, r.text_hash]): r.part for r in answer}
    assert {r.component_id for r in answer} == {0, 2}
    assert parts[0, other] == parts[1, other] != parts[1, one] == parts[0, one + " z"]
    assert parts[2, ""] is None and parts[2, None] is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.jaccard_components(empty, Workspace(spark)).count() == 0
    assert substring.dedup_substrings(empty, Workspace(spark)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(blank, Workspace(spark)).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_long_texts_in_chunks(monkeypatch):
    import numpy as np

    from triplewright.llm.words import word_codes
    codes = word_codes([b"%d" % (i * i % 97) for i in range(1000)])
    whole = substring.anchor_runs(codes)
    monkeypatch.setattr(substring, "_CHUNK", 128)
    parts = substring.anchor_runs(codes)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(parts[2], parts[3])])
    assert covered.tolist() == list(range(951))
    assert set(whole[0].tolist()) == set(parts[0].tolist())
