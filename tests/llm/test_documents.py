"""Packing, quality, mixing, languages and licenses on a small corpus."""

import collections
import math
import os
import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triplewright.llm import langid, licenses, mixing, packing, quality
from triplewright.plans.workspace import Workspace

from .corpora import SCHEMA, corpus, rows, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def data():
    return rows(corpus(3), [(None, "a", "b", "B", "é")[i % 5] for i in range(1000)])


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).cache()


def test_pieces_hold_the_tokens(docs, data):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = []
    for r in data:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for number, at in enumerate(range(0, len(ids), 100)):
            part = ids[at:at + 100]
            expected.append((r[0], number, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    found = packing.tokenized_pieces(docs, VOCABULARY, 100)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_word_ids_are_those_of_whole_texts():
    r = random.Random(5)
    letters = [*"aAbZ'sStTdDrReEvVmMlL 019.,!?<|>-_\t\n", "ß", "É", "é", "İ", "ı", "Σ", "ΑΣ", "ﬁ", " ", " ",
               "中", "😀", "<|endoftext|>", "<|startoftext|>", "n't", "́", "²", "½", "\x00", "\x85"]
    tokenizer, ids = Tokenizer.from_file(VOCABULARY), packing._WordIds(VOCABULARY)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for text, found in zip(texts, ids.of([t.encode() for t in texts])):
        assert list(struct.unpack(f"<{len(found) // 4}I", found)) == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(found, capacity):
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs):
    pieces = packing.tokenized_pieces(docs, VOCABULARY, 100)
    found = packing.pack(pieces, Workspace(spark), 100).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(map(tuple, pieces.collect()))
    assert check_packing(found, 100) <= 1.02 * math.ceil(sum(r.length for r in found) / 100) + 1
    again = packing.pack(pieces, Workspace(spark), 100).collect()
    assert sorted(found) == sorted(again)


def test_packing_plans():
    r = random.Random(2)
    for counts in ({}, {10: 3}, {4: 1}, {1: 1000}, {6: 5, 4: 5}, {7: 2, 5: 3, 4: 4, 3: 5, 2: 6, 1: 7},
                   {k: r.randint(0, 50) for k in range(1, 11)}):
        plan = packing.packing_plan(counts, 10)
        bins, placed = collections.Counter(), collections.Counter()
        for length, first, last, per_bin, first_bin, base in plan:
            for rank in range(last - first + 1):
                bins[first_bin + rank // per_bin] += length
                placed[length] += 1
        assert placed == collections.Counter({k: v for k, v in counts.items() if v})
        assert max(bins.values(), default=0) <= 10
        least = max(math.ceil(sum(k * v for k, v in counts.items()) / 10), sum(v for k, v in counts.items() if k > 5))
        assert len(bins) <= 1.25 * least + 1


def test_statistics(docs, data):
    odd = {r.doc_id: r for r in quality.text_statistics(docs).collect()}
    for r in data:
        text, w = r[1] or "", words(r[1])
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        found = odd[r[0]]
        assert (found.n_words, found.word_chars) == (len(w), sum(map(len, w)))
        assert found.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert found.n_dup_lines == len(lines) - len(set(lines))
        assert found.n_repeat_words == len(covered)


def test_learned_rules_reject_what_labels_call_bad(spark):
    r = random.Random(4)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(80))
            for _ in range(300)]
    bad = [t.replace(" ", "### ") for t in good[:150]]
    found = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 300)) for i, _ in found if i % 3] + [(None, 0), (5, None)]
    judged, rules = quality.apply_quality(
        spark.createDataFrame(found, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"), Workspace(spark))
    assert rules and {r.doc_id for r in judged.collect() if r.kept} == set(range(300))
    none, rules = quality.apply_quality(
        spark.createDataFrame(found, "doc_id long, text string"),
        spark.createDataFrame([], "doc_id long, quality int"), Workspace(spark))
    assert not rules and none.where("kept").count() == 450


@pytest.mark.parametrize("good, bad, learned", [(6, 3, True), (1, 2, True), (6, 1, False), (0, 4, False), (6, 0, False)])
def test_few_labels_are_enough(spark, good, bad, learned):
    r = random.Random(good + bad)
    data = [(i, " ".join(f"w{r.randrange(900)}" + "#" * (i >= good) for _ in range(80))) for i in range(good + bad)]
    judged, rules = quality.apply_quality(
        spark.createDataFrame(data, "doc_id long, text string"),
        spark.createDataFrame([(i, int(i < good)) for i, _ in data], "doc_id long, quality int"), Workspace(spark))
    assert bool(rules) == learned
    if learned:
        assert {r.doc_id for r in judged.collect() if r.kept} == set(range(good))


def test_a_rule_that_fails_on_held_out_rows_is_not_the_last_one_tried(spark):
    """Rows to learn from are told best by their symbols, held-out ones are not; words tell both well enough."""
    order = [r.i for r in spark.range(90).select(F.col("id").alias("i")).orderBy(F.xxhash64("i")).collect()]
    counts, labels, turn = [], [], {0: 0, 1: 0}
    for i in order:
        bad = i % 2
        turn[bad] += 1
        held = turn[bad] % 3 == 2
        symbols = 50 if bad != held else 0
        words_in = 100 + i + (0 if bad and i != 1 else 1000)
        counts.append((i, words_in, 5 * words_in, symbols, 0, 0, 1, 0, 0, words_in))
        labels.append((i, 1 - bad))
    names = ("doc_id", *quality.MEASURES, *quality._OTHERS)
    frame = spark.createDataFrame(counts, ", ".join(f"{n} long" for n in names))
    rules = quality.learn_rules(frame, spark.createDataFrame(labels, "doc_id long, quality int"), Workspace(spark))
    assert [[(c.statistic, c.above) for c in rule] for rule in rules][0][0][0] in ("words", "line_words", "word_chars")
    rejected = {r.doc_id for r in frame.where(~quality.verdict(rules)).collect()}
    assert rejected >= {i for i in order if i % 2 and i != 1} and not any(i % 2 == 0 for i in rejected)


def test_rules_learned_on_the_smallest_tables_hold_on_larger_ones(spark):
    """The rules of one folder, judged by the labels of one with ten times the documents."""
    folders = [os.path.join(os.path.dirname(FOLDER), name) for name in ("sf0.001", "sf0.01")]
    if not all(map(os.path.isdir, folders)):
        pytest.skip("needs both folders")
    small, large = ([spark.read.parquet(f"{f}/{t}.parquet") for t in ("documents", "labels")] for f in folders)
    _, rules = quality.apply_quality(*small, Workspace(spark))
    statistics = Workspace(spark).save(quality.text_statistics(large[0]), "statistics")
    judged = statistics.where(~quality.base_failed()).join(large[1], "doc_id")
    found = judged.groupBy("quality", quality.verdict(rules).alias("kept")).count().collect()
    n = {(r.quality, r.kept): r["count"] for r in found}
    assert n.get((0, False), 0) > 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, False), 0) < 0.05 * (n.get((1, False), 0) + n.get((1, True), 0))


def expected_targets(sizes):
    """Water filling over (source, size) by trying each number of full sources."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    wanted, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (wanted - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def test_mixing(spark, docs, data):
    numbered = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), F.col("doc_id").alias("row"))
    found, parts = mixing.mix(numbered, Workspace(spark))
    found, parts = found.collect(), parts.collect()
    source, sizes = {r[0]: r[3] for r in data}, collections.Counter()
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    targets, taken = expected_targets(sizes), collections.Counter()
    assert len(found) == len(data)
    for r in found:
        assert r.size == len(words(data[r.doc_id][1])) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.03 * target + 4 * mixing.BLOCK_WORDS
    spans = collections.Counter()
    for p in parts:
        assert 0 <= p.lo < p.hi <= len(words(data[p.row][1]))
        spans[p.row] += p.hi - p.lo
    assert {r.row: r.taken for r in found if r.taken} == dict(spans)
    assert sorted(found) == sorted(mixing.mix(numbered, Workspace(spark))[0].collect())


def test_mixed_documents(spark, docs, data):
    found = mixing.mixed_documents(docs, Workspace(spark))
    assert found.columns == docs.columns
    for r in found.collect():
        w, whole = words(r.text), words(data[r.doc_id][1])
        assert w and any(whole[i:i + len(w)] == w for i in range(len(whole) - len(w) + 1))
        assert r.n_chars == len(r.text)


def test_languages(spark):
    r = random.Random(6)
    languages = {"aa": "kala mena suti rovo".split(), "bb": "thrix glomp wazz ferd".split()}
    found = [(i, " ".join(r.choice(languages[lang]) + r.choice("aeiou") for _ in range(40)), lang)
             for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    found += [(100, None, "aa"), (101, "", "aa"), (102, "123 ... !!", "bb"), (103, "thrixa glompe wazzi ferdo", None)]
    frame = spark.createDataFrame(found, "doc_id long, text string, lang string")
    answer = {x.doc_id: x for x in langid.predict(frame, langid.learn(frame)).collect()}
    for doc, text, lang in found:
        x = answer[doc]
        assert x.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= x.score <= 1
        assert x.lang_pred == ("und" if doc in (100, 101, 102) else lang or "bb")
    # Labels of held-out rows change nothing.
    turned = frame.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert langid.learn(turned) == langid.learn(frame)
    nothing = langid.predict(frame, [])
    assert {x.lang_pred for x in nothing.collect()} == {"und"}


def test_licenses(spark):
    s = licenses.SENTENCES
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + s["mit-grant"][0].replace(" to any", "\n to any") + "\n\n" + s["mit-notice"][0]
    bsd = " ".join(s[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    found = [
        (0, None, []), (1, "", []), (2, "No licence here.", []), (3, "Foo\nReleased under the MIT License.\nbar", ["MIT"]),
        (4, mit, ["MIT"]), (5, bsd, ["BSD-2-Clause"]), (6, bsd + " " + s["bsd-endorse"][0], ["BSD-3-Clause"]),
        (7, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
        (8, "# SPDX-License-Identifier: GPL-3.0-only\ncode", ["GPL-3.0-only"]),
        (9, "x " * 50_000 + ". RELEASED   UNDER THE MIT LICENSE. " + "y " * 50_000, ["MIT"]),
        (10, "Unreleased under the MIT License.", []),
        (11, "This is free and unencumbered software released into the public\ndomain.", ["Unlicense"]),
        (12, "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", ["Apache-2.0", "MIT"]),
        (13, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"]),
        (14, "This file is licensed under the MIT License.", ["MIT"]),
        (15, "The software is distributed under the terms of the\n# Mozilla Public\n# License, v. 2.0.", ["MPL-2.0"]),
        (16, bsd + "\nNeither the name of Some\nBody, Inc. nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        (17, "The software is distributed under the terms of a contract. Released under pressure.", []),
        (18, "SPDX-License-Identifier: Unheard-Of-1.0", []), (19, "The SPDX-License-Identifier: MIT", ["MIT"]),
        (20, "Neither the name of " + "x" * 500 + " " + s["bsd-endorse"][0].split("holder ")[1], []),
    ]
    frame = spark.createDataFrame([x[:2] for x in found], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan_licenses(frame).collect()} == {d: e for d, _, e in found}


def test_every_run_of_fragments():
    """Texts of known and unknown sentences, cut over lines, against trying every run at every place."""
    r = random.Random(8)
    every = [f for forms in licenses.SENTENCES.values() for f in forms]
    every += [f"This {r.choice(('file', 'work'))} is released under the {n}." for forms in licenses.NAMES.values() for n in forms]
    every += [f.replace("...", "Some One") for forms in licenses.HOLES.values() for f in forms]

    def wrapped(sentence):
        return "".join(r.choice(("\n", " \n  ", "\n * ")) if c == " " and r.random() < 0.15 else c for c in sentence)

    for _ in range(200):
        parts = [wrapped(r.choice(every)) if r.random() < 0.6 else r.choice(("This is text.", "The MIT people", "Released."))
                 for _ in range(r.randint(1, 6))]
        body = r.choice(("\n", "\n\n")).join(parts).encode()
        fragments = [f for f in map(licenses.normalised, licenses._END.split(body)) if f]
        expected, at = [], 0
        while at < len(fragments):
            ends = [e for e in range(at + 1, len(fragments) + 1) if licenses._identifier(b" ".join(fragments[at:e]))]
            if ends:
                expected.append(licenses._identifier(b" ".join(fragments[at:ends[-1]])))
            at = ends[-1] if ends else at + 1
        assert [name for name, _ in licenses.sentence_ids(body)] == expected


def test_notices_in_the_documents_are_found(spark):
    """Each line of the smallest documents that names a license, found by a plain search, gives a license."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    named = {r.doc_id for r in docs.where(F.col("text").rlike(r"(?i)(licensed|released) under ")).collect()}
    assert named and all(found[d] for d in named)
    assert not any(found[d] for d in found.keys() - named)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(packing.tokenized_pieces(empty, VOCABULARY), Workspace(spark)).count() == 0
    assert quality.apply_quality(empty, spark.createDataFrame([], "doc_id long, quality int"), Workspace(spark))[0].count() == 0
    numbered = empty.select("doc_id", "source", mixing.word_count("text").alias("size"), F.col("doc_id").alias("row"))
    assert mixing.mix(numbered, Workspace(spark))[0].count() == 0
    assert mixing.mixed_documents(empty, Workspace(spark)).count() == 0
    assert langid.predict(empty, langid.learn(empty)).count() == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_words_of_letters_and_signs_are_cut_without_patterns():
    """Letters, Latin-1 ones too, with signs behind them or not; the parts are those of the vocabulary's pattern."""
    class Plain(packing._WordIds):
        ASCII = ASCII_PARTS = PLAIN = None

    plain, ids, tokenizer = Plain(VOCABULARY), packing._WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    easy = ["word", "Word,", "ciónoses.", "ÄHEIT&&&", "ß", "ªµº!", "they'", "a<|", "É"]
    for word in easy:
        assert [x.decode() for x in plain._cut(word.encode())] == packing._WordIds.PARTS.findall(word.lower())
    hard = ["don't", "it's.", "<|endoftext|>", "x1", "...", "1234,", "İ", "ŉ'", "×", "日本。", "é", "²", "a­", "'re"]
    for word in easy + hard:
        expected = tokenizer.encode(word, add_special_tokens=False).ids
        assert next(ids.of([word.encode()])) == struct.pack(f"<{len(expected)}I", *expected)


def test_plain_words_are_cut_as_columns(monkeypatch):
    """No word of letters, with signs behind them or not, is cut by itself, whatever the case and the Latin letters."""
    class Columns(packing._WordIds):
        def _cut(self, word):
            assert not word
            return super()._cut(word)

    letters = [chr(c) for c in range(0xA1, 0x250) if chr(c).isalpha() and c != 0x130]
    texts = ["", " ", "Word word, WORD. ción&&& they' a<|\x0b\x0cb", *(f"x{c} {c}! \t{c}yZ\n" for c in letters)]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for at_once in (packing.AT_ONCE, 1, 40):
        monkeypatch.setattr(packing, "AT_ONCE", at_once)
        ids = Columns(VOCABULARY)
        found = list(ids.of([t.encode() for t in texts]))
        assert [list(struct.unpack(f"<{len(f) // 4}I", f)) for f in found] == expected


def test_a_task_leaves_no_words_in_its_worker():
    """Spark keeps workers, so what a task has remembered would be in the memory of all that run there later."""
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["some words, 12 of them", None])})
    rows = packing._piece_rows(VOCABULARY, 2048)
    found = [list(rows(iter([batch, batch]))) for _ in range(2)]
    assert found[0] == found[1] and [b.num_rows for b in found[0]] == [2, 2]
    ids = packing._word_ids(VOCABULARY)
    assert not (ids.words or ids.words.older or ids.parts or ids.parts.older)
