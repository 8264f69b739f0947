"""Resampling, sharding and the source audit against brute force, with the awkward rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triplewright.llm import divergence, resampling, sharding
from triplewright.plans.workspace import Workspace

from .corpora import SCHEMA, corpus, rows

CLASHING = SCHEMA + ", position long, shard int, slot long, block long, term string"


def table(spark, data):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "t") for r in data], CLASHING)


def awkward():
    """Rows with clashing columns: a null id, repeated rows, and one id with two texts."""
    data = rows(corpus(5, 40))
    return data + [data[20], data[20], (None, "some words without an id " * 9, *data[0][2:]), (3, "another text", *data[0][2:])]


# Resampling


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(text, longest):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def expected_draw(docs, target, percent, min_words, buckets, longest):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = Counter(), Counter()
    found = [(i, *runs(text, longest)) for i, text in docs]
    for _, _, features in found:
        s.update(map(bucket, features))
    for text in target:
        t.update(map(bucket, runs(text, longest)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, words, features in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
                     for b in map(bucket, features))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(features), weight, score])
    pool = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = pool[:len(pool) * percent // 100]
    return out, drawn


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 60), (1, 0), (1, 100)])
def test_resampling(spark, longest, percent):
    data = awkward()
    target = ["W1 w2 É", None, "w5 w5"]
    found = resampling.resample(table(spark, data), spark.createDataFrame([(t,) for t in target], "text string"),
                                Workspace(spark), percent, 20, 300, longest).collect()
    every, drawn = expected_draw([r[:2] for r in data], target, percent, 20, 300, longest)
    key = repr
    assert sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score] for r in found), key=key) == sorted(every, key=key)
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_resampling_of_nothing(spark):
    few = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(few, few, Workspace(spark)).collect() == []


@pytest.mark.parametrize("spread", [1, 7, 100_000])
def test_draw_with_ties_and_a_poor_sketch(spark, spread):
    """Any bracket gives the same rows; most of the scores may be equal."""
    ws = Workspace(spark)
    data = ws.save(spark.range(5000).selectExpr("id % 4000 as doc_id", f"(id * 7919) % {spread} as score", "id as row"), "rows")
    wanted = sorted((-r.score, r.doc_id) for r in data.collect() if r.doc_id % 2 == 0)
    for k in (1, 777, 2500):
        for accuracy in (2, 50, 10_000):
            found = resampling.draw(data, ws, k, F.col("doc_id") % 2 == 0, accuracy).collect()
            assert len(found) == 5000
            ranked = sorted((r["rank"], -r.score, r.doc_id) for r in found if r["rank"])
            assert [r[0] for r in ranked] == list(range(1, k + 1))
            assert [r[1:] for r in ranked] == wanted[:k]


def test_bracket_is_narrow_and_widened_when_it_misses(spark):
    data = spark.range(20_000).selectExpr("(id * 7919) % 20000 as score").cache()
    low, high, above = resampling.bracket(data, 20_000, 2000)
    assert above < 2000 and high - low < 400 and low <= 18_000 <= high
    skewed = spark.range(20_000).selectExpr("if(id < 1999, 1000000 + id, 5) as score").cache()
    low, high, above = resampling.bracket(skewed, 20_000, 1999, 10_000)
    assert above < 1999 and low <= 1_000_000 <= high


# Sharding


def loads_of(found):
    size, count = defaultdict(int), defaultdict(list)
    for r in found:
        size[r.shard] += r.size
        count[r.shard].append(r.slot)
    return size, count


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 3)
    data = awkward() + [(1000 + i, "x" * (i % 97) + "é", *awkward()[0][2:]) for i in range(800)]
    found = sharding.shard_by_bytes(table(spark, data), Workspace(spark)).collect()
    content = [(r[1] or "").encode() for r in data]
    assert (sorted((repr(r.doc_id), r.size, r.text_crc32) for r in found)
            == sorted((repr(r[0]), len(c) + 1, zlib.crc32(c)) for r, c in zip(data, content)))
    size, count = loads_of(found)
    assert sorted(size) == list(range(8))
    for places in count.values():
        assert sorted(places) == list(range(len(places)))
    # What the long texts leave is dealt evenly; two shards hold one long text each.
    assert sorted(size.values())[5] - min(size.values()) <= 100


def test_shards_are_nearly_equal(spark):
    data = spark.range(20_000).selectExpr("id as doc_id", "repeat('ab ', cast(10 + id % 300 as int)) as text")
    found = sharding.shard_by_bytes(data, Workspace(spark)).collect()
    size, _ = loads_of(found)
    assert max(size.values()) - min(size.values()) < 0.001 * sum(size.values())


def test_versions_of_a_map(spark):
    """Rebalancing moves few slots, growing moves slots to the new shard only, and old versions stay."""
    ws = Workspace(spark)
    maps = sharding.SlotMaps(spark, f"{ws.root}/maps")
    assert maps.versions() == []
    first = {r.virtual_slot: r.shard for r in maps.first(512, 4).collect()}
    loads = ws.save(spark.range(512).selectExpr("cast(id as int) as virtual_slot", "if(id % 4 = 0, 3000, 1000) + id as bytes",
                                                "1L as rows"), "loads")
    weight = {r.virtual_slot: r.bytes for r in loads.collect()}

    def sums(table):
        out = defaultdict(int)
        for slot, shard in table.items():
            out[shard] += weight[slot]
        return out

    second = {r.virtual_slot: r.shard for r in maps.rebalance(loads, 4).collect()}
    moved = {s for s in first if first[s] != second[s]}
    assert sorted(second) == sorted(first) and {first[s] for s in moved} == {0}
    assert max(sums(second).values()) - min(sums(second).values()) <= 3000
    third = {r.virtual_slot: r.shard for r in maps.grow(loads, 4).collect()}
    assert {third[s] for s in third if third[s] != second[s]} == {4}
    assert max(sums(third).values()) - min(sums(third).values()) <= 5 * 3600
    again = {r.virtual_slot: r.shard for r in maps.rebalance(loads, 3).collect()}
    assert set(again.values()) == {0, 1, 2} and max(sums(again).values()) - min(sums(again).values()) <= 3600
    assert maps.versions() == [0, 1, 2, 3]
    assert {r.virtual_slot: r.shard for r in maps.read(0).collect()} == first


def test_sharding_of_nothing_and_of_one_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 5)
    few = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_bytes(few, Workspace(spark)).collect() == []
    same = sharding.shard_by_bytes(spark.createDataFrame([(1, "a")] * 40, "doc_id long, text string"), Workspace(spark)).collect()
    assert len({r.shard for r in same}) == 1 and sorted(r.slot for r in same) == list(range(40))


# Source audit


def expected_audit(docs, least, ranks):
    held, groups = defaultdict(Counter), set()
    counts = defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + math.floor(Fraction(10 ** 9 * (count[t] + 5), n + 5 * len(kept))) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def audit(spark, docs, least=3, ranks=4):
    frame = spark.createDataFrame([(i, t, l, s, 1, 2, "b", 0, "x") for i, (t, l, s) in enumerate(docs)],
                                  "doc_id long, text string, lang string, source string, rank int, n long, block string, "
                                  "number int, terms string").repartition(3)
    found = divergence.audit(frame, Workspace(spark), least, ranks)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


def mixed_docs():
    texts = [*corpus(8, 50), "Don't don't DON'T dont", "a-a A-b é É x　y", "1a2b3 ---", "x" * 200_000, "the the the", "\u0000z\u0001z"]
    langs, sources = ["en", "en", "en", "fr", "", None], ["s1", "s2", "é", None, ""]
    return [(t, langs[i % 6], sources[i % 5]) for i, t in enumerate(texts)] + [(None, "xx", "only"), (None, "xx", "other")]


def test_audit(spark):
    docs = mixed_docs()
    docs += docs[:40]
    assert audit(spark, docs) == expected_audit(docs, 3, 4)


def test_audit_in_small_blocks_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "blocks", lambda docs, of=divergence.blocks: of(docs, block_bytes=500))
    docs = mixed_docs()
    spark.conf.set("spark.triplewright.broadcast_rows", "0")
    spark.conf.set("spark.triplewright.broadcast_bytes", "0")
    try:
        assert audit(spark, docs, 5, 50) == expected_audit(docs, 5, 50)
    finally:
        spark.conf.unset("spark.triplewright.broadcast_rows")
        spark.conf.unset("spark.triplewright.broadcast_bytes")


def test_blocks_meet_in_buckets_without_joins(spark, monkeypatch):
    """Counting terms joins nothing and unfolds nothing: no step has a row for each chunk or term of a block."""
    plans = []

    class Watched(Workspace):
        def save(self, df, name, *args, **kwargs):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().save(df, name, *args, **kwargs)

    monkeypatch.setattr(divergence, "blocks", lambda docs, of=divergence.blocks: of(docs, block_bytes=500))
    monkeypatch.setattr(divergence, "BUCKET_BYTES", 200, raising=False)
    docs = mixed_docs()
    frame = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    found = divergence.term_counts(frame, Watched(spark), 4).collect()
    held, sums = Counter(), Counter()
    for text, lang, source in docs:
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        held.update((lang or "", t) for t in terms)
        for t, n in terms.items():
            sums[lang or "", t, source or ""] += n
    assert {(r.lang, r.term, s, n) for r in found for s, n in r.held} == {(*k, n) for k, n in sums.items() if held[k[:2]] >= 4}
    assert len(found) == sum(n >= 4 for n in held.values()) > 10
    assert plans and not any(word in plan for plan in plans for word in ("Join", "Generate"))


def test_audit_without_kept_terms(spark):
    assert audit(spark, [], 1) == []
    docs = [("a b", "en", "s"), ("c", "en", "t"), (None, "fr", "s")]
    assert audit(spark, docs, 2) == expected_audit(docs, 2, 4) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_a_chunk_is_cut_once(spark):
    docs = spark.createDataFrame([(f"every word {i % 7}, every time", "en", "s") for i in range(400)],
                                 "text string, lang string, source string").repartition(4)
    held = divergence.blocks(docs)
    chunks = held.select(F.explode("chunks").alias("chunk")).distinct()
    terms = {r.chunk: r.terms for r in divergence.chunk_terms(chunks).collect()}
    assert terms == {"every": ["every"], "word": ["word"], "time": ["time"]}
    assert held.select(F.explode("chunks")).count() <= 4 * 10


def test_chunks_of_a_block_are_told_apart_in_columns(monkeypatch):
    """Documents are counted some at a time, and the block has each chunk once, whatever their number."""
    docs = [(("en", "s"), b"b a, b --\x0bA"), (("en", "t"), b""), (("en", "s"), " é\x85é  ... b\n".encode()), (("en", "s"), b"b a,")]
    for at_once in (divergence.AT_ONCE, 1, 12):
        monkeypatch.setattr(divergence, "AT_ONCE", at_once)
        block = divergence._Block()
        for group, content in docs:
            block.add(group, content)
        row = block.record().to_pylist()[0]
        group, size, ids, counts = divergence._unpack(row["postings"])
        assert sorted(row["chunks"]) == ["A", "a,", "b", "é\x85é"] and row["sources"] == ["s", "t"]
        assert group.tolist() == [0, 1, 0, 0] and size.tolist() == [3, 0, 2, 2]
        found = [(row["chunks"][i], n) for i, n in zip(ids, counts)]
        assert [sorted(found[:3]), sorted(found[3:5]), sorted(found[5:])] == [
            [("A", 1), ("a,", 1), ("b", 2)], [("b", 1), ("é\x85é", 1)], [("a,", 1), ("b", 1)]]


def test_a_block_is_counted_some_documents_at_a_time(monkeypatch):
    """Counting a block takes a few bytes for each of its chunks, not several columns of all of them at once."""
    r = random.Random(4)
    block = divergence._Block()
    for i in range(3000):
        block.add((b"en", b"s%d" % (i % 3)), " ".join(r.choices([f"w{k}" for k in range(2000)], k=200)).encode())
    record = block.record()
    entries = int(divergence._unpack(record.column("postings")[0].as_py())[1].sum())
    left = pa.Table.from_batches([record])
    chunks = record.column("chunks").flatten()
    right = pa.table({"number": pa.array(range(len(chunks)), pa.int32()), "terms": chunks})

    def counted():
        tracemalloc.start()
        out = divergence._count_block(None, left, right).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return sorted((x["lang"], x["term"], x["docs"], *sorted(zip(x["sources"], x["occurrences"]))) for x in out), peak

    monkeypatch.setattr(divergence, "ENTRIES_AT_ONCE", 1 << 40)
    whole, most = counted()
    monkeypatch.setattr(divergence, "ENTRIES_AT_ONCE", 50_000)
    parts, peak = counted()
    assert whole == parts and len(whole) == 2000 and sum(x[2] for x in whole) == entries
    assert peak < 30 * entries < most
