"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word n-grams, and two of them link at a Jaccard similarity of at least NUMERATOR /
DENOMINATOR. All answers are exact up to collisions of 64-bit hashes. Equal sets are one set from the start.

1. Sets that share too few tokens with all the others together cannot link and leave. Tokens travel in packed
   blocks, one for each batch and range of hashes, so this costs a few bytes for each token.
2. Similar sets are brought together: sets with one minimal hash are compared with the most typical of them.
   The links found join nearly all sets of a group of near copies, without comparing its members in pairs.
3. What is still apart meets in the token-group matrix. Connected sets are cut into groups of bounded size,
   and the matrix has a row for each token and group that holds it. A set asks only for groups of other
   components, through its rarest tokens; a group is opened only if the overlap of the set with the union of
   the group's tokens reaches what a link needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.joins import may_match
from ..plans.workspace import Workspace
from .words import mixed, shingle_set, texts

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Tokens of the packed blocks of one range of hashes, about; the number of ranges grows with the input.
RANGE_TOKENS = 1_500_000
#: Tokens of one group of the matrix, about.
GROUP_TOKENS = 4096
#: Hash functions that bring similar sets together.
PERMUTATIONS = 4

_LIMIT = 1 << 63


def need(size):
    """Smallest overlap of a linked pair in which one set has ``size`` tokens."""
    return -(-NUMERATOR * size // DENOMINATOR)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted token sets link."""
    if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    common = overlap(a, b)
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common) > 0


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common values of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def token_set(body: bytes | None, width: int = WIDTH) -> np.ndarray:
    return shingle_set((body or b"").lower().split(), width)


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - _LIMIT


def _early(size: int) -> int:
    return max(1, size // 4)


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, key, text_hash) of every row; the key, null for an empty set, is equal for equal sets."""

    def rows(batches):
        for batch in batches:
            sets = [token_set(b, width) for b in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), batch.column(2)],
                ["doc_id", "n_shingles", "key", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        rows, "doc_id long, n_shingles long, key long, text_hash long")


def _packed_tokens(ranges: int, whole: bool, width: int):
    """Batches of texts to packed blocks: the tokens of each range of hashes, set after set.

    Not ``whole``: only the first half of each set in order of hash, which is enough to tell that it links
    with nothing. Of equal sets of a batch one is packed.
    """
    step = np.uint64((1 << 64) // ranges + 1)

    def rows(batches):
        for batch in batches:
            keys, sets = [], []
            seen = set()
            for body in texts(batch.column(0)):
                tokens = token_set(body, width)
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(tokens if whole else tokens[:len(tokens) - need(len(tokens)) + _early(len(tokens))])
            if not sets:
                continue
            cuts = np.arange(1, ranges, dtype=np.uint64) * step
            places = np.array([np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]) for s in sets])
            names = np.array(keys, np.int64)
            out = [[], [], [], []]
            for r in range(ranges):
                counts = places[:, r + 1] - places[:, r]
                used = np.flatnonzero(counts)
                if len(used):
                    block = np.concatenate([sets[i][places[i, r]:places[i, r + 1]] for i in used])
                    out[0].append(r)
                    # Six bytes tell tokens of one range apart well enough where a wrong match only costs work.
                    out[1].append(block.tobytes() if whole else block.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    out[2].append(counts[used].astype(np.uint32).tobytes())
                    out[3].append(names[used].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
                ["range", "tokens", "counts", "keys"])

    return rows


def _shared_tokens(whole: bool):
    """One range of hashes to (key, range, shared, classes).

    ``shared`` counts the tokens of a set that another set has too. ``classes`` has one byte for each token
    in order of hash: 0 for its own ones, else the logarithm of the number of sets plus one.
    """

    def rows(key: tuple, table: pa.Table) -> pa.Table:
        blocks = [table.column(c).to_pylist() for c in ("tokens", "counts", "keys")]
        raw = b"".join(blocks[0])
        if whole:
            tokens = np.frombuffer(raw, np.uint64)
        else:
            wide = np.zeros((len(raw) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            tokens = wide.view(np.uint64)[:, 0]
        counts = np.frombuffer(b"".join(blocks[1]), np.uint32).astype(np.int64)
        names, first = np.unique(np.frombuffer(b"".join(blocks[2]), np.int64), return_index=True)
        starts = np.cumsum(counts) - counts
        # A set that came in several batches is taken from the first.
        counts, starts = counts[first], starts[first]
        at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        _, which, times = np.unique(tokens[at], return_inverse=True, return_counts=True)
        classes = np.where(times > 1, np.ceil(np.log2(times + 1)), 0).astype(np.uint8)[which]
        edges = np.cumsum(counts) - counts
        shared = np.add.reduceat((classes > 0).astype(np.int64), edges)
        kept = np.ones(len(names), bool) if whole else shared > 0
        parts = [classes[s:s + n].tobytes() for s, n in zip(edges.tolist(), counts.tolist())] if whole else None
        return pa.table({
            "key": pa.array(names[kept]), "range": pa.array(np.full(kept.sum(), key[0].as_py(), np.int32)),
            "shared": pa.array(shared[kept]),
            "classes": pa.array(parts, pa.binary()) if whole else pa.nulls(int(kept.sum()), pa.binary())})

    return rows


def _shared(rows: DataFrame, tokens: int, whole: bool, width: int) -> DataFrame:
    ranges = max(8, -(-tokens // RANGE_TOKENS))
    packed = rows.select("text").mapInArrow(_packed_tokens(ranges, whole, width),
                                            "range int, tokens binary, counts binary, keys binary")
    return packed.groupBy("range").applyInArrow(_shared_tokens(whole),
                                                "key long, range int, shared long, classes binary")


def _profiles(width: int):
    """(key, n, weight, marks, prefix, text) of each set: its mean class, minimal hashes and rarest tokens.

    A text that is not that of the key is left out.
    """
    seeds = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))

    def rows(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for key, body, classes in zip(batch.column(0).to_pylist(), texts(batch.column(1)),
                                          batch.column(2).to_pylist()):
                tokens = token_set(body, width)
                if set_key(tokens) != key:
                    continue
                classes = np.frombuffer(classes, np.uint8)
                rare = np.lexsort((tokens, classes))[:len(tokens) - need(len(tokens)) + 1]
                prefix = np.where(classes[rare] > 0, tokens[rare].view(np.int64), 0)
                for column, value in zip(out, (
                        key, len(tokens), float(classes.mean()),
                        [int(mixed(tokens ^ s).min()) - _LIMIT for s in seeds], prefix, body)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()),
                 pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64())),
                 pa.array(out[5], pa.binary()).cast(pa.string())],
                ["key", "n", "weight", "marks", "prefix", "text"])

    return rows


def _verified(width: int):
    """Pairs of texts to the (src, dst) that link."""

    def rows(batches):
        last, tokens = None, None
        for batch in batches:
            src, dst = [], []
            for a, b, mine, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         texts(batch.column(2)), texts(batch.column(3))):
                if b != last:
                    last, tokens = b, token_set(other, width)
                if linked(token_set(mine, width), tokens):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows


def _typical_links(profiles: DataFrame, ws: Workspace, width: int) -> DataFrame:
    """Verified links of sets with the most typical set among those with the same minimal hash."""
    marked = profiles.select("key", "n", "weight", F.posexplode("marks").alias("turn", "mark"))
    typical = marked.groupBy("turn", "mark").agg(
        F.max(F.struct("weight", "key", "n")).alias("best"), F.count("*").alias("members")).where("members > 1")
    typical = ws.save(typical.select("turn", "mark", F.col("best.key").alias("centre"), F.col("best.n").alias("size")),
                      ws.unique("typical"))
    near = f"{DENOMINATOR} * least(n, size) >= {NUMERATOR} * greatest(n, size)"
    pairs = marked.join(typical, ["turn", "mark"]).where("key <> centre").where(near).select("key", "centre").distinct()
    pairs = ws.save(pairs, ws.unique("pairs"))
    mine = pairs.join(profiles.select("key", "text"), "key")
    other = profiles.select(F.col("key").alias("centre"), F.col("text").alias("other"))
    both = mine.join(other, "centre").select("key", "centre", "text", "other")
    return both.mapInArrow(_verified(width), "src long, dst long")


def _group_payload(width: int):
    def rows(key: tuple, table: pa.Table) -> pa.Table:
        sets = [token_set(b, width) for b in texts(table.column("text"))]
        return pa.table({
            "group": pa.array([key[0].as_py()], pa.int64()),
            "members": pa.array([np.array(table.column("key").to_pylist(), np.int64).tobytes()], pa.binary()),
            "sizes": pa.array([np.array([len(s) for s in sets], np.int64).tobytes()], pa.binary()),
            "sets": pa.array([b"".join(s.tobytes() for s in sets)], pa.binary()),
            "token_union": pa.array([np.unique(np.concatenate(sets)).tobytes()], pa.binary())})

    return rows


def _opened(width: int):
    """A set and a group to one link, if there is one: the union bounds the overlap, then members are tried."""

    def rows(batches):
        for batch in batches:
            src, dst = [], []
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
            for key, body, members, sizes, sets, union in zip(columns[0], texts(batch.column(1)), *columns[1:]):
                tokens = token_set(body, width)
                if overlap(tokens, np.frombuffer(union, np.uint64)) < need(len(tokens)):
                    continue
                every, at = np.frombuffer(sets, np.uint64), 0
                for name, size in zip(np.frombuffer(members, np.int64).tolist(),
                                      np.frombuffer(sizes, np.int64).tolist()):
                    if linked(tokens, every[at:at + size]):
                        src.append(key)
                        dst.append(name)
                        break
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows


def _matrix_links(profiles: DataFrame, parts: DataFrame, ws: Workspace, width: int) -> DataFrame:
    """Verified links between sets of different components, at least one for each pair of them that links.

    The set of the smaller component asks for groups of the larger one. Sets of a and b tokens that link share
    m of them with NUMERATOR * (a + b) <= (NUMERATOR + DENOMINATOR) * m, and from the first token they share, in
    order of rarity, each has at least m left. So its place bounds in each set how large the other one may be.
    """
    placed = profiles.join(parts.select(F.col("node").alias("key"), "rep"), "key", "left").select(
        "key", "n", "prefix", F.coalesce("rep", "key").alias("part"))
    sizes = ws.save(placed.groupBy("part").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")),
                    ws.unique("part_sizes"))
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("tokens") / F.lit(GROUP_TOKENS)).cast("long"))
    placed = ws.save(placed.join(sizes, "part").select(
        "key", "n", "prefix", "part", "members", F.xxhash64("part", block).alias("group")), ws.unique("placed"))
    rows = placed.select("key", "n", "part", "members", "group", F.posexplode("prefix").alias("at", "token"))
    rows = rows.where("token <> 0").withColumn(
        "room", F.expr(f"{NUMERATOR + DENOMINATOR} * (n - at) - {NUMERATOR} * n")).drop("at")
    split = rows.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    split = ws.save(split.where("a <> b").select("token"), ws.unique("split"))
    rows = ws.save(rows.join(split, "token"), ws.unique("prefix_rows"))
    matrix = rows.groupBy("token", "group").agg(
        F.first("part").alias("g_part"), F.first("members").alias("g_members"),
        F.min("n").alias("g_min"), F.max("room").alias("g_room"))
    matrix = ws.save(matrix, ws.unique("matrix"))
    smaller = "members < g_members or (members = g_members and part < g_part)"
    sized = f"{NUMERATOR} * g_min <= room and {NUMERATOR} * n <= g_room"
    wanted = ws.save(rows.join(matrix, "token").where("part <> g_part").where(smaller).where(sized)
                     .select("key", matrix["group"]).distinct(), ws.unique("wanted"))
    members = placed.select("group", "key").join(wanted.select("group").distinct(), "group").join(
        profiles.select("key", "text"), "key")
    payload = ws.save(members.groupBy("group").applyInArrow(
        _group_payload(width), "group long, members binary, sizes binary, sets binary, token_union binary"),
        ws.unique("groups"))
    asked = wanted.join(profiles.select("key", "text"), "key").join(payload, "group")
    return asked.select("key", "text", "members", "sizes", "sets", "token_union").mapInArrow(
        _opened(width), "src long, dst long")


def _joined_sets(docs: DataFrame, sets: DataFrame, ws: Workspace, width: int) -> DataFrame:
    """(node, rep): the component of every set (key, rep, text_hash, n) of ``sets`` that links with another."""
    with ws.inner() as first:
        tokens = sets.agg(F.sum("n")).first()[0] or 0
        early = _shared(docs, tokens // 2, False, width).groupBy("key").agg(F.sum("shared").alias("shared"))
        least = f"greatest(1, floor(ceil({NUMERATOR} * n / {DENOMINATOR}) / 4))"
        alive = first.save(sets.join(early.withColumnRenamed("shared", "early"), "key")
                           .where(f"early >= {least} and rep is not null").drop("early"), "alive")
        rows, tokens = alive.agg(F.count("*"), F.sum("n")).first()
        # Texts are not shuffled to be told apart: a few others pass, which add to the counts and leave after that.
        row = ["doc_id", "text_hash"]
        wide = may_match(docs.withColumn("text_hash", F.xxhash64("text")),
                         alive.select(F.col("rep").alias("doc_id"), "text_hash"), row, rows)
        wide = first.save(wide, "wide")
        classes = _shared(wide, tokens or 0, True, width).groupBy("key").agg(
            F.sum("shared").alias("shared"), F.sort_array(F.collect_list(F.struct("range", "classes"))).alias("parts"))
        joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["classes"]))
        classes = first.save(classes.join(alive, "key").where(f"shared >= ceil({NUMERATOR} * n / {DENOMINATOR})")
                             .select("key", F.col("rep").alias("doc_id"), "text_hash", joined.alias("classes")), "classes")
        # A set has one row here, and repeated documents meet in the partitions of the join.
        held = wide.join(classes, row).dropDuplicates(row)
        profiles = ws.save(held.select("key", "text", "classes").mapInArrow(
            _profiles(width), "key long, n long, weight double, marks array<long>, prefix array<long>, text string"),
            ws.unique("profiles"))
    with ws.inner() as second:
        typical = ws.save(_typical_links(profiles, second, width), ws.unique("typical_links"))
    with ws.inner() as third:
        parts = third.save(connected_components(third, typical), "parts")
        found = typical.unionByName(_matrix_links(profiles, parts, third, width))
        found = ws.save(found, ws.unique("links"))
    return connected_components(ws, found)


def jaccard_components(docs: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row (doc_id, text), as in ``jaccard_rows``."""
    return jaccard_rows(docs, ws, width).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, part, text_hash) of every row (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach. Null and empty texts and texts without words
    have no shingles and are alone; a text shorter than a shingle is one shingle. Repeated rows are
    documents with equal sets. A null doc_id is never the smallest. ``part`` tells components apart where rows
    of one id have different texts, and is null without shingles; ``text_hash`` is ``xxhash64`` of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    described_rows = ws.save(described(docs, width), ws.unique("described"))
    with ws.inner() as step:
        sets = step.save(described_rows.where("key is not null").groupBy("key").agg(
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first"),
            F.min("n_shingles").alias("n")).select("key", F.col("first.doc_id").alias("rep"), "first.text_hash", "n"), "sets")
        parts = step.save(_joined_sets(docs, sets, step, width), "parts")
        parts = parts.select(F.col("node").alias("key"), F.col("rep").alias("part"))
        members = parts.join(sets.select("key", "rep"), "key")
        smallest = step.save(members.groupBy("part").agg(F.min("rep").alias("least")), "smallest")
        linked_sets = step.save(parts.join(smallest, "part").select("key", "least", "part"), "linked_sets")
        named = sets.select("key", "rep").join(linked_sets, "key", "left").select(
            "key", F.coalesce("least", "rep").alias("least"), F.coalesce("part", "key").alias("part"))
        named = ws.save(named, ws.unique("named"))
    return described_rows.join(named, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "part", "text_hash")
