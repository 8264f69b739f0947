"""Exact top-k search by inner product, in blocks.

Candidates and queries are packed into blocks. A block whose vectors are about equally long is a matrix, and two of
these are multiplied as such, in the smallest type that holds every sum exactly; a block of few entries is kept as
postings (dimension -> rows and weights), from which every query scatters its weighted terms into a dense array of
scores. Shares of the candidates meet shares of the queries in cells. In a cell the blocks of candidates pass the
queries one after the other, and a query keeps its best k with their ties cut by id, so that of a later block only
scores which reach the k-th best are looked at.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a block, and most components of its vectors, about.
CANDIDATES = 4096
QUERIES = 512
VALUES = 1 << 20
#: Bytes of the queries of a cell as matrices, and of its candidates, about.
QUERY_BYTES = 64 << 20
CANDIDATE_BYTES = 64 << 20
#: Pairs of a cell. Queries are not copied to more cells than these for it, or than candidates are copied.
PAIRS = 2_000_000_000
CELLS = 32
#: Columns of the first look at a cell's candidates; the next looks take twice as many each, up to the most. Of a
#: query's scores only strips with one among its best are looked at.
FIRST, MOST, STRIP = 64, 1024, 64
#: Integers up to these are exact in the type, and sums of which no part is larger.
EXACT = ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53))
BEST = "query_id long, query_hash long, vec_id long, score long"
BLOCK = "spread long, ids binary, hashes binary, width int, kind string, row binary, term binary, value binary"
_BLOCK = pa.schema([("spread", pa.int64()), ("ids", pa.binary()), ("hashes", pa.binary()), ("width", pa.int32()),
                    ("kind", pa.string()), ("row", pa.binary()), ("term", pa.binary()), ("value", pa.binary())])


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, weights): floor(256 * x) of each component as a long; unusable vectors are left out.

    Vectors that are null or hold a null or non-finite component are unusable, and so are rows without an
    id. Components outside the range of a long take its nearest end.
    """
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~odd)
        .select(F.col(vec_id).cast("long").alias("vec_id"),
                F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("weights"))
    )


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values in the smallest integers that hold them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64)
                              if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _packed(ids: np.ndarray, hashes: np.ndarray | None, lengths: np.ndarray, values: np.ndarray) -> dict:
    """A row of ``BLOCK``: a matrix where that is not much more than the entries that are not zero, else these."""
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], np.repeat(np.argsort(order), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used, width = np.count_nonzero(values), int(lengths.max(initial=0))
    out = {"spread": int(ids[0]), "ids": ids.tobytes(), "hashes": None if hashes is None else hashes[order].tobytes()}
    values = _narrow(values)
    if len(ids) * width <= 4 * used + VALUES // 16:
        matrix = np.zeros((len(ids), width), values.dtype)
        matrix[row, term] = values
        return out | {"width": width, "kind": matrix.dtype.name, "row": None, "term": None, "value": matrix.tobytes()}
    kept = np.flatnonzero(values)
    kept = kept[np.lexsort((term[kept], row[kept]))]
    return out | {"width": -1, "kind": values.dtype.name, "row": row[kept].astype(np.int32).tobytes(),
                  "term": term[kept].astype(np.int32).tobytes(), "value": values[kept].tobytes()}


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, weights), and query_hash for queries, as rows of ``BLOCK`` of at most ``size`` of them."""
    most = VALUES

    def pack(batches):
        waiting, count, held = [], 0, 0

        def block():
            ids, hashes, lengths, values = (np.concatenate(x) if x[0] is not None else None for x in zip(*waiting))
            return _packed(ids, hashes, lengths, values)

        def written(found):
            return pa.RecordBatch.from_pylist([found], _BLOCK)

        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            hashed = "query_hash" in batch.schema.names
            hashes = batch.column("query_hash").to_numpy(zero_copy_only=False) if hashed else None
            weights = batch.column("weights")
            lengths = weights.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            ends = np.cumsum(lengths)
            at = 0
            while at < len(ids):
                begin = int(ends[at - 1]) if at else 0
                fits = int(np.searchsorted(ends, begin + most - held, side="right"))
                to = min(max(fits, at + (not waiting)), at + size - count, len(ids))
                if to > at:
                    part = slice(at, to)
                    waiting.append((ids[part], None if hashes is None else hashes[part], lengths[part],
                                    values[begin:int(ends[to - 1])]))
                    count, held, at = count + to - at, held + int(ends[to - 1]) - begin, to
                if count >= size or held >= most or at < len(ids):
                    yield written(block())
                    waiting, count, held = [], 0, 0
        if waiting:
            yield written(block())

    return rows.mapInArrow(pack, BLOCK)


class _Block:
    """A block as it is worked on. ``reach`` is the largest norm of its vectors, no sum of products is larger than
    that of both sides multiplied."""

    def __init__(self, ids, width, kind, row, term, value):
        self.ids = np.frombuffer(ids, np.int64)
        value = np.frombuffer(value, kind)
        if width >= 0:
            self.matrix = value.reshape(len(self.ids), width)
            squares = np.einsum("ij,ij->i", *2 * [self.matrix.astype(np.float64)])
        else:
            self.matrix, self.value = None, value.astype(np.int64)
            self.row, self.term = np.frombuffer(row, np.int32), np.frombuffer(term, np.int32)
            squares = np.bincount(self.row, self.value.astype(np.float64) ** 2, len(self.ids))
        self.reach = float(np.sqrt(squares.max(initial=0))) * (1 + 1e-9)
        self._as: dict = {}

    def entries(self):
        """(row, term, value) of the entries that are not zero, by row."""
        if self.matrix is not None:
            self.row, self.term = np.nonzero(self.matrix)
            self.value = self.matrix[self.row, self.term].astype(np.int64)
        return self.row, self.term, self.value

    def of(self, kind) -> np.ndarray:
        """The matrix with its numbers as ``kind``, of one kind at a time."""
        if kind not in self._as:
            self._as = {kind: self.matrix.astype(kind)}
        return self._as[kind]


def _scores(postings, count: int, terms: np.ndarray, weights: np.ndarray, kind) -> np.ndarray:
    scores = np.zeros(count, kind)
    for term, weight in zip(terms.tolist(), weights.tolist()):
        if term in postings:
            rows, values = postings[term]
            if len(rows) == count:
                scores += weight * values
            else:
                scores[rows] += weight * values
    return scores


class _Asking(_Block):
    """A block of queries with the best candidates of each so far, the best first."""

    def __init__(self, k, hashes, *block):
        super().__init__(*block)
        self.k, self.hashes = k, np.frombuffer(hashes, np.int64)
        shape = (len(self.ids), k)
        self.best, self.score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.have = np.zeros(len(self.ids), np.int64)

    def see(self, stored: _Block, seen: int) -> None:
        """Take what is among the best from a block of candidates, after ``seen`` others."""
        size = self.reach * stored.reach
        kind, most = next(((t, most) for t, most in EXACT if size <= most), (None, 0))
        if kind is None or self.matrix is None or stored.matrix is None:
            self._see_terms(stored, np.int64 if size < 2.0 ** 62 else object)
            return
        width = min(self.matrix.shape[1], stored.matrix.shape[1])
        mine, theirs = self.of(kind)[:, :width], stored.of(kind)[:, :width].T
        room, at = np.empty(len(self.ids) * MOST, kind), 0
        while at < len(stored.ids):
            wide = min(len(stored.ids) - at, MOST, max(FIRST, seen + at))
            wide -= wide % STRIP if wide > STRIP else 0
            scores = np.matmul(mine, theirs[:, at:at + wide], out=room[:len(self.ids) * wide].reshape(-1, wide))
            self._take(scores, stored.ids[at:at + wide], most)
            at += wide

    def _take(self, scores: np.ndarray, ids: np.ndarray, most: float) -> None:
        """``scores`` of all queries (rows) with candidates whose ids (columns) ascend, none beyond ``most``."""
        full = (self.have == self.k) & (self.score[:, -1] >= -most)
        least = np.where(full, self.score[:, -1], 0).astype(scores.dtype)
        least[~full] = -np.inf
        strip = min(STRIP, len(ids))
        scores, ids = scores.reshape(len(scores), -1, strip), ids.reshape(-1, strip)
        rows, strips = np.nonzero(scores.max(axis=2) >= least[:, None])
        if not len(rows):
            return
        last = np.where(full, self.best[:, -1], np.iinfo(np.int64).max)[rows, None]
        scores, ids, least = scores[rows, strips], ids[strips], least[rows, None]
        wanted = ((scores > least) | ((scores == least) & (ids < last))) & (ids != self.ids[rows, None])
        if strip > self.k and np.count_nonzero(wanted) > 2 * self.k * len(rows):
            cut = np.where(wanted, scores, -np.inf).astype(scores.dtype)
            wanted &= scores >= np.partition(cut, strip - self.k, axis=1)[:, strip - self.k, None]
        row, column = np.nonzero(wanted)
        self._merge(rows[row], ids[row, column], scores[row, column].astype(np.int64))

    def _see_terms(self, stored: _Block, kind) -> None:
        row, term, value = stored.entries()
        order = np.lexsort((row, term))
        cuts = np.flatnonzero(np.diff(term[order])) + 1
        postings = {int(term[x[0]]): (row[x], value[x].astype(kind)) for x in np.split(order, cuts) if len(x)}
        q_row, q_term, q_value = self.entries()
        starts = np.searchsorted(q_row, np.arange(len(self.ids) + 1))
        for i, query in enumerate(self.ids.tolist()):
            part = slice(starts[i], starts[i + 1])
            scores = _scores(postings, len(stored.ids), q_term[part], q_value[part].astype(kind), kind)
            if kind is object:
                scores = np.array([min(max(s, -2 ** 63), 2 ** 63 - 1) for s in scores.tolist()], np.int64)
            others = np.flatnonzero(stored.ids != query)
            if len(others) > self.k:
                reach = np.partition(scores[others], len(others) - self.k)[len(others) - self.k]
                others = others[scores[others] >= reach]
            best = others[np.lexsort((stored.ids[others], ~scores[others]))[:self.k]]
            self._merge(np.full(len(best), i), stored.ids[best], scores[best])

    def _merge(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put candidates, given with the rows of their queries, among the best."""
        touched = np.unique(row)
        old_row, old_at = np.nonzero(np.arange(self.k) < self.have[touched, None])
        old_row = touched[old_row]
        row = np.concatenate([old_row, row])
        ids = np.concatenate([self.best[old_row, old_at], ids])
        scores = np.concatenate([self.score[old_row, old_at], scores])
        order = np.lexsort((ids, ~scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        row, place = row[kept], place[kept]
        self.best[row, place], self.score[row, place] = ids[kept], scores[kept]
        self.have[touched] = np.bincount(row, minlength=len(self.ids))[touched]

    def found(self) -> pa.RecordBatch:
        row, at = np.nonzero(np.arange(self.k) < self.have[:, None])
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.ids[row], self.hashes[row], self.best[row, at], self.score[row, at])],
            names=["query_id", "query_hash", "vec_id", "score"])


def _search(k: int):
    def search(batches):
        cell, asking, seen = None, [], 0
        for batch in batches:
            for n in range(len(batch)):
                r = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                if r["cell"] != cell:
                    yield from (a.found() for a in asking)
                    cell, asking, seen = r["cell"], [], 0
                block = [r[c] for c in ("ids", "width", "kind", "row", "term", "value")]
                if r["hashes"] is not None:
                    asking.append(_Asking(k, r["hashes"], *block))
                    continue
                stored = _Block(*block)
                for a in asking:
                    a.see(stored, seen)
                seen += len(stored.ids)
        yield from (a.found() for a in asking)

    return search


def _shares(count: int, asked: int, values: int) -> tuple[int, int]:
    """Shares of the candidates and of the queries, from the rows of both and the components of the queries."""
    rounds = max(1, -(-values * 4 // QUERY_BYTES))
    held = count * values // max(1, asked) * 4
    most = max(CELLS, count * rounds // max(1, asked))
    return max(1, -(-held // CANDIDATE_BYTES), min(most, -(-count * asked // (rounds * PAIRS)))), rounds


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller id.

    Both inputs are frames of ``quantised``. A candidate with the query's id is not compared. Missing
    dimensions count as zero. A repeated candidate row is found as often as it occurs, a repeated query row
    is answered once, and two different vectors with one id are two queries. Scores beyond the range of a
    long take its nearest end. Empty inputs give no rows.
    """
    asked, values = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()
    shares, rounds = _shares(candidates.count(), asked, values)
    keyed = queries.distinct().select("vec_id", F.xxhash64("weights").alias("query_hash"), "weights")

    def placed(blocks, own, others, cell):
        """Each block in the cells of its share: one for each share of the other side."""
        return blocks.withColumn("own", F.pmod(F.xxhash64("spread"), F.lit(own)).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(F.expr(cell).alias("cell"), *_BLOCK.names)

    met = placed(_blocks(candidates.select("vec_id", "weights"), CANDIDATES), shares, rounds,
                 f"own * {rounds} + other").unionByName(
        placed(_blocks(keyed, QUERIES), rounds, shares, f"other * {rounds} + own"))
    # The queries of a cell come before its candidates.
    met = met.repartitionById(shares * rounds, "cell").sortWithinPartitions("cell", F.col("hashes").isNull())
    found = met.mapInArrow(_search(k), BEST)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
