"""Approximate nearest neighbours by largest inner product: probed lists, scanned a few dimensions at a time.

Vectors lie in lists around centroids.  A scan of a list works on rotated
vectors kept in blocks of columns: after each block the part of the distance
that is known, scaled up to all dimensions, is tested against the distance of
the k-th best so far, and pairs that are too far with near certainty are
abandoned.  What survives is scored on the original vectors in double precision.

Inner products become distances through one more dimension that gives all
candidates the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Rows (those of the least hashes) that the centroids and the number of probed lists are fitted on, and the most lists.
SAMPLE, MOST_LISTS = 16384, 1024
#: Queries of the sample that the number of probed lists is fitted on, and the recall that it has to give there.
TRIED, RECALL = 256, 0.97
#: Candidates and queries that one group of a scan holds, about.
BLOCK, CHUNK = 2048, 4096
#: Columns that are looked at before a test, and how many standard deviations it allows.
COLUMNS, SURE = 16, 2.5
#: Queries and pairs that are handled at a time.
STEP, PAIRS = 512, 1 << 19
#: Parts in which the finds of a query are merged first.
SALTS = 32
SEED = 20240229


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (array of doubles) of the rows that take part.

    Null ids, vectors that are null, empty or zero or hold null, NaN or infinite
    components, and vectors of another length than most take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (most["n"] if most else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors, as lists or as bytes of doubles, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Index:
    """What a bounded sample teaches: the rotation, the centroids and how many lists to probe."""

    def __init__(self, sample: np.ndarray, n: int, longest: float, k: int):
        rnd = np.random.default_rng(SEED)
        self.longest = longest
        self.rotation = np.linalg.qr(rnd.standard_normal((sample.shape[1] + 1,) * 2))[0]
        rows = self.placed(sample)
        lists = max(1, min(MOST_LISTS, round(n**0.5), len(sample) // 16))
        self.centroids = rows[np.sort(rnd.choice(len(rows), lists, replace=False))].copy()
        for _ in range(10):
            own = self.lists(rows)
            sizes = np.bincount(own, minlength=lists)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, rows)
            self.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centroids)
        self.probes = self._probes(sample, rows, k)

    def placed(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the dimension that makes all candidates as long as the longest, rotated."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, self.longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
        return np.column_stack([vectors, rest]) @ self.rotation

    def _nearness(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.centroids.T - 0.5 * np.einsum("ij,ij->i", self.centroids, self.centroids)

    def lists(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(self._nearness(rows[a : a + 4096]), axis=1) for a in range(0, len(rows), 4096)])

    def order(self, rows: np.ndarray) -> np.ndarray:
        """All lists, nearest first, for each row."""
        return np.argsort(-self._nearness(rows), axis=1, kind="stable")

    def _probes(self, sample: np.ndarray, rows: np.ndarray, k: int) -> int:
        tried = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
        scores = sample[tried] @ sample.T
        scores[np.arange(len(tried)), tried] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centroids)
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        place = np.argsort(self.order(self.placed(sample[tried], query=True)), axis=1)  # of each list
        needed = np.sort(np.take_along_axis(place, self.lists(rows)[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1


def _best(query: np.ndarray, less: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, -score, id) the k best different ones of each query, in order, and their ranks from 0."""
    order = np.lexsort((vec_id, less, query))
    query, less, vec_id = query[order], less[order], vec_id[order]
    other = np.ones(len(query), bool)
    other[1:] = (query[1:] != query[:-1]) | (less[1:] != less[:-1]) | (vec_id[1:] != vec_id[:-1])
    query, less, vec_id = query[other], less[other], vec_id[other]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    kept = rank < k
    return query[kept], less[kept], vec_id[kept], rank[kept]


def _fewest_copies(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be found: of equal vectors, those with the k + 1 smallest ids."""
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(np.ascontiguousarray(vectors[order]).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sorted_group = group[by_group]
    rank = np.arange(len(group)) - np.searchsorted(sorted_group, sorted_group)
    return np.sort(order[by_group[rank <= k]])


class Scan:
    """Finds of some queries in the lists of one block."""

    def __init__(self, index: Index, k: int):
        self.index, self.k = index, k

    def survivors(self, queries: list[np.ndarray], rows: list[np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) whose squared distance may be within ``bound``; both sides come as blocks of columns.

        The first blocks are multiplied as matrices; when few pairs are left, they go on one by one.
        """
        total = sum(q.shape[1] for q in queries)
        known = np.zeros((len(queries[0]), rows[0].shape[0]), np.float32)
        pairs = None
        seen = 0
        for q, x in zip(queries, rows):
            seen += q.shape[1]
            factor = (total / seen) / (1 + SURE / np.sqrt(seen)) ** 2 if seen < total else 1 - 1e-4
            if pairs is None:
                known += np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", x, x)[None, :] - 2 * (q @ x.T)
                alive = known * factor <= bound[:, None]
                if alive.mean() < 0.1 or seen == total:
                    pairs = np.nonzero(alive)
                    known = known[pairs]
            else:
                keep = np.zeros(len(known), bool)
                for a in range(0, len(known), PAIRS):
                    at = slice(a, a + PAIRS)
                    known[at] += np.square(q[pairs[0][at]] - x[pairs[1][at]]).sum(axis=1)
                    keep[at] = known[at] * factor <= bound[pairs[0][at]]
                pairs, known = (pairs[0][keep], pairs[1][keep]), known[keep]
        return pairs

    def __call__(self, vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, probes: list[np.ndarray]):
        """Rows (query place, -score, id), the best first; ``probes`` are each query's lists of this block, nearest first."""
        kept = _fewest_copies(vectors, ids, lists, self.k)
        by_list = kept[np.argsort(lists[kept], kind="stable")]
        vectors, ids, lists = vectors[by_list], ids[by_list], lists[by_list]
        cut = lambda m: [np.ascontiguousarray(m[:, a : a + COLUMNS], np.float32) for a in range(0, m.shape[1], COLUMNS)]
        rows, asked = cut(self.index.placed(vectors)), cut(self.index.placed(queries, query=True))
        lengths = np.einsum("ij,ij->i", queries, queries) + self.index.longest**2
        bound = np.full(len(queries), np.inf)
        found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        # each query's nearest list first, so that the others are met with a bound
        turns = [(turn, p, q) for q, ps in enumerate(probes) for turn, p in ((0 if j == 0 else 1, p) for j, p in enumerate(ps))]
        turns = np.array(sorted(turns), np.int64).reshape(-1, 3)
        starts = np.flatnonzero(np.r_[True, (turns[1:, :2] != turns[:-1, :2]).any(axis=1)]) if len(turns) else []
        for a, b in zip(starts, [*starts[1:], len(turns)]):
            lo, hi = np.searchsorted(lists, [turns[a, 1], turns[a, 1] + 1])
            for c in range(a, b, STEP if hi > lo else b - a or 1):
                who = turns[c : min(b, c + STEP), 2]
                q, x = self.survivors([m[who] for m in asked], [m[lo:hi] for m in rows], bound[who].astype(np.float32)) if hi > lo else ((), ())
                if not len(q):
                    continue
                q, x = who[q], x + lo
                other = query_ids[q] != ids[x]
                q, x = q[other], x[other]
                less = np.concatenate([np.zeros(0), *(-np.einsum("ij,ij->i", queries[q[s : s + PAIRS]], vectors[x[s : s + PAIRS]]) for s in range(0, len(q), PAIRS))]) + 0.0
                found = _best(np.r_[found[0], q], np.r_[found[1], less], np.r_[found[2], ids[x]], self.k)
                last = found[3] == self.k - 1
                bound[found[0][last]] = lengths[found[0][last]] + 2 * found[1][last]
                bound = np.maximum(bound, 0.0)
        return found[:3]


def _layout(sizes: np.ndarray, asked: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """First block and number of blocks of each list, and chunks of queries of each block.

    A list of more than a block's candidates is cut into several blocks; small
    lists share one.
    """
    first, parts, chunks = [], [], []
    filled, met = 0, 0
    for size, queries in zip(sizes.tolist(), asked.tolist()):
        if chunks and filled and filled + size <= BLOCK:
            filled, met = filled + size, met + queries
            first.append(len(chunks) - 1)
            parts.append(1)
            chunks[-1] = max(1, -(-met // CHUNK))
        else:
            n = max(1, -(-size // BLOCK))
            first.append(len(chunks))
            parts.append(n)
            chunks += [max(1, -(-queries // CHUNK))] * n
            filled, met = (size, queries) if n == 1 else (0, 0)
    return first, parts, chunks


def _numbers(values: list[int], at) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` candidates of largest inner product found for each row whose id is divisible by ``every``.

    Candidates are all other rows.  Returns query_id, rank (from 1, ties to the
    smaller id), vec_id and score; all candidates if there are no more than
    ``k``.  See :func:`usable` for the rows that take no part.  Rows that repeat
    an id and a vector count once; of a query id with several vectors the
    least one (as bytes) asks.  An empty table gives no rows; other columns are
    not read.

    Rotation, centroids and the number of probed lists come from at most
    ``SAMPLE`` rows; every row is in a list.  A query's lists are its nearest
    ones, and further ones until they hold ``k`` other rows.  Groups of a scan
    are about ``BLOCK`` candidates by ``CHUNK`` queries, whatever the sizes of
    lists: large lists are cut by hash, and of equal vectors in one block only
    those of the k + 1 smallest ids can be found, so the rest is passed over.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    if not whole["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(np.array(few["v"].tolist()), whole["n"], whole["square"] ** 0.5, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1))
            if len(m):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index.lists(index.placed(m)), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], ["vec_id", "list", "v"])

    assigned = written(rows.mapInArrow(assign, "vec_id long, list int, v binary"), "lists")
    n_lists = len(index.centroids)
    sizes = np.zeros(n_lists, np.int64)
    for r in assigned.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = index.order(index.placed(_matrix(b.column(1)), query=True))
                enough = np.maximum(index.probes, 1 + np.argmax(np.cumsum(sizes[order], axis=1) >= min(k + 1, sizes.sum()), axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[:n].tolist() for o, n in zip(order, enough)], pa.list_(pa.int32()))], ["query_id", "q", "probes"])

    asking = assigned.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    queries = written(asking.mapInArrow(probe, "query_id long, q binary, probes array<int>"), "queries")
    asked = np.zeros(n_lists, np.int64)
    for r in queries.select(F.explode("probes").alias("list")).groupBy("list").count().collect():  # a row a list
        asked[r["list"]] = r["count"]

    first, parts, chunks = _layout(sizes, asked)
    left = assigned.withColumn("block", _numbers(first, F.col("list")) + F.pmod(F.xxhash64("vec_id"), _numbers(parts, F.col("list"))).cast("int"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), _numbers(chunks, F.col("block")) - 1)))
    blocks = F.array_distinct(F.flatten(F.transform("probes", lambda p: F.sequence(_numbers(first, p), _numbers(first, p) + _numbers(parts, p) - 1))))
    right = queries.withColumn("block", F.explode(blocks)).withColumn("chunk", F.pmod(F.xxhash64("query_id"), _numbers(chunks, F.col("block"))).cast("int"))
    lists_of = [[p for p, (f, n) in enumerate(zip(first, parts)) if f <= b < f + n] for b in range(len(chunks))] if len(chunks) <= n_lists else None
    scan = Scan(index, k)

    def finds(key: tuple, candidates: pa.Table, some: pa.Table) -> pa.Table:
        block = key[0].as_py()
        if not candidates.num_rows or not some.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "salt": pa.array([], pa.int32()), "less": pa.array([], pa.list_(pa.float64())), "ids": pa.array([], pa.list_(pa.int64()))})
        here = set(lists_of[block]) if lists_of else {p for p in range(n_lists) if first[p] <= block < first[p] + parts[p]}
        probes = [[p for p in ps if p in here] for ps in some["probes"].to_pylist()]
        query_ids = some["query_id"].to_numpy()
        q, less, ids = scan(_matrix(candidates["v"]), candidates["vec_id"].to_numpy(), candidates["list"].to_numpy(), _matrix(some["q"]), query_ids, probes)
        cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        ends = np.r_[cuts, len(q)].astype(np.int32)
        as_lists = lambda v, t: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t))
        return pa.table({"query_id": pa.array(query_ids[q[cuts]], pa.int64()), "salt": pa.array(np.full(len(cuts), block % SALTS), pa.int32()), "less": as_lists(less, pa.float64()), "ids": as_lists(ids, pa.int64())})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(finds, "query_id long, salt int, less array<double>, ids array<long>")
    pairs = found.select("query_id", "salt", F.zip_with("less", "ids", lambda s, i: F.struct(s.alias("less"), i.alias("vec_id"))).alias("best"))
    for keys in (["query_id", "salt"], ["query_id"]):
        pairs = pairs.groupBy(*keys).agg(F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("best")))), 1, k).alias("best"))
    return pairs.select("query_id", F.posexplode("best").alias("place", "one")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.less")).alias("score"))
