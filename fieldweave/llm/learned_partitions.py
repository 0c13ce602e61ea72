"""Approximate nearest neighbours by learned partitions.

A bounded sample is joined to its nearest neighbours in a graph; the graph is cut into balanced parts by repeated
balanced reassignment towards the part most neighbours are in; a small network learns, for a vector, the share of its
neighbours in each part. Every vector of the table is indexed under its most probable part, every query is sent to its
most probable ones and reranked there by exact cosine. How many parts a query visits is learned too: as many as it
takes to find ``TARGET`` of the neighbours of sample vectors the network has not seen, and more where these hold too few
rows for ``k`` results.

``SAMPLE`` vectors (those with the smallest id hashes) are all that is fitted on the driver; whatever is not learned
covers all rows. A part is searched in blocks of ``BLOCK`` vectors and ``QUERY_BLOCK`` queries, so copies of one vector
in any number stay bounded; equal vectors in a block are compared once.

Vectors that are null, empty, zero, hold a null or non-finite number, or have another length than most take no part.
Components of any finite size serve; vectors are scaled by a power of two before squares are taken.
Rows with equal id and vector count once; a query's own row is every row with its id. Ties of the score go to the
smaller id. Tables of at most ``k`` candidates give all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col
from fieldweave.session import freeze

SAMPLE = 6144
NEIGHBOURS = 10
ROWS_PER_PART = 512
MAX_PARTS = 64
HIDDEN = 128
TARGET = 0.96
BLOCK = 8192
QUERY_BLOCK = 2048


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def in_range(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component below 1: squares can no longer leave the range of
    doubles, and as no digit changes the cosine is that of the original vectors."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The ``k`` nearest other rows of every unit row."""
    out = []
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Parts of at most equal size (rounded up) with many graph edges inside."""
    n, rng = len(graph), np.random.default_rng(seed)
    room = -(-n // parts)
    # grown from spread seeds along the graph, so that the first parts are already connected
    label = np.full(n, -1)
    label[rng.choice(n, parts, replace=False)] = np.arange(parts)
    votes = np.zeros((n, parts), np.float32)
    ends = graph.ravel()
    starts = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes[:] = 0
        known = label[ends] >= 0
        np.add.at(votes, (starts[known], label[ends[known]]), 1)
        known = label[starts] >= 0
        np.add.at(votes, (ends[known], label[starts[known]]), 1)
        stay = label >= 0
        votes[np.flatnonzero(stay), label[stay]] += 0.5
        votes += rng.random(votes.shape, np.float32) * 0.1
        free, label = np.full(parts, room), np.full(n, -1)
        for i in np.argsort(-votes.max(axis=1)):
            k = int(np.where(free > 0, votes[i], -1).argmax())
            label[i] = k
            free[k] -= 1
    return label


class Router:
    """A network of one hidden layer that gives each part's share of a vector's neighbours."""

    def __init__(self, inputs: int, parts: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, (2 / inputs) ** 0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        z = np.maximum(x @ a + b, 0) @ c + d
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 2e-3, seed: int = 13) -> None:
        rng, m, v, step = np.random.default_rng(seed), [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                h = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                g = (self.probabilities(x[at]) - target[at]) / len(at)
                gh = (g @ self.w[2].T) * (h > 0)
                grads = [x[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0)]
                step += 1
                for j, grad in enumerate(grads):
                    grad = grad + 1e-4 * self.w[j]
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.999 * v[j] + 0.001 * grad**2
                    self.w[j] = self.w[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)


def learn(sample: np.ndarray, parts: int, k: int) -> tuple[Router, int]:
    """The router and how many of its most probable parts a query visits."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(5).permutation(len(x))]
    if parts < 2 or len(x) < 4 * parts or len(x) < 4 * NEIGHBOURS:
        return Router(sample.shape[1], 1), 1
    asked, base = x[: len(x) // 4], x[len(x) // 4 :]
    graph = neighbour_graph(base, NEIGHBOURS)
    label = balanced_parts(graph, parts)
    target = np.zeros((len(base), parts))
    np.add.at(target, (np.repeat(np.arange(len(base)), graph.shape[1]), label[graph.ravel()]), 1.0)
    target[np.arange(len(base)), label] += 1.0
    router = Router(x.shape[1], parts)
    router.fit(base, target / target.sum(axis=1, keepdims=True))
    # visits: over unseen vectors, the place of each true neighbour's part in the query's order
    home = router.probabilities(base).argmax(axis=1)
    nearest = np.argpartition(-(asked @ base.T), k - 1, axis=1)[:, :k]
    order = np.argsort(-router.probabilities(asked), axis=1)
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, home[nearest], axis=1).ravel()) + 1
    return router, int(needed[int(np.ceil(TARGET * len(needed))) - 1])


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Query number, id and score of the ``k`` best rows of the block for each query, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    # of equal vectors only the first k + 1 ids can be among a query's best (one may be the query's own)
    _, same = np.unique(rows, axis=0, return_inverse=True)
    same = same.ravel()
    by_class = np.argsort(same, kind="stable")
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(same[by_class])) + 1])
    rank = np.arange(len(ids)) - np.repeat(firsts, np.diff(np.concatenate([firsts, [len(ids)]])))
    kept = np.sort(by_class[rank <= k])
    rows, ids = rows[kept], ids[kept]
    unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    out = []
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        near = (part / np.sqrt((part * part).sum(axis=1, keepdims=True))) @ unit.T
        near[query_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        if near.shape[1] > k:
            floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 1e-9
        else:
            floor = np.full(len(part), -2.0)
        for i in range(len(part)):
            at = np.flatnonzero(near[i] >= max(floor[i], -2.0))
            exact = cosine(part[i], rows[at])
            for j in np.lexsort((ids[at], -exact))[:k]:
                out.append((a + i, int(ids[at[j]]), float(exact[j])))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows found for every query row: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``."""
    source = vectors.select(col(vec_id).cast("bigint").alias("id"), col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = source.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("d", F.size("v"))
    common = good.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    n, d = (common["count"], common["d"]) if common else (0, 1)
    good = good.where(F.col("d") == d).drop("d")
    drawn = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"] if n else pa.chunked_array([pa.array([], pa.list_(pa.float64()))])
    fitted = np.array(drawn.to_pylist(), float).reshape(-1, d)
    fitted = in_range(fitted) if len(fitted) else fitted
    router, visits = learn(fitted, min(MAX_PARTS, n // ROWS_PER_PART), k) if n else (Router(d, 1), 1)

    def route(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            flat = in_range(flat) if len(flat) else flat
            p = router.probabilities(flat / np.linalg.norm(flat, axis=1, keepdims=True))
            order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
            asks = batch.column(2).to_pylist()
            parts = pa.array([o if q else o[:1] for o, q in zip(order, asks)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=["id", "v", "q", "parts"])

    # repeats would take several of a query's k places
    once = good.groupBy("id", "v").agg(F.max("q").alias("q"))
    routed = freeze(once.mapInArrow(route, "id bigint, v array<double>, q boolean, parts array<int>"), "routed")
    # at most MAX_PARTS counts
    sizes = {r["part"]: r["n"] for r in routed.groupBy(F.col("parts")[0].alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = routed.where("q")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(p, 0) // BLOCK))) for p in range(max([0, *sizes]) + 1)]), F.col("part") + 1)
    in_use = [p for p in sizes]
    # the learned number of parts, and further ones until they hold k rows besides those of the query's id
    own = routed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    held_by = F.array(*[F.lit(sizes.get(p, 0)).cast("bigint") for p in range(max([0, *sizes]) + 1)])
    rows_before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.get(held_by, p), F.lit(0).cast("bigint")))
    visited = F.filter("parts", lambda p, i: (i < visits) | (rows_before(i) < k + own))
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.explode(visited).alias("part")).where(F.col("part").isin(in_use))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    held = routed.select("id", "v", F.col("parts")[0].alias("part")).withColumn("block", F.pmod(F.xxhash64("id", "v"), blocks.cast("bigint")).cast("int"))
    held = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("qv", T.ArrayType(T.DoubleType())), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        matrix = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in c.chunks]).reshape(-1, d)
        ids, rows = right["id"].to_numpy(), matrix(right["v"])
        found = best_in_block(in_range(matrix(left["qv"])), left["query_id"].to_numpy(), in_range(rows), ids, k)
        at = pa.array([f[0] for f in found], pa.int64())
        columns = [left["query_id"].take(at), left["qv"].take(at), pa.chunked_array([pa.array([f[1] for f in found], pa.int64())]), pa.chunked_array([pa.array([f[2] for f in found], pa.float64())])]
        return pa.table([c.combine_chunks().cast(f.type) for c, f in zip(columns, target)], schema=target)

    keys = ["part", "block", "qb"]
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(rerank, schema).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
