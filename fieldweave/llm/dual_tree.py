"""Ranked lexical search of all documents for each item, by a dual-tree search.

Documents and items are rows of weights over the items' terms: what a term is worth in the document (its saturated
frequency) and in the item (its rarity, times its occurrences). Both are put under trees whose nodes hold, per term,
the largest weight below: an item node times a document node bounds every score below the two. A pair of nodes is
given up if the bound is under the weakest k-th best score that any item below the item node has so far; what is left
is scored in whole numbers. Nothing that belongs to a result is given up, and equal scores are told apart by id.

Documents are read once into vectors over the items' terms. Items are taken in bundles of bounded text, which is what
is broadcast. A search over a part of the documents gives first k-th scores, so that the search over all of them can
give up early; it only saves work. A task returns at most k documents per item, and those of all tasks are ranked again.

Items with equal id and text are one item; items without terms, and null texts, have no result. Documents without terms
count nowhere. Repeated rows of documents are documents of their own; a null document id ranks last among equal scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col, plain_words, scan_texts
from fieldweave.session import freeze

TOP = 10
BUNDLE_BYTES = 8 << 20
ITEMS_PER_TREE = 64
CELLS = 1 << 20
FAN_OUT = 8
SEED_PART = 64
_EXACT = 1 << 52


def document_weights(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Whole-number worth of a term that occurs ``tf`` times in a document of ``n`` terms."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * docs // terms))


class Tree:
    """Levels of maxima over the rows of a matrix, ``FAN_OUT`` rows or nodes below each node; the last level is one node."""

    def __init__(self, rows: np.ndarray):
        self.levels = [rows]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN_OUT), axis=0))


def _similar_order(rows: np.ndarray) -> np.ndarray:
    """Rows whose heaviest columns agree stand together."""
    best = np.argsort(-rows, axis=1, kind="stable")[:, :2] if rows.shape[1] > 1 else np.zeros((len(rows), 2), int)
    return np.lexsort((best[:, 1], best[:, 0]))


class Items:
    """Some items under one tree, over the columns that occur in them, with their best documents so far."""

    def __init__(self, numbers: list[int], vectors: list[dict[int, int]], k: int, floors: dict[int, int]):
        self.columns = np.array(sorted(set().union(*vectors)), np.int64)
        place = {c: i for i, c in enumerate(self.columns.tolist())}
        rows = np.zeros((len(vectors), len(place)), np.int64)
        for i, v in enumerate(vectors):
            for c, w in v.items():
                rows[i, place[c]] = w
        order = _similar_order(rows)
        # doubles hold these whole numbers exactly; where they could not, slower integer products do
        self.kind = np.float64 if rows.sum(axis=1).max(initial=0) * 1_000_000 < _EXACT else np.int64
        self.numbers = [numbers[i] for i in order.tolist()]
        self.tree = Tree(rows[order].astype(self.kind))
        self.k = k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in self.numbers]
        self.floor = np.array([max(1, floors.get(n, 1)) for n in self.numbers], np.int64)

    def weakest(self, level: int) -> np.ndarray:
        out = self.floor
        for _ in range(level):
            out = np.minimum.reduceat(out, np.arange(0, len(out), FAN_OUT))
        return out

    def meet(self, item: int, scores: np.ndarray, ids: list) -> None:
        found = [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)]
        self.best[item] = sorted(self.best[item] + found)[: self.k]
        if len(self.best[item]) == self.k:
            self.floor[item] = max(self.floor[item], -self.best[item][-1][0])

    def search(self, docs: Tree, ids: list) -> int:
        """Offers the documents below ``docs`` to the items; returns how many pairs of rows were scored."""
        items, scored = self.tree, 0
        stack = [(len(items.levels) - 1, 0, len(docs.levels) - 1, np.zeros(1, np.int64))]
        while stack:
            a, node, b, theirs = stack.pop()
            row = items.levels[a][node]
            bounds = docs.levels[b][theirs] @ row
            keep = bounds >= self.weakest(a)[node]
            theirs, bounds = theirs[keep], bounds[keep]
            if not b:
                scored += len(keep) if not a else 0
            if not len(theirs):
                continue
            if not a and not b:
                self.meet(node, bounds.astype(np.int64), [ids[i] for i in theirs.tolist()])
                continue
            if b and b >= a:
                below = (theirs[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                stack.append((a, node, b - 1, below[below < len(docs.levels[b - 1])]))
            else:
                children = range(node * FAN_OUT, min((node + 1) * FAN_OUT, len(items.levels[a - 1])))
                stack += [(a - 1, child, b, theirs) for child in children]
        return scored


def item_trees(items: list[tuple[int, dict[int, int]]], k: int, floors: dict[int, int]) -> list[Items]:
    """Items that share terms under common trees."""
    ordered = sorted(items, key=lambda i: (max(i[1], key=lambda c: (i[1][c], c)), i[0]))
    parts = [ordered[a : a + ITEMS_PER_TREE] for a in range(0, len(ordered), ITEMS_PER_TREE)]
    return [Items([n for n, _ in part], [v for _, v in part], k, floors) for part in parts]


class Batch:
    """Documents as sparse rows: places, columns and weights."""

    def __init__(self, ids: list, sizes: np.ndarray, columns: np.ndarray, weights: np.ndarray, width: int):
        place = np.repeat(np.arange(len(ids)), sizes)
        # documents with the same heaviest column stand together; columns are numbered from rare to common
        lead = np.full(len(ids), width, np.int64)
        np.minimum.at(lead, place, columns)
        order = np.argsort(lead, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        by = np.argsort(rank[place], kind="stable")
        self.ids = [ids[i] for i in order.tolist()]
        self.place, self.columns, self.weights, self.width = rank[place][by], columns[by], weights[by], width

    def parts(self, rows: int):
        for at in range(0, len(self.ids), rows):
            a, b = np.searchsorted(self.place, [at, at + rows])
            n = min(rows, len(self.ids) - at)
            yield self.ids[at : at + n], self.place[a:b] - at, self.columns[a:b], self.weights[a:b]


def offer(trees: list[Items], batch: Batch) -> int:
    """Offers a batch of documents to all items; returns the number of pairs scored."""
    scored = 0
    for ids, place, columns, weights in batch.parts(512):
        top = np.zeros(batch.width, np.int64)
        np.maximum.at(top, columns, weights)
        for items in trees:
            root = items.tree.levels[-1][0]
            if (top[items.columns].astype(items.kind) @ root) < items.floor.min():
                continue
            local = np.full(batch.width, -1, np.int64)
            local[items.columns] = np.arange(len(items.columns))
            to = local[columns]
            here = to >= 0
            present, rows = np.unique(place[here], return_inverse=True)
            step = max(FAN_OUT, CELLS // max(1, len(items.columns)))
            for at in range(0, len(present), step):
                n = min(step, len(present) - at)
                some = (rows >= at) & (rows < at + n)
                dense = np.zeros((n, len(items.columns)), items.kind)
                dense[rows[some] - at, to[here][some]] = weights[here][some]
                scored += items.search(Tree(dense), [ids[p] for p in present[at : at + n].tolist()])
    return scored


def _vectors(docs: DataFrame, doc_id: str, text: str, terms: list[bytes]) -> DataFrame:
    """Per document ``doc_id``, ``n`` (all its terms), and the columns and frequencies of the given terms in it."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def make():
        place = held.value

        def run(texts, _):
            out = {"n": [], "columns": [], "tf": []}
            for t in texts:
                words = plain_words(t)
                found = Counter(c for c in map(place.get, words) if c is not None)
                out["n"].append(len(words))
                out["columns"].append(np.fromiter(found.keys(), np.int32, len(found)))
                out["tf"].append(np.fromiter(found.values(), np.int64, len(found)))
            return out

        return run

    whole = T.ArrayType(T.IntegerType())
    source = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    return scan_texts(source, "text", ["doc_id"], make, [("n", T.LongType()), ("columns", whole), ("tf", T.ArrayType(T.LongType()))])


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _found(vectors: DataFrame, items: list[tuple[int, dict[int, int]]], order: np.ndarray, docs: int, terms: int, k: int, floors: dict[int, int]) -> DataFrame:
    """Up to ``k`` documents per item and task: ``item``, ``doc_id``, ``score``."""
    held = vectors.sparkSession.sparkContext.broadcast((items, order, floors))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("item", "doc_id", "score")])

    def run(batches):
        items, order, floors = held.value
        trees = item_trees(items, k, floors)
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("columns")).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            weights = document_weights(_flat(batch.column("tf")).astype(np.int64), np.repeat(n, sizes), docs, terms)
            offer(trees, Batch(batch.column("doc_id").to_pylist(), sizes, order[_flat(batch.column("columns"))], weights, len(order)))
        rows = [(n, None if none else d, -s) for t in trees for n, best in zip(t.numbers, t.best) for s, none, d in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "columns", "tf").mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_bundle(docs: DataFrame, bundle: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """Results of a bundle of items (``item``, ``text``), whose text is bounded."""
    counted = [(r["item"], Counter(plain_words(r["text"].encode()))) for r in bundle.collect()]
    counted = [(n, c) for n, c in counted if c]
    terms = sorted(set().union(*(c for _, c in counted)))
    vectors = freeze(_vectors(docs, doc_id, text, terms), "vectors")
    totals = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = vectors.select(F.explode("columns").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("df"))
    rarity = F.floor(1000 * F.log((2 * F.lit(totals["docs"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    # as many rows as the bundle has terms
    worth = np.full(len(terms), -1, np.int64)
    for r in df.select("c", rarity.alias("w")).collect():
        worth[r["c"]] = r["w"]
    order = np.empty(len(terms), np.int64)
    order[np.argsort(-worth, kind="stable")] = np.arange(len(terms))
    place = {t: i for i, t in enumerate(terms)}
    # terms that no document holds, or that are worth nothing, add to no score
    items = [(n, {int(order[place[t]]): c[t] * int(worth[place[t]]) for t in c if worth[place[t]] > 0}) for n, c in counted]
    items = [(n, v) for n, v in items if v]
    sized = vectors.where(F.size("columns") > 0)
    part = sized.where(F.pmod(F.xxhash64("doc_id", "columns"), F.lit(SEED_PART)) == 0)
    first = _ranked(_found(part, items, order, totals["docs"], totals["terms"], k, {}), k).where(F.col("rank") == k)
    floors = {r["item"]: r["score"] for r in first.collect()}
    return _ranked(_found(sized, items, order, totals["docs"], totals["terms"], k, floors), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``."""
    named = items.select(col(item_id).alias("item_id"), col(item_text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    named = freeze(named.withColumn("item", F.monotonically_increasing_id()), "items")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    bundles = max(1, -(-size // bundle_bytes))
    out = None
    for i in range(bundles):
        bundle = named.where(F.pmod(F.col("item"), F.lit(bundles)) == i).select("item", "text")
        found = freeze(_search_bundle(docs, bundle, doc_id, text, k), "found")
        out = found if out is None else out.unionByName(found)
    return out.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
