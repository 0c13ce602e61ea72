"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Up to ``bits`` differing bits change at most ``bits`` bytes, so linked fingerprints share at
least ``8 - bits`` bytes at their positions (5 for 3 bits). The index posts every distinct fingerprint under
compounds of positional bytes: three positions of the same half. Of any five shared positions three lie in one half,
so every linked pair meets in at least one of the eight lists. Within a list the shared positional bytes of a pair are
tallied, pairs below the guaranteed minimum are dropped, and the rest verified bit by bit.

Equal fingerprints are one entry, so copies cost nothing. A list never yields all its pairs: only links that join two
parts of it not yet joined leave the task, at most one less than its entries. Lists longer than ``LIST_LIMIT`` are
posted again under a quarter of the bits that remain free (up to 3 differing bits leave one of four quarters equal),
and so on; no entry or link is lost.

Texts without words (null, empty, white space) have fingerprint zero and link like any other. Rows with equal ids
count as they are; null ids never are a component's id. Extra columns pass only where named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col, scan_texts, spaced_words
from fieldweave.llm.components import components
from fieldweave.session import freeze

SHINGLE = 3
BITS = 3
LIST_LIMIT = 20_000
_STRETCH = 1 << 16
_U = np.uint64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the word shingles, repeats included."""
    import xxhash

    words = spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STRETCH):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _STRETCH], stops[at : at + _STRETCH])], _U)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def make():
        return lambda texts, _: {"fp": np.array([fingerprint(t, shingle) for t in texts], _U).view(np.int64)}

    return scan_texts(docs, text, keep, make, [("fp", T.LongType())])


def _halves() -> list[tuple[int, ...]]:
    """The eight compounds of three byte positions: all triples of the lower and of the upper four."""
    return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def _mask(positions: Sequence[int]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _quarters(mask: int) -> list[int]:
    """The free bits of a list with equal bits ``mask``, in four nearly equal parts."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << b for b in free[k::4]) for k in range(4)]


def list_links(values: np.ndarray, bits: int = BITS, block: int = 1024) -> list[tuple[int, int]]:
    """Links between distinct fingerprints that join parts of the list: a spanning forest of its links."""
    n = len(values)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    out: list[tuple[int, int]] = []
    least = 8 - bits
    for at in range(0, n, block):
        rows = values[at : at + block]
        for to in range(at, n, block):
            diff = rows[:, None] ^ values[None, to : to + block]
            # tally of shared positional bytes, then the bits themselves
            shared = (diff.view(np.uint8).reshape(*diff.shape, 8) == 0).sum(axis=2)
            i, j = np.nonzero((shared >= least) & (np.bitwise_count(diff) <= bits))
            i, j = i + at, j + to
            i, j = i[i < j], j[i < j]
            while len(i):
                # drop pairs that are joined already, then join the first of the rest for each left end
                roots = np.array([root(k) for k in range(n)]) if len(i) > n else None
                ri = roots[i] if roots is not None else np.array([root(k) for k in i.tolist()])
                rj = roots[j] if roots is not None else np.array([root(k) for k in j.tolist()])
                apart = ri != rj
                i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
                _, first = np.unique(ri, return_index=True)
                for k in first.tolist():
                    a, b = root(int(i[k])), root(int(j[k]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((int(i[k]), int(j[k])))
    return out


def links(distinct: DataFrame, bits: int = BITS, limit: int = LIST_LIMIT) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) with at most ``bits`` differing bits: enough of them
    to connect whatever all such pairs connect."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees links of up to 3 bits")
    masks = [_mask(p) for p in _halves()]
    base = distinct.select("fp").where("fp IS NOT NULL").distinct()
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    lists = base.select("fp", each.alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    found = []
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def within(key, batches):
        values = np.sort(np.concatenate([b.column("fp").to_numpy(zero_copy_only=False) for b in batches])).view(_U)
        if len(values) > 1:
            got = np.array(list_links(values, bits), np.int64).reshape(-1, 2)
            signed = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[got[:, 0]]), pa.array(signed[got[:, 1]])], names=["a", "b"])

    for depth in range(32):
        sizes = lists.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = freeze(sizes, "sizes")
        short = lists.join(sizes.where(F.col("n") <= limit).drop("n"), ["mask", "key"], "left_semi")
        # lists are few bytes and much work: a fixed number of partitions keeps them from being merged by size
        spread = int(short.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found.append(short.repartition(spread, "mask", "key").groupBy("mask", "key").applyInArrow(_iter_arrow(within), schema))
        long = sizes.where(F.col("n") > limit)
        # the distinct masks of one depth are few: 8 * 4 ** depth at most
        open_masks = [r["mask"] for r in long.select("mask").distinct().collect()]
        if not open_masks:
            break
        finer = F.lit(None).cast("array<bigint>")
        for m in open_masks:
            unsigned = m & (1 << 64) - 1
            finer = F.when(F.col("mask") == m, F.array(*[F.lit(_signed(unsigned | q)) for q in _quarters(unsigned)])).otherwise(finer)
        again = lists.join(long.drop("n"), ["mask", "key"], "left_semi").select("fp", F.explode(finer).alias("mask"))
        lists = freeze(again.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")), "lists")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _iter_arrow(fn):
    """A grouped Arrow function over the batches of a group."""
    from collections.abc import Iterator

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, limit: int = LIST_LIMIT) -> DataFrame:
    """Rows of ``docs`` as ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest id of a document
    whose fingerprint can be reached over links of at most ``bits`` differing bits."""
    rows = fingerprints(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), keep=["doc_id"], shingle=shingle)
    rows = freeze(rows, "fingerprints")
    return _labelled(rows, bits, limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(rows: DataFrame, bits: int, limit: int) -> DataFrame:
    """``rows`` with ``component_id``; ``rows`` has ``doc_id`` and ``fp``."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(freeze(links(classes, bits, limit), "links"))
    classes = freeze(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(classes.join(least, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with its own columns, one row of each component: the one with the smallest id (null last), and of rows
    that share it one, chosen by their whole contents."""
    names = docs.columns
    kept = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    key = F.col(f"_c{names.index(doc_id)}")
    whole = F.xxhash64(*[F.col(f"_c{i}").cast("string") if not _nested(f.dataType) else F.to_json(F.struct(f"_c{i}")) for i, f in enumerate(docs.schema.fields)])
    rows = fingerprints(kept.withColumn("_whole", whole), f"_c{names.index(text)}", [*kept.columns, "_whole"], shingle)
    rows = freeze(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    light = rows.select(key.alias("doc_id"), "fp", "_whole", "_row")
    best = _labelled_roots(light, bits)
    chosen = best.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_whole", "_row")).alias("x")).select(F.col("x._row").alias("_row"))
    return rows.join(chosen, "_row", "left_semi").select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def _labelled_roots(rows: DataFrame, bits: int) -> DataFrame:
    roots = components(freeze(links(rows.select("fp").distinct(), bits), "links"))
    return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
