"""Documents that share most of their word n-grams, by a blocked product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct n-gram sets (copies are one row), columns the n-grams, told apart by 64-bit hashes.
Two rows are linked when ``den * overlap >= num * union``.

Blocks. Rows of sizes that can be linked meet in a common size slot, whose columns are dealt into groups, one more than
two linked rows can differ in (plus spare ones): so linked rows agree in all entries of at least one group that is not
empty. Rows that agree in a group form a block. Spare groups make up for empty ones; a row with more empty groups
than that is posted in those too. This loses no pair, whatever passages many documents share.

Product. Pairs are dropped from the start if their sizes cannot reach the threshold, or if fewer column groups agree than
must at these sizes (a product of short outlines, which come with the first scan: whole rows are made and sent only where an
outline leaves a partner). Overlaps of the rest are counted
over stretches of columns; after each stretch those that the columns left cannot bring to the threshold are dropped. A block's pivot is its row of smallest hash, mostly
the same for all blocks of near copies. Each row is first multiplied with its pivots. Where several parts are left in a
block, pairs of different parts are multiplied (each pair once for all blocks of at most ``SMALL`` rows), in larger blocks
the rows outside the largest part with all others. Only links that join two parts leave a task, so that a large group of
near copies never yields its pairs.

Posts travel in packed batches per hash range, each class once per chunk. Texts without words are linked with nothing;
repeated and null ids pass through, the smallest id that is not null names a component. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col, scan_texts, slices, spaced_words
from fieldweave.llm.components import components
from fieldweave.llm.simhash import _iter_arrow
from fieldweave.session import freeze

SHINGLE = 4
NUM, DEN = 85, 100
GROWTH = 1.5
POSTS_PER_RANGE = 1 << 20
BLOCK_ROWS = 256
CROSS = 4
BLOCK_GRAMS = 1 << 20
SMALL = 32
KEPT_WORDS = 1 << 19
STRETCHES = 4
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _ODD[2]
    return x ^ x >> _U(27)


class _Words(dict):
    """The hash of each word, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


_words = _Words()


def gram_set(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word n-grams, in order; of all words together where they are fewer."""
    words = spaced_words(text)
    if not words:
        return np.zeros(0, _U)
    hashed = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    n = min(n, len(words))
    sums = np.full(len(words) - n + 1, n, _U)
    for i in range(n):
        sums = _mix(sums * _ODD[0] + hashed[i : len(words) - n + 1 + i])
    return np.unique(sums)


@contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Lets Spark put Bloom filters (of bounded size) before the larger side of a join, however large its files are."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def differing(total: int, num: int = NUM, den: int = DEN) -> int:
    """How many entries two linked rows of ``total`` entries together can differ in."""
    return total * (den - num) // (den + num)


@lru_cache(maxsize=None)
def slots(num: int, den: int) -> tuple[list[int], list[int], list[int]]:
    """Size slots: first size, number of column groups, and spare groups of each."""
    starts, size = [], 1
    while size < 1 << 40:
        starts.append(size)
        size = max(size + 1, int(size * GROWTH))
    differ = [differing(2 * (b - 1), num, den) for b in starts[1:]]
    spare = [0 if d == 0 else 2 + d // 8 for d in differ]
    return starts, [d + 1 + s for d, s in zip(differ, spare)], spare


@lru_cache(maxsize=1 << 16)
def row_slots(size: int, num: int = NUM, den: int = DEN) -> list[int]:
    """The slot of a size, and the next one where a larger row can be linked from there."""
    starts = slots(num, den)[0]
    slot = int(np.searchsorted(starts, size, "right")) - 1
    return [slot, slot + 1] if size * den // num >= starts[slot + 1] else [slot]


def group_sums(hashes: np.ndarray, groups: int) -> np.ndarray:
    """One hash per column group of a row (its sorted hashes): 0 where it has no entry."""
    out = np.zeros(groups, _U)
    place = ((hashes >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out[place[first]] = _mix(np.add.reduceat(_mix(hashes * _ODD[0]), first)) | _U(1)
    return out


def slot_sums(hashes: np.ndarray, num: int = NUM, den: int = DEN) -> list[tuple[int, np.ndarray]]:
    """The slots of a row with its group sums there; none for an empty row."""
    groups = slots(num, den)[1]
    return [(at, group_sums(hashes, groups[at])) for at in row_slots(len(hashes), num, den)] if len(hashes) else []


def group_keys(hashes: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The keys of the blocks in which a row stands; none where only copies can be linked."""
    _, groups, spare = slots(num, den)
    out = [np.zeros(0, _U)]
    for at, sums in slot_sums(hashes, num, den):
        if groups[at] > 1:
            names = np.flatnonzero(sums)
            if groups[at] - len(names) > spare[at]:
                names = np.arange(groups[at])
            out.append(_mix(_mix(sums[names] + names.astype(_U) * _ODD[1]) + _ODD[:1] * _U(at + 1)))
    return np.concatenate(out)


def outline(sums_of: list[tuple[int, np.ndarray]]) -> bytes:
    """8 bits of every group of a row's slots, one slot after the other; 0 stands for an empty group only."""
    return b"".join(sums.astype(np.uint8).tobytes() for _, sums in sums_of)


class Outlines:
    """The outlines of some rows, to tell which pairs can be linked."""

    def __init__(self, sizes: list[int], bits: list[bytes], num: int = NUM, den: int = DEN):
        self.sizes, self.num, self.den = np.array(sizes, np.int64), num, den
        self.groups = slots(num, den)[1]
        of = [row_slots(n, num, den) for n in sizes]
        self.first = np.array([s[0] for s in of], np.int64)
        self.at, self.bits = np.zeros((len(of), 2), np.int64), {}
        for slot in {s for both in of for s in both}:
            # a row's second slot stands behind its first
            rows = [i for i, both in enumerate(of) if slot in both]
            skip = [0 if of[i][0] == slot else self.groups[slot - 1] for i in rows]
            self.at[rows, [of[i].index(slot) for i in rows]] = np.arange(len(rows))
            self.bits[slot] = np.array([np.frombuffer(bits[i], np.uint8, self.groups[slot], k) for i, k in zip(rows, skip)])

    def partners(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of the rows ``others`` whose groups agree with those of ``x`` as often as in linked rows of these sizes."""
        sizes, size = self.sizes[others], self.sizes[x]
        keep = self.den * np.minimum(sizes, size) >= self.num * np.maximum(sizes, size)
        others, sizes = others[keep], sizes[keep]
        # a pair meets in the first slot of its larger row
        meet = np.maximum(self.first[others], self.first[x])
        out = []
        for slot in np.unique(meet).tolist():
            here = meet == slot
            rows, m = others[here], self.groups[slot]
            mine = self.bits[slot][self.at[x, slot - self.first[x]]]
            agree = (self.bits[slot][self.at[rows, slot - self.first[rows]]] == mine).sum(axis=1)
            out.append(rows[agree >= m - (sizes[here] + size) * (self.den - self.num) // (self.den + self.num)])
        return np.concatenate(out) if out else others


def _class(hashes: np.ndarray) -> int:
    import xxhash

    return struct.unpack("q", struct.pack("Q", xxhash.xxh64_intdigest(hashes.tobytes(), 11)))[0]


def product(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Linked pairs that join parts (``labels``) not joined yet; with ``left`` (a mask) one of a pair is of the left rows."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    cuts = [_U(s) << _U(64 - STRETCHES.bit_length() + 1) for s in range(1, STRETCHES)]
    # entries of each row before the end of each stretch of columns
    until = np.array([[*np.searchsorted(s, cuts), len(s)] for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.ravel()
    label = np.unique(labels, return_inverse=True)[1].ravel()
    mark = np.zeros(len(names), np.int8)
    out: list[tuple[int, int]] = []
    for x in range(n) if left is None else np.flatnonzero(left).tolist():
        # a pair of two left rows is taken once
        other = np.arange(n) > x if left is None else ~left | (np.arange(n) > x)
        rest = np.flatnonzero(other & (label != label[x]))
        rest = rest[den * np.minimum(sizes[rest], sizes[x]) >= num * np.maximum(sizes[rest], sizes[x])]
        if not len(rest):
            continue
        row = flat[starts[x] : ends[x]]
        mark[row] = 1
        need = -(-num * (sizes[x] + sizes[rest]) // (den + num))
        shared = np.zeros(len(rest), np.int64)
        for s in range(STRETCHES):
            a = starts[rest] + (until[rest, s - 1] if s else 0)
            b = starts[rest] + until[rest, s]
            shared += _counts(mark, flat, a, b)
            alive = shared + np.minimum(sizes[rest] - until[rest, s], sizes[x] - until[x, s]) >= need
            rest, need, shared = rest[alive], need[alive], shared[alive]
            if not len(rest):
                break
        mark[row] = 0
        for y in rest.tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _counts(mark: np.ndarray, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marked entries in each stretch ``flat[a:b]``."""
    length = b - a
    if not length.sum():
        return np.zeros(len(a), np.int64)
    ends = np.cumsum(length)
    at = np.repeat(a - ends + length, length) + np.arange(ends[-1])
    running = np.concatenate([[0], np.cumsum(mark[flat[at]], dtype=np.int64)])
    return running[ends] - running[ends - length]


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _posts(docs: DataFrame, text: str, shingle: int, ranges: int, num: int, den: int) -> DataFrame:
    """Packed posts per hash range: keys (their lower half; the range stands for the upper bits) and classes, side by side."""
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("classes", T.BinaryType())])

    def pack(keys, classes):
        if not keys:
            return
        every = np.concatenate(keys)
        who = np.repeat(np.array(classes, np.int64), [len(k) for k in keys])
        to = ((every >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        low, who = every[order].astype(np.uint32), who[order]
        stops = np.append(cuts[1:], len(order))
        got = [(int(to[order[a]]), low[a:b].tobytes(), who[a:b].tobytes()) for a, b in zip(cuts.tolist(), stops.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.binary())], names=["range", "keys", "classes"])

    def run(batches):
        met, keys, classes, held = set(), [], [], 0
        for _, texts in slices(batches):
            for t in texts:
                hashes = gram_set(t, shingle)
                cls = _class(hashes)
                if cls in met:
                    continue
                met.add(cls)
                got = group_keys(hashes, num, den)
                if len(got):
                    keys.append(got)
                    classes.append(cls)
                    held += len(got)
                if held >= POSTS_PER_RANGE:
                    yield from pack(keys, classes)
                    keys, classes, held = [], [], 0
            if len(met) > 1 << 20:
                met = set()
        yield from pack(keys, classes)

    return docs.select(col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _lists(posts: DataFrame) -> DataFrame:
    """Entries of all blocks of two rows or more: ``list`` (a hash of the block's rows; null for a block of two, whose pair
    says all), ``pivot`` and ``cls``."""
    schema = T.StructType([T.StructField("list", T.LongType()), T.StructField("pivot", T.LongType()), T.StructField("cls", T.LongType())])

    def run(key, batches):
        keys, who = [], []
        for batch in batches:
            keys += [np.frombuffer(k, np.uint32) for k in batch.column("keys").to_pylist()]
            who += [np.frombuffer(c, np.int64) for c in batch.column("classes").to_pylist()]
        keys, who = np.concatenate(keys), np.concatenate(who)
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (who[1:] != who[:-1]))
        keys, who = keys[fresh], who[fresh]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        names = np.add.reduceat(_mix(who.view(_U) * _ODD[0]), first) + _mix(size.astype(_U) * _ODD[1])
        # equal lists are told once
        once = np.zeros(len(first), bool)
        once[np.unique(names, return_index=True)[1]] = True
        pick = once & (size > 1)
        first, size, names = first[pick], size[pick], names[pick]
        if not len(first):
            return
        ends = np.cumsum(size)
        at = np.repeat(first - ends + size, size) + np.arange(ends[-1])
        lead, name, many = np.repeat(who[first], size), np.repeat(names.view(np.int64), size), np.repeat(size > 2, size)
        rows = who[at] != lead
        yield pa.RecordBatch.from_arrays([pa.array(name[rows], pa.int64(), mask=~many[rows]), pa.array(lead[rows]), pa.array(who[at][rows])], names=["list", "pivot", "cls"])

    return posts.groupBy("range").applyInArrow(_iter_arrow(run), schema)


_MEMBER = T.StructType([T.StructField("uid", T.StringType()), T.StructField("cls", T.LongType()), T.StructField("part", T.LongType()), T.StructField("is_left", T.BooleanType())])


def _grouped(units: DataFrame, rows: DataFrame, fields: list[str], link, schema: T.StructType) -> DataFrame:
    """Pairs that ``link(parts, left, *fields)`` finds in each unit: ``units`` has ``uid``, ``cls``, ``part`` and ``is_left``.
    With the schema ``_MEMBER`` ``link`` gives rows, and rows of units come out."""
    wanted = ["cls", "part", "is_left", *fields]

    def run(key, batches):
        every = [[] for _ in wanted]
        for batch in batches:
            for values, name in zip(every, wanted):
                values += batch.column(name).to_pylist()
        if len(every[0]) > 1:
            ids, parts, left = np.array(every[0], np.int64), np.array(every[1], np.int64), np.array(every[2], bool)
            got = link(parts, left, *every[3:])
            if schema is _PAIR:
                got = np.array(got, np.int64).reshape(-1, 2)
                columns = [pa.array(ids[got[:, 0]]), pa.array(ids[got[:, 1]])]
            else:
                columns = [pa.array([key[0].as_py()] * len(got), pa.string()), pa.array(ids[got]), pa.array(parts[got]), pa.array(left[got])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the filter on the units always holds; Spark builds runtime filters from filtered tables only
    whole = units.where(F.length("uid") > 0).join(rows.select("cls", *fields), "cls").select(*wanted, "uid")
    return whole.repartition(spread, "uid").groupBy("uid").applyInArrow(_iter_arrow(run), schema)


def _multiply(units: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links within units (stored), by the product of their rows."""

    def link(parts, left, hashes):
        return product([np.frombuffer(h, _U) for h in hashes], parts, left, num, den)

    return freeze(_grouped(units, rows, ["hashes"], link, _PAIR), "links")


def _star_units(pairs: DataFrame, rows: int) -> DataFrame:
    """Units of ``pairs`` (``a``, ``b``): row ``a`` with its rows ``b`` in chunks."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / rows).cast("bigint").alias("chunks"))
    right = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), F.col("b").alias("cls"), F.lit(False).alias("is_left"))
    left = counts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("cls"), F.lit(True).alias("is_left"))
    return left.unionByName(right).select(F.concat_ws(":", "a", "chunk").alias("uid"), "cls", F.col("cls").alias("part"), "is_left")


def _outlined(pairs: DataFrame, outlines: DataFrame, rows: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` whose groups agree as often as those of linked rows do."""

    def link(parts, left, size, bits):
        x = int(np.flatnonzero(left)[0])
        return [(x, y) for y in Outlines(size, bits, num, den).partners(x, np.flatnonzero(np.arange(len(size)) != x)).tolist()]

    return freeze(_grouped(freeze(_star_units(pairs, rows), "units"), outlines, ["size", "outline"], link, _PAIR), "pairs")


def _meeting(units: DataFrame, outlines: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of each unit that by the outlines can be linked with a row of another part there."""

    def link(parts, left, size, bits):
        lines, n = Outlines(size, bits, num, den), np.arange(len(size))
        met = np.zeros(len(size), bool)
        for x in np.flatnonzero(left).tolist():
            found = lines.partners(x, np.flatnonzero((parts != parts[x]) & (~left | (n > x))))
            met[found] = True
            met[x] |= len(found) > 0
        return np.flatnonzero(met)

    return _grouped(freeze(units, "units"), outlines, ["size", "outline"], link, _MEMBER)


def _sets(docs: DataFrame, wanted: DataFrame, text: str, shingle: int) -> DataFrame:
    """``cls`` and ``hashes`` of the classes whose ``body`` is wanted, from one text each."""

    def whole():
        def run(texts, _):
            every = [gram_set(t, shingle) for t in texts]
            return {"cls": [_class(s) for s in every], "hashes": [s.tobytes() for s in every]}

        return run

    # stored, so that Spark measures it: it is broadcast, or a Bloom filter (see ``_grouped``) spares the other texts their shuffle
    wanted = freeze(wanted.select("body", "size"), "wanted").where("size > 0")
    texts = docs.select(col(text).cast("string").alias("text")).withColumn("body", F.xxhash64("text")).join(wanted, "body", "left_semi")
    return freeze(scan_texts(texts.dropDuplicates(["body"]), "text", [], whole, [("cls", T.LongType()), ("hashes", T.BinaryType())]), "sets")


def _of_size(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _parts(found: DataFrame, live: DataFrame) -> DataFrame:
    """``cls``, ``size`` and ``part`` of the rows in question."""
    roots = components(found).select(F.col("node").alias("cls"), "root")
    return freeze(live.join(roots, "cls", "left").select("cls", "size", F.coalesce("root", "cls").alias("part")), "parts")


def _small_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different parts in blocks of at most ``SMALL`` entries (``list``, ``pivot``, ``cls``, ``size``, ``part``), the pivot's aside."""
    entries = F.array_sort(F.collect_list(F.struct("cls", "size", "part")))
    rows = lists.groupBy("list").agg(entries.alias("x")).select(F.posexplode("x").alias("i", "u"), "x")
    rows = rows.select("u", F.explode(F.expr("slice(x, i + 2, size(x))")).alias("v")).where("u.part <> v.part").where(_of_size("u.size", "v.size", num, den))
    return rows.select(F.col("u.cls").alias("a"), F.col("v.cls").alias("b")).distinct()


def _crossing(lists: DataFrame, tops: DataFrame, rows: int) -> DataFrame:
    """Units for larger blocks: entries outside a block's largest part against all its entries, ``rows`` and not much more than
    ``BLOCK_GRAMS`` n-grams a side."""
    per = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(BLOCK_GRAMS) / F.col("widest"))))
    few, many = [F.ceil(c / per).cast("int") for c in (F.col("all") - F.col("most"), F.col("most"))]
    placed = lists.join(tops.select("list", "top", few.alias("few"), many.alias("many")), "list").withColumn("minor", F.col("part") != F.col("top"))
    here = F.pmod(F.xxhash64("cls", "list"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many")).cast("bigint")).cast("int")
    # units 0 .. few - 1 hold the minor entries, those after them the rest
    placed = placed.withColumn("block", here + F.when(F.col("minor"), 0).otherwise(F.col("few")))
    partner = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    units = placed.withColumn("other", F.explode(partner))
    first, second = F.least("block", "other"), F.greatest("block", "other")
    return units.select(F.concat_ws(":", "list", first, second).alias("uid"), "cls", "part", (F.col("block") == first).alias("is_left"))


def links(docs: DataFrame, sketches: DataFrame, classes: DataFrame, text: str, shingle: int, num: int = NUM, den: int = DEN, rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs ``a``, ``b`` of linked classes: enough to connect what all linked pairs connect. ``sketches``: ``cls``, ``size``,
    ``outline``; ``classes``: ``cls``, ``size``, ``body``."""
    total = classes.agg(F.sum("size")).first()[0] or 0
    share = 5 * (den - num) / (den + num)
    ranges = max(8, int(total * share / POSTS_PER_RANGE) + 1)
    lists = freeze(_lists(_posts(docs, text, shingle, ranges, num, den)), "lists")
    stars = freeze(lists.select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    named = stars.select(F.col("b").alias("cls")).unionByName(stars.select(F.col("a").alias("cls"))).distinct()
    live = freeze(classes.join(named, "cls", "left_semi").select("cls", "size", "body"), "live")
    sizes = live.where("size > 0").select("cls", "size")
    for end in ("a", "b"):
        stars = stars.join(sizes.select(F.col("cls").alias(end), F.col("size").alias(f"size_{end}")), end)
    stars = freeze(stars.where(_of_size("size_a", "size_b", num, den)).select("a", "b"), "pairs")
    outlines = sketches.where(F.length("outline") > 0).select("cls", "size", "outline").join(sizes.select("cls"), "cls", "left_semi")
    outlines = freeze(outlines.dropDuplicates(["cls"]), "outlines")
    # each row with its pivots
    units = freeze(_star_units(_outlined(stars, outlines, rows, num, den), rows), "units")
    sets = _sets(docs, live.join(units.select("cls"), "cls", "left_semi"), text, shingle)
    found = _multiply(units, sets, num, den)
    # what is left in blocks of several parts; pivots have met all others
    entries = freeze(lists.where("list IS NOT NULL").select("list", "cls").distinct().join(_parts(found, live), "cls"), "entries")
    best = F.max(F.struct("n", "part"))
    counted = entries.groupBy("list", "part").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("widest")).groupBy("list")
    tops = counted.agg(best["part"].alias("top"), best["n"].alias("most"), F.sum("n").alias("all"), F.max("widest").alias("widest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    tops = freeze(tops, "tops")
    small = _small_pairs(entries.join(tops.where(F.col("all") <= SMALL), "list", "left_semi"), num, den)
    small = _outlined(freeze(small.join(stars, ["a", "b"], "left_anti"), "pairs"), outlines, rows, num, den)
    large = _meeting(_crossing(entries, tops.where(F.col("all") > SMALL), CROSS * rows), outlines, num, den)
    units = freeze(_star_units(small, rows).unionByName(large), "units")
    more = live.join(units.select("cls"), "cls", "left_semi").join(sets.select("cls"), "cls", "left_anti")
    sets = sets.unionByName(_sets(docs, more, text, shingle))
    return found.unionByName(_multiply(units, sets, num, den))


def linked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN, rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_shingles``, and ``component_id``, the smallest id that links reach (the row's own
    id where it has no n-gram)."""

    def sketch():
        met = set()

        def run(texts, _):
            out = {"cls": [], "size": [], "outline": []}
            for t in texts:
                hashes = gram_set(t, shingle)
                cls = _class(hashes)
                out["cls"].append(cls)
                out["size"].append(len(hashes))
                # once per class and task
                out["outline"].append(None if cls in met else outline(slot_sums(hashes, num, den)))
                if len(met) > 1 << 20:
                    met.clear()
                met.add(cls)
            return out

        return run

    source = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    marked = source.withColumn("body", F.xxhash64("text"))
    fields = [("cls", T.LongType()), ("size", T.LongType()), ("outline", T.BinaryType())]
    sketches = freeze(scan_texts(marked, "text", ["doc_id", "body"], sketch, fields), "sketches")
    classes = freeze(sketches.where("size > 0").groupBy("cls").agg(F.min("size").alias("size"), F.min("body").alias("body"), F.min("doc_id").alias("first")), "classes")
    with runtime_filters(docs.sparkSession):
        found = links(source, sketches, classes, "text", shingle, num, den, rows)
    roots = components(found).withColumnRenamed("node", "cls")
    named = freeze(classes.join(roots, "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    out = sketches.join(named, "cls", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
