"""Deleted interpolation: an n-gram language model learned and applied without gathering the corpus anywhere.

Training texts are split by a hash of their id into a counting part and a held-out part. The probability of a token
mixes maximum-likelihood estimates of every order and a uniform one; the mixture weights depend on how often the
context was seen (buckets of doubling frequency, per longest context known) and are learned by
expectation-maximisation on the held-out part against the counts of the other. Scores then use the counts of both.

How it runs. Texts are tokenized once into chunks, written to the shared folder: word numbers, and the 64-bit hash of
each distinct word. A chunk sends each distinct n-gram once, with its count, to the range of key space it falls in;
that range adds up all chunks and answers each with totals in the order asked, so an n-gram in every text costs one
entry per chunk, not one per text, and counts are looked up without sending tokens. Ranges are as many as the tokens
ask for (a power of two), and a chunk writes only to ranges it has n-grams for. N-grams are told apart by 64-bit hashes.

Tokens: words between ASCII white space with A-Z lowered, then one end token. Null and empty texts have the end token
only. A null id trains. Rows are independent and repeats count as often as they occur. No training rows: every
probability is the uniform one. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col, slices, spaced_words
from fieldweave.session import freeze

ORDER = 2
CHUNK_BYTES = 6 << 20
TOKENS_PER_RANGE = 1_000_000
HELD_SHARE = 10  # one training text in so many is held out
STEPS = 12
FIT, HELD, TEST = 0, 1, 2
_LEVELS = 48  # frequency buckets of one order
_U = np.uint64
_END = _U(0x1F83D9ABFB41BD6B)
_START = _U(0x5BE0CD19137E2179)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: small ones cost little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(blob: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(blob[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as differences."""
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, _U), dtype=_U)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _U(0x9E3779B97F4A7C15)) ^ (right + _U(0xD1B54A32D192ED03) + (left >> _U(29)))
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


# ------------------------------------------------------------------ chunks

def chunks(docs: DataFrame, doc_id: str, text: str, group: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per about ``chunk_bytes`` of text of one group, written once: ``chunk``, ``group``, ``n_tokens``, the ids and
    token counts of its texts, its distinct words' hashes (ascending) and its tokens as places in that list."""
    rows = docs.select(col(text).cast("string").alias("text"), group.cast("int").alias("group"), col(doc_id).alias("doc_id"))
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("group", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, first = to_arrow_schema(schema), TaskContext.get().partitionId() << 33
        open_chunks: dict[int, list] = {}
        made = 0

        def close(kind: int) -> pa.RecordBatch:
            nonlocal made
            numbers, flat, sizes, ids, _ = open_chunks.pop(kind)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), _U, len(numbers))
            hashes[0] = _END  # the end token is number 0
            words, rank = np.unique(hashes, return_inverse=True)
            tokens = rank.astype(np.int32)[np.concatenate(flat)]
            made += 1
            row = [first + made, kind, len(tokens), ids, pack(np.array(sizes, np.int64)), pack_sorted(words), pack(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, target)], schema=target)

        for batch, texts in slices(batches):
            kinds, names = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for t, kind, name in zip(texts, kinds, names):
                if kind not in open_chunks:
                    open_chunks[kind] = [{b"": 0}, [], [], [], 0]
                state = open_chunks[kind]
                numbers = state[0]
                # numbers grow as words appear; the end token closes every text
                line = [numbers.setdefault(w, len(numbers)) for w in spaced_words(t)]
                line.append(0)
                state[1].append(np.array(line, np.int32))
                state[2].append(len(line))
                state[3].append(name)
                state[4] += len(t or b"") + 64
                if state[4] >= chunk_bytes:
                    yield close(kind)
        for kind in list(open_chunks):
            yield close(kind)

    return freeze(rows.mapInArrow(run, schema), "chunks")


class Chunk:
    """N-gram keys of a chunk: per order the distinct keys, ascending, and for each token its place among them."""

    def __init__(self, row: dict, order: int):
        self.sizes = unpack(row["sizes"], np.int64)
        words, tokens = unpack_sorted(row["words"]), unpack(row["tokens"], np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.is_start = np.zeros(len(tokens), bool)
        self.is_start[self.starts] = True
        self.is_end = np.zeros(len(tokens), bool)
        self.is_end[self.starts + self.sizes - 1] = True
        self.keys, self.places, self.counts = [words], [tokens], [np.bincount(tokens, minlength=len(words))]
        gram = hashes = words[tokens]
        for _ in range(1, order):
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[self.is_start] = _START
            gram = _mix(before, hashes)
            keys, places, counts = np.unique(gram, return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.places.append(places)
            self.counts.append(counts)


# ------------------------------------------------------------------ counts

def _cuts(keys: Sequence[np.ndarray], bits: int) -> tuple[list[int], list[np.ndarray]]:
    """The ranges (leading ``bits`` bits) that hold any of the ascending keys, and where each begins and ends in every list."""
    of = [(k >> _U(64 - bits)).astype(np.int64) for k in keys]
    used = np.unique(np.concatenate([r[np.flatnonzero(np.diff(r, prepend=-1))] for r in of]))
    return used.tolist(), [np.stack([np.searchsorted(r, used), np.searchsorted(r, used, "right")], axis=1) for r in of]


def exchange(parts: DataFrame, order: int, bits: int) -> DataFrame:
    """Answers to every chunk: per range of keys (their leading ``bits`` bits) and order the counts in the training parts (``all<k>``) and, for held-out
    chunks, in the counting part (``fit<k>``). Rows with a null chunk carry the range's distinct words and tokens."""
    ask_schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("group", T.IntegerType())]
        + [T.StructField(f"{x}{k}", T.BinaryType()) for k in range(order) for x in ("key", "n")])
    tell_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("group", T.IntegerType()), T.StructField("range", T.IntegerType())]
        + [T.StructField(f"{x}{k}", T.BinaryType()) for k in range(order) for x in ("all", "fit")]
        + [T.StructField(x, T.LongType()) for x in ("n_words", "n_all", "n_fit")])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(ask_schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Chunk(row, order)
                used, cuts = _cuts(c.keys, bits)
                columns: list[list] = [used, [row["chunk"]] * len(used), [row["group"]] * len(used)]
                for keys, counts, cut in zip(c.keys, c.counts, cuts):
                    columns.append([pack_sorted(keys[a:b]) for a, b in cut])
                    columns.append([pack(counts[a:b].astype(np.int64)) for a, b in cut])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, target)], schema=target)

    def tell(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(tell_schema)
        table = pa.Table.from_batches(list(batches))
        names, groups = table["chunk"].to_pylist(), table["group"].to_pylist()
        out: list[list] = [[*names, None], [*groups, None], [key[0].as_py()] * (len(names) + 1)]
        stats = []
        for k in range(order):
            asked = [unpack_sorted(x) for x in table[f"key{k}"].to_pylist()]
            given = [unpack(x, np.int64) for x in table[f"n{k}"].to_pylist()]
            keys, place = np.unique(np.concatenate(asked), return_inverse=True)
            kind = np.repeat(groups, [len(a) for a in asked])
            n = np.concatenate(given)
            fit = np.bincount(place, np.where(kind == FIT, n, 0), len(keys)).astype(np.int64)
            both = fit + np.bincount(place, np.where(kind == HELD, n, 0), len(keys)).astype(np.int64)
            ends = np.cumsum([len(a) for a in asked])
            spots = [place[e - len(a) : e] for e, a in zip(ends, asked)]
            out.append([*[pack(both[s]) for s in spots], None])
            out.append([*[pack(fit[s]) if g == HELD else None for s, g in zip(spots, groups)], None])
            if k == 0:
                stats = [int((both > 0).sum()), int(both.sum()), int(fit.sum())]
        out += [[None] * len(names) + [s] for s in stats]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, target)], schema=target)

    tell.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    asked = parts.mapInArrow(ask, ask_schema)
    return freeze(asked.groupBy("range").applyInArrow(tell, tell_schema), "counts")


class Estimates:
    """Per token: maximum-likelihood estimates of every order, its bucket, and its count."""

    def __init__(self, chunk: Chunk, answers: list[np.ndarray], total: int, texts: int):
        order = len(answers)
        seen = [a[p] for a, p in zip(answers, chunk.places)]
        self.count = seen[0]
        self.p = np.empty((order, len(self.count)))
        self.p[0] = seen[0] / total if total else 0.0
        self.bucket = np.zeros(len(self.count), np.int64)
        for k in range(1, order):
            context = np.empty_like(seen[0])
            context[1:] = seen[k - 1][:-1]
            context[chunk.is_start] = texts
            self.p[k] = np.divide(seen[k], context, out=np.zeros(len(context)), where=context > 0)
            known = context > 0
            self.bucket[known] = k * _LEVELS + np.minimum(np.log2(context[known]).astype(np.int64), _LEVELS - 1)


def _answers(table: pa.Table, name: str, order: int) -> list[np.ndarray]:
    ordered = table.sort_by("range")
    return [np.concatenate([unpack(x, np.int64) for x in ordered[f"{name}{k}"].to_pylist()]) for k in range(order)]


# ------------------------------------------------------------------ weights

def _evidence(parts: DataFrame, counts: DataFrame, order: int, totals: dict) -> DataFrame:
    """Held-out tokens as bucket, estimates and number of tokens that have them."""
    schema = T.StructType([T.StructField("bucket", T.LongType())] + [T.StructField(f"p{k}", T.DoubleType()) for k in range(order)] + [T.StructField("n", T.LongType())])

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        if not left.num_rows:
            return target.empty_table()
        c = Chunk(left.to_pylist()[0], order)
        e = Estimates(c, _answers(right, "fit", order), totals["n_fit"], totals["fit_texts"])
        rows = np.column_stack([e.bucket.astype(float), *e.p])
        rows, n = np.unique(rows.view([("", float)] * rows.shape[1]).ravel(), return_counts=True)
        rows = rows.view(float).reshape(len(n), -1)
        return pa.table([pa.array(rows[:, 0].astype(np.int64)), *[pa.array(rows[:, k + 1]) for k in range(order)], pa.array(n)], schema=target)

    kept = parts.where(F.col("group") == HELD)
    asked = counts.where(F.col("group") == HELD).select("chunk", "range", *[f"fit{k}" for k in range(order)])
    per_chunk = kept.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(held, schema)
    names = ["bucket", *[f"p{k}" for k in range(order)]]
    return freeze(per_chunk.groupBy(*names).agg(F.sum("n").alias("n")), "evidence")


def learn_weights(evidence: DataFrame, order: int, uniform: float, steps: int = STEPS) -> np.ndarray:
    """Mixture weights per bucket (rows) of the uniform estimate and every order, by expectation-maximisation.

    The table of evidence stays distributed: each step is one pre-aggregated sum per bucket. Buckets without evidence
    keep equal weights.
    """
    buckets = order * _LEVELS
    weights = np.full((buckets, order + 1), 1.0 / (order + 1))
    estimates = [F.lit(uniform), *[F.col(f"p{k}") for k in range(order)]]
    for _ in range(steps):
        lookup = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), (F.col("bucket") + 1).cast("int")) * estimates[k] for k in range(order + 1)]
        shares = evidence.select("bucket", "n", *[x.alias(f"s{k}") for k, x in enumerate(lookup)])
        whole = sum((F.col(f"s{k}") for k in range(1, order + 1)), F.col("s0"))
        rows = shares.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(f"s{k}") / whole).alias(f"e{k}") for k in range(order + 1)]).collect()
        if not rows:
            break
        for r in rows:
            e = np.array([r[f"e{k}"] for k in range(order + 1)]) + 0.01
            weights[r["bucket"]] = e / e.sum()
    return weights


# ------------------------------------------------------------------ scores

def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", test: Column | None = None, order: int = ORDER, steps: int = STEPS,
    chunk_bytes: int = CHUNK_BYTES, tokens_per_range: int = TOKENS_PER_RANGE,
) -> DataFrame:
    """Every text's ``doc_id``, ``held_out`` (``test``, rows that teach nothing), ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score`` (the model), both log10 probabilities of the whole text."""
    if order < 1:
        raise ValueError("order must be at least 1")
    test = F.lit(False) if test is None else F.coalesce(test, F.lit(False))
    held = F.pmod(F.xxhash64(col(doc_id).cast("string"), F.lit("held")), F.lit(HELD_SHARE)) == 0
    parts = chunks(docs, doc_id, text, F.when(test, TEST).when(held, HELD).otherwise(FIT), chunk_bytes)
    sums = parts.groupBy("group").agg(F.sum("n_tokens").alias("n"), F.sum(F.size("ids")).alias("texts")).collect()
    texts = {r["group"]: int(r["texts"]) for r in sums}
    bits = max(3, (sum(int(r["n"]) for r in sums) // tokens_per_range).bit_length())
    counts = exchange(parts, order, bits)
    row = counts.where("chunk IS NULL").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n_words", "n_all", "n_fit")]).first()
    totals = {**row.asDict(), "fit_texts": texts.get(FIT, 0), "all_texts": texts.get(FIT, 0) + texts.get(HELD, 0)}
    uniform = 1.0 / (totals["n_words"] + 1)
    weights = learn_weights(_evidence(parts, counts, order, totals), order, uniform, steps)
    if not totals["n_all"]:
        weights[:] = np.eye(order + 1)[0]
    id_type = parts.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        if not left.num_rows:
            return target.empty_table()
        row = left.to_pylist()[0]
        c = Chunk(row, order)
        e = Estimates(c, _answers(right, "all", order), totals["n_all"], totals["all_texts"])
        p = weights[e.bucket, 0] * uniform
        for k in range(order):
            p += weights[e.bucket, k + 1] * e.p[k]
        base = np.log10((e.count + 1) / (totals["n_all"] + totals["n_words"] + 1))
        n = len(c.sizes)
        add = lambda x: np.add.reduceat(x, c.starts)
        columns = [row["ids"], [row["group"] == TEST] * n, c.sizes, add((e.count > 0).astype(np.int64)), np.full(n, totals["n_all"]), add(base), add(np.log10(p))]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, target)], schema=target)

    asked = counts.where("chunk IS NOT NULL").select("chunk", "range", *[f"all{k}" for k in range(order)])
    return parts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(score, schema)
