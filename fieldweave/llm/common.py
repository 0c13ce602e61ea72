"""Shared helpers: scanning texts in bounded Arrow slices, and picking columns by name."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20

# The contract's separators and letters (ASCII only).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_UPPER_LETTERS, _LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; null has none."""
    return text.translate(_LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and all characters beyond ASCII, A-Z lowered; null has none."""
    return text.translate(_WORDS).split() if text else []


def numbered(texts: Sequence[bytes | None], split: Callable, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as numbers in one array (unknown: -1; -2 after each text), words per text, start per text."""
    get = numbers.get
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        ids = [get(w, -1) for w in split(text)]
        counts[i] = len(ids)
        flat += ids
        flat.append(-2)
    starts = np.cumsum(counts + 1) - counts - 1
    return np.array(flat, np.int64), counts, starts


def lowered(text: Column) -> Column:
    """A-Z lowered in the JVM, as in :func:`spaced_words`."""
    return F.translate(text, _UPPER_LETTERS, _LOWER_LETTERS)


def col(name: str) -> Column:
    """A column by its literal name: extra columns may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose first column holds at most ``limit`` bytes (one text may exceed it)."""
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += int(size)
        if batch.num_rows > start:
            yield batch.slice(start), texts.slice(start).to_pylist()


def scan_texts(
    docs: DataFrame,
    text: str,
    keep: Sequence[str],
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], dict]],
    fields: Sequence[tuple[str, T.DataType]],
    new_text: bool = False,
) -> DataFrame:
    """One result row per row of ``docs``: the columns ``keep``, then ``fields``.

    ``make()`` runs once per task and returns the function that turns a slice of texts into the result columns.
    A kept column that has the name of a result column gives way to it. With ``new_text`` the result column
    named ``text`` replaces the text in its place. No shuffle; a slice holds ``SLICE_BYTES`` of text or one text.
    """
    results = {name for name, _ in fields}
    kept = [c for c in dict.fromkeys(keep) if c not in results or (new_text and c == text)]
    source = docs.select(col(text).cast("string").alias("_text"), *[col(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    by_name = {f.name: f for f in docs.schema.fields}
    added = [f for f in fields if f[0] not in kept]
    schema = T.StructType([T.StructField(f"_k{i}", by_name[c].dataType, True) for i, c in enumerate(kept)] + [T.StructField(f"_r{i}", t, True) for i, (_, t) in enumerate(added)])
    place = kept.index(text) if new_text and text in kept else -1

    def run(batches):
        turn = make()
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch, texts in slices(batches):
            got = turn(texts, batch)
            arrays = list(batch.columns[1:])
            if place >= 0:
                arrays[place] = pa.array(got[text], type=target.field(place).type)
            arrays += [pa.array(got[name], type=target.field(len(kept) + i).type) for i, (name, _) in enumerate(added)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(target.field(i).name, a.type) for i, a in enumerate(arrays)]))

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"_r{i}").alias(n) for i, (n, _) in enumerate(added)])


def release_memory() -> None:
    """Gives the memory that earlier tasks of this Python worker left unused back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers find this package where it is not installed but lies at the same path as here."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def text_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and text bytes of ``df``: one pre-aggregated row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(col(text).cast("string"))), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(id as text) mod ``modulus`` is ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
