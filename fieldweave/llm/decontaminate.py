"""Benchmark decontamination: a broadcast hash set of benchmark windows against every window of the documents.

Windows are ``window`` consecutive words of an item (an item of fewer words is one window). A document word inside
an occurrence of any window is hit. The windows travel as one broadcast while the benchmark holds at most
``max_bytes`` of text; beyond it, it is cut into slices of that size by a hash of the item and each slice scans the
documents, so memory stays bounded and no window is left out.

Null and empty texts have no words: they are never hit, and such items have no window. :func:`find_hits` leaves items
with a null id out unless ``unnamed`` is set; then their windows mark words too, and only the list of items lacks them.
:func:`decontaminate` removes their passages as any other. Repeated items count once. Rows of ``docs`` are never merged: equal rows give equal results.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col, numbered, plain_words, scan_texts, text_bytes

WINDOW = 10
MAX_BYTES = 32 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WindowIndex:
    """Benchmark windows, found by a rolling hash over word numbers and verified word by word."""

    def __init__(self, items: Sequence[tuple[str | None, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in plain_words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if size else ():
                found[tuple(ids[i : i + size])].add(item)
        self.items = dict(found)
        by_size: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for ids in found:
            by_size[len(ids)].append(ids)
        self.hashes = {n: np.unique(_window_hashes(np.array(rows, np.int64).reshape(len(rows), n).ravel(), n)[::n]) for n, rows in by_size.items()}

    def hits(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str | None]]]:
        """Per text its number of words; for all words whether they are hit; per hit text the items."""
        ids, counts, starts = numbered(texts, plain_words, self.words)
        mark = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str | None]] = defaultdict(set)
        # length of the run of benchmark words that begins at each place
        stops = np.flatnonzero(ids < 0)
        room = np.repeat(stops, np.diff(np.concatenate([[-1], stops]))) - np.arange(len(ids)) if len(ids) else ids
        for size, known in self.hashes.items():
            places = np.flatnonzero(room >= size)
            if not len(places):
                continue
            h = np.zeros(len(places), np.uint64)
            for k in range(size):
                h = (h + ids[places + k].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for p in places[known[at] == h]:
                if got := self.items.get(tuple(ids[p : p + size].tolist())):
                    mark[p] += 1
                    mark[p + size] -= 1
                    items[int(np.searchsorted(starts, p, "right")) - 1] |= got
        hit = np.cumsum(mark[:-1]) > 0
        return counts, hit[ids != -2], items


def _window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window that begins at each place (the last ``size - 1`` places are left out)."""
    h = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        h = (h + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    return h


def _word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte span of each word of :func:`plain_words`."""
    spans, at = [], 0
    plain = text.translate(_PLAIN)
    for w in plain.split():
        at = plain.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    return spans


_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit runs, from each run's first word up to the next word that stays."""
    spans, out, at, i = _word_spans(text), [], 0, 0
    while i < len(spans):
        if hit[i]:
            out.append(text[at : spans[i][0]])
            while i < len(spans) and hit[i]:
                i += 1
            at = spans[i][0] if i < len(spans) else len(text)
        else:
            i += 1
    out.append(text[at:])
    return b"".join(out)


_FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("hit_words", T.ArrayType(T.IntegerType()))]


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], text: str, keep: Sequence[str], window: int, clean: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        index = WindowIndex(shared.value, window)

        def turn(texts, _):
            counts, hit, items = index.hits(texts)
            parts = np.split(hit, np.cumsum(counts)[:-1]) if len(counts) else []
            out = {"n_words": counts, "n_hit": [int(p.sum()) for p in parts], "items": [sorted(x for x in items.get(i, ()) if x is not None) for i in range(len(texts))]}
            # boundaries of hit runs as word numbers: start, end, start, end, ...
            out["hit_words"] = [np.flatnonzero(np.diff(np.concatenate([[0], p.view(np.int8), [0]]))).tolist() if i in items else [] for i, p in enumerate(parts)]
            if clean:
                out[text] = [_without(t, p).decode("utf-8", "replace") if i in items else t for i, (t, p) in enumerate(zip(texts, parts))]
            return out

        return turn

    fields = [*_FIELDS, (text, T.StringType())] if clean else _FIELDS
    return scan_texts(docs, text, keep, make, fields, new_text=clean)


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES, clean: bool = False, unnamed: bool = False,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with ``n_words``, ``n_hit``, ``items`` (sorted ids as text) and
    ``hit_words`` (start and end word of each hit run); ``clean`` also cuts the hit runs out of the text. ``unnamed``: items with
    a null id hit words as well."""
    named = benchmark.select(col(item_id).cast("string").alias("item"), col(item_text).cast("string").alias("body")).where("body IS NOT NULL" if unnamed else "item IS NOT NULL AND body IS NOT NULL").distinct()
    _, size = text_bytes(named, "body")
    cuts = max(1, -(-size // max_bytes))
    part = lambda i: [(r["item"], r["body"].encode()) for r in named.where(F.pmod(F.xxhash64("item", "body"), F.lit(cuts)) == i).collect()]
    if cuts == 1:
        return _scan(docs, part(0), text, keep, window, clean)
    return _sliced(docs, map(part, range(cuts)), text, keep, window, clean)


def _sliced(docs, parts, text, keep, window, clean):
    """Several scans whose hits are joined: each slice hits some runs, their union counts. One slice is held at a time;
    its hits are written before the next one is read."""
    from fieldweave.session import freeze

    rows = freeze(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    hits = None
    for items in parts:
        one = freeze(_scan(rows, items, text, ["_row"], window, False).where("n_hit > 0").select("_row", "items", "hit_words"), "hits")
        hits = one if hits is None else hits.unionByName(one)
    # at most one row per slice and document
    merged = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"), F.collect_list("hit_words").alias("_runs"))
    joined = rows.join(merged, "_row", "left")
    carried = [c for c in dict.fromkeys(keep) if c not in {n for n, _ in _FIELDS}]

    def make():
        def turn(texts, batch):
            at = batch.num_columns - 2
            names, runs = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
            out = {"n_words": [], "n_hit": [], "items": [x or [] for x in names], "hit_words": []}
            if clean:
                out[text] = []
            for t, some in zip(texts, runs):
                hit = np.zeros(len(plain_words(t)), bool)
                for run in some or ():
                    for a, b in zip(run[::2], run[1::2]):
                        hit[a:b] = True
                out["n_words"].append(len(hit))
                out["n_hit"].append(int(hit.sum()))
                out["hit_words"].append(np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist())
                if clean:
                    out[text].append(_without(t, hit).decode("utf-8", "replace") if some else t)
            return out

        return turn

    fields = [*_FIELDS, (text, T.StringType())] if clean else _FIELDS
    return scan_texts(joined, text, [*carried, "_items", "_runs"], make, fields, new_text=clean).drop("_items", "_runs")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", max_hit: int = 0, **options) -> DataFrame:
    """``docs`` with its own columns, without benchmark passages.

    ``remove="documents"`` drops every row with more than ``max_hit`` hit words; ``"spans"`` keeps all rows and cuts
    the hit runs out of their texts.
    """
    names = docs.columns
    renamed = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    inner = f"_c{names.index(text)}"
    found = find_hits(renamed, benchmark, inner, renamed.columns, clean=remove == "spans", unnamed=True, **options)
    if remove == "documents":
        found = found.where(F.col("n_hit") <= max_hit)
    elif remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    return found.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def items_digest(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
