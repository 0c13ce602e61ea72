"""Token counts of whole texts with a tokenizer file, lengths only.

Texts are cut at safe boundaries (see ``segments``), so a text of any length becomes many short segments; each
distinct segment of a slice is encoded once, in batches of about equal bytes, and only lengths are kept. A table of
lengths, bounded by ``CACHE`` entries, is shared by the tasks of a worker. Tokenizers that are not plain byte-level
(no prefix space, no normalizer) are given whole texts.

Null and empty texts have 0 tokens. Special strings inside texts count as the library's default gives them. Rows are
independent: repeats give equal counts; extra columns pass only where named in ``keep``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldweave.llm.common import scan_texts
from fieldweave.llm.segments import cut, peel

CACHE = 500_000
CACHED_CHARS = 48
BATCH_BYTES = 256 << 10


def by_bytes(texts: Sequence[str], limit: int = BATCH_BYTES) -> list[list[str]]:
    """Batches of about ``limit`` bytes each, evened out: longest texts first, each into the lightest batch."""
    import heapq

    sizes = sorted(((len(t.encode()), i) for i, t in enumerate(texts)), reverse=True)
    n = max(1, -(-sum(s for s, _ in sizes) // limit))
    batches: list[list[str]] = [[] for _ in range(n)]
    heap = [(0, k) for k in range(n)]
    for size, i in sizes:
        filled, k = heap[0]
        batches[k].append(texts[i])
        heapq.heapreplace(heap, (filled + size, k))
    return [b for b in batches if b]


def _json_cuts(path: str) -> bool:
    """Whether texts for this tokenizer file may be cut: byte-level pieces without prefix space, special tokens that
    take no white space with them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = spec.get("added_tokens") or []
    return bool(plain and spec.get("normalizer") is None and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(map(str.isspace, t["content"])) for t in added))


class Counter:
    def __init__(self, path: str):
        self.seen: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.cuts = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.model = model
            self.lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.cuts = _json_cuts(path)

    def _joined(self, words: list[str]) -> list[int]:
        """Lengths of single words with a space before, encoded as one text: each word is one pretoken of it."""
        at = self.model.encode("".join(words), add_special_tokens=False).word_ids
        lengths = np.bincount(np.array(at, np.int64), minlength=len(words)).tolist()
        return lengths if len(lengths) == len(words) and all(lengths) else self.lengths(words)

    def count(self, texts: Sequence[str]) -> list[int]:
        if not self.cuts:
            out = [0] * len(texts)
            for i, t in enumerate(texts):  # whole texts: one by one, so that a batch is never larger than its longest
                out[i] = self.lengths([t])[0] if t else 0
            return out
        lists = [cut(t) for t in texts]
        seen = self.seen
        if len(seen) >= CACHE:
            seen.clear()
        peeled = {s: peel(s) for s in set().union(*lists) if s not in seen} if lists else {}
        parts = {p: seen.get(p, -1) for pair in peeled.values() for p in pair if p}
        new = [p for p, n in parts.items() if n < 0]
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        for batch in by_bytes(words):
            parts.update(zip(batch, self._joined(batch)))
        for batch in by_bytes([p for p in new if p[0] != " " or not p[1:].isalpha()]):
            parts.update(zip(batch, self.lengths(batch)))
        here = {s: sum(parts[p] for p in pair if p) for s, pair in peeled.items()} | parts
        for s, n in here.items():
            if len(s) <= CACHED_CHARS:
                seen[s] = n
        long = {s: n for s, n in here.items() if len(s) > CACHED_CHARS}
        if long:
            return [sum(long[s] if s in long else seen[s] for s in segments) for segments in lists]
        return [sum(map(seen.__getitem__, segments)) for segments in lists]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every whole text."""

    def make():
        c = counter(path)

        def turn(texts, _):
            n = c.count([t.decode() if t else "" for t in texts])
            return {"n_bytes": [len(t or b"") for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return turn

    return scan_texts(docs, text, keep, make, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())])
