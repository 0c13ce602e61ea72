"""License scans by an exact set-similarity join of text blocks with notice templates.

A block is a run of consecutive words: for a template of ``m`` words, blocks of ``L`` words (the power of two at or
above ``2 m``) begin every ``L / 2`` words, so a notice that stands anywhere in a text lies whole in a block. A block
matches a template if it holds at least ``threshold`` of the template's distinct words.

The words of the templates are ordered by their frequency in all documents, rarest first. A matching block must hold
one of a template's first ``size - need + 1`` words (prefix filter), have ``need`` template words at all (length
filter), and leave enough words behind each shared one to reach ``need`` (positional filter); what remains is counted
exactly. Frequencies are taken over the whole table; the templates are the only broadcast and do not grow with it.

Besides, fixed phrases are found at every place. Null and empty texts have no words, places or labels. Rows are
independent; repeats give equal results; extra columns pass only where named in ``keep``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col, numbered, plain_words, scan_texts

THRESHOLD = 0.9

# Wording of public license notices.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def word_frequencies(docs: DataFrame, words: Sequence[str], text: str = "text") -> dict[str, int]:
    """How often each of the given words stands in the whole table: partial counts per slice, one row per word."""
    numbers = {w.encode(): i for i, w in enumerate(words)}

    def make():
        def turn(texts, _):
            ids, _, _ = numbered(texts, plain_words, numbers)
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            # the slice's counts go with its first row
            return {"counts": [counts.tolist()] + [[]] * (len(texts) - 1)}

        return turn

    got = scan_texts(docs, text, [], make, [("counts", T.ArrayType(T.LongType()))])
    rows = got.select(F.posexplode("counts").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in words} | {words[r["word"]]: r["n"] for r in rows}


class Template:
    def __init__(self, label: str, ids: list[int], threshold: float):
        self.label = label
        self.ids = sorted(set(ids))  # numbers are ranks: rarest first
        self.need = max(1, math.ceil(threshold * len(self.ids) - 1e-9))
        self.prefix = self.ids[: len(self.ids) - self.need + 1]
        self.place = {w: i for i, w in enumerate(self.ids)}
        self.block = 1 << math.ceil(math.log2(2 * max(1, len(ids))))

    def shared(self, block: list[int]) -> int:
        """Distinct shared words of a block (sorted distinct ranks), or 0 as soon as ``need`` is out of reach."""
        if len(block) < self.need:
            return 0
        got = 0
        for j, w in enumerate(block):
            i = self.place.get(w)
            if i is None:
                continue
            got += 1
            if got + min(len(self.ids) - i, len(block) - j) - 1 < self.need:
                return 0
        return got if got >= self.need else 0


class Scanner:
    def __init__(self, templates, phrases, frequencies: dict[str, int], threshold: float):
        order = sorted(frequencies, key=lambda w: (frequencies[w], w))
        rank = {w: i for i, w in enumerate(order)}
        self.numbers = {w.encode(): i for w, i in rank.items()}
        for _, phrase in phrases:
            for w in phrase.split():
                self.numbers.setdefault(w.encode(), len(self.numbers))
        self.templates = [Template(label, [rank[w] for w in body.split()], threshold) for label, body in templates]
        self.phrases = [(label, [self.numbers[w.encode()] for w in body.split()]) for label, body in phrases]
        self.by_prefix: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for w in t.prefix:
                self.by_prefix[w].append(k)
        self.is_prefix = np.zeros(len(self.numbers) + 2, bool)
        self.is_prefix[list(self.by_prefix)] = True

    def scan(self, texts):
        ids, counts, starts = numbered(texts, plain_words, self.numbers)
        n = len(texts)
        places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for label, phrase in self.phrases:
            m = len(phrase)
            if len(ids) < m:
                continue
            at = np.flatnonzero(ids[: len(ids) - m + 1] == phrase[0])
            for k in range(1, m):
                at = at[ids[at + k] == phrase[k]]
            for p, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                places[d].append((p - int(starts[d]), label))
        found: list[dict[tuple[int, int], float]] = [{} for _ in range(n)]
        at = np.flatnonzero(self.is_prefix[ids])  # -1 and -2 meet the two spare places
        checked = set()
        for p, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
            start = int(starts[d])
            for k in self.by_prefix[int(ids[p])]:
                t = self.templates[k]
                half = t.block // 2
                for b in ((p - start) // half, (p - start) // half - 1):
                    if b < 0 or (d, k, b) in checked:
                        continue
                    checked.add((d, k, b))
                    words = np.unique(ids[start + b * half : min(start + b * half + t.block, start + int(counts[d]))])
                    got = t.shared(words[(words >= 0)].tolist())
                    if got:
                        found[d][(k, b)] = got / len(t.ids)
        return counts, places, found


_MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("containment", T.DoubleType())])


def scan_licenses(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), templates=None, phrases=None, threshold: float = THRESHOLD,
) -> DataFrame:
    """``keep`` and, of every whole text: ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the
    phrases; ``matches``, every template and block that reach the threshold (``first_word``: the block's first word);
    ``labels`` of both; ``score``, 1 where a phrase stands, else the largest containment, else 0."""
    templates = TEMPLATES if templates is None else list(templates)
    phrases = PHRASES if phrases is None else list(phrases)
    words = sorted({w for _, body in templates for w in body.split()})
    frequencies = word_frequencies(docs.select(col(text).alias("text")), words)

    def make():
        s = Scanner(templates, phrases, frequencies, threshold)

        def turn(texts, _):
            counts, places, found = s.scan(texts)
            out = {"n_words": counts, "n_base": [len(p) for p in places]}
            out["first_word"] = [min(p)[0] if p else None for p in places]
            out["last_word"] = [max(p)[0] if p else None for p in places]
            out["base_labels"] = [",".join(sorted({x for _, x in p})) for p in places]
            out["labels"] = [",".join(sorted({x for _, x in p} | {s.templates[k].label for k, _ in f})) for p, f in zip(places, found)]
            out["score"] = [1.0 if p else max(f.values(), default=0.0) for p, f in zip(places, found)]
            out["matches"] = [
                [{"label": s.templates[k].label, "template": k, "first_word": b * (s.templates[k].block // 2), "containment": c} for (k, b), c in sorted(f.items())] for f in found
            ]
            return out

        return turn

    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("matches", T.ArrayType(_MATCH))]
    return scan_texts(docs, text, keep, make, fields)
