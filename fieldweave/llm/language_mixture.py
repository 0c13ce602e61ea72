"""Language identification by mixture inference.

Each language has a distribution over hashed letter trigrams, counted over all labelled training texts. A text is a
mixture: expectation-maximisation finds the proportions that make its trigrams most likely, languages are then taken
in order of their share while each one raises the likelihood by more than the penalty, and the largest share of the
chosen set is the prediction.

Texts that are null or have no letter are ``und`` with score 0, and so is every text if there is no training text.
Training rows with a null language, or without a letter, teach nothing. Ties go to the language that sorts first.
Rows are independent; extra columns pass only where named in ``keep``.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.common import col, scan_texts, slices

BITS = 15
BINS = 1 << BITS
SMOOTHING = 0.5
STEPS = 8
PENALTY = 3.0
#: The model is languages x BINS numbers; more distinct labels than this are no languages.
MAX_LANGUAGES = 1000
_STRETCH = 1 << 20
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _letters[0]


def trigram_counts(text: bytes | None) -> np.ndarray | None:
    """Counts per bin of the trigrams of lower-case letters, anything else being one space; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    counts, carry = np.zeros(BINS, np.int64), np.zeros(1, np.uint32)
    table, any_letter = _letter_table(), False
    for at in range(0, len(points), _STRETCH):
        part = points[at : at + _STRETCH]
        letter = table[part]
        any_letter = any_letter or bool(letter.any())
        line = np.concatenate([carry, np.where(letter, part, np.uint32(0))])
        if at + _STRETCH >= len(points):
            line = np.append(line, np.uint32(0))
        line = line[np.concatenate([[True], (line[1:] != 0) | (line[:-1] != 0)])]
        if len(line) > 2:
            h = (line[:-2] * np.uint32(0x9E3779B1)) ^ (line[1:-1] * np.uint32(0x85EBCA77)) ^ (line[2:] * np.uint32(0xC2B2AE3D))
            h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
            counts += np.bincount(h, minlength=BINS)
        carry = line[-2:]
    return counts if any_letter else None


def train(docs: DataFrame, lang: str = "lang", text: str = "text", where: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their smoothed trigram distributions, one column each.

    Every task sums its texts per language and hands on at most languages x BINS counts, added up by Spark.
    """
    rows = docs.where(where) if where is not None else docs
    rows = rows.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches):
            for t, language in zip(texts, batch.column(1).to_pylist()):
                counts = trigram_counts(t)
                if counts is not None:
                    if language in sums:
                        sums[language] += counts
                    else:
                        sums[language] = counts
        for language, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bin", "n"])

    sums = rows.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = sums.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).limit(MAX_LANGUAGES + 1).collect()
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages")
    names = sorted(r["lang"] for r in table)
    model = np.full((BINS, len(names)), SMOOTHING)
    for r in table:
        model[[b["bin"] for b in r["bins"]], names.index(r["lang"])] += [b["n"] for b in r["bins"]]
    return names, model / model.sum(axis=0) if names else model


def _improve(shares: np.ndarray, p: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    """Expectation-maximisation of the mixture proportions."""
    total = weight.sum()
    for _ in range(steps):
        shares = shares * ((weight / (p @ shares)) @ p) / total
    return shares


def mixture(counts: np.ndarray, model: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> dict[int, float]:
    """Chosen languages of one text with their shares (largest first)."""
    at = np.flatnonzero(counts)
    p, weight = model[at], counts[at].astype(float)
    total, k = weight.sum(), model.shape[1]
    shares = _improve(np.full(k, 1.0 / k), p, weight, steps)
    order = np.argsort(-shares, kind="stable")
    singles = weight @ np.log(p)
    best = {int(singles.argmax()): 1.0}
    top = float(singles.max())
    for size in range(2, k + 1):
        chosen = order[:size]
        if shares[chosen[-1]] * total < 1:
            break
        some = _improve(shares[chosen] / shares[chosen].sum(), p[:, chosen], weight, steps)
        value = float(weight @ np.log(p[:, chosen] @ some)) - penalty * (size - 1) * np.log(total + 1)
        if value <= top:
            break
        top = value
        best = {int(c): float(s) for c, s in sorted(zip(chosen, some), key=lambda x: (-x[1], x[0]))}
    return best


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (the predicted language's share of the text) and ``languages``, the chosen set
    with shares. The model, at most MAX_LANGUAGES x BINS numbers, is broadcast."""
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))

    def make():
        p = shared.value

        def turn(texts, _):
            out = {"lang_pred": [], "score": [], "languages": []}
            for t in texts:
                counts = trigram_counts(t) if names else None
                found = mixture(counts, p) if counts is not None else {}
                out["languages"].append([{"lang": names[k], "share": s} for k, s in found.items()])
                first = next(iter(found), None)
                out["lang_pred"].append("und" if first is None else names[first])
                out["score"].append(0.0 if first is None else min(1.0, found[first]))
            return out

        return turn

    return scan_texts(docs, text, keep, make, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("languages", kind)])


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with its own columns, without the rows whose text is null or holds no letter: those that ``predict`` calls
    ``und``, or where the model has no language to tell them by, those without a letter."""
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    body = f"_c{names.index(text)}"

    def lettered():
        return lambda texts, _: {"_lettered": [trigram_counts(t) is not None for t in texts]}

    if model[0]:
        found = predict(plain, model, body, plain.columns).where(F.col("lang_pred") != "und")
    else:
        found = scan_texts(plain, body, plain.columns, lettered, [("_lettered", T.BooleanType())]).where("_lettered")
    return found.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
