"""The n-gram product makes and sends whole rows only where an outline leaves a partner."""

import random

import numpy as np
import pytest

from fieldweave.llm import ngram_product


@pytest.mark.parametrize("rows", [256, 16])
def test_whole_rows_only_where_outlines_leave_a_partner(spark, monkeypatch, rows):
    rng = random.Random(21)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = say(60)
    # a passage in texts that are otherwise different, and one pair of near copies
    texts = [f"{passage} {say(60 + i % 20)}" for i in range(90)]
    near = say(120)
    texts += [near, near + " more"]
    stored = {}
    whole = ngram_product.freeze

    def freeze(df, name="stage"):
        out = whole(df, name)
        stored.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_product, "freeze", freeze)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_product.linked_documents(docs, rows=rows).collect()}
    assert got == {i: 90 if i == 91 else i for i in range(92)}
    assert stored["live"] == [92] and sum(stored["sets"]) < 20


def test_outlines_keep_every_linked_pair():
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)
    for size in (6, 13, 40, 41, 100, 700):
        base = draw(size)
        made = [np.unique(np.concatenate([base[k:], draw(n)])) for k in range(size // 8 + 1) for n in (0, 1, size // 10)] + [np.unique(draw(size)) for _ in range(9)]
        lines = ngram_product.Outlines([len(s) for s in made], [ngram_product.outline(ngram_product.slot_sums(s)) for s in made])
        left_out = 0
        for x in range(len(made)):
            found = set(lines.partners(x, np.arange(len(made))).tolist())
            for y in range(len(made)):
                shared = len(np.intersect1d(made[x], made[y]))
                linked = 100 * shared >= 85 * (len(made[x]) + len(made[y]) - shared)
                assert not linked or y in found, (size, x, y)
                left_out += y not in found
        assert left_out
