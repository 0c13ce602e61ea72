"""Benchmark items without an id: their passages leave the documents, in one scan and in slices."""

import pytest

from fieldweave.llm import decontaminate


@pytest.mark.parametrize("limit", [1 << 25, 40])
def test_passages_of_items_without_id_are_removed(spark, limit):
    passage = " ".join(f"p{i}" for i in range(12))
    named = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(None, passage), ("7", named), ("8", passage + " more"), (None, None)], "item_id string, text string").where("item_id IS NULL OR item_id = '7'")
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, f"{named} x {passage}"), (3, "clean text"), (4, None)], "doc_id int, text string")
    kept = decontaminate.decontaminate(docs, bench, max_bytes=limit)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4}
    cut = decontaminate.decontaminate(docs, bench, remove="spans", max_bytes=limit)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "before after", 2: "x ", 3: "clean text", 4: None}
    hits = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_hits(docs, bench, max_bytes=limit, unnamed=True).collect()}
    assert hits == {1: (12, []), 2: (24, ["7"]), 3: (0, []), 4: (0, [])}
    # find_hits leaves them out unless asked
    assert {r["doc_id"] for r in decontaminate.find_hits(docs, bench, max_bytes=limit).where("n_hit > 0").collect()} == {2}
