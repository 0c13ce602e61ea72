"""The whole pipeline over planted documents, against a brute-force version of its stages."""

import random

import pytest

import corpus_pipeline
from fieldweave.llm import byte_bpe
from .test_near_copies import alike, brute_kept, edited, shingles
from .test_text_operators import brute_hits


def test_pipeline_equals_brute_force(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    bench = [("a", say(14)), ("b", say(10))]
    texts = [None, "", "12 34", say(40)]
    for _ in range(12):
        base = say(rng.randint(100, 200))
        texts += [base, *[edited(base, n, rng) for n in (1, 2, 3, 5)], base.upper()]
    leaked = say(60) + " " + bench[0][1] + " " + say(60)
    texts += [leaked, edited(leaked, 1, rng), say(30) + " " + bench[1][1]]
    sets = [shingles(t) for t in texts]
    assert sum(0.8 <= len(a & b) / len(a | b) <= 0.95 for i, a in enumerate(sets) for b in sets[:i] if a | b and a != b and alike(a, b)) >= 12
    docs = [(i, t, rng.choice(["en", "de"])) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id int, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    lettered = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    kept = [lettered[k] for k in brute_kept([texts[i] for i in lettered])]
    whole = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert got == {i: whole.encode_ordinary(texts[i]) for i in kept if not brute_hits(texts[i], bench)[1]}
