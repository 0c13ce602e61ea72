"""Operators over whole tables, against brute force on small fixtures."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldweave.llm import components, learned_partitions, lm_interpolation, merkle_audit, simhash, vector_packing

DOC = "doc_id int, text string, score string, `a.b` int"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "clash", 0) for i, t in enumerate(texts)], DOC)


def test_components_equal_union_find(spark):
    random.seed(1)
    for n, m in ((60, 40), (60, 90), (5, 0)):
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(12)]
        parent = list(range(200))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        linked = {x for e in edges if e[0] != e[1] for x in e}
        assert {(r["node"], r["root"]) for r in got} == {(x, root(x)) for x in linked} and len(got) == len(linked)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


@pytest.mark.parametrize("limit", [20_000, 4])
def test_simhash_equals_brute_force(spark, limit):
    random.seed(2)
    base = [" ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(1, 200))) for _ in range(12)]
    texts = [None, "", " \n", "one", "one two"]
    for b in base:
        texts += [b, b, b.upper(), b + " tail", b.replace(" ", "\n", 3)]
    texts.append("long word " * 20_000)
    prints = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = simhash.near_duplicates(docs(spark, texts), limit=limit).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{p:016x}", root(i)) for i, p in enumerate(prints)}
    kept = simhash.keep_one(docs(spark, texts), shingle=3)
    assert kept.columns == ["doc_id", "text", "score", "a.b"] and {r["doc_id"] for r in kept.collect()} == {root(i) for i in range(len(texts))}
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_index_finds_every_close_pair(spark):
    """Random pairs at each distance, and a dense cluster that overfills its lists."""
    random.seed(4)
    centre = random.getrandbits(64)
    values = {centre}
    while len(values) < 300:
        v = random.choice(list(values))
        for _ in range(random.randint(1, 3)):
            v ^= 1 << random.randrange(64)
        values.add(v)
    values |= {random.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = collections.defaultdict(set)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for i, v in enumerate(signed):
        want[root(i)].add(v)
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.links(distinct, limit=30)
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3 for r in links.collect())
    got = collections.defaultdict(set)
    for r in components.components(links).collect():
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def brute_lm(rows, steps, held):
    """Counts and weights as documented, word by word."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    fit, every = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for doc, text, test in rows:
        line = tokens(text)
        for pair in zip([0, *line], line):
            if not test:
                for c in ([every] if doc in held else [fit, every]):
                    c[0][pair[1]] += 1
                    c[1][pair] += 1

    def parts(counts, pair):
        context = counts[0][None] if pair[0] == 0 else counts[0][pair[0]]
        bucket = 48 + int(math.log2(context)) if context else 0
        return bucket, [1 / (len(every[0]) + 1), counts[0][pair[1]] / max(1, sum(counts[0].values())), counts[1][pair] / context if context else 0.0]

    weights = collections.defaultdict(lambda: [1 / 3] * 3)
    evidence = [parts(fit, p) for doc, text, test in rows if doc in held and not test for p in zip([0, *tokens(text)], tokens(text))]
    for _ in range(steps):
        sums = collections.defaultdict(lambda: [0.01] * 3)
        for bucket, e in evidence:
            w = weights[bucket]
            whole = sum(a * b for a, b in zip(w, e))
            sums[bucket] = [s + a * b / whole for s, a, b in zip(sums[bucket], w, e)]
        for bucket, s in sums.items():
            weights[bucket] = [x / sum(s) for x in s]
    out = {}
    n, v = sum(every[0].values()), len(every[0])
    for doc, text, _ in rows:
        line = tokens(text)
        score = 0.0
        for pair in zip([0, *line], line):
            bucket, e = parts(every, pair)
            score += math.log10(sum(a * b for a, b in zip(weights[bucket], e)))
        out[doc] = (len(line), sum(every[0][t] > 0 for t in line), n, sum(math.log10((every[0][t] + 1) / (n + v + 1)) for t in line), score)
    return out


def test_interpolation_equals_brute_force(spark):
    random.seed(8)
    texts = [" ".join(random.choice("ab c D e\tf gg hh".split(" ")) for _ in range(random.randint(0, 40))) for _ in range(80)] + [None, "", "zz " * 30_000]
    df = docs(spark, texts)
    test = F.col("doc_id") % 5 == 1
    held = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("held")), F.lit(10)) == 0).collect()}
    got = lm_interpolation.score_texts(df, test=test, chunk_bytes=2000, tokens_per_range=500).collect()
    want = brute_lm([(i, t, i % 5 == 1) for i, t in enumerate(texts)], lm_interpolation.STEPS, held)
    assert len(got) == len(texts)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, r["doc_id"] % 5 == 1)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_interpolation_of_odd_tables(spark):
    assert lm_interpolation.score_texts(docs(spark, []), order=3).count() == 0
    none = lm_interpolation.score_texts(docs(spark, ["a b", None]), test=F.lit(True)).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["base_score"] for r in none} == {0.0} and {r["score"] for r in none} == {0.0}
    three = lm_interpolation.score_texts(docs(spark, ["a b c d"] * 40), order=3).collect()
    assert len(three) == 40 and all(r["score"] > r["base_score"] for r in three)


def vectors(spark, rows, number="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{number}>, score string")


def test_search_small_tables(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [1.0, 1.0], "x"), (3, [1.0, 1.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x")]
    rows += [(6, [float("nan"), 1.0], "x"), (7, [None, 1.0], "x"), (8, [1.0], "x"), (9, [float("inf"), 0.0], "x"), (10, [], "x"), (None, [1.0, 0.0], "x")]
    got = learned_partitions.search(vectors(spark, rows), F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]
    assert got[1]["score"] == pytest.approx(2**-0.5)
    assert learned_partitions.search(vectors(spark, rows[:0]), F.col("vec_id") % 5 == 0).count() == 0
    same = [(i, [0.5, 0.25], "x") for i in range(3000)]
    got = learned_partitions.search(vectors(spark, same), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def test_search_tiny_and_huge_components(spark):
    """Squares of these leave the range of doubles; results are those of the same vectors at ordinary size."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    scale = [2.0**-700, 2.0**700, 1.0, 2.0**-1000]
    plain = vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)], "double")
    wild = vectors(spark, [(i, (v * scale[i % 4]).tolist(), "x") for i, v in enumerate(x)], "double")
    ask = lambda df: learned_partitions.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    got, want = ask(wild), ask(plain)
    assert len(got) == 30
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(r["query_id"], r["rank"], r["vec_id"]) for r in want]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], abs=1e-12)


def test_search_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 6000)] + 0.6 * rng.normal(size=(6000, 16))).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    got = collections.defaultdict(set)
    for r in learned_partitions.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(120), np.arange(0, 6000, 50)] = -9
    best = np.argsort(-near, axis=1)[:, :5]
    assert np.mean([len(got[50 * i] & set(b.tolist())) / 5 for i, b in enumerate(best)]) >= 0.9
    parts = learned_partitions.balanced_parts(learned_partitions.neighbour_graph(unit[:800], 10), 8)
    assert max(np.bincount(parts)) <= 100


def test_merkle_audit(spark):
    random.seed(9)
    left = [(a, o * 5000, 5000, f"h{a}-{o}") for a in range(40) for o in range(60)]
    right = {r[:2]: r for r in left}
    right[(3, 0)] = (3, 0, 5000, "bad")
    right[(17, 5000)] = (17, 5000, 4000, "short")
    del right[(39, 59 * 5000)]
    right[(5, 77)] = (5, 77, 10, "new")
    schema = "archive long, offset long, length long, digest string"
    frame = lambda rows: spark.createDataFrame(list(rows) + [(None, 1, 1, "x"), (1, 1, 1, None)], schema)
    got = merkle_audit.audit(frame(left), frame(right.values())).collect()
    want = {(3, 0, 5000, "content"), (17, 5000, 5000, "length"), (39, 59 * 5000, 5000, "missing"), (5, 77, 10, "extra")}
    assert {tuple(r) for r in got} == want
    assert merkle_audit.audit(frame(left), frame(left)).count() == 0
    assert merkle_audit.audit(frame([]), frame([])).count() == 0
    assert {r["kind"] for r in merkle_audit.audit(frame(left[:3]), frame([])).collect()} == {"missing"}
    pages = spark.createDataFrame([(1, "u", "<p>"), (1, "u", "<p>"), (None, None, None), (2, "", "x" * 200_000)], "page_id long, url string, html string")
    records, a, b = merkle_audit.page_manifests(pages, F.when(F.col("page_id") == 2, F.lit("gone")).otherwise(F.col("record")))
    assert records.count() == 4 and [r["kind"] for r in merkle_audit.audit(a, b).collect()] == ["length"]


def test_packing(spark):
    random.seed(10)
    texts = ["same text"] * 700 + [None, ""] * 50 + [" ".join("w" * random.randint(1, 9) for _ in range(random.randint(1, 60))) for _ in range(1200)]
    got = vector_packing.assign_shards(docs(spark, texts), shards=8, chunk_groups=200, fan_in=3).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["doc_id"], r["size"]) for r in got) == [(i, size(t)) for i, t in enumerate(texts)]
    load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.05 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for t, h in homes.items() if t and t != "same text")
    assert vector_packing.assign_shards(docs(spark, [])).count() == 0


def test_packing_few_huge_texts(spark):
    """Two, three and nine equal texts that outweigh all others: no shard gets two while another has none."""
    for copies in (2, 3, 9):
        texts = ["x" * 300_000] * copies + [f"text {i}" for i in range(200)]
        for chunk_groups in (4096, 40):
            got = vector_packing.assign_shards(docs(spark, texts), shards=8, chunk_groups=chunk_groups, fan_in=3).collect()
            assert len(got) == len(texts)
            held = collections.Counter(r["shard"] for r in got if r["doc_id"] < copies)
            assert max(held.values()) == -(-copies // 8)


def test_packing_one_chunk_is_plain_packing(spark):
    """With one chunk the shards are those of packing all groups at once; with many, totals and rows are the same."""
    random.seed(11)
    texts = [f"{i} " + " ".join("w" * random.randint(1, 9) for _ in range(random.randint(1, 60))) for i in range(300)]
    sizes = np.array([[len(t) + 16, len(t.split()), 1.0] for t in texts])
    digest = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    order = sorted(range(300), key=lambda i: digest[i])
    want = dict(zip(order, vector_packing.pack(sizes[order], 4)))
    got = vector_packing.assign_shards(docs(spark, texts), shards=4).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want
    many = vector_packing.assign_shards(docs(spark, texts), shards=4, chunk_groups=64, fan_in=2).collect()
    assert sum(r["size"] for r in many) == int(sizes[:, 0].sum()) and sorted(r["doc_id"] for r in many) == list(range(300))


def test_written_shards(spark, tmp_path):
    df = docs(spark, [f"text {i}" for i in range(30)])
    vector_packing.write_shards(df, vector_packing.assign_shards(df, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 30 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}
