"""The n-gram product, the Merkle manifest and the dual-tree search against brute force, with odd rows in every table."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import dual_tree, merkle_manifest, ngram_product

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part string, `a.b` int, cls long, path string"


def table(spark, texts, ids=None, lang=lambda i: ("en", "de", None, "é")[i % 4 if i % 9 else 0]):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang(n), None if n % 5 == 0 else "web", None if n % 6 == 0 else len(t or ""), 1, "x", 2, 3, "y") for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


# --- n-gram product


def grams(text, k=4):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows):
    sets, parent = [grams(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], len(sets[i]), least[root(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def edited(text, changes, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), min(changes, len(words))):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = say(60)
    texts = [None, "", " \n", "One", "one", "one two", "a b c d", "A  b\tc d", "a b c d e", "1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 9 10"]
    for n in (12, 20, 40, 90, 250, 700):
        for _ in range(4):
            base = say(n)
            texts += [base, base.upper(), *[edited(base, c, rng) for c in (1, 1, 2, 3, 5)], base + " " + say(max(1, n // 8)), " ".join(base.split()[n // 7 :])]
    # a passage that many share, and a chain whose ends are far apart
    texts += [passage + " " + say(rng.randint(5, 60)) for _ in range(40)]
    chain = say(120)
    for _ in range(15):
        texts.append(chain)
        chain = edited(chain, 1, rng)
    return texts


@pytest.mark.parametrize("rows,small", [(256, 32), (4, 2)])
def test_ngram_product_equals_brute_force(spark, monkeypatch, rows, small):
    monkeypatch.setattr(ngram_product, "SMALL", small)
    texts = corpus(random.Random(5))
    texts += texts[20:30] + [" ".join(f"long{i}" for i in range(30_000))] * 2
    ids = [None if i == 13 else i // 2 if i < 8 else 1000 - i for i in range(len(texts))]
    docs, made = table(spark, texts, ids)
    got = ngram_product.linked_documents(docs, rows=rows)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(made)


def test_ngram_product_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(150))
    docs, made = table(spark, [edited(base, rng.choice((1, 2)), rng) for _ in range(300)] + ["x " * 3] * 50)
    got = ngram_product.linked_documents(docs, rows=16)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(made)


def test_ngram_product_empty(spark):
    docs, _ = table(spark, ["a"])
    assert ngram_product.linked_documents(docs.limit(0)).collect() == []
    docs, made = table(spark, [None, "", "a b"])
    assert sorted(map(tuple, ngram_product.linked_documents(docs).collect()), key=repr) == brute_components(made)


def test_linked_rows_share_a_block():
    """Whatever the sizes and the place of the differences, rows at the threshold have a key in common."""
    rng = np.random.default_rng(3)
    for size in [*range(6, 60), 100, 257, 1000, 5000]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, size, np.uint64) << np.uint64(1)
            lost = rng.integers(0, ngram_product.differing(2 * size) + 1)
            b = a[rng.permutation(size)[: size - lost]]
            room = lost
            while room and 100 * len(b) < 85 * (size + room):
                room -= 1
            b = np.concatenate([b, rng.integers(0, 1 << 63, room, np.uint64) << np.uint64(1) | np.uint64(1)])
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 85 * (len(a) + len(b) - shared) or shared == len(a) == len(b):
                continue
            keys = [set(ngram_product.group_keys(np.sort(x)).tolist()) for x in (a, b)]
            assert keys[0] & keys[1], (size, len(b), shared)


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """``rows`` as in ``table``: what the contract says, step by step."""
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(mark, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    hit = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0

    def climb(level, paths):
        """Nodes above ``level``, with each leaf's siblings appended to its path."""
        spots = list(range(len(level)))
        while len(level) > 1:
            for path, at in zip(paths, spots):
                if at ^ 1 < len(level):
                    path.append((at & 1, level[at ^ 1]))
                else:
                    path.append(None)
            level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
            spots = [s // 2 for s in spots]
        return level[0]

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    paths, subroots = {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r), leaf(r, hit(r))))
        paths[g] = [[] for _ in groups[g]]
        subroots.append(climb([leaf(r) for r in groups[g]], paths[g]))
    above = [[] for _ in names]
    root = climb(subroots, above)
    out = []
    for g, sub, up in zip(names, subroots, above):
        for r, path in zip(groups[g], paths[g]):
            folded = leaf(r, hit(r))
            for step in [*path, *up]:
                folded = sha(folded) if step is None else sha(step[1] + folded) if step[0] else sha(folded + step[1])
            out.append((r[0], leaf(r), sub, root, "".join(s[1] for s in [*path, *up] if s), folded))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stride", [1, 3, 12])
def test_manifest_equals_brute_force(spark, stride):
    texts = [None, "", "é\n", "x" * 200_000, *[f"text {i % 40}" for i in range(333)]]
    ids = [None if i in (7, 8) else i // 2 if i < 30 else i for i in range(len(texts))]
    docs, made = table(spark, texts, ids)
    touched = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle_manifest.prove(docs, {"n_chars": touched}, stride=stride)
    rows = sorted(map(tuple, got.select("key", "leaf", "subroot", "root", "proof", "folded").collect()), key=repr)
    assert rows == brute_manifest(made)
    assert 0 < sum(r[5] != r[3] for r in rows) < len(rows)


def test_manifest_copies_of_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "LEAVES_PER_COPY", 7)
    docs, made = table(spark, [f"t{i}" for i in range(150)])
    got = merkle_manifest.prove(docs, {}, stride=2).select("key", "leaf", "subroot", "root", "proof").collect()
    assert sorted(map(tuple, got), key=repr) == [r[:5] for r in brute_manifest(made)]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    docs, made = table(spark, ["a", "b"], lang=lambda i: "en")
    rows = merkle_manifest.prove(docs.where(F.col("doc_id") < n), {}).collect()
    assert [r["key"] for r in sorted(rows)] == list(range(n))
    if n:
        want = brute_manifest(made[:n])
        assert sorted((r["leaf"], r["root"], r["proof"]) for r in rows) == sorted((w[1], w[3], w[4]) for w in want)
    if n == 1:
        assert rows[0]["leaf"] == rows[0]["subroot"] == rows[0]["root"] == rows[0]["folded"] and rows[0]["proof"] == ""


# --- dual-tree search


def terms(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in low).split(" ")


def brute_search(rows, items, k):
    docs = [(r[0], Counter(t for t in terms(r[1]) if t)) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    held = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in docs:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t and c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % 700}" for _ in range(n))


@pytest.mark.parametrize("bundle_bytes,per_tree", [(8 << 20, 64), (700, 5)])
def test_dual_tree_equals_brute_force(spark, monkeypatch, bundle_bytes, per_tree):
    monkeypatch.setattr(dual_tree, "ITEMS_PER_TREE", per_tree)
    rng = random.Random(2)
    texts = [None, "", " .,", "É é w1", *[words(rng, rng.randint(1, 80)) for _ in range(600)], words(rng, 60_000)]
    texts += texts[40:45] * 8
    ids = [None if i in (9, 10) else i // 2 if i < 100 else i for i in range(len(texts))]
    docs, made = table(spark, texts, ids)
    items = [(i, words(rng, rng.randint(1, 30))) for i in range(40)]
    items += [(1, texts[42]), (2, None), (3, ""), (4, "nowhere Else"), (None, texts[50]), (5, "W1 w1 w1! é"), items[6], (7, items[8][1]), (60, texts[41])]
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, score int")
    got = sorted(map(tuple, dual_tree.search(docs, bench, bundle_bytes=bundle_bytes).collect()), key=repr)
    assert got == brute_search(made, [i for i in items if i[1]], 10)


def test_dual_tree_gives_up_whole_batches():
    """Far fewer pairs are scored than there are, and none that counts is missed."""
    rng = np.random.default_rng(4)
    width, topics = 400, 20
    rows = np.zeros((2000, width), np.int64)
    for r, t in enumerate(rng.integers(0, topics, 2000)):
        rows[r, rng.integers(t * 20, t * 20 + 20, 12)] = rng.integers(300_000, 990_000, 12)
    items = [(i, {int(c): int(rng.integers(100, 9000)) for c in rng.integers(i % topics * 20, i % topics * 20 + 20, 10)}) for i in range(100)]
    trees = dual_tree.item_trees(items, 10, {})
    at, columns = np.nonzero(rows)
    scored = dual_tree.offer(trees, dual_tree.Batch(list(range(2000)), (rows > 0).sum(axis=1), columns, rows[at, columns], width))
    assert scored < 0.25 * 2000 * 100
    found = {n: [(-s, d) for s, _, d in best] for t in trees for n, best in zip(t.numbers, t.best)}
    for n, vector in items:
        scores = sum(rows[:, c] * w for c, w in vector.items())
        want = sorted(((-int(s), d) for d, s in enumerate(scores) if s > 0))[:10]
        assert found[n] == [(-s, d) for s, d in want]


def test_dual_tree_empty_tables(spark):
    docs, _ = table(spark, ["a b", None])
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dual_tree.search(docs.limit(0), bench).collect() == []
    assert dual_tree.search(docs, bench.limit(0)).collect() == []
    assert dual_tree.search(docs.where("doc_id = 1"), bench).collect() == []
