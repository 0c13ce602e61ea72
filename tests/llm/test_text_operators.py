"""Operators that read texts row by row, against the libraries and plain Python."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldweave.llm import byte_bpe, decontaminate, language_mixture, license_join, token_counts
from fieldweave.llm.common import plain_words
from fieldweave.llm.segments import cut

public = pytest.importorskip("public_tokenizers")
RANKS, SPEC = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a", "the  the\n\nthe ", "x" * 30_000, "<|endoftext|> it's 1st day", "Ünder thé\tsea\u0085 \x1c!", "word " * 20_000]


def docs(spark, texts):
    """Texts with an id, a null id at the end, and columns whose names clash with results."""
    rows = [(i if i < len(texts) - 1 or len(texts) < 3 else None, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, text string, n_tokens string, `a.b` int")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def mine():
    return byte_bpe.encoder(RANKS, public.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcTHE  \n\t \u0085\x1c.,'s<|>é漢🙂09"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_cut_joins_back(text):
    assert "".join(cut(text)) == text


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(list("abcTHE  \n\t \x1c.,'s<|>é漢🙂09") + ["'re", " the", "ing", "  ", "<|endoftext|>"]), max_size=30).map("".join))
def test_bpe_equals_library(text, library, mine):
    ids = mine.encode(text)
    assert ids == library.encode_ordinary(text) and mine.decode(ids) == text.encode()


def test_prefix_table_appends_and_edits(mine):
    random.seed(3)
    v = mine.vocabulary
    for _ in range(200):
        piece = bytes(random.choice(b"theinga") for _ in range(random.randint(0, 60)))
        table = byte_bpe.PrefixTable(v, piece[:20])
        table.append(piece[20:])
        assert table.last == byte_bpe.PrefixTable(v, piece).last and table.tokens() == mine._forward(piece)
        a = random.randint(0, len(piece))
        b, new = random.randint(a, len(piece)), bytes(random.choice(b"the") for _ in range(random.randint(0, 4)))
        table.edit(a, b, new)
        assert table.last == byte_bpe.PrefixTable(v, piece[:a] + new + piece[b:]).last
    long = byte_bpe.PrefixTable(v, b"thing" * 4000)
    assert long.edit(9000, 9001, b"x") < 2000


def test_encode_and_decode(spark, library):
    got = byte_bpe.encode_texts(docs(spark, ODD), RANKS, public.PATTERN, keep=["doc_id", "n_tokens", "a.b"], digests=True)
    assert got.columns == ["doc_id", "a.b", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    for text, r in zip(ODD, rows):
        ids = library.encode_ordinary(text or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decode_ids(got, RANKS, keep=["doc_id"]).collect()
    assert [r["text"] for r in back] == [t or "" for t in ODD]
    assert byte_bpe.encode_texts(docs(spark, ODD).limit(0), RANKS, public.PATTERN).count() == 0


def test_edited_ids(spark, mine):
    df = spark.createDataFrame([(1, "thinking", 0, 2, "bl"), (2, None, None, None, None)], "doc_id int, text string, a int, b int, x string")
    rows = byte_bpe.edited_ids(df, RANKS, "text", "a", "b", "x").collect()
    assert rows[0]["ids"] == mine._forward(b"blinking") and rows[1]["ids"] == []


def test_token_counts(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(SPEC)
    rows = token_counts.count_tokens(docs(spark, ODD), SPEC, keep=["doc_id", "n_tokens"]).collect()
    for text, r in zip(ODD, rows):
        n = len(model.encode(text or "", add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((text or "").encode()), n > 1024)
    other = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(other)
    rows = token_counts.count_tokens(docs(spark, ODD[:6]), other).collect()
    assert [r["n_tokens"] for r in rows] == [len(whole.encode(t or "", add_special_tokens=False)) for t in ODD[:6]]
    batches = token_counts.by_bytes(["x" * n for n in range(100)], 500)
    assert sorted(map(len, sum(batches, []))) == list(range(100)) and max(sum(map(len, b)) for b in batches) <= 550


def brute_hits(text, items, window=10):
    words, hit, found = plain_words((text or "").encode()), set(), set()
    for item, body in items:
        if item is None or body is None:
            continue
        w = plain_words(body.encode())
        k = min(window, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [1 << 25, 40])
def test_decontaminate_equals_brute_force(spark, limit):
    random.seed(5)
    word = lambda: random.choice(["the", "cat", "Über", "x1", "sat"])
    items = [(str(i), " ".join(word() for _ in range(random.choice([0, 1, 3, 12, 15])))) for i in range(12)] + [(None, "a b c"), ("n", None), ("0", "cat cat-x1")]
    items = [x for x in items if x[1] is None or len(x[1].split()) != 1]
    texts = [" ".join(word() for _ in range(random.randint(0, 60))) for _ in range(40)] + [items[k][1] for k in range(3)] + [None, "", "the " * 3000]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_hits(docs(spark, texts), bench, keep=["text", "a.b"], max_bytes=limit)
    want = sorted((t or "", *map(str, brute_hits(t, items))) for t in texts)
    assert sorted((r["text"] or "", str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in got.collect()) == want
    clean = decontaminate.decontaminate(docs(spark, texts), bench, max_bytes=limit)
    assert clean.columns == ["doc_id", "text", "n_tokens", "a.b"]
    assert sorted((r["text"] or "") for r in clean.collect()) == sorted((t or "") for t in texts if not brute_hits(t, items)[1])
    spans = decontaminate.decontaminate(docs(spark, ["keep me, " + items[0][1] + " x. and me" if items[0][1] else "keep"]), bench, remove="spans", max_bytes=limit)
    assert "keep me" in spans.first()["text"] and spans.count() == 1
    assert decontaminate.find_hits(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_licenses_equal_brute_force(spark):
    random.seed(6)
    pool = "released under the mit license licensed apache version 2 0 cc by nc 4 word other".split()
    texts = [" ".join(random.choice(pool) for _ in range(random.randint(0, 120))) for _ in range(60)]
    texts += ["Released under the MIT License, under the mit-license", "This work is licensed under the GNU General Public License, version 3.", None, "", "word " * 5000 + "CC BY-NC"]
    rows = license_join.scan_licenses(docs(spark, texts)).collect()
    for text, r in zip(texts, rows):
        words = [w.decode() for w in plain_words((text or "").encode())]
        places = [(i, label) for label, p in license_join.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        want = set()
        for k, (label, body) in enumerate(license_join.TEMPLATES):
            t = license_join.Template(label, list(range(len(body.split()))), 0.9)
            size, need = len(set(body.split())), max(1, -(-9 * len(set(body.split())) // 10))
            for b in range(0, len(words), t.block // 2):
                shared = len(set(words[b : b + t.block]) & set(body.split()))
                if shared >= need:
                    want.add((k, b, shared / size))
        assert {(m["template"], m["first_word"], m["containment"]) for m in r["matches"]} == want
    assert rows[61]["labels"] == "gpl-3" and rows[60]["labels"] == "mit" and rows[64]["labels"] == "cc-by-nc"


def test_language_mixture(spark):
    random.seed(7)
    say = {"en": "the of and water house river tree stone".split(), "de": "der und wasser schloß fluß über bäume".split(), "xx": ["zzqq", "qzzq"]}
    rows = [(i, " ".join(random.choice(say[k]) for _ in range(60)), k) for i, k in enumerate(["en", "de", "xx"] * 8)]
    train = spark.createDataFrame(rows + [(98, None, "en"), (99, "text", None), (97, "...", "de")], "doc_id int, text string, lang string")
    model = language_mixture.train(train)
    assert model[0] == ["de", "en", "xx"]
    mixed = " ".join([rows[0][1]] * 3 + [rows[1][1]] * 2)
    asked = [rows[0][1], rows[1][1].upper(), mixed, None, "", "123 ...", "a", rows[2][1] * 3000]
    got = language_mixture.predict(docs(spark, asked), model).collect()
    assert [r["lang_pred"] for r in got][:6] == ["en", "de", "en", "und", "und", "und"] and got[7]["lang_pred"] == "xx"
    assert {x["lang"] for x in got[2]["languages"]} == {"en", "de"} and 0.45 < got[2]["score"] < 0.75 and all(0 <= r["score"] <= 1 for r in got)
    assert language_mixture.keep_known(docs(spark, asked), model).count() == 5
    nothing = language_mixture.train(train.limit(0))
    assert {r["lang_pred"] for r in language_mixture.predict(docs(spark, asked), nothing).collect()} == {"und"}
    # shares are a fixed point of the expectation step
    counts, p = language_mixture.trigram_counts(mixed.encode()), model[1]
    found = language_mixture.mixture(counts, p, steps=400)
    at = counts.nonzero()[0]
    some = p[at][:, list(found)]
    share = list(found.values())
    again = ((counts[at] / (some @ share)) @ some) * share / counts[at].sum()
    assert max(abs(again - share)) < 1e-2
