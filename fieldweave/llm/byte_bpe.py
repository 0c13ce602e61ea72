"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has one valid last token: the token that ends there and follows the valid last token of
the prefix before it without a merge across their border. A table of these tokens gives the encoding of every prefix
by walking back, grows byte by byte without redoing anything, and after an edit only needs work until it meets the
old table again.

Null and empty texts have no tokens. Repeated pieces are encoded once per task and looked up afterwards; the lookup
table holds two generations of at most ``pieces`` (default ``CACHE``) pieces of at most ``CACHED_CHARS`` characters, which bounds memory, and
longer ones are encoded each time they occur. Extra columns of the documents pass only where named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldweave.llm.common import release_memory, scan_texts
from fieldweave.llm.segments import cut, peel

CACHE = 360_000
CHECKED_PAIRS = 600_000
CACHED_CHARS = 48
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with what the border test needs: how each token was merged, and for how long a part of it lives.

    A token ``a`` at the right edge of a finished token lives from its own rank until its parent's rank (forever for
    the token itself); likewise at a left edge. Two tokens may stand side by side unless some part of the right edge
    of the first and of the left edge of the second, alive at the same time, would have merged before either of them
    was used up.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._right: dict[int, list[tuple[bytes, int, int]]] = {}
        self._left: dict[int, list[tuple[bytes, int, int]]] = {}
        self.checked: dict[int, dict[int, bool]] = defaultdict(dict)
        self._n_checked = 0
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        # every start of a token: its rank, or -1 where it is none or no merge makes it
        self.starts = {b[:i]: -1 for b in ranks for i in range(1, len(b))}
        self.starts |= {b: r if self.made(b) else -1 for b, r in ranks.items()}
        # the same as a tree: a node and a byte lead to the next node; the token that ends at each node, or -1
        self.steps: dict[int, int] = {}
        self.ends = [-1]
        for b, r in self.starts.items():
            node = 0
            for byte in b:
                node = self.steps.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = r

    def merge(self, piece: bytes, below: int = _NEVER) -> list[bytes]:
        """Plain rank-ordered merging, for single tokens only: always the lowest rank under ``below``, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a byte or a token no merge makes."""
        if token not in self._parts:
            got = self.merge(token, self.ranks[token]) if len(token) > 1 else []
            self._parts[token] = (got[0], got[1]) if len(got) == 2 else None
        return self._parts[token]

    def made(self, token: bytes) -> bool:
        return len(token) == 1 or self.parts(token) is not None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """Tokens along one edge with the ranks between which each lives."""
        out, until = [], _NEVER
        while True:
            born = self.ranks[token] if len(token) > 1 else -1
            out.append((token, born, until))
            halves = self.parts(token)
            if halves is None:
                return out
            token, until = halves[side], born

    def fits(self, first: int, second: int) -> bool:
        """Whether the two tokens can be neighbours in an encoding."""
        known = self.checked[first].get(second)
        if known is None:
            if self._n_checked >= CHECKED_PAIRS:
                self.checked.clear()
                self._n_checked = 0
            known = self.checked[first][second] = self._fits_now(first, second)
            self._n_checked += 1
        return known

    def _fits_now(self, first: int, second: int) -> bool:
        right, left = self._right.get(first), self._left.get(second)
        if right is None:
            right = self._right[first] = self._edge(self.bytes[first], 1)
        if left is None:
            left = self._left[second] = self._edge(self.bytes[second], 0)
        get = self.ranks.get
        for a, a_born, a_until in right:
            for b, b_born, b_until in left:
                if a_born < b_until and b_born < a_until:
                    rank = get(a + b)
                    # at equal ranks the merge further left comes first
                    if rank is not None and rank < a_until and rank <= b_until:
                        return False
        return True


class PrefixTable:
    """The unique valid last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extends the table; entries there are stay as they are."""
        self.piece += more
        for end in range(len(self.last) + 1, len(self.piece) + 1):
            self.last.append(self._last_at(end))

    def _last_at(self, end: int) -> int:
        v, piece, last = self.vocabulary, self.piece, self.last
        starts, fits = v.starts, v.fits
        for start in range(max(0, end - v.longest), end):
            rank = starts.get(piece[start:end], -1)
            if rank >= 0 and (start == 0 or fits(last[start - 1], rank)):
                return rank
        raise ValueError(f"byte {piece[end - 1]} has no token")

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces ``piece[start:stop]``; returns how many entries were computed anew.

        Entries before the edit stay. After it an entry depends only on the bytes and entries of one longest token
        before it, so once that many entries in a row are as before, the rest is too.
        """
        old, tail = self.last, self.piece[stop:]
        shift = start + len(new) - stop
        self.piece, self.last = self.piece[:start] + new + tail, old[:start]
        same = done = 0
        for end in range(start + 1, len(self.piece) + 1):
            token = self._last_at(end)
            self.last.append(token)
            done += 1
            same = same + 1 if end > start + len(new) and token == old[end - 1 - shift] else 0
            if same >= self.vocabulary.longest and end - start - len(new) >= self.vocabulary.longest:
                self.last += old[end - shift :]
                break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes (default: all)."""
        end, out = len(self.piece) if end is None else end, []
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes[token])
        return out[::-1]


class Encoder:
    """Texts to ids and back, with a bounded table of pieces seen before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = CACHE):
        import regex

        self.room = pieces
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern)
        self.peels = pattern == _CUT_PATTERN
        self.cut = cut if self.peels else lambda text: [text]
        self.seen: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern: a token as it is, else by the prefix table."""
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._forward(piece)

    def _forward(self, piece: bytes) -> list[int]:
        """The prefix table filled as far as needed: from a reached prefix the longest token that may follow its last token
        goes first; a prefix from which none leads on is not reached again."""
        v = self.vocabulary
        step, ends, fits, checked, n = v.steps.get, v.ends, v.fits, v.checked, len(piece)
        out: list[int] = []
        ways: list[tuple[int, list[tuple[int, int]]]] = []
        closed: set[int] = set()
        at = 0
        while at < n:
            node, end, way = 0, at, []
            while end < n:
                node = step(node << 8 | piece[end])
                if node is None:
                    break
                end += 1
                if ends[node] >= 0:
                    way.append((end, ends[node]))
            while True:
                known = checked[out[-1]] if out else None
                while way:
                    end, rank = way.pop()
                    if end not in closed:
                        good = known is None or known.get(rank)
                        if good is None:
                            good = fits(out[-1], rank)
                        if good:
                            break
                else:
                    # no token leads on from here
                    closed.add(at)
                    if not ways:
                        raise ValueError(f"byte {piece[at]} has no token")
                    at, way = ways.pop()
                    out.pop()
                    continue
                break
            ways.append((at, way))
            out.append(rank)
            at = end
        return out

    def _encode(self, segment: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.encode_piece(p.encode()) for p in self.pieces.findall(segment)))

    def _keep(self, segment: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(segment) <= CACHED_CHARS:
            if len(self.seen) >= self.room:
                self.before, self.seen = self.seen, {}
            self.seen[segment] = ids
        return ids

    def _look(self, segment: str) -> tuple[int, ...]:
        """The ids of a segment that the newer table does not hold."""
        ids = self.before.get(segment)
        return self._keep(segment, self._encode(segment) if ids is None else ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        peels = self.peels
        for segment in self.cut(text):
            ids = self.seen.get(segment)
            if ids is None:
                base, tail = peel(segment) if peels else (segment, "")
                ids = (self.seen.get(base) or self._look(base)) if tail else self._look(base)
                if tail:
                    # a word and the marks after it are kept apart, so that the table holds each word once
                    ids += self.seen.get(tail) or self._look(tail)
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


#: Fixed value: the split pattern for which :func:`segments.cut` is proven; any other is matched on whole texts.
_CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_encoders: dict[tuple[str, str, int], Encoder] = {}


def encoder(path: str, pattern: str, pieces: int = CACHE) -> Encoder:
    """One encoder per Python worker, shared by its tasks."""
    key = (path, pattern, pieces)
    if key not in _encoders:
        release_memory()
        _encoders[key] = Encoder(read_ranks(path), pattern, pieces)
    return _encoders[key]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: bool = True, digests: bool = False, pieces: int = CACHE) -> DataFrame:
    """``keep`` and, of every whole text, ``n_tokens``, the token ``ids``, and with ``digests`` the SHA-256 of the decimal
    ids joined by spaces and of the bytes decoded from the ids. ``pieces`` bounds the table of pieces seen before: memory against time."""
    fields = [("n_tokens", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] * ids + [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] * digests

    def make():
        e = encoder(path, pattern, pieces)
        names = {r: str(r) for r in e.vocabulary.bytes} if digests else {}

        def turn(texts, _):
            out: dict[str, list] = {name: [] for name, _ in fields}
            for t in texts:
                tokens = e.encode(t.decode()) if t else []
                out["n_tokens"].append(len(tokens))
                if ids:
                    out["ids"].append(tokens)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(" ".join(map(names.__getitem__, tokens)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(e.decode(tokens)).hexdigest())
            return out

        return turn

    return scan_texts(docs, text, keep, make, fields)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the ``text`` of every list of ids; bytes that are no UTF-8 become replacement characters, null is empty."""
    fields = {f.name: f.dataType for f in docs.schema.fields}
    kept = [c for c in dict.fromkeys(keep) if c != "text"]
    source = docs.select(ids, *kept)
    schema = T.StructType([T.StructField(c, fields[c]) for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        table = {r: b for b, r in read_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, i or ())).decode("utf-8", "replace") for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*kept, "text"])

    return source.mapInArrow(run, schema)


def edited_ids(docs: DataFrame, path: str, text: str, start: str, stop: str, new: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Tokens of pieces after replacing bytes ``start``..``stop`` by ``new``: ``ids`` and ``n_computed``, the number of
    prefix entries that had to be computed anew. The text is one piece (no pattern); null texts and edits are empty."""
    fields = {f.name: f.dataType for f in docs.schema.fields}
    carry = [c for c in dict.fromkeys(keep) if c not in ("ids", "n_computed")]

    def make():
        v = Vocabulary(read_ranks(path))

        def turn(texts, batch):
            at = batch.num_columns - 3
            ids, work = [], []
            for t, a, b, x in zip(texts, *(batch.column(at + i).to_pylist() for i in range(3))):
                table = PrefixTable(v, t or b"")
                a = min(max(a or 0, 0), len(table.piece))
                work.append(table.edit(a, min(max(b or 0, a), len(table.piece)), (x or "").encode()))
                ids.append(table.tokens())
            return {"ids": ids, "n_computed": work}

        return turn

    source = docs.select(*[docs[c] for c in carry], docs[text].alias("_piece"), docs[start].alias("_a"), docs[stop].alias("_b"), docs[new].alias("_x"))
    got = scan_texts(source, "_piece", [*carry, "_a", "_b", "_x"], make, [("ids", T.ArrayType(T.IntegerType())), ("n_computed", T.LongType())])
    return got.drop("_a", "_b", "_x")
