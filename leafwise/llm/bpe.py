"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its byte position (a large number where no pair starts), an inner
node the smaller of its two; equal ranks go to the left. The root so names the leftmost pair of least rank. A merge
joins that pair, removes the leaf of its second part and gives new ranks to the pair and to the live neighbour on its
left: three point updates of logarithmic cost, so a run of n bytes costs O(n log n) however long it is.

The trees of many pieces of like length stand as rows of one array and step together. Pieces that a
worker has met are kept in a bounded table; the table decides only about time, never about ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from .common import tidy, unused

FAR = np.int64(1) << 62
#: So few pieces of like length are merged one by one, in plain integers; more step together.
FEW = 12
# Fixed value: the pattern whose matches never reach over a single space between other characters, see Encoder.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
PIECES_KEPT = 600_000
SEGMENTS_KEPT = 300_000
CHARS_AT_ONCE = 4_000_000


class Ranks:
    """The ranks of a vocabulary, with the ranks of all pairs of tokens whose bytes make a token."""

    def __init__(self, lines: Iterable[bytes], pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.token = {r: t for t, r in self.rank.items()}
        size = max(self.token) + 1
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, made = [], []
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    made.append(r)
        self.size = size
        bits = 21
        while True:
            table = self._hashed(np.array(keys, dtype=np.int64), np.array(made, dtype=np.int64), bits)
            if table is not None:
                break
            bits += 1

    def _hashed(self, keys: np.ndarray, made: np.ndarray, bits: int):
        """Open addressing with few steps, filled step by step; None if the table is too small."""
        self.bits, self.steps = bits, 0
        self.keys, self.made = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, FAR, dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            if self.steps == 8:
                return None
            at = self._slot(keys[left], self.steps)
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.made[at[won]] = made[left[won]]
            left, self.steps = left[~won], self.steps + 1
        return self

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (((mixed >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, FAR where its bytes make no token."""
        keys = a * self.size + b
        at = self._slot(keys, 0)
        out = np.where(self.keys[at] == keys, self.made[at], FAR)
        for step in range(1, self.steps):
            odd = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
            if not len(odd):
                break
            again = self._slot(keys[odd], step)
            hit = self.keys[again] == keys[odd]
            out[odd[hit]] = self.made[again[hit]]
            at[odd] = again
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        widths: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif piece:
                widths.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, found in widths.items():
            step = max(1, (1 << 20) // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                merged = self._merged([pieces[k] for k in part], width) if len(part) > FEW else map(self._alone, (pieces[k] for k in part))
                for k, ids in zip(part, merged, strict=True):
                    out[k] = ids
        return out

    def _merged(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        n, shift = len(pieces), np.int64(width.bit_length())
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        token = self.byte[raw].ravel()  # of the part that starts at a position
        column = np.arange(width)
        live = (column < length[:, None]).ravel()
        after = np.tile(column + 1, (n, 1)).ravel()  # where the next live part starts
        before = np.tile(column - 1, (n, 1)).ravel()
        has_pair = (column + 1 < length[:, None]).ravel()
        leaf = np.full(n * width, FAR, dtype=np.int64)
        at = np.flatnonzero(has_pair)
        rank = self.pairs(token[at], token[at + 1])
        leaf[at] = np.where(rank == FAR, FAR, (rank << shift) | (at % width))
        tree = np.full((n, 2 * width), FAR, dtype=np.int64)
        tree[:, width:] = leaf.reshape(n, width)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        flat = tree.ravel()

        def update(rows: np.ndarray, positions: np.ndarray, values: np.ndarray) -> None:
            """Point updates, one position of each row: the leaf, then its ancestors to the root."""
            base, node = rows * (2 * width), positions + width
            flat[base + node] = values
            while True:
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
                if node[0] <= 1:
                    return

        def ranked(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = self.pairs(token[rows * width + left], token[rows * width + right])
            return np.where(found == FAR, FAR, (found << shift) | left)

        active = np.flatnonzero(tree[:, 1] < FAR)
        while len(active):
            least = flat[active * (2 * width) + 1]
            left = least & ((np.int64(1) << shift) - 1)
            base = active * width
            right = after[base + left]
            token[base + left] = least >> shift
            live[base + right] = False
            follow = after[base + right]
            after[base + left] = follow
            more = follow < length[active]
            before[(base + follow)[more]] = left[more]
            update(active, right, np.full(len(active), FAR))
            value = np.full(len(active), FAR)
            value[more] = ranked(active[more], left[more], follow[more])
            update(active, left, value)
            prior = before[base + left]
            some = prior >= 0
            if some.any():
                rows = active[some]
                update(rows, prior[some], ranked(rows, prior[some], left[some]))
            active = active[flat[active * (2 * width) + 1] < FAR]
        packed = token[live].astype("<u4").tobytes()
        ends = np.cumsum(live.reshape(n, width).sum(axis=1)) * 4
        start = 0
        for end in ends.tolist():
            yield packed[start:end]
            start = end

    def _alone(self, piece: bytes) -> bytes:
        """One piece by a tree of its own."""
        n, far = len(piece), int(FAR)
        width = max(2, 1 << (n - 1).bit_length())
        shift, rank, parts = width.bit_length(), self.rank, [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def ranked(left: int, right: int) -> int:
            found = rank.get(parts[left] + parts[right])
            return far if found is None else found << shift | left

        tree = [far] * width + [ranked(i, i + 1) for i in range(n - 1)] + [far] * (width - n + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(position: int, value: int) -> None:
            node = position + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < far:
            left = tree[1] & ((1 << shift) - 1)
            right = after[left]
            parts[left] += parts[right]
            parts[right] = b""
            after[left] = follow = after[right]
            update(right, far)
            update(left, ranked(left, follow) if follow < n else far)
            if follow < n:
                before[follow] = left
            if before[left] >= 0:
                update(before[left], ranked(before[left], left))
        return b"".join(rank[p].to_bytes(4, "little") for p in parts if p)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Encoder:
    """Encodes whole texts. A text falls apart at single spaces between other characters, where no match of the
    pattern can reach across; each such segment's ids are kept. A text with other runs of space goes
    through the pattern as a whole, as do all texts if the pattern is another one."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.pieces: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        self.spaced = ranks.pattern.pattern == SPACED

    def _learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > PIECES_KEPT:
            self.pieces.clear()
        self.pieces.update(zip(new, self.ranks.encode_pieces([p.encode("utf-8") for p in new]), strict=True))

    def _parts(self, texts: Iterable[str]) -> dict[str, bytes]:
        """The ids of texts by their matches."""
        split = {t: self.ranks.pattern.findall(t) for t in texts}
        needed = {p for found in split.values() for p in found}
        missing = needed.difference(self.pieces)
        if missing:
            kept = {p: self.pieces[p] for p in needed.difference(missing)}
            self._learn(missing)
            self.pieces.update(kept)
        look = self.pieces.__getitem__
        return {t: b"".join(map(look, found)) for t, found in split.items()}

    def _segments(self, new: set[str]) -> None:
        """Learn segments, each read with the space before it. Most are a plain word, perhaps with a stop or comma."""
        plain = {s: m.groups() for s in new if (m := _PLAIN.fullmatch(s))}
        ends = self._parts(["", ".", ","])
        words = {f" {word}" for word, _ in plain.values()}
        missing = words.difference(self.pieces)
        if missing:
            kept = {p: self.pieces[p] for p in words.difference(missing)} if len(self.pieces) + len(missing) > PIECES_KEPT else {}
            self._learn(missing)
            self.pieces.update(kept)
        look = self.pieces
        for s, (word, end) in plain.items():
            self.segments[s] = look[f" {word}"] + ends[end]
        for s, ids in self._parts([f" {s}" for s in new.difference(plain)]).items():
            self.segments[s[1:]] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.spaced:
            whole = self._parts(set(texts))
            return [whole[t] for t in texts]
        split = [t.split(" ") for t in texts]
        seen: set[str] = set()
        for found in split:
            seen.update(found[1:])
        new = seen.difference(self.segments)
        odd = {s for s in new if not s or s[0].isspace() or s[-1].isspace()}
        new -= odd
        if len(self.segments) + len(new) > SEGMENTS_KEPT:
            self.segments = {s: self.segments[s] for s in seen.difference(new, odd)}
        self._segments(new)
        whole = [len(f) > 1 and (not f[0] or f[0][-1].isspace() or not (not odd or odd.isdisjoint(f[1:]))) for f in split]
        firsts = self._parts({t if w else f[0] for t, f, w in zip(texts, split, whole, strict=True)})
        look = self.segments.__getitem__
        return [firsts[t] if w else firsts[f[0]] + b"".join(map(look, f[1:])) for t, f, w in zip(texts, split, whole, strict=True)]


def parts_of(values: list, chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Stretches of the list whose texts have about so many characters."""
    start = total = 0
    for k, v in enumerate(values):
        total += len(v)
        if total >= chars:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(values):
        yield start, len(values)


_RANKS: dict[str, Ranks] = {}


def ranks_of(path: str, pattern: str) -> Ranks:
    """Read once per process; the vocabulary file is installed on each machine."""
    key = f"{path}\n{pattern}"
    if key not in _RANKS:
        with open(path, "rb") as f:
            _RANKS[key] = Ranks(f, pattern)
    return _RANKS[key]


def encode_documents(docs, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, keep: tuple[str, ...] = ()):
    """id_col, ids (array of int), decoded (binary: the bytes of the decoded ids), and the columns in keep; names that clash
    with those get underscores before them.

    A null text is read as an empty one: no ids, no bytes. Rows are independent of each other: repeated rows give
    repeated results, an empty table an empty one.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in keep])
    own = unused(chosen, "ids", "decoded")[: 1 + decode]
    fields = [f.simpleString().replace(":", "` ", 1) for f in chosen.schema.fields if f.name != "text"]
    schema = ", ".join(["`" + f for f in fields] + [f"`{name}` {kind}" for name, kind in zip(own, ("array<int>", "binary"), strict=False)])

    def run(batches):
        encoder = Encoder(ranks_of(vocabulary, pattern))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rest = batch.drop_columns(["text"])
            for a, b in parts_of(texts):
                ids = encoder.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                columns = rest.slice(a, b - a).columns + [lists]
                if decode:
                    columns.append(pa.array([encoder.ranks.decode(x) for x in ids], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=rest.schema.names + own)

    return chosen.mapInArrow(tidy(run), schema)


def digest_documents(docs, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"):
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids stay in the worker, their digests leave it."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        encoder = Encoder(ranks_of(vocabulary, pattern))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in parts_of(texts):
                ids = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], type=pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(encoder.ranks.decode(x)).hexdigest() for x in ids]),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
