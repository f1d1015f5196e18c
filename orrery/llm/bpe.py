"""BPE encoding and decoding of whole texts with a byte-level vocabulary.

A text is cut into pieces (letters, digits, other signs, white space); each distinct piece is merged on its own. The
merges of a piece are driven by a segment tree over its adjacent pairs: a leaf holds the pair's rank and place, a node
the smaller of its two, so the root is the leftmost pair of the lowest rank. Joining two symbols changes at most three
leaves, each put right in as many steps as the tree has levels. Short pieces go through many trees at once, as rows of
one array; longer ones have a tree each.

Cases: null and empty texts have no tokens and decode to the empty text. The special tokens' strings in a text give
the special ids. Long texts are cut where a single space starts a piece, so memory does not hold all their pieces.
Repeated rows, null ids and further columns of any name pass through in row; no rows give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, mapped, slices

#: White space of Unicode, and the pieces of byte-level vocabularies of this kind.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Pieces kept with their ids in a Python worker at most.
KEPT_PIECES = 250_000
#: Pieces of at most so many bytes share an array of trees.
SHORT = 64
#: Characters of text that are cut into pieces at once, about.
SPAN = 1 << 20
#: Bytes of texts, and rows of ids, that are worked on at once.
BATCH, DECODED = 1 << 22, 1024
NONE = np.int64(1) << np.int64(62)


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in vocabularies: printable Latin-1 signs for themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, text: str) -> None:
        import regex

        data = json.loads(text)
        model, signs = data["model"], byte_signs()
        byte_of = {s: b for b, s in signs.items()}
        ids = model["vocab"]
        self.first = np.array([ids[signs[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        joined = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), joined
        self.pairs = {int(k): r for r, k in enumerate(keys)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(byte_of[s] for s in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE for those that never merge."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merged_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids of pieces of at most width bytes (a power of two), by an array of segment trees with a row for each."""
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        place = np.arange(width)
        ids = np.where(place < n[:, None], self.first[raw], -1)
        after, before = np.tile(np.arange(1, width + 1), (len(pieces), 1)), np.tile(np.arange(-1, width - 1), (len(pieces), 1))
        tree = np.full((len(pieces), 2 * width), NONE)
        r, c = np.nonzero(place[:-1] + 1 < n[:, None])
        ranks = self.rank(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(ranks < NONE, ranks * width + c, NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        levels = width.bit_length() - 1
        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while rows.size:
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            ids[rows, at] = self.joined[root // width]
            ids[rows, gone] = -1
            beyond = after[rows, gone]
            after[rows, at] = beyond
            inner = beyond < n[rows]
            before[rows[inner], beyond[inner]] = at[inner]
            tree[rows, width + gone] = NONE
            right = np.full(rows.size, NONE)
            x, y = rows[inner], at[inner]
            ranks = self.rank(ids[x, y], ids[x, beyond[inner]])
            right[inner] = np.where(ranks < NONE, ranks * width + y, NONE)
            tree[rows, width + at] = right
            ahead = before[rows, at]
            has = ahead >= 0
            x, y = rows[has], ahead[has]
            ranks = self.rank(ids[x, y], ids[x, at[has]])
            tree[x, width + y] = np.where(ranks < NONE, ranks * width + y, NONE)
            for who, leaf in ((rows, gone), (rows, at), (x, y)):
                node = leaf + width
                for _ in range(levels):
                    node = node >> 1
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        left = ids >= 0
        flat = ids[left].astype("<u4").tobytes()
        ends = np.cumsum(left.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merged_long(self, piece: bytes) -> bytes:
        """The ids of one piece, by a segment tree of its own."""
        n, none = len(piece), int(NONE)
        width = 1 << (n - 1).bit_length()
        ids = self.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        pairs, joined = self.pairs, self.joined.tolist() if not hasattr(self, "joined_list") else self.joined_list
        self.joined_list = joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for k in range(n - 1):
            r = pairs.get(ids[k] << 32 | ids[k + 1])
            if r is not None:
                tree[width + k] = r * width + k
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while (root := tree[1]) < none:
            rank, at = divmod(root, width)
            gone = after[at]
            ids[at], ids[gone] = joined[rank], -1
            beyond = after[at] = after[gone]
            put(gone, none)
            r = None
            if beyond < n:
                before[beyond] = at
                r = pairs.get(ids[at] << 32 | ids[beyond])
            put(at, none if r is None else r * width + at)
            if (ahead := before[at]) >= 0:
                r = pairs.get(ids[ahead] << 32 | ids[at])
                put(ahead, none if r is None else r * width + ahead)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> list[str]:
        """Puts the ids of new pieces into known; those beyond KEPT_PIECES, to be dropped again, are returned."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(raw):
            by_width.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(k)
        room = KEPT_PIECES - len(self.known)
        for width, which in by_width.items():
            for start in range(0, len(which), 1 << 13):
                part = which[start : start + (1 << 13)]
                found = self.merged_short([raw[k] for k in part], width) if width <= SHORT else [self.merged_long(raw[k]) for k in part]
                self.known.update(zip([pieces[k] for k in part], found, strict=True))
        return pieces[max(room, 0) :]

    def spans(self, text: str) -> Iterator[str | int]:
        """The text in spans that are cut into pieces apart from each other, and special ids."""
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                yield self.special[part]
                continue
            start = 0
            while start < len(part):
                end = start + SPAN
                while end < len(part) and not (part[end] == " " and not part[end - 1].isspace() and not part[end + 1 : end + 2].isspace() and end + 1 < len(part)):
                    end += 1
                yield part[start:end]
                start = end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for text in texts:
            ids = []
            for span in self.spans(text or ""):
                if isinstance(span, int):
                    ids.append(span.to_bytes(4, "little"))
                    continue
                pieces = self.pieces.findall(span)
                drop = self.learn(new) if (new := [p for p in set(pieces) if p not in self.known]) else []
                ids.append(b"".join(map(self.known.__getitem__, pieces)))
                for p in drop:
                    del self.known[p]
            out.append(b"".join(ids))
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """As encode_all, with new pieces of many short texts learned together."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end] or "") <= SPAN):
                chars += len(texts[end] or "")
                end += 1
            part = texts[start:end]
            drop: list[str] = []
            if end - start > 1:
                cut = [[s for s in self.spans(t or "")] for t in part]
                all_pieces = [[s if isinstance(s, int) else self.pieces.findall(s) for s in spans] for spans in cut]
                new = {p for spans in all_pieces for s in spans if not isinstance(s, int) for p in s if p not in self.known}
                drop = self.learn(list(new)) if new else []
                get = self.known.__getitem__
                for spans in all_pieces:
                    yield b"".join(s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(get, s)) for s in spans)
                for p in drop:
                    del self.known[p]
            else:
                yield from self.encode_all(part)
            start = end

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, packed: bool = False) -> DataFrame:
    """row, n_tokens (long) and ids of every document: array<int>, or if packed binary of little-endian unsigned 32-bit ids.

    path: the tokenizer file, read on the driver and broadcast (its size does not depend on the data).
    """
    file = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(file.value)
        for batch in (part for whole in batches for part in slices(whole, 1, BATCH)):
            ids = list(known.encode_batch(batch.column(1).to_pylist()))
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            if packed:
                column: Any = pa.array(ids, pa.binary())
            else:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), column], names=["row", "n_tokens", "ids"])

    return mapped(carried(docs, keep, text=F.col(text_col)), encode, f"n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decoded(df: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """row and text for every row of ids (array<int>, or binary as encoded() packs them; null: no ids)."""
    file = df.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(file.value)
        for batch in (whole.slice(k, DECODED) for whole in batches for k in range(0, whole.num_rows, DECODED)):
            ids = batch.column(1)
            raw = ids.to_pylist() if pa.types.is_binary(ids.type) else [x.values.to_numpy().astype("<u4").tobytes() if x.is_valid else b"" for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.decode(x or b"") for x in raw], pa.string())], names=["row", "text"])

    return mapped(carried(df, keep, ids=F.col(ids_col)), decode, "text string")
