"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become token ids; those longer than a sequence are cut, all others stay whole. How the pieces share
sequences is decided on their lengths alone: the histogram of lengths has as many rows as a sequence has tokens at
most, however many documents there are, and the search on it gives fillings with the number of sequences filled that
way. Pieces then get their places by joins: a piece's rank among those of its length picks its place in a filling.

The search is bin completion by branch and bound. Around the longest piece left it enumerates fillings of what is
left of the sequence, drops the dominated ones (another piece fits in, or a longer piece fits in one's stead), takes
those of least waste first, and prunes branches whose waste can no longer beat the incumbent. The first descent takes
the best fitting filling each time, and is the first incumbent; the search ends when the incumbent meets the bound
total / capacity or after `nodes` branchings that follow the first incumbent, however many the first descent takes.

Cases: a null or empty text has only the end token. Repeated rows are documents of their own. A null id is kept. No
rows give no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_signs
from .common import carried, mapped, shuffle_partitions, written

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 4096, 1
#: Branchings of the search after the first incumbent at most, fillings tried at each, and steps to find them.
NODES, WIDTH, STEPS = 2000, 8, 4000
#: Bytes of text whose words are looked up together, and words that are kept (see Words).
SPAN, KEPT = 1 << 21, 500_000


class Words:
    """Ids of words, worked out by the tokenizer and kept: those of the last KEPT to twice KEPT distinct words.

    A word of letters alone is one piece for the tokenizer, and goes to its model at once; so does one with a point or
    a comma at its end, which is a piece of its own. All other words are encoded as texts.
    """

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_str(text)
        self.model = self.tokens.model
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.signs = dict(byte_signs())
        self.last = {sign: self.of_texts([sign.decode()])[0] for sign in (b".", b",")}

    def of_texts(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokens.encode_batch_fast(words, add_special_tokens=False)]

    def of_letters(self, word: bytes) -> bytes | None:
        """The ids of a word of letters that the tokenizer's normalizer leaves as it is; else None."""
        text = word.decode()
        if not text.isalpha() or text != text.lower():
            return None
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                return None
            text = word.decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        out: list[bytes | None] = []
        for w in words:
            last = self.last.get(w[-1:])
            if last is None:
                out.append(self.of_letters(w))
            else:
                stem = self.now.get(w[:-1]) if w[:-1].isalpha() else None
                stem = stem or self.of_letters(w[:-1])
                out.append(stem and stem + last)
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.of_texts([words[k].decode() for k in rest]), strict=True):
            out[k] = x
        return out

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of texts, word by word: this kind of vocabulary has no token with a space in it, and ignores case."""
        words = []
        for text in texts:
            text = text or b""
            if b"<|" not in text:  # which could become a special token
                text = text.lower()
            words.append(text.split())
        found = [list(map(self.now.get, w)) for w in words]
        gaps = [list(places_of_none(vs)) for vs in found]
        new = {ws[k] for ws, at in zip(words, gaps, strict=True) for k in at}
        if new:
            fresh = {w: self.before[w] for w in new if w in self.before}
            unknown = [w for w in new if w not in fresh]
            fresh.update(zip(unknown, self.encoded(unknown), strict=True))
            for ws, vs, at in zip(words, found, gaps, strict=True):
                for k in at:
                    vs[k] = fresh[ws[k]]
            if len(self.now) > KEPT:
                self.before, self.now = self.now, {}
            self.now.update(fresh)
        return [b"".join(vs) for vs in found]


def places_of_none(values: list) -> Iterator[int]:
    k = -1
    try:
        while True:
            k = values.index(None, k + 1)
            yield k
    except ValueError:
        return


@lru_cache(maxsize=2)
def word_ids(text: str) -> Words:
    return Words(text)


def spans(texts: list[bytes | None], size: int) -> Iterator[list[bytes | None]]:
    """The texts in runs of about size bytes."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or b"")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """row, piece, start, length, ids_crc32 and (with_ids) ids of every piece of every document.

    path: a file of the tokenizers library whose tokens hold no white space, read on the driver and broadcast.
    """
    file = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = word_ids(file.value), end.to_bytes(4, "little")
        for batch in batches:
            whose, rows, ids = [], [], []
            for k, raw in enumerate(x for run in spans(batch.column(1).to_pylist(), SPAN) for x in known.ids(run)):
                raw += last
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    whose.append(k)
                    rows.append((p, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            p, start, length, crc = (pa.array(x) for x in np.array(rows, dtype=np.int64).reshape(-1, 4).T)
            columns = [batch.column(0).take(pa.array(whose, pa.int64())), p.cast(pa.int32()), start, length, crc]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=["row", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return mapped(carried(docs, keep, text=F.col(text_col).cast("binary")), cut, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fillings(counts: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of room from the pieces in counts (length to number), as (waste, lengths), least waste first."""
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    left, found, chosen, steps = {s: counts[s] for s in sizes}, [], [], STEPS
    exact, rest = 0, room
    # what is chosen so far, by depth: the place of the next length to try, and whether one was tried; no recursion, as a filling may have thousands of pieces
    stack: list[list[int]] = []

    def dominated() -> bool:
        smallest = next((s for s in sizes if left[s]), None)
        if smallest is not None and smallest <= rest:
            return True  # a piece fits in besides
        for c in set(chosen):
            k = bisect_left(sizes, c + 1)
            while k < len(sizes) and sizes[k] <= c + rest:
                if left[sizes[k]]:
                    return True  # a longer piece fits in c's stead
                k += 1
        return False

    entering = True
    while entering or stack:
        if steps <= 0 or exact >= WIDTH:
            break
        if entering:
            entering = False
            steps -= 1
            top = chosen[-1] if chosen else room
            if rest <= top and left.get(rest, 0):  # an exact fit ends it
                found.append((0, (*chosen, rest)))
                exact += 1
                at, tried = -1, 1
            else:
                at, tried = bisect_right(sizes, min(rest, top)) - 1, 0
            stack.append([at, tried])
        level = stack[-1]
        while level[0] >= 0 and not left[sizes[level[0]]]:
            level[0] -= 1
        if level[0] >= 0:
            s = sizes[level[0]]
            level[0], level[1] = level[0] - 1, 1
            left[s] -= 1
            chosen.append(s)
            rest -= s
            entering = True
            continue
        if not level[1] and not dominated():
            found.append((rest, tuple(chosen)))
            exact += rest == 0
        stack.pop()
        if chosen:
            s = chosen.pop()
            left[s] += 1
            rest += s
    left = {s: counts[s] for s in sizes}
    if not found:  # the steps ran out: the best fit, longest piece first
        chosen, rest = [], room
        for s in reversed(sizes):
            n = min(left[s], rest // s)
            chosen += [s] * n
            rest -= n * s
        found.append((rest, tuple(chosen)))
    return sorted(set(found), key=lambda x: (x[0], tuple(-s for s in x[1])))[:WIDTH]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, longest first) and how many sequences are filled so. histogram: pieces by length, 1 to capacity."""
    counts = {s: n for s, n in histogram.items() if n and s < capacity}
    whole = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    total = sum(s * n for s, n in counts.items())
    bound = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins = 0
    path: list[tuple[tuple[int, ...], int]] = []
    waste = bins = 0

    def branches() -> Iterator[tuple[int, tuple[int, ...]]]:
        longest = max(s for s, n in counts.items() if n)
        counts[longest] -= 1
        try:
            found = fillings(counts, capacity - longest)
        finally:
            counts[longest] += 1
        return iter([(w, (longest, *f)) for w, f in found])

    def place(filling: tuple[int, ...], m: int) -> None:
        for s in filling:
            counts[s] -= m

    stack = [branches()] if total else []
    while stack:
        step = next(stack[-1], None)
        if step is None or (best is not None and nodes <= 0):
            stack.pop()
            if path and len(path) > len(stack) - 1 and stack:
                filling, m = path.pop()
                place(filling, -m)
                waste -= m * (capacity - sum(filling))
                bins -= m
            continue
        w, filling = step
        m = min(counts[s] // filling.count(s) for s in set(filling))
        left = any(n - m * filling.count(s) for s, n in counts.items())
        if best is not None and waste + m * w * left > (best_bins - 1) * capacity - total:
            continue  # its waste can't beat the incumbent
        place(filling, m)
        if left:
            nodes -= best is not None
            path.append((filling, m))
            waste += m * w
            bins += m
            stack.append(branches())
            continue
        if best is None or bins + m < best_bins:
            best, best_bins = [*path, (filling, m)], bins + m
        place(filling, -m)
        if best_bins <= bound:
            break
    return whole + (best or [])


def packed(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """parts (as pieces() gives them) with sequence_id and offset, in as few sequences as the search finds."""
    spark, parts = parts.sparkSession, written(parts)
    salt = F.pmod(F.xxhash64("row", "piece", "ids_crc32"), F.lit(max(16, shuffle_partitions(spark)))).cast("int")
    salted = parts.withColumn("salt", salt)
    numbers = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, m in plan(histogram, capacity, nodes):
        offset = 0
        for s in sorted(set(filling), reverse=True):
            u, start = filling.count(s), used.get(s, 0)
            places.setdefault(s, []).append((start, start + u * m, u, sequence, offset))
            used[s] = start + u * m
            offset += u * s
        sequence += m
    schema = "of_length long, places array<struct<start:long, stop:long, each:long, sequence:long, offset:long>>"
    where = spark.createDataFrame([(s, x) for s, x in places.items()], schema)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = numbers.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy(F.xxhash64("row", "piece"), "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(firsts, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("first"))
    out = ranked.join(F.broadcast(where), F.col("length") == F.col("of_length"))  # a row for each length, capacity at most
    place = F.filter("places", lambda p: (p["start"] <= F.col("nth")) & (F.col("nth") < p["stop"]))
    out = out.withColumn("place", F.get(place, 0)).withColumn("within", F.col("nth") - F.col("place.start"))
    sequence_id = F.col("place.sequence") + F.floor(F.col("within") / F.col("place.each"))
    offset = F.col("place.offset") + (F.col("within") % F.col("place.each")) * F.col("length")
    return out.select(*parts.columns, sequence_id.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
