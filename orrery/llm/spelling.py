"""Spelling variants: words one edit apart, found by generating each word's full neighbourhood.

Words are maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF) in lower case (A-Z only). Of every 31st run of a
document, by a checksum of its id and the run, one code point is deleted, as a writer's slips would be. Words of at
least SHORTEST code points and SEEN occurrences are the vocabulary.

Every word emits all its distinct deletions, replacements and insertions over the alphabet of the vocabulary, and what
an equi-join finds in the vocabulary is near: no distance is verified, as each candidate is one edit away by its making.
Candidates are worked out as numbers first: a word's hash is a sum of its code points times powers of an odd number, so
the hash of each neighbour is a few additions, done for all places and letters at once. A Bloom filter of the
vocabulary, of a bounded size, drops nearly all of those that are in no vocabulary before they are made as strings and
shuffled; what it lets through too many, the join drops. No key of the join is hot: a word has no more than
(2 * length + 1) * letters neighbours.

A word's form is its near word of largest count, if that is ten times its own at least. Counts grow tenfold along forms,
so there are no circles and a way to a root has 18 steps at most, which are doubled at a time.

Cases: null texts have no runs. A null id counts as the empty text in the checksum. Rows repeated count each. A word of
any length is taken whole, its neighbours some positions at a time. No words give no rows. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, ship, shuffle_partitions, written

#: Code points and occurrences of a word at least, and the share of runs that lose one.
SHORTEST, SEEN, EVERY = 7, 2, 31
#: How many times as often as a word its form must occur.
TIMES = 10
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Bits of the filter for each word, its bits at most, and the bits that a word sets.
BITS, MOST_BITS, PROBES = 16, 1 << 27, 4
#: Neighbours that are worked out at once, and bytes of them that are handed on together.
BLOCK, SPAN = 1 << 18, 1 << 22
#: The odd number whose powers are a hash's weights.
BASE = 0x9E3779B97F4A7C15


def long_runs(shortest: int) -> re.Pattern[bytes]:
    """Runs of at least so many code points, in UTF-8: U+00C0 to U+00FF are C3 and a byte from 80 to BF."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % shortest)


def slipped(run: bytes, h: int, every: int) -> bytes:
    """run, or if `every` divides h, run without its code point h % length."""
    if h % every:
        return run
    points = run.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


def vocabulary(docs: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST, seen: int = SEEN, every: int = EVERY) -> DataFrame:
    """word and n (occurrences)."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, least = long_runs(shortest), re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d}" % shortest)
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                content = text.as_buffer()
                for run, n in Counter(runs.findall(content.to_pybytes().lower() if content else b"")).items():
                    h = zlib.crc32(run, start)
                    if h % every:
                        held[run] += n
                    elif least.match(word := slipped(run, h, every)):
                        held[word] += n
                if len(held) >= HELD:
                    yield told()
        yield told()

    ids = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    counted = docs.select(ids.alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def points_of(word: str) -> np.ndarray:
    return np.fromiter(map(ord, word), np.uint64, len(word))


class Weights:
    """Powers of BASE, as many as have been asked for."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            out = np.full(2 * n, BASE, np.uint64)
            out[0] = 1
            self.powers = np.multiply.accumulate(out)
        return self.powers[:n]


def first_probe(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of these hashes, the first place in the filter and the step to the next ones."""
    place = mixed(hashes)
    return place, mixed(place ^ np.uint64(BASE)) | np.uint64(1)


def filter_of(words: DataFrame, bits: int) -> np.ndarray:
    """The vocabulary's filter, as words of 64 bits: tasks put theirs together by place, so that bits / 64 rows at most reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights()
        for batch in batches:
            place, step = first_probe(np.array([(p := points_of(w)) @ weights(len(p)) for w in batch.column(0).to_pylist()], np.uint64))
            at = np.concatenate([place + np.uint64(k) * step for k in range(PROBES)]) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    found = words.select("word").mapInArrow(places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def in_filter(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    at, (place, step) = np.arange(len(hashes)), first_probe(hashes)
    for k in range(PROBES):
        where = (place[at] + np.uint64(k) * step[at]) & np.uint64(64 * len(bitmap) - 1)
        at = at[(bitmap[(where >> np.uint64(6)).astype(np.int64)] >> (where & np.uint64(63))) & np.uint64(1) == 1]
    return at


def neighbours(words: list[str], alphabet: str, letters: np.ndarray, weights: Weights, bitmap: np.ndarray) -> Iterator[tuple[str, str]]:
    """(word, neighbour): the distinct neighbours of words of one length that the filter lets through, some positions at a time.

    With p the code points and B the base, a word's hash is the sum of p[i] * B^i. Without point i, those after it come
    one place nearer; with a point at i, those from i on go one place further; only p[i] changes by a replacement.
    """
    size = len(words[0])
    points = points_of("".join(words)).reshape(len(words), size)
    powers, none = weights(size + 1), np.zeros((len(words), 1), np.uint64)
    terms = points * powers[:-1]
    upto = np.concatenate([none, np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)  # of the first i points
    nearer = np.concatenate([none, np.cumsum(points[:, 1:] * powers[: size - 1], axis=1, dtype=np.uint64)], axis=1)  # of points 1 to i, one place nearer
    total, before = upto[:, -1:], np.concatenate([none, points], axis=1)  # the point before each place

    def found(hashes: np.ndarray, distinct: np.ndarray) -> Iterator[tuple[int, ...]]:
        places = np.nonzero(distinct)
        passed = in_filter(hashes[places], bitmap)
        return zip(*(p[passed].tolist() for p in places), strict=True)

    for w, i in found(upto[:, :-1] + (nearer[:, -1:] - nearer), points != before[:, :-1]):  # deletions in a run of one letter are equal
        yield words[w], words[w][:i] + words[w][i + 1 :]
    step = max(1, BLOCK // max(1, len(letters)))
    for start in range(0, size + 1, step):
        some = slice(start, min(size, start + step))
        with_letter = powers[some][None, :, None] * letters
        for w, i, c in found((total - terms[:, some])[:, :, None] + with_letter, points[:, some, None] != letters):
            yield words[w], words[w][: start + i] + alphabet[c] + words[w][start + i + 1 :]
        some = slice(start, min(size + 1, start + step))
        with_letter = powers[some][None, :, None] * letters
        moved = upto[:, some] + (total - upto[:, some]) * np.uint64(BASE)
        for w, i, c in found(moved[:, :, None] + with_letter, before[:, some, None] != letters):  # a letter after an equal one is the word that has it before
            yield words[w], words[w][: start + i] + alphabet[c] + words[w][start + i :]


def candidates(words: DataFrame, alphabet: str, bitmap: np.ndarray) -> DataFrame:
    """word and near: what the filter lets through of each word's neighbours."""
    held = words.sparkSession.sparkContext.broadcast(bitmap)  # its size is bounded by MOST_BITS

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, letters, bits = Weights(), points_of(alphabet), held.value
        out: list[tuple[str, str]] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["word", "near"])

        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for word in batch.column(0).to_pylist():
                by_length.setdefault(len(word), []).append(word)
            for length, group in by_length.items():
                step = max(1, BLOCK // ((length + 1) * len(letters)))
                for start in range(0, len(group), step):
                    for pair in neighbours(group[start : start + step], alphabet, letters, weights, bits):
                        out.append(pair)
                        size += 2 * length
                        if size > SPAN:
                            yield told()
                            out, size = [], 0
        yield told()

    return words.select("word").repartition(shuffle_partitions(words.sparkSession), "word").mapInArrow(generate, "word string, near string")


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n: every pair of words that are one edit apart, in both directions. words: word and n, a written table."""
    ship(words.sparkSession)
    letters = sorted(r["letter"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''").distinct().collect())  # 90 at most
    n = words.count()
    bits = 1 << max(6, min(MOST_BITS.bit_length() - 1, (BITS * n - 1).bit_length()))
    found = candidates(words, "".join(letters), filter_of(words, bits))
    known = words.select(F.col("word").alias("known"), F.col("n").alias("near_n"))
    return found.join(known, F.col("near") == F.col("known")).select("word", "near", "near_n")


def rooted(forms: DataFrame) -> DataFrame:
    """word and root: the last of the way from word to form, for words that have a form. forms: word and form."""
    ways = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("of"), F.col("root").alias("top"))
        longer = written(ways.join(further, F.col("root") == F.col("of"), "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if longer.filter("moved").isEmpty():
            return ways
        ways = longer.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, **how: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    words = written(vocabulary(docs, id_col, text_col, **how))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = near.select(F.col("word").alias("of"), "n_near", "best.near", (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= times * F.col("n")
    found = words.join(near, F.col("word") == F.col("of"), "left")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
    roots = rooted(found.filter("form IS NOT NULL")).select(F.col("word").alias("of"), F.col("root").alias("last"))
    return found.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
