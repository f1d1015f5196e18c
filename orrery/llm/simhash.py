"""SimHash near-duplicates: fingerprints of 64 bits, compared bit-sliced, and connected components.

A document's shingles (words in a row, repeats included) are hashed by XXH64; a bit of its fingerprint is 1 if more
than half of the hashes have it. Documents of one fingerprint are one node, whatever their number; nodes are linked
where at most RADIUS (2) bits differ.

Candidates: of four segments of a fingerprint two at least are equal in a linked pair, so each pair of segments is a
bucket key of 32 bits, and no link is lost. Buckets of one are dropped by counting. A bucket of more than LIMIT
fingerprints goes on by longer keys: its other 32 bits are cut into four again, which makes keys of 48 bits, whose
buckets can't hold more than 65,536 fingerprints. These are dealt in blocks, two of which meet in each unit, so a unit
is at most 2 * LIMIT fingerprints and a fingerprint gets 63 copies of itself at most.

Units stand next to each other in sorted partitions and are compared together. Bit planes are stored vertically: 64
fingerprints in a word, a word for each bit. For a distance s in the order, the planes are compared with themselves
moved by s places: one XOR tells of 64 pairs whether they differ in this bit, and carry-save counters, which start so
high that they overflow at RADIUS + 1, add it up for all of them. After every few planes the words in which all pairs
have overflowed are abandoned. A unit tells a link from each member to the first of its component there, so it never
has more rows than members.

Cases: texts without words (null, empty) have fingerprint zero and are linked like others. A text with fewer words than
a shingle is one shingle. Rows without an id are linked like others; a component's id is its smallest id that is not
null. Rows repeated with their id are in one component. Further columns of any name pass through in row; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, mapped, shuffle_partitions, slices, written
from .near_dup import components

#: Words of a shingle, the seed of its hash, and the bits that linked fingerprints differ in at most.
SIZE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a bucket, and of a block of a larger one.
LIMIT = 1024
#: Bytes of texts, and shingles, that are worked on at once.
SPAN, STEP = 1 << 21, 1 << 16
#: Rows of whole units that are compared together at least, words of 64 pairs at once, and planes between two looks at what can be abandoned.
ROWS, WORDS, PLANES = 1 << 15, 1 << 15, 8
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, size: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole, size = memoryview(b" ".join(words)), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts, digest = len(words) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        upto = min(n, at + STEP)
        pairs = zip(starts[at:upto].tolist(), ends[at + size - 1 : upto + size - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in pairs), np.uint64, upto - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.nonzero(2 * counts > n)[0].astype(np.uint64)).sum(dtype=np.uint64))


def signed(docs: DataFrame, text_col: str, keep: list[str] | None, size: int) -> DataFrame:
    """row and print (the fingerprint, as a signed number) of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SPAN):
                found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["row", "print"])

    return mapped(carried(docs, keep, text=F.col(f"`{text_col}`").cast("binary")), sign, "print long")


def planes_of(prints: np.ndarray, spare: int) -> np.ndarray:
    """Bit planes: a row for each bit, 64 fingerprints in each word, and spare words of zeros."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    words = -(-len(prints) // 64) + spare
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 8 * words - packed.shape[1])))).view(np.uint64)


def close_pairs(prints: np.ndarray, unit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one unit whose fingerprints differ in at most radius bits. Units are numbers, equal ones next to each other."""
    at = np.arange(len(prints))
    step, held = 1, 0
    while True:
        if step > held:  # only units of more than step members have pairs at this distance
            _, where, sizes = np.unique(unit, return_inverse=True, return_counts=True)
            stay = sizes[where] > step
            at, prints, unit, held = at[stay], prints[stay], unit[stay], 2 * step
            if not len(at):
                return
            most = int(sizes.max())
        words = -(-len(at) // 64)
        steps = np.arange(step, min(step + max(1, WORDS // words), held + 1, most))
        one, two = moved(prints, unit, steps, radius)
        yield at[one], at[two]
        step = int(steps[-1]) + 1
        if step >= most:
            return


def moved(prints: np.ndarray, unit: np.ndarray, steps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the close pairs that are steps apart."""
    n, words = len(prints), -(-len(prints) // 64)
    planes = planes_of(prints, int(steps[-1]) // 64 + 2)
    over = np.zeros((len(steps), 8 * words), np.uint8)
    for k, s in enumerate(steps.tolist()):
        apart = unit[: max(0, n - s)] != unit[s:]
        over[k] = np.packbits(np.concatenate([apart, np.ones(64 * words - len(apart), bool)]), bitorder="little")
    over = over.view(np.uint64)
    nth, word = np.nonzero(over != FULL)
    over, ahead, shift = over[nth, word], word + steps[nth] // 64, (steps[nth] % 64).astype(np.uint64)
    # counters: bit k of all of them in counts[k]; from 2^bits - 1 - radius on, they overflow at radius + 1
    bits = max(1, radius.bit_length())
    begin = (1 << bits) - 1 - radius
    counts = [np.full(len(over), FULL if begin >> k & 1 else np.uint64(0)) for k in range(bits)]
    for b in range(64):
        plane = planes[b]
        carry = plane[word] ^ ((plane[ahead] >> shift) | (plane[ahead + 1] << np.uint64(1) << (np.uint64(63) - shift)))
        for k in range(bits):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over |= carry
        if b % PLANES == PLANES - 1:
            alive = np.nonzero(over != FULL)[0]
            if len(alive) < len(over):
                nth, word, over, ahead, shift = (x[alive] for x in (nth, word, over, ahead, shift))
                counts = [c[alive] for c in counts]
            if not len(alive):
                break
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(near)
    one = 64 * word[pair] + lane
    return one, one + steps[nth[pair]]


def merged(top: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Makes the least place that links reach each place's top; top holds such places."""
    while True:
        a, b = top[one], top[two]
        apart = a != b
        if not apart.any():
            return
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := top[top], top):
            top[:] = up


def unit_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """a and b: for members of a unit, the first of their component there. batches: key, unit and print, sorted by key and unit."""

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)
        top = np.arange(len(prints))
        for one, two in close_pairs(prints, np.cumsum(new), radius):
            merged(top, one, two)
        less = np.nonzero(top != np.arange(len(top)))[0]
        a, b = prints[top[less]].view(np.int64), prints[less].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    keys, prints = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)])
        prints = np.concatenate([prints, batch.column(2).to_numpy().view(np.uint64)])
        if len(keys) >= ROWS:
            last = np.nonzero((keys != keys[-1]).any(axis=1))[0]
            cut = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on
            if cut:
                yield links(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
    yield links(keys, prints)


def taken(value: Column, places: list[tuple[int, int]]) -> Column:
    """Runs of bits (first place, number) of a number, put next to each other."""
    out, at = F.lit(0).cast("long"), 0
    for first, n in places:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << n) - 1).cast("long")), at))
        at += n
    return out


def keys_of(prints: DataFrame, tables: list[tuple[int, list[tuple[int, int]]]]) -> DataFrame:
    """key and print: a key for each table (number, runs of bits that make the key)."""
    keys = [F.lit(number << 48).cast("long").bitwiseOR(taken(F.col("print"), runs)) for number, runs in tables]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "print")


def linked_prints(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """a and b: links between fingerprints (distinct ones in prints) that connect all that differ in at most two bits."""
    parts = shuffle_partitions(prints.sparkSession)
    four = [(16 * k, 16) for k in range(4)]
    first = [(n, list(runs)) for n, runs in enumerate(combinations(four, 2))]

    def longer(number: int, runs: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
        halves = [(at + 8 * h, 8) for at, n in four if (at, n) not in runs for h in (0, 1)]
        return [(8 * number + k, [*runs, *more]) for k, more in enumerate(combinations(halves, 2))]

    def counted(of: DataFrame) -> DataFrame:
        sizes = of.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").withColumnRenamed("key", "of_key")
        return of.join(sizes, F.col("key") == F.col("of_key")).select("key", "print", "members")

    def compared(of: DataFrame) -> DataFrame:
        return of.repartition(parts, "key", "unit").sortWithinPartitions("key", "unit").mapInArrow(lambda batches: unit_links(batches, radius), "a long, b long")

    buckets = written(counted(keys_of(prints, first)))
    few = buckets.filter(F.col("members") <= limit).select("key", F.lit(0).cast("long").alias("unit"), "print")
    links = compared(few)
    if not (many := buckets.filter(F.col("members") > limit)).isEmpty():
        hot = counted(reduce(DataFrame.union, (keys_of(many.filter(F.shiftright("key", 48) == number), longer(number, runs)) for number, runs in first)))
        blocks = F.ceil(F.col("members") / limit)
        mine = F.when(blocks > 1, F.pmod(F.xxhash64("print"), blocks)).otherwise(0)
        others = F.when(blocks > 1, F.array_except(F.sequence(F.lit(0).cast("long"), blocks - 1), F.array(mine))).otherwise(F.array(F.lit(0).cast("long")))
        units = hot.select("key", "print", mine.alias("mine"), F.explode(others).alias("other"))
        links = links.union(compared(units.select("key", (F.least("mine", "other") * 65_536 + F.greatest("mine", "other")).cast("long").alias("unit"), "print")))
    return links.distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, size: int = SIZE, limit: int = LIMIT) -> DataFrame:
    """row, fingerprint (16 lowercase hex digits) and component_id (the smallest id reachable by links) of every document."""
    names = list(dict.fromkeys([*(keep or docs.columns), id_col]))
    base = written(signed(docs, text_col, names, size).withColumn("id", F.col(f"row.`{id_col}`")))
    prints = written(base.groupBy("print").agg(F.min("id").alias("id")))
    labels = components(written(linked_prints(prints.select("print"), limit=limit)))
    tops = prints.join(labels, F.col("print") == F.col("node"), "left").select("print", "id", F.coalesce("component", "print").alias("component"))
    first = tops.groupBy("component").agg(F.min("id").alias("component_id"))
    of_print = tops.join(first, "component").select(F.col("print").alias("of"), "component_id")
    return base.join(of_print, F.col("print") == F.col("of")).select("row", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
