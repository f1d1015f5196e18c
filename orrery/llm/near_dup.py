"""Near-duplicate documents: min-max MinHash, banding, exact confirmation, connected components.

A document is the set of its word shingles, each a 64-bit hash. Documents of one set form a class, whatever their
number, and all that follows works on classes. Under each permutation a set keeps its least and its largest value:
two signature values for one hash evaluation, each equal in two sets with the probability of their similarity. Bands
of signature values are bucket keys.

In each bucket the class with the least key is the pivot, and every member forms a pair with it (never members among
themselves). Pairs whose signatures agree too seldom for the similarity (4.5 standard deviations below it) go; each
class's most similar pivot is confirmed on full sets. In each bucket that still holds several components, the members
outside its largest one meet all of its members, in blocks that are bounded by members and by bytes of their sets. Only
pairs of different components that share no earlier bucket, whose sizes allow the similarity and whose signatures do not
rule it out are confirmed, on their full sets, where they meet; a link joins two components there, so a block tells no
more links than it has members, however many of them are alike. No pair that shares a band is given up.

With 38 bands of 6 values a pair of similarity 0.8 shares no band with probability 1e-5, one of 0.9 with 1e-13.

Cases: texts without words (null, empty) have no set and are linked with nothing. A text with fewer words than a
shingle is one shingle. Rows without an id are linked like others; a component's id is its smallest id that is not
null, and a row stays if its id is that one (or both are null). Rows repeated with their id stay or go together.
Further columns of any name pass through in row; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WordHashes, carried, mapped, mixed, odd_numbers, pieces, slices, written

#: Bands, and signature values of each. Half of the bands hold least values, half largest ones.
BANDS, ROWS = 38, 6
#: Standard deviations below the similarity at which a pair's signatures rule it out.
DEVIATIONS = 4.5
#: Members of a bucket that one task compares with as many others, about, and bytes of their shingles.
BLOCK, UNIT = 2048, 1 << 23
#: Members whose full sets are confirmed at once.
TRIED = 64
#: Bytes of texts whose sets are held at once.
SPAN = 1 << 21
#: Shingles that go through a permutation at once, and that are hashed at once.
STEP, PART = 1 << 15, 1 << 17


def shingle_sets(texts: list[bytes | None], size: int, known: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    weights = odd_numbers(size, size)
    out = []
    for text in texts:
        parts = (piece.lower().split() for piece in pieces(text or b"", SPAN, SPACE))
        codes = np.concatenate([np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)) for words in parts])
        n_words = len(codes)
        n = max(1, n_words - size + 1) if n_words else 0
        if n_words < size:
            codes = np.concatenate([codes, np.full(size - n_words, size, np.uint64)])  # no word has such a code but by chance
        hashes = np.empty(n, np.uint64)
        for at in range(0, n, PART):
            part = np.zeros(min(PART, n - at), np.uint64)
            for k in range(size):
                part += codes[at + k : at + k + len(part)] * weights[k]
            hashes[at : at + len(part)] = mixed(part)
        hashes.sort()
        out.append(hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if n else hashes)
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, signature values) of non-empty sets: arrays of a row for each."""
    values = bands * rows
    half = values // 2
    flips, factors = mixed(odd_numbers(17, half)), odd_numbers(29, half)
    sig = np.empty((len(sets), values), np.uint64)
    start = 0
    while start < len(sets):
        end, n = start + 1, len(sets[start])
        while end < len(sets) and n + len(sets[end]) <= STEP:
            n += len(sets[end])
            end += 1
        part = np.concatenate(sets[start:end])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]])]).astype(np.int64)
        out = np.empty_like(part)
        for k in range(half):
            np.bitwise_xor(part, flips[k], out=out)
            np.multiply(out, factors[k], out=out)
            sig[start:end, k] = np.minimum.reduceat(out, at)
            sig[start:end, half + k] = np.maximum.reduceat(out, at)
        start = end
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys = mixed(keys ^ sig[:, r::rows])
    return mixed(keys + np.arange(bands, dtype=np.uint64)), mixed(sig).astype(np.uint16)


def signed(docs: DataFrame, text_col: str, keep: list[str] | None, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, n_shingles, class and check (which together tell sets apart; null: no words), keys (bucket keys) and sig (signature, 16 bits of each value)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in slices(whole, 1, SPAN):
                sets = shingle_sets(batch.column(1).to_pylist(), size, known)
                full = [s for s in sets if len(s)]
                keys, sig = signatures(full, bands, rows)
                k, classes, checks, key_lists, sigs = 0, [], [], [], []
                for s in sets:
                    one, two = class_of(s) if len(s) else (None, None)
                    classes.append(one)
                    checks.append(two)
                    key_lists.append(keys[k].view(np.int64) if len(s) else None)
                    sigs.append(sig[k].tobytes() if len(s) else None)
                    k += bool(len(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), pa.array(key_lists, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["row", "n_shingles", "class", "check", "keys", "sig"],
                )

    return mapped(carried(docs, keep, text=F.col(text_col).cast("binary")), sign, "n_shingles long, class long, check long, keys array<long>, sig binary")


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two numbers of 64 bits that tell one set from another: each of its size and a sum of its hashes."""
    sums = np.zeros(2, np.uint64)
    for at in range(0, len(shingles), PART):
        part = shingles[at : at + PART]
        sums += np.array([part.sum(dtype=np.uint64), mixed(part ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    one, two = mixed(sums + np.uint64(len(shingles))).view(np.int64).tolist()
    return one, two


def told_apart(df: DataFrame, shared: list[int]) -> DataFrame:
    """df, whose classes in shared are numbers that different sets have, with a class of its own for each of their sets."""
    return df.withColumn("class", F.when(F.col("class").isin(shared), F.xxhash64("class", "check")).otherwise(F.col("class"))) if shared else df


def with_sets(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """class, check and shingles (array<long>) of every document with words."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in slices(whole, 0, SPAN):
                sets = [s for s in shingle_sets(batch.column(0).to_pylist(), size, known) if len(s)]
                names = [class_of(s) for s in sets]
                one, two = (pa.array([n[k] for n in names], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([one, two, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "check", "shingles"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(sets_of, "class long, check long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b), which are a written table: least labels, with pointer jumping."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("x")).first()["x"]
    while total is not None:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"))
        up = new.select(F.col("node").alias("up"), F.col("component").alias("top"))
        labels = written(new.join(up, F.col("component") == F.col("up")).select("node", F.col("top").alias("component")))
        last, total = total, labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("x")).first()["x"]
        if total == last:  # labels only ever fall
            break
    return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component), with the further edges (a, b): components that these join become one, and nodes that had no edge come in."""
    ends = edges
    for end in "ab":
        of = labels.select(F.col("node").alias(f"node_{end}"), F.col("component").alias(f"component_{end}"))
        ends = ends.join(of, F.col(end) == F.col(f"node_{end}"), "left").withColumn(end, F.coalesce(f"component_{end}", end)).select("a", "b")
    tops = components(written(ends.filter("a <> b").distinct())).select(F.col("node").alias("was"), F.col("component").alias("top"))
    moved = labels.join(tops, F.col("component") == F.col("was"), "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(moved.union(tops.join(labels, F.col("was") == F.col("node"), "left_anti").select("was", "top")))


def likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """a, b and alike (share of equal signature values) of the pairs where that is at least `least`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1)) for k in (2, 3))
            alike = (one == two).mean(axis=1)
            fine = np.nonzero(alike >= least)[0]
            a, b = (batch.column(k).take(pa.array(fine)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(alike[fine], pa.float64())], names=["a", "b", "alike"])

    one, two = (sigs.select(F.col("class").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a long, b long, alike double")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one, two = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.select("a", "b").join(one, "a").join(two, "b").filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def partners(buckets: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, least: float, block: int, span: int = UNIT) -> DataFrame:
    """a, b: links between members of a bucket that are in different components, as many as connect all those that are linked there.

    classes: class, sig, keys and shingles. Members outside of a bucket's largest component are compared with all of its
    members, in blocks of `block` members and `span` bytes of shingles, about. Signatures and sizes leave pairs out, full
    sets confirm the others, and what a link has joined is not compared again: a block tells no more links than it has members.
    """
    named = buckets.join(labels, buckets["class"] == labels["node"], "left").select("key", "class", F.coalesce("component", "class").alias("component"))
    named = named.join(classes.select(F.col("class").alias("of"), F.size("shingles").cast("long").alias("n_shingles")), F.col("class") == F.col("of")).drop("of")
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).groupBy("key")
    parts = parts.agg(F.max_by(F.struct("component", "n", "shingles"), F.struct("n", "component")).alias("main"), F.sum("n").alias("members"), F.sum("shingles").alias("total"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n, shingles: F.greatest(F.ceil(n / block), F.ceil(8 * shingles / span)).cast("int")
    parts = parts.select("key", F.col("main.component").alias("main"), blocks(F.col("members"), F.col("total")).alias("columns"), blocks(F.col("members") - F.col("main.n"), F.col("total") - F.col("main.shingles")).alias("rows"))
    members = named.join(parts, "key").join(classes, "class")
    mine = lambda n: F.pmod(F.xxhash64("class", "key"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    carries = ("class", "component", "sig", "keys", "shingles")
    asked = members.select("key", each(F.col("rows")).alias("y"), mine(F.col("columns")).alias("x"), F.lit(False).alias("asks"), *carries)
    asking = members.filter("component <> main").select("key", mine(F.col("rows")).alias("y"), each(F.col("columns")).alias("x"), F.lit(True).alias("asks"), *carries)

    def compare(group: pa.Table) -> pa.Table:
        asks, classes, parts = (group[c].to_numpy(zero_copy_only=False) for c in ("asks", "class", "component"))
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(group.num_rows, -1)
        keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        lists = group["shingles"].combine_chunks()
        values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        starts, sizes = np.concatenate([[0], ends[:-1]]), lists.value_lengths().to_numpy().astype(np.int64)
        parts = np.unique(parts, return_inverse=True)[1]
        there, here = np.nonzero(~asks)[0], group["key"][0].as_py()
        a, b = [], []
        for k in np.nonzero(asks)[0]:
            others = there[parts[there] != parts[k]]
            others = others[100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k])]
            others = others[keys[k, (keys[others] == keys[k]).argmax(axis=1)] == here]  # a pair counts in its first common bucket
            others = others[(sig[others] == sig[k]).mean(axis=1) >= least]
            own = np.sort(values[starts[k] : ends[k]])
            for at in range(0, len(others), TRIED):
                some = others[at : at + TRIED]
                some = some[parts[some] != parts[k]]
                if not len(some):
                    continue
                theirs = np.concatenate([values[starts[o] : ends[o]] for o in some])
                found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
                for o in some[100 * both >= percent * (sizes[some] + sizes[k] - both)]:
                    if parts[o] != parts[k]:
                        a.append(min(classes[k], classes[o]))
                        b.append(max(classes[k], classes[o]))
                        parts[parts == parts[o]] = parts[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return asked.union(asking).groupBy("key", "y", "x").applyInArrow(compare, "a long, b long")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """row, n_shingles, component_id (the smallest id reachable by links) and kept (whether that is the row's) of every document."""
    names = list(dict.fromkeys([*(keep or docs.columns), id_col]))
    base = written(signed(docs, text_col, names, size, bands, rows).withColumn("id", F.col(f"row.`{id_col}`")))
    least = percent / 100 - DEVIATIONS * math.sqrt(percent / 100 * (1 - percent / 100) / (bands * rows))

    def classes(of: DataFrame) -> DataFrame:
        first = [F.first(c).alias(c) for c in ("sig", "keys")]
        return written(of.filter("class is not null").groupBy("class").agg(*first, F.min("id").alias("id"), F.min("check").alias("check"), F.max("check").alias("other")))

    sigs = classes(base)
    shared = [r["class"] for r in sigs.filter("check <> other").select("class").collect()]  # 64 bits that two sets share: none but by chance
    if shared:
        base = told_apart(base, shared)
        sigs = classes(base)
    buckets = sigs.select("class", F.explode("keys").alias("key"))
    pivots = buckets.groupBy("key").agg(F.min("class").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    buckets = written(buckets.join(pivots, "key").select("key", "class", "pivot"))
    signs = sigs.select("class", "sig")
    pairs = buckets.filter("class <> pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    pairs = written(likely(pairs, signs, least))

    # the sets of all classes that may be compared, once
    need = buckets.select("class").distinct().join(sigs.select("class", "id"), "class").select(F.col("id").alias("needed")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(need, F.col("id").eqNullSafe(F.col("needed")), "left_semi")
    sets = told_apart(with_sets(texts, "text", size), shared).groupBy("class").agg(F.first("shingles").alias("shingles"))
    sets = written(sets.join(buckets.select("class").distinct(), "class", "left_semi"))

    best = Window.partitionBy("b").orderBy(F.desc("alike"), "a")
    judged = pairs.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("a", "b")
    links = written(confirmed(judged, sets, percent))
    labels = components(links)
    more = written(partners(buckets.select("key", "class"), labels, sigs.select("class", "sig", "keys").join(sets, "class"), percent, least, block).distinct())
    if not more.isEmpty():
        labels = joined(labels, more)

    ids = sigs.select("class", "id").join(labels, F.col("class") == F.col("node"), "left").select("class", "id", F.coalesce("component", "class").alias("component"))
    first = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = ids.join(first, "component").select(F.col("class").alias("of"), "component_id")
    out = base.join(of_class, F.col("class") == F.col("of"), "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select("row", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The documents that linked() keeps, with the columns they came with."""
    kept = linked(docs, id_col, text_col, keep=[id_col], **how).filter("kept").select(F.col(f"row.`{id_col}`").alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
