"""Substring dedup: words covered by long windows that also start in an earlier document.

What begins at a word of a text is a suffix. In the suffix tree over all suffixes, an inner node of a depth of `window`
words or more is a repeat: all suffixes below it begin with the same window. The tree is never built as a whole:

1. Anchors. Of the 6-grams in a window (`anchor` words) the one with the least hash is its anchor, so equal windows
   have equal anchors at the same place. Anchors are a fifth of all places; only they are shuffled, and those found in
   one document alone rule out their windows.
2. Prefixes. Suffixes are grouped by how their anchors begin. An anchor's code holds hashes of its first 1, 2, 4 and 6
   words, so shared anchors are counted by all their prefixes at once; a prefix with more than a quarter of `capacity`
   is split by the next longer one. Suffixes of anchors that are too many as a whole are grouped by their whole
   windows, of which a task sends one to a group unless a smaller id comes later. The number of groups comes from the
   number of suffixes and `capacity`, so a group fits in memory whatever words, lines or passages are hot.
3. Subtrees. What a group gets are runs of suffixes with a common anchor, with their words' codes. It sorts all
   suffixes by their words and finds the common-prefix lengths of neighbours: those of at least `window` words are
   below one deep inner node. All of a node's suffixes but those of its smallest document are repeats; those that follow
   one another in a run make up its maximal repeats, as spans.
4. The spans found, joined to their documents, give the words to remove.

Within a block of documents (BLOCK words, or one longer document) equal runs are reduced to that of the block's smallest
document before they are shuffled. Words are compared by 32 bits of their hashes and windows by 32 further ones.

Cases: null and empty texts have no words. Rows without an id neither lose words nor make others lose any. Of rows with
one id none is earlier. Texts shorter than a window stay. Further columns of any name pass through in row; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, carried, mapped, mixed, odd_numbers, regrouped, shuffle_partitions, written

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 13, 6
#: Prefixes of an anchor: their words (None: all), and how many of the code's 64 bits come after their own.
PREFIXES = ((1, 48), (2, 36), (4, 24), (None, 0))
#: Anchors of a group, about; of one prefix a quarter of it at most.
CAPACITY = 1 << 16
#: Prefixes that are too large are told to all tasks; as many of a length at most, as the capacity grows beyond that.
SPLIT = 1 << 18
#: Words of a block, about.
BLOCK = 1 << 19
#: Anchors that one task compares, about, and bytes of text for each.
BUCKET, ANCHOR_BYTES = 1 << 20, 27
#: Windows of hot anchors that a task remembers to have sent.
KEPT_WINDOWS = 1 << 18
#: Kinds of rows: 0 what is dealt to groups, 1 what is found, 2 numbers of anchors, 3 the documents of a block, 4 runs of a block that share what is found of another one.
FIELDS = [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("one", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("words", pa.binary()), ("signs", pa.binary())]
PARTS = "kind int, bucket int, block long, at array<int>, n array<int>, one array<long>, ids array<long>, words binary, signs binary"


def hashed(codes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of the size words from each place on, as far as there are so many."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k, w in enumerate(odd_numbers(seed, size)):
        out += codes[k : k + n] * w
    return mixed(out)


class Block:
    """Some documents as one array of word hashes."""

    def __init__(self, texts: list[bytes | None], known: WordHashes, window: int, keep_words: bool = False) -> None:
        self.words, codes = [], []
        for t in texts:
            words = (t or b"").split()
            codes.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
            if keep_words:
                self.words.append(words)
        self.lengths = np.array([len(c) for c in codes], dtype=np.int64)
        self.codes = np.concatenate([np.zeros(0, np.uint64), *codes])
        del codes
        self.firsts = np.cumsum(self.lengths) - self.lengths
        starts = np.maximum(self.lengths - window + 1, 0)  # whole windows of each document
        self.starts = np.arange(starts.sum()) + np.repeat(self.firsts - (np.cumsum(starts) - starts), starts)
        self.window = window

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, at, side="right") - 1 if len(at) else at

    def codes_of(self, anchor: int) -> np.ndarray:
        """The code of the anchor at each place, as far as there are so many words: hashes of its prefixes, the shortest in the highest bits."""
        n, out, before = max(0, len(self.codes) - anchor + 1), np.uint64(0), 64
        for k, (words, after) in enumerate(PREFIXES):
            part = hashed(self.codes, min(words or anchor, anchor), 3 + k)[:n] >> np.uint64(64 - before + after)
            out, before = out | (part << np.uint64(after)), after
        return out

    def anchors_of(self, codes: np.ndarray, anchor: int) -> np.ndarray:
        """The place of each window's anchor: the first of those with the least hash."""
        order = mixed(codes)
        least, place = order[self.starts], self.starts.copy()
        for k in range(1, self.window - anchor + 1):
            here = order[self.starts + k]
            less = here < least
            least[less], place[less] = here[less], self.starts[less] + k
        return place

    def same_in_doc(self, values: np.ndarray, at: np.ndarray, chosen: np.ndarray, chosen_at: np.ndarray) -> np.ndarray:
        """Which values are among the chosen of their own document."""
        salt = mixed(np.arange(len(self.lengths) + 1, dtype=np.uint64) + np.uint64(11))
        return np.isin(values ^ salt[self.doc(at)], chosen ^ salt[self.doc(chosen_at)])


def blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to blocks of about BLOCK words (seven bytes each)."""
    return regrouped(batches, text, 7 * BLOCK)


def unrepeated(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The first row of each id and hash (columns 0 and 1)."""
    ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    order = np.lexsort((np.arange(len(ids)), hashes, ids))
    new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])
    return batch if new.all() else batch.take(pa.array(np.sort(order[new])))


def rows_of(rows: list[dict]) -> pa.RecordBatch:
    def column(name: str, kind: pa.DataType) -> pa.Array:
        values = [r.get(name) for r in rows]
        if pa.types.is_list(kind):
            values = [v if v is None else np.asarray(v).astype(kind.value_type.to_pandas_dtype()) for v in values]
        return pa.array(values, kind)

    return pa.RecordBatch.from_arrays([column(*f) for f in FIELDS], names=[n for n, _ in FIELDS])


def runs_of_equal(values: np.ndarray) -> list[np.ndarray]:
    """Places of equal values, by value."""
    order = np.argsort(values, kind="stable")
    return [p for p in np.split(order, np.nonzero(np.diff(values[order]))[0] + 1) if len(p)]


def head(batch: pa.RecordBatch, b: Block, buckets: int) -> dict:
    """The row of a block's documents: their ids, hashes and numbers of words."""
    ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    name = int(np.uint64(xxhash.xxh3_64_intdigest(ids.tobytes() + hashes.tobytes())).view(np.int64))
    return {"kind": 3, "bucket": name % buckets, "block": name, "n": b.lengths, "one": hashes, "ids": ids}


def anchors_dealt(docs: DataFrame, window: int, anchor: int, buckets: int) -> DataFrame:
    """Anchors of each block by bucket: a code once, with its place, or less than 0 their number where several documents have it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in map(unrepeated, blocks(batches, 2)):
            b = Block(batch.column(2).to_pylist(), known, window)
            about = head(batch, b, buckets)
            rows = [about]
            if len(b.starts):
                codes = b.codes_of(anchor)
                at = np.unique(b.anchors_of(codes, anchor))
                order = np.lexsort((at, codes[at]))
                at, codes = at[order], codes[at][order]
                doc = b.doc(at)
                first = np.concatenate([[True], codes[1:] != codes[:-1]])
                group = np.cumsum(first) - 1
                last = np.concatenate([first[1:], [True]])
                several = doc[first] != doc[last]
                own = first | (doc != np.concatenate([[-1], doc[:-1]]))  # the first place of each document in a group
                rows.append({"kind": 1, "bucket": about["bucket"], "block": about["block"], "at": at[own & several[group]]})
                place = np.where(several, -np.bincount(group), at[first])
                codes = codes[first]
                for part in runs_of_equal((mixed(codes) % np.uint64(buckets)).astype(np.int64)):
                    rows.append({"kind": 0, "bucket": int(mixed(codes[part[:1]])[0] % np.uint64(buckets)), "block": about["block"], "at": place[part], "one": codes[part].view(np.int64)})
            yield rows_of(rows)

    return docs.mapInArrow(deal, PARTS)


def flat(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy()


def apart(group: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """The rows of kind 0, the others, and for each entry of the former's lists the number of its row."""
    kinds = group["kind"].to_numpy()
    parts = group.filter(pa.array(kinds == 0))
    whose = np.repeat(np.arange(parts.num_rows), np.diff(parts["at"].combine_chunks().offsets.to_numpy())) if parts.num_rows else np.zeros(0, np.int64)
    return parts, group.filter(pa.array(kinds != 0)), whose


def answered(parts: pa.Table, rest: pa.Table, whose: np.ndarray, rows: list[dict], **found: np.ndarray) -> pa.Table:
    """rest, rows, and rows of kind 1 of what was found for each block. whose: ascending rows of parts."""
    names = parts["block"].to_numpy()
    for mine in np.split(np.arange(len(whose)), np.nonzero(np.diff(whose))[0] + 1):
        if len(mine):
            rows.append({"kind": 1, "bucket": 0, "block": int(names[whose[mine[0]]])} | {k: v[mine] for k, v in found.items()})
    return pa.concat_tables([rest, pa.Table.from_batches([rows_of(rows)]).cast(rest.schema)])


def shared_anchors(group: pa.Table) -> pa.Table:
    """The places of anchors that more than one block has, and the numbers of all shared ones; other kinds as they are."""
    parts, rest, whose = apart(group)
    if not parts.num_rows:
        return rest
    codes, at = flat(parts, "one"), flat(parts, "at")
    order = np.argsort(codes, kind="stable")
    new = np.concatenate([[True], np.diff(codes[order]) != 0])
    which = np.cumsum(new) - 1
    several = np.bincount(which) > 1
    counts = np.bincount(which, np.maximum(1, -at[order].astype(np.int64))).astype(np.int64)
    shared = several | (counts > 1)
    hit = np.zeros(len(codes), bool)
    hit[order] = several[which]
    hit &= at >= 0
    rows = [{"kind": 2, "bucket": 0, "one": codes[order][new][shared], "ids": counts[shared]}]
    return answered(parts, rest, whose[hit], rows, at=at[hit])


def group_of(codes: np.ndarray, split: list[np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of anchors by their shortest prefix that is not split, and which have none."""
    out, hot = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    for k, (_, after) in enumerate(PREFIXES):
        prefix = codes >> np.uint64(after)
        fits = hot & ~np.isin(prefix, split[k])
        out[fits] = (mixed(prefix[fits] * np.uint64(4) + np.uint64(k)) % np.uint64(groups)).astype(np.int64)
        hot &= ~fits
    return out, hot


def suffixes_dealt(docs: DataFrame, window: int, anchor: int, groups: int, split: list[np.ndarray]) -> DataFrame:
    """Runs of suffixes whose anchor is shared, by group, with the words they consist of."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = WordHashes(), {}
        for batch in map(unrepeated, blocks(batches, 2)):
            ids = batch.column(0).to_numpy()
            b = Block(batch.column(2).to_pylist(), known, window)
            about = head(batch, b, groups)
            row = {"bucket": about["bucket"], "block": about["block"]}
            rows, places = [about], batch.column(3)
            at = b.firsts[np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))] + places.flatten().to_numpy()
            if len(b.starts):
                codes = b.codes_of(anchor)
                place = b.anchors_of(codes, anchor)
                near = b.same_in_doc(codes[place], place, codes[at], at)
                start, place = b.starts[near], place[near]
                new = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1])]) if len(start) else np.zeros(0, bool)
                first, n = start[new], np.diff(np.append(np.nonzero(new)[0], len(start)))
                group, hot = group_of(codes[place[new]], split, groups)
                names, signs = hashed(b.codes, window, 7), hashed(b.codes, window, 9)
                alone = start[np.repeat(hot, n)]
                hot_group = (names[alone] % np.uint64(groups)).astype(np.int64)
                first, n, group = np.concatenate([first[~hot], alone]), np.concatenate([n[~hot], np.ones(len(alone), n.dtype)]), np.concatenate([group[~hot], hot_group])
                hot = np.arange(len(first)) >= len(first) - len(alone)
                # equal runs of the block: those of larger ids than the least are repeats, of the others one is sent
                one, two = names[first], signs[first + n - 1] + n.astype(np.uint64)
                id_ = ids[b.doc(first)]
                order = np.lexsort((first, id_, two, one))
                one, two, id_, first, n, group, hot = (x[order] for x in (one, two, id_, first, n, group, hot))
                node = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(first) else np.zeros(0, bool)
                which = np.cumsum(node) - 1
                known_before = np.zeros(len(node), bool)
                for k in np.nonzero(hot & node)[0].tolist():
                    key, mine = (int(one[k]), int(two[k])), int(id_[k])
                    known_before[which[k]] = sent.get(key, mine) < mine
                    if key in sent or len(sent) < KEPT_WINDOWS:
                        sent[key] = min(mine, sent.get(key, mine))
                sure = (id_ > id_[node][which]) | known_before[which]
                same = ~node & ~sure  # what is found of the one that is sent holds for these
                rows.append(row | {"kind": 1, "at": first[sure], "n": n[sure]})
                if same.any():
                    rows.append(row | {"kind": 4, "at": first[same], "n": n[same], "one": first[node][which[same]]})
                send = np.nonzero(node & ~sure)[0]
                first, n, group = first[send], n[send], group[send]
                for part in runs_of_equal(group):
                    m = n[part]
                    suffix = np.repeat(first[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    m += window - 1
                    word = np.repeat(first[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    low = (b.codes[word] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                    rows.append({"kind": 0, "bucket": int(group[part[0]]), "block": about["block"], "at": first[part], "n": n[part], "ids": ids[b.doc(first[part])], "words": low, "signs": (signs[suffix] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()})
            yield rows_of(rows)

    return docs.mapInArrow(deal, PARTS)


def deep_repeats(words: np.ndarray, signs: np.ndarray, n: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes (n for each run) are below an inner node of the window's depth whose smallest id is less than their own."""
    run = np.repeat(np.arange(len(n)), n)
    size = n + window - 1
    at = np.repeat((np.cumsum(size) - size) - (np.cumsum(n) - n), n) + np.arange(len(run))  # where each suffix begins among the words
    keys = np.empty((len(run), window // 2 + 1), np.uint64)
    for k in range(keys.shape[1]):
        high = words[at + 2 * k] if 2 * k < window else np.zeros(len(run), np.uint32)
        low = words[at + 2 * k + 1] if 2 * k + 1 < window else signs
        keys[:, k] = high.astype(np.uint64) << np.uint64(32) | low
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    # common prefixes of neighbours, in pairs of words: a suffix that shares all of them with the one before is below its node
    common = np.where((same := keys[1:] == keys[:-1]).all(axis=1), keys.shape[1], same.argmin(axis=1))
    node = np.concatenate([[True], common < keys.shape[1]])
    own = ids[run[order]]
    least = np.minimum.reduceat(own, np.nonzero(node)[0])
    out = np.zeros(len(run), bool)
    out[order] = own > least[np.cumsum(node) - 1]
    return out


def repeats_of(window: int):
    """The maximal repeats of a group's runs, but for each node's smallest document; other kinds as they are."""

    def found(group: pa.Table) -> pa.Table:
        parts, rest, whose = apart(group)
        if not parts.num_rows:
            return rest
        at, n, ids = (flat(parts, c) for c in ("at", "n", "ids"))
        words, signs = (np.frombuffer(b"".join(parts[c].to_pylist()), np.uint32) for c in ("words", "signs"))
        n = n.astype(np.int64)
        hit = deep_repeats(words, signs, n, ids, window)
        run = np.repeat(np.arange(len(n)), n)
        begins = hit & np.concatenate([[True], ~hit[:-1] | (run[1:] != run[:-1])])
        first = np.nonzero(begins)[0]
        length = np.bincount(np.cumsum(begins)[hit] - 1, minlength=len(first))
        start = at[run[first]] + (first - (np.cumsum(n) - n)[run[first]])
        return answered(parts, rest, whose[run[first]], [], at=start, n=length)

    return found


def of_block(group: pa.Table) -> pa.Table:
    """id, hash, places and lengths of each document of a block in which something was found, from its rows of the kinds 1, 3 and 4."""
    by_kind = {k: group.filter(pa.array(group["kind"].to_numpy() == k)) for k in (1, 3, 4)}
    docs = by_kind[3].slice(0, 1)  # blocks of the same documents have the same rows
    ids, hashes, lengths = (flat(docs, c) for c in ("ids", "one", "n"))
    at = flat(by_kind[1], "at").astype(np.int64)
    n = flat(by_kind[1], "n").astype(np.int64)
    n = n if len(n) else np.ones(len(at), np.int64)
    if by_kind[4].num_rows:
        to, size, of = (flat(by_kind[4], c).astype(np.int64) for c in ("at", "n", "one"))
        order = np.argsort(of, kind="stable")
        to, size, of = to[order], size[order], of[order]
        heads, counts = np.unique(of, return_counts=True)
        widths = size[np.searchsorted(of, heads)]
        k = np.searchsorted(heads, at, side="right") - 1
        mine = np.nonzero((k >= 0) & (at < (heads + widths)[np.maximum(k, 0)]))[0] if len(at) else at
        extra = [(to[np.searchsorted(of, heads[k[m]]) + i] + at[m] - heads[k[m]], n[m]) for m in mine.tolist() for i in range(counts[k[m]])]
        at, n = np.concatenate([at, np.array([x for x, _ in extra], np.int64)]), np.concatenate([n, np.array([x for _, x in extra], np.int64)])
    firsts = np.cumsum(lengths) - lengths
    doc = np.searchsorted(firsts, at, side="right") - 1 if len(at) else at
    order = np.lexsort((at, doc))
    at, n, doc = at[order], n[order], doc[order]
    has = np.unique(doc)
    offsets = pa.array(np.append(np.searchsorted(doc, has), len(doc)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (at - firsts[doc], n)]
    return pa.table({"id": pa.array(ids[has], pa.int64()), "hash": pa.array(hashes[has], pa.int64()), "places": lists[0], "sizes": lists[1]})


def places_of(found: DataFrame) -> DataFrame:
    """id, hash, places and sizes of each document in which something was found; rows repeated with their id have the same ones."""
    each = found.filter("kind in (1, 3, 4)").groupBy("block").applyInArrow(of_block, "id long, hash long, places array<int>, sizes array<int>")
    return each.groupBy("id", "hash").agg(F.first(F.struct("places", "sizes")).alias("x")).select("id", "hash", "x.*")


def too_large(found: DataFrame, capacity: int) -> tuple[int, list[np.ndarray]]:
    """The number of groups, and the prefixes of each length that are split."""
    counts = found.filter("kind = 2").select(F.explode(F.arrays_zip("one", "ids")).alias("x")).select(F.col("x.one").alias("code"), F.col("x.ids").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    most = max(1, capacity // 4, total // SPLIT)
    prefixes = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("code", after).alias("prefix")) for k, (_, after) in enumerate(PREFIXES)))).alias("p")
    large = counts.select(prefixes, "n").groupBy("p.k", "p.prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("k", "prefix").collect()  # SPLIT of each length at most
    split = [np.sort(np.array([r["prefix"] for r in large if r["k"] == k], np.int64).view(np.uint64)) for k in range(len(PREFIXES))]
    return 2 * total // max(1, capacity) + 1, split


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR, capacity: int = CAPACITY, verbatim: bool = False) -> DataFrame:
    """row, n_words, n_removed, kept_text (words left, joined by a space) and removed (spans of words, end not included) of every document.

    verbatim: a text that loses nothing is kept as it is, with all its white space.
    """
    parts = shuffle_partitions(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    able = keyed.filter("id is not null and text is not null")
    size = able.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(2 * parts, size // (BUCKET * ANCHOR_BYTES) + 1)
    found = written(anchors_dealt(able, window, anchor, buckets).groupBy("bucket").applyInArrow(shared_anchors, PARTS))
    groups, split = too_large(found, capacity)
    hits = places_of(found).drop("sizes")
    near = able.join(hits, ["id", "hash"]).select("id", "hash", "text", "places")
    repeats = written(suffixes_dealt(near, window, anchor, max(2 * parts, groups), split).groupBy("bucket").applyInArrow(repeats_of(window), PARTS))
    starts = places_of(repeats).select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "places", "sizes")
    rows = carried(docs, keep, id=F.col(id_col).cast("long"), hash=F.xxhash64(text_col), text=F.col(text_col).cast("binary"))
    rows = rows.join(starts, (F.col("id") == F.col("of")) & (F.col("hash") == F.col("of_hash")), "left").select("row", "text", "places", "sizes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in blocks(iter([whole]), 1):
                texts = batch.column(1)
                has = np.nonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))[0]
                b = Block([texts[k].as_py() for k in has], known, window, keep_words=True)
                places, sizes = (batch.column(c).take(pa.array(has)) for c in (2, 3))
                at, n = b.firsts[np.repeat(np.arange(len(has)), np.diff(places.offsets.to_numpy()))] + places.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64)
                at = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                gone = np.zeros(len(b.codes) + 1, np.int64)
                if len(at):
                    names = hashed(b.codes, window, 7)
                    start = b.starts[b.same_in_doc(names[b.starts], b.starts, names[at], at)]
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                n, removed, left, spans = [], [], [], []
                nth = dict(zip(has.tolist(), range(len(has)), strict=True))
                for k in range(batch.num_rows):
                    if (j := nth.get(k)) is None:
                        words = (texts[k].as_py() or b"").split()
                        n.append(len(words))
                        removed.append(0)
                        left.append((texts[k].as_py() or b"") if verbatim else b" ".join(words))
                        spans.append([])
                        continue
                    words, out = b.words[j], gone[b.firsts[j] : b.firsts[j] + b.lengths[j]]
                    n.append(len(words))
                    removed.append(int(out.sum()))
                    left.append(texts[k].as_py() if verbatim and not out.any() else b" ".join([words[i] for i in np.nonzero(~out)[0]]))
                    edges = np.nonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))[0].reshape(-1, 2)
                    spans.append([{"start": a, "end": z} for a, z in edges.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["row", "n_words", "n_removed", "kept_text", "removed"],
                )

    return mapped(rows, cut, "n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")
