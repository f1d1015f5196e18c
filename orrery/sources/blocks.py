"""One JSON file read by many tasks: a speculative scan of blocks, whose starts are found by prefix sums.

What a byte of JSON means depends on all bytes before it: whether it is in a string, and how deep in brackets. A block
is scanned without that knowledge, for both cases: its number of quotes (which switch strings on and off) and the
change of depth if it begins outside or inside a string. Numbers of quotes add up, and so do the changes of depth once
it is known which of the two holds, so two prefix sums over the blocks tell where each of them begins. Blocks end
where no escape is pending.

Then every block knows the structure of its own bytes. What stands outside of the values of depth two (the skeleton:
keys, brackets and plain values of the top level) is gathered and parsed as it is; all else is cut at commas of depth
two into pieces, elements of lists or members of objects. Pieces that end in a later block are put together by their
number, which is a prefix sum too: the commas before them. Each piece is parsed by itself, so all of the file is
checked, and no task holds more than a block and one element.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from orrery.errors import ManifestError
from orrery.shared import ship, written

#: Bytes of a block, about.
BLOCK = 1 << 20
#: Blocks whose starts are broadcast at most; more are joined by a shuffle.
STARTS = 1 << 18
#: Bytes of a skeleton at most: it is parsed as a whole.
SKELETON = 1 << 26
INVALID, SHAPE, TWICE = "Manifest is not valid JSON", "Manifest must be an object with a list 'images'", "Manifest has more than one list 'images'"

#: The change of depth by each byte outside of strings.
STEP = np.zeros(256, np.int8)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1


def no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def parsed_json(text: str, **how: object) -> object:
    """A JSON value; numbers with a point or exponent are no ids, whatever their value."""
    return json.loads(text, parse_constant=no_constant, parse_float=lambda _: 0.5, **how)


def structure(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, whether each is in a string), for a block that begins outside of one; the quote that ends a string is outside of it."""
    b = np.frombuffer(block, np.uint8)
    quote, slash = b == ord('"'), b == ord("\\")
    if slash.any():
        place = np.arange(len(b))
        last = np.maximum.accumulate(np.where(slash, -1, place))  # the last byte that is no backslash
        escaped = np.zeros(len(b), bool)
        escaped[1:] = (place[:-1] - last[:-1]) % 2 == 1
        quote &= ~escaped
    return b, np.cumsum(quote) % 2 == 1


def speculated(block: bytes) -> tuple[int, int, int]:
    """(quotes, change of depth if the block begins outside of a string, and if inside of one)."""
    b, inside = structure(block)
    step = STEP[b]
    quotes = np.count_nonzero(np.diff(inside, prepend=False))
    return int(quotes), int(step[~inside].sum(dtype=np.int64)), int(step[inside].sum(dtype=np.int64))


@dataclass(frozen=True)
class Block:
    """A block whose start is known: its bytes, the depth after each, and the places of its marks.

    Marks are what pieces end and begin at: brackets between depths one and two, and commas of depth two.
    """

    text: bytes
    depth: np.ndarray
    opening: np.ndarray
    comma: np.ndarray
    mark: np.ndarray

    @classmethod
    def at(cls, text: bytes, inside: bool, depth: int) -> Block:
        b, string = structure(text)
        step = np.where(string == inside, STEP[b], 0)
        after = depth + np.cumsum(step, dtype=np.int64)
        opening = (step == 1) & (after == 2)
        comma = (b == ord(",")) & (string == inside) & (after == 2)
        return cls(text, after, opening, comma, np.nonzero(opening | comma | ((step == -1) & (after == 1)))[0])

    def skeleton(self) -> bytes:
        return np.frombuffer(self.text, np.uint8)[(self.depth <= 1) | self.opening].tobytes()

    def pieces(self, depth: int, openings: int, commas: int) -> Iterator[tuple[int, int, bool, bytes]]:
        """(container, number, whether it is whole, text with the marks around it) of each piece that the block has a part of.

        depth, openings and commas are those before the block. A container is the number of openings up to it, a
        piece's number that of commas up to its beginning.
        """
        marks = self.mark.tolist()
        if depth >= 2:
            yield openings, commas, False, self.text[: marks[0] + 1] if marks else self.text
        for at, upto in zip(marks, [*marks[1:], None], strict=False):
            openings += bool(self.opening[at])
            commas += bool(self.comma[at])
            if self.depth[at] == 2:
                yield openings, commas, upto is not None, self.text[at : upto + 1 if upto is not None else None]


def content_of(piece: bytes, is_list: bool) -> tuple[object, ...]:
    """(the value,) of an element of a list, () of an empty list or object; an error if it is no JSON. Members of objects are only checked."""
    text = piece[1:-1].decode()
    if not text.strip(" \t\r\n"):
        if piece[:1] in b"[{" and piece[-1:] in b"]}":
            return ()
        raise ValueError("a value is missing")
    if is_list:
        return (parsed_json(text),)
    if len(parsed_json("{" + text + "}", object_pairs_hook=list)) != 1:
        raise ValueError("a member is missing")
    return ()


def record_of(value: object) -> str:
    """An object's id and file_name as JSON; other values become 0."""
    out = json.dumps({k: value[k] for k in ("id", "file_name") if k in value} if isinstance(value, dict) else 0, ensure_ascii=False)
    out.encode()  # an error where it has halves of characters
    return out


def containers_of(skeleton: bytes) -> tuple[list[bool], int]:
    """(whether each container is a list, the number of the one that is the list `images`, from 1); an error if the shape is another."""
    kinds: list[bool] = []
    lists: list[int] = []

    def listed(pairs: list[tuple[str, object]]) -> object:
        return ("object", pairs)

    try:
        value = parsed_json(skeleton.decode(), object_pairs_hook=listed)
    except (ValueError, RecursionError) as error:
        raise ManifestError(INVALID) from error
    if not (isinstance(value, tuple) and value[0] == "object"):
        raise ManifestError(SHAPE)
    found = False
    for key, item in value[1]:
        if isinstance(item, (list, tuple)):
            kinds.append(isinstance(item, list))
        if key == "images":
            found = isinstance(item, list)
            lists += [len(kinds)] * found
    if len(lists) > 1:
        raise ManifestError(TWICE)
    if not found:
        raise ManifestError(SHAPE)
    return kinds, lists[0]


def blocks_of(spark: SparkSession, file: str, size: int, block: int) -> tuple[DataFrame, int]:
    """The blocks of a file of `size` bytes, in order of start and k, with text and what is speculated of it, and their number."""
    columns = "start long, k long, text binary, quotes long, if_outside long, if_inside long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(start: int, k: int, held: list[bytes]) -> pa.RecordBatch:
            text = b"}".join([*held, b""])
            row = (start, k, text, *speculated(text))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3), strict=True)], names=["start", "k", "text", "quotes", "if_outside", "if_inside"])

        start, k, held, n = -1, 0, [], 0
        for batch in batches:
            for line, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (at != start or n >= block):
                    yield told(start, k, held)
                    held, n, k = [], 0, k + 1
                if at != start:
                    start, k = at, 0
                held.append(line)
                n += len(line) + 1
        if held:
            yield told(start, k, held)

    lines = spark.read.option("lineSep", "}").text(file).select(F.col("value").cast("binary"), F.col("_metadata.file_block_start").alias("start"))
    seen = Observation()
    found = written(lines.mapInArrow(cut, columns).observe(seen, F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes"), F.max(F.struct("start", "k")).alias("last")))
    # each line was given the brace that ends it, but the last one may have none; a byte order mark is not in the text
    if seen.get["n"] and seen.get["bytes"] - size in (1, -2):
        is_last = (F.col("start") == seen.get["last"]["start"]) & (F.col("k") == seen.get["last"]["k"])
        found = found.withColumn("text", F.when(is_last, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")))
    return found, seen.get["n"]


def with_sums_before(blocks: DataFrame, **values: object) -> DataFrame:
    """blocks (start, k) with the sum of each value over the blocks before: sums of each file part first, then inside of it."""
    names = list(values)
    some = blocks.withColumns({f"of_{n}": v for n, v in values.items()})
    parts = some.groupBy(F.col("start").alias("part")).agg(*(F.sum(f"of_{n}").alias(n) for n in names))  # a row for each of Spark's parts of the file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"part_{n}") for n in names))
    inner = Window.partitionBy("start").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    out = some.join(parts, F.col("start") == F.col("part"))
    return out.select(*blocks.columns, *((F.col(f"part_{n}") + F.coalesce(F.sum(f"of_{n}").over(inner), F.lit(0))).alias(n) for n in names))


def joined(blocks: DataFrame, about: DataFrame, few: bool) -> DataFrame:
    names = [c for c in about.columns if c not in ("start", "k")]
    about = about.select(F.col("start").alias("of_start"), F.col("k").alias("of_k"), *names)
    both = blocks.join(F.broadcast(about) if few else about, (F.col("start") == F.col("of_start")) & (F.col("k") == F.col("of_k")))
    return both.select("start", "k", "text", *names)


def elements(spark: SparkSession, file: str, size: int, block: int = BLOCK) -> DataFrame:
    """pos and item (JSON of an object's id and file_name) of each element of a file's list `images`; an error if the file is no such JSON. size: the file's bytes."""
    ship(spark)
    blocks, n = blocks_of(spark, file, size, block)
    few = n <= STARTS
    about = with_sums_before(blocks.select("start", "k", "quotes", "if_outside", "if_inside"), switches=F.col("quotes"))
    about = about.withColumn("inside", F.col("switches") % 2 == 1)
    about = with_sums_before(about.select("start", "k", "inside", "if_outside", "if_inside"), depth=F.when(F.col("inside"), F.col("if_inside")).otherwise(F.col("if_outside")))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = Block.at(row["text"], row["inside"], row["depth"])
                out = {k: row[k] for k in ("start", "k", "inside", "depth")} | {"skeleton": known.skeleton(), "n_openings": int(known.opening.sum()), "n_commas": int(known.comma.sum())}
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("start", pa.int64()), ("k", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("skeleton", pa.binary()), ("n_openings", pa.int64()), ("n_commas", pa.int64())]))

    outlines = joined(blocks, about.select("start", "k", "inside", "depth"), few)
    seen = Observation()
    outlines = outlines.mapInArrow(outline, "start long, k long, inside boolean, depth long, skeleton binary, n_openings long, n_commas long")
    outlines = written(outlines.observe(seen, F.sum(F.length("skeleton")).alias("bytes")))
    if (seen.get["bytes"] or 0) > SKELETON:
        raise ManifestError(f"Manifest has more than {SKELETON} bytes outside of its lists")
    bones = outlines.filter(F.length("skeleton") > 0).select("start", "k", "skeleton").collect()
    kinds, images = containers_of(b"".join(r["skeleton"] for r in sorted(bones)))

    def judged(container: int, piece: bytes) -> tuple[str | None, str | None]:
        """(item, problem) of a piece that is whole."""
        try:
            value = content_of(piece, kinds[container - 1])
            return (record_of(value[0]) if container == images and value else None), None
        except (ValueError, RecursionError):
            return None, INVALID

    fields = pa.schema([("container", pa.int64()), ("number", pa.int64()), ("start", pa.int64()), ("k", pa.int64()), ("part", pa.binary()), ("item", pa.string()), ("problem", pa.string())])
    kept = "container long, number long, start long, k long, part binary, item string, problem string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known, out = Block.at(row["text"], row["inside"], row["depth"]), []
                for container, number, whole, text in known.pieces(row["depth"], row["openings"], row["commas"]):
                    item, problem = judged(container, text) if whole else (None, None)
                    if not whole or item is not None or problem:
                        out.append((container, number, row["start"], row["k"], None if whole else text, item, problem))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(fields)], schema=fields)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(c, b"".join(parts)) for c, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], names=["container", "number", "item", "problem"])

    counted = with_sums_before(outlines.select("start", "k", "inside", "depth", "n_openings", "n_commas"), openings=F.col("n_openings"), commas=F.col("n_commas"))
    found = written(joined(blocks, counted.select("start", "k", "inside", "depth", "openings", "commas"), few).mapInArrow(cut, kept))
    fragments = found.filter("part IS NOT NULL").groupBy("container", "number").agg(F.array_sort(F.collect_list(F.struct("start", "k", "part"))).alias("parts"))
    glued = fragments.select("container", "number", F.transform("parts", lambda x: x["part"]).alias("parts")).mapInArrow(whole, "container long, number long, item string, problem string")
    pieces = found.filter("part IS NULL").select("container", "number", "item", "problem").union(glued)
    seen = Observation()
    pieces = written(pieces.observe(seen, F.max("problem").alias("problem"), F.min(F.when(F.col("item").isNotNull(), F.col("number"))).alias("first")))
    if seen.get["problem"]:
        raise ManifestError(seen.get["problem"])
    return pieces.filter("item IS NOT NULL").select((F.col("number") - F.lit(seen.get["first"] or 0)).alias("pos"), "item")
