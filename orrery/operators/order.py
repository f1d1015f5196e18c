"""Whether two sets of records have the same ids and names at the same positions, and where they first differ.

Each row is hashed together with its position, and hashes are added up: the sum does not depend on the order in which
tasks see the rows, but on every position, id and name. So an aggregate of a row for each task tells whether all are
equal; no sort and no join. Two sums of 64-bit hashes each, for ids alone and with names, tell sets apart.

Where they differ is found by ranges: sums for FAN ranges of positions, then for the first range that differs again,
and so on: log(rows) / log(FAN) passes, each over what is left of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Ranges that a pass tells apart.
FAN = 1024


def sums() -> list[Column]:
    """Aggregates of rows with pos, image_id and file_name: n, and fingerprints of ids and of ids with names."""
    kinds = {"ids": ("pos", "image_id"), "names": ("pos", "image_id", "file_name")}
    total = lambda seed, columns: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    one = lambda columns: F.concat_ws(":", *(F.coalesce(total(seed, columns), F.lit(0).cast("decimal(38,0)")).cast("string") for seed in (1, 2)))
    return [F.count("*").alias("n"), *(one(columns).alias(name) for name, columns in kinds.items())]


def fingerprint(records: DataFrame) -> Row:
    """n, ids and names of all rows."""
    return records.agg(*sums()).first()


@dataclass(frozen=True)
class Difference:
    """The first position at which two sets of records differ, and what each has there: [(image_id, file_name)]."""

    pos: int
    expected: list[tuple]
    found: list[tuple]
    elsewhere: bool  # whether the expected id is at another position

    @property
    def kind(self) -> str:
        """repeated, missing, added, renamed, moved or other."""
        if len(self.found) > max(1, len(self.expected)):
            return "repeated"
        if not self.found:
            return "missing"
        if not self.expected:
            return "added"
        if self.expected[0][0] == self.found[0][0]:
            return "renamed"
        return "moved" if self.elsewhere else "other"

    def __str__(self) -> str:
        return f"at position {self.pos} is {self.found or 'nothing'}, expected was {self.expected or 'nothing'} ({self.kind})"


def first_difference(expected: DataFrame, found: DataFrame, fan: int = FAN) -> Difference | None:
    """The first difference in position, id or name; None if there is none. Positions are 0 or more."""
    ends = expected.select("pos").union(found.select("pos")).agg(F.max("pos").alias("last")).first()
    if ends["last"] is None:
        return None
    low, width = 0, 1
    while width <= ends["last"]:
        width *= fan
    while True:
        width = max(1, width // fan)
        ranges = []
        for side, rows in (("expected", expected), ("found", found)):
            some = rows.filter((F.col("pos") >= low) & (F.col("pos") < low + width * fan))
            by_range = some.groupBy(F.floor((F.col("pos") - low) / width).alias("range")).agg(*sums())
            ranges.append(by_range.select(F.col("range"), F.struct("n", "ids", "names").alias(side)))
        other = ranges[0].join(ranges[1], "range", "full_outer").filter(~F.col("expected").eqNullSafe(F.col("found")))  # of `fan` rows at most
        first = other.agg(F.min("range").alias("range")).first()["range"]
        if first is None:
            return None
        low += first * width
        if width == 1:
            break
    here = [[(r["image_id"], r["file_name"]) for r in rows.filter(F.col("pos") == low).orderBy("image_id", "file_name").limit(fan).collect()] for rows in (expected, found)]
    elsewhere = bool(here[0]) and not found.filter((F.col("image_id") == here[0][0][0]) & (F.col("pos") != low)).isEmpty()
    return Difference(low, here[0], here[1], elsewhere)
