"""Checks and composition of the names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a blank name may consist of.
BLANKS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Absolute under POSIX or Windows rules, or with ".." as a part under either.
UNSAFE = r"(?s)\A/|\A[\\/]{2}|\A.:[\\/]|(?:\A|[\\/]|\A[^\\/]:)\.\.(?:[\\/]|\z)"


def is_blank(name: Column) -> Column:
    return name.rlike(rf"\A[{BLANKS}]*\z")


def is_unsafe(name: Column) -> Column:
    return name.rlike(UNSAFE)


def joined(root: Column, name: Column) -> Column:
    """root / name, without doubled slashes, "." parts and a slash at the end."""
    path = F.concat(root, F.lit("/"), name)
    path = F.regexp_replace(path, r"/(?:\.?/)+", "/")
    return F.when(path.rlike(r"\A/\.?\z"), F.lit("/")).otherwise(F.regexp_replace(path, r"(?:/\.?)+\z", ""))
