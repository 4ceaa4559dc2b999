"""Expressions on file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def top_directory(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def parent(path: Column, up: int) -> Column:
    """The path element ``up`` places before the last; null if there are fewer."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) > up, F.element_at(parts, -1 - up))


def extension(path: Column) -> Column:
    """The last suffix of the name with its dot, or an empty text."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def chunk_id(path: Column) -> Column:
    """What stands between the name's last underscore and the first dot after it."""
    return F.substring_index(F.substring_index(basename(path), "_", -1), ".", 1)


def flat_name(path: Column) -> Column:
    """A path as one file name: slashes doubled to underscores."""
    return F.replace(path, F.lit("/"), F.lit("__"))


def partition_value(path: Column, name: str) -> Column:
    """The value of ``name=value`` in a path; null if it is absent."""
    v = F.regexp_extract(path, rf"(?:^|/){name}=([^/]*)", 1)
    return F.when(v != "", v)


def step_number(path: Column) -> Column:
    """The number of a finished ``step_N`` folder; null for names such as ``step_10.tmp``."""
    v = F.regexp_extract(path, r"step_([0-9]+)(?:/|$)", 1)
    return F.when(v != "", v.cast("bigint"))
