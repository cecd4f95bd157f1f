"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """``covers`` lists inventory ids; ``sql`` is None where the operator has no plain-SQL form."""

    name: str
    covers: tuple[str, ...]
    build: Build
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(covers.split()), build, sql)
        return build

    return keep
