"""What the script passes share: names, assignments, and how taint spreads along them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: rule, family, score, evidence
Found = Iterator[tuple[str, str, int, str]]
FINDING = "path string, rule string, family string, score int, evidence string"


@dataclass(frozen=True)
class Step:
    """Names that take a value, the names it is made of, and whether it holds request data itself."""

    targets: tuple[str, ...]
    uses: frozenset[str]
    sourced: bool = False
    clears: bool = False


def spread(steps: Iterable[Step], rounds: int = ROUNDS) -> set[str]:
    """Names that request data reaches: passes over the steps in order, at most `rounds` of them."""
    steps, tainted = list(steps), set()
    for _ in range(rounds):
        before = len(tainted)
        for s in steps:
            if s.sourced or s.uses & tainted:
                tainted.update(s.targets)
        if len(tainted) == before:
            break
    return tainted


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def pattern(text: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile(text, flags | re.ASCII)


def over_limit(files: DataFrame, name: str, most: int) -> DataFrame:
    """path, pass, bytes, reason of the files that `run_pass` leaves out for their size."""
    size = F.octet_length("text").cast("long")
    return files.where(size > most).select("path", F.lit(name).alias("pass"), size.alias("bytes"), F.lit("over the pass's size limit").alias("reason"))


def run_pass(files: DataFrame, analyse: Callable[[str, dict], Iterable[tuple[str, str, int, str]]], columns: tuple[str, ...] = (), most: int = 2 << 20, hint: str | None = None) -> DataFrame:
    """path, rule, family, score, evidence of files (path, text and more columns) by a per-file analysis of latin-1 text.

    A hint that every file with findings matches is tested on the JVM, so that others never reach Python. Files over the limit
    are rows of `over_limit`."""
    rows = files.where((F.octet_length("text") > 0) & (F.octet_length("text") <= most))
    if hint:
        rows = rows.where(F.col("text").rlike(hint))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                found += [(row["path"], *f) for f in analyse(row["text"], row)]
            columns_ = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "rule", "family", "score", "evidence"])

    return rows.select("path", "text", *columns).mapInArrow(run, FINDING)
