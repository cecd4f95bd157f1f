"""Reading the tables, and what several operators need."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackloom.catalog.registry import Build, Entry

#: Characters that part words in the contracts: a word is ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]"

#: Texts of an Arrow batch.
TEXTS = 1000

ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        ENTRIES[name] = Entry(name, (), build, sql)
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **parts) -> DataFrame:
    """The whole row as the struct ``row`` beside ``parts``, so that no column of the caller can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in parts.items()])


def texts_in_python(rows: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over rows that hold texts: batches of ``TEXTS`` rows, as a task and its worker hold several at a time.

    The size is a setting of the session; it is only ever lowered.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(rows.sparkSession.conf.get(setting)) <= TEXTS:
        rows.sparkSession.conf.set(setting, str(TEXTS))
    return rows.mapInArrow(tidy(run), schema)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after which a task gives back what it no longer uses: Python workers outlive their tasks."""
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Memory that this process no longer uses goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(batch: pa.RecordBatch, rows: int = 512) -> Iterable[pa.RecordBatch]:
    """Short slices, so that what a task holds beside its batch stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def fold(key: bytes, parts: int) -> int:
    return zlib.crc32(key) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], wanted: dict[int, int], id: str,
                    text: str, label: str) -> list[tuple[bytes, int]]:
    """At most ``wanted[value]`` (text, label) of each label value, on the driver; the bound on them is that of ``wanted``."""
    rows = sampled_texts(docs, labelled_ids(labels, learn, wanted, id, label), id, text).select("text", "y").toArrow()
    return list(zip(utf8(rows.column("text").combine_chunks()), rows.column("y").to_pylist()))


def labelled_ids(labels: DataFrame, learn: Callable[[Column], Column], wanted: dict[int, int], id: str, label: str) -> DataFrame:
    """``of``, ``y``: at most ``wanted[value]`` ids of each label value that pass ``learn``, by a hash of the id.

    They are chosen from the labels alone. Ids that are labelled twice count once per label.
    """
    own = labels.select(F.col(f"`{id}`").alias("of"), F.col(f"`{label}`").cast("int").alias("y")).where(learn(F.col("of"))).distinct()
    order = F.xxhash64("of")
    chosen = None
    for value, most in wanted.items():
        some = own.where(F.col("y") == value).orderBy(order, "of").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    return chosen


def sampled_texts(docs: DataFrame, chosen: DataFrame, id: str, text: str) -> DataFrame:
    """The columns of ``chosen`` (``of`` and others) and ``text``: one row for each row of ``chosen`` that has a document.

    Of documents with the same id, that with the smallest hash of its text is taken, so their number does not matter.
    """
    texts = docs.select(F.col(f"`{id}`").alias("of"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, "of").groupBy(*chosen.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def logistic_fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; ``penalty`` keeps them finite where classes part cleanly."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
