"""Fingerprints of texts from content-defined chunks."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import batches, texts_in_python, utf8
from trackloom.session import lookup

#: Bytes of a chunk at least, as a rule, and at most.
LEAST, USUAL, MOST = 8, 32, 128
#: A boundary needs this many of the top bits at zero before the usual length, and after it.
STRICT, LOOSE = 7, 3
GEAR = np.random.default_rng(42).integers(0, 2**32, 256, dtype=np.uint64).astype("<u4")


def gear_hashes(text: np.ndarray) -> np.ndarray:
    """For each byte, the 32-bit gear hash of the 16 bytes that end with it: each step shifts by two bits and adds."""
    h = GEAR[text]
    for reach in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[reach:] = h[:-reach] << np.uint32(2 * reach)
        h = h + older
    return h


def chunks(text: bytes) -> list[bytes]:
    """Chunks of a text in order. Boundaries depend on the 16 bytes before them alone, so they move with the text.

    From the shortest length on the first strict boundary ends a chunk, from the usual length on the first loose one.
    """
    n = len(text)
    if n <= LEAST:
        return [text] if n else []
    h = gear_hashes(np.frombuffer(text, np.uint8))
    loose = np.flatnonzero(h < 2 ** (32 - LOOSE))
    strict = (loose[h[loose] < 2 ** (32 - STRICT)] + 1).tolist()
    loose = (loose + 1).tolist()
    out, start = [], 0
    while start < n:
        k = bisect_left(strict, start + LEAST)
        end = strict[k] if k < len(strict) else n
        if end > start + USUAL:
            k = bisect_left(loose, start + USUAL)
            end = min(end, loose[k] if k < len(loose) else n, start + MOST, n)
        out.append(text[start:end])
        start = end
    return out


def fingerprint(text: bytes) -> dict[int, int]:
    """48-bit digests of the distinct chunks, with their lengths."""
    return {xxhash.xxh64_intdigest(c) >> 16: len(c) for c in chunks(text)}


def written(prints: dict[int, int]) -> str:
    """Digests in ascending order, 12 hex digits each, followed by two of the length."""
    return "".join([f"{d:012x}{n:02x}" for d, n in sorted(prints.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes in chunks of ``a`` that ``b`` has too; 1 for two empty texts, 0 if only ``a`` is empty."""
    if not a:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


#: Quantiles of the ids by which ranges are made alike.
KNOTS = 256
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited(text: str, following: str) -> str:
    """The last third replaced by as many characters from the start of the document that follows."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(doc_id: int | None, text: str, own: dict[int, int], following: str, other: dict[int, int]) -> tuple:
    changed = edited(text, following).encode()
    prints = fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), written(own), written(prints), containment(own, prints), containment(own, other))


def neighbour_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, compared with those of its edited text and of the next document.

    The next document is that with the next smaller id (equal ids: by a hash of the text; null ids last); after the last
    comes the first. Null text is empty; empty texts have an empty fingerprint; repeated rows follow each other and have
    likeness 1.

    Documents are dealt out by ranges of ids and go through their task in order, two texts at a time. The ranges follow
    ``KNOTS`` quantiles of the ids, the one thing that comes to the driver. So that the last document of a range
    finds its next one, a copy of each range's first document is dealt to the range before: one text for each range.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("range", ranges_of(rows, ranges))
    firsts = lookup(rows.groupBy("range").agg(F.max("doc_id").alias("first_id")), "first-ids")
    turn = Window.orderBy("range")
    before = firsts.select("range", "first_id", F.coalesce(F.lag("range").over(turn), F.max("range").over(Window.partitionBy())).alias("to"))
    before = lookup(before.withColumnRenamed("range", "of"), "ranges-before")
    opens = rows.join(before, (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    opens = opens.groupBy("to").agg(F.min(F.struct(F.xxhash64("text").alias("print"), "doc_id", "text")).alias("x"))
    opens = opens.select("x.doc_id", "x.text", F.col("to").alias("range"), F.lit(True).alias("opens"))
    dealt = rows.withColumn("opens", F.lit(False)).unionByName(opens).repartition("range")
    dealt = dealt.sortWithinPartitions("range", "opens", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    def along(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # id, text, fingerprint, range
        for big in it:
            for b in batches(big, 256):
                done = []
                for doc_id, raw, own, opens in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("range").to_pylist(),
                                                   b.column("opens").to_pylist()):
                    now = (doc_id, raw.decode(), fingerprint(raw), own)
                    if last is not None and last[3] == own:
                        done.append(compared(*last[:3], *now[1:3]))
                    last = None if opens else now
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(TYPES)], names=NAMES)

    return texts_in_python(dealt, along, RESULT)


def ranges_of(rows: DataFrame, ranges: int) -> Column:
    """Number of a row's range of ids, from the largest ids on; null ids have the last.

    Between ``KNOTS`` quantiles of the ids, ranges are of equal width, so that they hold about as many rows each.
    """
    shares = [k / KNOTS for k in range(KNOTS + 1)]
    found = rows.agg(F.percentile_approx("doc_id", shares)).first()[0]
    if not found:
        return F.lit(0)
    knots = sorted(set(found), reverse=True)
    per = -(-ranges // KNOTS)
    known = F.array(*[F.lit(k) for k in knots])
    above = F.greatest(F.size(F.filter(known, lambda k: k > F.col("doc_id"))) - 1, F.lit(0))
    high, low = (F.get(known, above + k).cast("double") for k in (0, 1))
    inside = F.floor((high - F.col("doc_id").cast("double")) / (high - low) * per).cast("int")
    own = above * per + F.least(F.greatest(F.coalesce(inside, F.lit(0)), F.lit(0)), F.lit(per - 1))
    return F.when(F.col("doc_id").isNull(), (len(knots) + 1) * per).otherwise(own)
