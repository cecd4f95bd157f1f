"""Fill-in-the-middle: texts as piece tables, cut, rearranged and put back without copying a text.

A document is a list of pieces (buffer, start, end) over buffers that never change: its own UTF-8 bytes and three
sentinels. Cutting splits a piece, an arrangement permutes the pieces and puts sentinel pieces between them, its inverse
drops these and permutes back. Hashes and outputs are read off the pieces, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from trackloom.llm.common import batches, packed, texts_in_python, utf8

Piece = tuple[int, int, int]

#: Buffers: the text, and the sentinels before the prefix, the suffix and the middle.
TEXT, PREFIX, SUFFIX, MIDDLE = range(4)
SENTINELS = {PREFIX: b"<P>", SUFFIX: b"<S>", MIDDLE: b"<M>"}
#: Order in which a form has its parts, each after its sentinel.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def cut(pieces: Sequence[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after ``at`` bytes; the piece that holds the place is split, no bytes move."""
    left, right = [], []
    for buffer, start, end in pieces:
        k = min(max(at, 0), end - start)
        left.append((buffer, start, start + k))
        right.append((buffer, start + k, end))
        at -= end - start
    return [p for p in left if p[1] < p[2]], [p for p in right if p[1] < p[2]]


def arranged(parts: dict[int, list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its sentinel."""
    return [p for name in FORMS[form] for p in [(name, 0, len(SENTINELS[name])), *parts[name]]]


def put_back(pieces: Sequence[Piece], form: str) -> list[Piece]:
    """Pieces of the original text from those of the output: the inverse of ``arranged``."""
    if form not in FORMS:
        return list(pieces)
    parts: dict[int, list[Piece]] = {}
    now: list[Piece] = []
    for p in pieces:
        if p[0] == TEXT:
            now.append(p)
        else:
            now = parts[p[0]] = []
    return [p for name in (PREFIX, MIDDLE, SUFFIX) for p in parts[name]]


def read(pieces: Iterable[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes of the pieces in order, as views of their buffers."""
    buffers = {TEXT: memoryview(text), **{k: memoryview(v) for k, v in SENTINELS.items()}}
    for buffer, start, end in pieces:
        yield buffers[buffer][start:end]


def digest(pieces: Iterable[Piece], text: bytes) -> str:
    h = hashlib.sha256()
    for part in read(pieces, text):
        h.update(part)
    return h.hexdigest()


def pieces_of_output(output: bytes, form: str) -> list[Piece]:
    """The pieces of an output that is read from a file, its own bytes as the text buffer: the sentinels are found in it,
    as no part of the text holds one."""
    if form not in FORMS:
        return [(TEXT, 0, len(output))] if output else []
    marks = sorted((output.index(SENTINELS[name]), name) for name in FORMS[form])
    ends = [at for at, _ in marks[1:]] + [len(output)]
    return [p for (at, name), end in zip(marks, ends) for p in ((name, 0, len(SENTINELS[name])), (TEXT, at + len(SENTINELS[name]), end))]


def unit_ends(text: bytes) -> np.ndarray:
    """Bytes before the first, second, ... line and after the last; a line includes its line feed."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], ends, [len(text)] if len(text) and not text.endswith(b"\n") else []]).astype(np.int64)


def code_points(text: bytes, start: int, end: int) -> int:
    return int(np.count_nonzero(np.frombuffer(text, np.uint8)[start:end] & 0xC0 != 0x80))


def draws(id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the id; a null id is written as nothing."""
    raw = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(raw[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(id: int | None, text: bytes, seed: int, rate: int, spm: int) -> tuple[int, str, list[Piece], int | None, int | None]:
    """Number of units, form, pieces of the output, and characters of prefix and middle (null if plain)."""
    ends, (h1, h2, h3, h4) = unit_ends(text), draws(id, seed)
    n = len(ends) - 1
    whole: list[Piece] = [(TEXT, 0, len(text))] if text else []
    if not text or any(s in text for s in SENTINELS.values()) or h3 % 100 >= rate:
        return n, "plain", whole, None, None
    first, second = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, rest = cut(whole, first)
    middle, suffix = cut(rest, second - first)
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, arranged({PREFIX: prefix, MIDDLE: middle, SUFFIX: suffix}, form), code_points(text, 0, first), code_points(text, first, second)


PIECES = "array<struct<buffer:int,start:bigint,end:bigint>>"


def with_infill(docs: DataFrame, whole: bool = True, outputs: bool = True, seed: int = 7, rate: int = 100, spm: int = 50, id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Every document cut at two line ends into prefix, middle and suffix, and rearranged.

    Gives ``row`` (the document, if ``whole``), ``doc_id``, ``n`` (lines), ``form``, ``pieces`` (of the output: buffer 0 is the
    text in UTF-8, 1 to 3 are the sentinels), ``prefix_chars``, ``middle_chars``, ``output`` (text, if ``outputs``),
    ``output_sha256`` and ``restored_sha256``. ``rate`` percent of documents are rearranged, ``spm`` percent of them with the
    suffix first. All draws hash ``seed`` and the id, so reruns agree and rows with equal ids draw alike.

    Null and empty texts, and texts that hold a sentinel, stay as they are (form ``plain``). A null id draws as an empty one.
    Cuts may fall at either end and on each other, which leaves empty parts. Nothing is shuffled; a task holds one batch of
    texts, of whatever length, and at most one output beside it.
    """
    rows = packed(docs, doc_id=F.col(f"`{id}`").cast("long"))
    if not whole:
        rows = rows.select("doc_id", F.struct(F.col(f"row.`{text}`").cast("string").alias(text)).alias("row"))
    kept = ["row", "doc_id"] if whole else ["doc_id"]
    schema = rows.select(*kept).schema.add("n", "long").add("form", "string")
    for name, kind in {"prefix_chars": "long", "middle_chars": "long", "output_sha256": "string", "restored_sha256": "string"}.items():
        schema = schema.add(name, kind)
    schema = schema.add("buffers", ArrayType(IntegerType())).add("starts", ArrayType(LongType())).add("ends", ArrayType(LongType()))
    if outputs:
        schema = schema.add("output", "string")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for big in it:
            for b in batches(big, 128):
                out: list[tuple] = []
                for key, own in zip(b.column("doc_id").to_pylist(), utf8(b.column("row").field(text).cast(pa.string()))):
                    n, form, pieces, prefix, middle = transformed(key, own, seed, rate, spm)
                    hashes = digest(pieces, own), digest(put_back(pieces, form), own)
                    out.append((n, form, prefix, middle, *hashes, *([p[k] for p in pieces] for k in range(3)),
                                *([b"".join(read(pieces, own)).decode()] if outputs else [])))
                columns = zip(*out) if out else [[]] * (9 + outputs)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(c, t) for c, t in zip(columns, [*types, pa.string()])],
                                                 names=schema.names)

    made = texts_in_python(rows, run, schema)
    pieces = F.arrays_zip("buffers", "starts", "ends").cast(PIECES)
    return made.withColumn("pieces", pieces).drop("buffers", "starts", "ends")


def restored_texts(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Columns of ``rows`` (as written by ``with_infill``) with ``restored``: the texts as they were, from outputs and forms
    alone. A null output gives an empty text; a null form counts as plain."""
    kept = rows.columns
    schema = rows.select(*kept).schema.add("restored", "string")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big, 128):
                made = [b"".join(read(put_back(pieces_of_output(t, f or "plain"), f or "plain"), t)).decode()
                        for t, f in zip(utf8(b.column(output)), b.column(form).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(made, pa.string())], names=schema.names)

    return texts_in_python(rows, run, schema)
