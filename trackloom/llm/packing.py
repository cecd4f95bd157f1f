"""Packing of tokenised documents into sequences: large-item matching, then best fit."""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import batches, texts_in_python, utf8
from trackloom.session import materialised

#: Parts of words whose ids a worker remembers before it starts anew, and as many before them: some 300 bytes each, 180 MB in all.
REMEMBERED = 300_000
#: Texts in which the tokenizer's own parting rules need no more than the parts below: no character changes but by case.
SIMPLE = re.compile(r"[\t\n -~À-ÖØ-öø-ÿ]*")
#: Fixed by the tokenizer file: runs of letters, contractions, single digits, runs of anything else but white space.
PARTS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


@lru_cache(1)
def encoders(path: str) -> tuple:
    """The tokenizer of a file, and one of the same model for parts that are parted and in lower case already; read once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    parts = Tokenizer(whole.model)
    parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return whole, parts


class Ids:
    """Token ids of texts as little-endian 32-bit numbers, remembered by part of a word.

    The tokenizer drops white space and merges nothing across its parts, so a text's ids are its parts' ids in a row. Texts
    of simple characters are parted here by the same rule; in others every word with another character is handed over whole.
    A text that may hold one of the tokenizer's added tokens goes to it as it is and is not remembered.
    """

    def __init__(self, path: str):
        self.encoder, self.simple = encoders(path)
        self.added = [t.content.lower() for t in self.encoder.get_added_tokens_decoder().values()]
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def parts(self, text: str, whole: set[str]) -> list[str]:
        """The words that the tokenizer gets whole are added to ``whole``."""
        if SIMPLE.fullmatch(text):
            return PARTS.findall(text.lower())
        out: list[str] = []
        for word in text.replace("\n", " ").replace("\t", " ").split(" "):
            if SIMPLE.fullmatch(word):
                out += PARTS.findall(word.lower())
            else:
                out.append(word)
                whole.add(word)
        return out

    def learn(self, parts: set[str], whole: set[str]) -> None:
        """Some parts at a time: the tokenizer's answers are many times as large as the ids."""
        simple = list(parts - whole)  # one token with an end each
        for k in range(0, len(simple), 500):
            own = simple[k : k + 500]
            ids = np.array(self.simple.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            if len(cuts) == len(own) + 1:
                self.known.update((p, raw[a:b]) for p, a, b in zip(own, cuts, cuts[1:]))
        rest = [p for p in parts if p not in self.known]
        for k in range(0, len(rest), 500):
            own = rest[k : k + 500]
            self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(own, self.encoder.encode_batch_fast(own, add_special_tokens=False)))

    def of(self, texts: list[str]) -> list[bytes]:
        whole = [any(a in low for a in self.added) for low in map(str.lower, texts)]
        known = iter(self.of_parts([t for t, own in zip(texts, whole) if not own]))
        return [np.array(self.encoder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if own else next(known) for t, own in zip(texts, whole)]

    def of_parts(self, texts: list[str]) -> list[bytes]:
        """Each part of a batch is looked up once; the texts' ids are put together by its number."""
        whole: set[str] = set()
        parted = [self.parts(t, whole) for t in texts]
        every = list(chain.from_iterable(parted))
        part = pa.array(every, pa.large_string()).dictionary_encode().indices.to_numpy()  # numbered as they first appear
        firsts = np.flatnonzero(part > np.maximum.accumulate(np.concatenate([[-1], part[:-1]])))
        distinct = [every[k] for k in firsts.tolist()]
        ids = list(map(self.known.get, distinct))
        absent = [k for k, own in enumerate(ids) if own is None]
        again = {distinct[k]: self.older[distinct[k]] for k in absent if distinct[k] in self.older}
        if len(self.known) + len(absent) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update(again)
        self.learn({distinct[k] for k in absent} - again.keys(), whole)
        for k in absent:
            ids[k] = self.known[distinct[k]]
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[part])])
        raw = flat[np.repeat(starts[part] - ends[:-1], sizes[part]) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[np.cumsum([0, *map(len, parted)])]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(1)
def worker_ids(path: str) -> Ids:
    """One for all tasks of a worker, which share most of their parts."""
    return Ids(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and then ``end``, cut into pieces of ``capacity`` where longer.

    ``tokenizer``: path of a ``tokenizers`` file, there on every executor. Gives ``doc_id``, ``piece`` (from 0), ``start``,
    ``length``, ``ids`` (binary, unsigned little-endian 32-bit numbers), ``task`` and ``nth`` (the piece's number among
    those of its length in its task). Null and empty texts are the end id alone; repeated rows are documents of their own.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    last = np.array([end], "<u4").tobytes()

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = worker_ids(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for big in it:
            for b in batches(big, 500):
                out: list[list] = [[], [], [], [], [], []]
                found = ids.of([t.decode() for t in utf8(b.column("text"))])
                for doc_id, all_ids in zip(b.column("doc_id").to_pylist(), found):
                    all_ids += last
                    for piece, start in enumerate(range(0, len(all_ids) // 4, capacity)):
                        part = all_ids[4 * start : 4 * (start + capacity)]
                        length = len(part) // 4
                        for column, value in zip(out, (doc_id, piece, start, length, part, seen[length])):
                            column.append(value)
                        seen[length] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)] + [pa.array([task] * len(out[0]), pa.int32())],
                                                 names=["doc_id", "piece", "start", "length", "ids", "nth", "task"])

    return texts_in_python(rows, run, "doc_id long, piece int, start long, length long, ids binary, nth long, task int")


class Bins:
    """Groups of equal bins while they are filled: ``gap`` -> groups of (number of bins, (length, times) in order)."""

    def __init__(self) -> None:
        self.by_gap: dict[int, list[tuple[int, tuple]]] = {}
        self.gaps: list[int] = []

    def put(self, gap: int, bins: int, items: tuple) -> None:
        if not bins:
            return
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append((bins, items))

    def tightest(self, length: int) -> tuple[int, int, tuple] | None:
        """Takes out a group with the smallest gap that holds ``length``."""
        k = bisect_left(self.gaps, length)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        bins, items = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[k]
        return gap, bins, items


def filled(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Bins for ``counts`` pieces of each length, as groups of equal bins: (number of bins, ((length, times), ...)).

    Pieces above a third of the capacity go first, from the longest: each is matched with the longest other such piece that
    fits beside it, so a bin holds two of them at most. Then the smaller pieces, from the longest, go where the gap is
    smallest. Equal bins are handled together: every step uses up a length or a group, so the work depends on the number of
    lengths, at most ``capacity``, and not on the number of pieces.
    """
    bins, left = Bins(), {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1  # the longest that fits beside it
        if k < 0:
            bins.put(capacity - a, left.pop(a), ((a, 1),))
            large.pop()
            continue
        b = large[k]
        if a == b:
            pairs = left[a] // 2
            bins.put(capacity - 2 * a, pairs, ((a, 2),))
            left[a] -= 2 * pairs
            if left[a]:  # one without a partner of its own length
                if k:
                    bins.put(capacity - a - large[k - 1], 1, ((a, 1), (large[k - 1], 1)))
                    left[large[k - 1]] -= 1
                    if not left[large[k - 1]]:
                        del left[large[k - 1]], large[k - 1]
                else:
                    bins.put(capacity - a, 1, ((a, 1),))
            del left[a]
            large.pop()
            continue
        pairs = min(left[a], left[b])
        bins.put(capacity - a - b, pairs, ((a, 1), (b, 1)))
        for n in (a, b):
            left[n] -= pairs
            if not left[n]:
                del left[n]
                large.remove(n)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            gap, number, items = bins.tightest(n) or (capacity, -(-count // (capacity // n)), ())
            times = gap // n  # best fit keeps to a bin until the next one does not fit
            full = min(number, count // times)
            bins.put(gap - times * n, full, (*items, (n, times)))
            count -= full * times
            number -= full
            if number and count:  # fewer are left than one bin takes
                bins.put(gap - count * n, 1, (*items, (n, count)))
                number, count = number - 1, 0
            bins.put(gap, number, items) if items else None
    return [g for groups in bins.by_gap.values() for g in groups]


def places(groups: list[tuple[int, tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece goes, as runs of equal length in their order: keys (length, first number of the run), and per run
    the first bin, pieces in each bin, and the offset of the first in its bin."""
    used: dict[int, int] = {}
    runs, first = [], 0
    for bins, items in groups:
        offset = 0
        for length, times in items:
            runs.append((length, used.get(length, 0), first, times, offset))
            used[length] = used.get(length, 0) + bins * times
            offset += length * times
        first += bins
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return table[:, 0], table[:, 1], table[:, 2:]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Columns of ``pieces`` but for ``task`` and ``nth``, with ``sequence_id`` and ``offset``.

    Only a histogram of the lengths, at most ``capacity`` rows, comes to the driver; the plan made from it says for the
    runs of each length which sequences they go to, and goes to the tasks. A piece's number among those of its length is
    its ``nth`` in its task and the number of such pieces in the tasks before, so nothing is sorted and a length that a
    third of all pieces share is no one's burden. Sequence ids are whole numbers without gaps. ``pieces`` is written once.
    """
    pieces = materialised(pieces, "pieces")
    per_task = materialised(pieces.groupBy("task", "length").agg(F.count("*").alias("own")), "lengths")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("own").alias("n")).collect()}
    length_of, from_of, run_of = places(filled(counts, capacity))
    width = np.int64(1) << 40
    key_of = length_of * width + from_of
    before = F.sum("own").over(Window.partitionBy("length").orderBy("task")) - F.col("own")
    starts = materialised(per_task.select("task", "length", before.alias("before")), "lengths-before")
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    numbered = pieces.join(starts, ["task", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("number"))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            k = np.searchsorted(key_of, length * width + number, side="right") - 1
            first, times, offset = run_of[k].T
            nth = number - from_of[k]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(first + nth // times), pa.array(offset + nth % times * length)],
                                             names=[*kept, "sequence_id", "offset"])

    schema = numbered.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: ``sequence_id``, ``length``, ``ids`` (binary), one row per sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(ordered, F.lit(b""), lambda ids, piece: F.concat(ids, piece["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
