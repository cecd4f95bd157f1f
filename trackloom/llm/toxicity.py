"""Toxicity from compression: windows that a dictionary of toxic text shortens more than one of ordinary text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import batches, fold, give_back, labelled_sample, logistic_fit, packed, texts_in_python, utf8

#: Bytes of a window, and of it before the piece that it is taken for.
WINDOW, BEFORE = 64, 24
#: Bytes of a piece: text has a bearing on toxicity only where it holds one that the toxic dictionary has and ordinary text lacks.
PIECE = 8
#: Distinct toxic texts that a piece must be in, and how many times oftener than in ordinary ones.
TEXTS, OFTENER = 3, 30.0
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 16384, 16384, 15
#: Ordinary texts that their dictionary is trained on at most, by a hash of the text.
DICTIONARY_TEXTS = 2000
#: Follows each window, so that even a short one is worth compressing and is not stored as it is.
TAIL = bytes(64)
#: A piece's place in the table that is looked at first.
TABLE_BITS = 20


def plain(text: bytes) -> bytes:
    """Lower case, one space between words and around them."""
    return b" " + b" ".join(text.lower().split()) + b" "


def pieces(text: bytes) -> np.ndarray:
    """All overlapping pieces, as numbers."""
    n = len(text) - PIECE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", text + bytes(8), strides=(1,)) & np.uint64(2 ** (8 * PIECE) - 1)


def place(found: np.ndarray) -> np.ndarray:
    return (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def texts_with(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pieces, and in how many of the texts each is; some texts at a time, to hold few pieces twice."""
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    for k in range(0, len(texts), 200):
        more, n = np.unique(np.concatenate([np.unique(pieces(t)) for t in texts[k : k + 200]]), return_counts=True)
        both, at = np.unique(np.concatenate([found, more]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int32)
        found = both
    return found, counts


def dictionary(samples: Sequence[bytes], size: int) -> bytes:
    """Dictionary content trained on ``samples``; where all distinct ones fit, or are too few for training, these themselves."""
    distinct = sorted(Counter(samples).items(), key=lambda x: (x[1], x[0]))  # the most frequent last, where they cost least
    if sum(len(s) for s, _ in distinct) <= size:
        return b"".join([s for s, _ in distinct])
    try:
        trained = zstandard.train_dictionary(size, samples, k=24, d=PIECE).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]
    return trained[256:]  # behind the header and entropy tables


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    """Dictionary contents, the pieces that mark toxic text, and weights of the features."""

    ordinary: bytes
    toxic: bytes
    only: np.ndarray
    weights: np.ndarray

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}  # compressors stay behind; tasks make their own

    def ready(self) -> None:
        # the toxic dictionary holds the ordinary one as well, so that text without toxic pieces costs the same in both
        self.pair = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        self.table = np.zeros(2**TABLE_BITS, bool)
        self.table[place(self.only)] = True

    def savings(self, text: bytes) -> list[int]:
        """Bytes that the toxic dictionary saves, by window around pieces that only it has."""
        whole = plain(text)
        found = pieces(whole)
        at = np.flatnonzero(self.table[place(found)])
        at = at[np.isin(found[at], self.only)].tolist()
        out, done = [], 0
        for k in at:
            if k >= done:
                start = max(0, k - BEFORE)
                window = whole[start : start + WINDOW] + TAIL
                out.append(len(self.pair[0].compress(window)) - len(self.pair[1].compress(window)))
                done = start + WINDOW - PIECE
        return out

    def features(self, text: bytes) -> tuple[float, ...]:
        """1, the best saving, the logs of all savings and of the savings in a thousand bytes."""
        saved = self.savings(text)
        total = sum(x for x in saved if x > 0)
        return 1.0, max(saved, default=0), float(np.log1p(total)), float(np.log1p(1000 * total / (len(text) + 200)))

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> Model:
    """Dictionaries from three quarters of the distinct texts, weights from the rest, on which savings are as on new text.

    Without toxic or without ordinary texts every score is that of the class there is.
    """
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    tests = [t for t in toxic if fold(t, 4) == 0], [t for t in ordinary if fold(t, 4) == 0]
    toxic, ordinary = [plain(t) for t in toxic if fold(t, 4)], [plain(t) for t in ordinary if fold(t, 4)]
    own, texts = texts_with(toxic)
    own, texts = own[texts >= TEXTS], texts[texts >= TEXTS]
    elsewhere = np.zeros(len(own))
    for t in ordinary if len(own) else ():
        seen = np.unique(pieces(t))
        at = np.minimum(np.searchsorted(own, seen), len(own) - 1)
        elsewhere[at[own[at] == seen]] += 1
    own = own[texts * (len(ordinary) + 1) >= OFTENER * (elsewhere + 0.5) * (len(toxic) + 1)]
    spans: Counter[bytes] = Counter()
    for t in toxic:
        hit = np.concatenate([[0], np.isin(pieces(t), own), [0]])
        edges = np.flatnonzero(np.diff(hit))
        spans.update({t[a : b + PIECE - 1] for a, b in zip(edges[::2], edges[1::2])})
    chosen = sorted(ordinary, key=lambda t: (zlib.crc32(t), t))[:DICTIONARY_TEXTS]
    windows = [t[k : k + WINDOW] for t in chosen for k in range(0, len(t), WINDOW)]
    content = dictionary([s for s, n in sorted(spans.items()) for _ in range(n)], TOXIC_BYTES)
    model = Model(dictionary(windows, ORDINARY_BYTES), content, np.intersect1d(own, pieces(content)), np.zeros(4))
    model.ready()
    x = np.array([model.features(t) for part in tests for t in part], float).reshape(-1, 4)
    y = np.repeat([1.0, 0.0], [len(tests[0]), len(tests[1])])
    if not len(toxic) or not len(ordinary):
        model.weights = np.array([4.0 if len(toxic) else -4.0, 0.0, 0.0, 0.0])
    else:
        model.weights = logistic_fit(x, y)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, texts: int = 10_000, id: str = "doc_id", text: str = "text",
                 label: str = "toxic") -> Model:
    """A model from at most ``texts`` labelled texts (a fifth of them toxic), whole and of any length, whose id passes ``learn``."""
    sample = labelled_sample(docs, labels, learn, {1: texts // 5, 0: texts - texts // 5}, id, text, label)
    toxic, ordinary = [t for t, y in sample if y], [t for t, y in sample if not y]
    del sample
    model = fit(toxic, ordinary)
    del toxic, ordinary
    give_back()  # the driver goes on with other stages
    return model


def with_toxicity(docs: DataFrame, model: Model, whole: bool = True, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the document, if ``whole``), ``doc_id`` and ``score`` (0 to 1) of every whole text. Null and empty texts have no window
    and the lowest score; the score of a text depends on it alone, so repeated rows agree."""
    rows = packed(docs, doc_id=F.col(f"`{id}`").cast("long"))
    if not whole:
        rows = rows.select("doc_id", F.struct(F.col(f"row.`{text}`")).alias("row"))
    kept = ["row", "doc_id"] if whole else ["doc_id"]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.ready()
        for big in it:
            for b in batches(big):
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(model.score(utf8(b.column("row").field(text).cast(pa.string()))))],
                                                 names=[*kept, "score"])

    return texts_in_python(rows, run, rows.select(*kept).schema.add("score", "double"))
