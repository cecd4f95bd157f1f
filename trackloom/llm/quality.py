"""Quality by positive-unlabelled learning: trusted good texts against web text, with a non-negative risk."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import batches, labelled_ids, logistic_fit, packed, sampled_texts, texts_in_python, utf8

#: Buckets of the three-character shapes, and single measures beside them.
SHAPES, MEASURES = 512, 11
#: Kind of a byte: lower-case letters (and all of other scripts), upper-case letters, digits, line ends, other space; each mark is its own.
KIND = np.full(256, 1, np.int64)
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[:33] = 4
KIND[10] = 5
for _k, _mark in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    KIND[_mark] = 6 + _k
KINDS = 40


def features(text: bytes) -> np.ndarray:
    """What a text looks like, whatever its language: square roots of the shares of hashed shapes of three characters, and
    measures of repetition, word length and kinds of characters. An empty text has zeros."""
    x = np.zeros(SHAPES + MEASURES, np.float32)
    if not text:
        return x
    raw = KIND[np.frombuffer(text, np.uint8)]
    if len(raw) > 2:
        shape = (raw[:-2] * KINDS + raw[1:-1]) * KINDS + raw[2:]
        x[:SHAPES] = np.sqrt(np.bincount((shape * 40503 >> 4) % SHAPES, minlength=SHAPES) / len(shape))
    of_kind = np.bincount(raw, minlength=KINDS) / len(raw)
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    x[SHAPES:] = (np.log1p(n), len(seen) / n, max(seen.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
                  pairs / max(1, n - 1), np.log1p(len(text) / n), of_kind[2], of_kind[3], of_kind[6:].sum(), of_kind[4] + of_kind[5],
                  len(set(lines)) / len(lines))
    return x


@dataclass
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        return sigmoid(self.inputs(texts) @ self.weights)

    def inputs(self, texts: Sequence[bytes]) -> np.ndarray:
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, SHAPES + MEASURES), np.float32)
        return scaled(x, self.middle, self.spread)


def scaled(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - middle) / spread, -8, 8), np.ones((len(x), 1))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(good: np.ndarray, web: np.ndarray) -> float:
    """Share of good texts among web texts: a score tells positive from web text; where it is high there are only good
    ones, so the ratio of the two tails there is the share. The smallest ratio over tails with enough texts is taken."""
    half = [g[k::2] for g in (good, web) for k in (0, 1)]
    x, y = np.vstack([half[0], half[2]]), np.repeat([1.0, 0.0], [len(half[0]), len(half[2])])
    w = logistic_fit(x, y, penalty=10.0)
    g, u = half[1] @ w, half[3] @ w
    tails = [(u >= t).mean() / (g >= t).mean() for t in np.quantile(g, np.linspace(0.02, 0.5, 25))] if len(g) and len(u) else [0.5]
    return float(np.clip(min(tails), 0.05, 0.95))


def nonnegative_fit(good: np.ndarray, web: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02, penalty: float = 1e-3) -> np.ndarray:
    """Weights that minimise the unbiased risk of positive-unlabelled learning, its negative part kept from falling below 0.

    The risk of the bad class is that of all web texts less the share of the good ones. It is never negative in truth; where
    the estimate is, the step goes the other way, so that the model does not fit itself to the sample.
    """
    w, m, v = np.zeros(good.shape[1]), np.zeros(good.shape[1]), np.zeros(good.shape[1])
    for k in range(1, rounds + 1):
        zg, zu = good @ w, web @ w
        as_good = -(good.T @ sigmoid(-zg)) / len(good)
        bad_good, bad_web = good.T @ sigmoid(zg) / len(good), web.T @ sigmoid(zu) / len(web)
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zg).mean()
        slope = prior * as_good + (bad_web - prior * bad_good) if bad >= 0 else prior * bad_good - bad_web
        slope = slope + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def fit(good: Sequence[bytes], web: Sequence[bytes]) -> Model:
    """From trusted good texts and unlabelled ones."""
    return fit_features(*([(digest(t), features(t).tobytes()) for t in x] for x in (good, web)))


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def fit_features(good: Sequence[tuple[bytes, bytes]], web: Sequence[tuple[bytes, bytes]]) -> Model:
    """From digests and features of trusted good texts and of unlabelled ones; equal texts count once. Without either every
    score is a half."""
    g, u = (np.frombuffer(b"".join([x for _, x in sorted(set(rows))]), np.float32).reshape(-1, SHAPES + MEASURES) for rows in (good, web))
    if not len(g) or not len(u):
        return Model(np.zeros(g.shape[1]), np.ones(g.shape[1]), np.zeros(g.shape[1] + 1), 0.5)
    middle, spread = u.mean(axis=0), u.std(axis=0) + 0.01
    g, u = scaled(g, middle, spread), scaled(u, middle, spread)
    prior = class_prior(g, u)
    return Model(middle, spread, nonnegative_fit(g, u, prior), prior)


def fit_quality(docs: DataFrame, labels: DataFrame, learn, good: int = 3000, web: int = 6000, id: str = "doc_id", text: str = "text",
                label: str = "quality") -> Model:
    """A model from at most ``good`` texts labelled 1 whose id passes ``learn``, and ``web`` texts without regard to labels.

    Both are chosen by a hash of the id, whatever their length; an id counts once, however many rows have it. Tasks make the
    features, so that 2 KB of each chosen text come to the driver.
    """
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                texts = utf8(b.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([digest(t) for t in texts], pa.binary()),
                                                  pa.array([features(t).tobytes() for t in texts], pa.binary())], names=["digest", "x"])

    def known(ids: DataFrame) -> list[tuple[bytes, bytes]]:
        rows = texts_in_python(sampled_texts(docs, ids, id, text).select("text"), run, "digest binary, x binary").toArrow()
        return list(zip(rows.column("digest").to_pylist(), rows.column("x").to_pylist()))

    ids = docs.select(F.col(f"`{id}`").alias("of")).where("of is not null").distinct()
    return fit_features(known(labelled_ids(labels, learn, {1: good}, id, label)), known(ids.orderBy(F.xxhash64(F.lit("web"), "of"), "of").limit(web)))


def with_quality(docs: DataFrame, model: Model, whole: bool = True, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the document, if ``whole``), ``doc_id`` and ``score`` (0 to 1) of every whole text. Null counts as empty; the score of a
    text depends on it alone, so repeated rows agree."""
    rows = packed(docs, doc_id=F.col(f"`{id}`").cast("long"))
    if not whole:
        rows = rows.select("doc_id", F.struct(F.col(f"row.`{text}`")).alias("row"))
    kept = ["row", "doc_id"] if whole else ["doc_id"]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(model.score(utf8(b.column("row").field(text).cast(pa.string()))))],
                                                 names=[*kept, "score"])

    return texts_in_python(rows, run, rows.select(*kept).schema.add("score", "double"))
