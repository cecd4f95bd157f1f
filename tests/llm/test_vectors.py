"""Near-duplicate vectors, infilling and hard negatives against brute force, and on odd input."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import hardnegatives, infill, vectordedup
from trackloom.llm.hardnegatives import hard_negatives
from trackloom.llm.queries import op12
from trackloom.llm.vectordedup import near_vectors

VECTORS = "vec_id long, label int, embedding array<float>, note string, node string, cell string, uid string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS)


@pytest.fixture(scope="module")
def crowd(spark):
    """Groups of near copies, a chain, exact copies, other labels, and vectors that link with nothing."""
    draw = np.random.default_rng(11)
    rows, k = [], 0

    def add(x, label):
        nonlocal k
        rows.append((int(k * 7 % 1201), label, [float(v) for v in np.asarray(x, np.float32)] if x is not None else None))
        k += 1

    for _ in range(200):
        add(draw.normal(size=12), int(draw.integers(0, 3)))
    for label, spread, many in ((0, 0.05, 150), (1, 0.03, 40), (0, 0.07, 60)):
        middle = draw.normal(size=12)
        for _ in range(many):
            add(middle + spread * draw.normal(size=12) * 2, label)
    turn, up = np.linalg.qr(draw.normal(size=(12, 2)))[0].T
    for step in range(20):  # each is near the next only
        add(math.cos(0.19 * step) * turn + math.sin(0.19 * step) * up, 2)
    same = draw.normal(size=12)
    for label in (0, 0, 0, 1, None):
        add(same, label)
    add(2.5 * same, 0)
    for odd in (None, [], [0.0] * 12, [math.nan] * 12, [math.inf] + [0.0] * 11, [1e-38] + [0.0] * 11, [1.0] + [0.0] * 11, [1.0, 0.0]):
        add(odd, 0)
    rows.append((2000, 0, [1.0, None]))
    rows += [(None, 0, rows[-3][2]), rows[210], rows[210], (None, None, None), (3000, None, rows[210][2])]
    return rows


def brute(rows, least=0.98):
    """(id, links, component, kept) by comparing all pairs."""
    def sound(r):
        v = r[2]
        return r[1] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    at = [k for k, r in enumerate(rows) if sound(r)]
    size = max(len(rows[k][2]) for k in at)
    x = np.array([[float(np.float32(v)) for v in rows[k][2]] + [0.0] * (size - len(rows[k][2])) for k in at])
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    label = np.array([rows[k][1] for k in at])
    near = (x @ x.T >= least) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links, root = [0] * len(rows), list(range(len(rows)))
    for i, k in enumerate(at):
        links[k] = int(near[i].sum())
    todo = set(range(len(at)))
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            i = edge.pop()
            group.add(i)
            more = set(np.flatnonzero(near[i]).tolist()) & todo
            todo -= more
            edge += more
        for i in group:
            root[at[i]] = at[min(group)]
    least_id = {}
    for k, r in enumerate(rows):
        least_id.setdefault(root[k], []).append(r[0])
    out = []
    for k, r in enumerate(rows):
        known = [i for i in least_id[root[k]] if i is not None]
        c = min(known) if known else None
        out.append((r[0], links[k], c, r[0] == c))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_near_vectors_are_those_of_all_pairs(spark, crowd):
    want = brute(crowd)
    assert sum(w[1] for w in want) > 10_000 and max(w[1] for w in want) > 100
    assert found(near_vectors(frame(spark, crowd))) == want


def test_long_lists_are_dealt_out_without_loss(spark, crowd, monkeypatch):
    monkeypatch.setattr(vectordedup, "PART", 30)
    monkeypatch.setattr(vectordedup, "LISTS", (4,))
    assert found(near_vectors(frame(spark, crowd), cosine=0.95)) == brute(crowd, 0.95)


@pytest.mark.parametrize("held, lists", [(30, (4,)), (7, (16,)), (10_000, (16,))])
def test_large_labels_are_dealt_out_in_blocks_without_loss(spark, crowd, monkeypatch, held, lists):
    monkeypatch.setattr(vectordedup, "BLOCK", held)
    monkeypatch.setattr(vectordedup, "PART", 50)
    monkeypatch.setattr(vectordedup, "LISTS", lists)
    assert found(near_vectors(frame(spark, crowd), cosine=0.95)) == brute(crowd, 0.95)


def test_vectors_travel_once_to_a_block_not_once_to_a_list(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(k, 0, [float(v) for v in draw.normal(size=6).astype(np.float32)]) for k in range(400)]
    met = []
    kept = vectordedup.materialised

    def watched(df, name):
        made = kept(df, name)
        met.append((name, made.count()))
        return made

    monkeypatch.setattr(vectordedup, "materialised", watched)
    monkeypatch.setattr(vectordedup, "LISTS", (16,))
    assert found(near_vectors(frame(spark, rows), cosine=0.9)) == brute(rows, 0.9)
    assert dict(met)["lists"] == 400  # some 4 lists a vector before


def test_vectors_of_doubles_are_compared_as_they_are(spark):
    one = [1.0, 1e-9, 0.0]  # less than single precision tells apart from the next
    rows = [(1, 0, one), (2, 0, [1.0, 2e-9, 0.0]), (3, 0, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(near_vectors(df)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_no_vectors(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    assert found(near_vectors(frame(spark, [(4, None, [1.0]), (2, 1, None)]))) == [(2, 0, 2, True), (4, 0, 4, True)]


def test_probes_and_tables_lose_no_neighbour():
    """Recall of each step by itself against brute force: lists probed, and pairs left by the tables."""
    draw = np.random.default_rng(2)
    x = vectordedup.unit(np.repeat(draw.normal(size=(300, 32)), 4, axis=0) + 0.03 * draw.normal(size=(1200, 32)))
    radius = math.sqrt(2 - 2 * 0.98)
    index = vectordedup.fitted(x, radius, 1e6)
    assert len(index.centres) > 10
    home, probes = index.lists(x)
    codes, error = index.codes(x, home)
    assert probes.mean() < 0.9
    pairs = 0
    for i, j in zip(*np.nonzero(x @ x.T >= 0.98)):
        assert probes[i, home[j]]
        table = index.tables(x[i : i + 1], home[j])
        assert sum(t[0, c] for t, c in zip(table, codes[j])) <= (radius + error[j]) ** 2 + vectordedup.TABLE_SLACK
        pairs += i != j
    assert pairs > 1000
    a = draw.integers(0, len(x), 2000)
    b = draw.integers(0, len(x), 2000)
    left = [sum(t[0, c] for t, c in zip(index.tables(x[i : i + 1], home[j]), codes[j])) <= (radius + error[j]) ** 2 for i, j in zip(a, b)]
    assert np.mean(left) < 0.2  # most pairs go by the tables alone


# Infilling

def slow_infill(id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return id, n, "plain", None, None, text, sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return id, n, form, len(p), len(m), out, sha(out)


@pytest.fixture(scope="module")
def texts(spark, odd):
    many = "\n".join(f"line {k} é😀" for k in range(50_000))
    rows = [(20, many), (21, many + "\n"), (22, "a<P>b\nc"), (23, "<\nS>"), (24, "\n"), (25, "\n\n\n"), (26, "no end"), (27, "<M\n>P>\n<S"), (28, "a\rb\r\n")]
    rows += [(100 + k, "one\ntwo ü\n\nthree<\nfour") for k in range(40)]
    return odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def test_infill_and_its_inverse(texts):
    made = infill.with_infill(texts).cache()
    rows = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256").collect()
    want = [slow_infill(r.doc_id, r.text) for r in texts.select("doc_id", "text").collect()]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    back = infill.restored_texts(made.select("doc_id", F.col("row.text").alias("text"), "output", "form", "restored_sha256"))
    for r in back.collect():
        assert r.restored == (r.text or "") and r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert made.select("row.*").columns == texts.columns


def test_infill_rates_and_empty_tables(texts, no_docs):
    rows = infill.with_infill(texts, whole=False, rate=30, spm=20, seed=3).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256").collect()
    want = [slow_infill(r.doc_id, r.text, 30, 20, 3) for r in texts.select("doc_id", "text").collect()]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert infill.with_infill(no_docs).count() == 0 and infill.restored_texts(infill.with_infill(no_docs)).count() == 0


def test_pieces_split_and_never_copy():
    draw = random.Random(4)
    text = bytes(draw.randrange(256) for _ in range(200))
    pieces = [(infill.TEXT, 0, 200)]
    for _ in range(100):
        at = draw.randrange(-5, 210)
        left, right = infill.cut(pieces, at)
        assert b"".join(infill.read(left, text)) == text[: max(0, at)] and b"".join(infill.read(right, text)) == text[max(0, at) :]
        pieces = left + right
    assert all(isinstance(v, memoryview) for v in infill.read(pieces, text)) and len(pieces) > 50
    parts = {infill.PREFIX: pieces[:7], infill.MIDDLE: [], infill.SUFFIX: pieces[7:]}
    for form in infill.FORMS:
        made = infill.arranged(parts, form)
        assert infill.put_back(made, form) == pieces
        output = b"".join(infill.read(made, text))
        assert infill.digest(made, text) == hashlib.sha256(output).hexdigest()


def test_op12_columns(spark, sf):
    want = sorted(((*w[:5], w[6], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
                   for w in [slow_infill(r.doc_id, r.text)]), key=str)
    got = op12(spark, sf).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want


# Hard negatives

def slow_negatives(rows, anchor, positives=5, negatives=5):
    size = max([len(r[2]) for r in rows if r[2]], default=0)
    good = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (size - len(v))) for i, y, v in rows
            if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in good:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i)
        for ps, j in [(-s, j) for s, j, z in scored if z == y][:positives]:
            fit = [(-s, k) for s, k, z in scored if z != y and 80 * ps <= -100 * s <= 100 * ps][:negatives]
            out += [(i, j, rank, k, ps, s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_are_those_of_all_pairs(spark, crowd, monkeypatch):
    rows = crowd + [(5000 + k, k % 3, crowd[k][2]) for k in range(0, 60)]  # equal scores, other labels
    want = slow_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    df = frame(spark, rows)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == want
    monkeypatch.setattr(hardnegatives, "STRIPE", 50)
    monkeypatch.setattr(hardnegatives, "GROUP", 7)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, positives=2, negatives=3)
    assert sorted(map(tuple, got.collect())) == slow_negatives(rows, lambda i: i % 10 == 0, 2, 3)


def test_no_anchors_and_no_rows(spark, crowd):
    assert hard_negatives(frame(spark, crowd), F.lit(False)).count() == 0
    assert hard_negatives(frame(spark, []), F.lit(True)).count() == 0
    assert hard_negatives(frame(spark, [(0, 1, [1.0, 0.0])]), F.lit(True)).count() == 0


def test_too_large_products_are_an_error(spark):
    rows = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [1.0]), (2, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(rows, F.lit(True)).count()


def test_packed_keys_sort_as_their_numbers():
    draw = random.Random(8)
    some = [-(2**63), -5, -1, 0, 1, 3, 2**63 - 1]
    rows = [(draw.choice(some), draw.choice([0, 1, 2**40]), draw.choice(some), draw.choice([0, 1]), draw.choice(some)) for _ in range(300)]
    by_key = sorted(rows, key=lambda r: hardnegatives.key(*r))
    assert by_key == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))


def test_windows_open_and_close_in_one_pass():
    rows = [(1, 9, 100, 0, 7), (1, 9, 100, 1, 3), (1, 9, 100, 0, 8), (1, 9, 90, 1, 4), (1, 9, 85, 0, 6), (1, 9, 80, 1, 5), (1, 9, 79, 1, 2), (1, 9, -4, 0, 1),
            (1, 9, -4, 1, 11), (2, 9, 0, 0, 1), (2, 9, 0, 1, 2)]
    keys = sorted(hardnegatives.key(*r) for r in rows)
    got = list(hardnegatives.mined([(k, None) for k in keys], 5, 2, (4, 5)))
    assert sorted(got) == [(1, 6, 1, 5, 85, 80), (1, 6, 2, 2, 85, 79), (1, 7, 1, 3, 100, 100), (1, 7, 2, 4, 100, 90), (1, 8, 1, 3, 100, 100), (1, 8, 2, 4, 100, 90),
                           (2, 1, 1, 2, 0, 0)]
