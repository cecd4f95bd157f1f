"""Near duplicates, lines and chunks against brute force, and on odd input."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import chunking, linededup, simhash
from trackloom.llm.components import components


def slow_fingerprint(text, words):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """id -> smallest id reachable, ids and fingerprints given as pairs"""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        least[find(k)].append(i)
    return [min([x for x in least[find(k)] if x is not None], default=None) for k in range(len(prints))]


def check_linked(df):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    prints = [(i, slow_fingerprint(t, 3)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, slow_components(prints))), key=str)
    assert sorted([tuple(r) for r in simhash.linked_documents(df).collect()], key=str) == want


def test_fingerprints_and_components(docs):
    check_linked(docs)


def test_odd_documents_link_by_the_same_rule(odd, no_docs):
    check_linked(odd)
    assert simhash.linked_documents(no_docs).count() == 0


def test_keys_cover_every_pair_within_the_limit():
    draw = np.random.default_rng(3)
    keys = simhash.lossless_keys(3)
    assert len(keys) == 10 and simhash.lossless_keys(3, 6) and len(simhash.lossless_keys(3, 6)) == 20
    for _ in range(2000):
        flips = set(draw.choice(64, 3, replace=False).tolist())
        assert any(not flips & set(k) for k in keys)


def test_links_of_a_crowded_key(spark, monkeypatch):
    """Thousands of fingerprints that agree on most bits: few links, every component whole, also when a key is dealt out."""
    draw = np.random.default_rng(5)
    base = int(draw.integers(0, 2**62))
    prints = sorted({base ^ int(sum(1 << int(b) for b in draw.choice(24, draw.integers(0, 9), replace=False))) for _ in range(1500)})
    want = slow_components([(p, p) for p in prints])
    for part in (8192, 200):
        monkeypatch.setattr(simhash, "PART", part)
        nodes = spark.createDataFrame([(p, p) for p in prints], "node long, f0 long")
        links = simhash.near_links(nodes, 3, simhash.lossless_keys(3))
        assert links.count() < 60 * len(prints)
        found = {r.node: r.root for r in components(links).collect()}
        assert [found.get(p, p) for p in prints] == want


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, odd, no_docs):
    words = [f"w{k}" for k in range(300)]
    near = words[:150] + ["changed"] + words[151:]
    far = [f"v{k}" for k in range(300)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (4, " ".join(far)), (8, ""), (6, None), (4, " ".join(far))]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 6]
    left = simhash.one_of_each_group(odd)
    assert left.columns == odd.columns and sorted([r.doc_id for r in left.collect()], key=str) == sorted([1, 2, 5, 6, 7, 7, 8, 9, 10, None], key=str)
    assert simhash.one_of_each_group(no_docs).columns == no_docs.columns


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_covered_against_all_pairs(spark):
    """Two classes: one of random sets around a few centres, with distances on both sides of the threshold, one of copies."""
    draw = random.Random(4)
    centres = [draw.sample(range(10**6), 60) for _ in range(6)]
    sets = {}
    for n in range(200):
        own = list(centres[n % 6])
        for k in range(draw.randrange(0, 16)):
            own[draw.randrange(60)] = 10**7 + 100 * n + k
        sets[n] = frozenset(own)
    sets.update({n: frozenset(centres[0]) for n in range(300, 330)})
    root = lambda n: 0 if n < 300 else 300
    rows = [(n, root(n), (False, n, n), sorted(s)) for n, s in sets.items()]
    schema = "node long, root long, best struct<none: boolean, doc_id: long, uid: long>, s array<long>"
    gone = {r.node for r in simhash.covered(spark.createDataFrame(rows, schema), 0.8).collect()}
    kept = sorted(set(sets) - gone)
    assert [n for n in kept if n >= 300] == [300] and 0 in kept
    for n in kept:
        assert not any(m != n and root(m) == root(n) and jaccard(sets[m], sets[n]) >= 0.8 for m in kept)
    for n in gone:
        assert any(root(m) == root(n) and jaccard(sets[m], sets[n]) >= 0.8 for m in kept)
    assert simhash.covered(spark.createDataFrame([], schema), 0.8).collect() == []


def test_only_documents_alike_to_one_that_stays_go(spark):
    """Chains of ever more changed documents: what goes has a partner at 0.8, what is below stays."""
    draw = random.Random(8)
    rows = []
    for group in range(30):
        words = [f"g{group}w{k}" for k in range(250)]
        for step in range(8):
            rows.append((len(rows), " ".join(words)))
            for _ in range(2 + group % 6):
                words[draw.randrange(250)] = f"x{len(rows)}y{draw.randrange(10**6)}"
    shingles = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    kept = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = lambda i: [j for j in range(i // 8 * 8, i // 8 * 8 + 8) if j != i and jaccard(shingles[i], shingles[j]) >= 0.8]
    assert all(kept & set(near(i)) for i in shingles if i not in kept)
    missed = [i for i in kept if kept & set(near(i))]
    assert len(missed) <= 4 and 30 <= len(kept) < 200


# Lines

def slow_lines(rows, least):
    sites, first = defaultdict(set), {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t, s in order:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" \t\n\r\x0b\x0c"):
                if s is not None:
                    sites[line.strip(" ")].add(s)
                first.setdefault(line.strip(" "), (i, k))
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        own = t.split("\n")
        keep = [x for k, x in enumerate(own) if not x.strip(" \t\n\r\x0b\x0c") or len(sites[x.strip(" ")]) < least or first[x.strip(" ")] == (i, k)]
        out.append((i, "\n".join(keep), len(own), len(own) - len(keep)))
    return sorted(out, key=str)


def test_spread_lines_go_but_for_the_first(docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    for least in (2, 8):
        got = linededup.without_spread_lines(docs, least).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted([tuple(r) for r in got], key=str) == slow_lines(rows, least)
    assert linededup.without_spread_lines(no_docs).count() == 0


def test_lines_of_odd_documents(odd):
    got = linededup.without_spread_lines(odd, 2)
    assert got.count() == odd.count() and got.select("row.*").columns == odd.columns
    by_id = defaultdict(set)
    for r in got.collect():
        by_id[r.doc_id].add((r.text, r.n_removed))
    assert by_id[2] == {(None, 0)} and by_id[3] == {("", 0)} and by_id[4] == {(" \t\n ", 0)} and by_id[7] == {("one line\nend", 0), ("one line\nother end", 0)}


def test_estimates_far_from_the_threshold_are_not_counted(spark):
    rows = [(i, "shared line\nown " + str(i), f"site{i % 500}") for i in range(2000)] + [(5000 + i, "rare line", f"site{i}") for i in range(9)]
    got = linededup.without_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10)
    assert got.agg(F.sum("n_removed")).first()[0] == 1999


def test_documents_are_shuffled_whatever_few_lose_lines(spark):
    """A join that is a broadcast on small tables only would have the shuffle grow faster than the input."""
    rows = [(i, "shared line\nown " + str(i), f"site{i}") for i in range(20)]
    got = linededup.without_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and got.agg(F.sum("n_removed")).first()[0] == 19


# Chunks

def test_boundaries_move_with_the_text():
    draw = np.random.default_rng(1)
    text = bytes(draw.choice(list(b"abcdefgh  "), 20000).tolist())
    own, shifted = chunking.fingerprint(text), chunking.fingerprint(b"some other start of it " + text)
    assert b"".join(chunking.chunks(text)) == text
    assert chunking.containment(own, shifted) > 0.98 and chunking.containment(own, chunking.fingerprint(text[::-1])) < 0.05
    sizes = [len(c) for c in chunking.chunks(text)[:-1]]
    assert chunking.LEAST <= min(sizes) and max(sizes) <= chunking.MOST and 20 < np.mean(sizes) < 50


def check_neighbours(df):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(
        F.col("doc_id").desc_nulls_last(), "h").collect()]
    want = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        f = [chunking.fingerprint(x.encode()) for x in (t, e, n)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), chunking.written(f[0]), chunking.written(f[1]),
                     chunking.containment(f[0], f[1]), chunking.containment(f[0], f[2])))
    got = [tuple(r) for r in chunking.neighbour_fingerprints(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours_in_descending_order(docs):
    check_neighbours(docs)


def test_neighbours_of_odd_documents(spark, odd, no_docs):
    check_neighbours(odd)
    check_neighbours(odd.limit(1))
    check_neighbours(spark.createDataFrame([(None, "a b c"), (None, "d")], "doc_id long, text string"))
    assert chunking.neighbour_fingerprints(no_docs).count() == 0


def test_large_classes_end_as_in_one_task(spark, monkeypatch):
    """Classes of unlike members take a few rounds whatever their size; the joins of large ones and the task of small ones agree."""
    draw = random.Random(5)
    rows = [(n, n % 2, (n % 9 == 0, None if n % 9 == 0 else n // 2, n), sorted(draw.sample(range(14), 3))) for n in range(300)]
    schema = "node long, root long, best struct<none: boolean, doc_id: long, uid: long>, s array<long>"
    df = spark.createDataFrame(rows, schema)
    written = []
    monkeypatch.setattr(simhash, "lookup", lambda f, name, own=simhash.lookup: written.append(name) or own(f, name))
    want = sorted(r.node for r in simhash.covered(df, 0.5).collect())
    assert written == ["class-sizes", "settled"] and 100 < len(want) < 290
    monkeypatch.setattr(simhash, "WIDEST", 16)
    assert sorted(r.node for r in simhash.covered(df, 0.5, small=100).collect()) == want
    sets = {n: set(s) for n, _, _, s in rows}
    kept = set(sets) - set(want)
    near = {n: any(m != n and m % 2 == n % 2 and jaccard(sets[m], sets[n]) >= 0.5 for m in kept) for n in sets}
    assert near == {n: n in set(want) for n in sets}
