"""Mixing, packing, search, licences and the pipeline: brute force, SQL twins, and odd input."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare
from trackloom.llm import licences, mixing, packing, topk
from trackloom.llm.common import ENTRIES

TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_matches_sql(spark, sf, duck, name):
    got = ENTRIES[name].build(spark, sf).toPandas()
    assert compare(got, duck.execute(ENTRIES[name].sql).df()) == "" and len(got)


@pytest.mark.parametrize("name", ["op1_licences", "op4_mixing", "op5_pii", "op9_line_dedup"])
def test_native_operators_run_no_python(spark, sf, name):
    plan = ENTRIES[name].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


# Mixing

def slow_targets(sizes, weights, total, most):
    """Shares by weight; what is above a limit is shared out again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, free = total * sum(sizes.values()), {}, set(order)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] > most * sizes[s]}
        if not full:
            return out | share
        out |= {s: most * sizes[s] for s in full}
        left, free = left - sum(most * sizes[s] for s in full), free - full


def check_mix(df):
    rows = [tuple(r) for r in mixing.mix(df).select("row.source", "row.text", "size", "source_size", "target", "times").collect()]
    sizes = defaultdict(int)
    for s, t, n, *_ in rows:
        assert n == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
    want = slow_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = defaultdict(int)
    for s, _, n, all_, target, times in rows:
        assert all_ == sizes[s] and abs(target - want[s]) < 1e-3 and times in (0, 1, 2)
        taken[s] += n * times
    most = {s: max(n for x, _, n, *_ in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= max(1, most[s]) for s in sizes)
    return rows


def test_targets_and_tokens(docs, odd, no_docs):
    check_mix(docs)
    check_mix(odd)
    assert mixing.mix(no_docs).count() == 0


def test_reruns_and_orders_agree(docs):
    first = sorted(mixing.mix(docs).select("doc_id", "times").collect())
    assert first == sorted(mixing.mix(docs.repartition(7)).select("doc_id", "times").collect())
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and again.count() == sum(r.times for r in first)


def test_smaller_budgets_are_nested(docs):
    some = {r.doc_id: r.times for r in mixing.mix(docs, total=0.3).select("doc_id", "times").collect()}
    more = {r.doc_id: r.times for r in mixing.mix(docs, total=0.6).select("doc_id", "times").collect()}
    assert all(some[k] <= more[k] for k in some) and sum(some.values()) < sum(more.values())


# Packing

def test_tokens_of_parts_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    draw = np.random.default_rng(2)
    signs = [*"aAbBéÉèñÑüßÿÀ.,'’\"!?-_() \n\t\r\x0b\x0c\x1c\x85\xa0 ́ΣςİıKﬁ漢かな한🙂👍🏽0189½²ªº×÷", "'s", "'ll", "'D", " ", " ", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(draw.choice(signs, draw.integers(0, 50))) for _ in range(4000)] + ["", " ", "<|endoftext|> hello", "<|startoftext|>x", "<|EndOfText|>", "a<|endoftext", "x" * 3000]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert packing.Ids(TOKENIZER).of(texts) == want


@pytest.mark.parametrize("capacity, n", [(10, 40), (100, 500), (2048, 20000)])
def test_bins_hold_every_piece_once(capacity, n):
    draw = np.random.default_rng(n)
    counts = Counter(np.clip(draw.exponential(capacity * 0.3, n).astype(int), 1, capacity).tolist())
    groups = packing.filled(dict(counts), capacity)
    got = Counter()
    for bins, items in groups:
        assert bins > 0 and sum(x * k for x, k in items) <= capacity and sum(k for x, k in items if 3 * x > capacity) <= 2
        for x, k in items:
            got[x] += bins * k
    used, least = sum(b for b, _ in groups), -(-sum(x * k for x, k in counts.items()) // capacity)
    assert got == counts and least <= used <= least * 1.02 + 1
    assert packing.filled({}, capacity) == [] and packing.filled({capacity: 3}, capacity) == [(3, ((capacity, 1),))]


def check_packed(df, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    out = packing.pack(packing.token_pieces(df, TOKENIZER, capacity), capacity)
    rows = out.collect()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k // capacity, k, ids[k : k + capacity].tobytes()) for k in range(0, len(ids), capacity)]
    assert sorted(((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert least <= len(bins) <= 1.15 * least + 1
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(out).collect()}
    assert all(joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) for r in rows)


def test_packed_documents(docs, odd, no_docs):
    check_packed(docs, 2048)
    check_packed(odd, 64)
    assert packing.pack(packing.token_pieces(no_docs, TOKENIZER)).count() == 0


# Search

def check_top(df, k=20):
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding]
    rows = [(i, v) for i, v in rows if all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in rows), default=0)
    t = np.array([np.floor(64 * np.array([*v, *[0.0] * (dims - len(v))])) for _, v in rows]).astype(np.int64).reshape(len(rows), dims)
    want = []
    for n, (q, _) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-int(t[n] @ t[m]), c) for m, (c, _) in enumerate(rows) if c != q)[:k]
            want += [(q, rank, c, -s) for rank, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k).collect()) == sorted(want)


def test_top_k_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SHARD", 2)
    monkeypatch.setattr(topk, "GROUP", 8)
    draw = np.random.default_rng(1)
    middles = draw.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in middles[i % 6] + draw.normal(scale=0.1, size=8)]) for i in range(600)]
    check_top(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.25, -0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, []), (8, [3.0]), (None, [9.0, 9.0]), (40, [-1e6, 2.0]), (9, [0.0, 0.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_top(df)
    check_top(df, 2)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(None).cast("boolean")).count() == 0


# Licences

def test_headers_and_nearest_directories(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    body = "\n".join(f"plain words of line {k}" for k in range(12))
    rows = [("LICENSE", f"{body}\n{mit}\n{body}"), ("a/COPYING.txt", gpl), ("a/b/x.py", body), ("a/b/own.py", f"# {mit.lower()}\n{body}"),
            ("ab/x.py", body), ("a/hidden.py", f"{body}\n{mit}\n{body}"), ("a/b/c/LICENSE", body), ("a/b/c/y", None), (None, body), (None, gpl), ("z", ""), ("z", "")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit("clash"))
    got = Counter((r.path, r.licence, r.found, r.directory) for r in licences.file_licences(df).collect())
    assert got == Counter([
        ("LICENSE", "MIT", "header", None), ("a/COPYING.txt", "GPL-3.0", "header", None), ("a/b/x.py", "GPL-3.0", "inherited", "a"),
        ("a/b/own.py", "MIT", "header", None), ("ab/x.py", "MIT", "inherited", ""), ("a/hidden.py", "GPL-3.0", "inherited", "a"),
        ("a/b/c/LICENSE", "GPL-3.0", "inherited", "a"), ("a/b/c/y", "GPL-3.0", "inherited", "a"), (None, None, "none", None),
        (None, "GPL-3.0", "header", None), ("z", "MIT", "inherited", ""), ("z", "MIT", "inherited", "")])
    assert licences.file_licences(df.limit(0)).count() == 0


def test_windows_overlap_by_half(spark):
    lines = [[f"a{k}", f"b{k}"] for k in range(9)]
    got = spark.createDataFrame([(lines,)], "lines array<array<string>>").select(licences.windows("lines").alias("w")).first().w
    want = [sum(lines, [])] + [sum(lines[k : k + w], []) for w in licences.WINDOWS for k in range(0, 9, w // 2)]
    assert got == want


def test_texts_of_many_lines(spark):
    """Comments of thousands of lines, in ordinary files and licence files: time in proportion to the text, the statement found."""
    comment = "\n".join(f"# plain words of line {k} under no terms" for k in range(20_000))
    mit = "Released under the MIT License."
    rows = [("a/one.py", f"{comment}\n# {mit}\n# and more"), ("a/two.py", comment), ("b/LICENSE", f"{comment}\n{mit}\n{comment}"), ("b/x", "plain")]
    began = time.time()
    got = {r.path: (r.licence, r.found) for r in licences.file_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/one.py": ("MIT", "header"), "a/two.py": (None, "none"), "b/LICENSE": ("MIT", "header"), "b/x": ("MIT", "inherited")}
    assert time.time() - began < 60


def test_whole_headers_and_licence_files(spark):
    text = {p.stem: p.read_text() for p in licences.TEXTS.glob("*.txt")}
    apache = [t for k, t in licences.NOTICES if k == "Apache-2.0"][0].split()
    wrapped = "\n".join(" * " + " ".join(apache[k : k + 11]) for k in range(0, len(apache), 11))
    code = "\n".join(f"x{k} = call_{k}(y)" for k in range(60))
    gnu = licences.GNU_NOTICE.format(work="program", kind="General", version="2", upto="either ", later=", or (at your option) any later version", end=licences.GNU_ENDS[0]).split()
    lines = "\n".join("# " + " ".join(gnu[k : k + 12]) for k in range(0, len(gnu), 12))
    want = {
        "a/one.c": ("/*\n * Copyright 2019 The Some Authors\n *\n" + wrapped + "\n */\n\n" + code, "Apache-2.0"),
        "b/two.py": ("#!/usr/bin/env python\n# Copyright (C) 2020 J. Doe\n#\n" + lines + "\n\n" + code, "GPL-2.0"),
        "c/three.js": ("// SPDX-License-Identifier: MIT\n" + code, "MIT"),
        "c/four.c": ("/* SPDX-License-Identifier: GPL-2.0-or-later */\n" + code, "GPL-2.0"),
        "d/five.js": ("/*\n" + text["MIT"].replace("(c)", "(c) 2021 Some One") + "*/\n" + code, "MIT"),
        "e/LICENSE": (text["MIT"].split("\n", 2)[2], "MIT"), "f/COPYING": (text["GPL-3.0"], "GPL-3.0"), "g/LICENSE.txt": (text["Apache-2.0"], "Apache-2.0"),
        "h/COPYING": (text["GPL-2.0"], "GPL-2.0"), "i/LICENSE": (text["BSD-3-Clause"].replace("(c)", "(c) 2001, Regents"), "BSD-3-Clause"),
        "j/LICENSE": (text["BSD-2-Clause"], "BSD-2-Clause"), "k/NOTICE": (code + "\n\n" + text["ISC"] + "\n\n" + code, "ISC"),
        "l/plain.py": ("# A tool for the public, version 2 of it\n" + code, None), "n/de.txt": ("Der chlichst imc\nMit.\nUniversal\nDie Zeit.", None),
        "m/late.py": (code + "\n\n" + text["MIT"] + "\n" + code, None)}
    got = licences.file_licences(spark.createDataFrame([(k, t) for k, (t, _) in want.items()], "path string, text string")).collect()
    assert {r.path: r.licence for r in got} == {k: v for k, (_, v) in want.items()}


# Pipeline

def test_stages_keep_clean_documents(spark, sf, docs):
    words = np.random.default_rng(8).choice([f"word{k}" for k in range(3000)], (40, 200))
    clean = [(10_000 + k, " ".join(w)) for k, w in enumerate(words)]
    copies = [(20_000 + k, clean[0][1].replace("word", "word", 1) + ("" if k % 2 else f" tail{k}")) for k in range(5)]
    extra = spark.createDataFrame([(i, t, "en", f"src{i % 20}", len(t)) for i, t in clean + copies], docs.schema)
    now = docs.unionByName(extra)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, sf).toArrow())
        seen.append(name)
        if name != "packing":
            assert now.columns == docs.columns
        if name in ("toxicity", "line_dedup"):
            assert {i for i, _ in clean} <= {r.doc_id for r in now.collect()}
        if name == "near_dedup":
            left = {r.doc_id for r in now.collect()}
            assert {i for i, _ in clean} <= left and not {i for i, _ in copies} & left
    assert seen == ["toxicity", "line_dedup", "near_dedup", "mixture", "packing"] and now.count() > 0


def test_stages_take_odd_and_empty_documents(spark, sf, odd, no_docs):
    for df in (odd.withColumn("n_chars", F.length("text")), no_docs.withColumn("n_chars", F.lit(0).cast("long"))):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            after = spark.createDataFrame(stage(spark, now, sf).toArrow())
            assert name == "packing" or after.columns == df.columns
            now = after


def test_run_gives_packed_pieces(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert zlib.crc32(bytes(out.first().ids)) >= 0


def test_tokens_do_not_depend_on_what_a_worker_remembers(monkeypatch):
    from tokenizers import Tokenizer

    draw = np.random.default_rng(3)
    texts = [" ".join("".join(draw.choice(list("abcé'1!"), 4)) for _ in range(50)) + " x\x0b漢 don't" for _ in range(40)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "REMEMBERED", 150)
    ids = packing.Ids(TOKENIZER)
    assert packing.worker_ids(TOKENIZER) is packing.worker_ids(TOKENIZER) and ids.encoder is packing.Ids(TOKENIZER).encoder
    for _ in range(2):
        assert [x for k in range(0, 40, 3) for x in ids.of(texts[k : k + 3])] == want
    learnt = []
    monkeypatch.setattr(ids, "learn", lambda parts, whole: learnt.append(parts))
    assert ids.of(texts[-1:]) == want[-1:] and learnt == [set()]
