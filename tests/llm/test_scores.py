"""Classifiers and personal data: contracts, held-out accuracy, and odd input."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import pii, quality, queries, toxicity
from trackloom.llm.common import fold, labelled_sample, logistic_fit

# Held-out accuracy on the tables


def held_out(spark, sf_dir, query, label):
    got = query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    y = np.array([r[label] for r in got])
    return y, np.array([r.score for r in got]), np.array([r.predicted for r in got])


def area(y, score):
    good, bad = score[y == 1], score[y == 0]
    return ((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2


def test_toxicity_of_held_out_documents(spark, sf):
    y, score, said = held_out(spark, sf.replace("sf0.001", "sf0.1"), queries.op2, "toxic")
    assert area(y, score) > 0.9 and said[y == 1].mean() > 0.65 and said[y == 0].mean() < 0.01


def test_quality_of_held_out_documents(spark, sf):
    y, score, said = held_out(spark, sf.replace("sf0.001", "sf0.1"), queries.op3, "quality")
    assert area(y, score) > 0.99 and said[y == 1].mean() > 0.98 and said[y == 0].mean() < 0.1


@pytest.mark.parametrize("query, parts, kept", [(queries.op2, 3, 1), (queries.op3, 4, 2)])
def test_score_columns(spark, sf, query, parts, kept):
    rows = query(spark, sf).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == kept) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [toxicity.fit_toxicity(docs, x, lambda i: queries.remainder(i, 3) != 1) for x in (labels, turned)]
    assert models[0].toxic == models[1].toxic and models[0].ordinary == models[1].ordinary and (models[0].weights == models[1].weights).all()


# Models by themselves

draw = random.Random(4)
SYLLABLES = "ka lo mi ne ru sa ti vo be do".split()


def prose(n):
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4))) for _ in range(n))


def test_compression_tells_texts_with_marked_words():
    clean = [prose(60).encode() for _ in range(400)]
    marked = [f"{prose(30)} {draw.choice(['grumpzwurf', 'fhlextorg', 'xyqqualm'])} {prose(30)}".encode() for _ in range(200)]
    model = toxicity.fit(marked[:150], clean[:300])
    assert (model.score(marked[150:]) >= 0.7).mean() > 0.9 and (model.score(clean[300:]) >= 0.7).mean() < 0.02
    assert model.savings(b"") == [] and model.score([b"", b"", b"a"]).tolist() == [model.score([b""])[0]] * 3


@pytest.mark.parametrize("fit", [toxicity.fit, quality.fit])
def test_classes_without_texts(fit):
    for a, b in (([], []), ([b"a b"], []), ([], [b"a b"]), ([b"a b"], [b"a b"])):
        assert ((0 <= (s := fit(a, b).score([b"", b"some text"]))) & (s <= 1)).all()


def test_prior_and_risk_of_mixed_web_text():
    good = [prose(80).encode() for _ in range(3000)]
    junk = [" ".join([f"{prose(1)}{k}"] * 80).encode() for k in range(900)]
    model = quality.fit(good[:1500], good[1500:] + junk)
    assert 0.5 < model.prior < 0.65  # 1,500 of 2,400
    assert (model.score(good) > 0.7).mean() > 0.9 and (model.score(junk) > 0.7).mean() < 0.03


def test_logistic_fit_stays_finite():
    x = np.array([[1.0, -1], [1, 1]])
    w = logistic_fit(x, np.array([0.0, 1.0]))
    assert np.isfinite(w).all() and w[1] > 0 and fold(b"x", 4) == zlib.crc32(b"x") % 4


@pytest.mark.parametrize("add, fit, name", [(toxicity.with_toxicity, toxicity.fit, "toxic"), (quality.with_quality, quality.fit, "good")])
def test_odd_documents_have_scores(spark, odd, no_docs, add, fit, name):
    model = fit([prose(40).encode() for _ in range(40)], [prose(20).upper().encode() for _ in range(40)])
    got = add(odd, model)
    assert got.count() == odd.count() and got.select("row.*").columns == odd.columns
    by_text = {}
    for r in got.select("row.text", "score").collect():
        assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
    assert add(no_docs, model).count() == 0 and add(odd, model, whole=False).columns == ["doc_id", "score"]


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def slow_base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def check_base(df):
    got = pii.personal_data(df).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()
    want = [(r.doc_id, ",".join(slow_base(r.text))) for r in df.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_base_spans_of_random_texts(spark):
    bits = ["a.b", "@", "x-y", ".", "com", " ", "+1", "(375)", "555-4393", "10.0.0.", "255", "256", "0007", "4111 1111 1111 1111", "-", "é", "😀", "1", "12", "\n", "_", "%"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    texts += ["a@b.c_x@y.z", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "9" * 4000, "a" * 50000, "+1" + "(" * 5000, "x@" + "a." * 20000 + "b", "1." * 30000, "1 " * 30000]
    check_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_personal_data_of_odd_documents(odd, no_docs):
    check_base(odd)
    assert pii.personal_data(no_docs).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    known = [(k, f"{prose(5)} reach me at user{k}@mail{k}.example.org today {prose(5)}") for k in range(40)]
    known += [(50 + k, f"{prose(3)} the number 4{k} is {prose(3)}") for k in range(20)]
    new = [(100, f"{prose(4)} reach me at (chief#7@intranet), today {prose(4)}"), (101, f"{prose(4)} the number 99 is {prose(4)}")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(known + new, "doc_id long, text string")).collect()}
    text = new[0][1]
    found = [text[s.start : s.end] for s in got[100].spans]
    assert found == ["chief#7@intranet"] and got[100].spans[0].context and not got[100].base
    assert not got[101].spans and all(len(got[k].spans) == 1 for k in range(40))


def test_one_trusted_pattern_suffices(spark):
    """A fixed context on the left with other words on the right each time; a number that mostly stands elsewhere is left out."""
    known = [(k, f"word{'abcdefghij'[k % 10]} reach me at user{k}@mail{k}.example.org next{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]} end") for k in range(40)]
    other = [(50 + k, f"so the number 77 is here {prose(3)}") for k in range(20)]
    new = [(100, "please reach me at chief#7@intranet whenever"), (101, "please reach me at 77 whenever")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(known + other + new, "doc_id long, text string")).collect()}
    assert [new[0][1][s.start : s.end] for s in got[100].spans] == ["chief#7@intranet"] and not got[101].spans and not got[50].spans


def test_half_of_unseen_identifiers_among_noise(spark):
    """Seeds and unseen identifiers in three contexts, with words of every kind around them and other numbers elsewhere."""
    asks = ["write to {}", "my handle is {}", "ask for {} at the desk"]
    rows, hidden = [], {}
    for k in range(400):
        near = asks[k % 3].format(f"user{k}@mail{k}.example.org" if k % 4 else f"nick#{k}@inside")
        rows.append((k, f"{prose(8)} {near} {prose(8)} {k} {prose(2)} room {k % 50}"))
        if not k % 4:
            hidden[k] = f"nick#{k}@inside"
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k: [rows[k][1][s.start : s.end] for s in got[k] if s.context] for k in range(400)}
    assert sum(v in found[k] for k, v in hidden.items()) >= len(hidden) / 2
    assert sum(len(v) for v in found.values()) <= 1.05 * sum(v in found[k] for k, v in hidden.items())


def slow_trust(words, rounds, support, trust):
    """The pattern graph by dictionaries: (value, patterns, kind or None) of each word -> value -> kind."""
    seeds = {}
    for v, _, kind in words:
        if kind is not None:
            seeds[v] = max(seeds.get(v, kind), kind)
    kinds = sorted({k for k in seeds.values()})
    of, seen = {}, {}
    for v, patterns, kind in words:
        for p in patterns:
            of.setdefault(p, []).append(v)
            if kind is not None:
                seen.setdefault((p, v), set()).add(kind)
    best = {pv: max(ks) for pv, ks in seen.items()}
    rich = {(p, k) for p in of for k in kinds if sum(1 for (q, v), own in best.items() if q == p and own == k) >= support}
    now = {(v, k): 1.0 for v, k in seeds.items()}
    for _ in range(rounds):
        belief = {(p, k): sum(now.get((v, k), 0.0) for v in of[p]) / (len(of[p]) + 1) for p, k in rich if any((v, k) in now for v in of[p])}
        fresh = {}
        for v in {v for v, _, _ in words} - set(seeds):
            own = [ps for w, ps, _ in words if w == v]
            for k in kinds:
                told = [max([belief[p, k] for p in ps if (p, k) in belief], default=None) for ps in own]
                if any(t is not None for t in told):
                    fresh[v, k] = sum(t or 0.0 for t in told) / len(own)
        now = {**{(v, k): 1.0 for v, k in seeds.items()}, **fresh}
    taken = {}
    for (v, k), t in sorted(now.items(), key=lambda x: (-x[1], x[0][1])):
        if v not in seeds and t >= trust:
            taken.setdefault(v, k)
    return taken


def test_graph_scores_by_brute_force(spark):
    import random

    draw = random.Random(12)
    words = []
    for _ in range(700):
        v, p = draw.randrange(120), draw.randrange(12)
        kind = v % 2 if v < 60 else None
        p = p if v % 5 == 0 else (p % 4 + 4 * (v % 2))  # most values keep to the patterns of their kind
        words.append((f"v{v}", [f"a{p}", f"b{draw.randrange(9)}"], kind))
    df = spark.createDataFrame(words, "value string, patterns array<string>, kind int")
    sizes = set()
    for trust in (0.3, 0.5, 0.8):
        want = slow_trust(words, 3, 3, trust)
        assert {r.value: r.kind for r in pii.scored_values(df, 3, 3, trust).collect()} == want
        sizes.add(len(want))
    assert len(sizes) > 1 and max(sizes) > 5


def test_many_candidates_in_one_text(spark):
    """40,000 candidates of one text: places by brute force, time in proportion."""
    text = " ".join(f"w{k} 10.0.{k % 256}.{k % 100}" for k in range(20_000))
    began = time.time()
    check_base(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert time.time() - began < 60


def test_digest_columns(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5(spark, sf).collect():
        base = slow_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in PATTERNS]


def test_an_id_with_many_rows_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "kept " * 30_000)] * 50 + [(k, f"text {k} " * 5) for k in range(2, 30)] + [(40, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(1, 41)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, lambda i: i > 0, {1: 10, 0: 100}, "doc_id", "text", "toxic")
    assert len(got) == len(set(got)) and sum(y for _, y in got) <= 10 and (b"", 0) in got
    whole = labelled_sample(docs, labels, lambda i: i == 1, {1: 10}, "doc_id", "text", "toxic")
    assert whole == [(b"kept " * 30_000, 1)]
    quality_labels = labels.withColumnRenamed("toxic", "quality")
    models = [quality.fit_quality(d, quality_labels, lambda i: i > 0, web=20) for d in (docs, docs.unionByName(docs))]
    assert (models[0].weights == models[1].weights).all()
