"""SimHash fingerprints, and links between near ones found with pivot distance tables.

A *pivot table* holds a fingerprint's Hamming distances to reference fingerprints. Two fingerprints at distance d differ
by at most d in every coordinate, so a pair whose largest coordinate difference exceeds the limit is discarded unseen.
The references are of two kinds. Those with a single bit, against the empty one, give the bits themselves; their
coordinates, taken some at a time, are the keys that bring candidates together. Pseudo-random ones order the
fingerprints within a key and discard pairs; survivors are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import batches, packed, texts_in_python, tidy, utf8
from trackloom.llm.components import components
from trackloom.session import lookup, materialised

SEED = 42
PIVOTS = 32
#: Rows of one key that a task compares; keys with more are dealt out as pairs of parts.
PART = 8192
#: Heads of one class in a round at most.
WIDEST = 1024


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """A hash of each shingle, repeats included; of fewer words the whole sequence is one, and no words have none."""
    w = text.lower().split()
    starts = range(max(1, len(w) - words + 1) if w else 0)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in starts), "<u8", len(starts))


def fingerprint(text: bytes, words: int, lanes: int, repeats: bool = True) -> np.ndarray:
    """``lanes`` 64-bit words: a bit is 1 if set in over half the hashes of the shingles, each counted once without ``repeats``."""
    h = shingle_hashes(text, words)
    h = h if repeats else np.unique(h)
    if not len(h):
        return np.zeros(lanes, "<u8")
    out = np.empty(lanes, "<u8")
    for k in range(lanes):
        ones = np.zeros(64, np.int64)
        for start in range(0, len(h), 255):  # 255 bits fit one byte, so eight columns are summed at a time
            bits = np.unpackbits(h[start : start + 255].view(np.uint8), bitorder="little").view("<u8").reshape(-1, 8)
            ones += bits.sum(axis=0, dtype="<u8").view(np.uint8)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
        h = mixed(h)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits for every hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def with_fingerprints(rows: DataFrame, words: int, lanes: int = 1, repeats: bool = True) -> DataFrame:
    """Columns of ``rows`` with ``text`` replaced by ``f0`` ... (signed 64-bit words). Null text counts as empty."""
    keep = [c for c in rows.columns if c != "text"]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                f = np.stack([fingerprint(t, words, lanes, repeats) for t in utf8(b.column("text"))]).view("<i8")
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(f[:, k]) for k in range(lanes)],
                                                 names=keep + [f"f{k}" for k in range(lanes)])

    schema = rows.select(*keep).schema
    for k in range(lanes):
        schema = schema.add(f"f{k}", "long")
    return texts_in_python(rows, run, schema)


def lossless_keys(limit: int, blocks: int = 5) -> list[list[int]]:
    """Bits of one word per key, so that any two fingerprints within ``limit`` bits agree on at least one key.

    The 64 bits are cut into ``blocks`` runs; at most ``limit`` runs can differ, so some ``blocks - limit`` agree. More
    blocks make more and longer keys: 5 suit up to about 10^8 fingerprints, 6 or 7 more.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    runs = [range(edges[k], edges[k + 1]) for k in range(blocks)]
    return [[b for r in c for b in r] for c in combinations(runs, blocks - limit)]


def sampled_keys(lanes: int, bits: int, keys: int) -> list[list[int]]:
    """Random bits of all words per key, for limits that no exact cover by keys can serve."""
    draw = np.random.default_rng(SEED)
    return [sorted(draw.choice(64 * lanes, bits, replace=False).tolist()) for _ in range(keys)]


def references(lanes: int, count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED + 1).integers(0, 2**63, (count, lanes, 2), dtype=np.uint64) @ np.array([1, 2], np.uint64)


def pivot_table(f: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Distances of the fingerprints (rows x words) to the references: rows x references."""
    return np.stack([np.bitwise_count(f ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)


def spanning_links(bucket: np.ndarray, f: np.ndarray, node: np.ndarray, refs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within each bucket; rows come ordered by bucket and first coordinate.

    Neighbours in this order are compared first, then those two apart, and so on while their first coordinates differ by
    ``limit`` at most. Pairs that earlier links connect are skipped, so the links are fewer than the rows.
    """
    n = len(bucket)
    d = pivot_table(f, refs)
    first = d[:, 0]
    root, links = np.arange(n), []
    i, step = np.arange(n - 1), 1
    while True:
        i = i[i + step < n]
        i = i[(bucket[i] == bucket[i + step]) & (first[i + step] - first[i] <= limit)]
        if not len(i):
            return links
        a = i[root[i] != root[i + step]]
        if len(a):
            a = a[np.abs(d[a] - d[a + step]).max(axis=1) <= limit]
            a = a[np.bitwise_count(f[a] ^ f[a + step]).sum(axis=1, dtype=np.int64) <= limit]
            for x in a.tolist():
                u, v = x, x + step
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                if u != v:
                    root[max(u, v)] = min(u, v)
                    links.append((int(node[x]), int(node[x + step])))
            while len(a) and (root[root] != root).any():
                root = root[root]
        step += 1


def near_links(nodes: DataFrame, limit: int, keys: list[list[int]], lanes: int = 1) -> DataFrame:
    """``node``, ``f0`` ... (distinct fingerprints) -> ``a``, ``b``: links at ``limit`` differing bits or fewer.

    Every component of linked fingerprints that share keys is connected by the links returned; links within an already
    connected part of a key are left out, so that a group of n near copies gives no n^2 rows. ``nodes`` should be a written table: it is
    read twice where a key has very many rows.
    """
    refs = references(lanes)
    names = [f"f{k}" for k in range(lanes)]
    kept = [np.array(k) for k in keys]

    def spread(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big, 4096):
                f = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).view("<u8")
                bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
                first = np.bitwise_count(f ^ refs[0]).sum(axis=1, dtype=np.int32)
                for t, own in enumerate(kept):
                    key = bits[:, own].astype(np.int64) @ (np.int64(1) << np.arange(len(own), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(key * len(kept) + t), b.column("node"), pa.array(first)]
                                                     + [b.column(c) for c in names], names=["bucket", "node", "first", *names])

    lanes_sql = ", ".join(f"{c} long" for c in names)
    rows = nodes.select("node", *names).mapInArrow(spread, f"bucket long, node long, first int, {lanes_sql}")
    full = materialised(rows.groupBy("bucket").count().where(F.col("count") > PART).select(
        "bucket", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "full-keys")
    rows = rows.join(full, "bucket", "left") if full.take(1) else rows.withColumn("parts", F.lit(None).cast("int"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(part, o) * F.col("parts") + F.greatest(part, o)))
    rows = rows.withColumn("pair", F.explode(pairs)).drop("parts")

    def compare(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def linked(t: pa.Table) -> pa.RecordBatch:
            col = lambda c: t.column(c).to_numpy()
            same = np.concatenate([[True], (col("bucket")[1:] != col("bucket")[:-1]) | (col("pair")[1:] != col("pair")[:-1])])
            f = np.stack([col(c) for c in names], axis=1).view("<u8")
            out = np.array(spanning_links(np.cumsum(same), f, col("node"), refs, limit), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

        for b in it:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            bucket, pair = t.column("bucket").to_numpy(), t.column("pair").to_numpy()
            last = (bucket == bucket[-1]) & (pair == pair[-1]) if len(bucket) else np.zeros(0, bool)
            cut = int(np.argmax(last)) if last.any() else 0
            rest = t.slice(cut)
            if cut:
                yield linked(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield linked(rest)

    ordered = rows.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "first")
    return ordered.mapInArrow(tidy(compare), "a long, b long").distinct()


def linked_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, limit: int = 3, blocks: int = 5) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every row.

    Documents link when their 64-bit fingerprints differ in at most ``limit`` bits, and ``component_id`` is the smallest id
    reachable. No link is lost: the keys cover every pair. Null and empty texts have fingerprint zero and link like others.
    Rows with equal ids are documents of their own; a null id counts as larger than all, and is the component's only where
    no other is there.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = materialised(with_fingerprints(rows, words), "fingerprints")
    nodes = materialised(prints.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("f0")), "distinct-prints")
    groups = components(near_links(nodes, limit, lossless_keys(limit, blocks)))
    named = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialised(named.select("node", "root", "least"), "named-prints")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialised(named.join(ids, "root").select(F.col("node").alias("f0"), "component_id"), "component-ids")
    return prints.join(named, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def with_shingles(rows: DataFrame, words: int) -> DataFrame:
    """Columns of ``rows`` with ``text`` replaced by ``s``: the distinct hashes of its shingles."""
    keep = [c for c in rows.columns if c != "text"]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big, 64):
                sets = pa.array([np.unique(shingle_hashes(t, words)).view("<i8") for t in utf8(b.column("text"))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [sets], names=[*keep, "s"])

    return texts_in_python(rows, run, rows.select(*keep).schema.add("s", T.ArrayType(T.LongType())))


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Jaccard similarity of two sets without repeats, from ``similarity``; sets too unequal in size are not compared."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    reached = both * (1 + similarity) >= similarity * (small + large) - 1e-9
    return F.when(small >= similarity * large - 1e-9, reached).otherwise(F.lit(False))


def settled(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray, dealt: np.ndarray, similarity: float, parts: int, most: int) -> np.ndarray:
    """Which members of one class go: the rounds of ``covered`` from ``parts`` parts on.

    ``flat`` holds the members' sets one after the other, ``sizes`` their sizes; ``order`` is a member's place by ``best`` and
    ``dealt`` the hash that deals it to a part. What a head has in common with the others is counted over the members
    that each of its shingles is in, so members without a common shingle cost nothing.
    """
    n = len(sizes)
    number = np.unique(flat, return_inverse=True)[1]
    of = np.repeat(np.arange(n), sizes)
    by_shingle = np.argsort(number, kind="stable")
    holders, ends = of[by_shingle], np.cumsum(np.bincount(number)) if len(number) else np.zeros(0, np.int64)
    edges, own = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(sizes)])

    def near(k: int) -> np.ndarray:
        lists = [holders[edges[x] : edges[x + 1]] for x in number[own[k] : own[k + 1]].tolist()]
        both = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        small, large = np.minimum(sizes, sizes[k]), np.maximum(sizes, sizes[k])
        out = (both * (1 + similarity) >= similarity * (small + large) - 1e-9) & (small >= similarity * large - 1e-9)
        out[k] = False
        return out

    left, gone = np.argsort(order), np.zeros(n, bool)
    while len(left) > 1:
        heads = left[np.sort(np.unique(dealt[left] % parts, return_index=True)[1])]
        found = [near(k) for k in heads.tolist()]
        stays = [not any(found[j][k] for j in range(i)) for i, k in enumerate(heads.tolist())]
        goes = np.zeros(n, bool)
        for own_near, stay in zip(found, stays):
            goes |= own_near & stay
        goes_now = np.zeros(n, bool)
        goes_now[left] = goes[left]
        gone |= goes_now
        goes_now[heads[stays]] = True
        left, parts = left[~goes_now[left]], min(parts * 4, most)
    return gone


def settle(members: DataFrame, similarity: float, parts: int, most: int) -> DataFrame:
    """``node`` of what goes of ``members`` whose classes are small enough for a task: each class is read by one."""
    def run(t: pa.Table) -> pa.Table:
        sets = t.column("s").combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy())
        flat = sets.flatten().to_numpy(zero_copy_only=False)
        # a null id stands last, as in ``best``; Python cannot compare it
        best = [(b["none"], 0 if b["none"] else b["doc_id"], b["uid"]) for b in t.column("best").to_pylist()]
        order = np.argsort(sorted(range(len(best)), key=best.__getitem__))
        gone = settled(flat, sizes, order, t.column("dealt").to_numpy(), similarity, parts, most)
        return pa.table({"node": t.column("node").filter(pa.array(gone))})

    rows = members.select("root", "node", "s", "best", F.xxhash64("node").alias("dealt"))
    return rows.groupBy("root").applyInArrow(run, "node long")


def covered(members: DataFrame, similarity: float, most: int = 16, small: int = 4096, hashes: int = 1 << 21) -> DataFrame:
    """``node`` of all ``members`` (``node``, ``root``, ``best``, ``s``) that are alike to one of their class that stays.

    A round takes heads of each class, in the first round its smallest ``best``, later the smallest of each of 4 and then ``most``
    parts by hash. A head that is not alike to a smaller head stays; members alike to one that stays go. The others go
    into the next round, until no class has two left. So no two that stay are alike, and none goes without its partner.

    Classes of ``small`` members and ``hashes`` shingles at most go through their rounds in one task. Larger ones go through them as
    joins, one class in many tasks, until they are as small; they have up to a sixteenth of their members as heads, so
    that the rounds grow with the logarithm of the class and not with it (from ``WIDEST`` heads on, with the class again).
    """
    now, parts, gone = members, 1, None
    while True:
        sizes = lookup(now.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("held")).where("n > 1"), "class-sizes")
        fits = (F.col("n") <= small) & (F.col("held") <= hashes)
        goes = lookup(settle(now.join(sizes.where(fits).select("root"), "root", "left_semi"), similarity, parts, most), "settled")
        gone = goes if gone is None else gone.unionByName(goes)
        if not sizes.where(~fits).take(1):
            return gone
        wide = F.lit(parts) if parts < most else F.greatest(F.lit(parts), F.least(F.ceil(F.col("n") / 16), F.lit(WIDEST))).cast("int")
        wide = sizes.where(~fits).select("root", wide.alias("parts"), F.ceil(F.col("n") / PART).cast("int").alias("deals"))
        now = now.join(wide, "root")
        hashed = F.xxhash64("node")
        ids = lookup(now.groupBy("root", F.pmod(hashed, F.col("parts")).alias("part")).agg(F.min("best").alias("first")).select(F.col("first.uid").alias("node")), "heads")
        heads = materialised(now.join(ids, "node").select("root", F.col("node").alias("head"), F.col("best").alias("first"), F.col("s").alias("t"), "deals"), "head-sets")
        if parts > 1:
            other = heads.select("root", F.col("first").alias("smaller"), F.col("t").alias("u"))
            waits = heads.join(other, "root").where((F.col("smaller") < F.col("first")) & alike(F.col("t"), F.col("u"), similarity)).select("head").distinct()
            heads = materialised(heads.join(lookup(waits, "waiting"), "head", "left_anti"), "staying")
        now = now.select(*members.columns, F.pmod(hashed, F.col("deals")).cast("int").alias("deal"))
        asked = heads.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        near = now.join(asked, ["root", "deal"]).where((F.col("node") != F.col("head")) & alike(F.col("s"), F.col("t"), similarity))
        goes = lookup(near.select("node").distinct(), "covered")
        gone = gone.unionByName(goes)
        rest = now.select(*members.columns).join(goes, "node", "left_anti").join(heads.select(F.col("head").alias("node")), "node", "left_anti")
        now, parts = materialised(rest, "undecided"), min(parts * 4, most)


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, lanes: int = 4,
                      similarity: float = 0.8, bits: int = 14, keys: int = 48) -> DataFrame:
    """The rows of ``docs`` without near duplicates: a document goes if one that stays has ``similarity`` or more of its shingles.

    Fingerprints of ``64 * lanes`` bits only find candidates: at a Jaccard similarity s the angle has cosine 2s / (1 + s), and
    the share of differing bits is angle / pi. Fingerprints link up to that number and two standard deviations more, if they share
    one of ``keys`` samples of ``bits`` bits (0.99 of pairs at 0.8 and more above). Within each class of linked fingerprints the
    Jaccard similarity of the shingle sets is then exact (``covered``). Of a group around one document that with the smallest id stays.
    Documents without words are copies of each other. Of repeated rows one stays; null ids come last. All columns are kept.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    limit = int(64 * lanes * share + 2 * (64 * lanes * share * (1 - share)) ** 0.5)
    named = materialised(packed(docs, uid=F.monotonically_increasing_id(), doc_id=F.col(f"`{id}`"), text=F.col(f"`{text}`").cast("string")), "numbered")
    prints = materialised(with_fingerprints(named.select("uid", "doc_id", "text"), words, lanes, repeats=False), "fingerprints")
    own = [f"f{k}" for k in range(lanes)]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    nodes = materialised(prints.groupBy(*own).agg(best).withColumn("node", F.col("best.uid")), "distinct-prints")
    groups = components(near_links(nodes, limit, sampled_keys(lanes, bits, keys), lanes))
    classed = lookup(nodes.select("node", "best").join(groups, "node"), "classes")
    members = materialised(with_shingles(named.select(F.col("uid").alias("node"), "text").join(classed, "node"), words), "shingle-sets")
    first = nodes.select(F.col("node").alias("uid")).join(covered(members, similarity).withColumnRenamed("node", "uid"), "uid", "left_anti")
    return named.join(first, "uid", "left_semi").select("row.*")
