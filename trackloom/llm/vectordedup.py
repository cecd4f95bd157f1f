"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table distances, exact rerank.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Every step is bounded with r, so no pair is
lost. *Probes*: a vector within r of ``a`` can only lie in the list of centre j if ``a`` is no farther than r from the plane
halfway between j and its own centre. *Codes*: the distance between ``a`` and a vector's code, read from tables, differs from
the true one by at most the code's own error, which is kept with it. What remains is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.components import components
from trackloom.session import materialised

#: Vectors that the index is fitted to at most, the numbers of lists tried, components of a subspace, codes of a subspace.
SAMPLE, LISTS, WIDTH, CODES = 20_000, (1, 4, 16, 64, 256, 1024), 8, 256
#: Vectors of a label that one task holds as members of their lists, and that it is asked about; larger labels are dealt out by parts.
BLOCK, PART = 32768, 8192
#: What asking about a vector in one more list costs, counted in comparisons.
COPY = 300
#: Pairs that a task has table distances of at a time.
PAIRS = 2**21
#: Rounding of sums of products of unit vectors, and of the single-precision tables.
SLACK, TABLE_SLACK = 1e-9, 1e-5


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows of ``x`` by rows of ``centres``."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """``k`` centres, at most one per row; centres that lose all rows are dropped."""
    centres = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        at = squares(x, centres).argmin(axis=1)
        count = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = sums[count > 0] / count[count > 0][:, None]
    return centres


@dataclass
class Index:
    """Centres of the lists, and for each run of components the residual codes."""

    centres: np.ndarray
    books: list[np.ndarray]
    radius: float

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own list, and all that vectors within ``radius`` of it can be in (rows x lists)."""
        d = squares(x, self.centres)
        home = d.argmin(axis=1)
        apart = np.sqrt(squares(self.centres, self.centres))[home]
        beyond = (d - d[np.arange(len(x)), home][:, None]) / 2 > (self.radius + SLACK) * apart + SLACK
        beyond[np.arange(len(x)), home] = False
        return home, ~beyond

    def runs(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, WIDTH * k : WIDTH * (k + 1)] for k in range(len(self.books))]

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals (rows x subspaces), and the distance of each vector from what its code stands for."""
        rest = x - self.centres[home]
        codes = np.stack([squares(r, book).argmin(axis=1) for r, book in zip(self.runs(rest), self.books)], axis=1)
        error = rest - np.hstack([book[codes[:, k]] for k, book in enumerate(self.books)])
        return codes.astype(np.uint8), np.sqrt((error * error).sum(axis=1))

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """Per subspace, the squared distances of the vectors' residuals from centre ``at`` to the codes."""
        return [squares(r, book).astype(np.float32) for r, book in zip(self.runs(x - self.centres[at]), self.books)]


def fitted(x: np.ndarray, radius: float, per_label: float) -> Index:
    """An index for lists of ``per_label`` vectors in all, from unit vectors ``x``. Of the numbers of lists that with the least
    work is taken: lists that a vector is asked about in, by their length and the cost of asking."""
    best: tuple[float, np.ndarray] | None = None
    for k in LISTS:
        if best and (len(x) < 20 * k or per_label < 20 * k):
            break
        centres = kmeans(x, k)
        probes = Index(centres, [], radius).lists(x[:2000])[1].sum(axis=1).mean()
        work = probes * (per_label / len(centres) + COPY)
        if best is None or work < best[0]:
            best = work, centres
    index = Index(best[1], [], radius)
    rest = x - index.centres[squares(x, index.centres).argmin(axis=1)]
    index.books = [kmeans(rest[:, k : k + WIDTH], CODES) for k in range(0, x.shape[1], WIDTH)]
    return index


def unit(flat: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that neither very large nor very small components spoil the length."""
    scaled = flat / np.abs(flat).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers; shorter vectors are zero beyond their end."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dims))
    out[np.arange(dims) < n[:, None]] = pc.list_flatten(whole).to_numpy(zero_copy_only=False)
    return out


def packed_rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def unpacked_rows(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Joins the trees of ``root`` along the links i - j, and returns the links that did it: fewer than there are trees."""
    used: list[tuple[int, int]] = []
    while True:
        a, b = root[i], root[j]
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        if not len(i):
            return used
        high, low = np.maximum(a, b), np.minimum(a, b)
        first = np.unique(high, return_index=True)[1]
        root[high[first]] = low[first]
        used += zip(i[first].tolist(), j[first].tolist())
        while (root[root] != root).any():
            root[:] = root[root]


def linked_in(index: Index, at: int, members: dict[str, np.ndarray], asking: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each asking vector the ``weight`` of linked members, and links (nodes) that connect what is linked.

    Table distances of some asking vectors to all members discard pairs; the others' cosines are computed, in bounded parts.
    """
    count = np.zeros(len(asking["node"]), np.int64)
    nodes, place = np.unique(np.concatenate([asking["node"], members["node"]]), return_inverse=True)
    root, links = np.arange(len(nodes)), []
    reach = ((index.radius + members["error"]) ** 2 + TABLE_SLACK).astype(np.float32)[:, None]
    step = max(1, min(256, PAIRS // max(1, len(reach))))
    for start in range(0, len(count), step):
        far = np.zeros((len(reach), len(count[start : start + step])), np.float32)
        for k, table in enumerate(index.tables(asking["x"][start : start + step], at)):
            far += np.ascontiguousarray(table.T)[members["codes"][:, k]]
        m, a = np.nonzero(far <= reach)
        for part in range(0, len(a), 65536):
            i, j = a[part : part + 65536] + start, m[part : part + 65536]
            near = np.einsum("nk,nk->n", asking["x"][i], members["x"][j]) >= cosine
            near &= asking["node"][i] != members["node"][j]
            i, j = i[near], j[near]
            count += np.bincount(i, members["weight"][j], len(count)).astype(np.int64)
            links += unite(root, place[i], place[j + len(count)])
    return count, [(int(nodes[a]), int(nodes[b])) for a, b in links]


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few of the links as connect what all of them connect."""
    if not links:
        return links
    nodes, place = np.unique(np.array(links, np.int64), return_inverse=True)
    i, j = place.reshape(-1, 2).T
    return [(int(nodes[a]), int(nodes[b])) for a, b in unite(np.arange(len(nodes)), i, j)]


def linked_block(index: Index, members: dict[str, np.ndarray], asking: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """``linked_in`` over all lists that the members are in (``home``): each is asked about the vectors that it can hold a neighbour of."""
    count, links = np.zeros(len(asking["node"]), np.int64), []
    probes = [index.lists(asking["x"][k : k + 1024])[1] for k in range(0, len(count), 1024)]
    probes = np.concatenate(probes) if probes else np.zeros((0, len(index.centres)), bool)
    for cell in np.unique(members["home"]).tolist():
        asked = np.flatnonzero(probes[:, cell])
        if len(asked):
            own = members["home"] == cell
            some, used = linked_in(index, cell, {k: v[own] for k, v in members.items()}, {k: v[asked] for k, v in asking.items()}, cosine)
            count[asked] += some
            links += used
            if len(links) > len(count) + len(members["node"]):
                links = spanning(links)
    return count, spanning(links)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Rows link if their labels are equal and the cosine of their vectors, in double precision, is ``cosine`` or more (above 0).
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable by links, its own
    included, ``kept`` whether that is its own.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
    A vector shorter than others is zero beyond its end. Repeated rows and rows with equal ids count each. A null id counts as
    larger than all and names a component only where no other id is there. An empty table gives an empty result.

    Rows with equal label and vector are one class, counted map-side before anything is compared, so copies cost nothing;
    a class has two 64-bit hashes as its key. The index is fitted to ``SAMPLE`` classes by hash at most and holds all. Each
    class is a member of one list of its label and is asked about in the lists that can hold a neighbour of it. A task holds the
    lists of a whole label, or ``BLOCK`` members of neighbouring lists of it, and is asked about ``PART`` vectors: a vector travels
    once to each block that has a list of its, not once to each list. A task returns a count for each vector it was asked about
    and fewer links than vectors, so that n near copies of each other make no n^2 rows.
    """
    spark, radius = vectors.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = F.col(f"`{label}`").cast("string")
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), own.alias("label"), F.when(own.isNotNull() & sound, v).alias("v"))
    rows = rows.withColumns({"p": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "q": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("other"), F.col("v")))})
    classes = rows.where("v is not null").groupBy("label", "p", "q").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialised(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    total, labels, dims = classes.agg(F.count("*"), F.approx_count_distinct("label"), F.max(F.size("v"))).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.select("label", "p", "q", "v").orderBy("p", "q", "label").limit(SAMPLE).toArrow()
    index = fitted(unit(matrix(sample.column("v"), dims)), radius, total / max(1, labels))

    held = vectors.schema[vector].dataType
    kind = np.float32 if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else np.float64  # as it came, so exact

    def listed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for start in range(0, big.num_rows, 1024):
                b = big.slice(start, 1024)
                raw = matrix(b.column("v"), dims)
                x = unit(raw)
                home = squares(x, index.centres).argmin(axis=1)
                codes, error = index.codes(x, home)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("label", "node", "n")], pa.array(home, pa.int32()), packed_rows(raw.astype(kind)),
                                                  packed_rows(codes), pa.array(error)], names=["label", "node", "n", "home", "x", "codes", "error"])

    spread = classes.select("label", "node", "n", "v").mapInArrow(listed, "label string, node long, n long, home int, x binary, codes binary, error double")
    spread = materialised(spread, "lists")
    run = Window.partitionBy("label")
    cells = spread.groupBy("label", "home").agg(F.count("*").alias("many")).withColumn("total", F.sum("many").over(run))
    cells = cells.where(F.col("total") > min(BLOCK, PART)).withColumn("start", F.sum("many").over(run.orderBy("home")) - F.col("many"))
    turns = F.ceil(F.max("total") / PART).cast("int").alias("turns")
    spans = F.map_from_entries(F.collect_list(F.struct("home", F.struct("start", "many"))))
    laid = F.when(F.max("total") > BLOCK, F.transform(F.sequence(F.lit(0), F.lit(len(index.centres) - 1)), lambda i: F.try_element_at(spans, i)))
    large = materialised(cells.groupBy("label").agg(turns, laid.alias("spans")), "large-labels")
    dealt = spread.join(large, "label", "left").withColumn("turns", F.coalesce("turns", F.lit(1)))
    some = lambda many, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), many)
    block = lambda place: F.floor(place / BLOCK).cast("int")
    home = F.get("spans", F.col("home"))
    blocks = F.array_distinct(F.flatten(F.transform("probes", lambda i: F.when(F.get("spans", i).isNotNull(), F.sequence(
        block(F.get("spans", i)["start"]), block(F.get("spans", i)["start"] + F.get("spans", i)["many"] - 1))).otherwise(F.array().cast("array<int>")))))
    # as a member a vector is in one block and there for all turns, as asking it is in one turn and meets all its blocks
    members = dealt.select("label", "node", "n", "home", "x", "codes", "error",
                           F.when(F.col("spans").isNull(), 0).otherwise(block(home["start"] + some(home["many"], "part"))).alias("block"),
                           F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("home", "int"), ("codes", "binary"), ("error", "double"))]

    def probing(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for start in range(0, big.num_rows, 1024):
                b = big.slice(start, 1024)
                row, cell = np.nonzero(index.lists(unit(unpacked_rows(b.column("x"), kind, dims).astype(float)))[1])
                ends = np.searchsorted(row, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))],
                                                 names=[*b.schema.names, "probes"])

    asks = dealt.select("label", "node", "n", "x", "turns", "spans")
    few = asks.where("spans is null").withColumn("block", F.lit(0))
    many = asks.where("spans is not null").drop("spans").mapInArrow(probing, "label string, node long, n long, x binary, turns int, probes array<int>")
    many = many.join(large.select("label", "spans"), "label").withColumn("block", F.explode(blocks))
    asking = few.drop("spans").unionByName(many.drop("spans", "probes")).withColumn("turn", some(F.col("turns"), "turn").cast("int"))
    meeting = members.unionByName(asking.select("label", "node", "n", *nothing[:1], "x", *nothing[1:], "block", "turn"))

    def compared(t: pa.Table) -> pa.Table:
        def side(own: pa.Table) -> dict[str, np.ndarray]:
            return {"node": own.column("node").to_numpy(), "weight": own.column("n").to_numpy(), "x": unit(unpacked_rows(own.column("x"), kind, dims).astype(float))}

        there = t.column("home").is_valid()
        held, asking = t.filter(there), side(t.filter(pc.invert(there)))
        if not held.num_rows or not len(asking["node"]):
            return pa.table([pa.array([], pa.int64())] * 3, names=["node", "links", "other"])
        members = {**side(held), "home": held.column("home").to_numpy(), "error": held.column("error").to_numpy(),
                   "codes": unpacked_rows(held.column("codes"), np.uint8, len(index.books))}
        count, links = linked_block(index, members, asking, cosine)
        at = np.flatnonzero(count)
        nodes = np.concatenate([asking["node"][at], np.array([a for a, _ in links], np.int64)])
        return pa.table([pa.array(nodes), pa.array([*count[at].tolist(), *[None] * len(links)], pa.int64()),
                         pa.array([*[None] * len(at), *[b for _, b in links]], pa.int64())], names=["node", "links", "other"])

    found = materialised(meeting.groupBy("label", "block", "turn").applyInArrow(compared, "node long, links long, other long"), "found-links")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("label", "p", "q", "node", "least", "n").join(counts, "node", "left").join(groups, "node", "left")
    named = materialised(named.select("label", "p", "q", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named-classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialised(named.join(ids, "root").select("label", "p", "q", "n_links", F.lit(True).alias("found"), "component_id"), "component-ids")
    done = rows.drop("v").join(named, ["label", "p", "q"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
