"""Order-dependent building blocks that never put a whole track, or a whole group, into one task.

A time axis is cut into ranges of ``CHUNK`` frames. Windows run inside one range; what crosses a border (the last row,
the running total) travels in a summary with one row per range. Order statistics are found between two approximate
quantiles, so only the few values between them are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.session import lookup

CHUNK = 4096
ACCURACY = 100_000
BUCKETS = 4096  # a power of two
TRIMMED = 1000  # largest n for which Spark trims row_number() <= n before the shuffle
SALTS = 64


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(keys), how)


def _attached(df: DataFrame, one_per_group: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``df`` with ``column`` of its group's row; without keys the single row is a scalar subquery, not a join."""
    if keys:
        return _join(df, one_per_group, keys)
    return df.withColumn(column, one_per_group.select(column).scalar())


def chunked(df: DataFrame, order: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``_chunk``, the range of each row. Given to ``neighbours`` shuffled by it and some of the keys, rows stay in place."""
    return df if "_chunk" in df.columns else df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))


def neighbours(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], *, ahead: bool = False,
               chunk: int = CHUNK) -> DataFrame:
    """Add ``prev_<v>`` and ``has_prev`` (and ``next_<v>``, ``has_next`` when ``ahead``) of the adjacent rows.

    ``order`` is a unique non-negative integer inside a group; gaps are allowed. NULL and false at the ends.
    """
    part = [*keys, "_chunk"]
    state = [F.lit(True), *[F.col(v) for v in values]]  # not as a struct, which would be shuffled beside the values
    inside = Window.partitionBy(*part).orderBy(order)
    cut = chunked(df, order, chunk)
    sides = {"_before": F.lag, "_after": F.lead}
    cut = cut.withColumns({f"{n}{i}": f(c).over(inside) for n, f in sides.items() for i, c in enumerate(state)})
    # The first and last row of a range look for their neighbour among the first and last rows of all ranges.
    border = F.col("_before0").isNull() | F.col("_after0").isNull()
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)
    edges = cut.where(border).withColumns({f"{n}{i}_": f(c).over(along) for n, f in sides.items() for i, c in enumerate(state)})
    edges = edges.select(*cut.columns[:-2 * len(state)], *[F.when(F.col(f"{n}0"), F.col(f"{n}{i}")).otherwise(F.col(f"{n}{i}_")).alias(f"{n}{i}")
                                                  for n in sides for i in range(len(state))])
    out = cut.where(~border).unionByName(edges)
    added = [F.col("_before0").isNotNull().alias("has_prev"), *[F.col(f"_before{i}").alias(f"prev_{v}") for i, v in enumerate(values, 1)]]
    if ahead:
        added += [F.col("_after0").isNotNull().alias("has_next"), *[F.col(f"_after{i}").alias(f"next_{v}") for i, v in enumerate(values, 1)]]
    return out.select(*df.columns, *added)


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, *,
                  chunk: int = CHUNK) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to and including this one."""
    part = [*keys, "_chunk"]
    cut = df.withColumn("_summed", value).withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    between = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_chunk")
    sums = cut.groupBy(*part).agg(F.sum("_summed").alias("_sum"))
    sums = sums.select(*part, F.sum("_sum").over(between.rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    out = _join(cut.withColumn("_run", F.sum("_summed").over(inside)), sums, part)
    zero = F.lit(0)
    return out.select(*df.columns, (F.coalesce("_base", zero) + F.coalesce("_run", zero)).alias(name))


def row_index(df: DataFrame, keys: Sequence[str], order: str, name: str = "rn", *, chunk: int = CHUNK) -> DataFrame:
    """Add the 1-based position of each row in its group, in the order of the unique integer ``order``."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, chunk=chunk)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     wanted: Mapping[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """Exact interpolated order statistics per group, plus the count ``n`` of values.

    ``wanted`` maps an output name to ``(p, position)``: ``position(n)`` is the zero-based, possibly fractional place in
    the sorted values, and ``p`` is that place as a share of the group, within one row. Groups above ``ACCURACY`` rows
    are narrowed to the values between two approximate quantiles; rows below only add to a count. The spans, one row
    per group, are written to the shared folder.
    """
    keys = list(keys)
    margin = 4.0 / ACCURACY
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    wanted = dict(sorted(wanted.items(), key=lambda kv: kv[1][0]))
    probs = [max(0.0, p - margin) for p, _ in wanted.values()] + [min(1.0, p + margin) for p, _ in wanted.values()]
    stats = src.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in probs]), ACCURACY).alias("_cuts"))
    bounds = []
    for i, (p, place) in enumerate(wanted.values()):
        small = F.col("n") <= ACCURACY
        bounds += [F.when(small | F.lit(p <= margin), F.col("_min")).otherwise(F.col("_cuts")[i]).alias(f"lo{i}"),
                   F.when(small | F.lit(p >= 1.0 - margin), F.col("_max")).otherwise(F.col("_cuts")[len(wanted) + i])
                   .alias(f"hi{i}"), place(F.col("n")).cast("double").alias(f"at{i}")]
    stats = stats.where("n > 0").select(*keys, F.struct("n", *bounds).alias("_stats"))
    stats = lookup(stats, "spans") if keys else stats
    # A value inside a span keeps its own entry; all others only count, per stretch between the starts of the spans.
    each = range(len(wanted))
    spans = [(F.col(f"_stats.lo{i}"), F.col(f"_stats.hi{i}")) for i in each]
    stretch = sum([(F.col("_v") >= lo).cast("int") for lo, _ in spans[1:]], (F.col("_v") >= spans[0][0]).cast("int"))
    inside = F.lit(False)
    for lo, hi in spans:
        inside = inside | F.col("_v").between(lo, hi)
    hits = _attached(src, stats, keys, "_stats").select(*keys, stretch.alias("_at"), F.when(inside, F.col("_v")).alias("_v"))
    counts = hits.groupBy(*keys, "_at", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_at", F.col("_v").asc_nulls_last())
    counts = counts.withColumn("_end", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counts = _attached(counts, stats, keys, "_stats")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picked = counts.groupBy(*keys).agg(
        F.max("_stats.n").alias("n"), *[F.max(f"_stats.at{i}").alias(f"_p{i}") for i in each],
        *[at(F.floor(f"_stats.at{i}")).alias(f"_a{i}") for i in each], *[at(F.ceil(f"_stats.at{i}")).alias(f"_b{i}") for i in each])

    def value_of(i: int) -> Column:
        a, b, place = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_p{i}")
        missed = F.raise_error(F.lit("order statistic outside its span")).cast("double")
        return F.when(a.isNull() | b.isNull(), missed).when(a == b, a).otherwise(a + (b - a) * (place - F.floor(place)))

    return picked.where("n is not null").select(*keys, "n", *[value_of(i).alias(name) for i, name in enumerate(wanted)])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group (and ``n``) for groups of any size.

    The input is read twice: pass a written table when it is expensive to compute.
    """
    def place(p: float) -> Callable[[Column], Column]:
        return lambda n: (n - 1) * F.lit(p)

    return order_statistics(df, keys, value, {name: (p, place(p)) for name, p in probs.items()})


def approx_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *,
                       accuracy: int = ACCURACY) -> DataFrame:
    """One-pass variant: each percentile is off by at most ``n / accuracy`` ranks."""
    made = [F.percentile_approx(value, p, accuracy).cast("double").alias(name) for name, p in probs.items()]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *made)


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str,
                      sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct values per group with running sums over the values up to each one.

    Returns ``keys, value, cnt, upto, total`` and, for each entry of ``sums`` (an expression summed per distinct value),
    ``<name>`` as its running sum. Values are spread over up to BUCKETS buckets between approximate quantiles; windows
    run inside a bucket, bucket totals are accumulated separately. The bucket limits, one row per group, are written
    to the shared folder.
    """
    keys = list(keys)
    sums = dict(sums or {})
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
    counts = counts.where("cnt > 0")  # always true; keeps the count in every branch, so one shuffle serves them all
    probs = F.expr("array(" + ", ".join(f"{i / BUCKETS}D" for i in range(1, BUCKETS)) + ")")
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, 5 * BUCKETS).alias("_cuts"))
    spread = _join(counts, lookup(cuts, "cuts"), keys) if keys else counts.withColumn("_cuts", cuts.scalar())
    # Binary search: add each step as long as the cut there is smaller than the value.
    bucket = F.aggregate(
        F.array(*[F.lit(1 << b) for b in reversed(range(BUCKETS.bit_length() - 1))]), F.lit(0),
        lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(value), at + step).otherwise(at))
    spread = spread.withColumn("_bucket", bucket).drop("_cuts")
    part = [*keys, "_bucket"]
    run = {"upto": "cnt", **{n: f"_s_{n}" for n in sums}}
    totals = spread.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in run.items()])
    before = ((Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    totals = totals.select(*part, F.sum("_t_upto").over(whole).alias("total"),
                           *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in run])
    inside = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.select(*part, value, "cnt", *[F.sum(c).over(inside).alias(f"_r_{n}") for n, c in run.items()])
    out = _join(out, totals, part)
    return out.select(*keys, value, "cnt", "total", *[(F.col(f"_b_{n}") + F.col(f"_r_{n}")).alias(n) for n in run])


def strict_rank_shares(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys, value, ``name``: for each distinct value the share of the group's values strictly smaller than it."""
    runs = cumulative_counts(df.select(*keys, value), keys, value)
    return runs.select(*keys, value, ((F.col("upto") - F.col("cnt")) / F.col("total")).alias(name))


def strict_rank_share(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the share of the group's values strictly smaller than this one (NULL values stay NULL)."""
    return _join(df, strict_rank_shares(df, keys, value, name), [*keys, value], "left")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    For n up to 1,000 Spark trims every map task to its own first ``n`` rows before the shuffle. For more, each group is
    first trimmed in SALTS parts, so a hot group never reaches one task whole.
    """
    name = rank or "_rn"
    keys = list(keys)
    if n > TRIMMED:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_first", F.row_number().over(part)).where(F.col("_first") <= n).drop("_salt", "_first")
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)
