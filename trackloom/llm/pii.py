"""Personal data: patterns of known kinds, and identifiers found by the words around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import materialised

#: Kinds of spans in their order. The patterns are the contract's, with possessive repeats, so that no text makes them slow
#: or deep: what may follow a repeat is never part of it, and an address or a number that fails from its first character
#: fails from all others. (An address may also start where the one before it ended.)
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without a match of these there is none of the kind.
HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Words that may be identifiers: those with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Characters before and after a word in which its context is looked for.
REACH = 200
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits, 19 at most, pass: from the right, every second one counts double, less 9 above 9."""
    padded = F.lpad(digits(value), 19, "0")
    total = F.lit(0)
    for k in range(19):
        d = F.substring(padded, k + 1, 1).cast("int")
        total = total + (2 * d - F.when(d > 4, 9).otherwise(0) if k % 2 else d)
    return total % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match counts; there are no second tries."""
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), "card": n.between(13, 19) & luhn(value), "phone": n.between(9, 15)}[kind]


def matched(text: Column, pattern: str, hint: str, context: bool = False) -> Column:
    """Matches in order, each with the length of what lies between it and the one before; with ``context`` also the
    characters around that gap's ends, and a last entry without a value for what follows the last match."""
    def entry(gap: Column, value: Column) -> Column:
        around = [F.substring(gap, 1, REACH).alias("head"), F.right(gap, F.lit(REACH)).alias("tail")] if context else []
        return F.struct(F.char_length(gap).alias("gap"), value.alias("value"), *around)

    return F.when(text.rlike(hint), F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), entry))


def placed(found: DataFrame, column: str) -> DataFrame:
    """One row per match of ``column``: ``uid``, its fields, ``start`` and ``end`` in code points."""
    rows = found.where(F.col(column).isNotNull()).select("uid", F.posexplode(column).alias("at", "m")).select("uid", "at", "m.*")
    length = F.coalesce(F.char_length("value"), F.lit(0))
    upto = Window.partitionBy("uid").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(upto).cast("long")).withColumn("start", F.col("end") - length)
    if "head" in rows.columns:
        rows = rows.withColumn("after", F.lead("head").over(upto))
    return rows.where("value is not null")


def base_spans(found: DataFrame) -> DataFrame:
    """``uid``, ``kind`` (number), ``start``, ``end`` of the matches that count."""
    out = None
    for n, kind in enumerate(KINDS):
        rows = placed(found, kind).where(holds(kind, F.col("value"))).select("uid", F.lit(n).alias("kind"), "start", "end")
        out = rows if out is None else out.unionByName(rows)
    return out


def words_in_context(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Words that may be identifiers: ``uid``, ``start``, ``value``, ``kind`` (of the span that starts in it, else null) and
    ``patterns``: lower-cased words before it, and before and after it. Words inside a span that starts earlier are left out.
    """
    tokens = placed(found, "token").select("uid", "start", "end", "value", "tail", "after", F.lit(None).cast("int").alias("kind"))
    empty = F.lit(None).cast("string")
    both = tokens.unionByName(spans.select("uid", "start", "end", empty.alias("value"), empty.alias("tail"), empty.alias("after"), "kind"))
    # along a text, a word meets the spans that start before its end: the last end of those before it, the first start after,
    # which is the last one met on the way back; both are running values, so a text costs what its candidates do
    order = [F.col("start"), F.col("value").isNull(), F.col("kind")]
    ahead = Window.partitionBy("uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("uid").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("value").isNull(), F.struct("start", "kind"))
    met = both.withColumn("covered", F.max(F.when(F.col("value").isNull(), F.col("end"))).over(ahead)).withColumn("next", F.last(own, ignorenulls=True).over(back))
    met = met.where("value is not null and coalesce(covered, 0) <= start")
    left = F.regexp_extract_all(F.lower("tail"), F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0))
    right = F.regexp_extract(F.lower("after"), r"[^\x20\x09-\x0D]++", 0)
    last, second = (F.coalesce(F.try_element_at(left, F.lit(-k)), F.lit("#")) for k in (1, 2))
    patterns = F.array(F.concat_ws(" ", second, last, F.lit("_")), F.concat_ws(" ", last, F.lit("_"), F.when(right == "", "#").otherwise(F.coalesce(right, F.lit("#")))))
    return met.select("uid", "start", F.lower("value").alias("value"), F.when(F.col("next.start") < F.col("end"), F.col("next.kind")).alias("kind"),
                      F.col("value").alias("raw"), patterns.alias("patterns"))


def scored_values(words: DataFrame, rounds: int, support: int, trust: float) -> DataFrame:
    """``value``, ``kind`` of the words that the patterns take for identifiers.

    The graph has a link between each pattern and each value found with it, weighted by the number of times. A value seen as
    a span of a kind has trust 1 in that kind. In each round a pattern's trust in a kind is the share of trusted values among
    all it is found with (one more in the denominator), if at least ``support`` different seed values are among them; each
    time a value is found the most trusted of its patterns counts, so that one suffices, and a value's trust is the mean over
    all times, those without a trusted pattern included. Values at ``trust`` or more after the last round are taken.
    """
    uses = materialised(words.groupBy("patterns", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "pattern-graph")
    links = uses.select("patterns", F.explode("patterns").alias("pattern"), "value", "n", "kind")
    edges = links.groupBy("pattern", "value").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"))
    seeds = words.where("kind is not null").groupBy("value").agg(F.max("kind").alias("kind"))
    degree = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    rich = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support).drop("seeds")
    rich = materialised(rich.join(degree, "pattern"), "supported-patterns")
    some = materialised(links.drop("kind").join(rich.select("pattern").distinct(), "pattern", "left_semi"), "supported-links")
    weight = uses.groupBy("value").agg(F.sum("n").alias("times"))
    seeds = materialised(seeds.select("value", "kind", F.lit(1.0).alias("trust")), "seed-values")
    now = seeds
    for _ in range(rounds):
        told = some.join(now, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("trust")).alias("sure"))
        believed = rich.join(told, ["pattern", "kind"]).select("pattern", "kind", (F.col("sure") / (F.col("all") + 1)).alias("belief"))
        best = some.join(believed, "pattern").groupBy("value", "patterns", "n", "kind").agg(F.max("belief").alias("belief"))
        heard = best.groupBy("value", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("sum"))
        fresh = heard.join(weight, "value").join(seeds.select("value"), "value", "left_anti").select("value", "kind", (F.col("sum") / F.col("times")).alias("trust"))
        now = materialised(seeds.unionByName(fresh), "trusted-values")
    new = now.join(seeds.select("value"), "value", "left_anti").where(F.col("trust") >= trust)
    return new.groupBy("value").agg(F.min_by("kind", F.struct(-F.col("trust"), F.col("kind"))).alias("kind"))


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's personal data: ``doc_id``, ``base`` and ``spans``, arrays of (kind, start, end, found by).

    ``base`` holds the matches of the known patterns, by kind and start; ``spans`` also what their contexts discover: words
    with a digit or an at sign, outside base spans, that stand where base spans of a kind stand (``scored_values``), without
    the marks around them. Places are code points, ends exclusive; kinds are numbers in the order of ``KINDS``. Null and empty
    texts have no spans, and repeated rows are documents of their own.

    Texts are read once; matches and the characters around candidates are written, and all else works on these.
    """
    clean = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").cast("long").alias("doc_id"), clean.alias("text"))
    found = rows.select("uid", "doc_id", *[matched(F.col("text"), p, HINTS[k]).alias(k) for k, p in KINDS.items()],
                        matched(F.col("text"), TOKEN, "[0-9@]", context=True).alias("token"))
    found = materialised(found, "matches")
    base = materialised(base_spans(found), "base-spans")
    words = materialised(words_in_context(found, base), "words")
    values = scored_values(words, rounds, support, trust)
    new = words.where("kind is null").drop("kind").join(values, "value")
    lead = F.char_length(F.regexp_extract("raw", "^[^A-Za-z0-9+]*+", 0))
    core = F.regexp_replace(F.regexp_replace("raw", "^[^A-Za-z0-9+]++", ""), "[^A-Za-z0-9]++$", "")
    new = new.select("uid", "kind", (F.col("start") + lead).alias("start"), core.alias("core")).where("core <> ''")
    new = new.select("uid", "kind", "start", (F.col("start") + F.char_length("core")).alias("end"))
    every = base.withColumn("context", F.lit(False)).unionByName(new.withColumn("context", F.lit(True)))
    spans = F.array_sort(F.collect_list(F.struct("kind", "start", "end", "context")))
    by_doc = every.groupBy("uid").agg(spans.alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,context:boolean>>")
    whole = found.select("uid", "doc_id").join(by_doc, "uid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return whole.select("doc_id", F.filter("spans", lambda s: ~s["context"]).alias("base"), "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
