"""The queries of the dealt operators: their columns as the contracts ask for them, each derived from the operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.chunking import neighbour_fingerprints
from trackloom.llm.common import ENTRIES, register, table
from trackloom.llm.hardnegatives import hard_negatives
from trackloom.llm.infill import with_infill
from trackloom.llm.licences import HEADER, LIKE, TEMPLATES, file_licences
from trackloom.llm.linededup import without_spread_lines
from trackloom.llm.mixing import mix
from trackloom.llm.packing import pack, token_pieces
from trackloom.llm.pii import KINDS, listed, personal_data
from trackloom.llm.quality import fit_quality, with_quality
from trackloom.llm.simhash import linked_documents
from trackloom.llm.topk import top_k
from trackloom.llm.toxicity import fit_toxicity, with_toxicity
from trackloom.llm.vectordedup import near_vectors
from trackloom.session import lookup


def remainder(id: Column, parts: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % parts


def scored(rows: DataFrame, parts: int, kept_back: int) -> DataFrame:
    """Columns of the contracts of both classifiers; a null id is never learnt from."""
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == kept_back, F.lit(True)).alias("held_out"), "score",
                       (F.col("score") >= 0.7).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str):
    return fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda id: remainder(id, 3) != 1)


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(with_toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir), whole=False), 3, 1)


@register("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda id: remainder(id, 4) != 2)
    return scored(with_quality(docs, model, whole=False), 4, 2)


#: Documents as files: a third lie in their source's directory, a third in that of their language below it, a third in one for
#: each hundred ids below that. The document with the smallest id is its directory's licence file.
OP1_SQL = rf"""
with d as (
  select doc_id, text, case doc_id % 3 when 0 then source when 1 then source || '/' || lang
         else source || '/' || lang || '/' || cast(doc_id // 100 as varchar) end as dir from documents),
f as (
  select doc_id, dir, string_split(text, chr(10)) as lines, doc_id = min(doc_id) over (partition by dir) as is_licence from d),
h as (
  select doc_id, dir, is_licence, case when is_licence or len(lines) <= {2 * HEADER} then lines
         else list_concat(lines[1:{HEADER}], lines[-{HEADER}:]) end as lines from f),
l as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from h),
w as (
  select doc_id, i, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) as term from l),
k as (
  select licence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term
  from (values {", ".join(f"('{k}', '{t}')" for k, t in TEMPLATES.items())}) v(licence, text)),
n as (
  select count(*) as files from documents),
idf as (
  select v.term, ln((1.0::double + files) / (1.0::double + count(distinct w.doc_id))) + 1.0 as idf
  from (select distinct term from k) v cross join n left join w on w.term = v.term group by v.term, files),
t as (
  select licence, k.term, count(*) * any_value(idf) as w from k join idf using (term) group by licence, k.term),
u as (
  select licence, term, w / sqrt(sum(w * w) over (partition by licence)) as share from t),
x as (
  select doc_id, i, w.term, count(*) * coalesce(any_value(idf), ln(1.0::double + any_value(files)) + 1.0) as w
  from w cross join n left join idf on idf.term = w.term group by doc_id, i, w.term),
y as (
  select doc_id, i, sqrt(sum(w * w)) as length from x group by doc_id, i),
z as (
  select x.doc_id, u.licence, round(sum(x.w * u.share) / any_value(y.length), 6) as score
  from x join u on x.term = u.term join y on y.doc_id = x.doc_id and y.i = x.i group by x.doc_id, x.i, u.licence),
o as (
  select doc_id, licence, score from z where score >= {LIKE}
  qualify row_number() over (partition by doc_id order by score desc, licence) = 1),
g as (
  select h.dir, o.licence, o.score from h join o using (doc_id) where is_licence),
a as (
  select h.doc_id, g.dir, g.licence, g.score
  from h join g on h.dir = g.dir or starts_with(h.dir, g.dir || '/')
  qualify row_number() over (partition by h.doc_id order by len(g.dir) desc) = 1)
select h.doc_id, h.dir || '/' || case when is_licence then 'LICENSE' else cast(h.doc_id as varchar) || '.txt' end as path,
       coalesce(o.licence, a.licence) as licence, coalesce(o.score, a.score) as score,
       case when o.licence is not null then 'header' when a.licence is not null then 'inherited' else 'none' end as found,
       case when o.licence is null then a.dir end as directory
from h left join o using (doc_id) left join a using (doc_id)
"""


@register("op1_licences", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    parts = F.when(F.col("doc_id") % 3 == 0, F.array("source")).when(F.col("doc_id") % 3 == 1, F.array("source", "lang")).otherwise(
        F.array("source", "lang", hundred))
    places = docs.select("doc_id", F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit("_"))), "/").alias("dir"))
    first = lookup(places.groupBy("dir").agg(F.min("doc_id").alias("first")), "first-files")
    name = F.when(F.col("doc_id") == F.col("first"), "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    paths = places.join(first, "dir").select("doc_id", F.concat_ws("/", "dir", name).alias("path"))
    return file_licences(docs, paths, id="doc_id").withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 9) as bigint) as place
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [3.0::double, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from d group by source),
l as (select *, 2.0::double * source_size as lim from s),
f as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) as share
  from l),
t as (
  select source, source_size, round(least(lim, w * max(share) over ()), 6) as target from f),
p as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies from t),
b as (
  select source, place, sum(size) as tokens from d group by source, place),
c as (
  select source, place, tokens, sum(tokens) over (partition by source order by place) - tokens as start from b),
x as (
  select c.source, max(case when 2 * (p.target - p.copies * p.source_size - c.start) >= c.tokens then c.place + 1 else c.place end) as below
  from c join p on c.source is not distinct from p.source
  where c.start < p.target - p.copies * p.source_size and c.start + c.tokens >= p.target - p.copies * p.source_size
  group by c.source)
select d.doc_id, d.size, p.source_size, p.target, d.size * (p.copies + case when d.place < coalesce(x.below, 0) then 1 else 0 end) as taken
from d join p on d.source is not distinct from p.source left join x on d.source is not distinct from x.source
"""


@register("op4_mixing", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@register("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"))


@register("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))


@register("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as t from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.t, c.t)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@register("op8_top_k", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = r"""
with d as (
  select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
l as (
  select doc_id, source, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
w as (
  select *, regexp_matches(line, '[^\x20\x09-\x0D]') as counts from l),
s as (
  select trim(line, ' ') as line, min({'doc_id': doc_id, 'i': i}) as first
  from w where counts group by trim(line, ' ') having count(distinct source) >= 8),
k as (
  select w.*, coalesce(s.first <> {'doc_id': w.doc_id, 'i': w.i}, false) as gone
  from w left join s on w.counts and trim(w.line, ' ') = s.line)
select doc_id, count(*)::int as n_lines, (count(*) filter (gone))::int as n_removed,
       coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as text
from k group by doc_id
"""


@register("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_spread_lines(table(spark, sf_dir, "documents")).drop("row")


@register("op10_chunk_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


OP11_SQL = """
with v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
k as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98),
r as (
  with recursive reach(a, b) as (select vec_id, vec_id from v union select reach.a, k.b from reach join k on reach.b = k.a)
  select a, min(b) as least from reach group by a),
n as (select a, count(*) as links from k group by a)
select e.vec_id, coalesce(n.links, 0)::bigint as n_links, coalesce(r.least, e.vec_id) as component_id, e.vec_id = coalesce(r.least, e.vec_id) as kept
from embeddings e left join n on e.vec_id = n.a left join r on e.vec_id = r.a
"""


@register("op11_vector_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
l as (
  select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
         cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (
  select *, len(lines)::bigint as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from l),
p as (
  select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle, array_to_string(lines[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then len(prefix) end::bigint as prefix_chars, case when form <> 'plain' then len(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from p
"""


@register("op12_infill", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_infill(table(spark, sf_dir, "documents"), whole=False, outputs=False).drop("pieces")


OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as t
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, list_inner_product(q.t, c.t)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
r as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 5
"""


@register("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
