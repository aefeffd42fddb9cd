"""The registered queries of the thirteen operators and of the pipeline, with the SQL of
those that SQL can express (DuckDB over the same tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio.llm import (decontam, embed_dedup, html_extract, line_dedup, manifest, mixing,
                       ngram_join, quality, spelling, token_planes, toxicity, url_filter, warc)
from helio.session import scratch_path

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        "taken")


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.resampled(_table(spark, sf_dir, "documents"), good).select(
        "doc_id", "log_weight", "gumbel_key", "kept")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(_table(spark, sf_dir, "documents"), k=4, t=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"),
                                   _table(spark, sf_dir, "benchmark"), size=10)
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), 0.93).select(
        "vec_id", "n_links", "component_id", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"),
                             _table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").alias("n_offending"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_planes.write_planes(_table(spark, sf_dir, "documents"),
                                    scratch_path(spark, "llm-planes"), tokenizer_path())
    return token_planes.read_index(spark, out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.damaged_words(_table(spark, sf_dir, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return manifest.document_manifest(_table(spark, sf_dir, "documents"), code % 7 == 0)


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_quality_resampling, op3_ngram_jaccard, op4_decontamination,
    op5_embedding_dedup, op6_url_filter, op7_html_extraction, op8_toxicity, op9_token_planes,
    op10_line_dedup, op11_spelling_variants, op12_merkle_manifest, op13_warc_index, pipeline)}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op1_mix_sources": r"""
with sized as (
  select doc_id, source, md5('mix-1|' || coalesce(cast(doc_id as varchar), 'null')) as k,
         coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'),
                                  lambda x: x <> '')), 0) as size
  from documents),
src as (
  select source, sum(size) as s,
         row_number() over (order by source is null, encode(source)) - 1 as i
  from sized group by source),
w as (select source, s, [3.0, 1.0, 2.0][1 + i % 3]::double as w, 2.0::double * s as cap from src),
t as (select 1.5::double * sum(s) as total from w),
steps as (
  select cap / w as level, (select total from t) - coalesce(sum(cap) over before, 0) as open_words,
         sum(w) over after_ as open_weight
  from w window before as (order by cap / w, w rows between unbounded preceding and 1 preceding),
                after_ as (order by cap / w, w rows between current row and unbounded following)),
lev as (select max(open_words / open_weight) as l from steps),
tgt as (
  select source, s, least(cap, coalesce((select l from lev), 1e300) * w) as target from w),
goal as (
  select *, cast(floor(target + 0.5) as bigint) as g,
         case when s > 0 then cast(floor(target + 0.5) as bigint) // s else 0 end as e from tgt),
placed as (
  select *, coalesce(sum(size) over (partition by source order by k, size
             rows between unbounded preceding and 1 preceding), 0) as before from sized)
select p.doc_id, cast(p.size as bigint) as size, cast(g.s as bigint) as source_size, g.target,
       cast(g.e * p.size + greatest(0, least(p.size, g.g - g.e * g.s - p.before)) as bigint)
         as taken
from placed p join goal g on p.source is not distinct from g.source""",
    "op4_decontamination": rf"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER},
         {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
iw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER},
         {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
iwin as (
  select distinct item_id, least(10, len(w)) as n,
         array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as g
  from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as p from iw where len(w) > 0)),
lens as (select distinct n from iwin),
hits as (
  select d.doc_id, d.p, d.n, i.item_id
  from (select doc_id, n, unnest(range(1, len(w) - n + 2)) as p, w from dw, lens
        where len(w) >= n) d
  join iwin i on i.n = d.n and i.g = array_to_string(d.w[d.p:d.p + d.n - 1], ' ')),
pos as (select doc_id, count(distinct q) as n_hit
        from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items,
               array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as s
        from hits group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from dw d left join pos using (doc_id) left join its using (doc_id)""",
    "op5_embedding_dedup": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, least(a, min(b)) as component_id from reach group by a),
n as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id,
       vec_id is not distinct from coalesce(component_id, vec_id) as kept
from embeddings left join c on vec_id = c.a left join n on vec_id = n.a""",
    "op10_line_dedup": rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
keyed as (select *, translate(trim(line, {_SPACES}), {_UPPER}, {_LOWER}) as k from lines),
common as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
marked as (
  select l.*, c.k is not null and l.doc_id <> c.keeper as lost
  from keyed l left join common c on l.k = c.k)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), ''))
         as kept_sha256
from marked group by doc_id""",
    "op11_spelling_variants": r"""
with recursive tab as (
  select list_transform(range(256), lambda i: list_reduce(range(8),
           lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i)) as t),
run as (
  select coalesce(cast(doc_id as varchar), '') as d, translate(unnest(regexp_extract_all(
           text, '[A-Za-z\x{00C0}-\x{00FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') as w from documents),
runs as (select d, w, count(*) as n from run group by d, w),
bytes as (
  select d, w, n, list_transform(string_split(d || ':', ''), lambda c: ord(c)::bigint) ||
         flatten(list_transform(string_split(w, ''), lambda c: case when ord(c) < 128
           then [ord(c)::bigint] else [192 + (ord(c)::bigint >> 6), 128 + (ord(c)::bigint & 63)] end)) as b
  from runs),
crc as (
  select w, n, xor(4294967295, list_reduce(b, lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]),
         4294967295)) as h from bytes, tab),
damaged as (
  select case when h % 199 = 0 then w[:(h % length(w))] || w[(h % length(w)) + 2:] else w end as word, n
  from crc),
vocab as (
  select word, cast(sum(n) as bigint) as n, length(word) as len, translate(word,
         'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß',
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_`{|') as k
  from damaged where length(word) >= 6 group by word having sum(n) >= 5),
link as (
  select a.word, a.n, b.word as other, b.n as other_n
  from vocab a join vocab b on b.len between a.len - 1 and a.len + 1
  where a.word <> b.word and levenshtein(a.k, b.k) = 1),
near as (
  select word, count(*) as n_near,
         min({'k': -other_n, 'b': encode(other), 'w': other}) as best from link group by word),
form as (
  select v.word, v.n, coalesce(n_near, 0) as n_near,
         case when -best.k >= 5 * v.n then best.w end as form,
         case when -best.k >= 5 * v.n then -best.k end as form_n
  from vocab v left join near on v.word = near.word),
chain(word, tip) as (
  select word, word from form
  union all
  select c.word, f.form from chain c join form f on c.tip = f.word where f.form is not null)
select f.word, f.n, f.n_near, f.form, f.form_n, c.tip as root
from form f join chain c on c.word = f.word join form e on e.word = c.tip and e.form is null""",
    "op12_merkle_manifest": r"""
with recursive tab as (
  select list_transform(range(256), lambda i: list_reduce(range(8),
           lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i)) as t),
field as (
  select doc_id, lang, n_chars,
    case when doc_id is null then '-' else length(cast(doc_id as varchar)) || ':' || doc_id end ||
    case when source is null then '-' else octet_length(encode(source)) || ':' || source end ||
    case when lang is null then '-' else octet_length(encode(lang)) || ':' || lang end as a,
    case when text is null then '-' else octet_length(encode(text)) || ':' || text end as z,
    coalesce(xor(4294967295, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''),
      lambda c: ord(c)::bigint), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]), 4294967295))
      % 7 = 0, false) as tampered
  from documents, tab),
hashed as (
  select doc_id, lang,
    sha256(a || case when n_chars is null then '-' else length(cast(n_chars as varchar)) || ':'
           || n_chars end || z) as leaf,
    sha256(a || case when n_chars is null then '-' else length(cast(n_chars + tampered::bigint
           as varchar)) || ':' || (n_chars + tampered::bigint) end || z) as seen
  from field),
leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p,
         count(*) over (partition by lang) as n,
         dense_rank() over (order by lang is not null, encode(lang)) - 1 as g from hashed),
node(g, l, p, n, h) as (
  select g, 0, p, n, leaf from leaves
  union all
  select a.g, a.l + 1, a.p // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  from node a left join node b on a.g = b.g and b.p = a.p + 1 where a.n > 1 and a.p % 2 = 0),
top(l, p, n, h) as (
  select 0, g, (select count(distinct g) from leaves), h from node where n = 1
  union all
  select a.l + 1, a.p // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  from top a left join top b on b.p = a.p + 1 where a.n > 1 and a.p % 2 = 0),
-- siblings of the nodes above every leaf; without one, a step that adds nothing
step as (
  select v.g, v.p, u.l, case when s.h is null then '.' when u.p % 2 = 0 then 'R' || s.h
         else 'L' || s.h end as s
  from leaves v join node u on u.g = v.g and u.n > 1 and u.p = v.p >> u.l
  left join node s on s.g = u.g and s.l = u.l and s.p = xor(u.p, 1::bigint)
  union all
  select v.g, v.p, 1000 + u.l, case when s.h is null then '.' when u.p % 2 = 0 then 'R' || s.h
         else 'L' || s.h end
  from leaves v join top u on u.n > 1 and u.p = v.g >> u.l
  left join top s on s.l = u.l and s.p = xor(u.p, 1::bigint)),
path as (select g, p, list(s order by l) as path from step group by g, p),
done as (
  select v.doc_id, v.leaf, sub.h as subroot, root.h as root, coalesce(path, []) as path, v.seen
  from leaves v join node sub on sub.g = v.g and sub.n = 1 join top root on root.n = 1
  left join path on path.g = v.g and path.p = v.p),
folds as (
  select *, list_reduce(path, lambda x, s: sha256(case when s[1] = 'L' then s[2:] || x
         when s[1] = 'R' then x || s[2:] else x end), seen) as folded_root from done)
select doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) as proof_sha256,
       folded_root, folded_root = root as verified
from folds""",
    "op13_warc_index": r"""
with hashed as (
  select page_id, url, coalesce(html, '') as body, sha1(coalesce(html, '')) as s from pages),
coded as (
  select page_id, body, octet_length(encode(body)) as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr(
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(s, 1 + 5 * (i // 4), 5)
      as bigint) >> (15 - 5 * (i % 4))) & 31 as integer), 1)), '') as payload_digest,
    row_number() over (partition by body order by page_id desc nulls last, url desc) as r,
    first_value(page_id) over (partition by body order by page_id desc nulls last, url desc) as top
  from hashed)
select page_id, payload_bytes, payload_digest,
       case when r = 1 then 'response' else 'revisit' end as record_type,
       case when r > 1 then top end as refers_to
from coded""",
}
