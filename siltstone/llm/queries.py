"""Queries of the training-data operators for the driver, each over whole tables with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe_tree, id_shards, imatch, line_dedup, near_join, phrases, quality_model, quality_rules, secret_scan, simhash, source_mix, suffix_dedup, trie
from siltstone.llm.common import batch_of, cut, map_arrow


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest()



def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    joined = suffix_dedup.with_spans(docs, suffix_dedup.repeated_spans(docs, suffix_dedup.Settings(length=100)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), suffix_dedup.batch_spans(batch.column(2)), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                out.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), sha256(suffix_dedup.kept_bytes(raw, spans))))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    return map_arrow(joined, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pooler, network = quality_model.train(docs, read(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, pooler, network)
    return scored.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(read(spark, sf_dir, "documents"), low=3.0, high=6.2)


def op5_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, entries = id_shards.write_and_index(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    found = id_shards.lookup(store, entries.select("doc_id", "occurrence"), digest=id_shards.crc32_of_ids)
    return found.select("doc_id", "start", "n_tokens", F.col("ids_digest").alias("ids_crc32"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy of a document in the mix: source weights at 95 % of the greatest entropy, every document at least once."""
    copies, _ = source_mix.plan(read(spark, sf_dir, "documents"), source_mix.Target(entropy=0.95), seed=6)
    rows = source_mix.realise(copies, seed=6)
    return rows.select("row.doc_id", "row.source", F.col("mix_n").alias("n_tokens"), F.round("mix_weight", 9).alias("weight"), F.col("mix_copies").alias("copies"), F.col("mix_pass").alias("pass"), F.shiftright("mix_place", 54).cast("int").alias("block"), F.col("mix_place").alias("place"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    joined = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, least_chars=20, least_docs=3))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [sha256(line_dedup.kept_text(t.as_py() or "", n, k)) for t, n, k in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield batch_of(schema, [batch.column(0), batch.column(2), batch.column(3), digests])

    return map_arrow(joined.select("row.doc_id", "row.text", "n_lines", "n_dropped", "keep"), digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP7_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, s.key is not null and doc_id < keeper as dropped from k left join s on k.key = s.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from j group by doc_id
"""


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_documents(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: Exact links of all pairs of different texts that share a word n-gram, and the least doc_id that links lead to.
OP8_SQL = r"""
with recursive t as (select coalesce(text, '') as text, min(doc_id) as rep from documents group by 1),
w as (select rep, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
s as (select distinct rep, gram from (
  select rep, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) else [array_to_string(words, ' ')] end) as gram
  from w where len(words) > 0)),
n as (select rep, count(*) as n from s group by rep),
p as (select a.rep as u, b.rep as v, count(*) as shared from s a join s b on a.gram = b.gram and a.rep <> b.rep group by 1, 2),
e as (select u, v from p join n x on x.rep = u join n y on y.rep = v where 100 * shared >= 80 * (x.n + y.n - shared)),
r as (select u as node, v as reached from e union select r.node, e.v from r join e on r.reached = e.u),
c as (select node, least(node, min(reached)) as class_id from r group by node),
k as (select u as node, count(*) as n_links from e group by u)
select d.doc_id, coalesce(c.class_id, t.rep) as class_id, coalesce(k.n_links, 0)::bigint as n_links
from documents d join t on coalesce(d.text, '') = t.text left join c on c.node = t.rep left join k on k.node = t.rep
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = secret_scan.Dictionary.from_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return secret_scan.scan(read(spark, sf_dir, "documents"), secret_scan.train(dictionary=dictionary))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), phrases.Settings(least=10, covered=50, top=2000))


OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as words from documents),
g as (select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase from (
  select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from p, (values (1), (2), (3)) as sizes(k) where len(words) >= k)),
f as (select lang, k, phrase, count(*)::hugeint as f from g group by lang, k, phrase),
w as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as words from f where k > 1 and f >= 10),
o as (select distinct s.lang, s.phrase from c s join (select lang, f, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) as phrase from c where k = 3) b
  on s.lang = b.lang and s.phrase = b.phrase where s.k = 2 and 100 * b.f >= 50 * s.f),
q as (select lang, phrase, f as a, cut, array_to_string(words[1:cut], ' ') as head, array_to_string(words[cut + 1:], ' ') as rest from c, (values (1), (2)) as cuts(cut) where cut < k),
s as (select q.lang, q.phrase, a, cut, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f * y.f) as score
  from q join f x on x.lang = q.lang and x.phrase = q.head join f y on y.lang = q.lang and y.phrase = q.rest left join o on o.lang = q.lang and o.phrase = q.phrase where o.phrase is null),
b as (select *, row_number() over (partition by lang, phrase order by score, cut) as best from s),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b where best = 1)
select t.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from t join w on t.lang = w.lang where rank <= 2000
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read(spark, sf_dir, "documents"), simhash.Settings(words=4, seed=42, distance=4))
    return found.select("doc_id", simhash.as_hex("node").alias("fingerprint"), "component_id")


def rebuilt_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, in their order p, and all conv_ids.

    A conversation c takes the first h turns of c - c % 5 and its own turns after the first h.  At most eight turns are
    taken over, and at most nine conversations take them, so no key of these joins grows with the table.
    """
    turns = trie.numbered(read(spark, sf_dir, "conversations"))
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = cut(turns.select("conv_id").distinct())
    heads = turns.where((F.col("p") <= 8) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", base.alias("base"), h.alias("h")).join(heads, "base").where("p <= h").select(*turns.columns)
    return taken.unionByName(turns.where(F.col("p") > h)), convs


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = trie.trie(*rebuilt_turns(spark, sf_dir))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 9 as h
  from (select distinct conv_id from t)),
r as (select c.conv_id, p, role, text from c join t on t.conv_id = c.base where p <= h
  union all select t.conv_id, p, role, text from t join c on t.conv_id = c.conv_id where p > h),
o as (select conv_id, row_number() over (partition by conv_id order by p) as depth, strlen(text) as bytes, sha256(length(role) || ':' || role || text) as m from r),
k as (select conv_id, depth, bytes, string_agg(m, ',') over (partition by conv_id order by depth) as key from o
  union all select conv_id, 0, 0, '' from c),
n as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from k group by depth, key),
e as (select n.depth, n.key, p.depth as parent_depth, p.key as parent_key, p.conv_id as parent_conv_id
  from n join k on k.conv_id = n.conv_id and k.depth = n.depth - 1 join n p on p.depth = k.depth and p.key = k.key),
b as (select parent_depth as depth, parent_key as key, count(*) as n_children from e group by 1, 2),
v as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * bytes as saved from n left join b on n.depth = b.depth and n.key = b.key),
s as (select k.depth, k.key, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens
  from v join k on k.conv_id = v.conv_id and k.depth <= v.depth group by 1, 2),
f as (select depth, key, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select *, max(depth) over (partition by conv_id) as last from k) where depth = last group by 1, 2)
select v.conv_id, v.depth::bigint as depth, e.parent_conv_id, v.n_convs::bigint as n_convs, v.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(f.ids, '')) as ends_sha256
from v join s on s.depth = v.depth and s.key = v.key left join e on e.depth = v.depth and e.key = v.key left join f on f.depth = v.depth and f.key = v.key
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_suffix_dedup": op2_suffix_dedup, "op3_quality": op3_quality, "op4_imatch": op4_imatch, "op5_id_shards": op5_id_shards, "op6_source_mix": op6_source_mix, "op7_line_dedup": op7_line_dedup, "op8_near_join": op8_near_join, "op9_secret_scan": op9_secret_scan, "op10_quality_rules": op10_quality_rules, "op11_phrases": op11_phrases, "op12_simhash": op12_simhash, "op13_trie": op13_trie}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op8_near_join": OP8_SQL, "op10_quality_rules": quality_rules.ORACLE, "op11_phrases": OP11_SQL, "op13_trie": OP13_SQL}
