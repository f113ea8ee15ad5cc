"""One query per operator over the driver's tables, and the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import fim, language, language_model, paths
from siltstone.functions import text as tx
from siltstone.functions.tokens import BYTES, byte_token_count
from siltstone.operators import dedup, evaluation, filters, mixture, packing, report, seen, shards, windows
from siltstone.operators.shared import cut, new_folder
from siltstone.plans import corpus
from siltstone.sources import loaders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if SQL can state it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Columns that the tables lack are stated by rules on the id, alike on both sides.
PATH_SQL = "case doc_id % 12 when 0 then 'pkg/m' || doc_id || '_pb2.py' when 1 then 'web/dist/app.js' when 2 then 'a/Cargo.lock' when 3 then 'package.json' when 4 then 'tsconfig.json' when 5 then 'docs/guide' || doc_id || '.md' when 6 then '.json' when 7 then 'x/LICENSE.md' when 8 then 'src/app.min.js' else 'src/m' || doc_id || '.py' end"
IDENTIFIER_SQL = "case when doc_id % 9 = 0 then '  ' when doc_id % 10 = 0 then null else 'fn_' || doc_id end"
LANGUAGE_SQL = "case doc_id % 5 when 0 then 'Python' when 1 then 'C#' when 2 then 'Rust' when 3 then 'Haskell' else 'Go' end"


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with file_path, identifier, language and a null size_bytes."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "text", F.expr(PATH_SQL).alias("file_path"), F.expr(IDENTIFIER_SQL).alias("identifier"), F.expr(LANGUAGE_SQL).alias("language"), F.lit(None).cast("long").alias("size_bytes"))


def sample_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as nested repositories of at most 40 files."""
    docs = sample_documents(spark, sf_dir)
    file = F.struct("file_path", "language", F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), (F.col("doc_id") % 11 == 0).alias("is_vendor"), F.lit("mit").alias("license_type"), "doc_id")
    repos = docs.groupBy(F.floor(F.col("doc_id") / 40).cast("long").alias("repo")).agg(F.collect_list(file).alias("files"))
    meta = F.when(F.col("repo") % 5 != 4, F.struct((F.col("repo") % 7 == 0).alias("is_fork"), F.col("repo").cast("int").alias("stars")))
    return repos.select(F.concat(F.lit("org/repo"), "repo").alias("repo_path"), meta.alias("github_metadata"), "files")


WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINES = "string_split(text, chr(10))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


NORMAL = f"regexp_replace({strip_sql('lower(text)')}, '[{WS}]+', ' ', 'g')"
ALNUM = r"coalesce(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::double / nullif(length(text), 0), 0.0)"
CONTENT_LINES = f"list_filter(list_transform({LINES}, lambda x: {strip_sql('x')}), lambda x: x <> '')"
REPEATED = "coalesce((len(content) - len(list_distinct(content)))::double / nullif(len(content), 0), 0.0)"
ASCII = r"coalesce(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::double / nullif(length(text), 0), 0.0)"
STOPS = "[" + ", ".join(f"'{w}'" for w in language.STOP_WORDS) + "]"
OVERLAP = rf"len(list_intersect(regexp_extract_all(lower(substring(text, 1, 2000)), '[\p{{L}}\p{{N}}_]+'), {STOPS}))"
LID = f"""l0 as (select *, {ASCII} as share, {OVERLAP} as stops from d0),
l as (select *, case when length({strip_sql('text')}) < 20 then 'unknown' when share < 0.6 then 'unknown' when share > 0.9 and stops >= 3 then 'en' when share > 0.85 and stops >= 1 then 'en' when share > 0.75 then 'en' else 'unknown' end as lid,
 case when length({strip_sql('text')}) < 20 then 0.0::double when share < 0.6 then 0.1::double when share > 0.9 and stops >= 3 then 0.95::double when share > 0.85 and stops >= 1 then 0.88::double when share > 0.75 then 0.75::double else 0.4::double end as confidence from l0)"""
PHRASES = " + ".join(f"contains(lower(text), '{p}')::int" for p in tx.BOILERPLATE_PHRASES)


@query(f"select doc_id, {ALNUM} as alnum_ratio from documents")
def alnum_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.alnum_ratio(F.col("text")).alias("alnum_ratio"))


@query(f"""select doc_id, len({LINES})::int as num_lines, list_max([length(x) for x in {LINES}])::int as max_line_len,
 list_sum([length(x) for x in {LINES}])::double / len({LINES}) as avg_line_len,
 len([x for x in {LINES} if {strip_sql('x')} = ''])::double / len({LINES}) as blank_line_ratio from documents""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", tx.num_lines(t).alias("num_lines"), tx.max_line_length(t).alias("max_line_len"), tx.mean_line_length(t).alias("avg_line_len"), tx.blank_line_ratio(t).alias("blank_line_ratio"))


@query(f"select doc_id, sha256({NORMAL}) as content_hash, sha256(text) as raw_hash from documents")
def norm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.content_hash(F.col("text"), normalize=False).alias("raw_hash"))


@query(f"""with n as (select doc_id, {NORMAL} as body from documents)
select doc_id, (case when length(body) < 5 then 0 else len(list_distinct(list_transform(range(1, length(body) - 3), lambda i: substring(body, i, 5)))) end)::int as n_ngrams from n""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tx.text_ngrams(tx.normalized(F.col("text")))).alias("n_ngrams"))


GENERATED_SQL = "|".join(paths.GENERATED)


def flags_sql(path: str) -> str:
    name = f"list_last(string_split(regexp_replace({path}, '/+$', ''), '/'))"
    config = "(" + " or ".join(f"contains(lower({path}), '{m}')" for m in paths.CONFIG_MARKS) + ")"
    suffix = rf"lower(regexp_extract({name}, '(?s)^.+(\.[^.]+)$', 1))"
    data = f"({suffix} in ({', '.join(repr(s) for s in paths.DATA_SUFFIXES)}) and not {config})"
    doc = "((" + " or ".join([*(f"ends_with(lower({path}), '{s}')" for s in paths.DOC_SUFFIXES), *(f"contains(lower({path}), '{m}')" for m in paths.DOC_MARKS)]) + ") and not (" + " or ".join(f"starts_with(list_last(string_split(lower({path}), '/')), '{x}')" for x in paths.LEGAL_STARTS) + "))"
    return f"regexp_matches({path}, '(?i){GENERATED_SQL}') as is_generated, lower({name}) in ({', '.join(repr(s) for s in paths.LOCK_FILES)}) as is_lockfile, {config} as is_config, {data} as is_data_file, {doc} as is_doc"


@query(f"select page_id as id, 'url' as kind, {flags_sql('url')} from pages union all select doc_id, 'path', {flags_sql('p')} from (select doc_id, {PATH_SQL} as p from documents)")
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    def flags(p: Column) -> list[Column]:
        return [paths.is_generated(p).alias("is_generated"), paths.is_lock_file(p).alias("is_lockfile"), paths.is_config(p).alias("is_config"), paths.is_data_file(p).alias("is_data_file"), paths.is_documentation(p).alias("is_doc")]

    urls = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("url").alias("kind"), *flags(F.col("url")))
    files = sample_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("path").alias("kind"), *flags(F.col("file_path")))
    return urls.unionByName(files)


@query(f"with d0 as (select * from documents), {LID} select doc_id, lid, confidence from l")
def lid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", language.language(F.col("text")).alias("a"))
    return rows.select("doc_id", F.col("a.lang").alias("lid"), F.col("a.confidence").alias("confidence"))


@query(f"with d0 as (select * from documents), {LID} select lang, lid, count(*) as n from l group by 1, 2")
def lid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("lang", language.language(F.col("text"))["lang"].alias("lid"))
    return rows.groupBy("lang", "lid").agg(F.count("*").alias("n"))


#: The trained model: whole thousandths of logarithms over 16,384 buckets of trigrams, and a temperature from the rows held out.
MODEL_SQL = f"""points as (select doc_id, lang, text, list_transform(string_split(text, ''), lambda x: unicode(x)::bigint) as c from documents where text is not null),
grams as (select doc_id, lang, bucket, count(*) as n from (select doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 7919 + c[i + 1] * 104729 + c[i + 2] * 1299709) % 16384)) as bucket from points) group by 1, 2, 3),
seen as (select lang, bucket, sum(n) as n from grams where doc_id % 5 <> 0 and lang is not null group by 1, 2),
langs as (select lang, round(1000 * ln(count(*) / (sum(count(*)) over ())::double))::bigint as prior from documents where doc_id % 5 <> 0 and lang is not null and text is not null group by 1),
sums as (select l.lang, prior, coalesce(sum(n), 0) as total from langs l left join seen s on l.lang = s.lang group by 1, 2),
weights as (select s.lang, b.bucket, round(1000 * ln((coalesce(e.n, 0) + 1) / (s.total + 16384)::double))::bigint as w from sums s, (select unnest(range(16384)) as bucket) b left join seen e on e.lang = s.lang and e.bucket = b.bucket),
score as (select p.doc_id, p.lang as own, l.lang, l.prior + coalesce(sum(g.n * w.w), 0)::bigint as score from points p, langs l left join grams g on g.doc_id = p.doc_id left join weights w on w.lang = l.lang and w.bucket = g.bucket group by p.doc_id, p.lang, l.lang, l.prior),
loss as (select t, sum(loss) as loss from (select s.doc_id, t, ln(sum(exp((s.score - o.score) / (1000.0::double * t)))) as loss from score s join score o on o.doc_id = s.doc_id and o.lang = o.own, (select unnest([{', '.join(f'{t}::double' for t in language_model.TEMPERATURES)}]) as t) where s.doc_id % 5 = 0 group by 1, 2) group by 1),
model as (select p.doc_id, case when length({strip_sql('p.text')}) < 20 then 'unknown' else b.lang end as lid, case when length({strip_sql('p.text')}) < 20 then 0 else b.confidence end as confidence
  from points p join (select doc_id, arg_min(lang, (-score, lang)) as lang, 1 / sum(exp((score - best) / (1000.0::double * (select t from loss order by loss, t limit 1)))) as confidence from (select *, max(score) over (partition by doc_id) as best from score) group by doc_id) b on p.doc_id = b.doc_id)"""


def document_model(spark: SparkSession, sf_dir: str) -> language_model.LanguageModel:
    """Learned from `documents`; every fifth id is held out for the temperature."""
    return language_model.trained(read(spark, sf_dir, "documents"), F.col("doc_id") % 5 == 0)


@query(f"with {MODEL_SQL} select doc_id, lid, round(confidence, 6) as confidence from model")
def lid_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", document_model(spark, sf_dir)(F.col("text")).alias("a"))
    return rows.select("doc_id", F.col("a.lang").alias("lid"), F.round("a.confidence", 6).alias("confidence"))


@query(f"with {MODEL_SQL} select lang, lid, count(*) as n from documents d join model m on d.doc_id = m.doc_id group by 1, 2")
def lid_model_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.confusion(read(spark, sf_dir, "documents"), document_model(spark, sf_dir))


@query(f"""with {MODEL_SQL}, l as (select d.*, lid, confidence from documents d join model m on d.doc_id = m.doc_id), c as (select *, {CONTENT_LINES} as content from l),
r as (select doc_id, case when length(text) < 200 then 'doc_too_short' when length(text) > 500000 then 'doc_too_long' when {ALNUM} < 0.5 then 'doc_low_alnum' when not (lid = 'en' and confidence >= 0.7) then 'non_english_doc' when len({LINES}) > 5 and {REPEATED} > 0.4 then 'doc_boilerplate' end as doc_reason,
 case when length(text) < 200 then 'web_too_short' when length(text) > 200000 then 'web_too_long' when {ALNUM} < 0.6 then 'web_low_alnum' when not (lid = 'en' and confidence >= 0.7) then 'non_english_web' when ({PHRASES}) > 3 and ({PHRASES}) / greatest(length(text) / 500.0::double, 1.0::double) > 0.5 then 'web_boilerplate' end as web_reason from c)
select doc_id, doc_reason, web_reason from r""")
def filter_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documentation and web filters with the trained model in place of the rule."""
    rows = read(spark, sf_dir, "documents").withColumn("detected", document_model(spark, sf_dir)(F.col("text")))
    detect = lambda _: F.col("detected")
    return rows.select("doc_id", filters.doc_reason(F.col("text"), detect=detect).alias("doc_reason"), filters.web_reason(F.col("text"), detect=detect).alias("web_reason"))


@query(f"select doc_id, ({PHRASES})::int as phrases, ({PHRASES}) > 3 and ({PHRASES}) / greatest(length(text) / 500.0::double, 1.0::double) > 0.5 as boilerplate from documents")
def web_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.boilerplate_phrases(F.col("text")).alias("phrases"), tx.is_boilerplate(F.col("text")).alias("boilerplate"))


@query(f"with c as (select doc_id, {CONTENT_LINES} as content from documents) select doc_id, {REPEATED} as repeated from c")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.repeated_line_ratio(F.col("text")).alias("repeated"))


DOLLARS = r"(length(text) - length(replace(text, '$', '')) - (length(text) - length(replace(text, '\$', ''))) // 2)"
BEGINS = r"((length(text) - length(replace(text, '\begin{', ''))) // 7)"
ENDS = r"((length(text) - length(replace(text, '\end{', ''))) // 5)"
RUNS = """letters as (select doc_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as k from documents),
islands as (select doc_id, ch, k - row_number() over (partition by doc_id, ch order by k) as island from letters where ch <> chr(10)),
runs as (select distinct doc_id from (select doc_id from islands group by doc_id, ch, island having count(*) >= 11))"""
OCR = r"(regexp_matches(text, '[^\x00-\x7F]{10,}|[\x00-\x08\x0e-\x1f]{3,}|[|]{5,}') or doc_id in (select doc_id from runs))"


@query(f"with {RUNS} select doc_id, {OCR} as ocr, {DOLLARS}::int as dollars, ({DOLLARS} % 2 <> 0 and {DOLLARS} > 5) as broken_latex, ({BEGINS} > 0 and abs({BEGINS} - {ENDS}) > 2) as unmatched from documents")
def math_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", tx.has_ocr_artifact(t).alias("ocr"), tx.unescaped_dollars(t).alias("dollars"), tx.has_broken_latex(t).alias("broken_latex"), tx.has_unmatched_environment(t).alias("unmatched"))


CODE_RULES = f"""with f as (select *, {PATH_SQL} as p from documents), g as (select doc_id, text, {flags_sql('p')}, {LINES} as lines from f),
r as (select doc_id, case when strlen(text) < 100 then 'too_small' when strlen(text) > 1000000 then 'too_large' when is_generated then 'generated_file' when is_lockfile then 'lockfile' when is_data_file then 'data_file'
 when {ALNUM} < 0.25 then 'low_alphanumeric_ratio' when len(lines) < 3 then 'too_few_lines' when len(lines) > 10000 then 'too_many_lines' when len(list_filter(lines, lambda x: length(x) > 1000)) > 2 then 'lines_too_long' when {strip_sql('text')} = '' then 'empty' end as reason from g)"""
DOC_RULES = f"""with d0 as (select * from documents), {LID}, c as (select *, {CONTENT_LINES} as content from l),
r as (select doc_id, case when length(text) < 200 then 'doc_too_short' when length(text) > 500000 then 'doc_too_long' when {ALNUM} < 0.5 then 'doc_low_alnum' when not (lid = 'en' and confidence >= 0.7) then 'non_english_doc' when len({LINES}) > 5 and {REPEATED} > 0.4 then 'doc_boilerplate' end as reason from c)"""
WEB_RULES = f"""with d0 as (select d.*, q.quality from documents d left join labels q on d.doc_id = q.doc_id), {LID},
r as (select doc_id, source, text, case when length(text) < 200 then 'web_too_short' when length(text) > 200000 then 'web_too_long' when {ALNUM} < 0.6 then 'web_low_alnum' when coalesce(quality < 1, false) then 'web_low_quality' when not (lid = 'en' and confidence >= 0.7) then 'non_english_web'
 when ({PHRASES}) > 3 and ({PHRASES}) / greatest(length(text) / 500.0::double, 1.0::double) > 0.5 then 'web_boilerplate' end as reason from l)"""
MATH_RULES = f"""with d0 as (select * from documents), {RUNS}, {LID}, m as (select *, {CONTENT_LINES} as content from l),
r as (select doc_id, case when length(text) < 100 then 'math_too_short' when length(text) > 200000 then 'math_too_long' when {OCR} then 'math_ocr_artifact' when {DOLLARS} % 2 <> 0 and {DOLLARS} > 5 then 'math_broken_latex' when {BEGINS} > 0 and abs({BEGINS} - {ENDS}) > 2 then 'math_unmatched_env'
 when len(content) > 5 and {REPEATED} > 0.3 then 'math_repeated_content' when not (lid = 'en' and confidence >= 0.6) then 'non_english_math' end as reason from m)"""
FUNCTION_RULES = f"""with f as (select *, {IDENTIFIER_SQL} as identifier from documents),
r as (select doc_id, case when length(text) < 50 then 'vault_too_short' when length(text) > 50000 then 'vault_too_long' when {ALNUM} < 0.3 then 'vault_low_alnum' when {strip_sql("coalesce(identifier, '')")} = '' then 'vault_no_identifier' end as reason from f)"""


def with_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality_score"))
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left")


def code_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_documents(spark, sf_dir).select("doc_id", filters.REASONS["code"](None).alias("reason"))


def doc_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", filters.doc_reason(F.col("text")).alias("reason"))


def web_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(spark, sf_dir).select("doc_id", filters.web_reason(F.col("text"), F.col("quality_score"), filters.WebLimits(least_quality=1.0)).alias("reason"))


def math_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", filters.math_reason(F.col("text")).alias("reason"))


def function_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_documents(spark, sf_dir).select("doc_id", filters.function_reason(F.col("text"), F.col("identifier")).alias("reason"))


for _kind, _reasons, _sql in (("code", code_reasons, CODE_RULES), ("doc", doc_reasons, DOC_RULES), ("web", web_reasons, WEB_RULES), ("math", math_reasons, MATH_RULES), ("vault", function_reasons, FUNCTION_RULES)):
    QUERIES[f"filter_{_kind}"] = _reasons
    ORACLES[f"filter_{_kind}"] = f"{_sql} select doc_id, reason from r"
    QUERIES[f"filter_stats_{_kind}"] = lambda spark, sf_dir, f=_reasons: filters.filter_stats(f(spark, sf_dir))
    ORACLES[f"filter_stats_{_kind}"] = f"{_sql} select coalesce(reason, 'pass') as reason, count(*) as n from r group by 1"


@query(f"{WEB_RULES} select count(*) as total_seen, count(*) filter (reason is null) as total_passed, count(*) filter (reason is null)::double / count(*) as pass_rate from r")
def filter_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pass_rate(web_reasons(spark, sf_dir))


@query(f"""{CODE_RULES} select d.doc_id, {ALNUM} as alnum_ratio, len({LINES})::int as num_lines from documents d join r on d.doc_id = r.doc_id where reason is null""")
def filtered_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filtered(sample_documents(spark, sf_dir), "code").select("doc_id", "alnum_ratio", "num_lines")


@query(f"select doc_id from documents qualify row_number() over (partition by sha256({NORMAL}) order by doc_id) = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_firsts(read(spark, sf_dir, "documents"), "doc_id")


@query(f"select doc_id, source from documents qualify row_number() over (partition by source, sha256({NORMAL}) order by doc_id) = 1")
def exact_dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_firsts(read(spark, sf_dir, "documents"), "doc_id", scope=["source"])


@query(f"with h as (select sha256({NORMAL}) as h from documents) select count(*) as total_seen, count(distinct h) as \"unique\", count(*) - count(distinct h) as duplicates_found, (count(*) - count(distinct h))::double / count(*) as dedup_rate from h")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_stats(read(spark, sf_dir, "documents"))


@query(f"with seen as (select sha256({NORMAL}) as h from benchmark union select sha256({NORMAL}) from conversations) select doc_id from documents where sha256({NORMAL}) not in (select h from seen where h is not null)")
def seen_hash_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, against the hashes of two other tables."""
    known = dedup.content_hashes(read(spark, sf_dir, "benchmark")).unionByName(dedup.content_hashes(read(spark, sf_dir, "conversations")))
    return dedup.without_seen(read(spark, sf_dir, "documents").select("doc_id", "text"), known, order_key="doc_id").select("doc_id")


#: Sources whose documents an earlier build has taken.
EARLIER = ("src0", "src1", "src2")


@query(f"""with seen as (select sha256({NORMAL}) as h from benchmark union select sha256({NORMAL}) from documents where source in {EARLIER})
select doc_id from documents where text is null or sha256({NORMAL}) not in (select h from seen where h is not null)""")
def seen_set_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a lasting set of two versions: the benchmark, and what an earlier build took."""
    docs, known = read(spark, sf_dir, "documents"), seen.SeenSet(new_folder(spark, "seen"))
    known.add(dedup.content_hashes(read(spark, sf_dir, "benchmark")))
    known.add(dedup.content_hashes(docs.where(F.col("source").isin(*EARLIER))))
    return seen.unseen_keys(docs, known, "doc_id")


#: Texts on which the rules fire that plain documents never meet: other alphabets, OCR remains, open environments, many lines, signs, phrases, size.
RARE_SQL = f"""case when doc_id % 331 = 3 then repeat('abcdefgh' || chr(10), 120000) when doc_id % 8 = 0 then repeat('жи ', length(text) + 100) || ' ' || text when doc_id % 8 = 1 then text || ' ||||||' when doc_id % 8 = 2 then text || repeat(' ' || chr(92) || 'begin' || chr(123) || 'a}}', 3)
 when doc_id % 8 = 3 then repeat('ab cd' || chr(10), 10050) when doc_id % 8 = 4 then repeat('#$%& a' || chr(10), 300) when doc_id % 8 = 5 then '{". ".join(p.replace("'", "''") for p in tx.BOILERPLATE_PHRASES)} ' || substring(text, 1, 300) else text end"""


def rare_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_documents(spark, sf_dir).withColumn("text", F.expr(RARE_SQL))


def rare_rules(rules: str) -> str:
    """The rules over `rare` in place of `documents`."""
    return f"with rare as (select doc_id, source, lang, {RARE_SQL} as text from documents), " + rules.removeprefix("with ").replace("from documents", "from rare")


RARE_REASONS = {
    "code": (CODE_RULES, lambda d: filters.REASONS["code"](None)),
    "doc": (DOC_RULES, lambda d: filters.doc_reason(F.col("text"))),
    "web": (WEB_RULES.replace("when coalesce(quality < 1, false) then 'web_low_quality' ", ""), lambda d: filters.web_reason(F.col("text"))),
    "math": (MATH_RULES, lambda d: filters.math_reason(F.col("text"))),
}
for _kind, (_sql, _reason) in RARE_REASONS.items():
    QUERIES[f"filter_rare_{_kind}"] = lambda spark, sf_dir, f=_reason: rare_texts(spark, sf_dir).select("doc_id", f(None).alias("reason"))
    ORACLES[f"filter_rare_{_kind}"] = f"{rare_rules(_sql)} select doc_id, reason from r"


@query()
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of exact, then MinHash deduplication; permutations are this engine's own, so rows are checked by tests."""
    return dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", minhash=True).select("doc_id")


@query()
def near_dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates, after exact deduplication."""
    return dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", minhash=True, mode="components").select("doc_id")


REPOS_SQL = f"""with f as (select doc_id, doc_id // 40 as repo, {PATH_SQL} as file_path, {LANGUAGE_SQL} as language, text as content, strlen(text) as size_bytes, doc_id % 11 = 0 as is_vendor from documents),
m as (select *, case when repo % 5 <> 4 then repo % 7 = 0 end as is_fork, case when repo % 5 <> 4 then repo end as stars from f)"""


@query(f"""{REPOS_SQL} select 'org/repo' || repo as repo_path, file_path, language, length(content)::int as n, size_bytes::bigint as size_bytes, coalesce(stars, 0)::int as stars, 'stack_v3_code' as source, 'mit' as license_type
from m where not coalesce(is_fork, false) and not is_vendor and language in ({', '.join(repr(x) for x in loaders.CODE_LANGUAGES)}) and content <> ''""")
def flatten_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = loaders.code_files(sample_repositories(spark, sf_dir))
    return files.select("repo_path", "file_path", "language", F.length("text").alias("n"), "size_bytes", "stars", "source", "license_type")


@query(f"""{REPOS_SQL}, g as (select repo, file_path, content, size_bytes, {flags_sql('file_path')} from m) select 'org/repo' || repo as repo_path, file_path, length(content)::int as n, size_bytes::bigint as size_bytes, 'stack_v3_docs' as source from g where is_doc and content <> ''""")
def doc_file_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.documentation_files(sample_repositories(spark, sf_dir)).select("repo_path", "file_path", F.length("text").alias("n"), "size_bytes", "source")


def sample_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.col("text").alias("code"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("docstring"), F.expr("case when conv_id % 3 = 0 then '' else 'fn_' || conv_id end").alias("identifier"), F.expr("case conv_id % 4 when 0 then 'Python' when 1 then 'Haskell' when 2 then 'C#' else 'Go' end").alias("language"), F.lit(None).cast("string").alias("path"))


@query(f"""with f as (select conv_id, text as code, case when turn % 2 = 0 then role end as docstring, case when conv_id % 3 = 0 then '' else 'fn_' || conv_id end as identifier, case conv_id % 4 when 0 then 'Python' when 1 then 'Haskell' when 2 then 'C#' else 'Go' end as language from conversations)
select concat_ws(chr(10), case when identifier <> '' then '# Function: ' || identifier end, case when docstring <> '' then '\"\"\"' || docstring || '\"\"\"' end, code) as text, language, identifier, '' as path, 'the_vault' as source from f where code <> '' and language in ({', '.join(repr(x) for x in loaders.FUNCTION_LANGUAGES)})""")
def function_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.functions(sample_functions(spark, sf_dir))


@query("select d.doc_id, d.text, 'u' || d.doc_id as url, q.quality::double as quality_score, 'fineweb_hq' as source from documents d left join labels q on d.doc_id = q.doc_id where d.text <> ''")
def web_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = with_quality(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), "doc_id"))
    return loaders.web_pages(table).withColumn("doc_id", F.substring("url", 2, 20).cast("long"))


@query("select text, 'u' || doc_id as url, 'openwebmath' as source, (doc_id % 2)::int as n_keys from documents where text <> ''")
def math_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "documents").select("text", F.concat(F.lit("u"), "doc_id").alias("url"), F.when(F.col("doc_id") % 2 == 1, F.create_map(F.lit("lang"), "lang")).alias("metadata"))
    return loaders.math_pages(table).select("text", "url", "source", F.size("metadata").alias("n_keys"))


@query(f"""{REPOS_SQL}, g as (select *, {flags_sql('file_path')} from m), u as (
select 'stack_v3_code' as source, content from m where not coalesce(is_fork, false) and not is_vendor and language in ({', '.join(repr(x) for x in loaders.CODE_LANGUAGES)}) and content <> ''
union all select 'stack_v3_docs', content from g where is_doc and content <> '' union all select 'fineweb_hq', text from documents where text <> '')
select source, count(*) as n, sum(length(content))::bigint as chars from u group by 1""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = sample_repositories(spark, sf_dir)
    web = with_quality(spark, sf_dir).withColumn("url", F.lit(None).cast("string"))
    every = loaders.union_sources(loaders.all_sources({"stack_v3_code": repos, "stack_v3_docs": repos, "fineweb_hq": web}))
    return every.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select 'text' as \"column\", count(*) as n, min(length(text))::int as min_length, max(length(text))::int as max_length, avg(length(text))::double as avg_length from documents")
def verify_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.length_profile(read(spark, sf_dir, "documents"))


@query("select ordinal_position::int - 1 as position, column_name as \"column\", case data_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' else lower(data_type) end as type from information_schema.columns where table_name = 'documents'")
def dataset_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.columns_of(read(spark, sf_dir, "documents"))


@query("select conv_id * 1000 + turn as key, conv_id, turn, role, text from conversations order by 1 limit 10")
def dataset_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows, as a report on a data set shows them."""
    turns = read(spark, sf_dir, "conversations").withColumn("key", F.expr("conv_id * 1000 + turn"))
    peek = evaluation.first_rows(turns, "key")
    return peek.select("key", F.from_json("row", "conv_id long, turn long, role string, text string").alias("r")).select("key", "r.*")


@query("select doc_id, greatest(1, length(text) // 4)::bigint as tokens from documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


#: Targets from the input: 3/4 of all tokens; the kth of n sources by name gets k / (1 + ... + n) of them, so that the last ones run out and the others fill up.
TARGET_SQL = """(select source, 2.0::double * k / (n * (n + 1)) as proportion, (3 * total * k // (2 * n * (n + 1)))::bigint as target
from (select source, row_number() over (order by source) as k, count(*) over () as n, (sum(tokens) over ())::bigint as total from (select source, sum(greatest(1, length(text) // 4))::bigint as tokens from documents where source is not null group by 1))) as t"""


def mix_sql(rows: str, target: str) -> str:
    """CTEs that end in x(doc_id, source, tokens), the rows taken of `rows`(doc_id, source, tokens)."""
    return f"""b as (select d.doc_id, d.source, d.tokens, target from {rows} d join {target} on d.source = t.source),
c as (select *, coalesce(sum(tokens) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from b),
miss as (select greatest((select sum(target) from {target}) - sum(tokens), 0) as short from c where before < target),
e as (select *, row_number() over (partition by source order by doc_id) as turn from c where before >= target),
g as (select *, coalesce(sum(tokens) over (order by turn, source rows between unbounded preceding and 1 preceding), 0) as given from e),
x as (select doc_id, source, tokens from c where before < target union all select doc_id, source, tokens from g, miss where given < short)"""


MIX_SQL = "with " + mix_sql("(select doc_id, source, greatest(1, length(text) // 4)::bigint as tokens from documents)", TARGET_SQL)


def estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", tx.token_estimate(F.col("text")).alias("tokens"))


def input_targets(docs: DataFrame) -> DataFrame:
    """source, proportion, target from the input's own sources and tokens; one row a source."""
    every = Window.partitionBy()
    sums = docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    placed = sums.select("source", F.row_number().over(Window.orderBy("source")).cast("long").alias("k"), F.count("*").over(every).alias("n"), F.sum("tokens").over(every).alias("total"))
    return placed.select("source", F.expr("2.0D * k / (n * (n + 1))").alias("proportion"), F.expr("3 * total * k div (2 * n * (n + 1))").alias("target"))


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = estimated(spark, sf_dir)
    table = cut(input_targets(docs))
    return mixture.mix(docs, table, "doc_id"), table


@query(f"{MIX_SQL} select doc_id, source, tokens from x")
def mix_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir)[0]


@query(f"""{MIX_SQL}, s as (select source, sum(tokens)::bigint as actual, count(*) as docs from x group by 1)
select t.source, proportion as target_proportion, coalesce(actual, 0) / (select sum(actual) from s)::double as actual_proportion, target as target_tokens, coalesce(actual, 0)::bigint as actual_tokens, coalesce(docs, 0)::bigint as docs, coalesce(actual, 0) / target::double as completion
from {TARGET_SQL} left join s on t.source = s.source""")
def mixture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_report(*mixed(spark, sf_dir))


@query()
def mix_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded sequential draw; tests hold it against its row-by-row definition."""
    docs = estimated(spark, sf_dir)
    rows = input_targets(docs).collect()
    # Each goal again is its proportion of the total, rounded down.
    total = sum(r.target for r in rows)
    return mixture.mix_replay(docs, {r.source: r.proportion for r in rows}, total, "doc_id")


@query("with p as (select source, count(*)::double as proportion from documents group by 1) select source, proportion / sum(proportion) over () as proportion from p")
def renorm_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.renormalized(read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("double").alias("proportion")))


def draw_sql(salt: str) -> str:
    return f"('0x' || substr(md5(doc_id || ':{salt}'), 1, 8))::bigint"


FIM_SQL = f"""with a as (select doc_id, {LINES} as rows, {draw_sql('42:split')} as r1, {draw_sql('42:middle')} as r2, text from documents),
b as (select *, len(rows) as n, 1 + r1 % greatest(len(rows) - 2, 1) as s from a), c as (select *, 1 + r2 % greatest(least(5, n - s - 1), 1) as m from b),
f as (select doc_id, text, n, array_to_string(rows[1:s], chr(10)) as prefix, array_to_string(rows[s + 1:s + m], chr(10)) as middle, array_to_string(rows[s + m + 1:n], chr(10)) as suffix from c)"""


@query(f"{FIM_SQL} select doc_id, prefix, middle, suffix from f where n >= 3")
def fim_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", fim.fim_parts(F.col("text"), F.col("doc_id")).alias("p")).where("p is not null")
    return rows.select("doc_id", "p.prefix", "p.middle", "p.suffix")


@query(f"{FIM_SQL} select f.doc_id, case when source in ('src0', 'src1') and {draw_sql('42:fim').replace('doc_id', 'f.doc_id')} < 2147483648 and n >= 3 then '<|fim_prefix|>' || prefix || '<|fim_suffix|>' || suffix || '<|fim_middle|>' || middle else f.text end as text from f join documents d on d.doc_id = f.doc_id")
def fim_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = fim.maybe_fim(F.col("text"), F.col("source"), F.col("doc_id"), 0.5, code_sources=("src0", "src1"))
    return read(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


LENGTH, GROUP = 4096, 200


def pack_sql(rows: str, group: str = f"doc_id // {GROUP}") -> str:
    """CTEs that pack `rows` (doc_id, text): r has a document's group, sequence and tokens, st the number of each group's first record."""
    return f"""t as (select doc_id, {group} as grp, row_number() over (partition by {group} order by doc_id) as k, least(strlen(text) + 1, {LENGTH})::bigint as n from {rows}),
r as (select grp, k, doc_id, n, 0::bigint as seq, n as used from t where k = 1 union all
select t.grp, t.k, t.doc_id, t.n, case when r.used + t.n > {LENGTH} then r.seq + 1 else r.seq end, case when r.used + t.n > {LENGTH} then t.n else r.used + t.n end from r join t on t.grp = r.grp and t.k = r.k + 1),
st as (select grp, coalesce(sum(c) over (order by grp rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select grp, max(seq) + 1 as c from r group by 1))"""


PACK_SQL = f"with recursive {pack_sql('documents')}"


#: All documents as one stream.
STREAM_SQL = f"with recursive {pack_sql('documents', '0::bigint')}"


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", byte_token_count(F.col("text")).alias("tokens"))
    return packing.assign_sequences(docs, "doc_id", LENGTH, F.floor(F.col("doc_id") / GROUP))


@query(f"{PACK_SQL} select r.grp as \"group\", doc_id as key, n as tokens, seq, start + seq as seq_no from r join st on r.grp = st.grp")
def pack_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.global_sequence(assigned(spark, sf_dir))


@query(f"{STREAM_SQL} select doc_id as key, n as tokens, seq as seq_no from r")
def pack_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-fit over the whole table as one stream."""
    return packing.stream_sequences(read(spark, sf_dir, "documents").select("doc_id", byte_token_count(F.col("text")).alias("tokens")), "doc_id", LENGTH)


@query(f"""{PACK_SQL}, q as (select count(distinct (grp, seq)) as s, count(*) as d, sum(n)::bigint as real from r)
select s as total_sequences, d as total_docs_packed, real as total_tokens_packed, s * {LENGTH} - real as total_padding_tokens, (s * {LENGTH} - real)::double / (s * {LENGTH}) as padding_ratio, d::double / s as avg_docs_per_seq from q""")
def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_stats(assigned(spark, sf_dir), LENGTH)


@query(f"""with recursive {FIM_SQL.removeprefix('with ')},
bodies as (select f.doc_id, case when source in ('src0', 'src1') and {draw_sql('42:fim').replace('doc_id', 'f.doc_id')} < 2147483648 and n >= 3 then '<|fim_prefix|>' || prefix || '<|fim_suffix|>' || suffix || '<|fim_middle|>' || middle else f.text end as text from f join documents d on d.doc_id = f.doc_id),
long as (select * from bodies where strlen(text) >= 4), {pack_sql('long')},
ids as (select r.grp, r.seq, r.doc_id, r.n, list_concat(list_transform(regexp_extract_all(hex(encode(text)), '..')[1:r.n - 1], lambda h: ('0x' || h)::int), [256]) as ids from r join long on r.doc_id = long.doc_id)
select grp as \"group\", seq, md5(array_to_string(list_concat(flatten(list(ids order by doc_id)), list_transform(range({LENGTH} - sum(n)::bigint), lambda k: 257)), ',')) as ids_md5, sum(n)::int as real_tokens, count(*)::int as docs from ids group by 1, 2""")
def pack_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of packed byte-token records."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    packed = packing.packed_dataset(docs, BYTES, "doc_id", LENGTH, F.floor(F.col("doc_id") / GROUP), fim_rate=0.5, code_sources=("src0", "src1"))
    return packed.select("group", "seq", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.size(F.filter("attention_mask", lambda m: m == 1)).alias("real_tokens"), F.size("doc_starts").alias("docs"))


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer sequences for the record operators: the length of every line of each document."""
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(tx.lines(F.col("text")), F.length).alias("ids"))


IDS = f"list_transform({LINES}, lambda x: length(x))"
PAD_SQL = f"""with i as (select doc_id, {IDS} as ids from documents),
p as (select doc_id, list_concat(ids, list_transform(range(16 - len(ids)), lambda k: 257)) as input_ids, list_concat(ids, list_transform(range(16 - len(ids)), lambda k: -100)) as labels, list_concat(list_transform(ids, lambda k: 1), list_transform(range(16 - len(ids)), lambda k: 0)) as attention_mask from i)"""


def joined_text(*names: str) -> list[Column]:
    return [F.array_join(n, ",").alias(n) for n in names]


@query(f"{PAD_SQL} select doc_id, array_to_string(input_ids, ',') as input_ids, array_to_string(labels, ',') as labels, array_to_string(attention_mask, ',') as attention_mask from p")
def pad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records shorter than 16 are padded; longer ones stay whole."""
    rows = line_lengths(spark, sf_dir).select("doc_id", packing.packed_record(F.col("ids"), 16, 257).alias("r")).select("doc_id", "r.*")
    return rows.select("doc_id", *joined_text("input_ids", "labels", "attention_mask"))


@query("select vec_id, w as \"window\", len(embedding[w * 24 + 1:w * 24 + 24])::int as n, embedding[w * 24 + 1]::double as first, embedding[least(w * 24 + 24, len(embedding))]::double as last from (select *, unnest(range(ceil(len(embedding) / 24)::int))::int as w from embeddings)")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.token_windows(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 24, ("embedding",))
    return rows.select("vec_id", "window", F.size("embedding").alias("n"), F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


@query(f"""with i as (select doc_id, {IDS} as ids from documents), w as (select doc_id, ids, unnest(range(ceil(len(ids) / 6)::int))::int as "window" from i), s as (select doc_id, "window", ids["window" * 6 + 1:"window" * 6 + 6] as part from w)
select doc_id, "window", array_to_string(list_concat(part, list_transform(range(6 - len(part)), lambda k: 0)), ',') as input_ids, array_to_string(list_concat(part, list_transform(range(6 - len(part)), lambda k: -100)), ',') as labels from s""")
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = line_lengths(spark, sf_dir).select("doc_id", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"))
    return windows.token_windows(records, 6, ("input_ids", "labels"), pad={"input_ids": 0, "labels": packing.IGNORED}).select("doc_id", "window", *joined_text("input_ids", "labels"))


WINDOWS_SQL = f"""with i as (select doc_id, {IDS} as ids from documents), w as (select doc_id, ids, unnest(range(ceil(len(ids) / 12)::int))::int as "window" from i),
s as (select row_number() over (order by doc_id, "window") - 1 as record, doc_id, "window", ids["window" * 12 + 1:"window" * 12 + 12] as ids from w), z as (select *, record // 8 as batch_no, 12 - len(ids) as gap from s), b as (select *, max(gap) over (partition by batch_no) = 0 as whole from z)"""


@query(f"""{WINDOWS_SQL} select batch_no, record, array_to_string(list_concat(ids, list_transform(range(gap), lambda k: 257)), ',') as input_ids, array_to_string(list_concat(ids, list_transform(range(gap), lambda k: -100)), ',') as labels,
case when not whole then array_to_string(list_concat(list_transform(ids, lambda k: 1), list_transform(range(gap), lambda k: 0)), ',') end as attention_mask from b""")
def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are windows of the batch's length, so that collating cuts nothing off."""
    parts = windows.token_windows(line_lengths(spark, sf_dir), 12, ("ids",))
    numbered = parts.join(windows.row_numbers(parts.select("doc_id", "window"), ["doc_id", "window"], "record"), ["doc_id", "window"])
    rows = numbered.select("record", packing.packed_record(F.col("ids"), 12, 257).alias("r")).select("record", "r.*")
    return windows.collated(rows, "record", 12, 8, 257).select("batch_no", "record", *joined_text("input_ids", "labels", "attention_mask"))


@query("""with r as (select doc_id, source, length(text)::int as n, ('0x' || substr(md5(doc_id || ':42:1'), 1, 15))::bigint as rank from documents), n as (select *, row_number() over (order by rank, doc_id) - 1 as place from r)
select doc_id, source, n, place // 64 as batch_no from n where place // 64 < (select count(*) // 64 from documents)""")
def prefetch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return windows.shuffled_batches(rows, "doc_id", 64, seed=42, epoch=1)


@query("select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) between 6 and 20")
def skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.skip_and_limit(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 5, 15)


SEQ_SQL = f"{PACK_SQL}, sq as (select start + seq as seq_no, sum(n)::bigint as real_tokens from r join st on r.grp = st.grp group by 1), sh as (select *, (seq_no // 7 + 115)::int as shard_index, printf('shard_%05d', (seq_no // 7 + 115)::int) as shard_name from sq)"


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = packing.global_sequence(assigned(spark, sf_dir)).groupBy("seq_no").agg(F.sum("tokens").alias("real_tokens"))
    return shards.shard_assignment(sequences, 7, 115)


@query(f"{SEQ_SQL} select seq_no, real_tokens, shard_index, shard_name from sh")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark, sf_dir)


@query("""with recursive t as (select doc_id, strlen(coalesce(text, ''))::bigint as size_bytes, row_number() over (order by doc_id) as k from documents),
r as (select k, doc_id, size_bytes, 115::bigint as shard, size_bytes as used, 1::bigint as n from t where k = 1 union all
select t.k, t.doc_id, t.size_bytes, case when r.used >= 65536 or r.n >= 30 then r.shard + 1 else r.shard end, case when r.used >= 65536 or r.n >= 30 then t.size_bytes else r.used + t.size_bytes end, case when r.used >= 65536 or r.n >= 30 then 1 else r.n + 1 end from r join t on t.k = r.k + 1)
select doc_id, size_bytes, shard::int as shard_index, printf('shard_%05d', shard) as shard_name from r""")
def shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of different size, here the documents' own bytes: a shard is closed at 64 KiB or 30 records."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size_bytes"))
    return shards.shards_by_bytes(docs, 65_536, 30, "doc_id", first_shard=115)


@query(f"{SEQ_SQL} select shard_name, shard_index, count(*) as num_sequences, count(*) * {LENGTH * shards.TOKEN_BYTES} as size_bytes, count(*) * {LENGTH} as total_tokens_padded, sum(real_tokens)::bigint as total_tokens_real from sh group by 1, 2")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.manifest_rows(sharded(spark, sf_dir), LENGTH)


@query(f"{SEQ_SQL} select seq_no, real_tokens from sh where (seq_no + 1) * {LENGTH} < 400000 + {LENGTH}")
def stop_at_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.until_target(sharded(spark, sf_dir), LENGTH, 400_000).select("seq_no", "real_tokens")


@query("select vec_id, label from embeddings where vec_id = 17 union all select vec_id, label from embeddings where vec_id = (select count(*) - 3 from embeddings)")
def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return loaders.record_at(rows, 17, "vec_id").unionByName(loaders.record_at(rows, -3, "vec_id"))


@query("select vec_id as row_no, vec_id, label from (select *, row_number() over (order by vec_id) - 1 as place, count(*) over () as n from embeddings) where place in (17, n - 3) or (place >= 40 and place < 45)")
def arrow_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as Arrow shards, and rows of it looked up by their place: a look-up opens one record batch and two columns."""
    rows, path = read(spark, sf_dir, "embeddings"), new_folder(spark, "arrow")
    shards.write_shards(rows.select("*", F.floor(F.col("vec_id") / 50).cast("int").alias("shard_index"), F.col("vec_id").alias("seq_no")), path, "arrow")
    table = lambda: loaders.arrow_rows(spark, path, ["vec_id", "label"])
    n = loaders.arrow_row_count(spark, path)
    return table().where(F.col("row_no").isin(17, n - 3)).unionByName(table().where((F.col("row_no") >= 40) & (F.col("row_no") < 45)))


@query(f"select sum(((doc_id % 7) / 4.0::double) * n)::double as total_loss, sum(n)::bigint as total_tokens, exp(sum(((doc_id % 7) / 4.0::double) * n) / sum(n)) as perplexity from (select doc_id, text, length(text) // 4 as n from documents) where {strip_sql('text')} <> '' and n >= 2")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("text", ((F.col("doc_id") % 7) / F.lit(4.0)).alias("loss"), F.floor(F.length("text") / 4).alias("tokens"))
    return evaluation.perplexity(rows)


@query("select a.turn, a.conv_id, a.text as text_left, b.text as text_right from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the next of its conversation."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    at = lambda back: turns.withColumn("key", F.struct("conv_id", (F.col("turn") - back).alias("turn")))
    return evaluation.compared(at(0), at(1), "key", ["text"]).select("key.turn", "key.conv_id", "text_left", "text_right")


@query("select doc_id as seq_no, array_to_string(list_transform(range(32), lambda k: 1 + ('0x' || substr(md5('42:' || doc_id || ':' || k), 1, 8))::bigint % 999), ',') as input_ids from documents")
def synthetic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic record of 32 ids for every document."""
    return loaders.synthetic_for(read(spark, sf_dir, "documents"), "doc_id", 32, 1000).select("seq_no", *joined_text("input_ids"))


KINDS = ("code", "docs", "web", "math", "functions")
#: The production plan over `documents`: source k has filter kind k % 5 and (k + 1) / 210 of half of all tokens; the first two unique rows of a source are skipped.
SOURCES = [f"src{k}" for k in range(20)]
PLAN_SHARES = {s: (k + 1) / 210 for k, s in enumerate(SOURCES)}
PLAN_TARGET = "(select sum(greatest(1, length(text) // 4))::bigint // 2 from documents)"
PLAN_TARGET_SQL = "(select source, floor(share * (select total from goal))::bigint as target from (values " + ", ".join(f"('{s}', {p!r}::double)" for s, p in PLAN_SHARES.items()) + ") as v(source, share)) as t"
PLAN_SQL = f"""goal as (select {PLAN_TARGET} as total),
d0 as (select doc_id, source, text, {PATH_SQL} as p, {IDENTIFIER_SQL} as identifier, substr(source, 4)::int % 5 as kind from documents), {RUNS}, {LID},
f0 as (select *, {CONTENT_LINES} as content, {LINES} as lines, {flags_sql('p')} from l),
f1 as (select doc_id, source, text, case kind
 when 0 then strlen(text) < 100 or strlen(text) > 1000000 or is_generated or is_lockfile or is_data_file or {ALNUM} < 0.25 or len(lines) < 3 or len(lines) > 10000 or len(list_filter(lines, lambda x: length(x) > 1000)) > 2 or {strip_sql('text')} = ''
 when 1 then length(text) < 200 or length(text) > 500000 or {ALNUM} < 0.5 or not (lid = 'en' and confidence >= 0.7) or (len(lines) > 5 and {REPEATED} > 0.4)
 when 2 then length(text) < 200 or length(text) > 200000 or {ALNUM} < 0.6 or not (lid = 'en' and confidence >= 0.7) or (({PHRASES}) > 3 and ({PHRASES}) / greatest(length(text) / 500.0::double, 1.0::double) > 0.5)
 when 3 then length(text) < 100 or length(text) > 200000 or {OCR} or ({DOLLARS} % 2 <> 0 and {DOLLARS} > 5) or ({BEGINS} > 0 and abs({BEGINS} - {ENDS}) > 2) or (len(content) > 5 and {REPEATED} > 0.3) or not (lid = 'en' and confidence >= 0.6)
 else length(text) < 50 or length(text) > 50000 or {ALNUM} < 0.3 or {strip_sql("coalesce(identifier, '')")} = '' end as rejected from f0),
u as (select * from f1 where not rejected qualify row_number() over (partition by sha256({NORMAL}) order by doc_id) = 1),
k as (select doc_id, source, greatest(1, length(text) // 4)::bigint as tokens from u qualify row_number() over (partition by source order by doc_id) > 2),
{mix_sql('k', PLAN_TARGET_SQL)}"""


def production_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, corpus.CorpusPlan]:
    total = estimated(spark, sf_dir).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] // 2
    kinds = {s: KINDS[k % 5] for k, s in enumerate(SOURCES)}
    return sample_documents(spark, sf_dir), corpus.CorpusPlan(kinds, PLAN_SHARES, total, length=LENGTH, skip=2, shard_mb=1, first_shard=115)


@query(f"with {PLAN_SQL} select doc_id, source, tokens from x")
def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, plan = production_plan(spark, sf_dir)
    return corpus.curated(docs, plan, "doc_id").select("doc_id", "source", "tokens")


@query(f"""with recursive {PLAN_SQL}, taken as (select d.doc_id, d.text from documents d join x on d.doc_id = x.doc_id where strlen(d.text) >= 4), {pack_sql('taken', '0::bigint')},
sq as (select start + seq as seq_no, sum(n)::int as real_tokens, count(*)::int as docs, r.grp, seq from r join st on r.grp = st.grp group by 1, 4, 5)
select seq_no, real_tokens, docs, (seq_no // {shards.sequences_per_shard(LENGTH, 1)} + 115)::int as shard_index from sq where seq_no < ceil((select total from goal) / {LENGTH}::double)""")
def packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, plan = production_plan(spark, sf_dir)
    packed = corpus.built_shards(docs, plan, order_key="doc_id")
    return packed.select("seq_no", "real_tokens", F.size("doc_starts").alias("docs"), "shard_index")


REPORT_SQL = f"""with recursive {PLAN_SQL}, taken as (select d.doc_id, d.text from documents d join x on d.doc_id = x.doc_id where strlen(d.text) >= 4), {pack_sql('taken', '0::bigint')},
sq as (select seq, sum(n)::double as real, count(*) as docs from r where seq < ceil((select total from goal) / {LENGTH}::double) group by 1),
n as (select (select count(*) from f1)::double as seen, (select count(*) from f1 where not rejected)::double as passed, (select count(*) from u)::double as uniq, (select count(*) from sq)::double as seqs, (select sum(docs) from sq)::double as docs, (select sum(real) from sq)::double as real)
select 'filter' as step, 'total_seen' as name, seen as value from n union all select 'filter', 'total_passed', passed from n union all select 'filter', 'pass_rate', passed / seen from n
union all select 'dedup', 'total_seen', passed from n union all select 'dedup', 'unique', uniq from n union all select 'dedup', 'duplicates_found', passed - uniq from n union all select 'dedup', 'dedup_rate', (passed - uniq) / passed from n
union all select 'packing', 'total_sequences', seqs from n union all select 'packing', 'total_docs_packed', docs from n union all select 'packing', 'total_tokens_packed', real from n union all select 'packing', 'total_padding_tokens', seqs * {LENGTH} - real from n
union all select 'packing', 'padding_ratio', (seqs * {LENGTH} - real) / (seqs * {LENGTH}) from n union all select 'packing', 'avg_docs_per_seq', docs / seqs from n"""


@query(REPORT_SQL)
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the production build, counted while it runs; rejections by reason are in filter_stats."""
    docs, plan = production_plan(spark, sf_dir)
    counted = report.BuildReport()
    corpus.built_shards(docs, plan, order_key="doc_id", report=counted).write.format("noop").mode("overwrite").save()
    return counted.table(spark).where("name not like 'reason%'")


@query(f"with {PLAN_SQL} select doc_id, source || ':' || (row_number() over (partition by source order by doc_id) - 1) as doc_key from x")
def ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, plan = production_plan(spark, sf_dir)
    return corpus.ordinal_ids(corpus.curated_keys(docs, plan, "doc_id"), "doc_id").select("doc_id", "doc_key")


@query(f"""with {PLAN_SQL}, p as (select doc_id, source, rejected, coalesce(sum((not rejected)::int) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from f1)
select source, min(doc_id) as first_key, count(*) as n from p where rejected group by source, before having count(*) >= 3""")
def rejection_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three rows that the production plan rejects; its own limit is 5,000."""
    docs, plan = production_plan(spark, sf_dir)
    reasons = docs.select("source", "doc_id", corpus.source_reason(docs, plan.kinds).alias("reason"))
    return corpus.rejection_alerts(reasons, "doc_id", 3)


@query(f"""with d0 as (select * from documents), {LID}, r as (select doc_id, source, text from l where not (length(text) < 200 or length(text) > 200000 or {ALNUM} < 0.6 or not (lid = 'en' and confidence >= 0.7) or (({PHRASES}) > 3 and ({PHRASES}) / greatest(length(text) / 500.0::double, 1.0::double) > 0.5))),
u as (select * from r qualify row_number() over (partition by sha256({NORMAL}) order by doc_id) = 1)
select source, count(*) as docs, sum(greatest(1, length(text) // 4))::bigint as tokens from u group by 1""")
def flagship_curated_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.curated_report(read(spark, sf_dir, "documents"))
