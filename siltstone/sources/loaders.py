"""Loaders as projections over source tables (O-01 to O-08, O-12)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.sources import arrow_ipc

#: The languages of the code and the function source.
CODE_LANGUAGES = ("Python", "TypeScript", "JavaScript", "C++", "C", "Rust", "Go", "Java", "Shell", "SQL", "HTML", "CSS", "Dockerfile")
FUNCTION_LANGUAGES = ("Python", "JavaScript", "Java", "Go", "Rust", "C++", "C", "C#", "Ruby", "PHP")


def has_text(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def code_files(repos: DataFrame, languages: Iterable[str] = CODE_LANGUAGES, exclude_forks: bool = True, exclude_vendor: bool = True) -> DataFrame:
    """One row per wanted file.  The array is filtered before it is unnested: predicates on unnested fields stay above the unnesting.

    A missing fork flag is no fork; a missing size is 0.
    """
    if exclude_forks:
        repos = repos.where(~F.coalesce("github_metadata.is_fork", F.lit(False)))
    languages = list(languages)

    def wanted(f: Column) -> Column:
        test = F.coalesce(f["language"].isin(*languages), F.lit(False)) & has_text(f["content"])
        return test & ~F.coalesce(f["is_vendor"], F.lit(False)) if exclude_vendor else test

    rows = repos.select("repo_path", F.coalesce("github_metadata.stars", F.lit(0)).alias("stars"), F.explode(F.filter("files", wanted)).alias("f"))
    return rows.select(F.col("f.content").alias("text"), F.col("f.language").alias("language"), F.col("f.file_path").alias("file_path"), "repo_path", F.coalesce("f.size_bytes", F.lit(0)).cast("long").alias("size_bytes"), "stars", F.lit("stack_v3_code").alias("source"), F.col("f.license_type").alias("license_type"))


def documentation_files(repos: DataFrame) -> DataFrame:
    """One row per documentation file; forks and vendored files count."""
    wanted = lambda f: F.coalesce(paths.is_documentation(f["file_path"]), F.lit(False)) & has_text(f["content"])
    rows = repos.select("repo_path", F.explode(F.filter("files", wanted)).alias("f"))
    return rows.select(F.col("f.content").alias("text"), F.col("f.file_path").alias("file_path"), "repo_path", F.lit("stack_v3_docs").alias("source"), F.coalesce("f.size_bytes", F.lit(0)).cast("long").alias("size_bytes"))


def web_pages(table: DataFrame) -> DataFrame:
    return table.where(has_text(F.col("text"))).select("text", "url", F.col("quality_score").cast("double").alias("quality_score"), F.lit("fineweb_hq").alias("source"))


def math_pages(table: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return table.where(has_text(F.col("text"))).select("text", "url", F.lit("openwebmath").alias("source"), F.coalesce("metadata", empty).alias("metadata"))


def function_text(code: Column, identifier: Column, docstring: Column, with_identifier: bool = True, with_docstring: bool = True) -> Column:
    """Name line, quoted docstring, code; absent parts leave no line."""
    name = F.when(has_text(identifier) & F.lit(with_identifier), F.concat(F.lit("# Function: "), identifier))
    doc = F.when(has_text(docstring) & F.lit(with_docstring), F.concat(F.lit('"""'), docstring, F.lit('"""')))
    return F.concat_ws("\n", name, doc, code)


def functions(table: DataFrame, languages: Iterable[str] = FUNCTION_LANGUAGES, with_identifier: bool = True, with_docstring: bool = True) -> DataFrame:
    """An empty list of languages takes all."""
    languages = list(languages)
    rows = table.where(F.col("language").isin(*languages)) if languages else table
    body = function_text(F.col("code"), F.col("identifier"), F.col("docstring"), with_identifier, with_docstring)
    return rows.where(has_text(F.col("code"))).select(body.alias("text"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("identifier", F.lit("")).alias("identifier"), F.coalesce("path", F.lit("")).alias("path"), F.lit("the_vault").alias("source"))


#: Source name -> loader of its table.
#: The names of the five sources.
LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {"stack_v3_code": code_files, "stack_v3_docs": documentation_files, "fineweb_hq": web_pages, "openwebmath": math_pages, "the_vault": functions}


def all_sources(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Loaded sources by name; unknown names are left out."""
    return {name: LOADERS[name](table) for name, table in tables.items() if name in LOADERS}


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources as one frame; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources.values())


def shard_format(spark: SparkSession, path: str) -> str | None:
    """`arrow` if a folder holds Arrow files at any depth, else `parquet` if it holds Parquet; hidden files do not count.

    A folder that Spark has finished (_SUCCESS) holds one format, so its first file tells; others are listed to the end.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None
    files, found, one_format = store.listFiles(place, True), None, store.exists(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))
    while files.hasNext():
        name = files.next().getPath().getName()
        if name.startswith((".", "_")):
            continue
        if name.endswith(".arrow"):
            return "arrow"
        if name.endswith(".parquet"):
            found = "parquet"
            if one_format:
                break
    return found


def read_shards(spark: SparkSession, *paths: str, output_format: str | None = None) -> DataFrame | None:
    """Shards under the first of the folders that holds some, at any depth: Arrow files if there are any, else Parquet; null where none does."""
    for path in paths:
        found = shard_format(spark, path)
        if found is not None:
            break
    else:
        return None
    if (output_format or found) == "arrow":
        arrow_ipc.register(spark)
        return spark.read.format("arrow_shards").option("path", path).load()
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def arrow_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of Arrow shards with row_no, their place from 0 in the order of file names, and only the columns named.

    Comparisons of row_no with numbers reach the source, so that a look-up opens the record batches that hold the rows.  Spark
    keeps them with the loaded table: load it once for every look-up, and do not use one loaded table under two of them.
    """
    arrow_ipc.register(spark)
    return spark.read.format("arrow_shards").option("path", path).option("columns", ",".join(columns or [])).option(arrow_ipc.ROW, "true").load()


def arrow_row_count(spark: SparkSession, path: str) -> int:
    """Rows by the committed lists, without opening a file that they name."""
    return sum(map(sum, arrow_ipc.batch_rows(path).values()))


def with_labels(records: DataFrame) -> DataFrame:
    """input_ids, labels (a copy of the ids where absent) and the mask if there is one, nothing else."""
    labels = F.coalesce("labels", "input_ids") if "labels" in records.columns else F.col("input_ids")
    rest = [c for c in ("attention_mask",) if c in records.columns]
    return records.select("input_ids", labels.alias("labels"), *rest)


def record_at(records: DataFrame, index: int, key: str = "seq_no", total: int | None = None) -> DataFrame:
    """The record of a global number by a pushed-down predicate; negative numbers count from the end."""
    if index < 0:
        index += records.count() if total is None else total
    return records.where(F.col(key) == index)


def synthetic_records(spark: SparkSession, n: int, length: int, vocabulary: int, seed: int = 42) -> DataFrame:
    """seq_no, input_ids, labels: ids in [1, vocabulary) from a hash of (seed, record, place)."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: (1 + F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(vocabulary - 1))).cast("int"))
    return spark.range(n).select(F.col("id").alias("seq_no"), ids.alias("input_ids")).withColumn("labels", F.col("input_ids"))


def synthetic_for(docs: DataFrame, key: str, length: int, vocabulary: int, seed: int = 42) -> DataFrame:
    """seq_no, input_ids, labels: a synthetic record for every row of a table, numbered by its key, as a stand-in of the same size for a training run.

    An id is 1 and the first 32 bits of md5(seed:key:place) modulo vocabulary - 1, so any engine makes the same ones.
    """
    drawn = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long")
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: (1 + drawn(k) % (vocabulary - 1)).cast("int"))
    return docs.select(F.col(key).alias("seq_no"), ids.alias("input_ids")).withColumn("labels", F.col("input_ids"))
