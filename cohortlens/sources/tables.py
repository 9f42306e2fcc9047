"""Table sources and sinks with declared schemas."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import fixed as X, text as S

_S = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names.split()])

#: Declared schemas by table.
REGISTRY = _S("query_id query_term uid pmcid pmid doi year pubdate title journal_abbrev journal_full first_author pmclivedate pmc_url ncbi_pmc_url pdf_url ncbi_total_count")
FETCH_LOG = _S("pmcid pmid doi year title status out_xml bytes_written http_status content_type article_type has_body n_sec_tags error")
SEGMENTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in "segment_uid pmcid pmid doi".split()]
    + [T.StructField("year", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in "title article_type case_id segment_type".split()]
    + [T.StructField("include_for_embedding", T.BooleanType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in "block_ids sec_paths".split()]
    + [T.StructField(n, T.LongType()) for n in "n_blocks n_chars_raw n_chars_clean leakage_n_matches_raw leakage_n_matches_clean".split()]
    + [T.StructField(n, T.StringType()) for n in "text_raw text_clean".split()]
)
BLOCKS = T.StructType([T.StructField("pmcid", T.StringType()), T.StructField("source", T.StringType()), T.StructField("block_index", T.IntegerType()), T.StructField("block_id", T.StringType()), T.StructField("sec_path", T.ArrayType(T.StringType())), T.StructField("sec_path_str", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a declared schema; only the columns that exist among those wanted (SRC-01 to SRC-03)."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names by Spark's own reader, so that any file system will do (SRC-05)."""
    return spark.read.option("header", True).csv(path).columns


def assert_columns(found: Sequence[str], expected: Sequence[str], label: str) -> None:
    if list(found) != list(expected):
        raise ValueError(f"{label}: columns {list(found)} are not {list(expected)}")


def load_curated(df: DataFrame, stages: Sequence[str], stage: str = "Temporal_Stage", subtype: str = "Subtype", text: str = "Description") -> DataFrame:
    """Rows of known stages with a subtype and text, numbered by content (SRC-06)."""
    missing = [c for c in (stage, subtype, text) if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    kept = df.where(F.col(stage).isin(*stages) & F.col(subtype).isNotNull() & F.col(text).isNotNull() & (F.trim(F.col(text)) != "") & (F.trim(F.col(subtype).cast("string")) != ""))
    return kept.withColumn("row_id", S.short_sha1(F.col(stage), F.col(subtype), F.col(text)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), small: bool = False) -> None:
    """Overwrite; small reports become one file (SNK-01)."""
    w = (df.coalesce(1) if small else df).write.mode("overwrite").partitionBy(*partition_by)
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def append_log(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Append with the schema enforced (SNK-02)."""
    if schema is not None:
        assert_columns(df.columns, schema.fieldNames(), path)
    df.write.mode("append").parquet(path)


def write_blocks(blocks: DataFrame, done: DataFrame | None, path: str) -> None:
    """JSON lines by document; those already written are left out (SNK-03)."""
    new = blocks if done is None else blocks.join(done.select("pmcid").distinct(), "pmcid", "left_anti")
    new.write.mode("append").partitionBy("pmcid").json(path)


def _put(folder: str):
    """Writes the files of a task's rows; a file gets its name when it is whole, so that whoever watches the folder, or a task that runs again, finds no part of one."""

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        attempt, n = TaskContext.get().taskAttemptId(), 0
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                if os.path.basename(name) != name or name[:1] in ("", "_", "."):
                    raise ValueError(f"{name!r} names no file that Spark's readers see")
                at = os.path.join(folder, f"_{attempt}-{n}")
                with open(at, "wb") as f:
                    f.write(content.as_buffer() or b"")
                os.replace(at, os.path.join(folder, name))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return put


def write_files(documents: DataFrame, folder: str) -> None:
    """A file of ``folder`` for each row (name, content): named files have no writer in Spark.

    On a file system that tasks see as a folder they write them by themselves: Spark's writers start processes for every local file, to set its
    permissions. Elsewhere (object stores, HDFS) Spark's text writer makes a folder ``pmcid=...`` for each, which ``documents.pmcid_of`` reads too.
    """
    spark = documents.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    dealt = documents.select("name", "content").repartition(4 * spark.sparkContext.defaultParallelism, "name")  # files are small beside the work that each makes
    if fs.getUri().getScheme() == "file":
        dealt.mapInArrow(_put(fs.makeQualified(at).toUri().getPath()), "n long").agg(F.sum("n")).first()
    else:
        texts = dealt.select(F.regexp_replace("name", r"\.[A-Za-z]+$", "").alias("pmcid"), F.col("content").cast("string").alias("value"))
        texts.write.mode("append").partitionBy("pmcid").text(folder)


def lock_config(path: str, config: dict, keys: Sequence[str]) -> dict:
    """Writes a run's configuration once; a resumed run must agree on ``keys`` (SNK-04, SNK-05). Driver side."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
        bad = [k for k in keys if old.get(k) != config.get(k)]
        if bad:
            raise ValueError(f"the run was started with other values of {bad}")
        return old
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2, sort_keys=True, ensure_ascii=False)
    return config


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file (SNK-12)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def disclosure_findings(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, reason) of files that a public repository must not hold; the first rule that fits counts (SNK-14)."""
    p = F.lower(F.col(column))
    name = F.substring_index(p, "/", -1)
    ext = F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1)
    reason = F.when(ext.isin(*X.FORBIDDEN_EXTENSIONS), "forbidden extension").when(name.isin(*X.FORBIDDEN_NAMES), "forbidden name").when(p.rlike(r"(^|/)(data|results)/") & ~name.isin("readme.md", ".gitkeep"), "data or results")
    return paths.select(F.col(column).alias("path"), reason.alias("reason")).where("reason IS NOT NULL")


def disclosure_audit(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, rule) of files, relative to the repository, that must not be published (SNK-14); the first rule that fits counts.

    Beyond names and endings: manuscripts, everything under data and results but placeholders, and tables whose names speak of
    segments, labels of cases, or ratings. Null paths and what lies under ``.git`` are no findings.
    """
    path = F.col(column)
    low = F.lower(path)
    name, top = F.substring_index(low, "/", -1), F.when(path.contains("/"), F.substring_index(path, "/", 1))
    ending = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: name.contains(w))
    table = ending == ".csv"
    rule = (
        F.when(top == "manuscript", "manuscript")
        .when(ending.isin(*X.FORBIDDEN_EXTENSIONS), "file type")
        .when(top.isin("data", "results") & ~path.isin(*X.PLACEHOLDERS), "data or results")
        .when(name.isin(*X.FORBIDDEN_NAMES), "file of cases")
        .when(table & any_of(X.CASE_WORDS), "segments or labels")
        .when(table & any_of(X.RATER_WORDS), "ratings")
        .when(ending.isin(".md", ".txt") & low.contains("ftd ratings"), "workbook")
    )
    return paths.where(~F.array_contains(F.split(path, "/"), ".git")).select(path.alias("path"), rule.alias("rule")).where("rule IS NOT NULL")


def assert_disclosable(paths: DataFrame, column: str = "path", shown: int = 20) -> None:
    """Raises if the audit finds anything, with the number of findings and the first paths: a command's exit status."""
    found = disclosure_audit(paths, column)
    n = found.count()
    if n:
        first = found.orderBy("path").limit(shown).collect()
        raise ValueError(f"{n} files must not be published: " + "; ".join(f"{r['path']} ({r['rule']})" for r in first))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as markdown (SNK-08)."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *(line(r) for r in rows)])


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where none is named and all tasks run in this process."""
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cohortlens-")
    return f"{at}/{uuid.uuid4().hex}"


# ---- registry ----


def registry_urls(df: DataFrame, pmcid: str = "pmcid") -> DataFrame:
    """Addresses of a record, null without an id (STR-14)."""
    c = F.nullif(F.col(pmcid), F.lit(""))
    page = F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), c, F.lit("/"))
    return df.withColumn("pmc_url", page).withColumn("ncbi_pmc_url", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), c, F.lit("/"))).withColumn("pdf_url", F.concat(page, F.lit("pdf/")))


def year_counts(df: DataFrame, year: Column) -> DataFrame:
    return df.select(year.alias("year")).where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n_papers"))


def recommend_split(counts: DataFrame, min_per_split: int = 200, tie: str = "earlier") -> DataFrame:
    """Cutoff year: feasible first, then balanced, then earlier or later (STT-17). One row; the year table is small."""
    total = F.sum("n_papers").over(W.partitionBy())
    c = counts.withColumn("n_discovery", F.sum("n_papers").over(W.orderBy("year").rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("n_confirmation", total - F.col("n_discovery"))
    ok = (F.col("n_discovery") >= min_per_split) & (F.col("n_confirmation") >= min_per_split)
    note = F.when(F.col("ok"), "Balanced split (meets min_per_split).").otherwise("Best-effort split (min_per_split not met).")
    best = c.withColumn("ok", ok).orderBy(F.desc("ok"), F.abs(F.col("n_discovery") - F.col("n_confirmation")), F.col("year") if tie == "earlier" else F.desc("year")).limit(1)
    return best.select(F.col("year").alias("cutoff_year"), "n_discovery", "n_confirmation", F.lit(min_per_split).alias("min_per_split"), F.lit(tie).alias("tie_breaker"), note.alias("note"))


def split_of_year(year: Column, cutoff: int) -> Column:
    return F.when(year <= cutoff, "discovery").when(year.isNotNull(), "confirmation")


def manifest(registry: DataFrame) -> DataFrame:
    """Suggested file names, duplicates numbered; screening columns are empty (WIN-04, STR-12)."""
    from ..operators.relational import duplicate_suffix

    clean = lambda c, most, default: F.left(F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-")), F.lit("")), F.lit(default)), F.lit(most))
    parts = [clean(F.coalesce("pmcid", F.lit("PMCID_UNKNOWN")), 20, "paper"), clean(F.coalesce(F.col("year").cast("string"), F.lit("YEAR_UNKNOWN")), 10, "paper"), clean(F.coalesce(F.nullif(F.split_part("first_author", F.lit(" "), F.lit(1)), F.lit("")), F.lit("Author")), 20, "paper"), clean(F.coalesce("title", F.lit("")), 60, "paper")]
    named = registry.withColumn("_stem", F.concat_ws("__", *parts))
    named = duplicate_suffix(named, "_stem", ["pmcid"], "_name").withColumn("suggested_pdf_filename", F.concat("_name", F.lit(".pdf"))).drop("_stem", "_name")
    return named.select("*", *(F.lit(None).cast("string").alias(c) for c in ("local_pdf_path", "screen_include", "screen_reason", "download_status", "notes")))
