"""Sources and sinks: Parquet, HTML folders, JSON lines, qrels, TREC runs, manifests, splits, results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trawl.functions.text import strip_undecodable
from trawl.sources import schemas
from trawl.sources.store import cut


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTIONS).parquet(path)


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """filing (the file's stem) and html of all .html files below a folder. Two files of one stem are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("filing")
    require_empty(duplicate_keys(files.select(stem), "filing"), "files of one name")
    return files.select(stem, strip_undecodable(F.col("content")).alias("html"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often; empty if they are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_empty(df: DataFrame, what: str) -> None:
    """Raises if a table of violations has rows."""
    found = df.take(3)
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_object(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, chunk_id, grade of a tab-separated file with a header. A key that comes twice keeps its last line, by the file's order."""
    lines = spark.read.schema(schemas.QRELS).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    lines = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos"))
    return lines.groupBy("qid", "chunk_id").agg(F.max_by("grade", F.struct("_file", "_block", "_pos")).alias("grade"))


def read_qrels_with_position(spark: SparkSession, path: str) -> DataFrame:
    """qid, chunk_id, grade of every line, with file_pos, the order in which lines stand, file by file; for "first gold". Splits of a file are read side by side, each counts its lines as they come, and what earlier splits hold is added, a number for each split; nothing is sorted."""
    lines = spark.read.schema(schemas.QRELS).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    lines = cut(lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")))
    before, total = [], 0
    for r in lines.groupBy("_file", "_block").agg(F.min("_line").alias("a"), F.count("*").alias("n")).orderBy("_file", "_block").collect():
        before.append((r["_file"], r["_block"], total - r["a"]))
        total += r["n"]
    splits = spark.createDataFrame(before, "_file string, _block long, _add long")
    return lines.join(F.broadcast(splits), ["_file", "_block"]).withColumn("file_pos", F.col("_line") + F.col("_add")).drop("_file", "_block", "_line", "_add")


def gold_sets(qrels: DataFrame) -> DataFrame:
    return qrels.select("qid", "chunk_id").distinct()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """system, qid, chunk_id, rank, score of one TREC file, a folder of them or what write_run() wrote; the system is the file's stem, or the name of write_run()'s folder, with @ for _at_. Ranks are made anew by (rank, chunk_id)."""
    from pyspark.sql import Window

    lines = spark.read.schema(schemas.RUN_LINES).option("sep", " ").csv(path)
    stem = F.col("system").cast("string") if "system" in lines.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    lines = lines.select(F.replace(stem, F.lit("_at_"), F.lit("@")).alias("system"), "qid", "chunk_id", "rank", "score")
    order = Window.partitionBy("system", "qid").orderBy("rank", "chunk_id")
    return lines.withColumn("rank", F.row_number().over(order))


def run_lines(run: DataFrame) -> DataFrame:
    """system, qid, rank and the TREC line of each row of a run; ranks from 1 by falling score."""
    from pyspark.sql import Window

    order = Window.partitionBy("system", "qid").orderBy(F.desc("score"), "chunk_id")
    ranked = run.withColumn("rank", F.row_number().over(order))
    return ranked.select("system", "qid", "rank", F.format_string("%s Q0 %s %d %.6f %s", F.col("qid").cast("string"), F.col("chunk_id").cast("string"), "rank", "score", "system").alias("line"))


def write_run(run: DataFrame, path: str) -> None:
    """TREC files in one folder for each system, @ written as _at_."""
    out = run_lines(run).select(F.replace("system", F.lit("@"), F.lit("_at_")).alias("system"), "qid", "rank", "line")
    out.repartition("system", "qid").sortWithinPartitions("system", "qid", "rank").select("system", F.col("line").alias("value")).write.mode("overwrite").partitionBy("system").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    named = qrels.select(F.col("qid").alias("query-id"), F.col("chunk_id").alias("corpus-id"), F.col("grade").alias("score"))
    named.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json_object(row: DataFrame, path: str) -> None:
    """One JSON object: of a table with one row, such as statistics or a split. Another number of rows is an error."""
    if len(row.take(2)) != 1:
        raise ValueError("a JSON object is made of exactly one row")
    row.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, key: str, metrics: list[str]) -> DataFrame:
    """key, metric, value of result tables in JSON, a line or object for each system."""
    fields = ", ".join([f"`{key}` string", *[f"`{m}` double" for m in metrics]])
    return unpivot_metrics(spark.read.schema(fields).json(path), key, metrics)


def split_object(sides: DataFrame, seed: int, test_frac: float) -> DataFrame:
    """One row as a frozen split is kept: seed, test_frac, train, test, names in order. Names of filings, so a list of them fits a row."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("filing")))).alias(s)
    return sides.agg(F.lit(seed).cast("long").alias("seed"), F.lit(test_frac).cast("double").alias("test_frac"), names("train"), names("test"))


def split_sides(frozen: DataFrame) -> DataFrame:
    """filing, side of a frozen split."""
    side = lambda s: frozen.select(F.explode(s).alias("filing"), F.lit(s).alias("side"))
    return side("train").unionByName(side("test"))


def unpivot_metrics(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return df.unpivot(key, metrics, "metric", "value")


def markdown_table(rows: list, columns: list[str], digits: int = 4) -> str:
    """A table for people, numbers rounded; for result tables of a few rows."""
    text = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [columns, ["---"] * len(columns), *[[text(r[c]) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def overlay(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Values by key, new ones first."""
    a, b = old.select(key, F.col(value).alias("_a")), new.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias(value))


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Idempotent by partition: what a rerun writes replaces what is there, partition by partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def unfinished(todo: DataFrame, spark: SparkSession, path: str, *by: str) -> DataFrame:
    """The rows whose partitions aren't written yet; all if there is nothing."""
    if not exists(spark, path):
        return todo
    done = spark.read.parquet(path).select(*by).distinct()
    return todo.join(done, list(by), "left_anti")


def fingerprint(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row: SHA-1 over the ids in order, nothing between them, and the number of rows. A digest is a chain, so sorted ids pass one task; it folds them as they come and holds none. Null ids add nothing."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha1(), 0
        for b in batches:
            n += b.num_rows
            digest.update("".join(i for i in b.column(0).to_pylist() if i is not None).encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], ["f", "n"])

    rows = df.select(F.col(id_col).cast("string").alias("i"), F.col(order_col).alias("o")).repartition(1).sortWithinPartitions("o", "i")
    whole = rows.select("i").mapInArrow(fold, "f string, n long")
    # without rows there may be no task
    return whole.agg(F.coalesce(F.max("f"), F.lit(hashlib.sha1().hexdigest())).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def manifest(vectors: DataFrame, model: str, id_col: str = "id", order_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    dim = vectors.agg(F.max(F.size(vector_col)).cast("long").alias("dim"))
    return fingerprint(vectors, id_col, order_col).join(dim).select(F.lit(model).alias("model"), F.col("n").alias("n_chunks"), "dim", "fingerprint")


def guarded(vectors: DataFrame, expected: DataFrame, model: str, **columns: str) -> DataFrame:
    """The vectors, if their manifest is as expected; a missing or different one is an error."""
    want = expected.take(1)
    have = manifest(vectors, model, **columns).first()
    if not want or any(want[0][k] != have[k] for k in ("model", "n_chunks", "dim", "fingerprint")):
        raise ValueError(f"embeddings don't fit their manifest: {want[:1]} and {have}")
    return vectors


def loss_points(history: DataFrame) -> DataFrame:
    """model, series, step, loss of histories that hold arrays of pairs."""
    both = [history.select("model", F.lit(s).alias("series"), F.explode(s).alias("p")) for s in ("train", "val")]
    return both[0].unionByName(both[1]).select("model", "series", F.element_at("p", 1).cast("long").alias("step"), F.element_at("p", 2).alias("loss"))


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """model, qid, system, prediction, gold of parallel arrays."""
    rows = predictions.select("model", F.explode(F.arrays_zip("ids", "gold", "base", "qlora")).alias("r"))
    return rows.select("model", F.col("r.ids").alias("qid"), F.col("r.gold").alias("gold"), F.col("r.base").alias("base"), F.col("r.qlora").alias("qlora")).unpivot(["model", "qid", "gold"], ["base", "qlora"], "system", "prediction")
