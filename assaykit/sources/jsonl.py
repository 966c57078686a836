"""JSON-lines and run files as DataFrames, with the reader's rules on comments, order and errors."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import labels as L
from assaykit.shared import checkpointed

_TEXT, _TEXTS, _FACTS = T.StringType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


def _fields(kinds: dict) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


EXAMPLE = _fields(
    dict.fromkeys(("id", "input", "label", "heading"), _TEXT)
    | {"answerable": T.BooleanType(), "justification": _TEXT, "difficulty": _TEXT, "tags": _TEXTS}
    | dict.fromkeys(("source", "source_id", "collected_at", "labelled_at", "labeller_notes", "labelled_by", "deprecated_by"), _TEXT)
    | {"collection_meta": _FACTS, "model_notes": _FACTS}
)
RUN_ROW = _fields(
    {"id": _TEXT, "gold_slab": _TEXT, "predicted_slab": _TEXT, "correct": T.BooleanType(), "stale_slab": _TEXT, "stale_cited": _TEXTS, "hsn_correct": T.BooleanType()}
    | dict.fromkeys(("tokens_in", "tokens_out", "latency_ms"), T.IntegerType())
    | {"error": _TEXT}
)
RUN = _fields(
    dict.fromkeys(("run_id", "model_key", "model_id", "served_model_id", "provider", "tier", "prompt_version", "prompt_mode", "dataset_sha"), _TEXT)
    | {"dataset_n": T.IntegerType(), "started_at": _TEXT, "finished_at": _TEXT, "summary": _FACTS, "cost": _FACTS, "notes": _TEXT, "rows": T.ArrayType(RUN_ROW)}
)
REQUIRED_RUN = ("model_key", "model_id", "provider", "started_at", "summary", "cost")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checked(column: Column, broken: Column, message: Column) -> Column:
    """The column, or an error while the plan runs."""
    return F.when(broken, F.raise_error(message)).otherwise(column)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = EXAMPLE) -> DataFrame:
    """Rows of a file in its order (pos). Blank and // lines are skipped; a missing file has no rows; a malformed line raises with file and line."""
    out = T.StructType([*schema.fields, T.StructField("pos", T.LongType())])
    if not exists(spark, path):
        return spark.createDataFrame([], out)
    return _lines(spark, path).transform(lambda d: _parsed(d, schema)).drop("file")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of lines that aren't blank or comments; line counts all of a file's lines from 0.

    Files are read in splits, a line a row. Lines are checkpointed with their split and their place in the
    scan; a line's number is its place in its split and the lines of the file's earlier splits.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    at = F.col("_metadata.file_block_start")
    lines = checkpointed(scan.select(F.col("_metadata.file_path").alias("path"), at.alias("block"), F.monotonically_increasing_id().alias("k"), "value"))
    each = lines.groupBy(F.col("path").alias("p"), F.col("block").alias("b")).agg(F.min("k").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("before", F.coalesce(before, F.lit(0)))
    blank = F.trim(F.regexp_replace("value", r"\s+", " "))
    told = lines.where((blank != "") & ~blank.startswith("//")).join(each, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    return told.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("k") - F.col("first") + F.col("before")).alias("line"), "value")


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    df = lines.withColumn("_j", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    df = df.withColumn("_j", checked(F.col("_j"), broken, F.format_string("%s:%d: malformed row", F.col("file"), F.col("line") + 1)))
    return df.select(*(F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields), F.col("line").cast("long").alias("pos"), "file")


def with_defaults(df: DataFrame) -> DataFrame:
    """Example rows with what a missing field means."""
    empty = F.array().cast("array<string>")
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("justification", "source", "source_id", "collected_at", "labelled_at", "labeller_notes")} | {"tags": F.coalesce("tags", empty), "labelled_by": F.coalesce("labelled_by", F.lit("human"))})


def read_pool(spark: SparkSession, folder: str, schema: T.StructType, names: str = "*.jsonl") -> DataFrame:
    """All rows of a folder's files of such names; (file, line) is their stable order."""
    return _parsed(_lines(spark, f"{folder}/{names}"), schema).withColumnRenamed("pos", "line")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """First-pass rows with a settled label and a heading, as typical examples."""
    df = read_jsonl(spark, path).where((F.col("label") != L.UNCERTAIN) & (F.coalesce("heading", F.lit("")) != ""))
    return df.withColumns({"difficulty": F.lit("typical"), "source": F.coalesce(F.nullif("source", F.lit("")), F.lit("aar"))})


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files, one JSON document each. Broken JSON or a missing field raises with the file's name; files without run_id are left out."""
    wide = T.StructType([*RUN.fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    df = df.withColumn("j", checked(F.col("j"), F.col("j").isNull() | F.col("j._corrupt").isNotNull(), F.concat(F.col("file"), F.lit(": not JSON"))))
    df = df.where(F.col("j.run_id").isNotNull())
    for name in REQUIRED_RUN:
        df = df.withColumn("j", checked(F.col("j"), F.col(f"j.{name}").isNull(), F.concat(F.col("file"), F.lit(f": no {name}"))))
    return df.select("j.*", "file").drop("_corrupt")


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "file")


def fingerprint(spark: SparkSession, path: str) -> tuple[str, int]:
    """(SHA-256 of a file's bytes, its lines that aren't blank); ('', 0) for a missing file."""
    if not exists(spark, path):
        return "", 0
    sha = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return sha, spark.read.text(path).where(F.trim("value") != "").count()


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256, text) of files, text taken as UTF-8 with white space squeezed."""
    df = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\s+", " ")
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"), text.alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a source manifest."""
    schema = "documents array<struct<file:string,title:string,dated:string,in_force_from:string,gazette:string,effect:string,must_contain:array<string>,bytes:bigint,sha256:string,pages:int>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("documents"))


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines: comments, 'export ', paired quotes and a byte-order mark go; empty values are left out."""
    out = {}
    for line in text.removeprefix("﻿").splitlines():
        line = line.strip().removeprefix("export ").strip()
        key, sign, value = line.partition("=")
        value = value.strip()
        if not sign or line.startswith("#"):
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        if value:
            out[key.strip()] = value
    return out


def load_env(path: str, override: bool = False, env=os.environ) -> list[str]:
    """Set a file's variables that the environment lacks or has empty (all, with override); their names. A missing file sets none."""
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8") as f:
        found = parse_env(f.read())
    new = [k for k in found if override or not env.get(k)]
    env.update((k, found[k]) for k in new)
    return new
