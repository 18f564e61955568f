"""CSV and JSON sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.functions import scores as sc
from hemicycle.operators import filters, joins, quality
from hemicycle.schemas import CLASSES, DEPUTES, RUN_ERRORS, RUN_REPORT, SENTIMENTS, TRANSFORMED
from hemicycle.sources import storage

# Output field -> (input field, default) of the transformed projection.
TRANSFORMED_DEFAULTS = {
    "fonction": ("orateur_fonction", "N/A"),
    "para_id": ("para_id", ""),
    "orateur_nom": ("orateur_nom", "N/A"),
    "texte": ("texte", ""),
    "section_titre": ("section_titre", "N/A"),
    "sous_section_titre": ("sous_section_titre", "N/A"),
    "section_id": ("section_id", "N/A"),
}


def scan_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.option("header", "true").option("enforceSchema", "false")
        .option("multiLine", "false").schema(schema).csv(path)
    )


def read_csv_sentiments(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SENTIMENTS)


def read_csv_deputes(spark: SparkSession, path: str) -> DataFrame:
    """The four deputy columns that are used; other columns of the file are ignored."""
    header = spark.read.option("header", "true").csv(path)
    return header.select(*[F.col(f.name).cast(f.dataType) for f in DEPUTES.fields])


def write_csv_sentiments(df: DataFrame, path: str) -> None:
    """``para_id`` and the five probabilities with four decimals."""
    df.select("para_id", *[sc.format_prob(F.col(c)).alias(c) for c in CLASSES]).write.option(
        "header", "true"
    ).csv(path)


# Fields whose NULL in the fixed schema stands for an element the source lacked. The speaker
# fields are always set by the paragraph job, so their NULL is a value and stays NULL.
ABSENT_WHEN_NULL = ("section_titre", "sous_section_titre", "section_id")


def transformed(df: DataFrame, *extra: str) -> DataFrame:
    """The seven transformed fields (plus ``extra`` columns) with defaults for absent ones."""
    filled = [
        F.coalesce(F.col(n), F.lit(TRANSFORMED_DEFAULTS[n][1])).alias(n)
        if n in ABSENT_WHEN_NULL else F.col(n)
        for n in TRANSFORMED_DEFAULTS
    ]
    keep = {c: (c, "") for c in extra}
    return filters.project_defaults(df, {**TRANSFORMED_DEFAULTS, **keep}).select(*filled, *extra)


def write_transformed(df: DataFrame, path: str, year: str = "annee", merge: bool = False) -> None:
    """Seven fields as JSON lines in one folder per year; with ``merge`` only documents whose
    ``para_id`` is not there yet are added."""
    out = transformed(df, year)
    spark = df.sparkSession
    if merge and storage.exists(path):
        out = merge_transformed(out, read_transformed(spark, path))
    # dealt by year, so that not every task leaves a file in every year
    out.hint("rebalance", F.col(year)).write.mode("append" if merge else "errorifexists").partitionBy(year).json(path)


def read_transformed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Transformed documents: our JSON lines, or JSON arrays with ``multi_line``."""
    documents = spark.read.option("multiLine", str(multi_line).lower()).schema(TRANSFORMED).json(path)
    return documents.select(*TRANSFORMED.fieldNames())


def new_documents(batch: DataFrame, existing: DataFrame, key: str = "para_id") -> DataFrame:
    """Batch rows whose non-empty key is not in ``existing``; keyless rows always pass."""
    keyed = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    # keyless rows do not enter the join: they could all hash to one task
    fresh = joins.anti_join_existing(batch.where(keyed), existing.where(keyed), [key])
    return fresh.unionByName(batch.where(~keyed | F.col(key).isNull()))


def merge_transformed(batch: DataFrame, existing: DataFrame, key: str = "para_id") -> DataFrame:
    """What has to be appended; duplicates inside the batch stay."""
    return new_documents(batch, existing, key)


def write_result_json(df: DataFrame, base: str, run_id: str | None = None) -> str:
    """A result as JSON under a run folder of its own; an earlier run is never overwritten."""
    path = f"{base.rstrip('/')}/run_id={run_id or uuid.uuid4().hex}"
    df.write.mode("errorifexists").json(path)
    return path


def append_run_report(
    report: DataFrame, errors: DataFrame, path: str, run_id: str
) -> None:
    """Append one run (nested statistics) and its failed files (one row each)."""
    report.withColumn("run_id", F.lit(run_id)).select(*RUN_REPORT.fieldNames()).write.mode(
        "append"
    ).json(f"{path}/runs")
    errors.withColumn("run_id", F.lit(run_id)).select(*RUN_ERRORS.fieldNames()).write.mode(
        "append"
    ).json(f"{path}/errors")


def read_run_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(RUN_REPORT).json(f"{path}/runs"),
        spark.read.schema(RUN_ERRORS).json(f"{path}/errors"),
    )


def write_duplicates(df: DataFrame, keys: list[str], path: str) -> None:
    """Entries of duplicated keys, one JSON line each with the size of its group."""
    quality.duplicate_entries(df, keys).write.mode("errorifexists").json(path)


def write_reconciliation(left: DataFrame, right: DataFrame, column: str, path: str) -> None:
    """Summary of an id comparison, and its findings one JSON line each."""
    quality.reconcile_ids(left, right, column).write.mode("errorifexists").json(f"{path}/summary")
    quality.reconcile_detail(left, right, column).write.mode("errorifexists").json(f"{path}/findings")
