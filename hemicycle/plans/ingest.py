"""Archives -> interventions table, as whole jobs.

A load reads its archives once: a scan whose planning leaves out what need not be read, a
parser that gives finished runs, and one write of them to the shared folder, without any
exchange. Table and per-file results are made from that copy, which is then removed.

``archive_files`` is a folder, whose archives are read by the data source, or rows (path,
content), as a binary file scan or a stream gives them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.functions import files as fl
from hemicycle.operators import aggregates as ag
from hemicycle.operators import filters, quality
from hemicycle.schemas import REQUIRED_FIELDS
from hemicycle.session import checkpointed
from hemicycle.sources import archive_source, archives, files, table

KEY = "para_id"
ORDER = ["source_file", "ordinal"]
CHECKED = quality.Checked(
    key=KEY, text="texte", date_text="date_seance", speaker="orateur_nom", metadata="section_id",
    core=("date_seance", "texte", KEY), required=REQUIRED_FIELDS)


def interventions(archive_files: DataFrame | str, spark: SparkSession | None = None, keep_all: bool = False) -> DataFrame:
    """Parsed interventions of the given archives."""
    if isinstance(archive_files, str):
        return archives.run_interventions(archive_source.read_transcripts(spark, archive_files, keep_all))
    return archives.xml_paragraphs(archive_files, keep_all)


def named(paths: DataFrame) -> DataFrame:
    """Add (annee, publication_numero), read off the names, to rows with a ``path``."""
    path = F.col("path")
    return paths.select("*", fl.issue_year(path).alias("annee"), fl.issue_number(path).alias("publication_numero"))


def list_archives(spark: SparkSession, root: str, pattern: str = archive_source.ARCHIVE_PATTERN) -> DataFrame:
    """(path, length) of the archives under a folder; contents are not read."""
    return archives.scan_recursive(spark, root, pattern).select("path", "length")


def mark_new(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``new`` to rows (path, annee, publication_numero): no such issue is stored. A name
    without year or number is new. Both sides of the join are names and distinct issues."""
    issues = stored.where("annee IS NOT NULL AND publication_numero IS NOT NULL").select(
        F.col("annee").alias("_year"), F.col("publication_numero").alias("_number")).distinct()
    known = listed.join(issues, (F.col("annee") == F.col("_year")) & (F.col("publication_numero") == F.col("_number")), "left")
    return known.select(*listed.columns, F.col("_year").isNull().alias("new"))


def load_runs(runs: DataFrame, write: Callable[[DataFrame], str | None], path: str) -> DataFrame:
    """Write runs once, hand their interventions to ``write`` (which returns the id of a load of
    the table at ``path``) and return a status row per file that was read.

    ``documents_count`` rows were extracted, of which ``documents_stored`` entered the table.
    A file that cannot be read is a ``failed`` row with its error, never a silent loss.
    """
    with table.Staged(runs, "runs") as staged:
        load = write(archives.run_interventions(staged))
        stored = table.read_load(runs.sparkSession, path, load).groupBy(F.col("source_file").alias("_file")).agg(
            F.count("*").alias("stored"))
        seen = staged.where("kind = 'file'")
        status = F.when(F.col("rows") == 0, "failed").otherwise("success")
        done = seen.join(stored, F.col("source_file") == F.col("_file"), "left").select(
            F.col("source_file").alias("filename"), status.alias("status"), F.col("rows").alias("documents_count"),
            F.coalesce("stored", F.lit(0)).cast("long").alias("documents_stored"),
            F.col("seconds").alias("duration_seconds"),
            F.when(status == "failed", F.coalesce("error", F.lit("no document extracted"))).alias("error_message"),
            F.col("issue_year").alias("year"))
        return checkpointed(done)


def load_parsed(archive_files: DataFrame, path: str, replace: bool = False) -> DataFrame:
    """Load archives given as rows (path, content), whatever their issue."""
    return ingest_years(archive_files, path, None, replace)


def ingest_years(
    archive_files: DataFrame | str, path: str, years: list[int] | None = None, replace: bool = True,
    transformed_path: str | None = None, merge: bool = False, spark: SparkSession | None = None,
) -> DataFrame:
    """Transform the archives of the given years and load them; one status row per file."""
    wanted = None if years is None else [str(y) for y in years]
    if isinstance(archive_files, str):
        tests = [] if wanted is None else [("file_year", "in", wanted)]  # applied while files are listed
        runs = archive_source.read_transcripts(spark or SparkSession.getActiveSession(), archive_files, where=tests)
    else:
        if wanted is not None:
            archive_files = archive_files.where(fl.file_year(F.col("path")).isin(*wanted))
        runs = archives.transcript_runs(archive_files)

    def write(rows: DataFrame) -> str | None:
        if transformed_path:
            files.write_transformed(rows, transformed_path, merge=merge)
        if replace:
            return table.upsert_by_key(rows, path, KEY, ORDER, stage=False)
        return table.insert_if_absent(rows, path, KEY, ORDER)

    return load_runs(runs, write, path)


def ingest_year(archive_files: DataFrame | str, path: str, year: int, **options: object) -> DataFrame:
    return ingest_years(archive_files, path, [year], **options)


def ingest_incremental(
    archive_files: DataFrame | str, path: str, report_path: str | None = None, skip: bool = True,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Load only new archives, insert-if-absent; returns one status row per file.

    Names are listed and met with the stored issues first; of a folder, only the archives that
    are left are then opened, however many issues are stored. With a ``report_path``, the run,
    its failed files and the checks of the rows it wrote are added there; the checks are made
    by the job that writes.
    """
    watch = quality.Watch(CHECKED) if report_path else None

    def insert(rows: DataFrame) -> str:
        return table.insert_if_absent(rows, path, KEY, ORDER, last=watch.over if watch else table.as_it_is)

    on_disk = isinstance(archive_files, str)
    spark = spark or (SparkSession.getActiveSession() if on_disk else archive_files.sparkSession)
    begin = time.time()
    if not table.table_exists(path):
        table.create_table(spark, path)
    listed = named(list_archives(spark, archive_files) if on_disk else archive_files.select("path"))
    stored = table.read_table(spark, path)
    marked = mark_new(listed, stored) if skip else listed.withColumn("new", F.lit(True))
    # listed before anything is stored: this run's own rows do not make a file "known"
    with table.Staged(marked, "listed") as marked:
        if on_disk:
            new = table.Staged(marked.where("new").select("path", "length"), "files")
            with new:
                runs = archive_source.read_transcripts(spark, files=new.path)
                done = load_runs(runs, insert, path)
        else:
            new = marked.where("new").select(F.col("path").alias("_new"))
            runs = archives.transcript_runs(archive_files.join(new, F.col("path") == F.col("_new"), "left_semi"))
            done = load_runs(runs, insert, path)
        skipped = marked.where("NOT new").select(
            F.col("path").alias("filename"), F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("documents_count"),
            F.lit(0).cast("long").alias("documents_stored"), F.lit(0.0).alias("duration_seconds"),
            F.lit(None).cast("string").alias("error_message"), F.col("annee").alias("year"))
        results = checkpointed(done.unionByName(skipped))
    if report_path:
        run_id = uuid.uuid4().hex
        files.append_run_report(
            run_report(results, begin, time.time()), failed_files(results), report_path, run_id,
        )
        watch.report().withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{report_path}/checks")
    return results


def run_report(results: DataFrame, begin: float, end: float) -> DataFrame:
    """One row: start, end, duration, nested statistics."""
    stats = ag.run_statistics(results)
    return stats.select(
        F.timestamp_micros(F.lit(int(begin * 1e6))).alias("start_time"),
        F.timestamp_micros(F.lit(int(end * 1e6))).alias("end_time"),
        F.lit(end - begin).alias("duration_seconds"),
        F.struct("total", "success", "failed", "skipped", "documents_indexed").alias("statistics"),
    )


def failed_files(results: DataFrame) -> DataFrame:
    return filters.filter_term(results, "status", "failed").select(
        F.col("filename").alias("file"), F.col("error_message").alias("error")
    )


def table_overview(spark: SparkSession, path: str) -> DataFrame:
    return ag.table_status(table.read_table(spark, path))
