"""The interventions table: Parquet by year, updated by key, in versions.

``merge_*`` are pure DataFrame operators. ``upsert_by_key`` and ``insert_if_absent`` apply them
to a stored table::

    table/data/annee=2018/load=<id>/*.parquet     rows, never changed once written
    table/versions/00000007.json                  the folders that version 7 is made of

A load writes its rows into folders of its own and then makes a new version that names them,
by renaming a finished file into place; until then no reader sees them, and a load that fails
takes its folders away and leaves the table as it was. An insert adds folders, an upsert puts
one new folder in place of the old ones of each year it touches. A reader stays on the version
it opened; folders that no version of the last ``KEPT_VERSIONS`` names are removed after a
commit. Loads of one table follow each other: a commit on a version that is no longer the last
is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.operators.joins import latest_per_key
from hemicycle.schemas import INTERVENTIONS
from hemicycle.session import scratch_path
from hemicycle.sources import storage
from hemicycle.sources.files import new_documents

YEAR, LOAD = "annee", "load"
#: Versions whose rows are kept: the last one, and those that readers may still be on.
KEPT_VERSIONS = 3
#: Folders of a year beyond which an insert rewrites the year into one.
MOST_FOLDERS = 16


Step = Callable[[DataFrame], DataFrame]


def as_it_is(df: DataFrame) -> DataFrame:
    return df


class ConcurrentLoad(RuntimeError):
    """Another load made a new version in the meantime."""


def _keyed(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string") != "", F.lit(False))


def batch_last_wins(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key along ``order``; rows without a key are all kept."""
    keyed = latest_per_key(batch.where(_keyed(key)), [key], [F.desc(o) for o in order])
    return keyed.unionByName(batch.where(~_keyed(key)))


def batch_first_wins(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    keyed = latest_per_key(batch.where(_keyed(key)), [key], [F.asc(o) for o in order])
    return keyed.unionByName(batch.where(~_keyed(key)))


def merge_upsert(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Table after the upsert: rows of the batch replace rows of the same key."""
    return new_documents(target, batch, key).unionByName(batch_last_wins(batch, key, order))


def absent_rows(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows an insert-if-absent adds."""
    return new_documents(batch_first_wins(batch, key, order), target, key)


def merge_insert(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    return target.unionByName(absent_rows(target, batch, key, order))


def skipped_count(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Batch rows an insert-if-absent leaves out."""
    added = absent_rows(target, batch, key, order).agg(F.count("*")).scalar()
    return batch.agg(F.count("*").alias("n")).withColumn("a", added).select(
        F.col("a").alias("inserted"), (F.col("n") - F.col("a")).alias("skipped")
    )


# versions


def versions(path: str) -> list[int]:
    return [int(n[:-5]) for n in storage.names_in(f"{path}/versions", "[0-9]*.json")]


def _version_file(path: str, version: int) -> str:
    return f"{path}/versions/{version:08d}.json"


def folders_of(path: str, version: int | None = None) -> tuple[int, list[str]]:
    """The version (by default the last) and its folders, below ``data``; 0 if there is none."""
    known = versions(path)
    if version is None:
        version = known[-1] if known else 0
    if version == 0:
        return 0, []
    return version, json.loads(storage.read_text(_version_file(path, version)))["folders"]


def commit(path: str, base: int, folders: list[str]) -> int:
    """Make the version after ``base``, of these folders, by one rename; then clean up."""
    waiting = f"{path}/versions/.{uuid.uuid4().hex}"
    storage.write_bytes(waiting, json.dumps({"folders": sorted(folders)}).encode())
    final = _version_file(path, base + 1)
    if (versions(path) or [0])[-1] != base or storage.exists(final):
        storage.remove(waiting)
        raise ConcurrentLoad(f"{path} is no longer at version {base}")
    storage.rename(waiting, final)
    clean_up(path)
    return base + 1


def clean_up(path: str, keep: int = KEPT_VERSIONS) -> None:
    """Drop versions before the last ``keep``, and the folders that only they name."""
    known = versions(path)
    kept = {f for v in known[-keep:] for f in folders_of(path, v)[1]}
    for version in known[:-keep]:
        for folder in set(folders_of(path, version)[1]) - kept:
            storage.remove(f"{path}/data/{folder}")
        storage.remove(_version_file(path, version))


def _year_of(folder: str) -> str:
    return folder.split("/")[0]


def _labels(years: list[int | None], year: str) -> set[str]:
    return {f"{year}={'__HIVE_DEFAULT_PARTITION__' if y is None else y}" for y in years}


def _write_load(df: DataFrame, path: str, year: str, last: Step) -> tuple[str, list[str]]:
    """Write rows into folders of a new load; its id, and the folders that got rows.

    Rows are dealt by year before the write (adaptively: a large year over several files, a
    small one to a single file), so a load does not leave a file per task and year.
    """
    load = uuid.uuid4().hex
    try:
        dealt = last(df.hint("rebalance", F.col(year))).withColumn(LOAD, F.lit(load))
        dealt.write.mode("append").partitionBy(year, LOAD).parquet(f"{path}/data")
    except BaseException:
        _forget_load(path, load, year)
        raise
    return load, _folders_of_load(path, load, year)


def _folders_of_load(path: str, load: str, year: str) -> list[str]:
    years = storage.names_in(f"{path}/data", f"{year}=*")
    return [f"{y}/{LOAD}={load}" for y in years if storage.exists(f"{path}/data/{y}/{LOAD}={load}")]


def _forget_load(path: str, load: str, year: str) -> None:
    for folder in _folders_of_load(path, load, year):
        storage.remove(f"{path}/data/{folder}")


def _load_and_commit(df: DataFrame, path: str, year: str, base: int, kept: list[str], last: Step) -> str:
    load, fresh = _write_load(df, path, year, last)
    try:
        commit(path, base, [*kept, *fresh])
    except BaseException:
        _forget_load(path, load, year)
        raise
    return load


# stored tables


def table_exists(path: str) -> bool:
    return bool(versions(path))


def create_table(
    spark: SparkSession, path: str, schema: T.StructType = INTERVENTIONS, year: str = YEAR
) -> None:
    """Drop and recreate the table, empty: a version without folders."""
    commit(path, folders_of(path)[0], [])


def _read_folders(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField(LOAD, T.StringType())])
    rows = spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in folders])
    return rows.select(*schema.fieldNames())


def read_table(spark: SparkSession, path: str, schema: T.StructType = INTERVENTIONS, version: int | None = None) -> DataFrame:
    """The table as of its last version, or an earlier one that is still kept."""
    found, folders = folders_of(path, version)
    if not found:
        raise FileNotFoundError(f"no table at {path}")
    return _read_folders(spark, path, folders, schema)


def read_load(spark: SparkSession, path: str, load: str | None, schema: T.StructType = INTERVENTIONS,
              year: str = YEAR) -> DataFrame:
    """The rows that one load wrote."""
    return _read_folders(spark, path, _folders_of_load(path, load, year) if load else [], schema)


class Staged:
    """Rows written once to the shared folder and read back from there, then removed.

    A batch is used several times below; without this an expensive plan behind it (parsing
    archives) would run each time.
    """

    def __init__(self, df: DataFrame, label: str = "staged"):
        self.path = scratch_path(df.sparkSession, label)
        self.df = df

    def __enter__(self) -> DataFrame:
        try:
            self.df.write.parquet(self.path)
        except BaseException:
            storage.remove(self.path)
            raise
        return self.df.sparkSession.read.schema(self.df.schema).parquet(self.path)

    def __exit__(self, *problem: object) -> None:
        storage.remove(self.path)


def insert_if_absent(
    batch: DataFrame, path: str, key: str, order: list[str],
    schema: T.StructType = INTERVENTIONS, year: str = YEAR, last: Step = as_it_is,
) -> str:
    """Add the rows whose key is absent, as one load, and return its id. The batch is read once;
    existing files are not touched, but those of a year in over ``MOST_FOLDERS`` folders, which
    are written anew beside the added rows. ``last`` is applied to the rows as they are written
    (to watch them, say)."""
    spark = batch.sparkSession
    base, folders = folders_of(path)
    rows = batch.select(*schema.fieldNames())
    by_year: dict[str, int] = {}
    for folder in folders:
        by_year[_year_of(folder)] = by_year.get(_year_of(folder), 0) + 1
    crowded = [f for f in folders if by_year[_year_of(f)] > MOST_FOLDERS]
    target = _read_folders(spark, path, folders, schema)
    added = absent_rows(target.select(key), rows, key, order)
    if crowded:
        added = added.unionByName(_read_folders(spark, path, crowded, schema))
    return _load_and_commit(added, path, year, base, [f for f in folders if f not in crowded], last)


def upsert_by_key(
    batch: DataFrame, path: str, key: str, order: list[str],
    schema: T.StructType = INTERVENTIONS, year: str = YEAR, stage: bool = True, last: Step = as_it_is,
) -> str | None:
    """Replace rows by key, as one load. Only the years with new or replaced rows are rewritten.

    A batch that is read straight from files needs no ``stage``.
    """
    rows = batch.select(*schema.fieldNames())
    if stage:
        with Staged(rows) as written:
            return upsert_by_key(written, path, key, order, schema, year, False, last)
    spark = batch.sparkSession
    base, folders = folders_of(path)
    target = _read_folders(spark, path, folders, schema)
    replaced = target.select(key, year).where(_keyed(key)).join(
        rows.where(_keyed(key)).select(key), key, "left_semi"
    )
    # one row per calendar year
    touched = [r[0] for r in rows.select(year).union(replaced.select(year)).distinct().collect()]
    if not touched:
        if not base:
            commit(path, base, [])
        return None
    labels = _labels(touched, year)
    old = _read_folders(spark, path, [f for f in folders if _year_of(f) in labels], schema)
    merged = merge_upsert(old, rows, key, order)
    return _load_and_commit(merged, path, year, base, [f for f in folders if _year_of(f) not in labels], last)


def skip_existing(files: DataFrame, table: DataFrame, year: str = YEAR,
                  number: str = "publication_numero") -> DataFrame:
    """Input files whose (year, issue number) the table does not hold yet.

    The table is reduced to its distinct issues before the join.
    """
    issues = table.select(year, number).distinct()
    keyed = F.col(year).isNotNull() & F.col(number).isNotNull()
    known = files.where(keyed).join(issues, [year, number], "left_anti")
    return known.unionByName(files.where(~keyed))
