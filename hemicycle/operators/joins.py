"""Lookups and joins.

No side is ever marked for broadcast by hand: Spark broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (at plan time, or at
run time under adaptive execution) and otherwise sorts and merges, splitting hot keys.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions import text as tx

# Political family -> parties.
FAMILIES = {
    "Gauche": [
        "Gauche Démocrate et Républicaine", "Gauche démocrate et républicaine",
        "Gauche démocrate et républicaine - NUPES",
        "Socialistes et apparentés", "Socialiste", "Écologiste et Social",
        "La France insoumise",
        "La France insoumise - Nouvelle Union Populaire écologique et sociale",
        "La France insoumise - Nouveau Front Populaire",
    ],
    "Centre": [
        "La République en Marche", "Renaissance", "Ensemble pour la République",
        "Mouvement Démocrate (MoDem) et Démocrates apparentés",
        "Démocrate (MoDem et Indépendants)", "Horizons & Indépendants", "Agir ensemble",
        "Les Démocrates", "Libertés, Indépendants, Outre-mer et Territoires",
        "Libertés et Territoires",
    ],
    "Droite": [
        "Les Républicains", "UDI et Indépendants", "Droite Républicaine",
        "Union des droites pour la République",
    ],
    "Extrême droite": ["Rassemblement National", "UDR"],
    "Non inscrit": ["Non inscrit"],
}


def _left_lookup(keys: DataFrame, mine: Column, one: DataFrame, key: str, field: str) -> DataFrame:
    """Rows with ``field`` of the table row of their key. ``one`` has one row per key. Rows
    without a key keep NULL and stay beside the join, where they would meet in one task."""
    keyed = keys.where(mine.isNotNull()).withColumn(key, mine).join(one, key, "left").drop(key)
    lone = keys.where(mine.isNull()).withColumn(field, F.lit(None).cast(one.schema[field].dataType))
    return keyed.unionByName(lone)


def lookup_field(
    keys: DataFrame, table: DataFrame, key: str, field: str, table_key: str | None = None,
    clean: bool = False,
) -> DataFrame:
    """Every key with the table's ``field``, NULL when unknown. Keys of different types
    compare as strings. Of repeated table keys the least value that is not NULL counts. Only
    table rows of keys that are asked for are grouped."""
    value, other = F.col(field), F.col(table_key or key)
    mine = F.col(key)
    if keys.schema[key].dataType != table.schema[table_key or key].dataType:
        mine, other = mine.cast("string"), other.cast("string")
    asked = keys.select(mine.alias("_k")).where("_k IS NOT NULL")
    found = table.select(other.alias("_k"), (tx.clean_speaker(value) if clean else value).alias(field)).join(
        asked, "_k", "left_semi")
    one = found.groupBy("_k").agg(F.min(field).alias(field))
    return _left_lookup(keys, mine, one, "_k", field)


def lookup_dates(
    keys: DataFrame, table: DataFrame, key: str, date: str = "date_seance",
    table_key: str | None = None,
) -> DataFrame:
    return lookup_field(keys, table, key, date, table_key)


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key. The rank filter is applied before the shuffle as well, so a hot
    key ships at most one row per input partition."""
    ranked = df.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    )
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def join_party(
    df: DataFrame, deputies: DataFrame, speaker: str, name: Column, newest_first: list[Column],
    party: str = "groupe",
) -> DataFrame:
    """Speaker -> party, from the newest deputy row of that full name. Rows without a speaker
    have no party and do not enter the join."""
    named = deputies.withColumn("_name", name).where(F.col("_name").isNotNull())
    one = latest_per_key(named, ["_name"], newest_first).select("_name", party)
    return _left_lookup(df, F.col(speaker), one, "_name", party)


def map_literal(families: dict[str, list[str]]) -> Column:
    """{family: [parties]} turned into a party -> family map literal."""
    pairs = {p: f for f, parties in families.items() for p in parties}
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def map_family(
    df: DataFrame, party: str = "groupe", out: str = "groupe_politique",
    families: dict[str, list[str]] | None = None, default: str = tx.DEFAULT_FAMILY,
) -> DataFrame:
    """Party -> family by a literal map; no join at all."""
    found = F.try_element_at(map_literal(families or FAMILIES), F.col(party))
    return df.withColumn(out, F.coalesce(found, F.lit(default)))


def anti_join_existing(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(existing.select(*keys), keys, "left_anti")


def semi_join_common(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def unmatched_speakers(df: DataFrame, speaker: str, party: str) -> DataFrame:
    """Distinct speakers without a party; a missing speaker counts as one."""
    lone = df.where(F.col(party).isNull()).select(speaker).distinct()
    return lone.agg(F.count("*").alias("unmatched"))
