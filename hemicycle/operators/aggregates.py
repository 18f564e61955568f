"""Counts, statistics and reports. Everything aggregates before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions import scores as sc
from hemicycle.functions import text as tx

N = "n"


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias(N))


def value_counts(df: DataFrame, column: str, by_key: bool = False) -> DataFrame:
    """Frequency of each value, NULL left out, biggest first (or ordered by value)."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(N))
    return counted.orderBy(column) if by_key else counted.orderBy(F.desc(N), column)


def count_by_year(df: DataFrame, year: str = "annee") -> DataFrame:
    return df.groupBy(year).agg(F.count("*").alias(N))


def count_by_month(df: DataFrame, date: str) -> DataFrame:
    """Documents per calendar month, all years together."""
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.month(date).alias("mois")).agg(F.count("*").alias(N))
    )


def stats_by_year(
    df: DataFrame, key: Column, year: str = "annee", approximate: bool = False
) -> DataFrame:
    """Documents and distinct keys per year, biggest year first."""
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return (
        df.groupBy(year)
        .agg(F.count("*").alias("documents"), distinct.alias("distinct_keys"))
        .orderBy(F.desc("documents"), year)
    )


def counted_words(df: DataFrame, text: str, whitespace: bool = False) -> DataFrame:
    """The rows with ``words`` in place of the text; single-space rule unless ``whitespace``."""
    words = tx.word_count_ws(F.col(text)) if whitespace else tx.word_count_space(F.col(text))
    return df.withColumn("words", words).drop(text)


def word_count_by_date(
    df: DataFrame, text: str, date: str, day: str | None = None, whitespace: bool = False
) -> DataFrame:
    """Words per sitting date (or of one date). Where the date comes from a join, count with
    :func:`counted_words` before it, so that no text travels."""
    rows = df if day is None else df.where(F.col(date) == F.lit(day).cast("date"))
    counted = rows if "words" in rows.columns else counted_words(rows, text, whitespace)
    return counted.groupBy(date).agg(F.sum("words").alias("words"))


def corpus_word_stats(df: DataFrame, text: str) -> DataFrame:
    """Words, documents, documents without text, mean words per document with text."""
    words = tx.word_count_ws(F.col(text))
    # an absent or empty text is "without"; a text of blanks has text and zero words
    without = F.col(text).isNull() | (F.col(text) == "")
    return df.agg(
        F.coalesce(F.sum(words), F.lit(0)).alias("total_words"),
        F.count("*").alias("total_docs"),
        F.count_if(without).alias("docs_without_text"),
    ).withColumn(
        "mean_words",
        F.try_divide(F.col("total_words"), F.col("total_docs") - F.col("docs_without_text")),
    )


def date_span(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def length_counts(df: DataFrame, text: str) -> DataFrame:
    """(length, n): the small table all length statistics are computed from."""
    return (
        df.where(F.col(text).isNotNull())
        .groupBy(tx.text_length(F.col(text)).alias("length")).agg(F.count("*").alias(N))
    )


def describe_length(df: DataFrame, text: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of the text length (linear interpolation)."""
    length, n = F.col("length"), F.col(N)
    total = F.sum(n)
    mean = F.sum(length * n) / total
    # exact integer sums, so the result does not depend on the order of addition
    squares = F.sum((length * length * n).cast("decimal(38,0)"))
    plain = F.sum((length * n).cast("decimal(38,0)"))
    spread = (squares.cast("double") - plain.cast("double") * mean)
    quart = F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    return length_counts(df, text).agg(
        total.alias("count"),
        mean.alias("mean"),
        F.when(total > 1, F.sqrt(spread / (total - 1))).alias("std"),
        F.min(length).alias("min"),
        quart.alias("_q"),
        F.max(length).alias("max"),
    ).select(
        "count", "mean", "std", "min",
        F.get("_q", F.lit(0)).alias("p25"),
        F.get("_q", F.lit(1)).alias("p50"),
        F.get("_q", F.lit(2)).alias("p75"),
        "max",
    )


def median_length(df: DataFrame, text: str) -> DataFrame:
    return length_counts(df, text).agg(F.percentile("length", F.lit(0.5), F.col(N)).alias("median_length"))


def avg_length(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.avg(tx.text_length(F.col(text))).alias("avg_length"))


def histogram_length(df: DataFrame, text: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over min..max, the last one closed; empty bins are kept."""
    # the window has one row per distinct length, so the texts are scanned once
    everything = Window.partitionBy()
    counts = length_counts(df, text).withColumns({
        "_lo": F.min("length").over(everything).cast("double"), "_hi": F.max("length").over(everything).cast("double")})
    # one distinct value only: a bin of width 1/bins around it, as plotting tools do
    bounds = counts.select(
        "length", N,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    bucket = F.least(F.floor((F.col("length") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    filled = bounds.groupBy(bucket.alias("bin")).agg(F.sum(N).alias(N))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(filled, "bin", "left").select("bin", F.coalesce(N, F.lit(0)).alias(N))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, NULL included."""
    return df.select(column).distinct()


def distinct_speakers(df: DataFrame, speaker: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(speaker) if approximate else F.count_distinct(F.col(speaker))
    return df.agg(count.alias("speakers"))


def word_frequencies(
    df: DataFrame, text: str, stop_words: tuple[str, ...], top: int | None = 100
) -> DataFrame:
    """Word counts without stop words, most frequent first."""
    words = df.select(F.explode(tx.tokenize(F.col(text))).alias("word"))
    counted = (
        words.where(~F.col("word").isin(*stop_words))
        .groupBy("word").agg(F.count("*").alias(N))
        .orderBy(F.desc(N), "word")
    )
    return counted if top is None else counted.limit(top)


def manifest_by_year(files: DataFrame, path: str, year: Column, show: int = 3) -> DataFrame:
    """Files per year with the count and the first names; only ``show`` names are collected."""
    rows = files.select(year.alias("annee"), F.col(path).alias("_p"))
    counts = rows.groupBy("annee").agg(F.count("*").alias("files"))
    ranked = rows.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("annee").orderBy("_p"))
    ).where(F.col("_rn") <= show)
    names = ranked.groupBy("annee").agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("_p"))).alias("first_files")
    )
    return counts.join(names, "annee")


def expected_manifest(
    per_year: DataFrame, present: DataFrame, year: str = "annee", n: str = "n", name: str = "name"
) -> DataFrame:
    """Expected archive names of each year, 1..n, minus those already present."""
    # numbers are unrolled a thousand at a time, so no row holds a long array
    thousands = per_year.where(F.col(n) >= 1).select(
        year, F.col(n).alias("_n"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / 1000).cast("int"))).alias("_t"),
    )
    first = F.col("_t") * 1000 + 1
    last = F.least(F.col("_t") * 1000 + 1000, F.col("_n").cast("int"))
    expected = thousands.select(year, F.explode(F.sequence(first, last)).alias("numero")).select(
        year, "numero",
        F.format_string("AN_%d%03d.taz", F.col(year).cast("int"), F.col("numero")).alias(name),
    )
    return expected.join(present.select(name), name, "left_anti").select(year, "numero", name)


def run_statistics(files: DataFrame) -> DataFrame:
    """Totals per status, shares in percent, mean seconds per successful file."""
    status = F.col("status")
    return files.agg(
        F.count("*").alias("total"),
        F.count_if(status == "success").alias("success"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.coalesce(
            F.sum(F.when(status == "success", F.col("documents_count"))), F.lit(0)
        ).alias("documents_indexed"),
        F.sum("duration_seconds").alias("duration_seconds"),
    ).select(
        "*",
        sc.percent_ratio(F.col("success"), F.col("total")).alias("success_pct"),
        sc.percent_ratio(F.col("failed"), F.col("total")).alias("failed_pct"),
        sc.percent_ratio(F.col("skipped"), F.col("total")).alias("skipped_pct"),
        F.try_divide(F.col("duration_seconds"), F.col("success")).alias("seconds_per_success"),
    )


def import_report(files: DataFrame) -> DataFrame:
    """Counts per status and documents per year of the successful files.

    The per-file records stay rows of ``files``; a list of them in one cell would grow
    without bound.
    """
    done, n, d = F.col("status") == "success", F.col("n"), F.col("d")
    # files are read once: a row per status and year is left
    groups = files.groupBy("status", "year").agg(F.count("*").alias("n"), F.sum("documents_count").alias("d"))
    years = F.collect_list(F.when(done & F.col("year").isNotNull(), F.struct(F.col("year").cast("string"), "d")))

    def total(value: Column, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0))

    return groups.agg(
        total(n).alias("total_files"),
        total(n, done).alias("success_files"),
        total(n, F.col("status") == "failed").alias("failed_files"),
        total(n, ~F.col("status").isin("success", "failed")).alias("skipped_files"),
        total(d, done).alias("total_documents"),
        F.map_from_entries(F.sort_array(years)).alias("documents_by_year"),
    )


def table_status(df: DataFrame, year: str = "annee") -> DataFrame:
    """One row: time, documents, documents per year (a map of calendar years)."""
    per_year = df.groupBy(year).agg(F.count("*").alias("c"))
    return per_year.agg(
        F.current_timestamp().alias("checked_at"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("documents"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(
                F.col(year).isNotNull(), F.struct(F.col(year).alias("y"), F.col("c"))
            )))
        ).alias("documents_by_year"),
    )


def count_by_doc_type(df: DataFrame, doc_type: str) -> DataFrame:
    """Documents by type with their share of all documents in percent."""
    counted = df.groupBy(doc_type).agg(F.count("*").alias(N))
    # one row per type: the total is a sum over the small grouped table
    total = counted.agg(F.sum(N)).scalar()
    return counted.withColumn("_t", total).select(
        doc_type, N, sc.percent_ratio(F.col(N), F.col("_t")).alias("ratio_pct")
    )


def column_info(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count, and the table's rows and columns."""
    names = df.columns
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(names)]
    )
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.col(f"_{i}").alias("non_null"),
            F.col("_rows").alias("n_rows"),
            F.lit(len(names)).alias("n_columns"),
        )
        for i, c in enumerate(names)
    ])
    return counted.select(F.inline(entries))


# sentiment series


def sentiment_daily(df: DataFrame, date: str, score: Column) -> DataFrame:
    """Mean, sample deviation and count per day; rows without a date are dropped."""
    return df.where(F.col(date).isNotNull()).groupBy(date).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("count")
    )


def sentiment_daily_group(df: DataFrame, date: str, family: str, score: Column) -> DataFrame:
    return (
        df.where(F.col(date).isNotNull() & F.col(family).isNotNull())
        .groupBy(date, family).agg(F.avg(score).alias("mean"), F.count(score).alias("count"))
    )


def sentiment_daily_group_min(df: DataFrame, date: str, family: str, score: Column) -> DataFrame:
    return (
        df.where(F.col(date).isNotNull() & F.col(family).isNotNull())
        .groupBy(date, family).agg(F.min(score).alias("min"), F.count(score).alias("count"))
    )


def sentiment_monthly(df: DataFrame, date: str, columns: tuple[str, ...]) -> DataFrame:
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.date_trunc("month", F.col(date)).cast("date").alias("periode"))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def sentiment_global_mean(df: DataFrame, score: Column) -> DataFrame:
    return df.agg(F.avg(score).alias("mean"))
