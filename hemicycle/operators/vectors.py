"""Embeddings: centroids, drift, similarity matrices, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.functions import text as tx
from hemicycle.functions import vectors as vx


def vector_centroid(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Element-wise mean vector and count per group.

    The mean is a partial aggregate: each task ships one vector per group it saw.
    """
    return (
        df.where(F.col(vector).isNotNull() & F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_m"),
            F.count("*").alias("n"),
        )
        .select(group, vector_to_array("_m").alias("centroid"), "n")
    )


def group_centroids(df: DataFrame, group: str, vector: str, groups: list) -> DataFrame:
    """Centroid and count of each requested group that has vectors."""
    return vector_centroid(df.where(F.col(group).isin(*groups)), group, vector)


def to_long(centroids: DataFrame, group: str, vector: str = "centroid") -> DataFrame:
    """(group, dim, value) rows."""
    return centroids.select(group, F.posexplode(vector).alias("dim", "value"))


def drift_year_to_year(centroids: DataFrame, year: str = "annee") -> DataFrame:
    """Cosine and drift between consecutive present years.

    The window has no partition key because its input has one row per calendar year.
    """
    along = Window.orderBy(year)
    return (
        centroids.withColumn("_prev", F.lag("centroid").over(along))
        .withColumn("from_year", F.lag(year).over(along))
        .where(F.col("from_year").isNotNull())
        .withColumn("similarity", vx.cosine(F.col("_prev"), F.col("centroid")))
        .select("from_year", F.col(year).alias("to_year"), "similarity",
                (F.lit(1.0) - F.col("similarity")).alias("drift"))
    )


def drift_cumulative(centroids: DataFrame, year: str = "annee") -> DataFrame:
    """Cosine and drift to the first year, that year included; nothing for a single year."""
    along = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        centroids.withColumn("_first", F.first("centroid").over(along))
        .withColumn("_years", F.count("*").over(along))
        .where(F.col("_years") > 1)
        .withColumn("similarity", vx.cosine(F.col("_first"), F.col("centroid")))
        .select(year, "similarity", (F.lit(1.0) - F.col("similarity")).alias("drift"))
    )


def pairwise_similarity(centroids: DataFrame, group: str, vector: str = "centroid", block: int = 512) -> DataFrame:
    """Full similarity matrix (a, b, similarity), as products of blocks.

    Unit vectors are dealt into blocks of about ``block`` groups. Every two blocks meet once, in
    one task, as two small matrices; the product gives the pairs of both orders. A vector
    travels once for every block, and a task holds two blocks and their product. Vectors of a
    matrix have one length.
    """
    unit = centroids.where(F.col(vector).isNotNull()).select(
        F.col(group).alias("g"), vx.l2_normalise(F.col(vector)).alias("u"))
    blocks = max(1, -(-unit.count() // block))
    dealt = unit.withColumn("mine", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).select(F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "g", "u")
    kind = centroids.schema[group].dataType.simpleString()

    def multiply(met: pa.Table) -> pa.Table:
        one, two, mine = (met.column(c).to_numpy() for c in ("one", "two", "mine"))
        matrix = np.array(met.column("u").to_pylist())
        left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
        values = (matrix[left] @ matrix[right].T).ravel()
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        if one[0] != two[0]:  # the other order
            a, b, values = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(values, 2)
        ids = met.column("g").combine_chunks()
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "similarity": pa.array(values)})

    return dealt.groupBy("one", "two").applyInArrow(multiply, f"a {kind}, b {kind}, similarity double")


def similarity_to(df: DataFrame, vector: str, query: "list[float] | DataFrame") -> DataFrame:
    """Add ``score``: cosine to one query vector (a list, or a one-row one-column frame)."""
    if isinstance(query, DataFrame):
        return (
            df.withColumn("_q", query.scalar())
            .withColumn("score", vx.cosine(F.col(vector), F.col("_q")))
            .drop("_q")
        )
    return df.withColumn("score", vx.cosine_to(F.col(vector), [float(x) for x in query]))


def knn_search(
    df: DataFrame, key: str, vector: str, query: "list[float] | DataFrame", k: int = 10,
    where: Column | None = None,
) -> DataFrame:
    """Exactly k nearest by cosine; the vector itself is left out of the result."""
    rows = (df if where is None else df.where(where)).where(F.col(vector).isNotNull())
    scored = similarity_to(rows, vector, query).drop(vector)
    return scored.orderBy(F.desc("score"), key).limit(k)


def knn_search_arrow(
    df: DataFrame, key: str, vector: str, query: list[float], k: int = 10
) -> DataFrame:
    """Exact kNN for wide vectors: one matrix product per Arrow batch, top k per batch,
    then top k over all. Needs vectors of the query's length."""
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    rows = df.where(F.size(vector) == len(query)).select(key, vector)
    schema = T.StructType([df.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            m = flat.astype(np.float64).reshape(batch.num_rows, len(q))
            norms = np.linalg.norm(m, axis=1)
            score = np.divide(m @ q, norms, out=np.zeros(len(m)), where=norms > 0)
            if len(score) > k:
                # keep every row that ties with the k-th score: ties are settled globally
                cut = np.partition(score, len(score) - k)[len(score) - k]
                keep = np.flatnonzero(score >= cut)
            else:
                keep = np.arange(len(score))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep)), pa.array(score[keep])], names=[key, "score"]
            )

    return rows.mapInArrow(run, schema).orderBy(F.desc("score"), key).limit(k)


def knn_search_lsh(
    df: DataFrame, key: str, vector: str, query: list[float], k: int = 10,
    num_candidates: int = 100, tables: int = 4, bucket_length: float = 1.0, seed: int = 42,
) -> DataFrame:
    """Approximate kNN: candidates from random projections of unit vectors, then re-ranked
    by exact cosine."""
    unit = df.where(F.col(vector).isNotNull()).select(
        "*", array_to_vector(vx.l2_normalise(F.col(vector))).alias("_u")
    )
    lsh = BucketedRandomProjectionLSH(
        inputCol="_u", outputCol="_h", numHashTables=tables, bucketLength=bucket_length, seed=seed
    )
    length = sum(x * x for x in query) ** 0.5 or 1.0
    model = lsh.fit(unit.limit(1))  # the projections depend on the vector length and seed only
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / length for x in query]), num_candidates)
    return (
        similarity_to(near, vector, query)
        .drop(vector, "_u", "_h", "distCol")
        .orderBy(F.desc("score"), key).limit(k)
    )


def topk_per_year(
    df: DataFrame, year: str, key: str, vector: str, query: "list[float] | DataFrame", k: int = 3
) -> DataFrame:
    """k nearest per year in one pass; each task keeps k rows per year before the shuffle."""
    rows = df.where(F.col(vector).isNotNull() & F.col(year).isNotNull())
    scored = similarity_to(rows, vector, query).drop(vector)
    rank = F.row_number().over(Window.partitionBy(year).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


# vectors from text

DIMENSIONS = 256


def embed_texts(
    df: DataFrame, text: str, out: str = "texte_embedding", dimensions: int = DIMENSIONS
) -> DataFrame:
    """Unit vectors by feature hashing of the tokens; runs inside the JVM."""
    tokens = df.withColumn("_tokens", tx.tokenize(F.col(text)))
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions).transform(tokens)
    # bound to a column of its own: the vector is used twice by the normalisation
    dense = hashed.select(*df.columns, F.explode(F.array(vector_to_array("_tf"))).alias("_v"))
    unit = vx.l2_normalise(F.col("_v")).cast("array<float>")
    return dense.withColumn(out, unit).drop("_v")


Embedder = Callable[[list[str]], "np.ndarray"]


def embed_with_model(
    df: DataFrame, text: str, load: Callable[[], Embedder], out: str = "texte_embedding",
    batch_size: int = 32, normalise: bool = True,
) -> DataFrame:
    """Vectors from a model; ``load`` runs once per task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [
                np.asarray(model(texts[at : at + batch_size]), dtype=np.float32)
                for at in range(0, len(texts), batch_size)
            ]
            m = np.concatenate(parts) if parts else np.zeros((0, 1), dtype=np.float32)
            if normalise and len(m):
                norms = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norms, out=m.copy(), where=norms > 0)
            yield pd.Series(list(m), index=batch.index)

    return df.withColumn(out, embed(F.col(text)))


def semantic_search(
    df: DataFrame, key: str, vector: str, text: str, k: int = 10, where: Column | None = None,
    embed: Callable[[DataFrame, str, str], DataFrame] = embed_texts,
) -> DataFrame:
    """The k rows nearest to a query text, which is embedded by the model that made ``vector``.

    The query's vector stays in the plan as a scalar; a text without a word finds nothing.
    """
    asked = embed(df.sparkSession.createDataFrame([(text,)], "q string"), "q", "asked").where(vx.norm(F.col("asked")) > 0)
    query = asked.select(F.col("asked").cast("array<double>"))
    return knn_search(df.where(query.scalar().isNotNull()), key, vector, query, k, where)


def add_vector_column(df: DataFrame, out: str = "texte_embedding") -> DataFrame:
    return df if out in df.columns else df.withColumn(out, F.lit(None).cast("array<float>"))


def enrich_embeddings(
    df: DataFrame, text: str, embed: Callable[[DataFrame, str, str], DataFrame] = embed_texts,
    out: str = "texte_embedding", where: Column | None = None,
) -> DataFrame:
    """Compute vectors only where there is none, the text is not blank and ``where`` holds."""
    table = add_vector_column(df, out)
    todo = F.col(out).isNull() & ~tx.is_blank(F.col(text))
    if where is not None:
        todo = todo & F.coalesce(where, F.lit(False))
    fresh = embed(table.where(todo).drop(out), text, out)
    return table.where(~todo).unionByName(fresh)


def enrichment_counts(before: DataFrame, after: DataFrame, out: str = "texte_embedding") -> DataFrame:
    """Rows, vectors before, vectors added, rows still without."""
    had = add_vector_column(before, out).agg(F.count(out)).scalar()
    return after.agg(F.count("*").alias("rows"), F.count(out).alias("with_vector")).withColumn(
        "_had", had
    ).select(
        "rows", "with_vector",
        (F.col("with_vector") - F.col("_had")).alias("added"),
        (F.col("rows") - F.col("with_vector")).alias("without_vector"),
    )
