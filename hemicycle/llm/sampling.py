"""Bounded, deterministic samples of labelled rows for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import cut

#: Longest text that a training sample takes, by default; scoring has no such limit.
SAMPLE_CHARS = 200_000


def labelled_sample(texts: DataFrame, labels: DataFrame, per_label: int,
                    most_chars: int = SAMPLE_CHARS) -> list[tuple[str, object]]:
    """At most ``per_label`` texts of each label, those with the smallest hashes of doc_id.

    ``texts``: (doc_id, text); ``labels``: (doc_id, label), one row per doc_id. The ids are
    chosen before any text is read, so only the chosen texts travel. Chosen texts of over
    ``most_chars`` characters are left out: cut short they would still outweigh all others of
    their label, and one wrong label among them would turn the counts.
    """
    kinds = [r[0] for r in labels.select("label").distinct().collect()]
    chosen = None
    for kind in kinds:
        some = (labels.where(F.col("label") == kind)
                .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_label))
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return []
    chosen = F.broadcast(cut(chosen))
    rows = (
        texts.where(F.length("text") <= most_chars).join(chosen, "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .orderBy("doc_id").collect()
    )
    return [(r["text"], r["label"]) for r in rows]
