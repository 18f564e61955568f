"""Language identification by Bayesian evidence fusion.

The posterior of a language adds, in logarithms:

* the text: a naive Bayes likelihood over hashed byte trigrams (A-Z in lower case, digits
  and ASCII signs as blanks), tempered because trigrams overlap;
* the declared markup language: P(declared | language), from counts over the whole table;
* the address suffix: a country suffix that names a language favours it;
* the host: its prior is smoothed towards its site's (last two labels), the site's towards
  that of all rows. The counts behind these priors are sums of text posteriors, grouped by
  host and site, over the whole table.

Every kind of evidence but the text may be missing. Rows are rejected if their text has no
letter, if its mean likelihood per trigram is below everything the training sample showed
(with a margin), or if no language reaches a posterior of 0.4 (``LEAST_POSTERIOR``).

Trigram counts come from a bounded sample per language (``SAMPLE_PER_LABEL`` texts); all
other counts are over all rows.

Defined cases: null and empty texts are rejected, with the language of their priors; a
null or unknown declared language, suffix or host is no evidence; equal posteriors go to the
alphabetically first language; without training rows nothing is known: language null,
rejected. Rows are judged one by one, so repeated ids do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import cut, hinted, wanted
from hemicycle.llm.sampling import SAMPLE_CHARS, labelled_sample
from hemicycle.llm.url_filter import host_of

#: Bound of the training sample, per language.
SAMPLE_PER_LABEL = 1000
BUCKETS = 1 << 16
#: Bytes of a text that are looked up at a time.
PIECE = 1 << 20
TEMPER, STRENGTH, MARGIN, LEAST_POSTERIOR = 0.3, 20.0, 1.5, 0.4
#: Country suffixes that name a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en"}
SUFFIX_ODDS = 10.0


def byte_classes() -> np.ndarray:
    """Letters stay (A-Z in lower case), bytes of other scripts stay, the rest is a blank."""
    classes = np.full(256, 32, np.uint32)
    classes[97:123] = np.arange(97, 123)
    classes[65:91] = np.arange(97, 123)
    classes[128:] = np.arange(128, 256)
    return classes


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed trigrams of a text, piece by piece; those of three blanks are left out."""
    classes = byte_classes()
    for start in range(0, max(1, len(text) - 2), PIECE):
        c = classes[np.frombuffer(text, np.uint8, min(PIECE + 2, len(text) - start), start)]
        if len(c) < 3:
            c = np.concatenate([c, np.full(3 - len(c), 32, np.uint32)])
        code = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
        code = code[code != 0x202020]
        yield ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): log P(trigram | language)
    floor: float  # mean log-likelihood that no training text was under

    def likelihood(self, text: bytes) -> tuple[int, np.ndarray]:
        """Number of trigrams, and the log-likelihood of the text in each language."""
        n, total = 0, np.zeros(len(self.languages))
        for codes in trigrams(text):
            n += len(codes)
            total += self.table[codes].sum(axis=0, dtype=np.float64)
        return n, total


def train(sample: list[tuple[str, str]]) -> TextModel:
    languages = sorted({label for _, label in sample})
    counts = np.zeros((BUCKETS, max(1, len(languages))))
    for text, label in sample:
        for codes in trigrams(text.encode()):
            counts[:, languages.index(label)] += np.bincount(codes, minlength=BUCKETS)
    smoothed = counts + 0.02
    table = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)
    model = TextModel(languages, table, 0.0)
    means = []
    for text, _ in sample:
        n, total = model.likelihood(text.encode())
        if n >= 50:
            means.append(total.max() / n)
    model.floor = min(means, default=float(table.min())) - MARGIN
    return model


def text_evidence(text: Column, model: TextModel) -> Column:
    """struct<n, ll>: trigrams, and log-likelihood per language."""
    kind = pa.struct([("n", pa.int64()), ("ll", pa.list_(pa.float64()))])

    @F.arrow_udf("n long, ll array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts.cast(pa.binary()):
            n, total = model.likelihood(value.as_py() or b"")
            rows.append({"n": n, "ll": total.tolist()})
        return pa.array(rows, kind)

    return evidence(text)


def softmax(scores: Column) -> Column:
    """Array of scores to an array of probabilities."""
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def site_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def smoothed(n: Column, total: Column, prior: Column) -> Column:
    """Counts per language, pulled towards a prior that weighs STRENGTH rows."""
    return F.transform(
        F.arrays_zip(n.alias("n"), prior.alias("p")),
        lambda x: (x["n"] + F.lit(STRENGTH) * x["p"]) / (total + F.lit(STRENGTH)))


def grouped(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Sums of text posteriors per language, and their total, per key."""
    sums = [F.round(F.sum(F.get("soft", F.lit(i))), 6) for i in range(size)]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("n"), F.count("*").cast("double").alias("total"))


def host_priors(rows: DataFrame, size: int) -> tuple[DataFrame, Column]:
    """(host, prior) by host, and the prior of all rows. ``rows``: host, soft."""
    everything = rows.agg(*[F.round(F.sum(F.get("soft", F.lit(i))), 6) for i in range(size)]).first()
    sums = [float(x or 0.0) + 1.0 for x in everything]
    world = F.array(*[F.lit(x / sum(sums)) for x in sums])
    hosts = cut(grouped(rows.where("host IS NOT NULL AND host <> ''"), ["host"], size)
                .withColumn("site", site_of(F.col("host"))))
    sites = hosts.groupBy("site").agg(
        F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(size)]).alias("n_site"),
        F.sum("total").alias("total_site"),
    ).select("site", smoothed(F.col("n_site"), F.col("total_site"), world).alias("site_prior"))
    priors = hosts.join(hinted(sites), "site").select(
        "host", smoothed(F.col("n"), F.col("total"), F.col("site_prior")).alias("prior"))
    return priors, world


def identify(rows: DataFrame, model: TextModel, evidence: str, declared: str | None = None,
             host: str | None = None) -> DataFrame:
    """Add ``language``, ``posterior``, ``text_language`` and ``kept`` to rows.

    ``evidence`` names a column made by :func:`text_evidence`; ``declared`` and ``host``
    name columns with the declared language and the host (or any other origin).
    """
    size = len(model.languages)
    if size == 0:
        return rows.select(
            "*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
            F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("kept"))
    names = F.array(*[F.lit(x) for x in model.languages])
    said = F.lower(F.substring(F.col(declared), 1, 2)) if declared else F.lit(None).cast("string")
    origin = F.col(host) if host else F.lit(None).cast("string")
    rows = rows.select(
        "*",
        F.transform(F.col(f"{evidence}.ll"), lambda x: x * TEMPER).alias("__text"),
        F.when(said.isin(model.languages), said).alias("__said"), origin.alias("__host"))
    soft = rows.select(softmax(F.col("__text")).alias("soft"), F.col("__host").alias("host"), "__said")
    priors, world = host_priors(soft, size)
    told = {r["__said"]: (r["n"], r["total"])
            for r in grouped(soft.where("__said IS NOT NULL"), ["__said"], size).collect()}
    per_language = [sum(n[i] for n, _ in told.values()) for i in range(size)]
    markup = F.array(*[F.lit(0.0)] * size)
    for code, (n, _) in sorted(told.items()):
        # a declared language is right in most cases: that much is assumed, the rest counted
        belief = [
            np.log((n[i] + STRENGTH * (0.7 if code == model.languages[i] else 0.3 / size))
                   / (per_language[i] + STRENGTH)) for i in range(size)]
        markup = F.when(F.col("__said") == code, F.array(*[F.lit(float(x)) for x in belief])).otherwise(markup)
    suffix = F.array(*[F.lit(0.0)] * size)
    for code, language in SUFFIXES.items():
        if language in model.languages:
            odds = [float(np.log(SUFFIX_ODDS)) if x == language else 0.0 for x in model.languages]
            suffix = F.when(F.col("__host").endswith(f".{code}"), F.array(*[F.lit(x) for x in odds])).otherwise(suffix)
    joined = rows.join(hinted(priors.select(F.col("host").alias("__prior_host"), F.col("prior").alias("__host_prior"))),
                       F.col("__host") == F.col("__prior_host"), "left")
    joined = joined.select(
        "*", F.transform(F.coalesce("__host_prior", world), lambda p: F.log(p)).alias("__prior"),
        markup.alias("__markup"), suffix.alias("__suffix"))
    parts = F.arrays_zip("__text", "__prior", "__markup", "__suffix")
    fused = softmax(F.transform(parts, lambda x: x["__text"] + x["__prior"] + x["__markup"] + x["__suffix"]))
    joined = joined.withColumn("__fused", fused)
    mean = F.array_max(f"{evidence}.ll") / F.col(f"{evidence}.n")
    best = F.array_max("__fused")
    drop = ("__text", "__said", "__host", "__prior_host", "__host_prior", "__prior", "__markup", "__suffix", "__fused")
    return joined.withColumns({
        "language": F.get(names, F.array_position("__fused", best).cast("int") - 1),
        "text_language": F.get(names, F.array_position("__text", F.array_max("__text")).cast("int") - 1),
        "posterior": best,
        "kept": F.coalesce((F.col(f"{evidence}.n") > 0) & (mean >= model.floor) & (best >= LEAST_POSTERIOR), F.lit(False)),
    }).drop(*drop)


def model_from(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               label_column: str = "lang", per_label: int = SAMPLE_PER_LABEL,
               most_chars: int = SAMPLE_CHARS) -> TextModel:
    """Train on ``per_label`` texts of each label, those of at most ``most_chars`` characters."""
    rows = wanted(documents, doc_id=id_column, text=text_column, label=label_column)
    labels = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(
        F.min("label").alias("label"))
    return train(labelled_sample(rows.select("doc_id", "text"), labels, per_label, most_chars))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, host): markup language and address of the page that shows a
    document, known by the number at the end of the page's path. The first page counts."""
    url = F.col("url")
    number = F.regexp_extract(url, r"^[^?#]*/(\d{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    return (
        pages.select(
            "page_id", F.when(number != "", number.cast("long")).alias("doc_id"),
            F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z]{2})", 1), F.lit("")).alias("declared"),
            host_of(url).alias("host"))
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id").agg(F.min(F.struct("page_id", "declared", "host")).alias("first"))
        .select("doc_id", "first.declared", "first.host")
    )


def with_origin(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``declared`` and ``origin`` to rows (doc_id, source, ...): of the page that shows a
    document, else its source in place of the host."""
    shown = hinted(cut(page_evidence(pages).withColumnRenamed("doc_id", "_shown")))
    return rows.join(shown, F.col("doc_id") == F.col("_shown"), "left").select(
        *rows.columns, "declared", F.coalesce("host", "source").alias("origin"))


def identify_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document with its language, posterior, and whether it is kept.

    Documents shown on a page have that page's markup and host as evidence; the others have
    their source in place of the host.
    """
    model = model_from(documents)
    scored = documents.select("doc_id", "source", text_evidence(F.col("text"), model).alias("evidence"))
    found = identify(cut(with_origin(scored, pages)), model, "evidence", "declared", "origin")
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")


def keep_identified(documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The documents whose language is known, with ``lang`` set to it, judged as by
    :func:`identify_documents`. Without ``pages`` the source is the only origin. Texts do not
    move while the pages' evidence is small enough to be broadcast."""
    model = model_from(documents)
    rows = documents.select(
        F.struct("*").alias("row"), "doc_id", "source", text_evidence(F.col("text"), model).alias("evidence"))
    if pages is None:
        rows = rows.select("*", F.lit(None).cast("string").alias("declared"), F.col("source").alias("origin"))
    else:
        rows = with_origin(rows, pages)
    found = identify(rows, model, "evidence", "declared", "origin").where("kept")
    return found.select(*[F.col("language").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c)
                          for c in documents.columns])
