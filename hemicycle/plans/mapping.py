"""How the given tables stand in for the library's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.functions import french
from hemicycle.plans.registry import Tables
from hemicycle.schemas import CLASSES
from hemicycle.sources import storage

# Words of the test corpus used as search words.
MAIN_WORD, NEAR_WORD = "der", "und"
THEMES = ("la", "that", "von", "que")

# Natural-language tokens and blank-collapsed text, in the SQL of the check tool.
def sql_tokens(column: str = "text") -> str:
    return (
        r"list_filter(regexp_split_to_array(regexp_replace(lower(" + column + r"), "
        r"'[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '')"
    )


def sql_clean(column: str) -> str:
    return rf"trim(regexp_replace(coalesce({column}, ''), '\s+', ' ', 'g'))"


def sql_words(column: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({column}, '\s+'), lambda x: x <> ''))"


def sql_french_tokens(column: str = "text") -> str:
    """Lower-case words in order after elision, stop words included."""
    elided = "|".join(french.ELIDED)
    return (
        rf"list_filter(list_transform(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}''’]+'), "
        rf"lambda w: regexp_replace(regexp_replace(w, '^(?:{elided})[''’](.)', '\1'), '[''’]', '', 'g')), lambda w: w <> '')"
    )


def sql_stems(vocabulary: str) -> str:
    """CTEs from a table (word) to ``stems`` (word, stem): the stemmer's steps, one by one."""
    out, last = [], f"(SELECT DISTINCT word, word AS w, FALSE AS done FROM {vocabulary})"
    for n, (final, rules) in enumerate(french.STEPS):
        def fits(ending: str, length: int) -> str:
            return f"length(w) > {length} AND suffix(w, '{ending}')"

        cases = " ".join(
            f"WHEN {fits(e, k)} THEN left(w, length(w) - {len(e)}) || '{r}'" for e, k, r in rules)
        ends = " OR ".join(f"({fits(e, k)})" for e, k, _ in rules) if final else "FALSE"
        out.append(f"step{n} AS (SELECT word, CASE WHEN done THEN w {cases} ELSE w END AS w, done OR {ends} AS done FROM {last})")
        last = f"step{n}"
    single = (
        r"array_to_string(list_filter(string_split(w, ''), lambda c, i: i = 1 OR c <> string_split(w, '')[i - 1] "
        r"OR NOT regexp_matches(c, '\p{L}')), '')")
    out.append(f"folded AS (SELECT word, CASE WHEN length(w) > {french.SHORT} THEN translate(w, '{french.ACCENTS[0]}', "
               f"'{french.ACCENTS[1]}') ELSE w END AS w, length(w) > {french.SHORT} AS long FROM {last})")
    out.append(f"single AS (SELECT word, CASE WHEN long THEN {single} ELSE w END AS w FROM folded)")
    out.append(f"shorn AS (SELECT word, CASE WHEN length(w) > {french.SHORT} AND suffix(w, 'ie') THEN left(w, length(w) - 2) "
               "ELSE w END AS w FROM single)")
    out.append(f"trimmed AS (SELECT word, length(w) > {french.SHORT} AS long, CASE WHEN length(w) > {french.SHORT} "
               "THEN regexp_replace(w, 'e{0,2}r?$', '') ELSE w END AS w FROM shorn)")
    out.append("stems AS (SELECT word, CASE WHEN long AND length(w) > 1 AND w[-1] = w[-2] "
               r"AND regexp_matches(w[-1], '\p{L}') THEN left(w, length(w) - 1) ELSE w END AS stem FROM trimmed)")
    return ",\n    ".join(out)


# documents as interventions


def interventions(t: Tables) -> DataFrame:
    """documents with the date of the order of the same number."""
    return dated(t, t.texts.select(
        F.col("doc_id").alias("para_id"), F.col("text").alias("texte"),
        F.col("source").alias("orateur_nom"), F.col("lang").alias("section_id"),
    ))


def dated(t: Tables, docs: DataFrame) -> DataFrame:
    """Rows keyed by ``para_id`` with their date. What can be derived from a text alone is
    derived before this join, so that the text does not travel through it."""
    dates = t.orders.select(
        F.col("o_orderkey").alias("para_id"),
        F.col("o_orderdate").cast("date").alias("date_seance"),
        F.year("o_orderdate").alias("annee"),
        F.month("o_orderdate").alias("mois"),
    )
    return docs.join(dates, "para_id")


SQL_INTERVENTIONS = """
    interventions AS (
        SELECT d.doc_id AS para_id, d.text AS texte, d.source AS orateur_nom,
               d.lang AS section_id, CAST(o.o_orderdate AS DATE) AS date_seance,
               CAST(year(o.o_orderdate) AS INTEGER) AS annee,
               CAST(month(o.o_orderdate) AS INTEGER) AS mois
        FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey)"""


# events as scored paragraphs: the class of the event type gets value / (value + 50), the
# other four share the rest

EVENT_CLASS = {
    "error": "very_negative", "view": "neutral", "click": "positive",
    "signup": "negative", "purchase": "very_positive",
}
FAMILY_OF_BUCKET = ("Gauche", "Centre", "Droite", "Extrême droite", "Non inscrit")


def sentiments(t: Tables) -> DataFrame:
    own = F.col("value") / (F.col("value") + F.lit(50.0))
    kind = {c: e for e, c in EVENT_CLASS.items()}
    return t.events.select(
        F.col("event_id").alias("para_id"),
        F.col("user_id"),
        F.col("ts").cast("date").alias("date_seance"),
        F.element_at(
            F.array(*[F.lit(f) for f in FAMILY_OF_BUCKET]), (F.col("user_id") % 5 + 1).cast("int")
        ).alias("groupe_politique"),
        *[
            F.when(F.col("event_type") == kind[c], own).otherwise((F.lit(1.0) - own) / F.lit(4.0)).alias(c)
            for c in CLASSES
        ],
    )


def _sql_class(c: str) -> str:
    kind = {cls: e for e, cls in EVENT_CLASS.items()}[c]
    return (
        f"CASE WHEN event_type = '{kind}' THEN value / (value + 50.0) "
        f"ELSE (1.0::DOUBLE - value / (value + 50.0)) / 4.0 END AS {c}"
    )


SQL_SENTIMENTS = f"""
    sentiments AS (
        SELECT event_id AS para_id, user_id, CAST(ts AS DATE) AS date_seance,
               ['Gauche', 'Centre', 'Droite', 'Extrême droite', 'Non inscrit'][user_id % 5 + 1]
                   AS groupe_politique,
               {", ".join(_sql_class(c) for c in CLASSES)}
        FROM events)"""
SQL_SCORE = "(-2.0 * very_negative - 1.0 * negative + 1.0 * positive + 2.0 * very_positive)"


# events as per-file records of an ingest run


def file_stats(t: Tables) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "skipped").otherwise("success")
    )
    return t.events.select(
        F.format_string("f%d.taz", "event_id").alias("filename"),
        status.alias("status"),
        F.col("user_id").alias("documents_count"),
        F.col("value").alias("duration_seconds"),
        F.when(status == "failed", F.concat(F.lit("e"), F.col("event_id"))).alias("error_message"),
        (F.lit(2014) + F.col("user_id") % 10).cast("int").alias("year"),
    )


SQL_FILE_STATS = """
    file_stats AS (
        SELECT 'f' || event_id || '.taz' AS filename,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped'
                    ELSE 'success' END AS status,
               user_id AS documents_count, value AS duration_seconds,
               CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error_message,
               CAST(2014 + user_id % 10 AS INTEGER) AS year
        FROM events)"""


# pages as archive paths: a third in year folders, a third named by year only, a third as is


def archive_paths(t: Tables) -> DataFrame:
    p = F.col("page_id")
    year = F.lit(2014) + p % 12
    return t.pages.select(
        "page_id",
        F.when(p % 3 == 0, F.format_string("data/raw/%d/AN_%d%03d.taz", year, year, p))
        .when(p % 3 == 1, F.format_string("data/raw/AN_%d%03d.taz", year, p))
        .otherwise(F.col("url")).alias("path"),
    )


SQL_ARCHIVE_PATHS = """
    archive_paths AS (
        SELECT page_id, CASE page_id % 3
            WHEN 0 THEN 'data/raw/' || (2014 + page_id % 12) || '/AN_' || (2014 + page_id % 12)
                        || CASE WHEN page_id < 1000 THEN lpad(page_id::VARCHAR, 3, '0')
                                ELSE page_id::VARCHAR END || '.taz'
            WHEN 1 THEN 'data/raw/AN_' || (2014 + page_id % 12)
                        || CASE WHEN page_id < 1000 THEN lpad(page_id::VARCHAR, 3, '0')
                                ELSE page_id::VARCHAR END || '.taz'
            ELSE url END AS path
        FROM pages)"""


def sql_stem(path: str) -> str:
    return rf"regexp_replace(regexp_extract({path}, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"


def sql_file_year(path: str) -> str:
    return (
        rf"coalesce(nullif(regexp_extract({path}, '(?:^|/)(\d{{4}})(?:/|$)', 1), ''), "
        rf"nullif(regexp_extract({sql_stem(path)}, '^.{{3}}(\d{{4}}).{{2}}', 1), ''), 'unknown')"
    )


# embeddings with the year of the order of the same number


def dated_embeddings(t: Tables) -> DataFrame:
    years = t.orders.select(F.col("o_orderkey").alias("vec_id"), F.year("o_orderdate").alias("annee"))
    return t.embeddings.join(years, "vec_id")


SQL_EMBEDDINGS = """
    vecs AS (
        SELECT e.vec_id, e.label, CAST(year(o.o_orderdate) AS INTEGER) AS annee,
               CAST(e.embedding AS DOUBLE[]) AS v
        FROM embeddings e JOIN orders o ON e.vec_id = o.o_orderkey)"""


def sql_centroids(group: str) -> str:
    return f"""
    dims AS (SELECT {group}, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, unnest(v) AS x FROM vecs),
    means AS (SELECT {group}, dim, avg(x) AS value FROM dims GROUP BY ALL),
    centroids AS (SELECT {group}, list(value ORDER BY dim) AS c FROM means GROUP BY {group})"""


# documents as archives: 32 documents per file, one section per language, one paragraph per
# line of text. Every file is bounded by construction, whatever the data looks like.

DOCS_PER_ARCHIVE = 32
#: Files that are packed between two batches of output.
FILES_AT_ONCE = 16


def _escape(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _taz(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io
    import tarfile

    def pack(name: str, data: bytes, mode: str) -> bytes:
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode=mode) as tar:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        return buffer.getvalue()

    for batch in batches:
        # a few files at a time, so that few of them are held packed
        for at in range(0, len(batch), FILES_AT_ONCE):
            some = batch.iloc[at: at + FILES_AT_ONCE]
            content = [
                pack("inner.tar", pack("CRI_1.xml", xml.encode(), "w"), "w:gz") for xml in some["xml"]
            ]
            yield pd.DataFrame({
                "path": some["path"], "modificationTime": pd.Timestamp(0, tz="UTC"),
                "length": [len(c) for c in content], "content": content,
            })


def archive_files(t: Tables) -> DataFrame:
    """Archive files made from documents, in the shape of a binary file scan."""
    block = F.floor(F.col("doc_id") / F.lit(DOCS_PER_ARCHIVE))
    lines = F.transform(
        F.split(_escape(F.col("text")), "\n"),
        lambda line, i: F.concat(
            F.lit('<Para idsyceron="'), F.col("doc_id").cast("string"), F.lit('">'),
            F.when(
                i == 0,
                F.concat(F.lit("<Orateur><Nom>M. "), F.col("source"), F.lit(".</Nom></Orateur> ")),
            ).otherwise(F.lit("")),
            line, F.lit("</Para>\n"),
        ),
    )
    docs = t.texts.select(
        block.alias("block"), "lang", "doc_id",
        F.when(F.col("lang").isin("en", "de"), F.col("source")).otherwise(F.lit("")).alias("sub"),
        F.array_join(lines, "").alias("xml"),
    )

    def joined(order: str) -> Column:
        parts = F.sort_array(F.collect_list(F.struct(order, "xml")))
        return F.array_join(parts.getField("xml"), "")

    def titled(tag: str, ident: Column, title: Column, extra: Column) -> Column:
        return F.concat(
            F.lit(f'<{tag}><TitreStruct Ident="'), ident, F.lit('"><Intitule>'), title,
            F.lit("</Intitule></TitreStruct>"), extra, F.col("xml"), F.lit(f"</{tag}>"),
        )

    empty = F.lit("")
    title = F.concat(F.lit("Source  "), "sub")
    subs = docs.groupBy("block", "lang", "sub").agg(
        joined("doc_id").alias("xml"), F.count("*").alias("n")
    ).withColumn(
        "xml",
        F.when(F.col("sub") == "", F.col("xml"))
        .when(F.col("lang") == "en", titled("SousSection1", F.col("sub"), title, empty))
        .otherwise(titled("SousSection2", F.col("sub"), title, empty)),
    )
    vote = F.when(F.col("lang") == "fr", F.concat(
        F.lit("<ResultatVote><NombreVotants><Valeur>"), F.col("n").cast("string"),
        F.lit("</Valeur></NombreVotants><Pour><Valeur>1</Valeur></Pour></ResultatVote>"),
    )).otherwise(F.lit("<Para idsyceron=\"x\">hors sous-section</Para>"))
    vote = F.when(F.col("lang").isin("fr", "en"), vote).otherwise(empty)
    sections = subs.groupBy("block", "lang").agg(
        joined("sub").alias("xml"), F.sum("n").alias("n")
    ).withColumn(
        "xml", titled("Section", F.concat(F.lit("sec-"), "lang"), F.concat(F.lit("Langue "), "lang"), vote)
    ).withColumn("toc", F.concat(
        F.lit("<Sommaire1><TitreStruct><Intitule>Langue "), F.col("lang"),
        F.lit("</Intitule></TitreStruct></Sommaire1>"),
    ))
    bodies = sections.groupBy("block").agg(
        joined("lang").alias("xml"),
        F.array_join(F.sort_array(F.collect_list("toc")), "").alias("toc"),
    )
    dates = t.orders.select(F.col("o_orderkey").alias("_k"), F.col("o_orderdate").alias("_d"))
    dated = bodies.join(dates, F.col("block") * DOCS_PER_ARCHIVE == F.col("_k"))
    year = F.year("_d")

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    xml = F.concat(
        F.lit("<P><Metadonnees>"),
        tag("PublicationNumero", F.col("block").cast("string")),
        tag("DateSeance", F.concat(
            F.lit("Jour-"), F.date_format("_d", "dd-MM"), F.lit("-Mois-"), year.cast("string")
        )),
        tag("DateParution", F.date_format("_d", "yyyy-MM-dd")),
        F.lit("<SessionNom>ordinaire</SessionNom><LegislatureNumero/></Metadonnees>"),
        F.lit("<C><CompteRendu><Contenu><Quantiemes><Journee>Jour "),
        F.col("block").cast("string"),
        F.lit("</Journee></Quantiemes><Sommaire>"), F.col("toc"),
        F.lit("<Sommaire1><TitreStruct><Intitule>Annexe "), F.col("block").cast("string"),
        F.lit("</Intitule></TitreStruct></Sommaire1>"),
        F.lit('</Sommaire><PresidentSeance idsyceron="p">Présidence</PresidentSeance>'),
        F.col("xml"), F.lit("</Contenu></CompteRendu></C></P>"),
    )
    return dated.select(
        F.format_string("raw/%d/AN_%d%03d.taz", year, year, F.col("block")).alias("path"),
        xml.alias("xml"),
    ).mapInPandas(_taz, "path string, modificationTime timestamp, length long, content binary")


def write_archives(archives: DataFrame, root: str) -> None:
    """Store rows (path, content) as files under a folder that all executors reach."""
    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                storage.write_bytes(f"{root}/{path}", content)
            yield batch[["path"]]

    archives.select("path", "content").mapInPandas(save, "path string").write.format("noop").mode("overwrite").save()


SQL_ARCHIVES = r"""
    blocks AS (
        SELECT DISTINCT doc_id // 32 AS block, CAST(o.o_orderdate AS DATE) AS date_seance
        FROM documents d JOIN orders o ON (d.doc_id // 32) * 32 = o.o_orderkey),
    named AS (
        SELECT *, CAST(year(date_seance) AS INTEGER) AS annee,
               'raw/' || year(date_seance) || '/AN_' || year(date_seance)
               || CASE WHEN block < 1000 THEN lpad(block::VARCHAR, 3, '0') ELSE block::VARCHAR END
               || '.taz' AS source_file
        FROM blocks),
    lines AS (
        SELECT doc_id, doc_id // 32 AS block, lang, source,
               generate_subscripts(string_split(text, chr(10)), 1) AS i,
               unnest(string_split(text, chr(10))) AS line
        FROM documents),
    cleaned AS (
        SELECT *, trim(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'),
                 '^(M\.|Mme|Mlle)\.?\s+[^.]+\.\s*', ''), ' ' || chr(9) || chr(10) || chr(13)) AS t
        FROM lines),
    paras AS (
        SELECT doc_id, block, lang, source, string_agg(t, ' ' ORDER BY i) AS texte, count(*) AS n_lines
        FROM cleaned GROUP BY doc_id, block, lang, source)"""
