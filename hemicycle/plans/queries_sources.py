"""Registered queries: sources, sinks, keyed tables, archive extraction.

Inputs of the file operators are derived from the given tables by Spark: archives are made
from documents, and sinks write under the shared folder and are read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.functions import files as fl
from hemicycle.functions import text as tx
from hemicycle.operators import aggregates as ag
from hemicycle.plans import ingest
from hemicycle.plans import mapping as m
from hemicycle.plans.registry import Tables, query, r6
from hemicycle.schemas import CLASSES, INTERVENTIONS
from hemicycle.session import scratch_path
from hemicycle.sources import archive_source
from hemicycle.sources import archives as ar
from hemicycle.sources import files as fi
from hemicycle.sources import table as tb

query("scan_all", "SELECT doc_id, lang, source, n_chars FROM documents")(
    lambda t: fi.scan_all(t.spark, f"{t.folder}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
)


# JSON lines by year, then read back as whole files


def _year_lines(t: Tables):
    path = scratch_path(t.spark, "lines")
    m.interventions(t).select("annee", F.to_json(F.struct("para_id", "texte")).alias("value")).write.option(
        "maxRecordsPerFile", 2000
    ).partitionBy("annee").text(path)
    return path


def _lines(files):
    content = F.split(F.col("content").cast("string"), "\n")
    return files.select(
        F.regexp_extract("path", r"annee=(\d+)", 1).cast("int").alias("annee"),
        F.explode(F.array_remove(content, "")).alias("line"),
    ).groupBy("annee").agg(F.count("*").alias("n"))


query("scan_recursive", f"WITH {m.SQL_INTERVENTIONS} SELECT annee, count(*) AS n FROM interventions GROUP BY 1")(
    lambda t: _lines(ar.scan_recursive(t.spark, _year_lines(t), "*.txt"))
)
query("scan_year_dir", f"""
    WITH {m.SQL_INTERVENTIONS} SELECT annee, count(*) AS n FROM interventions WHERE annee = 1998 GROUP BY 1
""")(lambda t: _lines(ar.scan_year_dir(t.spark, f"{_year_lines(t)}/annee=1998", "*.txt")))

query("scan_archives", f"""
    WITH {m.SQL_ARCHIVES} SELECT source_file, 'CRI_1.xml' AS xml_name FROM named
""")(lambda t: ar.parse_archives(m.archive_files(t), ("file",)).select("source_file", "xml_name"))

query("expected_manifest", """
    WITH per_year AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS annee, count(*) AS n FROM orders GROUP BY 1),
    expected AS (SELECT annee, CAST(unnest(generate_series(1, n)) AS INTEGER) AS numero FROM per_year),
    named AS (SELECT *, 'AN_' || annee || CASE WHEN numero < 1000 THEN lpad(numero::VARCHAR, 3, '0')
                             ELSE numero::VARCHAR END || '.taz' AS name FROM expected),
    present AS (SELECT DISTINCT 'AN_' || year(o_orderdate) || lpad((dayofyear(o_orderdate))::VARCHAR, 3, '0') || '.taz' AS name
                FROM orders)
    SELECT annee, numero, name FROM named WHERE name NOT IN (SELECT name FROM present)
""")(lambda t: ag.expected_manifest(
    t.orders.groupBy(F.year("o_orderdate").alias("annee")).agg(F.count("*").alias("n")),
    t.orders.select(F.format_string("AN_%d%03d.taz", F.year("o_orderdate"), F.dayofyear("o_orderdate")).alias("name")).distinct(),
))

query("skip_existing", """
    WITH stored AS (SELECT DISTINCT year(o_orderdate) AS annee, dayofyear(o_orderdate) AS n
                    FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT o_orderkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.annee = year(o.o_orderdate) AND s.n = dayofyear(o.o_orderdate))
""")(lambda t: tb.skip_existing(_issues(t), _issues(t).where("o_orderpriority = '1-URGENT'")).select("o_orderkey"))


def _issues(t: Tables):
    return t.orders.select(
        "o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("annee"),
        F.dayofyear("o_orderdate").alias("publication_numero"),
    )


# keyed tables: purchases are the batch, the other events the table; errors have no key

def _target_and_batch(t: Tables):
    key = F.when(F.col("event_type") != "error", F.col("user_id").cast("string"))
    rows = t.events.select(key.alias("para_id"), "event_id", "event_type", "ts")
    target = tb.batch_last_wins(rows.where("event_type <> 'purchase'"), "para_id", ["ts"])
    # customers bring keys the table lacks, and repeat a key within the batch
    batch = rows.where("event_type = 'purchase'").unionByName(t.customer.select(
        F.concat(F.lit("c"), F.floor(F.col("c_custkey") / F.lit(2))).alias("para_id"),
        (-F.col("c_custkey")).alias("event_id"), F.lit("customer").alias("event_type"),
        F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("ts"),
    ))
    return target, batch


_UPSERT = """
    ev AS (SELECT CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS para_id, event_id, event_type, ts FROM events),
    target AS (
        SELECT para_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY ts DESC) AS rn
            FROM ev WHERE event_type NOT IN ('purchase', 'error')) WHERE rn = 1
        UNION ALL SELECT para_id, event_id FROM ev WHERE event_type = 'error'),
    batch AS (
        SELECT para_id, event_id, ts FROM ev WHERE event_type = 'purchase'
        UNION ALL SELECT 'c' || (c_custkey // 2), -c_custkey, TIMESTAMP '2024-06-01' FROM customer),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY ts DESC, event_id DESC) AS last,
                      row_number() OVER (PARTITION BY para_id ORDER BY ts, event_id) AS first FROM batch)"""

query("upsert_by_key", f"""
    WITH {_UPSERT}
    SELECT para_id, event_id FROM target WHERE para_id IS NULL OR para_id NOT IN (SELECT para_id FROM batch)
    UNION ALL SELECT para_id, event_id FROM ranked WHERE last = 1
""")(lambda t: tb.merge_upsert(*_target_and_batch(t), "para_id", ["ts", "event_id"]).select("para_id", "event_id"))

query("insert_if_absent", f"""
    WITH {_UPSERT}
    SELECT para_id, event_id FROM target
    UNION ALL SELECT para_id, event_id FROM ranked
    WHERE first = 1 AND para_id NOT IN (SELECT para_id FROM target WHERE para_id IS NOT NULL)
""")(lambda t: tb.merge_insert(*_target_and_batch(t), "para_id", ["ts", "event_id"]).select("para_id", "event_id"))

query("insert_skipped", f"""
    WITH {_UPSERT}, added AS (SELECT count(*) AS a FROM ranked
        WHERE first = 1 AND para_id NOT IN (SELECT para_id FROM target WHERE para_id IS NOT NULL))
    SELECT (SELECT a FROM added) AS inserted, count(*) - (SELECT a FROM added) AS skipped FROM batch
""")(lambda t: tb.skipped_count(*_target_and_batch(t), "para_id", ["ts", "event_id"]))

query("batch_last_wins", f"WITH {_UPSERT} SELECT para_id, event_id FROM ranked WHERE last = 1")(
    lambda t: tb.batch_last_wins(_target_and_batch(t)[1], "para_id", ["ts", "event_id"]).select("para_id", "event_id")
)
query("batch_first_wins", f"WITH {_UPSERT} SELECT para_id, event_id FROM ranked WHERE first = 1")(
    lambda t: tb.batch_first_wins(_target_and_batch(t)[1], "para_id", ["ts", "event_id"]).select("para_id", "event_id")
)

query("merge_transformed", """
    SELECT doc_id AS para_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")(lambda t: fi.merge_transformed(
    t.documents.select(F.col("doc_id").alias("para_id")), t.labels.select(F.col("doc_id").alias("para_id"))
))


def _full(t: Tables):
    """documents in the full interventions schema."""
    rows = m.interventions(t).withColumns({
        "para_id": F.col("para_id").cast("string"), "ordinal": F.col("para_id").cast("long"),
    })
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in INTERVENTIONS.fields
    ])


def _created(t: Tables):
    path = scratch_path(t.spark, "table")
    tb.create_table(t.spark, path)
    tb.insert_if_absent(_full(t), path, "para_id", ["ordinal"])
    tb.create_table(t.spark, path)  # recreated: the rows are gone
    tb.upsert_by_key(_full(t).where("section_id = 'en'"), path, "para_id", ["ordinal"])
    tb.upsert_by_key(_full(t).withColumn("texte", F.lit("new")).where("section_id <> 'de'"), path, "para_id", ["ordinal"])
    return tb.read_table(t.spark, path)


query("create_table", f"""
    WITH {m.SQL_INTERVENTIONS}
    SELECT annee, section_id, count(*) AS n FROM interventions WHERE section_id <> 'de' GROUP BY 1, 2
""")(lambda t: _created(t).where("texte = 'new'").groupBy("annee", "section_id").agg(F.count("*").alias("n")))


def _transformed(t: Tables):
    path = scratch_path(t.spark, "transformed")
    fi.write_transformed(_full(t).where("section_id = 'fr'"), path)
    fi.write_transformed(_full(t), path, merge=True)
    return fi.read_transformed(t.spark, path)


_TRANSFORMED = """
    SELECT CAST(doc_id AS VARCHAR) AS para_id, CAST(NULL AS VARCHAR) AS fonction, source AS orateur_nom,
           md5(text) AS texte, 'N/A' AS section_titre, 'N/A' AS sous_section_titre, lang AS section_id FROM documents
"""
query("write_transformed", _TRANSFORMED)(lambda t: _transformed(t).withColumn("texte", F.md5("texte")))


def _json_arrays(t: Tables):
    """One JSON array per 32 documents, as the older multi-line files hold them."""
    path = scratch_path(t.spark, "arrays")
    full = fi.transformed(_full(t).select("*", F.floor(F.col("ordinal") / F.lit(32)).alias("b")), "b")
    full.groupBy("b").agg(F.to_json(F.collect_list(F.struct(*[c for c in full.columns if c != "b"]))).alias("value")).select(
        "value"
    ).write.option("maxRecordsPerFile", 1).text(path)
    return fi.read_transformed(t.spark, path, multi_line=True)


query("read_transformed", _TRANSFORMED)(lambda t: _json_arrays(t).withColumn("texte", F.md5("texte")))


def _csv_sentiments(t: Tables):
    path = scratch_path(t.spark, "csv")
    fi.write_csv_sentiments(m.sentiments(t), path)
    return fi.read_csv_sentiments(t.spark, path)


# four decimals on both sides: printf agrees with Spark except on exact ties, which these
# values (quotients of two-decimal numbers) do not meet
_CSV = f"""
    WITH {m.SQL_SENTIMENTS}
    SELECT CAST(para_id AS VARCHAR) AS para_id,
           {", ".join(f"CAST(printf('%.4f', {c}) AS DOUBLE) AS {c}" for c in CLASSES)} FROM sentiments
"""
query("write_csv_sentiments", _CSV)(_csv_sentiments)
query("read_csv_sentiments", f"""
    SELECT count(*) AS n, round(sum(very_negative), 4) AS s, min(para_id) AS first_id FROM ({_CSV})
""")(lambda t: _csv_sentiments(t).agg(
    F.count("*").alias("n"), F.round(F.sum("very_negative"), 4).alias("s"), F.min("para_id").alias("first_id")
))


def _csv_deputes(t: Tables):
    path = scratch_path(t.spark, "deputes")
    t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.lit("Ann")).alias("prenom"),
        F.col("c_name").alias("nom"), F.col("c_mktsegment").alias("groupe"),
        (F.lit(10) + F.col("c_nationkey") % 7).alias("legislatureLast"),
    ).write.option("header", "true").csv(path)
    return fi.read_csv_deputes(t.spark, path)


query("read_csv_deputes", """
    SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'Ann' END AS prenom, c_name AS nom, c_mktsegment AS groupe,
           CAST(10 + c_nationkey % 7 AS INTEGER) AS "legislatureLast" FROM customer
""")(_csv_deputes)


def _result_json(t: Tables):
    base = scratch_path(t.spark, "results")
    counts = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    fi.write_result_json(counts, base)
    fi.write_result_json(counts, base)
    return t.spark.read.schema("lang string, n long, run_id string").json(base)


query("write_result_json", "SELECT lang, count(*) AS n, 2 AS runs FROM documents GROUP BY lang")(
    lambda t: _result_json(t).groupBy("lang", "n").agg(F.count_distinct("run_id").cast("int").alias("runs"))
)


def _reports(t: Tables):
    path = scratch_path(t.spark, "reports")
    stats = m.file_stats(t)
    for run in ("a", "b"):
        fi.append_run_report(ingest.run_report(stats, 0.0, 98.5), ingest.failed_files(stats), path, run)
    return fi.read_run_reports(t.spark, path)


query("append_run_report", f"""
    WITH {m.SQL_FILE_STATS}, r(run_id) AS (VALUES ('a'), ('b'))
    SELECT run_id, 98.5::DOUBLE AS duration_seconds, count(*) AS total,
           count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS errors
    FROM file_stats CROSS JOIN r GROUP BY run_id
""")(lambda t: (lambda runs, errors: runs.join(
    errors.groupBy("run_id").agg(F.count("*").alias("errors")), "run_id"
).select("run_id", "duration_seconds", "statistics.total", "statistics.success", "errors"))(*_reports(t)))


def _written_duplicates(t: Tables):
    path = scratch_path(t.spark, "duplicates")
    fi.write_duplicates(t.documents.select("doc_id", "text"), ["text"], path)
    return t.spark.read.schema("doc_id long, text string, group_size long").json(path)


query("write_duplicates", """
    SELECT doc_id, md5(text) AS text, n AS group_size
    FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1
""")(lambda t: _written_duplicates(t).withColumn("text", F.md5("text")))


def _written_reconciliation(t: Tables):
    path = scratch_path(t.spark, "reconciliation")
    fi.write_reconciliation(t.documents, t.labels, "doc_id", path)
    return t.spark.read.schema("doc_id long, finding string, n long").json(f"{path}/findings")


query("write_reconciliation", """
    SELECT doc_id, 'missing' AS finding, 1::BIGINT AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")(_written_reconciliation)


# archives made from documents


def _elements(t: Tables, *kinds: str):
    return ar.parse_archives(m.archive_files(t), kinds)


_PARAS = f"""
    WITH {m.SQL_ARCHIVES}
    SELECT CAST(p.doc_id AS VARCHAR) AS para_id, n.source_file, 'sec-' || lang AS section_id,
           'Langue ' || lang AS section_titre, CASE WHEN lang IN ('en', 'de') THEN 'Source ' || source END AS sous_section_titre,
           'M. ' || source || '.' AS orateur_nom, 'Député' AS orateur_fonction, md5(texte) AS texte,
           lang = 'fr' AS vote_present, CAST(n.block AS INTEGER) AS publication_numero, n.date_seance, n.annee
    FROM paras p JOIN named n ON p.block = n.block"""
_PARA_COLUMNS = (
    "para_id", "source_file", "section_id", "section_titre", "sous_section_titre", "orateur_nom",
    "orateur_fonction", "vote_present", "publication_numero", "date_seance", "annee",
)


def _para_view(rows):
    return rows.select(*_PARA_COLUMNS, F.md5("texte").alias("texte"))


query("xml_paragraphs", _PARAS)(lambda t: _para_view(ar.xml_paragraphs(m.archive_files(t))))


def _ingested(t: Tables, years: list[int] | None, replace: bool):
    path = scratch_path(t.spark, "ingest")
    ingest.ingest_years(m.archive_files(t), path, years, replace=replace)
    return tb.read_table(t.spark, path)


query("ingest_years", _PARAS)(lambda t: _para_view(_ingested(t, None, True)))
query("ingest_year", f"SELECT * FROM ({_PARAS}) WHERE annee = 1997")(
    lambda t: _para_view(_ingested(t, [1997], False))
)


def _stored_archives(t: Tables) -> str:
    """The archives made from documents, as files under the shared folder."""
    root = scratch_path(t.spark, "archives")
    m.write_archives(m.archive_files(t), root)
    return f"{root}/raw"


def _incremental(t: Tables):
    path, root = scratch_path(t.spark, "incremental"), _stored_archives(t)
    ingest.ingest_years(root, path, [1996, 1997], spark=t.spark)
    done = ingest.ingest_incremental(root, path, spark=t.spark)
    return done.withColumn("filename", F.regexp_extract("filename", "(raw/.*)$", 1))


query("ingest_incremental", f"""
    WITH {m.SQL_ARCHIVES}, counts AS (SELECT block, count(*) AS d FROM paras GROUP BY 1)
    SELECT source_file AS filename, CASE WHEN annee IN (1996, 1997) THEN 'skipped' ELSE 'success' END AS status,
           CASE WHEN annee IN (1996, 1997) THEN 0 ELSE d END AS documents_count,
           CASE WHEN annee IN (1996, 1997) THEN 0 ELSE d END AS documents_stored,
           annee NOT IN (1996, 1997) AS timed, annee AS year
    FROM named JOIN counts USING (block)
""")(lambda t: _incremental(t).select(
    "filename", "status", "documents_count", "documents_stored", (F.col("duration_seconds") > 0).alias("timed"), "year"))


def _snapshots(t: Tables):
    """Row counts by version: first languages, then an upsert, then an insert; old ones stay."""
    path = scratch_path(t.spark, "versions")
    rows = _full(t)
    tb.insert_if_absent(rows.where("section_id = 'fr'"), path, "para_id", ["ordinal"])
    tb.upsert_by_key(rows.where("section_id IN ('fr', 'en')"), path, "para_id", ["ordinal"])
    tb.insert_if_absent(rows, path, "para_id", ["ordinal"])
    read = [tb.read_table(t.spark, path, version=v).withColumn("version", F.lit(v)) for v in tb.versions(path)]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("version", "annee").agg(F.count("*").alias("n"))


query("table_versions", f"""
    WITH {m.SQL_INTERVENTIONS}, v(version) AS (VALUES (1), (2), (3))
    SELECT version, annee, count(*) AS n FROM interventions, v
    WHERE section_id = 'fr' OR (version >= 2 AND section_id = 'en') OR version = 3 GROUP BY ALL
""")(_snapshots)

# the data source opens only what its tests leave
query("transcript_source", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT n.source_file, CAST(p.doc_id AS VARCHAR) AS para_id, i.lines AS parts
    FROM paras p JOIN named n USING (block) JOIN (SELECT doc_id, count(*) AS lines FROM lines GROUP BY 1) i USING (doc_id)
    WHERE n.annee >= 1995 AND n.block <> 3
""")(lambda t: archive_source.read_transcripts(
    t.spark, _stored_archives(t), where=[("issue_year", ">=", 1995), ("issue_number", "!=", 3)]
).where("kind = 'run'").select(F.regexp_extract("source_file", "(raw/.*)$", 1).alias("source_file"), "para_id", F.size("parts").cast("long").alias("parts")))

query("xml_metadata", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT source_file, CAST(block AS INTEGER) AS publication_numero, date_seance, date_seance AS date_parution, annee,
           CAST(month(date_seance) AS INTEGER) AS mois, 'ordinaire' AS session_nom, CAST(NULL AS INTEGER) AS legislature
    FROM named
""")(lambda t: ar.xml_metadata(_elements(t, "file")).select(
    "source_file", "publication_numero", "date_seance", "date_parution", "annee", "mois", "session_nom", "legislature"
))

query("xml_sections", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT source_file, 'sec-' || lang AS section_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 0 END AS sub_kind,
           count(*) AS n
    FROM lines JOIN named USING (block) GROUP BY ALL
""")(lambda t: ar.xml_sections(_elements(t, "para")).groupBy("source_file", "section_id", "sub_kind").agg(
    F.count("*").alias("n")
))

query("xml_text", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT CAST(doc_id AS VARCHAR) AS para_id, i AS rang, md5(CASE WHEN i = 1 THEN 'M. ' || source || '.' || '  ' || line
           ELSE line END) AS texte
    FROM lines
""")(lambda t: ar.xml_sections(_elements(t, "para")).select(
    F.col("idsyceron").alias("para_id"), "ordinal", "text"
).withColumn("rang", F.expr(
    "row_number() over (partition by para_id order by ordinal)"
).cast("long")).select("para_id", "rang", F.md5("text").alias("texte")))

query("xml_speaker", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT source_file, 'M. ' || source || '.' AS name, count(*) AS n FROM paras JOIN named USING (block) GROUP BY ALL
""")(lambda t: _elements(t, "para").where("name is not null").groupBy("source_file", "name").agg(
    F.count("*").alias("n")
))

query("xml_speakers", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT source_file, name FROM (
        SELECT source_file, 'M. ' || source || '.' AS name, row_number() OVER (
            PARTITION BY source_file ORDER BY lang DESC, CASE WHEN lang IN ('en', 'de') THEN source ELSE '' END DESC, doc_id DESC) AS rn
        FROM paras JOIN named USING (block)) WHERE rn <= 10
""")(lambda t: ar.xml_speakers(_elements(t, "speaker"), last=10).select("source_file", "name"))

query("xml_votes", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT source_file, 'sec-fr' AS section_id, TRUE AS vote_present, CAST(count(*) AS INTEGER) AS nombre_votants,
           CAST(NULL AS INTEGER) AS nombre_suffrages_exprimes, 1 AS votes_pour
    FROM paras JOIN named USING (block) WHERE lang = 'fr' GROUP BY source_file
""")(lambda t: ar.xml_votes(_elements(t, "vote")).select(
    "source_file", "section_id", "vote_present", "nombre_votants", "nombre_suffrages_exprimes", "votes_pour"
))

query("xml_ids", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT CAST(doc_id AS VARCHAR) AS id, 'Para' AS tag, count(*) AS n FROM lines GROUP BY doc_id
    UNION ALL SELECT 'x', 'Para', count(DISTINCT block) FROM lines WHERE lang = 'en'
    UNION ALL SELECT 'p', 'PresidentSeance', count(*) FROM named
""")(lambda t: ar.xml_ids(_elements(t, "id")).groupBy("id", "tag").agg(F.count("*").alias("n")))

query("xml_para_count", f"""
    WITH {m.SQL_ARCHIVES},
    raw AS (SELECT block, count(*) + CAST(bool_or(lang = 'en') AS INTEGER) AS raw FROM lines GROUP BY block),
    ext AS (SELECT block, count(*) AS extracted FROM paras GROUP BY block)
    SELECT source_file, raw, extracted, round(100.0::DOUBLE * extracted / raw, 6) AS ratio_pct
    FROM raw JOIN ext USING (block) JOIN named USING (block)
""")(lambda t: ar.xml_para_count(_elements(t, "any_para", "para")).withColumn("ratio_pct", r6("ratio_pct")))

query("xml_subsection_titles", f"""
    WITH {m.SQL_ARCHIVES} SELECT DISTINCT source_file, 'Source ' || source AS title
    FROM paras JOIN named USING (block) WHERE lang = 'de'
""")(lambda t: ar.xml_subsection_titles(_elements(t, "subsection")).select("source_file", "title"))

query("xml_sitting_header", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT source_file, 'Jour ' || block AS journee, '' AS session, 'Présidence' AS president FROM named
""")(lambda t: ar.xml_sitting_header(_elements(t, "header")).select("source_file", "journee", "session", "president"))

query("xml_toc", f"""
    WITH {m.SQL_ARCHIVES}
    SELECT DISTINCT source_file, CAST(1 AS INTEGER) AS level, 'title' AS kind, 'Langue ' || lang AS label
    FROM paras JOIN named USING (block)
    UNION ALL SELECT source_file, 1, 'title', 'Annexe ' || block FROM named
""")(lambda t: ar.xml_toc(_elements(t, "toc")).select("source_file", "level", "kind", "label"))

query("toc_missing_sections", f"""
    WITH {m.SQL_ARCHIVES} SELECT source_file, 'Annexe ' || block AS label FROM named
""")(lambda t: ar.toc_missing_sections(_elements(t, "toc", "para")))
