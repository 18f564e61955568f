"""Archives of XML transcripts as a Spark job.

``scan_*`` list files, ``parse_archives`` turns each file into element rows inside the
tasks, and everything after that (sections, paragraphs, speakers, votes, ids) is a
DataFrame expression over those rows.
"""

from __future__ import annotations

import io
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hemicycle.functions import dates as dt
from hemicycle.functions import text as tx
from hemicycle.schemas import ELEMENTS, INTERVENTIONS, RUNS
from hemicycle.sources.archive_source import ARCHIVE_PATTERN, batches_of
from hemicycle.sources.transcripts import VOTE_FIELDS, element_text, meta_pairs, speaker_of, title_of, vote_counts

ROWS_PER_BATCH = 5000

# scans


def scan_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """Archive files with their bytes: (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(list(paths))


def scan_year_dir(spark: SparkSession, directory: str, pattern: str = ARCHIVE_PATTERN) -> DataFrame:
    """Archives directly in one year directory."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)


def scan_recursive(spark: SparkSession, root: str, pattern: str = ARCHIVE_PATTERN) -> DataFrame:
    """Archives at any depth under a root."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    )


# parsing, inside the tasks


def _open_transcript(content: bytes) -> tuple[str, ET.Element]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as outer:
        inner = next((m for m in outer if m.name.endswith(".tar")), None)
        if inner is None:
            raise ValueError("no inner tar")
        with tarfile.open(fileobj=outer.extractfile(inner), mode="r:") as tar:
            for member in tar:
                if member.name.startswith("CRI_") and member.name.endswith(".xml"):
                    return member.name, ET.fromstring(tar.extractfile(member).read())
    raise ValueError("no CRI_*.xml in the inner tar")


def _title(elem: ET.Element) -> str | None:
    return title_of(elem.find("./TitreStruct"))


def _votes(section: ET.Element) -> list[tuple[str, str]] | None:
    result = section.find(".//ResultatVote")
    return None if result is None else vote_counts(result)


def _para_row(para: ET.Element, **place: object) -> dict:
    return {
        "kind": "para", "tag": para.tag, "ident": para.get("Ident"),
        "idsyceron": para.get("idsyceron"), "name": speaker_of(para),
        "text": element_text(para), **place,
    }


def _paragraph_rows(body: ET.Element) -> Iterator[dict]:
    """Every paragraph below the report's contents with its place. ``sub_kind``: 0 directly
    in a section, 1 or 2 in such a subsection, -1 before any section, 9 nested deeper."""
    for para in body.findall("./Para"):
        yield _para_row(para, sub_kind=-1)
    for s, section in enumerate(body.findall("./Section")):
        heading = section.find("./TitreStruct")
        place = {
            "section_seq": s,
            "section_id": None if heading is None else heading.get("Ident", ""),
            "section_titre": _title(section),
            "vote": _votes(section),
        }
        listed: set[int] = set()
        subs = [(k, e) for k in (1, 2) for e in section.findall(f"./SousSection{k}")]
        if place["vote"] is not None:
            yield {"kind": "vote", **place}
        for para in section.findall("./Para"):
            listed.add(id(para))
            yield _para_row(para, sub_kind=0, sub_seq=-1, level=len(subs), **place)
        for n, (kind, sub) in enumerate(subs):
            title = _title(sub)
            for para in sub.findall("./Para"):
                listed.add(id(para))
                yield _para_row(para, sub_kind=kind, sub_seq=n, sub_titre=title, **place)
        for para in section.iter("Para"):
            if id(para) not in listed:
                yield _para_row(para, sub_kind=9, **place)


def _toc_rows(root: ET.Element) -> Iterator[dict]:
    for summary in root.iter("Sommaire"):
        stack = [(summary, 0)]
        while stack:
            elem, level = stack.pop()
            below = []
            for child in elem:
                if child.tag in ("Sommaire1", "Sommaire2", "Sommaire3"):
                    below.append((child, int(child.tag[-1])))
                elif child.tag == "TitreStruct":
                    label = child.find(".//Intitule")
                    own = None if label is None else (label.text or "")
                    yield {"kind": "toc", "tag": "title", "level": level, "text": own}
                elif child.tag == "Para":
                    yield {"kind": "toc", "tag": "para", "level": level, "text": element_text(child)}
            stack.extend(reversed(below))


def _element_rows(root: ET.Element) -> Iterator[dict]:
    block = root.find(".//Metadonnees")
    meta = [] if block is None else meta_pairs(block)  # maps travel as lists of pairs
    yield {"kind": "file", "meta": meta}

    for elem in root.iter():
        if "idsyceron" in elem.attrib:
            yield {"kind": "id", "tag": elem.tag, "ident": elem.get("Ident"),
                   "idsyceron": elem.get("idsyceron")}
        if elem.tag == "Orateur":
            name = elem.find("Nom")
            yield {"kind": "speaker", "name": None if name is None else name.text}
        elif elem.tag == "SousSection2":
            yield {"kind": "subsection", "sub_titre": _title(elem)}
        elif elem.tag == "Para":
            yield {"kind": "any_para"}

    report = root.find(".//CompteRendu")
    if report is not None:
        header = {
            "Journee": report.findtext(".//Quantiemes/Journee"),
            "Session": report.findtext(".//Quantiemes/Session"),
            "PresidentSeance": next(
                (element_text(e) for e in report.findall("./Contenu/PresidentSeance")), None
            ),
            "Signataire": next(
                (" ".join(element_text(e).split()) for e in root.iter("Signataire")), None
            ),
        }
        yield {"kind": "header", "meta": [(k, v) for k, v in header.items() if v is not None]}
    for body in root.findall(".//CompteRendu/Contenu"):
        for row in _paragraph_rows(body):
            yield {**row, "meta": meta} if row["kind"] == "para" else row
    yield from _toc_rows(root)


def _rows_of_file(path: str, content: bytes, kinds: frozenset[str]) -> Iterator[dict]:
    xml_name = None
    try:
        xml_name, root = _open_transcript(content)
        for ordinal, row in enumerate(_element_rows(root)):
            if row["kind"] in kinds:
                yield {"source_file": path, "xml_name": xml_name, "ordinal": ordinal, **row}
    except Exception as problem:  # a bad file is a row, not a failed job
        yield {
            "source_file": path, "xml_name": xml_name, "kind": "error", "ordinal": -1,
            "error": f"{type(problem).__name__}: {problem}",
        }


ALL_KINDS = ("file", "id", "speaker", "subsection", "any_para", "header", "para", "vote", "toc")


def parse_archives(files: DataFrame, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """Element rows of the archives; a file that cannot be read gives one ``error`` row.

    Archives cannot be split, so one file is the unit of work; the scan packs them into
    partitions by size. Rows leave in small batches, so a large file is not held twice.
    """
    wanted = frozenset(kinds)
    schema = to_arrow_schema(ELEMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for row in _rows_of_file(path.as_py(), content.as_py(), wanted):
                    buffer.append(row)
                    if len(buffer) >= ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(buffer, schema=schema)
                        buffer = []
        if buffer:
            yield pa.RecordBatch.from_pylist(buffer, schema=schema)

    return files.select("path", "content").mapInArrow(run, ELEMENTS)


# rows -> tables, all native


def _of_kind(elements: DataFrame, kind: str) -> DataFrame:
    return elements.where(F.col("kind") == kind)


def metadata_columns(meta: str = "meta") -> dict[str, Column]:
    """Typed metadata; an empty or malformed number is NULL."""
    def get(field: str) -> Column:
        return F.try_element_at(F.col(meta), F.lit(field))

    def number(field: str) -> Column:
        return tx.strip(get(field)).try_cast("int")

    seance = dt.parse_an_date(get("DateSeance"))
    return {
        "publication_numero": number("PublicationNumero"),
        "date_parution": dt.parse_an_date(get("DateParution")),
        "date_seance": seance,
        "annee": F.year(seance),
        "mois": F.month(seance),
        "session_nom": get("SessionNom"),
        "session_parlementaire": get("SessionParlementaire"),
        "legislature": number("LegislatureNumero"),
        "numero_premiere_page": number("NumeroPremierePage"),
    }


def xml_metadata(elements: DataFrame) -> DataFrame:
    return _of_kind(elements, "file").select(
        "source_file", "xml_name", *[c.alias(n) for n, c in metadata_columns().items()]
    )


def kept_in_strict_mode() -> Column:
    """A section with subsections keeps only their paragraphs; paragraphs before the first
    section or nested deeper are left out."""
    # level holds, for a direct paragraph, how many subsections its section has
    direct = (F.col("sub_kind") == 0) & (F.col("level") == 0)
    return F.col("sub_kind").isin(1, 2) | direct


def xml_sections(elements: DataFrame, keep_all: bool = False) -> DataFrame:
    """Paragraph rows with section and subsection titles; ``keep_all`` keeps every paragraph."""
    paras = _of_kind(elements, "para")
    return paras if keep_all else paras.where(kept_in_strict_mode())


def transcript_runs(files: DataFrame, keep_all: bool = False) -> DataFrame:
    """Runs and file statuses of archives given as rows (path, content); files on disk are read
    by ``archive_source.read_transcripts``, which gives the same rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((path.as_py(), lambda content=content: io.BytesIO(content.as_py()))
                 for batch in batches for path, content in zip(batch.column("path"), batch.column("content")))
        yield from batches_of(given, keep_all)

    return files.select("path", "content").mapInArrow(run, RUNS)


def run_interventions(runs: DataFrame, generic: bool = True) -> DataFrame:
    """Interventions from runs, row by row: a continuation is cleaned with the speaker of the
    run's first paragraph."""
    cleaned = F.transform("parts", lambda part: tx.strip_speaker_prefix(part, F.col("orateur_nom"), generic))
    votes = {
        n: F.try_element_at(F.col("vote"), F.lit(n)).try_cast("int") for n in VOTE_FIELDS
    }
    out = {
        **metadata_columns(),
        **votes,
        "texte": F.array_join(cleaned, " "),
        "orateur_fonction": tx.classify_role(F.col("orateur_nom")),
        "vote_present": F.col("vote").isNotNull(),
        "extraction_timestamp": dt.now_timestamp(),
    }
    return _of_kind(runs, "run").select(*[
        out.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in INTERVENTIONS.fields
    ])


def xml_paragraphs(files: DataFrame, keep_all: bool = False, generic: bool = True) -> DataFrame:
    """One row per intervention: consecutive paragraphs of one id in one place are joined, by the
    parser itself, so nothing is shuffled."""
    return run_interventions(transcript_runs(files, keep_all), generic)


def xml_votes(elements: DataFrame) -> DataFrame:
    """One row per section with a vote."""
    return _of_kind(elements, "vote").select(
        "source_file", "section_seq", "section_id",
        F.lit(True).alias("vote_present"),
        *[F.try_element_at(F.col("vote"), F.lit(n)).try_cast("int").alias(n) for n in VOTE_FIELDS],
    )


def xml_ids(elements: DataFrame) -> DataFrame:
    return _of_kind(elements, "id").select(
        "source_file", "ordinal", F.col("idsyceron").alias("id"), "tag", "ident"
    )


PLACE = ["source_file", "section_seq", "sub_kind", "sub_seq"]


def xml_para_count(elements: DataFrame) -> DataFrame:
    """Per file: paragraph elements of the XML, extracted rows, and their ratio in percent.

    One pass: an extracted row is a paragraph that starts a run of its id.
    """
    kept = (F.col("kind") == "para") & F.col("idsyceron").isNotNull() & kept_in_strict_mode()
    rows = elements.where(F.col("kind").isin("any_para", "para")).withColumn(
        "_kept", F.coalesce(kept, F.lit(False))
    )
    along = Window.partitionBy(*PLACE, "_kept").orderBy("ordinal")
    starts = F.coalesce(F.lag("idsyceron").over(along) != F.col("idsyceron"), F.lit(True))
    return rows.withColumn("_start", F.col("_kept") & starts).groupBy("source_file").agg(
        F.count_if(F.col("kind") == "any_para").alias("raw"),
        F.count_if(F.col("_start")).alias("extracted"),
    ).withColumn("ratio_pct", F.try_divide(F.lit(100.0) * F.col("extracted"), F.col("raw")))


def xml_speakers(elements: DataFrame, last: int | None = None) -> DataFrame:
    """Speaker elements in order; ``last`` keeps the last ones of each file."""
    rows = _of_kind(elements, "speaker").select("source_file", "ordinal", "name")
    if last is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("ordinal")))
    return rows.withColumn("_rn", rank).where(F.col("_rn") <= last).drop("_rn")


def xml_subsection_titles(elements: DataFrame) -> DataFrame:
    return _of_kind(elements, "subsection").select(
        "source_file", "ordinal", F.col("sub_titre").alias("title")
    )


def xml_sitting_header(elements: DataFrame) -> DataFrame:
    def get(field: str) -> Column:
        return tx.clean_text(F.try_element_at(F.col("meta"), F.lit(field)))

    return _of_kind(elements, "header").select(
        "source_file",
        get("Journee").alias("journee"),
        get("Session").alias("session"),
        get("PresidentSeance").alias("president"),
        get("Signataire").alias("signataire"),
    )


def xml_toc(elements: DataFrame) -> DataFrame:
    """Table of contents rows: level, kind (title or para) and label."""
    return _of_kind(elements, "toc").select(
        "source_file", "ordinal", "level", F.col("tag").alias("kind"),
        tx.clean_text(F.col("text")).alias("label"),
    )


def toc_missing_sections(elements: DataFrame) -> DataFrame:
    """Titles of the table of contents that no section or subsection carries, per file."""
    listed = (F.col("kind") == "toc") & (F.col("tag") == "title")
    labels = F.when(listed, F.array(tx.clean_text(F.col("text")))).when(
        F.col("kind") == "para", F.array("section_titre", "sub_titre")
    )
    # one pass: both sides are counted per label
    rows = elements.select("source_file", "kind", F.explode(labels).alias("label"))
    sides = rows.where(F.col("label") != "").groupBy("source_file", "label").agg(
        F.count_if(F.col("kind") == "toc").alias("toc"), F.count_if(F.col("kind") == "para").alias("para")
    )
    return sides.where((F.col("toc") > 0) & (F.col("para") == 0)).select("source_file", "label")


def parse_errors(elements: DataFrame) -> DataFrame:
    return _of_kind(elements, "error").select("source_file", "error")
