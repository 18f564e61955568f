import datetime
import itertools
import os
import random
import xml.etree.ElementTree as ET

import pandas as pd
import pyarrow as pa
import pytest
from archive_maker import tar_bytes, taz, transcript, write
from pyspark.sql import functions as F

from hemicycle import session
from hemicycle.plans import ingest, mapping
from hemicycle.schemas import INTERVENTIONS
from hemicycle.sources import archive_source, archives, files, storage, table, transcripts
from hemicycle.streaming.ingest import ingest_available

BODY = """
<Para Ident="p0" idsyceron="10"><Orateur><Nom>M. le président.</Nom></Orateur> La séance est ouverte.</Para>
<Section>
  <TitreStruct Ident="s1"><Intitule>Accord <Exposant>er</Exposant> franco   allemand</Intitule></TitreStruct>
  <Para Ident="p1" idsyceron="11">
      <Orateur>
        <Nom>M. Paul Exemple.</Nom>
      </Orateur> Je suis <Italique>pour</Italique> ce texte.</Para>
  <Para Ident="p2" idsyceron="11">Suite du propos.</Para>
  <Para Ident="p3">sans identifiant</Para>
  <Para Ident="p4" idsyceron="11">Fin du propos.</Para>
  <Para Ident="p5" idsyceron="12"><Orateur><Nom>Mme la ministre.</Nom></Orateur> Merci.</Para>
  <Para Ident="p6" idsyceron="11">Encore.</Para>
  <ResultatVote><NombreVotants><Valeur>100</Valeur></NombreVotants><Pour><Valeur>60</Valeur></Pour>
    <Contre><Valeur>x</Valeur></Contre></ResultatVote>
</Section>
<Section>
  <TitreStruct Ident="s2"><Intitule>Budget</Intitule></TitreStruct>
  <Para Ident="p7" idsyceron="20">perdu en mode strict</Para>
  <SousSection2><TitreStruct><Intitule>Article 2</Intitule></TitreStruct>
    <Para idsyceron="21"><Orateur><Nom>Mme Anne Le Secrétaire</Nom></Orateur> Deux.</Para></SousSection2>
  <SousSection1><TitreStruct><Intitule>Article 1</Intitule></TitreStruct>
    <Para idsyceron="21">Un.</Para>
    <Groupe><Para idsyceron="22">profond</Para></Groupe></SousSection1>
</Section>
"""
SUMMARY = """<Sommaire><PresidentSeance>x</PresidentSeance>
<Sommaire1><TitreStruct><Intitule>Budget<LienInterneDocRef> (p.</LienInterneDocRef></Intitule></TitreStruct>
<Sommaire2><TitreStruct><Intitule>Inconnu</Intitule></TitreStruct><Para>M. Y</Para></Sommaire2></Sommaire1></Sommaire>"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    write(base, 2018, 83, taz(transcript(BODY, summary=SUMMARY)))
    other = """<Section><TitreStruct Ident="s9"><Intitule>T</Intitule></TitreStruct>
      <Para idsyceron="90">Texte de 2019.</Para></Section>"""
    write(base, 2019, 1, taz(transcript(other, number="", date="2019-01-08")))
    write(base, 2019, 2, tar_bytes({"only.txt": b"x"}, "w:gz"))
    write(base, 2019, 3, b"not an archive")
    write(base, 2019, 4, taz(transcript(other), xml_name="OTHER.xml"))
    write(base, 2019, 5, taz(transcript("")))
    return base


@pytest.fixture(scope="module")
def elements(spark, root):
    return archives.parse_archives(archives.scan_recursive(spark, str(root)))


@pytest.fixture(scope="module")
def scan(spark, root):
    return archives.scan_recursive(spark, str(root))


def rows_by(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_paragraphs_in_strict_mode(scan):
    rows = archives.xml_paragraphs(scan).where(F.col("source_file").contains("2018083"))
    got = {
        (r.section_id, r.sous_section_titre, r.para_id, r.texte): r for r in rows.collect()
    }
    assert set(got) == {
        ("s1", None, "11", "Je suis  pour  ce texte. Suite du propos. Fin du propos."),
        ("s1", None, "12", "Merci."),
        ("s1", None, "11", "Encore."),
        ("s2", "Article 2", "21", "Deux."),
        ("s2", "Article 1", "21", "Un."),
    }
    first = got[("s1", None, "11", "Je suis  pour  ce texte. Suite du propos. Fin du propos.")]
    assert first.section_titre == "Accord er franco allemand"
    assert first.orateur_nom == "M. Paul Exemple." and first.orateur_fonction == "Député"
    assert got[("s1", None, "12", "Merci.")].orateur_fonction == "Ministre"
    assert got[("s2", "Article 2", "21", "Deux.")].orateur_fonction == "Secrétaire"
    assert got[("s2", "Article 1", "21", "Un.")].orateur_fonction is None
    assert first.date_seance == datetime.date(2018, 11, 6) and first.annee == 2018 and first.mois == 11
    assert first.publication_numero == 83 and first.legislature == 15
    assert first.vote_present and first.nombre_votants == 100 and first.votes_pour == 60
    assert first.votes_contre is None
    assert not got[("s2", "Article 1", "21", "Un.")].vote_present


def test_keep_all_adds_the_lost_paragraphs(scan):
    rows = archives.xml_paragraphs(scan, keep_all=True).where(
        F.col("source_file").contains("2018083")
    )
    ids = [r.para_id for r in rows.collect()]
    assert sorted(ids) == ["10", "11", "11", "12", "20", "21", "21", "22"]


def test_other_extractions(spark, elements):
    one = elements.where(F.col("source_file").contains("2018083"))
    assert rows_by(archives.xml_ids(one), "id", "tag")[0] == ("1", "PresidentSeance")
    assert archives.xml_ids(one).count() == 11
    names = [r.name for r in archives.xml_speakers(one, last=2).orderBy("ordinal").collect()]
    assert names == ["Mme la ministre.", "Mme Anne Le Secrétaire"]
    assert rows_by(archives.xml_subsection_titles(one), "title") == [("Article 2",)]
    head = archives.xml_sitting_header(one).first()
    assert (head.journee, head.session, head.president) == (
        "Séance du matin", "Session de rentrée", "Présidence de Mme Q"
    )
    votes = archives.xml_votes(one).first()
    assert (votes.section_id, votes.nombre_votants, votes.votes_contre) == ("s1", 100, None)
    toc = [(r.level, r.kind, r.label) for r in archives.xml_toc(one).orderBy("ordinal").collect()]
    assert toc == [(1, "title", "Budget"), (2, "title", "Inconnu"), (2, "para", "M. Y")]
    assert rows_by(archives.toc_missing_sections(one), "label") == [("Inconnu",)]
    count = archives.xml_para_count(one).first()
    assert (count.raw, count.extracted) == (12, 5)


def test_bad_metadata_keeps_the_file_and_bad_files_are_rows(elements):
    meta = {r.source_file[-8:-4]: r for r in archives.xml_metadata(elements).collect()}
    assert meta["9001"].publication_numero is None
    assert meta["9001"].date_seance == datetime.date(2019, 1, 8)
    errors = {r.source_file[-7:-4]: r.error for r in archives.parse_errors(elements).collect()}
    assert set(errors) == {"002", "003", "004"}
    assert "no inner tar" in errors["002"] and "CRI_" in errors["004"]


def test_scan_year_dir_is_not_recursive(spark, root):
    assert archives.scan_year_dir(spark, str(root / "2019")).count() == 5
    assert archives.scan_recursive(spark, str(root)).count() == 6


@pytest.mark.parametrize("on_disk", [True, False])
def test_incremental_run(spark, root, tmp_path, on_disk):
    path, report = str(tmp_path / "table"), str(tmp_path / "report")
    scan = lambda: str(root) if on_disk else archives.scan_recursive(spark, str(root))
    first = ingest.ingest_incremental(scan(), path, report)
    status = {r.filename[-11:-4]: (r.status, r.documents_count, r.documents_stored) for r in first.collect()}
    # in one batch the first of a key wins
    assert status["2018083"] == ("success", 5, 3) and status["2019001"] == ("success", 1, 1)
    assert all(status[f"201900{i}"] == ("failed", 0, 0) for i in (2, 3, 4, 5))
    assert all(r.duration_seconds > 0 for r in first.collect())
    stored = table.read_table(spark, path)
    assert sorted(r.para_id for r in stored.collect()) == ["11", "12", "21", "90"]
    again = ingest.ingest_incremental(scan(), path, report)
    status = {r.filename[-11:-4]: (r.status, r.documents_count, r.documents_stored) for r in again.collect()}
    assert status["2018083"] == ("skipped", 0, 0)
    # the issue without a number is read again, and adds nothing
    assert status["2019001"] == ("success", 1, 0)
    assert table.read_table(spark, path).count() == 4
    runs, errors = files.read_run_reports(spark, report)
    assert runs.count() == 2 and errors.count() == 8
    stats = runs.orderBy("start_time").first().statistics
    assert (stats.total, stats.success, stats.failed, stats.documents_indexed) == (6, 2, 4, 6)


SMALL = """<Section><TitreStruct Ident="s"><Intitule>T</Intitule></TitreStruct><Para idsyceron="{0}">Texte {0}.</Para></Section>"""


def small_archives(base, year, numbers):
    return [write(base, year, n, taz(transcript(
        SMALL.format(n), number=str(n), date=f"Lundi-08-01-Janvier-{year}"))) for n in numbers]


def test_skipped_archives_are_never_opened(spark, tmp_path):
    """Stored archives are spoiled: opening one would give a failed row."""
    raw, path = tmp_path / "raw", str(tmp_path / "table")
    old = small_archives(raw, 2020, range(1, 7))
    assert {r.status for r in ingest.ingest_incremental(str(raw), path).collect()} == {"success"}
    for archive in old:
        archive.write_bytes(b"spoiled")
    small_archives(raw, 2020, range(7, 10))
    got = {r.filename[-7:-4]: r.status for r in ingest.ingest_incremental(str(raw), path).collect()}
    assert got == {f"{n:03d}": "skipped" if n < 7 else "success" for n in range(1, 10)}
    assert table.read_table(spark, path).count() == 9


def test_tests_are_applied_before_files_are_opened(spark, tmp_path):
    for year in (2020, 2021):
        small_archives(tmp_path, year, range(1, 5))
    for path in (tmp_path / "2020").iterdir():
        path.write_bytes(b"spoiled")
    read = lambda *where: archive_source.read_transcripts(spark, str(tmp_path), where=list(where))
    late = read(("issue_year", "=", 2021), ("issue_number", "in", [2, 3]))
    opened = late.where("kind = 'file'").collect()
    assert sorted((r.issue_number, r.rows, r.error) for r in opened) == [(2, 1, None), (3, 1, None)]
    assert late.where("issue_number = 2").count() == 2 and late.count() == 4  # one query leaves no trace in another
    assert late.where("issue_number = 2").unionAll(late.where("issue_number = 3")).count() == 4
    assert read().where("kind = 'file' AND error IS NOT NULL").count() == 4
    assert read(("issue_year", ">", 2021)).count() == 0
    assert ingest.ingest_year(str(tmp_path), str(tmp_path / "t"), 2021).where("status = 'success'").count() == 4
    with pytest.raises(ValueError, match="texte"):
        read(("texte", "=", "x"))


def test_tests_compare_as_sql_does():
    columns = archive_source.name_columns("a/2020/AN_2020007.taz")
    nameless = archive_source.name_columns("a/x.taz")
    for test, want in [(("issue_number", "=", 7), True), (("issue_number", "!=", 7), False), (("issue_number", "<", 8), True),
                       (("issue_number", "<=", 6), False), (("issue_number", ">", 6), True), (("issue_number", ">=", 8), False),
                       (("issue_year", "in", [2019, 2020]), True), (("issue_year", "not in", [2020]), False),
                       (("source_file", "starts with", "a/2"), True), (("file_year", "=", "2020"), True)]:
        assert archive_source.holds([test], columns) == want
        if test[0].startswith("issue"):
            assert not archive_source.holds([test], nameless)


def test_names_are_read_alike_in_planning_and_in_columns(spark):
    from hemicycle.functions import files as fl

    names = ["a/2019/AN_2019100.taz", "AN_20191001.taz", "x/AN_201901.taz", "a/.hidden", "2018", "a/other.taz", "b/AN_20x9100.t.taz",
             "AN_ 201100.taz", "a/AN_201999999999999.taz", "", "a/20180/AN_.taz", "é/AN_2020007.tar.taz"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(
        "p", fl.file_year(F.col("p")), fl.issue_year(F.col("p")), fl.issue_number(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [tuple(archive_source.name_columns(n).values()) for n in names]


def test_file_groups_hold_every_file_once():
    listed = [(f"f{i:03d}", (i * 37) % 100) for i in range(200)]
    groups = archive_source.grouped(listed, 500, 3)
    assert sorted(p for g in groups for p in g.paths) == sorted(p for p, _ in listed)
    sizes = dict(listed)
    assert all(len(g.paths) == 1 or sum(sizes[p] for p in g.paths) <= 500 for g in groups)
    assert len(archive_source.grouped(listed, 1 << 30, 8)) >= 8 and archive_source.grouped([], 5, 1) == []


def test_nothing_is_shuffled_before_the_insert(spark, root, scan):
    for rows in (ingest.interventions(str(root), spark), ingest.interventions(scan)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def runs_of_tree(xml: str, keep_all: bool):
    """The same runs, from the whole tree."""
    out = []
    top = ET.fromstring(xml)
    block = top.find(".//Metadonnees")
    meta = [] if block is None else [(f, block.findtext(f)) for f in transcripts.META_FIELDS if block.findtext(f)]

    def runs(paras, place):
        ids = [(p.get("idsyceron"), transcripts.speaker_of(p), transcripts.element_text(p)) for p in paras]
        for ident, group in itertools.groupby([x for x in ids if x[0] is not None], key=lambda x: x[0]):
            group = list(group)
            out.append((ident, group[0][1], [g[2] for g in group], *place, meta))

    bodies = top.findall(".//CompteRendu/Contenu")
    if keep_all:
        runs([p for b in bodies for p in b.findall("Para")], (None, None, None, None))
    for body in bodies:
        for section in body.findall("Section"):
            heading, vote = section.find("TitreStruct"), section.find(".//ResultatVote")
            place = [None if heading is None else heading.get("Ident", ""), transcripts.title_of(heading),
                     None if vote is None else transcripts.vote_counts(vote)]
            subs = section.findall("SousSection1") + section.findall("SousSection2")
            direct = section.findall("Para")
            if keep_all or not subs:
                runs(direct, (place[0], place[1], None, place[2]))
            for sub in subs:
                runs(sub.findall("Para"), (place[0], place[1], transcripts.title_of(sub.find("TitreStruct")), place[2]))
            if keep_all:
                known = {id(p) for p in direct} | {id(p) for s in subs for p in s.findall("Para")}
                runs([p for p in section.iter("Para") if id(p) not in known], (place[0], place[1], None, place[2]))
    return out


TAGS = ("Para", "Section", "SousSection1", "SousSection2", "TitreStruct", "Intitule", "ResultatVote", "Pour", "Valeur",
        "Orateur", "Nom", "Groupe", "Metadonnees", "PublicationNumero", "Italique")


def random_xml(rng, depth=0) -> str:
    tag = rng.choice(TAGS if depth else ("Section", "Para", "Section", "Groupe"))
    attributes = f' idsyceron="{rng.choice("123")}"' if rng.random() < 0.8 else ""
    attributes += ' Ident="i"' if rng.random() < 0.5 else ""
    inside = "".join(random_xml(rng, depth + 1) + rng.choice(["", "t", " \n"]) for _ in range(rng.randrange(5 if depth < 5 else 1)))
    return f"<{tag}{attributes}>{rng.choice(['', 'x y', 'é'])}{inside}</{tag}>"


def test_runs_read_on_the_way_equal_runs_of_the_whole_tree():
    rng = random.Random(3)
    for _ in range(400):
        body = "".join(random_xml(rng) for _ in range(rng.randrange(4)))
        extra = random_xml(rng) if rng.random() < 0.3 else ""
        xml = f"<P>{extra}<C><CompteRendu><Contenu>{body}</Contenu></CompteRendu></C><Metadonnees><DateSeance>d</DateSeance></Metadonnees></P>"
        data = xml.encode()
        for keep_all in (False, True):
            rows = transcripts.read_runs((data[i: i + 50] for i in range(0, len(data), 50)), keep_all)
            got = [(r["para_id"], r["orateur_nom"], r["parts"], r.get("section_id"), r.get("section_titre"),
                    r.get("sous_section_titre"), r.get("vote"), r["meta"]) for r in rows]
            assert got == runs_of_tree(xml, keep_all)
            order = [r["ordinal"] for r in rows]
            assert order == sorted(set(order))


def test_a_section_is_dropped_once_it_is_read():
    """The tree held while reading does not grow with the number of sections."""
    section = "<Section>" + "<Para idsyceron='1'>" + "x" * 100 + "</Para>" * 1 + "</Section>"
    parser, reader = ET.XMLPullParser(("start", "end")), transcripts.Reader()
    top, most = None, 0
    parser.feed("<P><C><CompteRendu><Contenu>")
    for _ in range(500):
        parser.feed(section)
        for event, elem in parser.read_events():
            top = elem if top is None else top
            (reader.start if event == "start" else reader.end)(elem)
        most = max(most, sum(len(e.text or "") for e in top.iter()))
    assert len(reader.rows) == 500 and most <= 100


def test_ingest_years_upserts_and_writes_transformed(spark, root, tmp_path):
    path, out = str(tmp_path / "table"), str(tmp_path / "json")
    scan = archives.scan_recursive(spark, str(root))
    ingest.ingest_year(scan, path, 2018, transformed_path=out)
    assert table.read_table(spark, path).count() == 3
    assert files.read_transformed(spark, out).count() == 5
    ingest.ingest_years(scan, path, [2018, 2019, 1999], transformed_path=out, merge=True)
    assert table.read_table(spark, path).count() == 4
    assert files.read_transformed(spark, out).count() == 6
    kept = {r.para_id: r.texte for r in table.read_table(spark, path).collect()}
    assert kept["11"] == "Encore."  # the last of a key wins
    before = sorted(map(str, table.read_table(spark, path).drop("extraction_timestamp").collect()))
    ingest.ingest_years(scan, path, [2018, 2019])
    after = sorted(map(str, table.read_table(spark, path).drop("extraction_timestamp").collect()))
    assert before == after


def test_stream_loads_each_archive_once(spark, root, tmp_path):
    path, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    ingest_available(spark, str(root), path, mark).awaitTermination()
    assert table.read_table(spark, path).count() == 4
    status = {r.filename[-11:-4]: (r.status, r.error_message) for r in spark.read.parquet(f"{path}_status").collect()}
    assert status["2018083"] == ("success", None) and status["2019001"][0] == "success"
    assert all(status[f"201900{i}"][0] == "failed" and status[f"201900{i}"][1] for i in (2, 3, 4, 5))
    ingest_available(spark, str(root), path, mark).awaitTermination()
    assert table.read_table(spark, path).count() == 4


def test_stored_issues_are_told_apart(spark):
    names = ["a/AN_2019100.taz", "a/AN_20191001.taz", "a/AN_2018100.taz", "a/other.taz"]
    listed = ingest.named(spark.createDataFrame([(n,) for n in names], "path string"))
    held = spark.createDataFrame([(2019, 100), (2019, 100), (None, 100)], "annee int, publication_numero int")
    new = {r.path: r.new for r in ingest.mark_new(listed, held).collect()}
    assert new == dict(zip(names, (False, True, True, True)))


def test_upsert_moves_a_row_between_years(spark, tmp_path):
    path = str(tmp_path / "t")
    blank = {f.name: None for f in INTERVENTIONS.fields}

    def batch(*rows):
        return spark.createDataFrame(
            [{**blank, "para_id": k, "annee": y, "texte": t, "ordinal": o} for k, y, t, o in rows],
            INTERVENTIONS,
        )

    table.upsert_by_key(batch(("a", 2018, "x", 1), ("b", 2019, "y", 2), (None, 2019, "z", 3)), path, "para_id", ["ordinal"])
    table.upsert_by_key(batch(("a", 2020, "moved", 1), ("", 2019, "w", 2), ("a", 2020, "last", 3)), path, "para_id", ["ordinal"])
    got = rows_by(table.read_table(spark, path).withColumn("k", F.coalesce("para_id", F.lit("?"))), "k", "annee", "texte")
    assert got == [("", 2019, "w"), ("?", 2019, "z"), ("a", 2020, "last"), ("b", 2019, "y")]
    table.insert_if_absent(batch(("a", 2020, "no", 1), ("c", 2020, "first", 1), ("c", 2020, "second", 2)), path, "para_id", ["ordinal"])
    got = rows_by(table.read_table(spark, path).where("annee = 2020"), "para_id", "texte")
    assert got == [("a", "last"), ("c", "first")]


def stored_files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def version_batch(spark, *rows):
    blank = {f.name: None for f in INTERVENTIONS.fields}
    return spark.createDataFrame([{**blank, "para_id": k, "annee": y, "texte": t, "ordinal": 1} for k, y, t in rows], INTERVENTIONS)


@pytest.mark.parametrize("load", [table.insert_if_absent, table.upsert_by_key])
@pytest.mark.parametrize("step", ["rename", "write_bytes", "write"])
def test_a_failed_load_leaves_the_table_whole(spark, tmp_path, monkeypatch, load, step):
    path = str(tmp_path / "t")
    table.upsert_by_key(version_batch(spark, ("a", 2018, "x"), ("b", 2019, "y")), path, "para_id", ["ordinal"])
    before, reader = stored_files(path), table.read_table(spark, path)
    batch = version_batch(spark, ("a", 2018, "new"), ("c", 2019, "z"), ("d", None, "w"))

    def fail(*_):
        raise OSError("lost")

    if step == "write":  # a task fails after others have written
        batch = batch.withColumn("texte", F.when(F.col("para_id") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("texte")))
    else:
        monkeypatch.setattr(storage, step, fail)
    with pytest.raises(Exception, match="lost"):
        load(batch, path, "para_id", ["ordinal"])
    monkeypatch.undo()
    kept = rows_by(table.read_table(spark, path), "para_id", "texte")
    assert kept == [("a", "x"), ("b", "y")] == rows_by(reader, "para_id", "texte")
    assert [f for f in stored_files(path) if f.endswith((".parquet", ".json"))] == [
        f for f in before if f.endswith((".parquet", ".json"))]


def test_readers_stay_on_their_version(spark, tmp_path):
    path = str(tmp_path / "t")
    table.insert_if_absent(version_batch(spark, ("a", 2018, "x")), path, "para_id", ["ordinal"])
    first = table.read_table(spark, path)
    table.upsert_by_key(version_batch(spark, ("a", 2020, "y")), path, "para_id", ["ordinal"])
    assert rows_by(first, "annee", "texte") == [(2018, "x")]
    assert rows_by(table.read_table(spark, path), "annee", "texte") == [(2020, "y")]
    assert rows_by(table.read_table(spark, path, version=1), "texte") == [("x",)]
    for n in range(table.KEPT_VERSIONS + 1):
        table.upsert_by_key(version_batch(spark, ("a", 2020, f"y{n}")), path, "para_id", ["ordinal"])
    assert len(table.versions(path)) == table.KEPT_VERSIONS
    # only the rows of kept versions are on disk
    assert len([f for f in stored_files(path) if f.endswith(".parquet")]) == table.KEPT_VERSIONS
    assert table.read_table(spark, path).count() == 1


def test_a_commit_on_an_old_version_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    table.create_table(spark, path)
    with pytest.raises(table.ConcurrentLoad):
        table.commit(path, 0, [])
    with pytest.raises(FileNotFoundError):
        table.read_table(spark, str(tmp_path / "none"))
    assert table.read_table(spark, path).count() == 0


def test_many_small_inserts_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "MOST_FOLDERS", 3)
    path = str(tmp_path / "t")
    for n in range(6):
        load = table.insert_if_absent(version_batch(spark, (f"k{n}", 2018, "x")), path, "para_id", ["ordinal"])
    assert len(table.folders_of(path)[1]) <= 4 and table.read_table(spark, path).count() == 6
    assert table.read_load(spark, path, load).count() >= 1


def test_loads_leave_no_scratch_copies(spark, root, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(storage.names_in(f"{shared}/hemicycle"))
    ingest.ingest_incremental(str(root), str(tmp_path / "t"))
    ingest.ingest_years(str(root), str(tmp_path / "t"), [2018])
    assert set(storage.names_in(f"{shared}/hemicycle")) == before


def test_python_workers_hold_a_bounded_number_of_bytes(spark):
    """Rows of long texts reach a worker a few MB at a time, and archives leave it a few at a time."""
    assert session.prepare(spark) is spark
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1000).alias("x"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 29_000_000 and max(got) < 9_000_000
    files = pd.DataFrame({"path": [f"p{i}" for i in range(40)], "xml": ["<P/>"] * 40})
    made = list(mapping._taz(iter([files])))
    assert max(map(len, made)) <= mapping.FILES_AT_ONCE and pd.concat(made)["path"].tolist() == files["path"].tolist()
