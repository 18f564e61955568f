"""The interventions of one transcript, closed while its XML is read.

A pull parser hands out elements as they end. Paragraphs become plain rows at once and lose
their elements; a section's rows wait for its end, because its title, its vote and whether it
has subsections may come late; then its runs of one id are joined and its tree is dropped.
So memory is the tree of one section, and the rows of the file: they leave when the file has
been read to its end, so that a broken file adds none.
"""

from __future__ import annotations

import tarfile
import time
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

CHUNK = 1 << 16

# Metadata elements read from the first metadata block, and vote counters.
META_FIELDS = (
    "PublicationNumero", "DateParution", "DateSeance", "SessionNom",
    "SessionParlementaire", "LegislatureNumero", "NumeroPremierePage",
)
VOTE_FIELDS = {
    "nombre_votants": "NombreVotants",
    "nombre_suffrages_exprimes": "NombreSuffrageExprime",
    "votes_pour": "Pour",
    "votes_contre": "Contre",
}


def element_text(elem: ET.Element) -> str:
    """All text below an element in document order, pieces joined by one space.

    An element with nothing inside stands for one empty piece. Elements still to be read
    wait on a list of their own, so depth is not limited.
    """
    pieces: list[str] = []
    waiting: list[ET.Element | str] = [elem]
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        inside: list[ET.Element | str] = [item.text] if item.text else []
        for child in item:
            inside.append(child)
            if child.tail:
                inside.append(child.tail)
        if inside:
            waiting.extend(reversed(inside))
        else:
            pieces.append("")
    return " ".join(pieces)


def title_of(heading: ET.Element | None) -> str | None:
    label = None if heading is None else heading.find(".//Intitule")
    return None if label is None else " ".join(element_text(label).split())


def vote_counts(result: ET.Element) -> list[tuple[str, str]]:
    found = {n: result.find(f".//{tag}/Valeur") for n, tag in VOTE_FIELDS.items()}
    return [(n, e.text or "") for n, e in found.items() if e is not None]


def speaker_of(para: ET.Element) -> str | None:
    speaker = para.find(".//Orateur")
    name = None if speaker is None else speaker.find("Nom")
    return None if name is None else " ".join((name.text or "").split())


def meta_pairs(block: ET.Element) -> list[tuple[str, str]]:
    found = {f: block.find(f) for f in META_FIELDS}
    return [(f, e.text) for f, e in found.items() if e is not None and e.text is not None]


@dataclass
class Para:
    at: int
    ident: str | None
    name: str | None
    text: str


@dataclass
class Subsection:
    kind: int
    at: int
    titled: bool = False
    title: str | None = None
    paras: list[Para] = field(default_factory=list)


@dataclass
class Section:
    number: int
    titled: bool = False
    ident: str | None = None
    title: str | None = None
    voted: bool = False
    vote: list[tuple[str, str]] | None = None
    direct: list[Para] = field(default_factory=list)
    subs: list[Subsection] = field(default_factory=list)
    deep: list[Para] = field(default_factory=list)


def runs(paras: list[Para], first_ordinal: int, **place: object) -> Iterator[dict]:
    """One row per run of consecutive paragraphs of one id; those without an id break none."""
    now: dict | None = None
    for n, para in enumerate(paras):
        if para.ident is None:
            continue
        if now is None or now["para_id"] != para.ident:
            if now is not None:
                yield now
            now = {"kind": "run", "para_id": para.ident, "ordinal": first_ordinal + n, "orateur_nom": para.name,
                   "parts": [], **place}
        now["parts"].append(para.text)
    if now is not None:
        yield now


class Reader:
    """Follows start and end of elements; ``rows`` fills as sections end."""

    def __init__(self, keep_all: bool = False):
        self.keep_all = keep_all
        self.roles: list[str] = []
        self.meta: list[tuple[str, str]] | None = None
        self.meta_seen = self.in_body = False
        self.section: Section | None = None
        self.sections, self.started = 0, 0
        self.before: list[Para] = []  # paragraphs before any section
        self.open_paras: list[tuple[int, list[Para] | None]] = []
        self.kept_trees = 0  # headings and votes being read: their trees are still needed
        self.rows: list[dict] = []

    def start(self, elem: ET.Element) -> None:
        self.roles.append(self.role(elem, self.roles[-1] if self.roles else None))

    def role(self, elem: ET.Element, parent: str | None) -> str:
        tag = elem.tag
        if parent is None:
            return "root"
        if tag == "Metadonnees" and not self.meta_seen:
            self.meta_seen = True
            return "meta"
        if not self.in_body:
            if tag == "Contenu" and parent == "report":
                self.in_body = True
                return "body"
            return "report" if tag == "CompteRendu" else ""
        if tag == "Section" and parent == "body":
            self.section = Section(self.sections)
            self.sections += 1
            return "section"
        if tag == "Para":
            self.open_paras.append((self.started, self.home(parent)))
            self.started += 1
            return "para"
        if self.section is None:
            return ""
        if tag in ("SousSection1", "SousSection2") and parent == "section":
            self.section.subs.append(Subsection(int(tag[-1]), self.started))
            self.started += 1
            return "sub"
        if tag == "TitreStruct" and parent in ("section", "sub"):
            owner = self.section if parent == "section" else self.section.subs[-1]
            if not owner.titled:
                owner.titled = True
                self.kept_trees += 1
                return f"{parent} heading"
        if tag == "ResultatVote" and not self.section.voted:
            self.section.voted = True
            self.kept_trees += 1
            return "vote"
        return ""

    def home(self, parent: str) -> list[Para] | None:
        """The list that a paragraph under this parent belongs to."""
        if parent == "body":
            return self.before
        if self.section is None:
            return None
        if parent == "section":
            return self.section.direct
        return self.section.subs[-1].paras if parent == "sub" else self.section.deep

    def end(self, elem: ET.Element) -> None:
        role = self.roles.pop()
        if role == "para":
            at, home = self.open_paras.pop()
            if home is not None:
                home.append(Para(at, elem.get("idsyceron"), speaker_of(elem), element_text(elem)))
            if not self.open_paras and not self.kept_trees:
                elem.clear()
        elif role == "section heading":
            self.section.ident, self.section.title = elem.get("Ident", ""), title_of(elem)
            self.kept_trees -= 1
        elif role == "sub heading":
            self.section.subs[-1].title = title_of(elem)
            self.kept_trees -= 1
        elif role == "vote":
            self.section.vote = vote_counts(elem)
            self.kept_trees -= 1
        elif role == "section":
            self.rows.extend(self.rows_of(self.section))
            self.section = None
        elif role == "meta":
            self.meta = meta_pairs(elem)
        elif role == "body":
            self.in_body = False
        if self.roles and self.roles[-1] == "body":
            elem.clear()

    def rows_of(self, section: Section) -> Iterator[dict]:
        """Direct paragraphs, then subsections of either kind, then what is nested deeper. A
        section with subsections keeps only their paragraphs, unless all are kept."""
        place = {"section_id": section.ident, "section_titre": section.title, "vote": section.vote}
        groups = []
        if self.keep_all or not section.subs:
            groups.append((section.direct, None))
        groups += [(s.paras, s.title) for s in sorted(section.subs, key=lambda s: (s.kind, s.at))]
        if self.keep_all:
            groups.append((sorted(section.deep, key=lambda p: p.at), None))
        at = (section.number + 1) << 32
        for paras, title in groups:
            yield from runs(paras, at, sous_section_titre=title, **place)
            at += len(paras)

    def finished(self) -> list[dict]:
        if self.keep_all:
            self.rows = [*runs(self.before, 0), *self.rows]
        for row in self.rows:
            row["meta"] = self.meta or []
        return self.rows


def read_runs(chunks: Iterator[bytes], keep_all: bool = False) -> list[dict]:
    parser, reader = ET.XMLPullParser(("start", "end")), Reader(keep_all)
    follow = {"start": reader.start, "end": reader.end}
    for chunk in chunks:
        parser.feed(chunk)
        for event, elem in parser.read_events():
            follow[event](elem)
    parser.close()
    for event, elem in parser.read_events():
        follow[event](elem)
    return reader.finished()


def pieces(file: BinaryIO) -> Iterator[bytes]:
    while data := file.read(CHUNK):
        yield data


def open_transcript(file: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    """Name and stream of the transcript in an archive, which is read once from front to end."""
    with tarfile.open(fileobj=file, mode="r|*") as outer:
        inner = next((m for m in outer if m.name.endswith(".tar")), None)
        if inner is None:
            raise ValueError("no inner tar")
        with tarfile.open(fileobj=outer.extractfile(inner), mode="r|") as tar:
            for member in tar:
                if member.name.startswith("CRI_") and member.name.endswith(".xml"):
                    yield member.name, tar.extractfile(member)
                    return
    raise ValueError("no CRI_*.xml in the inner tar")


def file_rows(path: str, opened, keep_all: bool = False) -> list[dict]:
    """Runs of one archive and, last, its status: seconds, rows, and the error if it is broken.

    ``opened()`` gives the archive's stream.
    """
    begin, xml_name, rows, error = time.perf_counter(), None, [], None
    try:
        with opened() as file:
            for xml_name, xml in open_transcript(file):
                rows = read_runs(pieces(xml), keep_all)
    except Exception as problem:  # a bad file is a row, not a failed job
        rows, error = [], f"{type(problem).__name__}: {problem}"
    for row in rows:
        row["source_file"], row["xml_name"] = path, xml_name
    status = {"source_file": path, "xml_name": xml_name, "kind": "file", "ordinal": -1, "rows": len(rows),
              "error": error, "seconds": time.perf_counter() - begin}
    return [*rows, status]
