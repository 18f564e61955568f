"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


INTERVENTIONS = _struct(
    ("para_id", _S),
    ("section_id", _S),
    ("section_titre", _S),
    ("sous_section_titre", _S),
    ("orateur_nom", _S),
    ("orateur_fonction", _S),
    ("texte", _S),
    ("vote_present", T.BooleanType()),
    ("nombre_votants", _I),
    ("nombre_suffrages_exprimes", _I),
    ("votes_pour", _I),
    ("votes_contre", _I),
    ("publication_numero", _I),
    ("date_parution", T.DateType()),
    ("date_seance", T.DateType()),
    ("annee", _I),
    ("mois", _I),
    ("session_nom", _S),
    ("session_parlementaire", _S),
    ("legislature", _I),
    ("numero_premiere_page", _I),
    ("extraction_timestamp", T.TimestampType()),
    ("source_file", _S),
    ("ordinal", _L),
)

REQUIRED_FIELDS = (
    "date_seance", "texte", "section_id", "para_id",
    "legislature", "publication_numero", "orateur_nom",
)

CLASSES = ("very_negative", "negative", "neutral", "positive", "very_positive")

SENTIMENTS = _struct(("para_id", _S), *((c, _D) for c in CLASSES))

DEPUTES = _struct(("prenom", _S), ("nom", _S), ("groupe", _S), ("legislatureLast", _I))

EMBEDDINGS = _struct(("para_id", _S), ("texte_embedding", T.ArrayType(T.FloatType())))

TRANSFORMED = _struct(
    ("fonction", _S), ("para_id", _S), ("orateur_nom", _S), ("texte", _S),
    ("section_titre", _S), ("sous_section_titre", _S), ("section_id", _S),
)

FILE_STATS = _struct(
    ("filename", _S), ("status", _S), ("documents_count", _L),
    ("duration_seconds", _D), ("error_message", _S), ("year", _I),
)

RUN_REPORT = _struct(
    ("start_time", T.TimestampType()),
    ("end_time", T.TimestampType()),
    ("duration_seconds", _D),
    ("statistics", _struct(
        ("total", _L), ("success", _L), ("failed", _L), ("skipped", _L), ("documents_indexed", _L),
    )),
    ("run_id", _S),
)

# Failed files of a run, one row each: a run can fail on any number of files.
RUN_ERRORS = _struct(("run_id", _S), ("file", _S), ("error", _S))

# What the archive job emits: one row per element of interest.
ELEMENTS = _struct(
    ("source_file", _S),
    ("xml_name", _S),
    ("kind", _S),
    ("ordinal", _L),
    ("tag", _S),
    ("ident", _S),
    ("idsyceron", _S),
    ("section_seq", _I),
    ("section_id", _S),
    ("section_titre", _S),
    ("sub_kind", _I),
    ("sub_seq", _I),
    ("sub_titre", _S),
    ("level", _I),
    ("name", _S),
    ("text", _S),
    ("meta", T.MapType(_S, _S)),
    ("vote", T.MapType(_S, _S)),
    ("error", _S),
)

# What the transcript source emits: the runs of a file (``parts`` in order), then its status.
# The three file columns are read off the name and can be filtered before a file is opened.
RUNS = _struct(
    ("source_file", _S),
    ("file_year", _S),
    ("issue_year", _I),
    ("issue_number", _I),
    ("xml_name", _S),
    ("kind", _S),
    ("ordinal", _L),
    ("para_id", _S),
    ("section_id", _S),
    ("section_titre", _S),
    ("sous_section_titre", _S),
    ("orateur_nom", _S),
    ("parts", T.ArrayType(_S)),
    ("meta", T.MapType(_S, _S)),
    ("vote", T.MapType(_S, _S)),
    ("error", _S),
    ("seconds", _D),
    ("rows", _L),
)
