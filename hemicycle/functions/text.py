"""Text helpers: cleaning, speakers, tokens, excerpts. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode \s leaves out the four ASCII separators that Python counts as blank.
_BLANK = r"(?U)[\s\x1c-\x1f]"
# The characters Python strips from both ends of a text.
STRIPPED = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Generic speaker opening, and the title dropped from a speaker name.
GENERIC_OPENING = r"^(M\.|Mme|Mlle)\.?\s+[^.]+\.\s*"
NAME_TITLE = r"^(M\.|Mme)\s*"

# Substring of the lower-cased name -> role, first match wins.
ROLES = (("président", "Président"), ("ministre", "Ministre"), ("secrétaire", "Secrétaire"))
DEFAULT_ROLE = "Député"

DEFAULT_FAMILY = "Non inscrit"


def strip(text: Column) -> Column:
    """Drop Unicode blanks at both ends (by default Spark's trim only knows the space)."""
    return F.trim(text, F.lit(STRIPPED))


def clean_text(text: Column) -> Column:
    """One space for every run of blanks, none at the ends, '' for NULL."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK + "+", " "))


def is_blank(text: Column) -> Column:
    """NULL, empty or only blanks."""
    return text.isNull() | (strip(text) == "")


def strip_speaker_prefix(
    text: Column, name: Column, generic: bool = True, strip_first: bool = True
) -> Column:
    """Remove the speaker's name, then a generic title opening, from the text start.

    ``strip_first`` lets the name be found in indented text as well.
    """
    body = F.coalesce(text, F.lit(""))
    if strip_first:
        body = strip(body)
    named = name.isNotNull() & (name != "") & (
        F.lower(F.left(body, F.length(name))) == F.lower(name)
    )
    rest = F.substring(body, F.length(name) + 1, F.length(body))
    dotless = F.when(rest.startswith("."), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    body = F.when(named, F.ltrim(dotless, F.lit(STRIPPED))).otherwise(body)
    if generic:
        opened = F.regexp_replace(body, "(?U)" + GENERIC_OPENING, "")
        # texts that cannot match skip the pattern
        body = F.when(body.startswith("M"), opened).otherwise(body)
    return strip(body)


def clean_speaker(name: Column) -> Column:
    """Name without leading title and without trailing dots and commas."""
    untitled = F.regexp_replace(strip(name), "(?U)" + NAME_TITLE, "")
    return F.regexp_replace(untitled, r"(?U)(?:\s*[.,])+$", "")


def classify_role(name: Column) -> Column:
    """Role read off the speaker's name; NULL without a name."""
    low = F.lower(name)
    role = F.when(name.isNull() | (name == ""), F.lit(None).cast("string"))
    for part, label in ROLES:
        role = role.when(low.contains(part), label)
    return role.otherwise(DEFAULT_ROLE)


def tokenize(text: Column) -> Column:
    """Lower-case words; everything but letters, digits, '_' and blanks is deleted."""
    kept = F.regexp_replace(
        F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", ""
    )
    return F.array_remove(F.split(kept, _BLANK + "+"), "")


def word_count_ws(text: Column) -> Column:
    """Words between blanks; 0 for NULL."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANK + "+"), "")
    return F.size(words).cast("long")


def word_count_space(text: Column) -> Column:
    """Pieces between single spaces, empty pieces included."""
    return F.size(F.split(text, " ")).cast("long")


def text_length(text: Column) -> Column:
    return F.length(text).cast("long")


def kwic_excerpt(text: Column, word: str, before: int = 50, after: int = 100) -> Column:
    """Excerpt round the first case-insensitive hit, in dots; NULL without a hit."""
    hit = F.locate(word.lower(), F.lower(text)) - 1
    start = F.greatest(hit - before, F.lit(0))
    end = F.least(hit + after, F.length(text))
    excerpt = F.substring(text, start + 1, end - start)
    return F.when(hit >= 0, F.concat(F.lit("..."), excerpt, F.lit("...")))


def preview(text: Column, n: int = 100) -> Column:
    return F.concat(F.left(text, F.lit(n)), F.lit("..."))


def full_name(first: Column, last: Column) -> Column:
    empty = F.lit("")
    return strip(F.concat(F.coalesce(first, empty), F.lit(" "), F.coalesce(last, empty)))


def default_family(family: Column, default: str = DEFAULT_FAMILY) -> Column:
    return F.coalesce(family, F.lit(default))


def normalise_for_compare(a: Column, b: Column) -> Column:
    """Equal once blanks are collapsed."""
    return clean_text(a) == clean_text(b)


def digest(*columns: Column) -> Column:
    """32-byte key standing for long or composite values in a shuffle (NULL-safe)."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def json_list_test(json_text: Column) -> Column:
    """True when the JSON value is an array; NULL for NULL or invalid JSON."""
    return F.startswith(F.schema_of_variant(F.try_parse_json(json_text)), F.lit("ARRAY"))
