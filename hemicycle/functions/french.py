"""French analysed terms: elision, stop words, light stemming."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words elided before an apostrophe.
ELIDED = ("l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu")

# Stop words.
STOP_WORDS = (
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "en", "à", "au", "aux",
    "pour", "par", "sur", "dans", "avec", "sans", "est", "sont", "être", "avoir",
    "ce", "cette", "ces", "qui", "que", "dont", "où", "il", "elle", "on", "nous",
    "vous", "ils", "elles", "se", "sa", "son", "ses", "leur", "leurs", "je", "tu",
    "me", "te", "mon", "ma", "mes", "ton", "ta", "tes", "notre",
    "votre", "nos", "vos", "ne", "pas", "plus", "tout", "tous", "toute", "toutes",
    "peut", "fait", "faire", "très", "bien", "donc", "aussi", "mais", "ou", "si",
    "comme", "alors", "ici", "là", "encore", "même", "autre", "autres", "cela", "ceci",
)

# The light French stemmer of Savoy (SAC 2006) as groups of (ending, the word must
# be longer than, replacement). In a group the first match wins; a FINAL group's match goes
# straight to the normalisation, the others go on with the next group.
FINAL, ONWARD = True, False
STEPS = (
    (ONWARD, (("eaux", 5, "eau"), ("aux", 5, "al"), ("x", 5, ""))),
    (ONWARD, (("x", 3, ""),)),
    (ONWARD, (("s", 3, ""),)),
    (FINAL, (
        ("issement", 9, "ir"), ("issant", 8, "ir"), ("ivement", 7, "if"), ("ement", 6, "e"),
        ("ficatrice", 11, "fier"), ("ficateur", 10, "fier"), ("catrice", 9, "quer"), ("cateur", 8, "quer"),
        ("atrice", 8, "er"), ("ateur", 7, "er"),
    )),
    (ONWARD, (("trice", 6, "teur"),)),
    (FINAL, (
        ("ième", 5, ""), ("teuse", 7, "ter"), ("teur", 6, "ter"), ("euse", 5, "eu"), ("ère", 8, "er"),
        ("ive", 7, "if"), ("folle", 4, "fou"), ("molle", 4, "mou"), ("nnelle", 9, "n"), ("nnel", 9, "n"),
    )),
    (ONWARD, (("ète", 4, "et"),)),
    (ONWARD, (("ique", 8, ""),)),
    (FINAL, (
        ("esse", 8, "e"), ("inage", 7, "in"), ("ualisation", 12, "uel"), ("isation", 9, ""), ("isateur", 9, ""),
        ("ation", 8, ""), ("ition", 8, ""),
    )),
)
ACCENTS = ("àáâôèéêùûîç", "aaaoeeeuuic")
#: Words of up to this length are not normalised, nor are words cut below it.
SHORT = 4
TWINS = r"(\p{L})\1+"
LAST_TWINS = r"(\p{L})\1$"
TAIL = "e{0,2}r?$"


def light_stem(word: str) -> str:
    """Stem of one lower-cased word, for query words."""
    for final, rules in STEPS:
        for ending, length, replacement in rules:
            if len(word) > length and word.endswith(ending):
                word = word[: -len(ending)] + replacement
                if final:
                    return _normalised(word)
                break
    return _normalised(word)


def _normalised(word: str) -> str:
    letters = r"([^\W\d_])\1"
    if len(word) > SHORT:
        word = re.sub(letters + "+", r"\1", word.translate(str.maketrans(*ACCENTS)))
    if len(word) > SHORT and word.endswith("ie"):
        word = word[:-2]
    if len(word) > SHORT:
        word = re.sub(letters + "$", r"\1", re.sub(TAIL, "", word, count=1))
    return word


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although it is used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_match(word: Column, rules: tuple[tuple[str, int, str], ...]) -> Column:
    """The word with the first ending that fits replaced; NULL if none fits."""
    out = None
    for ending, length, replacement in rules:
        fits = (F.length(word) > length) & F.endswith(word, F.lit(ending))
        cut = F.concat(F.left(word, F.length(word) - len(ending)), F.lit(replacement))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out


def _stepped(word: Column, steps: tuple) -> Column:
    if not steps:
        return word
    (final, rules), rest = steps[0], steps[1:]
    matched = _first_match(word, rules)
    if final:
        return F.coalesce(matched, _stepped(word, rest))
    return _let(F.coalesce(matched, word), lambda w: _stepped(w, rest))


def stem(word: Column) -> Column:
    """Stem of a lower-cased word, as :func:`light_stem` gives it. Native."""
    def folded(w: Column) -> Column:
        plain = F.regexp_replace(F.translate(w, *ACCENTS), TWINS, "$1")
        return F.when(F.length(w) > SHORT, plain).otherwise(w)

    def shorn(w: Column) -> Column:
        return F.when((F.length(w) > SHORT) & F.endswith(w, F.lit("ie")), F.left(w, F.length(w) - 2)).otherwise(w)

    def trimmed(w: Column) -> Column:
        return F.when(F.length(w) > SHORT, F.regexp_replace(F.regexp_replace(w, TAIL, ""), LAST_TWINS, "$1")).otherwise(w)

    return _let(_let(_let(_stepped(word, STEPS), folded), shorn), trimmed)


def may_stem_to(term: str, between: str = "") -> str:
    """Pattern that every word of this stem begins with: a cheap test before stemming.

    A stem is the beginning of its words, but for accents, doubled letters and what a step put
    in place of an ending. ``between`` is allowed between any two letters.
    """
    variants = {plain: plain for plain in ACCENTS[1]}
    for accented, plain in zip(*ACCENTS):
        variants[plain] += accented

    def letters(start: str) -> list[str]:
        return [f"[{re.escape(variants.get(c, c))}]+" for c in start]

    starts = [letters(term)]
    replaced = [(old, new) for _, rules in STEPS for old, _, new in rules if new] + [("trice", "ter")]
    for old, new in replaced:
        for kept in range(1, len(new) + 1):
            if term.endswith(new[:kept]):
                # the letter before may have been the same as the first one put in, and gone with it
                twin = f"[{re.escape(variants.get(new[0], new[0]))}]*"
                starts.append([*letters(term[:-kept]), twin, *letters(old)])
    return "(?:" + "|".join(sorted({between.join(x) for x in starts})) + ")"


def may_begin_with(term: str) -> list[str]:
    """The letters that a word of this stem may begin with, under the same rules."""
    first = {term[0]} | {x[0] for _, rules in STEPS for old, _, new in [*rules, ("trice", 0, "ter")]
                         for kept in range(1, len(new) + 1) if term == new[:kept] for x in (old, new)}
    accented = {a for a, plain in zip(*ACCENTS) if plain in first}
    return sorted(first | accented)


def may_contain(stems: list[str]) -> str:
    """Pattern of the whole runs of letters, digits and apostrophes in a lower-cased text whose
    token may have one of the stems."""
    inside, sign = r"[\p{L}\p{N}'’]", "['’]"
    words = "|".join(may_stem_to(x, f"{sign}*") for x in stems)
    return f"(?<!{inside})(?:(?:{'|'.join(ELIDED)}){sign}+|{sign}+)?(?:{words}){inside}*"


def french_tokens(text: Column) -> Column:
    """Lower-case words in order after elision, stop words included. Native."""
    # elisions and apostrophes go from the whole text at once: two passes, none per word
    inside = r"[\p{L}\p{N}'’]"
    elision = f"(?<!{inside})(?:" + "|".join(ELIDED) + f")['’](?={inside})"
    low = F.lower(F.coalesce(text, F.lit("")))
    # only texts that have an apostrophe are looked through for one
    signed = F.contains(low, F.lit("'")) | F.contains(low, F.lit("’"))
    joined = F.when(signed, F.translate(F.regexp_replace(low, elision, ""), "'’", "")).otherwise(low)
    return F.array_remove(F.split(joined, r"[^\p{L}\p{N}]+"), "")


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, under the same rules."""
    inside = r"[^\W_]|['’]"
    elision = f"(?<!{inside[:6]})(?<!['’])(?:" + "|".join(ELIDED) + f")['’](?={inside})"
    joined = re.sub("['’]", "", re.sub(elision, "", query.lower()))
    return [w for w in re.split(r"[\W_]+", joined) if w]


def french_words(text: Column) -> Column:
    """Words after elision and stop words, before stemming. Native."""
    return F.filter(french_tokens(text), lambda w: ~w.isin(*STOP_WORDS))


def french_terms(text: Column) -> Column:
    """Stems of the words of a text, in order. Native; for whole tables,
    ``search.term_counts`` stems every distinct word once."""
    return F.transform(french_words(text), stem)
