"""Regular expressions for taxonomy terms, as text and as column expressions.

Word characters are Unicode letters, digits and the underscore, written out so that boundaries do
not depend on the runtime's idea of ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
START = rf"(?<!{WORD})"
END = rf"(?!{WORD})"

# ---------------------------------------------------------------------------------------------
# Terms with a pattern of their own. Matches must equal those of existing runs.
# ---------------------------------------------------------------------------------------------
SPECIAL_TERMS = {
    "C++": r"(?<![a-zA-Z])C\+\+(?![a-zA-Z])",
    "C#": r"(?<![a-zA-Z])C#(?![a-zA-Z])",
    ".NET": r"(?<![a-zA-Z])\.NET(?![a-zA-Z0-9])",
    "Node.js": rf"{START}Node\.?js{END}",
    "Vue.js": rf"{START}Vue\.?js{END}",
    "Next.js": rf"{START}Next\.?js{END}",
    "Nuxt.js": rf"{START}Nuxt\.?js{END}",
    "D3.js": rf"{START}D3\.?js{END}",
    "Three.js": rf"{START}Three\.?js{END}",
}
# The older rule knows three of them and lets a digit follow.
BASIC_TERMS = {
    "C++": r"(?<![a-zA-Z])C\+\+(?![a-zA-Z])",
    "C#": r"(?<![a-zA-Z])C#(?![a-zA-Z])",
    ".NET": r"(?<![a-zA-Z])\.NET(?![a-zA-Z])",
}
# Text that looks like a technical term: CamelCase, CAPITALS, letters with digits, hyphenated. No part can give back
# letters and match, as a word character would follow, so none tries to.
POTENTIAL_TERM = r"(?:[A-Z][a-z]++[A-Z][a-z]*+|[A-Z]{2,}+|[a-zA-Z]++(?:\p{Nd}++|-[a-zA-Z]++))"
# ---------------------------------------------------------------------------------------------

IGNORE_CASE = "(?iu)"


def special_terms(special: str) -> dict[str, str]:
    return {"full": SPECIAL_TERMS, "basic": BASIC_TERMS}[special]


def quoted(term: Column) -> Column:
    """The term as a literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _edges(term: Column, strict: bool) -> tuple[Column, Column]:
    """Tests for the characters before and after a term, as look-around openings."""
    if not strict:
        return F.lit("(?<!"), F.lit("(?!")
    before = F.when(F.rlike(term, F.lit(rf"^{WORD}")), "(?<!").otherwise("(?<=")
    after = F.when(F.rlike(term, F.lit(rf"{WORD}$")), "(?!").otherwise("(?=")
    return before, after


def term_pattern(term: Column, *, special: str = "full", strict: bool = False) -> Column:
    """Pattern that finds a term between word boundaries, whatever the case.

    A term edge that is itself a symbol (``F#``) has no word boundary after it unless a word
    character follows. ``strict=True`` keeps that behaviour; by default such an edge only must not
    touch a word character.
    """
    before, after = _edges(term, strict)
    pattern = F.concat(before, F.lit(f"{WORD})"), quoted(term), after, F.lit(f"{WORD})"))
    return F.concat(F.lit(IGNORE_CASE), _own(term, special, pattern))


def _own(term: Column, special: str, pattern: Column) -> Column:
    for text, own in special_terms(special).items():
        pattern = F.when(term == text, F.lit(own)).otherwise(pattern)
    return pattern


def _extract(text: Column, ascii_pattern: str, pattern: str) -> Column:
    """All matches. Text of one byte per character takes a pattern that is quicker to test."""
    one_byte = F.octet_length(text) == F.length(text)
    quick = F.regexp_extract_all(text, F.lit(ascii_pattern), F.lit(0))
    return F.when(one_byte, quick).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def segments(text: Column) -> Column:
    """A text as its words and what stands between them, in turn; joined they are the text.

    One pattern for all texts: Java tests its classes quicker than those written out for ASCII.
    """
    return F.regexp_extract_all(text, F.lit(rf"{WORD}++|[^\p{{L}}\p{{N}}_]++"), F.lit(0))


def potential_terms(text: Column) -> Column:
    return _extract(text, rf"\b{POTENTIAL_TERM}\b", f"{START}{POTENTIAL_TERM}{END}")
