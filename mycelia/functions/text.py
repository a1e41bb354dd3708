"""Text predicates and the question's intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Opening words of each intent, in the order in which they are tried. Fixed values.
INTENTS = (
    ("causal", ("почему", "причина", "следствие")),
    ("procedural", ("как", "способ", "инструкция")),
    ("definitional", ("что такое", "кто такой", "определение")),
    ("factual", ("кто", "что", "где", "когда", "какой")),
)
DEFAULT_INTENT = "definitional"

#: Words that anchor nothing: a stand-in for a tagger's stop words.
STOP_WORDS = (
    "the", "of", "and", "is", "are", "was", "what", "why", "how", "does", "which", "who", "where", "when", "with", "for", "from", "that", "this",
    "что", "такое", "как", "какой", "какая", "будет", "где", "почему", "кто", "для", "при", "это", "или",
)
SHORTEST_ANCHOR = 3


def not_blank(text: Column) -> Column:
    """Whether a text holds anything but white space of any kind; null is blank."""
    return F.coalesce(text.rlike("[^\\s\\p{Z}]"), F.lit(False))


def intent(query: Column) -> Column:
    """The first intent one of whose openings starts the lower-case query; leading blanks are not skipped, null gives the default."""
    lower = F.lower(query)
    case = None
    for name, openings in INTENTS:
        hit = None
        for o in openings:
            hit = lower.startswith(o) if hit is None else hit | lower.startswith(o)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise(DEFAULT_INTENT)


def suffix(path: Column) -> Column:
    """The suffix of a path's last part in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, "[^/](\\.[^./]+)$", 1))


def question_words(query: Column) -> Column:
    """Distinct words of a question that may anchor it."""
    words = F.split(F.lower(query), "[^\\p{L}\\p{M}\\p{N}’'-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= SHORTEST_ANCHOR) & ~w.isin(list(STOP_WORDS))))
