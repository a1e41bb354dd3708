"""Dependency labels and their codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels in the order of their codes, from 0. Fixed values; the last four exist as codes but no parse label maps to them.
LABELS = (
    "UNKNOWN", "ROOT", "nsubj", "dobj", "iobj", "csubj", "ccomp", "xcomp", "obl", "vocative", "expl", "dislocated",
    "nmod", "appos", "nummod", "advcl", "advmod", "discourse", "compound", "fixed", "flat", "goeswith", "case", "acl",
    "amod", "aux", "cop", "conj", "cc", "det", "mark", "punct", "agent", "attr", "dative", "oprd", "predet", "prep",
    "nsubjpass", "csubjpass", "relcl", "prt", "intj", "meta", "neg", "poss", "pcomp", "quantmod",
    "math_equals", "math_operand", "logic_causes", "logic_implies",
)
PARSED = 48


def label_to_code(label: Column) -> Column:
    """The code of a label; unknown, wrongly cased and null labels give 0. Letters count exactly."""
    codes = F.create_map(*[x for i, name in enumerate(LABELS[:PARSED]) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(F.try_element_at(codes, label), F.lit(0))


def code_to_label(code: Column) -> Column:
    """The label of a code that a parse can give; any other is ``UNKNOWN``."""
    names = F.array(*[F.lit(x) for x in LABELS[:PARSED]])
    return F.when(code.between(0, PARSED - 1), F.get(names, code)).otherwise("UNKNOWN")
