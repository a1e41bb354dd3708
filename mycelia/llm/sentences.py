"""Sentence units across languages and scripts, in SQL expressions over whole columns.

Every step replaces one character by one private-use character, so places in the text never move:

1. *mask* points that end no sentence: decimals, addresses, abbreviations, initials, list numbers, ordinals, ellipses in
   mid-sentence, terminators inside a quotation whose attribution follows;
2. *mark* ends with script-specific terminator patterns: points, exclamation and question marks and the
   danda before white space, ideographic full stops wherever they stand, white space between
   full clauses in Thai, empty lines in every script;
3. *split* at the marks; what the masks hide is restored by cutting the text itself at the same places.

Wrongly decoded text is split in its repaired form and the places are carried back to the stored text.

Defined results: null and blank texts have no unit; a text without a terminator is one unit; units hold
at least one letter or digit, other remnants join the unit before; a repeated record gives its rows once.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mycelia.llm.encoding import repaired_texts, sample_sentences

MASK, MARK, INSIDE = "\ue000", "\ue001", "\ue002"
#: What may stand before the first character of a unit.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u3000\ufeff"

#: Abbreviations before a name or word, never at the end of a sentence. Fixed values.
BEFORE_WORD = (
    "dr", "mr", "mrs", "ms", "prof", "st", "messrs", "e\\.g", "i\\.e", "cf", "viz", "sr", "sra", "dra", "srta", "mme", "mlle", "hr",
    "ej", "c\\.-à-d", "bzw", "vgl", "см", "проф", "акад", "им", "ул", "див", "ім", "вул", "напр", "डॉ", "प्रो", "श्री", "พ\\.ศ", "ค\\.ศ", "ดร",
)
#: Abbreviations before a number. Fixed values.
BEFORE_NUMBER = (
    "no", "nos", "fig", "figs", "eq", "eqs", "vs", "approx", "pp", "vol", "ch", "sec", "abb", "nr", "ca", "bd", "kap", "tab", "env", "éq", "art", "chap",
    "pág", "págs", "ec", "núm", "aprox", "cap", "рис", "табл", "стр", "гл", "ок", "прибл", "мал", "ст",
)
#: Abbreviations that end a sentence only if a capital follows. Fixed values.
MAY_END = ("inc", "ltd", "corp", "co", "jr", "a\\.m", "p\\.m", "uhr", "г", "гг", "р", "рр", "тыс", "млн")
#: Closing abbreviations of lists, which end a sentence unless a small letter follows in mixed-case text. Fixed values.
LIST_END = ("etc", "usw", "u\\. ?a", "т\\. ?д", "т\\. ?п", "ін")
#: German months, after which an ordinal's point ends nothing. Fixed values.
MONTHS = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")

_CLOSE = "[)\\]”\"“»’』」]"
_NOT_WORD = "(?<![\\p{L}\\p{M}\\p{N}])"
_STOP = "[.!?…।]"
_END = f"(?:{_STOP}|{_STOP}{_CLOSE}|{_STOP}{_CLOSE}{_CLOSE}|{_STOP}[\\s\\u00a0]»)"


def _any(words: tuple[str, ...]) -> str:
    both = {*words, *(unicodedata.normalize("NFD", w) for w in words)}  # letters may be stored decomposed
    return "(" + "|".join(sorted(both, key=lambda w: (-len(w), w))) + ")"


#: (pattern, replacement) in order; a dot that is masked keeps its place.
MASKS = (
    # points and commas of numbers, and of addresses
    ("[.,](?=\\p{N})(?<=\\p{N}[.,])", INSIDE),
    ("[.?!](?=[^\\s.?!])(?<=(?:https?://|www\\.)[^\\s]{1,200})", INSIDE),
    (f"(?iu){_NOT_WORD}{_any(BEFORE_WORD)}\\.(?=[\\s\\u00a0])", f"$1{MASK}"),
    (f"(?iu){_NOT_WORD}{_any(BEFORE_NUMBER)}\\.(?=[\\s\\u00a0]*\\p{{N}})", f"$1{MASK}"),
    (f"(?iu){_NOT_WORD}{_any(MAY_END)}\\.(?=[\\s\\u00a0]+(?-i:\\p{{Ll}}))", f"$1{MASK}"),
    # the first point of "т. д." is a single letter's; the last one stays
    ("(?iu)(?<![\\p{L}\\p{N}])(т)\\.(?= ?[деп]\\.)", f"$1{MASK}"),
    # single letters: initials and one-letter abbreviations, but not a unit after a number, nor the end of a list
    ("(?<![\\p{L}\\p{M}\\p{N}])(?<!\\p{N}[\\s\\u00a0])(?<!(?iu:т)\\ue000 ?)(\\p{L})\\.(?=[\\s\\u00a0])", f"$1{MASK}"),
    ("(?iu)(?<=т\\ue000 ?)(е)\\.", f"$1{MASK}"),
    # ordinals before a month
    (f"(?iu)(?<=\\p{{N}})\\.(?=[\\s\\u00a0]{_any(MONTHS)})", MASK),
    # ellipses in mid-sentence
    ("\\.(?=\\.{0,2}[\\s\\u00a0]\\p{Ll})(?<=\\.\\.)", MASK),
    ("\\.(?=\\.{1,2}[\\s\\u00a0\\ue000])|\\.(?=\\.\\ue000)", MASK),
    ("…(?=[\\s\\u00a0]*…*[\\s\\u00a0]*[\\p{Ll}])", MASK),
    # a quotation and its attribution: a small letter or a dash after the closing mark
    ("[.!?…](?=[\\s\\u00a0]?[”\"“»’』」][\\s\\u00a0]+[\\p{Ll}—–])", MASK),
    # the same in scripts without capitals: the quotation opens the unit
    ("(^|[\\s.!?…।。！？”」』）)\\ue000])([“「『\"][^“”「」『』\"]{1,400})[?!।。？！](?=[”」』\"][\\s\\u00a0]?\\p{Lo})", f"$1$2{MASK}"),
    ("[?!。？！](?=[」』][とっ、])", MASK),
    # numbers that open a list item
    ("([\\u0e01-\\u0e5b]\\s{1,3}\\p{N}{1,3})\\.(?=\\s)", f"$1{MASK}"),
    (f"(^|\\n|{_END}[\\s\\u00a0]{{1,3}})(\\s{{0,3}}\\p{{N}}{{1,3}})\\.(?=[\\s\\u00a0])", f"$1$2{MASK}"),
)
#: Ends of units: the matched character becomes the mark.
MARKS = (
    # an empty line
    "\\n(?=[^\\S\\n]*\\n)",
    # ideographic ends, with what closes them
    "(?:(?<=[。！？]|[。！？][”」』）])[”」』）]|[。！？])(?![”」』）])",
    # white space after an end; a French closing mark may stand off
    f"(?<={_END})[\\s\\u00a0](?![\\s\\u00a0]*[»])",
    # a missing blank between two sentences
    "(?<=[\\p{Ll}\\p{N})\\]][\\p{Ll}\\p{N})\\]])[.!?](?=\\p{Lu}[\\p{Ll}’' ])",
    "(?<=[\\p{Ll}\\p{M}\\p{Lo}])।(?=\\S)",
    # Thai: white space between clauses; numbers and abbreviations belong to theirs
    "(?<=[\\u0e01-\\u0e5b])\\s(?=\\s*\\p{N}{1,3}\\ue000)",
    "(?<=[\\u0e01-\\u0e5b])\\s(?=[\\s]*[\\u0e01-\\u0e5b](?![\\u0e01-\\u0e5b]{0,3}[.\\ue000]))",
    "(?<=[\\u0e01-\\u0e5b])\\s(?=[\\s]*[“«„\"¿¡(]?(?:\\p{Lu}|[\\u0900-\\u097f\\u3040-\\u30ff\\u4e00-\\u9fff]))",
)


def marked(text: Column) -> Column:
    """``text`` with masks and marks, character for character."""
    ends = f"(?iu){_NOT_WORD}({'|'.join(LIST_END)})\\.(?=[\\s\\u00a0]+(?-i:\\p{{Ll}}))"
    # conditions look at the stored column, so that no step is evaluated twice
    masked = F.when(F.lower(text) != text, F.regexp_replace(text, F.lit(ends), F.lit(f"$1{MASK}"))).otherwise(text)
    masked = reduce(lambda t, m: F.regexp_replace(t, *map(F.lit, m)), MASKS, masked)
    return reduce(lambda t, m: F.regexp_replace(t, F.lit(m), F.lit(MARK)), MARKS, masked)


def units(text: Column) -> Column:
    """``array<struct<start, size>>`` of the units of a text, in code points from 0."""
    parts = F.split(marked(text), MARK, -1)
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("out")),
        lambda acc, part: F.struct(
            (acc.at + F.length(part) + 1).alias("at"),
            F.when(
                part.rlike("[\\p{L}\\p{N}]"),
                F.concat(
                    acc.out,
                    F.array(
                        F.struct(
                            (acc.at + F.length(part) - F.length(F.ltrim(part, F.lit(BLANKS)))).alias("start"),
                            (F.length(F.ltrim(part, F.lit(BLANKS))) + 1).alias("size"),
                        )
                    ),
                ),
            )
            .otherwise(acc.out)
            .alias("out"),
        ),
        lambda acc: acc.out,
    )


def is_plain_text(path: Column) -> Column:
    """Records that come from neither a web page nor paged print, by the suffix of the path in any case."""
    return ~F.coalesce(path.rlike("(?i)\\.(html|pdf)\\z"), F.lit(False))


def sentence_units(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, start_pos, unit``: every sentence unit of the plain-text records, by its place in the stored text.

    Texts in which characters were replaced for good are left out.
    """
    rows = sentence_data.where(is_plain_text(F.col("file_path")) & F.col("text").rlike("\\S") & F.col("rec_id").isNotNull())
    rows = rows.select("rec_id", "text")
    # only text with a letter beyond ASCII, or a question mark that may stand for one, can be wrongly decoded and goes through Python
    doubtful = F.col("text").rlike("[^\\x00-\\x7f]|\\?")
    plain = rows.where(~doubtful).select("rec_id", F.col("text").alias("fixed"), F.lit(None).cast("array<int>").alias("places"))
    fixed = repaired_texts(rows.where(doubtful), sample_sentences(lang_sample)).where("state IS NULL OR state <> 'lost'")
    fixed = plain.unionByName(fixed.select("rec_id", "fixed", "places"))
    each = fixed.select("rec_id", "fixed", "places", F.explode(units(F.col("fixed"))).alias("u"))
    place = F.when(F.col("places").isNull(), F.col("u.start")).otherwise(F.get("places", F.col("u.start")))
    return each.select("rec_id", place.cast("int").alias("start_pos"), F.rtrim(F.substring("fixed", F.col("u.start") + 1, F.col("u.size"))).alias("unit"))


def sentence_starts(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, start_pos`` of every unit, once."""
    return sentence_units(sentence_data, lang_sample).select("rec_id", "start_pos").distinct()
