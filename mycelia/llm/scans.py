"""Text of scanned pages: furniture, words divided by the layout and misread characters.

* *Furniture* is found per file: page numbers by their shape, running titles by recurring in the file
  or by standing beside a page number or the name of the source.
* *Breaks*: a line that ends in a hyphen is a break unless the corpus writes the compound with
  its hyphen. The continuation is the next line of the body, also on the next page.
* *Misread words*: a symmetric-delete index over the corpus frequency lexicon. Every word of a scan and every lexicon word
  at least ``RATIO`` times as frequent as any rare word can be is stored under all its deletes of up to two letters (one in a short word);
  words that share a delete are candidates. A weighted edit distance, in which confused glyph groups are cheap and any other edit is
  dear, and the context of the preceding word over all records score each candidate against the word as read; the best one wins.
  A word with a digit or foreign letter inside counts as unlikely to be meant as read; only if the index has nothing for it is it
  straightened glyph by glyph.

Wrong encodings are turned back first. Defined results: null and blank texts have no row; a repeated
record gives its rows once; a furniture line has no other kind.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mycelia.llm.encoding import repairer, sample_sentences
from mycelia.llm.pages import by_file, file_rows
from mycelia.session import cut_lineage

#: (printed, read as, weight) of the confusions of optical recognition. Fixed values.
CONFUSIONS = (
    ("e", "c", 1.0), ("i", "l", 1.0), ("l", "i", 1.2), ("o", "0", 0.5), ("s", "5", 0.5), ("l", "1", 0.5), ("i", "1", 0.6), ("d", "cl", 0.8), ("m", "rn", 0.8),
    ("h", "li", 0.8), ("u", "ii", 0.8), ("w", "vv", 0.8), ("n", "ri", 1.0), ("k", "lc", 1.0), ("g", "9", 0.5), ("q", "9", 0.8), ("é", "6", 0.5), ("b", "6", 0.6),
    ("b", "8", 0.5), ("f", "ſ", 0.5), ("t", "†", 0.5), ("a", "@", 0.5), ("z", "2", 0.6), ("ä", "a", 1.2), ("ö", "o", 1.2), ("ü", "u", 1.2), ("ß", "b", 1.2),
    ("а", "a", 0.5), ("е", "e", 0.5), ("о", "o", 0.5), ("о", "0", 0.5), ("р", "p", 0.5), ("с", "c", 0.5), ("у", "y", 0.5), ("х", "x", 0.5), ("і", "i", 0.5),
    ("т", "m", 0.5), ("к", "k", 0.6), ("и", "u", 0.6), ("з", "3", 0.5), ("б", "6", 0.5), ("ч", "4", 0.6), ("и", "н", 1.0), ("н", "п", 1.0), ("л", "п", 1.0),
    ("ш", "щ", 1.0), ("ы", "ьі", 0.8), ("ы", "ьi", 0.8), ("ы", "ы", 9.0), ("ю", "іо", 0.8), ("ж", "зк", 1.2), ("п", "н", 1.2), ("щ", "ш", 1.2), ("й", "и", 1.2), ("ё", "е", 2.0),
)
_BY_READ: dict[str, list[tuple[str, float]]] = {}
for _p, _r, _w in CONFUSIONS:
    if _p != _r and _w < 2:
        _BY_READ.setdefault(_r, []).append((_p, _w))
LOST_ACCENT = 1.2
WEIGHTS = {(p, r): w for p, r, w in CONFUSIONS}

#: A repair is so many times as frequent as what it replaces.
RATIO = 8
#: The weight of an edit that is no known confusion, the most edits of a word, the length from
#: which a word is stored under deletes of two letters, and the length below which unknown edits weigh more.
OTHER, EDITS, LONG, SHORT = 3.0, 2, 5, 6
#: What a unit of edit weight costs, what the preceding word is worth, and how unlikely a word with a sign or digit inside is meant as read.
COST, CONTEXT, ODD = 2.0, 1.0, 4.0

_TOKEN = re.compile(r"[^\W_]*[^\W\d_][\w†@̀-ͯ]*|\d[\w†@]*[^\W\d_]\w*|[†@][^\W\d_]\w+")
#: Signs that runs of letters and digits do not tell words by.
_SPECIAL, _RUN = re.compile("[_†@\u0300-\u036f\ufb00-\ufb06]"), re.compile(r"\w+")
_LIGATURE = re.compile("[\ufb00-\ufb06]")
_HYPHEN = re.compile(r"([^\W\d_]+)[-‐\xad¬]\s*$")
_NUMBER = re.compile(
    r"^(?:[·•\-–—\[(]\s*)?(?:(?:page|pag|p|s|стр|с|seite|página|pág|folio)\.?\s*)?(?=[\dlIoO]*\d|[lI][\dlIoO]+|[lI]$)[\dlIoO]{1,4}(?:\s*/\s*[\dlIoO]{1,4})?(?:\s*[·•\-–—\])])?$",
    re.I,
)
_SIDE_NUMBER = re.compile(r"^\s*[\dlIO]{1,4}\s{2,}(?=\S)|(?<=\S)\s{2,}[\dlIO]{1,4}\s*$")
_HEADING = re.compile(r"^\d+(?:\.\d+)+\s+\S.{0,70}(?<![.!?,;:-])$")
_FORMULA = re.compile(r"^(?:[A-Z][a-z]?\d{1,3}[A-Z]?\d*|[A-Z]{1,3}\d{1,2}[A-Z]?|[a-z]\d{1,2}|\d[A-Z]|v\d+)$")
_LATIN, _CYRILLIC = re.compile("[a-zà-ÿ]", re.I), re.compile("[а-яёіїєґ]", re.I)


def tokens(line: str) -> list[str]:
    """The words of a line; ligatures count as their letters."""
    if not _SPECIAL.search(line):
        return [w for w in _RUN.findall(line) if not w.isdecimal()]
    if not line.isascii():
        line = unicodedata.normalize("NFC", line)
        line = _LIGATURE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), line)
    return _TOKEN.findall(line)


def odd(word: str) -> bool:
    """A word that no lexicon is needed for: a sign, digit or letter of another script inside letters."""
    if word.isalpha():
        latin, cyrillic = len(_LATIN.findall(word)), len(_CYRILLIC.findall(word))
        return bool(latin and cyrillic and latin + cyrillic >= 3 and "ſ" not in word) or ("ſ" in word and len(word) >= 3)
    letters = sum(map(str.isalpha, word))
    strange = len(word) - letters
    if _FORMULA.match(word) or letters < 2 or strange > max(1, letters // 2):
        return False
    if any(c in "†@" for c in word):
        return letters >= 2
    return letters >= 3 and sum(map(str.islower, word)) >= 2


#: Groups of two letters that one letter is read as; they are taken out as one.
GROUPS = frozenset(r for _, r, _ in CONFUSIONS if len(r) == 2)


def deletes(word: str) -> set[str]:
    """The word and what is left of it without one letter or confused group, and without two if it is long."""
    one = _shorter(word)
    return one | {word} if len(word) < LONG else one | {word}.union(*map(_shorter, one))


def _shorter(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + word[i + 2 :] for i in range(len(word) - 1) if word[i : i + 2] in GROUPS}


@lru_cache(maxsize=100_000)
def confusion(printed: str, read: str) -> float | None:
    """The weight of reading a letter as a group, null if that is no known confusion; an accent may be lost on the way."""
    if (printed, read) in WEIGHTS:
        return WEIGHTS[printed, read]
    base = unicodedata.normalize("NFD", printed)[0]
    if base == printed:
        return None
    return LOST_ACCENT if base == read else LOST_ACCENT / 3 + WEIGHTS[base, read] if (base, read) in WEIGHTS else None


def distance(printed: str, read: str, limit: float) -> tuple[float, int, int] | None:
    """``(weight, first, last)``: the least weight of edits that make ``read`` out of ``printed`` and where in ``read`` they lie; null above ``limit``.

    An edit that is no known confusion says the less the shorter the word is: most short words are one letter from another.
    """
    n, m = len(printed), len(read)
    other = OTHER * max(1.0, SHORT / m)
    rows: list[list[tuple[float, int, int]]] = [[(j * other, 0 if j else m, j - 1) for j in range(m + 1)]]
    for i in range(1, n + 1):
        row = [(i * other, 0, 0)]
        above = rows[i - 1]
        for j in range(1, m + 1):
            a, b = printed[i - 1], read[j - 1]
            if a == b:
                best = above[j - 1]
            else:
                w, f, t = above[j - 1]
                known = confusion(a, b)
                best = (w + (other if known is None else known), min(f, j - 1), max(t, j - 1))
            for w, f, t in ((above[j][0] + other, *above[j][1:]), (row[j - 1][0] + other, *row[j - 1][1:])):
                if w < best[0]:
                    best = (w, min(f, j - 1), max(t, j - 1))
            if j > 1 and (w := confusion(a, read[j - 2 : j])) is not None and above[j - 2][0] + w < best[0]:
                best = (above[j - 2][0] + w, min(above[j - 2][1], j - 2), max(above[j - 2][2], j - 1))
            row.append(best)
        if min(r[0] for r in row) > limit:
            return None
        rows.append(row)
    weight, first, last = rows[n][m]
    return (weight, first, last) if weight <= limit else None


# -- the corpus lexicon ----------------------------------------------------------------------------
#: Characters of ordinary text; only a text with others may be wrongly decoded and is turned back before its words are counted.
_ORDINARY = re.compile(r"[\x00-\x7fàâäçéèêëîïôöùûüßñáíóúÄÖÜÉ¿¡«»а-яА-ЯёЁіїєґІЇЄҐ“”„’–—…ऀ-ॿ฀-๿぀-ヿ一-鿿。、「」，：！？（）·•°©œ¬‐\xad]*")


def counts(sentence_data: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """``word, hash, n``: how often every word, and every compound with a hyphen inside a line, occurs in all records; and, with a null
    ``word``, how often every pair of neighbouring words does, by the hash of both. Words are counted in repaired text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compound = re.compile(r"(?<![^\W\d_])[^\W\d_]{2,}(?:-[^\W\d_]{2,})+")
        fix = repairer(samples).repair
        for batch in batches:
            n: Counter = Counter()
            pairs: Counter = Counter()
            for text in batch["text"]:
                lower = (text if _ORDINARY.fullmatch(text) else fix(text)[0]).lower()
                words = tokens(lower)
                n.update(words)
                pairs.update(zip(words, words[1:]))
                if "-" in lower:
                    n.update(compound.findall(lower))
            yield pd.DataFrame([*(("", w, k) for w, k in n.items()), *((a, b, k) for (a, b), k in pairs.items())], columns=["prev", "word", "n"])

    rows = sentence_data.where("text IS NOT NULL").select("text").mapInPandas(count, "prev string, word string, n bigint")
    return rows.select(F.when(F.col("prev") == "", F.col("word")).alias("word"), F.xxhash64("prev", "word").alias("hash"), "n").groupBy("hash", "word").agg(F.sum("n").alias("n"))


def repairs(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, repair, n, m, weight, first, last``: lexicon words that ``words`` (``word, n``) may stand for, by deletes from both sides."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, w, n) for w, n in zip(batch["word"], batch["n"], strict=True) if "-" not in w for k in deletes(w)]
            yield pd.DataFrame(rows, columns=["key", "word", "n"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, repair, n, m in zip(batch["word"], batch["repair"], batch["n"], batch["m"], strict=True):
                found = distance(repair, word, EDITS * OTHER)
                if found:
                    out.append((word, repair, n, m, *found))
            yield pd.DataFrame(out, columns=["word", "repair", "n", "m", "weight", "first", "last"])

    keyed = F.xxhash64("key").alias("key")
    read = words.where(F.length("word") >= 3).mapInPandas(index, "key string, word string, n bigint").select(keyed, "word", "n")
    printed = lexicon.where((F.col("n") >= RATIO) & (F.length("word") >= 3)).mapInPandas(index, "key string, word string, n bigint").select(keyed, F.col("word").alias("repair"), F.col("n").alias("m"))
    near = (F.col("m") >= RATIO * F.col("n")) & (F.abs(F.length("word") - F.length("repair")) <= EDITS)
    met = read.join(printed, "key").where(near).select("word", "repair", "n", "m").distinct()
    return met.mapInPandas(measure, "word string, repair string, n bigint, m bigint, weight double, first int, last int")


# -- lines -----------------------------------------------------------------------------------------
def core(line: str, source: str | None) -> str:
    """What remains of a running title without source, numbers, case and signs."""
    if source:
        line = line.replace(source, " ")
    return " ".join(re.findall(r"[^\W\d_]+", _SIDE_NUMBER.sub(" ", line).casefold()))


def furniture_lines(pages: list[tuple[int, str | None, list[str]]]) -> set[tuple[int, int]]:
    """``(record, line)`` indices of page numbers and running titles of one file."""
    found: set[tuple[int, int]] = set()
    titles: Counter = Counter()
    seen: Counter = Counter()
    open_: list[tuple[int, int, str]] = []
    for r, (_, source, lines) in enumerate(pages):
        for i, line in enumerate(lines):
            text = line.strip()
            if not text:
                continue
            bare = text[len(source) :].strip() if source and text.lower().startswith(source.lower()) else text
            if _NUMBER.match(bare) or not bare:
                found.add((r, i))
                continue
            ends = text[-1] in ".!?…:;,-‐\xad¬।。"
            name = core(text, source)
            if len(name) < 4 or re.match(r"^\d+\.\d+\s", text):
                continue
            if not ends:
                seen[name] += 1
                open_.append((r, i, name))
            beside = bool(_SIDE_NUMBER.search(text)) and not ends
            if (beside and len(text) < 120) or re.match(r"^[·•|]\s", bare) or (text.isupper() and len(name) >= 8 and not ends):
                titles[name] += 1
    titles.update({k: n for k, n in seen.items() if n >= 2 and len(k) >= 8})
    for r, i, name in open_:
        if name in titles or any(abs(len(t) - len(name)) <= 3 and difflib.SequenceMatcher(None, t, name).ratio() >= 0.88 for t in titles):
            found.add((r, i))
        elif _first(pages[r][2]) == i and _stands_alone(pages[r][2], i):
            found.add((r, i))
    return found


def _first(lines: list[str]) -> int:
    return next((i for i, x in enumerate(lines) if x.strip()), -1)


def _stands_alone(lines: list[str], i: int) -> bool:
    """A first line that ends no sentence although the next one begins anew, and that leaves much of the width free."""
    after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
    width = max((len(x.strip()) for x in lines[i + 1 :]), default=0)
    return bool(after) and (after[0].isupper() or after[0] in "«“„\"¿¡(0123456789") and len(lines[i].strip()) < 0.8 * width


def line_facts(sentence_data: DataFrame, samples: tuple[str, ...], common: frozenset[str] = frozenset()) -> DataFrame:
    """``rec_id, line_no, kind, word, other, prev, cut``.

    ``furniture``; ``join``: a line-end hyphen with the joined word, the compound in ``other`` and the length of its
    first part in ``cut``; words in ``common`` are left out; ``tail``: the same at its second part; ``word``: a word of the line with the one before it.
    """
    columns = ["rec_id", "line_no", "kind", "word", "other", "prev", "cut"]

    def per_file(records: list[tuple]) -> list[tuple]:
        fix = repairer(samples).repair
        pages = [(rec_id, source, (fix(text)[0] or "").split("\n")) for rec_id, source, text in records]
        furniture = furniture_lines(pages)
        out: list[tuple] = [(pages[r][0], i, "furniture", None, None, None, 0) for r, i in furniture]
        body = [(rec_id, i, line) for r, (rec_id, _, lines) in enumerate(pages) for i, line in enumerate(lines) if line.strip() and (r, i) not in furniture]
        skip_first = False
        for k, (rec_id, i, line) in enumerate(body):
            words = tokens(line)
            if skip_first and words:
                words = words[1:]
            m = _HYPHEN.search(line)
            skip_first = False
            if m and k + 1 < len(body):
                following = tokens(body[k + 1][2])
                head = m.group(1)
                if following and body[k + 1][2].lstrip()[:1].isalnum():
                    out.append((rec_id, i, "join", (head + following[0]).lower(), f"{head}-{following[0]}".lower(), None, len(head)))
                    out.append((body[k + 1][0], body[k + 1][1], "tail", (head + following[0]).lower(), None, None, len(head)))
                    skip_first = True
                    words = words[:-1]
                elif words:
                    out.append((rec_id, i, "join", head.lower(), "", None, len(head)))
                    words = words[:-1]
            prev = None
            for w in words:
                low = w.lower()
                if low not in common and (len(w) >= 3 and w.isalpha() or odd(w)):
                    out.append((rec_id, i, "word", low, None, prev, 0))
                prev = low
        return out

    schema = "rec_id bigint, line_no int, kind string, word string, other string, prev string, cut int"
    return file_rows(sentence_data, ".pdf").mapInPandas(by_file(per_file, columns), schema)


def strange(word: str) -> tuple[int, int] | None:
    """Where the first and last strange glyphs of an odd word lie; null for any other word."""
    if not odd(word):
        return None
    cyrillic = len(_CYRILLIC.findall(word)) > len(_LATIN.findall(word))
    fits = _CYRILLIC if cyrillic else _LATIN
    at = [i for i, c in enumerate(word) if not fits.match(c) or c == "ſ"]
    return at[0], at[-1]


def line_repairs(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, line_no, kind, word, repair, path``: every line to be repaired and what stands for its words.

    ``path`` of a misread word: ``index`` if the lexicon's index decided, ``looks`` if it has no candidate for a word with a strange glyph.
    """
    samples = sample_sentences(lang_sample)
    counted = cut_lineage(counts(sentence_data, samples))
    words, pairs = counted.where("word IS NOT NULL").select("word", "n"), counted.where("word IS NULL").select("hash", "n")
    # a word that is more than 1/RATIO as frequent as the most frequent one has no candidate; by their sum these are few words
    most = words.agg(F.max("n")).first()[0] or 0
    common = frozenset(r.word for r in words.where(F.col("n") * RATIO > most).select("word").collect())
    facts = cut_lineage(line_facts(sentence_data, samples, common))

    furniture = facts.where("kind = 'furniture'").select("rec_id", "line_no", "kind", "word", F.lit(None).cast("string").alias("repair"), F.lit(None).cast("string").alias("path"))
    joins = facts.where("kind = 'join'").select("rec_id", "line_no", "word", "other")
    whole, split = words.select("word", F.col("n").alias("whole")), words.where("word LIKE '%-%'").select(F.col("word").alias("other"), F.col("n").alias("split"))
    kept = F.coalesce("split", F.lit(0)) > F.coalesce("whole", F.lit(0))
    breaks = joins.join(split, "other", "left").join(whole, "word", "left").where(~kept).select("rec_id", "line_no", F.lit("break").alias("kind"), F.col("other").alias("word"), F.col("word").alias("repair"), F.lit(None).cast("string").alias("path"))

    def looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, *at) for w in batch["word"] if (at := strange(w))], columns=["word", "left", "right"])

    seen = facts.where("kind IN ('word', 'join', 'tail')")
    # a divided word is counted in its parts, so as a whole it may be new to the lexicon
    asked = seen.select("word").distinct().join(words, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("n"))
    fixes = cut_lineage(repairs(asked, words))
    oddities = cut_lineage(asked.select("word").mapInPandas(looks, "word string, left int, right int"))

    # each occurrence of a word with candidates: the word as read against every candidate, by frequency, edits and the word before
    options = fixes.join(oddities, "word", "left").join(seen, "word")
    together = lambda a, b, name: pairs.select(F.col("hash").alias(a), F.col("n").alias(b + name))
    scored = options.withColumn("h1", F.when(F.col("prev").isNotNull(), F.xxhash64("prev", "repair"))).withColumn("h0", F.when(F.col("prev").isNotNull(), F.xxhash64("prev", "word")))
    scored = scored.join(together("h1", "with", "_repair"), "h1", "left").join(together("h0", "with", "_word"), "h0", "left")
    context = lambda c, less: CONTEXT * F.log1p(F.greatest(F.coalesce(c, F.lit(0)) - less, F.lit(0)))
    own = F.log("n") + context("with_word", 1) - F.when(F.col("left").isNotNull(), ODD).otherwise(0.0)
    gain = F.log("m") + context("with_repair", 0) - COST * F.col("weight") - own
    best = scored.withColumn("gain", gain).groupBy("rec_id", "line_no", "kind", "word", "prev", "cut").agg(F.max_by(F.struct("repair", "first", "last", "gain"), F.struct("gain", "repair")).alias("top")).where("top.gain > 0")
    # a misread glyph lies on the line of its part of a divided word
    on_line = "kind = 'word' OR (kind = 'join' AND {0} < cut) OR (kind = 'tail' AND {1} >= cut)"
    chars = best.where(on_line.format("top.first", "top.last")).select("rec_id", "line_no", F.lit("chars").alias("kind"), "word", "top.repair", F.lit("index").alias("path"))
    left = oddities.join(fixes.select("word").distinct(), "word", "left_anti").join(seen, "word").where(on_line.format("left", "right"))
    by_looks = left.select("rec_id", "line_no", F.lit("chars").alias("kind"), "word", F.lit(None).cast("string").alias("repair"), F.lit("looks").alias("path"))
    return furniture.unionByName(breaks).unionByName(chars).unionByName(by_looks)


def lines_to_repair(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, line_no, kind`` of every line to be repaired, once."""
    return line_repairs(sentence_data, lang_sample).select("rec_id", "line_no", "kind").distinct()


# -- paragraphs ------------------------------------------------------------------------------------
def straightened(word: str) -> str:
    """An odd word in the letters of its script: each strange glyph becomes the likeliest letter that is read as it."""
    cyrillic = len(_CYRILLIC.findall(word)) > len(_LATIN.findall(word))
    fits = _CYRILLIC if cyrillic else _LATIN
    out = []
    for c in word:
        if fits.match(c) and c != "ſ":
            out.append(c)
            continue
        options = sorted((w, p) for p, w in _BY_READ.get(c.lower(), []) if fits.match(p))
        out.append(options[0][1] if options else c)
    return "".join(out)


def mend_line(line: str, fixes: dict[str, str | None]) -> str:
    """A line with its misread words replaced; the first letter keeps its case."""

    def one(m: re.Match) -> str:
        word = m.group()
        fix = fixes.get(word.lower(), fixes.get(word, word)) if word.lower() in fixes or word in fixes else word
        fix = straightened(word) if fix is None else fix
        return fix.capitalize() if word[:1].isupper() and fix.islower() else fix

    return _TOKEN.sub(one, line)


def assemble(lines: list[tuple[str, bool, bool, dict]]) -> list[str]:
    """Paragraphs from ``(line, furniture, break, fixes)`` in reading order: an empty line ends one, divided words are joined.

    A word that is divided and misread is mended after its parts are joined.
    """
    out: list[str] = []
    text, glue, pending = "", " ", {}
    for line, furniture, divided, fixes in lines:
        if furniture:
            continue
        if not line.strip():
            if text:
                out.append(text)
            text, glue = "", " "
            continue
        if glue and _HEADING.match(line.strip()):  # a numbered heading stands by itself
            out += [text, mend_line(line.strip(), fixes)] if text else [mend_line(line.strip(), fixes)]
            text, glue = "", " "
            continue
        known = fixes | pending
        if divided:
            line = re.sub(r"[-‐\xad¬]\s*$", "", line)
        if glue == "" and text:
            head, _, text_last = text.rpartition(" ")
            first, _, rest = line.strip().partition(" ")
            joined = mend_line(text_last + first, known)
            text = f"{head} {joined}".strip() + (f" {mend_line(rest, fixes)}" if rest else "")
        else:
            text = f"{text} {mend_line(line.strip(), fixes)}".strip()
        pending = fixes if divided else {}
        glue = "" if divided or re.search(r"[^\W\d_]-$", line.strip()) else " "
    return [*out, text] if text else out


def own_lines(lines: list[tuple[bool, tuple]]) -> list[tuple]:
    """The lines of a stretch's own records; a word divided over its borders belongs to the stretch where it begins."""
    body = [i for i, (_, line) in enumerate(lines) if line[0].strip() and not line[1]]
    own = {i: line for i, (mine, line) in enumerate(lines) if mine}
    for here, after in zip(body, body[1:]):
        if lines[here][1][2] and lines[here][0] != lines[after][0]:
            line, furniture, divided, fixes = lines[after][1]
            first, _, rest = line.strip().partition(" ")
            if after in own:
                own[after] = (rest, furniture, divided, fixes)
            else:
                own[after] = (first, False, False, fixes)
    return [own[i] for i in sorted(own)]


def paragraphs(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``file_path, stretch, par_no, text``: the repaired paragraphs of every scanned file in reading order.

    Furniture is left out, so a sentence goes on over the end of a page; a new record begins no paragraph. A paragraph that crosses
    the border of a stretch comes out in two parts.
    """
    samples = sample_sentences(lang_sample)
    marks = line_repairs(sentence_data, lang_sample).drop("path").distinct()
    per_line = marks.groupBy("rec_id", "line_no").agg(
        F.max(F.col("kind") == "furniture").alias("furniture"),
        F.max(F.col("kind") == "break").alias("divided"),
        F.collect_set(F.when(F.col("kind") == "chars", F.struct("word", "repair"))).alias("fixes"),
    )
    per_record = per_line.groupBy("rec_id").agg(F.collect_list(F.struct("line_no", "furniture", "divided", "fixes")).alias("marks"))
    rows = file_rows(sentence_data, ".pdf").join(per_record, "rec_id", "left").repartition("file_path", "stretch").sortWithinPartitions("file_path", "stretch", "rec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer(samples).repair
        key, last, lines = None, None, []

        def flush() -> list[tuple]:
            return [(*key, i, p) for i, p in enumerate(assemble(own_lines(lines)))] if key else []

        columns = ["file_path", "stretch", "par_no", "text"]
        for batch in batches:
            out: list[tuple] = []
            for rec_id, path, stretch, own, text, found in zip(batch["rec_id"], batch["file_path"], batch["stretch"], batch["own"], batch["text"], batch["marks"], strict=True):
                if (path, stretch) != key:
                    out += flush()
                    key, last, lines = (path, stretch), None, []
                if rec_id == last:
                    continue
                last = rec_id
                at = {m["line_no"]: m for m in (found if found is not None else [])}
                for i, line in enumerate((fix(text)[0] or "").split("\n")):
                    m = at.get(i)
                    fixes = {f["word"]: f["repair"] for f in m["fixes"]} if m is not None else {}
                    lines.append((own, (line, m is not None and bool(m["furniture"]), m is not None and bool(m["divided"]), fixes)))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(flush(), columns=columns)

    return rows.mapInPandas(run, "file_path string, stretch bigint, par_no int, text string")
