"""Template residue, filler, error pages and script requests in place of content.

All documents are read once for evidence; records of one template are then aligned and judged together:

* *Slots.* Candidates are names in delimiters, default texts and blanks. A name in delimiters that prose has no use for is a
  retained variable wherever it stands. All others are judged by alignment: the two words before and after a candidate are
  its place, and whatever other records hold between the same words are the fillers of that place. A place with two or more
  different fillers is a slot of a template. Names in delimiters that prose shares are variables if they also stand in the former, or
  at two slots; a default or a blank is residue at a slot that two records have filled differently. Notation, quoted slots
  and slots in a sentence about templates are explained and exempt, however often they occur.
* *Whole-page templates.* Error pages, script requests and notices repeat their sentences from page to page. A sentence (codes and
  numbers masked) that recurs in different texts of few distinct words, and hardly in others, is one of a page template; a text made of
  such sentences, but for its title, is residue unless its words are on the whole those of content.
* *Filler* has no sentence twice but a small vocabulary of its own: words are weighed by how much more often they occur in poor than
  in rich texts, and a poor text is filler if it has sentences of such words and, but for a title, no sentence of content.

Counts cover all documents (equal texts once). Slots and page templates are joined, not sent round; only the words
that reach ``WORD_SHARE`` travel with the tasks, which bounds them by that share.

Defined results: null, empty and blank texts are no residue; copies count like their originals; a null
``doc_id`` is reported as null; empty tables give empty results.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mycelia.session import cut_lineage

#: A text of fewer distinct words is poor, any other rich. A property of the text, whatever the size of the corpus.
RICH = 75
#: A word is weighed from so many texts, and from this share of all of them.
LEAST_TEXTS, WORD_SHARE = 3, 1 / 20_000
#: How much more often a sentence of a page template occurs in poor texts, as a logarithm, and the share of a page that such sentences fill.
PAGE_WEIGHT, PAGE_FILL = 1.1, 0.6
#: The mean weight of its words below which a text is content.
CONTENT = -0.25
#: Most words of a filler that is looked for, and bits of the filters that find aligned records (misses cost time, never rows).
FILLER_WORDS, BITS = 4, 1 << 20

_NAME = r"[^\W\d_][\w-]{0,40}"
#: Delimiters of unfilled slots. Fixed values.
SLOT = re.compile(
    rf"(?=[{{<\[_%#$«])(?:\{{\{{\s*(?:\w+\.)*({_NAME})\s*(?:\|[^{{}}\n]{{0,40}})?\}}\}}|\$\{{({_NAME})\}}|\{{({_NAME})\}}|<%=?\s*({_NAME})\s*%>|<({_NAME})>|\[\[({_NAME})\]\]|\[({_NAME})\]"
    rf"|__({_NAME}?)__|%({_NAME})%|#({_NAME})#|\$({_NAME})\$|«({_NAME})»)"
)
#: Groups of SLOT whose delimiters prose has no use for, and the tags that pages may show as text. Fixed values.
_CLEAR = frozenset((1, 2, 3, 4, 5, 6, 9))
_TAGS = frozenset("html head body title meta link script style div span p a b i u em strong br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody img pre code sub sup form input button label select option section article header footer nav main aside figure blockquote iframe svg canvas video audio source small cite mark kbd".split())
#: Words of sentences that speak of slots, and signs that quote one. Fixed values.
_ABOUT = re.compile(
    r"\b(?:template (?:language|engine|syntax)|templating|slots?|placeholders?|shell|latex|environment variable|platzhalter\w*|vorlagensprache|umgebungsvariable\w*"
    r"|espaces? réservés?|langage de gabarit|variable d.environnement|marcador(?:es)? de posición|variable de entorno|шаблон\w*|заполнител\w*|заповнювач\w*)\b"
    r"|模板|占位符|テンプレート|プレースホルダ|टेम्पलेट|प्लेसहोल्डर|แม่แบบ|ตัวยึดตำแหน่ง",
    re.I,
)
_QUOTES = {"`": "`", '"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "「": "」"}
_RUN, _WORD = re.compile(r"\w+"), re.compile(r"\b[^\W\d_]+\b")
_DENSE = re.compile(r"[ऀ-෿฀-໿぀-ヿ一-鿿]{2,}")
_UNIT = re.compile(r"\n+|(?<=[.!?…।。！？])[ \t ]+|(?<=[。！？])(?=\S)")
_GAP = re.compile(r"[­​-‏﻿\x00-\x08\x0b-\x1f]")


def plain(text: str) -> str:
    """Lower case, without what is hidden between letters."""
    return _GAP.sub("", html.unescape(text) if "&" in text else text).lower()


def words_of(text: str) -> list[str]:
    """Lower-case words; scripts without spaces give character pairs."""
    text = plain(text)
    return _words(text, tokens_of(text))


def tokens_of(text: str) -> list[str]:
    """The runs of a text that hold letters only."""
    return [w for w in _RUN.findall(text) if w.isalpha()]


def _words(text: str, tokens: list[str]) -> list[str]:
    if text.isascii() or not _DENSE.search(text):
        return tokens
    return [w for w in tokens if not _DENSE.match(w)] + [run[i : i + 2] for run in _DENSE.findall(text) for i in range(len(run) - 1)]


#: Texts that stand in a slot by default, and blanks left to be filled. Fixed values.
_DEFAULT = re.compile(r"(?<![\w/.-])(?:tbd|tba|n/a|null|undefined|untitled|xxx+|todo|fixme)(?![\w/.-])", re.I)
_BLANK = re.compile(r"_{3,}|\[\s*\]|\(\s*\)|\{\s*\}|<\s*>")
_DEFAULT_WORDS = frozenset(("tbd", "tba", "null", "undefined", "untitled", "todo", "fixme"))
CLEAR, SHARED, DEFAULT, BLANK = range(4)
_CODE = re.compile(r"\d[\w-]*")
_ENDS = ".!?…।。！？ \t\n"


def slots_of(text: str, words: set[str] | None = None) -> list[tuple[str, str, int]]:
    """``(place, name, class)`` of every candidate that is not explained: the place is the two words before and after.

    Where its ``words`` hold no default there is none to look for.
    """
    spans = []
    if any(c in text for c in "{<[_%#$«"):
        for m in SLOT.finditer(text):
            name = m.group(m.lastindex).lower()
            if not explained(text, m, name):
                clear = m.lastindex in _CLEAR and not (m.lastindex == 5 and name in _TAGS)
                spans.append((m.start(), m.end(), name, CLEAR if clear else SHARED))
    taken = [(a, b) for a, b, *_ in spans]
    for pattern, kind in ((_DEFAULT, DEFAULT), (_BLANK, BLANK)):
        if kind == DEFAULT and words is not None and _DEFAULT_WORDS.isdisjoint(words) and not any(x in text for x in ("xxx", "XXX", "/a", "/A")):
            continue
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b in taken) and not explained(text, m, m.group().lower()):
                spans.append((m.start(), m.end(), m.group().lower(), kind))
    if not spans:
        return []
    words = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]

    def word(i: int, outside: str) -> str:
        if not 0 <= i < len(words):
            return outside
        a, b, w = words[i]
        return "?" if any(x < b and a < y for x, y, *_ in spans) else w

    found = []
    for a, b, name, kind in spans:
        i, j = int(np.searchsorted(starts, a)) - 1, int(np.searchsorted(starts, b))
        found.append((f"{word(i - 1, '^')} {word(i, '^')} _ {word(j, '$')} {word(j + 1, '$')}", name, kind))
    return found


def explained(text: str, m: re.Match, name: str) -> bool:
    """Whether a slot is notation (one cased letter, or glued to a command), quoted, or in a sentence about slots."""
    if len(name) == 1 and name.upper() != name or re.search(r"\\\w*$", text[max(0, m.start() - 20) : m.start()]):
        return True
    if m.start() and text[m.end() : m.end() + 1] == _QUOTES.get(text[m.start() - 1]):
        return True
    before = _UNIT.split(text[max(0, m.start() - 200) : m.start()])[-1]
    return bool(_ABOUT.search(f"{before} {_UNIT.split(text[m.end() : m.end() + 200])[0]}"))


def sentences_of(clean: str) -> list[str]:
    """The sentences of a text as :func:`plain` gives it, without their codes, numbers and ends."""
    text = _CODE.sub("#", clean)
    for end in ("! ", "? ", "… ", "। ", "\n", "。", "！", "？"):
        text = text.replace(end, ". ")
    return [u for part in text.split(". ") if (u := part.strip(_ENDS))]


def signature(sentence: str) -> int:
    return xxhash.xxh64_intdigest(sentence) - (1 << 63)


def titled(unit: str) -> bool:
    """Whether a text's first sentence may be its title: short and without the end of a sentence."""
    return len(unit) <= 120 and not re.search(r"[.!?…।。！？]\s*$", unit)


EVIDENCE = "kind string, item string, place string, text_hash bigint, text_size int, unit bigint, poor bigint, rich bigint"


def evidence(documents: DataFrame) -> DataFrame:
    """Counts over distinct texts (``EVIDENCE``), pre-aggregated per batch.

    ``w``: a word with the numbers of poor and rich texts that hold it, the empty one counting the texts; ``u``: a sentence with the number of poor
    texts that hold it; ``p``: a poor text's sentences with their characters (in ``poor``); ``s``: a text's slot candidates with their class (in ``poor``).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: tuple[Counter, Counter] = Counter(), Counter()
            sentences: Counter = Counter()
            rows: list[tuple] = []
            for text, h, n in zip(*(batch.column(c).to_pylist() for c in ("text", "h", "n")), strict=True):
                clean = plain(text)
                distinct = set(_words(clean, tokens_of(clean)))
                distinct.add("")
                rich = len(distinct) > RICH
                words[rich].update(distinct)
                if not rich:
                    line, _, below = text.strip().partition("\n")
                    chars: dict[int, int] = {}
                    for k, u in enumerate(sentences_of(clean)):
                        x = signature(u)
                        chars[x] = chars.get(x, 0) + (0 if k == 0 and below and titled(line) else len(u))
                    sentences.update(chars.keys())
                    rows += [("p", None, None, h, n, x, c, 0) for x, c in chars.items()]
                rows += [("s", name, place, h, n, None, kind, 0) for place, name, kind in set(slots_of(text, distinct))]
            poor, rich_ = words
            rows += [("w", k, None, None, None, None, poor.get(k, 0), rich_.get(k, 0)) for k in poor.keys() | rich_.keys()]
            rows += [("u", None, None, None, None, k, n, 0) for k, n in sentences.items()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = [c.split()[0] for c in EVIDENCE.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in EVIDENCE.split(", ")]
    parts = _distinct(documents).mapInArrow(count, EVIDENCE)
    keys = names[:-2]
    # the counts of words and sentences add up over batches; the other rows are one of a kind
    summed = parts.groupBy(*keys).agg(F.sum("poor").alias("poor"), F.sum("rich").alias("rich"))
    return summed.where(f"kind IN ('p', 's') OR (kind = 'w' AND poor + rich >= {LEAST_TEXTS}) OR (kind = 'w' AND item = '') OR (kind = 'u' AND poor >= 2)")


def _distinct(documents: DataFrame) -> DataFrame:
    return _hashed(documents.select("text")).dropDuplicates(["h", "n"])


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("text").rlike("\\S")).withColumns({"h": F.xxhash64("text"), "n": F.length("text")})


def _filter(bits: DataFrame) -> bytes:
    """Which of the ``BITS`` numbers occur in a column of numbers from 0: a filter of fixed size."""
    out = bytearray(BITS)
    for r in bits.toDF("b").distinct().collect():
        out[r.b] = 1
    return bytes(out)


def _crc(column: Column) -> Column:
    return (F.crc32(column) % BITS).cast("int")


class Aligner:
    """Finds what records hold at given places: filters of bounded size over the word before a slot, the two before it, and the whole place."""

    def __init__(self, places: DataFrame):
        left = F.substring_index("place", " _ ", 1)
        self.words = _filter(places.select(_crc(F.substring_index(left, " ", -1))))
        self.lefts = _filter(places.select(_crc(left)))
        self.wholes = _filter(places.select(_crc(F.col("place"))))
        self.any = any(self.wholes)
        self._word: dict[str, bool] = {}

    def fillers(self, tokens: list[str]) -> set[tuple[str, str]]:
        """``(place, filler)``, up to ``FILLER_WORDS`` words each."""
        known = self._word
        out: set[tuple[str, str]] = set()
        for i, w in enumerate(tokens):
            hit = known.get(w)
            if hit is None:
                if len(known) > 400_000:
                    known.clear()
                hit = known[w] = self.words[zlib.crc32(w.encode()) % BITS] == 1
            if hit and i and self.lefts[zlib.crc32(f"{tokens[i - 1]} {w}".encode()) % BITS]:
                for k in range(1, min(FILLER_WORDS, len(tokens) - i - 3) + 1):
                    place = f"{tokens[i - 1]} {w} _ {tokens[i + k + 1]} {tokens[i + k + 2]}"
                    if self.wholes[zlib.crc32(place.encode()) % BITS]:
                        out.add((place, " ".join(tokens[i + 1 : i + 1 + k])))
        return out


def slot_texts(slots: DataFrame, fillers: DataFrame) -> DataFrame:
    """``text_hash, text_size, reason`` of the texts that keep a variable name, a default or a blank.

    ``slots``: evidence of kind ``s`` with its ``class``; ``fillers`` (``place, filler``): what other records hold at the places.
    """
    clear, open_ = slots.where(F.col("class") == CLEAR), slots.where(F.col("class") != CLEAR)
    flagged = clear.select("text_hash", "text_size", F.lit("slot").alias("reason"))
    named = slots.select("place", F.concat(F.lit("{"), "item", F.lit("}")).alias("filler"))  # a name is no word that fills a slot
    slot = fillers.unionByName(named).groupBy("place").agg(F.count_distinct("filler").alias("n")).where("n >= 2").select("place")
    filled = fillers.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("place")
    shared = open_.where(F.col("class") == SHARED)
    at_slots = shared.join(slot, "place", "left_semi").groupBy("item").agg(F.count_distinct("place").alias("n")).where("n >= 2").select("item")
    variables = clear.select("item").distinct().unionByName(at_slots).distinct()
    flagged = flagged.unionByName(shared.join(variables, "item", "left_semi").select("text_hash", "text_size", F.lit("slot").alias("reason")))
    left = open_.where(F.col("class") >= DEFAULT).join(filled, "place", "left_semi")
    return flagged.unionByName(left.select("text_hash", "text_size", F.when(F.col("class") == DEFAULT, "default").otherwise("blank").alias("reason")))


def page_texts(seen: DataFrame, rich: DataFrame, n_poor: int, n_rich: int) -> DataFrame:
    """``text_hash, text_size, reason`` of the texts that are made of sentences which recur in poor texts and hardly in rich ones (``unit, rich``)."""
    weight = F.log((F.col("poor") + 0.5) / (n_poor + 1.0)) - F.log((F.coalesce(F.col("found"), F.lit(0)) + 0.5) / (n_rich + 1.0))
    sums = rich.groupBy("unit").agg(F.sum("rich").alias("found"))
    template = seen.where("kind = 'u'").select("unit", "poor").join(sums, "unit", "left").where(weight > PAGE_WEIGHT).select("unit", F.lit(True).alias("template"))
    own = seen.where("kind = 'p'").select("text_hash", "text_size", "unit", F.col("poor").alias("chars")).join(template, "unit", "left")
    filled = own.groupBy("text_hash", "text_size").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("template"), F.col("chars")).otherwise(0)).alias("filled"))
    return filled.where((F.col("filled") > 0) & (F.col("filled") >= PAGE_FILL * F.col("chars"))).select("text_hash", "text_size", F.lit("page").alias("reason"))


class Filler:
    """Tells filler by the weights of its words."""

    def __init__(self, words: dict[str, float]):
        self.words = words

    def score(self, unit: str) -> float | None:
        """Mean weight of a sentence's words, those of content being negative and rare ones nought. Null without a word."""
        words = words_of(unit)
        if not words:
            return None
        return sum(max(-2.0, min(self.words.get(w, 0.0), 4.0)) for w in words) / len(words)

    def content(self, words: set[str]) -> bool:
        """Whether a text's words are on the whole those of rich texts."""
        return sum(max(-2.0, min(self.words.get(w, 0.0), 4.0)) for w in words) < CONTENT * len(words)

    def __call__(self, text: str, words: set[str]) -> bool:
        if not words or sum(self.words.get(w, 0.0) > 1.0 for w in words) < 0.12 * len(words):
            return False
        units = [u for u in _UNIT.split(text) if u and u.strip()]
        scored = [(u, x) for u in units if (x := self.score(u)) is not None]
        residue = [u for u, x in scored if x >= 0.3]
        content = [u for u, x in scored if x < -0.25]
        if content and content[0] == scored[0][0] and titled(content[0]):
            content = content[1:]
        return bool(residue) and sum(map(len, content)) < 0.6 * sum(map(len, residue))


def residue_reasons(documents: DataFrame) -> DataFrame:
    """``doc_id, reason``: every document to be left out with all that tells so (``slot``, ``default``, ``blank``, ``page``, ``filler``)."""
    seen = cut_lineage(evidence(documents))
    words = seen.where("kind = 'w'")
    total = words.where("item = ''").first()
    n_poor, n_rich = (total.poor, total.rich) if total else (0, 0)
    weight = F.log((F.col("poor") + 0.5) / (n_poor + 1.0)) - F.log((F.col("rich") + 0.5) / (n_rich + 1.0))
    kept = words.where((F.col("item") != "") & (F.col("poor") + F.col("rich") >= max(LEAST_TEXTS, (n_poor + n_rich) * WORD_SHARE)))
    weights = {r.item: r.weight for r in kept.select("item", weight.alias("weight")).collect()}

    slots = seen.where("kind = 's'").select("item", "place", "text_hash", "text_size", F.col("poor").alias("class"))
    places = cut_lineage(slots.where((F.col("class") != CLEAR) & ~F.col("place").rlike("[?^$]")).select("place").distinct())
    aligner = Aligner(places)
    repeated = _filter(seen.where("kind = 'u'").select(F.pmod("unit", F.lit(BITS)).cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Filler(weights)
        for batch in batches:
            kept, filler, found = [], [], set()
            rich: Counter = Counter()
            for k, text in enumerate(batch.column("text").to_pylist()):
                clean = plain(text)
                tokens = tokens_of(clean)
                words = set(_words(clean, tokens))
                if len(words) < RICH:
                    is_filler = judge(text, words)
                    if is_filler or not judge.content(words):
                        kept.append(k)
                        filler.append(is_filler)
                else:
                    rich.update({x for u in sentences_of(clean) if repeated[(x := signature(u)) % BITS]})
                if aligner.any and (new := aligner.fillers(tokens)) and not slots_of(text):
                    found |= new
            out = batch.take(pa.array(kept, pa.int64()))
            none = pa.nulls(len(kept), pa.string())
            yield pa.RecordBatch.from_arrays([out.column("doc_id"), out.column("h"), out.column("n"), pa.array(filler, pa.bool_()), none, none, none.cast(pa.int64()), none.cast(pa.int64())], names=names)
            n = len(found) + len(rich)
            if n:
                types = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64())
                rows = [*((None, None, None, None, p, f, None, None) for p, f in found), *((None, None, None, None, None, None, u, c) for u, c in rich.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    names = ["doc_id", "text_hash", "text_size", "filler", "place", "word", "unit", "rich"]
    keyed = _hashed(documents.select("doc_id", "text"))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text_hash bigint, text_size int, filler boolean, place string, word string, unit bigint, rich bigint"
    # one pass over all documents: which poor ones are filler, or at least no content (the others are no page template, whatever they repeat), what
    # fills the places, and which sentences that recur in poor texts rich ones hold too
    passed = cut_lineage(keyed.mapInArrow(run, schema))
    judged = passed.where("filler IS NOT NULL")
    fillers = passed.where("place IS NOT NULL").select("place", F.col("word").alias("filler")).distinct().join(places, "place", "left_semi")
    key = ["text_hash", "text_size"]
    pages = judged.join(page_texts(seen, passed.where("unit IS NOT NULL").select("unit", "rich"), n_poor, n_rich), key).select("doc_id", "reason")
    kept_slots = keyed.select("doc_id", F.col("h").alias("text_hash"), F.col("n").alias("text_size")).join(slot_texts(slots, fillers).distinct(), key).select("doc_id", "reason")
    return kept_slots.unionByName(pages).unionByName(judged.where("filler").select("doc_id", F.lit("filler").alias("reason")))


def residue_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document to be left out."""
    return residue_reasons(documents).select("doc_id").distinct()
