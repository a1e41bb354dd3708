"""Language of every record and of every stretch of a mixed one, by compression.

Each language has a raw-content zstandard dictionary: its clean sample sentences and, up to
``DICTIONARY_CHARS``, the lines and sentences that recur under its label over all records. A sentence is encoded
with the dictionary of every language of its script; the smallest encoding names the language and
the distance to the second gives the confidence. Where the margin is narrow the sentence takes the
language of its neighbours; a record whose sentences are all narrow takes its own label if that is among
the near ones, else the language of the other records of its file.

Wrong encodings are turned back first; sentences are cut at ends of sentences, line ends and changes of
script, so single words, names and formulas inside a sentence do not make a record mixed.

Defined results: null and blank texts have no row; a text without a letter takes the language of its
file and is left out if there is none; a repeated record gives its rows once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mycelia.llm.encoding import repairer, sample_sentences
from mycelia.session import cut_lineage

#: Most characters of recurring lines in a language's dictionary.
DICTIONARY_CHARS = 40_000
#: Labelled sample sentences that are read at most; more would make dictionaries nobody needs.
SAMPLE_ROWS = 5_000
#: Characters of a line or sentence that may enter a dictionary, and the sightings from which its share of one label says something.
LINE_CHARS, SIGHTINGS, PURE = (3, 160), 8, 0.7
#: Compression levels: the first for all sentences, the second where the first gives no far margin.
LEVELS = (3, 6)
#: Sentences whose judgement a worker keeps; results do not depend on it.
CACHED_PIECES = 20_000
#: Fewer letters than this say nothing by themselves.
FEW_LETTERS = 12
#: A margin is wide from so many bytes and this share of the second size.
WIDE_BYTES, WIDE_SHARE = 3, 0.05
#: The margin from which a sentence differs from the other sentences of its script in the record, and a short one says anything.
FAR_LETTERS, FAR_BYTES, FAR_SHARE = 24, 6, 0.15
#: A letter of these scripts counts as so many.
LETTER_WEIGHT = {"Han": 3}

SCRIPTS = (
    ("Latin", re.compile(r"[A-Za-zÀ-ɏ]+")),
    ("Cyrillic", re.compile(r"[Ѐ-ԯ]+")),
    ("Han", re.compile(r"[぀-ヿ㐀-鿿]+")),
    ("Devanagari", re.compile(r"[ऀ-ॿ]+")),
    ("Thai", re.compile(r"[฀-๿]+")),
)
_ASCII_LETTERS = re.compile(r"[A-Za-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CUT = re.compile(r"(?<=[.!?…।])[)\]”\"“»’]*\s+(?=[^\s\da-zà-ÿа-яіїє—–])|\n+|(?<=[。！？])[”」』）]*|(?<=[฀-๿])\s+(?=[^\s\d฀-๿])|(?<=[^\s\d฀-๿])\s+(?=[฀-๿])")
_URLISH = re.compile(r"\S*(?:://|@|\.(?:txt|html?|pdf|invalid|com|org))\S*|[a-z]+-[a-z]+(?=[\s.·]|$)|[A-Za-z]*\d[A-Za-z\d]*")
#: What any match of the pattern above holds: a cheaper test.
_ODD_WORD = re.compile(r"\d|@|://|\.[thpico]|[a-z]-[a-z]")
#: Ends of the units counted for the dictionaries: of lines, and of sentences within them. A Java pattern.
_UNIT_END = r"\n|(?<=[.!?…])\s+(?=\p{Lu})"


def label_of(lang: Column) -> Column:
    """The first subtag in lower case; null where the label says nothing."""
    first = F.lower(F.split(F.trim(lang), "[-_]")[0])
    return F.when(first.isin("", "und", "xx"), None).otherwise(first)


class Classifier:
    """``dictionaries``: the raw content of each language's dictionary."""

    def __init__(self, dictionaries: dict[str, str]):
        import zstandard

        self.by_script: dict[str, list[str]] = {}
        self.encoders = {}
        self._pieces: dict[str, tuple | None] = {}
        for lang, content in sorted(dictionaries.items()):
            for level in LEVELS:
                raw = zstandard.ZstdCompressionDict(content.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=level)
                self.encoders[level, lang] = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False).compress
            self.by_script.setdefault(script_of(content) or "", []).append(lang)

    def sizes(self, text: str, script: str) -> dict[str, int]:
        """The size of a text by the dictionary of every language of its script; thoroughly if the quick encodings are not far apart."""
        langs = self.by_script.get(script, [])
        if len(langs) == 1:
            return {langs[0]: 0}
        raw = text.encode()
        quick, thorough = LEVELS
        out = {lang: len(self.encoders[quick, lang](raw)) for lang in langs}
        best = min(out.values(), default=0)
        near = [lang for lang in langs if out[lang] - best < max(FAR_BYTES, FAR_SHARE * out[lang])]
        if len(near) > 1:
            out |= {lang: len(self.encoders[thorough, lang](raw)) for lang in near}
        return out

    def piece(self, part: str) -> tuple | None:
        """``(sizes, letters, own language or null, margin, whether wrongly decoded)`` of a sentence; null without letters of a known script."""
        found = self._pieces.get(part, 0)
        if found == 0:
            if len(self._pieces) >= CACHED_PIECES:
                self._pieces.clear()
            found = self._pieces[part] = self._judged(part)
        return found

    def _judged(self, part: str) -> tuple | None:
        script = script_of(part)
        if script is None:
            return None
        clean = " ".join(_once(_URLISH.sub(" ", part) if _ODD_WORD.search(part) else part))
        letters = len("".join(_LETTERS.findall(clean))) * LETTER_WEIGHT.get(script, 1)
        sizes = self.sizes(clean, script) if letters else None
        if not sizes:
            return None
        garbled = script == "Latin" and 2 * len("".join(_ASCII_LETTERS.findall(clean))) < letters
        return (sizes, letters, *self._own(sizes, letters), garbled)

    def record(self, text: str) -> tuple[list[tuple[str, float]], list[str]]:
        """``(segments, near)``: the language and confidence of each stretch, and, where none is sure, the languages still possible."""
        pieces = [p for part in _CUT.split(text) if (p := self.piece(part))]
        if not pieces:
            return [], []
        first = pieces[0][2]
        if first and all(p[2] == first for p in pieces):  # the common case
            letters = sum(p[1] for p in pieces)
            return [(first, round(sum(p[3] * p[1] for p in pieces) / letters, 4))], []
        total: dict[str, float] = {}
        for sizes, letters, *_ in pieces:  # what each language saves against the worst of its script
            worst = max(sizes.values()) if len(sizes) > 1 else letters
            for lang, n in sizes.items():
                total[lang] = total.get(lang, 0.0) + worst - n
        main = max(sorted(total), key=lambda k: total[k])
        langs: list[tuple[str, float, int]] = []
        for sizes, letters, own, margin, garbled in pieces:
            if own != main and main in sizes and not (own and letters >= FAR_LETTERS and sizes[main] - sizes[own] >= FAR_BYTES and margin >= FAR_SHARE):
                # only a wide margin breaks with the rest of the record; else the nearer of it and the sentence before
                before = langs[-1][0] if langs and langs[-1][0] in sizes else main
                own = min((before, main), key=lambda k: sizes[k])
            elif main not in sizes:
                if letters < FEW_LETTERS:
                    continue  # a name or formula in another script
                if own is None and garbled:
                    continue
                if own is None:  # the nearer of the sentence before and what the record's sentences of this script save most in
                    side = max(sorted(sizes), key=lambda k: total[k])
                    before = langs[-1][0] if langs and langs[-1][0] in sizes else side
                    own = min((before, side), key=lambda k: sizes[k])
            langs.append((own, margin, letters))
        if not any(own for _, _, own, *_ in pieces) or not langs:
            best = min(sum(s.get(main, 0) for s, *_ in pieces), 10**9)
            sums = {k: sum(s.get(k, 10**6) for s, *_ in pieces) for k in {x for s, *_ in pieces for x in s}}
            near = sorted(k for k, v in sums.items() if v <= best + 2 * WIDE_BYTES)
            top = min(sums, key=lambda k: (sums[k], k))
            second = sorted(sums.values())[1] if len(sums) > 1 else sums[top]
            if len(near) > 1 or sum(n for _, n, *_ in pieces) < 6:
                return [(top, round(1 - sums[top] / second, 4) if second else 0.0)], near
            return [(top, round(1 - sums[top] / second, 4))], []
        runs: list[list] = []
        for lang, margin, letters in langs:
            if runs and runs[-1][0] == lang:
                runs[-1][1] += margin * letters
                runs[-1][2] += letters
            else:
                runs.append([lang, margin * letters, letters])
        return [(lang, round(m / n, 4)) for lang, m, n in runs], []

    @staticmethod
    def _own(sizes: dict[str, int], letters: int) -> tuple[str | None, float]:
        """The language whose encoding is smallest, if the margin is wide, and the margin."""
        if len(sizes) == 1:
            return next(iter(sizes)), 1.0
        n, m = sorted(sizes.values())[:2]
        best = min(lang for lang, size in sizes.items() if size == n)
        margin = 1 - n / m
        wide = letters >= FAR_LETTERS and m - n >= WIDE_BYTES and margin >= WIDE_SHARE or letters >= FEW_LETTERS and m - n >= FAR_BYTES and margin >= FAR_SHARE
        return best if wide else None, margin


def _once(text: str) -> list[str]:
    """The words of a text without those that are repeated: a word said ten times is no more of a language than said once."""
    words = text.split()
    if len(set(words)) == len(words):
        return words
    seen: set[str] = set()
    out = []
    for w in words:
        key = w.strip(".,;:!?").lower()
        if key not in seen:
            seen.add(key)
            out.append(w)
    return out


def script_of(text: str) -> str | None:
    """The script of most letters; scripts without spaces weigh more, as their letters say more."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else None
    best, most = None, 0
    for name, pattern in SCRIPTS:
        n = len("".join(pattern.findall(text))) * LETTER_WEIGHT.get(name, 1)
        if n > most:
            best, most = name, n
            if n > LETTER_WEIGHT["Han"] * (len(text) - n):
                break
    return best


@lru_cache(maxsize=2)
def _classifier(dictionaries: tuple[tuple[str, str], ...]) -> Classifier:
    return Classifier(dict(dictionaries))


def dictionaries(sentence_data: DataFrame, lang_sample: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[tuple[str, str], ...]:
    """The dictionary of each sampled language: its clean sentences, then recurring lines and sentences that mostly stand under its label.

    The dictionaries are the classifier's model: a bounded sample of labelled text (``sample_rows`` sentences, ``DICTIONARY_CHARS``
    of the most frequent lines), chosen by counts over all records. The ranking is cut in 64 parts per label first, so no task sorts all lines.
    """
    samples: dict[str, list[str]] = {}
    for r in lang_sample.where("text IS NOT NULL AND lang IS NOT NULL").orderBy("sample_id").limit(sample_rows).collect():
        samples.setdefault(r.lang, []).append(r.text)
    lines = sentence_data.where("text IS NOT NULL").select(label_of(F.col("lang")).alias("label"), F.explode(F.split("text", _UNIT_END)).alias("line"))
    lines = lines.where(F.length("line").between(*LINE_CHARS) & F.col("label").isin(list(samples))).withColumn("line", F.trim(F.regexp_replace("line", "[0-9]+", "#")))
    counts = lines.groupBy("line", "label").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("line").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("top"))
    ranked = seen.where((F.col("total") >= SIGHTINGS) & (F.col("top.n") >= PURE * F.col("total"))).select(F.col("top.label").alias("label"), "line", "total", F.pmod(F.xxhash64("line"), F.lit(64)).alias("part"))
    for groups in ("label, part", "label"):
        ranked = ranked.withColumn("chars", F.expr(f"sum(length(line) + 1) OVER (PARTITION BY {groups} ORDER BY total DESC, line)")).where(F.col("chars") <= DICTIONARY_CHARS)
    extra: dict[str, list[str]] = {}
    for r in ranked.orderBy("label", "total", "line").collect():
        extra.setdefault(r.label, []).append(r.line)
    return tuple((lang, "\n".join([*extra.get(lang, []), *own])) for lang, own in sorted(samples.items()))


def record_languages(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, label, segments``: the stretches of every record (``array<struct<lang, confidence>>``) beside its label."""
    content = dictionaries(sentence_data, lang_sample)
    samples = sample_sentences(lang_sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix, judge = repairer(samples).repair, _classifier(content).record
        for batch in batches:
            out = [judge(fix(t)[0]) for t in batch.column("text").to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(s) for s, _ in out)]), pa.int32())
            parts = [x for s, _ in out for x in s]
            pairs = pa.StructArray.from_arrays([pa.array([a for a, _ in parts], pa.string()), pa.array([float(c) for _, c in parts], pa.float64())], names=["lang", "confidence"])
            columns = [batch.column(c) for c in ("rec_id", "file_path", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pairs), pa.array([n for _, n in out], pa.list_(pa.string()))], names=["rec_id", "file_path", "label", "segments", "near"])

    rows = sentence_data.where("rec_id IS NOT NULL AND text RLIKE '\\\\S'").select("rec_id", "file_path", label_of(F.col("lang")).alias("label"), "text")
    schema = "rec_id bigint, file_path string, label string, segments array<struct<lang: string, confidence: double>>, near array<string>"
    found = cut_lineage(rows.mapInArrow(run, schema))

    sure = found.where("size(near) = 0 AND size(segments) > 0").groupBy("file_path", F.col("segments")[0]["lang"].alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    files = sure.groupBy("file_path").agg(F.max(F.struct("n", "lang")).alias("top")).select("file_path", F.col("top.lang").alias("file_lang"))
    open_ = found.where("size(near) > 0 OR size(segments) = 0").join(files, "file_path", "left")
    pick = (
        F.when(F.array_contains("near", F.col("file_lang")), F.col("file_lang"))
        .when(F.array_contains("near", F.col("label")), F.col("label"))
        .when(F.size("segments") > 0, F.col("segments")[0]["lang"])
        .otherwise(F.col("file_lang"))
    )
    confidence = F.coalesce(F.get("segments", F.lit(0))["confidence"], F.lit(0.0))
    decided = open_.withColumn("lang", pick).where("lang IS NOT NULL").select("rec_id", "label", F.array(F.struct("lang", confidence.alias("confidence"))).alias("segments"))
    return found.where("size(near) = 0 AND size(segments) > 0").select("rec_id", "label", "segments").unionByName(decided)


def language_report(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, seg_no, lang, confidence`` of the records that are mixed or whose label is missing or wrong."""
    rows = record_languages(sentence_data, lang_sample)
    wrong = rows.where(F.expr("size(segments) > 1 OR label IS NULL OR label <> segments[0].lang"))
    return wrong.select("rec_id", F.posexplode("segments").alias("i", "s")).select("rec_id", (F.col("i") + 1).cast("int").alias("seg_no"), "s.lang", "s.confidence").distinct()
