"""Text decoded with the wrong character encoding: find the garbled spans and turn them back.

For every pair (true encoding, wrong encoding) the garbled form of every character is computed once
per worker and put into one multi-pattern automaton:

* *multi-byte pairs* (UTF-8 read as a single-byte code page): the garbled first two bytes of every
  two-, three- and four-byte sequence. A hit is a span as long as its bytes decode; neighbouring
  spans are joined, replaced, and the result is looked at again for text garbled twice.
* *single-byte pairs*: the garbled forms of the letter trigrams of the sample sentences, less those that
  occur in correct text. A word whose trigrams are mostly hits of one pair is turned back.

Only matched spans change; correct text beside them stays as it is, unusual characters included.
Replacement characters and question marks in the place of letters are *lost*: nothing tells what
stood there.

Defined results: null and empty text and lemmas are never garbled; a repeated record gives its rows once;
a record with a null key is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages as which UTF-8 is read. Fixed values.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "koi8-r", "cp866", "cp437", "cp850")
#: (true, wrong) pairs of single-byte code pages. Fixed values.
SINGLE = (
    ("cp1251", "cp1252"),
    ("cp1251", "mac_roman"),
    ("cp866", "cp1251"),
    ("cp866", "cp1252"),
    ("koi8-r", "cp1251"),
    ("koi8-r", "cp1252"),
    ("cp1251", "koi8-r"),
    ("cp1251", "cp866"),
    ("iso8859-5", "cp1251"),
    ("mac_cyrillic", "cp1251"),
    ("cp1252", "cp1251"),
    ("cp1252", "cp1250"),
    ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
)


@lru_cache(maxsize=None)
def byte_to_char(page: str) -> tuple[str, ...]:
    """How a code page reads each byte; bytes it leaves undefined come out as control characters."""
    return tuple(bytes([b]).decode(page, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=None)
def char_to_byte(page: str) -> dict[str, int]:
    table = {chr(b): b for b in range(0x80, 0xA0)}
    table |= {c: b for b, c in enumerate(byte_to_char(page))}
    return table


def to_bytes(text: str, page: str) -> bytes | None:
    try:
        return bytes(map(char_to_byte(page).__getitem__, text))
    except KeyError:
        return None


#: Blocks of the characters that texts in the sampled languages hold. Fixed values.
BLOCKS = (
    (0x00A0, 0x024F), (0x0300, 0x036F), (0x0400, 0x052F), (0x0900, 0x097F), (0x0E00, 0x0E7F), (0x2010, 0x2060),
    (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFE0F, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF), (0x2000, 0x200F), (0x2022, 0x2027), (0x25A0, 0x27BF),
)
def _plausible(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in BLOCKS)


class Repairer:
    """Finds and replaces garbled spans. ``samples``: clean sentences of the languages in use."""

    def __init__(self, samples: list[str]):
        import ahocorasick

        self.multi = ahocorasick.Automaton()
        self.pages = {page: (char_to_byte(page), frozenset(byte_to_char(page)[0x80:0xC0])) for page in WRONG_FOR_UTF8}
        prefixes: dict[str, list[str]] = {}
        for page in WRONG_FOR_UTF8:
            to = byte_to_char(page)
            for lead in range(0xC2, 0xF5):
                for cont in range(0x80, 0xC0):
                    if page in WRONG_FOR_UTF8[5:] and to[lead].isalpha() and to[cont].isalpha():
                        continue  # ordinary words of other languages hold such pairs
                    prefixes.setdefault(to[lead] + to[cont], []).append(page)
        for seq, pages in prefixes.items():
            self.multi.add_word(seq, pages)
        self.multi.make_automaton()

        words = {w for s in samples for w in re.findall(r"[^\W\d_]+", s)}
        words |= {w.lower() for w in words} | {w.capitalize() for w in words} | {w.upper() for w in words}
        genuine = {g for w in words for g in _grams(w)}
        garbled: dict[str, set[int]] = {}
        for k, (true, wrong) in enumerate(SINGLE):
            to = byte_to_char(wrong)
            back = char_to_byte(true)
            cyrillic = true not in ("cp1252", "mac_roman", "cp437", "cp850")
            for w in words:
                if cyrillic != ("а" <= w[0].lower() <= "ї") and cyrillic:
                    continue
                if not cyrillic and (w.isascii() or not all(c in back for c in w)):
                    continue
                if not all(c in back for c in w):
                    continue
                for g in _grams(w):
                    if g.strip("^$").isascii():
                        continue
                    seq = "".join(c if c in "^$" else to[back[c]] for c in g)
                    if seq not in genuine and not seq.strip("^$").isascii():
                        garbled.setdefault(seq, set()).add(k)
        self.single = ahocorasick.Automaton()
        for seq, pairs in garbled.items():
            self.single.add_word(seq, pairs)
        self.single.make_automaton()
        self.genuine = genuine
        self._turned: dict[str, tuple[str | None, bool]] = {}
        #: Words that need no turning; results do not depend on what is kept.
        self._fine: set[str] = set()
        self._read: dict[str, list[tuple[str | None, float]]] = {}

    # -- UTF-8 read as a code page -------------------------------------------------------------
    def _multi_once(self, text: str) -> list[tuple[int, int, str]]:
        spans: dict[str, list[list[int]]] = {}
        for end, pages in self.multi.iter(text):
            start = end - 1
            for page in pages:
                own = spans.setdefault(page, [])
                if own and own[-1][1] > start:
                    continue
                n = self._length(text, start, page)
                if not n:
                    continue
                if own and own[-1][1] == start:
                    own[-1][1] = start + n
                    own[-1][2] += 1
                else:
                    own.append([start, start + n, 1])
        if not spans:
            return []
        found: list[tuple[int, int, str]] = []
        for page, own in spans.items():
            long = any(n > 1 for _, _, n in own)
            for a, b, n in own:
                if n > 1 or self._alone(text, a, b):
                    raw = to_bytes(text[a:b], page)
                    fixed = raw.decode("utf-8")
                    foreign = n == 1 and not long and b - a == 2 and page == "mac_roman" and ord(fixed[0]) >= 0x250 and not 0x2000 <= ord(fixed[0]) < 0x2300
                    if not foreign and all(map(_plausible, fixed)):
                        found.append((a, b, fixed))
        # the longest reading first; overlapping readings by other code pages give way
        found.sort(key=lambda s: (s[0] - s[1], s[0]))
        taken: list[tuple[int, int, str]] = []
        for a, b, fixed in found:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, fixed))
        return sorted(taken)

    def _length(self, text: str, start: int, page: str) -> int:
        table, follow = self.pages[page]
        lead = table.get(text[start], 0)
        n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        chars = text[start : start + n]
        if len(chars) < n or not all(c in follow for c in chars[2:]):
            return 0
        try:
            bytes(map(table.__getitem__, chars)).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return 0
        return n

    @staticmethod
    def _alone(text: str, a: int, b: int) -> bool:
        """Whether one garbled character by itself is evidence: no pair of ordinary letters inside a word is."""
        seq = text[a:b]
        beside = text[max(0, a - 1) : a] + text[b : b + 1]
        if all(c.isalpha() for c in seq) and not _ASCII_LETTER.search(beside):
            if seq[0].isupper() and seq[-1].islower() and all("Ѐ" <= c <= "ӿ" for c in seq):
                return not (b < len(text) and text[b].isalpha())  # a capital that begins an ordinary word
            if seq.isupper() and all("Ѐ" <= c <= "ӿ" for c in seq):
                return False
            if seq.lower() in ("äż", "îń"):
                return False
        return not any(c.isspace() and c != "\xa0" for c in seq)

    # -- one code page read as another ---------------------------------------------------------
    def _single_once(self, text: str) -> list[tuple[int, int, str]]:
        turned: list[tuple[int, int, str]] = []
        weak: list[tuple[int, int, str]] = []
        if self._fine.issuperset(_WORD.findall(text)):
            return turned
        for m in _WORD.finditer(text):
            word = m.group()
            if word.isascii():
                if len(self._fine) < 400_000:
                    self._fine.add(word)
                continue
            seen = self._turned.get(word)
            if seen is None:
                fixed = self._best(word)
                seen = fixed, not fixed and not _ASCII_LETTER.search(word) and self._known(word) < 0.35
                if len(self._turned) < 200_000:
                    self._turned[word] = seen
            fixed, open_ = seen
            if not fixed and not open_ and len(self._fine) < 400_000:
                self._fine.add(word)
            if fixed:
                turned.append((m.start(), m.end(), fixed))
            elif open_:
                weak.append((m.start(), m.end(), word))
        if weak:
            turned += self._together(weak)
            turned.sort()
        return turned

    def _together(self, weak: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Words too short or rare to tell by themselves, turned back if one pair explains all of them."""
        size = sum(b - a for a, b, _ in weak)
        before = sum(self._known(w) * len(w) for _, _, w in weak) / size
        best: tuple[float, list[tuple[int, int, str]]] = (max(before + 0.25, 0.35), [])
        if size < 5:
            return []
        read = [self._readings(w) for _, _, w in weak]
        for k in range(len(SINGLE)):
            if all(r[k][0] is not None for r in read):
                score = sum(r[k][1] for r in read) / size
                if score > best[0]:
                    best = (score, [(a, b, r[k][0]) for (a, b, _), r in zip(weak, read, strict=True)])
        return best[1]

    def _readings(self, word: str) -> list[tuple[str | None, float]]:
        """``(reading, known letters)`` of a word by every pair, kept for words that come again."""
        out = self._read.get(word)
        if out is None:
            turned = (self._turn(word, k) for k in range(len(SINGLE)))
            out = [(f, 0.0 if f is None else self._known(f) * len(f)) for f in turned]
            if len(self._read) < 50_000:
                self._read[word] = out
        return out

    def _best(self, word: str) -> str | None:
        """The word turned back by the pair that explains it, or null where it needs no turning."""
        own: dict[int, int] = {}
        for _, pairs in self.single.iter(f"^{word}$"):
            for k in pairs:
                own[k] = own.get(k, 0) + 1
        if not own:
            return None
        before = self._known(word)
        odd = self._odd(word)
        if not odd and (before >= 0.35 or len(word) < 4):
            return None
        best = (max(before + 0.3, 0.66), "")
        for k, n in own.items():
            fixed = self._turn(word, k)
            if fixed and fixed != word and n >= max(1 if odd else 2, len(word) // 3):
                score = self._known(fixed)
                if score > best[0] or (score == best[0] and fixed < best[1]):
                    best = (score, fixed)
        return best[1] or None

    def _known(self, word: str) -> float:
        """The share of a word's trigrams that occur in clean words."""
        grams = _grams(word)
        return sum(g in self.genuine for g in grams) / len(grams)

    @staticmethod
    def _odd(word: str) -> bool:
        """Whether a word mixes scripts or holds signs no word holds."""
        latin = any("a" <= c <= "z" or "A" <= c <= "Z" for c in word)
        other = any("Ѐ" <= c <= "ӿ" for c in word)
        signs = any(not c.isalpha() and c not in "'’-" for c in word)
        return (latin and other) or signs

    @staticmethod
    def _turn(word: str, k: int) -> str | None:
        true, wrong = SINGLE[k]
        raw = to_bytes(word, wrong)
        if raw is None:
            return None
        to = byte_to_char(true)
        fixed = "".join(to[b] for b in raw)
        return fixed if all(c.isalpha() or c in "'’-" for c in fixed) else None

    # -- both ----------------------------------------------------------------------------------
    def repair(self, text: str | None) -> tuple[str | None, str | None]:
        """``(text, state)``: state is ``restorable``, ``lost`` or null where nothing is garbled."""
        return self.repair_mapped(text)[:2]

    def repair_mapped(self, text: str | None) -> tuple[str | None, str | None, list[int] | None]:
        """As :meth:`repair`, with the place in the given text of every character of the repaired one (null if nothing changed)."""
        if not text:
            return text, None, None
        lost = bool(_LOST.search(text))
        at: list[int] | None = None
        if not text.isascii():
            for _ in range(3):  # text may be garbled more than once; a pass that finds nothing is the last
                spans = self._multi_once(text)
                if not spans:
                    break
                text, at = _replace(text, at or list(range(len(text))), spans)
            spans = self._single_once(text)
            if spans:
                text, at = _replace(text, at or list(range(len(text))), spans)
        if not lost and "?" in text:
            lost = self._questioned(text)
        return text, "lost" if lost else "restorable" if at is not None else None, at

    def _questioned(self, text: str) -> bool:
        """Question marks in the place of letters or quotes."""
        if "http" in text:
            text = _URL.sub(" ", text)
        return bool(_QUESTIONED.search(text))


def _replace(text: str, at: list[int], spans: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    """Replaces ``spans`` and keeps the place of every character: a span's bytes are dealt out in order."""
    pieces: list[str] = []
    places: list[int] = []
    last = 0
    for a, b, fixed in spans:
        pieces += text[last:a], fixed
        places += at[last:a]
        widths = [1] * len(fixed) if b - a == len(fixed) else [len(c.encode()) for c in fixed]
        i = a
        for w in widths:
            places.append(at[min(i, b - 1)])
            i += w
        last = b
    return "".join(pieces) + text[last:], places + at[last:]


def _grams(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + 3] for i in range(len(marked) - 2)] or [marked]


_WORD = re.compile(r"(?:[^\s!-&(-,./:-@\[-`{-~–—…“”„°\u0900-\u0e7f\u3000-\u9fff\uff00-\uffef]|[\xa0\xad]){2,}")
_ASCII_LETTER = re.compile("[A-Za-z]")
_LOST = re.compile("�")
_URL = re.compile(r"\S*(?:https?://|www\.)\S*")
#: a mark between letters, a run of marks that is no end of a sentence, or a mark before a word after a blank
_QUESTIONED = re.compile(r"[^\W\d_]\?[^\W\d_]|\?{3,}|(?:^|\s)\?{1,2}[^\W\d_]|\s\?[,;:]|[^\W\d_]\?{2,}[^\W\d_?]")


@lru_cache(maxsize=2)
def repairer(samples: tuple[str, ...]) -> Repairer:
    return Repairer(list(samples))


#: Clean sentences that travel with the tasks at most; a table of samples is small and fixed, and each one adds trigrams.
SAMPLE_ROWS = 5_000


def sample_sentences(lang_sample: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[str, ...]:
    """The clean sentences by which garbled words are told, in the order of their ids; a longer table is an error, not cut."""
    rows = lang_sample.where("text IS NOT NULL").orderBy("sample_id").limit(sample_rows + 1).collect()
    if len(rows) > sample_rows:
        raise ValueError(f"more than {sample_rows} sample sentences")
    return tuple(r.text for r in rows)


def repaired_records(sentence_data: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """``rec_id, text, text_state, lemmas, lemma_state``, one row per input row, in one narrow pass.

    ``text`` and ``lemmas`` are turned back as far as possible; the states are null where nothing is garbled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer(samples).repair
        seen: dict[str, tuple] = {}
        for batch in batches:
            texts, states, lemmas, lemma_states = [], [], [], []
            for text, items in zip(batch["text"], batch["lemmas"], strict=True):
                t, s = fix(text)
                out, marks = [], set()
                for x in [] if items is None else items:
                    if not x or (x.isascii() and "?" not in x):
                        out.append(x)
                        continue
                    r = seen.get(x)
                    if r is None:
                        r = fix(x)
                        if len(seen) < 200_000:
                            seen[x] = r
                    out.append(r[0])
                    marks.add(r[1])
                texts.append(t)
                states.append(s)
                lemmas.append(None if items is None else out)
                lemma_states.append("lost" if "lost" in marks else "restorable" if "restorable" in marks else None)
            yield pd.DataFrame({"rec_id": batch["rec_id"], "text": texts, "text_state": states, "lemmas": lemmas, "lemma_state": lemma_states})

    cols = sentence_data.where("rec_id IS NOT NULL").select("rec_id", "text", F.col("tokens.lemma").alias("lemmas"))
    return cols.mapInPandas(run, "rec_id bigint, text string, text_state string, lemmas array<string>, lemma_state string")


def garbled_records(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, place, state`` of every record garbled in ``text`` or in a ``lemma``."""
    rows = repaired_records(sentence_data, sample_sentences(lang_sample)).select("rec_id", "text_state", "lemma_state")
    places = F.expr("inline(array(struct('text' AS place, text_state AS state), struct('lemma' AS place, lemma_state AS state)))")
    return rows.where("text_state IS NOT NULL OR lemma_state IS NOT NULL").select("rec_id", places).where("state IS NOT NULL").distinct()


def repaired_texts(rows: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """``rows`` (with ``text``) plus ``fixed``, ``state`` and ``places``: the place in ``text`` of every character of ``fixed``.

    ``places`` is null where nothing changed. Clashing columns of ``rows`` are replaced.
    """
    from pyspark.sql import types as T

    rows = rows.drop("fixed", "state", "places")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer(samples).repair_mapped
        for batch in batches:
            out = [fix(t) for t in batch["text"]]
            yield batch.assign(fixed=[o[0] for o in out], state=[o[1] for o in out], places=pd.Series([o[2] for o in out], index=batch.index, dtype=object))

    schema = T.StructType([*rows.schema.fields, T.StructField("fixed", T.StringType()), T.StructField("state", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    return rows.mapInPandas(run, schema)
