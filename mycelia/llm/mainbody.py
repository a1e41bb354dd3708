"""Main body of web pages by composite text density.

The stored pages have lost their tags, so their tree is rebuilt from lines: the page is the body node, sections are its children,
lines are theirs, and what separators part inside a line are the leaves. A section is a run of lines that hold more
than links. What is a link is told by the corpus: lines and line openings that recur on a share of all pages, or of the pages of their
site, in words that running prose does not use, and that are not made to a pattern around words of prose, are navigation, notices and the like; their characters count as link characters. A
short line without the end of a sentence is a link too, unless it heads prose: teasers are such lines, and so are headings. Every node gets its
link-adjusted characters per tag

    density = C/T * log_b( C/LC * T/LT ),   b = ln( C/(C-LC) * LC + LC_body/C_body * C + e )

with 1 for a zero divisor (LC_body, C_body: link and all characters of the page). The section with the greatest sum of its
lines' densities is the main subtree. The threshold is the least density on the path from the body through it to its sparsest line; every
section that reaches it is main body, and the title above the first one.

Defined results: blank lines are never reported; a page without any prose or list keeps only its
title candidate; null texts hold no line; a repeated record counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mycelia.llm.encoding import repairer, sample_sentences
from mycelia.llm.pages import by_file, file_rows
from mycelia.session import cut_lineage

#: A line recurs from so many pages, and from this share of all pages or that of the pages of its site.
RECURS, PAGES_SHARE, SITE_SHARE = 3, 1 / 5000, 1 / 100
#: A word is one of prose, and a shape one of titles and sentences made to a pattern, from so many lines and this share of all of them. The shares bound both models.
LEAST_LINES, WORD_SHARE, SHAPE_SHARE = (3, 4), 1 / 1000, 1 / 20_000

_WORDS = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r"\s[|·›>•/]\s|\s{3,}|\]\s*\[|\s»\s")
_BULLET = re.compile(r"^\s*(?:[•\-–—*▪‣]|\d{1,3}[.)])\s+")
_ENDS = re.compile(r"[.!?…।。！？][)\]”\"“»’』」]*(?:\s*\[\d+\])?\s*$|[。！？]")
_THAI = re.compile(r"[ก-๛]{12,}")
_DENSE = re.compile(r"[ऀ-෿฀-໿぀-ヿ一-鿿]{2,}")


def norm(line: str, source: str | None) -> str:
    """A line without case, numbers, signs and the name of its source."""
    if source:
        line = line.replace(source, " ")
    return " ".join(_WORDS.findall(line.lower()))


def opening(line: str, source: str | None) -> str | None:
    """What stands before a colon, if it is short: labels such as those of tags or paths."""
    m = re.match(r"^\W*([^:：]{2,40}?)\s?[:：]\s", line + " ")
    key = norm(m.group(1), source) if m else ""
    return f"{key}:" if key else None


def words_of(key: str) -> list[str]:
    if not _DENSE.search(key):
        return key.split()
    out = [w for w in key.split() if not _DENSE.match(w)]
    return out + [run[i : i + 2] for run in _DENSE.findall(key) for i in range(len(run) - 1)]


def is_prose(line: str) -> bool:
    """Running text by its form: long enough, with the end of a sentence and without separators."""
    text = line.strip()
    if text.startswith("©") or "«" not in text and _SEPARATOR.search(text):
        return False
    if _THAI.search(text):
        return True
    if text.count("?") + text.count("\ufffd") > len(text) // 3:  # letters lost
        return len(text) >= 40
    return bool(_ENDS.search(text)) and (len(text) >= 30 or bool(_DENSE.search(text)) and len(text) >= 8 or len(text.split()) >= 4)


class Page:
    """Labels the lines of a page. ``model``: recurring keys, words of prose and shapes of titles; ``site``: keys that recur on the page's site."""

    def __init__(self, model: dict, site: frozenset[str] = frozenset()):
        self.recurring, self.prose_words, self.shapes, self.site = model["recurring"], model["words"], model["shapes"], site

    def recurs(self, key: str) -> bool:
        return key in self.recurring or key in self.site

    def affinity(self, key: str) -> float:
        """The share of words that prose uses."""
        words = words_of(key)
        return sum(w in self.prose_words for w in words) / len(words) if words else 0.0

    def link_share(self, line: str, source: str | None) -> float:
        """The share of a line's characters that are link characters."""
        text = line.strip()
        key = norm(text, source)
        parts = [text] if "«" in text else [p for p in _SEPARATOR.split(text) if p.strip()]
        if not key and is_prose(text):
            return 0.0
        if "©" in text or "@" in text or not key:
            return 1.0
        if len(parts) > 1 and sum(len(p.split()) for p in parts) / len(parts) <= 4:
            return 1.0
        head = opening(text, source)
        if head and self.recurs(head) and self.affinity(head[:-1]) < 0.9:
            return 1.0
        recurs = self.recurs(key)
        affinity = self.affinity(key)
        if is_prose(text):
            return 1.0 if recurs and affinity < 0.8 and shape(key, self.prose_words) not in self.shapes else 0.0
        if re.match(r"^\[.*\]$", text) or text.endswith("›"):
            return 1.0
        if recurs and affinity < 0.67:
            return 1.0
        return 0.5

    @staticmethod
    def density(node: tuple[float, float, float, float], body: tuple[float, float, float, float]) -> float:
        """The composite text density of a node ``(characters, link characters, tags, link tags)``."""
        c, lc, t, lt = node
        base = math.log(c / max(c - lc, 1.0) * lc + body[1] / max(body[0], 1.0) * c + math.e)
        return c / t * math.log(max(c / max(lc, 1.0) * t / max(lt, 1.0), 1.0)) / math.log(max(base, 1.0 + 1e-9))

    def node(self, line: str, share: float) -> tuple[float, float, float, float]:
        """A line as a node: each part between separators is a tag of its own."""
        text = line.strip()
        tags = 1.0 + len(_SEPARATOR.findall(text))
        return float(len(text)), len(text) * share, tags, tags * share

    def outside(self, lines: list[str], source: str | None) -> list[bool]:
        """For every line whether it is outside the main body (blank lines are)."""
        at = [i for i, x in enumerate(lines) if x.strip()]
        form = [self.link_share(lines[i], source) for i in at]
        items = [s < 1 and self.is_item(lines[i], source) for i, s in zip(at, form, strict=True)]
        shares = self.resolved([lines[i] for i in at], form, items, source)
        nodes = [self.node(lines[i], s) for i, s in zip(at, shares, strict=True)]
        body = _sum(nodes)
        dense = [self.density(n, body) for n in nodes]
        sections: list[list[int]] = [[]]
        for k, d in enumerate(dense):
            if d > 0:
                sections[-1].append(k)
            elif sections[-1]:
                sections.append([])
        sections = [s for s in sections if s]
        main: set[int] = set()
        if sections:
            own = [self.density(_sum([nodes[k] for k in s]), body) for s in sections]
            best = max(range(len(sections)), key=lambda j: sum(dense[k] for k in sections[j]))
            threshold = min(self.density(body, body), own[best], *(dense[k] for k in sections[best]))
            main = {k for s, d in zip(sections, own, strict=True) if d >= threshold for k in s}
        title = self.title(lines, at, form, items, min(main, default=len(at)), source)
        if title is not None:
            main.add(title)
        out = [True] * len(lines)
        for k in main:
            out[at[k]] = False
        return out

    def resolved(self, lines: list[str], form: list[float], items: list[bool], source: str | None) -> list[float]:
        """The share of link characters of every line: items are text, and a short line is text if it heads text, else a link."""
        shares = [0.0 if item else s for s, item in zip(form, items, strict=True)]
        begun = next((k for k, s in enumerate(shares) if s == 0.0), len(shares))
        heads, apart = False, False  # whether the next line that is no link is prose, and whether links stand between
        for k in range(len(lines) - 1, -1, -1):
            if shares[k] == 0.5:
                # links stand between a heading and its text only within the article
                shares[k] = 0.0 if heads and (k > begun or not apart) and self.is_heading(lines[k], source) else 1.0
                heads, apart = shares[k] == 0.0, False
            elif shares[k] == 0.0:
                heads, apart = not items[k], False
            else:
                apart = True
        return shares

    def is_item(self, line: str, source: str | None) -> bool:
        """An item of a list of the article: a bullet before several words that are no navigation of many pages."""
        return bool(_BULLET.match(line)) and ("," in line or "、" in line or len(norm(line, source).split()) >= 2)

    def is_heading(self, line: str, source: str | None) -> bool:
        """A short line in the words of the prose around it."""
        words = words_of(norm(line, source))
        return 1 <= len(line.split()) <= 3 and bool(words) and words[0] in self.prose_words

    def title(self, lines: list[str], at: list[int], shares: list[float], items: list[bool], first: int, source: str | None) -> int | None:
        """The nearest line above the body that may be a title: several words, no label, no link."""
        # without a body below it, the first such line of the page
        for k in range(first - 1, -1, -1) if first < len(at) else range(len(at)):
            text = lines[at[k]].strip()
            if (shares[k] == 0.5 or self.may_be_title(text, source)) and not items[k] and not _BULLET.match(text) and (len(text.split()) >= 3 or _DENSE.search(text) and len(text) >= 5):
                return k
        return None


    def may_be_title(self, text: str, source: str | None) -> bool:
        """Whether a line is one of many made to one pattern around words of prose."""
        if self.link_by_form(text, source):
            return False
        return shape(norm(text, source), self.prose_words) in self.shapes

    def link_by_form(self, text: str, source: str | None) -> bool:
        head = opening(text, source)
        label = head is not None and self.recurs(head) and self.affinity(head[:-1]) < 0.9
        return label or "©" in text or "@" in text or bool(re.match(r"^\[.*\]$", text)) or "«" not in text and bool(_SEPARATOR.search(text))


def shape(key: str, prose_words: frozenset) -> str:
    """A line with a gap for every word of prose."""
    return " ".join("_" if w in prose_words else w for w in words_of(key))


def _sum(nodes: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float]:
    c, lc, t, lt = (sum(n[k] for n in nodes) for k in range(4))
    return c, lc, t, lt


def page_model(sentence_data: DataFrame, samples: tuple[str, ...]) -> tuple[dict, DataFrame | None]:
    """Recurring lines and line openings, the words of prose and the shapes of titles, each bounded by a share of pages or lines; and
    ``page, keys``: what recurs on a page's site but on few pages of all, null if nothing does. A page goes by its first record.
    """

    def keys(records: list[tuple]) -> list[tuple]:
        fix = repairer(samples).repair
        seen: dict[str, bool] = {}
        for _, source, text, *_ in records:
            for line in (fix(text)[0] or "").split("\n"):
                if line.strip():
                    key = norm(line, source)
                    if key:
                        seen[key] = is_prose(line)
                    head = opening(line, source)
                    if head:
                        seen[head] = False
        seen.setdefault("", False)  # counts the pages
        return [(records[0][0], records[0][1], k, p) for k, p in seen.items()]

    found = cut_lineage(file_rows(sentence_data, ".html").mapInPandas(by_file(keys, ["page", "source", "key", "prose"]), "page bigint, source string, key string, prose boolean"))
    sites = found.groupBy("source", "key").agg(F.count(F.lit(1)).alias("pages"), F.max("prose").alias("prose"))
    sites = cut_lineage(sites)
    counts = sites.groupBy("key").agg(F.sum("pages").alias("pages"), F.max("prose").alias("prose"))
    total = counts.where("key = ''").first()
    least = max(RECURS, (total.pages if total else 0) * PAGES_SHARE)
    lines = cut_lineage(counts.where("key <> ''"))
    recurring = lines.where(F.col("pages") >= least).select("key").collect()  # no more than lines a page / PAGES_SHARE

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for key in batch["key"]:
                n.update(set(words_of(key)))
            yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    # distinct lines that do not recur, so that notices have no say in what prose is
    plain = lines.where(F.col("prose") & (F.col("pages") < least))
    words = plain.select("key").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    prose_words = frozenset(r.word for r in words.where(F.col("n") >= max(LEAST_LINES[0], plain.count() * WORD_SHARE)).collect())

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = Counter(shape(k, prose_words) for k in batch["key"])
            n = {k: v for k, v in n.items() if "_" in k.split()}
            yield pd.DataFrame(list(n.items()), columns=["shape", "n"])

    other = lines.where(~F.col("key").endswith(":")).select("key")
    shapes = other.mapInPandas(patterns, "shape string, n bigint").groupBy("shape").agg(F.sum("n").alias("n"))
    frequent = shapes.where(F.col("n") >= max(LEAST_LINES[1], other.count() * SHAPE_SHARE)).collect()

    of_site = sites.where("key = ''").select(F.col("source").alias("site"), F.col("pages").alias("of_site"))
    rare = lines.where((F.col("pages") >= RECURS) & (F.col("pages") < least)).select("key")
    local = sites.where("key <> ''").join(rare, "key", "left_semi").join(of_site, F.col("source").eqNullSafe(F.col("site")))
    local = cut_lineage(local.where((F.col("pages") >= RECURS) & (F.col("pages") >= F.col("of_site") * SITE_SHARE)).select("site", F.col("key").alias("local")))
    per_page = None
    if not local.isEmpty():
        own = found.join(local, F.col("source").eqNullSafe(F.col("site")) & (F.col("key") == F.col("local")))
        per_page = own.groupBy("page").agg(F.collect_set("key").alias("keys"))
    return {"recurring": frozenset(r.key for r in recurring), "words": prose_words, "shapes": frozenset(r["shape"] for r in frequent)}, per_page


def lines_outside(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``rec_id, line_no`` of each non-blank line of a web page that is no part of its main body."""
    samples = sample_sentences(lang_sample)
    model, per_page = page_model(sentence_data, samples)

    def per_file(records: list[tuple]) -> list[tuple]:
        fix = repairer(samples).repair
        where: list[tuple[int, int]] = []
        lines: list[str] = []
        site: set[str] = set()
        for rec_id, _, text, *keys in records:
            if keys and keys[0] is not None:
                site.update(keys[0])
            for i, line in enumerate((fix(text)[0] or "").split("\n")):
                where.append((rec_id, i))
                lines.append(line)
        out = Page(model, frozenset(site)).outside(lines, records[0][1])
        return [w for w, o, line in zip(where, out, lines, strict=True) if o and line.strip()]

    rows, extra = file_rows(sentence_data, ".html"), ()
    if per_page is not None:  # the keys of a page travel with its first record
        joined = rows.join(per_page.withColumnRenamed("page", "rec_id"), "rec_id", "left")
        rows, extra = joined.repartition("file_path", "stretch").sortWithinPartitions("file_path", "stretch", "rec_id"), ("keys",)
    return rows.mapInPandas(by_file(per_file, ["rec_id", "line_no"], extra), "rec_id bigint, line_no int")


def main_texts(sentence_data: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """``file_path, rec_id, line_no, line``: the lines of the main bodies as stored (places stay those of the stored text)."""
    lines = file_rows(sentence_data, ".html").where("own").dropDuplicates(["rec_id"]).select("file_path", "rec_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line RLIKE '\\\\S'")
    return lines.join(lines_outside(sentence_data, lang_sample), ["rec_id", "line_no"], "left_anti").select("file_path", "rec_id", "line_no", "line")
