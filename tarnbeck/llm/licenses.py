"""Licence scans by patience alignment.

Words that are unique to both a passage and a template anchor the two; the longest increasing run of anchors holds, and
the gaps between its neighbours, and before and after it, are aligned the same way. The template's coverage is the share
of its words that were aligned.

A gap without a unique word is anchored by words that are as frequent in it as in the template's, in order.

A find is an alignment that covers COVERED of the template or more, and that has what tells the licence from others: of short notices and
headers, the words that name it and each number in them; of any template, most of the words that the alignment with each similar
template leaves out; and no word inside that makes another licence of it. So a name or number that was changed gives no find.

A text is not aligned as a whole at first, or a notice that occurs twice would leave no unique word: every passage of at most
SLACK * n + 2 words that starts with a word of the template is aligned, unless too few of the template's words occur in it (each
counted as often as the template has it). A find starts at its first aligned word, and the next one of that template begins after its
last. What lies between finds is then aligned whole, so that a licence with much put in between is found as well: its
parts hold together where the gap is at most REACH times the aligned words on its smaller side. Of the finds of all templates, those
that overlap a better one go: better means more aligned words, then a higher coverage, then the name.

Each row is scanned by itself, whole, in one pass without a shuffle. Defined results: a null or empty text has no licence
(null), coverage 0 and no finds; repeated rows are scanned each; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.llm.columns import free_names, with_python_columns
from tarnbeck.llm.common import table
from tarnbeck.llm.license_texts import TEMPLATES

COVERED, SLACK, REACH = 0.8, 1.5, 8
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first part, a longest run whose second parts rise."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        if at == len(tails):
            tails.append(b)
            ends.append(k)
        else:
            tails[at], ends[at] = b, k
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def anchored(text: list, template: list, gap: tuple[int, int, int, int], words: set) -> list[tuple[int, int]]:
    """The longest rising run of anchors in a gap: its ``words``, each occurrence with the template's of the same rank."""
    a, z, b, y = gap
    places: dict = {}
    for k in range(b, y):
        if template[k] in words:
            places.setdefault(template[k], []).append(k)
    left = {w: iter(ks) for w, ks in places.items()}
    return rising([(k, next(left[text[k]])) for k in range(a, z) if text[k] in words])


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned positions (text, template), both rising."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, z, b, y = stack.pop()
        # equal words at the ends of a gap hold without an anchor
        while a < z and b < y and text[a] == template[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < z and b < y and text[z - 1] == template[y - 1]:
            z, y = z - 1, y - 1
            out.append((z, y))
        if a == z or b == y:
            continue
        mine, theirs = Counter(text[a:z]), Counter(template[b:y])
        once = {w for w, n in theirs.items() if n == 1 and mine.get(w) == 1}
        held = anchored(text, template, (a, z, b, y), once or {w for w, n in theirs.items() if mine.get(w) == n})
        if not held:
            continue
        out += held
        for (p, q), (r, s) in zip([(a - 1, b - 1), *held], [*held, (z, y)], strict=True):
            if r - p > 1 and s - q > 1:
                stack.append((p + 1, r, q + 1, s))
    return sorted(out)


def chains(held: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The alignment, cut where a gap in the text is wider than REACH times the aligned words on its smaller side."""
    out, stack = [], [held]
    while stack:
        part = stack.pop()
        gaps = [(part[k + 1][0] - part[k][0] - 1) / min(k + 1, len(part) - k - 1) for k in range(len(part) - 1)]
        widest = max(range(len(gaps)), key=gaps.__getitem__, default=None)
        if widest is None or gaps[widest] <= REACH:
            out.append(part)
        else:
            stack += [part[: widest + 1], part[widest + 1 :]]
    return out


def parts_of(word: str) -> set[str]:
    """A word and what it is joined from; a number stays whole."""
    parts = set(word.split("-"))
    return parts | {x for p in parts if not p[0].isdigit() for x in p.split(".")}


def is_short(name: str) -> bool:
    return name.endswith(("-notice", "-header"))


def naming_places(name: str, words: list[str]) -> list[list[int]]:
    """Places of the template, grouped: of each group, words that carry a part of the licence's name or a number of a short text, one must be aligned."""
    own = {p for p in name.lower().split("-") if p.isalpha()} - {"notice", "header", "long", "clause"}
    groups: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        for p in parts_of(w):
            if is_short(name) and (p in own or p[0].isdigit()):
                groups.setdefault(p, []).append(k)
    return list(groups.values())


def told_apart(name: str, words: list[str], others: dict[str, list[str]]) -> tuple[list[list[int]], set[str]]:
    """Of each similar template, the places that it doesn't have; and words that similar templates put between this one's, which
    make another licence of it."""
    places, inserted = [], set()
    for other, theirs in others.items():
        held = align(theirs, words) if other != name else []
        if len(held) < COVERED * len(words):
            continue
        have = {q for _, q in held}
        lacks = [k for k in range(len(words)) if k not in have]
        if lacks:
            places.append(lacks)
        if is_short(name) and all(words[k][0].isdigit() for k in lacks):
            kept = {p for p, _ in held}
            new = {w for k, w in enumerate(theirs) if held[0][0] < k < held[-1][0] and k not in kept and w not in words and not w[0].isdigit()}
            inserted |= new if len(new) <= 3 else set()
    return places, inserted


class Find(NamedTuple):
    license: str
    coverage: float
    n_aligned: int
    first_word: int
    last_word: int
    begins: int = 0  # where the template's first word would stand, by most of the aligned ones


class Template:
    def __init__(self, name: str, words: list[int], naming: list[list[int]] = (), apart: list[list[int]] = (), inserted: set[int] = frozenset()):
        self.name, self.words, self.count = name, words, Counter(words)
        self.need, self.span = math.ceil(COVERED * len(words) - 1e-9), int(SLACK * len(words)) + 2
        self.naming, self.inserted = [set(x) for x in naming], inserted
        self.apart = [(set(x), math.ceil(COVERED * len(x) - 1e-9)) for x in apart]
        self.kinds = list(self.count)

    def finds(self, words: np.ndarray) -> list[Find]:
        """All finds in a text's words (numbers; -1 for a word of no template)."""
        for group in self.naming:
            if not np.isin(words, [self.words[k] for k in group]).any():
                return []
        at = np.flatnonzero(np.isin(words, self.kinds))
        ends = np.searchsorted(at, at + self.span)
        out, done = [], 0
        for i in np.flatnonzero(ends - np.arange(len(at)) >= self.need).tolist():
            if at[i] < done or not self._enough(words[at[i] : at[i] + self.span].tolist()):
                continue
            if found := self._aligned(words, int(at[i]), int(at[i]) + self.span):
                found = self._centred(words, found, done)
                out.append(found)
                done = found.last_word + 1
        # what lies between: whole, so that nothing put in is too long
        left = list(zip([0, *[f.last_word + 1 for f in out]], [*[f.first_word for f in out], len(words)], strict=True))
        while left:
            a, z = left.pop()
            if z - a > self.span and self._enough(words[a:z].tolist()) and (found := self._aligned(words, a, z)):
                out.append(found := self._centred(words, found, a, z))
                left += [(a, found.first_word), (found.last_word + 1, z)]
        return out

    def _enough(self, own: list[int]) -> bool:
        return sum(min(n, self.count[w]) for w, n in Counter(own).items() if w in self.count) >= self.need

    def _aligned(self, words: np.ndarray, start: int, end: int) -> Find | None:
        own = words[start:end].tolist()
        for held in sorted(chains(align(own, self.words)), key=len, reverse=True):
            if len(held) < self.need:
                return None
            if self.tells(held, own):
                shift = sorted(p - q for p, q in held)[len(held) // 2]
                return Find(self.name, len(held) / len(self.words), len(held), start + held[0][0], start + held[-1][0], start + shift)
        return None

    def _centred(self, words: np.ndarray, found: Find, least: int, most: int | None = None) -> Find:
        """Where a passage holds words of its neighbours, these can stand in for the find's own: so it is aligned again in passages
        around the place where most of its words say that it begins. More words hold, then the shorter range."""
        n, most = len(self.words), len(words) if most is None else most
        tries = [self._aligned(words, max(least, found.begins - k), min(most, found.begins + n + k)) for k in (0, n // 8 + 1, n // 4 + 2)]
        return max([found, *filter(None, tries)], key=lambda f: (f.n_aligned, f.first_word - f.last_word))

    def tells(self, held: list[tuple[int, int]], own: list[int]) -> bool:
        """Whether the alignment has what tells this licence from others, and nothing that makes another of it."""
        have = {q for _, q in held}
        if not all(group & have for group in self.naming) or not all(len(places & have) >= n for places, n in self.apart):
            return False
        if not self.inserted:
            return True
        kept = {p for p, _ in held}
        return not any(own[k] in self.inserted for k in range(held[0][0], held[-1][0]) if k not in kept)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        split = {name: words_of(t) for name, t in sorted(templates.items())}
        self.number = {w: k for k, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
        self.templates = []
        for name, ws in split.items():
            if ws:
                apart, inserted = told_apart(name, ws, split)
                self.templates.append(Template(name, [self.number[w] for w in ws], naming_places(name, ws), apart, {self.number[w] for w in inserted}))
        self.counts = np.array([np.bincount(t.words, minlength=len(self.number)) for t in self.templates])
        self.need = np.array([t.need for t in self.templates])

    def scan(self, text: str) -> list[Find]:
        """The finds that overlap no better one, the best first."""
        words = np.fromiter((self.number.get(w, -1) for w in words_of(text)), np.int64)
        own = np.bincount(words[words >= 0], minlength=len(self.number))
        able = np.flatnonzero(np.minimum(self.counts, own).sum(1) >= self.need)
        found = [f for k in able.tolist() for f in self.templates[k].finds(words)]
        out: list[Find] = []
        taken = np.zeros(len(words), bool)
        for f in sorted(found, key=lambda f: (-f.n_aligned, -f.coverage, f.license, f.first_word)):
            if not taken[f.first_word : f.last_word + 1].any():
                taken[f.first_word : f.last_word + 1] = True
                out.append(f)
        return out


@cache
def own_scanner() -> Scanner:
    """Of the templates here; made once in a worker."""
    return Scanner(TEMPLATES)


SHOWN = Find._fields[:5]
FIND = T.StructType([T.StructField(n, k) for n, k in zip(SHOWN, [T.StringType(), T.DoubleType(), T.LongType(), T.LongType(), T.LongType()], strict=True)])


def scanned(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the best find's license, coverage, n_aligned, first_word and last_word, and all finds; and those columns'
    names."""
    names = dict(zip([*SHOWN, "finds"], free_names(docs, [*SHOWN, "finds"]), strict=True))
    kinds = [*[f.dataType for f in FIND.fields], T.ArrayType(FIND)]
    arrow = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def work():
        scanner = Scanner(templates) if templates else own_scanner()

        def made(texts: list[str]) -> list[pa.Array]:
            found = list(map(scanner.scan, texts))
            best = [f[0] if f else (None, 0.0, 0, None, None) for f in found]
            finds = pa.array([[dict(zip(SHOWN, x[:5], strict=True)) for x in f] for f in found], pa.list_(pa.struct(list(zip(SHOWN, arrow, strict=True)))))
            return [*[pa.array([b[k] for b in best], arrow[k]) for k in range(5)], finds]

        return made

    return with_python_columns(docs, text_col, list(zip(names.values(), kinds, strict=True)), work), names


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[F.col(n).alias(c) for c, n in names.items()])
