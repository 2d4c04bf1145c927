"""Evaluation passages inside training documents, however the article sets them.

1. *Plain words.* Markup is undone in a few linear passes: text macros are expanded, comment signs, commands and braces
   dropped, hyphenation (soft, discretionary, at line ends), ligatures, accents and odd spaces resolved.
2. *Templates.* Words become typed placeholders where a question could be re-parameterised: numbers, units, and names.
   Names are the words that a public vocabulary lacks as whole tokens, so what is a name doesn't depend on the items.
3. *Hash join.* Windows of ``WINDOW`` words of each item - as they are, and as templates - are keys. Each document's windows
   pass a filter of the keys, whose size is bounded whatever the number of items; those that may be two keys of one text,
   with the words around them, are joined with the keys by hash, as DataFrames. Items are nowhere collected, and the
   corpus is read once.
4. *Check.* For each candidate the passages are aligned in order: seeds are chained into stretches that allow a few words
   changed or put in, and slots must be filled consistently (a name of the item always by one name of the document). The
   best one or two stretches in order must cover ``SHARE`` of the item's words. A stretch proves itself in one of two ways:
   it holds a whole window of the item's own words and mostly consists of the item's very words (so does the other of two,
   which need not hold a window); or, as a re-parameterised
   question, it covers ``TEMPLATE_SHARE`` of the item, nearly every word of it is aligned, most are kept, other names and numbers stand
   for the item's one to one, and no other item is there word for word.

Windows that ``PHRASE_ITEMS`` or more different texts share are introductions and stock phrases: they are no keys and prove
nothing by themselves. That doesn't hold for variants of one text: where most of an item's words lie in shared windows,
these are its own text, however many variants there are.

Whole texts are read. Null and empty texts, of either side, leak nothing; repeated rows and copies are each reported under
their doc_id; items with the same id are several texts of one item, equal texts with several ids are leaked together; an
item of fewer than ``WINDOW`` words is leaked only word for word, one of fewer than three is a common phrase and never;
empty tables give no rows.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.bpe import DEFAULT_PATH
from chronoloom.operators.readings import spread
from chronoloom.session import ensure_checkpoint_dir

WINDOW = 5
#: Share of an item's words that its passages must cover.
SHARE = 1 / 3
#: A window that so many different texts share is a phrase.
PHRASE_ITEMS = 4
#: ... unless the shared windows hold this share of the item's words: then it is one of several variants of a text.
VARIANT_SHARE = 3 / 4
#: Placeholders that a template window may hold: with more, what is left says too little to look for.
SLOTS = 2
#: Words that may be skipped on either side between two seeds of one stretch.
GAP = 6
#: A stretch has at least so many aligned words.
LEAST_STRETCH = 6
#: A second stretch, beside one that proves itself, needs no proof if it is longer than phrases are.
LEAST_SECOND = 11
#: Share of a stretch's words that are the item's own, not slots filled otherwise or changed.
LEAST_EXACT = 0.65
#: A re-parameterised passage covers so much of the item, and aligns and keeps so much of its own length.
TEMPLATE_SHARE, TEMPLATE_ALIGNED, TEMPLATE_KEPT = 2 / 3, 0.9, 0.5
#: Share of those words that key windows hold even where every sixth word is changed and introductions are no keys.
KEY_SHARE = 0.6
#: Words between hits that part two groups.
APART = 60
#: Places of the filter, as a power of two: at least, at most (64 MB), and signatures of each.
LEAST_PLACES, MOST_PLACES, ROWS = 20, 23, 4
#: Signature of places where keys of several classes meet.
MANY = 65_535
#: Units of measurement.
UNITS = frozenset("percent pct ms s sec seconds min minutes h hours kg g mg km m cm mm nm hz khz mhz ghz ev kev mev gev k c f v w kw mw j pa kpa mpa mol db".split())
WORD, NUMBER, UNIT, NAME = range(4)
KNOWN_WORDS = 1 << 17

_MACRO = re.compile(r"\\(?:re)?(?:newcommand|providecommand)\*?\s*\{?\\([A-Za-z]+)\}?\s*\{([^{}\\$]{1,200})\}|\\def\s*\\([A-Za-z]+)\s*\{([^{}\\$]{1,200})\}")
_SILENT = re.compile(r"\\(?:cite[a-z]*|label|ref|eqref|pageref|input|include|includegraphics|bibliography|bibitem|footnotemark|index|vspace|hspace|begin|end)\*?\s*(?:\[[^\]\n]{0,200}\])?\s*\{[^{}]{0,300}\}")
_ACCENT = re.compile(r"\\(?:-|['`^\"~=.](?=[a-z{\\])|[cvuhdbkr](?=\{[a-z]\}))")
_JOIN = re.compile(r"(?<=[a-z])-[ \t]*\r?\n[ \t]*(?:%+[ \t]*)?(?=[a-z])|[{}]")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?")
_WORD = re.compile(r"[a-z]+|[0-9]+(?:[.,][0-9]+)*")
_HIDDEN = {ord(c): None for c in "\u00ad\u200b\u200c\u200d\u2060\ufeff"}
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ı": "i"})


def plain_words(text: str) -> list[str]:
    """The words of a text without its markup, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_HIDDEN))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    if "\\" in text:
        macros = {}
        if "command" in text or "\\def" in text:
            for m in _MACRO.finditer(text):
                macros[m[1] or m[3]] = m[2] or m[4]
        text = _SILENT.sub(" ", text)
        if macros:
            text = re.sub(r"\\(" + "|".join(sorted(macros, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\})?", lambda m: f" {macros[m[1]]} ", text)
        # Accents join their letters, commands part words, braces vanish: in this order.
        text = _JOIN.sub("", _COMMAND.sub(" ", _ACCENT.sub("", text.lower())))
    else:
        text = _JOIN.sub("", text.lower())
    if not text.isascii():
        text = text.translate(_LETTERS)
    return _WORD.findall(text)


class Coder(dict):
    """Words to codes: a hash of the word, and in the last two bits what it is in a template. Holds a bounded table."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        kind = NUMBER if word[0] <= "9" else UNIT if word in UNITS else WORD if word in self.lexicon else NAME
        # From 1, so that 0 can part regions.
        code = self[word] = (zlib.crc32(word.encode()) + 1) << 2 | kind
        return code

    def codes(self, text: str) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.__getitem__, words), "int64", len(words))


@lru_cache(maxsize=2)
def coder(vocabulary_path: str = DEFAULT_PATH) -> Coder:
    """One per worker process; the lexicon are the words that the vocabulary holds as whole tokens after a space."""
    tokens = (base64.b64decode(x.split()[0]) for x in Path(vocabulary_path).read_bytes().splitlines() if x)
    return Coder(frozenset(t[1:].decode() for t in tokens if t[:1] == b" " and t[1:].isalpha() and t.isascii() and t[1:].islower()))


def templates(codes: np.ndarray) -> np.ndarray:
    """The codes with placeholders for numbers, units and names."""
    kind = codes & 3
    return np.where(kind == WORD, codes, kind)


def _mixed(columns: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(columns[0]), salt, "uint64")
    for c in columns:
        h = (h ^ c.astype("uint64")) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view("int64")


def windows(codes: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows of a text, first word for word, then as templates with one to ``SLOTS`` placeholders."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    of = lambda c: [c[k : k + n] for k in range(size)]
    plain = _mixed(of(codes), size)
    if size < WINDOW:
        return plain, np.arange(n)
    slots = np.sum(of(((codes & 3) != WORD).astype("int8")), axis=0)
    at = np.flatnonzero((slots > 0) & (slots <= SLOTS))
    return np.append(plain, _mixed([c[at] for c in of(templates(codes))], size + 100)), np.append(np.arange(n), at)


class Filter:
    """Which hashes may be keys, and of which classes: a table of up to ``ROWS`` class signatures a place, addressed by hash.

    0 stands where there is none, ``MANY`` in the first row where keys of more classes meet. A key always finds its class's
    signature or ``MANY``.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, h: np.ndarray, class_id: np.ndarray, power: int) -> Filter:
        return cls._of_pairs(h & ((1 << power) - 1), class_id % (MANY - 1) + 1, power)

    @classmethod
    def _of_pairs(cls, at: np.ndarray, signature: np.ndarray, power: int) -> Filter:
        pairs = np.unique(at.astype("int64") << 16 | signature)
        at, signature = pairs >> 16, pairs & 0xFFFF
        begins = np.append(True, at[1:] != at[:-1])[: len(at)]
        first = np.flatnonzero(begins)
        row = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        table = np.zeros((ROWS, 1 << power), "uint16")
        table[row[row < ROWS], at[row < ROWS]] = signature[row < ROWS]
        many = np.append(at[row >= ROWS], at[signature == MANY])
        table[:, many] = 0
        table[0, many] = MANY
        return cls(table)

    def merge(self, other: Filter) -> Filter:
        both = np.concatenate([self.table, other.table])
        row, at = np.nonzero(both)
        return self._of_pairs(at, both[row, at].astype("int64"), self.table.shape[1].bit_length() - 1)

    def signatures(self, h: np.ndarray) -> np.ndarray:
        return self.table[:, h & (self.table.shape[1] - 1)]


def words_needed(n: int) -> int:
    """Words of an item of n words that key windows in two groups of close ones must cover before it is aligned."""
    return max(min(n, WINDOW), int(KEY_SHARE * SHARE * n))


def enough(hits: list[tuple[int, int]], need: int) -> list[tuple[int, int]]:
    """First and last position of the groups of close hits (position, width; in order), if the best two cover enough words."""
    groups: list[list[int]] = []  # first, last, words covered, end
    for at, width in hits:
        if groups and at - groups[-1][1] <= APART:
            g = groups[-1]
            g[2] += max(0, at + width - max(at, g[3]))
            g[1], g[3] = at, max(g[3], at + width)
        else:
            groups.append([at, at, width, at + width])
    # A single window proves nothing, unless the item is no longer; beside others it may mark a second passage.
    best = sorted((g[2] for g in groups if g[2] >= min(need, WINDOW + 1)), reverse=True)[:2]
    return [(g[0], g[1]) for g in groups] if sum(best) >= need else []


def likely(at: np.ndarray, width: np.ndarray, signature: np.ndarray, need: int) -> np.ndarray:
    """Which hits, sorted by position, may be enough for a class."""
    by: dict[int, list[tuple[int, int]]] = {}
    for a, w, several in zip(at.tolist(), width.tolist(), signature.T.tolist()):
        for s in several:
            if s:
                by.setdefault(s, []).append((a, w))
    many = by.pop(MANY, [])
    good = [s for s, hits in by.items() if (len(hits) + len(many)) * WINDOW >= need and enough(sorted(hits + many) if many else hits, need)]
    if not good and not (many and enough(many, need)):
        return np.zeros(len(at), bool)
    return np.isin(signature, [*good, MANY]).any(axis=0)


def around(groups: list[tuple[int, int]], margin: int, n: int) -> list[tuple[int, int]]:
    """Parts of a text of n words that reach ``margin`` words around the groups."""
    merged: list[list[int]] = []
    for start, end in groups:
        start, end = max(0, start - margin), min(n, end + WINDOW + margin)
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def laid_out(codes: np.ndarray, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts end to end, with breaks that nothing aligns across, and for each what to add to a position in it."""
    gap = np.zeros(APART + WINDOW, "int64")
    pieces, shift, size = [], [], 0
    for a, b in parts:
        shift.append(size - a)
        pieces += [codes[a:b], gap]
        size += b - a + len(gap)
    return np.concatenate(pieces), np.array(shift)


def candidate(codes: np.ndarray, keys: Filter, sizes: tuple[int, ...], need: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Words around the windows of a text that may be keys; those windows' hashes, positions among the words, and widths."""
    found = [(*windows(codes, size), size) for size in sizes]
    h, at, width = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.repeat([f[2] for f in found], [len(f[0]) for f in found])
    signature = keys.signatures(h)
    hit = np.flatnonzero(signature.any(axis=0))
    if len(hit) * WINDOW < need:
        return None
    hit = hit[np.argsort(at[hit], kind="stable")]
    hit = hit[likely(at[hit], width[hit], signature[:, hit], need)]
    if not len(hit):
        return None
    h, at, width = h[hit], at[hit], width[hit]
    parts = around([(int(a), int(a)) for a in at], margin, len(codes))
    words, shift = laid_out(codes, parts)
    return words, h, at + shift[np.searchsorted([a for a, _ in parts], at, side="right") - 1], width


def _seeds(item: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Positions (in the words, in the item) of equal template triples, in order; triples of placeholders only must be equal word for word."""

    def triples(codes: np.ndarray) -> np.ndarray:
        n = len(codes) - 2
        if n <= 0:
            return np.zeros(0, "int64")
        of = lambda c: [c[k : k + n] for k in range(3)]
        bare = np.all([(c & 3) != WORD for c in of(codes)], axis=0)
        h = np.where(bare, _mixed(of(codes), 1), _mixed(of(templates(codes)), 2))
        # Breaks have numbers of their own.
        broken = np.any([c == 0 for c in of(codes)], axis=0)
        return np.where(broken, -1 - np.arange(n), h)

    a, b = triples(item), triples(words)
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, side="left"), np.searchsorted(a[order], b, side="right")
    n = high - low
    j = np.repeat(np.arange(len(b)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return list(zip(j.tolist(), order[k].tolist()))


def _chains(seeds: list[tuple[int, int]], least: int) -> list[list[tuple[int, int]]]:
    """Seeds that follow each other closely on both sides: the best predecessor of each, then the best chains."""
    reach = GAP + 3
    score, back = [3.0] * len(seeds), [-1] * len(seeds)
    oldest = 0
    for n, (j, i) in enumerate(seeds):
        while j - seeds[oldest][0] > reach:
            oldest += 1
        for m in range(n - 1, oldest - 1, -1):
            dj, di = j - seeds[m][0], i - seeds[m][1]
            if dj > 0 and 0 < di <= reach and (new := score[m] + min(3, di, dj) - 0.3 * abs(dj - di)) > score[n]:
                score[n], back[n] = new, m
    chains = []
    used = [False] * len(seeds)
    for n in sorted(range(len(seeds)), key=lambda n: -score[n]):
        if used[n] or score[n] < least:
            continue
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(seeds[n])
            n = back[n]
        chains.append(chain[::-1])
    return chains


def stretches(item: np.ndarray, own: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, set[int], bool, bool]]:
    """Passages of the item in the words: item from, to, words from, to, the item positions covered, whether word for word, and whether that proves itself."""
    item_words, text, owned = item.tolist(), words.tolist(), own.tolist()
    size = len(item_words)
    out = []
    for chain in _chains(_seeds(item, words), min(LEAST_STRETCH, size)):
        aligned: dict[int, int] = {}
        for j, i in chain:
            for k in range(3):
                aligned.setdefault(i + k, j + k)
        # Slots are consistent: a name (or number) of the item is always filled by one of the document.
        filled: dict[int, int] = {}
        consistent = True
        for i, j in sorted(aligned.items()):
            if item_words[i] & 3 != WORD and filled.setdefault(item_words[i], text[j]) != text[j]:
                del aligned[i]
                consistent = False
        first, last = min(aligned), max(aligned)
        # The passage proves itself by words of its own: some whole window without a change or a shared phrase.
        run = proof = 0
        for i in sorted(aligned):
            same = owned[i] and item_words[i] == text[aligned[i]]
            run = run + 1 if same and (not run or aligned.get(i - 1) == aligned[i] - 1) else int(same)
            proof = max(proof, run)
        exact = [i for i, j in aligned.items() if item_words[i] == text[j]]
        proved = proof >= min(WINDOW, size)
        literal = (proved or len(aligned) >= LEAST_SECOND) and len(exact) >= LEAST_EXACT * (last - first + 1)
        template = False
        if not (literal and proved):
            kept = sum(owned[i] for i in exact)
            one_to_one = len(set(filled.values())) == len(filled)
            template = consistent and one_to_one and kept >= max(LEAST_STRETCH, TEMPLATE_KEPT * (last - first + 1)) and len(aligned) >= max(TEMPLATE_SHARE * size, TEMPLATE_ALIGNED * (last - first + 1))
            if not (literal or template):
                continue
        start, end = min(aligned.values()), max(aligned.values())
        # Changed words between two aligned ones, as many on both sides, belong to the passage.
        covered = set(aligned)
        ordered = sorted(aligned.items())
        for (a, x), (b, y) in zip(ordered, ordered[1:]):
            if 1 < b - a <= 3 and y - x == b - a:
                covered.update(range(a + 1, b))
        out += [(first, last, start, end, covered, mode, mode and proved) for mode, given in ((True, literal), (False, template)) if given]
    return out


def leaked(item: np.ndarray, own: np.ndarray, words: np.ndarray, hits: list[tuple[int, int]], share: float = SHARE) -> tuple[int, bool, int, int] | None:
    """Words of the item in its best one or two passages, in order; whether word for word; where they begin and end. None if too few."""
    groups = enough(hits, words_needed(len(item)))
    if not groups:
        return None
    parts = around(groups, len(item), len(words))
    text, shift = laid_out(words, parts)
    found = [s for s in stretches(item, own, text) if len(s[4]) >= min(LEAST_STRETCH, len(item))]
    best: tuple[int, bool, int, int] = (0, False, 0, 0)
    for literal in (True, False):
        for a in found:
            if a[5] != literal:
                continue
            if a[6] or not literal:
                best = max(best, (len(a[4]), literal, a[2], a[3]))
            for b in found if literal else ():
                if b[5] and (a[6] or b[6]) and b[2] > a[3] and b[0] > a[0]:
                    best = max(best, (len(a[4] | b[4]), literal, a[2], b[3]))
        if best[0] >= share * len(item):
            # Back to positions among the words given.
            starts = np.array([a for a, _ in parts]) + shift
            back = lambda x: int(x - shift[np.searchsorted(starts, x, side="right") - 1])
            return best[0], literal, back(best[2]), back(best[3])
    return None


def _code_items(vocabulary_path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = coder(vocabulary_path)
        for pdf in batches:
            rows = []
            for item, text in zip(pdf.item_id, pdf.text):
                codes = of.codes(text)
                if len(codes) >= 3:
                    h, at = windows(codes, min(WINDOW, len(codes)))
                    rows.append((item, xxhash.xxh64(codes.tobytes()).intdigest() >> 1, codes.tobytes(), len(codes), h, at))
            yield pd.DataFrame(rows, columns=["item_id", "class_id", "words", "n", "h", "at"])

    return run


def _finish_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Own words and keys of each class from its windows and how many classes share them."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            codes = np.frombuffer(r.words, "int64")
            size = min(WINDOW, len(codes))
            h, at = windows(codes, size)
            phrase = np.isin(h, np.asarray(r.shared if r.shared is not None else [], "int64"))
            plain = np.arange(len(h)) < len(codes) - size + 1
            key = np.ones(len(h), bool)
            own = np.ones(len(codes), bool)
            for which in (plain, ~plain):
                held = np.zeros(len(codes), bool)
                for k in at[phrase & which]:
                    held[k : k + size] = True
                if held.sum() < VARIANT_SHARE * len(codes):
                    key &= ~(phrase & which)
                    own &= ~held if which is plain else True
            keys = np.unique(h[key])
            rows.append((r.class_id, r.words, len(codes), words_needed(len(codes)), own.tobytes(), keys))
        yield pd.DataFrame(rows, columns=["class_id", "words", "n", "need", "own", "keys"])


def item_classes(items: DataFrame, vocabulary_path: str = DEFAULT_PATH) -> tuple[DataFrame, DataFrame]:
    """Different texts of the items (class_id, words, n, need, own, keys), and the ids of each (class_id, item_id)."""
    texts = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    coded = texts.mapInPandas(_code_items(vocabulary_path), "item_id long, class_id long, words binary, n int, h array<long>, at array<int>")
    one = coded.groupBy("class_id").agg(F.first("words").alias("words"), F.first("h").alias("h"))
    held = one.select("class_id", F.explode(F.array_distinct("h")).alias("h"))
    shared = held.groupBy("h").agg(F.count("*").alias("n_classes")).where(F.col("n_classes") >= PHRASE_ITEMS).select("h")
    phrases = held.join(shared, "h").groupBy("class_id").agg(F.collect_list("h").alias("shared"))
    classes = one.select("class_id", "words").join(phrases, "class_id", "left").mapInPandas(_finish_items, "class_id long, words binary, n int, need int, own binary, keys array<long>")
    return classes, coded.select("class_id", "item_id").distinct()


def key_filter(keys: DataFrame) -> Filter:
    """The filter of keys (h, class_id), of a size between two bounds that grows with their number, built in parts."""
    n = keys.count()
    power = min(MOST_PLACES, max(LEAST_PLACES, (64 * n).bit_length()))

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(pdf.h.to_numpy("int64"), pdf.class_id.to_numpy("int64")) for pdf in batches]
        h, c = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, "int64"),) * 2
        yield pd.DataFrame({"part": [zlib.compress(Filter.of(h, c, power).table.tobytes(), 1)]})

    whole = Filter(np.zeros((ROWS, 1 << power), "uint16"))
    for r in keys.coalesce(1 if n < 1_000_000 else 8).mapInPandas(table, "part binary").toLocalIterator():
        whole = whole.merge(Filter(np.frombuffer(zlib.decompress(r.part), "uint16").reshape(ROWS, -1)))
    return whole


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, vocabulary_path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, item_id, covered_words, item_words, literal: one row per document and item that it leaks."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    classes, ids = item_classes(items, vocabulary_path)
    classes = classes.checkpoint()
    keys = classes.select("class_id", F.explode("keys").alias("h"))
    facts = classes.agg(F.count("*").alias("n"), F.max("n").alias("longest"), F.min("need").alias("need"), F.collect_set(F.least("n", F.lit(WINDOW))).alias("sizes")).first()
    if not facts.n:
        return spark.createDataFrame([], "doc_id long, item_id long, covered_words int, item_words int, literal boolean")
    table = spark.sparkContext.broadcast(key_filter(keys))
    sizes, need, longest = tuple(sorted(facts.sizes)), facts.need, facts.longest

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, keys_of = coder(vocabulary_path), table.value
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                if isinstance(text, str) and text and (found := candidate(of.codes(text), keys_of, sizes, need, longest)):
                    words, h, at, width = found
                    data = words.tobytes()
                    rows.append((xxhash.xxh64(data, seed=doc & 0xFFFFFFFF).intdigest() - (1 << 63), doc, data, h, at, width))
            yield pd.DataFrame(rows, columns=["doc_key", "doc_id", "words", "h", "at", "width"])

    texts = spread(documents.select("doc_id", "text").where("doc_id IS NOT NULL"))
    # Only the words around possible passages; the corpus isn't read again.
    near = texts.mapInPandas(search, "doc_key long, doc_id long, words binary, h array<long>, at array<int>, width array<int>").checkpoint()
    hits = near.select("doc_key", "doc_id", F.explode(F.arrays_zip("h", "at", "width")).alias("x")).select("doc_key", "doc_id", "x.*").distinct()
    pairs = hits.join(keys, "h").groupBy("doc_key", "doc_id", "class_id").agg(F.array_sort(F.collect_list(F.struct("at", "width"))).alias("hits"))
    # What can't be enough for the class goes no further.
    pairs = pairs.join(classes.select("class_id", "need"), "class_id").where(F.size("hits") * WINDOW >= F.col("need")).drop("need")
    pairs = pairs.join(near.groupBy("doc_key", "doc_id").agg(F.first("words").alias("text_words")), ["doc_key", "doc_id"]).join(classes.drop("keys"), "class_id")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                item, own, words = np.frombuffer(r.words, "int64"), np.frombuffer(r.own, bool), np.frombuffer(r.text_words, "int64")
                if found := leaked(item, own, words, [(x["at"], x["width"]) for x in r.hits], share):
                    rows.append((r.doc_key, r.doc_id, r.class_id, *found, r.n))
            yield pd.DataFrame(rows, columns=["doc_key", "doc_id", "class_id", "covered_words", "literal", "start", "end", "item_words"])

    found = pairs.mapInPandas(check, "doc_key long, doc_id long, class_id long, covered_words int, literal boolean, start int, end int, item_words int").checkpoint()
    # A passage that is another item word for word is no re-parameterised form of this one.
    plain = found.where("literal").select(F.col("doc_key").alias("k"), F.col("doc_id").alias("d"), F.col("start").alias("from"), F.col("end").alias("to"))
    overlap = F.least("end", "to") - F.greatest("start", "from") > (F.col("end") - F.col("start")) / 2
    found = found.where("literal").unionByName(found.where("NOT literal").join(plain, (F.col("doc_key") == F.col("k")) & (F.col("doc_id") == F.col("d")) & overlap, "left_anti"))
    best = found.join(ids, "class_id").groupBy("doc_id", "item_id").agg(F.max(F.struct("covered_words", "item_words", "literal")).alias("b"))
    return best.select("doc_id", "item_id", "b.*")
