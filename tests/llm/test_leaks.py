"""Planted passages in every dress are found, and phrases that anyone uses are not."""

import os
import random

import numpy as np
import pandas as pd
import pytest

from chronoloom.llm import bpe
from chronoloom.llm import leaks as L
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_PATH), reason="no vocabulary")


def words_like_item(rng, n):
    stems = [a + b for a in ("orb", "sens", "vort", "plas", "kern", "mark", "latt", "enz", "can", "lig") for b in ("it", "or", "ex", "ma", "el", "et", "ice", "yme")]
    verbs = [a + b for a in ("bound", "driv", "mask", "split", "refin", "invert") for b in ("es", "ates", "izes", "ens")]
    adjectives = [a + b for a in ("dens", "slow", "rigid", "nois", "conv", "bright") for b in ("e", "ish", "al", "ic", "ous")]
    out = []
    while len(out) < n:
        out += ["the", rng.choice(adjectives), rng.choice(stems), rng.choice(verbs), "each", rng.choice(stems), "of", "the", f"{rng.choice('vkmtr')}{rng.choice('aeiou')}l{rng.choice('aeiou')}n{rng.choice('dkst')}on", rng.choice(stems)]
    return out[:n]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    return [(i, "State whether the claim holds. " + " ".join(words_like_item(rng, 70)) + ".") for i in range(30)]


class Index:
    """Brute force in place of the joins: every class is checked at each of its windows that a text has."""

    def __init__(self, rows):
        of = L.coder()
        self.ids, words = {}, {}
        for i, t in rows:
            c = of.codes(t)
            if len(c) >= 3:
                self.ids.setdefault(c.tobytes(), set()).add(i)
                words[c.tobytes()] = c
        hashes = {k: L.windows(c, min(L.WINDOW, len(c)))[0] for k, c in words.items()}
        held = [x for h in hashes.values() for x in set(h.tolist())]
        shared = {x for x in set(held) if held.count(x) >= L.PHRASE_ITEMS} if len(held) < 20_000 else {x for x, n in zip(*np.unique(held, return_counts=True)) if n >= L.PHRASE_ITEMS}
        pdf = pd.DataFrame([(k, k, [x for x in set(hashes[k].tolist()) if x in shared]) for k in words], columns=["class_id", "words", "shared"])
        self.classes = next(L._finish_items(iter([pdf])))

    def find(self, text):
        codes = L.coder().codes(text)
        out = set()
        for r in self.classes.itertuples():
            item, own = np.frombuffer(r.words, "int64"), np.frombuffer(r.own, bool)
            size = min(L.WINDOW, len(item))
            h, at = L.windows(codes, size)
            hits = sorted((int(a), size) for a in at[np.isin(h, r.keys)])
            if L.leaked(item, own, codes, hits):
                out |= self.ids[r.words]
        return out


@pytest.fixture(scope="module")
def index(items):
    return Index(items)


def passage(items, k, a=0.0, b=1.0):
    w = items[k][1].split()[5:]
    return w[int(a * len(w)) : int(b * len(w))]


def found(index, text):
    return index.find(text)


FILLER = "\\section{Results}\nWe note in passing that nothing of the sort was seen before.\n\n"


def wrap(words, rng):
    return {
        "plain": " ".join(words),
        "lines": "\n".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7)),
        "comment": "\n".join("% " + " ".join(words[k : k + 7]) for k in range(0, len(words), 7)),
        "emphasis": " ".join(f"\\emph{{{w}}}" if k % 5 == 0 else w for k, w in enumerate(words)),
        "fonts": " ".join(f"{{\\it {w}}}" if k % 6 == 0 else w for k, w in enumerate(words)),
        "hyphens": " ".join(f"{w[:3]}-\n{w[3:]}" if len(w) > 5 and k % 3 == 0 else w for k, w in enumerate(words)),
        "soft": " ".join(f"{w[:3]}\u00ad{w[3:]}" if len(w) > 5 else w for w in words).replace("fi", "ﬁ").replace(" ", "\u00a0", 9),
        "discretionary": " ".join(f"{w[:2]}\\-{w[2:]}" if len(w) > 4 else w for w in words),
        "upper": " ".join(words).upper(),
        "cites": " ".join(w + ("~\\cite{a2001b}" if k % 9 == 8 else "") for k, w in enumerate(words)),
        "macro": "\\newcommand{\\abc}{" + " ".join(words[20:23]) + "}\n" + " ".join(words[:20]) + " \\abc{} " + " ".join(words[23:]),
        "changed": " ".join("altered" if k % 8 == 7 else w for k, w in enumerate(words)),
        "dropped": " ".join(w for k, w in enumerate(words) if k % 10 != 9),
        "inserted": " ".join(words[: len(words) // 2] + "notably this is quite another matter of its own here".split() + words[len(words) // 2 :]),
        "tied": "~".join(words), "crlf": "\r\n".join(words),
        "accents": " ".join(words).replace("a", "\\'a", 5),
        "hidden": "\\iffalse\n" + " ".join(words) + "\n\\fi",
    }


@pytest.mark.parametrize("style", list(wrap(["x"] * 30, random.Random(0))))
def test_every_dress(index, items, style):
    rng = random.Random(5)
    for k in range(0, 30, 3):
        assert found(index, FILLER + wrap(passage(items, k), rng)[style] + "\n\n" + FILLER) == {items[k][0]}, style


def test_parts(index, items):
    for k in range(30):
        assert found(index, FILLER + " ".join(passage(items, k, 0.3, 0.85)) + FILLER) == {items[k][0]}
        two = FILLER + " ".join(passage(items, k, 0.0, 0.3)) + FILLER * 30 + " ".join(passage(items, k, 0.6, 0.9)) + FILLER
        assert found(index, two) == {items[k][0]}
        assert found(index, FILLER + " ".join(passage(items, k, 0.4, 0.6)) + FILLER) == set()


def renamed(text, lexicon):
    """The text with every name and number replaced, each by one of its own."""
    names = sorted({w for w in L.plain_words(text) if w not in lexicon and w not in L.UNITS})
    to = {w: str(7_001 + n) if w[0] <= "9" else f"zor{chr(97 + n % 26)}{chr(97 + n // 26)}mik" for n, w in enumerate(names)}
    return " ".join(to.get(w, w) for w in L.plain_words(text))


QUESTION = "A train from Quoxton to Velgarth leaves Quoxton at 240 km, reaches Velgarth by 37 hours, and passes Zyrmond near 12 towns before Quoxton."


@pytest.mark.parametrize("words", [14, 20, 24])
def test_reparameterised(index, items, words):
    """A question whose names and numbers are all replaced, one for one, is found at any length; filled at random it isn't."""
    lexicon = L.coder().lexicon
    question = " ".join(L.plain_words(QUESTION)[:words])
    one = Index([*items, (77, question)])
    assert found(one, FILLER + renamed(question, lexicon) + FILLER) == {77}
    rng = random.Random(1)
    mixed = " ".join(w if w in lexicon or w in L.UNITS or w[0] <= "9" else f"zor{chr(97 + rng.randrange(26))}mik" for w in renamed(question, lexicon).split())
    assert found(one, FILLER + mixed + FILLER) == set()
    # The names that no other item has, in an item of many invented words.
    others = {w for i, t in items if i != items[4][0] for w in L.plain_words(t)}
    assert items[4][0] in found(index, renamed(" ".join(passage(items, 4)), lexicon | others))


@pytest.mark.parametrize("n", [1, 4, 50])
@pytest.mark.parametrize("size", [26, 80])
def test_variants_of_one_text(n, size):
    """However many near-identical items there are, a document with what they share leaks each of them."""
    rng = random.Random(n)
    base = words_like_item(rng, size)
    variants = [(k, " ".join([*base[:-2], f"last{chr(97 + k % 26)}{chr(97 + k // 26)}", "word"])) for k in range(n)]
    others = [(1_000 + k, "State whether the claim holds. " + " ".join(words_like_item(rng, 70))) for k in range(30)]
    index = Index(variants + others)
    assert found(index, FILLER + " ".join(base[:-2]) + "\n\n" + FILLER) == {k for k, _ in variants}
    assert found(index, FILLER + "State whether the claim holds. " + FILLER) == set()


@pytest.mark.parametrize("text", ["Qoxr vlumt zabni prengol duvax hirst omkel wurb jentop kasrid yulme brofa xand tirgel poqsu", "seven grey owls sleep here", "zebra quilts hum", "why do four owls sleep by day"])
def test_rare_words_and_short_items(items, text):
    """Items of names only, and of five, three and seven words, word for word."""
    index = Index([*items, (500, text), (501, "two words"), (502, "one")])
    assert found(index, FILLER + f"\\emph{{{text}}}." + FILLER) == {500}
    assert found(index, FILLER + " ".join(text.split()[::-1]) + " two words, one." + FILLER) == set()


def test_no_leak(index, items):
    assert found(index, "State whether the claim holds. " * 50) == set()
    assert found(index, "") == set() and found(index, "x " * 100_000) == set()
    rng = random.Random(99)
    for _ in range(20):
        assert found(index, " ".join(words_like_item(rng, 600))) == set()


def test_tables(spark, items, index):
    docs = spark.createDataFrame([(1, items[0][1], 9), (1, items[0][1], 9), (2, None, 9), (3, "", 9), (4, items[1][1] + FILLER * 2_000, 9), (None, items[2][1], 9), (5, "seven grey owls sleep here", 9)], "doc_id long, text string, item_id long")
    ev = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x"), items[0], (92, items[0][1].upper()), (93, "seven grey owls sleep here")], "item_id long, text string")
    pairs = lambda *a: sorted((r.doc_id, r.item_id) for r in L.find_leaks(*a).collect())
    assert pairs(docs, ev) == [(1, 0), (1, 92), (4, 1), (5, 93)]
    assert pairs(docs.limit(0), ev) == pairs(docs, ev.limit(0)) == pairs(docs, ev.where("item_id = 90")) == []


def test_filter_never_loses_a_key():
    rng = np.random.default_rng(2)
    h, c = rng.integers(-(2**62), 2**62, 60_000), rng.integers(0, 2**62, 60_000)
    h[30_000:40_000] = h[:10_000]
    h[40_000:45_000] = h[0]  # one window of very many classes
    whole, parts = L.Filter.of(h, c, 16), L.Filter.of(h[:31_234], c[:31_234], 16).merge(L.Filter.of(h[31_234:], c[31_234:], 16))
    for f in (whole, parts):
        s = f.signatures(h)
        assert ((s == c % (L.MANY - 1) + 1).any(axis=0) | (s[0] == L.MANY)).all()
    assert (np.sort(whole.table, axis=0) == np.sort(parts.table, axis=0)).all()


def test_join_and_filter_lose_nothing(spark, items, index):
    """The distributed search gives what brute force over all classes gives."""
    rng = random.Random(3)
    texts = [FILLER + " ".join(passage(items, k % 30, (k % 5) / 10, 0.4 + (k % 7) / 10)) + FILLER * (k % 4) for k in range(60)]
    texts += [FILLER + " ".join(w if k % 6 else "other" for k, w in enumerate(passage(items, j, 0.1, 0.8), 1)) for j in range(30)]
    texts += [renamed(items[k][1], L.coder().lexicon) for k in range(10)] + [" ".join(words_like_item(rng, 400)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).where("literal").collect()}
    brute = {(k, i) for k, t in enumerate(texts) for i in index.find(t)}
    assert got <= brute and {(k, i) for k, i in brute if k < 90} == {x for x in got if x[0] < 90} and len(got) > 60


def test_against_plain_overlap_on_the_tables(spark):
    """Every document that holds a third of an item's words in five-word windows of its own is found, and no other far from it."""
    from collections import defaultdict

    d = f"{DATA}/sf0.01"
    docs, ev = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(docs, ev).collect()}
    owner = defaultdict(set)
    size = {}
    for r in ev.collect():
        w = L.plain_words(r.text)
        size[r.item_id] = len(w)
        for k in range(len(w) - 4):
            owner[tuple(w[k : k + 5])].add((r.item_id, k))
    certain, any_ = set(), set()
    for r in docs.where("text IS NOT NULL").collect():
        w = L.plain_words(r.text)
        covered = defaultdict(set)
        for k in range(len(w) - 4):
            hits = owner.get(tuple(w[k : k + 5]), ())
            if len({i for i, _ in hits}) == 1:
                for i, at in hits:
                    covered[i] |= set(range(at, at + 5))
        certain |= {(r.doc_id, i) for i, c in covered.items() if len(c) >= 0.5 * size[i]}
        any_ |= {(r.doc_id, i) for i, c in covered.items() if len(c) >= 0.15 * size[i]}
    assert len(certain) > 20 and certain <= got <= any_


@pytest.mark.parametrize("share, every, parts, least", [(0.4, 0, 1, 0.99), (0.4, 0, 2, 0.99), (0.4, 8, 1, 0.99), (0.4, 8, 2, 0.95), (0.45, 6, 1, 0.99), (0.45, 6, 2, 0.85)])
def test_recall_of_parts_with_changed_words(spark, share, every, parts, least):
    """Parts of the table's own items, in one or two stretches among words of its documents, every so many words replaced."""
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/eval_items.parquet").orderBy("item_id").collect()]
    index = Index(rows)
    rng = random.Random(1)
    pool = [w for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect() for w in L.plain_words(r.text)]

    def filler(n):
        a = rng.randrange(len(pool) - n)
        return pool[a : a + n]

    changed = lambda ws: [rng.choice(pool) if every and k % every == every - 1 else w for k, w in enumerate(ws)]
    ok = 0
    for i, t in rows[:80]:
        w = L.plain_words(t)
        m = int(len(w) * share) + 1
        if parts == 1:
            a = rng.randrange(len(w) - m + 1)
            doc = filler(60) + changed(w[a : a + m]) + filler(60)
        else:
            h = m // 2
            a = rng.randrange(0, len(w) - m - 4)
            b = rng.randrange(a + h + 4, len(w) - (m - h) + 1)
            doc = filler(60) + changed(w[a : a + h]) + filler(100) + changed(w[b : b + m - h]) + filler(60)
        ok += i in index.find(" ".join(doc))
    assert ok >= least * 80
