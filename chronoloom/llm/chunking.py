"""Oversized texts cut into pieces under a token limit, at the article's own boundaries.

A text is parsed into a tree: sections by their headings, environments and lists, however deep they nest, the items of a
list, and the blocks that blank lines part within each of them. A node that fits is one piece or part of one; only an
oversized node is opened. Its children that fit are merged with their siblings, in order, as far as the limit allows, an
oversized child is opened in turn, and what comes of it is not merged with its parent's other children. A block without
structure is opened at the coarsest boundary that it has: list entries, sentences, lines, clauses, spaces, words, tokens.
Every piece but the first begins with the last ``overlap`` tokens before it.

Marks that don't match are no harm: an end without a begin is a boundary and no more, a heading ends what is open.

Pieces are contiguous slices of the text and without their overlaps give it back exactly. Null and empty texts, and
texts within the limit, have no pieces; a text without any boundary is cut between tokens (never inside a character); of
repeated rows each is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronoloom.llm import bpe
from chronoloom.operators.readings import spread

LIMIT = 2048
OVERLAP = 128
#: Tokens of a piece that stay free while it is packed.
SPARE = 8
HEADINGS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
_MARK = re.compile(
    r"^[ \t]*\\(?P<heading>" + "|".join(HEADINGS) + r")\*?[ \t]*[\[{]"
    r"|^[ \t]*(?P<hashes>#{1,6})[ \t]"
    r"|\\(?P<edge>begin|end)[ \t]*\{(?P<env>[^}\n]*)\}"
    r"|(?P<blank>(?:\r\n|\n|\r)[ \t]*(?:(?:\r\n|\n|\r)[ \t]*)+)"
    r"|^[ \t]*(?P<item>\\(?:item|bibitem)\b)",
    re.MULTILINE,
)
#: Boundaries inside a block, from coarse to fine: before entries, after sentences, lines and clauses, at spaces and before commands.
_WITHIN = (
    re.compile(r"^(?=[ \t]*(?:\\(?:item|bibitem)\b|[-*+][ \t]|[0-9]+[.)][ \t]))", re.MULTILINE),
    re.compile(r"[.!?]['\")}\]]*[ \t]*(?:\r\n|\n|\r|(?<=[ \t]))[ \t]*(?=[^\s])"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[;,][ \t]*(?=\S)"),
    re.compile(r"[ \t]+(?=\S)|(?<=[^\\A-Za-z])(?=\\[A-Za-z])"),
)
WORDS, TOKENS = len(_WITHIN), len(_WITHIN) + 1


@dataclass
class Node:
    """A part of the text; ``kids`` follow each other and make it up, a block without structure has none."""

    start: int
    end: int
    kind: str  # root, section, env, item or block
    level: int = -1  # of a section; of a block, the kind of boundary to look for first
    name: str = ""
    kids: list[Node] = field(default_factory=list)
    #: Where the block begins that is still open.
    at: int = 0
    #: Nothing but its own mark has come yet.
    fresh: bool = True


def parse(text: str) -> Node:
    """The tree of a text."""
    root = Node(0, len(text), "root")
    stack = [root]

    def block(at: int) -> None:
        """Ends the open block of the innermost node."""
        top = stack[-1]
        if at > top.at:
            top.kids.append(Node(top.at, at, "block", 0))
            top.at = at

    def close(at: int) -> None:
        block(at)
        node = stack.pop()
        node.end = at
        stack[-1].kids.append(node)
        stack[-1].at, stack[-1].fresh = at, False

    def begin(node: Node) -> None:
        block(node.start)
        node.at = node.start
        stack.append(node)

    for m in _MARK.finditer(text):
        kind = m.lastgroup if m.lastgroup != "env" else "edge"
        if kind in ("heading", "hashes"):
            level = HEADINGS.index(m["heading"]) if kind == "heading" else min(len(m["hashes"]), len(HEADINGS)) - 1
            while len(stack) > 1 and not (stack[-1].kind == "section" and stack[-1].level < level):
                close(m.start())
            begin(Node(m.start(), 0, "section", level))
        elif kind == "edge" and m["env"] == "document":
            # The document itself is no block: its body is what the article consists of.
            block(m.start() if m["edge"] == "begin" else m.end())
        elif kind == "edge" and m["edge"] == "begin":
            begin(Node(m.start(), 0, "env", name=m["env"]))
        elif kind == "edge":
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].kind == "env" and stack[k].name == m["env"]), 0)
            # A section that began inside keeps what is its own.
            if depth and all(n.kind != "section" for n in stack[depth:]):
                while len(stack) > depth:
                    close(m.end())
            else:
                block(m.end())
        elif kind == "item":
            if stack[-1].kind == "item":
                close(m.start())
            if stack[-1].kind == "env":
                begin(Node(m.start(), 0, "item"))
            else:
                block(m.start())
        elif not (stack[-1].fresh and not stack[-1].kids and "\n" not in text[stack[-1].start : m.start()].strip()):
            # A mark stays with what follows it.
            block(m.end())
        stack[-1].fresh &= stack[-1].start == m.start()
    while len(stack) > 1:
        close(len(text))
    block(len(text))
    return root


class _Text:
    """A text's words and tokens, and how many tokens lie between two positions."""

    def __init__(self, text: str, encoder: bpe.Encoder):
        self.text, self.encoder = text, encoder
        chars, tokens = encoder.counts(text)
        self.ends = np.cumsum(chars)
        self.upto = np.cumsum(tokens)
        self.total = int(self.upto[-1]) if len(tokens) else 0

    def before(self, at: int) -> int:
        """Tokens before a position; a word that it cuts counts whole."""
        k = int(np.searchsorted(self.ends, at, side="left"))
        return int(self.upto[min(k, len(self.upto) - 1)]) if at > 0 else 0

    def cost(self, start: int, end: int) -> int:
        """Tokens of a slice, at most (words that an end cuts count whole, on both sides)."""
        k = int(np.searchsorted(self.ends, start, side="right"))
        return self.before(end) - (int(self.upto[k - 1]) if k else 0)

    def between(self, cuts: list[int]) -> list[int]:
        """The positions that don't lie inside a word of many tokens (a long run of line ends, say): there only its tokens part it."""
        at = np.array(cuts, "int64")
        k = np.searchsorted(self.ends, at, side="left")
        size = self.upto[k] - np.append(0, self.upto)[k]
        return at[(self.ends[k] == at) | (size <= SPARE)].tolist()

    def token_cuts(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions inside a slice between two tokens of it, where these end with a character, and the tokens before each."""
        cuts, counts, at, n, held = [], [], start, 0, b""
        for word in self.encoder.words(self.text[start:end]):
            for token in self.encoder.tokens_of(word):
                held += token
                n += 1
                try:
                    at += len(held.decode("utf-8", "surrogatepass"))
                except UnicodeDecodeError:
                    continue
                held = b""
                if at < end:
                    cuts.append(at)
                    counts.append(n)
        return np.array(cuts, "int64"), np.array(counts, "int64")

    def place(self, at: int) -> tuple[int, int, int]:
        """The word that a position lies in or ends: its number, its begin, and the tokens before the position."""
        k = int(np.searchsorted(self.ends, at, side="left"))
        begin = int(self.ends[k - 1]) if k else 0
        before = int(self.upto[k - 1]) if k else 0
        if at == self.ends[k]:
            return k, begin, int(self.upto[k])
        cuts, counts = self.token_cuts(begin, int(self.ends[k]))
        i = int(np.searchsorted(cuts, at, side="right")) - 1
        return k, begin, before + (int(counts[i]) if i >= 0 else 0)


def _inside(t: _Text, node: Node, limit: int) -> list[Node]:
    """The parts of a block without structure, at its coarsest boundary."""
    for level in range(max(0, node.level), WORDS):
        cuts = t.between([m.end() for m in _WITHIN[level].finditer(t.text, node.start, node.end) if node.start < m.end() < node.end])
        if cuts:
            edges = [node.start, *cuts, node.end]
            return [Node(a, b, "block", level + 1) for a, b in zip(edges, edges[1:])]
    if node.level <= WORDS:
        a, b = np.searchsorted(t.ends, node.start, side="right"), np.searchsorted(t.ends, node.end, side="left")
        edges = [node.start, *t.ends[a:b].tolist(), node.end]
        if len(edges) > 2:
            return [Node(a, b, "block", TOKENS) for a, b in zip(edges, edges[1:])]
    # Inside one word: as many tokens as fit.
    cuts, counts = t.token_cuts(node.start, node.end)
    steps, taken = [node.start], 0
    while (i := int(np.searchsorted(counts, taken + limit, side="right")) - 1) >= 0 and counts[i] > taken and i < len(cuts) - 1:
        steps.append(int(cuts[i]))
        taken = int(counts[i])
    steps.append(node.end)
    return [Node(a, b, "block", TOKENS + 1) for a, b in zip(steps, steps[1:])]


def pack(t: _Text, root: Node, limit: int) -> list[tuple[int, int]]:
    """Slices under the limit that make up a tree: whole siblings merged, oversized nodes opened."""
    out: list[tuple[int, int]] = []
    work: list[Node] = [root]  # what is left, last first; nodes of level TOKENS + 1 are pieces
    while work:
        node = work.pop()
        if node.level > TOKENS or t.cost(node.start, node.end) <= limit:
            out.append((node.start, node.end))
            continue
        kids = node.kids or _inside(t, node, limit)
        edges = np.array([kids[0].start, *(k.end for k in kids)])
        # Tokens before each edge; of an edge inside a word, with the whole word to its left.
        upto = np.append(0, t.upto)[np.searchsorted(t.ends, edges, side="left") + (edges > 0)] if len(t.upto) else np.zeros(len(edges))
        merged: list[Node] = []
        i = 0
        while i < len(kids):
            # As many whole siblings as fit together; one that doesn't fit alone is opened.
            j = int(np.searchsorted(upto, upto[i] + limit, side="right")) - 1
            while j > i and t.cost(int(edges[i]), int(edges[j])) > limit:
                j -= 1
            merged.append(kids[i] if j <= i else Node(int(edges[i]), int(edges[j]), "block", TOKENS + 1))
            i = max(j, i + 1)
        work += merged[::-1]
    return out


def _overlap_start(t: _Text, start: int, overlap: int) -> tuple[int, int]:
    """Where the ``overlap`` tokens before a position begin, and how many they are: fewer only at the text's begin."""
    _, _, have = t.place(start)
    want = have - overlap
    if want <= 0:
        return 0, have
    w = int(np.searchsorted(t.upto, want, side="right"))
    begin = int(t.ends[w - 1]) if w else 0
    drop = want - (int(t.upto[w - 1]) if w else 0)
    if drop:
        # The first of the tokens lies inside a word: begin there if it begins with a character, else a little before.
        cuts, counts = t.token_cuts(begin, int(t.ends[w]))
        i = int(np.searchsorted(counts, drop, side="right")) - 1
        if i >= 0:
            return int(cuts[i]), overlap + drop - int(counts[i])
    return begin, overlap + drop


def pieces_of(text: str, encoder: bpe.Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """Of a text over the limit: each piece's begin, the end of its overlap, its end, its tokens and its overlap's tokens."""
    if not text or len(text) * 4 <= limit:
        return []
    t = _Text(text, encoder)
    if t.total <= limit:
        return []
    tree, inner = parse(text), limit - overlap - SPARE
    while True:
        # A few tokens stay free, as a slice's first and last word may split otherwise than in the whole.
        out = _with_overlaps(t, pack(t, tree, inner), limit, overlap)
        over = max(n for *_, n, _ in out) - limit
        if over <= 0:
            return out
        if inner <= over:
            raise ValueError(f"no pieces of at most {limit} tokens with an overlap of {overlap}")
        inner -= over


def _with_overlaps(t: _Text, cores: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    text, encoder = t.text, t.encoder
    out = []
    for k, (start, end) in enumerate(cores):
        begin, shared = _overlap_start(t, start, overlap) if k else (start, 0)
        n = len(encoder.encode(text[begin:end]))
        while n > limit and begin < start:
            # Only where a slice splits otherwise than the whole text by more than the tokens kept free.
            begin += 1
            n = len(encoder.encode(text[begin:end]))
            shared = len(encoder.encode(text[begin:start]))
        out.append((begin, start, end, n, shared))
    return out


def cut_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary_path: str = bpe.DEFAULT_PATH) -> DataFrame:
    """doc_id, piece_no, char_from, char_core, char_to, n_tokens, overlap_tokens, piece of every text over the limit. Nothing is shuffled, unless the input has fewer splits than cores."""
    columns = ["doc_id", "piece_no", "char_from", "char_core", "char_to", "n_tokens", "overlap_tokens", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.encoder(vocabulary_path)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                rows = [(d, k, a, s, b, n, o, t[a:b]) for d, t in zip(part.doc_id, part.text) if isinstance(t, str) for k, (a, s, b, n, o) in enumerate(pieces_of(t, encoder, limit, overlap))]
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, piece_no int, char_from long, char_core long, char_to long, n_tokens int, overlap_tokens int, piece string")
