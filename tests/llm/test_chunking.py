"""Pieces give the text back, keep the limit, overlap, and begin at boundaries."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import bpe, chunking
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder()


def check(text, encoder, limit, overlap):
    n = len(encoder.encode(text))
    pieces = chunking.pieces_of(text, encoder, limit, overlap)
    assert bool(pieces) == (n > limit)
    if pieces:
        assert "".join(text[s:e] for _, s, e, _, _ in pieces) == text
        for k, (begin, start, end, size, shared) in enumerate(pieces):
            assert begin <= start < end and size == len(encoder.encode(text[begin:end])) <= limit
            # By itself the overlap's last white space may be one token less than in the text.
            assert abs(shared - len(encoder.encode(text[begin:start]))) <= 2 and (k > 0 or shared == 0)
    return pieces


def article(seed, sections):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice("the dense orbit of a slow sensor bounds each vortex".split()) for _ in range(12)).capitalize() + "."
    out = ["\\documentclass{article}\n\\begin{document}\n"]
    for k in range(sections):
        out.append(f"\\section{{Part {k}}}\n")
        for _ in range(rng.randrange(1, 5)):
            out.append("\n".join(sentence() for _ in range(rng.randrange(1, 6))) + "\n\n")
        out.append("\\begin{equation}\n x_{1} = \\frac{a}{b}\n\\end{equation}\n\n")
    return "".join(out) + "\\end{document}\n"


@pytest.mark.parametrize("seed", range(5))
def test_article(encoder, seed):
    text = article(seed, 30)
    pieces = check(text, encoder, 256, 32)
    edges = set()

    def walk(node):
        edges.update((node.start, node.end))
        for kid in node.kids:
            walk(kid)

    walk(chunking.parse(text))
    assert all(s in edges for _, s, *_ in pieces[1:])
    assert all(32 <= shared <= 36 for *_, shared in pieces[1:])


@settings(max_examples=150, deadline=None)
@given(text=st.text("ab .\n\r{}\\é日1#-", max_size=600))
def test_any_text(encoder, text):
    check(text, encoder, 40, 8)


@pytest.mark.parametrize("text", ["x" * 9_000, "∮∇" * 3_000, " " * 9_000, "word " * 4_000, "\n" * 5_000, "a\r\n" * 3_000, "1;2;3;" * 2_000, "q" * 100 + " " + "日" * 5_000])
def test_texts_without_structure(encoder, text):
    check(text, encoder, 512, 64)


@pytest.mark.parametrize("text", ["\n" * 5_000, "a\n" + " \n" * 4_000 + "b", ";,; " * 50 + "\r\n" * 3_000])
def test_long_runs_of_line_ends_stay_few_pieces(encoder, text):
    pieces = check(text, encoder, 512, 64)
    assert len(pieces) <= 2 + len(encoder.encode(text)) // 300


def test_headings_are_preferred(encoder):
    text = "\\section{A}\n" + "one two three.\n" * 20 + "\\subsection{B}\n" + "four five six.\n" * 20 + "\\section{C}\n" + "seven eight.\n" * 20
    pieces = check(text, encoder, 200, 16)
    assert {text[s:].split("\n")[0] for _, s, *_ in pieces[1:]} <= {"\\subsection{B}", "\\section{C}"}


def whole(node, text):
    """Children make up their node, in order."""
    if node.kids:
        assert node.kids[0].start == node.start and node.kids[-1].end == node.end
        assert all(a.end == b.start for a, b in zip(node.kids, node.kids[1:]))
        for kid in node.kids:
            whole(kid, text)


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(["\\section{A}", "\n\\subsection{B}\n", "\\begin{itemize}", "\\end{itemize}", "\n\\item x", "\n\n", "\\begin{a}", "\\end{a}", "word. ", "\n", "\\end{document}", "\\begin{document}", "\n# H\n", "\r\n\r\n", "- e\n"]), max_size=40))
def test_any_marks_make_a_tree(encoder, parts):
    text = "".join(parts)
    whole(chunking.parse(text), text)
    check(text, encoder, 40, 8)


def nested(depth, n):
    """A list of n items, each with a list of n items, and so on."""
    if not depth:
        return "one two three four five.\n"
    return "\\begin{itemize}\n" + "".join(f"\\item entry {depth}\n{nested(depth - 1, n)}" for _ in range(n)) + "\\end{itemize}\n"


def test_nested_lists_are_a_tree(encoder):
    """Only oversized nodes are opened: pieces are whole items of the depth at which they fit, with their siblings."""
    text = "\\section{A}\n" + nested(3, 4) + "\\section{B}\nshort.\n"
    tree = chunking.parse(text)
    assert [k.kind for k in tree.kids] == ["section", "section"]
    outer = tree.kids[0].kids[1]
    assert outer.kind == "env" and [k.kind for k in outer.kids] == ["block", *["item"] * 4]
    inner = outer.kids[1].kids[1]
    assert inner.kind == "env" and len(inner.kids) == 5 and inner.kids[1].kids[1].kind == "env"
    t = chunking._Text(text, encoder)
    size = t.cost(inner.start, inner.end)
    pieces = chunking.pack(t, tree, size + 20)
    assert "".join(text[a:b] for a, b in pieces) == text
    # Each outer item is a piece of its own, and the section after the list isn't merged into the list's last item.
    assert [text[a:b].count("entry 3") for a, b in pieces].count(1) == 4 and text[slice(*pieces[-1])].startswith("\\section{B}")
    # With less room the inner lists are opened, and their items merged with one another only.
    finer = chunking.pack(t, tree, size // 2)
    assert max(t.cost(a, b) for a, b in finer) <= size // 2
    opened = [text[a:b] for a, b in finer if text[a:b].startswith("\\item entry 2")]
    assert opened and all("entry 3" not in x for x in opened)


def test_very_deep_and_malformed(encoder):
    for text in ("\\begin{a}\n" * 3_000 + "x " * 3_000, "\\end{a}\n" * 3_000 + "x " * 3_000, "\\begin{a}\\section{S} " * 2_000):
        check(text, encoder, 512, 64)


def test_tables(spark, encoder):
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, article(1, 120), "x"), (4, article(1, 120), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = chunking.cut_documents(df).collect()
    assert {r.doc_id for r in got} == {4} and len(got) % 2 == 0
    assert chunking.cut_documents(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("length(text) > 5000")
    over = {r.doc_id for r in docs.collect() if len(encoder.encode(r.text)) > 2048}
    pieces = chunking.cut_documents(docs).collect()
    assert {r.doc_id for r in pieces} == over and max(r.n_tokens for r in pieces) <= 2048
