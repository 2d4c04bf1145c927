"""Byte-level BPE of a public vocabulary as a bounded-lookahead streaming transducer, and its inverse.

A text may come in pieces of any size; ids leave as soon as they are stable, and what is held in between is bounded.

* ``Splitter`` cuts the text into words. It holds back its last two matches, the only ones that further text can change; of
  a word longer than ``OPEN`` characters it hands over what has come and goes on within the word.
* ``Transducer`` turns a word's bytes into tokens position by position: the encoding of a prefix ends in the one token that
  forms a valid pair with the token before it, so one back pointer per byte suffices. No later token begins more than
  ``lookahead - 1`` bytes back, where ``lookahead`` is the length of the longest token that the merge list can produce.
  Tokens before the last boundary that all live back pointers share are therefore stable and are emitted.

Every token comes from the transducer. As words recur, the tokens of whole words that have gone through it are kept in a
table of bounded size; that saves time only.

Null and empty texts have no tokens. Special tokens are not known here: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex

#: Fixed value: how the public vocabulary splits texts into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only, for the faster engine.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1 << 18
#: A word of more characters is handed over in parts.
OPEN = 1 << 10
#: Words that the table holds at most, and pairs of tokens whose validity is known.
KEPT_WORDS, KEPT_PAIRS = 1 << 18, 1 << 20
#: Kinds of words by their first character after an optional space, with the pattern of what continues one.
LETTERS, NUMBERS, OTHERS, SPACES = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"[^\s\p{L}\p{N}]+"), regex.compile(r"\s+")


class Vocabulary:
    """Tokens by rank, and what the transducer derives from the merge list."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # Tokens that the merges lead to; others never come out.
        self.made = {t: i for t, i in ranks.items() if len(t) == 1 or self._halves_merge(t)}
        #: Bytes after which no later token can reach back.
        self.lookahead = max(map(len, self.made), default=1)
        # Lengths of the tokens that end in two given bytes, so that few candidates are tried at a position.
        lengths: dict[bytes, set[int]] = {}
        for t in self.made:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {end: sorted(n) for end, n in lengths.items() if len(end) == 2}
        self._valid: dict[tuple[bytes, bytes], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})

    def merge(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merge list applied to a few bytes by its definition: the pair of lowest rank under ``below``, leftmost first, until none is left."""
        parts = [data[k : k + 1] for k in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            ranked = [get(a + b, below) for a, b in zip(parts, parts[1:])]
            low = min(ranked)
            if low >= below:
                break
            k = ranked.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _halves_merge(self, token: bytes) -> bool:
        """Whether a token's bytes merge into it: the merges before its own leave just two parts."""
        return len(self.merge(token, self.ranks[token])) == 2

    def valid(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens in a row stay as they are."""
        known = self._valid.get((left, right))
        if known is None:
            if len(self._valid) >= KEPT_PAIRS:
                self._valid.clear()
            known = self._valid[left, right] = self.merge(left + right) == [left, right]
        return known


class Transducer:
    """Bytes of one word in, tokens out; holds the bytes and back pointers since the last token that left."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.kept = bytearray()
        self.ends: list[int] = [0]  # length of the token that ends at each position of kept; 0 where none can
        self.before = b""  # the last token that left
        self.since = 0

    def feed(self, data: bytes) -> list[bytes]:
        """Takes more of the word; the tokens that became stable."""
        v = self.vocabulary
        made, lengths, valid, pairs = v.made, v.lengths, v.valid, v._valid
        kept, ends, out = self.kept, self.ends, []
        for byte in data:
            kept.append(byte)
            at = len(kept)
            # A single byte is the last resort of the ascending order: it is tried first, as is each shorter token.
            for n in (1, *lengths.get(bytes(kept[-2:]), ())):
                if n > at:
                    break
                start = at - n
                back = ends[start]
                if start and not back:
                    continue
                token = bytes(kept[start:])
                if token not in made:
                    continue
                last = bytes(kept[start - back : start]) if start else self.before
                if not last:
                    ends.append(n)
                    break
                known = pairs.get((last, token))
                if valid(last, token) if known is None else known:
                    ends.append(n)
                    break
            else:
                ends.append(0)
            self.since += 1
            if self.since >= v.lookahead:
                self.since = 0
                out += self._stable()
        return out

    def finish(self) -> list[bytes]:
        """The word ends here: the tokens that are left."""
        out = self._path(len(self.kept))
        self.kept.clear()
        self.ends[:], self.before, self.since = [0], b"", 0
        return out

    def _path(self, at: int) -> list[bytes]:
        out = []
        while at:
            out.append(bytes(self.kept[at - self.ends[at] : at]))
            at -= self.ends[at]
        return out[::-1]

    def _stable(self) -> list[bytes]:
        """Takes off the tokens before the last boundary that the paths to all live positions share."""
        kept, ends = self.kept, self.ends
        live = {p for p in range(max(0, len(kept) - self.vocabulary.lookahead + 1), len(kept) + 1) if p == 0 or ends[p]}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - ends[far])
        (cut,) = live
        done = self._path(cut)
        if done:
            self.before = done[-1]
            del kept[:cut]
            ends[:] = [0, *ends[cut + 1 :]]
        return done


class Splitter:
    """Pieces of a text in, words out; of a word longer than ``OPEN`` the part that has come."""

    def __init__(self):
        self.held = ""
        self.run = None  # pattern of the word that is open

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[list[str], str, bool]]:
        """(whole words, part of an open word, whether that word ends here), in the order of the text."""
        text = self.held + piece
        self.held = ""
        if self.run is not None:
            m = self.run.match(text)
            end = m.end() if m else 0
            over = last or end < len(text)
            # White space before a word leaves its last character to it; more may come after what is here.
            if self.run is SPACES and end and (not over or end < len(text)):
                end -= 1
            yield [], text[:end], over
            text = text[end:]
            if not over:
                self.held = text
                return
            self.run = None
        words = (_ASCII_SPLIT if text.isascii() else _SPLIT)(text)
        if last:
            yield words, "", False
            return
        done, ahead = words[:-2], words[-2:]
        self.held = "".join(ahead)
        if ahead and len(ahead[-1]) > OPEN:
            word = ahead[-1]
            first = word[1:2] if word[0] == " " and not SPACES.match(word[1:2]) else word[:1]
            self.run = next(r for r in (LETTERS, NUMBERS, SPACES, OTHERS) if r.match(first))
            end = len(word) - (self.run is SPACES)
            self.held = word[end:]
            yield done + ahead[:-1], word[:end], False
        else:
            yield done, "", False


_SPLIT = regex.compile(PATTERN).findall
_ASCII_SPLIT = re.compile(ASCII_PATTERN).findall


class Encoder:
    """Texts to ids; holds a bounded table of the words met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._words: dict[str, bytes] = _Words(vocabulary)

    def _ids(self, tokens: list[bytes]) -> bytes:
        ranks = self.vocabulary.ranks
        return np.array([ranks[t] for t in tokens], "<i4").tobytes()

    def stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids (4 bytes each) of a text that comes in pieces, as they become stable; memory doesn't grow with the text."""
        splitter, known = Splitter(), self._words
        open_word: Transducer | None = None

        def blocks() -> Iterator[tuple[str, bool]]:
            for piece in pieces:
                for at in range(0, len(piece), BLOCK):
                    yield piece[at : at + BLOCK], False
            yield "", True

        for block, last in blocks():
            for words, part, ends in splitter.feed(block, last):
                if words:
                    yield b"".join([known[w] for w in words])
                if part or open_word:
                    open_word = open_word or Transducer(self.vocabulary)
                    tokens = open_word.feed(part.encode("utf-8", "surrogatepass"))
                    if ends:
                        tokens += open_word.finish()
                        open_word = None
                    if tokens:
                        yield self._ids(tokens)
        if open_word:
            yield self._ids(open_word.finish())

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join(self.stream((text,))) if text else b"", "<i4")

    def words(self, text: str) -> list[str]:
        """The words of a text."""
        return (_ASCII_SPLIT if text.isascii() else _SPLIT)(text)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of a text, its characters and its tokens."""
        known = self._words
        words = self.words(text)
        n = len(words)
        return np.fromiter(map(len, words), "int64", n), np.fromiter((len(known[w]) for w in words), "int64", n) // 4

    def tokens_of(self, word: str) -> list[bytes]:
        tokens = self.vocabulary.tokens
        return [tokens[i] for i in np.frombuffer(self._words[word], "<i4").tolist()]


class _Words(dict):
    """Ids by word, each as the transducer gave them; the last long word is kept apart, as its document asks for it again."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.long: tuple[str, bytes] = ("", b"")

    def __missing__(self, word: str) -> bytes:
        if word == self.long[0]:
            return self.long[1]
        t = Transducer(self.vocabulary)
        tokens = t.feed(word.encode("utf-8", "surrogatepass")) + t.finish()
        ranks = self.vocabulary.ranks
        ids = np.array([ranks[x] for x in tokens], "<i4").tobytes()
        if len(word) > OPEN:
            self.long = (word, ids)
            return ids
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Decoder:
    """Ids to text as they come: a state machine that holds the bytes of an unfinished character only."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.state.decode(b"".join([self.tokens[int(i)] for i in ids]), last)


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_PATH) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(Vocabulary.load(path))
