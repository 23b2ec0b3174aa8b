"""Pieces and pre-tokens of texts for the word-end BPE vocabulary, as Python helpers for code that runs inside tasks.

A text is cut at white space first. No pre-token crosses white space and normalisation never joins two pieces, so the ids
of a text are those of its pieces in a row, and pieces that occur again are looked up. Pieces of Latin characters
alone (below U+0180, where no version of Unicode differs and nothing is composed) are split here; all others go through
the normaliser and the splitter of the tokenizer itself, whose Unicode tables count.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

# Fixed values of the vocabulary file: its normaliser and splitter.
ADDED = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
# The splitter as it is for lowered characters below U+0180: letters, numbers, all others.
LATIN = re.compile("[\0-\u017f]*")
LETTERS, NUMBERS = "a-zªµºß-öø-\u017f", "0-9²³¹¼-¾"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\t-\\r \x85\xa0{LETTERS}{NUMBERS}]+")
# White space for str.split() only, not for the splitter; and characters it sees but str.split() cuts at.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_END = "</w>"


def byte_characters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTE_CHARACTERS = byte_characters()


def as_byte_characters(word: str) -> str:
    return word if word.isascii() and word.isprintable() else "".join(BYTE_CHARACTERS[b] for b in word.encode("utf-8"))


def pieces(text: str) -> list[str]:
    """The parts of a text that are encoded on their own."""
    if SEPARATORS.search(text):
        return re.split(f"[{WHITE}]+", text)
    return text.split()


class Kept(dict):
    """What `make` gives for a key, remembered for the last `most` to twice as many keys that came up."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


def tokenizer(path: str):
    """The tokenizer of a vocabulary file, without threads of its own: Spark's tasks fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def rules(path: str):
    """The tokenizer of a vocabulary file without its model, for its normaliser and splitter alone: half as much memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    data = vocabulary(path)
    data["model"] |= {"vocab": {}, "merges": []}
    return Tokenizer.from_str(json.dumps(data | {"added_tokens": [], "post_processor": None, "decoder": None}))


def splitter(library) -> Callable[[str], list[str]]:
    """The pre-tokens of a piece in byte characters, as the tokenizer's own normaliser and splitter give them."""
    normalise, split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
    return lambda piece: [word for word, _ in split(normalise(piece))]


class PieceEncoder:
    """Ids of a text as unsigned 32-bit little-endian bytes.

    `encode_word` gives those of a pre-token in byte characters, `split` the pre-tokens of a piece that is not Latin.
    """

    def __init__(self, encode_word, split, added: dict[str, int], most: int = 250_000):
        self.encode_word, self.split, self.added = encode_word, split, added
        self.words, self.shown = Kept(self._word, most // 2), Kept(self._shown, most // 4)
        self.pieces = Kept(self._piece, most)

    def _word(self, word: str) -> bytes:
        return self._shown(as_byte_characters(word))

    def _shown(self, word: str) -> bytes:
        return np.array(self.encode_word(word), "<u4").tobytes()

    def _plain(self, piece: str) -> bytes:
        words = self.words
        if LATIN.fullmatch(piece):
            return b"".join([words[x] for x in PRE_TOKEN.findall(piece.lower())])
        shown = self.shown
        return b"".join([shown[x] for x in self.split(piece)])

    def _piece(self, piece: str) -> bytes:
        if "<|" not in piece:
            return self._plain(piece)
        parts = enumerate(ADDED.split(piece))
        return b"".join([self.added[x].to_bytes(4, "little") if i % 2 else self._plain(x) for i, x in parts])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text. Null and empty texts have none."""
        known = self.pieces
        return b"".join([known[x] for x in pieces(text)]) if text else b""


class WordEncoder(PieceEncoder):
    """The same ids, with whole Latin texts cut into pre-tokens at once: far fewer different ones come up than pieces.

    White space ends a pre-token by itself there. Texts with other characters are still cut into pieces first.
    """

    def __init__(self, encode_word, split, added: dict[str, int], most: int = 250_000):
        super().__init__(encode_word, split, added, most)
        self.words = Kept(self._word, most)

    def encode(self, text: str | None) -> bytes:
        if text and LATIN.fullmatch(text):
            return self._piece(text)
        return super().encode(text)


def vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)
