"""Token ids of the tokenizers library, with a cache of space-delimited pieces.

A byte-level BPE never joins characters across a space that stands alone between words,
so a text's ids are the ids of its pieces laid end to end. Pieces repeat, whole texts
don't: a worker asks the library for a piece once while its cache has room. Plain pieces
go to the library's BPE model word by word, all others (and texts with odd white space or
with an added token such as <|endoftext|>, and tokenizers of another kind) through its full encoder.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from textguard.llm import memory

#: Pieces and bare words kept by one worker, and the longest piece kept; together they bound its memory.
CACHE_PIECES, CACHE_WORDS, CACHE_CHARS = 600_000, 50_000, 32
#: A space inside or at the end of a run of white space: piece borders are not token borders there.
_ODD_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Pieces for which Python's and the library's character classes surely agree.
_PLAIN = re.compile("[\n\x20-\x7eÀ-ÖØ-öø-ſ]+").fullmatch
#: Words of a plain piece, as the byte-level pre-tokenizer cuts them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+").findall


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: a byte that prints stands for itself, the others follow from U+0100."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(0x100 + k) for k, b in enumerate(moved)}


#: What may follow a word without being part of it, and how long a tail may be to be looked up.
_TAIL, _TAIL_CHARS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 4


class _Words(dict):
    """Ids of a word as the pre-tokenizer cuts it, with or without a space before it."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.letters = tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = array("I", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


class _Pieces(dict):
    """Ids of a piece together with the space before it, by the piece."""

    def __init__(self, model, full):
        super().__init__()
        self.tokenize, self.full, self.letters = model.tokenize, full, _byte_letters()
        self.space, self.words = self.letters[0x20], _Words(model.tokenize)

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_TAIL)
        if len(word) < len(piece):
            # a word and its tail are tokenized apart, so the word's ids serve all its tails
            if word.isalpha() and len(piece) - len(word) <= _TAIL_CHARS and (word.isascii() or _PLAIN(word)):
                known = self.get(word)
                found = (self[word] if known is None else known) + self.words[piece[len(word) :]]
                if known is None:  # perhaps never met again
                    return found
            else:
                found = self.ids(f" {piece}")
        elif piece.isalpha() and (piece.isascii() or _PLAIN(piece)):
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.tokenize(self.space + mapped)]).tobytes()
        else:
            found = self.ids(f" {piece}")
        if len(self) < CACHE_PIECES and len(piece) <= CACHE_CHARS:
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(text) > CACHE_CHARS or not _PLAIN(text):
            return self.full(text)
        return b"".join([self[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w] for w in _WORDS(text)])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens") or () if t["content"]]
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.pieces = _Pieces(self.tokenizer.model, self.whole)

    def whole(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, straight from the full encoder."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; null is empty."""
        if not text:
            return b""
        if not self.by_piece or _ODD_SPACE.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        head, *tail = text.split(" ")
        return (self.pieces.ids(head) if head else b"") + b"".join(map(self.pieces.__getitem__, tail))


_ENCODERS: dict[str, Encoder] = memory.keep("bpe", {})


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
