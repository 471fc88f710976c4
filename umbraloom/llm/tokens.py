"""Encoders of the public vocabularies, and the bytes that each token stands for."""

from __future__ import annotations

import json
import re

import sentencepiece
import tiktoken
from tokenizers import Tokenizer

#: Texts of more characters are searched for runs of blanks, and runs of so many go to the tokenizers library.
LONG = 100_000
_RUN = re.compile(r"\s{%d}" % LONG)
_PIECE_SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the other bytes, in order,
    for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """A byte-level vocabulary from a tokenizers file.

    Ids are those of the tokenizers library without added special tokens. They come from tiktoken, which has the same merges at about five times
    the speed, but where its pattern matcher gives up (long runs of blanks): such texts are encoded by the tokenizers library itself.
    special_as_text: the special tokens' strings in a text are plain text; else they are those tokens.
    """

    def __init__(self, path: str, pattern: str, special_as_text: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, special = byte_letters(), {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.path, self.special, self.special_as_text, self._exact = path, tuple(special), special_as_text, None
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.size = 1 + max([*ranks.values(), *special.values()])
        self.bytes = [b""] * self.size
        for t, i in ranks.items():
            self.bytes[i] = t
        for t, i in special.items():
            self.bytes[i] = t.encode()

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG or not _RUN.search(text):
            try:
                if not self.special_as_text and any(s in text for s in self.special):
                    return self.fast.encode(text, allowed_special="all")
                return self.fast.encode_ordinary(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # what tiktoken raises where its matcher gives up
                    raise
        if self._exact is None:
            self._exact = Tokenizer.from_file(self.path)
            self._exact.encode_special_tokens = self.special_as_text
        return self._exact.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentence-piece vocabulary. Its encoder puts a space before a text."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [self._bytes(i) for i in range(self.size)]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(_PIECE_SPACE, " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)
