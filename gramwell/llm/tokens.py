"""Token ids of texts by a public byte-level BPE, as packed unsigned 16-bit numbers."""

from __future__ import annotations

import re
import sys
from array import array
from functools import cached_property

from gramwell.llm.workers import remembered

#: A space before white space or the end: texts with one are not cut at spaces.
_LOOSE = re.compile(r" (?:\s|\Z)")
#: Letters, then marks that are neither letters, digits nor white space, nor start a contraction.
_ENDED = re.compile(r"([^\W\d_]+)([.,;:!?]+)")
LONGEST_CACHED, REMEMBERED = 48, 600_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Encodes texts as the tokenizer file does, without special tokens.

    The pre-tokenizer never joins what stands on two sides of a single space between non-spaces, so a
    text is cut at spaces and each piece (with its leading space) is encoded once and remembered; the
    memory forgets everything when it is full. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        self.vocabulary, self.rank = vocabulary, None
        if vocabulary.endswith("byte_bpe_50k.json"):
            # the same vocabulary and pattern for a faster library
            import base64
            from pathlib import Path

            import public_tokenizers
            import tiktoken

            lines = Path(vocabulary).with_suffix(".tiktoken").read_bytes().splitlines()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.rank = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        elif self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids of this vocabulary don't fit 16 bits")

    @cached_property
    def tokenizer(self):
        """The tokenizer of the file, which the faster library does without."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.vocabulary)
        out.encode_special_tokens = True
        return out

    def ids(self, text: str) -> list[int]:
        if self.rank is not None:
            return self.rank.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pack(self, text: str) -> bytes:
        out = array("H", self.ids(text))
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, piece: str) -> bytes:
        if m := _ENDED.fullmatch(piece):
            # letters and the marks after them are encoded apart anyway
            out = self[m[1]] + self.pack(m[2])
        else:
            out = self.pack(" " + piece)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        if self.rank is None or _LOOSE.search(text):
            return self.pack(text)
        first, *rest = text.split(" ")
        return self.pack(first) + b"".join(map(self.__getitem__, rest))


def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder, until an operator that needs none begins here."""
    return remembered(("encoder", vocabulary), lambda: Encoder(vocabulary))
