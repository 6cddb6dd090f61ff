"""Token ids with the public vocabularies, by cached chunks.

Both encoders split a text where the tokenizer itself must split it, encode each distinct chunk once through the library,
and join the chunks' ids; the ids equal those of encoding the whole text. Only short chunks are kept, and the cache is
emptied at a fixed number of them, so its bytes are bounded whatever the script. An empty text has no ids.
"""

from __future__ import annotations

import os
import re

LIMIT, LONGEST = 250_000, 64  # chunks kept, and characters of each


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, nxt = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(nxt))
        nxt += b not in own
    return out


class WordEncoder(dict):
    """Lower-casing BPE with word ends; blanks part words and have no ids. Chunk -> ids as little-endian uint32 bytes."""

    #: Letters that lower-case alike everywhere, then ASCII punctuation but the apostrophe, which can start a word ending.
    CORE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model, self.letters, self.parts = self.whole.model, byte_letters(), {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _part(self, part: str, letters: bool) -> bytes:
        if (out := self.parts.get(part)) is None:
            if len(self.parts) >= LIMIT:
                self.parts.clear()
            ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in part.encode()]))] if letters else self.whole.encode(part, add_special_tokens=False).ids
            out = self._packed(ids)
            if len(part) <= LONGEST:
                self.parts[part] = out
        return out

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= LIMIT:
            self.clear()
        if m := self.CORE.fullmatch(chunk):
            out = self._part(m[1].lower(), True) + (self._part(m[2], False) if m[2] else b"")
        else:
            out = self._packed(self.whole.encode(chunk, add_special_tokens=False).ids) if chunk else b""
        if len(chunk) <= LONGEST:
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class Inseparable(Exception):
    pass


class ByteEncoder(dict):
    """Byte-level BPE. Chunks are parted by single spaces between two other characters; texts with other blanks are encoded whole. Chunk -> ids as uint16 bytes."""

    END = 50256

    def __init__(self, path: str | None = None) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(2, "little") for i in ids)

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Inseparable
        if len(self) >= LIMIT:
            self.clear()
        out = self._packed(self.whole.encode_ordinary(" " + chunk))
        if len(chunk) <= LONGEST:
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self._packed(self.whole.encode_ordinary(text))
        try:
            if not first or first[-1].isspace():
                raise Inseparable
            return self._packed(self.whole.encode_ordinary(first)) + b"".join(map(self.__getitem__, rest))
        except Inseparable:
            return self._packed(self.whole.encode_ordinary(text))
