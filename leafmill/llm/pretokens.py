"""Cutting a text into chunks that a byte-level tokenizer treats independently.

The pattern of the byte-level vocabularies lets a token take one space in front and nothing across
a later one. A space with no white space on at least one side therefore begins a pre-token whatever
stands around it, and each stretch up to the next such space can be cut, and remembered, alone.
Texts in which a space stands inside a longer run of white space are cut by the pattern itself.
"""

from __future__ import annotations

import re

#: Patterns with that property (fixed values of their formats); for others a text's chunks are its pre-tokens.
SPACED = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
_INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")


class Cutter:
    """``chunks(text)`` and ``pieces(chunk)`` for one pattern."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.plain = pattern in SPACED

    def apart(self, text: str) -> list[str] | None:
        """The pre-tokens of a text that isn't cut before each of its spaces, else None."""
        if self.plain and not _INSIDE_RUN.search(text):
            return None
        return self.find(text)

    def chunks(self, text: str) -> list[str]:
        """Chunks in order; joined they are the text, and no pre-token crosses two of them."""
        parts = self.apart(text)
        if parts is not None:
            return parts
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        if first:
            out.insert(0, first)
        return out

    def pieces(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk; single words, with a mark behind or not, need no pattern."""
        if not self.plain:
            return [chunk]
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def raw_pieces(self, chunk: bytes) -> list[bytes]:
        """:meth:`pieces` in UTF-8; ASCII words need no decoding."""
        if self.plain:
            body = chunk[1:] if chunk[0] == 32 else chunk
            if body.isalpha():
                return [chunk]
            if body[-1:] in (b".", b",") and body[:-1].isalpha():
                return [chunk[:-1], chunk[-1:]]
        return [p.encode("utf-8") for p in self.pieces(chunk.decode("utf-8"))]
