"""Where the pre-tokens of byte-level tokenizers begin, for many texts at once.

The pattern tells letters, digits, white space and all else apart. A pre-token begins where the kind
changes; of a run of white space in front of something, the last character stands alone, and if it is a
space it is the first character of what follows. The contractions of the pattern end a pre-token after them.
"""

from __future__ import annotations

import numpy as np

#: Contractions that the pattern names (fixed values of the format).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3


def kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for low in range(0, 0x110000, 0x10000):
        text = "".join(chr(p) for p in range(low, low + 0x10000) if not 0xD800 <= p < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
            for c in regex.findall(pattern + "+", text):
                out[np.frombuffer(c.encode("utf-32-le"), np.uint32)] = kind
    return out


class Boundaries:
    def __init__(self):
        self.kinds = kinds()

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at a code point; ``first`` says where texts begin."""
        n = len(points)
        kind = self.kinds[points]
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # something behind white space, in the same text
        behind = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
        start[behind - 1] = True
        start[behind] = points[behind - 1] != 32
        marks = np.flatnonzero((points == 39) & start)
        if len(marks):
            padded = np.concatenate([points, np.zeros(3, points.dtype)])
            ends = np.concatenate([first, np.ones(3, bool)])
            for c in CONTRACTIONS:
                hit = marks
                for k, x in enumerate(c, 1):
                    hit = hit[(padded[hit + k] == ord(x)) & ~ends[hit + k]]
                start[hit + 1] = False
                after = hit + len(c) + 1
                start[after[after < n]] = True
        return start

    def pieces(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens begin in ``data``, texts in UTF-8 one after the other that begin at ``begins``."""
        head = (data & 0xC0) != 0x80  # the first byte of each code point
        first = np.zeros(len(data), bool)
        first[begins[begins < len(data)]] = True
        if head.all():
            return np.flatnonzero(self.starts(data.astype(np.uint32), first))
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero(head)
        return at[self.starts(points, first[at])]
