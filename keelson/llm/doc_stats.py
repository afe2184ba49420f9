"""Statistics of one document, shared by the quality classifier and the quality rules.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, which
is also how bytes.split() cuts.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

# Character classes.
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"
STOPS = (b".", b"!", b"?", b'"', b";", b":")
#: Words in a block in which distinct words are counted.
BLOCK = 1000
# End of fixed values.

#: Names of what `stats` returns, in order.
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_lower",
    "n_digits", "n_stops", "n_commas", "n_bangs", "n_distinct", "n_twins", "n_stop_lines", "longest_word", "n_pipes", "n_cased_words",
    "block_words", "block_distinct",
)


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more; the first find counts too."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(reach, i)
            reach = i + 3
    return total


def blocks(words: list[bytes]) -> tuple[int, int]:
    """Words and distinct words, added up over all blocks of BLOCK words of the whole text; the last block ends with the text and may overlap the one before."""
    n = len(words)
    if n <= BLOCK:
        return n, len(set(words))
    starts = [*range(0, n - BLOCK, BLOCK), n - BLOCK]
    return BLOCK * len(starts), sum(len(set(words[i : i + BLOCK])) for i in starts)


def stats(text: bytes) -> tuple[int, ...]:
    """The numbers named in FIELDS for one UTF-8 text."""
    words = text.split()
    n, chars = len(words), len(text.decode("utf-8", "replace"))
    in_words = sum(map(len, words))
    seen: set[bytes] = set()
    lines = dups = stopped = 0
    for line in text.split(b"\n"):
        if bare := line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
            stopped += bare.endswith(STOPS)
    return (
        n, chars - (len(text) - in_words), _without(text, SYMBOLS), dups, repeat_words(words), chars, lines, _without(text, UPPER), _without(text, LOWER),
        _without(text, DIGITS), _without(text, b".?"), _without(text, b",;"), text.count(b"!"), len(set(words)), sum(map(eq, words, words[1:])), stopped,
        max(map(len, words), default=0), text.count(b"|"), sum(map(bytes.isupper, words)),
        *blocks(words),
    )


def table(texts: list[bytes]) -> np.ndarray:
    """One row of FIELDS for each text."""
    return np.array([stats(t) for t in texts], dtype=np.int64).reshape(len(texts), len(FIELDS))
