"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text.

A line fails as navigation when separators make up a large part of it, by punctuation when its symbols
outweigh its letters, when most of its words shout, or when it is short and ends without a stop, and as boilerplate when it
holds a set phrase. Lines without a word always stay. A document is rejected when the failed lines hold more
than ``MAX_LOST`` of its word characters, or when it fails the base rules: fewer than 10 words, or more than a
fifth of them in repeated five-word windows.

Null texts count as empty: no words, base failed, not kept. Repeated rows give equal rows.
"""

import re

import numpy as np
from pyspark.sql import DataFrame

from barometry.llm.common import add_columns, as_bytes

#: A document may lose this share of its word characters to failed lines.
MAX_LOST = 0.5
#: A line of fewer words must end with a stop.
SHORT_WORDS = 4
#: Separators per word from which a line is navigation.
NAV_SHARE = 0.25
#: Symbols per word from which a line fails.
SYMBOL_SHARE = 0.5
WINDOW = 5

_BOILERPLATE = re.compile(
    rb"cookie policy|accept (?:all )?cookies|uses cookies|all rights reserved|privacy policy|terms of (?:use|service)"
    rb"|enable javascript|skip to (?:main )?content|subscribe to our|sign up for|click here|read more|share this"
    rb"|powered by|log ?in \|")
_SYMBOLS = b"#*$%&|<>"
_SEPARATORS = (b"|", "»".encode(), "›".encode(), "•".encode(), "·".encode())
_STOPS = tuple(x.encode() for x in ".!?:;…\"')”»。！？")
_NOT_COUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a character


class Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    base, key, span = len(numbers), ids[:n], len(numbers)
    for i in range(1, window):
        if span * base >= 1 << 62:  # number the windows so far anew, so that keys stay exact
            key = np.unique(key, return_inverse=True)[1]
            span = n
        key = key * base + ids[i:n + i]
        span *= base
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return 0
    hit = np.zeros(n, bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    change = np.zeros(len(words) + 1, np.int32)
    change[:n] += hit
    change[window:window + n] -= hit
    return int(np.count_nonzero(np.cumsum(change)))


def characters(data: bytes) -> int:
    """Characters that are not white space."""
    return len(data.translate(None, _NOT_COUNTED))


def line_fails(line: bytes, words: list[bytes]) -> bool:
    n = len(words)
    if sum(map(line.count, _SEPARATORS)) >= NAV_SHARE * n and n > 1:
        return True
    if len(line) - len(line.translate(None, _SYMBOLS)) > SYMBOL_SHARE * n:
        return True
    if 2 * line.count(b"!!") > n:
        return True
    if n < SHORT_WORDS and not words[-1].endswith(_STOPS):
        return True
    return _BOILERPLATE.search(line.lower()) is not None


def judge(data: bytes) -> tuple:
    """All figures of one text, and the text without its failed lines."""
    words = data.split()
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    dup = failed = lost = with_words = 0
    kept_lines = []
    for line in lines:
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        with_words += 1
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, own):
            failed += 1
            lost += characters(line)
        else:
            kept_lines.append(line)
    n, chars, repeat = len(words), characters(data), repeated_words(words)
    base_failed = n < 10 or 100 * repeat > 20 * n
    lost_share = lost / chars if chars else 0.0
    return (n, chars, len(data) - len(data.translate(None, _SYMBOLS)), dup, repeat, base_failed,
            not base_failed and lost_share <= MAX_LOST, with_words, failed, lost_share, b"\n".join(kept_lines).decode())


OUTPUTS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "n_lines": "bigint",
    "n_failed_lines": "bigint", "lost_share": "double", "cleaned": "string"}


def quality(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``OUTPUTS``: counts, both verdicts and the cleaned text."""

    def make():
        def work(texts):
            rows = [judge(x or b"") for x in as_bytes(texts)]
            return [list(c) for c in zip(*rows)]

        return work

    return add_columns(df, [text], OUTPUTS, make, drop)
