"""Fill-in-the-middle: texts cut at unit borders and rearranged around three marks.

A text is a sequence of units: runs of ASCII letters, and single code points of any other kind. Two hashed
numbers choose the borders, a third whether the text stays plain, a fourth the order of the parts:

* plain: the text itself; always so if it is empty or holds one of the marks,
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

The units are never listed. The UTF-8 bytes are viewed as 64-bit words, and arithmetic on whole words marks
the last byte of every unit by its top bit; ``bitwise_count`` gives the units of a word, a search in their running
sum finds the word that holds the k-th border, and a multiplication resolves the place within it. Work is linear in the
bytes, whatever the number of units, and about three words of memory are needed for each eight bytes of the longest text.

Null texts are empty. The numbers are hashed from the seed and the id in decimal, so a retried task draws the
same and rows with equal ids draw equal numbers; a null id counts as an empty one.
"""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.llm.common import add_columns, as_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of the texts that stay plain, and per cent of the others whose suffix comes first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20

OUTPUTS = {"n_units": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "infill": "string"}


def every_byte(value: int) -> np.uint64:
    return np.uint64(value * 0x0101010101010101)


TOP, LOW, ONES = every_byte(0x80), every_byte(0x7F), 0x0101010101010101
# Added to a byte below 0x80, these reach its top bit from "a" on and from the byte after "z" on.
FROM_A, PAST_Z, SMALL = every_byte(0x80 - 0x61), every_byte(0x80 - 0x7B), every_byte(0x20)


class Units:
    """The unit borders of one text, as top bits in its words."""

    def __init__(self, data: bytes) -> None:
        n = len(data)
        self.n_bytes = n
        words = np.frombuffer(data + bytes(-n % 8), "<u8")
        small = (words | SMALL) & LOW
        letter = ((small + FROM_A) & ~(small + PAST_Z) & ~words) & TOP
        trail = words & ~(words << np.uint64(1)) & TOP  # 10xxxxxx
        # A unit goes on into a trail byte, and from a letter into a letter.
        ends = ~(following(trail) | (letter & following(letter))) & TOP
        heads = ~trail & TOP
        if n % 8:
            inside = np.uint64((1 << 8 * (n % 8)) - 1)
            ends[-1] &= inside
            heads[-1] &= inside
        self.ends, self.heads = ends, heads
        self.units_to = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
        self.count = int(self.units_to[-1]) if n else 0

    def cut(self, units: int) -> int:
        """The bytes that the first ``units`` units take."""
        if not units:
            return 0
        word = int(np.searchsorted(self.units_to, units))
        before = int(self.units_to[word - 1]) if word else 0
        return 8 * word + select(int(self.ends[word]), units - before) + 1

    def chars(self, n_bytes: int) -> int:
        """Code points in the first ``n_bytes`` bytes."""
        word, rest = divmod(n_bytes, 8)
        found = int(np.bitwise_count(self.heads[:word]).sum(dtype=np.int64))
        return found + (int(self.heads[word]) & (1 << 8 * rest) - 1).bit_count() if rest else found


def following(marks: np.ndarray) -> np.ndarray:
    """For every byte, the mark of the byte after it; nothing is marked behind the last word."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def select(word: int, k: int) -> int:
    """The byte of the k-th (from 1) top bit that is set in a word: running counts by one multiplication."""
    counts = (word >> 7) * ONES & (1 << 64) - 1
    reached = ((counts | int(TOP)) - k * ONES) & int(TOP)  # a byte's top bit stays where its count is k or more
    return 8 - reached.bit_count()


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2**32 from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4]) for i in range(0, 16, 4)]


def arrange(doc_id: int | None, data: bytes, seed: str, plain_percent: int, suffix_first_percent: int) -> tuple:
    """The values of ``OUTPUTS`` for one text."""
    units = Units(data)
    n = units.count
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= 100 - plain_percent or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.cut(first), units.cut(last)
    before = units.chars(a)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < suffix_first_percent:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, before, units.chars(b) - before, b"".join(parts)


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1", plain_percent: int = PLAIN_PERCENT,
                   suffix_first_percent: int = SUFFIX_FIRST_PERCENT, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``OUTPUTS``; ``infill`` is the rearranged text. Columns of these names are replaced."""

    def make():
        def work(ids, texts):
            rows = [arrange(i, x or b"", seed, plain_percent, suffix_first_percent)
                    for i, x in zip(ids.to_pylist(), as_bytes(texts))]
            *columns, made = zip(*rows)
            return [*map(list, columns), [x.decode("utf-8", "surrogatepass") for x in made]]

        return work

    return add_columns(df, [doc_id, text], OUTPUTS, make, drop)


def restored(infill: Column, form: Column) -> Column:
    """The text that an output stands for. Rearranged texts hold each mark once."""
    part = lambda i: F.get(F.split(infill, "<[PSM]>", -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(
        form == "spm", F.concat(part(2), part(3), part(1))).otherwise(infill)
