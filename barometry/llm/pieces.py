"""SentencePiece encoding and decoding by a table of distinct chunks.

The model is a byte-pair one whose pieces never go on behind a whitespace marker: a marked word, which is a run of
markers and all up to the next one, is segmented on its own. So each distinct marked word of a stretch of
text is segmented once, into a table, and the ids of the texts are the table's entries joined back by position. The
table is kept over the texts of a task and begun anew when it holds ``TABLE_CHUNKS`` words or ``TABLE_CHARS`` characters, which
changes no result.

Encoding merges the pair of neighbouring pieces with the highest score, the leftmost of equals, as long as a pair makes
a piece; characters without a piece become the ids of their bytes. No string of a text is taken for a control piece.

Null and empty texts have no ids but the end id. Nothing is cut: a text is split for processing only at the start of a
marked word. One marked word is merged in one go, with work of n log n in its length.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.llm.bpe import Numbers, spread
from barometry.llm.common import add_columns

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters whose marked words are looked up at once.
BLOCK_CHARS = 1 << 19
#: Marked words and characters that the table of a task holds at most, beyond those of one block.
TABLE_CHUNKS = 200_000
TABLE_CHARS = 4 << 20
#: Marked words of up to these lengths are merged together, a longer one by a heap of its own.
WIDTHS = (6, 12, 24)
#: The rank of a pair that makes no piece.
NO_PAIR = np.iinfo(np.int32).max
#: What an unknown id decodes to.
UNKNOWN = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """What is needed of a model; its size is fixed by the model."""

    ids: dict[str, int]        # pieces that merges can make
    scores: dict[str, float]
    byte_ids: list[int]        # ids of the 256 bytes
    bytes: frozenset[int]
    control: frozenset[int]
    tokens: list[bytes]        # bytes of each id, markers as spaces
    end: int


def read_model(path: str) -> Vocabulary:
    """The vocabulary of a byte-pair model with byte fallback whose normaliser only marks spaces; else an error."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, tokens, control, byte_ids = {}, {}, [], set(), [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(piece[3:5], 16)]))
            byte_ids[tokens[-1][0]] = i
        elif model.is_control(i):
            control.add(i)
            tokens.append(b"")
        elif model.is_unknown(i):
            tokens.append(UNKNOWN.encode())
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            tokens.append(piece.replace(MARK, " ").encode())
    probe = "  ﬁ a\t "
    if model.normalize(probe) != MARK + probe.replace(" ", MARK) or -1 in byte_ids or any(model.is_unused(i) for i in ids.values()):
        raise ValueError("this model's normaliser, byte pieces or unused pieces are not supported")
    if any(MARK in piece.lstrip(MARK) for piece in ids):
        raise ValueError("this model's pieces cross whitespace markers")
    return Vocabulary(ids, scores, byte_ids, frozenset(byte_ids), frozenset(control), tokens, model.eos_id())


class Pairs:
    """Pairs of symbols that make a piece, with the rank of its score and its id.

    A symbol is a piece, by its id, or a character of a piece that is none itself, by a number behind the ids; a
    character that no piece holds is -2.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        number = dict(vocabulary.ids)
        for piece in vocabulary.ids:
            for c in piece:
                number.setdefault(c, len(vocabulary.tokens) + len(number))
        place = {s: i for i, s in enumerate(sorted(set(vocabulary.scores.values()), reverse=True))}
        keys, ranks, made = [], [], []
        for piece, score in vocabulary.scores.items():
            for i in range(1, len(piece)):
                left, right = number.get(piece[:i]), number.get(piece[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(place[score])
                    made.append(number[piece])
        order = np.argsort(keys)
        # A key behind all others ends every search.
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self._ranks = np.append(np.array(ranks, np.int32)[order], np.int32(NO_PAIR))
        self._made = np.append(np.array(made, np.int32)[order], np.int32(-1))
        self._symbols = np.full(0x110000, -2, np.int32)
        for piece, i in number.items():
            if len(piece) == 1:
                self._symbols[ord(piece)] = i

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return self._symbols[points]

    def at(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return at, self.keys[at] == key

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self.at(left, right)
        return np.where(there, self._ranks[at], np.int32(NO_PAIR))

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._made[self.at(left, right)[0]]


class Segmenter:
    """Ids of texts, through one table of distinct marked words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.pairs = vocabulary, Pairs(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.chars = Numbers(), 0
        self.flat, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def merged_rows(self, ids: np.ndarray) -> np.ndarray:
        """Symbols of many marked words, one in each row and padded with -1, after all merges of each.

        In every round each row merges its best pair: the one of lowest rank, the leftmost of equals.
        """
        pairs = self.pairs
        ranks, rows = pairs.ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(ids))
        columns = np.arange(ids.shape[1])
        while True:
            best = ranks.argmin(1)
            good = ranks[np.arange(len(rows)), best] < NO_PAIR
            if not good.all():
                rows, ranks, best = rows[good], ranks[good], best[good]
            if not len(rows):
                return ids
            own, at = ids[rows], np.arange(len(rows))
            made = pairs.made(own[at, best], own[at, best + 1])
            # What stands behind the pair moves up by one.
            take = np.minimum(columns + (columns > best[:, None]), len(columns) - 1)
            own = np.take_along_axis(own, take, 1)
            own[:, -1] = -1
            own[at, best] = made
            ids[rows] = own
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], len(columns) - 2), 1)
            ranks[:, -1] = NO_PAIR
            inside = best < len(columns) - 1
            ranks[at[inside], best[inside]] = pairs.ranks(own[at, best][inside], own[at, np.minimum(best + 1, len(columns) - 1)][inside])
            left = best > 0
            ranks[at[left], best[left] - 1] = pairs.ranks(own[at, best - 1][left], own[at, best][left])

    def segmented(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of marked words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        counts = np.zeros(len(chunks), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        alone = sizes > WIDTHS[-1]
        for least, width in zip((0, *WIDTHS), WIDTHS):
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            if not len(some):
                continue
            points = np.frombuffer("".join(chunks[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32)
            ids = np.full((len(some), width + 1), -1, np.int32)
            ids[np.arange(width + 1) < sizes[some][:, None]] = self.pairs.symbols(points)
            # A character that is no piece becomes bytes: those few words are segmented one by one.
            odd = ((ids < -1) | (ids >= len(self.vocabulary.tokens))).any(1)
            alone[some[odd]] = True
            done = self.merged_rows(ids[~odd])
            counts[some[~odd]] = (done >= 0).sum(1)
            found.append((some[~odd], done[done >= 0]))
        others = np.flatnonzero(alone)
        slow = [self.segment(chunks[i]) for i in others.tolist()]
        counts[others] = list(map(len, slow))
        found.append((others, np.fromiter((i for ids in slow for i in ids), np.int32)))
        flat = np.empty(int(counts.sum()), np.int32)
        start = np.cumsum(counts) - counts
        for some, ids in found:
            flat[spread(start[some], counts[some])] = ids
        return flat, counts

    def merged(self, chunk: str) -> list[str]:
        """The pieces of one marked word of any length."""
        score = self.vocabulary.scores.get
        parts: list[str | None] = list(chunk)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # (-score, left, length of the pair): the length tells whether a neighbour has been merged meanwhile.
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score(chunk[i:i + 2])) is not None]
        heapify(heap)

        def push(i: int, j: int) -> None:
            if (s := score(parts[i] + parts[j])) is not None:
                heappush(heap, (-s, i, len(parts[i]) + len(parts[j])))

        while heap:
            _, i, length = heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != length:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return [p for p in parts if p is not None]

    def segment(self, chunk: str) -> list[int]:
        known, byte_ids = self.vocabulary.ids.get, self.vocabulary.byte_ids
        out = []
        for piece in self.merged(chunk):
            if (i := known(piece)) is not None:
                out.append(i)
            else:
                out += [byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def joined(self, block: list[str]) -> list[np.ndarray]:
        """The ids of parts of texts: new marked words go into the table, and all are joined from it."""
        if len(self.numbers) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.clear()
        known = len(self.counts)
        codes = []
        for part in block:
            chunks = CHUNK.findall(part)
            codes.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks)))
        if len(self.numbers) > known:
            new = list(self.numbers)[known:]
            flat, counts = self.segmented(new)
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
            self.chars += sum(map(len, new))
        start = np.cumsum(self.counts) - self.counts
        return [self.flat[spread(start[c], self.counts[c])] for c in codes]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of every text, the end id behind them."""
        end = np.array([self.vocabulary.end], np.int32)
        block: list[tuple[int, str]] = []
        size, n_texts = 0, 0
        held: dict[int, list[np.ndarray]] = {}

        def flush() -> None:
            nonlocal size
            for (i, _), ids in zip(block, self.joined([part for _, part in block])):
                held.setdefault(i, []).append(ids)
            block.clear()
            size = 0

        for text in texts:
            for part in parts_of(text or ""):
                block.append((n_texts, part))
                size += len(part)
                if size >= BLOCK_CHARS:
                    flush()
            n_texts += 1
        flush()
        for i in range(n_texts):
            yield np.concatenate([*held.pop(i, ()), end])


def parts_of(text: str, limit: int = 0) -> Iterator[str]:
    """The marked text in parts of about ``limit`` characters (default ``BLOCK_CHARS``), each beginning with a marked word."""
    if not text:
        return
    limit = limit or BLOCK_CHARS
    marked = MARK + text.replace(" ", MARK)
    begin = 0
    while len(marked) - begin > limit:
        cut = marked.find(MARK, begin + limit)
        while cut > 0 and marked[cut - 1] == MARK:
            cut = marked.find(MARK, cut + 1)
        if cut < 0:
            break
        yield marked[begin:cut]
        begin = cut
    yield marked[begin:]


def decoded(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids: the first piece loses one leading space, bytes that are no UTF-8 become U+FFFD each."""
    tokens, is_byte = vocabulary.tokens, vocabulary.bytes
    data = b"".join(map(tokens.__getitem__, ids))
    first = next((i for i in ids if i not in vocabulary.control), None)
    # Only a piece that stands for text loses its leading marker.
    strip = first is not None and first not in is_byte and tokens[first] != UNKNOWN.encode() and data[:1] == b" "
    try:
        # A control piece parts the bytes before it from those behind.
        out = data.decode() if vocabulary.control.isdisjoint(ids[:-1]) else None
    except UnicodeDecodeError:
        out = None
    if out is None:
        out = "".join(map(repaired, byte_runs(tokens, is_byte, ids)))
    return out[1:] if strip else out


def byte_runs(tokens: list[bytes], is_byte: frozenset[int], ids: list[int]) -> Iterator[bytes]:
    """Runs of byte pieces as one, other pieces alone."""
    run = b""
    for i in ids:
        if i in is_byte:
            run += tokens[i]
            continue
        if run:
            yield run
            run = b""
        yield tokens[i]
    if run:
        yield run


def repaired(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        lead = data[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(data[at:at + width].decode())
            at += width
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_SEGMENTERS: dict[int, Segmenter] = {}


def _segmenter(shared) -> Segmenter:
    """One table per Python worker and vocabulary: later tasks use it again."""
    vocabulary = shared.value
    if id(vocabulary) not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[id(vocabulary)] = Segmenter(vocabulary)
    return _SEGMENTERS[id(vocabulary)]


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens",
           drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ids of ``text`` (an array, the end id last) and their number; columns of these names are replaced.

    The model is read on the driver and its vocabulary broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        segmenter = _segmenter(shared)

        def work(texts):
            made = list(segmenter.encode(texts.to_pylist()))
            counts = np.fromiter(map(len, made), np.int64, len(made))
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made))), pa.array(counts)]

        return work

    return add_columns(df, [text], {ids: "array<int>", count: "bigint"}, make, drop)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the text that ``ids`` stand for; null ids give an empty one. An id out of range is an error."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        vocabulary = shared.value

        def work(column):
            return [[decoded(vocabulary, x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in column]]

        return work

    return add_columns(df, [ids], {text: "string"}, make, drop)


def id_text(ids: Column) -> Column:
    """Ids in decimal, one space between."""
    return F.array_join(ids.cast("array<string>"), " ")
