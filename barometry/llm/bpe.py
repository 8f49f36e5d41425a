"""Byte-level byte-pair encoding by a rank file, and decoding.

A text is cut into pre-tokens by the pattern of the rank files, each pre-token is encoded on its own, and no
string is treated as a special token. Ids equal those of the usual library for such files.

Merges run on a doubly linked list of parts. Every mergeable pair stands in the bucket of its rank; two levels
of bitmaps name the buckets that hold something, so the lowest rank is found by two find-first-set steps
whatever the length. An entry that a merge nearby has made untrue is skipped when its bucket is read. The
distinct pre-tokens of some megabytes of text share one list and one queue, so that a bucket is merged by
array operations; a very long pre-token has its own, with time linear in its length but for the heaps.

Null and empty texts have no ids. Nothing is cut: a text is split for processing only before a white-space
character that follows another character, where no pre-token can cross.
"""

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.llm.common import add_columns, as_bytes

#: Characters that are cut into pre-tokens at once.
BLOCK_CHARS = 1 << 19
#: Bytes of text whose pre-tokens share one rank queue.
GATHER_BYTES = 4 << 20
#: The same where ids are decoded in the pass too, and ids that are decoded at once.
ROUND_TRIP_BYTES = 2 << 20
DECODE_IDS = 1 << 16
#: A longer pre-token has a queue of its own.
LONG_BYTES = 256

_LETTER, _NUMBER, _SPACE, _OTHER, _BREAK = range(5)
# The contractions of the public split pattern, and Unicode's white space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
               0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def character_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = _SPACE
    return table


class RankQueue:
    """Buckets by rank, with two levels of bitmaps over the ranks whose bucket holds something."""

    def __init__(self) -> None:
        self.summary = 0                  # bit g: some rank in [g * 256, (g + 1) * 256) has a bucket
        self.words: dict[int, int] = {}   # bit r % 256 of word r // 256: rank r has a bucket
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        held = self.buckets.get(rank)
        if held is None:
            held = self.buckets[rank] = []
            group = rank >> 8
            self.words[group] = self.words.get(group, 0) | 1 << (rank & 255)
            self.summary |= 1 << group
        return held

    def add(self, rank: int, positions) -> None:
        self.bucket(rank).append(positions)

    def push(self, rank: int, position: int) -> None:
        heappush(self.bucket(rank), position)

    def first(self) -> int | None:
        """The lowest rank with a bucket, by find-first-set on both levels."""
        if not self.summary:
            return None
        group = (self.summary & -self.summary).bit_length() - 1
        word = self.words[group]
        return group << 8 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list:
        """All that the bucket holds; it is empty afterwards."""
        group = rank >> 8
        self.words[group] ^= 1 << (rank & 255)
        if not self.words[group]:
            self.summary ^= 1 << group
        return self.buckets.pop(rank)

    def pop(self, rank: int) -> int:
        """The leftmost position in the bucket."""
        held = self.buckets[rank]
        position = heappop(held)
        if not held:
            self.take(rank)
        return position


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left id * 2**32 + right id) of all pairs of tokens that make a token, and its rank."""
    keys, made = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                made.append(rank)
    order = np.argsort(keys)
    return np.array(keys, np.int64)[order], np.array(made, np.int32)[order]


class Encoder:
    """Packed little-endian ids of texts."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray | None = None) -> None:
        self.ranks = ranks
        self.classes = character_classes() if classes is None else classes
        self.single = [bytes([b]) for b in range(256)]
        self.byte_ids = np.array([ranks[b] for b in self.single], np.int32)
        self.none = max(ranks.values()) + 1  # stands for "no such pair" and lies behind every rank
        self.keys, self.made = pair_table(ranks)

    def tokens(self) -> list[bytes]:
        """The bytes of every id; an unused id has none."""
        out = [b""] * self.none
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    def long_merge(self, token: bytes) -> list[int]:
        """The ids of one long pre-token: a queue of its own, with a heap of positions in each bucket."""
        get, single = self.ranks.get, self.single
        parts: list[bytes | None] = [single[b] for b in token]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at: list[int | None] = [None] * n
        queue = RankQueue()
        for i in range(n - 1):
            if (rank := get(token[i:i + 2])) is not None:
                rank_at[i] = rank
                queue.push(rank, i)
        while (rank := queue.first()) is not None:
            i = queue.pop(rank)
            if rank_at[i] != rank:
                continue  # stale: a neighbour was merged meanwhile
            j = after[i]
            merged = parts[i] + parts[j]
            parts[i], parts[j], rank_at[j], rank_at[i] = merged, None, None, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := get(merged + parts[k])) is not None:
                    rank_at[i] = new
                    queue.push(new, i)
            if (h := before[i]) >= 0:
                rank_at[h] = new = get(parts[h] + merged)
                if new is not None:
                    queue.push(new, h)
        return [self.ranks[p] for p in parts if p is not None]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or ``none``."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], np.int32(self.none))

    def merge_all(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens, one after another, and how many each has.

        All stand in one linked list, with a barrier after each, and share one queue: a bucket holds positions
        of many pre-tokens, which are merged at once. Of one pre-token only the leftmost position is taken
        at a time, since its merge may make a pair of lower rank.
        """
        none = self.none
        raw = np.frombuffer(b"\0".join(tokens) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int32, len(tokens)) + 1
        owner = np.repeat(np.arange(len(tokens), dtype=np.int32), sizes)
        barriers = np.cumsum(sizes) - 1
        ids = self.byte_ids[raw]
        ids[barriers] = none
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank_at = np.full(n, none, np.int32)
        rank_at[:-1] = self.lookup(ids[:-1], ids[1:])
        queue = RankQueue()

        def push(positions: np.ndarray) -> None:
            ranks = rank_at[positions]
            positions, ranks = positions[ranks != none], ranks[ranks != none]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for a, b, rank in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
                queue.add(rank, positions[a:b])

        push(np.arange(n, dtype=np.int32))
        while (rank := queue.first()) is not None:
            held = queue.take(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[rank_at[at] == rank]  # the others are stale: a neighbour was merged meanwhile
            if len(at) > 1:
                at = np.sort(at)
                of = owner[at]
                again = np.zeros(len(at), bool)
                np.equal(of[1:], of[:-1], out=again[1:])
                if again.any():
                    queue.add(rank, at[again])
                    at = at[~again]
            elif not len(at):
                continue
            gone = after[at]
            rest = after[gone]
            left = before[at]
            ids[at] = rank
            ids[gone] = -1
            after[at] = rest
            before[rest] = at
            rank_at[gone] = none
            old = ids[left]
            if left[0] < 0:
                old[0] = none
            new = self.lookup(np.concatenate([ids[at], old]), np.concatenate([ids[rest], ids[at]]))
            rank_at[at] = new[:len(at)]
            inside = left >= 0
            rank_at[left[inside]] = new[len(at):][inside]
            push(np.concatenate([at, left[inside]]))
        kept = (ids >= 0) & (ids != none)
        return ids[kept], np.bincount(owner[kept], minlength=len(tokens))

    def token_ids(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has."""
        whole = list(map(self.ranks.get, tokens))
        counts = np.ones(len(tokens), np.int64)
        short, longer = [], []
        for i, rank in enumerate(whole):
            if rank is None:
                (short if len(tokens[i]) <= LONG_BYTES else longer).append(i)
        flat = np.fromiter((-1 if x is None else x for x in whole), np.int64, len(whole))
        merged = [self.long_merge(tokens[i]) for i in longer]
        counts[longer] = list(map(len, merged))
        some, of = self.merge_all([tokens[i] for i in short]) if short else (np.empty(0, np.int64), 0)
        counts[short] = of
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        single = flat >= 0
        out[start[single]] = flat[single]
        out[spread(start[short], counts[short])] = some
        for i, ids in zip(longer, merged):
            out[start[i]:start[i] + len(ids)] = ids
        return out, counts

    def pre_tokens(self, texts: list[str]) -> Iterator[list[bytes]]:
        """The pre-tokens of each text, found for all texts in one vectorised pass."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[points]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind[ends] = _BREAK
        start = np.empty(len(kind), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        # The last white-space character before other text leaves its run; a plain space joins what follows.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _BREAK))
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        for i in np.flatnonzero((points == 0x27) & start).tolist():
            for rest in CONTRACTIONS:
                if joined.startswith(rest, i + 1):
                    start[i + 1] = False
                    if i + 1 + len(rest) < len(start):
                        start[i + 1 + len(rest)] = True
                    break
        start[ends] = True
        start[ends[:-1] + 1] = True
        data = joined.encode("utf-8", "surrogatepass")
        at = np.flatnonzero(start)
        if len(data) != len(points):
            width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.uint8) + (points >= 0x10000)
            places = (np.cumsum(width) - width)[at].tolist()
        else:
            places = at.tolist()
        first = 0
        for last in np.searchsorted(at, ends).tolist():
            yield [data[a:b] for a, b in zip(places[first:last], places[first + 1:last + 1])]
            first = last + 1

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Packed ids of each text. The distinct pre-tokens of all texts are encoded once, together."""
        numbers = Numbers()
        codes: list[np.ndarray] = []
        owners: list[int] = []
        block: list[tuple[int, str]] = []
        size = n_texts = 0

        def flush() -> None:
            if block:
                for (i, _), tokens in zip(block, self.pre_tokens([p for _, p in block])):
                    codes.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                    owners.append(i)

        for i, text in enumerate(texts):
            n_texts += 1
            for piece in pieces(text or ""):
                if size + len(piece) > BLOCK_CHARS:
                    flush()
                    block, size = [], 0
                block.append((i, piece))
                size += len(piece)
        flush()
        out = [b""] * n_texts
        if codes:
            flat, counts = self.token_ids(list(numbers))
            flat = flat.astype("<u4")
            start = np.cumsum(counts) - counts
            for i, code in zip(owners, codes):
                out[i] += flat[spread(start[code], counts[code])].tobytes()
        return out


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of ``counts`` entries, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(start - (ends - counts), counts)


def pieces(text: str, limit: int = BLOCK_CHARS) -> Iterator[str]:
    """Parts of a text of about ``limit`` characters, cut only before a space that follows other text."""
    begin = 0
    while len(text) - begin > limit:
        cut = begin + limit
        while (cut := text.find(" ", cut)) > 0 and text[cut - 1].isspace():
            cut += 1
        if cut <= 0:
            break
        yield text[begin:cut]
        begin = cut
    if begin < len(text):
        yield text[begin:]


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``df`` with the ids of ``text``: ``ids`` (binary, little-endian unsigned 32-bit numbers) and their ``count``.

    The rank file is read on the driver and broadcast; its size is fixed (one line per token).
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        encoder = _encoder(shared)

        def work(texts):
            packed = encoder.encode(texts.to_pylist())
            return [packed, [len(p) // 4 for p in packed]]

        return work

    return add_columns(df, [text], {ids: "binary", count: "bigint"}, make, gather=GATHER_BYTES)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per Python worker and vocabulary: later tasks use its tables again."""
    ranks = shared.value
    if id(ranks) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(ranks)] = Encoder(ranks)
    return _ENCODERS[id(ranks)]


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that packed ``ids`` stand for; null ids give no bytes. An id out of range is an error."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        token = {rank: t for t, rank in shared.value.items()}.__getitem__

        def work(column):
            return [[b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in as_bytes(column)]]

        return work

    return add_columns(df, [ids], {decoded: "binary"}, make)


def round_trip(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens",
               same: str = "round_trip", drop: tuple[str, ...] = ()) -> DataFrame:
    """``encode`` with ``same`` besides: whether the ids decode to the bytes of ``text`` (a null one has none).

    Encoded, decoded and compared in one Arrow pass: a task needs one Python worker with one vocabulary, and
    neither the text nor the decoded bytes go back to the JVM if ``drop`` names the text.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        encoder = _encoder(shared)
        token = encoder.tokens().__getitem__

        def work(texts):
            packed, equal = [], []
            # A few texts at a time: their ids and bytes are all that is held besides the batch.
            for data, text in zip(encoder.encode(texts.to_pylist()), texts):
                packed.append(data)
                n = 0
                whole = memoryview(text.as_buffer() or b"").cast("B")
                good = True
                for at in range(0, len(data), 4 * DECODE_IDS):
                    part = b"".join(map(token, np.frombuffer(data[at:at + 4 * DECODE_IDS], "<u4").tolist()))
                    good = good and whole[n:n + len(part)] == part
                    n += len(part)
                equal.append(good and n == len(whole))
            return [packed, [len(p) // 4 for p in packed], equal]

        return work

    return add_columns(df, [text], {ids: "binary", count: "bigint", same: "boolean"}, make, drop, gather=ROUND_TRIP_BYTES)


def id_array(ids: Column) -> Column:
    """Packed ids as an array of numbers."""
    def number(h):
        return F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")

    # Eight digits a time, in one pass over the whole.
    return F.transform(F.regexp_extract_all(F.hex(F.coalesce(ids, F.lit(b""))), F.lit("(.{8})"), F.lit(1)), number)
