"""N-gram Jaccard join: documents whose sets of word shingles overlap by ``percent`` per cent or more.

Exact, without a pair of equal sets ever being formed: documents with equal sets are one class, and only one
of each class is compared. The steps are

1. Tokens into groups. The hash range of shingles is cut into groups. Two sets that link differ in at most
   ``d`` shingles, where d follows from their size, so of d + 1 + s groups more than s have the same content in
   both: every class is filed under the content of its groups, and may forgo the s files that hold the most
   classes, which are those of wide-spread passages. Sizes are banded; a class near the upper end of its band is filed in
   the next band too.
2. Files that two or more classes keep tie them into candidate components (exact, no pair within a file is listed).
3. In a component too large for one block, the class that shares most is the pivot, and all others are
   compared with it. Classes linked to the pivot need no comparison with each other any more.
4. Components are joined in blocks of bounded size: an R-tree over count vectors (shingles per cell of the hash
   range) prunes by the sum of coordinate minima, which bounds the overlap from above; the pairs that survive
   are verified on the sets. Pairs already connected are skipped, so a block gives a spanning forest at most.
5. Links give the components.

Work in step 4 is quadratic only within blocks, and in the number of classes of a large candidate component
that are not linked to its pivot. A document without words has an empty set and links with nothing. Rows that share an id are one
document: they have one component. Rows with a null id have no component and link with nothing. Hashes of
shingles have 64 bits, of sets 128.
"""

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barometry.llm.common import add_columns, arrow_batches, as_bytes
from barometry.llm.graph import connected_components
from barometry.session import written

#: Words of a shingle and least similarity in per cent, unless a caller names others.
SHINGLE = 5
PERCENT = 80
#: Bands of set sizes grow by a half: sets of two neighbouring bands at most may link.
LEAST_PERCENT = 70
#: Cells of a count vector, points of a leaf and children of a node of the R-tree.
CELLS = 64
LEAF = 16
#: Classes and shingles of a block in step 4.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 400_000
#: Hashed words that a task remembers.
CACHE_WORDS = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; A-Z count as a-z."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h)
    odd = odd_numbers(width + 1)
    if n >= width:
        return np.unique(mix(sum(h[k:n - width + 1 + k] * odd[k] for k in range(width))))
    # The number of words goes in, so that a short text never equals a shingle.
    return mix(np.array([sum(int(x) * int(odd[k]) for k, x in enumerate(h)) + n * int(odd[width]) & (1 << 64) - 1],
                        np.uint64)) if n else h


@functools.cache
def odd_numbers(n: int) -> np.ndarray:
    """``n`` odd factors: the first four fixed, further ones by mixing."""
    more = mix(np.arange(len(_ODD), max(n, len(_ODD)), dtype=np.uint64)) | np.uint64(1)
    return np.concatenate([_ODD, more])[:n]


def size_bands() -> np.ndarray:
    """Lower ends of the bands of set sizes, each half as large again as the one before."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return np.array(ends)


BANDS = size_bands()


def group_files(s: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, int]]:
    """The files of a set in each of its bands, and how many of them, the lightest, it is to keep there.

    Sets that link differ in fewer than ``need`` shingles, so of need + spare groups more than ``spare`` have the same
    content. In one order of all files, each set may therefore forgo its ``spare`` heaviest: the lightest that
    both share has at least ``spare`` heavier ones in either. Empty groups count as heaviest of all.
    """
    n = len(s)
    band = int(np.searchsorted(BANDS, n, "right")) - 1
    bands = [band, band + 1] if 100 * n >= percent * int(BANDS[band + 1]) else [band]
    spread = mix(s + _ODD[1])
    files = []
    for b in bands:
        largest = int(BANDS[b + 1]) - 1
        # Sets A and B with J >= t differ in at most (|A| + |B|) (1 - t) / (1 + t) shingles.
        need = 2 * largest * (100 - percent) // (100 + percent) + 1
        if need == 1:
            continue  # only equal sets link here, and those are one class already
        spare = 1 + need // 3
        groups = need + spare
        starts = cell_starts(s, groups)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
        ends = np.append(starts[1:], n)
        key = np.arange(groups, dtype=np.uint64) * _ODD[2] + np.array([b], np.uint64) * _ODD[3]
        # The lowest bit tells an odd band from an even one: the same in both sets, whichever band is their own.
        keys = mix(mix(total[ends] - total[starts]) + key) & ~np.uint64(1) | np.uint64(b & 1)
        filled = ends > starts
        own, empty = keys[filled], np.sort(keys[~filled])
        # Of more empty groups than it may forgo, a set files those of the smallest keys and keeps all it files.
        files.append((np.concatenate([own, empty[:max(0, len(empty) - spare)]]), need))
    return files


def cell_starts(s: np.ndarray, cells: int) -> np.ndarray:
    """Where each of so many equal parts of the hash range begins in a sorted set."""
    step = (1 << 64) // cells + 1
    return np.searchsorted(s, np.arange(cells, dtype=np.uint64) * np.uint64(step) if cells > 1 else np.zeros(1, np.uint64))


def counts(s: np.ndarray) -> np.ndarray:
    """The count vector of a set."""
    starts = cell_starts(s, CELLS)
    return np.diff(np.append(starts, len(s))).astype("<i4")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return tuple(int(signed(mix(s + odd).sum(keepdims=True))[0]) for odd in (_ODD[0], _ODD[2]))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_link(overlap, sizes, percent: int = PERCENT) -> np.ndarray:
    """Whether an overlap of at most ``overlap`` can be enough for sets of together ``sizes`` shingles."""
    return (100 + percent) * overlap >= percent * sizes


class RTree:
    """Count vectors in nested boxes; of a box only its upper corner and smallest set matter for the bound."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.vectors, self.sizes = vectors, sizes
        self.root = self.build(np.arange(len(sizes)))

    def build(self, points: np.ndarray) -> tuple:
        inside = self.vectors[points]
        top, least = inside.max(0), int(self.sizes[points].min())
        if len(points) <= LEAF:
            return top, least, points, ()
        # Cut at the median of the coordinate, or the size, that varies most.
        columns = np.column_stack([inside, self.sizes[points]])
        widest = int(np.argmax(columns.var(0)))
        order = points[np.argsort(columns[:, widest], kind="stable")]
        half = len(order) // 2
        return top, least, None, (self.build(order[:half]), self.build(order[half:]))

    def candidates(self, vectors: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        """Pairs (query, point) whose bound is high enough, a leaf at a time."""
        stack = [(self.root, np.arange(len(sizes)))]
        while stack:
            (top, least, points, children), active = stack.pop()
            bound = np.minimum(vectors[active], top).sum(1)
            active = active[may_link(bound, sizes[active] + least, percent)]
            if not len(active):
                continue
            if points is None:
                stack += [(child, active) for child in children]
                continue
            overlap = np.minimum(vectors[active][:, None, :], self.vectors[points][None, :, :]).sum(2)
            q, p = np.nonzero(may_link(overlap, sizes[active][:, None] + self.sizes[points][None, :], percent))
            yield active[q], points[p]


def join_block(left: list, right: list | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a forest of them) between two lists of (id, tied to the pivot, set), or within one."""
    rows = left + (right or [])
    root = np.arange(len(rows))
    tied = np.array([r[1] for r in rows], bool)
    if tied.any():
        root[tied] = np.flatnonzero(tied)[0]
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    vectors = np.stack([counts(s) for s in sets])
    n = len(left)
    tree = RTree(vectors[:n], sizes[:n])
    first = 0 if right is None else n
    links = []
    for queries, points in tree.candidates(vectors[first:], sizes[first:], percent):
        for q, p in zip((queries + first).tolist(), points.tolist()):
            if (right is not None or q > p) and root[q] != root[p] and linked(sets[q], sets[p], percent):
                links.append((rows[q][0], rows[p][0]))
                root[root == root[q]] = root[p]
    return links


def describe(df: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """id, set size, hash of the set and files of every row; how many of even and of odd bands it may forgo."""

    def make():
        hashes = WordHashes()

        def work(texts):
            sizes, h1, h2, files, spare = [], [], [], [], ([], [])
            for x in as_bytes(texts):
                s = shingle_set(x or b"", hashes, width)
                sizes.append(len(s))
                for h, column in zip(set_hash(s), (h1, h2)):
                    column.append(h)
                found = group_files(s, percent) if len(s) else []
                files.append(signed(np.concatenate([f for f, _ in found])) if found else np.empty(0, np.int64))
                # Of two neighbouring bands one is even, the other odd.
                may_forgo = {int(f[0]) & 1: len(f) - keep for f, keep in found}
                for odd, column in enumerate(spare):
                    column.append(may_forgo.get(odd, 0))
            offsets = np.concatenate([[0], np.cumsum(list(map(len, files)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(files)))
            return [sizes, h1, h2, lists, *spare]

        return work

    return add_columns(df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("_text")), ["_text"],
                       {"n": "bigint", "h1": "bigint", "h2": "bigint", "files": "array<bigint>", "spare_even": "int", "spare_odd": "int"},
                       make, ("_text",))


def points_of(df: DataFrame, width: int) -> DataFrame:
    """The sets of the texts of classes; a row whose set is another class's is left out."""

    def make():
        hashes = WordHashes()

        def work(texts, h1, h2):
            sets = []
            for x, a, b in zip(as_bytes(texts), h1.to_pylist(), h2.to_pylist()):
                s = shingle_set(x or b"", hashes, width)
                sets.append(s.tobytes() if set_hash(s) == (a, b) else None)
            return [sets]

        return work

    return add_columns(df, ["_text", "h1", "h2"], {"set": "binary"}, make, ("_text", "h1", "h2")).where("set is not null")


def discard(table: DataFrame) -> None:
    """Remove a written table that no later step reads."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def small_links(points: DataFrame, percent: int) -> DataFrame:
    """Links of components that fit into one block each."""

    def join(table: pa.Table) -> pa.Table:
        rows = zip(table.column("rep").to_pylist(), table.column("set").to_pylist())
        return link_table(join_block([(r, False, s) for r, s in rows], percent=percent))

    return points.select("comp", "rep", "set").groupBy("comp").applyInArrow(join, "u bigint, v bigint")


def against_pivot(df: DataFrame, percent: int) -> DataFrame:
    """``df`` with ``tied``: whether a class links with the pivot of its component."""

    def make():
        def work(own, pivot):
            out = []
            for a, b in zip(own.to_pylist(), pivot.to_pylist()):
                s, t = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                bound = np.minimum(counts(s), counts(t)).sum()
                out.append(bool(may_link(bound, len(s) + len(t), percent)) and linked(s, t, percent))
            return [out]

        return work

    return add_columns(df, ["set", "p_set"], {"tied": "boolean"}, make, ("p_set",))


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between classes of large components in blocks (step 4); ``rows`` are those of ``against_pivot``."""
    sums = rows.groupBy("comp").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.when(F.col("tied"), 0).otherwise(1)).alias("loose"), F.sum("n").alias("total"))
    parts = lambda m: F.ceil(F.greatest(
        m / BLOCK_CLASSES, F.col("total") * m / F.col("m") / BLOCK_SHINGLES)).cast("int")
    open_ones = sums.where("loose > 0").select(
        "comp", parts(F.col("loose")).alias("k_loose"), parts(F.col("m") - F.col("loose")).alias("k_tied"))
    placed = rows.select("comp", "rep", "tied", "set").join(written(open_ones, "components"), "comp")
    chance = F.xxhash64("rep", F.lit(3))
    own = F.when(F.col("tied"), F.pmod(chance, F.col("k_tied"))).otherwise(F.col("k_tied") + F.pmod(chance, F.col("k_loose"))).cast("int")
    # Parts below k_tied hold what is tied to the pivot; two of them need not meet.
    others = F.when(F.col("tied"), F.sequence(F.col("k_tied"), F.col("k_tied") + F.col("k_loose") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("k_tied") + F.col("k_loose") - 1))
    dealt = placed.withColumn("part", own).withColumn("other", F.explode(others))
    dealt = dealt.select("comp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part",
                         "rep", "tied", "set")

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        sides: dict[int, list] = {i: [], j: []}
        for part, *row in zip(*(table.column(c).to_pylist() for c in ("part", "rep", "tied", "set"))):
            sides[part].append(row)
        if i == j:
            return link_table(join_block(sides[i], percent=percent))
        return link_table(join_block(sides[i], sides[j], percent) if sides[i] and sides[j] else [])

    return dealt.groupBy("comp", "i", "j").applyInArrow(join, "u bigint, v bigint")


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE,
                 percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``.

    ``width`` is the number of words of a shingle, ``percent`` (``LEAST_PERCENT`` to 100) the least similarity.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be between {LEAST_PERCENT} and 100")
    arrow_batches(docs)
    # Texts of classes that share a file are read again; a Bloom filter of their ids, whose size Spark bounds,
    # keeps most others out of that shuffle while the ids are few enough for one.
    docs.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    whole = written(describe(docs, doc_id, text, width, percent), "sets")
    sets = written(whole.select("id", "n", "h1", "h2"), "ids")
    real = sets.where("n > 0 and id is not null")
    classes = written(real.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "classes")
    # All rows of a class have the same files.
    filing = F.max(F.struct("files", "spare_even", "spare_odd")).alias("f")
    filings = written(whole.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), filing).select(
        "rep", "f.*"), "filings")
    discard(whole)
    filed = filings.select("rep", F.explode("files").alias("file"))
    shared = written(filed.groupBy("file").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "files")
    # Files are the heavier the more classes they hold. The heaviest of a class, as many as it may forgo, are left out.
    odd = F.col("file").bitwiseAND(F.lit(1))
    hits = filed.join(shared, "file").join(filings.select("rep", "spare_even", "spare_odd"), "rep").withColumn("odd", odd)
    heavy = Window.partitionBy("rep", "odd").orderBy(F.col("m").desc(), "file")
    light = written(hits.withColumn("nth", F.row_number().over(heavy)).where(
        F.col("nth") > F.when(F.col("odd") == 1, F.col("spare_odd")).otherwise(F.col("spare_even"))).select("rep", "file", "m"), "light")
    discard(filings)
    ends = light.groupBy("file").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("file", "low")
    found = written(light.join(ends, "file").groupBy("rep", "low").agg(F.sum("m").alias("m")), "filed")
    candidates = connected_components(found, "rep", "low").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    scores = found.groupBy("rep").agg(F.sum("m").alias("score"))
    placed = written(candidates.join(scores, "rep").join(classes, "rep"), "placed")
    stats = written(placed.groupBy("comp").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.max_by("rep", F.struct("score", -F.col("rep"))).alias("pivot")), "stats")
    members = written(placed.drop("score").join(stats, "comp"), "members")
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    fits = (F.col("m") <= BLOCK_CLASSES) & (F.col("total") <= BLOCK_SHINGLES)

    def points(which) -> DataFrame:
        return points_of(texts.join(members.where(which), F.col("_id") == F.col("rep")).drop("_id"), width)

    # Sets of small components are never stored: they go straight to their blocks.
    large = written(points(~fits).select("comp", "rep", "n", "pivot", "set"), "points")
    # A pivot whose id belongs to several texts takes one of them.
    pivots = written(large.where("rep = pivot").groupBy("comp").agg(F.min("set").alias("p_set")), "pivots")
    tested = written(against_pivot(large.join(pivots, "comp"), percent), "tested")
    links = small_links(points(fits), percent).unionByName(block_links(tested, percent)).unionByName(
        tested.where("tied and rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v")))
    # Texts that share an id are one document, so their classes belong together.
    same = real.select("id", "h1", "h2").join(classes, ["h1", "h2"]).where("id <> rep").groupBy(
        "id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select(
        F.col("low").alias("u"), F.col("high").alias("v"))
    components = connected_components(links.unionByName(same), "u", "v")
    labels = written(classes.join(components, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component_id")), "labels")
    named = sets.select("id", "n", "h1", "h2").join(labels, ["h1", "h2"], "left")
    return named.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(
        F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))).alias("component_id"))
