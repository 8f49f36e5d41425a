"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles
(words in lower case, cut at ASCII white space; a text of one to four words is one shingle, a text without words has none). The
sketch of a union is the bottom k of the united sketches, so parts can be sketched apart and merged. Two
sketches give estimates of resemblance and containment, one sketch gives the number of distinct shingles; while
a sketch holds fewer than k hashes these are exact but for hash collisions.

Null texts are empty: an empty sketch, its string empty; two empty sketches resemble each other fully.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barometry.llm.common import WHITE

SHINGLE = 5
K = 128

#: Documents that are ordered together by ``with_next``, and the most such groups (their first ids are broadcast).
NEXT_GROUP = 512
NEXT_GROUPS = 100_000
#: Shares of one key whose sketches are limited apart when sketches are merged.
MERGE_PARTS = 64


def with_sketch(df: DataFrame, text: str = "text", sketch: str = "sketch", k: int = K) -> DataFrame:
    """``df`` with the sketch of ``text``. The words are hashed once, in a column of their own."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"{WHITE}+"), lambda w: w != "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_words")
    full = F.transform(F.sequence(F.lit(0), n - SHINGLE),
                       lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(SHINGLE)]))
    few = F.when(n > 0, F.array(F.xxhash64(F.array_join(F.transform("_words", lambda h: h.cast("string")), " ")))
                 ).otherwise(F.array().cast("array<bigint>"))
    return hashed.withColumn(sketch, bottom(F.when(n >= SHINGLE, full).otherwise(few), k)).drop("_words")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return bottom(F.concat(a, b), k)


def merge_sketches(df: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts, a null key included; null sketches are empty.

    No group is gathered: a key's hashes are first limited within each of ``MERGE_PARTS`` shares of its parts, so
    at most k a share are left when the shares of one key meet. A rank limit goes before either shuffle too.
    """
    parts = df.select(F.col(key).alias("_key"), F.coalesce(F.col(sketch), F.array().cast("array<bigint>")).alias("_s"))
    # Copies go first, with partial results; a hash of the sketch deals the rest of a key evenly, and alike on a retry.
    dealt = parts.distinct().withColumn("_share", F.pmod(F.xxhash64("_s"), F.lit(MERGE_PARTS)))
    hashes = dealt.select("_key", "_share", F.explode_outer("_s").alias("_h"))
    some = _least(hashes, ["_key", "_share"], k).select("_key", "_h")
    least = _least(some, ["_key"], k)
    # A key of empty sketches keeps a null hash, which the list leaves out.
    return least.groupBy("_key").agg(F.sort_array(F.collect_list("_h")).alias(sketch)).withColumnRenamed("_key", key)


def _least(hashes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` smallest distinct hashes of each key; nulls come last and count like a hash."""
    nth = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last()))
    return hashes.withColumn("_n", nth).where(F.col("_n") <= k).drop("_n").distinct()


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of common shingles, from the bottom k of both sketches together."""
    union = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has too."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def read_fingerprint(text: Column) -> Column:
    """The sketch that a text stands for."""
    n = (F.length(text) / 16).cast("int")

    def hash_at(i):
        # conv gives an unsigned number; the two halves keep it within a signed one.
        high = F.conv(F.substring(text, i * 16 + 1, F.lit(8)), 16, 10).cast("long")
        low = F.conv(F.substring(text, i * 16 + 9, F.lit(8)), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), hash_at)).otherwise(F.array().cast("array<bigint>"))


def with_next(docs: DataFrame, added: dict[str, str], prepare=lambda df: df, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with columns of the next document by ascending id (after the last: the first).

    ``added`` maps new names to columns; ``prepare`` is applied to the rows after they have been moved, so what
    it computes is not shuffled. Rows with a null id come first, equal ids are ordered by text.

    The ids are cut into groups at quantiles, which only decide what is ordered together. Each group also gets
    the first rows of the group after it, so one shuffle brings every row to its successor.
    """
    ids = docs.select(F.col(doc_id).alias("_id"))
    n = ids.count()
    groups = max(1, min(NEXT_GROUPS, n // NEXT_GROUP))
    cuts = [0.0]
    if groups > 1:
        at = [i / groups for i in range(1, groups)]
        found = ids.agg(F.percentile_approx("_id", at, max(10_000, 10 * groups))).first()[0] or []
        cuts = sorted(set(map(float, found))) or cuts
    edges = [float("-inf"), *cuts, float("inf")]

    def grouped(df: DataFrame, name: str) -> DataFrame:
        number = Bucketizer(splits=edges, inputCol="_number", outputCol="_group", handleInvalid="keep")
        placed = number.transform(df.withColumn("_number", F.col(name).cast("double"))).drop("_number")
        return placed.withColumn("_group", F.when(F.col(name).isNull(), -1).otherwise(F.col("_group").cast("int")))

    # At most NEXT_GROUPS rows: the first id of each group, and the group before it.
    firsts = grouped(ids, "_id").groupBy("_group").agg(F.min("_id").alias("_first"))
    order = Window.orderBy("_group")
    before = firsts.select("_first", F.coalesce(
        F.lag("_group").over(order),
        F.max("_group").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    own = grouped(docs, doc_id).withColumn("_halo", F.lit(0))
    halo = docs.join(F.broadcast(before), docs[doc_id].eqNullSafe(before["_first"])).drop("_first").withColumnRenamed(
        "_before", "_group").withColumn("_halo", F.lit(1))
    moved = prepare(own.unionByName(halo).repartition("_group"))
    following = Window.partitionBy("_group").orderBy("_halo", doc_id, text)
    out = moved.withColumns({new: F.lead(old).over(following) for new, old in added.items()})
    return out.where("_halo = 0").drop("_halo", "_group")
