"""Line dedup: windows of three consecutive lines, found again anywhere, lose their later occurrences.

Every window is hashed to 128 bits. Of the windows with equal hashes the one with the smallest document id
(then text hash, then position) stays; the lines that any other covers are removed, covered positions of
neighbouring windows merged. Texts with fewer lines have no window and stay as they are; windows of three
empty lines do not count. Lines are compared as they are. Null texts stay null.

An id and a text make a document: rows that repeat both are one document and get one result, rows with a null id too.

A frequent window costs one row per occurrence and nothing more: the first occurrence is an aggregate with
partial results, and the repeated windows are written to the shared folder and joined from there, where a
skewed join can split them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.session import written

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """doc, text hash, position and hash of every window."""
    lines = docs.select("_doc", "_hash", F.split("_text", "\n", -1).alias("l"))
    hashed = lines.where(F.size("l") >= WINDOW).select(
        "_doc", "_hash", F.transform("l", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("l", lambda x: F.xxhash64(F.lit(17), x)).alias("b"))

    def window(i: Column) -> Column:
        own = lambda c: [F.get(F.col(c), i + k) for k in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(*own("a")).alias("w1"), F.xxhash64(*own("b")).alias("w2"))

    empty = F.xxhash64(*[F.xxhash64(F.lit(""))] * WINDOW)
    starts = F.sequence(F.lit(0), F.size("a") - WINDOW)
    return hashed.select("_doc", "_hash", F.inline(F.transform(starts, window))).where(F.col("w1") != empty)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines``, ``n_removed`` and ``removed`` (spans "first-last" of line
    numbers from 0, comma-joined)."""
    named = docs.withColumns({"_doc": F.col(doc_id), "_text": F.col(text), "_hash": F.xxhash64(F.col(text))})
    keys = named.select("_doc", "_hash", "_text")
    repeated = written(_windows(keys).groupBy("w1", "w2").agg(
        F.min(F.struct("_doc", "_hash", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "w1", "w2", "first"), "windows")
    later = _windows(keys).join(repeated, ["w1", "w2"]).where(F.struct("_doc", "_hash", "pos") > F.col("first"))
    covered = later.groupBy(F.col("_doc").alias("_d"), F.col("_hash").alias("_h")).agg(F.collect_set("pos").alias("_starts"))
    joined = named.join(covered, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")

    lines = F.split("_text", "\n", -1)
    n = F.coalesce(F.size(lines), F.lit(0))
    marked = F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (WINDOW - 1))))
    gone = F.sort_array(F.array_distinct(marked))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "_gone")
    # A span begins at a covered line whose predecessor is not covered, and ends likewise.
    begins = F.filter("_gone", lambda p, i: (i == 0) | (F.get(F.col("_gone"), i - 1) != p - 1))
    ends = F.filter("_gone", lambda p, i: F.coalesce(F.get(F.col("_gone"), i + 1) != p + 1, F.lit(True)))
    spans = F.array_join(F.zip_with(begins, ends, lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))), ",")
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    out = joined.withColumns({"_gone": gone, "_lines": lines})
    some = F.col("_gone").isNotNull()
    return out.withColumns({
        text: F.when(some, cleaned).otherwise(F.col("_text")),
        "n_lines": F.when(F.col("_text").isNull(), 0).otherwise(n).cast("long"),
        "n_removed": F.when(some, F.size("_gone")).otherwise(0).cast("long"),
        "removed": F.when(some, spans).otherwise(""),
    }).drop("_doc", "_text", "_hash", "_d", "_h", "_starts", "_gone", "_lines")
