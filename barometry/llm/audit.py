"""Filter interaction audit by an incremental stream with retractions.

Five filters fail a document: A under 50 words; B fewer than 65 distinct words in a hundred; C more than 5 capitals
A-Z in a hundred code points; D one of ``#$%&*|`` in the text; E a text that a smaller id has too, table-wide.
Whatever the order of the filters, what each of them does follows from how many documents of a part fail
which set of them (a mask of five bits), so the audit counts masks, and expands the counts at the end.

All files go through available-now micro-batches. A to D are found in one pass over the whole text. E needs state
keyed by the text (128 bits of its hash): the smallest id so far with its part and labels. A row counts as a copy (E set)
unless it has its text's smallest id; when a smaller id arrives, the mask counted for the one before is retracted
and counted again with E. Counters are signed sums per part, so the order of files and of rows plays no part, and a later run over
the same checkpoint goes on with new files.

A batch reduces copies before any shuffle by text: the smallest id per text is an aggregate with partial results, and
rows meet their text's smallest id by (text, id), so a text with a third of all rows is spread by its ids. State is one
table version per batch, 60 bytes a text; state and counters are written below the batch's id, so a batch
that runs again after a failure writes the same. Two versions of the state stay.

Null texts are empty. A null id is not smaller than any other and no copy. Rows that share an id are copies only of
smaller ids. Labels of an id that has several rows hold if one of them does. Null parts become the empty string. An empty table has no rows.
"""

from itertools import permutations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barometry.llm.common import add_columns, as_bytes
from barometry.session import shared_folder, written

LETTERS = "ABCDE"
COPY = 16  # the bit of E
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
#: Micro-batches that the files there are when a stream begins are dealt to, at most about.
BATCHES = 4

_CAPITALS = bytes(range(65, 91))
_TRAIL = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"

KEY = ["h1", "h2"]
COUNTED = ["part", "mask", "good", "toxic"]


def own_mask(data: bytes) -> int:
    """Which of A to D a text fails, as bits from A on."""
    words = data.split()  # at ASCII white space
    n = len(words)
    points = len(data.translate(None, _TRAIL))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return ((n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2
            | (len(data.translate(None, _MARKS)) < len(data)) << 3)


def described(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """id, part, text hash and the mask of A to D of every row."""

    def make():
        def work(texts):
            h1, h2, masks = [], [], []
            for x in as_bytes(texts):
                digest = xxhash.xxh3_128_digest(x or b"")
                h1.append(int.from_bytes(digest[:8], signed=True))
                h2.append(int.from_bytes(digest[8:], signed=True))
                masks.append(own_mask(x or b""))
            return [h1, h2, masks]

        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(text).alias("_text"))
    return add_columns(rows, ["_text"], {"h1": "bigint", "h2": "bigint", "mask": "int"}, make, ("_text",))


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """``rows`` with ``good`` (quality 1) and ``toxic`` (toxic 1)."""
    marks = labels.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return rows.join(marks, F.col("id") == F.col("_id"), "left").drop("_id").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def firsts(rows: DataFrame) -> DataFrame:
    """The rows with the smallest id of their text, equal ones counted."""
    known = rows.where("id is not null")
    low = known.groupBy(*KEY).agg(F.min("id").alias("id"))
    return known.groupBy(*KEY, "id", *COUNTED).agg(F.count(F.lit(1)).alias("n")).join(low, [*KEY, "id"], "left_semi")


def apply_batch(batch: DataFrame, batch_id: int, folder: str, labels: DataFrame, doc_id: str, text: str, part: str) -> None:
    """One micro-batch: the next version of the state, and what it adds to the counters."""
    spark = batch.sparkSession
    rows = written(labelled(described(batch, doc_id, text, part), labels, doc_id), "audit-rows")
    fresh = firsts(rows).withColumn("age", F.lit(1))
    if batch_id:
        before = state(spark, folder, batch_id - 1)
        fresh = fresh.unionByName(before.withColumn("age", F.lit(0)))
    # At most the smallest ids before and now of each text.
    low = F.min("id").over(Window.partitionBy(*KEY))
    fresh.withColumn("low", low).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
    moved = spark.read.parquet(f"{folder}/state/batch={batch_id}")
    first, copy = F.col("mask"), F.col("mask").bitwiseOR(F.lit(COPY))

    def change(where: str, mask: Column, sign: int) -> DataFrame:
        return moved.where(where).select("part", mask.alias("mask"), "good", "toxic", (sign * F.col("n")).alias("n"))

    seen = rows.groupBy("part", F.when(F.col("id").isNull(), first).otherwise(copy).alias("mask"), "good", "toxic").agg(
        F.count(F.lit(1)).alias("n"))
    now, past = "age = 1 and id = low", "age = 0 and id > low"
    changes = (seen.unionByName(change(now, first, 1)).unionByName(change(now, copy, -1))
               .unionByName(change(past, first, -1)).unionByName(change(past, copy, 1)))
    changes.groupBy(*COUNTED).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/counters/batch={batch_id}")
    if batch_id >= 2:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/batch={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def state(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The smallest ids by text after a batch."""
    return spark.read.parquet(f"{folder}/state/batch={batch_id}").where("id = low").drop("age", "low")


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by part, mask and labels, from the signed changes of all batches."""
    changes = spark.read.parquet(f"{folder}/counters").drop("batch")
    return changes.groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``counters``."""
    bit = {x: 1 << i for i, x in enumerate(LETTERS)}
    steps = []
    for order in permutations(LETTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"),
                                  F.lit(bit[letter]).alias("own"), F.lit(earlier).alias("earlier")))
            earlier |= bit[letter]
    # At most 32 rows a part before they are expanded.
    whole = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    each = whole.select("*", F.inline(F.array(*steps)))
    mask, own, earlier = F.col("mask"), F.col("own"), F.col("earlier")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(earlier) != 0
    total = lambda when, n: F.sum(F.when(when, n).otherwise(0)).cast("long")
    # Of the orders, a document counts as removed by each filter that it fails in an equal share.
    share = F.col("n") * (F.lit(120) / F.greatest(F.bit_count(mask), F.lit(1))).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(mask.bitwiseAND(own.bitwiseOR(earlier)) == 0, F.col("n")).alias("kept"),
        total(fails & ~gone, F.col("n")).alias("removed"), total(fails & gone, F.col("n")).alias("redundant"),
        total(mask == own, F.col("n")).alias("unique_fails"), total(fails & ~gone, F.col("good")).alias("good_lost"),
        total(fails & ~gone, F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 part: str = "source") -> DataFrame:
    """Run the stream ``docs`` over all files that are there and report on all documents so far.

    ``folder`` keeps checkpoint, state and counters; a later call with it goes on where this one ended. Without
    one, a new folder below the shared one is taken.
    """
    spark = docs.sparkSession
    base = folder or shared_folder(spark, "audit")
    # Without any file there is no batch: the counters then are this empty table.
    spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean, n long").write.mode("overwrite").parquet(
        f"{base}/counters/batch=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, base, labels, doc_id, text, part)

    query = docs.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return report(counters(spark, base))


def file_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files of a table as a stream that deals them to about ``batches`` micro-batches.

    The table may be a folder or a single file: as a pattern, which matches only itself, both can be streamed."""
    table = spark.read.parquet(path)
    path = path.rstrip("/")
    files = max(1, -(-len(table.inputFiles()) // batches))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
