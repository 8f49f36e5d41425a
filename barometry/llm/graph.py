"""Connected components of a graph given as edges, by alternating star contractions."""

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from barometry.session import written

#: Copies of each node's minimum, so that a node with very many neighbours is spread over so many tasks.
SALT = 16
#: Edges up to which the minima, at most two rows an edge, are sent to all tasks instead.
FEW_EDGES = 20_000


def _with_minimum(edges: DataFrame, key: str, other: str, few: bool) -> DataFrame:
    """``edges`` with ``low``, the smallest ``other`` of each ``key``; a key with many edges is salted.

    Whether a side is broadcast is not left to the planner, which takes all copies of a minimum for one row and
    packed files for what they hold: the driver would have to hold many times the size that it allows.
    """
    low = edges.groupBy(key).agg(F.min(other).alias("low")).select(F.col(key).alias("_key"), "low")
    if few:
        return edges.join(F.broadcast(low), F.col(key) == F.col("_key")).drop("_key")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    copies = low.select("_key", "low", spread.alias("_salt")).hint("merge")
    salted = edges.withColumn("_s", F.pmod(F.xxhash64(other), F.lit(SALT)).cast("int"))
    return salted.join(copies, (F.col(key) == F.col("_key")) & (F.col("_s") == F.col("_salt"))).drop("_key", "_salt", "_s")


def _state(edges: DataFrame) -> Row:
    """The number of edges and a sum over them, which tell whether a round has changed anything."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``component`` (the smallest node of its component) for every node of an edge.

    Self-links are ignored and do not make a node. Every round shuffles the edges a few times and writes them to the shared
    folder; a path of n nodes takes about log n rounds.
    """
    now = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), "edges")
    state = _state(now)
    while True:
        few = state[0] <= FEW_EDGES  # a round makes no more edges than there are
        # Large star: what is larger than a node is tied to the smallest of its surroundings.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, "u", "v", few).where("v > u").select(
            F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        lows = _with_minimum(large, "u", "v", few)
        small = lows.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").unionByName(
            lows.select("u", F.col("low").alias("v"))).distinct()
        now = written(small, "edges")
        last, state = state, _state(now)
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
