"""Mixing sources to target weights by Poisson replication.

Each source is to make up its share of the total weight, measured in characters. The rate of a source is its
target amount over what it has: the mean number of times that each of its documents appears. A document's
number of copies is the Poisson quantile of a uniform number hashed from the seed and its id, so a retried
task draws the same. Every copy is a row of its own, and all rows are shuffled globally: a hashed key deals
them out to partitions and orders them there.

Sources without a weight of their own, null among them, form one group with weight ``rest``. Only one row per
weight and one for the rest comes to the driver. Rows with equal ids draw equal numbers. A null or empty text
adds nothing to its source but is copied like the others; a group without any characters has rate 0.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of the hash that make the uniform number: 52 bits.
HASH_DIGITS = 13


def uniform(seed: str, *keys) -> Column:
    """A number in [0, 1) hashed from the seed and the keys."""
    return _hashed(seed, HASH_DIGITS, *keys).cast("double") / float(1 << 4 * HASH_DIGITS)


def _hashed(seed: str, digits: int, *keys) -> Column:
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def poisson_cdf(rate: float) -> list[float]:
    """The distribution function at 0, 1, ... until what is left is below the uniform number's last bit."""
    if rate <= 0:
        return [1.0]
    step = rate + 12 * math.sqrt(rate) + 40
    log = -rate
    total, out, k = 0.0, [], 0
    while k <= step and total < 1 - 2.0**-53:
        total += math.exp(log)
        out.append(total)
        k += 1
        log += math.log(rate / k)
    return out


def rates(docs: DataFrame, weights: dict[str, float], rest: float = 0.0, total: float | None = None,
          source: str = "source", text: str = "text") -> dict[str | None, float]:
    """The mean repetition of every source with a weight; None stands for all other sources."""
    group = F.when(F.col(source).isin(*weights), F.col(source))
    have = {r[0]: r[1] or 0 for r in docs.groupBy(group.alias("g")).agg(
        F.sum(F.length(text).cast("long")).alias("n")).collect()}  # at most one row per weight and one more
    goal = sum(have.values()) if total is None else total
    share = {**weights, None: rest}
    present = sum(w for g, w in share.items() if have.get(g))
    return {g: goal * w / present / have[g] if have.get(g) and present else 0.0 for g, w in share.items()}


def mix(docs: DataFrame, weights: dict[str, float], rest: float = 0.0, total: float | None = None, seed: str = "mix",
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All copies of the rows of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, shuffled globally."""
    found = rates(docs, weights, rest, total, source, text)
    tables = {g: F.array(*map(F.lit, poisson_cdf(r))) for g, r in found.items()}
    cdf = tables[None]
    if weights:
        known = F.create_map(*[x for g in weights for x in (F.lit(g), tables[g])])
        cdf = F.coalesce(known[F.col(source)], cdf)
    u = uniform(seed, F.col(doc_id))
    copies = F.size(F.filter(cdf, lambda c: c <= u))
    drawn = docs.withColumn("_n", copies).where("_n > 0")
    each = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).drop("_n")
    keyed = each.withColumn("shuffle_key", _hashed(seed + ":order", 15, F.col(doc_id), F.col("copy")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", doc_id, "copy")
