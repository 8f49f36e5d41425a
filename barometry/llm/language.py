"""Language identification by fusing evidence: text, declared language, address suffix and host.

* Text: likelihood of hashed byte trigrams under each language, trained on a bounded sample of labelled rows
  (``TRAIN_ROWS`` a language), tempered since neighbouring trigrams are not independent.
* Declared language (a column, or the lang attribute of a page): its probability given the true language, from
  counts of all rows, so a declaration that the texts often contradict weighs little.
* Address suffix: country suffixes favour a language.
* Host: shares of languages by text over all rows of a host, smoothed towards those of its suffix, and these
  towards those of the corpus.

Counts for the last three are grouped aggregates over all rows; hosts are joined, never gathered. A document
is kept if its text is not blank, its best language has posterior ``MIN_POSTERIOR`` or more, and its text looks like that
language: of ten trigrams or more at most the share ``MOST_UNSEEN`` is in fewer than two texts of its sample, and their mean log-likelihood
lies no more than ``MOST_SPREADS`` spreads below that of the corpus' own texts in the language. The spread is that of
texts around their language's mean, and for short texts that of single trigrams too. Both measures move with the fit, so a verdict does not hang
on the size of the training sample.

Null and blank texts are not kept; texts of one or two bytes have no text evidence. Null declarations, hosts and addresses are no
evidence. Equal rows get equal results.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.llm.common import add_columns, arrow_batches, as_bytes
from barometry.session import written

LANGUAGES = ("en", "de", "fr", "es")
#: Labelled rows per language that the text model is fitted on, at most about.
TRAIN_ROWS = 5000
BUCKETS = 1 << 16
#: Weight of a trigram's log-likelihood.
TEMPER = 0.1
#: Counts that the level above stands for in a host's and a suffix's shares.
SMOOTHING = 20.0
MIN_POSTERIOR = 0.5
#: Share of trigrams foreign to a language's sample, above which a text of ``JUDGED_GRAMS`` or more is not in it.
MOST_UNSEEN = 0.5
JUDGED_GRAMS = 10
#: Spreads that a text's mean log-likelihood may lie below its language's.
MOST_SPREADS = 6.0
#: Least spread of texts' means, spread of single trigrams, and trigrams of a text that counts for the means.
LEAST_SPREAD = 0.25
GRAM_SPREAD = 2.5
TYPICAL_GRAMS = 100
#: Probability that a page with a country suffix is in one of the country's languages.
SUFFIX_TRUST = 0.8
# Country suffixes and their main language.
SUFFIX_LANGUAGES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "uk": "en", "us": "en",
                    "au": "en", "ie": "en", "nz": "en"}


def trigrams(data: bytes) -> np.ndarray:
    """The bucket of every byte trigram; A-Z count as a-z."""
    b = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(16)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host name that has several."""
    suffix = F.regexp_extract(F.lower(host), r"\.([a-z]+)$", 1)
    return F.when(suffix != "", suffix)


def declared_in(html: Column) -> Column:
    """The language that a page's html element declares, without its region."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.when(found != "", found)


class Model(NamedTuple):
    """One row per language, one column per trigram bucket."""

    loglik: np.ndarray  # log-probability
    common: np.ndarray  # whether two texts of the sample or more hold it: a text is no evidence for itself


def train(df: DataFrame, text: str, label: str, languages: tuple[str, ...]) -> Model:
    """The model of a sample of labelled rows.

    At most one row per language and bucket comes to the driver.
    """
    # Copies of a text count once: neither the bound nor the model hangs on how often a text is repeated.
    known = df.where(F.col(label).isin(*languages)).select(F.col(label), F.col(text)).withColumn(
        "_h", F.xxhash64(text)).dropDuplicates([label, "_h"])
    have = {r[0]: r[1] for r in known.groupBy(label).count().collect()}  # one row per language
    share = F.lit(0.0)
    for language, n in have.items():
        share = F.when(F.col(label) == language, min(1.0, TRAIN_ROWS / n)).otherwise(share)
    chance = F.pmod(F.xxhash64(text), F.lit(1_000_000)) / 1_000_000
    sample = known.where(chance < share).select(F.col(label).alias("label"), F.col(text).alias("text"))
    index = {language: i for i, language in enumerate(languages)}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        texts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for language, data in zip(batch.column("label").to_pylist(), as_bytes(batch.column("text"))):
                if data and len(data) >= 3:
                    often = np.bincount(trigrams(data), minlength=BUCKETS)
                    total[index[language]] += often
                    texts[index[language]] += often > 0
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row * BUCKETS + bucket), pa.array(total[row, bucket]), pa.array(texts[row, bucket])], ["cell", "n", "texts"])

    cells = arrow_batches(sample).mapInArrow(tally, "cell bigint, n bigint, texts bigint").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("texts").alias("texts")).toArrow()
    counted, held = np.zeros(len(languages) * BUCKETS), np.zeros(len(languages) * BUCKETS)
    counted[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    held[cells.column("cell").to_numpy()] = cells.column("texts").to_numpy()
    counted = counted.reshape(len(languages), BUCKETS) + 0.5
    return Model(np.log(counted / counted.sum(1, keepdims=True)), held.reshape(len(languages), BUCKETS) >= 2)


def score(df: DataFrame, model: Model, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_grams``, ``_loglik`` (log-likelihood of the text by language) and ``_unseen`` (trigrams that
    fewer than two texts of each language's sample hold)."""
    # A bucket's log-probabilities lie together; the model has a fixed size.
    shared = df.sparkSession.sparkContext.broadcast(
        (np.ascontiguousarray(model.loglik.T), np.ascontiguousarray(~model.common.T)))

    def make():
        table, rare = shared.value

        def work(texts):
            grams, out, strange = [], [], []
            for data in as_bytes(texts):
                total, n = np.zeros(table.shape[1]), max(0, len(data or b"") - 2)
                unseen = np.zeros(table.shape[1], np.int64)
                for at in range(0, n, 1 << 20):
                    part = trigrams(data[at:at + (1 << 20) + 2])
                    if len(part) > 20_000:
                        often = np.bincount(part, minlength=BUCKETS)
                        total += often @ table
                        unseen += often @ rare
                    else:
                        total += table[part].sum(0)
                        unseen += rare[part].sum(0)
                grams.append(n if data and data.strip() else -1)
                out.append(total.tolist())
                strange.append(unseen.tolist())
            return [grams, out, strange]

        return work

    return add_columns(df, [text], {"_grams": "bigint", "_loglik": "array<double>", "_unseen": "array<bigint>"}, make, drop)


def best(scores: Column, languages: tuple[str, ...]) -> Column:
    """The language with the highest score (the first of equals)."""
    return F.get(F.array(*map(F.lit, languages)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def shares(counts: Column, above: Column) -> Column:
    """Shares from counts, smoothed towards those of the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING))


def language_id(df: DataFrame, text: str = "text", declared: str | None = None, host: str | None = None, url: str | None = None,
                label: str | None = None, languages: tuple[str, ...] = LANGUAGES, keep_text: bool = True) -> DataFrame:
    """``df`` with ``language``, ``confidence``, ``text_language`` and ``language_kept``.

    ``declared``, ``host`` and ``url`` name columns, if there are any; without ``host`` it is read from ``url``.
    ``label`` (default: ``declared``) names the labels that the text model is fitted on. Without ``keep_text``
    the text column is left out, and texts are read once less.
    """
    none = F.lit(None).cast("string")
    name = F.lower(F.col(host)) if host else host_of(F.col(url)) if url else none
    evidence = df.withColumns({"_declared": F.lower(F.col(declared)) if declared else none, "_host": name, "_suffix": suffix_of(name)})
    model = train(df, text, label or declared, languages)
    # Once without the texts, for the counts.
    scored = score(evidence if not keep_text else evidence.select(F.col(text), "_declared", "_host", "_suffix"), model, text, (text,))
    narrow = written(scored, "language")
    guess = narrow.where("_grams > 0").select("_declared", "_host", "_suffix", best(F.col("_loglik"), languages).alias("_by_text"))
    one = lambda x: F.sum(F.when(F.col("_by_text") == x, 1).otherwise(0)).cast("double")
    counted = F.array(*map(one, languages)).alias("_counts")
    by_host = written(guess.groupBy("_host", "_suffix").agg(counted), "hosts")
    summed = F.array(*[F.sum(F.get("_counts", F.lit(i))) for i in range(len(languages))]).alias("_of_suffix")
    total = by_host.agg(summed).first()[0] or []  # one number per language
    total = [x or 0.0 for x in total] or [0.0] * len(languages)
    corpus = F.array(*[F.lit((x + 1) / (sum(total) + len(languages))) for x in total])
    by_suffix = by_host.groupBy("_suffix").agg(summed).select(F.col("_suffix").alias("_s"), shares(F.col("_of_suffix"), corpus).alias("_of_suffix"))
    hosts = written(by_host.join(by_suffix, F.col("_suffix").eqNullSafe(F.col("_s"))).where("_host is not null").select(
        F.col("_host").alias("_h"), shares(F.col("_counts"), F.col("_of_suffix")).alias("_prior")), "priors")
    # P(declared | language): one row per pair of languages at most.
    pairs = {(r[0], r[1]): r[2] for r in guess.where(F.col("_declared").isin(*languages)).groupBy("_declared", "_by_text").count().collect()}
    said = {d: [(pairs.get((d, x), 0) + 1) / (sum(pairs.get((e, x), 0) for e in languages) + len(languages)) for x in languages]
            for d in languages}

    # What the texts of each language look like: at most one row per language.
    by_text = best(F.col("_loglik"), languages)
    own_texts = narrow.where(F.col("_grams") >= TYPICAL_GRAMS).where(F.coalesce(F.col("_declared") == by_text, F.lit(True)))
    mean = F.array_max("_loglik") / F.col("_grams")
    typical = {r[0]: (r[1], max(LEAST_SPREAD, r[2] or 0.0)) for r in own_texts.groupBy(by_text.alias("l")).agg(
        F.avg(mean), F.stddev_pop(mean)).collect()}

    base = narrow if not keep_text else score(evidence, model, text)
    joined = base.join(hosts, F.col("_host") == F.col("_h"), "left")

    def table(key: Column, rows: dict[str, list[float]], i: int) -> Column:
        out = F.lit(0.0)
        for k, values in rows.items():
            out = F.when(key == k, float(np.log(values[i]))).otherwise(out)
        return out

    country = {s: [SUFFIX_TRUST if x == y else (1 - SUFFIX_TRUST) / (len(languages) - 1) for x in languages]
               for s, y in SUFFIX_LANGUAGES.items() if y in languages}
    prior = F.coalesce("_prior", corpus)
    fused = F.array(*[
        TEMPER * F.get("_loglik", F.lit(i)) + F.log(F.get(prior, F.lit(i))) + table(F.col("_declared"), said, i)
        + table(F.col("_suffix"), country, i) for i in range(len(languages))])
    out = joined.withColumn("_fused", fused)
    confidence = 1 / F.aggregate("_fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_fused")))
    at = (F.array_position("_fused", F.array_max("_fused")) - 1).cast("int")
    n = F.greatest(F.col("_grams"), F.lit(1))
    known = (n < JUDGED_GRAMS) | (F.get("_unseen", at) <= MOST_UNSEEN * n)
    for i, x in enumerate(languages):
        if x in typical:
            centre, spread = typical[x]
            least = centre - MOST_SPREADS * F.sqrt(F.lit(spread * spread) + GRAM_SPREAD * GRAM_SPREAD / n)
            known = known & ((at != i) | (F.get("_loglik", at) / n >= least))
    return out.withColumns({
        "language": best(F.col("_fused"), languages), "confidence": confidence,
        "text_language": F.when(F.col("_grams") > 0, best(F.col("_loglik"), languages)),
        "language_kept": (F.col("_grams") >= 0) & (confidence >= MIN_POSTERIOR) & known,
    }).drop("_declared", "_host", "_suffix", "_grams", "_loglik", "_unseen", "_h", "_prior", "_fused")
