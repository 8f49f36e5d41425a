"""Secret scan: fixed patterns, and tokens that pass a battery of randomness tests.

Base spans are password, token and key assignments, access keys and long hexadecimal numbers. Besides, every run of at least
``MIN_TOKEN`` token characters with letters and digits, or ``MIN_LETTERS`` with letters, is a candidate. Its encoding is the
smallest alphabet that holds its characters, and four statistics are taken over that alphabet: chi-squared distance
from uniform use of the alphabet, the number of runs of lower case, upper case, digits and signs, the number of runs of
vowels and consonants inside stretches of letters, and the correlation of neighbouring characters.

A candidate is found when
* it is consistent with randomness: none of the four tests rejects it at ``REJECT`` (each at a quarter), and
* it is unlikely as ordinary text: the combined probability that words of this length use the alphabet as
  evenly, change class as often and alternate between vowels and consonants as seldom stays below the threshold of
  its length class.

The thresholds control the share of false discoveries at ``FDR`` (Benjamini-Hochberg) over all candidates of
the corpus, apart for each length class, since short tokens carry little evidence. Only counts of probabilities
in bins of a hundredth of a decimal power are gathered: at most ``BINS`` rows per length class.

Null texts are empty. Repeated rows give equal rows; every input row gives one row. Positions are code points.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barometry.session import written

ASSIGN = r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 12
#: Without digits a run has no changes between letters and digits to judge it by, and needs more characters.
MIN_LETTERS = 20
REJECT = 0.001
FDR = 0.01
#: Length classes: below the first, below the second and so on, the rest.
LENGTH_CLASSES = (20, 32, 64)
BINS = 3000

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings in the order in which they are tried: name, pattern, alphabet, unevenness of ordinary text in it
# (alphabet size times the sum of squared shares, less 1).
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef", 1.0),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF", 1.0),
    ("lower", "^[a-z]+$", LOWER, 0.7),
    ("upper", "^[A-Z]+$", UPPER, 0.7),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567", 1.1),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER, 1.36),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER, 1.36),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER, 2.2),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 2.7),
    ("base64", "^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/", 2.8),
]
#: Share of neighbours in ordinary identifiers that differ in class.
WORD_CHANGES = 0.15
#: The same where letters have one case only: changes are those between letters and digits.
ONE_CASE = ("hex", "HEX", "base32", "base36", "BASE36")
ONE_CASE_CHANGES = 0.1
#: Share of neighbouring letters of which one is a vowel: in words, and among letters drawn alike (2 * 5/26 * 21/26).
WORD_VOWELS = 0.58
RANDOM_VOWELS = 210 / 676


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def find_all(text: Column, pattern: str, may: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, match, second group of the pattern).

    Each step takes the text up to the next match and the match itself, so positions are sums of lengths.
    ``may`` is a cheap condition without which the pattern cannot match.
    """
    step = r"\G((?s:.*?))" + pattern
    take = lambda g: F.regexp_extract_all(text, F.lit(step), F.lit(g))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,value:string>>")
    pieces = F.arrays_zip(take(1).alias("gap"), take(2).alias("match"), take(3).alias("value"))

    def place(p, end):
        return F.struct((end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("match"),
                        p["value"].alias("value"))

    def placed(found):
        ends = running_sum(F.transform(found, lambda p: (F.length(p["gap"]) + F.length(p["match"])).cast("long")))
        return F.zip_with(found, ends, place)

    # One-element transforms bind what is used more than once.
    return F.when(may, F.transform(F.array(pieces), placed)[0]).otherwise(empty)


#: Terms of a running sum that are appended one by one; longer ones are cut into blocks of so many.
SUM_BLOCK = 256


def running_sum(terms: Column) -> Column:
    """Running sums of an array of long numbers, by blocks, so that no array grows by one beyond a block's length."""
    def grow(xs, before):
        sums = F.aggregate(xs, F.array(before), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(sums, 2, F.greatest(F.size(sums) - 1, F.lit(0)))

    def total(xs):
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_blocks(xs):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(SUM_BLOCK))
        return F.transform(F.array(F.transform(firsts, lambda i: F.slice(xs, i, SUM_BLOCK))), join_blocks)[0]

    def join_blocks(blocks):
        before = F.concat(F.array(F.lit(0).cast("long")), grow(F.transform(blocks, total), F.lit(0).cast("long")))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), grow))

    return F.transform(F.array(terms), by_blocks)[0]


def count_below(spans: Column, field: str, value: Column) -> Column:
    """How many of the spans, whose ``field`` ascends, have it below ``value``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (step <= F.size(spans) - at) & (F.get(spans, at + step - 1)[field] < value), at + step).otherwise(at))


def apart(token: Column, spans: Column) -> Column:
    """Whether the token overlaps none of ``spans``, which are in order and do not overlap each other."""
    return (F.size(spans) == 0) | (
        count_below(spans, "start", token["end"]) == count_below(spans, "end", token["start"] + 1))


def pairs(xs: Column, size: Column, f) -> Column:
    """``f`` of the neighbours of an array."""
    return F.zip_with(F.slice(xs, 1, size - 1), F.slice(xs, 2, size - 1), f)


PLACE = ("start", "end")


def place(s: Column) -> list[Column]:
    return [s[c].alias(c) for c in PLACE]


def encoded(s: Column) -> Column:
    """Of a candidate (start, end, match): its encoding, and its characters with their classes and sounds."""
    bare = F.rtrim(s["match"], F.lit("="))
    number = F.lit(-1)
    for k, (_, pattern, _, _) in reversed(list(enumerate(ENCODINGS))):
        number = F.when(bare.rlike(pattern), k).otherwise(number)
    # The URL-safe signs stand for those of the usual alphabet.
    return F.struct(*place(s), number.alias("encoding"), F.translate(bare, "-_", "+/").alias("plain"))


def spelled(s: Column) -> Column:
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("alphabet"), F.lit(u).alias("uneven")) for n, _, a, u in ENCODINGS])
    own = F.get(known, s["encoding"])
    # Vowels are 1, other letters 0; all else splits the stretches of letters.
    sound = F.translate(F.lower(s["plain"]), "aeioubcdfghjklmnpqrstvwxyz0123456789+/", "1" * 5 + "0" * 21 + "." * 12)
    kind = F.translate(s["plain"], LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    return F.struct(
        *place(s), own["name"].alias("name"), own["uneven"].alias("uneven"), own["alphabet"].alias("alphabet"),
        s["plain"].alias("plain"), F.length(s["plain"]).alias("size"), F.split(own["alphabet"], "").alias("signs"),
        F.split(s["plain"], "").alias("letters"), F.split(kind, "").alias("kind"), F.split(sound, "").alias("sound"))


def measured(e: Column) -> Column:
    n, m = e["size"].cast("double"), F.size(e["signs"]).cast("double")
    squares = F.aggregate(e["signs"], F.lit(0.0), lambda a, c: a + F.pow(
        (e["size"] - F.length(F.replace(e["plain"], c, F.lit("")))).cast("double"), F.lit(2.0)))
    index = F.transform(e["letters"], lambda c: F.position(c, e["alphabet"]).cast("double"))
    changes = F.aggregate(pairs(e["kind"], e["size"], lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    spoken = F.array_compact(pairs(
        e["sound"], e["size"], lambda a, b: F.when((a != ".") & (b != "."), (a != b).cast("int"))))
    return F.struct(
        *place(e), e["name"].alias("name"), m.alias("m"), n.alias("n"), (m / n * squares - n).alias("chi"),
        e["uneven"].alias("uneven"), index.alias("index"), changes.cast("double").alias("changes"), spoken.alias("spoken"),
        e["kind"].alias("kind"), F.array_distinct(e["kind"]).alias("kinds"), e["size"].alias("size"))


def summed(s: Column) -> Column:
    """The share of pairs of characters of one class, and the sums that the serial correlation takes."""
    same = F.aggregate(s["kinds"], F.lit(0.0), lambda a, k: a + F.pow(
        F.size(F.filter(s["kind"], lambda x: x == k)) / s["n"], F.lit(2.0)))
    total = F.aggregate(s["index"], F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(s["index"], F.lit(0.0), lambda a, x: a + x * x)
    cross = F.aggregate(pairs(s["index"], s["size"], lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    turns = F.aggregate(s["spoken"], F.lit(0), lambda a, x: a + x)
    return F.struct(
        *place(s), *[s[c].alias(c) for c in ("name", "m", "n", "chi", "uneven", "changes")], same.alias("same"),
        F.size(s["spoken"]).cast("double").alias("spoken"), turns.cast("double").alias("turns"),
        (total / s["n"]).alias("mean"), square.alias("square"), cross.alias("cross"),
        (F.get(s["index"], F.lit(0)) + F.element_at(s["index"], -1)).alias("ends"))


def statistics(candidates: Column) -> Column:
    """Of every candidate: encoding, and the counts and sums that the tests take."""
    # Step by step, each over the whole array: what a step uses more than once is computed before it.
    for step in (encoded, spelled, measured, summed):
        candidates = F.transform(candidates, step)
    return candidates


def normal_numbers(s: Column) -> Column:
    """The statistics as normal numbers: four of randomness, three of ordinary text."""
    m, n, df = s["m"], s["n"], s["m"] - 1
    # Uniform use of the alphabet: Wilson and Hilferty's cube root turns chi-squared into a normal number.
    uniform = (F.pow(s["chi"] / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # Runs: neighbours differ in class as often as the shares of the classes make expect.
    expected = (n - 1) * (1 - s["same"])
    runs = (s["changes"] - expected) / F.sqrt(F.greatest(expected * s["same"], F.lit(0.25)))
    # Runs of vowels. Hexadecimal letters are two vowels of six: theirs say nothing.
    sounds = F.when((m == 16) | (s["spoken"] == 0), 0.0).otherwise(
        (s["turns"] - RANDOM_VOWELS * s["spoken"]) / F.sqrt(F.greatest(
            RANDOM_VOWELS * (1 - RANDOM_VOWELS) * s["spoken"], F.lit(0.1))))
    # Neighbouring characters: correlation of their places in the alphabet.
    spread = s["square"] - n * s["mean"] * s["mean"]
    covered = s["cross"] - s["mean"] * (2 * n * s["mean"] - s["ends"]) + (n - 1) * s["mean"] * s["mean"]
    serial = F.when(spread > 0, (covered / spread + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n) * 9)
    # Ordinary text: noncentral chi-squared for the alphabet, binomial changes of class and of vowels.
    excess = n * s["uneven"]
    even = (s["chi"] - (df + excess)) / F.sqrt(2 * (df + 2 * excess))
    share = F.when(s["name"].isin(*ONE_CASE), ONE_CASE_CHANGES).otherwise(WORD_CHANGES)
    often = (share * (n - 1) - s["changes"]) / F.sqrt(share * (1 - share) * (n - 1))
    seldom = F.when(s["spoken"] == 0, 9.0).otherwise((s["turns"] + 0.5 - WORD_VOWELS * s["spoken"]) / F.sqrt(F.greatest(
        WORD_VOWELS * (1 - WORD_VOWELS) * s["spoken"], F.lit(0.1))))
    return F.struct(*place(s), s["name"].alias("name"), n.alias("n"),
                    F.array(uniform, F.abs(runs), F.abs(sounds), F.abs(serial), even, often, seldom).alias("z"))


def probabilities(s: Column) -> Column:
    return F.struct(*place(s), s["name"].alias("name"), s["n"].alias("n"), F.transform(s["z"], normal_cdf).alias("p"))


def tested(s: Column) -> Column:
    level, p = REJECT / 4, s["p"]
    random = 1 - p[0] >= level
    for k in (1, 2, 3):
        random = random & (2 * (1 - p[k]) >= level)
    return F.struct(*place(s), s["name"].alias("name"), s["n"].alias("n"), random.alias("random"),
                    F.log(F.greatest(p[4] * p[5] * p[6], F.lit(1e-300))).alias("log"))


def binned(s: Column) -> Column:
    # Fisher's combination of three.
    p = F.least(F.lit(1.0), F.exp(s["log"]) * (1 - s["log"] + s["log"] * s["log"] / 2))
    length_class = F.lit(0)
    for least in LENGTH_CLASSES:
        length_class = length_class + (s["n"] >= least).cast("int")
    return F.struct(*place(s), s["name"].alias("encoding"), length_class.alias("length_class"), s["random"].alias("random"),
                    F.least(F.lit(BINS), F.floor(-100 * F.log10(p)).cast("int")).alias("bin"))


def judged(candidates: Column) -> Column:
    """Candidate spans with their encoding, length class, whether the battery accepts them as random, and their bin."""
    judgement = statistics(candidates)
    for step in (normal_numbers, probabilities, tested, binned):
        judgement = F.transform(judgement, step)
    return judgement


def thresholds(candidates: DataFrame) -> dict[int, int]:
    """The lowest bin that counts as found, by length class (Benjamini and Hochberg over all candidates)."""
    bins = candidates.groupBy("length_class", "bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    everything = Window.partitionBy("length_class")
    ranked = bins.select("length_class", "bin", F.sum("n").over(order).alias("found"), F.sum("n").over(everything).alias("m"))
    good = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 100) <= FDR * F.col("found") / F.col("m"))
    rows = good.groupBy("length_class").agg(F.min("bin").alias("bin")).collect()  # one row per length class
    return {r["length_class"]: r["bin"] for r in rows}


def secret_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``base_spans`` and ``spans`` (kind, start, end), ordered by start and kind."""
    span = "array<struct<start:bigint,end:bigint,kind:int>>"

    def spans(found: Column, kind: str) -> Column:
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"))).cast(span)

    t = F.col("_text")
    named = df.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = named.select(
        doc_id,
        # Matches are taken first and short ones dropped afterwards: a short one may hide what begins inside it.
        F.filter(find_all(t, "(?i:" + ASSIGN + ")", t.contains("=") | t.contains(":")),
                 lambda m: F.length(m["value"]) >= 8).alias("assign"),
        find_all(t, "(AKIA([A-Z0-9]{12,}))", t.contains("AKIA")).alias("access"),
        find_all(t, "(()[0-9a-f]{32,})", t.rlike("[0-9a-f]{32}")).alias("hex"),
        find_all(t, "(()[A-Za-z0-9+/_-]{%d,}={0,2})" % MIN_TOKEN, t.rlike("[A-Za-z0-9+/_-]{%d}" % MIN_TOKEN)).alias("tokens"))
    base = F.sort_array(F.concat(spans(F.col("assign"), "assign"), spans(F.col("access"), "access"), spans(F.col("hex"), "hex")))
    # Plain numbers and short words carry too little; what a base span covers is found already.
    mixed = F.filter("tokens", lambda m: m["match"].rlike("[A-Za-z]") & (
        m["match"].rlike("[0-9]") | (F.length(m["match"]) >= MIN_LETTERS)) & apart(m, F.col("assign"))
        & apart(m, F.col("access")) & apart(m, F.col("hex")))
    narrow = written(found.select(doc_id, base.alias("_base"), judged(mixed).alias("_tokens")), "secrets")
    lowest = thresholds(narrow.select(F.inline("_tokens")))

    def is_found(c):
        good = F.lit(False)
        for length_class, least in lowest.items():
            good = good | ((c["length_class"] == length_class) & (c["bin"] >= least))
        return c["random"] & good

    added = F.transform(F.filter("_tokens", is_found), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind"))).cast(span)
    every = F.sort_array(F.transform(F.concat("_base", added), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    base_order = F.sort_array(F.transform("_base", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    named_spans = lambda xs: F.transform(xs, lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return narrow.select(doc_id, named_spans(base_order).alias("base_spans"), named_spans(every).alias("spans"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
