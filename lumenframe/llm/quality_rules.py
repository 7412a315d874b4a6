"""Quality rules: counted base rules, then divergence of character and word histograms from language references."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import SPACES, cut, words

#: Frequent function words by language. A histogram has one bin for each distinct word and one for all others.
COMMON = {
    "en": "the of and to in a is that it for was on are as with his they at be this from by or had an not".split(),
    "fr": "le la de et les des en un une du que est pour qui dans par sur pas au il elle ce ne se plus".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
SYMBOLS = "#*$%&|<>"
#: Character classes, in the order in which they are taken out of a text; what is left is the last bin.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"[\p{L}\p{M}]+", r"\p{N}+", r"[\s\p{Z}]+", r"[.,;:!?'\"()\-]+")
#: The place of the class of blanks.
BLANKS = 4
#: Distance (0: the same, 1: nothing in common) above which a character histogram is not that of prose.
MOST_CHARS = 0.28
#: The same for words, as a part of the distance that a text without any common word has from the same reference. A text
#: without any is at 1 from each reference, and only texts with far too many of some words are beyond.
MOST_WORDS = 0.95
#: Texts under these lengths have no histogram worth comparing.
LEAST_CHARS, LEAST_WORDS = 200, 40


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def features(docs: DataFrame) -> DataFrame:
    """docs without text but with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and two histograms.

    Native columns only. Windows of 8 words are compared by 64-bit hashes within one text. Positions are sorted only
    in texts where a window comes twice, so the work for a text of n words is n log n at most.
    """
    t, w, n = F.col("__t"), F.col("__w"), F.col("n_words")
    d = docs.withColumn("__t", F.coalesce("text", F.lit(""))).drop("text")
    d = d.withColumn("__w", words(t)).withColumn("n_words", F.size("__w").cast("long"))
    # windows of 2, 4 and 8 words, each from two of half its length; zip_with pads at the end, which slice cuts off
    joined = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.size(c)), lambda x, y: F.xxhash64(x, y))
    d = d.withColumn("__h", F.when(n >= 8, F.transform(w, lambda x: F.xxhash64(x))))
    for k in (1, 2, 4):
        d = d.withColumn("__h", joined(F.col("__h"), k))
    d = d.withColumn("__v", F.slice("__h", F.lit(1), (n - 7).cast("int"))).drop("__h")
    v, s, p = F.col("__v"), F.col("__s"), F.col("__p")
    d = d.withColumn("__s", F.when(F.size(F.array_distinct(v)) < F.size(v), F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("__v")
    d = d.withColumn("__p", F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, x["x"] == F.get(s, k - 1)["x"]), F.lit(False)) | F.coalesce(x["x"] == F.get(s, k + 1)["x"], F.lit(False))), lambda x: x["i"]))).drop("__s")
    d = d.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    ).drop("__p")
    # the common words in order with one more of each, so that every word has a run and the runs' lengths are the counts
    d = d.withColumn("__c", F.filter(w, lambda x: x.isin(WORDS))).drop("__w").withColumn("__n", F.size("__c"))
    d = d.withColumn("__c", F.sort_array(F.concat("__c", F.array(*[F.lit(x) for x in WORDS]))))
    c, a = F.col("__c"), F.col("__a")
    d = d.withColumn("__a", F.array_compact(F.transform(c, lambda x, i: F.when((i == 0) | (x != F.get(c, i - 1)), i))))
    counts = F.transform(a, lambda x, k: (F.coalesce(F.get(a, k + 1), F.col("__n") + len(WORDS)) - x - 1).cast("long"))
    d = d.withColumn("word_bins", F.concat(counts, F.array(n - F.col("__n")))).drop("__c", "__a", "__n")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__l", lines).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).drop("__l")
    bins = []
    for k, pattern in enumerate(CLASSES):
        before = f"__r{k}" if k else "__t"
        d = d.withColumn(f"__r{k + 1}", F.regexp_replace(before, pattern, ""))
        bins.append((F.length(before) - F.length(f"__r{k + 1}")).cast("long"))
    rest = F.col(f"__r{len(CLASSES)}")
    bins.append(F.length(rest).cast("long"))
    # no class takes a symbol, and none before BLANKS takes a blank, so both are counted in what these leave of a text
    odd, blank = rest, F.col(f"__r{BLANKS}")
    d = d.withColumn("word_chars", (F.length(t) - (F.octet_length(blank) - F.octet_length(_without(blank, SPACES)))).cast("long"))
    d = d.withColumn("n_symbols", (F.octet_length(odd) - F.octet_length(_without(odd, SYMBOLS))).cast("long"))
    return d.withColumn("char_bins", F.array(*bins)).drop("__t", *[f"__r{k + 1}" for k in range(len(CLASSES))])


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: within a lambda a column is computed for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _shares(bins: Column) -> Column:
    """Counts that are not 0 as shares p of their sum, each with its bin i."""
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x)
    some = F.filter(F.transform(bins, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] > 0)
    return _once(total, lambda t: F.transform(some, lambda s: F.struct((s["x"] / t).alias("p"), s["i"].alias("i"))))


def _distance(shares: Column, q: Column) -> Column:
    """Jensen-Shannon distance to base 2, from 0 to 1, of shares from a histogram. Bins that the shares leave empty add log 2 of their part of q, whose sum is where the others start from."""

    def term(s: Column) -> Column:
        p, r = s["p"], F.get(q, s["i"])
        return p * F.log(2 * p / (p + r)) + F.when(r > 0, r * F.log(r / (p + r))).otherwise(F.lit(0.0))

    start = F.aggregate(q, F.lit(0.0), lambda a, x: a + x) * math.log(2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(shares, start, lambda a, s: a + term(s)) / (2 * math.log(2))))


def _empty_distance(q: list[float]) -> float:
    """The distance of a text without any common word from a word histogram."""
    a = q[-1]
    terms = sum(x * math.log(2) for x in q[:-1]) + math.log(2 / (1 + a)) + (a * math.log(2 * a / (1 + a)) if a > 0 else 0.0)
    return math.sqrt(max(0.0, terms / (2 * math.log(2))))


def references(found: DataFrame) -> list[tuple[str, list[float], list[float]]]:
    """The histograms of all texts of each supported language that pass the base rules and length guards.

    One row of whole counts a supported language goes to the driver.
    """
    ok = found.where(~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS) & F.col("lang").isin(list(COMMON)))
    sums = lambda c, n: [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(n)]
    rows = (
        ok.select("lang", F.col("char_bins").alias("c"), F.col("word_bins").alias("w"))
        .groupBy("lang")
        .agg(*sums("c", len(CLASSES) + 1), *sums("w", len(WORDS) + 1))
        .orderBy("lang")
        .collect()
    )
    out = []
    for r in rows:
        c = [r[f"c{i}"] for i in range(len(CLASSES) + 1)]
        w = [r[f"w{i}"] for i in range(len(WORDS) + 1)]
        out.append((r["lang"], [x / max(1, sum(c)) for x in c], [x / max(1, sum(w)) for x in w]))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """docs (without text) with the base counts, base_failed, the two distances and kept.

    kept is false if base_failed, or if the text is long enough and its character histogram lies further than MOST_CHARS
    from every language's reference, or its common-word histogram further than MOST_WORDS of what a text without common
    words does. Comparing with all languages spares clean texts with a wrong or missing lang. Texts whose lang has no
    reference are judged by the base rules alone, and references without common words do not decide. Null and empty texts
    have no words and fail the base rules. Other columns stay as they are, and every row is kept and judged by itself, repeated ones too. An empty table gives no
    rows; without any reference only the base rules decide. Columns named like the results are an error.
    """
    if clash := {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "word_bins", "char_bins", "base_failed", "char_distance", "word_distance", "kept"} & set(docs.columns):
        raise ValueError(f"the table already has {sorted(clash)}")
    found = cut(features(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    refs = references(found)
    # one lambda over all references: an array of distances would be taken apart and each distance computed for every use
    known = [F.struct(F.array(*[F.lit(float(x)) for x in r[1]]).alias("c"), F.array(*[F.lit(float(x)) for x in r[2]]).alias("w"), F.lit(_empty_distance(r[2])).alias("e")) for r in refs]
    if refs:
        each = lambda c: lambda n: F.transform(F.array(*known), lambda r: F.struct(_distance(n, r[c]).alias("d"), r["e"].alias("e")))
        d = found.withColumn("__c", _once(_shares(F.col("char_bins")), each("c"))).withColumn("__d", _once(_shares(F.col("word_bins")), each("w")))
        least = lambda c: F.least(F.array_min(F.transform(c, lambda x: x["d"])), F.lit(1.0))
        d = d.withColumn("char_distance", least("__c")).withColumn("word_distance", least("__d"))
        d = d.withColumn("__far", F.coalesce(F.array_min(F.transform("__d", lambda x: F.when(x["e"] > 0, x["d"] / x["e"]))), F.lit(0.0))).drop("__c", "__d")
    else:
        d = found.withColumns({c: F.lit(0.0) for c in ("char_distance", "word_distance", "__far")})
    chars = F.aggregate("char_bins", F.lit(0).cast("long"), lambda a, x: a + x)
    odd = ((chars >= LEAST_CHARS) & (F.col("char_distance") > MOST_CHARS)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("__far") > MOST_WORDS))
    known_lang = F.col("lang").isNull() | F.col("lang").isin([r[0] for r in refs])
    return d.withColumn("kept", ~F.col("base_failed") & ~(odd & known_lang)).drop("__far")


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
