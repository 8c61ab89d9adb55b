"""Quality rules by distribution divergence.

DataFrame operations only.  Each text gives two histograms: of its characters
by class and of its words by a list of common words.  Each language's
reference is the mean histogram of its documents that pass the base rules and
are long enough.  A document is kept if it passes the base rules and, for some
language, both Jensen-Shannon distances are within their limits.  Texts below
the minimum lengths are not judged by distance, nor are documents whose
language has no reference.

Defined cases: a null text has no words and fails the base rules; a null
language is judged against every reference; repeated rows are judged alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import SPACE_PATTERN, WORD_PATTERN

# Characters by class; what is in none is a class of its own.
CHARACTER_CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "accented": "À-ÖØ-öø-ÿ",
    "digit": "0-9",
    "space": r"\x20\x09-\x0D",
    "stop": ".,;:?'\"()-",
}
# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for",
    "fr": "le la les de des et un une que qui",
    "de": "der die und in den das ist ein zu im",
    "es": "el la los de que y en un una por",
}
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Distances judge texts of at least so many characters and words.
MIN_CHARS, MIN_JUDGED_WORDS = 200, 40
#: Limits of the Jensen-Shannon distances (0 to 1, base 2).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.45

LANGUAGES = tuple(COMMON_WORDS)
WORDS = tuple(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws.split()))
#: One ASCII character for each common word, so that counting words is counting characters.
CODES = "".join(chr(c) for c in range(48, 48 + len(WORDS)))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def base_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text, words, n_chars) of docs with n_words, word_chars, n_dup_lines, n_repeat_words, base_failed.

    Words in repeated windows: windows are hashed from the words' hashes; only
    texts in which some window occurs twice sort their windows by hash, take the
    places that have an equal neighbour and add up what those windows cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_PATTERN))
    out = docs.select("doc_id", "lang", text.alias("text")).withColumn("words", F.array_remove(F.split("text", SPACE_PATTERN), "")).withColumn("lines", lines)
    out = out.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col("h"), i + k)
    windows = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("windows", windows)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.when(repeats, F.sort_array(F.transform("windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).otherwise(F.array().cast("array<struct<k:bigint,i:int>>"))
    out = out.withColumn("by_hash", by_hash)
    beside = lambda x, j: F.coalesce(F.get(F.col("by_hash"), j)["k"] == x["k"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("by_hash", lambda x, j: beside(x, j - 1) | beside(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        twice,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    out = out.select(
        "doc_id",
        "lang",
        "text",
        "words",
        F.length("text").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def histograms(based: DataFrame) -> DataFrame:
    """Adds ``chars``, ``common`` and ``n_symbols``; drops text and words.

    ``chars`` counts characters by class, each class taken out of what the ones
    before have left; ``common`` counts common words, then words without letter
    or digit; the last count of each is the rest.
    """
    out = based.withColumn("left0", F.col("text"))
    for i, c in enumerate(CHARACTER_CLASSES.values()):
        out = out.withColumn(f"left{i + 1}", without(F.col(f"left{i}"), f"[{c}]+"))
    last = f"left{len(CHARACTER_CLASSES)}"
    counts = [F.length(f"left{i}") - F.length(f"left{i + 1}") for i in range(len(CHARACTER_CLASSES))]
    forms = [*WORDS, *[w.capitalize() for w in WORDS]]
    code = F.create_map(*[F.lit(x) for pair in zip(WORDS, CODES, strict=True) for x in pair])
    codes = F.array_join(F.transform(F.filter("words", lambda w: w.isin(*forms)), lambda w: F.element_at(code, F.lower(w))), "")
    bare = F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]")))
    out = out.withColumn("codes", codes).withColumn("bare", bare)
    out = out.withColumn("n_symbols", (F.length(last) - F.length(without(F.col(last), SYMBOLS + "+"))).cast("long")).withColumn("chars", F.array(*counts, F.length(last)))
    found = [F.length("codes") - F.length(F.replace("codes", F.lit(c))) for c in CODES]
    out = out.withColumn("common", F.array(*found, F.col("bare"), (F.col("n_words") - F.length("codes") - F.col("bare")).cast("int")))
    return out.drop("text", "words", "codes", "bare", *[f"left{i}" for i in range(len(CHARACTER_CLASSES) + 1)])


def distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of shares p and the reference q."""
    ref = F.array(*[F.lit(float(x)) for x in q])
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    sums = F.aggregate(F.zip_with(p, ref, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), sums / 2))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance) for each document.

    The histograms are written once; the references, one row for each of the
    fixed languages, come to the driver and go into the second pass as literals.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    seen = scratch.put("histograms", histograms(base_rules(docs)))
    share = lambda name, total: F.transform(name, lambda x: x / F.greatest(F.col(total), F.lit(1)))
    seen = seen.withColumn("p", share("chars", "n_chars")).withColumn("w", share("common", "n_words"))
    judged = (F.col("n_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_JUDGED_WORDS)
    n_chars, n_common = len(CHARACTER_CLASSES) + 1, len(WORDS) + 2
    means = [F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(n_chars)] + [F.avg(F.col("w")[i]).alias(f"w{i}") for i in range(n_common)]
    references = seen.filter(judged & ~F.col("base_failed") & F.col("lang").isin(*LANGUAGES)).groupBy("lang").agg(*means).orderBy("lang").collect()
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if not references:
        return seen.select(*base, (~F.col("base_failed")).alias("kept"), F.lit(None).cast("double").alias("char_distance"), F.lit(None).cast("double").alias("word_distance"))
    # rounded, as means of doubles depend on the order in which rows come
    rounded = [([round(r[f"p{i}"], 9) for i in range(n_chars)], [round(r[f"w{i}"], 9) for i in range(n_common)]) for r in references]
    pairs = [F.struct(distance(F.col("p"), chars).alias("c"), distance(F.col("w"), common).alias("w")) for chars, common in rounded]
    known = F.coalesce(F.col("lang").isin(*[r["lang"] for r in references]), F.lit(True))
    applies = judged & known
    # the reference that is nearest by the larger of the two distances, each in parts of its limit
    worst = lambda d: F.greatest(d["c"] / MAX_CHAR_DISTANCE, d["w"] / MAX_WORD_DISTANCE)
    nearest = F.array_min(F.transform("d", lambda d: F.struct(worst(d).alias("worst"), d["c"].alias("c"), d["w"].alias("w"))))
    out = seen.withColumn("applies", applies).withColumn("d", F.array(*pairs)).withColumn("near", nearest)
    kept = ~F.col("base_failed") & (~F.col("applies") | (F.col("near")["worst"] <= 1))
    return out.select(*base, kept.alias("kept"), F.when(F.col("applies"), F.col("near")["c"]).alias("char_distance"), F.when(F.col("applies"), F.col("near")["w"]).alias("word_distance"))
