"""Quality rules: Jensen-Shannon distance of a document's histograms to its language's.

Two histograms are compared, of character classes and of common words; the
references are the sums over all documents of a language. Everything is
DataFrame functions on one row: no shuffle but the sums of the references,
which are one row per language of the word lists.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import renamed, written

# Frequent function words of each language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "in", "is", "was", "by", "for", "that", "with", "this", "from", "it", "as", "on", "are", "at", "be", "a"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
}

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window that may repeat.
WINDOW = 8
#: Classes of characters that are counted; the rest of a text is one more class.
CLASSES = {"upper": r"[A-Z\u00C0-\u00DE]", "digit": r"[0-9]", "mark": r"[.,;:!?'\"()\-]", "symbol": SYMBOLS}


@dataclass(frozen=True)
class Rules:
    """Thresholds. A histogram of fewer than min_words words or min_chars characters isn't judged."""

    least_words: int = 20
    most_repeated_percent: int = 30
    min_words: int = 50
    min_chars: int = 200
    most_word_distance: float = 0.34
    most_char_distance: float = 0.32


def _words(text: Column) -> Column:
    """Words of a text: with one sign to split at, no regular expression is needed."""
    for sign in "\t\n\v\f\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _counted(rows: DataFrame) -> DataFrame:
    """Adds words, classes, n_words, word_chars, n_chars and n_symbols to (text, ...).

    What a lambda reads is made in a step before it.
    """
    text = F.coalesce("text", F.lit(""))
    classes = [F.regexp_count(text, F.lit(pattern)).cast("double") for pattern in CLASSES.values()]
    step = rows.select("*", _words(text).alias("words"), F.array(*classes).alias("classes"), F.length(text).alias("n_chars"))
    return step.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.get("classes", F.lit(list(CLASSES).index("symbol"))).cast("long").alias("n_symbols"),
    )


def _pairs(column: str, apart: int) -> Column:
    """Hash of each element with the one `apart` places on."""
    n = F.size(column)
    both = F.zip_with(F.slice(column, 1, n - apart), F.slice(column, apart + 1, n - apart), lambda a, b: F.xxhash64(a, b))
    return F.when(n > apart, both).otherwise(F.array().cast("array<bigint>"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Adds n_dup_lines and n_repeat_words: words in windows of eight that the text holds twice or more.

    Windows are compared by 64-bit hashes, built by doubling: words, pairs,
    fours, eights. Texts whose windows are all distinct need no more than that;
    for the others the starts of repeated windows are sorted, and each covers
    the words up to the next start, eight at most.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(WORD))
    step = rows.select("*", lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1")).drop("text")
    step = step.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    step = step.withColumn("h2", _pairs("h1", 1)).drop("h1")
    step = step.withColumn("h4", _pairs("h2", 2)).drop("h2")
    step = step.withColumn("h8", _pairs("h4", 4)).drop("h4")
    step = step.withColumn("again", F.size(F.array_distinct("h8")) < F.size("h8"))
    # only texts with a repeated window are sorted
    at = F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.withColumn("sorted", F.when(F.col("again"), F.sort_array(at))).drop("h8")
    n = F.size("sorted")
    equal = F.zip_with(
        F.slice("sorted", 1, n - 1),
        F.slice("sorted", 2, n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    step = step.withColumn("starts", F.when(F.col("again"), F.sort_array(F.array_distinct(F.flatten(equal))))).drop("sorted")
    m = F.size("starts")
    gaps = F.zip_with(F.slice("starts", 1, m - 1), F.slice("starts", 2, m - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda total, x: total + x)
    return step.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(F.lit(0).cast("long"))).drop("starts", "again")


def _by_language(values: dict[str, list], kind: str) -> Column:
    """The array that belongs to the language of a row, null for languages without one."""
    chosen = F.lit(None).cast(f"array<{kind}>")
    for lang, items in values.items():
        chosen = F.when(F.col("lang") == lang, F.array(*map(F.lit, items)).cast(f"array<{kind}>")).otherwise(chosen)
    return chosen


def _histograms(rows: DataFrame) -> DataFrame:
    """Adds char_counts and word_counts. word_counts is null for languages without a list."""
    space = (F.col("n_chars") - F.col("word_chars")).cast("double")
    rest = F.col("n_chars") - space - F.aggregate("classes", F.lit(0.0), lambda a, b: a + b)
    step = rows.withColumn("char_counts", F.concat("classes", F.array(space, F.greatest(rest, F.lit(0.0))))).drop("classes")
    # words as they stand at the start and inside of a sentence; a set of a language's own list is looked up once per word
    hits = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        forms = [x for word in words for x in (word, word.capitalize())]
        hits = F.when(F.col("lang") == lang, F.filter("words", partial(_is_one_of, forms))).otherwise(hits)
    step = step.withColumn("hits", F.transform(hits, lambda w: F.lower(w))).withColumn("listed", _by_language(COMMON_WORDS, "string"))
    # hits is used twice, so that it is made before the lambda that reads it and not in it
    each = F.transform("listed", lambda word: F.size(F.filter("hits", lambda h: h == word)).cast("double"))
    step = step.withColumn("word_hits", F.when(F.size("hits") >= 0, each)).drop("listed")
    return step.withColumn("word_counts", F.concat("word_hits", F.array((F.col("n_words") - F.size("hits")).cast("double")))).drop("word_hits", "hits")


def _is_one_of(forms: list[str], word: Column) -> Column:
    return word.isin(forms)


def _shares(counted: DataFrame) -> dict[str, dict[str, list[float]]]:
    """For each language of the lists: its share of each character class and common word over all rows.

    One row per language reaches the driver; languages without a row have none.
    """
    sums = {"char_counts": len(CLASSES) + 2, "word_counts": max(map(len, COMMON_WORDS.values())) + 1}
    parts = [F.sum(F.get(column, F.lit(i))).alias(f"{column}_{i}") for column, n in sums.items() for i in range(n)]
    found = {}
    for row in counted.where(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*parts).collect():
        found[row["lang"]] = {}
        for column, n in sums.items():
            values = [row[f"{column}_{i}"] or 0.0 for i in range(n)]
            found[row["lang"]][column] = [x / max(sum(values), 1.0) for x in values]
    return found


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Shares of character classes and common words of each listed language, over all documents."""
    rows = renamed(docs, text=docs[text].cast("string"), lang=docs[lang].cast("string"))
    return _shares(_histograms(_counted(rows)).select("lang", "char_counts", "word_counts"))


def _with_distance(rows: DataFrame, counts: str, found: dict[str, list[float]], name: str) -> DataFrame:
    """Adds the Jensen-Shannon distance, 0 to 1, of counts to the shares of the row's language.

    Null for counts that add up to 0 and for languages without shares.
    """
    step = rows.withColumn("total", F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)).withColumn("shares", _by_language(found, "double"))
    # total is used twice, so that it is made before the lambda that reads it and not in it
    step = step.withColumn(counts, F.when(F.col("total") > 0, F.transform(counts, lambda x: x / F.col("total"))))
    parts = F.zip_with(
        counts,
        "shares",
        lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0),
    )
    divergence = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2
    # rounding may leave a little less than 0; a null stays one
    return step.withColumn(name, F.sqrt(F.when(divergence < 0, 0.0).otherwise(divergence))).drop("total", "shares", counts)


def _with_distances(rows: DataFrame, found: dict[str, dict[str, list[float]]]) -> DataFrame:
    for kind in ("char", "word"):
        shares = {lang: of[f"{kind}_counts"] for lang, of in found.items()}
        rows = _with_distance(rows, f"{kind}_counts", shares, f"{kind}_distance")
    return rows


def _verdict(rows: DataFrame, found: dict[str, dict[str, list[float]]], rules: Rules) -> DataFrame:
    """Adds char_distance, word_distance, base_failed and kept."""
    step = _with_distances(rows, found)
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words"))
    far_words = (F.col("n_words") >= rules.min_words) & (F.col("word_distance") > rules.most_word_distance)
    far_chars = (F.col("n_chars") >= rules.min_chars) & (F.col("char_distance") > rules.most_char_distance)
    step = step.select("*", failed.alias("base_failed"), F.coalesce(far_words | far_chars, F.lit(False)).alias("far"))
    # The row number is no part of the verdict: it keeps the optimizer from copying all of the above into filters on kept.
    verdict = F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & ~F.col("far")).otherwise(F.lit(False))
    return step.withColumn("kept", verdict).drop("far")


def judge(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: counts, distances, base_failed, kept.

    A null text is an empty one and fails the base rules, as it has no words.
    Documents in a null or unlisted language are kept if they pass the base
    rules, as there is no reference for them. Repeated rows are judged alike;
    an empty table gives an empty one. The texts are read once: the counts are
    written before the references are summed from them.
    """
    rows = renamed(docs, doc_id=doc_id, text=docs[text].cast("string"), lang=docs[lang].cast("string"))
    counted = _histograms(_repeated(_counted(rows))).drop("words")
    measured = written(counted)
    return _verdict(measured, _shares(measured), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all columns. No row is shuffled; texts are read twice."""
    found = references(docs, text, lang)
    rows = docs.select(
        docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"), F.struct(*(docs[c] for c in docs.columns)).alias("carried")
    )
    return _verdict(_histograms(_repeated(_counted(rows))), found, rules).where("kept").select("carried.*")
