"""Quality rules by distribution divergence.

A document is described by two histograms: of its characters over six classes (capitals,
other letters, digits, white space, punctuation, other signs) and of its words over the
``common`` most frequent words of its language and "any other word". Both are compared
with the pooled histograms of the language by the Jensen-Shannon distance (square root of
the divergence to base 2, 0 to 1). A distance counts only from a minimum length on: short
texts have ragged histograms.

Everything is column expressions. The references are counted over all documents: words in
one pass, class and common-word counts in another, both as sums per language that map
tasks combine first. They are trimmed once: distances to the histograms of all documents
that pass the base rules decide which documents the final histograms are summed over, so
that much junk in a language does not become its norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.common import SPACE, key_of, text_of, words_of
from opsight.scratch import materialize

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
WINDOW = 5


def common_words(docs: DataFrame, common: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``common`` most frequent words of each language, as ``_lang``, ``_common``.

    Ties go to the smaller word; the rank is a group limit below the shuffle.
    """
    words = docs.select(key_of(lang_col).alias("_lang"), F.explode(words_of(text_of(text_col))).alias("_word"))
    counts = words.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.col("_n").desc(), "_word"))
    top = counts.withColumn("_rank", rank).filter(F.col("_rank") <= common)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_word"))), lambda x: x["_word"])
    return top.groupBy("_lang").agg(listed.alias("_common"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one text. Only texts with an equal pair
    order their windows; the positions of repeated windows, in order, then add up to the
    words they cover.
    """
    hashes = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = _let(pairs, lambda p: _neighbours(p, F.size(p)))
        places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        return _let(places, lambda p: _cover(p, F.size(p)))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _neighbours(pairs: Column, n: Column) -> Column:
    def equal(i: Column) -> Column:
        mine = pairs[i]["h"]
        left = F.when(i > 0, pairs[F.greatest(i - 1, F.lit(0))]["h"] == mine).otherwise(False)
        right = F.when(i < n - 1, pairs[F.least(i + 1, n - 1)]["h"] == mine).otherwise(False)
        return left | right

    return F.filter(pairs, lambda x, i: equal(i))


def _cover(places: Column, n: Column) -> Column:
    def reach(x: Column, i: Column) -> Column:
        gap = places[F.least(i + 1, n - 1)] - x
        return F.when(i < n - 1, F.least(gap, F.lit(WINDOW))).otherwise(WINDOW)

    return F.aggregate(F.transform(places, reach), F.lit(0), lambda a, x: a + x)


def _counts(places: Column, common: int) -> Column:
    """How often each of 1..common occurs in ``places``, then how many are 0."""
    known = F.array_remove(places, 0)
    each = _let(
        known, lambda k: F.transform(F.sequence(F.lit(1), F.lit(common)), lambda j: F.size(F.filter(k, lambda x: x == j)))
    )
    return F.concat(each, F.array(F.size(places) - F.size(known)))


def measures(docs: DataFrame, words: DataFrame, common: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Base counts and both histograms of every document."""
    text = F.col("_text")
    rest = F.length(F.col("_rest"))
    digits, points = (F.length(F.regexp_replace("_rest", p, "")) for p in (r"[^0-9]+", r"[^.,;:!?'\"()\-]+"))
    spaces = F.col("_n_chars") - F.col("word_chars")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    places = F.transform("_words", lambda w: F.array_position(F.col("_common"), w).cast("int"))
    return (
        docs.select(F.col(id_col), key_of(lang_col).alias("_lang"), text_of(text_col).alias("_text"))
        .join(words, "_lang", "left")
        .withColumn("_common", F.coalesce("_common", F.array().cast("array<string>")))
        .withColumn("_words", words_of(text))
        .withColumn("_n", F.size("_words"))
        .withColumn("_n_chars", F.length(text))
        .withColumn("word_chars", F.length(F.regexp_replace(text, SPACE, "")))
        .withColumn("_rest", F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
        .withColumn("_capitals", F.length(F.regexp_replace(text, r"\P{Lu}+", "")))
        .withColumn("_lines", lines)
        .select(
            id_col,
            "_lang",
            F.col("_n").cast("long").alias("n_words"),
            F.col("word_chars").cast("long").alias("word_chars"),
            F.length(F.regexp_replace("_rest", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_words"), F.col("_n")).cast("long").alias("n_repeat_words"),
            F.array(
                F.col("_capitals"),
                F.col("_n_chars") - spaces - rest - F.col("_capitals"),
                digits,
                spaces,
                points,
                rest - digits - points,
            ).alias("_classes"),
            _counts(places, common).alias("_known"),
        )
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null if one is all zero."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(0.0)

    def divergence(sp: Column, sq: Column) -> Column:
        each = F.zip_with(p, q, lambda x, y: part(x / sp, y / sq) + part(y / sq, x / sp))
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2.0

    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    both = _let(
        sums, lambda s: F.when((s["p"] > 0) & (s["q"] > 0), F.sqrt(F.greatest(divergence(s["p"], s["q"]), F.lit(0.0))))
    )
    return both


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def _judged(measured: DataFrame, sample: DataFrame, common: int, guard_chars: int, guard_words: int) -> DataFrame:
    """``measured`` with both distances to the histograms that ``sample`` sums up per language."""
    reference = sample.groupBy("_lang").agg(
        _sums("_classes", 6).alias("_ref_classes"), _sums("_known", common + 1).alias("_ref_known")
    )
    # Written before it is joined: one row per language, whose size the planner then knows, so
    # documents stay where they are instead of meeting by language.
    reference = materialize(reference, "quality-reference")
    n_chars = F.aggregate("_classes", F.lit(0), lambda s, x: s + x)
    by_class = F.when(n_chars >= guard_chars, js_distance(F.col("_classes"), F.col("_ref_classes")))
    by_word = F.when(F.col("n_words") >= guard_words, js_distance(F.col("_known"), F.col("_ref_known")))
    return (
        measured.join(reference, "_lang", "left")
        .withColumn("class_distance", by_class)
        .withColumn("word_distance", by_word)
        .drop("_ref_classes", "_ref_known")
    )


def _near(most_class: float, most_word: float) -> Column:
    near = F.coalesce(F.col("class_distance") <= most_class, F.lit(True))
    return near & F.coalesce(F.col("word_distance") <= most_word, F.lit(True))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = 16,
    least_words: int = 10,
    most_repeated: int = 20,
    guard_chars: int = 200,
    guard_words: int = 70,
    most_class_distance: float = 0.25,
    most_word_distance: float = 0.28,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``class_distance``, ``word_distance``.

    The base rules reject texts under ``least_words`` words or with over ``most_repeated``
    per cent of their words in repeated windows of five. A document that passes them is
    rejected if its class histogram (from ``guard_chars`` characters on) or its word
    histogram (from ``guard_words`` words on) is farther than allowed from its language's;
    below the guards the distances are null and count for the document.

    A null text is an empty text and fails the base rules. Null is a language of its own,
    as is every other value; a language whose documents all fail has no reference and
    gives null distances. Repeated rows, null or repeated ids are each their own document.
    Other columns are not read. An empty table gives an empty result.
    """
    # Written first, so the planner knows its size and broadcasts it only if it is small.
    words = materialize(common_words(docs, common, text_col, lang_col), "quality-words")
    measured = materialize(measures(docs, words, common, id_col, text_col, lang_col), "quality-measures")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    pooled = _judged(measured, measured.filter("not base_failed"), common, guard_chars, guard_words)
    near = _near(most_class_distance, most_word_distance)
    trimmed = pooled.filter(~F.col("base_failed") & near)
    judged = _judged(measured, trimmed, common, guard_chars, guard_words)
    return judged.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        "class_distance",
        "word_distance",
    )
