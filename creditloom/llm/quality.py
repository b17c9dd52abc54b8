"""Quality rules with a divergence test, in DataFrame expressions only.

The base rules count words, symbols, repeated lines and repeated 8-word
windows inside each text. The divergence test compares two histograms of a
document with references of its language by Jensen-Shannon distance (base 2,
0 to 1): the classes of its characters, and its common words (one bucket for
all others). References come from all documents. Documents too short for a
histogram to mean anything are not judged by it (minimum lengths).

Every language has its own reference, whatever its share of the documents;
those without a language are one more. A histogram of a reference that is too
small to mean anything (minimum sizes) judges no document. A reference word is
any word, of whatever length, with at least the share ``WORD_SHARE`` of the words
of its language, so a reference has at most 1 / WORD_SHARE words. The references are a stored table
of a row a language, joined on it: Spark broadcasts it while it is small, and
else deals out by language, where adaptive execution splits the common ones.

Everything about one text is worked out inside its row: no row meets another
but in the counts of the references, which are summed before they are shuffled.
One pass over the texts writes their measures and lower-cased words, which the
references and the distances read.

Rows: null text has no words (counts 0, base_failed); repeated rows and equal
ids give a row each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.session import cut_lineage

BLANKS = "[\\x20\\x09-\\x0D]"
WINDOW = 8
#: Character classes in the order in which they are taken out of the text; what is left is the last class.
CLASSES = {"lower": "[a-z]+", "blank": "[\\x20\\x09-\\x0D]+", "upper": "[A-Z]+", "letter": "\\p{L}+", "stop": "[.,;:'\"()?-]+", "digit": "[0-9]+"}
WORD_SHARE = 0.01

MIN_CHARS = 200
MIN_WORDS = 40
MIN_REFERENCE_CHARS = 100 * MIN_CHARS
MIN_REFERENCE_WORDS = 100 * MIN_WORDS
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.45


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS + "+"), "")


def class_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``classes``, the characters of each class: one class after another is
    taken out of the text, so each pass reads what the ones before have left."""
    out, at, sizes = docs, text, [F.char_length(text)]
    for i, pattern in enumerate(CLASSES.values()):
        out = out.withColumn(f"__t{i}", F.regexp_replace(F.col(at), pattern, ""))
        at = f"__t{i}"
        sizes.append(F.char_length(at))
    counts = [(a - b).cast("double") for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    return out.withColumn("classes", F.array(*counts, sizes[-1].cast("double"))).drop(*(f"__t{i}" for i in range(len(CLASSES))))


def repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs again in the same text."""

    def places(s: Column) -> Column:
        twice = lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"])
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(twice(j), F.lit(False))), lambda j: F.get(s, j)["i"]))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    covered = let(ordered, lambda s: F.aggregate(places(s), start, step)["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to (text, ...)."""
    d = docs.withColumn("words", words_of(F.col("text"))).withColumn("__lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = d.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    h = F.col("__h")
    # a window of 2, 4, 8 words is two neighbouring ones of half its length
    for step in (1, 2, 4):
        n = F.greatest(F.size(h) - step, F.lit(0))
        d = d.withColumn("__h", F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumnRenamed("__h", "__windows")
    d = d.select(
        "*",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("__windows")).cast("bigint").alias("n_repeat_words"),
    ).drop("__lines", "__windows")
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def word_counts(measured: DataFrame) -> DataFrame:
    """(lang, key, n): every word of the lines, counted over all documents in one scan."""
    words = measured.select("lang", F.explode(F.split("__line", " ")).alias("key")).where("key <> ''")
    return words.groupBy("lang", "key").agg(F.count(F.lit(1)).cast("double").alias("n"))


def references(measured: DataFrame) -> DataFrame:
    """(ref, ref_chars, ref_words, ref_shares), a stored row for every language and for null: shares of
    the classes, common words, and shares of these and of all others; null where too small."""
    chars = F.array(*[F.sum(F.col("classes")[i]) for i in range(len(CLASSES) + 1)])
    sums = cut_lineage(measured.groupBy(F.col("lang").alias("ref")).agg(F.sum("n_words").cast("double").alias("__words"), chars.alias("__chars")))
    common = word_counts(measured).join(sums, F.col("lang").eqNullSafe(F.col("ref"))).where(F.col("n") >= WORD_SHARE * F.col("__words"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n") / F.col("__words")).alias("share"), "key")))
    common = common.groupBy("lang").agg(listed.alias("__common"))
    table = sums.join(common, F.col("lang").eqNullSafe(F.col("ref")), "left").withColumn("__common", F.coalesce("__common", F.array().cast("array<struct<share:double,key:string>>")))
    shares = F.transform("__common", lambda x: -x["share"])
    rest = F.greatest(F.lit(0.0), 1.0 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))
    enough = {"ref_chars": F.aggregate("__chars", F.lit(0.0), lambda a, x: a + x) >= MIN_REFERENCE_CHARS, "ref_words": F.col("__words") >= MIN_REFERENCE_WORDS}
    return cut_lineage(
        table.select(
            "ref",
            F.when(enough["ref_chars"], _shares(F.col("__chars"))).alias("ref_chars"),
            F.when(enough["ref_words"], F.col("__common")["key"]).alias("ref_words"),
            F.when(enough["ref_words"], F.concat(shares, F.array(rest))).alias("ref_shares"),
        )
    )


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The base columns, both distances (null below the minimum lengths and sizes) and ``kept`` of every document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__raw"), F.col(lang_col).cast("string").alias("lang"), *[c for c in keep if c not in (id_col, text_col, lang_col)])
    d = class_counts(base_rules(d.withColumn("text", F.coalesce("__raw", F.lit("")))))
    d = d.withColumn("__line", F.lower(F.array_join("words", " "))).withColumn("__length", F.char_length("text")).drop("__raw", "text", "words")
    # both the references and the distances read what one pass over the texts has written
    d = cut_lineage(d, "zstd")
    d = d.join(references(d), F.col("lang").eqNullSafe(F.col("ref")), "left")
    # every word stands between blanks of its own, so what a replacement takes away counts the word
    # (``let``: worked out once a document, not once a reference word)
    taken = lambda line, w: F.octet_length(line) - F.octet_length(F.replace(line, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
    line = F.concat(F.lit(" "), F.replace("__line", F.lit(" "), F.lit("  ")), F.lit(" "))
    number = let(line, lambda x: F.transform("ref_words", lambda w: taken(x, w) / (F.octet_length(w) + 2)))
    d = d.withColumn("__hits", number)
    d = d.withColumn("__counts", F.concat("__hits", F.array(F.col("n_words") - F.aggregate("__hits", F.lit(0.0), lambda a, x: a + x))))
    distances = {"char_distance": (js_distance(_shares(F.col("classes")), F.col("ref_chars")), (F.col("__length") >= MIN_CHARS) & F.col("ref_chars").isNotNull()), "word_distance": (js_distance(_shares(F.col("__counts")), F.col("ref_shares")), (F.col("n_words") >= MIN_WORDS) & F.col("ref_words").isNotNull())}
    d = d.select("*", *[F.when(long, value).alias(name) for name, (value, long) in distances.items()])
    diverges = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return d.select("doc_id", *names, (~F.col("base_failed") & ~diverges).alias("kept"), "char_distance", "word_distance", *[c for c in keep if c not in (id_col, text_col, lang_col)])
