"""Quality rules: base counts, then distribution divergence against language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, let, settle, words_of

#: Frequent function words of four languages (public knowledge); their shares form the common-word histogram.
COMMON_WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which this you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Disjoint character classes of the class histogram; what is left over counts as "other".
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "blank": r"\s", "punct": r"\p{P}", "symbol": r"\p{S}"}
MIN_WORDS, MIN_REFERENCE_WORDS, MAX_LANGUAGES = 50, 2000, 10_000
#: Set by both error rates on the labelled rows (README). A text without any common word has a distance of about 0.39 to 0.40,
#: so a higher word limit rejects nothing.
CLASS_LIMIT, WORD_LIMIT = 0.25, 0.34


def _sum(xs: Column, zero=0) -> Column:
    return F.aggregate(xs, F.lit(zero), lambda a, x: a + x)


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in words.

    Windows are compared by a 64-bit hash first; only if some hash repeats are those windows compared as text, so a
    hash collision never changes the result.
    """
    n = F.size(words)

    def text_of(i):
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def twins(rows):
        """The positions i of those of the sorted structs (v, i) whose v equals a neighbour's."""
        hit = F.filter(rows, lambda x, k: F.coalesce(F.get(rows, k - 1)["v"] == x["v"], F.lit(False)) | F.coalesce(F.get(rows, k + 1)["v"] == x["v"], F.lit(False)))
        return F.transform(hit, lambda x: x["i"])

    def covered(starts):
        return _sum(F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3)))))

    def exact(hashes):
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("v"), i.alias("i"))))
        maybe = let(rows, twins)
        same = let(F.sort_array(F.transform(maybe, lambda i: F.struct(text_of(i).alias("v"), i.alias("i")))), twins)
        return let(F.sort_array(same), covered)

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))
    return F.when(n < 4, F.lit(0)).otherwise(found).cast("long")


def duplicate_lines(text: Column) -> Column:
    """How many \\n-split lines hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def common_histogram(text: Column) -> Column:
    """array<struct<word, n>> of the common words in text, lower-cased and parted at anything but letters."""
    tokens = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " ")
    common = F.sort_array(F.filter(tokens, lambda x: x.isin(VOCABULARY)))

    def runs(c):
        at = F.transform(F.array_distinct(c), lambda u: F.struct(u.alias("word"), F.array_position(c, u).alias("p")))
        return let(at, lambda a: F.transform(a, lambda x, k: F.struct(x["word"].alias("word"), (F.coalesce(F.get(a, k + 1)["p"], F.size(c) + F.lit(1)) - x["p"]).cast("long").alias("n"))))

    return let(common, runs)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One narrow row per document: id, language, base counts, base verdict and both histograms."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("language"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), words_of(F.col(text_col)).alias("w"))
    size = {k: F.length(F.regexp_replace("t", f"[^{v}]+", "")) for k, v in CLASSES.items()}
    rows = rows.select(
        "id",
        "language",
        F.length("t").cast("long").alias("n_code_points"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("t")).alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.array(*[v.cast("long") for v in size.values()]).alias("classes"),
        common_histogram(F.col("t")).alias("common"),
    )
    rows = rows.withColumn("classes", F.concat("classes", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_code_points") - _sum(F.col("classes"), F.lit(0).cast("long"))))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def references(feats: DataFrame) -> DataFrame:
    """One row per language: class shares and common-word shares over all its documents that pass the base rules."""
    good = feats.where("NOT base_failed")
    k = len(CLASSES) + 1
    sums = good.groupBy("language").agg(F.sum("n_words").alias("total"), *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(k)])
    whole = sum((F.col(f"c{i}") for i in range(k)), F.lit(0))
    shares = sums.select("language", "total", F.array(*[F.col(f"c{i}") / F.greatest(whole, F.lit(1)) for i in range(k)]).alias("class_shares"))
    counts = good.select("language", F.explode("common").alias("x")).groupBy("language", F.col("x.word").alias("word")).agg(F.sum("x.n").alias("n"))
    # at most len(VOCABULARY) rows a language, so the map below is bounded
    maps = counts.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    return shares.join(maps, "language", "left").withColumn("word_shares", F.transform_values(F.coalesce("counts", F.create_map().cast("map<string,bigint>")), lambda _, v: v / F.greatest(F.col("total"), F.lit(1)))).drop("counts")


def _part(p: Column, q: Column) -> Column:
    """What one category adds to twice the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """A verdict per document (one row for each input row, repeated ids included).

    Base rules: under 50 words, or more than half of the words in repeated 3-word windows, fails. The others are
    compared with their language's reference (shares over all passing documents of that language): a Jensen-Shannon
    distance above class_limit between character classes, or above word_limit between common-word shares, rejects.
    Guards: no comparison where the language has under MIN_REFERENCE_WORDS words. Null text counts as empty (fails the
    base rules); null language is a language of its own; an empty table gives an empty result. Other columns are not read.
    """
    feats = settle(features(docs, id_col, text_col, lang_col), "quality")
    ref = broadcast_within(settle(references(feats), "reference"), MAX_LANGUAGES)
    joined = feats.join(ref, "language", "left")
    p_class = F.transform("classes", lambda c: c / F.greatest(F.col("n_code_points"), F.lit(1)))
    class_d = _distance(_sum(F.zip_with(p_class, F.col("class_shares"), _part), 0.0))
    n = F.greatest(F.col("n_words"), F.lit(1))
    seen = F.transform("common", lambda x: F.struct((x["n"] / n).alias("p"), F.coalesce(F.col("word_shares")[x["word"]], F.lit(0.0)).alias("q")))

    def word_distance(s):
        p_all, q_seen = _sum(F.transform(s, lambda x: x["p"]), 0.0), _sum(F.transform(s, lambda x: x["q"]), 0.0)
        q_all = _sum(F.map_values("word_shares"), 0.0)
        rest = _part(F.greatest(F.lit(0.0), 1 - p_all), F.greatest(F.lit(0.0), 1 - q_all))
        return _distance(_sum(F.transform(s, lambda x: _part(x["p"], x["q"])), 0.0) + (q_all - q_seen) + rest)

    out = joined.withColumn("class_distance", class_d).withColumn("word_distance", let(seen, word_distance))
    far = (F.col("total") >= MIN_REFERENCE_WORDS) & ((F.col("class_distance") > class_limit) | (F.col("word_distance") > word_limit))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "word_distance",
    )
