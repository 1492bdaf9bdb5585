"""Quality rules with thresholds that follow the data.

Counts of words, symbols, repeated lines and repeated words come from array
functions on each whole text. The thresholds are not fixed: mergeable quantile
sketches of every language and source give the usual range of each measure, and a
text is rejected if a measure lies far beyond it. A small group, or one whose limit is
far above that of its language or of all texts, takes the wider limit. Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from creel.llm import scratch

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A measure is far out beyond the upper quartile by so many times the distance from the median
#: to it, or by the least margin, whichever is more.
SPREADS = 10.0
#: The share of measures, and the least distance from the quartile that counts as far.
MARGINS = {"symbol_share": 0.02, "line_share": 0.30, "repeat_share": 0.25, "capital_share": 0.30, "mark_share": 0.15}
#: A group of fewer texts, or with a limit above so many times the wider one, takes the wider one.
LEAST_TEXTS, FAR_ABOVE = 20, 2.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def words(text: Column) -> Column:
    """Runs of other characters than space, tab, and line and page breaks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times, also within lambdas, that is worked out once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words within three-word windows that the text holds twice or more."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(ranked: Column) -> Column:
        last = F.size(ranked) - 1

        def same(x: Column, y: Column) -> Column:
            equal = x["h"] == y["h"]
            for k in (-1, 0, 1):  # and the words themselves, lest two windows share a hash
                equal = equal & (F.get(w, x["i"] + k) == F.get(w, y["i"] + k))
            return equal

        def twin(x: Column, i: Column) -> Column:
            return ((i > 0) & same(F.get(ranked, i - 1), x)) | ((i < last) & same(F.get(ranked, i + 1), x))

        places = F.transform(F.filter(ranked, twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    ranked = lambda found: F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    # windows with different hashes are different, so most short texts end here
    counted = let(hashes, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(let(ranked(found), covered)))
    return F.when(n < 4, 0).otherwise(counted).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of every whole text; a null text has no word, symbol or line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda signs: (F.length(text) - F.length(F.regexp_replace(text, signs, ""))).cast("long")
    return (
        docs.withColumn("__w", words(F.col(text_col)))
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
        .withColumn("n_symbols", without(f"[{SYMBOLS}]+"))
        .withColumn("__lines", lines)
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("__w")))
        .withColumn("__n_lines", F.size("__lines").cast("long"))
        .withColumn("__capitals", without("\\p{Lu}+"))
        .withColumn("__marks", without("[!?]+"))
        .drop("__w", "__lines")
    )


def shares(df: DataFrame) -> DataFrame:
    """The measures that are judged, all between 0 and 1 and higher for worse texts."""
    share = lambda a, b: F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(0.0))
    return (
        df.withColumn("symbol_share", share("n_symbols", "word_chars"))
        .withColumn("line_share", share("n_dup_lines", "__n_lines"))
        .withColumn("repeat_share", share("n_repeat_words", "n_words"))
        .withColumn("capital_share", share("__capitals", "word_chars"))
        .withColumn("mark_share", share("__marks", "n_words"))
    )


def thresholds(df: DataFrame, groups: list[str], accuracy: int = 1000) -> DataFrame:
    """Upper limit of every measure in each group, from quantile sketches.

    percentile_approx keeps a sketch of bounded size for each group, built by every
    task for its own rows and merged after the shuffle, so a large group costs no
    more than a small one. The rows of all groups that share all but the last column
    make the next wider group, up to all rows. A group of fewer than LEAST_TEXTS texts
    takes the limits of the wider one, and so does a limit of more than FAR_ABOVE times
    the wider: there the upper quartile is itself that of texts unlike the others. Only
    the limits of all rows have nothing to be held against.
    """
    sketched = [F.percentile_approx(m, [0.5, 0.75], accuracy).alias(m) for m in MARGINS]
    found = df.rollup(*groups).agg(F.grouping_id().alias("__level"), F.count(next(iter(MARGINS))).alias("__n"), *sketched)
    far = lambda m, least: F.col(m)[1] + F.greatest(SPREADS * (F.col(m)[1] - F.col(m)[0]), F.lit(least))
    found = scratch.written(found.select(*groups, "__level", "__n", *[far(m, least).alias(f"max_{m}") for m, least in MARGINS.items()]))
    # a level is told by a set bit for each column, from the last on, that the group leaves open
    level = lambda k: found.where(F.col("__level") == (1 << len(groups) - k) - 1)
    limits = level(0).select([f"max_{m}" for m in MARGINS])
    for k in range(1, len(groups) + 1):
        wider = limits.withColumnsRenamed({c: f"__wide_{c}" for c in limits.columns})
        same = [F.col(g).eqNullSafe(F.col(f"__wide_{g}")) for g in groups[: k - 1]]
        both = level(k).join(wider, same) if same else level(k).crossJoin(wider)
        usable = lambda c: (F.col("__n") >= LEAST_TEXTS) & (F.col(c) <= FAR_ABOVE * F.col(f"__wide_{c}"))
        chosen = [F.when(usable(c), F.col(c)).otherwise(F.col(f"__wide_{c}")).alias(c) for c in (f"max_{m}" for m in MARGINS)]
        limits = both.select(*groups[:k], *chosen)
    return limits


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Columns of docs (all, or those in `carry`) as one column `row`, with counts, base_failed and kept; needs no unique id.

    base_failed: fewer than 50 words, or over half of the words in repeated windows.
    kept: not base_failed, and no measure above its limit for the language and
    source. Texts that fail the base rules have no part in the limits. A null language or source is a group like any other. A null or
    empty text fails. Equal rows get equal verdicts; an empty table gives no rows. Columns
    of docs may have any names, those of the counts too: they stay within `row`.

    The counts are written once, since the limits and the verdicts both read them.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    apart = docs.select(own.alias("row"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__l"), F.col(source_col).alias("__s"))
    rows = shares(measured(apart, "__text")).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    rows = scratch.written(rows.select("__l", "__s", "row", *COUNTS, *MARGINS, "base_failed"))
    learned = rows.select("__l", "__s", *[F.when(~F.col("base_failed"), F.col(m)).alias(m) for m in MARGINS])
    limits = thresholds(learned, ["__l", "__s"]).withColumnsRenamed({"__l": "__lang", "__s": "__source"})
    same = F.col("__l").eqNullSafe(F.col("__lang")) & F.col("__s").eqNullSafe(F.col("__source"))
    over = F.greatest(*[F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False)) for m in MARGINS])
    out = rows.join(limits, same, "left").withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~over))
    return out.select("row", *COUNTS, *MARGINS, "base_failed", "kept")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdicts of every whole text, one row for each row of docs; see `judged`.

    Columns of docs other than these four are ignored; a null id stays null.
    """
    out = judged(docs, text_col, lang_col, source_col, [id_col])
    return out.select(F.col("row")[id_col].alias(id_col), *COUNTS, "base_failed", "kept", *MARGINS)
