"""URL filters: host and path rules, and a logistic regression on hashed n-grams for the rest.

The URLs that a rule decides are a labelled table. Of it a small bounded part trains
a logistic regression on hashed character n-grams of host and path, which judges the
URLs that no rule fits. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from creel.llm.quality_rules import let

DIMENSIONS = 2048
SAMPLE = 1000
GRAM = 4
STEPS = 12
RATE, L2 = 4.0, 0.001
ALLOW, BLOCK = "allow", "block"
RULES = {"com/": ALLOW, "example.com/en/": BLOCK, "www.example.com/en/": ALLOW, "net/es/": BLOCK, "net/fr/": BLOCK}


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark or hash; A-Z lowered; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_col: Column, path_col: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that begins with the rule's."""
    out = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, at, rest = text.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(at + rest)
        out = F.when(fits, text).otherwise(out)
    return out


def grams(host_col: Column, path_col: Column, size: int = GRAM, dimensions: int = DIMENSIONS) -> Column:
    """Distinct hashed n-grams of host and path; a shorter text is one n-gram."""

    def of(text: Column, kind: str) -> Column:
        def parts(marked: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - size + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(marked, i, F.lit(size))), F.lit(dimensions)).cast("int"))

        return let(F.concat(F.lit("^"), text, F.lit("$")), parts)

    return F.array_distinct(F.concat(of(host_col, "host"), of(path_col, "path")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def margin(gram_col: Column, weights: list[float], bias: float) -> Column:
    """The sum of the weights of the n-grams; the weights are a constant of bounded length."""
    held = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")  # one constant, folded by the optimizer
    return let(held, lambda w: F.aggregate(gram_col, F.lit(float(bias)), lambda acc, i: acc + F.get(w, i)))


def fit(labelled: DataFrame, gram_col: str, label_col: str, dimensions: int = DIMENSIONS, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias by gradient steps over the labelled rows, each step one aggregation.

    A step sends one number for each dimension to the driver, whatever the rows. The
    gradients are scaled by the usual length of a coordinate's past ones.
    """
    weights, bias = [0.0] * dimensions, 0.0
    past = [1e-6] * (dimensions + 1)
    n = labelled.count()
    if not n:
        return weights, bias
    for _ in range(steps):
        off = labelled.select(gram_col, (sigmoid(margin(F.col(gram_col), weights, bias)) - F.col(label_col)).alias("off"))
        rows = off.select(F.explode(F.concat(F.col(gram_col), F.array(F.lit(dimensions)))).alias("at"), "off").groupBy("at").agg(F.sum("off").alias("g")).collect()
        for at, g in rows:
            g = g / n + (L2 * weights[at] if at < dimensions else 0.0)
            past[at] += g * g
            change = RATE * g / (past[at] ** 0.5) / (steps**0.5)
            if at < dimensions:
                weights[at] -= change
            else:
                bias -= change
    return weights, bias


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Mapping[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Host, path, rule and verdict of every URL.

    Returns one row for each row of pages: the id, host, path, rule (null if none
    fits), verdict and score, the model's probability that the URL is allowed. The
    model learns from at most `sample` distinct URLs of each verdict, those with the
    smallest hashes, among the URLs that a rule decides. Without such URLs it scores
    0.5, which allows. A null URL, or one without ://, has an empty host and path.
    Repeated rows are judged each; a null id stays null; an empty table gives no
    rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("__id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    decided = rows.where(F.col("rule").isNotNull()).select("host", "path", (verdicts[F.col("rule")] == ALLOW).cast("int").alias("label"))
    parts = [decided.where(F.col("label") == v).distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample) for v in (0, 1)]
    few = parts[0].union(parts[1]).select("label", grams(F.col("host"), F.col("path")).alias("grams"))
    few = pages.sparkSession.createDataFrame(few.collect(), few.schema)  # at most 2 * sample rows
    weights, bias = fit(few, "grams", "label")
    rows = rows.withColumn("score", sigmoid(margin(grams(F.col("host"), F.col("path")), weights, bias)))
    verdict = F.coalesce(verdicts[F.col("rule")], F.when(F.col("score") >= 0.5, ALLOW).otherwise(BLOCK))
    return rows.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
