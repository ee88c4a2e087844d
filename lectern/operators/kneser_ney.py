"""Estimation of n-gram models: interpolated modified Kneser-Ney, from counts alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.scratch import store

#: Marks of a sentence's ends and of unknown words (fixed values), discounts where counts are too few to estimate them.
BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"
FALLBACK = (0.5, 1.0, 1.5)


def _first(gram: str) -> Column:
    return F.substring_index(gram, " ", 1)


def _head(gram: str) -> Column:
    """All words but the last; empty for a single word."""
    return F.regexp_replace(gram, " ?[^ ]+$", "")


def _tail(gram: str) -> Column:
    """All words but the first; empty for a single word."""
    return F.regexp_replace(gram, "^[^ ]+ ?", "")


def gram_counts(sentences: DataFrame, words: Column, order: int) -> DataFrame:
    """(ord, gram, n) of all n-grams up to order, with the marks of both ends; empty words and null sentences are left out."""
    w = sentences.select(F.concat(F.array(F.lit(BEGIN)), F.filter(words, lambda x: x != ""), F.array(F.lit(END))).alias("w")).where("w is not null")

    def of(n: int) -> Column:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("ord"), F.array_join(F.slice("w", i, n), " ").alias("gram")))

    return w.select(F.inline(F.concat(*[of(n) for n in range(1, order + 1)]))).groupBy("ord", "gram").agg(F.count("*").alias("n"))


def _discounts(adjusted: DataFrame) -> DataFrame:
    """(ord, d1, d2, d3) from how many n-grams of an order have the counts 1, 2, 3 and 4."""
    t = adjusted.groupBy("ord").agg(*[F.count_if(F.col("a") == k).cast("double").alias(f"t{k}") for k in range(1, 5)])
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    y = over(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    d = [F.lit(float(k)) - (k + 1) * y * over(F.col(f"t{k + 1}"), F.col(f"t{k}")) for k in (1, 2, 3)]
    fine = F.coalesce((F.least("t1", "t2", "t3", "t4") > 0) & (F.least(*d) >= 0) & (d[0] <= 1) & (d[1] <= 2) & (d[2] <= 3), F.lit(False))
    return t.select("ord", *[F.when(fine, x).otherwise(F.lit(f)).alias(f"d{k}") for k, (x, f) in enumerate(zip(d, FALLBACK, strict=True), 1)])


def estimate(counts: DataFrame, order: int, prune: tuple[int, ...]) -> DataFrame:
    """(ord, gram, logp, backoff), decimal logarithms, of the counts of gram_counts.

    Below the highest order, and but for n-grams that begin a sentence, what counts is how many different words come
    before an n-gram. N-grams that occur no more often than their order's threshold are left out; their mass and the
    discounts go to the next shorter context. The unknown word has the share of one word of the vocabulary. Every
    order is two joins on its n-grams' strings, and nothing but sums of an order is broadcast.
    """
    raw = store(counts)
    longer = raw.where("ord > 1").select((F.col("ord") - 1).alias("ord"), _tail("gram").alias("gram")).groupBy("ord", "gram").agg(F.count("*").alias("a"))
    own = raw.where((F.col("ord") == order) | (_first("gram") == BEGIN)).where(F.col("gram") != BEGIN).select("ord", "gram", F.col("n").alias("a"))
    adjusted = longer.union(own)
    least = F.element_at(F.array(*map(F.lit, prune)), F.col("ord"))
    known = raw.select("ord", "gram", (F.col("n") > least).alias("kept"))
    adjusted = store(adjusted.join(known, ["ord", "gram"]))
    by = F.broadcast(_discounts(adjusted))  # a row an order
    discount = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = store(adjusted.join(by, "ord").select("ord", "gram", "kept", F.col("a").cast("double").alias("a"), discount.alias("d"), _head("gram").alias("head")))
    contexts = grams.groupBy("ord", "head").agg((F.sum(F.when(F.col("kept"), F.col("d")).otherwise(F.col("a"))) / F.sum("a")).alias("gamma"), F.sum("a").alias("total"))
    contexts = store(contexts)
    share = contexts.where("ord = 1").join(F.broadcast(grams.where("ord = 1").agg((F.count("*") + 1).alias("words")))).select((F.col("gamma") / F.col("words")).alias("least"))
    own_part = grams.where("kept").join(contexts, ["ord", "head"]).select("ord", "gram", ((F.col("a") - F.col("d")) / F.col("total")).alias("u"), "gamma")
    own_part = store(own_part)
    p = own_part.where("ord = 1").join(F.broadcast(share)).select("gram", (F.col("u") + F.col("least")).alias("p"))
    levels = [store(p.union(share.select(F.lit(UNKNOWN).alias("gram"), F.col("least").alias("p"))))]
    for n in range(2, order + 1):
        shorter = levels[-1].select(F.col("gram").alias("tail"), F.col("p").alias("q"))
        here = own_part.where(F.col("ord") == n).withColumn("tail", _tail("gram")).join(shorter, "tail")
        levels.append(store(here.select("gram", (F.col("u") + F.col("gamma") * F.col("q")).alias("p"))))
    out = None
    for n, level in enumerate(levels, 1):
        rows = level.select("gram", F.log10("p").alias("logp"))
        if n == 1:
            rows = rows.union(rows.sparkSession.createDataFrame([(BEGIN, 0.0)], rows.schema))
        back = contexts.where(F.col("ord") == n + 1).select(F.col("head").alias("gram"), F.log10("gamma").alias("backoff"))
        rows = rows.join(back, "gram", "left").select(F.lit(n).alias("ord"), "gram", "logp", F.coalesce("backoff", F.lit(0.0)).alias("backoff"))
        out = rows if out is None else out.union(rows)
    return out


def arpa_lines(lm: DataFrame, order: int) -> DataFrame:
    """(section, gram, line) of an ARPA file in its order: the counts, then a section an order, and the end."""
    spark = lm.sparkSession
    number = lambda c: F.col(c).cast("string")  # noqa: E731  shortest digits that give the same number
    body = lm.select(F.col("ord").alias("section"), F.lit(1).alias("part"), "gram", F.concat_ws("\t", number("logp"), "gram", F.when(F.col("ord") < order, number("backoff"))).alias("line"))
    sizes = lm.groupBy("ord").count().select(F.lit(0).alias("section"), F.lit(1).alias("part"), F.col("ord").cast("string").alias("gram"), F.format_string("ngram %d=%d", "ord", "count").alias("line"))
    heads = [(0, 0, "", "\\data\\"), *[(n, 0, "", f"\n\\{n}-grams:") for n in range(1, order + 1)], (order + 1, 0, "", "\n\\end\\")]
    fixed = spark.createDataFrame(heads, "section int, part int, gram string, line string")
    return fixed.union(sizes).union(body).orderBy("section", "part", "gram").select("section", "gram", "line")
