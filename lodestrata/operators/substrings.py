"""Which texts contain which words, without comparing each with each.

Every word is looked up by the rarest of its grams, pieces of three characters or of its whole
length if it is shorter; only texts that hold that gram are compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct pieces of `size` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substr(text, at, size)))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, words: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """`texts` (text, ...) joined with the distinct `words` (word) that they contain, letters as they are.

    `scope` names columns of both sides that must be equal. Null and empty words match nothing, null
    texts contain nothing; repeated texts match each. A text comes once for a word, so the result is
    as large as the matches are many; what is compared beyond them is what the rarest gram lets through.
    """
    scope = scope or []
    wanted = words.where("word is not null and word != ''").select(*scope, "word").distinct()
    sizes = F.least(F.length("word"), F.lit(GRAM))
    word_grams = wanted.withColumn("gram", F.explode(_grams(F.col("word"), sizes)))
    # grams of the texts, of the sizes and in the scope that words ask for
    pieces = F.explode(F.flatten(F.array(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])))
    asked = word_grams.select(*scope, "gram").distinct()
    held = texts.where("text is not null").withColumn("gram", pieces).join(asked, [*scope, "gram"], "left_semi")
    counts = held.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    rarest = (
        word_grams.join(counts, [*scope, "gram"], "left")
        .groupBy(*scope, "word").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "gram")).alias("g"))
        .where("g.n > 0").select(*scope, "word", F.col("g.gram").alias("gram"))
    )
    return held.join(rarest, [*scope, "gram"]).where(F.contains("text", "word")).drop("gram")
