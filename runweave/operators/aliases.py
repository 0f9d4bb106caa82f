"""Names matched with the candidates that share most words with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that stand for each other. Fixed values.
SYNONYMS = {"coefficient": ["stiffness"], "stiffness": ["coefficient"]}
#: Candidates with a word, in one part of it.
PART = 1_000


def tokens(text: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """The distinct words of a name: lower case, cut at blanks, _ and -, with the singular of words of over three letters in s, and with synonyms."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[_-]", " "), r"\s+"), lambda w: w != "")
    singular = F.transform(F.filter(words, lambda w: w.endswith("s") & (F.length(w) > 3)), lambda w: F.substring(w, 1, F.length(w) - 1))
    both = F.array_distinct(F.concat(words, singular))
    known = SYNONYMS if synonyms is None else synonyms
    if not known:
        return both
    table = F.create_map(*(x for word, others in known.items() for x in (F.lit(word), F.array(*map(F.lit, others)))))
    more = F.flatten(F.filter(F.transform(both, lambda w: F.element_at(table, w)), lambda x: x.isNotNull()))
    return F.array_distinct(F.concat(both, more))


def alias_match(names: DataFrame, candidates: DataFrame, keys: list[str], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, name, candidate, shared, ambiguous) of each name (keys, name) that shares a word with a candidate (keys, candidate, place[, more]) of its keys.

    The candidate that shares most words wins; of equal ones that with most words of its own, of these the first by
    place. A match is ambiguous, and its candidate null, if another that shares as many words comes after it. `more` is
    a further text of the candidate whose words count, too. Names that are candidates themselves need no match.

    Names of the same words are matched once. Words lead to candidates through an inverted index; that of a frequent
    word is cut into parts, so no word is a hot key.
    """
    own = candidates.select(*keys, "candidate", "place", F.array_union(tokens(F.col("candidate"), synonyms), tokens(F.col("more"), synonyms) if "more" in candidates.columns else F.array().cast("array<string>")).alias("words"))
    asked = names.select(*keys, "name").distinct().join(candidates.select(*keys, F.col("candidate").alias("name")), [*keys, "name"], "left_anti")
    asked = asked.withColumn("words", F.array_sort(tokens(F.col("name"), synonyms)))
    sets = asked.select(*keys, "words").distinct()
    index = own.select(*keys, F.explode("words").alias("word"), "candidate", "place", F.size("words").alias("own"))
    parts = index.groupBy(*keys, "word").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    index = index.join(parts, [*keys, "word"]).withColumn("part", F.pmod(F.xxhash64("candidate"), F.col("parts")).cast("int")).drop("parts")
    sought = sets.select(*keys, "words", F.explode("words").alias("word")).join(parts, [*keys, "word"])
    sought = sought.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    shared = sought.join(index, [*keys, "word", "part"]).groupBy(*keys, "words", "candidate", "place", "own").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.withColumn("most", F.max("shared").over(Window.partitionBy(*keys, "words"))).where("shared = most")
    picked = best.groupBy(*keys, "words").agg(F.max("shared").alias("shared"), F.min(F.struct((-F.col("own")).alias("own"), "place", "candidate")).alias("first"), F.max("place").alias("last"))
    found = picked.withColumn("ambiguous", F.col("last") > F.col("first.place"))
    return asked.join(found, [*keys, "words"]).select(*keys, "name", F.when(~F.col("ambiguous"), F.col("first.candidate")).alias("candidate"), "shared", "ambiguous")
