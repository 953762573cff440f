"""Word study and relations between passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(words: DataFrame, key: str, passage: list[str]) -> DataFrame:
    """(key, n, passages): occurrences and distinct passages."""
    return words.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(F.struct(*passage)).alias("passages"))


def modal_form(words: DataFrame, key: str, form: str) -> DataFrame:
    """(key, form, n): the most frequent spelling, the least on ties."""
    counts = words.groupBy(key, form).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), form)
    return counts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def coded_search(words: DataFrame, codes: DataFrame, code: str, wanted: Column, exceptions: DataFrame, key: str, group: str, limit: int) -> DataFrame:
    """Words whose code has the wanted properties, apart from words re-tagged by exceptions; at most limit groups, each with the totals of all.

    exceptions (key, code) give single words another code.
    """
    good = codes.where(wanted).select(code)
    usual = words.join(exceptions.select(key), key, "left_anti").join(good, code, "left_semi")
    changed = words.drop(code).join(exceptions.select(key, code), key).join(good, code, "left_semi")
    hits = usual.unionByName(changed.select(*usual.columns))
    per = hits.groupBy(group).agg(F.count("*").alias("n"))
    totals = per.agg(F.count("*").alias("total_groups"), F.sum("n").alias("total_words")).withColumn("one", F.lit(1))
    return per.orderBy(group).limit(limit).withColumn("one", F.lit(1)).join(totals, "one").drop("one")


def concordance(entries: DataFrame, words: DataFrame, passages: DataFrame, key: str, passage: list[str]) -> DataFrame:
    """Every occurrence of each entry with its passage."""
    return entries.join(words, key).join(passages, passage)


def ranked_references(edges: DataFrame, source: str, target: str, weight: str, limit: int) -> DataFrame:
    """The heaviest targets of each source; repeated edges add up."""
    total = edges.groupBy(source, target).agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(source).orderBy(F.desc("weight"), target)
    return total.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def parallels(members: DataFrame, group: str, member: str) -> DataFrame:
    """(member, other, shared): members of common groups with the number of groups they share, each pair once each way. Groups are small by nature (sections of parallel texts)."""
    a, b = members.select(group, F.col(member).alias("a")).distinct(), members.select(group, F.col(member).alias("b")).distinct()
    return a.join(b, group).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def relevance(links: DataFrame, article: str, weight: str, size: str) -> DataFrame:
    """(article, relevance): the square of the summed weights over a thousand times the article's links plus three thousand, in whole numbers."""
    sums = links.groupBy(article).agg(F.sum(weight).alias("w"), F.max(size).alias("n"))
    return sums.select(article, F.expr("w * w div (n * 1000 + 3000)").alias("relevance"))


def learned_lexicon(words: DataFrame, label: str, seen: int = 3, share: float = 0.9) -> DataFrame:
    """(token, label, n, share): tokens seen often enough whose occurrences mostly have one label."""
    counts = words.groupBy("token", label).agg(F.count("*").alias("c"))
    per = counts.groupBy("token").agg(F.sum("c").alias("n"), F.max(F.struct("c", label)).alias("m"))
    out = per.select("token", F.col(f"m.{label}").alias(label), "n", F.round(F.col("m.c") / F.col("n"), 6).alias("share"))
    return out.where((F.col("n") >= seen) & (F.col("share") >= share))


def contains_join(rows: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """Rows with each keyword that their text contains, whatever its case; keywords are a short list."""
    hits = F.filter(F.array(*(F.when(F.lower(F.col(text)).contains(k.lower()), F.lit(k)) for k in keywords)), lambda k: k.isNotNull())
    return rows.withColumn("keyword", F.explode(hits))


def any_of(rows: DataFrame, key: str, tags: DataFrame, wanted: list[str], invert: bool = False) -> DataFrame:
    """Rows that have (have none of) the wanted tags (key, tag)."""
    return rows.join(tags.where(F.col("tag").isin(wanted)).select(key), key, "left_anti" if invert else "left_semi")


def resolve_names(names: DataFrame, entities: DataFrame, shared: DataFrame) -> DataFrame:
    """(name, entity): by equal folded name and most shared passages; else the only bearer; else a close spelling.

    names (name, fold), entities (entity, fold), shared (name, entity, n). Close: the same first letter and at most a third of the letters changed.
    """
    exact = names.join(entities, "fold").join(shared, ["name", "entity"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bearers = exact.groupBy("name").agg(F.count("*").alias("bearers"), F.max_by("entity", F.struct("n", -F.col("entity"))).alias("entity"), F.max("n").alias("n"))
    sure = bearers.where("n > 0 or bearers = 1").select("name", "entity")
    rest = names.join(bearers, "name", "left_anti")
    near = rest.withColumn("first", F.substring("fold", 1, 1)).join(entities.select("entity", F.col("fold").alias("other"), F.substring("fold", 1, 1).alias("first")), "first")
    near = near.withColumn("d", F.levenshtein("fold", "other")).where("3 * d <= length(fold)")
    w = Window.partitionBy("name").orderBy("d", "entity")
    return sure.unionByName(near.withColumn("place", F.row_number().over(w)).where("place = 1").select("name", "entity"))


def union_counts(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, n): counts of several sources added."""
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("n").alias("n"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Parents with an ordered array of their children."""
    inner = [c for c in children.columns if c not in (key, order)]
    arrays = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *inner))).alias(name))
    return parents.join(arrays, key, "left")
