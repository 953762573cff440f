"""Ranked full-text retrieval: a parsed query as a lazy plan over postings.

The postings table holds a row for each (token, document) with the token's count and positions. A query filters
it by token (which reaches the scan, as postings are written sorted by token), and all terms of a
conjunction are intersected by one aggregate on the document, whatever their number. Ranking works
on ids; texts are joined after the top rows are known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .querylang import All, Any, Exact, Near, Phrase, Query, Term, Without, parse

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


@dataclass
class Index:
    """Postings (token, doc_id, tf, positions), sizes (doc_id, length) of the documents (doc_id, text, ...)."""

    docs: DataFrame
    postings: DataFrame
    sizes: DataFrame

    @classmethod
    def over(cls, docs: DataFrame, text: str = "text") -> Index:
        """An index that is computed as it is asked: token filters apply before anything is shuffled."""
        own = docs.select("doc_id", tokens(F.col(text)).alias("ts"))
        each = own.select("doc_id", F.posexplode("ts").alias("pos", "token"))
        # Queries that need no positions do not gather them: unused aggregates are pruned.
        postings = each.groupBy("token", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
        return cls(docs, postings, own.select("doc_id", F.size("ts").alias("length")))

    @classmethod
    def build(cls, docs: DataFrame, path: str, text: str = "text") -> Index:
        """Writes postings, sorted by token, and sizes under path, and reads them again."""
        made = cls.over(docs, text)
        made.postings.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        made.sizes.write.mode("overwrite").parquet(f"{path}/sizes")
        return cls.load(docs, path)

    @classmethod
    def load(cls, docs: DataFrame, path: str) -> Index:
        read = docs.sparkSession.read.parquet
        return cls(docs, read(f"{path}/postings"), read(f"{path}/sizes"))

    def vocabulary(self) -> DataFrame:
        """(token, n, docs): occurrences and documents of each token."""
        return self.postings.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


def words_in(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _is(term: Term) -> Column:
    word = "".join(words_in(term.word)) if len(words_in(term.word)) == 1 else term.word.lower()
    return F.col("token").startswith(word) if term.prefix else F.col("token") == word


def _phrase_starts(index: Index, words: list[str], prefix: bool = False) -> DataFrame:
    """(doc_id, start): where the words stand one after the other; the last may be a prefix."""
    tests = [F.col("token") == w for w in words]
    if prefix:
        tests[-1] = F.col("token").startswith(words[-1])
    hit = index.postings.where(reduce(lambda a, b: a | b, tests))
    place = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in enumerate(tests))), lambda k: k.isNotNull())
    spots = hit.select("doc_id", F.explode("positions").alias("pos"), place.alias("ks")).select("doc_id", "pos", F.explode("ks").alias("k"))
    return spots.groupBy("doc_id", (F.col("pos") - F.col("k")).alias("start")).agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(words)).select("doc_id", "start")


def matching(index: Index, node: object) -> DataFrame:
    """(doc_id): the documents that a tree of conditions holds for, each once."""
    match node:
        case Term() if len(words_in(node.word)) > 1:
            return _phrase_starts(index, words_in(node.word), node.prefix).select("doc_id").distinct()
        case Term():
            return index.postings.where(_is(node)).select("doc_id").distinct()
        case Phrase(text):
            return _phrase_starts(index, words_in(text)).select("doc_id").distinct()
        case Near(a, b, n):
            left, right = words_in(a)[0], words_in(b)[0]
            both = index.postings.where(F.col("token").isin(left, right)).groupBy("doc_id").agg(F.first(F.when(F.col("token") == left, F.col("positions")), ignorenulls=True).alias("a"), F.first(F.when(F.col("token") == right, F.col("positions")), ignorenulls=True).alias("b"))
            return both.where(F.exists("a", lambda x: F.exists("b", lambda y: (F.abs(x - y) <= n + 1) & (x != y)))).select("doc_id")
        case All(parts):
            marked = [matching(index, p).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
            return reduce(DataFrame.unionByName, marked).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).select("doc_id")
        case Any(parts):
            return reduce(DataFrame.unionByName, [matching(index, p) for p in parts]).distinct()
        case Without(keep, drop):
            return matching(index, keep).join(matching(index, drop), "doc_id", "left_anti")
    raise TypeError(node)


def leaves(node: object) -> list:
    """The conditions that a match is ranked by."""
    match node:
        case All(parts) | Any(parts):
            return [x for p in parts for x in leaves(p)]
        case Without(keep, _):
            return leaves(keep)
        case Near(a, b, _):
            return [Term(a), Term(b)]
        case None:
            return []
    return [node]


def frequencies(index: Index, node: object) -> DataFrame:
    """(doc_id, leaf, tf): occurrences of each ranked condition."""
    out = []
    for i, leaf in enumerate(leaves(node)):
        words = words_in(leaf.text if isinstance(leaf, Phrase) else leaf.word)
        if len(words) > 1 or isinstance(leaf, Phrase):
            tf = _phrase_starts(index, words).groupBy("doc_id").agg(F.count("*").alias("tf"))
        else:
            tf = index.postings.where(_is(leaf)).groupBy("doc_id").agg(F.sum("tf").alias("tf"))
        out.append(tf.select("doc_id", F.lit(i).alias("leaf"), F.col("tf").cast("long").alias("tf")))
    return reduce(DataFrame.unionByName, out)


def bm25(index: Index, node: object) -> DataFrame:
    """(doc_id, score) of the matching documents; lower is better. Statistics are of all documents."""
    tf = frequencies(index, node)
    stats = index.sizes.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    df = tf.groupBy("leaf").agg(F.count("*").alias("df"))
    # One row, and one row for each leaf of the query.
    weights = df.withColumn("one", F.lit(1)).join(stats.withColumn("one", F.lit(1)), "one")
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    rows = tf.join(matching(index, node), "doc_id", "left_semi").join(F.broadcast(weights.select("leaf", idf.alias("idf"), "mean")), "leaf").join(index.sizes, "doc_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("doc_id").agg(F.round(-F.sum(part), 6).alias("score"))


def exact_column(text: Column, exact: Exact) -> Column:
    """Whether a word stands in the text in this very form, by itself."""
    pattern = rf"(?<![\p{{L}}\p{{N}}]){re.escape(exact.word)}(?![\p{{L}}\p{{N}}])"
    return text.rlike(pattern if exact.cased else f"(?iu){pattern}")


def checked(ids: DataFrame, query: Query, docs: DataFrame) -> DataFrame:
    """What an index cannot test: exact forms and regular expressions, on the texts of the ids."""
    if not query.exact and not query.regex:
        return ids
    tests = [exact_column(F.col("text"), e) for e in query.exact] + ([F.col("text").rlike(query.regex)] if query.regex else [])
    keep = docs.where(reduce(lambda a, b: a & b, tests)).select("doc_id")
    return ids.join(keep, "doc_id", "left_semi")


def search(index: Index, text: str, limit: int = 20, prefix: bool = True, order: str = "rank") -> DataFrame:
    """The first rows of a search: doc_id and score, by rank or in the order of ids."""
    query = parse(text, prefix)
    if query.tree is None:
        found = checked(index.docs.select("doc_id").withColumn("score", F.lit(0.0)), query, index.docs) if query.regex else index.docs.select("doc_id").withColumn("score", F.lit(0.0)).limit(0)
    else:
        found = checked(bm25(index, query.tree), query, index.docs)
    return found.orderBy(*(["score", "doc_id"] if order == "rank" else ["doc_id"])).limit(limit)


def total(index: Index, text: str, prefix: bool = True) -> DataFrame:
    """(total): how many documents a search finds."""
    query = parse(text, prefix)
    return checked(matching(index, query.tree), query, index.docs).agg(F.count("*").alias("total"))


def facets(index: Index, text: str, columns: list[str], prefix: bool = True) -> DataFrame:
    """(facet, value, n): hits by the values of each column, in one pass."""
    query = parse(text, prefix)
    hits = index.docs.join(checked(matching(index, query.tree), query, index.docs), "doc_id", "left_semi")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return hits.select(each.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def federated(index: Index, text: str, shelf: str, each: int, prefix: bool = True) -> DataFrame:
    """The best rows of every shelf (a column of the documents), merged by rank."""
    query = parse(text, prefix)
    scored = checked(bm25(index, query.tree), query, index.docs).join(index.docs.select("doc_id", shelf), "doc_id")
    w = Window.partitionBy(shelf).orderBy("score", "doc_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each).select(shelf, "place", "doc_id", "score")


def highlight(text: Column, query: Query, start: str = "[", end: str = "]") -> Column:
    """The text with the query's words marked."""
    parts = []
    for leaf in leaves(query.tree):
        words = words_in(leaf.text if isinstance(leaf, Phrase) else leaf.word)
        body = r"[^\p{L}\p{N}]+".join(map(re.escape, words))
        parts.append(body + (r"[\p{L}\p{N}]*" if isinstance(leaf, Term) and leaf.prefix else ""))
    if not parts:
        return text
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({'|'.join(parts)})(?![\p{{L}}\p{{N}}])", f"{start}$1{end}")


def snippet(text: Column, query: Query, size: int = 12) -> Column:
    """Up to size words around the first hit, marked, with dots where text is left out."""
    marked = F.split(highlight(text, query), r"\s+")
    first = F.coalesce(F.array_min(F.filter(F.transform(marked, lambda w, i: F.when(w.contains("["), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(first - size // 3, F.lit(0))
    shown = F.array_join(F.slice(marked, start + 1, F.lit(size)), " ")
    return F.concat(F.when(start > 0, "…").otherwise(""), shown, F.when(F.size(marked) > start + size, "…").otherwise(""))


def quote(text: Column, words: list[str], radius: int = 80) -> Column:
    """A window around the longest word that stands in the text, cut to whole words."""
    low = F.lower(text)
    spots = [F.when(F.instr(low, w.lower()) > 0, F.instr(low, w.lower())) for w in sorted(words, key=len, reverse=True)]
    at = F.coalesce(*spots, F.lit(1))
    start = F.greatest(at - radius, F.lit(1))
    window = F.substring(text, start, F.lit(2 * radius))
    window = F.when(start > 1, F.concat(F.lit("…"), F.regexp_replace(window, r"^\S*\s+", ""))).otherwise(window)
    return F.when(F.length(text) >= start + 2 * radius, F.concat(F.regexp_replace(window, r"\s+\S*$", ""), F.lit("…"))).otherwise(window)


def suggest(vocabulary: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """The most frequent tokens that start with a prefix."""
    return vocabulary.where(F.col("token").startswith(prefix.lower())).orderBy(F.desc("n"), "token").limit(limit)


def did_you_mean(vocabulary: DataFrame, word: str, limit: int = 5) -> DataFrame:
    """(token, distance, n): frequent tokens within one edit of a short word, two of a longer one."""
    most = 1 if len(word) <= 4 else 2
    distance = F.levenshtein(F.col("token"), F.lit(word.lower()), most)
    near = vocabulary.where(F.length("token").between(len(word) - most, len(word) + most)).withColumn("distance", distance)
    return near.where((F.col("distance") > 0)).select("token", "distance", "n").orderBy("distance", F.desc("n"), "token").limit(limit)


def merged(lists: list[DataFrame], limit: int) -> DataFrame:
    """Ranked lists (id, score) as one: by score, ties by place in their list, then by list."""
    parts = []
    for i, rows in enumerate(lists):
        ranked = rows.orderBy("score", "id").limit(limit)
        parts.append(ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(i)).orderBy("score", "id"))).withColumn("list", F.lit(i)))
    return reduce(DataFrame.unionByName, parts).orderBy("score", "place", "list").limit(limit)


def tiered(lists: list[DataFrame]) -> DataFrame:
    """Rows (id, ...) of the first list that has them, with the number of the list."""
    marked = [d.withColumn("tier", F.lit(i)) for i, d in enumerate(lists)]
    both = reduce(DataFrame.unionByName, marked)
    return both.groupBy("id").agg(F.min("tier").alias("tier"))




def open_index(spark: SparkSession, docs_path: str, path: str) -> Index:
    return Index.load(spark.read.parquet(docs_path), path)
