"""Text functions as columns, and the few that need Python as vectorized functions over distinct words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import stem

TOKEN = r"([\p{L}\p{N}]+)"

# Elements that separate words when markup goes; all others join what they touch.
BLOCK_TAGS = ["p", "div", "br", "hr", "li", "ul", "ol", "blockquote", "pre", "table", "tr", "td", "th", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"]
# Letters with marks in the Latin-1 range and their plain letters, for folding inside column expressions.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Words that a gloss may start with and that do not count, unless nothing else is left.
GLOSS_FUNCTION_WORDS = ["the", "a", "an", "of", "in", "into", "unto", "to", "by", "for", "at", "as", "with", "and", "that", "this", "these", "those", "which"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def fold(text: Column) -> Column:
    """Text without the marks of Latin-1 letters."""
    return F.translate(text, _MARKED, _PLAIN)


def html_text(html: Column) -> Column:
    """The words of a page: scripts and styles go (to the end, if they are not closed), block elements separate, others join, entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def word_count(html: Column) -> Column:
    """Words with a letter or digit once every tag is a space."""
    plain = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"&[A-Za-z0-9#]+;", " ")
    return F.size(F.filter(F.split(F.trim(plain), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def escape_html(text: Column) -> Column:
    """& < > as entities; match marks stay."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sql_date(text: Column) -> Column:
    """Digits and dashes only."""
    return F.regexp_replace(text, r"[^0-9-]", "")


def normalize_gloss(gloss: Column) -> Column:
    """A gloss in lower case without punctuation (apostrophes and hyphens stay) and leading function words, unless it has no others."""
    words = F.filter(F.split(F.regexp_replace(F.lower(gloss), r"[^\p{L}\p{N}'-]+", " "), " +"), lambda w: w != "")
    light = F.array(*map(F.lit, GLOSS_FUNCTION_WORDS))
    first = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when(~F.array_contains(light, w), i)), lambda i: i.isNotNull())), F.lit(0))
    return F.array_join(F.slice(words, first + 1, F.greatest(F.size(words), F.lit(1))), " ")


def strongs_number(text: Column) -> Column:
    """G or H and a number without leading zeros; null if it is none (1 to 5 digits)."""
    found = F.regexp_extract(F.upper(F.trim(text)), r"^([GH])0*([1-9][0-9]{0,4})$", 0)
    return F.when(found != "", F.regexp_replace(found, r"^([GH])0*", "$1"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_prefix(column: Column, prefix: str) -> Column:
    return column.startswith(prefix)


def bare_letters(word: str | None) -> str | None:
    """A word without accents, points and final forms, in lower case."""
    if word is None:
        return None
    out = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return out.replace("ς", "σ")


@F.pandas_udf(T.StringType())
def plain(words: pd.Series) -> pd.Series:
    return words.map(bare_letters)


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def over_distinct(df: DataFrame, column: str, function, name: str) -> DataFrame:
    """df with function(column) as name, computed once for each distinct value and joined back."""
    values = df.select(column).distinct().withColumn(name, function(F.col(column)))
    return df.join(values, [column], "left")


def register(spark: SparkSession) -> None:
    """The SQL functions of the engine: plain, stem and the table function find_references."""
    from .references import FindReferences

    spark.udf.register("plain", plain)
    spark.udf.register("stem", stemmed)
    spark.udtf.register("find_references", FindReferences)
