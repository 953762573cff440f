"""Readers: XML Bibles and commentaries, USFM, tab-separated tables, keyed JSON, record text, plain tables.

Parsers work on whole files (one row each) inside vectorized functions, so files are read in parallel;
table formats use Spark's own readers. A file that cannot be parsed gives no rows and is named in the
outcome, never an error of the job.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.references import book

VERSES = "file string, book int, chapter int, verse int, text string"
SAMPLE = 8192


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, content, sha256): whole files under path, also in folders below."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("path").alias("file"), "content", F.sha2("content", 256).alias("sha256"))


def parsed(found: DataFrame, parser: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that a parser finds in each file; the schema starts with the file."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    rows = list(parser(bytes(content).decode("utf-8-sig", "replace")))
                except (ET.ParseError, ValueError, KeyError):
                    rows = []
                if rows:
                    yield pd.DataFrame([(file, *r) for r in rows], columns=names)

    return found.select("file", "content").mapInPandas(run, schema)


def zefania(text: str) -> Iterator[tuple]:
    """Verses of an XML Bible: BIBLEBOOK bnumber, CHAPTER cnumber, VERS vnumber. Notes are left out."""
    for b in ET.fromstring(text).iter("BIBLEBOOK"):
        for c in b.iter("CHAPTER"):
            for v in c.iter("VERS"):
                words = "".join(_outside(v, {"NOTE", "XREF"}))
                yield int(b.get("bnumber")), int(c.get("cnumber")), int(v.get("vnumber")), re.sub(r"\s+", " ", words).strip()


def _outside(element: ET.Element, skipped: set[str]) -> Iterator[str]:
    yield element.text or ""
    for child in element:
        if child.tag not in skipped:
            yield from _outside(child, skipped)
        yield child.tail or ""


def usfm(text: str) -> Iterator[tuple]:
    """Verses of a USFM book: headings and footnotes go, words keep their text without attributes."""
    number = book(m[1]) if (m := re.search(r"\\id\s+(\w+)", text)) else None
    if number is None:
        return
    text = re.sub(r"\\(f|x|fe)\b.*?\\\1\*", "", text, flags=re.S)
    text = re.sub(r"\\\+?w\s+([^|\\]*)(?:\|[^\\]*)?\\\+?w\*", r"\1", text)
    chapter = verse = 0
    words: list[str] = []
    for line in re.split(r"(?=\\[a-z]+\d*\b)", text):
        m = re.match(r"\\([a-z]+\d*)\*?\s*(.*)", line, re.S)
        if not m:
            continue
        marker, rest = m[1], m[2]
        if marker in ("c", "v"):
            if verse and words:
                yield number, chapter, verse, _joined(words)
            words = []
            n = re.match(r"(\d+)\S*\s*(.*)", rest, re.S)
            if marker == "c":
                chapter, verse = int(n[1]) if n else chapter, 0
            elif n:
                verse, words = int(n[1]), [n[2]]
        elif re.fullmatch(r"(s|ms|r|d|mt|h|toc|ide|id|rem|sp|mr|sr)\d*", marker):
            continue
        elif verse:
            words.append(rest)
    if verse and words:
        yield number, chapter, verse, _joined(words)


def _joined(words: list[str]) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\\\+?[a-z]+\d*\*?", "", " ".join(words))).strip()


def thml(text: str) -> Iterator[tuple]:
    """Commentary entries of a ThML file: the text under each scripCom passage (type, passage, osisRef), as plain text."""
    for div in ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text)).iter():
        marks = [m for m in div if m.tag.lower() == "scripcom"]
        for i, mark in enumerate(marks):
            children = list(div)
            start = children.index(mark)
            end = children.index(marks[i + 1]) if i + 1 < len(marks) else len(children)
            body = " ".join(" ".join(c.itertext()) for c in children[start + 1 : end]) + (mark.tail or "")
            ref = (mark.get("osisRef") or mark.get("parsed") or mark.get("passage") or "").removeprefix("Bible:")
            yield ref, re.sub(r"\s+", " ", body).strip()


def records(text: str) -> Iterator[tuple]:
    """Records of a line format: a line that starts with $ opens one, tab-separated fields follow."""
    kind, number = "", 0
    for line in text.splitlines():
        if line.startswith("$"):
            kind, number = line.lstrip("$= ").split("\t")[0], number + 1
        elif line.strip() and not line.startswith("#") and number:
            fields = line.split("\t")
            yield number, kind, fields[0].strip(), "\t".join(f.strip() for f in fields[1:])


def osis_dictionary(text: str) -> Iterator[tuple]:
    """Entries of an XML dictionary: an id (n or id) and the text."""
    for e in ET.fromstring(text).iter():
        tag = e.tag.rsplit("}", 1)[-1].lower()
        if tag in ("entry", "entryfree", "item") and (key := e.get("n") or e.get("id") or e.get("key")):
            yield key, re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table; # starts a comment, rows that do not fit are left out."""
    return spark.read.schema(schema).csv(path, sep="\t", comment="#", mode="DROPMALFORMED", quote="")


def keyed_json(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A JSON object by key as rows: the key and the fields of value (a struct type)."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string,{value}>")
    return whole.select(F.explode(entries).alias(key, "entry")).select(key, "entry.*")


def cross_references(spark: SparkSession, path: str) -> DataFrame:
    """(from, to_first, to_last, votes) of a table of Book.chapter.verse pairs."""
    from ..functions.references import dotted, dotted_range

    rows = tsv(spark, path, "a string, b string, votes int")
    return rows.select(dotted(F.col("a")).alias("from"), dotted_range(F.col("b")).alias("to"), "votes").where("from.chapter is not null and to.first.chapter is not null").select("from", F.col("to.first").alias("to_first"), F.col("to.last").alias("to_last"), "votes")


#: Format -> (test of a file's first bytes, parser, schema).
FORMATS: dict[str, tuple[str, Callable[[str], Iterator[tuple]], str]] = {
    "zefania": (r"<XMLBIBLE", zefania, VERSES),
    "thml": (r"<ThML", thml, "file string, reference string, text string"),
    "usfm": (r"(?s)^\s*\\id\s", usfm, VERSES),
    "records": (r"(?m)^\$", records, "file string, record int, kind string, name string, fields string"),
    "dictionary": (r"(?i)<(osis|TEI|dictionary|lexicon)\b", osis_dictionary, "file string, key string, text string"),
}


def detect(found: DataFrame) -> DataFrame:
    """found with the format that each file's first bytes show (null: none)."""
    head = F.decode(F.substring("content", 1, SAMPLE), "UTF-8")
    return found.withColumn("format", F.coalesce(*(F.when(head.rlike(test), F.lit(name)) for name, (test, _, _) in FORMATS.items())))


def read(found: DataFrame, name: str) -> DataFrame:
    """The rows of all files of a format."""
    test, parser, schema = FORMATS[name]
    return parsed(detect(found).where(F.col("format") == name), parser, schema)


def link_weights(html: DataFrame, key: str, text: str, most: int = 40) -> DataFrame:
    """(key, reference, weight): passages that markup names in data-osis; a span of verses shares a thousand, spans over the most count as that many."""
    refs = html.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r'data-osis="([^"]+)"'), F.lit(1))).alias("r"))
    part = lambda i: F.regexp_extract("r", r"^(\w+)\.(\d+)\.(\d+)(?:-(?:\w+\.\d+\.)?(\d+))?$", i)
    rows = refs.select(key, part(1).alias("book"), part(2).try_cast("int").alias("chapter"), part(3).try_cast("int").alias("first"), F.coalesce(part(4).try_cast("int"), part(3).try_cast("int")).alias("last")).where("chapter is not null and last >= first")
    rows = rows.withColumn("span", F.least(F.col("last") - F.col("first") + 1, F.lit(most)))
    each = rows.select(key, "book", "chapter", "span", F.explode(F.expr("sequence(first, first + span - 1)")).alias("verse"))
    return each.groupBy(key, "book", "chapter", "verse").agg(F.sum(F.expr("1000 div span")).alias("weight"))
