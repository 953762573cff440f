"""Passage references: whole inputs, references inside prose, citations with their context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# The 66 books in order, with chapters and the abbreviations by which prose cites them.
BOOKS: list[tuple[str, int, str]] = [
    ("Genesis", 50, "gen ge gn"), ("Exodus", 40, "exod exo ex"), ("Leviticus", 27, "lev le lv"), ("Numbers", 36, "num nu nm"), ("Deuteronomy", 34, "deut deu dt"),
    ("Joshua", 24, "josh jos"), ("Judges", 21, "judg jdg"), ("Ruth", 4, "rut ru"), ("1 Samuel", 31, "1sam 1sa"), ("2 Samuel", 24, "2sam 2sa"), ("1 Kings", 22, "1kgs 1ki"), ("2 Kings", 25, "2kgs 2ki"),
    ("1 Chronicles", 29, "1chron 1chr 1ch"), ("2 Chronicles", 36, "2chron 2chr 2ch"), ("Ezra", 10, "ezr"), ("Nehemiah", 13, "neh ne"), ("Esther", 10, "esth est"), ("Job", 42, "jb"), ("Psalms", 150, "psalm psa ps"),
    ("Proverbs", 31, "prov pro pr"), ("Ecclesiastes", 12, "eccles eccl ecc"), ("Song of Solomon", 8, "song songofsongs canticles sos"), ("Isaiah", 66, "isa is"), ("Jeremiah", 52, "jer je"), ("Lamentations", 5, "lam la"),
    ("Ezekiel", 48, "ezek eze ezk"), ("Daniel", 12, "dan da dn"), ("Hosea", 14, "hos ho"), ("Joel", 3, "joe jl"), ("Amos", 9, "amo am"), ("Obadiah", 1, "obad oba"), ("Jonah", 4, "jon"), ("Micah", 7, "mic"),
    ("Nahum", 3, "nah"), ("Habakkuk", 3, "hab"), ("Zephaniah", 3, "zeph zep"), ("Haggai", 2, "hag"), ("Zechariah", 14, "zech zec"), ("Malachi", 4, "mal"), ("Matthew", 28, "matt mat mt"), ("Mark", 16, "mar mk mrk"),
    ("Luke", 24, "luk lk"), ("John", 21, "joh jn jhn"), ("Acts", 28, "act ac"), ("Romans", 16, "rom ro rm"), ("1 Corinthians", 16, "1cor 1co"), ("2 Corinthians", 13, "2cor 2co"), ("Galatians", 6, "gal ga"),
    ("Ephesians", 6, "eph"), ("Philippians", 4, "phil php"), ("Colossians", 4, "col"), ("1 Thessalonians", 5, "1thess 1thes 1th"), ("2 Thessalonians", 3, "2thess 2thes 2th"), ("1 Timothy", 6, "1tim 1ti"),
    ("2 Timothy", 4, "2tim 2ti"), ("Titus", 3, "tit"), ("Philemon", 1, "philem phm"), ("Hebrews", 13, "heb"), ("James", 5, "jas jam"), ("1 Peter", 5, "1pet 1pe"), ("2 Peter", 3, "2pet 2pe"),
    ("1 John", 5, "1joh 1jn"), ("2 John", 1, "2joh 2jn"), ("3 John", 1, "3joh 3jn"), ("Jude", 1, "jud"), ("Revelation", 22, "rev re"),
]
LAST_VERSE = 176
CONTEXT_BEFORE, CONTEXT_AFTER = 160, 80

_NAMES = {alias: i for i, (name, _, short) in enumerate(BOOKS, 1) for alias in [name.lower().replace(" ", ""), *short.split()]}


class Reference(NamedTuple):
    book: int
    chapter: int
    verse_start: int | None
    verse_end: int | None


class Found(NamedTuple):
    start: int
    end: int
    reference: Reference


def roman(text: str) -> int | None:
    """The value of a Roman numeral from 1 to 199, else null."""
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    digits = [values.get(c, 0) for c in text.lower()]
    if not digits or 0 in digits:
        return None
    total = sum(-d if i + 1 < len(digits) and d < digits[i + 1] else d for i, d in enumerate(digits))
    return total if 1 <= total <= 199 and _as_roman(total) == text.lower() else None


def _as_roman(n: int) -> str:
    out = ""
    for value, letters in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += letters * (n // value)
        n %= value
    return out


def book(name: str) -> int | None:
    """The number of a book by its name or an abbreviation; leading I, II, III stand for 1, 2, 3."""
    key = re.sub(r"[\s.]+", "", name.lower())
    key = re.sub(r"^(iii|ii|i|1st|2nd|3rd|first|second|third)(?=(sam|king|kgs|chr|cor|thes|tim|pet|joh|jn))", lambda m: {"iii": "3", "3rd": "3", "third": "3", "ii": "2", "2nd": "2", "second": "2"}.get(m[1], "1"), key)
    return _NAMES.get(key)


def book_name(number: int) -> str:
    return BOOKS[number - 1][0]


def _checked(number: int | None, chapter: int, start: int | None, end: int | None) -> Reference | None:
    """A reference inside the book's bounds. A book of one chapter cites verses alone."""
    if number is None:
        return None
    last = BOOKS[number - 1][1]
    if not 0 <= chapter <= last or (start is not None and not 1 <= start <= LAST_VERSE):
        return None
    if end is not None and (end < start or end > LAST_VERSE):
        end = start
    return Reference(number, chapter, start, end)


_WHOLE = re.compile(r"\s*((?:[1-3]|i{1,3})?\s*[a-z][a-z .]*?)\.?\s*(?:(\d{1,3})(?:\s*[:.]\s*(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?)?)?\s*", re.I)


def parse_reference(text: str) -> Reference | None:
    """The reference that the whole input is, chapter 0 for a whole book; null if it is none."""
    if not (m := _WHOLE.fullmatch(text)):
        return None
    start = int(m[3]) if m[3] else None
    return _checked(book(m[1]), int(m[2] or 0), start, int(m[4]) if m[4] else start)


_BOOK_IN_PROSE = "|".join(sorted({re.escape(n).replace(r"\ ", r"\s+") for name, _, short in BOOKS for n in [name.lstrip("123 "), *(s.lstrip("123") for s in short.split())] if len(n) > 1}, key=len, reverse=True))
_HEAD = re.compile(rf"(?<![\w])((?:(?:[1-3]|I{{1,3}})\s+)?(?:{_BOOK_IN_PROSE}))\b(\.?)\s+(\d{{1,3}}|[ivxlc]+)\s*[:.]\s*(\d{{1,3}})(?:\s*[-–]\s*(\d{{1,3}}))?", re.I)
_TAIL = re.compile(r"\s*([,;])\s*(?:(\d{1,3})\s*[:.]\s*)?(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?(?!\d|\s*[:.]\s*\d)")
_CHAPTER_TAIL = re.compile(r"\s*[;,]\s*(\d{1,3})\s*[:.]\s*(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?")


def find_references(text: str) -> list[Found]:
    """The references in prose: a book with chapter and verse, and the run of verses and chapters after it."""
    out: list[Found] = []
    at = 0
    while m := _HEAD.search(text, at):
        at = m.end(1)
        name = m[1]
        # Two letters are a book only if they are written as one.
        short = len(name.replace(" ", "")) <= 2
        if short and not (name[:1].isupper() or name[:1].isdigit()):
            continue
        chapter = int(m[3]) if m[3].isdigit() else roman(m[3])
        number = book(name)
        found = None if chapter is None else _checked(number, chapter, int(m[4]), int(m[5] or m[4]))
        if found is None or chapter == 0:
            continue
        out.append(Found(m.start(), m.end(), found))
        at = m.end()
        while True:
            if t := _CHAPTER_TAIL.match(text, at):
                nxt, first, last = int(t[1]), int(t[2]), int(t[3] or t[2])
            elif t := _TAIL.match(text, at):
                nxt, first, last = int(t[2] or chapter), int(t[3]), int(t[4] or t[3])
            else:
                break
            more = _checked(number, nxt, first, last)
            if more is None or nxt == 0:
                break
            chapter = nxt
            out.append(Found(t.start(), t.end(), more))
            at = t.end()
    return out


def label(r: Reference) -> str:
    verses = "" if r.verse_start is None else f":{r.verse_start}" + (f"-{r.verse_end}" if r.verse_end not in (None, r.verse_start) else "")
    return f"{book_name(r.book)} {r.chapter}{verses}"


def citations(text: str) -> list[tuple[str, int, str, Reference]]:
    """(label, occurrence, context, reference) of each reference in a text; occurrence numbers a label's repeats from 0."""
    seen: dict[str, int] = {}
    out = []
    for f in find_references(text):
        name = label(f.reference)
        left = text[max(0, f.start - CONTEXT_BEFORE) : f.start]
        # Start after the last sentence end, or at a whole word.
        cut = max((m.end() for m in re.finditer(r"[.!?]\s+(?=[A-Z])", left)), default=0)
        left = left[cut:] if cut else (re.sub(r"^\S*\s+", "", left) if f.start > CONTEXT_BEFORE else left)
        right = text[f.start : f.end + CONTEXT_AFTER]
        if f.end + CONTEXT_AFTER < len(text):
            right = re.sub(r"\s+\S*$", "", right)
        out.append((name, seen.get(name, 0), re.sub(r"\s+", " ", left + right).strip(), f.reference))
        seen[name] = seen.get(name, 0) + 1
    return out


@udtf(returnType=T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "book", "chapter", "verse_start", "verse_end")]))
class FindReferences:
    """Table function: the references in a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for f in find_references(text or ""):
            yield (f.start, f.end, *f.reference)


def dotted(column):
    """A reference written Book.chapter.verse as a struct; null parts where it is none."""
    part = lambda i: F.regexp_extract(column, r"^(.+)\.(\d+)\.(\d+)$", i)
    return F.struct(F.nullif(part(1), F.lit("")).alias("book"), part(2).try_cast("int").alias("chapter"), part(3).try_cast("int").alias("verse"))


def dotted_range(column):
    """The first and last of Book.chapter.verse-Book.chapter.verse; one reference is both."""
    parts = F.split(column, "-")
    return F.struct(dotted(parts[0]).alias("first"), dotted(F.coalesce(F.get(parts, 1), parts[0])).alias("last"))
