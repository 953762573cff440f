"""Alignment of word sequences: common subsequences, edition differences, labels carried across texts, typed recall."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_keys(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def common_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, the earliest in b on ties."""
    sizes = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            sizes[i, j] = sizes[i + 1, j + 1] + 1 if a[i] == b[j] else max(sizes[i + 1, j], sizes[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif sizes[i + 1, j] >= sizes[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def common_size(a: list, b: list) -> int:
    """The length of a longest common subsequence, in memory of one row."""
    row = np.zeros(len(b) + 1, np.int32)
    codes = {w: i for i, w in enumerate(dict.fromkeys(b))}
    bs = np.array([codes[w] for w in b], np.int32)
    for w in a:
        new = row.copy()
        if len(b):
            new[1:] = np.maximum(row[1:], np.where(bs == codes.get(w, -1), row[:-1] + 1, 0))
            new = np.maximum.accumulate(new)
        row = new
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many words two texts have in common, in order."""
    return pd.Series([0 if x is None or y is None else common_size(word_keys(x), word_keys(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def edition_diff(a: str, b: str) -> list[tuple[str, str]]:
    """(kind, words): what two editions share, what only the first and only the second has, in order."""
    x, y = a.split(), b.split()
    out: list[tuple[str, str]] = []
    i = j = 0
    for p, q in [*common_pairs([w.lower() for w in x], [w.lower() for w in y]), (len(x), len(y))]:
        for kind, words in (("removed", x[i:p]), ("added", y[j:q]), ("same", y[q : q + 1])):
            if words:
                if out and out[-1][0] == kind:
                    out[-1] = (kind, f"{out[-1][1]} {' '.join(words)}")
                else:
                    out.append((kind, " ".join(words)))
        i, j = p + 1, q + 1
    return out


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Edits between two words, null if there are more than most."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return None
        row = new
    return row[-1] if row[-1] <= most else None


def likeness(a: str, b: str) -> float:
    """How alike two names are spelled, from 0 to 1; 0 if they start differently."""
    a, b = a.lower(), b.lower()
    if not a or not b or a[0] != b[0]:
        return 0.0
    d = edit_distance(a, b, max(len(a), len(b)))
    return 1 - d / max(len(a), len(b))


def project_spans(base: str, spans: list[tuple[int, int, str]], other: str, least: float = 0.6) -> list[tuple[int, int, str]]:
    """Labelled character spans of one text in another: by common words, then by like spellings between them.

    Neighbouring words with one label become one span.
    """
    x, y = list(re.finditer(r"[^\W_]+", base)), list(re.finditer(r"[^\W_]+", other))
    pairs = dict(common_pairs([m[0].lower() for m in x], [m[0].lower() for m in y]))
    anchors = sorted(pairs.items())
    bounds = [(-1, -1), *anchors, (len(x), len(y))]
    for (i, j), (p, q) in zip(bounds, bounds[1:], strict=False):
        # Between two anchors: the likest word, else by place.
        for at in range(i + 1, p):
            free = [k for k in range(j + 1, q) if k not in pairs.values()]
            scored = max(((likeness(x[at][0], y[k][0]), -k) for k in free), default=(0.0, 0))
            if scored[0] >= least:
                pairs[at] = -scored[1]
            elif p - i == q - j:
                pairs[at] = j + (at - i)
    out: list[tuple[int, int, str]] = []
    for start, end, code in spans:
        words = [pairs[k] for k, m in enumerate(x) if m.start() < end and m.end() > start and k in pairs]
        for w in sorted(words):
            a, b = y[w].start(), y[w].end()
            if out and out[-1][2] == code and other[out[-1][1] : a].strip() == "" and out[-1][1] <= a:
                out[-1] = (out[-1][0], b, code)
            else:
                out.append((a, b, code))
    return out


def first_letters(text: str) -> str:
    """Each word's first letter, punctuation kept: a hint for recall."""
    return re.sub(r"([^\W_])[^\W_]*(?:['’][^\W_]+)?", r"\1", text)


def recall(expected: str, typed: str) -> tuple[list[tuple[str, str]], float]:
    """The difference between a text and what was typed, and the share of words that were right."""
    words = word_keys(expected)
    return edition_diff(expected, typed), (common_size(words, word_keys(typed)) / len(words) if words else 1.0)


def align_phrases(phrases: list[tuple[str, list[str]]], words: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(phrase, word) index pairs: phrases (text, numbers) of a translation with words (text, number) of the original.

    Words whose numbers stand in the same order in both come first; each word left over goes to the nearest phrase that
    names its number and has not got that number yet. A word belongs to one phrase.
    """
    named = [(i, n) for i, (_, numbers) in enumerate(phrases) for n in numbers]
    pairs = {b: named[a][0] for a, b in common_pairs([n for _, n in named], [n for _, n in words])}
    taken = {(p, words[w][1]) for w, p in pairs.items()}
    for w, (_, number) in enumerate(words):
        if w in pairs:
            continue
        place = len(phrases) * w / max(len(words), 1)
        free = [i for i, (_, numbers) in enumerate(phrases) if number in numbers and (i, number) not in taken]
        if free:
            best = min(free, key=lambda i: (abs(i - place), i))
            pairs[w] = best
            taken.add((best, number))
    return sorted((p, w) for w, p in pairs.items())
