"""Parsing codes as fields. Codes are few; decode them once each and join by code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Greek parsing codes of the form V-PAI-3S, N-NSM, ADV.
GREEK_PARTS = {"N": "noun", "A": "adjective", "T": "article", "V": "verb", "P": "personal pronoun", "R": "relative pronoun", "C": "reciprocal pronoun", "D": "demonstrative pronoun", "K": "correlative pronoun", "I": "interrogative pronoun", "X": "indefinite pronoun", "Q": "correlative pronoun", "F": "reflexive pronoun", "S": "possessive pronoun", "ADV": "adverb", "CONJ": "conjunction", "COND": "conditional", "PRT": "particle", "PREP": "preposition", "INJ": "interjection", "ARAM": "Aramaic", "HEB": "Hebrew"}
GREEK_TENSES = {"P": "present", "I": "imperfect", "F": "future", "A": "aorist", "R": "perfect", "L": "pluperfect"}
GREEK_VOICES = {"A": "active", "M": "middle", "P": "passive", "E": "middle or passive", "D": "middle deponent", "O": "passive deponent", "N": "middle or passive deponent"}
GREEK_MOODS = {"I": "indicative", "S": "subjunctive", "O": "optative", "M": "imperative", "N": "infinitive", "P": "participle"}
CASES = {"N": "nominative", "V": "vocative", "G": "genitive", "D": "dative", "A": "accusative"}
NUMBERS = {"S": "singular", "P": "plural", "D": "dual"}
GENDERS = {"M": "masculine", "F": "feminine", "N": "neuter", "C": "common", "B": "both"}
PERSONS = {"1": "first", "2": "second", "3": "third"}
# Letters of Hebrew parsing codes of the form HVqp3ms, HNcmsa.
HEBREW_PARTS = {"A": "adjective", "C": "conjunction", "D": "adverb", "N": "noun", "P": "pronoun", "R": "preposition", "S": "suffix", "T": "particle", "V": "verb"}
HEBREW_STEMS = {"q": "qal", "N": "niphal", "p": "piel", "P": "pual", "h": "hiphil", "H": "hophal", "t": "hithpael"}
HEBREW_FORMS = {"p": "perfect", "q": "sequential perfect", "i": "imperfect", "w": "sequential imperfect", "h": "cohortative", "j": "jussive", "v": "imperative", "r": "participle active", "s": "participle passive", "a": "infinitive absolute", "c": "infinitive construct"}
HEBREW_GENDERS = {"m": "masculine", "f": "feminine", "b": "both", "c": "common"}
HEBREW_NUMBERS = {"s": "singular", "p": "plural", "d": "dual"}
HEBREW_STATES = {"a": "absolute", "c": "construct", "d": "determined"}

FIELDS = ["language", "part", "tense", "voice", "mood", "person", "gramcase", "number", "gender", "stem", "state"]


def _greek(code: str) -> dict[str, str]:
    head, *rest = code.split("-")
    out = {"language": "Greek", "part": GREEK_PARTS.get(head, "")}
    if head == "V" and rest:
        form = rest[0].lstrip("2")
        out |= {"tense": GREEK_TENSES.get(form[:1], ""), "voice": GREEK_VOICES.get(form[1:2], ""), "mood": GREEK_MOODS.get(form[2:3], "")}
        rest = rest[1:]
        if rest and rest[0][:1] in PERSONS:
            return out | {"person": PERSONS[rest[0][0]], "number": NUMBERS.get(rest[0][1:2], "")}
    if rest:
        form = rest[0]
        if form[:1] in PERSONS:
            out["person"], form = PERSONS[form[0]], form[1:]
        out |= {"gramcase": CASES.get(form[:1], ""), "number": NUMBERS.get(form[1:2], ""), "gender": GENDERS.get(form[2:3], "")}
    return out


def _hebrew(code: str) -> dict[str, str]:
    language = "Aramaic" if code[0] == "A" else "Hebrew"
    # The last part of a word with prefixes is the word itself; suffixes start with S.
    parts = [p for p in code[1:].split("/") if p]
    main = next((p for p in reversed(parts) if p[0] != "S"), parts[-1] if parts else "")
    out = {"language": language, "part": HEBREW_PARTS.get(main[:1], "")}
    if main[:1] == "V":
        out |= {"stem": HEBREW_STEMS.get(main[1:2], ""), "tense": HEBREW_FORMS.get(main[2:3], "")}
        rest = main[3:]
        if rest[:1] in PERSONS:
            out["person"], rest = PERSONS[rest[0]], rest[1:]
    elif main[:1] == "P" and main[2:3] in PERSONS:
        out["person"], rest = PERSONS[main[2]], main[3:]
    else:
        rest = main[2:]
    return out | {"gender": HEBREW_GENDERS.get(rest[:1], ""), "number": HEBREW_NUMBERS.get(rest[1:2], ""), "state": HEBREW_STATES.get(rest[2:3], "")}


def decode(code: str | None) -> dict[str, str]:
    """The fields of a code, empty where it says nothing, and a description in words."""
    found = {} if not code else _hebrew(code) if code[0] in "HA" and "-" not in code and code not in GREEK_PARTS and code[1:2].isupper() and len(code) > 1 else _greek(code)
    out = {f: found.get(f, "") for f in FIELDS}
    out["description"] = " ".join(out[f] for f in ("stem", "tense", "voice", "mood", "part", "person", "gramcase", "number", "gender", "state") if out[f])
    return out


DECODED = T.StructType([T.StructField(f, T.StringType()) for f in [*FIELDS, "description"]])


@F.pandas_udf(DECODED)
def decoded(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(c) for c in codes], columns=[*FIELDS, "description"])


def decode_column(words: DataFrame, code: str) -> DataFrame:
    """words with the fields of their codes; each code is decoded once."""
    codes = words.select(code).distinct().select(code, decoded(F.col(code)).alias("d")).select(code, "d.*")
    return words.join(codes, code, "left")
