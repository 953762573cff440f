"""Suffix stripping for English after M. F. Porter, "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

import re

# The suffix rules of the paper's steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _closed(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            return root + rules[suffix] if _measure(root) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word of ASCII letters; other words are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif (found := re.fullmatch("(.*)(ed|ing)", word)) and "v" in _shape(found[1]):
        word = found[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _closed(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2, 0), _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _closed(root)):
            word = root
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
