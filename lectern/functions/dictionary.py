"""Finding the headword of an inflected English word, old forms among them."""

from __future__ import annotations

# Endings that a headword may have taken, with what stood there before.
ENDINGS = [("s", ""), ("es", ""), ("es", "e"), ("ies", "y"), ("ed", ""), ("ed", "e"), ("ied", "y"), ("ing", ""), ("ing", "e"), ("eth", ""), ("eth", "e"), ("est", ""), ("est", "e"), ("er", ""), ("er", "e"), ("ly", ""), ("ness", "")]
# Irregular forms.
IRREGULAR = {"hath": "have", "hast": "have", "had": "have", "has": "have", "doth": "do", "dost": "do", "did": "do", "does": "do", "saith": "say", "said": "say", "spake": "speak", "spoke": "speak", "brake": "break", "broke": "break", "begat": "beget", "went": "go", "gone": "go", "art": "be", "is": "be", "are": "be", "was": "be", "were": "be", "men": "man", "women": "woman", "children": "child", "brethren": "brother", "feet": "foot", "oxen": "ox"}
SUFFIXES = ["s", "es", "ed", "ing", "eth", "est"]


def candidates(word: str) -> list[str]:
    """Headwords that a word may belong to, the likeliest first, the word itself before all."""
    low = word.lower().strip("'’")
    out = [low]
    if low in IRREGULAR:
        out.append(IRREGULAR[low])
    for possessive in ("'s", "’s"):
        if low.endswith(possessive):
            out.append(low[: -len(possessive)])
    for ending, instead in ENDINGS:
        if low.endswith(ending) and len(low) - len(ending) >= 2:
            root = low[: -len(ending)]
            out.append(root + instead)
            # stopped -> stop
            if not instead and ending in ("ed", "ing", "er", "est", "eth") and len(root) > 3 and root[-1] == root[-2] and root[-1] not in "aeiouls":
                out.append(root[:-1])
    return list(dict.fromkeys(out))


def headword(word: str, known: set[str]) -> str | None:
    """The first candidate that a dictionary has."""
    return next((c for c in candidates(word) if c in known), None)


def inflections(word: str) -> list[str]:
    """A headword's regular forms."""
    return [word, *(word + s for s in SUFFIXES)]
