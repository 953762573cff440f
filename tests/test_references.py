import pytest

from lectern.functions.references import Reference, book, citations, find_references, parse_reference, roman
from lectern.functions.stemmer import stem
from lectern.functions.text import bare_letters


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Jn 3:16", (43, 3, 16, 16)), ("Ps 23", (19, 23, None, None)), ("1 Jn 1:9-10", (62, 1, 9, 10)), ("rom8", (45, 8, None, None)), ("psalms", (19, 0, None, None)), ("Jude 3:1", None), ("love", None), ("", None)],
)
def test_whole_inputs(text, expected):
    assert parse_reference(text) == (Reference(*expected) if expected else None)


def test_prose():
    found = [f.reference[:3] for f in find_references("as Paul says (Rom. 8:28, 30; 9:1), and Matt. xvi. 18 teaches")]
    assert found == [(45, 8, 28), (45, 8, 30), (45, 9, 1), (40, 16, 18)]
    found = [f.reference for f in find_references("see 1 Cor. 13:4-7 and I John 4. 8")]
    assert found == [(46, 13, 4, 7), (62, 4, 8, 8)]


@pytest.mark.parametrize("text", ["In the year 1662, 3 men", "Chapter 3. 4 things", "Jude 30:1", ""])
def test_no_references(text):
    assert find_references(text) == []


def test_citations():
    got = citations("First, Rom. 8:28 comforts us. Later Rom. 8:28 is cited again.")
    assert [c[:2] for c in got] == [("Romans 8:28", 0), ("Romans 8:28", 1)]
    assert got[1][2].startswith("Later")


def test_small_kernels():
    assert [roman(x) for x in ("xvi", "iv", "iiii", "cxc", "")] == [16, 4, None, 190, None]
    assert book("II Sam.") == 10 and book("nowhere") is None
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "falling", "happy", "generalizations", "sky")] == ["caress", "poni", "relat", "hop", "fall", "happi", "gener", "sky"]
    assert bare_letters("Λόγος") == "λογοσ" and bare_letters(None) is None


def test_headwords():
    from lectern.functions.dictionary import headword, inflections

    known = {"love", "stop", "city", "have", "run", "speak"}
    assert [headword(w, known) for w in ("loveth", "stopped", "cities", "hath", "Running", "spake", "zzz")] == ["love", "stop", "city", "have", "run", "speak", None]
    assert "loveing" in inflections("love")
