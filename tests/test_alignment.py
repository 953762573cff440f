from lectern.functions.alignment import align_phrases
from lectern.operators.layout import ticks


def test_phrases_and_words():
    phrases = [("In the beginning", ["H7225"]), ("God", ["H430"]), ("created", ["H1254"]), ("and God", ["H430"])]
    words = [("reshit", "H7225"), ("bara", "H1254"), ("elohim", "H430"), ("elohim", "H430"), ("et", "H853")]
    assert align_phrases(phrases, words) == [(0, 0), (1, 2), (2, 1), (3, 3)] or align_phrases(phrases, words) == [(0, 0), (1, 3), (2, 1), (3, 2)]
    assert align_phrases([], words) == [] and align_phrases(phrases, []) == []


def test_ticks():
    assert ticks(-10, 10, 4) == [-10, -5, 0, 5, 10]
    assert ticks(0, 10, 20) == [float(i) for i in range(11)]
    assert ticks(5, 5, 3) == [] and len(ticks(-4004, 100, 10)) <= 11
