import pytest

from lectern.plans.querylang import Exact, book_scope, parse, render


def shown(text, prefix=True):
    return render(parse(text, prefix).tree)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("love joy", '"love"* "joy"*'),
        ('"in the beginning"', '"in the beginning"'),
        ("faith OR hope", '"faith"* OR "hope"*'),
        ("faith AND hope", '"faith"* "hope"*'),
        ("love -hate", '"love"* NOT "hate"*'),
        ("love NOT hate", '"love"* NOT "hate"*'),
        ("-hate", ""),
        ("NOT hate", ""),
        ("love OR", '"love"*'),
        ("OR love", '"love"*'),
        ('o"brien', '"o""brien"*'),
        ("let not your heart", '"let"* "not"* "your"* "heart"*'),
        ("and", '"and"*'),
        ("(love OR charity) -world", '("love"* OR "charity"*) NOT "world"*'),
        ('love -"the world"', '"love"* NOT "the world"'),
        ("love)", '"love"*'),
        ("((love", '"love"*'),
        ("()", ""),
        ("", ""),
    ],
)
def test_trees(text, expected):
    assert shown(text) == expected


@pytest.mark.parametrize(("text", "expected"), [("son", '"son"'), ("love ~5 God", 'NEAR("love" "God", 5)'), ("love ~ God", 'NEAR("love" "God", 10)'), ("love ~500 God", 'NEAR("love" "God", 100)'), ("lov*", '"lov"*'), ("love -hate", '"love" NOT "hate"')])
def test_whole_words(text, expected):
    assert shown(text, prefix=False) == expected


def test_exact_forms():
    q = parse("+LORD")
    assert render(q.tree) == '"LORD"' and q.exact == [Exact("LORD", True)]
    assert parse("+love").exact == [Exact("love", False)]


def test_filters():
    q = parse('in:psalms +LORD -"LORD of hosts" t:kjv')
    assert render(q.tree) == '"LORD" NOT "LORD of hosts"'
    assert q.filters.books == [19] and q.filters.translations == ["KJV"]
    q = parse("in:rom8 love")
    assert q.filters.books == [45] and q.filters.chapter == 8
    q = parse("in:gospels G26 red:")
    assert q.filters.books == [40, 41, 42, 43] and q.filters.strongs == ["G26"] and q.filters.red
    assert q.tree is None and not q.is_empty()
    assert parse("in:narnia love").unknown == ["in:narnia"]
    assert parse("in:rom8,gen").filters.chapter is None


def test_marks_and_voices():
    q = parse("lamb tag:son speaker:god,quote tag:nope")
    assert q.filters.tags == ["GS"] and q.filters.speakers == ["god", "quote"]
    assert "naming the Son" in q.chips and q.unknown == ["tag:nope"] and q.filters.narrows()


def test_spellings_and_regex():
    assert '"show"' in render(parse("shew", False, True).tree)
    assert '"believeth"' in render(parse("believe", False, True).tree)
    assert parse("/righteous(ness)?$/i").regex == "(?i)righteous(ness)?$"
    assert book_scope("nt")[0] == 40 and book_scope("nowhere") == []
