"""The search language: a query becomes a tree of conditions, filters, and a description of what was understood.

Words side by side are both wanted and bind closest, then NOT (or a leading dash), then OR; only
upper-case AND, OR and NOT are operators. What cannot be meant (a dangling OR, a NOT with nothing
before it, an open parenthesis) is repaired, never an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.references import BOOKS, book, book_name, parse_reference

# Groups of spellings that one another's search finds.
SPELLINGS = [
    ("show", "shew"), ("showed", "shewed"), ("shows", "shews", "sheweth", "showeth"), ("showing", "shewing"), ("shown", "shewn"), ("has", "hath"),
    ("does", "doth", "doeth"), ("says", "saith"), ("music", "musick"), ("public", "publick"), ("cloak", "cloke"), ("jail", "gaol"), ("soap", "sope"),
    ("ankles", "ancles"), ("honor", "honour"), ("honored", "honoured"), ("color", "colour"), ("colors", "colours"), ("savior", "saviour"),
    ("neighbor", "neighbour"), ("neighbors", "neighbours"), ("labor", "labour"), ("labored", "laboured"), ("favor", "favour"), ("armor", "armour"),
    ("odor", "odour"), ("vapor", "vapour"), ("gray", "grey"), ("center", "centre"), ("mold", "mould"), ("plow", "plough"), ("plowman", "ploughman"),
    ("fulfill", "fulfil"), ("forever", "for ever"), ("spoke", "spake"), ("broke", "brake"),
]
# Names for runs of books.
BOOK_GROUPS = {
    "ot": ("the Old Testament", 1, 39), "nt": ("the New Testament", 40, 66), "pentateuch": ("the Pentateuch", 1, 5), "law": ("the Law", 1, 5), "torah": ("the Law", 1, 5),
    "history": ("the Histories", 6, 17), "histories": ("the Histories", 6, 17), "wisdom": ("the Wisdom books", 18, 22), "poetry": ("the Wisdom books", 18, 22),
    "prophets": ("the Prophets", 23, 39), "majorprophets": ("the Major Prophets", 23, 27), "minorprophets": ("the Minor Prophets", 28, 39), "gospels": ("the Gospels", 40, 43),
    "epistles": ("the Epistles", 45, 65), "letters": ("the Epistles", 45, 65), "pauline": ("Paul's letters", 45, 57), "paul": ("Paul's letters", 45, 57), "general": ("the General Epistles", 58, 65),
}
# Names of marked kinds of words, the codes they stand for, and what is said of them.
TAGS = {
    "god": (["GF", "GS", "HS"], "naming God"), "father": (["GF"], "naming the Father"), "son": (["GS"], "naming the Son"), "christ": (["GS"], "naming the Son"), "jesus": (["GS"], "naming the Son"),
    "spirit": (["HS"], "naming the Holy Spirit"), "holyspirit": (["HS"], "naming the Holy Spirit"), "ghost": (["HS"], "naming the Holy Spirit"),
    "angels": (["AN", "DE"], "naming angels or demons"), "spirits": (["AN", "DE"], "naming angels or demons"), "angel": (["AN"], "naming angels"), "angelic": (["AN"], "naming angels"),
    "demon": (["DE"], "naming demons or false gods"), "demons": (["DE"], "naming demons or false gods"), "demonic": (["DE"], "naming demons or false gods"), "idol": (["DE"], "naming demons or false gods"), "idols": (["DE"], "naming demons or false gods"),
    "people": (["PN", "PG", "GP"], "naming people"), "who": (["PN", "PG", "GP"], "naming people"), "person": (["PN"], "naming a person"), "persons": (["PN"], "naming a person"), "name": (["PN"], "naming a person"), "names": (["PN"], "naming a person"),
    "nation": (["PG"], "naming a nation or tribe"), "nations": (["PG"], "naming a nation or tribe"), "tribe": (["PG"], "naming a nation or tribe"), "tribes": (["PG"], "naming a nation or tribe"), "group": (["PG"], "naming a nation or tribe"),
    "nature": (["BE", "PL"], "naming animals or plants"), "what": (["BE", "PL"], "naming animals or plants"), "animal": (["BE"], "naming animals"), "animals": (["BE"], "naming animals"), "plant": (["PL"], "naming plants"), "plants": (["PL"], "naming plants"),
    "places": (["PP", "L1"], "naming places"), "where": (["PP", "L1"], "naming places"), "placename": (["PP"], "naming a place"), "place-name": (["PP"], "naming a place"), "city": (["PP"], "naming a place"), "cities": (["PP"], "naming a place"),
    "time": (["T1", "T2"], "marking time"), "when": (["T1", "T2"], "marking time"), "date": (["T1"], "naming a time"), "dates": (["T1"], "naming a time"), "feast": (["T1"], "naming a time"), "feasts": (["T1"], "naming a time"),
    "number": (["NU", "ME"], "with numbers"), "numbers": (["NU", "ME"], "with numbers"), "howmany": (["NU", "ME"], "with numbers"), "measure": (["ME"], "with measures"), "measures": (["ME"], "with measures"),
}
# Voices.
SPEAKERS = {
    "god": ("god", "God speaking"), "lord": ("god", "God speaking"), "divine": ("god", "God speaking"), "quote": ("quote", "Scripture quoted"), "quoted": ("quote", "Scripture quoted"), "scripture": ("quote", "Scripture quoted"),
    "speech": ("speech", "someone speaking"), "person": ("speech", "someone speaking"), "people": ("speech", "someone speaking"), "inner": ("inner", "speech within speech"), "nested": ("inner", "speech within speech"),
    "benediction": ("benediction", "benedictions"), "blessing": ("benediction", "benedictions"),
}
# Highlight colours as they are stored.
COLORS = {"yellow": "#fef08a", "amber": "#fef08a", "green": "#bbf7d0", "blue": "#bfdbfe", "pink": "#fbcfe8", "orange": "#fed7aa", "underline": "#f59e0b"}


@dataclass(frozen=True)
class Term:
    word: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Near:
    left: str
    right: str
    distance: int


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Without:
    keep: object
    drop: object


@dataclass(frozen=True)
class Exact:
    word: str
    cased: bool


@dataclass
class Filters:
    books: list[int] = field(default_factory=list)
    chapter: int | None = None
    translations: list[str] = field(default_factory=list)
    commentaries: list[str] = field(default_factory=list)
    strongs: list[str] = field(default_factory=list)
    lemmas: list[str] = field(default_factory=list)
    red: bool = False
    tags: list[str] = field(default_factory=list)
    speakers: list[str] = field(default_factory=list)
    has_note: bool = False
    has_highlight: bool = False
    colors: list[str] = field(default_factory=list)
    since: str | None = None
    series: str | None = None

    def narrows(self) -> bool:
        """Whether the filters alone define a set of passages."""
        return bool(self.strongs or self.lemmas or self.red or self.tags or self.speakers or self.has_note or self.has_highlight or self.colors)


@dataclass
class Query:
    tree: object | None
    exact: list[Exact]
    regex: str | None
    filters: Filters
    chips: list[str]
    unknown: list[str]

    def is_empty(self) -> bool:
        return self.tree is None and self.regex is None and not self.filters.narrows()


_TOKEN = re.compile(r"""\s*(?:
    (?P<open>\() | (?P<close>\)) | (?P<phrase>-?"[^"]*"?) | (?P<regex>/(?P<pattern>(?:\\.|[^/\\])+)/(?P<flags>[A-Za-z]*))
    | ~(?P<near>\d*) | (?P<word>[^\s()]+)
)""", re.X)  # fmt: skip


def _spellings(word: str) -> list[str]:
    """A word's other spellings, old verb endings among them."""
    low = word.lower()
    out = [w for group in SPELLINGS if low in group for w in group if w != low]
    if re.fullmatch("[a-z]{3,}", low) and not low.endswith(("eth", "est")):
        base = low if low.endswith("e") else f"{low}e"
        out += [f"{base}th", f"{base}st"]
    return list(dict.fromkeys(out))


class _Parser:
    def __init__(self, text: str, prefix: bool, older: bool):
        self.prefix, self.older = prefix, older
        self.filters, self.exact, self.chips, self.unknown, self.regex = Filters(), [], [], [], None
        self.tokens = [t for m in _TOKEN.finditer(text) if (t := self.token(m)) is not None]
        self.at = 0

    def token(self, m: re.Match) -> tuple | None:
        """(kind, value): open, close, or, not, near, or leaf with a node."""
        if m["open"] or m["close"]:
            return ("open" if m["open"] else "close", None)
        if m["phrase"]:
            inner = m["phrase"].lstrip("-").strip('"').strip()
            if not inner:
                return None
            negated = m["phrase"].startswith("-")
            self.chips.append(f'without "{inner}"' if negated else f'"{inner}"')
            return ("no leaf" if negated else "leaf", Phrase(inner))
        if m["regex"]:
            self.regex = ("(?i)" if "i" in m["flags"] else "") + m["pattern"]
            self.chips.append(f"matching {m['regex']}")
            return None
        if m["near"] is not None:
            return "near", min(100, max(1, int(m["near"] or 10)))
        word = m["word"]
        if word in ("AND", "OR", "NOT"):
            return {"AND": None, "OR": ("or", None), "NOT": ("not", None)}[word]
        if self.filter(word):
            return None
        return self.leaf(word)

    def leaf(self, word: str) -> tuple | None:
        if word.startswith("-") and len(word) > 1:
            self.chips.append(f"without {word[1:]}")
            return "no leaf", Term(word[1:].rstrip("*"), self.prefix or word.endswith("*"))
        if word.startswith("+") and len(word) > 1:
            cased = word[1:] != word[1:].lower()
            self.exact.append(Exact(word[1:], cased))
            self.chips.append(f"exactly {word[1:]}")
            return "leaf", Term(word[1:])
        starred = word.endswith("*") and len(word) > 1
        plain = word.rstrip("*")
        if not re.search(r"[^\W_]", plain):
            return None
        self.chips.append(plain)
        own = Term(plain, self.prefix or starred)
        others = _spellings(plain) if self.older and not starred else []
        if others:
            return "leaf", Any((own, *(Phrase(w) if " " in w else Term(w) for w in others)))
        return "leaf", own

    def filter(self, word: str) -> bool:
        """Takes a word that is a filter; one that looks like a filter but is none is noted as unknown."""
        if m := re.fullmatch(r"([GH])0*([1-9]\d{0,4})", word):
            self.filters.strongs.append(m[1] + m[2])
            self.chips.append(f"with {m[1]}{m[2]}")
            return True
        m = re.fullmatch(r"(in|t|c|lemma|red|tag|speaker|has|color|since|series):(.*)", word)
        if not m:
            return False
        name, values = m[1], [v for v in m[2].split(",") if v]
        if name == "red":
            self.filters.red = True
            self.chips.append("words of Christ")
            return True
        for value in values:
            if not getattr(self, f"on_{name}")(value):
                self.unknown.append(f"{name}:{value}")
        return True

    def on_in(self, value: str) -> bool:
        key = value.lower()
        if key in BOOK_GROUPS:
            said, first, last = BOOK_GROUPS[key]
            self.filters.books += range(first, last + 1)
            self.chips.append(f"in {said}")
            return True
        found = parse_reference(value)
        if found is None:
            return False
        self.filters.books.append(found.book)
        self.filters.chapter = found.chapter or None
        self.chips.append(f"in {book_name(found.book)}" + (f" {found.chapter}" if found.chapter else ""))
        return True

    def on_t(self, value: str) -> bool:
        self.filters.translations.append(value.upper() if value.lower() != "all" else "all")
        self.chips.append(f"in {value.upper()}")
        return True

    def on_c(self, value: str) -> bool:
        self.filters.commentaries.append(value.lower())
        self.chips.append(f"commentaries named {value}")
        return True

    def on_lemma(self, value: str) -> bool:
        self.filters.lemmas.append(value)
        self.chips.append(f"lemma {value}")
        return True

    def on_tag(self, value: str) -> bool:
        if value.lower() not in TAGS:
            return False
        codes, said = TAGS[value.lower()]
        self.filters.tags += [c for c in codes if c not in self.filters.tags]
        self.chips.append(said)
        return True

    def on_speaker(self, value: str) -> bool:
        if value.lower() not in SPEAKERS:
            return False
        voice, said = SPEAKERS[value.lower()]
        self.filters.speakers.append(voice)
        self.chips.append(said)
        return True

    def on_has(self, value: str) -> bool:
        if value.lower() not in ("note", "notes", "highlight", "highlights"):
            return False
        setattr(self.filters, f"has_{value.lower().rstrip('s')}", True)
        self.chips.append(f"with a {value.lower().rstrip('s')}")
        return True

    def on_color(self, value: str) -> bool:
        if value.lower() not in COLORS:
            return False
        self.filters.colors.append(COLORS[value.lower()])
        self.chips.append(f"highlighted {value.lower()}")
        return True

    def on_since(self, value: str) -> bool:
        self.filters.since = re.sub(r"[^0-9-]", "", value)
        self.chips.append(f"since {self.filters.since}")
        return bool(self.filters.since)

    def on_series(self, value: str) -> bool:
        self.filters.series = value
        self.chips.append(f"series {value}")
        return True

    def group(self) -> object | None:
        """Everything up to the closing parenthesis or the end."""
        branches = []
        while True:
            branch = self.branch()
            if branch is not None:
                branches.append(branch)
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "or":
                self.at += 1
                continue
            break
        return branches[0] if len(branches) == 1 else Any(tuple(branches)) if branches else None

    def branch(self) -> object | None:
        """Runs of wanted things, parted by NOT: all of the first run without all of each later one."""
        runs: list[list] = [[]]
        negated = near = None
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind in ("or", "close"):
                break
            self.at += 1
            if kind == "not":
                negated = True
                continue
            if kind == "near":
                near = value
                continue
            if kind == "open":
                node = self.group()
                if self.at < len(self.tokens) and self.tokens[self.at][0] == "close":
                    self.at += 1
            else:
                node, negated = value, negated or kind == "no leaf"
            if node is None:
                continue
            if negated:
                if runs[0]:
                    runs.append([node])
            elif near is not None and runs[-1] and isinstance(runs[-1][-1], Term) and isinstance(node, Term):
                runs[-1][-1] = Near(runs[-1][-1].word, node.word, near)
            else:
                runs[-1].append(node)
            negated = near = None
        joined = [r[0] if len(r) == 1 else All(tuple(r)) for r in runs if r]
        out = joined[0] if joined else None
        for drop in joined[1:]:
            out = Without(out, drop)
        return out

    def all(self) -> object | None:
        parts = []
        while self.at < len(self.tokens):
            node = self.group()
            if node is not None:
                parts.append(node)
            # A parenthesis that was never opened.
            if self.at < len(self.tokens):
                self.at += 1
        return parts[0] if len(parts) == 1 else All(tuple(parts)) if parts else None


def parse(text: str, prefix: bool = True, older_spellings: bool = False) -> Query:
    p = _Parser(text, prefix, older_spellings)
    tree = p.all()
    if p.filters.chapter is not None and len(set(p.filters.books)) != 1:
        p.filters = replace(p.filters, chapter=None)
    return Query(tree, p.exact, p.regex, p.filters, p.chips, p.unknown)


def render(node: object | None) -> str:
    """A tree as text, the way full-text indexes write it."""
    quoted = lambda w: '"' + w.replace('"', '""') + '"'
    inside = lambda n: f"({render(n)})" if isinstance(n, Any) else render(n)
    match node:
        case None:
            return ""
        case Term(word, prefix):
            return quoted(word) + "*" * prefix
        case Phrase(text):
            return quoted(text)
        case Near(a, b, n):
            return f"NEAR({quoted(a)} {quoted(b)}, {n})"
        case All(parts):
            return " ".join(map(inside, parts))
        case Any(parts):
            return " OR ".join(map(render, parts))
        case Without(keep, drop):
            return f"{inside(keep)} NOT {inside(drop)}"
    raise TypeError(node)


def book_scope(name: str) -> list[int]:
    """The books that a name or a group stands for."""
    if name.lower() in BOOK_GROUPS:
        _, first, last = BOOK_GROUPS[name.lower()]
        return list(range(first, last + 1))
    found = book(name)
    return [found] if found else []


assert len(BOOKS) == 66
