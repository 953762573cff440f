"""Operator 1: secret scan with a random forest against false positives. DataFrame functions only.

One regular expression finds texts that may hold a secret at all; only in those are words taken apart,
inside the row. A candidate is any run of 16 or more key characters of a word, or a value of 8 or more characters, a digit
among them, behind a secret's name and a sign (=, : and the like). Each is judged with its own name, that is the part
of its word before it. Its features: length, character transitions, coverage by dictionary words, the path (source) it
comes from and the words around it. A random forest trained on labelled findings, its trees written out as column
expressions, decides which candidates are secrets. Nothing is shuffled but for the dictionary.

The dictionary is the most frequent words of the corpus (``WORDS`` of them), counted over all documents, with a few
words of placeholders. Labelled findings are a table (word, before, after, path, label); labelled_findings() makes a
bounded one from rules: keys, tokens and passwords in assignments and addresses against checksums, identifiers,
numbers, placeholders, paths and long words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
_KEY = "[A-Za-z0-9+/_~.-]"
_RUN = rf"{_KEY}{{15,}}[A-Za-z0-9_-]"
#: Some word has a run of 16 key characters or more.
MAYBE = rf"(?<!{_KEY}){_KEY}{{15}}"
_CORE = rf"((?<!{_KEY}){_RUN}={{0,2}})"

# Words that name a secret, and words that name something else.
NAMES = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "authorization", "bearer", "credential", "credentials", "key"]
OTHERS = ["commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "guid", "id", "revision", "hash", "card", "phone", "call", "order", "invoice", "version", "file", "url", "see", "mail", "email"]
PLACEHOLDERS = [
    "example", "sample", "dummy", "placeholder", "changeme", "change", "your", "here", "test", "fake", "token", "secret", "password", "key", "api",
    "access", "user", "name", "default", "value", "insert", "replace", "none", "null", "xxxx", "aaaa", "0000", "1234", "abcd", "the", "and", "with", "from",
    "http", "https", "www", "com", "org", "net", "file", "index", "page", "mail", "version", "release", "build", "static", "image", "data", "main", "src",
]
_VALUE = r"[^\s\"'`,;&<>(){}\[\]=:]"
#: A shorter value behind a secret's name; group 1 is the value.
SHORT = rf"(?i)(?<![a-z])(?:{'|'.join(map(re.escape, NAMES))})[\"'`]?\s?(?::=|=>|[:=])\s?[\"'`]?((?=[^0-9\s]{{0,64}}[0-9]){_VALUE}{{8,}})"
#: Of values in a word and the ones before it, those in the last word.
_SHORT_LAST = rf"{SHORT}(?=\S*$)"
FEATURES = ["length", "transitions", "distinct", "digits", "letters_run", "dictionary", "hex", "uuid", "slashes", "mail", "login", "quoted", "assigned", "named", "othered", "path"]
TREES, DEPTH, SAMPLE = 15, 7, 4000
#: Words of the dictionary that come from the corpus.
WORDS = 2000


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def _cores(word: Column, before: Column) -> Column:
    """The candidates of a word: its long runs, and short values behind a secret's name that hold no such run."""
    runs = F.regexp_extract_all(word, F.lit(_CORE), F.lit(1))
    short = F.regexp_extract_all(F.concat_ws(" ", before, word), F.lit(_SHORT_LAST), F.lit(1))
    return F.array_distinct(F.concat(runs, F.filter(short, lambda x: ~x.rlike(MAYBE))))


def dictionary(docs: DataFrame, size: int = WORDS) -> list[str]:
    """The size most frequent lower-case words of three letters or more of all texts; ties in order of the alphabet."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word")).where(F.length("word").between(3, 15))
    return [r[0] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect()]


def _covered(core: Column, words: list[str]) -> Column:
    """The letters of core that stand in dictionary words; core is split at case changes and signs."""
    # One literal, which the optimizer splits once.
    known = F.split(F.lit(" ".join(sorted({*words, *PLACEHOLDERS}))), " ")
    parts = F.split(F.lower(F.regexp_replace(core, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
    return F.aggregate(F.filter(parts, lambda x: (F.length(x) > 2) & F.array_contains(known, x)), F.lit(0), lambda n, x: n + F.length(x))


def features(word: Column, before: Column, after: Column, path: Column, words: list[str], core: Column | None = None) -> dict[str, Column]:
    """The features of a candidate: the word, up to three words before it and one after (each joined by spaces), the path, and which part of the word it is (the last candidate, unless given)."""
    core = F.coalesce(F.try_element_at(_cores(word, before), F.lit(-1)), F.lit("")) if core is None else core
    lead = F.split_part(word, core, F.lit(1))
    # The candidate's own part of the word; what precedes it counts only if that part names nothing.
    last = F.regexp_extract(lead, r"([^,;&{}?]*)$", 1)
    named = last.rlike("[A-Za-z]")
    own = F.when(named, last).otherwise(lead)
    before = F.when(named & (last != lead) & (F.length(F.regexp_replace(lead, "[^A-Za-z]", "")) > F.length(F.regexp_replace(last, "[^A-Za-z]", ""))), F.lit("")).otherwise(before)
    size = F.greatest(F.length(core), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[^A-Za-z0-9]", "_"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_replace(kinds, r"(.)\1*", "$1")
    near = F.lower(F.concat_ws(" ", before, own))
    flag = lambda c: c.cast("double")
    return {
        "length": F.length(core).cast("double"),
        "transitions": (F.length(runs) - 1) / size,
        "distinct": F.size(F.array_distinct(F.split(F.lower(core), ""))) / F.least(size, F.lit(36.0)),
        "digits": F.length(F.regexp_replace(core, "[^0-9]", "")) / size,
        "letters_run": F.aggregate(F.split(core, "[^A-Za-z]"), F.lit(0), lambda a, x: F.greatest(a, F.length(x))) / size,
        "dictionary": _covered(core, words) / size,
        "hex": flag(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(core.rlike("(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")),
        "slashes": F.length(F.regexp_replace(core, "[^/.]", "")) / size,
        "mail": flag(F.concat(own, core).contains("@") | F.concat(own, core).contains("://")),
        "login": flag(lead.rlike("://[^/@]*:$") & F.substring(word, F.length(lead) + F.length(core) + 1, F.lit(1)).eqNullSafe("@")),
        "quoted": flag(word.rlike("[\"'`]")),
        "assigned": flag(F.concat_ws(" ", before, own).rlike(r"(?:[:=]>?[ \"'`]*|bearer )$") | F.lower(before).endswith("bearer")),
        "named": flag(near.rlike(rf"(?:^|[^a-z])(?:\w*_)?(?:{_any(NAMES)})(?:[^a-z]|$)")),
        "othered": flag(near.rlike(rf"(?:^|[^a-z])(?:{_any(OTHERS)})(?:[^a-z]|$)")),
        "path": flag(F.coalesce(F.lower(path), F.lit("")).rlike(r"test|example|sample|fixture|mock|docs?/|\.lock|\.sum")),
    }


def labelled_findings(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """n made-up findings (word, before, after, path, label) and a quarter as many short ones, the same on every run."""
    i = F.col("id").cast("string")
    hexes = F.sha2(F.concat(F.lit("finding "), i), 512)
    base = F.regexp_replace(F.base64(F.unhex(hexes)), r"[\s=]", "")
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (draw(k, len(xs)) + 1).cast("int"))
    text = lambda k: pick(k, ["the order of", "and then in", "one of these", "est une de", "und der von", "la de los", "this is a", "is, that."])
    name = F.concat(pick(1, ["", "", "", "my_", "app_", "prod_"]), pick(2, NAMES))
    name = F.when(draw(3, 4) == 0, F.upper(name)).otherwise(name)
    quote, tail = pick(4, ['"', '"', '"', "'", ""]), pick(5, ["", "", "", ",", ";", "###", "!!", "***"])
    sign = pick(6, ["=", "=", ":", ":=", "=>"])
    key = F.element_at(F.array(
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 40), F.substring(hexes, 9, 32), hexes, F.upper(F.substring(hexes, 1, 40)), F.substring(base, 1, 40),
        F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(base, "+/", "XY"), 1, 16))), F.concat(F.lit("ghp_"), F.substring(F.translate(base, "+/", "xy"), 1, 36)),
        F.concat(F.lit("sk-"), F.substring(F.translate(base, "+/", "xy"), 1, 48)), F.concat(F.lit("eyJ"), F.substring(base, 1, 30), F.lit("."), F.substring(base, 20, 40)),
    ), (draw(7, 10) + 1).cast("int"))
    letters = F.translate(F.substring(base, 3, 40), "0123456789+/", "kQzXwJvYqGpR")
    key = F.when(draw(23, 6) == 0, letters).otherwise(key)
    number = F.translate(hexes, "abcdef", "031425")
    lower = F.translate(hexes, "0123456789", "etaoinshrd")
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    not_key = F.element_at(F.array(
        F.substring(hexes, 1, 40), hexes, F.substring(hexes, 1, 32), uuid, F.substring(number, 1, 16), F.substring(number, 1, 20), F.concat(F.substring(lower, 1, 24), F.substring(number, 1, 1)),
        F.concat(F.substring(number, 1, 2), F.lit("@mail"), F.substring(number, 3, 1), F.lit(".example.com")), F.concat(F.lit("https://"), F.substring(lower, 1, 7), F.lit(".example.com/en/"), F.substring(number, 1, 3)),
        F.concat(F.lit("src/test/"), F.substring(lower, 1, 9), F.lit("/v"), F.substring(number, 1, 2), F.lit(".py")), F.lit("example-api-key-12345678"), F.lit("your_secret_token_here_1234"), F.lit("xxxxxxxxxxxxxxxx0000"),
        F.substring(lower, 1, 18), F.substring(lower, 3, 26), F.concat_ws("-", F.substring(lower, 1, 6), F.substring(lower, 7, 4), F.substring(lower, 11, 8)), F.concat(F.initcap(F.substring(lower, 1, 8)), F.initcap(F.substring(lower, 9, 12))), F.concat(F.substring(lower, 1, 7), F.lit("..."), F.substring(lower, 9, 9)), F.upper(F.substring(lower, 1, 17)),
        F.lit("your-access-token-goes-here"), F.lit("replace_with_your_password"), F.concat(F.lit("MY_SERVICE_"), F.upper(pick(2, NAMES)), F.lit("_NAME")),
    ), (draw(8, 22) + 1).cast("int"))
    placeholder = draw(8, 22).between(10, 12) | (draw(8, 22) >= 19)
    spaced = draw(9, 3) > 0
    good, in_test = F.col("id") % 2 == 0, draw(10, 9) == 0
    secret_word = F.concat(F.when(spaced, "").otherwise(F.concat(name, sign)), quote, key, quote, tail)
    secret_before = F.when(draw(11, 12) == 0, F.concat(text(12), F.lit(" Bearer"))).when(spaced, F.concat_ws(" ", text(12), name, sign)).otherwise(text(12))
    other_before = F.when(placeholder, F.concat_ws(" ", text(13), name, sign)).when(draw(14, 3) > 0, F.concat_ws(" ", text(13), pick(15, OTHERS), pick(16, ["", "", ":", "="]))).otherwise(text(13))
    rows = spark.range(n).select(
        F.when(good, secret_word).otherwise(F.concat(F.when(placeholder, quote).otherwise(""), not_key, F.when(placeholder, quote).otherwise(""), tail)).alias("word"),
        F.when(good, secret_before).otherwise(other_before).alias("before"), text(17).alias("after"),
        F.when(in_test & ~good, "tests/fixtures/data.txt").otherwise(F.concat(F.lit("src"), draw(18, 20).cast("string"))).alias("path"), good.cast("double").alias("label"),
    )
    # Passwords, and what stands in their place, of 8 to 15 characters.
    secret = F.concat(F.substring(F.translate(base, "+/", "!#"), 1, 7), pick(19, ["7", "2!", "9x", "4#Q", "3pL$", "8rT5", "1wZ6k", "5@mN0q"]))
    stand_in = F.concat(pick(20, ["example", "changeme", "password", "default", "required", "your_key", "optional", "version"]), pick(21, ["1", "12", "123", "1234", "_1", "-2", "01", "00"]))
    stand_in = F.when(draw(22, 4) == 0, F.substring(number, 1, 8)).otherwise(stand_in)
    value = F.concat(F.when(spaced, "").otherwise(F.concat(name, sign)), quote, F.when(good, secret).otherwise(stand_in), quote)
    # Keys in the place of a password in an address, and addresses with long names only.
    host = F.concat(F.lit("https://"), F.substring(lower, 1, 6))
    login = F.when(good, F.concat(host, F.lit(":"), F.substring(key, 1, 20), F.lit("@example.com/x"))).otherwise(F.concat(host, F.lit(".example.com:8080/"), F.substring(lower, 5, 20), F.lit("/"), F.substring(number, 1, 4)))
    logins = spark.range(n // 8).select(login.alias("word"), text(12).alias("before"), text(17).alias("after"), F.concat(F.lit("src"), draw(18, 20).cast("string")).alias("path"), good.cast("double").alias("label"))
    short = spark.range(n // 4).select(value.alias("word"), F.when(spaced, F.concat_ws(" ", text(12), name, sign)).otherwise(text(12)).alias("before"), text(17).alias("after"), F.concat(F.lit("src"), draw(18, 20).cast("string")).alias("path"), good.cast("double").alias("label"))
    return rows.unionByName(logins).where(F.col("word").rlike(MAYBE)).unionByName(short.where(F.size(_cores(F.col("word"), F.col("before"))) > 0))


#: A leaf's class, or (feature, edge, what holds up to the edge, what holds above it).
Tree = float | tuple[str, float, "Tree", "Tree"]


@dataclass
class Forest:
    """The trees, and the dictionary that their features use."""

    trees: list[Tree]
    words: list[str]


def _tree(printed: str) -> Tree:
    lines = [x.strip() for x in printed.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node() -> Tree:
        line = lines.pop(0)
        if found := re.match(r"Predict: (\S+)", line):
            return float(found[1])
        feature, edge = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        lines.pop(0)
        return FEATURES[int(feature)], float(edge), left, node()

    return node()


def _share(forest: Forest, f: Column) -> Column:
    """The share of trees that call a candidate with the features f (a struct) a secret."""

    def of(t: Tree) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(f[t[0]] <= t[1], of(t[2])).otherwise(of(t[3]))

    return reduce(lambda a, b: a + b, map(of, forest.trees)) / float(len(forest.trees))


def train(findings: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A random forest that tells secrets from other candidates.

    findings has word, before, after, path and label (1.0: a secret), a bounded sample; words is the dictionary.
    """
    rows = findings.select(*(c.alias(k) for k, c in features(F.col("word"), F.col("before"), F.col("after"), F.col("path"), words).items()), "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird").fit(rows)
    return Forest([_tree(t) for t in re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):", model.toDebugString)[1:]], words)


def _findings(text: Column, path: Column, forest: Forest, least: float) -> Column:
    """The secrets of a text, as an array of structs."""

    def of(w: Column) -> Column:
        word = lambda i, d: F.coalesce(F.get(w, i - 1 + d), F.lit(""))

        before = lambda i: F.concat_ws(" ", word(i, -3), word(i, -2), word(i, -1))

        def described(i: Column, core: Column) -> Column:
            f = F.struct(*(c.alias(k) for k, c in features(word(i, 0), before(i), word(i, 1), path, forest.words, core).items()))
            scored = F.transform(F.array(f), lambda x: _share(forest, x))[0]
            return F.struct((i - 1).cast("int").alias("word"), core.alias("secret"), scored.alias("score"))

        # A short candidate has a digit, any other a long run.
        maybe = lambda x: (F.length(x) >= 8) & ((F.length(x) >= 16) & x.rlike(MAYBE) | x.rlike("[0-9]"))
        at = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: maybe(F.element_at(w, i)))
        found = F.flatten(F.transform(at, lambda i: F.transform(_cores(word(i, 0), before(i)), lambda core: described(i, core))))
        return F.filter(found, lambda x: x["score"] >= least)

    # The words are bound once, as the one element of an array.
    found = F.transform(F.array(F.split(text, SPACE)), of)[0]
    return F.when(text.rlike(MAYBE) | text.rlike(SHORT), found).otherwise(F.array().cast("array<struct<word:int,secret:string,score:double>>"))


def scan(docs: DataFrame, forest: Forest, least: float = 0.5, path: str = "source") -> DataFrame:
    """docs with a column secrets: for each confirmed secret its word's number, its characters and the forest's score.

    docs has text and, if known, the column named by path; others stay as they are, rows are judged one by one. A null text gives an
    empty array, as does one without candidates. A secret that stands twice is listed twice.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("secrets", _findings(F.coalesce(F.col("text").cast("string"), F.lit("")), where, forest, least))


def redact(docs: DataFrame, forest: Forest, least: float = 0.5, mark: str = "[SECRET]", path: str = "source") -> DataFrame:
    """docs with every confirmed secret in text replaced by the mark; all rows and columns stay. A null text stays null."""
    columns = docs.columns
    out = scan(docs, forest, least, path)
    # The longest first: one secret may be a part of another.
    longest = F.array_sort("secrets", lambda a, b: F.length(b["secret"]) - F.length(a["secret"]))
    clean = F.aggregate(longest, F.col("text"), lambda t, s: F.replace(t, s["secret"], F.lit(mark)))
    return out.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text"))).select(*columns)


def findings(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """(doc_id, word, start, length, secret_sha1, score): a row for each confirmed secret of docs (doc_id, text, source).

    word numbers the text's pieces between white space from 0; start is the 1-based character at which
    the secret stands. Texts without secrets, empty and null ones give no rows, nor does an empty table; repeated rows
    give repeated findings, and a null doc_id stays null. Of equal scores none is preferred: every candidate of half the trees'
    votes or more is told. A text of any length is judged whole, in its row. Other columns, of any name, are ignored.
    """
    rows = scan(docs.select(F.col("doc_id").cast("long"), "text", *(["source"] if "source" in docs.columns else [])), forest, least)
    # Equal secrets are told apart by their number among those before them.
    nth = F.transform("secrets", lambda s, i: F.struct(s.alias("s"), F.size(F.filter(F.slice("secrets", F.lit(1), i), lambda o: o["secret"] == s["secret"])).alias("n")))
    rows = rows.select("doc_id", "text", F.explode(nth).alias("x")).select("doc_id", "text", "x.s", "x.n")
    before = F.array_join(F.slice(F.split(F.col("text"), F.concat(F.lit(r"\Q"), F.col("s.secret"), F.lit(r"\E"))), F.lit(1), F.col("n") + 1), "")
    start = F.length(before) + F.col("n") * F.length("s.secret") + 1
    return rows.select("doc_id", F.col("s.word").alias("word"), start.cast("int").alias("start"), F.length("s.secret").alias("length"), F.sha1("s.secret").alias("secret_sha1"), F.col("s.score").alias("score"))
