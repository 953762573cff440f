"""The engine's queries over the driver's tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.alignment import common_words
from .functions.references import FindReferences
from .operators import activity, changes, layout, ranges, study
from .plans import search as ft

LAST_DAY = "2024-01-30"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that must give the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class T:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def index_of(spark: SparkSession, sf_dir: str) -> ft.Index:
    return ft.Index.over(T(spark, sf_dir).documents)


_TOK = r"""tok as (select doc_id, unnest(l) token, unnest(range(len(l))) pos from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') l from documents))"""
_SIZE = r"""size as (select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) dl from documents)"""


def _bm25_sql(leaf_tf: str, match: str, tail: str) -> str:
    """leaf_tf: (doc_id, leaf, tf); match: (doc_id)."""
    return f"""with {_TOK}, {_SIZE}, tf as ({leaf_tf}), hit as ({match}), st as (select count(*) n, avg(dl) m from size), df as (select leaf, count(*) d from tf group by leaf),
        sc as (select tf.doc_id, round(-sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) score
            from tf join hit using (doc_id) join df using (leaf) join size using (doc_id), st group by tf.doc_id)
        {tail}"""


# Full text


@query(f"with {_TOK} select distinct doc_id from tok where token = 'the'")
def fts_term(spark, sf_dir):
    return ft.matching(index_of(spark, sf_dir), ft.parse("the", False).tree)


@query(f"with {_TOK} select distinct doc_id from tok where starts_with(token, 'ther')")
def fts_prefix(spark, sf_dir):
    return ft.matching(index_of(spark, sf_dir), ft.parse("ther*", False).tree)


@query(f"with {_TOK} select distinct a.doc_id from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.token = 'of' and b.token = 'the'")
def fts_phrase(spark, sf_dir):
    return ft.matching(index_of(spark, sf_dir), ft.parse('"of the"', False).tree)


@query(f"with {_TOK} select distinct a.doc_id from tok a join tok b using (doc_id) where a.token = 'with' and b.token = 'from' and abs(a.pos - b.pos) <= 6")
def fts_near(spark, sf_dir):
    return ft.matching(index_of(spark, sf_dir), ft.parse("with ~5 from", False).tree)


@query(f"with {_TOK} select distinct doc_id from tok where token in ('und', 'elle') and doc_id not in (select doc_id from tok where token = 'nicht')")
def fts_or_not(spark, sf_dir):
    return ft.matching(index_of(spark, sf_dir), ft.parse("(und OR elle) -nicht", False).tree)


@query(r"select doc_id from documents where regexp_matches(text, '(^|[^\p{L}\p{N}])The($|[^\p{L}\p{N}])')")
def fts_exact_case(spark, sf_dir):
    q = ft.parse("+The", False)
    index = index_of(spark, sf_dir)
    return ft.checked(ft.matching(index, q.tree), q, index.docs)


@query(r"select doc_id from documents where regexp_matches(text, '(?i)token = .[0-9a-f]{8}')")
def fts_regex(spark, sf_dir):
    q = ft.parse("/token = .[0-9a-f]{8}/i")
    docs = T(spark, sf_dir).documents
    return ft.checked(docs.select("doc_id"), q, docs)


@query(_bm25_sql("select doc_id, token leaf, count(*) tf from tok where token in ('the', 'and') group by all", "select doc_id from tok where token in ('the', 'and') and doc_id not in (select doc_id from tok where token = 'was') group by doc_id having count(distinct token) = 2", "select doc_id, score from sc order by score, doc_id limit 20"))
def fts_bm25_topk(spark, sf_dir):
    return ft.search(index_of(spark, sf_dir), "the and -was", 20, prefix=False)


@query(_bm25_sql("select doc_id, 0 leaf, count(*) tf from tok where starts_with(token, 'thin') group by all", "select distinct doc_id from tok where starts_with(token, 'thin')", "select doc_id, score from sc order by score, doc_id limit 20"))
def fts_prefix_topk(spark, sf_dir):
    return ft.search(index_of(spark, sf_dir), "thin", 20)


@query(f"with {_TOK}, hit as (select distinct doc_id from tok where token = 'of') select facet, value, count(*) n from (select 'lang' facet, lang as value from documents semi join hit using (doc_id) union all select 'source', source from documents semi join hit using (doc_id)) group by all")
def fts_facets(spark, sf_dir):
    return ft.facets(index_of(spark, sf_dir), "of", ["lang", "source"], prefix=False)


@query(f"with {_TOK} select count(*) total from (select doc_id from tok where token in ('of', 'with') group by doc_id having count(distinct token) = 2)")
def fts_total(spark, sf_dir):
    return ft.total(index_of(spark, sf_dir), "of with", prefix=False)


@query(_bm25_sql("select doc_id, token leaf, count(*) tf from tok where token in ('the') group by all", "select distinct doc_id from tok where token = 'the'", "select source, place, doc_id, score from (select source, doc_id, score, row_number() over (partition by source order by score, doc_id) place from sc join documents using (doc_id)) where place <= 3"))
def federated_topk(spark, sf_dir):
    return ft.federated(index_of(spark, sf_dir), "the", "source", 3, prefix=False)


@query(r"""with d as (select doc_id id, -(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))::bigint score from documents where lang = 'es'),
    c as (select conv_id * 1000 + turn id, -strlen(text)::bigint score from conversations),
    u as ((select *, row_number() over (order by score, id) place, 0 list from d order by score, id limit 15) union all (select *, row_number() over (order by score, id) place, 1 list from c order by score, id limit 15))
    select * from u order by score, place, list limit 15""")
def merged_rank_notes(spark, sf_dir):
    t = T(spark, sf_dir)
    docs = t.documents.where("lang = 'es'").select(F.col("doc_id").alias("id"), (-F.size(tx.tokens(F.col("text")))).cast("long").alias("score"))
    convs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (-F.octet_length("text")).cast("long").alias("score"))
    return ft.merged([docs, convs], 15)


@query(r"""with h as (select doc_id, text, lower(text) low from documents where lower(text) like '%pathetic%' order by doc_id limit 20),
    s as (select doc_id, text, greatest(instr(low, 'pathetic') - 80, 1) st from h)
    select doc_id, substr(text, st, 160) raw from s""")
def quote_window(spark, sf_dir):
    docs = T(spark, sf_dir).documents.where(F.lower("text").contains("pathetic")).orderBy("doc_id").limit(20)
    start = F.greatest(F.instr(F.lower("text"), "pathetic") - 80, F.lit(1))
    return docs.select("doc_id", F.substring("text", start, F.lit(160)).alias("raw"))


@query()
def search_page(spark, sf_dir):
    """Top rows first, then their texts: snippet, marked text and quote."""
    index, q = index_of(spark, sf_dir), ft.parse("the with -nicht", False)
    top = ft.search(index, "the with -nicht", 20, prefix=False)
    page = F.broadcast(top).join(index.docs, "doc_id")
    return page.select("doc_id", "score", tx.escape_html(ft.snippet(F.col("text"), q)).alias("snippet"), ft.quote(F.col("text"), ["with"]).alias("quote"))


@query(f"with {_TOK} select token, count(*) n, count(distinct doc_id) docs from tok group by token")
def vocab_counts(spark, sf_dir):
    return index_of(spark, sf_dir).vocabulary()


@query(f"with {_TOK} select token, count(*) n, count(distinct doc_id) docs from tok where starts_with(token, 'hea') group by token order by n desc, token limit 10")
def suggest_words(spark, sf_dir):
    return ft.suggest(index_of(spark, sf_dir).vocabulary(), "hea")


@query(f"with {_TOK}, v as (select token, count(*) n from tok group by token) select token, levenshtein(token, 'thinble') distance, n from v where abs(len(token) - 7) <= 2 and levenshtein(token, 'thinble') between 1 and 2 order by distance, n desc, token limit 5")
def did_you_mean(spark, sf_dir):
    return ft.did_you_mean(index_of(spark, sf_dir).vocabulary(), "thinble")


@query(r"""with d as (select doc_id, text from documents), a as (select doc_id, min(case when regexp_matches(text, '(^|[^\p{L}\p{N}])und($|[^\p{L}\p{N}])') then 0 when contains(lower(text), 'nicht') then 1 end) tier from d group by 1) select doc_id id, tier from a where tier is not null""")
def tiered_search(spark, sf_dir):
    docs = T(spark, sf_dir).documents
    first = docs.where(F.col("text").rlike(r"(?<![\p{L}\p{N}])und(?![\p{L}\p{N}])")).select(F.col("doc_id").alias("id"))
    second = docs.where(F.lower("text").contains("nicht")).select(F.col("doc_id").alias("id"))
    return ft.tiered([first, second])


# Text functions

_HTML = r"""regexp_replace(html, '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?-->', ' ', 'g')"""


@query(rf"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({_HTML}, '(?i)</?(?:{'|'.join(tx.BLOCK_TAGS)})\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) text from pages""")
def html_text(spark, sf_dir):
    return T(spark, sf_dir).pages.select("page_id", tx.html_text(F.col("html")).alias("text"))


@query(r"""select page_id, len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[A-Za-z0-9#]+;', ' ', 'g')), '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) n from pages""")
def page_word_count(spark, sf_dir):
    return T(spark, sf_dir).pages.select("page_id", tx.word_count(F.col("html")).cast("long").alias("n"))


@query(r"""select page_id, link, count(*) n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) link from pages) group by all""")
def link_weights(spark, sf_dir):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return T(spark, sf_dir).pages.select("page_id", links.alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("select conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') html from conversations")
def escape_text(spark, sf_dir):
    return T(spark, sf_dir).conversations.select("conv_id", "turn", tx.escape_html(F.col("text")).alias("html"))


@query(f"with {_TOK} select strip_accents(token) word, count(*) n, count(distinct token) forms from tok where regexp_matches(token, '[éèêç]') group by 1")
def folded_words(spark, sf_dir):
    toks = T(spark, sf_dir).documents.select(F.explode(tx.tokens(F.col("text"))).alias("token")).where(F.col("token").rlike("[éèêç]"))
    return toks.groupBy(tx.fold(F.col("token")).alias("word")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("forms"))


@query()
def stem_groups(spark, sf_dir):
    """Words of one stem: stems are computed once for each distinct word."""
    vocab = index_of(spark, sf_dir).vocabulary().where("docs >= 3").withColumn("stem", tx.stemmed(F.col("token")))
    return vocab.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("forms")).where("forms > 1")


@query()
def find_references(spark, sf_dir):
    """References that the texts of the documents cite, by a table function."""
    rows = T(spark, sf_dir).documents.select("doc_id", "text")
    spark.udtf.register("lectern_find_references", FindReferences)
    rows.createOrReplaceTempView("lectern_reference_rows")
    return spark.sql("select doc_id, r.* from lectern_reference_rows, lateral lectern_find_references(text) r")


@query()
def lcs_alignment(spark, sf_dir):
    """Words in order that each benchmark item has in common with the documents that hold its first words."""
    t = T(spark, sf_dir)
    key = lambda c: F.array_join(F.slice(tx.tokens(F.col(c)), 1, 4), " ")
    items = t.benchmark.select("item_id", F.col("text").alias("item"), key("text").alias("k"))
    docs = t.documents.select("doc_id", "text", tx.tokens(F.col("text")).alias("ts"))
    grams = docs.select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ts") - 3, F.lit(1))), lambda i: F.array_join(F.slice("ts", i, 4), " ")))).alias("k"))
    return grams.join(items, "k").select("item_id", "doc_id", common_words("item", "text").alias("common"))


# Relational operators


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def semi_exists(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.customer.join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select doc_id, source from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def anti_unscanned(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1 union select doc_id from labels where quality = 0)")
def tag_any_of(spark, sf_dir):
    t = T(spark, sf_dir)
    tags = t.labels.select("doc_id", F.explode(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor"), F.when(F.col("quality") == 1, "good"))).alias("tag"))
    return study.any_of(t.documents, "doc_id", tags, ["toxic", "poor"]).select("doc_id", "lang")


@query("select event_type, count(*) n from events where not (value < 10 and event_type = 'error') group by 1")
def soft_delete_live(spark, sf_dir):
    rows = T(spark, sf_dir).events.withColumn("deleted_at", F.expr("if(value < 10 and event_type = 'error', ts, null)"))
    return changes.live(rows).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_partkey, l_suppkey from lineitem where (l_partkey, l_suppkey) in (select l_partkey, l_suppkey from lineitem where l_quantity >= 50) and (l_orderkey, l_linenumber) not in (values (1, 1), (2, 1), (3, 2))")
def row_value_in(spark, sf_dir):
    t = T(spark, sf_dir)
    wanted = t.lineitem.where("l_quantity >= 50").select("l_partkey", "l_suppkey")
    never = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "l_orderkey long, l_linenumber int")
    return t.lineitem.join(wanted, ["l_partkey", "l_suppkey"], "left_semi").join(F.broadcast(never), ["l_orderkey", "l_linenumber"], "left_anti").select("l_orderkey", "l_partkey", "l_suppkey")


@query("select l_suppkey, min(l_orderkey) first, max(l_orderkey) as last, count(*) n from (select *, l_orderkey - row_number() over (partition by l_suppkey order by l_orderkey) g from (select distinct l_suppkey, l_orderkey from lineitem)) group by l_suppkey, g")
def id_runs(spark, sf_dir):
    return ranges.id_runs(T(spark, sf_dir).lineitem, ["l_suppkey"], "l_orderkey")


@query("""with r as (select o_orderpriority k, min(o_orderkey) first, max(o_orderkey) as last from (select *, o_orderkey - row_number() over (partition by o_orderpriority order by o_orderkey) g from orders) group by o_orderpriority, g)
    select k as o_orderpriority, count(*) n from r join lineitem on l_orderkey between first and last group by 1""")
def run_tally(spark, sf_dir):
    t = T(spark, sf_dir)
    return ranges.run_tally(t.lineitem.select("l_orderkey"), "l_orderkey", ranges.id_runs(t.orders, ["o_orderpriority"], "o_orderkey"), "o_orderpriority", 64)


@query("select event_id, o_orderkey from events join (select o_orderkey, date_diff('day', date '1970-01-01', o_orderdate::date) a from orders where o_orderkey % 10 = 0) o on date_diff('day', date '1970-01-01', ts::date) - 9000 between a and a + 3")
def range_point_join(spark, sf_dir):
    t = T(spark, sf_dir)
    day = lambda c: F.datediff(F.to_date(c), F.to_date(F.lit("1970-01-01")))
    spans = t.orders.where("o_orderkey % 10 = 0").select("o_orderkey", day("o_orderdate").alias("a")).withColumn("b", F.col("a") + 3)
    points = t.events.select("event_id", (day("ts") - 9000).alias("p"))
    return ranges.point_pairs(points, "p", spans, "a", "b", 4).select("event_id", "o_orderkey")


@query("select point, count(*) n from (select unnest(generate_series(l_linenumber, l_linenumber + (l_quantity / 10)::int)) point from lineitem) group by 1")
def range_expand_counts(spark, sf_dir):
    rows = T(spark, sf_dir).lineitem.select(F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.rint(F.col("l_quantity") / 10).cast("int")).alias("b"))
    return ranges.expand_counts(rows, "a", "b")


@query("""with m as (select o_orderkey, o_orderkey + 1000000 new_o_orderkey from orders where o_orderstatus = 'F')
    select m.new_o_orderkey o_orderkey, o_custkey, true mapped from orders join m using (o_orderkey) union all select o_orderkey, o_custkey, false from orders anti join m using (o_orderkey)""")
def canonical_union_anti(spark, sf_dir):
    orders = T(spark, sf_dir).orders
    mapping = orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_orderkey") + 1000000).alias("new_o_orderkey"))
    return ranges.canonical(orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], mapping)


@query("""with a as (select l_suppkey, l_returnflag, count(*) n from lineitem group by all), p as (select l_suppkey, n own from a where l_returnflag = 'A'), b as (select l_suppkey, n base from a where l_returnflag = 'R')
    select l_suppkey, own, base from p full join b using (l_suppkey) where own is distinct from base""")
def profile_divergence(spark, sf_dir):
    per = T(spark, sf_dir).lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return ranges.divergence(per.where("l_returnflag = 'A'"), per.where("l_returnflag = 'R'"), ["l_suppkey"], "n")


@query("select p_partkey, k as keyword from part, (values ('steel'), ('red'), ('small')) v(k) where p_name ilike '%' || k || '%' or p_type ilike '%' || k || '%'")
def topic_contains_join(spark, sf_dir):
    part = T(spark, sf_dir).part.withColumn("both", F.concat_ws("\n", "p_name", "p_type"))
    return study.contains_join(part, "both", ["steel", "red", "small"]).select("p_partkey", "keyword")


@query("select l_partkey, count(*) n, count(distinct l_orderkey) passages from lineitem group by 1")
def word_study_counts(spark, sf_dir):
    return study.occurrences(T(spark, sf_dir).lineitem, "l_partkey", ["l_orderkey"])


@query("select l_suppkey, l_returnflag, n from (select *, row_number() over (partition by l_suppkey order by n desc, l_returnflag) r from (select l_suppkey, l_returnflag, count(*) n from lineitem group by all)) where r = 1")
def forms_mode(spark, sf_dir):
    return study.modal_form(T(spark, sf_dir).lineitem, "l_suppkey", "l_returnflag")


@query("""with x as (select p_partkey, 'moved' c from part where p_partkey % 97 = 0), good as (select distinct p_brand from part where p_size > 25),
    w as (select l_suppkey, p_partkey, p_brand from lineitem join part on l_partkey = p_partkey), hit as (select w.l_suppkey from w where p_brand in (select p_brand from good) and p_partkey not in (select p_partkey from x)),
    per as (select l_suppkey, count(*) n from hit group by 1)
    select l_suppkey, n, (select count(*) from per) total_groups, (select sum(n) from per)::bigint total_words from per order by l_suppkey limit 20""")
def coded_dimension_search(spark, sf_dir):
    t = T(spark, sf_dir)
    words = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_partkey", "p_brand")
    codes = t.part.select("p_brand", "p_size").distinct()
    exceptions = t.part.where("p_partkey % 97 = 0").select("p_partkey", F.lit("moved").alias("p_brand"))
    return study.coded_search(words, codes, "p_brand", F.col("p_size") > 25, exceptions, "p_partkey", "l_suppkey", 20)


@query("select p_partkey, p_name, l_orderkey, o_orderdate from part join lineitem on l_partkey = p_partkey join orders on o_orderkey = l_orderkey where p_size = 1")
def concordance(spark, sf_dir):
    t = T(spark, sf_dir)
    words = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("o_orderkey"))
    return study.concordance(t.part.where("p_size = 1").select("p_partkey", "p_name"), words, t.orders.select("o_orderkey", "o_orderdate"), "p_partkey", ["o_orderkey"]).select("p_partkey", "p_name", F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")


@query("select l_suppkey, l_partkey, weight, place from (select *, row_number() over (partition by l_suppkey order by weight desc, l_partkey) place from (select l_suppkey, l_partkey, sum(l_quantity) weight from lineitem group by all)) where place <= 3")
def xref_ranked(spark, sf_dir):
    return study.ranked_references(T(spark, sf_dir).lineitem, "l_suppkey", "l_partkey", "l_quantity", 3)


@query("select a.l_partkey a, b.l_partkey b, count(distinct a.l_orderkey) shared from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey where a.l_orderkey % 20 = 0 group by 1, 2")
def parallels_selfjoin(spark, sf_dir):
    return study.parallels(T(spark, sf_dir).lineitem.where("l_orderkey % 20 = 0"), "l_orderkey", "l_partkey")


@query("select l_partkey, (w * w) // (n * 1000 + 3000) relevance from (select l_partkey, sum((l_quantity * 100)::bigint)::bigint w, max(p_size)::bigint n from lineitem join part on p_partkey = l_partkey group by 1)")
def passage_relevance(spark, sf_dir):
    t = T(spark, sf_dir)
    links = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", (F.col("l_quantity") * 100).cast("long").alias("w"), F.col("p_size").cast("long").alias("n"))
    return study.relevance(links, "l_partkey", "w", "n")


@query(f"""with {_TOK}, c as (select token, lang, count(*) c from tok join documents using (doc_id) group by all), m as (select token, sum(c)::bigint n, max(c) mc, max_by(lang, (c, lang)) lang from c group by token)
    select token, lang, n, round(mc / n, 6) share from m where n >= 3 and round(mc / n, 6) >= 0.9""")
def learned_lexicon(spark, sf_dir):
    words = T(spark, sf_dir).documents.select("lang", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return study.learned_lexicon(words, "lang")


@query()
def nested_orders(spark, sf_dir):
    t = T(spark, sf_dir)
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    return study.nested(t.orders.select("o_orderkey", "o_custkey"), items, "o_orderkey", "l_linenumber", "items")


@query("select key, sum(n)::bigint n from (select o_custkey key, count(*) n from orders group by 1 union all select user_id, count(*) from events group by 1) group by 1")
def union_counts(spark, sf_dir):
    t = T(spark, sf_dir)
    return study.union_counts([t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n")), t.events.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))], "key")


@query("select r_name, n_name, count(c_custkey) customers, count(case when c_acctbal < 0 then 1 end) owing from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all")
def left_join_counts(spark, sf_dir):
    t = T(spark, sf_dir)
    nations = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return nations.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("owing"))


@query("select c_custkey, c_name, c_mktsegment from customer where c_acctbal > 0 and c_name ilike '%1%' order by c_mktsegment is null desc, lower(c_name) nulls first, c_custkey limit 50")
def filtered_page(spark, sf_dir):
    rows = T(spark, sf_dir).customer.where(F.col("c_acctbal") > 0).where(F.col("c_name").ilike("%1%"))
    return rows.orderBy(F.col("c_mktsegment").isNull().desc(), F.lower("c_name").asc_nulls_first(), "c_custkey").limit(50).select("c_custkey", "c_name", "c_mktsegment")


@query("select c_mktsegment, string_agg(distinct n_name, ',' order by n_name) nations from customer join nation on n_nationkey = c_nationkey group by 1")
def grouped_names(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("nations"))


@query("select l_linestatus, l_returnflag, count(*) n, grouping(l_linestatus)::int whole from lineitem group by grouping sets ((l_linestatus), (l_returnflag))")
def facet_grouping_sets(spark, sf_dir):
    t = T(spark, sf_dir)
    t.lineitem.createOrReplaceTempView("lectern_lineitem")
    return spark.sql("select l_linestatus, l_returnflag, count(*) n, cast(grouping(l_linestatus) as int) whole from lectern_lineitem group by grouping sets ((l_linestatus), (l_returnflag))")


@query("select o_custkey from (select o_custkey from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_orderstatus = 'O') except select o_custkey from orders where o_totalprice > 400000")
def set_operations(spark, sf_dir):
    o = T(spark, sf_dir).orders
    k = lambda c: o.where(c).select("o_custkey")
    return k("o_orderpriority = '1-URGENT'").intersect(k("o_orderstatus = 'O'")).subtract(k("o_totalprice > 400000"))


@query("select n_name from nation join customer on c_nationkey = n_nationkey where c_acctbal > 9900 group by n_name having count(*) = 1")
def unique_names(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.nation.join(t.customer.where("c_acctbal > 9900"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n")).where("n = 1").select("n_name")


# Activity


@query(f"select ts::date as day, count(*) n from events where ts::date <= date '{LAST_DAY}' and ts::date > date '{LAST_DAY}' - 14 group by 1")
def heatmap_daily(spark, sf_dir):
    return activity.heatmap(T(spark, sf_dir).events, "ts", LAST_DAY, 14)


@query("select user_id, event_type, last, place from (select *, row_number() over (partition by user_id order by last desc, event_type) place from (select user_id, event_type, max(ts) as last from events group by all)) where place <= 2")
def recent_per_key(spark, sf_dir):
    return activity.recent(T(spark, sf_dir).events, "user_id", "ts", "event_type", 2)


@query("""with d as (select distinct user_id, ts::date as day from events where event_type = 'view'), i as (select *, day - row_number() over (partition by user_id order by day)::int g from d), r as (select user_id, g, count(*) n, max(day) as last from i group by all)
    select user_id, sum(n)::bigint as days, max(n) longest, max_by(n, last) as current from r group by 1""")
def streaks(spark, sf_dir):
    return activity.streaks(T(spark, sf_dir).events.where("event_type = 'view'"), "user_id", "ts")


@query("select event_type, count(*) n, count(distinct user_id) users, count(distinct ts::date) as days from events group by 1")
def stats_dashboard(spark, sf_dir):
    return activity.dashboard(T(spark, sf_dir).events, "ts", "event_type", "user_id")


@query(f"select user_id, count(distinct ts::date) as days from events where ts::date <= date '{LAST_DAY}' and ts::date > date '{LAST_DAY}' - 30 group by 1")
def practice_days(spark, sf_dir):
    return activity.distinct_days(T(spark, sf_dir).events, "user_id", "ts", LAST_DAY)


@query("select date_trunc('week', ts)::date as week, (isodow(ts) - 1)::int as weekday, count(*) n from events group by all")
def weekly_grid(spark, sf_dir):
    return activity.weekly(T(spark, sf_dir).events, "ts")


@query("""with e as (select user_id, event_type = 'purchase' p, floor(value * 60)::bigint words, (event_id % 50 + 10) * 30 secs, ts, event_id from events),
    r as (select *, words / (secs / 60.0) wpm from e where words > 0 qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10)
    select user_id, case when count(*) >= 2 then floor(round(sum(wpm * case when p then 2 else 1 end) / sum(case when p then 2 else 1 end), 6) + 0.5)::bigint end rate, count(*) filter (where p) preachings, count(*) filter (where not p) rehearsals
    from r where wpm between 80 and 220 group by 1""")
def speaking_rate(spark, sf_dir):
    events = T(spark, sf_dir).events.withColumns({"secs": (F.col("event_id") % 50 + 10) * 30, "words": F.floor(F.col("value") * 60)})
    return activity.speaking_rate(events, "user_id", "ts", "words", "secs", F.col("event_type") == "purchase")


@query("""with recursive e as (select user_id, ts, least(5, floor(value / 20))::int q, row_number() over (partition by user_id order by ts, event_id) k from events),
    s(user_id, k, ease, iv, reps) as (select distinct user_id, 0::bigint, 2.5::double, 0, 0 from e
        union all select s.user_id, e.k, greatest(1.3, s.ease + 0.1 - (5 - e.q) * ((5 - e.q) * 0.02 + 0.08)),
            case when e.q < 3 then 1 when s.reps = 0 then 1 when s.reps = 1 then 6 else least(round(s.iv * s.ease), 2147483647)::int end, case when e.q < 3 then 0 else s.reps + 1 end
        from s join e on e.user_id = s.user_id and e.k = s.k + 1),
    z as (select user_id, max(k) k from e group by 1)
    select s.user_id, round(s.ease, 6) ease, s.iv as interval, s.reps, e.ts::date + s.iv due from s join z using (user_id, k) join e using (user_id, k)""")
def sm2_state(spark, sf_dir):
    reviews = T(spark, sf_dir).events.withColumn("q", F.least(F.lit(5), F.floor(F.col("value") / 20)).cast("int"))
    return activity.memory_state(reviews, "user_id", "ts", "q")


@query("select o_orderkey, date '2026-09-11' + (((row_number() over (order by o_orderkey) - 1) * 7) // (select count(*) from orders))::int as date from orders")
def plan_spread(spark, sf_dir):
    orders = T(spark, sf_dir).orders.select("o_orderkey")
    n = orders.count()
    placed = ranges.divide_evenly(orders, ["o_orderkey"], 7, n)
    return placed.select("o_orderkey", F.date_add(F.to_date(F.lit("2026-09-11")), F.col("part").cast("int")).alias("date"))


@query("select o_orderkey, ((row_number() over (order by o_orderkey) - 1) * 30) // (select count(*) from orders) part from orders")
def plan_divide(spark, sf_dir):
    orders = T(spark, sf_dir).orders.select("o_orderkey")
    return ranges.divide_evenly(orders, ["o_orderkey"], 30, orders.count()).select("o_orderkey", "part")


@query("""select n_nationkey, d::date as day from nation, (select d, row_number() over () r from (select unnest(generate_series(date '2026-09-10', date '2026-09-10' + 60, interval 1 day)) d) where isodow(d) <= 5) t where r <= n_nationkey % 7 + 1""")
def weekday_schedule(spark, sf_dir):
    days = activity.weekday_schedule(F.to_date(F.lit("2026-09-10")), F.col("n_nationkey") % 7 + 1, [0, 1, 2, 3, 4])
    return T(spark, sf_dir).nation.select("n_nationkey", F.explode(days).alias("day"))


# Changes


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1 and value >= 15")
def latest_wins(spark, sf_dir):
    log = T(spark, sf_dir).events.select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"), F.expr("if(value < 15, 'D', 'U')").alias("op"))
    return changes.latest(log, ["user_id", "event_type"], "at").select("user_id", "event_type", "value")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 20")
def retention(spark, sf_dir):
    log = T(spark, sf_dir).events.select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return changes.newest(log, ["user_id"], "at", 20).select("user_id", "event_id")


@query("""with own as (select o_orderkey k, o_orderstatus p from orders where o_orderkey % 3 <> 0), ship as (select o_orderkey k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end p from orders where o_orderkey % 4 <> 0), used as (select distinct l_orderkey k from lineitem where l_quantity >= 49)
    select coalesce(own.k, ship.k) as key, case when ship.k is null then case when used.k is not null then 'retire' else 'drop' end when own.k is null then 'add' when own.p <> ship.p then 'repoint' else 'keep' end as action from own full join ship using (k) left join used on used.k = coalesce(own.k, ship.k)""")
def library_sync(spark, sf_dir):
    t = T(spark, sf_dir)
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name")
    own = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("path"), name)
    ship = t.orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("key"), F.expr("if(o_orderkey % 5 = 0, 'X', o_orderstatus)").alias("path"), name)
    used = t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("key"))
    return changes.sync_actions(own, ship, used)


@query("select user_id, count(*) n from events where value % 2 >= 1 and ts < timestamp '2024-01-31' - interval 10 day group by 1")
def trash_expiry(spark, sf_dir):
    rows = T(spark, sf_dir).events.withColumn("deleted_at", F.expr("if(value % 2 >= 1, ts, null)"))
    return changes.expired(rows, "deleted_at", "2024-01-31", 10).groupBy("user_id").agg(F.count("*").alias("n"))


# Layout


@query("select n_nationkey, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(n_nationkey * 3 - 20 - 31.8) / 2), 2) + cos(radians(31.8)) * cos(radians(n_nationkey * 3 - 20)) * pow(sin(radians(n_nationkey * 7 - 35.2) / 2), 2))), 4) km from nation")
def distances(spark, sf_dir):
    lat, lon = F.col("n_nationkey") * 3 - 20, F.col("n_nationkey") * 7
    return T(spark, sf_dir).nation.select("n_nationkey", F.round(layout.haversine(F.lit(31.8), F.lit(35.2), lat, lon), 4).alias("km"))


@query()
def interval_packing(spark, sf_dir):
    """Orders of each customer as bars in at most three rows, the dearest first."""
    orders = T(spark, sf_dir).orders
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1970-01-01"))).cast("double")
    rows = orders.select("o_custkey", F.col("o_orderkey").alias("id"), day.alias("start"), (day + 90).alias("end"), F.col("o_totalprice").alias("priority"))
    return layout.pack_rows(rows, "o_custkey", 3)


@query("select event_id from events where epoch(ts) <= epoch(timestamp '2024-01-10') and epoch(ts) + value >= epoch(timestamp '2024-01-08')")
def interval_overlap(spark, sf_dir):
    rows = T(spark, sf_dir).events.select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double").alias("m"), "value").withColumn("start", F.col("m") / 1e6).withColumn("end", F.col("m") / 1e6 + F.col("value"))
    lo, hi = 1704672000.0, 1704844800.0
    return layout.overlapping(rows, lo, hi).select("event_id")


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


@query("select c_nationkey, c_custkey, place from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) place from customer) where place <= 5")
def topk_per_group(spark, sf_dir):
    return top_per_group(T(spark, sf_dir).customer, "c_nationkey", [F.desc("c_acctbal"), "c_custkey"], 5).select("c_nationkey", "c_custkey", "place")


# Filters, paging, documents of several fields


@query("select event_id, (props->>'$.k')::int k from events where (props->>'$.k')::int >= 90")
def json_attribute(spark, sf_dir):
    props = F.from_json("props", "k int")
    return T(spark, sf_dir).events.select("event_id", props["k"].alias("k")).where("k >= 90")


@query("""with s as (select n_nationkey, case when n_nationkey % 3 > 0 then n_nationkey * 10 end a, case when n_nationkey % 4 > 0 then n_nationkey * 50 end b from nation)
    select n_nationkey, count(*) n from s join customer on (a is null or c_custkey >= a) and (b is null or c_custkey <= b) group by 1""")
def open_ranges(spark, sf_dir):
    """Ranges whose ends may be open (null): points are held to the ends there are."""
    t = T(spark, sf_dir)
    spans = t.nation.select("n_nationkey", F.expr("if(n_nationkey % 3 > 0, n_nationkey * 10, null)").alias("a"), F.expr("if(n_nationkey % 4 > 0, n_nationkey * 50, null)").alias("b"))
    points = t.customer.select(F.col("c_custkey").alias("p"))
    return ranges.point_join(points, "p", spans, "a", "b", 100).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("select p_partkey, p_name from part where starts_with(p_name, 'Part#') and p_name like '%1\\%%' escape '\\' or p_brand like 'Brand#1_'")
def like_patterns(spark, sf_dir):
    part = T(spark, sf_dir).part
    return part.where((F.col("p_name").startswith("Part#") & F.col("p_name").contains("1%")) | F.col("p_brand").like("Brand#1_")).select("p_partkey", "p_name")


@query("select o_orderkey, o_totalprice from orders where (o_totalprice, o_orderkey) < (300000.0, 100) order by o_totalprice desc, o_orderkey desc limit 25")
def keyset_page(spark, sf_dir):
    """The page after a known row: no rows before it are counted."""
    o = T(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    after = (F.col("o_totalprice") < 300000.0) | ((F.col("o_totalprice") == 300000.0) & (F.col("o_orderkey") < 100))
    return o.where(after).orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(25)


@query("select s_suppkey, (select count(*) from lineitem where l_suppkey = s_suppkey) n, coalesce((select max(l_quantity) from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R'), -1.0) most from supplier")
def scalar_subqueries(spark, sf_dir):
    t = T(spark, sf_dir)
    per = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max(F.expr("if(l_returnflag = 'R', l_quantity, null)")).alias("m"))
    return t.supplier.join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("m", F.lit(-1.0)).alias("most"))


_FIELDS_SQL = r"""with f as (select doc_id, 'head' field, regexp_extract_all(lower(substr(text, 1, 80)), '[\p{L}\p{N}]+') ts from documents union all select doc_id, 'body', regexp_extract_all(lower(text), '[\p{L}\p{N}]+') from documents),
    tf as (select doc_id, sum(case field when 'head' then 5.0 else 1.0 end * len(list_filter(ts, lambda x: x = 'the'))) tf, sum(len(ts)) dl from f group by 1),
    st as (select count(*) n, avg(dl) m, count(case when tf > 0 then 1 end) d from tf)
    select doc_id, round(-(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 9) score from tf, st where tf > 0 order by score, doc_id limit 20"""


@query(_FIELDS_SQL)
def bm25_fields(spark, sf_dir):
    """Ranking with field weights: a hit in the head counts five times."""
    docs = T(spark, sf_dir).documents.select("doc_id", tx.tokens(F.substring("text", 1, 80)).alias("head"), tx.tokens(F.col("text")).alias("body"))
    hits = lambda c: F.size(F.filter(c, lambda x: x == "the"))
    rows = docs.select("doc_id", (hits("head") * 5.0 + hits("body")).alias("tf"), (F.size("head") + F.size("body")).alias("dl"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("m"), F.count_if(F.col("tf") > 0).alias("d")).withColumn("one", F.lit(1))
    scored = rows.where("tf > 0").withColumn("one", F.lit(1)).join(stats, "one")
    idf = F.greatest(F.log((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(ft.LEAST_IDF))
    score = F.round(-(idf * F.col("tf") * (ft.K1 + 1) / (F.col("tf") + ft.K1 * (1 - ft.B + ft.B * F.col("dl") / F.col("m")))), 9)
    return scored.select("doc_id", score.alias("score")).orderBy("score", "doc_id").limit(20)


@query("select conv_id, count(*) turns, sum(strlen(text))::bigint bytes, string_agg(role, ',' order by turn) roles from conversations group by 1")
def conversation_outline(spark, sf_dir):
    c = T(spark, sf_dir).conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", "turns", "bytes", F.array_join(F.col("r.role"), ",").alias("roles"))


@query("select doc_id, instr(lower(text), 'the') first, len(regexp_extract_all(lower(text), 'the'))::bigint n from documents where contains(lower(text), 'the')")
def find_in_page(spark, sf_dir):
    docs = T(spark, sf_dir).documents.where(F.lower("text").contains("the"))
    return docs.select("doc_id", F.instr(F.lower("text"), "the").cast("long").alias("first"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("(the)"), F.lit(1))).cast("long").alias("n"))


@query("select o_orderkey, case when d < date '1996-06-01' then 'overdue' when d = date '1996-06-01' then 'today' else 'ahead' end state from (select o_orderkey, o_orderdate::date d from orders) where o_orderkey % 7 = 0")
def due_states(spark, sf_dir):
    day, today = F.to_date("o_orderdate"), F.to_date(F.lit("1996-06-01"))
    state = F.when(day < today, "overdue").when(day == today, "today").otherwise("ahead")
    return T(spark, sf_dir).orders.where("o_orderkey % 7 = 0").select("o_orderkey", state.alias("state"))


@query("""with done as (select l_orderkey k, min(case when l_returnflag = 'N' then l_linenumber end) stop, max(l_linenumber) top from lineitem group by 1) select k as l_orderkey, coalesce(stop, top + 1) - 1 streak from done""")
def completed_prefix(spark, sf_dir):
    """The unbroken run of finished days from the first: up to the day before the first that is open."""
    per = T(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.min(F.expr("if(l_returnflag = 'N', l_linenumber, null)")).alias("stop"), F.max("l_linenumber").alias("top"))
    return per.select("l_orderkey", (F.coalesce("stop", F.col("top") + 1) - 1).alias("streak"))


@query("select event_id, round(year(ts) + (dayofyear(ts) - 1) / 365.0, 6) y from events where event_id % 100 = 0 and year(ts) % 4 <> 0 union all select event_id, round(year(ts) + (dayofyear(ts) - 1) / 366.0, 6) from events where event_id % 100 = 0 and year(ts) % 4 = 0")
def fractional_years(spark, sf_dir):
    days = F.expr("if(year(ts) % 4 = 0, 366.0D, 365.0D)")
    return T(spark, sf_dir).events.where("event_id % 100 = 0").select("event_id", F.round(F.year("ts") + (F.dayofyear("ts") - 1) / days, 6).alias("y"))


@query("select l_orderkey, l_linenumber, last_value(a ignore nulls) over (partition by l_orderkey order by l_linenumber) before, first_value(a ignore nulls) over (partition by l_orderkey order by l_linenumber rows between current row and unbounded following) as after from (select distinct l_orderkey, l_linenumber, case when l_linenumber % 3 = 1 then l_linenumber end a from lineitem where l_orderkey % 25 = 0)")
def nearest_anchor(spark, sf_dir):
    """The nearest anchored word before and after each word."""
    rows = T(spark, sf_dir).lineitem.where("l_orderkey % 25 = 0").select("l_orderkey", "l_linenumber").distinct().withColumn("a", F.expr("if(l_linenumber % 3 = 1, l_linenumber, null)"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", F.last("a", True).over(w).alias("before"), F.first("a", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("after"))


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf_dir):
    """Rows that go with their parents."""
    t = T(spark, sf_dir)
    gone = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where("o_orderstatus = 'F'").join(gone, "o_custkey", "left_semi").select("o_orderkey")


@query("select 'line without order' as problem, count(*) n from lineitem anti join orders on o_orderkey = l_orderkey union all select 'order without customer', count(*) from orders anti join customer on c_custkey = o_custkey union all select 'label without document', count(*) from labels anti join documents using (doc_id)")
def integrity_check(spark, sf_dir):
    """Constraint checks as counts of violations."""
    t = T(spark, sf_dir)
    tests = {
        "line without order": t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "order without customer": t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "label without document": t.labels.join(t.documents, "doc_id", "left_anti"),
    }
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, df in tests.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(r"""select token, n from (select token, count(*) n from (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) token from documents) group by 1) where token in ('the', 'thes', 'theing', 'thed') or (starts_with(token, 'the') and substr(token, 4) in ('s', 'es', 'ed', 'ing', 'eth', 'est'))""")
def headword_forms(spark, sf_dir):
    """A headword with the inflected forms that the corpus has."""
    from .functions.dictionary import inflections

    vocab = index_of(spark, sf_dir).vocabulary()
    return vocab.where(F.col("token").isin([*inflections("the"), "the", "thes", "theing", "thed"])).select("token", "n")
