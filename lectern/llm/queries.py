"""The corpus operators' queries, each over the whole of its tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, license_scan, quality_rules as quality_rules_module, secret_scan, sentencepiece_lattice
from .common import table
from .decontamination import contaminated
from .jaccard_join import jaccard_components
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .url_filter import url_filter
from .warc import archive_pages

#: A vocabulary file of the BPE kind; a parameter of the operator.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = secret_scan.train(secret_scan.labelled_findings(spark), secret_scan.dictionary(docs))
    return secret_scan.findings(docs, forest)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=13, full=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), MODEL_FILE, full=False).drop("ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_substring_dedup, op3_ngram_jaccard_join, op4_warc, op5_url_filter,
        op6_license_scan, op7_decontamination, op8_language_id, op9_sentencepiece, op10_quality_rules,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _quality_sql() -> str:
    """The quality rules with their sketches as plain counts."""
    tolerances = ", ".join(f"('{k}', {hi}, {'null' if lo is None else lo}::int)" for k, (_, hi, lo) in quality_rules_module.MEASURES.items())
    bins = " union all ".join(f"select lang, source, '{k}' m, {sql.replace(' div ', ' // ')} b from base where not base_failed" for k, (sql, *_) in quality_rules_module.MEASURES.items())
    own = " union all ".join(f"select doc_id, lang, source, '{k}' m, {sql.replace(' div ', ' // ')} b from base where not base_failed" for k, (sql, *_) in quality_rules_module.MEASURES.items())

    def fences(name: str, rows: str, keys: str) -> str:
        return f"""{name} as (select {keys} m, max(s) s, min(case when 4 * u >= s then b end) q1, min(case when 4 * u >= 3 * s then b end) q3
            from (select *, sum(n) over (partition by {keys} m order by b) u, sum(n) over (partition by {keys} m) s from ({rows})) group by {keys} m)"""

    return f"""
        with w as (select doc_id, lang, source, coalesce(text, '') t, {_WORDS} ws from documents),
        win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] k from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) i from w)),
        rep as (select doc_id, count(distinct i + d)::bigint n from (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1), unnest([0, 1, 2]) x(d) group by 1),
        lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from w),
        base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from (select doc_id, lang, source, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(rep.n, 0) n_repeat_words, len(ls)::bigint n_lines from w join lines using (doc_id) left join rep using (doc_id))),
        cnt as (select lang, source, m, b, count(*) n from ({bins}) group by all),
        {fences("f0", "cnt", "lang, source,")}, {fences("f1", "select lang, m, b, sum(n) n from cnt group by all", "lang,")}, {fences("f2", "select m, b, sum(n) n from cnt group by all", "")},
        tol(m, hi, lo) as (values {tolerances}),
        lim as (select f0.lang, f0.source, f0.m, q3 + {quality_rules_module.SPREAD} * (q3 - q1) + hi most, q1 - {quality_rules_module.SPREAD} * (q3 - q1) - lo low from (select f0.lang, f0.source, f0.m,
            case when f0.s >= {quality_rules_module.LEAST} then f0.q1 when f1.s >= {quality_rules_module.LEAST} then f1.q1 else f2.q1 end q1, case when f0.s >= {quality_rules_module.LEAST} then f0.q3 when f1.s >= {quality_rules_module.LEAST} then f1.q3 else f2.q3 end q3
            from f0 join f1 on f0.lang is not distinct from f1.lang and f0.m = f1.m join f2 on f0.m = f2.m) f0 join tol using (m)),
        bad as (select distinct o.doc_id from ({own}) o join lim on o.lang is not distinct from lim.lang and o.source is not distinct from lim.source and o.m = lim.m where o.b > most or o.b < low)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null as kept from base left join bad using (doc_id)"""


#: Levels of the doubling: windows of 13 words, twice, four times ... up to 13 * 2^14.
_LEVELS = 15


def _doubled_sql() -> str:
    """The windows of each level that occur in two documents; those of level 0 are l0."""
    again = "qualify min(doc_id) over (partition by k) < max(doc_id) over (partition by k)"
    steps = [f"l0 as (select doc_id, i, md5(k) k from win {again})"]
    steps += [f"l{n} as (select * from (select a.doc_id, a.i, md5(a.k || b.k) k from l{n - 1} a join l{n - 1} b on a.doc_id = b.doc_id and b.i = a.i + {13 << (n - 1)}) {again})" for n in range(1, _LEVELS)]
    every = " union all ".join(f"select doc_id, {13 << n} s from l{n}" for n in range(_LEVELS))
    return ", ".join(steps) + f", longest as (select doc_id, max(s)::bigint longest_repeat from ({every}) group by doc_id)"


ORACLE_SQL: dict[str, str] = {
    "op10_quality_rules": _quality_sql(),
    "op2_substring_dedup": f"""
        with w as (select doc_id, {_WORDS} ws from documents),
        win as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') k from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) i from w)),
        first as (select k, min(doc_id) f from win group by k),
        gone as (select distinct doc_id, i + d j from win join first using (k), unnest(generate_series(0, 12)) t(d) where f < doc_id),
        word as (select doc_id, unnest(generate_series(1, len(ws))) j, unnest(ws) x from w),
        kept as (select doc_id, string_agg(x, ' ' order by j) t, count(*) n from word anti join gone using (doc_id, j) group by doc_id),
        {_doubled_sql()}
        select doc_id, len(ws)::bigint n_words, len(ws)::bigint - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256, longest_repeat from w left join kept using (doc_id) left join longest using (doc_id)""",
    "op3_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
        s as (select doc_id, list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) ks from w),
        e as (select doc_id, len(ks) n, unnest(ks) k from s),
        f as (select doc_id, k from (select *, row_number() over (partition by doc_id order by c, k) o from (select *, count(*) over (partition by k) c from e)) where o <= n - (9 * n + 9) // 10 + 1),
        p as (select distinct a.doc_id x, b.doc_id y from f a join f b on a.k = b.k and a.doc_id < b.doc_id),
        l as (select x, y from (select x, y, len(list_intersect(a.ks, b.ks)) n, len(a.ks) + len(b.ks) m from p join s a on a.doc_id = x join s b on b.doc_id = y) where 100 * n >= 90 * (m - n)),
        r(a, b) as (select doc_id, doc_id from s union select r.a, case when l.x = r.b then l.y else l.x end from r join l on l.x = r.b or l.y = r.b)
        select doc_id, len(ks)::bigint n_shingles, m component_id from s join (select a, min(b) m from r group by 1) on a = doc_id""",
    "op4_warc": """
        with p as (select page_id, coalesce(html, '') t from pages),
        d as (select page_id, strlen(t)::bigint b, sha1(t) h from p),
        g as (select *, case when b >= 1000 then max(page_id) over (partition by h, b) else page_id end m from d)
        select page_id, b payload_bytes, h payload_digest, case when page_id < m then 'revisit' else 'response' end record_type, case when page_id < m then m end refers_to from g""",
    "op5_url_filter": r"""
        with recursive u as (select page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
        rules(rule, host, path, action) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        edge as (select regexp_replace(url, '(?s)#.*', '') a, regexp_replace(regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '(?s)#.*', '') b from u where html ilike '%canonical%'),
        node as (select regexp_replace(url, '(?s)#.*', '') x from u union select b from edge where b <> ''),
        reach(x, y) as (select x, x from node union select r.x, case when e.a = r.y then e.b else e.a end from reach r join edge e on (e.a = r.y or e.b = r.y) where e.b <> ''),
        judged as (select x, (select r.action from rules r where (h = r.host or h like '%.' || r.host) and starts_with(p, r.path) order by length(r.rule) desc limit 1) action
            from (select x, lower(regexp_extract(x, '(?s)^.*?://([^/?#]*)', 1)) h, regexp_extract(x, '(?s)^.*?://[^/?#]*([^?#]*)', 1) p from node)),
        hit as (select distinct r.x from reach r join judged j on j.x = r.y where j.action = 'block' and r.x <> r.y)
        select u.page_id, u.host, u.path, b.rule, coalesce(b.action, case when hit.x is not null then 'block' else 'allow' end) verdict
        from u left join (select u.page_id, max_by(r.rule, length(r.rule)) rule, max_by(r.action, length(r.rule)) action from u join rules r on (u.host = r.host or u.host like '%.' || r.host) and starts_with(u.path, r.path) group by 1) b using (page_id)
        left join hit on hit.x = regexp_replace(u.url, '(?s)#.*', '')""",
}
