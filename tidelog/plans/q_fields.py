"""Queries for regex field extraction (O10-O16) over ``pages.url``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.extract import extract_by_source, extract_fields
from .registry import query
from ..functions.timefmt import with_field_time
from .tables import events_ts_utc, table

URL_PATTERNS = [
    ("re_url", r"^(?P<scheme>[a-z]+)://(?P<host>[^/?#]+)(?P<path>[^?#]*)"),
    ("tld:host", r"\.(?P<tld>[a-z]+)$"),
    ("site:host", r"(?P<site>[a-z]+)\.example\."),
]

POSITIONAL_PATTERNS = [
    ("p1", r"^(\w+)://([^/]+)/(\w+)"),
    ("p2", r"/(\d+)"),
]

STOP_PATTERNS = [
    ("secure", r"^(?P<scheme>https)://"),
    ("host", r"://(?P<host>[^/?#]+)"),
    ("sub:host", r"^(?P<sub>m|blog|www)\."),
    ("query", r"\?(?P<query>.+)$"),
]

OPTIONAL_PATTERNS = [
    ("url", r"^(?P<scheme>[a-z]+)://(?P<sub>(?:m|blog)\.)?(?P<host>[^/?#]+)"),
]


def _pages_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("seq"), "page_id",
        F.col("url").alias("event_text"))


def _n_fields():
    return F.size("fields").cast("bigint").alias("n_fields")


def _f(k, alias=None):
    return F.element_at(F.col("fields"), F.lit(k)).alias(alias or k)


@query("url_fields", "O10 O11 O13 O16", oracle=r"""
WITH a AS (
  SELECT page_id, url,
         regexp_matches(url, '^([a-z]+)://([^/?#]+)([^?#]*)') AS m1,
         regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 2) AS h
  FROM pages),
b AS (SELECT *, m1 AND regexp_matches(h, '\.([a-z]+)$') AS m2 FROM a),
c AS (SELECT *, m2 AND regexp_matches(h, '([a-z]+)\.example\.') AS m3 FROM b)
SELECT page_id,
       CASE WHEN m1 THEN regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 1) END AS scheme,
       CASE WHEN m1 THEN h END AS host,
       CASE WHEN m1 THEN regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 3) END AS path,
       CASE WHEN m2 THEN regexp_extract(h, '\.([a-z]+)$', 1) END AS tld,
       CASE WHEN m3 THEN regexp_extract(h, '([a-z]+)\.example\.', 1) END AS site,
       CAST(CASE WHEN m1 THEN 3 ELSE 0 END + CASE WHEN m2 THEN 1 ELSE 0 END
            + CASE WHEN m3 THEN 1 ELSE 0 END AS BIGINT) AS n_fields
FROM c
""")
def url_fields(spark, sf_dir):
    df = extract_fields(_pages_lines(spark, sf_dir), URL_PATTERNS)
    return df.select("page_id", _f("scheme"), _f("host"), _f("path"), _f("tld"), _f("site"), _n_fields())


@query("positional_fields", "O12 O16", oracle=r"""
WITH a AS (
  SELECT page_id, url, regexp_matches(url, '^(\w+)://([^/]+)/(\w+)') AS m1 FROM pages),
b AS (SELECT *, m1 AND regexp_matches(url, '/(\d+)') AS m2 FROM a)
SELECT page_id,
       CASE WHEN m2 THEN regexp_extract(url, '/(\d+)', 1)
            WHEN m1 THEN regexp_extract(url, '^(\w+)://([^/]+)/(\w+)', 1) END AS f1,
       CASE WHEN m1 THEN regexp_extract(url, '^(\w+)://([^/]+)/(\w+)', 2) END AS f2,
       CASE WHEN m1 THEN regexp_extract(url, '^(\w+)://([^/]+)/(\w+)', 3) END AS f3,
       CAST(CASE WHEN m1 THEN 3 ELSE 0 END AS BIGINT) AS n_fields
FROM b
""")
def positional_fields(spark, sf_dir):
    df = extract_fields(_pages_lines(spark, sf_dir), POSITIONAL_PATTERNS)
    return df.select("page_id", _f("1", "f1"), _f("2", "f2"), _f("3", "f3"), _n_fields())


@query("stop_rule", "O15 O13", oracle=r"""
WITH a AS (
  SELECT page_id, url, regexp_matches(url, '^(https)://') AS m1 FROM pages),
b AS (SELECT *, m1 AND regexp_matches(url, '://([^/?#]+)') AS m2,
             regexp_extract(url, '://([^/?#]+)', 1) AS h FROM a),
c AS (SELECT *, m2 AND regexp_matches(h, '^(m|blog|www)\.') AS m3 FROM b),
d AS (SELECT *, m3 AND regexp_matches(url, '\?(.+)$') AS m4 FROM c)
SELECT page_id,
       CASE WHEN m1 THEN 'https' END AS scheme,
       CASE WHEN m2 THEN h END AS host,
       CASE WHEN m3 THEN regexp_extract(h, '^(m|blog|www)\.', 1) END AS sub,
       CASE WHEN m4 THEN regexp_extract(url, '\?(.+)$', 1) END AS query,
       CAST(CASE WHEN m1 THEN 1 ELSE 0 END + CASE WHEN m2 THEN 1 ELSE 0 END
            + CASE WHEN m3 THEN 1 ELSE 0 END + CASE WHEN m4 THEN 1 ELSE 0 END AS BIGINT) AS n_fields
FROM d
""")
def stop_rule(spark, sf_dir):
    df = extract_fields(_pages_lines(spark, sf_dir), STOP_PATTERNS)
    return df.select("page_id", _f("scheme"), _f("host"), _f("sub"), _f("query"), _n_fields())


@query("optional_groups", "O11 O16 (absent group -> NULL)", oracle=r"""
SELECT page_id,
       regexp_extract(url, '^([a-z]+)://((?:m|blog)\.)?([^/?#]+)', 1) AS scheme,
       NULLIF(regexp_extract(url, '^([a-z]+)://((?:m|blog)\.)?([^/?#]+)', 2), '') AS sub,
       regexp_extract(url, '^([a-z]+)://((?:m|blog)\.)?([^/?#]+)', 3) AS host,
       CAST(CASE WHEN regexp_matches(url, '^([a-z]+)://((?:m|blog)\.)?([^/?#]+)') THEN 3 ELSE 0 END AS BIGINT)
         AS n_fields
FROM pages
""")
def optional_groups(spark, sf_dir):
    df = extract_fields(_pages_lines(spark, sf_dir), OPTIONAL_PATTERNS)
    return df.select("page_id", _f("scheme"), _f("sub"), _f("host"), _n_fields())


SOURCE_SETS = {
    "click": ([("entry", r"t=(?P<when>\d{10}) id=(?P<num>\d+)"), ("last:num", r"(?P<digit>\d)$")], "when"),
    "view": ([("entry", r"^(\d+) at (\d{10})")], "2"),
    "purchase": ([("entry", r"^(\d+) at (\d{10})")], "2"),
}


@query("source_patterns", "O10 O12 O13 O27 (a pattern set and time field per source)", oracle="""
SELECT event_id, event_type,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(event_id AS VARCHAR) END AS num,
       CASE WHEN event_type = 'click' THEN right(CAST(event_id AS VARCHAR), 1) END AS digit,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) END AS secs,
       CAST(CASE WHEN event_type = 'click' THEN 3 WHEN event_type IN ('view', 'purchase') THEN 2 ELSE 0 END AS BIGINT) AS n_fields
FROM events
""")
def source_patterns(spark, sf_dir):
    """Clicks are written in one form, all others in another; sources without a set get no fields."""
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    secs, num = F.unix_seconds("ts").cast("string"), F.col("event_id").cast("string")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("t="), secs, F.lit(" id="), num)).otherwise(F.concat(num, F.lit(" at "), secs))
    lines = ev.select("event_id", "event_type", text.alias("event_text"))
    df = with_field_time(extract_by_source(lines, SOURCE_SETS, source_col="event_type"), F.col("parse_time"))
    return df.select("event_id", "event_type", F.coalesce(_f("num"), F.element_at("fields", F.lit("1"))).alias("num"), _f("digit"),
                     F.unix_seconds("event_time").alias("secs"), _n_fields())


LONG_PATTERNS = [("value", r'^"(?P<s>(?:[^"\\]|\\.)*)" (?P<rest>\w+ \d+ \w+)$'), ("head:s", r"^(?P<head>(?:[^A-Z\\]|\\.)*)")]
LONG_CHARS = 80_000


@query("long_values", "O10 O11 O13 (loops over alternations on values of 80,000 characters and more)", oracle=r"""
WITH v AS (SELECT page_id, repeat(replace(replace(html, '\', '\\'), '"', '\"'), CAST(80000 // greatest(length(html), 1) + 1 AS BIGINT)) AS s FROM pages),
m AS (SELECT page_id, '"' || s || '" page ' || page_id || ' end' AS line FROM v),
x AS (SELECT page_id, regexp_extract(line, '(?s)^"((?:[^"\\]|\\.)*)" (\w+ \d+ \w+)$', ['s', 'rest']) AS f FROM m)
SELECT page_id, length(f.s) AS n_chars, md5(f.s) AS s_md5, f.rest AS rest, CAST(length(regexp_extract(f.s, '(?s)^((?:[^A-Z\\]|\\.)*)', 1)) AS BIGINT) AS head_chars FROM x
""")
def long_values(spark, sf_dir):
    """Each page as an escaped, quoted value of a line, repeated to ``LONG_CHARS`` at least."""
    escaped = F.replace(F.replace("html", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    times = (F.lit(LONG_CHARS) / F.greatest(F.length("html"), F.lit(1))).cast("int") + 1
    line = F.concat(F.lit('"'), F.repeat(escaped, times), F.lit('" page '), F.col("page_id").cast("string"), F.lit(" end"))
    df = extract_fields(table(spark, sf_dir, "pages").select("page_id", line.alias("event_text")), LONG_PATTERNS)
    df = df.select("page_id", _f("s"), _f("rest"), _f("head"))
    return df.select("page_id", F.length("s").cast("bigint").alias("n_chars"), F.md5(F.col("s").cast("binary")).alias("s_md5"), "rest",
                     F.length("head").cast("bigint").alias("head_chars"))


CLASS_PATTERNS = [("a", r"^\W*(?P<word>\w+)(?P<gap>\W+)(?P<next>\w+)"), ("b", r"\s(?P<run>\S+)$"), ("c", r"(?i)\b(?P<the>K\w*)\b")]
_W, _S = r"\p{L}\p{N}_", r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query("unicode_classes", "O10 O11 O15 (Python's word and space characters)", oracle=rf"""
WITH l AS (SELECT doc_id, translate(replace(replace(text, 'a', 'a' || chr(769)), ' t', chr(28) || 't'), 'n', chr(8255)) || chr(133) || 'end' || chr(8205) || chr(178) AS line FROM documents),
a AS (SELECT doc_id, line, regexp_extract(line, '^[^{_W}]*([{_W}]+)([^{_W}]+)([{_W}]+)', ['word', 'gap', 'next']) AS f,
             regexp_matches(line, '^[^{_W}]*([{_W}]+)([^{_W}]+)([{_W}]+)') AS m1 FROM l),
b AS (SELECT *, m1 AND regexp_matches(line, '[{_S}]([^{_S}]+)$') AS m2, regexp_extract(line, '[{_S}]([^{_S}]+)$', 1) AS r FROM a),
c AS (SELECT *, m2 AND regexp_matches(line, '(?:^|[^{_W}])([Kk\x{{212A}}][{_W}]*)') AS m3,
             regexp_extract(line, '(?:^|[^{_W}])([Kk\x{{212A}}][{_W}]*)', 1) AS k FROM b)
SELECT doc_id, CASE WHEN m1 THEN f.word END AS word, CASE WHEN m1 THEN f.gap END AS gap, CASE WHEN m1 THEN f.next END AS next,
       CASE WHEN m2 THEN r END AS run, CASE WHEN m3 THEN k END AS the FROM c
""")
def unicode_classes(spark, sf_dir):
    """Document texts with combining accents, file separators, undertie marks, a next-line mark and a superscript."""
    line = F.replace(F.replace(F.replace("text", F.lit("a"), F.lit("a\u0301")), F.lit(" t"), F.lit("\x1ct")), F.lit("n"), F.lit("\u203f"))
    line = F.concat(line, F.lit("\x85end\u200d\u00b2"))
    df = extract_fields(table(spark, sf_dir, "documents").select("doc_id", line.alias("event_text")), CLASS_PATTERNS)
    return df.select("doc_id", _f("word"), _f("gap"), _f("next"), _f("run"), _f("the"))
