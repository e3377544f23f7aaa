"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import job_conf, read
from .embedding_dedup import embedding_dedup
from .langid import language
from .merkle import verified_manifest
from .mixing import mix
from .ngram_join import ngram_join
from .pii import personal_data
from .positional_index import contamination
from .quality_knn import quality
from .quality_rules import quality_rules
from .reply_trees import chat_digest
from .secret_scan import secret_scan
from .vector_packing import pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            job_conf(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


@_query("op2_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS gs FROM w),
u AS (SELECT doc_id, unnest(gs) AS gram FROM g),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM u x JOIN u y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b
      WHERE 5 * n_both >= 4 * (len(ga.gs) + len(gb.gs) - n_both)),
same AS (SELECT a, min(b) AS m FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b
         WHERE n_both = len(ga.gs) AND n_both = len(gb.gs) GROUP BY 1),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT g.doc_id, c.class_id, least(g.doc_id, coalesce(same.m, g.doc_id)) AS copy_id, coalesce(n.n_links, 0) AS n_links,
       len(g.gs) AS n_shingles, g.doc_id = c.class_id AS kept
FROM g JOIN c ON c.a = g.doc_id LEFT JOIN n ON n.a = g.doc_id LEFT JOIN same ON same.a = g.doc_id
""")
def _op2(spark, sf_dir):
    return ngram_join(read(spark, sf_dir, "documents"))


@_query("op10_embedding_near_dedup", r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""")
def _op10(spark, sf_dir):
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


@_query("op4_vector_packing")
def _op4(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op6_cube_mixing")
def _op6(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).drop("row_key", "row_key2")


@_query("op8_quality_neighbour_voting")
def _op8(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query("op5_personal_data")
def _op5(spark, sf_dir):
    return personal_data(read(spark, sf_dir, "documents"))


@_query("op1_host_quality_rules", r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, unnest([0, 1, 2]) AS o(k) WHERE n > 1 GROUP BY 1),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ls WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT w.doc_id, w.source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_lines, 0) AS n_lines,
             coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS f1,
             10 * n_dup_lines > 3 * n_lines AS f2, word_chars < 2 * n_words OR word_chars > 15 * n_words AS f3 FROM c),
h AS (SELECT source, r AS rule, count(*) AS n, sum(CAST([base_failed, f1, f2, f3][r] AS INT)) AS bad FROM j, unnest([1, 2, 3, 4]) AS o(r) GROUP BY 1, 2),
m AS (SELECT rule, sum(bad) / sum(n) AS m, sum(n) AS docs, count(*) AS k FROM h GROUP BY 1),
v AS (SELECT rule, m, sum(n * (bad / n - m) * (bad / n - m)) / any_value(docs) - any_value(k) * m * (1 - m) / any_value(docs) AS between_
      FROM h JOIN m USING (rule) GROUP BY 1, 2),
s AS (SELECT rule, m, least(greatest(CASE WHEN between_ > 0 THEN m * (1 - m) / between_ - 1 ELSE 10000 END, 1), 10000) AS strength FROM v),
r AS (SELECT source, max((bad + m * strength) / (n + strength)) > 0.5 AS host_rejected FROM h JOIN s USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
""")
def _op1(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


@_query("op3_secret_scan")
def _op3(spark, sf_dir):
    return secret_scan(read(spark, sf_dir, "documents"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


@_query("op7_reply_tree_chats", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n,
      length('<|im_start|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + 1
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
""")
def _op7(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    return chat_digest(rows.unionByName(control))


@_query("op9_hyperdimensional_language")
def _op9(spark, sf_dir):
    return language(read(spark, sf_dir, "documents"))


@_query("op12_merkle_manifest", r"""
WITH RECURSIVE d AS (SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
  CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
  list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT) AS crc FROM documents),
l AS (SELECT *, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed FROM d),
o AS (SELECT doc_id, lang, leaf, coalesce(changed, leaf) AS changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM o
  UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
r AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM r
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
w AS (SELECT doc_id, lang, leaf, 0 AS lvl, pos, n, changed AS h, '' AS proof FROM o
  UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM w LEFT JOIN t AS s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
x AS (SELECT w.doc_id, w.leaf, r.subroot, 0 AS lvl, r.pos, r.n, w.h, w.proof FROM w JOIN r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT x.doc_id, x.leaf, x.subroot, x.lvl + 1, x.pos // 2, (x.n + 1) // 2,
    sha256(CASE WHEN x.pos % 2 = 1 THEN s.h || x.h ELSE x.h || coalesce(s.h, '') END), x.proof || coalesce(s.h, '')
  FROM x LEFT JOIN u AS s ON s.lvl = x.lvl AND s.pos = xor(x.pos, 1) WHERE x.n > 1)
SELECT x.doc_id, x.leaf, x.subroot, u.h AS root, sha256(x.proof) AS proof_sha256, x.h AS folded_root, x.h = u.h AS verified
FROM x, u WHERE x.n = 1 AND u.n = 1
""")
def _op12(spark, sf_dir):
    return verified_manifest(read(spark, sf_dir, "documents"))


@_query("op13_positional_decontamination", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i:i+least(len(ws), 10)-1], ' ') AS gram
      FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS r(i) WHERE len(ws) > 0),
s AS (SELECT DISTINCT size FROM g),
w AS (SELECT row, i, size, array_to_string(ws[i:i+size-1], ' ') AS gram FROM d, s, unnest(range(1, len(ws) - size + 2)) AS r(i)),
m AS (SELECT w.row, w.i, w.size, g.item FROM w JOIN g ON g.size = w.size AND g.gram = w.gram),
h AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, size)) AS o(k) GROUP BY 1),
n AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN n USING (row)
""")
def _op13(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query("op11_automaton_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i+m-1], ' ') AS phrase, count(*) AS f FROM w, unnest([1, 2, 3]) AS o(m), unnest(range(1, len(ws) - m + 2)) AS r(i) GROUP BY 1, 2, 3),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 10),
x AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
      FROM c, unnest(range(1, m)) AS o(k) JOIN g AS l ON l.lang = c.lang AND l.m = k AND l.phrase = array_to_string(ws[1:k], ' ')
      JOIN g AS r ON r.lang = c.lang AND r.m = c.m - k AND r.phrase = array_to_string(ws[k+1:c.m], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(ws[j:j+1], ' ') AS phrase, max(a) AS longer FROM c, unnest([1, 2]) AS o(j) WHERE m = 3 GROUP BY 1, 2),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase)
      WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000
""")
def _op11(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))
