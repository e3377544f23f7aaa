"""Queries for fingerprints and change detection (O07-O09) over ``documents``.

``documents.text`` stands for file content: the current inventory is derived
from it, and an older manifest is derived by a rule per language so that every
kind of change occurs (grown, truncated, replaced, unchanged, new, gone).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.inventory import EMPTY_MD5, detect_changes, head_fingerprint
from .registry import query
from .tables import table


@query("fingerprint", "O08", oracle="""
SELECT doc_id, md5(substr(text, 1, 1024)) AS sig_h, CAST(length(substr(text, 1, 1024)) AS INTEGER) AS sig_b
FROM documents
""")
def fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    h, b = head_fingerprint(F.col("text"))
    return d.select("doc_id", h.alias("sig_h"), b.alias("sig_b"))


def _inventory_and_manifest(spark, sf_dir, every_source=False):
    """Files as they are (those of Spanish documents are gone) and as they were saved (those of ``src3`` were not, unless wanted)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/logs/"), F.coalesce("source", F.lit("")) if every_source else F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".log"))
    size = F.octet_length("text").cast("long")
    mtime = (F.lit(1_700_000_000) + F.col("doc_id")).cast("double")
    inv = d.where(F.col("lang") != "es").select(path.alias("path"), size.alias("size"), mtime.alias("mtime"),
                                               F.col("text").substr(F.lit(1), F.lit(1024)).alias("head"))
    half = F.col("text").substr(F.lit(1), (F.length("text") / 2).cast("int"))
    lang = F.col("lang")
    s_text = F.when(lang == "en", half).otherwise(F.col("text"))
    s_b = F.least(F.lit(1024), F.length(s_text))
    s_h = F.when(lang == "de", F.md5(F.concat(F.lit("x"), s_text.substr(F.lit(1), s_b - 1)))) \
        .otherwise(F.md5(s_text.substr(F.lit(1), s_b)))
    s_size = F.when(lang == "fr", size + 100).otherwise(F.octet_length(s_text).cast("long"))
    s_mtime = F.when(lang.isin("en", "fr", "de"), mtime - 100).otherwise(mtime)
    man = (d if every_source else d.where(F.col("source") != "src3")).select(
        path.alias("path"), s_mtime.alias("mtime"), s_size.alias("pos"), s_size.alias("size"), s_h.alias("sig_h"),
        s_b.alias("sig_b"))
    return inv, man


@query("changes", "O07 O09", oracle=f"""
WITH d AS (
  SELECT '/logs/' || source || '/doc-' || doc_id || '.log' AS path, lang, source,
         CAST(strlen(text) AS BIGINT) AS size, 1700000000 + doc_id AS mtime, text,
         CASE WHEN lang = 'en' THEN substr(text, 1, CAST(trunc(length(text) / 2) AS INTEGER)) ELSE text END AS s_text
  FROM documents),
inv AS (SELECT path, size, mtime, substr(text, 1, 1024) AS head FROM d WHERE lang <> 'es'),
man AS (
  SELECT path,
         CASE WHEN lang IN ('en', 'fr', 'de') THEN mtime - 100 ELSE mtime END AS mtime,
         CASE WHEN lang = 'fr' THEN size + 100 ELSE CAST(strlen(s_text) AS BIGINT) END AS size,
         CASE WHEN lang = 'fr' THEN size + 100 ELSE CAST(strlen(s_text) AS BIGINT) END AS pos,
         CASE WHEN lang = 'de' THEN md5('x' || substr(s_text, 1, least(1024, length(s_text)) - 1))
              ELSE md5(substr(s_text, 1, least(1024, length(s_text)))) END AS sig_h,
         least(1024, length(s_text)) AS sig_b
  FROM d WHERE source <> 'src3'),
j AS (
  SELECT coalesce(inv.path, man.path) AS path,
         coalesce(inv.size, 0) AS cur_size, coalesce(inv.mtime, 0) AS cur_mtime,
         coalesce(man.size, 0) AS s_size, coalesce(man.mtime, 0) AS s_mtime, man.pos,
         md5(substr(coalesce(inv.head, ''), 1, coalesce(man.sig_b, 0))) AS cur_h,
         coalesce(man.sig_h, '{EMPTY_MD5}') AS s_h
  FROM inv FULL OUTER JOIN man ON inv.path = man.path)
SELECT path,
       CASE WHEN cur_mtime > s_mtime AND cur_size < s_size THEN 'truncated'
            WHEN cur_h <> s_h THEN 'replaced'
            WHEN cur_size > 0 AND cur_size > s_size AND cur_mtime >= s_mtime THEN 'grown'
            ELSE 'unchanged' END AS change,
       CAST(CASE WHEN (cur_mtime > s_mtime AND cur_size < s_size) OR cur_h <> s_h
                 THEN CASE WHEN cur_size > 0 THEN 0 END
                 WHEN cur_size > 0 AND cur_size > s_size AND cur_mtime >= s_mtime THEN coalesce(pos, 0) END
            AS BIGINT) AS read_from,
       CAST(cur_size AS BIGINT) AS size
FROM j
""")
def changes(spark, sf_dir):
    inv, man = _inventory_and_manifest(spark, sf_dir)
    return detect_changes(inv, man)
