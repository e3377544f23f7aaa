"""Queries for packing, delivery, back-off and throttles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delivery import backoff, is_transient, outcome, settle
from ..operators.packing import assemble_batches, flush_stats, pack_batches, single_event_batches
from ..operators.throttle import message_tag, throttle
from .registry import query
from .tables import events_ts_utc, table

PACK_MAX = 4000
# Conversations per chunk of the packing scan: a chunk (~16k turns) is what one
# Python worker holds, and the per-role walk reads one small report per chunk.
# Chunk boundaries are exercised by tests/test_packing_delivery.py (widths 1, 7).
PACK_CHUNK = 4096

PACK_CTE = f"""
WITH RECURSIVE items AS (
  SELECT nullif(role, 'system') AS role, conv_id, turn, CAST(coalesce(strlen(text), 0) AS BIGINT) AS sz,
         row_number() OVER (PARTITION BY nullif(role, 'system') ORDER BY conv_id, turn) AS rn
  FROM conversations),
walk AS (
  SELECT role, rn, CAST(0 AS BIGINT) AS batch_no,
         CASE WHEN 1 + sz < {PACK_MAX} THEN sz ELSE -1 END AS cur
  FROM items WHERE rn = 1
  UNION ALL
  SELECT i.role, i.rn,
         CASE WHEN w.cur <> -1 AND w.cur + 1 + i.sz < {PACK_MAX} THEN w.batch_no ELSE w.batch_no + 1 END,
         CASE WHEN w.cur <> -1 AND w.cur + 1 + i.sz < {PACK_MAX} THEN w.cur + 1 + i.sz
              WHEN 1 + i.sz < {PACK_MAX} THEN i.sz ELSE -1 END
  FROM walk w JOIN items i ON i.role IS NOT DISTINCT FROM w.role AND i.rn = w.rn + 1),
packed AS (
  SELECT i.conv_id, i.turn, i.role, i.sz, w.batch_no FROM walk w JOIN items i ON i.role IS NOT DISTINCT FROM w.role AND i.rn = w.rn)"""


def _packed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("role", F.expr("nullif(role, 'system')"))  # a group without a name
    c = c.withColumn("size", F.octet_length("text")).withColumn("chunk", F.floor(F.col("conv_id") / PACK_CHUNK))
    return pack_batches(c, ["role"], ["conv_id", "turn"], "size", "chunk", max_bytes=PACK_MAX, sep=" ")


@query("pack", "O61 O62 O63", oracle=PACK_CTE + """
SELECT conv_id, turn, role, batch_no FROM packed
""")
def pack(spark, sf_dir):
    return _packed(spark, sf_dir).select("conv_id", "turn", "role", "batch_no")


@query("flush_stats", "O68 O73 O63", oracle=PACK_CTE + """
SELECT role, CAST(count(DISTINCT batch_no) AS BIGINT) AS batches,
       CAST(sum(sz) + count(*) - count(DISTINCT batch_no) AS BIGINT) AS bytes,
       CAST(count(*) AS BIGINT) AS items
FROM packed GROUP BY role
""")
def flush_stats_q(spark, sf_dir):
    b = assemble_batches(_packed(spark, sf_dir), ["role"], ["conv_id", "turn"], "text", sep=" ")
    return flush_stats(b, ["role"])


@query("single_event", "O69", oracle="""
SELECT conv_id, turn, role, CAST(1 AS BIGINT) AS items, CAST(strlen(text) AS BIGINT) AS bytes FROM conversations
""")
def single_event(spark, sf_dir):
    return single_event_batches(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "role", "items", "bytes")


# Recorded answers of one flush: none for the batch with this number in its group, 503 for one of 3,900 bytes or more after it.
NO_ANSWER, BUSY_BYTES = 11, 3900


@query("deliver", "O61 O65 O66 O67 O68", oracle=PACK_CTE + f""",
b AS (SELECT role, batch_no, CAST(sum(sz) + count(*) - 1 AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS items FROM packed GROUP BY role, batch_no),
s AS (SELECT *, CASE WHEN batch_no = {NO_ANSWER} THEN NULL WHEN bytes >= {BUSY_BYTES} AND batch_no > 2 THEN 503 WHEN batch_no % 2 = 1 THEN 400 ELSE 200 END AS status FROM b),
o AS (SELECT *, CASE WHEN status IS NULL THEN 'connection_error' WHEN status = 503 THEN 'server_error' ELSE 'ok' END AS outcome FROM s),
f AS (SELECT role, min(batch_no) AS at FROM o WHERE outcome <> 'ok' GROUP BY role)
SELECT o.role, batch_no, bytes, items, status, outcome,
       CASE WHEN f.at IS NULL OR batch_no < f.at THEN 'sent' WHEN batch_no = f.at THEN 'failed' ELSE 'queued' END AS state
FROM o LEFT JOIN f ON o.role IS NOT DISTINCT FROM f.role
""")
def deliver_q(spark, sf_dir):
    """A flush of the packed batches by their recorded answers: which of each group are sent, which one fails, which wait."""
    b = assemble_batches(_packed(spark, sf_dir), ["role"], ["conv_id", "turn"], "text", sep=" ")
    n = F.col("batch_no")
    status = (F.when(n == NO_ANSWER, F.lit(None).cast("int")).when((F.col("bytes") >= BUSY_BYTES) & (n > 2), 503).when(n % 2 == 1, 400).otherwise(200))
    done = settle(b.select("role", "batch_no", "bytes", "items", status.alias("status")), ["role"], ["batch_no"])
    return done.select("role", "batch_no", "bytes", "items", "status", outcome(F.col("status")).alias("outcome"), "state")


@query("outcomes", "O66", oracle="""
SELECT o_orderkey,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
            WHEN o_orderstatus = 'F' THEN 200 WHEN o_orderstatus = 'O' THEN 400 ELSE 503 END AS http_status,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'connection_error'
            WHEN o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'server_error' END AS outcome,
       (o_orderpriority = '1-URGENT' OR o_orderstatus NOT IN ('F', 'O')) AS transient
FROM orders
""")
def outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("int"))
              .when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 400).otherwise(503))
    o = o.select("o_orderkey", status.alias("http_status"))
    out = outcome(F.col("http_status"))
    return o.select("o_orderkey", "http_status", out.alias("outcome"), is_transient(out).alias("transient"))


# Of each group the second step sends what the first left unsent; a group that fails in both ends with a rest.
REQUEUE_1, REQUEUE_2 = 701, 1303


@query("requeue", "O67 O66", oracle=f"""
WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS grp FROM orders),
f1 AS (SELECT grp, min(o_orderkey) AS at FROM o WHERE o_orderkey % {REQUEUE_1} = 0 GROUP BY grp),
s1 AS (SELECT o.*, f1.at IS NULL OR o_orderkey < f1.at AS sent FROM o LEFT JOIN f1 ON o.grp IS NOT DISTINCT FROM f1.grp),
f2 AS (SELECT grp, min(o_orderkey) AS at FROM s1 WHERE NOT sent AND o_orderkey % {REQUEUE_2} = 0 GROUP BY grp)
SELECT o_orderkey, s1.grp, CAST(1 AS INT) AS step, 'sent' AS state FROM s1 WHERE sent
UNION ALL
SELECT o_orderkey, s1.grp, CAST(2 AS INT), CASE WHEN f2.at IS NULL OR o_orderkey < f2.at THEN 'sent' WHEN o_orderkey = f2.at THEN 'failed' ELSE 'queued' END
FROM s1 LEFT JOIN f2 ON s1.grp IS NOT DISTINCT FROM f2.grp WHERE NOT sent
""")
def requeue(spark, sf_dir):
    """Two flush steps over the orders as batches, by their recorded statuses (no answer in step 1, 503 in step 2)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("grp"))
    key = F.col("o_orderkey")
    one = settle(o.withColumn("status", F.when(key % REQUEUE_1 != 0, 200)), ["grp"], ["o_orderkey"])
    left = one.where("state <> 'sent'").drop("state")
    two = settle(left.withColumn("status", F.when(key % REQUEUE_2 == 0, 503).otherwise(200)), ["grp"], ["o_orderkey"])
    done = [x.select("o_orderkey", "grp", F.lit(k).alias("step"), "state") for k, x in ((1, one.where("state = 'sent'")), (2, two))]
    return done[0].unionByName(done[1])


@query("backoff", "O67", oracle="""
WITH RECURSIVE s AS (
  SELECT user_id, event_id, event_type <> 'error' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events),
w AS (
  SELECT user_id, rn, event_id, 'send' AS action,
         CAST(CASE WHEN ok THEN 0 ELSE 2 END AS BIGINT) AS n, CAST(0 AS BIGINT) AS c
  FROM s WHERE rn = 1
  UNION ALL
  SELECT s.user_id, s.rn, s.event_id,
         CASE WHEN w.c < w.n THEN 'skip' ELSE 'send' END,
         CASE WHEN w.c < w.n THEN w.n WHEN s.ok THEN 0 WHEN w.n > 0 THEN w.n * 2 ELSE 2 END,
         CASE WHEN w.c < w.n THEN w.c + 1 ELSE 0 END
  FROM w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
SELECT event_id, user_id, action, n AS skip_steps FROM w
""")
def backoff_q(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("ok"))
    return backoff(ev, ["user_id"], ["event_id"], "ok").select("event_id", "user_id", "action", "skip_steps")


def _throttle_oracle(tag_sql: str, limit_us: int, time_sql: str = "ts") -> str:
    return f"""
WITH RECURSIVE e AS (SELECT event_id, {tag_sql} AS tag, {time_sql} AS ts FROM events),
s AS (
  SELECT event_id, tag, epoch_us(ts) AS t, row_number() OVER (PARTITION BY tag ORDER BY ts, event_id) AS rn
  FROM e WHERE ts IS NOT NULL),
w AS (
  SELECT tag, rn, event_id, true AS kept, t AS clock FROM s WHERE rn = 1
  UNION ALL
  SELECT s.tag, s.rn, s.event_id, s.t - w.clock >= {limit_us},
         CASE WHEN s.t - w.clock >= {limit_us} THEN s.t ELSE w.clock END
  FROM w JOIN s ON s.tag IS NOT DISTINCT FROM w.tag AND s.rn = w.rn + 1)
SELECT event_id, tag, kept FROM w UNION ALL SELECT event_id, tag, NULL FROM e WHERE ts IS NULL
"""


# Every 50th user has no tag, every 37th event no time.
TAG_SQL = "CASE WHEN user_id % 50 <> 0 THEN CAST(user_id AS VARCHAR) END"
TIME_SQL = "CASE WHEN event_id % 37 <> 0 THEN ts END"


def events_with_gaps(spark, sf_dir):
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    return ev.withColumn("ts", F.when(F.col("event_id") % 37 != 0, F.col("ts"))) \
        .withColumn("user", F.when(F.col("user_id") % 50 != 0, F.col("user_id").cast("string")))


@query("throttle", "O71", oracle=_throttle_oracle(TAG_SQL, 86_400_000_000, TIME_SQL))
def throttle_q(spark, sf_dir):
    ev = events_with_gaps(spark, sf_dir).select("event_id", "user", "ts")
    return throttle(ev, F.col("user"), "ts", 86_400, order_cols=["event_id"]) \
        .select("event_id", "tag", "kept")


@query("message_throttle", "O72 O71", oracle=_throttle_oracle(f"concat_ws('|', {TAG_SQL}, event_type)", 3_600_000_000, TIME_SQL))
def message_throttle(spark, sf_dir):
    ev = events_with_gaps(spark, sf_dir).select("event_id", "user", "event_type", "ts")
    return throttle(ev, message_tag("user", "event_type"), "ts", 3_600, order_cols=["event_id"]).select("event_id", "tag", "kept")


@query("queue_sizes", "O73", oracle="""
SELECT role, CAST(count(*) AS BIGINT) AS items, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
       CAST(sum(strlen(text)) + greatest(0, count(*) - 1) AS BIGINT) AS bytes_with_sep
FROM conversations GROUP BY role
""")
def queue_sizes(spark, sf_dir):
    from ..operators.metrics import size_measures
    c = table(spark, sf_dir, "conversations").withColumnRenamed("text", "payload")
    return size_measures(c, ["role"], payload="payload", sep=" ")
