"""Sets, gap scores from logs, co-clicks, aliases, agreement and the life of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import ascii_words, fitted_body
from tallyloom.operators import boards, capabilities, demand, lifecycle, rules
from tallyloom.sources.tables import bytes_by_kind
from tallyloom.streaming.sync import rebuilt, review_sessions

from .registry import Registry, Tables

plans = Registry()


@plans.add(
    "q50_union_minus",
    """
WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 5000)
SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s)
UNION ALL SELECT 'minus', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)
""",
)
def union_minus(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct()
    s = t.supplier.filter("s_acctbal < 5000").select(F.col("s_nationkey").alias("k")).distinct()
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", c.union(s).distinct()).unionByName(named("intersect", c.intersect(s))).unionByName(named("minus", c.exceptAll(s)))


@plans.add(
    "q51_parent_suppression",
    """
WITH g AS (SELECT p_brand AS brand, p_type AS type, p_size AS size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type, p_size), (p_brand, p_type), (p_brand)) HAVING count(*) >= 3)
SELECT brand, type, size, n FROM g p WHERE size IS NOT NULL
  OR type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g c WHERE c.brand = p.brand AND c.type = p.type AND c.size IS NOT NULL)
  OR type IS NULL AND NOT EXISTS (SELECT 1 FROM g c WHERE c.brand = p.brand AND c.type IS NOT NULL)
""",
)
def parent_suppression(t: Tables) -> DataFrame:
    cells = t.part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return demand.finest_cells(cells, ["brand", "type", "size"], 3)


_DEMAND_SQL = """
s AS (SELECT user_id % 10 AS branch, 'room' || (user_id % 30) AS room, user_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'),
d AS (SELECT branch, room, count(*) FILTER (WHERE event_type = 'error') AS d1, count(*) FILTER (WHERE event_type = 'click') AS d2, count(*) FILTER (WHERE event_type = 'purchase') AS d3,
  count(*) FILTER (WHERE event_type = 'view') AS d4, count(*) FILTER (WHERE event_type = 'signup') AS d5, count(DISTINCT CASE WHEN event_type IN ('error', 'click') THEN day END) AS sessions FROM s GROUP BY 1, 2),
q AS (SELECT *, 3 * d1 + 2.5 * d2 + d3 + 0.5 * ln(1 + d4) + 4 * d5 AS demand FROM d WHERE d5 >= 1 OR d1 + d2 >= 2 AND sessions >= 2)"""


@plans.add(
    "q52_gap_score_v2",
    f"""
WITH {_DEMAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY demand DESC, room) AS place, count(*) OVER (PARTITION BY branch) AS cells FROM q)
SELECT branch, room, round(demand, 3) AS demand, CAST(place AS INTEGER) AS place, greatest(cells - 2, 0) AS suppressed FROM r WHERE place <= 2
""",
)
def gap_score_v2(t: Tables) -> DataFrame:
    kinds = {"error": "zero_result", "click": "refined", "purchase": "reached_past", "view": "browsed", "signup": "requested"}
    signal = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    log = t.events.filter("ts >= TIMESTAMP '2024-01-05 00:00:00'").select(
        (F.col("user_id") % 10).alias("branch"), F.concat(F.lit("room"), (F.col("user_id") % 30).cast("string")).alias("room"), signal.alias("signal"), F.to_date("ts").alias("session")
    )
    top = demand.top_per_branch(demand.scored(log, ["branch", "room"]), "branch", "room", 2)
    return top.select("branch", "room", F.round("demand", 3).alias("demand"), "place", "suppressed")


@plans.add(
    "q53_coclick",
    """
SELECT 'k' || (user_id % 20) AS token, event_id % 25 AS asset_id, round(sum(CASE WHEN event_type = 'click' THEN exp(-date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') / 30.0) END)
  / sum(exp(-date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') / 30.0)), 5) AS rate, count(*) AS shown
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2
""",
)
def coclick(t: Tables) -> DataFrame:
    log = t.events.filter(F.col("event_type").isin("click", "view")).select(
        F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("token"),
        (F.col("event_id") % 25).alias("asset_id"),
        (F.col("event_type") == "click").alias("clicked"),
        F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("age_days"),
    )
    return demand.click_rates(log, 30.0).withColumn("rate", F.round("rate", 5))


@plans.add(
    "q54_alias_pairs",
    r"""
WITH w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS term FROM benchmark),
k AS (SELECT * FROM w WHERE length(term) >= 5), n AS (SELECT term, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n_both FROM k a JOIN k b ON a.item_id = b.item_id AND a.term < b.term GROUP BY 1, 2)
SELECT term_a, term_b, n_both, round(n_both / (x.n + y.n - n_both), 4) AS jaccard FROM c JOIN n x ON x.term = term_a JOIN n y ON y.term = term_b WHERE n_both >= 2 AND n_both / (x.n + y.n - n_both) >= 0.5
""",
)
def alias_pairs(t: Tables) -> DataFrame:
    terms = t.benchmark.select(F.col("item_id").alias("id"), F.explode(ascii_words("text")).alias("term")).filter("length(term) >= 5")
    found = demand.alias_pairs(terms, 2, 0.5)
    return found.withColumn("jaccard", F.round("jaccard", 4))


@plans.add(
    "q55_label_agreement",
    """
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
j AS (SELECT d.lang, l.quality = 1 AS truth, d.n_chars > 400 AS told FROM documents d JOIN l USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE truth AND told) AS tp, count(*) FILTER (WHERE told AND NOT truth) AS fp, count(*) FILTER (WHERE truth AND NOT told) AS fn FROM j GROUP BY 1)
SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 3) AS precision, round(tp / nullif(tp + fn, 0), 3) AS recall FROM c
""",
)
def label_agreement(t: Tables) -> DataFrame:
    truth = t.labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("truth"))
    told = t.documents.select("doc_id", "lang", (F.col("n_chars") > 400).alias("told"))
    return demand.agreement(told.join(truth, "doc_id"), "lang")


@plans.add(
    "q61_token_index",
    r"""
WITH w AS (SELECT item_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS token FROM benchmark)
SELECT token, id, 2 * count(*) AS weight FROM w WHERE token <> '' GROUP BY 1, 2
""",
)
def token_index(t: Tables) -> DataFrame:
    return demand.token_index(t.benchmark.select(F.col("item_id").alias("id"), "text"), {"text": 2})


@plans.add(
    "q62_eviction_order",
    """
WITH r AS (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS upto, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey) AS total,
  CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders)
SELECT o_orderkey, CAST(upto AS BIGINT) AS freed FROM r WHERE upto - b < total - 1000000
""",
)
def eviction(t: Tables) -> DataFrame:
    blobs = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey"), F.col("o_orderdate").alias("created_at"), F.floor("o_totalprice").alias("bytes"))
    return lifecycle.evicted(blobs, "owner", "o_orderkey", 1_000_000).select("o_orderkey", "freed")


@plans.add(
    "q63_transfer_states",
    """
WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, coalesce(before, 'none') AS before, count(*) AS n,
  coalesce(before, 'none') || '>' || event_type IN ('none>view', 'view>click', 'click>purchase', 'click>error', 'error>view') AS legal FROM s GROUP BY 1, 2
""",
)
def transfer_states(t: Tables) -> DataFrame:
    legal = {"none": ("view",), "view": ("click",), "click": ("purchase", "error"), "error": ("view",)}
    steps = t.events.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("place"), F.col("event_type").alias("state"))
    checked = lifecycle.transitions(steps, legal, "none")
    return checked.groupBy(F.col("state").alias("event_type"), "before", "legal").agg(F.count("*").alias("n"))


@plans.add(
    "q64_transfer_gate",
    """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'not_owner' WHEN o_totalprice < 1000 THEN 'no_bytes' WHEN o_orderpriority = '5-LOW' THEN 'metered' ELSE 'go' END AS outcome, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1
""",
)
def transfer_gate(t: Tables) -> DataFrame:
    refusals = {"not_owner": F.col("o_orderstatus") == "P", "no_bytes": F.col("o_totalprice") < 1000, "metered": F.col("o_orderpriority") == "5-LOW"}
    gated = t.orders.withColumn("outcome", lifecycle.first_refusal(refusals))
    return gated.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plans.add(
    "q65_running_offsets",
    """
WITH r AS (SELECT o_orderkey, unnest(range(0, 1 + o_orderkey % 3)) AS i, 100 + o_orderkey % 7 AS size FROM orders)
SELECT o_orderkey, CAST(i AS INTEGER) AS sample, CAST(coalesce(sum(size) OVER (PARTITION BY o_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM r
""",
)
def running_offsets(t: Tables) -> DataFrame:
    table = t.orders.select("o_orderkey", (1 + F.col("o_orderkey") % 3).alias("count"), (100 + F.col("o_orderkey") % 7).alias("size"))
    return lifecycle.sample_offsets(table, "o_orderkey")


@plans.add(
    "q66_token_chain",
    """
WITH t AS (SELECT sha256('invite-' || o_orderkey) AS hash, o_orderkey, o_orderstatus = 'P' AS revoked FROM orders),
asked AS (SELECT event_id, sha256('invite-' || (event_id % 20000)) AS hash FROM events)
SELECT a.event_id, CASE WHEN t.hash IS NULL THEN 'unknown' WHEN t.revoked OR c.c_custkey IS NULL THEN 'refused' ELSE 'ok' END AS outcome, CASE WHEN NOT t.revoked THEN c.c_custkey END AS creator_id
FROM asked a LEFT JOIN t USING (hash) LEFT JOIN orders o ON o.o_orderkey = t.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey
""",
)
def token_chain(t: Tables) -> DataFrame:
    name = lambda c: F.sha2(F.concat(F.lit("invite-"), c.cast("string")), 256)
    tokens = t.orders.select(name(F.col("o_orderkey")).alias("token_hash"), F.col("o_orderkey").alias("collab_id"), F.when(F.col("o_orderstatus") == "P", 1).alias("revoked_at"))
    collabs = t.orders.select(F.col("o_orderkey").alias("collab_id"), F.col("o_custkey").alias("creator_id"))
    creators = t.customer.select(F.col("c_custkey").alias("creator_id"))
    asked = t.events.select("event_id", name(F.col("event_id") % 20000).alias("token_hash"))
    return lifecycle.opened(asked, tokens, collabs, creators).select("event_id", "outcome", "creator_id")


@plans.add(
    "q67_rank_at_event",
    """
WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT event_id, p_partkey, CAST(rank AS INTEGER) AS rank_at_event FROM events LEFT JOIN r ON p_partkey = event_id % 2500 WHERE event_type = 'click'
""",
)
def rank_at_event(t: Tables) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = t.part.select("p_partkey", F.row_number().over(order).alias("rank_at_event"))
    clicks = t.events.filter("event_type = 'click'").select("event_id", (F.col("event_id") % 2500).alias("part"))
    return clicks.join(ranked, F.col("part") == F.col("p_partkey"), "left").select("event_id", "p_partkey", "rank_at_event")


@plans.add(
    "q68_full_merge",
    """
WITH b AS (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_acctbal < 0 GROUP BY 1)
SELECT coalesce(b.k, c.k) AS k, b, c, CASE WHEN b IS NULL THEN 'added' WHEN c IS NULL THEN 'kept' ELSE 'merged' END AS how FROM b FULL JOIN c ON b.k = c.k
""",
)
def full_merge(t: Tables) -> DataFrame:
    base = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    incoming = t.customer.filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("c"))
    return base.join(incoming, "k", "full").select("k", "b", "c", F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "kept").otherwise("merged").alias("how"))


_PARTS_SQL = """
t AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing, p_size FROM part)"""


@plans.add(
    "q69_parse_queries",
    f"""
WITH {_PARTS_SQL}
SELECT p_partkey, CASE WHEN colour IN ('red', 'blue') THEN colour ELSE '' END AS vibe, CASE WHEN thing = 'ring' THEN 'ring' ELSE '' END AS subject,
  concat_ws(' ', CASE WHEN colour NOT IN ('red', 'blue') THEN colour END, CASE WHEN thing <> 'ring' THEN thing END) AS unmapped, 'closeup' AS shot, CAST(p_size AS INTEGER) AS max_s FROM t
""",
)
def parse_queries(t: Tables) -> DataFrame:
    asked = t.part.select("p_partkey", F.concat(F.lit("Show me a close-up of the "), "p_name", F.lit(", under "), F.col("p_size").cast("string"), F.lit("s")).alias("text"))
    parsed = capabilities.parse_queries(asked, {"red": "vibe", "blue": "vibe", "ring": "subject"})
    one = lambda f: F.coalesce(F.get(f"filters.{f}", F.lit(0)), F.lit(""))
    return parsed.select("p_partkey", one("vibe").alias("vibe"), one("subject").alias("subject"), F.array_join("unmapped", " ").alias("unmapped"), one("shot_type").alias("shot"), F.col("duration.max_s").alias("max_s"))


@plans.add(
    "q70_match_complement",
    """
WITH m AS (SELECT l_orderkey AS asset_id, l_partkey AS item_id, CASE WHEN l_returnflag = 'R' THEN 'no' ELSE 'covers' END AS verdict FROM lineitem WHERE l_quantity > 40),
c AS (SELECT p_partkey AS item_id FROM part WHERE p_size < 20)
SELECT 'matched' AS side, count(*) AS n FROM m WHERE item_id IN (SELECT item_id FROM c)
UNION ALL SELECT 'unmatched', count(*) FROM c WHERE item_id NOT IN (SELECT item_id FROM m WHERE verdict <> 'no')
""",
)
def match_complement(t: Tables) -> DataFrame:
    matches = t.lineitem.filter("l_quantity > 40").select(F.col("l_orderkey").alias("asset_id"), F.col("l_partkey").alias("item_id"), F.when(F.col("l_returnflag") == "R", "no").otherwise("covers").alias("verdict"))
    kept, rest = capabilities.matched_and_rest(matches, t.part.filter("p_size < 20").select(F.col("p_partkey").alias("item_id")))
    count = lambda side, df: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count("matched", kept).unionByName(count("unmatched", rest))


@plans.add(
    "q71_retry_budget",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2 AS fails FROM events",
)
def retry_budget(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("user_id").alias("subject_id"), "event_id", F.struct("ts", "event_id").alias("seq"))
    return capabilities.failing_first(calls, 2).select(F.col("subject_id").alias("user_id"), "event_id", "fails")


@plans.add(
    "q72_templates",
    "SELECT c_custkey, 'Dear ' || c_name || ', ' || CASE WHEN c_acctbal < 0 THEN 'not provided' ELSE CAST(c_nationkey AS VARCHAR) END || ' clips wait.' AS text FROM customer",
)
def templates(t: Tables) -> DataFrame:
    waiting = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))
    return t.customer.select("c_custkey", capabilities.filled("Dear {{name}}, {{n}} clips wait.", {"name": F.col("c_name"), "n": waiting}).alias("text"))


@plans.add(
    "q73_stage_board",
    """
SELECT o_orderkey AS collab_id, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS col, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders
""",
)
def stage_board(t: Tables) -> DataFrame:
    collabs = t.orders.select(F.col("o_orderkey").alias("collab_id"), F.col("o_orderstatus").alias("stage"), F.col("o_orderdate").alias("entered_at"))
    return boards.stage_board(collabs, ("O", "P", "F")).select("collab_id", F.col("column").alias("col"), "place")


@plans.add(
    "q74_clip_sheet",
    """
WITH g AS (SELECT l_partkey AS id, list_sort(list_distinct(list(l_linestatus || l_linenumber) FILTER (WHERE l_returnflag = 'A'))) AS h, list_sort(list_distinct(list(l_linestatus || l_linenumber) FILTER (WHERE l_returnflag <> 'A'))) AS m FROM lineitem GROUP BY 1),
u AS (SELECT event_id % 3000 AS id, count(*) AS used FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT p_partkey AS id, coalesce(array_to_string(h, ' '), '') AS human_tags, coalesce(array_to_string(m, ' '), '') AS ai_tags, coalesce(used, 0) AS used FROM part LEFT JOIN g ON g.id = p_partkey LEFT JOIN u ON u.id = p_partkey
""",
)
def clip_sheet(t: Tables) -> DataFrame:
    tags = t.lineitem.select(F.col("l_partkey").alias("asset_id"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("term"), F.when(F.col("l_returnflag") == "A", "human").otherwise("ai").alias("source"))
    usage = t.events.filter("event_type = 'purchase'").select((F.col("event_id") % 3000).alias("asset_id"))
    sheet = boards.clip_sheet(t.part.select(F.col("p_partkey").alias("id")), tags, usage)
    return sheet.select("id", F.array_join("human_tags", " ").alias("human_tags"), F.array_join("ai_tags", " ").alias("ai_tags"), "used")


@plans.add(
    "q75_stale_decisions",
    """
SELECT CASE WHEN o_orderstatus = c.rev THEN 'taken' ELSE 'stale' END AS outcome, count(*) AS n
FROM orders JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS rev FROM orders) c ON k = o_orderkey GROUP BY 1
""",
)
def stale_decisions(t: Tables) -> DataFrame:
    seen = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("rev"))
    current = seen.withColumn("rev", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("rev")))
    decisions = seen.select("id", F.lit("approve").alias("decision"))
    return boards.decided(seen, current, decisions).groupBy("outcome").agg(F.count("*").alias("n"))


@plans.add("q76_bytes_by_kind", "SELECT p_type AS kind, count(*) AS blobs, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1")
def blob_bytes(t: Tables) -> DataFrame:
    return bytes_by_kind(t.part.select(F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")).alias("key"), F.col("p_size").alias("bytes")))


@plans.add(
    "q77_capture_choice",
    """
WITH c AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS a, CASE WHEN o_orderkey % 2 = 0 THEN epoch_ms(o_orderdate) + o_custkey * 1000 END AS b, o_orderkey % 3 = 0 AS sure FROM orders)
SELECT id, CASE WHEN b IS NULL THEN 'mvhd' WHEN sure THEN 'mvhd' ELSE 'udta_day' END AS source, coalesce(b - a, 0) AS disagreement_ms,
  CASE WHEN coalesce(b - a, 0) > 60000 THEN 'low' WHEN sure THEN 'high' ELSE 'assumed' END AS confidence FROM c
""",
)
def capture_choice(t: Tables) -> DataFrame:
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    first = F.struct(at.alias("at_ms"), F.lit("mvhd").alias("source"), (F.col("o_orderkey") % 3 == 0).alias("has_offset"))
    second = F.struct((at + F.col("o_custkey") * 1000).alias("at_ms"), F.lit("udta_day").alias("source"), F.lit(False).alias("has_offset"))
    candidates = F.array_compact(F.array(first, F.when(F.col("o_orderkey") % 2 == 0, second)))
    return t.orders.select(F.col("o_orderkey").alias("id"), rules.capture_choice(candidates).alias("c")).select("id", "c.source", "c.disagreement_ms", "c.confidence")


@plans.add(
    "q78_rotation",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'not_needed' WHEN l_returnflag = 'N' THEN 'we_applied' WHEN l_linenumber % 4 = 2 THEN 'undecidable' WHEN l_returnflag = 'A' THEN 'element_applied' ELSE 'we_applied' END AS source,
  CASE WHEN l_linenumber % 4 <> 0 AND (l_returnflag = 'N' OR l_returnflag = 'R' AND l_linenumber % 4 <> 2) THEN l_linenumber % 4 ELSE 0 END AS quarter_turns FROM lineitem
""",
)
def rotation(t: Tables) -> DataFrame:
    size = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    turns = F.col("l_linenumber") % 4
    reported = F.when(F.col("l_returnflag") == "A", F.when(turns % 2 == 1, size(1080, 1920)).otherwise(size(1920, 1080))).when(F.col("l_returnflag") == "R", size(1920, 1080))
    found = t.lineitem.select("l_orderkey", "l_linenumber", rules.rotation_decision(size(1920, 1080), reported, turns * 90).alias("r"))
    return found.select("l_orderkey", "l_linenumber", "r.source", "r.quarter_turns")


@plans.add(
    "q79_review_sessions",
    "SELECT user_id AS session_id, CAST(max(event_id % 50) AS BIGINT) AS cursor_index, array_to_string(list_sort(list_distinct(list(event_type))), ' ') AS skipped, min(CASE WHEN event_type = 'purchase' THEN ts END) AS completed_at FROM events GROUP BY 1",
)
def sessions(t: Tables) -> DataFrame:
    versions = t.events.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 50).alias("cursor_index"), F.array("event_type").alias("skipped"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("completed_at"))
    return review_sessions(versions).withColumn("skipped", F.array_join("skipped", " "))


@plans.add("q80_rebuilt_projection", "SELECT user_id AS subject_id, event_type AS kind, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def rebuilt_projection(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), "value")
    return rebuilt(runs, ["value"])


HALF_LIFE_MS = 30 * 86_400_000.0
#: The faded sums of all events at the last one's time, and of them by what is asked.
_LOG_SQL = """
e AS (SELECT user_id, 'k' || (user_id % 20) AS token, event_id % 25 AS asset_id, 'f' || (event_id % 25 % 4) AS facet, event_type = 'click' AS clicked, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('click', 'view')),
w AS (SELECT *, pow(0.5, ((SELECT max(ms) FROM e) - ms) / 2592000000.0) AS weight FROM e)"""


def _log(t: Tables) -> DataFrame:
    asset = F.col("event_id") % 25
    return t.events.filter(F.col("event_type").isin("click", "view")).select(
        "user_id", F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("token"), asset.alias("asset_id"), F.concat(F.lit("f"), (asset % 4).cast("string")).alias("facet"),
        (F.col("event_type") == "click").alias("clicked"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.dayofmonth("ts") % 3).alias("batch"),
    )


def _counted(log: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of three batches of days, merged without a second look at the events."""
    return demand.merged_counters([demand.counters(log.filter(F.col("batch") == b), keys, HALF_LIFE_MS) for b in (2, 0, 1)], keys, HALF_LIFE_MS)


@plans.add(
    "q90_decayed_counters",
    f"WITH {_LOG_SQL} SELECT token, asset_id, round(sum(CASE WHEN clicked THEN weight ELSE 0 END), 6) AS clicks, round(sum(weight), 6) AS shown, (SELECT max(ms) FROM e) AS at_ms FROM w GROUP BY 1, 2",
)
def decayed_counters(t: Tables) -> DataFrame:
    return _counted(_log(t), ["token", "asset_id"]).withColumns({c: F.round(c, 6) for c in ("clicks", "shown")}).withColumnRenamed("at", "at_ms")


@plans.add(
    "q91_reranked",
    f"""
WITH {_LOG_SQL},
t AS (SELECT token, asset_id, sum(CASE WHEN clicked THEN weight ELSE 0 END) AS clicks, sum(weight) AS shown FROM w GROUP BY 1, 2),
a AS (SELECT asset_id, sum(CASE WHEN clicked THEN weight ELSE 0 END) AS clicks FROM w GROUP BY 1),
u AS (SELECT user_id, facet, sum(CASE WHEN clicked THEN weight ELSE 0 END) AS clicks FROM w GROUP BY 1, 2),
s AS (SELECT user_id, facet, clicks / nullif(sum(clicks) OVER (PARTITION BY user_id), 0) AS share FROM u),
r AS (SELECT DISTINCT user_id AS query_id, user_id, token, k AS asset_id, 'f' || (k % 4) AS facet, (k * 7 + user_id) % 10 / 10.0 AS score FROM e, range(25) x(k)),
j AS (SELECT r.*, ln(1 + coalesce(a.clicks, 0)) AS prior, 2 * coalesce(t.clicks / (t.shown + 1), 0) AS affinity, coalesce(s.share, 0) AS taste, coalesce(t.shown >= 2 AND t.clicks < 0.5, false) AS demoted
  FROM r LEFT JOIN t USING (token, asset_id) LEFT JOIN a USING (asset_id) LEFT JOIN s ON s.user_id = r.user_id AND s.facet = r.facet),
k AS (SELECT *, (score + prior + affinity + taste) * CASE WHEN demoted THEN 0.5 ELSE 1 END AS ranked FROM j)
SELECT query_id, asset_id, demoted, round(ranked, 6) AS ranked, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(ranked, 9) DESC, asset_id) AS INTEGER) AS place FROM k QUALIFY place <= 5
""",
)
def reranked(t: Tables) -> DataFrame:
    """The five best of 25 assets for each user, by what was clicked for the token, at all, and by that user."""
    log = _log(t)
    asked = log.select("user_id", "token").distinct().select(F.col("user_id").alias("query_id"), "user_id", "token", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("asset_id"))
    results = asked.select("*", F.concat(F.lit("f"), (F.col("asset_id") % 4).cast("string")).alias("facet"), ((F.col("asset_id") * 7 + F.col("user_id")) % 10 / 10.0).alias("score"))
    ranked = demand.reranked(results, _counted(log, ["token", "asset_id"]), _counted(log, ["asset_id"]), _counted(log, ["user_id", "facet"]), demand.Signals(least_shown=2.0))
    return ranked.filter("place <= 5").select("query_id", "asset_id", "demoted", F.round("ranked", 6).alias("ranked"), "place")


_NAMES_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS text, p_type AS kind FROM part WHERE p_partkey % 17 <> 0"


@plans.add(
    "q92_index_upkeep",
    rf"""
WITH n AS ({_NAMES_SQL}), w AS (SELECT id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS token, 2 AS weight FROM n UNION ALL SELECT id, unnest(regexp_split_to_array(lower(kind), '[^a-z0-9_]+')), 1 FROM n)
SELECT token, id, CAST(sum(weight) AS BIGINT) AS weight FROM w WHERE token <> '' GROUP BY 1, 2
""",
)
def index_upkeep(t: Tables) -> DataFrame:
    """An index of names kept up through two batches of changes: some parts renamed, then some removed."""
    weights = {"text": 2, "kind": 1}
    build = lambda rows: demand.token_index(rows, weights)
    first = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("kind"), "p_brand")
    second = first.withColumn("text", F.when(F.col("id") % 10 == 0, F.concat_ws(" ", "text", "p_brand")).otherwise(F.col("text")))
    third = second.filter(F.col("id") % 17 != 0)
    index = build(first)
    for before, after in ((first, second), (second, third)):
        queue = demand.reindex_queue(before, after, list(weights))
        index = demand.index_applied(index, demand.index_changes(index, after, queue, build))
    return index


@plans.add(
    "q93_facet_upkeep",
    "WITH n AS (SELECT p_partkey AS id, p_brand, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS p_type FROM part) SELECT id, 'p_brand' AS facet, p_brand AS value FROM n UNION ALL SELECT id, 'p_type', p_type FROM n WHERE p_type IS NOT NULL",
)
def facet_upkeep(t: Tables) -> DataFrame:
    """Facets of parts after some containers are taken back."""
    names = ["p_brand", "p_type"]
    build = lambda rows: demand.asset_facets(rows, names)
    before = t.part.select(F.col("p_partkey").alias("id"), *names)
    after = before.withColumn("p_type", F.when(F.col("id") % 9 != 0, F.col("p_type")))
    index = build(before)
    return demand.index_applied(index, demand.index_changes(index, after, demand.reindex_queue(before, after, names), build))


@plans.add(
    "q94_ingest_policy",
    """
WITH s AS (SELECT c_custkey AS session_id, list_extract(['ample', 'standard', 'constrained'], c_custkey % 3 + 1) AS tier, c_custkey % 7 * 20 AS files, c_custkey % 5 <> 0 AS has_worker FROM customer),
b AS (SELECT *, CASE WHEN tier = 'ample' AND files > 60 THEN 2 ELSE list_position(['ample', 'standard', 'constrained'], tier) END AS start FROM s),
q AS (SELECT o_custkey AS session_id, o_orderkey AS ord, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rung FROM orders),
r AS (SELECT q.*, b.start, greatest(b.start, coalesce(max(CASE WHEN rung <= 3 THEN rung END) OVER (PARTITION BY q.session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS worst FROM q JOIN b USING (session_id)),
d AS (SELECT session_id, max(rung) AS lowest, string_agg(list_extract(['ample', 'standard', 'constrained'], worst) || ' -> ' || list_extract(['ample', 'standard', 'constrained'], rung) || ': order ' || ord, '; ' ORDER BY ord) AS notes FROM r WHERE rung <= 3 AND rung > worst GROUP BY 1),
f AS (SELECT b.*, coalesce(d.lowest, b.start) AS rung, notes FROM b LEFT JOIN d USING (session_id))
SELECT session_id, list_extract(['ample', 'standard', 'constrained'], rung) AS tier, CAST(list_extract([4, 2, 1], rung) AS INTEGER) AS decode_concurrency, CAST(list_extract([480, 480, 360], rung) AS INTEGER) AS frame_long_edge, list_extract([0.72, 0.7, 0.66], rung)::DOUBLE AS jpeg_quality,
  concat_ws('; ', CASE WHEN NOT has_worker THEN 'no_worker: extraction runs on the main thread, so concurrency is capped' END, CASE WHEN tier = 'ample' AND files > 60 THEN 'large_batch: ' || files || ' files, so concurrency is reduced' END, notes) AS downgrades FROM f
""",
)
def ingest_policies(t: Tables) -> DataFrame:
    """Customers are sessions of devices, their orders requests for a tier, some of which there is none."""
    tier = F.element_at(F.array(*map(F.lit, lifecycle.TIERS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), tier.alias("tier"), (F.col("c_custkey") % 7 * 20).alias("files"), (F.col("c_custkey") % 5 != 0).alias("has_worker"))
    asked = F.get(F.array(*map(F.lit, lifecycle.TIERS)), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    requests = t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("ord"), asked.alias("to"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("reason"))
    policy = lifecycle.ingest_policy(sessions, requests)
    return policy.select("session_id", "tier", "decode_concurrency", "frame_long_edge", "jpeg_quality", F.array_join("downgrades", "; ").alias("downgrades"))


@plans.add(
    "q98_consent_gate",
    """
WITH c AS (SELECT c_custkey AS collab_id FROM customer), r AS (SELECT o_custkey AS collab_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS consent_id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
b AS (SELECT o_custkey AS collab_id, arg_min(o_orderkey, (o_orderpriority <> '1-URGENT', o_orderkey)) AS brief_id FROM orders GROUP BY 1),
i AS (SELECT l_orderkey AS brief_id, string_agg(l_linenumber, ',' ORDER BY l_linenumber DESC) AS items FROM lineitem GROUP BY 1)
SELECT collab_id, CASE WHEN consent_id IS NULL THEN 'agree' ELSE 'upload' END AS goes, consent_id, CASE WHEN consent_id IS NULL THEN brief_id END AS brief_id, CASE WHEN consent_id IS NULL THEN coalesce(items, '') END AS items
FROM c LEFT JOIN r USING (collab_id) LEFT JOIN b USING (collab_id) LEFT JOIN i USING (brief_id)
""",
)
def consent_gates(t: Tables) -> DataFrame:
    """Customers are collabs, their part orders consents, their orders briefs, urgent ones locked."""
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("collab_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "locked").otherwise("draft").alias("status"), "o_orderstatus")
    items = t.lineitem.select(F.col("l_orderkey").alias("brief_id"), (-F.col("l_linenumber")).alias("seq"), F.col("l_linenumber").cast("string").alias("id"))
    gates = lifecycle.consent_gate(t.customer.select(F.col("c_custkey").alias("id")), orders.filter("o_orderstatus = 'P'"), orders, items)
    return gates.withColumn("items", F.array_join("items", ","))


@plans.add(
    "q99_fitted_bodies",
    r"""
WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS body FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\x{10000}-\x{10FFFF}]')),
p AS (SELECT *, string_split(body, chr(10) || chr(10)) AS parts FROM d),
k AS (SELECT *, coalesce(list_max([n FOR n IN range(2, greatest(len(parts), 2) + 1) IF length(array_to_string(parts[:n], chr(10) || chr(10))) <= 900]), 2) AS n FROM p WHERE length(body) > 900)
SELECT doc_id, sha256(body) AS body, length(body) AS n FROM d WHERE length(body) <= 900
UNION ALL SELECT doc_id, sha256(left(array_to_string(parts[:n], chr(10) || chr(10)), 900)), length(left(array_to_string(parts[:n], chr(10) || chr(10)), 900)) FROM k
""",
)
def fitted_bodies(t: Tables) -> DataFrame:
    """Documents as drafts, whose lines are paragraphs, within the bound of a body."""
    plain = t.documents.filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]"))
    body = fitted_body(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return plain.select("doc_id", body.alias("b")).select("doc_id", F.sha2("b", 256).alias("body"), F.char_length("b").cast("long").alias("n"))
