"""Queries of evaluation, event logs and relational forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragframe.operators import corpus, evaluate
from ragframe.sources import store
from ragframe.streaming import events as streams

from .registry import query, table

_KINDS = "CASE doc_id % 4 WHEN 0 THEN 'no_info' ELSE 'factual' END"
_ANSWER = "CASE WHEN doc_id % 5 = 0 THEN 'No dispongo de información suficiente.' WHEN doc_id % 11 = 0 THEN 'Tras revisar, ' || text ELSE text END"
#: An evaluation set of the labelled documents: a text is the answer, its source the url, its second word the keyword.
_EVAL = f"""
WITH i AS (SELECT d.doc_id AS id, {_KINDS} AS type, d.doc_id % 4 = 0 AS should_refuse, {_ANSWER} AS answer, d.source AS url, 'src' || (l.quality * 3) AS expected, CASE WHEN d.doc_id % 3 = 0 THEN ['the'] ELSE [] END AS kws FROM documents d JOIN labels l USING (doc_id)),
s AS (SELECT id, type, starts_with(answer, 'No dispongo de información') AS refused, starts_with(answer, 'Tras revisar') AS leaked, contains(lower(url), lower(expected)) AS hit, should_refuse, len(kws) AS w, CAST(len([k FOR k IN kws IF contains(lower(answer), k)]) AS BIGINT) AS h FROM i),
r AS (SELECT id, type, refused, leaked, CASE WHEN id % 6 = 0 THEN NULL ELSE hit END AS retrieval_hit, CASE WHEN w > 0 THEN h || '/' || w ELSE '-' END AS kw_coverage, CASE WHEN should_refuse THEN refused WHEN w > 0 THEN NOT refused AND h = w ELSE NOT refused END AS answer_correct FROM s)
"""


def _scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    id_, none = F.col("doc_id"), F.expr("cast(array() as array<string>)")
    answer = F.when(id_ % 5 == 0, "No dispongo de información suficiente.").when(id_ % 11 == 0, F.concat(F.lit("Tras revisar, "), "text")).otherwise(F.col("text"))
    rows = docs.select(
        id_.alias("id"), F.when(id_ % 4 == 0, "no_info").otherwise("factual").alias("type"), (id_ % 4 == 0).alias("should_refuse"), F.when(id_ % 6 == 0, none).otherwise(F.array(F.concat(F.lit("src"), (F.col("quality") * 3).cast("string")))).alias("expected_sources"),
        F.when(id_ % 3 == 0, F.array(F.lit("the"))).otherwise(none).alias("expected_keywords"), answer.alias("answer"), F.array("source").alias("urls"),
    )
    return evaluate.scored(rows)


@query(f"{_EVAL} SELECT * FROM r")
def eval_scoring(spark, sf_dir):
    """K13, C21, D20."""
    return _scores(spark, sf_dir)


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN '-' ELSE CAST(CAST(round_even(100.0::DOUBLE * {part} / {whole}, 0) AS INTEGER) AS VARCHAR) || '%' END"


@query(f"""{_EVAL} SELECT count(*) AS n, {_pct("count_if(answer_correct)", "count(*)")} AS answer_accuracy, {_pct("count_if(coalesce(retrieval_hit, false))", "count(retrieval_hit)")} AS retrieval_recall,
 {_pct("count_if(type <> 'no_info' AND answer_correct)", "count_if(type <> 'no_info')")} AS factual_accuracy, {_pct("count_if(type = 'no_info' AND answer_correct)", "count_if(type = 'no_info')")} AS noinfo_correct,
 CAST(count_if(type <> 'no_info' AND refused) AS BIGINT) AS false_refusals, CAST(count_if(leaked) AS BIGINT) AS leaks FROM r""")
def eval_summary(spark, sf_dir):
    """D13, H42."""
    return evaluate.summary(_scores(spark, sf_dir))


@query(f"""{_EVAL} SELECT count(*) AS n, {_pct("count_if(answer_correct)", "count(*)")} AS answer_accuracy, {_pct("count_if(type = 'no_info' AND NOT refused)", "count_if(type = 'no_info')")} AS hallucination_rate FROM r""")
def eval_baseline(spark, sf_dir):
    """D15."""
    return evaluate.baseline_summary(_scores(spark, sf_dir))


@query(f"{_EVAL} SELECT id FROM r WHERE type <> 'no_info' AND NOT refused")
def ragas_eligible(spark, sf_dir):
    """B24."""
    rows = _scores(spark, sf_dir).select("id", "type", "refused", (F.col("type") == "no_info").alias("should_refuse"), F.array(F.lit("context")).alias("retrieved_contexts"))
    return evaluate.ragas_eligible(rows).select("id")


@query("SELECT event_type, avg(CASE WHEN CAST(substr(props, 7, length(props) - 7) AS INTEGER) % 10 <> 0 THEN value END) AS mean FROM events GROUP BY event_type")
def nan_means(spark, sf_dir):
    """Every tenth value is no number."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_type", F.when(k % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("x"))
    return rows.groupBy("event_type").agg(evaluate.nan_mean(F.col("x")).alias("mean"))


@query("WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT value AS p95 FROM o WHERE i = least(n - 1, CAST(floor(0.95::DOUBLE * n) AS BIGINT))")
def p95_latency(spark, sf_dir):
    """events' values stand for latencies."""
    return evaluate.p95(table(spark, sf_dir, "events"), "value")


@query("WITH c AS (SELECT greatest(1, length(text) // 4) AS t FROM documents), o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM c) SELECT any_value(n) AS n, CAST(max(t) FILTER (WHERE i = n // 2) AS INTEGER) AS median, CAST(max(t) AS INTEGER) AS most, CAST(count_if(t > 1024) AS BIGINT) AS large FROM o")
def chunk_sizes(spark, sf_dir):
    """The upper median comes from counts by size, not from one sorted list."""
    from ragframe.functions.text import token_length

    sizes = table(spark, sf_dir, "documents").select(token_length(F.col("text")).alias("t"))
    counts = sizes.groupBy("t").agg(F.count("*").alias("c"))
    upto = counts.select("t", "c", F.sum("c").over(Window.orderBy("t")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))  # a row for each size
    median = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("t")))
    return upto.agg(F.max("n").alias("n"), median.alias("median"), F.max("t").alias("most"), F.coalesce(F.sum(F.when(F.col("t") > 1024, F.col("c"))), F.lit(0)).alias("large"))


@query("SELECT lang, count(*) AS n, avg(quality) AS quality, avg(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_quality_rates(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def log_events_by_type(spark, sf_dir):
    """A30."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'INFO' AS level, 'events' AS module FROM events")
def log_props_json(spark, sf_dir):
    """H41, A30."""
    rows = store.events(table(spark, sf_dir, "events"), "events", "seen", F.col("ts"), "event_id", "props")
    parsed = F.from_json("extras", "event_id long, props string")
    return rows.select(parsed["event_id"].alias("event_id"), F.get_json_object(parsed["props"], "$.k").cast("int").alias("k"), "level", "module")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def log_hourly(spark, sf_dir):
    """2.I's extension in batch."""
    return streams.hourly(table(spark, sf_dir, "events"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS s, event_id FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k
""")
def log_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation", "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_name", "r_name")  # region: five rows by definition


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return c.select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def join_full(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    a, b = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a")), s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("customers"), F.coalesce("b", F.lit(0)).alias("suppliers"))


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_semi(spark, sf_dir):
    p, line = _t(spark, sf_dir, "part", "lineitem")
    return p.join(line.filter("l_quantity > 45"), p.p_partkey == line.l_partkey, "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = (s.select(F.col("s_suppkey").alias(x), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias(f"{x}_bal")) for x in "ab")
    return a.join(b, "k").filter("a_bal < b_bal").select("a", "b")


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_nation(spark, sf_dir):
    c, n, r = _t(spark, sf_dir, "customer", "nation", "region")
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS rank, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def window_rank(spark, sf_dir):
    own = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(own.orderBy(F.desc("o_totalprice"))).alias("rank"), F.round(F.sum("o_totalprice").over(own.orderBy("o_orderdate", "o_orderkey")), 2).alias("running"))


@query("SELECT p_brand, p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    return corpus.top_by_group(table(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 3).select("p_brand", "p_partkey", "rank")


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def union_except_intersect(spark, sf_dir):
    """2.G."""
    c, s, n = _t(spark, sf_dir, "customer", "supplier", "nation")
    c, s, n = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")), n.select(F.col("n_nationkey").alias("k"))
    sets = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": n.subtract(s)}
    out = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    """Filter, projection and partial aggregation over the largest relational table."""
    line = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
