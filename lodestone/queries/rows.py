"""Queries over row transforms: sources, pipes, joins, unions, order, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import joins, ordered, pipes
from lodestone.queries.registry import Tables, query
from lodestone.session import new_path
from lodestone.sources import feeds, text

# -- sources and sinks ---------------------------------------------------------------------------


@query("S1_text_lines", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name AS value FROM part")
def _(t: Tables):
    path = new_path(t.spark, "lines")
    text.write_lines(t.part.orderBy("p_partkey").coalesce(1), path, "p_name")
    return text.lines(t.spark, path)


@query("S2_csv", "SELECT s_suppkey AS c0, s_name AS c1, s_acctbal AS c2 FROM supplier")
def _(t: Tables):
    path = new_path(t.spark, "csv")
    text.write_values(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return text.csv(t.spark, path, "c0 bigint, c1 string, c2 double")


@query("S3_csv_header", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    path = new_path(t.spark, "csv")
    t.nation.select("n_nationkey", "n_name").write.csv(path, header=True)
    return text.csv(t.spark, path, "n_nationkey int, n_name string", header=True)


@query("S4_arff", "SELECT CAST(p_size AS DOUBLE) AS p_size, p_brand, p_retailprice FROM part")
def _(t: Tables):
    path = new_path(t.spark, "arff")
    text.write_arff(t.part.select("p_size", "p_brand", "p_retailprice"), path)
    return text.arff(t.spark, path)


@query("S13_text_sink", "SELECT c_name AS value FROM customer")
def _(t: Tables):
    path = new_path(t.spark, "lines")
    text.write_lines(t.customer, path, "c_name")
    return t.spark.read.text(path)


@query("S14_values_sink", "SELECT concat_ws(',', n_nationkey, n_name, n_regionkey) AS value FROM nation")
def _(t: Tables):
    path = new_path(t.spark, "values")
    text.write_values(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    return t.spark.read.text(path)


@query("S15_to_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def _(t: Tables):
    df = t.nation.select("n_nationkey", "n_name")
    return df.select(text.json_rows(df).alias("json"))


@query("S17_slices", "SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS index, CAST(unnest(embedding) AS DOUBLE) AS slice FROM embeddings")
def _(t: Tables):
    return feeds.slices(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")


@query("S18_repeat", "SELECT n_nationkey, CAST(e AS INTEGER) AS epoch FROM nation, range(3) r(e)")
def _(t: Tables):
    return feeds.repeat(t.nation.select("n_nationkey"), 3)


@query("S18_batch", "SELECT b AS \"group\", list(n_name ORDER BY n_nationkey) AS values FROM (SELECT *, n_nationkey // 4 AS b FROM (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS n_nationkey, n_name FROM nation)) GROUP BY b")
def _(t: Tables):
    return feeds.batch(t.nation, "n_name", 4, ["n_nationkey"])


@query("S18_cache_file", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables):
    return feeds.cache(t.region, "file")


@query("S19_tensors", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS data, CAST(2 AS INTEGER) AS first FROM embeddings")
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    a, b = feeds.tensor(F.slice(e, 1, 32), [32]), feeds.tensor(F.slice(e, 33, 32), [32])
    s = feeds.stack(a, b)
    return t.embeddings.select("vec_id", s["data"].alias("data"), s["shape"][0].alias("first"))


# -- pipes ---------------------------------------------------------------------------------------


@query("P1_map_function", "SELECT o_orderkey, round(o_totalprice * 2 + 1, 4) AS v FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 2 + 1, 4).alias("v"))


@query("P2_compose", "SELECT o_orderkey, round(o_totalprice / 2, 4) AS half FROM orders WHERE o_totalprice / 2 > 50000")
def _(t: Tables):
    p = pipes.mapped(half=F.col("o_totalprice") / 2) >> pipes.filtered(F.col("half") > 50000) >> pipes.projected("o_orderkey", F.round("half", 4).alias("half"))
    return p(t.orders)


@query("P3_parallel", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT r_regionkey, upper(r_name) FROM region")
def _(t: Tables):
    both = pipes.filtered(F.col("n_regionkey") == 1) * pipes.mapped(r_name=F.upper("r_name"))
    a, b = both((t.nation, t.region))
    return a.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).union(b.select("r_regionkey", "r_name"))


@query("P4_beside", "SELECT o_orderkey, round(least(o_totalprice, 100000), 2) AS low, length(o_orderpriority) AS n FROM orders")
def _(t: Tables):
    f = pipes.Pipe(lambda c: F.round(F.least(c, F.lit(100000.0)), 2)).beside(lambda c: F.length(c))
    low, n = f((F.col("o_totalprice"), F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", low.alias("low"), n.cast("long").alias("n"))


@query("P5_fork", "SELECT event_id, round(value * value, 6) AS square, round(value + 1, 6) AS next FROM events")
def _(t: Tables):
    a, b = pipes.fork(lambda c: c * c, lambda c: c + 1)(F.col("value"))
    return t.events.select("event_id", F.round(a, 6).alias("square"), F.round(b, 6).alias("next"))


@query("P8_tuple_fields", "SELECT c_custkey AS _1, c_name AS _2 FROM customer")
def _(t: Tables):
    return t.customer.select(F.struct(F.col("c_custkey").alias("_1"), F.col("c_name").alias("_2")).alias("p")).select("p._1", "p._2")


@query("P9_several_arguments", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def _(t: Tables):
    charge = pipes.merge(lambda p, d, x: p * (1 - d) * (1 + x)) >> (lambda c: F.round(c, 6))
    return t.lineitem.select("l_orderkey", "l_linenumber", charge((F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"))).alias("charge"))


@query("P10_curried", "SELECT event_id, round(value * 3 - 2, 6) AS v FROM events")
def _(t: Tables):
    line = pipes.meta(lambda a, b, c: a * c + b)
    return t.events.select("event_id", F.round(line(3, -2)(F.col("value")), 6).alias("v"))


@query("P12_flat_map", "SELECT lang, count(*) AS words FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang")
def _(t: Tables):
    return pipes.flat_mapped(F.split("text", " "), "w")(t.documents.select("lang", "text")).groupBy("lang").agg(F.count("*").alias("words"))


@query("P13_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 10")
def _(t: Tables):
    return pipes.filtered((F.col("event_type") == "click") & (F.col("value") > 10))(t.events).select("event_id")


@query("P14_partition", "SELECT coalesce(value > 50, false) AS side, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    yes, no = pipes.partitioned(F.col("value") > 50)(t.events)
    return yes.select(F.lit(True).alias("side")).union(no.select(F.lit(False))).groupBy("side").agg(F.count("*").alias("n"))


@query("P17_unzip", "SELECT c_custkey AS pos, c_name AS v FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer")
def _(t: Tables):
    a, b = pipes.unzip(t.customer.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("_1"), F.col("c_mktsegment").alias("_2")))
    return a.withColumnRenamed("_1", "v").union(b)


@query("P18_dataset_function", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(t: Tables):
    return t.events.transform(lambda d: d.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")))


@query("P19_drop_head", "SELECT n_name FROM nation WHERE n_nationkey > (SELECT min(n_nationkey) FROM nation)")
def _(t: Tables):
    return pipes.drop_head()(ordered.with_position(t.nation, ["n_nationkey"])).select("n_name")


@query("P20_extract_columns", "SELECT c_custkey, c_mktsegment AS c0, nullif(c_name, 'Customer#000000001') AS c1 FROM customer")
def _(t: Tables):
    raw = t.customer.select("c_custkey", F.concat_ws(",", "c_name", "c_mktsegment").alias("value"))
    return (pipes.split_lines() >> pipes.extract_columns([1, 0], {0: "Customer#000000001"}))(raw)


@query("P21_drop_missing", "SELECT p_partkey, p_size FROM part WHERE p_size <> 7")
def _(t: Tables):
    return pipes.drop_missing()(t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size")))


@query("P22_features_target", "SELECT l_orderkey, l_linenumber, [l_quantity, l_discount] AS features, l_extendedprice AS target FROM lineitem")
def _(t: Tables):
    return pipes.features_and_target(["l_quantity", "l_discount"], "l_extendedprice")(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"))


@query("P24_filter_not", "SELECT event_id FROM events WHERE NOT (value > 50)")
def _(t: Tables):
    return pipes.filtered(F.col("value") > 50, keep=False)(t.events).select("event_id")


@query("P27_to_supervised", "SELECT event_id, [value, CAST(user_id AS DOUBLE)] AS features, event_type = 'purchase' AS target FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.array("value", F.col("user_id").cast("double")).alias("features"), (F.col("event_type") == "purchase").alias("target"))


@query("P28_split_flag", "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 'train' ELSE 'test' END AS split FROM events")
def _(t: Tables):
    return pipes.split_flag(F.col("event_id") % 5 < 4)(t.events).select("event_id", "split")


@query("P29_split_by_share", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(0.7 * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS split FROM orders")
def _(t: Tables):
    return ordered.split_by_share(t.orders, 0.7, ["o_orderkey"]).select("o_orderkey", "split")


@query("P30_split_train_test", "SELECT 'train' AS split, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100) UNION ALL SELECT 'test', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50)")
def _(t: Tables):
    a = ordered.take(t.orders, 100, ["o_orderkey"]).select(F.lit("train").alias("split"), "o_orderkey")
    return a.union(ordered.take(t.orders, 50, ["o_orderkey"], last=True).select(F.lit("test"), "o_orderkey"))


# -- joins ---------------------------------------------------------------------------------------


@query("J1_last_wins_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON c_custkey = o_custkey AND r = 1")
def _(t: Tables):
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return joins.last_wins_join(t.customer, right, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("J2_key_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("J7_outer_pairs", "SELECT r_regionkey, n_nationkey, r_regionkey * n_nationkey AS v FROM region, nation")
def _(t: Tables):
    return joins.pairs(t.region, t.nation).select("r_regionkey", "n_nationkey", (F.col("r_regionkey") * F.col("n_nationkey")).alias("v"))


@query("J8_renyi_entropy", "SELECT round(-ln(avg(exp(-list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 2) / pow(sqrt(2 * pi()), 64))), 6) AS entropy FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b")
def _(t: Tables):
    e = t.embeddings.select(F.col("embedding").cast("array<double>").alias("e"))
    return joins.renyi_entropy(e, "e", 1.0).select(F.round("entropy", 6).alias("entropy"))


@query("J9_zip", "SELECT a.pos, a.n_name, b.c_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation) a JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_name FROM customer) b USING (pos)")
def _(t: Tables):
    return ordered.zip_frames(t.nation.select("n_nationkey", "n_name"), t.customer.select("c_custkey", "c_name"), ["n_nationkey"], ["c_custkey"]).select("pos", "n_name", "c_name")


@query("J10_collect", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, [n_nationkey, n_nationkey * 2] AS values FROM nation")
def _(t: Tables):
    a = t.nation.select("n_nationkey")
    return ordered.collect_frames([(a, "n_nationkey", ["n_nationkey"]), (a.select((F.col("n_nationkey") * 2).alias("m")), "m", ["m"])])


@query("J11_product", "SELECT a.r_name AS a, b.r_name AS b, CAST(c.i AS BIGINT) AS c FROM region a, region b, range(3) c(i)")
def _(t: Tables):
    return joins.product([t.region.select(F.col("r_name").alias("a")), t.region.select(F.col("r_name").alias("b")), t.spark.range(3).select(F.col("id").alias("c"))])


@query("J12_exclude", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t: Tables):
    return joins.exclude(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("J13_range_bins", "SELECT CAST(floor((l_extendedprice - 900) / 5000) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy(joins.cell(F.col("l_extendedprice"), 900.0, 5000.0).alias("bin")).agg(F.count("*").alias("n"))


@query("J14_as_of", "SELECT a.event_id, b.event_id AS r_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN LATERAL (SELECT e.event_id FROM events e WHERE e.event_type = 'click' AND e.user_id = a.user_id AND e.ts <= a.ts ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) b ON true")
def _(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'purchase'").drop("event_type")
    right = e.where("event_type = 'click'").drop("event_type")
    return joins.as_of(left, right, ["user_id"], "ts", span=86400.0 * 7).select("event_id", "r_event_id")


# -- unions --------------------------------------------------------------------------------------


@query("U1_concatenate", "SELECT n_name AS v, 0 AS side FROM nation UNION ALL SELECT r_name, 1 FROM region")
def _(t: Tables):
    return ordered.concatenate(t.nation.select(F.col("n_name").alias("v")), t.region.select(F.col("r_name").alias("v")))


@query("U5_tensor_concatenate", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS data FROM embeddings")
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    c = feeds.concatenate(feeds.tensor(F.slice(e, 1, 24), [24]), feeds.tensor(F.slice(e, 25, 40), [40]))
    return t.embeddings.select("vec_id", c["data"].alias("data"))


@query("U5_unstack", "SELECT vec_id, CAST(i AS INTEGER) AS index, CAST(embedding[i * 16 + 1 : i * 16 + 16] AS DOUBLE[]) AS data FROM embeddings, range(4) r(i)")
def _(t: Tables):
    whole = feeds.tensor(F.col("embedding").cast("array<double>"), [4, 16])
    return t.embeddings.select("vec_id", F.posexplode(feeds.unstack(whole)).alias("index", "t")).select("vec_id", "index", F.col("t.data").alias("data"))


@query("U6_set_difference", "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000")
def _(t: Tables):
    return t.nation.select("n_nationkey").subtract(t.customer.where("c_acctbal > 5000").select("c_nationkey"))


# -- order -----------------------------------------------------------------------------------------


@query("K1_take", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 25")
def _(t: Tables):
    return ordered.take(t.events, 25, ["ts", "event_id"]).select("event_id", "value")


@query("K1_take_by_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def _(t: Tables):
    return ordered.take(t.events, 3, ["ts", "event_id"], by=["user_id"], last=True).select("user_id", "event_id")


@query("K3_sorted_curve", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 20")
def _(t: Tables):
    return t.part.orderBy("p_retailprice", "p_partkey").limit(20).select("p_partkey")


@query("K6_bagging")
def _(t: Tables):
    n = t.spark.range(5).select(F.col("id").alias("bag"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("draw"))
    picks = n.withColumn("pos", F.floor(F.rand(7) * t.nation.count()))
    return picks.join(ordered.with_position(t.nation, ["n_nationkey"]), "pos").select("bag", "draw", "n_name")


@query("K7_sample_with_replacement")
def _(t: Tables):
    return t.orders.sample(True, 0.1, 11).select("o_orderkey")


@query("K8_sample")
def _(t: Tables):
    return t.orders.sample(False, 0.1, 11).select("o_orderkey")


@query("K9_take_sample", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 50)")
def _(t: Tables):
    return t.orders.orderBy(F.rand(3)).limit(50).agg(F.count("*").alias("n"))


@query("K10_argmin", "SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("o_orderkey"))


@query("K11_random_split", "SELECT count(*) AS n FROM orders")
def _(t: Tables):
    return t.orders.withColumn("split", F.when(F.rand(5) <= 0.9, "train").otherwise("test")).groupBy("split").count().agg(F.sum("count").alias("n"))


# -- windows ---------------------------------------------------------------------------------------

LAGS = "FROM (SELECT *, lag(value, 3) OVER w AS l3, lag(value, 2) OVER w AS l2, lag(value, 1) OVER w AS l1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE l3 IS NOT NULL"


@query("W1_delta_features", f"SELECT event_id, [l3, l2] AS features, value AS target {LAGS}")
def _(t: Tables):
    return ordered.delta_features(t.events, "value", 2, 1, ["ts", "event_id"], ["user_id"]).select("event_id", "features", "target")


@query("W1_delta_features_global", "SELECT event_id, [l2, l1] AS features, value AS target FROM (SELECT *, lag(value, 2) OVER w AS l2, lag(value, 1) OVER w AS l1 FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE l2 IS NOT NULL")
def _(t: Tables):
    return ordered.delta_features(t.events, "value", 2, 0, ["ts", "event_id"]).select("event_id", "features", "target")


@query("W2_delta_features_vector", "SELECT event_id, [v2, v1, u2, u1] AS features, value AS target FROM (SELECT *, lag(value, 2) OVER w AS v2, lag(value, 1) OVER w AS v1, lag(u, 2) OVER w AS u2, lag(u, 1) OVER w AS u1 FROM (SELECT *, CAST(length(event_type) AS DOUBLE) AS u FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE v2 IS NOT NULL")
def _(t: Tables):
    e = t.events.withColumn("u", F.length("event_type").cast("double"))
    return ordered.delta_features_vector(e, ["value", "u"], [2, 2], ["ts", "event_id"], ["user_id"]).select("event_id", "features", "target")


@query("W3_delta_features_arx", "SELECT event_id, [v1, u3, u2, u1] AS features, value AS target FROM (SELECT *, lag(value, 1) OVER w AS v1, lag(u, 3) OVER w AS u3, lag(u, 2) OVER w AS u2, lag(u, 1) OVER w AS u1 FROM (SELECT *, CAST(length(event_type) AS DOUBLE) AS u FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE u3 IS NOT NULL")
def _(t: Tables):
    e = t.events.withColumn("u", F.length("event_type").cast("double"))
    return ordered.delta_features_vector(e, ["value", "u"], [1, 3], ["ts", "event_id"], ["user_id"]).select("event_id", "features", "target")


@query("W4_delta_features_outputs", "SELECT event_id, [v1, u1] AS features, [value, u] AS target FROM (SELECT *, lag(value, 1) OVER w AS v1, lag(u, 1) OVER w AS u1 FROM (SELECT *, CAST(length(event_type) AS DOUBLE) AS u FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE v1 IS NOT NULL")
def _(t: Tables):
    e = t.events.withColumn("u", F.length("event_type").cast("double"))
    return ordered.delta_features_vector(e, ["value", "u"], [1, 1], ["ts", "event_id"], ["user_id"], targets=["value", "u"]).select("event_id", "features", "target")


@query("W5_time_series", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS time, value FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), "value")


@query("W6_scan_left", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS scan FROM events")
def _(t: Tables):
    return ordered.scan(t.events, "value", ["ts", "event_id"], ["user_id"]).select("event_id", F.round("scan", 4).alias("scan"))


@query("W6_scan_left_global", "SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS scan FROM events")
def _(t: Tables):
    return ordered.scan(t.events, "value", ["ts", "event_id"]).select("event_id", F.round("scan", 3).alias("scan"))


@query("W7_scan_right", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS scan FROM events")
def _(t: Tables):
    return ordered.scan(t.events, "value", ["ts", "event_id"], ["user_id"], right=True).select("event_id", F.round("scan", 4).alias("scan"))


@query("W8_scan_max", "SELECT event_id, max(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scan FROM events")
def _(t: Tables):
    return ordered.scan(t.events, "value", ["ts", "event_id"], how="max").select("event_id", "scan")


@query("W8_fold", "SELECT user_id, round(sum(value), 4) AS fold FROM events GROUP BY user_id")
def _(t: Tables):
    return ordered.fold(t.events, "value", F.lit(0.0), lambda a, x: a + x, ["ts", "event_id"], ["user_id"]).select("user_id", F.round("fold", 4).alias("fold"))


@query("W9_grouped", "SELECT g AS \"group\", list(o_orderkey ORDER BY o_orderkey) AS values FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS g FROM orders) GROUP BY g")
def _(t: Tables):
    return ordered.grouped(t.orders, "o_orderkey", 100, ["o_orderkey"])


@query("X1_time_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("X8_table_function", "SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items FROM pages")
def _(t: Tables):
    found = pipes.flat_mapped(F.regexp_extract_all("html", F.lit("(<li>)"), F.lit(1)), "x")(t.pages)
    return t.pages.select("page_id").join(found.groupBy("page_id").agg(F.count("*").alias("items")), "page_id", "left").na.fill(0, ["items"])
