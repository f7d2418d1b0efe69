"""Summary, target and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..operators import analytics as A
from ..registry import query
from ..sources import tables as T

_NUMERIC = """SELECT '{c}' AS field, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(var_pop({c}), 6) AS variance,
  min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95 FROM lineitem"""


@query(" UNION ALL ".join(_NUMERIC.format(c=c) for c in ("l_quantity", "l_discount", "l_tax")))
def numeric_summary(spark, sf_dir):
    return A.numeric_summary(T.read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


_COUNTS = """counts AS (
  SELECT 'lang' AS field, coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2
  UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2)"""


@query(f"WITH {_COUNTS} SELECT field, value, n, round(n / sum(n) OVER (PARTITION BY field), 6) AS share FROM counts")
def categorical_summary(spark, sf_dir):
    return A.categorical_counts(T.read(spark, sf_dir, "documents"), ["lang", "source"]).withColumn("share", F.round("share", 6))


@query(
    f"""WITH {_COUNTS}, s AS (SELECT *, n / sum(n) OVER (PARTITION BY field) AS p FROM counts),
    e AS (SELECT field, CAST(sum(n) AS BIGINT) AS n, count(*) AS u, -sum(p * log2(p)) AS e FROM s GROUP BY field)
    SELECT field, n, u AS unique_values, round(e, 6) AS entropy_bits, round(CASE WHEN u > 1 THEN e / log2(u) ELSE 0 END, 6) AS normalised_entropy FROM e"""
)
def entropy_bits(spark, sf_dir):
    return A.entropies(T.read(spark, sf_dir, "documents"), ["lang", "source"])


_JOINT = """pairs AS (SELECT event_type || ' × ' || CAST(hour(ts) AS VARCHAR) AS pair, count(*) AS n FROM events GROUP BY 1)"""


@query(f"WITH {_JOINT} SELECT pair, n FROM pairs ORDER BY n DESC, pair LIMIT 20")
def joint_coverage_top20(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events")
    return A.top(A.joint_counts(rows, F.col("event_type"), F.hour("ts")), 20, "pair")


@query(f"WITH {_JOINT} SELECT count(*) AS unique_pairs, CAST(sum(n) AS BIGINT) AS n, round(-sum(n / t * log2(n / t)), 6) AS entropy_bits FROM pairs, (SELECT sum(n) AS t FROM pairs)")
def joint_entropy(spark, sf_dir):
    pairs = A.joint_counts(T.read(spark, sf_dir, "events"), F.col("event_type"), F.hour("ts"))
    # -sum(p log p) = log(T) - sum(n log n) / T: one aggregation.
    total = F.sum("n")
    return pairs.agg(F.count("*").alias("unique_pairs"), total.alias("n"), F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy_bits"))


#: Target shares of languages that the gap report compares with.
TARGETS = [("de", 0.2), ("en", 0.4), ("es", 0.2), ("it", 0.2)]
_GAPS = f"""target AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in TARGETS)}) AS t(key, target)),
observed AS (SELECT lang AS key, count(*) / sum(count(*)) OVER () AS observed FROM documents GROUP BY lang),
gaps AS (
  SELECT coalesce(t.key, o.key) AS key, round(coalesce(target, 0), 6) AS target, round(coalesce(observed, 0), 6) AS observed,
         round(coalesce(observed, 0) - coalesce(target, 0), 6) AS gap, abs(round(coalesce(observed, 0) - coalesce(target, 0), 6)) AS abs_gap
  FROM target t FULL OUTER JOIN observed o ON t.key = o.key)"""


def _gaps(spark, sf_dir):
    counts = A.categorical_counts(T.read(spark, sf_dir, "documents"), ["lang"])
    return A.gaps(counts.select(F.col("value").alias("key"), F.col("share").alias("observed")), spark.createDataFrame(TARGETS, "key string, target double"))


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def target_vs_observed(spark, sf_dir):
    return _gaps(spark, sf_dir)


_FACTS = """facts AS (
  SELECT count(*) AS pages, count(DISTINCT source) AS sources, round(avg(CASE WHEN n_chars < 100 THEN 1.0 ELSE 0.0 END), 6) AS short_share FROM documents)"""


@query(
    f"""WITH {_GAPS}, {_FACTS}, found AS (
      SELECT 'target_gap' AS rule, key AS detail FROM gaps WHERE abs_gap >= 0.15
      UNION ALL SELECT 'few_pages', CAST(pages AS VARCHAR) FROM facts WHERE pages < 5000
      UNION ALL SELECT 'few_sources', CAST(sources AS VARCHAR) FROM facts WHERE sources < 5
      UNION ALL SELECT 'many_short', 'share' FROM facts WHERE short_share > 0.2)
    SELECT rule, detail FROM found UNION ALL SELECT 'ok', '' WHERE NOT EXISTS (SELECT 1 FROM found)"""
)
def recommendation_rules(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    facts = docs.agg(F.count("*").alias("pages"), F.countDistinct("source").alias("sources"), F.avg(F.when(F.col("n_chars") < 100, 1.0).otherwise(0.0)).alias("short_share"))
    rules = [
        ("few_pages", F.col("pages") < 5000, F.col("pages")),
        ("few_sources", F.col("sources") < 5, F.col("sources")),
        ("many_short", F.col("short_share") > 0.2, F.lit("share")),
    ]
    return A.recommend(_gaps(spark, sf_dir), rules, facts)


@query("SELECT c_mktsegment AS key, round(sum(greatest(c_acctbal, 0)) / sum(sum(greatest(c_acctbal, 0))) OVER (), 6) AS share FROM customer GROUP BY 1")
def dist_normalize(spark, sf_dir):
    weights = T.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("w"))
    return A.normalise(weights, "key", "w").withColumn("share", F.round("share", 6))


@query(
    f"""WITH {T.PAGES} SELECT page_id, lang, line_count, n_chars, round(n_chars / greatest(1, line_count), 6) AS chars_per_line,
    coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic, CASE WHEN n_chars >= 4000 THEN 'dense' WHEN n_chars >= 600 THEN 'normal' ELSE 'sparse' END AS density
    FROM doc_pages"""
)
def page_features(spark, sf_dir):
    rows = T.doc_pages(spark, sf_dir)
    density = F.when(F.col("n_chars") >= 4000, "dense").when(F.col("n_chars") >= 600, "normal").otherwise("sparse")
    return rows.select(
        "page_id", "lang", "line_count", "n_chars", F.round(F.col("n_chars") / F.greatest(F.lit(1), "line_count"), 6).alias("chars_per_line"),
        F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), density.alias("density"),
    )


@query(
    """SELECT event_id, try_cast(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS INTEGER) AS k,
    CASE WHEN try_cast(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS INTEGER) IS NULL OR event_type = 'error' THEN 'unreadable' END AS error FROM events"""
)
def feature_error_rows(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return rows.select("event_id", "k", F.when(F.col("k").isNull() | (F.col("event_type") == "error"), "unreadable").alias("error"))


@query("SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS fail_ratio, count(*) AS total, count(*) FILTER (event_type = 'error') AS fail, count(*) FILTER (event_type <> 'error') AS ok, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events")
def qc_run_summary(spark, sf_dir):
    bad = F.col("event_type") == "error"
    rows = T.read(spark, sf_dir, "events")
    return rows.agg(F.round(F.avg(F.when(bad, 1.0).otherwise(0.0)), 6).alias("fail_ratio"), F.count("*").alias("total"), F.count_if(bad).alias("fail"), F.count_if(~bad).alias("ok"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


@query(
    """SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures, count(*) OVER w AS seen,
    round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 6) AS ratio
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def running_fail_ratio(spark, sf_dir):
    rows = A.running_ratio(T.read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.select("event_id", "failures", "seen", "ratio")


@query(f"WITH {T.HTML_BLOCKS}, p AS (SELECT page_id, max((kind = 'list')::INT) AS l, max((kind = 'title')::INT) AS t FROM html_blocks GROUP BY 1) SELECT count(*) AS pages, round(avg(l), 6) AS list_ratio, round(avg(t), 6) AS title_ratio, round(avg(l * t), 6) AS both_ratio FROM p")
def feature_mode_ratios(spark, sf_dir):
    has = lambda k: F.max((F.col("kind") == k).cast("int"))
    pages = T.html_blocks(spark, sf_dir).groupBy("page_id").agg(has("list").alias("l"), has("title").alias("t"))
    return pages.agg(F.count("*").alias("pages"), F.round(F.avg("l"), 6).alias("list_ratio"), F.round(F.avg("t"), 6).alias("title_ratio"), F.round(F.avg(F.col("l") * F.col("t")), 6).alias("both_ratio"))


_SIGNATURE = f"""WITH {T.BOXES}, s AS (
  SELECT page, CAST(floor(count(*) / 2) * 2 AS BIGINT) AS n, string_agg(DISTINCT CAST(CAST(floor(x / 100) AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(CAST(floor(x / 100) AS BIGINT) AS VARCHAR)) AS xs,
         CAST(floor(sum(w * h) / 4800) AS BIGINT) AS share
  FROM boxes GROUP BY page)
SELECT concat_ws('|', n, xs, share) AS signature, count(*) AS pages FROM s GROUP BY 1"""


def _signatures(spark, sf_dir):
    bins = F.array_join(F.array_sort(F.collect_set(F.floor(F.col("x") / 100).cast("string"))), ",")
    pages = T.boxes(spark, sf_dir).groupBy("page").agg((F.floor(F.count("*") / 2) * 2).cast("long").alias("n"), bins.alias("xs"), F.floor(F.sum(F.col("w") * F.col("h")) / 4800).cast("long").alias("share"))
    return pages.select(F.concat_ws("|", "n", "xs", "share").alias("signature")).groupBy("signature").agg(F.count("*").alias("pages"))


@query(_SIGNATURE)
def layout_signature(spark, sf_dir):
    return _signatures(spark, sf_dir)


@query(f"WITH sig AS ({_SIGNATURE}), t AS (SELECT *, sum(pages) OVER () AS total FROM sig) SELECT count(*) AS signatures, round(CASE WHEN count(*) > 1 THEN -sum(pages / total * log2(pages / total)) / log2(count(*)) ELSE 0 END, 6) AS normalised, round(max(pages / total), 6) AS largest, round(count(*) / any_value(total), 6) AS uniqueness FROM t")
def normalized_entropy(spark, sf_dir):
    rows, total = _signatures(spark, sf_dir), F.sum("pages")
    entropy = F.log2(total) - F.sum(F.col("pages") * F.log2("pages")) / total
    return rows.agg(F.count("*").alias("signatures"), F.round(F.when(F.count("*") > 1, entropy / F.log2(F.count("*"))).otherwise(0.0), 6).alias("normalised"), F.round(F.max("pages") / total, 6).alias("largest"), F.round(F.count("*") / total, 6).alias("uniqueness"))


@query(
    f"""WITH sig AS ({_SIGNATURE}), t AS (SELECT *, sum(pages) OVER () AS total FROM sig),
    m AS (SELECT count(*) / any_value(total) AS u, -sum(pages / total * log2(pages / total)) / log2(count(*)) AS e FROM t),
    f AS (SELECT avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS ok FROM events)
    SELECT round(0.6 * u + 0.4 * e, 6) AS diversity, round(0.25 * (0.6 * u + 0.4 * e) + 0.75 * ok, 6) AS overall, 0.25 * (0.6 * u + 0.4 * e) + 0.75 * ok >= 0.75 AS passed FROM m, f"""
)
def acceptance_score(spark, sf_dir):
    rows, total = _signatures(spark, sf_dir), F.sum("pages")
    m = rows.agg((F.count("*") / total).alias("u"), ((F.log2(total) - F.sum(F.col("pages") * F.log2("pages")) / total) / F.log2(F.count("*"))).alias("e"))
    ok = T.read(spark, sf_dir, "events").agg(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("ok"))
    diversity = 0.6 * F.col("u") + 0.4 * F.col("e")
    score = 0.25 * diversity + 0.75 * F.col("ok")
    # One row on either side.
    return m.crossJoin(ok).select(F.round(diversity, 6).alias("diversity"), F.round(score, 6).alias("overall"), (score >= 0.75).alias("passed"))


_VECTORS = """v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS j FROM embeddings),
s AS (SELECT j, avg(x) AS m, stddev_pop(x) AS sd FROM v GROUP BY j),
z AS (SELECT vec_id, j, CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END AS z FROM v JOIN s USING (j))"""


@query(
    f"""WITH {_VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(sum((a.z - b.z) * (a.z - b.z))), 4) AS distance
    FROM z a JOIN z b ON a.j = b.j AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2"""
)
def pairwise_distance(spark, sf_dir):
    """Distances of z-scored vectors: of the stated query set, ids divisible by 50, to all others.

    Catalyst multiplies blocks of the two sides, and broadcasts the queries only if they are measured to be small.
    """
    rows = T.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    stats = rows.groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = rows.join(F.broadcast(stats), "j").select("vec_id", "j", F.when(F.col("sd") > 0, (F.col("x") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("z"))
    z = z.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "z"))), lambda s: s["z"]).alias("z"))
    a, b = z.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("z").alias("za")), z.select(F.col("vec_id").alias("b"), F.col("z").alias("zb"))
    far = F.sqrt(F.aggregate(F.zip_with("za", "zb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", F.round(far, 4).alias("distance"))


@query("SELECT round(100.0 * sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / count(*), 2) AS pct, lpad(CAST(CAST(floor(count(*) / 10) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(count(*) / 10) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(count(*) / 10) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS eta FROM events")
def progress_projection(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    rows = rows.withColumn("left", F.floor(F.col("n") / 10).cast("long"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    eta = F.concat(two(F.expr("left div 3600")), F.lit(":"), two(F.expr("left % 3600 div 60")), F.lit(":"), two(F.col("left") % 60))
    return rows.select(F.round(100.0 * ratio(F.col("ok"), F.col("n")), 2).alias("pct"), eta.alias("eta"))
