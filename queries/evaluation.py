"""Scoring, ensembles, evaluation and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation, runs, scoring

from .base import money, query, table


class PriceModel:
    """A tiny regression model: one weight per feature."""

    def predict(self, frame):
        return (frame["l_quantity"] * 1500.5 + frame["l_discount"] * -2000 + 37.25).to_frame()


def _scored(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"
    )
    return scoring.score(lines, PriceModel, ["l_quantity", "l_discount"], ["predicted"])


PREDICTED = "l_quantity * 1500.5 + l_discount * -2000 + 37.25"


@query(
    "score_batch",
    f"SELECT l_orderkey, l_linenumber, round({PREDICTED}, 4) AS predicted, TIMESTAMP '2024-01-01' AS scored_at FROM lineitem",
)
def score_batch(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = scoring.score(lines, PriceModel, ["l_quantity", "l_discount"], ["predicted"], "scored_at", "2024-01-01 00:00:00")
    return out.select("l_orderkey", "l_linenumber", money("predicted", 4).alias("predicted"), "scored_at")


@query("udf_model", "SELECT c_custkey, c_acctbal > 1000 AND c_nationkey < 12 AS good FROM customer")
def udf_model(spark, sf_dir):
    class Rule:
        def predict(self, frame):
            return ((frame["c_acctbal"] > 1000) & (frame["c_nationkey"] < 12)).astype(float).to_frame()

    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = scoring.score(customer, Rule, ["c_acctbal", "c_nationkey"], ["p"])
    return out.select("c_custkey", (F.col("p") == 1).alias("good"))


MODELS = ["m1", "m2", "m3"]


def _models(spark, sf_dir):
    """Three rules that classify an order by different columns."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("m1"),
        (F.floor(F.col("o_totalprice") / 100001) + 1).cast("int").alias("m2"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("m3"),
    )


MODELS_SQL = """WITH m AS (SELECT o_orderkey, substring(o_orderpriority, 1, 1)::INT AS m1, (floor(o_totalprice / 100001) + 1)::INT AS m2, (o_custkey % 5 + 1)::INT AS m3 FROM orders),
      v AS (SELECT o_orderkey, m1 AS c, {a} AS w FROM m UNION ALL SELECT o_orderkey, m2, {b} FROM m UNION ALL SELECT o_orderkey, m3, {c} FROM m),
      s AS (SELECT o_orderkey, c, round(sum(w), 9) AS w FROM v GROUP BY 1, 2)
    SELECT o_orderkey, arg_max(c, (w, -c))::BIGINT AS vote FROM s GROUP BY 1"""


@query("vote_majority", MODELS_SQL.format(a=1 / 3, b=1 / 3, c=1 / 3))
def vote_majority(spark, sf_dir):
    return scoring.vote(_models(spark, sf_dir), MODELS, kind="classification").select("o_orderkey", "vote")


@query("vote_long", MODELS_SQL.format(a=0.5, b=0.3, c=0.2))
def vote_long(spark, sf_dir):
    """The same vote over one row per model."""
    long = _models(spark, sf_dir).unpivot(["o_orderkey"], MODELS, "model", "prediction")
    out = scoring.vote_long(long, ["o_orderkey"], "model", "prediction", {"m1": 0.5, "m2": 0.3, "m3": 0.2})
    return out.withColumn("vote", F.col("vote").cast("long"))


@query(
    "vote_mean",
    "SELECT l_orderkey, l_linenumber, round(l_quantity * 0.5 + l_tax * 0.25 + l_discount * 0.25, 6) AS vote FROM lineitem",
)
def vote_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    out = scoring.vote(lines, ["l_quantity", "l_tax", "l_discount"], {"l_quantity": 0.5, "l_tax": 0.25, "l_discount": 0.25}, "regression")
    return out.select("l_orderkey", "l_linenumber", money("vote", 6).alias("vote"))


@query("vote_auto", MODELS_SQL.format(a=0.25, b=0.75, c=0.0))
def vote_auto(spark, sf_dir):
    """All predictions are whole numbers, so classes are voted on; weights rescale to 1."""
    return scoring.vote(_models(spark, sf_dir), MODELS, {"m1": 0.2, "m2": 0.6}).select("o_orderkey", "vote")


@query("vote_weights", "SELECT o_orderkey, round((m1 * 0.4 + m2 * 0.6)::DOUBLE, 6) AS vote FROM (" + MODELS_SQL.split("WITH m AS (")[1].split(" FROM orders)")[0] + " FROM orders)")
def vote_weights(spark, sf_dir):
    out = scoring.vote(_models(spark, sf_dir), MODELS, {"m1": 0.2, "m2": 0.3}, "regression")
    return out.select("o_orderkey", money("vote", 6).alias("vote"))


@query("udf_vote", "SELECT o_orderkey, greatest(m1, m2, m3) AS vote FROM (" + MODELS_SQL.split("WITH m AS (")[1].split(" FROM orders)")[0] + " FROM orders)")
def udf_vote(spark, sf_dir):
    out = scoring.vote(_models(spark, sf_dir), MODELS, logic=lambda df, models, weights: F.greatest(*models))
    return out.select("o_orderkey", "vote")


def _second(votes: list[float], weights: list[float]) -> float:
    """Weighted lower median: the least vote that half of the weight does not exceed."""
    total, reached = sum(weights), 0.0
    for vote, weight in sorted(zip(votes, weights)):
        reached += weight
        if 2 * reached >= total:
            return vote
    return votes[-1]


@query(
    "udf_vote_aggregate",
    """WITH v AS (SELECT l_orderkey, l_suppkey % 5 AS model, l_quantity AS vote, CASE l_suppkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS w FROM lineitem),
      c AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey ORDER BY vote, w ROWS UNBOUNDED PRECEDING) AS reached, sum(w) OVER (PARTITION BY l_orderkey) AS total FROM v)
    SELECT l_orderkey, min(vote)::DOUBLE AS vote FROM c WHERE 2 * reached >= total GROUP BY 1""",
)
def udf_vote_aggregate(spark, sf_dir):
    """A user's own rule over the votes of each order, as a grouped aggregate."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_suppkey % 5 AS STRING) AS model", "l_quantity")
    return scoring.vote_aggregate(lines, ["l_orderkey"], "model", "l_quantity", _second, {"0": 3, "1": 1, "2": 2})


@query(
    "parallel_merge",
    "SELECT p_partkey, p_retailprice * 2 AS price, upper(p_type) AS p_type, p_size % 2 = 0 AS even FROM part",
)
def parallel_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    branches = [
        lambda df: {"price": F.col("p_retailprice"), "p_type": F.upper("p_type")},
        lambda df: {"price": F.col("p_retailprice") * 2, "even": F.col("p_size") % 2 == 0},
    ]
    return scoring.parallel_merge(part, branches).drop("p_size", "p_retailprice")


def _judged(spark, sf_dir):
    """Labelled documents with a score from their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")
    score = F.least(F.col("n_chars") / 4000, F.lit(1.0))
    return docs.join(labels, "doc_id").select(
        "doc_id", "quality", "toxic", score.alias("score"), (score > 0.2).cast("int").alias("predicted")
    )


JUDGED = """(SELECT d.doc_id, quality, toxic, least(n_chars / 4000, 1.0) AS score, (least(n_chars / 4000, 1.0) > 0.2)::INT AS predicted
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@query(
    "eval_confusion",
    f"""SELECT t.v AS truth, p.v AS predicted, round(coalesce(n, 0) / sum(n) OVER (PARTITION BY t.v), 6) AS value
    FROM (SELECT unnest([0, 1]) AS v) t CROSS JOIN (SELECT unnest([0, 1]) AS v) p
    LEFT JOIN (SELECT quality, predicted, count(*) AS n FROM {JUDGED} GROUP BY 1, 2) c ON c.quality = t.v AND c.predicted = p.v""",
)
def eval_confusion(spark, sf_dir):
    out = evaluation.confusion(_judged(spark, sf_dir), "quality", "predicted", normalize="true")
    return out.withColumn("value", money("value", 6))


@query(
    "eval_roc",
    f"""WITH s AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS n FROM {JUDGED} GROUP BY 1)
    SELECT score AS threshold, round(sum(n) OVER w / (SELECT sum(n) FROM s), 9) AS fpr, round(sum(p) OVER w / (SELECT sum(p) FROM s), 9) AS tpr
    FROM s WINDOW w AS (ORDER BY score DESC)
    UNION ALL SELECT 'inf'::DOUBLE, 0, 0""",
)
def eval_roc(spark, sf_dir):
    out = evaluation.roc_curve(_judged(spark, sf_dir), "quality", "score")
    return out.withColumns({"fpr": money("fpr", 9), "tpr": money("tpr", 9)})


@query(
    "eval_auc",
    f"""SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 9) AS auc
    FROM {JUDGED} a, {JUDGED} b WHERE a.quality = 1 AND b.quality = 0""",
)
def eval_auc(spark, sf_dir):
    return evaluation.auc(_judged(spark, sf_dir), "quality", "score").select(money("auc", 9).alias("auc"))


CLASS_SCORES = """(SELECT o_orderkey, substring(o_orderpriority, 1, 1)::INT AS t, 1 + o_custkey % 3 AS w,
      unnest([1, 2, 3]) AS label, round(abs(sin(o_totalprice)) * 20) / 20 + CASE WHEN substring(o_orderpriority, 1, 1)::INT = unnest([1, 2, 3]) THEN 0.1 ELSE 0 END AS s FROM orders)"""


def _class_scores(spark, sf_dir):
    """Priority classes with a coarse score for three of them, and weights."""
    orders = table(spark, sf_dir, "orders")
    t = F.substring("o_orderpriority", 1, 1).cast("int")
    base = F.round(F.abs(F.sin("o_totalprice")) * 20) / 20
    return orders.select(
        t.alias("t"), (1 + F.col("o_custkey") % 3).alias("w"),
        *[(base + F.when(t == label, 0.1).otherwise(0.0)).alias(f"s{label}") for label in (1, 2, 3)],
    )


@query(
    "eval_roc_classes",
    f"""WITH s AS (SELECT label, s, sum(CASE WHEN t = label THEN w ELSE 0 END) AS p, sum(CASE WHEN t = label THEN 0 ELSE w END) AS n FROM {CLASS_SCORES} GROUP BY ALL)
    SELECT label, round(s, 6) AS threshold, round(sum(n) OVER w / sum(n) OVER (PARTITION BY label), 9) AS fpr, round(sum(p) OVER w / sum(p) OVER (PARTITION BY label), 9) AS tpr
    FROM s WINDOW w AS (PARTITION BY label ORDER BY s DESC)
    UNION ALL SELECT unnest([1, 2, 3]), 'inf'::DOUBLE, 0, 0""",
)
def eval_roc_classes(spark, sf_dir):
    out = evaluation.class_roc(_class_scores(spark, sf_dir), "t", {1: "s1", 2: "s2", 3: "s3"}, "w")
    return out.withColumns({"threshold": money("threshold", 6), "fpr": money("fpr", 9), "tpr": money("tpr", 9)})


@query(
    "eval_auc_classes",
    f"""WITH s AS (SELECT label, s, sum(CASE WHEN t = label THEN w ELSE 0 END) AS p, sum(CASE WHEN t = label THEN 0 ELSE w END) AS n FROM {CLASS_SCORES} GROUP BY ALL)
    SELECT a.label, round((sum(CASE WHEN a.s > b.s THEN a.p * b.n WHEN a.s = b.s THEN a.p * b.n / 2 ELSE 0 END) / (max(tp) * max(tn)))::DOUBLE, 9) AS auc
    FROM s a JOIN s b USING (label) JOIN (SELECT label, sum(p) AS tp, sum(n) AS tn FROM s GROUP BY 1) USING (label) GROUP BY 1""",
)
def eval_auc_classes(spark, sf_dir):
    out = evaluation.class_auc(_class_scores(spark, sf_dir), "t", {1: "s1", 2: "s2", 3: "s3"}, "w")
    return out.withColumn("auc", money("auc", 9))


@query(
    "eval_calibration",
    f"""SELECT ((score > 0.2)::INT + (score > 0.4)::INT + (score > 0.6000000000000001)::INT + (score > 0.8)::INT)::INT AS bin, round(avg(score), 6) AS mean_predicted, round(avg(quality), 6) AS observed, count(*) AS n FROM {JUDGED} GROUP BY 1""",
)
def eval_calibration(spark, sf_dir):
    out = evaluation.calibration(_judged(spark, sf_dir), "quality", "score")
    return out.withColumns({"mean_predicted": money("mean_predicted", 6), "observed": money("observed", 6)})


@query(
    "eval_calibration_quantile",
    f"""WITH j AS {JUDGED}, q AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e FROM j)
    SELECT len(list_filter(e, lambda x: x < score))::INT AS bin, round(avg(score), 6) AS mean_predicted, round(avg(quality), 6) AS observed, count(*) AS n FROM j, q GROUP BY 1""",
)
def eval_calibration_quantile(spark, sf_dir):
    out = evaluation.calibration(_judged(spark, sf_dir), "quality", "score", strategy="quantile")
    return out.withColumns({"mean_predicted": money("mean_predicted", 6), "observed": money("observed", 6)})


@query(
    "eval_metrics",
    f"""WITH c AS (SELECT sum((quality = 1 AND predicted = 1)::INT) AS tp, sum((quality = 0 AND predicted = 1)::INT) AS fp,
        sum((quality = 1 AND predicted = 0)::INT) AS fn, sum((quality = 0 AND predicted = 0)::INT) AS tn FROM {JUDGED})
    SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def eval_metrics(spark, sf_dir):
    out = evaluation.classification_scores(_judged(spark, sf_dir), "quality", "predicted")
    return out.select(*[money(c, 6).alias(c) for c in out.columns])


@query(
    "eval_metrics_multiclass",
    """WITH m AS (SELECT substring(o_orderpriority, 1, 1)::INT AS t, (o_custkey % 5 + 1)::INT AS p FROM orders),
      l AS (SELECT c, (SELECT count(*) FROM m WHERE t = c AND p = c) AS tp, (SELECT count(*) FROM m WHERE p = c) AS np, (SELECT count(*) FROM m WHERE t = c) AS nt
        FROM (SELECT unnest([1, 2, 3, 4, 5]) AS c)),
      s AS (SELECT tp, nt, tp / np AS pr, tp / nt AS re, 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) AS f FROM l)
    SELECT round(sum(tp) / sum(nt), 6) AS accuracy, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f), 6) AS f1, 'macro' AS average FROM s
    UNION ALL SELECT round(sum(tp) / sum(nt), 6), round(sum(pr * nt) / sum(nt), 6), round(sum(re * nt) / sum(nt), 6), round(sum(f * nt) / sum(nt), 6), 'weighted' FROM s""",
)
def eval_metrics_multiclass(spark, sf_dir):
    models = _models(spark, sf_dir)
    parts = [
        evaluation.classification_scores(models, "m1", "m3", a).withColumn("average", F.lit(a)) for a in ("macro", "weighted")
    ]
    out = parts[0].unionByName(parts[1])
    return out.withColumns({c: money(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "eval_metrics_regression",
    f"""WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - ({PREDICTED}) AS e FROM lineitem)
    SELECT round(avg(abs(e)), 4) AS mae, round(avg(e * e), 1) AS mse, round(sqrt(avg(e * e)), 4) AS rmse,
      round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e""",
)
def eval_metrics_regression(spark, sf_dir):
    out = evaluation.regression_scores(_scored(spark, sf_dir), "l_extendedprice", "predicted")
    return out.select(money("mae", 4).alias("mae"), money("mse", 1).alias("mse"), money("rmse", 4).alias("rmse"), money("r2", 6).alias("r2"))


def _runs(spark, sf_dir):
    """A run per supplier; suppliers of even nations have one iteration per return flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )
    child = F.struct(
        F.col("l_returnflag").alias("iter"),
        F.lit("completed").alias("state"),
        F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("parameters"),
        F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("qty"), F.col("qty")).alias("results"),
    )
    children = lines.groupBy("l_suppkey").agg(F.collect_list(child).alias("iterations"))
    suppliers = table(spark, sf_dir, "supplier")
    runs_table = suppliers.join(children, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return runs_table.select(
        F.col("s_name").alias("name"),
        F.lit("0").alias("iter"),
        F.when(F.col("s_acctbal") < 0, "error").otherwise("completed").alias("state"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("parameters"),
        F.create_map(F.lit("balance"), F.col("s_acctbal")).alias("results"),
        F.when(F.col("s_nationkey") % 2 == 0, F.col("iterations")).alias("iterations"),
    )


@query(
    "runs_flatten",
    """WITH l AS (SELECT l_suppkey, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2)
    SELECT s_name AS name, l_returnflag AS iter, 'completed' AS state, NULL::VARCHAR AS "param.nation", l_returnflag AS "param.flag",
      NULL::DOUBLE AS "output.balance", n::DOUBLE AS "output.n", qty AS "output.qty" FROM supplier JOIN l ON l_suppkey = s_suppkey WHERE s_nationkey % 2 = 0
    UNION ALL SELECT s_name, '0', CASE WHEN s_acctbal < 0 THEN 'error' ELSE 'completed' END, s_nationkey::VARCHAR, NULL, s_acctbal, NULL, NULL
    FROM supplier WHERE s_nationkey % 2 = 1 OR s_suppkey NOT IN (SELECT l_suppkey FROM l)""",
)
def runs_flatten(spark, sf_dir):
    expanded = runs.expand_iterations(_runs(spark, sf_dir))
    return runs.flatten_maps(
        expanded,
        {"parameters": ("param.", ["nation", "flag"]), "results": ("output.", ["balance", "n", "qty"])},
    )
