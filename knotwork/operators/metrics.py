"""Metrics of classifiers, rankings, spans and link prediction, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.sampling import running_sums
from knotwork.session import table


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one confusion count."""
    c = confusion(df, truth, guess)
    by_truth = c.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hits"))
    by_guess = c.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("guessed"))
    p = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    r = F.col("hits") / F.col("support")
    return by_truth.join(by_guess, "class", "left").select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(F.col("hits") > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def token_scores(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Precision, recall and F1 over sub-tokens of names."""
    hits = F.size(F.array_intersect(truth, guess))
    sums = df.agg(F.sum(hits).alias("tp"), F.sum(F.size(guess) - hits).alias("fp"), F.sum(F.size(truth) - hits).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return sums.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def mean_rank(df: DataFrame, rank: str) -> DataFrame:
    return df.agg(F.round(F.avg(rank), 6).alias("mean_rank"), F.round(F.avg(1 / F.col(rank)), 6).alias("mrr"), F.round(F.avg((F.col(rank) <= 10).cast("double")), 6).alias("hits_at_10"))


def span_scores(gold: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc", "start", "end", "label")) -> DataFrame:
    """Precision, recall and F1 of labelled spans; spans are sets."""
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(found.select(*keys).distinct().withColumn("f", F.lit(1)), list(keys), "full")
    s = both.agg(F.count("g").alias("g"), F.count("f").alias("f"), F.sum(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0)).alias("b"))
    p, r = F.col("b") / F.nullif("f", F.lit(0)), F.col("b") / F.nullif("g", F.lit(0))
    return s.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties shared; scores are counted first, so each distinct score is one row."""
    c = df.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    won = running_sums(c, [score], {"upto": "n"}).select("p", "n", (F.col("upto") - F.col("n")).alias("below"))
    return won.agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n")), 6).alias("auc"))


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Average precision: precision at each distinct score times the recall gained there."""
    c = df.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("t"))
    run = running_sums(c, [F.desc(score)], {"cp": "p", "ct": "t"})
    return run.agg(F.round(F.sum(F.col("p") * F.col("cp") / F.col("ct")) / F.sum("p"), 6).alias("average_precision"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def edge_weights(edges: DataFrame, nodes: int) -> DataFrame:
    """Weight of positive edges and the norm of the reconstruction loss of a graph of ``nodes`` nodes."""
    n2 = float(nodes * nodes)
    return edges.agg(F.count(F.lit(1)).alias("e")).select(F.round((n2 - F.col("e")) / F.col("e"), 6).alias("pos_weight"), F.round(n2 / ((n2 - F.col("e")) * 2), 6).alias("norm"))


def early_stops(costs: DataFrame, order: str, cost: str, k: int) -> DataFrame:
    """Rows whose cost is above the mean of the k before."""
    w = Window.orderBy(order).rowsBetween(-k, -1)
    return costs.withColumn("_m", F.avg(cost).over(w)).withColumn("_n", F.count(cost).over(w)).filter((F.col("_n") == k) & (F.col(cost) > F.col("_m"))).drop("_m", "_n")


def _scored(s, d) -> DataFrame:
    e = table(s, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("label_b"))
    return e.join(other, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("b")), 4).alias("score"), (F.col("label") == F.col("label_b")).alias("positive"))


def _guess(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("truth"), (F.pmod(F.col("o_orderkey") * 31 + F.col("o_custkey"), F.lit(5)) + 1).cast("int").alias("guess"))


def queries() -> dict:
    def spans(s, d):
        e = table(s, d, "entity").filter("entitytext is not null and stored_dir_name is not null and ent_type is not null")
        e = e.select(F.col("stored_dir_name").alias("doc"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.col("ent_type").alias("label"), F.length("entitytext").alias("size"))
        return span_scores(e.filter("size < 20"), e.filter("size > 8"))

    def names(s, d):
        p = table(s, d, "part")
        return token_scores(p, F.split("p_name", " "), F.split(F.concat_ws(" ", F.split("p_name", " ")[0], F.lower("p_type")), " "))

    return {
        "edge_auc": lambda s, d: auc(_scored(s, d), "score", "positive"),
        "edge_average_precision": lambda s, d: average_precision(_scored(s, d), "score", "positive"),
        "confusion_matrix": lambda s, d: confusion(_guess(s, d), "truth", "guess"),
        "class_report": lambda s, d: class_report(_guess(s, d), "truth", "guess"),
        "mean_reciprocal_rank": lambda s, d: mean_rank(table(s, d, "lineitem").select(F.col("l_linenumber").alias("rank")), "rank"),
        "subtoken_scores": names,
        "span_scores": spans,
        "edge_weights": lambda s, d: edge_weights(table(s, d, "orders"), 2000),
        "early_stops": lambda s, d: early_stops(table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 2).alias("cost")), "day", "cost", 10).select("day"),
    }


def oracle_sql() -> dict[str, str]:
    scored = "WITH s AS (SELECT round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score, a.label = b.label AS positive FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), c AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM s GROUP BY score)"
    guess = "WITH g AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS truth, CAST((o_orderkey * 31 + o_custkey) % 5 + 1 AS INTEGER) AS guess FROM orders)"
    return {
        "edge_auc": f"{scored} SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)",
        "edge_average_precision": f"{scored} SELECT round(sum(p * cp * 1.0 / ct) / sum(p), 6) AS average_precision FROM (SELECT p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(p + n) OVER (ORDER BY score DESC) AS ct FROM c)",
        "confusion_matrix": f"{guess} SELECT truth, guess, count(*) AS n FROM g GROUP BY 1, 2",
        "class_report": f"{guess}, t AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = guess) AS hits FROM g GROUP BY 1), u AS (SELECT guess AS class, count(*) AS guessed FROM g GROUP BY 1) SELECT class, support, round(hits / guessed, 6) AS precision, round(hits / support, 6) AS recall, round(2 * (hits / guessed) * (hits / support) / (hits / guessed + hits / support), 6) AS f1 FROM t JOIN u USING (class)",
        "mean_reciprocal_rank": "SELECT round(avg(l_linenumber), 6) AS mean_rank, round(avg(1.0 / l_linenumber), 6) AS mrr, round(avg(CASE WHEN l_linenumber <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_10 FROM lineitem",
        "subtoken_scores": "WITH p AS (SELECT string_split(p_name, ' ') AS t, [string_split(p_name, ' ')[1], lower(p_type)] AS g FROM part), s AS (SELECT sum(len(list_intersect(t, g))) AS tp, sum(len(g) - len(list_intersect(t, g))) AS fp, sum(len(t) - len(list_intersect(t, g))) AS fn FROM p) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM s",
        "span_scores": "WITH e AS (SELECT stored_dir_name AS doc, start_pos, end_pos, ent_type, length(entitytext) AS size FROM entity WHERE entitytext IS NOT NULL AND stored_dir_name IS NOT NULL AND ent_type IS NOT NULL), g AS (SELECT DISTINCT doc, start_pos, end_pos, ent_type FROM e WHERE size < 20), f AS (SELECT DISTINCT doc, start_pos, end_pos, ent_type FROM e WHERE size > 8), b AS (SELECT (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM g JOIN f USING (doc, start_pos, end_pos, ent_type)) AS nb) SELECT round(nb / nf, 6) AS precision, round(nb / ng, 6) AS recall, round(2 * (nb / nf) * (nb / ng) / (nb / nf + nb / ng), 6) AS f1 FROM b",
        "edge_weights": "SELECT round((4000000.0 - count(*)) / count(*), 6) AS pos_weight, round(4000000.0 / ((4000000.0 - count(*)) * 2), 6) AS norm FROM orders",
        "early_stops": "WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 2) AS cost FROM orders GROUP BY 1) SELECT day FROM (SELECT *, avg(cost) OVER w AS m, count(cost) OVER w AS n FROM c WINDOW w AS (ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE n = 10 AND cost > m",
    }
