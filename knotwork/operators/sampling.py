"""Ranks, samples and splits that repeat exactly: order comes from arithmetic on keys, never from a random generator."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import stage_table, table


def turn(key: Column, salt: int = 0) -> Column:
    """A whole number below 2^31 that scatters keys, the same in every engine."""
    return F.pmod(key * 1_103_515_245 + F.lit(12_345 + salt), F.lit(2_147_483_648))


def numbered(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """Rows with their number from 0 in an order, without a task that holds them all.

    The rows are sorted by ranges and written; the numbers of rows per range, one small row each, give every range its first.
    """
    rows = stage_table(df.orderBy(*order).withColumn("_r", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("_r", (F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_f"))
    return rows.join(F.broadcast(first), "_r").withColumn(name, F.col("_f") + F.col("_k")).drop("_r", "_k", "_f")


def running_sums(df: DataFrame, order: list, columns: dict[str, str]) -> DataFrame:
    """Rows with sums of columns up to and with the row in an order that tells all rows apart: {new column: column}.

    The rows are sorted by ranges and written; sums within a range are added to the sums of all ranges before it, of which
    there is one small row each, so no task holds all rows.
    """
    rows = stage_table(df.orderBy(*order).withColumn("_r", F.spark_partition_id()), "running")
    totals = rows.groupBy("_r").agg(*(F.sum(c).alias(f"_{n}") for n, c in columns.items()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("_r", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in columns))
    inside = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(first), "_r").select(*df.columns, *((F.col(f"_{n}") + F.sum(c).over(inside)).alias(n) for n, c in columns.items()))


def most_similar(vectors: DataFrame, key: str, vector: str, asked: DataFrame, top: int = 10, most: int = 200_000, digits: int = 6) -> DataFrame:
    """(key, rank, other, score): for each asked row the ``top`` rows of the highest cosine, itself not among them.

    The asked vectors, whose number is checked, go to the tasks in blocks; every task keeps the best of its own rows, and
    the best of all tasks are chosen per asked row. Scores are compared rounded, ties go to the lesser key.
    """
    rows = [(r[0], r[1]) for r in asked.select(key, vector).filter(F.col(vector).isNotNull()).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} asked vectors")
    if not rows:
        return vectors.select(F.col(key), F.lit(0).alias("rank"), F.col(key).alias("other"), F.lit(0.0).alias("score")).limit(0)
    ids, kind = np.array([r[0] for r in rows]), dict(vectors.dtypes)[key]
    unit = np.array([r[1] for r in rows], float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for b in batches:
            other = np.array(b.column(0).to_pylist())
            v = np.array(b.column(1).to_pylist(), float)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for at in range(0, len(ids), 256):
                score = np.round(unit[at : at + 256] @ v.T, digits)
                score[ids[at : at + 256, None] == other[None, :]] = -2.0
                for k in range(len(score)):
                    turn = np.lexsort((other, -score[k]))[:top]
                    best[at + k] = sorted([*best[at + k], *((-float(score[k][j]), int(other[j])) for j in turn if score[k][j] > -2)])[:top]
        out = [(int(i), o, -s) for i, found in zip(ids, best, strict=True) for s, o in found]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], [key, "other", "score"])

    each = vectors.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(task, f"{key} {kind}, other {kind}, score double")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "other")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(key, "rank", "other", "score")


def projected(vectors: DataFrame, key: str, vector: str, dims: int = 2) -> DataFrame:
    """(key, x): vectors on their ``dims`` principal axes; an axis may point either way."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return PCA(k=dims, inputCol="_v", outputCol="_x").fit(rows).transform(rows).select(key, vector_to_array("_x").alias("x"))


def ranked_counts(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(value, n, idx): values by falling count, ties by value, numbered from 0.

    Counts are aggregated first. The number of a value is that of all values with a larger count plus its place among
    equals, so only the table of distinct counts is ordered as a whole, and equals are ordered per count.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("n", (F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("before"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("value")) - 1
    return counts.withColumn("_p", place).join(before, "n").select("value", "n", (F.col("before") + F.col("_p")).alias("idx"))


def nth_smallest(df: DataFrame, value: Column, places: list[int], width: int = 1 << 16) -> list[int | None]:
    """The values at some places (from 1) in the order of a whole-numbered column; None beyond the last row.

    Rows are counted per range of values, and the range that holds the place is cut again until it is a single value, so
    each pass is a small aggregation and no task orders all rows. At most ``width`` counts of a place come to the driver.
    """
    rows = df.select(value.cast("long").alias("v")).filter("v is not null")
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    out: list[int | None] = []
    for place in places:
        if not 1 <= place <= n:
            out.append(None)
            continue
        lo, hi, left = low, high, place
        while lo < hi:
            step = -(-(hi - lo + 1) // width)
            counts = rows.filter(F.col("v").between(lo, hi)).groupBy(F.floor((F.col("v") - lo) / step).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()
            for k, m in counts:
                if left <= m:
                    lo, hi = lo + k * step, min(hi, lo + (k + 1) * step - 1)
                    break
                left -= m
        out.append(lo)
    return out


def train_only_split(triples: DataFrame, key: str, p: str, fixed: tuple[str, ...] = ("type", "label"), test: float = 0.2, valid: float = 0.2) -> DataFrame:
    """Triples with a part: those of fixed predicates are for training only; of the others, in an order that scatters keys,
    as many as ``test`` of *all* triples are tested, then ``valid`` of all are for validation, and the rest is for training."""
    free = triples.filter(~F.col(p).isin(*fixed))
    n = triples.count()
    t, v = nth_smallest(free, turn(F.col(key)), [int(n * test), int(n * test) + int(n * valid)])
    at = turn(F.col(key))
    last = lambda x: F.lit(-1 if n == 0 or x == 0 else x if x is not None else 1 << 31)
    part = F.when(F.col(p).isin(*fixed), "train").when(at <= last(t if int(n * test) else 0), "test").when(at <= last(v if int(n * valid) + int(n * test) else 0), "valid").otherwise("train")
    return triples.withColumn("part", part)


def capped_samples(df: DataFrame, group: str, key: str, size: int, most: int) -> DataFrame:
    """(group, sample_id, key): groups with more than ``size`` rows give min(rows // size, most) samples of ``size`` rows each."""
    w = Window.partitionBy(group).orderBy(turn(F.col(key)), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    rows = df.select(group, key, n.alias("_n"), (F.row_number().over(w) - 1).alias("_k"))
    rows = rows.withColumn("sample_id", F.floor(F.col("_k") / size).cast("int")).filter((F.col("_n") > size) & (F.col("sample_id") < F.least(F.floor(F.col("_n") / size), F.lit(most))))
    return rows.select(group, "sample_id", key)


def class_partners(df: DataFrame, key: str, label: str, classes: int) -> DataFrame:
    """(key, same, other): for every row one row of its class and one of the next class, by rank within the class.

    Rows are numbered within their class; partners are met by number, so no pairs of a class are made.
    """
    w = Window.partitionBy(label).orderBy(turn(F.col(key)), key)
    r = df.select(key, label, (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(label)).alias("n"))
    sizes = r.groupBy(label).agg(F.max("n").alias("n"))
    other = sizes.select(F.pmod(F.col(label) - 1, F.lit(classes)).alias(label), F.col("n").alias("m"), F.col(label).alias("next"))
    asked = r.join(other, label).withColumn("a", F.pmod(F.col("k") + 1, F.col("n"))).withColumn("b", F.pmod(F.col("k"), F.col("m")))
    same = r.select(F.col(label), F.col("k").alias("a"), F.col(key).alias("same"))
    rest = r.select(F.col(label).alias("next"), F.col("k").alias("b"), F.col(key).alias("other"))
    return asked.join(same, [label, "a"]).join(rest, ["next", "b"]).select(key, "same", "other")


def smooth_peaks(df: DataFrame, group: str, order: str, value: str, half: int = 7) -> DataFrame:
    """(group, peaks): local maxima of a series after smoothing with a Hanning window over 2 x half + 1 places.

    The weights are 0.5 - 0.5 cos(pi k / half), over their sum; places beyond the ends of the series count as 0.
    """
    w = Window.partitionBy(group).orderBy(order)
    near = lambda k: F.coalesce(F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else F.col(value), F.lit(0.0))
    terms = [near(k) * F.lit(round((0.5 + 0.5 * math.cos(math.pi * k / half)) / half, 12)) for k in range(1 - half, half)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    s = df.select(group, order, F.round(total, 6).alias("s"))
    peak = (F.col("s") > F.lag("s").over(w)) & (F.col("s") > F.lead("s").over(w))
    return s.withColumn("p", F.coalesce(peak, F.lit(False)).cast("long")).groupBy(group).agg(F.sum("p").alias("peaks"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): how many distinct edges enter each node, 0 for roots."""
    e = edges.select("src", "dst").distinct()
    counts = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return nodes.join(counts, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def hash_order_split(df: DataFrame, key: str, share: float) -> DataFrame:
    """Rows with ``held_out``: the share of rows that comes first in an order that scatters keys, exactly."""
    n = int(df.count() * share)
    at = nth_smallest(df, turn(F.col(key)), [n])[0]
    return df.withColumn("held_out", turn(F.col(key)) <= F.lit(at if n else -1))


def shortest(df: DataFrame, group: str, value: str) -> DataFrame:
    """The shortest value of each group, ties by value."""
    return df.groupBy(group).agg(F.min_by(value, F.struct(F.length(value), value)).alias(value))


def pdf_link(c: Column) -> Column:
    """Address of the file of a paper from that of its page."""
    return F.concat(F.regexp_replace(F.regexp_replace(c, "/abs/", "/pdf/"), r"\.pdf$", ""), F.lit(".pdf"))


def queries() -> dict:
    lines = lambda s, d: table(s, d, "lineitem")
    orders = lambda s, d: table(s, d, "orders")
    return {
        "word_ranks": lambda s, d: ranked_counts(table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")), "w"),
        "enumerated_terms": lambda s, d: ranked_counts(table(s, d, "entity"), "ent_type").select("value", "idx"),
        "kge_split": lambda s, d: train_only_split(orders(s, d).select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "type").otherwise("calls").alias("p")), "k", "p"),
        "function_samples": lambda s, d: capped_samples(orders(s, d).select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4, 3),
        "siamese_partners": lambda s, d: class_partners(table(s, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 10),
        "smoothed_peaks": lambda s, d: smooth_peaks(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value"),
        "main_files": lambda s, d: shortest(table(s, d, "repo").filter("code_path is not null and stored_dir_name is not null").select("stored_dir_name", "code_path"), "stored_dir_name", "code_path"),
        "pdf_links": lambda s, d: table(s, d, "paper").filter("paper_link is not null").select("paper_id", pdf_link(F.col("paper_link")).alias("link")),
        "bottom_functions": lambda s, d: lines(s, d).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy("n", F.desc("l_partkey")).limit(20),
        "numbered_papers": lambda s, d: numbered(table(s, d, "paper").filter(F.lower("framework").isin("tensorflow", "pytorch")).select("paper_id", "framework"), ["framework", "paper_id"]),
        "most_similar": lambda s, d: most_similar(table(s, d, "embeddings"), "vec_id", "embedding", table(s, d, "embeddings").filter("vec_id % 100 = 0"), 10, digits=4),
        "projected_vectors": lambda s, d: projected(table(s, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.size("x").alias("dims")),
        "in_degrees": lambda s, d: in_degrees(table(s, d, "part").select(F.col("p_partkey").alias("src"), (F.pmod(F.col("p_partkey") * 31, F.lit(97)) + 1).alias("dst"))),
        "doc_split": lambda s, d: hash_order_split(table(s, d, "documents").select("doc_id"), "doc_id", 0.1),
        "top_functions": lambda s, d: lines(s, d).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20),
        "distinct_neighbours": lambda s, d: lines(s, d).select("l_orderkey", "l_partkey", F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_shipdate")).alias("p")).filter("p is null or p <> l_partkey").select("l_orderkey", "l_partkey"),
        "adjacency_totals": lambda s, d: lines(s, d).select("l_partkey", "l_suppkey").distinct().agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("l_partkey").alias("rows"), F.count_distinct("l_suppkey").alias("cols")),
        "propagated_labels": lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(orders(s, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey"),
        "semi_joined_papers": lambda s, d: table(s, d, "paper").join(table(s, d, "repo").select("stored_dir_name"), "stored_dir_name", "left_semi").select("paper_id"),
        "node_labels": lambda s, d: table(s, d, "nation").join(table(s, d, "region").filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("N/A")).alias("label")),
    }


def oracle_sql() -> dict[str, str]:
    t = lambda k: f"(({k} * 1103515245 + 12345) % 2147483648)"
    rank = "row_number() OVER (ORDER BY n DESC, value) - 1"
    hanning = [round((0.5 - 0.5 * math.cos(2 * math.pi * j / 14)) / 7, 12) for j in range(15)]
    weights = " + ".join(f"coalesce({'lag' if k > 0 else 'lead'}(value, {abs(k)}) OVER w, 0.0) * CAST({hanning[k + 7]:.12f} AS DOUBLE)" if k else f"coalesce(value, 0.0) * CAST({hanning[7]:.12f} AS DOUBLE)" for k in range(-6, 7))
    return {
        "word_ranks": f"SELECT value, n, {rank} AS idx FROM (SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value)",
        "enumerated_terms": f"SELECT value, {rank} AS idx FROM (SELECT ent_type AS value, count(*) AS n FROM entity WHERE ent_type IS NOT NULL GROUP BY 1)",
        "kge_split": f"WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'type' ELSE 'calls' END AS p FROM orders), r AS (SELECT k, row_number() OVER (ORDER BY {t('k')}) AS rn, (SELECT count(*) FROM e) AS n FROM e WHERE p <> 'type') SELECT e.k, e.p, CASE WHEN rn <= floor(n * 0.2) THEN 'test' WHEN rn <= 2 * floor(n * 0.2) THEN 'valid' ELSE 'train' END AS part FROM e LEFT JOIN r USING (k)",
        "function_samples": f"SELECT o_custkey, CAST(k // 4 AS INTEGER) AS sample_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {t('o_orderkey')}, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 4 AND k // 4 < least(n // 4, 3)",
        "siamese_partners": f"WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {t('vec_id')}, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT a.vec_id, b.vec_id AS same, c.vec_id AS other FROM r a JOIN r b ON a.label = b.label AND b.k = (a.k + 1) % a.n JOIN r c ON c.label = (a.label + 1) % 10 AND c.k = a.k % c.n",
        "smoothed_peaks": f"WITH s AS (SELECT user_id, event_id, round({weights}, 6) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), p AS (SELECT user_id, s > lag(s) OVER w AND s > lead(s) OVER w AS p FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) FILTER (p) AS peaks FROM p GROUP BY 1",
        "main_files": "SELECT stored_dir_name, code_path FROM (SELECT *, row_number() OVER (PARTITION BY stored_dir_name ORDER BY length(code_path), code_path) AS rn FROM repo WHERE code_path IS NOT NULL AND stored_dir_name IS NOT NULL) WHERE rn = 1",
        "pdf_links": "SELECT paper_id, regexp_replace(regexp_replace(paper_link, '/abs/', '/pdf/', 'g'), '\\.pdf$', '') || '.pdf' AS link FROM paper WHERE paper_link IS NOT NULL",
        "bottom_functions": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n, l_partkey DESC LIMIT 20",
        "numbered_papers": "SELECT paper_id, framework, row_number() OVER (ORDER BY framework, paper_id) - 1 AS idx FROM paper WHERE lower(framework) IN ('tensorflow', 'pytorch')",
        "most_similar": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 4) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, CAST(rank AS INTEGER) AS rank, other, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM s) WHERE rank <= 10",
        "in_degrees": "WITH e AS (SELECT DISTINCT p_partkey AS src, (p_partkey * 31) % 97 + 1 AS dst FROM part), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, count(src) AS degree FROM n LEFT JOIN e ON node = dst GROUP BY node",
        "doc_split": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {t('doc_id')}) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, rn <= floor(n * 0.1) AS held_out FROM r",
        "top_functions": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20",
        "distinct_neighbours": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem",
        "adjacency_totals": "SELECT count(*) AS nnz, count(DISTINCT l_partkey) AS rows, count(DISTINCT l_suppkey) AS cols FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
        "propagated_labels": "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey",
        "semi_joined_papers": "SELECT paper_id FROM paper WHERE stored_dir_name IN (SELECT stored_dir_name FROM repo)",
        "node_labels": "SELECT n_name, coalesce(r_name, 'N/A') AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3",
    }
