"""Tabular operators around the graph: casts, filters, keyed maps, upserts, pivots, vocabulary merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import table

# Words of captions that show a diagram, and of captions that show results.
DIAGRAM_WORDS = ("diagram", "network", "framework", "flowchart", "flow chart", "architecture")
RESULT_WORDS = ("result", "plot", "graph", "image", "dataset")


def cast_all(df: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """Every column as ``kind``; values that are none become null, or raise with ``strict``."""
    return df.select(*(F.col(c).cast(kind).alias(c) if strict else F.col(c).try_cast(kind).alias(c) for c in df.columns))


def stars(c: Column) -> Column:
    """Number of stars written as ``1,234``."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("int")


def blank_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin("", "None"), F.trim(c))


def valid_date(c: Column) -> Column:
    """A date as it is written if it is one in the form year-month-day, else null."""
    return F.when(F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd")).isNotNull(), F.trim(c))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in an order; one aggregation, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_"))
    return picked.select(*keys, *(F.col(f"_.{c}").alias(c) for c in rest))


def last_written(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key in an order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_"))
    return picked.select(*keys, *(F.col(f"_.{c}").alias(c) for c in rest))


def upsert_do_nothing(current: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, the first of each key: what an insert on conflict do nothing adds."""
    return first_seen(new.filter(F.col(key).isNotNull()), [key], order).join(current.select(key), key, "left_anti")


def update_by_key(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``current`` with the columns of ``updates`` where its key is updated; a null there keeps the old value."""
    fields = [c for c in updates.columns if c != key]
    joined = current.join(updates.select(key, *(F.col(c).alias(f"_{c}") for c in fields)), key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns))


def conflict_free(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value, and the value; keys in conflict are dropped with all their rows."""
    values = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return values.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_last")).filter(F.col(value) == F.col("_last")).drop("_last")


def union_first_wins(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in order of preference: of equal keys the row of the earliest part, there the first in ``order``."""
    ranked = [p.withColumn("_rank", F.lit(k)) for k, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p)
    return first_seen(out, keys, ["_rank", *order]).drop("_rank")


def mint_uri(term: Column, space: str = "http://example.org/term/") -> Column:
    """Address of a term: blanks become ``_``, the rest is quoted."""
    return F.concat(F.lit(space), F.url_encode(F.replace(term, F.lit(" "), F.lit("_"))))


def is_diagram_caption(c: Column) -> Column:
    has = lambda words: F.greatest(*(F.contains(F.lower(c), F.lit(w)) for w in words))
    return has(DIAGRAM_WORDS) & ~has(RESULT_WORDS)


def between_markers(c: Column, start: str, end: str) -> Column:
    """Lower-cased text after the first ``start`` up to the next ``end``; null unless both stand beyond the first letter."""
    low = F.lower(c)
    return F.when((F.instr(low, start) > 1) & (F.instr(low, end) > 1), F.element_at(F.split(F.element_at(F.split(low, start), 2), end), 1))


def metadata_record(files: DataFrame) -> DataFrame:
    """One row per directory from its small files (dir_name, key, value): blanks and bad dates are null, stars a number."""
    wide = files.groupBy("dir_name").pivot("key", ["title", "framework", "date", "tags", "stars", "code", "paper"]).agg(F.min("value"))
    return wide.select(
        "dir_name",
        *(blank_to_null(F.col(c)).alias(c) for c in ("title", "framework", "tags", "code", "paper")),
        valid_date(blank_to_null(F.col("date"))).alias("date"),
        stars(blank_to_null(F.col("stars"))).alias("stars"),
    )


def within_bounds(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """Rows of keys that have more than ``least`` and fewer than ``most`` rows, counted before the rows are joined back."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > least) & (F.col("_n") < most))
    return df.join(sizes.select(key), key, "left_semi")


def leaderboard_rows(tasks: DataFrame) -> DataFrame:
    """(task, category, paper_url) of the result rows in a nested leaderboard; data sets without results give none."""
    each = tasks.select("task", F.explode("datasets").alias("d")).filter("d.sota is not null")
    return each.select("task", F.col("d.dataset").alias("dataset"), F.explode("d.sota.sota_rows").alias("r")).select("task", "dataset", F.col("r.paper_url").alias("paper_url"))


def _leaderboard(s, d) -> DataFrame:
    """Regions as tasks, their nations as data sets, suppliers as result rows, by way of JSON text."""
    sup = table(s, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct(F.col("s_name").alias("paper_url")))).alias("rows"))
    nat = table(s, d, "nation").join(sup, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    sets = nat.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("dataset"), F.when(F.col("rows").isNotNull(), F.struct(F.col("rows").alias("sota_rows"))).alias("sota"))).alias("datasets"))
    text = table(s, d, "region").join(sets, F.col("r_regionkey") == F.col("n_regionkey")).select(F.to_json(F.struct(F.col("r_name").alias("task"), "datasets")).alias("j"))
    kind = "struct<task:string,datasets:array<struct<dataset:string,sota:struct<sota_rows:array<struct<paper_url:string>>>>>>"
    return leaderboard_rows(text.select(F.from_json("j", kind).alias("j")).select("j.*"))


def queries() -> dict:
    papers = lambda s, d: table(s, d, "paper")
    named = lambda s, d: table(s, d, "entity").filter("entitytext is not null and ent_type is not null").select(F.lower(F.trim("entitytext")).alias("term"), F.col("ent_type").alias("type"))

    def upsert(s, d):
        p = papers(s, d).select("stored_dir_name", "title", "batch_no", "paper_id")
        return upsert_do_nothing(p.filter("batch_no = 0"), p.filter("batch_no > 0"), "stored_dir_name", ["batch_no", "paper_id"]).select("stored_dir_name", "title", "paper_id")

    def update(s, d):
        orders = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("c_acctbal")).withColumnRenamed("o_custkey", "c_custkey").filter("c_acctbal > 400000")
        return update_by_key(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), orders, "c_custkey")

    def records(s, d):
        p = first_seen(papers(s, d).filter("stored_dir_name is not null").select("stored_dir_name", "batch_no", "paper_id", "title", "framework", "pdate", "tags", "stars", "code", "paper_link"), ["stored_dir_name"], ["batch_no", "paper_id"])
        pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("title", "title"), ("framework", "framework"), ("date", "pdate"), ("tags", "tags"), ("stars", "stars"), ("code", "code"), ("paper", "paper_link"))))
        files = p.select(F.col("stored_dir_name").alias("dir_name"), F.explode(pairs).alias("f")).select("dir_name", "f.key", "f.value")
        return metadata_record(files)

    def merged(s, d):
        new = table(s, d, "layer_type_stardard").select(F.col("variant").alias("term"), F.lit("Method").alias("type"))
        old = conflict_free(named(s, d).distinct(), "term", "type")
        return union_first_wins([new, old], ["term"], ["type"])

    def minted(s, d):
        known = table(s, d, "layer_type_stardard").select(F.col("variant").alias("term"))
        terms = named(s, d).filter(F.rlike("term", F.lit("^[a-z ]+$"))).select("term").distinct()
        return terms.join(known, "term", "left_anti").select("term", mint_uri(F.col("term")).alias("uri"))

    return {
        "upsert_do_nothing": upsert,
        "update_by_key": update,
        "metadata_pivot": records,
        "conflict_free_vocab": lambda s, d: conflict_free(named(s, d).distinct(), "term", "type"),
        "relation_union_first_wins": merged,
        "minted_uris": minted,
        "caption_filter": lambda s, d: table(s, d, "documents").filter(is_diagram_caption(F.col("text"))).select("doc_id"),
        "cast_columns": lambda s, d: cast_all(table(s, d, "paper").select("paper_id", "stars", "pdate", "tags").drop("tags"), "double"),
        "abstract_between_markers": lambda s, d: table(s, d, "documents").select("doc_id", between_markers(F.col("text"), "in practice", "on average").alias("abstract")).filter("abstract is not null"),
        "sota_explode": _leaderboard,
        "first_seen_label": lambda s, d: first_seen(table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], ["o_orderkey"]),
        "last_write_wins": lambda s, d: last_written(table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], ["o_orderkey"]),
        "papers_within_bounds": lambda s, d: within_bounds(table(s, d, "entity").filter("stored_dir_name is not null").select("entity_id", "stored_dir_name").distinct(), "stored_dir_name", 3, 1000),
        "framework_links": lambda s, d: papers(s, d).filter(F.contains(F.col("framework"), F.lit("tf")) & F.contains(F.col("code"), F.lit("codeharbour"))).select("paper_id", "framework"),
        "try_cast_stars": lambda s, d: papers(s, d).select("paper_id", stars(F.col("stars")).alias("stars")),
    }


def oracle_sql() -> dict[str, str]:
    named = "named AS (SELECT DISTINCT lower(trim(entitytext, ' ')) AS term, ent_type AS type FROM entity WHERE entitytext IS NOT NULL AND ent_type IS NOT NULL), one AS (SELECT term, min(type) AS type FROM named GROUP BY term HAVING count(DISTINCT type) = 1)"
    first = "row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS rn"
    clean = lambda c: f"CASE WHEN trim({c}, ' ') NOT IN ('', 'None') THEN trim({c}, ' ') END"
    return {
        "upsert_do_nothing": f"SELECT stored_dir_name, title, paper_id FROM (SELECT *, {first.format(k='stored_dir_name', o='batch_no, paper_id')} FROM paper WHERE batch_no > 0 AND stored_dir_name IS NOT NULL) WHERE rn = 1 AND stored_dir_name NOT IN (SELECT stored_dir_name FROM paper WHERE batch_no = 0 AND stored_dir_name IS NOT NULL)",
        "update_by_key": "SELECT c_custkey, c_name, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000) ON c_custkey = o_custkey",
        "metadata_pivot": f"SELECT stored_dir_name AS dir_name, {clean('title')} AS title, {clean('framework')} AS framework, {clean('tags')} AS tags, {clean('code')} AS code, {clean('paper_link')} AS paper, CASE WHEN regexp_full_match(trim(pdate, ' '), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(trim(pdate, ' ') AS DATE) IS NOT NULL THEN trim(pdate, ' ') END AS date, CASE WHEN regexp_full_match(replace(trim(stars, ' '), ',', ''), '[+-]?\\d+(\\.\\d*)?') THEN try_cast(trunc(try_cast(replace(trim(stars, ' '), ',', '') AS DOUBLE)) AS INTEGER) END AS stars FROM (SELECT *, {first.format(k='stored_dir_name', o='batch_no, paper_id')} FROM paper WHERE stored_dir_name IS NOT NULL) WHERE rn = 1",
        "conflict_free_vocab": f"WITH {named} SELECT term, type FROM one",
        "relation_union_first_wins": f"WITH {named} SELECT variant AS term, 'Method' AS type FROM layer_type_stardard UNION SELECT term, type FROM one WHERE term NOT IN (SELECT variant FROM layer_type_stardard)",
        "minted_uris": f"WITH {named} SELECT DISTINCT term, 'http://example.org/term/' || replace(term, ' ', '_') AS uri FROM named WHERE regexp_full_match(term, '[a-z ]+') AND term NOT IN (SELECT variant FROM layer_type_stardard)",
        "cast_columns": "SELECT CAST(paper_id AS DOUBLE) AS paper_id, TRY_CAST(trim(stars) AS DOUBLE) AS stars, TRY_CAST(trim(pdate) AS DOUBLE) AS pdate FROM paper",
        "caption_filter": "SELECT doc_id FROM (SELECT doc_id, lower(text) AS c FROM documents) WHERE regexp_matches(c, 'diagram|network|framework|flowchart|flow chart|architecture') AND NOT regexp_matches(c, 'result|plot|graph|image|dataset')",
        "abstract_between_markers": "SELECT doc_id, string_split(string_split(t, 'in practice')[2], 'on average')[1] AS abstract FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE instr(t, 'in practice') > 1 AND instr(t, 'on average') > 1",
        "sota_explode": "SELECT r_name AS task, n_name AS dataset, s_name AS paper_url FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey",
        "first_seen_label": "SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
        "last_write_wins": "SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
        "papers_within_bounds": "SELECT entity_id, stored_dir_name FROM (SELECT *, count(*) OVER (PARTITION BY stored_dir_name) AS n FROM (SELECT DISTINCT entity_id, stored_dir_name FROM entity WHERE stored_dir_name IS NOT NULL)) WHERE n > 3 AND n < 1000",
        "framework_links": "SELECT paper_id, framework FROM paper WHERE framework LIKE '%tf%' AND code LIKE '%codeharbour%'",
        "try_cast_stars": "SELECT paper_id, CASE WHEN regexp_full_match(replace(trim(stars, ' '), ',', ''), '[+-]?\\d+(\\.\\d*)?') THEN try_cast(trunc(try_cast(replace(trim(stars, ' '), ',', '') AS DOUBLE)) AS INTEGER) END AS stars FROM paper",
    }
