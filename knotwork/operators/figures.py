"""Geometry of diagrams: overlaps, nearest components, suppression of repeated boxes, layer sequences, flow votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.closure import components
from knotwork.operators.construction import spread
from knotwork.session import table

# Which layer may follow which.
VALID_NEXT = {
    "input": ("dense", "conv", "embed", "rnn", "lstm", "norm", "concat"),
    "conv": ("conv", "flatten", "dropout", "pooling", "concat", "norm", "activation"),
    "deconv": ("deconv", "unpooling", "norm", "activation"),
    "dense": ("dense", "dropout", "concat", "embed", "loss", "norm", "activation", "output"),
    "flatten": ("dense", "dropout", "concat", "embed", "norm"),
    "dropout": ("dense", "dropout", "concat", "embed", "lstm", "rnn", "lstmseq", "rnnseq"),
    "pooling": ("conv", "flatten", "dropout", "pooling", "concat", "dense"),
    "unpooling": ("conv", "deconv"),
    "concat": ("dense", "dropout", "concat", "embed", "conv", "deconv", "flatten", "pooling", "rnn", "rnnseq", "LSTM", "LSTMseq", "norm"),
    "rnn": ("dense", "dropout", "concat", "embed", "loss", "norm", "output"),
    "rnnseq": ("flatten", "dropout", "concat", "rnn", "rnnseq", "lstm", "lstmseq", "output"),
    "lstm": ("conv", "dropout", "concat", "embed", "loss", "norm", "output"),
    "lstmseq": ("flatten", "dropout", "concat", "rnn", "rnnseq", "lstm", "lstmseq", "output"),
    "norm": ("dense", "relu"),
    "embed": ("concat", "rnn", "lstm", "rnnseq", "lstmseq"),
    "activation": ("flatten", "dropout", "upsample", "conv", "pooling", "loss"),
    "loss": ("output",),
}

BOX = ("x1", "y1", "x2", "y2")


def overlaps(a: str, b: str) -> Column:
    """Whether boxes with the prefixes touch or overlap."""
    c = lambda p, k: F.col(f"{p}{k}")
    return ~((c(a, "x2") < c(b, "x1")) | (c(a, "y2") < c(b, "y1")) | (c(a, "x1") > c(b, "x2")) | (c(a, "y1") > c(b, "y2")))


def cells(df: DataFrame, size: float) -> DataFrame:
    """Each box once per grid cell that it touches, as columns ``cx`` and ``cy``."""
    low = lambda k: F.floor(F.col(k) / size).cast("int")
    return df.withColumn("cx", F.explode(F.sequence(low("x1"), low("x2")))).withColumn("cy", F.explode(F.sequence(low("y1"), low("y2"))))


def overlap_join(boxes: DataFrame, figure: str, key: str, size: float) -> DataFrame:
    """(figure, a, b): pairs a < b of overlapping boxes of one figure, by an equi-join on grid cells.

    A pair is reported from the cell of the upper left corner of what they share, so no pair repeats and none needs a
    distinct.
    """
    cut = cells(boxes.select(figure, key, *BOX), size)
    side = lambda p: cut.select(figure, "cx", "cy", *(F.col(c).alias(f"{p}{c}") for c in (key, *BOX)))
    both = side("a_").join(side("b_"), [figure, "cx", "cy"]).filter((F.col(f"a_{key}") < F.col(f"b_{key}")) & overlaps("a_", "b_"))
    home = (F.floor(F.greatest("a_x1", "b_x1") / size) == F.col("cx")) & (F.floor(F.greatest("a_y1", "b_y1") / size) == F.col("cy"))
    return both.filter(home).select(figure, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))


def box_pairs(boxes: DataFrame, figure: str, key: str, size: float, test: Column, reach: float = 0.0) -> DataFrame:
    """(figure, a, b): ordered pairs of different boxes of a figure that pass ``test`` on columns a_x1 .. b_y2.

    Only boxes of which the second touches the first, widened by ``reach``, meet; each pair is made in one grid cell.
    """
    wide = boxes.select(figure, key, *((F.col(c) - reach if c[1] == "1" else F.col(c) + reach).alias(c) for c in BOX))
    side = lambda df, p: cells(df.select(figure, key, *BOX), size).select(figure, "cx", "cy", *(F.col(c).alias(f"{p}{c}") for c in (key, *BOX)))
    both = side(wide, "w_").join(side(boxes, "b_"), [figure, "cx", "cy"]).filter((F.col(f"w_{key}") != F.col(f"b_{key}")) & overlaps("w_", "b_"))
    home = (F.floor(F.greatest("w_x1", "b_x1") / size) == F.col("cx")) & (F.floor(F.greatest("w_y1", "b_y1") / size) == F.col("cy"))
    back = [(F.col(f"w_{c}") + reach if c[1] == "1" else F.col(f"w_{c}") - reach).alias(f"a_{c}") for c in BOX]
    return both.filter(home).select(figure, F.col(f"w_{key}").alias("a"), F.col(f"b_{key}").alias("b"), *back, *(f"b_{c}" for c in BOX)).filter(test).select(figure, "a", "b")


def contained_join(boxes: DataFrame, figure: str, key: str, size: float) -> DataFrame:
    """(figure, a, b): boxes b that lie within a box a."""
    c = F.col
    return box_pairs(boxes, figure, key, size, (c("b_x1") >= c("a_x1")) & (c("b_y1") >= c("a_y1")) & (c("b_x2") <= c("a_x2")) & (c("b_y2") <= c("a_y2")))


def near_join(boxes: DataFrame, figure: str, key: str, size: float, reach: float) -> DataFrame:
    """(figure, a, b), a < b: boxes at most ``reach`` apart in both directions."""
    return box_pairs(boxes, figure, key, size, F.col("a") < F.col("b"), reach)


def segment_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction of a line in degrees from 0 up to 180, whichever end comes first."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)) + 180.0, F.lit(180.0))


def point_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a line between two ends."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length)))
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))


def line_groups(lines: DataFrame, figure: str, key: str, far: float = 10.0, turn: float = 1.0) -> DataFrame:
    """(figure, x1, y1, x2, y2, parts): lines that run alike and close together, merged from their first to their last end.

    Two lines belong together if an end of one is nearer than ``far`` to the other and their directions differ by less than
    ``turn`` degrees; groups are closed over such pairs. Ends are ordered by x in flat groups and by y in steep ones.
    """
    low = [F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2")]
    met = box_pairs(lines.select(figure, key, *low), figure, key, 64.0, F.col("a") < F.col("b"), far)
    end = lambda p: lines.select(figure, F.col(key).alias(p), *(F.col(c).alias(f"{p}{c}") for c in BOX))
    both = met.join(end("a"), [figure, "a"]).join(end("b"), [figure, "b"])
    c = F.col
    gaps = [point_distance(c(f"{p}x{k}"), c(f"{p}y{k}"), c(f"{q}x1"), c(f"{q}y1"), c(f"{q}x2"), c(f"{q}y2")) for p, q in (("a", "b"), ("b", "a")) for k in (1, 2)]
    off = F.abs(segment_angle(*(c(f"a{x}") for x in BOX)) - segment_angle(*(c(f"b{x}") for x in BOX)))
    same = both.filter((F.least(*gaps) < far) & (F.least(off, 180.0 - off) < turn))
    name = lambda k: F.concat_ws(" ", c(figure).cast("string"), c(k).cast("string"))
    group = components(same.select(name("a").alias("src"), name("b").alias("dst"))).select(F.col("node").alias("_n"), "component")
    rows = lines.withColumn("_n", name(key)).join(group, "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    ends = rows.select(figure, "component", F.abs(c("x2") - c("x1")).alias("w"), F.abs(c("y2") - c("y1")).alias("h"), F.explode(F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y")))).alias("e"))
    flat = lambda f: f(F.struct("e.x", "e.y"))
    steep = lambda f: f(F.struct("e.y", "e.x"))
    out = ends.groupBy(figure, "component").agg(flat(F.min).alias("f1"), flat(F.max).alias("f2"), steep(F.min).alias("s1"), steep(F.max).alias("s2"), F.sum("w").alias("w"), F.sum("h").alias("h"), (F.count(F.lit(1)) / 2).cast("long").alias("parts"))
    pick = lambda f, g, k: F.when(c("w") >= c("h"), c(f"{f}.{k}")).otherwise(c(f"{g}.{k}"))
    return out.select(figure, pick("f1", "s1", "x").alias("x1"), pick("f1", "s1", "y").alias("y1"), pick("f2", "s2", "x").alias("x2"), pick("f2", "s2", "y").alias("y2"), "parts")


def nearest_ends(lines: DataFrame, figure: str, key: str, far: float = 10.0) -> DataFrame:
    """(figure, line, end, other, distance): for each end of a line (1 or 2) the nearest end of another line within ``far``."""
    ends = lines.select(figure, F.col(key).alias("line"), F.posexplode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("k", "e"))
    ends = ends.select(figure, "line", (F.col("k") + 1).alias("end"), "e.x", "e.y")
    low = lambda v: F.floor(F.col(v) / far).cast("int")
    mine = ends.withColumn("cx", F.explode(F.sequence(low("x") - 1, low("x") + 1))).withColumn("cy", F.explode(F.sequence(low("y") - 1, low("y") + 1)))
    other = ends.select(figure, F.col("line").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), low("x").alias("cx"), low("y").alias("cy"))
    d = F.round(F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)), 6)
    met = mine.join(other, [figure, "cx", "cy"]).filter("line <> other").withColumn("d", d).filter(F.col("d") <= far)
    return met.groupBy(figure, "line", "end").agg(F.min(F.struct("d", "other")).alias("m")).select(figure, "line", "end", "m.other", F.col("m.d").alias("distance"))


def merged_texts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, best, mean): texts of the parts from top to bottom and left to right, their largest and mean confidence."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y1", "x1", "text"))), lambda x: x["text"])
    return parts.groupBy(*keys).agg(F.array_join(ordered, " ").alias("text"), F.max("conf").alias("best"), F.round(F.avg("conf"), 6).alias("mean"))


def first_uncovered(sources: list[DataFrame], figure: str, key: str, size: float) -> DataFrame:
    """Boxes of several detectors: those of the first, then of each next the ones that overlap none kept so far."""
    kept = sources[0].select(figure, key, *BOX)
    for more in sources[1:]:
        kept = kept.unionByName(uncovered(more.select(figure, key, *BOX), kept, figure, key, size))
    return kept


def outline_boxes(outlines: DataFrame, figure: str, solid: float = 0.4) -> DataFrame:
    """Outlines (figure, shape, box, area) whose area fills more than ``solid`` of their box, merged per figure and shape."""
    box = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    full = outlines.filter(F.col("area") > solid * box).withColumn("_g", F.struct(figure, "shape"))
    name = F.concat_ws(" ", F.col(f"_g.{figure}").cast("string"), F.col("_g.shape"))
    return merge_pool(full.select(name.alias("group"), *BOX), "group")


def figure_facts(figures: DataFrame, parts: DataFrame, steps: DataFrame) -> DataFrame:
    """(s, p, o) lines of figures (fig, paper, caption, flow), parts (fig, part, kind, text, x1, y1) and steps (fig, src, dst)."""
    f = F.col("fig").cast("string")
    named = lambda c: F.concat_ws("_", f, F.lit("Comp"), F.col(c).cast("string"))
    about = spread(figures, [(f, "isA", F.lit("Figure")), (f, "hasCaption", F.col("caption")), (f, "foundIn", F.col("paper")), (f, "hasFlow", F.col("flow"))])
    of = spread(parts, [(named("part"), "partOf", f), (named("part"), "isType", F.col("kind")), (named("part"), "hasDescription", F.nullif(F.col("text"), F.lit(""))), (named("part"), "hasPos", F.concat_ws(",", F.col("x1").cast("string"), F.col("y1").cast("string")))])
    return about.unionByName(of).unionByName(spread(steps, [(named("src"), "followedBy", named("dst"))]))


def uncovered(boxes: DataFrame, by: DataFrame, figure: str, key: str, size: float) -> DataFrame:
    """Boxes that overlap none of ``by`` in their figure."""
    other = cells(by.select(figure, *(F.col(c) for c in BOX)), size).select(figure, "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in BOX))
    mine = cells(boxes.select(figure, key, *BOX), size)
    hit = mine.join(other, [figure, "cx", "cy"]).filter(~((F.col("x2") < F.col("o_x1")) | (F.col("y2") < F.col("o_y1")) | (F.col("x1") > F.col("o_x2")) | (F.col("y1") > F.col("o_y2"))))
    return boxes.join(hit.select(figure, key).distinct(), [figure, key], "left_anti")


def nearest(points: DataFrame, boxes: DataFrame, figure: str, point: str, key: str, limit: float) -> DataFrame:
    """(figure, point, box, distance) of the nearest box within ``limit`` of each point; ties go to the least box.

    Only boxes in grid cells that the limit reaches meet a point.
    """
    near = cells(boxes.select(figure, key, *BOX).select(figure, key, *((F.col(c) - limit if c[1] == "1" else F.col(c) + limit).alias(c) for c in BOX)), max(limit, 1.0))
    near = near.select(figure, key, "cx", "cy", *((F.col(c) + limit if c[1] == "1" else F.col(c) - limit).alias(c) for c in BOX))
    at = points.select(figure, point, "px", "py", F.floor(F.col("px") / max(limit, 1.0)).cast("int").alias("cx"), F.floor(F.col("py") / max(limit, 1.0)).cast("int").alias("cy"))
    gap = lambda v, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col(v), F.col(v) - F.col(hi))
    d = F.round(F.sqrt(F.pow(gap("px", "x1", "x2"), 2) + F.pow(gap("py", "y1", "y2"), 2)), 6)
    met = at.join(near, [figure, "cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= limit)
    best = met.groupBy(figure, point).agg(F.min(F.struct("distance", key)).alias("m"))
    return best.select(figure, point, F.col(f"m.{key}").alias("box"), F.col("m.distance").alias("distance"))


def _per_figure(boxes: DataFrame, figure: str, fields: list[str], one: Callable[[list[tuple]], list[tuple]], kind: str, names: list[str]) -> DataFrame:
    """Apply a sequential rule to the boxes of each figure; figures are small, independent and go in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            rows = []
            for f, group in zip(b.column("f").to_pylist(), b.column("g").to_pylist(), strict=True):
                rows += [(f, *r) for r in one(sorted(tuple(x[c] for c in fields) for x in group))]
            inner = b.column("g").type.value_type
            kinds = [b.column("f").type, *(pa.int32() if n == "merged" else inner.field(n).type for n in names[1:])]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            schema = pa.schema(list(zip(names, kinds, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], schema=schema)

    return boxes.groupBy(F.col(figure).alias("f")).agg(F.collect_list(F.struct(*fields)).alias("g")).mapInArrow(run, kind)


def suppress(boxes: DataFrame, figure: str, key: str, confidence: str, limit: float = 0.5) -> DataFrame:
    """Boxes left by greedy suppression: from the surest down, boxes whose own area is covered beyond ``limit`` go."""
    fields = [confidence, key, *BOX]
    kinds = dict(boxes.dtypes)

    def one(group: list[tuple]) -> list[tuple]:
        left = sorted(group, key=lambda r: (-r[0], r[1]))
        kept = []
        while left:
            top, left = left[0], left[1:]
            kept.append(top)
            x1, y1, x2, y2 = top[2:]
            shared = lambda r: max(0.0, min(x2, r[4]) - max(x1, r[2])) * max(0.0, min(y2, r[5]) - max(y1, r[3]))  # noqa: B023, E731
            left = [r for r in left if shared(r) <= limit * (r[4] - r[2]) * (r[5] - r[3])]
        return kept

    return _per_figure(boxes, figure, fields, one, ", ".join(f"{c} {kinds[c]}" for c in (figure, *fields)), [figure, *fields])


def merge_pool(boxes: DataFrame, figure: str) -> DataFrame:
    """Boxes of each figure after overlapping ones are merged into their hull until none overlap, with how many went in."""
    kinds = dict(boxes.dtypes)

    def one(group: list[tuple]) -> list[tuple]:
        pool = [(*r, 1) for r in group]
        while True:
            out: list[tuple] = []
            for r in sorted(pool):
                hit = next((k for k, o in enumerate(out) if not (o[2] < r[0] or o[3] < r[1] or o[0] > r[2] or o[1] > r[3])), None)
                if hit is None:
                    out.append(r)
                else:
                    o = out[hit]
                    out[hit] = (min(o[0], r[0]), min(o[1], r[1]), max(o[2], r[2]), max(o[3], r[3]), o[4] + r[4])
            if len(out) == len(pool):
                return out
            pool = out

    kind = f"{figure} {kinds[figure]}, " + ", ".join(f"{c} {kinds[c]}" for c in BOX) + ", merged int"
    return _per_figure(boxes, figure, list(BOX), one, kind, [figure, *BOX, "merged"])


def layer_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst, src_layer, dst_layer): component pairs (a, b, a_layer, b_layer) put in an order that layers allow.

    A pair that is allowed as it stands keeps its order, one that is only allowed the other way is turned, others go.
    """
    rows = [(a, b) for a, after in VALID_NEXT.items() for b in after]
    valid = F.broadcast(pairs.sparkSession.createDataFrame(rows, "u string, v string"))
    marked = pairs.join(valid.select(F.col("u").alias("a_layer"), F.col("v").alias("b_layer"), F.lit(1).alias("_f")), ["a_layer", "b_layer"], "left")
    marked = marked.join(valid.select(F.col("v").alias("a_layer"), F.col("u").alias("b_layer"), F.lit(1).alias("_r")), ["a_layer", "b_layer"], "left")
    turn = F.col("_f").isNull()
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return marked.filter("_f is not null or _r is not null").select(pick("a", "b").alias("src"), pick("b", "a").alias("dst"), pick("a_layer", "b_layer").alias("src_layer"), pick("b_layer", "a_layer").alias("dst_layer"))


def dominant_flow(steps: DataFrame, figure: str, order: str) -> DataFrame:
    """Direction of each figure: a running vote of steps to the right against others that stays turned once negative."""
    vote = F.when(F.col("sx") < F.col("ex"), 1).otherwise(-1)
    run = steps.select(figure, F.sum(vote).over(Window.partitionBy(figure).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return run.groupBy(figure).agg(F.when(F.min("run") < 0, "right-to-left").otherwise("left-to-right").alias("flow"))


def shape_name(vertices: Column, ratio: Column) -> Column:
    """Shape by the number of corners of its outline and the ratio of its sides."""
    return F.when(vertices == 3, "triangle").when((vertices == 4) & ratio.between(0.95, 1.05), "square").when(vertices == 4, "rectangle").when(vertices == 5, "pentagon").otherwise("circle")


def _boxes(s, d) -> DataFrame:
    """Lines of an order as boxes of a figure, by arithmetic."""
    k = F.col("l_partkey") * 13 + F.col("l_suppkey") * 7 + F.col("l_linenumber")
    x, y = F.pmod(k, F.lit(400)).cast("int"), F.pmod(k * 3, F.lit(300)).cast("int")
    rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"))
    return rows.select(F.col("l_orderkey").alias("fig"), F.col("l_linenumber").alias("box"), x.alias("x1"), y.alias("y1"), (x + 40 + F.col("l_quantity").cast("int")).alias("x2"), (y + 30 + F.col("l_linenumber") * 5).alias("y2"), F.col("l_quantity").alias("conf"))


_BOX_SQL = """b AS (SELECT l_orderkey AS fig, l_linenumber AS box, CAST(k % 400 AS INTEGER) AS x1, CAST((k * 3) % 300 AS INTEGER) AS y1, CAST(k % 400 + 40 + CAST(q AS INTEGER) AS INTEGER) AS x2,
  CAST((k * 3) % 300 + 30 + l_linenumber * 5 AS INTEGER) AS y2, q AS conf FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) * 13 + max(l_suppkey) * 7 + l_linenumber AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2))"""


def queries() -> dict:
    layers = list(VALID_NEXT)

    def pairs(s, d):
        b = table(s, d, "part").select("p_partkey", "p_size", "p_brand")
        name = lambda c: F.element_at(F.array(*map(F.lit, layers)), F.pmod(c, F.lit(len(layers))).cast("int") + 1)
        return b.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), name(F.col("p_partkey") * 5).alias("a_layer"), name(F.col("p_partkey") * 3 + F.col("p_size")).alias("b_layer"))

    def points(s, d):
        return table(s, d, "orders").select(F.col("o_orderkey").alias("fig"), F.lit(0).alias("point"), F.pmod(F.col("o_custkey") * 17, F.lit(450)).cast("double").alias("px"), F.pmod(F.col("o_custkey") * 29, F.lit(350)).cast("double").alias("py"))

    def flow(s, d):
        b = _boxes(s, d)
        nxt = b.select("fig", (F.col("box") - 1).alias("box"), F.col("x1").alias("ex"))
        return dominant_flow(b.join(nxt, ["fig", "box"]).select("fig", "box", F.col("x1").alias("sx"), "ex"), "fig", "box")

    def lines(s, d):
        k, n = F.col("l_partkey") * 13 + F.col("l_suppkey"), F.col("l_linenumber")
        rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
        x, y = F.pmod(k, F.lit(40)).cast("int") * 5, F.pmod(n, F.lit(4)) * 4
        steep = F.pmod(k, F.lit(3)) == 0
        return rows.select(F.col("l_orderkey").alias("fig"), n.alias("line"), x.alias("x1"), y.alias("y1"), F.when(steep, x).otherwise(x + 60).alias("x2"), F.when(steep, y + 50).otherwise(y).alias("y2"))

    def texts(s, d):
        t = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("fig"), F.col("l_linenumber").alias("box")).agg(F.min("l_shipdate").cast("date").cast("string").alias("text"))
        return _boxes(s, d).join(t, ["fig", "box"])

    def detectors(s, d):
        return [_boxes(s, d).filter(F.pmod("box", F.lit(3)) == k) for k in (1, 2, 0)]

    def facts(s, d):
        b = _boxes(s, d)
        o = table(s, d, "orders").select(F.col("o_orderkey").alias("fig"), F.concat(F.lit("paper"), F.col("o_custkey").cast("string")).alias("paper"), F.col("o_orderpriority").alias("caption"))
        name = F.element_at(F.array(*map(F.lit, layers)), F.pmod("box", F.lit(len(layers))).cast("int") + 1)
        nxt = b.select("fig", F.col("box").alias("dst"), (F.col("box") - 1).alias("src"))
        steps = b.select("fig", F.col("box").alias("src")).join(nxt, ["fig", "src"])
        return figure_facts(o.join(flow(s, d), "fig", "left"), b.select("fig", F.col("box").alias("part"), name.alias("kind"), F.when(F.col("box") % 2 == 0, F.lit("")).otherwise(F.lit("text")).alias("text"), "x1", "y1"), steps)

    return {
        "rect_contained_join": lambda s, d: contained_join(_boxes(s, d), "fig", "box", 64.0),
        "rect_near_join": lambda s, d: near_join(_boxes(s, d), "fig", "box", 64.0, 10.0),
        "line_groups": lambda s, d: line_groups(lines(s, d), "fig", "line"),
        "nearest_line_ends": lambda s, d: nearest_ends(lines(s, d), "fig", "line"),
        "component_texts": lambda s, d: merged_texts(texts(s, d), ["fig"]),
        "detector_merge": lambda s, d: first_uncovered(detectors(s, d), "fig", "box", 64.0).select("fig", "box"),
        "outline_boxes": lambda s, d: outline_boxes(_boxes(s, d).select("fig", F.when(F.col("box") % 2 == 0, "square").otherwise("circle").alias("shape"), *BOX, (F.col("conf") * 60).alias("area")), "fig"),
        "figure_facts": facts,
        "boxes_in_order": lambda s, d: _boxes(s, d).select("fig", "box", F.row_number().over(Window.partitionBy("fig").orderBy("x1", "y1", "box")).alias("place")),
        "rect_overlap_join": lambda s, d: overlap_join(_boxes(s, d), "fig", "box", 64.0),
        "rect_uncovered": lambda s, d: uncovered(_boxes(s, d).filter("conf < 25"), _boxes(s, d).filter("conf >= 25"), "fig", "box", 64.0).select("fig", "box"),
        "nearest_component": lambda s, d: nearest(points(s, d), _boxes(s, d), "fig", "point", "box", 25.0).select("fig", "box", "distance"),
        "layer_sequence_edges": lambda s, d: layer_edges(pairs(s, d)),
        "dominant_flow": flow,
        "box_suppression": lambda s, d: suppress(_boxes(s, d), "fig", "box", "conf").select("fig", "box"),
        "box_merge": lambda s, d: merge_pool(_boxes(s, d), "fig"),
        "shape_names": lambda s, d: table(s, d, "part").select("p_partkey", shape_name(F.pmod("p_size", F.lit(7)), F.round(F.col("p_retailprice") / 1000, 2)).alias("shape")),
    }


def oracle_sql() -> dict[str, str]:
    over = "NOT (a.x2 < b.x1 OR a.y2 < b.y1 OR a.x1 > b.x2 OR a.y1 > b.y2)"
    layers = "[" + ", ".join(f"'{x}'" for x in VALID_NEXT) + "]"
    valid = ", ".join(f"('{a}', '{b}')" for a, t in VALID_NEXT.items() for b in t)
    n = len(VALID_NEXT)
    line = """l AS (SELECT l_orderkey AS fig, l_linenumber AS line, CAST(k % 40 * 5 AS INTEGER) AS x1, CAST(l_linenumber % 4 * 4 AS INTEGER) AS y1, CAST(CASE WHEN k % 3 = 0 THEN k % 40 * 5 ELSE k % 40 * 5 + 60 END AS INTEGER) AS x2,
      CAST(CASE WHEN k % 3 = 0 THEN l_linenumber % 4 * 4 + 50 ELSE l_linenumber % 4 * 4 END AS INTEGER) AS y2, k % 3 = 0 AS steep FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) * 13 + max(l_suppkey) AS k FROM lineitem GROUP BY 1, 2))"""
    # lines are flat or steep here, so the distance of an end from a line is that from a box without width
    gap = lambda x, y, q: f"sqrt(pow(greatest(0, {q}.x1 - {x}, {x} - {q}.x2), 2) + pow(greatest(0, {q}.y1 - {y}, {y} - {q}.y2), 2))"
    ends = 'e AS (SELECT fig, line, 1 AS "end", x1 AS x, y1 AS y FROM l UNION ALL SELECT fig, line, 2, x2, y2 FROM l)'
    near = ", ".join(gap(f"{p}.x{k}", f"{p}.y{k}", q) for p, q in (("a", "b"), ("b", "a")) for k in (1, 2))
    apart = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
    shared = "greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1)) > 0.5 * (o.x2 - o.x1) * (o.y2 - o.y1)"
    box = "{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}"
    return {
        "rect_contained_join": f"WITH {_BOX_SQL} SELECT a.fig AS fig, a.box AS a, b.box AS b FROM b a JOIN b ON a.fig = b.fig AND a.box <> b.box AND b.x1 >= a.x1 AND b.y1 >= a.y1 AND b.x2 <= a.x2 AND b.y2 <= a.y2",
        "rect_near_join": f"WITH {_BOX_SQL} SELECT a.fig AS fig, a.box AS a, b.box AS b FROM b a JOIN b ON a.fig = b.fig AND a.box < b.box AND NOT (a.x2 + 10 < b.x1 OR a.y2 + 10 < b.y1 OR a.x1 - 10 > b.x2 OR a.y1 - 10 > b.y2)",
        "line_groups": f"WITH RECURSIVE {line}, p AS (SELECT a.fig, a.line AS u, b.line AS v FROM l a JOIN l b ON a.fig = b.fig AND a.line <> b.line AND a.steep = b.steep AND least({near}) < 10), r AS (SELECT fig, line AS u, line AS v FROM l UNION SELECT r.fig, r.u, p.v FROM r JOIN p ON p.fig = r.fig AND p.u = r.v), c AS (SELECT fig, u AS line, min(v) AS c FROM r GROUP BY 1, 2) SELECT fig, CASE WHEN bool_or(steep) THEN arg_min(x1, (y1, x1)) ELSE min(x1) END AS x1, CASE WHEN bool_or(steep) THEN min(y1) ELSE arg_min(y1, (x1, y1)) END AS y1, CASE WHEN bool_or(steep) THEN arg_max(x2, (y2, x2)) ELSE max(x2) END AS x2, CASE WHEN bool_or(steep) THEN max(y2) ELSE arg_max(y2, (x2, y2)) END AS y2, count(*) AS parts FROM l JOIN c USING (fig, line) GROUP BY fig, c",
        "nearest_line_ends": f'WITH {line}, {ends} SELECT fig, line, "end", other, distance FROM (SELECT a.fig, a.line, a."end", b.line AS other, round({apart}, 6) AS distance, row_number() OVER (PARTITION BY a.fig, a.line, a."end" ORDER BY round({apart}, 6), b.line) AS rn FROM e a JOIN e b ON a.fig = b.fig AND a.line <> b.line AND {apart} <= 10) WHERE rn = 1',
        "component_texts": f"WITH {_BOX_SQL}, t AS (SELECT l_orderkey AS fig, l_linenumber AS box, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS txt FROM lineitem GROUP BY 1, 2) SELECT fig, string_agg(txt, ' ' ORDER BY y1, x1, txt) AS text, max(conf) AS best, round(avg(conf), 6) AS mean FROM b JOIN t USING (fig, box) GROUP BY fig",
        "detector_merge": f"WITH {_BOX_SQL}, k1 AS (SELECT * FROM b WHERE box % 3 = 1), k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM b a WHERE a.box % 3 = 2 AND NOT EXISTS (SELECT 1 FROM k1 b WHERE b.fig = a.fig AND {over})), k3 AS (SELECT * FROM k2 UNION ALL SELECT * FROM b a WHERE a.box % 3 = 0 AND NOT EXISTS (SELECT 1 FROM k2 b WHERE b.fig = a.fig AND {over})) SELECT fig, box FROM k3",
        "figure_facts": f"""WITH {_BOX_SQL}, st AS (SELECT a.fig, a.box, CASE WHEN a.x1 < b.x1 THEN 1 ELSE -1 END AS v FROM b a JOIN b ON a.fig = b.fig AND b.box = a.box + 1), run AS (SELECT fig, sum(v) OVER (PARTITION BY fig ORDER BY box) AS run FROM st), fl AS (SELECT fig, CASE WHEN min(run) < 0 THEN 'right-to-left' ELSE 'left-to-right' END AS flow FROM run GROUP BY fig),
          f AS (SELECT CAST(o_orderkey AS VARCHAR) AS f, 'paper' || o_custkey AS paper, o_orderpriority AS caption, flow FROM orders LEFT JOIN fl ON fig = o_orderkey), c AS (SELECT CAST(fig AS VARCHAR) AS f, fig || '_Comp_' || box AS c, {layers}[box % {n} + 1] AS kind, box, x1, y1 FROM b)
          SELECT f AS s, 'isA' AS p, 'Figure' AS o FROM f UNION ALL SELECT f, 'hasCaption', caption FROM f UNION ALL SELECT f, 'foundIn', paper FROM f UNION ALL SELECT f, 'hasFlow', flow FROM f WHERE flow IS NOT NULL UNION ALL SELECT c, 'partOf', f FROM c UNION ALL SELECT c, 'isType', kind FROM c
          UNION ALL SELECT c, 'hasDescription', 'text' FROM c WHERE box % 2 = 1 UNION ALL SELECT c, 'hasPos', x1 || ',' || y1 FROM c UNION ALL SELECT a.c, 'followedBy', b.c FROM c a JOIN c b ON a.f = b.f AND b.box = a.box + 1""",
        "boxes_in_order": f"WITH {_BOX_SQL} SELECT fig, box, CAST(row_number() OVER (PARTITION BY fig ORDER BY x1, y1, box) AS INTEGER) AS place FROM b",
        "box_suppression": f"WITH RECURSIVE {_BOX_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY fig ORDER BY conf DESC, box) AS rn FROM b), r AS (SELECT fig, rn AS k, [{box}] AS kept, box, TRUE AS stays FROM o WHERE rn = 1 UNION ALL SELECT o.fig, o.rn, CASE WHEN len(list_filter(r.kept, lambda q: {shared})) > 0 THEN r.kept ELSE list_append(r.kept, {box}) END, o.box, len(list_filter(r.kept, lambda q: {shared})) = 0 FROM r JOIN o ON o.fig = r.fig AND o.rn = r.k + 1) SELECT fig, box FROM r WHERE stays",
        "rect_overlap_join": f"WITH {_BOX_SQL} SELECT a.fig AS fig, a.box AS a, b.box AS b FROM b a JOIN b ON a.fig = b.fig AND a.box < b.box AND {over}",
        "rect_uncovered": f"WITH {_BOX_SQL} SELECT a.fig AS fig, a.box AS box FROM b a WHERE a.conf < 25 AND NOT EXISTS (SELECT 1 FROM b WHERE b.fig = a.fig AND b.conf >= 25 AND {over})",
        "nearest_component": f"WITH {_BOX_SQL}, p AS (SELECT o_orderkey AS fig, CAST((o_custkey * 17) % 450 AS DOUBLE) AS px, CAST((o_custkey * 29) % 350 AS DOUBLE) AS py FROM orders), m AS (SELECT p.fig, box, round(sqrt(pow(greatest(0.0, x1 - px, px - x2), 2) + pow(greatest(0.0, y1 - py, py - y2), 2)), 6) AS distance FROM p JOIN b ON p.fig = b.fig) SELECT fig, box, distance FROM (SELECT *, row_number() OVER (PARTITION BY fig ORDER BY distance, box) AS rn FROM m WHERE distance <= 25) WHERE rn = 1",
        "layer_sequence_edges": f"WITH v AS (SELECT * FROM (VALUES {valid}) t(u, v)), p AS (SELECT p_partkey AS a, p_partkey + 1 AS b, {layers}[(p_partkey * 5) % {n} + 1] AS la, {layers}[(p_partkey * 3 + p_size) % {n} + 1] AS lb FROM part), q AS (SELECT *, EXISTS (SELECT 1 FROM v WHERE u = la AND v.v = lb) AS f, EXISTS (SELECT 1 FROM v WHERE u = lb AND v.v = la) AS r FROM p) SELECT CASE WHEN f THEN a ELSE b END AS src, CASE WHEN f THEN b ELSE a END AS dst, CASE WHEN f THEN la ELSE lb END AS src_layer, CASE WHEN f THEN lb ELSE la END AS dst_layer FROM q WHERE f OR r",
        "dominant_flow": f"WITH {_BOX_SQL}, st AS (SELECT a.fig, a.box, CASE WHEN a.x1 < b.x1 THEN 1 ELSE -1 END AS v FROM b a JOIN b ON a.fig = b.fig AND b.box = a.box + 1), r AS (SELECT fig, sum(v) OVER (PARTITION BY fig ORDER BY box) AS run FROM st) SELECT fig, CASE WHEN min(run) < 0 THEN 'right-to-left' ELSE 'left-to-right' END AS flow FROM r GROUP BY fig",
        "shape_names": "SELECT p_partkey, CASE WHEN v = 3 THEN 'triangle' WHEN v = 4 AND r BETWEEN 0.95 AND 1.05 THEN 'square' WHEN v = 4 THEN 'rectangle' WHEN v = 5 THEN 'pentagon' ELSE 'circle' END AS shape FROM (SELECT p_partkey, p_size % 7 AS v, round(p_retailprice / 1000, 2) AS r FROM part)",
    }
