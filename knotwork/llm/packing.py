"""Texts of varying length placed in containers of fixed capacity (problem 6), by sum-of-squares packing.

Each document goes where the sum of squares of the numbers of open containers per residual gap becomes smallest, a
new container being one of the choices. A document above the capacity fills containers of its own and its rest is
placed like a document. The rule is sequential, so the documents are dealt to shards by a hash of their id and each
(capacity, shard) is packed by one task, longest first; the number of shards follows the number of tokens
(``SHARD_TOKENS``), so a task's work is bounded at every scale and the rests of shards stay a small share. Only ids and
sizes are shuffled, never texts. Within a shard equal sizes keep the order of ids, so results do not depend on how the
input is partitioned.

Defined results: null or negative ``n_tokens`` counts as 0; documents of 0 tokens take no room and stand in the first
container of their shard; rows with one doc_id count once with their largest size; null doc_ids and capacities below 1
give no row; an empty table gives no container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a shard, about.
SHARD_TOKENS = 16_000_000
#: Most capacities, and most partitions of the packing step.
MOST_SPECS, MOST_PARTITIONS = 1000, 20_000

PLACED = "spec_id int, capacity_tokens int, container_id long, part_no int, doc_id long, start_token int, doc_start long, n_tokens int"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(container, start within it) of each size in order, none above the capacity, and the number of containers.

    ``open_at[g]`` holds the containers with gap g. Moving one of n[g] containers to gap g - s changes the sum of
    squares by 2 (n[g-s] - n[g] + 1); a container that becomes full leaves the sum, a new one joins it.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    start = np.empty(len(sizes), np.int64)
    count = 0
    far = 1 << 60
    for k, s in enumerate(sizes.tolist()):
        held = n[s:]
        change = np.where(held > 0, 2 * (n[: capacity - s + 1] - held) + 2, far)
        if held[0] > 0:
            change[0] = 1 - 2 * held[0]
        g = int(change.argmin())
        fresh = 2 * int(n[capacity - s]) + 1 if s < capacity else 0
        if change[g] >= far or fresh < change[g]:
            box, gap = count, capacity
            count += 1
        else:
            gap = g + s
            box = open_at[gap].pop()
            n[gap] -= 1
        where[k], start[k] = box, capacity - gap
        if gap > s:
            n[gap - s] += 1
            open_at[gap - s].append(box)
    return where, start, count


def pack(docs: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """Places of all documents of a shard: container from 0, part, document, start in container and document, tokens."""
    whole, rest = sizes // capacity, sizes % capacity
    full = np.repeat(np.arange(len(docs)), whole)
    part = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    small = np.flatnonzero(rest)
    small = small[np.lexsort((docs[small], -rest[small]))]
    box, start, count = sum_of_squares(rest[small], capacity)
    none = np.flatnonzero(sizes == 0)
    frame = pd.DataFrame(
        {
            "container_id": np.concatenate((box, count + np.arange(len(full)), np.zeros(len(none), np.int64))),
            "part_no": np.concatenate((whole[small], part, np.zeros(len(none), np.int64))),
            "doc_id": np.concatenate((docs[small], docs[full], docs[none])),
            "start_token": np.concatenate((start, np.zeros(len(full) + len(none), np.int64))),
            "doc_start": np.concatenate((whole[small] * capacity, part * capacity, np.zeros(len(none), np.int64))),
            "n_tokens": np.concatenate((rest[small], np.full(len(full), capacity), np.zeros(len(none), np.int64))),
        }
    )
    return frame


def placements(documents: DataFrame, container_spec: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per part of a document and capacity: its container, and where it begins there and in the document.

    The groups get partitions of their own (a set number, which adaptive execution does not merge into few tasks).
    """
    size = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long")
    docs = documents.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(size).alias("size"))
    total = documents.agg(F.coalesce(F.sum(size), F.lit(0)).alias("t")).first()["t"]
    shards = max(1, round(total / shard_tokens))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    specs = sorted(map(tuple, container_spec.filter("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().limit(MOST_SPECS + 1).collect()))
    if len(specs) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    # every document is placed once per capacity
    wanted = F.array(*(F.struct(F.lit(i).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity_tokens")) for i, c in specs)).cast("array<struct<spec_id:int,capacity_tokens:int>>")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        spec, capacity, shard = int(frame["spec_id"].iloc[0]), int(frame["capacity_tokens"].iloc[0]), int(frame["shard"].iloc[0])
        out = pack(frame["doc_id"].to_numpy(np.int64), frame["size"].to_numpy(np.int64), capacity)
        out["container_id"] += shard << 40
        out.insert(0, "capacity_tokens", capacity)
        out.insert(0, "spec_id", spec)
        return out

    each = docs.select("doc_id", "size", "shard", F.explode(wanted).alias("c")).select("doc_id", "size", "shard", "c.spec_id", "c.capacity_tokens")
    keys = ("spec_id", "capacity_tokens", "shard")
    return each.repartition(min(MOST_PARTITIONS, 4 * max(1, len(specs)) * shards), *keys).groupBy(*keys).applyInPandas(one, PLACED)


def fill(documents: DataFrame, container_spec: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Containers, tokens and share of room used per capacity, with the least possible number of containers."""
    p = placements(documents, container_spec, shard_tokens).groupBy("spec_id", "capacity_tokens").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return p.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
