"""Problem 8: filling fixed-capacity containers with items.

Texts longer than a container are split into full containers and a rest. The pieces are spread over groups of about
``GROUP`` containers by the hash of their id; each group is partitioned by Karmarkar-Karp multiway differencing: every piece
starts as a partial partition of its own, the two partial partitions of largest imbalance are merged with the largest sums of one
laid on the smallest of the other, until one is left. If its largest window exceeds the capacity, the number of windows rises. A
group has a bounded expected size at any scale, so no task grows with the data; the price is a fraction of a container a group.

Defined cases: null and empty texts (0 tokens) take no room and get no container; a text of exactly the capacity fills one;
equal sizes are laid in order of id; an empty table gives no containers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from .tokens import token_counts

CAPACITY = 2048
GROUP = 256  # containers of a group
TASKS = 10_000  # tasks the groups are spread over at most


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of near-equal sums (largest differencing method)."""
    # a partial partition: its non-empty windows by falling sum; the other k - len are empty
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for n, i in enumerate(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))):
        heap.append((-sizes[i], n, [(sizes[i], [i])]))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:
            merged = a + b  # the empty windows of one take those of the other
        else:
            # b's largest go to a's empty windows, the rest onto a's smallest: largest with smallest
            merged = a[: len(a) - (len(b) - free)] + b[:free]
            low = a[len(a) - (len(b) - free) :]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(low), b[free:])]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, n, merged))
        n += 1
    return [w for _, w in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; every size is at most ``capacity``. Full pieces keep a window to themselves."""
    full = [[i] for i, s in enumerate(sizes) if s == capacity]
    rest = [i for i, s in enumerate(sizes) if 0 < s < capacity]
    if not rest:
        return full
    part = [sizes[i] for i in rest]
    k = max(1, -(-sum(part) // capacity))
    while True:
        windows = differencing(part, k)
        worst = max(sum(part[i] for i in w) for w in windows)
        if worst <= capacity:
            return full + [[rest[i] for i in w] for w in windows]
        k += 1


def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens): one row a document, or one for each container's worth of it."""
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity)))
    return sized.filter("tokens > 0").select("doc_id", "tokens", parts.alias("piece")).select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("tokens"))


def lay_out(sized: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, tokens, container) of ``sized`` (doc_id, tokens); container is unique over all groups."""
    p = pieces(sized, capacity)
    total = p.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, round(total / (capacity * group)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        g = t.column("g")[0].as_py()
        where = [0] * t.num_rows
        for c, w in enumerate(pack(t.column("tokens").to_pylist(), capacity)):
            for i in w:
                where[i] = (g << 32) + c
        return t.select(["doc_id", "piece", "tokens"]).append_column("container", pa.array(where, pa.int64()))

    spread = p.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    # a task for every four groups: small as the rows are, packing them is not
    return spread.repartition(min(max(1, groups // 4), TASKS), "g").groupBy("g").applyInArrow(run, "doc_id long, piece long, tokens long, container long")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece."""
    return lay_out(_sized(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, tokens and fill of each container."""
    laid = p8_containers(spark, sf_dir).groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return laid.withColumn("fill", F.round(F.col("tokens") / CAPACITY, 6))
