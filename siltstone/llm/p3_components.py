"""Problem 3: consolidating pairwise matches into groups by low-diameter decomposition.

Clusters grow from exponentially shifted start times: vertex ``v`` draws a shift ``d(v) ~ Exp(beta)`` and a vertex joins the
centre ``u`` that minimises ``dist(u, v) - d(u)``. A fixed number of growth rounds (each one join and one partial
aggregation) gives every vertex a centre in its own component; clusters are contracted to super-vertices, the edges between
clusters are the next, smaller level, and the assignments of all levels are composed. Every level is written to the shared
folder, so lineage stays short and nothing is collected. What is left of the edges after a level, once it is ``LAST`` and fewer,
is joined by one task instead of by more levels: a level of few edges takes the driver as many jobs and plans as one of many.

Defined cases: null keys link nothing; a vertex without edges is in no group of two and gets no row; repeated edges and
self-loops are ignored; an empty edge table gives an empty result; shifts come from a hash, so a recomputed task draws the
same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, table
from .keys import id_key, phone_key

#: Edges between clusters that one task joins: some ten MB there.
LAST = 200_000


def _shift(v: Column, level: int, beta: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(v, F.lit(level)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / beta


def _grow(edges: DataFrame, level: int, beta: float, rounds: int) -> DataFrame:
    """(v, c): the centre of each vertex after ``rounds`` rounds of shifted growth over symmetric ``edges`` (src, dst, len).

    Each vertex has an edge of length 0 to itself, so a round reads the labels once: the plan grows with the rounds, it isn't
    doubled by them.
    """
    v = F.col("v")
    label = edges.filter("len = 0").select(F.col("src").alias("v"), F.struct((-_shift(F.col("src"), level, beta)).alias("d"), F.col("src").alias("c")).alias("l"))
    for _ in range(rounds):
        reached = edges.join(label.hint("merge"), F.col("src") == v)
        label = reached.groupBy(F.col("dst").alias("v")).agg(F.min(F.struct((F.col("l.d") + F.col("len")).alias("d"), F.col("l.c").alias("c"))).alias("l"))
    return label.select("v", F.col("l.c").alias("c"))


def _join_last(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex of the component of each vertex of ``edges`` (a, b), by union and find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while (u := up.setdefault(v, v)) != v:
                up[v] = up[u]
                v = up[u]
            return v

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(v) for v in list(up)], pa.int64())], names=["v", "c"])

    return edges.coalesce(1).mapInArrow(run, "v long, c long")


def connected_groups(edges: DataFrame, beta: float = 0.2, rounds: int = 4) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: bigint); all vertices of one component have one root.

    ``beta`` and ``rounds`` change only how many levels are needed (the edges left fall by a constant factor a level). Joins are
    merges, which spill: what a compressed table takes in memory isn't known from its size.
    """
    canonical = lambda e: e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, centres = materialize(canonical(edges)), []
    while True:
        both = left.selectExpr("inline(array(struct(a as src, b as dst), struct(b as src, a as dst)))")
        loops = both.select("src").distinct().select("src", F.col("src").alias("dst"))
        sym = materialize(both.withColumn("len", F.lit(1.0)).unionByName(loops.withColumn("len", F.lit(0.0))))
        centre = materialize(_grow(sym, len(centres), beta, rounds))
        centres.append(centre)
        ca, cb = centre.toDF("a", "ca").hint("merge"), centre.toDF("b", "cb").hint("merge")
        rest = materialize(canonical(left.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        release(left, sym)
        left = rest
        n = rest.count()
        if 0 < n <= LAST:
            centres.append(_join_last(rest))
        if n <= LAST:
            break
    whole = centres[0].toDF("v", "root")
    for centre in centres[1:]:  # each level is smaller by a constant factor, the last has up to LAST edges
        whole = whole.join(centre.toDF("root", "next"), "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    if len(centres) > 1:
        whole = materialize(whole)
        release(*centres)
    release(left)
    return whole


def key_edges(records: DataFrame, rid: str, keys: list[Column]) -> DataFrame:
    """(a, b): each record tied to the smallest record of every key it has: as many edges as keys, however hot a key is."""
    tagged = F.array(*[F.concat(F.lit(f"{k}:"), c) for k, c in enumerate(keys)])
    long = records.select(F.col(rid).alias("r"), F.explode(F.array_compact(tagged)).alias("k"))
    hub = long.groupBy("k").agg(F.min("r").alias("h"), F.max("r").alias("m")).filter("h < m").select("k", "h")
    return long.join(hub, "k").filter("r <> h").select(F.col("h").alias("a"), F.col("r").alias("b"))


def linked_groups(customers: DataFrame) -> DataFrame:
    """(rec_id, group_id) of each record in a group of two or more; group_id is the smallest rec_id of the group."""
    rec = customers.select("rec_id", id_key(F.col("cleaned_record.customer_id")).alias("i"), phone_key(F.col("cleaned_record.phone")).alias("p"))
    roots = connected_groups(key_edges(rec, "rec_id", [F.col("i"), F.col("p")]))
    least = roots.groupBy("root").agg(F.min("v").alias("group_id"))
    return roots.join(least, "root").select(F.col("v").alias("rec_id"), "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "customer_knowledge"))


_KEYS = r"""
with w as (
  select rec_id, cleaned_record.customer_id i, cleaned_record.phone p from customer_knowledge),
k as (
  select rec_id, 'c' || lower(regexp_replace(i, '[^\p{L}\p{Nd}]', '', 'g')) k from w
  where lower(trim(i, E' \t\n\r')) not in (NULLS) and regexp_replace(i, '[^\p{L}\p{Nd}]', '', 'g') <> ''
  union all
  select rec_id, 'p' || right(d, 10) from (select rec_id, p, regexp_replace(p, '[^0-9]', '', 'g') d from w)
  where lower(trim(p, E' \t\n\r')) not in (NULLS) and length(d) >= 10
    and right(d, 10) <> repeat(right(d, 1), 10) and right(d, 10) <> '1234567890'),
"""


def oracle() -> dict[str, str]:
    from ..config import CLEAN_NULLS

    nulls = ", ".join(f"'{x}'" for x in ("", *CLEAN_NULLS))
    recursive = _KEYS.replace("NULLS", nulls).replace("with w as", "with recursive w as") + """
h as (select k, min(rec_id) h from k group by k having count(*) > 1),
e as (select distinct h a, rec_id b from k join h using (k) where rec_id <> h),
s as (select a, b from e union select b, a from e),
r as (select a v, a g from s union select s.b, r.g from r join s on s.a = r.v)
select v rec_id, min(g) group_id from r group by v
"""
    return {"p3_found": recursive}
