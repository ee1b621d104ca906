"""Problem 9: mixing sources to target weights by weighted fair queueing.

Distinct texts of the listed sources are shuffled by hash, pass after pass up to the source's cap. Each use gets a virtual finish
time, the tokens its source has sent so far divided by the source's weight. All uses are ranged by that time, added up in its
order and cut off at the budget. Sums are built in two steps, those of bounded runs and then those within a run, so neither a source
that holds most rows nor the whole order is ever gathered in one task; time is cut into slots that hold a bounded number of tokens,
as all sources together send at most the sum of their weights in a unit of time.

Defined cases: null and blank texts and sources that are not listed take no part; source names are compared in lower case,
trimmed, with ``_`` for any separator; of equal texts the document of smallest id stands for all, so no text is used more often
than its source's cap; a source that runs out is reported with the share it reached, the others fill the budget; ties in time go to
the source name and id; an empty table or list gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, table
from .p1_entities import small_list
from .tokens import token_counts

RUN = 20_000  # rows of a run of a source's queue


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))), r"[\s\-.]+", "_")


def mix(sized: DataFrame, targets: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Uses per document (doc_id, source, tokens, uses) and reached shares, of ``sized`` (doc_id, source, h, tokens).

    ``h`` identifies the text; ``targets`` has source, target_share and max_repeats.
    """
    listed = {r.source: (float(r.target_share), int(r.max_repeats)) for r in small_list(targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))}
    docs = sized.withColumn("source", source_name(F.col("source"))).filter(F.col("source").isin(list(listed)) & (F.col("tokens") > 0))
    budget = docs.agg(F.sum("tokens")).first()[0] or 0
    # of equal texts the smallest id stands for all
    keep = docs.groupBy("h").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d")).select("d.*")
    keep = materialize(keep)
    totals = {r.source: (r.t, r.n) for r in keep.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    queues = {s: (w, totals[s][0], p) for s, (w, p) in listed.items() if s in totals and w > 0}
    spark = sized.sparkSession
    if not queues:
        empty = spark.createDataFrame([], "doc_id long, source string, tokens long, uses long")
        return empty, spark.createDataFrame([], "source string, target_share double, max_repeats long, documents long, uses long, tokens long, reached_share double")
    keep = keep.filter(F.col("source").isin(list(queues)))
    runs = {s: max(1, -(-totals[s][1] // run)) for s in queues}
    pick = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("source")]
    shuffle = F.xxhash64("doc_id", F.lit(9))
    at = keep.withColumn("o", shuffle).withColumn("b", F.floor((F.shiftrightunsigned("o", 11).cast("double") / float(1 << 53)) * pick(runs)))
    sums = at.groupBy("source", "b").agg(F.sum("tokens").alias("t"))
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "b").orderBy(F.shiftrightunsigned("o", 11), "o", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = at.join(before, ["source", "b"]).withColumn("sent", F.col("before") + F.sum("tokens").over(inside))
    # the p-th use of a text finishes at (sent + (p - 1) * tokens of the source) / weight
    weight, full = pick({s: q[0] for s, q in queues.items()}), pick({s: float(q[1]) for s, q in queues.items()})
    passes = F.explode(F.sequence(F.lit(1), pick({s: q[2] for s, q in queues.items()})))
    ends = cum.select("doc_id", "source", "tokens", "sent", passes.alias("pass")).withColumn("finish", (F.col("sent") + (F.col("pass") - 1) * full) / weight)
    slot = max(1.0, budget / sum(w for w, _, _ in queues.values())) / max(1, -(-sum(n for _, n in totals.values()) // run))
    ends = ends.withColumn("slot", F.floor(F.col("finish") / slot))
    # slots are few: the time of the slowest source over that of a slot
    of_slot = ends.groupBy("slot").agg(F.sum("tokens").alias("t"))
    ahead = of_slot.withColumn("ahead", F.coalesce(F.sum("t").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("ahead") < budget).drop("t")
    order = Window.partitionBy("slot").orderBy("finish", "source", "doc_id", "pass").rowsBetween(Window.unboundedPreceding, 0)
    sent = ends.join(ahead, "slot").withColumn("all", F.col("ahead") + F.sum("tokens").over(order)).filter(F.col("all") <= budget)
    taken = sent.groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("uses"))
    got = taken.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    wanted = spark.createDataFrame([(s, w, p) for s, (w, p) in listed.items()], "source string, target_share double, max_repeats long")
    report = wanted.join(got, "source", "left").na.fill(0, ["documents", "uses", "tokens"])
    whole = Window.partitionBy()  # a row a source
    return taken, report.withColumn("reached_share", F.round(F.col("tokens") / F.sum("tokens").over(whole), 6))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id", "source", F.sha2("text", 256).alias("h"), "text")
    return materialize(token_counts(docs))


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each listed source."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]
