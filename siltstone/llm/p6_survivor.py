"""Problem 6: best representative of each duplicate group.

``survivors`` picks, field by field, the record with a usable value whose channel is trusted most, then the latest, then the
smallest ``rec_id``: one partial aggregation, no group is ever gathered. This is the rule TESTDATA.md fixes for p6_found.
``fuse`` is the Bayesian fusion with copy detection: it estimates the accuracy of each source and which sources copy
(from shared false values), discounts copied votes and takes the value of maximum posterior.

Defined cases: a null token is no value; a field without a usable value gives no row; a missing channel or trust ranks last,
a missing timestamp before the earliest; ties go to the smaller ``rec_id``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLEAN_NULLS
from ..session import blank_or_null, materialize, release, table
from .keys import id_key
from .p1_entities import small_list

FIELDS = ("name", "email", "address")


def usable_email(c: Column) -> Column:
    """Trimmed: no blank inside, one @ with text before it, and after it a dot with text on both sides, none at the end."""
    t = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return t.rlike(r"^[^@\s\p{Z}]+@[^@\s\p{Z}]+$") & t.rlike(r"@[^@]*[^@]\.[^@]") & ~t.endswith(".")


def usable(field: str, c: Column) -> Column:
    ok = ~blank_or_null(c)
    return ok & usable_email(c) if field == "email" else ok


def survivors(customers: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_id, field, rec_id, value): the record that supplies each field of each group of two or more records."""
    c = F.col("cleaned_record")
    rec = customers.select(id_key(c["customer_id"]).alias("k"), "rec_id", "timestamp", F.col("metadata.channel").alias("channel"), *[c[f].alias(f) for f in FIELDS]).filter("k is not null")
    listed = small_list(trust.groupBy("channel").agg(F.max("trust").alias("trust")))
    known = customers.sparkSession.createDataFrame([tuple(r) for r in listed], "channel string, trust long")
    rec = rec.join(F.broadcast(known), "channel", "left")
    rank = [(-F.coalesce("trust", F.lit(-(1 << 31)))).alias("t"), (-F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(-(1 << 62)))).alias("s"), F.col("rec_id").alias("r")]
    best = [F.min(F.when(usable(f, F.col(f)), F.struct(*rank, F.col(f).alias("value")))).alias(f) for f in FIELDS]
    groups = rec.groupBy("k").agg(F.min("rec_id").alias("group_id"), F.count("*").alias("n"), *best).filter("n > 1")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.r").alias("rec_id"), F.col(f"{f}.value").alias("value")) for f in FIELDS]))
    return groups.select("group_id", rows.alias("x")).select("group_id", "x.*").filter("rec_id is not null")


def _plain(field: str, c: Column) -> Column:
    """Form in which two values count as the same claim."""
    return F.when(usable(field, c), F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}@]+", " ")))


def fuse(customers: DataFrame, rounds: int = 10, settled: float = 0.002, n_false: float = 20.0, copy_prior: float = 0.1, copy_rate: float = 0.8, start: float = 0.8, max_sources: int = 64) -> DataFrame:
    """(group_id, field, rec_id, value, posterior, votes): the surviving value by Bayesian fusion with copy detection.

    Sources are the systems of ``metadata.source`` and ``metadata.channel``; there may be ``max_sources`` of them, so what the driver holds (an accuracy a source, a
    dependence a pair of sources) is of bounded size.
    Each round: values get the log-odds ``sum ln(n_false * A / (1 - A))`` over their sources, a vote discounted by the chance
    that it was copied from a more accurate source for the same value; accuracies are the mean posterior of what a source
    claims; two sources depend on each other by Bayes' rule over how often they share false values, share true ones or differ,
    given those accuracies. Rounds end when no accuracy moves by more than ``settled``, or after ``rounds``.
    """
    c = F.col("cleaned_record")
    rec = customers.select(id_key(c["customer_id"]).alias("k"), "rec_id", F.coalesce("metadata.source", F.lit("?")).alias("source"), *[c[f].alias(f) for f in FIELDS], F.coalesce("metadata.channel", F.lit("?")).alias("channel")).filter("k is not null")
    rec = rec.withColumn("source", F.concat_ws("/", "source", "channel"))
    groups = rec.groupBy("k").agg(F.min("rec_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    long = rec.join(groups, "k").select("group_id", "rec_id", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _plain(f, F.col(f)).alias("v"), F.col(f).alias("value")) for f in FIELDS])).alias("x"))
    long = long.select("group_id", "rec_id", "source", "x.*").filter("v is not null")
    claims = materialize(
        long.groupBy("group_id", "field", "v", "source").agg(F.min(F.struct("rec_id", "value")).alias("first"))
        .groupBy("group_id", "field", "v").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.min("first").alias("first"))
    )  # at most one entry a source in an array
    names = [r.s for r in claims.select(F.explode("sources").alias("s")).distinct().limit(max_sources + 1).collect()]
    if len(names) > max_sources:
        raise ValueError(f"more than {max_sources} sources: they are to be merged first, or max_sources raised")
    accuracy, copies, done = dict.fromkeys(names, start), {}, False
    for step in range(rounds + 1):
        if not names:
            return claims.select("group_id", "field", "first.*", F.lit(0.0).alias("posterior"), F.size("sources").alias("votes"))
        acc = F.create_map(*[F.lit(x) for kv in accuracy.items() for x in kv])
        weight = lambda s: F.log(F.lit(n_false) * acc[s] / (1 - acc[s]))
        if not copies:
            votes = F.transform("sources", weight)
        else:
            dep = F.create_map(*[F.lit(x) for kv in copies.items() for x in kv])
            earlier = lambda s: F.filter("sources", lambda o: (acc[o] > acc[s]) | ((acc[o] == acc[s]) & (o < s)))
            own = lambda s: F.aggregate(earlier(s), F.lit(1.0), lambda p, o: p * (1 - copy_rate * F.coalesce(dep[F.concat(F.least(o, s), F.lit("|"), F.greatest(o, s))], F.lit(0.0))))
            votes = F.transform("sources", lambda s: weight(s) * own(s))
        scored = claims.withColumn("score", F.aggregate(votes, F.lit(0.0), lambda x, y: x + y))
        top = scored.groupBy("group_id", "field").agg(F.max("score").alias("top"), F.sum(F.exp(F.least("score", F.lit(500.0)))).alias("mass"), F.count("*").alias("values"))
        unseen = F.greatest(F.lit(n_false) + 1 - F.col("values"), F.lit(0.0))
        posterior = scored.join(top, ["group_id", "field"]).withColumn("posterior", F.exp(F.least("score", F.lit(500.0))) / (F.col("mass") + unseen))
        if step == rounds or done:
            best = posterior.groupBy("group_id", "field").agg(F.max_by(F.struct("first", "posterior", "sources"), F.struct("posterior", -F.col("first.rec_id"))).alias("b"))
            return best.select("group_id", "field", F.col("b.first.rec_id").alias("rec_id"), F.col("b.first.value").alias("value"), F.round("b.posterior", 6).alias("posterior"), F.size("b.sources").alias("votes"))
        known = materialize(posterior.select("group_id", "field", "sources", "posterior"))
        before, estimated = accuracy, {r.s: min(0.99, max(0.05, r.a)) for r in known.select(F.explode("sources").alias("s"), "posterior").groupBy("s").agg(F.avg("posterior").alias("a")).collect()}
        # votes that are copies count in full at first: accuracies are taken from them only once copies are known
        accuracy = estimated if step else accuracy
        done = step > 0 and max(abs(accuracy[n] - before[n]) for n in accuracy) <= settled
        each = known.select("group_id", "field", F.explode("sources").alias("s"), "posterior", F.col("sources").alias("same"))
        both = each.groupBy("group_id", "field").agg(F.collect_set("s").alias("all"))
        shared = known.select(F.explode(F.expr("filter(flatten(transform(sources, (x, i) -> transform(sources, (y, j) -> if(i < j, concat(x, '|', y), null)))), z -> z is not null)")).alias("pair"), "posterior").groupBy("pair").agg(F.sum("posterior").alias("true_same"), F.sum(1 - F.col("posterior")).alias("false_same"))
        met = both.select(F.explode(F.expr("filter(flatten(transform(sort_array(`all`), x -> transform(sort_array(`all`), y -> if(x < y, concat(x, '|', y), null)))), z -> z is not null)")).alias("pair")).groupBy("pair").agg(F.count("*").alias("met"))
        pairs = met.join(shared, "pair", "left").na.fill(0.0)
        # at most one row a pair of sources
        copies = {r.pair: dependence(*[accuracy[n] for n in r.pair.split("|")], r.true_same, r.false_same, max(0.0, r.met - r.true_same - r.false_same), n_false, copy_prior, copy_rate) for r in pairs.collect()}
        release(known)


def dependence(a: float, b: float, true_same: float, false_same: float, differ: float, n_false: float, prior: float, rate: float) -> float:
    """Probability that one of two sources of accuracies ``a`` and ``b`` copies the other, who share and differ as often as given."""
    chance = (a * b, (1 - a) * (1 - b) / n_false)
    alone = (*chance, 1 - sum(chance))
    better = max(a, b)
    copied = (better * rate + chance[0] * (1 - rate), (1 - better) * rate + chance[1] * (1 - rate), alone[2] * (1 - rate))
    odds = sum(n * (math.log(x) - math.log(y)) for n, x, y in zip((true_same, false_same, differ), alone, copied))
    return 1 / (1 + math.exp(min(50.0, max(-50.0, odds))) * (1 - prior) / prior)


def plain_vote(customers: DataFrame) -> DataFrame:
    """(group_id, field, value): the form most records of a group claim, the smaller one of two; what :func:`fuse` is measured against."""
    rec = customers.select(id_key(F.col("cleaned_record.customer_id")).alias("k"), "rec_id", *[_plain(f, F.col(f"cleaned_record.{f}")).alias(f) for f in FIELDS]).filter("k is not null")
    groups = rec.groupBy("k").agg(F.min("rec_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1").select("k", "group_id")
    long = rec.join(groups, "k").select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select("group_id", "x.*").filter("value is not null")
    votes = long.groupBy("group_id", "field", "value").agg(F.count("*").alias("n"))
    return votes.groupBy("group_id", "field").agg(F.min(F.struct(-F.col("n"), "value")).alias("b")).select("group_id", "field", "b.value")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "customer_knowledge"), table(spark, sf_dir, "channel_trust")).select("group_id", "field", "rec_id")


def p6_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group: the surviving customer."""
    found = survivors(table(spark, sf_dir, "customer_knowledge"), table(spark, sf_dir, "channel_trust"))
    pick = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    return found.groupBy("group_id").agg(*pick)


def p6_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(table(spark, sf_dir, "customer_knowledge"))


def oracle() -> dict[str, str]:
    nulls = ", ".join(f"'{x}'" for x in ("", *CLEAN_NULLS))
    base = rf"""
with c as (
  select rec_id, timestamp ts, lower(regexp_replace(cleaned_record.customer_id, '[^\p{{L}}\p{{Nd}}]', '', 'g')) k, t.trust,
         cleaned_record.name "name", cleaned_record.email email, cleaned_record.address address
  from customer_knowledge left join channel_trust t on t.channel = metadata.channel
  where lower(trim(cleaned_record.customer_id, E' \t\n\r')) not in ({nulls})),
g as (select k, min(rec_id) group_id from c where k <> '' group by k having count(*) > 1),
f as (
  select group_id, field, rec_id, trust, ts, val from c join g using (k) cross join lateral (values ('name', "name"), ('email', email), ('address', address)) v(field, val)
  where lower(trim(val, E' \t\n\r')) not in ({nulls})
    and (field <> 'email' or (regexp_matches(trim(val, E' \t\n\r'), '^[^@\s]+@[^@\s]+$') and regexp_matches(val, '@[^@]*[^@]\.[^@]') and trim(val, E' \t\n\r') not like '%.'))),
r as (select *, row_number() over (partition by group_id, field order by trust desc nulls last, ts desc nulls last, rec_id) n from f)
"""
    return {
        "p6_found": base + "select group_id, field, rec_id from r where n = 1",
        "p6_survivor": base + "select group_id, max(val) filter (field = 'name') \"name\", max(val) filter (field = 'email') email, max(val) filter (field = 'address') address from r where n = 1 group by group_id",
    }
