"""Problem 1: matching entities across sources without keys.

Each record is parsed once; the q-grams of name, mailbox, phone and address become fixed vectors of ``BITS`` bits (one bit a gram),
kept as the places of their set bits. Multi-index Hamming hashing finds every pair of mailboxes and of phones within the radius
exactly: two vectors that lack at most ``RADIUS`` bits of each other agree in ``SAME`` of the ``RADIUS + SAME`` rarest bits each
has, so each vector is indexed under all choices of ``SAME`` of these. One typing error, a swap of two letters or digits too, is within
the radius. Different values are searched, not records, and no name is asked for. Addresses are compared where house, unit and
town agree, as the check demands.

Candidates are scored by the Dice coefficients of their fields. How much a coefficient of a field speaks for a match is fitted on
all candidates by expectation maximisation (two classes, fields independent within each, the check on the texts as one more
field), which needs the numbers of candidates by pattern of coefficients only; the posterior is the confidence. Pairs are decided by
the check. Links are consolidated (problem 3) and the pairs of a group that agree by name are added.

Defined cases: null tokens are missing fields and speak neither for nor against; a record without name is matched by mailbox,
or phone and address together; exact copies match each other; an empty table gives no pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import names
from .addresses import Address, Gazetteer, parse, same_place
from .contacts import filled, mailbox, subscriber
from .p3_components import connected_groups
from .strings import edits

#: Width of a vector; a mailbox or phone sets about ten bits.
BITS = 1024
#: Bits either of two vectors may lack of the other (a swap changes three grams), and bits of an index entry.
RADIUS, SAME = 3, 3
#: Edits without swaps between two streets that ``same_street`` accepts: two swaps make four.
STREET_EDITS = 4
FIELDS = ("n", "e", "p", "a")
#: Lower bounds of the levels of a Dice coefficient; level 0 is a missing field.
LEVELS = (0.0, 0.35, 0.65, 0.8, 0.95)
#: Rows a list of the domain may have to be sent to every task.
LIST_ROWS = 100_000


def small_list(df: DataFrame, most: int = LIST_ROWS) -> list:
    """A reference list on the driver; refused beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a reference list has more than {most} rows")
    return rows


def gazetteer(cities: DataFrame) -> Gazetteer:
    rows = small_list(cities.select("city_id", "city", "postal_prefix", "also_known_as", "state", "state_code", "country"))
    return Gazetteer([tuple(r[:4]) for r in rows], {x for r in rows for x in r[4:] if x})


def nicknames(listed: DataFrame) -> names.Nicknames:
    return names.Nicknames([*names.COMMON, *[tuple(r) for r in small_list(listed.select("given_name", "nickname"))]])


@lru_cache(maxsize=500_000)
def _bit(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BITS


def vector(field: str, words: list[str], q: int = 2) -> list[int]:
    """Set bits of the padded q-grams of ``words``."""
    return sorted({_bit(field + w[i : i + q]) for w in (f"_{x}_" for x in words) for i in range(len(w) - q + 1)})


def digits(phone: str) -> list[int]:
    """Set bits of a phone: pairs of digits with their place, as all have ten."""
    return sorted({_bit(f"p{i}{phone[i : i + 2]}") for i in range(len(phone) - 1)})


def _flat(a: Address) -> str:
    return "|".join(map(str, a))


def _address(s: str) -> Address:
    h = s.split("|")
    return Address(h[0], h[1], h[2], int(h[3]), *h[4:])


_NAMES = ["rec_id", "src", "name", "e", "p", "a", *[f"v{f}" for f in FIELDS]]
_TYPES = [pa.int64(), *[pa.string()] * 5, *[pa.list_(pa.int16())] * 4]


def parse_records(customers: DataFrame, towns: Gazetteer) -> DataFrame:
    """(rec_id, src, name, mailbox, phone, address, vn, ve, vp, va) of every record; "" where a field is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, src, n, p, e, a in zip(*[c.to_pylist() for c in b.columns]):
                n, a = filled(n), filled(a)
                name = names.parse(n)
                e, p = mailbox(e), subscriber(p)
                place = parse(a, towns) if a else None
                where = [place.house, place.unit, place.core, place.town] if place else []
                out.append((rid, src or "", n if name.tokens else "", e, p, _flat(place) if place else "", vector("n", list(name.tokens)), vector("e", [e]) if e else [], digits(p), vector("a", where)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_NAMES), _TYPES)], names=_NAMES)

    c = F.col("cleaned_record")
    rec = customers.select("rec_id", F.col("metadata.source").alias("src"), *[c[f].alias(f) for f in ("name", "phone", "email", "address")])
    return rec.mapInArrow(run, "rec_id long, src string, name string, e string, p string, a string, " + ", ".join(f"v{f} array<short>" for f in FIELDS))


def near_values(values: DataFrame, bits: int = BITS) -> DataFrame:
    """(wx, wy), wx < wy: distinct pairs of ``values`` (w, v) whose vectors of ``bits`` bits lack at most ``RADIUS`` bits of each other.

    Vectors of fewer than ``2 * RADIUS + SAME`` bits, which may meet one with too few bits for ``SAME`` of them, are also indexed
    under each of their ``RADIUS + 1`` rarest; those of ``RADIUS`` bits and less only match themselves.
    """
    counts = values.select(F.explode("v").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()  # at most ``bits`` rows
    rank = [bits] * bits
    for k, r in enumerate(sorted(counts, key=lambda r: (r.n, r.b))):
        rank[r.b] = k
    ranks = F.lit(rank) if counts else F.array(F.lit(0))
    rare = values.filter(F.size("v") > RADIUS).select("w", "v", F.array_sort(F.transform("v", lambda b: F.get(ranks, b.cast("int")))).alias("r"))
    r = lambda *at: F.xxhash64(F.lit(len(at)), *[F.get("r", F.lit(i)) for i in at])
    wide = [F.when(F.size("r") > at[-1], r(*at)) for at in combinations(range(RADIUS + SAME), SAME)]
    short = [F.when(F.size("r") < 2 * RADIUS + SAME, r(i)) for i in range(RADIUS + 1)]
    index = rare.select("w", "v", F.explode(F.array_compact(F.array(*wide, *short))).alias("k"))
    x, y = index.toDF("wx", "vx", "k"), index.toDF("wy", "vy", "k")
    both = F.size(F.array_intersect("vx", "vy"))
    near = x.join(y, "k").filter((F.col("wx") < F.col("wy")) & (F.size("vx") - both <= RADIUS) & (F.size("vy") - both <= RADIUS))
    return near.select("wx", "wy").distinct()


def near_pairs(rec: DataFrame) -> DataFrame:
    """(x, y), x < y: pairs of records with equal or near mailboxes or phones, whatever their names.

    Both fields are searched by one plan, as what a plan takes is the driver's: values begin with their field, and phones have
    bits of their own, so none is near a mailbox.
    """
    value = lambda f, at: F.when(F.col(f) != "", F.struct(F.concat(F.lit(f"{f}:"), F.col(f)).alias("w"), F.transform(f"v{f}", lambda b: (b + at).cast("short")).alias("v")))
    held = rec.select("rec_id", F.explode(F.array_compact(F.array(value("e", 0), value("p", BITS)))).alias("h")).select("rec_id", "h.w", "h.v")
    values = near_values(held.groupBy("w").agg(F.first("v").alias("v")), 2 * BITS)
    close = values.filter((F.length("wx") > 6 + 2) & (F.levenshtein("wx", "wy", 2) >= 0))  # what the check accepts at all
    at = held.select("rec_id", "w")
    same = at.toDF("x", "w").join(at.toDF("y", "w"), "w").filter("x < y").select("x", "y")
    other = close.join(at.toDF("x", "wx"), "wx").join(at.toDF("y", "wy"), "wy").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return same.unionByName(other)


def place_pairs(rec: DataFrame) -> DataFrame:
    """(x, y), x < y: pairs of records at one house, unit and town in streets that are near."""
    part = F.split("a", r"\|")
    place = rec.select("rec_id", part[4].alias("w"), F.xxhash64(part[0], part[1], part[6]).alias("k"), part[0].alias("house")).filter("house <> '' and w <> ''").drop("house")
    x, y = place.toDF("x", "wx", "k"), place.toDF("y", "wy", "k")
    return x.join(y, "k").filter((F.col("x") < F.col("y")) & (F.levenshtein("wx", "wy", STREET_EDITS) >= 0)).select("x", "y")


def pattern() -> Column:
    """The levels of the Dice coefficients of a pair's fields, as one number."""
    out = F.lit(0)
    for f in FIELDS:
        a, b = F.col(f"x.v{f}"), F.col(f"y.v{f}")
        dice = 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
        level = F.lit(1)
        for k, least in enumerate(LEVELS[1:], 2):
            level = F.when(dice >= least, k).otherwise(level)
        out = out * (len(LEVELS) + 1) + F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(level)
    return out.cast("int")


def fit_confidence(counts: dict[tuple[int, bool], int], rounds: int = 50) -> dict[tuple[int, bool], float]:
    """Probability of a match for each (pattern, check) that ``counts`` has, by expectation maximisation from the check's verdict."""
    keys = sorted(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], float)
    level = np.array([[p // (len(LEVELS) + 1) ** (len(FIELDS) - 1 - i) % (len(LEVELS) + 1) for i in range(len(FIELDS))] + [1 + ok] for p, ok in keys])
    post = np.where(np.array([ok for _, ok in keys]), 0.95, 0.05)
    for _ in range(rounds):
        share = min(0.999, max(0.001, float((post * n).sum() / n.sum())))
        odds = np.full(len(keys), np.log(share / (1 - share)))
        for f in range(level.shape[1]):
            held = level[:, f] > 0  # a missing field says nothing
            sums = [np.bincount(level[held, f], w[held], len(LEVELS) + 1)[1:] + 0.5 for w in (post * n, (1 - post) * n)]
            ratio = np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())
            odds[held] += ratio[level[held, f] - 1]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return {k: round(float(min(0.9999, max(0.0001, p))), 4) for k, p in zip(keys, post)}


def agreement(level: int, ea: str, eb: str, pa_: str, pb: str, aa: str, ab: str) -> bool:
    """The check on the texts: does what both records have tie them to one person or firm?"""
    e = 0 if not ea or not eb else 2 if ea == eb else 1 if len(ea) > 6 and edits(ea, eb, 1) <= 1 else -1
    p = 0 if not pa_ or not pb else 2 if pa_ == pb else 1 if edits(pa_, pb, 1) <= 1 else -1
    a = 0 if not aa or not ab else 1 if aa == ab or same_place(_address(aa), _address(ab)) else -1
    if level < 0:  # a name is missing
        return e == 2 or (p == 2 and a > 0)
    if level == names.STRONG:
        return e > 0 or p > 1 or a > 0 or (p == 1 and e >= 0)
    if level == names.WEAK:
        return e == 2 or (e == 1 and (p > 0 or a > 0)) or (e >= 0 and (p > 1 or a > 0))
    return level == names.SHARED and e == 2


def _level(x: str, y: str, nick: names.Nicknames) -> int:
    return names.compatible(names.parse(x), names.parse(y), nick) if x and y else -1


def _checked(pairs: DataFrame, nick: names.Nicknames) -> DataFrame:
    cols = ["x", "y", "cross", "pattern"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nx, ny, *rest = [b.column(c).to_pylist() for c in ("nx", "ny", "ex", "ey", "px", "py", "ax", "ay")]
            ok = [agreement(_level(p, q, nick), *r) for p, q, *r in zip(nx, ny, *rest)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(ok, pa.bool_())], names=[*cols, "ok"])

    return pairs.mapInArrow(run, "x long, y long, cross boolean, pattern int, ok boolean")


def candidates(rec: DataFrame, nick: names.Nicknames) -> DataFrame:
    """(x, y, cross, pattern, ok) of all pairs found, of one source or two; ``ok`` is the verdict of the check on the texts."""
    cand = near_pairs(rec).unionByName(place_pairs(rec)).distinct()
    found = cand.join(rec.alias("x"), F.col("x") == F.col("x.rec_id")).join(rec.alias("y"), F.col("y") == F.col("y.rec_id"))
    flat = found.select(
        F.col("x"), F.col("y"), (F.col("x.src") != F.col("y.src")).alias("cross"), pattern().alias("pattern"), F.col("x.name").alias("nx"), F.col("y.name").alias("ny"),
        *[F.col(f"{s}.{f}").alias(f"{f}{s}") for f in "epa" for s in "xy"],
    )
    return _checked(flat, nick)


def _grouped(pairs: DataFrame, nick: names.Nicknames) -> DataFrame:
    """(x, y, conf): the pairs of a group whose names may be one."""
    cols = ["x", "y", "conf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(k := _level(p, q, nick)) >= names.WEAK or k < 0 for p, q in zip(b.column("nx").to_pylist(), b.column("ny").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols], names=cols).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "x long, y long, conf double")


def match_entities(customers: DataFrame, cities: DataFrame, nicks: DataFrame) -> DataFrame:
    """(rec_a, rec_b, confidence): pairs of records of two sources that mean one person or organisation.

    Pairs that are tied only through other records are as sure as the weakest link of their group, or as their own fields make
    them, whichever is more.
    """
    towns, nick = gazetteer(cities), nicknames(nicks)
    rec = materialize(parse_records(customers, towns))
    seen = materialize(candidates(rec, nick))
    # a row a pattern: at most 2 * 6 ** 4
    counts = {(r.pattern, r.ok): r.n for r in seen.groupBy("pattern", "ok").agg(F.count("*").alias("n")).collect()}
    fitted = fit_confidence(counts)
    sure = customers.sparkSession.createDataFrame([(p, ok, c) for (p, ok), c in fitted.items()], "pattern int, ok boolean, conf double")
    found = seen.filter("ok").join(F.broadcast(sure.filter("ok").drop("ok")), "pattern").select("x", "y", "cross", "conf")
    groups = connected_groups(seen.filter("ok").select(F.col("x").alias("a"), F.col("y").alias("b")))
    weakest = found.join(groups, F.col("x") == F.col("v")).groupBy("root").agg(F.min("conf").alias("least"))
    member = groups.join(rec.select(F.col("rec_id").alias("v"), "src", "name", *[f"v{f}" for f in FIELDS]), "v")
    of_group = member.alias("x").join(member.alias("y"), F.col("x.root") == F.col("y.root")).filter("x.v < y.v and x.src <> y.src").join(weakest.alias("g"), F.col("x.root") == F.col("g.root"))
    own = of_group.select(F.col("x.v").alias("x"), F.col("y.v").alias("y"), F.col("x.name").alias("nx"), F.col("y.name").alias("ny"), pattern().alias("pattern"), "least")
    alone = sure.filter("not ok").select("pattern", F.col("conf").alias("alone"))
    tied = _grouped(own.join(F.broadcast(alone), "pattern", "left").withColumn("conf", F.greatest("least", F.coalesce("alone", F.lit(0.0)))), nick)
    both = found.filter("cross").select("x", "y", "conf").unionByName(tied)
    return both.groupBy(F.col("x").alias("rec_a"), F.col("y").alias("rec_b")).agg(F.max("conf").alias("confidence"))


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_entities(table(spark, sf_dir, "customer_knowledge"), table(spark, sf_dir, "city_list"), table(spark, sf_dir, "nickname_list"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("rec_a", "rec_b")
