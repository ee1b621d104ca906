"""Linking of tables: match keys, clusters of one entity, directed relationships."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize
from .clean import RID, data_columns, q

# --- fixed values ---------------------------------------------------------
#: Columns by key; of several columns of one key the last filled one counts.
PRIMARY = {
    "vin": ("vin", "vehicle_identification_number", "chassis_no", "vehicle_id", "car_id"),
    "plate": ("license_plate", "plate_number", "plate_no", "reg_no", "registration_number"),
    "customer_id": ("customer_id", "cust_id", "user_id", "member_id", "client_id", "buyer_id"),
    "emp_id": ("emp_id", "employee_id", "staff_id", "worker_id"),
    "student_id": ("student_id", "roll_no", "roll_number", "admission_no"),
    "patient_id": ("patient_id", "mrn", "medical_record_number", "case_id"),
}
FOREIGN = {
    "store_id": ("store_id", "branch_id", "outlet_id", "warehouse_id", "store_code", "branch_code"),
    "product_id": ("product_id", "item_id", "sku", "sku_id", "barcode", "upc", "ean", "item_code", "product_code"),
    "transaction_id": ("transaction_id", "order_id", "invoice_no", "invoice_num", "invoice_number", "bill_no", "bill_number", "receipt_id", "sale_id"),
}
NAMES = ("name", "customer_name", "full_name", "store_name", "product_name", "item_name", "model", "car_model", "buyer_name")
CITY = ("city", "location", "town", "branch_city", "store_city")
CATEGORY = ("category", "product_category", "item_category")
EDGE_CONFIDENCE, FOREIGN_CONFIDENCE = 0.98, 0.96
#: Relationship, source, target, method, matched fields: edges that a transaction gives.
EDGES = (
    ("customer", "transaction", "customer", "Exact Key Linkage", ("transaction_id", "customer_id")),
    ("product", "transaction", "product", "Exact Product ID / SKU", ("transaction_id", "product_id")),
    ("store", "transaction", "store", "Exact Store ID", ("transaction_id", "store_id")),
    ("purchased", "customer", "product", "Transaction Cross-Link", ("customer_id", "product_id", "transaction_id")),
    ("purchased_at", "customer", "store", "Transaction Store Bridge", ("customer_id", "store_id", "transaction_id")),
    ("sold", "store", "product", "Sales Distribution Link", ("store_id", "product_id", "transaction_id")),
)
# --------------------------------------------------------------------------


def _base(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_").split(".")[-1]


def _id(c: Column) -> Column:
    s = F.upper(S.match_form(c))
    return F.when(F.length(s) >= 2, s)


def _last(columns: list[Column]) -> Column:
    return F.coalesce(*reversed(columns), F.lit(None).cast("string"))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns ``a_b``; arrays and maps stay."""
    from pyspark.sql import types as T

    def walk(t: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in t.fields:
            p = [*path, f.name]
            c = q(p[0])
            for k in p[1:]:
                c = c.getField(k)
            out += walk(f.dataType, p) if isinstance(f.dataType, T.StructType) else [c.alias("_".join(p))]
        return out

    return df.select(*walk(df.schema, []))


def typed_keys(columns: Sequence[str]) -> dict[str, dict[str, Column]]:
    """M7: key -> expression, for the primary, foreign and descriptive keys of a table with ``columns``.

    A column with "phone", "mobile" or "contact" in its name is a phone, before anything else is tried.
    """
    got: dict[str, dict[str, list[Column]]] = {"primary": {}, "foreign": {}, "descriptive": {}}

    def add(group: str, key: str, value: Column) -> None:
        got[group].setdefault(key, []).append(value)

    for c in columns:
        b, raw = _base(c), q(c).cast("string")
        v = F.when(~S.is_empty(raw), S.trimmed(raw))
        form = S.match_form(v)
        if any(w in b for w in ("phone", "mobile", "contact")):
            d = F.regexp_replace(F.coalesce(S.normalize_phone(v), v), r"\D", "")
            add("primary", "phone", F.when(F.length(d) >= 7, F.right(d, F.lit(10))))
        elif "email" in b:
            e = F.coalesce(S.normalize_email(v), F.lower(v))
            add("primary", "email", F.when(e.contains("@"), e))
        elif b in PRIMARY["vin"]:
            x = F.regexp_replace(F.upper(v), r"[^A-HJ-NPR-Z0-9]", "")
            add("primary", "vin", F.when(F.length(x) >= 6, x))
        elif b in PRIMARY["plate"]:
            x = F.regexp_replace(F.upper(v), r"[\s-]", "")
            add("primary", "plate", F.when(F.length(x) >= 4, x))
        elif key := next((k for k, names in PRIMARY.items() if b in names), None):
            add("primary", key, _id(v))
        elif key := next((k for k, names in FOREIGN.items() if b in names), None):
            add("foreign", key, _id(v))
        elif b in NAMES:
            n = F.when(F.length(form) >= 2, form)
            add("descriptive", "name", n)
            for word, key in (("store", "store_name"), ("product", "product_name"), ("item", "product_name"), ("customer", "customer_name"), ("buyer", "customer_name")):
                if word in b:
                    add("descriptive", key, n)
                    break
        elif "address" in b or "street" in b:
            a = S.normalize_address(v)
            add("descriptive", "address", F.when(F.length(a) >= 4, a))
        elif b in CITY:
            add("descriptive", "city", F.when(F.length(form) >= 2, form))
        elif b in CATEGORY:
            add("descriptive", "category", form)
    return {g: {k: _last(cs) for k, cs in keys.items()} for g, keys in got.items()}


def global_records(tables: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """One row a record of all files, (filename, domain, table): keys by group, the record as JSON, ``gid`` in source order."""
    out = None
    for k, (filename, domain, df) in enumerate(tables):
        keys = typed_keys(data_columns(df))
        maps = {g: F.map_filter(F.create_map(*[x for n, c in sorted(keys[g].items()) for x in (F.lit(n), c)]) if keys[g] else F.create_map().cast("map<string,string>"), lambda _, v: v.isNotNull()) for g in keys}
        names = [c for c in data_columns(df) if _base(c) in NAMES]
        label = F.coalesce(*[F.when(~S.is_empty(q(c).cast("string")), S.trimmed(q(c).cast("string"))) for c in names], F.lit(None).cast("string"))
        rid = q(RID) if RID in df.columns else F.monotonically_increasing_id()
        one = df.select((F.lit(k).cast("long") * (1 << 40) + rid.cast("long")).alias("gid"), F.lit(filename).alias("filename"), F.lit(S.domain_of(domain)).alias("domain"), *[m.alias(g) for g, m in maps.items()], label.alias("label"), F.to_json(F.struct(*[q(c) for c in data_columns(df)])).alias("record"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def key_links(records: DataFrame) -> DataFrame:
    """(a, b) ties every record to the first one of its domain with the same primary key: as many edges as keys."""
    long = records.select("gid", "domain", F.explode("primary").alias("k", "v"))
    first = long.groupBy("domain", "k", "v").agg(F.min("gid").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return long.join(first, ["domain", "k", "v"]).filter("gid <> a").select("a", F.col("gid").alias("b"))


def name_links(records: DataFrame, alike: float = 0.90, alike_in_city: float = 0.82) -> DataFrame:
    """Records of one domain in two files with names at least ``alike``, or ``alike_in_city`` in one city.

    Different names are compared, once each, blocked by the beginnings or the ends of words, so that no nested loop over all
    pairs arises. Rows of alike names hang together through the first of each file, which ties them like all pairs would.
    """
    n = records.select("gid", "domain", "filename", F.col("descriptive")["name"].alias("name"), F.col("descriptive")["city"].alias("city")).filter("name is not null")
    d = materialize(n.groupBy("domain", "filename", "name", "city").agg(F.min("gid").alias("gid")))
    words = F.split("name", " ")
    heads = F.array_sort(F.transform(words, lambda x: F.substring(x, 1, 3)))
    keys = F.array_distinct(F.concat(F.transform(heads, lambda x: F.concat(F.lit("h"), x)), F.transform(words, lambda x: F.concat(F.lit("t"), F.right(x, F.lit(4))))))
    told = d.select("domain", "name").distinct()
    long = told.withColumn("k", F.explode(keys))
    pairs = long.toDF("domain", "x", "k").join(long.toDF("domain", "y", "k"), ["domain", "k"]).filter("x < y").select("domain", "x", "y").distinct()
    least = min(alike, alike_in_city)
    if least > 0.2:  # cheap conditions, one of which holds for every likeness above that of other suffixes
        x, y, longest = F.col("x"), F.col("y"), F.greatest(F.length("x"), F.length("y"))
        edits = (1 - least) * longest + 1e-6
        tokens = [F.array_distinct(F.split(c, " ")) for c in (x, y)]
        shared = F.size(F.array_intersect(*tokens)) >= 0.7 * F.greatest(*[F.size(t) for t in tokens]) - 1e-6
        pairs = pairs.filter(x.contains(y) | y.contains(x) | shared | ((F.abs(F.length("x") - F.length("y")) <= edits) & (F.levenshtein("x", "y") <= edits)))
    near = materialize(pairs.withColumn("s", S.string_similarity(F.col("x"), F.col("y"))).filter(F.col("s") >= least))
    sure = near.filter(F.col("s") >= alike)
    ways = reduce(DataFrame.unionByName, [told.select("domain", F.col("name").alias("x"), F.col("name").alias("y")), sure.select("domain", "x", "y"), sure.select("domain", F.col("y").alias("x"), F.col("x").alias("y"))])
    lead = d.groupBy("domain", F.col("name").alias("x"), F.col("filename").alias("fx")).agg(F.min("gid").alias("a"))
    rows = d.select("domain", F.col("name").alias("y"), F.col("filename").alias("fy"), F.col("city").alias("cy"), F.col("gid").alias("b"))
    tied = ways.join(lead, ["domain", "x"]).join(rows, ["domain", "y"]).filter("fx <> fy").select("a", "b")
    own = d.select("domain", F.col("name").alias("x"), F.col("filename").alias("fx"), F.col("city").alias("cy"), F.col("gid").alias("a"))
    in_city = near.filter((F.col("s") >= alike_in_city) & (F.col("s") < alike)).join(own, ["domain", "x"]).join(rows, ["domain", "y", "cy"]).filter("fx <> fy").select("a", "b")
    links = tied.unionByName(in_city).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # rows of one name, city and file hang together through their first
    same = n.join(d.withColumnRenamed("gid", "first"), (n.domain == d.domain) & (n.filename == d.filename) & (n.name == d.name) & n.city.eqNullSafe(d.city)).select(F.col("first").alias("a"), n.gid.alias("b")).filter("a <> b")
    linked = links.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return links.unionByName(same.join(linked, "a", "left_semi").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) with the least id of each component: minimum labels spread along edges and over the label of the label.

    Labels are written to shared storage each round; rounds grow with the logarithm of the diameter.
    """
    e = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(sym.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        around = sym.join(label.toDF("b", "rb"), "b").groupBy(F.col("a").alias("v")).agg(F.min("rb").alias("rb"))
        near = label.join(around, "v").select("v", F.least("root", "rb").alias("r"), "root")
        jumped = near.join(label.toDF("r", "rr"), "r", "left").select("v", F.least("r", F.coalesce("rr", "r")).alias("root"), F.col("root").alias("old"))
        nxt = materialize(jumped)
        changed = not nxt.filter("root <> old").isEmpty()
        label = nxt.select("v", "root")
        if not changed:
            return label


def resolve_entities(records: DataFrame, cluster_transactions: bool = True) -> tuple[DataFrame, DataFrame]:
    """(membership, clusters) of records that mean one entity.

    Membership is (gid, root); a cluster has its id ``<DOMAIN>-ENTITY-nnn`` numbered by first record, display name, keys,
    files and confidence. ``cluster_transactions`` False keeps sales of one customer apart.
    """
    rec = records if cluster_transactions else records.filter("domain <> 'transaction'")
    member = components(key_links(rec).unionByName(name_links(rec)))
    joined = member.join(rec, member.v == rec.gid)
    keys = F.array_join(F.array_sort(F.transform(F.map_entries("primary"), lambda e: F.concat(F.upper(e["key"]), F.lit(": "), e["value"]))), "; ")
    agg = joined.groupBy("root").agg(F.first("domain").alias("entity_type"), F.count("*").alias("records_count"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("gid"))).alias("display_name"), F.sort_array(F.collect_set("filename")).alias("files_involved"), F.sort_array(F.collect_set(F.nullif(keys, F.lit("")))).alias("matched_keys"))
    numbered = numbered_rows(agg, "root")
    mid = F.concat(F.upper("entity_type"), F.lit("-ENTITY-"), F.lpad(F.col("n").cast("string"), 3, "0"))
    clusters = numbered.withColumn("match_id", F.when(F.col("n") > 999, F.concat(F.upper("entity_type"), F.lit("-ENTITY-"), F.col("n").cast("string"))).otherwise(mid)).withColumn("confidence", F.when(F.size("matched_keys") > 0, 0.98).otherwise(0.88))
    return member.select(F.col("v").alias("gid"), "root"), clusters.select("root", "match_id", "entity_type", F.coalesce("display_name", "match_id").alias("display_name"), "records_count", "files_involved", "matched_keys", "confidence")


def _first_of(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """First row of each key, (key, cols...): the build side of the look-ups, with no repeats."""
    return df.filter(q(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *cols)).alias("f")).select(key, *[F.col(f"f.{c}").alias(c) for c in cols])


def transaction_edges(sales: DataFrame, customers: DataFrame | None = None, products: DataFrame | None = None, stores: DataFrame | None = None) -> DataFrame:
    """M9 A-F, C1-C4: (relationship, source_type, source_id, source_name, target_type, target_id, target_name, method).

    ``sales`` is (rid, transaction_id, customer_id, customer_phone, product_id, store_id); the others are (rid, id, name) and
    customers also phone. Ids are compared in match form on both sides; an edge needs an id in the sale, not a record behind it. The
    first edge of a signature is kept, without a sort: a minimum over the source order.
    """
    s = sales.select("rid", *[F.when(~S.is_empty(F.col(c)), S.trimmed(F.col(c))).alias(c) for c in ("transaction_id", "customer_id", "customer_phone", "product_id", "store_id")])
    key = lambda c: F.upper(S.match_form(F.col(c)))
    tail = lambda c: F.right(F.regexp_replace(F.col(c), r"\D", ""), F.lit(10))
    s = s.withColumn("kc", key("customer_id")).withColumn("kp", key("product_id")).withColumn("ks", key("store_id")).withColumn("ph", F.when(F.length(tail("customer_phone")) >= 7, tail("customer_phone")))
    for df, k, n in ((customers, "kc", "customer"), (products, "kp", "product"), (stores, "ks", "store")):
        if df is None:
            s = s.withColumn(f"{n}_name", F.lit(None).cast("string"))
            continue
        build = _first_of(df.withColumn(k, key("id")), k, "rid", "name").withColumnRenamed("name", f"{n}_name")
        s = s.join(build, k, "left")
    if customers is not None and "phone" in customers.columns:
        build = _first_of(customers.withColumn("ph", tail("phone")).filter(F.length("ph") >= 7), "ph", "rid", "id", "name").toDF("ph", "pid", "pname")
        s = s.join(build, "ph", "left")
        by_phone = F.col("customer_name").isNull() & F.col("pid").isNotNull() & F.col("customer_id").isNull()
        s = s.withColumns({"customer_name": F.when(by_phone, F.col("pname")).otherwise(F.col("customer_name")), "customer_id": F.when(by_phone, F.col("pid")).otherwise(F.col("customer_id"))})
    ends = {
        "transaction": (F.col("transaction_id"), F.concat(F.lit("Order #"), F.col("transaction_id"))),
        "customer": (F.col("customer_id"), F.coalesce("customer_name", "customer_id")), "product": (F.col("product_id"), F.coalesce("product_name", "product_id")), "store": (F.col("store_id"), F.coalesce("store_name", "store_id")),
    }
    rows = [F.when(ends[a][0].isNotNull() & ends[b][0].isNotNull(), F.struct(F.lit(k).alias("o"), F.lit(rel).alias("relationship"), F.lit(a).alias("source_type"), ends[a][0].alias("source_id"), ends[a][1].alias("source_name"), F.lit(b).alias("target_type"), ends[b][0].alias("target_id"), ends[b][1].alias("target_name"), F.lit(m).alias("method"))) for k, (rel, a, b, m, _) in enumerate(EDGES)]
    long = s.select("rid", F.explode(F.array_compact(F.array(*rows))).alias("e"))
    return unique_edges(long.select(F.struct("rid", "e.o").alias("at"), *[F.col(f"e.{c}").alias(c) for c in EDGE_COLUMNS]))


EDGE_COLUMNS = ("relationship", "source_type", "source_id", "source_name", "target_type", "target_id", "target_name", "method")
SIGNATURE = ("relationship", "source_type", "source_id", "target_type", "target_id")


def unique_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each signature; ``at`` is its place in the source."""
    rest = [c for c in edges.columns if c not in SIGNATURE and c != "at"]
    return edges.groupBy(*SIGNATURE).agg(F.min(F.struct("at", *rest)).alias("f")).select(F.col("f.at").alias("at"), *[F.col(c) if c in SIGNATURE else F.col(f"f.{c}").alias(c) for c in EDGE_COLUMNS])


def numbered_rows(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``n``, from 1 in the order of a column. Partition sizes are summed first, so numbering needs no single task."""
    ordered = materialize(df.orderBy(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r._p: r.n for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])[F.col("_p")] if start else F.lit(0)
    return ordered.withColumn("n", (offset + F.row_number().over(Window.partitionBy("_p").orderBy("_m"))).cast("long")).drop("_p", "_m")


def number_edges(edges: DataFrame) -> DataFrame:
    """Ids ``REL-0001`` in source order."""
    n = F.col("n").cast("string")
    return numbered_rows(edges, "at").withColumn("edge_id", F.concat(F.lit("REL-"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))).drop("n")


def foreign_edges(records: DataFrame, stores: DataFrame, rel: str, source: str) -> DataFrame:
    """Inner links of ``records`` (rid, id, name, store_id) to ``stores`` (rid, id, name).

    ``source`` "customer" gives customer -registered_at-> store, "store" gives store -sold-> product.
    """
    k = F.upper(S.match_form(F.col("store_id")))
    build = _first_of(stores.withColumn("k", F.upper(S.match_form(F.col("id")))), "k", "rid", "id", "name").toDF("k", "sid", "sname")
    j = records.filter(F.col("id").isNotNull()).withColumn("k", k).join(build, "k")
    own, other = (F.col("id"), F.coalesce("name", "id")), (F.col("sid"), F.coalesce("sname", "sid"))
    ends = (own, other) if source == "customer" else (other, own)
    types = ("customer", "store") if source == "customer" else ("store", "product")
    edges = j.select(F.struct("rid", F.lit(9).alias("o")).alias("at"), F.lit(rel).alias("relationship"), F.lit(types[0]).alias("source_type"), ends[0][0].alias("source_id"), ends[0][1].alias("source_name"), F.lit(types[1]).alias("target_type"), ends[1][0].alias("target_id"), ends[1][1].alias("target_name"), F.lit("Direct Foreign Key").alias("method"))
    return unique_edges(edges)


def edge_confidence(edges: DataFrame) -> DataFrame:
    return edges.withColumn("confidence", F.when(F.col("relationship") == "registered_at", FOREIGN_CONFIDENCE).otherwise(EDGE_CONFIDENCE))


def edge_stats(edges: DataFrame) -> DataFrame:
    """Number and mean confidence of the edges of each pair of types, and distinct ends overall."""
    e = edge_confidence(edges)
    return e.groupBy(F.concat_ws("_", "source_type", "target_type").alias("edge_type")).agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 2).alias("mean_confidence"))


def connected_ends(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_type").alias("t"), F.col("source_id").alias("i")), F.struct(F.col("target_type").alias("t"), F.col("target_id").alias("i")))).alias("x"))
    return ends.agg(F.countDistinct("x.t", "x.i").alias("connected"))


def filter_edges(edges: DataFrame, relationship: str | None = None, band: str | None = None, method: str | None = None, text: str | None = None) -> DataFrame:
    """By type, confidence band (high, medium, low), part of the method, text in ids and names."""
    e = edge_confidence(edges)
    if relationship:
        e = e.filter(F.col("relationship") == relationship)
    if band:
        e = e.filter({"high": "confidence >= 0.90", "medium": "confidence >= 0.75 and confidence < 0.90", "low": "confidence < 0.75"}[band])
    if method:
        e = e.filter(F.lower("method").contains(method.lower()))
    if text:
        e = e.filter(F.exists(F.array("source_id", "source_name", "target_id", "target_name"), lambda x: F.lower(x).contains(text.lower())))
    return e


def filter_matches(clusters: DataFrame, entity: str | None = None, text: str | None = None) -> DataFrame:
    """B19"""
    c = clusters.filter(F.col("entity_type") == entity) if entity else clusters
    if text:
        t = text.lower()
        c = c.filter(F.lower("match_id").contains(t) | F.lower("display_name").contains(t) | F.exists(F.concat("files_involved", "matched_keys"), lambda x: F.lower(x).contains(t)))
    return c
