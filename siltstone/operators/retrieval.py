"""Deterministic text vectors, collections of them, similarity look-up and schema retrieval."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import match as M
from .clean import data_columns, q
from .entities import CATALOGUE, Entity

DIM = 384
#: Most queries that are searched at once: the stated query set is sent to every task.
QUERIES = 4096

# --- fixed values ---------------------------------------------------------
PRIORITY = {
    "customer": (
        "customer_id", "cust_id", "id", "code", "name", "full_name", "customer_name", "first_name", "last_name", "phone", "mobile", "contact",
        "customer_phone", "email", "customer_email", "address", "street", "city", "state", "pin", "pincode", "zip_code", "postal_code", "country",
        "age", "gender", "dob",
    ),
    "store": (
        "store_id", "branch_id", "outlet_id", "id", "code", "store_name", "branch_name", "outlet_name", "name", "city", "state", "address",
        "location", "pin", "pincode", "zip_code", "postal_code", "manager", "manager_name", "phone", "email", "store_type", "region",
    ),
    "item": (
        "product_id", "item_id", "sku", "barcode", "upc", "ean", "id", "code", "product_name", "item_name", "name", "title", "category",
        "subcategory", "brand", "manufacturer", "price", "unit_price", "selling_price", "mrp", "cost_price", "stock", "quantity", "inventory",
    ),
    "transaction": (
        "transaction_id", "order_id", "invoice_id", "bill_id", "id", "date", "transaction_date", "order_date", "customer_id", "store_id", "item_id",
        "product_id", "total_amount", "amount", "price", "quantity", "qty", "payment_method",
    ),
}
COLLECTIONS = {"customer": ("customer", "client", "user"), "store": ("store", "branch", "outlet"), "item": ("item", "product", "sku"), "transaction": ("transaction", "order", "sale"), "schema": ("schema",), "general": ()}
ID_PRIORITY = ("id", "doc_id", "customer_id", "store_id", "product_id", "item_id", "transaction_id", "order_id", "code")
ABBREVIATIONS = {
    "customer": {
        "cust_nm": "name", "client_name": "name", "buyer_name": "name", "cust_no": "customer_id", "client_id": "customer_id", "mob_no": "phone",
        "cell_no": "phone", "ph_num": "phone", "contact_num": "phone", "mail_addr": "email", "e_mail": "email", "res_addr": "address",
        "street_addr": "address", "zip_cd": "postal_code", "pin_cd": "postal_code",
    },
    "item": {
        "prod_cd": "product_id", "prod_id": "product_id", "item_cd": "product_id", "prod_nm": "product_name", "item_nm": "product_name",
        "prod_desc": "description", "unit_prc": "price", "sell_prc": "price", "cost_prc": "cost_price", "mrp_val": "price", "qty": "stock",
        "qty_on_hand": "stock", "stk_qty": "stock", "mfg_name": "brand",
    },
    "store": {
        "str_id": "store_id", "str_nm": "store_name", "br_id": "store_id", "br_nm": "store_name", "out_id": "store_id", "str_loc": "address",
        "str_mgr": "manager_name", "br_mgr": "manager_name",
    },
}
# --------------------------------------------------------------------------


# --- fixed values: tokens and hashes that make vectors equal to stored ones
GRAMS = ((2, "bi"), (3, "tri"), (4, "quad"))
WORD, SPLIT, DIGITS = r"[\w@.+]+", r"[_\-\s.]+", r"\d+"
WHOLE_TAG, PART_TAG, NUMBER_TAG, TAIL_TAG, TAIL = "full", "w", "num", "num_end", 4
HASH_DIGITS, MIX, WEIGHT_STEPS, SECOND = 8, 31, 100, 0.5
# --------------------------------------------------------------------------


def token_counts(text: str) -> Counter[str]:
    """How often each token of a text occurs: itself, words, parts of words, their n-grams, numbers and the ends of long numbers."""
    t = text.lower().strip()
    words, parts, numbers = re.findall(WORD, t), re.split(SPLIT, t), re.findall(DIGITS, t)
    found = Counter(words)
    found[f"{WHOLE_TAG}_{t}"] += 1
    found.update(f"{PART_TAG}_{p}" for p in parts if p)
    found.update(f"{tag}_{w[i : i + n]}" for w in set(words) | set(parts) for n, tag in GRAMS for i in range(len(w) - n + 1))
    found.update(f"{NUMBER_TAG}_{d}" for d in numbers)
    found.update(f"{TAIL_TAG}_{d[-TAIL:]}" for d in numbers if len(d) >= TAIL)
    return found


def _places(token: str, dim: int) -> tuple[int, float, int, float]:
    """The two places of a vector that a token adds to, and what it adds."""
    raw = token.encode()
    first, second = (int(h(raw).hexdigest()[:HASH_DIGITS], 16) for h in (hashlib.md5, hashlib.sha256))
    sign = 1.0 - 2 * (second % 2)
    return first % dim, sign * (1.0 + second % WEIGHT_STEPS / (2 * WEIGHT_STEPS)), (first * MIX + second) % dim, sign * SECOND


def embed(text: str | None, dim: int = DIM, memo: dict[str, tuple[int, float, int, float]] | None = None) -> np.ndarray:
    """Hashed token vector of length one; zeros for blank texts. ``memo`` keeps the places of tokens between texts."""
    if not text or not text.strip():
        return np.zeros(dim, np.float64)
    memo = {} if memo is None else memo
    counts = token_counts(text)
    for t in counts.keys() - memo.keys():
        memo[t] = _places(t, dim)
    at = np.array([memo[t] for t in counts], np.float64)
    n = np.fromiter(counts.values(), np.float64)
    v = np.bincount(at[:, 0].astype(np.int64), n * at[:, 1], dim) + np.bincount(at[:, 2].astype(np.int64), n * at[:, 3], dim)
    length = np.linalg.norm(v)
    return v / length if length else v


def embed_texts(docs: DataFrame, rid: str, text: str = "text") -> DataFrame:
    """(rid, vector: array<float>) of each text, in Arrow batches."""
    kind = docs.schema[rid].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, float, int, float]] = {}
        for b in batches:
            if len(memo) > 200_000:
                memo.clear()
            x = [embed(t, DIM, memo) for t in b.column(1).to_pylist()]
            flat = np.concatenate(x).astype(np.float32) if x else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, DIM, dtype=np.int32), flat)], names=[rid, "vector"])

    from pyspark.sql import types as T

    return docs.select(q(rid), q(text)).mapInArrow(run, T.StructType([T.StructField(rid, kind), T.StructField("vector", T.ArrayType(T.FloatType()))]))


def serialize(columns: Sequence[str], entity: str) -> Column:
    """``Entity: X | Label: value | ...``, known fields first, then the rest; empty ones left out."""
    by = {S.header_token(c): c for c in reversed(columns)}
    order = [by[k] for k in PRIORITY.get(entity.lower(), ()) if k in by]
    order += [c for c in columns if c not in order and not c.startswith("_")]
    parts = [F.when(~S.is_empty(q(c).cast("string")), F.concat(F.lit(f"{c.replace('_', ' ').title()}: "), S.display_value(q(c).cast("string")))) for c in order]
    return F.concat_ws(" | ", F.lit(f"Entity: {entity.capitalize()}"), *parts)


def cosine(a: Column, b: Column) -> Column:
    """R2: dot product of two unit vectors, between 0 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot))


def collection_of(entity: str) -> str:
    """Name of the collection of an entity; collections are partitions of one table by ``entity_type``."""
    return next((k for k, words in COLLECTIONS.items() if entity.lower() in words), "general")


def record_id(columns: Sequence[str]) -> Column:
    """The first filled key, else a random id."""
    by = {S.header_token(c): c for c in columns}
    keys = [F.when(~S.is_empty(q(by[k]).cast("string")), S.trimmed(q(by[k]).cast("string"))) for k in ID_PRIORITY if k in by]
    return F.coalesce(*keys, F.uuid()) if keys else F.uuid()


def ingest(df: DataFrame, entity: str) -> DataFrame:
    """(doc_id, text, vector, entity_type) of a table of records."""
    docs = df.select(record_id(data_columns(df)).alias("doc_id"), serialize(data_columns(df), entity).alias("text"))
    vectors = embed_texts(docs.withColumn("_k", F.struct("doc_id", "text")).select("doc_id", "text"), "doc_id")
    return docs.join(vectors, "doc_id").withColumn("entity_type", F.lit(collection_of(entity)))


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def top_k(collection: DataFrame, queries: DataFrame, rid: str, vector: str = "vector", k: int = 5, least: float = 0.0, dim: int | None = None) -> DataFrame:
    """(query_id, id, score) of the ``k`` best rows of ``collection`` for each of at most ``QUERIES`` queries.

    The queries (query_id, vector) are a stated set: they are collected once and each task multiplies its rows with all of
    them, keeping ``k`` a query and batch; the few that are left are ranked by window. Ties go to the smaller id.
    """
    rows = queries.select("query_id", vector).limit(QUERIES + 1).collect()
    if len(rows) > QUERIES:
        raise ValueError(f"more than {QUERIES} queries: search them in blocks")
    ids, kind = [r[0] for r in rows], collection.schema[rid].dataType
    x = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, dim or 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    qtype = queries.schema["query_id"].dataType
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    out = T.StructType([T.StructField("query_id", qtype), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    qa = to_arrow_type(qtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            if not len(ids) or not b.num_rows:
                continue
            y = np.asarray(col.flatten(), np.float64).reshape(b.num_rows, -1)
            n = np.linalg.norm(y, axis=1, keepdims=True)
            s = np.round(x @ (y / np.where(n > 0, n, 1)).T, 6)
            take = min(k, b.num_rows)
            edge = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
            r, c = np.nonzero((s >= edge[:, None]) & (s >= least))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in r], qa), b.column(0).take(pa.array(c)), pa.array(s[r, c])], names=["query_id", "id", "score"])

    width = x.shape[1] if len(rows) else dim or 1
    usable = collection.filter(F.size(q(vector)) == width).select(q(rid), q(vector))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return usable.mapInArrow(run, out).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_records(collection: DataFrame, record: dict[str, str], entity: str, k: int = 5, least: float = 0.35, exclude: str | None = None) -> DataFrame:
    """Records most like ``record``; ``exclude`` leaves one id out."""
    spark = collection.sparkSession
    text = spark.createDataFrame([record]).select(serialize(list(record), entity)).first()[0]
    queries = spark.createDataFrame([(0, [float(x) for x in embed(text)])], "query_id int, vector array<double>")
    own = collection.filter(F.col("entity_type") == collection_of(entity))
    if exclude is not None:
        own = own.filter(F.col("doc_id") != exclude)
    return top_k(own, queries, "doc_id", k=k, least=least, dim=DIM)


def schema_knowledge(spark: SparkSession, catalogue: dict[str, Entity] = CATALOGUE) -> DataFrame:
    """(doc_id, alias, canonical_field, entity_type, vector) of fields, aliases and abbreviations of four entities."""
    rows = []
    for name in ("customer", "item", "store", "transaction"):
        pairs = [(a, f.name) for f in catalogue[name].fields.values() for a in sorted(f.aliases)]
        pairs += ABBREVIATIONS.get(name, {}).items()
        rows += [(f"{name}:{alias}:{canon}", alias, canon, name, [float(x) for x in embed(alias)]) for alias, canon in dict.fromkeys(pairs)]
    return spark.createDataFrame(rows, "doc_id string, alias string, canonical_field string, entity_type string, vector array<double>")


def map_headers(knowledge: DataFrame, headers: Sequence[str], entity: str, k: int = 3, least: float = 0.20) -> DataFrame:
    """(header, canonical_field, score): the best distinct fields of each header."""
    spark = knowledge.sparkSession
    asked = [(h, [float(x) for x in embed(h.strip().lower())]) for h in headers]
    own = knowledge.filter(F.col("entity_type") == entity)
    hits = top_k(own, spark.createDataFrame(asked, "query_id string, vector array<double>"), "doc_id", k=k * 10, least=least)
    named = hits.join(own.select(F.col("doc_id").alias("id"), "canonical_field"), "id")
    best = named.groupBy(F.col("query_id").alias("header"), "canonical_field").agg(F.max("score").alias("score"))
    w = Window.partitionBy("header").orderBy(F.desc("score"), "canonical_field")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def map_header_batch(knowledge: DataFrame, headers: Sequence[str], entity: str, least: float = 0.30) -> dict[str, tuple[str, float]]:
    """The best field of each header, where it reaches ``least``; headers are few, so the answer is a dictionary."""
    return {r.header: (r.canonical_field, r.score) for r in map_headers(knowledge, headers, entity, k=1).filter(F.col("score") >= least).collect()}


def save_collection(collection: DataFrame, path: str) -> None:
    """A collection as one table, a folder each entity type, so that a look-up reads its own type only."""
    collection.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def load_collection(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """A stored collection, or its part of one entity."""
    df = spark.read.parquet(path)
    return df if entity is None else df.filter(F.col("entity_type") == collection_of(entity))


def clear_collection(spark: SparkSession, path: str, entity: str | None = None) -> None:
    """Deletes a stored collection, or its part of one entity."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path if entity is None else f"{path.rstrip('/')}/entity_type={collection_of(entity)}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def record_matches(collection: DataFrame, queries: DataFrame, entity: str, columns: Sequence[str], k: int = 5, least: float = 0.35, reason: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stored records that match each query record, best first.

    ``collection`` has doc_id, vector, entity_type and ``columns``; ``queries`` has query_id and ``columns``. The ``k`` nearest of
    each query are compared field by field (M1, M3); candidates with another id or with nothing but weak fields in common are left out.
    Gives (query_id, doc_id, score, matched, conflicting, confidence, filled, merged, reason, rank); ``reason`` may rewrite the reasons.
    """
    texts = queries.select("query_id", serialize(list(columns), entity).alias("text"))
    own = collection.filter(F.col("entity_type") == collection_of(entity))
    near = top_k(own, embed_texts(texts, "query_id"), "doc_id", k=k, least=least, dim=DIM).drop("rank")
    one = lambda d, rid, s: d.select(q(rid).alias("query_id" if s == "a" else "id"), F.struct(*[q(c).cast("string").alias(c) for c in columns]).alias(s))
    pairs = near.join(F.broadcast(one(queries, "query_id", "a")), "query_id").join(one(own, "doc_id", "b"), "id")  # queries: at most QUERIES rows
    merged, filled = M.merge(columns)
    out = pairs.filter(~M.conflicting_ids(columns)).select("query_id", F.col("id").alias("doc_id"), "score", M.compare(columns).alias("m"), filled.alias("filled"), merged.alias("merged"))
    out = out.filter(F.exists("m.weights", lambda w: w > 0.30)).select("query_id", "doc_id", "score", "m.matched", "m.conflicting", "m.confidence", "filled", "merged", F.concat(F.lit("matched on "), F.array_join("m.matched", ", ")).alias("reason"))
    if reason is not None:
        out = reason(out)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("score"), "doc_id")))
