"""From a file, or several, to clean linked tables: plans are built, actions run at the sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import extract as X
from ..operators import link as L
from ..operators import match as M
from ..operators import schema as K
from ..operators.clean import RID, clean_table, cleaning_metrics, data_columns, union_collections
from ..operators.entities import CATALOGUE
from ..operators.profile import profile
from ..sources import readers as R


@dataclass
class Hooks:
    """L1-L3: optional services; each may return None, then the rules decide."""

    extract: Callable[[DataFrame], DataFrame | None] | None = None
    classify: Callable[[DataFrame], K.Classification | None] | None = None
    explain: Callable[[DataFrame], DataFrame | None] | None = None


@dataclass
class Result:
    """Lazy tables and reports of one file."""

    name: str
    status: str = "completed"
    kind: str = "unknown"
    confidence: float = 0.0
    tables: dict[str, DataFrame] = field(default_factory=dict)
    fields: DataFrame | None = None
    reports: dict[str, DataFrame] = field(default_factory=dict)
    steps: list[tuple[str, str]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def process_table(df: DataFrame, name: str, hooks: Hooks = Hooks(), collection: str | None = None) -> Result:
    """Clean, profile, audit, validate, classify, map and standardise one table of text cells with ``_rid``."""
    out = Result(name)
    hybrid = X.extract_hybrid(df)
    cleaned = clean_table((hybrid.drop("warnings") if hybrid is not None else df))
    out.steps.append(("clean", "completed"))
    found = K.classify(cleaned, fallback=hooks.classify)
    metrics = cleaning_metrics(df)
    matches = M.match_table(cleaned, found.kind)
    out.reports = {"metrics": metrics, "profile": profile(cleaned), "matches": matches, "audit": A.audit(cleaned, matches), "errors": A.validate(cleaned)}
    out.reports["scorecard"] = A.scorecard(out.reports["audit"], A.cleaning_actions(metrics))
    if found.kind == "unknown" and collection and (e := K.entity_of_collection(collection)):
        found = K.Classification(e, 0.70, {}, {}, [e])
    out.kind, out.confidence = found.kind, found.confidence
    if hooks.explain and (told := hooks.explain(cleaned)) is not None:
        out.reports["explained"] = told
    out.steps.append(("classify", "completed"))
    if found.kind == "mixed":
        out.tables = K.split_mixed(cleaned, found)
        out.tables["combined"] = cleaned
    elif found.kind in CATALOGUE:
        canon, mapping = K.to_canonical(cleaned, CATALOGUE[found.kind])
        out.tables[found.kind] = K.standardize(canon, CATALOGUE[found.kind])
        out.reports["coverage"] = A.coverage(out.tables[found.kind], list(CATALOGUE[found.kind].fields))
        rows = [(c, t) for t, cs in mapping.items() for c in cs]
        out.reports["mapping"] = df.sparkSession.createDataFrame(rows, "source string, target string")
    else:
        out.tables["general"] = cleaned
    return out


def process_text(texts: DataFrame, name: str, hooks: Hooks = Hooks()) -> Result:
    """Fields or records of texts (path, text)."""
    out = Result(name)
    docs = X.clean_texts(texts.select(F.col("path").alias("doc_id"), "text"))
    given = hooks.extract(docs) if hooks.extract else None
    if given is not None:
        out.tables["records"] = given
    else:
        out.tables["records"] = X.extract_records(docs)
        out.fields = X.extract_fields(docs)
        out.tables["lines"] = X.key_value_lines(docs)
    out.reports = {"audit": A.audit_text(docs)}
    if out.fields is not None:
        out.reports["errors"] = A.validate_fields(out.fields)
    told = K.classify_texts(docs).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))
    kinds = told.orderBy(F.desc("n"), "domain").limit(1).collect()  # the kind of most documents
    if kinds:
        out.kind, out.confidence = kinds[0].domain, kinds[0].confidence
    return out


def process_file(spark: SparkSession, path: str, hooks: Hooks = Hooks()) -> Result:
    """Any file the readers know; what goes wrong is a failed status, not an exception."""
    name = path.rsplit("/", 1)[-1]
    kind = R.EXTENSIONS.get(name.rsplit(".", 1)[-1].lower(), "txt")
    try:
        if kind == "csv":
            return process_table(R.read_csv(spark, path), name, hooks)
        if kind == "json":
            got = R.read_json(spark, path)
            return process_collections(got, name, hooks) if isinstance(got, dict) else process_table(got, name, hooks)
        if kind == "excel":
            sheets = R.read_excel(spark, path)
            return process_collections(sheets, name, hooks) if len(sheets) > 1 else process_table(next(iter(sheets.values())), name, hooks)
        return process_text(R.extract_text(R.scan_files(spark, path)).filter("text is not null"), name, hooks)
    except Exception as e:  # a bad file must not stop a batch
        return Result(name, status="failed", errors=[f"{type(e).__name__}: {e}"])


def process_collections(tables: dict[str, DataFrame], name: str, hooks: Hooks = Hooks()) -> Result:
    """Several tables of one file: each by itself, their audits added up, all rows together as "combined"."""
    out = Result(name, kind="mixed")
    parts = {n: process_table(df, f"{name}:{n}", hooks, n) for n, df in tables.items()}
    for n, r in parts.items():
        for e, df in r.tables.items():
            out.tables[e if e not in out.tables else f"{e}:{n}"] = df
    out.confidence = round(sum(r.confidence for r in parts.values()) / len(parts), 4) if parts else 0.0
    out.reports["audit"] = A.merge_audits([r.reports["audit"] for r in parts.values()])
    out.reports["scorecard"] = A.scorecard(out.reports["audit"])
    out.tables["combined"] = union_collections({n: clean_table(df) for n, df in tables.items()}, "_collection")
    return out


@dataclass
class Batch:
    """Results of several files, clusters and relationships over them."""

    results: list[Result]
    membership: DataFrame | None = None
    clusters: DataFrame | None = None
    edges: DataFrame | None = None
    stats: DataFrame | None = None


def _pick(df: DataFrame, columns: dict[str, Sequence[str]]) -> DataFrame:
    have = {c.lower(): c for c in data_columns(df)}
    cols = [F.coalesce(*[F.col(f"`{have[n]}`").cast("string") for n in names if n in have], F.lit(None).cast("string")).alias(k) for k, names in columns.items()]
    return df.select(F.col(RID).alias("rid"), *cols)


def link_tables(tables: Sequence[tuple[str, str, DataFrame]]) -> Batch:
    """Clusters of one entity and directed relationships over (filename, domain, table)."""
    records = L.global_records(tables)
    member, clusters = L.resolve_entities(records)
    by: dict[str, DataFrame] = {}
    shape = {
        "customer": {"id": ("customer_id", "cust_id"), "name": ("full_name", "customer_name", "name"), "phone": ("phone", "mobile"), "store_id": ("store_id",)},
        "product": {"id": ("item_id", "product_id", "sku"), "name": ("item_name", "product_name", "name"), "store_id": ("seller_id", "store_id")},
        "store": {"id": ("store_id", "branch_id"), "name": ("store_name", "name")},
        "transaction": {"transaction_id": ("transaction_id", "order_id", "invoice_no"), "customer_id": ("customer_id", "cust_id"), "customer_phone": ("phone", "buyer_phone", "relationship_context_buyer_phone"), "product_id": ("item_id", "product_id", "sku"), "store_id": ("store_id", "branch_id")},
    }
    from ..functions.scalars import domain_of

    for _, domain, df in tables:
        d = domain_of(domain)
        if d in shape:
            one = _pick(df, shape[d])
            by[d] = by[d].unionByName(one) if d in by else one
    edges = None
    if "transaction" in by:
        edges = L.transaction_edges(by["transaction"], by.get("customer"), by.get("product"), by.get("store"))
    for d, rel in (("customer", "registered_at"), ("product", "sold")):
        if d in by and "store" in by:
            direct = L.foreign_edges(by[d], by["store"], rel, "customer" if d == "customer" else "store")
            edges = direct if edges is None else L.unique_edges(edges.unionByName(direct))
    return Batch([], member, clusters, edges, L.edge_stats(edges) if edges is not None else None)


def process_batch(spark: SparkSession, paths: Sequence[str], hooks: Hooks = Hooks()) -> Batch:
    """Every file by itself, failed ones skipped, then linking."""
    results = [process_file(spark, p, hooks) for p in paths]
    tables = [(r.name, r.kind, df) for r in results if r.status == "completed" for e, df in r.tables.items() if e == r.kind and RID in df.columns]
    out = link_tables(tables) if tables else Batch([])
    out.results = results
    return out
