"""Pairwise record matching with confidence, merge preview and conflicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .clean import RID, data_columns, q

# --- fixed values ---------------------------------------------------------
FUZZY = ("name", "full_name", "first_name", "last_name", "customer_name", "store_name", "product_name", "item_name", "address", "street", "location", "city", "title", "brand")
ID_COLUMNS = frozenset("id customer_id cust_id client_id member_id user_id store_id branch_id outlet_id warehouse_id item_id product_id sku sku_id barcode upc ean asin transaction_id order_id invoice_id receipt_id bill_id sale_id student_id emp_id employee_id roll_no reg_no code".split())
NAME_COLUMNS = ("name", "full_name", "first_name", "student_name", "customer_name", "person_name")
SALES = frozenset("transaction transactions sale sales order orders log logs".split())
MAX_COMPARISONS = 5000
# --------------------------------------------------------------------------


def _token(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def _side(side: str, c: str) -> Column:
    return F.col(f"{side}.`{c}`").cast("string")


def _forms(c: str, a: str, b: str) -> Column:
    """Both sides of a field in match form, null where empty."""
    x, y = _side(a, c), _side(b, c)
    return F.struct(F.when(~S.is_empty(x), S.match_form(x)).alias("x"), F.when(~S.is_empty(y), S.match_form(y)).alias("y"))


def _cell(c: str, fuzzy: bool) -> Callable[[Column], Column]:
    def read(e: Column) -> Column:
        x, y = e["x"], e["y"]
        near = S.bind(S.string_similarity(x, y), lambda s: F.when(s >= 0.70, s)) if fuzzy else F.lit(None).cast("double")
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit(c).alias("f"), F.lit(S.field_weight(c)).alias("w"), F.when(x == y, 1.0).otherwise(near).alias("s")))

    return read


def compare(columns: Sequence[str], a: str = "a", b: str = "b") -> Column:
    """M1 over the columns of ``a`` and ``b``: a struct of ``matched`` and ``conflicting`` names, ``confidence`` and ``weights``."""
    cells = []
    for c in columns:
        fuzzy = any(f in _token(c) for f in FUZZY)
        cells.append(S.bind(_forms(c, a, b), _cell(c, fuzzy)))
    def judge(live: Column) -> Column:
        matched, wrong = F.filter(live, lambda e: e["s"].isNotNull()), F.filter(live, lambda e: e["s"].isNull())
        total = F.aggregate(live, F.lit(0.0), lambda t, e: t + e["w"])
        got = F.aggregate(matched, F.lit(0.0), lambda t, e: t + e["w"] * e["s"])
        base = F.when(total > 0, F.least(F.lit(0.99), F.round(got / total, 2))).otherwise(0.0)
        floor = F.when((F.size(wrong) == 0) & (F.size(matched) >= 3), 0.95).when((F.size(wrong) == 0) & (F.size(matched) == 2), 0.85).otherwise(0.0)
        return F.struct(F.transform(matched, lambda e: e["f"]).alias("matched"), F.transform(wrong, lambda e: e["f"]).alias("conflicting"), F.greatest(base, floor).alias("confidence"), F.transform(matched, lambda e: e["w"]).alias("weights"))

    return S.bind(F.array_compact(F.array(*cells)), judge)


def merge(columns: Sequence[str], a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """M2: (merged record as a struct, the first side wins; names of the fields only one side has)."""
    xs = {c: (F.when(~S.is_empty(_side(a, c)), _side(a, c)), F.when(~S.is_empty(_side(b, c)), _side(b, c))) for c in columns}
    merged = F.struct(*[F.coalesce(x, y).alias(c) for c, (x, y) in xs.items()])
    filled = F.array_compact(F.array(*[F.when(x.isNull() != y.isNull(), F.lit(c)) for c, (x, y) in xs.items()]))
    return merged, filled


def conflicting_ids(columns: Sequence[str], a: str = "a", b: str = "b") -> Column:
    """M3: an id column differs, or a name column is less than 0.65 alike."""
    tests = []
    for c in columns:
        t = _token(c)
        if t.endswith("id") or t in ID_COLUMNS:
            tests.append(S.bind(_forms(c, a, b), lambda e: F.coalesce(e["x"] != e["y"], F.lit(False))))
        if t in NAME_COLUMNS:
            tests.append(S.bind(_forms(c, a, b), lambda e: F.coalesce((e["x"] != e["y"]) & (S.string_similarity(e["x"], e["y"]) < 0.65), F.lit(False))))
    return F.exists(F.array(*tests), lambda x: x) if tests else F.lit(False)


def first_pairs(df: DataFrame, most: int = MAX_COMPARISONS, order: str = RID) -> DataFrame:
    """The first ``most`` pairs (a, b) of rows, row by row, as the capped matcher takes them.

    Only the rows that take part are ranked: the pairs of a triangle of ``most`` come from its first rows, or from the first
    row with the next ``most``.
    """
    n = df.count()
    k = min(n, most + 1)
    head = df.orderBy(order).limit(k)
    i = head.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)  # at most ``most`` + 1 rows
    left = i.select(F.col("_i").alias("i"), F.struct(*[q(c) for c in df.columns]).alias("a"))
    partners = left.withColumn("start", F.col("i") * n - (F.col("i") * (F.col("i") + 1)) / 2).filter(F.col("start") < most)
    wanted = partners.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.least(F.lit(n - 1), F.col("i") + (most - F.col("start")).cast("int"))))).filter("j > i").drop("start")
    right = i.select(F.col("_i").alias("j"), F.struct(*[q(c) for c in df.columns]).alias("b"))
    return wanted.join(right, "j").select("i", "j", "a", "b")


def blocked_pairs(df: DataFrame, keys: Sequence[Column], order: str = RID) -> DataFrame:
    """Pairs that share a blocking key, each once: what takes the place of the cap on large tables. Only ids are paired, rows follow."""
    long = df.select(q(order).alias("r"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), c) for k, c in enumerate(keys)])))).alias("k"))
    pairs = long.toDF("i", "k").join(long.toDF("j", "k"), "k").filter("i < j").select("i", "j").distinct()
    side = lambda at, s: df.select(q(order).alias(at), F.struct(*[q(c) for c in df.columns]).alias(s))
    return pairs.join(side("i", "a"), "i").join(side("j", "b"), "j").select("i", "j", "a", "b")


def match_records(pairs: DataFrame, columns: Sequence[str], entity: str = "general") -> DataFrame:
    """M4: (i, j, matched, conflicting, confidence, status, filled, merged) of the pairs that match.

    Pairs with other ids, with nothing but weak fields in common, or with one field below 0.85 are left out. Conflicts are kept
    for review; a pair without conflicts is a candidate if merging fills something.
    """
    skip = conflicting_ids(columns)
    if entity.lower().strip() in SALES:
        txn = [c for c in columns if _token(c) in ("transaction_id", "order_id", "invoice_id")]
        x, y = (F.coalesce(*[F.when(~S.is_empty(_side(s, c)), S.match_form(_side(s, c))) for c in txn], F.lit(None).cast("string")) for s in "ab")
        skip = skip | F.coalesce(x != y, F.lit(False))
    merged, filled = merge(columns)
    out = pairs.filter(~skip).select("i", "j", compare(columns).alias("m"), filled.alias("filled"), merged.alias("merged")).select("i", "j", "m.*", "filled", "merged")
    strong = F.exists("weights", lambda w: w > 0.30)
    single = (F.size("matched") == 1) & F.exists("weights", lambda w: w >= 0.85) & (F.size("conflicting") == 0)
    out = out.filter(strong & ((F.size("matched") >= 2) | single))
    status = F.when(F.size("conflicting") > 0, "Review Required").when((F.size("matched") >= 3) | (F.col("confidence") >= 0.85), "high_confidence").otherwise("merge_candidate")
    return out.withColumn("status", status).filter((F.size("conflicting") > 0) | (F.size("filled") > 0)).drop("weights")


def match_table(df: DataFrame, entity: str = "general", max_comparisons: int | None = MAX_COMPARISONS, block: Sequence[Column] | None = None) -> DataFrame:
    """M4, M5 over a table: the first ``max_comparisons`` pairs, or with None all pairs that share a key of ``block``."""
    pairs = first_pairs(df, max_comparisons) if max_comparisons is not None else blocked_pairs(df, block or default_blocks(df))
    return match_records(pairs, data_columns(df), entity)


def default_blocks(df: DataFrame) -> list[Column]:
    """Keys a match needs: a strong field equal, or two words of a fuzzy field with equal beginnings."""
    out = []
    for c in data_columns(df):
        v = F.when(~S.is_empty(q(c).cast("string")), S.match_form(q(c).cast("string")))
        if S.field_weight(c) >= 0.85:
            out.append(v)
        elif S.field_weight(c) == 0.6:
            w = F.array_sort(F.transform(F.split(v, " "), lambda x: F.substring(x, 1, 3)))
            out.append(F.when(F.size(w) > 1, F.concat_ws(" ", F.slice(w, 1, 3))).when(v.isNotNull(), F.substring(v, 1, 4)))
    return out


def reasons(columns: Sequence[str], a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """(reason, score) of a pair by rules: phone, mail, id, name, address; 0.40 + 0.25 for each, at most 1."""
    hits = []
    for label, words in (("phone numbers match", ("phone", "mobile", "contact")), ("e-mail addresses match", ("email",)), ("identifiers match", ("id", "sku", "code")), ("names are alike", ("name",)), ("addresses are alike", ("address", "street"))):
        own = [c for c in columns if any(w in _token(c) for w in words) and not (label == "identifiers match" and any(w in _token(c) for w in ("name", "phone")))]
        tests = []
        for c in own:
            x, y = _side(a, c), _side(b, c)
            both = ~S.is_empty(x) & ~S.is_empty(y)
            if "phone" in label:
                dx, dy = (F.right(F.regexp_replace(v, r"\D", ""), F.lit(10)) for v in (x, y))
                tests.append(both & (dx == dy) & (F.length(dx) >= 7))
            elif "alike" in label:
                tests.append(both & (S.string_similarity(S.match_form(x), S.match_form(y)) >= 0.8))
            else:
                tests.append(both & (S.match_form(x) == S.match_form(y)))
        if tests:
            any_ = tests[0]
            for t in tests[1:]:
                any_ = any_ | t
            hits.append(F.when(any_, F.lit(label)))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return F.array_join(found, "; "), F.when(F.size(found) > 0, F.least(F.lit(1.0), 0.40 + 0.25 * F.size(found))).otherwise(0.0)
