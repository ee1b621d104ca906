"""Queries over the core operators, each over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CLEAN_NULLS
from .functions import scalars as S
from .operators import audit as A
from .operators import clean as C
from .operators import extract as X
from .operators import link as L
from .operators import match as M
from .operators import profile as P
from .operators import retrieval as R
from .operators import schema as K
from .operators.entities import CATALOGUE
from .session import table
from .sources import sinks as W

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- SQL pieces
def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _empty(x: str, words) -> str:
    return f"({x} is null or lower({_trim(x)}) in ({_in(words)}))"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _clean(x: str) -> str:
    return f"case when {_trim(x)} <> '' and lower({_trim(x)}) not in ({_in(CLEAN_NULLS)}) then {_trim(x)} end"


def _number(x: str) -> str:
    s = rf"regexp_replace({x}, '[₹$€£¥,\s%]', '', 'g')"
    return rf"case when regexp_matches({s}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({s} as double) end"


def _match(x: str) -> str:
    return _squeeze(rf"regexp_replace(regexp_replace(lower({_trim(x)}), '\.0$', ''), '[,;._-]', ' ', 'g')")


_USER_COLS = ("Name", "Email", "Date of Birth", "Phone", "Salary", "City")
_LONG_USERS = "(" + " union all ".join(f"""select row_id "row", '{c}' "column", "{c}" "value" from sample_users""" for c in _USER_COLS) + ")"
_SALE_COLS = ("transaction_id", "customer_id", "store_id", "product_id", "order_date", "grand_total", "pay_type", "qty")
_LONG_SALES = "(" + " union all ".join(f"""select '{c}' "column", cast({c} as varchar) "value" from retail_transactions""" for c in _SALE_COLS) + ")"


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_users").select(F.col("row_id").alias(C.RID), *[C.q(c) for c in _USER_COLS])


def _sales(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retail_transactions")


def _knowledge(spark: SparkSession, d: str, name: str, record: str = "cleaned_record") -> DataFrame:
    return table(spark, d, f"{name}_knowledge").select(F.col("rec_id").alias(C.RID), f"{record}.*")


# ------------------------------------------------------------------- cleaning
@_query("select row_id _rid, " + ", ".join(f'{_clean(chr(34) + c + chr(34))} "{c}"' for c in _USER_COLS) + " from sample_users")
def b3_clean_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_cells(_users(spark, d))


@_query(f"""
with c as (select *, {_trim('"value"')} t from {_LONG_USERS}),
e as (select "row", "column", "value" original, t cleaned, 'trim' operation, 'outer white space' "rule" from c where "value" <> t
  union all select "row", "column", "value", null, 'null', 'null word' from c where "value" is not null and (t = '' or lower(t) in ({_in(CLEAN_NULLS)})))
select * from e""")
def b4_provenance(spark: SparkSession, d: str) -> DataFrame:
    return C.provenance(_users(spark, d), None)


@_query("with u as (select " + ", ".join(f'{_clean(chr(34) + c + chr(34))} c{i}, "{c}" o{i}' for i, c in enumerate(_USER_COLS)) + """ from sample_users),
m as (select *, """ + " and ".join(rf"coalesce(regexp_matches(o{i}, '\S'), false) = false" for i in range(6)) + """ blank, """ + " and ".join(f"c{i} is null" for i in range(6)) + """ gone from u)
select count(*) initial_rows, (select count(*) from (select distinct """ + ", ".join(f"c{i}" for i in range(6)) + """ from m where not gone)) final_rows,
  sum(gone::int)::bigint empty_rows, (sum((not gone)::int) - (select count(*) from (select distinct """ + ", ".join(f"c{i}" for i in range(6)) + """ from m where not gone)))::bigint duplicates_removed,
  sum(case when blank then 0 else """ + " + ".join(f"(o{i} is not null and c{i} is null)::int" for i in range(6)) + """ end)::bigint nulls_normalized,
  sum(case when blank then 0 else """ + " + ".join(f"coalesce((o{i} <> {_trim(f'o{i}')})::int, 0)" for i in range(6)) + """ end)::bigint cells_trimmed from m""")
def d19_cleaning_metrics(spark: SparkSession, d: str) -> DataFrame:
    return C.cleaning_metrics(_users(spark, d))


@_query("""select transaction_id, customer_id, store_id, product_id, order_date, grand_total, pay_type, qty, sold_at, loaded_at from (
select *, row_number() over (partition by transaction_id order by loaded_at nulls first, customer_id nulls first, store_id nulls first, product_id nulls first, order_date nulls first, grand_total nulls first, pay_type nulls first, qty nulls first, sold_at nulls first) n from retail_transactions) where n = 1""")
def e1_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_first(_sales(spark, d), ["transaction_id"], "loaded_at")


@_query("""select row_id _rid, "Name", "Email", "Date of Birth", "Phone", "Salary", "City" from sample_users u where exists (select 1 from sample_users v where v.row_id < u.row_id
  and v."Name" is not distinct from u."Name" and v."Email" is not distinct from u."Email" and v."Date of Birth" is not distinct from u."Date of Birth" and v."Phone" is not distinct from u."Phone" and v."Salary" is not distinct from u."Salary" and v."City" is not distinct from u."City")""")
def c11_duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(_users(spark, d))


@_query("""select 'store' "collection", store_id, store_name, city, phone, null::varchar product_id, null::varchar product_name, null::varchar category, null::double price from (select unnest(cleaned_record) from store_knowledge)
union all select 'item', null, null, null, null, product_id, product_name, category, price from (select unnest(cleaned_record) from item_knowledge)""")
def h1_union_collections(spark: SparkSession, d: str) -> DataFrame:
    return C.union_collections({n: _knowledge(spark, d, n).drop(C.RID) for n in ("store", "item")}, "collection")


@_query("""select row_id _rid, "Name", "Email", "Date of Birth", "Phone", "Salary", "City" from sample_users where """ + " or ".join(f"""coalesce(contains(lower("{c}"), 'kar'), false)""" for c in _USER_COLS))
def b16_search(spark: SparkSession, d: str) -> DataFrame:
    return C.search_rows(_users(spark, d), "KAR")


@_query("""select row_id _rid, "Name", "Email", "Date of Birth", "Phone", "Salary", "City" from sample_users order by row_id limit 10 offset 20""")
def g5_page(spark: SparkSession, d: str) -> DataFrame:
    return C.page(_users(spark, d), 3)


@_query("select distinct entity_type from customer_knowledge union select distinct entity_type from store_knowledge union select distinct entity_type from item_knowledge")
def h5_distinct_types(spark: SparkSession, d: str) -> DataFrame:
    return C.union_collections({n: table(spark, d, f"{n}_knowledge").select("entity_type") for n in ("customer", "store", "item")}).distinct()


@_query("select store_id, order_date, transaction_id from (select store_id, order_date, transaction_id, row_number() over (partition by store_id order by order_date, transaction_id, loaded_at) n from retail_transactions where order_date is not null) where n <= 3")
def e6_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.first_rows(_sales(spark, d).filter("order_date is not null").select("store_id", "order_date", "transaction_id", "loaded_at"), ["store_id"], ["order_date", "transaction_id", "loaded_at"], 3).drop("loaded_at")


# ------------------------------------------------------------------ profiling
def _profile_sql(long: str) -> str:
    return f"""select "column", count(*) total, sum(e::int)::bigint nulls, count(distinct case when not e then "value" end) distinct_values, round(sum(e::int) * 100.0 / count(*), 2) null_percent
from (select *, {_empty('"value"', S.AUDIT_NULLS)} e from {long}) group by 1"""


@_query(_profile_sql("(" + " union all ".join(f"""select '{c}' "column", cast({c} as varchar) "value" from customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + ")"))
def d1_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.profile(table(spark, d, "customer"))


@_query(_profile_sql(_LONG_USERS))
def d1_profile_users(spark: SparkSession, d: str) -> DataFrame:
    return P.profile(_users(spark, d))


@_query(_profile_sql(_LONG_SALES))
def d1_profile_sales(spark: SparkSession, d: str) -> DataFrame:
    return P.profile(_sales(spark, d), _SALE_COLS)


@_query(f"""select "column", min(x) "min", max(x) "max", round(quantile_cont(x, 0.25), 2) q1, round(quantile_cont(x, 0.5), 2) q2, round(quantile_cont(x, 0.75), 2) q3
from (select "column", {_number('"value"')} x from {_LONG_SALES} where "column" in ('grand_total', 'qty')) where x is not null group by 1""")
def d2_numeric_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.numeric_stats(_sales(spark, d), ["grand_total", "qty"])


@_query("select min(case when length(order_date) >= 8 then order_date end) first_text, max(case when length(order_date) >= 8 then order_date end) last_text from retail_transactions")
def d3_text_range(spark: SparkSession, d: str) -> DataFrame:
    a, b = P.text_range(F.col("order_date"))
    return _sales(spark, d).agg(a.alias("first_text"), b.alias("last_text"))


@_query(f"""select "column", "value", n, "rank" from (select "column", "value", count(*) n, row_number() over (partition by "column" order by count(*) desc, "value") "rank" from {_LONG_SALES}
where "column" in ('pay_type', 'store_id', 'product_id') and not {_empty('"value"', S.AUDIT_NULLS)} group by 1, 2) where "rank" <= 5""")
def d4_top_values(spark: SparkSession, d: str) -> DataFrame:
    return P.top_values(_sales(spark, d), ["pay_type", "store_id", "product_id"])


@_query(f"""select "column", sum((n > 1)::int)::bigint "groups" from (select "column", lower("value") v, count(distinct "value") n from {_LONG_USERS} where "column" in ('Name', 'City') and not {_empty('"value"', S.AUDIT_NULLS)} group by 1, 2) group by 1""")
def d5_inconsistent_case(spark: SparkSession, d: str) -> DataFrame:
    return P.inconsistent_case(_users(spark, d), ["Name", "City"])


@_query("select count(*) \"rows\", count(*) - (select count(*) from (select distinct * from lineitem)) duplicates from lineitem")
def d6_duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_rows(table(spark, d, "lineitem"))


@_query(f"""select round((count(*) - sum({_empty('"value"', S.AUDIT_NULLS)}::int)) * 100.0 / count(*), 2) completeness from {_LONG_USERS}""")
def d7_completeness(spark: SparkSession, d: str) -> DataFrame:
    return P.completeness(_users(spark, d))


@_query()
def d8_inferred_types(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, c, t) for n in ("sample_users", "retail_transactions", "lineitem") for c, t in P.infer_types(table(spark, d, n)).items()]
    return spark.createDataFrame(rows, "table string, column string, type string")


# -------------------------------------------------------------------- auditing
@_query(f"""select "row", "column" from {_LONG_USERS} where {_empty('"value"', S.AUDIT_NULLS)}""")
def d9_missing(spark: SparkSession, d: str) -> DataFrame:
    return A.missing(_users(spark, d))


@_query("with t as (select row_id, " + ", ".join(f'{_trim(chr(34) + c + chr(34))} c{i}' for i, c in enumerate(_USER_COLS)) + """ from sample_users)
select row_id _rid from (select row_id, row_number() over (partition by """ + ", ".join(f"c{i}" for i in range(6)) + " order by row_id) n from t) where n > 1")
def d10_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_issues(_users(spark, d)).select(C.RID)


@_query(f"""select transaction_id || '|' || loaded_at::varchar "row", "column", "value" from (select transaction_id, loaded_at, 'total_amount' "column", grand_total "value" from retail_transactions union all select transaction_id, loaded_at, 'quantity', qty::varchar from retail_transactions)
where not {_empty('"value"', S.AUDIT_NULLS)} and ({_number('"value"')}) is null""")
def d11_wrong_types(spark: SparkSession, d: str) -> DataFrame:
    t = _sales(spark, d).select(F.concat_ws("|", "transaction_id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss")).alias(C.RID), F.col("grand_total").alias("total_amount"), F.col("qty").alias("quantity"), "store_id")
    return A.wrong_types(t)


@_query(rf"""select "row", "column", "value", 'email' issue from {_LONG_USERS} where "column" = 'Email' and not {_empty('"value"', S.AUDIT_NULLS)} and not regexp_matches({_trim('"value"')}, '{A.EMAIL_RULE}')
union all select "row", "column", "value", 'negative_price' from {_LONG_USERS} where "column" = 'Salary' and not {_empty('"value"', S.AUDIT_NULLS)} and ({_number('"value"')}) < 0""")
def d12_invalid_values(spark: SparkSession, d: str) -> DataFrame:
    return A.invalid_values(_users(spark, d))


@_query("""with v as (select event_id, "value" x from events where "value" is not null), p as (select quantile_cont(x, 0.25) a, quantile_cont(x, 0.75) b from v)
select event_id "row", 'value' "column", x, a - 1.5 * (b - a) low, b + 1.5 * (b - a) high from v, p where x < a - 1.5 * (b - a) or x > b + 1.5 * (b - a)""")
def d13_outliers(spark: SparkSession, d: str) -> DataFrame:
    return A.outliers(table(spark, d, "events"), ["value"], "event_id")


def _format_sql() -> str:
    v, t = '"value"', _trim('"value"')
    money = rf"(regexp_matches({t}, '^[₹$€£¥]\s*[0-9,.]+$') or regexp_matches({t}, '^[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?$'))"
    return rf"""select * from (select "row", "column", "value", case when {v} <> {t} then 'white_space' when "column" not in ('Name', 'Email', 'Phone', 'City') and {money} then 'currency' when regexp_matches({t}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}$') then 'slash_date' end issue
from {_LONG_USERS} where not {_empty(v, S.AUDIT_NULLS)}) where issue is not null"""


@_query(_format_sql())
def d14_format_issues(spark: SparkSession, d: str) -> DataFrame:
    return A.format_issues(_users(spark, d))


@_query()
def d17_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_audits([A.audit(_users(spark, d)), A.audit(_knowledge(spark, d, "item"))])


@_query()
def d18_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return A.scorecard(A.audit(_users(spark, d)))


@_query(r"""with l as (select doc_id, unnest(string_split(regexp_replace("text", '\r\n?', chr(10), 'g'), chr(10))) t from documents where "text" is not null),
k as (select doc_id, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) t from l)
select doc_id, count(*)::int "lines", sum((t = '')::int)::int blank_lines, (sum((length(t) > 1)::int) - count(distinct case when length(t) > 1 then t end))::int repeated_lines from k group by 1""")
def d16_text_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_text(table(spark, d, "documents"))


def _check_sql() -> str:
    v = _trim('"value"')
    signed = rf"regexp_replace({v}, '[^0-9.-]', '', 'g')"
    number = rf"case when regexp_matches({signed}, '^-?([0-9]+\.?[0-9]*|\.[0-9]+)$') then try_cast({signed} as double) end"
    digits = rf"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    dated = rf"(regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or regexp_matches({v}, '^[0-9]{{1,4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,4}}'))"
    return rf"""select * from (select "row", "column", "value", case "column" when 'Email' then case when not regexp_matches({v}, '{A.EMAIL_RULE}') then 'email' end
  when 'Date of Birth' then case when not regexp_matches({v}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') and (length({v}) < 4 or not {dated}) then 'date' end
  when 'Phone' then case when {digits} < 7 or {digits} > 15 then 'phone' end when 'Salary' then case when ({number}) < 0 then 'negative_money' end end issue
from {_LONG_USERS} where not {_empty('"value"', (*S.SHORT_NULLS, "-"))}) where issue is not null"""


@_query(_check_sql())
def v1_validate(spark: SparkSession, d: str) -> DataFrame:
    return A.validate(_users(spark, d))


# --------------------------------------------------------------------- scalars
@_query(rf"""select row_id, nullif(lower(regexp_extract("Email", '{S.EMAIL}', 0)), '') email from sample_users""")
def s4_email(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select(F.col(C.RID).alias("row_id"), S.normalize_email(F.col("Email")).alias("email"))


def _phone_sql(x: str) -> str:
    s = rf"regexp_replace({_trim(x)}, '\.0+$', '')"
    g = rf"regexp_replace({s}, '\D', '', 'g')"
    b = f"regexp_replace({g}, '^00', '')"
    return f"""case when (starts_with({s}, '+') or starts_with({s}, '00')) and length({b}) between 8 and 15 then '+' || {b} when length({g}) = 10 then '+91' || {g}
when length({g}) = 11 and starts_with({g}, '0') then '+91' || substr({g}, 2, 10) when length({g}) between 11 and 15 then '+' || {g} end"""


@_query(f"""select row_id, {_phone_sql('"Phone"')} phone from sample_users""")
def s5_phone(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select(F.col(C.RID).alias("row_id"), S.normalize_phone(F.col("Phone")).alias("phone"))


_NUM6 = r"regexp_replace(regexp_replace(grand_total, '(?i)\b(inr|usd|eur|gbp|rs)\b\.?', '', 'g'), '[₹$€£¥,\s]', '', 'g')"


@_query(rf"select transaction_id, grand_total, case when regexp_matches({_NUM6}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then round(try_cast({_NUM6} as double), 4) end amount from retail_transactions")
def s6_number(spark: SparkSession, d: str) -> DataFrame:
    return _sales(spark, d).select("transaction_id", "grand_total", S.normalize_number(F.col("grand_total")).alias("amount"))


def _date_sql(x: str) -> str:
    t = _trim(x)
    iso, dmy = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
    g = lambda p, k: f"try_cast(nullif(regexp_extract({t}, '{p}', {k}), '') as int)"
    made = lambda y, m, dd: f"case when {y} between 1900 and 2100 then strftime(try_cast(({y})::varchar || '-' || ({m})::varchar || '-' || ({dd})::varchar as date), '%Y-%m-%d') end"
    yy = f"case when length(regexp_extract({t}, '{dmy}', 3)) = 2 then {g(dmy, 3)} + case when {g(dmy, 3)} >= 70 then 1900 else 2000 end else {g(dmy, 3)} end"
    word = r"^(\d{1,2})(?:st|nd|rd|th)?[ -]+([A-Za-z]{3})[a-z]*\.?,?[ -]+(\d{4})$"
    front = r"^([A-Za-z]{3})[a-z]*\.?[ -]+(\d{1,2})(?:st|nd|rd|th)?,?[ -]+(\d{4})$"
    mon = lambda p, k: f"nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(regexp_extract({t}, '{p}', {k}))), 0)"
    return f"case when length({t}) >= 4 then coalesce({made(g(iso, 1), g(iso, 2), g(iso, 3))}, {made(g(iso, 1), g(iso, 3), g(iso, 2))}, {made(yy, g(dmy, 2), g(dmy, 1))}, {made(yy, g(dmy, 1), g(dmy, 2))}, {made(g(word, 3), mon(word, 2), g(word, 1))}, {made(g(front, 3), mon(front, 1), g(front, 2))}) end"


@_query(f"""select row_id, {_date_sql('"Date of Birth"')} born from sample_users""")
def s3_date(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select(F.col(C.RID).alias("row_id"), S.parse_date(C.q("Date of Birth")).alias("born"))


@_query(r"""with t as (select transaction_id, order_date, regexp_replace(regexp_replace(order_date, '^\s+|\s+$', '', 'g'), '[T ]\d{1,2}:\d{2}.*$', '') o from retail_transactions) select transaction_id, order_date, """ + _date_sql("o") + " iso from t")
def s12_order_date(spark: SparkSession, d: str) -> DataFrame:
    return _sales(spark, d).select("transaction_id", "order_date", S.standardize_date(F.col("order_date")).alias("iso"))


@_query(rf"""with w as (select row_id, {_squeeze('"Name"')} s from sample_users)
select row_id, case when s <> '' then array_to_string(list_transform(string_split(s, ' '), lambda x: case when contains(x, '''') then array_to_string(list_transform(string_split(x, ''''), lambda y: upper(y[1]) || lower(y[2:])), '''')
 when starts_with(lower(x), 'mc') and length(x) > 2 then 'Mc' || upper(x[3]) || lower(x[4:]) else upper(x[1]) || lower(x[2:]) end), ' ') end full_name from w""")
def s1_name(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).select(F.col(C.RID).alias("row_id"), S.normalize_name(F.col("Name")).alias("full_name"))


@_query(rf"""select rec_id, case when {_empty('c', S.SHORT_NULLS)} then null else array_to_string(list_transform(string_split({_squeeze('c')}, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') end city from (select rec_id, cleaned_record.city c from store_knowledge)""")
def s2_city(spark: SparkSession, d: str) -> DataFrame:
    return _knowledge(spark, d, "store").select(F.col(C.RID).alias("rec_id"), S.normalize_city(F.col("city")).alias("city"))


_ID10 = rf"regexp_replace({_trim('c')}, '\.0+$', '')"


@_query(rf"select rec_id, case when {_empty('c', S.SHORT_NULLS)} then null when regexp_matches({_ID10}, '^[a-zA-Z]+[-\s_]?\d+$') then upper({_ID10}) else {_ID10} end customer_id from (select rec_id, cleaned_record.customer_id c from customer_knowledge)")
def s10_id(spark: SparkSession, d: str) -> DataFrame:
    return _knowledge(spark, d, "customer").select(F.col(C.RID).alias("rec_id"), S.standardize_id(F.col("customer_id")).alias("customer_id"))


@_query(f"select o_orderkey, case when lower({_trim('o_orderstatus')}) in ({_in(S.TRUE_WORDS)}) then 'true' when lower({_trim('o_orderstatus')}) in ({_in(S.FALSE_WORDS)}) then 'false' else o_orderstatus end flag from orders")
def s9_boolean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.standardize_boolean(F.col("o_orderstatus")).alias("flag"))


@_query(rf"""select doc_id, regexp_replace(regexp_replace("text", '\s+([:,.;])', '\1', 'g'), '([0-9A-Za-z_]):([^\s/])', '\1: \2', 'g') fixed from documents where "text" is not null""".replace("rf", ""))
def s16_ocr_blanks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", S.fix_ocr(F.col("text")).alias("fixed"))


@_query(r"""with l as (select doc_id, string_split("text", chr(10)) l from documents where "text" is not null)
select doc_id, array_to_string(list_filter(l, lambda x, i: trim(x) = '' or i = 1 or l[i - 1] <> x), chr(10)) kept from l""")
def s18_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", S.drop_repeated_lines(F.col("text")).alias("kept"))


@_query()
def s19_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return X.clean_texts(table(spark, d, "documents").select("doc_id", "text"))


@_query(f"""with n as (select distinct {_match('p_name')} v from part where p_name is not null)
select a.v x, b.v y, round(1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v)), 6) ratio from n a join n b on a.v < b.v where 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v)) >= 0.75""")
def s22_levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    # names that are 0.75 alike share the beginning or the end of a word
    n = table(spark, d, "part").filter("p_name is not null").select(S.match_form(F.col("p_name")).alias("v")).distinct()
    keys = F.array_distinct(F.flatten(F.transform(F.split("v", " "), lambda w: F.array(F.substring(w, 1, 2), F.right(w, F.lit(2))))))
    k = n.withColumn("k", F.explode(keys))
    pairs = k.alias("a").join(k.alias("b"), F.col("a.k") == F.col("b.k")).filter("a.v < b.v").select(F.col("a.v").alias("x"), F.col("b.v").alias("y")).distinct()
    r = S.levenshtein_ratio(F.col("x"), F.col("y"))
    return pairs.filter(r >= 0.75).withColumn("ratio", F.round(r, 6))


def _similar_sql(a: str, b: str) -> str:
    """S24 of two columns in match form."""
    mark = lambda x: rf"regexp_extract({x}, '(?:^|[^\p{{L}}\p{{N}}_])([a-z]|[0-9]+|[ivx]+)$', 1)"
    words = lambda x: f"list_distinct(string_split({x}, ' '))"
    both = f"len(list_intersect({words(a)}, {words(b)}))"
    jac = f"({both} * 1.0 / greatest(len({words(a)}) + len({words(b)}) - {both}, 1))"
    ratio = f"(1 - levenshtein({a}, {b}) * 1.0 / greatest(length({a}), length({b})))"
    short = f"(least(length({a}), length({b})) * 1.0 / greatest(length({a}), length({b})))"
    behind = lambda x, y: f"(instr({x}, ' ') = 2 and substr({x}, 3) = {y})"
    return f"""case when {a} is null or {b} is null then null when {a} = '' or {b} = '' then 0 when {a} = {b} then 1 when {mark(a)} <> '' and {mark(b)} <> '' and {mark(a)} <> {mark(b)} then 0.2
when {behind(a, b)} or {behind(b, a)} then 0.92 when {ratio} >= 0.75 then {ratio} when {jac} >= 0.7 then least(0.95, 0.7 + 0.25 * {jac}) when (contains({a}, {b}) or contains({b}, {a})) and {short} >= 0.8 then 0.85 else {ratio} end"""


@_query(f"with n as (select rec_id, {_match('original_record.name')} a, {_match('cleaned_record.name')} b from customer_knowledge) select rec_id, round(({_similar_sql('a', 'b')})::double, 6) similarity from n")
def s24_similarity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer_knowledge").select("rec_id", S.match_form(F.col("original_record.name")).alias("a"), S.match_form(F.col("cleaned_record.name")).alias("b"))
    return c.select("rec_id", F.round(S.string_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@_query(rf"select rec_id, regexp_extract(lower({_trim('cleaned_record.name')}), '(?:^|[^\p{{L}}\p{{N}}_])([a-z]|[0-9]+|[ivx]+)$', 1) mark from customer_knowledge")
def s23_suffix_marks(spark: SparkSession, d: str) -> DataFrame:
    return _knowledge(spark, d, "customer").select(F.col(C.RID).alias("rec_id"), S.suffix_mark(F.col("name")).alias("mark"))


@_query(rf"""select city_id, case when length(x) between 1 and 10 then x end postal from (select city_id, regexp_replace(regexp_replace({_trim("postal_prefix || ' 001.0'")}, '\.0+$', ''), '\s+', '', 'g') x from city_list)""")
def s7_postal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "city_list").select("city_id", S.normalize_postal(F.concat("postal_prefix", F.lit(" 001.0"))).alias("postal"))


def _name_sql(s: str) -> str:
    return rf"""case when {s} <> '' then array_to_string(list_transform(string_split({s}, ' '), lambda x: case when contains(x, '''') then array_to_string(list_transform(string_split(x, ''''), lambda y: upper(y[1]) || lower(y[2:])), '''')
 when starts_with(lower(x), 'mc') and length(x) > 2 then 'Mc' || upper(x[3]) || lower(x[4:]) else upper(x[1]) || lower(x[2:]) end), ' ') end"""


@_query(rf"with v as (select city_id, {_squeeze('state_code')} a, {_squeeze('state')} b from city_list) select city_id, case when length(a) = 2 then upper(a) else {_name_sql('a')} end code, case when length(b) = 2 then upper(b) else {_name_sql('b')} end state from v")
def s11_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "city_list").select("city_id", S.standardize_state(F.col("state_code")).alias("code"), S.standardize_state(F.col("state")).alias("state"))


@_query(rf"""select row_id, case when not {_empty('"Name"', S.AUDIT_NULLS)} then row_id::varchar || ' (' || {_trim('"Name"')} || ')' else row_id::varchar end identity from sample_users""")
def s29_row_identity(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "sample_users").select("row_id", "Name", "Email")
    return u.select("row_id", S.row_identity(u.columns).alias("identity"))


@_query(r"select rec_id, regexp_replace(regexp_extract(f, '([^/\\]*)$', 1), '\.[^.]*$', '') base from (select rec_id, '/in/' || metadata.source || '.v' || metadata.file_row || '.csv' f from store_knowledge)")
def s31_base_names(spark: SparkSession, d: str) -> DataFrame:
    f = F.concat(F.lit("/in/"), F.col("metadata.source"), F.lit(".v"), F.col("metadata.file_row").cast("string"), F.lit(".csv"))
    return table(spark, d, "store_knowledge").select("rec_id", S.base_name(f).alias("base"))


_ADDR = "lower(" + _trim("a") + ")"
for _a, _b in S.STREET_WORDS:
    _ADDR = rf"regexp_replace({_ADDR}, '\b{_a}\b', '{_b}', 'g')"


@_query(rf"select rec_id, {_squeeze(rf'''regexp_replace({_ADDR}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')''')} address from (select rec_id, cleaned_record.address a from customer_knowledge)")
def s27_address(spark: SparkSession, d: str) -> DataFrame:
    return _knowledge(spark, d, "customer").select(F.col(C.RID).alias("rec_id"), S.normalize_address(F.col("address")).alias("address"))


def _shown(label: str, col: str) -> str:
    s = _squeeze(rf"regexp_replace({_trim(col)}, '^(\d+)\.0+$', '\1')")
    return f"case when not {_empty(col, S.MATCH_NULLS)} then '{label}: ' || {s} end"


@_query(f"select rec_id, concat_ws(' | ', 'Entity: Store', {_shown('Store Id', 'store_id')}, {_shown('Store Name', 'store_name')}, {_shown('City', 'city')}, {_shown('Phone', 'phone')}) line from (select rec_id, unnest(cleaned_record) from store_knowledge)")
def s30_serialize(spark: SparkSession, d: str) -> DataFrame:
    df = _knowledge(spark, d, "store")
    return df.select(F.col(C.RID).alias("rec_id"), R.serialize(C.data_columns(df), "store").alias("line"))


# --------------------------------------------------------------- schema, classes
@_query()
def k4_classified_tables(spark: SparkSession, d: str) -> DataFrame:
    found = {n: K.classify(table(spark, d, n)) for n in ("sample_users", "retail_transactions", "lineitem")} | {n: K.classify(_knowledge(spark, d, n)) for n in ("customer", "store", "item")}
    return spark.createDataFrame([(n, c.kind, c.confidence) for n, c in found.items()], "table string, kind string, confidence double")


def _domain_sql() -> str:
    pattern = {"car": r"(?i)\b[A-HJ-NPR-Z0-9]{17}\b".replace("(?i)", ""), "medical": r"\b(?:PAT|MRN)-?\d+", "student": r"\bSTU-?\d+", "employee": r"\bEMP-?\d+", "invoice": r"\b(?:INV|BILL)-?\d+", "store": r"\b(?:STR|BRN)-?\d+", "transaction": r"\b(?:TXN|ORD)-?\d+"}
    words = ", ".join(f"({o}, '{n}', ' {k.replace('_', ' ')} ', {w})" for o, (n, e) in enumerate(CATALOGUE.items()) for lv, w in K.DOMAIN_WEIGHTS for k in sorted(getattr(e, lv)))
    ents = ", ".join(f"({o}, '{n}')" for o, n in enumerate(CATALOGUE))
    pat = " ".join(f"when '{n}' then case when regexp_matches(\"text\", '{p}') then {2.0 if n == 'car' else 1.5} else 0 end" for n, p in pattern.items())
    return rf"""with w(o, e, k, p) as (values {words}), n(o, e) as (values {ents}), t as (select doc_id, "text", ' ' || regexp_replace(lower("text"), '[^a-z0-9]+', ' ', 'g') || ' ' s from documents),
h as (select doc_id, w.e, sum(p) p from t join w on contains(t.s, w.k) group by 1, 2),
g as (select t.doc_id, n.o, n.e, round(coalesce(h.p, 0) + case n.e {pat} else 0 end, 4) p from t cross join n left join h on h.doc_id = t.doc_id and h.e = n.e),
b as (select *, row_number() over (partition by doc_id order by p desc nulls last, o) r from g)
select doc_id, case when p >= 1.8 then e else 'unknown' end "domain", case when p >= 1.8 then round(least(0.95, 0.70 + 0.05 * p), 4) else 0.0 end confidence from b where r = 1"""


@_query(_domain_sql())
def k5_text_domains(spark: SparkSession, d: str) -> DataFrame:
    return K.classify_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "domain", "confidence")


@_query("select transaction_id, store_id, product_id item_id, customer_id, order_date purchase_date, qty::varchar quantity, grand_total total_amount, pay_type payment_method, sold_at, loaded_at from retail_transactions")
def b8_canonical_columns(spark: SparkSession, d: str) -> DataFrame:
    return K.to_canonical(_sales(spark, d), CATALOGUE["transaction"])[0]


def _std_sql(col: str, kind: str) -> str:
    ident = rf"case when regexp_matches(regexp_replace({_trim(col)}, '\.0+$', ''), '^[a-zA-Z]+[-\s_]?\d+$') then upper(regexp_replace({_trim(col)}, '\.0+$', '')) else regexp_replace({_trim(col)}, '\.0+$', '') end"
    bare = rf"regexp_replace(regexp_replace({col}, '(?i)\b(inr|usd|eur|gbp|rs)\b\.?', '', 'g'), '[₹$€£¥,\s]', '', 'g')"
    num = rf"case when regexp_matches({bare}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then abs(round(try_cast({bare} as double), 4)) end"
    day = _date_sql(rf"regexp_replace({_trim(col)}, '[T ]\d{{1,2}}:\d{{2}}.*$', '')")
    made = {"id": ident, "numeric": num, "date": f"coalesce({day}, {col})", "name": f"coalesce({_name_sql(_squeeze(col))}, {col})"}[kind]
    return f"case when not {_empty(col, (*S.SHORT_NULLS, '-'))} then {made} end"


@_query("with t as (select *, qty::varchar q from retail_transactions) select " + ", ".join(f"{_std_sql(c, k)} {n}" for c, k, n in (("transaction_id", "id", "transaction_id"), ("store_id", "id", "store_id"), ("product_id", "id", "item_id"), ("customer_id", "id", "customer_id"), ("q", "numeric", "quantity"), ("grand_total", "numeric", "total_amount"), ("order_date", "date", "purchase_date"), ("pay_type", "name", "payment_method"))) + " from t")
def s13_standardized_sales(spark: SparkSession, d: str) -> DataFrame:
    out = K.standardize(K.to_canonical(_sales(spark, d), CATALOGUE["transaction"])[0], CATALOGUE["transaction"])
    return out.select("transaction_id", "store_id", "item_id", "customer_id", *[F.col(c).try_cast("double").alias(c) for c in ("quantity", "total_amount")], "purchase_date", "payment_method")


def _place_sql() -> str:
    t = _trim("a")
    turned = r"^([A-Za-z]{2}),\s*([A-Za-z\s]+)$"
    town = r"(?i)^\d+\s+[A-Za-z0-9.\s]+\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd)\s*"
    trim = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return rf"""with w as (select rec_id, a, {t} s, list_filter(list_transform(string_split({t}, ','), lambda x: {trim('x')}), lambda x: x <> '') p from (select rec_id, cleaned_record.address a from customer_knowledge)),
v as (select rec_id, not {_empty('a', (*S.SHORT_NULLS, '-'))} ok, regexp_matches(s, '{turned}') t, s, p[-1] st, p[-2] c, {trim(f"regexp_replace(p[-2], '{town}', '')")} plain, len(p) n from w)
select rec_id, case when ok and t then {trim(f"regexp_extract(s, '{turned}', 2)")} when ok and n >= 2 then case when plain <> '' then plain else c end end city,
 case when ok and t then upper(regexp_extract(s, '{turned}', 1)) when ok and n >= 2 then case when length(st) = 2 then upper(st) else st end end state from v"""


@_query(_place_sql())
def b11_city_state(spark: SparkSession, d: str) -> DataFrame:
    city, state = K.city_state(F.col("address"))
    return _knowledge(spark, d, "customer").select(F.col(C.RID).alias("rec_id"), city.alias("city"), state.alias("state"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    o, c, i = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem")
    j = i.join(o, i.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias(C.RID), *[x.cast("string").alias(n) for n, x in {"order_id": o.o_orderkey, "purchase_date": F.date_format(o.o_orderdate, "yyyy-MM-dd"), "total_amount": o.o_totalprice, "customer_id": c.c_custkey, "customer_name": c.c_name, "product_id": i.l_partkey, "unit_price": i.l_extendedprice, "store_id": i.l_suppkey, "store_name": F.concat(F.lit("Store "), i.l_suppkey)}.items()])


@_query("select 'customer' entity, count(distinct o_custkey) \"rows\" from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey union all select 'item', count(distinct l_partkey) from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey union all select 'store', count(distinct l_suppkey) from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey union all select 'transaction', count(*) from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def k8_split_mixed(spark: SparkSession, d: str) -> DataFrame:
    df = _mixed(spark, d)
    parts = K.split_mixed(df, K.classify(df.drop(C.RID)))
    out = None
    for n, p in parts.items():
        one = p.agg(F.count("*").alias("rows")).select(F.lit(n).alias("entity"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ extraction
@_query(r"""with l as (select doc_id, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) - 1 n from (select doc_id, regexp_replace("text", '\r\n?', chr(10), 'g') t from documents where "text" is not null)),
p as (select doc_id, n, x, case when instr(x, ':') > 0 then instr(x, ':') else instr(x, '=') end i from l),
k as (select doc_id, n::int line, regexp_replace(lower(regexp_replace(substr(x, 1, i - 1), '^\s+|\s+$', '', 'g')), '\s+', '_', 'g') "key", regexp_replace(substr(x, i + 1), '^\s+|\s+$', '', 'g') "value" from p where i > 1)
select doc_id, line, "key", "value" from k where "key" <> '' and "value" <> ''""")
def b13_key_value_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.key_value_lines(table(spark, d, "documents"))


@_query(r"""select doc_id, lower(regexp_extract("text", '([A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[a-zA-Z]{2,})', 1)) email from documents where regexp_matches("text", '([A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[a-zA-Z]{2,})')""")
def x1_emails(spark: SparkSession, d: str) -> DataFrame:
    e = X.identify_fields(F.col("text"))["email"]
    return table(spark, d, "documents").select("doc_id", F.lower(e).alias("email")).filter("email is not null")


def _x1_sql() -> str:
    t = r"""regexp_replace("text", '\r\n?', chr(10), 'g')"""
    g = lambda p: f"nullif({_trim(f'''regexp_extract(t, '{p}', 1)''')}, '')"
    whole = {n: g(f"(?i){p}") for n, _, p in X.TEXT_PATTERNS}
    line = {n: f"coalesce({g(rf'(?im)^[ \t]*(?:{w})[ \t]*[:=-][ \t]*(.*)$')}, {g(rf'(?im)^[ \t]*(?:{w})[ \t]*[:=-][ \t]*\n\s*(\S[^\n]*)')})" for n, _, w in X.LABELS}
    cols = {"dob": whole["dob"], "date": f"coalesce({whole['date']}, case when {whole['dob']} is null then {g(r'\b(\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4})\b')} end)", "id_number": whole["id_number"], "amount": f"coalesce({line['amount']}, {whole['amount']})", "organization": line["organization"], "address": line["address"], "city": line["city"]}
    return f"""with d as (select doc_id, {t} t from documents where "text" is not null) select doc_id, {", ".join(f'{c} "{n}"' for n, c in cols.items())} from d"""


@_query(_x1_sql())
def x1_fields(spark: SparkSession, d: str) -> DataFrame:
    f = X.identify_fields(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", *[f[n].alias(n) for n in ("dob", "date", "id_number", "amount", "organization", "address", "city")])


@_query()
def x2_fields(spark: SparkSession, d: str) -> DataFrame:
    return X.extract_fields(table(spark, d, "documents"))


@_query()
def x3_records(spark: SparkSession, d: str) -> DataFrame:
    return X.extract_records(table(spark, d, "documents"))


@_query()
def x9_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Customers, items and stores out of the documents of each kind."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("record_key").alias("id"), "text", "entity_type")
    parts = {k: X.extract_hybrid(docs.filter(F.col("entity_type") == k).drop("entity_type"), k) for k in ("customer", "item", "store")}
    return C.union_collections({k: p for k, p in parts.items() if p is not None}, "kind")


# --------------------------------------------------------------------- matching
@_query()
def m4_capped_matches(spark: SparkSession, d: str) -> DataFrame:
    return M.match_table(_users(spark, d), "customer").drop("merged")


@_query()
def m4_blocked_matches(spark: SparkSession, d: str) -> DataFrame:
    u = _users(spark, d)
    mail = F.when(~S.is_empty(F.col("Email")), S.normalize_email(F.col("Email")))
    return M.match_table(u, "customer", None, [mail, F.when(~S.is_empty(F.col("Phone")), S.normalize_phone(F.col("Phone")))]).drop("merged")


@_query("""with recursive p as (select rec_id, cleaned_record.phone p from store_knowledge where not """ + _empty("cleaned_record.phone", S.MATCH_NULLS) + """),
k as (select rec_id, right(g, 10) k from (select rec_id, regexp_replace(coalesce(""" + _phone_sql(_trim("p")) + ", " + _trim("p") + r"""), '\D', '', 'g') g from p) where length(g) >= 7),
e as (select a.rec_id a, b.rec_id b from k a join k b using (k) where a.rec_id <> b.rec_id),
r as (select rec_id v, rec_id g from (select a rec_id from e) union select e.b, r.g from r join e on e.a = r.v)
select v gid, min(g) root from r group by v""")
def m8_phone_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = _knowledge(spark, d, "store").select(C.RID, "phone")
    return L.components(L.key_links(L.global_records([("stores", "store", t)]))).toDF("gid", "root")


@_query()
def m8_entities(spark: SparkSession, d: str) -> DataFrame:
    rec = L.global_records([("stores.csv", "store", _knowledge(spark, d, "store")), ("old_stores.csv", "store", _knowledge(spark, d, "store", "original_record"))])
    return L.resolve_entities(rec)[1]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    s = C.keep_first(_sales(spark, d), ["transaction_id"], "loaded_at").select(F.struct("loaded_at", "transaction_id").alias("rid"), "transaction_id", "customer_id", F.lit(None).cast("string").alias("customer_phone"), "product_id", "store_id")
    named = lambda n, i, c, *more: _knowledge(spark, d, n).select(F.col(C.RID).alias("rid"), F.col(i).alias("id"), F.col(c).alias("name"), *more)
    return L.transaction_edges(s, named("customer", "customer_id", "name", "phone"), named("item", "product_id", "product_name"), named("store", "store_id", "store_name"))


def _edge_sql(select: str) -> str:
    f = lambda x: f"case when not {_empty(x, S.MATCH_NULLS)} then {_trim(x)} end"
    return f"""with s as (select distinct on (transaction_id) transaction_id t, customer_id c, product_id p, store_id s from retail_transactions order by transaction_id, loaded_at, customer_id nulls first, store_id nulls first, product_id nulls first),
u as (select {f('t')} t, {f('c')} c, {f('p')} p, {f('s')} s from s),
e as (select distinct 'customer' relationship, 'transaction' source_type, t source_id, 'customer' target_type, c target_id from u where t is not null and c is not null
 union all select distinct 'product', 'transaction', t, 'product', p from u where t is not null and p is not null union all select distinct 'store', 'transaction', t, 'store', s from u where t is not null and s is not null
 union all select distinct 'purchased', 'customer', c, 'product', p from u where c is not null and p is not null union all select distinct 'purchased_at', 'customer', c, 'store', s from u where c is not null and s is not null
 union all select distinct 'sold', 'store', s, 'product', p from u where s is not null and p is not null) {select}"""


def _named_edge_sql() -> str:
    key = lambda x: f"upper({_match(x)})"
    look = lambda n, t, i, c: f"{n} as (select {key(i)} k, arg_min({{'n': {c}}}, rec_id).n n from (select rec_id, cleaned_record.{i} {i}, cleaned_record.{c} {c} from {t}) where {i} is not null group by 1)"
    method = " ".join(f"when '{e[0]}' then '{e[3]}'" for e in L.EDGES)
    name = lambda side: f"case {side}_type when 'transaction' then 'Order #' || {side}_id else coalesce({side}_c.n, {side}_p.n, {side}_s.n, {side}_id) end"
    joins = " ".join(f"left join {t} {side}_{t[0]} on {side}_type = '{kind}' and {side}_{t[0]}.k = {key(f'{side}_id')}" for side in ("source", "target") for t, kind in (("cn", "customer"), ("pn", "product"), ("sn", "store")))
    looks = ", ".join((look("cn", "customer_knowledge", "customer_id", "name"), look("pn", "item_knowledge", "product_id", "product_name"), look("sn", "store_knowledge", "store_id", "store_name")))
    return _edge_sql(f", {looks} select relationship, source_type, source_id, {name('source')} source_name, target_type, target_id, {name('target')} target_name, case relationship {method} end method from e {joins}")


@_query(_named_edge_sql())
def m9_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select(*L.EDGE_COLUMNS)


@_query(rf"""with c as (select rec_id, cleaned_record.customer_id id, cleaned_record."name" n, right(regexp_replace(cleaned_record.phone, '\D', '', 'g'), 10) t from customer_knowledge),
f as (select t, arg_min({{'id': id, 'n': n}}, rec_id) x from c where length(t) >= 7 group by 1),
s as (select rec_id, right(regexp_replace({_trim('p')}, '\D', '', 'g'), 10) t from (select rec_id, original_record.phone p from customer_knowledge) where not {_empty('p', S.MATCH_NULLS)})
select distinct 'customer' relationship, 'transaction' source_type, rec_id::varchar source_id, 'Order #' || rec_id source_name, 'customer' target_type, f.x.id target_id, coalesce(f.x.n, f.x.id) target_name from s join f using (t) where length(t) >= 7 and f.x.id is not null""")
def c2_phone_edges(spark: SparkSession, d: str) -> DataFrame:
    """Sales that name a phone instead of a customer."""
    none = F.lit(None).cast("string")
    sales = table(spark, d, "customer_knowledge").select(F.col("rec_id").alias("rid"), F.col("rec_id").cast("string").alias("transaction_id"), none.alias("customer_id"), F.col("original_record.phone").alias("customer_phone"), none.alias("product_id"), none.alias("store_id"))
    people = _knowledge(spark, d, "customer").select(F.col(C.RID).alias("rid"), F.col("customer_id").alias("id"), "name", "phone")
    return L.transaction_edges(sales, people).drop("at", "method")


@_query("""select 'sold' relationship, 'store' source_type, s_suppkey::varchar source_id, s_name source_name, 'product' target_type, l_partkey::varchar target_id, min(p_name) target_name
from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 3, 4, 6""")
def c6_foreign_edges(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.struct("l_orderkey", "l_linenumber").alias("rid"), F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("l_suppkey").cast("string").alias("store_id"))
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return L.foreign_edges(items, stores, "sold", "store").drop("at", "method")


@_query(_edge_sql("select * from e where relationship = 'sold' and (contains(lower(source_id), 'str-0000001') or contains(lower(target_id), 'str-0000001'))"))
def b18_filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).withColumn("source_name", F.col("source_id")).withColumn("target_name", F.col("target_id"))
    return L.filter_edges(e, "sold", "high", "sales", "STR-0000001").select(*L.SIGNATURE)


@_query(_edge_sql(", n as (select count(*) c from e) select 'REL-' || case when length(i::varchar) < 4 then lpad(i::varchar, 4, '0') else i::varchar end edge_id from n, unnest(generate_series(1, c)) t(i)"))
def e4_edge_numbers(spark: SparkSession, d: str) -> DataFrame:
    return L.number_edges(_edges(spark, d)).select("edge_id")


@_query(_edge_sql("select source_type || '_' || target_type edge_type, count(*) edges, 0.98 mean_confidence from e group by 1"))
def d20_edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.edge_stats(_edges(spark, d))


@_query(_edge_sql("select count(*) connected from (select source_type, source_id from e union select target_type, target_id from e)"))
def d20_connected_ends(spark: SparkSession, d: str) -> DataFrame:
    return L.connected_ends(_edges(spark, d))


# ----------------------------------------------------------------------- exports
@_query(r"""with l as (select doc_id, unnest(string_split("text", chr(10))) t, generate_subscripts(string_split("text", chr(10)), 1)::int line from documents where "text" is not null)
select doc_id, line, regexp_replace(t, '^\s+|\s+$', '', 'g') content from l where regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''""")
def a20_text_lines(spark: SparkSession, d: str) -> DataFrame:
    return W.text_table(table(spark, d, "documents"))


@_query(f"""select doc_id, email, regexp_matches({_trim('email')}, '{A.EMAIL_RULE}') is_valid from (select doc_id, regexp_extract("text", '([A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+[.][a-zA-Z]{{2,}})', 1) email from documents) where email <> ''""")
def v2_valid_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", X.identify_fields(F.col("text"))["email"].alias("value"), F.lit("email").alias("type")).filter("value is not null")
    return A.validate_fields(e).select("doc_id", F.col("value").alias("email"), "is_valid")


@_query(f"""with e as (select count(*) n from ({_check_sql()})) select count(*) records, (select n from e) errors, round(greatest(0, (count(*) - (select n from e)) * 1.0 / count(*)), 4) score from sample_users""")
def d22_quality_score(spark: SparkSession, d: str) -> DataFrame:
    u = _users(spark, d)
    return u.agg(F.count("*").alias("records")).join(A.validate(u).agg(F.count("*").alias("errors"))).withColumn("score", A.quality_score(F.col("records"), F.col("errors")))


# -------------------------------------------------------------------- retrieval
@_query("""with q as (select vec_id query_id, embedding v from embeddings where vec_id % 100 = 0)
select query_id, id, score, "rank" from (select q.query_id, e.vec_id id, round(list_cosine_similarity(e.embedding::double[], q.v::double[]), 6) score, row_number() over (partition by q.query_id order by round(list_cosine_similarity(e.embedding::double[], q.v::double[]), 6) desc, e.vec_id) "rank" from embeddings e cross join q) where "rank" <= 5 and score >= 0""")
def c10_top_k(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    return R.top_k(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector"), "vec_id", k=5)


@_query()
def r1_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = R.embed_texts(table(spark, d, "store_knowledge"), "rec_id")
    return v.select("rec_id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


@_query()
def r9_mapped_headers(spark: SparkSession, d: str) -> DataFrame:
    return R.map_headers(R.schema_knowledge(spark), ["cust_nm", "mob_no", "E-Mail Addr", "zip_cd"], "customer", k=1)


@_query()
def m6_record_matches(spark: SparkSession, d: str) -> DataFrame:
    """Stored stores that match the stores whose number is divisible by 100."""
    s = _knowledge(spark, d, "store").withColumnRenamed(C.RID, "doc_id")
    columns = ["store_id", "store_name", "city", "phone"]
    stored = s.join(R.embed_texts(s.select("doc_id", R.serialize(columns, "store").alias("text")), "doc_id"), "doc_id").withColumn("entity_type", F.lit("store"))
    asked = s.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return R.record_matches(stored, asked, "store", columns).drop("merged")
