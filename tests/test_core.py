"""Core operators on the fixtures of the survey."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators import audit as A
from siltstone.operators import clean as C
from siltstone.operators import extract as X
from siltstone.operators import link as L
from siltstone.operators import match as M
from siltstone.operators import profile as P
from siltstone.operators import retrieval as R
from siltstone.operators import schema as K
from siltstone.operators.entities import CATALOGUE
from siltstone.plans import pipeline
from siltstone.sources import readers, sinks


def frame(spark, cols, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_rid bigint, " + ", ".join(f"`{c}` string" for c in cols))


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize("f,value,want", [
    (S.normalize_name, "RAVI KUMAR", "Ravi Kumar"), (S.normalize_name, "mcdonald  o'connor", "McDonald O'Connor"), (S.normalize_email, "RAVI@GMAIL.COM", "ravi@gmail.com"), (S.normalize_phone, "+91-98765 43210", "+919876543210"), (S.normalize_phone, "9876543210.0", "+919876543210"), (S.normalize_phone, "123", None),
    (S.normalize_number, "₹10,000", 10000.0), (S.normalize_number, "1d", None), (S.normalize_number, "INR 15,000", 15000.0), (S.parse_date, "12/05/2001", "2001-05-12"), (S.parse_date, "2024-01-05", "2024-01-05"), (S.parse_date, "12/21/1960", "1960-12-21"), (S.parse_date, "30.2.1999", None), (S.parse_date, "1706-01-01", None),
    (S.parse_date, "5 March 2024", "2024-03-05"), (S.parse_date, "Mar 5, 2024", "2024-03-05"), (S.standardize_date, "2024-01-15T10:30:00", "2024-01-15"), (S.standardize_id, "102.0", "102"), (S.standardize_id, "s-001", "S-001"), (S.standardize_boolean, "In Stock", "true"), (S.standardize_boolean, "maybe", "maybe"),
    (S.standardize_state, "fl", "FL"), (S.normalize_postal, "600 001.0", "600001"), (S.normalize_city, "n/a", None), (S.normalize_city, "new  delhi", "New Delhi"), (S.match_form, " A-1_b.0 ", "a 1 b"), (S.normalize_address, "12 Main St., Apt 4", "12 main street apartment 4"),
    (S.dedupe_phrases, "big shop and big shop", "big shop"), (S.fix_ocr, "Name:Ravi ,x", "Name: Ravi,x"), (S.drop_repeated_lines, "a\na\n\n\nb\na", "a\n\n\nb\na"), (S.normalize_lines, " a  b \r\n\r\n\r\nc ", "a b\n\nc"), (S.remove_control, "He​llo\x00", "Hello"), (S.base_name, "/x/y.tar.csv", "y.tar"),
    (S.plain_number, "$1,234.5", 1234.5), (S.suffix_mark, "Shop II", "ii"), (S.suffix_mark, "Kumar", ""),
])
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want
    assert one(spark, f, None) is None or f in (S.standardize_boolean,)


def test_dayfirst_flag(spark):
    assert one(spark, lambda c: S.parse_date(c, True), "2024-01-05") == "2024-05-01" and one(spark, lambda c: S.parse_date(c, True), "2024-01-15") == "2024-01-15"


@pytest.mark.parametrize("a,b,want", [("x", "x", 1.0), ("shop 1", "shop 2", 0.2), ("r kumar", "ravi kumar", 0.7), ("s kiruthikeyan", "kiruthikeyan", 0.92), ("smith", "j smith", 0.92), ("ravi kumar", "ravi kumaf", 0.9), ("store a", "store b", 0.2), ("mart xi", "mart v", 0.2), ("", "x", 0.0)])
def test_similarity(spark, a, b, want):
    assert one(spark, S.string_similarity, a, b) == pytest.approx(want)


def test_weights():
    assert (S.field_weight("customer_id"), S.field_weight("City"), S.field_weight("paid"), S.field_weight("colour")) == (1.0, 0.3, 1.0, 0.5)


def test_cleaning(spark):
    df = frame(spark, ["a", " b "], [(" x ", "1"), ("x", "1"), ("N/A", "missing"), (None, " "), ("y", "-5")])
    out = C.clean_table(df)
    assert sorted(map(tuple, out.select("a", "b").collect())) == [("x", "1"), ("y", "-5")]
    m = C.cleaning_metrics(df).first().asDict()
    assert m == {"initial_rows": 5, "final_rows": 2, "empty_rows": 2, "duplicates_removed": 1, "nulls_normalized": 2, "cells_trimmed": 1}
    assert [r.operation for r in C.provenance(df).collect()] == ["trim", "null", "null", "trim", "null"]
    assert C.clean_headers(["a", " a ", "", None and "", "b  c"]) == ["a", "a_1", "Column", "None", "b c"]
    assert C.clean_table(df.limit(0)).count() == 0


def test_profile(spark):
    df = frame(spark, ["age", "amount"], [("30", "100"), ("n/a", "500"), ("40", "₹300"), ("41", "200.5")])
    assert {r["column"]: (r.nulls, r.null_percent) for r in P.profile(df).collect()} == {"age": (1, 25.0), "amount": (0, 0.0)}
    r = P.numeric_stats(df, ["amount"]).first()
    assert (r["min"], r["max"], r.q2) == (100.0, 500.0, 250.25)
    assert P.infer_types(df.withColumn("user_id", F.lit("1"))) == {"age": "integer", "amount": "float", "user_id": "identifier"}


def test_audit(spark):
    df = frame(spark, ["product_id", "price", "stock", "email", "age"], [(str(i), str(100 + i), "5", "a@b.co", "30") for i in range(8)] + [("9", "9999", "-50", "bad", "200"), ("10", "abc", "1", None, "5")])
    assert [r.x for r in A.outliers(df).filter("column = 'price'").collect()] == [9999.0]
    assert sorted(r.issue for r in A.invalid_values(df).collect()) == ["age", "email", "negative_stock"]
    assert [r.value for r in A.wrong_types(df).collect()] == ["abc"]
    a = {r.dimension: r.issues for r in A.audit(df).collect()}
    assert a["missing"] == 1 and a["wrong_types"] == 1 and len(a) == 7
    s = A.scorecard(A.audit(df)).collect()
    assert len(s) == 12 and {r.status for r in s} == {"Passed", "Review"}
    assert {r.issue for r in A.validate(df).collect()} == {"email", "negative_stock"}
    assert A.merge_audits([A.audit(df), A.audit(df)]).filter("dimension = 'missing'").first().issues == 2


@pytest.mark.parametrize("kind,cols,rows", [
    ("store", ["store_id", "store_name", "city", "state", "store_manager"], [("S1", "Main", "Miami", "FL", "Ann")]), ("item", ["product_id", "product_name", "sku", "category", "unit_price", "stock"], [("P1", "Pen", "K1", "Toys", "5", "7")]),
    ("customer", ["customer_id", "customer_name", "customer_email", "phone", "city"], [("C1", "Ravi", "r@x.co", "9876543210", "Pune")]), ("transaction", ["order_id", "purchase_date", "quantity", "total_amount", "payment_method"], [("O1", "2024-01-02", "2", "50", "Cash")]),
    ("mixed", ["store_id", "store_name", "city", "product_id", "product_name", "unit_price", "customer_id", "customer_name", "customer_email", "purchase_date", "quantity", "total_amount"], [("S1", "M", "X", "P1", "Pen", "5", "C1", "R", "r@x.co", "2024-01-02", "1", "5")]), ("unknown", ["foo", "bar"], [("1a", "2b")]),
])
def test_classification(spark, kind, cols, rows):
    found = K.classify(frame(spark, cols, rows))
    assert found.kind == kind and (kind == "unknown" or found.confidence >= (0.2 if kind == "mixed" else 0.3))


def test_mapping_and_split(spark):
    df = frame(spark, ["cust_id", "first_name", "last_name", "mail", "mobile", "signup_date"], [("c001", "RAVI", "kumar", "R@X.CO", "98765 43210", "25/12/1990")])
    out = K.standardize(K.to_canonical(df, CATALOGUE["customer"])[0], CATALOGUE["customer"]).first().asDict()
    assert out == {"_rid": 0, "customer_id": "C001", "full_name": "Ravi Kumar", "email": "r@x.co", "phone": "+919876543210", "registered_on": "1990-12-25"}
    two = frame(spark, ["store_id", "name", "zip", "postal_code"], [("1", "A", "600001", None), ("2", "B", None, "400001")])
    assert [r.postal_code for r in K.to_canonical(two, CATALOGUE["store"])[0].orderBy("_rid").collect()] == ["600001", "400001"]
    mixed = frame(spark, ["store_id", "store_name", "city", "product_id", "product_name", "unit_price", "customer_id", "customer_name", "customer_email", "purchase_date", "quantity", "total_amount"], [("S1", "M", "X", "P1", "Pen", "5", "C1", "R", "r@x.co", "2024-01-02", "1", "5"), ("S1", "M", "X", "P2", "Cup", "5", "C1", "R", "r@x.co", "2024-01-03", "1", "5")])
    parts = K.split_mixed(mixed, K.classify(mixed))
    assert {n: p.count() for n, p in parts.items()} == {"store": 1, "item": 2, "customer": 1, "transaction": 2}
    a, b = K.city_state(F.col("c"))
    rows = spark.createDataFrame([("704 Main St, Miami, fl",), ("CO, Denver",), ("x",)], "c string").select(a, b).collect()
    assert [tuple(r) for r in rows] == [("Miami", "FL"), ("Denver", "CO"), (None, None)]


def test_extraction(spark):
    text = "Name: Ravi Kumar\nDate of Birth: 12/05/2001\nEmail: RAVI@GMAIL.COM\nPhone: +91 98765-43210\nTotal Amount: INR 15,000"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "1. Name: A B\nEmail: a@b.co\n2. Name: C D\nEmail: c@d.co")], "doc_id bigint, text string")
    f = {r.key: r.value for r in X.extract_fields(docs.filter("doc_id = 1")).collect()}
    assert f["name"] == "Ravi Kumar" and f["dob"] == "2001-05-12" and f["email"] == "ravi@gmail.com" and f["phone"] == "+919876543210" and f["amount"] == "15000"
    assert sorted(r.email for r in X.extract_records(docs).collect()) == ["a@b.co", "c@d.co"]
    assert ("date_of_birth", "12/05/2001") in {(r.key, r.value) for r in X.key_value_lines(docs).collect()}
    assert {r.doc_id: r.repeated_lines for r in A.audit_text(spark.createDataFrame([(1, "Ab\nab\nx\nx\n\n")], "doc_id bigint, text string")).collect()} == {1: 1}
    assert X.clean_texts(spark.createDataFrame([(1, "Ｈｅｌｌｏ​ “x”\r\n\r\n\r\nb\nb")], "doc_id bigint, text string")).first().text == 'Hello "x"\n\nb'


def test_hybrid(spark):
    rows = [("C101", "Customer C101: Ravi Kumar from Chennai, phone 9876543210. Is a prime member."), ("C102", "Customer C109: Asha Rao from Pune, phone 123456. Has 4 orders so far. Pays by UPI.")]
    out = X.extract_hybrid(spark.createDataFrame(rows, "id string, text string")).collect()
    assert out[0].customer_name == "Ravi Kumar" and out[0].city == "Chennai" and out[0].phone == "9876543210" and out[0].membership_status == "Prime"
    assert out[1].buying_preferences == "Has 4 orders so far" and len(out[1].warnings) == 2 and out[0].raw_text.startswith("Customer C101")
    item = X.extract_hybrid(spark.createDataFrame([("I201", "product=Steel Kettle | price=-1499 | mrp=2662 | seller S140")], "id string, text string"), "item").first()
    assert (item.price, item.mrp, item.seller_id, item.product_name) == (-1499.0, 2662.0, "S140", "Steel Kettle")
    assert X.extract_hybrid(frame(spark, ["a"], [("1",)])) is None


def test_matching(spark):
    df = frame(spark, ["customer_id", "name", "phone", "city"], [("1", "Ravi Kumar", "98", "Pune"), (None, "R Kumar", "98", None), ("2", "Asha", None, "Pune")])
    got = M.match_table(df, "customer").collect()
    assert [(r.i, r.j, r.status, sorted(r.matched)) for r in got] == [(0, 1, "high_confidence", ["name", "phone"])] and got[0].confidence == 0.88
    assert sorted(got[0].filled) == ["city", "customer_id"] and got[0].merged.city == "Pune"
    assert [(r.i, r.j) for r in M.match_table(df, "customer", None).collect()] == [(0, 1)]
    assert M.first_pairs(frame(spark, ["a"], [(str(i),) for i in range(6)]), 7).count() == 7
    assert M.match_table(df.limit(0), "customer").count() == 0
    m = frame(spark, ["id", "phone", "name"], [("1", "9876543210", "Al"), ("1", "9876543210", "Al")])
    p = M.first_pairs(m)
    assert p.select(M.reasons(["id", "phone", "name"])[1]).first()[0] == 1.0


def test_linking(spark):
    cust = frame(spark, ["customer_id", "customer_name", "phone", "store_id"], [("C-1", "Ravi", "+91 98765 43210", "S1"), ("C2", "Asha", None, None)])
    txn = frame(spark, ["transaction_id", "customer_id", "store_id", "product_id"], [("T1", "C-1", "S1", "P1"), ("T2", None, "S9", "P1"), ("T1", "C-1", "S1", "P1")])
    item = frame(spark, ["product_id", "product_name"], [("P1", "Pen")])
    store = frame(spark, ["store_id", "store_name"], [("S1", "Main")])
    b = pipeline.link_tables([("c.csv", "customer", cust), ("t.csv", "transaction", txn), ("i.csv", "item", item), ("s.csv", "store", store)])
    rel = sorted((r.relationship, r.source_id, r.target_name) for r in b.edges.collect())
    assert ("registered_at", "C-1", "Main") in rel and ("customer", "T1", "Ravi") in rel and ("store", "T2", "S9") in rel and len(rel) == 10
    assert sum(r.edges for r in b.stats.collect()) == 10
    ids = [r.edge_id for r in L.number_edges(b.edges.filter("relationship <> 'registered_at'").select("at", *L.EDGE_COLUMNS)).orderBy("edge_id").collect()]
    assert ids == [f"REL-{i:04d}" for i in range(1, 10)]
    assert L.filter_edges(b.edges, "sold", "high", "sales").count() == 2
    other = frame(spark, ["customer_id", "customer_name", "phone"], [("9", "Ravi K", "09876543210")])
    c = pipeline.link_tables([("c.csv", "customer", cust), ("d.csv", "customer", other)]).clusters.collect()
    assert len(c) == 1 and c[0].records_count == 2 and c[0].match_id == "CUSTOMER-ENTITY-001" and c[0].files_involved == ["c.csv", "d.csv"]


def test_retrieval(spark):
    v = R.embed("Customer Ravi 9876543210")
    assert np.linalg.norm(v) == pytest.approx(1) and not R.embed("  ").any()
    cust = spark.createDataFrame([("C1", "Ravi Kumar", "9876543210"), ("C2", "Asha Rao", "7000000001")], "customer_id string, name string, phone string")
    col = R.ingest(cust, "customer").cache()
    assert R.search_records(col, {"name": "Ravi Kumar"}, "customer", k=1).first().id == "C1"
    assert R.search_records(col, {"name": "Ravi Kumar"}, "customer", k=2, least=0.0, exclude="C1").first().id == "C2"
    assert R.upsert(col, col.limit(1)).count() == 2
    best = {r.header: r.canonical_field for r in R.map_headers(R.schema_knowledge(spark), ["cust_nm", "mob_no"], "customer", k=1).collect()}
    assert best == {"cust_nm": "name", "mob_no": "phone"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Email\n Ravi ,r@x.co\nRavi,r@x.co\n\nNA,"q,1"\n')
    rows = C.clean_table(readers.read_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert sorted((r.Name or "", r.Email) for r in rows) == [("", "q,1"), ("Ravi", "r@x.co")]
    (tmp_path / "m.json").write_text(json.dumps({"stores": [{"store_id": "S1", "at": {"city": "Pune"}}], "items": [{"sku": "K", "tags": ["a"]}], "summary": [{"n": 1}]}))
    got = readers.read_json(spark, str(tmp_path / "m.json"))
    assert set(got) == {"stores", "items"} and got["stores"].first().at_city == "Pune" and got["items"].first().tags == '["a"]'
    book = sinks.excel_export({"One": frame(spark, ["a"], [("1",), ("<&>",)]), "Two": frame(spark, ["b"], [("x",)])})
    (tmp_path / "b.xlsx").write_bytes(book)
    sheets = readers.read_excel(spark, str(tmp_path / "b.xlsx"))
    assert [r.a for r in sheets["One"].orderBy("_rid").collect()] == ["1", "<&>"] and set(sheets) == {"One", "Two"}
    buf = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    d = tmp_path / "docs"
    d.mkdir()
    (d / "x.docx").write_bytes(buf.getvalue())
    (d / "y.eml").write_text("From: a@b.co\nSubject: S\nContent-Type: text/html\n\n<b>Body</b>")
    (d / "z.txt").write_bytes("é".encode("latin-1"))
    (d / "p.pdf").write_bytes(b"%PDF-1.4")
    (d / "empty.txt").write_bytes(b"")
    t = {r.path.rsplit("/", 1)[1]: r.text for r in readers.extract_text(readers.scan_files(spark, str(d))).collect()}
    assert t["x.docx"] == "Hi\na | b" and "Body" in t["y.eml"] and t["z.txt"] == "é" and t["p.pdf"] is None and "empty.txt" not in t
    r = pipeline.process_file(spark, str(tmp_path / "a.csv"))
    assert r.status == "completed" and r.reports["audit"].count() == 7
    assert pipeline.process_file(spark, str(tmp_path / "none.csv")).status == "failed"
    sinks.write_csv(frame(spark, ["a"], [("1",)]), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().a == "1"


def test_streaming(spark, tmp_path):
    from siltstone.streaming import rows

    spark.createDataFrame([(1, " a ", "2024-01-01 00:00:10"), (1, "a", "2024-01-01 00:01:00"), (2, "N/A", "2024-01-01 00:06:00")], "k int, v string, t string").selectExpr("k", "v", "cast(t as timestamp) t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string, t timestamp").parquet(str(tmp_path / "in"))
    got = []
    q = rows.each_batch(rows.dedupe_stream(rows.clean_stream(stream, ["v"]), ["k"], "t"), lambda df, _: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted((r.k, r.v) for r in got) == [(1, "a")]


def test_narratives_of_stores_and_items(spark):
    t = "Star Mart (store id S102) - Coimbatore. Owner phone 98765. Ships within 3 days. Ships from own warehouse. Gives GST invoice. 4.5 star seller rating."
    st = X.extract_hybrid(spark.createDataFrame([("S102", t)], "id string, text string"), "store").first()
    assert (st.store_name, st.city, st.owner_phone, st.delivery_policy, st.notes) == ("Star Mart", "Coimbatore", "98765", "Ships within 3 days; Ships from own warehouse", "4.5 star seller rating; Gives GST invoice")
    assert st.warnings == ["phone 98765"]
    t = "Board game - Rs 915. Best seller this month. Only 3 left in stock. Delivery in 2-4 days. Available in 5 colours. Good toys."
    it = X.extract_hybrid(spark.createDataFrame([("I1", t)], "id string, text string"), "item").first()
    assert (it.product_name, it.price, it.category, it.stock_information, it.delivery_information, it.description) == ("Board game", 915.0, "Toys", "Only 3 left in stock", "Delivery in 2-4 days", "Best seller this month; Available in 5 colours")
    t = "cust=Hari Pillai | id=C304 | ph=98765 4321x | note: likes tea and likes tea | saves items in wishlist, cash on delivery, upi, gold member"
    cu = X.extract_hybrid(spark.createDataFrame([(None, t)], "id string, text string"), "customer").first()
    assert (cu.customer_id, cu.customer_name, cu.phone, cu.payment_preference, cu.membership_status) == ("C304", "Hari Pillai", "98765 4321x", "Cash on Delivery, UPI", "Gold") and cu.warnings == ["phone 98765 4321x"]


def test_fields_without_labels(spark):
    docs = spark.createDataFrame([(1, "Meeting held on 12/03/2024"), (2, "Address:\n12 Main St, PIN 600001\nCity:\r\n\r\nPune"), (3, "DOB: 01/02/1990\nsee 12/03/2024")], "doc_id bigint, text string")
    got = {(r.doc_id, r.key): r.raw_value for r in X.extract_fields(docs).collect()}
    assert got[(1, "date")] == "12/03/2024" and got[(2, "address")] == "12 Main St, PIN 600001" and got[(2, "postal_code")] == "600001" and got[(2, "city")] == "Pune" and (3, "date") not in got


def test_csv_keeps_quoted_line_breaks_and_counts_bad_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,note,note\n1,"x\ny",a\n2,short\n3,p,q,too many\n\n4,"say ""hi""",z\n', encoding="utf-8")
    good, bad = readers.csv_rows(spark, str(tmp_path / "q.csv"))
    assert good.columns == [C.RID, "id", "note", "note_1"] or set(good.columns) == {C.RID, "id", "note", "note_1"}
    assert sorted((r.id, r.note, r.note_1) for r in good.collect()) == [("1", "x\ny", "a"), ("2", "short", None), ("4", 'say "hi"', "z")] and bad.count() == 1
    (tmp_path / "l.csv").write_bytes("id,town\n1,Köln\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "l.csv")).first().town == "Köln"


def test_repeated_headers(spark):
    assert C.clean_table(spark.createDataFrame([(1, "a", "b", "c")], f"{C.RID} long, x string, y string, z string").toDF(C.RID, "n", " n", "m")).columns == [C.RID, "n", "n_1", "m"]


def test_record_matches_and_stored_collections(spark, tmp_path):
    cols = ["store_id", "store_name", "city", "phone"]
    df = spark.createDataFrame([("S1", "Star Mart", "Pune", "9876543210"), ("S2", "Moon Shop", "Delhi", "9123456780")], ", ".join(f"{c} string" for c in cols))
    stored = R.ingest(df, "store").join(df.withColumnRenamed("store_id", "doc_id"), "doc_id").withColumn("store_id", F.col("doc_id"))
    R.save_collection(stored, str(tmp_path / "c"))
    back = R.load_collection(spark, str(tmp_path / "c"), "store")
    asked = spark.createDataFrame([("q", None, "Star Mart", "Pune", "9876543210"), ("r", "S9", "Star Mart", "Pune", "9876543210")], "query_id string, " + ", ".join(f"{c} string" for c in cols))
    got = R.record_matches(back, asked, "store", cols, least=0.1).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [("q", "S1", 1)] and got[0].confidence >= 0.95 and got[0].filled == ["store_id"]
    R.clear_collection(spark, str(tmp_path / "c"), "store")
    assert not list((tmp_path / "c").glob("entity_type=*"))
    known = R.schema_knowledge(spark)
    best = R.map_header_batch(known, ["cust_nm", "mob_no"], "customer")
    assert best["cust_nm"][0] == "name" and best["mob_no"][0] == "phone" and all(x >= 0.3 for _, x in best.values())


def test_audit_reports(spark):
    df = frame(spark, ["name", "price"], [("Al", "-1"), (None, "x"), ("Al", "-1")])
    issues = A.invalid_values(df)
    assert A.filter_issues(issues, "PRICE").count() == 2 and A.filter_issues(issues, text="negative").count() == 2 and A.filter_issues(issues, "name").count() == 0
    r = A.coverage(df, ["name", "price", "stock"]).first()
    assert (r.expected, r.present, r.filled, r.coverage) == (3, 2, 2, 0.6667) and A.coverage(df.limit(0), ["zip"]).first().coverage == 0
    raw = frame(spark, ["name", "phone", "city", "price"], [(" Ravi Kumar", "9876543210", None, "n/a"), ("Ravi Kumar", "9876543210", "Pune", "4"), ("Ravi Kumar", "9876543210", "Pune", "4")])
    out = pipeline.process_table(raw, "t.csv", pipeline.Hooks(explain=lambda d: d.select("name")))
    card = {x.fundamental: (x.issues, x.actions, x.status) for x in out.reports["scorecard"].collect()}
    assert card["Record matching"][0] == 1 and card["Missing values"] == (2, 1, "Review") and card["Duplicates"] == (0, 1, "Passed") and "explained" in out.reports


def test_phone_edges_and_cluster_numbers(spark):
    sales = spark.createDataFrame([(1, "T1", None, "+91 98765 43210", None, None), (2, "T2", None, "12", None, None)], "rid long, transaction_id string, customer_id string, customer_phone string, product_id string, store_id string")
    people = spark.createDataFrame([(1, "C1", "Ravi", "9876543210")], "rid long, id string, name string, phone string")
    assert [(e.source_id, e.target_id, e.target_name) for e in L.transaction_edges(sales, people).collect()] == [("T1", "C1", "Ravi")]
    rows = spark.createDataFrame([(i * 7,) for i in range(50)], "root long").repartition(5)
    assert [(r.root, r.n) for r in L.numbered_rows(rows, "root").orderBy("n").collect()] == [(i * 7, i + 1) for i in range(50)] and L.numbered_rows(rows.limit(0), "root").count() == 0


def test_name_links_grow_with_the_rows(spark):
    rows = [(k * 100 + i, "store", f"{k}.csv", "old town mart" if i % 2 else "old town marts", f"c{i}" if i else None) for k in (1, 2) for i in range(20)]
    df = spark.createDataFrame([(g, d, f, {"name": n} | ({"city": c} if c else {})) for g, d, f, n, c in rows], "gid bigint, domain string, filename string, descriptive map<string,string>")
    links = {(r.a, r.b) for r in L.name_links(df).collect()}
    assert 39 <= len(links) <= 80  # all 400 pairs before
    root = {r[0]: r[0] for r in rows}
    for _ in range(40):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root.values()) == {100}
