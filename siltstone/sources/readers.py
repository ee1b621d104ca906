"""Readers: files to tables of text cells with a source order, or to texts."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import CSV_NULLS, trimmed
from ..operators.clean import RID, clean_headers, q
from ..operators.link import flatten

# --- fixed values ---------------------------------------------------------
EXTENSIONS = {"csv": "csv", "tsv": "csv", "xlsx": "excel", "xls": "excel", "json": "json", "pdf": "pdf", "txt": "txt", "text": "txt", "md": "txt", "log": "txt", "docx": "docx", "doc": "docx", "eml": "email", "msg": "email", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "bmp": "image", "tiff": "image"}
MIME = (("csv", "csv"), ("excel", "excel"), ("spreadsheet", "excel"), ("json", "json"), ("pdf", "pdf"), ("word", "docx"), ("rfc822", "email"), ("image", "image"), ("text", "txt"))
STRUCTURED = ("csv", "excel", "json")
SUMMARY_KEYS = frozenset("summary metadata meta pagination page pages total totals count status info report statistics stats links version".split())
MAX_BYTES = 50 * 1024 * 1024
# --------------------------------------------------------------------------


def file_type(path: Column, content: Column, mime: Column | None = None) -> Column:
    """A1: by first bytes, then extension, then MIME type; else text."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    head = F.hex(F.substring(content, 1, 12))
    by_ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    by_ext = F.try_element_at(by_ext, ext)
    out = F.when(head.startswith("25504446"), "pdf").when(head.startswith("FFD8FF") | head.startswith("89504E47"), "image").when(head.startswith("52494646") & head.endswith("57454250"), "image")
    out = out.when(head.startswith("504B0304") & ext.isin("xlsx", "xlsm"), "excel").when(head.startswith("504B0304") & (ext == "docx"), "docx").when(by_ext.isNotNull(), by_ext)
    for word, kind in MIME if mime is not None else ():
        out = out.when(F.lower(mime).contains(word), kind)
    return out.otherwise("txt")


def data_type(kind: Column) -> Column:
    """A2"""
    return F.when(kind.isin(*STRUCTURED), "structured").otherwise("unstructured")


def scan_files(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """(path, content, length, file_type, data_type) of files that have a name, content and at most ``most`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ok = files.filter((F.col("length") > 0) & (F.col("length") <= most) & (F.regexp_extract("path", r"[^/\\]+$", 0) != ""))
    typed = ok.withColumn("file_type", file_type(F.col("path"), F.col("content")))
    return typed.withColumn("data_type", data_type(F.col("file_type")))


def with_rid(df: DataFrame) -> DataFrame:
    """Source order: partition and place in it, as the reader delivers them."""
    return df.withColumn(RID, F.monotonically_increasing_id())


def drop_csv_nulls(df: DataFrame) -> DataFrame:
    """Texts that CSV readers of the pandas family take for missing; not counted as cleaning."""
    return df.withColumns({f.name: F.when(~q(f.name).isin(*CSV_NULLS), q(f.name)) for f in df.schema.fields if f.dataType == T.StringType()})


def csv_rows(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A3: (rows, lines with more fields than the header) of a CSV file or folder, all cells as text.

    One pass over the lines decides how the file is to be read: as Latin-1 if its bytes are no UTF-8, and whole instead of in
    splits if a line holds an odd number of quotes, as a quoted cell then may run over a line end. Short lines are filled with nulls.
    """
    lines = spark.read.text(path).select("value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    look = lines.agg(F.max(F.col("quotes") % 2).alias("open"), F.max(~F.is_valid_utf8("value")).alias("foreign")).first()
    encoding = encoding or ("ISO-8859-1" if look.foreign else "UTF-8")
    options = {"sep": sep, "encoding": encoding, "escape": '"', "multiLine": bool(look.open), "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": False}
    head = spark.read.csv(path, header=False, inferSchema=False, **options).limit(1).collect()
    names = clean_headers([("" if c is None else c).lstrip("\ufeff") for c in head[0]]) if head else []
    extra = "_extra_field"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, extra]])
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE", **options)
    return with_rid(drop_csv_nulls(raw.filter(q(extra).isNull()).drop(extra))), raw.filter(q(extra).isNotNull())


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """A3: the rows of :func:`csv_rows`; lines with too many fields are left out, as the second frame there shows them."""
    return csv_rows(spark, path, sep, encoding)[0]


def read_json(spark: SparkSession, path: str) -> DataFrame | dict[str, DataFrame]:
    """An array of objects as one flat table; an object with several lists as a table each, summaries left out.

    Files of one object are read whole, one a task; arrays of lines are split as Spark does.
    """
    df = spark.read.option("multiLine", "true").json(path)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and not is_summary(f.name)]
    if not lists:
        return with_rid(_text(flatten(df)))
    tables = {n: with_rid(_text(flatten(df.select(F.explode(q(n)).alias("x")).select("x.*")))) for n in lists}
    objects = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType) and not is_summary(f.name)]
    if len(lists) + len(objects) > 1:
        tables |= {n: with_rid(_text(flatten(df.select(f"`{n}`.*")))) for n in objects}
    return tables if len(tables) > 1 else tables[lists[0]]


def _text(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(q(f.name)) if isinstance(f.dataType, nested) else q(f.name).cast("string")).alias(f.name) for f in df.schema.fields])


def is_summary(key: str) -> bool:
    """Summary, meta and paging keys of an object."""
    k = key.lower().strip()
    return k in SUMMARY_KEYS or any(k.startswith(f"{w}_") or k.endswith(f"_{w}") for w in SUMMARY_KEYS)


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def docx_text(data: bytes) -> str:
    """A10: paragraphs that are not empty, then table rows with cells joined by " | "."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = [t for p in (body if body is not None else []) if p.tag == f"{w}p" and (t := text(p).strip())]
    for row in body.iter(f"{w}tr") if body is not None else ():
        cells = [text(c).strip() for c in row.findall(f"{w}tc")]
        if any(cells):
            out.append(" | ".join(cells))
    return "\n".join(out)


def email_text(data: bytes) -> str:
    """From, To, Subject and Date, then the first plain part, else the HTML without tags; attachments are skipped."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{h}: {m[h]}" for h in ("From", "To", "Subject", "Date") if m[h]]
    parts = [p for p in m.walk() if not p.is_multipart() and p.get_content_disposition() != "attachment"]
    plain = next((p for p in parts if p.get_content_type() == "text/plain"), None)
    html = next((p for p in parts if p.get_content_type() == "text/html"), None)
    body = ""
    if plain is not None:
        body = plain.get_content()
    elif html is not None:
        body = re.sub(r"<[^>]+>", " ", html.get_content())
    return "\n".join([*head, "", body.strip()]) if head else body.strip()


#: Readers of other kinds, by file type: ``bytes -> text``. PDF and images have no library here; add one to read them.
PLUGINS: dict[str, object] = {"docx": docx_text, "email": email_text}


def extract_text(files: DataFrame) -> DataFrame:
    """(path, file_type, text, method, confidence) of each file of ``scan_files``; a file that can't be read has no text."""
    readers = dict(PLUGINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, kind, plain in zip(b.column("content").to_pylist(), b.column("file_type").to_pylist(), b.column("plain").to_pylist()):
                if kind in readers:
                    try:
                        out.append((readers[kind](data), kind, 1.0))
                    except Exception as e:
                        out.append((None, f"failed: {type(e).__name__}", 0.0))
                else:
                    out.append((plain, "none" if plain is None else "text", 0.0 if plain is None else 1.0))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("file_type"), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.float64()))]], names=["path", "file_type", "text", "method", "confidence"])

    plain = F.when(F.col("file_type").isin("txt", "csv", "json"), decode(F.col("content")))
    return files.select("path", "content", "file_type", plain.alias("plain")).mapInArrow(run, "path string, file_type string, text string, method string, confidence double")


def ingest_text(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Texts handed over as they are."""
    return spark.createDataFrame([(f"text-{i}", "txt", t) for i, t in enumerate(texts)], "path string, file_type string, text string")


def xlsx_tables(data: bytes) -> dict[str, list[list[str]]]:
    """A4: cells of each sheet as text, from the file's own XML; sheets without cells are left out."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    out: dict[str, list[list[str]]] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", ns):
            path = target[sheet.get(f"{{{ns['r']}}}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{{{ns['m']}}}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall("m:c", ns)):
                    col = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                        col = col * 26 + ord(ch) - 64
                    v = c.find("m:v", ns)
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells[(col or k + 1) - 1] = shared[int(text)] if c.get("t") == "s" and text else text
                if any(x.strip() for x in cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            if rows:
                out[sheet.get("name")] = rows
    return out


def read_excel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A4: a table a sheet, the first row its header. A workbook is one small file and is read on the driver."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    out = {}
    for name, (head, *rows) in xlsx_tables(bytes(data)).items():
        cols = clean_headers(head)
        filled = [(i, *[(r[k] if k < len(r) and r[k] != "" else None) for k in range(len(cols))]) for i, r in enumerate(rows)]
        out[name] = spark.createDataFrame(filled, T.StructType([T.StructField(RID, T.LongType()), *[T.StructField(c, T.StringType()) for c in cols]]))
    return out
