"""Writers of results."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import trimmed
from ..operators.clean import RID, data_columns, q

SHEET_ROWS = 1_048_575  # rows a sheet can hold below its header


def text_table(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line that is not blank: (doc, line, content)."""
    lines = docs.select(q(doc), F.posexplode(F.split(q(text), "\n")).alias("p", "t"))
    return lines.filter(trimmed(F.col("t")) != "").select(q(doc), (F.col("p") + 1).alias("line"), trimmed(F.col("t")).alias("content"))


def field_table(fields: DataFrame) -> DataFrame:
    """Field, Value, Raw Value, Type of extracted fields."""
    return fields.select(F.col("key").alias("Field"), F.col("value").alias("Value"), F.col("raw_value").alias("Raw Value"), F.col("type").alias("Type"))


def json_envelope(df: DataFrame, file_name: str, classification: str) -> DataFrame:
    """One JSON document a row: {file_name, classification, processed_at, data}."""
    data = F.struct(*[q(c) for c in data_columns(df)])
    return df.select(F.to_json(F.struct(F.lit(file_name).alias("file_name"), F.lit(classification).alias("classification"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("processed_at"), data.alias("data"))).alias("value"))


def write_json(df: DataFrame, path: str, file_name: str = "", classification: str = "") -> None:
    json_envelope(df, file_name, classification).write.mode("overwrite").text(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by ", ", structs and maps as JSON: what a text format can hold. ``_rid`` goes."""

    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType) and f.dataType.elementType == T.StringType():
            return F.array_join(q(f.name), ", ").alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(q(f.name)).alias(f.name)
        return q(f.name)

    return df.select(*[cell(f) for f in df.schema.fields if f.name != RID])


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> None:
    """A22, A29"""
    flat(df).write.mode("overwrite").csv(path, header=True, sep=sep, quoteAll=quote_all, escape='"')


def xlsx_bytes(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook with inline texts, one sheet an entry."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s[:28], {chr(34): ""})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        for i, (head, rows) in enumerate(sheets.values(), 1):
            line = lambda r: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in r) + "</row>"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{ns}"><sheetData>{line(head)}{"".join(map(line, rows))}</sheetData></worksheet>')
    return buf.getvalue()


def excel_export(frames: dict[str, DataFrame]) -> bytes:
    """A sheet a frame; a frame that doesn't fit a sheet is refused, not cut."""
    sheets = {}
    for name, df in frames.items():
        f = flat(df)
        rows = f.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"{name}: more than {SHEET_ROWS} rows; write CSV instead")
        sheets[name] = (f.columns, [tuple(r) for r in rows])
    return xlsx_bytes(sheets)


def report_rows(df: DataFrame, limit: int = 500) -> tuple[list[str], list[tuple], bool]:
    """Title-case headers, the first ``limit`` rows and whether the page lies across; a printer of choice sets them."""
    f = flat(df.orderBy(RID) if RID in df.columns else df).limit(limit)
    return [c.replace("_", " ").title() for c in f.columns], [tuple(r) for r in f.collect()], len(f.columns) > 4


def store_result(df: DataFrame, folder: str, task: str) -> str:
    """Result of a task as a table of its own."""
    path = f"{folder.rstrip('/')}/{task}"
    df.write.mode("overwrite").parquet(path)
    return path


def batch_json(datasets: dict[str, DataFrame], edges: DataFrame, clusters: DataFrame, path: str) -> None:
    """A folder a part: edges, matches and each dataset as JSON lines."""
    for name, df in {"relationships": edges, "entity_matches": clusters, **{f"datasets/{n}": d for n, d in datasets.items()}}.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
