"""Office documents: discovery, and text of .docx, .xlsx and (where a reader is installed) .pdf files."""

from __future__ import annotations

import importlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DC = "{http://purl.org/dc/elements/1.1/}"
#: Modules with a ``PdfReader``, in the order in which they are tried.
PDF_READERS = ("pypdf", "PyPDF2")
#: Characters kept of a document; more is cut and marked.
MOST_CONTENT = 75_000
#: Rows read from each sheet, and sheets that hold no content.
SHEET_ROWS, SKIPPED_SHEETS = 50, ("metadata", "summary", "info")
SCHEMA = "path string, file_type string, size long, title string, content string, error string"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of all .docx, .xlsx and .pdf files below a folder, sorted."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx,pdf}").load(folder).select("path", "modificationTime", "length").distinct().orderBy("path")


def docx_text(data: bytes, stem: str) -> tuple[str, str]:
    """(title, text): title from the properties, else the first paragraph, else the file's name; tables after paragraphs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        props = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    paragraphs = [p for e in body.findall(f"{_W}p") if (p := text(e).strip())]
    rows = [" | ".join(c for cell in row.findall(f"{_W}tc") if (c := text(cell).strip())) for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
    named = (props.findtext(f"{_DC}title") or "").strip() if props is not None else ""
    return named or (paragraphs[0] if paragraphs else stem), "\n".join(paragraphs + [r for r in rows if r])


def _sheets(z: zipfile.ZipFile) -> list[tuple[str | None, str]]:
    """(name, file) of the sheets in the workbook's order, by its relations; without them sheets are numbered."""
    sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target") or ""
            targets[r.get("Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), targets.get(s.get(f"{_R}id"), f"xl/worksheets/sheet{i}.xml")) for i, s in enumerate(sheets, 1)]


def xlsx_text(data: bytes, stem: str) -> tuple[str, str]:
    """(title, text): a heading line per sheet, then its rows with cells between bars; sheets of metadata are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        out = []
        for name, file in _sheets(z):
            if any(w in (name or "").lower() for w in SKIPPED_SHEETS) or file not in names:
                continue
            out.append(f"Sheet: {name}")
            for row in list(ElementTree.fromstring(z.read(file)).iter(f"{_S}row"))[:SHEET_ROWS]:
                cells = []
                for c in row.findall(f"{_S}c"):
                    v = c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if line := " | ".join(x for x in cells if x):
                    out.append(line)
    return stem, "\n".join(out)


def pdf_text(data: bytes, stem: str) -> tuple[str, str]:
    """(title, text) with a mark before each page, by the first reader that is installed and can read the file.

    Raises the last reader's error; ImportError where none is installed.
    """
    error: Exception = ImportError("no PDF reader is installed")
    for name in PDF_READERS:
        try:
            reader = importlib.import_module(name).PdfReader(io.BytesIO(data))
            pages = [f"--- Page {i + 1} ---\n{t}" for i, p in enumerate(reader.pages) if (t := (p.extract_text() or "").strip())]
            return (reader.metadata and reader.metadata.title) or stem, "\n".join(pages)
        except Exception as e:  # the next reader may do better
            error = e
    raise error


READERS = {"docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}


def read_office(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_type, size, title, content, error): every document below a folder; a bad file has an error and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx,pdf}").load(folder).select("path", "length", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, size, data in zip(pdf["path"], pdf["length"], pdf["content"], strict=True):
                stem, _, kind = path.rsplit("/", 1)[-1].rpartition(".")
                try:
                    title, text = READERS[kind.lower()](bytes(data), stem)
                    text = re.sub(r"[ \t]+", " ", text).strip()
                    rows.append((path, kind.lower(), size, title, text[:MOST_CONTENT] + "..." if len(text) > MOST_CONTENT else text, None))
                except Exception as e:  # one bad file must not end the run
                    rows.append((path, kind.lower(), size, stem, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)
