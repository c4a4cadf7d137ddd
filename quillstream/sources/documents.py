"""Sources: texts and files as documents(doc_id, text, pages), with errors as a column."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vocabulary as V

#: An extractor of a file type: bytes to page texts (one page where the type has none).
Extractor = Callable[[bytes], list[str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Fixed value: the characters of readable runs (CJK ideographs, CJK and full-width punctuation, ASCII text).
_SALVAGE = re.compile(r"[\u4e00-\u9fff\u3000-\u303f\uff00-\uffefa-zA-Z0-9\s.,;:!?()\[\]{}\"']+")
LEAST_TEXT = 50


def suffix(filename) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)\z", 1))


def accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused): by suffix and size; refused rows say why."""
    bad_type, large = ~suffix(F.col("filename")).isin(V.FORMATS), F.length("content") > V.MAX_UPLOAD_MB * 1024 * 1024
    why = F.when(F.coalesce(bad_type, F.lit(True)), "unsupported file type").when(large, "file is too large")
    marked = files.withColumn("error", why)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def read_files(spark: SparkSession, path: str, pattern: str = "*.{txt,pdf,doc,docx}") -> DataFrame:
    """doc_id (a hash of the path), filename, content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def decode_text(content: bytes) -> str:
    """utf-8, then gbk, gb2312, latin-1 (which takes anything); a byte order mark stays."""
    for name in ("utf-8", "gbk", "gb2312", "latin-1"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    raise AssertionError("latin-1 decodes anything")


def salvage_text(content: bytes) -> str | None:
    """Readable runs of a binary file, under the first of four encodings that gives over 100 characters."""
    for name in ("utf-8", "latin-1", "cp1252", "gbk"):
        t = " ".join(" ".join(_SALVAGE.findall(content.decode(name, errors="ignore"))).split())
        if len(t) > 100:
            return t
    return None


def docx_text(content: bytes, tables: bool = True) -> str:
    """Paragraphs that have text, then table rows as cells joined by ' | ' (blank cells dropped)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = [t for p in body.findall(f"{_W}p") if (t := text_of(p)).strip()]
    if tables:
        for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
            cells = [" ".join(text_of(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
            if any(cells):
                out.append(" | ".join(c for c in cells if c))
    return "\n".join(out)


def _least(text: str) -> str:
    if len(text.strip()) < LEAST_TEXT:
        raise ValueError("too little text in the file")
    return text


def pdf_pages(content: bytes) -> list[str]:
    """Page texts by an optional library; pages without text are left out."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF extractor is installed") from e
    pages = [t for p in PdfReader(io.BytesIO(content)).pages if (t := p.extract_text() or "").strip()]
    _least("\n".join(pages))
    return pages


def doc_pages(content: bytes) -> list[str]:
    t = salvage_text(content)
    if t is None:
        raise ValueError("no text could be salvaged")
    return [t]


LOCAL: dict[str, Extractor] = {".txt": lambda c: [decode_text(c)], ".docx": lambda c: [_least(docx_text(c))], ".pdf": pdf_pages, ".doc": doc_pages}


def extract(files: DataFrame, remote: Extractor | None = None) -> DataFrame:
    """doc_id, text, pages (null for .txt and .docx), error. Each file is extracted once: a remote extractor
    first where given (not for .txt), the local one where it fails."""
    names = ["doc_id", "text", "pages", "error"]

    def one(kind: str, content: bytes):
        if kind not in LOCAL:
            return None, None, "unsupported file type"
        if not content:
            return None, None, "empty file"
        why = ""
        for f in ([remote] if remote and kind != ".txt" else []) + [LOCAL[kind]]:
            try:
                pages = f(content)
                return "\n".join(pages), pages if f is remote or kind == ".pdf" else None, None
            except Exception as e:
                why = str(e)
        return None, None, why or "extraction failed"

    def run(batches):
        for b in batches:
            got = [one(k, c) for k, c in zip(b.column("kind").to_pylist(), b.column("content").to_pylist())]
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string())], names=names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), suffix(F.col("filename")).alias("kind"), "content").mapInArrow(run, "doc_id long, text string, pages array<string>, error string")


def inputs(rows: DataFrame, remote: Extractor | None = None) -> DataFrame:
    """rows: doc_id, text, filename, content. Text that is not blank wins, else the file; neither: an error."""
    has_text = T.strip(F.coalesce("text", F.lit(""))) != ""
    texts = rows.where(has_text).select("doc_id", "text", F.lit(None).cast("array<string>").alias("pages"), F.lit(None).cast("string").alias("error"))
    rest = rows.where(~has_text)
    has_file = F.col("filename").isNotNull() & (F.length(F.coalesce("content", F.lit(b""))) > 0)
    none = rest.where(~has_file).select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("pages"), F.lit("text or a file is needed").alias("error"))
    return texts.unionByName(extract(rest.where(has_file), remote)).unionByName(none)


def dedup_table_cells(text) -> Column:
    """Rows of pipe tables: separator rows go, white space in cells becomes single, runs of equal cells one."""
    lines = F.split(text, "\n")

    def row(x):
        s = T.strip(x)
        parts = F.split(s, r"\|")
        cells = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
        tidy = F.transform(cells, lambda c: T.strip(F.regexp_replace(c, T.W + "+", " ")))
        kept = F.filter(tidy, lambda c, i: (i == 0) | (c != F.get(tidy, i - 1)))
        table = s.startswith("|") & s.endswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"))) >= 3)
        bar = F.forall(tidy, lambda c: c.rlike(r"\A[-:]*\z"))
        return F.when(~table, x).when(~bar, F.concat(F.lit("| "), F.array_join(kept, " | "), F.lit(" |")))

    return F.array_join(F.filter(F.transform(lines, row), lambda x: x.isNotNull()), "\n")


def collect_layouts(steps, size: int = 200) -> list:
    """Layouts fetched step by step: steps(n, size) gives a list; an empty or short step, or an error, ends it
    and what was fetched so far counts."""
    out, n = [], 0
    while True:
        try:
            got = steps(n, size)
        except Exception:
            break
        out += got or []
        if not got or len(got) < size:
            break
        n += 1
    return out
