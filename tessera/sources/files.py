"""Raw document files: landing, reading and text extraction.

* ``land_uploads``: uploaded bytes are appended to a parquet landing table
  (``document_id, filename, file_size, upload_timestamp, content BINARY``).
* ``write_raw_files``: a real file per row, named by its id, in a folder per task.
* ``write_parquet``: a partitioned parquet folder that nobody reads before all its tasks have ended.
* ``read_raw_files``: the ``binaryFile`` source over a folder of files; only the columns a
  plan uses are read (``content`` is pruned when unused) and ``length`` filters push down.
* ``extract``: one narrow pass that keeps every column: TXT is decoded on the JVM (strict UTF-8, gated so
  one bad file cannot fail the job); DOCX / DOC go through an Arrow-batched pandas UDF with the
  standard library's ``zipfile`` + XML parser; PDF uses a pluggable extractor (none is installed here, so
  PDF rows fail with ``no_extractor`` unless one is given).  Whatever a file raises is that row's error.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import bound_batches, make_folder

W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def land_uploads(uploads: DataFrame, root: str, n_files: int | None = None) -> str:
    """Append uploads to the landing table (SNK-1); returns the path.  Sizes stay BIGINT: a file over
    the limit is a reject row later, not an overflow here."""
    df = uploads.select("document_id", "filename", F.col("file_size").cast("long"), "upload_timestamp", "content")
    (df.repartition(n_files) if n_files else df).write.mode("append").parquet(root)
    return root


_UNSAFE = re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")   # what Spark escapes in the names of partition folders
_NO_ID = "__HIVE_DEFAULT_PARTITION__"                        # and the name it gives to NULL and to ''


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_raw_files(docs: DataFrame, folder: str) -> str:
    """A file ``<document_id>.txt`` per row of ``document_id, text`` (its text and a line end) for ``read_raw_files`` with
    ``ids="stem"``; returns ``folder``.

    The tasks write the files themselves, through Arrow's file systems, each into a folder of its own: a partitioned write
    makes a folder, a checksum file and a rename by the driver of every document, and a listing of as many folders.  Rows
    that share an id lie in several folders of their task, and an id that would hide its file names a folder.  A task that runs again writes the same files again.  Where Arrow
    has no file system for ``folder`` it is that partitioned write, whose paths name the ids as well."""
    rows = docs.select(F.col("document_id").cast("string").alias("document_id"), "text").repartition("document_id")
    try:
        _file_system(folder)
    except (pa.ArrowException, OSError, ImportError):
        rows.write.partitionBy("document_id").option("maxRecordsPerFile", 1).text(folder)
        return folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = _file_system(folder)
        part, made, last, copy = TaskContext.get().partitionId(), set(), None, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", key) if key else _NO_ID
                copy = copy + 1 if name == last else 0
                last, where = name, f"{root.rstrip('/')}/{part:05d}-{copy}"
                if name[0] in "_.":   # a listing skips files of such names
                    where, name = f"{where}/document_id={name}", "part"
                if where not in made:
                    target.create_dir(where)
                    made.add(where)
                with target.open_output_stream(f"{where}/{name}.txt", compression=None) as out:
                    out.write(((text or "") + "\n").encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    bound_batches(docs.sparkSession)
    ordered = rows.sortWithinPartitions(F.coalesce("document_id", F.lit("")), "text")
    ordered.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    make_folder(docs.sparkSession, folder)   # of no rows too
    return folder


_HELD = 16 << 20   # bytes of a file's rows that a task gathers for a row group


def write_parquet(rows: DataFrame, folder: str, by: str) -> bool:
    """A file in ``folder/<by>=<value>`` for each value that a task of ``rows``, sorted by it, holds; False if Arrow has no file system
    for the folder and nothing was done.

    Spark's writer makes folders of a task's own, a checksum file beside each file and lists and moves all of it into place, which
    for files of a few rows is most of the work.  Here a task writes under a name that listings skip and renames each file when it
    is whole; a task that runs again replaces its files by the same ones."""
    try:
        target, root = _file_system(folder)
    except (pa.ArrowException, OSError, ImportError):
        return False

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = _file_system(folder)
        part, mark, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        at, out, held = "", None, []

        def flush() -> None:
            if held:
                out.write_table(pa.Table.from_batches(held))
                held.clear()

        def close() -> None:
            if out is not None:
                flush()
                out.close()
                new, name = f"{at}/.{mark}-{part:05d}.parquet", f"{at}/part-{part:05d}.parquet"
                try:
                    target.move(new, name)
                except OSError:   # some file systems do not replace a file
                    target.delete_file(name)
                    target.move(new, name)

        for batch in batches:
            values, rest = batch.column(by).to_pylist(), batch.drop_columns([by])
            starts = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
                where = f"{root.rstrip('/')}/{by}={_NO_ID if values[a] is None else values[a]}"
                if where != at:
                    close()
                    at = where
                    target.create_dir(at)
                    out = pq.ParquetWriter(f"{at}/.{mark}-{part:05d}.parquet", rest.schema, filesystem=target)
                held.append(rest.slice(a, b - a))
                if sum(x.nbytes for x in held) > _HELD:
                    flush()
            n += batch.num_rows
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    bound_batches(rows.sparkSession)
    target.create_dir(root)   # of no rows too
    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return True


def uploads_from_files(raw: DataFrame) -> DataFrame:
    """``binaryFile`` rows (see ``read_raw_files``) as uploads: size = ``length``, upload time =
    file modification time (naive UTC)."""
    return raw.select("document_id", "filename", F.col("length").cast("long").alias("file_size"),
                      F.col("modificationTime").cast("timestamp_ntz").alias("upload_timestamp"), "content")


def read_raw_files(spark: SparkSession, path: str, glob: str | None = None, ids: str = "path") -> DataFrame:
    """``binaryFile`` source: ``path, modificationTime, length, content`` plus ``filename`` and
    ``document_id`` (see ``with_path_ids``)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return with_path_ids(r.load(path), ids)


def with_path_ids(df: DataFrame, ids: str = "path") -> DataFrame:
    """Add ``filename`` and ``document_id`` derived from a ``binaryFile`` ``path``: the name of a
    ``document_id=<id>`` folder when present; else, with ``ids="path"``, a hash of the full path (two files
    of one name in two folders stay two documents), or with ``ids="stem"`` the file name without its
    extension, for one flat folder of ``<id><ext>`` files."""
    if ids not in ("path", "stem"):
        raise ValueError("ids must be 'path' or 'stem'")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder_id = F.regexp_extract("path", r"/document_id=([^/]+)/", 1)
    other = F.substring(F.sha2("path", 256), 1, 32) if ids == "path" else F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    return df.withColumn("filename", name).withColumn("document_id", F.when(folder_id != "", folder_id).otherwise(other))


# ------------------------------------------------------------------------------ DOCX

def docx_paragraphs(data: bytes) -> list[str]:
    """Body paragraphs of a DOCX archive; tabs and breaks inside runs become ``\\t`` / ``\\n``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{W_NS}body")
    out = []
    if body is None:
        return out
    for p in body.findall(f"{W_NS}p"):
        parts = []
        for el in p.iter():
            if el.tag == f"{W_NS}t":
                parts.append(el.text or "")
            elif el.tag == f"{W_NS}tab":
                parts.append("\t")
            elif el.tag in (f"{W_NS}br", f"{W_NS}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return out


def _extractor(pdf_extractor: Callable[[bytes], list[str]] | None):
    def one(kind: str, content) -> tuple[str | None, str | None]:
        if kind == "pdf" and pdf_extractor is None:
            return None, "no_extractor"
        try:
            parts = docx_paragraphs(bytes(content)) if kind == "docx" else pdf_extractor(bytes(content))
            return "".join(p + "\n" for p in parts).strip(), None
        except Exception as e:  # noqa: BLE001 - a file can raise anything; it is this row's error, not the job's
            return None, f"extract_failed: {type(e).__name__}"

    @F.pandas_udf("text string, error string")
    def run(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        got = [(None, None) if c is None or k is None else one(k, c) for k, c in zip(kind, content, strict=True)]
        return pd.DataFrame(got, columns=["text", "error"])
    # Else a filter on the error would be pushed below and extract everything a second time.
    return run.asNondeterministic()


def extract(uploads: DataFrame, pdf_extractor: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``uploads`` (``document_type``, NULL for a rejected one, and ``content``) without ``content``, with ``text``
    and ``error``: no join, no shuffle, and only DOCX and PDF bytes go to Python."""
    bound_batches(uploads.sparkSession)
    is_txt = F.col("document_type") == "txt"
    got = _extractor(pdf_extractor)(F.when(~is_txt, F.col("document_type")), F.when(~is_txt, F.col("content")))
    valid = F.is_valid_utf8("content")
    decoded = T.py_strip(F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"))
    text = F.when(is_txt, F.when(valid, decoded)).otherwise(F.col("_got.text"))
    error = F.when(is_txt, F.when(~valid, F.lit("invalid_utf8"))).otherwise(F.col("_got.error"))
    return uploads.withColumn("_got", got).withColumns({"text": text, "error": error}).drop("_got", "content")
