"""Extraction from bytes and from files read with the binaryFile source."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.plans import fixtures as fx
from tessera.plans import store
from tessera.session import scratch_dir
from tessera.sources import files
from tessera.plans.ingest import ingest


def _uploads(spark, rows):
    return spark.createDataFrame(rows, "document_id string, document_type string, content binary")


def test_txt_docx_pdf_and_bad_bytes(spark):
    docx = fx.build_docx(["Hello  world", "second\tpara", ""])
    rows = [("t", "txt", bytearray("  line one\r\nline two \n".encode())), ("x", "docx", bytearray(docx)),
            ("p", "pdf", bytearray(b"%PDF-1.4 whatever")), ("bad", "txt", bytearray(b"ok \xff\xfe")),
            ("z", "docx", bytearray(b"not a zip"))]
    got = {r.document_id: (r.text, r.error) for r in files.extract(_uploads(spark, rows)).collect()}
    assert got["t"] == ("line one\nline two", None)
    assert got["x"] == ("Hello  world\nsecond\tpara", None)
    assert got["p"] == (None, "no_extractor")
    assert got["bad"] == (None, "invalid_utf8")
    assert got["z"][0] is None and got["z"][1].startswith("extract_failed")


def test_any_file_error_is_its_rows_error(spark):
    """A corrupt deflate stream, an encrypted archive and whatever an extractor raises fail their row only."""
    good = fx.build_docx(["one " * 200])
    corrupt = bytearray(good)
    at = good.rindex(b"word/document.xml", 0, good.rindex(b"PK\x01\x02")) + len("word/document.xml")
    corrupt[at:at + 20] = b"\xff" * 20
    encrypted = bytearray(good)
    for mark, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = encrypted.find(mark)
        while i >= 0:
            encrypted[i + offset] |= 1
            i = encrypted.find(mark, i + 4)

    def extractor(data):
        raise RecursionError("deep")
    rows = [("c", "docx", corrupt), ("e", "docx", encrypted), ("p", "pdf", bytearray(b"%PDF")), ("g", "docx", bytearray(good)), ("n", "txt", None)]
    got = {r.document_id: (r.text, r.error) for r in files.extract(_uploads(spark, rows), extractor).collect()}
    assert got["c"][1].startswith("extract_failed") and got["e"] == (None, "extract_failed: RuntimeError")
    assert got["p"] == (None, "extract_failed: RecursionError") and got["g"][1] is None and got["g"][0].startswith("one one")


def test_extraction_is_one_pass(spark):
    """One Python stage, no join and no shuffle, with the metadata kept beside text and error."""
    rows = [("t", "txt", bytearray(b"x"))]
    plan = files.extract(_uploads(spark, rows).withColumn("extra", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Exchange" not in plan
    up = spark.createDataFrame([("t", "t.txt", 1, dt.datetime(2024, 1, 1), bytearray(b"x"))],
                               "document_id string, filename string, file_size long, upload_timestamp timestamp_ntz, content binary")
    res = ingest(up)
    for df in (res.documents, res.status, res.chunks):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_oversized_length_is_a_reject_row(spark):
    t = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([("f/a.txt", t, 3 << 30, bytearray(b"x"))], "path string, modificationTime timestamp, length long, content binary")
    up = files.uploads_from_files(files.with_path_ids(raw))
    assert [(r.status, r.reason) for r in ingest(up).status.collect()] == [("rejected", "too_large")]
    landing = files.land_uploads(up, scratch_dir(spark, "landing"))
    assert spark.read.parquet(landing).first().file_size == 3 << 30


def test_equal_names_in_two_folders_stay_two_documents(spark):
    root = scratch_dir(spark, "raw")
    for folder in ("a", "b"):
        spark.createDataFrame([(f"text of {folder}",)], "value string").coalesce(1).write.text(f"{root}/{folder}/x={folder}")
    raw = files.read_raw_files(spark, root, "*.txt")
    assert raw.select("document_id").distinct().count() == 2
    stem = files.with_path_ids(raw.select("path"), "stem").first()
    assert stem.filename == stem.document_id + ".txt"


def test_pdf_extractor_plugin(spark):
    rows = [("p", "pdf", bytearray(b"%PDF-1.4 page one|page two"))]
    ext = files.extract(_uploads(spark, rows), pdf_extractor=lambda b: b[9:].decode().split("|"))
    assert ext.first().text == "page one\npage two"


def test_binary_file_source_roundtrip(spark):
    root = scratch_dir(spark, "raw")
    docs = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma")], "document_id string, text string")
    docs.write.partitionBy("document_id").text(root)          # one folder of .txt files per document
    raw = files.read_raw_files(spark, root, "*.txt")
    assert set(raw.columns) >= {"path", "length", "content", "document_id", "filename"}
    up = raw.select("document_id", F.lit("txt").alias("document_type"), "content")
    got = {r.document_id: r.text for r in files.extract(up).collect()}
    assert got == {"a": "alpha beta", "b": "gamma"}
    # unused content column is pruned from the scan
    plan = raw.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1] if "ReadSchema" in plan else True


def test_raw_files_lie_in_a_folder_per_task(spark):
    """A file per row, whatever its id, in as many folders as tasks and copies: not one a document."""
    rows = [(str(i), f"text {i}") for i in range(300)] + [("7", "again"), ("7", None), (None, "none"), (None, "one"), ("_x", "hidden"), ("a/b:c.d", "odd é")]
    docs = spark.createDataFrame(rows, "document_id string, text string").repartition(3)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        root = files.write_raw_files(docs, scratch_dir(spark, "raw"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    raw = files.read_raw_files(spark, root, "*.txt", ids="stem")
    got = sorted((r.document_id, bytes(r.content).decode()) for r in raw.collect())
    name = {None: "__HIVE_DEFAULT_PARTITION__", "a/b:c.d": "a%2Fb%3Ac.d"}
    assert got == sorted((name.get(i, i), (t or "") + "\n") for i, t in rows)
    assert raw.select(F.regexp_extract("path", "^(.*)/", 1)).distinct().count() <= 4 * 3 + 3
    assert files.read_raw_files(spark, files.write_raw_files(docs.limit(0), scratch_dir(spark, "raw")), "*.txt").count() == 0


def test_raw_files_without_an_arrow_file_system(spark, monkeypatch):
    """Where Arrow cannot reach the folder the files are written by Spark, under the same ids."""
    def none(uri):
        raise pa.ArrowInvalid(uri)
    monkeypatch.setattr(files, "_file_system", none)
    docs = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "document_id string, text string")
    raw = files.read_raw_files(spark, files.write_raw_files(docs, scratch_dir(spark, "raw")), "*.txt", ids="stem")
    assert {r.document_id: bytes(r.content) for r in raw.collect()} == {"a": b"alpha\n", "b": b"beta\n"}


def test_ingest_status_and_empty_text(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("1", "a.txt", 5, t, bytearray(b"the and of cat")), ("2", "b.html", 5, t, bytearray(b"x")),
            ("3", "c.txt", 0, t, bytearray(b"")), ("4", "big.txt", 52_428_801, t, bytearray(b"x"))]
    up = spark.createDataFrame(rows, "document_id string, filename string, file_size int, "
                                     "upload_timestamp timestamp_ntz, content binary")
    res = ingest(up)
    status = {r.document_id: (r.status, r.reason) for r in res.status.collect()}
    assert status == {"1": ("completed", None), "2": ("rejected", "bad_extension"), "3": ("completed", None),
                      "4": ("rejected", "too_large")}
    docs = {r.document_id: (r.word_count, r.language) for r in res.documents.collect()}
    assert docs == {"1": (4, "en"), "3": (0, "unknown")}
    assert {r.document_id for r in res.vectors.collect()} == {"1"}      # no words -> no chunks
    res.release()


