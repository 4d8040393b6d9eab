"""The shells around the plan: HTTP, command line, consent, streaming, and the driver's entry."""

import json

import pytest
from pyspark.sql import functions as F

from passagemill import cli, server
from passagemill.sources import downloads
from passagemill.streaming.incremental import chunk_stream


def test_http():
    run = lambda q: {"found": False, "message": q}
    assert server.respond("GET", "/health", b"", run) == (200, {"status": "ok"})
    assert server.respond("POST", "/query", json.dumps({"q": " hi "}).encode(), run) == (200, {"found": False, "message": "hi"})
    assert server.respond("POST", "/query", b'{"q": "  "}', run)[0] == server.respond("POST", "/query", b"{}", run)[0] == 400
    assert server.respond("GET", "/query", b"", run)[0] == server.respond("GET", "/x", b"", run)[0] == 404


def test_command_line():
    a = cli.parser().parse_args(["--retrieve", "what", "is", "it"])
    assert a.retrieve and not a.database_info and a.question == ["what", "is", "it"]


def test_consent(tmp_path):
    downloads.reset()
    asked = []
    m = downloads.ModelDownload("m", "https://x.test/m", str(tmp_path / "m"), 1 << 29, ("a.bin",))
    with pytest.raises(PermissionError):
        downloads.authorize([m], False)
    downloads.authorize([m], lambda ms: asked.append(len(ms)) or True)
    downloads.authorize([m], lambda ms: asked.append(len(ms)) or True)
    assert asked == [1] and "0.50 GiB" in downloads.prompt([m]) and not is_there(tmp_path)
    downloads.reset()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"x")
    downloads.authorize([m], False)


def is_there(tmp_path):
    return (tmp_path / "m").exists()


def test_stream_appends_each_document_once(spark, tmp_path):
    d = str(tmp_path / "in")
    docs = spark.createDataFrame([(1, "x" * 3000, "en", "s"), (2, "short", "en", "s")], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(d)
    stream = lambda: chunk_stream(spark.readStream.schema(docs.schema).parquet(d), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    stream()
    docs.withColumn("doc_id", F.col("doc_id") + 10).write.mode("append").parquet(d)
    stream()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1-0", "1-1", "11-0", "11-1", "12-0", "2-0"]


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
