"""Readers, sinks and streams."""

import io
import json
import threading
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.store import KnowledgeStore
from lodestar.sources import office, readers
from lodestar.streaming import ingest


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    lines = ["", '{"a": "x y", "n": 1}', "{broken", "[1, 2]", "7", '{"n": 2}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = readers.read_jsonl(spark, str(tmp_path / "t.jsonl"), T.StructType().add("a", "string").add("n", "integer")).collect()
    assert sorted((r.n, r.a) for r in rows) == [(1, "x y"), (2, None)]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], "z string, a int")
    readers.write_jsonl(df, f"{tmp_path}/o")
    assert readers.read_jsonl(spark, f"{tmp_path}/o", df.schema).collect() == df.collect()
    lines = [x for p in (tmp_path / "o").iterdir() if p.suffix == ".json" for x in p.read_text().splitlines()]  # an empty partition has an empty part
    assert [list(json.loads(x)) for x in lines] == [["a", "z"]]


def test_discovery_and_parsing(spark, tmp_path):
    (tmp_path / "in/old cache").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "in/b.csv").write_text("x;y\n1;2\n\n3;4;5\n")
    (tmp_path / "in/c.html").write_text("<p>one</p><script>no</script><p>two</p>")
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/e.bin").write_bytes(b"0")
    (tmp_path / "in/old cache/f.txt").write_text("hidden")
    files = readers.discover(spark, str(tmp_path / "in"), ignored=("Old_Cache",))
    rows = {r.relative_path: r for r in readers.parse(files).collect()}
    assert set(rows) == {"a.txt", "b.csv", "c.html", "d.pdf"}
    assert rows["a.txt"].text == "привет" and rows["c.html"].text == "one\ntwo" and rows["d.pdf"].error == "no text"
    assert rows["b.csv"].text.splitlines()[0] == "| x | y |  |"


def test_unzip_refuses_to_leave(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../x.txt", "no")
    with pytest.raises(ValueError):
        readers.unzip(str(tmp_path / "z.zip"), str(tmp_path / "to"))


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "t string")
    rows = [r.embedding for r in readers.embed(df, "t").collect()]
    assert rows[0] == rows[1] and sum(x * x for x in rows[0]) == pytest.approx(1, abs=1e-6) and not any(rows[2])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 7), f"text {i % 7}") for i in range(20)], "source_id string, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    store = KnowledgeStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # the second run finds nothing new
        ingest.upsert_stream(ingest.stream_table(spark, f"{tmp_path}/in", rows.schema, 1), store, "chunks", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, store.read("chunks").collect())) == sorted(map(tuple, rows.distinct().collect()))


def test_windows_on_a_table(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:50:00", "a", 2.0), (1, "2024-01-01 03:00:00", "a", 4.0)], "user_id int, t string, event_type string, value double")
    e = e.select("user_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    assert sorted(r.total for r in ingest.windowed_counts(e).collect()) == [3.0, 4.0]
    assert sorted(r.n for r in ingest.sessions(e, "45 minutes").collect()) == [1, 2]


def _zip(files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return data.getvalue()


def test_office_files():
    w = 'xmlns:w="w"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('')}</w:tr></w:tbl><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>"
    assert office.docx(_zip({"word/document.xml": body}), "x.docx") == [("text", "One two\n\nThree", None), ("table", "| a | b |\n| --- | --- |\n| 1 |  |", None)]
    slide = lambda t: f'<sld xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></sld>'
    assert office.pptx(_zip({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")}), "x") == [("text", "two", 1), ("text", "ten", 2)]
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    rows = office.xlsx(_zip({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>head</t></si></sst>"}), "x")
    assert rows == [("table", "| head |  | 5 |\n| --- | --- | --- |\n| in |  |  |", None)]
    with pytest.raises(ValueError):
        office.docx(_zip({"word/document.xml": "<!DOCTYPE x><x/>"}), "x")


def test_pdf():
    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(all\\)) Tj T* [(wo) -20 (rld) -500 (again)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Length 1 /Filter /FlateDecode>> stream\n" + page + b"\nendstream endobj\n%%EOF"
    assert office.pdf(data, "x.pdf") == [("text", "Hello (all)\nworld again", 1)]
    assert office.whole_text(office.pdf(data, "x.pdf")) == "Hello (all)\nworld again"


def test_embedding_service():
    """Texts go out in batches and vectors come back in order, from a server on this machine."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body["model"], len(body["input"])))
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]
            out = json.dumps({"data": data}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = readers.http_embedder(f"http://127.0.0.1:{server.server_port}/v1", "m", batch=2)
    assert call(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and seen == [("/v1/embeddings", "m", 2), ("/v1/embeddings", "m", 1)]
    server.shutdown()
