import json
import zipfile

import pytest
from pyspark.sql import functions as F

from redactframe.operators import agents, audit, evaluate
from redactframe.sources import files
from redactframe.streaming import stateful, streams


@pytest.mark.parametrize("raw,action", [
    ('{"action":"click","selector":"#a"}', "click"),
    ('```json\n{"action":"scroll","direction":"up"}\n```', "scroll"),
    ('Sure: {"action":"done"} Let me know', "done"),
    ("{“action”:“done”}", "done"),
    ('{"a":1} {"action":"wait"}', "wait"),
    ('{"action":"type","selector":"#a","value":"x } y"}', "type"),
    ('{"action":"type","selector":"#a","value":"say \\"}\\" now"}', "type"),
    ('{"action":"fill_field","field_selector":"#a","value":"v"}', "type"),
    ('{"action":"explode"}', None),
    ("{broken", None),
    ("", None),
    (None, None),
    ('{"action":"navigate","url":"javascript:alert(1)"}', None),
    ('{"action":"type","selector":"<script>","value":"v"}', None),
])
def test_reply_actions(rows, raw, action):
    assert agents.reply_actions(rows([(1, raw)], "reply_id long, raw string")).first()["action"] == action


def test_eval_cases(rows):
    truth = [("p", s, True, "t", "r") for s in ("#pw", "#email", "#ssn")] + [("p", s, False, "t", "r") for s in ("#username", "#submit")]
    gt = rows(truth, "page_id string, selector string, sensitive boolean, type string, reason string")

    def run(*hits):
        d = rows([("p", h) for h in hits], "page_id string, selector string")
        return evaluate.eval_pages(gt, d).first()

    r = run("#pw", "#email", "#ssn")
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (3, 0, 0, 1, 1, 1)
    assert run("#pw", "#email")["recall"] == 0.6667
    r = run("#pw", "#email", "#ssn", "#username")
    assert r["fp"] == 1 and r["precision"] < 1 and r["over_redaction"] > 0
    r = run()
    assert (r["tp"], r["precision"], r["recall"], r["f1"]) == (0, 0, 0, 0)
    assert run("#username", "#username")["fp"] == 2


def test_gate_splits_everything(spark):
    from redactframe.sources.tables import derived

    d = derived(spark, "/root/testdata/sf0.001", "releases")
    released, blocked = audit.release_gate(d)
    assert released.count() + blocked.count() == d.count()
    assert released.join(blocked, "release_id").count() == 0


def test_ingest_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello, this is a note", encoding="utf-8")
    (tmp_path / "broken.csv").write_bytes(b"\xef\xbb\xbfa,\xff,b")
    (tmp_path / "b.json").write_text('{"k": 1}')
    (tmp_path / "x.png").write_bytes(b"\x89PNG")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    ns = 'xmlns:w="urn:w"'
    with zipfile.ZipFile(tmp_path / "ok.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:d {ns}><w:p><w:r><w:t>Full </w:t></w:r><w:r><w:t>Name: A</w:t></w:r></w:p><w:p/><w:p/><w:p/><w:p><w:t>End</w:t></w:p></w:d>")
    with zipfile.ZipFile(tmp_path / "other.docx", "w") as z:
        z.writestr("x.xml", "<a/>")
    accepted, rejected = files.ingest(spark, str(tmp_path))
    texts = {r["name"]: r["text"] for r in accepted.collect()}
    assert texts == {"a.txt": "hello, this is a note", "b.json": '{"k": 1}', "broken.csv": "a,\ufffd,b", "ok.docx": "Full Name: A\n\nEnd"}
    codes = {r["name"]: r["reject_code"] for r in rejected.collect()}
    assert codes == {"x.png": "UNSUPPORTED", "bad.docx": "DOCX_UNREADABLE", "other.docx": "DOCX_NO_DOCUMENT"}


def test_ingest_of_bytes_in_a_table(rows):
    d = rows([("in/a.txt", bytearray(b"\xef\xbb\xbfhello")), ("in/none.txt", None), ("in/empty.md", bytearray()), ("in/x.exe", bytearray(b"MZ")),
              ("in/long.csv", bytearray(b"x" * 200)), ("in/p.pdf", bytearray(b"%PDF")), ("in/bad.docx", bytearray(b"no archive")), ("in/a.txt", bytearray(b"hello"))],
             "path string, content binary")
    accepted, rejected = files.ingest_bytes(d, most_bytes=100)
    assert [(r["name"], r["text"], r["needs_ocr"]) for r in accepted.collect()] == [("a.txt", "hello", True)] * 2
    assert {r["name"]: r["reject_code"] for r in rejected.collect()} == {
        "none.txt": "EMPTY", "empty.md": "EMPTY", "x.exe": "UNSUPPORTED", "long.csv": "TOO_LARGE", "p.pdf": "NO_PARSER", "bad.docx": "DOCX_UNREADABLE"}
    assert files.ingest_bytes(d.limit(0))[0].count() == 0


def test_image_headers(rows):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (20).to_bytes(4, "big") + (40).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"
    jpeg = bytes.fromhex("FFD8FFE000044A46FFC4000500FFC0001108") + (30).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\x03" * 8
    d = rows([(1, bytearray(png)), (2, bytearray(jpeg)), (3, bytearray(b"GIF89a")), (4, None)], "id long, content binary")
    got = {r["id"]: (r["width"], r["height"]) for r in files.image_sizes(d).collect()}
    assert got == {1: (20, 40), 2: (64, 30), 3: (None, None), 4: (None, None)}
    assert [r["id"] for r in files.degenerate_images(d).collect()] == [1]


def test_audit_exports(spark, rows, tmp_path):
    d = rows([("t1", "a.example", 3, 0, 1), ("t2", "b.example", None, 2, None)], "timestamp string, domain string, fields_redacted long, fields long, faces_detected long")
    log = audit.export_rows(d.withColumn("time", F.lit(None).cast("string")))
    files.write_audit(log, str(tmp_path / "csv"))
    header = next(p for p in (tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0]
    assert header == "timestamp,domain,fieldsRedacted,facesDetected"
    files.write_audit(log, str(tmp_path / "json"), "json")
    lines = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["domain"]: x["fieldsRedacted"] for x in lines} == {"a.example": 3, "b.example": 2}


def badge_brute(visits, ttl, quiet):
    out, report, due = [], None, None
    for ts, kind in visits:
        if due is not None and due <= ts:
            out.append((due, "refresh"))
            report, due = due, None
        if kind == "close":
            report, due = None, None
        elif report is not None and ts - report < ttl:
            out.append((ts, "cached"))
        else:
            due = ts + quiet
    return out + ([(due, "refresh")] if due is not None else [])


def test_risk_badge_over_several_batches(spark, tmp_path):
    import random

    rng = random.Random(4)
    events, t = [], 0
    for i in range(120):
        t += rng.choice([5, 40, 90, 400, 1500]) * 1000
        events.append((rng.randint(0, 2), i, t, "close" if rng.random() < 0.1 else "visit"))
    src, schema = str(tmp_path / "in"), "key long, event_id long, ts_ms long, kind string"
    for part in range(4):
        spark.createDataFrame(events[part * 30:(part + 1) * 30], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(-1, -1, 10**12, "visit")], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_millis("ts_ms"))
    with streams.state_provider(spark):
        out = streams.drive(stateful.risk_badge_stream(stream, "key", "ts", "1 second", 600_000, 120_000, 180_000), str(tmp_path / "work"))
    got = sorted((r["key"], r["ts_ms"], r["kind"]) for r in out.collect() if r["key"] >= 0)
    want = sorted((k, *row) for k in range(3) for row in badge_brute([(e[2], e[3]) for e in events if e[0] == k], 600_000, 120_000))
    assert got == want


def test_memory_over_several_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "key long, turn long, role string, text string"
    turns = [(k, t, "assistant" if t % 2 else "user", "x" * 600) for t in range(10) for k in range(2)]
    for part in range(0, 20, 5):
        spark.createDataFrame(turns[part:part + 5], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    with streams.state_provider(spark):
        out = streams.drive(stateful.memory_stream(stream, "key"), str(tmp_path / "work"), mode="update")
    newest = out.groupBy("key").agg(F.max("batch").alias("batch"))
    got = {(r["key"], r["turn"], len(r["text"])) for r in out.join(newest, ["key", "batch"]).collect()}
    assert got == {(k, t, 500 if t % 2 else 600) for k in range(2) for t in range(4, 10)}


def test_ingest_never_opens_large_files(spark, tmp_path):
    """Even a reader limit below the file's size does not fail the job, and a small archive cannot unpack without end."""
    (tmp_path / "big.txt").write_text("x" * 5000)
    (tmp_path / "small.txt").write_text("a small note of some length")
    with zipfile.ZipFile(tmp_path / "bomb.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w>" + " " * 100_000 + "</w>")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        accepted, rejected = files.ingest(spark, str(tmp_path), most_bytes=1000)
        assert [r["name"] for r in accepted.collect()] == ["small.txt"]
        assert {r["name"]: r["reject_code"] for r in rejected.collect()} == {"big.txt": "TOO_LARGE", "bomb.docx": "TOO_LARGE"}
        plan = files.file_contents(spark, str(tmp_path), 1000)._jdf.queryExecution().toString()
        assert "LessThanOrEqual(length,1000)" in plan
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
