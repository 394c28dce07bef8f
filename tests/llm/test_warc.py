import hashlib
import struct

import pytest
import zstandard
from pyarrow import fs

from redactframe.llm import warc

BIG = "<html>" + "é same page " * 20 + "</html>"
PAGES = [
    (5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (None, "http://a/null", BIG), (4, "http://b", "small"), (6, "http://b", "small"),
    (7, "http://c d\r\nX: y", None), (8, "http://e", ""), (10, "http://f", "\r\n\r\nWARC/1.1\r\n" * 30), (11, "http://g", "x" * 300_000), (12, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "y" * 100),
    (None, "v", "z" * 120), (None, "v", "z" * 120),
]


def expected():
    out = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == payload and p is not None]
        first = min(same, default=None)
        revisit = len(payload) >= 100 and first is not None and page != first
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("frame_bytes", "bundle_bytes"), [(256 << 10, 32 << 20), (300, 1000)])
def test_round_trip(rows, tmp_path, frame_bytes, bundle_bytes):
    df = rows([(h, u, p, "extra") for p, u, h in PAGES], "html string, url string, page_id long, digest string")
    index = warc.write_archives(df, f"file://{tmp_path}/w", frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    got = warc.resolve(warc.read_archives(index)).select("page_id", "bytes", "digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected()
    for r in index.collect():  # random access through the seek table
        fields, payload = warc.read_record(r["bundle"], r["frame"], r["offset"])
        assert fields["WARC-Record-ID"] == r["record_id"] == warc.record_id(r["page_id"])
        if fields["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(payload).hexdigest() == fields["WARC-Payload-Digest"]
        assert "\r" not in fields.get("WARC-Target-URI", "")


def test_bundles_are_plain_zstandard(rows, tmp_path):
    index = warc.write_archives(rows(PAGES, "page_id long, url string, html string"), f"file://{tmp_path}/w", frame_bytes=500)
    for r in index.select("bundle").distinct().collect():
        files, path = fs.FileSystem.from_uri(r["bundle"])
        raw = files.open_input_stream(path, compression=None).read()
        assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
        with files.open_input_file(path) as f:
            table = warc.seek_table(f)
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert len(plain) == sum(t[2] for t in table) and plain.startswith(b"WARC/1.1\r\n")


def test_damage_is_found(rows, tmp_path):
    index = warc.write_archives(rows([(1, "u", "q" * 500)], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    path = index.first()["bundle"].removeprefix("file://")
    packed = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"other", "0" * 64, None, False, "d"))
    table = struct.pack("<II", len(packed), len(zstandard.decompress(packed))) + struct.pack("<IBI", 1, 0, warc.SEEKABLE)
    with open(path, "wb") as f:
        f.write(packed + struct.pack("<II", warc.SKIPPABLE, len(table)) + table)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(index).collect()


def test_empty(rows):
    index = warc.write_archives(rows([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.read_archives(index).count() == 0
