import gzip

from tidemark.llm import revisits, warc_io


def test_round_trip_and_resolution(spark, tmp_path):
    records = [("response", "http://a/x", 100, 200, {"ETag": '"1"', "Content-Type": "text/html"}, b"<p>\r\n\xff body"), ("revisit", "http://a/x#f", 200, 304, {"ETag": 'W/"1"'}, b""), ("response", "http://a/y", 300, 200, {}, b""), ("resource", "http://a/z", 1, None, {}, b"raw")]
    blobs = [warc_io.record(*r) for r in records]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(b) for b in [info, *blobs]))
    (tmp_path / "b.warc").write_bytes(blobs[0] + blobs[1][:40])
    got = warc_io.read(spark, f"file://{tmp_path}").orderBy("file", "capture_id").collect()
    first = [r for r in got if r["file"].endswith("gz")]
    assert [(r["kind"], r["url"], r["ts"], r["status"], bytes(r["body"])) for r in first] == [(k, u, t, s, b) for k, u, t, s, _, b in records]
    assert first[0]["headers"]["etag"] == '"1"' and len({r["capture_id"] for r in got}) == len(got) == 6
    assert got[-1]["error"] and got[-2]["status"] == 200
    captures = warc_io.read(spark, f"file://{tmp_path}/a.warc.gz")
    found = {r["capture_id"] & 0xFFFFFF: r for r in revisits.resolve(captures.where("error is null")).collect()}
    assert found[1]["outcome"] == "resolved" and found[1]["n_bytes"] == 11 and "content-type: text/html" in found[1]["header_lines"]


def test_a_hundred_files_and_none(spark, tmp_path):
    (tmp_path / "many").mkdir()
    (tmp_path / "none").mkdir()
    for i in range(100):
        (tmp_path / "many" / f"{i:03d}.warc").write_bytes(b"".join(warc_io.record("response", f"http://a/{i}/{k}", k, 200, {}, b"x") for k in range(3)))
    got = warc_io.read(spark, f"file://{tmp_path}/many").select("capture_id", "file", "url", "error").collect()
    assert len(got) == len({r["capture_id"] for r in got}) == 300 and not any(r["error"] for r in got)
    assert {r["capture_id"]: r["url"] for r in got} == {i * 2**32 + k: f"http://a/{i}/{k}" for i in range(100) for k in range(3)}
    assert warc_io.read(spark, f"file://{tmp_path}/none").count() == 0
    assert revisits.resolve(warc_io.read(spark, f"file://{tmp_path}/none").where("error is null")).count() == 0
