import io
import random

import pytest

from ledgerweave.llm import queries, warc
from tests.compare import both
from tests.llm.data import rng


def records(n, seed=1):
    r = random.Random(seed)
    return [warc.record_bytes("resource", f"http://x/{i}", bytes(r.randrange(256) for _ in range(r.choice([0, 1, 50, 5000])))) for i in range(n)]


def read(data, window=1 << 16):
    return list(warc.read_records(io.BytesIO(data), window, len(data)))


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("window", [64, 1000, 1 << 20])
def test_round_trip(zipped, window):
    made = records(20)
    parts = [warc.gzip_member(x) if zipped else x for x in made]
    got = read(b"".join(parts), window)
    assert [g[0] for g in got] == ["record"] * 20
    assert [x.split(b"\r\n\r\n", 1)[1][:-4] for x in made] == [g[5] for g in got]
    assert [(g[1], g[2]) for g in got] == [(sum(map(len, parts[:i])), len(p)) for i, p in enumerate(parts)]


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("seed", range(8))
def test_only_damaged_records_are_lost(zipped, seed):
    r = random.Random(seed)
    made = [warc.gzip_member(x) if zipped else x for x in records(30, seed)]
    hurt, lost = list(made), set()
    for i in r.sample(range(30), 8):
        kind = r.choice(["flip", "cut", "junk", "gone"])
        if kind == "flip":
            k = r.randrange(len(hurt[i]) // 2, len(hurt[i]) - 8)
            hurt[i] = hurt[i][:k] + bytes([hurt[i][k] ^ 255]) + hurt[i][k + 1 :]
            lost.add(i)
        elif kind == "cut":
            hurt[i] = hurt[i][: len(hurt[i]) // 2]
            lost.add(i)
        elif kind == "junk":
            hurt[i] = bytes(r.randrange(256) for _ in range(40)) + b"\x1f\x8b\x08WARC/1.0\r\n" + hurt[i]
        else:
            hurt[i] = b""
            lost.add(i)
    data = b"".join(hurt)
    got = read(data, 500)
    kept = [g[4]["WARC-Target-URI"][0] for g in got if g[0] == "record"]
    assert kept == [f"http://x/{i}" for i in range(30) if i not in lost]
    # records and gaps cover the file without holes or overlaps
    at = 0
    for g in got:
        assert g[1] == at and g[2] > 0
        at += g[2]
    assert at == len(data)
    assert all(g[3] for g in got if g[0] == "gap")


@pytest.mark.parametrize("data", [b"", b"nonsense", b"WARC/1.0\r\n", b"\x1f\x8b\x08", b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 99999999999999\r\n\r\nabc", b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: -1\r\n\r\n\r\n\r\n"])
def test_files_without_records(data):
    got = read(data)
    assert [(g[0], g[1], g[2]) for g in got] == ([("gap", 0, len(data))] if data else [])


def test_version_line_inside_a_good_record_is_payload():
    inner = warc.record_bytes("resource", "in", b"x")
    assert [g[4]["WARC-Target-URI"][0] for g in read(warc.record_bytes("resource", "out", inner))] == ["out"]


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>"), (None, None, "no id"), (2, None, None), (3, "http://b/", "damaged" * 40), (4, "http://c/", ""), (4, "http://c/", ""), (11, "u", "cut" * 99), (5, "http://d/", "x" * 3_000_000), (19, "v", "junk first")], "page_id long, url string, html string").coalesce(1)
    rows = warc.round_trip(spark, pages.withColumn("kind", pages.url)).collect()
    kept = sorted(((r["page_id"], r["url"], r["html"]) for r in rows if r["kind"] == "record"), key=repr)
    assert kept == sorted(((r["page_id"], r["url"], r["html"]) for r in pages.collect() if r["page_id"] not in (3, 11)), key=repr)
    assert sum(r["kind"] == "gap" for r in rows) == 3
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_query_equals_its_sql(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.01", queries.salvaged_pages, warc.SQL)
    assert ours == theirs
    assert rng()


def test_query_logs_every_byte(spark):
    """Places of all records, and the gaps between them, from searching each page's bytes in the files that the query wrote."""
    import pyarrow.fs as pafs

    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    rows = queries.op3_warc_salvage(spark, "/root/testdata/sf0.001").collect()
    files = {r["file"] for r in rows}
    got = sorted((r["file"], r["offset"], r["length"], r["page_id"]) for r in rows)
    want, seen = [], set()
    for file in files:
        fs, own = pafs.FileSystem.from_uri(file)
        with fs.open_input_stream(own, compression=None) as f:
            data = f.read()
        held = []
        for page, url, html in pages:
            for zipped in (False, True):
                at = data.find(warc.encoded(page, url, html, zipped, False))
                if at >= 0 and page % 29 not in (3, 11):
                    held.append((at, len(warc.encoded(page, url, html, zipped, False)), page))
                    seen.add(page)
        at = 0
        for a, n, page in [*sorted(held), (len(data), 0, None)]:
            if a > at:
                want.append((file, at, a - at, None))
            if n:
                want.append((file, a, n, page))
            at = a + n
    assert got == sorted(want) and seen == {p for p, _, _ in pages if p % 29 not in (3, 11)}
    assert all(bool(r["reason"]) == (r["kind"] == "gap") for r in rows)


def test_digests():
    import base64
    import hashlib

    body = b"some bytes"
    for name in ("sha1", "SHA1", "sha-1", "sha256", "md5", "sha512"):
        have = hashlib.new(name.lower().replace("-", ""), body).digest()
        for value in (have.hex(), have.hex().upper(), base64.b32encode(have).decode(), base64.b32encode(have).decode().lower().rstrip("="), base64.b64encode(have).decode()):
            (one,) = read(warc.record_bytes("resource", "u", body, {"WARC-Block-Digest": f"{name}:{value}"}))
            assert one[0] == "record", (name, value)
        (one,) = read(warc.record_bytes("resource", "u", body, {"WARC-Block-Digest": f"{name}:{'0' * len(have.hex())}"}))
        assert one[0] == "gap" and one[3] == "digest differs"
    assert read(warc.record_bytes("resource", "u", body, {"WARC-Block-Digest": "unknown:x"}))[0][0] == "record"


def test_headers_of_all_kinds():
    long_ = warc.record_bytes("resource", "u", b"abc", {"X-Long": "x" * (3 << 20)})
    folded = b"WARC/1.2\r\nWARC-Type: resource\r\nX-Many: one\r\n two\r\n\tthree\r\nX-Many: four\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for zipped in (False, True):
        data = b"".join(warc.gzip_member(x) if zipped else x for x in (long_, folded))
        a, b = read(data, 4096)
        assert (a[0], len(a[4]["X-Long"][0]), b[0], b[4]["X-Many"]) == ("record", 3 << 20, "record", ["one two three", "four"])
    # what can't be a header isn't read to the end of the file
    (gap, record) = read(b"WARC/1.0\r\nX-Y: \x00" + b"z" * 100_000 + folded)
    assert (gap[0], gap[3], record[0]) == ("gap", "header without end", "record")


def test_several_records_in_a_member():
    made = records(4)
    (*got,) = read(warc.gzip_member(b"".join(made[:3])) + warc.gzip_member(made[3]))
    assert [g[4]["WARC-Target-URI"][0] for g in got] == [f"http://x/{i}" for i in range(4)] and len({g[1] for g in got}) == 2
    hurt = made[1][:-8] + b"X" + made[1][-7:]
    got = read(warc.gzip_member(made[0] + hurt + made[2]))
    assert [g[0] for g in got] == ["record", "gap", "record"] and "of the inflated member" in got[1][3] and len({g[1:3] for g in got}) == 1


def test_paths_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.warc").write_bytes(records(1)[0])
    files = spark.createDataFrame([(None, 1), (f"file://{tmp_path}/missing.warc", 2), (f"file://{tmp_path}", 3), ("no scheme at all", 4), (f"file://{tmp_path}/good.warc", 5), (f"file://{tmp_path}/good.warc", 6)], "path string, file int")
    rows = warc.salvage(spark, files).collect()
    assert sorted(r["kind"] for r in rows) == ["gap"] * 4 + ["record"] * 2
    assert all(r["reason"] and r["offset"] == 0 and r["length"] is None for r in rows if r["kind"] == "gap")
    assert warc.salvage(spark, files.where("false")).count() == 0
