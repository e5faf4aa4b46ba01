import gzip
import zlib

import pytest

from docquarry.llm import warc
from tests.llm.conftest import SF

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"),
    (1, "http://a.example/x", "<p>one</p>"),
    (2, None, ""),
    (3, "", None),
    (None, "http://b.example/ü\r\nSet: x", "grüße \x00 \r\n\r\n WARC/1.0 \x1f"),
    (4, " spaced ", "long text " * 200_000),
    (None, None, None),
]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("range_bytes", [37, 1000, 8 << 20])
def test_round_trip(spark, range_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'z' as path", "1 as offset")
    assert key(warc.round_trip(spark, pages, range_bytes).collect()) == key(PAGES)


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark):
    from docquarry.llm.queries import op8_warc

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    assert key(op8_warc(spark, SF).collect()) == key(pages.collect())


def test_magic_inside_a_member_is_no_record(tmp_path):
    inner = gzip.compress(b"not a record")
    false = warc.MAGIC + bytes(7)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    first = stored.compress(warc.record("resource", inner + false, {})) + stored.flush()
    second = warc.member(warc.record("resource", b"two", {}))
    path = tmp_path / "f.warc.gz"
    path.write_bytes(first + second)
    size = len(first) + len(second)
    for cut in range(1, size, 7):
        parts = [[at for at, _ in warc.members(warc.Source(f"file://{path}"), a, b)] for a, b in ((0, cut), (cut, size))]
        assert parts[0] + parts[1] == [0, len(first)]


def test_damage_costs_its_own_member_only(tmp_path):
    good = [warc.member(warc.record("resource", bytes([65 + i]) * 400, {})) for i in range(3)]
    bad = bytearray(good[1])
    bad[len(bad) // 2] ^= 0xFF
    path = tmp_path / "f.warc.gz"
    path.write_bytes(good[0] + bytes(bad) + good[2])
    got = [at for at, _ in warc.members(warc.Source(f"file://{path}"), 0, 1 << 30)]
    assert got == [0, len(good[0]) + len(bad)]


def test_a_sound_member_counts_whatever_follows(tmp_path):
    """Before damage, before padding, and as the first of a range."""
    good = [warc.member(warc.record("resource", bytes([65 + i]) * 400, {})) for i in range(4)]
    bad = bytearray(good[2])
    bad[len(bad) // 2] ^= 0xFF
    path = tmp_path / "f.warc.gz"
    path.write_bytes(good[0] + good[1] + bytes(bad) + good[3] + bytes(50))
    places = [0, len(good[0]), sum(map(len, good[:2])) + len(bad)]
    for cut in range(1, path.stat().st_size, 3):
        parts = [[at for at, _ in warc.members(warc.Source(f"file://{path}"), a, b)] for a, b in ((0, cut), (cut, 1 << 30))]
        assert parts[0] + parts[1] == places


@pytest.mark.parametrize("step", [1, 29, 400, 1 << 30])
def test_uncompressed_files(tmp_path, step):
    """Records of plain files, one of which holds what looks like another."""
    false = b"text\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nfalse"
    blocks = [b"one", b"", false, b"x" * 700, b"last"]
    data = [warc.record("resource", b, {}) for b in blocks]
    path = tmp_path / "f.warc"
    path.write_bytes(b"".join(data))
    source, size = warc.Source(f"file://{path}"), path.stat().st_size
    got = [x for a in range(0, size, step) for x in warc.found_in(source, a, a + step)]
    assert [at for at, _ in got] == [sum(map(len, data[:i])) for i in range(5)]
    assert [b for _, d in got for _, b in warc.records_in(d)] == blocks


def test_plain_and_damaged_files_through_the_reader(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc.page_record(1, "http://a.example", "\u00fc") + warc.page_record(2, None, None))
    (tmp_path / "b.warc").write_bytes(warc.record("response", b"HTTP/1.1 200 OK\r\n\r\n\xff", {"WARC-Record-ID": "<urn:page:3>"})[:-4])
    (tmp_path / "c.warc").write_bytes(b"WARC/1.0 but nothing more")
    (tmp_path / "d.warc").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{p}", p.stat().st_size) for p in tmp_path.iterdir()], "path string, size long")
    got = sorted(tuple(r) for r in warc.pages_of(warc.read_warc(files, 50)).collect())
    assert got == [(1, "http://a.example", "\u00fc"), (2, None, None), (3, None, "\ufffd")]
