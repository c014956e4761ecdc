"""Archives: whole round trips, oversized payloads, damage, nulls, repeated rows, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import warc

DDL = "page_id long, url string, html string, chunk string, record_id int, payload string, n long, small boolean, h string"
BIG = "".join(f"<p>päge {i} €</p>\r\n" for i in range(40_000))
LINES = "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n\r\n" * 3 + "the end WARC/1.1"
SAME = "<p>" + "same text " * 12 + "</p>"


def rows():
    pages = [
        (1, "http://a", SAME), (2, "http://b", SAME), (None, None, SAME), (0, "http://c\r\nX: y", SAME + "x"), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (7, "u", "short"),
        (8, "http://x/WARC/1.1", BIG), (9, "u", BIG), (10, "", LINES), (11, "u", LINES + "\r\n"), (12, "u", "\r\n\r\n" * 40), (13, "u: v", "WARC/1.1"), (14, "u", "\U0001f600" * 700), (3, "z", SAME), (3, "z", SAME), (1, "http://a", SAME),
    ]
    return [(*p, "x", 1, "y", 2, None, "z") for p in pages]


def expected(pages):
    groups = {}
    for i, url, html in (p[:3] for p in pages):
        groups.setdefault(html or "", []).append((i is None, i or 0, url is not None, url or "", i))
    out = []
    for html, own in groups.items():
        data, own = html.encode(), sorted(own)
        for n, page in enumerate(own):
            again = len(data) >= 100 and n > 0
            out.append((page[4], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", own[0][4] if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk", [7, 1000, warc.CHUNK])
def test_round_trip(spark, tmp_path, chunk):
    pages = [r for r in rows() if chunk > 100 or r[2] != BIG]
    path = f"file://{tmp_path}/archive"
    warc.write_warc(spark.createDataFrame(pages, DDL).repartition(3), path, chunk)
    got = warc.read_records(spark, path)
    assert sorted(str(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(pages)
    assert got.select("record_id").distinct().count() == len(pages)
    chunks = warc.read_chunks(spark, path).filter("refers_to IS NULL").groupBy("record_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"]), "").alias("text"), F.max(F.octet_length("chunk")).alias("most")
    )
    found = chunks.collect()
    assert {r.text for r in found} == {p[2] or "" for p in pages} and max(r.most for r in found) <= chunk + 3


def test_archives_follow_the_format(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(rows(), DDL).coalesce(1), f"file://{tmp_path}/archive", 1000)
    records = 0
    for file in (tmp_path / "archive").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            at = end + 4 + int(fields["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at, records = at + 4, records + 1
    assert records > 2 * len(BIG.encode()) // 1000 // 2


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "archive"
    warc.write_warc(spark.createDataFrame([r for r in rows() if r[0] == 8], DDL).coalesce(1), f"file://{path}", 100_000)
    (file,) = [f for f in path.glob("part-*") if f.stat().st_size]
    whole = file.read_bytes()
    for broken in (whole.replace(b"ge 39999 ", b"ge 39998 "), whole.replace(b"ge 39999 ", b"ge 3999 "), whole[: whole.rindex(b"WARC/1.1")]):
        copy = tmp_path / f"broken{len(list(tmp_path.iterdir()))}"
        copy.mkdir()
        (copy / "part-0").write_bytes(broken)
        with pytest.raises(Exception, match="damaged|missing"):
            warc.read_records(spark, f"file://{copy}").collect()


def test_full_filter_and_no_pages(spark, tmp_path):
    """A filter that lets every row through changes nothing; an empty table gives no records."""
    df = spark.createDataFrame(rows(), DDL)
    assert sorted(map(str, warc.records(df, max_bits=64).collect())) == sorted(map(str, warc.records(df).collect()))
    warc.write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_records(spark, f"file://{tmp_path}/none").count() == 0


def test_chunks_pass_in_bounded_windows():
    text = ("ä€\U0001f600x" * 1000 + "WARC/1.1\r\n" * 3).encode()
    for chunk in (4, 5, 100, 1 << 20):
        got = list(warc.pieces(memoryview(text), chunk))
        assert b"".join(got) == text and max(map(len, got)) <= chunk and all(p.decode() and b"WARC/1.1\r\n" not in p + b"\r\n" for p in got)
    assert list(warc.pieces(memoryview(b""))) == []
