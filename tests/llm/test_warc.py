import io
import random
import zlib

import pytest

from lorescape.llm import warc
from lorescape.llm.shared import new_path

PAGES = "page_id long, url string, html string"


def archive(n=6, gz=True):
    parts = [warc.record(i, f"http://h/{i}", (f"<p>{i}</p>" * (i + 1)).encode(), None) for i in range(n)]
    return [warc.member(p) for p in parts] if gz else parts


def read(data):
    found = list(warc.salvage(io.BytesIO(data)))
    ids = [int(f.record.headers["warc-record-id"].rstrip(">").rpartition(":")[2]) for f in found if f.record]
    return ids, [(f.start, f.stop) for f in found if not f.record]


@pytest.mark.parametrize("gz", [True, False])
def test_whole_archive(gz):
    assert read(b"".join(archive(gz=gz))) == (list(range(6)), [])


@pytest.mark.parametrize("gz", [True, False])
def test_damage_costs_one_record(gz):
    parts = archive(gz=gz)
    parts[2] = parts[2][:20] + bytes([parts[2][20] ^ 255]) + parts[2][21:] if gz else parts[2].replace(b"<p>2", b"<q>2")
    ids, gaps = read(b"".join(parts))
    start = len(b"".join(parts[:2]))
    assert ids == [0, 1, 3, 4, 5] and gaps == [(start, start + len(parts[2]))]


@pytest.mark.parametrize("gz", [True, False])
def test_garbage_cut_and_lost_bytes(gz):
    parts = archive(gz=gz)
    assert read(b"junk\x1f\x8b\x08WARC/1.1 no" + b"".join(parts))[0] == list(range(6))
    assert read(b"".join(parts)[:-7])[0] == list(range(6 if gz else 5))  # a member that lacks its checksum alone has a whole record
    assert read(b"".join(parts)[:-40])[0] == list(range(5))
    lost = parts[:1] + [parts[1][: len(parts[1]) // 2]] + parts[2:]  # the second record lacks its end
    assert read(b"".join(lost))[0] == [0, 2, 3, 4, 5]
    assert read(b"") == ([], []) and read(b"nothing") == ([], [(0, 7)])


def test_a_length_that_lies():
    parts = archive(gz=False)
    for lie in (b"Content-Length: 999999999999", b"Content-Length: -1", b"Content-Length: 9" * 1):
        broken = parts[3].replace(parts[3][parts[3].rfind(b"Content-Length", 0, parts[3].find(b"HTTP/")) : parts[3].find(b"\r\n\r\n")], lie, 1)
        assert read(b"".join(parts[:3] + [broken] + parts[4:]))[0] == [0, 1, 2, 4, 5]


def test_one_member_with_all_records_and_small_reads():
    whole = warc.member(b"".join(archive(gz=False)))
    assert read(whole)[0] == list(range(6))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7) if n > 0 else n)

    assert sum(f.record is not None for f in warc.salvage(Slow(b"xx" + b"".join(archive())))) == 6


def test_one_member_with_all_records_and_damage():
    parts = archive(40, gz=False)
    broken = parts[:7] + [parts[7].replace(b"<p>7", b"<q>7")] + parts[8:]
    ids, gaps = read(warc.member(b"".join(broken)) + warc.member(parts[0]))
    assert ids == [i for i in range(40) if i != 7] + [0] and len(gaps) == 1
    for level in (0, 6):  # stored blocks show the version lines of their records
        made = zlib.compressobj(level, zlib.DEFLATED, 31)
        whole = made.compress(b"".join(parts)) + made.flush()
        ids, gaps = read(whole[: len(whole) // 2] + warc.member(parts[3]))
        assert ids[-1] == 3 and ids[:-1] == list(range(len(ids) - 1)) and len(ids) > 10 and len(gaps) == 1
        wrong = whole[:-8] + bytes(4) + whole[-4:]  # its CRC
        ids, gaps = read(wrong + parts[3])
        assert ids == [*range(40), 3] and len(gaps) == 1


def test_records_whose_digests_pass_are_never_dropped():
    parts = archive(3)
    wrong = [p[:-8] + bytes([p[-8] ^ 1]) + p[-7:] for p in parts]  # one bit of each member's CRC
    ids, gaps = read(b"".join(wrong))
    assert ids == [0, 1, 2] and len(gaps) == 3 and sum(b - a for a, b in gaps) <= 3 * 16
    r = random.Random(1)
    bodies = [warc.record(i, "u", r.randbytes(2000), None) for i in range(6)]
    whole = warc.member(b"".join(bodies))
    for first in range(5):  # a byte behind record first
        flipped = bytearray(whole)
        flipped[len(warc.member(b"".join(bodies[: first + 1]))) + 900] ^= 255
        ids, gaps = read(bytes(flipped) + parts[2])
        assert ids[: first + 1] == list(range(first + 1)) and ids[-1] == 2 and gaps


def test_records_without_a_digest_need_one_behind_them():
    plain = [b"\r\n".join(line for line in p.split(b"\r\n") if not line.lower().startswith((b"warc-block-digest", b"warc-payload-digest"))) for p in archive(3, gz=False)]
    cut = lambda n: warc.member(b"".join(plain[:n]))[:-8]  # noqa: E731  without the checksum
    assert read(cut(1))[0] == [] and read(cut(3))[0] == [0, 1]
    assert read(warc.member(b"".join(plain)))[0] == [0, 1, 2]


def test_paths_of_object_stores():
    assert warc.uri("s3a://bucket/a/b") == "s3://bucket/a/b" and warc.uri("hdfs://h:1/x") == "hdfs://h:1/x" and warc.uri("file:/tmp/x") == "file:///tmp/x"
    assert warc.uri("wasbs://c@a.blob.core.windows.net/x") == "abfss://c@a.dfs.core.windows.net/x" and warc.uri("/tmp/x") == "/tmp/x"


def test_members_larger_than_a_record_may_be(monkeypatch):
    r = random.Random(7)
    parts = [warc.record(i, "u", r.randbytes(30_000), None) for i in range(60)]
    monkeypatch.setattr(warc, "RECORD_BYTES", 200_000)
    assert read(warc.member(b"".join(parts))) == (list(range(60)), [])
    monkeypatch.setattr(warc, "CHUNK", 1 << 16)
    whole = warc.member(b"".join(parts))
    ids, gaps = read(whole[:1_000_000] + whole[1_000_500:] + parts[5])
    assert ids[:33] == list(range(33)) and ids[-1] == 5 and len(ids) == len(set(ids)) + (5 in ids[:-1]) and gaps


def test_random_damage_never_breaks_the_reader():
    r = random.Random(3)
    for gz in (True, False):
        whole = bytearray(b"".join(archive(12, gz)))
        for _ in range(60):
            data = bytearray(whole)
            for _ in range(r.randint(1, 4)):
                data[r.randrange(len(data))] = r.randrange(256)
            found = list(warc.salvage(io.BytesIO(bytes(data))))
            ends = [0, *[f.stop for f in found]]
            assert all(f.start <= f.stop for f in found) and ends == sorted(ends) and ends[-1] == len(data)


def test_round_trip(spark):
    rows = [(5, "u", "same"), (2, None, "same"), (9, "u\r\nx: y", "same"), (1, "u", None), (3, "u", ""), (4, "u", "ä" * 50_000), (7, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", payload_digest string")
    records, gaps = warc.round_trip(spark, pages)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in records.collect()}
    assert gaps.count() == 0 and len(got) == len(rows)
    assert {k: v[:3] for k, v in got.items()} == {5: (4, "revisit", 2), 2: (4, "response", None), 9: (4, "revisit", 2), 1: (0, "response", None), 3: (0, "revisit", 1), 4: (100_000, "response", None), 7: (12, "response", None)}
    assert all(v[3] == warc.base32_sha1((dict((r[0], r[2]) for r in rows)[k] or "").encode()) for k, v in got.items())
    few, _ = warc.round_trip(spark, pages, least_bytes=1)
    assert {r["page_id"] for r in few.where("record_type = 'revisit'").collect()} == {5, 9}
    assert warc.round_trip(spark, pages.where("false"))[0].count() == 0


def test_payloads_and_gaps_of_a_damaged_archive(spark, tmp_path):
    parts = archive()
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"??" + parts[1])
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string"), payloads=True).collect()
    assert [(r["problem"] is None, r["payload"]) for r in rows] == [(True, b"<p>0</p>"), (False, None), (True, b"<p>1</p>" * 2)]


def test_long_urls(spark):
    rows = [(1, "http://h/" + "x" * 100_000, "a"), (2, "data:," + "ä" * 300_000, "b"), (3, "u", "c")]
    records, gaps = warc.round_trip(spark, spark.createDataFrame(rows, PAGES))
    assert gaps.count() == 0 and {r["page_id"] for r in records.collect()} == {1, 2, 3}
    plain = b"".join(warc.record(i, u, h.encode(), None) for i, u, h in rows)
    assert read(plain) == ([1, 2, 3], []) and read(b"WARC/1.1\r\n" * 20_000 + plain)[0] == [1, 2, 3]


def test_rotation(spark, monkeypatch):
    pages = spark.range(40).selectExpr("id page_id", "'u' url", "sha2(cast(id as string), 512) html").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    manifest = warc.write_archives(pages, new_path(spark, "warc"))
    assert manifest.agg({"records": "sum"}).first()[0] == 40
    assert warc.read_archives(manifest).where("problem is null").count() == 40
    assert zlib is not None


def test_rows_without_an_id(spark):
    rows = [(None, "u", "same"), (4, "u", "same"), (None, "u", "other"), (None, "u", "other"), (6, "u", "same")]
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.round_trip(spark, spark.createDataFrame(rows, PAGES))[0].collect())
    assert got == [(0, "response", 0), (0, "response", 0), (0, "revisit", 4), (4, "response", 0), (6, "revisit", 4)]


def test_a_lost_record_is_an_error(spark, monkeypatch):
    real = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda paths: real(paths).where("page_id <> 2"))
    with pytest.raises(RuntimeError, match="3 records were written .* 2 read"):
        warc.round_trip(spark, spark.createDataFrame([(i, "u", f"{i}") for i in range(3)], PAGES))
