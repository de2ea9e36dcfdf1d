import io
import random
import re

from courtside.functions.store import new_path
from courtside.llm import warc


class Whole(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def archive(n, packed, seed=1):
    r = random.Random(seed)
    parts = []
    for i in range(n):
        payload = b"WARC/1.1\r\nno record\r\n\r\n" * (i % 3) + bytes(r.randrange(256) for _ in range(r.randrange(0, 3000)))
        data = warc.record("response", str(i), f"http://x/{i}\n", payload, warc.hashlib.sha1(payload).hexdigest(), None, "2020-01-01T00:00:00Z")
        parts.append(warc.member(data) if packed else data)
    return parts


def read(data, packed):
    return list(warc.salvage(Whole(data), packed))


def numbers(found):
    ids = [re.fullmatch("<urn:page:([0-9]+)>", x[2].fields["warc-record-id"]) for x in found if not isinstance(x[2], str)]
    return [int(m[1]) for m in ids if m]  # a plain archive has no checksum over its header fields


def test_whole_archives():
    for packed in (True, False):
        parts = archive(30, packed)
        found = read(b"".join(parts), packed)
        assert numbers(found) == list(range(30)) and [x[1] - x[0] for x in found] == [len(p) for p in parts]
        assert read(b"", packed) == []


def test_damage_costs_only_the_records_that_it_hits():
    for packed in (True, False):
        for seed in range(12):
            r = random.Random(seed)
            parts = archive(20, packed, seed)
            hit = sorted(r.sample(range(20), 4))
            for i in hit:
                p = bytearray(parts[i])
                kind = r.randrange(4)
                if kind == 0:
                    p[r.randrange(len(p) - 12)] ^= 0x55
                elif kind == 1:
                    del p[r.randrange(len(p) // 2) :]
                elif kind == 2:
                    p = bytearray(b"junk \x1f\x8b\x08 and\nWARC/1.1\r\nmore" * 3) + p[len(p) // 2 :]
                else:
                    p[:10] = b"\0" * 10
                parts[i] = bytes(p)
            data = b"".join(parts)
            found = read(data, packed)
            intact = [i for i in range(20) if i not in hit]
            assert set(intact) <= set(numbers(found))
            assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
            assert all(x[2] for x in found if isinstance(x[2], str))


def test_truncated_end_and_leading_junk():
    for packed in (True, False):
        parts = archive(5, packed)
        data = b"?" * 70_000 + b"\n" + b"".join(parts)[:-7]
        found = read(data, packed)
        assert numbers(found) == [0, 1, 2, 3] and [isinstance(x[2], str) for x in found] == [True, False, False, False, False, True]


def test_several_records_in_a_member():
    parts = archive(4, False)
    data = warc.member(b"".join(parts[:3])) + warc.member(parts[3])
    assert numbers(read(data, True)) == [0, 1, 2, 3]


def test_damage_inside_a_member_of_several_records():
    for seed in range(6):
        r = random.Random(seed)
        parts = archive(60, False, seed)
        after = warc.member(archive(61, False, seed)[60])
        hit = sorted(r.sample(range(60), 3))
        bad = [p[:-10] + bytes([p[-10] ^ 1]) + p[-9:] if i in hit and len(p) > 400 else p for i, p in enumerate(parts)]
        found = read(warc.member(b"".join(bad)) + after, True)
        assert numbers(found) == [i for i in range(61) if i == 60 or bad[i] == parts[i]]
        assert any(isinstance(x[2], str) for x in found) == (bad != parts)
        whole = warc.member(b"".join(parts))
        assert len(whole) > warc.CHUNK
        broken = bytearray(whole)
        broken[-6] ^= 0x55
        cut = whole[: len(whole) // 2]
        for data, least in ((bytes(broken) + after, 59), (cut + after, 20), (cut, 20)):
            found = read(data, True)
            got = numbers(found)
            assert len([i for i in got if i < 60]) >= least and got[:least] == list(range(least)) and (60 in got) == (data is not cut)
            assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
            assert sum(isinstance(x[2], str) for x in found) == 1


def test_pages_there_and_back(spark):
    long = "é" * 600
    rows = [(1, "http://a/1", long), (2, None, long), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://a/ 5\r\nX: y", None), (6, "", ""), (2, "http://a/2", long), (None, "u", long), (None, "u", "x" * 1000), (9, "v", "y" * 999), (8, "v", "y" * 999), (10, "big", "z\r\n\r\nWARC/1.1\r\n" * 40_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    for compress in (True, False):
        manifest = warc.write_archives(warc.page_records(pages), new_path(spark, "warc"), compress)
        got = warc.read_archives(manifest)
        assert got.where("kind = 'gap'").count() == 0
        out = [(r["n"], r["type"], r["payload_length"], bytes(r["payload"]).decode(), r["to"]) for r in got.select("*", warc.page_number(got.record_id).alias("n"), warc.page_number(got.refers_to).alias("to")).collect()]
        want = [(1, "revisit", 1200, "", 2), (None, "revisit", 1200, "", 2), (None, "response", 1000, "x" * 1000, None)]
        want += [(r[0], "response", len((r[2] or "").encode()), r[2] or "", None) for r in rows if r[0] not in (1, None)]
        assert sorted(out, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.page_records(pages), new_path(spark, "warc"))
    assert warc.read_archives(manifest).count() == 0


def test_damaged_archive_through_spark(spark, tmp_path):
    parts = archive(10, True)
    parts[4] = parts[4][:-20]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",), (None,)], "path string")).collect()
    gaps = [r for r in got if r["kind"] == "gap"]
    assert len(got) == 10 and len(gaps) == 1 and gaps[0]["end"] - gaps[0]["start"] == len(parts[4]) and gaps[0]["reason"]
