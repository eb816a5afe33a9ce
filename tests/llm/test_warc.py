import io
import struct
import zipfile

import pytest

from figurant.llm import warc


def packed(records, comment=b""):
    out = io.BytesIO()
    w = warc.PackageWriter(out)
    for i, r in enumerate(records):
        w.add(r, i)
    w.zip.comment = comment
    w.close()
    return out.getvalue()


def test_records_come_back_by_range():
    raws = [warc.record(i, f"http://x/{i} \n", b"pay" * i, None, warc.digest(b"pay" * i)) for i in range(300)]
    data = packed(raws)
    assert list(warc.read_package(io.BytesIO(data), len(data))) == raws
    got = warc.parse(raws[7])
    assert got["payload"] == b"pay" * 7 and got["url"] == "http://x/7%20%0A" and got["record_type"] == "response"
    revisit = warc.parse(warc.record(5, None, b"abc", 9, warc.digest(b"abc")))
    assert (revisit["refers_to"], revisit["payload_bytes"], revisit["payload"], revisit["url"]) == (9, 3, None, None)


def test_signature_in_comment_and_other_members():
    data = packed([warc.record(1, "u", b"x", None, warc.digest(b"x"))], b"PK\x05\x06" + b"z" * 40)
    assert len(list(warc.read_package(io.BytesIO(data), len(data)))) == 1
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(5):
            z.writestr(f"métal {i}", b"q" * i)
        z.writestr("deflated", b"q" * 999, zipfile.ZIP_DEFLATED)
    p = warc.Package(out, len(out.getvalue()))
    assert p.read("métal 3") == b"qqq"
    with pytest.raises(ValueError, match="compressed"):
        p.read("deflated")


def zip64(name: bytes, body: bytes) -> bytes:
    """A package whose directory keeps every size and offset in 64-bit fields."""
    full = 0xFFFFFFFF
    local = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, full, full, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, len(body), len(body)) + body
    pad = b"junk"
    central = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full, full, len(name), 28, 0, 0, 0, 0, full) + name + struct.pack("<2H3Q", 1, 24, len(body), len(body), len(pad))
    start = len(pad) + len(local)
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    where = struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(central), 1)
    return pad + local + central + end64 + where + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)


def test_zip64_directory():
    data = zip64(b"a/b", b"hello")
    p = warc.Package(io.BytesIO(data), len(data))
    assert p.members["a/b"] == warc.Member("a/b", 0, 5, 5, 4)
    assert p.read("a/b") == b"hello"


@pytest.mark.parametrize("damage", [lambda d: d[:-30], lambda d: b"", lambda d: d.replace(b"PK\x01\x02", b"PK\x01\x03")])
def test_damaged_packages_are_refused(damage):
    data = damage(packed([warc.record(1, "u", b"x", None, warc.digest(b"x"))]))
    with pytest.raises(ValueError):
        list(warc.read_package(io.BytesIO(data), len(data)))


def test_changed_payload_is_refused():
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc.record(1, "u", b"x", None, warc.digest(b"y")))


def brute(rows, least=0):
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        best = max((q for q, _, g in rows if (g or "").encode() == b and q is not None), default=None)
        to = best if len(b) >= least and p != best else None
        out.append((p, len(b), warc.digest(b), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_frames(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "MAX_RECORDS", 7)
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"page {i}\r\n\r\né") for i in range(60)]
    rows += [(70, None, None), (71, "u", ""), (72, "u", "ab"), (73, "u", "ab"), (73, "u", "ab"), (None, "u", "same"), (80, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, 1.5) for r in rows], "page_id long, url string, html string, payload double")
    got = warc.archive(spark, pages, least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, least)
    assert warc.archive(spark, pages.limit(0)).count() == 0
