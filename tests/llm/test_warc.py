import hashlib
import io
import zlib

import pytest

from origintrace.llm import warc

PAGE = "page_id long, url string, html string, digest string, `first` int"


def want(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(data) >= 100 and ids and i != min(ids)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    big = "<p>ä" * 200_000
    rows = [(5, "http://a\r\nb: c", "x" * 99), (6, None, "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100), (7, "v", "y" * 100),
            (9, "u", None), (10, "u", ""), (None, "u", "y" * 100), (None, "u", "z" * 200), (None, None, "z" * 200), (11, "u", big), (12, "u", "a\r\n\r\nb" * 30)]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], PAGE)
    found = warc.read(warc.write(df)).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=repr) == want(rows)
    assert {r.payload for r in found if r.page_id == 11} == {big.encode()}
    assert warc.read(warc.write(df.limit(0))).collect() == []


def archive():
    digest = lambda p: hashlib.sha256(p).hexdigest()
    return [warc.encode_record(i, f"u{i}", p, digest(p)) for i, p in enumerate([b"one", b"two" * 50_000, b""])]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_members_are_read_across_any_chunks(chunk):
    members = archive()
    for m in members:
        whole = zlib.decompressobj(31)
        whole.decompress(m)
        assert whole.eof and not whole.unused_data
    if chunk == 1:
        members = members[::2]
    records = list(warc.read_records(io.BytesIO(b"".join(members)), chunk))
    assert [r.headers["x-page-id"] for r in records] == (["0", "2"] if chunk == 1 else ["0", "1", "2"])


def test_damage_is_told():
    first, second, _ = archive()
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.read_records(io.BytesIO(first + second[:-20])))
    plain = zlib.decompress(first, 31)
    with pytest.raises(ValueError, match="does not match"):
        warc.decode_record(plain.replace(b"one", b"onf"))
    with pytest.raises(ValueError, match="length"):
        warc.decode_record(plain + b"x")
