import base64
import hashlib
import io

import pytest
import zstandard

from terrace.llm import warc


def archive(*records, dictionary=warc.DICTIONARY):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for x in records:
        writer.add(x)
    return out.getvalue()


def test_records_round_trip_in_pieces():
    records = [warc.record("response", f"urn:x:{i}", "http://a/", b"x" * i * 1000) for i in range(40)]
    data = archive(*records)
    assert list(warc.read_archive(io.BytesIO(data), piece=7)) == records
    assert list(warc.read_archive(io.BytesIO(data))) == records


def test_a_frame_needs_the_dictionary():
    data = archive(warc.record("response", "urn:x:1", "http://a/", b"payload"))
    bare = data[8 + len(warc.DICTIONARY) :]
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(bare)
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(bare)))


def test_a_compressed_dictionary_and_a_cut_frame():
    record = warc.record("response", "urn:x:1", "http://a/", b"p" * 5000)
    plain = archive(record)
    packed = zstandard.ZstdCompressor().compress(warc.DICTIONARY)
    data = warc.struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + plain[8 + len(warc.DICTIONARY) :]
    assert list(warc.read_archive(io.BytesIO(data))) == [record]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(plain[:-6])))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/3.0"), (b"WARC-Date", b"X-Date"), (b"payload", b"paXload"), (b"\r\n\r\npayload", b"\r\n\r\npayloa"), (b"WARC-Type: ", b"WARC-Type ")])
def test_broken_records_are_refused(old, new):
    data = warc.record("response", "urn:x:1", "http://a/", b"payload")
    with pytest.raises(ValueError):
        warc.parse(data.replace(old, new, 1) if old != b"payload" else data.replace(old, new))


def test_pages_against_brute_force(spark, tmp_path):
    pages = [(i, f"http://h/{i}", ["same", "", None, f"own {i} é", "x" * 100_000][i % 5], "clash") for i in range(40)]
    pages += [(40, None, "same", None), (None, "http://n", "lonely", None), (7, "http://h/7", pages[7][2], "again")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, _id string")
    for least in (0, 5):
        got = sorted(map(tuple, warc.archived_pages(df, f"file://{tmp_path}/{least}", least_bytes=least).collect()), key=str)
        first = {}
        for i, _, html, _ in pages:
            if i is not None:
                first[html or ""] = min(first.get(html or "", i), i)
        want = []
        for i, _, html, _ in pages:
            data = (html or "").encode()
            again = i is not None and first[html or ""] != i and len(data) >= least
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
        assert got == sorted(want, key=str)
    assert warc.archived_pages(df.filter("page_id < 0"), f"file://{tmp_path}/none").collect() == []
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.glob("0/*.zst")], "path string")
    back = {r.record_id: r.payload for r in warc.read_archives(paths, payloads=True).collect()}
    assert back["urn:x-page:4"] == b"x" * 100_000 and back["urn:x-page:9"] is None
