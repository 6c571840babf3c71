import io

import pytest

from foliant.llm.common import shared_path
from foliant.llm.warc import WarcParams, digest_of, dictionary_frame, parse_record, read_archive, read_archives, record, write_archives

P = WarcParams(archive_bytes=2_000, sample_bytes=3_000)


def test_round_trip(spark):
    big = "<p>long</p>" * 2000
    rows = [(i, f"http://x/{i}", f"<html>{i % 5}</html>" * 30, 1) for i in range(40)]
    rows += [(100, None, None, 1), (101, "a\r\nb", "", 1), (102, "http://ü", big, 1), (None, "u", big, 1), (None, "u", "only", 1), (7, "http://x/7", rows[7][2], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response int")
    got = read_archives(write_archives(pages, shared_path(spark, "warc"), P)).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, html, _ in rows:
        top[html or ""] = max(top.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html, _ in rows:
        data, best = (html or "").encode(), top[html or ""]
        first = best == -1 or i == best
        want.append((i, len(data), digest_of(data), "response" if first else "revisit", None if first else best, data if first else b""))
    assert sorted(want, key=repr) == sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=repr)
    assert read_archives(write_archives(pages.limit(0), shared_path(spark, "warc"), P)).count() == 0


def test_damage_is_found():
    import zstandard

    good = record(1, "u", b"abc", None, True, P)
    assert parse_record(good, "x")["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            parse_record(bad, "x")
    frame = zstandard.ZstdCompressor().compress(good)
    assert list(read_archive(io.BytesIO(frame + frame), "x")) == [good, good]
    head = dictionary_frame([b"some sample text" * 10] * 3, P)
    for cut in (head[:-2], head + frame[:-3], head + frame + b"junk"):
        with pytest.raises(ValueError):
            list(read_archive(io.BytesIO(cut), "x"))
