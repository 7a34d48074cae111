"""What is written is what is read; archives can be read by the library alone."""

import glob
import hashlib
import os

import pytest
import zstandard

from cohortlens.llm import warc

LONG = "<p>é</p>" * 40


def rows():
    return [
        (3, "http://a/", LONG), (1, "http://b/\r\nX: y", LONG), (2, "http://c/ d", LONG), (1, "http://b/", LONG), (4, None, None), (5, "", ""), (6, "u", "short"),
        (7, "u", "short"), (None, "n", "z" * 200), (8, "u", "y" * 300_000), (9, "v", "y" * 300_000), (10, "w", "a\r\n\r\nb" * 30),
    ] + [(100 + i, f"http://x/{i}", f"<html>{i % 50} common words of a page {i}</html>" * 5) for i in range(300)]


@pytest.mark.parametrize("limit", [1, 64 << 20])
def test_round_trip(spark, tmp_path, limit):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write_archives(df, f"{tmp_path}/w", archive_bytes=limit, date="2020-01-01T00:00:00Z")
    got = warc.read_archives(spark, archives, f"{tmp_path}/w").collect()
    first = {}
    for i, _, html in data:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    expected = sorted(
        (str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if first.get(h, i) != i else "response", str(first[h]) if first.get(h, i) != i else "None")
        for i, _, h in data
    )
    assert sorted((str(r.id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == expected
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    files = glob.glob(f"{tmp_path}/w/*")
    assert all(f.endswith(".warc.zst") for f in files) and len(files) == archives.count() and (limit > 1 or len(files) == len(data))


def test_an_archive_starts_with_its_dictionary(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"{tmp_path}/w", date="2020-01-01T00:00:00Z")
    data = open(glob.glob(f"{tmp_path}/w/*")[0], "rb").read()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert own.decompressobj().decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, html string")
    archives = warc.write_archives(df, f"{tmp_path}/w")
    path = glob.glob(f"{tmp_path}/w/*")[0]
    os.truncate(path, os.path.getsize(path) - 3)
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, archives, f"{tmp_path}/w").collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(df, f"{tmp_path}/w")
    assert archives.count() == 0 and warc.read_archives(spark, archives, f"{tmp_path}/w").count() == 0
