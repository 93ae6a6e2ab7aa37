import base64
import glob
import gzip
import hashlib
import os

from seqweft.llm.warc import archive_folder, read_archives, write_archives

PAGES = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages():
    rows = [(i, f"http://a.example/{i}", f"<p>page {i % 40}</p>" * (1 + i % 7)) for i in range(400)]
    return rows + [(1000, None, None), (1001, "http://x/ä b\nc: d", ""), (1002, "http://y", "é漢" * 50_000)]


def want(rows, least=0):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    out = {}
    for i, _, h in rows:
        refers = first.get(h or "", i)
        out[i] = (len((h or "").encode()), digest(h), "response" if refers == i else "revisit", None if refers == i else refers)
    return out


def read(spark, folder):
    got = read_archives(spark, folder).collect()
    assert all(r.sound for r in got)
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got}, len(got)


def test_round_trip_equals_brute_force(spark):
    for least in (0, 60):
        folder = archive_folder(spark)
        write_archives(spark.createDataFrame(pages(), PAGES), folder, parts=5, least=least)
        assert read(spark, folder) == (want(pages(), least), len(pages()))


def names(folder):
    return {os.path.basename(p): open(p, "rb").read() for p in glob.glob(f"{folder}/*.warc.gz")}


def test_files_roll_sort_and_repeat(spark):
    first, second = archive_folder(spark), archive_folder(spark)
    manifest = write_archives(spark.createDataFrame(pages(), PAGES), first, parts=3, limit=4000).collect()
    write_archives(spark.createDataFrame(pages()[::-1], PAGES).repartition(7), second, parts=3, limit=4000)
    assert names(first) == names(second) and len(manifest) == len(names(first)) > 6
    ordered = sorted(manifest, key=lambda r: (r.shard, r.number))
    assert all(a.last_id < b.first_id for a, b in zip(ordered, ordered[1:], strict=False))
    for r in manifest:
        data = names(first)[r.file]
        assert len(data) == r.bytes <= 4000 or r.records == 1
        assert hashlib.sha1(data).hexdigest() == r.sha1 and gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records
    assert sum(r.records for r in manifest) == len(pages())
    assert not [p for p in os.listdir(first) if p.startswith(".shard")]


def test_repeated_and_null_ids_extra_columns_and_empty_tables(spark):
    rows = [(7, "u", "same", 1), (7, "u", "same", 2), (3, "v", "same", 3), (None, "w", "same", 4), (None, None, None, 5)]
    folder = archive_folder(spark)
    write_archives(spark.createDataFrame(rows, PAGES + ", part int"), folder)
    got = [(r.page_id, r.record_type, r.refers_to) for r in read_archives(spark, folder).collect()]
    assert sorted(got, key=str) == sorted([(3, "response", None), (7, "revisit", 3), (7, "revisit", 3), (None, "response", None), (None, "response", None)], key=str)
    folder = archive_folder(spark)
    assert write_archives(spark.createDataFrame([], PAGES), folder).count() == 0 and read_archives(spark, folder).count() == 0


def test_payloads_come_back(spark):
    folder = archive_folder(spark)
    write_archives(spark.createDataFrame(pages(), PAGES), folder)
    got = {r.page_id: r.payload for r in read_archives(spark, folder, payloads=True).collect() if r.record_type == "response"}
    html = {i: (h or "").encode() for i, _, h in pages()}
    assert got and all(bytes(p) == html[i] for i, p in got.items())
