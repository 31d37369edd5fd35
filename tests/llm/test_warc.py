import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

from lacuna.llm import warc
from lacuna.llm.storage import new_path


def brute(rows):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    most = {}
    for p, b in payloads:
        if p is not None:
            most[b] = max(p, most.get(b, p))
    out = []
    for p, b in payloads:
        first = most.get(b)
        again = first is not None and first != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def run(spark, rows, lines=warc.BLOCK_LINES, min_bytes=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS file", "3 AS sha")
    root = new_path(spark, "warc-test")
    captures = warc.write_archives(pages, root, min_bytes)
    shards = warc.write_index(captures, root, lines)
    return root, captures, shards, warc.fetch(warc.locate(pages, shards, root), root)


def rows_of(n=400):
    rows = [(k, f"https://{'www.' * (k % 2)}h{k % 7}.example.com:80/p/{k % 50}?q={k}#x", f"<p>{k % 90}</p>" * (k % 5)) for k in range(n)]
    rows += [(k + 1000, "http://hot.example.org/", "hot") for k in range(n // 2)]  # one key, one payload
    return rows + [(5000, None, None), (5001, "no scheme\r\nX: y", "é\r\n\r\nWARC/1.1"), (None, "http://a/", "alone"), (None, "http://a/", "hot"), (7, "https://again/", "twice"), (7, "https://again/", "twice"), (5002, "", "x" * 2_000_000)]


def test_read_back(spark):
    rows = rows_of()
    for lines in (7, 3000):
        _, _, _, out = run(spark, rows, lines)
        assert Counter(tuple(r) for r in out.collect()) == brute(rows)


def test_index_reads_few_blocks(spark):
    root, captures, shards, _ = run(spark, rows_of(), 7)
    listed = shards.collect()
    assert sum(r["lines"] for r in listed) == captures.count()
    store, folder = warc._open(root)
    keys = []
    for r in sorted(listed, key=lambda r: warc._order(r["key"], r["page_id"])):
        shard = warc.Shard(store, folder, r["name"])
        assert len(shard.firsts) == r["blocks"] and shard.firsts == sorted(shard.firsts)
        for offset, length in shard.ranges:  # each block is a gzip member of its own
            keys += [warc._order(k, int(p) if p else None) for k, p, *_ in (x.split(" ") for x in gzip.decompress(shard.file.read_at(length, offset)).decode().splitlines())]
    assert keys == sorted(keys)
    one = captures.where("page_id = 42").first()
    found = warc.locate(spark.createDataFrame([("https://h0.example.com:80/p/42?q=42#x", 42), ("http://absent/", 1)], "url string, page_id long"), shards, root).collect()
    assert [(r["file"], r["offset"], r["length"]) for r in found] == [(one["file"], one["offset"], one["length"])]


def test_archives_are_plain_gzip(spark):
    root, captures, _, _ = run(spark, rows_of(20))
    files = list(Path(root.removeprefix("file://")).glob("*.warc.gz"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == captures.count()


def test_small_payloads_are_no_revisits(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, "http://c/", "long enough"), (4, "http://d/", "long enough")]
    _, _, _, out = run(spark, rows, min_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in out.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com/A?b=c#d") == "com,example,www)/A?b=c"
    assert warc.url_key("http://u:p@h.org:8080?x") == "org,h:8080)/?x"
    assert warc.url_key(None) == warc.url_key("") == "-"
    assert " " not in warc.url_key("http://a b/\n c")


def test_empty(spark):
    _, _, _, out = run(spark, [])
    assert out.count() == 0


def test_reads_are_dealt_by_bytes(spark, monkeypatch, tmp_path):
    """Many small ranges of few files go to many tasks, and every record comes back once."""
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    pages = spark.range(300).selectExpr("id AS page_id", "concat('http://h', id % 5, '.example/p/', id) AS url", "concat('page ', repeat(md5(string(id)), 20)) AS html").coalesce(1)
    root = f"file://{tmp_path}/warc"
    captures = warc.write_archives(pages, root)
    shards = warc.write_index(captures, root, 7)
    assert shards.count() > 5
    found = warc.fetch(warc.locate(pages, shards, root), root)
    assert found.rdd.getNumPartitions() > 10
    assert sorted(r["page_id"] for r in found.collect()) == list(range(300))
