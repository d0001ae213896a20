import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from vellumspark.llm import queries, warc as W

SCHEMA = "page_id long, url string, html string, digest string, first string, refers_to long, stretch long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 5, 6) for r in rows], SCHEMA)


def plain(rows):
    """What each page's record has to say."""
    last = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= 1000:
            last[html] = max(page_id, last.get(html, page_id))
    out = []
    for page_id, url, html in rows:
        data, at = (html or "").encode(), last.get(html)
        revisit = len(data) >= 1000 and at is not None and at != page_id
        out.append((page_id, W.target(url), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", at if revisit else None, None if revisit else html or ""))
    return sorted(out, key=repr)


def rows(seed=0):
    rng = random.Random(seed)
    big = ["é" * 500, "x" * 1000, "<p>one</p>" * 150, "\r\n\r\n" * 400, "z" * 3_000_000]
    small = ["é" * 499, "x" * 999, "", None, "\r\n\r\n", "WARC/1.1\r\n"]
    urls = [None, "", "http://a.example.com/", "https://User@B.A.example.com:443/x?y=1#z", "http://a.example.com:8080/x", "no url at all", "http://é.example/\r\nWARC-Type: x", "//host/p\tq", "http://a.example.com/" + "k" * 2000]
    found = [(k, rng.choice(urls), rng.choice(big[:4] + small)) for k in range(300)]
    found += [(1000 + k, "http://hot.example.com/", "hot page " * 200) for k in range(300)]  # a third of all rows
    found += [(None, "http://n.example.com/", "x" * 1000), (None, None, "only without an id " * 100), (1299, "http://hot.example.com/", "hot page " * 200), (2000, None, big[4]), (-7, "http://a.example.com/", big[4])]
    found += [(5000 + k, "http://a.example.com/" + "k" * (600 + k), f"page {k}") for k in range(40)]
    rng.shuffle(found)
    return found


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 16)


def archived(spark, tmp_path, found):
    folder = f"file://{tmp_path}/archives"
    return W.build_index(W.write_archives(frame(spark, found), folder), folder)


def test_all_captures_come_back(spark, tmp_path, small_blocks):
    found = rows()
    index = archived(spark, tmp_path, found)
    assert index.directory.count() > 30
    got = index.read(index.lookup(frame(spark, found).select("url"))).collect()
    assert sorted(map(tuple, got), key=repr) == plain(found)


def test_lookup_of_some(spark, tmp_path, small_blocks):
    found = rows(1)
    index = archived(spark, tmp_path, found)
    for asked in (["HTTP://A.Example.com#part"], ["http://hot.example.com", "http://nowhere.example/"], ["http://a.example.com/" + "k" * 620], [""], ["zzz"], []):
        keys = {W.url_key(u) for u in asked}
        got = index.read(index.lookup(spark.createDataFrame([(u,) for u in asked], "u string"))).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((r for r in plain(found) if W.url_key(r[1]) in keys), key=repr)


def test_archives_are_plain_warc(spark, tmp_path):
    found = rows(2)
    archived(spark, tmp_path, found)
    heads, responses = [], {}
    for path in Path(tmp_path, "archives").glob("*.warc.gz"):
        data, at = gzip.decompress(path.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
            assert data[at:].startswith(b"WARC/1.1\r\n") and data[end + 4 + int(head["Content-Length"]) :].startswith(b"\r\n\r\n")
            body = data[end + 4 : end + 4 + int(head["Content-Length"])]
            heads.append(head)
            if head["WARC-Type"] == "response":
                payload = body.split(b"\r\n\r\n", 1)[1]
                assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                responses[head["WARC-Record-ID"]] = payload
            at = end + 4 + len(body) + 4
    assert sum(h["WARC-Type"] != "warcinfo" for h in heads) == len(found)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert hashlib.sha1(responses[h["WARC-Refers-To"]]).digest() == base64.b32decode(h["WARC-Payload-Digest"][5:])


def test_keys_and_candidates():
    key = W.url_key
    assert key("https://Blog.Example.com/a?b#c") == "com,example,blog)/a?b" and key("http://h:8080") == "h:8080)/" and key(None) == key("") == ""
    assert key("http://u:p@h.org:80/@x") == "org,h)/@x" and "\n" not in key("http://h/\n") and "\t" not in key("\t")
    rng = random.Random(4)
    for _ in range(300):
        keys = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 40)))
        blocks = [keys[k : k + 3] for k in range(0, len(keys), 3)]
        for k in {*keys, "", "abab", "b"}:
            met = W.candidates([b[0] for b in blocks], k)
            assert sum(blocks[b].count(k) for b in met) == keys.count(k)


def test_damage_is_seen_and_empty_tables(spark, tmp_path):
    record = W.encode_record(1, "http://a/", b"payload", None, None)
    assert W.decode_record(record)["payload"] == "payload"
    with pytest.raises(ValueError):
        W.decode_record(record.replace(b"payload\r\n", b"pay1oad\r\n"))
    index = archived(spark, tmp_path, [])
    assert index.read(index.lookup(frame(spark, rows()).select("url"))).count() == 0
    index.discard(spark)
    assert not Path(tmp_path, "archives").exists()


def test_the_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    want = plain([(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()])
    got = queries.QUERIES["op13_warc"](spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == [(r[0], *r[2:6]) for r in want]
