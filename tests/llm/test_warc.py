import gzip

from annogrid.llm import warc

PAGE = '<html lang="fr"><head><title>A &amp; B</title><script>x</script></head><body><p>One<p>Two <a href="/x?a=1&amp;b=2">link</a></body></html>'


def rows(spark):
    data = [(1, "http://h/1", PAGE, "x"), (2, None, None, "y"), (3, "http://h/3", "", "z"), (1, "http://h/1", PAGE, "x"), (None, "http://h/é", "é " * 100000, "z")]
    return spark.createDataFrame(data, "page_id long, url string, html string, record string")


def test_derivatives_of_pages(spark):
    pages = rows(spark)
    responses = warc.pages_to_responses(pages)
    by_id = {r.page_id: next(warc.read_records(bytes(r.record))) for r in responses.collect()}
    found = warc.derivatives(responses).collect()
    assert len(found) == 10 and len({r.record_id for r in found}) == 8
    for r in found:
        _, source, block = by_id[r.page_id]
        assert r.refers_to == warc.header(source, "WARC-Record-ID") and r.target_uri == (warc.header(source, "WARC-Target-URI") or None)
        assert r.source_payload_digest == warc.header(source, "WARC-Payload-Digest") == warc.digest(warc.split_http(block)[2])
        assert r.block_digest == warc.digest(bytes(r.block)) and r.content_length == len(r.block)
        (again,) = warc.read_records(bytes(r.record))
        assert again[2] == bytes(r.block) and warc.header(again[1], "WARC-Refers-To") == r.refers_to
    one = {r.warc_type: bytes(r.block).decode() for r in found if r.page_id == 1}
    assert one["conversion"] == "One\nTwo link\n"
    assert "title: A & B\r\n" in one["metadata"] and "outlink: /x?a=1&b=2\r\n" in one["metadata"] and "digest-status: verified\r\n" in one["metadata"]
    assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in one["metadata"] and "language: fr\r\n" in one["metadata"]
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_files(spark, tmp_path):
    responses = warc.pages_to_responses(rows(spark)).repartition(2)
    written = warc.write_warc(responses, str(tmp_path / "a")).collect()
    assert sum(r.records for r in written) == 5
    back = warc.read_warc(spark, str(tmp_path / "a"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in responses.collect())
    assert warc.derivatives(back.withColumnRenamed("offset", "page_id")).count() == 10


def test_odd_records():
    def derived(block, **headers):
        own = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), *((k.replace("_", "-"), v) for k, v in headers.items())]
        return {name: (h, b) for name, h, b in warc.derive(own, block)}

    assert warc.derive([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n") == []
    body = gzip.compress("Grüße".encode("latin-1"))
    chunks = b"%x\r\n%s\r\n%x;ext\r\n%s\r\n0\r\n\r\n" % (5, body[:5], len(body) - 5, body[5:])
    made = derived(b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks)
    assert made["conversion"][1].decode() == "Grüße\n"
    made = derived(b"HTTP/1.0 404 Not Found\nContent-Type: image/png\n\n\x89PNG", WARC_Payload_Digest="sha1:AAAA")
    assert list(made) == ["metadata"] and b"digest-status: mismatch" in made["metadata"][1] and b"http-status: 404" in made["metadata"][1]
    assert warc.header(made["metadata"][0], "WARC-Source-Payload-Digest") == "sha1:AAAA"
    made = derived(b"<p>bare page")
    assert made["conversion"][1] == b"bare page\n"
    record = warc.write_record([("WARC-Type", "response"), ("WARC-Target-URI", "u")], b"x")
    damaged = b"junk WARC/1.0 no\r\n" + record + b"WARC/1.1\r\nContent-Length: bad\r\n\r\n" + record
    assert len(list(warc.read_records(damaged))) == 2
    members = gzip.compress(record) + gzip.compress(record) + b"\x1f\x8bbroken"
    assert [at for at, _, _ in warc.read_records(members)] == [0, len(gzip.compress(record))]
    folded = warc.parse_headers(b"WARC/1.1\r\nA: b\r\n c\r\nbad\r\n\r\n")
    assert folded == [("A", "b c")]


def test_large_archives_take_linear_time():
    import random
    import time

    rng = random.Random(1)
    member = gzip.compress(warc.write_record([("WARC-Type", "response")], rng.randbytes(3000)))

    def seconds(n):
        data, began = member * n, time.perf_counter()
        assert sum(1 for _ in warc.read_records(data)) == n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 16 * max(seconds(1000), 0.02)
    big = warc.write_record([("WARC-Type", "response")], rng.randbytes(300_000))
    assert [len(b) for *_, b in warc.read_records(gzip.compress(big) + member)] == [300_000, 3000]


def test_brute_force_over_a_table(spark):
    """Every derivative of the query's rows again from the pages alone, by the standard library's parser."""
    import hashlib
    import html.parser

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.links, self.words, self.depth = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag in ("title", "script", "style")
            self.links += [dict(attrs).get("href")] * (tag == "a")

        def handle_endtag(self, tag):
            self.depth -= tag in ("title", "script", "style")

        def handle_data(self, data):
            self.words += [] if self.depth else data.split()

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {(r.page_id, r.warc_type): r for r in warc.derivatives(warc.pages_to_responses(pages)).collect()}
    rows = pages.collect()
    assert len(found) == 2 * len(rows)
    for page in rows:
        reader = Reader()
        reader.feed(page.html)
        reader.close()
        info, text = (found[page.page_id, k] for k in ("metadata", "conversion"))
        lines = bytes(info.block).decode().split("\r\n")
        assert [x[9:] for x in lines if x.startswith("outlink: ")] == [" ".join(x.split()) for x in reader.links]
        assert bytes(text.block).decode().split() == reader.words
        payload = page.html.encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        named = lambda data: "sha1:" + __import__("base64").b32encode(hashlib.sha1(data).digest()).decode()
        for r in (info, text):
            assert (r.source_payload_digest, r.source_block_digest, r.block_digest) == (named(payload), named(block), named(bytes(r.block)))
            assert r.refers_to_target_uri == r.target_uri == page.url and r.refers_to_date == r.warc_date and r.content_length == len(r.block)
        assert info.refers_to == text.refers_to and info.concurrent_to == text.record_id and text.concurrent_to == info.record_id
