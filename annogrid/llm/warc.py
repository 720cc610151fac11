"""WARC archives: reading, writing, and the derivative builder.

From each response record the builder makes a metadata record (application/warc-fields: status, the source's HTTP
headers, title, links) and, where the payload is text, a plain-text conversion record. Both name the response in
WARC-Refers-To, with its target URI and date, and keep the source's payload digest; block digests are computed anew.
Record ids are derived from the source's id, so that a task that runs again makes the same records.

Defined results: a record that isn't a response has no derivatives; a response without an HTTP head is all payload; a
payload that is neither HTML nor plain text has a metadata record only; a wrong digest is noted in the metadata
(digest-status: mismatch), a missing one is computed and noted as computed; a response without a record id gets one
from its content; null pages make responses with an empty payload; repeated rows make repeated records; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annogrid.llm.common import map_batches
from annogrid.llm.markup import parse, text_of, walk

VERSION = "WARC/1.1"
#: Not shown text of a page.
HIDDEN = frozenset("script style noscript template iframe textarea select object svg head title".split())
_HEADER = re.compile(rb"(?:WARC/\d\.\d|HTTP/\d(?:\.\d)?)[^\r\n]*\r?\n(?:[^\r\n]+\r?\n)*\r?\n")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_holds(named: str, data: bytes) -> bool | None:
    """Whether a digest as it stands in a header fits; None if its algorithm is unknown."""
    algorithm, _, value = named.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own, value = hashlib.new(algorithm, data).digest(), value.strip()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def derived_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(names))}>"


def parse_headers(block: bytes) -> list[tuple[str, str]]:
    """Header lines in order; a line that begins with a space goes on from the one before."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def header(headers: list[tuple[str, str]], name: str, default: str = "") -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in headers if k.lower() != "content-length"), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Bytes of a file that are decompressed at a time.
FEED = 1 << 16


def _members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The parts of a file and their offsets: each gzip member, or all of it. Every byte is looked at a bounded number of times."""
    at = 0
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            at = data.find(b"\x1f\x8b", at)
            if at < 0:
                return
        stream, parts, end = zlib.decompressobj(31), [], at
        try:
            while end < len(data) and not stream.eof:
                parts.append(stream.decompress(view[end : end + FEED]))
                end = min(len(data), end + FEED)
        except zlib.error:
            at += 2
            continue
        yield at, b"".join(parts)
        if not stream.eof:
            return
        at = end - len(stream.unused_data)


def read_records(data: bytes) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
    """Offset (of the gzip member, or in the file), headers and block of each record; damaged stretches are skipped."""
    for base, part in _members(data):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            m = _HEADER.match(part, at)
            if not m:
                at += 5
                continue
            headers = parse_headers(m[0])
            size = header(headers, "Content-Length")
            if not size.isdigit():
                at = m.end()
                continue
            yield base if part is not data else at, headers, part[m.end() : m.end() + int(size)]
            at = m.end() + int(size)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response block."""
    m = _HEADER.match(block)
    if not m:
        return "", [], block
    line = m[0].split(b"\n", 1)[0].decode("latin-1").strip()
    return line, parse_headers(m[0]), block[m.end() :]


def decoded(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without transfer and content encodings; as it is where they don't hold."""
    if header(headers, "Transfer-Encoding").lower() == "chunked":
        out, at = [], 0
        while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r?\n").match(payload, at):
            n = int(m[1], 16)
            out.append(payload[m.end() : m.end() + n])
            at = m.end() + n + (2 if payload[m.end() + n : m.end() + n + 2] == b"\r\n" else 0)
            if not n:
                break
        payload = b"".join(out) if out else payload
    coding = header(headers, "Content-Encoding").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if coding == "deflate":
            return zlib.decompress(payload)
    except (OSError, EOFError, zlib.error):
        pass
    return payload


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """The derivatives of one record: type, headers and block of each."""
    if header(headers, "WARC-Type").lower() != "response":
        return []
    source = header(headers, "WARC-Record-ID") or derived_id("response", header(headers, "WARC-Target-URI"), digest(block))
    uri, date = header(headers, "WARC-Target-URI"), header(headers, "WARC-Date")
    line, http, payload = split_http(block)
    named = header(headers, "WARC-Payload-Digest")
    held = digest_holds(named, payload) if named else None
    status = "computed" if not named else {True: "verified", False: "mismatch", None: "unknown"}[held]
    kind = header(http, "Content-Type", "text/html" if not http else "application/octet-stream")
    media = kind.split(";")[0].strip().lower()
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    body = decoded(http, payload)
    fields = [("http-status", line.split(" ")[1] if line.count(" ") else ""), ("http-status-line", line), ("content-type", kind)]
    fields += [("digest-status", status), ("payload-length", str(len(payload)))]
    text = None
    if media in ("text/html", "application/xhtml+xml", "text/plain"):
        declared = charset or media != "text/plain" and re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", body[:2048], re.I)
        encoding = (declared[1] if charset else declared[1].decode("latin-1")) if declared else "utf-8"
        try:
            plain = body.decode(encoding, "replace")
        except (LookupError, UnicodeError):
            encoding = "utf-8"
            plain = body.decode(encoding, "replace")
        fields.append(("charset-used", encoding.lower()))
        if media == "text/plain":
            text = plain
        else:
            root = parse(plain)
            title = next((" ".join("".join(x for x in n.children if type(x) is str).split()) for n in walk(root) if n.tag == "title"), "")
            language = next((n.attributes().get("lang", "") for n in walk(root) if n.tag == "html"), "")
            links = [n.attributes().get("href", "") for n in walk(root) if n.tag == "a" and "href" in n.attributes()]
            fields += [("title", title), ("language", language)] + [("outlink", " ".join(html.unescape(x).split())) for x in links]
            text = "\n".join(text_of(root, lambda n: n.tag in HIDDEN))
    fields += [("http-header", f"{k}: {v}") for k, v in http]
    refers = [("WARC-Refers-To", source)]
    refers += [("WARC-Refers-To-Target-URI", uri)] if uri else []
    refers += [("WARC-Refers-To-Date", date)] if date else []
    common = ([("WARC-Target-URI", uri)] if uri else []) + ([("WARC-Date", date)] if date else [])
    kept = [("WARC-Source-Payload-Digest", named or digest(payload)), ("WARC-Source-Block-Digest", header(headers, "WARC-Block-Digest") or digest(block))]
    info = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    made = [("metadata", "application/warc-fields", info)]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass") + (b"\n" if text else b"")))
    ids = {name: derived_id(name, source) for name, *_ in made}
    out = []
    for name, content_type, data in made:
        others = [("WARC-Concurrent-To", ids[x]) for x in ids if x != name]
        own = [("WARC-Type", name), ("WARC-Record-ID", ids[name]), *common, *refers, *others, *kept, ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type)]
        out.append((name, own, data))
    return out


def page_response(url: str | None, page: str | None, date: str, key: str = "") -> tuple[list[tuple[str, str]], bytes]:
    """A response record for a page that was fetched without its archive."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", derived_id("response", url or "", key, digest(payload)))]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return headers, block


def pages_to_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): a whole response record for each page."""
    id_type = dict(pages.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        made = [write_record(*page_response(url, page, date, str(i))) for i, url, page in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [id_col, "record"])

    return map_batches(pages.select(id_col, url_col, html_col), run, f"`{id_col}` {id_type}, record binary")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """A row for each derivative of the records in a binary column: its headers' main values, its block and the whole record."""
    id_type = dict(records.dtypes)[id_col]
    names = {
        "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
        "concurrent_to": "WARC-Concurrent-To", "source_payload_digest": "WARC-Source-Payload-Digest",
        "source_block_digest": "WARC-Source-Block-Digest", "refers_to_target_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type",
    }

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, columns, blocks, sizes, whole = [], {k: [] for k in names}, [], [], []
        for k, data in enumerate(batch.column(1).to_pylist()):
            for _, headers, block in read_records(data or b""):
                for _, own, made in derive(headers, block):
                    places.append(k)
                    for column, name in names.items():
                        columns[column].append(header(own, name) or None)
                    blocks.append(made)
                    sizes.append(len(made))
                    whole.append(write_record(own, made))
        ids = batch.column(0).take(pa.array(places, pa.int64()))
        arrays = [pa.array(v, pa.string()) for v in columns.values()]
        return pa.RecordBatch.from_arrays([ids, *arrays, pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary()), pa.array(whole, pa.binary())], [id_col, *names, "content_length", "block", "record"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{x} string" for x in names) + ", content_length long, block binary, record binary"
    return map_batches(records.select(id_col, record_col), run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, record) of every record in the .warc and .warc.gz files at a path that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc{,.gz}").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, at, write_record(headers, block)) for at, headers, block in read_records(data)]
                for k in range(0, len(rows), 256):
                    part = list(zip(*rows[k : k + 256], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())], ["path", "offset", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, offset long, record binary")


def write_warc(records: DataFrame, folder: str, record_col: str = "record") -> DataFrame:
    """Write one .warc.gz file for each partition into a folder that all executors mount; (file, records) of each.

    A file gets its name by renaming, so that a task that runs again replaces it. The rows must be collected or written
    for the files to be made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, name, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/.{name}", "wb") as out:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    out.write(gzip.compress(record, mtime=0))
                    n += 1
        final = f"{folder}/part-{number:05d}.warc.gz"
        os.replace(f"{folder}/.{name}", final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], ["file", "records"])

    return records.select(F.col(record_col)).mapInArrow(run, "file string, records long")
