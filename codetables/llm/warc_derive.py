"""Operator 6: WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is its bytes as in a WARC/1.1 file: version line, named headers, empty line, block.  Each response
gives a metadata record (JSON: its WARC and HTTP headers, title, language, links) and a conversion record (plain text),
both of which refer to the response's id and keep its target, date and payload digest.  The headers are kept twice: all fields
in order as pairs (warc-fields, http-fields), and by name (warc-headers, http-headers: of repeated fields the last).
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codetables.llm import files
from codetables.llm.common import batches_of, parallelism, shared_folder, written

VERSION = b"WARC/1.1"
#: Elements whose content isn't text, and those that begin a new line.
HIDDEN = frozenset(("script", "style", "noscript", "template", "svg", "head"))
BLOCKS = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "thead", "tr", "ul")

#: Elements whose content is no markup until their own end tag; of the last two it is text.
RAW = frozenset(("script", "style", "noscript", "title", "textarea"))
#: Elements that a head can hold: any other begins the body, as text does, where </head> is left out.
IN_HEAD = frozenset(("html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"))

_BREAKS = frozenset(x + name for name in BLOCKS for x in ("", "/"))
#: A tag without < or > inside (read at once, up to the next < at most), or the beginning of another mark.
_MARK = re.compile(r"<(?:(/?[a-zA-Z][^\s/><\"']{0,63})(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+(>)|!--|[!?]|(/?[a-zA-Z][^\s/>]{0,63}))")
_STOP = re.compile(r"[>\"']")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_IN_SCRIPT = re.compile(r"<!--|-->|<script(?=[\s/>])|</script(?=[\s/>])[^>]*>?", re.I)
_TITLE, _TITLE_END = re.compile(r"<title", re.I), re.compile(r"</title", re.I)
_HTML, _LANG = re.compile(r"<html", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_ANCHOR, _HREF, _BARE = re.compile(r"<a\s", re.I), re.compile(r"href\s*=\s*", re.I), re.compile(r"[^\s>]+")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(*parts: str) -> str:
    """A name-based id: a repeated task gives the same record the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> list[tuple[str, str]]:
    """Named fields; a line that begins with white space continues the one before it."""
    out: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of one record; the block has the length that its header gives."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = parse_headers(head.partition(b"\r\n")[2])
    length = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), len(rest))
    return headers, rest[:length]


def _script_end(page: str, at: int) -> tuple[int, int] | None:
    """Where a script's end tag is: not the one of a script that is named inside <!-- -->, as HTML has it."""
    comment, inner = False, False
    while m := _IN_SCRIPT.search(page, at):
        at, token = m.end(), m[0].lower()
        if token == "<!--":
            comment, at = True, at - 2  # <!--> is a whole comment
        elif token == "-->":
            comment = inner = False
        elif token == "<script":
            inner = comment
        elif inner:
            inner = False
        else:
            return m.span()
    return None


class _Page:
    """The marks of one page from left to right; what is known not to come any more is not searched again, so the whole takes linear time."""

    def __init__(self, page: str):
        self.page, self.gone, self.open_ended, self.known = page, set(), set(), {}

    def find(self, what: str, at: int) -> int:
        """The next place of a string at or after ``at``, -1 for none; asked for in any order."""
        last = self.known.get(what, (0, -2))
        if last[1] == -2 or not last[0] <= at <= (len(self.page) if last[1] < 0 else last[1]):
            self.known[what] = last = (at, self.page.find(what, at))
        return last[1]

    def stop(self, at: int) -> int:
        """The next >, " or ' at or after ``at``, the page's length for none."""
        last = self.known.get("stop", (0, -1))
        if not last[0] <= at <= last[1]:
            m = _STOP.search(self.page, at)
            self.known["stop"] = last = (at, m.start() if m else len(self.page))
        return last[1]

    def tag_end(self, at: int) -> int:
        """Behind the > that ends a tag, outside quotes; -1 where none does.

        Places from which no > is reached are remembered: a later tag that comes to one of them has none either.
        """
        seen = []
        while (k := self.stop(at)) < len(self.page) and k not in self.open_ended:
            if self.page[k] == ">":
                return k + 1
            seen.append(k)
            at = self.find(self.page[k], k + 1) + 1
            if not at:
                break
        self.open_ended.update(seen)
        return -1

    def mark(self, at: int) -> tuple[int, int, str] | None:
        """(begin, end, lower-case name or '') of the next comment, declaration or tag at or after ``at``."""
        while m := _MARK.search(self.page, at):
            if m[2]:
                return m.start(), m.end(), m[1].lower()
            begin, name = m.start(), (m[3] or "").lower()
            if name:
                end = self.tag_end(m.end())
            elif self.page.startswith("<!--", begin):
                end = self.find("-->", m.end())
                end = end + 3 if end >= 0 else len(self.page)
            else:
                end = self.find(">", m.end()) + 1 or -1
            if end >= 0:
                return begin, end, name
            at = begin + 1
        return None

    def raw_end(self, name: str, at: int) -> tuple[int, int] | None:
        if name == "script":
            return _script_end(self.page, at)
        m = None if name in self.gone else _END[name].search(self.page, at)
        if not m:
            self.gone.add(name)
        return m.span() if m else None


def title_of(page: str) -> str | None:
    m = _TITLE.search(page)
    begin = page.find(">", m.end()) if m else -1
    end = _TITLE_END.search(page, begin) if begin >= 0 else None
    return html.unescape(page[begin + 1 : end.start()]).strip() if end else None


def language_of(page: str) -> str | None:
    """The last lang of the first <html> that has one."""
    at = 0
    while m := _HTML.search(page, at):
        at = page.find(">", m.end())
        at = at if at >= 0 else len(page)
        if found := _LANG.findall(page, m.end(), at):
            return found[-1]
    return None


def links_of(page: str) -> list[str]:
    """Targets of all anchors; a quote without an end belongs to a bare target."""
    p, out, at = _Page(page), [], 0
    while m := _ANCHOR.search(page, at):
        at = p.find(">", m.end())
        at = at if at >= 0 else len(page)
        h = _HREF.search(page, m.end(), at)
        if not h:
            continue
        quote = page[h.end() : h.end() + 1]
        end = p.find(quote, h.end() + 1) if quote and quote in "\"'" else -1
        if end >= 0:
            out.append(page[h.end() + 1 : end])
            at = end + 1
        elif bare := _BARE.match(page, h.end()):
            out.append(bare[0])
            at = bare.end()
    return [html.unescape(x) for x in out]


def plain_text(page: str) -> str:
    """Text of a page: hidden elements dropped, a line per block element, references resolved, spaces joined."""
    out, at, head, hidden, depth = [], 0, False, None, 0
    p = _Page(page)
    while mark := p.mark(at):
        begin, end, name = mark
        text, at = page[at:begin], end
        if head and (hidden in (None, "noscript") and name == "body" or name == "/head"):
            head, hidden = False, None
        elif head and hidden is None and (text.strip(" \t\n\f\r") or name in ("/body", "/html", "/br") or name[:1] not in ("", "/") and name not in IN_HEAD):
            head = False
            out.append(text)
        elif not head and hidden is None:
            out.append(text)
        shown = not head and hidden is None
        opens = page[end - 2 : end] != "/>"
        if name in RAW and opens:
            stop = p.raw_end(name, at)
            if stop or name in ("script", "style"):
                begin, (stop, at) = at, stop or (len(page), len(page))
                if shown and name not in HIDDEN:
                    out.append(page[begin:stop])
            elif name == "noscript":
                hidden, depth = hidden or name, depth or 1
        elif hidden is not None:
            if name == hidden and opens:
                depth += 1
            elif name == "/" + hidden:
                depth -= 1
                hidden = hidden if depth else None
        elif name == "head" and opens:
            head = True
        elif name in HIDDEN and opens:
            hidden, depth = name, 1
        elif shown and name in _BREAKS:
            out.append("\n")
    if hidden is None and (not head or page[at:].strip(" \t\n\f\r")):
        out.append(page[at:])
    lines = _SPACE.sub(" ", html.unescape("".join(out))).split("\n")
    return "\n".join(y for x in lines if (y := x.strip()))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """source_id, record BINARY: a WARC response record per page.

    A null url or page counts as empty; pages of any length are kept whole; repeated rows give records of equal ids, null ids their own;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for i, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (page or "").encode("utf-8")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                target = " ".join((url or "").split())  # a header is one line
                out.append(record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(i), target, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(http)), ("WARC-Payload-Digest", digest(body))], http))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["source_id", "record"])

    small = pages.select(F.col(id_col).cast("long").alias("source_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return small.mapInArrow(run, "source_id long, record binary")


_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]+)[ \t]*(?:;[^\r\n]*)?\r?\n")


def unchunked(data: bytes) -> bytes:
    """The body that chunks carry, as far as they go; data that doesn't begin with a chunk was undone by the crawler and stays."""
    out, at = [], 0
    while m := _CHUNK.match(data, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(data[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] == b"\n"
    return b"".join(out) if m or at else data


def _inflated(data: bytes, wbits: int) -> bytes | None:
    """What zlib gives for all members, as far as the data goes; None where it doesn't begin as such."""
    out = []
    while data:
        z = zlib.decompressobj(wbits)
        part = []
        try:
            for i in range(0, len(data), 1 << 16):
                part.append(z.decompress(data[i : i + (1 << 16)]))
                if z.eof:
                    break
            else:
                part.append(z.flush())
        except zlib.error:
            if not out and not any(part):
                return None
            return b"".join([*out, *part])
        out += part
        data = z.unused_data + data[i + (1 << 16) :] if z.eof and wbits == 31 else b""
    return b"".join(out)


def decoded(body: bytes, codings: list[str]) -> tuple[bytes | None, list[str]]:
    """(the body without its content codings, those that were not undone): None where one is not gzip or deflate.

    A body that isn't in the coding that its header names was decoded by the crawler and stays.
    """
    for k in range(len(codings) - 1, -1, -1):
        name = codings[k]
        if name in ("gzip", "x-gzip"):
            got = _inflated(body, 31)
        elif name == "deflate":  # with zlib's header, or as some servers send it, without
            got = _inflated(body, 15)
            got = _inflated(body, -15) if got is None else got
        elif name in ("identity", ""):
            continue
        else:
            return None, codings[: k + 1]
        body = body if got is None else got
    return body, []


def _codings(http: list[tuple[str, str]], field: str) -> list[str]:
    return [x.strip().lower() for k, v in http if k.lower() == field for x in v.split(",")]


def is_response(data: bytes) -> bool:
    fields = parse_headers(data.partition(b"\r\n\r\n")[0].partition(b"\r\n")[2])
    return any(k.lower() == "warc-type" and v.lower() == "response" for k, v in fields)


DERIVED = "source_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, record binary"
_NAMES = [f.split()[0] for f in DERIVED.split(", ")]


def derivatives(data: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response record, each as a row of DERIVED without source_id.

    A body in a coding other than gzip, deflate and chunked gives no title, language, links or text; the metadata names the
    coding (not-decoded).
    """
    headers, block = parse(data)
    of = {k.lower(): v for k, v in reversed(headers)}
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, body = b"", block
    http = parse_headers(head.partition(b"\r\n")[2])
    if "chunked" in _codings(http, "transfer-encoding"):
        body = unchunked(body)
    codings = [x for x in _codings(http, "transfer-encoding") if x != "chunked"]
    plain, left = decoded(body, [*_codings(http, "content-encoding"), *codings])
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html")
    charset = (re.search(r"charset=[\"']?([\w-]+)", kind) or [None, "utf-8"])[1]
    try:
        page = (plain or b"").decode(charset, "replace")
    except (LookupError, UnicodeError):  # no such charset, or one that Python has under that name for other uses
        page = (plain or b"").decode("utf-8", "replace")
    payload = of.get("warc-payload-digest") or digest(body)
    source, target, date = of.get("warc-record-id", ""), of.get("warc-target-uri", ""), of.get("warc-date", "")
    facts = {"warc-headers": dict(headers), "warc-fields": headers, "http-status": head.partition(b"\r\n")[0].decode("utf-8", "replace"), "http-headers": dict(http), "http-fields": http, "not-decoded": left, "payload-length": len(body), "payload-digest": payload, "title": title_of(page), "lang": language_of(page), "links": links_of(page)}
    rows = []
    for name, content_type, content in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "surrogatepass"))):
        own = record_id(name, source, payload)
        fields = [("WARC-Type", name), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Target-URI", target), ("WARC-Date", date), ("Content-Type", content_type), ("WARC-Block-Digest", digest(content)), ("WARC-Payload-Digest", payload)]
        rows.append((name, own, source, target, date, content_type, len(content), digest(content), payload, record(fields, content)))
    return rows


def derive(records: DataFrame) -> DataFrame:
    """Two rows of DERIVED per row of source_id, record; no shuffle.

    An empty payload gives an empty conversion; repeated records give repeated rows of equal ids; records
    that aren't responses, and null ones, are left out.  Pages of any length are read whole, in time linear in their length.  Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if k in ("source_id", "content_length") else pa.binary() if k == "record" else pa.string() for k in _NAMES]

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [(i, *row) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if data and is_response(data) for row in derivatives(data)]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

        return batches_of(rows, make, 200)

    return records.select("source_id", "record").mapInArrow(run, DERIVED)


def write_files(records: DataFrame, folder: str) -> DataFrame:
    """Write records as .warc.gz files, a gzip member each; file, offset and length of each as in a CDX, with all other columns of ``records``."""
    rest = [f for f in records.schema.fields if f.name not in ("record", "file", "offset", "length")]
    names = [f.name for f in rest]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = None, None, 0
        for batch in rows:
            if batch.num_rows and out is None:
                name, out = files.new_file(folder, "derived", ".warc.gz")
            offsets, lengths = [], []
            for data in batch.column(0).to_pylist():
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = z.compress(data) + z.flush()
                out.write(packed)
                offsets.append(at)
                lengths.append(len(packed))
                at += len(packed)
            yield pa.record_batch([*batch.columns[1:], pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], [*names, "file", "offset", "length"])
        if out is not None:
            out.close()

    schema = StructType([*rest, *StructType.fromDDL("file string, offset long, length long").fields])
    return written(records.select("record", *names).mapInArrow(run, schema), "warc-index")


#: Bytes of a file that one task reads, and records that it hands on at once.
SPAN, MANY = 64 << 20, 100


def read_files(folder: str, index: DataFrame) -> DataFrame:
    """The rows of an index of write_files, with record BINARY in place of offset and length: each record by one ranged read, in order."""
    names = [c for c in index.columns if c not in ("file", "offset", "length")]
    types = [f for f in index.schema.fields if f.name in names]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files.store(folder)
        name, f = None, None
        for batch in rows:
            for begin in range(0, batch.num_rows, MANY):
                part, out = batch.slice(begin, MANY), []
                for other, offset, length in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    if other != name:
                        name, f = other, fs.open_input_file(f"{path}/{other}")
                    f.seek(offset)
                    out.append(zlib.decompress(f.read(length), 31))
                yield pa.record_batch([part.column(0), *part.columns[3:], pa.array(out, pa.binary())], ["file", *names, "record"])

    span = F.floor(F.col("offset") / SPAN)
    dealt = index.select("file", "offset", "length", *names).repartition(parallelism(index.sparkSession), "file", span).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, StructType([*StructType.fromDDL("file string").fields, *types, *StructType.fromDDL("record binary").fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    index = write_files(derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))), folder)
    return read_files(folder, index).select(F.col("source_id").alias("page_id"), *_NAMES[1:-1], F.decode("record", "UTF-8").alias("record"))
