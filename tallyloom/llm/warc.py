"""WARC records: responses, and the metadata and plain-text conversions derived from them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import cut

#: Names of records derive from their source's by this namespace, so reruns give the same.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:derived-records")
RECORD = "warc_type string, record_id string, target_uri string, warc_date string, content_type string, headers array<struct<name: string, value: string>>, block binary"
DERIVED = "source_id string, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block binary"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_HREF = re.compile(r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)")
#: Elements whose content isn't text, and elements that end a line.
HIDDEN = frozenset(["script", "style", "noscript", "template", "head", "iframe", "object", "svg", "textarea", "select"])
RAW = frozenset(["script", "style", "iframe", "textarea", "noscript"])
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """(text, title, links) of an HTML page: one line for each block element, blanks joined, character
    references resolved, hidden elements left out. An unclosed hidden element ends with the page, an
    unclosed `head` at `body`, and one whose tag ends in `/>` at once."""
    out, title, links, hidden, at, in_title = [], [], [], [], 0, False
    going = True
    while going:
        going = False
        for found in _TOKEN.finditer(page, at):
            start = found.start()
            if start > at:
                if in_title:
                    title.append(page[at:start])
                elif not hidden:
                    out.append(page[at:start].replace("\n", " "))
            at = found.end()
            closing, name, rest = found.groups()
            if not name:
                continue
            name = name.lower()
            ended = not closing and rest.endswith("/")
            if name == "title":
                in_title = not closing and not ended
            elif name == "a" and not closing and (href := _HREF.search(rest)):
                links.append(html.unescape(next(g for g in href.groups() if g is not None)))
            elif name == "body" and not closing:
                hidden = [h for h in hidden if h != "head"]
            if name in HIDDEN and not ended:
                if closing:
                    if name in hidden:
                        hidden.remove(name)
                elif name in RAW:
                    end = _ENDS[name].search(page, at)
                    at, going = end.end() if end else len(page), True
                    break  # what looks like a tag in there is none
                else:
                    hidden.append(name)
            if name in BREAKS and not hidden:
                out.append("\n")
    if at < len(page):
        (title if in_title else out if not hidden else []).append(page[at:] if in_title else page[at:].replace("\n", " "))
    lines = [" ".join(words) for line in html.unescape("".join(out)).split("\n") if (words := line.split())]
    return "\n".join(lines), " ".join(html.unescape("".join(title)).split()), links


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP message, chunks joined and gzip or deflate undone
    where that works. Without a blank line all is payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    known = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in known.get("transfer-encoding", ""):
        payload = _joined(payload)
    try:
        if "gzip" in known.get("content-encoding", ""):
            payload = gzip.decompress(payload)
        elif "deflate" in known.get("content-encoding", ""):
            payload = zlib.decompress(payload)
    except (OSError, EOFError, zlib.error):
        pass
    return status, headers, payload


def _joined(chunked: bytes) -> bytes:
    parts, at = [], 0
    while (end := chunked.find(b"\r\n", at)) >= 0:
        try:
            size = int(chunked[at:end].split(b";")[0], 16)
        except ValueError:
            return chunked
        if not size:
            return b"".join(parts)
        parts.append(chunked[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(parts) if parts else chunked


def decoded(payload: bytes, content_type: str) -> str:
    """Text in the charset of the header, else of the page's first 1024 bytes, else UTF-8; what
    doesn't decode is replaced."""
    named = _CHARSET.search(content_type.encode("latin-1", "replace")) or _CHARSET.search(payload[:1024])
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _header_lists(column: pa.Array) -> list[list[tuple[str, str]]]:
    """The (name, value) pairs of each record's headers; none for null."""
    flat = column.flatten()
    pairs = list(zip(flat.field("name").to_pylist(), flat.field("value").to_pylist(), strict=True))
    ends = pc.fill_null(pc.list_value_length(column), 0).to_numpy().cumsum().tolist()
    return [pairs[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def _header_array(lists: list[list[tuple[str, str]]]) -> pa.Array:
    pairs = pa.StructArray.from_arrays([pa.array([h[k] for own in lists for h in own], pa.string()) for k in (0, 1)], ["name", "value"])
    bounds = [0]
    for own in lists:
        bounds.append(bounds[-1] + len(own))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)


def _derived(record_id: str | None, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """(type, id, content type, length, digest, source's block digest, payload digest, headers, block) of
    the records that derive from one."""
    status, http_headers, payload = split_http(block)
    known = {n.lower(): v for n, v in http_headers}
    kind = known.get("content-type", "")
    bare = kind.split(";")[0].strip().lower()
    names = {t: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{t} {record_id or ''}')}>" for t in ("metadata", "conversion")}
    warc_headers = "".join(f"{n}: {v}\r\n" for n, v in headers)
    fields, text = [("status", status), *((f"http-header-{n.lower()}", v) for n, v in http_headers), ("payload-length", str(len(payload)))], None
    if bare in ("text/html", "application/xhtml+xml"):
        text, title, links = plain_text(decoded(payload, kind))
        fields += [("title", title), *(("outlink", " ".join(link.split())) for link in links)]
    elif bare == "text/plain":
        text = decoded(payload, kind)
    if text is not None:
        fields.append(("conversion", names["conversion"]))
    made = [("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in fields).encode("utf-8", "replace"))]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    digests = digest(block), digest(payload)
    return [(t, names[t], c, len(b), digest(b), *digests, warc_headers, b) for t, c, b in made]


def derive(records: DataFrame, carry: str | None = None) -> DataFrame:
    """For each response record a `metadata` record and, for HTML and plain text, a `conversion`
    record with the plain text of the payload. Both refer to the source by its id and keep its
    target, date and WARC headers, and the digests of its block and payload; the metadata block
    has the status, all HTTP headers, title and links, and names the conversion.

    Ids derive from the source's, so reruns and repeated records give equal records. Records of
    other types give none; null blocks are empty and give a metadata record alone; an empty table
    gives no rows. Needs the columns of RECORD; others are ignored, but for a long column `carry`
    that derived records take over. One pass, without a shuffle."""
    made = DERIVED + (f", {carry} long" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, headers, blocks = part.column("record_id").to_pylist(), _header_lists(part.column("headers")), part.column("block").to_pylist()
                rows, source = [], []
                for k, (name, own, block) in enumerate(zip(ids, headers, blocks, strict=True)):
                    found = _derived(name, own, block or b"")
                    rows += found
                    source += [k] * len(found)
                taken = part.take(pa.array(source, pa.int32()))
                own = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()))]
                columns = {"source_id": taken.column("record_id"), "warc_type": own[0], "record_id": own[1], "refers_to": taken.column("record_id"), "target_uri": taken.column("target_uri"), "warc_date": taken.column("warc_date"), "content_type": own[2], "content_length": own[3], "block_digest": own[4], "source_block_digest": own[5], "source_payload_digest": own[6], "source_headers": own[7], "block": own[8]}
                yield pa.RecordBatch.from_pydict(columns | ({carry: taken.column(carry)} if carry else {}))

    kept = ("record_id", "target_uri", "warc_date", "headers", "block", *([carry] if carry else []))
    return records.where("warc_type = 'response'").select(*kept).mapInArrow(run, made)


#: The header in which a response carries the number of its page.
CARRIED = "X-Page-Id"


def responses(pages: DataFrame, date: str = "2025-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of crawled pages: the page as the payload of an HTTP message. The id derives
    from the page's id and URL. Null pages are empty; a null id or URL counts as empty in the id.
    Adds the page's id under its name, and in a header of the record."""
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    name = F.md5(F.concat_ws(" ", number, F.coalesce(url_col, F.lit(""))))
    dashed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    record_id = F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.coalesce(v, F.lit("")).alias("value"))
    block = F.concat(head.cast("binary"), body)
    headers = F.array(pair("WARC-Type", F.lit("response")), pair("WARC-Record-ID", record_id), pair("WARC-Target-URI", F.col(url_col)), pair("WARC-Date", F.lit(date)), pair("Content-Type", F.lit("application/http; msgtype=response")), pair("Content-Length", F.octet_length(block).cast("string")), pair(CARRIED, number))
    return pages.select(F.lit("response").alias("warc_type"), record_id.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), F.lit("application/http; msgtype=response").alias("content_type"), headers.alias("headers"), block.alias("block"), id_col)


def header(name: str) -> Column:
    """The value of a record's header; null without it."""
    found = F.filter("headers", lambda h: F.lower(h["name"]) == name.lower())
    return F.get(found, 0)["value"]


def _line(text: str) -> str:
    """A header's value has no line ends."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _one_line(text: str) -> str:
    """Several lines as one, to be undone by `restored`."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


#: Columns of a record, in the order in which `serialised` takes them; those of derived records may be absent.
WRITTEN = ("warc_type", "record_id", "target_uri", "warc_date", "content_type", "refers_to", "source_block_digest", "source_payload_digest", "source_headers")


def serialised(block: bytes | None, headers: list[tuple[str, str]], warc_type: str | None, record_id: str | None, target_uri: str | None, warc_date: str | None, content_type: str | None, refers_to: str | None = None, source_block_digest: str | None = None, source_payload_digest: str | None = None, source_headers: str | None = None, block_digest: str | None = None) -> bytes:
    """One record, headers and block, as a gzip member of its own. A derived record has the digests
    of its source's block and payload, and all headers of its source in one line, under names of their
    own; a record that was read keeps the headers that this has no field for."""
    block = block or b""
    fields = [("WARC-Type", warc_type), ("WARC-Record-ID", record_id), ("WARC-Target-URI", target_uri), ("WARC-Date", warc_date), ("WARC-Refers-To", refers_to), ("WARC-Block-Digest", block_digest or digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    fields += [("X-Source-Block-Digest", source_block_digest), ("X-Source-Payload-Digest", source_payload_digest), ("X-Source-Headers", _one_line(source_headers) if source_headers else None)]
    known = {n.lower() for n, _ in fields}
    fields += [h for h in headers if h[0].lower() not in known]
    fields = [f for f in fields if f[1]]
    head = "".join([f"{n}: {v}\r\n" for n, v in fields])
    if head.count("\n") > len(fields) or head.count("\r") > len(fields):
        head = "".join([f"{n}: {_line(v)}\r\n" for n, v in fields])
    head = f"WARC/1.1\r\n{head}\r\n"
    return gzip.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n", 1, mtime=0)


def _members(batch: pa.RecordBatch) -> Iterator[bytes]:
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        headers = _header_lists(part.column("headers")) if "headers" in part.schema.names else [[]] * part.num_rows
        columns = [part.column(c).to_pylist() if c in part.schema.names else [None] * part.num_rows for c in WRITTEN]
        for block, own, *fields in zip(part.column("block").to_pylist(), headers, *columns, strict=True):
            yield serialised(block, own, *fields)


#: Bytes after which a writer begins another file.
FILE_BYTES = 512 << 20


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records as .warc.gz files of about `file_bytes` bytes, one or more for each partition;
    returns (file, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (member for batch in batches for member in _members(batch))
        part, made, ahead = TaskContext.get().partitionId(), [], next(members, None)

        def filled() -> Iterator[bytes]:
            nonlocal ahead
            size = count = 0
            while ahead is not None and size < file_bytes:
                size, count = size + len(ahead), count + 1
                yield ahead
                ahead = next(members, None)
            made[-1][1] = count

        while ahead is not None:
            name = f"part-{part:06d}-{len(made):04d}.warc.gz"
            made.append([name, 0, 0])
            made[-1][2] = files.put(folder, name, filled())
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return records.mapInArrow(run, "file string, records long, bytes long")


def members(content: memoryview, step: int = 1 << 14) -> Iterator[tuple[bytes, bool]]:
    """(data, whether it is a gzip member) of a file's members, each byte looked at once: after a broken
    member, the bytes up to the next gzip header are one that isn't."""
    at = 0
    while at < len(content):
        member, parts, to = zlib.decompressobj(31), [], at
        try:
            while not member.eof and to < len(content):
                parts.append(member.decompress(content[to : to + step]))
                to += step
            whole = member.eof
        except zlib.error:
            whole = False
        if whole:
            yield b"".join(parts), True
            at = min(to, len(content)) - len(member.unused_data)
            continue
        after = _next_member(content, at + 1, step)
        yield bytes(content[at:after]), False
        at = after


def _next_member(content: memoryview, at: int, step: int) -> int:
    """Where the next gzip header is, or the end."""
    for k in range(at, len(content), step):
        found = bytes(content[k : k + step + 2]).find(b"\x1f\x8b\x08")
        if found >= 0:
            return k + found
    return len(content)


def parsed(data: bytes) -> tuple[dict[str, str], list[tuple[str, str]], bytes] | None:
    """(fields by lower-case name, headers, block) of a record; None if it isn't one whose block is whole."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    headers = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers.append((name.strip(), value.strip()))
    found = {n.lower(): v for n, v in headers}
    length = found.get("content-length", "")
    if not mark or not length.isdigit() or len(rest) < int(length):
        return None
    return found, headers, rest[: int(length)]


class _Part:
    """The members of a part of a file, whose bytes come one after the other.

    A part from a file's middle begins somewhere: its first member is the first gzip header from which a whole
    member with a record follows. What lies before it (`head`) and what is left at the end (`tail`) goes to
    where the parts of a file meet. Not more than one member, or what may be one, is held."""

    def __init__(self, start: int) -> None:
        self.sure, self.broken = start == 0, False
        self.bytes, self.at, self.to = bytearray(), 0, 0
        self._begin(0)
        if not self.sure:
            self.zip = None

    def _begin(self, at: int) -> None:
        self.at = self.to = at
        self.zip, self.parts, self.broken = zlib.decompressobj(31), [], False

    def _step(self, step: int = 1 << 14) -> bool | None:
        """Whether the member from here on is whole; None if that isn't known yet."""
        try:
            while not self.zip.eof and self.to < len(self.bytes):
                self.parts.append(self.zip.decompress(memoryview(self.bytes)[self.to : self.to + step]))
                self.to = min(self.to + step, len(self.bytes))
                if not self.sure and len(begun := b"".join(self.parts[:5])[:5]) == 5 and begun != b"WARC/":
                    return False
        except zlib.error:
            return False
        if not self.zip.eof:
            return None
        self.to -= len(self.zip.unused_data)
        return self.sure or bool(self.parts and b"".join(self.parts[:5])[:5] == b"WARC/")

    def fed(self, data: bytes) -> Iterator[tuple[str, bytes]]:
        self.bytes += data
        while True:
            if self.sure and not self.broken:
                if self.at >= len(self.bytes):
                    break
                whole = self._step()
                if whole is None:
                    break
                if whole:
                    yield "whole", b"".join(self.parts)
                    self._begin(self.to)
                    continue
                self.broken = True
            if self.sure:
                after = self.bytes.find(b"\x1f\x8b\x08", self.at + 1)
                if after < 0:
                    break
                yield "broken", bytes(memoryview(self.bytes)[self.at : after])
                self._begin(after)
                continue
            if self.zip is None:
                found = self.bytes.find(b"\x1f\x8b\x08", self.at)
                if found < 0:
                    self.at = max(self.at, len(self.bytes) - 2)
                    break
                self._begin(found)
            whole = self._step()
            if whole is None:
                break
            if whole:
                yield "head", bytes(memoryview(self.bytes)[: self.at])
                yield "whole", b"".join(self.parts)
                self.sure = True
                self._begin(self.to)
            else:
                self.zip, self.at = None, self.at + 1
        if self.sure and self.at:
            del self.bytes[: self.at]
            self.to, self.at = self.to - self.at, 0

    def ended(self) -> Iterator[tuple[str, bytes]]:
        yield ("tail" if self.sure else "head"), bytes(self.bytes)


#: ((path, start of the part), kind, bytes): a whole or broken member, or what is left before the first or after the last one.
_Events = Iterator[tuple[tuple[str, int], str, bytes]]


def _events(chunks: Callable[[Iterator[pa.RecordBatch]], files.Chunks]) -> Callable[[Iterator[pa.RecordBatch]], _Events]:
    def run(batches: Iterator[pa.RecordBatch]) -> _Events:
        for key, own in itertools.groupby(chunks(batches), lambda c: c[0]):
            part = _Part(key[1])
            for _, data in own:
                yield from ((key, *e) for e in part.fed(data))
            yield from ((key, *e) for e in part.ended())

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> _Events:
    """The events of members that lie in several parts: what is left of one part begins them, and what comes before
    the first member of the next one goes on."""

    def made(key: tuple[str, int], joined: bytes) -> _Events:
        yield from ((key, "whole" if whole else "broken", data) for data, whole in members(memoryview(joined)))

    now, held = None, bytearray()
    for batch in batches:
        for path, tail, data in zip(*[batch.column(c).to_pylist() for c in ("path", "tail", "data")], strict=True):
            if now is not None and (tail or now[0] != path):
                yield from made(now, bytes(held))
                held = bytearray()
            now = (path, -1)
            held += data
    if now is not None:
        yield from made(now, bytes(held))


def _dealt_edges(rows: DataFrame) -> DataFrame:
    """The edges (path, start, tail, data), those of a file in order."""
    return rows.where("data is not null").select("path", "start", "tail", "data").repartition("path").sortWithinPartitions("path", "start", "tail")


#: The type of rows for what isn't a record.
UNREADABLE = "unreadable"
_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-type")
_EDGE = "path string, start long, tail boolean, data binary"


def _records(events):
    """Rows of RECORD, and of _EDGE where a part ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list, edges: list) -> pa.RecordBatch:
            none = lambda n, t: pa.nulls(n, t)
            columns = [pa.array([r[0].get(f) for r in rows] + [None] * len(edges), pa.string()) for f in _FIELDS]
            own = [_header_array([r[1] for r in rows] + [[]] * len(edges)), pa.array([r[2] for r in rows] + [None] * len(edges), pa.binary())]
            ends = [pa.concat_arrays([none(len(rows), t), pa.array([e[k] for e in edges], t)]) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*columns, *own, *ends], ["warc_type", "record_id", "target_uri", "warc_date", "content_type", "headers", "block", "path", "start", "tail", "data"])

        rows, edges, size = [], [], 0
        for (path, start), kind, data in events(batches):
            if kind in ("whole", "broken"):
                rows.append((parsed(data) if kind == "whole" else None) or ({"warc-type": UNREADABLE}, [], data))
            elif data:
                edges.append((path, start, kind == "tail", data))
            size += len(data)
            if len(rows) == 256 or size > 4 << 20:
                yield made(rows, edges)
                rows, edges, size = [], [], 0
        if rows or edges:
            yield made(rows, edges)

    return run


def read(spark: SparkSession, folder: str, part: int = files.PART) -> DataFrame:
    """The records of a folder's .warc.gz files, one gzip member each. What doesn't parse is a row of
    type UNREADABLE with its bytes as block, so it can be counted and nothing derives from it.

    A large file is divided by ranges of `part` bytes, and each part is read as a stream, so memory is that of
    a member and not of a file; members that cross parts are put together by file. A member that holds whole
    records as gzip members, stored as they are, and in which a part begins, may give those, too. The rows are
    stored once."""
    rows, chunks = files.parts(spark, folder, ".warc.gz", part)
    found = cut(rows.mapInArrow(_records(_events(chunks)), f"{RECORD}, {_EDGE}"))
    names = [c for c in found.columns if c not in ("path", "start", "tail", "data")]
    crossing = _dealt_edges(found).mapInArrow(_records(_edges), f"{RECORD}, {_EDGE}")
    return found.where("data is null").select(names).unionByName(crossing.select(names))


def restored(records: DataFrame) -> DataFrame:
    """The columns of derived records that were written and read."""
    lines = header("X-Source-Headers")
    for escaped, plain in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        lines = F.replace(lines, F.lit(escaped), F.lit(plain))
    own = {"source_id": header("WARC-Refers-To"), "warc_type": F.col("warc_type"), "record_id": F.col("record_id"), "refers_to": header("WARC-Refers-To"), "target_uri": F.col("target_uri"), "warc_date": F.col("warc_date"), "content_type": F.col("content_type"), "content_length": F.octet_length("block").cast("long"), "block_digest": header("WARC-Block-Digest"), "source_block_digest": header("X-Source-Block-Digest"), "source_payload_digest": header("X-Source-Payload-Digest"), "source_headers": lines, "block": F.col("block")}
    return records.select(*[c.alias(n) for n, c in own.items()], *[c for c in records.columns if c not in (*own, "headers")])


def _converted(target: str, events):
    """Files of what derives from members, one for each part of a file, and the edges of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), own in itertools.groupby(events(batches), lambda e: e[0]):
            counts, edges = [0, 0], []

            def made(own=own, counts=counts, edges=edges) -> Iterator[bytes]:
                for _, kind, data in own:
                    found = parsed(data) if kind == "whole" else None
                    if kind in ("head", "tail"):
                        edges.append((kind == "tail", data))
                    elif found is None:
                        counts[1] += 1
                    elif found[0].get("warc-type") == "response":
                        fields, headers, block = found
                        name, uri, date, page = (fields.get(f) for f in ("warc-record-id", "warc-target-uri", "warc-date", CARRIED.lower()))
                        for t, own_name, kind_of, _, of_body, of_block, of_payload, lines, body in _derived(name, headers, block):
                            counts[0] += 1
                            yield serialised(body, [(CARRIED, page or "")], t, own_name, uri, date, kind_of, name, of_block, of_payload, lines, of_body)

            file = path.rpartition("/")[2]
            size = files.put(target, f"{file.removesuffix('.warc.gz')}.{'edges' if start < 0 else start}.warc.gz", made())
            edges = [(None, None), *((t, d) for t, d in edges if d)]
            n = len(edges)
            columns = {"file": [file] * n, "records": pa.array([counts[0], *[0] * (n - 1)], pa.int64()), "unreadable": pa.array([counts[1], *[0] * (n - 1)], pa.int64()), "bytes": pa.array([size, *[0] * (n - 1)], pa.int64())}
            columns |= {"path": [path] * n, "start": pa.array([start] * n, pa.int64()), "tail": pa.array([t for t, _ in edges], pa.bool_()), "data": pa.array([d for _, d in edges], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def convert(spark: SparkSession, source: str, target: str, part: int = files.PART) -> DataFrame:
    """Write the records that derive from the responses of the .warc.gz files in `source` to files in
    `target`, one for each part of a file and one for members that cross parts; returns (file, records,
    unreadable, bytes) for each file of `source`. Derived records keep the header CARRIED of their source."""
    schema = f"file string, records long, unreadable long, bytes long, {_EDGE}"
    rows, chunks = files.parts(spark, source, ".warc.gz", part)
    found = cut(rows.mapInArrow(_converted(target, _events(chunks)), schema))
    crossing = _dealt_edges(found).mapInArrow(_converted(target, _edges), schema)
    return cut(found.unionByName(crossing).groupBy("file").agg(*[F.sum(c).alias(c) for c in ("records", "unreadable", "bytes")]))


def through_files(records: DataFrame, carry: str) -> DataFrame:
    """Write response records as WARC files, convert these into files of derived records, and return
    what is read of them, with the long column `carry` that CARRIED holds; the files lie in the shared
    folder meanwhile, and what is read of them is stored.

    A null block is empty and gives a metadata record; a record of another type gives none; repeated records
    give equal records each, and rows have no order, so ties don't matter. A very long block is one member, held whole by
    the task that reads it. An empty table gives no rows; columns that a record doesn't have are ignored."""
    spark = records.sparkSession
    top = files.shared_folder(spark, "warc")
    try:
        made, derived = (files.create(spark, f"{top}/{name}") for name in ("responses", "derived"))
        write(records, made).write.format("noop").mode("overwrite").save()
        convert(spark, made, derived)
        files.remove(spark, made)
        return restored(read(spark, derived).withColumn(carry, header(CARRIED).try_cast("long")))
    finally:
        files.remove(spark, top)
