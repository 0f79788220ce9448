"""The whole result of the WARC query against pages that another parser reads, one at a time."""

import base64
import hashlib
import os
import uuid
from collections import Counter
from html.parser import HTMLParser

import pytest

from tallyloom.llm import queries, warc

DATA = "/root/testdata/sf0.001"


class Page(HTMLParser):
    """Text by lines, title and links, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.title, self.links, self.hidden, self.in_title = [""], "", [], [], False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.links.append(href)
        if tag == "body":
            self.hidden = [h for h in self.hidden if h != "head"]
        if tag in warc.HIDDEN:
            self.hidden.append(tag)
        if tag in warc.BREAKS and not self.hidden:
            self.lines.append("")

    def handle_startendtag(self, tag, attrs):
        if tag in warc.BREAKS and not self.hidden:
            self.lines.append("")
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.links.append(href)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:
            self.hidden.remove(tag)
        if tag in warc.BREAKS and not self.hidden:
            self.lines.append("")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.lines[-1] += data.replace("\n", " ")

    @property
    def text(self):
        return "\n".join(" ".join(line.split()) for line in self.lines if line.split())


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_page(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = Counter()
    for p in pages:
        html = (p.html or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
        key = hashlib.md5(f"{p.page_id} {p.url or ''}".encode()).hexdigest()
        source = f"<urn:uuid:{uuid.UUID(key)}>"
        page = Page()
        page.feed(p.html or "")
        page.close()
        for kind, body in (("conversion", page.text), ("metadata", None)):
            want[p.page_id, kind, source, p.url, sha1(block), sha1(html), body, " ".join(page.title.split()) if body is None else None, tuple(" ".join(x.split()) for x in page.links) if body is None else None] += 1
    got = Counter()
    for r in queries.op1_warc_derivatives(spark, DATA).collect():
        fields = [line.split(": ", 1) for line in r.block.split("\r\n") if ": " in line] if r.warc_type == "metadata" else []
        title = next((v for n, v in fields if n == "title"), "") if r.warc_type == "metadata" else None
        links = tuple(v for n, v in fields if n == "outlink") if r.warc_type == "metadata" else None
        got[r.page_id, r.warc_type, r.refers_to, r.target_uri, r.source_block_digest, r.source_payload_digest, r.block if r.warc_type == "conversion" else None, title, links] += 1
        assert r.block_digest == sha1(r.block.encode()) and r.content_length == len(r.block.encode()) and f"WARC-Block-Digest: {r.source_block_digest}" in r.source_headers
    assert got == want
