import base64
import gzip
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import files, quantised, urls, warc


@pytest.mark.parametrize("tile", [7, 2048])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 12))
    made = []
    for k in range(150):
        made.append((k, (base[k % 25] + rng.normal(size=12) * (0.0 if k % 7 == 0 else 0.1)).astype(np.float32), int(k % 25 % 3)))
    rows = [(k, v.tolist(), y) for k, v, y in made] + [(500, [0.0] * 12, 1), (501, None, 1), (502, made[0][1].tolist(), None), (503, [float("nan")] + [1.0] * 11, 0), (504, [None] + [1.0] * 11, 0), (505, [], 0), (506, made[0][1][:5].tolist(), 0), (3, made[3][1].tolist(), made[3][2]), (None, made[4][1].tolist(), made[4][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    good = [k for k, r in enumerate(rows) if r[2] is not None and r[1] and len(r[1]) == 12 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and unit[j] @ unit[k] >= 0.98] for k in good}
    group = {k: k for k in range(len(rows))}
    for k, near in links.items():
        for j in near:
            a, b = group[k], group[j]
            group = {x: min(a, b) if g in (a, b) else g for x, g in group.items()}
    want = []
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        want.append((r[0], len(links.get(k, [])), min(ids) if ids else None, r[0] is not None and r[0] == min(ids)))
    got = [tuple(r) for r in quantised.embedding_groups(table, tile=tile).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[1] for w in want) > 100
    assert quantised.embedding_groups(table.limit(0)).count() == 0


def brute_links(vectors, labels, cosine):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return {int(y): set(map(tuple, np.argwhere(np.triu(unit[own] @ unit[own].T >= cosine, 1)))) for y in np.unique(labels) for own in [labels == y]}


@pytest.mark.parametrize("size", [3000, 9000])
def test_embedding_recall(spark, size):
    """Diffuse vectors, a third under one label, with pairs just above and below the threshold, and one
    large group of near copies: with production parameters every link is found and none beyond."""
    rng = np.random.default_rng(size)
    base = rng.normal(size=(size, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for k in range(0, size // 3, 2):
        turn = rng.normal(size=64)
        turn -= turn @ base[k] * base[k]
        c = (0.985, 0.9801, 0.9799, 0.995)[k // 2 % 4]
        base[k + 1] = c * base[k] + (1 - c * c) ** 0.5 * turn / np.linalg.norm(turn)
    base[-400:] = base[-400] + 0.008 * rng.normal(size=(400, 64))
    labels = np.where(np.arange(size) // 2 % 3 == 0, 0, np.arange(size) // 2 % 9)
    labels[-400:] = 0
    base = base.astype(np.float32)
    want = brute_links(base.astype(float), labels, 0.98)
    table = spark.createDataFrame([(k, base[k].tolist(), int(labels[k])) for k in range(size)], "vec_id long, embedding array<float>, label int")
    got = quantised.embedding_groups(table).collect()
    found, due = sum(r.n_links for r in got) // 2, sum(map(len, want.values()))
    assert due > 50_000 and 0.999 * due <= found <= due
    small = {r.vec_id: r.n_links for r in got if r.vec_id < size // 3}
    near = {k: 0 for k in small}
    for y, pairs in want.items():
        ids = np.flatnonzero(labels == y)
        for a, b in pairs:
            for k in (int(ids[a]), int(ids[b])):
                if k in near:
                    near[k] += 1
    assert sum(small[k] >= near[k] for k in small) >= 0.998 * len(small) and all(small[k] <= near[k] for k in small)


def test_embeddings_of_any_magnitude(spark):
    rows = [(1, [1e200, 1e199], 0), (2, [1e200, 1e199], 0), (3, [1e-170, 1e-171], 0), (4, [5e-324, 0.0], 1), (5, [3.0, 0.0], 1), (6, [0.0, 0.0], 1), (7, [float("inf"), 1.0], 1)]
    got = quantised.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 0, 7)]


def test_urls(spark):
    asked = ["http://a.example.com/en/1", "https://WWW.Example.com/en/2?q#x", "x://sub.www.example.com/en/", "http://example.net/es/1", "http://net/fr/", "http://notexample.com/en/", "http://com", "http://com/", "http://example.com:80/en/", "no scheme", None, "", "http://", "http://example.org/en/?a=/fr/", "http://x.net/fr#/es/", "a://b://c.com/d", "http://é.com/ü"] * 2
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(asked)] + [(None, asked[0], "", "")], "page_id long, url string, host string, rule string")

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        whole = rest.split("?")[0].split("#")[0]
        host, path = whole.split("/")[0], whole[len(whole.split("/")[0]) :]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(table, urls.rule_table(spark)).collect()}
    assert got == {**{i: plain(u) for i, u in enumerate(asked)}, None: plain(asked[0])}
    assert urls.judge_urls(table.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge_urls(table, urls.rule_table(spark).limit(0), default="block").collect()} == {"block"}
    two = spark.createDataFrame([("example.com", "/en", "allow"), ("example.com", "/en", "block"), ("a.example.com", "/e", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(table.limit(2), two).collect()} == {0: "allow", 1: "block"}


def test_urls_with_long_hosts_and_a_hot_expression(spark):
    labels = ".".join(f"l{k}" for k in range(50_000))
    asked = [f"http://{labels}.example.com/en/" + "p/" * 50_000] + [f"http://h{k}.com/{k}" for k in range(3000)]
    table = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(table, urls.rule_table(spark)).collect()}
    assert got == {0: ("example.com/en/", "block")} | {k: ("com/", "allow") for k in range(1, 3001)}
    assert time.perf_counter() - began < 60


PAGE = "<html><head><title>A &amp;\n B</title><style>p{}</style></head><body><script>if (a<b) '</p>'</script><p>One  <b>two</b><br>three<!-- no --><a HREF='/x y'>link</a><div>&lt;four&gt;<noscript>hid</noscript></div>tail"


def test_plain_text():
    text, title, links = warc.plain_text(PAGE)
    assert (text, title, links) == ("One two\nthreelink\n<four>\ntail", "A & B", ["/x y"])
    assert warc.plain_text("") == ("", "", []) and warc.plain_text("a < b & c")[0] == "a < b & c"
    assert warc.plain_text("a<svg/>b<script src='x'/>c<br/>d")[0] == "abc\nd"
    assert warc.plain_text("<script>never closed <p>x")[0] == ""


def test_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE, "z"), (2, None, None, "z"), (3, "http://c/", "é" * 5000, "z"), (1, "http://a/", PAGE, "z")], "page_id long, url string, html string, block string")
    records = warc.responses(pages)
    made = warc.derive(records, carry="page_id").collect()
    assert Counter((r.page_id, r.warc_type) for r in made) == {(1, "metadata"): 2, (1, "conversion"): 2, (2, "metadata"): 1, (2, "conversion"): 1, (3, "metadata"): 1, (3, "conversion"): 1}
    sources = {r.record_id: r for r in records.collect()}
    for r in made:
        source = sources[r.refers_to]
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        payload = bytes(source.block).split(b"\r\n\r\n", 1)[1]
        assert (r.source_block_digest, r.source_payload_digest, r.block_digest, r.content_length) == (sha(source.block), sha(payload), sha(r.block), len(r.block))
        assert r.target_uri == source.target_uri and f"WARC-Record-ID: {r.refers_to}\r\n" in r.source_headers
    one = {r.warc_type: bytes(r.block).decode() for r in made if r.page_id == 1}
    assert one["conversion"].startswith("One two") and "title: A & B\r\n" in one["metadata"] and "outlink: /x y\r\n" in one["metadata"]
    assert next(r.record_id for r in made if r.page_id == 1 and r.warc_type == "conversion") in one["metadata"]
    assert warc.derive(records.limit(0)).count() == 0
    folder = f"file://{tmp_path}/warc"
    assert sum(r.records for r in warc.write(records, folder).collect()) == 4
    again = warc.derive(warc.read(spark, folder))
    compared = ("refers_to", "record_id", "block_digest", "target_uri", "source_payload_digest")
    assert sorted(repr([r[c] for c in compared]) for r in again.collect()) == sorted(repr([r[c] for c in compared]) for r in made)


def test_through_files(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (None, "http://c/\r\nX: y", "é" * 5000), (1, "http://a/", PAGE)], "page_id long, url string, html string")
    found = warc.through_files(warc.responses(pages), carry="page_id").collect()
    assert Counter((r.page_id, r.warc_type) for r in found) == {(1, "metadata"): 2, (1, "conversion"): 2, (2, "metadata"): 1, (2, "conversion"): 1, (None, "metadata"): 1, (None, "conversion"): 1}
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    for r in found:
        block = bytes(sources[r.refers_to].block)
        assert (r.source_block_digest, r.source_payload_digest, r.block_digest) == (warc.digest(block), warc.digest(block.split(b"\r\n\r\n", 1)[1]), warc.digest(bytes(r.block)))
        assert f"WARC-Record-ID: {r.refers_to}\r\n" in r.source_headers and f"WARC-Block-Digest: {r.source_block_digest}\r\n" in r.source_headers
        assert r.content_length == len(r.block) and r.source_id == r.refers_to
    assert warc.through_files(warc.responses(pages.limit(0)), "page_id").count() == 0


def test_broken_members(spark, tmp_path):
    fields = ([("X-Kept", "1%0A")], "response", "<urn:x>", "u", "d", "c")
    good, cut_short = warc.serialised(b"x" * 100_000, *fields), gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    broken = bytearray(good)
    broken[20:30] = b"0123456789"
    (tmp_path / "a.warc.gz").write_bytes(good + bytes(broken) + good + b"junk" + cut_short + good + good[:-12])
    found = [r.warc_type for r in warc.read(spark, f"file://{tmp_path}").collect()]
    assert found.count("response") == 3 and set(found) == {"response", warc.UNREADABLE} and found.count(warc.UNREADABLE) >= 4
    assert warc.derive(warc.read(spark, f"file://{tmp_path}")).count() == 3
    counted = warc.convert(spark, f"file://{tmp_path}", f"file://{tmp_path}/derived").first()
    assert (counted.records, counted.unreadable) == (3, found.count(warc.UNREADABLE)) and warc.read(spark, f"file://{tmp_path}/derived").count() == 3
    members = [warc.serialised(b"%d" % k, *fields) for k in range(20_000)]
    began = time.perf_counter()
    assert sum(whole for _, whole in warc.members(memoryview(b"".join(members)))) == 20_000
    assert time.perf_counter() - began < 10


def test_large_files_are_read_in_parts(spark, tmp_path):
    """Members of all sizes over parts of 64 KB: one goes through many parts, some hold gzip members
    within them, some are broken; the rows are those of the whole file."""
    rng = random.Random(9)
    fields = ([("X-Page-Id", "7")], "response", "<urn:x>", "u", "d", "c")
    inner = gzip.compress(rng.randbytes(900))
    parts, whole = [], 0
    for k in range(300):
        data = rng.randbytes(rng.choice((0, 10, 3000, 40_000, 90_000 if k % 50 else 700_000)))
        member = bytearray(warc.serialised(data + (gzip.compress(b"not a record" * 9) + inner if k % 7 == 0 else b""), *fields))
        if k % 40 == 3:
            member[len(member) // 2 :] = rng.randbytes(len(member) - len(member) // 2)
        else:
            whole += 1
        parts.append(bytes(member))
    body = b"".join(parts)
    (tmp_path / "in").mkdir()
    for name, content in (("a", body), ("b", body[: len(body) // 2]), ("c", b""), ("d", b"\x1f"), ("e", parts[0])):
        (tmp_path / "in" / f"{name}.warc.gz").write_bytes(content)
    want = Counter()
    for name in "abcde":
        content = (tmp_path / "in" / f"{name}.warc.gz").read_bytes()
        for data, good in warc.members(memoryview(content)):
            found = warc.parsed(data) if good else None
            want[(found[0]["warc-type"], found[2]) if found else (warc.UNREADABLE, data)] += 1
    source, small = f"file://{tmp_path}/in", 1 << 16
    assert files.parts(spark, source, ".warc.gz", small)[0].count() > 50
    got = Counter((r.warc_type, bytes(r.block)) for r in warc.read(spark, source, small).collect())
    counted = {r.file: r for r in warc.convert(spark, source, f"file://{tmp_path}/out", small).collect()}
    again = warc.read(spark, f"file://{tmp_path}/out").count()
    records = lambda c: Counter({k: n for k, n in c.items() if k[0] != warc.UNREADABLE})
    assert records(got) == records(want) and sum(records(want).values()) > whole
    # a broken member's bytes may be cut elsewhere, where a part begins; none is lost
    bytes_of = lambda c: sum(len(k[1]) * n for k, n in c.items() if k[0] == warc.UNREADABLE)
    assert bytes_of(got) == bytes_of(want)
    assert sum(r.records for r in counted.values()) == sum(records(want).values()) == again


def test_stores_that_only_spark_opens(spark, tmp_path, monkeypatch):
    """Files are streamed by Spark's reader of lines, past their codec."""
    fields = ([("X-Kept", "1")], "response", "<urn:x>", "u", "d", "c")
    rng = random.Random(2)
    blocks = [rng.randbytes(rng.choice((0, 5, 30_000))) for _ in range(200)]
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(warc.serialised(b, *fields) for b in blocks[k::3]))
    store = files._store
    monkeypatch.setattr(files, "_store", lambda folder: (_ for _ in ()).throw(ValueError("no such store")))
    rows = warc.read(spark, f"file://{tmp_path}")
    monkeypatch.setattr(files, "_store", store)
    assert Counter(bytes(r.block) for r in rows.collect()) == Counter(blocks)


def test_folders_have_schemes(spark):
    assert files.qualified(spark, "/tmp/x") == "file:/tmp/x" and files.shared_folder(spark, "k").startswith("file:/")
    assert files._store("file:/tmp/x")[1] == "/tmp/x" and files._store("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError):
        files._store("/tmp/x")


def test_files_of_a_size(spark, tmp_path):
    records = warc.responses(spark.range(100).selectExpr("id page_id", "'u' url", "array_join(transform(sequence(1, 100), k -> md5(string(id * 1000 + k))), ' ') html").coalesce(1))
    made = warc.write(records, f"file://{tmp_path}/w", file_bytes=100_000).collect()
    assert len(made) >= 3 and sum(r.records for r in made) == 100 == warc.read(spark, f"file://{tmp_path}/w").count()


def test_http_messages():
    body = gzip.compress(b"<p>hi</p>")
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    status, headers, payload = warc.split_http(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX: a\r\n b\r\n\r\n" + chunked)
    assert status == "HTTP/1.1 200 OK" and ("X", "a b") in headers and payload == b"<p>hi</p>"
    assert warc.split_http(b"no blank line") == ("", [], b"no blank line")
    assert warc.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert warc.decoded(b'<meta charset="windows-1252">\x80', "text/html").endswith("€")
    assert warc.decoded(b"\xff", "text/html; charset=nonsense") == "�"
