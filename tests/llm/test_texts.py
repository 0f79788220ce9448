"""Operators on texts against plain Python versions, with nulls, empty and odd texts and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallyloom.llm import decontam, mixing, simhash, substrings, tokens, toxicity

RNG = random.Random(5)
VOCABULARY = ["the", "of", "and", "Anblewh", "thonre", "été", "über", "x1", "42", "tion"] + [f"w{i}" for i in range(200)]


def words(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


PASSAGE, ITEM = words(60), words(25)
LONG = words(400)
TEXTS = [None, "", " \n\t", "one", "two words", "é" * 30, "aaaa" * 60, "aaaa" * 61, PASSAGE, PASSAGE, words(9) + "  " + PASSAGE + "\n" + words(7), LONG, LONG + " more", LONG.replace("w1", "W1"), LONG[:-5]] + [words(RNG.randint(1, 80)) for _ in range(30)]
TEXTS += [words(5) + " " + ITEM.upper().replace(" ", ", ", 3) + " " + words(4), "tail " + " ".join(ITEM.split()[3:14]), "x" * 49, "x" * 50, "y" + "x" * 50, words(3000)]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i * 3 + 1, t, f"s{i % 4}" if i % 5 else None, 1.5, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*made, made[9], (None, PASSAGE, "s1", 1.0, "z")], "doc_id long, text string, source string, size double, n_words string")


def keyed(rows):
    return sorted(((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in rows), key=repr)


ROWS = [(i * 3 + 1, t) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[9], (None, PASSAGE)]


def test_substrings(spark, docs):
    def removed(doc_id, text):
        earlier = {t[k : k + 50] for i, s in ROWS if i is not None and (doc_id is None or i < doc_id) for t in [(s or "").encode()] for k in range(len(t) - 49)}
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if data[k : k + 50] in earlier:
                gone[k : k + 50] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        return (-1 if doc_id is None else doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())

    want = sorted((removed(*r) for r in ROWS), key=repr)
    for size in (2000, 1 << 20):
        assert keyed(substrings.remove_repeats(docs, group_bytes=size).collect()) == want
    assert sum(w[2] for w in want) > 1000
    with_text = substrings.remove_repeats(docs, text=True, group_bytes=5000).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in with_text)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_substrings_of_rows_without_id_and_of_long_texts(spark, monkeypatch):
    long = " ".join(RNG.choice(VOCABULARY) for _ in range(9000))
    rows = [(None, PASSAGE + f" {k} " + LONG[: 20 * k]) for k in range(60)] + [(7, PASSAGE + "a"), (7, "b" + PASSAGE), (8, "x")] + [(None, "")] * 300
    rows += [(100, long), (101, long[5000:30000] + "tail"), (102, "head" + long[7777:])]
    monkeypatch.setattr(substrings, "PIECE", 4096)
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=3000, group_rows=20).collect()
    want = []
    for i, t in rows:
        data, gone = t.encode(), np.zeros(len(t.encode()), bool)
        earlier = {d[k : k + 50] for j, s in rows if j is not None and (i is None or j < i) for d in [s.encode()] for k in range(len(d) - 49)} if len(data) >= 50 else set()
        for k in range(len(data) - 49):
            if data[k : k + 50] in earlier:
                gone[k : k + 50] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want.append((-1 if i is None else i, len(data), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0, hashlib.sha256(kept).hexdigest()))
    assert keyed(found) == sorted(want, key=repr)


def test_what_groups_send_grows_with_the_text():
    data = np.random.default_rng(3).integers(97, 123, 16 << 20).astype(np.uint8).tobytes()

    def sent(size):
        texts = [data[k : k + 2048] for k in range(0, len(data), 2048)]
        total = 0
        for k in range(0, len(texts), size // 2048):
            own = texts[k : k + size // 2048]
            runs = substrings._runs_of(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), 50, 24)
            group = pa.table([pa.array([1] * len(own)), pa.array(range(len(own))), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.binary()), pa.array(runs, pa.binary())], names=list(substrings.GROUPED))
            blobs = substrings._grams(group, 50, 24, 204).column("blob").to_pylist()
            total += sum(map(len, blobs)) + 36 * len(blobs)
        return total

    assert sent(512 << 10) < 1.3 * sent(8 << 20) < 1.3 * len(data)


@pytest.mark.parametrize("seed", range(4))
def test_refinement_tells_strings_apart(seed):
    data = np.random.default_rng(seed).integers(0, 2 + seed, 400).astype(np.uint8)
    for length in (8, 20, 50):
        buckets = substrings.refined(data, length)
        strings = [data[k : k + length].tobytes() for k in range(len(data) - length + 1)]
        assert len(set(zip(strings, buckets.tolist()))) == len(set(strings)) == len(set(buckets[: len(strings)].tolist()))


def test_simhash(spark, docs):
    def plain(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", lower)
        shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    prints = [plain(t) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min(ROWS[i][0] for i in range(len(ROWS)) if group[i] == g and ROWS[i][0] is not None) for g in set(group)}
    want = sorted(((-1 if ROWS[i][0] is None else ROWS[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(ROWS))), key=repr)
    assert keyed(simhash.simhash_groups(docs).collect()) == want
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [2, 3, 5])
def test_links_find_all_near_fingerprints(spark, distance):
    rng = np.random.default_rng(distance)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = fps[:40].copy()
    for _ in range(distance):
        near ^= np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
    cluster = fps[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # a bucket of many
    every = np.unique(np.concatenate([fps, near, cluster]))
    edges = simhash.fingerprint_links(spark.createDataFrame([(int(f),) for f in every.view(np.int64)], "fp long"), distance).collect()
    assert all((int(np.uint64(r.a & (2**64 - 1))) ^ int(np.uint64(r.b & (2**64 - 1)))).bit_count() <= distance for r in edges)
    label = {int(f): int(f) for f in every.view(np.int64)}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in edges:
        label[find(r.a)] = find(r.b)
    for i, f in enumerate(every):
        for g in every[np.bitwise_count(every ^ f) <= distance]:
            assert find(int(f.view(np.int64))) == find(int(g.view(np.int64)))


def test_decontamination(spark, docs):
    items = [(7, ITEM), (10, "two WORDS!"), (11, None), (12, "..."), (None, PASSAGE), (7, "two words"), (100, " ".join(PASSAGE.split()[20:33]))]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = find(text)
        for k in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    want = []
    for doc_id, text in ROWS:
        w, hit, seen = find(text), set(), set()
        for window, of in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    seen |= of
        want.append((-1 if doc_id is None else doc_id, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, _id string")
    for rows in (decontam.BROADCAST_ROWS, 0):
        assert keyed(decontam.contaminated(docs, benchmark, broadcast_rows=rows).collect()) == sorted(want, key=repr)
    assert not any(r.contaminated for r in decontam.contaminated(docs, benchmark.limit(0)).collect())
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0
    assert sum(w[5] for w in want) >= 5


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("distance", [1, 3])
def test_divided_buckets_keep_links(monkeypatch, distance):
    monkeypatch.setattr(simhash, "_MANY", 16)
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 32, 300, dtype=np.uint64) | np.uint64(5 << 40))
    near = fps.copy()
    for _ in range(distance):
        near ^= np.uint64(1) << rng.integers(0, 32, len(fps), dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, near, fps[0] ^ (np.uint64(1) << np.arange(32, dtype=np.uint64))]))
    groups = simhash._divided(fps, distance)
    together = {(int(a), int(b)) for g in groups for a in g for b in g}
    linked = [(int(a), int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= distance and a < b]
    assert len(linked) > 200 and all(p in together for p in linked)
    assert sum(len(g) ** 2 for g in groups) < len(fps) ** 2 / 4


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements are not equal, alone or as windows."""
    rows, items = [], []
    for n in (1024, 2048, 4096):
        word = thue_morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        items += [(n, word), (n + 1, " ".join([word] * 10))]
        rows += [(n, other), (n + 1, " ".join([other] * 10)), (n + 2, f"x {word.upper()} y")]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in found} == {k: (1, True) if t.startswith("x ") else (0, False) for k, t in rows}
    many = thue_morse(4096)
    letters = spark.createDataFrame([(1, " ".join(many)), (2, " ".join(many.translate(str.maketrans("ab", "ba"))))], "doc_id long, text string")
    window = spark.createDataFrame([(1, " ".join(many))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontam.contaminated(letters, window, window=4096).collect()} == {1: True, 2: False}


def test_windows_that_many_items_share(spark):
    shared = words(12)
    items = spark.createDataFrame([(k, shared + f" only{k}") for k in range(300)], "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame([(k, shared) for k in range(200)], "doc_id long, text string"), items).collect()
    want = hashlib.sha256(",".join(sorted(map(str, range(300)))).encode()).hexdigest()
    assert {(r.n_hit, r.n_items, r.items_sha256) for r in found} == {(12, 300, want)} and len(found) == 200


def test_mixing_agrees_however_rows_lie(spark):
    rows = [(k % 40 if k % 7 else None, words(RNG.randint(1, 60)), f"s{k % 3}") for k in range(600)]
    rows += [(5, "the same words each time", "s1")] * 200
    made = [keyed(mixing.mix(spark.createDataFrame(some, "doc_id long, text string, source string").repartition(n), chunk=50).collect()) for some, n in ((rows, 1), (rows[::-1], 5), (sorted(rows, key=lambda r: r[1]), 3))]
    assert made[0] == made[1] == made[2] and len(made[0]) == 800


@pytest.mark.parametrize("chunk", [5, 2000])
def test_mixing(spark, docs, chunk):
    found = mixing.mix(docs, chunk=chunk).collect()
    assert len(found) == len(ROWS) and keyed(found) == keyed(mixing.mix(docs, chunk=chunk).collect())
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in docs.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_sources, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if weight[s] * level > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
        open_sources -= full
    target |= {s: weight[s] * level for s in open_sources}
    home = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for source in order:
        own = [r for r in found if home[r.doc_id] == source]
        assert {round(r.target, 4) for r in own} == {round(target[source], 4)} and {r.source_size for r in own} == {sizes[source]}
        whole = int(target[source] / sizes[source])
        reachable = {0}
        for r in own:
            reachable |= {v + r["size"] for v in reachable}
        best = min(abs(whole * sizes[source] + v - target[source]) for v in reachable)
        # chunks of a few documents leave few to make up for a long one that is left
        allowed = best + (20 if chunk > len(ROWS) else max(r["size"] for r in own))
        assert abs(sum(r.taken for r in own) - target[source]) <= allowed
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_packed_ids():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 50_000, 2**32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint32)
            ids[rng.random(n) < 0.03] = top - 1
            data = tokens.pack(ids)
            assert (tokens.unpack(data) == ids).all() and len(tokens.unpack(data)) == n
            if n > 1000:
                assert (tokens.unpack(data, 3, 7) == ids[384:896]).all()


def test_an_id_of_most_rows_is_dealt_into_ranges(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rows = [(None if i % 3 else i, f"{words(3)} {i % 50}" if i % 7 else None) for i in range(900)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = tokens.write_tokens(texts, f"file://{tmp_path}/t", path)
    assert {r["part"] for r in made.where("docs > 0").collect()} == {0, 1, 2, 3} and made.agg({"docs": "max"}).first()[0] < 500
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((-1 if doc_id is None else doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert keyed(tokens.read_tokens(spark, f"file://{tmp_path}/t", made).collect()) == sorted(want, key=repr)


def test_token_files(spark, docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    odd = ["<|endoftext|> A", "H\u0331 B\u0331x don't", "a\u00a0b\u2003c\x1cd", "İI ΣΑΣ <|", "ﬁ 12 ,,%%% word."]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted([*ROWS, *((1000 + i, t) for i, t in enumerate(odd))], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((-1 if doc_id is None else doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert keyed(tokens.token_table(more, path).collect()) == sorted(want, key=repr)
    clashing = more.selectExpr("doc_id", "text", "'x' as start", "1 as _id", "'y' as _text", "2 as n_tokens")
    assert keyed(tokens.token_table(clashing, path).collect()) == sorted(want, key=repr)
    assert tokens.token_table(docs.limit(0), path).count() == 0


def test_pieces_with_marks():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    encoder = tokens.Encoder(path, 1)
    marks = ["", ",", "...", "'", "',", "'s", "'s.", "-", "--", "\"", ")", "(", "é", "\u0301", "\u0338", "=\u0338", "…", "…,", "_", "<", "|>", "%'s", "'ll", "’s,", "1", "²,", "!a", "\u00a0,", "Σ", "Σ.", ".Α"]
    words = [a + b + c for a in ("", "word", "don't", "x1", "7", "é", "ΑΣ", "'") for b in marks for c in ("", ".", "'d")]
    RNG.shuffle(words)
    for k in range(0, len(words), 50):
        text = " ".join(words[k : k + 50])
        for _ in range(2):
            ids, counts = encoder.encode([text.encode()])
            assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]


def test_pieces_without_end_are_forgotten(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 1000)
    encoder = tokens.Encoder(path, 1)
    for k in range(20):
        text = f"{k}x" * 200 + " word"
        ids, counts = encoder.encode([text.encode()])
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]
        assert encoder.known.bytes <= 3000


def test_ordinal_likelihood():
    """The fit has no lower penalised likelihood than small steps away from it, and grades follow the
    plain formulas; ties of scores get one grade."""
    rng = np.random.default_rng(9)
    rows, features = 120, 4
    value = rng.random((rows, features)) * (rng.random((rows, features)) < 0.6)
    grade = np.clip((value @ [2.0, 1.0, -1.0, 0.0] + rng.normal(size=rows)).astype(int), 0, 3)
    row, feature = np.nonzero(value)
    weights, cuts = toxicity.fit_ordinal(rows, row, feature, value[row, feature], grade, features, rounds=3000, ridge=1e-2)
    assert (np.diff(cuts) > 0).all()

    def chances(w, c):
        below = 1 / (1 + np.exp(-(c[None, :] - (value @ w)[:, None])))
        return np.diff(np.concatenate([np.zeros((rows, 1)), below, np.ones((rows, 1))], axis=1), axis=1)

    def gain(w, c):
        return np.log(chances(w, c)[np.arange(rows), grade]).mean() - 1e-2 * (w**2).sum() / 2

    best = gain(weights, cuts)
    for k in range(features):
        for step in (-0.05, 0.05):
            assert gain(weights + step * (np.arange(features) == k), cuts) < best
    for k in range(len(cuts)):
        for step in (-0.03, 0.03):
            assert gain(weights, cuts + step * (np.arange(len(cuts)) == k)) < best
    model = toxicity.Ordinal(np.arange(features), weights, cuts)
    score, made = value @ weights, chances(weights, cuts)
    assert np.allclose(model.expected(score), made @ np.arange(made.shape[1]))
    assert (model.likeliest(score) == 1 + made[:, 1:].argmax(axis=1)).all()
    assert len(set(model.likeliest(np.full(5, 1.3)).tolist())) == 1


def test_an_id_that_many_rows_have(spark):
    """One of its texts is looked at, so what reaches the driver is bounded by the sample."""
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, toxic int")
    base = [(i, words(30) + (" idiot moron" if i % 2 else "")) for i in range(60)]
    many = [(i % 60, words(30)) for i in range(600)]
    least = {}
    for i, text in base + many:
        least[i] = min(least.get(i, (b"", "~")), (text.encode(), hashlib.sha256(text.encode()).hexdigest()), key=lambda t: t[1])
    one = toxicity.fit_toxicity(spark.createDataFrame([(i, t[0].decode()) for i, t in least.items()], "doc_id long, text string"), labels)
    all_of = toxicity.fit_toxicity(spark.createDataFrame(base + many, "doc_id long, text string"), labels)
    assert np.array_equal(one.words, all_of.words) and np.allclose(one.weights, all_of.weights) and np.allclose(one.cuts, all_of.cuts)


def test_toxicity(spark):
    insults = ["idiot", "moron", "scumbag", "worthless"]
    made = []
    for i in range(600):
        toxic = i % 5 == 0
        n = RNG.randint(1, 4) if toxic else 0
        text = words(40).split()
        for _ in range(n):
            text.insert(RNG.randrange(len(text)), RNG.choice(insults) + RNG.choice(["", "s", "ic"]))
        made.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(900, None), (901, ""), (902, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i % 2 == 0] + [(0, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    graded = {r.doc_id: r for r in toxicity.grade_toxicity(docs, model).collect()}
    held = [(y, graded[i].toxic) for i, _, y in made if i % 2]
    assert sum(bool(y) == t for y, t in held) / len(held) > 0.97
    assert not any(graded[i].toxic for i in (900, 901, 902))
    assert all((r.grade > 0) == r.toxic == (r.severity >= toxicity.REJECT) and r.grade <= toxicity.GRADES for r in graded.values())
    again = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 20")).unionByName(spark.createDataFrame([(0, words(200_000)), (None, "idiot moron scumbag")], "doc_id long, text string"))
    twice = toxicity.grade_toxicity(again, model).collect()
    assert len(twice) == 42 and all(sum(r.doc_id == k and (r.severity, r.grade) == (graded[k].severity, graded[k].grade) for r in twice) == 2 for k in range(1, 20))
    assert [r.toxic for r in twice if r.doc_id is None] == [True]
    few = [graded[i].severity for i, t, y in made if y and sum(x in t for x in insults) == 1]
    many = [graded[i].severity for i, t, y in made if y and sum(x in t for x in insults) >= 3]
    assert np.mean(many) > np.mean(few)
    assert not any(r.toxic for r in toxicity.grade_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0))).collect())
    assert toxicity.grade_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.grade_toxicity(docs.withColumnRenamed("doc_id", "toxic"), model, id_col="toxic", keep="flag").columns == ["toxic", "text", "flag"]
