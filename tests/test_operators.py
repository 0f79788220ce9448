"""Operators on small hand-made tables."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import draws, order, text
from tallyloom.operators import baskets as B
from tallyloom.operators import cooccurrence as C
from tallyloom.operators import coverage, divergence, examples, names, pairs, similarity
from tallyloom.plans import gates


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def decks(spark):
    made = [(f"d{i}", item) for i in range(10) for item in (f"card{i}", f"card{i + 1}", "shared")]
    return spark.createDataFrame([*made, made[0], ("d0", None)], "basket string, item string")


def test_counts_and_staples(decks):
    assert rows(B.staples(decks), "item", "appearances") == [("shared", 10)]
    assert dict(rows(B.appearance_counts(decks), "item", "appearances"))["card1"] == 2


def test_split_is_disjoint_and_repeats(decks):
    first = rows(B.split_baskets(decks), "basket", "split")
    assert first == rows(B.split_baskets(decks), "basket", "split")
    assert Counter(s for _, s in first) == {"train": 8, "test": 2}
    sides = [B.split_baskets(decks).where(F.col("split") == s) for s in ("train", "test")]
    B.assert_no_leak(*sides)
    with pytest.raises(AssertionError):
        B.assert_no_leak(sides[0], sides[0])


def test_temporal_split(spark):
    dated = spark.createDataFrame([(f"d{i}", f"2026-01-{i // 2 + 1:02d}") for i in range(20)] + [("x", None), ("y", "")], "basket string, created_at string")
    found = B.temporal_split(dated).collect()
    assert len(found) == 20 and {r.cutoff for r in found} == {"2026-01-09"}
    assert sum(r.split == "test" for r in found) == 4  # three asked for, ties enlarge
    assert B.temporal_split(dated.where("created_at is null")).collect() == []


@pytest.fixture(scope="module")
def parsed(spark):
    return spark.createDataFrame([("land1", "Basic Land", "clean", None, None), ("spell1", "Sorcery", "gap", None, "effect"), ("spell2", "Instant", "clean", None, None), ("odd", "Instant", "excluded", "layout", None)], "item string, type_line string, status string, exclusion_reason string, gap_category string").withColumn("ok", F.col("status") == "clean").withColumn("encoded", F.col("status").isin("clean", "gap"))


def test_coverage(spark, parsed):
    held = spark.createDataFrame([(f"d{i}", item) for i in range(10) for item in ("land1", "spell1", "spell2")] + [("d0", "lost")], "basket string, item string")
    items = coverage.weighed(parsed, held)
    assert rows(coverage.strata(items), "stratum", "covered", "total") == [("all", 20, 30), ("non_land", 10, 20), ("non_land_non_staple", 0, 0), ("non_staple", 0, 0)]
    shares = coverage.status_share(items).collect()
    assert {r.status for r in shares} == set(coverage.STATUSES) and math.isclose(sum(r.share for r in shares), 1)
    assert rows(coverage.unmatched(parsed, held), "items", "appearances") == [(1, 1)]
    assert rows(coverage.gap_categories(items), "gap_category", "appearances") == [("effect", 10)]
    assert rows(coverage.exclusion_reasons(items), "exclusion_reason", "appearances") == [("layout", 0)]
    assert [r.item for r in coverage.failures(items).collect()] == ["spell1", "odd"]
    heads = coverage.head_breakouts(items, held).collect()
    assert {r["head"] for r in heads} == set(coverage.HEADS) and all(r.n_items == 3 for r in heads)
    assert coverage.judged(items).first().verdict == "FAIL"
    full = gates.run_coverage(parsed, held)
    assert full["verdict"]["verdict"] == "FAIL" and len(full["strata"]) == 4
    none = coverage.weighed(parsed, held.limit(0))
    assert all(r.coverage == 0 for r in coverage.strata(none).collect())


@pytest.mark.parametrize(("cover", "guard", "want"), [(0.69, 0.69, "FAIL"), (0.70, 0.1, "UNRESOLVED"), (0.85, 0.80, "PASS"), (0.90, 0.70, "UNRESOLVED")])
def test_coverage_verdict(spark, cover, guard, want):
    assert spark.range(1).select(coverage.verdict(F.lit(cover), F.lit(guard))).first()[0] == want


def brute_ppmi(decks):
    count, sums = Counter(), Counter()
    for deck in decks:
        for a, b in combinations(sorted(set(deck)), 2):
            count[a, b] += 1
    for (a, b), n in count.items():
        sums[a] += n
        sums[b] += n
    total = 2 * sum(count.values())
    return {k: v for k, n in count.items() if (v := math.log(n * total) - math.log(sums[k[0]]) - math.log(sums[k[1]])) > 0}


@pytest.fixture(scope="module")
def baskets(spark):
    made = [[f"i{(b * k + k * k) % 23:02d}" for k in range(1, 7)] for b in range(60)]
    return made, spark.createDataFrame([(f"b{n}", i) for n, deck in enumerate(made) for i in deck], "basket string, item string")


def test_ppmi_and_positives(spark, baskets):
    made, df = baskets
    want = brute_ppmi(made)
    values = C.ppmi(C.cooccurrence(df)).cache()
    got = {(r.a, r.b): r.ppmi for r in values.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    doubled = sorted([*want.values(), *want.values()])
    at = (len(doubled) - 1) * 0.9
    limit = doubled[int(at)] + (doubled[min(int(at) + 1, len(doubled) - 1)] - doubled[int(at)]) * (at - int(at))
    assert math.isclose(C.percentile(values, "ppmi", 0.9, 2), limit, abs_tol=1e-9)
    some = max(want, key=want.get)
    evals = spark.createDataFrame([(some[1], some[0])], "a string, b string")
    loose, strict = rows(C.positives(values, evals), "a", "b"), rows(C.positives(values, evals, strict=True), "a", "b")
    assert loose == sorted(k for k, v in want.items() if v >= limit - 1e-9 and k != some)
    assert strict == [p for p in loose if not set(p) & set(some)]
    with pytest.raises(ValueError):
        C.ppmi(C.cooccurrence(df.limit(0)))


def test_order_statistics(spark):
    ordered = sorted(i % 977 for i in range(5000))
    values = spark.range(5000).select((F.col("id") % 977).cast("double").alias("v"))
    ranks = [0, 1234, 1235, 4999, 2500]
    assert C.order_statistics(values, "v", ranks, few=20) == [ordered[k] for k in ranks]
    assert C.order_statistics(values, "v", ranks, few=20, size=8, margin=0.001) == [ordered[k] for k in ranks]  # sketches that often miss
    # most values are the same one, or one of two
    heavy = spark.range(40_000).select(F.when(F.col("id") < 30_000, 1.0).when(F.col("id") < 39_000, 2.0).otherwise(F.col("id") * 1.0).alias("v"))
    assert C.order_statistics(heavy, "v", [0, 29_999, 30_000, 38_999, 39_000, 39_999], few=5) == [1.0, 1.0, 2.0, 2.0, 39_000.0, 39_999.0]
    with pytest.raises(IndexError):
        C.order_statistics(values, "v", [5000])


@pytest.mark.parametrize(("values", "share", "frequency", "want"), [
    ([1.0, 2.0, 3.0, math.nan], 1.0, 1, 3.0), ([1.0, 2.0, 3.0, math.nan, None], 0.5, 1, 2.0), ([math.nan], 0.5, 1, None), ([], 0.9, 2, None), ([None], 0.0, 1, None), ([5.0], 1.0, 2, 5.0), ([1.0, 2.0], 0.5, 2, 1.5),
])
def test_percentile_of_odd_values(spark, values, share, frequency, want):
    assert C.percentile(spark.createDataFrame([(v,) for v in values], "v double"), "v", share, frequency) == want


def test_borders(spark, monkeypatch):
    """The n-th ticket, by any number of rounds, with repeated keys."""
    keyed = spark.range(3000).select((F.col("id") % 2500).alias("k")).withColumn("_ticket", draws.ticket(42, "k"))
    ordered = sorted(r["_ticket"] for r in keyed.collect())
    for few in (1000, 1):
        monkeypatch.setattr(draws, "FEW", few)
        for n in (1, 2, 777, 2999):
            at, wanted, equal = draws.border(keyed, n)
            assert (at, wanted, equal) == (ordered[n - 1], n - sum(t < at for t in ordered), ordered.count(at))
        assert draws.border(keyed, 3000) is None and draws.border(keyed.limit(0), 1) is None
        assert draws.border(keyed, lambda total: total // 3)[0] == ordered[999]
    same = spark.range(50).select(F.lit(1).alias("k"), "id")
    assert draws.sample(same, 7, ["k"]).count() == 7
    for made in (B.split_baskets(keyed.select(F.col("k").alias("basket"))), C.cap(keyed.select("k", F.col("k").alias("a"), F.col("k").alias("b")), 40), C.holdout(keyed.select(F.col("k").alias("a"), F.col("k").alias("b")))):
        assert "TakeOrderedAndProject" not in made._jdf.queryExecution().toString() and "TopK" not in made._jdf.queryExecution().toString()


def test_very_large_baskets(spark, monkeypatch):
    """A basket of many chunks: all its pairs once, and no key with more than two chunks of items."""
    monkeypatch.setattr(C, "TILE", 64)
    made = [("big", i) for i in range(700)] + [("big", 3)] + [(f"b{k}", i) for k in range(20) for i in range(k, k + 4)] + [("other", i) for i in range(0, 140, 2)]
    baskets = spark.createDataFrame(made, "basket string, item long")
    want = Counter(p for b in {m[0] for m in made} for p in combinations(sorted({i for c, i in made if c == b}), 2))
    assert {(r.a, r.b): r.n for r in C.cooccurrence(baskets).collect()} == want
    sizes = baskets.distinct().groupBy("basket").agg(F.count("*").alias("size")).where("size > 64")
    met = C._large_pairs(baskets.distinct(), sizes)
    keys = [line for line in met._jdf.queryExecution().toString().split("\n") if "Join Inner" in line and "low" in line]
    assert keys and "high" in keys[0]


def test_negatives_and_phenotypes(spark, baskets):
    made, df = baskets
    want = brute_ppmi(made)
    values = C.ppmi(C.cooccurrence(df)).cache()
    items = sorted({i for d in made for i in d})
    colours = spark.createDataFrame([(i, ["W"] if k % 2 else ["U"]) if k else (i, []) for k, i in enumerate(items)], "item string, colours array<string>")
    evals = spark.createDataFrame([(items[1], items[2])], "a string, b string")
    vocabulary, found = df.select("item").distinct(), C.positives(values, evals)
    for zero in ("ppmi", "count"):
        source = values if zero == "ppmi" else C.cooccurrence(df)
        chosen = rows(C.hard_negatives(source, colours, vocabulary, evals, found, zero=zero), "a", "b")
        assert chosen and len({frozenset(p) for p in chosen}) == len(chosen) and len({a for a, _ in chosen}) == len(chosen)
        assert all(tuple(sorted(p)) not in want and items.index(p[0]) % 2 == items.index(p[1]) % 2 and items[0] not in p for p in chosen)
    vectors = spark.createDataFrame([(i, [math.cos(k), math.sin(k)]) for k, i in enumerate(items[:-1])], "item string, vector array<double>")
    kinds = C.phenotype_pairs(values, vectors, evals, n=5).collect()
    assert Counter(r.kind for r in kinds) == {"positive": 5, "negative": 5} and all(items[-1] not in (r.a, r.b) for r in kinds)
    best = [r.ppmi for r in kinds if r.kind == "positive"]
    assert best == sorted(best, reverse=True)


def test_cap_is_a_repeatable_random_subset(spark):
    pool = spark.range(1000).select(F.format_string("a%04d", "id").alias("a"), F.format_string("b%04d", "id").alias("b"))
    kept = rows(C.cap(pool, 50), "a", "b")
    assert len(set(kept)) == 50 and kept == rows(C.cap(pool, 50), "a", "b") and kept != rows(pool.orderBy("a").limit(50), "a", "b")
    assert kept != rows(C.cap(pool, 50, seed=7), "a", "b")
    assert C.cap(pool, None).count() == C.cap(pool, 0).count() == C.cap(pool, 5000).count() == 1000
    assert Counter(r.split for r in C.holdout(pool).collect()) == {"train": 850, "holdout": 150}


def test_mined_pairs(spark):
    items = spark.createDataFrame([("a", "A", "Deal 1 damage to it."), ("b", "B", "Deal 2 damage to it."), ("c", "C", "Deal 2 damage to it."), ("d", "D", "Deal 1 damage to it."), ("e", "E", None), ("f", "Fox", "Fox runs to the far hills."), ("g", "Gnu", "Gnu runs to the far hills."), ("g", "Gnu", "Gnu runs to the far hills."), ("h", "H", " \n")], "item string, name string, text string")
    assert rows(pairs.numeric_pairs(items), "a", "b") == [("a", "b"), ("a", "c"), ("b", "d")]
    assert rows(pairs.identical_text_pairs(items), "a", "b") == [("f", "g")]
    tags = pairs.tag_index(spark.createDataFrame([("draw", "a"), ("draw", "b"), ("draw", "c"), ("typal-elf", "a"), ("typal-elf", "b"), ("one", "a"), ("pair", "a"), ("pair", "b"), ("", "a")], "slug string, item string"))
    assert rows(tags, "slug", "item") == [("draw", "a"), ("draw", "b"), ("draw", "c"), ("pair", "a"), ("pair", "b")]
    info = spark.createDataFrame([("a", "Instant", 1.0), ("b", "Instant", 2.0), ("c", "Instant — x", 3.0), ("d", "Sorcery", None)], "item string, type_line string, cost double")
    assert rows(pairs.tag_candidates(info, tags), "a", "b", "slug", "n") == [("a", "b", "pair", 2), ("b", "c", "draw", 3)]
    printed = spark.createDataFrame([("a", "Do  it."), ("a", "Do it."), ("a", "Do that."), ("b", "x"), (None, "y")], "item string, printed_text string")
    assert rows(pairs.reprint_pairs(printed), "item", "text_a", "text_b", "wordings") == [("a", "Do it.", "Do that.", 2)]
    known = items.select("item", "name", F.monotonically_increasing_id().alias("ordinal"))
    named = spark.createDataFrame([(" A", "B ", "r"), ("A", "nobody", ""), ("Fox", "Gnu", "same")], "name_a string, name_b string, role string")
    good, lost = pairs.curated_pairs(named, known)
    assert rows(good, "a", "b") == [("a", "b"), ("f", "g")] and rows(lost, "name") == [("nobody",)]
    kept, same = pairs.checked_pairs(named, known, pairs.identical_text_pairs(items))
    assert rows(kept, "a", "b") == [("a", "b")] and rows(same, "a", "b") == [("f", "g")]


def test_names(spark):
    items = spark.createDataFrame([(1, 1, "Fire // Ice"), (2, 2, "Fire // Water"), (3, 3, "Bolt"), (4, 4, "bolt"), (5, 5, None)], "item int, ordinal int, name string")
    asked = spark.createDataFrame([("b1", "FIRE // ICE"), ("b1", "fire"), ("b1", "Fire // Other"), ("b2", "BOLT"), ("b3", "gone")], "basket string, name string")
    found = names.resolve(asked, items)
    assert rows(found.where("item is not null"), "name", "item", "tier") == [("BOLT", 4, "exact"), ("FIRE // ICE", 1, "exact"), ("Fire // Other", 1, "front"), ("fire", 1, "front")]
    stats = names.resolution_stats(found).first()
    assert (stats.n_baskets, stats.n_baskets_resolved, stats.n_unresolved, stats.resolution_rate, stats.unresolved_examples) == (3, 2, 1, 0.8, "gone")


def test_text_expressions(spark):
    one = spark.createDataFrame([("Legendary Creature — Land", "# SPEC_GAP: effect not matched: x", "# UNKNOWN_KEYWORD: Ninjutsu", "# SPEC_GAP: alone")], "t string, g string, u string, n string")
    got = one.select(text.primary_type("t"), text.is_land("t"), text.gap_category("g"), text.gap_category("u"), text.gap_category("n"), text.percent(F.lit(0.4321)), text.percent(F.lit(None).cast("double"))).first()
    assert tuple(got) == ("creature", True, "effect not matched", "UNKNOWN_KEYWORD", "(uncategorized)", "43.2%", "—")
    cdl = spark.createDataFrame([("CARD {\n # SPEC_GAP: DRAW_X: y\n DRAW_CARD { ABC }\n}",)], "c string")
    assert cdl.select(text.constructs("c")).first()[0] == ["ABC", "CARD", "DRAW_CARD"]
    cards = spark.createDataFrame([(["W", "U"], 3.5, "Instant"), ([], None, None), (None, 1.0, "Artifact Land")], "ci array<string>, cost double, t string")
    assert [r[0] for r in cards.select(text.stratum("ci", "cost", "t")).collect()] == ["UW|4-5|instant", "C|0-1|other", "C|0-1|artifact"]


def test_similarity(spark):
    group = [(i, f"g{i % 3}") for i in range(30)] + [(99, "alone")]
    grouping = spark.createDataFrame(group, "item long, grp string")
    asked = spark.createDataFrame([("p", 0, 3), ("q", 1, 2), ("r", 99, 5)], "pair string, a long, b long")
    found = similarity.random_controls(asked, grouping).collect()
    assert Counter((r.pair, r.anchor) for r in found) == {("p", 0): 3, ("p", 3): 3, ("q", 1): 3, ("q", 2): 3, ("r", 5): 3}
    assert all(dict(group)[r.anchor] == dict(group)[r.partner] and r.partner not in {"p": (0, 3), "q": (1, 2), "r": (99, 5)}[r.pair] for r in found)
    assert len({tuple(r) for r in found}) == len(found)
    many = [(f"p{i}", i, i + 1) for i in range(0, 2000, 2)]
    one_group = spark.range(2000).selectExpr("id item", "'g' grp")
    drawn = similarity.random_controls(spark.createDataFrame(many, "pair string, a long, b long"), one_group).collect()
    near = Counter(frozenset(r.partner for r in drawn if r.anchor == a) for a in range(300))
    assert len(drawn) == 6000 and len(near) == 300
    sides = {"substitute": [0.8 + i / 100 for i in range(10)], "random": [i / 100 for i in range(20)]}
    cosines = spark.createDataFrame([(side, f"p{i}", i, i + 1, v) for side, values in sides.items() for i, v in enumerate(values)], "side string, pair string, a long, b long, cosine double")
    wide = similarity.bootstrap(cosines, 2000).first()
    assert wide.ci_low < wide.lift < wide.ci_high and math.isclose(wide.lift, np.mean(sides["substitute"]) - np.mean(sides["random"]))
    again = similarity.bootstrap(cosines.orderBy(F.desc("cosine")).repartition(7), 2000).first()
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(wide, again))
    rng = np.random.default_rng(1)
    plain = [rng.choice(sides["substitute"], 10).mean() - rng.choice(sides["random"], 20).mean() for _ in range(2000)]
    assert np.allclose([wide.ci_low, wide.ci_high], np.quantile(plain, [0.025, 0.975]), atol=0.01)
    empty = similarity.bootstrap(cosines.where("side = 'random'"), 10).first()
    assert empty.lift is None and empty.ci_low is None
    assert similarity.harness(0.72, 0.75)["matches_reference"] and similarity.harness(None, 1.0)["matches_reference"] is None


@pytest.mark.parametrize(("lift", "low", "mined", "want"), [(0.2, 0.1, 0.1, "PASS"), (0.04, 0.01, None, "FAIL"), (0.2, 0.0, None, "FAIL"), (0.06, 0.01, 0.2, "PHENOTYPE_FIT"), (None, None, None, "NO_DATA"), (float("nan"), 0.1, None, "NO_DATA")])
def test_leakage_verdict(spark, lift, low, mined, want):
    value = lambda v: F.lit(v).cast("double")
    assert spark.range(1).select(similarity.verdict(value(lift), value(low), value(mined))).first()[0] == want


TEXTS = {"ring": "R", "signet": "S", "ramp": "P", "reach": "K", "counter": "N", "none": ""}


@pytest.mark.parametrize(("positives", "negatives", "want"), [
    ([("ring", "signet"), ("ramp", "reach")], [], [("R", "S"), ("P", "K")]),
    ([("ring", "signet"), ("ramp", "reach")], [("ring", "counter"), ("ramp", "signet")], [("R", "S", "N"), ("P", "K", "S")]),
    ([("ramp", "reach")], [("ring", "counter")], [("P", "K", "N")]),
    ([("ring", "none"), ("ramp", "reach")], [], [("P", "K")]),
    ([("ring", "signet")], [("ring", "none")], []),
    ([("ring", "none"), ("ramp", "reach")], [("x", "ring"), ("y", "counter")], [("P", "K", "N")]),
])
def test_examples(spark, positives, negatives, want):
    table = lambda p: spark.createDataFrame([(k, *x) for k, x in enumerate(p)], "ordinal long, a string, b string")
    texts = spark.createDataFrame(list(TEXTS.items()), "item string, text string")
    found = examples.training_examples(table(positives), table(negatives) if negatives else None, texts).orderBy("ordinal").collect()
    assert [tuple(r)[1:] for r in found] == want


def test_divergence(spark):
    def parser(value):
        if value == "bad":
            raise RuntimeError("no")
        return (None, "layout") if value == "out" else (f"CARD {{ X {{ {value} }} }}" + ("\n# SPEC_GAP: a: b" if value == "GAP" else ""), None)

    items = spark.createDataFrame([("a", "Ash", "ONE"), ("b", "Bay", "ONE"), ("c", "Cow", "TWO"), ("d", "Dew", "GAP"), ("e", "Elk", "bad"), ("f", "Fox", "out")], "item string, name string, source string")
    encoded = divergence.encode(items, parser, "source").cache()
    assert dict(rows(encoded, "item", "status")) == {"a": "clean", "b": "clean", "c": "clean", "d": "gap", "e": "crash", "f": "excluded"}
    assert encoded.where("item = 'e'").first().error == "RuntimeError: no"
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "zz")], "a string, b string")
    scored = divergence.score_pairs(asked, encoded)
    assert rows(scored.where("both_encoded"), "b", "diverge_rules_loose") == [("b", False), ("c", True), ("d", True)]
    rate = divergence.rates(scored).first()
    assert (rate.n_pairs, rate.n_both_clean, rate.n_both_encoded, rate.clean_rules_loose, rate.upper_bound, rate.underpowered) == (5, 2, 3, 0.5, None, True)
    found = gates.run_divergence({"same_effect_wording": asked.limit(1), "numeric": asked}, encoded)
    assert found["verdict"]["verdict"] == "PARTIAL" and found["verdict"]["numeric"] == 0.5
    assert gates.run_divergence({"same_effect_wording": asked.limit(1)}, encoded)["verdict"]["verdict"] == "PASS (UNDERPOWERED)"


def test_draws_are_md5(spark):
    import hashlib

    got = spark.range(3).select(draws.draw(42, "id")).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) for i in range(3)]


def test_ranges_give_the_global_order(spark):
    values = [(k * 7919 % 1000, k % 3) for k in range(1000)]
    got = rows(order.running(spark.createDataFrame(values, "v long, n long").repartition(5), ["v"], {"before": "n"}), "v", "row", "before")
    ordered, want, total = sorted(values), [], 0
    for k, (v, n) in enumerate(ordered):
        want.append((v, k, total))
        total += n
    assert got == want
    assert rows(examples.numbered(spark.createDataFrame([(3, 1), (1, 2), (1, 1)], "a long, b long"), "a", "b"), "a", "b", "ordinal") == [(1, 1, 0), (1, 2, 1), (3, 1, 2)]


def test_negatives_of_a_group_that_is_nearly_all_barred(spark):
    """One colour of 300 items; the anchor has PPMI with all but two of them."""
    colours = spark.createDataFrame([(i, ["red"]) for i in range(300)], "item long, colours array<string>")
    vocabulary = spark.range(300).withColumnRenamed("id", "item")
    barred = spark.createDataFrame([(a, b, 1.0) for a in range(300) for b in range(a + 1, 300) if (a, b) not in {(5, 77), (5, 140), (8, 9)}], "a long, b long, ppmi double")
    none = spark.createDataFrame([], "a long, b long")
    got = {frozenset(r) for r in C.hard_negatives(barred, colours, vocabulary, none, none).collect()}
    assert frozenset((8, 9)) in got and got <= {frozenset(p) for p in ((5, 77), (5, 140), (8, 9))} and len(got) == 3
    alone = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "item long, colours array<string>")
    assert C.hard_negatives(barred, alone, alone.select("item"), none, none).count() == 0


def test_first_free_places(spark):
    """The least number that isn't taken, within a bitmap and beyond full ones."""
    full = C.BITS
    taken = {"none": [3], "next": [0, 1, 1, 2, 5], "byte": [*range(8), 9], "part": [*range(full)], "gap": [*range(full), *range(2 * full, 3 * full)], "beyond": [*range(full + 77), full + 79], "late": [full, full + 1]}
    rows_ = spark.createDataFrame([(k, p) for k, places in taken.items() for p in places], "k string, place long").repartition(4)
    got = {r["k"]: r["free"] for r in C._first_free(rows_, ["k"]).collect()}
    assert got == {"none": 0, "next": 3, "byte": 8, "part": full, "gap": full, "beyond": full + 77, "late": 0}


def test_identical_texts_beyond_the_cap(spark):
    made = [(k, f"n{k:04}", f"a text that {k // 5} items share") for k in range(4000)]
    items = spark.createDataFrame(made, "item long, name string, text string")
    got = [(r.a, r.b) for r in pairs.identical_text_pairs(items, 100).orderBy("note", "a").collect()]
    by_text = {}
    for k, _, text_of in sorted(made, key=lambda r: (r[2], r[1])):
        by_text.setdefault(text_of, []).append(k)
    assert got == [p for own in by_text.values() for p in zip(own, own[1:])][:100]
