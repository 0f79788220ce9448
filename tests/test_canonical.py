"""Canonical forms must not depend on what doesn't matter, and must on what does."""

import pytest

from tallyloom.operators import divergence
from tallyloom.operators.canonical import FORMS, canonical, canonical_column, forms, lexemes, parse, truncated_column


def spell(effect: str) -> str:
    return "CARD {\n  SPELL {\n    EFFECT: [\n      %s\n    ]\n  }\n}" % effect


SAME = [
    (spell('AND { TYPE: "Basic" TYPE: "Land" }'), spell('AND { TYPE: "Land" TYPE: "Basic" }'), {}),
    (spell("SEARCH { ZONE: L } AS $found;\nMOVE { $found TO: H }"), spell("SEARCH { ZONE: L } AS $x;\nMOVE { $x TO: H }"), {}),
    (spell("USE { $a AND $ab }"), spell("USE { $p AND $q }"), {}),
    ('CARD {\nNAME: "Foo"\nMANA_COST: "{1}"\n}', 'CARD {   NAME:    "Foo"\n\n\nMANA_COST:  "{1}"   }', {"scope": "full"}),
    ('CARD {\n NAME: "A"\n MANA_COST: "{1}"\n X { COST: TAP }\n}', 'CARD {\n NAME: "B"\n MANA_COST: "{2}"\n X { COST: TAP }\n}', {}),
    ('CARD {\n SUBTYPES: ["Frog"]\n T { E: {} }\n}', 'CARD {\n SUBTYPES: ["Robot", "Scorpion"]\n T { E: {} }\n}', {}),
    (spell("DRAW { COUNT: 2 }"), spell("DRAW { COUNT: 3 }"), {"mask_numbers": True}),
    (spell('ADD { "{U}{B}" }'), spell('ADD { "{U}{R}" }'), {"mask_symbols": True}),
    (spell('ADD { CHOICE ["{R/W}"] }'), spell('ADD { CHOICE ["{B/G}"] }'), {"mask_symbols": True}),
    (spell("PAINT { white }"), spell("PAINT { Black }"), {"mask_symbols": True}),
    ('CARD {\n  # SPEC_GAP: effect: something\n  X { A }\n}', "CARD {\n  X { A }\n}", {}),
    (spell("DRAW { 1 };\nDISCARD { 1 }"), spell("DISCARD { 1 };\nDRAW { 1 }"), {"sort_all": True}),
]
DIFFERENT = [
    (spell("DRAW { 1 };\nDISCARD { 1 }"), spell("DISCARD { 1 };\nDRAW { 1 }"), {}),
    (spell("DRAW { 1 }"), spell("DESTROY { 1 }"), {}),
    ('CARD {\n SUBTYPES: ["Frog"]\n}', 'CARD {\n SUBTYPES: ["Robot"]\n}', {"scope": "full"}),
    (spell("DRAW { COUNT: 2 }"), spell("DRAW { COUNT: 3 }"), {}),
    (spell('ADD { "{W/P}" }'), spell('ADD { "{U/P}" }'), {"mask_symbols": True}),  # a gap that is kept by default
]


@pytest.mark.parametrize(("a", "b", "options"), SAME)
def test_same(a, b, options):
    assert canonical(a, **options) == canonical(b, **options)


@pytest.mark.parametrize(("a", "b", "options"), DIFFERENT)
def test_different(a, b, options):
    assert canonical(a, **options) != canonical(b, **options)


def test_names_scopes_and_brackets():
    a, b = 'CARD { NAME: "Foo" S { TARGET: "Foo" } }', 'CARD { NAME: "Bar" S { TARGET: "Bar" } }'
    assert canonical(a, name="Foo", scope="full") == canonical(b, name="Bar", scope="full")
    assert canonical(spell('ADD { "{W/P}" }'), mask_symbols=True, wider_symbols=True) == canonical(spell('ADD { "{U/P}" }'), mask_symbols=True, wider_symbols=True)
    with pytest.raises(ValueError):
        canonical(a, scope="some")
    assert parse("A { B } } C")[1] and not parse("A { B { C")[1]
    assert canonical("A } B") == "A"
    assert canonical(None) == ""


def test_columns(spark):
    rows = spark.createDataFrame([("CARD { X { A } }", "n"), (None, None), ("A } B", "n")], "cdl string, name string")
    found = rows.select(canonical_column("cdl", "name").alias("c"), truncated_column("cdl").alias("t")).collect()
    assert [(r.c, r.t) for r in found] == [("CARD{X{A}}", False), ("", False), ("A", True)]


def test_deep_nesting():
    depth = 100_000
    deep = "CARD { " + "A { " * depth + "x; y" + " }" * depth + " }"
    assert canonical(deep).count("{") == depth + 1
    assert canonical(deep) == canonical(deep.replace("A { ", "A {  "))


def test_four_forms_by_one_parse(spark):
    """As one by one, and with digests that tell forms apart as they do; one Python stage in a plan of scores."""
    found = [spell("ADD { A 1; B $x }"), "CARD { NAME: \"Foo\" TYPES: [X, Y] SPELL { B; A } }", None, "A } B", '"un closed { "x" y', "a,b;c{d:e f:}"]
    for source in found:
        assert forms(source, name="Foo", mask_numbers=True) == {f"{scope}_{kind}": canonical(source, scope, kind == "strict", name="Foo", mask_numbers=True) for scope in ("rules", "full") for kind in ("loose", "strict")}
    rows = spark.createDataFrame([(k, "n", c, "clean") for k, c in enumerate(found)], "item long, name string, cdl string, status string")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a)], "a long, b long")
    scored = divergence.score_pairs(pairs, rows)
    for r in scored.collect():
        x, y = forms(found[r.a], name="n"), forms(found[r.b], name="n")
        assert [r[f"diverge_{f}"] for f in FORMS] == [x[f] != y[f] for f in FORMS] and (r.canonical_a, r.canonical_b) == (x["rules_loose"], y["rules_loose"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert len({line.split("[")[1] for line in plan.split("\n") if "ArrowEvalPython" in line}) <= 2  # one for each side of the join, of one UDF


def test_lexemes():
    assert list(lexemes('A{B:"x { y"z,[c];d} "e')) == ["A", "{", "B:", '"x { y"', "z", ",", "[", "c", "]", ";", "d", "}", "e"]
    assert list(lexemes("")) == [] and list(lexemes(' \t""')) == ['""']
