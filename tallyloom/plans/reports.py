"""Findings of the gates as Markdown."""

from __future__ import annotations

from ..operators import coverage, divergence, similarity
from ..sources.sinks import percent, table

#: Said with every finding.
CONFOUND = "Truth that derives from co-occurrence inherits what made the baskets alike; differences between arms survive that, absolute numbers don't."
#: What the tiers of the divergence gate are for.
ROLES = {
    "reprints": "wordings of one item over time",
    "identical_text": "a control: one text but for the name, so any difference is the parser's",
    "same_effect_wording": "the tier that is judged: one effect, two wordings",
    "parametric_cycles": "one template with other values; numbers and symbols masked",
    "numeric": "one effect with other numbers; numbers masked, judged by a limit of its own",
    "substitutes_contrast": "a contrast: substitutes that aren't equivalent and should differ more",
}


def _signed(value: float | None) -> str:
    return "—" if value is None else f"{value:+.4f}"


def _page(title: str, question: str, *parts: str) -> str:
    return "\n".join([f"# {title}\n", f"> {CONFOUND}\n", f"{question}\n", *parts])


def coverage_report(results: dict[str, dict]) -> str:
    """`results` maps a corpus to what `gates.run_coverage` found."""
    head = [{"corpus": name, "baskets": r["n_baskets"], "distinct": percent(r["distinct"]["in_baskets"]), "appearances": percent(r["verdict"]["coverage"]), "guarded": percent(r["verdict"]["guarded"]), "drop": percent(r["verdict"]["coverage"] - r["verdict"]["guarded"]), "verdict": r["verdict"]["verdict"]} for name, r in results.items()]
    parts = [f"Passes from {percent(coverage.PASS)}, fails below {percent(coverage.FAIL)}; the guarded slice may trail by {percent(coverage.GUARD_DROP)}.\n", "## Verdicts\n", table(head)]
    for name, r in results.items():
        parts += [f"## {name}\n", table(r["strata"]), table(r["heads"]), table(r["status_share"])]
        encoded = r["encoded"]["coverage"]
        parts.append(f"Encoded at all, with gaps or without: {percent(encoded)}; without: {percent(r['verdict']['coverage'])}.\n")
        if isinstance(r["exclusion_reasons"], list) and r["exclusion_reasons"]:
            parts += ["Left out before parsing, and counted as uncovered:\n", table(r["exclusion_reasons"])]
        if r["gap_categories"]:
            parts += ["Gaps by category:\n", table(r["gap_categories"])]
        parts.append(f"Items never parsed: {r['unmatched']['items']} in {r['unmatched']['appearances']} appearances. Staples ({len(r['staples'])}): {', '.join(r['staples']) or 'none'}.\n")
    parts.append("The failures with most appearances are in `t0_failures_<corpus>.csv`; that list, not the share, says what to encode next.\n")
    return _page("T0: coverage by appearances", "How much of what baskets hold can be encoded?", *parts)


def divergence_report(found: dict, skips: dict[str, str] | None = None) -> str:
    """Of what `gates.run_divergence` found."""
    rows = []
    for s in found["sets"]:
        masks = ", ".join(n for n, on in zip(("numbers", "symbols"), divergence.TIERS.get(s["tier"], (False, False)), strict=True) if on) or "none"
        bound = "—" if s["upper_bound"] is None else f"≤ {percent(s['upper_bound'])}"
        rows.append({"set": s["tier"] + (" (few)" if s["underpowered"] else ""), "pairs": s["n_pairs"], "clean": s["n_both_clean"], "masked": masks, "divergence": percent(s["clean_rules_loose"]), "bound": bound, "strict": percent(s["clean_rules_strict"]), "full": percent(s["clean_full_loose"]), "all encoded": percent(s["all_rules_loose"])})
    parts = [f"Passes below {percent(divergence.PASS)}, fails above {percent(divergence.FAIL)}; numeric pairs below {percent(divergence.NUMERIC)}.\n", f"## Verdict: {found['verdict']['verdict']}\n", table(rows)]
    parts += [f"A set of fewer than {divergence.ENOUGH} clean pairs carries no verdict alone; where none differ, three over their number bounds the rate.\n", "## What the sets are for\n", *[f"* `{k}`: {v}." for k, v in ROLES.items()], ""]
    if skips:
        parts += ["## Sets left out\n", *[f"* {k}: {v}" for k, v in skips.items()], ""]
    parts.append("`t1_divergent_pairs.csv` has every pair that differs, with both forms.\n")
    return _page("T1: divergence of equivalent items", "Do equivalent items get one encoding?", *parts)


def leakage_report(results: list[dict], harness: dict, rungs: list[tuple[str, str]] | None = None) -> str:
    """Of rungs that `gates.run_arm` found; `rungs` are those that were asked for."""
    rows = []
    for r in results:
        c, low_high = r["curated"], r["curated"]["lift_vs_cluster_ci"]
        mined = _signed((r.get("mined_holdout") or {}).get("lift_vs_cluster")) + (" †" if r.get("narrow_effect") else "")
        rows.append({"arm": r["arm"], "corpus": r["corpus"], "substitutes": _signed(c["mean_substitute_cosine"]), "random": _signed(c["mean_random_cluster_cosine"]), "lift": _signed(c["lift_vs_cluster"]), "interval": f"[{_signed(low_high[0])}, {_signed(low_high[1])}]", "mined": mined, "verdict": r["verdict"]})
    seen = "not run" if harness["observed_substitute"] is None else f"{harness['observed_substitute']:.4f} and {harness['observed_random']:.4f}, {'as' if harness['matches_reference'] else 'other than'} before"
    parts = [f"Passes with a lift from {similarity.MIN_LIFT:+} and an interval above zero; a lift below {similarity.RATIO} of the mined pairs' fits phenotypes only.\n", f"Means of arm 2a, for information: {seen} ({harness['expected_substitute']} and {harness['expected_random']}).\n", "## Rungs\n", table(rows)]
    missing = sorted(set(rungs or []) - {(r["arm"], r["corpus"]) for r in results})
    if missing:
        parts.append(f"Not run, so open: {', '.join(f'{a}/{c}' for a, c in missing)}.\n")
    if any(r.get("narrow_effect") for r in results):
        parts.append("† Narrow: the mined pairs' lift is below the least lift and below half the curated one. It changes no verdict.\n")
    parts += ["## What follows\n", "* 2d passes: leakage was a matter of training.", "* 2d fails and 2b is above 2a: the corpus drove it.", "* 2c is well above 2b: negatives were what was missing.", "* 2d fails outright: surface text carries the geometry.", ""]
    return _page("T2: leakage of text into geometry", "Are substitutes nearer than random pairs of one group?", *parts)
