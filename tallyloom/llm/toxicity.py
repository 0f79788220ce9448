"""Toxicity grades by cumulative-link ordinal regression on hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .words import LETTERS, mixed, slices, spans_hash

#: Bits of a hashed word, and the lengths in bytes of the word beginnings that are hashed too.
BITS, BEGINNINGS = 30, (4, 5, 6)
DIMS = 1 << BITS
#: Labelled texts the model is fitted on, at most; chosen by a hash of the id.
SAMPLE = 8000
#: The evidence (likelihood ratio) that a word or beginning needs to become a feature.
EVIDENCE = 20.0
#: Least hashes of five-word runs by which near-copies in the sample are found.
SKETCH, RUN = 4, 5
#: Grades above 0 that toxic texts are divided into.
GRADES = 3
#: Expected severity from which a text counts as toxic.
REJECT = 0.25


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word, in order."""
    starts, ends, row = LETTERS.words(data, offsets)
    return row, (LETTERS.hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of the beginnings of longer words, which inflected forms share."""
    starts, ends, row = LETTERS.words(data, offsets)
    rows, found = [row], [LETTERS.hashes(data, starts, ends)]
    for length in BEGINNINGS:
        longer = ends - starts > length
        rows.append(row[longer])
        found.append(mixed(LETTERS.hashes(data, starts[longer], starts[longer] + length) + np.uint64(length)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count) of each distinct word of a row."""
    keys, counts = np.unique(row.astype(np.int64) * DIMS + word, return_counts=True)
    return keys // DIMS, keys % DIMS, counts


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(cuts[k] - weights . x): one weight for each feature, shared by all
    thresholds, which are in order. x is 1 + log(count) of chosen hashed words and beginnings."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of the probability to be above."""
        return (1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))).sum(axis=1)

    def likeliest(self, score: np.ndarray) -> np.ndarray:
        """The grade above 0 of the highest probability, the lowest of equals."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.cuts[None, :], -60, 60)))
        return 1 + np.diff(np.concatenate([below, np.ones((len(score), 1))], axis=1), axis=1).argmax(axis=1)

    def scores(self, rows: int, row: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, word), max(0, len(self.words) - 1))
        hit = self.words[at] == word if len(self.words) else np.zeros(len(word), bool)
        return np.bincount(row[hit], self.weights[at[hit]] * (1 + np.log(count[hit])), rows)


def fit_ordinal(rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int, rounds: int = 600, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full gradient steps (Adam) on the mean log-likelihood with
    a ridge penalty. Thresholds are a first one and positive steps, so they stay in order."""
    top = int(grade.max(initial=0))
    if not top:
        return np.zeros(features), np.full(1, 30.0)
    share = np.clip([(grade <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    at = np.concatenate([np.zeros(features), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, rounds + 1):
        w, gaps = at[:features], np.exp(at[features + 1 :])
        cuts = at[features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, w[feature] * value, rows)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))
        bounds = np.concatenate([np.zeros((rows, 1)), below, np.ones((rows, 1))], axis=1)
        at_grade = np.arange(rows), grade
        chance = np.maximum(bounds[:, 1:][at_grade] - bounds[:, :-1][at_grade], 1e-9)
        slope = below * (1 - below)
        g_cuts = np.zeros((rows, top))
        upper, lower = grade < top, grade > 0
        g_cuts[upper, grade[upper]] += slope[upper, grade[upper]] / chance[upper]
        g_cuts[lower, grade[lower] - 1] -= slope[lower, grade[lower] - 1] / chance[lower]
        g_score = -g_cuts.sum(axis=1)
        g = np.empty_like(at)
        g[:features] = np.bincount(feature, value * g_score[row], features) / rows - ridge * w
        by_cut = g_cuts.sum(axis=0) / rows
        g[features] = by_cut.sum()
        g[features + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        at = at + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return at[:features], at[features] + np.concatenate([[0], np.cumsum(np.exp(at[features + 1 :]))])


def _sketch(rows: int, row: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """For each row its least hashes, under SKETCH scramblings, of runs of RUN words (of fewer words, of all)."""
    firsts, lasts = np.searchsorted(row, np.arange(rows)), np.searchsorted(row, np.arange(rows), "right")
    at = np.arange(len(row))
    starts = at[(at + RUN <= lasts[row]) | (at == firsts[row])]
    hashes = spans_hash(mixed(word.astype(np.uint64)), starts, np.minimum(starts + RUN, lasts[row[starts]]), 2)
    found = []
    for k in range(SKETCH):
        least = np.full(rows, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, row[starts], mixed(hashes + np.uint64(k + 1)))
        found.append(least.view(np.int64))
    return found


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in slices(batch.column("_text")):
            words = _hashed(data, offsets)
            row, word, count = _counted(*_features(data, offsets))
            bounds = np.searchsorted(row, np.arange(last - first + 1))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int32())) for v in (word, count)]
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(_sketch(last - first, *words), axis=1).ravel()), SKETCH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_at").slice(first, last - first), batch.column("_toxic").slice(first, last - first), *lists, sketch], ["_at", "_toxic", "words", "counts", "sketch"])


def _only(words: np.ndarray):
    """Keep these words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat, counts = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            hit = np.isin(flat, words)
            bounds = pa.array(np.searchsorted(row[hit], np.arange(len(lists) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_at"), batch.column("_toxic"), *(pa.ListArray.from_arrays(bounds, pa.array(v[hit], pa.int32())) for v in (flat, counts))], ["_at", "_toxic", "w", "c"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, evidence: float = EVIDENCE, grades: int = GRADES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """Fit on at most `sample` labelled texts, the first by a hash of their id.

    Labels say toxic or not; severity grades 1 to `grades` divide the toxic ones evenly by how much
    evidence (1 + log counts of the words that speak for toxic) they hold, and the others are grade 0.
    Of an id's texts the one with the least digest counts. A text that occurs more than once counts once, as toxic if any label says so, and of texts that
    share a least hash of five-word runs, near-copies that is, one counts; null labels, null
    texts and labels without document are left out. Without toxic labels nothing is ever graded.

    Every word or beginning of the sample whose likelihood ratio against independence is at least
    `evidence` is a feature. Document frequencies and ratios are Spark's; only features, and their
    counts in the sampled texts, reach the driver."""
    labelled = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    chosen = labelled.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).where(F.col("_text").isNotNull())
    # an id that many rows have gives one text, so no more than `sample` are looked at
    once = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct(F.sha2("_text", 256).alias("_at"), "_text")).alias("t"), F.first("_toxic").alias("_toxic"))
    found = once.groupBy("t._at").agg(F.first("t._text").alias("_text"), F.max("_toxic").alias("_toxic"))
    held = cut(found.select("_at", "_toxic", "_text").mapInArrow(_document_words, "_at string, _toxic int, words array<int>, counts array<int>, sketch array<bigint>"))
    seen_hashes, kept = set(), []
    for r in held.select("_at", "sketch").orderBy("_at").collect():
        marks = set(enumerate(r["sketch"]))
        if not marks & seen_hashes:
            kept.append((r["_at"],))
        seen_hashes |= marks
    held = held.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "_at string")), "_at")
    n = {r["_toxic"]: r["n"] for r in held.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    nothing = Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(1, 30.0))
    if not toxic:
        return nothing
    spread = held.select("_toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("_toxic").cast("double").alias("a"), F.sum(1 - F.col("_toxic")).cast("double").alias("b"))
    rate = (F.col("a") + F.col("b")) / (clean + toxic)

    def part(x: str, of: int):
        some, rest = F.col(x), F.lit(float(of)) - F.col(x)
        return F.when(some > 0, some * F.log(some / (of * rate))).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / (of * (1 - rate)))).otherwise(0.0)

    ratio = 2 * (part("a", toxic) + part("b", clean))
    seen = spread.where(ratio >= evidence).select("word", (F.col("a") * max(clean, 1) > F.col("b") * toxic).alias("speaks")).toPandas().sort_values("word")
    words = seen["word"].to_numpy(np.int64)
    speaks = dict(zip(words.tolist(), seen["speaks"].tolist(), strict=True))
    chosen_words = held.select("_at", "_toxic", "words", "counts").mapInArrow(_only(words), "_at string, _toxic int, w array<int>, c array<int>")
    rows = chosen_words.orderBy("_at").collect()
    row = np.repeat(np.arange(len(rows)), [len(r["w"]) for r in rows])
    word = np.array([w for r in rows for w in r["w"]], np.int64)
    value = 1 + np.log(np.array([c for r in rows for c in r["c"]], float))
    is_toxic = np.array([r["_toxic"] for r in rows], bool)
    weight = np.bincount(row, value * np.array([speaks[w] for w in word.tolist()], float), len(rows)) if len(word) else np.zeros(len(rows))
    grade = np.zeros(len(rows), np.int64)
    rank = np.empty(int(is_toxic.sum()), np.int64)
    rank[np.argsort(weight[is_toxic], kind="stable")] = np.arange(len(rank))
    grade[is_toxic] = 1 + rank * min(grades, len(rank)) // len(rank)
    weights, cuts = fit_ordinal(len(rows), row, np.searchsorted(words, word), value, grade, len(words))
    return Ordinal(words, weights, cuts)


def grade_toxicity(docs: DataFrame, model: Ordinal, threshold: float = REJECT, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """Expected severity of every row's whole text, whether it is `toxic` (expected severity of at
    least `threshold`), and its grade: 0 if it isn't, else the most likely one above 0.

    Null, empty and wordless texts have the severity that the thresholds alone give. Repeated rows
    and ids each keep their row; an empty table gives no rows. Returns (id, severity, grade,
    toxic), or all columns of `docs` and `toxic` under the name `keep`."""

    rough = np.zeros(1 << 16, bool)
    rough[model.words & (len(rough) - 1)] = True

    def judge(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        severity, likeliest = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
        for first, last, data, offsets in slices(batch.column(text_col)):
            row, word = _features(data, offsets)
            known = rough[word & (len(rough) - 1)]
            known[known] = np.isin(word[known], model.words)
            score = model.scores(last - first, *_counted(row[known], word[known]))
            severity[first:last], likeliest[first:last] = model.expected(score), model.likeliest(score)
        return severity, likeliest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, likeliest = judge(batch)
            toxic = pa.array(severity >= threshold)
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, toxic], [*batch.schema.names, keep])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.round(severity, 6)), pa.array(np.where(severity >= threshold, likeliest, 0).astype(np.int32)), toxic], [id_col, "severity", "grade", "toxic"])

    if keep:
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(keep, T.BooleanType())]))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, severity double, grade int, toxic boolean")
