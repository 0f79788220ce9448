"""Collocations: n-grams counted for each language, scored exactly, without those that a longer one explains."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot
from .words import Lexer, slices

MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Words whose n-grams are counted together before they leave a task.
GROUP = 1_500_000
#: Shares of a language's candidates that are ranked apart before its first ones are.
SHARES = 64
#: Rows sent on together, and bits of the filter that is broadcast, at most.
_ROWS, SLOTS = 100_000, 1 << 29
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?") + [10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[0x09, 0x20]] = False
#: Words are runs of bytes that are neither blanks, tabs nor ends of pieces.
_WORDS = Lexer(_WORD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Between a phrase, which has none, and its language in keys.
_MARK = "\n"
_BETWEEN = pa.scalar(_MARK, pa.large_string())


def _coded(values: np.ndarray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the distinct values by number."""
    found = (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class _Words:
    """The words of a run of texts, as codes of (language, word), and where the next word follows in
    the same piece."""

    def __init__(self) -> None:
        self.langs: list[pa.Array] = []
        self.words: list[pa.Array] = []
        self.rows: list[np.ndarray] = []
        self.follows: list[np.ndarray] = []
        self.n_rows = self.n_words = 0

    def add(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, row = _WORDS.words(data, offsets)
        if len(starts):
            piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
            follows = np.zeros(len(starts), bool)
            follows[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
            bounds = np.column_stack([starts, ends]).ravel().astype(np.int64)
            low = _LOWER[data]
            parts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(low)])
            self.words.append(parts.take(pa.array(np.arange(0, len(bounds), 2))))
            self.rows.append(row + self.n_rows)
            self.follows.append(follows)
        self.langs.append(langs)
        self.n_rows += len(langs)
        self.n_words += len(starts)

    def counts(self, orders: list[int], passed) -> Iterator[pa.RecordBatch]:
        """(key, f) of the n-grams of these orders; order 0 is the number of all words. With
        `passed`, n-grams both of whose shorter ones pass it."""
        of_row, langs = _coded(pa.concat_arrays(self.langs))
        if not self.n_words:
            return
        word, spelt = _coded(pa.concat_arrays(self.words))
        self.words = []
        follows, lang_of = np.concatenate(self.follows), of_row[np.concatenate(self.rows)].astype(np.int64)
        self.follows = self.rows = []
        codes, known = _coded(lang_of * len(spelt) + word)
        known = known.to_numpy()
        size = len(known)
        lang, text = (known // len(spelt)).astype(np.int32), spelt.cast(pa.large_string()).take(pa.array(known % len(spelt)))
        last = text
        total = np.bincount(lang_of, minlength=len(langs))
        del word, spelt, lang_of
        if 0 in orders:
            yield from _sent(langs, np.arange(len(langs)), pa.array([""] * len(langs), pa.large_string()), total)
        if 1 in orders:
            yield from _sent(langs, lang, text, np.bincount(codes, minlength=size))
        at, single = np.arange(len(codes), dtype=np.int32), codes
        for n in range(2, max(orders) + 1):
            fits = follows[at + n - 2]  # the n-gram from here doesn't leave its piece
            if passed is not None and n == max(orders):
                some = passed(_keys(langs, lang, text))
                good = np.zeros(len(single) + 1, bool)
                good[at] = some[codes]
                fits = fits & good[at] & good[at + 1]
            at, before = at[fits], codes[fits].astype(np.int64)
            before *= size
            before += single[at + n - 1]
            codes, known = _coded(before)
            del before, fits
            known = known.to_numpy()
            lang = lang[known // size]
            text = pc.binary_join_element_wise(text.take(pa.array(known // size)), last.take(pa.array(known % size)), pa.scalar(" ", pa.large_string()))
            if n in orders:
                yield from _sent(langs, lang, text, np.bincount(codes, minlength=len(known)))


def _keys(langs: pa.Array, lang: np.ndarray, text: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(text, langs.take(pa.array(lang)).cast(pa.large_string()), _BETWEEN)


def _sent(langs: pa.Array, lang: np.ndarray, text: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(counts), _ROWS):
        keys = _keys(langs, lang[k : k + _ROWS], text.slice(k, _ROWS)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([keys, pa.array(counts[k : k + _ROWS].astype(np.int64))], ["key", "f"])


def _grams(orders: list[int], bits: Broadcast | None, slots: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else np.frombuffer(zlib.decompress(bits.value), np.uint8)

        def passed(keys: pa.Array) -> np.ndarray:
            h = np.zeros(len(keys), np.uint64)
            for at in range(0, len(keys), _ROWS):
                h[at : at + _ROWS] = [xxhash.xxh64_intdigest(k, 42) for k in keys.slice(at, _ROWS).cast(pa.large_binary()).to_pylist()]
            found = np.ones(len(h), bool)
            for part in (h, h >> np.uint64(32)):
                at = (part & np.uint64(slots - 1)).astype(np.int64)
                found &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            return found

        words = _Words()
        for batch in batches:
            langs = batch.column("lang").cast(pa.string())
            for first, last, data, offsets in slices(batch.column("text")):
                words.add(langs.slice(first, last - first), data, offsets)
                if words.n_words >= group:
                    yield from words.counts(orders, None if table is None else passed)
                    words = _Words()
        if words.n_rows:
            yield from words.counts(orders, None if table is None else passed)

    return run


def _key(phrase: str) -> Column:
    return F.concat(F.col(phrase), F.lit(_MARK), F.col("lang"))


def _filter(phrases: DataFrame) -> tuple[Broadcast, int]:
    """A Bloom filter of (lang, phrase), of SLOTS bits at most: what it lets through by mistake is counted and dropped."""
    spark = phrases.sparkSession
    slots = min(SLOTS, max(1 << 16, 1 << (16 * phrases.count()).bit_length()))
    h = F.xxhash64(_key("phrase"))
    places = phrases.select(F.explode(F.array(F.pmod(h, F.lit(slots)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(slots)))).alias("at"))
    width = 8 * 4096  # bits that Spark's bitmaps hold
    parts = places.groupBy(F.floor(F.col("at") / width).alias("part")).agg(F.bitmap_construct_agg((F.col("at") % width).cast("long")).alias("bits"))
    bits = np.zeros(slots // 8, np.uint8)
    for row in parts.toLocalIterator():
        bits[row["part"] * 4096 :][:4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1)), slots


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", group: int = GROUP) -> DataFrame:
    """(lang, n, phrase, f): how often each phrase of 1 to `max_words` words occurs in the pieces of a
    language's texts, of those with `least` occurrences; n = 0 is the number of all words.

    n-grams leave their tasks as rows, each once for every GROUP words, and are summed by a
    shuffle. A phrase of three or more words has `least` occurrences only if both phrases
    of one word less do; so longer n-grams are made after those, and only where a filter of
    bounded size doesn't refute one of the two."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    found = None
    for orders in [[0, 1, 2], *[[n] for n in range(3, max_words + 1)]]:
        bits, slots = (None, 0) if found is None else _filter(found.where(F.col("n") == orders[0] - 1).select("lang", "phrase"))
        orders = [n for n in orders if n <= max_words]
        rows = texts.mapInArrow(_grams(orders, bits, slots, group), "key string, f long")
        # the tasks have summed already: the rows are dealt first, so that Spark doesn't sum them before, too
        summed = rows.repartition("key").groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.startswith("key", F.lit(_MARK)))
        phrase = F.substring_index("key", _MARK, 1)
        spelt = summed.withColumn("phrase", phrase).withColumn("lang", F.substr("key", F.length("phrase") + 2))
        words = F.when(F.col("phrase") == "", 0).otherwise(1 + F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))))
        kept = cut(spelt.select("lang", words.cast("int").alias("n"), "phrase", "f"))
        found = kept if found is None else cut(found.unionByName(kept))
    return found


def _looked_up(cuts: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """Adds `name`, the count of the phrase in column `key`. A part that very many phrases share goes to where they lie."""
    keyed = cut(cuts.withColumn("_part", _key(key)))
    known = counts.where("n > 0").select(_key("phrase").alias("_part"), F.col("f").alias(name))
    asked = keyed.groupBy("_part").agg(F.count("*").alias("_rows"))
    return join_hot(keyed, cut(known.join(asked, "_part")), "_part", "_rows").drop("_part")


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in decimals of 38 digits: exact for counts up to 10^15."""
    whole = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({whole(a)} * {whole(a)} * cast(1000000 as decimal(7,0))) div ({whole(l)} * {whole(r)})")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang", group: int = GROUP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    Texts are lower-cased (A-Z) and end pieces at [.,;:!?] and line ends; a null text is empty, a
    null language is `und`. Candidates are phrases of 2 to `max_words` words within a piece with
    `least` occurrences, a. Of a candidate's cuts into two the one with the lowest score
    counts, of equal ones the first: l and r are the counts of its two parts. A candidate goes if
    one that contains its words has at least `share` percent of its occurrences; as a phrase has
    no more occurrences than its parts, one-word extensions decide. Ranks are by score and
    occurrences, descending, then by the phrase's bytes, so ties have one order. Repeated rows count
    each; empty tables give no rows; other columns are ignored; n is the number of the language's words."""
    counts = phrase_counts(docs, max_words, least, text_col, lang_col, group)
    candidates = counts.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), "n")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)")})
    both = _looked_up(_looked_up(cuts, counts, "head", "l"), counts, "tail", "r")
    scored = both.select("lang", "phrase", "a", F.struct(score("a", "l", "r").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    longer = candidates.where("n > 2")
    parts = F.array(F.expr("substring_index(phrase, ' ', n - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
    extended = longer.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    same = (F.col("b.lang") == F.col("e.lang")) & (F.col("b.phrase") == F.col("e.phrase"))
    apart = best.alias("b").join(extended.alias("e"), same & (F.col("longest") * 100 >= F.col("b.a") * share), "left_anti")
    rows = apart.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # a language's first ones are among the first of each of its shares
    ordered = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*ordered))
    some = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("_place", place("_share")).where(F.col("_place") <= top)
    first = some.withColumn("rank", place().cast("long")).where(F.col("rank") <= top)
    totals = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

