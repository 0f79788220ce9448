"""Embedding near-duplicates by product quantisation."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import tasks_for
from .common import cut, join_hot, partitions
from .components import components
from .words import mixed

#: Distinct vectors the quantisers are fitted on, at most; chosen by a hash. All are indexed.
SAMPLE = 131_072
#: Rows of a list, about, and vectors of the sample for each list; so many lists at most.
ROWS, PER_LIST = 64, 16
LISTS = SAMPLE // PER_LIST
SUBSPACES, CODES = 8, 64
#: Probes reach all lists of a difference that along the line between two centres is up to so many
#: times its mean square; with None, of any difference within the radius.
DEVIATIONS = 3.0
#: Rows of a list, and queries to it, that meet in one task.
TILE = 2048
#: Where queries reach more than this share of a quantiser of so many lists at most, lists are as long as tiles, and
#: tiles have so many times the rows and the queries: probes of short lists would cost more than the comparisons.
WIDE, TRIED, TALL, BROAD = 0.25, 256, 2, 8
#: Candidate pairs that are compared together, and long lists that are named to all tasks.
_PAIRS, _NAMED = 1 << 17, 50_000
_SLACK = 1e-9
#: Heads of rows: check, list, weight, error; of queries: check, error, scale, dimensions.
_HELD, _ASKED = "<Iiqd", "<IffI"
_HELD_SIZE, _ASKED_SIZE = struct.calcsize(_HELD), struct.calcsize(_ASKED)


def _kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from an even spread of the points; a centre without points stays."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 or len(points) > 1 else 0):
        nearest = _nearest(points, centres)
        counts = np.bincount(nearest, minlength=k)
        order = np.argsort(nearest, kind="stable")
        some = np.flatnonzero(counts)
        sums = np.add.reduceat(points[order], (np.cumsum(counts) - counts)[some], axis=0)
        centres[some] = sums / counts[some, None]
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)


def _near(squares: np.ndarray, nearest: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """Whether a vector may be nearest to a centre if it differs from the point by `reach` along the line
    from the point's nearest centre: the difference of the squared distances to two centres changes by
    twice their distance for each unit."""
    apart = np.sqrt(_squares(centres, centres))
    return squares - squares[np.arange(len(squares)), nearest][:, None] <= 2 * reach * apart[nearest] + _SLACK


@dataclass
class Quantiser:
    """Coarse centres of unit vectors in two levels, and codebooks for the residuals in each subspace.
    A list belongs to a centre of the second level; its number counts those of all first ones. Queries are
    sent in so many bits a component."""

    tops: np.ndarray
    centres: list[np.ndarray]
    books: list[np.ndarray]
    bits: int = 8

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
        lists = max(1, min(lists, len(sample)))
        tops = _kmeans(sample, max(1, round(lists**0.5)))
        of = _nearest(sample, tops)
        centres = [_kmeans(own, min(len(own), max(1, round(lists * len(own) / len(sample))))) if len(own := sample[of == t]) else tops[t : t + 1] for t in range(len(tops))]
        made = cls(tops, centres, [])
        some = sample[:: max(1, len(sample) // 16_384)]
        residuals = some - np.concatenate(centres)[made.lists(some)]
        parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        made.books = [_kmeans(residuals[:, p], min(codes, len(some))) for p in parts]
        return made

    def starts(self) -> np.ndarray:
        return np.cumsum([0, *(len(c) for c in self.centres)])

    def lists(self, points: np.ndarray) -> np.ndarray:
        """The list of each point."""
        of, found, starts = _nearest(points, self.tops), np.zeros(len(points), np.int64), self.starts()
        for t in np.unique(of).tolist():
            own = of == t
            found[own] = starts[t] + _nearest(points[own], self.centres[t])
        return found

    def probes(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) for all lists that a vector may be in that differs by `reach` along the lines
        between centres, on both levels."""
        squares, starts, who, where = _squares(points, self.tops), self.starts(), [], []
        tops = _near(squares, squares.argmin(1), self.tops, reach)
        for t in np.flatnonzero(tops.any(0)).tolist():
            own = np.flatnonzero(tops[:, t])
            inner = _squares(points[own], self.centres[t])
            at, which = np.nonzero(_near(inner, inner.argmin(1), self.centres[t], reach))
            who.append(own[at])
            where.append(starts[t] + which)
        return np.concatenate(who), np.concatenate(where)

    def reached(self, points: np.ndarray, reach: float) -> float:
        """The share of all lists that a point probes, of the mean of some points."""
        some = points[:: max(1, len(points) // 1024)]
        return len(self.probes(some, reach)[0]) / (len(some) * int(self.starts()[-1]))

    def digits(self) -> np.dtype:
        return np.dtype(f"<i{self.bits // 8}")

    def parts(self) -> list[slice]:
        edges = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, points: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of the decoded point from the point)."""
        residuals = points - np.concatenate(self.centres)[lists]
        codes = np.stack([_nearest(residuals[:, p], b) for p, b in zip(self.parts(), self.books, strict=True)], axis=1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((residuals - decoded) ** 2).sum(1))


def _unit(raw: list[bytes], kind: np.dtype) -> np.ndarray:
    """Unit vectors; the largest component is made 1 first, so no square over- or underflows."""
    points = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    points = points / np.abs(points).max(axis=1)[:, None]
    return points / np.sqrt((points**2).sum(1))[:, None]


def _checked(kind: np.dtype):
    """A key and the bytes of each vector that can be compared; null for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            lists, labels = batch.column("_vector"), batch.column("_label").to_pylist()
            flat, offsets = lists.values, lists.offsets.to_numpy()
            missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            empty = lists.is_null().to_numpy(zero_copy_only=False)
            for i, label in enumerate(labels):
                a, b = offsets[i], offsets[i + 1]
                v = values[a:b] + kind.type(0)  # -0.0 becomes 0.0
                good = label is not None and not empty[i] and b > a and missing[a] == missing[b] and np.isfinite(v).all() and v.any()
                raw = v.tobytes() if good else None
                raws.append(raw)
                keys.append(hashlib.sha256(f"{label}|".encode() + raw).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["_id", "_label", "_key", "_raw"])

    return run


def _cells(space: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """A number for the list of a space; spaces are told apart by 32 more bits in the rows."""
    return mixed(mixed(space.view(np.uint64)) + lists.astype(np.uint64)).view(np.int64)


def _reach(radius: float, deviations: float | None, dim: int) -> float:
    return radius * (1.0 if deviations is None else min(1.0, deviations / dim**0.5))


def _indexed(shared, kind: np.dtype, radius: float, deviations: float | None):
    """Of each class a row for its list, which holds the vector, its codes and its weight, and a query for
    each list to be probed, which holds the vector in 8 or 16 bits a component with the error of that."""
    names = ["cell", "node", "held", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                dims = np.array([len(r) for r in part.column("_raw").to_pylist()]) // kind.itemsize
                for dim in np.unique(dims).tolist():
                    rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                    quantiser: Quantiser = shared.value[dim]
                    raw, space, check = rows.column("_raw").to_pylist(), rows.column("space").to_numpy(), rows.column("check").to_numpy().view(np.uint32)
                    points = _unit(raw, kind)
                    lists = quantiser.lists(points)
                    codes, error = quantiser.encode(points, lists)
                    held = [struct.pack(_HELD, *head) + c.tobytes() + r for *head, c, r in zip(check.tolist(), lists.tolist(), rows.column("_n").to_pylist(), error.tolist(), codes, raw, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(_cells(space, lists)), rows.column("node"), pa.array(np.ones(len(held), bool)), pa.array(held, pa.binary())], names)
                    most = np.iinfo(quantiser.digits()).max
                    scale = (np.abs(points).max(axis=1) / most).astype(np.float32)
                    rounded = np.clip(np.rint(points / scale[:, None]), -most, most).astype(quantiser.digits())
                    off = np.sqrt(((points - rounded * scale[:, None].astype(np.float64)) ** 2).sum(1)) + 1e-6
                    asked = pa.array([struct.pack(_ASKED, *head, dim) + e.tobytes() for *head, e in zip(check.tolist(), off.tolist(), scale.tolist(), rounded, strict=True)], pa.binary())
                    who, where = quantiser.probes(points, _reach(radius, deviations, dim))
                    which = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(_cells(space[who], where)), rows.column("node").take(which), pa.array(np.zeros(len(who), bool)), asked.take(which)], names)

    return run


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges between nodes `left` and `right` that connect what the links connect, one for each
    node at most. A node is looked at once."""
    edges = []
    open_left, open_right = links.any(1), links.any(0)
    while open_left.any():
        stack = [(True, int(open_left.argmax()))]
        open_left[stack[0][1]] = False
        while stack:
            is_left, i = stack.pop()
            line, still = (links[i], open_right) if is_left else (links[:, i], open_left)
            found = np.flatnonzero(line & still)
            still[found] = False
            here, there = (left, right) if is_left else (right, left)
            edges += [(int(here[i]), int(there[j])) for j in found if here[i] != there[j]]
            stack += [(not is_left, int(j)) for j in found]
    return edges



def _found(a: list, b: list, links: list) -> pa.RecordBatch:
    """Rows (a, b, links): a count of links of a without b, an edge with links 0, a pair to be compared
    exactly with links -1."""
    ends = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, [y for y in b if y is not None], links)]
    missing = np.concatenate([np.full(len(x), y is None) for x, y in zip(a, b, strict=True)]) if a else np.zeros(0, bool)
    other = np.zeros(len(missing), np.int64)
    other[~missing] = ends[1]
    return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(other, pa.int64(), mask=missing), pa.array(ends[2])], ["a", "b", "links"])


def _matched(shared, kind: np.dtype, radius: float):
    """Links between the queries and the rows of each tile: of each query how many vectors it links for
    certain, edges that connect these, and the pairs that 8 bits a component can't decide."""

    def tile(nodes: np.ndarray, held: np.ndarray, data: list[bytes], out: tuple[list, list, list]) -> None:
        rows, asked = np.flatnonzero(held), np.flatnonzero(~held)
        heads = [struct.unpack_from(_HELD, data[i]) for i in rows]
        queries = [struct.unpack_from(_ASKED, data[i]) for i in asked]
        dim = queries[0][3]
        quantiser: Quantiser = shared.value[dim]
        width = len(quantiser.books)
        y = _unit([data[i][_HELD_SIZE + width :] for i in rows], kind)
        codes = np.frombuffer(b"".join(data[i][_HELD_SIZE : _HELD_SIZE + width] for i in rows), np.uint8).reshape(len(rows), width)
        check, lists, weight, error = (np.array(c) for c in zip(*heads, strict=True))
        asked_check, off, scale, _ = (np.array(c) for c in zip(*queries, strict=True))
        x = np.frombuffer(b"".join(data[i][_ASKED_SIZE :] for i in asked), quantiser.digits()).reshape(len(asked), dim) * scale[:, None]
        offset = x - np.concatenate(quantiser.centres)[lists[0]]
        decoded = np.concatenate([book[codes[:, s]] for s, book in enumerate(quantiser.books)], axis=1)
        # a product of 32 bits is at least 0 where a decoded row is within reach; `loose` is more than its rounding
        reach, loose = radius + off + _SLACK, 1e-6 * (dim + 16)
        coded = np.column_stack([decoded, error, np.ones(len(y)), ((decoded**2).sum(1) - error**2) / 2]).astype(np.float32).T
        sought = np.column_stack([offset, reach, (reach**2 - (offset**2).sum(1)) / 2, -np.ones(len(x))]).astype(np.float32)
        # the same for the rows themselves, whose distance decides but for the rounding and the query's error
        whole = np.column_stack([y, (y**2).sum(1) / 2]).astype(np.float32).T
        plain = np.column_stack([x, -np.ones(len(x))]).astype(np.float32)
        squares, within = (x**2).sum(1), radius - off - _SLACK
        inner, outer = np.where(within > 0, (squares - within**2) / 2 + loose, np.inf), (squares - reach**2) / 2 - loose
        left, right = nodes[asked], nodes[rows]
        alike = len({*check.tolist(), *asked_check.tolist()}) == 1
        _, mine, same = np.intersect1d(left, right, return_indices=True)
        links = np.zeros((len(x), len(y)), bool)
        for at in range(0, len(x), 256):
            some = slice(at, at + 256)
            near = sought[some] @ coded >= -loose
            if not alike:
                near &= asked_check[some, None] == check[None, :]
            here = (mine >= at) & (mine < at + 256)
            near[mine[here] - at, same[here]] = False
            if np.count_nonzero(near) > near.size // 64:  # too many to look at one by one
                products = plain[some] @ whole
                certain = products > inner[some, None]
                links[some] = near & certain
                near &= (products >= outer[some, None]) & ~certain
            i, j = np.nonzero(near)
            for k in range(0, len(i), _PAIRS):
                a, b = i[k : k + _PAIRS] + at, j[k : k + _PAIRS]
                apart = np.sqrt(((x[a] - y[b]) ** 2).sum(1))
                sure = apart + off[a] < radius - _SLACK
                links[a[sure], b[sure]] = True
                open_pairs = ~sure & (apart - off[a] <= radius + _SLACK)
                for into, values in zip(out, (left[a[open_pairs]], right[b[open_pairs]], np.full(int(open_pairs.sum()), -1)), strict=True):
                    into.append(values)
        some = links.any(1)
        for into, values in zip(out, (left[some], None, links[some] @ weight), strict=True):
            into.append(values)
        edges = np.array(_forest(links, left, right), np.int64).reshape(-1, 2)
        for into, values in zip(out, (edges[:, 0], edges[:, 1], np.zeros(len(edges), np.int64)), strict=True):
            into.append(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held, data = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, bool), []

        def tiles(stop: int) -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            bounds = np.flatnonzero(np.concatenate(([True], (keys[1:stop] != keys[: stop - 1]).any(1), [True]))) if stop > 1 else np.array([0, stop])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if held[a:b].any() and not held[a:b].all():
                    tile(nodes[a:b], held[a:b], data[a:b], out)
            return _found(*out)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "row_tile", "query_tile")], axis=1)
            keys, nodes = np.concatenate([keys, own]), np.concatenate([nodes, batch.column("node").to_numpy()])
            held, data = np.concatenate([held, batch.column("held").to_numpy(zero_copy_only=False)]), data + batch.column("data").to_pylist()
            last = np.flatnonzero((keys != keys[-1]).any(1))  # the last tile may go on
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop:
                yield tiles(stop)
                keys, nodes, held, data = keys[stop:].copy(), nodes[stop:].copy(), held[stop:].copy(), data[stop:]
        if len(keys):
            yield tiles(len(keys))

    return run


def _compared(kind: np.dtype, cosine: float):
    """Of pairs (a, b) with both vectors and the weight of b: those linked, as a count and as an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, weight = (batch.column(c).to_numpy() for c in ("a", "b", "weight"))
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            sizes = np.array([len(v) for v in x], np.int64)
            near = np.zeros(len(x), bool)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                for k in range(0, len(own), 4096):
                    some = own[k : k + 4096]
                    near[some] = np.einsum("ij,ij->i", _unit([x[i] for i in some], kind), _unit([y[i] for i in some], kind)) >= cosine
            yield _found([a[near], a[near]], [None, b[near]], [weight[near], np.zeros(int(near.sum()), np.int64)])

    return run


def _fitted(points: np.ndarray, lists: int, long: int, reach: float) -> Quantiser:
    """A quantiser of `lists` lists, or of `long` ones where queries would probe most of those anyway: then
    a query is sent to few, and its 16 bits a component leave hardly a pair open."""
    some = points[:: -(-len(points) // (TRIED * PER_LIST * 4))]
    tried = Quantiser.fit(some, min(lists, TRIED))
    if lists > long and tried.reached(some, reach) > WIDE:
        made = Quantiser.fit(points[: long * PER_LIST * 4], long)
        made.bits = 16
        return made
    return tried if lists <= TRIED and len(some) == len(points) else Quantiser.fit(points, lists)


def embedding_groups(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, rows_per_list: int = ROWS, tile: int = TILE, deviations: float | None = DEVIATIONS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links by cosine of at least `cosine` between rows with one label, and groups of linked rows.

    n_links counts the other rows that a row links with directly; component_id is the least id
    that links reach, and `kept` marks the rows whose id that is. Rows whose label is null or whose
    vector is null, empty, zero or holds null or non-finite components link with nothing; vectors
    of different lengths don't link; vectors of any finite magnitude do. Repeated rows are rows of
    their own that link; null ids take part but are never a component's least id, and are not
    kept. An empty table gives no rows; other columns are ignored. Returns (id, n_links,
    component_id, kept).

    Equal vectors with one label form a class that is searched once, with its count. A coarse
    quantiser in two levels, fitted on a bounded sample, has as many lists as the largest label needs
    for lists of `rows_per_list`, up to a share of the sample; every class is in one list, and
    residuals are coded in subspaces. A query probes every list that a linked vector can be in if
    the difference is, along each line between centres, up to `deviations` times its mean square:
    in d dimensions the radius times deviations / sqrt(d), beyond which some 1 in 700 differences
    of the whole radius lie on either side. With `deviations` None, or up to deviations squared
    dimensions, the bound is that of the triangle inequality, and no link is lost. Where that is most lists,
    lists are made as long as tiles. Products with the decoded rows
    give distances to them; rows whose distance less all known coding errors is within
    reach are compared with the query in 8 bits a component (16 where lists are long), and the few pairs that
    its error leaves open, exactly. A long list is dealt into tiles, and of a tile only counts, a spanning
    forest of links and open pairs come out."""
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    kind = np.dtype(np.float32 if isinstance(element, T.FloatType) else np.float64)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    id_kind = vectors.schema[id_col].dataType.simpleString()
    narrow = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vector_col).alias("_vector"))
    rows = cut(narrow.mapInArrow(_checked(kind), f"_id {id_kind}, _label string, _key binary, _raw binary"))
    classes = rows.where("_key is not null").groupBy("_key").agg(F.first("_label").alias("_label"), F.first("_raw").alias("_raw"), F.min("_id").alias("_least"), F.count("*").alias("_n"))
    space = [F.octet_length("_raw"), F.col("_label")]
    classes = cut(classes.select("*", F.monotonically_increasing_id().alias("node"), F.xxhash64(*space).alias("space"), F.hash(*space).alias("check")))
    quantisers = {}
    by_length = classes.groupBy(F.octet_length("_raw").alias("bytes"), "space").count().groupBy("bytes").agg(F.max("count"), F.sum("count"))
    for size, largest, count in by_length.collect():  # one for each length of vector
        lists = max(1, min(-(-largest // rows_per_list), sample // PER_LIST))
        chosen = classes.where(F.octet_length("_raw") == size).orderBy(F.xxhash64("_key"), "_key").limit(min(count, lists * PER_LIST * 4, sample)).select("_raw").collect()
        points, dim = _unit([bytes(r[0]) for r in chosen], kind), size // kind.itemsize
        quantisers[dim] = _fitted(points, lists, -(-largest // (TALL * tile)), _reach(radius, deviations, dim))
    shared = spark.sparkContext.broadcast(quantisers)
    tall, broad = (TALL * tile, BROAD * tile) if any(q.bits > 8 for q in quantisers.values()) else (tile, tile)
    indexed = cut(classes.select("space", "check", "node", "_n", "_raw").mapInArrow(_indexed(shared, kind, radius, deviations), "cell long, node long, held boolean, data binary"))
    sizes = indexed.groupBy("cell").agg(F.count_if("held").alias("rows"), F.count_if(~F.col("held")).alias("queries"))
    sizes = cut(sizes.select("*", F.ceil(F.col("rows") / tall).cast("int").alias("row_tiles"), F.ceil(F.col("queries") / broad).cast("int").alias("query_tiles")))
    sent = sizes.agg(F.coalesce(F.sum(F.col("rows") * F.greatest("query_tiles", F.lit(1)) + F.col("queries") * F.greatest("row_tiles", F.lit(1))), F.lit(0))).first()[0]
    long = sizes.where("row_tiles > 1 or query_tiles > 1").drop("rows", "queries")
    many = long.count() > _NAMED
    joined = indexed.join(long if many else F.broadcast(long), "cell", "left")
    row_tiles, query_tiles = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("row_tiles", "query_tiles"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("held"), row_tiles).otherwise(query_tiles)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("held"), query_tiles).otherwise(row_tiles) - 1))
    dealt = joined.select("cell", "node", "held", "data", mine.alias("mine"), others.alias("other"))
    keys = ["cell", "row_tile", "query_tile"]
    tiles = dealt.select("cell", F.when(F.col("held"), F.col("mine")).otherwise(F.col("other")).alias("row_tile"), F.when(F.col("held"), F.col("other")).otherwise(F.col("mine")).alias("query_tile"), "node", "held", "data")
    ordered = tiles.repartition(max(partitions(spark), tasks_for(sent)), *keys).sortWithinPartitions(*keys)
    schema = "a long, b long, links long"
    found = cut(ordered.mapInArrow(_matched(shared, kind, radius), schema))
    side = lambda a, x, *more: classes.select(F.col("node").alias(a), F.col("_raw").alias(x), *more)
    undecided = found.where("links = -1").select("a", "b").distinct()
    exact = cut(undecided.join(side("a", "x"), "a").join(side("b", "y", F.col("_n").alias("weight")), "b").mapInArrow(_compared(kind, cosine), schema))
    found = found.where("links >= 0").unionByName(exact)
    links = found.groupBy("a").agg(F.sum("links").alias("_links"))
    roots = components(found.where("b is not null"))
    named = classes.select("_key", "_n", "_least", "node").join(links, F.col("node") == F.col("a"), "left").drop("a")
    named = named.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("_root", F.coalesce("root", "node")).drop("_node", "root")
    named = cut(named)
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    spread = cut(named.join(least, "_root").select("_key", "_n", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), "_component"))
    good = join_hot(rows.where("_key is not null").drop("_raw"), spread, "_key", "_n").select("_id", "_links", "_component")
    alone = rows.where("_key is null").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    return good.unionByName(alone).select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.coalesce(F.col("_id") == F.col("_component"), F.lit(False)).alias("kept"))
