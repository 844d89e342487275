"""Nearest neighbours by cross-polytope hashing: a stated query set against all rows.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform and takes the
signed axis nearest to it as its code; TABLES turns give as many tables. A row lies in one cell of every
table, the first code; each further code (`depth`) divides a cell. A query probes the codes in order
of the distance between its turned vector and their axes (the least sum of squared gaps to the best
axis). Candidates of all probed cells are ranked by the exact distance of the original vectors.

How many codes a query probes is measured, not fixed: of CALIBRATION queries the true neighbours are
found by one brute-force pass, and with them the probe at which each is met; the number of probes is
the least that meets RECALL of them. So recall holds as the table grows, at more probes or more cells.

Skew. Cells are counted first. Rows of a cell go into blocks of at most ROWS or four times the mean,
its queries into blocks of QUERIES; each block of rows meets each block of queries, so a ball of near
copies is spread over as many tasks as it has blocks. Equal vectors of a batch travel with their k + 1
least ids only: no other one can be among the k nearest of any query. Queries that found fewer than k
rows probe every cell in a second pass, which is exact.

Vectors that do not all have one length (within a hundredth) are lifted to the sphere by one more
coordinate, sqrt(M * M - |x| * |x|), M the greatest length, as Euclidean distance depends on length.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor rows without an id, nor vectors whose number of components is not the most frequent one (the least
of equals). Rows equal in id and vector are one row; rows that share an id with other vectors are rows
of their own, and queries of their own. Fewer than k candidates: all of them. Columns other than vec_id
and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut_lineage

K = 10
TABLES = 3
SEED = 20260311
#: A cell is divided by a further code where the table has this many rows for each of the codes then.
CODE_ROWS = 1024
#: Queries whose true neighbours are sought by brute force, and the part of these that the probes must meet.
CALIBRATION, RECALL = 128, 0.96
#: Probes a query has at most; where they miss RECALL, cells are divided less deeply.
MOST_PROBES = 16_384
ROWS, LEAST_ROWS, QUERIES = 65_536, 256, 8192
#: Queries whose distances to a block are held at once.
_AT_ONCE = 128


def _turned(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotation: three rounds of signs and Hadamard transform; unit has a power of two columns."""
    x, n = unit, unit.shape[1]
    for round_signs in signs:
        x = x * round_signs
        width = 1
        while width < n:
            pairs = x.reshape(len(x), n // (2 * width), 2, width)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(len(x), n)
            width *= 2
        x = x / math.sqrt(n)
    return x


@dataclass(frozen=True)
class Space:
    """What all tasks know of the table: components, greatest length if vectors are lifted, and the hashes."""

    size: int
    lift: float | None
    double: bool
    seed: int = SEED

    @property
    def kind(self) -> np.dtype:
        return np.dtype(np.float64 if self.double else np.float32)

    @property
    def width(self) -> int:
        return 1 << max(1, (self.size + (self.lift is not None) - 1).bit_length())

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors of `width` components, lifted where lengths differ."""
        scale = np.abs(vectors).max(axis=1, keepdims=True)
        length = np.sqrt(((vectors / scale) ** 2).sum(axis=1, keepdims=True)) * scale
        out = np.zeros((len(vectors), self.width))
        if self.lift is None:
            out[:, : self.size] = vectors / length
        else:
            share = np.minimum(length / self.lift, 1.0)
            out[:, : self.size] = vectors / self.lift
            out[:, self.size] = np.sqrt(1.0 - share[:, 0] ** 2)
        return out

    def gaps(self, unit: np.ndarray, table: int, level: int) -> np.ndarray:
        """How far each vector's best signed axis is before each of the 2 * width axes."""
        signs = np.random.default_rng([self.seed, table, level]).choice([-1.0, 1.0], (3, self.width))
        turned = _turned(unit, signs)
        both = np.concatenate([turned, -turned], axis=1)
        return both.max(axis=1, keepdims=True) - both

    def codes(self, unit: np.ndarray, table: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code within the cell of each vector."""
        cell = self.gaps(unit, table, 0).argmin(axis=1)
        fine = np.zeros(len(unit), np.int64)
        for level in range(1, depth):
            fine = fine * (2 * self.width) + self.gaps(unit, table, level).argmin(axis=1)
        return cell, fine

    def probes(self, unit: np.ndarray, table: int, depth: int, most: int) -> np.ndarray:
        """For each query its `most` nearest codes (cell and rest as one number), nearest first."""
        n = len(unit)
        axes = 2 * self.width
        cost, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for level in range(depth):
            gap = self.gaps(unit, table, level) ** 2
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * axes + np.arange(axes)).reshape(n, -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :most]
            cost, code = np.take_along_axis(cost, order, 1), np.take_along_axis(code, order, 1)
        return code

    def fine_codes(self, depth: int) -> int:
        return (2 * self.width) ** (depth - 1)


def _matrix(column: pa.Array, space: Space) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(space.kind).reshape(len(column), space.size)


def _fits(embedding: Column) -> Column:
    """Is the vector there, not zero, and are all its components numbers?"""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return embedding.isNotNull() & F.forall(embedding, number) & F.exists(embedding, lambda x: x != 0)


def _described(rows: DataFrame) -> tuple[DataFrame, Space | None, int]:
    """The rows that take part, what is known of them, and their number; one pass over the table."""
    kind = dict(rows.dtypes)["embedding"]
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & _fits(F.col("embedding"))).withColumn("size", F.size("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.min(length).alias("least"), F.max(length).alias("most"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    if most is None:
        return rows, None, 0
    level = most["least"] > 0 and most["most"] <= 1.01 * most["least"]
    space = Space(most["size"], None if level else float(most["most"]), kind != "array<float>")
    return rows.where(F.col("size") == space.size).drop("size"), space, most["n"]


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    gap = vectors - query
    out = np.sqrt((gap * gap).sum(axis=1))
    far = ~np.isfinite(out)
    if far.any():
        scale = np.abs(gap[far]).max(axis=1, keepdims=True)
        out[far] = scale[:, 0] * np.sqrt(((gap[far] / scale) ** 2).sum(axis=1))
    return out


class _Block:
    """Candidates of a cell, distinct, ordered by the code within the cell."""

    def __init__(self, vec_id: np.ndarray, fine: np.ndarray, data: list[bytes], space: Space):
        order = np.argsort(fine, kind="stable")
        if len(np.unique(vec_id)) < len(vec_id):  # rows that repeat an id: equal ones count once
            seen: set[tuple[int, bytes]] = set()
            order = np.array([k for k in order.tolist() if (key := (int(vec_id[k]), data[k])) not in seen and not seen.add(key)], np.int64)
        self.vec_id, self.fine = vec_id[order], fine[order]
        own = np.frombuffer(b"".join(data), space.kind).reshape(len(data), space.size)[order]
        self.own, self.vectors = own, own.astype(np.float64)
        with np.errstate(over="ignore"):
            self.squares = (self.vectors**2).sum(axis=1)

    def nearest(self, vec_id: int, query: np.ndarray, rough: np.ndarray, at: np.ndarray | None, k: int) -> list[tuple[float, int]]:
        """The k nearest rows (score, vec_id) other than the query's own, of the rows `at`, by squared distances with rounding errors."""
        want = k + 1
        slack = 1e-9 * (float(self.squares.max()) + float(query @ query)) if np.isfinite(rough).all() else np.inf
        if len(rough) > want:
            bound = np.partition(rough, want - 1)[want - 1]
            near = np.flatnonzero(rough <= bound + slack) if np.isfinite(slack) else np.arange(len(rough))
        else:
            near = np.arange(len(rough))
        near = near if at is None else at[near]
        score = _exact(query, self.vectors[near])
        ids = self.vec_id[near]
        mine = (ids == vec_id) & (self.own[near] == query.astype(self.own.dtype)).all(axis=1)
        score, ids = score[~mine], ids[~mine]
        order = np.lexsort([ids, score])[:k]
        return list(zip(score[order].tolist(), ids[order].tolist(), strict=True))


_KEPT = "array<struct<score:double,vec_id:bigint>>"
_FOUND = f"query_id long, own long, kept {_KEPT}"
_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("own", pa.int64()), ("kept", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])


def _found(rows: list[tuple[int, int, list[tuple[float, int]]]]) -> pa.Table:
    columns = [[r[k] for r in rows] for k in range(3)]
    columns[2] = [[{"score": s, "vec_id": i} for s, i in kept] for kept in columns[2]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _FOUND_SCHEMA.types, strict=True)], schema=_FOUND_SCHEMA)


def _meeting(space: Space, k: int) -> Callable[[pa.Table], pa.Table]:
    """Blocks of candidates and of queries that probe them -> the k nearest of each query within the block."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("own").is_valid().to_numpy()
        if asks.all() or not asks.any():
            return _found([])
        rows, queries = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        fine = np.array([int.from_bytes(b, "little") for b in rows.column("codes").to_pylist()], np.int64)
        block = _Block(rows.column("vec_id").to_numpy(), fine, rows.column("data").to_pylist(), space)
        whole = not len(np.flatnonzero(block.fine))
        ids, own = queries.column("vec_id").to_pylist(), queries.column("own").to_pylist()
        data = queries.column("data").to_pylist()
        vectors = np.frombuffer(b"".join(data), space.kind).reshape(len(data), space.size).astype(np.float64)
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            if whole:
                for start in range(0, len(ids), _AT_ONCE):
                    some = vectors[start : start + _AT_ONCE]
                    rough = block.squares - 2.0 * (some @ block.vectors.T)
                    out += [(ids[q], own[q], block.nearest(ids[q], vectors[q], rough[q - start], None, k)) for q in range(start, start + len(some))]
            else:
                for q, codes in enumerate(queries.column("codes").to_pylist()):
                    wanted = np.frombuffer(codes, np.int32)
                    a, b = np.searchsorted(block.fine, wanted, "left"), np.searchsorted(block.fine, wanted, "right")
                    at = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange(int((b - a).sum()))
                    rough = block.squares[at] - 2.0 * (block.vectors[at] @ vectors[q])
                    out.append((ids[q], own[q], block.nearest(ids[q], vectors[q], rough, at, k) if len(at) else []))
        return _found([r for r in out if r[2]])

    return run


_SENT = "block long, vec_id long, own long, codes binary, data binary"
_SENT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


@dataclass(frozen=True)
class _Layout:
    """Blocks of rows and of queries in each cell, numbered through."""

    first: np.ndarray  # [table, cell] number of the cell's first block
    rows: np.ndarray
    queries: np.ndarray

    @staticmethod
    def of(counts: dict[tuple[int, int], tuple[int, int]], cells: int, tables: int) -> _Layout:
        rows, queries = np.zeros((tables, cells), np.int64), np.zeros((tables, cells), np.int64)
        for (table, cell), (n, m) in counts.items():
            rows[table, cell], queries[table, cell] = n, m
        most = min(ROWS, max(LEAST_ROWS, int(4 * rows.sum() / max(1, (rows > 0).sum()))))
        rows, queries = -(-rows // most), -(-queries // QUERIES)
        size = (rows * queries).ravel()
        return _Layout((np.cumsum(size) - size).reshape(rows.shape), rows, queries)


def _hash(values: np.ndarray) -> np.ndarray:
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(3)


def _distinct(batch: pa.RecordBatch, space: Space, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch; of equal vectors the k + 1 least ids, which are all that any query can want."""
    vec_id, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"), space)
    name = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    order = np.argsort(vec_id, kind="stable")
    _, group = np.unique(name[order], return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    ordered = group[by_group]
    place = np.arange(len(ordered)) - np.searchsorted(ordered, ordered, "left")
    # Equal rows of one id take one place.
    ids = vec_id[order][by_group]
    if len(np.unique(vec_id)) < len(vec_id):
        fresh = np.append(True, (ordered[1:] != ordered[:-1]) | (ids[1:] != ids[:-1]))
        by_group, ordered = by_group[fresh], ordered[fresh]
        place = np.arange(len(ordered)) - np.searchsorted(ordered, ordered, "left")
    keep = order[by_group[place <= k]]
    return vec_id[keep], vectors[keep]


def _cells(rows: DataFrame, space: Space, k: int) -> DataFrame:
    """(tab, cell, n): rows that travel, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = space.unit(_distinct(batch, space, k)[1].astype(np.float64))
            for table in range(TABLES):
                cell, n = np.unique(space.codes(unit, table, 1)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), table)), pa.array(cell), pa.array(n)], ["tab", "cell", "n"])

    return rows.mapInArrow(run, "tab long, cell long, n long").groupBy("tab", "cell").agg(F.sum("n").alias("n"))


def _sent_rows(rows: DataFrame, space: Space, depth: int, layout: _Layout, tables: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id, vectors = _distinct(batch, space, k)
            unit = space.unit(vectors.astype(np.float64))
            data = [v.tobytes() for v in vectors]
            for table in range(tables):
                cell, fine = space.codes(unit, table, depth)
                part = _hash(vec_id) % np.maximum(layout.rows[table, cell], 1).astype(np.uint64)
                copies = layout.queries[table, cell]
                at = np.repeat(np.arange(len(cell)), copies)
                copy = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                block = layout.first[table, cell[at]] + part[at].astype(np.int64) * copies[at] + copy
                codes = [int(f).to_bytes(4, "little") if depth > 1 else b"" for f in fine[at]]
                columns = [block, vec_id[at], pa.nulls(len(at), pa.int64()), codes, [data[j] for j in at.tolist()]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _SENT_TYPES, strict=True)],
                                                 [c.split()[0] for c in _SENT.split(", ")])

    return rows.mapInArrow(run, _SENT)


def _probed(unit: np.ndarray, space: Space, table: int, depth: int, probes: int | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(query, cell, codes within the cell) of the probes; None: every cell whole."""
    if probes is None:
        every = np.arange(space.fine_codes(depth))
        yield from ((q, cell, every) for q in range(len(unit)) for cell in range(2 * space.width))
        return
    size = space.fine_codes(depth)
    for q, code in enumerate(space.probes(unit, table, depth, probes)):
        cell, fine = np.divmod(np.sort(code), size)
        name, at = np.unique(cell, return_index=True)
        for c, a, b in zip(name.tolist(), at.tolist(), [*at[1:].tolist(), len(cell)], strict=True):
            yield q, c, fine[a:b]


def _sent_queries(queries: DataFrame, space: Space, depth: int, layout: _Layout | None, tables: int, probes: int | None) -> DataFrame:
    """Queries by block of rows that they probe; without a layout the number of queries by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"), space)
            own = batch.column("own").to_numpy()
            part = _hash(own)
            for table in range(tables):
                for start in range(0, len(vec_id), 64):  # so that the probes of few queries are held at once
                    unit = space.unit(vectors[start : start + 64].astype(np.float64))
                    out = []
                    for q, cell, fine in _probed(unit, space, table, depth, probes):
                        q += start
                        if layout is None:
                            out.append((table, cell, 1))
                            continue
                        shares = int(layout.queries[table, cell])
                        codes, data = fine.astype(np.int32).tobytes() if depth > 1 else b"", vectors[q].tobytes()
                        for r in range(int(layout.rows[table, cell])):
                            block = int(layout.first[table, cell]) + r * shares + int(part[q] % np.uint64(shares))
                            out.append((block, int(vec_id[q]), int(own[q]), codes, data))
                    if out:
                        names = ["tab", "cell", "n"] if layout is None else [c.split()[0] for c in _SENT.split(", ")]
                        types = [pa.int64()] * 3 if layout is None else _SENT_TYPES
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    if layout is not None:
        return queries.mapInArrow(run, _SENT)
    return queries.mapInArrow(run, "tab long, cell long, n long").groupBy("tab", "cell").agg(F.sum("n").alias("m"))


def _probed_blocks(rows: DataFrame, queries: DataFrame, space: Space, depth: int, tables: int, probes: int | None, k: int) -> DataFrame:
    """The nearest of each query in each block that it probes."""
    counted = _cells(rows, space, k).where(F.col("tab") < tables).join(
        _sent_queries(queries, space, depth, None, tables, probes), ["tab", "cell"], "left")
    # At most TABLES * 2 * width rows, whatever the table's size.
    counts = {(r["tab"], r["cell"]): (r["n"], r["m"] or 0) for r in counted.collect()}
    layout = _Layout.of(counts, 2 * space.width, tables)
    sent = _sent_rows(rows, space, depth, layout, tables, k).unionByName(_sent_queries(queries, space, depth, layout, tables, probes))
    return sent.groupBy("block").applyInArrow(_meeting(space, k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    kept = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept")))), 1, k)
    return found.groupBy("query_id", "own").agg(kept.alias("kept"))


def _depth(n: int, space: Space) -> int:
    return max(1, int(math.log(max(1.0, n / CODE_ROWS), 2 * space.width)))


def _calibrated(rows: DataFrame, queries: DataFrame, space: Space, depth: int, k: int, recall: float) -> tuple[int, int]:
    """(depth, probes): the deepest division, of `depth` at most, whose probes meet `recall` of the true neighbours of a few queries."""
    some = queries.orderBy(F.xxhash64("vec_id", "own"), "vec_id").limit(CALIBRATION).collect()
    axes = 2 * space.width
    if not some:
        return 1, 1
    ids = [r["vec_id"] for r in some]
    wanted = np.array([r["embedding"] for r in some], space.kind)
    unit = space.unit(wanted.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of a task to each chosen query, and at each depth the probe that meets them first."""
        best: list[list[tuple[float, int, bytes]]] = [[] for _ in ids]
        for batch in batches:
            vec_id, vectors = _distinct(batch, space, k)
            block = _Block(vec_id, np.zeros(len(vec_id), np.int64), [v.tobytes() for v in vectors], space)
            with np.errstate(over="ignore", invalid="ignore"):
                rough = block.squares - 2.0 * (wanted.astype(np.float64) @ block.vectors.T)
            place = {int(i): j for j, i in enumerate(block.vec_id.tolist())}
            for q in range(len(ids)):
                near = block.nearest(ids[q], wanted[q].astype(np.float64), rough[q], None, k)
                best[q] = sorted({*best[q], *((s, i, block.own[place[i]].tobytes()) for s, i in near)})[:k]
        out = []
        for q, near in enumerate(best):
            if not near:
                continue
            other = space.unit(np.frombuffer(b"".join(v for _, _, v in near), space.kind).reshape(len(near), space.size).astype(np.float64))
            at = np.full((len(near), depth), MOST_PROBES, np.int64)
            for table in range(TABLES):
                for d in range(1, depth + 1):
                    cell, fine = space.codes(other, table, d)
                    code = cell * space.fine_codes(d) + fine
                    order = space.probes(unit[q : q + 1], table, d, MOST_PROBES)[0]
                    hit = order[None, :] == code[:, None]
                    at[:, d - 1] = np.minimum(at[:, d - 1], np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
            out += [(q, s, i, p) for (s, i, _), p in zip(near, at.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())], strict=True)],
                                             ["q", "score", "vec_id", "met"])

    near = rows.mapInArrow(run, "q long, score double, vec_id long, met array<long>").distinct()
    first = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id", "met"))), 1, k)
    lists = near.groupBy("q").agg(first.alias("near")).collect()  # CALIBRATION rows
    met = np.array([x["met"] for r in lists for x in r["near"]], np.int64).reshape(-1, depth)
    if not len(met):
        return 1, 1
    for d in range(depth, 0, -1):
        probes = int(np.sort(met[:, d - 1])[math.ceil(recall * len(met)) - 1]) + 1
        if probes <= min(MOST_PROBES, axes**d):
            return d, probes
    return 1, axes


def search(rows: DataFrame, wanted: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): of the rows with `wanted` (a condition on vec_id) the k nearest other rows."""
    spark = bounded_batches(rows.sparkSession)
    rows, space, n = _described(rows)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(wanted).withColumn("own", F.xxhash64("embedding")).dropDuplicates(["vec_id", "own"])
    depth, probes = _calibrated(rows, queries, space, _depth(n, space), k, recall)
    found = cut_lineage(_best(_probed_blocks(rows, queries, space, depth, TABLES, probes, k), k))
    # Queries that the probes gave fewer than k rows look into every cell of one table.
    enough = found.where(F.size("kept") >= k).select(F.col("query_id").alias("vec_id"), "own")
    short = cut_lineage(queries.join(enough, ["vec_id", "own"], "left_anti"))
    if not short.isEmpty():
        rest = _best(_probed_blocks(rows, short, space, 1, 1, None, k), k)
        found = found.where(F.size("kept") >= k).unionByName(rest)
    ranked = found.select("query_id", F.posexplode("kept").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
