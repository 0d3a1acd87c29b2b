"""Vectors compressed to codes of codebook entries, with adaptive distance bounds between rounds.

A vector of whole numbers is cut into parts; a code names each part's nearest codebook entry. Rounds assign
every part and then move the entries to their parts' means. Between rounds a table keeps, for each part, its
b closest entries in order, with a lower bound of the distance to each, and an outer bound for all others. When
entries have moved, the bounds shrink by as much; the distance to the entry a part had is computed anew, and
as long as it lies below the bounds nothing else can be nearer. Otherwise the entries whose bounds are
reached are computed, and all entries only if the outer bound is reached. b shrinks to what parts needed.
Bounds are floating numbers rounded to the safe side; whatever they leave open is settled in whole numbers,
with ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import drop_table, heavy_from, written

ENTRIES, PARTS, ROUNDS, SCALE = 64, 16, 2, 256
#: One of so many entries is among the closest at first, and the share of parts that the next b must suffice for.
CLOSEST, ENOUGH = 16, 0.95
#: Labels whose sums are broadcast; further ones are joined by a shuffle.
LABELS = 100_000
#: What floating bounds are widened by.
SLACK = 1e-6
#: Groups that smallest ids are sought in before the smallest of all.
GROUPS = 256
#: Whole numbers up to here are exact as floating numbers; beyond, plain integers of any size are used.
EXACT = 2**53


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as floating numbers where those are exact for all squares, else as integers of any size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) < 2**40:
        return scaled
    return np.array([int(s) if np.isfinite(s) else int(x) * scale for s, x in zip(scaled.ravel(), vectors.ravel(), strict=True)], object).reshape(vectors.shape)


def _rounded_down(bounds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        small = np.minimum(bounds, 60_000).astype(np.float16)
    return np.where(small > bounds, np.nextafter(small, np.float16(-1)), small).astype(np.float16)


class Codebooks:
    """The entries of all parts after some round, and how far each has moved in that round."""

    def __init__(self, entries: list[list[list[int]]], before: Codebooks | None = None):
        self.entries = entries  # part -> entry -> components
        self.largest = max((abs(x) for part in entries for entry in part for x in entry), default=0)
        self.width = len(entries[0][0])
        self.moved = np.zeros((len(entries), len(entries[0])))
        if before:
            gone = [[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for a, b in zip(*pair, strict=True)] for pair in zip(entries, before.entries, strict=True)]
            self.moved = np.sqrt([[float(min(g, 10**300)) for g in part] for part in gone]) * (1 + SLACK)

    def exact(self, vectors: np.ndarray) -> bool:
        """Whether floating numbers give all distances, times the number of entries, without rounding."""
        if vectors.dtype == object:
            return False
        largest = max(self.largest, int(np.abs(vectors).max(initial=0)))
        return (2 * largest) ** 2 * self.width * len(self.entries[0]) < EXACT

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


class Assigned:
    """Per vector and part: closest entries (the first is the nearest), bounds, squared distance, entries needed."""

    def __init__(self, near: np.ndarray, low: np.ndarray, squares: np.ndarray, needed: np.ndarray):
        self.near, self.low, self.squares, self.needed = near, low, squares, needed


def _ordered(keys: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From distance * k + entry: the closest entries in order, bounds for all but the first and the rest, the least square."""
    first = np.sort(np.partition(keys, min(keep, k - 1), axis=1)[:, : keep + 1], axis=1) if keep < k else np.sort(keys, axis=1)
    roots = np.sqrt(first // k)
    low = np.full((len(keys), keep), np.inf)
    low[:, : first.shape[1] - 1] = roots[:, 1:]
    return (first[:, :keep] % k).astype(np.uint8), low, first[:, 0] // k


def assign(vectors: np.ndarray, books: Codebooks, state: tuple[np.ndarray, np.ndarray] | None) -> Assigned:
    """Nearest entries of whole-number vectors; ``state`` holds near and low as of the round before."""
    n, parts, k = len(vectors), len(books.entries), len(books.entries[0])
    cut = vectors.reshape(n, parts, books.width)
    keep = state[0].shape[2] if state else min(k, max(2, k // CLOSEST))
    near, low = np.zeros((n, parts, keep), np.uint8), np.zeros((n, parts, keep))
    needed = np.zeros((n, parts), np.int64)
    if not books.exact(vectors):
        squares = np.zeros((n, parts), object)
        for p in range(parts):
            gaps = cut[:, p].astype(object)[:, None, :] - np.array(books.entries[p], object)[None]
            every = (gaps * gaps).sum(2)
            near[:, p, 0] = every.argmin(1)
            squares[:, p] = every[np.arange(n), near[:, p, 0]] if n else 0
        return Assigned(near, low, squares, needed + keep)  # bounds of zero: looked at again in any round
    squares = np.zeros((n, parts))
    for p in range(parts):
        x, entries = cut[:, p], np.array(books.entries[p], np.float64)
        sizes = (entries**2).sum(1)

        def keys_of(x: np.ndarray, entries=entries, sizes=sizes) -> np.ndarray:
            return ((x**2).sum(1)[:, None] - 2 * (x @ entries.T) + sizes) * k + np.arange(k)

        if not state:
            near[:, p], low[:, p], squares[:, p] = _ordered(keys_of(x), k, keep)
            continue
        ids = state[0][:, p].astype(np.int64)
        bounds = state[1][:, p].astype(np.float64)
        bounds[:, :-1] -= books.moved[p][ids[:, 1:]]
        bounds[:, -1] -= books.moved[p].max()
        bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
        own = ((x - entries[ids[:, 0]]) ** 2).sum(1)
        need = (bounds <= (np.sqrt(own) * (1 + SLACK) + SLACK)[:, None]).sum(1)
        all_of_them, some = np.flatnonzero(need == keep), np.flatnonzero((need > 0) & (need < keep))
        if len(some):
            mine, upto = ids[some], need[some]
            gaps = x[some][:, None, :] - entries[mine]
            keys = (gaps**2).sum(2) * k + mine
            keys[np.arange(keep)[None] > upto[:, None]] = np.inf  # not reached: stay behind, in their order
            order = np.argsort(keys, axis=1, kind="stable")
            known = np.take_along_axis(keys, order, 1)
            ids[some] = np.take_along_axis(mine, order, 1)
            own[some] = known[:, 0] // k
            reached = np.isfinite(known[:, 1:])
            bounds[some, :-1] = np.where(reached, np.sqrt(np.where(reached, known[:, 1:], 0) // k), bounds[some, :-1])
        near[:, p], low[:, p], squares[:, p], needed[:, p] = ids, bounds, own, need
        if len(all_of_them):
            near[all_of_them, p], low[all_of_them, p], squares[all_of_them, p] = _ordered(keys_of(x[all_of_them]), k, keep)
    return Assigned(near, low, squares, needed)


def _narrowed(found: Assigned, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The state to keep: as many closest entries as nearly all parts of these vectors needed, one more to go on."""
    keep = found.near.shape[2]
    if not first and found.needed.size:
        keep = int(min(keep, max(1, np.quantile(found.needed, ENOUGH, method="higher") + 1)))
    outer = found.low[:, :, keep - 1 :].min(2, keepdims=True) if found.low.size else found.low[:, :, :1]
    return found.near[:, :, :keep], _rounded_down(np.maximum(np.concatenate([found.low[:, :, : keep - 1], outer], 2), 0))


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def _groups(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray] | None]]:
    """Rows of a batch with their states; rows that keep different numbers of entries come apart."""
    if "near" not in batch.schema.names:
        yield batch, None
        return
    sizes = np.fromiter((len(x) for x in batch.column("near").to_pylist()), np.int64, len(batch))
    for size in np.unique(sizes):
        part = batch.filter(pa.array(sizes == size))
        near = np.frombuffer(b"".join(part.column("near").to_pylist()), np.uint8).reshape(len(part), parts, -1)
        yield part, (near, np.frombuffer(b"".join(part.column("low").to_pylist()), np.float16).reshape(near.shape))


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def _keep_state(rows: DataFrame, books: Codebooks, dimension: int, scale: int) -> DataFrame:
    """The rows with near and low after one more assignment."""
    first, parts = "near" not in rows.columns, len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, state in _groups(batch, parts):
                found = assign(whole(_vectors(part.column("embedding"), dimension), scale), books, state)
                near, low = _narrowed(found, first)
                kept = {name: part.column(name) for name in ("vec_id", "label", "embedding")}
                yield pa.RecordBatch.from_pydict({**kept, "near": _packed(near), "low": _packed(low)})

    schema = rows.select("vec_id", "label", "embedding").schema.add("near", "binary").add("low", "binary")
    return rows.mapInArrow(run, schema)


#: Sums are sent in digits of this base, so that they fit whatever the vectors hold.
_DIGIT = 2**32


def _sums(state: DataFrame, books: Codebooks, dimension: int, scale: int) -> list:
    """Per part, entry and place (-1: count): the sum over all vectors, added up in each task first."""
    parts, k, width = len(books.entries), len(books.entries[0]), books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            for part, (near, _) in _groups(batch, parts):
                vectors = whole(_vectors(part.column("embedding"), dimension), scale)
                cut = (vectors if vectors.dtype == object else vectors.astype(np.int64)).reshape(len(part), parts, width)
                for p in range(parts):
                    order = np.argsort(near[:, p, 0], kind="stable")
                    entries, starts = np.unique(near[order, p, 0], return_index=True)
                    counts[p, entries] += np.diff(np.append(starts, len(order)))
                    sums[p, entries] += np.add.reduceat(cut[order, p], starts, axis=0).astype(object)
        found = [(p, e, -1, 0, int(counts[p, e])) for p, e in np.argwhere(counts).tolist()]
        for p, e, _, _, _ in list(found):
            for place, total in enumerate(sums[p, e].tolist()):
                sign, rest, digit = (-1 if total < 0 else 1), abs(int(total)), 0
                while rest:
                    rest, low = divmod(rest, _DIGIT)
                    found.append((p, e, place, digit, sign * low))
                    digit += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _SUM_TYPES, strict=True)], names=_SUM_NAMES)

    partial = state.select("embedding", "near", "low").mapInArrow(run, "part int, entry int, place int, digit int, total long")
    return partial.groupBy("part", "entry", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


_SUM_NAMES = ["part", "entry", "place", "digit", "total"]
_SUM_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]


def _updated(books: Codebooks, sums: list) -> Codebooks:
    """Entries moved to the means of their parts, rounded down; those without parts stay."""
    totals: dict[tuple[int, int, int], int] = {}
    for row in sums:
        at = row["part"], row["entry"], row["place"]
        totals[at] = totals.get(at, 0) + int(row["total"]) * _DIGIT ** row["digit"]

    def moved(p: int, e: int, entry: list[int]) -> list[int]:
        count = totals.get((p, e, -1), 0)
        return [totals.get((p, e, i), 0) // count for i in range(len(entry))] if count else entry

    return Codebooks([[moved(p, e, entry) for e, entry in enumerate(part)] for p, part in enumerate(books.entries)], books)


def _coded(state: DataFrame, books: Codebooks, dimension: int, scale: int) -> DataFrame:
    """vec_id, label, code and error; an error beyond 64 bits is null."""
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kept in _groups(batch, parts):
                found = assign(whole(_vectors(part.column("embedding"), dimension), scale), books, kept)
                codes = [row.tobytes().hex() for row in np.ascontiguousarray(found.near[:, :, 0])]
                errors = [e if e < 2**63 else None for e in map(int, found.squares.sum(1).tolist())]
                columns = {"vec_id": part.column("vec_id"), "label": part.column("label"), "code": pa.array(codes, pa.string()), "error": pa.array(errors, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    return state.mapInArrow(run, state.select("vec_id", "label").schema.add("code", "string").add("error", "long"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of rows whose vector and all of its components are there and finite."""
    limit = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("embedding").isNotNull() & finite)


def _smallest(rows: DataFrame, most: int) -> list:
    """The rows of smallest id, equal ids by their vectors; sought in groups first, so that no task gets a share of each."""
    placed = rows.where("vec_id is not null").withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(GROUPS)))
    order = Window.partitionBy("group").orderBy("vec_id", "embedding")
    few = placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return few.orderBy("vec_id", "embedding").select("embedding").limit(most).collect()


def compress(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of all usable vectors: columns vec_id, code, error, label_error, codebooks_sha256.

    ``vectors`` has vec_id, embedding (an array of floating numbers) and label, whatever its type; other
    columns are left out. Rows whose vector is null, or holds null, NaN or infinite components, are left
    out, and so are vectors whose length differs from the commonest length that can be cut into ``parts``
    (of equally common ones, the shorter). Repeated rows count and are listed each; a null vec_id is coded
    but starts no entry, and without any id there are no codes. With fewer vectors than ``entries`` the
    codebooks are as many entries long. ``error`` is null if 64 bits can't hold it, and so is ``label_error``
    if that holds for any vector of the label, or for the sum. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits, so there may be 256 entries")
    spark, rows = vectors.sparkSession, usable(vectors)
    lengths = rows.where(F.size("embedding") > 0).where(F.size("embedding") % parts == 0).groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    commonest = lengths.agg(F.max(F.struct("n", (-F.col("size")).alias("size")))["size"]).first()[0]
    dimension = -(commonest or 0)
    rows = rows.where(F.size("embedding") == dimension)
    seeds = _smallest(rows, entries) if dimension else []
    if not seeds:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    start = [list(map(int, whole(np.array(seed["embedding"], np.float64)[None], scale)[0])) for seed in seeds]
    width = dimension // parts
    books = Codebooks([[vector[p * width : (p + 1) * width] for vector in start] for p in range(parts)])
    path = None
    for _ in range(rounds):
        rows, now = written(_keep_state(rows, books, dimension, scale))
        if path:
            drop_table(spark, path)
        path = now
        books = _updated(books, _sums(rows, books, dimension, scale))
    coded, _ = written(_coded(rows, books, dimension, scale))
    if path:
        drop_table(spark, path)
    return _with_label_sums(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _with_label_sums(coded: DataFrame) -> DataFrame:
    """``label_error``: sums of labels that many vectors have are broadcast, those of rare labels joined by a shuffle."""
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    sums, _ = written(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")))
    cut = heavy_from(sums, "n", LABELS)
    same = coded["label"].eqNullSafe(sums["label"])
    if not cut:
        return coded.join(F.broadcast(sums), same, "left").select("vec_id", "code", "error", "label_error")
    heavy = F.broadcast(sums.where(F.col("n") >= cut).select(F.col("label").alias("heavy"), F.col("label_error").alias("by_heavy"), F.lit(True).alias("is_heavy")))
    marked = coded.join(heavy, coded["label"].eqNullSafe(F.col("heavy")), "left")
    light = sums.where(F.col("n") < cut).select(F.col("label").alias("light"), "label_error")
    rest = marked.where("is_heavy is null").join(light, F.col("label").eqNullSafe(F.col("light")), "left").select("vec_id", "code", "error", "label_error")
    return marked.where("is_heavy").select("vec_id", "code", "error", F.col("by_heavy").alias("label_error")).unionByName(rest)


def _assignment(n: int, books: str) -> str:
    return f"""a{n} AS MATERIALIZED (
    SELECT vec_id, p, best % {ENTRIES} AS e, best // {ENTRIES} AS d FROM (
        SELECT vec_id, p, min(d * {ENTRIES} + e) AS best FROM (
            SELECT vec_id, p, e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d FROM x JOIN {books} b USING (p, i) GROUP BY ALL) GROUP BY ALL))"""


def _means(n: int) -> str:
    return f"""b{n + 1} AS MATERIALIZED (
    SELECT p, e, i, CASE WHEN c IS NULL THEN v ELSE (s - ((s % c) + c) % c) // c END::BIGINT AS v
    FROM b{n} LEFT JOIN (SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS c FROM x JOIN a{n} USING (vec_id, p) GROUP BY ALL) USING (p, e, i))"""


ORACLE = f"""
WITH kept AS (
    SELECT vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS MATERIALIZED (
    SELECT vec_id, (nth - 1) // (size // {PARTS}) AS p, (nth - 1) % (size // {PARTS}) AS i, floor({SCALE} * c::DOUBLE)::BIGINT AS v
    FROM (SELECT vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS nth, len(embedding) AS size FROM kept)),
b0 AS MATERIALIZED (
    SELECT p, e, i, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{", ".join(f"{_assignment(n, f'b{n}')}, {_means(n)}" for n in range(ROUNDS))},
{_assignment(ROUNDS, f"b{ROUNDS}")},
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS digest FROM b{ROUNDS}),
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""
