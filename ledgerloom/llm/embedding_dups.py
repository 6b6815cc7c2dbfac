"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision where they leave a doubt.

Equal vectors are merged first. A vector u of length 1 is kept as int8 codes q times a scale s; e = |u - s q| is measured, not
estimated, so u.v lies within e_u + (1 + e_u) e_v of s_u s_v q_u.q_v for every pair. Tiles of vectors are dealt in squares of two
groups of tiles, whose products are exact integers; pairs surely below the threshold are dropped, those surely above it become
links, and only the others are computed again in double precision. Vectors are ordered around pivots, so that tiles are compact, and a product
is spared where the angle between two tiles' centres is larger than their radii and the threshold allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, components, forest, partitions, stored, stored_and_measured

THRESHOLD = 0.95
#: At most so many vectors, and so many codes, in a tile; so many tiles in a group.
TILE_ROWS, TILE_CODES, GROUP_TILES = 2048, 1 << 18, 4
#: Pivots are a bounded sample, and only decide the order of vectors, so which products are spared, never the result.
PIVOTS = 64
#: Room for rounding in double precision, beside the measured quantisation error.
ROUNDING = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component so that nothing over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales and errors of unit vectors: |u - scale * codes| <= error, row by row."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    off = u - scale[:, None] * codes
    return codes, scale, np.sqrt((off * off).sum(axis=1)) + ROUNDING


class Tile:
    """What a tile's product needs: codes, scales, errors, weights, ids, centre and radius."""

    def __init__(self, tile, n, dim, ids, weights, codes, scales, errors, centre, radius):
        self.tile, self.n, self.dim, self.radius = tile, n, dim, radius
        self.ids, self.weights = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
        self.codes = np.frombuffer(codes, np.int8).reshape(n, dim)
        self.scales, self.errors, self.centre = np.frombuffer(scales, np.float64), np.frombuffer(errors, np.float64), np.frombuffer(centre, np.float64)


def apart(a: Tile, b: Tile, threshold: float) -> bool:
    """True if no vector of a can reach the threshold with one of b: angles obey the triangle inequality."""
    between = np.arccos(np.clip(a.centre @ b.centre, -1, 1))
    return bool(between > a.radius + b.radius + np.arccos(threshold) + 1e-6)


def product(a: Tile, b: Tile, threshold: float, strip: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) by strips: the pairs of vectors of a and b that can reach the threshold, and whether they surely do. In one tile i < j."""
    # sums of so many products of bytes are exact in single precision up to 2**24, in double far beyond
    kind = np.float32 if a.dim * 127 * 127 < 1 << 24 else np.float64
    right = np.ascontiguousarray(b.codes.T.astype(kind))
    most_scale, most_error = b.scales.max(), b.errors.max()
    for lo in range(0, a.n, strip):
        rows = slice(lo, min(lo + strip, a.n))
        dots = a.codes[rows].astype(kind) @ right
        need = threshold - a.errors[rows] - (1 + a.errors[rows]) * most_error - ROUNDING
        # the least dot that any vector of b would need; where need isn't above 0 every pair is looked at
        least = np.where(need > 0, need / (a.scales[rows] * most_scale), -np.inf)
        i, j = np.nonzero(dots >= (least * (1 - 1e-6))[:, None].astype(kind))
        i += lo
        if a is b:
            i, j = i[i < j], j[i < j]
        about = a.scales[i] * b.scales[j] * dots[i - lo, j].astype(np.float64)
        bound = a.errors[i] + (1 + a.errors[i]) * b.errors[j] + ROUNDING
        may = about + bound >= threshold
        yield i[may], j[may], (about - bound >= threshold)[may]


_OUT = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("pairs", pa.binary())])
_OUT_SQL = "kind string, a long, b long, n long, pairs binary"


def _batch(kind: str, a: np.ndarray, b: np.ndarray | None = None, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(a), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        own = len(a[at])
        col = lambda x: pa.nulls(own, pa.int64()) if x is None else pa.array(x[at].astype(np.int64))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array([kind] * own), col(a), col(b), col(n), pa.nulls(own, pa.binary())], schema=_OUT)


class Links:
    """Links of one task's vectors: how many each has, and edges that connect what they connect."""

    def __init__(self):
        self.ids, self.counts, self.edges = [], [], []

    def add(self, a_ids, b_ids, a_weights, b_weights, i, j):
        for ids, at, weights, other in ((a_ids, i, b_weights, j), (b_ids, j, a_weights, i)):
            n = np.bincount(at, weights=weights[other], minlength=len(ids)).astype(np.int64)
            self.ids.append(ids[n > 0])
            self.counts.append(n[n > 0])
        self.edges.append(np.stack(forest(a_ids[i], b_ids[j])))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            ids, at = np.unique(np.concatenate(self.ids), return_inverse=True)
            yield from _batch("count", ids, n=np.bincount(at, weights=np.concatenate(self.counts)).astype(np.int64))
            u, v = forest(*np.concatenate(self.edges, axis=1))
            yield from _batch("edge", u, v)


def _square(threshold: float):
    """Of two groups of tiles (or one with itself) all products."""

    def compute(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        one, two = rows[0]["one"], rows[0]["two"]
        tiles = {r["tile"]: Tile(r["tile"], r["n"], r["dim"], r["ids"], r["weights"], r["codes"], r["scales"], r["errors"], r["centre"], r["radius"]) for r in rows}
        links, doubts = Links(), []
        for a in tiles.values():
            for b in tiles.values():
                if a.tile > b.tile or a.dim != b.dim or (one != two and a.tile // GROUP_TILES == b.tile // GROUP_TILES) or apart(a, b, threshold):
                    continue
                unsure = []
                for i, j, sure in product(a, b, threshold):
                    if sure.any():
                        links.add(a.ids, b.ids, a.weights, b.weights, i[sure], j[sure])
                    unsure.append(np.stack([i[~sure], j[~sure]]).astype(np.uint16))
                unsure = np.concatenate(unsure, axis=1)
                if unsure.size:
                    doubts.append({"kind": "doubt", "a": a.tile, "b": b.tile, "n": unsure.shape[1], "pairs": unsure.tobytes()})
        return pa.Table.from_batches([pa.RecordBatch.from_pylist(doubts, _OUT), *links.batches()], _OUT)

    return compute


def _settle(threshold: float):
    """The doubtful pairs of two tiles, in double precision."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                links = Links()
                side = lambda k: [np.frombuffer(r[f"{x}_{k}"], t) for x, t in (("ids", np.int64), ("weights", np.int64), ("vectors", np.float64))]  # noqa: B023, E731
                (a_ids, a_weights, a), (b_ids, b_weights, b) = side("a"), side("b")
                a, b = a.reshape(len(a_ids), -1), b.reshape(len(b_ids), -1)
                pairs = np.frombuffer(r["pairs"], np.uint16).reshape(2, -1).astype(np.int64)
                for lo in range(0, pairs.shape[1], 1 << 14):
                    i, j = pairs[:, lo : lo + (1 << 14)]
                    x, y = a[i], b[j]
                    cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                    good = cosine >= threshold
                    if good.any():
                        links.add(a_ids, b_ids, a_weights, b_weights, i[good], j[good])
                yield from links.batches()

    return compute


_TILE_SQL = "part long, seq long, n int, dim int, ids binary, weights binary, codes binary, scales binary, errors binary, centre binary, radius double, vectors binary"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a partition's sorted vectors (uid, weight, embedding) into tiles of one dimension."""
    part, seq = TaskContext.get().partitionId(), 0
    fields = {"part": pa.int64(), "seq": pa.int64(), "n": pa.int32(), "dim": pa.int32()} | dict.fromkeys(("ids", "weights", "codes", "scales", "errors", "centre"), pa.binary()) | {"radius": pa.float64(), "vectors": pa.binary()}
    schema = pa.schema(list(fields.items()))

    def tile(held):
        nonlocal seq
        x = np.array([v for _, _, v in held], np.float64)
        x = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1))))[:, None]  # powers of two change no bit of a cosine
        u = unit(x)
        codes, scale, error = quantised(u)
        centre = u.sum(axis=0)
        long = np.sqrt(centre @ centre)
        centre = centre / long if long > 1e-9 else u[0]
        radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
        raw = {"ids": np.array([h[0] for h in held], np.int64), "weights": np.array([h[1] for h in held], np.int64), "codes": codes, "scales": scale, "errors": error, "centre": centre, "vectors": x}
        row = {"part": part, "seq": seq, "n": len(held), "dim": x.shape[1], "radius": radius} | {k: np.ascontiguousarray(v).tobytes() for k, v in raw.items()}
        seq += 1
        return pa.RecordBatch.from_pylist([row], schema)

    held = []
    for batch in batches:
        for uid, weight, vector in zip(*(batch.column(c).to_pylist() for c in ("uid", "weight", "embedding")), strict=True):
            if held and (len(vector) != len(held[0][2]) or len(held) >= max(1, min(TILE_ROWS, TILE_CODES // len(vector)))):
                yield tile(held)
                held = []
            held.append((uid, weight, vector))
    if held:
        yield tile(held)


def _cells(pivots: dict[int, np.ndarray]):
    """Adds to each vector its dimension, its nearest pivot and how near that is."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            cell, near, dims = np.zeros(len(vectors), np.int32), np.zeros(len(vectors)), np.array([len(v) for v in vectors], np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in pivots:
                    cosines = unit(np.array([vectors[k] for k in at], np.float64)) @ pivots[d].T
                    cell[at], near[at] = cosines.argmax(axis=1), cosines.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(near)], names=[*batch.schema.names, "dim", "cell", "near"])

    return compute


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows at a cosine of ``threshold`` or more), component_id, kept.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing and are components of their own;
    vectors of different dimensions don't link. Rows with equal vectors link with each other; so do rows repeated with one id, which
    share a verdict. A component's id is its smallest vec_id, null if it has none; kept is vec_id = component_id, nulls being equal.
    The threshold is above 0. Empty tables give no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("digest", F.when(F.coalesce(good, F.lit(False)), F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256)))
    rows, seen = stored_and_measured(rows.withColumn("_row", F.monotonically_increasing_id()), F.count("digest").alias("n"))
    merged = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    single = stored(merged.withColumn("uid", F.monotonically_increasing_id()))
    # the smallest digests are as good as drawn by lot, and the same in any run
    drawn: dict[int, list] = {}
    for r in single.select("digest", "embedding").orderBy("digest").limit(PIVOTS).collect():
        drawn.setdefault(len(r.embedding), []).append(r.embedding)
    pivots = {d: unit(np.array(v, np.float64)) for d, v in drawn.items()}
    own = single.select("uid", "weight", "embedding")
    placed = own.mapInArrow(_cells(pivots), "uid long, weight long, embedding array<double>, dim int, cell int, near double")
    order = ["dim", "cell", "near", "uid"]
    cut = stored(placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_tiles, _TILE_SQL))
    # partitions are as many as the session says, whatever the data
    before, starts = 0, {}
    for r in cut.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts[r.part] = before
        before += r.n
    if not before:
        starts = {0: 0}
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("part").cast("int"))
    tiles = cut.withColumn("tile", start.cast("long") + F.col("seq"))
    groups = max(1, -(-before // GROUP_TILES))
    mine = F.floor(F.col("tile") / GROUP_TILES)
    squares = tiles.drop("vectors", "part", "seq").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("*", F.least(mine, "other").alias("one"), F.greatest(mine, "other").alias("two"))
    found = stored(squares.drop("other").groupBy("one", "two").applyInArrow(_square(threshold), _OUT_SQL))
    full = lambda k: tiles.select(F.col("tile").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("ids", "weights", "vectors")])
    settled = stored(found.where("kind = 'doubt'").join(full("a"), "a").join(full("b"), "b").select("pairs", *[f"{c}_{k}" for k in "ab" for c in ("ids", "weights", "vectors")]).mapInArrow(_settle(threshold), _OUT_SQL))
    links = found.unionByName(settled)
    counts = links.where("kind = 'count'").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
    roots = components(links.where("kind = 'edge'").select("a", "b"))
    known = single.drop("embedding").join(counts, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    known, met = stored_and_measured(known.select("uid", "digest", "weight", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root")), F.count("*").alias("n"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    verdicts = stored(attach(known, stored(least), "root", "size", met["n"], F.col("uid")).select("digest", "weight", "n_links", "component_id"))
    out = attach(rows.drop("embedding"), verdicts, "digest", "weight", seen["n"], F.col("_row"))
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
