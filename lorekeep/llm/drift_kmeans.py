"""Centroid clustering whose bounds loosen by less than the centroids' full drift.

A vector keeps an upper bound on the distance to its own centroid and one lower bound on the
distance to any other. The vectors of a cluster lie in a sphere around its centroid. When another
centroid moves, the distance to it falls within that sphere by what planar geometry gives for the
plane through the three centres, often far less than the way it moved; by that much the lower
bound loosens. A vector whose bounds still lie apart keeps its cluster unseen, the others are
measured against all centroids in whole numbers.

Only the vectors' own rows are written between rounds, and one row per cluster, component and task
meets in a shuffle: no cluster, however large, comes together anywhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove, work_dir

#: Below this size of a component, squared distances are whole numbers that doubles hold exactly.
EXACT = 1 << 22
LONG = (1 << 63) - 1
_STATE = [T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()),
          T.StructField("lower", T.DoubleType()), T.StructField("scans", T.IntegerType())]
_LAST = [T.StructField("cluster", T.IntegerType()), T.StructField("scans", T.IntegerType()),
         T.StructField("distance", T.LongType()), T.StructField("full", T.StringType())]


@dataclass(frozen=True)
class Settings:
    clusters: int = 16
    rounds: int = 3
    dims: int = 64
    #: A component x becomes floor(scale * x).
    scale: int = 64
    #: Centroids start as the vectors with the least SHA-256 of this and their id.
    seed: str = "1:"
    #: Strips into which the planar bound cuts a sphere.
    strips: int = 256


SETTINGS = Settings()


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that are whole, or Python's integers where doubles would not do."""
    if not x.size or np.abs(x).max() * scale < EXACT:
        return np.floor(x * scale)
    big = [[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.tolist()]
    return np.array(big, dtype=object).reshape(x.shape)


def squares(q: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    if q.dtype != object and all(abs(v) < EXACT for c in centroids for v in c):
        c = np.array(centroids, np.float64)
        return (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)
    c = np.array(centroids, dtype=object)
    own = np.array([[int(v) for v in row] for row in q.tolist()], dtype=object).reshape(q.shape)
    return np.stack([((own - one) ** 2).sum(1) for one in c], axis=1)


def roots(d: np.ndarray) -> np.ndarray:
    """Square roots as doubles, infinite where a double cannot hold the square."""
    if d.dtype != object:
        return np.sqrt(d)
    return np.array([math.sqrt(v) if v < 1 << 1000 else math.inf for v in d.ravel()]).reshape(d.shape)


def fall_within(own: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray, strips: int) -> float:
    """Upper bound on ``|x - old| - |x - new|`` for all x within ``radius`` of ``own``.

    In the plane through the three centres (beyond it the difference is smaller) let t run along the way
    from old to new. The difference is that of the squares, linear in t, over the sum of
    both distances; each strip of t takes its largest numerator and its least denominator.
    """
    way = float(np.linalg.norm(new - old))
    if way == 0:
        return 0.0
    along = (new - old) / way
    t_old = float((old - own) @ along)
    t_new = t_old + way
    off = float(np.linalg.norm((old - own) - t_old * along))
    edge = np.linspace(-radius, radius, strips + 1)
    lo, hi = edge[:-1], edge[1:]
    nearest_t = np.where((lo <= 0) & (hi >= 0), 0.0, np.minimum(np.abs(lo), np.abs(hi)))
    aside = np.maximum(0.0, off - np.sqrt(np.maximum(0.0, radius * radius - nearest_t**2)))

    def away(t: float) -> np.ndarray:
        return np.hypot(aside, np.maximum(0.0, np.maximum(t - hi, lo - t)))

    top = 2 * hi * way + t_old**2 - t_new**2
    return float(min(way, np.max(np.maximum(0.0, top) / np.maximum(way, away(t_old) + away(t_new)))))


def doubled(v: int) -> float:
    """As a double; infinite beyond, which leaves bounds open and so is measured exactly."""
    return float(v) if abs(v) < 1 << 1000 else math.inf if v > 0 else -math.inf


@dataclass(frozen=True)
class Move:
    """What the bounds need to know of a round: per cluster its drift, how far lower bounds
    loosen, half the way to the next centroid; and the slack of the arithmetic.
    """

    drift: np.ndarray
    loosen: np.ndarray
    half: np.ndarray
    slack: float


def moved(old: list[list[int]], new: list[list[int]], radii: list[float], strips: int) -> Move:
    a, b = (np.array([[doubled(v) for v in row] for row in c]) for c in (old, new))
    k = len(a)
    loosen = np.zeros(k)
    for i in range(k):
        falls = [fall_within(a[i], radii[i], a[j], b[j], strips) for j in range(k) if j != i]
        loosen[i] = np.max(falls, initial=0.0)
    apart = np.sqrt(((b[:, None] - b[None]) ** 2).sum(-1)) + np.diag(np.full(k, math.inf))
    slack = 1e-9 * (1 + float(np.abs(np.stack([a, b])).max()) * math.sqrt(a.shape[1]))
    return Move(np.linalg.norm(b - a, axis=1), loosen, apart.min(1) / 2, slack)


def assigned(x: np.ndarray, state: tuple | None, centroids: list[list[int]], move: Move | None, scale: int) -> tuple:
    """(cluster, upper, lower, scans) of the rows of ``x``; with no state, all are scanned."""
    n = len(x)
    if state is None:
        cluster, upper, lower, scans = np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n, np.int32)
        todo = np.arange(n)
    else:
        cluster, upper, lower, scans = (s.copy() for s in state)
        upper += move.drift[cluster]
        lower -= move.loosen[cluster]
        lower_all = np.maximum(lower, move.half[cluster])

        def open_(rows: np.ndarray) -> np.ndarray:
            gap = lower_all[rows] - upper[rows]
            return rows[~(gap > move.slack + 1e-9 * (upper[rows] + np.abs(lower[rows])))]

        todo = open_(np.arange(n))
        for c in np.unique(cluster[todo]):
            own = todo[cluster[todo] == c]
            upper[own] = roots(squares(whole(x[own], scale), [centroids[c]]))[:, 0]
        todo = open_(todo)
    if len(todo):
        d = squares(whole(x[todo], scale), centroids)
        best = np.argmin(d, axis=1)
        far = roots(d)
        at = np.arange(len(todo))
        cluster[todo], upper[todo] = best, far[at, best]
        far[at, best] = math.inf
        lower[todo] = far.min(1)
        scans[todo] += 1
    return cluster, upper, lower, scans


def vectors(batch: pa.RecordBatch, place: int, dims: int) -> np.ndarray:
    lists = batch.column(0).field(place)
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """An integer as (place, signed part of 32 bits): sums of any size add up in longs."""
    sign, value, place = (-1 if value < 0 else 1), abs(int(value)), 0
    while value or not place:
        yield place, sign * (value & 0xFFFFFFFF)
        value >>= 32
        place += 1


def _sums(df: DataFrame, of) -> dict[tuple[int, int], tuple[int, float]]:
    """{(cluster, part): (sum, largest radius)} of what ``of(batch)`` yields, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        widest: dict[int, float] = {}
        for batch in batches:
            for c, sums, radius in of(batch):
                widest[c] = max(widest.get(c, 0.0), radius)
                for part, v in enumerate(sums):
                    total[c, part] = total.get((c, part), 0) + int(v)
        rows = [(c, part, limb, v, widest[c]) for (c, part), s in total.items() for limb, v in limbs(s)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["cluster", "part", "limb", "value", "radius"])

    parts = df.mapInArrow(run, "cluster int, part int, limb int, value long, radius double")
    found: dict[tuple[int, int], tuple[int, float]] = {}
    # At most clusters x (dims + 1) x limbs rows.
    for r in parts.groupBy("cluster", "part", "limb").agg(F.sum("value").alias("v"), F.max("radius").alias("r")).collect():
        v, radius = found.get((r["cluster"], r["part"]), (0, 0.0))
        found[r["cluster"], r["part"]] = (v + (r["v"] << (32 * r["limb"])), max(radius, r["r"]))
    return found


def cluster_vectors(
    df: DataFrame, settings: Settings = SETTINGS, id_column: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, list[list[int]], dict[int, int]]:
    """Vectors with ``cluster``, ``distance`` (squared) and ``scans``; the centroids; the distance summed by cluster.

    Kept are rows whose vector has exactly ``dims`` components, none null, NaN or infinite; all their
    columns pass through (one named like a result is replaced). ``scans`` counts the passes
    in which a vector was measured against all centroids, of ``rounds + 1``.
    A null id never starts a centroid; equal ids start in the order of their vectors; of
    fewer vectors than ``clusters`` each starts one. Ties go to the smaller number. An empty table
    gives no rows and no centroids. Components of any finite size count exactly; a distance
    beyond a long is null. Very long vectors have the wrong length and are left out.
    """
    spark, s = df.sparkSession, settings
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    e = F.col(f"row.`{vector}`")
    rows = rows.where((F.size(e) == s.dims) & F.forall(
        e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < math.inf)))
    hashed = rows.select(F.sha2(F.concat(F.lit(s.seed), F.col(f"row.`{id_column}`").cast("string")), 256).alias("h"), e.alias("e"))
    first = hashed.where("h IS NOT NULL").orderBy("h", "e").limit(s.clusters).collect()
    centroids = [[int(v) for v in whole(np.array([r["e"]], np.float64), s.scale)[0]] for r in first]
    place = [c.lower() for c in df.columns].index(vector.lower())
    kind = rows.schema["row"]

    def step(frame: DataFrame, centroids: list[list[int]], move: Move | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = vectors(batch, place, s.dims)
                state = move and tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
                with np.errstate(all="ignore"):
                    out = _apart(x, state, centroids, move, s.scale)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *map(pa.array, out)], names=["row", "cluster", "upper", "lower", "scans"])

        return frame.mapInArrow(run, T.StructType([kind, *_STATE]))

    def added(batch: pa.RecordBatch):
        x, cluster, upper = vectors(batch, place, s.dims), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for c in np.unique(cluster):
            mine = cluster == c
            q = whole(x[mine], s.scale)
            yield int(c), [*q.sum(0), int(mine.sum())], float(upper[mine].max())

    def measured(frame: DataFrame, centroids: list[list[int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, cluster = whole(vectors(batch, place, s.dims), s.scale), batch.column(1).to_numpy()
                d: list[int] = [0] * len(q)
                for c in np.unique(cluster):
                    mine = np.flatnonzero(cluster == c)
                    for i, v in zip(mine, squares(q[mine], [centroids[c]])[:, 0]):
                        d[i] = int(v)
                fits = pa.array([v if v <= LONG else None for v in d], pa.int64())
                full = pa.array([str(v) for v in d], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(4), fits, full],
                    names=["row", "cluster", "scans", "distance", "full"])

        return frame.mapInArrow(run, T.StructType([kind, *_LAST]))

    held = [c for c in df.columns if c.lower() not in ("cluster", "distance", "scans")]
    shown = [F.col(f"row.`{c}`").alias(c) for c in held] + ["cluster", "distance", "scans"]
    if not centroids:
        none = rows.where(F.lit(False)).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "scans": F.lit(0)})
        return none.select(*shown), [], {}

    def written(frame: DataFrame) -> tuple[DataFrame, str]:
        path = work_dir(spark, "clusters")
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path), path

    state, path = written(step(rows, centroids, None))
    for _ in range(s.rounds):
        sums = _sums(state, added)
        new = [[sums[c, p][0] // sums[c, s.dims][0] for p in range(s.dims)] if (c, s.dims) in sums else old
               for c, old in enumerate(centroids)]
        radii = [sums.get((c, s.dims), (0, 0.0))[1] for c in range(len(new))]
        with np.errstate(all="ignore"):
            move = moved(centroids, new, radii, s.strips)
        after, next_path = written(step(state, new, move))
        remove(spark, path)
        state, path, centroids = after, next_path, new
    last, _ = written(measured(state, centroids))
    remove(spark, path)

    def spent(batch: pa.RecordBatch):
        for c, full in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield c, [int(full)], 0.0

    inertia = {c: v for (c, _), (v, _) in _sums(last.select("cluster", "full"), spent).items()}
    return last.select(*shown), centroids, inertia


def _apart(x, state, centroids, move, scale) -> tuple:
    """``assigned``, with vectors beyond exact doubles on their own, so they do not slow down the others."""
    big = (np.abs(x) * scale >= EXACT).any(1) if len(x) else np.zeros(0, bool)
    if not big.any() or big.all():
        return assigned(x, state, centroids, move, scale)
    out = tuple(np.zeros(len(x), t) for t in (np.int32, np.float64, np.float64, np.int32))
    for mine in (big, ~big):
        part = assigned(x[mine], state and tuple(v[mine] for v in state), centroids, move, scale)
        for to, v in zip(out, part):
            to[mine] = v
    return out


def cluster_digest(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Per kept vector its cluster and squared distance, the sums of these, and the hash of its final centroid."""
    done, centroids, inertia = cluster_vectors(df.select("vec_id", "embedding"), settings)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda v: F.lit(v if v <= LONG else None).cast("long")
    at = F.col("cluster") + 1
    own = F.element_at(F.array(*[fit(inertia.get(c, 0)) for c in range(len(names))]), at) if names else F.lit(0).cast("long")
    name = F.element_at(F.array(*map(F.lit, names)), at) if names else F.lit("")
    return done.select(
        "vec_id", "cluster", "distance", own.alias("cluster_inertia"), fit(sum(inertia.values())).alias("inertia"),
        name.alias("centroid_sha256"))


def _sql(s: Settings = SETTINGS) -> str:
    """The same rows in SQL: every vector against every centroid in every round."""
    each = f"range(1, {s.dims + 1})"

    def nearest(c: str) -> str:
        return (f"SELECT row_id, vec_id, q, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM ("
                f"SELECT v.row_id, v.vec_id, v.q, {c}.c, list_sum([(v.q[i] - {c}.m[i]) * (v.q[i] - {c}.m[i]) FOR i IN {each}])::BIGINT AS d "
                f"FROM v, {c}) GROUP BY row_id, vec_id, q")

    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id,
  [CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE len(embedding) = {s.dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{s.seed}' || vec_id), q) - 1 AS c, q AS m FROM v
  WHERE vec_id IS NOT NULL QUALIFY c < {s.clusters})"""]
    for r in range(s.rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
  SELECT cluster, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS m FROM (
    SELECT cluster, i, (sum(q[i]) - ((sum(q[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
    FROM a{r}, (SELECT unnest({each}) AS i) GROUP BY cluster, i) GROUP BY cluster) n ON n.cluster = c{r}.c)""")
    steps.append(f"z AS MATERIALIZED ({nearest(f'c{s.rounds}')})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{s.rounds}.m, ',')) AS centroid_sha256
FROM z JOIN c{s.rounds} ON c{s.rounds}.c = cluster"""


CLUSTER_SQL = _sql()
