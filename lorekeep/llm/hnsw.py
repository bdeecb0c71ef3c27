"""Near-duplicate embeddings by navigable small-world graphs, one hierarchy per shard.

Vectors of one label are dealt into shards of bounded size. Each shard's graph is built
in batches that numpy handles whole; then every vector queries every shard of its
label. Beams widen until each query has seen past the similarity, and until an
audit against all vectors of the shard finds nothing missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import components, shuffle_width


@dataclass(frozen=True)
class Settings:
    """Similarity of a link, graph degrees, beams, and the audit."""

    cosine: float = 0.98
    degree: int = 16
    build_beam: int = 48
    beam: int = 32
    #: Vectors of a shard, and queries that move through a graph together.
    shard_rows: int = 4096
    batch: int = 512
    #: Queries of a shard that the audit compares with all its vectors, and the recall it asks for.
    audit: int = 128
    recall: float = 0.98


SETTINGS = Settings()


class Graph:
    """A hierarchy over unit vectors: layer 0 has all of them, each further one about 1 in ``degree``."""

    def __init__(self, x: np.ndarray, s: Settings, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.s, self.entry = x.astype(np.float32), s, entry
        self.layers = layers or []

    @classmethod
    def build(cls, x: np.ndarray, s: Settings) -> Graph:
        g, n = cls(x, s), len(x)
        u = np.random.default_rng(5).random(n)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(s.degree)).astype(np.int64), 6)
        if n:
            level[0] = level.max()  # the first vector is the entry
        g.layers = [np.full((n, 2 * s.degree if not k else s.degree), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        done = 1
        while done < n:
            size = min(done, s.batch, n - done)
            g._insert(np.arange(done, done + size), level)
            done += size
        return g

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        """Link a batch: candidates are what a search finds, and the rest of the batch."""
        q = self.x[new]
        near = np.zeros((len(new), 1), np.int64)
        among = q @ q.T
        np.fill_diagonal(among, -2)
        for k in range(len(self.layers) - 1, -1, -1):
            near, _ = self._walk(q, near, k, self.s.build_beam if k <= level[new].max() else 4)
            mine = np.flatnonzero(level[new] >= k)
            if not len(mine):
                continue
            mates = among[np.ix_(mine, mine)]
            take = min(self.s.degree, len(mine))
            top = np.argpartition(-mates, take - 1, axis=1)[:, :take]
            fellow = np.where(np.take_along_axis(mates, top, 1) > -2, new[mine][top], -1)
            found = np.concatenate([near[mine], fellow], axis=1)
            # A batch of one layer may not know older vectors of that layer at all.
            found[(found >= 0) & (level[np.maximum(found, 0)] < k)] = -1
            picked = self._select(new[mine], found, self.s.degree)
            self.layers[k][new[mine], :picked.shape[1]] = picked
            self._link_back(k, new[mine], picked)

    def _link_back(self, k: int, new: np.ndarray, picked: np.ndarray) -> None:
        src = np.repeat(new, picked.shape[1])
        dst = picked.ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        node, start, count = np.unique(dst, return_index=True, return_counts=True)
        width = self.layers[k].shape[1]
        for a in range(0, len(node), self.s.batch):
            own, first, n = node[a:a + self.s.batch], start[a:a + self.s.batch], np.minimum(count[a:a + self.s.batch], 4 * width)
            extra = np.full((len(own), int(n.max())), -1, np.int64)
            at = np.arange(extra.shape[1])
            fits = at < n[:, None]
            extra[fits] = src[(first[:, None] + at)[fits]]
            picked = self._select(own, np.concatenate([self.layers[k][own].astype(np.int64), extra], axis=1), width)
            self.layers[k][own] = -1
            self.layers[k][own, :picked.shape[1]] = picked

    def _select(self, node: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        """For each node up to ``most`` of ``found``: first those nearer to it than to one already taken."""
        found = np.where(found == node[:, None], -1, found)
        ordered = np.sort(found, axis=1)
        repeat = np.zeros(found.shape, bool)
        repeat[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        found = np.where(repeat, -1, ordered)
        sims = np.where(found >= 0, np.einsum("qcd,qd->qc", self.x[found], self.x[node]), -3.0)
        keep = min(found.shape[1], 3 * most)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        vectors = self.x[found]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(found.shape, bool)
        closest = np.full(found.shape, -3.0)
        for c in range(keep):
            ok = (found[:, c] >= 0) & (sims[:, c] > closest[:, c]) & (taken.sum(1) < most)
            taken[:, c] = ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, c]), closest)
        rank = np.argsort(~taken * 2 + (found < 0), axis=1, kind="stable")[:, :most]  # then the nearest of the rest
        return np.take_along_axis(found, rank, 1)

    def _walk(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search in layer ``k`` for all rows of ``q`` at once: (numbers, similarities), best first."""
        rows, links = np.arange(len(q))[:, None], self.layers[k]
        seen = np.zeros((len(q), len(self.x) + 1), bool)  # the last column takes what is no vector
        seen[:, -1] = True
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -4.0, np.float32)
        start = start[:, :beam]
        ids[:, :start.shape[1]] = start
        sims[:, :start.shape[1]] = np.where(start >= 0, np.einsum("qcd,qd->qc", self.x[start], q), -4.0)
        seen[rows, start] = True
        open_ = ids >= 0
        step = min(4, beam)
        live = np.arange(len(q))
        while len(live):
            # The beam is sorted, so the first open ones are the best.
            pick = np.argsort(~open_[live], axis=1, kind="stable")[:, :step]
            chosen = np.where(np.take_along_axis(open_[live], pick, 1), np.take_along_axis(ids[live], pick, 1), -1)
            open_[live[:, None], pick] = False
            near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            got = np.where(near >= 0, np.einsum("qcd,qd->qc", self.x[near], q[live]), -4.0).astype(np.float32)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], got], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)
            live = live[open_[live].any(1)]
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.full((len(q), 1), self.entry, np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            near, _ = self._walk(q, near, k, 8)
        return self._walk(q, near, 0, beam)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) of all found at ``least`` or more; a beam that holds nothing below is doubled."""
        out_q, out_n, todo = [], [], np.arange(len(q))
        while len(todo):
            beam, again = min(beam, len(self.x)), []
            for a in range(0, len(todo), self.s.batch):
                own = todo[a:a + self.s.batch]
                ids, sims = self.search(q[own], beam)
                full = (sims[:, -1] >= least) & (beam < len(self.x))
                hit = (sims >= least) & (ids >= 0) & ~full[:, None]
                r, c = np.nonzero(hit)
                out_q.append(own[r])
                out_n.append(ids[r, c])
                again.append(own[full])
            todo, beam = np.concatenate(again), beam * 2
        return (np.concatenate(out_q), np.concatenate(out_n)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def audited(graph: Graph, x: np.ndarray, q: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Links of queries ``q`` to the shard's ``x``, at beams that a sample of the queries proves wide enough.

    The sample's queries are spread over all of them. What the audit itself finds is a
    link too. A beam as wide as the shard sees everything that can be reached.
    """
    least, beam = s.cosine - 1e-4, s.beam  # single precision walks, double precision decides
    sample = np.unique(np.linspace(0, len(q) - 1, min(len(q), s.audit)).astype(np.int64)) if len(q) else np.zeros(0, np.int64)
    exact_q, exact_n = np.nonzero(q[sample] @ x.T >= s.cosine)
    wanted = sample[exact_q] * len(x) + exact_n
    while True:
        got_q, got_n = graph.within(q.astype(np.float32), least, beam)
        found = np.isin(wanted, got_q * len(x) + got_n).sum()
        if found >= s.recall * len(wanted) or beam >= len(x):
            break
        beam *= 2
    pair = np.union1d(got_q * len(x) + got_n, wanted)
    a, b = pair // len(x), pair % len(x)
    cosine = np.empty(len(a))
    for i in range(0, len(a), 1 << 16):
        cosine[i:i + (1 << 16)] = np.einsum("pd,pd->p", q[a[i:i + (1 << 16)]], x[b[i:i + (1 << 16)]])
    return a[cosine >= s.cosine], b[cosine >= s.cosine]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of ``n`` over links (a, b)."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


SHARD = "label int, dim int, shard int, ids binary, copies binary, vectors binary, links binary, widths array<int>"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def build_shards(reps: DataFrame, s: Settings) -> DataFrame:
    """A row per shard: its vectors and its graph."""
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / s.shard_rows).cast("int").alias("_shards"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("_shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        dim = table.column("dim")[0].as_py()
        raw = np.array([v for chunk in table.column("embedding").chunks for v in chunk.flatten().to_numpy(zero_copy_only=False)],
                       np.float64).reshape(-1, dim)
        x = unit(raw)
        graph = Graph.build(x, s)
        return pa.table({
            "label": table.column("label")[:1], "dim": table.column("dim")[:1], "shard": table.column("shard")[:1],
            "ids": [table.column("rep").to_numpy().astype(np.int64).tobytes()],
            "copies": [table.column("copies").to_numpy().astype(np.int64).tobytes()], "vectors": [x.tobytes()],
            "links": [b"".join(k.tobytes() for k in graph.layers)],
            "widths": pa.array([[k.shape[1] for k in graph.layers]], pa.list_(pa.int32())),
        })

    return dealt.drop("_shards").groupBy("label", "dim", "shard").applyInArrow(build, SHARD)


def query_shards(shards: DataFrame, s: Settings) -> DataFrame:
    """(id, links, root): for each pair of shards of a label, links found either way.

    The links of a pair of shards stay in the task; it hands on their number for each
    vector and the smallest id that it reaches, so as many rows as there are vectors.
    """
    names = ["label", "dim"]
    held = shards.groupBy(*names).agg(F.max("shard").alias("_most"))
    pairs = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_most")))).withColumn(
        "j", F.explode(F.sequence("i", "_most"))).drop("_most")
    fields = ["ids", "copies", "vectors", "links", "widths"]
    one = shards.select(*names, F.col("shard").alias("i"), F.struct(*fields).alias("a"))
    two = shards.select(*names, F.col("shard").alias("j"), F.struct(*fields).alias("b"))
    work = pairs.join(one, [*names, "i"]).join(two, [*names, "j"])
    # The tasks are few and long: a row in each, so far as there are executors for them.
    work = work.repartition(8 * shuffle_width(shards), "label", "dim", "i", "j").select("dim", "i", "j", "a", "b")

    def load(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
        x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), dim)
        links, layers, at = np.frombuffer(row["links"], np.int32), [], 0
        for width in row["widths"]:
            layers.append(links[at:at + len(ids) * width].reshape(len(ids), width))
            at += len(ids) * width
        return ids, copies, x, Graph(x, s, layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, copies, x, graph = load(row["a"], row["dim"])
                if row["i"] == row["j"]:
                    a, b = audited(graph, x, x, s)
                    n = len(ids)
                else:
                    ids2, copies2, y, graph2 = load(row["b"], row["dim"])
                    a, b = audited(graph, x, y, s)  # a: of y, b: of x
                    b2, a2 = audited(graph2, y, x, s)
                    n = len(ids) + len(ids2)
                    a, b = np.append(a, a2) + len(ids), np.append(b, b2)
                    ids, copies = np.append(ids, ids2), np.append(copies, copies2)
                pair = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
                a, b = pair // n, pair % n
                a, b = a[a != b], b[a != b]
                count = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
                order = np.argsort(ids, kind="stable")
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n)
                root = ids[order][forest(rank[a], rank[b], n)[rank]]
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(count[some].astype(np.int64)), pa.array(root[some])],
                    names=["id", "links", "root"])

    return work.mapInArrow(run, "id long, links long, root long")


def link_vectors(vectors: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are one class with a number of copies, which all link with
    each other. Null labels, null or zero vectors and vectors with null or non-finite
    components link with nothing, nor do vectors of different length. vec_ids are taken
    as distinct; equal rows count as copies. An empty table gives no rows.
    """
    numbers = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(numbers, lambda v: v != 0)
    key = [F.xxhash64(F.lit(i), "label", "embedding") for i in (1, 2)]
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), numbers.alias("embedding")).withColumn(
        "_good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("_k1", F.when(F.col("_good"), key[0])).withColumn("_k2", F.when(F.col("_good"), key[1]))
    reps = rows.where("_good").groupBy("_k1", "_k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    reps = settle(reps, "vector-classes")
    shards = settle(build_shards(reps.drop("_k1", "_k2"), s), "shards")
    found = settle(query_shards(shards, s), "vector-links")
    parts = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = reps.select("_k1", "_k2", "rep", "copies").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(
        parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("_k1", "_k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "rep").alias("component_id"))
    return rows.select("vec_id", "_k1", "_k2").join(classes, ["_k1", "_k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
