"""An inverted index of vectors: cells around coarse centroids, kept as parts of a table, of which a search names few.

Centroids are fitted by rounds of k-means over a bounded, hashed share of the rows, as sums that Spark adds up per cell;
every row is indexed under its nearest one. A search looks at each query's nearest cells until they hold `reach` times
the rows it asks for and are `probes` at least; only these folders are in the plan. How many probes a recall takes
depends on the vectors (few where they lie in clusters, most where they are noise), so `tune` measures it against
`search.knn`, which is the exact way, and keeps the number beside the index.

What the driver holds: centroids (4096 at most) and sizes of cells, and queries up to search.SMALL_BATCH. The space of
vectors (a model) is part of the index's name, and its dimension is checked. Rows without a vector, and vectors that are
zero or not finite, are not indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.sources.versions import Parts, Tables, part_of

PLACES = 64
PLACE = "vec_id long, cell long, near double"


def near_cells(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(vectors[at : at + 4096] @ centroids.T, axis=1) for at in range(0, len(vectors), 4096)]) if len(vectors) else np.zeros(0, np.int64)


def flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The unit vectors of a batch, all of one dimension."""
    return unit_rows(batch[column].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class VectorIndex:
    """Vectors of one space; by: columns kept beside them, to compare within."""

    def __init__(self, tables: Tables, space: str = "default", id_col: str = "vec_id", vector_col: str = "embedding"):
        self.tables, self.spark, self.space, self.id_col, self.vector_col = tables, tables.spark, space, id_col, vector_col
        self.rows, self.centroids, self.places, self.tuned = (f"{kind}-{space}" for kind in ("vectors", "centroids", "places", "tuned"))

    def _usable(self, vectors: DataFrame, dims: int | None) -> DataFrame:
        others = [c for c in vectors.columns if c not in (self.id_col, self.vector_col)]
        kind = "float" if vectors.schema[self.vector_col].dataType.simpleString() == "array<float>" else "double"
        plain = vectors.select(F.col(self.id_col).cast("long").alias("vec_id"), F.transform(self.vector_col, lambda v: v.cast(kind)).alias("embedding"), *others)
        bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        good = plain.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad & F.exists("embedding", lambda v: v != 0))
        if dims is None:
            return good
        right = F.assert_true(F.size("embedding") == dims, F.concat(F.lit(f"vectors of {self.space} have {dims} dimensions, not "), F.size("embedding").cast("string")))
        return good.where(right.isNull())

    def build(self, vectors: DataFrame, cells: int | None = None, most_cells: int = 4096, train_rows: int = 64, rounds: int = 8) -> None:
        """Fits the centroids, about one for the square root of the rows, on train_rows rows for each; indexes all rows."""
        base = self.tables.latest()
        rows = self._usable(vectors, None)
        n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if low != high:
            raise ValueError(f"vectors of {self.space} have {low} to {high} dimensions")
        cells = max(1, min(most_cells, cells or round(n**0.5)))
        share = int(min(1.0, cells * train_rows / max(1, n)) * (1 << 30))
        order = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30))
        sample = search_written(rows.where(order <= share).select("vec_id", "embedding"))
        first = sample.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(cells).toPandas()
        centroids = unit_rows(np.stack(first.embedding.to_numpy()).astype(np.float64)) if len(first) else np.zeros((1, low or 1))
        for _ in range(rounds if len(first) > 1 else 0):
            moved = centroids.copy()
            for r in sample.mapInArrow(sums(centroids), "cell long, total array<double>").groupBy("cell").applyInArrow(added, "cell long, total array<double>").toLocalIterator():
                if np.linalg.norm(r.total) > 0:
                    moved[r.cell] = np.array(r.total) / np.linalg.norm(r.total)
            done, centroids = float(np.abs(moved - centroids).max()) < 1e-3, moved
            if done:
                break
        known = self.spark.createDataFrame([(k, c.tolist(), int(low or 0)) for k, c in enumerate(centroids)], "cell long, centroid array<double>, dims int")
        schema, parts = self.tables.stage(self.centroids, known.coalesce(1).withColumn("part", F.lit(0)))
        drop = {name: {p: [] for p in self.tables.parts(name, base)} for name in (self.centroids, self.rows, self.places)}
        changes = self._staged(rows, centroids)
        self.tables.commit({self.centroids: (schema, {**drop[self.centroids], **parts}), **{n: (s, {**drop[n], **p}) for n, (s, p) in changes.items()}}, base)

    def _staged(self, rows: DataFrame, centroids: np.ndarray) -> dict[str, tuple[str, Parts]]:
        others = [c for c in rows.columns if c not in ("vec_id", "embedding")]
        schema = rows.select("vec_id", "embedding", *others).schema.add("cell", "long").add("near", "double")
        placed = search_written(rows.select("vec_id", "embedding", *others).mapInArrow(assigned(centroids), schema))
        own = self.tables.stage(self.rows, placed.drop("near").withColumn("part", F.col("cell")).repartition("part"))
        return {self.rows: own, self.places: self.tables.stage(self.places, placed.select("vec_id", "cell", "near", part_of(F.col("vec_id"), PLACES).alias("part")).repartition("part"))}

    def _centroids(self, version: int) -> tuple[np.ndarray, int]:
        known = self.tables.read(self.centroids, version).orderBy("cell").toPandas()
        return np.stack(known.centroid.to_numpy()), int(known.dims.iloc[0])

    def put(self, vectors: DataFrame, gone: DataFrame | None = None) -> None:
        """Adds vectors, or puts them in the place of those with the same ids; those of `gone` (vec_id) leave.

        Cells that hold old vectors of these ids are written anew, others get a further folder. Centroids stay.
        """
        base = self.tables.latest()
        centroids, dims = self._centroids(base)
        rows = self._usable(vectors, dims or None)
        ids = search_written((rows.select("vec_id") if gone is None else rows.select("vec_id").union(gone.select(F.col(self.id_col).cast("long")))).distinct())
        touched = [str(r[0]) for r in ids.select(part_of(F.col("vec_id"), PLACES)).distinct().collect()]
        places = self.tables.read(self.places, base, touched, PLACE)
        old = [str(r.cell) for r in places.join(ids, "vec_id", "left_semi").select("cell").distinct().collect()]
        fresh = self._staged(rows, centroids)
        stay = self.tables.read(self.rows, base, old).join(ids, "vec_id", "left_anti")
        kept = {
            self.rows: self.tables.stage(self.rows, stay.withColumn("part", F.col("cell")).repartition("part"))[1],
            self.places: self.tables.stage(self.places, places.join(ids, "vec_id", "left_anti").withColumn("part", part_of(F.col("vec_id"), PLACES)).repartition("part"))[1],
        }
        changes = {}
        for name, anew in ((self.rows, old), (self.places, touched)):
            schema, parts = fresh[name]
            before = self.tables.parts(name, base)
            changes[name] = (schema, {p: [*(kept[name].get(p, []) if p in anew else before.get(p, [])), *parts.get(p, [])] for p in {*parts, *anew}})
        self.tables.commit(changes, base)

    def tune(self, k: int, recall: float = 0.93, queries: int = 256) -> int:
        """Finds how many probes give the recall at k, on some of the indexed vectors as queries, and keeps the number."""
        base = self.tables.latest()
        centroids, _ = self._centroids(base)
        rows = self.tables.read(self.rows, base)
        asked = rows.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
        asked = search_written(asked)
        found = search.knn(rows, asked, k).select("query_id", "vec_id").join(self.tables.read(self.places, base), "vec_id").select("query_id", "cell").toPandas()
        own = asked.toPandas()
        order = np.argsort(-(search.unit(own.query_vector) @ centroids.T), axis=1, kind="stable") if len(own) else np.zeros((0, len(centroids)), int)
        turn = {q: np.argsort(order[k]) for k, q in enumerate(own.query_id)}
        needed = np.sort([turn[q][c] + 1 for q, c in zip(found.query_id, found.cell, strict=True)])
        probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1
        before = self.tables.read(self.tuned, base, schema="k long, probes long").where(F.col("k") != k)
        schema, parts = self.tables.stage(self.tuned, before.union(self.spark.createDataFrame([(k, probes)], "k long, probes long")).coalesce(1).withColumn("part", F.lit(0)))
        self.tables.commit({self.tuned: (schema, parts)}, base)
        return probes

    def probes_for(self, k: int, version: int) -> int:
        """The number tuned for the nearest k that isn't less, or else for the largest; 8 if none is."""
        known = {r.k: r.probes for r in self.tables.read(self.tuned, version, schema="k long, probes long").collect()}
        return known[min([x for x in known if x >= k], default=max(known))] if known else 8

    def radii(self, version: int) -> dict[int, float]:
        """The widest angle between a cell's centroid and one of its vectors."""
        widest = self.tables.read(self.places, version, schema=PLACE).groupBy("cell").agg(F.min("near").alias("near"))
        return {r.cell: float(np.arccos(np.clip(r.near, -1.0, 1.0))) for r in widest.collect()}

    def sizes(self, version: int) -> dict[int, int]:
        return {r.cell: r["count"] for r in self.tables.read(self.places, version).groupBy("cell").count().collect()}

    def search(self, queries: DataFrame, k: int = search.POOL, by: str | None = None, reach: int = 8, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, vec_id, similarity and rank of k near vectors of each query (query_id, query_vector, and by).

        Where they are compared within values of `by` only, k and what was tuned are of all vectors: give more probes.
        exact: a second search reads every cell that may hold a nearer vector than the k-th of the first, by the angle
        between query and centroid less the cell's radius. On vectors in clusters that leaves out most cells, on noise none.
        """
        version = self.tables.latest()
        probes = probes or self.probes_for(k, version)
        centroids, dims = self._centroids(version)
        sizes = np.array([n for _, n in sorted({**dict.fromkeys(range(len(centroids)), 0), **self.sizes(version)}.items())])
        same = F.lit("") if by is None else F.col(by).cast("string")
        # vectors of another dimension, or an index of none, have no neighbours here
        wanted = queries.select("query_id", "query_vector", same.alias("by")).where("by IS NOT NULL").where(F.size("query_vector") == (dims or -1))
        choose = lambda q: probed(search.unit(q.query_vector), centroids, sizes, k * reach, probes) if len(q) else []
        found = self._nearest(wanted, version, k, same, sizes, choose)
        if exact:
            last = search_written(search.top(found, [F.desc("similarity"), F.col("vec_id")], k).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least")))
            radii = np.array([r for _, r in sorted({**dict.fromkeys(range(len(centroids)), 0.0), **self.radii(version)}.items())])
            choose = lambda q: reachable(search.unit(q.query_vector), q.least.fillna(-2).to_numpy(), centroids, sizes, radii) if len(q) else []
            found = self._nearest(wanted.join(last, "query_id", "left"), version, k, same, sizes, choose)
        return search.top(found, [F.desc("similarity"), F.col("vec_id")], k)

    def _nearest(self, wanted: DataFrame, version: int, k: int, same: Column, sizes: np.ndarray, choose: Callable[[pd.DataFrame], list[np.ndarray]]) -> DataFrame:
        """The best k of each task for queries, within the cells that are chosen for them."""
        few = wanted.limit(search.SMALL_BATCH + 1).toPandas()
        if len(few) <= search.SMALL_BATCH:
            few["cells"] = choose(few)
            cells = {int(c) for own in few.cells for c in own}
            known = self.tables.read(self.rows, version, [str(c) for c in cells]).select("vec_id", "embedding", same.alias("by"), "cell")
            return known.mapInArrow(nearest_in_cells(few, k), search.NEAREST)
        known = self.tables.read(self.rows, version).select("vec_id", "embedding", same.alias("by"), "cell")
        asked = search_written(wanted.mapInArrow(with_cells(choose), "query_id long, query_vector array<double>, by string, cell long"))
        n = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
        rows = F.array(*[F.lit(max(1, -(-int(s) // 20_000))) for s in sizes])
        columns = F.array(*[F.lit(max(1, -(-n.get(c, 0) // search.SMALL_BATCH))) for c in range(len(sizes))])
        block = lambda key, of: F.pmod(F.xxhash64(key), F.get(of, F.col("cell").cast("int"))).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.get(of, F.col("cell").cast("int")) - 1))
        left = known.where(F.col("cell").isin([*n])).withColumn("i", block("vec_id", rows)).withColumn("j", every(columns))
        right = asked.withColumn("j", block("query_id", columns)).withColumn("i", every(rows))
        return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(lambda v, w: search.scored(w, v, k), search.NEAREST)


def search_written(df: DataFrame) -> DataFrame:
    from quillspark.operators.graph import written

    return written(df)


def sums(centroids: np.ndarray):
    """(vec_id, embedding) -> the sum of a task's vectors in each cell."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            if batch.num_rows:
                x = flat(batch, "embedding")
                cells = near_cells(x, centroids)
                for c in np.unique(cells).tolist():
                    total[c] = total.get(c, 0.0) + x[cells == c].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array([*total], pa.int64()), "total": pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))})

    return emit


def added(rows: pa.Table) -> pa.Table:
    total = np.stack(rows["total"].to_pandas().to_numpy()).sum(axis=0)
    return pa.table({"cell": pa.array([rows["cell"][0].as_py()], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def assigned(centroids: np.ndarray):
    """Rows with their cell and their cosine to its centroid."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = flat(batch, "embedding")
                cells = near_cells(x, centroids).astype(np.int64)
                near = np.einsum("ij,ij->i", x, centroids[cells])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    return emit


def probed(queries: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, rows: int, probes: int) -> list[np.ndarray]:
    """The nearest cells of each query, as many as hold `rows` vectors, `probes` at least."""
    out = []
    for at in range(0, len(queries), 256):
        order = np.argsort(-(queries[at : at + 256] @ centroids.T), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < rows).sum(axis=1) + 1
        out += [order[k, : max(n, probes)] for k, n in enumerate(enough.tolist())]
    return out


def reachable(queries: np.ndarray, least: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
    """The cells that may hold a vector as near to a query as `least`, by the triangle inequality of angles."""
    out = []
    for at in range(0, len(queries), 256):
        angle = np.arccos(np.clip(queries[at : at + 256] @ centroids.T, -1.0, 1.0))
        bound = np.cos(np.clip(angle - radii - 1e-6, 0.0, np.pi))
        # similarities are rounded to six places
        out += [np.flatnonzero(ok) for ok in ~(bound < least[at : at + 256, None] - 2e-6) & (sizes > 0)]
    return out


def nearest_in_cells(queries: pd.DataFrame, k: int):
    """vec_id, embedding, by, cell -> the best k of a task's vectors for each query that probes their cell."""
    of: dict[int, list[int]] = {}
    for row, cells in enumerate(queries.cells):
        for c in cells.tolist():
            of.setdefault(c, []).append(row)
    plain = queries[["query_id", "query_vector", "by"]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search.Best(plain, k)
        for batch in batches:
            for at in range(0, batch.num_rows, search.STEP):
                for c, v in batch.slice(at, search.STEP).to_pandas().groupby("cell", sort=False):
                    if c in of:
                        best.add(v, np.array(of[c]))
        yield from best.batches()

    return emit


def with_cells(choose: Callable[[pd.DataFrame], list[np.ndarray]]):
    """(query_id, query_vector, by) -> one row per cell that is chosen for the query, a bounded number at once: many cells may be."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                q = batch.slice(at, 256).to_pandas()
                q["cell"] = choose(q)
                q = q.explode("cell").dropna(subset="cell").astype({"cell": "int64"})
                for k in range(0, len(q), search.STEP):
                    own = q.iloc[k : k + search.STEP].copy()
                    own["query_vector"] = [np.asarray(v, np.float64) for v in own.query_vector]
                    yield pa.RecordBatch.from_pandas(own[["query_id", "query_vector", "by", "cell"]], preserve_index=False)

    return emit
