"""Near-duplicate vectors by iterative quantisation (Gong and Lazebnik 2011) and Hamming tables.

Vectors are projected on their principal axes and turned by a learned rotation, so that the signs
are balanced bits that keep angles. The code is cut into short keys, one per table; vectors that
share the key of any table meet there and are compared by their original components. A pair that
shares several keys counts in the first of these tables alone. Equal vectors are folded before.

A crowded bucket is cut into blocks; every two blocks meet in a task of their own, which returns a
link count and one connecting link per vector, never its pairs. So nothing is capped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import staged
from wayfare.llm.components import components

SIMILARITY = 0.93
BITS, KEY_BITS = 64, 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; very large and small rows keep their angle."""
    v = np.asarray(vectors, float)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray

    def keys(self, units: np.ndarray, key_bits: int) -> np.ndarray:
        """Key of each table: the code cut into stretches of ``key_bits`` signs."""
        signs = (units - self.mean) @ self.axes > 0
        tables = -(-signs.shape[1] // key_bits)
        signs = np.pad(signs, ((0, 0), (0, tables * key_bits - signs.shape[1])))
        return signs.reshape(len(signs), tables, key_bits) @ (1 << np.arange(key_bits))


def learn(units: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 5) -> Rotation:
    """Principal axes and the rotation that brings the projections close to signs."""
    dims = units.shape[1]
    bits, rng = min(bits, dims), np.random.default_rng(seed)
    mean = units.mean(0)
    _, axes = np.linalg.eigh((units - mean).T @ (units - mean))
    axes = axes[:, ::-1][:, :bits]
    projected = (units - mean) @ axes
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return Rotation(mean, axes @ turn)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _usable():
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & some, F.lit(False))


def _keyed(folded: DataFrame, models: dict[int, Rotation], key_bits: int) -> DataFrame:
    """(id, label, dims, units, keys, copies)"""
    sent = folded.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                units = unit(_matrix(own["embedding"]))
                model = sent.value.get(int(d))
                # A dimension the sample did not have: an unlearned rotation is right, only less even.
                model = model or learn(np.eye(int(d)), rounds=0)
                keys = model.keys(units, key_bits).astype(np.int64)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    for x in (units, keys)
                ]
                yield pa.RecordBatch.from_arrays([own["id"], own["label"], own["dims"], *lists, own["copies"]], names)

    names = ["id", "label", "dims", "units", "keys", "copies"]
    schema = "id long, label long, dims int, units array<double>, keys array<long>, copies long"
    return folded.mapInArrow(run, schema)


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(keyed: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, n, root) per vector and meeting: links found there, and an id it is connected with."""
    rows = keyed.select("*", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dims", "t", "key"]
    counts = rows.groupBy(*bucket).count().filter("count > 1")
    blocks = staged(counts.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"), "buckets")
    rows = rows.join(blocks, bucket)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})

    def meet(group: pa.Table) -> pa.Table:
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        own, t = group["own"].to_numpy(), group["t"][0].as_py()
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        units, keys = _matrix(group["units"]), _matrix(group["keys"])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        linked = np.zeros((len(ids), len(ids)), bool)
        n = np.zeros(len(ids), np.int64)
        for i in range(0, len(left), 256):
            some = left[i : i + 256]
            near = units[some] @ units[right].T >= threshold
            near &= some[:, None] < right[None, :] if x == y else True
            a, b = np.nonzero(near)
            a, b = some[a], right[b]
            linked[a, b] = linked[b, a] = True
            fresh = ~(keys[a, :t] == keys[b, :t]).any(1)
            np.add.at(n, a[fresh], copies[b[fresh]])
            np.add.at(n, b[fresh], copies[a[fresh]])
        touched = np.flatnonzero(linked.any(1))
        root = ids[_labels(linked)[touched]]
        return pa.table({"id": ids[touched], "n": n[touched], "root": root})

    return rows.groupBy(*bucket, "x", "y").applyInArrow(meet, "id long, n long, root long")


def linked_vectors(
    vectors: DataFrame,
    threshold: float = SIMILARITY,
    key_bits: int = KEY_BITS,
    sample_rows: int = 20_000,
    block: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal labels link if they share a key of any table and their cosine is at least
    ``threshold``. n_links counts linked rows, equal vectors among them, the row itself not;
    component_id is the least vec_id that links reach; kept is vec_id = component_id. Null
    labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing, and neither do rows with a null id (null component, kept). Repeated rows are equal
    vectors. Vectors of different length do not link. The rotation is learned on at most
    ``sample_rows`` vectors, those of least hash; all vectors are indexed. Other columns are ignored.
    An empty table gives an empty table.
    """
    usable = vectors.filter(_usable()).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    folded = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    folded = staged(folded.withColumn("dims", F.size("embedding")), "vectors")
    # At most sample_rows vectors come to the driver.
    sample = folded.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("dims", "embedding").toArrow()
    dims = sample["dims"].to_numpy()
    models = {
        int(d): learn(unit(_matrix(sample.filter(pa.array(dims == d))["embedding"]))) for d in np.unique(dims)
    }
    found = staged(_compared(_keyed(folded, models, key_bits), threshold, block), "met")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    # An id may stand for several vectors; copies are folded by vector, so all of them are linked by id.
    tied = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = folded.select("label", "embedding", F.col("id").alias("first"), "copies")
    known = known.join(counts, F.col("first") == counts["id"], "left").drop("id")
    known = known.join(tied, F.col("first") == tied["id"], "left").drop("id")
    known = staged(
        known.select(
            "label", "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "first").alias("component_id"),
        ),
        "classes",
    )
    linked = usable.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~_usable()).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", kept)
