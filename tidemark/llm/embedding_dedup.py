"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors that are equal and of one label are one class. In every tree a class goes down from the
root: at each level one random direction of that tree and level decides, by a median per node, on
which side it falls, and within a margin of the median it goes to both sides (spill). The medians
are fitted on at most max_sample classes, those with the smallest hashes of their ids; deeper nodes
take the level's median. All classes are indexed, and those of one label that share a leaf of any
tree are compared by cosine in double precision. A pair that shares several leaves counts in the
first of them, so links are counted without listing pairs; for components each leaf gives the links
of a spanning forest. A leaf with more than max_leaf classes of a label is compared in pairs of
blocks, a task for each pair of blocks.

Defined cases: null label, null vector, zero vector, null or non-finite components: linked with
nothing; vectors of unequal length never link; a null id takes part in counts but gets a null
component and isn't kept; rows that repeat an id count as further vectors; an empty table gives no
rows. Other columns aren't returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of lists of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Forest:
    """Directions and medians of all trees; of a size that depth and max_sample bound."""

    def __init__(self, sample: np.ndarray, n_trees: int, depth: int, margin: float, seed: int, least: int = 16):
        self.n_trees, self.depth, self.margin = n_trees, depth, margin
        rng = np.random.default_rng(seed)
        ways = rng.standard_normal((n_trees, depth, sample.shape[1]))
        self.ways = ways / np.sqrt((ways * ways).sum(2, keepdims=True))
        self.medians: list[list[tuple[float, np.ndarray, np.ndarray]]] = []
        for tree in range(n_trees):
            node, levels = np.ones(len(sample), np.int64), []
            for level in range(depth):
                p = sample @ self.ways[tree, level]
                order = np.lexsort((p, node))
                names, first, count = np.unique(node[order], return_index=True, return_counts=True)
                mid = p[order][first + count // 2]
                fit = count >= least
                levels.append((float(np.median(p)) if len(p) else 0.0, names[fit], mid[fit]))
                node = node * 2 + (p >= self.at(levels[-1], node))
            self.medians.append(levels)

    @staticmethod
    def at(level: tuple[float, np.ndarray, np.ndarray], node: np.ndarray) -> np.ndarray:
        rest, names, mid = level
        if not len(names):
            return np.full(len(node), rest)
        k = np.minimum(np.searchsorted(names, node), len(names) - 1)
        return np.where(names[k] == node, mid[k], rest)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and code (tree and leaf) of every leaf that a vector falls into."""
        rows, codes = [], []
        for tree in range(self.n_trees):
            row, node = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
            for level in range(self.depth):
                d = (vectors @ self.ways[tree, level])[row] - self.at(self.medians[tree][level], node)
                left, right = d < self.margin, d >= -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
            rows.append(row)
            codes.append(node * self.n_trees + tree)
        return np.concatenate(rows), np.concatenate(codes)


def with_leaves(classes: DataFrame, forest: Forest) -> DataFrame:
    """classes with codes, the sorted codes of their leaves."""
    sent = classes.sparkSession.sparkContext.broadcast(forest)
    names = classes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code = sent.value.leaves(unit(matrix(batch.column("v"))))
            order = np.lexsort((code, row))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(batch)))), pa.int32()), pa.array(code[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "codes"])

    return classes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in classes.dtypes) + ", codes array<long>")


def _compared(table: pa.Table, least: float) -> pa.Table:
    """cls, n (weight of links first seen here), other (a link of the forest of this group, or null)."""
    code, first, second = (table.column(c)[0].as_py() for c in ("code", "i", "j"))
    part, cls, weight = (table.column(c).to_numpy() for c in ("part", "cls", "w"))
    order = np.lexsort((cls, part))
    part, cls, weight = part[order], cls[order], weight[order]
    x = unit(matrix(pa.concat_arrays(table.column("v").chunks).take(pa.array(order))))
    codes = pa.concat_arrays(table.column("codes").chunks).take(pa.array(order))
    rows = np.repeat(np.arange(len(cls)), np.diff(codes.offsets.to_numpy()))
    values = codes.flatten().to_numpy()
    rows, values = rows[values < code], values[values < code]
    names, column = np.unique(values, return_inverse=True)
    before = np.zeros((len(cls), len(names)), np.float32)
    before[rows, column] = 1
    a, b = (np.flatnonzero(part == k) for k in (first, second))
    n, label, edges = np.zeros(len(cls), np.int64), np.arange(len(cls)), []
    for k in range(0, len(a), 256):
        mine = a[k : k + 256]
        hit = x[mine] @ x[b].T >= least
        hit &= before[mine] @ before[b].T == 0
        if first == second:
            hit &= mine[:, None] != b[None, :]
        n[mine] += hit @ weight[b]
        if first != second:
            n[b] += weight[mine] @ hit
        for r, m in enumerate(mine.tolist()):
            to = b[hit[r]]
            for t in to[label[to] != label[m]].tolist():
                if label[t] != label[m]:
                    edges.append((m, t))
                    label[label == label[t]] = label[m]
    some = np.flatnonzero(n)
    ends = np.array(edges, np.int64).reshape(-1, 2)
    other = pa.array(np.concatenate([np.zeros(len(some), np.int64), cls[ends[:, 1]]]), mask=np.arange(len(some) + len(ends)) < len(some))
    return pa.table({"cls": np.concatenate([cls[some], cls[ends[:, 0]]]), "n": np.concatenate([n[some], np.zeros(len(ends), np.int64)]), "other": other})


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, n_trees: int = 8, leaf: int = 400, spill: float = 0.6, max_leaf: int = 4000, max_sample: int = 20_000, seed: int = 7
) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    # floats travel as floats, which double precision holds exactly
    v = F.col(vector_col) if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    length2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    good = F.coalesce(F.col("label").isNotNull() & finite & (length2 > 0) & (length2 < F.lit(math.inf)), F.lit(False))
    key = ["label", "mark", "v"]
    rows = rows.withColumn("_good", good).withColumn("mark", F.xxhash64("label", "v"))
    # a class's number: its smallest id, or a hash where all ids are null
    classes = rows.filter("_good").groupBy(*key).agg(F.coalesce(F.min("_id"), -F.abs(F.first("mark")) - 1).alias("cls"), F.count("*").alias("w"))
    classes = written(classes.withColumn("size", F.size("v")), "vectors")
    found = None
    for size in sorted(r[0] for r in classes.select("size").distinct().collect()):  # lengths of vectors, one in any sound table
        same = classes.filter(F.col("size") == size)
        depth = max(0, math.ceil(math.log2(max(1, same.count() / leaf))))
        sample = same.orderBy(F.xxhash64("cls"), "cls").limit(max_sample).select("v").toArrow()
        margin = spill * math.sqrt((2 - 2 * least) / size)
        forest = Forest(unit(matrix(pa.concat_arrays(sample.column("v").chunks))), n_trees, depth, margin, seed)
        placed = written(with_leaves(same.select("cls", "w", "label", "v"), forest), "leaves")
        sizes = placed.select("label", F.explode("codes").alias("code")).groupBy("label", "code").agg(F.count("*").alias("n"))
        sizes = sizes.filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / max_leaf).cast("long"))
        each = placed.withColumn("code", F.explode("codes")).join(sizes, ["label", "code"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        each = each.withColumn("_o", F.explode(other)).withColumns({"i": F.least("part", "_o"), "j": F.greatest("part", "_o")})
        groups = each.select("label", "code", "i", "j", "part", "cls", "w", "v", "codes").groupBy("label", "code", "i", "j")
        part = groups.applyInArrow(lambda table: _compared(table, least), "cls long, n long, other long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        out = rows.select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    else:
        found = written(found, "links")
        comps = components(found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")), "linked")
        counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
        facts = classes.select(*key, "cls", "w").join(counts, "cls", "left").join(comps.withColumnRenamed("id", "cls"), "cls", "left")
        out = rows.join(facts, key, "left").select(
            "_id", F.coalesce(F.col("n") + F.col("w") - 1, F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("_id").isNotNull(), F.coalesce("component", "cls", "_id")).alias("component_id"),
        )
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
