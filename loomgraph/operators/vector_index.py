"""A vector index of cells: coarse centres, vectors stored by their nearest centre, probes, exact scores.

Centres are fitted on a bounded sample (SAMPLE_ROWS rows by the hash of their ids); every row is indexed. A search asks
only the cells of a query's nearest centres, which are partitions of the stored table, and scores their vectors exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .retrieval import QUERY_BLOCK, _scan, _unit

#: Rows that centres are fitted on, at most, whatever the size of the table.
SAMPLE_ROWS = 20_000


@dataclass
class Index:
    """centres: unit vectors; path: the table of id, v, cell and other columns, partitioned by cell; items: that table."""

    centres: np.ndarray
    path: str
    items: DataFrame


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: the mean directions of the sample's cells; an empty cell keeps its centre."""
    x = _unit(sample)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def build(items: DataFrame, path: str, *, cells: int = 64, id_col: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), seed: int = 0) -> Index:
    """Writes the index of all rows with an id and a vector; `keep` are columns that searches may filter by."""
    rows = items.dropna(subset=[id_col, vector]).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *keep)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).toArrow()
    centres = fit_centres(np.array(sample.column("v").to_pylist(), float), cells, seed=seed) if sample.num_rows else np.zeros((0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _unit(b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, centres.shape[1]))
            yield b.append_column("cell", pa.array(np.argmax(v @ centres.T, axis=1).astype(np.int32)) if b.num_rows else pa.array([], pa.int32()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(place, f"{kinds}, cell int")
    placed.write.partitionBy("cell").parquet(path)
    return Index(centres, path, items.sparkSession.read.schema(placed.schema).parquet(path))


def search(queries: DataFrame, index: Index, k: int, *, probes: int = 8, least: float | None = None, where: Column | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine among the rows of each query's `probes` nearest cells, but for its own id.

    least: only scores from it on; where: a filter over the index's columns. Queries go out in blocks of QUERY_BLOCK; a
    task reads its share of the block's cells and keeps k rows for each query, so a cell with most of the rows is split.
    """
    asked = queries.dropna(subset=[id_col, vector]).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    held = stored(asked.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    found = []
    for part in range(blocks):
        block = held.filter(F.col("_part") == part).toArrow()
        if not block.num_rows or not len(index.centres):
            continue
        names, q = block.column("id").to_numpy(), np.array(block.column("v").to_pylist(), float)
        near = np.argsort(-(_unit(q) @ index.centres.T), axis=1, kind="stable")[:, :probes]
        by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        found.append(_probe(index, names, q, by_cell, k, least, where))
    if not found:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    met = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, [stored(x) for x in found])
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("near")


def _probe(index: Index, names: np.ndarray, q: np.ndarray, by_cell: dict[int, np.ndarray], k: int, least: float | None, where: Column | None) -> DataFrame:
    items = index.items.filter(F.col("cell").isin(list(by_cell)))
    items = items if where is None else items.filter(where)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("cell").to_numpy()
            for c in np.unique(cells).tolist():
                mine = by_cell[c]
                yield _scan(q[mine], names[mine], k, iter([b.select(["id", "v"]).take(pa.array(np.flatnonzero(cells == c)))]), least)

    return items.select("id", "v", "cell").mapInArrow(task, "query_id long, id long, score double, near double")
