"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one. Each half of the components has its own codebook (k-means on a bounded sample); the
pair of nearest codewords is the vector's cell in the product grid. Two vectors can only be as similar as wanted if the cell of one
is near enough to the other: the squared distances of a vector from the boundaries of a cell in both halves add up to a lower bound of its squared
distance to anything there. A multi-sequence traversal visits cells by rising bound. Beyond the squared distance that the similarity allows nothing
can be lost; it stops before that, at the bound that keeps the wanted recall on a sample (links of sampled vectors, and vectors turned away from them by
just the angle that is allowed). Pairs that meet in a cell are verified by their cosine in double precision.

Of two cells the one of the lower number visits the other, so that each pair meets once. Equal vectors are one class before that, and the class counts as many
vectors as it has. Rows of a cell are dealt to blocks of BLOCK_ROWS; those that visit it stream past each block, also in parts if there are many. No
pairs leave a task: only counts, and edges of a spanning forest of what is linked there. So a group of near copies costs comparisons by its square (counting links
needs them) in matrix products of bounded size, but rows only in proportion.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors are compared
with those of their own dimension; one row is returned for each id, and rows that repeat an id count once (the smallest vector); a null id
links with nothing and has no component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencia.llm import common
from cadencia.llm.components import connected_components

#: Vectors that codebooks and the stopping bound are fitted on, and the most codewords of a half.
SAMPLE, MOST_WORDS = 16_384, 1_024
#: Share of the links that the traversal must reach on the sample.
RECALL = 0.9995
BLOCK_ROWS, VISITOR_ROWS = 2_048, 65_536
#: Vectors that a cell should hold about, and cells that a vector may visit on average: beyond that, cells are made coarser, so that rows sent grow with the vectors only.
CELL_ROWS, MOST_VISITS = 48, 32
_EDGE = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision."""
    vectors = common.power_scaled(np.asarray(vectors, float))
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (words * words).sum(1)[None, :] - 2 * (x @ words.T), 0)


def codebook(x: np.ndarray, words: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means: at most `words` codewords."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    own = x[np.sort(rng.choice(len(x), min(words, len(x)), replace=False))]
    for _ in range(rounds):
        near = np.concatenate([_distances(x[a : a + 4_096], own).argmin(1) for a in range(0, len(x), 4_096)])
        sums = np.zeros_like(own)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=len(own))[:, None]
        own = np.where(size > 0, sums / np.maximum(size, 1), own)
    return own


class Grid:
    """Two codebooks, and the bound at which a traversal stops."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.books, self.stop = (left, right), 0.0
        self.apart = [np.sqrt(_distances(b, b)) for b in self.books]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return x[:, :cut], x[:, cut:]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(cell of each vector; for each half, its squared distances from the boundaries of all codewords' regions: 0 for its own)."""
        cell, out = np.zeros(len(x), np.int64), []
        for part, book, apart in zip(self.halves(x), self.books, self.apart, strict=True):
            d = _distances(part, book)
            own = d.argmin(1)
            # distance from the plane halfway between the own codeword and another
            gap = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart[own], 1e-12)
            out.append(np.where(np.arange(len(book)) == own[:, None], 0, np.maximum(gap, 0) ** 2))
            cell = cell * len(book) + own
        return cell, out

    def reach(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bound at which the traversal from each x meets the cell of its y."""
        cell, (first, second) = self.bounds(y)[0], self.bounds(x)[1]
        rows, words = np.arange(len(x)), len(self.books[1])
        return first[rows, cell // words] + second[rows, cell % words]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """(cell of each vector, cells of a higher number that its traversal visits)."""
        cell, (first, second) = self.bounds(x)
        words = len(self.books[1])
        return cell, [[c for c in (i * words + j for i, j in multi_sequence(a, b, self.stop)) if c > own] for a, b, own in zip(first, second, cell.tolist(), strict=True)]


def multi_sequence(first: np.ndarray, second: np.ndarray, stop: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by rising first[i] + second[j], as far as `stop`."""
    near = [sorted((v, i) for i, v in enumerate(x.tolist()) if v <= stop) for x in (first, second)]
    a, b = near
    if not a or not b:
        return
    heap, pushed = [(a[0][0] + b[0][0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > stop:
            return
        yield a[i][1], b[j][1]
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in pushed:
                pushed.add((i2, j2))
                heapq.heappush(heap, (a[i2][0] + b[j2][0], i2, j2))


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float = RECALL) -> Grid:
    """The grid for `rows` vectors of the sample's dimension."""
    x = unit(sample)
    words = int(np.clip(2 ** round(np.log2(max(1.0, rows / CELL_ROWS)) / 2), 1, min(MOST_WORDS, max(1, len(x) // 16))))
    while True:
        grid = _fitted(x, words, threshold, recall)
        if words == 1 or np.mean([len(v) for v in grid.visits(x[:1_024])[1]]) <= MOST_VISITS:
            return grid
        words //= 2


def _fitted(x: np.ndarray, words: int, threshold: float, recall: float) -> Grid:
    cut = x.shape[1] // 2
    grid = Grid(codebook(x[:, :cut], words), codebook(x[:, cut:], words))
    allowed = 2 - 2 * threshold
    rng = np.random.default_rng(7)
    some = x[rng.permutation(len(x))[:2_048]]
    reached = [np.zeros(1)]
    if x.shape[1] > 1:  # turned by just the angle that is allowed, in a random direction
        for _ in range(8):
            aside = rng.standard_normal(some.shape)
            aside -= (aside * some).sum(1, keepdims=True) * some
            reached.append(grid.reach(some, threshold * some + np.sqrt(1 - threshold**2) * unit(aside)))
    drawn, real = np.concatenate(reached), [np.zeros(1)]
    for a in range(0, len(some), 256):
        i, j = np.nonzero(some[a : a + 256] @ x.T >= threshold)
        real.append(grid.reach(some[a + i], x[j]))
    grid.stop = float(min(allowed + 1e-9, max(np.quantile(drawn, recall), np.quantile(np.concatenate(real), recall)) + 1e-12))
    return grid


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one usable vector of each id, with components as doubles or, where they are that already, floats."""
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def _place(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """(id, copies, v, dim, cell, visits) of each class."""
    element = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1_024):
                b = whole.slice(a, 1_024)
                dim = b.column("v").value_lengths().to_numpy()
                cell, visits = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
                for d in np.unique(dim).tolist():
                    rows = np.flatnonzero(dim == d)
                    if d in grids:
                        x = unit(b.column("v").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d))
                        cell[rows], found = grids[d].visits(x)
                        for r, f in zip(rows.tolist(), found, strict=True):
                            visits[r] = f
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copies"), b.column("v"), pa.array(dim, pa.int32()), pa.array(cell), pa.array(visits, pa.list_(pa.int64()))], names=["id", "copies", "v", "dim", "cell", "visits"])

    return classes.mapInArrow(run, f"id {classes.schema['id'].dataType.simpleString()}, copies long, v {element}, dim int, cell long, visits array<long>")


def _dealt(placed: DataFrame) -> DataFrame:
    """Rows (dim, cell, block, part, role, id, copies, v): role 0 is held by its block, role 1 streams past it."""
    base = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"))
    guests = placed.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("guests"))
    size = base.join(guests, ["dim", "cell"], "left").select(
        "dim", "cell", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil((F.col("rows") + F.coalesce("guests", F.lit(0))) / VISITOR_ROWS).cast("int").alias("parts"))
    mark = F.xxhash64("id")
    home = placed.drop("visits").join(size, ["dim", "cell"]).withColumn("own", F.pmod(mark, F.col("blocks")).cast("int"))
    part = F.pmod(F.shiftrightunsigned(mark, 20), F.col("parts")).cast("int").alias("part")
    out = ["dim", "cell", "block", "part", "role", "id", "copies", "v"]
    held = home.withColumn("block", F.col("own")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(0))
    mates = home.filter("own > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).withColumn("part", part).withColumn("role", F.lit(1))
    came = placed.drop("cell").withColumn("cell", F.explode("visits")).drop("visits").join(size, ["dim", "cell"])
    came = came.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", part).withColumn("role", F.lit(1))
    return held.select(out).unionByName(mates.select(out)).unionByName(came.select(out)).repartition("dim", "cell", "block", "part").sortWithinPartitions("dim", "cell", "block", "part", "role", "id")


class _Block:
    """One block's vectors; everything that streams past is compared with them."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, threshold: float) -> None:
        self.ids, self.copies, self.x, self.threshold = ids, copies, unit(vectors), threshold
        self.links = np.zeros(len(ids), np.int64)
        self.group = np.arange(len(ids))  # what is linked through this block already

    def _linked(self, x: np.ndarray) -> np.ndarray:
        product = x @ self.x.T
        linked = product >= self.threshold
        for i, j in zip(*np.nonzero(np.abs(product - self.threshold) <= _EDGE), strict=True):
            linked[i, j] = float((x[i] * self.x[j]).sum()) >= self.threshold
        return linked

    def _join(self, members: np.ndarray) -> list[tuple]:
        """Edges that make one group of the groups of these members."""
        groups, first = np.unique(self.group[members], return_index=True)
        if len(groups) < 2:
            return []
        self.group[np.isin(self.group, groups[1:])] = groups[0]
        return [(self.ids[members[first[0]]], self.ids[members[f]]) for f in first[1:]]

    def meet(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """(links of each that streams past, edges)."""
        linked = self._linked(unit(vectors))
        self.links += copies @ linked
        edges = []
        for i in np.flatnonzero(linked.any(1)):
            members = np.flatnonzero(linked[i])
            edges += [(ids[i], self.ids[members[0]]), *self._join(members)]
        return linked @ self.copies, edges

    def inside(self) -> list[tuple]:
        """Edges among the block's own vectors, whose links are counted."""
        edges = []
        for a in range(0, len(self.ids), 512):
            linked = self._linked(self.x[a : a + 512])
            linked[np.arange(len(linked)), np.arange(a, a + len(linked))] = False
            self.links[a : a + 512] += linked @ self.copies
            for i in np.flatnonzero(linked.any(1)):
                edges += self._join(np.r_[a + i, np.flatnonzero(linked[i])])
        return edges


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): edges a-b (n null), and counts n of links of a (b null)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        schema = None

        def table(a: list, b: list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, schema), pa.array(b, schema), pa.array(n, pa.int64())], names=["a", "b", "n"])

        def told(ids: np.ndarray, links: np.ndarray, edges: list[tuple]) -> pa.RecordBatch:
            some = np.flatnonzero(links)
            a, b = list(ids[some]) + [e[0] for e in edges], [None] * len(some) + [e[1] for e in edges]
            return table(a, b, list(links[some]) + [None] * len(edges))

        def built() -> _Block:
            return _Block(*(np.concatenate([h[i] for h in held]) for i in range(3)), threshold)

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                own = block or built()
                edges = own.inside() if now[3] == 0 else []
                yield told(own.ids, own.links, edges)

        for b in batches:
            schema = b.column("id").type
            place = np.column_stack([b.column(c).to_numpy() for c in ("dim", "cell", "block", "part", "role")])
            ids, copies, flat = b.column("id").to_numpy(zero_copy_only=False), b.column("copies").to_numpy(), b.column("v").flatten().to_numpy()
            at = np.r_[0, np.cumsum(place[:, 0])]
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if (key := tuple(place[lo, :4])) != now:
                    yield from finish()
                    now, held, block = key, [], None
                vectors = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
                if place[lo, 4] == 0:
                    held.append((ids[lo:hi], copies[lo:hi], vectors))
                    continue
                block = block or built()
                for a in range(lo, hi, 512):
                    z = min(a + 512, hi)
                    yield told(ids[a:z], *block.meet(ids[a:z], copies[a:z], vectors[a - lo : z - lo]))
        yield from finish()

    return rows.mapInArrow(run, f"a {id_type}, b {id_type}, n long")


def embedding_duplicates(df: DataFrame, threshold: float = 0.95, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of each id: vectors linked directly, and the smallest id that links reach."""
    with common.scratch() as keep:
        one = keep(_usable(df, id_col, vector_col), "vectors")
        classes = keep(one.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies", "v"), "classes")
        rows = classes.count()
        drawn = classes.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("v").combine_chunks()
        size, grids = drawn.value_lengths().to_numpy(zero_copy_only=False), {}
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            vectors = drawn.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)
            grids[d] = fit(vectors, rows * len(own) // len(drawn), threshold, recall)
        placed = keep(_place(classes, grids), "cells")
        found = keep(_verify(_dealt(placed), threshold), "links")
        links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        groups = connected_components(found.filter("b is not null").select("a", "b")).withColumnsRenamed({"id": "rep", "component": "c"})
        told = classes.select(F.col("id").alias("rep"), "copies", F.col("v").alias("rv")).join(links, "rep", "left").join(groups, "rep", "left")
        told = told.select("rv", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "rep").alias("component_id"))
        member = one.join(told, one["v"] == told["rv"]).select("id", "n_links", "component_id")
        every = df.select(F.col(id_col).alias("id")).distinct().join(member, "id", "left")
        component = F.coalesce("component_id", "id")
        out = every.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
        return common.materialize(out, "embedding-classes")


def op12_embeddings(spark, sf_dir: str) -> DataFrame:
    return embedding_duplicates(common.read_table(spark, sf_dir, "embeddings"))
