"""Embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, nodes, smallest_ids
from .shared import broadcast_if, stored

#: Vectors that the codebooks are fitted on (a hash sample); every vector is indexed.
SAMPLE = 20_000
LLOYD = 8
#: Share of neighbours at or above the threshold that the visited cells are to hold. The pair is met from its larger node's side.
RECALL = 0.995
#: Members and visitors of one cell that one task compares; larger cells are split.
MEMBERS, VISITORS = 2_000, 20_000
#: Sampled vectors that the number of visits is judged on.
JUDGED = 4_000


def unit_vectors(table: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, v, ok): v in double precision; ok if it has components, all finite, and is not zero."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine &= F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("ok"))


def normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codebook(x: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Lloyd's k-means on the bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(codes, len(x)), replace=False)]
    for _ in range(LLOYD):
        near = distances(x, c).argmin(1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]))


def fit(vectors: DataFrame, sample: int, codes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codebooks of the two halves of unit vectors, from about `sample` vectors of least hash, and these."""
    n = vectors.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(1, n)))
    some = vectors if n <= sample else vectors.where(share).limit(2 * sample)
    rows = some.select("v").toPandas()
    x = normed(np.array(rows["v"].tolist()))
    h = x.shape[1] // 2
    return codebook(x[:, :h], codes, seed), codebook(x[:, h:], codes, seed + 1), x


def _cells(shared):
    """(node, cell, x, copies): the unit vector's own cell, that of its nearest codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                x = normed(np.array(batch.column(1).to_pylist()))
                cell = multi_sequence(x, one, two, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], names=["node", "cell", "x", "copies"])

    return run


def multi_sequence(x: np.ndarray, one: np.ndarray, two: np.ndarray, visits: int) -> np.ndarray:
    """The first `visits` cells of each row's multi-sequence traversal: the product grid's cells in order of summed squared half distance.

    The traversal goes through both halves' codewords from near to far. It pops cell
    (i, j) of these orders only after all (i', j') of i' <= i and j' <= j, so the
    first `visits` pops are among the cells of (i + 1)(j + 1) <= visits: visits times
    its logarithm, whatever the grid. These are ranked for all rows at once.
    """
    h = one.shape[1]
    d1, d2 = distances(x[:, :h], one) ** 2, distances(x[:, h:], two) ** 2
    o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    near = np.minimum(len(two), visits // np.arange(1, min(len(one), visits) + 1))
    i = np.repeat(np.arange(len(near)), near)
    j = np.arange(near.sum()) - np.repeat(np.cumsum(near) - near, near)
    total = np.take_along_axis(d1, o1[:, : len(near)], 1)[:, i] + np.take_along_axis(d2, o2[:, : near[0]], 1)[:, j]
    best = np.argsort(total, 1, kind="stable")[:, :visits]
    return np.take_along_axis(o1, i[best], 1) * len(two) + np.take_along_axis(o2, j[best], 1)


def visits_needed(x: np.ndarray, one: np.ndarray, two: np.ndarray, least: float, recall: float, seed: int = 3) -> int:
    """Cells to visit for the target recall, judged on the sample in two ways, of which the worse counts: neighbours at a cosine of exactly `least` in random directions, and the sample's own pairs at or above it."""
    rng = np.random.default_rng(seed)
    x = x[:JUDGED]
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * y / np.maximum(1e-300, np.sqrt((y * y).sum(1, keepdims=True)))
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    home, mine = multi_sequence(y, one, two, 1), multi_sequence(x, one, two, 1)
    most = len(one) * len(two)
    t = min(8, most)
    while t < most:
        held = pairs = 0
        for at in range(0, len(x), 500):
            cells = multi_sequence(x[at : at + 500], one, two, t)
            held += int((cells == home[at : at + 500]).any(1).sum())
            on = (a >= at) & (a < at + 500)
            pairs += int((cells[a[on] - at] == mine[b[on]]).any(1).sum())
        if min(held / max(1, len(x)), pairs / len(a) if len(a) else 1.0) >= recall:
            break
        t = min(most, t * 2)
    return t


def _visits(shared):
    """(node, cell, x, copies): the cells that each vector visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, visits = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                b = batch.slice(at, 250)
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(b.num_rows, -1)
                cells = multi_sequence(x, one, two, visits)
                row = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(cells.ravel().astype(np.int32)), b.column(1).take(row), b.column(2).take(row)], names=["node", "cell", "x", "copies"])

    return run


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of links (i, j) between 0..n-1 the least place that each can reach, by hooking and halving."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(least: float):
    """Links of a block (node, x, copies) of visitors and members, met from the larger node: per node the copies that it is linked with (b null), and links (a, b) that span the block's classes. No more rows than the block has nodes, however many links."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "n": []}, dtype="Int64")]
        if len(left) and len(right):
            m = np.frombuffer(b"".join(right["x"]), np.float64).reshape(len(right), -1)
            node, weight = right["node"].to_numpy(), right["copies"].to_numpy()
            for at in range(0, len(left), 1_000):
                part = left.iloc[at : at + 1_000]
                q = np.frombuffer(b"".join(part["x"]), np.float64).reshape(len(part), -1)
                mine = part["node"].to_numpy()
                hit = (q @ m.T >= least) & (mine[:, None] > node[None, :])
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                ids, place = np.unique(np.r_[mine, node], return_inverse=True)
                u, v = place[i], place[len(mine) + j]
                links = np.bincount(u, weight[j], len(ids)) + np.bincount(v, part["copies"].to_numpy()[i], len(ids))
                root, on = spanning(u, v, len(ids)), np.flatnonzero(links)
                out.append(pd.DataFrame({"a": ids[on], "b": pd.array([None] * len(on), "Int64"), "n": links[on].astype(np.int64)}))
                far = np.flatnonzero(root != np.arange(len(ids)))
                out.append(pd.DataFrame({"a": ids[root[far]], "b": ids[far], "n": np.zeros(len(far), np.int64)}))
        return pd.concat([x.astype("Int64") for x in out])

    return run


def near_duplicates(table: DataFrame, least: float = 0.9, sample: int = SAMPLE, codes: int | None = None) -> DataFrame:
    """Per row of table: vec_id, n_links, component_id, kept.

    Equal vectors are one class; classes are compared. Each is indexed in the cell of
    its nearest codewords (one codebook a half) and visits the cells of its
    multi-sequence traversal, as many as the target recall takes; a pair is met from
    its larger node's side, once, and verified by cosine in double precision. Large
    cells and long visit lists are split into blocks, and each block pair is a task
    of its own, which sends on counts of links and a spanning set of them, so a group
    of near copies is not expanded into its pairs. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, and so do vectors of
    another length than most (lengths are compared apart) and rows with a null id,
    which are kept. A vec_id with several vectors has the links of each on its rows;
    repeated rows are separate vectors. An empty table gives no row; columns beside
    vec_id and embedding are ignored.
    """
    every = unit_vectors(table)
    key = F.concat_ws(":", F.size("v"), F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))))
    good = every.where("ok and id is not null").withColumn("key", key)
    named = stored(nodes(good.select("key", "id")))
    rep = good.withColumn("least", F.col("id").cast("long")).join(named, ["key", "least"]).dropDuplicates(["key"])
    rep = stored(rep.select("node", "v", "copies"))
    found = None
    for (size,) in sorted(tuple(r) for r in rep.select(F.size("v")).distinct().collect()):
        if size >= 2:
            one = linked(rep.where(F.size("v") == size), least, sample, codes)
        else:
            # One component: the sign decides, and all of one sign are linked with each other.
            signs = stored(rep.where(F.size("v") == 1).select("node", "copies", F.signum(F.col("v")[0]).alias("s")))
            firsts = signs.groupBy("s").agg(F.min("node").alias("a"), F.sum("copies").alias("all"))
            of = signs.join(F.broadcast(firsts), "s")
            counts = of.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("all") - F.col("copies")).alias("n"))
            one = counts.unionByName(of.where("a < node").select("a", F.col("node").alias("b"), F.lit(0).cast("long").alias("n")))
        found = one if found is None else found.unionByName(one)
    rest = every.where("not ok or id is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return rest
    found = stored(found)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    label = components(found.where("b is not null").select("a", "b"))
    info = named.join(links, "node", "left").select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n"))
    info = info.join(smallest_ids(named, label), "key")
    out = every.where("ok and id is not null").withColumn("key", key).select("id", "key").join(info, "key")
    out = out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    return out.unionByName(rest)


def linked(rep: DataFrame, least: float, sample: int, codes: int | None, recall: float = RECALL) -> DataFrame:
    """Of vectors (node, v, copies) of one length: (a, null, n), parts of the number of vectors linked with a at a cosine of at least `least`, and (a, b, 0), links enough to join each class."""
    spark = rep.sparkSession
    codes = codes or int(max(8, min(1024, (rep.count() / 200) ** 0.5)))
    one, two, x = fit(rep, sample, codes)
    visits = visits_needed(x, one, two, least, recall)
    books = spark.sparkContext.broadcast((one, two, visits))
    held = stored(rep.select("node", "v", "copies").mapInArrow(_cells(books), "node long, cell int, x binary, copies long"))
    asked = held.select("node", "x", "copies").mapInArrow(_visits(books), "node long, cell int, x binary, copies long")
    # Blocks of each cell: members by MEMBERS, visitors by VISITORS. One row a cell of the grid.
    of = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"), F.min("node").alias("least"))
    by = asked.select("cell").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("slices"))
    blocks = stored(of.join(by, "cell"))
    blocks = broadcast_if(blocks, blocks.count(), 1 << 16)
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A visitor below all members of a cell has nothing to meet there.
    q = asked.join(blocks, "cell").where("node > least").withColumn("slice", deal("slices", 1)).withColumn("part", each("parts"))
    m = held.join(blocks, "cell").withColumn("part", deal("parts", 2)).withColumn("slice", each("slices"))
    keys = ["cell", "part", "slice"]
    cols = ["node", "x", "copies", *keys]
    met = q.select(*cols).groupBy(*keys).cogroup(m.select(*cols).groupBy(*keys))
    return met.applyInPandas(_compare(least), "a long, b long, n long")
