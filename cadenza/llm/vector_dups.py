"""Near-duplicate vectors by an exact range join in metric space.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2t). Vectors of one label are
a cell; a cell of more than LIMIT vectors is cut by pivots: a vector lives in the cell of its nearest pivot,
and is replicated to each other cell that one within r of it may live in. By the triangle inequality such a
one exists only if the cell's pivot is at most 2r farther than the nearest; and only if the vector is within r
of the plane between the two pivots, which is the sharper test. So a vector meets all its partners in its own
cell, and cells are joined independently. Cells are cut again while that pays.

Equal vectors of a label are one class before anything is compared. What pivots can't cut (vectors all within
r of each other, or that are equally far from everything) is joined in blocks of LIMIT by LIMIT vectors, dealt to
many tasks; so no task holds more than that, and no partner is left out. Two home vectors of a cell meet in one
block. Products in single precision tell what is surely linked or not; between, doubles decide. A block gives
counts of links for its vectors and a spanning forest of them, not the pairs.

Pivots are a bounded sample: at most FAN of a cell, in CELLS cells a turn, the largest. As many other vectors
tell whether they cut the cell well; if not, as in many dimensions without clusters, it is left to blocks, as
copies of its vectors in most of the smaller cells would cost more than they spare. Everything else covers
all vectors, and results don't depend on the pivots.

Defined results: a vector that is null, zero or has null or non-finite components, or whose label is null, links
with nothing, nor do vectors of different sizes; repeated rows are vectors of their own, linked to each other; the
least id of a component ignores null ids, and a component of null ids alone has a null component_id, of which each
row is kept; tables may be empty and have any further columns.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import remove, scratch, stage, with_unique
from cadenza.llm.simhash import components, star

#: Vectors that a cell may have before it is cut, and of either side of a block; of a side in very many dimensions fewer,
#: as it has SIDE numbers at most, or LEAST vectors.
LIMIT, SIDE, LEAST = 16384, 1 << 20, 64
#: Pivots of a cell at most, and cells that are cut in a turn at most; what they leave is joined in blocks.
FAN, CELLS, TURNS = 24, 1000, 6
#: Numbers of pivots and probes that the driver takes in a turn.
HELD = 1 << 22
#: A cell is cut if a vector of it has to be in this share of the smaller cells at most, on average; a smaller share if
#: it has few home vectors, as these are what a copy of a vector may be spared.
WORTH = 0.5
#: Vectors of a block that are multiplied at once, by so many others.
TILE, WIDE = 256, 2048
#: What rounding may take from a distance.
SLACK = 1e-9


def tables(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors of them as doubles) for each size that vectors have, without those that link with nothing."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        m = column.take(pa.array(at)).flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(-1, d)
        fine = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        yield at[fine], m[fine]


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their greatest components first, so that squares neither vanish nor overflow."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, cell, key, u): label and size, what equal vectors of it share, and the unit vector; null where nothing links."""
    names = ["vec_id", "cell", "key", "u"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.float64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, labels = np.ones(len(b), bool), b.column(2)
            labelled = labels.is_valid().to_numpy(zero_copy_only=False)
            for at, m in tables(b.column(1)):
                at, m = at[labelled[at]], m[labelled[at]]
                rest[at] = False
                if not len(at):
                    continue
                cells = [f"{m.shape[1]}:{label}" for label in labels.take(pa.array(at)).to_pylist()]
                keys = [hashlib.sha256(cell.encode() + b"/" + v.tobytes()).hexdigest() for cell, v in zip(cells, m + 0.0, strict=True)]
                units = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * m.shape[1], pa.int32()), pa.array(unit(m).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cells, pa.string()), pa.array(keys, pa.string()), units], names)
            ids = b.column(0).filter(pa.array(rest))
            yield pa.RecordBatch.from_arrays([ids, *(pa.nulls(len(ids), k) for k in kinds)], names)

    kind = vectors.schema[id_col].dataType.simpleString()
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    return own.mapInArrow(run, f"vec_id {kind}, cell string, key string, u array<double>")


def table_of(units: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def reached(u: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot of each vector, vectors by pivots: whether a vector within r may have that pivot as its nearest)."""
    square = np.maximum(2 - 2 * (u @ pivots.T), 0)
    far, rows = np.sqrt(square), np.arange(len(u))
    home = square.argmin(axis=1)
    near = far <= far[rows, home][:, None] + 2 * r + SLACK
    between = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2))
    for m in range(len(pivots)):  # the plane between any two pivots has to be within r
        near &= square - square[:, m : m + 1] <= 2 * r * between[m][None] + SLACK
    near[rows, home] = True
    return home, near


def pivots_of(rows: DataFrame, big: list, turn: int, r: float) -> dict[str, np.ndarray]:
    """At most FAN pivots for each of the cells (cell, homes) of big that they cut well: those of least hash in a sample."""
    cells = F.broadcast(rows.sparkSession.createDataFrame([(x["cell"], x["homes"]) for x in big], "cell string, homes long"))
    h = F.xxhash64("node", F.lit(turn))
    # four times as many as are needed, so that hardly a cell gets too few; these are ranked
    drawn = rows.where("home").join(cells, "cell").withColumn("h", h).where(F.pmod("h", F.lit(1 << 40)) < F.lit(float(1 << 40)) * 8 * FAN / F.col("homes"))
    ranked = drawn.withColumn("nth", F.row_number().over(W.partitionBy("cell").orderBy("h", "node"))).where(F.col("nth") <= 2 * FAN)
    t = ranked.select("cell", "u").toArrow()
    names, homes, found = t.column("cell").to_numpy(), {x["cell"]: x["homes"] for x in big}, {}
    for c in np.unique(names):
        u = table_of(t.column("u").take(pa.array(np.flatnonzero(names == c))))
        half = len(u) // 2  # the rest are probes
        if half > 1 and reached(u[half:], u[:half], r)[1].mean() <= WORTH * homes[c] / (homes[c] + 2 * LIMIT):
            found[c] = u[:half]
    return found


def cut(rows: DataFrame, pivots: dict[str, np.ndarray], r: float) -> DataFrame:
    """rows (cell, node, n, home, u), those of the pivots' cells dealt to smaller ones."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(0).to_numpy(zero_copy_only=False)
            at, names = [], []
            for c in np.unique(cells):
                own = np.flatnonzero(cells == c)
                if c not in shared.value:
                    at.append(np.stack([own, np.zeros(len(own), int)], axis=1))
                    names += [c] * len(own)
                    continue
                home, near = reached(table_of(b.column(4).take(pa.array(own))), shared.value[c], r)
                row, cell = np.nonzero(near)
                at.append(np.stack([own[row], (home[row] != cell)], axis=1))
                names += [f"{c}/{k}" for k in cell.tolist()]
            at = np.concatenate(at)
            for i in range(0, len(at), 4096):
                part = at[i : i + 4096]
                t = b.take(pa.array(part[:, 0]))
                stays = t.column(3).to_numpy(zero_copy_only=False).astype(bool) & (part[:, 1] == 0)
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 4096], pa.string()), t.column(1), t.column(2), pa.array(stays), t.column(4)], ["cell", "node", "n", "home", "u"])

    return rows.mapInArrow(run, rows.schema)


def in_cells(rows: DataFrame, path: str, r: float) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): rows cut until cells are small or pivots don't cut them well; cell, homes, rows and dimensions of each cell."""
    spark = rows.sparkSession
    size = lambda t: stage(t.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("dims")), f"{path}/sizes-{turn}")
    turn = 0
    rows = stage(rows, f"{path}/cells-0")
    sizes = size(rows)
    before: dict[str, int] = {}
    left: set[str] = set()
    while turn < TURNS:
        big = sizes.where((F.col("n") > LIMIT) & (F.col("homes") > 1)).orderBy(F.col("n").desc(), "cell").limit(CELLS).collect()
        # a cell that kept two thirds of its parent's vectors is too dense to be cut
        big = [x for x in big if x["cell"] not in left and 3 * x["n"] <= 2 * before.get(x["cell"].rpartition("/")[0], 2 * x["n"])]
        held = itertools.accumulate(2 * FAN * x["dims"] for x in big)
        big = [x for x, most in zip(big, held, strict=True) if most <= HELD]
        pivots = pivots_of(rows, big, turn, r) if big else {}
        left |= {x["cell"] for x in big} - set(pivots)
        if not pivots:
            break
        before |= {x["cell"]: x["n"] for x in big}
        turn += 1
        rows = stage(cut(rows, pivots, r), f"{path}/cells-{turn}")
        remove(spark, f"{path}/cells-{turn - 1}", f"{path}/sizes-{turn - 1}")
        sizes = size(rows)
    return rows, sizes


def blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows dealt to blocks (cell, a, b); role: 1 on the side of a, 2 on the side of b, 3 on both, and 4 more for home vectors.

    The home vectors of a cell are dealt to parts, and the others to parts that follow. A part of home vectors meets itself
    and each later part, so two home vectors meet in one block, and others don't meet. A small cell is one block.
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    side = F.least(F.lit(LIMIT), F.greatest(F.lit(LEAST), F.floor(F.lit(SIDE) / F.greatest("dims", F.lit(1)))))
    in_parts = lambda n: F.ceil(n / side).cast("int")
    sizes = sizes.where(F.col("n") > side).select("cell", "n", F.struct(in_parts(F.col("homes")).alias("homes"), in_parts(F.col("n") - F.col("homes")).alias("others")).alias("parts"))
    rows = with_unique(rows.withColumnRenamed("n", "copies"), sizes, "cell", "n", total, F.col("node").cast("string"))
    rows = rows.withColumn("parts", F.coalesce("parts", F.struct(F.lit(1).alias("homes"), F.lit(0).alias("others"))))
    part = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(F.lit(1), n)).cast("int")
    others = F.when(F.col("parts.others") > 0, F.col("parts.homes") + part(F.col("parts.others"), 2)).otherwise(0)
    rows = rows.withColumn("own", F.when(F.col("home"), part(F.col("parts.homes"), 1)).otherwise(others))
    last = F.col("parts.homes") - 1 + F.when(F.col("home"), F.col("parts.others")).otherwise(0)
    role = lambda x: F.when(~F.col("home"), 2).when(x == F.col("own"), 7).when(x > F.col("own"), 5).otherwise(6)
    place = lambda x: F.struct(F.least(x, "own").alias("a"), F.greatest(x, "own").alias("b"), role(x).alias("role"))
    return rows.select("cell", "node", "copies", "u", F.inline(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), place))))


def linked(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, other, n): how many vectors a node links with, besides its own copies; or an edge to other, where that is set."""

    def run(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        left = np.flatnonzero(role & 1)
        order = np.concatenate([left, np.flatnonzero(role & 3 == 2)])
        node, copies, home, u = t.column("node").to_numpy()[order], t.column("copies").to_numpy()[order], role[order] & 4 > 0, table_of(t.column("u"))[order]
        w, both = u.astype(np.float32), bool((role[left] & 2).any())
        # the rounding of a single-precision product of unit vectors, with room to spare
        off = (u.shape[1] + 8) * 2.0**-23
        some = max(1, SIDE // u.shape[1])
        n, low = np.zeros(len(order)), np.arange(len(order))
        for i in range(0, len(left), TILE):
            for j in range(i if both else len(left), len(order), WIDE):
                dots = w[i : min(i + TILE, len(left))] @ w[j : j + WIDE].T
                at = np.flatnonzero(dots >= np.float32(cosine - off))
                if not len(at):
                    continue
                x, y = np.divmod(at, dots.shape[1])
                x, y, hit = x + i, y + j, dots.ravel()[at] >= np.float32(cosine + off)
                hit &= x < y
                near = np.flatnonzero(~hit & (x < y))
                for k in range(0, len(near), some):
                    z = near[k : k + some]
                    hit[z] = (u[x[z]] * u[y[z]]).sum(axis=1) >= cosine
                x, y = x[hit], y[hit]
                n += np.bincount(x, copies[y], len(order)) + np.bincount(y, copies[x], len(order))
                # what is not connected yet goes to the first that it reaches
                a, b = low[x], low[y]
                if (apart := a != b).any():
                    a, b = star(a[apart], b[apart])
                    to = np.arange(len(order))
                    to[a] = b
                    low = to[low]
        found, moved = home & (n > 0), low != np.arange(len(order))
        edges = node[low[moved]].tolist()
        return pa.table({"node": np.concatenate([node[found], node[moved]]), "other": pa.array([None] * int(found.sum()) + edges, pa.int64()), "n": np.concatenate([n[found].astype(np.int64), np.zeros(len(edges), np.int64)])})

    return rows.groupBy("cell", "a", "b").applyInArrow(run, "node long, other long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of vectors.

    n_links: other vectors of the same label at that cosine or more; component_id: the smallest id
    reachable by links; kept: whether that is the row's own.
    """
    if not 0 < cosine <= 1:
        raise ValueError("a cosine above 0 and up to 1 is needed")
    spark = vectors.sparkSession
    path, r = scratch(spark, "vectors"), float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    own = stage(keyed(vectors, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()), f"{path}/own")
    classes = own.where("key is not null").groupBy("key").agg(F.first("cell").alias("cell"), F.first("u").alias("u"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), f"{path}/classes")
    rows, sizes = in_cells(classes.select("cell", "node", "n", F.lit(True).alias("home"), "u"), path, r)
    found = stage(linked(blocks(rows, sizes), cosine), f"{path}/linked")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("links"))
    roots = components(found.where("other is not null").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")), f"{path}/components")
    named = classes.select("node", "key", "n", "least").join(counts, "node", "left").join(roots, "node", "left")
    named = stage(named.select("node", "key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), f"{path}/named")
    total = named.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    first = named.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("size"))
    named = with_unique(named, stage(first, f"{path}/first"), "root", "size", total["classes"], F.col("node"))
    answer = named.select("key", "n", F.struct((F.col("links") + F.col("n") - 1).alias("links"), F.col("first")).alias("answer"))
    own = own.select("vec_id", "row", F.coalesce("key", F.col("row").cast("string")).alias("key"))
    out = with_unique(own, stage(answer, f"{path}/answer"), "key", "n", total["rows"], F.col("row").cast("string"))
    least = lambda c: F.when(F.col("answer").isNull(), F.col("vec_id")).otherwise(c)
    out = out.select("vec_id", F.coalesce("answer.links", F.lit(0)).alias("n_links"), least(F.col("answer.first")).alias("component_id"))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

