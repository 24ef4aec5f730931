"""Near-duplicates among embeddings: an exact range join in metric space, within equal labels.

Vectors of length one with a cosine of ``c`` lie ``sqrt(2 - 2c)`` apart, so the join asks
for all pairs within a radius. Pivots split the vectors of a large label into cells, each
vector at home with its nearest pivot. By the triangle inequality a vector can have a
partner at home in another cell only if it lies within the radius of the plane between the
two pivots; it is copied to those cells and no others. A cell then finds, for every vector
in it, the partners that are at home there, so each link is found once from either end.

Vectors within half the radius of their pivot, the core of a cell, are all linked with one
another: they are counted, not compared, which keeps a cell cheap that holds a large group
of near copies. What remains of a large cell is dealt out in blocks of targets and queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch
from .graph import connected_components

THRESHOLD = 0.93
# Vectors that a cell should hold at home, pivots of a label, and pivots of all labels (the bound of the broadcast).
CELL, LABEL_PIVOTS, ALL_PIVOTS = 4096, 256, 1 << 14
# Vectors per pivot sought that the pivots of a label are chosen from, and rows in a block.
SAMPLE, BLOCK = 4, 2048
# Distances from products of doubles are good to about 1e-8.
SLACK = 1e-6


def _unit(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def normalised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, group, vector)``: vectors of length one in doubles, as bytes, with label and dimension as their group.

    Left out are vectors that link with nothing: without id or label, null, empty, zero,
    or with components that are null or not finite.
    """
    plain = rows.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.to_json(F.struct(F.col(f"`{label_col}`").alias("l"), F.size(f"`{vector_col}`").alias("n"))).alias("group"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
        F.col(f"`{label_col}`").isNotNull().alias("_labelled"),
    ).where("_labelled AND vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            out, keep = [], []
            for i, v in enumerate(np.split(flat, np.cumsum(at)[:-1]) if len(at) else []):
                # Scaled first, so that squares neither overflow nor vanish.
                top = np.abs(v).max()
                if top > 0:
                    v = v / top
                    out.append((v / np.sqrt(v @ v)).tobytes())
                    keep.append(i)
            kept = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(out, pa.binary())], ["vec_id", "group", "vector"])

    return plain.select("vec_id", "group", "v").mapInArrow(run, "vec_id bigint, group string, vector binary")


def choose_pivots(vectors: np.ndarray, wanted: int, radius: float) -> np.ndarray:
    """At most ``wanted`` of the vectors, in their order, none within the radius of another."""
    chosen: list[int] = []
    near = np.full(len(vectors), -1.0)
    for i in range(len(vectors)):
        if len(chosen) == wanted:
            break
        if not chosen or 2 - 2 * near[i] > radius * radius:
            chosen.append(i)
            near = np.maximum(near, vectors @ vectors[i])
    return vectors[chosen]


def pivots(classes: DataFrame, radius: float) -> dict[str, np.ndarray]:
    """Pivots of the groups with more than ``CELL`` vectors; smaller groups are one cell.

    Their number follows the size of the group, up to ``LABEL_PIVOTS`` each and
    ``ALL_PIVOTS`` in all: where that binds, cells grow and are dealt out in more blocks.
    """
    sizes = classes.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    total = sizes.agg(F.sum(F.least(F.ceil(F.col("n") / CELL), F.lit(LABEL_PIVOTS))).alias("p")).first()["p"]
    if not total:
        return {}
    share = min(1.0, ALL_PIVOTS / total)
    wanted = F.greatest(F.floor(F.least(F.ceil(F.col("n") / CELL), F.lit(LABEL_PIVOTS)) * share), F.lit(1)).cast("int")
    some = sizes.orderBy(F.desc("n"), "group").limit(ALL_PIVOTS).withColumn("wanted", wanted)
    # A vector is sampled by its hash, at a rate that gives its group about SAMPLE for each pivot.
    draw = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
    drawn = classes.join(F.broadcast(some), "group").where(draw < SAMPLE * F.col("wanted") / F.col("n"))
    first = Window.partitionBy("group").orderBy(F.xxhash64("vector"), "vec_id")
    drawn = drawn.withColumn("at", F.row_number().over(first)).where(F.col("at") <= 2 * SAMPLE * F.col("wanted"))
    by: dict[str, list] = {}
    for r in drawn.select("group", "at", "wanted", "vector").collect():
        by.setdefault(r["group"], []).append((r["at"], r["wanted"], bytes(r["vector"])))
    out = {}
    for group, rows in by.items():
        rows.sort()
        out[group] = choose_pivots(_unit([v for _, _, v in rows]), rows[0][1], radius)
    return out


def assigned(classes: DataFrame, of: dict[str, np.ndarray], radius: float) -> DataFrame:
    """``(vec_id, group, vector, copies, cell, home, away, core)``: a row for each cell that a vector stands in."""
    shared = classes.sparkSession.sparkContext.broadcast(of)
    names = ["vec_id", "group", "vector", "copies", "cell", "home", "away", "core"]

    def cells(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        square = np.maximum(2 - 2 * (x @ p.T), 0)
        home = square.argmin(axis=1)
        nearest = square[np.arange(len(x)), home]
        between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
        # Distance to the plane between the home pivot and another one.
        plane = (square - nearest[:, None]) / np.maximum(2 * between, 1e-12)
        row, cell = np.nonzero((plane <= radius + SLACK) | (np.arange(len(p)) == home[:, None]))
        own = cell == home[row]
        return row, cell, own, np.sqrt(square[row, cell])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            groups = batch.column(1).to_pylist()
            by: dict[str, list[int]] = {}
            for i, g in enumerate(groups):
                by.setdefault(g, []).append(i)
            rows, cell, home, away = [], [], [], []
            for g, at in by.items():
                if g not in known:
                    rows += at
                    cell.append(np.zeros(len(at), np.int64))
                    home.append(np.ones(len(at), bool))
                    away.append(np.full(len(at), 2.0))  # one cell without a pivot has no core
                    continue
                x = _unit(batch.column(2).take(pa.array(at, pa.int32())).to_pylist())
                row, c, own, far = cells(x, known[g])
                rows += np.array(at)[row].tolist()
                cell.append(c)
                home.append(own)
                away.append(far)
            if rows:
                part = batch.take(pa.array(rows, pa.int32()))
                home, away = np.concatenate(home), np.concatenate(away)
                more = [pa.array(np.concatenate(cell).astype(np.int32)), pa.array(home), pa.array(away), pa.array(home & (away <= radius / 2 - SLACK))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names)

    ddl = "vec_id bigint, group string, vector binary, copies bigint, cell int, home boolean, away double, core boolean"
    return classes.select(*names[:4]).mapInArrow(run, ddl)


def dealt(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of ``cells`` as targets and queries of blocks: ``part`` tells core and other targets apart.

    A block holds about ``BLOCK`` targets and as many queries, however large the cell.
    """
    rows = cells.join(sizes, ["group", "cell"])
    spread = F.xxhash64("vec_id", F.lit(7))

    def blocks(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("int")

    def key(part: int, target: Column, query: Column, is_query: bool) -> Column:
        return F.struct(F.lit(part).alias("part"), target.alias("target"), query.alias("query"), F.lit(is_query).alias("asks"))

    def all_of(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def as_target(part: int, mine: Column):
        return lambda i: key(part, mine, i, False)

    def as_query(part: int, mine: Column):
        return lambda i: key(part, i, mine, True)

    places = []
    for part, n_targets, n_queries, is_target, asks in (
        (0, F.col("n_core"), F.col("n_all") - F.col("n_core"), F.col("core"), ~F.col("core")),
        (1, F.col("n_home") - F.col("n_core"), F.col("n_all"), F.col("home") & ~F.col("core"), F.lit(True)),
    ):
        t, q = blocks(n_targets), blocks(n_queries)
        mine_t, mine_q = (F.pmod(spread, F.greatest(n, F.lit(1))).cast("int") for n in (t, q))
        none = F.array().cast("array<struct<part:int,target:int,query:int,asks:boolean>>")
        places.append(F.when(is_target, F.transform(all_of(q), as_target(part, mine_t))).otherwise(none))
        places.append(F.when(asks, F.transform(all_of(t), as_query(part, mine_q))).otherwise(none))
    # A part without queries or without targets deals out nothing.
    return rows.select("vec_id", "group", "cell", "vector", "copies", "home", "away", F.explode(F.concat(*places)).alias("k")).select(
        "group", "cell", "k.*", "vec_id", "vector", "copies", "home", "away"
    )


def _forest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same vectors as the given pairs of places do, fewer than there are vectors."""
    nodes, where = np.unique(np.concatenate([ids[x], to[y]]), return_inverse=True)
    a, b = where[: len(x)], where[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def cell_links(blocks: DataFrame, threshold: float, radius: float) -> DataFrame:
    """``(vec_id, n, other)``: the weight of a vector's partners in a block, or a link (``n`` is null).

    Targets come first and are held; queries stream by, so memory is bounded by a block.
    """
    keys = ["group", "cell", "part", "target", "query"]
    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys, "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        targets = None

        def compare(ids: np.ndarray, x: np.ndarray, away: np.ndarray) -> pa.RecordBatch:
            to, y, weight, far = targets
            near = away[:, None] + far <= radius - SLACK
            open_ = ~near & (np.abs(away[:, None] - far) <= radius + SLACK)
            linked = near
            if open_.any():
                linked = near | (open_ & (x @ y.T >= threshold))
            linked &= ids[:, None] != to
            n = linked @ weight
            i, j = np.nonzero(linked)
            a, b = _forest(i, j, ids, to)
            has = n > 0
            size = int(has.sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[has], a])),
                    pa.array(np.concatenate([n[has], np.zeros(len(a), np.int64)]), pa.int64(), mask=np.arange(size + len(a)) >= size),
                    pa.array(np.concatenate([np.zeros(size, np.int64), b]), pa.int64(), mask=np.arange(size + len(a)) < size),
                ],
                ["vec_id", "n", "other"],
            )

        for batch in batches:
            columns = batch.to_pydict()
            key = list(zip(*[columns[k] for k in keys]))
            asks = columns["asks"]
            start = 0
            while start < len(key):
                end = start
                while end < len(key) and key[end] == key[start] and asks[end] == asks[start] and end - start < 512:
                    end += 1
                if key[start] != held_key:
                    held_key, held, targets = key[start], [], None
                ids = np.array(columns["vec_id"][start:end], np.int64)
                x = _unit(columns["vector"][start:end])
                away = np.array(columns["away"][start:end])
                if not asks[start]:
                    held.append((ids, x, np.array(columns["copies"][start:end], np.int64), away))
                elif held:
                    targets = targets or tuple(np.concatenate(c) for c in zip(*held))
                    yield compare(ids, x, away)
                start = end

    return ordered.mapInArrow(run, "vec_id bigint, n bigint, other bigint")


def similar_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: links by cosine within equal labels and dimensions.

    Equal vectors of a label are first merged into a class, whose members are linked. Rows
    without an id, a label or a usable vector link with nothing and are components of their
    own. Rows that repeat an id stay and count as vectors. An empty table gives no rows;
    other columns are not looked at.
    """
    radius = float(np.sqrt(2 - 2 * threshold))
    scratch = Scratch(rows.sparkSession)
    usable = scratch.write(normalised(rows, id_col, vector_col, label_col).withColumn("same", F.sha2("vector", 256)), "vectors")
    # The least id stands for a class; repeated rows of an id are copies too.
    classes = scratch.write(
        usable.groupBy("group", "same").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")),
        "classes",
    )
    cells = scratch.write(assigned(classes, pivots(classes, radius), radius), "cells")
    count = F.count(F.lit(1))
    sizes = scratch.write(
        cells.groupBy("group", "cell").agg(
            count.alias("n_all"),
            F.count_if("home").alias("n_home"),
            F.count_if("core").alias("n_core"),
            F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_copies"),
            F.min(F.when(F.col("core"), F.col("vec_id"))).alias("core_id"),
        ),
        "sizes",
    )
    found = scratch.write(cell_links(dealt(cells, sizes.select("group", "cell", "n_all", "n_home", "n_core")), threshold, radius), "found")
    core = cells.where("core").join(sizes, ["group", "cell"])
    within = core.select("vec_id", (F.col("core_copies") - F.col("copies")).alias("n"))
    beside = classes.select("vec_id", (F.col("copies") - 1).alias("n"))
    numbers = found.where("n IS NOT NULL").select("vec_id", "n").unionByName(within).unionByName(beside)
    numbers = numbers.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    links = found.where("n IS NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    parts = connected_components(links.unionByName(core.select(F.col("vec_id").alias("a"), F.col("core_id").alias("b"))))
    known = numbers.join(parts, F.col("vec_id") == F.col("id"), "left")
    named = classes.select("group", "same", "vec_id").join(
        known.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id")), "vec_id"
    )
    named = scratch.write(named.select("group", "same", "n_links", "component_id"), "named")
    # Every row finds its class; rows left out above have none.
    members = usable.select("vec_id", "group", "same").join(named, ["group", "same"]).select("vec_id", "n_links", "component_id")
    every = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"))
    rest = _left_out(every, members)
    return members.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _left_out(every: DataFrame, members: DataFrame) -> DataFrame:
    """The ids, as often as they occur more in ``every`` than in ``members``, each on its own."""
    both = every.select("vec_id", F.lit(1).alias("n")).unionAll(members.select("vec_id", F.lit(-1).alias("n")))
    more = both.groupBy("vec_id").agg(F.sum("n").cast("int").alias("n")).where("n > 0")
    again = more.select("vec_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return again.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
