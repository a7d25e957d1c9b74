"""Embedding near-duplicates by NN-descent.

1. Equal vectors are one class with a weight, so exact copies cost nothing further.
2. A first neighbour graph comes from leaves of random hyperplane codes, several times over; a leaf that
   is too full takes further bits, and vectors too alike for that are dealt to leaves by salt.
3. NN-descent: around each vector its neighbours and a sample of its reverse neighbours are compared
   with each other, and each keeps its nearest. Vectors whose list is full of links are saturated and
   get a list twice as long. Rounds end when few lists change, or no change is a link.
4. An audit compares a bounded sample of vectors with all others, and further leaves and rounds follow
   while too few of its links are connected.
5. Edges at or above the threshold stay, of all rounds; their components are the groups. Inside a group
   each vector's links are counted exactly, however long its list was: a large group is dealt to cells
   around pivots, of which the triangle inequality tells those apart that hold no link or nothing else,
   and blocks count the rest without emitting pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing; vectors of different lengths link with nothing; scaled copies have cosine 1; repeated vec_ids
are one vertex of their first vector in byte order, and each row is returned; null vec_ids get a row
each, linked with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import logging
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import Scratch, bounded_batches
from lethe.llm.components import connected_components

BITS = 48
LOG = logging.getLogger(__name__)


def pack(vector: np.ndarray) -> bytes:
    """A vector as bytes: a mark for the precision that holds it exactly, and its components.

    Doubles are scaled first, so that no square overflows.
    """
    single = vector.astype("<f4")
    if (single == vector).all():
        return b"4" + single.tobytes()
    return b"8" + (vector / np.abs(vector).max()).tobytes()


def unpack(raw: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<f4" if r[:1] == b"4" else "<f8", offset=1) for r in raw]).astype("<f8")


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit vectors in double precision."""
    x = unpack(raw)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _checked(vectors: DataFrame) -> DataFrame:
    """(id, dim, key, raw) of the vectors that can link."""

    def run(batches):
        for batch in batches:
            out = []
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if vec_id is None or not x or any(v is None for v in x):
                    continue
                v = np.asarray(x, "<f8")
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    raw = pack(v)
                    out.append((vec_id, len(v), hashlib.blake2b(raw, digest_size=16).digest(), raw))
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["id", "dim", "key", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "id long, dim long, key binary, raw binary")
    return rows.groupBy("id").agg(F.min_by(F.struct("dim", "key", "raw"), "raw").alias("x")).select("id", "x.dim", "x.key", "x.raw")


def _codes(classes: DataFrame, trees: int, seed: int) -> DataFrame:
    """(id, dim, raw, tree, code): for each tree, which side of random hyperplanes a vector is on."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, dims, raws = (np.array(batch.column(c).to_pylist(), t) for c, t in (("id", np.int64), ("dim", np.int64), ("raw", object)))
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, int(dim))).standard_normal((int(dim), trees * BITS))
                at = np.flatnonzero(dims == dim)
                side = (unit(raws[at]) @ planes[dim] > 0).reshape(len(at), trees, BITS)
                code = side @ (np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1])
                for tree in range(trees):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at]), pa.array(np.full(n, dim)), pa.array(raws[at].tolist(), pa.binary()), pa.array(np.full(n, tree)), pa.array(code[:, tree])],
                        ["id", "dim", "raw", "tree", "code"],
                    )

    return classes.select("id", "dim", "raw").mapInArrow(run, "id long, dim long, raw binary, tree long, code long")


def _top(sims: np.ndarray, k: int):
    """Row and column of the k largest entries of each row, the diagonal left out."""
    np.fill_diagonal(sims, -np.inf)
    k = min(k, len(sims) - 1)
    cols = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(sims), 0), int)
    return np.repeat(np.arange(len(sims)), k), cols.ravel()


EDGES = "u long, v long, sim double"


def _leaf_edges(classes: DataFrame, n: int, scratch: Scratch, name: str, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """The k nearest within a leaf for each vector and tree."""
    depth = min(BITS // 2, max(0, math.ceil(math.log2(max(1, n / leaf)))))
    codes = scratch.write(_codes(classes, trees, seed), f"{name}-codes")
    first = F.shiftright("code", BITS - depth)
    rows = codes.withColumn("b1", first)
    by1 = ["tree", "dim", "b1"]
    full = scratch.write(rows.groupBy(*by1).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf), f"{name}-full")
    more = F.least(F.lit(BITS - depth), F.ceil(F.log2(F.col("n") / leaf)).cast("int"))
    rows = rows.join(full.withColumn("more", more).drop("n"), by1, "left")
    rows = rows.withColumn("b2", F.coalesce(F.expr(f"shiftright(code, {BITS - depth} - more)"), F.lit(-1)))
    by2 = [*by1, "b2"]
    crowded = rows.where(F.col("more").isNotNull()).groupBy(*by2).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf)
    crowded = scratch.write(crowded.withColumn("salts", F.ceil(F.col("n") / leaf)).drop("n"), f"{name}-crowded")
    rows = rows.join(crowded, by2, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "tree", F.lit(seed)), "salts"), F.lit(0)))

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), np.int64)
        if len(ids) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        x = unit(table.column("raw").to_pylist())
        sims = x @ x.T
        a, b = _top(sims, k)
        return pa.table({"u": ids[a], "v": ids[b], "sim": sims[a, b]})

    return rows.groupBy(*by2, "salt").applyInArrow(run, EDGES)


def _groups(batches, key: str):
    """Tables of the rows of one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(batch)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(batch):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _nearest(edges: DataFrame, k: DataFrame | int) -> DataFrame:
    """The nearest of each list: k of them, or the vector's own number where a table (u, k) gives one."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    if isinstance(k, int):
        return best.where(F.col("r") <= k).drop("r")
    return best.join(k, "u").where(F.col("r") <= F.col("k")).drop("r", "k")


def _descend(lists: DataFrame, sizes: DataFrame, classes: DataFrame, scratch: Scratch, name: str, threshold: float, reverse: int) -> DataFrame:
    """One round: what neighbours of a common vector find in each other, merged into the lists."""
    worst = lists.join(sizes, "u").groupBy("u", "k").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    worst = scratch.write(worst.select("u", F.when(F.col("n") < F.col("k"), F.lit(-2.0)).otherwise(F.col("low")).alias("low")), f"{name}-worst")
    by = Window.partitionBy("v").orderBy(F.xxhash64("u", "v"))
    back = lists.withColumn("r", F.row_number().over(by)).where(F.col("r") <= reverse).select(F.col("v").alias("w"), F.col("u").alias("id"))
    around = lists.select(F.col("u").alias("w"), F.col("v").alias("id")).union(back).union(lists.select(F.col("u").alias("w"), F.col("u").alias("id"))).distinct()
    told = scratch.write(classes.join(worst, classes["id"] == worst["u"], "left").select("id", "raw", F.coalesce("low", F.lit(-2.0)).alias("low")), f"{name}-told")
    rows = around.join(told, "id")

    def compare(batches):
        for group in _groups(batches, "w"):
            ids = group.column("id").to_numpy()
            low = group.column("low").to_numpy()
            x = unit(group.column("raw").to_pylist())
            sims = x @ x.T
            np.fill_diagonal(sims, -np.inf)
            a, b = np.nonzero(sims > low[:, None])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(sims[a, b])], ["u", "v", "sim"])

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "w").sortWithinPartitions("w").mapInArrow(compare, EDGES)
    return _nearest(lists.union(found), sizes)


def audit(classes: DataFrame, n: int, sample: int, threshold: float) -> DataFrame:
    """Links (u, v) of about ``sample`` vectors, chosen by hash, with all others, by brute force."""
    spot = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))
    chosen = classes.where(spot < max(1, int((1 << 20) * min(1.0, sample / max(1, n))))).select("id", "dim", "raw").orderBy("id").limit(4 * sample).collect()
    shipped = classes.sparkSession.sparkContext.broadcast([(r.id, r.dim, bytes(r.raw)) for r in chosen])

    def run(batches):
        by_dim: dict[int, list] = {}
        for vec_id, dim, raw in shipped.value:
            by_dim.setdefault(dim, []).append((vec_id, raw))
        ready = {d: (np.array([i for i, _ in x]), unit([r for _, r in x])) for d, x in by_dim.items()}
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            ids, raws = np.array(batch.column("id").to_pylist(), np.int64), np.array(batch.column("raw").to_pylist(), object)
            for dim, (q, x) in ready.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    a, b = np.nonzero(x @ unit(raws[at]).T >= threshold)
                    keep = q[a] != ids[at][b]
                    yield pa.RecordBatch.from_arrays([pa.array(q[a][keep]), pa.array(ids[at][b][keep])], ["u", "v"])

    return classes.select("id", "dim", "raw").mapInArrow(run, "u long, v long")


def near_links(
    vectors: DataFrame, threshold: float = 0.95, k: int = 12, most: int = 96, trees: int = 6, leaf: int = 128, rounds: int = 4, little: float = 0.01,
    sample: int = 256, recall: float = 0.98, least: float = 0.9, extra: int = 2, block: int = 512,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding).

    Links inside components are counted exactly, so a true link is found if its ends lie in one
    component; that share of the audit's links is logged. Links that the audit finds are kept. Below
    ``recall`` another attempt follows, ``extra`` at most; below ``least`` after the last one, the job fails.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "embeddings")
    points = scratch.write(_checked(vectors), "points")
    classes = points.groupBy("dim", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.min("raw").alias("raw"))
    classes = scratch.write(classes, "classes")
    n = classes.count()
    ends = lambda x: x.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    lists = links = found = None
    for attempt in range(extra + 1):
        edges = _leaf_edges(classes, n, scratch, f"leaves-{attempt}", k, trees, leaf, seed=101 + attempt)
        if lists is None:
            lists = scratch.write(_nearest(edges, k), f"lists-{attempt}-0")
        else:  # lists keep the lengths that they have grown to
            lengths = scratch.write(lists.groupBy("u").agg(F.greatest(F.lit(k), F.count(F.lit(1))).alias("k")), f"lengths-{attempt}")
            all_ids = classes.select(F.col("id").alias("u")).join(lengths, "u", "left").select("u", F.coalesce("k", F.lit(k)).alias("k"))
            lists = scratch.write(_nearest(edges.union(lists), all_ids), f"lists-{attempt}-0")
        seen = [lists]
        for step in range(1, rounds + 1):
            # A list full of links is saturated and may grow to twice its length, up to ``most``.
            full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
            grown = F.when((F.col("n") >= k) & (F.col("low") >= threshold), F.greatest(F.col("n"), F.least(F.lit(most), 2 * F.col("n")))).otherwise(F.greatest(F.lit(k), "n"))
            sizes = scratch.write(full.select("u", grown.alias("k")), f"sizes-{attempt}-{step}")
            new = scratch.write(_descend(lists, sizes, classes, scratch, f"round-{attempt}-{step}", threshold, k), f"lists-{attempt}-{step}")
            fresh = new.join(lists, ["u", "v"], "left_anti").agg(F.count(F.lit(1)), F.count_if(F.col("sim") >= threshold)).first()
            lists = new
            seen.append(lists)
            if fresh[0] <= little * k * n or not fresh[1]:
                break
        # Every link that any list has held counts, of this attempt and of those before.
        held = reduce(DataFrame.union, map(ends, seen), ends(lists) if links is None else links)
        links = scratch.write(held.distinct(), f"links-{attempt}")
        found = scratch.write(connected_components(links, scratch, f"components-{attempt}"), f"found-{attempt}")
        truth = scratch.write(audit(classes, n, sample, threshold), f"audit-{attempt}")
        side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of"))
        met = truth.join(side("u"), "u", "left").join(side("v"), "v", "left").agg(F.count(F.lit(1)), F.count_if(F.col("u_of") == F.col("v_of"))).first()
        share = met[1] / met[0] if met[0] else 1.0
        LOG.info("attempt %d: %.4f of %d audited links lie inside a component", attempt, share, met[0])
        if share == 1.0:
            break
        links = scratch.write(links.union(truth.select(F.col("u").alias("a"), F.col("v").alias("b"))).distinct(), f"links-{attempt}-told")
        found = scratch.write(connected_components(links, scratch, f"components-{attempt}-told"), f"found-{attempt}-told")
        if share >= recall:
            break
    else:
        if share < least:
            raise RuntimeError(f"recall {share:.3f} of {met[0]} audited links after {extra + 1} attempts: allow more attempts, trees or longer lists")
    counts = _link_counts(classes, found, scratch, threshold, block)
    whole = classes.join(found, "id", "left").join(counts, "id", "left")
    whole = scratch.write(
        whole.select("key", "dim", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "whole"
    )
    by_id = scratch.write(points.select("id", "key", "dim").join(whole, ["key", "dim"]).select("id", "component", "n_links"), "by-id")
    out = vectors.select(F.col("vec_id")).join(by_id, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _link_counts(classes: DataFrame, found: DataFrame, scratch: Scratch, threshold: float, block: int) -> DataFrame:
    """(id, links): the weights of the other classes of the component at or above the threshold.

    A component of up to ``block`` classes is compared in one block, a larger one cell by cell.
    """
    sizes = scratch.write(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component-sizes")
    members = classes.join(found, "id").select("id", "raw", "weight", "component")
    members = scratch.write(members.join(sizes, "component"), "members")

    def one_block(table: pa.Table) -> pa.Table:
        near = (x := unit(table.column("raw").to_pylist())) @ x.T >= threshold
        np.fill_diagonal(near, False)
        return pa.table({"id": table.column("id"), "links": near @ table.column("weight").to_numpy()})

    counts = members.where(F.col("n") <= block).groupBy("component").applyInArrow(one_block, "id long, links long")
    large = members.where(F.col("n") > block)
    if not large.isEmpty():
        counts = counts.union(_large_counts(large, scratch, threshold, block))
    return counts.groupBy("id").agg(F.sum("links").alias("links"))


CELLS = "component long, id long, raw binary, weight long, cell int, angle double"


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _cells(large: DataFrame, scratch: Scratch, threshold: float, most: int, room: int) -> tuple[DataFrame, DataFrame]:
    """(component, id, raw, weight, cell, angle): each vector of a large component with its nearest pivot and the angle to it; and the pivots.

    A component's pivots are its centre and vectors drawn by hash, one in sixteen but ``most`` at the
    most, of which those stay that are half the threshold's angle apart.
    Cells are even numbers; a vector within half the threshold's angle of its pivot is in the odd one beside.
    """
    widest = math.acos(threshold)
    half = widest / 2 - 1e-6

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for component, x in zip(batch.column("component").to_pylist(), unit(batch.column("raw").to_pylist()) if len(batch) else ()):
                sums[component] = sums[component] + x if component in sums else x
            if len(sums) > 10_000:
                yield _sum_rows(sums)
                sums = {}
        if sums:
            yield _sum_rows(sums)

    def net(table: pa.Table) -> pa.Table:
        raws, centre = table.column("raw").to_pylist(), table.column("centre").to_pylist()
        total = np.sum([np.frombuffer(r, "<f8") for r, c in zip(raws, centre) if c], axis=0)
        drawn = sorted(r for r, c in zip(raws, centre) if not c)
        x = np.random.default_rng(len(drawn)).permutation(unit(drawn))
        # Where cells around all of them would mostly be within reach of each other, an eighth makes cells of a handier size.
        between = np.sort(_angles(x, x), axis=1)
        reach = 2 * np.median(between[:, min(1, len(x) - 1)]) + widest
        if (between <= reach).mean() > 0.2:
            x = x[: -(-len(x) // 8)]
        if np.linalg.norm(total) > 1e-6:
            x = np.concatenate([total[None] / np.linalg.norm(total), x])
        kept, open_ = [], np.ones(len(x), bool)
        for i in range(len(x)):
            if open_[i]:
                kept.append(x[i])
                open_ &= _angles(x, x[i : i + 1])[:, 0] > half
        pivots = b"".join(p.tobytes() for p in kept)
        return pa.table({"component": table.column("component").slice(0, 1), "pivots": pa.array([pivots], pa.binary())})

    want = F.least(F.lit(most), F.ceil(F.greatest(4 * F.sqrt("n"), F.col("n") / 16))).cast("int")
    spot = F.xxhash64("id", F.lit(31))
    place = F.row_number().over(Window.partitionBy("component").orderBy(spot, "id"))
    drawn = large.select("component", "raw", "id", "n").withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= want)
    sums = large.mapInArrow(partial, "component long, raw binary").select("component", "raw", F.lit(True).alias("centre"))
    pivots = sums.union(drawn.select("component", "raw", F.lit(False))).groupBy("component").applyInArrow(net, "component long, pivots binary")
    pivots = scratch.write(pivots, "pivots")

    def assign(table: pa.Table) -> pa.Table:
        raws, held = table.column("raw").to_pylist(), [p for p in table.column("pivots").to_pylist() if p]
        at = [i for i, r in enumerate(raws) if r is not None]
        if not at:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.float64())], [c.split()[0] for c in CELLS.split(", ")])
        x = unit([raws[i] for i in at])
        angles = _angles(x, np.frombuffer(held[0], "<f8").reshape(-1, x.shape[1]))
        cell = angles.argmin(axis=1)
        angle = angles[np.arange(len(at)), cell]
        rows = table.take(at)
        return pa.table({k: rows.column(k) for k in ("component", "id", "raw", "weight")} | {"cell": pa.array((2 * cell + (angle <= half)).astype(np.int32)), "angle": pa.array(angle)})

    # Vectors are dealt to blocks by salt, and the pivots go to each of them as one row.
    blocks = F.ceil(F.col("n") / room).cast("int")
    rows = large.select("component", F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int").alias("x"), "id", "raw", "weight", F.lit(None).cast("binary").alias("pivots"))
    each = large.groupBy("component").agg(F.max(blocks).alias("b")).join(pivots, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("x"), "pivots")
    told = each.select("component", "x", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("long").alias("weight"), "pivots")
    return scratch.write(rows.union(told).groupBy("component", "x").applyInArrow(assign, CELLS), "cells"), pivots


def _cell_pairs(cells: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """(component, a, b, whole): pairs of cells, a <= b, that hold links by the triangle inequality; whole: nothing but links."""
    widest = math.acos(threshold)
    sizes = cells.groupBy("component", "cell").agg(F.max("angle").alias("radius"))

    def pairs(table: pa.Table) -> pa.Table:
        cell, radius = table.column("cell").to_numpy(), table.column("radius").to_numpy()
        packed, n = next(p for p in table.column("pivots").to_pylist() if p), int(table.column("n_pivots")[0].as_py())
        x = np.frombuffer(packed, "<f8").reshape(n, -1)[cell >> 1]
        between = _angles(x, x)
        spread = radius[:, None] + radius[None, :]
        a, b = np.nonzero((between - spread <= widest + 1e-6) & (cell[:, None] <= cell[None, :]))
        whole = (between + spread)[a, b] <= widest - 1e-6
        return pa.table({"component": pa.array(np.full(len(a), table.column("component")[0].as_py())), "a": cell[a], "b": cell[b], "whole": whole})

    dims = cells.groupBy("component").agg(F.min("raw").alias("one"))
    width = F.when(F.substring("one", 1, 1) == F.lit(b"4"), (F.octet_length("one") - 1) / 4).otherwise((F.octet_length("one") - 1) / 8)
    held = pivots.join(dims, "component").select("component", "pivots", (F.octet_length("pivots") / 8 / width).cast("int").alias("n_pivots"))
    first = sizes.groupBy("component").agg(F.min("cell").alias("cell")).join(held, "component")  # the pivots travel once
    n_pivots = held.select("component", "n_pivots")
    rows = sizes.join(n_pivots, "component").join(first.select("component", "cell", "pivots"), ["component", "cell"], "left")
    return rows.groupBy("component").applyInArrow(pairs, "component long, a int, b int, whole boolean")


def _large_counts(large: DataFrame, scratch: Scratch, threshold: float, block: int, most: int = 2048) -> DataFrame:
    """(id, links) parts for the vectors of large components.

    Vectors are dealt to cells around pivots. Pairs of cells too far apart to hold a link are passed
    over, pairs so close that all is linked are counted by weight, and only the others are compared, in
    blocks: along a chain of vectors that is a bounded number of cells for each, and inside a dense group
    nothing. Cells of a component far longer than ``most`` pivots can tell apart stay large, and the
    work is then quadratic in them.
    """
    cells, pivots = _cells(large, scratch, threshold, most, 8 * block)
    pairs = scratch.write(_cell_pairs(cells, pivots, threshold), "cell-pairs")
    sizes = cells.groupBy("component", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))
    sizes = scratch.write(sizes, "cell-sizes")
    both = pairs.select("component", F.col("a").alias("cell"), F.col("b").alias("other"), "whole")
    both = both.union(pairs.where("a != b").select("component", "b", "a", "whole"))
    sums = both.where("whole").join(sizes.withColumnRenamed("cell", "other"), ["component", "other"])
    sums = scratch.write(sums.groupBy("component", "cell").agg(F.sum("total").alias("sum"), F.max(F.col("cell") == F.col("other")).alias("self")), "whole")
    counted = cells.join(sums, ["component", "cell"]).select("id", (F.col("sum") - F.when(F.col("self"), F.col("weight")).otherwise(0)).alias("links"))
    chunks = F.greatest(F.lit(1), F.ceil(2 * F.col("n") / block)).cast("int")
    size = sizes.select("component", "cell", chunks.alias("chunks"))
    met = pairs.where(~F.col("whole")).join(size.select("component", F.col("cell").alias("a"), F.col("chunks").alias("xs")), ["component", "a"])
    met = scratch.write(met.join(size.select("component", F.col("cell").alias("b"), F.col("chunks").alias("ys")), ["component", "b"]), "met")
    dealt = cells.join(size, ["component", "cell"]).withColumn("at", F.pmod(F.xxhash64("id"), "chunks").cast("int")).select("component", "cell", "id", "weight", "raw", "at")
    dealt = scratch.write(dealt, "dealt")
    side = lambda mine, n: dealt.join(met.withColumn("cell", F.col(mine)), ["component", "cell"]).withColumn("to", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    one = F.col("a") == F.col("b")
    left = side("a", "ys").where(~one | (F.col("at") <= F.col("to"))).select("component", "a", "b", F.col("at").alias("x"), F.col("to").alias("y"), "id", "weight", "raw", F.lit(True).alias("asks"))
    right = side("b", "xs").where(~one | (F.col("to") < F.col("at"))).select("component", "a", "b", F.col("to").alias("x"), F.col("at").alias("y"), "id", "weight", "raw", F.lit(False).alias("asks"))

    def compare(table: pa.Table) -> pa.Table:
        ids, weight, asks = (table.column(k).to_numpy() for k in ("id", "weight", "asks"))
        x = unit(table.column("raw").to_pylist())
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        if table.column("a")[0] == table.column("b")[0] and table.column("x")[0] == table.column("y")[0]:  # a chunk with itself
            near = x[a] @ x[a].T >= threshold
            np.fill_diagonal(near, False)
            return pa.table({"id": ids[a], "links": near @ weight[a]})
        near = x[a] @ x[b].T >= threshold
        return pa.table({"id": np.concatenate([ids[a], ids[b]]), "links": np.concatenate([near @ weight[b], near.T @ weight[a]])})

    return counted.union(left.union(right).groupBy("component", "a", "b", "x", "y").applyInArrow(compare, "id long, links long"))


def _sum_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["component", "raw"])


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON r.id = l.x),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
d AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT m.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON m.vec_id = c.id LEFT JOIN d ON d.x = m.vec_id
"""
