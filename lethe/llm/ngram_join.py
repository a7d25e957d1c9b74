"""N-gram Jaccard join with signature trees.

1. Each text's shingle set gets a digest; equal sets are one class, whatever rows hold them. A class goes
   by a 64-bit key of its digest, and by its smallest doc_id in the result.
2. Segment signatures (see ``shingles``) bring sets together that may be similar. They are shuffled as
   packed arrays and counted; each set keeps the rarest of its shared ones, as many as the similarity
   demands, and what meets in those becomes star edges, whose components are the candidate groups. No
   pair of sets of the wanted similarity lies in two groups.
3. Sets, one for each class, are joined by signature trees over blocks that hold many groups side by
   side: leaves hold a set's bitmap and size, nodes the OR of their children's bitmaps and the range of
   sizes, and a dual traversal drops pairs of nodes whose greatest possible overlap is too small. Sets lie
   in order of their group and least hash, so that siblings are alike and nodes of different groups part
   near the root. Pairs of leaves are verified on the full sets. A pair whose ends are already connected
   needs no check, since components are the result.
4. Large groups are dealt to blocks by salt, each with the same few pivots, so that most of a group
   connects in linear work. Sets that remain apart from the group's main part are then joined with all
   blocks of the group, which makes the result exact.

Defined cases: texts without words have an empty set, link with nothing and are their own component;
rows that repeat a doc_id are one document, which connects its texts; null doc_ids are one document;
repeated rows each get a row;
an empty table gives an empty result; other columns pass through ``drop_near_copies`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import Scratch, bounded_batches, carried, small
from lethe.llm.components import connected_components
from lethe.llm.shingles import BOUNDS, TAG_BITS, differences, digest, mixed, overlap, shingle_set, signatures

NO_ID = -1 << 63
LEVEL = (80, 100)  # 100 * intersection >= 80 * union


# --- sets and candidate groups


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))


def class_key(found: bytes) -> int:
    """A 64-bit name of a class, from its digest."""
    return int.from_bytes(found[:8], "little", signed=True)


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, key) of each row; no digest and key for an empty set."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            digests = [digest(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([x and class_key(x) for x in digests], pa.int64())],
                ["doc_id", "n_shingles", "digest", "key"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, key long")


def _planes(ids: np.ndarray) -> bytes:
    """64-bit numbers by byte plane, which compresses well."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


FLUSH = 1 << 20
SIGNS, FILLED = range(2)
MET = "id long, tag int, sig long, m long"


def shared_signatures(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (id, tag, sig, m) for each signature that m > 1 classes have; ids are their keys.

    One row with m < 0 for each class and tag says that the class has -m signatures of the tag.
    """
    names = ["part", "kind", "keys", "ids"]

    def sign(batches):
        keys, ids, filled, seen, held = [], [], [], set(), 0

        def dealt(kind, by, x, y):
            part = (mixed(by) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            return [(p, kind, x[at].tobytes(), _planes(y[at])) for p in range(parts) if len(at := order[cuts[p] : cuts[p + 1]])]

        def flush():
            all_keys, counts = np.concatenate(keys), np.array(filled, np.int64)
            rows = dealt(SIGNS, all_keys, all_keys, np.concatenate(ids)) + dealt(FILLED, counts[:, 1].astype(np.uint64), counts[:, 0], counts[:, 1])
            for x in (keys, ids, filled, seen):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                items = shingle_set(text)
                if not len(items):
                    continue
                key = class_key(digest(items))
                if key in seen:  # the same set signs once in a flush
                    continue
                seen.add(key)
                for tag, found in signatures(items):
                    keys.append(found)
                    ids.append(np.full(len(found), key, np.int64))
                    filled.append((len(found) << TAG_BITS | tag, key))
                    held += len(found)
            if held >= FLUSH:
                yield flush()
                held = 0
        if held:
            yield flush()

    def rows_of(ids, tags, sigs, m):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags.astype(np.int32)), pa.array(sigs.view(np.int64)), pa.array(m.astype(np.int64))], ["id", "tag", "sig", "m"])

    def meet(batches):
        groups: dict[int, list] = {}
        counts: dict[int, list] = {}
        for batch in batches:
            for part, kind, keys, ids in zip(*(batch.column(k).to_pylist() for k in names)):
                keys, ids = np.frombuffer(keys, "<u8"), _unplanes(ids)
                if kind == SIGNS:
                    groups.setdefault(part, []).append((keys, ids))
                else:
                    counts.setdefault(part, []).append(np.stack([keys.view(np.int64), ids], 1))
        while counts:  # a set that several flushes hold counts once
            n, ids = np.unique(np.concatenate(counts.popitem()[1]), axis=0).T
            for i in range(0, len(n), FLUSH):
                x = n[i : i + FLUSH]
                yield rows_of(ids[i : i + FLUSH], x & (1 << TAG_BITS) - 1, np.zeros(len(x), np.int64), -(x >> TAG_BITS))
        while groups:
            got = groups.popitem()[1]
            keys, ids = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys, ids = keys[np.concatenate([[True], new])], ids[np.concatenate([[True], new])]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.diff(np.concatenate([starts, [len(keys)]]))
            m = np.repeat(n, n)
            at = m > 1
            for i in range(0, int(at.sum()), FLUSH):
                x = np.flatnonzero(at)[i : i + FLUSH]
                yield rows_of(ids[x], (keys[x] & np.uint64((1 << TAG_BITS) - 1)).astype(np.int64), keys[x], m[x])

    signed = _texts(docs).mapInArrow(sign, "part long, kind long, keys binary, ids binary")
    return signed.repartition(parts, "part").mapInArrow(meet, MET)


def candidate_edges(met: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between classes that may be similar, as stars around the smallest id of a signature.

    Of its signatures of a tag, in order of their counts, a class keeps the first d + 1. Those that
    no other class has come first in that order and count, though they lead nowhere.
    """
    by = Window.partitionBy("id", "tag")
    differ = F.element_at(F.array(*(F.lit(differences(i)) for i in range(len(BOUNDS) - 1))), F.shiftright("tag", 2) + 1)
    alone = F.greatest(F.lit(0), -F.min("m").over(by) - F.count_if(F.col("m") > 0).over(by))
    kept = (
        met.withColumn("rank", F.row_number().over(by.orderBy("m", "sig")) - 1)  # the row of m < 0 is first
        .withColumn("most", differ + 1 - alone)
        .where((F.col("m") > 0) & (F.col("rank") <= F.col("most")))
        .select("sig", "id")
    )
    kept = scratch.write(kept, "kept")
    low = kept.groupBy("sig").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return kept.join(scratch.write(low, "low"), "sig").where(F.col("id") > F.col("low")).select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()


# --- signature trees


class SignatureTree:
    """Bitmaps and size ranges of sets, level by level; level 0 are the sets, in order of group, least hash and size.

    ``seen`` tells (level, pairs, pairs kept) of the traversal, from the root down.
    """

    def __init__(self, sets: list[np.ndarray], groups: list[int] | None = None, fanout: int = 8):
        sizes = np.array([len(x) for x in sets], np.int64)
        low = np.array([int(x[0]) >> 1 for x in sets], np.int64)  # a min-hash: like sets often share it
        self.order = np.lexsort((sizes, low, np.zeros(len(sets)) if groups is None else np.array(groups, np.int64)))
        self.seen: list[tuple[int, int, int]] = []
        bits = 1 << int(np.clip(4 * int(sizes.max()), 256, 1 << 15) - 1).bit_length()
        maps = np.zeros((len(sets), bits), bool)
        for row, i in enumerate(self.order):
            maps[row, (sets[i] & np.uint64(bits - 1)).astype(np.int64)] = True
        packed = np.packbits(maps, axis=1).view(np.uint64)
        sizes = sizes[self.order]
        slack = sizes - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        self.levels = [(packed, sizes, sizes, slack)]
        self.fanout = fanout
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, sl = self.levels[-1]
            cut = np.arange(0, len(m), fanout)
            self.levels.append((np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(sl, cut)))

    def pairs(self):
        """Pairs (i, j) of sets that may be similar, by dual traversal from the root.

        Of x below node A and y below B, common elements lie in common bits; x has at most as many
        elements there as common bits plus its slack (elements less bits). So no overlap exceeds
        min(slack of A, slack of B) + common bits, nor the smaller greatest size.
        """
        top = len(self.levels) - 1
        front = np.zeros((1, 2), np.int64)
        for level in range(top, -1, -1):
            m, lo, hi, sl = self.levels[level]
            if level < top:
                n = len(m)
                kids = np.arange(self.fanout)
                a = (front[:, :1] * self.fanout + kids)[:, :, None]
                b = (front[:, 1:] * self.fanout + kids)[:, None, :]
                a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
                ok = (a < n) & (b < n) & (a <= b)
                front = np.stack([a[ok], b[ok]], 1)
            keep = np.zeros(len(front), bool)
            for at in range(0, len(front), 4096):
                a, b = front[at : at + 4096].T
                common = np.bitwise_count(m[a] & m[b]).sum(axis=1, dtype=np.int64)
                most = np.minimum(np.minimum(sl[a], sl[b]) + common, np.minimum(hi[a], hi[b]))
                # An overlap of 80 % of the union is at least 80/180 of both sizes together.
                need = lo[a] + lo[b]
                near = (LEVEL[1] * hi[a] >= LEVEL[0] * lo[b]) & (LEVEL[1] * hi[b] >= LEVEL[0] * lo[a])
                keep[at : at + 4096] = near & (most * (LEVEL[0] + LEVEL[1]) >= LEVEL[0] * need)
            self.seen.append((level, len(front), int(keep.sum())))
            front = front[keep]
        front = front[front[:, 0] < front[:, 1]]
        return self.order[front[:, 0]], self.order[front[:, 1]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = overlap(a, b)
    return LEVEL[1] * both >= LEVEL[0] * (len(a) + len(b) - both)


def block_links(ids: list[int], sets: list[np.ndarray], labels: list[int], groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what similar pairs connect, beyond what equal labels connect already."""
    if len(sets) < 2:
        return []
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first: dict[int, int] = {}
    for i, label in enumerate(labels):
        up[i] = first.setdefault(label, i)
    links = []
    for i, j in zip(*SignatureTree(sets, groups).pairs()):
        a, b = find(int(i)), find(int(j))
        if a != b and similar(sets[i], sets[j]):
            up[a] = b
            links.append((ids[i], ids[j]))
    return links


def _join_blocks(rows: DataFrame) -> DataFrame:
    """Edges (a, b) found in blocks of rows (block, grp, id, label, items)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        links = block_links(ids, [np.frombuffer(x, "<u8") for x in table.column("items").to_pylist()], table.column("label").to_pylist(), table.column("grp").to_pylist())
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return rows.groupBy("block").applyInArrow(run, "a long, b long")


# --- the join


def join_sets(
    docs: DataFrame, scratch: Scratch, block_rows: int = 128, block_items: int = 1 << 20, pivots: int = 4, per_part: int = 2_500_000, broadcast_rows: int = 2_000_000
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, digest, key) of each row, and (digest, rep, component) of each class.

    A block of several groups holds about four times ``block_rows`` sets, and no more than about ``block_items`` elements.
    """
    bounded_batches(docs.sparkSession)
    sizes = scratch.write(set_sizes(docs), "sizes")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // per_part)
    classes = scratch.write(sizes.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("n_shingles").alias("size")), "classes")
    met = scratch.write(shared_signatures(docs, parts), "met")
    near = scratch.write(candidate_edges(met, scratch), "near")
    for name in ("met", "kept", "low"):
        scratch.drop(name)
    groups = connected_components(near, scratch, "groups").withColumnRenamed("component", "grp")
    # Classes in groups, and their sets from the rows of their smallest doc_ids.
    members = scratch.write(classes.join(groups, classes["key"] == groups["id"]).select("key", "rep", "grp", "size"), "members")
    split = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("size") / block_items)).cast("int")
    counts = scratch.write(members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), split.alias("blocks")), "counts")
    one = counts.where(F.col("blocks") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0))).first()
    shelves = max(1, one[0] // (4 * block_rows), one[1] // block_items)  # blocks of several groups
    members = scratch.write(members.join(counts, "grp").select("key", "rep", "grp", "blocks"), "wanted")
    n_members = members.count()

    def sets(batches):
        for batch in batches:
            found = [x for x in map(shingle_set, batch.column("text").to_pylist()) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([class_key(digest(x)) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "items"])

    reps = members.select("rep").distinct()
    texts = _texts(docs).join(small(reps, n_members, broadcast_rows), F.col("doc_id") == F.col("rep"), "left_semi").select("text")
    items = texts.mapInArrow(sets, "id long, items binary").join(small(members, n_members, broadcast_rows), F.col("id") == F.col("key"))
    items = scratch.write(items.select("grp", "blocks", "id", "items"), "items")
    if items.count() > n_members:  # rows of one doc_id repeat a set
        items = scratch.write(items.dropDuplicates(["id"]), "unique")
    salt = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    alone, shelf = F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(shelves))
    block = F.struct(F.when(alone, shelf).otherwise(F.col("grp")).alias("grp"), F.when(alone, F.lit(-1)).otherwise(salt).alias("x"), F.lit(0).alias("y"))
    own = items.select(block.alias("block"), "grp", "id", F.col("id").alias("label"), "items")
    by_hash = Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id")
    shared = (
        items.where(F.col("blocks") > 1)
        .withColumn("rank", F.row_number().over(by_hash))
        .where(F.col("rank") <= pivots)
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where(F.col("x") != salt)
        .select(F.struct("grp", "x", F.lit(0).alias("y")).alias("block"), "grp", "id", F.col("id").alias("label"), "items")
    )
    links = scratch.write(_join_blocks(own.union(shared)), "links")
    large = items.where(F.col("blocks") > 1)
    if not large.isEmpty():
        found = connected_components(links, scratch, "first")
        links = links.union(scratch.write(_join_rest(large, found, scratch, block_rows), "more"))
    named = lambda end: members.select(F.col("key").alias(end), F.col("rep").alias(f"{end}_rep"))
    links = links.join(named("a"), "a").join(named("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    found = connected_components(links.union(_same_document(sizes, classes, scratch)), scratch, "all")
    joined = classes.join(found, classes["rep"] == found["id"], "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    return sizes, scratch.write(joined, "joined")


def _same_document(sizes: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between the smallest doc_ids of the classes of a doc_id that has several; null has but one."""
    full = sizes.where(F.col("key").isNotNull() & (F.col("doc_id") != NO_ID))
    several = scratch.write(full.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where(F.col("low") != F.col("high")).select("doc_id"), "several")
    reps = full.join(several, "doc_id", "left_semi").select("doc_id", "key").join(classes, "key").select("doc_id", "rep").distinct()
    low = reps.groupBy("doc_id").agg(F.min("rep").alias("low"))
    return reps.join(low, "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b"))


def _join_rest(large: DataFrame, found: DataFrame, scratch: Scratch, block_rows: int) -> DataFrame:
    """Edges between the sets of a large group that are apart from its main part and all its other sets."""
    labelled = large.join(found, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    labelled = scratch.write(labelled, "labelled")
    by_label = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("m"))
    main = by_label.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("top"))
    main = scratch.write(main.where(F.col("all") > F.col("top")), "main")
    rows = scratch.write(labelled.join(main, "grp"), "apart")
    chunk = lambda n: F.greatest(F.lit(1), F.ceil(2 * n / block_rows)).cast("int")
    rest = chunk(F.col("all") - F.col("top"))
    spot = F.xxhash64("id", F.lit(1))
    ys = F.explode(F.sequence(F.lit(0), F.col("all_chunks") - 1))
    rows = rows.withColumn("rest_chunks", rest).withColumn("all_chunks", chunk(F.col("all")))
    x, y = F.pmod(spot, F.col("rest_chunks")).cast("int"), F.pmod(spot, F.col("all_chunks")).cast("int")
    left = rows.where(F.col("label") != F.col("main")).select("grp", x.alias("x"), ys.alias("y"), "id", "label", "items")
    right = rows.select("grp", F.explode(F.sequence(F.lit(0), F.col("rest_chunks") - 1)).alias("x"), y.alias("y"), "id", "label", "items")
    blocks = left.union(right).select(F.struct("grp", "x", "y").alias("block"), "grp", "id", "label", "items").dropDuplicates(["block", "id"])
    return _join_blocks(blocks)


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of (doc_id, text)."""
    sizes, classes = join_sets(docs, Scratch(docs.sparkSession, "ngram-join"), **options)
    out = sizes.join(classes, "digest", "left")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; texts without words all stay."""
    sizes, classes = join_sets(docs, Scratch(docs.sparkSession, "ngram-join"), **options)
    gone = sizes.join(classes, "digest").where(F.col("doc_id") != F.col("component")).select(F.col("doc_id").alias("id")).distinct()
    return docs.select(carried(docs), F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).join(gone, "id", "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.root FROM r JOIN e ON r.id = e.x),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id FROM n JOIN c ON n.doc_id = c.id
"""
