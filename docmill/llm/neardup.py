"""Near-duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

Two collections of HALVES keys are made, each of ROWS minimum hashes. A table is a pair of one key of either
collection, so 2 * HALVES * ROWS hashes serve HALVES ** 2 tables of 2 * ROWS hashes, about the square root of what
separate tables need. At similarity s a link is missed with probability at most 2 (1 - s ** ROWS) ** HALVES, 9e-5 at
s = 0.8 and 3e-6 at 0.85, and then matters only if no other path joins the two.

1. Documents with equal shingle sets become one representative (partial sums before the shuffle).
2. Halves that only one representative has are dropped before pairs of halves are formed.
3. Each table bucket is a star around its smallest member, so a bucket of n gives n - 1 edges; components of the stars are
   clusters that hold every candidate pair.
4. A cluster above one block is split first, so that a chain of documents with little in common comes apart before it is compared.
   This loses no link: of two linked sets each has one of the other's among its rarest few (prefix filter, see _split), so the
   links that are found do not depend on the size of a cluster.
5. A cluster is dealt out in blocks; a task compares two blocks by their full sets and returns a spanning forest of the
   links it finds, never all pairs. Components of these are the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_blocks, overlaps
from .common import Memo, dropped, likely_among, marked, resident, written
from .components import connected_components

HALVES, ROWS = 14, 3
#: Documents of a cluster that are compared as one block.
BLOCK = 384
#: Counters of shingles that order those of large clusters by how frequent they are (2 MB in each worker).
COUNTERS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _FOLD
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of 64-bit hashes of `width` consecutive words; words are maximal runs without ASCII white space, A-Z lowered."""

    def __init__(self, width: int, bound: int = 150_000) -> None:
        import xxhash

        self.width = width
        self.words = Memo(lambda w: xxhash.xxh3_64_intdigest(w), bound)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; fewer words than `width` are one shingle, none are none."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        width = min(self.width, n)
        x = h[: n - width + 1].copy()
        for i in range(1, width):
            x *= _MIX
            x += h[i : n - width + 1 + i]
        if n < self.width:  # not equal to a part of a longer text
            x = x * _MIX + np.uint64(n)
        return np.unique(_mixed(x))


class Hasher:
    """The half keys of a set."""

    def __init__(self, halves: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = 2 * halves * rows
        self.halves, self.rows = halves, rows
        self.a = rng.integers(1, 1 << 63, n, dtype=np.uint64)[:, None] | np.uint64(1)
        self.b = rng.integers(1, 1 << 63, n, dtype=np.uint64)[:, None]
        self.salt = rng.integers(1, 1 << 63, 2 * halves, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = None
        for i in range(0, len(shingles), 4096):
            x = ((shingles[None, i : i + 4096] * self.a + self.b) >> np.uint64(16)).min(axis=1)
            least = x if least is None else np.minimum(least, x)
        least = least.reshape(2 * self.halves, self.rows)
        key = self.salt.copy()
        for i in range(self.rows):
            key = _mixed(key * _MIX + least[:, i])
        return key.view(np.int64)


SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("halves", T.ArrayType(T.LongType()))])


def shingle_sets(docs: DataFrame, width: int, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, a hash of the whole set (null if empty) and its half keys."""

    def run(batches):
        import pyarrow as pa

        shingle, keys = resident(("shingles", width), lambda: Shingler(width)), Hasher(halves, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sizes, hashes, found = [], [], []
                for t in batch.column(1)[at : at + 512].to_pylist():
                    x = shingle(t)
                    sizes.append(len(x))
                    hashes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    found.append(keys(x) if len(x) else np.zeros(0, np.int64))
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512], pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), lists], names=SETS.names)

    return docs.mapInArrow(run, SETS)


def _candidates(reps: DataFrame, halves: int) -> DataFrame:
    """Star edges (u, v) of the table buckets of (rep, halves)."""
    each = reps.select("rep", F.posexplode("halves").alias("i", "half"))
    shared = each.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    live = each.join(shared, "half").groupBy("rep").agg(F.collect_list(F.struct("i", "half")).alias("h"))  # at most 2 * HALVES
    side = lambda low: F.filter("h", lambda x: (x["i"] < halves) if low else (x["i"] >= halves))
    pairs = live.select("rep", F.explode(side(True)).alias("a"), side(False).alias("bs")).select("rep", "a", F.explode("bs").alias("b"))
    tables = pairs.select("rep", F.xxhash64("a.half", "b.half").alias("key"))
    tables = written(tables, "tables")
    stars = tables.groupBy("key").agg(F.min("rep").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "u")
    edges = written(tables.join(stars, "key").where("rep <> u").select("u", F.col("rep").alias("v")).distinct(), "stars")
    dropped(tables)
    return edges


def links(sets: list[np.ndarray], blocks: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= percent * union) between sets of the two blocks, or within one."""
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((i, j))

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    within = len(set(blocks)) == 1
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if (within or blocks[i] != blocks[j]) and root(i) != root(j):
                    small, large = sorted((int(sizes[i]), int(sizes[j])))
                    if 100 * small >= percent * large:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= percent * (small + large - both):
                            join(i, j)
        return out
    both = overlaps(sets)
    ok = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if not within:
        b = np.array(blocks)
        ok &= b[:, None] != b[None, :]
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        join(int(i), int(j))
    return out


EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _confirmed(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) of (cluster, i, j, block, rep, text), rows of a task (cluster, i, j) lying together."""

    def run(batches):
        import pyarrow as pa

        shingle = resident(("shingles", width), lambda: Shingler(width))
        key, ids, blocks, sets = None, [], [], []

        def found():
            pairs = links(sets, blocks, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in pairs], pa.int64()), pa.array([ids[b] for _, b in pairs], pa.int64())], names=EDGES.names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for new, block, rep, text in zip(zip(part["cluster"], part["i"], part["j"], strict=True), part["block"], part["rep"], part["text"], strict=True):
                    if new != key:
                        yield found()
                        key, ids, blocks, sets = new, [], [], []
                    ids.append(rep)
                    blocks.append(block)
                    sets.append(shingle(text))
        yield found()

    dealt = members.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(run, EDGES)


def _with_roots(roots: DataFrame) -> DataFrame:
    """(rep, cluster) of every member, the roots included, from connected_components()."""
    clusters = roots.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    return written(clusters.unionByName(clusters.select(F.col("cluster").alias("rep"), "cluster").distinct()), "clusters")


def _split(clusters: DataFrame, own: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """(rep, cluster), those above one block split into what shared prefixes join; members that share none go.

    The shingles of members are put in one order, rare ones first. Sets with 100 * intersection >= percent * union have at
    least percent / 100 of either in common, so whichever of these comes first is among the first
    n - ceil(n * percent / 100) + 1 of both: every link joins two members that share such a shingle, however large the cluster."""
    large = written(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("cluster"), "large")
    if large.isEmpty():
        return clusters
    members = written(clusters.join(large, "cluster", "left_semi"), "members")
    ids = members.select(F.col("rep").alias("doc_id"))
    texts = likely_among(own, F.col("doc_id"), ids).join(members.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "cluster", "text").distinct()
    texts = written(texts, "members")

    def counted(batches):
        import pyarrow as pa

        shingle, counts = resident(("shingles", width), lambda: Shingler(width)), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(counts, (shingle(t) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    totals = written(texts.select("text").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")), "counters")
    counts = np.zeros(COUNTERS, np.int64)
    got = totals.toArrow()
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    sent = own.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches):
        import pyarrow as pa

        shingle, often = resident(("shingles", width), lambda: Shingler(width)), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256), []
                for t in part.column(2).to_pylist():
                    x = shingle(t)
                    x = x[np.argsort(often[(x % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")]
                    found.append(x[: len(x) - -(-len(x) * percent // 100) + 1].view(np.int64) if len(x) else np.zeros(0, np.int64))
                sizes = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(k).to_numpy(), sizes)) for k in (0, 1)] + [pa.array(np.concatenate(found))], names=["rep", "cluster", "x"])

    tokens = written(texts.select("rep", "cluster", "text").mapInArrow(prefixes, "rep long, cluster long, x long"), "prefixes")
    stars = tokens.groupBy("cluster", "x").agg(F.min("rep").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", "x", "u")
    edges = written(tokens.join(stars, ["cluster", "x"]).where("rep <> u").select("u", F.col("rep").alias("v")).distinct(), "stars")
    for t in (tokens, texts):
        dropped(t)
    finer = _with_roots(connected_components(edges))
    return written(clusters.join(large, "cluster", "left_anti").unionByName(finer), "clusters")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", halves: int = HALVES, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept.

    Texts without words have no shingles and no links. A row with a null id takes no part in links: its component_id
    is null and it is kept. An id is one document: rows that repeat it, with the same text or others, are linked with what any of
    them is linked with. An empty table gives an empty result; other columns are left out."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(shingle_sets(own, width, halves, rows), "sets")
    whole = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = written(whole.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "reps")
    clusters = connected_components(_candidates(reps, halves))
    clusters = _split(_with_roots(clusters), own, width, percent, block)
    # Texts that are in no cluster are left out where they are read.
    ids = clusters.select(F.col("rep").alias("doc_id"))
    texts = likely_among(own, F.col("doc_id"), ids).join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").distinct()
    tasks = in_blocks(clusters.select(F.col("rep").alias("node"), "cluster"), block).withColumnRenamed("node", "rep")
    members = texts.join(tasks, "rep").select("cluster", "i", "j", "block", "rep", "text")
    found = written(_confirmed(members, width, percent), "links")
    numbered = whole.select("doc_id", "set_hash", F.xxhash64("set_hash").alias("x"))
    again = written(numbered.groupBy("doc_id").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a <> b").select("doc_id"), "again")
    if not again.isEmpty():  # ids with several texts join the classes of these
        several = written(numbered.join(again, "doc_id", "left_semi").join(reps.select("set_hash", "rep"), "set_hash").select("doc_id", "rep").distinct(), "several")
        found = found.unionByName(several.join(several.groupBy("doc_id").agg(F.min("rep").alias("u")), "doc_id").select("u", F.col("rep").alias("v")))
    roots = connected_components(found)
    groups = reps.select("set_hash", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("root", "rep").alias("found"))
    out = sets.select("doc_id", "n_shingles", "set_hash").join(groups, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("found"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of linked ones, with all its columns."""
    gone = written(near_groups(docs, width, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__gone_id")).distinct(), "gone")
    own = marked(docs, F.col(id_col).cast("long"), gone, "__hit")
    # Only rows that the filter cannot tell from dropped ones are moved.
    hit = own.where("__hit")
    return own.where("NOT __hit").unionByName(hit.join(gone, hit[id_col].cast("long") == gone["__gone_id"], "left_anti")).select(*docs.columns)
