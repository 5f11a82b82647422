"""MinHash near-dedup over an LSH forest.

TREES sorted orders of DEPTH minima each. In every order a document's candidates are its longest-common-prefix
neighbours: sorting puts the deepest shared prefixes next to each other, so the depth that counts adapts to how dense
a region is. A first round confirms a spanning forest of the most similar neighbours on full shingle sets. A second
looks at every pair of one region (documents that share the first LEAST minima of a tree) that still lies in different
components, so the neighbour window is no cap: regions are compared in bounded blocks, only against their minority
components, and the blocks test the sets themselves, so no table of pairs arises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import U64, discard, join_hot, mix, partitions, ship, shingle_sets, stage, whole_runs
from strata.llm.components import components

TREES, DEPTH, LEAST = 16, 16, 4
#: Sorted neighbours that the first round looks at on each side.
WINDOW = 48
#: Rows of the two sides of a block in the second round.
PROBES, BLOCK = 256, 2048
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 4.5
#: Rows of whole regions that a task of the first round holds at once, about.
RUN = 16_384

_N = TREES * DEPTH
_A = (mix(np.arange(1, _N + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, _N + 1001, dtype=U64)) >> U64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of a shingle set, cut to 16 bits."""
    least = np.full(_N, 0xFFFFFFFF, np.uint32)
    x = (hashes >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        h = _A[:, None] * x[None, i : i + 1024] + _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _fingerprint(s: np.ndarray) -> int:
    return int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64))


def _documents(batches):
    for batch in batches:
        ids, n, f1, f2, sig = batch.column(0), [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            f1.append(_fingerprint(s))
            f2.append(int(np.bitwise_xor.reduce(mix(s + U64(0x14057B7EF767814F)), initial=U64(0)).view(np.int64)))
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())],
            ["doc_id", "n_shingles", "f1", "f2", "sig"],
        )


def _region_keys(batches):
    """(doc, sig) -> (region, doc): a region is the hash of a tree and its first LEAST minima."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(_regions(sig).ravel())], ["doc", "region"]
        )


def _regions(sig: np.ndarray) -> np.ndarray:
    h = np.zeros(sig.shape[:2], U64) + np.arange(TREES, dtype=U64) * U64(0xD1342543DE82EF95)
    for k in range(LEAST):
        h = mix(h + sig[:, :, k].astype(U64) + U64(1))
    return h.view(np.int64)


def _tree_rows(batches):
    """(doc, f1, sig) -> a row for each tree: (region, key, doc, f1, tree, sketch, high); the sketch holds the low byte of every
    minimum, high the other byte of those that make regions."""
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
        keys = sig.astype(">u2").tobytes()
        sketch = sig.astype(np.uint8).tobytes()
        high = (sig[:, :, :LEAST] >> 8).astype(np.uint8).tobytes()
        w, v = DEPTH * 2, TREES * LEAST
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(_regions(sig).ravel()),
                pa.array([keys[i : i + w] for i in range(0, len(keys), w)], pa.binary()),
                pa.array(np.repeat(batch.column(0).to_numpy(), TREES)),
                pa.array(np.repeat(batch.column(1).to_numpy(), TREES)),
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                pa.array([sketch[i * _N : (i + 1) * _N] for i in range(n) for _ in range(TREES)], pa.binary()),
                pa.array([high[i * v : (i + 1) * v] for i in range(n) for _ in range(TREES)], pa.binary()),
            ],
            ["region", "key", "doc", "f1", "tree", "sketch", "high"],
        )


def _near(region: np.ndarray, sketch: np.ndarray, least: float, reach: int, ok=None):
    """Index pairs of one region at most reach rows apart whose estimated similarity is at least `least`."""
    n = len(region)
    cut = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
    left = np.repeat(cut[1:], np.diff(cut)) - np.arange(n) - 1  # rows of the region that follow
    rows, found = np.arange(n), []
    for step in range(1, reach + 1):
        rows = rows[left[rows] >= step]
        if not len(rows):
            break
        a = rows
        b = rows + step
        if ok is not None:
            keep = ok(a, b)
            a, b = a[keep], b[keep]
        for i in range(0, len(a), 8192):
            x, y = a[i : i + 8192], b[i : i + 8192]
            est = (sketch[x] == sketch[y]).sum(axis=1, dtype=np.int32)
            hit = est >= least * _N
            if hit.any():
                found.append((x[hit], y[hit], est[hit]))
    if not found:
        return [np.zeros(0, np.int64)] * 3
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Boruvka's maximum spanning forest; ties go by the pair, so all partitions keep the same links."""
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, -weight))] = np.arange(len(a))
    at = np.argsort(rank)
    comp, kept = np.arange(n), []
    while True:
        live = comp[a] != comp[b]
        a, b, rank = a[live], b[live], rank[live]
        if not len(a):
            return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        best = np.full(n, len(at), np.int64)
        np.minimum.at(best, comp[a], rank)
        np.minimum.at(best, comp[b], rank)
        chosen = np.unique(best[best < len(at)])
        pick = np.isin(rank, chosen)
        kept.append(at[chosen])
        x, y = comp[a[pick]], comp[b[pick]]
        root = np.arange(n)
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if (root == before).all():
                break
        comp = root[comp]


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, _N)


def _neighbour_links(least: float):
    """Rows sorted by region: a spanning forest of the near neighbours of every run of regions."""

    def run(batches):
        for t in whole_runs(batches, "region", RUN):
            docs, node = np.unique(t.column("doc").to_numpy(), return_inverse=True)
            a, b, est = _near(t.column("region").to_numpy(), _sketches(t), least, WINDOW)
            x, y = node[np.minimum(a, b)], node[np.maximum(a, b)]
            x, y = np.minimum(x, y), np.maximum(x, y)
            live = x != y
            x, y, est = x[live], y[live], est[live]
            if len(x):
                _, first = np.unique(x * len(docs) + y, return_index=True)
                x, y, est = x[first], y[first], est[first]
                keep = _forest(x, y, est, len(docs))
                yield pa.RecordBatch.from_arrays([pa.array(docs[x[keep]]), pa.array(docs[y[keep]])], ["a", "b"])

    return run


def _seen_before(sketch: np.ndarray, high: np.ndarray, tree: np.ndarray):
    """Whether two rows of one tree share the region of an earlier tree too, where the pair is looked at already: all 16
    bits of the minima that make the region are compared."""
    low = sketch.reshape(-1, TREES, DEPTH)[:, :, :LEAST]
    heads = np.concatenate([low, high.reshape(-1, TREES, LEAST)], axis=2).view(U64)[:, :, 0]
    return lambda i, j: ((heads[i] == heads[j]) & (np.arange(TREES) < tree[i][:, None])).any(axis=1)


def _cross(least: float, percent: int | None):
    """Rows sorted by block, probes first: the pairs of a probe with any row of another component.

    Without percent the documents of pairs whose estimate reaches `least`; with it a spanning forest of the pairs
    that the exact test on their full sets confirms. Either way the output grows with the rows, not with the pairs."""

    def run(batches):
        for t in whole_runs(batches, "block", 1):
            block, comp, doc, tree = (t.column(c).to_numpy() for c in ("block", "comp", "doc", "tree"))
            probe, sketch = t.column("probe").to_numpy(), _sketches(t)
            high = np.frombuffer(b"".join(t.column("high").to_pylist()), np.uint8)
            seen = _seen_before(sketch, high, tree)
            # Rows of different trees never share a block, but for a collision of its hash: compare the trees too.
            ok = lambda i, j: (probe[i] | probe[j]) & (comp[i] != comp[j]) & (tree[i] == tree[j]) & ~seen(i, j)  # noqa: B023, E731
            a, b, _ = _near(block, sketch, least, len(block), ok)
            if percent is None:
                found = np.unique(np.concatenate([doc[a], doc[b]]))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found)], ["doc"])
                continue
            sets = t.column("set").chunk(0)
            own = [np.frombuffer(sets[int(i)].as_buffer(), U64) for i in range(len(doc))]
            same = np.array([_linked(own[i], own[j], percent) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
            if same.any():
                docs, node = np.unique(doc, return_inverse=True)
                x, y = node[a[same]], node[b[same]]
                keep = _forest(np.minimum(x, y), np.maximum(x, y), np.ones(len(x)), len(docs))
                yield pa.RecordBatch.from_arrays([pa.array(docs[x[keep]]), pa.array(docs[y[keep]])], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    both = int((long[at] == short).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _set_rows(batches):
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        prints = pa.array([_fingerprint(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "f1", "set"])


def _confirm(percent: int):
    """(a, b, sa, sb) -> (a, b, linked): the exact test on the full sets of hashes."""

    def run(batches):
        for batch in batches:
            linked = [
                _linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), a row for each input row.

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of distinct 5-word shingles (hashed to
    64 bits); component_id is the least doc_id reachable over links. Null, empty and wordless texts have no shingles
    and stand alone; texts of one to four words are one shingle. Equal sets are grouped before any pair is looked at,
    however many copies there are. Rows that repeat a doc_id share its component; a null doc_id stands alone with a
    null component and is kept. Other columns of docs are ignored. Pairs are searched among documents that share the
    first LEAST minima of a tree: a pair at 0.85 shares none with a probability of about 7e-6, one at 0.8 of 2.2e-4.
    """
    spark = docs.sparkSession
    ship(spark)
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / _N) ** 0.5
    found = stage(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _documents, "doc_id long, n_shingles long, f1 long, f2 long, sig binary"
        ),
        "signatures",
    )
    key = ["f1", "f2", "n_shingles"]
    usable = found.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Equal sets are one: their least doc_id stands for all. Links and components are those of the sets alone.
    first = stage(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")), "sets-by-print")
    total = found.count()
    reps = usable.join(first.select(*key, F.col("rep").alias("doc_id")), ["doc_id", *key], "left_semi")
    reps = reps.select(F.col("doc_id").alias("doc"), "f1", "sig").dropDuplicates(["doc", "f1"])
    # A doc_id that repeats with different texts links their sets.
    several = usable.groupBy("doc_id").agg((F.min(F.struct(*key)) != F.max(F.struct(*key))).alias("differ")).where("differ").select("doc_id")
    same = usable.join(several, "doc_id", "left_semi").join(first, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    keys = reps.select("doc", "sig").mapInArrow(_region_keys, "doc long, region long")
    shared = keys.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    active = keys.join(shared, "region", "left_semi").select("doc").distinct()
    trees = stage(
        reps.join(active, "doc", "left_semi").mapInArrow(_tree_rows, "region long, key binary, doc long, f1 long, tree int, sketch binary, high binary"), "trees"
    )
    active = trees.select("doc").distinct()
    sets = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
        .join(active, "doc", "left_semi")
        .mapInArrow(_set_rows, "doc long, f1 long, set binary"),
        "sets",
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        sa = sets.select(F.col("doc").alias("a"), F.col("set").alias("sa"))
        sb = sets.select(F.col("doc").alias("b"), F.col("set").alias("sb"))
        rows = pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")
        return stage(rows.mapInArrow(_confirm(percent), "a long, b long, linked boolean"), "links")

    n = partitions(spark)
    ordered = trees.select("region", "key", "doc", "sketch").repartitionByRange(n, "region", "key", "doc").sortWithinPartitions("region", "key", "doc")
    tested = confirmed(ordered.mapInArrow(_neighbour_links(least), "a long, b long").distinct())
    links = same.union(tested.where("linked").select("a", "b"))
    comp = stage(components(links), "components")
    # Documents with a likely partner in another component, then the exact test among these alone.
    open_docs = stage(_blocks(trees, comp).mapInArrow(_cross(least, None), "doc long").distinct(), "open")
    if not open_docs.isEmpty():
        few = stage(trees.join(open_docs, "doc", "left_semi"), "few")
        more = stage(_blocks(few, comp, sets).mapInArrow(_cross(least, percent), "a long, b long"), "more")
        if not more.isEmpty():
            comp = stage(components(comp.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(more)), "components")
    least_of = first.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "_n", F.coalesce("component_id", "rep").alias("component_id"))
    out = join_hot(usable.select("doc_id", *key), least_of, key, total)
    alone = found.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", *key, F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def _blocks(trees: DataFrame, comp: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The rows of every region with several components, dealt into blocks of about PROBES probes (rows outside the
    region's largest component) and BLOCK rows; with sets their shingle sets too. The regions are staged and a row gets
    all its places at once, so the plan reads trees for one join, however the rows are dealt."""
    n = partitions(trees.sparkSession)
    named = lambda rows: rows.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component_id", "doc"))
    sizes = named(trees.select("region", "doc")).groupBy("region", "comp").agg(F.count("*").alias("n"))
    regions = stage(
        sizes.groupBy("region")
        .agg(F.sum("n").alias("size"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"))
        .where("size > most")
        .withColumn("blocks", F.ceil((F.col("size") - F.col("most")) / PROBES).cast("long"))
        .withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("long"))
        .withColumn("_n", F.col("size")),
        "regions",
    )
    rows = named(join_hot(trees, regions, ["region"], trees.count())).withColumn("minor", F.col("comp") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks"))).withColumn("part", F.pmod(F.xxhash64("doc", F.lit(2)), F.col("parts")))
    every = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cells = ["tree", "comp", "doc", "sketch", "high"]
    if sets is not None:
        rows = rows.join(sets.dropDuplicates(["doc", "f1"]), ["doc", "f1"])
        cells.append("set")
    place = lambda probe, i, j: F.struct(F.lit(probe).alias("probe"), i.alias("i"), j.alias("j"))
    probes = F.transform(every("parts"), lambda j: place(True, F.col("own"), j))
    # A row meets the probes of every block; where it is a probe of that very cell it is there already.
    others = F.transform(F.filter(every("blocks"), lambda i: ~F.col("minor") | (i != F.col("own"))), lambda i: place(False, i, F.col("part")))
    places = F.when(F.col("minor"), F.concat(probes, others)).otherwise(others)
    blocks = rows.select("region", *cells, F.explode(places).alias("at")).select(*cells, "at.probe", F.xxhash64("region", "at.i", "at.j").alias("block"))
    return blocks.repartition(n, "block").sortWithinPartitions("block", F.desc("probe"))
