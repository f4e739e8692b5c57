"""Near-duplicate groups by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class from the start (by a 104-bit hash of
the set), so copies never meet again. Every independent tree branches the class representatives by
minwise tokens: a node's children are keyed by the node and by the minwise token of each of
``branch`` permutations picked for that level. Nodes of at most ``node_limit`` documents are compared
exhaustively, larger ones branch again, as long as that pays: a node whose children together hold
three quarters of its pairs or more has documents so much alike that it is compared exhaustively. A
pair at similarity s is lost by a tree only if all branches part it: (1 - s) ** branch at the first
level, 0.0034 at s = 0.85; by all ``trees`` trees 4e-8.

Exhaustive comparison is cut into blocks of ``block`` documents, dealt to tasks pair of blocks by
pair of blocks, so a large node is shared out. A first pass compares 256-byte sketches to drop
documents without any promising partner (and leaves a pair to the first small node that it
shares), a second confirms links on the full sets. Each task reports a spanning forest of its
links, never all pairs; groups are the connected components of those forests, found by
alternating star contractions in the shared storage.

Shingles are 64-bit hashes of their words, kept by document. Two of the n shingles of a pair share a
hash by chance with a probability of n * n / 2 ** 65, 3e-6 for ten million shingles.

Defined results: null or empty texts, or texts without words, have the empty set and are linked with
nothing; texts with fewer words than a shingle have their whole sequence as the one shingle; rows
that share an id are one document; a null id is linked with nothing and its component is
null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, U64, Hashes, chunks, mix, signed
from ._runtime import lean, written
from .rows import once

BINS = 256
#: Estimates below the threshold by this much (over 5 standard deviations of 256 bins) are dropped.
MARGIN = 0.13


def _sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, sorted distinct shingle hashes, bounds by row) for at most 4096 rows at a time."""
    for k in range(0, rows.num_rows, 4096):
        own = offsets[k : k + 4097]
        text = LOWER[data[own[0] : own[-1]]]
        words = Hashes(text, own - own[0])
        h = words.h
        n = len(h)
        shingle = np.zeros(max(0, n - width + 1), np.uint64)
        for j in range(width):
            shingle *= U64(0xD6E8FEB86659FD93)
            shingle += h[j : j + len(shingle)]
        inside = words.doc[: len(shingle)] == words.doc[width - 1 :] if len(shingle) else np.zeros(0, bool)
        doc, shingle = words.doc[: len(shingle)][inside], mix(shingle[inside])
        short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < width))
        if len(short):
            whole = []
            for d in short:
                value = U64(width)
                with np.errstate(over="ignore"):
                    for x in h[words.bounds[d] : words.bounds[d + 1]]:
                        value = value * U64(0xA0761D6478BD642F) + x
                whole.append(value)
            doc, shingle = np.concatenate([doc, short]), np.concatenate([shingle, mix(np.array(whole, np.uint64))])
        order = np.argsort(shingle)
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]  # by document, then by hash
        doc, shingle = doc[order], shingle[order]
        if len(doc):
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])])
            doc, shingle = doc[new], shingle[new]
        count = len(own) - 1
        yield rows.slice(k, count), shingle, np.searchsorted(doc, np.arange(count + 1))


def _seeds(first: int, permutations: int) -> np.ndarray:
    return mix(np.arange(first + 1, first + permutations + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def _minima(mixed: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minwise token of each set under each permutation; 0 for empty sets."""
    mins = np.zeros((len(bounds) - 1, len(seeds)), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        starts = bounds[:-1][some]
        for j, seed in enumerate(seeds):
            v = (mixed ^ seed) * U64(0xFF51AFD7ED558CCD)
            v ^= v >> U64(32)
            v *= U64(0xC4CEB9FE1A85EC53)
            mins[some, j] = np.minimum.reduceat(v, starts)
    return mins


def _lists(mins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1, dtype=np.int32) * mins.shape[1]), pa.array(signed(mins.ravel())))


def _more_minima(batches: Iterable[pa.RecordBatch], width: int, seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            for part, values, bounds in _sets(rows, data, offsets, width):
                sums, mixed = np.zeros(part.num_rows, np.uint64), mix(values + U64(1))
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    sums[some] = np.add.reduceat(mixed, bounds[:-1][some])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(sums)), _lists(_minima(mixed, bounds, seeds))], names=["doc", "set_a", "mins"])


def _signatures(batches: Iterable[pa.RecordBatch], width: int, permutations: int) -> Iterator[pa.RecordBatch]:
    seeds = _seeds(0, permutations)
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            for part, values, bounds in _sets(rows, data, offsets, width):
                n = part.num_rows
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                bins = np.full(n * BINS, U64((1 << 64) - 1))
                sums = np.zeros((2, n), np.uint64)
                mixed = mix(values + U64(1))
                if len(some):
                    starts = bounds[:-1][some]
                    sums[0, some] = np.add.reduceat(mixed, starts)
                    sums[1, some] = np.add.reduceat(mix(mixed), starts)
                    doc = np.repeat(np.arange(n), sizes)
                    np.minimum.at(bins, doc * BINS + (mixed & U64(BINS - 1)).astype(np.int64), mixed)
                sketch = np.where(bins == U64((1 << 64) - 1), 0, 1 + (bins >> U64(16)) % U64(255)).astype(np.uint8).reshape(n, BINS)
                lists = _lists(_minima(mixed, bounds, seeds))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(signed(sums[0])), pa.array(signed(sums[1])), lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "mins", "sketch"],
                )


def _full_sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            for part, values, bounds in _sets(rows, data, offsets, width):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc", "members"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal ``task`` (the first column), many at a time; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(task, task[-1]))  # where the open run begins
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(0)[-1].as_py() != task[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _run_bounds(task: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])), len(task))


def _pairs(bounds: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows of the same run, in lots of about ``most``."""
    sizes = np.diff(bounds)
    for size in np.unique(sizes):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        starts = bounds[:-1][sizes == size]
        step = max(1, most // len(i))
        for k in range(0, len(starts), step):
            a = (starts[k : k + step, None] + i).ravel()
            b = (starts[k : k + step, None] + j).ravel()
            for at in range(0, len(a), most):
                yield a[at : at + most], b[at : at + most]


def _promising(batches: Iterable[pa.RecordBatch], share: float, first: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, doc) that have a partner in their run worth confirming."""
    for table in _runs(batches):
        table = table.combine_chunks()
        task, doc, block, position, hot, size = (table[c].to_numpy() for c in ("task", "doc", "block", "position", "hot", "n_shingles"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        mins = table["mins"].combine_chunks().flatten().to_numpy().reshape(len(task), -1)[:, :first]
        cool = (hot[:, None] >> np.arange(first)) & 1 == 0
        earlier = cool & (np.arange(first) < position[:, None])
        lone = table["lone"].to_numpy(zero_copy_only=False)
        keep = np.zeros(len(task), bool)
        for a, b in _pairs(_run_bounds(task)):
            on = (lone[a] | (block[a] != block[b])) & (np.minimum(size[a], size[b]) >= share * np.maximum(size[a], size[b]) - 1e-9)
            a, b = a[on], b[on]
            on = ~((mins[a] == mins[b]) & earlier[a]).any(axis=1)
            a, b = a[on], b[on]
            x, y = sketch[a], sketch[b]
            same = ((x == y) & (x != 0)).sum(axis=1)
            used = ((x | y) != 0).sum(axis=1)
            on = same >= (share - MARGIN) * used
            keep[a[on]] = keep[b[on]] = True
        out = np.flatnonzero(keep)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(task[out]), pa.array(doc[out])], names=["task", "doc"])


def _links(batches: Iterable[pa.RecordBatch], over: int, under: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the confirmed links of each run: over * intersection >= under * union."""
    for table in _runs(batches):
        table = table.combine_chunks()
        docs, members = table["doc"].to_numpy(), table["members"].to_pylist()
        found: list[tuple[int, int]] = []
        bounds = _run_bounds(table["task"].to_numpy())
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            found += _forest(docs[begin:end], [np.frombuffer(m, np.uint64) for m in members[begin:end]], over, under)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(found, np.int64).T], names=["u", "v"])


def _forest(docs: np.ndarray, sets: list[np.ndarray], over: int, under: int) -> list[tuple[int, int]]:
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    docs, sizes = docs[order], sizes[order]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark = np.zeros(len(ids), np.int32)
    label = np.arange(len(docs))
    found: list[tuple[int, int]] = []
    for x in range(len(docs) - 1):
        if not sizes[x]:
            continue
        last = int(np.searchsorted(sizes, over * sizes[x] // under, "right"))
        if last <= x + 1 or (label[x + 1 : last] == label[x]).all():
            continue
        own = ids[bounds[x] : bounds[x + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids[bounds[x + 1] : bounds[last]]], bounds[x + 1 : last] - bounds[x + 1])
        mark[own] = 0
        linked = over * shared >= under * (sizes[x] + sizes[x + 1 : last] - shared)
        for y in (np.flatnonzero(linked) + x + 1).tolist():
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                found.append((int(docs[x]), int(docs[y])))
    return [f for f in found if f[0] != f[1]]


def _with_least(edges: DataFrame, n: int, of: DataFrame, limit: int) -> DataFrame:
    """``edges`` (u, v; n of them at most) with m of their u, from ``of`` (centre, m, degree).

    Centres of more than ``limit`` edges, or of a hundred-thousandth of all, are broadcast, at most
    200 000 of them, so that no task gets all edges of one.
    """
    limit = max(limit, n // 100_000)
    hot = of.where(F.col("degree") > limit)
    if hot.isEmpty():
        return edges.join(of.select("centre", "m"), F.col("u") == F.col("centre")).select("u", "v", "m")
    known = edges.join(F.broadcast(hot.select("centre", "m")), F.col("u") == F.col("centre"), "left")
    cold = of.where(F.col("degree") <= limit).select(F.col("centre").alias("cold"), F.col("m").alias("cold_m"))
    rest = known.where("centre is null").select("u", "v").join(cold, F.col("u") == F.col("cold")).select("u", "v", F.col("cold_m").alias("m"))
    return known.where("centre is not null").select("u", "v", "m").unionByName(rest)


def components(links: DataFrame, limit: int = 1000) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v): component is the smallest node reachable.

    Alternating large-star and small-star contractions: each round is two aggregations and two
    joins over the links, and the links shrink to stars in a logarithmic number of rounds. Edges of
    nodes with more than ``limit`` of them find their least neighbour by a broadcast.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy(F.col("u").alias("centre")).agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("centre", "m")), "least")
        large = written(_with_least(both.where("v > u"), now[0], least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = written(large.groupBy(F.col("u").alias("centre")).agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")
        small = _with_least(large, now[0], least, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select(F.col("centre").alias("u"), F.col("m").alias("v"))).distinct(), "links")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (4, 5),
    doc_id: str = "doc_id",
    text: str = "text",
    trees: int = 3,
    branch: int = 3,
    levels: int = 3,
    node_limit: int = 4096,
    block: int = 512,
    broadcast_limit: int = 500_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Linked are documents with intersection / union >= threshold (a fraction, as two integers) of
    their sets of ``width``-word shingles. ``broadcast_limit``: up to that many document ids are
    broadcast to pick texts to confirm; more are joined by a shuffle.
    """
    under, over = threshold
    first = trees * branch
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed_ = written(own.mapInArrow(lambda it: lean(_signatures(it, width, first * levels)), "doc_id long, n_shingles long, set_a long, set_b long, mins array<long>, sketch binary"), "signatures")
    ids = signed_.select("doc_id", "n_shingles", "set_a", "set_b")
    classes = ids.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("doc"))
    classes = written(classes, "classes")
    heads = signed_.join(classes.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "n_shingles", "set_a", "mins", "sketch")
    repeats = ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    heads = written(once(heads, repeats, "doc", "set_a").drop("set_a"), "heads")

    def children(parents: DataFrame, level: int) -> DataFrame:
        """Nodes of a level with two documents or more: node, tree, position, doc, size, and what their parent is."""
        at = level % levels * first + 1
        spread = parents.select("node", "tree", "parent_size", "doc", F.posexplode(F.slice("mins", F.col("tree") * branch + at, branch)).alias("way", "value"))
        spread = spread.select(F.xxhash64("node", "tree", "way", "value", F.lit(level)).alias("node"), "tree", (F.col("tree") * branch + F.col("way")).cast("int").alias("position"), "doc", F.col("node").alias("parent"), "parent_size")
        sizes = spread.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        return written(spread.join(sizes, "node"), "nodes")

    roots = heads.select(F.lit(0).cast("long").alias("node"), F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), F.lit(0).cast("long").alias("parent_size"), "doc", "mins")
    compared = ["node", "tree", "position", "doc", "size"]
    nodes = children(roots, 0).select(compared)
    large = nodes.where(F.col("size") > node_limit)
    hot = large.groupBy(F.col("doc").alias("hot_doc")).agg(F.expr("bit_or(shiftleft(1L, position))").alias("hot"))
    small = nodes.where(F.col("size") <= node_limit)
    level, mins = 0, heads.select("doc", "mins")
    while not large.isEmpty():
        level += 1
        if level % levels == 0:  # tokens of further permutations, for the documents that need them
            open_ = large.select("doc").distinct()
            again = own.join(open_, F.col("doc_id") == F.col("doc"), "left_semi").mapInArrow(lambda it, seeds=_seeds(level * first, levels * first): lean(_more_minima(it, width, seeds)), "doc long, set_a long, mins array<long>")
            mins = written(once(again, repeats, "doc", "set_a").drop("set_a"), "mins")
        nodes = children(large.select("node", "tree", F.col("size").alias("parent_size"), "doc").join(mins, "doc"), level).withColumn("position", F.lit(first))
        pairs = nodes.groupBy(F.col("parent").alias("alike")).agg(F.sum("size").alias("pairs"), F.max("parent_size").alias("of"))
        alike = written(pairs.where(F.col("pairs") >= 0.75 * F.col("of").cast("double") * F.col("of")).select("alike"), "alike")
        small = small.unionByName(large.join(alike, F.col("node") == F.col("alike"), "left_semi").withColumn("position", F.lit(first)))
        nodes = nodes.join(alike, F.col("parent") == F.col("alike"), "left_anti").select(compared)
        small = small.unionByName(nodes.where(F.col("size") <= node_limit))
        large = nodes.where(F.col("size") > node_limit)
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = small.select("node", "position", "doc", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("doc", "node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("node", "position", "doc", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = dealt.select(
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "doc", "block", "position", (F.col("block") == F.col("other")).alias("own")
    )
    described = tasks.join(heads.join(hot, F.col("doc") == F.col("hot_doc"), "left").select("doc", "n_shingles", "mins", "sketch", F.coalesce("hot", F.lit(0)).alias("hot")), "doc")
    described = described.select("task", "doc", "block", "position", "hot", "n_shingles", "mins", "sketch", F.col("own").alias("lone"))
    share = under / over
    promising = described.repartition("task").sortWithinPartitions("task").mapInArrow(lambda it: lean(_promising(it, share, first)), "task long, doc long")
    promising = written(promising, "promising")
    wanted = promising.select("doc").distinct()
    if wanted.count() <= broadcast_limit:
        wanted = F.broadcast(wanted)
    texts = own.join(wanted, F.col("doc_id") == F.col("doc"), "left_semi").mapInArrow(lambda it: lean(_full_sets(it, width)), "doc long, members binary")
    confirmed = promising.join(texts, "doc").select("task", "doc", "members").repartition("task").sortWithinPartitions("task")
    groups = components(confirmed.mapInArrow(lambda it: lean(_links(it, over, under)), "u long, v long"))
    named = classes.join(groups, F.col("doc") == F.col("node"), "left").select("n_shingles", "set_a", "set_b", F.coalesce("component", "doc").alias("component"))
    component = F.coalesce("component", "doc_id")
    linked = ids.join(named, ["n_shingles", "set_a", "set_b"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return linked.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
