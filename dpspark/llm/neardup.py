"""Near-duplicates: MinHash signatures, joined within a Hamming distance by a multi-index.

A text's signature is ``SLOTS`` minima of 16 bits each. The first 60 are split
into 12 chunks of 5. Two signatures at a distance of at most 23 of those 60
differ in one slot at most in some chunk (pigeonhole), so every chunk is indexed
five times, each time with another slot left out: all such pairs meet under some
key. At a Jaccard similarity of 0.8 a pair has no such chunk once in 10 million.

Pairs that meet are held against the distance over all slots and then against
the full sets. To keep hot keys cheap, only pairs that can still join two
components are looked at: first each key's members against one centre, a few
times with other centres, then all that is left of a key across components. Of
small keys these are plain pairs. Of large ones, members go that share none of
their rarest shingles with another (prefix filter); the others are dealt into
blocks, and a task holds two blocks against each other and returns links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, text_rows, written
from dpspark.llm.words import chunks, mix, runs, words

SHINGLE = 5
SIMILARITY = 80
SLOTS, CHUNKS, WIDTH = 96, 12, 5
#: Slots in which a pair may differ. Of 96, a pair of similarity 0.8 differs in 19, and in more than 41 once in 10 million.
DISTANCE = 41
STARS = 3
#: Keys with more members than FEW are worked off in blocks of about BLOCK.
FEW, BLOCK = 16, 512
#: Counters of shingles in large keys, as a power of two.
COUNTERS = 18
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(8)
_MUL = _rng.integers(0, 1 << 32, (SLOTS, 1), np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, (SLOTS, 1), np.uint32)
_KEYS = _rng.integers(0, 1 << 63, (CHUNKS, WIDTH), np.uint64)


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted; fewer words than ``size`` are one shingle."""
    w = words(batch["text"])
    hashes, at = runs(w.hash, w.first, size)
    cut = np.searchsorted(at, w.first)
    for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        n = w.first[i + 1] - w.first[i]
        if 0 < n < size:
            yield runs(w.hash[w.first[i] : w.first[i + 1]], np.array([0, n]), int(n))[0] ^ np.uint64(n)
        else:
            yield np.unique(hashes[a:b])


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(small), 1 << 14):
        least = np.minimum(least, (small[None, i : i + (1 << 14)] * _MUL + _ADD).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for s in shingle_sets(part, size):
                    rows.append((len(s), int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)), signature(s).tobytes() if len(s) else b""))
                n, a, b, sig = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of a signature's 60 keys."""
    for batch in batches:
        for i in range(0, len(batch), 4096):
            part = batch.slice(i, 4096)
            sig = np.frombuffer(b"".join(part["sig"].to_pylist()), "<u2").reshape(len(part), SLOTS)
            node = np.repeat(part["node"].to_numpy(zero_copy_only=False), CHUNKS * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(_keys_of(sig).reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = [s.view(np.int64) for s in shingle_sets(part, size)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    return run


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are close enough."""
    for batch in batches:
        if len(batch):
            u, v = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("sig_u", "sig_v"))
            yield batch.filter(pa.array((u != v).sum(axis=1) <= DISTANCE)).select(["u", "v"])


def _keys_of(sig: np.ndarray) -> np.ndarray:
    """(signatures x 60) keys, the same ones as in the index."""
    sig = sig[:, : CHUNKS * WIDTH].reshape(-1, CHUNKS, WIDTH)
    keys = [mix(np.ascontiguousarray(np.delete(sig, e, 2)).view(np.uint64)[:, :, 0] + _KEYS[:, e]) for e in range(WIDTH)]
    return np.stack(keys, 1).reshape(len(sig), -1)


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every one of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    every, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    twice = np.bincount(at) > 1
    column = np.cumsum(twice) - 1
    side = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    side, at = side[twice[at]], column[at[twice[at]]]
    order = np.argsort(at, kind="stable")
    side, at = side[order], at[order]
    for low in range(0, int(twice.sum()), 4096):
        i, j = np.searchsorted(at, [low, low + 4096])
        grid = np.zeros((len(a) + len(b), 4096), np.float32)
        grid[side[i:j], at[i:j] - low] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out


def _block_links(similarity: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between two blocks that join components; of links that join the same ones, the first."""
        table = table.combine_chunks()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, SLOTS)
        node, label, n, block = (table[c].to_numpy() for c in ("node", "label", "n", "block"))
        sets = [x.values.to_numpy(zero_copy_only=False) for x in table["shingles"]]
        keys, parent, u, v = _keys_of(sig), {}, [], []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        one, other = np.flatnonzero(block == table["one"][0].as_py()), np.flatnonzero(block == table["other"][0].as_py())
        for lo in range(0, len(one), 64):
            rows = one[lo : lo + 64]
            maybe = (label[rows][:, None] != label[other]) & (np.minimum(n[rows][:, None], n[other]) * 100 >= np.maximum(n[rows][:, None], n[other]) * similarity)
            i, j = np.nonzero(maybe)
            i, j = rows[i], other[j]
            near = (sig[i] != sig[j]).sum(axis=1) <= DISTANCE
            i, j = i[near], j[near]
            met = (keys[i] == keys[j]).any(axis=1)
            i, j = i[met], j[met]
            if len(i):
                left, x = np.unique(i, return_inverse=True)
                right, y = np.unique(j, return_inverse=True)
                both = _common([sets[k] for k in left], [sets[k] for k in right])[x, y]
                for a, b in zip(i[linked := both * 100 >= (n[i] + n[j] - both) * similarity], j[linked], strict=True):
                    if root(int(label[a])) != root(int(label[b])):
                        parent[root(int(label[a]))] = root(int(label[b]))
                        u.append(int(node[a]))
                        v.append(int(node[b]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _star_edges(left: DataFrame, folder: str) -> DataFrame:
    """Edges (a, b) over which nodes that share a key reach each other: one for each node, to the smallest of its keys' first nodes, and from there to the others."""
    first = left.groupBy("key").agg(F.min("node").alias("first"))
    met = written(left.join(first, "key").select("node", "first").distinct(), folder, "met")
    least = met.groupBy("node").agg(F.min("first").alias("a"))
    between = met.join(least, "node").select("a", F.col("first").alias("b"))
    return between.union(least.select("a", F.col("node").alias("b"))).where("a <> b").distinct()


def _slots(group: np.ndarray, sets: list[np.ndarray], bits: int) -> np.ndarray:
    """For each shingle of each set the counter that it has together with others of all groups."""
    of = np.repeat(mix(group.astype(np.uint64)), [len(s) for s in sets])
    return (mix(np.concatenate(sets).view(np.uint64) ^ of) >> np.uint64(64 - bits)).astype(np.int64)


def _sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch["group"].to_numpy(zero_copy_only=False), [x.values.to_numpy(zero_copy_only=False) for x in batch["shingles"]]


def _counted(bits: int):
    """What a task's sets add to the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_slots(*_sets_of(batch), bits), minlength=len(total))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    return run


def _prefixes(often, bits: int, similarity: int):
    """Each set's rarest shingles, without those that no other set can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            group, sets = _sets_of(batch)
            n = often.value[_slots(group, sets, bits)]
            out, ends = [], np.cumsum([0, *map(len, sets)])
            for s, a, b in zip(sets, ends, ends[1:], strict=False):
                order = np.lexsort((s, n[a:b]))[: len(s) + (-len(s) * similarity // 100) + 1]
                out.append(s[order[n[a:b][order] > 1]])
            size = [len(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(group, size)), pa.array(np.repeat(batch["node"].to_numpy(zero_copy_only=False), size)), pa.array(np.concatenate(out))], names=["group", "node", "shingle"])

    return run


def _with_rare_shingle(dealt: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of the nodes (group, node), those that can be similar to another one of their group.

    Of similar sets at least one shingle is among both sets' first n - least + 1
    ones, in any order of all shingles, where least is the overlap that n needs.
    So a node goes whose first shingles no other node has among its own. Rare
    ones come first, by counters of which a fixed number is shared by all
    shingles: that a counter is shared makes the order worse, not wrong.
    """
    every = dealt.select("group", "node").join(sets, "node").select("group", "node", "shingles")
    found = every.mapInArrow(_counted(COUNTERS), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(1 << COUNTERS, np.int64)
    often[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    rarest = every.mapInArrow(_prefixes(dealt.sparkSession.sparkContext.broadcast(often), COUNTERS, similarity), "group long, node long, shingle long")
    again = rarest.groupBy("group", "shingle").agg(F.count("*").alias("often")).where("often > 1").select("group", "shingle")
    return rarest.join(again, ["group", "shingle"], "left_semi").select("group", "node").distinct()


def _in_blocks(left: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int, folder: str) -> DataFrame:
    """Links across components among nodes that share a large key. left: (key, node, label)."""
    group = components(_star_edges(left, folder), f"{folder}/groups").select("node", F.col("label").alias("group"))
    group = written(group, folder, "group")
    group = written(_with_rare_shingle(group, sets, similarity), folder, "rare")
    size = group.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = group.join(size, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(left.select("node", "label").distinct(), "node").join(nodes, "node").join(sets, "node")
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block", "node", "label", "n", "sig", "shingles")
    return written(dealt.groupBy("group", "one", "other").applyInArrow(_block_links(similarity), "u long, v long"), folder, "blocks")


def among(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids``: broadcast if these are few, else shuffled."""
    ids = ids.withColumnRenamed(name, key)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), folder, "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), folder, "labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # a label's own label is a shortcut; one label may be that of very many nodes
        far = labels.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("label"), F.col("label").alias("far"))
        far = written(far, folder, f"far{step}")
        far = F.broadcast(far) if far.count() <= BROADCAST_IDS else far
        new = labels.join(near, "node").join(far, "label").select("node", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        new = written(new, folder, f"labels{step}")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def _linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int, folder: str, name: str) -> DataFrame:
    """The pairs (u, v) whose full sets are similar."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    close = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * similarity)
    close = written(close.select("u", "v", "sig_u", "sig_v").mapInArrow(_differing, "u long, v long"), folder, f"close{name}")
    held = lambda c: sets.join(close.select(F.col(c).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    met = close.join(held("v"), "v").join(held("u"), "u")
    both = F.size(F.array_intersect("set_u", "set_v"))
    return written(met.where(both * 100 >= (F.size("set_u") + F.size("set_v") - both) * similarity).select("u", "v"), folder, f"links{name}")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, with A-Z in lower case; a
    document's set holds its distinct shingles of ``shingle`` words. Documents
    are linked whose sets' Jaccard similarity is at least ``similarity`` per
    cent, confirmed on the full sets. One row per row of ``docs``: doc_id,
    n_shingles, component_id (the smallest doc_id reachable over links, its own
    included), kept (doc_id = component_id).

    Fewer words than ``shingle`` are one shingle. Null, empty and blank texts
    have an empty set and are linked with nothing. Rows that share a doc_id are
    one node if it is the smallest of equal sets. A null doc_id is linked with
    nothing and kept. Other columns are ignored; an empty table gives no row.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = text_rows(docs)
    sketched = written(rows.mapInArrow(_sketched(shingle), "doc_id long, n_shingles long, set_a long, set_b long, sig binary"), folder, "sketched")
    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one node: the smallest of their ids
    nodes = written(known.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")).select("node", F.col("n_shingles").alias("n"), "set_a", "set_b", "sig"), folder, "nodes")
    index = nodes.select("node", "sig").mapInArrow(_indexed, "key long, node long")
    shared = index.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = written(index.join(shared, "key"), folder, "members")
    inner = members.select("node").distinct()
    sets = written(among(rows, inner, "doc_id", "node").mapInArrow(_sets(shingle), "node long, shingles array<long>"), folder, "sets")
    sketch = nodes.select("node", "n", "sig")
    labels = written(inner.select("node", F.col("node").alias("label")), folder, "alone")
    for turn in range(STARS + 1):
        at = f"{folder}/{turn}"
        met = members.join(labels, "node")
        rank = F.xxhash64("node", F.lit(turn))
        keys = met.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(rank.alias("rank"), F.col("node").alias("centre"), F.col("label").alias("own"))).alias("c")).where("lo < hi")
        if turn < STARS:
            pairs = met.join(keys.select("key", "c.centre", "c.own"), "key").where("label <> own").select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v"))
        else:
            left = written(met.join(keys.select("key", "size"), "key"), at, "left")
            few, many = left.where(f"size <= {FEW}"), left.where(f"size > {FEW}").drop("size")
            pairs = few.alias("x").join(few.alias("y"), "key").where("x.node < y.node AND x.label <> y.label").select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
        links = _linked(pairs.distinct(), sketch, sets, similarity, at, "")
        if turn == STARS:
            links = links.unionByName(_in_blocks(many, sketch, sets, similarity, at))
        elif links.isEmpty():
            if keys.isEmpty():
                break
            continue
        by = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        edges = links.join(by("u"), "u").join(by("v"), "v").select(F.col("label_u").alias("a"), F.col("label_v").alias("b"))
        moved = components(edges, at).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), at, "labels")
    of = nodes.select("set_a", "set_b", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    found = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(of, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id")).alias("component_id")
    return found.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
