"""MinHash near-deduplication by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles (words: runs without 20 and 09-0D, A-Z lower-cased; a shorter document
is one shingle, its whole word sequence; no words: the empty set, linked with nothing). Documents are linked if
intersection / union >= ``threshold``, confirmed on full sets.

1. Equal sets collapse to their smallest doc_id. Each remaining document has ``width`` minwise values.
2. Chosen-path trees over the first ``kept`` values. A node chooses tokens (minwise values at a position) by its own hash, one
   or two with expectation 1 / threshold, and a document goes to the child named by the chosen token's value. All documents
   of a node choose alike, so a linked pair meets in at least one child on average at every level. ``trees`` independent trees
   bring recall to its target.
3. A node of at most ``small`` documents is compared exhaustively on sketches (one bit of each minwise value, and the sets'
   sizes). A pair is likely unless its sketches agree five standard deviations less than a pair at the threshold would. What
   likely pairs connect within a node is a bundle; bundles of the same documents count once.
4. The documents of a bundle bring their full sets together in one task, where all intersections are counted exactly. Linked
   documents contract to components. The first tree's bundles go first; of the other trees only those that still hold
   two components are compared, as pairs within a component can't change the result.
5. A node of more documents is dealt into blocks, each with the node's leader (one document) beside it, and blocks are compared
   like small nodes: a large group of near copies contracts through its leaders. Where few of a large node's documents are
   left outside its largest component, blocks of that component meet all of them, and the node is done. The others split into
   children, level by level, until no node is both large and mixed: nothing is dropped, and rows grow by 1 / threshold a
   level only for such nodes.

Defined cases: null or empty text has the empty set; rows that share a doc_id and differ in text take part each and are
reported each, as one document for components; a null doc_id is reported with a null component and kept as false; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, byte_class, hashed_words, mix64, release, row_blocks, staged, utf8_views

_rng = np.random.default_rng(7)
_STEP = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, _, _, rows = hashed_words(data, offsets, byte_class("nonspace"))
    n = len(words)
    grams = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        grams += words[k : n - size + 1 + k] * _STEP[k] if n >= size else grams
    grams = mix64(grams)
    out = []
    for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if j - i >= size:
            own = np.sort(grams[i : j - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif j > i:
            out.append(mix64(np.array([(words[i:j] * _STEP[: j - i]).sum() + np.uint64(j - i)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(width: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 31, width, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(own: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minwise 32-bit values of a set, one for each multiplier."""
    h = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):  # blocks that stay in cache
        x = h[i : i + 512, None] * multipliers[None, :]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _profile(size: int, width: int, kept: int):
    """mapInArrow: set size, set fingerprint, one-bit sketch of all and the first ``kept`` minwise values."""
    multipliers = _multipliers(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_views(batch.column("text"))
            for i, j in row_blocks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                sig = np.stack([signature(own, multipliers) for own in sets])
                sketch = np.packbits(((sig >> np.uint32(7)) & np.uint32(1)).astype(np.uint8), axis=1)
                f1 = np.array([mix64(own).sum() for own in sets], np.uint64)
                f2 = np.array([mix64(own * _STEP[9]).sum() for own in sets], np.uint64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "n": pa.array([len(own) for own in sets], pa.int64()),
                        "f1": pa.array(f1.view(np.int64)),
                        "f2": pa.array(f2.view(np.int64)),
                        "sketch": pa.array([row.tobytes() for row in sketch], pa.binary()),
                        "sig": pa.array([row[:kept].tobytes() for row in sig], pa.binary()),
                    }
                )

    return run


def _sets(size: int):
    """mapInArrow: texts become sets, arrays of longs; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_views(batch.column("text"))
            for i, j in row_blocks(offsets, 4 << 20):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                out = {c: batch.column(c).slice(i, j - i) for c in batch.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(out | {"shingles": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))})

    return run


def _children(kept: int, trees: int, twice: float, deeper: bool):
    """mapInArrow: the child nodes (node, doc_id, tree) of each row; at the root, of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, kept)
            rows = np.arange(batch.num_rows)
            if deeper:
                parent, row, tree = batch.column("node").to_numpy().view(np.uint64), rows, batch.column("tree").to_numpy()
            else:
                parent = np.tile(mix64(np.arange(1, trees + 1, dtype=np.uint64) * _STEP[3]), batch.num_rows)
                row, tree = np.repeat(rows, trees), np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)
            nodes, owners, origins = [], [], []
            for branch in range(2):
                h = mix64(parent + _STEP[4 + branch])
                chosen = np.ones(len(row), bool) if branch == 0 else (h >> np.uint64(40)).astype(np.float64) < twice * (1 << 24)
                position = (h[chosen] % np.uint64(kept)).astype(np.int64)
                value = sig[row[chosen], position].astype(np.uint64)
                nodes.append(mix64(mix64(parent[chosen] + _STEP[6] * (position.astype(np.uint64) + np.uint64(1))) + value * _STEP[7]))
                owners.append(row[chosen])
                origins.append(tree[chosen])
            out = {"node": pa.array(np.concatenate(nodes).view(np.int64)), "doc_id": batch.column("doc_id").take(pa.array(np.concatenate(owners)))}
            yield pa.RecordBatch.from_pydict(out | {"tree": pa.array(np.concatenate(origins).astype(np.int32))})

    return run


def _dealt(rows: DataFrame, nodes: DataFrame, copied: DataFrame, n: Column) -> DataFrame:
    """(node, doc_id, tree): nodes cut into ``n`` blocks: each of ``rows`` goes to one block of its node by hash, each of ``copied``
    to every block. ``nodes`` has what ``n`` needs."""
    own = rows.join(nodes.hint("merge"), "node").select(F.xxhash64("node", F.pmod(F.xxhash64("doc_id"), n.cast("long"))).alias("node"), "doc_id", "tree")
    every = copied.join(nodes.hint("merge"), "node").select("node", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("block"), "doc_id", "tree")
    return own.unionAll(every.select(F.xxhash64("node", "block").alias("node"), "doc_id", "tree"))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of 0 .. n-1 by the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _by_group(key: str, links: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], result: Callable[[pa.Table, np.ndarray], dict[str, pa.Array]]):
    """mapInArrow over rows that are sorted by ``key`` and not split: calls ``links(rows, starts of groups)`` and gives
    ``result(rows, smallest row connected with each row)``."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        own = rows.column(key).to_numpy()
        i, j = links(rows, np.flatnonzero(np.append(True, own[1:] != own[:-1])))
        return pa.RecordBatch.from_pydict(result(rows, _roots(len(own), i, j)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            own = rows.column(key).to_numpy()
            whole = int(np.flatnonzero(own != own[-1])[-1]) + 1 if own[0] != own[-1] else 0
            if whole:
                yield found(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None:
            yield found(rest)

    return run


def _spanning(rows: pa.Table, root: np.ndarray) -> dict[str, pa.Array]:
    """A spanning set (a, b) of the links between documents."""
    moved = np.flatnonzero(root != np.arange(len(root)))
    doc = rows.column("doc_id").to_numpy()
    return {"a": pa.array(doc[root[moved]]), "b": pa.array(doc[moved])}


def _bundles(rows: pa.Table, root: np.ndarray) -> dict[str, pa.Array]:
    """(bundle, doc_id, tree): connected rows of two documents or more, named by their documents alone."""
    doc = rows.column("doc_id").to_numpy()
    name = np.zeros(len(root), np.uint64)
    np.add.at(name, root, mix64(doc.view(np.uint64) + _STEP[11]))
    several = np.flatnonzero((np.bincount(root, minlength=len(root)) > 1)[root])
    return {"bundle": pa.array(mix64(name)[root[several]].view(np.int64)), "doc_id": pa.array(doc[several]), "tree": pa.array(rows.column("tree").to_numpy()[several])}


def _likely_links(width: int, threshold: float):
    """Links of ``_by_group`` on sketches, between different components."""
    p = (1 + threshold) / 2
    most = width - int(np.floor(width * p - 5 * np.sqrt(width * p * (1 - p))))

    def links(rows: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = rows.num_rows
        s = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(total, -1)
        n, c = rows.column("n").to_numpy().astype(np.float64), rows.column("c").to_numpy()
        size = np.diff(np.append(starts, total))
        left, right = [], []

        def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            apart = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.int64)
            for k in range(s.shape[1]):
                apart += np.bitwise_count(s[a, k] ^ s[b, k])
            return (c[a] != c[b]) & (apart <= most) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))

        few = np.repeat(size <= 24, size)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, int(size[size <= 24].max(initial=1))):
            a = np.flatnonzero(few[:-d] & (group[d:] == group[:-d]))
            a = a[likely(a, a + d)] if len(a) else a
            left.append(a)
            right.append(a + d)
        for at, m in zip(starts[size > 24].tolist(), size[size > 24].tolist(), strict=True):
            own = np.arange(at, at + m)
            for k in range(0, m, 128):
                a, b = np.nonzero(likely(own[k : k + 128, None], own[None, :]))
                a += k
                left.append(own[a[a < b]])
                right.append(own[b[a < b]])
        return np.concatenate([*left, starts[:0]]), np.concatenate([*right, starts[:0]])

    return links


def _exact_links(threshold: float):
    """Links of ``_by_group`` on full sets: all intersections of a group, counted over columns of shared shingles."""
    share = round(threshold * 100)

    def links(rows: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column("shingles").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
        at = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy()
        left, right = [], []
        for a, b in zip(starts.tolist(), np.append(starts[1:], rows.num_rows).tolist(), strict=True):
            m = b - a
            if m < 2:
                continue
            n = np.diff(at[a : b + 1])
            if m == 2:
                common = np.array([[n[0], (c := len(np.intersect1d(flat[at[a] : at[a + 1]], flat[at[a + 1] : at[b]], assume_unique=True)))], [c, n[1]]])
            else:
                shingles, owner = flat[at[a] : at[b]], np.repeat(np.arange(m), n)
                order = np.argsort(shingles, kind="stable")
                shingles, owner = shingles[order], owner[order]
                fresh = np.append(True, shingles[1:] != shingles[:-1])
                times = np.diff(np.append(np.flatnonzero(fresh), len(shingles)))
                shared = np.repeat(times > 1, times)
                place = (np.cumsum(fresh) - 1)[shared]
                if len(place):
                    place = np.cumsum(np.append(0, (place[1:] != place[:-1]).astype(np.int64)))
                owner = owner[shared]
                wide = 2048
                cuts = np.searchsorted(place, np.arange(0, (int(place[-1]) if len(place) else -1) + 1 + wide, wide))
                for top in range(0, m, 1024):  # strips of rows bound the matrix of intersections
                    common = np.zeros((min(1024, m - top), m), np.float32)
                    for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                        held = np.zeros((m, wide), np.float32)
                        held[owner[x:y], place[x:y] - k * wide] = 1
                        common += held[top : top + 1024] @ held.T
                    # Counts are whole and far below 2**24, but 100 times them need not be.
                    i, j = np.nonzero((100 + share) * common.astype(np.float64) >= share * (n[top : top + 1024, None] + n[None, :]))
                    ahead = i + top < j
                    left.append(i[ahead] + top + a)
                    right.append(j[ahead] + a)
                continue
            linked = np.triu((100 + share) * common >= share * (n[:, None] + n[None, :]), 1)
            i, j = np.nonzero(linked)
            left.append(i + a)
            right.append(j + a)
        return np.concatenate([*left, starts[:0]]), np.concatenate([*right, starts[:0]])

    return links


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(v, c): the smallest vertex reachable from each vertex of staged ``links`` (a, b).

    Rounds of contraction: each vertex points to its smallest neighbour if that is smaller, pointers are followed to their ends,
    and links between different ends are left for the next round. Every step is written to the shared folder; nothing is
    collected but whether something is left.
    """
    edges, whole, turn = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), None, 0
    while True:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        label = staged(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), f"{name}-{turn}")
        step = 0
        while True:
            on = label.select(F.col("v").alias("c"), F.col("c").alias("d")).hint("merge")
            after = staged(label.join(on, "c").select("v", F.col("d").alias("c"), (F.col("d") != F.col("c")).alias("moved")), f"{name}-{turn}-{step}")
            release(label)
            label, step = after.select("v", "c"), step + 1
            if after.where("moved").isEmpty():
                break
        before = whole
        if before is None:
            whole = label
        else:
            on = label.select(F.col("v").alias("c"), F.col("c").alias("d")).hint("merge")
            whole = staged(before.join(on, "c", "left").select("v", F.coalesce("d", "c").alias("c")), f"{name}-{turn}-whole")
            release(before)
        ca, cb = label.select(F.col("v").alias("a"), F.col("c").alias("ca")).hint("merge"), label.select(F.col("v").alias("b"), F.col("c").alias("cb")).hint("merge")
        met = edges.join(ca, "a").join(cb, "b").where("ca <> cb")
        left = staged(met.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), f"{name}-{turn}-edges")
        release(edges if turn else None, label if whole is not label else None)
        edges = left
        if edges.isEmpty():
            return whole
        turn += 1


def _together(rows: DataFrame, key: str) -> DataFrame:
    """Each group in one task, sorted."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, key).sortWithinPartitions(key, "doc_id")


class _Join:
    """The state of one join: sketched documents, full sets, and the components that confirmed links have made so far."""

    def __init__(self, alone: DataFrame, texts: DataFrame, size: int, threshold: float, width: int):
        self.alone, self.texts, self.size, self.threshold, self.width = alone, texts, size, threshold, width
        self.label: DataFrame | None = None  # (v, c), for documents with a link
        self.sets: DataFrame | None = None
        self.turn = 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return staged(df, f"near-{name}-{self.turn}")

    def bundles(self, nodes: DataFrame) -> DataFrame:
        """(bundle, doc_id, tree) of nodes (node, doc_id, tree) that fit a task."""
        rows = _together(self.labelled(nodes.join(self.alone.select("doc_id", "n", "sketch").hint("merge"), "doc_id")), "node")
        found = rows.mapInArrow(_by_group("node", _likely_links(self.width, self.threshold), _bundles), "bundle bigint, doc_id bigint, tree int")
        return self.stage(found.groupBy("bundle", "doc_id").agg(F.min("tree").alias("tree")), "bundles")

    def bring(self, documents: DataFrame) -> None:
        """Full sets of documents (doc_id)."""
        wanted = self.texts.join(documents.hint("merge"), "doc_id", "left_semi")
        self.sets = self.stage(wanted.mapInArrow(_sets(self.size), "doc_id bigint, shingles array<bigint>"), "sets")

    def component(self) -> Column:
        return F.coalesce("c", "doc_id")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with their document's component as c."""
        if self.label is None:
            return rows.withColumn("c", F.col("doc_id"))
        return rows.join(self.label.select(F.col("v").alias("doc_id"), "c").hint("merge"), "doc_id", "left").withColumn("c", self.component())

    def mixed(self, rows: DataFrame, key: str) -> DataFrame:
        """The groups of rows (key, doc_id) that hold two components: key, members, leader, tree."""
        leader = F.min(F.struct(F.xxhash64("doc_id", F.lit(self.turn)), "doc_id"))["doc_id"].alias("leader")
        sizes = self.labelled(rows).groupBy(key).agg(F.count("*").alias("members"), F.min("c").alias("lo"), F.max("c").alias("hi"), leader, F.min("tree").alias("tree"))
        return self.stage(sizes.where("lo < hi").drop("lo", "hi"), "mixed")

    def confirm(self, bundles: DataFrame) -> None:
        """Links within the bundles that hold two components, and what they connect."""
        self.turn += 1
        groups = self.mixed(bundles, "bundle")
        rows = bundles.select("bundle", "doc_id").join(groups.select("bundle").hint("merge"), "bundle", "left_semi").join(self.sets.hint("merge"), "doc_id")
        found = _together(rows, "bundle").mapInArrow(_by_group("bundle", _exact_links(self.threshold), _spanning), "a bigint, b bigint").where("a <> b").distinct()
        self.contract(self.stage(found, "links"))

    def contract(self, links: DataFrame) -> None:
        if links.isEmpty():
            return
        if self.label is not None:
            links = links.unionAll(self.label.select(F.col("v").alias("a"), F.col("c").alias("b")))
        before, self.label = self.label, components(links, f"near-components-{self.turn}")
        release(before)

    def led(self, rows: DataFrame, large: DataFrame, small: int) -> DataFrame:
        """Blocks of large nodes, each with the node's leader."""
        leaders = large.select("node", F.col("leader").alias("doc_id"), "tree")
        others = rows.join(leaders.drop("tree").hint("merge"), ["node", "doc_id"], "left_anti")
        return _dealt(others, large.select("node", "members"), leaders, F.ceil(2 * F.col("members") / small))

    def against_main(self, rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
        """Of large nodes that hold two components: blocks in which a node's largest component meets all its other documents,
        where those are few; and the rows of the other nodes."""
        labelled = self.stage(self.labelled(rows), "labelled")
        counts = labelled.groupBy("node", "c").agg(F.count("*").alias("n"))
        top = F.max(F.struct("n", "c"))
        nodes = self.stage(counts.groupBy("node").agg(top["n"].alias("top"), top["c"].alias("main"), F.sum("n").alias("members")).where("members > top"), "mains")
        few = F.col("members") - F.col("top") <= small // 2
        own = labelled.join(nodes.where(few).hint("merge"), "node").select("node", "doc_id", "tree", (F.col("c") == F.col("main")).alias("of_main"))
        met = _dealt(own.where("of_main"), nodes.where(few).select("node", "top"), own.where("NOT of_main"), F.ceil(2 * F.col("top") / small))
        return met, labelled.drop("c").join(nodes.where(~few).select("node").hint("merge"), "node", "left_semi")


def _linked(join: _Join, kept: int, trees: int, small: int) -> None:
    """Runs the trees: afterwards ``join.label`` has the components of every link that met."""
    twice = 1 / join.threshold - 1
    schema = "node bigint, doc_id bigint, tree int"
    signatures = join.alone.select("doc_id", "sig")

    def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of nodes with two components: the rows of small ones, the large ones, and their rows."""
        nodes = join.mixed(rows, "node")
        large = nodes.where(F.col("members") > small)
        fit = rows.join(nodes.where(F.col("members") <= small).select("node").hint("merge"), "node", "left_semi")
        return fit, large, join.stage(rows.join(large.select("node").hint("merge"), "node", "left_semi"), "large")

    nodes = join.stage(signatures.mapInArrow(_children(kept, trees, twice, False), schema), "nodes")
    fit, large, rows = by_size(nodes)
    # Large nodes of the first tree show what their leaders are linked with, before any other large node is looked at.
    bundles = join.bundles(fit.unionAll(join.led(rows.where("tree = 0"), large.where("tree = 0"), small)))
    release(nodes)
    join.bring(bundles.select("doc_id").unionAll(rows.select("doc_id")))
    join.confirm(bundles.where("tree = 0"))
    join.confirm(bundles.where("tree > 0"))
    while not rows.isEmpty():
        join.turn += 1
        met, rows = join.against_main(rows, small)
        grown = rows.join(signatures.hint("merge"), "doc_id").select("node", "doc_id", "tree", "sig")
        nodes = join.stage(grown.mapInArrow(_children(kept, trees, twice, True), schema), "nodes")
        fit, large, rows = by_size(nodes)
        join.confirm(join.bundles(met.unionAll(fit).unionAll(join.led(rows, large, small))))
        release(nodes)


def near_duplicates(documents: DataFrame, size: int = 5, threshold: float = 0.75, width: int = 256, kept: int = 64, trees: int = 16, small: int = 4096) -> DataFrame:
    """A row per document row: doc_id, n_shingles, component_id, kept."""
    bounded_batches(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = staged(texts.mapInArrow(_profile(size, width, kept), "doc_id bigint, n bigint, f1 bigint, f2 bigint, sketch binary, sig binary"), "profiles")
    named = profile.where("doc_id IS NOT NULL AND n > 0")
    # One representative of each set.
    first = staged(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "representatives")
    heads = first.select(F.col("rep").alias("doc_id"), "f1", "f2", "n")
    alone = staged(named.join(heads.hint("merge"), ["doc_id", "f1", "f2", "n"], "left_semi").dropDuplicates(["doc_id", "f1", "f2", "n"]).select("doc_id", "n", "sketch", "sig"), "alone")
    # Copies of a set follow their representative; the sets of one doc_id belong together.
    copies = named.select("doc_id", "f1", "f2", "n").distinct().join(first.hint("merge"), ["f1", "f2", "n"]).select("doc_id", "rep")
    owned = staged(copies.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")), "owned")
    doubled = owned.where("lo < hi").select("doc_id", "lo")
    join = _Join(alone, texts, size, threshold, width)
    join.contract(copies.join(doubled.hint("merge"), "doc_id").where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")))
    _linked(join, kept, trees, small)
    release(alone, join.sets)
    whole = owned.withColumnRenamed("doc_id", "v").withColumn("c", F.col("lo"))
    if join.label is not None:
        label = join.label.select(F.col("v").alias("lo"), F.col("c").alias("found"))
        whole = whole.join(label.hint("merge"), "lo", "left").withColumn("c", F.coalesce("found", "lo"))
    out = profile.select("doc_id", F.col("n").alias("n_shingles")).join(whole.select("v", "c").hint("merge"), F.col("doc_id") == F.col("v"), "left")
    out = out.withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), "n_shingles", F.col("component_id").cast(id_type).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
