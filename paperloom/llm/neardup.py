"""Operator 5: near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct shingles of five words. Documents with equal
sets are one class from the start. Each class has a sketch of minwise values. A tree
starts at a root; each node picks one or (so that the mean is 1 / threshold) two
coordinates of the sketch, and a class goes on to one child for each, named by the
path and the value there. Similar classes share children more likely than not;
trees are repeated independently, so the chance to miss a pair falls geometrically.
Small nodes are compared exhaustively: sketches first, and the full sets of those whose
sketches may belong to a link. Below the root the mean is larger, SHARED / threshold: a
pair at the threshold then shares more than one child on average, and the chance to part
it stays under a bound at any depth.

Two phases keep hot groups cheap. In the first, a node that is larger than a leaf is
dealt into leaves that all hold one common pivot; most large groups of near copies
become one component there. In the second, more trees are grown, and only nodes whose
classes still belong to different components are looked at. Those with few members
outside their largest component are compared whole, these members against all, block by
block; the others branch further, level by level. What no branching can part is compared
in blocks too, so nothing is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, passes, staged, table, text_bytes, worker_state
from .graph import components
from .shingles import WordHashes, mixed, sequence_hashes

WORDS = 5
SKETCH = 128  # coordinates
PERCENT = 85  # least similarity of a link
FIRST_TREES, ALL_TREES = 3, 8
LEAF = 256  # classes of a leaf in the first phase
BLOCK = 2048  # classes of a block whose sketches are compared in the second
FEW = 4096  # members outside the largest component up to which a node is compared whole
SETS = 512  # classes of a block whose full sets are compared
SHARED = 1.275  # mean children that a pair at the threshold shares below the root
DEPTH = 20  # levels that a large node branches further
SPREAD = 4.2  # standard deviations under its mean from which a sketch counts against a link
FILTER_BITS = 26  # at most 2 ** so many in the filter that finds the texts of candidates

_rng = np.random.default_rng(20240817)
_MULTIPLY = _rng.integers(1, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCH, np.uint64)


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(sequence_hashes(hashes.of(words), min(WORDS, len(words))))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minwise values: for each coordinate the smallest of a linear map, upper 32 bits."""
    low = np.full(SKETCH, ~np.uint64(0), np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at : at + 4096, None] * _MULTIPLY + _ADD).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def _class_prints(batches):
    hashes = worker_state(("words", 0), WordHashes)
    for batch in batches:
        n, digest, marks = [], [], []
        for text in batch.column(batch.num_columns - 1):
            s = shingle_set(text.as_py(), hashes)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            marks.append(sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "raw", "n_shingles", "digest", "sketch"])


def children(paths: np.ndarray, sketches: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows at nodes `paths`, with `mean` coordinates chosen at each: the rows (repeated
    where several are chosen) and the paths of their children."""
    whole = int(mean)
    more = np.flatnonzero(mixed(paths + np.uint64(0xEF)) < np.uint64(int((mean - whole) * 2.0**64)))
    picks = [mixed(paths + np.uint64(0x1F3 + 0x104 * k)) for k in range(whole + 1)]
    rows = np.concatenate([*[np.arange(len(paths))] * whole, more])
    which = np.concatenate([*picks[:whole], picks[whole][more]]) % np.uint64(SKETCH)
    value = sketches[rows, which.astype(np.int64)].astype(np.uint64)
    return rows, mixed(mixed(paths[rows] ^ which * np.uint64(0x9E3779B97F4A7C15)) + value)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def _first_children(first: int, last: int, threshold: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches, ids = _matrix(batch.column(1)), np.arange(batch.num_rows)
            for tree in range(first, last):
                root = mixed(np.full(len(ids), tree + 1, np.uint64))
                rows, paths = children(root, sketches, 1 / threshold)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(np.full(len(rows), tree, np.int32)), batch.column(0).take(take)], names=["node", "tree", "rep"])

    return run


def _next_children(threshold: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, paths = children(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(3)), SHARED / threshold)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), *[batch.column(i).take(take) for i in (1, 2)]], names=["node", "tree", "rep"])

    return run


NODE = "node bigint, tree int, rep bigint"


def least_agreement(threshold: float) -> int:
    """Equal coordinates of two sketches below which a pair is taken for no link."""
    return math.ceil(SKETCH * threshold - SPREAD * math.sqrt(SKETCH * threshold * (1 - threshold)))


def likely(sketches: np.ndarray, sizes: np.ndarray, labels: np.ndarray, threshold: float) -> np.ndarray:
    """Which members of a leaf may have a link to one of another component, by sizes and
    sketches. Every such pair has a member outside the largest component; only those are
    held against all."""
    values, inverse, counts = np.unique(labels, return_inverse=True, return_counts=True)
    out, least = np.zeros(len(labels), bool), least_agreement(threshold)
    outside = np.flatnonzero(inverse != counts.argmax()) if counts.max() > 1 else np.arange(len(labels))
    step = max(1, (1 << 15) // len(labels))
    for at in range(0, len(outside), step):
        own = outside[at : at + step]
        low, high = np.minimum(sizes[own, None], sizes[None]), np.maximum(sizes[own, None], sizes[None])
        i, j = np.nonzero((low >= threshold * high) & (labels[own, None] != labels[None]))
        hit = (sketches[own[i]] == sketches[j]).sum(1) >= least
        out[own[i[hit]]] = True
        out[j[hit]] = True
    return out


def _likely_members(threshold: float):
    """Rows come sorted by leaf: those of likely(), without sketches."""

    def run(batches):
        leaf, rows = None, []

        def close():
            if len(rows) < 2:
                return []
            sketches = np.frombuffer(b"".join(r[6] for r in rows), "<u4").reshape(-1, SKETCH)
            hit = likely(sketches, np.array([r[5] for r in rows], float), np.array([r[2] for r in rows]), threshold)
            return [r[:5] for r, h in zip(rows, hit, strict=True) if h]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["node", "rep", "label", "doc_id", "digest"])

        for batch in batches:
            found = []
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != leaf:
                    found += close()
                    leaf, rows = name, []
                rows.append(row)
            yield batch_of(found)
        yield batch_of(close())

    return run


def _sets_of(shipped):
    """Sets of the documents that pass the filter."""

    def run(batches):
        hashes = worker_state(("words", 0), WordHashes)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero(passes(shipped.value, batch.column(1).to_numpy()))
            sets = [shingle_set(batch.column(2)[int(i)].as_py(), hashes) for i in hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[hit], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "digest", "shingles"]
            )

    return run


def linked_groups(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Components of at least two sets under 100 * intersection >= percent * union, from
    exact intersections on full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((n, n))
    if n == 2:
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        several = times[column] > 1
        column, owner = np.unique(column[several], return_inverse=True)[1], owner[several]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [at, at + 8192])
            block = np.zeros((n, 8192), np.float32)
            block[owner[a:b], column[a:b] - at] = 1
            shared += block @ block.T
    shared = np.rint(shared).astype(np.int64)
    link = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(link, False)
    seen, out = np.zeros(n, bool), []
    for i in range(n):
        if not seen[i] and link[i].any():
            group, front = [], [i]
            seen[i] = True
            while front:
                group += front
                near = link[front].any(0) & ~seen
                seen |= near
                front = np.flatnonzero(near).tolist()
            out.append(group)
    return out


def _leaf_edges(percent: int):
    """Rows come sorted by leaf: each leaf's components become stars around the smallest id."""

    def run(batches):
        leaf, ids, sets, a, b = None, [], [], [], []

        def close():
            if len(ids) > 1:
                for group in linked_groups(sets, percent):
                    least = min(ids[i] for i in group)
                    a.extend(ids[i] for i in group if ids[i] != least)
                    b.extend([least] * (len(a) - len(b)))

        for batch in batches:
            for name, rep, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if name != leaf:
                    close()
                    leaf, ids, sets = name, [], []
                ids.append(rep)
                sets.append(np.frombuffer(shingles.as_py(), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class _Join:
    """The state of one run over the classes of a table."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int):
        self.docs, self.classes, self.percent, self.threshold = docs, classes, percent, percent / 100

    def likely(self, members: DataFrame) -> DataFrame:
        """members: leaf, node, rep, label. Those that may have a link to another component
        of their leaf: node, rep, label, doc_id, digest."""
        full = members.join(self.classes, "rep").select("leaf", "node", "rep", "label", "doc_id", "digest", "n_shingles", "sketch")
        found = full.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_likely_members(self.threshold), "node bigint, rep bigint, label bigint, doc_id bigint, digest binary")
        return staged(found.distinct(), "likely")

    def edges(self, members: DataFrame) -> DataFrame:
        """members: leaf, rep, doc_id, digest. Links of each leaf, from full sets."""
        spark = members.sparkSession
        members = staged(members.select("leaf", "rep", "doc_id", "digest"), "leaves")
        wanted = members.select("doc_id", "digest").distinct()
        shipped = spark.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("doc_id")), FILTER_BITS))
        sets = self.docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id"), "text").mapInArrow(_sets_of(shipped), "doc_id bigint, digest binary, shingles binary")
        sets = sets.join(wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
        full = members.join(sets, ["doc_id", "digest"]).select("leaf", "rep", "shingles")
        return full.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_leaf_edges(self.percent), "a bigint, b bigint")

    def first_phase(self) -> DataFrame:
        rows = self.classes.select("rep", "sketch").mapInArrow(_first_children(0, FIRST_TREES, self.threshold), NODE)
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).filter("size > 1")
        rows = staged(rows.join(sizes, "node"), "nodes")
        # a larger node is dealt into leaves around its pivot
        large = rows.filter(F.col("size") > LEAF)
        dealt = large.select(F.xxhash64("node", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / (LEAF - 1)))).alias("leaf"), "rep", "pivot")
        pivots = dealt.select("leaf", F.col("pivot").alias("rep")).distinct()
        leaves = rows.filter(F.col("size") <= LEAF).select(F.col("node").alias("leaf"), "rep").union(dealt.select("leaf", "rep").union(pivots).distinct())
        found = self.likely(leaves.select("leaf", F.col("leaf").alias("node"), "rep", F.col("rep").alias("label")))
        return staged(self.edges(found.withColumnRenamed("node", "leaf")), "links")

    def nodes(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of nodes whose members belong to several components, with the node's size,
        its largest component (main) and how many members are outside of it."""
        rows = rows.join(labels, rows.rep == labels.id, "left").select(rows["*"], F.coalesce("label", "rep").alias("label"))
        spans = rows.groupBy("node").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("node")
        rows = staged(rows.join(spans, "node"), "nodes")
        return staged(rows.join(self.mains(rows), "node"), "nodes")

    @staticmethod
    def mains(rows: DataFrame) -> DataFrame:
        count = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
        return count.groupBy("node").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))

    def second_phase(self, labels: DataFrame) -> DataFrame:
        sketches = self.classes.select("rep", "sketch")
        rows, parts = sketches.mapInArrow(_first_children(0, ALL_TREES, self.threshold), NODE), []
        for level in range(DEPTH + 1):
            found = self.nodes(rows, labels)
            if level < DEPTH:
                thick = found.filter(F.col("outside") > FEW)
                found = found.filter(F.col("outside") <= FEW)
            parts.append(found)
            if level == DEPTH or thick.isEmpty():
                break
            rows = thick.select("node", "tree", "rep").join(sketches, "rep").select("node", "tree", "rep", "sketch").mapInArrow(_next_children(self.threshold), NODE)
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.filter((F.col("tree") >= FIRST_TREES) | (F.col("size") > LEAF))  # the others were compared in the first phase
        found = self.likely(_blocks(found, BLOCK, ["node", "rep", "label"]))
        return self.edges(_blocks(found.join(self.mains(found), "node"), SETS, ["rep", "doc_id", "digest"]))


def _blocks(rows: DataFrame, most: int, columns: list[str]) -> DataFrame:
    """Leaves in which each member outside the main component of its node meets all others:
    the node itself if it has at most 2 * most members, else blocks of `most` members
    outside against blocks of `most` of all."""
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.ceil(F.col(n) / most))
    whole = rows.filter(F.col("size") <= 2 * most).select(F.col("node").alias("leaf"), *columns)
    large = rows.filter(F.col("size") > 2 * most)
    places = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / most) - 1))
    leaf = F.xxhash64("node", "own", "block").alias("leaf")
    others = large.withColumns({"block": dealt("size", "rep"), "own": places("outside")}).select(leaf, *columns)
    mine = large.filter(F.col("label") != F.col("main")).withColumn("own", dealt("outside", F.lit(1), "rep")).withColumn("block", places("size")).select(leaf, *columns)
    return whole.union(others.union(mine).distinct())


def _labelled(docs: DataFrame, percent: int, raw) -> DataFrame:
    """doc_id, raw, n_shingles, component_id and component (a number) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw.alias("raw"), text_bytes().alias("text"))
    prints = staged(rows.mapInArrow(_class_prints, "doc_id bigint, raw binary, n_shingles bigint, digest binary, sketch binary"), "prints")
    with_id = prints.filter("doc_id is not null and digest is not null")
    classes = with_id.groupBy("digest", "sketch", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbered once, by being written
    join = _Join(rows.select("doc_id", "text"), classes, percent)
    labels = staged(components(join.first_phase()), "labels")
    more = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(join.second_phase(labels))
    labels = staged(components(more), "labels")
    named = staged(classes.join(labels, classes.rep == labels.id, "left").select("digest", "doc_id", F.coalesce("label", "rep").alias("component")), "named")
    firsts = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = prints.select("doc_id", "raw", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    found = own.join(named.join(firsts, "component").select("digest", "component", "component_id"), "digest", "left")
    return found.select("doc_id", "raw", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "component")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked if 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest doc_id that links reach, kept says that it is
    the row's own. Texts that are null, empty or only white space have no shingles
    and no links; texts of any length are taken whole. Rows that repeat a doc_id are
    linked each by its own text. A null doc_id takes no part in links: component_id is
    null and kept true. Extra columns are ignored, whatever their names. An empty table
    gives an empty result."""
    found = _labelled(docs, percent, F.lit(None).cast("binary"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; all columns stay.

    Rows are told apart by doc_id and text: a text that is like no other stays even if
    another row has its doc_id. Of rows of a component that share the smallest doc_id one
    stays (of different texts that with the smallest hash). Rows without shingles stay,
    but exact repeats of id and text go; rows with a null doc_id all stay."""
    mark = F.md5(text_bytes()).cast("binary")
    found = _labelled(docs, percent, mark).filter("doc_id is not null and n_shingles > 0")
    first = F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("raw"))).alias("first")
    keys = staged(found.select("component", "component_id", "doc_id", "raw").distinct(), "keys")
    firsts = keys.groupBy("component").agg(first)
    gone = keys.join(firsts, "component").filter((F.col("doc_id") != F.col("component_id")) | (F.col("raw") != F.col("first")))
    gone = gone.select(F.col("doc_id").alias("__pl_gone"), F.col("raw").alias("__pl_text"))
    known = docs.filter("doc_id is not null").withColumn("__pl_raw", mark)
    rest = known.join(gone, (F.col("doc_id").cast("bigint") == F.col("__pl_gone")) & (F.col("__pl_raw") == F.col("__pl_text")), "left_anti")
    return docs.filter("doc_id is null").unionByName(rest.dropDuplicates(["doc_id", "__pl_raw"]).drop("__pl_raw"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
