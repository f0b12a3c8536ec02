"""Merkle manifest of a dataset: a tree per source and one over the sources, kept as postorder logs.

Nodes of a tree are hashed in runs of 16, level by level, until one is left. Leaves are numbered within their
tree and dealt to aligned builders of 16^3 of them. A builder appends nodes to its log in the order in which they are
complete: a leaf when it comes, a parent right after its last child. So the place of a node in a log follows from sizes of
subtrees alone (``postorder``), and siblings are read at computed offsets; nothing in the log points anywhere. Builder roots
are the leaves of the next round of builders, 4,096 times fewer, until every tree has one root; the roots of the trees are leaves of
the top tree. Proofs go the other way: a round hands each of its children the siblings above it.

A digest is lower-case hex sha256 of its inputs written one after another; a log holds 64 letters a node.

Defined results: a NULL field is ``-``; NULL doc_ids come first in a source and are never tampered with; the NULL source comes first;
rows of equal doc_id are ordered by their leaf, and equal rows all stay, each with the proof of its own place; a lone
leaf is its tree's root; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, discard, stored, table

FAN, HEIGHT = 16, 3
BLOCK, DIGEST = FAN**HEIGHT, 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_LOG = "tree string, seg long, n long, log string, root string, ids {ids}, forged array<string>"
_TAIL = "tree string, seg long, lefts array<string>, rights array<string>, subroot string, top string"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf_digest(*fields: Column) -> Column:
    """sha256 of fields as byte count, colon and value; ``-`` for NULL."""

    def spelled(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(spelled, fields)).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def postorder(level: int, index: int, n: int, top: int) -> int:
    """Place of a node in the log of a tree of n leaves and ``top`` levels above them.

    By then all nodes up to its level that lie left of its end are complete, and of higher ones those that end where it starts.
    """
    start, end = index * FAN**level, min(n, (index + 1) * FAN**level)
    return sum(-(-end // FAN**m) for m in range(level + 1)) + sum(start // FAN**m for m in range(level + 1, top + 1)) - 1


def build(leaves: list[bytes], top: int) -> bytes:
    """The log of a tree with ``top`` levels above its leaves; its last node is the root."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(top)]

    def complete(node: bytes, level: int) -> None:
        log.append(node)
        if level < top:
            runs[level].append(node)
            if len(runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        complete(digest(b"".join(run)), level + 1)

    for leaf in leaves:
        complete(leaf, 0)
    for level in range(top):
        if runs[level]:
            close(level)
    return b"".join(log)


def siblings(log: bytes, n: int, top: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """Per leaf, level by level, what stands left and right of its path in its run, read from the log at computed places."""
    levels = []
    for level in range(top):
        at = (postorder(level, k, n, top) for k in range(-(-n // FAN**level)))
        levels.append([log[p * DIGEST : (p + 1) * DIGEST] for p in at])
    for leaf in range(n):
        path = []
        for level, nodes in enumerate(levels):
            k = leaf // FAN**level
            run = k // FAN * FAN
            path.append((b"".join(nodes[run:k]), b"".join(nodes[k + 1 : run + FAN])))
        yield path


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with ``at``, their place in their tree from 0, and ``n``, its rows. No tree need fit one task."""
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(wide, tree, *order).sortWithinPartitions(tree, *order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "merkle-ranged")
    runs = ranged.groupBy(F.col(tree).alias("t"), F.col("part").alias("p")).agg(F.min("row").alias("first"), F.count("*").alias("many"))  # a row a tree and partition
    own = Window.partitionBy("t")
    before = F.coalesce(F.sum("many").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("t", "p", (before - F.col("first")).alias("shift"), F.sum("many").over(own).alias("n"))
    met = ranged.join(runs, F.col(tree).eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return met.withColumn("at", F.col("row") + F.col("shift")).drop("t", "p", "part", "row", "shift")


def _segments(nodes: DataFrame, kind: str) -> DataFrame:
    """nodes(tree, at, n, digest, id, forged) -> one row a builder: its log, its root and its leaves' ids and forged digests."""
    node = F.struct("at", "digest", "id", "forged")
    rows = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("seg")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node)).alias("m"))
    rows = rows.select("tree", "seg", "n", "m.digest", F.col("m.id").alias("ids"), "m.forged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, leaves = row.column(2)[0].as_py(), [x.encode() for x in row.column(3)[0].as_py()]
                log = build(leaves, height(n) if n <= BLOCK else HEIGHT).decode()
                yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([log]), pa.array([log[-DIGEST:]]), *row.columns[4:]], names=["tree", "seg", "n", "log", "root", "ids", "forged"])

    return stored(rows.mapInArrow(run, _LOG.format(ids=f"array<{kind}>")), "merkle-log")


class Trees:
    """Logs of many trees: ``rounds`` from the leaves up, and ``roots`` (tree, root)."""

    def __init__(self, leaves: DataFrame):
        """leaves(tree, at, n, digest, id, forged)."""
        self.rounds = [_segments(leaves, dict(leaves.dtypes)["id"])]
        while self.rounds[-1].where(F.col("n") > BLOCK).limit(1).count():
            below = self.rounds[-1].where(F.col("n") > BLOCK)
            none = F.lit(None).cast("string")
            self.rounds.append(_segments(below.select("tree", F.col("seg").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"), none.alias("id"), none.alias("forged")), "string"))
        whole = [r.where(F.col("n") <= BLOCK).select("tree", "root") for r in self.rounds]
        self.roots = whole[0]
        for more in whole[1:]:
            self.roots = self.roots.unionByName(more)

    def paths(self, above: DataFrame) -> DataFrame:
        """The builders of the first round, each with the siblings above it. above(tree, lefts, rights, subroot, top): what is above the trees."""
        tails = None
        for k in range(len(self.rounds) - 1, -1, -1):
            here = self.rounds[k]
            ends = here.where(F.col("n") <= BLOCK).select(F.col("tree").alias("t"), "seg", "root")
            tail = ends.join(above.withColumnRenamed("tree", "u"), F.col("t").eqNullSafe(F.col("u"))).select(F.col("t").alias("tree"), "seg", "lefts", "rights", F.coalesce("subroot", "root").alias("subroot"), F.coalesce("top", "root").alias("top"))
            tail = tail if tails is None else tail.unionByName(tails)
            t = tail.withColumnsRenamed({"tree": "t", "seg": "s"})
            both = here.join(t, F.col("tree").eqNullSafe(F.col("t")) & (F.col("seg") == F.col("s"))).drop("t", "s")
            if k == 0:
                return both
            tails = stored(both.mapInArrow(_hand_down, _TAIL), "merkle-tails")


def _paths(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[bytes], Iterator[list[tuple[bytes, bytes]]]]]:
    """(row, its leaves, their paths up to the top) of each builder."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        n = row["n"] if row["n"] <= BLOCK else min(BLOCK, row["n"] - row["seg"] * BLOCK)
        top, log = height(n) if row["n"] <= BLOCK else HEIGHT, row["log"].encode()
        upper = [(a.encode(), b.encode()) for a, b in zip(row["lefts"], row["rights"], strict=True)]
        leaves = [log[p * DIGEST : (p + 1) * DIGEST] for p in (postorder(0, k, n, top) for k in range(n))]
        yield row, leaves, (path + upper for path in siblings(log, n, top))


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each builder of the round below (or tree, where builders have ids) the siblings above it."""
    for batch in batches:
        for row, _, paths in _paths(batch):
            lefts, rights = [], []
            for path in paths:
                lefts.append([a.decode() for a, _ in path])
                rights.append([b.decode() for _, b in path])
            m, first = len(lefts), row["seg"] * BLOCK
            yield pa.RecordBatch.from_pydict({"tree": pa.array([row["tree"]] * m, pa.string()), "seg": pa.array(range(first, first + m), pa.int64()), "lefts": pa.array(lefts, pa.list_(pa.string())), "rights": pa.array(rights, pa.list_(pa.string())), "subroot": pa.array([row["subroot"]] * m, pa.string()), "top": pa.array([row["top"]] * m, pa.string())})


def _to_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for builders of the top tree, whose leaves are roots of trees."""
    for batch in batches:
        for row, leaves, paths in _paths(batch):
            lefts, rights = [], []
            for path in paths:
                lefts.append([a.decode() for a, _ in path])
                rights.append([b.decode() for _, b in path])
            yield pa.RecordBatch.from_pydict({"tree": pa.array(row["ids"], pa.string()), "lefts": pa.array(lefts, pa.list_(pa.string())), "rights": pa.array(rights, pa.list_(pa.string())), "subroot": pa.array([x.decode() for x in leaves], pa.string()), "top": pa.array([row["top"]] * len(leaves), pa.string())})


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.schema.field("ids").type.value_type
        for row, leaves, paths in _paths(batch):
            proofs, folded = [], []
            for leaf, forged, path in zip(leaves, row["forged"], paths, strict=True):
                proof = hashlib.sha256()
                for left, right in path:
                    proof.update(left)
                    proof.update(right)
                proofs.append(proof.hexdigest())
                folded.append(fold(leaf if forged is None else forged.encode(), path).decode())
            m = len(leaves)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["ids"], ids), "leaf": [x.decode() for x in leaves], "subroot": [row["subroot"]] * m, "root": [row["top"]] * m, "proof_sha256": proofs, "folded_root": folded, "verified": [x == row["top"] for x in folded]})


def manifest(leaves: DataFrame) -> tuple[Trees, Trees, DataFrame]:
    """leaves(tree, id, digest, forged) -> the trees, the top tree over their roots, and the builders with all siblings above them."""
    hashed = stored(leaves.select("tree", "id", "digest", "forged"), "merkle-leaves")  # digests are made once; numbering reads them twice
    trees = Trees(numbered(hashed, "tree", "id", "digest"))
    none = F.lit(None).cast("string")
    tops = numbered(trees.roots.select(none.alias("all"), F.col("tree").alias("id"), F.col("root").alias("digest")), "all", "id")
    top = Trees(tops.select(F.col("all").alias("tree"), "at", "n", "digest", "id", none.alias("forged")))
    nothing = F.array().cast("array<string>")
    over = top.roots.select("tree", nothing.alias("lefts"), nothing.alias("rights"), none.alias("subroot"), none.alias("top"))
    above = stored(top.paths(over).mapInArrow(_to_trees, "tree string, lefts array<string>, rights array<string>, subroot string, top string"), "merkle-above")
    discard(hashed)
    return trees, top, trees.paths(above)


def prove(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    folded_root goes from the row's leaf up its siblings; where ``tampered`` holds, from the leaf of the row with the letters A-Z of its text lowered.
    """
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [F.col(c) for c in FIELDS]
    forged = F.when(F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)), leaf_digest(*own[:-1], low))
    leaves = docs.select(*FIELDS).select(F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("id"), leaf_digest(*own).alias("digest"), forged.alias("forged"))
    _, _, paths = manifest(leaves)
    kind = dict(docs.dtypes)["doc_id"]
    return paths.mapInArrow(_prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return prove(docs, (crc_mod("doc_id", 5) == 0) & F.col("text").isNotNull())
