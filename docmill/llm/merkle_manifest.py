"""Merkle manifest of a dataset: a node store in sorted, level-partitioned Parquet, and proofs by merge-scans over it.

A leaf is the hash of a document's fields; leaves of a language ascend by doc_id (then by leaf; nulls first) and make one tree, and the roots of these
trees, by language, make the tree of the whole. A node's coordinate is (tree, level, place), places dense from 0. Leaves are sorted once into runs;
only counts of runs are needed to number them. The store then grows in bands of BAND levels: a task reads some aligned stretches of 2^BAND nodes of the
band's lowest level, in order, and hashes each level from the one below, so 10^10 leaves take four passes; every pass writes its levels as
partitions of the store and reads only the last level of the pass before. Proofs go the other way: a stretch and its nodes are scanned side by side, the
sibling of place p at level l is place (p >> l) ^ 1, and what lies above the stretch is the path of the stretch's own top node. No task holds more than a
stretch, and nothing but the greatest tree size and the one root reaches the driver.

Every row is a leaf: null fields are written as "-", rows that repeat a doc_id are leaves of their own, a null doc_id comes first. Other columns are ignored.
An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm._common import new_path, stored

BAND = 10  # levels that one pass over the store adds; a task holds stretches of 2^BAND nodes

PATH = "array<struct<left boolean, digest string>>"  # siblings from below; a null digest where a node has none
_STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])
_NODE = "tree string, level int, place long, size long, digest string"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The hash of a document: each field as its length in UTF-8 bytes, a colon and the value."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def step(below: Column, sibling: Column) -> Column:
        beside = sibling.digest
        return F.sha2(F.when(beside.isNull(), below).when(sibling.left, F.concat(beside, below)).otherwise(F.concat(below, beside)), 256)

    return F.aggregate(path, leaf, step)


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree of that many."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0).cast("int")


@dataclass
class Forest:
    """Trees in store: leaves with `tree`, `place`, `size` (leaves of the tree), `digest` and their own columns, and all nodes above them."""

    leaves: DataFrame
    nodes: DataFrame
    top: int  # height of the highest tree
    band: int  # levels of a pass

    def roots(self) -> DataFrame:
        """tree and the digest of its root."""
        single = self.leaves.filter("size = 1").select("tree", "size", "digest")
        return single.unionByName(self.nodes.filter(F.col("level") == _height(F.col("size"))).select("tree", "size", "digest"))


def _numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """rows with their place in their tree by order, and the tree's size. Sorted runs are stored; their counts give each run its first place."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    runs = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), tag)
    run = F.shiftright("at", 33).alias("run")
    counts = runs.groupBy("tree", run).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))
    starts = counts.select("tree", "run", shift.alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return runs.withColumn("run", run).join(starts, ["tree", "run"]).select(*rows.columns, (F.col("at") - F.col("shift")).alias("place"), "size")


def _rise(stretch: pa.Table, base: int, band: int) -> pa.Table:
    """The nodes above a stretch of one level, up to the band's last level or the tree's root."""
    stretch = stretch.sort_by("place")
    tree, size, digests = stretch["tree"][0].as_py(), stretch["size"][0].as_py(), stretch["digest"].to_pylist()
    first, wide = stretch["place"][0].as_py(), -(-size >> base)
    out = []
    for level in range(base + 1, base + band + 1):
        if wide == 1:
            break
        digests = [hashlib.sha256("".join(digests[k : k + 2]).encode()).hexdigest() for k in range(0, len(digests), 2)]
        first, wide = first >> 1, -(-wide // 2)
        n = len(digests)
        out.append(pa.table({"tree": pa.array([tree] * n, pa.string()), "level": pa.array([level] * n, pa.int32()), "place": pa.array(range(first, first + n), pa.int64()), "size": pa.array([size] * n, pa.int64()), "digest": pa.array(digests, pa.string())}))
    return pa.concat_tables(out)


def _rising(base: int, band: int):
    return lambda stretch: _rise(stretch, base, band)


def grow(leaves: DataFrame, order: list[str], tag: str, band: int = BAND) -> Forest | None:
    """Numbers the leaves (tree, digest and other columns) by order within their tree and builds the store above them; None without leaves."""
    spark = leaves.sparkSession
    leaves = stored(_numbered(leaves, order, tag + "-runs"), tag + "-leaves")
    size = leaves.agg(F.max("size")).first()[0]
    if size is None:
        return None
    top, path = (size - 1).bit_length(), new_path(spark, tag + "-nodes")
    nodes = spark.createDataFrame([], _NODE)
    level = leaves.select("tree", F.lit(0).alias("level"), "place", "size", "digest")
    for base in range(0, top, band):
        stretches = level.filter(F.col("size") > 1 << base).groupBy("tree", F.shiftright("place", band).alias("stretch"))
        levels = f"{path}/band={base // band}"
        stretches.applyInArrow(_rising(base, band), _NODE).write.partitionBy("level").option("compression", "zstd").parquet(levels)
        made = spark.read.schema(_NODE).parquet(levels)
        nodes, level = nodes.unionByName(made), made.filter(F.col("level") == base + band)
    return Forest(leaves, nodes, top, band)


def _scan(stretch: pa.Table, above: pa.Table, base: int, band: int, columns: list[str]) -> pa.Table:
    """Paths of a stretch: its own siblings level by level out of the nodes above it, then the path of its top node."""
    stretch = stretch.sort_by("place")
    tail = above.filter(pc.is_valid(above["path"]))
    steps = tail["path"].combine_chunks().flatten()
    steps = steps.chunk(0) if isinstance(steps, pa.ChunkedArray) else steps
    nodes = above.filter(pc.is_null(above["path"])).sort_by([("level", "ascending"), ("place", "ascending")])
    levels = nodes["level"].to_numpy()
    place, size = stretch["place"].to_numpy(), stretch["size"][0].as_py()
    height = max(0, min((size - 1).bit_length() - base, band))
    pool, taken, left, at = [stretch["digest"].combine_chunks()], [], [], 0
    for up in range(height):
        if up:
            some = nodes.filter(pa.array(levels == base + up))
            pool.append(some["digest"].combine_chunks())
            at += len(pool[-2])
        own = place >> up
        beside, first = own ^ 1, place[0] >> up
        there = beside < -(-size >> (base + up))
        taken.append(np.where(there, at + beside - first, -1))
        left.append(beside < own)
    pool.append(steps.field("digest"))
    at = sum(map(len, pool[:-1]))
    n, more = len(place), len(steps)
    taken += [np.full(n, at + k) for k in range(more)]
    left += [np.full(n, bool(x)) for x in steps.field("left").to_pylist()]
    take = np.stack(taken, 1).ravel() if taken else np.zeros(0, np.int64)
    side = np.stack(left, 1).ravel() if left else np.zeros(0, bool)
    digest = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in pool]).take(pa.array(take, pa.int64(), mask=take < 0))
    ends = pa.array(np.arange(n + 1) * (height + more), pa.int32())
    path = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(side), digest], fields=list(_STEP)))
    return pa.table([*[stretch[c] for c in columns], path, pa.repeat(tail["subroot"][0], n)], names=[*columns, "path", "subroot"])


def _scanning(base: int, band: int, columns: list[str]):
    return lambda stretch, above: _scan(stretch, above, base, band, columns)


def paths(forest: Forest, tails: DataFrame) -> DataFrame:
    """The leaves with `path` (siblings from the leaf to the root and on along the tree's tail) and `subroot`. tails: tree, size, subroot, path of the root."""
    tails = tails.select("tree", "size", F.lit(0).cast("long").alias("stretch"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), "path", "subroot")
    upper, band = None, forest.band
    for base in reversed(range(0, max(forest.top, 1), band)):
        level = forest.leaves if base == 0 else forest.nodes.filter(F.col("level") == base)
        level = level.filter(F.col("size") > 1 << base) if base else level
        columns = list(level.columns) if base == 0 else ["tree", "place", "size"]
        ends = tails.filter(F.col("size") <= 1 << (base + band))
        ends = ends.filter(F.col("size") > 1 << base) if base else ends
        inner = forest.nodes.filter((F.col("level") > base) & (F.col("level") < base + band) & (F.col("level") < _height(F.col("size"))))
        stretch = F.call_function("shiftright", "place", F.lit(band + base) - F.col("level"))
        above = inner.select("tree", "size", stretch.alias("stretch"), "level", "place", "digest", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot")).unionByName(ends)
        if upper is not None:
            above = above.unionByName(upper.select("tree", "size", F.col("place").alias("stretch"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), "path", "subroot"))
        kinds = [f"`{c}` {t}" for c, t in level.select(*columns).dtypes]
        upper = (
            level.groupBy("tree", F.shiftright("place", band).alias("stretch"))
            .cogroup(above.groupBy("tree", "stretch"))
            .applyInArrow(_scanning(base, band, columns), ", ".join([*kinds, f"path {PATH}", "subroot string"]))
        )
        if base:
            upper = stored(upper, "merkle-paths")
    return upper


def manifest(documents: DataFrame, tampered: Column | None = None, band: int = BAND) -> DataFrame:
    """A row for each row of documents: doc_id, leaf, altered (the leaf it has where `tampered` holds and n_chars is one more; else null), path, subroot, root."""
    spark = documents.sparkSession
    doc_id, source, lang, n_chars, text = F.col("doc_id").cast("long"), *map(F.col, ("source", "lang", "n_chars", "text"))
    more = n_chars.cast("decimal(20,0)") + 1
    altered = F.when(F.coalesce(tampered, F.lit(False)) & n_chars.isNotNull(), leaf_digest(doc_id, source, lang, more, text)) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), lang), F.lit(""))  # null first, then bytewise
    rows = stored(documents.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf_digest(doc_id, source, lang, n_chars, text).alias("digest"), altered.alias("altered")), "merkle-digests")
    languages = grow(rows, ["doc_id", "digest"], "merkle", band)
    if languages is None:
        return spark.createDataFrame([], f"doc_id long, leaf string, altered string, path {PATH}, subroot string, root string")
    subroots = stored(languages.roots(), "merkle-subroots")
    whole = grow(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("size").alias("leaves"), "digest"), ["lang"], "merkle-top", band)
    root = whole.roots().first().digest
    size = whole.leaves.agg(F.max("size")).first()[0]
    at_root = spark.range(1).select(F.lit("").alias("tree"), F.lit(size).cast("long").alias("size"), F.array().cast(PATH).alias("path"), F.lit(root).alias("subroot"))
    tails = stored(paths(whole, at_root).select(F.col("lang").alias("tree"), F.col("leaves").alias("size"), "path", F.col("digest").alias("subroot")), "merkle-tails")
    return paths(languages, tails).select("doc_id", F.col("digest").alias("leaf"), "altered", "path", "subroot", F.lit(root).alias("root"))


TAMPER = 7  # the query alters documents whose crc32 it divides


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_merkle_manifest: leaf, proof and verdict of every document, some of them altered before they are verified."""
    made = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("long").cast("string")) % TAMPER == 0)
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: s.digest)), 256)
    made = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
  FROM documents
), leaf AS (
  SELECT doc_id, lang,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR) END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR) END || tail) AS altered,
    xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b)] || CAST(range(8) AS BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))) AS crc
  FROM field
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM leaf
), node AS (
  SELECT lang, 0 AS level, place, size AS wide, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, (wide + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM node WHERE wide > 1 GROUP BY lang, level, place // 2, wide
), subroot AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM node WHERE wide = 1
), upper_node AS (
  SELECT 0 AS level, place, size AS wide, digest FROM subroot
  UNION ALL
  SELECT level + 1, place // 2, (wide + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM upper_node WHERE wide > 1 GROUP BY level, place // 2, wide
), step AS (
  SELECT p.doc_id, p.leaf, n.level AS nth, n.place < (p.place >> n.level) AS before, n.digest
  FROM placed p JOIN node n ON n.lang IS NOT DISTINCT FROM p.lang AND n.place = xor(p.place >> n.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, 100 + n.level, n.place < (s.place >> n.level), n.digest
  FROM placed p JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang JOIN upper_node n ON n.place = xor(s.place >> n.level, 1)
), level_of AS (
  SELECT p.doc_id, p.leaf, n.level AS nth FROM placed p JOIN (SELECT DISTINCT lang, level, wide FROM node) n ON n.lang IS NOT DISTINCT FROM p.lang WHERE n.wide > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, 100 + n.level FROM placed p CROSS JOIN (SELECT DISTINCT level, wide FROM upper_node) n WHERE n.wide > 1
), ordered AS (
  SELECT l.doc_id, l.leaf, s.before, s.digest, row_number() OVER (PARTITION BY l.doc_id, l.leaf ORDER BY l.nth) AS k
  FROM level_of l LEFT JOIN step s ON s.doc_id = l.doc_id AND s.leaf = l.leaf AND s.nth = l.nth
), folded AS (
  SELECT doc_id, leaf, CASE WHEN crc % 7 = 0 THEN altered ELSE leaf END AS digest, 1 AS k FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, sha256(CASE WHEN o.digest IS NULL THEN f.digest WHEN o.before THEN o.digest || f.digest ELSE f.digest || o.digest END), f.k + 1
  FROM folded f JOIN ordered o ON o.doc_id = f.doc_id AND o.leaf = f.leaf AND o.k = f.k
), last AS (
  SELECT doc_id, leaf, arg_max(digest, k) AS folded_root FROM folded GROUP BY doc_id, leaf
), proof AS (
  SELECT doc_id, leaf, sha256(coalesce(string_agg(digest, '' ORDER BY k) FILTER (WHERE digest IS NOT NULL), '')) AS proof_sha256 FROM ordered GROUP BY doc_id, leaf
), whole AS (
  SELECT digest AS root FROM upper_node WHERE wide = 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang JOIN last USING (doc_id, leaf) LEFT JOIN proof USING (doc_id, leaf) CROSS JOIN whole
"""
