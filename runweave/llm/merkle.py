"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Rows get their place in their group from a range sort (place in the part of the file, plus the counts of the parts
before), so no group is one task. Trees grow by blocks of BLOCK nodes, a few levels a step, into a stored table of
nodes (group, level, place, digest). Proofs are coordinate lookups: from its place and the group's size each node
explodes the coordinates of the siblings it needs up to the next step's level, joins the table of nodes, puts the
digests in order, and takes the rest of the proof from the node above, whose proof is looked up once for the whole
block. A digest is folded along its proof to a root.

H is the lowercase hex SHA-256 of its inputs, one after another, digests as hex text. A leaf is H over the fields,
`-` for null, else bytes in UTF-8, `:`, value. Within a group, rows ascend by id (null first), rows of one id by leaf;
repeated rows are leaves each. Groups ascend bytewise, null first. Long texts are hashed where they are read and never
move. Columns that are neither id, group nor field are left out. An empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Most nodes of a block that one step takes together (a run, where runs are longer).
BLOCK = 16

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(fields: list[Column]) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A key that is never null and ascends as the groups do, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows, with idx (their place in their group in this order, from 0) and n (rows of the group)."""
    keys = [group, *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = common.materialise(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = placed.groupBy(group, part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = common.materialise(parts.select(F.col(group).alias("of"), F.col("part").alias("of_part"), (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n")))
    found = placed.join(starts, (F.col(group) == F.col("of")) & (part == F.col("of_part")))
    return found.select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")


@dataclass
class Tree:
    """nodes: (grp, n, level, idx, digest) of all levels, n being the leaves of the group. most: leaves of the largest group."""

    nodes: DataFrame
    size: int
    most: int

    @property
    def steps(self) -> list[tuple[int, int]]:
        """Levels (from, to) of each step. There is one step at least."""
        out = [(0, _levels(self.size))]
        while self.size ** out[-1][1] < self.most:
            out.append((out[-1][1], out[-1][1] + _levels(self.size)))
        return out

    def tops(self) -> DataFrame:
        """(grp, n, digest): the root of each group."""
        return self.nodes.where(F.col("level") == self.height(F.col("n"))).select("grp", "n", "digest")

    def height(self, n: Column) -> Column:
        """The level of the root of a group of n leaves."""
        return sum((F.when(n > self.size**level, 1).otherwise(0) for level in range(self.steps[-1][1])), F.lit(0))


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by))


def _levels(size: int) -> int:
    levels = 1
    while size ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def build(leaves: DataFrame, size: int = 2) -> Tree:
    """The tree over leaves (grp, n, idx, digest), a stored table; `size` consecutive nodes become one."""
    if size < 2:
        raise ValueError("at least two nodes become one")
    tree = Tree(leaves.select("grp", "n", F.lit(0).alias("level"), "idx", "digest"), size, leaves.agg(F.max("n")).first()[0] or 0)
    below = tree.nodes

    def parents(digests: Column) -> Column:
        runs = F.sequence(F.lit(0), _div(F.size(digests) - 1, size).cast("int"))
        return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(digests, k * size + 1, F.lit(size)), ""), 256))

    for low, high in tree.steps:
        blocks = below.groupBy("grp", "n", _div(F.col("idx"), size ** (high - low)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("own"))
        rows, made = blocks.withColumn("level0", F.col("own.digest")), []
        for k in range(1, high - low + 1):
            rows = rows.withColumn(f"level{k}", parents(F.col(f"level{k - 1}")))
            numbered = _numbered(f"level{k}", low + k, F.col("block") * size ** (high - low - k))
            made.append(F.when(F.col("n") > size ** (low + k - 1), numbered).otherwise(F.slice(numbered, 1, 0)))
        step = common.materialise(rows.select("grp", "n", F.inline(F.concat(*made))))
        tree.nodes = tree.nodes.unionByName(step)
        below = step.where(F.col("level") == high)
    return tree


def _numbered(digests: str, level: int, first: Column) -> Column:
    return F.transform(digests, lambda digest, i: F.struct(F.lit(level).alias("level"), (first + i).alias("idx"), digest.alias("digest")))


def proofs(tree: Tree, ends: DataFrame) -> DataFrame:
    """(grp, idx, path, top) of each leaf: path has what stands left and right of the digest on each level, from the leaf up.

    ends: (grp, n, path, top), how the path goes on above each group's root, and what top to report.
    """
    upper, size = None, tree.size
    for low, high in reversed(tree.steps):
        own = tree.nodes.where((F.col("level") == low) & ((F.col("n") > size**low) | F.lit(low == 0))).select("grp", "n", "idx")
        need = F.concat(*(_siblings(level, low, size) for level in range(low, high)))
        wanted = own.select("grp", "n", "idx", F.inline_outer(need))
        side = tree.nodes.where(F.col("level").between(low, high - 1)).select(F.col("grp").alias("of"), F.col("level").alias("of_level"), F.col("idx").alias("of_idx"), "digest")
        found = wanted.join(side, (F.col("grp") == F.col("of")) & (F.col("at_level") == F.col("of_level")) & (F.col("at") == F.col("of_idx")), "left")
        several = found.groupBy("grp", "n", "idx").agg(F.array_sort(F.collect_list(F.struct("at_level", "at", "before", "digest"))).alias("near"))
        steps = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda level: F.struct(_digests(level, True).alias("left"), _digests(level, False).alias("right")))
        steps = F.slice(steps, F.lit(1), F.greatest(F.least(tree.height(F.col("n")), F.lit(high)) - low, F.lit(0)))
        block = _div(F.col("idx"), size ** (high - low))
        last = (tree.height(F.col("n")) <= high) & ((F.col("n") > size**low) | F.lit(low == 0))
        above = ends.where(last).select("grp", F.lit(0).cast("long").alias("idx"), "path", "top")
        above = (above if upper is None else upper.unionByName(above)).select(F.col("grp").alias("up"), F.col("idx").alias("up_idx"), F.col("path").alias("rest"), "top")
        joined = several.join(above, (F.col("grp") == F.col("up")) & (block == F.col("up_idx")))
        upper = common.materialise(joined.select("grp", "idx", F.concat(steps, F.col("rest")).alias("path"), "top"))
    return upper


def _siblings(level: int, low: int, size: int) -> Column:
    """Coordinates of the siblings that a node (of level low, place idx) needs on a level; none from the root's level on."""
    place = _div(F.col("idx"), size ** (level - low))
    first = place - place % size
    nodes = _div(F.col("n") + (size**level - 1), size**level)
    run = F.array_except(F.sequence(first, F.least(first + size, nodes) - 1), F.array(place))
    rows = F.transform(run, lambda at: F.struct(F.lit(level).alias("at_level"), at.alias("at"), (at < place).alias("before")))
    return F.when(F.col("n") > size**level, rows).otherwise(F.slice(rows, 1, 0))


def _digests(level: Column, before: bool) -> Column:
    here = F.filter("near", lambda x: (x.at_level == level) & (x.before == before))
    return F.array_join(F.transform(here, lambda x: x.digest), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda held, step: F.sha2(F.concat(step.left, held, step.right), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, size: int = 2, claims: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, folded_root, verified) of each row.

    claims: other values of fields, as expressions over docs. Each row's leaf, with its claims in place, is folded
    along the path of the original; verified says whether this gives the root. Without claims every row is verified.
    """
    values = {f: F.col(f) for f in fields}
    leaf, claimed = (leaf_of([v[f] for f in fields]) for v in (values, values | (claims or {})))
    other = claimed if claims else F.lit(None).cast("string")
    narrow = docs.select(group_key(F.col(group_col)).alias("grp"), F.col(id_col).alias("id"), leaf.alias("digest"), other.alias("other"))
    narrow = common.materialise(narrow.withColumn("other", F.nullif("other", "digest")))
    leaves = common.materialise(ranked(narrow, "grp", "id", "digest"))
    trees = build(leaves, size)
    tops = common.materialise(trees.tops().withColumn("all", F.lit("")))
    over = common.materialise(ranked(tops.withColumnsRenamed({"digest": "top", "n": "leaves"}), "all", "grp"))
    whole = build(over.select(F.col("all").alias("grp"), "n", "idx", F.col("top").alias("digest")), size)
    root = (whole.tops().first() or [None] * 3)[2]
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    upper = proofs(whole, whole.tops().select("grp", "n", nothing.alias("path"), F.lit("").alias("top")))
    ends = over.select(F.col("grp").alias("of_grp"), "leaves", F.col("idx").alias("of_idx"), F.col("top").alias("subroot")).join(upper, F.col("of_idx") == F.col("idx"))
    paths = proofs(trees, common.materialise(ends.select(F.col("of_grp").alias("grp"), F.col("leaves").alias("n"), "path", F.col("subroot").alias("top"))))
    paths = paths.select(F.col("grp").alias("of"), F.col("idx").alias("of_idx"), "path", "top")
    rows = leaves.join(paths, (F.col("grp") == F.col("of")) & (F.col("idx") == F.col("of_idx")))
    rows = rows.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "path", folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    rows = manifest(common.documents(spark, sf_dir), claims={"n_chars": F.col("n_chars") + F.when(changed, 1).otherwise(0)})
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step.left, step.right)), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: xor(crc >> 8, list_reduce([xor(crc & 255, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda v, one: CASE WHEN v & one = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))) % 7 = 0 AS changed
  FROM documents
), f AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, n_chars::VARCHAR AS old, (n_chars + CASE WHEN changed THEN 1 ELSE 0 END)::VARCHAR AS new
  FROM c
), h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(old) || ':' || old, '-') || body) AS leaf, sha256(head || coalesce(strlen(new) || ':' || new, '-') || body) AS other FROM f
), d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h
), nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM d
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n
), tops AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), above AS (
  SELECT 0 AS level, i, n, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 2, n
), walk AS (
  SELECT doc_id, lang, leaf, 0 AS level, i, n, '' AS proof, other AS fold FROM d
  UNION ALL
  SELECT doc_id, w.lang, leaf, w.level + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN s.h IS NULL THEN fold WHEN w.i % 2 = 1 THEN s.h || fold ELSE fold || s.h END)
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1
), top_walk AS (
  SELECT doc_id, leaf, subroot, 0 AS level, t.i, t.n, proof, fold FROM walk w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, w.level + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN s.h IS NULL THEN fold WHEN w.i % 2 = 1 THEN s.h || fold ELSE fold || s.h END)
  FROM top_walk w LEFT JOIN above s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM top_walk JOIN above r ON r.n = 1 WHERE top_walk.n = 1
"""
