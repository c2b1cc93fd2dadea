"""A Merkle manifest of a dataset: leaves hash rows, a tree a partition and one over the partitions' roots, built by joins.

H is SHA-256 of its inputs end to end, digests as lower-case hex text. A level's nodes stand in runs of FANOUT consecutive ones
(the last may be shorter, even one node), and each run becomes the H of its nodes. At every level each node is joined by equality
with its siblings, whose indices are computed: index XOR 1 for two, offsets of the slot for more; the row in slot zero of each
run then gives the parent. A tree of n leaves takes log(n) levels, each a fanout-th of the one below, so all levels together
shuffle little more than twice the lowest. Siblings are handed down from the roots in the same way, a join a level.

No key is hot: (tree, index) names one node. Leaves get their index from a sort by range (common.placed), so no partition of
the dataset goes through one task. Digests are kept as 32 bytes.

A null cell is `-`; the null partition is a tree of its own and comes first. Rows with a null id come first in theirs; rows that
repeat an id stand in the order of their digests, so equal rows may change places without a change of any root. An empty table
has no leaves and no root: no rows. Further columns are ignored; a column's name can't clash, as cells are read into new ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import look_up, materialise, placed

FANOUT = 2
#: Siblings are written down after so many levels of joins.
STEP = 6


def _h(*parts: Column) -> Column:
    """H of digests, as bytes."""
    return F.unhex(F.sha2(F.concat(*(F.lower(F.hex(p)) for p in parts)), 256))


def leaf(cells: Sequence[Column]) -> Column:
    """H of a row: each cell its length in UTF-8 bytes, a colon and its text; `-` if null."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cells]
    return F.unhex(F.sha2(F.concat(*written), 256))


def _paired(level: DataFrame, fanout: int) -> DataFrame:
    """level(tree, at, n, digest, ...) with before and after: the digests of the run's other nodes, end to end."""
    slot = F.col("at") % fanout
    if fanout == 2:
        other = [F.col("at").bitwiseXOR(F.lit(1))]
    else:
        other = [F.col("at") - slot + (slot + k) % fanout for k in range(1, fanout)]
    found = level
    for k, at in enumerate(other):
        sibling = level.select("tree", F.col("at").alias(f"_at{k}"), F.col("digest").alias(f"_d{k}"))
        found = found.withColumn(f"_at{k}", at).join(sibling, ["tree", f"_at{k}"], "left")
    ordered = F.array_sort(F.array(*(F.struct(F.col(f"_at{k}").alias("at"), F.col(f"_d{k}").alias("d")) for k in range(len(other)))))
    joined = lambda keep: F.aggregate(F.filter(ordered, lambda x: x["d"].isNotNull() & keep(x["at"])), F.lit(b""), lambda a, x: F.concat(a, x["d"]))
    if fanout == 2:
        sides = F.when(slot == 1, F.col("_d0")), F.when(slot == 0, F.col("_d0"))
    else:
        sides = joined(lambda at: at < F.col("at")), joined(lambda at: at > F.col("at"))
    none = F.lit(b"")
    return found.select(*level.columns, F.coalesce(sides[0], none).alias("before"), F.coalesce(sides[1], none).alias("after"))


def climb(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """leaves(tree, at, n, digest, ...), n being the tree's number of leaves -> each level's nodes, with before and after if they have a run."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, level = [], leaves
    while most > 1:
        paired = materialise(_paired(level, fanout), f"{name}-level")
        levels.append(paired)
        parents = paired.filter((F.col("at") % fanout == 0) & (F.col("n") > 1))
        above = F.ceil(F.col("n") / fanout).cast("long")
        made = parents.select("tree", (F.col("at") / fanout).cast("long").alias("at"), above.alias("n"), _h(F.col("digest"), F.col("after")).alias("digest"))
        level, most = made, -(-most // fanout)
    return [*levels, materialise(level.withColumns({"before": F.lit(b""), "after": F.lit(b"")}), f"{name}-level")]


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of the nodes that stand alone in their level."""
    return reduce(DataFrame.unionAll, (x.filter("n = 1").select("tree", "digest") for x in levels))


def paths(levels: list[DataFrame], above: DataFrame, fanout: int, name: str) -> DataFrame:
    """The lowest level's rows with path, the runs' other nodes from there to the root; above(tree, path) goes on from each root."""
    step = F.struct("before", "after")
    found = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        kept = [c for c in level.columns if c not in ("before", "after", "digest")] if k == 0 else ["tree", "at"]
        top = level.filter("n = 1").join(above, "tree").select(*kept, *(["digest"] if k == 0 else []), "path")
        if found is None:
            found = top
        else:
            over = found.select("tree", F.col("at").alias("_over"), F.col("path").alias("_path"))
            own = level.filter("n > 1").withColumn("_over", (F.col("at") / fanout).cast("long")).join(over, ["tree", "_over"])
            own = own.select(*kept, *(["digest"] if k == 0 else []), F.concat(F.array(step), F.col("_path")).alias("path"))
            found = own.unionAll(top)
        if k and k % STEP == 0:
            found = materialise(found, f"{name}-paths")
    return found


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda own, x: _h(x["before"], own, x["after"]))


def proof(path: Column) -> Column:
    """H of the siblings, level by level, left to right, as hex text."""
    told = F.aggregate(path, F.lit(b""), lambda seen, x: F.concat(seen, x["before"], x["after"]))
    return F.sha2(F.lower(F.hex(told)), 256)


def manifest(rows: DataFrame, id_col: str, by: str, cells: dict[str, Column], fanout: int = FANOUT) -> DataFrame:
    """A row per row: id, partition, subroot, root, path (structs of digests before and after), and leaves, a digest for each of `cells`.

    cells maps names to digests of a row (see leaf()); the first makes the tree, the others are carried along as they are.
    """
    names = list(cells)
    own = F.struct(*(c.alias(k) for k, c in cells.items()))
    held = rows.select(F.col(id_col).alias("id"), F.col(by).isNotNull().alias("known"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("part"), own.alias("leaves"))
    held = held.withColumn("digest", F.col(f"leaves.{names[0]}"))
    set_out = materialise(placed(held, ["known", "part"], [F.col("id").asc_nulls_first(), F.col("digest").asc()], "merkle"), "merkle-placed")
    trees = set_out.groupBy("known", "part").agg(F.count("*").alias("n"))
    trees = materialise(placed(trees, [], [F.col("known").asc(), F.col("part").asc()], "merkle-trees").withColumnRenamed("_place", "tree"), "merkle-trees")
    found = look_up(set_out, trees, ["known", "part"], "n", set_out.count(), F.col("_place"))
    lower = climb(found.select("tree", F.col("_place").alias("at"), "n", "digest", "id", "known", "part", "leaves"), fanout, "merkle")
    lone = materialise(roots(lower), "merkle-subroots")
    count = lone.count()
    upper = climb(lone.select(F.lit(0).alias("tree"), F.col("tree").alias("at"), F.lit(count).cast("long").alias("n"), "digest"), fanout, "merkle-upper")
    start = rows.sparkSession.createDataFrame([(0, [])], "tree int, path array<struct<before: binary, after: binary>>")
    over = paths(upper, start, fanout, "merkle-upper").select(F.col("at").alias("tree"), "path", F.col("digest").alias("subroot"))
    over = materialise(over, "merkle-over")
    # the subroot goes along as the first step of the path above, so that it meets its rows without a join of its own
    marked = over.select("tree", F.concat(F.array(F.struct(F.col("subroot").alias("before"), F.lit(None).cast("binary").alias("after"))), F.col("path")).alias("path"))
    full = paths(lower, marked, fanout, "merkle")
    steps = F.filter("path", lambda x: x["after"].isNotNull())
    subroot = F.element_at(F.filter("path", lambda x: x["after"].isNull()), 1)["before"]
    root = roots(upper).first()
    top = F.lit(bytes(root.digest) if root else None).cast("binary")
    return full.select(F.col("id").alias(id_col), F.when(F.col("known"), F.col("part")).alias(by), "leaves", subroot.alias("subroot"), top.alias("root"), steps.alias("path"))


def verify(found: DataFrame, name: str) -> DataFrame:
    """manifest() with folded_root, that of the path from the named leaf digest, and verified: whether it is the root."""
    folded = fold(F.col("leaves")[name], F.col("path"))
    return found.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
