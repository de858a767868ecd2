"""Merkle manifest of a dataset, with proofs by pointer jumping.

A document is a leaf: the sha256 of its fields. Per source, leaves in order of their ids
are hashed in runs of ``FANOUT`` until one subroot is left; the subroots in order of the
sources are hashed to one root in the same way.

Places in a source come from a range partitioning and sums over its parts, so a source of
any size is spread over all tasks. A node above the leaves holds the way to an ancestor:
for each level the digests left and right of it. A round joins nodes to their ancestors,
which doubles the distance and puts the ways together, until all ways end at the root. The
at most ``FANOUT`` leaves of a run share the way of their parent and stay in one row with
it; they are unfolded at the end, which moves no row.

Defined cases: nulls are written ``-``; documents without a source are a source of their
own, before all others; equal and null ids have places by their leaves, nulls first; equal
rows are a leaf each; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlake.session import remove_folder, stage, staging_folder

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that may meet at one ancestor in a join before its key is salted.
ROWS_OF_KEY = 1 << 14
_TOP = "/"


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def _join(digests: Column) -> Column:
    return F.array_join(digests, "")


def field(column: Column) -> Column:
    value = column.cast("string")
    with_size = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    return F.coalesce(with_size, F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a document's fields, some of them changed."""
    return digest(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """``rows`` with their place ``idx`` in their tree and its size ``n``."""
    keys = ["tree", *order, "scan"]  # the last one parts equal rows among tasks
    rows = rows.withColumn("scan", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("scan")
    rows = stage(rows.withColumn("slot", F.monotonically_increasing_id()), name, folder)
    rows = rows.withColumn("part", F.shiftright("slot", 33))
    sizes = rows.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("slot").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(
        "tree",
        "part",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(tree).alias("n"),
    )
    idx = (F.col("slot") + F.col("shift")).alias("idx")
    return rows.join(sizes, ["tree", "part"]).select(*rows.drop("slot", "part").columns, idx, "n")


def _node(level: int, idx: Column) -> Column:
    return F.concat_ws("/", F.lit(level), idx, F.col("tree"))


def runs(items: DataFrame, *carried: str) -> DataFrame:
    """One row for each run of a tree: its members in order and their digest."""
    run = F.floor(F.col("idx") / FANOUT).alias("run")
    member = F.struct("idx", "digest", *carried)
    return items.groupBy("tree", "n", run).agg(F.sort_array(F.collect_list(member)).alias("members"))


def _above(members: Column) -> Column:
    return digest(_join(members.digest))


def climb(
    items: DataFrame, folder: str, name: str, most: int, level: int
) -> tuple[list[DataFrame], DataFrame]:
    """Hash items of trees with up to ``most`` items each to one.

    Items are (tree, n, idx, node, digest), at a level of their trees. Gives the ways from
    nodes to their parents, and the last node of each tree."""
    ways, tops = [], []
    while True:
        tops.append(items.where("n = 1").select("tree", "node", "digest"))
        if most <= 1:
            break
        level += 1
        made = stage(runs(items.where("n > 1"), "node"), f"{name}{level}", folder)
        parent = _node(level, F.col("run"))
        each = made.select(parent.alias("ancestor"), "members", F.posexplode("members").alias("at", "member"))
        ways.append(
            each.select(
                F.col("member.node").alias("node"),
                "ancestor",
                F.array(_step(F.col("members.digest"), F.col("at"))).alias("steps"),
            )
        )
        items = made.select(
            "tree",
            F.ceil(F.col("n") / FANOUT).alias("n"),
            F.col("run").alias("idx"),
            parent.alias("node"),
            _above(F.col("members")).alias("digest"),
        )
        most = -(-most // FANOUT)
    last = tops[0]
    for top in tops[1:]:
        last = last.union(top)
    return ways, last


def _step(digests: Column, at: Column) -> Column:
    """What stands left and right of the digest at a place."""
    return F.struct(
        _join(F.slice(digests, F.lit(1), at)).alias("left"),
        _join(F.slice(digests, at + 2, F.lit(FANOUT))).alias("right"),
    )


def fold(start: Column, steps: Column) -> Column:
    """The digest that ``start`` leads to."""
    return F.aggregate(steps, start, lambda below, step: digest(step.left, below, step.right))


def jump(ways: DataFrame, root: str, height: int, nodes: int, folder: str) -> DataFrame:
    """Ways to the root, from ways to parents of ``nodes`` nodes below a root at ``height``."""
    ways, distance = stage(ways, "ways0", folder), 1
    while distance < height:
        # An ancestor at this distance has up to FANOUT ** distance nodes below it.
        salts = max(1, min(FANOUT ** max(distance - 2, 0), nodes // ROWS_OF_KEY))
        short = ways.where(F.col("ancestor") != root)
        salt = F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt")
        upper = ways.join(short.select(F.col("ancestor").alias("node")).distinct(), "node", "left_semi")
        upper = upper.select(
            F.col("node").alias("ancestor"),
            F.col("ancestor").alias("further"),
            F.col("steps").alias("more"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"),
        )
        longer = short.select("*", salt).join(upper, ["ancestor", "salt"]).select(
            "node", F.col("further").alias("ancestor"), F.concat("steps", "more").alias("steps")
        )
        distance *= 2
        ways = stage(ways.where(F.col("ancestor") == root).union(longer), f"ways{distance}", folder)
    return ways


def manifest(documents: DataFrame, tampered: Column, altered_text: Column) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, steps, altered): each leaf's way to the root.

    ``altered`` is the leaf of a document that was tampered with: where ``tampered`` holds,
    its text is ``altered_text``. It is null elsewhere.
    """
    spark = documents.sparkSession
    folder = staging_folder(spark)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    changed = F.when(tampered, leaf(text=altered_text))
    made = documents.select(
        tree.alias("tree"), "source", "doc_id", leaf().alias("digest"), changed.alias("altered")
    )
    made = stage(made, "leaves", folder)
    leaves = numbered(made, ["doc_id", "digest"], folder, "leaf")
    whole = runs(leaves, "doc_id", "source", "altered")
    whole = whole.withColumn("node", _node(1, F.col("run")))
    # A lone leaf is its source's subroot; other runs are hashed.
    up = F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(_above(F.col("members")))
    whole = stage(whole.withColumn("digest", up), "runs", folder)
    found = whole.agg(F.max("n").alias("most"), F.count("*").alias("runs")).first()
    if not found["runs"]:
        remove_folder(spark, folder)
        return spark.createDataFrame([], _SCHEMA)
    parents = whole.select("tree", F.ceil(F.col("n") / FANOUT).alias("n"), F.col("run").alias("idx"), "node", "digest")
    most = -(-found["most"] // FANOUT)
    ways, subroots = climb(parents, folder, "level", most, 1)
    subroots = stage(subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("own"), "node", "digest"), "subroots", folder)
    sources = subroots.count()
    over, root = climb(numbered(subroots, ["own"], folder, "top"), folder, "over", sources, 0)
    root = root.first()
    every = None
    for way in ways + over:
        every = way if every is None else every.union(way)
    levels = len(ways) + len(over)
    if every is None:
        whole = whole.withColumn("steps", F.array().cast(_STEPS))
    else:
        every = jump(every, root["node"], levels, found["runs"] + sources, folder)
        whole = whole.join(every.select("node", "steps"), "node", "left")
        whole = whole.withColumn("steps", F.coalesce("steps", F.array().cast(_STEPS)))
    inside = sum(
        (F.col("n") > FANOUT ** (k + 1)).cast("int") for k in range(max(1, math.ceil(math.log(most + 1, FANOUT)) + 1))
    )
    whole = whole.withColumn("subroot", fold(F.col("digest"), F.slice("steps", F.lit(1), inside)))
    each = whole.select("*", F.posexplode("members").alias("at", "member"))
    first = F.array(_step(F.col("members.digest"), F.col("at")))
    steps = F.when(F.col("n") == 1, F.col("steps")).otherwise(F.concat(first, "steps"))
    return each.select(
        "member.doc_id",
        "member.source",
        F.col("member.digest").alias("leaf"),
        "subroot",
        F.lit(root["digest"]).alias("root"),
        steps.alias("steps"),
        "member.altered",
    )


_STEPS = "array<struct<left: string, right: string>>"
_SCHEMA = (
    "doc_id bigint, source string, leaf string, subroot string, root string, "
    f"steps {_STEPS}, altered string"
)


def verify(found: DataFrame) -> DataFrame:
    """The digest of each proof, and whether document and proof lead to the root."""
    siblings = F.transform("steps", lambda step: F.concat(step.left, step.right))
    folded = fold(F.coalesce("altered", "leaf"), F.col("steps"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(_join(siblings)).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT row, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS altered
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, n, idx // 16
), subroots AS (
  SELECT tree, level, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM tops WHERE n > 1 GROUP BY level, n, idx // 16
), every AS (
  SELECT tree, level, idx, n, digest FROM nodes
  UNION ALL SELECT '/', level, idx, n, digest FROM tops
), beside AS (
  SELECT tree, level, idx, n,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM every WINDOW run AS (PARTITION BY tree, level, idx // 16 ORDER BY idx)
), walk AS (
  SELECT row, tree, 0 AS level, idx, n, '' AS siblings, coalesce(altered, leaf) AS folded FROM placed
  UNION ALL
  SELECT w.row,
    CASE WHEN w.n > 1 THEN w.tree ELSE '/' END,
    CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.idx // 16 ELSE s.idx END,
    CASE WHEN w.n > 1 THEN (w.n + 15) // 16 ELSE s.n END,
    CASE WHEN w.n > 1 THEN w.siblings || b.before || b.after ELSE w.siblings END,
    CASE WHEN w.n > 1 THEN sha256(b.before || w.folded || b.after) ELSE w.folded END
  FROM walk w JOIN beside b ON b.tree = w.tree AND b.level = w.level AND b.idx = w.idx
    LEFT JOIN subroots s ON s.tree = w.tree
  WHERE w.n > 1 OR w.tree <> '/'
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root,
  sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM placed p JOIN subroots s USING (tree)
  JOIN walk w ON w.row = p.row AND w.tree = '/' AND w.n = 1
  JOIN tops t ON t.n = 1
"""
