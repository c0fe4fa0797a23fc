"""A Merkle manifest of a table: a hash tree for each language, one tree over their roots, and a proof for every row.

Trees are built a block of levels at a time: a block holds the nodes under one ancestor, at most ``arity ** stride`` of
them, so a group is bounded and a table of n rows needs log(n) / stride rounds. What is stored is one row for each node of a block's
lowest level: its id, its ancestor's id (the link to the parent block's row) and, level by level, the digests (binary) of the run's other
nodes to its left and right. A recursive query climbs these links from every leaf at once, appends the siblings to the proof and
folds the (tampered) leaf on the way; each step joins with a table that is smaller by the size of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import dropped, free_names, scratch, stored

ARITY, STRIDE, DIVISOR = 2, 10, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROUND = 56  # an id is a node's round, shifted, and the rank of its first leaf
_TOP = 64  # rounds of the tree over the languages' roots start here


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def leaf_digests(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, lang, leaf and tampered: the leaf with 1 added to n_chars where ``divisor`` divides the CRC-32 of the decimal
    doc_id, else null. A null n_chars stays null; a row without a doc_id is not tampered with."""
    own = [F.col(c) for c in FIELDS]
    other = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % divisor == 0
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), row_digest(*own).alias("leaf"), F.when(hit, row_digest(*other)).alias("tampered"))


def _join(a: Column) -> Column:
    return F.array_join(a, "")


def _block(nodes: DataFrame, arity: int, stride: int, round_: int) -> DataFrame:
    """The nodes (tree, size, pos, hash, payload) of one round in blocks: every block's members with their siblings, its digest,
    and whether that is the tree's root."""
    span = arity**stride
    members = F.array_sort(F.collect_list(F.struct("pos", "hash", "payload")))
    grouped = nodes.groupBy("tree", "first", "size", F.floor(F.col("pos") / span).cast("long").alias("block")).agg(members.alias("m"))
    # levels of the tree above this round, at most a block's worth
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(stride)), F.struct(F.col("size").alias("n"), F.lit(0).alias("h")),
                         lambda s, _: F.when(s["n"] > 1, F.struct(F.ceil(s["n"] / arity).cast("long").alias("n"), (s["h"] + 1).alias("h"))).otherwise(s))
    grouped = grouped.withColumn("up", levels).withColumn("h", F.col("up")["h"])
    upper = lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / arity).cast("int") - 1), lambda i: F.sha2(_join(F.slice(a, i * arity + 1, F.lit(arity))), 256))
    built = F.aggregate(F.sequence(F.lit(1), F.lit(stride)), F.array(F.transform("m", lambda x: x["hash"])),
                        lambda acc, i: F.when(i <= F.col("h"), F.concat(acc, F.array(upper(F.element_at(acc, -1))))).otherwise(acc))
    return grouped.withColumns({"levels": built}).withColumns({"digest": F.element_at("levels", -1)[0], "done": F.col("up")["n"] <= 1, "round": F.lit(round_)})


def _steps(blocks: DataFrame, arity: int, stride: int, round_: int, up: Column) -> DataFrame:
    """One row for each node of the round: id, up (the id of its ancestor's row, null at the end), sides and the node's own columns."""
    span = arity**stride

    def climbed(i: Column) -> Column:
        def side(level: Column, j: Column) -> Column:
            at = F.floor(i / F.pow(F.lit(float(arity)), j)).cast("int")
            run = F.floor(at / arity).cast("int") * arity
            return F.struct(F.unhex(_join(F.slice(level, run + 1, at - run))).alias("before"), F.unhex(_join(F.slice(level, at + 2, run + arity - at - 1))).alias("after"))

        return F.transform(F.slice("levels", F.lit(1), F.col("h")), side)

    scale = span**round_ if round_ < _TOP else span ** (round_ - _TOP)
    rows = F.transform("m", lambda x, i: F.struct((F.lit(round_ << _ROUND) + F.col("first") + x["pos"] * scale).alias("id"), x["hash"].alias("hash"), x["payload"].alias("payload"), climbed(i).alias("sides")))
    return blocks.select("tree", up.alias("up"), F.inline(rows))


def _climb_tree(nodes: DataFrame, arity: int, stride: int, first_round: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored steps of every round of the trees, and (tree, digest) of their roots; ``top`` in a root's row is where it goes on."""
    span, round_, steps, roots = arity**stride, first_round, [], []
    more = True
    while more:
        blocks = stored(_block(nodes, arity, stride, round_), f"{name}-blocks")
        scale = span ** (round_ - first_round + 1)
        onward = F.lit((round_ + 1) << _ROUND) + F.col("first") + F.col("block") * scale
        up = F.when(~F.col("done"), onward)
        steps.append(stored(_steps(blocks, arity, stride, round_, up), f"{name}-steps"))
        # digests alone stay of a block, whose members are in the steps
        whole, blocks = blocks, stored(blocks.select("tree", "first", "size", "block", "digest", "done"), f"{name}-digests")
        dropped(whole)
        roots.append(blocks.where("done").select("tree", "digest"))
        rest = blocks.where("not done")
        more = not rest.isEmpty()
        nodes = rest.select("tree", "first", F.ceil(F.col("size") / span).cast("long").alias("size"), F.col("block").alias("pos"), F.col("digest").alias("hash"), F.lit(None).cast("string").alias("payload"))
        round_ += 1
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return steps, found


#: The ascent. The anchor climbs the block of the leaves, which they carry themselves; every step climbs one block more.
_CLIMB = """WITH RECURSIVE climb(doc_id, tree, leaf, node, proof, folded) MAX RECURSION LEVEL 200 AS (
  SELECT doc_id, tree, unhex(leaf), up, {proof_leaf}, unhex({fold_leaf})
  FROM {leaves}
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, n.up, c.proof || {proof}, unhex({fold})
  FROM climb c JOIN {nodes} n ON c.node = n.id)
SELECT doc_id, tree, lower(hex(leaf)) AS leaf, sha2(lower(hex(proof)), 256) AS proof_sha256, lower(hex(folded)) AS folded FROM climb WHERE node IS NULL"""
_PROOF = "aggregate({sides}, unhex(''), (p, s) -> p || s.before || s.after)"
_FOLD = "aggregate({sides}, {start}, (h, s) -> sha2(lower(hex(s.before)) || h || lower(hex(s.after)), 256))"


def _ascend(spark: SparkSession, leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proof and folded digest of every leaf. The engine's limit on the rows of a recursion is lifted while this runs."""
    stem = scratch(spark, "x").rsplit("-", 1)[-1]
    names = {"leaves": f"leaves_{stem}", "nodes": f"nodes_{stem}"}
    parts = {"proof_leaf": _PROOF.format(sides="sides"), "proof": _PROOF.format(sides="n.sides"), "fold_leaf": _FOLD.format(sides="sides", start="coalesce(tampered, leaf)"), "fold": _FOLD.format(sides="n.sides", start="lower(hex(c.folded))")}
    leaves.createOrReplaceTempView(names["leaves"])
    nodes.createOrReplaceTempView(names["nodes"])
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        return stored(spark.sql(_CLIMB.format(**names, **parts)), "proofs")
    finally:
        spark.conf.set(key, before)
        for view in names.values():
            spark.catalog.dropTempView(view)


def manifest(docs: DataFrame, arity: int = ARITY, stride: int = STRIDE, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    Leaves of a language stand by doc_id, null first; rows of equal doc_id by their digests. Runs of ``arity`` nodes become their
    digest until one is left; a lone leaf is its language's root, and a lone language's root the root. Languages stand
    bytewise, null first and apart from the empty one. A null text, source, lang or n_chars is written as ``-``; columns
    beside these and doc_id are not read; an empty table has no rows.
    """
    spark = docs.sparkSession
    row, = free_names(docs, "row")
    flat = stored(leaf_digests(docs, divisor), "leaves")
    ranked = numbered(flat.withColumn(row, F.monotonically_increasing_id()), [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), "leaf", row], "rank").drop(row)  # the row's number tells equal ones apart
    dropped(flat)
    langs = ranked.groupBy("lang").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    # a tree is known by the rank of its first leaf; languages are joined null-safe, then forgotten
    trees = stored(langs, "trees")
    placed = ranked.join(trees, ranked["lang"].eqNullSafe(trees["lang"])).select(
        F.col("first").alias("tree"), "first", "size", (F.col("rank") - F.col("first")).alias("pos"), F.col("leaf").alias("hash"),
        F.to_json(F.struct("doc_id", "tampered")).alias("payload"))
    steps, subroots = _climb_tree(placed, arity, stride, 0, "lang")
    dropped(ranked)
    order = numbered(subroots, ["tree"], "pos")
    n_trees = order.count()
    top = stored(order.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("first"), F.lit(n_trees).cast("long").alias("size"), "pos", F.col("digest").alias("hash"), F.col("tree").cast("string").alias("payload")), "subroots")
    top_steps, roots = _climb_tree(top, arity, stride, _TOP, "top")
    entrance = top_steps[0].select(F.col("payload").cast("long").alias("tree"), F.col("id").alias("entry"), F.col("hash").alias("subroot"))
    # the last row of a language's path goes on at its root's place in the upper tree
    entered = [s.join(entrance.select("tree", "entry"), "tree").withColumn("up", F.coalesce("up", "entry")).drop("entry") for s in steps]
    leaves = entered[0].select("tree", "up", "sides", F.col("hash").alias("leaf"), F.from_json("payload", docs.select("doc_id").schema.add("tampered", "string")).alias("p")).select("tree", "up", "sides", "leaf", "p.*")
    nodes = None
    for s in [*entered[1:], *top_steps]:
        own = s.select("id", "up", "sides")
        nodes = own if nodes is None else nodes.unionByName(own)
    proofs = _ascend(spark, leaves, stored(nodes, "nodes"))
    dropped(steps[0])
    root = [r["digest"] for r in roots.collect()]  # one digest
    out = proofs.join(entrance.select("tree", "subroot"), "tree")
    folded = F.col("folded")
    root_ = F.lit(root[0] if root else None)
    return out.select("doc_id", "leaf", "subroot", root_.alias("root"), "proof_sha256", folded.alias("folded_root"), (folded == root_).alias("verified"))
