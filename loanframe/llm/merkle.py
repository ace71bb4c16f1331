"""Merkle manifest of a dataset: an octopus multiproof for every block of leaves.

A row is a leaf: the SHA-256 of its fields.  The leaves of a group, in order of
their ids, are the bottom of the group's tree; every ``arity`` consecutive nodes
become the hash of their digests, until one is left (the subroot).  The
subroots, in order of the groups, are the bottom of the top tree, whose last node
is the root.  Digests are lowercase hex text.

1. Leaves are hashed, range-partitioned by group and id and numbered through.
   Consecutive numbers form blocks of ``block`` leaves, so a group that holds a
   third of all rows is spread over many blocks, and small groups share one.
2. Each block hashes up to its highest complete nodes.  The nodes above them
   are made in rounds of ``step`` levels, a bounded subtree for each task.
3. Each block names the smallest set of nodes that its leaves' proofs need and
   it can't derive (siblings at the two ends of each level, in the trees of its
   groups and in the top tree).  One join fetches them for all blocks at once.
4. With these a block derives all interior nodes that its proofs share, once,
   and expands and folds the proof of each leaf locally.

Defined results: a null field is hashed as ``-``, another as its UTF-8 byte
count, ``:`` and its value; null groups and null ids come first; rows that
repeat an id follow each other by digest; an empty table gives no rows; columns
that are not named as fields, group or id are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import lookup_join, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
BLOCK = 1 << 14  # leaves whose proofs are expanded together
STEP = 12  # levels that one round makes: 4096 nodes a task at arity 2
TOP = -1  # number of the top tree; the groups' trees have 0, 1, ...
NODE = "tree long, size long, level int, place long, digest string"
_NODE = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def widths(leaves: int, arity: int) -> list[int]:
    """Nodes on each level of a tree."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def crown(nodes: list[str], first: int, leaves: int, arity: int, every: bool = False) -> list[tuple[int, int, str]]:
    """(level, place, digest) of the highest nodes that consecutive leaves, from place ``first``, determine, or of every one."""
    out = []
    for level, width in enumerate(widths(leaves, arity)):
        end = first + len(nodes)
        lo = -(-first // arity) * arity
        hi = end if end == width else end // arity * arity  # the last run of a level may be short
        if width == 1 or lo >= hi:
            return out + [(level, first + i, x) for i, x in enumerate(nodes)]
        some = range(first, end) if every else (*range(first, lo), *range(hi, end))
        out += [(level, i, nodes[i - first]) for i in some]
        nodes = [digest(nodes[i - first:min(i + arity, hi) - first]) for i in range(lo, hi, arity)]
        first = lo // arity
    return out


def missing(first: int, end: int, leaves: int, arity: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that the proofs of the leaves first..end - 1 need beside what these determine."""
    out = []
    for level, width in enumerate(widths(leaves, arity)[:-1]):
        lo, hi = first // arity * arity, min(-(-end // arity) * arity, width)
        out += [(level, i) for i in (*range(lo, first), *range(end, hi))]
        first, end = lo // arity, -(-hi // arity)
    return out


def climb(nodes: list[str], first: int, leaves: int, arity: int, fetched: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """(first place, nodes) of each level, whole runs, from consecutive leaves and the fetched nodes."""
    out = []
    for level, width in enumerate(widths(leaves, arity)):
        if width == 1:
            return [*out, (0, nodes)]
        end, lo = first + len(nodes), first // arity * arity
        hi = min(-(-end // arity) * arity, width)
        nodes = [fetched[level, i] for i in range(lo, first)] + nodes + [fetched[level, i] for i in range(end, hi)]
        out.append((lo, nodes))
        nodes = [digest(nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        first = lo // arity
    return out


def expand(levels: list[tuple[int, list[str]]], place: int, arity: int, node: str) -> tuple[list[str], str]:
    """(siblings from the bottom up, what ``node`` in that place folds to)."""
    siblings = []
    for first, nodes in levels[:-1]:
        run, at = place // arity * arity - first, place % arity
        others = nodes[run:run + arity]
        others[at] = node
        node = digest(others)
        siblings += nodes[run:run + at] + nodes[run + at + 1:run + arity]
        place //= arity
    return siblings, node


def _field(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(_field, cols)), 256)


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``pos``, their place in the whole order (from 0): range partitions, numbered from their files."""
    kept = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("at", F.monotonically_increasing_id()), name)
    kept = kept.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth")).drop("at")
    per = kept.groupBy("part").count()  # a row for each partition that was written
    base = per.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    return lookup_join(kept, base, ["part"], "inner").withColumn("pos", F.col("base") + F.col("nth")).drop("part", "base", "nth")


def _spans(groups: DataFrame, block: int) -> DataFrame:
    """(block, tree, first, size): the trees that have leaves in each block."""
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))
    return groups.select(F.explode(blocks).alias("block"), "tree", "first", "size")


def _leaf_runs(rows: pa.Table, spans: pa.Table) -> list[tuple[int, int, int, int, int]]:
    """(tree, size, place of the first leaf, first row, end row) for the trees of a block; rows stand by pos."""
    low, n = rows["pos"][0].as_py(), rows.num_rows
    out = []
    for s in spans.select(["tree", "first", "size"]).to_pylist():
        a, b = max(s["first"], low), min(s["first"] + s["size"], low + n)
        out.append((s["tree"], s["size"], a - s["first"], a - low, b - low))
    return sorted(out)


def _crowns(leaves: DataFrame, spans: DataFrame, arity: int, every: bool) -> DataFrame:
    def run(rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        digests = rows["leaf"].to_pylist()
        out = [(tree, size, *x) for tree, size, first, a, b in _leaf_runs(rows, spans) for x in crown(digests[a:b], first, size, arity, every)]
        return _node_table(out)

    return (leaves.select("block", "pos", "leaf").groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, NODE))


def _above(top: int, arity: int):
    """The nodes up to level ``top`` above those given."""
    def run(rows: pa.Table) -> pa.Table:
        here: dict[int, dict[int, str]] = {}
        for r in rows.to_pylist():
            here.setdefault(r["level"], {})[r["place"]] = r["digest"]
        tree, size = rows["tree"][0].as_py(), rows["size"][0].as_py()
        out, sizes = [], widths(size, arity)
        for level in range(min(here), min(top, len(sizes) - 1)):
            some = here.get(level, {})
            for up in {i // arity for i in some} - here.get(level + 1, {}).keys():
                made = digest([some[i] for i in range(up * arity, min(up * arity + arity, sizes[level]))])
                here.setdefault(level + 1, {})[up] = made
                out.append((tree, size, level + 1, up, made))
        return _node_table(out)
    return run


def _node_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _NODE.types)], schema=_NODE)


def _tree_nodes(leaves: DataFrame, spans: DataFrame, most: int, arity: int, step: int, every: bool = False) -> DataFrame:
    """The highest complete nodes of the blocks (or every one), and all nodes above them; ``most`` leaves in a tree."""
    low = stored(_crowns(leaves, spans, arity, every), "merkle-crowns")
    nodes, height = low, len(widths(most, arity)) - 1
    for top in range(step, height + step, step):
        # Nodes below one node of level ``top`` meet in a task: arity ** step of them at most.
        above = F.floor(F.col("place") / F.pow(F.lit(arity), top - F.col("level")))
        made = stored(low.where(F.col("level") < top).withColumn("above", above).groupBy("tree", "above")
                      .applyInArrow(_above(top, arity), NODE), "merkle-nodes")
        nodes = nodes.unionByName(made)
        low = low.where(F.col("level") >= top).unionByName(made.where(F.col("level") == top))
    return nodes


def _requests(spans: DataFrame, trees: int, arity: int, block: int) -> DataFrame:
    """(block, tree, level, place) of the nodes that each block has to fetch."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(r["block"], r["tree"], *x) for x in missing(r["lo"], r["hi"], r["size"], arity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (
                pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["block", "tree", "level", "place"])

    start = F.col("block") * block
    own = spans.select("block", "tree", "size", F.greatest(start - F.col("first"), F.lit(0)).alias("lo"),
                       F.least(start + block - F.col("first"), F.col("size")).alias("hi"))
    top = spans.groupBy("block").agg(F.min("tree").alias("lo"), (F.max("tree") + 1).alias("hi")).select(
        "block", F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), "lo", "hi")
    return own.unionByName(top).mapInArrow(run, "block long, tree long, level int, place long")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             claims: dict[str, Column] | None = None, arity: int = ARITY, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """One row per document: id, group, leaf, claim, subroot, root, proof (siblings from the leaf up, through the
    subroot to the root), folded_root (what the claim folds to) and verified (it is the root).

    A claim is the leaf of the row with ``claims`` in place of its fields; by default the leaf itself."""
    spark = docs.sparkSession
    claimed = [(claims or {}).get(c, F.col(f"`{c}`")) for c in fields]
    hashed = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"),
                         leaf(*[F.col(f"`{c}`") for c in fields]).alias("leaf"), leaf(*claimed).alias("claim"))
    rows = stored(hashed.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()]
    leaves = _numbered(rows, order, "merkle-ordered").withColumn("block", F.floor(F.col("pos") / block))
    groups = stored(leaves.groupBy("group").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-groups")
    groups = stored(_numbered(groups.drop("group"), [F.col("first").asc()], "merkle-group-order").withColumnRenamed("pos", "tree"), "merkle-trees")
    trees, most = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    kind, group_kind = docs.schema[id_col].dataType, docs.schema[group_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("group", group_kind), *[T.StructField(c, T.StringType()) for c in (
        "leaf", "claim", "subroot")], T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("folded_root", T.StringType())])
    if not trees:
        return spark.createDataFrame([], schema).select("id", "group", "leaf", "claim", "subroot", F.lit("").alias("root"), "proof",
                                                        "folded_root", F.lit(True).alias("verified"))
    spans = stored(_spans(groups, block), "merkle-spans")
    nodes = _tree_nodes(leaves, spans, most, arity, step)
    # The subroots are the leaves of the top tree, made by the same steps. Its blocks are not those that ask for nodes, so every
    # one is kept.
    heights = F.expr(_height_sql(most, arity))
    subroots = nodes.where(F.col("level") == heights).select(F.col("tree").alias("pos"), F.col("digest").alias("leaf"))
    subroots = stored(subroots.withColumn("block", F.floor(F.col("pos") / block)), "merkle-subroots")
    one = spark.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("first"), F.lit(trees).cast("long").alias("size"))
    nodes = stored(nodes.unionByName(_tree_nodes(subroots, _spans(one, block), trees, arity, step, every=True)), "merkle-tree")
    root = nodes.where((F.col("tree") == TOP) & (F.col("level") == len(widths(trees, arity)) - 1)).first()["digest"]
    wanted = _requests(spans, trees, arity, block).join(nodes.select("tree", "level", "place", "digest").hint("merge"), ["tree", "level", "place"])
    none = F.lit(None)
    known = spans.select("block", "tree", "first", "size", none.cast("int").alias("level"), none.cast("long").alias("place"),
                         none.cast("string").alias("digest")).unionByName(
        wanted.select("block", "tree", none.cast("long").alias("first"), none.cast("long").alias("size"), "level", "place", "digest"))
    known = stored(known, "merkle-known")

    def prove(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        told = known["level"].is_valid()
        fetched: dict[int, dict[tuple[int, int], str]] = {}
        for r in known.filter(told).select(["tree", "level", "place", "digest"]).to_pylist():
            fetched.setdefault(r["tree"], {})[r["level"], r["place"]] = r["digest"]
        leaves, claims = rows["leaf"].to_pylist(), rows["claim"].to_pylist()
        runs = _leaf_runs(rows, known.filter(pa.compute.invert(told)))
        own = [climb(leaves[a:b], first, size, arity, fetched.get(tree, {})) for tree, size, first, a, b in runs]
        upper = climb([levels[-1][1][0] for levels in own], runs[0][0], trees, arity, fetched.get(TOP, {}))
        subroot, proof, folded = [], [], []
        for (tree, _, first, a, b), levels in zip(runs, own):
            above, _ = expand(upper, tree, arity, levels[-1][1][0])
            for i in range(a, b):
                below, node = expand(levels, first + i - a, arity, claims[i])
                proof.append(below + above)
                folded.append(expand(upper, tree, arity, node)[1])
            subroot += [levels[-1][1][0]] * (b - a)
        return pa.table({"id": rows["id"], "group": rows["group"], "leaf": rows["leaf"], "claim": rows["claim"],
                         "subroot": pa.array(subroot, pa.string()), "proof": pa.array(proof, pa.list_(pa.string())),
                         "folded_root": pa.array(folded, pa.string())})

    proven = leaves.select("block", "pos", "id", "group", "leaf", "claim").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(prove, schema)
    return proven.select("id", "group", "leaf", "claim", "subroot", F.lit(root).alias("root"), "proof", "folded_root",
                         (F.col("folded_root") == F.lit(root)).alias("verified"))


def _height_sql(most: int, arity: int) -> str:
    """SQL for the height of a tree of ``size`` leaves: one step for each power of the arity up to ``most``."""
    steps, power = [], 1
    while power < most:
        steps.append(f"cast(size > {power} as int)")
        power *= arity
    return " + ".join(steps) or "0"
