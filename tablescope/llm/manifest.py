"""Operator 13, a Merkle manifest of a table: a persistent tree whose versions copy paths only.

The rows of a source are leaves in the order of their ids. `FAN` consecutive nodes become their parent, level by level, until one is left,
the subroot; the subroots of all sources form a tree of the same kind above. Work goes in aligned blocks of FAN**DEPTH nodes of one source: a
block's levels are built in one task and leave one node, which is a node of the next tier; so a tier costs one shuffle of
what the last one left, and a source with a third of all rows is as many blocks as it needs. On the way back every block gets
the siblings above it. A changed leaf makes a new version of the tree: inside its block it copies its ancestors and shares every other node,
and above it continues with the siblings that came down.
"""
from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ordered
from ..session import freeze

FAN, DEPTH = 16, 2
ASIDE = "array<struct<left:string,right:string>>"
ASIDE_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it goes into a leaf: `-` for NULL, else its length in UTF-8 bytes, `:` and itself."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


class Tree:
    """The levels of a block. `version` gives the nodes that a changed leaf copies; all others are those of the tree."""

    def __init__(self, leaves: list[str], height: int, fan: int) -> None:
        self.fan, self.levels = fan, [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i:i + fan])) for i in range(0, len(below), fan)])

    def aside(self, i: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf's ancestor in its run, level by level."""
        out = []
        for level in self.levels[:-1]:
            first = i - i % self.fan
            out.append(("".join(level[first:i]), "".join(level[i + 1:first + self.fan])))
            i //= self.fan
        return out

    @staticmethod
    def version(leaf: str, aside: list[tuple[str, str]]) -> list[str]:
        """The ancestors of a leaf with a new value, lowest first: the copied path."""
        path = []
        for left, right in aside:
            leaf = digest(left + leaf + right)
            path.append(leaf)
        return path


def _height(total: int, fan: int, depth: int) -> int:
    """Levels of a block whose source has `total` nodes in this tier: up to one node, `depth` at most."""
    h = 0
    while h < depth and fan ** h < total:
        h += 1
    return h


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("at", "ascending")]))


def _tree(table: pa.Table, fan: int, depth: int) -> Tree:
    return Tree(table["node"].to_pylist(), _height(table["total"][0].as_py(), fan, depth), fan)


def _tiers(nodes: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """The frames (g, at, total, node) of each tier, from the given one up to that where every g has one node."""
    wide = fan ** depth

    def top(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        tree, first = _tree(table, fan, depth), table.slice(0, 1)
        return pa.table({"g": first["g"], "at": [first["at"][0].as_py() // wide], "total": [-(-first["total"][0].as_py() // wide)], "node": [tree.levels[-1][0]]},
                        schema=pa.schema([("g", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("node", pa.string())]))

    tiers = [nodes.select("g", "at", "total", "node")]
    while (tiers[-1].agg(F.max("total").alias("n")).first()["n"] or 0) > 1:
        block = F.floor(F.col("at") / wide).cast("long").alias("block")
        tiers.append(freeze(tiers[-1].groupBy("g", block).applyInArrow(top, "g string, at long, total long, node string")))
    return tiers


def _descend(nodes: DataFrame, above: DataFrame, fan: int, depth: int, give, schema: str) -> DataFrame:
    """give(table, asides) for every block of `nodes`; `above` (g, at, aside) has what stands beside the ancestors of the block's top."""
    block = F.floor(F.col("at") / fan ** depth).cast("long")

    def down(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = _in_order(table)
        tree = _tree(table, fan, depth)
        over = [(x["left"], x["right"]) for x in upper["aside"][0].as_py()]
        return give(table, [tree.aside(i) + over for i in range(len(table))])

    left = nodes.withColumn("block", block).groupBy("g", "block")
    right = above.withColumnRenamed("at", "block").groupBy("g", "block")
    return left.cogroup(right).applyInArrow(down, schema)


def _asides(tiers: list[DataFrame], above: DataFrame, fan: int, depth: int) -> DataFrame:
    """(g, at, aside) of the tops of the lowest tier's blocks, from those of the highest tier."""
    def give(table: pa.Table, asides: list) -> pa.Table:
        plain = [[{"left": a, "right": b} for a, b in x] for x in asides]
        return pa.table({"g": table["g"], "at": table["at"], "aside": pa.array(plain, ASIDE_TYPE)})

    for tier in reversed(tiers[1:-1]):
        above = freeze(_descend(tier, above, fan, depth, give, f"g string, at long, aside {ASIDE}"))
    return above


def manifest(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", source: str = "source", changed: dict[str, Column] | None = None,
             where: Column | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row per row of `docs`: doc_id, source, at (0-based place in its source), leaf, subroot, root, proof, versioned, path, folded_root.

    A leaf is the SHA-256 of the listed columns in their order, each `-` if NULL, else its UTF-8 length, `:` and the value. `proof` holds the siblings
    of the leaf and of its ancestors up to the root as one text, 64 characters each; `path` the ancestors that the row's version copies, with
    the values of `changed` where `where` holds (`versioned`), else with its own; its last one, or the leaf where there is none, is folded_root.

    NULL sources are a source of their own, before all others; rows with a NULL id come first in theirs; rows with one id are put in order by
    leaf, so repeated rows are leaves of their own in either order. Texts are hashed whole, whatever their length; an empty text is `0:`. An
    empty table has no rows and no root. Other columns are not looked at.
    """
    changed = changed or {}
    own = [docs[c] for c in columns]
    other = leaf_of([changed.get(c, docs[c]) for c in columns])
    marked = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    g = F.when(docs[source].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs[source].cast("string")))
    leaves = freeze(docs.select(g.alias("g"), docs[doc_id].isNotNull().alias("has"), F.coalesce(docs[doc_id].cast("long"), F.lit(0)).alias("id"),
                                leaf_of(own).alias("node"), F.when(marked, other).alias("now")))
    placed = ordered(leaves, ["has", "id", "node"], within=["g"], rank="place")
    totals = leaves.groupBy("g").agg(F.count("*").alias("total"))
    base = freeze(placed.withColumn("at", F.col("place") - 1).join(totals, "g").drop("place"))
    tiers = _tiers(base, fan, depth)
    # the subroots in their order are the leaves of the tree above; this tree has one group
    subroots = freeze(tiers[-1].select("g", F.col("node").alias("subroot")))
    upper = ordered(subroots, ["g"], rank="place").select(F.lit("").alias("g"), (F.col("place") - 1).alias("at"), F.col("subroot").alias("node"), F.col("g").alias("of"))
    upper = freeze(upper.join(upper.groupBy("g").agg(F.count("*").alias("total")), "g"))
    heights = _tiers(upper, fan, depth)
    none = F.array().cast(ASIDE)
    root = heights[-1].select("node").scalar()
    over = heights[-1].select("g", "at", none.alias("aside"))
    if len(heights) > 1:
        over = _asides(heights, over, fan, depth)

        def named(table: pa.Table, asides: list) -> pa.Table:
            return pa.table({"g": table["of"], "aside": pa.array([[{"left": a, "right": b} for a, b in x] for x in asides], ASIDE_TYPE)})

        over = _descend(upper, over, fan, depth, named, f"g string, aside {ASIDE}")
    else:
        over = upper.select(F.col("of").alias("g"), none.alias("aside"))
    tops = freeze(over.select("g", F.lit(0).cast("long").alias("at"), "aside"))
    blocks = _asides(tiers, tops, fan, depth)

    def rows(table: pa.Table, asides: list) -> pa.Table:
        leaf, now = table["node"].to_pylist(), table["now"].to_pylist()
        proof = ["".join(a + b for a, b in x) for x in asides]
        path = [Tree.version(n or l, x) for l, n, x in zip(leaf, now, asides)]
        return pa.table({"g": table["g"], "has": table["has"], "id": table["id"], "at": table["at"], "leaf": table["node"], "now": table["now"],
                         "proof": pa.array(proof, pa.string()), "path": pa.array(path, pa.list_(pa.string()))})

    found = _descend(base, blocks, fan, depth, rows, "g string, has boolean, id long, at long, leaf string, now string, proof string, path array<string>")
    found = found.join(subroots, "g")
    last = F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(F.coalesce("now", "leaf"))
    return found.select(F.when(F.col("has"), F.col("id")).alias("doc_id"), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source"), "at", "leaf", "subroot",
                        root.alias("root"), "proof", F.col("now").isNotNull().alias("versioned"), "path", last.alias("folded_root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    capitals = "".join(map(chr, range(65, 91)))
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(5)) == 0
    found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": F.translate("text", capitals, capitals.lower())}, where=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
