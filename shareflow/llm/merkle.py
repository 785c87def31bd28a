"""A Merkle manifest of a table: leaves per row, a tree per source, a tree over the sources, a proof per row.

Leaves of a source are numbered by doc_id. A node is labelled with the interval [lo, hi] of leaf numbers that it covers:
a leaf covers itself, a node of level k a run of up to FAN_OUT nodes of level k - 1. A level is built by grouping the
nodes below by the bucket `lo div FAN_OUT ** k`, so each group holds FAN_OUT rows at most. Proofs go down again: the
runs of a level join the node above that contains them, on source and bucket of that level; a node's siblings are the
parent's interval without the node's own, to the left and to the right. The tree over the sources is built the same way
from the sources' roots (one group).

Numbers come from one range partitioning by (source, doc_id) whose result is written: a row's number is its place in its
partition plus the counts of the partitions before, so a source of any size is spread over many tasks. Only digests and
ids are shuffled, never texts. Results:

- a null source is a source of its own, the first; null in any column is `-` in the leaf, so it differs from empty text;
- leaves with one doc_id are ordered by their digest; equal rows are leaves of their own with proofs of their own;
- rows without a doc_id come before all others of their source;
- a source of one row has that leaf as its root; one source alone has its root as the table's; a proof without siblings
  is the digest of nothing; an empty table has no root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shareflow.llm.common import written

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PARTITION_BITS = 33  # of monotonically_increasing_id: the partition stands above them


class Tree(NamedTuple):
    """levels: for each level the runs of its nodes: group, bucket, lo, hi, leaves (of the group), children, digest.

    roots: group, leaves, digest. first: the leaves, as nodes. children are (lo, hi, digest) in order; those of the
    first level have the item of their leaf too.
    """

    first: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields: each `-` if null, else its number of bytes, a colon and its value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*(one(c.cast("string")) for c in fields.values())))


def group_key(source: Column) -> Column:
    """The source as a key that is never null and sorts in order of bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """Add lo and hi, each item's number from 0 in its group by `order`, and leaves, the size of the group.

    items are a written table; order is a list of columns after `group`. Items that are equal in all of them take their
    order from their place in the table, so no key is too frequent for a range.
    """
    keys = ["group", *order, "_tie"]
    ranged = items.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-places")
    placed = placed.withColumn("_part", F.shiftright("_at", _PARTITION_BITS))
    parts = placed.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    every, before = Window.partitionBy("group"), Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("group", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("leaves"))
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return placed.join(parts, ["group", "_part"]).withColumns({"lo": number, "hi": number}).drop("_part", "_at", "_first", "_before")


def _runs(nodes: DataFrame, level: int, more: list[str]) -> DataFrame:
    """Group the nodes of a level into runs: the nodes of the level above."""
    bucket = F.expr(f"lo div {FAN_OUT ** (level + 1)}L").alias("bucket")
    child = F.struct("lo", "hi", "digest", *more)
    grouped = nodes.groupBy("group", bucket).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("leaves").alias("leaves"), F.array_sort(F.collect_list(child)).alias("children"))
    return grouped.withColumn("digest", digest(F.array_join(F.transform("children", lambda c: c["digest"]), "")))


def _tops(nodes: DataFrame, level: int) -> Column:
    """Whether a node of this level is its group's root: it has no node beside it, and none below had none."""
    return (F.col("leaves") <= FAN_OUT**level) & ((F.col("leaves") > FAN_OUT ** (level - 1)) if level else F.lit(True))


def build(leaves: DataFrame) -> Tree:
    """The trees over numbered leaves (group, lo, hi, leaves, digest, item), one for each group; every level is written."""
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    levels, nodes, roots = [], leaves, leaves.filter(_tops(leaves, 0)).select("group", "leaves", "digest")
    while most > FAN_OUT ** len(levels):
        level = len(levels)
        runs = written(_runs(nodes.filter(F.col("leaves") > FAN_OUT**level), level, [] if level else ["item"]), f"merkle-level-{level}")
        levels.append(runs)
        nodes = runs.select("group", "lo", "hi", "leaves", "digest")
        roots = roots.unionByName(nodes.filter(_tops(nodes, level + 1)).select("group", "leaves", "digest"))
    return Tree(leaves, levels, written(roots, "merkle-roots"))


def _siblings(children: Column, own: Column) -> Column:
    """What the parent's interval holds beside the node's own: digests to its left and to its right, joined."""
    side = lambda beside: F.array_join(F.transform(F.filter(children, beside), lambda c: c["digest"]), "")
    return F.struct(side(lambda c: c["hi"] < own["lo"]).alias("left"), side(lambda c: c["lo"] > own["hi"]).alias("right"))


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """group, leaf, item and path of every leaf, and the other columns of above.

    above: group, path (what follows above the group's root: an array of siblings left and right) and any other columns.
    """
    more = [c for c in above.columns if c not in ("group", "path")]
    tops = lambda level: above.join(tree.roots.filter(_tops(tree.roots, level)), "group")
    node = lambda rows: rows.select("group", F.lit(0).cast("long").alias("lo"), (F.col("leaves") - 1).alias("hi"), "path", *more)
    known = node(tops(len(tree.levels)))
    single = tops(0).select("group", F.col("path"), *more).join(tree.first.filter("leaves = 1").select("group", F.col("digest").alias("leaf"), "item"), "group")
    for level in range(len(tree.levels) - 1, -1, -1):
        width = FAN_OUT ** (level + 1)
        outer = known.select(F.col("group").alias("o_group"), F.expr(f"lo div {width}L").alias("o_bucket"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), "path", *more)
        contained = (F.col("group") == F.col("o_group")) & (F.col("bucket") == F.col("o_bucket")) & (F.col("lo") >= F.col("o_lo")) & (F.col("hi") <= F.col("o_hi"))
        runs = tree.levels[level].drop("digest").join(outer, contained)
        each = runs.select("group", "path", "children", *more, F.explode("children").alias("own"))
        beside = F.concat(F.array(_siblings(F.col("children"), F.col("own"))), F.col("path"))
        if not level:
            return each.select("group", F.col("own.digest").alias("leaf"), F.col("own.item").alias("item"), beside.alias("path"), *more).unionByName(single)
        known = each.select("group", "own.lo", "own.hi", beside.alias("path"), *more).unionByName(node(tops(level)))
    return single


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(path, leaf, lambda so_far, p: digest(F.concat(p["left"], so_far, p["right"])))


def proof_text(path: Column) -> Column:
    """All siblings, level by level to the root, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


NO_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and path of every row of docs, and claimed_leaf: the leaf of the row as someone claims it.

    claimed gives columns in place of docs' own; folded(claimed_leaf, path) is the table's root if the claim is true.
    """
    own = {c: F.col(c) for c in FIELDS}
    other = leaf_digest(own | (claimed or {}))
    leaves = docs.select(group_key(F.col("source")).alias("group"), "doc_id", leaf_digest(own).alias("digest"), other.alias("claimed"))
    # an equal claim needn't be kept beside the leaf
    item = F.struct("doc_id", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")).alias("claimed"))
    leaves = written(leaves.select("group", "doc_id", "digest", item.alias("item")), "merkle-leaves")
    sources = build(written(numbered(leaves, ["doc_id", "digest"]).drop("doc_id"), "merkle-numbered"))
    roots = written(sources.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), "merkle-sources")
    upper = build(written(numbered(roots, ["name"]).select("group", "lo", "hi", "leaves", "digest", F.struct("name").alias("item")), "merkle-upper"))
    top = upper.roots.select("group", F.array().cast(NO_PATH).alias("path"), F.col("digest").alias("root"))
    # every level of the sources' trees joins these, so their plan isn't repeated in each
    tops = written(proofs(upper, top).select(F.col("item.name").alias("group"), "path", F.col("leaf").alias("subroot"), "root"), "merkle-tops")
    rows = proofs(sources, tops)
    return rows.select("item.doc_id", "leaf", F.coalesce("item.claimed", "leaf").alias("claimed_leaf"), "subroot", "root", "path")


def lower_cased(docs_text: str = "text") -> Column:
    """The text, A-Z in lower case, where 5 divides the CRC-32 of the decimal doc_id; rows without an id stay as they are."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate(F.col(docs_text), string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col(docs_text))


def verified(docs: DataFrame, claimed: dict[str, Column]) -> DataFrame:
    """The manifest's rows with the digest of their proof, and whether the claimed row folds to the root."""
    rows = manifest(docs, claimed)
    out = rows.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), folded(F.col("claimed_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)")) + " || " + _FIELD + ")"
#: One byte of CRC-32, by halves: the table is that of the polynomial for 4 bits.
_CRC_TABLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_CRC = f"""list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0], lambda e, z: xor(e >> 4, ({_CRC_TABLE}::bigint[])[(e & 15) + 1])))"""
ORACLE = f"""
with recursive d as (
  select doc_id, source, {_LEAF.format("text")} as leaf,
    case when xor({_CRC}, 4294967295) % 5 = 0 then {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as claimed
  from documents),
l as (select *, coalesce('=' || source, '') as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from d),
t(g, level, i, n, digest, sibs) as (
  select g, 0, i, n, leaf, []::varchar[] from l
  union all
  select g, level + 1, i // 16, max((n + 15) // 16), sha256(string_agg(digest, '' order by i)), list(digest order by i) from t where n > 1 group by g, level, i // 16),
s as (select g, digest as subroot, level as height from t where n = 1),
u as (select *, row_number() over (order by g) - 1 as i, count(*) over () as n from s),
v(level, i, n, digest, sibs) as (
  select 0, i, n, subroot, []::varchar[] from u
  union all
  select level + 1, i // 16, max((n + 15) // 16), sha256(string_agg(digest, '' order by i)), list(digest order by i) from v where n > 1 group by level, i // 16),
r as (select digest as root from v where n = 1),
f(doc_id, leaf, g, level, i, fold, proof) as (
  select doc_id, leaf, g, 0, i, coalesce(claimed, leaf), '' from l
  union all
  select f.doc_id, f.leaf, f.g, f.level + 1, f.i // 16,
    sha256(array_to_string(list_concat(t.sibs[1:f.i % 16], [f.fold], t.sibs[f.i % 16 + 2:]), '')),
    f.proof || array_to_string(list_concat(t.sibs[1:f.i % 16], t.sibs[f.i % 16 + 2:]), '')
  from f join t on t.g = f.g and t.level = f.level + 1 and t.i = f.i // 16),
w(doc_id, leaf, subroot, level, i, fold, proof) as (
  select f.doc_id, f.leaf, u.subroot, 0, u.i, f.fold, f.proof from f join u on f.g = u.g and f.level = u.height
  union all
  select w.doc_id, w.leaf, w.subroot, w.level + 1, w.i // 16,
    sha256(array_to_string(list_concat(v.sibs[1:w.i % 16], [w.fold], v.sibs[w.i % 16 + 2:]), '')),
    w.proof || array_to_string(list_concat(v.sibs[1:w.i % 16], v.sibs[w.i % 16 + 2:]), '')
  from w join v on v.level = w.level + 1 and v.i = w.i // 16)
select w.doc_id, w.leaf, w.subroot, r.root, sha256(w.proof) as proof_sha256, w.fold as folded_root, w.fold = r.root as verified
from w cross join r where w.level = (select max(level) from v)
"""
