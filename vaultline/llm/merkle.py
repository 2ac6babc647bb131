"""Merkle manifest of a dataset by a nested-struct rollup.

Leaves get their place in their language (``ranks``). The low bits of a place
are digit columns, the high bits number a block of ``2 ** DIGITS`` neighbours.
Inside a block, the digits are grouped away one after the other: nodes that
differ in the last digit only become the children of one struct, whose hash
is taken over theirs. All these groupings follow the block's one exchange.
Block hashes are the nodes of the next, 256 times smaller rollup, until every
language has one node; the languages' nodes are rolled up in the same way.
Going back down, each nested block meets its own path to the root by a
grouping on the block (one row from either side), and a transform over the
nested children writes every child's path, which an explode turns into rows.
There is no join of nodes with their siblings, and no task holds more of a
language than a block.

Defined results: each of a leaf's fields counts as ``-`` if null. A null
language is a group of its own, ordered first; a null doc_id orders first in
its language and is never tampered with; rows that share a doc_id are ordered
by leaf, and equal rows are separate leaves next to each other. A null or
empty text is a leaf like any other. An empty table returns no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .ranks import ranked

DIGITS = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_MODULUS = 7


def _field(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, modulus: int = TAMPER_MODULUS) -> DataFrame:
    """(doc_id, g, h, tampered): the language group, the leaf, and the leaf of
    the row as tampered with (n_chars plus 1 where ``modulus`` divides the
    doc_id's CRC-32)."""
    d = docs.select(*FIELDS)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    same = {c: _field(F.col(c)) for c in FIELDS}
    leaf = _hash(*same.values())
    return d.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"), leaf.alias("h"),
                    F.when(hit, _hash(*(same | {"n_chars": _field(more)}).values())).otherwise(leaf).alias("tampered"))


def roll_up(nodes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row per (g, block): ``tree``, the block's nodes (g, r, n, h, item)
    nested under their hashes; ``n`` is the number of nodes of the group."""
    bits = [f"d{k}" for k in reversed(range(digits))]
    tree = nodes.select(
        "g", "n", F.shiftright("r", digits).alias("block"),
        *[F.shiftright("r", k).bitwiseAND(F.lit(1)).alias(f"d{k}") for k in reversed(range(digits))],
        F.struct("h", "item").alias("tree")).repartition("g", "block")
    for k in range(digits):
        tree = tree.groupBy("g", "block", "n", *bits[:digits - 1 - k]).agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), F.col("tree")))).alias("kids"))
        tree = tree.withColumn("kids", F.transform("kids", lambda x: x["tree"]))
        joined = F.array_join(F.transform("kids", lambda x: x["h"]), "")
        up = F.when(F.col("n") > (1 << k), _hash(joined)).otherwise(F.col("kids")[0]["h"])  # a group's only node is left as it is
        tree = tree.select("g", "block", "n", *bits[:digits - 1 - k], F.struct(up.alias("h"), F.col("kids")).alias("tree"))
    return tree


STEP = "struct<before:string,after:string>"


def _children(k: int):
    """The lambda from a node of level ``k + 1`` to its children, each with its path and place."""
    def children(p):
        kids = p["tree"]["kids"]

        def child(kid, i):
            step = F.struct(F.when(i == 1, kids[0]["h"]).otherwise(F.lit("")).alias("before"),
                            F.when((i == 0) & (F.size(kids) == 2), kids[1]["h"]).otherwise(F.lit("")).alias("after"))
            path = F.when(F.col("n") > (1 << k), F.concat(F.array(step), p["path"])).otherwise(p["path"])
            return F.struct(kid.alias("tree"), path.alias("path"), (p["r"] * 2 + i).alias("r"))
        return F.transform(kids, child)
    return children


def hand_down(trees: DataFrame, paths: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(g, r, item, subroot, root, path) of every node nested in ``trees``.
    ``paths`` holds the same of each block's top node (its r is the block);
    a path's steps are the siblings' hashes before and after the node."""
    met = trees.select("g", "block", "n", "tree", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("subroot", "string"), ("root", "string"), ("path", f"array<{STEP}>"))])
    met = met.unionByName(paths.select("g", F.col("r").alias("block"), "subroot", "root", "path"), allowMissingColumns=True)
    both = met.groupBy("g", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "subroot", "root", "path")])
    found = F.array(F.struct(F.col("tree"), F.col("path"), F.lit(0).cast("long").alias("r")))
    for k in reversed(range(digits)):
        found = F.flatten(F.transform(found, _children(k)))
    rows = both.select("g", "block", "subroot", "root", F.explode(found).alias("x"))
    return rows.select("g", (F.col("block") * (1 << digits) + F.col("x.r")).alias("r"), F.col("x.tree.item").alias("item"),
                       "subroot", "root", F.col("x.path").alias("path"))


def _climb(nodes: DataFrame, scratch: Scratch, name: str, digits: int) -> list[DataFrame]:
    """Rollups from the nodes up to one node per group, each a stored table."""
    levels, most = [], 2
    while most is not None and (most > 1 or not levels):
        trees = scratch.save(roll_up(nodes, digits), f"{name}{len(levels)}")
        levels.append(trees)
        more = F.shiftright(F.col("n") + ((1 << digits) - 1), digits)
        most = trees.agg(F.max(more)).first()[0]
        nodes = trees.select("g", F.col("block").alias("r"), more.alias("n"), F.col("tree.h").alias("h"), F.lit(0).alias("item"))
    return levels


def manifest(docs: DataFrame, digits: int = DIGITS, modulus: int = TAMPER_MODULUS) -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its language), root, path (steps of
    sibling hashes from leaf to root) and the tampered leaf."""
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = scratch.save(leaves(docs, modulus), "leaves")
    placed = ranked(rows, "g", [F.col("doc_id"), F.col("h")], scratch, "leaves")
    placed = placed.select("g", "r", "n", "h", F.struct("doc_id", "h", "tampered").alias("item"))
    levels = _climb(placed, scratch, "lang", digits)
    top = levels[-1].select(F.lit("").alias("all"), F.col("g").alias("lang"), F.col("tree.h").alias("h"))
    langs = ranked(top, "all", [F.col("lang")], scratch, "langs")
    langs = langs.select(F.col("all").alias("g"), "r", "n", "h", F.struct("lang", "h").alias("item"))
    roots = _climb(langs, scratch, "root", digits)
    at = roots[-1].select("g", F.lit(0).cast("long").alias("r"), F.col("tree.h").alias("subroot"), F.col("tree.h").alias("root"),
                          F.array().cast(f"array<{STEP}>").alias("path"))
    for trees in reversed(roots):
        at = hand_down(trees, at, digits)
    at = at.select(F.col("item.lang").alias("g"), F.lit(0).cast("long").alias("r"), F.col("item.h").alias("subroot"), "root", "path")
    for k in reversed(range(len(levels))):
        at = hand_down(levels[k], at, digits)
        if k:
            at = scratch.save(at, f"paths{k}")
    return at.select(F.col("item.doc_id").alias("doc_id"), F.col("item.h").alias("leaf"), "subroot", "root", "path",
                     F.col("item.tampered").alias("tampered"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's path leads to."""
    return F.aggregate(path, leaf, lambda acc, x: _hash(x["before"], acc, x["after"]))


def manifest_report(docs: DataFrame, digits: int = DIGITS, modulus: int = TAMPER_MODULUS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from
    the tampered leaf) and verified."""
    m = manifest(docs, digits, modulus)
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
                 fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


# DuckDB form of manifest_report(): recursion by level over (group, place). 3988292384 is the polynomial of CRC-32.
SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
doc AS (SELECT doc_id, coalesce('=' || lang, '') AS g, n_chars,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 7 = 0 AS hit
  FROM documents, crc),
leaf AS (SELECT doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS h,
  sha256(head || coalesce(strlen(CAST(n_chars + CASE WHEN hit THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN hit THEN 1 ELSE 0 END), '-') || tail) AS bad
  FROM doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM leaf),
lv AS (SELECT g, 0 AS k, r, h FROM placed
  UNION ALL
  SELECT g, k + 1, r // 2, sha256(string_agg(h, '' ORDER BY r)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM lv) WHERE c > 1
  GROUP BY g, k, r // 2),
sub AS (SELECT g, k, h FROM lv QUALIFY k = max(k) OVER (PARTITION BY g)),
tv AS (SELECT 0 AS k, row_number() OVER (ORDER BY g) - 1 AS r, h FROM sub
  UNION ALL
  SELECT k + 1, r // 2, sha256(string_agg(h, '' ORDER BY r)) FROM (SELECT *, count(*) OVER () AS c FROM tv) WHERE c > 1 GROUP BY k, r // 2),
top AS (SELECT h, k FROM tv QUALIFY k = max(k) OVER ()),
f AS (SELECT g, r AS leaf_r, 0 AS k, r, bad AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT f.g, leaf_r, f.k + 1, f.r // 2, sha256(CASE WHEN f.r % 2 = 0 THEN acc || coalesce(lv.h, '') ELSE lv.h || acc END), proof || coalesce(lv.h, '')
  FROM f JOIN sub ON sub.g = f.g AND f.k < sub.k LEFT JOIN lv ON lv.g = f.g AND lv.k = f.k AND lv.r = xor(f.r, 1)),
up AS (SELECT f.g, f.leaf_r, acc, proof FROM f JOIN sub ON sub.g = f.g AND sub.k = f.k),
place AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS r FROM sub),
t AS (SELECT up.g, leaf_r, 0 AS k, place.r, acc, proof FROM up JOIN place ON place.g = up.g
  UNION ALL
  SELECT t.g, leaf_r, t.k + 1, t.r // 2, sha256(CASE WHEN t.r % 2 = 0 THEN acc || coalesce(tv.h, '') ELSE tv.h || acc END), proof || coalesce(tv.h, '')
  FROM t JOIN top ON t.k < top.k LEFT JOIN tv ON tv.k = t.k AND tv.r = xor(t.r, 1))
SELECT p.doc_id, p.h AS leaf, sub.h AS subroot, top.h AS root, sha256(t.proof) AS proof_sha256, t.acc AS folded_root, t.acc = top.h AS verified
FROM placed p JOIN sub ON sub.g = p.g JOIN top ON true JOIN t ON t.g = p.g AND t.leaf_r = p.r AND t.k = top.k
"""
