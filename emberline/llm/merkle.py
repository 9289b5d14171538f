"""Operator 13: a Merkle manifest of a dataset, three children a node, by lag and lead windows.

Rows are leaves, hashed from their columns. Within a source they ascend by ``doc_id``; every ``FAN`` consecutive nodes (the
last run: fewer) become one node until one is left, the source's subroot. Subroots in the order of their sources are the
leaves of a last tree of the same kind, whose top is the dataset's root. A leaf's proof holds, level by level, what stands
left and right of it in its run, so anyone with the leaf, the proof and the root can verify a row without the others.

Each level is a set of lag and lead columns at the fixed offsets of that level: the first leaf under a node carries the
node's hash, the slot in the run tells which neighbours are siblings, and the first child hashes the parent. Windows never
hold a source: runs do not cross blocks of ``FAN ** LEVELS`` consecutive nodes, so a block is a window, a round climbs
``LEVELS`` levels of all blocks at once, and the blocks' tops are the nodes of the next round. Positions come from one range
partitioning of the leaves (written once) and counts a partition, so a source may hold any share of the rows. Going down, a
node meets its block's proof by (source, block), never by source alone.

Nulls are hashed as ``-``, which no value gives; rows without source form a source of their own, before all others; rows
without id come first in their source; rows of one id are ordered by their hashes, and rows equal in all columns are
interchangeable leaves; empty and very long texts are values like others; a source of one row has its leaf as subroot; an
empty table has no rows; further columns are neither hashed nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

FAN = 3
LEVELS = 5
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def spelled(value: Column) -> Column:
    """The value with its length before it, so neighbours in a row can't be confused."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(**other: Column) -> Column:
    """Hash of a row; ``other`` replaces columns."""
    return hashed(*(spelled(other.get(f, F.col(f))) for f in FIELDS))


def without_lines(docs: DataFrame) -> Column:
    """The tampered row's leaf: texts of rows whose id has an even CRC-32 lose their line feeds."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even & F.contains("text", F.lit("\n")), leaf(text=F.replace("text", F.lit("\n")))).otherwise(F.col("h"))


def positioned(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their position in group ``g`` by ``order`` as ``pos``, from 0 without gaps, and the group's count ``n``."""
    rows = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    rows = keep(rows.withColumn("at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    spans = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    group = Window.partitionBy("g")
    before = F.sum("many").over(group.orderBy("part")) - F.col("many")
    spans = spans.select("g", "part", "first", before.alias("before"), F.sum("many").over(group).alias("n"))
    return rows.join(spans, ["g", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, pos, n, h) with their ``block``, ``steps`` (left and right siblings a level) and, at each block's first, its top as ``h``."""
    block = Window.partitionBy("g", "block").orderBy("pos")
    out, pos, n, h = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")), F.col("pos"), F.col("n"), F.col("h")
    for k in range(LEVELS):
        step = FAN**k
        near = {j: F.coalesce(F.col(f"at_{j + FAN}"), F.lit("")) for j in range(1 - FAN, FAN) if j}
        out = out.withColumns({f"at_{j + FAN}": (F.lag("h", -j * step) if j < 0 else F.lead("h", j * step)).over(block) for j in near})
        slot, alive = F.expr(f"pos div {step}") % FAN, n > step
        left = F.concat(*(F.when(slot >= -j, near[j]).otherwise("") for j in sorted(near) if j < 0))
        right = F.concat(*(F.when(slot + j < FAN, near[j]).otherwise("") for j in sorted(near) if j > 0))
        parent = F.when(alive, hashed(h, *(near[j] for j in sorted(near) if j > 0))).otherwise(h)
        step_of_node = F.when(alive & (pos % step == 0), F.struct(left.alias("left"), right.alias("right")))
        out = out.withColumns({f"step_{k}": step_of_node, "h": F.when(pos % (FAN * step) == 0, parent)})
    # every leaf below a node takes what the node's first leaf found
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"step_{k}": F.last(f"step_{k}", ignorenulls=True).over(upto) for k in range(LEVELS)})
    steps = F.filter(F.array(*(f"step_{k}" for k in range(LEVELS))), lambda s: s.isNotNull())
    return out.withColumn("steps", steps).drop(*(f"step_{k}" for k in range(LEVELS)), *(f"at_{j + FAN}" for j in near))


def rise(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, from the leaves to one row a group."""
    rounds = [keep(nodes, "nodes")]
    most = rounds[0].agg(F.max("n")).first()[0] or 1
    while True:
        tops = climbed(rounds[-1]).filter(F.col("pos") % BLOCK == 0)
        rounds.append(keep(tops.select("g", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "h"), "nodes"))
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with all ``steps`` to the root; ``above``: g, steps_above and further columns of the group."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds[:-1]):
        carried = [c for c in above.columns if c not in ("g", "block", "steps_above")]
        # hashes of the nodes themselves stay beside the tops that climbing leaves at the blocks' first nodes
        here = climbed(nodes.withColumn("own", F.col("h"))).drop("h", "n")
        here = here.join(above, ["g", "block"]).withColumn("steps", F.concat("steps", "steps_above")).drop("steps_above", "block")
        above = here.drop("own").select("g", F.col("pos").alias("block"), F.col("steps").alias("steps_above"), *carried)
    return here.withColumnRenamed("own", "h")


def folded(h: Column, steps: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(steps, h, lambda a, s: hashed(s["left"], a, s["right"]))


def manifest(docs: DataFrame, tampered: Callable[[DataFrame], Column] = without_lines) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; ``tampered`` gives the leaves that are verified."""
    rows = docs.select(*FIELDS).withColumn("h", leaf())
    rows = rows.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("g"), "h", tampered(rows).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    sources = rise(positioned(keep(rows, "leaves"), "doc_id", "h", "row"))
    subroots = sources[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "h")
    top = rise(positioned(subroots, "source"))
    root = top[-1].select("h").first()
    nothing = top[-1].select("g", F.array().cast("array<struct<left:string,right:string>>").alias("steps_above"))
    above = descend(top, nothing).select(F.col("source").alias("g"), F.col("steps").alias("steps_above"), F.col("h").alias("subroot"))
    out = descend(sources, above).withColumn("root", F.lit(root[0] if root else None).cast("string"))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.withColumn("folded_root", folded(F.col("claimed"), F.col("steps")))
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows as DuckDB SQL: nodes level by level, then each leaf's way up. CRC-32 is taken bit by bit.
ORACLE = r"""
WITH RECURSIVE base AS (
 SELECT doc_id, source, coalesce('=' || source, '-') AS g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
  list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, (a & 1) * 3988292384) END) % 2 AS odd FROM documents),
leaves AS (
 SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN odd = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed FROM base),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
low AS (
 SELECT g, 0 AS lv, pos, n, leaf AS h FROM placed
 UNION ALL
 SELECT g, lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, lv, pos // 3, n),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
 SELECT 0 AS lv, pos, n, subroot AS h FROM sub
 UNION ALL
 SELECT lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lv, pos // 3, n),
way AS (
 SELECT doc_id, g, leaf, 0 AS part, 0 AS lv, pos, n, '' AS proof, claimed AS h FROM placed
 UNION ALL
 SELECT w.doc_id, w.g, w.leaf, CASE WHEN w.n > 1 THEN w.part ELSE 1 END, CASE WHEN w.n > 1 THEN w.lv + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.pos // 3 ELSE s.pos END, CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE s.n END,
  CASE WHEN w.n > 1 THEN w.proof || coalesce(b.h, '') || coalesce(c.h, '') ELSE w.proof END,
  CASE WHEN w.n > 1 THEN sha256(CASE WHEN w.pos % 3 = 0 THEN w.h || coalesce(b.h, '') || coalesce(c.h, '') WHEN w.pos % 3 = 1 THEN b.h || w.h || coalesce(c.h, '') ELSE b.h || c.h || w.h END) ELSE w.h END
 FROM way w JOIN sub s ON s.g = w.g
 LEFT JOIN (SELECT 0 AS part, g, lv, pos, h FROM low UNION ALL SELECT 1, sub.g, lv, high.pos, h FROM high, sub) b ON b.part = w.part AND b.g = w.g AND b.lv = w.lv AND b.pos = w.pos - w.pos % 3 + (CASE WHEN w.pos % 3 = 0 THEN 1 ELSE 0 END)
 LEFT JOIN (SELECT 0 AS part, g, lv, pos, h FROM low UNION ALL SELECT 1, sub.g, lv, high.pos, h FROM high, sub) c ON c.part = w.part AND c.g = w.g AND c.lv = w.lv AND c.pos = w.pos - w.pos % 3 + (CASE WHEN w.pos % 3 = 2 THEN 1 ELSE 2 END)
 WHERE w.n > 1 OR w.part = 0)
SELECT w.doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM way w JOIN sub ON sub.g = w.g, (SELECT h FROM high WHERE n = 1) r WHERE w.part = 1 AND w.n = 1
"""
