"""Merkle manifest of a dataset by sibling-shift self-joins.

Rows are leaves, numbered in their group. At every level each node sends its digest to the computed places of its siblings (XOR of
the place for a binary tree, offsets of the slot within the run otherwise) and an equi-join lets every node meet what was sent to
it; the nodes of slot zero then emit the parents. The tops of the groups are the leaves of one more tree, whose top is the root.
Digests travel as 32 bytes and are hashed as lowercase hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.scratch import cut

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(h: Column) -> Column:
    return F.lower(F.hex(h))


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text, so that no two rows give one string."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def place(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx``, the place in the group ``g`` in the given order (nulls first), and ``n``, the rows of the group.

    Rows are dealt out by ranges of (group, order), so a group of any share spans many tasks; a row's place is that in its part and
    the rows of the group in the parts before. Rows that are equal in all of ``order`` may change places.
    """
    own = rows.withColumn("row", F.monotonically_increasing_id())
    keys = ["g", *order, "row"]
    held = cut(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    spans = held.groupBy("g", part).agg(F.min("at").alias("first"), F.count("*").alias("own"))
    w = Window.partitionBy("g")  # a row for each part that holds the group
    before = F.coalesce(F.sum("own").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("own").over(w).alias("n"))
    return cut(held.withColumn("part", part).join(spans, ["g", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n"))


def siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """The nodes (``g``, ``idx``, ``n``, ``h`` and others) with the digests of the run's others as bytes: ``before`` and ``after`` their own."""
    slot = F.col("idx") % fan
    if fan == 2:
        others = F.array(F.col("idx").bitwiseXOR(F.lit(1).cast("long")))
    else:
        others = F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda o: F.col("idx") - slot + (slot + o) % fan)
    sent = nodes.select(F.col("g").alias("to_g"), F.explode(others).alias("to"), F.col("n").alias("of"), slot.alias("slot"), F.col("h").alias("sent")).where("to < of")
    met = nodes.join(sent, (F.col("g") == F.col("to_g")) & (F.col("idx") == F.col("to")), "left")
    # The rows are already dealt out by (g, idx) for the join, so this shuffles nothing.
    own = [F.first(c).alias(c) for c in nodes.columns if c not in ("g", "idx")]
    held = met.groupBy("g", "idx").agg(*own, F.array_sort(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("slot", "sent")))).alias("sent"))

    def side(test) -> Column:
        return F.aggregate(F.filter("sent", test), F.expr("X''"), lambda a, s: F.concat(a, s["sent"]))

    return held.select("g", "idx", *[c for c in nodes.columns if c not in ("g", "idx")], side(lambda s: s["slot"] < slot).alias("before"), side(lambda s: s["slot"] > slot).alias("after"))


def parents(nodes: DataFrame, fan: int) -> DataFrame:
    """What the nodes of slot zero emit: the run's digest, one level up."""
    run = digest(F.concat(hexed(F.col("h")), hexed(F.col("after"))))
    return nodes.where(F.col("idx") % fan == 0).select("g", F.expr(f"idx div {fan}").alias("idx"), F.ceil(F.col("n") / fan).alias("n"), run.alias("h"))


@dataclass(frozen=True)
class Tree:
    """Trees of some groups. ``levels``: from the leaves up, the nodes that have a parent, with their siblings. ``tops``: by level, the
    nodes that have none."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    fan: int

    def nodes(self) -> DataFrame:
        """All nodes: ``g``, ``level``, ``idx``, ``digest`` as hex text."""
        every = [(k, t) for k, t in [*enumerate(self.levels), *enumerate(self.tops)]]
        out = [t.select("g", F.lit(k).alias("level"), "idx", hexed(F.col("h")).alias("digest")) for k, t in every]
        found = out[0]
        for t in out[1:]:
            found = found.union(t)
        return found


def grow(nodes: DataFrame, fan: int = FAN) -> Tree:
    """Level by level, until every group has one node left. Each level is a table in the shared folder."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [nodes.where("n = 1")]
    while most > 1:
        levels.append(cut(siblings(nodes.where("n > 1"), fan)))
        nodes, most = parents(levels[-1], fan), -(-most // fan)
        tops.append(nodes.where("n = 1"))
    return Tree(levels, tops, fan)


STEP = "array<struct<before: binary, after: binary>>"


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves of ``tree`` with the columns of ``above`` (a row for each group: ``g``, ``path`` and others), ``path`` lengthened by the steps
    from the leaf to the group's top. Every level is joined with its parents only."""
    extra = [c for c in above.columns if c not in ("g", "path")]
    own = [c for c in tree.tops[0].columns if c not in ("g", "idx", "n", "h")]
    found = None
    for k in reversed(range(len(tree.tops))):
        kept = own if k == 0 else []
        here = tree.tops[k].select("g", "idx", "h", *kept).join(above, "g")
        if found is not None:
            step = F.array(F.struct("before", "after"))
            up = found.select("g", F.col("idx").alias("up"), *extra, "path")
            nodes = tree.levels[k].withColumn("up", F.expr(f"idx div {tree.fan}"))
            here = here.unionByName(nodes.join(up, ["g", "up"]).select("g", "idx", "h", *kept, *extra, F.concat(step, "path").alias("path")))
        found = here
    return found


def fold(start: Column, path: Column) -> Column:
    """The root as hex text that a leaf (bytes) and the steps of its path give."""
    return F.aggregate(path, hexed(start), lambda acc, s: F.sha2(F.concat(hexed(s["before"]), acc, hexed(s["after"])), 256))


def proof(path: Column) -> Column:
    """The siblings of a path, level by level and left to right, as hex text."""
    return F.array_join(F.transform(path, lambda s: hexed(F.concat(s["before"], s["after"]))), "")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", fan: int = FAN, changed: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, ``leaf``, ``subroot`` (of its group), ``root``, ``path`` (its siblings as bytes, a struct of ``before`` and
    ``after`` for each level), and ``changed``, the leaf bytes of the column of that name (default: the leaf). Digests are hex text.

    Nulls in any column have a digest of their own; a null group is one, the first; a null id sorts first. Rows of equal group and id are
    ordered by leaf, so repeated rows give one tree whatever their order. Texts are hashed whole. Other columns are not read. An
    empty table gives no rows. A group without siblings has its leaf as subroot, a lone group's subroot is the root.
    """
    own = leaf(*[F.col(f"`{c}`") for c in fields])
    group = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    rows = cut(docs.select(group.alias("g"), F.col(f"`{id_col}`").alias("id"), own.alias("h"), (own if changed is None else changed).alias("changed")))
    tree = grow(place(rows, "id", "h"), fan)
    tops = tree.tops[0].select("g", "h")
    for t in tree.tops[1:]:
        tops = tops.union(t.select("g", "h"))
    crown = grow(place(cut(tops.select(F.lit("").alias("g"), F.col("g").alias("group"), "h")), "group"), fan)
    start = crown.tops[-1].select("g", hexed(F.col("h")).alias("root"), F.expr(f"cast(array() as {STEP})").alias("path"))
    above = cut(paths(crown, start).select(F.col("group").alias("g"), hexed(F.col("h")).alias("subroot"), "root", "path"))
    return paths(tree, above).select(F.col("id").alias(id_col), hexed(F.col("h")).alias("leaf"), "subroot", "root", "path", "changed")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query: every fifth document by hash is tampered with (its letters A-Z in lower case)."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = manifest(docs, changed=leaf(*[tampered if c == "text" else F.col(c) for c in FIELDS]))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
f AS (SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256]))) AS crc
  FROM documents, crc),
l AS (SELECT doc_id, coalesce('s' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
node AS (SELECT 0 AS lvl, g, idx, n, leaf AS h FROM p
  UNION ALL SELECT lvl + 1, g, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY lvl, g, idx // 16, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
crown AS (SELECT 0 AS lvl, idx, n, h FROM s
  UNION ALL SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY lvl, idx // 16, n),
step AS (SELECT p.g, p.idx, a.lvl AS k, coalesce(string_agg(a.h, '' ORDER BY a.idx) FILTER (a.idx < p.idx >> (4 * a.lvl)), '') AS b, coalesce(string_agg(a.h, '' ORDER BY a.idx) FILTER (a.idx > p.idx >> (4 * a.lvl)), '') AS a
  FROM p JOIN node a ON a.g = p.g AND a.n > 1 AND a.idx >> 4 = p.idx >> (4 * a.lvl + 4) GROUP BY ALL
  UNION ALL
  SELECT p.g, p.idx, 100 + a.lvl, coalesce(string_agg(a.h, '' ORDER BY a.idx) FILTER (a.idx < s.idx >> (4 * a.lvl)), ''), coalesce(string_agg(a.h, '' ORDER BY a.idx) FILTER (a.idx > s.idx >> (4 * a.lvl)), '')
  FROM p JOIN s ON s.g = p.g JOIN crown a ON a.n > 1 AND a.idx >> 4 = s.idx >> (4 * a.lvl + 4) GROUP BY p.g, p.idx, s.idx, a.lvl),
path AS (SELECT g, idx, list({'b': b, 'a': a} ORDER BY k) AS steps, string_agg(b || a, '' ORDER BY k) AS siblings FROM step GROUP BY g, idx),
r AS (SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend({'b': p.changed, 'a': ''}, coalesce(steps, [])), lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}).b AS folded_root
  FROM p JOIN s ON s.g = p.g LEFT JOIN path ON path.g = p.g AND path.idx = p.idx)
SELECT *, folded_root = root AS verified FROM r
"""
