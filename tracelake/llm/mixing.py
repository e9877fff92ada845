"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets come from weights, with a cap at twice a source's size. Blocks of BLOCK_WORDS words go to sources, and from
each source to its shards, by highest quotients target / (2 k + 1). A shard lines its documents up in a seeded order and
takes as many whole passes as its quota holds, and then a run of blocks from a seeded start. A source has a shard for
each SHARD_WORDS words, so a source that holds a third of the corpus is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, cut

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 16, 250_000, "7"
#: Shards, and quotients of a group, that are ranked in one task.
SPAN = 200_000


def measure(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(f"`{text_col}`", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``ord``, ``weight`` and ``target`` from ``source`` and ``source_size``: one row a source."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("ord", F.row_number().over(w) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("ord") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("most", (F.col("source_size") * CAP).cast("long"))
    up = Window.orderBy(F.col("most") / F.col("weight"), "ord")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # The level that each source would get per unit of weight if all sources that fill up sooner stop at their cap.
    s = s.withColumn(
        "level",
        (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "ord", "level"))
    s = s.withColumn("level", F.min(fits).over(every)["level"])
    return s.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))).drop("most", "level")


def apportion(items: DataFrame, by: list[str], order: str, size: str, seats: Column, cap: Column, spread: bool = False) -> DataFrame:
    """``items`` and ``quota``: how many of the ``seats`` of its group each gets by the highest quotients.

    Sainte-Laguë rounds each share up or down but for a few: an item's quota lies within n * share / (2 seats) + 1 of
    its share, n the items of the group. What lies below that is given at once, and only the quotients within it are
    ranked; so the rows ranked are about as many as the items, however many the seats. No item gets more than ``cap``.
    With ``spread`` items are ranked in spans of their quotients, so that no group is ranked in one task: whole spans win or
    lose, and places count within the one between. The result is the same; it reads ``items`` several times. Keys are not null.
    """
    keep = [c for c in items.columns if c not in (*by, order)]
    g = Window.partitionBy(*by)
    d = items.withColumn("__seats", seats).withColumn("__cap", cap)
    if spread:
        d = d.join(items.groupBy(*by).agg(F.sum(size).alias("__sum"), F.count(F.lit(1)).alias("__n")), by)
    else:
        d = d.withColumn("__sum", F.sum(size).over(g)).withColumn("__n", F.count(F.lit(1)).over(g))
    d = d.withColumn("__share", F.when(F.col("__sum") > 0, F.col("__seats") * F.col(size) / F.col("__sum")).otherwise(0.0))
    d = d.withColumn("__near", F.when(F.col("__seats") > 0, F.ceil(F.col("__n") * F.col("__share") / (2 * F.col("__seats")))).otherwise(0) + 1)
    d = d.withColumn("__base", F.least(F.greatest(F.floor("__share") - F.col("__near"), F.lit(0)), F.col("__cap")))
    last = F.least(F.floor("__share") + F.col("__near"), F.col("__cap") - 1)
    seat = F.when(last >= F.col("__base"), F.sequence("__base", last)).otherwise(F.array().cast("array<bigint>"))
    if not spread:
        d = d.withColumn("__left", F.col("__seats") - F.sum("__base").over(g)).withColumn("__k", F.explode_outer(seat))
        ranked = g.orderBy(F.when(F.col("__k").isNotNull(), F.col(size) / (2 * F.col("__k") + 1)).desc_nulls_last(), order)
        d = d.withColumn("__won", (F.col("__k").isNotNull() & (F.row_number().over(ranked) <= F.col("__left"))).cast("long"))
        return d.groupBy(*by, order).agg(*[F.first(c).alias(c) for c in keep], (F.first("__base") + F.sum("__won")).cast("long").alias("quota"))
    tries = d.withColumn("__k", F.explode(seat)).select(*by, order, (F.col(size) / (2 * F.col("__k") + 1)).alias("__q"))
    edges = tries.groupBy(*by).agg(F.min("__q").alias("__low"), F.max("__q").alias("__high"), F.ceil(F.count(F.lit(1)) / SPAN).alias("__spans"))
    left = d.groupBy(*by).agg((F.max("__seats") - F.sum("__base")).alias("__left"))
    at = F.least(F.floor((F.col("__high") - F.col("__q")) / (F.col("__high") - F.col("__low")) * F.col("__spans")), F.col("__spans") - 1)
    cells = tries.join(edges, by).withColumn("__span", F.when(F.col("__high") > F.col("__low"), at).otherwise(0).cast("long"))
    upto = g.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy(*by, "__span").agg(F.count(F.lit(1)).alias("__own")).withColumn("__before", F.coalesce(F.sum("__own").over(upto), F.lit(0)))
    ranked = Window.partitionBy(*by, "__span").orderBy(F.col("__q").desc(), order)
    placed = cells.withColumn("__place", F.row_number().over(ranked)).join(before.join(left, by), [*by, "__span"])
    won = placed.where(F.col("__before") + F.col("__place") <= F.col("__left")).groupBy(*by, order).agg(F.count(F.lit(1)).alias("__won"))
    return d.join(won, [*by, order], "left").select(*by, order, *keep, (F.col("__base") + F.coalesce("__won", F.lit(0))).cast("long").alias("quota"))


def _digest(id_col: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:{SEED}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))


#: The columns that a plan adds.
PLANNED = ("source_size", "target", "taken", "passes", "from1", "to1", "from2", "to2")


def _packed(rows: DataFrame, id_col: str, source_col: str, size: Column) -> DataFrame:
    """The columns of ``rows`` in one struct, so that no name of theirs can clash, and what the plan works on."""
    every = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()])
    packed = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(packed.alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__src"), size.alias("__size"), every.alias("__all"))


def plan(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """The rows with ``source_size``, ``target``, ``taken`` and what makes it up: ``passes`` (whole copies, at most CAP) and
    the word ranges [``from1``, ``to1``), [``from2``, ``to2``) of one more copy, each empty where from = to.

    ``size_col`` holds each row's words. Sources are ordered by code point, null last, and weigh 5, 2, 1 in turn. Rows
    without words get 0. Repeated rows count each on its own; a null id is an id of its own. Rows that share
    id and size stand in the order of a hash over all their columns, so reruns agree. The sums over a source come near its
    target, off by less than a block for each shard and pass; no row exceeds CAP times its size. Columns named like those that are added are replaced. An empty table gives an empty result.
    """
    planned = _plan(_packed(rows, id_col, source_col, F.col(f"`{size_col}`")))
    return planned.select(*[F.col(f"__row.`{c}`").alias(c) for c in rows.columns if c not in PLANNED], *PLANNED)


def _plan(rows: DataFrame) -> DataFrame:
    """``plan`` over packed rows."""
    sizes = rows.groupBy(F.col("__src").alias("source")).agg(F.sum("__size").alias("source_size"))
    per_source = targets(sizes).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)))
    per_source = cut(per_source.select(F.col("source").alias("__name"), "source_size", "ord", "target", "shards"))
    shard = F.conv(F.substring(_digest("__id", "shard"), 1, 8), 16, 10).cast("long") % F.col("shards")
    placed = rows.join(per_source, F.col("__src").eqNullSafe(F.col("__name"))).withColumn("__shard", shard)

    per_shard = placed.groupBy("ord", F.col("__shard").alias("shard")).agg(F.sum("__size").alias("shard_size"))
    per_shard = cut(per_shard.withColumn("blocks", F.ceil(F.col("shard_size") / BLOCK_WORDS)))
    spread = per_shard.count() > SPAN
    room = per_shard.groupBy("ord").agg((F.sum("blocks") * CAP).alias("room"))
    given = per_source.join(room, "ord")
    seats = F.floor(F.sum("target").over(Window.partitionBy()) / BLOCK_WORDS + 0.5)
    quotas = apportion(given.withColumn("__all", F.lit(0)), ["__all"], "ord", "target", seats, F.col("room")).select("ord", F.col("quota").alias("source_quota"))
    shards = per_shard.join(quotas, "ord")
    shares = apportion(cut(shards) if spread else shards, ["ord"], "shard", "shard_size", F.col("source_quota"), F.col("blocks") * CAP, spread)
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"start:{SEED}"), F.col("ord").cast("string"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    has = F.col("blocks") > 0
    shares = shares.select(
        F.col("ord").alias("__ord"), F.col("shard").alias("__sh"), "shard_size", "blocks",
        F.when(has, F.expr("quota div blocks")).otherwise(0).alias("passes"),
        F.when(has, F.expr("quota % blocks")).otherwise(0).alias("rest"),
        F.when(has, start % F.col("blocks")).otherwise(0).alias("begin"),
    )
    line = Window.partitionBy("ord", "__shard").orderBy(_digest("__id", "order"), "__id", "__size", "__all")
    lined = placed.withColumn("__end", F.sum("__size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    lined = lined.join(shares, (F.col("ord") == F.col("__ord")) & (F.col("__shard") == F.col("__sh")))
    begin, size = F.col("__end") - F.col("__size"), F.col("__size")
    stop = F.col("begin") + F.col("rest")

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x - begin, F.lit(0)), size).cast("long")

    out = lined.withColumns({
        "from1": clip(F.col("begin") * BLOCK_WORDS),
        "to1": clip(F.least(stop * BLOCK_WORDS, F.col("shard_size"))),
        "from2": F.lit(0).cast("long"),
        "to2": clip(F.greatest(stop - F.col("blocks"), F.lit(0)) * BLOCK_WORDS),
    })
    out = out.withColumn("taken", (F.col("passes") * size + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")).cast("long"))
    return out.select("__row", "__size", *PLANNED)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: a row for each whole copy of a document and one for each cut part.

    Documents that the mix leaves out have no row, nor have those without words. Cut parts, at most two a shard, hold their
    words with single blanks. A column ``n_chars`` gets the new length; other columns stay, whatever their names.
    Repeated rows and null ids are documents like any other. An empty table gives an empty result.
    """
    names = docs.columns
    planned = _plan(_packed(docs, id_col, source_col, measure(docs, text_col)))

    def part(a: str, b: str) -> Column:
        whole = F.col(b) - F.col(a) == F.col("__size")
        words = F.regexp_extract_all(F.col(f"__row.`{text_col}`"), F.lit(WORD), F.lit(0))
        cut_text = F.array_join(F.slice(words, F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int")), " ")
        return F.when(F.col(b) > F.col(a), F.when(whole, F.col(f"__row.`{text_col}`")).otherwise(cut_text))

    texts = F.concat(F.array_repeat(F.col(f"__row.`{text_col}`"), F.col("passes").cast("int")), F.array(part("from1", "to1"), part("from2", "to2")))
    texts = F.filter(texts, lambda x: x.isNotNull())
    out = planned.where("taken > 0").withColumn("__copy", F.explode(texts))
    return out.select(*[F.col("__copy").alias(c) if c == text_col else F.length("__copy").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in names])


SQL = r"""
WITH m AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM s0),
s2 AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS most FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
       FROM s2 WINDOW b AS (ORDER BY most::DOUBLE / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT arg_min(level, (most::DOUBLE / weight, ord)) FROM s3 WHERE level * weight <= most) AS lam FROM s3),
s AS (SELECT source, source_size, ord, least(most::DOUBLE, lam * weight) AS target, greatest(ceil(source_size / 250000.0), 1)::BIGINT AS shards FROM s4),
p AS (SELECT m.doc_id, m.size, s.*, ('0x' || substr(md5('shard:7:' || coalesce(m.doc_id::VARCHAR, '')), 1, 8))::BIGINT % s.shards AS shard
      FROM m JOIN s ON m.source IS NOT DISTINCT FROM s.source),
h AS (SELECT ord, shard, sum(size)::BIGINT AS shard_size, ceil(sum(size) / 16.0)::BIGINT AS blocks FROM p GROUP BY ord, shard),
a0 AS (SELECT s.ord, s.target AS size, (SELECT floor(sum(target) / 16 + 0.5) FROM s)::BIGINT AS seats, sum(h.blocks)::BIGINT * 2 AS cap
       FROM s JOIN h ON s.ord = h.ord GROUP BY s.ord, s.target),
a1 AS (SELECT *, unnest(range(0, cap)) AS k FROM a0),
a2 AS (SELECT *, row_number() OVER (ORDER BY size / (2 * k + 1) DESC, ord) AS nth FROM a1),
a AS (SELECT ord, count(*) FILTER (WHERE nth <= seats) AS seats FROM a2 GROUP BY ord),
b1 AS (SELECT h.*, a.seats, unnest(range(0, blocks * 2)) AS k FROM h JOIN a ON h.ord = a.ord),
b2 AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard) AS nth FROM b1),
q AS (SELECT ord, shard, shard_size, blocks, count(*) FILTER (WHERE nth <= seats) AS quota FROM b2 GROUP BY ALL),
z AS (SELECT *, quota // blocks AS passes, quota % blocks AS rest,
             ('0x' || substr(md5('start:7:' || ord || ':' || shard), 1, 8))::BIGINT % blocks AS begin FROM q WHERE blocks > 0),
l AS (SELECT p.doc_id, p.size, p.source_size, p.target, p.ord, p.shard,
             sum(p.size) OVER (PARTITION BY p.ord, p.shard ORDER BY md5('order:7:' || coalesce(p.doc_id::VARCHAR, '')), p.doc_id, p.size
                               ROWS UNBOUNDED PRECEDING) - p.size AS at FROM p)
SELECT l.doc_id, l.size, l.source_size, l.target,
       coalesce(z.passes * l.size
         + least(greatest(least((z.begin + z.rest) * 16, z.shard_size) - l.at, 0), l.size) - least(greatest(z.begin * 16 - l.at, 0), l.size)
         + least(greatest(greatest(z.begin + z.rest - z.blocks, 0) * 16 - l.at, 0), l.size), 0)::BIGINT AS taken
FROM l LEFT JOIN z ON l.ord = z.ord AND l.shard = z.shard
"""
