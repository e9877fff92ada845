"""Line deduplication over overlapping three-line windows, in DataFrame operations only.

Every run of three consecutive lines is hashed where the text is read; only hashes and positions are shuffled. The
first place of each repeated window (smallest document id, then position) stays, all later places are covered, and a
line goes if any covered window holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(lines: Column, width: int) -> Column:
    """Per window that is not blank: its start and a 128-bit hash."""

    def one(i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(width)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*parts).alias("a"),
            F.xxhash64(*reversed(parts), F.lit(width)).alias("b"),
            F.exists(F.slice(lines, i + 1, width), lambda x: F.trim(x) != "").alias("solid"),
        )

    starts = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, one), lambda w: w["solid"])


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``id``, ``row`` (hash of the text) and ``pos`` of every window that repeats an earlier one anywhere."""
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("row"), F.split(f"`{text_col}`", "\n", -1).alias("lines"))
    places = lines.select("id", "row", F.explode(_windows(F.col("lines"), width)).alias("w")).select("id", "row", "w.pos", "w.a", "w.b")
    first = places.groupBy("a", "b").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return places.join(first.drop("n"), ["a", "b"]).where(F.struct("id", "pos") > F.col("first")).select("id", "row", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, counts: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of the text, and ``n_lines``, ``n_removed``.

    Lines end at line feeds and count as they stand. A window of ``width`` lines, not all blank, that occurred
    before (in a document of smaller id, or further up in the same one) covers its lines; covered lines go. Texts with
    fewer lines stay as they are; one whose lines all go becomes empty; a null text stays null with counts of zero.
    Rows with a null id come before all others. Rows that share id and text are one document and fare alike, and rows
    that share an id but not the text count as further places at that id. Columns named like the two counts are
    replaced, but without ``counts`` none is added and all columns stay. An empty table gives an empty result.
    """
    found = later_windows(docs, id_col, text_col, width)
    covered = found.groupBy("id", "row").agg(F.collect_set("pos").alias("starts"))
    lost = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))
    covered = covered.select(F.col("id").alias("of"), F.col("row").alias("its"), lost.alias("lost"))
    # The caller's row in one struct, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("key"))
    joined = rows.join(covered, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("its")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long")
    own = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    out = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in own]
    return joined.select(*out, *([n.alias("n_lines"), gone.alias("n_removed")] if counts else []))


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3),
w AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS win FROM p
      WHERE trim(lines[pos + 1]) <> '' OR trim(lines[pos + 2]) <> '' OR trim(lines[pos + 3]) <> ''),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) v(k) WHERE nth > 1),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d),
j AS (SELECT l.doc_id, l.line, l.pos, c.pos IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(k.kept) END AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
