"""Removal of repeated passages by overlapping three-line windows.

A text is cut after its newlines and after its sentence ends (a full stop, exclamation or question mark before a space), since
whole passages often stand in one physical line; three lines are three pieces or more, so no window of lines is lost. Every run
of three consecutive solid pieces is hashed. Windows found more than once anywhere keep their first occurrence (smallest id, then
hash of the text, then position); the pieces under all later ones are merged into one set of positions per text and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import discard, materialize, read_table

WIDTH = 3
#: A window with at least this share of all windows is hot; there are at most 1 / ``HOT_SHARE`` of them, so they are broadcast.
HOT_SHARE = 1e-4
WHITE = " \t\n\x0b\x0c\r"


def pieces_of(text: Column) -> Column:
    """The pieces of a text, each with its own line end or space, so that they join to the text again."""
    return F.split(text, r"(?<=\n)|(?<=[.!?] )", -1)


def _solid(pieces: Column) -> Column:
    """(line, at) of each piece that holds more than white space, trimmed, with its number among all."""
    return F.filter(F.transform(pieces, lambda x, i: F.struct(F.btrim(x, F.lit(WHITE)).alias("line"), i.alias("at"))), lambda x: x["line"] != "")


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, g, id, tie, i) of every window; h and g hash its trimmed pieces to 96 bits, tie hashes the text, i numbers its solid pieces from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.transform(_solid(pieces_of(text)), lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("g")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), hashed.alias("s"))
    made = F.transform(
        F.sequence(F.lit(0), F.size("s") - WIDTH),
        lambda i: F.struct(F.xxhash64(*(F.col("s")[i + k]["h"] for k in range(WIDTH))).alias("h"), F.hash(*(F.col("s")[i + k]["g"] for k in range(WIDTH))).alias("g"), i.alias("i")),
    )
    # no filter on the size of s: it would be pushed below and cut every text twice
    return rows.select("id", "tie", F.explode(F.when(F.size("s") >= WIDTH, made)).alias("w")).select("w.h", "w.g", "id", "tie", "w.i")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, gone), written: the solid pieces of each text that later occurrences of a window cover.

    A window that is in very many places would meet all of them in one task of the join; such windows are few by
    definition and go to the tasks that read the windows.
    """
    win = materialize(line_windows(docs, id_col, text_col), "windows")
    seen = win.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("id", "tie", "i")).alias("first")).filter("n > 1")
    seen = materialize(seen, "seen")
    hot = F.col("n") >= max(2.0, HOT_SHARE * win.count())
    few, many = (seen.filter(c).select("h", "g", "first") for c in (hot, ~hot))
    at_hot = win.join(F.broadcast(few), ["h", "g"])  # at most 1 / HOT_SHARE rows
    rest = win.join(F.broadcast(few), ["h", "g"], "left_anti").join(many, ["h", "g"])
    hit = at_hot.unionByName(rest)
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tie") == F.col("first.tie"))
    later = hit.filter(~(same & (F.col("i") == F.col("first.i"))))
    # where a window runs into itself, the pieces of its first occurrence stay
    free = F.when(same, F.greatest(F.lit(0), F.least(F.lit(WIDTH), F.col("first.i") + WIDTH - F.col("i")))).otherwise(F.lit(0))
    covered = F.filter(F.transform(F.array(*(F.lit(k) for k in range(WIDTH))), lambda k: F.when(k >= free, F.col("i") + k)), lambda x: x.isNotNull())
    at = later.filter("id is not null").select("id", "tie", F.explode(covered).alias("at")).distinct()
    gone = materialize(at.groupBy("id", "tie").agg(F.collect_list("at").alias("gone")), "gone-lines")
    discard(win, seen)  # the windows are the largest table of all
    return gone


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the solid pieces numbered in ``gone``; where the last piece goes, so does the line end or space before it."""

    def left(p: Column, at: Column) -> Column:
        kept = F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), at)), lambda i: p[i]), "")
        return F.when(F.array_contains(at, F.size(p) - 1), F.regexp_replace(kept, r"[\x20\n]\z", "")).otherwise(kept)

    def numbered(p: Column) -> Column:
        """The pieces with the numbers among all of those that go."""
        return F.struct(p.alias("p"), F.transform(F.array(_solid(p)), lambda s: F.transform(gone, lambda k: s[k]["at"]))[0].alias("at"))

    return F.transform(F.transform(F.array(pieces_of(text)), numbered), lambda x: left(x["p"], x["at"]))[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), the cleaned ``text``, ``n_lines`` and ``n_removed`` (pieces) for every row.

    Pieces are compared without surrounding white space; blank ones are in no window and stay. Texts
    with fewer than three solid pieces never change; null texts stay null with no lines. Rows that share an id but not the text are
    documents of their own; rows equal in id and text are one document and each get its cleaned text. Rows with a null id are
    never changed (their windows count as the first occurrences).
    """
    gone = repeated_lines(docs, id_col, text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.join(gone, ["id", "tie"], "left").select(
        "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias("text"), F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


OP5_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '(?s:.*?(?:[.!?] |\n))|(?s:.+)') || CASE WHEN regexp_matches(text, '(?:[.!?] |\n)\z') THEN [''] ELSE [] END AS part FROM documents WHERE text IS NOT NULL
), piece AS (
  SELECT doc_id, unnest(part) AS line, generate_subscripts(part, 1) AS pos, len(part) AS n_pieces FROM cut
), solid AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM piece WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), win AS (
  SELECT a.doc_id, a.i, [a.pos, b.pos, c.pos] AS pos, [a.line, b.line, c.line] AS w
  FROM solid a JOIN solid b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN solid c ON c.doc_id = a.doc_id AND c.i = a.i + 2
), first AS (
  SELECT w, count(*) AS n, min({'id': doc_id, 'i': i}) AS f FROM win GROUP BY w HAVING count(*) > 1
), later AS (
  SELECT win.doc_id, win.pos, CASE WHEN win.doc_id = f.id THEN greatest(0, least(3, f.i + 3 - win.i)) ELSE 0 END AS free
  FROM win JOIN first USING (w) WHERE NOT (win.doc_id = f.id AND win.i = f.i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(pos[free + 1:3]) AS pos FROM later
), kept AS (
  SELECT p.doc_id, string_agg(p.line, '' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed, bool_or(g.pos = p.n_pieces) AS no_end
  FROM piece p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN k.no_end THEN regexp_replace(coalesce(k.text, ''), '[\x20\n]\z', '') ELSE coalesce(k.text, '') END AS text,
  coalesce(length(d.text) - length(replace(d.text, chr(10), '')) + 1, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
