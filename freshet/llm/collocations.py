"""Collocations by set-oriented mining of occurrence relations.

The relation of length k holds every occurrence of a frequent phrase of k words: its document, its position and the phrase's number. It is
persisted in (document, position) order, a row for each document with its occurrences as two parallel arrays. Positions skip one
where a piece ends, so two of them are adjacent only within a piece. A step merge-joins the relation with itself at adjacent positions (two phrases that
overlap in all but one word are a phrase of k + 1 words), counts the groups, and semi-joins the joined occurrences with the frequent groups, whose
numbers they take, before the next length is formed. Groups are numbered in Spark; no table of phrases has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import materialize, read_table
from .texts import LOWER, Batches, chunks, lean, pieces, strings, wide_batches

LONGEST, LEAST, TOP = 3, 10, 2000
#: Frequent groups that are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 2_000_000
#: Joined occurrences that a task counts at a time, rows of a batch that it returns, and parts in which the first rows of a language are found.
HELD, BATCH, PARTS = 1 << 21, 1 << 16, 64

PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPLIT = PIECE_END.copy()
SPLIT[[0x20, 0x09]] = True


def _tokens(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StringArray]]:
    """(row, position, word) of each word of consecutive chunks; ``row`` counts in ``col``."""
    for i, _, buf, offs in chunks(col):
        low = LOWER[buf]
        start, end, row = pieces(low, offs, SPLIT)
        if len(start):
            at = np.arange(len(start)) + np.cumsum(PIECE_END[low])[start]
            yield row + i, (at - at[np.searchsorted(row, row)]).astype(np.int32), strings(low, start, end)


def _count_words(batches: Batches) -> Batches:
    """(lang, text) to (lang, word, n), counted within chunks."""
    for b in batches:
        lang = b.column(0).dictionary_encode()
        code = lang.indices.to_numpy(zero_copy_only=False)
        for row, _, word in _tokens(b.column(1)):
            word = word.dictionary_encode()
            size = len(word.dictionary)
            key, n = np.unique(code[row].astype(np.int64) * size + word.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // size)), word.dictionary.take(pa.array(key % size)), pa.array(n)], ["lang", "word", "n"])


def _list_words(batches: Batches) -> Batches:
    """(doc, lang, text) to (doc, at, lang, word) in order."""
    for b in batches:
        for row, at, word in _tokens(b.column(2)):
            mine = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(mine), pa.array(at), b.column(1).take(mine), word], ["doc", "at", "lang", "word"])


def _nest(batches: Batches) -> Batches:
    """(doc, at, id) in order to a row for each document; a document may go on in the next batch."""
    held: list[np.ndarray] = []

    def rows(doc: np.ndarray, at: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        offs = pa.array(np.append(first, len(doc)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.ListArray.from_arrays(offs, pa.array(at)), pa.ListArray.from_arrays(offs, pa.array(code))], ["doc", "at", "code"])

    for b in batches:
        cols = [b.column(k).to_numpy() for k in range(3)]
        if not len(cols[0]):
            continue
        if held:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        doc, at, _ = cols
        step = np.diff(doc)
        if ((step < 0) | ((step == 0) & (np.diff(at) <= 0))).any():
            raise ValueError("occurrences came out of order")
        last = int(np.searchsorted(doc, doc[-1]))
        if last:
            yield rows(*(c[:last] for c in cols))
        held = [c[last:].copy() for c in cols]
    if held:
        yield rows(*held)


def _adjacent(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, at, left, right) of the merge join of the relation with itself at adjacent positions."""
    offs = b.column(1).offsets.to_numpy().astype(np.int64)
    at, code = (b.column(k).values.to_numpy() for k in (1, 2))
    row = np.repeat(np.arange(len(b)), np.diff(offs))
    at, code = at[offs[0] : offs[-1]], code[offs[0] : offs[-1]]
    k = np.flatnonzero((at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]))
    return row[k], at[k], code[k], code[k + 1]


def _count_pairs(batches: Batches) -> Batches:
    """The relation to (left, right, n), counted over up to ``HELD`` joined occurrences."""

    def counted(left: np.ndarray, right: np.ndarray) -> Batches:
        order = np.sort((left.astype(np.int64) << 32) | right) if left.dtype == np.int32 else None
        if order is None:  # numbers of more than 31 bits
            by = np.lexsort((right, left))
            left, right = left[by], right[by]
            first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
            left, right, total = left[first], right[first], len(by)
        else:
            first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
            left, right, total = (order[first] >> 32).astype(np.int32), (order[first] & 0xFFFFFFFF).astype(np.int32), len(order)
        n = np.diff(np.append(first, total))
        for s in range(0, len(n), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + BATCH]) for x in (left, right, n)], ["left", "right", "n"])

    held, size = [], 0
    for b in batches:
        _, _, left, right = _adjacent(b)
        held.append((left, right))
        size += len(left)
        if size >= HELD:
            yield from counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield from counted(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _list_pairs(batches: Batches) -> Batches:
    """The relation to (doc, at, left, right) in order."""
    for b in batches:
        row, at, left, right = _adjacent(b)
        for s in range(0, len(row), BATCH):
            e = s + BATCH
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[s:e])), *(pa.array(x[s:e]) for x in (at, left, right))], ["doc", "at", "left", "right"])


def _numbered(groups: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """``groups`` with a number ``id`` each, written, and how many there are: those of each of some hash buckets take every n-th number."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = materialize(groups, name)
    size = groups.count()
    kind = "int" if size < 1 << 28 else "bigint"
    bucket = F.pmod(F.hash(*keys), F.lit(n)).cast("bigint")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(*keys)).cast("bigint")
    made = groups.withColumn("__b", bucket).withColumn("id", (rank * n + F.col("__b")).cast(kind)).drop("__b")
    return materialize(made, name), size


def _semi_join(rows: DataFrame, groups: DataFrame, size: int, keys: Sequence[str], name: str, broadcast_groups: int) -> DataFrame:
    """The relation of the occurrences ``rows`` (doc, at, keys), which come in order, whose keys are in ``groups``."""
    found = groups.select(*keys, "id")
    if size <= broadcast_groups:
        hits = rows.join(F.broadcast(found), list(keys)).select("doc", "at", "id")
    else:
        hits = rows.join(found, list(keys)).select("doc", "at", "id").repartition("doc").sortWithinPartitions("doc", "at")
    kind = dict(found.dtypes)["id"]
    run = lean(_nest)
    wide_batches()
    return materialize(hits.mapInArrow(run, f"doc long, at array<int>, code array<{kind}>"), name)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, broadcast_groups: int = BROADCAST_GROUPS) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, and the number of all words ``n`` by ``lang``.

    The frame of length k has lang, phrase, f, id, and the counts of its first (``heads``) and last (``tails``) 1 to k - 1 words; from length 2
    also left and right, the ids of its first and last k - 1 words.
    """
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run = lean(_count_words)
    counts = materialize(src.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    empty = F.array().cast("array<bigint>")
    one, size = _numbered(counts.filter(F.col("f") >= least).select("lang", "word", "f"), ["lang", "word"], "phrases-1")
    out = [one.select("lang", F.col("word").alias("phrase"), "f", "id", empty.alias("heads"), empty.alias("tails"))]
    if longest > 1:
        rows = src.select(F.monotonically_increasing_id().alias("doc"), "lang", "text").mapInArrow(lean(_list_words), "doc long, at int, lang string, word string")
        relation = _semi_join(rows, one, size, ["lang", "word"], "occurrences-1", broadcast_groups)
    for k in range(2, longest + 1):
        kind = dict(out[-1].dtypes)["id"]
        run = lean(_count_pairs)
        wide_batches()
        groups = relation.mapInArrow(run, f"left {kind}, right {kind}, n long").groupBy("left", "right").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        groups, size = _numbered(groups, ["left", "right"], f"groups-{k}")
        before = out[-1]
        first = before.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("p"), F.concat("heads", F.array("f")).alias("heads"))
        last = before.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("w"), F.concat("tails", F.array("f")).alias("tails"))
        named = groups.join(first, "left").join(last, "right").select("lang", F.concat_ws(" ", "p", "w").alias("phrase"), "f", "id", "heads", "tails", "left", "right")
        out.append(materialize(named, f"phrases-{k}"))
        if k < longest:
            run = lean(_list_pairs)
            wide_batches()
            relation = relation.withColumn("doc", F.monotonically_increasing_id())  # a task may read several files, each with numbers of its own
            relation = _semi_join(relation.mapInArrow(run, f"doc long, at int, left {kind}, right {kind}"), groups, size, ["left", "right"], f"occurrences-{k}", broadcast_groups)
    return out, total


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = 50, top: int = TOP, broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Words are lowered in A-Z and never cross a piece (``PIECE_END``). A phrase of 2 to ``longest`` words found ``a`` >= ``least`` times scores floor(10**6 a**2 / (l r)) for
    the cut of least score (then of fewest first words) into parts found l and r times. Phrases inside a frequent one that is a word longer and found in ``share`` % of
    their places are left out; a still longer one implies one of those. Order: score, a (both falling), phrase in byte order. A null language is ``und``, null and empty texts have no words, every row counts
    (repeated rows and ids too), other columns are ignored; without frequent phrases there are no rows.
    """
    by_length, total = phrases(docs, text_col, lang_col, longest, least, broadcast_groups)
    parts = []
    for k, found in enumerate(by_length[1:], 2):
        if k < longest:
            longer = by_length[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
            found = found.join(longer, "id", "left").filter(F.col("over").isNull() | (F.col("over") * 100 < F.col("f") * share))
        cuts = [F.struct(F.lit(j).alias("j"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k)]
        found = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*cuts)).alias("c")).select("lang", "phrase", "a", "c.j", "c.l", "c.r")
        found = found.withColumn("score", _ratio("a", "l", "r"))
        best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "j")).alias("b")
        parts.append(found.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.hash("phrase"), F.lit(PARTS))
    first = every.withColumn("__p", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__p").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # PARTS * top rows at most
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # one row a language


def _ratio(a: str, l: str, r: str) -> F.Column:
    """floor(10**6 a**2 / (l r)), exact for counts below 10**15 with a <= l and a <= r: products have up to 37 digits, the quotient 7."""
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) DIV (CAST({l} AS DECIMAL(15,0)) * CAST({r} AS DECIMAL(15,0))) AS BIGINT)")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS p
  FROM (SELECT lang, doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents WHERE text IS NOT NULL)
), ws AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), f1 AS (
  SELECT lang, w AS p, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM ws) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1
), f2 AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM ws) GROUP BY ALL HAVING count(*) >= {LEAST}
), f3 AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM ws) GROUP BY ALL HAVING count(*) >= {LEAST}
), longer AS (
  SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL
), cut AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.p = f2.a JOIN f1 y ON y.lang = f2.lang AND y.p = f2.b
    LEFT JOIN longer z ON z.lang = f2.lang AND z.a = f2.a AND z.b = f2.b WHERE z.f IS NULL OR 100 * z.f < 50 * f2.f
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.p = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.p = f3.c
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cut
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) QUALIFY rank <= {TOP}
"""
