"""Quality rules with thresholds that adapt to each language and source.

Base measures of a text are counted exactly. For the verdict, each (language, source) pair keeps a
mergeable quantile sketch of six ratios: counts in logarithmic bins of relative width 2 %, so
sketches of any split of the rows add up to the same sketch. A limit is the median plus
``SPREAD`` times the distance from the tenth percentile to the median, and for a share at most halfway from the median to 1. Both come from the lower half of a
group, which junk does not move until it is half of the group. No ratio has a fixed limit or floor.

Quantiles of a pair are blended with those of its language, and these with the corpus's, as if each had ``PRIOR`` texts of the wider
group besides its own; so small groups follow the wider one without a switch. A text breaks a limit when it lies above it by more than
``EVENTS`` characters (or lines) and ``SPREAD`` deviations of a count with the median's expectation: shares of short texts move in such steps, and
where most texts have none of a kind the count is all there is to go by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .tables import materialize, read_table
from .texts import HASH_BITS, WHITE, chunks, lean, lines, pieces, small_batches, span_hashes, trim, windows

#: Ratio and what its events are counted over (a share of repeated words moves by whole lines); the last one is a mean, no share.
RATIOS = {"symbol_share": "chars", "upper_share": "chars", "bang_share": "chars", "repeat_share": "lines", "dup_line_share": "lines", "word_length": "words"}
MEANS = ("word_length",)
SPREAD, EVENTS, PRIOR, WIDTH = 6.0, 3.0, 10.0, 1.02
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL, _UPPER, _BANG, _LEAD = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_BANG[33] = True
_LEAD[:] = (np.arange(256) & 0xC0) != 0x80


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] - total[offs[:-1]]


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every row of a chunk, as int64 arrays."""
    n = len(offs) - 1
    start, end, row = pieces(buf, offs, WHITE)
    count = np.bincount(row, minlength=n)
    words = span_hashes(buf, start, end)
    h, at = windows(words, row, 3)
    rows = row[at].astype(np.uint64)
    key = (rows << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    hit = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(words) + 3, bool)
    for k in range(3):
        cover[hit + k] = True
    ls, le, lr = lines(buf, offs)
    solid = np.concatenate([[0], np.cumsum(~WHITE[buf])])
    full = solid[le] > solid[ls]
    ls, le, lr = ls[full], le[full], lr[full]
    lkey = np.unique((lr.astype(np.uint64) << np.uint64(HASH_BITS)) | (span_hashes(buf, ls, le) >> np.uint64(64 - HASH_BITS)))
    n_lines = np.bincount(lr, minlength=n)
    distinct = np.bincount((lkey >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n)
    return {
        "n_words": count,
        "word_chars": _per_row(_LEAD[buf] & ~WHITE[buf], offs),
        "n_symbols": _per_row(_SYMBOL[buf], offs),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": np.bincount(row[cover[: len(words)]], minlength=n),
        "n_lines": n_lines,
        "n_upper": _per_row(_UPPER[buf], offs),
        "n_bangs": _per_row(_BANG[buf], offs),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``id_col``, ``keep`` and the counts of each whole text (null: empty), one row per input row."""
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in chunks(b.column("__text")):
                m = measure(buf, offs)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in names), *(pa.array(m[c].astype(np.int64)) for c in COUNTS)], [*names, *COUNTS])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), *(f"{c} long" for c in COUNTS)])
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(lean(run), schema)


def _ratios(counts: DataFrame) -> DataFrame:
    chars, words, lines = (F.greatest(c, F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    return counts.withColumns({
        "symbol_share": F.col("n_symbols") / chars, "upper_share": F.col("n_upper") / chars, "bang_share": F.col("n_bangs") / chars,
        "repeat_share": F.col("n_repeat_words") / words, "dup_line_share": F.col("n_dup_lines") / lines, "word_length": F.col("word_chars") / words, "chars": chars, "words": words, "lines": lines,
    })


def sketch(counts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, ratio, bin, n): counts of texts in logarithmic bins; partial counts merge by adding."""
    long = _ratios(counts).select(
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), F.floor(F.log(F.greatest(F.col(k), F.lit(1e-4))) / F.log(F.lit(WIDTH))).cast("int").alias("bin")) for k in RATIOS))).alias("x")
    )
    return long.groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count("*").alias("n"))


_Q = ("q10", "q50")


def _quantiles(bins: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, "ratio").orderBy("bin")
    cum = bins.groupBy(*by, "ratio", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).withColumn("rows", F.sum("n").over(Window.partitionBy(*by, "ratio")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.pow(F.lit(WIDTH), F.col("bin") + 0.5)))
    return cum.groupBy(*by, "ratio").agg(F.max("rows").alias("rows"), at(0.1).alias("q10"), at(0.5).alias("q50"))


def limits(bins: DataFrame) -> DataFrame:
    """One row per (lang, source) with an upper limit and the median per ratio, from its own sketch blended with the wider ones."""
    own = _quantiles(bins, ["lang", "source"])
    lang = _quantiles(bins, ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("lr"), F.struct("rows", *_Q).alias("by_lang"))
    every = _quantiles(bins, []).select(F.col("ratio").alias("er"), F.struct(*_Q).alias("by_all"))
    q = own.join(lang, own.lang.eqNullSafe(lang.l) & (own.ratio == lang.lr)).join(every, F.col("ratio") == F.col("er"))
    blend = lambda rows, mine, wider: (rows * mine + PRIOR * wider) / (rows + PRIOR)
    at = {c: blend(F.col("rows"), F.col(c), blend(F.col("by_lang.rows"), F.col(f"by_lang.{c}"), F.col(f"by_all.{c}"))) for c in _Q}
    q = q.select("lang", "source", "ratio", *(v.alias(c) for c, v in at.items()))
    limit = F.col("q50") + SPREAD * (F.col("q50") - F.col("q10"))
    halfway = (1 + F.least(F.col("q50"), F.lit(1.0))) / 2
    of = lambda k, c: F.max(F.when(F.col("ratio") == k, c))
    return q.groupBy("lang", "source").agg(*(x for k in RATIOS for x in (of(k, limit if k in MEANS else F.least(limit, halfway)).alias(f"max_{k}"), of(k, F.col("q50")).alias(f"mid_{k}"))))


def _base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _verdict() -> F.Column:
    """No base failure and no ratio above its limit; a pair without limits has none to break."""
    ok = ~_base_failed()
    for k, unit in RATIOS.items():
        more = (EVENTS + SPREAD * F.sqrt(F.col(f"mid_{k}") * F.col(unit))) / F.col(unit)
        ok = ok & F.coalesce(F.col(k) <= F.col(f"max_{k}") + more, F.lit(True))
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null or empty texts have no words and fail the base. Null languages and sources form groups of
    their own. Repeated rows are judged each for itself; other columns are ignored. The counts are
    written once to the shared folder, since both the sketches and the verdict read them.
    """
    counts = materialize(text_counts(docs, id_col, text_col, (lang_col, source_col)), "counts")
    lim = limits(sketch(counts, lang_col, source_col)).withColumnsRenamed({"lang": "__l", "source": "__s"})
    rated = _ratios(counts)
    return rated.join(lim, rated[lang_col].eqNullSafe(lim["__l"]) & rated[source_col].eqNullSafe(lim["__s"]), "left").withColumn("base_failed", _base_failed()).withColumn("kept", _verdict()).drop("__l", "__s")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts_of(col: pa.Array) -> pa.Array:
    made = [measure(buf, offs) for _, _, buf, offs in chunks(col)]
    trim()
    return pa.StructArray.from_arrays([pa.array(np.concatenate([m[c] for m in made]).astype(np.int64) if made else np.zeros(0, np.int64)) for c in COUNTS], list(COUNTS))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; the same verdicts as ``judge``, row by row.

    The sketches are made in a first pass; the second measures each text again beside its row, which saves
    a shuffle of the texts.
    """
    small_batches()
    key = docs.select(F.col(text_col).alias("__t"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.lit(0).alias("__id"))
    lim = materialize(limits(sketch(text_counts(key, "__id", "__t"))).withColumnsRenamed({"lang": "__l", "source": "__s"}), "limits")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), _counts_of(F.coalesce(F.col(text_col), F.lit(""))).alias("m"))
    rated = _ratios(rows.select("row", "lang", "source", "m.*"))
    both = rated.join(lim, rated["lang"].eqNullSafe(lim["__l"]) & rated["source"].eqNullSafe(lim["__s"]), "left")
    return both.filter(_verdict()).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RATES = {"symbol_share": "n_symbols / chars", "upper_share": "n_upper / chars", "bang_share": "n_bangs / chars", "repeat_share": "n_repeat_words / words", "dup_line_share": "n_dup_lines / lines", "word_length": "word_chars / words"}
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), gram AS (
  SELECT a.doc_id, a.i, a.x || ' ' || b.x || ' ' || c.x AS g FROM word a JOIN word b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN word c ON c.doc_id = a.doc_id AND c.i = a.i + 2
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1
), line AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d
), solid AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1
), base AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (coalesce(s.n, 0) - coalesce(s.u, 0))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(s.n, 0)::BIGINT AS n_lines,
    (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) AS n_upper, (length(t) - length(translate(t, '!', ''))) AS n_bangs
  FROM d LEFT JOIN solid s ON s.doc_id = d.doc_id LEFT JOIN cover c ON c.doc_id = d.doc_id
), unit AS (
  SELECT *, greatest(word_chars, 1)::DOUBLE AS chars, greatest(n_words, 1)::DOUBLE AS words, greatest(n_lines, 1)::DOUBLE AS lines FROM base
), rate AS (
  SELECT doc_id, lang, source, unnest([{", ".join(f"'{k}'" for k in _RATES)}]) AS ratio, unnest([{", ".join(_RATES.values())}]) AS v, unnest([{", ".join(RATIOS[k] for k in _RATES)}]) AS unit FROM unit
), bins AS (
  SELECT lang, source, ratio, CAST(floor(ln(greatest(v, 1e-4::DOUBLE)) / ln({WIDTH}::DOUBLE)) AS INT) AS b, count(*) AS n FROM rate GROUP BY ALL
), level AS (
  SELECT lang, source, ratio, b, n, 0 AS k FROM bins UNION ALL SELECT lang, NULL, ratio, b, sum(n), 1 FROM bins GROUP BY lang, ratio, b UNION ALL SELECT NULL, NULL, ratio, b, sum(n), 2 FROM bins GROUP BY ratio, b
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY k, lang, source, ratio ORDER BY b) AS upto, sum(n) OVER (PARTITION BY k, lang, source, ratio) AS total FROM level
), q AS (
  SELECT k, lang, source, ratio, max(total) AS total, {", ".join(f"min(pow({WIDTH}::DOUBLE, b + 0.5::DOUBLE)) FILTER (WHERE upto >= {p}::DOUBLE * total) AS q{p * 100:.0f}" for p in (0.1, 0.5))} FROM cum GROUP BY ALL
), pick AS (
  SELECT o.lang, o.source, o.ratio, {", ".join(f"(o.total * o.{c} + {PRIOR}::DOUBLE * ((l.total * l.{c} + {PRIOR}::DOUBLE * e.{c}) / (l.total + {PRIOR}::DOUBLE))) / (o.total + {PRIOR}::DOUBLE) AS {c}" for c in _Q)}
  FROM q o JOIN q l ON l.k = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.ratio = o.ratio JOIN q e ON e.k = 2 AND e.ratio = o.ratio WHERE o.k = 0
), verdict AS (
  SELECT doc_id, bool_and(v <= CASE WHEN ratio IN ({", ".join(f"'{k}'" for k in MEANS)}) THEN q50 + {SPREAD}::DOUBLE * (q50 - q10) ELSE least(q50 + {SPREAD}::DOUBLE * (q50 - q10), (1 + least(q50, 1.0::DOUBLE)) / 2) END
    + ({EVENTS}::DOUBLE + {SPREAD}::DOUBLE * sqrt(q50 * unit)) / unit) AS ok
  FROM rate r JOIN pick p USING (ratio) WHERE p.lang IS NOT DISTINCT FROM r.lang AND p.source IS NOT DISTINCT FROM r.source GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND ok AS kept
FROM base JOIN verdict USING (doc_id)
"""
