import corpus_pipeline as C
import public_tokenizers
import sentencepiece

from freshet.llm import quality_rules as Q

from .conftest import ODD
from .test_ngram_join import brute
from .test_shards_mix_lines import brute_lines


def test_stages_follow_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    good = {r.doc_id for r in Q.judge(docs).filter("kept").collect()}
    a = C.rules(spark, docs, sf)
    texts = {r.doc_id: r.text for r in a.collect()}
    assert a.columns == names and texts.keys() == good and 0.5 < len(good) / docs.count() < 1
    b = C.lines(spark, a, sf)
    want = {k: t for k, (t, _, gone) in brute_lines(texts).items() if not gone or t.split()}
    texts = {r.doc_id: r.text for r in b.collect()}
    assert b.columns == names and texts == want and all(r.n_chars == len(r.text) for r in b.collect())
    c = C.near(spark, b, sf)
    keep = {k for k, (_, root) in brute(texts, 5, 80).items() if root == k}
    assert c.columns == names and {r.doc_id for r in c.collect()} == keep
    d = C.mix(spark, c, sf)
    mixed = [r.doc_id for r in d.collect()]
    assert d.columns == names and set(mixed) == keep and len(mixed) <= 2 * len(keep)
    e = C.ids(spark, d, sf).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(r.doc_id for r in e) == sorted(mixed)
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.same for r in e)
    assert C.run(spark, sf).count() == len(e)


def test_stages_on_odd_rows(spark, sf, odd, none):
    for rows in (odd, none):
        docs = rows
        for _, stage in C.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
    assert Q.keep_good(odd).columns == odd.columns
    assert C.near(spark, odd, sf).count() <= len(ODD) + 2


GOOD = " ".join(f"word{i}" for i in range(80))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, row string"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in rows], SCHEMA)


def test_each_stage_gives_odd_rows_their_defined_result(spark, sf):
    pick = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    rows = [(None, GOOD, "a"), (1, GOOD, "a"), (1, GOOD, "a"), (2, None, "a"), (3, "", None), (4, "short text", None), (5, GOOD.replace("word", "other"), None), (1, GOOD.replace("word", "third"), "b")]
    docs = _table(spark, rows)
    # rules: null, empty and short texts go, null ids, shared ids and repeats stay
    kept = [(i, t) for i, t, _ in rows if t and len(t.split()) >= 50]
    assert pick(C.rules(spark, docs, sf)) == sorted(kept, key=repr)
    # lines: a null id comes first, so its lines are the first occurrence; the others lose theirs
    block = "\n".join(f"line {k} of a passage that is found again" for k in range(3))
    lined = [(7, f"{block}\nown end", "a"), (8, f"own head\n{block}", "a"), (9, block, "a"), (None, block, "a"), (10, None, "a")]
    got = C.lines(spark, _table(spark, lined), sf).collect()
    assert {(r.doc_id, r.text) for r in got} == {(7, "own end"), (8, "own head"), (None, block), (10, None)}  # 9 has no word left
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.hash == r.row == "clash" for r in got)
    # near: one of equal rows stays, null ids and rows without words stay, other texts of an id stay
    near = pick(C.near(spark, docs, sf))
    assert near == sorted(((i, t) for i, t in {(i, t) for i, t, _ in rows}), key=repr)
    # mix: every row at least once, a null source is a source
    mixed = C.mix(spark, docs, sf).collect()
    assert {(r.doc_id, r.text) for r in mixed} == {(i, t) for i, t, _ in rows} and len(mixed) >= len(rows)
    # ids: a row each, null texts have none
    coded = C.ids(spark, docs, sf).collect()
    assert len(coded) == len(rows) and sorted(len(r.ids) for r in coded)[:2] == [0, 0] and all(r.same for r in coded)
