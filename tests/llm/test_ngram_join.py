import random
import re

import numpy as np
import pytest

from freshet.llm import ngram_join as J

from .conftest import SCHEMA


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(texts, width, percent):
    sets = {k: shingles(t, width) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, sf, texts, width, percent):
    got = J.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), width=width, percent=percent).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_edited_groups_of_all_sizes(spark, width, percent):
    rng = random.Random(7)
    made = []
    for size in [3, 6, 9, 12, 15, 20, 25, 30, 50, 80, 120, 200, 400]:
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for edits in [0, 0, 1, 1, 2, 3, 4, 6]:
            t = [*base]
            for _ in range(edits):
                t[rng.randrange(len(t))] = f"e{rng.randrange(9)}"
            made.append(" ".join(t[rng.randrange(2) :]))
    common = " ".join(f"p{i}" for i in range(30))
    made += [common + " " + " ".join(f"u{i}x{k}" for k in range(12)) for i in range(25)]
    rng.shuffle(made)
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(made)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute({i * 3: t for i, t in enumerate(made)}, width, percent)


def test_odd_rows(spark, odd, none):
    extra = spark.createDataFrame([(None, "a b c d", None, None, 1, "", 1), (None, None, None, None, 1, "", 1)], SCHEMA)
    rows = odd.union(extra)
    got = J.near_duplicates(rows, width=3, percent=90).collect()
    assert len(got) == rows.count()
    want = brute({r.doc_id: r.text for r in odd.collect()}, 3, 90)
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == want[r.doc_id]
    assert J.near_duplicates(none).count() == 0
    kept = J.keep_one(rows).collect()
    assert {r.doc_id for r in kept} == {k for k, (_, c) in brute({r.doc_id: r.text for r in odd.collect()}, 5, 80).items() if c == k} | {None}
    assert len([r for r in kept if r.doc_id in (5, 6)]) == len({r.doc_id for r in kept} & {5, 6})  # of equal rows one stays
    assert J.keep_one(none).columns == none.columns


def test_rows_that_share_an_id(spark):
    a, b, c = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in J.near_duplicates(df).collect() if r.doc_id)
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4)]
    assert sorted((r.doc_id or 0, r.text) for r in J.keep_one(df).collect()) == [(0, c), (1, a), (2, b), (4, c)]


def test_a_group_whose_centre_is_an_edited_copy(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    made = []
    for k in range(120):
        t = [*base]
        if k % 40:
            t[rng.randrange(5, 55)] = f"own{k}"
        made.append(" ".join(t))
    df = spark.createDataFrame([*enumerate(made)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == brute(dict(enumerate(made)), 5, 80)


def test_pairs_that_cannot_link_cost_no_product(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    made = []
    for k in range(300):  # each has a stretch of its own that is too long for a link between any two
        at = rng.randrange(280)
        made.append(" ".join([*base[:at], *(f"own{k}_{j}" for j in range(18)), *base[at + 18 :]]))
    tried, real = [], J.materialize

    def watched(df, name):
        out = real(df, name)
        if name in ("star-pairs", "open-pairs"):
            tried.append(out.count())
        return out

    monkeypatch.setattr(J, "materialize", watched)
    df = spark.createDataFrame([*enumerate(made)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(df, width=3, percent=90).collect()}
    assert got == {k: k for k in range(300)} and sum(tried) == 0


def test_long_chains_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.node: r.root for r in J.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100}


def test_same_result_for_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = {tuple(r) for r in J.near_duplicates(docs, width=3, percent=90).collect()}
    b = {tuple(r) for r in J.near_duplicates(docs.repartition(13), width=3, percent=90).collect()}
    assert a == b and len({r[2] for r in a}) < len(a)


@pytest.mark.parametrize("which", ["none", "all", "half"])
def test_common_grams_change_only_the_work(spark, sf, texts, which, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = J.common_grams

    def other(df, width):
        every = np.unique(np.array([h for r in df.mapInArrow(J._rows(width), "id long, grams array<long>").collect() for h in r.grams], np.int64)).view(np.uint64)
        return {"none": every[:0], "all": every, "half": every[::2]}[which]

    monkeypatch.setattr(J, "common_grams", other)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()}
    assert got == brute(texts, 5, 80)
    assert found(docs.selectExpr("doc_id id", "text __text"), 5).dtype == np.uint64


@pytest.mark.parametrize("small", [0, 2, 10**6])
def test_small_buckets_change_only_the_work(spark, small, monkeypatch):
    rng = random.Random(19)
    made = []
    for size in (12, 40, 150):
        base = [f"w{size}_{i}" for i in range(size)]
        for k in range(24):
            t = [*base]
            for _ in range(rng.choice([0, 1, 2, 4, size // 8, size // 4])):
                t[rng.randrange(size)] = f"e{rng.randrange(5)}"
            made.append(" ".join([*t, *(f"own{size}_{k // 2}_{j}" for j in range(size // 6))]))
    monkeypatch.setattr(J, "SMALL", small)
    df = spark.createDataFrame([*enumerate(made)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == brute(dict(enumerate(made)), 5, 80)


def test_members_of_small_buckets_are_not_taken_apart(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"w{i}" for i in range(200)]
    made = [" ".join(base)]
    for k in range(8):  # each shares two thirds with the first text, so blocks are equal, and links with nothing or with one other
        at = 15 * (k // 2) + rng.randrange(10)
        made.append(" ".join([*base[:at], *(f"own{k // 2 if k < 4 else k}_{j}" for j in range(70)), *base[at + 70 :]]))
    rows, real = {}, J.materialize

    def watched(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(J, "materialize", watched)
    df = spark.createDataFrame([*enumerate(made)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == brute(dict(enumerate(made)), 5, 80)
    assert rows["pairs"] > 1 and rows["differences"] == 0


@pytest.mark.parametrize("common", [False, True])
@pytest.mark.parametrize("percent", [50, 80, 90])
def test_rows_within_the_bound_agree_in_more_blocks_than_they_leave(percent, common):
    rng = np.random.default_rng(29)
    c = J.Classes(percent, 4096)
    left = []
    for size in [12, 19, 33, 40, 64, 90, 150, 233, 400, 900]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << J.HASH_BITS, size, np.uint64))
            k = 2 * len(a) * (100 - percent) // (100 + percent)
            out = k // 2
            b = np.sort(np.concatenate([a[rng.permutation(len(a))[out:]], np.unique(rng.integers(0, 1 << J.HASH_BITS, k - out, np.uint64))]))
            both = np.intersect1d(a, b)
            if 100 * len(both) < percent * (len(a) + len(b) - len(both)):
                continue
            gone = rng.choice(both, len(both) // 3) if common else both[:0]
            sizes, row, label = np.array([1]), np.array([0]), int(c.of(np.array([max(len(a), len(b))]))[0])
            found = []
            for keys in (a, b):
                keys = keys[~np.isin(keys, gone)]
                sig, _, spare = J._blocks(keys, sizes, row, np.array([label]), c)
                found.append((set(sig.tolist()), int(spare[0])))
            left += [n for _, n in found]
            assert c.m[label] == 0 or len(found[0][0] & found[1][0]) > max(n for _, n in found)
    assert max(left) > 0


def test_buckets_keep_what_their_rows_leave_across_batches():
    import pyarrow as pa

    rows = [(5, 1, 9, J.SET, 0), (7, 1, 9, J.BLOCK, 6), (7, 2, 9, J.BLOCK, 8), (7, 3, 8, J.BLOCK, 3), (8, 4, 70_000_000, J.BLOCK, 4), (9, 1, 9, J.BLOCK, 6), (9, 3, 8, J.BLOCK, 2)]
    batch = lambda r: pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]]), pa.array([(r[2] << (J.LEAVE_BITS + 2)) + (r[4] << 2) + r[3]])], ["sig", "id", "tag"])
    got = [tuple(r.values()) for b in J._gather(iter([batch(r) for r in rows])) for r in b.to_pylist()]
    assert sorted(got) == [(J.SET, 5, 1, 9, 1, 9, 0), (J.BLOCK, 7, 1, 9, 1, 9, 6), (J.BLOCK, 7, 2, 9, 1, 9, 8), (J.BLOCK, 7, 3, 8, 1, 9, 3), (J.BLOCK, 9, 1, 9, 1, 9, 6), (J.BLOCK, 9, 3, 8, 1, 9, 2)]


def test_texts_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    rng = random.Random(31)
    made = []
    passage = [f"p{i}" for i in range(40)]
    for k in range(120):  # in a large table so few texts share it that its n-grams are not common ones
        own = [f"own{k}_{j}" for j in range(160)]
        at = rng.randrange(160)
        made.append(" ".join([*own[:at], *passage, *own[at:]]))
    made += [made[0] + " end", made[1] + " end"]
    rows, real = {}, J.materialize

    def watched(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(J, "materialize", watched)
    monkeypatch.setattr(J, "LOOK_TEXTS", 10**6)
    df = spark.createDataFrame([*enumerate(made)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == brute(dict(enumerate(made)), 5, 80)
    assert rows["pairs"] == 2 and rows["differences"] == 0


def test_members_are_taken_apart_once_whatever_their_centres(spark, monkeypatch):
    rng = random.Random(37)
    made = []
    long = [f"p{j}" for j in range(240)]
    for k in range(80):  # four stretches of one passage that overlap, so the buckets of a text have several centres; only the first texts link
        at = 30 * (k % 4)
        made.append(" ".join([*long[at : at + 150], *(f"own{k % 4 if k < 8 else k}_{j}" for j in range(50 + k // 4 % 2))]))
    rng.shuffle(made)
    rows, real = {}, J.materialize

    def watched(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(J, "materialize", watched)
    monkeypatch.setattr(J, "LOOK_TEXTS", 10**6)
    df = spark.createDataFrame([*enumerate(made)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == brute(dict(enumerate(made)), 5, 80)
    assert 0 < rows["differences"] <= sum(n for n, _ in got.values())


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    import time

    from freshet.llm.tables import materialize

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before = held()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_to = spark.conf.get(key, None)
    plan = spark.range(20_000).withColumn("k", J.F.xxhash64("id")).repartition(4, "k")  # kept, as a caller keeps its frames
    out = materialize(plan, "written")
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key, None) == set_to
    assert out.count() == plan.count() == 20_000  # the plan can be computed again


@pytest.mark.parametrize("most", [1, 10**6])
def test_only_rows_that_a_list_of_pairs_names_are_moved(spark, most, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", most)
    grams = spark.createDataFrame([(i, [i, i + 1]) for i in range(500)], "id long, grams array<long>").repartition(3)
    pairs = spark.createDataFrame([(1, 7), (1, 9), (400, 3)], "a long, b long")
    found = J._beside(pairs, grams)
    assert sorted((r.a, r.b, r.x, r.y) for r in found.collect()) == [(a, b, [a, a + 1], [b, b + 1]) for a, b in [(1, 7), (1, 9), (400, 3)]]
    assert ("left_semi" in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")) == (most > 1)
