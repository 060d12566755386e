import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import piece_codec as P

from .conftest import ODD

PATH = public_tokenizers.path(P.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(spark, sf, texts, library):
    got = {r.doc_id: r for r in P.op3_sentencepiece(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert got[k].ids == library.encode(t), t[:80]
        assert got[k].same and got[k].n_ids == len(got[k].ids) and got[k].decoded_crc32 == zlib.crc32(t.encode())


def test_odd_texts(odd, none, library):
    got = P.round_trip(odd, PATH).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        t = ODD[r.doc_id] or ""
        assert r.ids == library.encode(t), t[:50]
        assert r.same
    back = {r.doc_id: r.text for r in P.decode(P.encode(odd, PATH), PATH).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD)}
    assert P.round_trip(none, PATH).count() == 0 and P.decode(P.encode(none, PATH), PATH).count() == 0


def test_random_words_from_pieces(library):
    rng = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))) for _ in range(6000)]
    made += ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    made += ["ab" * 40, "a" * 47, "aaaa", "eeeeeee", "x" * 5000, " " * 1000]
    ids, cut = P.codec(PATH).encode(made)
    wrong = [t for k, t in enumerate(made) if ids[cut[k] : cut[k + 1]].tolist() != library.encode(t)]
    assert not wrong, wrong[:5]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_any_text(t):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, cut = P.codec(PATH).encode([t])
    if "\0" not in t:
        assert ids.tolist() == library.encode(t)
    assert P.codec(PATH).decode(ids, cut) == [t.replace("▁", " ")]


def test_long_strings_and_runs_of_spaces(library):
    rng = random.Random(5)
    made = ["".join(rng.choice(al) for _ in range(n)) for al in ("ACGT", "aeinrst", "x", "漢字かな語中文", "0123456789abcdef", "ab ", " é") for n in (31, 32, 33, 400, 70_000)]
    made += [" " * k + x for k in range(1, 70) for x in ("a", "漢", "", "\n b", "é")]
    made += ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)), "word " * 300_000]
    c = P.codec(PATH)
    for part in (made[:5], made[5:]):
        ids, cut = c.encode(part)
        wrong = [t[:40] for k, t in enumerate(part) if ids[cut[k] : cut[k + 1]].tolist() != library.encode(t)]
        assert not wrong, wrong[:5]
        assert c.decode(ids, cut) == part


def test_words_forgotten_and_learned_again(library, texts, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 50)
    c = P.codec(PATH)
    for t in [*texts.values()][:40]:
        assert c.encode([t])[0].tolist() == library.encode(t)
