import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from rankforge.llm import packing  # noqa: E402

PATH = public_tokenizers.path(packing.TOKENIZER)
TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet=st.one_of(st.sampled_from("HTJ\u0331\u0308\u030caB'sİΣς é́ͅ \n\t\x0b\x1c\x85\xa0 ***<|endoftext|>ﬁ1½中"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_word_by_word_are_the_ids_of_the_text(text):
    assert np.frombuffer(packing.word_ids(PATH)(text), "<u4").tolist() == plain(text)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    monkeypatch.setattr(packing, "CACHED_PARTS", 2)
    fresh = packing.WordIds(PATH)
    for text in ("a bb ccc dddd", "bb a eeeee " + "x" * 200, "a bb", "ccc", "f g h i a"):
        assert np.frombuffer(fresh(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("length", [7, 64])
def test_pieces_hold_every_id_once(spark, length):
    texts = {1: "Hello there, world! " * 9, 2: None, 3: "", 4: "É*** <|endoftext|> token", 5: "word " * 300, 6: " \n"}
    rows = [(k, t, 9, "x") for k, t in texts.items()] + [(5, texts[5], 9, "x"), (None, "no key", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, ids string").repartition(3, "doc_id")
    pieces = packing.pack(df, PATH, length=length)
    got = sorted((r.asDict() for r in pieces.collect()), key=lambda r: (r["sequence_id"], r["offset"]))
    assert {len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got} == {True}
    at = 0
    for r in got:  # gapless, full sequences
        assert (r["sequence_id"], r["offset"]) == divmod(at, length)
        at += r["length"]
    whole = {}
    for r in got:  # pieces of a document follow one another
        if r["start"] == 0:
            whole.setdefault(r["doc_id"], []).append([])
        doc = whole[r["doc_id"]][-1]
        assert len(doc) == r["start"]
        doc += np.frombuffer(r["ids"], "<u4").tolist()
        assert r["doc_tokens"] == len(plain(texts.get(r["doc_id"], "no key"))) + 1
    assert whole == {**{k: [plain(t) + [1]] for k, t in texts.items()}, 5: [plain(texts[5]) + [1]] * 2, None: [plain("no key") + [1]]}
    seq = packing.sequences(pieces, length).orderBy("sequence_id").collect()
    assert [len(s.ids) for s in seq] == [4 * length] * len(seq) and sum(s.n_tokens for s in seq) == at
    thin = packing.pack(df, PATH, length=length, with_ids=False)
    assert "ids" not in thin.columns and thin.count() == len(got)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
