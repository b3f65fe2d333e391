import os
import random

import pytest

from quern.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no vocabulary file")
ODD = ["a", "b", "the", " ", "  ", "\n", "\r", "é", "ệ", "🙂", "12", "<|endoftext|>", "'s", "ing", "😭😭", "​", "\x00", "中文", "aaaaaaaaaaaaaa"]


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    return [*out, "a" * 5000, " " * 3000, "ha" * 3000, *("".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 30))) for _ in range(3000))]


def test_same_ids_as_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    mine, all_ = bpe.encoder(bpe.vocabulary_path()), texts()
    assert [mine.encode(x) for x in all_] == [x.ids for x in t.encode_batch(all_, add_special_tokens=False)]


def test_small_tables_give_the_same(monkeypatch):
    whole = bpe.Encoder(bpe.load(bpe.vocabulary_path()))
    want = [whole.encode(x) for x in texts()[:300]]
    monkeypatch.setattr(bpe, "KEPT", 50)
    small = bpe.Encoder(whole.a)
    assert [small.encode(x) for x in texts()[:300]] == want


def test_round_trip(spark):
    rows = [(i, t, i) for i, t in enumerate([None, "", *texts()[:50]])]
    df = bpe.with_text(bpe.with_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids bigint")))
    for r in df.collect():
        assert r.decoded == (r.text or "") and (r.ids == [] if not r.text else r.ids)
    n = bpe.with_token_count(spark.createDataFrame(rows, "doc_id bigint, text string, ids bigint"))
    assert {r.doc_id: r.tokens for r in n.collect()}[0] == 0
