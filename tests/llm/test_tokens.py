import random

import numpy as np
import public_tokenizers as P
import pytest

from arealedger.llm import tokens
from arealedger.llm.bpe_codec import codec
from arealedger.llm.tokens import Encoder, PieceCache

BITS = ["a", "B", ".", " ", "\n", "\n\n", "  ", "\t", ",", "!", "'s", "<|endoftext|>", "é", "İ", "Σ", "ß", "1", "23", "_", "\x1d", "\xa0", "　", "é", "漢", "🙂", "word", "Thing", "..", "don't", " .", " ,", "<|startoftext|>"]


def texts(n=6000):
    rng = random.Random(1)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(n)] + ["", " ", "x " * 50_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    e = Encoder(P.path(name))
    some = texts()
    for t, got, want in zip(some, e.encode(some), e.tok.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("limit", [0, 40, 10_000])
def test_signs_behind_letters_and_full_caches(name, limit):
    """Whatever is kept, ids are the library's: signs behind a letter, and letters whose composed form ends in a mark."""
    e, rng = Encoder(P.path(name), limit), random.Random(2)
    ends = ["", ".", ",", "!!", "'", "'s", "...!", "_", "?)", "\u0301."]
    for _ in range(20):
        some = [" ".join(rng.choice(["word", "Ça", "\u0958", "\u0130", "\ufb1d", "漢", "x1", "(a", "é", "µ", "-"]) * rng.randint(1, 3) + rng.choice(ends) for _ in range(30)) for _ in range(20)]
        for t, got, want in zip(some, e.encode(some), e.tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(t)


def test_a_full_cache_keeps_what_it_knows():
    """Frequent words aren't encoded again because rare ones come along; of a changed vocabulary the cache starts anew."""
    e, asked = Encoder(P.path("word_bpe_49k.json"), 60), []
    own = e._library
    e._library = lambda pieces: asked.append(pieces) or own(pieces)
    word = lambda i: "w" + "abcdefghij"[i // 100 % 10] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10]
    for k in range(8):
        e.encode([" ".join(word(i) for i in [*range(50), *range(100 + 20 * k, 120 + 20 * k)]) + "!!"])
    assert sum("waaa" in x for x in asked) == 1 and len(e.place) <= 60 + 22
    e.encode([" ".join(word(i) for i in range(500, 550))])
    asked.clear()
    e.encode([" ".join(word(i) for i in range(500, 550))])
    assert not asked


def test_own_bpe_equals_the_library():
    path = P.path("word_bpe_49k.json")
    lib, own = Encoder(path).tok, codec(path)
    for t in texts(3000):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == ids, repr(t)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_a_full_cache_starts_anew():
    c = PieceCache(lambda x: [p * 2 for p in x], limit=3)
    for batch in (["a", "b"], ["b", "c", "d"], ["e", "f", "g", "h"]):
        assert all(c.ready(batch)[p] == p * 2 for p in batch)


def test_a_worker_lets_go_of_freed_memory(monkeypatch):
    """After a task, when the last batch is out, and not before."""
    said = []
    monkeypatch.setattr(tokens, "let_go", lambda: said.append("gone"))
    for x in tokens.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2])):
        said.append(x)
    assert said == [2, 4, "gone"]


def test_pipeline_hands_texts_to_python_in_small_batches(spark):
    """400 texts of 100 kB were one batch, which an executor and its worker hold twice each."""
    import pyarrow as pa

    from arealedger.llm.common import BATCH, BATCH_KEY, small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    before = spark.conf.get(BATCH_KEY)
    with small_batches(spark):
        got = spark.range(0, 400, 1, 1).selectExpr("repeat('ab cd', 20000) AS text").mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) < BATCH + 200_000
    assert spark.conf.get(BATCH_KEY) == before


def test_packing_is_the_same_with_little_memory(spark):
    from arealedger.llm import config_packing
    from arealedger.llm.queries import tokenizer

    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 97} r{k}." for k in range(i * 7))) for i in range(60)] + [(60, None)], "doc_id bigint, text string")
    both = [sorted(map(tuple, config_packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), size=64, **more).collect())) for more in ({}, {"kept": 20, "most": 100})]
    assert both[0] == both[1] and len(both[0]) > 100
