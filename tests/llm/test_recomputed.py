"""Scores, fingerprints and components recomputed in plain Python; very long texts; one text in thousands of rows."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from arealedger.llm import bpe_codec, config_packing, iso_media, label_propagation, permutation_minhash, secret_battery, shingle_groups, simhash_golay, toxic_crf, wavelet_tokens

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "thing", "more", "less", "every"]) + str(rng.randint(0, 40)) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(5)


def test_marginals_and_scores_by_enumeration(spark):
    rng = random.Random(7)
    terms = {t: rng.gauss(0, 1) for w in ("bad", "worse", "fine", "good", "ugly") for t in toxic_crf.terms(w)}
    fit = toxic_crf.Field(terms, -0.3, np.array([[1.4, 0.6], [0.5, 1.9]]), np.array([-1.0, 0.7, 1.3]))
    texts = [" ".join(rng.choice(["bad", "worse", "fine", "good", "ugly", "plain"]) for _ in range(n)) for n in (1, 2, 5, 9)] + ["", None, "..."]
    got = {r["doc_id"]: r for r in toxic_crf.with_scores(frame(spark, texts), fit, "text", "score", "spans").collect()}
    for i, t in enumerate(texts):
        w = toxic_crf.WORD.findall(t or "")
        emit = [math.exp(-0.3 + sum(terms.get(x, 0.0) for x in toxic_crf.terms(v))) for v in w]
        total, ones = 0.0, [0.0] * len(w)
        for path in range(1 << len(w)):
            s = [path >> k & 1 for k in range(len(w))]
            p = math.prod(e for e, k in zip(emit, s, strict=True) if k) * math.prod(fit.trans[a][b] for a, b in zip(s, s[1:]))
            total += p
            for k in range(len(w)):
                ones[k] += p * s[k]
        m = [x / total for x in ones]
        z = -1.0 + 0.7 * math.log1p(sum(m)) + 1.3 * max(m, default=0.0)
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert got[i]["spans"] == ",".join(f"{x.start()}:{x.end()}" for x, p in zip(toxic_crf.WORD.finditer(t or ""), m, strict=True) if p >= 0.5)


def fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))], np.uint64)
    bits = [(int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h)) for b in range(64)]
    return sum(1 << b for b, one in enumerate(bits) if one)


def test_fingerprints_and_components_of_short_and_long_texts(spark):
    rng = random.Random(9)
    base = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = [*base, *[b + " " + words(rng, 1) for b in base[:30]], None, "", "\x0b\t", "A b", "a B", words(rng, 40_000), words(rng, 60_000)]
    texts += [texts[-1] + " end", texts[-2]]
    prints = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):  # the least number reachable, by plain rounds
        new = [min(root[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(texts))]
        if new == root:
            break
        root = new
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_golay.simhash_groups(frame(spark, texts)).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in enumerate(prints)}


@pytest.fixture(scope="module")
def hot(spark):
    """5,000 rows of one text, some near copies of it, and others; one text of over 200,000 characters."""
    rng = random.Random(5)
    many = words(rng, 90)
    texts = [many] * 5000 + [many.replace("the", f"t{i}he", 1) for i in range(40)] + [words(rng, 30) for _ in range(60)] + [words(rng, 45_000), "", None]
    return texts, frame(spark, texts).cache()


OPERATORS = {
    "op3": lambda d: permutation_minhash.fingerprints(d).select("doc_id", "fingerprint"),
    "op5": lambda d: secret_battery.secrets(d).select("doc_id", "spans"),
    "op6": lambda d: iso_media.media_columns(d).select("doc_id", "media_sha256"),
    "op7": lambda d: wavelet_tokens.wavelet_tokens(d, WORD).select("doc_id", "ids_crc32"),
    "op8": lambda d: simhash_golay.simhash_groups(d).select("doc_id", "fingerprint"),
    "op10": lambda d: bpe_codec.bpe_digests(d, WORD).select("doc_id", "ids_sha256"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_equal_texts_get_equal_values_in_a_hot_group(hot, name):
    texts, docs = hot
    rows = OPERATORS[name](docs).collect()
    assert Counter(r[0] for r in rows) == Counter(range(len(texts)))
    assert len({r[1] for r in rows if r[0] < 5000}) == 1


def test_hot_groups_are_split_over_shards_and_packed_and_deduplicated(hot):
    texts, docs = hot
    rows = label_propagation.shard_documents(docs).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    pieces = config_packing.pack_documents(docs, BYTE).collect()
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 1024 for p in places.values())
    kept = {r["doc_id"] for r in shingle_groups.keep_one(docs).collect()}
    assert kept == {0, *[i for i, t in enumerate(texts) if i >= 5040 and t], len(texts) - 2}


def test_near_copies_share_a_link_key(spark):
    """A text takes part in links by a few keys only: a sketch. Of its pairs with a five-word likeness of 0.8 or more nearly all share one."""
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        w = words(rng, rng.randint(30, 300)).split()
        for _ in range(4):
            x = list(w)
            for _ in range(rng.randint(0, len(w) // 50)):
                x[rng.randrange(len(x))] = f"edit{rng.randint(0, 9999)}"
            texts.append(" ".join(x))
    keys = {r["doc_id"]: set(r["k"] or ()) for r in frame(spark, texts).select("doc_id", label_propagation.link_keys(F.col("text")).alias("k")).collect()}
    runs = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i // 4 * 4, i) if texts[i] != texts[j] and len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j])]
    assert len(near) > 150 and sum(bool(keys[i] & keys[j]) for i, j in near) >= 0.98 * len(near)
