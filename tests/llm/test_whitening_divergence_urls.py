"""Whitening, divergence and url rules on small tables of hard cases, against brute force in plain Python."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealedger.llm import divergence_audit, embedding_whitening, queries, url_digests

VECTORS = "vec_id bigint, embedding array<float>, label int, x string, key string, w int"


def vectors(n=300, width=6, hot=150, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(width, width))
    base = (rng.normal(size=(n, width)) @ mix).astype("float32")
    rows = [(i, base[i].tolist()) for i in range(n)] + [(n + i, base[0].tolist()) for i in range(hot)] + [(2 * n + i, base[i % 5].tolist()) for i in range(40)]
    odd = [(-1, None), (-2, [1.0] * (width - 1) + [None]), (-3, [float("nan")] * width), (-4, [float("inf")] * width), (-5, [1.0] * (width + 2)), (-6, [])]
    return [*rows, rows[3], (None, base[7].tolist())], odd


def framed(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", 7) for i, v in rows], VECTORS).repartition(5)


def whitened_by_hand(rows, weights="counts"):
    x = {}
    for _, v in rows:
        x.setdefault(tuple(int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v), []).append(1)
    every = np.array([k for k, m in x.items() for _ in (m if weights == "counts" else [1])], dtype=object)
    n, sums = len(every), every.sum(axis=0)
    y = ((every * n - sums) / n).astype(float)
    values, vecs = np.linalg.eigh(y.T @ y / n)
    return n, sums, values[::-1], vecs[:, ::-1], float(np.trace(y.T @ y / n))


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_equals_brute_force(spark, weights):
    rows, odd = vectors()
    got = embedding_whitening.whiten(framed(spark, rows + odd), weights=weights).collect()
    n, sums, values, vecs, trace = whitened_by_hand(rows, weights)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c) for i, _ in rows for c in range(1, 7))
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    of = {i: v for i, v in rows}
    x = {i: np.array([int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v], dtype=object) for i, v in of.items()}
    signs = {}
    for r in got:
        c, d = r["component"] - 1, x[r["vec_id"]] * n - sums
        assert int(r["deviation"]) == int((d * d).sum())
        assert abs(r["explained"] - values[c] / trace) < 1e-9
        want = float((d / n).astype(float) @ vecs[:, c] / np.sqrt(values[c]))
        if abs(want) > 1e-6:
            assert signs.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(want) - abs(r["whitened"])) < 1e-8


def test_whitening_measures_its_error_and_handles_flat_and_huge_entries(spark):
    flat = embedding_whitening.whiten(framed(spark, [(i, [float(i % 2), 3.0]) for i in range(6)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and {r["explained"] for r in flat if r["component"] == 2} == {0.0}
    one = embedding_whitening.whiten(framed(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one] == [(None, 0.0, None, 0)] * 2
    huge = embedding_whitening.whitened_rows(framed(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] != 3)


def test_whitening_of_nothing(spark):
    assert embedding_whitening.whitened_rows(framed(spark, [])).collect() == []
    assert embedding_whitening.whitened_rows(framed(spark, [(1, None), (2, [])])).collect() == []


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, n int, block int, value int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def corpus(seed=4, n=260, sources=11):
    rng = random.Random(seed)
    words = ["The", "of", "Straße", "été", "x", "naïve", "don't", "日本語", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), "hot" if i % 3 else f"s{rng.randrange(sources)}"
        rows.append((i, " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 40))), lang, source))
    rows += [(900, None, "en", None), (901, "", "zz", "only"), (902, "123 !", "zz", "other"), (903, "one two", "zz", "third"), (904, "of " * 50_000, "en", "s1"), rows[5], rows[5]]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "clash", 2, 3, 4) for i, t, lang, s in rows], DOCS).repartition(4)


def audited(rows, least=10, top=10):
    groups, n, docs = {}, Counter(), Counter()
    for _, t, lang, s in rows:
        lang, s = lang or "", s or ""
        groups[lang, s] = 1
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        n.update((lang, s, x) for x in found)
        docs.update((lang, x) for x in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [x for (k, x), d in docs.items() if k == lang and d >= least]
        mine = sorted(s for k, s in groups if k == lang)
        share = lambda c, total: 1 + (10**9 * (c + 2)) // (total + 2 * len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        p = {s: {x: share(n[lang, s, x], sum(n[lang, s, y] for y in kept)) for x in kept} for s in mine}
        q = {x: share(sum(n[lang, s, x] for s in mine), sum(n[lang, s, y] for s in mine for y in kept)) for x in kept}
        for s in mine:
            pairs = sorted(((sum(f(p[s][x], p[o][x]) for x in kept), o) for o in mine if o != s), key=lambda v: (-v[0], v[1].encode()))
            terms = sorted(((f(p[s][x], q[x]), x) for x in kept if n[lang, s, x] and p[s][x] > q[x]), key=lambda v: (-v[0], v[1].encode()))[:top]
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)] + [(lang, s, "term", x, v, i + 1) for i, (v, x) in enumerate(terms)]
    return Counter(out)


@pytest.mark.parametrize("blocks", [(8, 512), (2, 3), (1, 1), (100, 1000)])
def test_divergence_equals_brute_force(spark, blocks):
    rows = corpus()
    got = divergence_audit.audit(documents(spark, rows), groups_in_block=blocks[0], terms_in_block=blocks[1])
    assert Counter(tuple(r) for r in got.collect()) == audited(rows)


def test_divergence_of_nothing(spark):
    assert divergence_audit.audit(documents(spark, [])).collect() == []
    few = divergence_audit.audit(documents(spark, [(1, None, None, None), (2, "a b", None, "s")])).collect()
    assert sorted(tuple(r) for r in few) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_shares_stay_exact_beyond_sixty_four_bits(spark):
    n, total, kept = 9 * 10**15, 3 * 10**16 + 7, 10**9
    got = spark.range(1).select(divergence_audit.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + (10**9 * (n + 2)) // (total + 2 * kept)
    assert Fraction(got - 1, 10**9) <= Fraction(n + 2, total + 2 * kept)


PAGES = "page_id bigint, url string, html string, host int, path int, rule int, verdict int"
URLS = [
    None, "", "no scheme", "http://", "://x.net/fr/", "HTTP://WWW.Example.COM/en/1?x#y", "https://example.com/en/", "https://example.com/EN/", "https://a.example.com/en/x", "https://a.www.example.com/en/x",
    "https://notexample.com/en/", "https://example.com", "https://example.com?/en/", "ftp://b.c.net/es/x", "ftp://net/fr/", "ftp://net/f", "http://xnet/es/", "http://é.NET/es/é#", "http://x.net:80/es/", "http://x.net./es/",
    "a://b://c.net/es/", "http://com/", "http://.com/", "http://" + "a." * 50_000 + "net/es/", "http://x.com/" + "é" * 300_000, "https://x.org/en/", "https://a.b\nc.net/fr/\n?z", "http://x.net/es/", "http://x.net/es/",
]


def pages(spark, urls):
    return spark.createDataFrame([(None if i == 8 else i, u, "clash", 1, 2, 3, 4) for i, u in enumerate(urls)], PAGES).repartition(3)


def judged(url, rules, otherwise="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[3] if best else otherwise


@pytest.mark.parametrize(("shard", "bits"), [(1_000_000, 64), (2, 64), (1_000_000, 2), (3, 0)])
def test_urls_equal_brute_force(spark, shard, bits):
    rules = [*queries.RULES, ("x.com", "/é", "block"), ("c.net", "/", "allow"), ("net", "", "block"), ("c.net", "/", "block"), ("b", "/long", "allow")]
    given = spark.createDataFrame([*[(h.upper(), p, v) for h, p, v in rules], (None, "/", "block"), ("x.org", None, "block"), ("x.org", "/", None)], "host string, path string, verdict string")
    got = url_digests.judge(pages(spark, URLS), given, shard=shard, bits=bits).collect()
    want = Counter((None if i == 8 else i, *judged(u, rules)) for i, u in enumerate(URLS))
    assert Counter(tuple(r) for r in got) == want


def test_urls_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r["rule"], r["verdict"]) for r in url_digests.judge(pages(spark, URLS), none, otherwise="block").collect()} == {(None, "block")}
    some = spark.createDataFrame(list(queries.RULES), none.schema)
    assert url_digests.judge(pages(spark, []), some).collect() == []


def test_a_mapped_file_gives_back_what_was_packed(tmp_path):
    keys = [f"k{i}".encode() for i in range(100)]
    for bits in (64, 3, 0):
        arrays, order = url_digests.sorted_digests(keys, bits)
        path = tmp_path / f"{bits}.bin"
        path.write_bytes(url_digests.packed({f"a.{k}": v for k, v in arrays.items()}))
        found = url_digests.Lookup(url_digests.mapped(str(path)), "a").find([b"none", *keys])
        assert found[0] == -1 and [int(order[i]) for i in found[1:]] == list(range(100))


def test_new_queries_read_whole_tables(spark, tmp_path):
    rows, odd = vectors(40, 3, 5)
    framed(spark, rows + odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    documents(spark, corpus(n=30)).write.parquet(f"{tmp_path}/documents.parquet")
    pages(spark, URLS).write.parquet(f"{tmp_path}/pages.parquet")
    counts = defaultdict(int)
    for name, f in queries.queries().items():
        if name in ("op11_whitening", "op12_divergence", "op13_urls"):
            counts[name] = f(spark, str(tmp_path)).count()
    assert counts["op11_whitening"] == 3 * len(rows) and counts["op13_urls"] == len(URLS) and counts["op12_divergence"] > 0
