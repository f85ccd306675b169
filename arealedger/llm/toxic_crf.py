"""Toxic spans by a linear-chain conditional random field; forward-backward marginals give document scores.

Labels are of documents, so token labels are derived first: a term (a word or its first letters) that stands far more
often in toxic than in clean labelled documents marks tokens of toxic documents. The same terms are features of the
emissions; what the chain adds is the neighbours' say, and the document weights are fitted on its marginals. Counts cover a bounded sample of
the labelled training rows (about TRAIN_ROWS of each label, all where there are fewer); the field is fitted on
TRAIN_DOCS of them of each label and tags every whole text.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, fresh, materialize
from .tokens import let_go, sole, text_slices, trimmed

#: Labelled documents of each label, about, whose terms are counted.
TRAIN_ROWS = 20_000
#: Documents of each label in the fitting sample, read whole.
TRAIN_DOCS = 400
#: Terms of the token-label lexicon at most.
LEXICON = 4000
PREFIXES = (4, 5, 6)
WORD = re.compile(r"\w+")
CHUNK = 128
EPOCHS = 60
#: Words whose emission a worker keeps.
KEPT_WORDS = 250_000
#: Bytes of text that are tagged at once.
SLICE = 1_000_000


def terms(word: str) -> list[str]:
    """What of a word the field sees: itself, its first and its last letters."""
    return ["w:" + word, *(f"p:{word[:k]}" for k in PREFIXES if len(word) >= k), "s:" + word[-4:]]


def recursion(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, run_back: bool) -> np.ndarray:
    """Odds of state 1 given what is before (or after) each place of sequences packed place by place.

    sizes[t] sequences have a place t; they are the first ones of place t - 1, so a place is one slice of emit (odds).
    Forward odds hold the place's own emission, backward odds don't.
    """
    (a, c), (b, d) = trans  # from 0: to 0, to 1; from 1: to 0, to 1
    ends = np.cumsum(sizes)
    out = np.ones(len(emit))
    if not run_back:
        for t, n in enumerate(sizes):
            lo = ends[t] - n
            if t == 0:
                out[:n] = emit[:n]
            else:
                r = out[ends[t - 1] - sizes[t - 1] : ends[t - 1] - sizes[t - 1] + n]
                out[lo : lo + n] = emit[lo : lo + n] * (c + d * r) / (a + b * r)
        return out
    for t in range(len(sizes) - 2, -1, -1):
        n, lo, nxt = sizes[t + 1], ends[t] - sizes[t], ends[t]
        q = emit[nxt : nxt + n] * out[nxt : nxt + n]
        out[lo : lo + n] = (b + d * q) / (a + c * q)
    return out


def packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sizes): place-by-place order of sequences laid end to end, and how many have each place."""
    by_length = np.argsort(-lengths, kind="stable")
    if not len(lengths) or lengths.max() == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.bincount(lengths)[::-1].cumsum()[::-1][1:]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[by_length]
    order = np.concatenate([starts[:n] + t for t, n in enumerate(sizes)])
    return order, sizes


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state 1) at each place of sequences laid end to end (emit: log-odds)."""
    order, sizes = packed(lengths)
    odds = np.exp(np.clip(emit[order], -30, 30))
    x = recursion(odds, sizes, trans, False) * recursion(odds, sizes, trans, True)
    out = np.empty(len(emit))
    out[order] = x / (1 + x)
    return out


@dataclass
class Field:
    """weights: of terms; trans: 2x2 potentials; document: weights of (1, log of expected tokens, largest marginal)."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    document: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # of this fit's emissions in a worker

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(t, 0.0) for t in terms(word.lower()))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        kept = _emissions(self.key)
        words = [WORD.findall(t) for t in texts]
        for x in words:
            for w in set(x).difference(kept):
                kept[w] = self.emission(w)
        lengths = np.array([len(x) for x in words], np.int64)
        emit = np.fromiter((kept[w] for x in words for w in x), float, int(lengths.sum()))
        if len(kept) > KEPT_WORDS:
            kept.clear()
        return np.split(marginals(emit, lengths, self.trans), np.cumsum(lengths)[:-1]) if len(texts) else []

    @staticmethod
    def features(found: list[np.ndarray]) -> np.ndarray:
        return np.array([[1.0, np.log1p(m.sum()), m.max() if len(m) else 0.0] for m in found]).reshape(-1, 3)

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(found) @ self.document, -30, 30)))


def _emissions(key: str) -> dict[str, float]:
    """Word emissions of one fit."""
    return sole(("emissions", key), dict)


def lexicon(labelled: DataFrame, limit: int = LEXICON) -> set[str]:
    """Words and first letters that mark toxic documents, from counts over all rows of labelled (text, toxic).

    At least 5 toxic documents and one in a hundred of them, odds 8 times those in clean ones, 3 standard errors above even; the `limit` strongest.
    """
    words = labelled.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("w")).where("w <> ''")
    stems = F.array(F.concat(F.lit("w:"), "w"), *[F.when(F.length("w") >= k, F.concat(F.lit("p:"), F.substring("w", 1, k))) for k in PREFIXES])
    seen = words.select("toxic", F.explode(F.array_compact(stems)).alias("term"))
    counts = seen.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad >= 5")
    totals = labelled.agg(F.sum("toxic").alias("n_bad"), F.sum(1 - F.col("toxic")).alias("n_good")).first()
    if not totals["n_bad"] or not totals["n_good"]:
        return set()
    ratio = F.log((F.col("bad") + 0.5) / (totals["n_bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (totals["n_good"] + 1.0))
    z = ratio / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    found = counts.where((F.col("bad") >= 0.01 * totals["n_bad"]) & (ratio >= float(np.log(8))) & (z >= 3)).orderBy(z.desc(), "term").limit(limit)
    return {r["term"] for r in found.select("term").collect()}


def fit_field(texts: list[str], toxic: list[int], marks: set[str], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood by Adam over chunks of the sample, then a logistic document score over the marginals."""
    words = [[w.lower() for w in WORD.findall(t)] for t in texts]
    flat = [w for x in words for w in x]
    names: dict[str, int] = {}
    known = np.array([names.setdefault(w, len(names)) for w in flat], np.int64)
    seed_word = np.array([any(t in marks for t in terms(w)) for w in names], bool)
    of_doc = np.repeat(np.array(toxic, bool), [len(x) for x in words])
    y = (seed_word[known] & of_doc).astype(float) if len(flat) else np.zeros(0)
    index: dict[str, int] = {}
    rows = [[index.setdefault(t, len(index) + 1) for t in terms(w)] for w in names]
    width = max(map(len, rows), default=1)
    feats = np.array([r + [0] * (width - len(r)) for r in rows], np.int64).reshape(-1, width)
    lengths = np.array([min(CHUNK, len(x) - i) for x in words for i in range(0, len(x), CHUNK)], np.int64)
    order, sizes = packed(lengths)
    known, y = known[order], y[order]
    n, ends = max(len(y), 1), np.cumsum(sizes)
    after = np.concatenate([np.arange(ends[t], ends[t] + sizes[t + 1]) for t in range(len(sizes) - 1)]) if len(sizes) > 1 else np.zeros(0, np.int64)
    before = np.concatenate([np.arange(ends[t] - sizes[t], ends[t] - sizes[t] + sizes[t + 1]) for t in range(len(sizes) - 1)]) if len(sizes) > 1 else np.zeros(0, np.int64)
    pairs = np.array([[((1 - y[before]) * (1 - y[after])).sum(), ((1 - y[before]) * y[after]).sum()], [(y[before] * (1 - y[after])).sum(), (y[before] * y[after]).sum()]])
    w, log_t = np.zeros(len(index) + 1), np.zeros((2, 2))
    bias, state = np.log((y.sum() + 1) / (n - y.sum() + 1)), [np.zeros(len(w) + 5), np.zeros(len(w) + 5)]
    for step in range(1, epochs + 1):
        odds = np.exp(np.clip(bias + w[feats].sum(axis=1)[known], -30, 30)) if len(flat) else np.zeros(0)
        trans = np.exp(log_t)
        r, q = recursion(odds, sizes, trans, False), recursion(odds, sizes, trans, True)
        p = r * q / (1 + r * q)
        g_word = np.bincount(known, weights=p - y, minlength=len(names)) if len(flat) else np.zeros(0)
        g = np.bincount(feats.ravel(), weights=np.repeat(g_word, width), minlength=len(w)) + 0.02 * w
        g[0] = 0.0
        rb, qa = r[before], odds[after] * q[after]
        cells = [np.full(len(rb), trans[0, 0]), trans[0, 1] * qa, trans[1, 0] * rb, trans[1, 1] * rb * qa]
        whole = sum(cells)
        expect = np.array([(c / whole).sum() for c in cells]).reshape(2, 2)
        g = np.concatenate([g, ((expect - pairs) + 0.02 * log_t).ravel(), [(p - y).sum()]])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.3 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
        w -= move[: len(w)]
        log_t -= move[len(w) : len(w) + 4].reshape(2, 2)
        bias -= move[-1]
    fit = Field({t: float(w[i]) for t, i in index.items() if abs(w[i]) > 0.05}, float(bias), np.exp(log_t), np.zeros(3))
    x, t = Field.features(fit.tag(texts)), np.array(toxic, float)
    v = np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (p - t) + 0.01 * v
        v -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3), grad)
    fit.document = v
    return fit


def one_of_copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, toxic) with one document of each group of near copies: else a much copied text's own words
    would look like signs of its label.

    In each of four passes documents of one label that share the least hash of their 3-word runs, under that pass's
    seed, leave the one with the smallest doc_id. Only ids and hashes are regrouped, then joined back.
    """
    words = F.split("text", r"\s+")
    runs = lambda s: F.array_min(F.transform(F.col("_runs"), lambda h: F.xxhash64(h, F.lit(s))))
    hashed = rows.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    pairs = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, 1 << 30).alias("b"), F.slice("_words", 3, 1 << 30).alias("c"))
    hashed = hashed.select("doc_id", "toxic", F.transform(pairs, lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("_runs"))
    left = materialize(hashed.select("doc_id", "toxic", *[runs(s).alias(f"s{s}") for s in range(4)]), "toxic-copies")
    for s in range(4):
        left = left.groupBy("toxic", f"s{s}").agg(F.min(F.struct("doc_id", *[f"s{k}" for k in range(4)])).alias("r")).select("toxic", "r.*")
    return rows.join(left.select("doc_id").distinct(), "doc_id", "left_semi")


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of about train_rows documents of each label, or all of them, drawn by a hash of the id.

    Who is drawn is settled on ids and labels alone, so that texts are never regrouped: the drawn ids, twice train_rows
    of them about, are broadcast to one scan of the texts.
    """
    of = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    of = of.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = materialize(of.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-known")
    share = known.groupBy("toxic").agg((F.lit(float(train_rows)) / F.count("*")).alias("share"))
    place = F.shiftright(F.xxhash64("doc_id"), 11).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = materialize(known.join(F.broadcast(share), "toxic").where(place < F.col("share")).select("doc_id", "toxic"), "toxic-drawn")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(texts.join(F.broadcast(drawn), "doc_id"), "toxic-labelled")
    drop_tables(known, drawn)
    return found


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_rows: int = TRAIN_ROWS) -> Field:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 isn't 0. Rows without label or id teach nothing.

    A doc_id labelled twice counts as toxic if one label says so. Without both labels every score is that of no sign.
    """
    drawn = training_rows(docs, labels, train_rows)
    rows = materialize(one_of_copies(drawn), "toxic-train")
    drop_tables(drawn)
    marks = lexicon(rows)
    sample = []
    for label in (0, 1):
        some = rows.where(F.col("toxic") == label)
        first = some.select("doc_id", F.xxhash64("doc_id", "text").alias("_h")).orderBy("_h").limit(train_docs).select("doc_id").distinct()
        found = some.join(F.broadcast(first), "doc_id", "left_semi").select("doc_id", "text", "toxic").collect()
        sample += sorted(found, key=lambda r: (r["doc_id"], r["text"]))
    drop_tables(rows)
    fit = fit_field([r["text"] for r in sample], [r["toxic"] for r in sample], marks)
    del sample, found
    let_go()  # the driver's Python is idle through the later stages
    return fit


def with_scores(df: DataFrame, fit: Field, text: str, score: str, spans: str) -> DataFrame:
    """df with the score and the offending spans (start:end in code points, comma-joined) of each whole text."""
    held = df.sparkSession.sparkContext.broadcast(fit)
    schema = df.select("*", F.lit(0.0).alias(score), F.lit("").alias(spans)).schema

    def run(batches):
        f = held.value
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            for lo, hi in text_slices(col, SLICE):
                part = [t or "" for t in col.slice(lo, hi - lo).to_pylist()]
                m, found = f.tag(part), []
                for t, x in zip(part, m, strict=True):
                    bad = x >= 0.5
                    found.append(",".join(f"{w.start()}:{w.end()}" for w, k in zip(WORD.finditer(t), bad.tolist(), strict=True) if k) if bad.any() else "")
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(f.scores(m), pa.float64()), pa.array(found, pa.string())], names=[*b.schema.names, score, spans])

    return df.mapInArrow(trimmed(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document row.

    A null doc_id is not held out, a null text counts as empty (the score of no sign). Repeated doc_ids keep a row each; other
    columns are not looked at; an empty table gives an empty one.
    """
    out = with_scores(docs.select("doc_id", "text"), train(docs, labels), "text", "score", "spans")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the field rejects; the columns stay as they are, whatever their names.

    Null and empty texts stay unless texts without a sign are rejected. Equal rows share their fate.
    """
    score, spans = fresh(docs, "_toxic_score"), fresh(docs, "_toxic_spans")
    return with_scores(docs, train(docs, labels), "text", score, spans).where(F.col(score) < 0.5).select(*docs.columns)
