"""Secret scans: fixed patterns, and a randomness test battery over encoded-looking runs. SQL functions only.

The battery's hypothesis is that a run is random. False-discovery control bounds the share of random runs among those that
it calls text; it bounds no share of text among those called secret, which tests measure on planted runs instead.

Work on a text is in proportion to its length and its matches: places are running sums and maxima, folded by blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, materialize

# The base patterns, with the capture group and length that a match needs to count.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Runs that the battery tests, whole and by their parts between signs.
RUN, SIGNS = r"[A-Za-z0-9+/_-]{20,}", r"[+/_-]"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: (name, letters in order, the least length at which ordinary words would be told from random ones), narrowest first.
#: Runs of lower-case hex digits are base spans already.
ALPHABETS = (
    ("hex", _DIGITS + "ABCDEF", 20),
    ("base32", _UPPER + "234567", 24),
    ("base32 lower", _LOWER + "234567", 24),
    ("base36 lower", _DIGITS + _LOWER, 24),
    ("base36 upper", _DIGITS + _UPPER, 24),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 24),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", 24),
)
#: Values folded at once; totals of such blocks are folded again.
BLOCK = 256
#: Code points in a chunk of a text that is cut anew.
CHUNK = 512
#: Upper ends of the length classes; longer runs are the last class.
CLASSES = (31, 47, 79)
#: Share of random runs, within a length class, that the battery may take for ordinary text.
FALSE_REJECTIONS = 0.05
#: P-values are counted in steps of a twentieth of a power of ten, so the counts have at most STEPS rows a class.
STEPS = 400


def running(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs, start and all earlier values put together by op (a sum or a maximum).

    Folded in blocks, then over block totals: no array grows by more than a block's values one at a time.
    """
    def fold(x: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, zero, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def two_levels(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(F.transform(bs, lambda x: F.aggregate(x, start, op)), start), fold)))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(bound(values, lambda v: F.when(F.size(v) <= BLOCK, fold(v, start)).otherwise(two_levels(v))))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def zero() -> Column:
    return F.lit(0).cast("long")


def found(text: Column, pattern: str) -> Column:
    """Array of (start, match) of leftmost non-overlapping matches; start in code points from 0.

    Text between matches comes from split; running sums of the lengths of both give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), hits, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("m")))
    step = F.filter(both, lambda x: x["m"].isNotNull())
    empty = F.array().cast("array<struct<start: bigint, m: string>>")

    def placed(xs: Column) -> Column:
        before = running(F.transform(xs, lambda x: x["gap"] + F.length(x["m"])), zero(), _sum)
        return F.zip_with(xs, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["m"].alias("m")))

    return F.when(text.rlike(pattern), bound(step, placed)).otherwise(empty)


def spans(hits: Column, kind: int) -> Column:
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end")))


def encoding(m: Column) -> Column:
    """1-based place in ALPHABETS of the narrowest alphabet that m fits and whose variety it shows, else null.

    Letters alone, or digits alone, are words or numbers.
    """
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    both = m.rlike("[a-z]") & m.rlike("[A-Z]")
    fits = F.when(m.rlike("^[0-9A-F]+$"), 1).when(m.rlike("^[A-Z2-7]+$"), 2).when(m.rlike("^[a-z2-7]+$"), 3).when(m.rlike("^[a-z0-9]+$"), 4).when(m.rlike("^[A-Z0-9]+$"), 5)
    return F.when(mixed, fits.when(both & m.rlike("^[A-Za-z0-9+/]+$"), 6).when(both & m.rlike("^[A-Za-z0-9_-]+$"), 7))


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by a logistic-type approximation good to about 2e-4; two-sided tests double it."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def battery(m: Column, enc: Column) -> Column:
    """P-value of a run being uniformly random: the least of three tests times three.

    Chi-squared of letter counts (Wilson-Hilferty), runs above and below the alphabet's middle, and serial
    correlation of neighbouring letters.
    """
    letters = F.element_at(F.array(*[F.lit(a) for _, a, _ in ALPHABETS]), enc)
    k, n = F.length(letters).cast("double"), F.length(m).cast("double")
    counts = F.transform(F.split(letters, ""), lambda c: (F.length(m) - F.length(F.replace(m, c, F.lit("")))).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + (c - n / k) * (c - n / k)) / (n / k)
    df = k - 1
    p_chi = upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    ranks = F.transform(F.split(m, ""), lambda c: F.call_function("instr", letters, c).cast("double"))
    pairs = F.zip_with(F.slice(ranks, F.lit(1), F.length(m) - 1), F.slice(ranks, F.lit(2), F.length(m) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    half = k / 2
    switches = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.when((x["a"] > half) != (x["b"] > half), 1.0).otherwise(0.0))
    p_runs = 2 * upper_tail(F.abs(switches - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
    mid, var = (k + 1) / 2, (k * k - 1) / 12
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"] - mid) * (x["b"] - mid)) / var / F.sqrt(n - 1)
    p_serial = 2 * upper_tail(F.abs(serial))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def length_class(n: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i, top in reversed(list(enumerate(CLASSES))):
        out = F.when(n <= top, i).otherwise(out)
    return out


def with_parts(runs: Column) -> Column:
    """Runs, and the parts of those that hold signs: a token in a path or behind a prefix stands by itself."""
    def parts(r: Column) -> Column:
        words = F.split(r["m"], SIGNS, -1)
        own = bound(words, lambda ws: F.zip_with(ws, running(F.transform(ws, lambda w: F.length(w).cast("long") + 1), r["start"], _sum), lambda w, at: F.struct(at.alias("start"), w.alias("m"))))
        return F.when(r["m"].rlike(SIGNS), F.concat(F.array(r), F.filter(own, lambda x: F.length(x["m"]) >= 20))).otherwise(F.array(r))

    return F.flatten(F.transform(runs, parts))


def free_of(cands: Column, base: Column) -> Column:
    """cands (start, end, ...) that no base span (start, kind, end) overlaps: one order by place for both, the farthest
    base end before each candidate and the nearest base start after it."""
    none = F.lit(None).cast("struct<start: bigint, end: bigint, m: string, enc: int>")
    events = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("side"), b["end"].alias("end"), none.alias("c"))), F.transform(cands, lambda c: F.struct(c["start"].alias("at"), F.lit(1).alias("side"), c["end"].alias("end"), c.alias("c")))))

    def clear(es: Column) -> Column:
        ends = running(F.transform(es, lambda e: F.when(e["side"] == 0, e["end"]).otherwise(zero())), zero(), _larger)
        starts = F.reverse(running(F.reverse(F.transform(es, lambda e: F.when(e["side"] == 0, -e["at"]).otherwise(F.lit(-(1 << 62))))), F.lit(-(1 << 62)), _larger))
        marked = F.zip_with(F.arrays_zip(es.alias("e"), ends.alias("before")), starts, lambda x, after: F.struct(x["e"]["c"].alias("c"), ((x["e"]["side"] == 1) & (x["before"] <= x["e"]["at"]) & (-after >= x["e"]["end"])).alias("ok")))
        return F.transform(F.filter(marked, lambda x: x["ok"]), lambda x: x["c"])

    return F.when((F.size(base) == 0) | (F.size(cands) == 0), cands).otherwise(bound(events, clear))


def candidates(runs: Column, base: Column) -> Column:
    """Runs and parts that no base span overlaps, that fit an encoding and are long enough for it: (start, end, class, p)."""
    least = F.array(*[F.lit(x) for _, _, x in ALPHABETS])
    shaped = F.transform(with_parts(runs), lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(r["m"])).alias("end"), r["m"].alias("m"), encoding(r["m"]).alias("enc")))
    kept = F.filter(shaped, lambda r: r["enc"].isNotNull() & (r["end"] - r["start"] >= F.element_at(least, r["enc"])))
    return F.transform(free_of(kept, base), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), length_class(r["end"] - r["start"]).alias("class"), battery(r["m"], r["enc"]).alias("p")))


def step_of(p: Column) -> Column:
    return F.least(F.lit(STEPS), F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-30)))).cast("int"))


def rejection_steps(scanned: DataFrame, rate: float) -> dict[int, int]:
    """Benjamini-Hochberg in each length class over all candidates: the least p-value step that is rejected.

    Counts by class and step, at most 4 x (STEPS + 1) rows, come to the driver.
    """
    rows = scanned.select(F.explode("_cand").alias("c")).groupBy(F.col("c.class").alias("class"), step_of(F.col("c.p")).alias("step")).agg(F.count("*").alias("n")).collect()
    out = {}
    for cls in {r["class"] for r in rows}:
        counts = {r["step"]: r["n"] for r in rows if r["class"] == cls}
        total, below = sum(counts.values()), 0
        for step in sorted(counts, reverse=True):
            below += counts[step]
            if 10 ** (-step / 20) <= rate * below / total:  # the step's largest p-value
                out[cls] = step
    return out


def joined(all_spans: Column) -> Column:
    """kind:start:end by start, then kind in the order listed, comma-joined."""
    names = F.array(F.lit("assign"), F.lit("access"), F.lit("hex"), F.lit("random"))
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rate: float = FALSE_REJECTIONS) -> DataFrame:
    """keep, and _base and _random: arrays of (start, kind, end) for each whole text (null: empty).

    Kinds: 1 assign, 2 access, 3 hex, 4 random. The scan is written once, so the corpus-wide counts behind the
    false-discovery control and the result read the same narrow table. A part of a random run is no span of its own.
    """
    t = F.coalesce(text, F.lit(""))
    assign = F.filter(found(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)
    access = F.filter(found(t, ACCESS), lambda x: F.length(x["m"]) >= 18)
    base = F.concat(spans(assign, 1), spans(access, 2), spans(found(t, HEX), 3))
    wide = df.select(*keep, base.alias("_base"), found(t, RUN).alias("_runs")).select(*keep, "_base", F.when(F.size("_runs") > 0, candidates(F.col("_runs"), F.col("_base"))).alias("_cand"))
    scanned = materialize(wide.withColumn("_cand", F.coalesce("_cand", F.array().cast(wide.schema["_cand"].dataType))), "secret-scan")
    limits = rejection_steps(scanned, rate)

    def whole(cs: Column) -> Column:  # candidates come by start, a run before its parts
        ends = running(F.transform(cs, lambda c: c["end"]), zero(), _larger)
        outer = F.filter(F.zip_with(cs, ends, lambda c, before: F.struct(c["start"].alias("start"), F.lit(4).alias("kind"), c["end"].alias("end"), before.alias("before"))), lambda x: x["start"] >= x["before"])
        return F.transform(outer, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    ordered = F.array_sort(F.transform(F.filter("_cand", lambda c: ~_rejected(c, limits)), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["end"].alias("end"))))
    return scanned.select(*keep, "_base", bound(ordered, whole).alias("_random"))


def _rejected(c: Column, limits: dict[int, int]) -> Column:
    out = F.lit(False)
    for cls, step in limits.items():
        out = out | ((c["class"] == cls) & (step_of(c["p"]) >= step))
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document row.

    A null text counts as empty: no span, and the digest of the empty string. Null and repeated doc_ids keep a row each.
    Other columns are not looked at; an empty table gives an empty one. Spans that start together go by kind.
    """
    n = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    every = scan(docs)
    return every.select("doc_id", n(1).alias("n_assign"), n(2).alias("n_access"), n(3).alias("n_hex"), F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.concat("_base", "_random")).alias("spans"))


def without(text: Column, cuts: Column, mark: str) -> Column:
    """text with each of cuts (start, end; sorted by start) replaced by mark; one that begins inside an earlier one adds none.

    Kept pieces are cut from chunks of the text, so that none is looked for from the text's beginning.
    """
    def kept(cs: Column, chunks: Column) -> Column:
        farthest = running(F.concat(F.transform(cs, lambda c: c["end"]), F.array(zero())), zero(), _larger)

        def piece(a: Column, z: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, F.floor((z - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(z > a, F.substring(near, (a - first * CHUNK + 1).cast("int"), (z - a).cast("int"))).otherwise("")

        def each(c: Column, at: Column) -> Column:
            tail = piece(at, F.length(text).cast("long"))
            return F.when(c.isNull(), tail).when(c["start"] >= at, F.concat(piece(at, c["start"]), F.lit(mark))).otherwise("")

        return F.array_join(F.zip_with(cs, farthest, each), "")

    return bound(cuts, lambda cs: bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: kept(cs, chunks)))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret span of text replaced by `mark`, and n_chars, if there is one, counted anew.

    No row goes; texts without a secret, and null ones, stay as they are. Null and repeated doc_ids are rows like others,
    and columns of any name pass through. An empty table stays empty.
    """
    own = docs.columns  # under other names below, so that none clashes
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(own)], F.col("text").alias("_text"))
    got = scan(inner, "_text", tuple(inner.columns))
    cuts = F.array_sort(F.transform(F.concat("_base", "_random"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    text = F.when((F.size("_base") + F.size("_random")) > 0, without(F.col("_text"), cuts, mark)).otherwise(F.col("_text"))
    out = got.withColumn("_done", text)
    cols = [F.col("_done").alias(c) if c == "text" else (F.when(F.col(f"k{i}").isNotNull(), F.length("_done")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"k{i}").alias(c)) for i, c in enumerate(own)]
    return out.select(*cols)
