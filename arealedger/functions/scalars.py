"""Scalar expressions on prices, shares, flags and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sample flags in display order.
FEW_SALES, ONE_COMPLEX, HIGH_ERROR = "FEW_SALES", "ONE_COMPLEX_DOMINATES", "HIGH_INDEX_ERROR"
BAND_EDGES = (0.016, 0.032)


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def log_to_pct(c: Column) -> Column:
    return half_up((F.exp(c) - 1) * 100, 1)


def log_se_to_pct(center: Column, se: Column) -> Column:
    return half_up(F.exp(center) * (F.exp(se) - F.exp(-se)) / 2 * 100, 1)


def pct_interval(y: Column, q: Column) -> Column:
    return F.struct(*[((F.exp(x) - 1) * 100).alias(n) for x, n in ((y, "est"), (y - q, "lower"), (y + q, "upper"))])


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero or null b."""
    return F.try_divide(a, b)


def log1p_change(a: Column, b: Column) -> Column:
    return F.log1p(a) - F.log1p(b)


def index_se(n: Column, sigma, tau, lam: float) -> Column:
    """Standard error of a deviation shrunk by n / (n + lam)."""
    return F.sqrt(F.pow(F.lit(sigma), 2) * n + F.pow(F.lit(tau), 2) * lam * lam) / (n + lam)


def shrink(d: Column, n: Column, lam: float) -> Column:
    return d * n / (n + lam)


def unshrink(d: Column, n: Column, lam: float) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.try_divide(d * (n + lam), n))


def se_band(se: Column) -> Column:
    return F.when(se < BAND_EDGES[0], "LOW").when(se < BAND_EDGES[1], "MID").when(se.isNotNull(), "HIGH")


def sample_flags(n: Column, share: Column, se: Column | None = None) -> Column:
    """Flags in a fixed order: under 20 sales, a complex with over half of them, an error from the upper band on."""
    found = [F.when(n < 20, FEW_SALES), F.when(share > 0.5, ONE_COMPLEX)]
    if se is not None:
        found.append(F.when(se >= BAND_EDGES[1], HIGH_ERROR))
    return F.array_compact(F.array(*found))


def parse_flags(c: Column) -> Column:
    known = F.array(F.lit(FEW_SALES), F.lit(ONE_COMPLEX), F.lit(HIGH_ERROR))
    return F.array_intersect(F.transform(F.split(c, ";"), lambda x: F.trim(x)), known)


def enum_or_null(c: Column, allowed: list[str]) -> Column:
    return F.when(c.isin(allowed), c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number_or_null(c: Column) -> Column:
    x = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    return F.when(~F.isnan(x), x)


def strict_bool(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin("true", "1"), True).when(x.isin("false", "0"), False)


def normalize_address(c: Column, city: str) -> Column:
    """Without the city's name, with single spaces, and a mountain lot's marker joined to its number."""
    x = F.regexp_replace(F.trim(c), f"^{city}\\s*", "")
    return F.regexp_replace(F.regexp_replace(x, "\\s+", " "), "산 (?=[0-9])", "산")


def strip_zeros(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(c), "^0+", ""), F.lit(""))


def lot_address(city: str, gu: Column, umd: Column, main: Column, sub: Column) -> Column:
    """City, gu, neighbourhood and lot; null if a part but the sub-lot is blank."""
    lot = F.concat_ws("-", strip_zeros(main), strip_zeros(sub))
    return F.when(strip_zeros(main).isNotNull(), F.concat(F.lit(f"{city} "), blank_to_null(gu), F.lit(" "), blank_to_null(umd), F.lit(" "), lot))


def road_address(city: str, gu: Column, road: Column, main: Column, sub: Column) -> Column:
    """City, gu, road (without a building number at its end) and building; null if a part but the second number is blank."""
    name = blank_to_null(F.regexp_replace(F.trim(road), r"\s+[0-9]+(-[0-9]+)?$", ""))
    number = F.concat_ws("-", strip_zeros(main), strip_zeros(sub))
    return F.when(strip_zeros(main).isNotNull(), F.concat(F.lit(f"{city} "), blank_to_null(gu), F.lit(" "), name, F.lit(" "), number))


def parse_spaced_date(c: Column) -> Column:
    """Dates like `2026. 8. 16.`"""
    part = [F.regexp_extract(c, r"^\s*(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?\s*$", k) for k in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), "yyyy-MM-dd")


def with_particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """word and the particle that fits its last syllable (a final consonant, by the syllable's code point)."""
    code = F.call_function("ascii", F.substring(word, -1, 1))
    closed = code.between(44032, 55203) & (F.pmod(code - 44032, F.lit(28)) != 0)
    return F.concat(word, F.when(closed, after_consonant).otherwise(after_vowel))


def format_share(c: Column) -> Column:
    return F.concat(half_up(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def format_pct(c: Column) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), F.format_number(c, 1), F.lit("%"))


def crc_fold(c: Column, k: int = 2) -> Column:
    return (F.crc32(c.cast("string")) % k).cast("int")


def km_distance(lat: Column, lng: Column, point: tuple[float, float]) -> Column:
    return F.sqrt(F.pow((lat - point[0]) * 111.0, 2) + F.pow((lng - point[1]) * 88.0, 2))


def format_price(c: Column) -> Column:
    """Units of ten thousand as `N억 M`, either part left out where it is nothing."""
    n = half_up(c).cast("long")
    big, rest = F.floor(n / 10000), F.pmod(n, F.lit(10000))
    return F.when(n == 0, "0").otherwise(F.concat_ws(" ", F.when(big > 0, F.concat(big.cast("string"), F.lit("억"))), F.when(rest > 0, F.format_number(rest, 0))))


def zone_neighbourhood(address: Column, gu: Column) -> Column:
    """The neighbourhood that a zone's lot stands in: without the gu's name and lot numbers; null for a list of lots, or without a lot.

    A digit that belongs to the name (before its last letter) stays.
    """
    bare = F.trim(F.regexp_replace(F.trim(address), F.concat(F.lit("^"), gu, F.lit(r"\s*")), F.lit("")))
    name = F.regexp_extract(bare, r"^(.*?[가-힣])\s*(?:산\s*)?\d+(?:-\d+)?(?:\s*(?:번지|일대|일원|외|~).*)?$", 1)
    return F.when(~bare.rlike(r"[,·]") & (name != ""), F.trim(name))


def round_coords(polygons: Column, digits: int = 6) -> Column:
    """Every coordinate of a multipolygon rounded."""
    return F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.transform(p, lambda x: F.round(x, digits)))))


def encode_peers(peers: Column) -> Column:
    """An array of (dong, reason) structs as JSON; null for none."""
    return F.when(F.size(peers) > 0, F.to_json(peers))


def peers_valid(c: Column) -> Column:
    """Whether a text is a non-empty JSON list of objects with a dong and a reason, and nothing else."""
    items = F.from_json(c, "array<map<string, string>>")
    keys = lambda m: F.array_sort(F.map_keys(m))
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda m: (keys(m) == F.array(F.lit("dong"), F.lit("reason"))) & m["dong"].isNotNull() & m["reason"].isNotNull()), F.lit(False))
