"""Secret scans: three fixed patterns, then a battery of randomness tests for long tokens.

Base spans (whole matches, leftmost and non-overlapping per kind, positions in code points, end exclusive):

* ``assign``: a password-like name, ``:`` or ``=``, and a value of 12 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters in all;
* ``hex``: 16 or more lower-case hex digits.

The method adds ``random`` spans. Candidates are runs of ``MIN_TOKEN`` or more characters of the base64 alphabets (and their
padding) between the assign spans that hold no access or hex span. The encoding of a candidate is the smallest alphabet of
``ALPHABETS`` that has all its characters. Three tests measure how far the token is from uniform draws of that alphabet, each as a
number that is standard normal for such draws:

* chi-squared uniformity of the symbol counts in ``CELLS`` (letters by frequency in prose and by case, digits, signs);
* the runs test of lower case, upper case and others (positive: fewer changes than random);
* lag-one serial correlation of vowels, and of the upper half of the alphabet; the larger counts.

Their sum beyond what chance explains (``distance``) is small for random tokens. The null hypothesis is that a token is structured, and its
distribution comes from the corpus: every document gives one stretch of its letters (in lower case, joined, its place and length class
by a hash of all of them), which is the structured kind that lies nearest to random. Median and upper spread of their distances (which random texts
in the corpus do not move) give a token's p-value: how often a structured token of its length is as near to random. In each length class
the Benjamini-Hochberg procedure at level ``FDR`` then declares tokens random, so at most about that share of the reported tokens is
structured. Distances are counted in bins, so the procedure needs tables of fixed size only.

Defined results: null and empty texts have no spans; repeated rows give repeated results; an empty table
gives an empty result; extra columns are ignored. One scan of the texts, no join, no shuffle of rows; time grows as n log n with the matches of a text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed, running_sums

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: A hex run has 16 or more digits exactly if this finds it, since both match whole runs.
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN, MIN_ASSIGN, MIN_ACCESS = 20, 12, 18
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}=*"
#: A token with an access or hex span in it; both consist of token characters, so none can overlap a token's end.
TAKEN = rf"{HEX}|AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}"
FDR = 0.05
#: Lower ends of the length classes.
LENGTHS = (20, 28, 40, 64, 128)
#: Distances are counted in bins of 1 / STEP from LOW on; p-values in bins of -10 log10 p.
STEP, LOW, HIGH, BINS = 20, -10.0, 40.0, 300
#: Stands in for a small corpus: so many stretches of prose, with median PRIOR_MEDIAN * length ** (1 / 3) and this spread.
PRIOR_ROWS, PRIOR_MEDIAN, PRIOR_SPREAD = 20, 1.4, 1.1

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, smallest alphabet first: digits, hex, letters of one case, base32, base36, base62, base64, and all.
ALPHABETS = (
    _DIGITS,
    "0123456789abcdef",
    "0123456789ABCDEF",
    _LOWER,
    _UPPER,
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _UPPER + _LOWER,
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
    _UPPER + _LOWER + _DIGITS + "+/-_",
)
#: Letters that are frequent, usual and rare in prose, in both cases; low and high digits; signs.
CELLS = ("etaoinsr", "hldcumfpgwyb", "vkxjqz", "ETAOINSR", "HLDCUMFPGWYB", "VKXJQZ", "01234", "56789", "+/-_")
VOWELS = "aeiouAEIOU"
_SPANS = "array<struct<s:int,k:int,e:int>>"
_MATCHES = "array<struct<s:int,e:int,m:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with value computed once."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): start, end and text of all matches of pattern, from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        before = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x: F.length(x))
        steps = F.zip_with(before, m, lambda p, x: p + F.length(x))
        return F.zip_with(running_sums(steps), m, lambda e, x: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("m")))

    return _let(found, placed)


def _as_spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def assign_spans(text: Column) -> Column:
    long_value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= MIN_ASSIGN
    return F.when(F.regexp_like(text, F.lit(ASSIGN)), F.filter(_matches(text, ASSIGN), long_value)).otherwise(F.array().cast(_MATCHES))


def base_spans(text: Column, assign: Column) -> Column:
    """All base spans of a text as array of (s, k, e), ordered by start, then kind."""
    none = F.array().cast(_SPANS)
    long_key = lambda x: F.length(x["m"]) >= MIN_ACCESS
    access = F.when(text.contains("AKIA"), _as_spans(F.filter(_matches(text, ACCESS), long_key), 1)).otherwise(none)
    hexes = F.when(F.regexp_like(text, F.lit(HEX)), _as_spans(_matches(text, HEX), 2)).otherwise(none)
    return F.array_sort(F.concat(_as_spans(assign, 0), access, hexes))


def candidates(text: Column, assign: Column) -> Column:
    """Array of (s, e, m): tokens between the assign spans without an access or hex span."""

    def between(a: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(a, lambda x: x["e"]))
        ends = F.concat(F.transform(a, lambda x: x["s"]), F.array(F.length(text)))
        gaps = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), F.substr(text, s + 1, e - s).alias("t")))
        shifted = lambda g: F.transform(_matches(g["t"], TOKEN), lambda x: F.struct((g["s"] + x["s"]).alias("s"), (g["s"] + x["e"]).alias("e"), x["m"].alias("m")))
        return F.flatten(F.transform(F.filter(gaps, lambda g: F.regexp_like(g["t"], F.lit(TOKEN))), shifted))

    found = F.when(F.size(assign) == 0, _matches(text, TOKEN)).otherwise(_let(assign, between))
    tokens = F.when(F.regexp_like(text, F.lit(TOKEN)), found).otherwise(F.array().cast(_MATCHES))
    return F.filter(tokens, lambda x: ~F.regexp_like(x["m"], F.lit(TAKEN)))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: Abramowitz and Stegun 26.2.17, absolute error below 7.5e-8; 0 from z = 38."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly


class _Encoding:
    """What uniform draws of an alphabet expect in each test."""

    def __init__(self, alphabet: str) -> None:
        n = len(alphabet)
        cells = [sum(c in cell for c in alphabet) / n for cell in CELLS]
        self.inverse, self.freedom = [1 / p if p else 0.0 for p in cells], float(max(1, sum(p > 0 for p in cells) - 1))
        kinds = [sum(c in kind for c in alphabet) / n for kind in (_LOWER, _UPPER)]
        kinds.append(1 - sum(kinds))
        self.same, cubes = sum(q * q for q in kinds), sum(q**3 for q in kinds)
        self.spread, self.cross = self.same * (1 - self.same), 2 * (cubes - self.same**2)
        self.vowels = sum(c in VOWELS for c in alphabet) / n
        self.high = alphabet[(n + 1) // 2 :]
        self.highs = len(self.high) / n


_ENCODINGS = tuple(map(_Encoding, ALPHABETS))


def _of(encoding: Column, name: str) -> Column:
    values = F.array(*[F.array(*map(F.lit, v)) if isinstance(v := getattr(e, name), list) else F.lit(v) for e in _ENCODINGS])
    return F.element_at(values, encoding + 1)


def _serial(marked: Column, n: Column, share: Column) -> Column:
    """Lag-one serial correlation of the marks ``!`` in a token, in standard deviations of uniform draws."""
    def z(s: Column) -> Column:
        count = (F.length(s) - F.length(F.replace(s, F.lit("!"), F.lit("")))).cast("double")
        ends = (F.substring(s, 1, 1) == "!").cast("double") + (F.substring(s, -1, 1) == "!").cast("double")
        both = F.regexp_count(s, F.lit("!(?=!)")).cast("double")
        return (both - share * (count * 2 - ends) + (n - 1) * share * share) / (F.sqrt(n - 1) * share * (1 - share))

    return F.when(share > 0, F.abs(_let(marked, z))).otherwise(F.lit(0.0))


def encoding_of(body: Column) -> Column:
    """Number of the smallest alphabet that has all characters; null if none."""
    kind = F.lit(None).cast("int")
    for k, a in reversed(list(enumerate(ALPHABETS))):
        letters = "".join("\\" + c if c in "-/+" else c for c in a)
        kind = F.when(F.regexp_like(body, F.lit(f"^[{letters}]+$")), F.lit(k)).otherwise(kind)
    return kind


def distance(token: Column, kind: Column | None = None) -> Column:
    """The battery's distance from uniform draws of the token's encoding: near 0 for random tokens; null without encoding."""
    body = F.regexp_replace(token, "=+$", "") if kind is None else token

    def measure(x: Column) -> Column:
        t, n = x["t"], x["n"]
        k = x["k"] if kind is None else kind
        counts = [(n - F.length(F.translate(t, cell, ""))) for cell in CELLS]
        chi = reduce(lambda a, b: a + b, [o * o * F.element_at(_of(k, "inverse"), i + 1) for i, o in enumerate(counts)]) / n - n
        freedom = _of(k, "freedom")
        z1 = (F.cbrt(F.greatest(chi, F.lit(0.0)) / freedom) - (1 - F.lit(2.0) / (freedom * 9))) / F.sqrt(F.lit(2.0) / (freedom * 9))
        runs = (F.regexp_count(t, F.lit("[a-z]+|[A-Z]+|[^a-zA-Z]+")) - 1).cast("double")
        same, spread, cross = _of(k, "same"), _of(k, "spread"), _of(k, "cross")
        z2 = F.when(same < 1, ((n - 1) * (1 - same) - runs) / F.sqrt((n - 1) * spread + (n - 2) * cross)).otherwise(F.lit(0.0))
        highs = F.call_function("translate", t, _of(k, "high"), F.repeat(F.lit("!"), F.length(_of(k, "high"))))
        z3 = F.greatest(
            _serial(F.translate(t, VOWELS, "!" * len(VOWELS)), n, _of(k, "vowels")),
            _serial(highs, n, _of(k, "highs")),
        )
        return z1 + F.greatest(z2 - 1, F.lit(0.0)) + F.greatest(z3 - 2, F.lit(0.0))

    sized = lambda t: F.struct(t.alias("t"), (encoding_of(t) if kind is None else kind).alias("k"), F.length(t).cast("double").alias("n"))
    return _let(_let(body, sized), lambda x: F.when(x["k"].isNotNull() & (x["n"] >= 2), measure(x)))


def _bin(d: Column) -> Column:
    return F.floor((F.greatest(F.lit(LOW), F.least(d, F.lit(HIGH))) - LOW) * STEP).cast("int")


def _length_class(n: Column) -> Column:
    return sum(((n >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))


def prose_stretch(text: Column) -> Column:
    """(c, b) of one stretch of the text's letters: its length class, one of those that the letters fill, and its bin; null if they fill none."""

    def cut(letters: Column) -> Column:
        drawn = F.xxhash64(letters)
        filled = sum(((F.length(letters) >= low).cast("int") for low in LENGTHS), F.lit(0))
        c = F.pmod(drawn, F.greatest(filled, F.lit(1))).cast("int")
        n = F.element_at(F.array(*map(F.lit, LENGTHS)), c + 1)
        at = F.pmod(F.shiftrightunsigned(drawn, 20), F.length(letters) - n + 1).cast("int") + 1
        stretch = _bin(distance(F.substr(letters, at, n), F.lit(ALPHABETS.index(_LOWER))))
        return F.when(filled > 0, F.struct(c.alias("c"), stretch.alias("b")))

    return _let(F.lower(F.regexp_replace(text, "[^A-Za-z]+", "")), cut)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: id, base (array of spans), random (array of spans of the method)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("assign", assign_spans(F.col("text")))
    tested = F.transform(
        candidates(F.col("text"), F.col("assign")),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _length_class(F.length(x["m"])).alias("c"), _bin(distance(x["m"])).alias("b")),
    )
    scanned = checkpointed(
        scanned.select("id", base_spans(F.col("text"), F.col("assign")).alias("base"), tested.alias("tokens"), prose_stretch(F.col("text")).alias("prose"))
    )
    # Two tables of at most len(LENGTHS) * (HIGH - LOW) * STEP rows, whatever the number of tokens and documents.
    both = F.concat(F.transform("tokens", lambda t: F.struct(F.lit(0).alias("null"), t["c"].alias("c"), t["b"].alias("b"))),
                    F.array(F.struct(F.lit(1).alias("null"), F.col("prose.c").alias("c"), F.col("prose.b").alias("b"))))
    tables: tuple[dict, dict] = ({}, {})
    for r in scanned.select(F.explode(both).alias("t")).where("t.b is not null").groupBy("t.null", "t.c", "t.b").count().collect():
        tables[r["null"]][r["c"], r["b"]] = r["count"]
    limits = F.array(*[F.lit(x) for x in random_below(tables[0], tables[1], fdr)])
    random = F.filter("tokens", lambda x: x["b"] < F.element_at(limits, x["c"] + 1))
    return scanned.select(F.col("id").alias(id_col), "base", _as_spans(random, 3).alias("random"))


def null_of(prose: dict[tuple[int, int], int], c: int) -> tuple[float, float]:
    """Median and upper spread of the distances of structured tokens of a length class."""
    own = {b: float(n) for (k, b), n in prose.items() if k == c}
    for i in range(PRIOR_ROWS):
        d = PRIOR_MEDIAN * LENGTHS[c] ** (1 / 3) + PRIOR_SPREAD * _normal_quantile((i + 0.5) / PRIOR_ROWS)
        b = int((d - LOW) * STEP)
        own[b] = own.get(b, 0.0) + 1
    total = sum(own.values())

    def quantile(q: float) -> float:
        so_far = 0.0
        for b in sorted(own):
            so_far += own[b]
            if so_far >= q * total:
                break
        return LOW + (b + 0.5) / STEP

    middle = quantile(0.5)
    return middle, max(0.5, quantile(0.8413) - middle)


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def p_value(b: int, null: tuple[float, float]) -> float:
    """How often a structured token has a distance in bin b or below."""
    z = (LOW + (b + 1) / STEP - null[0]) / null[1]
    return 0.5 * math.erfc(-z / math.sqrt(2))


def random_below(tokens: dict[tuple[int, int], int], prose: dict[tuple[int, int], int], fdr: float) -> list[int]:
    """Per length class the bin of distance below which Benjamini-Hochberg declares tokens random (0: none)."""
    p_bins: dict[tuple[int, int], int] = {}
    of: dict[tuple[int, int], int] = {}
    for (c, b), n in tokens.items():
        of[c, b] = min(BINS, int(-10 * math.log10(max(1e-300, p_value(b, null_of(prose, c))))))
        p_bins[c, of[c, b]] = p_bins.get((c, of[c, b]), 0) + n
    cuts = rejected_from(p_bins, fdr)
    return [max([b + 1 for (k, b), p in of.items() if k == c and p >= cuts[c]], default=0) for c in range(len(LENGTHS))]


def rejected_from(counts: dict[tuple[int, int], int], fdr: float) -> list[int]:
    """Benjamini-Hochberg on counts per (length class, bin of -10 log10 p): per class the least bin that is rejected; BINS + 1 if none."""
    out = []
    for c in range(len(LENGTHS)):
        own = {b: n for (k, b), n in counts.items() if k == c}
        total, above, cut = sum(own.values()), 0, BINS + 1
        for b in sorted(own, reverse=True):
            above += own[b]
            if 10 ** (-b / 10) <= fdr * above / total:
                cut = b
        out.append(cut)
    return out


#: The procedure's former name, from when it rejected uniformity instead of structure.
structured_from = rejected_from


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a scan: counts per base kind, hash of the base spans, all spans as text."""
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
