"""Secrets in texts: fixed patterns, and tokens whose characters look random.

Built-in functions only: positions come from the texts between matches, the tests for
randomness are expressions over the characters of a token, and the corpus-wide threshold
is an aggregate of at most ``BANDS * BINS`` rows.

The battery takes every run of 20 or more key characters that holds a digit and a letter
and whose alphabet is that of a known encoding. A run with marks of two alphabets, such as a
path that ends in a token, is taken apart at the marks foreign to each. Its hypothesis is that the token is
random in that alphabet. Three tests look against it: chi-squared uniformity over pooled
cells of the alphabet, the number of runs above and below the middle of the alphabet, and
the correlation of neighbours. Their p-values are combined by Fisher's rule. Tokens of
one length band are judged together by the Benjamini-Hochberg rule, so that at most the
share ``q`` of the tokens dismissed as ordinary is random after all: long tokens, of which
the tests know much, are not outvoted by the many short ones. What is not dismissed is a
span of kind ``random``, unless a pattern has found it already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import plain_names

# Fixed patterns of the base rules. A match of `assign` counts if its second group has six characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
# Marks that no encoding holds together, and the runs of either alphabet within such a token.
FOREIGN = "[+/].*[_-]|[_-].*[+/]"
PIECES = (r"[A-Za-z0-9_-]{20,}+={0,2}", r"[A-Za-z0-9+/]{20,}+={0,2}")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings in the order in which they are tried: name, pattern, alphabet by code.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
# Bands of token length, one per power of two; p-values are counted in steps of a twentieth of a power of ten.
BANDS, BINS, STEPS = 32, 400, 20
FALSE_DISCOVERIES = 0.01
MARK = "[SECRET]"

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_TOKENS = "array<struct<start:int,end:int,token:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, item: Callable[[Column, Column, Column], Column], keep: Callable[[Column], Column], kind: str, group: int = 0) -> Column:
    """An item for each kept match of a pattern, from its start, end and text, in code points.

    The texts between matches and the matches are walked together, so no position is searched again.
    """
    pat = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pat, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pat, F.lit(group)).alias("part"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        kept = x["match"].isNotNull() & keep(x["part"])
        found = F.when(kept, F.concat(acc["items"], F.array(item(start, end, x["match"])))).otherwise(acc["items"])
        return F.struct(end.alias("at"), found.alias("items"))

    none = F.array().cast(kind)
    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("items")), step, lambda acc: acc["items"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _pattern_spans(text: Column, kind: int) -> Column:
    def item(start: Column, end: Column, match: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))

    if KINDS[kind] == "assign":
        return _found(text, ASSIGN, item, lambda part: F.length(part) >= 6, _SPANS, group=2)
    return _found(text, (ASSIGN, ACCESS, HEX)[kind], item, lambda part: F.lit(True), _SPANS)


def _tokens(text: Column) -> Column:
    """Runs of key characters with a digit and a letter; of a run that fits no encoding, the runs of each alphabet."""

    def runs(of: Column, pattern: str, at: Column) -> Column:
        def item(start: Column, end: Column, match: Column) -> Column:
            return F.struct((at + start).alias("start"), (at + end).alias("end"), match.alias("token"))

        return _found(of, pattern, item, lambda part: part.rlike("[0-9]") & part.rlike("[A-Za-z]"), _TOKENS)

    def whole(t: Column) -> Column:
        pieces = F.concat(*[runs(t["token"], pattern, t["start"]) for pattern in PIECES])
        return F.when(t["token"].rlike(FOREIGN), pieces).otherwise(F.array(t))

    return F.flatten(F.transform(runs(text, TOKEN, F.lit(0)), whole))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic curve good to 0.0002 (Bowling and others, 2009)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _both(z: Column) -> Column:
    return F.least(2 * _tail(F.abs(z)), F.lit(1.0))


def _mean(values: Column, n: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n


def _uniform(codes: Column, n: Column, k: Column) -> Column:
    """p-value of chi-squared over cells that expect five characters each, two cells at least."""
    cells = F.greatest(F.least((n / 5).cast("int"), k), F.lit(2))

    def statistic(b: Column) -> Column:
        def cell(i: Column) -> Column:
            low, high = F.ceil(i * k / b), F.ceil((i + 1) * k / b)
            expected = n * (high - low) / k
            seen = F.size(F.filter(codes, lambda c: (c >= low) & (c < high)))
            return (seen - expected) * (seen - expected) / expected

        x2 = F.aggregate(F.transform(F.sequence(F.lit(0), b - 1), cell), F.lit(0.0), lambda a, x: a + x)
        step = F.lit(2.0) / (9 * (b - 1))
        return _tail((F.pow(x2 / (b - 1), F.lit(1 / 3)) - (1 - step)) / F.sqrt(step))

    return _let(cells, statistic)


def _neighbours(codes: Column, n: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), f)


def _runs(codes: Column, n: Column, k: Column) -> Column:
    """p-value of the number of runs above and below the middle of the alphabet."""
    upper = F.transform(codes, lambda c: 2 * c >= k)
    high = F.size(F.filter(upper, lambda x: x)).cast("double")
    runs = 1 + F.size(F.filter(_neighbours(upper, n, lambda a, b: a != b), lambda x: x))

    def p(h: Column) -> Column:
        twice = 2 * h * (n - h)
        mean = twice / n + 1
        var = twice * (twice - n) / (n * n * (n - 1))
        return F.when(var > 0, _both((runs - mean) / F.sqrt(var))).otherwise(F.lit(0.0))

    return _let(high, p)


def _serial(codes: Column, n: Column, k: Column) -> Column:
    """p-value of the correlation of neighbouring characters."""
    mid, var = (k - 1) / 2, (k * k - 1) / 12
    total = F.aggregate(_neighbours(codes, n, lambda a, b: (a - mid) * (b - mid)), F.lit(0.0), lambda a, x: a + x)
    return _both(total / (var * F.sqrt(n - 1)))


def _battery(token: Column, alphabet: Column) -> Column:
    """Combined p-value of a token against randomness in an alphabet."""
    k = F.length(alphabet)
    codes = F.transform(F.filter(F.split(token, "", -1), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)

    def combined(c: Column) -> Column:
        n = F.size(c)
        logs = [F.log(F.greatest(p, F.lit(1e-12))) for p in (_uniform(c, n, k), _runs(c, n, k), _serial(c, n, k))]
        half = -(logs[0] + logs[1] + logs[2])
        return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return _let(codes, combined)


def _judged(token: Column) -> Column:
    """``(band, bin)`` of a token; null if its characters fit no encoding."""
    bare = F.rtrim(token, F.lit("="))
    fitting = F.lit(None).cast("string")
    for _, pattern, alphabet in reversed(ENCODINGS):
        fitting = F.when(bare.rlike(pattern), F.lit(alphabet)).otherwise(fitting)
    p = _let(fitting, lambda alphabet: F.when(alphabet.isNotNull(), _battery(bare, alphabet)))
    band = F.least(F.log2(F.length(bare)).cast("int"), F.lit(BANDS - 1))

    def binned(q: Column) -> Column:
        step = F.least(F.floor(-F.log10(F.greatest(q, F.lit(1e-19))) * STEPS), F.lit(BINS - 1)).cast("int")
        return F.when(q.isNotNull(), F.struct(band.alias("band"), step.alias("bin")))

    return _let(p, binned)


def dismissal(docs: DataFrame, text_col: str = "text", q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """{length band: first bin of p-values that is dismissed as ordinary}, over all tokens of all texts.

    The counts by band and bin are made where the texts are read; at most ``BANDS`` rows
    come to the driver. A band without dismissals is missing.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    tokens = docs.select(F.explode(_tokens(text)).alias("t")).select(_judged(F.col("t.token")).alias("j"))
    counts = tokens.where("j IS NOT NULL").groupBy("j.band", "j.bin").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("band").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(below)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    edge = F.pow(F.lit(10.0), -F.col("bin") / STEPS)
    first = ranked.where(edge <= q * F.col("upto") / F.col("all")).groupBy("band").agg(F.min("bin").alias("bin"))
    return {r["band"]: r["bin"] for r in first.collect()}


def find_secrets(docs: DataFrame, text_col: str = "text", q: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of ``(start, kind, end)`` by start, then kind.

    ``start`` and ``end`` count code points, ``end`` exclusive; ``kind`` is a place in
    ``KINDS``. ``_base`` holds what the patterns find, ``_spans`` the random tokens too.
    Null and empty texts have empty arrays, an empty table gives no rows, rows that repeat
    stay, columns beside the text pass as they are. Texts of any length are searched whole.
    """
    limits = dismissal(docs, text_col, q)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    by_kind = [_pattern_spans(text, kind) for kind in range(3)]
    found = docs.select("*", F.array_sort(F.concat(*by_kind)).alias("_base"), _tokens(text).alias("_tokens"))

    def random(t: Column) -> Column:
        def undismissed(j: Column) -> Column:
            first = F.lit(BINS)
            for band, at in sorted(limits.items()):
                first = F.when(j["band"] == band, F.lit(at)).otherwise(first)
            return j.isNotNull() & (j["bin"] < first)

        known = F.exists(F.col("_base"), lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"]))
        return ~known & _let(_judged(t["token"]), undismissed)

    kind = F.lit(KINDS.index("random"))
    more = F.transform(
        F.filter(F.col("_tokens"), random),
        lambda t: F.struct(t["start"].alias("start"), kind.alias("kind"), t["end"].alias("end")),
    ).cast(_SPANS)
    none = F.size("_tokens") == 0
    spans = F.when(none, F.col("_base")).otherwise(F.array_sort(F.concat("_base", more)))
    return found.withColumn("_spans", spans).drop("_tokens")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    item = F.transform(
        spans,
        lambda s: F.concat(
            F.element_at(name, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
        ),
    )
    return F.concat_ws(",", item)


def secret_report(docs: DataFrame, q: float = FALSE_DISCOVERIES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)`` per row of ``docs``."""
    found = find_secrets(docs.select("doc_id", "text"), "text", q)

    def count(kind: int) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", q: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with a mark in place of every secret; spans that touch or overlap share one mark.

    Texts without secrets stay as they are, null included; where a text changes,
    ``length_col`` is its new number of code points.
    """
    rows, named = plain_names(docs)
    found = find_secrets(rows, named[text_col], q)
    text = F.col(named[text_col])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] > acc["at"], F.concat(acc["out"], gap, F.lit(MARK))).otherwise(
            F.when(acc["out"] == "", F.lit(MARK)).otherwise(acc["out"])
        )
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.size("_spans") > 0
    fresh = found.withColumn("_clean", F.when(hit, clean).otherwise(text))
    out = []
    for c, name in named.items():
        if c == text_col:
            out.append(F.col("_clean").alias(c))
        elif c == length_col:
            out.append(F.when(hit, F.length("_clean").cast(docs.schema[c].dataType)).otherwise(F.col(name)).alias(c))
        else:
            out.append(F.col(name).alias(c))
    return fresh.select(*out)
