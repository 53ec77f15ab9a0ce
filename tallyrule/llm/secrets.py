"""Secret scans: three fixed patterns, and a battery of randomness tests over other tokens, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import materialize

# The base patterns. Group 1 is what stands before, group 2 the match, group 3 (where there is one) the value.
# \G ties each search to the end of the last match; without it the rest after the last match would be searched from every place.
KEYWORDS = r"(?i)(?:password|passwd|secret|token|api_?key)"
ASSIGN = rf"\G(?s)(.*?)({KEYWORDS}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
ACCESS = r"\G(?s)(.*?)(AKIA[A-Z0-9]+)"
HEX = r"\G(?s)(.*?)([0-9a-f]{24,})"
#: Tokens for the test battery: at least 20 characters of a base-64 alphabet, nothing of it before them.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
BANDS = (20, 32, 64)
ENCODINGS = ("hex", "base32", "base64")
#: Mean and standard deviation of the battery's sum for ordinary names and paths, by band of length, until the corpus has its own; they
#: count as PRIOR_TOKENS tokens.
PRIOR = ((8.0, 2.5), (12.0, 3.0), (18.0, 4.0))
PRIOR_TOKENS = 50
#: Alphabets of the inferred encodings, in the order of their values.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}

_SPANS = "array<struct<s:bigint,e:bigint>>"


def _spans(text: str, pattern: str, value_from: int = 0, least: int = 1) -> Column:
    """Spans in code points of all matches in order; matches whose value (or self) is shorter than least are then left out."""
    part = lambda i, name: F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(name)
    parts = F.arrays_zip(part(1, "a"), part(2, "b"), part(3 if value_from else 2, "c"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint,v:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["a"])
        e = s + F.length(x["b"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), F.length(x["c"]).alias("v")))).alias("out"))

    return F.filter(F.aggregate(parts, start, step, lambda acc: acc["out"]), lambda x: x["v"] >= least)


def _below(z: Column) -> Column:
    """The normal distribution function at z below 0, by Abramowitz and Stegun's 26.2.17 (error under 1e-7); 1/2 and more above 0."""
    x = F.least(F.abs(z), F.lit(12.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """(kind, stat) of a token: its inferred encoding (a place in ENCODINGS) and the sum of three tests of uniformly random characters.

    Chi-squared of the character counts (with exact mean and variance), runs of character classes (capitals, small letters, digits, signs;
    fewer count), and lag-one serial correlation of the character values (positive ones count), each in its standard deviations.
    Random tokens of any encoding and length have sums around 0, names and paths have larger ones, which grow with their length.
    """
    same = F.translate(token, "-_", "+/")
    kind = F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 0).when(token.rlike("^[A-Z2-7]+$"), 1).otherwise(2)
    pick = lambda k, *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).otherwise(xs[2])
    letters = pick(kind, *(F.lit(ALPHABETS[e]) for e in ENCODINGS))
    clean = F.when(kind == 0, F.lower(same)).otherwise(same)

    def tests(x: Column) -> Column:
        n, k, chars, v = x["n"], x["k"], x["chars"], x["v"]
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(chars, lambda d: d == c)).cast("double"), F.lit(2.0)))
        z_chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        group = lambda y: pick(x["kind"], (y >= 10).cast("int"), (y >= 26).cast("int"), (y >= 26).cast("int") + (y >= 52).cast("int") + (y >= 62).cast("int"))
        pairs = F.arrays_zip(F.slice(v, 1, x["size"] - 1).alias("a"), F.slice(v, 2, x["size"] - 1).alias("b"))
        runs = F.aggregate(pairs, F.lit(0.0), lambda acc, y: acc + F.when(group(y["a"]) != group(y["b"]), 1.0).otherwise(0.0))
        change = pick(x["kind"], F.lit(1 - (10**2 + 6**2) / 16**2), F.lit(1 - (26**2 + 6**2) / 32**2), F.lit(1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2))
        z_runs = (runs - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        average = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y) / n
        across = F.aggregate(pairs, F.lit(0.0), lambda acc, y: acc + (y["a"] - average) * (y["b"] - average))
        own = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + (y - average) * (y - average))
        z_serial = (across / F.greatest(own, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        return F.struct(x["kind"].alias("kind"), (z_chi - z_runs + F.greatest(z_serial, F.lit(0.0))).alias("stat"))

    chars = F.split(clean, "")
    data = F.struct(kind.alias("kind"), F.length(clean).cast("double").alias("n"), F.length(clean).alias("size"), F.length(letters).cast("double").alias("k"), chars.alias("chars"), F.transform(chars, lambda c: (F.instr(letters, c) - 1).cast("double")).alias("v"))
    # a one-element transform binds the struct once
    return F.element_at(F.transform(F.array(data), tests), 1)


def _band(x: Column) -> Column:
    """The band of lengths of a span, from 0."""
    return sum(((x["e"] - x["s"]) >= b).cast("int") for b in BANDS[1:]) + F.lit(0)


def ordinary(tested: DataFrame) -> list[list[tuple[float, float]]]:
    """Mean and standard deviation of the battery's sum by encoding and band, from the tokens without digits and the PRIOR.

    Tokens of letters and signs alone are names, paths and words; they are no candidates, and give the null hypothesis.
    """
    x = tested.where("tested IS NOT NULL").select(F.explode("tested").alias("x")).where("x.plain")
    rows = x.groupBy(F.col("x.kind").alias("kind"), _band(F.col("x")).alias("band")).agg(F.count("*").alias("n"), F.sum("x.stat").alias("s"), F.sum(F.col("x.stat") * F.col("x.stat")).alias("q"))
    sums = {(r.kind, r.band): (r.n, r.s, r.q) for r in rows.collect()}  # at most nine rows
    out = []
    for kind in range(len(ENCODINGS)):
        own = []
        for band, (mean, sd) in enumerate(PRIOR):
            n, s, q = sums.get((kind, band), (0, 0.0, 0.0))
            n, s, q = n + PRIOR_TOKENS, s + PRIOR_TOKENS * mean, q + PRIOR_TOKENS * (mean * mean + sd * sd)
            own.append((s / n, math.sqrt(max(q / n - (s / n) ** 2, 0.25))))
        out.append(own)
    return out


def p_value(x: Column, null: list[list[tuple[float, float]]]) -> Column:
    """How likely an ordinary token of x's encoding and band looks at least as random as x."""
    pick = lambda i: F.element_at(F.array(*[F.lit(float(c[i])) for own in null for c in own]), x["kind"] * len(BANDS) + _band(x) + 1)
    return _below((x["stat"] - pick(0)) / pick(1))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """Base spans and random-looking tokens of every whole text.

    Columns doc_id, assign, access, hex (arrays of spans), random (spans that the battery adds). A token is a candidate if it holds a
    digit and a letter and touches no base span. The null hypothesis is that it is an ordinary name or path of its encoding and
    length (ordinary), and Benjamini-Hochberg at the given rate over the candidates of each band of lengths decides which are reported: of
    those, at most that share are expected to be ordinary. P-values enter as counts of hundredths of their decimal logarithm,
    rounded up, so no list of tokens is sorted or collected.
    A null text is empty and has no spans; rows are judged alone but for those thresholds, so repeated or null ids do no harm (repeated
    rows count each time); an empty table gives an empty result. Only id and text are read.
    """
    t = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    none = F.lit(None).cast("array<struct<s:bigint,e:bigint,v:int>>")
    found = {
        "assign": F.when(F.col("_t").rlike(KEYWORDS), _spans("_t", ASSIGN, 3, 6)).otherwise(none),
        "access": F.when(F.contains("_t", F.lit("AKIA")), _spans("_t", ACCESS, 0, 20)).otherwise(none),
        "hex": F.when(F.col("_t").rlike("[0-9a-f]{24}"), _spans("_t", HEX, 0, 24)).otherwise(none),
        "tokens": F.when(F.col("_t").rlike(TOKEN), _spans("_t", rf"\G(?s)(.*?)({TOKEN})", 0, 20)).otherwise(none),
    }
    empty = F.array().cast(_SPANS)
    bare = lambda c: F.coalesce(F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), empty)
    t = t.select("doc_id", "_t", *[c.alias(k) for k, c in found.items()]).select("doc_id", *[bare(k).alias(k) for k in KINDS[:3]], F.col("tokens"), "_t")
    base = F.concat(*KINDS[:3])
    word = lambda x: F.substring(F.col("_t"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))
    free = F.filter("tokens", lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])) & word(x).rlike("[A-Za-z]"))
    judged = lambda x, y: F.struct(x["s"].alias("s"), x["e"].alias("e"), y["kind"].alias("kind"), y["stat"].alias("stat"), (~word(x).rlike("[0-9]")).alias("plain"))
    tested = F.transform(free, lambda x: F.element_at(F.transform(F.array(battery(word(x))), lambda y: judged(x, y)), 1))
    t = t.select("doc_id", *KINDS[:3], F.when(F.col("tokens").isNotNull(), tested).alias("tested"))
    t = materialize(t, "spans")

    null = ordinary(t)
    cell = lambda p: F.floor(-100 * F.log10(F.greatest(p, F.lit(1e-30)))).cast("int")
    counts = t.where("tested IS NOT NULL").select(F.explode("tested").alias("x")).where("NOT x.plain").groupBy(_band(F.col("x")).alias("band"), cell(p_value(F.col("x"), null)).alias("cell")).count()
    cut = thresholds([(x["band"], x["cell"], x["count"]) for x in counts.collect()], rate)  # at most 3 * 3001 rows
    limit = lambda x: F.element_at(F.array(*[F.lit(c) for c in cut]), _band(x) + 1)
    kept = F.filter("tested", lambda x: ~x["plain"] & (cell(p_value(x, null)) >= limit(x)))
    return t.select("doc_id", *KINDS[:3], F.coalesce(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), empty).alias("random"))


def thresholds(counts: list[tuple[int, int, int]], rate: float) -> list[int]:
    """For each band the least cell (hundredths of -log10 p) that Benjamini-Hochberg rejects, from (band, cell, tokens); beyond all if none."""
    out = []
    for band in range(len(BANDS)):
        cells = {c: n for b, c, n in counts if b == band}
        m, rank, cut = sum(cells.values()), 0, 1 << 30
        for c in sorted(cells, reverse=True):
            rank += cells[c]
            if 10 ** (-c / 100) <= rate * rank / m:
                cut = c
        out.append(cut)
    return out


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans by start, then kind as listed, joined by commas."""
    tag = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("i"), x["e"].alias("e"), F.lit(k).alias("k"))
    tagged = [F.transform(k, tag(k)) for k in kinds]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(F.encode(listed(*KINDS[:3]), "UTF-8"), 256).alias("base_sha256"), listed(*KINDS).alias("spans"))
