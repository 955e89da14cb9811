"""Secret scan: base patterns, and a battery of randomness tests for tokens that no pattern names. DataFrame functions only.

Base kinds (always reported): assign, access, hex. The method adds kind ``random``: a token of ``MIN_TOKEN`` or more
characters whose alphabet is inferred (hex, base32, base64), and which

* three tests fail to tell from uniform noise: chi-squared uniformity of the alphabet, Wald-Wolfowitz runs about the
  alphabet's middle, and lag-1 serial correlation (Bonferroni over the three), and
* is unlikely as text: the chi-squared value lies far below what text of that length gives (a shifted chi-squared
  whose shift grows with the length, so short tokens need more evidence), at the false-discovery rate ``RATE`` by
  Benjamini-Hochberg over all tokens of the document.

Defined cases: null text counts as empty; texts without tokens give no spans; repeated rows are each reported; columns
other than the id and the text are ignored; an empty table gives an empty result. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.spans import Proposal, alone, joined, of_rank, with_found, with_spans

BASE = ("assign", "access", "hex")
MIN_TOKEN = 20
#: Significance of the tests against uniform noise, and the false-discovery rate against text.
ALPHA, RATE = 0.01, 0.05

LEFT = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
ASSIGN = LEFT + "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{14,}"  # the same matches as one or more, then 18 in all: a later start in a run is shorter
HEX = "[0-9a-f]{16,}"
TOKEN = f"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"

#: Encodings by the first pattern that a token fits: name, pattern, alphabet in order, excess of text (size of the alphabet times the chance that two letters of a text agree, less 1).
HEX_LOW, HEX_HIGH, B32, B64 = "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", HEX_LOW, 0.6),
    ("HEX", "^[0-9A-F]+$", HEX_HIGH, 0.6),
    ("base32", "^[A-Z2-7]+$", B32, 1.08),
    ("base64", "", B64, 3.2),
]

PROPOSALS = [
    Proposal("assign", ASSIGN, LEFT, lambda x: F.length(F.regexp_replace(x["hit"], "^" + LEFT, "")) >= 12, lambda x: F.lit(1.0)),
    Proposal("access", ACCESS, "AKIA", lambda x: F.lit(True), lambda x: F.lit(1.0)),
    Proposal("hex", HEX, HEX, lambda x: F.lit(True), lambda x: F.lit(1.0)),
]


def below(z: Column) -> Column:
    """The normal distribution function, by a polynomial that is right to 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_sided(z: Column) -> Column:
    return 2 * below(-F.abs(z))


def _per_encoding(token: Column, value) -> Column:
    """value(alphabet, excess) of the first encoding that the token fits."""
    out = None
    for _, pattern, alphabet, excess in reversed(ENCODINGS):
        here = value(alphabet, excess)
        out = here if out is None else F.when(token.rlike(pattern), here).otherwise(out)
    return out


def _symbols(token: Column) -> Column:
    """The token in the base64 alphabet's own characters."""
    return F.translate(token, "-_", "+/")


def _battery(x: Column) -> Column:
    """What the tests need of a token: length, alphabet size, excess, chi-squared, runs, halves and lag products."""
    token = _symbols(x["hit"])
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    halves = _per_encoding(token, lambda a, e: F.translate(token, a, "0" * (len(a) // 2) + "1" * (len(a) // 2)))
    index = _per_encoding(token, lambda a, e: F.transform(chars, lambda c: F.instr(F.lit(a), c).cast("double")))
    lag = F.aggregate(
        index,
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("xy"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx")),
        lambda acc, v: F.struct(
            v.alias("last"), (acc["xy"] + F.coalesce(acc["last"] * v, F.lit(0.0))).alias("xy"), (acc["x"] + v).alias("x"), (acc["xx"] + v * v).alias("xx")),
    )
    first = F.coalesce(F.get(index, F.lit(0)), F.lit(0.0))
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), (alone(x) & token.rlike("[0-9]") & token.rlike("[A-Za-z]")).alias("fit"),
        F.length(token).cast("double").alias("n"), _per_encoding(token, lambda a, e: F.lit(float(len(a)))).alias("size"),
        _per_encoding(token, lambda a, e: F.lit(e)).alias("excess"), squares.alias("squares"),
        F.length(F.regexp_replace(halves, "0+|1+", "x")).cast("double").alias("runs"),
        F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double").alias("high"),
        lag.alias("lag"), first.alias("first"),
    )


def _judged(b: Column) -> Column:
    """struct(start, end, ok, p): whether the tests take the token for noise, and how likely text would look as uniform."""
    n, free = b["n"], b["size"] - 1
    chi = b["squares"] * b["size"] / n - n
    third = F.pow(chi / free, F.lit(1 / 3))
    z_chi = (third - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    low = n - b["high"]
    mean = 2 * b["high"] * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(spread > 0, (b["runs"] - mean) / F.sqrt(spread)).otherwise(F.lit(99.0))
    lag = b["lag"]
    centre = lag["x"] / n
    dev = lag["xx"] - n * centre * centre
    cov = lag["xy"] - centre * (2 * lag["x"] - b["first"] - lag["last"]) + (n - 1) * centre * centre
    z_lag = F.when(dev > 0, cov / dev * F.sqrt(n)).otherwise(F.lit(99.0))
    least = F.least(two_sided(z_chi), two_sided(z_runs), two_sided(z_lag))
    shift = n * b["excess"]
    p_text = below((chi - (free + shift)) / F.sqrt(2 * (free + 2 * shift)))
    return F.struct(b["start"].alias("start"), b["end"].alias("end"), (least * 3 >= ALPHA).alias("ok"), p_text.alias("p"))


def _discovered(judged: Column) -> Column:
    """The largest p that Benjamini-Hochberg rejects at RATE among all tokens of the document; -1 if none."""
    ranked = F.array_sort(F.transform(judged, lambda j: j["p"]))
    passing = F.filter(F.transform(ranked, lambda p, i: F.when(p <= RATE * (i + 1) / F.size(judged), p).otherwise(F.lit(-1.0))), lambda p: p >= 0)
    return F.coalesce(F.array_max(passing), F.lit(-1.0))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with column out: all spans, struct(start, rank, end, kind, score), by start, then kind as listed."""
    df = df.withColumn("__secret_text", F.coalesce(F.col(text), F.lit("")))
    df = with_spans(df, "__secret_text", PROPOSALS, "__base")
    df = with_found(df, "__secret_text", "__tokens", TOKEN, TOKEN)
    df = df.withColumn("__battery", F.when(F.size("__tokens") > 0, F.filter(F.transform("__tokens", _battery), lambda b: b["fit"])))
    df = df.withColumn("__judged", F.transform("__battery", _judged))
    df = df.withColumn("__bound", F.when(F.size("__judged") > 0, _discovered(F.col("__judged"))).otherwise(F.lit(-1.0)))
    bound = F.col("__bound")
    noise = F.transform(
        F.filter(F.arrays_zip(F.col("__judged").alias("j"), F.array_repeat(bound, F.size("__judged")).alias("b")), lambda z: z["j"]["ok"] & (z["j"]["p"] <= z["b"])),
        lambda z: F.struct(z["j"]["start"].alias("start"), F.lit(len(BASE)).alias("rank"), z["j"]["end"].alias("end"), F.lit("random").alias("kind"), (1 - z["j"]["p"]).alias("score")))
    spans = F.when(F.size("__judged") > 0, F.array_sort(F.concat(F.col("__base"), noise))).otherwise(F.col("__base"))
    return df.withColumn(out, spans).drop("__secret_text", "__base", "__tokens", "__battery", "__judged", "__bound")


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, all spans."""
    found = find_secrets(documents.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("secrets", of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
