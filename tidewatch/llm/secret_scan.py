"""Secret scans: fixed patterns, and a battery of randomness tests on tokens, in Spark expressions alone.

Patterns give the base spans. The battery looks at every token, a run of letters, digits and ``+/_-`` of at least
:data:`LEAST` characters (``=`` at its end is padding), of the whole text:

1. An encoding is inferred from the characters: hexadecimal digits of one case, base 32, lower-case letters with digits, letters of both cases
   with digits, or these with marks (base 64). Digits must be there, and all cases of the alphabet; other tokens are words and are not tested.
2. Four statistics are standardised under uniform random symbols of that alphabet: chi-squared of the symbol counts (exact mean and variance),
   runs of symbols in the upper and lower half of the alphabet (Wald-Wolfowitz), and serial correlation of symbol numbers at lags
   one and two. Their squares add up to chi-squared with four degrees of freedom; its tail is the p-value of randomness, and tokens
   below :data:`RANDOM_P` are no secrets.
3. The same pairs of equal symbols that make up chi-squared are held against ordinary text, in which equal symbols meet with probability
   :data:`ORDINARY`: the chance of as few pairs in as many characters is the token's p-value of being ordinary. Mean and variance
   follow the length, so a short token can't have a small one.
4. Tokens are grouped by encoding and length (doublings), and in each group the Benjamini-Hochberg rule at :data:`FALSE_SHARE` chooses the level, over
   all tokens of all documents that were tested. Counts are taken on a grid of levels, so a group is a few numbers
   whatever it holds; the largest grid level that satisfies the rule is used, which is never above the exact one.

A token that overlaps a base span is counted but adds no span: the secret is reported already. Statistics of a long token are summed
over blocks of :data:`BLOCK` characters; only pairs within a block count for the correlations.

Rows: null counts as the empty text, which has no spans; null and repeated ids are rows of their own; an empty table gives no rows;
other columns are not read. Spans are in code points, ends exclusive, ordered by start, then kind (assign, access, hex, random).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import query, table
from tidewatch.session import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "random"]
#: least characters of a token, characters of a block, level below which a token is not random, false share of reported tokens
LEAST, BLOCK, RANDOM_P, FALSE_SHARE = 20, 256, 1e-3, 0.05
#: alphabets by encoding
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "lower": DIGITS + LOWER, "mixed": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/"}
#: fixed values: published frequencies of letters in English text, per thousand
LETTERS = dict(a=82, b=15, c=28, d=43, e=127, f=22, g=20, h=61, i=70, j=2, k=8, l=40, m=24, n=67, o=75, p=19, q=1, r=60, s=63, t=91, u=28, v=10, w=24, x=2, y=20, z=1)


def _ordinary(alphabet: str) -> tuple[float, float]:
    """Chances that two and that three letters of ordinary text are equal, among those of the alphabet."""
    share = [v for k, v in LETTERS.items() if k in alphabet.lower()]
    return tuple(sum((v / sum(share)) ** power for v in share) for power in (2, 3))


ORDINARY = {name: _ordinary(alphabet) for name, alphabet in ALPHABETS.items()}
#: levels at which the rule is tried
LEVELS = [FALSE_SHARE * 0.75**i for i in range(64)]


def _spans(text: Column, pattern: str, kind: str, least: int, value: str | None = None) -> Column:
    """Matches as (start, end, kind, found) in order; ``value`` is the pattern of what must have ``least`` characters.

    The text between matches and the matches themselves give all positions in one fold.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = (lambda m: F.char_length(F.regexp_extract(m, value, 2))) if value else F.char_length
    nothing = F.expr("CAST(array() AS array<struct<start:long,end:long,kind:int,found:string>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("out"))
    both = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["b"])
        end = at + F.char_length(x["m"])
        span = F.struct(at.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("found"))
        return F.struct(end.alias("at"), F.when(size(x["m"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(both, start, step)["out"]).otherwise(nothing)


def _encoding(token: Column) -> Column:
    has = lambda p: token.rlike(p)
    digit, lower, upper, mark = has("[0-9]"), has("[a-z]"), has("[A-Z]"), has("[+/_-]")
    return (
        F.when(~digit, None)
        .when(has("^([0-9a-f]+|[0-9A-F]+)$") & (lower | upper), "hex")
        .when(has("^[A-Z2-7]+$") & upper, "base32")
        .when(has("^[0-9a-z]+$") & lower, "lower")
        .when(lower & upper & ~mark, "mixed")
        .when(lower & upper, "base64")
    )


def _by(encoding: Column, value) -> Column:
    """A value that depends on the encoding."""
    out = F.lit(None)
    for name in ALPHABETS:
        out = F.when(encoding == name, value(name)).otherwise(out)
    return out


def _normal_tail(z: Column) -> Column:
    """Lower tail of the normal distribution (Abramowitz and Stegun 26.2.17, absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, upper).otherwise(1 - upper)


def _lagged(blocks: str, lag: int) -> str:
    """SQL sum of products of symbol numbers ``lag`` apart within blocks."""
    pairs = f"zip_with(slice(b, 1, greatest(size(b) - {lag}, 0)), slice(b, {lag} + 1, greatest(size(b) - {lag}, 0)), (x, y) -> (x - mean) * (y - mean))"
    return f"aggregate({blocks}, 0D, (s, b) -> s + aggregate({pairs}, 0D, (v, p) -> v + p))"


def tested(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` (column ``token``) that have an encoding, with ``encoding``, ``n``, ``random_p`` and ``ordinary_p``."""
    keep = tokens.columns
    rows = tokens.withColumn("encoding", _encoding(F.col("token"))).filter("encoding IS NOT NULL")
    same = F.when(F.col("encoding") == "hex", F.lower("token")).when(F.col("encoding") == "base64", F.translate("token", "-_", "+/")).otherwise(F.col("token"))
    rows = rows.withColumns({"t": same, "alphabet": _by(F.col("encoding"), lambda e: F.lit(ALPHABETS[e])), "n": F.char_length("token").cast("double")})
    rows = rows.withColumn("size", F.char_length("alphabet").cast("double"))
    rows = rows.withColumn("counts", F.expr("transform(sequence(1, cast(size AS int)), i -> n - char_length(replace(t, substring(alphabet, i, 1), '')))"))
    rows = rows.withColumns(
        {
            "mean": F.expr("aggregate(counts, struct(0D AS i, 0D AS s), (a, c) -> struct(a.i + 1 AS i, a.s + a.i * c AS s)).s / n"),
            "pairs": F.expr("aggregate(counts, 0D, (s, c) -> s + c * (c - 1) / 2)"),
            # symbols of the lower half become 0, those of the upper half 1
            "halves": F.expr("translate(t, alphabet, concat(repeat('0', cast(size / 2 AS int)), repeat('1', cast(size - cast(size / 2 AS int) AS int))))"),
            "blocks": F.expr(f"transform(regexp_extract_all(t, '.{{1,{BLOCK}}}', 0), b -> transform(filter(split(b, ''), c -> c <> ''), c -> cast(instr(alphabet, c) - 1 AS double)))"),
        }
    )
    rows = rows.withColumns(
        {
            "spread": F.expr("aggregate(counts, struct(0D AS i, 0D AS s), (a, c) -> struct(a.i + 1 AS i, a.s + c * (a.i - mean) * (a.i - mean) AS s)).s"),
            "ones": F.expr("char_length(replace(halves, '0', ''))"),
            "runs": F.expr("1 + (2 * n - char_length(replace(halves, '01', '')) - char_length(replace(halves, '10', ''))) / 2"),
            "near": F.expr(_lagged("blocks", 1)),
            "far": F.expr(_lagged("blocks", 2)),
        }
    )
    rows = rows.withColumns({"chi": F.expr("size / n * (2 * pairs + n) - n"), "runs_mean": F.expr("2 * ones * (n - ones) / n + 1")})
    runs_var = F.expr("(runs_mean - 1) * (runs_mean - 2) / (n - 1)")
    worst = F.sqrt("n")  # of symbols that are all alike
    z_chi = F.expr("(chi - (size - 1)) / sqrt(2 * (size - 1) * (1 - 1 / n))")
    z_runs = F.when(runs_var > 0, (F.col("runs") - F.col("runs_mean")) / F.sqrt(runs_var)).otherwise(worst)
    serial = lambda c: F.when(F.col("spread") > 0, (F.col(c) / F.col("spread") + 1 / F.col("n")) * F.sqrt("n")).otherwise(worst)
    half = (z_chi * z_chi + z_runs * z_runs + serial("near") * serial("near") + serial("far") * serial("far")) / 2
    meet, three = _by(F.col("encoding"), lambda e: F.lit(ORDINARY[e][0])), _by(F.col("encoding"), lambda e: F.lit(ORDINARY[e][1]))
    all_pairs = F.expr("n * (n - 1) / 2")
    variance = all_pairs * meet * (1 - meet) + F.expr("n * (n - 1) * (n - 2)") * (three - meet * meet)
    ordinary = _normal_tail((F.col("pairs") + 0.5 - all_pairs * meet) / F.sqrt(variance))
    return rows.select(*keep, "encoding", "n", (F.exp(-half) * (1 + half)).alias("random_p"), ordinary.alias("ordinary_p"))


def _group() -> Column:
    """Encoding and doubling of the length."""
    return F.concat("encoding", F.lit(":"), F.floor(F.log2("n")).cast("string"))


def levels(tested_tokens: DataFrame) -> dict[str, float]:
    """The Benjamini-Hochberg level of each group of encoding and length; groups without a discovery are left out.

    The rows that come to the driver are one per group: at most five encodings times the doublings of a token's length.
    """
    counted = [F.sum((F.col("random_p") >= RANDOM_P).cast("long") * (F.col("ordinary_p") <= t).cast("long")).alias(f"n{i}") for i, t in enumerate(LEVELS)]
    rows = tested_tokens.groupBy(_group().alias("group")).agg(F.count("*").alias("m"), *counted).collect()
    out = {}
    for r in rows:
        good = [t for i, t in enumerate(LEVELS) if r[f"n{i}"] and r["m"] * t <= FALSE_SHARE * r[f"n{i}"]]
        if good:
            out[r["group"]] = max(good)
    return out


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, the hash of their list, and the list of all spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    spans = {
        "assign": _spans(F.col("text"), ASSIGN, "assign", 12, value=ASSIGN),
        "access": _spans(F.col("text"), "AKIA[A-Z0-9]{14,}", "access", 18),
        "hex": _spans(F.col("text"), "[0-9a-f]{16,}", "hex", 16),
        "tokens": _spans(F.col("text"), f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}", "random", LEAST),
    }
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    found = rows.select("doc_id", *(c.alias(n) for n, c in spans.items()))
    base = F.array_sort(F.flatten(F.array(*(F.transform(n, bare) for n in ("assign", "access", "hex")))))
    tokens = F.expr("transform(filter(tokens, x -> x.found rlike '[0-9]' AND x.found rlike '[A-Za-z]'), x -> struct(x.start, x.end, rtrim('=', x.found) AS token))")
    counts = [F.size(n).cast("long").alias(f"n_{n}") for n in ("assign", "access", "hex")]
    # numbers of rows are written with them, so both readers of the table see the same ones
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *counts, base.alias("base"), tokens.alias("tokens")), "spans")
    single = found.select("row", F.explode("tokens").alias("x")).select("row", "x.start", "x.end", "x.token")
    single = written(tested(single).drop("token"), "token-tests")
    level = F.lit(None).cast("double")
    for group, t in sorted(levels(single).items()):
        level = F.when(_group() == group, t).otherwise(level)
    secret = single.filter((F.col("random_p") >= RANDOM_P) & (F.col("ordinary_p") <= level))
    span = F.struct(F.col("start"), F.lit(KINDS.index("random")).alias("kind"), F.col("end"))
    secret = secret.groupBy("row").agg(F.collect_list(span).alias("secrets"))  # those of one document
    out = found.drop("tokens").join(secret, "row", "left")
    added = F.expr("filter(coalesce(secrets, array()), s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end))")
    spans = F.array_sort(F.concat("base", added))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


@query("op12_randomness_battery_secrets")
def op12_randomness_battery_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document of the table."""
    return scanned(table(spark, folder, "documents"))
