"""Secret scans: fixed patterns, and a battery of randomness tests with error control.

Candidates are long runs of characters that encodings use. For each one the narrowest encoding
that explains it is inferred (hex digits, base 32, base 64), and three tests ask whether it
looks drawn at random from that alphabet: chi-squared uniformity of the characters, the number
of runs above and below the middle of the alphabet, and serial correlation of neighbours. The
smallest of the three p-values, corrected for being the smallest, is the candidate's p.

Ordinary strings pile up at small p, random ones spread evenly over 0 to 1. So per encoding and
length class the number of random ones is read off the upper half of the p-values, and the
threshold is the smallest p at which the share of ordinary strings among those above it stays
within the wanted false-discovery rate. Each distinct string counts once there, so copies of one
do not move the threshold of its class; the threshold then holds for all occurrences. Short strings give weak tests: in their classes the
ordinary ones reach higher p and the threshold moves up.

All of it is DataFrame functions. One pass reads the texts; only matches and the lengths between
them are kept. Positions are running sums over the matches of one text. The driver sees one
histogram row per (encoding, length class, p bin), a number fixed by the longest text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import stored, text_of

# The patterns of the base scan and the least lengths of a match that counts.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs of at least the least hex length; the same runs as HEX with shorter ones dropped.
HEX_LONG = r"[0-9a-f]{24,}"

LEAST_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
RATE = 0.05
BINS = 20
KINDS = ("assign", "access", "hex", "random")


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches, each with the length of the piece before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.transform(
        F.arrays_zip(found.alias("m"), between.alias("b")),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(z["b"]).alias("gap"), z["m"].alias("found")
        ),
    )


def matches(text: Column) -> Column:
    """Matches of every kind; the cheap tests in front drop no match."""
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,found:string>>")
    seen = {
        "assign": (text.contains(":") | text.contains("="), ASSIGN),
        "access": (text.contains("AKIA"), ACCESS),
        "hex": (text.rlike(HEX_LONG), HEX_LONG),
        "random": (text.rlike(CANDIDATE), CANDIDATE),
    }
    return F.concat(*[F.when(test, _matches(text, k, p)).otherwise(none) for k, (test, p) in seen.items()])


def _two_sided(z: Column) -> Column:
    """Two-sided normal p-value, to 1.2e-7 relative."""
    # Coefficients of the published rational Chebyshev fit of erfc.
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = F.lit(c) + t * poly
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def tested(rows: DataFrame) -> DataFrame:
    """Add ``encoding`` (null where none is inferred) and ``p`` to rows with ``found``.

    Uniformity: under random draws from k letters the statistic has mean k-1 and variance
    2(k-1)(1-1/n) at any length n. Runs: how often neighbours lie in different halves of the
    alphabet has mean (n-1)/2 and variance (n-1)/4. Correlation: the products of neighbours
    around the alphabet's middle have mean 0 and variance ((k^2-1)/12)^2 each, and are
    uncorrelated. Encodings need a digit beside a letter, base 64 both cases of letters.
    """
    s = F.col("found")
    digit = s.rlike("[0-9]")
    encoding = (
        F.when(digit & s.rlike("[a-fA-F]") & s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(s.rlike("^[A-Z2-7]+=*$") & digit & s.rlike("[A-Z]"), F.lit("base32"))
        .when(digit & s.rlike("[A-Z]") & s.rlike("[a-z]"), F.lit("base64"))
    )
    rows = rows.withColumn("encoding", F.when(F.col("kind") == "random", encoding))
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.col("encoding"))
    plain = F.translate(F.regexp_replace(s, "=+$", ""), "-_", "+/")
    plain = F.when(F.col("encoding") == "hex", F.lower(plain)).otherwise(plain)
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: (F.position(c, F.col("alphabet")) - 1).cast("double"))
    rows = rows.withColumn("alphabet", alphabet).withColumn("codes", F.when(F.col("encoding").isNotNull(), codes))
    k, n, half = F.col("k"), F.col("n"), F.col("k") / 2

    def count(a: Column, x: Column) -> Column:
        same = x == a["last"]
        run = F.when(same, a["run"] + 1).otherwise(F.lit(1.0))
        squares = a["squares"] + F.when(same, 2 * a["run"] + 1).otherwise(F.lit(1.0))
        return F.struct(x.alias("last"), run.alias("run"), squares.alias("squares"))

    def follow(a: Column, x: Column) -> Column:
        middle = (k - 1) / 2
        first = a["last"] < 0
        changed = F.when(~first & ((x < half) != (a["last"] < half)), 1.0).otherwise(0.0)
        product = F.when(first, 0.0).otherwise((x - middle) * (a["last"] - middle))
        return F.struct(x.alias("last"), (a["changes"] + changed).alias("changes"), (a["products"] + product).alias("products"))

    zero = F.lit(0.0)
    rows = rows.withColumns({"k": F.length("alphabet").cast("double"), "n": F.size("codes").cast("double")})
    rows = rows.withColumns(
        {
            "squares": F.aggregate(
                F.array_sort("codes"), F.struct(F.lit(-1.0).alias("last"), zero.alias("run"), zero.alias("squares")), count
            )["squares"],
            "order": F.aggregate(
                "codes", F.struct(F.lit(-1.0).alias("last"), zero.alias("changes"), zero.alias("products")), follow
            ),
        }
    )
    chi = k / n * F.col("squares") - n
    z = [
        (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)),
        (F.col("order.changes") - (n - 1) / 2) / F.sqrt((n - 1) / 4),
        F.col("order.products") / (F.sqrt(n - 1) * (k * k - 1) / 12),
    ]
    least = F.least(*[_two_sided(x) for x in z])
    p = F.lit(1.0) - F.pow(F.lit(1.0) - least, len(z))
    return rows.withColumn("p", F.when(F.col("encoding").isNotNull(), p)).drop("alphabet", "codes", "k", "n", "squares", "order")


def _class() -> Column:
    return F.concat_ws(":", F.col("encoding"), F.floor(F.log2(F.length("found"))).cast("string"))


def thresholds(histogram: dict[str, dict[int, int]], rate: float = RATE) -> dict[str, float]:
    """Per class the smallest p above which at most ``rate`` of the strings are ordinary."""
    out = {}
    for name, bins in histogram.items():
        above = [sum(c for b, c in bins.items() if b >= t) for t in range(BINS + 1)]
        spread = above[BINS // 2] / 0.5  # random ones, from the half that ordinary ones do not reach
        for t in range(BINS):
            false = max(0.0, above[t] - spread * (1 - t / BINS))
            if above[t] and false <= rate * above[t]:
                out[name] = t / BINS
                break
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row: key and ``spans``, an array of (start, rank, end, kind) by start, then kind.

    Positions count code points, ends are exclusive. Null and empty texts have no spans. Texts of
    any length are scanned whole. Repeated rows each have their own result, a null identifier
    stays null. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), matches(text_of(text)).alias("hits"))
    rows = stored(rows, "secret-matches")
    each = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    along = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(along))
    long = F.length("found")
    counts = (
        F.when(F.col("kind") == "assign", F.length(F.regexp_extract("found", ASSIGN, 2)) >= LEAST["assign"])
        .when(F.col("kind") == "access", long >= LEAST["access"])
        .otherwise(F.lit(True))
    )
    each = stored(tested(each.where(counts)).where("kind <> 'random' OR p IS NOT NULL"), "secret-tests")
    distinct = each.where(F.col("kind") == "random").select(
        _class().alias("class"), F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin"), F.sha2("found", 256).alias("string")
    ).distinct()
    histogram: dict[str, dict[int, int]] = {}
    for r in distinct.groupBy("class", "bin").count().collect():  # classes times bins
        histogram.setdefault(r["class"], {})[r["bin"]] = r["count"]
    limits = thresholds(histogram, rate)
    if limits:
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), _class())
        each = each.where((F.col("kind") != "random") | (F.col("p") >= limit))
    else:
        each = each.where(F.col("kind") != "random")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(
        (F.col("end") - F.length("found")).alias("start"), rank.alias("rank"), F.col("end"), F.col("kind")
    )
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # spans of one text
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", key).join(spans, "row", "left").select(key, F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


