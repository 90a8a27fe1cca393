"""URL filter: the ratio of two character Markov models of variable order.

Rules (host and path prefixes) decide the URLs that they fit.  Those decisions are
also what the models learn from: one model of the URLs that rules allow, one of
those that they block.  A model gives each character a probability after the up to
``ORDER - 1`` characters before it; Witten-Bell smoothing mixes every context length
with the next shorter one.  A URL's score is the mean over its characters of the log
of the models' ratio.  A hashed quarter of the decided URLs takes no part in the
counts; on it the threshold is set where the mean of the two classes' accuracies is
highest.

Host and path are modelled as they are, each character a symbol of its own.  The
n-grams' table is sent to where the URLs are if it is small; otherwise URLs' n-grams
are joined by a shuffle, in which each n-gram is dealt out to ``SALTS`` keys, as the
first few characters are alike in most URLs.  Everything is DataFrame code; ``html``
is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import by_place, cut, place

ORDER = 5
#: Rows of the n-gram table that are broadcast, at most; about 60 MB.
BROADCAST_GRAMS = 1_000_000
SALTS = 16
#: What stands before a URL, ORDER - 1 times, and after it; no URL has them.
START, END = "\x02", "\x03"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    start = F.locate("://", url)
    rest = F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as struct(verdict, rule); null for none.

    A rule fits its host and all subdomains if the path starts with the rule's.  The rules
    are part of the plan: meant for up to some thousands.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def spelling() -> Column:
    """Host and path with marks for start and end."""
    return F.concat(F.lit(START * (ORDER - 1)), "host", "path", F.lit(END))


def grams(rows: DataFrame) -> DataFrame:
    """``rows`` with ``gram`` instead of ``spelt``, one row for each character.

    The characters are laid out once, in a projection of their own, so that a long URL costs
    no more for each character than a short one.
    """
    rows = rows.withColumn("chars", F.split("spelt", "")).drop("spelt")
    gram = lambda i: F.concat(*[F.get("chars", i + k) for k in range(ORDER)])
    return rows.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(0), F.size("chars") - ORDER), gram))).drop("chars")


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): the log of the models' ratio for the last character of each n-gram.

    ``counts``: gram, and how often the URLs allowed and blocked have it, zeros included.
    Every shorter n-gram is an ending of some of these, so sums over them are its counts.
    The shortest context is mixed with equal chances for all characters that URLs have.
    """
    lower: DataFrame | None = None
    kinds = counts.select(F.substring("gram", ORDER, 1)).distinct().count()
    for n in range(1, ORDER + 1):
        here = counts.groupBy(F.substring("gram", ORDER - n + 1, n).alias("gram")).agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
        context = Window.partitionBy(F.substring("gram", 1, n - 1))
        for c in ("allowed", "blocked"):
            here = here.withColumn(f"{c}_all", F.sum(c).over(context)).withColumn(f"{c}_kinds", F.sum((F.col(c) > 0).cast("long")).over(context))
        if lower is None:
            chances = [(F.col(c) + 1.0) / (F.col(f"{c}_all") + float(kinds)) for c in ("allowed", "blocked")]
        else:
            here = here.withColumn("ending", F.substring("gram", 2, n - 1)).join(lower, "ending")
            chances = [F.when(F.col(f"{c}_all") == 0, F.col(f"p_{c}")).otherwise((F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))) for c in ("allowed", "blocked")]
        lower = here.select(F.col("gram").alias("ending"), chances[0].alias("p_allowed"), chances[1].alias("p_blocked"))
    return lower.select(F.col("ending").alias("gram"), (F.log("p_allowed") - F.log("p_blocked")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score from which on URLs are allowed, from scored rows with ``allow`` (true or false).  Without both classes: 0.

    Scores are counted in hundredths.  Of the gaps between counted ones, that with the best
    balanced accuracy is cut in its middle; of equals the lowest.
    """
    bins = scored.groupBy(F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100))).cast("int").alias("bin")).agg(F.sum(F.col("allow").cast("long")).alias("a"), F.sum((~F.col("allow")).cast("long")).alias("b"))
    everything, up = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    gain = F.coalesce(F.sum("b").over(below), F.lit(0)) / F.sum("b").over(everything) - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(everything)
    middle = (F.col("bin") + F.coalesce(F.lag("bin").over(up), F.col("bin"))) / 200
    best = bins.select("bin", F.round(F.when((F.sum("a").over(everything) > 0) & (F.sum("b").over(everything) > 0), gain), 9).alias("gain"), middle.alias("middle")).orderBy(F.col("gain").desc_nulls_last(), "bin").first()
    return best["middle"] if best and best["gain"] is not None else 0.0


def judged(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of ``pages``, host, path, rule, verdict and score: one row for each row of ``pages``.

    A URL that is null or has no ``://`` has empty host and path and is judged by its score,
    like all that no rule fits.  Where rules decide no URL, or all alike, the threshold is 0
    and scores lean on what was counted.  Repeated rows count as often as they come.  URLs
    are read whole, however long.  A ``keep`` column that is named like a result is left out;
    other columns don't matter, and of columns with equal names the first is meant.
    """
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict", "score"))
    host, path = parts(F.col(place(pages, url_col)))
    kept = F.struct(*[F.col(place(pages, c)).alias(f"k{k}") for k, c in enumerate(keep)]) if keep else F.lit(0)
    tested = F.col("found").isNotNull() & (F.substring(F.md5(F.concat("host", "path")), 1, 1) < "4")
    decided = F.col("found.verdict") == "allow"
    rows = by_place(pages).select(kept.alias("kept"), host.alias("host"), path.alias("path")).withColumn("found", fitting(rules)).withColumn("tested", tested)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    # What is laid out character by character has no column that is as long as the URL.
    counted = lambda yes: F.coalesce((decided == yes) & ~F.col("tested"), F.lit(False)).cast("long")
    flags = rows.select(spelling().alias("spelt"), counted(True).alias("a"), counted(False).alias("b"))
    counts = cut(grams(flags).groupBy("gram").agg(F.sum("a").alias("allowed"), F.sum("b").alias("blocked")))
    table = cut(ratios(counts).withColumn("ratio", F.round("ratio", 6).cast("decimal(18,6)")))
    spread = grams(rows.select("row", spelling().alias("spelt")))
    if table.count() <= BROADCAST_GRAMS:
        found = spread.join(F.broadcast(table), "gram")
    else:
        salts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = spread.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salts, ["gram", "salt"])
    # Sums of decimals don't depend on the order of rows, so a rerun gives the same score.
    scores = found.groupBy("row").agg(F.round(F.sum("ratio").cast("double") / F.count("*"), 9).alias("score"))
    scored = cut(rows.join(scores, "row"))
    least = threshold(scored.where("tested").select("score", decided.alias("allow")))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= least, "allow").otherwise("block"))
    return scored.select(*[F.col(f"kept.k{k}").alias(c) for k, c in enumerate(keep)], "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
