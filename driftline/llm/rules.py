"""Quality rules with risk-controlled thresholds, with built-in functions only.

Method: a rule rejects a document where a ratio exceeds a cutoff. On labelled
holdouts, for each stratum (texts of similar length), each ratio and each cutoff
of a fixed grid, the good documents that the cutoff would reject are counted. A
cutoff is admissible if, by the exact binomial tail, a false rejection rate above
ALPHA / number of ratios would show so few rejections with a probability of at
most DELTA / number of tests (Bonferroni over strata, ratios and cutoffs). Each
stratum takes the lowest admissible cutoff of each ratio, or none. So, with a
probability of 1 - DELTA, no stratum loses more than ALPHA of its good documents.

Only counts come to the driver: strata x ratios x cutoffs of them.

Cases: a null or empty text has no words and fails the base rule; without labels
no ratio has a cutoff and the base rule decides alone; repeated rows each get
their verdict (and each count as a holdout); other columns are kept.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import checkpoint, held_out, table

ALPHA, DELTA = 0.05, 0.05
#: Upper ends, in words, of all strata but the last.
STRATA = (100, 300, 1000)
RATIOS = ("symbols", "upper", "dup_lines", "repeats", "word_chars")
GRID = {
    "symbols": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "upper": [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "dup_lines": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeats": [0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.22, 0.25, 0.28],
    "word_chars": [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0],
}
WINDOW = 8


def pairs(hashes: str, step: int) -> Column:
    """Each hash with the one `step` behind it; the last ones, with none behind them, are to be cut off."""
    return F.zip_with(F.col(hashes), F.slice(F.col(hashes), step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def covered(order: str) -> Column:
    """Words covered by windows found more than once. order: the name of a column of sorted (hash, position) structs."""
    o, none = F.col(order), F.array(F.lit(None).cast("bigint"))
    h = F.transform(o, lambda x: x["h"])
    before = F.concat(none, F.slice(h, 1, F.size(o) - 1))
    behind = F.concat(F.slice(h, 2, F.size(o)), none)
    twice = F.zip_with(F.zip_with(o, before, lambda x, b: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["h"].eqNullSafe(b).alias("t"))), behind, lambda x, b: F.when(x["t"] | x["h"].eqNullSafe(b), x["i"]))
    at = F.array_sort(F.array_compact(twice))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """The rows of docs without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
    kept = [c for c in docs.columns if c != "text" and c not in made]
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda cls: F.length(F.regexp_replace("__t", f"[^{cls}]+", ""))
    one = docs.select(*kept, text.alias("__t"), F.array_remove(F.split(text, r"\s+"), "").alias("__w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")).alias("__l"))
    # Each step's arrays are columns that the next step names more than once; inside a lambda an expression would be evaluated for each element.
    hashed = one.withColumn("__wh", F.transform("__w", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of 2, 4 and then WINDOW words
        hashed = hashed.withColumn("__wh", pairs("__wh", step))
    two = hashed.withColumn("__h", F.slice("__wh", 1, F.greatest(F.size("__wh") - (WINDOW - 1), F.lit(0)))).withColumn("__u", F.size(F.array_distinct("__h")) < F.size("__h"))
    two = two.withColumn("__o", F.when(F.col("__u"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return two.select(
        *kept, F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), count(r"#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.when(F.col("__u"), covered("__o")).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"), count("A-Z").cast("long").alias("n_upper"),
    )


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": over("n_symbols", "word_chars"), "upper": over("n_upper", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "word_chars": over("word_chars", "n_words")}


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") <= STRATA[k], k).otherwise(out)
    return out


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly."""
    return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1))


def controlled(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether k of n rejections show, at level delta, a rate of at most alpha."""
    return k < n * alpha and tail(k, n, alpha) <= delta


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """(stratum, ratio) -> cutoff, from the statistics of good documents."""
    tests = (len(STRATA) + 1) * sum(map(len, GRID.values()))
    value = ratios()
    sums = [F.sum((value[r] > c).cast("long")).alias(f"{r}{i}") for r in RATIOS for i, c in enumerate(GRID[r])]
    found = {}
    for row in good.withColumn("stratum", stratum()).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row for each stratum
        for r in RATIOS:
            ok = [c for i, c in enumerate(GRID[r]) if controlled(row[f"{r}{i}"], row["n"], alpha / len(RATIOS), delta / tests)]
            if ok:
                found[row["stratum"], r] = min(ok)
    return found


def verdicts(statistics: DataFrame, cut: dict[tuple[int, str], float]) -> DataFrame:
    """statistics with base_failed and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    value, bad = ratios(), F.lit(False)
    for (s, r), c in sorted(cut.items()):
        bad = bad | ((F.col("__s") == s) & (value[r] > c))
    out = statistics.withColumn("__s", stratum()).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("__s")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = checkpoint(text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    out = verdicts(statistics, cutoffs(statistics.join(labels, "doc_id", "left_semi")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
