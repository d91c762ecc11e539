"""Personal data by boosted trees over proposed spans, with built-in functions only.

Method: generators of high recall propose spans that may overlap: the four base
formats without their checks, digit groups without a plus sign, long runs of
letters and digits, and addresses with `at` spelled out. Each span has format
features (length, share of digits, case, groups) and context features (a naming
word before it, quotes and signs around it), all in few bins. The distinct
feature rows with their counts, a bounded table of at most the product of the
bins, are what gradient boosting of depth-2 trees is trained on. Labels are
weak: a span that passes a base format's checks, or that a naming word
announces, is private; the features that decide a span's label are not inputs
for its generator. Documents of one hash fold calibrate: a generator's threshold
is the lowest score from which on at least PRECISION of the fold's spans by this
generator are private; one without such a score adds nothing. The trees are applied as column expressions.

Spans that pass the base checks always stay; spans that the trees add overlap
none of them, and the higher score wins among those that overlap each other: by
falling score, a span is added unless it overlaps one that is.

Cases: a null or empty text has no spans; offsets count code points; repeated
rows each get the same result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import checkpoint, held_out, keyed, table

#: Base formats. Each run of letters or digits is tried once, at its start or where the last match ended.
LOCAL = "A-Za-z0-9._%+-"
GENERATORS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "spelled": rf"(?<![{LOCAL}])[{LOCAL}]++ ?(?:\[at\]|\(at\)|\{{at\}}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++",
    "grouped": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+",
}
BASE = ("email", "ip", "card", "phone")
#: Kind of the spans that a generator adds.
KIND = {"spelled": "email", "grouped": "phone", "secret": "secret"}
KINDS = (*BASE, "secret")
#: What must occur in a text for the generator to be tried.
SIGNS = {"email": "@", "phone": "+", "spelled": "at"}
NAMED = r"(?i)(?:token|secret|password|passwd|api.?key|key|auth|bearer|credential|phone|tel|call|mobile|fax|mail|contact|card|visa|ip|host)\W{1,6}$"
IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
FEATURES = ("generator", "length", "digits", "case", "hex", "groups", "quoted", "named", "edge")
#: Features that decide a generator's weak label, and so are no inputs for it.
PRECISION, TREES, RATE = 0.95, 30, 0.3


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.try_element_at(F.array(*(F.lit(k) for k in range(10)), *(F.lit(k) for k in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1 + 10 * (i % 2)))
    return F.aggregate(F.array_compact(each), F.lit(0), lambda a, x: a + x) % 10 == 0


def numbered(spans: Column, generator: int) -> Column:
    return F.transform(spans, lambda x, i: F.struct(F.lit(generator).alias("gen"), i.alias("i"), x["gap"].alias("gap"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, th, gen, m, before, after, start, end: all proposed spans, and a row with null gen for each document."""
    df, lists = docs, []
    for k, (name, pattern) in enumerate(GENERATORS.items()):
        text = F.when(F.col("text").contains(SIGNS[name]), F.col("text")) if name in SIGNS else F.when(F.col("text").rlike("[0-9]"), F.col("text"))
        df = df.withColumn(f"m{k}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        some = F.size(f"m{k}") > 0
        df = df.withColumn(f"g{k}", F.when(some, F.split("text", pattern, -1)))
        here = F.zip_with(F.slice(f"g{k}", 1, F.size(f"m{k}")), f"m{k}", lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"), F.right(g, F.lit(24)).alias("before")))
        here = F.zip_with(here, F.slice(f"g{k}", 2, F.size(f"m{k}")), lambda x, g: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), x["before"].alias("before"), F.left(g, F.lit(1)).alias("after")))
        lists.append(F.when(some, numbered(here, k)))
    kind = "array<struct<gen:int,i:int,gap:int,m:string,before:string,after:string>>"
    none = F.array(F.lit(None).cast(kind[6:-1]))
    rows = df.select("doc_id", "th", F.explode(F.concat(none.cast(kind), *(F.coalesce(x.cast(kind), F.array().cast(kind)) for x in lists))).alias("x")).select("doc_id", "th", "x.*")
    w = W.partitionBy("doc_id", "th", "gen").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")).drop("gap", "i")


def described(spans: DataFrame) -> DataFrame:
    """spans with base (whether it passes a base format's checks), weak (its label) and the binned features."""
    names = list(GENERATORS)
    of = lambda name: F.col("gen") == names.index(name)
    digits = F.regexp_replace("m", "[^0-9]", "")
    n, size = F.length(digits), F.length("m")
    base = of("email") | (of("ip") & F.col("m").rlike(IP)) | (of("card") & luhn(digits)) | (of("phone") & n.between(9, 15))
    named = F.col("before").rlike(NAMED)
    bins = lambda x, *cuts: sum(((x > c).cast("int") for c in cuts), F.lit(0))
    shape = F.when(F.col("m").rlike("[a-z]") & F.col("m").rlike("[A-Z]"), 2).when(F.col("m").rlike("[A-Z]"), 1).otherwise(0)
    features = {
        "generator": F.col("gen"), "length": bins(size, 11, 15, 19, 31, 39, 64), "digits": bins(n / size, 0.0, 0.15, 0.45, 0.8, 0.99), "case": shape,
        "hex": F.col("m").rlike("^[0-9a-f]+$").cast("int"), "groups": bins(F.length(F.regexp_replace("m", "[A-Za-z0-9]", "")), 0, 1, 3),
        "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("int"), "named": F.when(F.col("gen") < names.index("spelled"), named.cast("int")).otherwise(0), "edge": F.col("before").rlike("[=:] ?[\"'`]?$").cast("int"),
    }
    weak = F.when(F.col("gen") < len(BASE), base).when(of("secret"), named & F.col("m").rlike("[0-9]")).when(of("grouped"), named).otherwise(True)
    return spans.withColumns({"base": F.coalesce(base, F.lit(False)), "weak": F.coalesce(weak, F.lit(False))} | {f"f_{k}": v for k, v in features.items()})


Tree = tuple


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[Tree]:
    """Trees of depth 2 on binned rows with private counts y of w: (feature, cut, left, right), leaves are numbers."""
    score, trees = np.zeros(len(x)), []

    def grow(rows: np.ndarray, depth: int) -> Tree | float:
        g, h = (y - w * p)[rows], (w * p * (1 - p))[rows]
        best, at = 1e-6, None
        for f in range(x.shape[1] if depth else 0):
            for cut in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= cut
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best:
                    best, at = gain, (f, int(cut))
        if at is None:
            return float(RATE * g.sum() / (h.sum() + 1))
        left = x[rows, at[0]] <= at[1]
        return (*at, grow(rows[left], depth - 1), grow(rows[~left], depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(x)), 2))
        score += evaluated(trees[-1], x)
    return trees


def evaluated(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] <= cut, evaluated(a, x), evaluated(b, x))


def expression(tree: Tree | float) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, a, b = tree
    return F.when(F.col(f"f_{FEATURES[f]}") <= cut, expression(a)).otherwise(expression(b))


def trained(spans: DataFrame) -> tuple[list[Tree], dict[int, float]]:
    """Trees, and for each generator that adds spans the threshold of the sum of their leaves, from described spans."""
    fold = held_out(F.col("doc_id"))
    cells = spans.where(F.col("gen").isNotNull()).groupBy(fold.alias("fold"), *(f"f_{f}" for f in FEATURES)).agg(F.count(F.lit(1)).alias("w"), F.sum(F.col("weak").cast("int")).alias("y"))
    rows = cells.collect()  # at most a row for each combination of bins
    x = np.array([[r[f"f_{f}"] or 0 for f in FEATURES] for r in rows], np.int64).reshape(-1, len(FEATURES))
    y, w, apart = (np.array([r[c] for r in rows], float) for c in ("y", "w", "fold"))
    fit, check = apart == 0, apart == 1
    if not y[fit].any():
        return [], {}
    trees = boost(x[fit], y[fit], w[fit])
    return trees, {g: calibrated(sum(evaluated(t, x[own]) for t in trees), y[own], w[own]) for g in range(len(BASE), len(GENERATORS)) for own in [check & (x[:, 0] == g)]}


def calibrated(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The lowest score from which on at least PRECISION of the spans (w, of which y are private) are private; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    private, every, falls = np.cumsum(y[order]), np.cumsum(w[order]), np.append(np.diff(score[order]) < 0, True)[: len(order)]
    ok = np.flatnonzero((private >= PRECISION * every) & falls)
    return float(score[order][ok[-1]]) - 1e-9 if len(ok) else np.inf


def find(docs: DataFrame) -> DataFrame:
    """doc_id, found: for each row of docs its spans as structs (kind, start, end, base, score), in order.

    docs: doc_id, text.
    """
    own = keyed(docs)
    copies = own.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
    repeated = not copies.where("copies > 1").isEmpty()
    spans = checkpoint(described(proposals(own.dropDuplicates(["doc_id", "th"]) if repeated else own)).drop("m", "before", "after"))
    trees, thresholds = trained(spans)
    score = sum((expression(t) for t in trees), F.lit(0.0))
    names = list(GENERATORS)
    kind = F.lit(len(KINDS) - 1)
    for i, name in enumerate(names):
        kind = F.when(F.col("gen") == i, KINDS.index(KIND.get(name, name))).otherwise(kind)
    added = F.lit(False)
    for g, threshold in thresholds.items():
        added = added | ((F.col("gen") == g) & (score >= threshold))
    span = F.struct(kind.alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("base").alias("base"), score.alias("score"))
    # What meets a base span goes: one that began before and reaches over, or one that begins inside. Both are running
    # values over the spans in order, as is where a run of spans that meet begins; only inside a run are they compared.
    text = W.partitionBy("doc_id", "th")
    rows = spans.select("doc_id", "th", F.col("start").alias("a"), F.col("end").alias("z"), "base", (added & ~F.col("base")).alias("more"), span.alias("span"))
    reach = F.max(F.when(F.col("base"), F.col("z"))).over(text.orderBy("a").rangeBetween(W.unboundedPreceding, W.currentRow))
    follows = F.min(F.when(F.col("base"), F.col("a"))).over(text.orderBy(F.desc("a")).rangeBetween(W.unboundedPreceding, W.currentRow))
    blocked = F.coalesce(reach > F.col("a"), F.lit(False)) | F.coalesce(follows < F.col("z"), F.lit(False))
    rows = rows.withColumn("free", F.coalesce(F.col("more"), F.lit(False)) & ~blocked)
    in_order = text.orderBy("a", "z", "span.k")
    before = F.max(F.when(F.col("free"), F.col("z"))).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.col("free") & F.coalesce(F.col("a") >= before, F.lit(True)))
    rows = rows.withColumn("run", F.when(F.col("free"), F.sum(F.col("opens").cast("long")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))).otherwise(0))
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    runs = rows.groupBy("doc_id", "th", "run").agg(F.collect_list(F.when(F.col("base"), F.col("span"))).alias("sure"), F.collect_list(F.when(F.col("free"), F.col("span"))).alias("ones"))
    ranked = F.array_sort(F.transform("ones", lambda a: F.struct((-a["score"]).alias("rank"), a["start"].alias("start"), a["k"].alias("k"), a["end"].alias("end"), a.alias("span"))))
    runs = runs.withColumn("ranked", F.when(F.size("ones") > 1, ranked))
    greedy = F.aggregate("ranked", F.slice("ones", 1, 0), lambda taken, a: F.when(F.exists(taken, lambda b: meet(a, b)), taken).otherwise(F.concat(taken, F.array(a["span"]))))
    runs = runs.withColumn("kept", F.concat("sure", F.when(F.col("ranked").isNotNull(), greedy).otherwise(F.col("ones"))))
    out = runs.groupBy("doc_id", "th").agg(F.array_sort(F.flatten(F.collect_list("kept"))).alias("found"))
    if repeated:
        out = own.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).join(out, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    named = F.transform("found", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    return out.select("doc_id", named.alias("found"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["base"])
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", label), ",").alias("spans"))
