"""Quality rules and robust multivariate outliers, in DataFrame functions alone.

Each document gets counts of words, symbols, repeated lines and repeated three-word windows, and a vector of
five transformed statistics: the logarithm of the mean word length, and square roots of the shares of
symbols, repeated lines, repeated words and capitals. Per language and source the minimum covariance
determinant estimate gives a centre and a scatter that junk doesn't move, and a document is rejected
whose squared Mahalanobis distance passes the chi-square point ``CUTOFF``.

The estimate starts from coordinate medians and median deviations and takes concentration steps: moments of
the ``SUBSET`` share of a group's rows with the least distances, until determinants settle; a last step
takes all rows within the 97.5 % point. Distances and medians are ranked in fine bins, so a step is
one scan and one combined aggregation into a bounded table (groups x bins), whatever the size of a group; a
source with a third of all rows is like any other. Each scatter gets the square of ``FLOORS`` added, the
resolution below which differences don't matter (a group may have no symbols at all).

Groups with fewer than ``MIN_ROWS`` rows are judged by the estimate of all rows of their language, and those of a language
with fewer by that of all rows. Rows that fail the base rules don't
enter the estimates. Defined cases: a null or empty text has no words and fails the base rules; null
languages and sources are groups of their own; repeated rows count each; an empty table gives an empty
result. Extra columns pass through unless they are named like the added ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.arrays import bind
from mailsieve.operators.durable import durable

# What separates words, and what counts as a symbol.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FLOORS = (0.08, 0.05, 0.15, 0.15, 0.04)
DIMS = len(FLOORS)
SUBSET, MIN_ROWS, STEPS, SETTLED = 0.6, 50, 8, 1e-3
CUTOFF, REWEIGHT = 1 - 1e-5, 0.975
#: Bins to a unit of ln(1 + squared distance), and to a floor in the start's medians.
DISTANCE_BINS, VALUE_BINS = 64, 8
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def chi_square(x: float, d: int) -> float:
    """Probability that a chi-square variable of ``d`` degrees is at most ``x``."""
    a, half = d / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= half / (a + k)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if half > 0 else 0.0


def chi_square_point(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return low


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the list, the first ones included."""

    def covered(places: Column) -> Column:
        gap = lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, x: a + x)

    def repeated(sorted_: Column) -> Column:
        same = lambda x, k, step: F.coalesce(F.get(sorted_, k + step)["h"] == x["h"], F.lit(False))
        # get(-1) is null, so the first window has no neighbour before it.
        found = F.filter(sorted_, lambda x, k: same(x, k, 1) | (same(x, k, -1) & (k > 0)))
        return bind(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def judge(h: Column) -> Column:
            pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            # Most texts repeat no window; only the others sort theirs.
            return F.when(F.size(F.array_distinct(h)) < F.size(h), bind(F.sort_array(pairs), repeated)).otherwise(0)

        return F.when(F.size(w) >= 3, bind(hashes, judge)).otherwise(0)

    return bind(words, windows)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text but with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    and the share of capitals."""
    body = F.coalesce(F.col(text), F.lit(""))
    inked = f"[^{SPACE[1:-1]}]"
    words = F.filter(F.split(body, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(inked))
    letters = F.char_length(F.regexp_replace(body, f"{SPACE}+", ""))
    added = {
        "n_words": bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))),
        "word_chars": letters.cast("long"),
        "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
        "n_capitals": F.char_length(F.regexp_replace(body, r"[^\p{Lu}]+", "")),
    }
    keep = [c for c in docs.columns if c not in (text, *added, "n_lines", "n_repeat_words", "base_failed")]
    counted = docs.select(*keep, *(v.alias(k) for k, v in added.items()))
    flat = counted.select(
        *keep, F.col("n_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("n_dup_lines.d").alias("n_dup_lines"),
        F.col("n_words.r").alias("n_repeat_words"), F.col("n_dup_lines.n").alias("n_lines"), "n_capitals",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return flat.withColumn("base_failed", failed)


def vectors() -> list[Column]:
    """The five transformed statistics of a counted document."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log(F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_capitals", "word_chars"),
    ]


def _middle(counts: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """The weighted median bin of each group of a binned table."""
    order = Window.partitionBy(*by).orderBy(value)
    running = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return running.where(2 * F.col("upto") >= F.col("all")).groupBy(*by).agg(F.min(value).alias(out))


def _start(rows: DataFrame) -> DataFrame:
    """(grp, c0.., m00..): medians as centres, inverse median deviations on the diagonal of the transform."""
    cells = F.array(*(F.struct(F.lit(i).alias("dim"), F.round(F.col(f"x{i}") * (VALUE_BINS / f)).cast("int").alias("bin")) for i, f in enumerate(FLOORS)))
    # Bounded: groups x dimensions x bins; shares end at 1 and a logarithm of a word length at about 22.
    bins = durable(rows.select("grp", F.explode(cells).alias("c")).groupBy("grp", "c.dim", "c.bin").agg(F.count(F.lit(1)).alias("n")), "value-bins")
    centre = durable(_middle(bins, ["grp", "dim"], "bin", "mid"), "medians")
    apart = bins.join(centre, ["grp", "dim"]).withColumn("off", F.abs(F.col("bin") - F.col("mid"))).groupBy("grp", "dim", "off").agg(F.sum("n").alias("n"))
    both = centre.join(_middle(apart, ["grp", "dim"], "off", "dev"), ["grp", "dim"])
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, F.col(c)))
    columns = []
    for i, f in enumerate(FLOORS):
        spread = F.greatest(pick(i, "dev") * (1.4826 * f / VALUE_BINS), F.lit(f))
        columns += [(pick(i, "mid") * (f / VALUE_BINS)).alias(f"c{i}"), (1 / spread).alias(f"m{i}{i}")]
        columns += [F.lit(0.0).alias(f"m{i}{j}") for j in range(i)]
    return both.groupBy("grp").agg(*columns)


def distance() -> Column:
    """Squared Mahalanobis distance of x from c under the transform m (a lower triangle)."""
    rows = [sum((F.col(f"m{i}{j}") * (F.col(f"x{j}") - F.col(f"c{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(DIMS)]
    return sum((r * r for r in rows), F.lit(0.0))


def _moments(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Counts and sums of products per group and distance bin, bounded by groups x bins."""
    near = rows.join(fitted, "grp").withColumn("d2", distance()).withColumn("bin", F.floor(F.log1p("d2") * DISTANCE_BINS).cast("int"))
    sums = [F.sum(F.col(f"x{i}")).alias(f"s{i}") for i in range(DIMS)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    return near.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)


def _transform(sums: DataFrame, factor: float) -> DataFrame:
    """(grp, c.., m.., log_det) from counts and sums: the inverse Cholesky factor of the scatter."""
    df = sums
    for i in range(DIMS):
        df = df.withColumn(f"c{i}", F.col(f"s{i}") / F.col("n"))
    spread = {(i, j): (F.col(f"s{i}{j}") / F.col("n") - F.col(f"c{i}") * F.col(f"c{j}")) * factor for i, j in PAIRS}
    df = df.select("grp", "n", *(f"c{i}" for i in range(DIMS)), *(
        (F.greatest(v, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else v).alias(f"v{i}{j}") for (i, j), v in spread.items()
    ))
    for j in range(DIMS):
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1e-12))))
        for i in range(j + 1, DIMS):
            rest = F.col(f"v{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    for i in range(DIMS):
        for j in range(i):
            part = sum((F.col(f"l{i}{k}") * F.col(f"m{k}{j}") for k in range(j, i)), F.lit(0.0))
            df = df.withColumn(f"m{i}{j}", -part / F.col(f"l{i}{i}"))
        df = df.withColumn(f"m{i}{i}", 1 / F.col(f"l{i}{i}"))
    log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(DIMS)), F.lit(0.0))
    return df.select("grp", *(f"c{i}" for i in range(DIMS)), *(f"m{i}{j}" for i, j in PAIRS), log_det.alias("log_det"))


def _total(binned: DataFrame) -> DataFrame:
    names = [f"s{i}" for i in range(DIMS)] + [f"s{i}{j}" for i, j in PAIRS]
    return binned.groupBy("grp").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


def fit_groups(rows: DataFrame) -> DataFrame:
    """(grp, c.., m.., log_det) for a written table (grp, x0..x4)."""
    fitted = durable(_start(rows), "centres")
    factor = SUBSET / chi_square(chi_square_point(SUBSET, DIMS), DIMS + 2)
    order = Window.partitionBy("grp").orderBy("bin")
    last = None
    for _ in range(STEPS):
        binned = _moments(rows, fitted).withColumn("before", F.sum("n").over(order) - F.col("n"))
        binned = binned.withColumn("all", F.sum("n").over(Window.partitionBy("grp")))
        fitted = durable(_transform(_total(binned.where(F.col("before") < F.ceil(F.col("all") * SUBSET))), factor), "centres")
        # Every group settles on its own; the steps end when none of them moves any more.
        now = fitted.select("grp", "log_det")
        if last is not None and now.join(last, "grp").where(F.abs(F.col("log_det") - F.col("last_det")) > SETTLED).isEmpty():
            break
        last = now.withColumnRenamed("log_det", "last_det")
    inside = math.floor(math.log1p(chi_square_point(REWEIGHT, DIMS)) * DISTANCE_BINS)
    share = REWEIGHT / chi_square(chi_square_point(REWEIGHT, DIMS), DIMS + 2)
    return durable(_transform(_total(_moments(rows, fitted).where(F.col("bin") < inside)), share), "centres")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the text, with the base counts, base_failed, distance (squared) and kept."""
    names = [f"x{i}" for i in range(DIMS)]
    own = {"pair", "grp", "distance", "kept", "n_capitals", *names, *(f"c{i}" for i in range(DIMS)), *(f"m{i}{j}" for i, j in PAIRS)}
    counted = base_counts(docs.drop(*(c for c in docs.columns if c in own and c not in (text, lang, source))), text)
    pair = F.concat_ws("\x1f", F.coalesce(F.col(lang).cast("string"), F.lit("\x00")), F.coalesce(F.col(source).cast("string"), F.lit("\x00")))
    counted = durable(counted.withColumns(dict(zip(names, vectors()))).withColumn("pair", pair), "quality")
    sizes = counted.where("NOT base_failed").groupBy("pair").count()
    of_lang, of_all = F.concat(F.substring_index("pair", "\x1f", 1), F.lit("\x1f\x01")), F.lit("\x1f\x02")
    in_lang = F.sum("count").over(Window.partitionBy(of_lang))
    used = F.when(F.col("count") >= MIN_ROWS, F.col("pair")).when(in_lang >= MIN_ROWS, of_lang).otherwise(of_all)
    groups = durable(sizes.select("pair", used.alias("grp")), "groups")
    # A row enters its own group and the wider ones that some group is judged by.
    feeds = groups.select("pair", F.explode(F.array(F.col("pair"), of_lang, of_all)).alias("grp")).join(groups.select("grp").distinct(), "grp", "left_semi")
    feeds = durable(feeds, "feeds")
    rows = durable(counted.where("NOT base_failed").join(feeds, "pair").select("grp", *names), "vectors")
    fitted = groups.join(fit_groups(rows), "grp").drop("grp", "log_det")
    fitted = durable(fitted, "fitted")
    far = F.coalesce(distance(), F.lit(0.0))
    judged = counted.join(fitted, "pair", "left").withColumn("distance", far)
    kept = ~F.col("base_failed") & (F.col("distance") <= chi_square_point(CUTOFF, DIMS))
    drop = (own - {"distance"}) | {"n_lines"}
    return judged.withColumn("kept", kept).select(*(c for c in judged.columns if c not in drop), "kept")
