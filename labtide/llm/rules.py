"""Quality rules: plain limits, and robust multivariate outliers per language and source.

Five statistics of each text are brought to a logarithmic scale: mean word length, and the shares of
symbols, repeated lines, words in repeated passages, and capitals with exclamation marks. For each
(language, source) a minimum covariance determinant estimate gives the centre and spread of the tightest
half of its documents; a document far outside, by Mahalanobis distance, is rejected.

The estimate starts twice, from the medians with median deviations and from the plain mean and covariance.
Each start takes concentration steps: the half of the group with the smallest distances gives the next
mean and covariance. The start that ends with the smaller determinant wins. A step is one aggregation
over slim rows: counts and moments per distance class, combined before the shuffle, then summed over the
classes up to the half. Statistics are fixed-point integers, so sums are exact in any order and reruns agree.

A group with fewer than `LEAST_ROWS` documents joins the others of its language, and those too few in
turn all the rest; with too few documents in the end only the plain limits judge. Spreads have a floor, so
that a group whose documents all lack symbols does not reject the first one that has a few.

Defined cases: null text is a text without words and fails the plain limits; null language and source are
values of their own; rows are judged one by one, so repeated rows agree; empty tables give empty results.
`keep` passes all columns of its input through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtide.llm.common import SPACES, held, settled, whole, words

LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words in repeated passages
PASSAGE = 5
LEAST_ROWS = 100
#: Squared distance beyond which a document is an outlier: about the 0.9999 quantile of chi-square in five dimensions.
CUTOFF = 25.0
STEPS = 3
#: Fixed-point steps per unit of the logarithmic scale.
UNIT = 1000
#: Smallest spread of each statistic. Each is well under a fifth (the root of the cutoff) of what its statistic can
#: reach, log(101) for a share and log(21) for repeats within the plain limit, so that each can reject alone.
FLOORS = {"x_length": 0.15, "x_symbols": 0.35, "x_lines": 0.7, "x_repeats": 0.55, "x_capitals": 0.4}
NAMES = list(FLOORS)
P = len(NAMES)
#: Makes the covariance of the tightest half estimate that of the whole in five dimensions.
HALF_FACTOR = 1.9
#: Classes of squared distance per doubling.
CLASSES = 8
#: Estimates are broadcast up to this many groups and joined by shuffle beyond.
BROADCAST_GROUPS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _zip_shifted(left: Column, right: Column, shift: int, size: Column) -> Column:
    """Hashes of left[i] with right[i + shift], for `size` positions."""
    n = F.greatest(size, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: F.xxhash64(a, b))


def with_counts(docs: DataFrame) -> DataFrame:
    """Each row of `docs` as a struct `row`, with the counts its rules need."""
    base = docs.select(F.struct("*").alias("row"), whole("text").alias("t"))
    split = base.select(
        "row", "t", words("t").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
    )
    counted = split.select(
        "row", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", r"[^A-Z!]+", "")).cast("long").alias("n_capitals"),
    )
    plain = ["row", "n", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals"]
    two = counted.select(*plain, "h", _zip_shifted(F.col("h"), F.col("h"), 1, F.col("n") - 1).alias("h2"))
    four = two.select(*plain, "h", _zip_shifted(F.col("h2"), F.col("h2"), 2, F.col("n") - 3).alias("h4"))
    five = four.select(*plain, _zip_shifted(F.col("h4"), F.col("h"), PASSAGE - 1, F.col("n") - PASSAGE + 1).alias("h5"))
    # only texts with a repeated window sort theirs
    repeats = F.size(F.array_distinct("h5")) < F.size("h5")
    placed = F.sort_array(F.transform("h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = five.select(*plain, F.when(repeats, placed).alias("p"))

    def twin(x: Column, k: Column) -> Column:
        return (F.get("p", k - 1)["h"] == x["h"]) | F.coalesce(F.get("p", k + 1)["h"] == x["h"], F.lit(False))

    found = F.filter("p", lambda x, k: F.when(k == 0, F.get("p", k + 1)["h"] == x["h"]).otherwise(twin(x, k)))
    starts = ordered.select(*plain, F.sort_array(F.transform(found, lambda x: x["i"])).alias("s"))
    steps = F.zip_with(
        F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: F.least(F.lit(PASSAGE), b - a)
    )
    repeated = F.when(F.col("s").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(PASSAGE), lambda a, b: a + b))
    return starts.select(
        "row", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated.cast("long").alias("n_repeat_words"), "n_lines", "n_capitals",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """Fixed-point statistics. The added constants stand for a little ordinary text, so short ones vary less."""
    share = lambda part, of: F.log(1 + 100 * F.col(part) / of)
    raw = {
        "x_length": F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20)),
        "x_symbols": share("n_symbols", F.col("word_chars") + 100),
        "x_lines": share("n_dup_lines", F.col("n_lines") + 10),
        "x_repeats": share("n_repeat_words", F.col("n_words") + 50),
        "x_capitals": share("n_capitals", F.col("word_chars") + 100),
    }
    return {k: F.round(v * UNIT).cast("long") for k, v in raw.items()}


def _distance(rows: DataFrame, out: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the lower triangle l_i_j."""
    for i, x in enumerate(NAMES):
        gap = F.col(x).cast("double") - F.col(f"m_{i}")
        for j in range(i):
            gap = gap - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", gap / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, P)), F.col("z_0") * F.col("z_0"))
    return rows.withColumn(out, total).drop(*[f"z_{i}" for i in range(P)])


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _triangle(moments: DataFrame, factor: float) -> DataFrame:
    """Means and Cholesky triangle of factor * covariance + floors, from n, s_i and q_i_j."""
    n = F.col("n").cast("double")
    out = moments.withColumns(
        {f"m_{i}": F.col(f"s_{i}").cast("double") / n for i in range(P)}
    )
    floors = [(FLOORS[x] * UNIT) ** 2 for x in NAMES]
    out = out.withColumns({
        f"c_{i}_{j}": factor * (F.col(f"q_{i}_{j}").cast("double") / n - F.col(f"m_{i}") * F.col(f"m_{j}")) + (floors[i] if i == j else 0.0)
        for i, j in _PAIRS
    })
    return _cholesky(out)


def _cholesky(out: DataFrame) -> DataFrame:
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    det = F.col("l_0_0")
    for i in range(1, P):
        det = det * F.col(f"l_{i}_{i}")
    return out.withColumn("det", det)


_FITTED = [f"m_{i}" for i in range(P)] + [f"l_{i}_{j}" for i, j in _PAIRS] + ["det"]


def groups(slim: DataFrame) -> DataFrame:
    """lang, source, group: the pool whose estimate judges the documents of a language and source."""
    counted = slim.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    few = F.when(F.col("rows") < LEAST_ROWS, F.col("rows")).otherwise(0)
    pooled = counted.withColumn("pool", F.sum(few).over(Window.partitionBy("lang")))
    name = (
        F.when(F.col("rows") >= LEAST_ROWS, F.to_json(F.struct("lang", "source")))
        .when(F.col("pool") >= LEAST_ROWS, F.to_json(F.struct("lang")))
        .otherwise("all")
    )
    return pooled.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), name.alias("group"))


def _grouped(rows: DataFrame, named: DataFrame, small: bool) -> DataFrame:
    side = F.broadcast(named) if small else named
    return rows.join(
        side, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left"
    ).drop("g_lang", "g_source")


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS],
    )


def _step(rows: DataFrame, fitted: DataFrame, small: bool) -> DataFrame:
    """One concentration step: the estimates of the closest half under the last estimates."""
    side = F.broadcast(fitted) if small else fitted
    near = _distance(rows.join(side, "group"), "d2")
    kind = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * CLASSES).cast("int")
    sums = _moments(near.withColumn("class", kind), ["group", "start", "class"])
    upto = Window.partitionBy("group", "start").orderBy("class")
    every = Window.partitionBy("group", "start")
    parts = sums.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("rows", F.sum("n").over(every))
    half = parts.where(F.col("before") < F.floor((F.col("rows") + P + 1) / 2))
    kept = half.groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in sums.columns[3:]])
    return settled(_triangle(kept, HALF_FACTOR).select("group", "start", *_FITTED))


def fit(slim: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Group names, estimates per group, and whether these are few enough to broadcast.

    `slim` has lang, source and the fixed-point statistics, already settled.
    """
    named = settled(groups(slim))
    few = named.count() <= BROADCAST_GROUPS
    rows = settled(_grouped(slim, named, few).select("group", *NAMES))
    # a pool that is still too small gets no estimate
    every = _moments(rows, ["group"]).where(F.col("n") >= LEAST_ROWS)
    classical = _triangle(every, 1.0).select("group", F.lit("mean").alias("start"), *_FITTED)
    middle = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(x, 0.5).alias(f"m_{i}") for i, x in enumerate(NAMES)])
    middle = middle.where(F.col("n") >= LEAST_ROWS).drop("n")
    away = rows.join(F.broadcast(middle) if few else middle, "group").groupBy("group").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(P)],
        *[F.percentile(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5).alias(f"a_{i}") for i, x in enumerate(NAMES)],
    )
    diagonal = away.withColumns({
        f"c_{i}_{j}": (F.col(f"a_{i}") * 1.4826) ** 2 + (FLOORS[NAMES[i]] * UNIT) ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS
    })
    robust = _cholesky(diagonal).select("group", F.lit("median").alias("start"), *_FITTED)
    fitted = settled(classical.unionByName(robust))
    for _ in range(STEPS):
        fitted = _step(rows, fitted, few)
    best = fitted.groupBy("group").agg(F.min_by(F.struct(*_FITTED), F.struct("det", "start")).alias("best"))
    return named, settled(best.select("group", "best.*")), few


def slim_rows(counted: DataFrame, *carried: str) -> DataFrame:
    """lang, source, counts and statistics of `with_counts`, with fields of the row carried along."""
    return counted.select(
        *[F.col("row")[c].alias(c) for c in carried], F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *COUNTS
    ).withColumns(_vector())


def judged(rows: DataFrame, named: DataFrame, fitted: DataFrame, small: bool, cutoff: float = CUTOFF) -> DataFrame:
    """`rows` with distance (null without an estimate), base_failed and kept."""
    joined = _grouped(rows, named, small).join(F.broadcast(fitted) if small else fitted, "group", "left")
    far = _distance(joined, "distance").drop(*_FITTED, "group")
    verdict = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return far.withColumn("base_failed", base_failed()).withColumn("kept", verdict)


def report(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, counts, statistics, distance, base_failed and kept of every document."""
    slim = settled(slim_rows(with_counts(docs), "doc_id"))
    return judged(slim, *fit(slim), cutoff)


def keep(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that pass, unchanged. Texts are counted twice rather than shuffled or stored."""
    slim = settled(slim_rows(with_counts(docs)).drop(*COUNTS))
    counted = with_counts(docs)
    rows = counted.select(
        "row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *COUNTS
    ).withColumns(_vector())
    passed = held(judged(rows, *fit(slim), cutoff).select("row", "kept")).where("kept")
    return passed.select(*[F.col("row")[c].alias(c) for c in docs.columns])
