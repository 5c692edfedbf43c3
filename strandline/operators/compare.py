"""Comparison tables over paths (variant, t, date, tau) and model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import average_rank

#: The years that count as crises.
CRISIS_YEARS = (1998, 1999, 2007, 2008, 2020)


def crisis(date: Column | str, years: tuple[int, ...] = CRISIS_YEARS) -> Column:
    return F.year(date).isin(*years)


def path_comparison(a: DataFrame, b: DataFrame, key: list[str], years: tuple[int, ...] = CRISIS_YEARS, least: int = 12) -> DataFrame:
    """Two paths (key, t, date, x) joined: correlation, Spearman, RMSE, correlation in crises, means, peak months.
    Correlations of fewer than `least` common months are null."""
    j = a.withColumnRenamed("x", "xa").join(b.drop("date").withColumnRenamed("x", "xb"), [*key, "t"]).filter("xa IS NOT NULL AND xb IS NOT NULL")
    j = average_rank(average_rank(j, "xa", key, "ra"), "xb", key, "rb")
    c = crisis("date", years)
    enough = lambda x: F.when(F.count("*") >= least, x)
    return j.groupBy(*key).agg(
        F.count("*").alias("n"),
        enough(F.corr("xa", "xb")).alias("corr"),
        enough(F.corr("ra", "rb")).alias("spearman"),
        F.sqrt(F.avg((F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")))).alias("rmse"),
        F.corr(F.when(c, F.col("xa")), F.when(c, F.col("xb"))).alias("crisis_corr"),
        F.avg("xa").alias("mean_a"),
        F.avg("xb").alias("mean_b"),
        F.min_by("date", F.struct(-F.col("xa"), F.col("t"))).alias("peak_a"),
        F.min_by("date", F.struct(-F.col("xb"), F.col("t"))).alias("peak_b"),
    )


def top(df: DataFrame, value: str, key: list[str], k: int, ties: str = "t") -> DataFrame:
    """The k largest of each key with their rank."""
    w = Window.partitionBy(*key).orderBy(F.col(value).desc(), F.col(ties))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_overlap(a: DataFrame, b: DataFrame, key: list[str], k: int) -> DataFrame:
    """Two-source top-k table: source, rank, place, and whether the place is in the other source's list too."""
    ta = top(a, "x", key, k).select(*key, F.lit("a").alias("source"), "rank", "t", "x")
    tb = top(b, "x", key, k).select(*key, F.lit("b").alias("source"), "rank", "t", "x")
    both = ta.unionByName(tb)
    return both.withColumn("in_both", F.count("*").over(Window.partitionBy(*key, "t")) == 2)


def new_places(new: DataFrame, old: DataFrame, key: list[str], k: int) -> DataFrame:
    """Places in new's top k that aren't in old's."""
    return top(new, "x", key, k).join(top(old, "x", key, k).select(*key, "t"), [*key, "t"], "left_anti")


def correlation_matrix(long: DataFrame, name: str, least: int = 12) -> DataFrame:
    """Pairwise Pearson correlations of the series of a long table (name, t, x) over common places."""
    a = long.select(F.col(name).alias("a"), "t", F.col("x").alias("xa"))
    b = long.select(F.col(name).alias("b"), "t", F.col("x").alias("xb"))
    j = a.join(b, "t").filter("xa IS NOT NULL AND xb IS NOT NULL")
    return j.groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("xa", "xb")).alias("corr"))


def nearest_state(named: DataFrame, top_states: DataFrame) -> DataFrame:
    """For each named place its nearest top state (ties: higher rank): a fixed, small set on either side."""
    d = F.abs(F.col("t") - F.col("named_t"))
    j = named.crossJoin(F.broadcast(top_states.select("t", "rank")))
    return j.groupBy("name", "named_t").agg(F.min_by("t", F.struct(d, F.col("rank"))).alias("nearest_t"), F.min(d).alias("distance"))


def pair_differences(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Model scores (model, t, score) as differences a - b of each named pair, joined by place."""
    spark = scores.sparkSession
    dim = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "pair string, ma string, mb string")
    a = scores.select(F.col("model").alias("ma"), "t", F.col("score").alias("sa"))
    b = scores.select(F.col("model").alias("mb"), "t", F.col("score").alias("sb"))
    return a.join(F.broadcast(dim), "ma").join(b, ["mb", "t"]).select("pair", "t", (F.col("sa") - F.col("sb")).alias("diff"))


#: Quantiles of the pair summary.
QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.75, 0.90, 0.95, 0.99)


def pair_summary(diffs: DataFrame) -> DataFrame:
    """Mean, sd, median, extremes, quantiles and the share of total absolute difference in the top 1, 5 and 10 places."""
    w = Window.partitionBy("pair").orderBy(F.abs("diff").desc(), "t")
    r = diffs.withColumn("r", F.row_number().over(w))
    a = F.abs("diff")
    share = lambda k: (F.sum(F.when(F.col("r") <= k, a)) / F.sum(a)).alias(f"top{k}_share")
    return r.groupBy("pair").agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"), F.percentile("diff", F.lit(0.5)).alias("median"), F.min("diff").alias("lo"), F.max("diff").alias("hi"),
        *[F.percentile("diff", F.lit(q)).alias(f"q{round(100 * q):02d}") for q in QUANTILES], share(1), share(5), share(10),
    )


def influential(diffs: DataFrame, k: int) -> DataFrame:
    """The k places of each pair with the largest absolute difference, and their share of the total."""
    w = Window.partitionBy("pair").orderBy(F.abs("diff").desc(), "t")
    total = F.sum(F.abs("diff")).over(Window.partitionBy("pair"))
    return diffs.withColumn("abs_share", F.abs("diff") / total).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def envelope(paths: list[DataFrame], names: list[str], key: list[str]) -> DataFrame:
    """Full outer join of named paths (key, x) with the smallest, largest and range over those present."""
    out = None
    for p, n in zip(paths, names):
        p = p.select(*key, F.col("x").alias(n))
        out = p if out is None else out.join(p, key, "full")
    lo, hi = F.least(*names), F.greatest(*names)
    return out.withColumn("lo", lo).withColumn("hi", hi).withColumn("spread", hi - lo)


def union_named(frames: dict[str, DataFrame], name: str = "variant") -> DataFrame:
    """UNION ALL by name with a literal name for each frame; columns that a frame lacks are null."""
    out = None
    for k, f in frames.items():
        f = f.withColumn(name, F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def union_keep_last(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """UNION in which a later row replaces an earlier one with the same key."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("_o").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_o")


def survival(full: DataFrame, part: DataFrame, key: list[str], k: int = 12) -> DataFrame:
    """How a reduced path keeps the full one: correlation, top-k overlap, ratio of means, sds, maxima, peak places."""
    j = full.select(*key, "t", F.col("x").alias("xf")).join(part.select(*key, "t", F.col("x").alias("xp")), [*key, "t"])
    s = j.groupBy(*key).agg(F.corr("xf", "xp").alias("corr"), (F.avg("xp") / F.avg("xf")).alias("retention"), F.stddev_pop("xf").alias("sd_full"), F.stddev_pop("xp").alias("sd_part"), F.max("xf").alias("max_full"), F.max("xp").alias("max_part"), F.min_by("t", F.struct(-F.col("xf"), F.col("t"))).alias("peak_full"), F.min_by("t", F.struct(-F.col("xp"), F.col("t"))).alias("peak_part"))
    both = top(full, "x", key, k).select(*key, "t").join(top(part, "x", key, k).select(*key, "t"), [*key, "t"]).groupBy(*key).agg(F.count("*").alias("overlap"))
    return s.join(both, key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def best_candidate(df: DataFrame, key: list[str], loss: str, tie: str, columns: list[str]) -> DataFrame:
    """The candidate with the least (loss, tie) of each key."""
    return df.groupBy(*key).agg(F.min(F.struct(loss, tie, *[c for c in columns if c not in (loss, tie)])).alias("b")).select(*key, *[F.col(f"b.{c}").alias(c) for c in dict.fromkeys([loss, tie, *columns])])


def selected_episodes(df: DataFrame, key: list[str], fixed: str) -> DataFrame:
    """Places that stand for a path (t, date, tau, rms): closest to neutral by hypot(ln tau, rms), largest tau, largest
    rms, and a fixed month; labels that fall on one place are merged."""
    s = df.withColumn("neutral", F.hypot(F.log("tau"), F.col("rms")))
    picks = s.groupBy(*key).agg(F.min(F.struct("neutral", "t")).alias("a"), F.min(F.struct(-F.col("tau"), F.col("t"))).alias("b"), F.min(F.struct(-F.col("rms"), F.col("t"))).alias("c"), F.min(F.when(F.col("date") == F.lit(fixed).cast("date"), F.col("t"))).alias("d"))
    named = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("t")) for n, c in (("neutral", "a.t"), ("peak", "b.t"), ("shape", "c.t"), ("fixed", "d"))])
    rows = picks.select(*key, F.explode(named).alias("p")).select(*key, "p.label", "p.t").filter("t IS NOT NULL")
    merged = rows.groupBy(*key, "t").agg(F.array_join(F.array_sort(F.collect_list("label")), "+").alias("label"))
    return merged.join(s, [*key, "t"]).select(*key, "t", "date", "label", "tau", "rms")


def window_peaks(df: DataFrame, windows: list[tuple[str, str, str]], fixed: list[str]) -> DataFrame:
    """Fixed months, and the largest value of each named window unless it is one of them: (label, date, x)."""
    spark = df.sparkSession
    dim = spark.createDataFrame(windows, "label string, lo string, hi string").selectExpr("label", "CAST(lo AS DATE) lo", "CAST(hi AS DATE) hi")
    j = df.join(F.broadcast(dim), F.col("date").between(F.col("lo"), F.col("hi")))
    peaks = j.groupBy("label").agg(F.min(F.struct(-F.col("x"), F.col("date"), F.col("x").alias("v"))).alias("p")).select("label", "p.date", F.col("p.v").alias("x"))
    own = df.filter(F.col("date").isin(*[F.lit(d).cast("date") for d in fixed])).select(F.concat(F.lit("fixed "), F.date_format("date", "yyyy-MM")).alias("label"), "date", "x")
    return own.unionByName(peaks.join(own.select("date"), "date", "left_anti").select("label", "date", "x"))


def mode_shares(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Counts and shares of labels; is_mode marks all that tie for most frequent."""
    n = df.groupBy(*key, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    return n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("is_mode", F.col("n") == F.max("n").over(w))


def model_summary(scores: DataFrame) -> DataFrame:
    """(model, t, score): count, mean, total and its rank of total."""
    s = scores.groupBy("model").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.sum("score").alias("total"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("total").desc(), "model")))


def comparison_summary(draws: DataFrame, dims: int) -> DataFrame:
    """Bootstrap draws (pair, draw, mean, n): centre, interval, P(> 0) and the gain for each dimension."""
    return draws.groupBy("pair").agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.05)).alias("p05"), F.percentile("mean", F.lit(0.95)).alias("p95"), F.avg((F.col("mean") > 0).cast("double")).alias("prob_positive"), (F.avg("mean") / dims).alias("per_dim"))


def score_energy(scores: DataFrame) -> DataFrame:
    """(variant, t, psi, psi_rf, psi_fs): energies of the two parts, their cross term and the additive identity's error."""
    return scores.groupBy("variant", "t").agg(F.sum(F.col("psi") * F.col("psi")).alias("energy"), F.sum(F.col("psi_rf") * F.col("psi_rf")).alias("rf"), F.sum(F.col("psi_fs") * F.col("psi_fs")).alias("fs"), (2 * F.sum(F.col("psi_rf") * F.col("psi_fs"))).alias("cross"))


def numeric_difference(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Largest absolute difference of each numeric column between two tables with the same keys, and unmatched rows."""
    j = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a")).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b")), key, "full")
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("d")) for c in columns])
    return j.select("_a", "_b", F.explode(items).alias("i")).groupBy("i.column").agg(F.max("i.d").alias("max_abs_diff"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"))


def basis_comparison(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two families of paths (key, basis, t, x): correlation, RMSE and both standard deviations of every basis path."""
    j = a.withColumnRenamed("x", "xa").join(b.withColumnRenamed("x", "xb"), [*key, "basis", "t"])
    d = F.col("xa") - F.col("xb")
    return j.groupBy(*key, "basis").agg(F.corr("xa", "xb").alias("corr"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_samp("xa").alias("sd_a"), F.stddev_samp("xb").alias("sd_b"))


def against_base(paths: DataFrame, base: str, k: int) -> DataFrame:
    """One compact row for each path (variant, t, x) against the one named `base`: correlation, RMSE, largest value, its
    place, and how many of the k largest places are among the base's k largest."""
    own = top(paths, "x", ["variant"], k).select("variant", "t")
    shared = own.join(own.filter(F.col("variant") == base).select("t"), "t").groupBy("variant").agg(F.count("*").alias("shared_top"))
    j = paths.join(paths.filter(F.col("variant") == base).select("t", F.col("x").alias("x0")), "t")
    d = F.col("x") - F.col("x0")
    row = j.groupBy("variant").agg(F.corr("x", "x0").alias("corr"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max("x").alias("largest"), F.min_by("t", F.struct(-F.col("x"), F.col("t"))).alias("place"))
    return row.join(shared, "variant", "left").na.fill(0, ["shared_top"])


def admissible(candidates: DataFrame, least_ess: float, most_weight: float, best: str) -> DataFrame:
    """Candidates (candidate, min_ess, max_w, ...) that are stable; `chosen` marks the one with the lowest `best`."""
    ok = candidates.filter((F.col("min_ess") >= least_ess) & (F.col("max_w") <= most_weight))
    return ok.withColumn("chosen", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(best, "candidate")) == 1)
