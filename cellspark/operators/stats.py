"""Statistics over long frames ``feature, value`` and wide feature tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspark.functions.special import t_p_value, z_p_value

from .frame import materialized, numbered, running, with_average_rank


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot(keys, columns, "feature", "value").where("value is not null")


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """t and its degrees of freedom from means, sample variances and counts; null without spread."""
    a, b = v1 / n1, v2 / n2
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    return t, F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))


def adjust_fdr(df: DataFrame, p: str, order: list[str], method: str = "fdr_bh", name: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg over all rows; a missing p counts as 1. ``order`` tells rows of one p apart.

    Ranks and the running minimum come from range-sorted passes, so that the tests may be as many as the data.
    """
    if method != "fdr_bh":
        raise ValueError(f"unknown correction {method!r}")
    filled = df.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    total = filled.agg(F.count("*").alias("_m"))
    ranked = numbered(filled, [F.col("_p").asc(), *(F.col(c).asc() for c in order)], name="_rank").join(F.broadcast(total))  # one row
    out = running(ranked, [F.desc("_rank")], least={"_q": F.col("_p") * F.col("_m") / F.col("_rank")})
    return out.withColumn(name, F.least(F.lit(1.0), "_q")).drop("_p", "_rank", "_m", "_q")


def _sums(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def find_markers(long: DataFrame, legacy: bool = False, test: str = "welch") -> DataFrame:
    """Each label against the rest, for each feature: ``label, feature, value`` in, one row per pair out, adjusted jointly.

    The rest's moments are the total's less the label's, from values centred on the feature's mean, so the
    data is grouped once; rank tests instead rank each feature once.
    """
    centre = long.groupBy(F.col("feature").alias("f0")).agg(F.avg("value").alias("c"))
    rows = long.join(centre, F.col("feature") == F.col("f0")).withColumn("z", F.col("value") - F.col("c"))
    own = rows.groupBy("feature", "label").agg(F.first("c").alias("c"), F.count("z").alias("n1"), F.sum("z").alias("s1"), F.sum(F.col("z") * F.col("z")).alias("q1"))
    whole = own.groupBy(F.col("feature").alias("fw")).agg(F.sum("n1").alias("n"), F.sum("s1").alias("s"), F.sum("q1").alias("q"))
    g = own.join(whole, F.col("feature") == F.col("fw")).withColumn("n2", F.col("n") - F.col("n1"))
    mean = lambda s, n: F.try_divide(s, n)
    var = lambda s, q, n: F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))
    m1, m2 = mean(F.col("s1"), F.col("n1")), mean(F.col("s") - F.col("s1"), F.col("n2"))
    v1, v2 = var(F.col("s1"), F.col("q1"), F.col("n1")), var(F.col("s") - F.col("s1"), F.col("q") - F.col("q1"), F.col("n2"))
    t, dof = welch(m1, v1, F.col("n1"), m2, v2, F.col("n2"))
    mean_in, mean_out = m1 + F.col("c"), m2 + F.col("c")
    out = g.select("label", "feature", "n1", "n2", mean_in.alias("mean_in"), mean_out.alias("mean_out"), t.alias("statistic"), dof.alias("df"))
    if not legacy:
        out = out.where("n1 >= 3 and n2 >= 3")
    if test in ("welch", "ttest"):
        out = out.withColumn("pval", t_p_value(F.col("statistic"), F.col("df")))
    elif test in ("mannwhitneyu", "wilcoxon", "ranksum"):
        u = rank_sums(long).select(F.col("label").alias("ul"), F.col("feature").alias("uf"), "u", "z")
        out = out.drop("statistic", "df").join(u, (F.col("label") == F.col("ul")) & (F.col("feature") == F.col("uf"))).drop("ul", "uf").withColumn("statistic", F.col("u")).withColumn("pval", z_p_value(F.col("z"))).drop("u", "z")
    else:
        raise ValueError(f"unknown test {test!r}")
    ratio = F.try_divide(F.col("mean_in"), F.col("mean_out"))
    if legacy:
        fc = (F.col("mean_in") + 1e-15) / (F.col("mean_out") + 1e-15)
        out = out.withColumns({"fold_change": fc, "abs_delta_fc": F.abs(fc - 1)})
    else:
        delta = F.col("mean_in") - F.col("mean_out")
        out = out.withColumns({"delta": delta, "abs_delta_fc": F.abs(delta), "fold_change": ratio, "log2_fc": F.when(ratio > 0, F.log2(ratio))})
    return adjust_fdr(out, "pval", ["label", "feature"])


def rank_sums(long: DataFrame) -> DataFrame:
    """Mann-Whitney U of each label against the rest, and its normal score with ties corrected.

    Ranks come from the counts of distinct values, so equal values travel as one row.
    """
    counts = long.groupBy("feature", "label", "value").agg(F.count("*").alias("k"))
    ties = counts.groupBy("feature", "value").agg(F.sum("k").alias("t"))
    ties = running(ties, [F.col("value").asc()], ("feature",), sums={"upto": F.col("t")}).withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    total = ties.groupBy(F.col("feature").alias("tf")).agg(F.sum("t").alias("n"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    joined = counts.join(ties.select(F.col("feature").alias("rf"), F.col("value").alias("rv"), "rank"), (F.col("feature") == F.col("rf")) & (F.col("value") == F.col("rv")))
    sums = joined.groupBy("feature", "label").agg(F.sum(F.col("k") * F.col("rank")).alias("r1"), F.sum("k").alias("n1")).join(total, F.col("feature") == F.col("tf"))
    n1, n2, n = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double"), F.col("n").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1))))
    off = F.abs(u - n1 * n2 / 2)
    return sums.select("label", "feature", u.alias("u"), F.try_divide(F.greatest(off - 0.5, F.lit(0.0)), spread).alias("z"))


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-rank sums of ``a - b``, zeros left out; ``w`` is the lesser, z its normal score with ties corrected."""
    d = pairs.withColumn("d", F.col("a") - F.col("b")).where("d <> 0").withColumn("m", F.abs("d"))
    ranked = with_average_rank(d, "m", tuple(keys), "r")
    g = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"), F.count("*").cast("double").alias("n"))
    ties = d.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), "m").agg(F.count("*").cast("double").alias("t")).groupBy(*(f"_{k}" for k in keys)).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    n, w = F.col("n"), F.least("up", "down")
    out = g.join(ties, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48))
    return out.select(*keys, w.alias("w"), F.col("n").cast("long").alias("n"), z.alias("z")).withColumn("pval", z_p_value(F.col("z")))


def group_difference(long: DataFrame, group: str, first: str, second: str, test: str = "welch", key: str | None = None) -> DataFrame:
    """Means, sample spreads, counts, a test and Cohen's d (mean of the two variances) of two groups, by feature.

    ``test``: welch, mannwhitneyu, or wilcoxon, which pairs the groups' rows by their places in the order of ``key``.
    """
    if test not in ("welch", "mannwhitneyu", "wilcoxon"):
        raise ValueError(f"unknown test {test!r}")
    both = group_difference(long, group, first, second) if test != "welch" else None
    if test == "mannwhitneyu":
        two = long.where(F.col(group).isin(first, second)).select("feature", F.col(group).alias("label"), "value")
        u = rank_sums(two).where(F.col("label") == first).select(F.col("feature").alias("_f"), F.col("u").alias("statistic"), z_p_value(F.col("z")).alias("pval"))
        return both.drop("statistic", "df", "pval").join(u, F.col("feature") == F.col("_f"), "left").drop("_f")
    if test == "wilcoxon":
        if key is None:
            raise ValueError("a paired test needs the column that orders the rows")
        side = lambda g, name: numbered(long.where((F.col(group) == g) & F.col("value").isNotNull()).select("feature", key, F.col("value").alias(name)), [F.col(key).asc()], ("feature",), "_at").drop(key)
        w = wilcoxon(side(first, "a").join(side(second, "b"), ["feature", "_at"]), ["feature"]).select(F.col("feature").alias("_f"), F.col("w").alias("statistic"), "pval")
        return both.drop("statistic", "df", "pval").join(w, F.col("feature") == F.col("_f"), "left").drop("_f")
    in1, in2 = F.col(group) == first, F.col(group) == second
    side = lambda f, c: f(F.when(c, F.col("value")))
    g = long.where(in1 | in2).groupBy("feature").agg(
        side(F.avg, in1).alias("mean1"), side(F.avg, in2).alias("mean2"), side(F.var_samp, in1).alias("v1"), side(F.var_samp, in2).alias("v2"), F.count_if(in1).alias("n1"), F.count_if(in2).alias("n2")
    )
    t, dof = welch(F.col("mean1"), F.col("v1"), F.col("n1"), F.col("mean2"), F.col("v2"), F.col("n2"))
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    return g.select("feature", "mean1", "mean2", F.sqrt("v1").alias("std1"), F.sqrt("v2").alias("std2"), "n1", "n2", t.alias("statistic"), dof.alias("df"), F.when(pooled > 0, (F.col("mean1") - F.col("mean2")) / pooled).alias("cohens_d"), t_p_value(t, dof).alias("pval"))


def boundary_differences(long: DataFrame, least: int = 10) -> DataFrame:
    """Close against distant cells by type and feature (``cell_type, border_proximity, feature, value``); types of fewer than ``least`` on a side are left out; no adjustment."""
    close, far = F.col("border_proximity") == "close", F.col("border_proximity") == "distant"
    side = lambda f, c: f(F.when(c, F.col("value")))
    g = long.where(F.col("cell_type") != "n/a").groupBy("cell_type", "feature").agg(
        side(F.avg, close).alias("mean_close"), side(F.avg, far).alias("mean_distant"), side(F.var_samp, close).alias("v1"), side(F.var_samp, far).alias("v2"), F.count_if(close).alias("n_close"), F.count_if(far).alias("n_distant")
    )
    g = g.where((F.col("n_close") >= least) & (F.col("n_distant") >= least))
    t, dof = welch(F.col("mean_close"), F.col("v1"), F.col("n_close"), F.col("mean_distant"), F.col("v2"), F.col("n_distant"))
    effect = F.try_divide(F.col("mean_close") - F.col("mean_distant"), F.sqrt((F.col("v1") + F.col("v2")) / 2))
    return g.select("cell_type", "feature", "mean_close", "mean_distant", "n_close", "n_distant", t.alias("statistic"), dof.alias("df"), effect.alias("effect_size"), t_p_value(t, dof).alias("pval"))


def correlations(long: DataFrame) -> DataFrame:
    """``feature, n, pearson_r, spearman_r, spearman_p`` from ``feature, value, target``; at least three pairs."""
    rows = long.where("value is not null and target is not null")
    ranks = with_average_rank(with_average_rank(rows, "value", ("feature",), "rv"), "target", ("feature",), "rt")
    # Null, not an error, for a column without spread.
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    g = ranks.groupBy("feature").agg(F.count("*").alias("n"), corr("value", "target").alias("pearson_r"), corr("rv", "rt").alias("spearman_r")).where("n >= 3")
    rho = F.col("spearman_r")
    t = F.try_divide(rho * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(F.greatest(1 - rho * rho, F.lit(0.0))))
    p = F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(t_p_value(t, (F.col("n") - 2).cast("double")))
    return g.withColumn("spearman_p", p)


#: Rows of a feature that are shuffled among themselves, and shuffled numbers held at once.
CHUNK, _CELLS = 4096, 4_000_000
#: Features that share a shuffle, chunks whose sums come together in one task, and parts that the deals are split in.
FEATURES, SPAN, LANES = 64, 4, 4


def keyed_permutation(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudo-random permutation of 0 .. n - 1 by a key: a Feistel network of four rounds on the next even number of bits, walked until inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            mixed = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (mixed >> np.uint64(64 - half)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permutation_p(long: DataFrame, n_permutations: int = 10_000, seed: int = 42, method: str = "pearson", block: int = 512, chunk: int = CHUNK) -> DataFrame:
    """``feature, p``: share of shuffles of the target whose correlation is at least as strong; 1 / (n + 1) for none.

    A feature may have any number of rows, which are numbered by their target, so features with the same targets have them at the same numbers and share
    their shuffles, up to ``FEATURES`` at once: a shuffle is made once and multiplied with the values of all. For every ``block`` shuffles a keyed permutation of
    the row numbers deals the targets anew to chunks of at most ``chunk`` rows; within a chunk they are shuffled against its values, and the chunks' sums of
    products come together by shuffle. Since the deal is uniform, so is each shuffle; those of one deal share the chunks' means only, a
    ``1 / chunk``-th of the variance, and nothing where one chunk holds the feature.
    Cost: ``n / block`` targets moved for each shuffle of ``FEATURES`` features, values moved ``LANES`` times, ``n`` products for each shuffle and feature. 10,000
    shuffles of a million rows and 64 features are 20 million targets and 256 million values moved, and 39 million sums.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    deals = -(-n_permutations // block)
    rows = long.where("value is not null and target is not null").select("feature", F.col("value").cast("double").alias("value"), F.col("target").cast("double").alias("target"))
    if method == "spearman":
        ranked = with_average_rank(with_average_rank(rows, "value", ("feature",), "rv"), "target", ("feature",), "rt")
        rows = ranked.select("feature", F.col("rv").alias("value"), F.col("rt").alias("target"))
    rows = numbered(rows, [F.col("target"), F.xxhash64(F.lit(seed), "value", "target"), F.col("value")], ("feature",), "i")
    rows = materialized(rows.withColumn("i", F.col("i") - 1))
    alike = [F.bit_xor(F.xxhash64("i", "target")).alias("h0"), F.bit_xor(F.xxhash64("target", "i", F.lit(1))).alias("h1")]
    sums = rows.groupBy(F.col("feature").alias("f")).agg(F.count("*").alias("n"), F.avg("value").alias("mx"), F.avg("target").alias("my"), F.stddev_pop("value").alias("sx"), F.stddev_pop("target").alias("sy"), *alike)
    place = F.row_number().over(Window.partitionBy("n", "h0", "h1").orderBy("f")) - 1  # a row for each feature
    sums = sums.where("n >= 3 and sx > 0 and sy > 0").withColumn("place", place)
    sums = materialized(sums.select("f", "n", "mx", "my", F.xxhash64("n", "h0", "h1", F.expr(f"place div {FEATURES}")).alias("g"), (F.col("place") % FEATURES).cast("int").alias("m")))
    chunks = F.ceil(F.col("n") / chunk)
    rows = rows.join(sums, F.col("feature") == F.col("f")).select("feature", "i", "n", "g", "m", (F.col("value") - F.col("mx")).alias("x"), (F.col("target") - F.col("my")).alias("y"), (F.col("i") % chunks).alias("chunk"), F.floor(F.col("i") / chunks).cast("int").alias("slot"))
    rows = materialized(rows)
    real = rows.groupBy(F.col("g").alias("rg"), F.col("m").alias("rm"), "feature").agg(F.sum(F.col("x") * F.col("y")).alias("real"))

    def deal(frames):
        for df in frames:
            for at in range(0, len(df), max(1, 100_000 // deals)):
                part = df.iloc[at : at + max(1, 100_000 // deals)]
                many = -(-part["n"].to_numpy(np.int64) // chunk)
                for d in range(deals):
                    place = part["i"].to_numpy(np.int64).copy()
                    for n in part["n"].unique():
                        own = (part["n"] == n).to_numpy()
                        place[own] = keyed_permutation(place[own], int(n), seed * 1_000_003 + d)
                    yield pd.DataFrame({"g": part["g"], "lane": np.int32(d % LANES), "chunk": place % many, "slot": (place // many).astype(np.int32), "d": np.int32(d), "y": part["y"]})

    span = F.expr(f"chunk div {SPAN}").alias("span")
    dealt = rows.where("m = 0").select("g", "i", "n", "y").mapInPandas(deal, "g long, lane int, chunk long, slot int, d int, y double").select("*", span)
    fixed = rows.select("g", F.explode(F.sequence(F.lit(0), F.lit(min(deals, LANES) - 1))).alias("lane"), "chunk", "slot", "m", "x", span)
    keys = ["g", "lane", "span"]

    def shuffled(key: tuple, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((SPAN, int(xs["slot"].max()) + 1, int(xs["m"].max()) + 1))
        values[xs["chunk"].to_numpy() % SPAN, xs["slot"].to_numpy(), xs["m"].to_numpy()] = xs["x"].to_numpy()
        width, got = values.shape[2], {}
        for (d, c), own in ys.groupby(["d", "chunk"]):
            y = own.sort_values("slot")["y"].to_numpy()
            x, rng = values[c % SPAN, : len(y)], np.random.default_rng([seed, int(d), int(c)])
            n = min(block, n_permutations - int(d) * block)
            at_once = max(1, min(n, _CELLS // len(y)))
            one = np.concatenate([rng.permuted(np.broadcast_to(y, (min(at_once, n - k), len(y))), axis=1) @ x for k in range(0, n, at_once)])
            got[d] = got[d] + one if d in got else one
        every = [pd.DataFrame({"g": key[0], "d": np.int32(d), "k": np.repeat(np.arange(len(s), dtype=np.int32), width), "m": np.tile(np.arange(width, dtype=np.int32), len(s)), "s": s.ravel()}) for d, s in got.items()]
        return pd.concat(every, ignore_index=True)

    parts = fixed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(shuffled, "g long, d int, k int, m int, s double")
    tried = parts.groupBy("g", "d", "k", "m").agg(F.sum("s").alias("s")).join(real, (F.col("g") == F.col("rg")) & (F.col("m") == F.col("rm")))
    counts = tried.groupBy("feature").agg(F.count_if(F.abs("s") >= F.abs("real") * (1 - 1e-12)).alias("hits"))
    return counts.select("feature", F.when(F.col("hits") > 0, F.col("hits") / n_permutations).otherwise(1 / (n_permutations + 1)).alias("p"))


def correlation_screen(long: DataFrame, n_permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """Both correlations of each feature with the target, permutation and analytic p, adjusted, by adjusted p."""
    p = permutation_p(long, n_permutations, seed).select(F.col("feature").alias("pf"), F.col("p").alias("pearson_p"))
    out = correlations(long).join(p, F.col("feature") == F.col("pf"), "left").drop("pf")
    out = adjust_fdr(adjust_fdr(out, "pearson_p", ["feature"], name="pearson_p_adj"), "spearman_p", ["feature"], name="spearman_p_adj")
    return out.orderBy("pearson_p_adj", "feature")


def legacy_correlation(rows: DataFrame, value: str, target: str, kinds: list[str] | None = None, n_permutations: int = 100_000, seed: int = 1234) -> DataFrame:
    """``n, pearson_r, p`` of one feature and target by permutation, over cells of the given types only if any are given."""
    rows = rows if kinds is None else rows.where(F.col("cell_type").isin(*kinds))
    long = rows.select(F.lit(value).alias("feature"), F.col(value).cast("double").alias("value"), F.col(target).cast("double").alias("target"))
    p = permutation_p(long, n_permutations, seed).select(F.col("feature").alias("pf"), "p")
    return correlations(long).join(p, F.col("feature") == F.col("pf"), "left").select("feature", "n", "pearson_r", "p")


def legacy_screen(long: DataFrame, n_permutations: int = 100_000, seed: int = 1234) -> DataFrame:
    """Permutation screen of each feature with the target: features without a correlation are left out, p is adjusted."""
    found = correlations(long).where("pearson_r is not null and not isnan(pearson_r)").select("feature", "n", "pearson_r")
    p = permutation_p(long, n_permutations, seed).select(F.col("feature").alias("pf"), "p")
    return adjust_fdr(found.join(p, F.col("feature") == F.col("pf")).drop("pf"), "p", ["feature"])


def sorted_markers(markers: DataFrame) -> DataFrame:
    """By adjusted p over all labels, then by p within a label."""
    return markers.orderBy("p_adj", "label", "pval", "feature")


def first_markers(markers: DataFrame, n: int = 6, alpha: float = 0.05) -> DataFrame:
    """The first n significant markers by adjusted p."""
    return markers.where(F.col("p_adj") < alpha).orderBy("p_adj", "pval", "label", "feature").limit(n)


def regression_lines(rows: DataFrame, hue: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(hue).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.count("*").alias("n"))
