"""Goodness of fit of modelled against observed values, as aggregates."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.lanes import quantiles, running
from tarnflow.session import materialise


def fit_metrics(pairs: DataFrame, keys: list[str], observed: str = "observed", modelled: str = "modelled", min_n: int = 3, large: bool = False) -> DataFrame:
    """Per key: n, bias, rmse, r2, nse, nse_standard, kge, kge_standard, fze.

    nse and kge take the modelled series as reference, as this model's evaluation always did; the _standard ones take
    the observed. All but n and bias are NULL for fewer than `min_n` pairs or where either series is constant; a
    ratio with denominator 0 is NULL. Pairs with a NULL or NaN do not count. With `large` groups the quartiles come from ranks
    over ranges of rows (`lanes.quantiles`) and not from one buffer a group; the result is the same.
    """
    o, m = F.col(observed), F.col(modelled)
    good = pairs.filter(o.isNotNull() & m.isNotNull() & ~F.isnan(o) & ~F.isnan(m))
    zero = F.lit(0.0)
    if large:
        good = materialise(good)
    quartiles = [] if large else [F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(n) for c, n in ((o, "_qo"), (m, "_qm"))]
    a = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m - o).alias("bias"), F.sqrt(F.avg((m - o) * (m - o))).alias("_rmse"), F.sum((m - o) * (m - o)).alias("_ss"),
        F.var_pop(o).alias("_vo"), F.var_pop(m).alias("_vm"), F.avg(o).alias("_mo"), F.avg(m).alias("_mm"), ((F.min(o) < F.max(o)) & (F.min(m) < F.max(m))).alias("_scatter"), F.covar_pop(o, m).alias("_c"), *quartiles,
    )
    if large:
        for c, n in ((observed, "_qo"), (modelled, "_qm")):
            a = a.join(quantiles(good, keys, c, {"_q1": 0.25, "_q3": 0.75}).select(*keys, F.array("_q1", "_q3").alias(n)), keys)
    r = F.col("_c") / F.nullif(F.sqrt(F.col("_vo") * F.col("_vm")), zero)
    iqr = lambda c: F.col(c)[1] - F.col(c)[0]
    root = lambda x, y, z: 1 - F.sqrt((x - 1) * (x - 1) + (y - 1) * (y - 1) + (z - 1) * (z - 1))
    ratio = lambda x, y: x / F.nullif(y, zero)
    so, sm = F.sqrt("_vo"), F.sqrt("_vm")
    gate = lambda c: F.when((F.col("n") >= min_n) & F.col("_scatter"), c)
    r2 = 1 - ratio(F.col("_ss"), F.col("_vo") * F.col("n"))
    return a.select(
        *keys, "n", "bias", gate(F.col("_rmse")).alias("rmse"), gate(r2).alias("r2"),
        gate(1 - ratio(F.col("_ss"), F.col("_vm") * F.col("n"))).alias("nse"), gate(r2).alias("nse_standard"),
        gate(root(r, ratio(so, sm), ratio(F.col("_mo"), F.col("_mm")))).alias("kge"), gate(root(r, ratio(sm, so), ratio(F.col("_mm"), F.col("_mo")))).alias("kge_standard"),
        gate(root(r, ratio(iqr("_qm"), iqr("_qo")), ratio(F.col("_mm"), F.col("_mo")))).alias("fze"),
    )


def legacy_fze(pairs: DataFrame, keys: list[str], observed: str = "observed", modelled: str = "modelled") -> DataFrame:
    """The earlier FZE, with R2 in the place of the correlation: keys, fze_legacy."""
    f = fit_metrics(pairs, keys, observed, modelled, 1)
    o, m = F.col(observed), F.col(modelled)
    q = lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    parts = pairs.dropna(subset=[observed, modelled]).groupBy(*keys).agg((q(m) / F.nullif(q(o), F.lit(0.0))).alias("g"), (F.avg(m) / F.nullif(F.avg(o), F.lit(0.0))).alias("b"))
    both = f.select(*keys, "r2").join(parts, keys)
    return both.select(*keys, (1 - F.sqrt((F.col("r2") - 1) ** 2 + (F.col("g") - 1) ** 2 + (F.col("b") - 1) ** 2)).alias("fze_legacy"))


def student_p(rho: Column, n: Column, steps: int = 2000) -> Column:
    """Two-sided p-value of a correlation `rho` of `n` pairs by Student's t with n - 2 degrees of freedom.

    With t = rho sqrt((n - 2) / (1 - rho^2)) it is the integral of cos(x)^(n - 3) from asin|rho| to pi / 2, over that from 0;
    both by Simpson's rule as far as the integrand counts. NULL for fewer than three pairs; 0 where |rho| is 1.
    """
    power = (n - 3).cast("double")
    half_pi = F.lit(math.pi / 2)
    reach = F.lit(14.0) / F.sqrt(F.greatest(power, F.lit(1.0)))

    def integral(a: Column) -> Column:
        h = (F.least(half_pi, a + reach) - a) / steps
        weight = lambda k: F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        term = lambda s, k: s + weight(k) * F.pow(F.greatest(F.cos(a + h * k), F.lit(0.0)), power)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), term) * h / 3

    start = F.asin(F.least(F.abs(rho), F.lit(1.0)))
    return F.when(n >= 3, F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(integral(start) / integral(F.lit(0.0))))


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rank correlation per key: keys, n, rho, t, p. Ranks come from counts per value, summed up over ranges
    of values (`lanes.running`), so no key is sorted in one task.

    t is the statistic of the usual test, with n - 2 degrees of freedom, p its two-sided p-value. NULL pairs are left out.
    """
    good = pairs.dropna(subset=[x, y])

    def ranks(v: str, name: str) -> DataFrame:
        per_value = good.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_n"))
        return running(per_value, keys, [v], "_n", "_before").select(*keys, v, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))

    ranked = good.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return out.withColumns({"t": t, "p": student_p(F.col("rho"), F.col("n"))})


def equal_bins(value: Column, low: Column, high: Column, bins: int = 10) -> Column:
    """Bin 1..bins of equal width between low and high; the upper edge belongs to the last bin."""
    span = F.nullif(high - low, F.lit(0.0))
    return F.least(F.lit(bins), F.coalesce(F.floor((value - low) / span * bins), F.lit(0)) + 1).cast("int")
