"""Least squares with dummies, from one aggregate of cross products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.exprs import valid
from evenhand.functions.special import f_sf, t_ppf, t_sf2

#: Levels of one categorical covariate at most: each is a column of the design.
MOST_LEVELS = 100


def ols(df: DataFrame, y: str, covariates: list[str], alpha: float = 0.05) -> DataFrame:
    """(term, coef, se, t, p, ci_lo, ci_hi, r2, adj_r2, f, f_p, n), with a constant; strings become dummies without their first level.

    Rows with an invalid outcome or a null covariate are left out. One aggregation gives X'X and X'y; the solve is of
    the number of terms, which ``MOST_LEVELS`` bounds.
    """
    rows = df.filter(valid(F.col(y).cast("double"))).dropna(subset=covariates)
    terms = [("const", F.lit(1.0))]
    for c in covariates:
        if df.schema[c].dataType.simpleString() == "string":
            levels = [r[0] for r in rows.select(c).distinct().orderBy(c).limit(MOST_LEVELS + 1).collect()]
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
            terms += [(f"{c}[{v}]", (F.col(c) == v).cast("double")) for v in levels[1:]]
        else:
            terms.append((c, F.col(c).cast("double")))
    names, x = [t[0] for t in terms], [t[1] for t in terms]
    k, target = len(x), F.col(y).cast("double")
    sums = [F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum(v * target) for v in x]
    got = rows.agg(*sums, F.sum(target * target), F.sum(target), F.count(F.lit(1))).first()
    n = got[-1]
    gram = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = got[at] or 0.0
            at += 1
    xy = np.array([v or 0.0 for v in got[at : at + k]])
    yy, ysum = got[at + k] or 0.0, got[at + k + 1] or 0.0
    dof = n - k
    schema = "term string, coef double, se double, t double, p double, ci_lo double, ci_hi double, r2 double, adj_r2 double, f double, f_p double, n long"
    if dof <= 0:
        return df.sparkSession.createDataFrame([], schema)
    inv = np.linalg.pinv(gram)
    beta = inv @ xy
    rss = max(0.0, yy - float(beta @ xy))
    tss = yy - ysum * ysum / n
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / dof
    f = ((tss - rss) / (k - 1)) / (rss / dof) if k > 1 and rss > 0 else float("nan")
    se = np.sqrt(np.maximum(np.diag(inv) * rss / dof, 0))
    q = t_ppf(1 - alpha / 2, dof)
    out = []
    for i, name in enumerate(names):
        t = float(beta[i] / se[i]) if se[i] > 0 else float("nan")
        out.append((name, float(beta[i]), float(se[i]), t, t_sf2(t, dof), float(beta[i] - q * se[i]), float(beta[i] + q * se[i]), float(r2), float(adj), float(f), f_sf(float(f), k - 1, dof) if k > 1 else float("nan"), n))
    return df.sparkSession.createDataFrame(out, schema)
