"""Quality classification by hierarchical empirical Bayes over sites.

A document's own evidence is a logistic model of its text statistics. The
documents of a path, the paths of a host and the hosts of the corpus then lend
it strength: each level's mean quality has a Beta posterior whose prior is
centred on the level above, with a strength found by moments from how much sites
differ beyond chance. Sparse sites so shrink to the global prior, rich ones speak
for themselves. All documents count, in grouped sums only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clumpwise.llm.decision_lists import FEATURES, SAMPLE, labelled, statistics
from clumpwise.llm.linear import fit_logistic
from clumpwise.llm.textops import cut, stored

#: What the evidence of a site weighs against a document's own.
SITE_WEIGHT = 0.5
#: Most sites that are broadcast (under 20 MB).
SENT = 100_000
#: Bounds of a prior's strength, in documents.
STRENGTH = (2.0, 10_000.0)


def _own_evidence(x: np.ndarray, y: np.ndarray) -> Column:
    """P(good) of a document by its statistics, as an expression."""
    x = np.log1p(100 * x)
    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(len(FEATURES))
    w = fit_logistic((x - mean) / scale, y)
    z = F.lit(float(w[-1]))
    for k, f in enumerate(FEATURES.values()):
        z = z + float(w[k]) * (F.log1p(100 * F.expr(f).cast("double")) - float(mean[k])) / float(scale[k])
    return 1 / (1 + F.exp(-z))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, centre: Column) -> float:
    """The prior's weight in documents, by moments: sites' spread about ``centre`` beyond that of their documents."""
    m, c = F.col("s") / F.col("n"), centre
    found = sites.where("n > 1").agg(
        F.sum(F.col("n") * (m - c) * (m - c)).alias("between"),
        F.sum((F.col("q") - F.col("n") * m * m) / (F.col("n") - 1)).alias("noise"),
        F.sum("n").alias("n"),
        F.sum(c * (1 - c)).alias("unit"),
        F.count("*").alias("k"),
    ).first()
    if not found["k"]:
        return STRENGTH[1]
    spread = (found["between"] - found["noise"]) / found["n"]
    if spread <= 0:
        return STRENGTH[1]
    return float(np.clip(found["unit"] / found["k"] / spread - 1, *STRENGTH))


def site_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE
) -> DataFrame:
    """The columns ``keep`` of every row with p_own, p_host, p_path, p_good and kept.

    ``host`` and ``path`` are expressions over ``docs``; a path belongs to its host, null
    sites are sites of their own. p_host and p_path are of the other documents of
    the row's host and path. ``kept``: p_good of at least 1/2. Texts without
    words have their own statistics (all nought), repeated rows stay, labels that
    fit no row are ignored and without labels every p_own is 1/2.
    """
    own = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, own, strict=True)], "doc_id", "text", host.cast("string").alias("_host"), path.cast("string").alias("_path"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("\u0000")) for c in ("_host", "_path")})
    # one pass over the texts; the table is read for its narrow columns twice and in full once
    stats = stored(statistics(rows, ["doc_id", "_host", "_path", *own]))
    evidence = _own_evidence(*labelled(stats, labels, "quality", sample)).alias("p")
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = cut(stats.select("_host", "_path", evidence).groupBy("_host", "_path").agg(*sums))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    base = float((total["s"] or 0.0) + 0.5) / float((total["n"] or 0) + 1)
    k = _strength(hosts, F.lit(base))
    hosts = hosts.select("_host", F.col("n").alias("hn"), F.col("s").alias("hs"), _posterior("s", "n", k, F.lit(base)).alias("p_host"))
    under = cut(paths.join(cut(hosts), "_host"))
    j = _strength(under, F.col("p_host"))
    sites = under.select("_host", "_path", "n", "s", "hn", "hs")
    if sites.count() <= SENT:  # else the rows are dealt by site
        sites = F.broadcast(sites)
    # a document's own evidence is taken out of its sites', so that it counts once
    others = stats.select("_host", "_path", *own, evidence).join(sites, ["_host", "_path"])
    others = others.withColumn("p_host", _posterior(F.col("hs") - F.col("p"), F.col("hn") - 1, k, F.lit(base)))
    others = others.withColumn("p_path", _posterior(F.col("s") - F.col("p"), F.col("n") - 1, j, F.col("p_host")))
    z = _logit(F.col("p")) + SITE_WEIGHT * (_logit(F.col("p_path")) - _logit(F.lit(base)))
    found = others.withColumn("p_good", 1 / (1 + F.exp(-z)))
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], F.col("p").alias("p_own"), "p_host", "p_path", "p_good", (F.col("p_good") >= 0.5).alias("kept"))


def _posterior(s: Column | str, n: Column | str, weight: float, centre: Column) -> Column:
    """The mean of a Beta posterior: n documents of total evidence s under a prior of ``weight`` documents."""
    s, n = (F.col(c) if isinstance(c, str) else c for c in (s, n))
    return (s + weight * centre) / (n + weight)
