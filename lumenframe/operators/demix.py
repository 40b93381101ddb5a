"""Demixing of labelled trials: variance fractions, axes of each marginal, shuffles of labels, pseudo-populations.

A trial is a labelled document; its two factors are ``quality`` and ``toxic``, positions are languages. Shuffles are
orders by a digest of the shuffle's number and the trial's id, so that any partitioning gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.moments import _CELLS, cell_means, marginals
from lumenframe.sources.tables import table

SHUFFLES = 32
#: Ranges of digests within which rows are ranked; the ranges' counts are summed up.
RANGES = 65_536


def trials(spark, sf_dir) -> DataFrame:
    """doc_id, s, d, lang, x, y: size and blanks of each labelled document, as logarithms."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", F.log1p(F.col("n_chars").cast("double")).alias("x"), F.log1p(F.regexp_count("text", F.lit(" ")).cast("double")).alias("y"))
    return own.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("s"), F.col("toxic").cast("long").alias("d")), "doc_id")


def shuffled_rank(frame: DataFrame, group: list[str], digest: Column, out: str) -> DataFrame:
    """The place, from 1, of each row of a group in the order of a digest, without one task for a group: ranks are
    counted within ranges of the digest, and each range starts where those before it end."""
    own = frame.withColumn("__digest", digest).withColumn("__range", F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"))  # RANGES values
    n = own.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = n.select(*group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy(*group, "__range").orderBy("__digest"))
    return own.withColumn("__k", inside).join(starts, [*group, "__range"]).withColumn(out, F.col("__k") + F.col("__start")).drop("__digest", "__range", "__k", "__start", "__n")


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def variance_fractions(spark, sf_dir):
    """Each marginal's share of the energy of the centred cell means."""
    m = marginals(spark, sf_dir)
    parts = ("position", "stimulus", "decision", "interaction")
    e = m.agg(*(F.sum(F.pow(c, 2)).alias(c) for c in parts))
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    return e.select(*(F.round(F.col(c) / F.greatest(total, F.lit(1e-15)), 6).alias(c) for c in parts))


def _axes(spark, sf_dir) -> DataFrame:
    """lang, stimulus, decision, interaction: entries of each marginal's axis. With two levels a factor's marginal
    has rank one, so its leading direction is the vector of its contrasts over positions."""
    at = lambda s, d: F.max(F.when((F.col("quality") == s) & (F.col("toxic") == d), F.col("m")))
    w = cell_means(spark, sf_dir).groupBy("lang").agg(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("e"))
    return w.select("lang", F.expr("(c + e - a - b) / 4").alias("stimulus"), F.expr("(b + e - a - c) / 4").alias("decision"), F.expr("(e - c - b + a) / 4").alias("interaction"))


def marginal_axes(spark, sf_dir):
    """Each marginal's own direction over positions, of unit length, its first entry in order positive."""
    long = _axes(spark, sf_dir).select("lang", F.expr("stack(3, 'stimulus', stimulus, 'decision', decision, 'interaction', interaction) as (marginal, v)"))
    size = long.groupBy("marginal").agg(F.sqrt(F.sum(F.pow("v", 2))).alias("norm"), F.min_by("v", "lang").alias("head"))
    return long.join(size, "marginal").select("marginal", "lang", F.round(F.col("v") * F.when(F.col("head") < 0, -1.0).otherwise(1.0) / F.greatest("norm", F.lit(1e-15)), 6).alias("weight"))


def demixing_index(spark, sf_dir):
    """Energy of each true marginal through each marginal's axis, as a share of that axis's whole; the index is the
    share of its own."""
    names = ("stimulus", "decision", "interaction")
    a = _axes(spark, sf_dir)
    dots = a.agg(*(F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for p in names for q in names))
    energy = {(p, q): F.pow(f"{p}_{q}", 2) / F.greatest(F.col(f"{p}_{p}"), F.lit(1e-15)) for p in names for q in names}
    rows = [F.struct(F.lit(p).alias("axis"), *((energy[p, q] / F.greatest(sum((energy[p, r] for r in names), F.lit(0.0)), F.lit(1e-15))).alias(q) for q in names), (energy[p, p] / F.greatest(sum((energy[p, r] for r in names), F.lit(0.0)), F.lit(1e-15))).alias("index")) for p in names]
    return dots.select(F.explode(F.array(*rows)).alias("r")).select("r.axis", *(F.round(f"r.{c}", 6).alias(c) for c in (*names, "index")))


def averaging_mismatch(spark, sf_dir):
    """Reconstruction of single trials from their cell's mean: the error of trials, and the share of their variance
    that means keep, by position."""
    t = trials(spark, sf_dir)
    cells = t.groupBy("lang", "s", "d").agg(F.avg("x").alias("m"))
    joined = t.join(cells, ["lang", "s", "d"])
    g = joined.groupBy("lang").agg(F.avg(F.pow(F.col("x") - F.col("m"), 2)).alias("left"), F.var_pop("x").alias("var"))
    return g.select("lang", F.round("left", 7).alias("trial_mse"), F.round(1 - F.col("left") / F.greatest("var", F.lit(1e-15)), 6).alias("kept"))


def label_pair_shuffle(spark, sf_dir, number: int = 1):
    """Pairs of labels dealt to other trials as pairs; counts of the cells before and after are alike."""
    t = shuffled_rank(trials(spark, sf_dir).withColumn("one", F.lit(1)), ["one"], _digest(0, F.col("doc_id").cast("string")), "k")
    given = shuffled_rank(trials(spark, sf_dir).withColumn("one", F.lit(1)), ["one"], _digest(number, F.col("doc_id").cast("string")), "k").select("k", F.col("s").alias("new_s"), F.col("d").alias("new_d"))
    return t.join(given, "k").select("doc_id", "s", "d", "new_s", "new_d")


def label_null(spark, sf_dir, shuffles: int = SHUFFLES):
    """The gap between the factor's means against its gaps under shuffled labels: quantiles of the null, and how
    many are as large. A shuffle labels the first n1 trials in its own order."""
    t = trials(spark, sf_dir).select("doc_id", "s", "x")
    n = t.agg(F.sum("s").alias("n1"), F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("s")).alias("s1"))
    tries = t.select("doc_id", "x", F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("shuffle"))
    ranked = shuffled_rank(tries, ["shuffle"], _digest(F.col("shuffle").cast("string"), F.col("doc_id").cast("string")), "k").crossJoin(F.broadcast(n))  # one row
    gap = lambda s1: F.abs(s1 / F.col("n1") - (F.col("sx") - s1) / (F.col("n") - F.col("n1")))
    null = ranked.where("k <= n1").groupBy("shuffle", "n1", "n", "sx", "s1").agg(F.sum("x").alias("in1")).select("shuffle", gap(F.col("in1")).alias("gap"), gap(F.col("s1")).alias("real"))
    q = null.agg(F.max("real").alias("real"), F.percentile("gap", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.count_if(F.col("gap") >= F.col("real") - 1e-12).alias("exceeding"))  # a row for each shuffle
    return q.select(F.round("real", 6).alias("gap"), *(F.round(F.col("q")[k], 6).alias(c) for k, c in enumerate(("null_low", "null_median", "null_high"))), "exceeding")


def pseudo_population(spark, sf_dir):
    """Trials put together from features that were never seen at once: within a cell each feature's trials take an
    order of their own, and those of one place make one trial. The features' covariance in a cell, before and after."""
    t = trials(spark, sf_dir)
    cell = ["s", "d"]
    a = shuffled_rank(t.select("doc_id", *cell, "x"), cell, _digest("x", F.col("doc_id").cast("string")), "k").drop("doc_id")
    b = shuffled_rank(t.select("doc_id", *cell, "y"), cell, _digest("y", F.col("doc_id").cast("string")), "k").drop("doc_id")
    made = a.join(b, [*cell, "k"]).groupBy(*cell).agg(F.count("*").alias("n"), F.round(F.covar_pop("x", "y"), 5).alias("shuffled"))
    return made.join(t.groupBy(*cell).agg(F.round(F.covar_pop("x", "y"), 5).alias("together")), cell)


QUERIES = {f.__name__: f for f in (variance_fractions, marginal_axes, demixing_index, averaging_mismatch, label_pair_shuffle, label_null, pseudo_population)}

_PARTS = f"{_CELLS}, k AS (SELECT *, avg(m) OVER () AS grand, avg(m) OVER (PARTITION BY lang) AS t, avg(m) OVER (PARTITION BY lang, quality) AS s, avg(m) OVER (PARTITION BY lang, toxic) AS d FROM c), e AS (SELECT sum(pow(t - grand, 2)) AS position, sum(pow(s - t, 2)) AS stimulus, sum(pow(d - t, 2)) AS decision, sum(pow(m - s - d + t, 2)) AS interaction FROM k)"
_AXIS = f"{_CELLS}, h AS (SELECT lang, max(m) FILTER (quality = 0 AND toxic = 0) AS a, max(m) FILTER (quality = 0 AND toxic = 1) AS b, max(m) FILTER (quality = 1 AND toxic = 0) AS c, max(m) FILTER (quality = 1 AND toxic = 1) AS e FROM c GROUP BY lang), w AS (SELECT lang, (c + e - a - b) / 4 AS stimulus, (b + e - a - c) / 4 AS decision, (e - c - b + a) / 4 AS interaction FROM h)"
_TRIALS = "t AS (SELECT doc_id, quality::BIGINT AS s, toxic::BIGINT AS d, lang, ln(1 + n_chars) AS x, ln(1 + length(text) - length(replace(text, ' ', ''))) AS y FROM documents JOIN labels USING (doc_id))"
_DOT = ", ".join(f"sum({p} * {q}) AS {p}_{q}" for p in ("stimulus", "decision", "interaction") for q in ("stimulus", "decision", "interaction"))


def _share(p: str) -> str:
    of = {q: f"pow({p}_{q}, 2) / greatest({p}_{p}, 1e-15)" for q in ("stimulus", "decision", "interaction")}
    whole = f"greatest({' + '.join(of.values())}, 1e-15)"
    return f"SELECT '{p}' AS axis, " + ", ".join(f"round({e} / {whole}, 6) AS {q}" for q, e in of.items()) + f", round({of[p]} / {whole}, 6) AS index FROM o"


ORACLES = {
    "variance_fractions": f"WITH {_PARTS} SELECT " + ", ".join(f"round({c} / greatest(position + stimulus + decision + interaction, 1e-15), 6) AS {c}" for c in ("position", "stimulus", "decision", "interaction")) + " FROM e",
    "marginal_axes": f"WITH {_AXIS}, l AS (SELECT lang, 'stimulus' AS marginal, stimulus AS v FROM w UNION ALL SELECT lang, 'decision', decision FROM w UNION ALL SELECT lang, 'interaction', interaction FROM w), z AS (SELECT marginal, sqrt(sum(v * v)) AS norm, arg_min(v, lang) AS head FROM l GROUP BY marginal) SELECT marginal, lang, round(v * CASE WHEN head < 0 THEN -1.0 ELSE 1.0 END / greatest(norm, 1e-15), 6) AS weight FROM l JOIN z USING (marginal)",
    "demixing_index": f"WITH {_AXIS}, o AS (SELECT {_DOT} FROM w) " + " UNION ALL ".join(_share(p) for p in ("stimulus", "decision", "interaction")),
    "averaging_mismatch": f"WITH {_TRIALS}, m AS (SELECT *, avg(x) OVER (PARTITION BY lang, s, d) AS m FROM t) SELECT lang, round(avg((x - m) * (x - m)), 7) AS trial_mse, round(1 - avg((x - m) * (x - m)) / greatest(var_pop(x), 1e-15), 6) AS kept FROM m GROUP BY lang",
    "label_pair_shuffle": f"WITH {_TRIALS}, a AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || doc_id)) AS k FROM t), b AS (SELECT s, d, row_number() OVER (ORDER BY md5('1:' || doc_id)) AS k FROM t) SELECT a.doc_id, a.s, a.d, b.s AS new_s, b.d AS new_d FROM a JOIN b USING (k)",
    "label_null": f"WITH {_TRIALS}, n AS (SELECT sum(s) AS n1, count(*) AS n, sum(x) AS sx, sum(x) FILTER (s = 1) AS s1 FROM t), r AS (SELECT shuffle, x, row_number() OVER (PARTITION BY shuffle ORDER BY md5(shuffle || ':' || doc_id)) AS k FROM t, range(1, {SHUFFLES + 1}) q(shuffle)), g AS (SELECT shuffle, sum(x) AS in1 FROM r, n WHERE k <= n1 GROUP BY shuffle), z AS (SELECT abs(in1 / n1 - (sx - in1) / (n - n1)) AS gap, abs(s1 / n1 - (sx - s1) / (n - n1)) AS real FROM g, n) SELECT round(max(real), 6) AS gap, round(quantile_cont(gap, 0.025), 6) AS null_low, round(quantile_cont(gap, 0.5), 6) AS null_median, round(quantile_cont(gap, 0.975), 6) AS null_high, count(*) FILTER (gap >= real - 1e-12) AS exceeding FROM z",
    "pseudo_population": f"WITH {_TRIALS}, a AS (SELECT s, d, x, row_number() OVER (PARTITION BY s, d ORDER BY md5('x:' || doc_id)) AS k FROM t), b AS (SELECT s, d, y, row_number() OVER (PARTITION BY s, d ORDER BY md5('y:' || doc_id)) AS k FROM t), p AS (SELECT s, d, count(*) AS n, round(covar_pop(x, y), 5) AS shuffled FROM a JOIN b USING (s, d, k) GROUP BY s, d) SELECT p.*, together FROM p JOIN (SELECT s, d, round(covar_pop(x, y), 5) AS together FROM t GROUP BY s, d) USING (s, d)",
}
