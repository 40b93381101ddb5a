"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent between 0 (equal weights) and 1 (as they are).
The exponent is found by narrowing an interval of whole millionths: the largest at which the weights'
entropy reaches the target, or, if no source may be repeated so often, the smallest at which none is. Each
narrowing step is one aggregate over the source totals, so that sources needn't fit anywhere.

A source's budget is its weight of the whole. It is filled by whole permutations of the source's documents,
one an epoch, and by the beginning of one more. Tokens before a document are summed in two steps, within a
range of the permutation key and over the ranges' totals, so that a hot source isn't brought to one task.
The token offset in a source's stream gives the block; blocks have a bounded number of tokens, so ranking
inside a block is bounded, too.

Defined results: tokens are words, counted over whole texts of any length; a null source counts as the
source ''; a source without tokens has no weight and isn't in the mixture, but ``apply`` without a budget
returns its rows, equal ones once; documents without tokens are in each whole epoch; documents are ordered by a digest
of id and epoch, ties by id, then by a hash of the text; repeated rows are taken as often as they occur; an
empty table gives no rows; other columns aren't looked at, and ``apply`` returns them whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, partitions, prepare, unused

ENTROPY = 0.97  # of the largest possible
REPEATS = 4.0
BLOCK_TOKENS = 65_536
#: Documents that a range of the permutation should hold at most, on average.
RANGE_ROWS = 4096
MILLION = 1_000_000


def _at(totals: DataFrame, exponents: set[int]) -> dict[int, tuple[float, float]]:
    """For each exponent (in millionths) the weights' entropy and the most epochs of a source when every
    source is used at least once. One aggregate, a row for each source and exponent."""
    x = F.col("a") / MILLION
    u = F.pow("share", x)
    tried = totals.select("share", F.explode(F.array(*(F.lit(a) for a in sorted(exponents)))).alias("a"))
    sums = tried.groupBy("a").agg(F.sum(u).alias("z"), F.sum(u * F.log("share") * x).alias("e"), F.max(F.pow("share", x - 1)).alias("high"), F.min(F.pow("share", x - 1)).alias("low"))
    return {r["a"]: (math.log(r["z"]) - r["e"] / r["z"], r["high"] / r["low"]) for r in sums.collect()}  # a row for each exponent


def exponent(totals: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> int:
    """In millionths. ``totals``: share. The repetition limit comes before the entropy."""
    n = totals.count()
    if n < 2:
        return MILLION
    flat = few = 0  # the last that is flat enough, the last that repeats too often (0: perhaps none)
    for step in (10_000, 100, 1):
        near = [{a for a in range(low, min(MILLION, low + 100 * step) + 1, step)} for low in (flat, few)]
        found = _at(totals, near[0] | near[1])
        flat = max([flat, *(a for a in near[0] if found[a][0] >= entropy * math.log(n))])
        few = max([few, *(a for a in near[1] if found[a][1] > repeats)])
    return max(flat, min(MILLION, few + 1 if found[few][1] > repeats else few))


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, mark: Column | None = None) -> DataFrame:
    """One row for each use of a document: doc_id, source, mark (hash of the text), epoch, n_tokens, block,
    slot. Read by block and slot, it is the mixed stream. Without ``budget`` (in tokens) the whole is as
    small as it can be with each source used at least once, and so no document is left out. ``mark`` tells
    rows of one id apart, if not by text."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), (F.xxhash64(text) if mark is None else mark).alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens")).checkpoint()
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("rows")).where("total > 0").checkpoint()
    everything, rows = (x or 1 for x in sums.agg(F.sum("total"), F.sum("rows")).first())
    digits = max(2, math.ceil(math.log(rows / RANGE_ROWS, 16)))  # of the key, that name a range
    totals = sums.withColumn("share", F.col("total").cast("double") / F.lit(float(everything)))
    x = exponent(totals, entropy, repeats) / MILLION
    u = totals.withColumn("u", F.pow("share", F.lit(x)))
    z, cover = u.agg(F.sum("u"), F.max(F.col("total") / F.col("u"))).first()
    whole = float(budget) if budget is not None else (cover or 0.0) * (z or 0.0)
    n_blocks = max(1, math.ceil(whole / block_tokens))
    plan = u.select("source", "total", F.round(F.lit(whole) * F.col("u") / F.lit(z or 1.0)).cast("long").alias("budget"))
    plan = plan.select("*", F.expr("budget div total").alias("full"), (F.col("budget") % F.col("total")).alias("rest"))
    salts = partitions(docs.sparkSession)  # a hot source's rows meet as many copies of its one plan row
    salted = plan.where("budget > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    uses = tokens.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(salts)).cast("int")).join(salted, ["source", "salt"]).select("*", F.explode(F.expr("sequence(0L, if(rest > 0, full, full - 1))")).alias("epoch"))
    keyed = uses.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "epoch"))).withColumn("range", F.substring("key", 1, digits))
    ranges = keyed.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("n"))
    earlier = W.partitionBy("source", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("source", "epoch", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("source", "epoch", "range").orderBy("key", "doc_id", "mark").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(starts, ["source", "epoch", "range"]).withColumn("start", F.col("before") + F.col("inside"))
    used = placed.where("epoch < full or start < rest")
    offset = (F.col("epoch").cast("decimal(38,0)") * F.col("total") + F.col("start")).cast("decimal(28,0)")
    blocked = used.withColumn("block", F.least(F.expr(f"{n_blocks - 1}L"), F.floor(offset * F.lit(n_blocks) / F.col("budget")).cast("long")))
    order = W.partitionBy("block").orderBy("key", "doc_id", "mark")  # a block's tokens are bounded
    return blocked.select("doc_id", "source", "mark", "epoch", "n_tokens", "block", (F.row_number().over(order) - 1).cast("long").alias("slot"))


def apply(docs: DataFrame, budget: int | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture uses it."""
    own_doc, own_mark, own_source, times, k = unused(docs.columns, "doc", "mark", "source_name", "uses", "k")
    plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    mark = F.xxhash64(*plain)  # rows that are equal in all columns are one, used as often as they occur
    uses = mix(docs, budget, mark=mark, **options).groupBy(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias(own_doc), F.col("mark").alias(own_mark), F.col("source").alias(own_source)).agg(F.count("*").alias(times))
    own = docs.withColumns({own_doc: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), own_mark: mark, own_source: F.coalesce(F.col("source").cast("string"), F.lit(""))})
    key = [own_doc, own_mark, own_source]
    joined = own.dropDuplicates(key).join(uses, key, "left" if budget is None else "inner")
    return joined.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce(times, F.lit(1).cast("long"))))).select(*docs.columns)


#: The same result in SQL, for the default parameters.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), t AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM d GROUP BY source HAVING sum(n_tokens) > 0
), s AS (SELECT source, total, total::DOUBLE / (SELECT sum(total) FROM t)::DOUBLE AS share FROM t
), e1 AS (SELECT a, ln(sum(pow(share, a / 1e6))) - sum(pow(share, a / 1e6) * ln(share) * (a / 1e6)) / sum(pow(share, a / 1e6)) AS entropy, max(pow(share, a / 1e6 - 1)) / min(pow(share, a / 1e6 - 1)) AS reps FROM s, (SELECT unnest(range(0, 1000001, 1000)) AS a) GROUP BY a
), f1 AS (SELECT coalesce(max(a) FILTER (entropy >= {ENTROPY} * (SELECT ln(count(*)) FROM s)), 0) AS flat, coalesce(max(a) FILTER (reps > {REPEATS}), 0) AS few FROM e1
), e2 AS (SELECT a, ln(sum(pow(share, a / 1e6))) - sum(pow(share, a / 1e6) * ln(share) * (a / 1e6)) / sum(pow(share, a / 1e6)) AS entropy, max(pow(share, a / 1e6 - 1)) / min(pow(share, a / 1e6 - 1)) AS reps
  FROM s, (SELECT unnest(list_concat(range((SELECT flat FROM f1), least(1000001, (SELECT flat FROM f1) + 1001)), range((SELECT few FROM f1), least(1000001, (SELECT few FROM f1) + 1001)))) AS a) GROUP BY a
), x AS (SELECT CASE WHEN (SELECT count(*) FROM s) < 2 THEN 1000000 ELSE greatest(coalesce(max(a) FILTER (entropy >= {ENTROPY} * (SELECT ln(count(*)) FROM s)), 0), least(1000000, coalesce(max(a) FILTER (reps > {REPEATS}) + 1, 0))) END / 1e6 AS x FROM e2
), u AS (SELECT source, total, pow(share, x) AS u FROM s, x
), w AS (SELECT max(total / u) * sum(u) AS whole, sum(u) AS z FROM u
), p AS (SELECT source, total, round(whole * u / z)::BIGINT AS budget, greatest(1, ceil(whole / {BLOCK_TOKENS}))::BIGINT AS n_blocks FROM u, w
), k AS (SELECT *, md5(doc_id || ':' || epoch) AS key FROM (SELECT d.*, p.* EXCLUDE source, unnest(range(0, budget // total + CASE WHEN budget % total > 0 THEN 1 ELSE 0 END)) AS epoch FROM d JOIN p USING (source) WHERE budget > 0)
), c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k
), b AS (SELECT *, least(n_blocks - 1, ((epoch::HUGEINT * total + start) * n_blocks) // budget)::BIGINT AS block FROM c WHERE epoch < budget // total OR start < budget % total
)
SELECT doc_id, source, epoch, n_tokens, block, row_number() OVER (PARTITION BY block ORDER BY key, doc_id) - 1 AS slot FROM b
"""
