"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared as sets.

Words are runs of letters and digits, lower case. Each occurrence of an anchor gives one signature: the
anchor and the next ``CHAIN`` content words, other anchors skipped (fewer at a text's end, but one at
least). A fingerprint is the sorted set of the signatures' digests, eight hex digits each. A text without
any signature has its whole word sequence as its one signature, so that it is like equal texts only.

All of it is SQL functions: a text is marked, joined and rewritten by one regular expression that puts
the chain beside each anchor, so no array is indexed from inside a lambda.

Likeness is the Jaccard coefficient of two sets. ``near_duplicates`` compares sets only within and between
neighbouring ranges of set length, by their rarest signatures, and verifies the length bound, then the
exact coefficient.

Defined results: null text counts as empty (fingerprint of the empty word sequence); a text is fingerprinted
whole, however long; signatures are sorted by digest, equal ones are one; rows that repeat both
id and text count as one document in the order of documents and come back as often as they occur; rows
that share an id only are ordered by a hash of the text; a null id is the smallest; with one document the
next one is itself; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, prepare
from lumenframe.llm.graph import link_by_keys

#: Common words of four languages. Fixed values.
ANCHORS = (
    "a an and are as at be by for from he in is it not of on or that the this to was with you "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auf das dem den der des die ein eine es für ich im in ist mit nicht sich sie und von zu "
    "al como con del el en es la las lo los más no para por que se su un una y"
).split()
CHAIN = 2
ALIKE = 0.8
#: Stands for a null id in the order of documents.
NO_ID = -(1 << 63)
#: Parts into which the order of ids is cut; a bound for what the driver sees of it.
SPLITS = 200

_MARK, _OPEN, _CLOSE = "\x01", "\x02", "\x03"


def signatures(text: Column, anchors: tuple[str, ...] | list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    plain = F.array_join(words, " ")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(*sorted(set(anchors))), F.concat(F.lit(_MARK), w)).otherwise(w)), " ")
    skip = rf"(?: {_MARK}[^ ]+)*+"
    follow = rf"{skip} ([^ {_MARK}][^ ]*)" + "".join(rf"(?:{skip} ([^ {_MARK}][^ ]*))?" for _ in range(chain - 1))
    beside = F.regexp_replace(marked, rf"{_MARK}([^ ]+)(?={follow})", F.lit(_OPEN + "$1" + "".join(f" ${k + 2}" for k in range(chain)) + _CLOSE))
    digest = lambda x: F.substring(F.md5(x), 1, 8)
    chains = F.array_compact(F.transform(F.split(beside, _OPEN), lambda p: F.when(F.contains(p, F.lit(_CLOSE)), digest(F.substring_index(p, _CLOSE, 1)))))
    # the lambda names the set, so that nothing before is worked out twice
    return F.transform(F.array(F.sort_array(F.array_distinct(chains))), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(digest(F.concat(F.lit("= "), plain)))))[0]


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b)).cast("double")
    return common / (F.size(a) + F.size(b) - common)


def order_of_documents(keys: DataFrame) -> DataFrame:
    """Distinct (doc, mark, n_chars) -> with ``rank`` from 0 by descending doc, then mark, their number ``of``
    and how many rows are such (``rows``). Ranks are counted within ranges of ids whose bounds are at most
    SPLITS approximate quantiles."""
    keys = keys.groupBy("doc", "mark", "n_chars").agg(F.count("*").alias("rows")).checkpoint()
    cuts = keys.agg(F.percentile_approx("doc", [k / SPLITS for k in range(1, SPLITS)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("doc"))) if cuts else F.lit(0)
    parted = keys.withColumn("part", part)
    sizes = {r["part"]: r["n"] for r in parted.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most SPLITS rows
    before, starts = 0, {}
    for p in sorted(sizes, reverse=True):
        starts[p], before = before, before + sizes[p]
    start = F.element_at(F.array(*(F.lit(starts.get(p, 0)).cast("long") for p in range(len(cuts) + 1))), F.col("part") + 1)
    own = F.row_number().over(W.partitionBy("part").orderBy(F.desc("doc"), F.desc("mark")))
    return parted.withColumn("rank", start + own - 1).drop("part").withColumn("of", F.lit(before).cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and their likeness to these and to the next ones."""
    prepare(docs.sparkSession)
    text = documents(docs).withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "mark": F.xxhash64("text")})
    ranked = order_of_documents(text.select("doc", "mark", F.length("text").cast("long").alias("n_chars"))).checkpoint()
    before = ranked.select(((F.col("rank") + 1) % F.col("of")).alias("rank"), F.col("doc").alias("to_doc"), F.col("mark").alias("to_mark"), F.floor(F.col("n_chars") / 2).cast("int").alias("take"))
    heirs = ranked.join(before, "rank").select("doc", "mark", "to_doc", "to_mark", "take")  # whose text goes to which document
    # one exchange of the texts and their sets (four bytes a signature), used twice: both sides take the same columns
    dealt = text.select("doc", "mark", "text", F.unhex(F.array_join(signatures(F.col("text")), "")).alias("set")).repartition("doc", "mark")
    given = dealt.join(heirs.hint("shuffle_hash"), ["doc", "mark"])
    if (ranked.agg(F.max("rows")).first()[0] or 0) > 1:  # repeated rows give their text once
        given = given.dropDuplicates(["to_doc", "to_mark"])
    # what goes on to the document before: as much of the text as it takes, and the set
    heads = given.select(F.col("to_doc").alias("doc"), F.col("to_mark").alias("mark"), F.substring("text", F.lit(1), F.col("take")).alias("head"), F.col("set").alias("next_set"))
    n = F.length("text")
    hexed = lambda c: F.lower(F.hex(c))
    unpacked = lambda c: F.regexp_extract_all(F.col(c), F.lit(".{8}"), F.lit(0))
    edited = (
        dealt.join(heads.hint("shuffle_hash"), ["doc", "mark"])
        .select("doc", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "head").alias("edited"), hexed("set").alias("fingerprint"), hexed("next_set").alias("next_print"))
        .select("*", signatures(F.col("edited")).alias("edited_sigs"), unpacked("fingerprint").alias("sigs"), unpacked("next_print").alias("next_sigs"))
    )
    return edited.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", F.array_join("edited_sigs", "").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """doc_id, class_id (smallest doc_id whose set is reached by links of likeness ``alike`` or more).

    Equal sets are one node. A node's keys are its rarest signatures (as many as any set that is alike must
    share one of) beside its length range and the next one; longer and shorter sets never meet.
    """
    prepare(docs.sparkSession)
    made = documents(docs).select("doc_id", signatures(F.col("text")).alias("sigs")).withColumn("node", F.xxhash64(F.array_join("sigs", ""))).checkpoint()
    sets = made.groupBy("node").agg(F.first("sigs").alias("sigs"), F.min("doc_id").alias("low")).withColumn("n", F.size("sigs")).checkpoint()
    flat = sets.select("node", "n", F.explode("sigs").alias("sig"))
    ordered = flat.join(flat.groupBy("sig").agg(F.count("*").alias("df")), "sig").withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("df", "sig")))
    rare = ordered.where(F.col("k") <= F.col("n") - F.ceil(F.lit(alike) * F.col("n") - 1e-9) + 1)
    span = F.floor(F.log("n") / math.log(1 / alike) + 1e-9).cast("int") if alike < 1 else F.col("n")
    keys = rare.select(F.col("node"), F.explode(F.array(span, span + 1)).alias("range"), "sig").select("node", F.xxhash64("sig", "range").alias("key"))

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("src"), F.col("sigs").alias("a"), F.col("n").alias("na"))
        b = sets.select(F.col("node").alias("dst"), F.col("sigs").alias("b"), F.col("n").alias("nb"))
        sized = pairs.distinct().join(a, "src").join(b, "dst").where(F.least("na", "nb") >= F.lit(alike) * F.greatest("na", "nb") - 1e-9)
        return sized.where(likeness(F.col("a"), F.col("b")) >= alike - 1e-12).select("src", "dst")

    roots = link_by_keys(keys.distinct(), verify).withColumnRenamed("component", "root")
    named = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("low").alias("class_id"))
    return made.select("doc_id", "node").join(named.join(ids, "root").select("node", "class_id"), "node").select("doc_id", "class_id")


_in = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))


def _sql_sets(source: str, key: str, column: str) -> str:
    """SQL for (key, sigs) over a relation with a text column."""
    return f"""
  SELECT {key}, CASE WHEN count(sig) > 0 THEN list_sort(list_distinct(list(sig) FILTER (sig IS NOT NULL))) ELSE [substr(md5('= ' || coalesce(any_value(plain), '')), 1, 8)] END AS sigs
  FROM (
    SELECT {key}, plain, CASE WHEN anchor AND c1 IS NOT NULL THEN substr(md5(w || ' ' || c1 || ' ' || coalesce(c2, '')), 1, 8) END AS sig
    FROM (
      SELECT o.{key}, o.plain, o.w, o.anchor, content[o.before + 1] AS c1, content[o.before + 2] AS c2
      FROM (
        SELECT *, (sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i))::BIGINT AS before
        FROM (SELECT {key}, plain, unnest(words) AS w, generate_subscripts(words, 1) AS i, unnest(words) IN ({_in}) AS anchor
              FROM (SELECT {key}, words, array_to_string(words, ' ') AS plain FROM (SELECT {key}, list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM {source})))
      ) o JOIN (SELECT {key} AS ck, list_filter(list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: x NOT IN ({_in})) AS content FROM {source}) ON ck = {key}
    )
    UNION ALL SELECT {key}, '', NULL FROM {source} WHERE NOT regexp_matches({column}, '[\\p{{L}}\\p{{N}}]')
  ) GROUP BY {key}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT doc_id, n, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), x AS (SELECT doc_id, n, next_id, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS edited FROM e
), s AS ({_sql_sets("d", "doc_id", "text")}
), t AS ({_sql_sets("x", "doc_id", "edited")}
)
SELECT x.doc_id, x.n::BIGINT AS n_chars, sha256(x.edited) AS edited_sha256, array_to_string(s.sigs, '') AS fingerprint, array_to_string(t.sigs, '') AS edited_fingerprint,
  len(list_intersect(s.sigs, t.sigs))::DOUBLE / (len(s.sigs) + len(t.sigs) - len(list_intersect(s.sigs, t.sigs))) AS near_edited,
  len(list_intersect(s.sigs, u.sigs))::DOUBLE / (len(s.sigs) + len(u.sigs) - len(list_intersect(s.sigs, u.sigs))) AS near_next
FROM x JOIN s USING (doc_id) JOIN t USING (doc_id) JOIN s AS u ON u.doc_id = x.next_id
"""

#: The classes of ``near_duplicates`` from all pairs.
CLASSES = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), s AS MATERIALIZED ({_sql_sets("d", "doc_id", "text")}
), p AS MATERIALIZED (
  SELECT a.doc_id AS src, b.doc_id AS dst FROM s a JOIN s b ON a.doc_id <> b.doc_id AND least(len(a.sigs), len(b.sigs)) >= {ALIKE} * greatest(len(a.sigs), len(b.sigs)) - 1e-9
  WHERE len(list_intersect(a.sigs, b.sigs))::DOUBLE / (len(a.sigs) + len(b.sigs) - len(list_intersect(a.sigs, b.sigs))) >= {ALIKE} - 1e-12
), c AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT p.dst, c.root FROM c JOIN p ON p.src = c.node WHERE c.root < p.dst
)
SELECT node AS doc_id, min(root) AS class_id FROM c GROUP BY node
"""
