"""Removal of repeated runs of lines by content-defined chunks.

Lines are hashed, and a rolling hash over the last ``SPAN`` line hashes ends a chunk where it is zero
modulo ``EVERY``; a boundary hangs on nearby lines only, so inserted lines shift nothing further on.
Chunks with at least two lines that aren't blank are counted over the whole corpus by a 64-bit hash; the
bytes of those whose hash repeats are then compared with the first chunk's, and equal ones are removed.
A chunk's first occurrence, by doc_id and place, stays.

Counting moves one narrow row a chunk; those of a hot hash stay where they are and meet its first place by
broadcast (``common.hot_join``). The bytes of chunks with a repeated hash are compared by their least and
greatest value for each hash, combined in each task first, so a chunk in a third of all documents is moved
once a task. If any two differ, the chunks of those hashes are told apart by their bytes.

Defined results: null text counts as one empty line and comes back as empty; repeats within a document
count; rows that repeat both id and text count as one document and come back as often as they occur; a
null doc_id counts as the largest; which of several equal chunks is the first is settled by doc_id, a hash of
the text and the place; a text is cut whole, however long; an empty table gives no rows; other columns come
back unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import hot_join, per_batch, prepare, unused

SPAN, EVERY = 2, 3
BASE, PRIME = 1_000_003, (1 << 31) - 1
LAST = (1 << 63) - 1
LEAST_LINES = 2


def line_hash(line: str) -> int:
    return int(hashlib.md5(line.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)


def cut(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk."""
    h = [line_hash(x) for x in lines]
    ends = []
    for i in range(len(h)):
        rolled = 0
        for k in range(max(0, i - SPAN + 1), i + 1):
            rolled = (rolled * BASE + h[k]) % PRIME
        if rolled % EVERY == 0 or i == len(h) - 1:
            ends.append(i + 1)
    return list(zip([0, *ends], ends, strict=False))


def _is_run(lines: list[str]) -> bool:
    return sum(bool(x.strip(" \t\r\v\f")) for x in lines) >= LEAST_LINES


def _chunks(text: str):
    lines = text.split("\n")
    for no, (a, b) in enumerate(cut(lines)):
        if b - a >= LEAST_LINES and _is_run(lines[a:b]):
            yield no, "\n".join(lines[a:b]).encode("utf-8", "surrogatepass")


def _hashes(bits: int):
    def step(batch: pa.RecordBatch):
        rows = [((xxhash.xxh3_64_intdigest(data) >> 64 - bits) - (1 << 63), i, no) for i, t in enumerate(batch.column(2)) for no, data in _chunks(t.as_py())]
        if rows:
            h, at, no = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *(batch.column(k).take(pa.array(at)) for k in (0, 1)), pa.array(no, pa.int32())], names=["hash", "doc", "mark", "no"])

    return step


def repeated(plain: DataFrame, bits: int = 64) -> DataFrame:
    """``plain``: doc, mark (hash of the text), text -> (doc, mark, no): chunks to be removed, bytes compared.
    ``bits`` of a chunk's hash are used."""
    chunks = plain.mapInArrow(per_batch(lambda: _hashes(bits)), "hash long, doc long, mark long, no int").checkpoint()
    place = F.struct("doc", "mark", "no")
    often = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "n", "first").checkpoint()
    asked = hot_join(chunks, often, "hash", chunks.count()).select("hash", "doc", "mark", "no", (F.col("first") == place).alias("is_first")).checkpoint()
    by_document = asked.groupBy("doc", "mark").agg(F.collect_set(F.struct("no", "hash")).alias("asks"))  # of one document

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for i, (text, asks) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                wanted = {a["no"]: a["hash"] for a in asks.as_py()}
                rows += [(i, wanted[no], no, data) for no, data in _chunks(text.as_py()) if no in wanted]
            if rows:
                at, h, no, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in (0, 1)), pa.array(h, pa.int64()), pa.array(no, pa.int32()), pa.array(data, pa.binary())], names=["doc", "mark", "hash", "no", "data"])

        return step

    data = plain.join(by_document.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "mark", "text", "asks").mapInArrow(per_batch(make), "doc long, mark long, hash long, no int, data binary")
    differ = data.groupBy("hash").agg(F.min("data").alias("low"), F.max("data").alias("high")).where("low <> high").select("hash").checkpoint()
    later = asked.where("not is_first")
    if differ.isEmpty():
        return later.select("doc", "mark", "no")
    mixed = data.join(differ, "hash", "left_semi").checkpoint()  # two chunks of one 64-bit hash
    firsts = mixed.groupBy("hash", "data").agg(F.min(place).alias("first"))
    equal = mixed.join(firsts, ["hash", "data"]).where(F.col("first") != place).select("doc", "mark", "no")
    return later.join(differ, "hash", "left_anti").select("doc", "mark", "no").union(equal)


def remove_repeats(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with its columns and the repeated chunks taken out of ``text``; with ``counts`` also
    ``n_lines`` and ``n_removed`` (which replace columns of that name)."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    own = docs.drop("n_lines", "n_removed") if counts else docs
    doc, mark, no = unused(own.columns, "doc", "mark", "gone")
    gone = repeated(plain).groupBy("doc", "mark").agg(F.collect_set("no").alias("no")).checkpoint().toDF(doc, mark, no)  # of one document
    keyed = own.withColumns({"text": text, doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), mark: F.xxhash64(text)})
    joined = keyed.join(gone.hint("shuffle_hash"), [doc, mark], "left").select(*own.columns, no)
    at = own.columns.index("text")
    schema = T.StructType([*own.schema.fields, *([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())] if counts else [])])

    def make():
        def step(batch: pa.RecordBatch):
            texts, lines_in, lines_out = [], [], []
            for text, gone in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                lines = text.as_py().split("\n")
                lines_in.append(len(lines))
                if gone.is_valid:
                    out = set(gone.as_py())
                    lines = [x for no, (a, b) in enumerate(cut(lines)) if no not in out for x in lines[a:b]]
                lines_out.append(lines_in[-1] - len(lines))
                texts.append("\n".join(lines))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.string())
            extra = [pa.array(lines_in, pa.int64()), pa.array(lines_out, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=schema.names)

        return step

    return joined.mapInArrow(per_batch(make), schema)


#: The same result in SQL, on chunks grouped by their text.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, no, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents)
), r AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) % {PRIME} * {BASE} + h) % {PRIME} % {EVERY} = 0 AS ends FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no)
), c AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r
), g AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY no) AS body, count(*) AS n, count(*) FILTER (trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS solid FROM c GROUP BY ALL
), m AS (
  SELECT *, n >= {LEAST_LINES} AND solid >= {LEAST_LINES} AND row_number() OVER (PARTITION BY body, n >= {LEAST_LINES} AND solid >= {LEAST_LINES} ORDER BY doc_id, chunk) > 1 AS gone FROM g
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS text
FROM m GROUP BY doc_id
"""
