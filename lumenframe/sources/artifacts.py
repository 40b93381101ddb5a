"""Result files: canonical JSON, metric tables, array archives, manifests, a gate over source trees, a small picture.

Files are written once, byte for byte alike for the same values, so that two builds can be compared by hash.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.plans.status import STATUSES

DIGITS = 17


def canonical_json(value) -> str:
    """Sorted keys, two spaces, no NaN, a line feed at the end."""
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False, default=lambda v: v.item() if isinstance(v, np.generic) else v.tolist()) + "\n"


def write_metrics(frame: DataFrame, path: str, keys: list[str]) -> None:
    """CSV in order of ``keys``; doubles with as many digits as tell them apart. What isn't finite is an error."""
    doubles = [f.name for f in frame.schema.fields if f.dataType.simpleString() == "double"]
    checked = frame.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.raise_error(F.lit(f"{c} isn't finite"))).otherwise(F.col(c)).cast("string") for c in doubles})
    checked.repartitionByRange(*keys).sortWithinPartitions(*keys).write.csv(path, header=True, nullValue="", mode="overwrite")


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """An archive of arrays in order of name, without times of writing, so that equal arrays give equal bytes."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name in sorted(arrays):
            data = io.BytesIO()
            np.lib.format.write_array(data, np.ascontiguousarray(arrays[name]), allow_pickle=False)
            entry = zipfile.ZipInfo(f"{name}.npy", (1980, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_DEFLATED
            out.writestr(entry, data.getvalue())


def load_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, name, index, value: entries of all archives below ``path``, in C order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)

    def run(batches):
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(data), allow_pickle=False) as held:
                    for name in held.files:
                        flat = held[name].astype(float).ravel()
                        for at in range(0, len(flat), 65_536):
                            part = flat[at : at + 65_536]
                            yield pa.RecordBatch.from_arrays([pa.array([where] * len(part)), pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["path", "name", "index", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, index long, value double")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each ``manifest.json`` below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").load(path)
    return files.select("path", F.col("content").cast("string").alias("text"))


def manifest_hashes(found: DataFrame) -> DataFrame:
    """path, file, sha256 of the hashes that a manifest states, in any of three layouts, the first there is."""
    plain = "map<string,string>"
    layouts = F.coalesce(
        F.from_json(F.get_json_object("text", "$.files_sha256"), plain), F.from_json(F.get_json_object("text", "$.artifact_hashes_sha256"), plain),
        F.transform_values(F.from_json(F.get_json_object("text", "$.artifacts"), "map<string,struct<sha256:string>>"), lambda _, v: v["sha256"]),
    )
    return found.select("path", F.explode(layouts).alias("file", "sha256"))


def benchmark_names(found: DataFrame) -> DataFrame:
    """path, name: by object_id, else benchmark, else the artifact's id or benchmark, else the folder's name."""
    at = lambda p: F.get_json_object("text", p)
    folder = F.element_at(F.split("path", "/"), -2)
    return found.select("path", F.coalesce(at("$.object_id"), at("$.benchmark"), at("$.artifact.object_id"), at("$.artifact.benchmark"), folder).alias("name"))


def tree_gate(spark: SparkSession, path: str, required: tuple[str, ...] = ("results.csv", "diagnostics.json", "manifest.json"), columns: tuple[str, ...] = ("row_key", "status")) -> DataFrame:
    """folder, problem: what keeps a folder of results from being taken. Files that must be there, maturity and status
    of its manifest, hashes, columns, statuses outside the vocabulary, and status counts against the diagnostics."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))
    files = files.where(F.col("file").rlike(r"\.(csv|json)$"))
    folders = files.select("folder").distinct()
    need = folders.select("folder", F.explode(F.array(*(F.lit(r) for r in required))).alias("file")).join(files.select("folder", "file"), ["folder", "file"], "left_anti")
    found = files.where("file = 'manifest.json'").withColumn("path", F.concat_ws("/", F.lit(""), "folder", F.lit("manifest.json")))
    grade = found.where(~(F.coalesce(F.get_json_object("text", "$.maturity"), F.lit("")) == "L1") | ~(F.coalesce(F.get_json_object("text", "$.status"), F.lit("")) == "stable")).select("folder", F.lit("maturity_or_status").alias("problem"))
    stated = manifest_hashes(found).select(F.element_at(F.split("path", "/"), -2).alias("folder"), "file", F.col("sha256").alias("stated"))
    changed = stated.join(files.select("folder", "file", "sha256"), ["folder", "file"], "left").where("sha256 is null or sha256 <> stated").select("folder", F.concat(F.lit("hash_"), "file").alias("problem"))
    results = files.where("file = 'results.csv'").select("folder", F.split("text", "\r?\n").alias("lines"))
    header = results.select("folder", F.split(F.col("lines")[0], ",").alias("header"), "lines")
    lacking = header.select("folder", F.explode(F.array_except(F.array(*(F.lit(c) for c in columns)), "header")).alias("c")).select("folder", F.concat(F.lit("column_"), "c").alias("problem"))
    at = F.array_position("header", "status").cast("int")
    rows = header.where(at > 0).select("folder", at.alias("at"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line")).where("line <> ''")
    status = rows.select("folder", F.split("line", ",")[F.col("at") - 1].alias("status")).groupBy("folder", "status").agg(F.count("*").alias("n"))
    unknown = status.where(~F.col("status").isin(*STATUSES)).select("folder", F.concat(F.lit("status_"), "status").alias("problem"))
    said = files.where("file = 'diagnostics.json'").select("folder", F.explode(F.from_json(F.get_json_object("text", "$.status_counts"), "map<string,long>")).alias("status", "said"))
    counts = said.join(status, ["folder", "status"], "full").where(F.coalesce("said", F.lit(0)) != F.coalesce("n", F.lit(0))).select("folder", F.concat(F.lit("count_"), "status").alias("problem"))
    return need.select("folder", F.concat(F.lit("missing_"), "file").alias("problem")).unionByName(grade).unionByName(changed).unionByName(lacking).unionByName(unknown).unionByName(counts)


def artifact_problems(folder: str, stated: dict[str, str]) -> list[str]:
    """Of one folder: files that are missing, unexpected or changed, in order."""
    own = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).iterdir() if p.is_file()}
    return sorted([f"missing {n}" for n in stated.keys() - own.keys()] + [f"unexpected {n}" for n in own.keys() - stated.keys()] + [f"changed {n}" for n in own.keys() & stated.keys() if own[n] != stated[n]])


def draw_bars(path: str, values: list[float], width: int = 640, height: int = 240) -> None:
    """A picture of values between 0 and 1 as bars, as a PNG file of eight-bit greys."""
    image = np.full((height, width), 255, np.uint8)
    each = max(1, width // max(1, len(values)))
    for k, v in enumerate(values):
        top = height - round(min(max(v, 0.0), 1.0) * (height - 1)) - 1
        image[top:, k * each + 1 : (k + 1) * each - 1] = 90
    raw = np.pad(image, ((0, 0), (1, 0))).tobytes()  # a filter byte 0 before each line

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b""))
