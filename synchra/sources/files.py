"""File sources and sinks: parquet, text matrices, NPY and MAT arrays, NIfTI volumes, BIDS tables.

Files are listed and read by Spark (``binaryFile`` or text), so they may be in any store it reads, and
each is decoded by the task that holds its bytes.  One file is one recording and fits in a task.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SUBJECT = r"(sub-[^/_.]+)"


def find_subjects(spark: SparkSession, root: str) -> DataFrame:
    """``subj``: sorted distinct ``sub-...`` names among the paths below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", _SUBJECT, 1).alias("subj")).where("subj <> ''").distinct().orderBy("subj")


def common_subjects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Subjects of both listings."""
    return a.select("subj").intersect(b.select("subj")).orderBy("subj")


def decode_npy(raw: bytes) -> np.ndarray:
    """A numeric NPY file.  Pickled contents are refused, as they could run code."""
    return np.load(io.BytesIO(raw), allow_pickle=False)


def decode_text(raw: bytes) -> np.ndarray:
    """A matrix as white-space separated text, a sample per line."""
    return np.loadtxt(io.BytesIO(raw), ndmin=2)


def decode_mat(raw: bytes) -> dict[str, np.ndarray]:
    """Real numeric matrices of a level-5 MAT file by name; other variables are skipped."""
    kinds = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
    order = "<" if raw[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray] = {}

    def element(data: bytes, at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element keeps its data in its tag
            return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
        end = at + 8 + size
        return kind, data[at + 8 : end], end if kind == 15 else end + -size % 8

    def variable(body: bytes) -> None:
        parts, at = [], 0
        while at < len(body) and len(parts) < 4:
            kind, data, at = element(body, at)
            parts.append((kind, data))
        if len(parts) < 4 or parts[3][0] not in kinds:
            return
        shape = np.frombuffer(parts[1][1], f"{order}i4")
        values = np.frombuffer(parts[3][1], order + kinds[parts[3][0]])
        out[parts[2][1].decode("ascii")] = values.reshape(shape, order="F").astype(float)

    at = 128
    while at < len(raw):
        kind, data, at = element(raw, at)
        if kind == 15:
            kind, data, _ = element(zlib.decompress(data), 0)
        if kind == 14:
            variable(data)
    return out


def decode_nifti(raw: bytes) -> np.ndarray:
    """The voxel array (3 or 4 dimensions) of a single-file NIfTI-1 image, scaled, compressed or not."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    dim = struct.unpack_from(f"{order}8h", raw, 40)
    code = struct.unpack_from(f"{order}h", raw, 70)[0]
    kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}[code]
    offset, slope, inter = struct.unpack_from(f"{order}3f", raw, 108)
    shape = dim[1 : dim[0] + 1]
    v = np.frombuffer(raw, order + kind, int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(float)
    return v * slope + inter if slope else v


def read_matrices(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray] = decode_npy, transpose: bool = False) -> DataFrame:
    """Wide series from files of samples x nodes (or nodes x samples): ``path, subj, tr, x``."""

    def run(frames):
        for f in frames:
            for p, raw in zip(f["path"], f["content"], strict=True):
                m = np.atleast_2d(decode(bytes(raw)))
                m = m.T if transpose else m
                yield pd.DataFrame({"path": p, "tr": np.arange(len(m)), "x": list(m)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, tr long, x array<double>").select("path", F.regexp_extract("path", _SUBJECT, 1).alias("subj"), "tr", "x")


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """``path, t, vx, vy, vz, value`` of NIfTI files (``t`` is 0 in images without time)."""

    def run(frames):
        for f in frames:
            for p, raw in zip(f["path"], f["content"], strict=True):
                v = decode_nifti(bytes(raw))
                v = v[..., None] if v.ndim == 3 else v
                x, y, z = (a.ravel() for a in np.indices(v.shape[:3]))
                for t in range(v.shape[3]):
                    yield pd.DataFrame({"path": p, "t": t, "vx": x, "vy": y, "vz": z, "value": v[..., t].ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, t long, vx long, vy long, vz long, value double")


def label_means(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """Region signals: mean of the voxels of each label (``vx, vy, vz, label``; 0 is background): ``path, tr, node, x``."""
    lab = labels.where("label > 0").select("vx", "vy", "vz", F.col("label").cast("long").alias("label"))
    return voxels.join(lab, ["vx", "vy", "vz"]).groupBy("path", F.col("t").alias("tr"), (F.col("label") - 1).alias("node")).agg(F.avg("value").alias("x"))


def sphere_means(voxels: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """Region signals: mean of the voxels within ``radius`` of each seed (``node, x, y, z`` in voxels).

    A seed is given each of the bounded number of voxel places in its box, and these are joined by
    equality, so no pair of voxel and seed outside the boxes is formed.
    """
    r = int(np.floor(radius)) + 1
    box = seeds.select(F.col("node").cast("long").alias("node"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"))
    for c, v in (("sx", "vx"), ("sy", "vy"), ("sz", "vz")):
        box = box.withColumn(v, F.explode(F.sequence(F.floor(c) - r, F.floor(c) + r)))
    inside = (F.col("vx") - F.col("sx")) ** 2 + (F.col("vy") - F.col("sy")) ** 2 + (F.col("vz") - F.col("sz")) ** 2 <= radius**2
    return voxels.join(box.where(inside).select("node", "vx", "vy", "vz"), ["vx", "vy", "vz"]).groupBy("path", F.col("t").alias("tr"), "node").agg(F.avg("value").alias("x"))


#: Which groups of confounds each strategy regresses out.
CONFOUNDS = {
    "none": (),
    "no_motion": ("wm_csf",),
    "no_motion_no_gsr": ("wm_csf",),
    "simple": ("motion", "wm_csf"),
    "simple+gsr": ("motion", "wm_csf", "global"),
}


def regress_out(wide: DataFrame, confounds: DataFrame, strategy: str = "simple") -> DataFrame:
    """Residuals of each node on the strategy's confounds (``subj, tr, kind, values``), with an intercept, per subject."""
    if strategy not in CONFOUNDS:
        raise ValueError(f"unknown confound strategy: {strategy}")
    if not CONFOUNDS[strategy]:
        return wide
    chosen = confounds.where(F.col("kind").isin(*CONFOUNDS[strategy])).groupBy("subj", "tr").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind", "values"))), lambda s: s["values"])).alias("c"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("tr")
        x, c = np.stack(g["x"]), np.stack(g["c"])
        c = np.column_stack([np.ones(len(c)), c])
        return pd.DataFrame({"subj": g["subj"], "tr": g["tr"], "x": list(x - c @ np.linalg.lstsq(c, x, rcond=None)[0] + x.mean(0))})

    return wide.select("subj", "tr", "x").join(chosen, ["subj", "tr"]).groupBy("subj").applyInPandas(run, wide.select("subj", "tr", "x").schema)


def read_task_events(spark: SparkSession, path: str) -> DataFrame:
    """``path, subj, row, onset, duration, trial_type`` from tab-separated event tables with a header."""
    columns = ("onset", "duration", "trial_type")
    df = spark.read.option("sep", "\t").option("header", "true").csv(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"event table without {missing}")
    return df.select(F.input_file_name().alias("path"), F.regexp_extract(F.input_file_name(), _SUBJECT, 1).alias("subj"), F.monotonically_increasing_id().alias("row"), F.col("onset").cast("double"), F.col("duration").cast("double"), "trial_type")


def trial_codes(events: DataFrame) -> DataFrame:
    """``trial_type, code``: 0 for rest, then the other types in sorted order from 1."""
    types = events.select("trial_type").distinct().where("trial_type <> 'rest'")
    # One row per type of trial reaches the window.
    codes = types.select("trial_type", F.row_number().over(Window.orderBy("trial_type")).alias("code"))
    return codes.union(events.sparkSession.createDataFrame([("rest", 0)], "trial_type string, code int"))


def repetition_time(spark: SparkSession, path: str) -> DataFrame:
    """``path, tr_seconds`` from BIDS side files."""
    return spark.read.option("multiLine", "true").json(path).select(F.input_file_name().alias("path"), F.col("RepetitionTime").cast("double").alias("tr_seconds"))


def write_series(df: DataFrame, path: str, keys: tuple[str, ...] = ("session", "subj")) -> None:
    """Parquet partitioned by ``keys``, so later reads of a subject or session touch its folder only."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_series(spark: SparkSession, path: str, sessions: list[str] | None = None, subjects: list | None = None) -> DataFrame:
    """Partition-pruned read; sessions or subjects that don't exist are skipped."""
    df = spark.read.option("ignoreMissingFiles", "true").parquet(path)
    if sessions is not None:
        df = df.where(F.col("session").isin(*sessions))
    if subjects is not None:
        df = df.where(F.col("subj").isin(*subjects))
    return df


def write_text(df: DataFrame, path: str) -> None:
    """``key : value`` lines."""
    k, v = df.columns[:2]
    df.select(F.concat_ws(" : ", F.col(k).cast("string"), F.col(v).cast("string"))).write.mode("overwrite").text(path)


def cut_sample(wide: DataFrame, per_subject: int = 1200) -> DataFrame:
    """Split one long recording into subjects of ``per_subject`` samples each."""
    return wide.select((F.floor(F.col("tr") / per_subject)).alias("subj"), (F.col("tr") % per_subject).alias("tr"), "x")


READERS: dict[str, Callable[..., DataFrame]] = {
    "npy": lambda spark, path: read_matrices(spark, path, decode_npy),
    "text": lambda spark, path: read_matrices(spark, path, decode_text),
    "mat": lambda spark, path, name="ROI_data": read_matrices(spark, path, lambda raw: decode_mat(raw)[name]),
    "nifti": read_voxels,
    "parquet": read_series,
}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Read by format name."""
    if kind not in READERS:
        raise ValueError(f"unknown format: {kind}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
