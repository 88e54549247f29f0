"""Whole landmark archives: NPZ tensors with JSON metadata beside them, read to one row a frame and written back.

Tensors become columns of points without a Python object for a point. Metadata are read by Spark's own JSON functions, with a
declared type for what is known and a map of text for the rest.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .file_sink import write_files

# The tensors of an archive, their coordinates and columns, and the labels of provenance.
FORMAT_VERSION = 1
TENSORS = {"pose_xyv": ("pose", "xyv"), "pose_xyz": ("pose_depth", "xyz"), "face_xy": ("face", "xy"), "left_hand_xy": ("left_hand", "xy"), "right_hand_xy": ("right_hand", "xy")}
SOURCES = ("left_hand_source", "right_hand_source", "face_source")
META = "format_version int, n_frames long, fps double, width int, height int, hands_rejected_offtarget long"

_POINTS = {c: pa.list_(pa.struct([(x, pa.float32()) for x in axes])) for c, axes in TENSORS.values()}
_FRAMES = pa.schema([("clip_id", pa.string()), ("frame", pa.int64()), *_POINTS.items(), *((s, pa.string()) for s in SOURCES)])
_DDL = "clip_id string, frame long, " + ", ".join(f"{c} array<struct<{', '.join(f'{x}: float' for x in axes)}>>" for c, axes in TENSORS.values()) + "".join(f", {s} string" for s in SOURCES)
_BATCH_FRAMES = 5000


def points_of(tensor: np.ndarray, axes: str) -> pa.ListArray:
    """Frames x points x coordinates as one list of points for each frame."""
    frames, points, size = tensor.shape
    if size != len(axes):
        raise ValueError(f"{size} coordinates instead of {len(axes)}")
    flat = tensor.astype(np.float32).reshape(frames * points, size)
    rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(size)], list(axes))
    return pa.ListArray.from_arrays(pa.array(np.arange(frames + 1, dtype=np.int32) * points), rows)


def tensor_of(column: pa.Array, axes: str) -> np.ndarray:
    """Lists of points as a tensor; frames whose number of points is not the clip's largest are missing throughout (NaN)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    points = int(sizes.max(initial=0))
    out = np.full((len(sizes), points, len(axes)), np.nan, np.float32)
    flat = column.flatten()
    whole = sizes == points
    if points:
        kept = np.repeat(whole, sizes)
        for k, axis in enumerate(axes):
            values = pc.fill_null(flat.field(axis).cast(pa.float32()), np.nan).to_numpy(zero_copy_only=False)
            out[whole, :, k] = values[kept].reshape(-1, points)
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a frame of the archives below a path, with their metadata; clips without metadata have nulls there.

    A clip is known by its file's name. NaN stays NaN. An archive is decoded by one task.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip, content in zip(batch.column("clip_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    tensors, sources = {k: z[k] for k in TENSORS}, {k: z[k].astype(str) for k in SOURCES}
                frames = len(tensors["pose_xyv"])
                for at in range(0, frames, _BATCH_FRAMES):
                    part = slice(at, min(frames, at + _BATCH_FRAMES))
                    n = part.stop - at
                    points = [points_of(t[part], TENSORS[k][1]).cast(_POINTS[TENSORS[k][0]]) for k, t in tensors.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([clip] * n, pa.string()), pa.array(np.arange(at, part.stop, dtype=np.int64)), *points, *(pa.array(s[part].tolist(), pa.string()) for s in sources.values())], schema=_FRAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    clip = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("clip_id")
    archives = files.option("pathGlobFilter", "*.npz").load(path).select(clip, "content")
    told = files.option("pathGlobFilter", "*.json").load(path).select(clip, F.decode("content", "UTF-8").alias("json"))
    meta = told.select("clip_id", F.from_json("json", META).alias("m"), F.map_filter(F.from_json("json", "map<string,string>"), lambda k, _: ~k.isin(*[c.split()[0] for c in META.split(", ")])).alias("meta"))
    return archives.mapInArrow(decode, _DDL).join(meta.select("clip_id", "m.*", "meta"), "clip_id", "left")


def write_archives(frames: DataFrame, path: str) -> None:
    """Each clip's frames, in order, as an archive and its metadata; frames are as ``read_archives`` gives them.

    Columns of points that the frames lack are written without points, sources that they lack as missing. The metadata are
    those of the clip's first frame. A clip is put together by one task; repeated frame numbers raise ValueError.
    """
    names = {c.split()[0]: c.split()[1] for c in META.split(", ")}
    have = set(frames.columns)
    columns = [F.col(c) if c in have else F.array().cast(f"array<struct<{', '.join(f'{x}: float' for x in axes)}>>").alias(c) for c, axes in TENSORS.values()]
    sources = [F.coalesce(F.col(s), F.lit("missing")).alias(s) if s in have else F.lit("missing").alias(s) for s in SOURCES]
    told = F.to_json(F.struct(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in names.items()])).alias("told")
    extra = (F.to_json("meta") if "meta" in have else F.lit("{}")).alias("extra")
    dealt = frames.select("clip_id", "frame", *columns, *sources, told, extra).where("clip_id IS NOT NULL").repartition("clip_id").sortWithinPartitions("clip_id", "frame")
    out = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def clip_files(table: pa.Table) -> Iterator[tuple[str, bytes]]:
        clip, number = table.column("clip_id")[0].as_py(), table.column("frame").to_pylist()
        if len(set(number)) != len(number):
            raise ValueError(f"repeated frames of {clip}")
        held = io.BytesIO()
        np.savez_compressed(held, **{k: tensor_of(table.column(c), axes) for k, (c, axes) in TENSORS.items()}, **{s: np.asarray(table.column(s).to_pylist(), dtype="<U16") for s in SOURCES})
        meta = json.loads(table.column("extra")[0].as_py() or "{}") | json.loads(table.column("told")[0].as_py()) | {"format_version": FORMAT_VERSION, "n_frames": len(number)}
        yield f"{clip}.npz", held.getvalue()
        yield f"{clip}.json", json.dumps(meta, ensure_ascii=False, sort_keys=True).encode()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed() -> Iterator[pa.RecordBatch]:
            files = list(clip_files(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in files]), pa.array([c for _, c in files], pa.binary())], schema=out)

        for batch in batches:
            clips = batch.column("clip_id").to_pylist()
            edges = [0, *(i for i in range(1, len(clips)) if clips[i] != clips[i - 1]), len(clips)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                if held and held[0].column("clip_id")[0].as_py() != clips[start]:
                    yield from closed()
                    held = []
                held.append(batch.slice(start, stop - start))
        if held:
            yield from closed()

    write_files(dealt.mapInArrow(encode, "name string, content binary"), path)


def unpadded(points: Column, original: tuple[Column, Column], padded: tuple[Column, Column], pad: tuple[Column, Column]) -> Column:
    """Points normalised to a padded frame as points normalised to the original one; other coordinates stay."""

    def moved(p: Column) -> Column:
        x = (p["x"] * padded[0] - pad[0]) / original[0].cast("double")
        y = (p["y"] * padded[1] - pad[1]) / original[1].cast("double")
        return p.withField("x", x.cast("float")).withField("y", y.cast("float"))

    return F.transform(points, moved)


def selected_points(points: Column, ids: Sequence[int]) -> Column:
    """The points of some numbers, in their order; a number beyond the last is a null point, and of null there is nothing."""
    return F.when(points.isNotNull(), F.transform(F.array(*map(F.lit, ids)), lambda i: F.get(points, i)))
