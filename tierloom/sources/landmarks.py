"""Landmark tensors of clips: NPZ archives in, one row per frame out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT, _POSE = "struct<x:double,y:double>", "struct<x:double,y:double,v:double>"
SCHEMA = f"clip_id string, frame long, left_shoulder {_POSE}, right_shoulder {_POSE}, chin {_POINT}, face_top {_POINT}, left_hand array<{_POINT}>, right_hand array<{_POINT}>"


def read_landmarks(spark: SparkSession, path: str, left_shoulder: int = 0, right_shoulder: int = 1, chin: int = 0, face_top: int = 1) -> DataFrame:
    """Frames of NPZ files with pose_xyv, face_xy, left_hand_xy and right_hand_xy; the numbers say which points are which.

    NaN stays NaN. A file is decoded by one task, as its archive cannot be split.
    """

    def frames(batches: Iterator) -> Iterator:
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    pose, face, left, right = (z[k].astype(float) for k in ("pose_xyv", "face_xy", "left_hand_xy", "right_hand_xy"))
                point = lambda p: {"x": p[0], "y": p[1]}
                shoulder = lambda p: {"x": p[0], "y": p[1], "v": p[2]}
                clip = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame([
                    {"clip_id": clip, "frame": i, "left_shoulder": shoulder(pose[i, left_shoulder]), "right_shoulder": shoulder(pose[i, right_shoulder]), "chin": point(face[i, chin]), "face_top": point(face[i, face_top]), "left_hand": list(map(point, left[i])), "right_hand": list(map(point, right[i]))}
                    for i in range(len(pose))
                ])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(frames, SCHEMA)


def load_signers(rows: DataFrame) -> DataFrame:
    """Signers of a roster with loosely named columns: signer_id, handedness, age, gender; comment rows go."""
    from ..operators.space import normalise_gender
    from .files import first_existing

    signer = first_existing(rows, "signer_id", "signer", "id", "name")
    hand = F.lower(first_existing(rows, "handedness", "hand", "left_handed"))
    left = hand.isin("left", "l", "true", "1", "yes")
    out = rows.select(signer.alias("signer_id"), F.when(left, "left").otherwise("right").alias("handedness"), first_existing(rows, "age").try_cast("double").alias("age"), normalise_gender(first_existing(rows, "gender", "sex")).alias("gender"))
    return out.where((F.col("signer_id") != "") & ~F.col("signer_id").startswith("#"))
