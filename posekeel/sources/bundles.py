"""Binary bundles: a length, a JSON header, and 32-bit floats."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from posekeel.operators.svm import Svm

EMBEDDINGS = "video_idx int, frame_idx int, inst_idx int, dataset string, emb array<float>"


def split_bundle(data: bytes) -> tuple[dict, np.ndarray]:
    """Header and payload; a short or odd file is refused."""
    if len(data) < 4:
        raise ValueError("a bundle begins with the length of its header")
    (n,) = struct.unpack_from("<I", data)
    if 4 + n > len(data):
        raise ValueError("the header is cut off")
    header = json.loads(data[4 : 4 + n])
    body = data[4 + n :]
    if len(body) % 4:
        raise ValueError("the payload is no whole number of floats")
    return header, np.frombuffer(body, "<f4")


def join_bundle(header: dict, payload: np.ndarray) -> bytes:
    text = json.dumps(header).encode()
    return struct.pack("<I", len(text)) + text + np.asarray(payload, "<f4").tobytes()


def embedding_rows(data: bytes) -> pd.DataFrame:
    """Rows of an embeddings bundle, or of an old one that also holds a model
    (its weights come first)."""
    header, payload = split_bundle(data)
    dim, n = header["dim"], header["n"]
    skip = 2 * dim + header["n_sv"] * (1 + dim) if header.get("n_sv") and len(payload) > n * dim else 0
    if len(payload) < skip + n * dim:
        raise ValueError("the bundle holds fewer embeddings than it says")
    emb = payload[skip : skip + n * dim].reshape(n, dim)
    return pd.DataFrame({"video_idx": header["video"], "frame_idx": header["frame_idx"], "inst_idx": header["inst"], "dataset": header.get("dataset", ""), "emb": list(emb)})


def read_embedding_bundles(spark: SparkSession, path: str) -> DataFrame:
    """All bundles under a path, wherever Spark can read it; one file is held
    at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                yield embedding_rows(data)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, EMBEDDINGS)


def read_model_bundle(data: bytes) -> Svm:
    """Classifier of a bundle: mean, scale, dual weights, support vectors."""
    h, p = split_bundle(data)
    d, n = h["dim"], h["n_sv"]
    if len(p) < 2 * d + n * (1 + d):
        raise ValueError("the bundle is shorter than its model")
    cut = np.cumsum([d, d, n, n * d])
    mean, scale, dual, vectors = np.split(p[: cut[-1]].astype(float), cut[:-1])
    platt = (h["platt_a"], h["platt_b"]) if h.get("platt_a") is not None else None
    return Svm(mean, scale, h["gamma"], h["intercept"], dual, vectors.reshape(n, d), h.get("threshold", 0.0), platt)


def check_match(header: dict, dim: int, patch: float | None = None) -> list[str]:
    """Refuses another dimension; warns of another patch size or data set."""
    if header["dim"] != dim:
        raise ValueError(f"the bundle has {header['dim']} dimensions, not {dim}")
    return [f"patches were cut with {header['node_min']}, not {patch}"] if patch is not None and header.get("node_min") not in (None, patch) else []
