"""Vectors of nodes' texts: inference with a local model where there is one, and a table that follows the texts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelNotAvailable(RuntimeError):
    """There is no model file; searches go on without vectors."""


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the hidden states of the tokens that count, of length 1 (or 0 where none counts)."""
    weight = mask[..., None].astype(np.float64)
    mean = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(norm > 0, norm, 1)


def local_model(folder: str, batch: int = 32) -> Callable[[list[str]], np.ndarray]:
    """An encoder of texts by model.onnx and tokenizer.json of a folder that every executor has."""
    paths = [os.path.join(folder, x) for x in ("model.onnx", "tokenizer.json")]
    if not all(map(os.path.exists, paths)):
        raise ModelNotAvailable(f"{folder} has no model.onnx and tokenizer.json")
    import onnxruntime
    from tokenizers import Tokenizer

    session, tokenizer = onnxruntime.InferenceSession(paths[0]), Tokenizer.from_file(paths[1])
    tokenizer.enable_padding()
    wanted = {x.name for x in session.get_inputs()}

    def encode(texts: list[str]) -> np.ndarray:
        made = []
        for at in range(0, len(texts), batch):
            own = tokenizer.encode_batch(texts[at : at + batch])
            ids, mask = (np.array([getattr(e, x) for e in own], np.int64) for x in ("ids", "attention_mask"))
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            made.append(pooled(session.run(None, {k: v for k, v in given.items() if k in wanted})[0], mask))
        return np.concatenate(made) if made else np.zeros((0, 0))

    return encode


def embedded(texts: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(id, embedding, text_hash) of texts (id, text); make gives an encoder, once for each task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "embedding": [v.astype(np.float32).tolist() for v in encode(list(f["text"]))], "text_hash": f["text_hash"]})

    rows = texts.where("text IS NOT NULL").select("id", "text", F.sha2("text", 256).alias("text_hash"))
    return rows.mapInPandas(work, "id string, embedding array<float>, text_hash string")


def refreshed(texts: DataFrame, before: DataFrame | None, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The vectors' table for the texts there are: what hasn't changed stays, the rest is embedded anew, what is gone goes."""
    if before is None:
        return embedded(texts, make)
    now = texts.where("text IS NOT NULL").select("id", F.sha2("text", 256).alias("text_hash"))
    same = before.join(now, ["id", "text_hash"], "left_semi").select("id", "embedding", "text_hash")
    return same.unionByName(embedded(texts.join(same.select("id"), "id", "left_anti"), make))
