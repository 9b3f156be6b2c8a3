"""Mono 16-bit PCM WAV files as arrays of samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate). Anything but mono 16-bit PCM is an error."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 16):
                raise ValueError("only mono 16-bit PCM can be read")
        elif name == b"data":
            if rate is None:
                raise ValueError("samples before their format")
            body = data[at + 8 : at + 8 + size]
            return np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768, rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, sample_rate, samples, sha256) of the files at a path; files that cannot be read have null samples and an error."""
    name = F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1)
    rows = spark.read.format("binaryFile").load(path).select(name.alias("media_id"), F.sha2("content", 256).alias("sha256"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for media, digest, data in zip(pdf["media_id"], pdf["sha256"], pdf["content"]):
                try:
                    samples, rate = decode_wav(bytes(data))
                    out.append((media, rate, samples.tolist(), digest, None))
                except ValueError as e:
                    out.append((media, None, None, digest, str(e)))
            yield pd.DataFrame(out, columns=["media_id", "sample_rate", "samples", "sha256", "error"])

    return rows.mapInPandas(run, "media_id string, sample_rate int, samples array<float>, sha256 string, error string")
