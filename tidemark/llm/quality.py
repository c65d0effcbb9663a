"""Compression classifier for text quality.

Two Zstandard dictionaries are trained, one on good and one on bad labelled text. A whole text is cut into pieces of
``PIECE`` bytes, each compressed with both; with sizes g and b over all pieces, (b - g) / (b + g) is the normalised
difference. A ridge logistic regression on labelled rows that trained no dictionary turns it, the compressed bytes per byte
and the length into a probability.

Fitted on a bounded sample: ``FIT_ROWS`` labelled rows of each class at most, of which half train the dictionaries, with all
pieces of their whole texts, and half the calibration. One task a class trains its dictionary. Null and empty texts get the
score of a text of no bytes. Null ids are scored, never held out. With a class missing in the sample the score is a constant
near the base rate. Repeated rows give repeated results; an empty table an empty one. Only doc_id and text are read, and of
labels doc_id and quality.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.common import TEXT_BYTES, arrow_schema, map_batches

PIECE, DICTIONARY_BYTES, LEVEL, FIT_ROWS = 512, 1 << 16, 3, 3000


def held(id_col: Column) -> Column:
    return labelled.held_out(id_col, 5, 0)


def pieces_of(text: str | None, size: int = PIECE) -> list[bytes]:
    """The whole text in pieces; an empty text is one empty piece."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[k : k + size] for k in range(0, max(1, len(data)), size)]


def train_dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the pieces themselves."""
    size = max(1024, min(size, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    shape = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=level, **shape)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, **shape)


def feature_maker(good: bytes, bad: bytes) -> Callable[[list], np.ndarray]:
    by_good, by_bad = _compressor(good, LEVEL).compress, _compressor(bad, LEVEL).compress

    def features(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            pieces = pieces_of(text)
            size = sum(map(len, pieces))
            g, b = sum(len(by_good(p)) for p in pieces), sum(len(by_bad(p)) for p in pieces)
            out[i] = (b - g) / (b + g), np.log((b + g) / (size + 1)), np.log(size + 1)
        return out

    return features


def _make_scorer(model: tuple) -> Callable[[list], np.ndarray]:
    good, bad, calibration = model
    features = feature_maker(good, bad)
    return lambda texts: labelled.logistic(calibration, features(texts))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Callable[[], Callable[[list], np.ndarray]]:
    """A scorer to hand to ``labelled.score_rows`` or ``labelled.keep_rows``."""
    sample = labelled.sample(docs, labels, "quality", held, rows)
    target = arrow_schema(docs.sparkSession, "label int, dictionary binary")

    def trained(group: pa.Table) -> pa.Table:
        pieces = sorted(p for text in group.column("text").to_pylist() for p in pieces_of(text) if p)
        return pa.Table.from_pylist([{"label": group.column("label")[0].as_py(), "dictionary": train_dictionary(pieces)}], schema=target)

    by_class = sample.where("part = 0").select("label", "text").groupBy("label")  # as many rows a group as ``rows`` allows
    found = {r["label"]: bytes(r["dictionary"]) for r in by_class.applyInArrow(trained, "label int, dictionary binary").collect()}
    good, bad = found.get(1, b""), found.get(0, b"")

    def measured(columns: dict[str, list], features: Callable) -> dict[str, list]:
        return {"label": columns["label"], "features": features(columns["text"]).tolist()}

    seen = map_batches(sample.where("part = 1"), measured, "label int, features array<double>", partial(feature_maker, good, bad), TEXT_BYTES).collect()
    seen.sort(key=lambda r: (r["features"], r["label"]))
    calibration = labelled.fit_logistic(np.array([r["features"] for r in seen]).reshape(-1, 3), np.array([r["label"] for r in seen], float))
    return partial(_make_scorer, (good, bad, calibration))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled.score_rows(docs, fit(docs, labels), held)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled.keep_rows(docs, fit(docs, labels), positive=True)
