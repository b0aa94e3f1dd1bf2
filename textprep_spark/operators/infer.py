"""Batch inference with a model the user supplies.

A model is given by a loader: a function without arguments that returns a callable from a list of
texts to one result per text. A Python worker loads a model once and keeps it for its later tasks,
as long as the same loader object is used. Only the text column goes to Python.

Models pad the texts of a batch to its longest. So texts are held back in a buffer of bounded size and
handed to the model by length, short with short and long with long; results go back in the order in
which the texts came.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep_spark.functions.text import clean_question
from textprep_spark.shipping import ship

Model = Callable[[Sequence[str]], Any]
Loader = Callable[[], Model]

BATCH_SIZE = 32
KEPT_MODELS = 2  # per worker
BUFFER_TEXTS = 4096  # held back to be ordered by length, at most
BUFFER_CHARS = 8_000_000  # after so many characters no further text is waited for

_keys: weakref.WeakKeyDictionary[Loader, str] = weakref.WeakKeyDictionary()  # on the driver
_loaded: dict[str, Model] = {}  # per worker process


def _key(load: Loader) -> str:
    """A name for this loader object. Another loader, whatever it is called, has another one."""
    try:
        return _keys.setdefault(load, uuid.uuid4().hex)
    except TypeError:  # cannot be referred to weakly
        return uuid.uuid4().hex


def _model(key: str, load: Loader) -> Model:
    if key not in _loaded:
        while len(_loaded) >= KEPT_MODELS:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = load()
    return _loaded[key]


def _buffers(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of a stream in runs of bounded size."""
    held: list[str | None] = []
    size = 0
    for batch in batches:
        for text in batch.to_pylist():
            held.append(text)
            size += len(text or "")
            if len(held) >= BUFFER_TEXTS or size >= BUFFER_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _by_length(texts: list[str | None], model: Model, batch_size: int, convert: Callable[[Any], list]) -> list:
    """A result for each text, in its place; the model gets texts of like length together."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
    out: list = [None] * len(texts)
    for start in range(0, len(order), batch_size):
        places = order[start : start + batch_size]
        found = convert(model([texts[i] for i in places]))
        if len(found) != len(places):
            raise ValueError(f"the model gave {len(found)} results for {len(places)} texts")
        for i, result in zip(places, found):
            out[i] = result
    return out


def _apply_model(
    df: DataFrame,
    text: str,
    target: str,
    kind: T.DataType,
    arrow: pa.DataType,
    load: Loader,
    batch_size: int,
    convert: Callable[[Any], list],
) -> DataFrame:
    if text not in df.columns:
        raise ValueError(f"column {text!r} is absent")
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    ship(df.sparkSession)
    key = _key(load)

    def results(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _buffers(batches):
            yield pa.array(_by_length(texts, _model(key, load), batch_size, convert), arrow)

    # the optimizer must not run a model again for each use of its result, nor a sampling one twice
    apply = F.arrow_udf(_typed(results), kind).asNondeterministic()
    return df.withColumn(target, apply(F.col(text)))


def _typed(function):
    """With annotations as objects, which the kind of the function is read from."""
    function.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return function


def embed_texts(
    df: DataFrame,
    text: str,
    load: Loader,
    target: str = "embedding",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``df`` with one vector per text."""

    def vectors(output: Any) -> list:
        return [np.asarray(v, dtype=np.float64) for v in output]

    kind, arrow = T.ArrayType(T.DoubleType()), pa.list_(pa.float64())
    return _apply_model(df, text, target, kind, arrow, load, batch_size, vectors)


def generate_questions(
    df: DataFrame,
    text: str,
    target: str,
    load: Loader,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``df`` with one generated question per text, freed of its stock opening."""
    raw = _apply_model(df, text, target, T.StringType(), pa.string(), load, batch_size, list)
    return raw.withColumn(target, clean_question(F.col(target)))
