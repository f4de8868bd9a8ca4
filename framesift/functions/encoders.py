"""Pluggable encoders and taggers, and the column functions that host them.

An encoder is any object with ``dimension``, ``encode_text(list[str])`` and
``encode_image(list[bytes])``; a tagger has ``tag(list[str])``. Jobs take a
factory, which each Python worker process calls once, so weights load on the
executors and never travel with the plan.
"""

from __future__ import annotations

import base64
import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.schemas import ENTITY_TYPE, VECTOR_TYPE

ON_ERROR = ("null", "fail")

_ENTITY_ARROW = pa.list_(
    pa.struct(
        [("entity", pa.string()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]
    )
)

#: Results a task keeps for inputs it has seen already, and their bytes, as estimated.
REUSE_ENTRIES, REUSE_BYTES = 4096, 32 * 1024 * 1024

#: Rows of a batch that are Python objects at a time.
PIECE_ROWS = 256


class Encoder(Protocol):
    dimension: int

    def encode_text(self, texts: list[str]) -> Sequence[Sequence[float]]: ...

    def encode_image(self, images: list[bytes]) -> Sequence[Sequence[float]]: ...


class Tagger(Protocol):
    def tag(self, texts: list[str]) -> list[list[dict[str, Any]]]: ...


def _run(call: Callable[[list], Sequence], inputs: list, on_error: str) -> list:
    """Call a model on a batch; under "null", retry one by one so only bad inputs fail."""
    try:
        results = list(call(inputs))
        if len(results) != len(inputs):
            raise ValueError(f"model returned {len(results)} results for {len(inputs)} inputs")
        return results
    except Exception:
        if on_error == "fail":
            raise
        if len(inputs) == 1:
            return [None]
        return [result for one in inputs for result in _run(call, [one], on_error)]


def _run_reporting(call: Callable[[list], Sequence], inputs: list, dim: int | None) -> list[tuple]:
    """(vector, reason) for each input of a batch: one of the two is None.

    A batch that fails is halved, so the good inputs of a batch with one bad
    one are run a few times more, not one by one.
    """
    try:
        results = list(call(inputs))
        if len(results) != len(inputs):
            raise ValueError(f"model returned {len(results)} results for {len(inputs)} inputs")
    except Exception as error:
        if len(inputs) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(inputs) // 2
        return _run_reporting(call, inputs[:half], dim) + _run_reporting(call, inputs[half:], dim)
    reasons = []
    for result in results:
        if result is None or not len(result):
            reasons.append("empty vector")
        elif dim is not None and len(result) != dim:
            reasons.append(f"{len(result)} components, not {dim}")
        else:
            reasons.append(None)
    return [(None, reason) if reason else (result, None) for result, reason in zip(results, reasons)]


def _pieces(batches: Iterator[pa.Array], rows: int | None = None) -> Iterator[pa.Array]:
    """The batches, some rows at a time: a batch of whole texts is many times larger as Python objects."""
    step = rows or PIECE_ROWS
    for batch in batches:
        for first in range(0, max(1, len(batch)), step):
            yield batch.slice(first, step)


def _result_bytes(result: Any) -> int:
    """About what a remembered result takes: a vector, or a list of numbers or entities."""
    if result is None or not len(result):
        return 64
    if isinstance(result, np.ndarray):
        return 128 + result.nbytes
    return 64 + len(result) * (512 if isinstance(result[0], dict) else 32)


def _reusing(call: Callable[[list], Sequence], on_error: str, batch_size: int) -> Callable[[list], list]:
    """Run ``call`` once per distinct input, remembering recent results within the task."""
    known: OrderedDict[bytes, Any] = OrderedDict()
    held = 0

    def digest(value: str | bytes) -> bytes:
        return hashlib.sha256(value.encode() if isinstance(value, str) else value).digest()

    def apply(values: list) -> list:
        nonlocal held
        digests = [None if value is None else digest(value) for value in values]
        missing = {d: v for d, v in zip(digests, values) if d is not None and d not in known}
        fresh: dict[bytes, Any] = {}
        todo = list(missing.items())
        for first in range(0, len(todo), batch_size):
            part = todo[first : first + batch_size]
            fresh.update(zip((d for d, _ in part), _run(call, [v for _, v in part], on_error)))
        results = [None if d is None else fresh[d] if d in fresh else known[d] for d in digests]
        known.update(fresh)
        held += sum(map(_result_bytes, fresh.values()))
        while len(known) > REUSE_ENTRIES or held > REUSE_BYTES:
            held -= _result_bytes(known.popitem(last=False)[1])
        return results

    return apply


def _check_on_error(on_error: str) -> str:
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}, not {on_error!r}")
    return on_error


#: Models a worker process keeps between tasks.
RESIDENT_MODELS = 2

_resident: OrderedDict[str, Any] = OrderedDict()


def _identity(factory: Callable[[], Any]) -> str:
    """Same factory, same name, whichever task it arrives in."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _load(identity: str, factory: Callable[[], Any]) -> Any:
    """The model of ``factory``, made on first use in this worker process.

    Python workers outlive their tasks, so weights load once per process, not
    once per task.
    """
    if identity not in _resident:
        _resident[identity] = factory()
    _resident.move_to_end(identity)
    while len(_resident) > RESIDENT_MODELS:
        _resident.popitem(last=False)
    return _resident[identity]


def _model_column(
    factory: Callable[[], Any],
    method: str,
    spark_type: T.DataType,
    arrow_type: pa.DataType,
    on_error: str,
    batch_size: int,
    empty_is_null: bool,
):
    identity = _identity(factory)
    _check_on_error(on_error)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = _reusing(getattr(_load(identity, factory), method), on_error, batch_size)
        for batch in _pieces(batches):
            results = apply(batch.to_pylist())
            if empty_is_null:
                results = [r if r is not None and len(r) else None for r in results]
            yield pa.array(results, type=arrow_type)

    # Not deterministic as far as the optimizer may assume: a later filter on
    # the result must not plan a second run of the model.
    return F.arrow_udf(column, spark_type).asNondeterministic()


def text_encoder(factory: Callable[[], Encoder], on_error: str = "null", batch_size: int = 256):
    """Column function ``string -> array<float>``."""
    return _model_column(factory, "encode_text", VECTOR_TYPE, pa.list_(pa.float32()), on_error, batch_size, True)


def image_encoder(factory: Callable[[], Encoder], on_error: str = "null", batch_size: int = 32):
    """Column function ``binary -> array<float>``."""
    return _model_column(factory, "encode_image", VECTOR_TYPE, pa.list_(pa.float32()), on_error, batch_size, True)


REPORT_TYPE = T.StructType([T.StructField("vector", VECTOR_TYPE), T.StructField("error", T.StringType())])


def reporting_encoder(factory: Callable[[], Encoder], method: str, dim: int | None = None, batch_size: int = 256):
    """Column function ``string or binary -> struct<vector, error>``: a vector, or the reason why there is none.

    ``method`` is the encoder's, encode_text or encode_image. A NULL input has
    the reason "no input". With ``dim`` a vector of another length has one too.
    """
    identity = _identity(factory)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = getattr(_load(identity, factory), method)
        for batch in _pieces(batches):
            values = batch.to_pylist()
            places = [i for i, value in enumerate(values) if value is not None]
            results: list[tuple] = [(None, "no input")] * len(values)
            for first in range(0, len(places), batch_size):
                part = places[first : first + batch_size]
                for i, result in zip(part, _run_reporting(call, [values[i] for i in part], dim)):
                    results[i] = result
            vectors = pa.array([v for v, _ in results], type=pa.list_(pa.float32()))
            yield pa.StructArray.from_arrays([vectors, pa.array([e for _, e in results], pa.string())], names=["vector", "error"])

    return F.arrow_udf(column, REPORT_TYPE).asNondeterministic()


def pooled_text_encoder(factory: Callable[[], Encoder], batch_size: int = 256):
    """Column function ``array<string> -> array<float>``: the mean of the vectors of a text's windows, by their lengths.

    Windows of all rows of a batch go to the model together; no row is
    shuffled. NULL or no windows give NULL.
    """
    identity = _identity(factory)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = _load(identity, factory).encode_text
        for batch in _pieces(batches):
            rows = batch.to_pylist()
            flat = [text for row in rows for text in row or []]
            vectors = [v for at in range(0, len(flat), batch_size) for v in _run(call, flat[at : at + batch_size], "fail")]
            pooled, place = [], 0
            for row in rows:
                if not row:
                    pooled.append(None)
                    continue
                weights = np.array([max(1, len(text)) for text in row], dtype=np.float64)
                some = np.array(vectors[place : place + len(row)], dtype=np.float64)
                pooled.append((weights @ some / weights.sum()).astype(np.float32))
                place += len(row)
            yield pa.array(pooled, type=pa.list_(pa.float32()))

    return F.arrow_udf(column, VECTOR_TYPE).asNondeterministic()


def stitching_tagger(factory: Callable[[], Tagger], step: int, overlap: int, batch_size: int = 256):
    """Column function ``array<string> -> array<entity>``: the entities of a text from those of its windows.

    Window n begins at character n * ``step`` and shares ``overlap`` characters
    with the next. An entity that touches a window's edge inside the text may
    be cut there, and is taken from the window that has it whole. Any that is
    shorter than the overlap is found once, at its place in the text.
    """
    identity = _identity(factory)
    size = step + overlap

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = _load(identity, factory).tag
        for batch in _pieces(batches):
            rows = batch.to_pylist()
            flat = [text for row in rows for text in row or []]
            tagged = [t for at in range(0, len(flat), batch_size) for t in _run(call, flat[at : at + batch_size], "fail")]
            results, place = [], 0
            for row in rows:
                if row is None:
                    results.append(None)
                    continue
                found: dict[tuple, dict] = {}
                for n, (text, hits) in enumerate(zip(row, tagged[place : place + len(row)])):
                    for hit in hits:
                        cut = (hit["start"] == 0 and n > 0) or (hit["end"] == size == len(text) and n + 1 < len(row))
                        if not cut:
                            start, end = hit["start"] + n * step, hit["end"] + n * step
                            found.setdefault((start, end, hit["entity"]), {**hit, "start": start, "end": end})
                results.append([found[key] for key in sorted(found)])
                place += len(row)
            yield pa.array(results, type=_ENTITY_ARROW)

    return F.arrow_udf(column, ENTITY_TYPE).asNondeterministic()


def entity_tagger(factory: Callable[[], Tagger], on_error: str = "fail", batch_size: int = 256):
    """Column function ``string -> array<struct<entity, word, start, end, score>>``."""
    return _model_column(factory, "tag", ENTITY_TYPE, _ENTITY_ARROW, on_error, batch_size, False)


def register_ai_query(
    spark: SparkSession,
    models: Mapping[str, tuple[str, Callable[[], Encoder]]],
    name: str = "ai_query",
    on_error: str = "fail",
) -> None:
    """Make ``ai_query(endpoint, request => expr)`` callable from SQL.

    ``models`` maps an endpoint name to ``("text" | "image", factory)``; an
    image request is base64 text. A SQL function has one return type, so only
    embeddings are served here.
    """
    _check_on_error(on_error)
    chosen = {name: (kind, factory, _identity(factory)) for name, (kind, factory) in models.items()}

    def loader(endpoint: str) -> Callable[[list[str]], Sequence]:
        if endpoint not in chosen:
            raise ValueError(f"unknown model {endpoint!r}; known: {sorted(chosen)}")
        kind, factory, identity = chosen[endpoint]
        encoder = _load(identity, factory)
        if kind == "text":
            return encoder.encode_text
        return lambda requests: encoder.encode_image([base64.b64decode(r, validate=True) for r in requests])

    loaded: dict[str, Callable[[list], list]] = {}  # filled per task, on the worker

    # Column by column rather than as an iterator: only then does SQL accept
    # the named argument ``request =>``.
    def ai_query(endpoint: pa.Array, request: pa.Array) -> pa.Array:
        names, values = endpoint.to_pylist(), request.to_pylist()
        results: list = [None] * len(values)
        for model in dict.fromkeys(names):
            if model not in loaded:
                loaded[model] = _reusing(loader(model), on_error, 256)
            rows = [i for i, n in enumerate(names) if n == model]
            for i, result in zip(rows, loaded[model]([values[i] for i in rows])):
                results[i] = result
        return pa.array(results, type=pa.list_(pa.float32()))

    spark.udf.register(name, F.arrow_udf(ai_query, VECTOR_TYPE).asNondeterministic())
