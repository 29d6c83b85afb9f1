"""A user's own batch function over a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, types as T


#: Models a worker process keeps; the one used longest ago makes room.
MODELS_PER_WORKER = 2
_models: dict[str, Callable] = {}


def model_of(token: str, make_fn: Callable[[], Callable]) -> Callable:
    """The model known by `token` in this worker process, made when it is first asked for."""
    if token not in _models:
        while len(_models) >= MODELS_PER_WORKER:
            _models.pop(next(iter(_models)))
        _models[token] = make_fn()
    _models[token] = _models.pop(token)
    return _models[token]


def score_batches(
    df: DataFrame,
    make_fn: Callable[[], Callable],
    in_cols: Sequence[str],
    out_cols: str | T.StructType,
    batch_size: int = 32,
    keep: Sequence[str] = (),
    token: str | None = None,
) -> DataFrame:
    """Run a batch function, such as a recogniser, over `df`.

    `make_fn` returns the function. It is called once per worker process, at its first batch
    with rows, and serves all tasks of that process, so a model is loaded neither per row nor
    per task. Calls with one `token` share a model; by default each call has its own. The
    function gets a pandas frame with `in_cols` of at most `batch_size` rows and returns a frame
    with `out_cols`, row for row. The result holds the columns `keep`, the outputs and `error`:
    when a batch raises, its halves are tried, and theirs, until only the rows that fail alone
    are left; these carry a message and null outputs. A bad row in a batch of n costs about
    2 log2 n calls.

    Results of a model are costly and may differ between runs: store them, for instance
    with `materialize_once`, before using them twice.
    """
    token = token or uuid.uuid4().hex
    outputs = T.StructType.fromDDL(out_cols) if isinstance(out_cols, str) else out_cols
    names = [f.name for f in outputs]
    kept, inputs = list(keep), list(in_cols)
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField(f.name, f.dataType) for f in outputs]
        + [T.StructField("error", T.StringType())]
    )

    def run(frames):
        import pandas as pd

        def checked(part):
            result = model_of(token, make_fn)(part)
            if len(result) != len(part):
                raise ValueError(f"{len(part)} rows in, {len(result)} rows out")
            return result[names].set_axis(part.index)

        def failed(part, problem):
            message = f"{type(problem).__name__}: {problem}"
            return pd.DataFrame({n: [None] for n in names} | {"error": [message]}, part.index)

        def one_batch(part):
            try:
                return checked(part).assign(error=None)
            except Exception as problem:
                if len(part) == 1:
                    return failed(part, problem)
            half = len(part) // 2
            halves = [one_batch(part.iloc[:half]), one_batch(part.iloc[half:])]
            # object columns keep integers whole next to nulls
            return pd.concat([h.astype(object) for h in halves])

        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size].reset_index(drop=True)
                scored = one_batch(part[inputs])
                yield pd.concat([part[kept], scored], axis=1)

    columns = list(dict.fromkeys([*kept, *inputs]))
    return df.select(*columns).mapInPandas(run, schema)
