"""Stateful filters over streams of samples (key, i, v).

Each key is a channel; its state is carried between micro-batches. A batch's samples are sorted by
position first. Positions must rise from batch to batch: a sample at or before the last one seen
fails the query, since a recursive filter cannot go back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filtering import Biquad, run_sections
from ..operators.radar import run_nlms
from ..shipping import ship

OUTPUT = "key string, i long, v double"


def _samples(frames, last: int) -> pd.DataFrame:
    x = pd.concat(list(frames)).sort_values("i", kind="stable")
    if len(x) and (x["i"].iloc[0] <= last or (np.diff(x["i"]) <= 0).any()):
        raise ValueError(f"positions must rise beyond {last}")
    return x


def _keyed(stream: DataFrame, key: str, run, state: str) -> DataFrame:
    ship(stream.sparkSession)
    rows = stream.selectExpr(f"cast(`{key}` as string) as key", *[c for c in stream.columns if c != key])
    return rows.groupBy("key").applyInPandasWithState(run, OUTPUT, state, "append", GroupStateTimeout.NoTimeout)


def biquad_stream(stream: DataFrame, key: str, sections: Biquad | Sequence[Biquad]) -> DataFrame:
    """Sections in series over a stream (key, i, v); block by block equal to one long run."""
    chain = [sections] if isinstance(sections, Biquad) else list(sections)

    def run(name, frames, state: GroupState):
        last, held = (state.get[0], np.array(state.get[1])) if state.exists else (-1, np.zeros(2 * len(chain)))
        x = _samples(frames, last)
        memory = held.reshape(len(chain), 2, 1)
        y = run_sections(x["v"].to_numpy(float)[None], chain, memory)[0]
        state.update((int(x["i"].iloc[-1]) if len(x) else last, memory.ravel().tolist()))
        yield pd.DataFrame({"key": name[0], "i": x["i"].astype("int64"), "v": y})

    return _keyed(stream.select(key, "i", "v"), key, run, "last long, memory array<double>")


def nlms_stream(stream: DataFrame, key: str, length: int, mu: float, eps: float = 1e-6) -> DataFrame:
    """NLMS residual over a stream (key, i, v, ref), weights and references carried on."""

    def run(name, frames, state: GroupState):
        last, seen, w, u = state.get if state.exists else (-1, 0, [0.0] * length, [0.0] * length)
        x = _samples(frames, last)
        memory = {"w": np.array([w]), "u": np.array([u]), "seen": np.array([seen])}
        y = run_nlms(x["v"].to_numpy(float)[None], x["ref"].to_numpy(float)[None], np.array([len(x)]), length, mu, eps, "passthrough", memory)[0]
        state.update((int(x["i"].iloc[-1]) if len(x) else last, int(memory["seen"][0]), memory["w"][0].tolist(), memory["u"][0].tolist()))
        yield pd.DataFrame({"key": name[0], "i": x["i"].astype("int64"), "v": y})

    return _keyed(stream.select(key, "i", "v", "ref"), key, run, "last long, seen long, w array<double>, u array<double>")


def resample_stream(stream: DataFrame, key: str, taps: Sequence[float], up: int, down: int) -> DataFrame:
    """Polyphase resampling over a stream (key, i, v); the state is the last inputs and the number of them."""
    reach = math.ceil(len(taps) / up)
    phases = np.zeros((up, reach))
    for k, h in enumerate(taps):
        phases[k % up, k // up] = h

    def run(name, frames, state: GroupState):
        last, count, tail = state.get if state.exists else (-1, 0, [0.0] * (reach - 1))
        x = _samples(frames, last)
        v = np.concatenate([tail, x["v"].to_numpy(float)])
        m = np.arange(-(-count * up // down), -(-(count + len(x)) * up // down))
        newest = m * down // up - count + reach - 1
        taken = v[newest[:, None] - np.arange(reach)] if len(m) else np.zeros((0, reach))
        y = (taken * phases[m * down % up]).sum(1)
        state.update((int(x["i"].iloc[-1]) if len(x) else last, count + len(x), v[len(v) - (reach - 1) :].tolist()))
        yield pd.DataFrame({"key": name[0], "i": m.astype("int64"), "v": y})

    return _keyed(stream.select(key, "i", "v"), key, run, "last long, n long, tail array<double>")
