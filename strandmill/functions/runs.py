"""Runs of equal characters in batches of Arrow strings, by numpy: one pass over a batch's characters, whatever the number of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings, one behind the other, and where each string begins (and the last one ends). Nulls have none."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    held = text.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    if not len(data) or data.max() < 128:
        return data, at - at[0]
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def runs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(char, n, ends): code point and length of each run in order; those of row i are ends[i] to ends[i + 1] - 1."""
    flat, at = points(text)
    edge = np.ones(len(flat), bool)
    edge[1:] = flat[1:] != flat[:-1]
    edge[at[:-1][at[:-1] < len(flat)]] = True
    first = np.flatnonzero(edge)
    return flat[first].astype(np.int64), np.diff(np.append(first, len(flat))), np.searchsorted(first, at)


def stretched(head: np.ndarray, given: np.ndarray, repeats: np.ndarray, base: int, most: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, ends): each run's ``head`` where ``given``, then its repeats as base + count, in stretches of at most ``most``."""
    rest = repeats % most
    sizes = given + repeats // most + (rest > 0)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(upto[-1]), base + most, np.int64)
    out[upto[:-1][given]] = head[given]
    out[upto[1:][rest > 0] - 1] = base + rest[rest > 0]
    return out, upto[ends]


def pieces(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, sizes, upto): runs cut into pieces of at most ``most``, the last one shorter. Pieces of run i are upto[i] to upto[i + 1] - 1."""
    count = -(-n // most)
    upto = np.concatenate([[0], np.cumsum(count)])
    sizes = np.full(int(upto[-1]), most, np.int64)
    sizes[upto[1:] - 1] = n - (count - 1) * most
    return np.repeat(np.arange(len(n)), count), sizes, upto


def stretch(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one stretch behind the other."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def text_of(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Strings of code points; row i has those from at[i] to at[i + 1] - 1."""
    if not len(flat) or flat.max() < 128:
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(flat.astype(np.uint8).tobytes())).cast(pa.string())
    whole = flat.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([whole[x:y] for x, y in zip(at.tolist(), at[1:].tolist())], pa.string())


def lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of int; row i has the entries from at[i] to at[i + 1] - 1."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
