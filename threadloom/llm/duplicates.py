"""Duplicates hidden by formatting differences.

Records get a canonical form (case, white space, punctuation, field order and layout removed) and
a 128-bit hash of it. Every partition counts hash cells in a saturating two-level Bloom filter
(seen once, seen repeatedly); the filters are merged segment by segment. Only records whose cells
were all seen repeatedly are shuffled for exact grouping; the others are singletons for certain.

A filter has about ``CELLS_A_ROW`` cells a row, whatever the number of rows, so that it lets through
few singletons at every size. As one filter may have at most ``MAX_CELLS`` bits (32 MiB) to be
broadcast, more rows are cut into ranges of their hashes, which no two equal records can straddle;
each range has its own filter and its own pass over its own files of hashes.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.durable import cut, drop_cut
from threadloom.operators.hierarchy import union_all

MAX_CELLS = 1 << 28
SEGMENT = 1 << 18
HASHES = 4
CELLS_A_ROW = 16
_NOISE = re.compile(r"[\W_]+")


def _reject(name: str):
    raise ValueError(name)


def _number(text: str):
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 1e15 else value


def _fold(value):
    if isinstance(value, str):
        return _NOISE.sub("", value.casefold())
    if isinstance(value, list):
        return [_fold(x) for x in value]
    if isinstance(value, dict):
        pairs = sorted(((k.casefold(), _fold(x)) for k, x in value.items()), key=lambda p: (p[0], json.dumps(p[1], sort_keys=True)))
        return {"": [list(p) for p in pairs]}
    return value


def canonical(tool: str | None, parameters: str | None) -> str | None:
    """Canonical form of a call, None where the parameters are null or unreadable."""
    if parameters is None:
        return None
    try:
        value = json.loads(parameters, parse_float=_number, parse_constant=_reject)
        return json.dumps([_fold(tool or ""), _fold(value)], separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def hashed_calls(calls: DataFrame) -> DataFrame:
    """(call_id, h1, h2) of the readable calls; rows without call_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, his, los = [], [], []
            for cid, tool, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                form = canonical(tool, text)
                if form is not None:
                    digest = hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    ids.append(cid)
                    his.append(int.from_bytes(digest[:8], "little", signed=True))
                    los.append(int.from_bytes(digest[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(his, pa.int64()), pa.array(los, pa.int64())], names=["call_id", "h1", "h2"])

    src = calls.where(F.col("call_id").isNotNull() & F.col("parameters").isNotNull()).select("call_id", "tool", "parameters")
    return src.mapInArrow(run, "call_id string, h1 bigint, h2 bigint")


def _cells(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """(HASHES, n) cell numbers by double hashing."""
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(size - 1) for i in range(HASHES)]).astype(np.int64)


def _unpack(bits: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bits), np.uint8)


def _merge(once: list[bytes], twice: list[bytes]) -> tuple[bytes, bytes]:
    one, two = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
    for o, t in zip(once, twice):
        o, t = _unpack(o), _unpack(t)
        two |= t | (one & o)
        one |= o
    return zlib.compress(one.tobytes(), 1), zlib.compress(two.tobytes(), 1)


def repeated_filter(hashes: DataFrame, cells: int) -> np.ndarray:
    """Bitmap of the cells that were hit at least twice over the whole table.

    A row counts each of its cells once. A task keeps two bits a cell of the segments it hits and
    sends them packed, so that its share grows with its rows. Filters are merged in two rounds so that
    no task sees more than the square root of all partial filters of one segment.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(h1):
                continue
            at = np.sort(_cells(h1, h2, cells), axis=0)
            fresh = np.ones(at.shape, bool)
            fresh[1:] = at[1:] != at[:-1]
            cell, n = np.unique(at[fresh], return_counts=True)
            segment = cell // SEGMENT
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            for i, j in zip(starts, [*starts[1:], len(cell)]):
                once, twice = held.setdefault(int(segment[i]), (np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)))
                local = cell[i:j] % SEGMENT
                byte, bit = local // 8, (128 >> (local % 8)).astype(np.uint8)
                again = (once[byte] & bit > 0) | (n[i:j] > 1)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
        salt = TaskContext.get().partitionId()
        for segment, (once, twice) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.array([salt], pa.int64()), *(pa.array([zlib.compress(x.tobytes(), 1)]) for x in (once, twice))],
                names=["segment", "salt", "once", "twice"],
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = _merge(list(pdf["once"]), list(pdf["twice"]))
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "salt": [0], "once": [once], "twice": [twice]})

    shape = "segment bigint, salt bigint, once binary, twice binary"
    parts = hashes.select("h1", "h2").mapInArrow(partial, shape)
    spread = max(1, int(hashes.rdd.getNumPartitions() ** 0.5))
    merged = parts.groupBy("segment", (F.col("salt") % spread).alias("g")).applyInPandas(merge, shape)
    if spread > 1:
        merged = merged.groupBy("segment").applyInPandas(merge, shape)
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.select("segment", "twice").toLocalIterator():
        at = row["segment"] * SEGMENT // 8
        bits[at : at + SEGMENT // 8] = _unpack(row["twice"])
    return bits


def cells_for(rows: int) -> int:
    """A power of two of at least ``CELLS_A_ROW`` cells a row, within one segment."""
    return max(SEGMENT, 1 << (CELLS_A_ROW * max(1, rows) - 1).bit_length())


def _marked(hashes: DataFrame, cells: int) -> tuple[DataFrame, object]:
    bits = hashes.sparkSession.sparkContext.broadcast(repeated_filter(hashes, cells))

    @F.pandas_udf("boolean")
    def maybe(h1: pd.Series, h2: pd.Series) -> pd.Series:
        at = _cells(h1.to_numpy(), h2.to_numpy(), cells)
        return pd.Series(((bits.value[at // 8] >> (7 - at % 8)) & 1).all(axis=0))

    return hashes.withColumn("maybe", maybe("h1", "h2")), bits


def split_by_filter(calls: DataFrame, most: int = MAX_CELLS) -> DataFrame:
    """(call_id, h1, h2, maybe) of :func:`hashed_calls`; maybe is false only for rows whose hash occurs once."""
    hashes = cut(hashed_calls(calls), "hashes")
    cells = cells_for(hashes.count())
    if cells <= most:
        return _marked(hashes, cells)[0]
    ranges = cells // most
    ranged = cut(hashes.withColumn("r", F.pmod("h2", F.lit(ranges))), "hash-ranges", "r")
    drop_cut(hashes)
    done = []
    for r in range(ranges):  # one range after the other, so that one filter is held at a time
        marked, bits = _marked(ranged.where(F.col("r") == r).drop("r"), most)
        done.append(cut(marked, "marked"))
        bits.unpersist()
    drop_cut(ranged)
    return union_all(done)


def _groups(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, groups): distinct calls of the possible repeats and their groups' first call and size."""
    members = marked.where("maybe").select("h1", "h2", "call_id").distinct()
    groups = members.groupBy("h1", "h2").agg(F.min("call_id").alias("first_call_id"), F.count("*").alias("n_calls"))
    return members, groups


def duplicate_calls(calls: DataFrame, most: int = MAX_CELLS) -> DataFrame:
    """(first_call_id, call_id) of every call that is not the smallest of its group.

    Rows of one call_id are one call. A group of any size is met by a join with its single group
    row, never gathered. Null call ids, null and unreadable parameters are left out.
    """
    marked = split_by_filter(calls, most)
    members, groups = _groups(marked)
    return (
        members.join(groups.where(F.col("n_calls") > 1), ["h1", "h2"])
        .where(F.col("call_id") != F.col("first_call_id"))
        .select("first_call_id", "call_id")
        .distinct()
    )


def collapsed_calls(calls: DataFrame, most: int = MAX_CELLS) -> DataFrame:
    """(call_id, n_calls): one row per distinct record, named by its smallest call."""
    marked = split_by_filter(calls, most)
    _, groups = _groups(marked)
    single = marked.where(~F.col("maybe")).select("call_id", F.lit(1).cast("bigint").alias("n_calls"))
    return groups.select(F.col("first_call_id").alias("call_id"), "n_calls").unionByName(single)
