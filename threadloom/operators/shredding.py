"""Deeply nested JSON records to flat tables by adjacency-table shredding.

A record becomes rows of one adjacency table: node, parent, label, ordinal and scalar. Depth is
unknown, so the traversal runs once per record with an explicit stack inside Arrow batches; all
the rest (choice of the counting record, joins of object nodes with their scalar children, pivot
into entity tables) are Spark operators on flat rows. A record never leaves its partition while
it is shredded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of ``state.input`` that stand for a list even when given as one bare object.
INPUT_LISTS = ("todos", "questions", "tool_calls", "content")

NODE_SCHEMA = (
    "message_id string, node_id bigint, parent_id bigint, label string, ordinal bigint, kind string, scalar string, "
    "json_path string, entity string, in_list boolean, holder_id bigint, member string"
)
#: Most member names that one entity may have as a wide table; ``flat_rows`` has no such bound.
MAX_LABELS = 5_000


def _reject(name: str):
    raise ValueError(name)


def read_json(text: str | None):
    """The decoded value, or None where the text is no JSON (also NaN, Infinity, absurd depth)."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _as_list(entity: str, label: str, value):
    """``value`` with bare objects read as lists of one and string inputs read as JSON."""
    if entity == "parts.state" and label == "input" and isinstance(value, str):
        inner = read_json(value)
        return inner if isinstance(inner, (dict, list)) else value
    if entity == "parts.state.input" and label in INPUT_LISTS and isinstance(value, dict):
        return [value]
    return value


def _step(key: str) -> str:
    """One step of a member path; keys that would read as several steps are quoted."""
    return json.dumps(key) if not key or any(x in key for x in '.[]"') else key


def shred_record(message_id: str, record: dict) -> Iterator[tuple]:
    """Adjacency rows of one {info, parts} record in document order; node 0 is the record.

    holder_id: the nearest object above a node that has a row of its own in the flat tables (an
    element of a list, ``info`` or the record); member: the path from there to the node.
    """
    parts = record.get("parts")
    root = {"info": record.get("info"), "parts": [parts] if isinstance(parts, dict) else parts}
    count = 0
    # entries: value, parent id, label, ordinal, path, entity, whether an element of a list, holder, member
    stack = [(root, None, None, 0, "", "", False, None, "")]
    while stack:
        value, parent, label, ordinal, path, entity, in_list, holder, member = stack.pop()
        node, count = count, count + 1
        if isinstance(value, dict):
            yield message_id, node, parent, label, ordinal, "object", None, path, entity, in_list, holder, member
            if in_list or not path or (path == "info" and parent == 0):
                holder, member = node, ""
            items = [
                (_as_list(entity, k, v), node, k, i, f"{path}.{k}" if path else k, f"{entity}.{k}" if entity else k, False, holder, f"{member}.{_step(k)}" if member else _step(k))
                for i, (k, v) in enumerate(value.items())
            ]
        elif isinstance(value, list):
            yield message_id, node, parent, label, ordinal, "list", None, path, entity, in_list, holder, member
            items = [(v, node, label, i, f"{path}[{i}]", entity, True, holder, f"{member}[{i}]") for i, v in enumerate(value)]
        else:
            yield message_id, node, parent, label, ordinal, "scalar", _scalar(value), path, entity, in_list, holder, member
            items = []
        stack.extend(reversed(items))


def counting_records(exports: DataFrame) -> DataFrame:
    """(message_id, payload) of the readable export with the greatest exported_at per info.id.

    exports: record_id, exported_at, payload. Null, unreadable or id-less payloads are no records;
    ties on the time go to the greatest record_id.
    """

    @F.pandas_udf("string")
    def message_id(payload: pd.Series) -> pd.Series:
        def one(text):
            value = read_json(text)
            info = value.get("info") if isinstance(value, dict) else None
            found = info.get("id") if isinstance(info, dict) else None
            return found if isinstance(found, str) and found.strip() else None

        return payload.map(one)

    return (
        exports.where(F.col("payload").isNotNull())
        .select(message_id("payload").alias("message_id"), "exported_at", "record_id", "payload")
        .where(F.col("message_id").isNotNull())
        .groupBy("message_id")
        .agg(F.max(F.struct("exported_at", "record_id", "payload")).alias("m"))
        .select("message_id", F.col("m.payload").alias("payload"))
    )


def shred(records: DataFrame) -> DataFrame:
    """Adjacency table of (message_id, payload) records, in the columns of ``NODE_SCHEMA``."""
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("message_id", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("label", pa.string()), ("ordinal", pa.int64()),
            ("kind", pa.string()), ("scalar", pa.string()), ("json_path", pa.string()), ("entity", pa.string()), ("in_list", pa.bool_()),
            ("holder_id", pa.int64()), ("member", pa.string()),
        ])
        for batch in batches:
            rows: list[tuple] = []
            for mid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = read_json(text)
                if not isinstance(value, dict):
                    continue
                for row in shred_record(mid, value):
                    rows.append(row)
                    if len(rows) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], names=names)

    return records.select("message_id", "payload").mapInArrow(run, NODE_SCHEMA)


def flat_rows(nodes: DataFrame) -> DataFrame:
    """Object nodes joined with their scalar children: one row per object that is an element of a list, and per ``info``.

    Columns: message_id, entity, node_id, owner_id (the row that encloses it; 0 is the record, which
    message_id names), ordinal, json_path, in_list, members (map from path to text). The scalars of
    nested objects and lists that have no rows of their own belong to the row around them. JSON
    numbers and booleans keep their JSON spelling. The join is one aggregation over both sides, which
    share their key; objects without scalars stay.
    """
    is_object = (F.col("kind") == "object") & (F.col("in_list") | ((F.col("entity") == "info") & (F.col("parent_id") == 0)))
    sides = nodes.where(is_object | ((F.col("kind") == "scalar") & F.col("holder_id").isNotNull())).select(
        "message_id",
        F.when(is_object, F.col("node_id")).otherwise(F.col("holder_id")).alias("node_id"),
        F.when(is_object, F.struct("entity", F.col("holder_id").alias("owner_id"), "ordinal", "json_path", "in_list")).alias("o"),
        F.when(~is_object, F.struct("member", "scalar")).alias("m"),
    )
    both = sides.groupBy("message_id", "node_id").agg(F.max("o").alias("o"), F.map_from_entries(F.collect_list("m")).alias("members"))
    return both.where(F.col("o").isNotNull()).select("message_id", "o.entity", "node_id", "o.owner_id", "o.ordinal", "o.json_path", "o.in_list", "members")


def list_objects(nodes: DataFrame) -> DataFrame:
    """The rows of ``flat_rows`` that are elements of a list below ``parts``."""
    return flat_rows(nodes).where(F.col("in_list") & F.col("entity").startswith("parts"))


def entity_table(nodes: DataFrame, entity: str, labels: list[str] | None = None, is_list: bool = True) -> DataFrame:
    """Flat table of the objects of one entity: their scalar members, one column per label.

    Without ``labels`` they are the members that the data has. Columns: message_id, node_id, owner_id,
    ordinal and json_path as in ``flat_rows``, then the labels (null where absent), prefixed by ``f_``
    so that none can clash; of labels that differ in letter case only, later ones get ``#2`` and so on.
    """
    rows = flat_rows(nodes).where((F.col("entity") == entity) & (F.col("in_list") == is_list))
    if labels is None:
        found = rows.select(F.explode(F.map_keys("members")).alias("k")).distinct().limit(MAX_LABELS + 1).collect()
        if len(found) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} members in {entity}")
        labels = sorted(r["k"] for r in found)
    seen: dict[str, int] = {}
    columns = []
    for x in labels:
        seen[x.lower()] = n = seen.get(x.lower(), 0) + 1
        columns.append(F.try_element_at("members", F.lit(x)).alias(f"f_{x}" if n == 1 else f"f_{x}#{n}"))
    return rows.select("message_id", "node_id", "owner_id", "ordinal", "json_path", *columns)
