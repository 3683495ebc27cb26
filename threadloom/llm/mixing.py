"""Mixing sources to target weights, measured in tokens of a public tokenizer.

The tokens of each source are packed, in an order drawn by hash, into blocks of ``BLOCK_TOKENS`` that
hold the token ids themselves. The mix is a row of output shards of ``SHARD_SLOTS`` slots; the slots of a
shard are given to sources by one multinomial draw, made in Spark over ranges of shards. The i-th slot of a source takes block perm(i mod n) in the (i div n)-th pass over
its n blocks, with one pseudorandom permutation per source and pass, and slots are joined with
blocks by (source, block).

A source may hold a third of all rows: the running token count of a source is taken in two steps,
inside hash buckets and over the small table of bucket sums, never in one window over a source.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.durable import cut, drop_cut, spread

TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 512
SHARD_SLOTS = 256
BUCKET_DOCS = 20_000
#: Documents whose tokens are held at once.
BATCH_DOCS = 512
MAX_SOURCES = 10_000
#: Shards that one task draws for.
RANGE_SHARDS = 4096
BATCH_SLOTS = 100_000


def source_name(c: str | Column) -> Column:
    """Source spelled in lower case with underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_-]+", "_")


def token_ids(documents: DataFrame, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, tokens) of every document with a source and at least one token.

    The vocabulary (50,256 entries, about 1 MB) is read on the driver and broadcast.
    """
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=held.value, special_tokens={})
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(start, BATCH_DOCS)
                ids, ends = array("i"), [0]
                for text in batch.column(2):
                    ids.extend(coder.encode_ordinary(text.as_py()))
                    ends.append(len(ids))
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), tokens], names=["doc_id", "source", "n_tokens", "tokens"])

    src = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), source_name("source").alias("source"), "text"
    )
    return spread(src.where(F.col("source") != "")).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, tokens array<int>").where(F.col("n_tokens") > 0)


def token_counts(documents: DataFrame, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with a source and at least one token."""
    return token_ids(documents, folder, vocabulary).select("doc_id", "source", "n_tokens")


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, max_repeats); rows without a source or a positive share set no target.

    Spellings of one source are one target: the greatest share and the greatest repeat count. A null
    or smaller repeat count is 1. The table names sources, at most ``MAX_SOURCES``.
    """
    rows = (
        targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
        .where((F.col("source") != "") & (F.col("target_share") > 0) & ~F.isnan("target_share"))
        .groupBy("source")
        .agg(F.max("target_share").alias("share"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).alias("most"))
        .orderBy("source")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return {r["source"]: (r["share"], r["most"]) for r in rows}


def pack(counts: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block, n_tokens, pieces, tokens) with pieces array<struct<doc_id, from_token, to_token>>.

    Documents of a source follow one another by hash bucket and hash; blocks are cut from their
    tokens without gaps, so only the last block of a source may be short. Pieces run from from_token
    up to but not including to_token. tokens: the ids of the block's tokens, piece after piece.
    """
    buckets = max(1, counts.count() // BUCKET_DOCS)
    h = F.xxhash64("doc_id")
    rows = counts.select("doc_id", "source", "n_tokens", "tokens", h.alias("h"), F.pmod(h, F.lit(buckets)).alias("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "bucket", before.alias("bucket_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", inside).join(starts, ["source", "bucket"]).select(
        "source", "doc_id", "tokens", (F.col("bucket_start") + F.col("upto") - F.col("n_tokens")).alias("a"), (F.col("bucket_start") + F.col("upto")).alias("b")
    )
    size = F.lit(block_tokens).cast("bigint")
    first, last = F.expr(f"a div {block_tokens}"), F.expr(f"(b - 1) div {block_tokens}")
    cuts = placed.select("source", "doc_id", "tokens", "a", "b", F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest("a", F.col("block") * size), F.least("b", (F.col("block") + 1) * size)
    pieces = cuts.select("source", "block", F.struct(lo.alias("at"), "doc_id", (lo - F.col("a")).alias("from_token"), (hi - F.col("a")).alias("to_token"), F.slice("tokens", (lo - F.col("a") + 1).cast("int"), (hi - lo).cast("int")).alias("tokens")).alias("p"))
    return pieces.groupBy("source", "block").agg(F.sum(F.col("p.to_token") - F.col("p.from_token")).alias("n_tokens"), F.sort_array(F.collect_list("p")).alias("p")).select(
        "source", "block", "n_tokens", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["from_token"].alias("from_token"), x["to_token"].alias("to_token"))).alias("pieces"),
        F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens"),
    )


@dataclass
class Plan:
    """What the draws go by: sources in order, their shares, blocks and repeats, and the slots in all."""

    names: list[str]
    share: np.ndarray
    blocks: np.ndarray
    supply: np.ndarray
    total: int

    @staticmethod
    def of(blocks: dict[str, int], targets: dict[str, tuple[float, int]]) -> Plan:
        """The mix is as large as the shares allow: the source that runs out first sets the total."""
        names = sorted(s for s in targets if blocks.get(s, 0) > 0)
        share = np.array([targets[s][0] for s in names])
        n = np.array([blocks[s] for s in names], np.int64)
        supply = n * np.array([targets[s][1] for s in names], np.int64)
        share = share / share.sum() if names else share
        return Plan(names, share, n, supply, max(1, int((supply / share).min())) if names else 0)


def draw(shards: range, plan: Plan, shard_slots: int, seed: int) -> np.ndarray:
    """counts[shard, source] of one range of shards, by a generator of its own; only the last shard of all may be short."""
    at = np.arange(shards.start, shards.stop, dtype=np.int64)
    sizes = np.minimum(shard_slots, plan.total - at * shard_slots)
    return np.random.default_rng([seed, shards.start]).multinomial(sizes, plan.share).astype(np.int64)


@dataclass
class Moves:
    """How draws above a source's supply go to others: ``over`` of ``drawn`` draws leave a source, chosen
    over all shards by a pseudorandom permutation; the j-th of all that leave, permuted again, goes to
    the source whose part of range(sum(over)) holds it."""

    drawn: np.ndarray
    over: np.ndarray
    taken: np.ndarray

    @staticmethod
    def of(drawn: np.ndarray, plan: Plan) -> Moves:
        over = np.maximum(drawn - plan.supply, 0)
        room = np.maximum(plan.supply - drawn, 0)
        taken = np.minimum(room, np.maximum(np.floor(plan.share * plan.total).astype(np.int64) - drawn, 0))
        left = int(over.sum() - taken.sum())
        if left < 0:  # more is missing than leaves: each gets its part of it
            taken = taken * int(over.sum()) // max(1, int(taken.sum()))
            left = int(over.sum() - taken.sum())
        for s in np.argsort(-(room - taken), kind="stable"):
            more = min(left, int(room[s] - taken[s]))
            taken[s] += more
            left -= more
        return Moves(drawn, over, taken)

    def apply(self, source: np.ndarray, i: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(source, index in it) of the i-th draws of the sources."""
        source, i = source.copy(), i.copy()
        hit = np.flatnonzero(self.over[source])
        if len(hit):
            s = source[hit]
            q = permuted(i[hit], self.drawn[s], seed * 7919 + s)
            stay = q >= self.over[s]
            i[hit[stay]] = (q - self.over[s])[stay]
            leaves = hit[~stay]
            first = np.cumsum(self.over) - self.over
            n = int(self.over.sum())
            j = permuted((first[s] + q)[~stay], np.full(len(leaves), n), np.full(len(leaves), seed * 104_729 + 1))
            ends = np.cumsum(self.taken)
            to = np.searchsorted(ends, j, side="right")
            source[leaves] = to
            i[leaves] = self.drawn[to] + j - (ends - self.taken)[to]
        return source, i


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) per key, by a four-round Feistel walk."""
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            x = right + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def mix(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZER_FOLDER, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(mix, blocks). mix: shard, slot, source, block, pass_no, n_tokens, pieces, tokens; one row per slot.

    Sources without documents get no slots and the shares of the rest are scaled up to 1. Without any
    usable target the mix is empty.
    """
    spark = documents.sparkSession
    wanted = read_targets(targets)
    counts = cut(token_ids(documents, folder), "token-ids")
    blocks = cut(pack(counts.where(F.col("source").isin(list(wanted))) if wanted else counts.limit(0), block_tokens), "token-blocks")
    drop_cut(counts)
    n_blocks = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.count("*").alias("n")).collect()}
    slots = draw_slots(spark, Plan.of(n_blocks, wanted), shard_slots, seed)
    return slots.join(blocks, ["source", "block"]), blocks


def draw_slots(spark: SparkSession, plan: Plan, shard_slots: int = SHARD_SLOTS, seed: int = 1, range_shards: int = RANGE_SHARDS) -> DataFrame:
    """(shard, slot, source, pass_no, block) of every slot of the mix.

    A task draws for a range of shards; where the draws of a source begin in its range is a running
    sum over one row per range and source. Draws depend on seed and range only, so a lost task is drawn
    again alike. The driver holds one row per source.
    """
    n_shards = -(-plan.total // shard_slots)
    n_ranges = -(-n_shards // range_shards)
    held = spark.sparkContext.broadcast(plan)  # at most MAX_SOURCES rows

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                shards = range(r * range_shards, min((r + 1) * range_shards, n_shards))
                n = draw(shards, held.value, shard_slots, seed)
                shard, source = np.nonzero(n)
                before, inside = np.cumsum(n, 0) - n, np.cumsum(n, 1) - n
                cols = [np.full(len(shard), r), shard + shards.start, source, n[shard, source], before[shard, source], inside[shard, source]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["range_no", "shard", "source_no", "n", "before", "first_slot"])

    drawn = spark.range(0, n_ranges, 1, max(1, min(n_ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(counts, "range_no bigint, shard bigint, source_no bigint, n bigint, before bigint, first_slot bigint")
    sums = drawn.groupBy("range_no", "source_no").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range_no", "source_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    per_source = np.zeros(len(plan.names), np.int64)
    for row in sums.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        per_source[row["source_no"]] = row["n"]
    moves = spark.sparkContext.broadcast(Moves.of(per_source, plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, names = held.value, np.array(held.value.names, object)
        for batch in batches:
            shard, source, n, first, slot = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            at = 0
            while at < len(n):  # about BATCH_SLOTS slots at once
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(n[at:]), BATCH_SLOTS)))
                some, at = slice(at, to), to
                each = np.repeat(np.arange(len(n[some])), n[some])
                j = np.arange(len(each)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                with np.errstate(over="ignore"):
                    s, i = moves.value.apply(source[some][each], first[some][each] + j, seed)
                    turn, where = i // plan.blocks[s], i % plan.blocks[s]
                    block = permuted(where, plan.blocks[s], seed * 1_000_003 + s * 65_537 + turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[some][each]), pa.array(slot[some][each] + j), pa.array(names[s], pa.string()), pa.array(turn), pa.array(block)], names=["shard", "slot", "source", "pass_no", "block"]
                )

    rows = drawn.join(starts, ["range_no", "source_no"]).select("shard", "source_no", "n", (F.col("start") + F.col("before")).alias("first"), "first_slot")
    return rows.mapInArrow(place, "shard bigint, slot bigint, source string, pass_no bigint, block bigint")


def shares(mixed: DataFrame, blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target, the share scaled to 1, what it offers and what the mix really holds."""
    wanted = read_targets(targets)
    spark = mixed.sparkSession
    named = spark.createDataFrame([(s, t, m) for s, (t, m) in wanted.items()], "source string, target_share double, max_repeats bigint")
    offered = blocks.groupBy("source").agg(F.sum("n_tokens").alias("offered_tokens"))
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.max(F.col("pass_no") + 1).alias("passes"))
    out = named.join(offered, "source", "left").join(used, "source", "left").na.fill(0, ["offered_tokens", "mix_tokens", "passes"])
    everything = Window.partitionBy(F.lit(1))  # one row per target source
    with_docs = F.when(F.col("offered_tokens") > 0, F.col("target_share")).otherwise(0.0)
    return out.select(
        "source", "target_share", "max_repeats", "offered_tokens", "mix_tokens", "passes",
        F.try_divide(with_docs, F.sum(with_docs).over(everything)).alias("scaled_share"),
        F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(everything)).alias("actual_share"),
    )
