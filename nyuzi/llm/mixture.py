"""Sources mixed to target weights, by Pfair scheduling of equal blocks.

Sizes are tokens of a public tokenizer. Each source gives its target share of the mixture, its records repeated at most
``max_repeats`` times; what a short source cannot give is spread over the others by their weights.

The mixture is cut into equal ranges and each source's part of a range into equal blocks of at most ``BLOCK`` tokens. A range is a Pfair schedule in
whole numbers: of N slots, block i of a source with k blocks is released at slot floor(i * N / k) and due by ceil((i + 1) * N / k), and the released
block due earliest takes each slot, so at every slot each source is within one block of its share, and exactly at its share where a range ends. All
ranges of a mixture have the same schedule, of at most ``SLOTS`` slots and one a source more; only their number grows with the data, so the
schedule is made once and sent to the executors.

Sources are few: at most ``MAX_SOURCES``, checked, are added up on the driver. Records never are: running sums over any source, however large, are
spread over ranges of a hash (:func:`nyuzi.llm.prefix.running_sum`).

Defined results: a null source or one without target is in no mixture, though its tokens count in the size of all documents;
null and empty texts have no tokens and are not drawn; weights of null or 0 draw nothing; sources that differ in case or outer
blanks are one; records of equal hash keep the order of their ids; an empty table gives shares of 0; extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.llm.prefix import buckets_for, running_sum
from nyuzi.session import cut

#: Where the public tokenizer's ranks lie, unless the session's setting ``spark.nyuzi.tokenizer`` says otherwise; every executor has the folder.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-splitting pattern published with byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_SOURCES = 10_000
#: Most tokens of a block, and slots of a range but for one a source.
BLOCK, SLOTS = 65_536, 4_096

_encodings: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer, read once a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def source_key(col):
    return F.lower(F.trim(col))


def count_tokens(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``*carry, tokens``: whole texts are encoded; one pass over the scan."""
    path = path or docs.sparkSession.conf.get("spark.nyuzi.tokenizer", TOKENIZER)
    source = docs.select(*carry, text)
    schema = T.StructType([source.schema[c] for c in carry] + [T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(n, pa.int64())], names=[*carry, "tokens"])

    return source.mapInArrow(run, schema)


def plan_shares(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, dict[str, float]]:
    """For each target source its wanted and reachable tokens and what the mixture draws of it.

    ``wanted`` is the target share of ``total``; ``most`` all documents used ``max_repeats`` times; ``drawn`` fills up to
    ``total`` with sources that can give more, in proportion to their weights.
    """
    out = {s: {"weight": w or 0.0, "size": float(sizes.get(s, 0)), "repeats": r or 0, "wanted": (w or 0.0) * total, "most": float(sizes.get(s, 0)) * (r or 0)} for s, (w, r) in targets.items()}
    open_, left = {s for s in out if out[s]["weight"] > 0}, total
    for s in out:
        out[s]["drawn"] = 0.0
    while open_ and left > 1e-9:
        span = sum(out[s]["weight"] for s in open_)
        full = {s for s in open_ if out[s]["most"] <= left * out[s]["weight"] / span}
        if not full:
            for s in open_:
                out[s]["drawn"] = left * out[s]["weight"] / span
            break
        for s in full:
            out[s]["drawn"] = out[s]["most"]
            left -= out[s]["most"]
        open_ -= full
    return out


def pfair(blocks: dict[str, int]) -> list[tuple[int, str, int]]:
    """``slot, source, block`` of one range: earliest deadline among the blocks released; ties go to the larger source, then by name.

    Every source has all its ``blocks`` after as many slots as there are blocks. All windows are whole numbers, so nothing is rounded.
    """
    total = sum(n for n in blocks.values() if n > 0)
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s] > 0]  # release, source, block
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // blocks[s]), -blocks[s], s, i))
        _, _, s, i = heapq.heappop(ready)
        out.append((slot, s, i))
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (max(slot + 1, (i + 1) * total // blocks[s]), s, i + 1))
    return out


class Schedule(NamedTuple):
    """How often a range repeats, its slots, and the blocks of each source in it."""

    ranges: int
    slots: list[tuple[int, str, int]]
    blocks: dict[str, int]

    @classmethod
    def of(cls, sizes: dict[str, float], most: float = BLOCK, slots: int = SLOTS) -> Schedule:
        """For sources of these sizes in tokens."""
        sizes = {s: v for s, v in sizes.items() if v > 0}
        total = sum(sizes.values())
        blocks = {s: max(1, math.ceil(slots * (v / total))) for s, v in sizes.items()}
        return cls(max(1, math.ceil(total / (slots * most))), pfair(blocks), blocks)


def source_plan(docs: DataFrame, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, dict, float]:
    """Token counts of the documents (checkpointed), the plan by source, and the tokens of all documents taken once."""
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_weight", "max_repeats").where("source IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = cut(count_tokens(docs.select("doc_id", source_key(F.col("source")).alias("source"), "text"), ["doc_id", "source"], "text", path))
    wanted = {r["source"]: (r["target_weight"], r["max_repeats"]) for r in rows}
    known = docs.sparkSession.createDataFrame([(s, True) for s in wanted], "source string, known boolean")  # at most MAX_SOURCES rows
    by = tokens.groupBy("source").agg(F.sum("tokens").alias("n")).join(F.broadcast(known), "source", "left")
    sums = by.groupBy(F.when(F.col("known"), F.col("source")).alias("source")).agg(F.sum("n").alias("n")).collect()
    total = float(sum(r["n"] or 0 for r in sums))
    return tokens, plan_shares({r["source"]: r["n"] for r in sums if r["source"] is not None}, wanted, total), total


def unfilled(spark: SparkSession, wanted: dict[str, float], has: dict[str, float], most: float = BLOCK) -> DataFrame:
    """``range, source, n_blocks, lacking``: blocks of the schedule that a source cannot fill, and their missing tokens, range by range.

    The schedule is of what is ``wanted`` of each source; block by block it draws on what the source ``has``.
    """
    plan = Schedule.of(wanted, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = pd.DataFrame(plan.slots, columns=["slot", "source", "block"])
        k, want, have = (slots["source"].map(x).to_numpy() for x in (plan.blocks, wanted, has))
        for b in batches:
            for r in b["id"]:
                block = r * k + slots["block"].to_numpy()
                # the last block ends exactly at what is wanted
                lacking = np.minimum(want * ((block + 1) / (plan.ranges * k)) - have, want / (plan.ranges * k))
                short = slots.assign(range=r, lacking=lacking)[lacking > 0]
                yield short.groupby(["range", "source"], as_index=False).agg(n_blocks=("slot", "size"), lacking=("lacking", "sum"))

    return spark.range(plan.ranges if plan.slots else 0).mapInPandas(run, "range long, source string, n_blocks long, lacking double")


def short_sources(docs: DataFrame, targets: DataFrame, path: str | None = None, block: float = BLOCK) -> DataFrame:
    """``source`` (as the targets write it) of those that cannot fill the blocks that the schedule of the target weights asks of them."""
    _, plan, _ = source_plan(docs, targets, path)
    asked = unfilled(docs.sparkSession, {s: v["wanted"] for s, v in plan.items()}, {s: v["most"] for s, v in plan.items()}, block)
    short = asked.select(F.col("source").alias("_short")).distinct()
    return targets.join(short, source_key(F.col("source")) == F.col("_short"), "left_semi").select("source")


def share_report(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """``source, target_share, actual_share, tokens_once, tokens_drawn, repeats, short`` of the mixture as it is drawn."""
    mixed, plan = mix(docs, targets, path)
    spark = docs.sparkSession
    base = spark.createDataFrame(
        [(s, float(v["weight"]), int(v["size"]), bool(v["most"] < v["wanted"])) for s, v in plan.items()], "source string, target_share double, tokens_once bigint, short boolean"
    )
    drawn = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens_drawn"), (F.max("copy") + 1).alias("repeats"))
    out = base.join(drawn, "source", "left").withColumn("tokens_drawn", F.coalesce("tokens_drawn", F.lit(0)))
    all_drawn = F.sum("tokens_drawn").over(_everything())
    return out.select("source", "target_share", F.coalesce(F.try_divide("tokens_drawn", all_drawn), F.lit(0.0)).alias("actual_share"), "tokens_once", "tokens_drawn", F.coalesce("repeats", F.lit(0)).cast("int").alias("repeats"), "short")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # one row a source


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, block: float = BLOCK) -> tuple[DataFrame, dict]:
    """``doc_id, source, copy, tokens, slot, place``: the mixture in order of ``slot`` and ``place``; and the plan.

    Every source is one endless line of its documents in hash order, copy after copy, up to what is drawn of it; a document lies in the
    block in which it begins.
    """
    spark = docs.sparkSession
    tokens, plan, _ = source_plan(docs, targets, path)
    drawn = {s: v["drawn"] for s, v in plan.items() if v["drawn"] > 0}
    order = Schedule.of(drawn, block)
    by_source = spark.createDataFrame(
        [(s, v, plan[s]["size"], int(plan[s]["repeats"]), order.blocks[s]) for s, v in drawn.items()], "source string, drawn double, size double, repeats int, k long"
    )
    lined = running_sum(tokens.where("tokens > 0").join(F.broadcast(by_source), "source"), ["source"], F.col("doc_id"), "tokens", "at", buckets_for(tokens.count()))
    copies = F.least(F.ceil((F.col("drawn") - F.col("at")) / F.col("size")).cast("int"), F.col("repeats"))
    each = lined.where(F.col("at") < F.col("drawn")).select("doc_id", "source", "tokens", "at", "size", "drawn", "k", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    at, blocks = F.col("at") + F.col("copy") * F.col("size"), order.ranges * F.col("k")
    no = F.least(F.floor(at / F.col("drawn") * blocks).cast("bigint"), blocks - 1)
    each = each.select("doc_id", "source", "copy", "tokens", F.floor(no / F.col("k")).alias("_r"), (no % F.col("k")).alias("block"), at.cast("bigint").alias("place"))
    slots = spark.createDataFrame(order.slots, "_s long, source string, block long")  # at most SLOTS and one a source
    slot = F.col("_r") * len(order.slots) + F.col("_s")
    return each.join(F.broadcast(slots), ["source", "block"]).select("doc_id", "source", "copy", "tokens", slot.alias("slot"), "place"), plan
