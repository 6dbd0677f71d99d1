"""Documents of varying token length into containers of fixed capacity.

Hierarchical residual packing. Partitions of bounded size pack their items best-fit in decreasing order and emit
the nearly full bins; the underfull ones go on as items of their own fill to a tree of rounds, each merging the
partitions of the one before by a fixed fan-in and packing best-fit again. Only bins travel in the rounds, never
items, and a task hands on at most ``carry`` bins (the emptiest); the others are final as they are, so no task grows with the input.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import checkpointed, sized

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a public tokenizer's tokens, chosen by the file's kind; special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, size): tokens of each whole text; null texts have none."""
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count([t or "" for t in b.column(1).to_pylist()]), pa.int64())], names=["id", "size"])

    return src.mapInArrow(run, schema=f"id {src.schema['id'].dataType.simpleString()}, size bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(bin of each item, fill of each bin), best-fit in decreasing order; ties by position. Sizes are 1 to capacity."""
    where = np.empty(len(sizes), dtype=np.int64)
    fill: list[int] = []
    room: dict[int, list[int]] = {}
    mask = 0  # bit r is set where a bin has r tokens of room
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = mask >> s
        if above:
            r = (above & -above).bit_length() - 1 + s
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        fill[b] += s
        where[i] = b
        if r > s:
            room.setdefault(r - s, []).append(b)
            mask |= 1 << (r - s)
    return where, fill


def _carried(fill: list[int], capacity: int, full: float, carry: int) -> np.ndarray:
    """Which bins go on: the emptiest of those not nearly full."""
    f = np.asarray(fill)
    under = np.flatnonzero(f < full * capacity)
    out = np.zeros(len(f), dtype=bool)
    out[under[np.argsort(f[under], kind="stable")[:carry]]] = True
    return out


def pack(sizes: DataFrame, targets: DataFrame, items_per_task: int = 20_000, fan_in: int = 8, full: float = 0.98, carry: int = 512) -> DataFrame:
    """(target, container_id, id, piece, start, tokens): where each document's tokens lie.

    sizes is (id, size), targets (target, capacity_tokens), a short list read by the driver. A document of at most the capacity is one piece; a longer one is cut into full
    containers and a rest that is packed like any other. Documents without tokens (null or empty) lie in no container. Repeated rows are
    packed each. A target without a positive capacity gets nothing. Every token is in exactly one container and none
    holds more than its capacity, whatever ``carry`` and ``full`` are; they only trade unused space for work.
    """
    goal = targets.where("capacity_tokens > 0").select("target", F.col("capacity_tokens").cast("long")).distinct().collect()
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(int(c)).cast("long").alias("cap")) for t, c in goal]) if goal else F.array().cast("array<struct<target:string,cap:bigint>>")
    have = checkpointed(sizes.where("size > 0")).withColumn("row", F.monotonically_increasing_id())
    parts = max(1, -(-have.count() // items_per_task))
    all_ = have.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("_g", F.explode(each)).select("id", "size", "row", "part", "_g.target", "_g.cap")
    whole = all_.where("size >= cap").select("target", "id", "row", "cap", F.explode(F.sequence(F.lit(0), (F.floor(F.col("size") / F.col("cap")) - 1).cast("int"))).alias("piece"))
    whole = whole.select("target", F.concat_ws("/", "target", F.lit("w"), "row", "piece").alias("container_id"), "id", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("tokens"))
    rest = all_.select("target", "cap", "part", "id", "row", (F.col("size") % F.col("cap")).alias("s"), F.floor(F.col("size") / F.col("cap")).cast("int").alias("piece")).where("s > 0")
    idt = rest.schema["id"].dataType.simpleString()

    def local(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending")])
        target, part = key[0].as_py(), key[1].as_py()
        cap = t["cap"][0].as_py()
        where, fill = best_fit(t["s"].to_numpy(), cap)
        on = _carried(fill, cap, full, carry)
        names = np.array([f"{target}/{part}/{b}" for b in range(len(fill))])
        return pa.table({
            "target": t["target"], "cap": t["cap"], "part": t["part"], "id": t["id"], "piece": t["piece"], "s": t["s"],
            "bin": pa.array(names[where].tolist(), pa.string()), "fill": pa.array(np.asarray(fill)[where], pa.int64()), "on": pa.array(on[where]),
        })

    first = rest.groupBy("target", "part").applyInArrow(local, schema=f"target string, cap bigint, part int, id {idt}, piece int, s bigint, bin string, fill bigint, `on` boolean")
    first = checkpointed(first)

    def again(rnd: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("bin", "ascending")])
            target, part = key[0].as_py(), key[1].as_py()
            cap = t["cap"][0].as_py()
            where, fill = best_fit(t["fill"].to_numpy(), cap)
            on = _carried(fill, cap, full, carry)
            names = np.array([f"{target}/{rnd}.{part}/{b}" for b in range(len(fill))])
            return pa.table({
                "target": t["target"], "cap": t["cap"], "part": pa.array(np.full(len(t), part), pa.int32()), "old": t["bin"],
                "bin": pa.array(names[where].tolist(), pa.string()), "fill": pa.array(np.asarray(fill)[where], pa.int64()), "on": pa.array(on[where]),
            })

        return run

    on = first.where("`on`").select("target", "cap", "part", "bin", "fill").distinct()
    rounds, left, rnd = [], parts, 0
    while left > 1:
        rnd, left = rnd + 1, -(-left // fan_in)
        grown = on.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        step = grown.groupBy("target", "part").applyInArrow(again(rnd), schema="target string, cap bigint, part int, old string, bin string, fill bigint, `on` boolean")
        step = checkpointed(step)
        rounds.append(step.select("old", "bin"))
        on = step.where("`on`").select("target", "cap", "part", "bin", "fill").distinct()
    final = first.select("target", "id", "piece", "cap", "s", "bin")
    if rounds:
        chain = rounds[-1]
        for step in reversed(rounds[:-1]):
            chain = step.join(chain.select(F.col("old").alias("bin"), F.col("bin").alias("to")), "bin", "left").select("old", F.coalesce("to", "bin").alias("bin"))
        final = final.join(sized(chain.select(F.col("old").alias("bin"), F.col("bin").alias("to"))), "bin", "left").withColumn("bin", F.coalesce("to", "bin"))
    packed = final.select("target", F.col("bin").alias("container_id"), "id", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.col("s").alias("tokens"))
    return packed.unionByName(whole)
