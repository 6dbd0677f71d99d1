import random

import numpy as np
import pytest

from orrery.llm.packing import TOKENIZER, best_fit, pack, token_sizes


def packed(spark, sizes, targets=(("s", 100), ("l", 1000)), **kw):
    df = spark.createDataFrame(sizes, "id long, size long")
    return pack(df, spark.createDataFrame(list(targets), "target string, capacity_tokens int"), **kw).collect()


def whole(rows, sizes, targets):
    for name, cap in targets:
        mine = [r for r in rows if r.target == name]
        fill, seen = {}, {}
        for r in mine:
            assert 0 < r.tokens <= cap
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            seen.setdefault(r.id, []).append((r.start, r.tokens))
        assert all(f <= cap for f in fill.values())
        want = {}
        for i, s in sizes:
            if s:
                want.setdefault(i, []).append(s)
        for i, ss in want.items():
            if len(ss) == 1:
                at = 0
                for start, n in sorted(seen[i]):
                    assert start == at
                    at += n
                assert at == ss[0] and (ss[0] > cap or len(seen[i]) == 1)
            else:
                assert sum(n for _, n in seen[i]) == sum(ss)
        assert set(seen) == set(want)
    return {n: sum(r.tokens for r in rows if r.target == n) / (c * len({r.container_id for r in rows if r.target == n})) for n, c in targets}


def test_everything_once_and_well_filled(spark):
    rnd = random.Random(1)
    sizes = [(i, min(5000, int(rnd.lognormvariate(3.5, 1.2)) + 1)) for i in range(3000)]
    targets = (("s", 100), ("l", 1000))
    for per_task in (20_000, 100):
        used = whole(packed(spark, sizes, targets, items_per_task=per_task, fan_in=3), sizes, targets)
        assert min(used.values()) > 0.97


def test_unmergeable_bins_and_carry(spark):
    sizes = [(i, 60) for i in range(500)]
    used = whole(packed(spark, sizes, (("s", 100),), items_per_task=50, carry=3), sizes, (("s", 100),))
    assert used["s"] == pytest.approx(0.6)


def test_edges(spark):
    sizes = [(1, 0), (2, None), (3, 100), (4, 250), (5, 1), (5, 1), (6, 200)]
    rows = packed(spark, sizes, (("s", 100), ("none", 0)))
    whole(rows, [(i, s or 0) for i, s in sizes], (("s", 100),))
    assert {r.target for r in rows} == {"s"} and sum(r.tokens for r in rows if r.id == 5) == 2
    assert packed(spark, []) == []


def test_best_fit():
    where, fill = best_fit(np.array([60, 50, 40, 50, 1]), 100)
    assert sorted(fill) == [1, 100, 100] and where[0] == where[2] and where[1] == where[3]


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 50_000)], "doc_id long, text string")
    got = {r.id: r.size for r in token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 1000
    for kind in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        other = {r.id: r.size for r in token_sizes(df, tokenizer=TOKENIZER.rpartition("/")[0] + "/" + kind).collect()}
        assert other[1] >= 2 and other[3] == 0
