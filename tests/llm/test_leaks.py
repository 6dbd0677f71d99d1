import random

import numpy as np

from orrery.llm.leaks import Index, MultiIndex, find_leaks, reader_words, search

ITEM = "Antenna offset 1.698 at QQ86 was entered as 25.68, so E15 shows 353 bad rows at 79 degrees; find the dual-frequency reflector of the five floating ones"


def leaks(spark, docs, items=((1, ITEM),), where="exact", **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((r.item_id, r.doc_id) for r in find_leaks(d, q, **kw).where(where).collect())


def test_words_as_a_reader_sees_them():
    assert reader_words("The <b>re</b>flec­tor&nbsp;of reﬂec-\n> tion, １.５７３ **Wo**rd [see](http://x.y/z) `code` ﬁxed wei​ghs") == "the reflector of reflection 1 573 word see code fixed weighs".split()
    voc = frozenset({"dual", "frequency", "steering"})
    assert reader_words("dual-\r\nfrequency steer-\ning", voc) == ["dual", "frequency", "steering"]
    assert reader_words("") == []


def test_variants_found(spark):
    w = ITEM.split(" ")
    part = " ".join(w[3:17])
    docs = [
        (1, "Some text. " + ITEM + " more."), (2, part), (3, " ".join(w[3:12])), (4, part.upper().replace(" ", "  \n")), (5, part.replace(" ", "&nbsp;").replace("bad", "<i>bad</i>")), (6, part.replace("entered", "ent-\n> ered")),
        (7, part.replace("1.698", "１.６９８")), (8, part.replace("entered", "altered")), (9, None), (10, ""), (11, "Find the du­al-frequency reﬂector of the ﬁve ﬂoating ones x at 79 degrees; find"), (12, "79 degrees; find the dual-\nfrequency reﬂector of the ﬁve ﬂoating ones"),
    ]
    assert leaks(spark, docs) == [(1, i) for i in (1, 2, 4, 5, 6, 7, 12)]


def test_blocks_of_items(spark):
    items = [(k, ITEM if k == 7 else f"nothing {k} " * 10) for k in range(20)]
    assert leaks(spark, [(1, ITEM)], items, block_chars=600) == [(7, 1)]


def passage(rng, n=60):
    return [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randint(0, 30)}" for _ in range(n)]


def test_edited_passages_are_found():
    """An item with a word swapped, inserted or dropped in its middle third, in other text: at least nine of ten found; unlike ones never."""
    rng = random.Random(4)
    items = [passage(rng, rng.randint(44, 90)) for _ in range(60)]
    index = Index([(k, " ".join(ws)) for k, ws in enumerate(items)], 12, 5, 7)
    hit = n = 0
    for k, ws in enumerate(items):
        for edit in range(3):
            at, new = rng.randint(len(ws) // 3, 2 * len(ws) // 3), rng.choice(["zig", "zag"])
            ws2 = ws[:at] + ([new, ws[at]] if edit == 1 else [new] if edit == 0 else []) + ws[at + 1 :]
            got = list(search(index, [passage(rng) + ws2 + passage(rng), passage(rng, 200)], 0.8))
            assert all(d == 0 and i == k for d, i, *_ in got)
            # the whole passage, not only its untouched parts
            long = list(search(Index([(k, " ".join(ws))], len(ws) - len(ws) % 8, 5, 7), [passage(rng) + ws2 + passage(rng)], 0.8))
            n, hit = n + 1, hit + bool(long)
            assert got
    assert hit >= 0.9 * n


def test_radius_decides():
    """An edited passage without twelve words in a row is found within the radius and not without it."""
    rng = random.Random(9)
    ws = passage(rng, 23)
    edited = ws[:11] + ["zig"] + ws[12:]
    item = [(1, " ".join(ws))]
    wide, none = Index(item, 12, 2, 20), Index(item, 12, 2, 0)
    assert [(i, e) for _, i, _, _, e in search(wide, [edited], 0.75)] == [(1, False)] and not list(search(none, [edited], 0.75))


def brute(items, docs, least, k, radius, share):
    """All windows of all sizes against all, by the definitions."""
    import math

    import xxhash

    def fp(ws):
        return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(w) >> b & 1 for w in ws) > len(ws))

    grams = lambda ws: [tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)]
    df: dict = {}
    for i in items:
        for g in set(grams(i)):
            df[g] = df.get(g, 0) + 1
    weight = {g: math.log(1 + len(items) / c) for g, c in df.items()}
    out = set()
    for n, i in enumerate(items):
        sizes = {len(i) - len(i) % 8, *(least * 2**e for e in range(5) if least * 2**e <= len(i))}
        for size in sizes:
            for a in range(len(i) - size + 1):
                w = i[a : a + size]
                for m, d in enumerate(docs):
                    for b in range(len(d) - size + 1):
                        x = d[b : b + size]
                        if (fp(w) ^ fp(x)).bit_count() <= radius:
                            have, want = grams(x), grams(w)
                            got = sum(weight[g] * min(have.count(g), want.count(g)) for g in set(want)) / sum(weight[g] for g in want)
                            if got >= share - 1e-9:
                                out.add((m, n))
    return out


def test_against_all_windows():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnop")
    items = [[word() for _ in range(17)] for _ in range(3)]
    docs = []
    for i in items:
        j = list(i)
        j[rng.randint(2, 14)] = "q"
        docs += [[word() for _ in range(5)] + j[: rng.randint(10, 17)] + [word() for _ in range(4)], i[:9] + i[4:13]]
    index = Index([(n, " ".join(i)) for n, i in enumerate(items)], 12, 2, 9)
    assert {(d, i) for d, i, *_ in search(index, docs, 0.5)} == brute(items, docs, 12, 2, 9, 0.5) != set()


def test_long_text_ties_and_empty(spark):
    filler = "word " * 130_000
    assert leaks(spark, [(1, filler + ITEM + " " + filler), (2, filler), (1, ITEM)]) == [(1, 1), (1, 1)]
    assert leaks(spark, []) == [] and leaks(spark, [(1, ITEM)], []) == [] and leaks(spark, [(1, ITEM)], [(1, None), (2, "short")]) == []


def test_no_pair_within_the_radius_is_lost():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 400, dtype=np.uint64)
    ask = np.concatenate([fp[:50] ^ np.uint64(0x8000000100000001), fp[50:60], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    got = [(a, b) for w, k in MultiIndex(fp, 15).pairs(ask) for a, b in zip(w.tolist(), k.tolist(), strict=True)]
    want = {(a, b) for a in range(len(ask)) for b in np.flatnonzero(np.bitwise_count(fp ^ ask[a]) <= 15)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 60


def test_against_brute_force(spark, base):
    d, q = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/eval_item.parquet")
    items = [(r.item_id, reader_words(r.text)) for r in q.collect()]
    voc = frozenset(x for _, ws in items for x in ws)
    grams: dict = {}
    for i, ws in items:
        for k in range(len(ws) - 11):
            grams.setdefault(tuple(ws[k : k + 12]), set()).add(i)
    want = set()
    for r in d.select("doc_id", "text").collect():
        ws = reader_words(r.text or "", voc)
        want |= {(i, r.doc_id) for k in range(len(ws) - 11) for i in grams.get(tuple(ws[k : k + 12]), ())}
    assert {(r.item_id, r.doc_id) for r in find_leaks(d, q).where("exact").collect()} == want
