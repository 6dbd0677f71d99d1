import random

from pyspark.sql import functions as F

from orrery.llm.spam import FEATURES, SIGNALS, features, page_features, page_signals, score_pages, weak_label

TEXT = "The residuals of L2W are precise before noon and noisy afterwards. We had to compare the station record because of a firmware change. "
KEYS = "\n".join(["récepteur gnss pas cher", "LOCATION RTK", "location rtk", "Tallis location rtk", "antenne promo"] * 8)
LINKS = "\n".join(f"* www.shop-{k}.example" for k in range(30))
TAGS = "#RtkSale #BestGnss #RtkSale #kestrix " * 12
STOCK = "\n".join(f"Meridan B{k} sale {k}69.00 USD" for k in range(200, 230))
PAIRS = " • ".join(f"used total station {c}" for c in ("Tarnby", "Quellford", "Skelby") * 8)
STUFFED = " ".join(["Best cors subscription of cors subscription for you.", "cors subscription? cors subscription! CORS SUBSCRIPTION.", "Buy cors subscription, cors subscription price, cors subscription near Weldasse."] * 6)
CUT = "\n".join(f'ref="https://dl.fixora-geo{k}.example/doc/{k}">antenna cable discount</a> <a href="https://kestrix-sat{k}.example/p/{k}">used total station</a> <a hr' for k in range(12))
REFS = TEXT * 3 + "\n\nReferences\n" + "\n".join(f"[{k}] Partial chi-square test notes, part {k}. https://a-{k}.example/p/{k}" for k in range(1, 12))
LOG = TEXT + "\n" + "\n".join(f"04:31:{k:02d} INFO no clock for VK69 at epoch {k}" for k in range(40))
TRACE = TEXT + "\n" + "\n".join(f"% 1 2021-01-17 07:21:{k:02d}.00 PHAS_MEAS R01 XZ26 L5Q -0.4125 0.5892 0.5491 KF-838" for k in range(40))
TABLE = TEXT + "\nsite | height | sats\n" + "\n".join(f"XQ90 | 19.{k} | {k}" for k in range(60))
CONF = TEXT + "\n" + "\n".join(f"epoch_buffer:\n    sigma: {k}\n    source: [L1C, L2W]" for k in range(30))
GLOSS = "\n".join(f"Term {k}: The tolerance of {k} seconds suits a diurnal stream, not a carrier phase." for k in range(20))
SPAM = [STUFFED, CUT, KEYS, LINKS, TAGS, STOCK, PAIRS, TEXT + "\n" + KEYS, TEXT + TAGS]
HAM = [TEXT, REFS, LOG, TRACE, TABLE, CONF, GLOSS, TEXT * 10 + "\n" + KEYS[:200], "Short."]


def spam_share(t):
    return sum(page_features(t)[:4])


def test_shares():
    for t in SPAM:
        assert spam_share(t) > 0.5
    for t in HAM:
        assert spam_share(t) < 0.4
    assert len(page_features("")) == len(FEATURES) and spam_share("x" * 2_000_000) == 0
    assert len(page_signals("")) == len(SIGNALS)


WORDS = "antenna clock orbit ridge sample filter bench tide mount signal epoch river survey mast".split()


def made(rng, label):
    """A page of random words: the texts of one seed share no line with those of another."""
    word = lambda: rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("klmnop")
    told = lambda: f"The {word()} of the {word()} was {rng.choice(['late', 'noisy', 'kept'])} because we had to {word()} it with a {word()} and the {word()}."
    said = [told() for _ in range(rng.randint(4, 30))]
    if not label:
        tail = rng.choice([
            lambda: [f"% 1 2021-01-{rng.randint(10, 28)} 07:21:{k % 60:02d}.00 PHAS_MEAS R01 {word()} L5Q -0.{rng.randint(1000, 9999)}" for k in range(30)],
            lambda: [f"{word()}:\n    {word()}: {rng.randint(1, 99)}" for _ in range(20)], lambda: [],
            lambda: [f"[{k}] {word()} notes of {word()}. https://{word()}.example/p/{k}" for k in range(3)],
        ])()
        return "\n".join([*said, *tail])
    phrases = [f"{word()} {word()}" for _ in range(6)]
    body = rng.choice([
        lambda: [rng.choice(phrases) for _ in range(60)], lambda: [f"https://www.{word()}.example/{k}" for k in range(40)],
        lambda: ["#" + word() for _ in range(60)], lambda: [f"{word()} B{k} sale {k}69.00 USD" for k in range(40)],
    ])()
    return "\n".join([*said[: rng.randint(0, 3)], *body])


def pages(spark, seed, n):
    rng = random.Random(seed)
    return [(seed * 100_000 + k, made(rng, k % 5 == 0), f"host{k % 7}", k % 5 == 0) for k in range(n)]


def test_held_out_accuracy(spark):
    """The trees are fitted on a sample by id; only pages outside it, all of other texts, are judged."""
    rows = pages(spark, 1, 900) + [(-1 - k, t, "host0", True) for k, t in enumerate(SPAM)] + [(-100 - k, t, "host1", False) for k, t in enumerate(HAM)]
    c = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    truth = {r[0]: r[3] for r in rows}
    got = score_pages(c, sample=300).withColumn("fitted", F.pmod(F.xxhash64("doc_id"), F.lit(-(-len(rows) // 300))) == 0).collect()
    unseen = [r for r in got if not r.fitted]
    assert all(r.weak is None for r in unseen) and len(unseen) > 500
    hit = sum(r.score > 0.5 and truth[r.doc_id] for r in unseen)
    assert hit >= 0.99 * sum(truth[r.doc_id] for r in unseen) - 1 and hit >= 0.99 * sum(r.score > 0.5 for r in unseen)


def test_hosts_move_undecided_pages(spark):
    """The same undecided page falls either way by its host; without trees nothing is found."""
    half = TEXT * 2 + "\n" + "\n".join(f"Meridan B{k} sale {k}69.00 USD" for k in range(200, 209))
    rng = random.Random(5)
    rows = [(k, made(rng, k % 3 == 0 if k % 2 else False), "good" if k % 2 == 0 else "bad") for k in range(600)]
    rows += [(1000, half, "good"), (1001, half, "bad")]
    got = {r.doc_id: r for r in score_pages(spark.createDataFrame(rows, "doc_id long, text string, source string"), prior=1.0, pull=1.0).collect()}
    assert got[1000].page == got[1001].page and got[1001].host_rate > got[1000].host_rate and got[1001].score > got[1000].score


def test_nulls_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "h"), (3, KEYS, None), (3, KEYS, None)], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.score > 0.5) for r in score_pages(df).collect())
    assert got == [(1, False), (2, False), (3, True), (3, True)]
    assert score_pages(df.where("false")).count() == 0


def test_weak_labels(spark):
    df = spark.createDataFrame([(k, t, "h") for k, t in enumerate([*SPAM, *HAM])], "doc_id long, text string, source string")
    got = {r.d: r.l for r in features(df, "doc_id", "text", "source").select("d", weak_label(F.col("s")).alias("l")).collect()}
    wrong = [k for k in got if got[k] not in (None, float(k < len(SPAM)))]
    # weak: the short text over a reference list has a link in every ten words
    assert wrong in ([], [len(SPAM) + HAM.index(REFS)])
