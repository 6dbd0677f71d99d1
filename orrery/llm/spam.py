"""Keyword-stuffed pages, link lists, tag and stock lists among sentences.

Each page becomes a row of content and link features (mapped once, never shuffled). Weak labels come from labelling
functions on a bounded sample of pages; they read signals the trees never see (compression, function words, anchors,
tags and prices a word, repeated word pairs, sentence ends), each votes or abstains, and a page most of them leave
open has no label. Bagged decision trees learn from the labelled pages and score all; the log odds of each
score are then moved by those of its host's spam rate, a map-side combined aggregate.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import checkpointed

# Frequent function words of the corpus' languages.
STOPWORDS = frozenset(
    "the a an and or of to in is are was were be by for with on at as from that this it its not no but if when which how do does did has have had we our you your they their than then so into without between after before during "
    "der die das und oder von zu im in ist sind war den dem des ein eine nicht mit auf für als auch bei nach bis sich wird wegen ohne zwischen unter liegen bitte sie "
    "le la les et ou de du des un une est sont dans par pour avec sur en au aux que qui ne pas il elle nous avons été entre après reste "
    "el los las y o del al es son en por para con una se que no lo como más entre sin unos unas conviene".split()
)
FEATURES = ("link", "tag", "stock", "keyword", "sentence", "structure", "plain", "distinct", "hosts", "upper", "length")
SIGNALS = ("compression", "function_words", "anchors", "tags", "prices", "repeated_pairs", "sentence_ends", "digits", "records")

_LINK = re.compile(r"<a\b[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\s]*\)|https?://\S+|\bwww\.\S+|(?<!\S)(?:[a-z0-9-]+\.)+(?:example|com|org|net|info|biz|shop)(?:/\S*)?(?!\S)", re.I)
_LINKISH = ("://", "](", "<a", "www.", ".example", ".com", ".org", ".net", ".info", ".biz", ".shop")
_HOST = re.compile(r"(?:https?://)?(?:www\.|dl\.)?((?:[a-z0-9-]+\.)+[a-z]{2,})", re.I)
_TAG = re.compile(r"(?<!\S)#\w+")
_PRICE = re.compile(r"\d+[.,]\d{2}\s*(?:USD|EUR|GBP|CHF|credits?|dollars?|euros?|€|\$|£)|[€$£]\s*\d", re.I)
_PRICED = ("usd", "eur", "gbp", "chf", "credit", "dollar", "€", "$", "£")
_STRUCTURE = re.compile(
    r"^\s*(?:%\s|\d{1,2}:\d{2}:\d{2}\b|#+ \S|page \d+ of \d+|[\w-]+:\s*(?:\[.*\]|[\w.+-]*)\s*$|(?:tags|keywords)\s*:|\[\d+\]\s|[^|\n]{1,20}\|[^|\n]{1,20}\|\s*[\d.-]+\s*$|site \| )", re.I
)
_MONEY = re.compile(r"\b(?:USD|EUR|GBP|CHF|credits?|dollars?|euros?)\b|[€$£]", re.I)
_RECORD = re.compile(r"^[ \t]*(?:%[ \t]|\d{1,2}:\d{2}:\d{2}\b|\[\d+\][ \t]|[\w-]+:(?:[ \t]|$)|[^|\n]{1,20}\|[^|\n]{1,20}\|)", re.M)
_END = re.compile(r"[.?!](?:\s|$)")
_CUT = re.compile(r"(?<=[.?!])\s+")
_SIDE = re.compile(r"[|/;•·,]")
_WORD = re.compile(r"[^\W\d_]+")


def _any(marks: tuple[str, ...], low: str) -> bool:
    for m in marks:
        if m in low:
            return True
    return False


def _kind(u: str, words: list[str], stops: int) -> str:
    """A unit's kind; a unit without a sentence's end needs two different function words to be one ('pas cher' is none)."""
    if _STRUCTURE.match(u):
        return "structure"
    low = u.lower()
    if _any(_PRICED, low) and _PRICE.search(u) and stops <= 1 + len(words) // 6:
        return "stock"
    bare = _LINK.sub(" ", u) if _any(_LINKISH, low) else u
    if bare != u:
        rest = _WORD.findall(bare)
        # what is left of a cut anchor gives one 'a' after another
        s = len(STOPWORDS.intersection(w.lower() for w in rest))
        told = bare.strip().endswith((".", "?", "!")) and len(rest) >= 3 or s >= 2
        return "sentence" if told else "link"
    if "#" in u and _TAG.search(u):
        return "tag" if stops <= len(words) // 8 else "sentence"
    if (u.rstrip()[-1:] in (".", "?", "!") and len(words) >= 3) or (len(words) >= 4 and stops * 12 >= len(words) and len(STOPWORDS.intersection(words)) >= 2):
        return "sentence"
    return "short"


def _phrase(u: str) -> bool:
    """A few words and nothing else: no digits, hardly a function word."""
    words = _WORD.findall(u)
    return 1 <= len(words) <= 6 and not any(c.isdigit() for c in u) and 4 * sum(w.lower() in STOPWORDS for w in words) <= len(words)


def _listing(u: str) -> bool:
    """Four or more phrases side by side."""
    parts = [p for p in _SIDE.split(u) if p.strip()]
    return len(parts) >= 4 and all(map(_phrase, parts[1:-1]))


def page_features(text: str) -> list[float]:
    """The page's features, in the order of FEATURES; the first seven are shares of its characters and add up to one."""
    size: Counter = Counter()
    shorts: list[tuple[str, list[str]]] = []
    told: list[tuple[str, list[str]]] = []
    seen: Counter = Counter()
    n_words = n_upper = 0
    vocabulary: set[str] = set()
    for line in text.splitlines():
        for u in _CUT.split(line):
            if not u.strip():
                continue
            raw = _WORD.findall(u)
            words = list(map(str.lower, raw))
            stops = len([1 for w in words if w in STOPWORDS])
            kind = _kind(u, words, stops)
            if kind == "short":
                shorts.append((u, words))
            elif kind == "sentence":
                told.append((u, words))
            else:
                size[kind] += len(u)
            if kind != "structure":
                n_words += len(words)
                n_upper += len([1 for w in raw if len(w) > 1 and w.isupper()])
                vocabulary.update(words)
                seen.update(zip(words, words[1:], strict=False))
    lone = [_phrase(u) for u, _ in shorts]
    listed = sum(lone) >= 5
    for (u, words), alone in zip(shorts, lone, strict=True):
        pairs = list(zip(words, words[1:], strict=False))
        often = sum(seen[p] >= 3 for p in pairs)
        keyword = (often > 0 and often * 3 >= len(pairs)) or (alone and listed) or _listing(u)
        size["keyword" if keyword else "plain"] += len(u)
    # a pair said at every eighth word is a keyword even between full stops
    main = {p for p, c in seen.items() if c >= 6 and 8 * c >= n_words and not STOPWORDS.intersection(p)}
    for u, words in told:
        inside = len([1 for p in zip(words, words[1:], strict=False) if p in main]) if main else 0
        size["keyword" if inside and 6 * inside >= len(words) else "sentence"] += len(u)
    total = max(1, sum(size.values()))
    share = {k: size[k] / total for k in ("link", "tag", "stock", "keyword", "sentence", "structure", "plain")}
    links = _LINK.findall(text) if _any(_LINKISH, text.lower()) else []
    hosts = {m.group(1).lower() for x in links if (m := _HOST.search(x))}
    return [
        share["link"], share["tag"], share["stock"], share["keyword"], share["sentence"], share["structure"], share["plain"],
        len(vocabulary) / max(1, n_words), 100 * len(hosts) / max(1, n_words), n_upper / max(1, n_words), float(np.log1p(len(text))),
    ]


def page_signals(text: str) -> list[float]:
    """What the labelling functions read, in the order of SIGNALS: none of it is among the features."""
    raw = text.encode("utf-8", "replace")
    words = list(map(str.lower, _WORD.findall(text)))
    n = max(1, len(words))
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = sum(1 for line in text.splitlines() if line.strip())
    anchors = sum(text.count(m) for m in ("http", "www.", "](", "<a ", ".example"))
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)), sum(w in STOPWORDS for w in words) / n, anchors / n, text.count("#") / n, len(_MONEY.findall(text)) / n,
        sum(c for c in pairs.values() if c >= 3) / max(1, sum(pairs.values())), len(_END.findall(text)) / n, sum(map(str.isdigit, text)) / max(1, len(text)),
        len(_RECORD.findall(text)) / max(1, lines),
    ]


def features(docs: DataFrame, doc_id: str, text: str, host: str, every: int = 1) -> DataFrame:
    """(d, host, x array<double>, s array<double>): null texts have null features; signals s only for one in ``every`` pages, by a hash of the id."""
    src = docs.select(F.col(doc_id).alias("d"), F.col(host).alias("host"), F.col(text).alias("t"), (F.pmod(F.xxhash64(F.col(doc_id)), F.lit(every)) == 0).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            x = [None if t is None else page_features(t) for t in texts]
            s = [page_signals(t) if c and t is not None else None for t, c in zip(texts, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64())), pa.array(s, pa.list_(pa.float64()))], names=["d", "host", "x", "s"])

    types = {c: src.schema[c].dataType.simpleString() for c in ("d", "host")}
    return src.mapInArrow(run, schema=f"d {types['d']}, host {types['host']}, x array<double>, s array<double>")


def weak_label(s: Column) -> Column:
    """1.0 spam, 0.0 not, null where the labelling functions' votes do not add up to two either way."""
    f = {n: s[i] for i, n in enumerate(SIGNALS)}
    votes = [
        F.when(f["compression"] <= 0.30, 1).when(f["compression"] >= 0.55, -1).otherwise(0),
        F.when(f["function_words"] <= 0.02, 1).when(f["function_words"] >= 0.26, -1).otherwise(0),
        F.when(f["repeated_pairs"] >= 0.5, 1).when(f["repeated_pairs"] <= 0.05, -1).otherwise(0),
        F.when((f["sentence_ends"] < 0.01) & (f["digits"] < 0.02), 1).when((f["sentence_ends"] > 0.05) & (f["anchors"] < 0.02), -1).otherwise(0),
        F.when(f["records"] >= 0.4, -3).otherwise(0), F.when((f["digits"] >= 0.12) & (f["prices"] < 0.02) & (f["anchors"] < 0.02), -1).otherwise(0),
        # a word in ten an anchor, one in seven a tag, one in sixteen a price: hardly a text
        F.when(f["anchors"] >= 0.10, 3).otherwise(0), F.when(f["tags"] >= 0.15, 3).otherwise(0), F.when(f["prices"] >= 0.06, 3).otherwise(0),
    ]
    total = sum(votes, F.lit(0))
    return F.when(total >= 2, 1.0).when(total <= -2, 0.0)


def _host_rates(scored: DataFrame, rates: DataFrame) -> DataFrame:
    """Every page with its host's rate: broadcast where few hosts, else each host's pages are spread over 32 salts."""
    if rates.limit(20_001).count() <= 20_000:
        return scored.join(F.broadcast(rates), F.col("host").eqNullSafe(F.col("h")), "left")
    left = scored.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(32)).cast("int"))
    right = rates.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return left.join(right, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("k")), "left")


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4))
    return F.log(q / (1 - q))


def score_pages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", sample: int = 20_000, trees: int = 32, depth: int = 6, prior: float = 20.0, pull: float = 1.0, seed: int = 7
) -> DataFrame:
    """(doc_id, host, weak, page, host_rate, score): the weak label where there is one, the trees' spam probability, the host's smoothed rate, and the two combined.

    At most about ``sample`` rows, chosen by a hash of the id, are labelled to fit the trees (the only bound; every page is scored).
    A host's rate is its mean page probability, drawn to the overall rate by ``prior`` pages; the score moves the page's log odds by ``pull`` times
    the host's log odds over the overall ones. Null texts score 0; a null host is a host; with no labelled page of either class the share of links, tags,
    stock and keywords in the text is the page's score. Very long texts are read whole. Repeated rows are scored each. Empty tables give no rows.
    """
    every = max(1, -(-docs.count() // sample))
    pages = checkpointed(features(docs, doc_id, text, host, every)).withColumn("weak", weak_label(F.col("s")))
    train = pages.where("weak IS NOT NULL").select("d", array_to_vector("x").alias("features"), F.col("weak").alias("label"))
    train = checkpointed(train.repartition(6, "d").sortWithinPartitions("d"))
    page = sum((F.col("x")[i] for i in range(1, 4)), F.col("x")[0])
    if train.select("label").distinct().count() == 2:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=1.0, seed=seed, maxBins=64).fit(train)
        zeros = F.array(*[F.lit(0.0)] * len(FEATURES))
        pages = model.transform(pages.withColumn("features", array_to_vector(F.coalesce("x", zeros))))
        page = vector_to_array("probability")[1]
    scored = checkpointed(pages.select("d", "host", "weak", F.when(F.col("x").isNull(), 0.0).otherwise(page).alias("page")))
    hosts = checkpointed(scored.groupBy(F.col("host").alias("h")).agg(F.sum("page").alias("s"), F.count("*").alias("n")))
    overall = hosts.agg(F.sum("s") / F.sum("n")).first()[0] or 0.0
    back = _host_rates(scored, hosts.select("h", ((F.col("s") + prior * overall) / (F.col("n") + prior)).alias("host_rate")))
    odds = _logit(F.col("page")) + pull * (_logit(F.col("host_rate")) - _logit(F.lit(float(overall))))
    return back.select(F.col("d").alias(doc_id), F.col("host").alias(host), "weak", "page", "host_rate", (1 / (1 + F.exp(-odds))).alias("score"))
