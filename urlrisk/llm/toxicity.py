"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import is_training, light_batches, utf8

TOKEN = re.compile(r"\w+")
SPAN = "struct<start:int,end:int,text:string,probability:double>"
#: Tokens that one vectorised pass holds; longer single texts get a pass of their own.
TOKENS_AT_ONCE = 400_000
_CLIP = 15.0


class Tagger(NamedTuple):
    """Two tags, clean (0) and toxic (1). Word 0 stands for all that aren't in ``words``."""

    words: dict[str, int]
    own: np.ndarray  # score of toxic against clean, by the token's word
    before: np.ndarray  # by the word before it
    after: np.ndarray
    move: np.ndarray  # 2 x 2 transition scores
    doc: np.ndarray  # bias and weights of the document features


def lowered(text: str) -> str:
    """Lower case with the same number of code points."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Chains:
    """Texts of any lengths, end to end, longest first; recursions step through all of them at once."""

    def __init__(self, lengths: Sequence[int]) -> None:
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        by_length = self.lengths[self.order]
        self.sorted_starts = self.starts[self.order]
        steps = int(by_length[0]) if len(by_length) else 0
        self.active = np.searchsorted(-by_length, -np.arange(steps), side="left")  # texts longer than t

    def marginals(self, odds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of toxic against clean. A message is a pair of numbers; only their
        ratio matters, so nothing under- or overflows however long a text is."""
        (oo, ot), (to, tt) = np.exp(move)
        forward, backward = np.empty_like(odds), np.ones_like(odds)
        last = None
        for t, n in enumerate(self.active.tolist()):
            at = self.sorted_starts[:n] + t
            here = odds[at]
            if last is not None:
                prev = last[:n]
                here = here * (ot + tt * prev) / (oo + to * prev)
            forward[at] = last = here
        for t in range(len(self.active) - 2, -1, -1):
            n = int(self.active[t + 1])
            later = self.sorted_starts[:n] + t + 1
            ahead = odds[later] * backward[later]
            backward[later - 1] = (to + tt * ahead) / (oo + ot * ahead)
        return forward, backward


def neighbours(ids: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after each token; -1 at the ends of a text."""
    before, after = np.roll(ids, 1), np.roll(ids, -1)
    some = chains.lengths > 0
    before[chains.starts[some]] = -1
    after[(chains.starts + chains.lengths - 1)[some]] = -1
    return before, after


def emission(tagger: Tagger, ids: np.ndarray, chains: Chains) -> np.ndarray:
    before, after = neighbours(ids, chains)
    score = tagger.own[ids] + np.where(before >= 0, tagger.before[before], 0) + np.where(after >= 0, tagger.after[after], 0)
    return np.exp(np.clip(score, -_CLIP, _CLIP))


def document_features(p: np.ndarray, chains: Chains) -> np.ndarray:
    """Per text: 1, its highest marginal, and the log of one plus the expected number of toxic tokens."""
    out = np.zeros((len(chains.lengths), 3))
    out[:, 0] = 1.0
    some = chains.lengths > 0
    if some.any():
        out[some, 1] = np.maximum.reduceat(p, chains.starts[some])
        out[some, 2] = np.log1p(np.add.reduceat(p, chains.starts[some]))
    return out


def significant(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, most: int) -> dict[str, float]:
    """Words whose document counts differ between the classes: signed G statistics of at least 16."""
    share, out = n_toxic / (n_toxic + n_clean), {}
    for word in toxic.keys() | clean.keys():
        a, b = toxic[word], clean[word]
        n = a + b
        expect = n * share
        g = 2 * ((a * math.log(a / expect) if a else 0.0) + (b * math.log(b / (n - expect)) if b else 0.0))
        if g >= 16:
            out[word] = g if a > expect else -g
    return dict(sorted(out.items(), key=lambda x: (-abs(x[1]), x[0]))[:most])


def learn(texts: list[str], toxic: np.ndarray, ratio: float, lexicon: int, rounds: int) -> Tagger | None:
    """Train on whole texts with a class each; ``ratio`` restores the classes' true odds.

    Token labels come from the texts' classes: in a toxic text, the words that significantly go with
    toxic texts and are rare in clean ones. The field's likelihood is then climbed by Adam.
    """
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return None
    tokens = [TOKEN.findall(lowered(t)) for t in texts]
    per = {True: Counter(), False: Counter()}
    for own, label in zip(tokens, toxic.tolist(), strict=True):
        per[label].update(set(own))
    chosen = significant(per[True], per[False], n_toxic, n_clean, lexicon)
    words = {w: i + 1 for i, w in enumerate(chosen)}
    offending = np.zeros(len(words) + 1, bool)
    for w, i in words.items():
        a, b = per[True][w] / n_toxic, per[False][w] / n_clean
        offending[i] = chosen[w] > 0 and a > 10 * b
    chains = Chains([len(t) for t in tokens])
    ids = np.fromiter((words.get(w, 0) for own in tokens for w in own), np.int64, int(chains.lengths.sum()))
    of = np.repeat(np.arange(len(tokens)), chains.lengths)
    tag = (offending[ids] & toxic[of]).astype(float)
    before, after = neighbours(ids, chains)
    has_before, has_after = before >= 0, after >= 0
    size = len(words) + 1
    weights = [np.zeros(size), np.zeros(size), np.zeros(size), np.zeros((2, 2))]
    weights[0][:] = -2.0
    second = np.flatnonzero(has_before)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (tag[second - 1].astype(int), tag[second].astype(int)), 1)
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    tagger = Tagger(words, *weights, np.zeros(3))
    for step in range(1, rounds + 1):
        odds = emission(tagger, ids, chains)
        forward, backward = chains.marginals(odds, tagger.move)
        both = forward * backward
        gap = tag - both / (1 + both)
        scale = np.exp(tagger.move)
        # expected transitions, from the forward message of one token and the backward one of the next
        r, s = forward[second - 1], odds[second] * backward[second]
        four = np.array([[scale[0, 0] + 0 * r, scale[0, 1] * s], [scale[1, 0] * r, scale[1, 1] * r * s]])
        expected = (four / four.sum(axis=(0, 1))).sum(axis=2)
        n = max(1.0, tag.sum())
        gradient = [
            np.bincount(ids, gap, size) / n,
            np.bincount(before[has_before], gap[has_before], size) / n,
            np.bincount(after[has_after], gap[has_after], size) / n,
            (pairs - expected) / n,
        ]
        fresh = []
        for i, (w, g) in enumerate(zip((tagger.own, tagger.before, tagger.after, tagger.move), gradient, strict=True)):
            g = g - 1e-3 * w
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            fresh.append(w + 0.4 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8))
        tagger = Tagger(words, *fresh, tagger.doc)
    forward, backward = chains.marginals(emission(tagger, ids, chains), tagger.move)
    both = forward * backward
    x = document_features(both / (1 + both), chains)
    return tagger._replace(doc=logistic(x, toxic.astype(float), np.where(toxic, ratio, 1.0)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a slightly regularised logistic regression by Newton's method; a step that goes too far is halved."""
    ridge = np.eye(x.shape[1]) * 1e-2

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + w @ ridge @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, x.T @ (weight * (y - p)) - ridge @ w)
        now, share = loss(w), 1.0
        while share > 1e-6 and loss(w + share * step) > now:
            share /= 2
        if share <= 1e-6:
            break
        w = w + share * step
    return w


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 2500, lexicon: int = 20_000, rounds: int = 60
) -> Tagger | None:
    """Learn from labelled documents: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic 0/1).

    The classifier is fitted on a bounded sample of labelled rows: about ``sample`` documents of each
    class, whole texts, chosen by a hash of the id; ``lexicon`` bounds its words. The sampled ids, at most
    2 x 2 x ``sample``, are broadcast to the documents, and one task trains. Documents with several labels
    count as toxic if one is; null ids, labels and texts teach nothing. None if a class is missing.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    count = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if len(count) < 2:
        return None
    steps = 1 << 20
    cut = F.when(F.col("toxic") == 1, min(steps, -(-steps * sample // count[1]))).otherwise(min(steps, -(-steps * sample // count[0])))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(steps))
    chosen = known.where(F.col("toxic").isin(0, 1) & (draw < cut)).limit(4 * sample)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), utf8("text").alias("_text"))
    # ids aren't unique for certain: one text each, so that the sample stays bounded
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("_text").alias("_text")).withColumn("_one", F.lit(1))
    odds = (count[1] / count[0])

    def train(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("doc_id")
        label = own["toxic"].to_numpy() == 1
        ratio = odds / max(1e-9, label.sum() / max(1, (~label).sum()))
        tagger = learn([t.decode() for t in own["_text"]], label, ratio, lexicon, rounds)
        if tagger is None:
            return pd.DataFrame({"word": [], "i": [], "own": [], "before": [], "after": [], "rest": []}, dtype=object)
        rest = [*tagger.move.ravel().tolist(), *tagger.doc.tolist()]
        names = ["", *tagger.words]
        return pd.DataFrame({
            "word": names, "i": range(len(names)), "own": tagger.own, "before": tagger.before, "after": tagger.after,
            "rest": [rest if not i else None for i in range(len(names))]})

    got = sorted(found.groupBy("_one").applyInPandas(
        train, "word string, i int, own double, before double, after double, rest array<double>").collect(), key=lambda r: r["i"])
    if not got:
        return None
    rest = got[0]["rest"]
    return Tagger(
        {r["word"]: r["i"] for r in got[1:]}, *(np.array([r[c] for r in got]) for c in ("own", "before", "after")),
        np.array(rest[:4]).reshape(2, 2), np.array(rest[4:]))


def score_texts(texts: list[str], tagger: Tagger) -> tuple[np.ndarray, list[list[dict]]]:
    """Document scores, and the spans of tokens that are toxic rather than not."""
    low = [lowered(t) for t in texts]
    tokens = [TOKEN.findall(t) for t in low]
    chains = Chains([len(t) for t in tokens])
    get = tagger.words.get
    parts = [np.fromiter(map(get, own, repeat(0)), np.int64, len(own)) for own in tokens]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    forward, backward = chains.marginals(emission(tagger, ids, chains), tagger.move)
    both = forward * backward
    p = both / (1 + both)
    score = 1 / (1 + np.exp(-np.clip(document_features(p, chains) @ tagger.doc, -30, 30)))
    spans: list[list[dict]] = [[] for _ in texts]
    hits = np.flatnonzero(p >= 0.5)
    where = np.searchsorted(chains.starts, hits, side="right") - 1
    for d in np.unique(where):
        own = set((hits[where == d] - chains.starts[d]).tolist())
        for i, m in enumerate(TOKEN.finditer(low[d])):
            if i in own:
                spans[d].append({"start": m.start(), "end": m.end(), "text": texts[d][m.start():m.end()],
                                 "probability": float(p[chains.starts[d] + i])})
    return score, spans


def score(docs: DataFrame, tagger: Tagger | None, base: float = 0.0) -> DataFrame:
    """(doc_id, score, toxic_spans) per document.

    Every token of the whole text gets the marginal probability of the toxic tag, from the forward and
    backward recursions over its chain; tokens at 0.5 or more are toxic spans, with code point offsets.
    The highest marginal and the expected number of toxic tokens make the score. Null and empty texts are
    scored as texts without tokens; without a tagger (nothing to learn from) every score is ``base``. Invalid
    UTF-8 is read as U+FFFD. One pass, no shuffle, one output row per input row, none for an empty table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t.decode() for t in batch["_text"]]
            scores: list[np.ndarray] = []
            spans: list[list[dict]] = []
            at = 0
            while at < len(texts):
                to, room = at, TOKENS_AT_ONCE * 6
                while to < len(texts) and (to == at or len(texts[to]) <= room):
                    room -= len(texts[to])
                    to += 1
                a, b = (np.full(to - at, base), [[]] * (to - at)) if tagger is None else score_texts(texts[at:to], tagger)
                scores.append(a)
                spans += b
                at = to
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "score": np.concatenate(scores) if scores else [],
                "toxic_spans": pd.Series(spans, dtype=object)})

    light_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), utf8("text").alias("_text")).mapInPandas(
        run, f"doc_id bigint, score double, toxic_spans array<{SPAN}>")


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tagger = fit(docs, labels.where(is_training(F.col("doc_id"), 5, 0)))
    spans = F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return score(docs, tagger).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.concat_ws(",", spans).alias("offsets"))
