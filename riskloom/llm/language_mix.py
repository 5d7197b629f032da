"""Languages of a text as a mixture, by expectation-maximisation over character n-grams.

Each language has a distribution of the n-grams (one to three characters, lower case, what is
no letter a single space) of its documents, counted over all documents that it may learn from
and smoothed. A text's n-grams are taken as drawn from a mixture of the languages. Its
proportions are found by EM: each n-gram is shared out to the languages by their proportion and
likelihood, and the shares are the new proportions. More languages always fit better, so sets
of languages, the leading one, the leading two and so on, are compared by log-likelihood less
PENALTY * log(n) for each language after the first, n the number of characters; the best set
is kept and the language with the greatest proportion predicted, its proportion the score.

The log-likelihood is concave in the proportions, so its slopes at a language alone bound what
any mixture can gain on it. Where that is less than the penalty, EM has nothing to find and is
left out; this changes no result.

Defined results: a text that is null or has no letter is `und` with score 0 and no languages,
and so is every text if there is nothing to learn from; equal proportions go to the language
that sorts first; repeated rows come out each, and count each where they are learned from; a null id counts as the empty text in
crc32; extra columns take no part; an empty table gives no rows. The model has one number for
each language and feature, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_texts, hash_remainder, per_worker
from riskloom.session import checkpoint

#: Hashed features, longest n-gram, pseudo-count of each feature.
FEATURES, LONGEST, SMOOTH = 1 << 15, 3, 0.05
#: Times log(n): what a further language must gain.
PENALTY = 4.0
#: Rounds of EM and least change of a proportion that calls for another.
ROUNDS, STILL = 60, 1e-4
#: Features of the texts that go through EM together.
BLOCK = 200_000
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for start in range(0, 0x110000, 0x1000):
        table[start : start + 0x1000] = [chr(i).isalpha() for i in range(start, start + 0x1000)]
    return table


def ngrams(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Hashed n-grams of a text, None if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    is_letter = letters[code]
    if not is_letter.any():
        return None
    code = np.concatenate([[np.uint64(32)], np.where(is_letter, code, np.uint64(32)), [np.uint64(32)]])
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    out, value = [], np.zeros(len(code), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(LONGEST, len(code)) + 1):
            value = (value[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            out.append((value >> np.uint64(13)) & np.uint64(FEATURES - 1))
    return np.concatenate(out).astype(np.int64)


def letters_here() -> np.ndarray:
    return per_worker("letters", letter_table)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, feature and n over all rows of (lang, text): each partition counts its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, counts = letters_here(), {}
        for b in batches:
            for lang, text in zip(b["lang"], as_texts(b["text"]), strict=True):
                if (found := ngrams(text, letters)) is not None:
                    held = counts.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
                    held += np.bincount(found, minlength=FEATURES)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"lang": lang, "feature": at.astype(np.int32), "n": held[at]})

    return docs.select("lang", "text").mapInPandas(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages, sorted, and the probability of each feature in each (features, languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.p = ((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * FEATURES)).astype(np.float32)
        self.log_p = np.log(self.p)

    def mixtures(self, texts: list[str], penalty: float = PENALTY) -> list[list[tuple[str, float]]]:
        """For each text its languages and their proportions, the greatest first."""
        letters, out, block, size = letters_here(), [], [], 0
        for text in texts:
            found = ngrams(text, letters) if self.languages else None
            counts = None if found is None else np.bincount(found, minlength=FEATURES)
            at = np.empty(0, dtype=np.int64) if counts is None else np.flatnonzero(counts)
            block.append((at, counts[at] / min(LONGEST, len(at)) if len(at) else at.astype(float)))
            size += len(at)
            if size >= BLOCK:
                out += self._block(block, penalty)
                block, size = [], 0
        return out + self._block(block, penalty)

    def _block(self, block: list[tuple[np.ndarray, np.ndarray]], penalty: float) -> list[list[tuple[str, float]]]:
        out: list[list[tuple[str, float]]] = [[] for _ in block]
        own = [i for i, (at, _) in enumerate(block) if len(at)]
        if own:
            doc, share = self._choose([block[i] for i in own], penalty)
            for i, row in zip(own, share, strict=True):
                order = sorted(np.flatnonzero(row), key=lambda j: (-row[j], j))
                out[i] = [(self.languages[j], float(row[j])) for j in order]
        return out

    def _choose(self, block: list[tuple[np.ndarray, np.ndarray]], penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (documents, languages) of the best set of languages of each document."""
        feature, x = np.concatenate([at for at, _ in block]), np.concatenate([c for _, c in block])
        length = np.array([len(at) for at, _ in block])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        n = np.add.reduceat(x, start)
        alone = np.add.reduceat(x[:, None] * self.log_p[feature], start, axis=0)
        best = alone.argmax(axis=1)
        share = np.zeros(alone.shape)
        share[np.arange(len(block)), best] = 1.0
        doc, cost = np.repeat(np.arange(len(block)), length), penalty * np.log(n + 1)
        p = self.p[feature].astype(np.float64)
        slope = np.add.reduceat((x / p[np.arange(len(feature)), best[doc]])[:, None] * p, start, axis=0).max(axis=1) - n
        unsure = np.flatnonzero(slope > cost)
        if len(unsure) and len(self.languages) > 1:
            rows = np.flatnonzero(np.isin(doc, unsure))
            mixed = self._mixed(p[rows], x[rows], length[unsure], n[unsure], alone[unsure].max(axis=1), cost[unsure])
            chosen = np.flatnonzero(mixed.sum(axis=1))
            share[unsure[chosen]] = mixed[chosen]
        return doc, share

    def _mixed(self, p, x, length, n, single, cost) -> np.ndarray:
        """Proportions of the best set of several languages, zeros where one language is best."""
        out, best = np.zeros((len(length), p.shape[1])), single.copy()
        everything, _ = em(p, x, length, n, np.full((len(length), p.shape[1]), 1 / p.shape[1]))
        order = np.argsort(-everything, axis=1, kind="stable")
        active = np.arange(len(length))
        for k in range(2, p.shape[1] + 1):
            member = np.zeros((len(length), p.shape[1]), dtype=bool)
            np.put_along_axis(member, order[:, :k], True, axis=1)
            rows = np.flatnonzero(np.isin(np.repeat(np.arange(len(length)), length), active))
            begin = np.where(member, everything + 1e-3, 0)[active]
            share, fit = em(p[rows], x[rows], length[active], n[active], begin / begin.sum(axis=1, keepdims=True))
            better = fit - (k - 1) * cost[active] > best[active]
            best[active[better]] = (fit - (k - 1) * cost[active])[better]
            out[active[better]] = share[better]
            # a set of k that does not pay is not made to pay by a language of smaller proportion
            active = active[better]
            if not len(active):
                break
        return out


def em(p: np.ndarray, x: np.ndarray, length: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after EM from `share`, and the log-likelihood, of documents whose features
    lie one after the other: likelihoods p (features, languages), counts x."""
    start, doc = np.concatenate([[0], np.cumsum(length)[:-1]]), np.repeat(np.arange(len(length)), length)
    moving = np.ones(len(length), dtype=bool)
    for _ in range(ROUNDS):
        if not moving.all():  # documents that have come to rest leave the work
            keep = moving[doc]
            q, y, size = p[keep], x[keep], length[moving]
            at, own = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(size)), size)
        else:
            q, y, at, own = p, x, start, doc
        now = share[moving]
        joint = q * now[own]
        new = np.add.reduceat(joint * (y / joint.sum(axis=1))[:, None], at, axis=0) / n[moving][:, None]
        share[moving] = new
        moving[np.flatnonzero(moving)[np.abs(new - now).max(axis=1) < STILL]] = False
        if not moving.any():
            break
    fit = np.add.reduceat(x * np.log((p * share[doc]).sum(axis=1)), start)
    return share, fit


def fit_languages(docs: DataFrame) -> LanguageModel:
    """A model of all rows of (lang, text) with a language."""
    counted = checkpoint(count_ngrams(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())))
    table = counted.groupBy("lang").agg(F.collect_list("feature").alias("feature"), F.collect_list("n").alias("n")).collect()  # FEATURES entries a language
    rows = sorted(table, key=lambda r: r["lang"])
    counts = np.zeros((FEATURES, len(rows)))
    for j, r in enumerate(rows):
        counts[r["feature"], j] = r["n"]
    return LanguageModel([r["lang"] for r in rows], counts)


def mix_languages(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """The rows (doc_id, text, others) with lang_pred, score and languages, a list of the chosen
    languages with their proportions."""
    kind = "struct<lang_pred: string, score: double, languages: array<struct<lang: string, share: double>>>"

    @F.pandas_udf(kind)
    def mix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model.mixtures(as_texts(batch), penalty)
            yield pd.DataFrame(
                {
                    "lang_pred": [m[0][0] if m else UNKNOWN for m in found],
                    "score": [min(m[0][1], 1.0) if m else 0.0 for m in found],
                    "languages": [[{"lang": a, "share": s} for a, s in m] for m in found],
                }
            )

    return docs.withColumn("_mix", mix(F.col("text"))).select(*[c for c in docs.columns if c != "text"], "_mix.lang_pred", "_mix.score", "_mix.languages")


def identify(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, languages. Held-out rows are
    not learned from."""
    rest = hash_remainder(F.col("doc_id"), modulus) == held_out
    model = fit_languages(docs.where(~rest).select("lang", "text"))
    return mix_languages(docs.select("doc_id", rest.alias("held_out"), "text"), model)
