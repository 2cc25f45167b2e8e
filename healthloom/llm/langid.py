"""Language identification: each document's mixture of languages, by expectation maximisation over letter trigrams.

Trigrams of lower-cased letters (anything else is one blank) are hashed into BUCKETS. Training counts them by language; a
document's likelihood is that of a mixture of the languages' distributions. The set of languages starts with the best single
one and grows by the one that raises the likelihood most, as long as that is worth the penalty. As the likelihood is concave in
the shares, a language whose derivative at share 0 isn't positive can't raise it and is left out without a fit.

The model is fitted on a bounded sample of labelled rows (``sample`` documents a language on average, chosen by hash of the
id), but of every label value; predictions cover every whole text, in one pass without a shuffle.

Defined results: und with score 0 for null texts, texts without a letter, and everything if nothing was learned; rows of one
id are predicted each by itself; an empty table gives none.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1 << 15
#: Labelled documents a language that the model is fitted on, on average; a language with fewer uses all.
SAMPLE = 20_000
#: Languages whose numbers are held dense at once; a model of more keeps sparse counts and goes through them in blocks.
BLOCK = 256
SMOOTHING, ROUNDS = 0.5, 25
#: Cost of one more language, in units of log(number of trigrams); trigrams overlap, so more than the usual half.
PENALTY = 3.0
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_letters: np.ndarray | None = None


def trigrams(text: str | None) -> np.ndarray | None:
    """Bucket numbers of the whole text's trigrams; None if it has no letter."""
    global _letters
    if not text:
        return None
    if _letters is None:
        _letters = _letter_table()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    # Runs of blanks count once, and a blank stands before and after.
    codes = codes[np.concatenate([[True], letter[1:] | letter[:-1]])]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    if len(codes) < 3:
        return None
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def shares(found: np.ndarray, model: Model) -> np.ndarray:
    """Shares of the model's languages in a document of these trigrams."""
    counts = np.bincount(found, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    c = counts[used].astype(np.float64)
    total, n = c.sum(), len(model.langs)
    at = [(lo, min(n, lo + BLOCK)) for lo in range(0, n, BLOCK)]
    only = model.rows(0, n, used) if len(at) == 1 else None
    rows = lambda lo, hi: only[lo:hi] if only is not None else model.rows(lo, hi, used)
    some = lambda js: np.concatenate([rows(j, j + 1) for j in js])
    single = np.concatenate([np.log(rows(lo, hi)) @ c if model.logs is None else model.logs[lo:hi, used] @ c for lo, hi in at])
    chosen = [int(np.argmax(single))]
    best, share = float(single[chosen[0]]), np.ones(1)
    while len(chosen) < n:
        p = some(chosen)
        ratio = c / (share @ p)
        slope = np.concatenate([rows(lo, hi) @ ratio for lo, hi in at]) - total
        rest = [j for j in np.flatnonzero(slope > 0) if j not in chosen]
        trial = None
        for j in rest:
            fitted, value = _fit(np.concatenate([p, rows(j, j + 1)]), c, np.append(share * 0.9, 0.1))
            if trial is None or value > trial[0]:
                trial = (value, j, fitted)
        if trial is None or trial[0] - best <= PENALTY * np.log(total + 1):
            break
        best, share = trial[0], trial[2]
        chosen.append(int(trial[1]))
    out = np.zeros(n)
    out[chosen] = share
    return out


def _fit(p: np.ndarray, c: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    total, value = c.sum(), -np.inf
    for _ in range(ROUNDS):
        mixed = share @ p
        new = share * (p @ (c / mixed)) / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    value = float(np.log(share @ p) @ c)
    return share / share.sum(), value


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows of the fold that is never trained on: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


class Model:
    """langs, and the probability of each bucket in each of them: dense for up to BLOCK languages, else made from sparse counts."""

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        """lang (its place in langs), bucket and n: how often a bucket was seen in a language, once for each pair."""
        self.langs = langs
        order = np.lexsort((bucket, lang))
        self.bucket, self.n = bucket[order].astype(np.int32), n[order].astype(np.float64)
        self.starts = np.searchsorted(lang[order], np.arange(len(langs) + 1))
        self.totals = np.bincount(lang, weights=n, minlength=len(langs)) + SMOOTHING * BUCKETS
        self.probs = self.logs = None
        if len(langs) <= BLOCK:
            self.probs = self._made(0, len(langs), np.arange(BUCKETS))
            self.logs = np.log(self.probs.astype(np.float64))
            self.bucket = self.n = None

    def _made(self, lo: int, hi: int, used: np.ndarray) -> np.ndarray:
        place = np.full(BUCKETS, -1, np.int64)
        place[used] = np.arange(len(used))
        a, b = self.starts[lo], self.starts[hi]
        at, row = place[self.bucket[a:b]], np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1]))
        smooth = np.full((hi - lo, len(used)), SMOOTHING)
        smooth[row[at >= 0], at[at >= 0]] += self.n[a:b][at >= 0]
        return (smooth / self.totals[lo:hi, None]).astype(np.float32)

    def rows(self, lo: int, hi: int, used: np.ndarray) -> np.ndarray:
        """Probabilities of the used buckets in languages lo to hi."""
        return (self._made(lo, hi, used) if self.probs is None else self.probs[lo:hi, used]).astype(np.float64)


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` rows a language of labelled (null languages are left out)."""
    labelled = labelled.where(F.col(lang).isNotNull())
    counted = labelled.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    sizes = sorted((r["lang"], r["n"]) for r in counted.collect())
    langs = [x for x, _ in sizes]
    if not langs:
        return Model([], *[np.zeros(0, np.int64)] * 3)
    # Languages with no more rows than the sample use all of them; the rates of the others are few.
    rates = [(x, sample / n) for x, n in sizes if n > sample]
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("train")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    if rates:
        rate = F.from_json(F.lit(json.dumps(dict(rates))), "map<string,double>")
        rows = rows.where(F.col("draw") < F.coalesce(F.element_at(rate, F.col("lang")), F.lit(1.0)))
    rows = rows.select("lang", "text")
    index = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def given() -> Iterator[pd.DataFrame]:
            for one, s in sums.items():
                used = np.flatnonzero(s)
                yield pd.DataFrame({"lang": one, "bucket": used.astype(np.int32), "n": s[used]})
            sums.clear()

        for b in batches:
            for one, t in zip(b["lang"], b["text"], strict=True):
                if (found := trigrams(t)) is not None:
                    if one not in sums:
                        if len(sums) >= BLOCK:
                            yield from given()
                        sums[one] = np.zeros(BUCKETS, np.int64)
                    sums[one] += np.bincount(found, minlength=BUCKETS)
        yield from given()

    summed = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    parts = array("i"), array("i"), array("q")
    for r in written(summed, "trigrams").toLocalIterator():
        for part, x in zip(parts, (index[r["lang"]], r["bucket"], r["n"]), strict=True):
            part.append(x)
    return Model(langs, *[np.array(part) for part in parts])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns keep, lang_pred, score (the share of lang_pred) and mixture (shares of all languages found)."""
    langs = model.langs
    # As text, so that pandas doesn't turn whole numbers with nulls among them into floats.
    narrow = docs.select(*[F.col(c).cast("string").alias(c) for c in keep], F.col(text).alias("__text"))
    kept = ", ".join(f"`{c}` string" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pred, score, mixture = [], [], []
            for t in b["__text"]:
                found = trigrams(t) if isinstance(t, str) and langs else None
                if found is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    mixture.append({})
                    continue
                s = shares(found, model)
                k = int(np.argmax(s))
                pred.append(langs[k])
                score.append(float(min(1.0, s[k])))
                mixture.append({langs[i]: float(s[i]) for i in np.flatnonzero(s)})
            yield b[list(keep)].assign(lang_pred=pred, score=score, mixture=mixture)

    made = narrow.mapInPandas(run, f"{kept}, lang_pred string, score double, mixture map<string,double>")
    return made.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in keep], "lang_pred", "score", "mixture")


def identify(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows of docs outside the held-out fold and predicts all: doc_id, held_out, lang_pred, score, mixture."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(named.where(~held_out() & F.col("doc_id").isNotNull()), sample=sample)
    flagged = named.withColumn("held_out", held_out()).drop("lang")
    return predict(flagged, model, keep=("doc_id", "held_out"))
