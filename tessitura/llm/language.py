"""Language identification as inference of a mixture of languages.

Each language is a multinomial over hashed character trigrams of padded, lower-cased words. A document is a bag of words,
each drawn from one of the languages; expectation-maximisation estimates the document's language proportions, and the set
of languages is the one of the nested candidates with the largest penalised log-likelihood
(``log-likelihood - penalty * (languages - 1) * log(words)``).

The trigram counts come from a bounded sample: at most about ``rows_per_lang`` labelled rows of each language, chosen by a
hash of the row's key and text, and LEAST of them at least (those with the smallest hashes), so every label is learned, however rare and whatever its rows' keys. Every document is predicted over its whole text.

The nested candidates go on until none that is left could be better, as none can be likelier than all languages together; there is no largest set.

Defined results: a null text, or one without a letter (Unicode category L), gets ``und``, score 0 and no languages; with no labelled row at all every
document gets that. Labels that are null teach nothing. Repeated rows are predicted alike; ties go to the language that
sorts first; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UNKNOWN = "und"


def spans_of(numbers) -> list[tuple[int, int]]:
    """Ascending numbers as runs, first and last."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        out[-1:] = [(out[-1][0], n)] if out and out[-1][1] == n - 1 else [*out[-1:], (n, n)]
    return out


#: Word characters that are neither letters nor digits (fractions, Roman numerals and the like), as ranges.
NUMERALS = "".join(f"{chr(a)}-{chr(b)}" for a, b in spans_of(c for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()))
WORD = re.compile(rf"[^\W\d_{NUMERALS}]+")
BITS = 16
FLOOR = 1e-5  # least likelihood of a word relative to its best language: one odd word never decides
BLOCK = 20_000  # words that are inferred at once, or one longer document; fewer with more than WIDE languages
WIDE = 64
LEAST = 100  # labelled rows of a language that are learned from at least, if it has them


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all padded words, and where each word's first one stands."""
    joined = "\x02" + "\x02\x02".join(words) + "\x02"
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate([[0], np.cumsum(lens + 2)[:-1]])
    return (h >> np.uint64(64 - BITS)).astype(np.int64), at


def dense(p: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    """Trigram log-probabilities (2**BITS) of one language of a model."""
    out = np.full(1 << BITS, p[0], np.float32)
    out[p[1]] = p[2]
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 3000) -> dict:
    """Of every label the log-probability of unseen trigrams, the trigrams seen and their log-probabilities, from a bounded sample of the labelled rows."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    sizes = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).count().collect()  # one row for each label
    sizes = sorted((r["_lang"], r["count"]) for r in sizes)
    if not sizes:
        return {"langs": [], "logp": []}
    draw = F.pmod(F.xxhash64(F.col("_key"), F.col("_text"), F.lit("language sample")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    first = rows.select("_lang", draw.alias("_draw")).withColumn("_nth", F.row_number().over(W.partitionBy("_lang").orderBy("_draw"))).where(F.col("_nth") <= LEAST)
    lowest = {r["_lang"]: r["_draw"] for r in first.groupBy("_lang").agg(F.max("_draw").alias("_draw")).collect()}  # one row for each label
    share = spark.createDataFrame([(x, at, max(rows_per_lang / n, lowest.get(x, 0.0))) for at, (x, n) in enumerate(sizes)], "_lang string, _at int, _share double")
    sample = rows.join(F.broadcast(share), "_lang").where(draw <= F.col("_share")).select("_at", "_text")

    def counts(held):
        for at, n in held.items():
            k = np.flatnonzero(n)
            yield pd.DataFrame({"_at": at, "gram": k, "n": n[k]})

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b["_at"], b["_text"], strict=True):
                if words := WORD.findall(t.lower()):
                    g, at = trigrams(words)
                    keep = np.ones(len(g), bool)
                    keep[at[1:] - 1] = False  # the two gaps between words are none of their trigrams
                    keep[at[1:] - 2] = False
                    if name not in held and len(held) == WIDE:  # memory for so many; the sums are the same
                        yield from counts(held)
                        held = {}
                    held.setdefault(name, np.zeros(1 << BITS, np.int64))
                    held[name] += np.bincount(g[keep], minlength=1 << BITS)
        yield from counts(held)

    grams = sample.mapInPandas(count, "_at int, gram int, n long").groupBy("_at", "gram").agg(F.sum("n").alias("n")).toPandas()  # the trigrams seen in each language
    grams = grams.sort_values(["_at", "gram"])
    bounds, logp = np.searchsorted(grams["_at"].to_numpy(), np.arange(len(sizes) + 1)), []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        n = np.full(1 << BITS, 0.02)
        n[seen := grams["gram"].to_numpy()[lo:hi]] += grams["n"].to_numpy(np.float64)[lo:hi]
        p = np.log(n / n.sum()).astype(np.float32)
        logp.append((np.float32(np.log(0.02 / n.sum())), seen.astype(np.uint16), p[seen]))
    return {"langs": [x for x, _ in sizes], "logp": logp}


def likelihoods(words: list[str], logp: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words x languages: likelihoods relative to each word's best language, FLOOR at least; the best log-likelihoods; the words' numbers of trigrams."""
    g, at = trigrams(words)
    out = np.empty((len(words), len(logp)), np.float32)
    stop = np.append(at[1:] - 2, len(g))
    for j, p in enumerate(logp):
        s = np.concatenate([[0.0], np.cumsum(dense(p)[g], dtype=np.float64)])
        out[:, j] = s[stop] - s[at]
    best = out.max(1)
    return np.maximum(np.exp(out - best[:, None]), FLOOR), best, stop - at


def em(lik: np.ndarray, n: np.ndarray, doc: np.ndarray, total: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log-likelihoods. Rows of ``lik`` are sorted by ``doc``, which has no gaps.

    A document is done when a round moves it by less than 0.001, whatever the others do, so its result doesn't depend on them.
    """
    pi = np.full((len(total), lik.shape[1]), 1.0 / lik.shape[1])
    live, x, m, d = np.arange(len(total)), lik, n, doc
    for i in range(rounds):
        each = x * pi[live][d]
        each *= (m / each.sum(1))[:, None]
        new = np.add.reduceat(each, np.flatnonzero(np.diff(d, prepend=-1)), 0) / total[live, None]
        moved = np.abs(new - pi[live]).max(1) >= 1e-3
        pi[live] = new
        if i > 1 and not moved.all():
            live, rows = live[moved], moved[d]
            if not len(live):
                break
            x, m, d = x[rows], m[rows], (np.cumsum(moved) - 1)[d[rows]]
    return pi, np.add.reduceat(n * np.log((lik * pi[doc]).sum(1)), np.flatnonzero(np.diff(doc, prepend=-1)))


def mixtures(lik: np.ndarray, n: np.ndarray, doc: np.ndarray, total: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The chosen set's proportions (0 outside the set), and the number of languages in it."""
    full, most = em(lik, n, doc, total)
    order = np.argsort(-full, 1, kind="stable")
    best, best_pi, size = np.full(len(total), -np.inf), np.zeros_like(full), np.zeros(len(total), np.int64)
    left = np.arange(len(total))  # documents that a larger set may still suit better
    for k in range(1, full.shape[1] + 1):
        rows = np.isin(doc, left) if len(left) < len(total) else np.ones(len(doc), bool)
        at = np.searchsorted(left, doc[rows])
        own = order[left, :k]
        pi, ll = em(np.take_along_axis(lik[rows], own[at], 1), n[rows], at, total[left])
        most[left] = np.maximum(most[left], ll)
        value = ll - penalty * (k - 1) * np.log(total[left] + 1)
        better = np.flatnonzero(value > best[left])
        chosen = left[better]
        best[chosen], size[chosen] = value[better], k
        here = np.zeros((len(better), full.shape[1]), full.dtype)
        np.put_along_axis(here, own[better], pi[better], 1)
        best_pi[chosen] = here
        left = left[most[left] - penalty * k * np.log(total[left] + 1) > best[left]]
        if not len(left):
            break
    return best_pi, size


def infer(texts, langs: list[str], logp: list, penalty: float) -> list[tuple]:
    """Of each text ``lang_pred``, ``score``, ``n_langs``, ``langs``, its number of trigrams, and how far its log-likelihood under its mixture is above chance."""

    def block(docs_words: list[list[str]]) -> list[tuple]:
        vocabulary: dict[str, int] = {}
        ids = [np.fromiter([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64, len(ws)) for ws in docs_words]
        size = len(vocabulary)
        pairs, n = np.unique(np.concatenate([i + d * size for d, i in enumerate(ids)]), return_counts=True)
        doc, word = pairs // size, pairs % size
        total = np.array([len(i) for i in ids], float)
        relative, best, grams = likelihoods(list(vocabulary), logp)
        lik, starts = relative[word], np.flatnonzero(np.diff(doc, prepend=-1))
        pi, k = mixtures(lik, n.astype(float), doc, total, penalty)
        above = np.add.reduceat(n * (np.log((lik * pi[doc]).sum(1)) + best[word] + grams[word] * BITS * np.log(2)), starts)
        long = np.add.reduceat(n * grams[word], starts)
        out = []
        for p, m, g, x in zip(pi, k, long, above, strict=True):
            top = np.argsort(-p, kind="stable")[:m]
            out.append((langs[top[0]], float(min(1.0, p[top[0]])), int(m), ",".join(f"{langs[j]}:{p[j]:.3f}" for j in top), int(g), float(x)))
        return out

    out: list = [(UNKNOWN, 0.0, 0, "", 0, 0.0)] * len(texts)
    held, rows, size, most_words = [], [], 0, BLOCK * WIDE // max(WIDE, len(langs))
    for i, t in enumerate(texts):
        if langs and t and (words := WORD.findall(t.lower())):
            held.append(words)
            rows.append(i)
            size += len(words)
        if held and (size > most_words or i == len(texts) - 1):
            for r, x in zip(rows, block(held), strict=True):
                out[r] = x
            held, rows, size = [], [], 0
    return out


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", penalty: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the carried columns, ``lang_pred``, ``score``, ``n_langs`` and ``langs`` (name:share, largest share first)."""
    langs = model["langs"]
    shared = docs.sparkSession.sparkContext.broadcast(model["logp"])  # the trigrams seen in each language

    @F.pandas_udf("lang_pred string, score double, n_langs long, langs string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x[:4] for x in infer(texts, langs, shared.value, penalty)], columns=["lang_pred", "score", "n_langs", "langs"])

    out = docs.select(key, *carry, run(F.col(text)).alias("_r"))
    return out.select(key, *carry, "_r.lang_pred", "_r.score", "_r.n_langs", "_r.langs")


def keep_known(docs: DataFrame, model: dict, text: str = "text", penalty: float = 2.0, slack: float = 24.0) -> DataFrame:
    """``docs`` without the rows that the mixture inference rejects: ``und``, and those less likely under their mixture than by chance
    (the uniform distribution over trigrams) by more than ``slack`` times the root of their number of trigrams.

    For each trigram the bound is ``slack / sqrt(trigrams)`` below chance, so the shorter a text, the less likely it may be; no length is exempt.
    A text that suits no language goes from about ten trigrams on."""
    langs = model["langs"]
    shared = docs.sparkSession.sparkContext.broadcast(model["logp"])  # the trigrams seen in each language

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([lang != UNKNOWN and above >= -slack * n**0.5 for lang, _, _, _, n, above in infer(texts, langs, shared.value, penalty)])

    return docs.where(known(F.col(text)))


def held_out(key: str = "doc_id"):
    """Rows that are kept from learning: crc32 of the key's text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 3000) -> DataFrame:
    """Fit on the rows that aren't held out, predict every row."""
    marked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("held_out", held_out("doc_id"))
    model = fit(marked.where(~F.col("held_out")), rows_per_lang=rows_per_lang)
    return predict(marked, model, carry=("held_out",))
