"""Personal data by weak supervision.

One scan of each whole text proposes spans of nine kinds, by pattern, by gazetteer (a given name before a capitalised word) and by context (what stands
behind words that announce a number of somebody's), and lets five labelers vote on each (-1 against, 0 abstain, 1 for):
``format`` (the strict pattern of the kind), ``gazetteer`` (top-level domains, calling codes, issuer prefixes, reserved
ranges, given names), ``context`` (cue words before the span), ``shape`` (lengths and grouping) and ``edge`` (what touches the
span). Spark counts the vote patterns of all documents; expectation-maximisation over those counts estimates, for each kind, the share of true spans
and each labeler's reliability. A logistic classifier is trained on the resulting posteriors over more than the votes, namely the kind, the length class, the form of the span (its runs of
letters and digits, hashed) and the word before it (hashed), so that it can tell spans apart that the labelers can't, and decides the spans that the base patterns don't fix. The
number of patterns is bounded (kinds x 3**5 votes x 4 length classes x FORMS x WORDS), whatever the corpus.

Defined results: base matches (email, ip, card, phone) always stay; null and empty texts have no spans; offsets are code
points, end exclusive; a proposal that overlaps a base match or an earlier proposal is dropped. Rows are independent, so repeated rows, null keys and ties need no rule; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm.scratch import small_batches, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "mail_spelled", "person", "number")
LABELERS = ("format", "gazetteer", "context", "shape", "edge")
KIND_AT = {k: i for i, k in enumerate(KINDS)}
FORMS, WORDS = 16, 32  # classes of a span's form and of the word before it

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
CARD_LONG = re.compile(r"(?:[0-9][ -]?){11}[0-9]")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}(?![A-Za-z0-9])")
PERSON = re.compile(r"(?:[Mm]y name is|[Ss]igned by|\bMr\.|\bMrs\.|\bMs\.|\bDr\.) ([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?)(?![A-Za-z])")

PAIR = re.compile(r"\b[A-Z][a-z]{1,14}(?= [A-Z][a-z]{1,20}\b)")
NEXT = re.compile(r" [A-Z][a-z]{1,20}\b")
ANNOUNCED = re.compile(r"\b(?:passport|licen[cs]e|account|customer|patient|policy|tax|member|insurance) (?:id|no\.?|number|nr\.?)(?: is)?[ :#]{1,3}([A-Z]{0,3}[0-9][0-9A-Z-]{4,18}[0-9])(?![A-Za-z0-9])", re.IGNORECASE)
BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z]*$")
RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|.", re.DOTALL)

# Names, cue words and prefixes that the labelers know.
TLDS = frozenset("com org net edu gov mil int info biz name pro io co ai app dev de fr es uk it nl eu at be ch cz dk fi gr hu ie jp kr no pl pt ru se us ca au br cn in mx nz za".split())
GIVEN = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah"
    " edward stephanie ronald rebecca timothy laura jason helen jeffrey sharon ryan cynthia jacob kathleen gary amy nicholas angela eric anna jonathan ruth stephen brenda larry pamela justin nicole scott katherine maria peter julia carlos sofia pierre claire hans greta jean marie luis ana jose carmen juan isabel antonio lucia"
    " jacques francoise michel sophie heinrich ursula wolfgang monika klaus petra giovanni giulia marco francesca pablo elena miguel rosa".split()
)
CUES = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "ssn": ("ssn", "social security"),
    "iban": ("iban", "account", "bank"),
    "mail_spelled": ("mail", "contact", "write to"),
    "person": ("name is", "signed by", "regards", "sincerely", "mr", "mrs", "dr.", "author", "contact"),
    "number": ("passport", "account", "customer", "patient", "policy", "tax", "insurance"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of local@domain.domain, found from the @ outwards in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches of the four kinds, kind by kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    if CARD_LONG.search(text):
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans outside the base ones that the classifier is to decide."""
    out = []
    if DIGIT.search(text):
        out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        out += [("ssn", *m.span()) for m in SSN.finditer(text)]
        out += [("iban", *m.span()) for m in IBAN.finditer(text)]
    if "dot" in text:
        out += [("mail_spelled", *m.span()) for m in SPELLED.finditer(text)]
    if "name is" in text or "igned by" in text or "r. " in text or "s. " in text:
        out += [("person", *m.span(1)) for m in PERSON.finditer(text)]
    for m in PAIR.finditer(text):
        if m[0].lower() in GIVEN:
            out.append(("person", m.start(), NEXT.match(text, m.end()).end()))
    if DIGIT.search(text):
        out += [("number", *m.span(1)) for m in ANNOUNCED.finditer(text)]
    if not out:
        return out
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    starts, free, last = [a for a, _ in taken], [], -1
    for k, a, b in sorted(out, key=lambda s: (s[1], -s[2])):
        i = bisect.bisect_left(starts, b) - 1
        if a >= last and (i < 0 or taken[i][1] <= a):
            free.append((k, a, b))
            last = b
    return free


def votes(text: str, kind: str, a: int, b: int, is_base: bool) -> tuple[int, ...]:
    """One vote of each labeler, from the span and the 40 characters before it."""
    said, before = text[a:b], text[max(0, a - 40) : a].lower()
    digits = [c for c in said if "0" <= c <= "9"]
    form = 1 if is_base or kind in ("ssn", "iban") else 0
    gaz = shape = 0
    if kind in ("email", "mail_spelled"):
        end = re.split(r"[^A-Za-z]", said)[-1].lower()
        gaz = 1 if end in TLDS else -1
        shape = 1 if len(said) <= 80 else -1
    elif kind == "ip":
        gaz = -1 if said.startswith(("0.", "127.", "255.")) else 0
        shape = 1 if all(p == "0" or p[0] != "0" for p in said.split(".")) else -1
    elif kind == "card":
        gaz = 1 if digits and digits[0] in "3456" else -1
        shape = 1 if len(digits) in (13, 14, 15, 16) else -1
    elif kind == "phone":
        gaz = 1 if said[0] == "+" and digits[0] != "0" else 0
        shape = 1 if 10 <= len(digits) <= 13 and len(set(digits)) > 2 else -1
    elif kind == "ssn":
        gaz = -1 if said[:3] in ("000", "666") or said[0] == "9" else 0
        shape = -1 if said[4:6] == "00" or said[-4:] == "0000" else 1
    elif kind == "iban":
        flat = said.replace(" ", "")
        value = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
        gaz = 1 if int(value) % 97 == 1 else -1
        shape = 1 if 15 <= len(flat) <= 34 else -1
    elif kind == "number":
        gaz = -1 if len(set(digits)) < 3 else 0
        shape = 1 if 6 <= len(digits) <= 14 else -1
    else:
        gaz = 1 if said.split(" ")[0].lower() in GIVEN else 0
        shape = 1 if " " in said else 0
    cue = 1 if any(c in before for c in CUES[kind]) else 0
    around = text[a - 1 : a] + text[b : b + 1]
    edge = -1 if any(c.isalnum() for c in around) else 1
    return form, gaz, cue, shape, edge


SPANS = T.ArrayType(T.StructType([T.StructField(c, T.BooleanType() if c == "base" else T.IntegerType()) for c in ("kind", "start", "end", "base", "votes", "size", "form", "word")]))


def form_of(said: str) -> int:
    """A class of the span's form: its runs of capitals, small letters and digits, by kind and length up to four, and what stands between them."""
    out = ""
    for run in RUNS.findall(said[:64]):
        if run.isascii() and run.isalnum():
            out += ("A" if run[0].isupper() else "a" if run[0].islower() else "9") + str(min(4, len(run)))
        else:
            out += run
    return zlib.crc32(out.encode()) % FORMS


def word_before(text: str, a: int) -> int:
    """A class of the word before the span; 0 for none."""
    m = BEFORE.search(text[max(0, a - 24) : a])
    return 1 + zlib.crc32(m[1].lower().encode()) % (WORDS - 1) if m else 0


def spans_of(t: str | None) -> list[dict]:
    """All spans of a text by start, then kind: kind, offsets, base flag, packed votes, and classes of length, form and the word before."""
    if not t:
        return []
    base, out = base_spans(t), []
    for is_base, spans in ((True, base), (False, proposals(t, base))):
        for k, a, b in spans:
            packed = 0
            for v in votes(t, k, a, b, is_base):
                packed = packed * 3 + v + 1
            out.append({"kind": KIND_AT[k], "start": a, "end": b, "base": is_base, "votes": packed, "size": min(3, (b - a) // 10), "form": form_of(t[a:b]), "word": word_before(t, a)})
    return sorted(out, key=lambda s: (s["start"], s["kind"]))


@F.pandas_udf(SPANS)
def found_in(texts: pd.Series) -> pd.Series:
    return pd.Series([spans_of(t) for t in texts])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``found``: every span of a text, as ``spans_of`` gives them."""
    return docs.select(key, found_in(F.col(text)).alias("found"))


def pattern_counts(found: DataFrame, column: str = "found") -> pd.DataFrame:
    """How often each pattern (kind, votes, size, form, word) occurs over all documents."""
    by = ("kind", "votes", "size", "form", "word")
    return found.select(F.explode(column).alias("x")).groupBy(*[f"x.{c}" for c in by]).agg(F.count("*").alias("n")).toPandas().sort_values(list(by))


def estimate(counts: pd.DataFrame, rounds: int = 50) -> dict:
    """Dawid-Skene EM for each kind over counted vote patterns, then one logistic classifier on the posteriors.

    ``counts``: kind, votes, size, form, word, n. Returns the classifier's weights, the shares of true spans and the labelers' reliabilities.
    """
    m = len(LABELERS)
    v = np.array([[(p // 3 ** (m - 1 - j)) % 3 for j in range(m)] for p in counts["votes"]], int).reshape(-1, m)
    n, kind = counts["n"].to_numpy(float), counts["kind"].to_numpy(int)
    post, share, reliability = np.zeros(len(counts)), np.full(len(KINDS), 0.5), np.full((len(KINDS), m), 0.5)
    for k in range(len(KINDS)):
        own = kind == k
        if not own.any():
            continue
        vk, nk = v[own], n[own]
        q = 1 / (1 + np.exp(-(vk - 1).sum(1).astype(float)))  # majority vote to begin with
        for _ in range(rounds):
            pi = (nk @ q + 2) / (nk.sum() + 4)
            table = np.ones((2, m, 3))
            for j in range(m):
                for c in range(3):
                    hit = nk * (vk[:, j] == c)
                    table[1, j, c] += hit @ q
                    table[0, j, c] += hit @ (1 - q)
            table[1, :, 2] += 2  # a labeler is taken to be better than chance
            table[0, :, 0] += 2
            table /= table.sum(2, keepdims=True)
            on = np.log(pi) + np.log(table[1][np.arange(m), vk]).sum(1)
            off = np.log(1 - pi) + np.log(table[0][np.arange(m), vk]).sum(1)
            q = 1 / (1 + np.exp(np.clip(off - on, -50, 50)))
        post[own], share[k] = q, pi
        reliability[k] = table[1, :, 2] / (table[1, :, 2] + table[0, :, 2])
    x = features(v, kind, *(counts[c].to_numpy(int) for c in ("size", "form", "word")))
    w = np.zeros(x.shape[1])
    for _ in range(300):  # weighted logistic regression on soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 2.0 * (x.T @ (n * (post - p)) / max(n.sum(), 1) - 1e-4 * w)
    return {"weights": w, "share": share, "reliability": reliability}


def features(v: np.ndarray, kind: np.ndarray, size: np.ndarray, form: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One-hot votes, kinds and classes of length, form and the word before."""
    return np.concatenate([np.eye(3)[v].reshape(len(v), 3 * len(LABELERS)), np.eye(len(KINDS))[kind], np.eye(4)[size], np.eye(FORMS)[form], np.eye(WORDS)[word]], 1)


def classify(found: DataFrame, model: dict, threshold: float = 0.5, column: str = "found") -> DataFrame:
    """``found`` without the spans that the classifier rejects; base spans stay."""
    m, at, parts = len(LABELERS), 0, []
    for size in (*[3] * m, len(KINDS), 4, FORMS, WORDS):
        parts.append(F.array(*[F.lit(float(x)) for x in model["weights"][at : at + size]]))
        at += size

    def value(s):
        score = F.lit(0.0)
        for j in range(m):
            score += F.element_at(parts[j], (F.floor(s["votes"] / 3 ** (m - 1 - j)) % 3 + 1).cast("int"))
        for part, c in zip(parts[m:], ("kind", "size", "form", "word"), strict=True):
            score += F.element_at(part, s[c] + 1)
        return score

    cut = float(np.log(threshold / (1 - threshold)))
    return found.withColumn(column, F.filter(column, lambda s: s["base"] | (value(s) >= cut)))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``key`` and ``found`` (accepted spans by start, then kind) of every document."""
    with small_batches(docs.sparkSession):
        found = written(scan(docs, key, text), "personal")
    return classify(found, estimate(pattern_counts(found)), threshold)


def span_text(found, base_only: bool):
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(found, lambda s: s["base"]) if base_only else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@F.pandas_udf(T.StringType())
def rewritten(texts: pd.Series, found: pd.Series) -> pd.Series:
    """Each text with its spans replaced; of overlapping spans the first by start, then kind, is named."""

    def one(t: str, spans) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [t[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
            at = max(at, s["end"])
        return "".join([*out, t[at:]])

    return pd.Series([one(t, s) if len(s) else t for t, s in zip(texts, found, strict=True)])


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each accepted span of ``text`` replaced by ``[KIND]``; the model is fitted on these documents.

    Texts are scanned once: a row's spans are written beside the row, so no join by key is needed and rows with
    equal or null keys keep their own text. Rows without accepted spans don't leave the JVM again. Null texts stay null.
    """
    name = "found"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    with small_batches(docs.sparkSession):
        held = written(docs.withColumn(name, found_in(F.col(text))), "personal")
    told = classify(held, estimate(pattern_counts(held, name)), threshold, name)
    clean = told.where(F.size(name) == 0)
    other = told.where(F.size(name) > 0).withColumn(text, rewritten(F.col(text), F.col(name)))
    return clean.unionByName(other).select(*docs.columns)
