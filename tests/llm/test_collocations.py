"""Automata and collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessitura.llm import collocations as co
from tessitura.llm.automaton import Automaton

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, size string, rank int"


def online(words):
    """The classic suffix automaton, word by word: endpos counts of all substrings of up to three words."""
    nxt, link, length, count = [{}], [-1], [0], [0]
    last = 0
    for w in words:
        cur = len(nxt)
        nxt.append({}), link.append(-1), length.append(length[last] + 1), count.append(1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                c = len(nxt)
                nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), count.append(0)
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = c
                    p = link[p]
                link[q] = link[cur] = c
        last = cur
    for s in sorted(range(1, len(nxt)), key=lambda s: -length[s]):
        count[link[s]] += count[s]
    out = {}

    def walk(state, phrase):
        for w, s in nxt[state].items():
            out[*phrase, w] = count[s]
            if len(phrase) < 2:
                walk(s, (*phrase, w))

    walk(0, ())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_online_construction(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(1, 2 + seed * 2, 300).astype(np.int32)
    a = Automaton(words, 3)
    got = {p: n for k in (1, 2, 3) for *p, n in zip(*a.phrases(k), a.count[k - 1], strict=True) for p in [tuple(map(int, p))]}
    assert got == online(words.tolist())
    # the link leads to the phrase without its first word, whose endpos hold this one's
    for k in (2, 3):
        assert all(a.count[k - 2][a.link[k - 1]] >= a.count[k - 1])


def test_automaton_gaps():
    a = Automaton(np.array([0, 1, 2, 0, 2, 1, 2, 0], np.int32), 3)
    got = {tuple(map(int, p)): int(n) for k in (1, 2, 3) for *p, n in zip(*a.phrases(k), a.count[k - 1], strict=True)}
    assert got == {(1,): 2, (2,): 3, (1, 2): 2, (2, 1): 1, (2, 1, 2): 1}


def plain(rows, least=10, longest=3, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in good.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        found = []
        for p, a in good.items():
            s, _, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < share * a:
                found.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


ODD = ["a b c"] * 12 + ["A\tb  C d"] * 9 + ["x y!x y;x y"] * 5 + [None, "", " \t", ".,;", "é É ß"] + ["É ß é"] * 11 + ["w " * 3000, "\x00 \x01 \x00 \x01 " * 12, "z\xa0q r " * 11]


@pytest.mark.parametrize("shard,bits,longest", [(2_000_000, 29, 3), (7, 20, 3), (50, 20, 4)])
def test_plain(spark, texts, monkeypatch, shard, bits, longest):
    rng = random.Random(3)
    rows = [(t, rng.choice(["en", "de", None])) for t in texts * 3 + ODD] + [(t, "und") for t in ODD] + [("k l m n k l m n " * 8, "fr")]
    monkeypatch.setattr(co, "SHARD", shard)
    if bits == 20:  # a table so full that it lets everything through
        monkeypatch.setattr(co, "bit_table", lambda f: (20, np.full(1 << 17, 255, np.uint8)))
    docs = spark.createDataFrame([(1, t, lang, "p", 1, "s", 2) for t, lang in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in co.collocations(docs, longest=longest).collect()]
    assert sorted(got) == plain(rows, longest=longest) and len(got) > 20


def test_ties_top_and_empty(spark):
    rows = [(f"p{i} q{i} s{i}." * 10, "en") for i in range(30)]
    docs = spark.createDataFrame([(1, t, lang, "p", 1, "s", 2) for t, lang in rows], SCHEMA)
    assert sorted(tuple(r) for r in co.collocations(docs, top=7).collect()) == plain(rows, top=7)
    assert co.collocations(docs.limit(0)).count() == 0
