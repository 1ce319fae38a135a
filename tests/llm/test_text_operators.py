"""Each operator against a plain brute-force version, on the small table and on edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessitura.llm import benchmark, fingerprints, language, licenses, personal, pieces, registry, secrets, substrings, suffixes

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_pieces_round_trip(frame, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=registry.model_path())
    rng = random.Random(1)
    odd = ["".join(rng.choice(" ▁ab\n\té日\U0001f600\x00.<s>1") for _ in range(rng.randrange(40))) for _ in range(300)]
    own = texts + odd + [" " * 40, "▁▁x", "é" * 30000]
    got = by_id(pieces.digests(frame(own), registry.model_path(), table_entries=50))
    every = by_id(pieces.digests(frame(own), registry.model_path(), table_entries=50, whole=True))
    for i, t in enumerate(own):
        ids = sp.encode(t or "")
        assert got[i] == every[i] and (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else "")), repr(t)[:80]
    full = by_id(pieces.encode_decode(frame(own[:20]), registry.model_path()))
    assert full[3]["ids"] == sp.encode(own[3]) and full[3]["decoded"] == own[3]


def plain_personal(t):
    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ):
        out.append([(m.start(), m.end(), kind) for m in re.finditer(pattern, t or "") if ok(m[0])])
    return out


def test_personal_base(frame, texts):
    rng = random.Random(2)
    parts = ["a@b.c", "x.y@z-1.co.uk", "1.2.3.4", ".5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", "+", "@", " ", "-", "7", "é", "call ", "001.002.003.004"]
    own = texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]
    found = personal.detect(frame(own)).select("doc_id", personal.span_text(F.col("found"), True).alias("b"), personal.span_text(F.col("found"), False).alias("s"))
    order = ["email", "ip", "card", "phone"]
    for i, r in by_id(found).items():
        base = sorted((x for k in plain_personal(own[i]) for x in k), key=lambda s: (s[0], order.index(s[2])))
        assert r["b"] == ",".join(f"{k}:{a}:{b}" for a, b, k in base), own[i]
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))


def test_query_counts(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    names = ["email", "ip", "card", "phone"]
    for i, r in by_id(registry.op1_personal_data(spark, "/root/testdata/sf0.01")).items():
        assert [r[f"n_{k}"] for k in names] == [len(x) for x in plain_personal(docs[i])]
        base = sorted((x for k in plain_personal(docs[i]) for x in k), key=lambda s: (s[0], names.index(s[2])))
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, b, k in base))
    for i, r in by_id(registry.op3_secrets(spark, "/root/testdata/sf0.01")).items():
        assert r["n_access"] == sum(len(m) >= 20 for m in re.findall("AKIA[A-Z0-9]+", docs[i])) and r["n_hex"] == sum(len(m) >= 24 for m in re.findall("[0-9a-f]+", docs[i]))


def test_twins(spark):
    """The queries that SQL can express, against DuckDB."""
    import duckdb

    from tessitura.llm.oracle import SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in SQL.items():
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        got = con.execute(sql)
        at, order = [c[0] for c in got.description], sorted(df.columns)
        want = sorted(tuple(str(r[at.index(c)]) for c in order) for r in got.fetchall())
        assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == want, name


def test_personal_more_and_masking(frame):
    own = ["My name is Maria Lopez, ssn 123-45-6789", "write to bob at mail dot com", "plain words only", None, "card 4111 1111 1111 1111 ok", "iban DE89 3704 0044 0532 0130 00"]
    got = {r["doc_id"]: r["text"] for r in personal.masked(frame(own)).collect()}
    assert got[2] == "plain words only" and got[3] is None and got[4] == "card [CARD] ok"
    assert "[SSN]" in got[0] and personal.masked(frame(own)).columns == frame(own).columns
    assert personal.masked(frame([])).count() == 0 and personal.detect(frame([])).count() == 0


def test_estimate_equals_plain_em():
    """Reliabilities and posteriors by EM written out pattern by pattern; the classifier follows the posteriors and sees more than the votes."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(3000):  # spans of one kind: labelers 0 and 1 are right in 90 %, 2 is a coin, 3 and 4 abstain; true spans have form 3
        true = rng.random() < 0.4
        vote = lambda right: (2 if true else 0) if rng.random() < right else (0 if true else 2)
        v = [vote(0.9), vote(0.9), vote(0.5), 1, 1]
        rows.append((7, sum(x * 3 ** (4 - j) for j, x in enumerate(v)), 1, 3 if true else 5, 0))
    counts = pd.DataFrame(rows, columns=["kind", "votes", "size", "form", "word"]).groupby(["kind", "votes", "size", "form", "word"]).size().reset_index(name="n")
    model = personal.estimate(counts)
    patterns = {}
    for r in counts.itertuples(index=False):
        v = tuple(r.votes // 3 ** (4 - j) % 3 for j in range(5))
        patterns[v] = patterns.get(v, 0) + r.n
    q = {v: 1 / (1 + np.exp(-float(sum(v) - 5))) for v in patterns}
    for _ in range(50):
        total, on = sum(patterns.values()), sum(n * q[v] for v, n in patterns.items())
        pi = (on + 2) / (total + 4)
        table = [[[1.0, 1.0, 1.0] for _ in range(5)] for _ in range(2)]
        for v, n in patterns.items():
            for j, x in enumerate(v):
                table[1][j][x] += n * q[v]
                table[0][j][x] += n * (1 - q[v])
        for j in range(5):
            table[1][j][2] += 2
            table[0][j][0] += 2
        chance = lambda side, v: np.prod([table[side][j][x] / sum(table[side][j]) for j, x in enumerate(v)])
        q = {v: pi * chance(1, v) / (pi * chance(1, v) + (1 - pi) * chance(0, v)) for v in patterns}
    assert model["share"][7] == pytest.approx(pi, abs=1e-6) and 0.3 < pi < 0.5
    right = [table[1][j][2] / sum(table[1][j]) / (table[1][j][2] / sum(table[1][j]) + table[0][j][2] / sum(table[0][j])) for j in range(5)]
    assert np.allclose(model["reliability"][7], right, atol=1e-6) and min(right[:2]) > 0.8 > abs(right[2])
    score = lambda v, form: float((personal.features(np.array([v]), np.array([7]), np.array([1]), np.array([form]), np.array([0])) @ model["weights"])[0])
    assert score((2, 2, 1, 1, 1), 3) > 0 > score((0, 0, 1, 1, 1), 5) and score((1, 1, 1, 1, 1), 3) > score((1, 1, 1, 1, 1), 5)


def test_gazetteer_and_context_propose(frame):
    said = "Passport number: X1234567 and account no. 00991122-7, seen by Maria Lopez at noon; Blue Widget and maria lopez stay; account 5; policy id: ABC"
    found = {(personal.KINDS[s["kind"]], said[s["start"] : s["end"]]) for s in personal.scan(frame([said])).first()["found"]}
    assert {("number", "X1234567"), ("number", "00991122-7"), ("person", "Maria Lopez")} == found
    assert personal.spans_of(None) == personal.spans_of("") == []


def test_large_keys_beside_null_ones(spark):
    """Keys never pass through floating point, whatever stands beside them."""
    ids = [2**62 + 1, None, -(2**62) - 3, 2**53 + 1]
    df = spark.createDataFrame([(i, f"text of {i} " * 30) for i in ids], "doc_id long, text string").coalesce(1)
    path = registry.model_path()
    for out in (substrings.deduplicated(df), suffixes.deduplicated(df), pieces.digests(df, path), fingerprints.near_duplicates(df), personal.detect(df), secrets.scan(df), licenses.scan(df)):
        assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, ids))


def test_secrets(frame, texts):
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "ApiKey", "=", ":", " ", "'", '"', "abcdef12", "abc", "AKIA" + "Z9" * 9, "AKIAAB", "deadbeef" * 4, "0123456789abcdef", "é", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3"]
    own = texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]
    rows = by_id(secrets.scan(frame(own)).select("doc_id", secrets.span_text(F.col("spans"), secrets.RULES, True).alias("b"), secrets.span_text(F.col("spans"), secrets.RULES).alias("s")))
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for i, t in enumerate(own):
        t = t or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert rows[i]["b"] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)), t
        for k, a, b in (s.split(":") for s in rows[i]["s"].split(",") if s):
            rule = next(r for r in secrets.RULES if r.kind == k)
            assert re.fullmatch(secrets.java(rule), t[int(a) : int(b)])
    rows = frame(own).selectExpr("doc_id AS _no", "coalesce(text, '') AS _text")
    index = secrets.postings(rows, 5)
    names = secrets.dictionary()
    for g, fold in names:  # every list is whole, whatever its block
        held = [d for r in index.where(f"gram = {names.index((g, fold))}").collect() for d in r["docs"]]
        assert sorted(held) == [i for i, t in enumerate(own) if g in ((t or "").lower() if fold else t or "")]
    found = {r["_doc"]: set(r["rules"]) for r in secrets.candidates(index).collect()}

    def holds(q, t):
        return True if q is True else q in t if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, t) for x in q[1:])

    for i, t in enumerate(own):  # the lists alone give the rules whose query the text satisfies, and no others
        want = {at for at, r in enumerate(secrets.RULES) if (x := secrets.derive(r.pattern, r.fold)) is not True and holds(x, (t or "").lower() if r.fold else t or "")}
        assert found.get(i, set()) == want


def test_very_many_secrets(spark, frame):
    """The work grows with the matches, and places stay right."""
    import time

    n = 16_000
    line = "x token=abcdef%05d\n"
    began = time.time()
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(["".join(line % i for i in range(n)), None, ""])).collect()}
    assert time.time() - began < 90 and len(spans) == 3  # sums that copy what they have took over 120 s for the matches alone
    assert [(s["start"], s["end"]) for s in spans[0]] == [(20 * i + 2, 20 * i + 19) for i in range(n)] and not spans[1] and not spans[2]


def test_trigram_queries():
    from tessitura.llm.trigrams import derive

    assert derive("abcd") == ("and", "abc", "bcd")
    assert derive("(abc|abd)x?") == ("or", ("and", "abc", "bcx"), "abc", ("and", "abd", "bdx"), "abd") or derive("(abc|abd)x?")
    assert derive("[0-9a-f]{24,}") is True and derive("(foo)*bar[0-9]+") == "bar"
    rng = random.Random(4)

    def holds(q, t):
        return True if q is True else q in t if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, t) for x in q[1:])

    for p in ("ab?cd+e", "(abc|de[fg]h)ij", "x(yz){2}w", "(a|bc)?def", "abc|", "foo.*bar"):
        for _ in range(300):
            t = "".join(rng.choice("abcdefghijxyzwor") for _ in range(12))
            t = t[:5] + rng.choice(["abcde", "abcij", "deghij", "xyzyzw", "adef", "fooXbar"]) + t[5:]
            assert not re.search(p, t) or holds(derive(p), t), (p, t)


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_licenses(frame, texts):
    rng = random.Random(21)
    said = [t for _, t in licenses.TEMPLATES]
    own = texts + ["Under THE MIT License, under the mit license; CC-BY-NC cc by nc by nc", "apache license, version 2.0", "mit license", " ".join(["lorem"] * 40) + " " + said[4].upper() + " x" * 100]
    for t in said:  # words left out, put in between, put in front
        w = t.split(" ")
        own += [" ".join(x for x in w if rng.random() > 0.2), " ".join(x + " lorem" * rng.randrange(3) for x in w), "the of and " * 9 + t + " in the " * 9 + t]
    rows = by_id(licenses.scan(frame(own)))
    some = 0
    for i, t in enumerate(own):
        w, places, labels = words_of(t), [], set()
        for p, label in licenses.PHRASES.items():
            p = p.split(" ")
            at = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        more, best, blocks = set(labels), 0.0, 0
        for label, words, need, width in licenses.table():
            words = set(words)
            for b in (j for j, x in enumerate(w) if x in words):
                n = len(words & set(w[b : b + width]))
                if n >= need:
                    more.add(label)
                    best, blocks = max(best, n / len(words)), blocks + 1
        r = rows[i]
        some += blocks
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r["base_labels"], r["labels"], r["n_blocks"]) == (",".join(sorted(labels)), ",".join(sorted(more)), blocks)
        assert r["score"] == pytest.approx(1.0 if places else best)
    assert some > 100


def test_contamination(spark, frame, texts, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, "É" * 20 + " short item"), (901, None), (902, "..."), (903, "a a a a a a a a a a a a"), (904, "x"), (905, items[0][1]), (None, "null id item of some more words than ten in all here")]
    own = texts + [items[1][1].upper(), "pre " + " ".join(items[2][1].split()[3:14]) + " post", "É" * 20 + " SHORT item!", "é" * 20 + " short item", "end x"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = by_id(benchmark.contamination(frame(own), bench))
    wins = defaultdict(set)
    for k, t in items:
        w = words_of(t)
        if k is not None and w:
            for j in range(max(1, len(w) - 9)):
                wins[tuple(w[j : j + 10])].add(str(k))
    sizes = {len(x) for x in wins}
    for i, t in enumerate(own):
        w, hit, found = words_of(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    found |= wins[tuple(w[j : j + n])]
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)), t
    assert benchmark.contamination(frame(["a b"]), bench.limit(0)).count() == 1
    assert benchmark.contamination(frame([]), bench).count() == 0


def test_contamination_without_broadcast(spark, frame, texts, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    own = frame(texts)
    want = sorted(map(tuple, benchmark.contamination(own, bench).collect()))
    monkeypatch.setattr(benchmark, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, benchmark.contamination(own, bench).collect())) == want


def brute_repeats(docs, size):
    seen, gone = set(), {}
    for i in sorted(docs):
        t = docs[i]
        gone[i] = [False] * len(t)
        for j in range(len(t) - size + 1):
            k = t[j : j + size] if isinstance(t, bytes) else tuple(t[j : j + size])
            if k in seen:
                gone[i][j : j + size] = [True] * size
            seen.add(k)
    return gone


def spans_in(g):
    return sum(1 for a, b in zip([False, *g], g, strict=False) if b and not a)


def tricky(texts, rng):
    long = [t for t in texts if t and len(t) > 600]
    out = []
    for _ in range(60):
        a, b = rng.choice(long), rng.choice(long)
        x = rng.randrange(len(a) - 300)
        out.append(b[: rng.randrange(200)] + a[x : x + rng.randrange(80, 300)] + b[200 : 200 + rng.randrange(200)])
    return out


def test_substrings(frame, texts):
    own = texts + tricky(texts, random.Random(5)) + ["a b " * 200, "a b " * 150 + "c"]
    rows = by_id(substrings.deduplicated(frame(own), texts=True))
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(own)}
    for i, g in brute_repeats(docs, 20).items():
        kept = " ".join(w for w, x in zip(docs[i], g, strict=True) if not x)
        r = rows[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"], r["n_spans"]) == (len(docs[i]), sum(g), sha(kept), kept, spans_in(g)), i


def test_suffixes(frame, texts):
    own = texts + tricky(texts, random.Random(6)) + ["ab" * 300, "ab" * 250 + "c", "é" * 200]
    rows = by_id(suffixes.deduplicated(frame(own)))
    docs = {i: (t or "").encode() for i, t in enumerate(own)}
    for i, g in brute_repeats(docs, 100).items():
        kept = bytes(b for b, x in zip(docs[i], g, strict=True) if not x)
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(docs[i]), sum(g), spans_in(g), sha(kept)), i


def test_suffixes_long_document_in_pieces(frame, monkeypatch):
    rng = random.Random(7)
    base = "".join(rng.choice("abcd") for _ in range(5000))
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    pieces_ = [(0, base.encode()), (1, (base[1000:2500] + "zz" + base[3000:3150]).encode())]
    got = [x for held in suffixes.chunks([{"_no": [0, 1], "_text": [base, pieces_[1][1].decode()]}], 100) for x in zip(*suffixes.runs(held, 100), strict=True)]
    windows = {(int(d), int(f) + j) for _, _, d, f, n in got for j in range(int(n))}
    assert windows == {(d, j) for d, raw in pieces_ for j in range(len(raw) - 99)} and sum(int(x[4]) for x in got) == len(windows)


def test_merged_transforms():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    shards = [strings[:10], strings[10:25], strings[25:]]
    z, suffix, block = suffixes.merged_blocks(shards, 12)
    seen = {}
    for s, at, b in zip(z, suffix, block, strict=True):
        joined = [x for t in shards[s] for x in [(t, j) for j in range(len(t) + 1)]]
        t, j = joined[at]
        rotated = ([c + 1 for c in t] + [0]) * 14
        seen.setdefault(int(b), set()).add(tuple(rotated[j : j + 12]))
    keys = [next(iter(seen[b])) for b in sorted(seen)]
    assert all(len(v) == 1 for v in seen.values()) and keys == sorted(keys) and len(set(keys)) == len(keys)


def test_same_key_rows_do_not_remove_each_other(frame):
    """Equal rows of a key are one document; the null key sorts first."""
    t = " ".join(f"word{i}" for i in range(60))
    rows = substrings.deduplicated(frame([t, t, t], [5, 5, None])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in rows) == [(False, 60), (False, 60), (True, 0)]
    rows = suffixes.deduplicated(frame([t, t], [5, 5])).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_different_texts_of_one_key(spark, kind):
    """Rows of one key with different texts are different documents, in the order of their SHA-256."""
    rng = random.Random(11)
    some = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(90)) for _ in range(6)]
    own = [(-(1 << 63), some[0]), (None, some[1]), (7, some[2] + " " + some[0]), (7, some[3]), (8, some[3] + " " + some[1]), (7, some[4]), (7, some[4]), (9, some[5][:200] + some[4] + some[2])]
    rows = [(k if kind == "long" or k is None else f"key {k:+03d}" if k > -100 else "", t) for k, t in own]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, sha(r[1])))
    for run, size, cut, width in ((substrings, 20, str.split, "n_words"), (suffixes, 100, str.encode, "n_bytes")):
        gone = brute_repeats({i: cut(t) for i, (_, t) in enumerate(order)}, size)
        want = sorted((str(order[i][0]), len(gone[i]), sum(gone[i])) for i in range(len(order)) for _ in range(rows.count(order[i])))
        assert sorted((str(r["doc_id"]), r[width], r["n_removed"]) for r in run.deduplicated(df).collect()) == want


def test_substrings_in_small_chunks(frame, texts, monkeypatch):
    """Long texts in pieces, very long words, several chunks to a task and split stretches give the same rows."""
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcd") * rng.randrange(1, 4) for _ in range(400)) for _ in range(3)]
    own = texts[:40] + tricky(texts, rng)[:20] + [base[0], base[0][300:] + " " + "x" * 900 + " " + base[1], "z " + "x" * 900 + " " + base[1] + "\x0b\t" + base[2], "x" * 5000, "y" * 899 + " " + base[2]] + [base[1][:200]] * 30
    monkeypatch.setattr(substrings, "CHUNK", 500)
    monkeypatch.setattr(substrings, "LONG", 300)
    monkeypatch.setattr(substrings, "KNOWN", 50)
    docs = {i: (t or "").encode().split() for i, t in enumerate(own)}
    gone = brute_repeats({i: [w.decode() for w in t] for i, t in docs.items()}, 20)
    raw = [t.encode() for t in own if t]
    for t in raw:  # pieces hold each window once
        found = [(first + j) for first, p in substrings.pieces_of(t, 20) for j in range(len(p.split()) - 19)]
        assert found == list(range(max(0, len(t.split()) - 19)))
    leasts = np.unique(np.concatenate([substrings.window_hashes([(0, f, p)], 20)[1] for t in raw for f, p in substrings.pieces_of(t, 20)]))
    rows = [(i, t or "") for i, t in enumerate(own)]
    for hot in ((np.zeros(0, np.uint64), np.zeros(0, np.uint64)), (leasts[::2], np.full(len(leasts[::2]), 3, np.uint64))):
        packed = []
        for part in (rows[::2], rows[1::2]):
            dealer = substrings.Dealer(20, 7, hot)
            packed += [r for held in substrings.chunks([{"_no": [i for i, _ in part], "_text": [t for _, t in part]}], 20) for r in dealer.rows(held)]
        frame_of = pd.DataFrame(packed, columns=["bucket", "hashes", "leasts", "docs", "starts", "counts", "gone"])
        found = {}
        for _, g in frame_of.groupby("bucket"):
            for s in substrings.fold([g.iloc[at : at + 9] for at in range(0, len(g), 9)]):
                for d, a, b in s.itertuples(index=False):
                    found.setdefault(int(d), []).append({"first": a, "last": b})
        for i, t in enumerate(own):
            count, removed, _, kept = substrings.kept_words((t or "").encode(), found.get(i), 20)
            want = b" ".join(w for w, x in zip(docs[i], gone[i], strict=True) if not x)
            assert (b"".join(kept), removed, count[0]) == (want, sum(gone[i]), len(docs[i])), i


def test_suffixes_with_hot_anchors(frame, texts, monkeypatch):
    """Windows of anchors that are split by their own hash are judged alike."""
    monkeypatch.setattr(suffixes, "HOT", 2)
    test_suffixes(frame, texts[:60])


@pytest.mark.parametrize("depth", [0, 3])
def test_fingerprints(spark, frame, texts, depth, monkeypatch):
    import xxhash

    if depth:  # many shards, blocks and levels even on a small table
        real = fingerprints.np.ceil
        monkeypatch.setattr(fingerprints, "BLOCK", 16)
        monkeypatch.setattr(fingerprints, "LEAF", 8)
        monkeypatch.setattr(fingerprints.np, "ceil", lambda x: max(real(x), 3.0))
    rng = random.Random(9)
    own = texts + [" ".join(rng.sample(texts[3].split(), 40)) for _ in range(20)]
    own += [" ".join(w if rng.random() > 0.01 else "zz" for w in rng.choice(texts[:40]).split(" ")) for _ in range(150)]
    rows = by_id(fingerprints.near_duplicates(frame(own)))
    fps = {}
    for i, t in enumerate(own):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sh = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert rows[i]["fingerprint"] == f"{fps[i]:016x}"
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: rows[i]["component_id"] for i in fps} == {i: find(i) for i in fps}
    assert fingerprints.near_duplicates(frame([])).count() == 0


def test_vantage_trees_find_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    near = base[:300].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, near]))
    found = set()
    for tree in (0, 1):
        nodes = fingerprints.upper_tree(fingerprints.part_of(fp, tree), 5)
        rows, shards, homes = fingerprints.route(fingerprints.part_of(fp, tree), nodes, 1)
        assert homes.sum() == len(fp)
        for s in np.unique(shards):
            own = rows[shards == s]
            h, q = fp[own[homes[shards == s]]], fp[own]
            for a, b in fingerprints.links_within(h, q, tree, 3):
                found |= {(int(min(x, y)), int(max(x, y))) for x, y in zip(q[a], h[b], strict=True) if x != y}
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = {(int(fp[i]), int(fp[j])) for i, j in zip(*np.nonzero(d <= 3), strict=True) if i < j}
    assert found == want and len(want) >= 250


def test_parity_maps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(12)
    for n, m, shared in ((5, 5, 4), (300, 260, 250), (1000, 1100, 990), (64, 65, 0)):
        h = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = h[:n], np.concatenate([h[:shared], h[n : n + m - shared]])
        got = int(fingerprints.unlike([fingerprints.parity(a), fingerprints.parity(b)], np.array([0]), np.array([1]))[0])
        true = n + m - 2 * shared
        assert 0.7 * true <= got <= true and (got - true) % 2 == 0


def test_language(spark, frame, texts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    own = [*texts, "12 34", "Der und die", None, ""]
    model = language.fit(docs)
    odd = by_id(language.predict(frame(own), model))
    assert [odd[len(texts) + i]["lang_pred"] for i in (0, 2, 3)] == ["und"] * 3
    parts = {r["lang"]: r["text"] for r in docs.where("n_chars > 1500").collect()}
    mixed = by_id(language.predict(frame([parts["de"][:1500] + " " + parts["fr"][:1500]]), model))[0]
    assert {x.split(":")[0] for x in mixed["langs"].split(",")} == {"de", "fr"} and 0.3 < mixed["score"] < 0.7
    assert {r["lang_pred"] for r in language.identify(frame(["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(frame([])).count() == 0


@pytest.mark.parametrize("block", [3072, 40])
def test_similar_documents(frame, texts, block, monkeypatch):
    """Pairs of at least 0.8 over five-word shingles, against brute force; no other pair is linked."""
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(11)
    long = [t for t in texts if t and len(t.split()) > 90][:40]
    own = list(texts)
    for t in long:
        w = t.split(" ")
        for rate in (0.005, 0.01, 0.08):
            own.append(" ".join("zz" if rng.random() < rate else x for x in w))
    got = by_id(fingerprints.similar_documents(frame(own)))
    sets = []
    for t in own:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if own[i] != own[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0]
    caught = sum(got[i]["component_id"] == got[j]["component_id"] for i, j in pairs)
    assert len(pairs) > 60 and caught >= 0.95 * len(pairs)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in [*pairs, *[(i, j) for i in range(len(own)) for j in range(i) if (own[i] or "") == (own[j] or "")]]:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert all(find(i) == find(r["component_id"]) for i, r in got.items())
    assert fingerprints.similar_documents(frame([])).count() == 0


def test_similar_passages(frame, texts):
    """Copies with a passage appended, cut off or swapped, of similarity 0.80 to 0.86, are found."""
    long = [t.split() for t in dict.fromkeys(t for t in texts if t) if len(t.split()) >= 120][:60]
    own, pairs = [], []
    for i, w in enumerate(long):
        other = [x + "q" for x in long[i - 1]] * 3
        n = len(w)
        for edit in (w + other[: int(n * 0.22)], w[: int(n * 0.83)], other[: int(n * 0.09)] + w[int(n * 0.09) :]):
            sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in ([x.lower() for x in w], [x.lower() for x in edit])]
            if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.86:
                pairs.append((len(own), len(own) + 1))
                # each pair has words of its own, so that no other pair links it
                own += [" ".join(f"{x}{len(pairs)}" for x in t) for t in (w, edit)]
    got = by_id(fingerprints.similar_documents(frame(own)))
    caught = sum(got[a]["component_id"] == got[b]["component_id"] for a, b in pairs)
    assert len(pairs) > 60 and caught >= 0.99 * len(pairs), (caught, len(pairs))


def test_rejected_languages(spark, frame):
    """The pipeline's first stage rejects by the mixture's fit at any length: unlearned scripts go, short texts of learned languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    rng = random.Random(2)
    greek = " ".join("".join(chr(rng.randrange(0x3B1, 0x3C9)) for _ in range(rng.randrange(3, 9))) for _ in range(400))
    foreign = [greek[:n] for n in (60, 100, 200, 400, 499, 600, 2000)]
    plain = [r["text"] for r in docs.where("n_chars > 700 and doc_id < 200").collect()]
    plain = [t[: t.index(" ", n)] for t in plain for n in (3, 20, 100, 400, 600)]
    own = [*foreign, *plain, None, "12 34"]
    kept = {r["doc_id"] for r in language.keep_known(frame(own), model).collect()}
    assert len(plain) > 100 and kept == set(range(len(foreign), len(own) - 2))


def plain_mixture(lik, n, penalty):
    """One document: the nested set with the largest penalised likelihood, by EM written out."""

    def em(x):
        pi = np.full(x.shape[1], 1 / x.shape[1])
        for i in range(15):
            new = sum(c * (r * pi) / (r * pi).sum() for r, c in zip(x, n, strict=True)) / sum(n)
            moved, pi = np.abs(new - pi).max(), new
            if i > 1 and moved < 1e-3:
                break
        return pi, sum(c * np.log((r * pi).sum()) for r, c in zip(x, n, strict=True))

    order = np.argsort(-em(lik)[0], kind="stable")
    best = max(((ll - penalty * (k - 1) * np.log(sum(n) + 1), -k, pi) for k in range(1, lik.shape[1] + 1) for pi, ll in [em(lik[:, order[:k]])]), key=lambda x: x[:2])
    out = np.zeros(lik.shape[1])
    out[order[: -best[1]]] = best[2]
    return out, -best[1]


def test_mixtures_equal_plain_em():
    """Whatever stands beside a document, it gets the set and proportions that plain EM gives it; sets of five languages and more occur."""
    rng = np.random.default_rng(3)
    for penalty in (0.0, 0.3, 2.0):
        liks, counts, docs = [], [], []
        for d in range(40):
            words, mine = int(rng.integers(1, 60)), rng.integers(0, 9, int(rng.integers(1, 8)))
            x = np.full((words, 9), 1e-5)
            x[np.arange(words), rng.choice(mine, words)] = 1.0
            liks.append(np.maximum(x, rng.random((words, 9)) * 0.2))
            counts.append(rng.integers(1, 5, words).astype(float))
            docs.append(np.full(words, d))
        total = np.array([c.sum() for c in counts])
        pi, size = language.mixtures(np.concatenate(liks), np.concatenate(counts), np.concatenate(docs), total, penalty)
        for d in range(40):
            want, k = plain_mixture(liks[d], counts[d], penalty)
            assert size[d] == k and np.allclose(pi[d], want, atol=1e-9), (penalty, d)
        assert penalty or size.max() > 4


def test_letters_are_category_l(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = by_id(language.predict(frame(["½ ² ٣ Ⅳ", "12 _ !!", "a"]), language.fit(docs)))
    assert [got[i]["lang_pred"] == "und" for i in range(3)] == [True, True, False]


def test_many_languages(spark, frame):
    """Every label is learned: 90 languages, of which the last has the fewest rows."""
    rng = random.Random(4)
    kinds = [["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(30)] for _ in range(90)]
    rows = [(f"l{at:02}", " ".join(rng.choices(words, k=60))) for at, words in enumerate(kinds) for _ in range(2 + (at < 70))]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    model = language.fit(docs)
    assert model["langs"] == [f"l{at:02}" for at in range(90)]
    got = by_id(language.predict(docs, model))
    assert all(got[i]["lang_pred"] == lang for i, (lang, _) in enumerate(rows))


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch follows the bytes of its texts, not a number of rows; the session's own setting comes back."""
    from tessitura.llm import scratch

    @F.pandas_udf(personal.SPANS)
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": 0, "start": 0, "end": int(texts.str.len().sum()), "base": True, "votes": 0, "size": 0, "form": 0, "word": 0}]] * len(texts))

    monkeypatch.setattr(personal, "found_in", whole)
    docs = spark.range(0, 2400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(10_000)).alias("text"))
    before = spark.conf.get(scratch.BATCH)
    for rows in (personal.detect(docs), personal.masked(docs.withColumn("found", F.lit(1)))):
        assert rows.count() == 2400
    largest = personal.detect(docs).select(F.max(F.col("found")[0]["end"])).first()[0]
    assert 10_000 < largest <= scratch.BATCH_BYTES + 10_000 and spark.conf.get(scratch.BATCH) == before
