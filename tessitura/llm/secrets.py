"""Secret scanning through a trigram inverted index, in DataFrame operations only.

For every rule a Boolean trigram query is derived from its pattern (``trigrams.derive``). The index is inverted: a posting list of documents for each
trigram that the queries use, cut into blocks of documents whose number follows from the bytes of the texts, so that no list grows with the data and
a trigram that a third of all documents hold is as many lists as there are blocks. In each block the lists are intersected and united as each rule's
query says, which gives (document, rules) candidates; these are joined back to the texts, and a rule is verified on its candidates only. A
rule without mandatory trigrams (``hex``) scans every text.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; a match that fails its rule's length is dropped and not
retried. Repeated rows and rows of one key are each scanned; keys may be null and of any type; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.numbering import buckets, numbered
from tessitura.llm.scratch import written
from tessitura.llm.trigrams import derive, grams

STEP = 256  # matches whose places are summed up one after the other


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1
    fold: bool = False  # letters of the keywords in either case


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Formats of public services' keys, beyond the base rules.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosted_git", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._!$%-]{3,64}@"),
)
RULES = BASE + MORE


def java(rule: Rule) -> str:
    """The pattern for Spark; only the keywords of a folded rule match in either case."""
    return rule.pattern.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))") if rule.fold else rule.pattern


def dictionary(rules: tuple[Rule, ...] = RULES) -> list[tuple[str, bool]]:
    """The trigrams of all queries, each with whether it is looked up in lower-cased text."""
    return sorted({(g, r.fold) for r in rules for g in grams(derive(r.pattern, r.fold))})


def postings(rows: DataFrame, blocks: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (block, gram, docs): for each trigram of the dictionary, by its place there, the documents of a block that hold it.

    ``rows``: _no, _text. A text is looked through for the dictionary's trigrams once; those for keywords in either case in its lower-cased form.
    """
    names = dictionary(rules)
    held = F.array(*[F.when(F.col("_low" if fold else "_text").contains(g), F.lit(i)) for i, (g, fold) in enumerate(names)]) if names else F.array().cast("array<int>")
    block = F.pmod(F.xxhash64("_no"), F.lit(blocks))
    each = rows.select("_no", "_text", F.lower("_text").alias("_low")).select(block.alias("block"), "_no", F.explode(F.array_compact(held)).alias("gram"))
    return each.groupBy("block", "gram").agg(F.collect_set("_no").alias("docs"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_no, rules): the documents that satisfy the query of some rule, with the places of those rules, from the posting lists alone."""
    names = dictionary(rules)
    none = F.array().cast("array<bigint>")

    def docs(query, fold: bool) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.try_element_at("lists", F.lit(names.index((query, fold)))), none)
        parts = [docs(q, fold) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
        return out

    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("lists"))
    queries = [(at, derive(r.pattern, r.fold), r.fold) for at, r in enumerate(rules)]
    found = F.array(*[F.struct(F.lit(at).alias("rule"), docs(q, fold).alias("docs")) for at, q, fold in queries if q is not True])
    met = blocks.select(F.explode(found).alias("x")).select("x.rule", F.explode("x.docs").alias("_doc"))
    return met.groupBy("_doc").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """The rule's matches: (start, end, rule's place), by the lengths of matches and of what stands between them.

    Places are running sums. They are summed within stretches of STEP matches, whose own starts are summed first, so the work stays near the
    number of matches, however many there are.
    """
    pattern = java(rule)
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else said
    between = F.split(text, pattern, -1)
    every = F.transform(F.arrays_zip(said.alias("s"), counts.alias("c"), F.slice(between, F.lit(1), F.size(said)).alias("b")), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["s"]).alias("n"), F.length(x["c"]).alias("counted")))
    kind = "array<struct<start:int,end:int,kind:int>>"

    def step(acc, x):
        start = acc["to"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["n"]).alias("end"), F.lit(at).alias("kind"))
        return F.struct((start + x["n"]).alias("to"), F.when(x["counted"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def begin(acc, part):
        to = acc["to"] + F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
        return F.struct(to.alias("to"), F.concat(acc["out"], F.array(F.struct(acc["to"].alias("to"), part.alias("part")))).alias("out"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / STEP).cast("int")), lambda i: F.slice(every, i * STEP + 1, F.lit(STEP)))
    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<to:int,part:array<struct<gap:int,n:int,counted:int>>>>").alias("out"))
    begun = F.aggregate(parts, zero, begin)["out"]
    return F.flatten(F.transform(begun, lambda p: F.aggregate(p["part"], F.struct(p["to"].alias("to"), F.array().cast(kind).alias("out")), step)["out"]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key`` and ``spans``: array of (start, end, kind: the rule's place), by start, then rule."""
    rows, total = numbered(docs, key, text)
    index = written(postings(rows, buckets(rows, total), rules), "postings")
    found = written(candidates(index, rules), "candidates")
    joined = rows.join(found, rows["_no"] == found["_doc"], "left").select("_key", "_text", "rules")
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    spans = []
    for at, rule in enumerate(rules):
        wanted = F.lit(True) if derive(rule.pattern, rule.fold) is True else F.coalesce(F.array_contains("rules", at), F.lit(False))
        # positions are worked out only where there is a match at all
        spans.append(F.when(wanted & F.col("_text").rlike(java(rule)), _spans(F.col("_text"), rule, at)).otherwise(none))
    return joined.select(F.col("_key").alias(key), F.array_sort(F.concat(*spans), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...], base_only: bool = False) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    kept = F.filter(spans, lambda s: s["kind"] < len(BASE)) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
