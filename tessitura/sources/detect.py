"""Which export lies at a path: one Spark job over a listing of its files, so any store that Spark reads will do.

Every file is a row of facts. Facts that need the bytes are worked out on the executors, for archives and for the one file whose first
record decides; each format is a rule over the facts of the whole listing. The answer is a single row, however many files there are.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names inside an export, suffixes of audio files, the key that a record of streaming history has.
SIGNATURES = ("Apple Music Library Tracks", "Apple Music Play Activity")
AUDIO = ("mp3", "m4a", "flac")
HISTORY_KEY = "master_metadata_track_name"
NESTED = 2  # archives within archives that are opened
HEAD = 512  # bytes of a text file that show a property list

FACTS = "path string, head binary, fields int, names array<string>, history boolean"


def inside(raw: bytes, depth: int = NESTED) -> list[str]:
    """Names in an archive and in the archives within it; what can't be opened has none."""
    stack, out = [(raw, depth)], []
    while stack:
        data, left = stack.pop()
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
                stack += [(z.read(n), left - 1) for n in names if left and n.lower().endswith(".zip")]
                out += names
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError):
            pass
    return out


def first_json(raw: bytes) -> bytes:
    """The first JSON file of an archive, by name; empty if there is none."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = min((n for n in z.namelist() if n.endswith(".json")), default=None)
        return z.read(name) if name else b""


def is_history(raw: bytes) -> bool:
    """A JSON list whose first record is one of a streaming history."""
    try:
        records = json.loads(raw)
    except ValueError:
        return False
    return isinstance(records, list) and bool(records) and isinstance(records[0], dict) and HISTORY_KEY in records[0]


def first_row(raw: bytes) -> int:
    """Fields of the first CSV row; 0 where the bytes are no text."""
    try:
        return len(next(csv.reader(io.StringIO(raw.decode())), []))
    except (ValueError, csv.Error):
        return 0


def looked_at(batches):
    """FACTS of each file, from its bytes."""
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            raw, low = bytes(content), path.lower()
            packed = zipfile.is_zipfile(io.BytesIO(raw))
            data = first_json(raw) if packed else raw if low.endswith(".json") else b""
            rows.append((path, raw[:HEAD].lower(), first_row(raw) if low.endswith(".csv") else 0, inside(raw) if packed else [], bool(data) and is_history(data)))
        yield pd.DataFrame(rows, columns=["path", "head", "fields", "names", "history"])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, alone (the path names this very file) and the path below it of every file there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("%20"), F.lit(" ")), "^[a-z]+:/*", "/")
    root = plain(F.lit(path.rstrip("/")))
    return files.select("path", (plain(F.col("path")) == root).alias("alone"), F.substr(plain(F.col("path")), F.length(root) + 1).alias("below"))


def rules() -> dict[str, Column]:
    """Each format as a condition on the facts of all files; ``below`` is a file's path below the one looked at, ``suffix`` its ending in lower case."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    alone, suffix, names = F.col("alone"), F.col("suffix"), F.col("names")
    signed = lambda c: F.greatest(*[c.contains(s) for s in SIGNATURES])
    head = F.decode("head", "ISO-8859-1")
    return {
        "plist": some(alone & (suffix == "xml") & head.startswith("<?xml") & head.contains("plist")),
        "media_services": some(F.when(alone, F.exists(names, signed)).otherwise(signed(F.col("below")))),
        "streaming_history": some(F.col("history") & (F.col("first_json") | (alone & (F.size(names) > 0)))),
        "listens": some(F.when(alone, F.exists(names, lambda n: n.endswith(".jsonl"))).otherwise(suffix == "jsonl")),
        "scrobble_csv": some(alone & (suffix == "csv") & (F.col("fields") >= 4)),
        "audio": some(~alone & suffix.isin(*AUDIO)),
    }


def detect(spark: SparkSession, path: str) -> list[str]:
    """All formats that fit: none is unknown, several are ambiguous; the caller decides. A path that isn't there fits none."""
    try:
        files = listing(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    first = files.where(~F.col("alone") & F.col("path").endswith(".json")).agg(F.min("path").alias("p"))
    wanted = files.where("alone").select("path").union(first.where("p is not null").select("p"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    facts = read.join(F.broadcast(wanted), "path", "left_semi").mapInPandas(looked_at, FACTS)  # two files at most
    j = files.join(F.broadcast(facts), "path", "left").withColumn("first_json", F.col("history").isNotNull() & ~F.col("alone"))
    j = j.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    found = j.agg(*[c.alias(n) for n, c in rules().items()]).first()
    return [n for n in rules() if found[n]]
