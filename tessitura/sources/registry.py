"""Importers: what can be read from each format, one table of them that can be added to, and the choice for a path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Flag, auto

from pyspark.sql import DataFrame, SparkSession

from tessitura.sources import exports
from tessitura.sources.detect import detect

Reader = Callable[[SparkSession, str], DataFrame]


class DataKind(Flag):
    TRACKS = auto()
    PLAYLISTS = auto()
    SCROBBLES = auto()
    FILES = auto()


@dataclass(frozen=True)
class Importer:
    """A format by the name that detection gives it, with a reader for each kind of data that it holds."""

    name: str
    readers: dict[DataKind, Reader] = field(default_factory=dict)

    @property
    def kinds(self) -> DataKind:
        out = DataKind(0)
        for k in self.readers:
            out |= k
        return out


IMPORTERS: dict[str, Importer] = {}


def register(importer: Importer) -> None:
    """Add a format, or replace the one of its name."""
    IMPORTERS[importer.name] = importer


for _one in (
    Importer("plist", {DataKind.TRACKS: exports.plist_tracks, DataKind.PLAYLISTS: exports.plist_playlists}),
    Importer("media_services", {DataKind.TRACKS: exports.media_services_tracks, DataKind.PLAYLISTS: exports.media_services_playlists, DataKind.SCROBBLES: exports.play_activity}),
    Importer("streaming_history", {DataKind.SCROBBLES: lambda spark, path: exports.streaming_history(spark, path)[0]}),
    Importer("listens", {DataKind.SCROBBLES: exports.listens}),
    Importer("scrobble_csv", {DataKind.SCROBBLES: exports.scrobble_csv}),
    Importer("audio", {DataKind.FILES: exports.audio_files}),
):
    register(_one)


def importer_for(spark: SparkSession, path: str, name: str | None = None) -> Importer:
    """The importer of a path. Raises where no format fits, or several do and ``name`` doesn't choose one of them."""
    found = detect(spark, path)
    if name is not None:
        if name not in IMPORTERS:
            raise ValueError(f"no importer is called {name}")
        return IMPORTERS[name]
    if len(found) != 1:
        raise ValueError(f"{path}: " + (f"several formats fit: {', '.join(found)}" if found else "no known format"))
    return IMPORTERS[found[0]]


def ingest(spark: SparkSession, path: str, name: str | None = None) -> dict[DataKind, DataFrame]:
    """All that a path holds, tracks before playlists before scrobbles."""
    readers = importer_for(spark, path, name).readers
    return {k: readers[k](spark, path) for k in DataKind if k in readers}
