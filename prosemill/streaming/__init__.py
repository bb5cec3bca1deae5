"""Streams of edits: detection batch by batch, paths told apart under a watermark, and translations that fall behind, by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosemill.operators.detect import detect
from prosemill.operators.filters import language_of
from prosemill.operators.project import notified, source_of, translations
from prosemill.operators.score import capped
from prosemill.sources import edited_paths


def detect_stream(edits: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cap: int = 20, trigger: dict | None = None, **settings) -> StreamingQuery:
    """Findings of each batch of edits (doc_id, text), at most ``cap`` a document, handed to ``sink`` with the batch's number.

    A batch is a plan like any other, so a batch that is run again after a failure gives the same rows; a sink that writes by batch number
    is written once.
    """
    run = lambda batch, number: sink(capped(detect(batch.dropDuplicates(["doc_id"]), **settings), cap), number)
    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def notices(edits: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, name, message) for edited paths: rules whose globs match, and a source's translations that are older than it; rules and files
    are static sides. Files without ``modified`` can't tell their age, so each translation of an edited source is named."""
    pairs = edits.select(F.col("path").alias("source")).distinct().join(translations(files), "source")
    if "modified" in files.columns:
        times = files.select("path", "modified")
        pairs = pairs.join(times.withColumnRenamed("modified", "mine"), "path").join(times.select(F.col("path").alias("source"), F.col("modified").alias("theirs")), "source").where("theirs > mine")
    stale = pairs.select(F.col("source").alias("path"), F.lit("i18n").alias("name"), F.concat(F.lit("translation may be stale: "), "path").alias("message"))
    return notified(edits, rules).unionByName(stale)


def edited_once(events: DataFrame, delay: str = "10 minutes", column: str = "value", at: str = "at", root: str = "") -> DataFrame:
    """(path, at): edited paths of a stream of JSON events, each once within ``delay`` of its first event.

    The watermark trails the latest event by ``delay``. A path's state is let go when the watermark has passed its event by that much, so what is
    held is bounded by the paths of that time, not by the stream. Events behind the watermark are dropped. A path that is edited again later
    comes again.
    """
    paths = edited_paths(events.withColumn("_at", F.col(at).cast("timestamp")), column, keep=("_at",), root=root).withColumnRenamed("_at", "at")
    return paths.withWatermark("at", delay).dropDuplicatesWithinWatermark(["path"])


_BEHIND = "source string, path string, lang string, changed timestamp, translated timestamp"
_STATE = "source timestamp, paths array<string>, langs array<string>, times array<timestamp>, behind array<boolean>"


def _fallen(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Translations of one source that fall behind with this batch's edits, in order of time."""
    changed: Any = None
    known: dict[str, list] = {}  # path: language, time, whether behind
    if state.exists:
        changed, paths, langs, times, behind = state.get
        known = {p: [lang, t, b] for p, lang, t, b in zip(paths, langs, times, behind)}
    edits = pd.concat(list(chunks), ignore_index=True)
    # At one moment translations come first: a source that isn't newer leaves them as they are.
    edits = edits.assign(own=edits["path"] == key[0]).sort_values(["modified", "own", "path"], kind="stable")
    out = []

    def tell(path: str) -> None:
        lang, t, behind = known[path]
        now = changed is not None and t < changed
        if now and not behind:
            out.append((key[0], path, lang, changed, t))
        known[path][2] = now

    for path, lang, t, own in edits[["path", "lang", "modified", "own"]].itertuples(index=False):
        if own:
            if changed is None or t > changed:
                changed = t
                for p in sorted(known):
                    tell(p)
        else:
            if path not in known:
                known[path] = [lang, t, False]
            elif t > known[path][1]:
                known[path][1] = t
            tell(path)
    paths = sorted(known)
    state.update((changed, paths, *([known[p][k] for p in paths] for k in range(3))))
    yield pd.DataFrame(out, columns=["source", "path", "lang", "changed", "translated"])


def fallen_behind(edits: DataFrame) -> DataFrame:
    """(source, path, lang, changed, translated): a row each time that an edit leaves a translation older than its source.

    ``edits`` is a stream of (path, modified). Its state is kept by source: its last edit and that of each of its translations, a bounded number of
    languages. A translation is told of once until it is edited at or after the source's time; edits that come late count by their time.
    As all edits of a source are read in the order of their times, batches of another size, or a restart from the checkpoint, give the same rows,
    as long as edits come in order. Edits without path or time are left out.
    """
    p = F.col("path")
    keyed = edits.where("path is not null and modified is not null").select(F.coalesce(source_of(p), p).alias("source"), "path", language_of(p).alias("lang"), "modified")
    return keyed.groupBy("source").applyInPandasWithState(_fallen, _BEHIND, _STATE, "append", GroupStateTimeout.NoTimeout)
