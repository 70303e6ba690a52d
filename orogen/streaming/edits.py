"""Streams of edits: debounced saves, newest generations, undo and redo, and the pyramid kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.pyramid import rebuild_dirty
from ..sources.store import Store

# Pause that ends a burst of edits, versions kept for undo.
PAUSE, UNDO = "250 milliseconds", 25


def debounce(edits: DataFrame, key: str = "key", pause: str = PAUSE, late: str | None = None) -> DataFrame:
    """The last edit of each burst: edits (key, ts, ord, value) of a key with less than a pause between them are one.

    Works on a batch and on a stream; a stream needs `late`, the watermark after which a burst is closed.
    """
    if late:
        edits = edits.withWatermark("ts", late)
    burst = edits.groupBy(key, F.session_window("ts", pause).alias("burst")).agg(F.max(F.struct("ts", "ord", "value")).alias("last"), F.count(F.lit(1)).alias("n"))
    return burst.select(key, F.col("burst.start").alias("started"), F.col("last.ts").alias("saved"), F.col("last.value").alias("value"), "n")


def newest_generation(results: DataFrame, key: str = "key") -> DataFrame:
    """Per key the result of the highest generation (ties: the later ts, then ord); older ones that come late are dropped."""
    best = results.groupBy(key).agg(F.max(F.struct("generation", "ts", "ord", "value")).alias("b"))
    return best.select(key, "b.generation", "b.value")


_STATE = "past array<string>, now string, future array<string>"
_OUT = "key string, now string, n_undo int, n_redo int"


def _apply(state: tuple, action: str, value: str | None, keep: int) -> tuple:
    past, now, future = list(state[0]), state[1], list(state[2])
    if action == "commit":
        return (past + [now])[-keep:] if now is not None else past, value, []
    if action == "undo" and past:
        return past[:-1], past[-1], [now, *future][:keep]
    if action == "redo" and future:
        return (past + [now])[-keep:], future[0], future[1:]
    return past, now, future


def history_stream(edits: DataFrame, keep: int = UNDO) -> DataFrame:
    """A stream of edits (key, ord, action, value) to each key's state after every batch: now, n_undo, n_redo.

    commit sets a new value and forgets what was undone; undo and redo step through at most `keep` versions.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], None, [])
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        for action, value in zip(rows["action"], rows["value"], strict=True):
            held = _apply(held, action, value, keep)
        state.update(held)
        yield pd.DataFrame({"key": [key[0]], "now": [held[1]], "n_undo": [len(held[0])], "n_redo": [len(held[2])]})

    return edits.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "update", "NoTimeout")


def history(edits: DataFrame, keep: int = UNDO) -> DataFrame:
    """history_stream over a whole batch: each key's state after its last edit."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        held = ([], None, [])
        pdf = pdf.sort_values("ord", kind="stable")
        for action, value in zip(pdf["action"], pdf["value"], strict=True):
            held = _apply(held, action, value, keep)
        return pd.DataFrame({"key": [pdf["key"].iat[0]], "now": [held[1]], "n_undo": [len(held[0])], "n_redo": [len(held[2])]})

    return edits.groupBy("key").applyInPandas(step, _OUT)


def bake_status(events: DataFrame, key: str = "key") -> DataFrame:
    """Each world's status after its events (key, ord, action): a commit makes it stale, a bake baking, done clean, an error failed."""
    to = F.create_map(*[F.lit(x) for kv in {"commit": "stale", "undo": "stale", "redo": "stale", "bake": "baking", "done": "clean", "error": "failed"}.items() for x in kv])
    known = events.withColumn("status", F.element_at(to, F.col("action"))).where("status is not null")
    return known.groupBy(key).agg(F.max_by("status", "ord").alias("status"))


def keep_pyramid(dirty: DataFrame, store: Store, project: str, tile_size: int, tiles_per_side: int, checkpoint: str):
    """Starts a stream of dirty tiles (x, y, d) that rebuilds their ancestors in the store, a batch at a time.

    A batch that is repeated after a failure writes the same tiles again.
    """
    from ..sources.codecs import pack_tiles, unpack_tiles

    def rebuild(batch: DataFrame, _: int) -> None:
        read = batch.sparkSession.read.parquet
        above = K.ancestors(batch.distinct(), tiles_per_side)
        # only the children of what is rebuilt are read and unpacked, from the folders of their rows
        below = above.select(F.explode(K.children(F.col("x"), F.col("y"), F.col("d"))).alias("k")).select("k.d", "k.y", "k.x")
        keys = below.select(F.col("d").alias("part_d"), F.col("y").alias("part_y"), "x").distinct()
        stored = store.read_tiles(project).join(keys, ["part_d", "part_y", "x"], "left_semi").select("d", "y", "x", "data")
        fresh = pack_tiles(rebuild_dirty(unpack_tiles(stored, tile_size), batch.distinct(), tile_size, tiles_per_side), tile_size)
        fresh.write.mode("overwrite").parquet(f"{store.at(project)}-fresh")
        fresh = read(f"{store.at(project)}-fresh")
        rows = above.select(F.col("d").alias("part_d"), F.col("y").alias("part_y")).distinct()
        done = store.read_tiles(project).join(rows, ["part_d", "part_y"], "left_semi").select("d", "y", "x", "data")
        done = done.join(fresh.select("d", "y", "x"), ["d", "y", "x"], "left_anti").unionByName(fresh)
        staged = f"{store.at(project)}-staged"
        done.write.mode("overwrite").parquet(staged)  # the folders that are replaced are read until here
        store.write_tiles(project, read(staged))

    return dirty.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
