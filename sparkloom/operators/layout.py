"""Deterministic force layouts: modules on a plane, files within their module. A group is one layout, so it is one task."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _start(names: list[str], spread: float) -> np.ndarray:
    raw = np.array([list(hashlib.blake2b(n.encode(), digest_size=8).digest()) for n in names], dtype=np.float64).reshape(len(names), 8)
    angle, radius = raw[:, 0] / 256 * 2 * np.pi + raw[:, 1] / 65536, np.sqrt((raw[:, 2] * 256 + raw[:, 3] + 1) / 65536)
    return spread * np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)


def _push(at: np.ndarray, reach: float, strength: float) -> np.ndarray:
    """Repulsion from the centres of the grid cells around, and within a cell from its own mean: linear in points."""
    cell = np.floor(at / reach).astype(np.int64)
    low = cell.min(axis=0) - 1
    # rows of the grid one after the other, with a free cell on either side
    width = int(cell[:, 1].max() - low[1]) + 2
    keys, where = np.unique((cell[:, 0] - low[0]) * width + cell[:, 1] - low[1], return_inverse=True)
    n = np.bincount(where)
    centre = np.stack([np.bincount(where, at[:, k]) / n for k in (0, 1)], axis=1)
    out = np.zeros_like(at)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            wanted = keys + dx * width + dy
            at_key = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            other = np.where(keys[at_key] == wanted, at_key, -1)[where]
            some = other >= 0
            d = at[some] - centre[other[some]]
            dist = np.maximum((d**2).sum(axis=1, keepdims=True), 1e-3)
            out[some] += strength * n[other[some]][:, None] * d / dist
    return out


def relax(names: list[str], edges: list[tuple[str, str, float]], sizes: list[float], steps: int = 72, reach: float = 48.0) -> np.ndarray:
    """Positions after spring and repulsion steps, then collisions apart, centred."""
    at = _start(names, reach * max(1.0, len(names) ** 0.5))
    index = {n: k for k, n in enumerate(names)}
    pairs = [(index[a], index[b], w) for a, b, w in edges if a in index and b in index]
    a, b, w = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    for step in range(steps):
        move = _push(at, reach, reach * 0.6)
        if len(a):
            pull = (at[b] - at[a]) * (0.02 * np.log1p(w))[:, None]
            np.add.at(move, a, pull)
            np.add.at(move, b, -pull)
        move -= 0.002 * at
        length = np.maximum(np.sqrt((move**2).sum(axis=1, keepdims=True)), 1e-9)
        at += move / length * np.minimum(length, reach * (1 - step / steps) * 0.25)
    radius = np.sqrt(np.maximum(np.array(sizes, dtype=float), 1.0))
    for _ in range(16):
        order = np.argsort(at[:, 0], kind="stable")
        for k in range(1, min(9, len(names))):
            i, j = order[:-k], order[k:]
            d = at[j] - at[i]
            dist = np.maximum(np.sqrt((d**2).sum(axis=1)), 1e-6)
            gap = np.maximum(radius[i] + radius[j] - dist, 0) / dist / 2
            np.add.at(at, i, -d * gap[:, None])
            np.add.at(at, j, d * gap[:, None])
    return at - at.mean(axis=0)


def module_layout(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module, x, y. modules: module, files; edges: a, b, weight. One picture holds a few thousand modules, in one task."""
    links = edges.agg(F.array_sort(F.collect_list(F.struct("a", "b", F.col("weight").cast("double").alias("weight")))).alias("edges"))
    whole = modules.agg(F.array_sort(F.collect_list(F.struct("module", "files"))).alias("modules")).crossJoin(links)

    def work(batches):
        for batch in batches:
            for own, ties in zip(batch["modules"], batch["edges"], strict=True):
                names = [m["module"] for m in own]
                at = relax(names, [(e["a"], e["b"], e["weight"]) for e in ties], [m["files"] for m in own]) if names else np.zeros((0, 2))
                yield pd.DataFrame({"module": names, "x": at[:, 0].round(2), "y": at[:, 1].round(2)})

    return whole.mapInPandas(work, "module string, x double, y double")


def file_layout(members: DataFrame, deps: DataFrame) -> DataFrame:
    """path, module, x, y: each module's files laid out about its own centre."""
    m = members.select("path", "module")
    ends = deps.join(m.select(F.col("path").alias("src"), F.col("module").alias("home")), "src").join(m.select(F.col("path").alias("dst"), F.col("module").alias("other")), "dst")
    inside = ends.filter("home = other").select("home", "src", "dst")

    def work(key: tuple, own: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        names = sorted(own["path"])
        at = relax(names, [(a, b, 1.0) for a, b in sorted(zip(ties["src"], ties["dst"], strict=True))], [1.0] * len(names), steps=36, reach=8.0)
        return pd.DataFrame({"path": names, "module": key[0], "x": at[:, 0].round(2), "y": at[:, 1].round(2)})

    return m.groupBy("module").cogroup(inside.groupBy("home")).applyInPandas(work, "path string, module string, x double, y double")
