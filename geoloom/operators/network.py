"""A small segmentation network over rasters as rows of pixels: one exchange of pixels, then the whole pass in each task.

The network: a convolution, pooling by two, a convolution, doubling, the first layer's channels beside it (the skip), a
convolution, and one more whose largest channel is the label. All convolutions are 3 by 3; an image's edge pixels stand for
what lies beyond it. Images are cut into squares, each with a margin of its neighbours' pixels that is wider than what a
label depends on, so squares give what the image as a whole would. Sides and margins are even, that pooling stays aligned.

Defined results: a pixel that is missing within its image counts as zero in every band and has no label; repeated pixels
add up; a null value is zero; the first of equal channels is the label; no pixels give no labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.tables import join_checked

#: Pixels along a square's side and of its margin; a label depends on pixels up to six away.
SIDE, MARGIN = 256, 8


@dataclass(frozen=True)
class Network:
    """Kernels by output, input, row and column, and biases by output; bands are scaled, then made (x - mean) / std."""

    first: tuple[np.ndarray, np.ndarray]
    middle: tuple[np.ndarray, np.ndarray]
    joined: tuple[np.ndarray, np.ndarray]
    head: tuple[np.ndarray, np.ndarray]
    mean: np.ndarray
    std: np.ndarray
    scale: float = 1.0

    def __post_init__(self):
        width = {"first": len(self.mean), "middle": len(self.first[1]), "joined": len(self.middle[1]) + len(self.first[1]), "head": len(self.joined[1])}
        for name, n in width.items():
            kernel, bias = getattr(self, name)
            if np.shape(kernel) != (len(bias), n, 3, 3):
                raise ValueError(f"{name}: kernels of {np.shape(kernel)}, not {(len(bias), n, 3, 3)}")


def convolved(grid: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """grid: channel, row, column; the edge stands for what lies beyond it."""
    wide = np.pad(grid, ((0, 0), (1, 1), (1, 1)), mode="edge")
    h, w = grid.shape[1:]
    out = np.broadcast_to(np.asarray(bias, float)[:, None, None], (len(bias), h, w)).copy()
    for i in range(3):
        for j in range(3):
            out += np.einsum("oc,chw->ohw", np.asarray(kernel, float)[:, :, i, j], wide[:, i : i + h, j : j + w])
    return out


def labels_of(grid: np.ndarray, net: Network) -> np.ndarray:
    """Labels of a whole grid (band, row, column)."""
    h, w = grid.shape[1:]
    even = np.pad(grid, ((0, 0), (0, h % 2), (0, w % 2)), mode="edge")
    x = (even * net.scale - np.asarray(net.mean, float)[:, None, None]) / np.asarray(net.std, float)[:, None, None]
    first = np.maximum(convolved(x, *net.first), 0)
    c, hh, ww = first.shape
    pooled = first.reshape(c, hh // 2, 2, ww // 2, 2).max(axis=(2, 4))
    middle = np.maximum(convolved(pooled, *net.middle), 0)
    joined = np.concatenate([middle.repeat(2, axis=1).repeat(2, axis=2), first])
    return np.argmax(convolved(np.maximum(convolved(joined, *net.joined), 0), *net.head), axis=0)[:h, :w]


def segmented(pixels: DataFrame, bands: list[str], net: Network, side: int = SIDE, margin: int = MARGIN) -> DataFrame:
    """image, row, col, label of pixels (image, row, col from 0, bands)."""
    if side % 2 or margin % 2:
        raise ValueError("sides and margins are even")
    own = pixels.select("image", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), *[F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias(b) for b in bands])
    size = own.groupBy("image").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    near = lambda c: F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-margin, 0, margin))), lambda d: F.greatest(F.floor((F.col(c) + d) / side), F.lit(0)))))
    held = join_checked(own, size, ["image"]).select("*", near("row").alias("_r")).select("*", near("col").alias("_c"))
    # A square that lies beyond the image, reached from its last rows alone, has nothing to label.
    held = held.filter((F.col("_r") * side < F.col("_h")) & (F.col("_c") * side < F.col("_w")))

    def one(df: pd.DataFrame) -> pd.DataFrame:
        h, w, r, c = (int(df[x].iloc[0]) for x in ("_h", "_w", "_r", "_c"))
        top, left = max(0, r * side - margin), max(0, c * side - margin)
        low, right = min(h, (r + 1) * side + margin), min(w, (c + 1) * side + margin)
        grid = np.zeros((len(bands), low - top, right - left))
        row, col = df["row"].to_numpy(), df["col"].to_numpy()
        np.add.at(grid, (slice(None), row - top, col - left), df[bands].to_numpy(float).T)
        found = labels_of(grid, net)
        mine = df.loc[(row // side == r) & (col // side == c), ["image", "row", "col"]].drop_duplicates()
        return mine.assign(label=found[mine["row"].to_numpy() - top, mine["col"].to_numpy() - left].astype("int32"))

    return held.groupBy("image", "_r", "_c").applyInPandas(one, f"image {pixels.schema['image'].dataType.simpleString()}, row bigint, col bigint, label int")
