"""From tokens on a coarse grid to labelled regions of a volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from . import tiles
from .components import connected_components
from .crops import nearest_seed
from .grid import trilinear
from .resample import otsu
from .voxels import channel_sum

Shape = tuple[int, int, int]
_AT = ["tp", "z", "y", "x"]


def response(volume: DataFrame, shape: Shape, radius: int, blur: float, spot: float = 2.0, outline: float = 2.0, side: int = 32) -> DataFrame:
    """(tp, z, y, x, outline, peak): the volume less its opening by a ball, through the negative Laplacian of a Gaussian and a blur.

    ``outline`` is that blurred once more, ``peak`` 1 at the maxima of the
    same blurred by ``spot``.  One exchange serves the whole chain.
    """
    first = [tiles.without(tiles.opened(radius)), tiles.weighted(-tiles.laplacian_of_gaussian()), tiles.blurred(blur)]
    return tiles.stencils(volume, shape, {"outline": [tiles.blurred(outline)], "peak": [tiles.blurred(spot), tiles.peaks()]}, first, side)


def regions(told: DataFrame, shape: Shape) -> DataFrame:
    """(tp, z, y, x, label): voxels above the outline's Otsu threshold by their nearest peak inside it.

    Touching peaks are one seed, numbered in raster order; of equally near
    seeds the least counts.  Pieces of the mask that hold no peak get no label.
    Time points of one value have no voxel above their threshold.
    """
    _, height, width = shape
    ends = otsu(told, ["tp"], "outline")
    mask = cut(told.join(ends, "tp").filter("outline > threshold").select(*_AT, "peak"))
    seeds = connected_components(mask.filter("peak = 1"), height, width)
    pieces = connected_components(mask, height, width).withColumnRenamed("label", "piece")
    held = pieces.join(seeds.select(*_AT), _AT).select("tp", "piece").distinct()
    cells = pieces.join(held, ["tp", "piece"], "left_semi")
    return nearest_seed(cells, seeds, shape).select(*_AT, "label")


def segmented(tokens: DataFrame, shape: Shape, target: Shape, radius: int = 5, blur: float = 1.0, spot: float = 2.0, outline: float = 2.0, side: int = 32) -> DataFrame:
    """(tp, z, y, x, label): the regions of tokens (tp, z, y, x, features) on the grid ``shape``, on the volume's grid ``target``.

    Channels are summed (attention left out), the sums interpolated to the
    volume's grid, its background removed; see :func:`response` and
    :func:`regions`.  Missing tokens are zero; null features too.
    """
    sums = tokens.select(*_AT, F.coalesce(channel_sum(F.col("features")), F.lit(0.0)).alias("v"))
    told = cut(response(trilinear(sums, shape, target), target, radius, blur, spot, outline, side))
    return regions(told, target)
