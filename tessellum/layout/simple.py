"""Layouts that give each cell to one rank: slabs of one axis, and square tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellum.layout.axis import axis_compatible, block_owner, even_owner, linear_column, splits, to_linear, whole_division
from tessellum.layout.base import Layout
from tessellum.layout.multi_axis import MultiAxisLayout


class SlabLayout(Layout):
    """One axis dealt in blocks; block 0 deals it out evenly."""

    def __init__(self, mesh: int | Sequence[int], axis: int = 0, block: int = 0):
        super().__init__(mesh)
        self.axis, self.block = axis, block

    def __str__(self) -> str:
        return f"D_[{self.processors}]⊥{self.axis}({self.block})"

    def as_multi_axis(self, order: int) -> MultiAxisLayout:
        """The same layout of tensors of some order, among those that collectives lead between."""
        if not self.block:
            raise ValueError("an even split has no block size")
        return MultiAxisLayout((self.processors,), [(0,) if k == self.axis else None for k in range(order)], [self.block if k == self.axis else None for k in range(order)])

    def latex(self) -> str:
        return rf"T_{{\perp\{{ {self.axis} \}}({self.block})}}"

    def compatible(self, shape: Sequence[int]) -> bool:
        return len(shape) > self.axis and axis_compatible(shape[self.axis], self.block, self.processors)

    def ranks(self, shape: Sequence[int], index: Sequence[Column]) -> Column:
        x = index[self.axis]
        own = block_owner(x, self.block, self.processors) if self.block else even_owner(x, shape[self.axis], self.processors)
        return F.array(own.cast("int"))

    def location(self, shape: Sequence[int], index: Sequence[int]) -> list[int]:
        self.require(shape)
        block = next(i for i, (_, end) in enumerate(splits(shape[self.axis], self.block, self.processors)) if index[self.axis] < end)
        return [block % self.processors]

    def local_shape(self, shape: Sequence[int], rank: int) -> tuple[int, ...]:
        self.require(shape)
        own = sum(n for n, _ in splits(shape[self.axis], self.block, self.processors)[rank :: self.processors])
        return tuple(own if k == self.axis else n for k, n in enumerate(shape))


def to_multi_axis(layout: Layout, shape: Sequence[int]) -> MultiAxisLayout:
    """The layout of several axes, among which collectives lead, that places every cell of a shape as ``layout`` does.

    A slab is dealt along its axis, an even split too where it leaves no remainder; tiles are dealt along the
    first axis if a column of tiles goes round all processors a whole number of times, or along all axes up to
    one that does.  ValueError where no layout of several axes places cells so.
    """
    layout.require(shape)
    if isinstance(layout, MultiAxisLayout):
        return layout
    if isinstance(layout, SlabLayout):
        if layout.block:
            return layout.as_multi_axis(len(shape))
        if shape[layout.axis] % layout.processors == 0:
            return SlabLayout(layout.processors, layout.axis, shape[layout.axis] // layout.processors).as_multi_axis(len(shape))
        raise ValueError(f"{shape[layout.axis]} cells split evenly into {layout.processors} parts have no block size")
    if not isinstance(layout, TileLayout):
        raise ValueError(f"{layout} is no layout of slabs or tiles")
    # The number of a tile counts the first axis fastest: what it is modulo the processors is a product of
    # coordinates while each axis divides what the ones before it leave of them.
    left, mesh, used = layout.processors, [], []
    for k, n in enumerate(shape):
        tiles = n // layout.tile
        here = left if tiles % left == 0 else tiles
        if left % here:
            raise ValueError(f"{tiles} tiles along axis {k} do not go round {left} processors evenly")
        mesh.append(here)
        used.append(k)
        left //= here
        if left == 1:
            break
    if left > 1:
        raise ValueError(f"there are fewer tiles than the {layout.processors} processors")
    # Ranks count the first axis fastest, a mesh its last dimension.
    dims = {k: len(mesh) - 1 - i for i, k in enumerate(used)}
    return MultiAxisLayout(mesh[::-1], [(dims[k],) if k in dims else None for k in range(len(shape))], [layout.tile if k in dims else None for k in range(len(shape))])


class TileLayout(Layout):
    """Square tiles dealt one after another, the first axis fastest."""

    def __init__(self, mesh: int | Sequence[int], tile: int):
        super().__init__(mesh)
        if tile < 1:
            raise ValueError("a tile has at least one cell")
        self.tile = tile

    def __str__(self) -> str:
        return f"D_[{self.processors}]⊥({self.tile})"

    def latex(self) -> str:
        return rf"T_(\perp\{{ {self.tile} \}})"

    def compatible(self, shape: Sequence[int]) -> bool:
        return all(n % self.tile == 0 for n in shape)

    def _grid(self, shape: Sequence[int]) -> list[int]:
        return [n // self.tile for n in shape]

    def ranks(self, shape: Sequence[int], index: Sequence[Column]) -> Column:
        grid = [whole_division(x, self.tile) for x in index]
        at = linear_column(self._grid(shape), grid, range(len(shape) - 1, -1, -1))
        return F.array(F.pmod(at, F.lit(self.processors)).cast("int"))

    def location(self, shape: Sequence[int], index: Sequence[int]) -> list[int]:
        self.require(shape)
        at = to_linear(self._grid(shape), [x // self.tile for x in index], range(len(shape) - 1, -1, -1))
        return [at % self.processors]

    def local_shape(self, shape: Sequence[int], rank: int) -> tuple[int, ...]:
        """Tiles of a rank need not form a box: (tiles, tile, tile, ...)."""
        self.require(shape)
        tiles = 1
        for n in self._grid(shape):
            tiles *= n
        return (len(range(rank, tiles, self.processors)), *([self.tile] * len(shape)))
