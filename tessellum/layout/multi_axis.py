"""Block-cyclic layouts of several axes over an N-dimensional mesh, and the collectives between them.

``mapping[k]`` lists the mesh dimensions that axis k is dealt over; in that order they form one
virtual row of processors, and blocks of ``blocks[k]`` cells go round it.  Mesh dimensions that no
axis uses hold copies.  Planning methods return (layout, elements moved, processors involved).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.layout.axis import axis_compatible, block_owner, index_columns, linear_column, to_linear, whole_division
from tessellum.layout.base import Layout, by_rank

Step = tuple[str, "MultiAxisLayout", int, int]


class MultiAxisLayout(Layout):
    def __init__(self, mesh: int | Sequence[int], mapping: Sequence[Sequence[int] | None], blocks: int | Sequence[int | None]):
        super().__init__(mesh)
        self.mapping = tuple(tuple(m) if m else () for m in mapping)
        given = [blocks] * len(self.mapping) if isinstance(blocks, int) else list(blocks)
        if len(given) != len(self.mapping):
            raise ValueError(f"{len(given)} block sizes for {len(self.mapping)} axes")
        used = [d for m in self.mapping for d in m]
        if len(set(used)) != len(used):
            raise ValueError("a mesh dimension is mapped twice")
        if any(not 0 <= d < len(self.mesh) for d in used):
            raise ValueError(f"mesh dimensions are 0 to {len(self.mesh) - 1}")
        if any(b is not None and b != -1 and b <= 0 for b in given):
            raise ValueError("block sizes are positive")
        self.blocks = tuple((1 if b is None or b == -1 else b) if m else -1 for b, m in zip(given, self.mapping, strict=True))

    def __str__(self) -> str:
        shown = ["∅" if not m else str(m[0]) if len(m) == 1 else "(" + ",".join(map(str, m)) + ")" for m in self.mapping]
        sizes = ["∅" if b == -1 else str(b) for b in self.blocks]
        return f"D_[{','.join(map(str, self.mesh))}]⊥{{{','.join(shown)}}}({','.join(sizes)})"

    def latex(self) -> str:
        shown = [r"\emptyset" if not m else str(m[0]) if len(m) == 1 else "(" + ",".join(map(str, m)) + ")" for m in self.mapping]
        sizes = [r"\emptyset" if b == -1 else str(b) for b in self.blocks]
        return rf"$T_{{\perp\{{ {','.join(shown)} \}}({','.join(sizes)})}}$"

    @property
    def distributed(self) -> bool:
        return any(self.mapping)

    def spread(self, axis: int) -> int:
        """The processors an axis is dealt over."""
        return math.prod(self.mesh[d] for d in self.mapping[axis])

    @property
    def free_dims(self) -> list[int]:
        used = {d for m in self.mapping for d in m}
        return [d for d in range(len(self.mesh)) if d not in used]

    def compatible(self, shape: Sequence[int]) -> bool:
        return len(shape) == len(self.mapping) and all(axis_compatible(n, b, self.spread(k)) for k, (n, b) in enumerate(zip(shape, self.blocks, strict=True)) if self.mapping[k])

    # Ownership.

    def ranks(self, shape: Sequence[int], index: Sequence[Column]) -> Column:
        place: dict[int, Column] = {}
        for k, dims in enumerate(self.mapping):
            if dims:
                own = block_owner(index[k], self.blocks[k], self.spread(k))
                place.update(zip(dims, index_columns(own, [self.mesh[d] for d in dims]), strict=True))
        strides = [math.prod(self.mesh[d + 1 :]) for d in range(len(self.mesh))]
        fixed = F.lit(0).cast("bigint")
        for d, at in place.items():
            fixed = fixed + at * strides[d]
        free = [sum(i * strides[d] for i, d in zip(at, self.free_dims, strict=True)) for at in itertools.product(*(range(self.mesh[d]) for d in self.free_dims))]
        return F.transform(F.array(*(F.lit(o).cast("bigint") for o in free)), lambda o: (fixed + o).cast("int"))

    def owns(self, shape: Sequence[int], index: Sequence[Column], rank: Column) -> Column:
        """Whether a rank owns a cell."""
        at = index_columns(rank, self.mesh)
        out = F.lit(True)
        for k, dims in enumerate(self.mapping):
            if dims:
                virtual = linear_column([self.mesh[d] for d in dims], [at[d] for d in dims])
                out = out & (block_owner(index[k], self.blocks[k], self.spread(k)) == virtual)
        return out

    def local_index(self, index: Sequence[Column]) -> list[Column]:
        """A cell's coordinates inside its owner's local tensor."""
        out = []
        for k, dims in enumerate(self.mapping):
            b, p = self.blocks[k], self.spread(k)
            out.append(whole_division(index[k], b * p) * b + F.pmod(index[k], F.lit(b)) if dims else index[k])
        return out

    def location(self, shape: Sequence[int], index: Sequence[int]) -> list[int]:
        self.require(shape)
        return [r for r in range(self.processors) if all(index[k] // self.blocks[k] % self.spread(k) == self._virtual(r, k) for k, dims in enumerate(self.mapping) if dims)]

    def _virtual(self, rank: int, axis: int) -> int:
        return to_linear(self.mesh, self.mesh_index(rank), self.mapping[axis])

    def local_shape(self, shape: Sequence[int], rank: int) -> tuple[int, ...]:
        self.require(shape)
        out = []
        for k, n in enumerate(shape):
            if self.mapping[k]:
                b, p, v = self.blocks[k], self.spread(k), self._virtual(rank, k)
                rounds, rest = divmod(n, b * p)
                n = rounds * b + min(b, max(0, rest - v * b))
            out.append(n)
        return tuple(out)

    # Collectives.

    def _with(self, mapping: Sequence[Sequence[int]], blocks: Sequence[int]) -> MultiAxisLayout:
        return MultiAxisLayout(self.mesh, mapping, blocks)

    def _need(self, shape: Sequence[int], axis: int | None = None) -> None:
        self.require(shape)
        if not self.distributed or (axis is not None and not self.mapping[axis]):
            raise ValueError("the tensor is not distributed" if axis is None else f"axis {axis} is not distributed")

    def all_gather(self, shape: Sequence[int], dim: int | None = None) -> tuple[MultiAxisLayout, int, int]:
        """Undo the dealing over one mesh dimension, or over all."""
        self._need(shape)
        if dim is None:
            procs = math.prod(self.spread(k) for k in range(len(shape)))
            return self._with([()] * len(shape), [-1] * len(shape)), self.max_elements(shape) * procs, procs
        axis = next((k for k, m in enumerate(self.mapping) if dim in m), None)
        if axis is None:
            raise ValueError(f"nothing is dealt over mesh dimension {dim}")
        at = self.mapping[axis].index(dim)
        if at not in (0, len(self.mapping[axis]) - 1):
            raise ValueError(f"mesh dimension {dim} is neither first nor last on axis {axis}; gathering it leaves no block-cyclic layout")
        procs, blocks = self.mesh[dim], list(self.blocks)
        if at:
            blocks[axis] *= procs
        return self._with([[d for d in m if d != dim] for m in self.mapping], blocks), self.max_elements(shape) * procs, procs

    def split(self, shape: Sequence[int], axis: int, dims: int | Sequence[int], block: int = 1, minor: bool = False) -> tuple[MultiAxisLayout, int, int]:
        """Deal an axis over further mesh dimensions.  Nothing moves: every rank keeps a part of what it has."""
        self.require(shape)
        dims = (dims,) if isinstance(dims, int) else tuple(dims)
        mapping, blocks = list(self.mapping), list(self.blocks)
        if not mapping[axis]:
            mapping[axis], blocks[axis] = dims, block
        elif minor:
            procs = math.prod(self.mesh[d] for d in dims)
            if blocks[axis] % procs:
                raise ValueError(f"blocks of {blocks[axis]} do not split into {procs}")
            mapping[axis], blocks[axis] = mapping[axis] + dims, blocks[axis] // procs
        else:
            mapping[axis] = dims + mapping[axis]
        return self._fitting(shape, mapping, blocks), 0, 0

    def permute(self, shape: Sequence[int], dims: Sequence[int]) -> tuple[MultiAxisLayout, int, int]:
        """Exchange two mesh dimensions of equal size in the mapping of one axis."""
        self._need(shape)
        a, b = dims
        if self.mesh[a] != self.mesh[b]:
            raise ValueError(f"mesh dimensions {a} and {b} differ in size")
        if not any({a, b} <= set(m) for m in self.mapping):
            raise ValueError(f"mesh dimensions {a} and {b} are not mapped by one axis")
        swap = {a: b, b: a}
        return self._with([[swap.get(d, d) for d in m] for m in self.mapping], self.blocks), self.max_elements(shape), 2

    def all_to_all(self, shape: Sequence[int], source: int, target: int, block: int = -1, from_minor: bool = False, to_minor: bool = False) -> tuple[MultiAxisLayout, int, int]:
        """Deal another axis over the mesh dimensions of one, or over the last of them."""
        self._need(shape, source)
        if source == target:
            raise ValueError("source and target are the same axis")
        moved = self.mapping[source][-1:] if from_minor else self.mapping[source]
        procs = math.prod(self.mesh[d] for d in moved)
        mapping, blocks = list(self.mapping), list(self.blocks)
        fresh = not mapping[target]
        if to_minor:
            whole = shape[target] if fresh else blocks[target]
            if whole % procs:
                raise ValueError(f"{whole} cells of axis {target} do not split into {procs}")
        if fresh:
            blocks[target] = self.blocks[source] if block < 0 else block
        elif to_minor:
            blocks[target] //= procs
        mapping[target] = mapping[target] + moved if to_minor else moved + mapping[target]
        mapping[source] = mapping[source][:-1] if from_minor else ()
        blocks[source] = blocks[source] * procs if from_minor else -1
        return self._fitting(shape, mapping, blocks), self.max_elements(shape) * procs, procs

    def change_block(self, shape: Sequence[int], axis: int, block: int) -> tuple[MultiAxisLayout, int, int]:
        """Another block size: a multiple of a whole round of blocks, or 1."""
        self._need(shape, axis)
        old, procs = self.blocks[axis], self.spread(axis)
        if block == old or block < 1 or (block > old and block % (old * procs)) or (block < old and block != 1):
            raise ValueError(f"blocks of {old} over {procs} processors cannot become blocks of {block}")
        blocks = list(self.blocks)
        blocks[axis] = block
        return self._fitting(shape, self.mapping, blocks), self.max_elements(shape), procs

    def _fitting(self, shape: Sequence[int], mapping, blocks) -> MultiAxisLayout:
        made = self._with(mapping, blocks)
        made.require(shape)
        return made

    def neighbours(self, shape: Sequence[int], block_sizes: Sequence[int] = ()) -> list[Step]:
        """All layouts one collective away: (operation, layout, elements, processors), in a fixed order."""
        sizes = sorted({1, *block_sizes})
        axes = range(len(shape))
        used = [d for d in range(len(self.mesh)) if d not in self.free_dims]
        tries: list[tuple[str, object]] = []
        for dim, b, axis in itertools.product(self.free_dims, sizes, axes):
            tries.append((f"split_{axis}_{dim}_{b}", lambda a=axis, d=dim, b=b: self.split(shape, a, d, b)))
            tries.append((f"split_minor_{axis}_{dim}_{b}", lambda a=axis, d=dim, b=b: self.split(shape, a, d, b, True)))
        tries.append(("allgather_*", lambda: self.all_gather(shape)))
        tries += [(f"allgather_{d}", lambda d=d: self.all_gather(shape, d)) for d in used]
        tries += [(f"permute_{p[0]}_{p[1]}", lambda p=p: self.permute(shape, p)) for m in self.mapping for p in itertools.combinations(m, 2)]
        for source, target, b in itertools.product(axes, axes, [-1, *sizes]):
            for mf, mt in itertools.product((False, True), repeat=2):
                if self.mapping[source] and (not mf or len(self.mapping[source]) > 1) and (not mt or len(self.mapping[target]) > 1):
                    name = "alltoall" + "_mf" * mf + "_mt" * mt + f"_{source}_{target}_{b}"
                    tries.append((name, lambda s=source, t=target, b=b, mf=mf, mt=mt: self.all_to_all(shape, s, t, b, mf, mt)))
        tries += [(f"reblock_{axis}_{b}", lambda a=axis, b=b: self.change_block(shape, a, b)) for axis, b in itertools.product(axes, sizes)]
        out = []
        for name, make in tries:
            try:
                out.append((name, *make()))
            except ValueError:
                continue
        return out

    # Execution on placed frames.

    def one_copy(self, rank: Column) -> Column:
        """Whether a rank is the first of those that hold the same cells."""
        at = index_columns(rank, self.mesh)
        out = F.lit(True)
        for d in self.free_dims:
            out = out & (at[d] == 0)
        return out


def move(placed: DataFrame, shape: Sequence[int], start: MultiAxisLayout, target: MultiAxisLayout) -> DataFrame:
    """A placed frame under another layout of the same mesh.

    Where the target's cells of every rank are among the start's, rows are filtered in place;
    otherwise one copy of each row is sent to its new owners.
    """
    if start.mesh != target.mesh:
        raise ValueError("the layouts have different meshes")
    target.require(shape)
    index = [F.col(f"d{k}") for k in range(len(shape))]
    if _refines(start, target):
        return placed.where(target.owns(shape, index, F.col("rank")))
    sent = placed.where(start.one_copy(F.col("rank"))).withColumn("rank", F.explode(target.ranks(shape, index)))
    return by_rank(sent, target.processors)


def _refines(start: MultiAxisLayout, target: MultiAxisLayout) -> bool:
    """Whether the target only deals undealt axes further, or appends mesh dimensions inside blocks."""
    for a, b, x, y in zip(start.mapping, target.mapping, start.blocks, target.blocks, strict=True):
        inside = len(b) >= len(a) and b[: len(a)] == a and (not a or x == y * math.prod(target.mesh[d] for d in b[len(a) :]))
        outside = bool(a) and len(b) > len(a) and b[len(b) - len(a) :] == a and x == y
        if not (inside or outside):
            return False
    return True
