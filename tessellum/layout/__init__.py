"""Which processor of a mesh owns which cell of a tensor."""

from tessellum.layout.multi_axis import MultiAxisLayout
from tessellum.layout.simple import SlabLayout, TileLayout

__all__ = ["MultiAxisLayout", "SlabLayout", "TileLayout"]
