"""Reductions that go on while cells arrive."""

from tessellum.streaming.running import running_sum

__all__ = ["running_sum"]
