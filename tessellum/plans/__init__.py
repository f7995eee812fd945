"""Costs of collectives and plans that lead from one layout to another."""

from tessellum.plans.cost import Cost, CostModel, IdealLowerBounds
from tessellum.plans.planner import NaivePlanner, Planner, SearchPlanner, execute_schedule, find_routes, schedule_frame

__all__ = ["Cost", "CostModel", "IdealLowerBounds", "NaivePlanner", "Planner", "SearchPlanner", "execute_schedule", "find_routes", "schedule_frame"]
