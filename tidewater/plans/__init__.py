"""Whole jobs and registered queries."""

from tidewater.plans.job import TaskResult, run_task

__all__ = ["TaskResult", "run_task"]
