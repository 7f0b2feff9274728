"""Inputs: action log, user table, task record; outputs: idempotent sinks."""

from tidewater.sources.actions import actions_in_range, adapt_actions, adapt_users, save_actions, user_dim
from tidewater.sources.sinks import replace_task_jdbc, write_jdbc, write_task_output, write_task_table
from tidewater.sources.tasks import TaskParams, read_source, read_task, read_task_jdbc, task_params

__all__ = [
    "TaskParams", "actions_in_range", "adapt_actions", "adapt_users", "read_source", "read_task", "read_task_jdbc", "replace_task_jdbc", "save_actions",
    "task_params", "user_dim", "write_jdbc", "write_task_output", "write_task_table",
]
