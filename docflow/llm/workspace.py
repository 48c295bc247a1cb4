"""Intermediate tables that outlive the loss of an executor: see docflow.plans.workspace."""

from docflow.plans.workspace import Workspace, shared_dir

__all__ = ["Workspace", "shared_dir"]
