"""Intermediate tables in the folder that every machine of the cluster shares."""

from ..scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
