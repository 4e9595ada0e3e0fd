"""Salvage: inventory, normalise, export and audit legacy databases as Spark jobs."""

from salvage.options import EVERYTHING, SCHEMA_ONLY, UnpackOptions
from salvage.plans.unpack import UnpackResult, unpack
from salvage.session import build_session, scratch_dir

__all__ = [
    "EVERYTHING",
    "SCHEMA_ONLY",
    "UnpackOptions",
    "UnpackResult",
    "build_session",
    "scratch_dir",
    "unpack",
]
