"""Cutting lineage on storage that all executors share; see quillmark.storage."""

from quillmark.storage import SETTING, discard, shared_folder, written

__all__ = ["SETTING", "discard", "shared_folder", "written"]
