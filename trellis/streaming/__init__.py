"""Change streams and incremental maintenance."""

from .incremental import apply_changes, cascade_items, changed_files, rebuilt_equals, signature_changes, work_order
from .stream import change_source, debounced, index_batch, maintain, maintain_index

__all__ = [n for n in dir() if not n.startswith("_")]
