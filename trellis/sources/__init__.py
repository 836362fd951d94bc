"""Where tables come from and go to."""

from .envelope import envelope
from .files import assign_submodules, content_hashes, extract_comments, project_files, submodules
from .star import from_star
from .versions import Conflict, collect_versions, manifest, materialize, publish, read_current, read_version

__all__ = [n for n in dir() if not n.startswith("_")]
