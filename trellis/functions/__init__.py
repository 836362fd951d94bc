"""Column functions: built-in expressions only."""

from .text import (
    accessibility_rank,
    attribute_list,
    canonical_id,
    citations,
    comment_tag,
    comment_text,
    containing_type,
    count_parameters,
    csv_list,
    file_name,
    fold_accents,
    fold_text,
    is_generated,
    is_ignored,
    like_contains,
    like_prefix,
    namespace_of,
    normalize_url,
    nuget_package,
    package_of_path,
    sha16,
    signature_hash,
    simple_name,
    snippet,
    strip_xml,
    target_framework,
    test_framework,
    tokens,
    valid_profile,
)

__all__ = [n for n in dir() if not n.startswith("_") and n != "text"]
