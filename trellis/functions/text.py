"""Text functions over code-index columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ACCESSIBILITY_RANK, COMMENT_TAGS, TEST_FRAMEWORKS


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sha16(x: str | Column) -> Column:
    return F.substring(F.sha2(_c(x), 256), 1, 16)


def canonical_id(url: str | Column, path: str | Column) -> Column:
    """Identity of a project: 16 digits of the hash of its normalised address and path."""
    return sha16(F.concat(normalize_url(url), F.lit("|"), _c(path)))


def signature_hash(signature: str | Column, fallback: str | Column | None = None) -> Column:
    s = _c(signature) if fallback is None else F.coalesce(_c(signature), _c(fallback))
    return F.sha2(s, 256)


def normalize_url(url: str | Column) -> Column:
    """https form of a repository address: no credentials, port, query, .git or last slash; the host in lower case."""
    u = F.trim(_c(url))
    u = F.regexp_replace(u, r"^(?![a-zA-Z][a-zA-Z0-9+.-]*://)(?:[^@/:]+@)?([^/:]+):(?!//)(.*)$", "https://$1/$2")
    u = F.regexp_replace(u, r"^(?i)(?:ssh|git)://", "https://")
    u = F.regexp_replace(u, r"(?i)\.git$", "")
    u = F.regexp_replace(u, r"^(https?://)[^/@]*@", "$1")
    u = F.regexp_replace(u, r"^(https?://[^/:?#]+):\d+", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"/$", "")
    host = F.regexp_extract(u, r"^(https?://[^/]*)", 1)
    return F.when(host != "", F.concat(F.lower(host), F.substr(u, F.length(host) + 1))).otherwise(u)


def namespace_of(fqn: str | Column) -> Column:
    """What is before the last dot; null without one."""
    return F.nullif(F.regexp_extract(_c(fqn), r"(?s)^(.*)\.[^.]*$", 1), F.lit(""))


def _before_paren(fqn: str | Column) -> Column:
    return F.substring_index(_c(fqn), "(", 1)


def simple_name(fqn: str | Column) -> Column:
    """Last segment of a name, without its parameters."""
    return F.substring_index(_before_paren(fqn), ".", -1)


def containing_type(fqn: str | Column) -> Column:
    """The name without parameters and its last segment; null without one."""
    return namespace_of(_before_paren(fqn))


def count_parameters(signature: str | Column) -> Column:
    """Commas outside angle brackets plus one, between the first ( and the last ); 0 if that is blank or missing."""
    inner = F.regexp_extract(_c(signature), r"(?s)^[^(]*\((.*)\)", 1)
    state = F.aggregate(
        F.split(inner, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n")),
        lambda s, ch: F.struct(
            (s["depth"] + F.when(ch == "<", 1).when(ch == ">", -1).otherwise(0)).alias("depth"),
            (s["n"] + F.when((ch == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("n"),
        ),
        lambda s: s["n"],
    )
    return F.when(F.trim(F.coalesce(inner, F.lit(""))) == "", F.lit(0)).otherwise(state)


def strip_xml(text: str | Column) -> Column:
    """Text of a documentation comment: tags out, white space runs to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"<[^>]+>", " "), r"\s+", " "))


def attribute_list(attributes: str | Column) -> Column:
    """A JSON array of strings as an array; anything else is null."""
    a = _c(attributes)
    parsed = F.from_json(a, "array<string>")
    return F.when(a.rlike(r'^\s*\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$'), parsed)


def comment_tag(comment: str | Column) -> Column:
    """Upper-cased tag of a comment that starts with one; empty if it doesn't."""
    return F.upper(F.regexp_extract(_c(comment), _TAG, 1))


def comment_text(comment: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(_c(comment), _TAG, 2), r"\s*\*/\s*$", ""))


_TAG = r"(?is)(?://\s*|^\s*/\*.*?)(" + "|".join(COMMENT_TAGS) + r")\b[:\s]*(.*)$"


def csv_list(text: str | Column) -> Column:
    """Comma-separated values, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(_c(text), ","), F.trim), lambda x: x != "")


def accessibility_rank(accessibility: str | Column) -> Column:
    """5 for public down to 0 for private, -1 for anything else."""
    a = _c(accessibility)
    return F.coalesce(reduce(lambda acc, kv: acc.when(a == kv[0], kv[1]), ACCESSIBILITY_RANK.items(), F), F.lit(-1)).cast("int")


def snippet(line: str | Column, start: str | Column, end: str | Column, around: int = 60, cap: int = 120) -> Column:
    """Text around the span [start, end) of a line, white space collapsed, capped."""
    text, a = _c(line), F.greatest(_c(start) - around, F.lit(0))
    cut = F.substr(text, (a + 1).cast("int"), (F.least(_c(end) + around, F.length(text)) - a).cast("int"))
    return F.substring(F.trim(F.regexp_replace(cut, r"\s+", " ")), 1, cap)


def file_name(path: str | Column, extension: bool = True) -> Column:
    name = F.substring_index(F.regexp_replace(_c(path), r"\\", "/"), "/", -1)
    return name if extension else F.regexp_replace(name, r"\.[^.]*$", "")


def citations(text: str | Column) -> Column:
    """Distinct qualified names that a text cites as global::A.B.C, without parameters."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(global::[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)"), 1)
    return F.array_distinct(found)


def test_framework(attributes: Column) -> Column:
    """Framework of a test's attribute array, by the first substring that is in any of them."""
    joined = F.array_join(attributes, " ")
    return F.coalesce(reduce(lambda acc, kv: acc.when(joined.contains(kv[0]), kv[1]), TEST_FRAMEWORKS, F), F.lit("unknown"))


def package_of_path(path: str | Column) -> Column:
    """Segment between a folder `packages` and a further one of a path; null without one."""
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(path), r"\\", "/"), r"(?i)(?:^|/)packages/([^/]+)/", 1), F.lit(""))


nuget_package = package_of_path


def target_framework(xml: str | Column) -> Column:
    """First TargetFramework of a project file, else the first of its TargetFrameworks."""
    one = F.xpath_string(_c(xml), F.lit("//TargetFramework"))
    many = F.split(F.xpath_string(_c(xml), F.lit("//TargetFrameworks")), ";")
    return F.coalesce(F.nullif(F.trim(one), F.lit("")), F.nullif(F.trim(F.get(many, F.lit(0))), F.lit("")))


def valid_profile(name: str | Column) -> Column:
    return _c(name).rlike(r"^[a-zA-Z0-9_-]+$")


def is_generated(path: str | Column) -> Column:
    return _c(path).rlike(r"(?i)(?:\.g\.cs|\.designer\.cs)$|[/\\]obj[/\\]")


def is_ignored(path: str | Column) -> Column:
    """Whether a changed file lies in a build or repository folder."""
    return _c(path).rlike(r"(?i)[/\\](?:obj|bin|\.git)[/\\]")


def like_contains(column: str | Column, needle: str) -> Column:
    """Contains, with % and _ as wildcards and letters of any case; a backslash is itself."""
    return F.ilike(_c(column), F.lit("%" + needle.replace("\\", "\\\\") + "%"))


def like_prefix(column: str | Column, prefix: str) -> Column:
    return F.ilike(_c(column), F.lit(prefix.replace("\\", "\\\\") + "%"))


def _marked() -> dict[str, str]:
    """Small letters of Latin, Greek and Cyrillic that Unicode takes apart into a letter and marks, and those letters."""
    places = (*range(0xC0, 0x530), *range(0x1E00, 0x2000))
    apart = {chr(k): unicodedata.normalize("NFD", chr(k)) for k in places}
    return {c: d[0] for c, d in apart.items() if c == c.lower() and len(d) > 1 and all(map(unicodedata.combining, d[1:]))}


MARKED = _marked()
ACCENTED, PLAIN = "".join(MARKED), "".join(MARKED.values())


def fold_accents(text: str | Column) -> Column:
    """Lower case, without the marks of Latin, Greek and Cyrillic letters, composed or combining."""
    return F.translate(F.regexp_replace(F.lower(_c(text)), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def fold_text(text: str) -> str:
    """fold_accents of a text at hand, such as a query."""
    return "".join(MARKED.get(c, c) for c in text.lower() if unicodedata.category(c) != "Mn")


def tokens(text: str | Column) -> Column:
    """Words of a full-text column: runs of letters and digits, folded."""
    return F.filter(F.split(fold_accents(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")
