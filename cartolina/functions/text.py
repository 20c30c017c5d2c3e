"""Scalar functions on paths, ids, references and targets, as Columns; and the glob compiler, which runs on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed limits of owner and repository names.
OWNER_PATTERN = r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})$"
REF_LENGTH = 255
REPO_PATTERN = r"^[A-Za-z0-9._-]{1,100}$"


def bare_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def module_of(symbol_id: Column) -> Column:
    return F.substring_index(symbol_id, ":", 2)


def path_tail(path: Column, n: int = 2) -> Column:
    return F.substring_index(path, "/", -n)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def is_external(target: Column) -> Column:
    return target.startswith("pkg:")


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def bounded_int(value: Column, fallback: int, most: int) -> Column:
    """A setting: plain decimal digits between 1 and most, anything else the fallback."""
    n = F.when(value.rlike(r"\A[0-9]+\z"), value.try_cast("decimal(38,0)"))
    return F.when((n >= 1) & (n <= most), n.cast("long")).otherwise(F.lit(fallback).cast("long"))


#: White space, also beyond ASCII, as a class of a regular expression.
_BLANK = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


_BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def valid_ref(ref: Column) -> Column:
    """A branch, tag or commit that is safe to hand to git: it can't be read as an option, and has none of git's own marks."""
    plain = ref.rlike(rf"\A[^{_BLANK}\x00-\x1F\x7F~^:?*\[\\]{{1,{REF_LENGTH}}}\z")
    edges = ref.rlike(r"\A[-/]") | ref.rlike(r"(?:/|\.|\.lock)\z")
    inner = ref.contains("..") | ref.contains("//") | ref.contains("@{")
    return F.coalesce(plain & ~edges & ~inner, F.lit(False))


def valid_owner(owner: Column) -> Column:
    return F.coalesce(owner.rlike(OWNER_PATTERN) & ~owner.endswith("-"), F.lit(False))


def valid_repo(repo: Column) -> Column:
    return F.coalesce(repo.rlike(REPO_PATTERN) & ~repo.isin(".", ".."), F.lit(False))


_HOST = r"(?i)\Agithub\.com[/:]"


def repo_target(text: Column) -> Column:
    """owner, repo and ref of a GitHub URL, ssh remote or owner/repo; null if it is none of these.

    Of a page within the repository only a tree or a blob names a ref: the one segment after it, as a branch with slashes can't be told from folders.
    """
    rest = F.regexp_replace(trimmed(text), r"(?i)\A(?:git@github\.com:)?(?:[a-z]+://)?(?:www\.)?", "")
    other = ~rest.rlike(_HOST) & rest.rlike(r"(?i)\A[a-z0-9.-]+\.[a-z]{2,}/")
    parts = F.filter(F.split(F.regexp_replace(rest, _HOST, ""), "/"), lambda x: x != "")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    repo = F.regexp_replace(part(2), r"(?i)\.git\z", "")
    ref = F.when(F.lower(part(3)).isin("tree", "blob"), part(4))
    fine = ~other & valid_owner(part(1)) & valid_repo(repo)
    return F.when(fine, F.struct(part(1).alias("owner"), repo.alias("repo"), ref.alias("ref")))


def explicit_remote(text: Column) -> Column:
    """Whether a text can only mean a remote: it has a scheme, the ssh form or GitHub's bare host."""
    return F.coalesce(trimmed(text).rlike(r"(?i)\A(?:[a-z][a-z0-9+.-]*://|git@github\.com:|(?:www\.)?github\.com[/:])"), F.lit(False))


def ref_slug(ref: Column) -> Column:
    """A file name for a ref: itself if all its characters are safe, else the safe ones with a digest that keeps different refs apart."""
    safe = F.regexp_replace(ref, r"[^A-Za-z0-9._-]+", "-")
    return F.when(safe == ref, ref).otherwise(F.concat(safe, F.lit("-"), F.substring(F.sha1(ref.cast("binary")), 1, 8)))


def clone_dir(root: str, owner: Column, repo: Column, ref: Column) -> Column:
    """Where a repository's clone lies; names differ in case only by spelling, and each ref has a folder of its own."""
    at = F.when(ref.isNull(), "").otherwise(F.concat(F.lit("@"), ref_slug(ref)))
    return F.concat(F.lit(f"{root.rstrip('/')}/repos/"), F.lower(owner), F.lit("/"), F.lower(repo), at)


def repo_slug(owner: Column, repo: Column) -> Column:
    return F.lower(F.concat_ws("__", owner, repo))


def ls_remote_head(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, r"(?m)^([0-9a-f]{40})\s+HEAD$", 1), F.lit(""))


def output_tail(data: Column, most: int) -> Column:
    """The last bytes of a binary."""
    return F.substring(data, F.greatest(F.length(data) - most + 1, F.lit(1)), F.lit(most))


def glob_regex(glob: str) -> str:
    """An anchored regular expression: * and ? stay within a path segment, ** crosses segments, a final /** also means the folder itself."""
    tail = "(?:/.*)?" if glob.endswith("/**") and len(glob) > 3 else ""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|.", glob[: -3 if tail else None], re.S)
    means = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(means.get(t, re.escape(t)) for t in tokens) + tail + "$"


def ignored(rel: Column, globs: list[str]) -> Column:
    """Whether a path, or its last segment, matches any of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | rel.rlike(glob_regex(g)) | F.substring_index(rel, "/", -1).rlike(glob_regex(g))
    return out
