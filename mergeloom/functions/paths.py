"""Globs, ignore rules and other predicates on paths and names, as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are never tracked, whatever the rules say.
NEVER_TRACKED = (".git", ".hg", ".svn", ".bzr", "_darcs", "CVS", "node_modules")
#: Words that carry no content of a description.
FILLER = tuple(
    """a an the of for to from in on at by with and or is are was be been this that these those
    it its as get gets set sets return returns returned value values given used use uses when if
    then into via per not may can will has have had does do making make called call calls whether
    while which what where how why both each all any some no nor none either neither also always
    never often usually typically generally respectively eg ie""".split()
)

_PARTS = re.compile(r"\*\*/?|\*|\?|[^*?]+")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression.

    ** is anything within a line, with a slash right after it taken in; * and ? stay
    within a segment.
    """
    line = r"[^\n\r\u2028\u2029]*"
    special = {"**": line, "**/": line, "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(special.get(p) or re.sub(r"([\\.\[\](){}^$|+\-])", r"\\\1", p) for p in _PARTS.findall(pattern)) + r"\z"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [matches_glob(path, p) for p in patterns], F.lit(False))


@dataclass
class IgnoreRules:
    patterns: list[str] = field(default_factory=list)
    negations: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> IgnoreRules:
        """A rule a line; # starts a comment, ! a negation. A final slash means all below it; no slash, any depth."""
        rules = cls()
        for line in map(str.strip, text.split("\n")):
            rule = line.removeprefix("!")
            if not rule or line.startswith("#"):
                continue
            glob = f"{rule}**" if rule.endswith("/") else rule if "/" in rule else f"**/{rule}"
            (rules.negations if line.startswith("!") else rules.patterns).append(glob.removeprefix("./"))
        return rules


def ignored(path: Column, rules: IgnoreRules) -> Column:
    """Never-tracked names first, then patterns, and any negation takes a path back."""
    fixed = reduce(Column.__or__, [(path == n) | path.startswith(n + "/") | path.contains(f"/{n}/") for n in NEVER_TRACKED])
    return fixed | (matches_any(path, rules.patterns) & ~matches_any(path, rules.negations))


def canonical_path(path: Column) -> Column:
    """No empty, '.' or '..' segment, no NUL, and so no slash at its start."""
    return ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")) & ~path.contains("\u0000")


def excluded(path: Column, entries: list[str]) -> Column:
    """Equal to an entry, or below one that ends with a slash."""
    return reduce(Column.__or__, [path.startswith(e) if e.endswith("/") else path == e for e in entries], F.lit(False))


def ref_name_ok(name: Column) -> Column:
    """No empty, '.', '..' or .lock segment and none of the reserved characters."""
    segments = F.forall(F.split(name, "/"), lambda s: ~s.isin("", ".", "..") & ~s.endswith(".lock"))
    return segments & ~name.rlike(r"[\x00-\x20\x7f~^:?*\[\]\\]")


def remote_name_ok(name: Column) -> Column:
    """A single segment, not '.' or '..', with none of the characters that refs reserve."""
    return F.coalesce(~name.isin("", ".", "..") & ~name.rlike(r"[/\\]") & ~name.rlike(r"[\x00-\x20\x7f~^:?*\[\]]"), F.lit(False))


def prunable(name: Column) -> Column:
    """A folder that a walk need not enter: its name is never tracked, and no rule takes it back."""
    return name.isin(*NEVER_TRACKED)


def normal_path(path: Column) -> Column:
    """path below the root, without '.', '..' and empty segments; null where it leaves the root, is the root or has a NUL."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        up, none = s == "..", s.isin("", ".")
        size = F.size(acc["parts"])
        parts = F.when(none, acc["parts"]).when(up, F.slice(acc["parts"], F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(F.concat(acc["parts"], F.array(s)))
        return F.struct(parts.alias("parts"), (acc["out"] | (up & (size == 0))).alias("out"))

    got = F.aggregate(F.split(path, "/"), start, step)
    bad = path.startswith("/") | path.contains("\u0000") | got["out"] | (F.size(got["parts"]) == 0)
    return F.when(~bad, F.array_join(got["parts"], "/"))


def telling_words(text: Column) -> Column:
    """Lower-case words of a name or sentence that carry content, camel case split."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*FILLER))


def adds_information(text: Column, name: Column, least_words: int = 4, least_new: int = 2) -> Column:
    """text has enough words, and enough that name doesn't have."""
    words = telling_words(text)
    return (F.size(words) >= least_words) & (F.size(F.array_except(words, telling_words(name))) >= least_new)


def tracking_ref(remote: Column, ref: Column) -> Column:
    """Where a remote's branch is kept locally; other refs keep their name."""
    return F.when(ref.startswith("refs/heads/"), F.concat(F.lit("refs/remotes/"), remote, F.lit("/"), F.substring(ref, 12, F.length(ref)))).otherwise(ref)


def local_name(remote: Column, ref: Column) -> Column:
    """Where a fetched ref is kept: a branch as the remote's, a tag as it is; null for refs that aren't fetched."""
    return F.when(ref.startswith("refs/heads/") | ref.startswith("refs/tags/"), tracking_ref(remote, ref))


def below(path: Column, prefix: str) -> Column:
    """path is prefix or lies below it; an empty prefix holds all."""
    return (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)


def base_id(path: Column) -> Column:
    """The last segment without its last extension; null where that is empty."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit(""))


def document_id(path: Column, prefix: str, extension: str = ".toon") -> Column:
    """The id of an item document, which lies one folder below prefix, but not in history; null for other paths."""
    inner = F.split(F.substring(path, len(prefix) + 2, F.length(path)) if prefix else path, "/")
    stem = F.get(inner, F.lit(1))
    fits = path.endswith(extension) & (F.size(inner) == 2) & (F.get(inner, F.lit(0)) != "history")
    return F.when(fits, F.nullif(F.substring(stem, F.lit(1), F.length(stem) - len(extension)), F.lit("")))
