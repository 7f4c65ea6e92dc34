"""HEAD, refs and remotes as tables and small values."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ref_name_ok, remote_name_ok


class BadHead(ValueError):
    """A HEAD that names neither a ref nor an object."""


class BadRemote(ValueError):
    """Remotes of the wrong shape, or a name that can't be used."""


@dataclass
class Head:
    """ref: the branch that HEAD follows, null where it is detached; target: the commit, null for a branch without one."""

    ref: str | None
    target: str | None


def _passes(spark, check, name: str) -> bool:
    return bool(spark.range(1).select(check(F.lit(name)).alias("x")).first().x)


def read_head(raw: str | None, refs: DataFrame) -> Head:
    """HEAD from its file's text and the refs (name, target)."""
    text = (raw or "").strip()
    if text.startswith("ref: "):
        ref = text[5:].strip()
        if not _passes(refs.sparkSession, ref_name_ok, ref):
            raise BadHead(f"bad ref name {ref!r}")
        row = refs.where(F.col("name") == ref).first()
        return Head(ref, row.target if row else None)
    if len(text) != 64 or not set(text) <= set("0123456789abcdef"):
        raise BadHead("HEAD is missing" if not text else f"HEAD holds {text!r}")
    return Head(None, text)


def head_text(head: Head) -> str:
    """The text that read_head reads back."""
    if head.ref is None and head.target is None:
        raise BadHead("a detached HEAD needs a commit")
    return f"ref: {head.ref}" if head.ref else head.target


def advanced(head: Head, refs: DataFrame, target: str) -> tuple[Head, DataFrame]:
    """HEAD and refs once HEAD's branch, or a detached HEAD itself, is at target."""
    if head.ref is None:
        return replace(head, target=target), refs
    new = refs.sparkSession.createDataFrame([(head.ref, target)], "name string, target string")
    return replace(head, target=target), refs.select("name", "target").where(F.col("name") != head.ref).union(new)


def with_prefix(refs: DataFrame, prefix: str) -> DataFrame:
    """Refs below a prefix, by name."""
    return refs.where(F.col("name").startswith(prefix)).orderBy("name")


@dataclass
class Remotes:
    """Names with urls."""

    urls: dict[str, str]

    @classmethod
    def parse(cls, text: str | None) -> Remotes:
        try:
            got = json.loads(text) if text else {}
        except ValueError as e:
            raise BadRemote("no JSON") from e
        if not isinstance(got, dict) or not all(isinstance(v, str) for v in got.values()):
            raise BadRemote("remotes must be an object of texts")
        return cls(dict(got))

    def text(self) -> str:
        return json.dumps(dict(sorted(self.urls.items(), key=lambda kv: kv[0].encode())), indent=2) + "\n"

    def require(self, name: str) -> str:
        if name not in self.urls:
            raise BadRemote(f"no remote {name!r}")
        return self.urls[name]

    def add(self, spark, name: str, url: str) -> Remotes:
        if not _passes(spark, remote_name_ok, name):
            raise BadRemote(f"bad remote name {name!r}")
        if name in self.urls:
            raise BadRemote(f"there is a remote {name!r}")
        if not url:
            raise BadRemote("a remote needs a url")
        return Remotes({**self.urls, name: url})

    def remove(self, name: str) -> Remotes:
        self.require(name)
        return Remotes({k: v for k, v in self.urls.items() if k != name})
