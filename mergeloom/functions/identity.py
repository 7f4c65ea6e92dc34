"""Content identity: framed hashes, encodings of trees, commits and signatures, id predicates."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT_ID, FILE_ID = r"^[0-9a-f]{64}\z", r"^[0-9a-f]{32}\z"


def frame(kind: Column, payload: Column) -> Column:
    """The bytes that are hashed: kind, blank, byte length, NUL, payload."""
    raw = payload.cast("binary")
    return F.concat(F.concat(kind, F.lit(" "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw)


def object_id(kind: Column, payload: Column) -> Column:
    """64 lower-case hex digits of the framed payload's SHA-256."""
    return F.sha2(frame(kind, payload), 256)


def unframed(framed: Column) -> Column:
    """struct(kind, payload) of a frame; null where kind or length don't hold."""
    cut = F.instr(F.hex(framed), F.lit("00"))
    # hex digits come in pairs: only a pair that starts at an odd place is a byte
    head = F.substring_index(F.decode(framed, "ISO-8859-1"), "\u0000", 1)
    kind, size = F.substring_index(head, " ", 1), F.substring_index(head, " ", -1)
    payload = F.substring(framed, F.length(head) + 2, F.octet_length(framed))
    sound = (cut > 0) & head.rlike(r"^(blob|tree|commit|record) (0|[1-9][0-9]*)\z") & (size.try_cast("bigint") == F.octet_length(payload))
    return F.when(sound, F.struct(kind.alias("kind"), payload.alias("payload")))


def is_object_id(c: Column) -> Column:
    return F.coalesce(c.rlike(OBJECT_ID), F.lit(False))


def is_file_id(c: Column) -> Column:
    return F.coalesce(c.rlike(FILE_ID), F.lit(False))


def derived_file_id(label: str, *parts: Column) -> Column:
    """A reproducible 32-digit id from a label and parts, NUL between them."""
    return F.substring(F.sha2(F.concat_ws("\u0000", F.lit(label), *parts), 256), 1, 32)


def effective_change_id(change_id: Column, commit_id: Column) -> Column:
    return F.coalesce(change_id, commit_id)


def signature_text(s: Column) -> Column:
    """Name <email> milliseconds minutes."""
    return F.format_string("%s <%s> %d %d", s["name"], s["email"], s["ts_ms"], s["tz_min"])


def parsed_signature(text: Column) -> Column:
    """struct(name, email, ts_ms, tz_min); null where the line is none."""
    p = r"^(.*) <([^<>]*)> (-?\d+) (-?\d+)$"
    part = lambda i: F.regexp_extract(text, p, i)
    return F.when(text.rlike(p), F.struct(part(1).alias("name"), part(2).alias("email"), part(3).cast("bigint").alias("ts_ms"), part(4).cast("int").alias("tz_min")))


def commit_text(tree: Column, change_id: Column, items: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    """A commit's header lines, a blank line and its message; items sorted, each once."""
    each = lambda word, a: F.transform(a, lambda x: F.concat(F.lit(word + " "), x))
    none = F.array().cast("array<string>")
    head = F.concat(
        F.array(F.concat(F.lit("tree "), tree)),
        F.when(change_id.isNotNull(), F.array(F.concat(F.lit("change "), change_id))).otherwise(none),
        each("item", F.array_sort(F.array_distinct(F.coalesce(items, none)))),
        each("parent", F.coalesce(parents, none)),
        F.array(F.concat(F.lit("author "), signature_text(author)), F.concat(F.lit("committer "), signature_text(committer))),
    )
    return F.concat(F.array_join(head, "\n"), F.lit("\n\n"), message)


def commit_id(*args: Column) -> Column:
    return object_id(F.lit("commit"), commit_text(*args))


def identity_without_change(tree: Column, items: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    """The id that a commit would have without a change line: a new commit's change id."""
    return commit_id(tree, F.lit(None).cast("string"), items, parents, author, committer, message)


def parsed_commit(text: Column) -> Column:
    """struct(tree, change_id, items, parents, author, committer, message) of a commit's text."""
    head = F.split(F.substring_index(text, "\n\n", 1), "\n")
    values = lambda word: F.transform(F.filter(head, lambda x: x.startswith(word + " ")), lambda x: F.substring(x, len(word) + 2, F.length(x)))
    return F.struct(
        F.get(values("tree"), F.lit(0)).alias("tree"),
        F.get(values("change"), F.lit(0)).alias("change_id"),
        values("item").alias("items"),
        values("parent").alias("parents"),
        parsed_signature(F.get(values("author"), F.lit(0))).alias("author"),
        parsed_signature(F.get(values("committer"), F.lit(0))).alias("committer"),
        F.substring(text, F.instr(text, F.lit("\n\n")) + 2, F.length(text)).alias("message"),
    )


class BadTree(ValueError):
    """Entries that no tree can hold, or bytes that are none."""


def checked_entries(entries: list[dict]) -> list[dict]:
    """entries by name, after the checks that every tree passes."""
    names = [e["name"] for e in entries]
    for e in entries:
        name, file_id, origin = e["name"], e.get("file_id"), e.get("copied_from")
        if not name or "/" in name or "\0" in name:
            raise BadTree(f"bad name {name!r}")
        if e["mode"] == "40000":
            if file_id or origin:
                raise BadTree(f"directory {name!r} with an identity")
        elif any(x is not None and not re.fullmatch("[0-9a-f]{32}", x) for x in (file_id, origin)) or (origin and origin in (file_id, None)) or (origin and not file_id):
            raise BadTree(f"bad identity of {name!r}")
    if len(set(names)) < len(names):
        raise BadTree("a name twice")
    return sorted(entries, key=lambda e: e["name"].encode())


def tree_bytes(entries: list[dict], header: str) -> bytes:
    """A tree's payload: binary entries without file identities, else header and JSON lines."""
    entries = checked_entries(entries)
    if not any(e.get("file_id") or e.get("copied_from") for e in entries):
        return b"".join(f"{e['mode']} {e['name']}\0{e['id']}".encode() for e in entries)
    lines = [json.dumps([e["mode"], e["id"], e.get("file_id"), e.get("copied_from"), e["name"]], ensure_ascii=False, separators=(",", ":")) for e in entries]
    return (header + "\n" + "\n".join(lines)).encode()


def tree_entries(payload: bytes, header: str) -> list[dict]:
    """The entries of a tree's payload, in either form."""
    out = []
    mark = (header + "\n").encode()
    if payload.startswith(mark):
        for line in payload[len(mark) :].decode().split("\n"):
            mode, oid, file_id, origin, name = json.loads(line)
            out.append({"name": name, "mode": mode, "id": oid, "file_id": file_id, "copied_from": origin})
    else:
        at = 0
        while at < len(payload):
            m = re.compile(rb"(100644|100755|40000) ([^\0]*)\0([0-9a-f]{64})").match(payload, at)
            if not m:
                raise BadTree("bytes that are no entry")
            out.append({"name": m[2].decode(), "mode": m[1].decode(), "id": m[3].decode(), "file_id": None, "copied_from": None})
            at = m.end()
    if checked_entries(out) != out:
        raise BadTree("entries out of order")
    return out
