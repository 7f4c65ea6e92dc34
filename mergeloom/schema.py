"""Schemas of the tables that the engine works on.

Absent is not null: a field that a record lacks is an SQL null, and a null value
is the canonical text 'null'. Ids and texts order by UTF-8 bytes, which is how
Spark orders strings.
"""

from __future__ import annotations

SIGNATURE = "struct<name:string,email:string,ts_ms:bigint,tz_min:int>"
OBJECTS = "id string, type string, payload binary, size bigint"
TREE_ENTRIES = "tree_id string, name string, mode string, id string, file_id string, copied_from string"
SNAPSHOT = "path string, id string, mode string, file_id string, copied_from string"
COMMITS = f"id string, tree string, change_id string, items array<string>, parents array<string>, author {SIGNATURE}, committer {SIGNATURE}, message string"
EDGES = "child string, parent string, ordinal int"
RECORD_FIELDS = "record_id string, field string, value string"
REFS = "name string, target string"
OPLOG = "sequence bigint, command string, at string, summary string, refs array<struct<ref:string,before:string,after:string>>"
INDEX = "path string, id string, mode string, file_id string, copied_from string, stat struct<size:bigint,mtime_ns:bigint,ctime_ns:bigint,dev:bigint,ino:bigint,observed_ns:bigint>"
BUNDLE_LINE = "id string, type string, payload binary"
PATH_CHANGES = "sha string, seq int, status string, path string"

FILE, EXECUTABLE, DIRECTORY = "100644", "100755", "40000"
KINDS = ("blob", "tree", "commit", "record")
