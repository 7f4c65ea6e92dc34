"""Three-way merge of structured records, field by field, and of append-only logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import quoted, stripped
from .graph import BLOCK, numbered
from .snapshots import three_beside

STRATEGIES = ("scalar", "set", "sequence", "timestamp")


@dataclass
class Policy:
    """How fields merge when both sides changed them differently; without a word on one, arrays are sets, the rest scalars."""

    fields: dict[str, str] = field(default_factory=dict)
    fallback: str | None = None

    def strategy(self, name: Column, ours: Column, theirs: Column) -> Column:
        sample = F.coalesce(F.nullif(ours, F.lit("null")), F.nullif(theirs, F.lit("null")))
        guess = F.lit(self.fallback) if self.fallback else F.when(sample.startswith("["), "set").otherwise("scalar")
        out = guess
        for f, s in self.fields.items():
            out = F.when(name == f, s).otherwise(out)
        return out


def members(value: Column) -> Column:
    """A canonical value's members as canonical texts: an array's own, a single value's one, none of an absent one.

    Texts keep their quotes, so that 1 and "1" stay different.
    """
    return F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), split_array(value)).otherwise(F.array(value))


def split_array(value: Column) -> Column:
    """Top-level members of a canonical JSON array, as they stand there.

    A comma or bracket counts only outside texts and inner containers; the members
    are found by one pass over the array's tokens with a running depth.
    """
    tokens = F.regexp_extract_all(F.substring(value, 2, F.length(value) - 2), F.lit(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|,|[^"\[\]{},]+'), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("depth"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)
        cut = (t == ",") & (acc["depth"] == 0)
        return F.struct(F.when(cut, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(cut, "").otherwise(F.concat(acc["now"], t)).alias("now"), depth.alias("depth"))

    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def union_members(base: Column, ours: Column, theirs: Column, ordered: bool | Column) -> Column:
    """Members of base that both keep, then what ours adds, then theirs, each once; a set is sorted by bytes."""
    kept = F.filter(base, lambda x: F.array_contains(ours, x) & F.array_contains(theirs, x))
    every = F.array_distinct(F.concat(kept, F.array_except(ours, base), F.array_except(theirs, base)))
    if isinstance(ordered, bool):
        return every if ordered else F.array_sort(every)
    return F.when(ordered, every).otherwise(F.array_sort(every))


def later(ours: Column, theirs: Column) -> Column:
    """The later of two canonical texts of ISO instants, the greater bytes of equal ones; null unless both are instants."""
    instant = lambda v: F.when(v.startswith('"'), F.try_to_timestamp(F.substring(v, 2, F.length(v) - 2)))
    a, b = instant(ours), instant(theirs)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("string")).when(a > b, ours).when(b > a, theirs).otherwise(F.greatest(ours, theirs))


def decide(b: Column, o: Column, t: Column, strategy: Column) -> Column:
    """struct(resolved, conflict, changed) of one field; null is an absent field."""
    oc, tc = ~o.eqNullSafe(b), ~t.eqNullSafe(b)
    both = oc & tc & ~o.eqNullSafe(t)
    union = union_members(members(b), members(o), members(t), strategy == "sequence")
    joined = F.concat(F.lit("["), F.array_join(union, ","), F.lit("]"))
    instant = later(o, t)
    resolved = F.when(~oc & ~tc, b).when(~tc, o).when(~oc, t).when(~both, o).when(strategy.isin("set", "sequence"), joined).when(strategy == "timestamp", F.coalesce(instant, o)).otherwise(o)
    conflict = both & ((strategy == "scalar") | ((strategy == "timestamp") & instant.isNull()))
    return F.struct(resolved.alias("resolved"), conflict.alias("conflict"), (~resolved.eqNullSafe(b)).alias("changed"))


def merge_fields(base: DataFrame, ours: DataFrame, theirs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(record_id, field, base, ours, theirs, resolved, conflict, changed) over fields (record_id, field, value).

    Values are canonical JSON texts. A null resolved field is removed. On a conflict
    ours stays.
    """
    policy = policy or Policy()
    side = three_beside(base, ours, theirs, ["record_id", "field"], ["value"])
    flat = side.select("record_id", "field", F.col("b.value").alias("base"), F.col("o.value").alias("ours"), F.col("t.value").alias("theirs"))
    judged = flat.withColumn("d", decide(F.col("base"), F.col("ours"), F.col("theirs"), policy.strategy(F.col("field"), F.col("ours"), F.col("theirs"))))
    return judged.select("record_id", "field", "base", "ours", "theirs", "d.resolved", "d.conflict", "d.changed")


def merged_records(fields_: DataFrame) -> DataFrame:
    """(record_id, document, conflicts, changed_fields, clean) from merge_fields' rows."""
    pair = F.concat(quoted(F.col("field")), F.lit(":"), F.col("resolved"))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("resolved").isNotNull(), F.struct("field", pair.alias("p"))))), lambda x: x["p"])
    names = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("field"))))
    return fields_.groupBy("record_id").agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("document"), names("conflict").alias("conflicts"), names("changed").alias("changed_fields"), (~F.max("conflict")).alias("clean"))


def totals(fields_: DataFrame) -> DataFrame:
    """One row: fields, conflicts, changed and removed."""
    return fields_.agg(F.count("*").alias("fields"), F.count_if("conflict").alias("conflicts"), F.count_if("changed").alias("changed"), F.count_if(F.col("changed") & F.col("resolved").isNull()).alias("removed"))


def merge_log(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, seq, line): the union of append-only logs (key, pos, line), each line as often as the side that has it most.

    Lines lose the white space at their ends, blank ones go. They come in the order base,
    ours, theirs; the first arrivals of a line stay. They are sorted by time text, then
    arrival; a line without a text `at` has the time of the last line before it, at first
    the empty text. The key names the log. Arrivals are numbered over all logs and
    worked on in blocks, so neither a long log nor a frequent line is one group of rows.
    """
    key = key or []
    sides = [d.select(*key, F.lit(i).alias("side"), "pos", stripped(F.col("line")).alias("line")).where("line <> ''") for i, d in enumerate((base, ours, theirs))]
    every = numbered(sides[0].unionByName(sides[1]).unionByName(sides[2]), [*key, "side", "pos", "line"], "arrival").withColumn("block", F.floor(F.col("arrival") / BLOCK))
    most = every.groupBy(*key, "line", "side").agg(F.count("*").alias("n")).groupBy(*key, "line").agg(F.max("n").alias("most"))
    earlier = lambda *by: Window.partitionBy(*key, *by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = every.groupBy(*key, "line", "block").agg(F.count("*").alias("n")).select(*key, "line", "block", F.coalesce(F.sum("n").over(earlier("line")), F.lit(0)).alias("before"))
    here = Window.partitionBy(*key, "line", "block").orderBy("arrival")
    kept = every.withColumn("rn", F.row_number().over(here)).join(counts, [*key, "line", "block"]).join(most, [*key, "line"]).where("rn + before <= most")
    at = F.when(F.expr("schema_of_variant(variant_get(try_parse_json(line), '$.at', 'variant')) = 'STRING'"), F.get_json_object("line", "$.at"))
    kept = kept.select(*key, "side", "pos", "line", "arrival", "block", at.alias("own"))
    last = kept.groupBy(*key, "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("arrival"))).alias("last"))
    carried = last.select(*key, "block", F.last("last", ignorenulls=True).over(earlier()).alias("carry"))
    inside = Window.partitionBy(*key, "block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    timed = kept.withColumn("at", F.last("own", ignorenulls=True).over(inside)).join(carried, [*key, "block"])
    timed = timed.select(*key, F.coalesce("at", "carry", F.lit("")).alias("at"), "arrival", "line")
    placed = numbered(timed, [*key, "at", "arrival"], "place")
    if not key:
        return placed.select((F.col("place") + 1).cast("int").alias("seq"), "line")
    first = placed.groupBy(*key).agg(F.min("place").alias("first"))
    return placed.join(first, key).select(*key, (F.col("place") - F.col("first") + 1).cast("int").alias("seq"), "line")


def shown(record_fields: DataFrame) -> DataFrame:
    """(record_id, text): a record with a field a line, sorted, for diffs; never hashed."""
    line = F.struct("field", F.concat(quoted(F.col("field")), F.lit(": "), "value").alias("t"))
    g = record_fields.groupBy("record_id").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return g.select("record_id", F.concat(F.array_join(F.transform("x", lambda s: s["t"]), "\n"), F.lit("\n")).alias("text"))
