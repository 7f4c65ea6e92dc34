"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask is laid at every position of a text; the words under its ones are
hashed, those under its zeros are ignored, so a seed survives substitutions at
ignored places. Seeds of the benchmark and of the documents are joined by hash.
Each hit gives an alignment (document position less item position), and the
texts are then compared word by word along it: a document is contaminated where
some `window` aligned words hold at least `share` equal ones.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Three masks of 10 words with 7 that count.
MASKS = ("1101110011", "1110010111", "1011011101")
#: With it, 13 words have a seed wherever up to two of them are substituted.
MORE = "0101110111"
WINDOW, SHARE = 13, 0.8
#: Items of fewer words are left out.
SHORTEST = 3
#: Seeds or items of up to so many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a seed: hash, item, place and what a row takes.
SEED_BYTES = 32


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; [] for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeded(df: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """(keys, at, h): the seeds of w at each place. All masks are equally long.

    Words are hashed first. A place is a row from then on, and its seeds are ordinary
    column expressions on the shared array of hashes, which are compiled into one loop;
    the same as a lambda over places takes three times as long.
    """
    span = len(masks[0])
    hashed = df.select(*keys, F.expr("transform(w, x -> xxhash64(x))").alias("g"))
    places = hashed.select(*keys, "g", F.explode(F.expr(f"CASE WHEN size(g) >= {span} THEN sequence(0, size(g) - {span}) ELSE array() END")).alias("at"))
    each = [f"xxhash64('{m}', {', '.join(f'g[at + {k}]' for k, c in enumerate(m) if c == '1')})" for m in masks]
    return places.select(*keys, "at", F.explode(F.expr(f"array({', '.join(each)})")).alias("h"))


def whole(n: int, share: float) -> tuple[str, ...]:
    """Masks over all of n words, one of which ignores every substituted word while `share` of n are equal.

    The words are cut into two blocks more than there may be substitutions, where there are
    that many, and each mask ignores as many blocks as there may be substitutions.
    """
    wrong = n - math.ceil(n * share - 1e-9)
    blocks = min(n, wrong + 2)
    return tuple("".join("0" if k * blocks // n in out else "1" for k in range(n)) for out in combinations(range(blocks), wrong))


def alignments(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = (*MASKS, MORE), window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(ik, rk, item, delta), distinct: where seeds of a document and of an item agree.

    docs: ik, rk, w; benchmark: item, w. An item of fewer words than `window` has seeds over
    the whole of it as well.
    """
    short = [r[0] for r in benchmark.select(F.size("w")).where(F.size("w") < window).distinct().collect()]  # a row a length
    groups = [(masks, benchmark), *((whole(n, share), benchmark.where(F.size("w") == n)) for n in sorted(short))]
    seeds = [_seeded(b, ["item"], m) for m, b in groups]
    places = [_seeded(docs, ["ik", "rk"], m) for m, _ in groups]
    items = stored(reduce(DataFrame.union, seeds).select("h", "item", F.col("at").alias("item_at")), "seeds")
    n = items.count()
    hits = reduce(DataFrame.union, places).join(F.broadcast(items) if n * SEED_BYTES <= BROADCAST_BYTES else items, "h")
    return hits.select("ik", "rk", "item", (F.col("at") - F.col("item_at")).alias("delta")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, masks: tuple[str, ...] = (*MASKS, MORE), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, rk, n_words, contaminated, n_items, items, best), a row for each row of docs.

    items: contained item ids, ascending, comma-joined; best: the most equal words in
    a window over its length (null without a contained item). An item of fewer words than
    `window` is compared as a whole, one shorter than SHORTEST never matches. Null and
    empty texts, on either side, match nothing; rows with null ids are judged like
    others, but a null item id is not named. Equal rows get equal results, equal items
    are all named, and ties between places make no difference. Very long texts are read
    whole.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("ik"), F.xxhash64(id_col, text_col).alias("rk"), words(F.col(text_col)).alias("w"))
    # Items with the same words stand for each other: only one of them is aligned.
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), words(F.col(item_text)).alias("w")).where(F.size("w") >= SHORTEST)
    items = items.groupBy("w").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.xxhash64("w").alias("item"), "ids", "w")
    items = stored(items, "items")
    found = stored(alignments(keyed, items, masks, window, share), "hits")
    weight = items.agg(F.sum(F.octet_length(F.array_join("w", " ")) + 16 * F.size("w") + 8 * F.size("ids") + 64)).first()[0] or 0
    pairs = found.join(F.broadcast(items) if weight <= BROADCAST_BYTES else items, "item")
    per = pairs.join(keyed.select("ik", "rk", F.col("w").alias("dw")).dropDuplicates(["ik", "rk"]), ["ik", "rk"])
    per = per.withColumn("lo", F.greatest(F.lit(0), -F.col("delta"))).withColumn("hi", F.expr("least(size(w), size(dw) - delta)"))
    # both texts are cut to the words that lie side by side
    per = per.select("ik", "rk", "ids", F.size("w").alias("n"), F.expr("slice(w, lo + 1, hi - lo)").alias("a"), F.expr("slice(dw, lo + delta + 1, hi - lo)").alias("b"))
    per = per.select("ik", "rk", "ids", "n", F.expr("zip_with(a, b, (x, y) -> IF(x = y, 1, 0))").alias("m"))
    per = per.withColumn("win", F.expr(f"least({window}, size(m))"))
    per = per.withColumn("top", F.expr("array_max(transform(sequence(1, size(m) - win + 1), k -> aggregate(slice(m, k, win), 0, (a, x) -> a + x)))"))
    least = F.when(F.col("win") >= window, F.lit(math.ceil(window * share - 1e-9))).otherwise(F.ceil(F.col("win") * share))
    # A stretch below the window's length counts only where it is all of the item.
    whole = (F.col("win") >= window) | (F.size("m") == F.col("n"))
    judged = per.select("ik", "rk", "ids", (F.col("top") / F.col("win")).alias("best"), (whole & (F.col("top") >= least)).alias("ok"))
    top = judged.groupBy("ik", "rk").agg(F.max(F.when(F.col("ok"), F.col("best"))).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("ok"), F.col("ids")))))).alias("ids"), F.max("ok").alias("contaminated"))
    out = keyed.select("doc_id", "ik", "rk", F.size("w").cast("long").alias("n_words")).join(top, ["ik", "rk"], "left")
    return out.select("doc_id", "rk", "n_words", F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("items"), F.round("best", 6).alias("best"))
