"""What the repeat removers share: first occurrences, and texts without spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, let, spread_join


def candidates(occurrences: DataFrame, total: int) -> DataFrame:
    """Occurrences (digest, ...) whose digest occurs more than once. ``occurrences`` is a written table."""
    counts = materialize(occurrences.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    return spread_join(occurrences, counts, "digest", "n", total)


def first_kept(rows: DataFrame, total: int, same: bool = False) -> DataFrame:
    """The rows (_id, _hash, start, stop, digest, ...) of a written table that have an earlier one and don't overlap it.

    With ``same``, rows are equal only if they hold the same bytes, in a column ``body``: different bodies
    under one digest have a first occurrence each.
    """
    place = F.struct("_id", "_hash", "start")
    found = None
    if same:
        odd = materialize(rows.select("digest", "body").distinct().groupBy("digest").count().filter("count > 1").select("digest"), "shared-digests")
        if odd.count():
            of_odd = materialize(rows.join(odd, "digest"), "shared-digest-rows")
            firsts = of_odd.groupBy("digest", "body").agg(F.min(place).alias("first"))
            found = of_odd.join(firsts, ["digest", "body"]).drop("body")
            rows = rows.join(odd, "digest", "left_anti")
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    plain = spread_join(rows.drop("body"), materialize(first, "firsts"), "digest", "n", total)
    found = plain if found is None else plain.unionByName(found)
    own = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_hash") == F.col("first._hash")) & (F.col("start") < F.col("first.start") + F.col("stop") - F.col("start"))
    return found.filter((place > F.col("first")) & ~own)


def later(occurrences: DataFrame, total: int, same: bool = False) -> DataFrame:
    """Occurrences (_id, _hash, start, stop, digest, ...) whose digest has an earlier one.

    Earlier is by (_id, _hash, start), nulls first; rows that are equal in all three are one occurrence and
    share its fate. ``same`` as in first_kept. ``occurrences`` is a written table.
    """
    return first_kept(materialize(candidates(occurrences, total), "candidates"), total, same)


def runs(spans: DataFrame, least: int = 0) -> DataFrame:
    """(_id, _hash, spans): neighbouring and overlapping spans united, those of at least so many bytes, in order; and where the bytes first occur."""
    once = spans.groupBy("_id", "_hash", "start", "stop").agg(F.min("first._id").alias("source"))
    order = Window.partitionBy("_id", "_hash").orderBy("start")
    begins = once.withColumn("new", F.when(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start"), 0).otherwise(1))
    numbered = begins.withColumn("run", F.sum("new").over(order))
    united = numbered.groupBy("_id", "_hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("source").alias("source"))
    long_enough = united.filter(F.col("stop") - F.col("start") >= least)
    return long_enough.groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "source"))).alias("spans"))


def cut(docs: DataFrame, removed: DataFrame, id_col: str, text_col: str, changed_only: bool = False) -> DataFrame:
    """The documents without their removed spans (byte offsets); all other columns stay.

    With ``changed_only``: just (id, text, spans, first_ids) of the documents that lose something.
    """
    h, s = free_name(docs, "_hash"), free_name(docs, "_spans")
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    i, c = free_name(docs, "_cut_id"), free_name(docs, "_cut_hash")
    spans = removed.select(F.col("_id").alias(i), F.col("_hash").alias(c), F.col("spans").alias(s))
    both = keyed.join(spans, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(c)), "inner" if changed_only else "left")

    def rest(b):
        def parts(x):
            begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x, i - 1)["stop"])
            end = lambda i: F.coalesce(F.get(x, i)["start"], F.octet_length(b))
            piece = lambda i: F.substring(b, begin(i) + 1, end(i) - begin(i)).cast("string")
            return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x)), piece), "")
        return let(F.col(s), parts)

    text = F.when(F.col(s).isNull(), F.col(text_col)).otherwise(let(F.encode(F.col(text_col), "utf-8"), rest))
    if changed_only:
        spans_only = F.transform(F.col(s), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
        return both.select(F.col(id_col), text.alias("text"), spans_only.alias("spans"), F.array_distinct(F.transform(F.col(s), lambda x: x["source"])).alias("first_ids"))
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
