"""Line dedup by overlapping three-line windows.

A line ends at a line feed; a line over `WRAP` words also ends after each word that is the least of its neighbours (`REACH` on
both sides, in byte order), so that cuts move with a passage and it has windows wherever it stands in a line. Every three
consecutive lines are one window, known by 128 hash bits. The first place of a window over all documents stays, in order of
doc_id and place; later ones are covered, and covered lines go. DataFrame functions only.

Windows are dealt out once, by their hash. So that a window which a third of all documents share doesn't meet in one task, the
commonest windows of a sample are dealt out by document too and their firsts compared once more; the sample only decides who
meets where, never the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRAP, REACH, WINDOW = 16, 3, 3
#: A document in so many is looked at for common windows; so many of them are dealt out in so many parts.
SAMPLE, COMMON, PARTS = 64, 1000, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(w: Column, wrap: int) -> Column:
    """Where the lines begin that a line of words w is cut into: after each least word, and after `wrap` words that hold none. The
    words within REACH of the line's ends aren't least."""

    def least(x: Column, i: Column) -> Column:
        near = [c for k in range(1, REACH + 1) for c in (x <= F.get(w, i + k), x < F.get(w, i - k))]
        return reduce(and_, near)  # most words fail at the first; past an end it is null

    marks = F.transform(w, lambda x, i: F.when(least(x, i), i + 1).otherwise(0))
    ends = F.array_append(F.array_remove(marks, 0), F.size(w))
    return let(ends, lambda e: F.flatten(F.transform(e, lambda x, k: F.sequence(F.coalesce(F.get(e, k - 1), F.lit(0)), x - 1, F.lit(wrap)))))


def lines_of(text: Column, wrap: int = WRAP, bare: bool = False) -> Column:
    """The lines, each with what ends it: joined they are the text. bare: without that and without spaces before it."""

    def cut(w: Column, end: Column) -> Column:
        def line(s: Column, x: Column, k: Column) -> Column:
            after = F.get(s, k + 1)
            own = F.array_join(F.slice(w, x + 1, F.coalesce(after, F.size(w)) - x), " ")
            return F.rtrim(own) if bare else F.concat(own, F.when(after.isNotNull(), " ").otherwise(end))

        return let(starts(w, wrap), lambda s: F.transform(s, lambda x, k: line(s, x, k)))

    def each(parts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            end = F.when(i + 1 < F.size(parts), "\n").otherwise("")
            return let(F.split(x, " "), lambda w: F.when(F.size(w) > wrap, cut(w, end)).otherwise(F.array(F.rtrim(x) if bare else F.concat(x, end))))

        whole = F.slice(parts, F.lit(1), F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))
        return F.flatten(F.transform(whole, one))

    return let(F.split(text, "\n"), each)


def windows(rows: DataFrame, wrap: int = WRAP) -> DataFrame:
    """doc_id, row, at, h1, h2 for rows (doc_id, row, text): a row for each window that isn't blank, known by its middle line,
    and one at -1 - n for a document of n lines. Hashed before they are rows, so that no line is copied for each."""

    def window(l: Column, at: Column) -> Column:
        three = [F.get(l, at + (k - 1)) for k in range(WINDOW)]
        return F.struct(at.alias("at"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(1), *three).alias("h2"), reduce(or_, [x != "" for x in three]).alias("some"))

    def each(l: Column) -> Column:
        size = F.array(F.struct((-1 - F.size(l)).alias("at"), F.col("row").alias("h1"), F.xxhash64("doc_id").alias("h2"), F.lit(True).alias("some")))
        return F.when(F.size(l) >= WINDOW, F.concat(size, F.transform(F.sequence(F.lit(1), F.size(l) - (WINDOW - 1)), lambda at: window(l, at)))).otherwise(size)

    bare = lines_of(F.coalesce("text", F.lit("")), wrap, bare=True)
    # outer, as for an inner one the optimizer works the array out once more to filter by its size
    return rows.select("doc_id", "row", F.inline_outer(let(bare, each))).where("some").drop("some")


def later_places(own: DataFrame, common: DataFrame) -> DataFrame:
    """Of windows (doc_id, row, at, h1, h2) those that stand at an earlier place too, and the rows with at < 0; common (h1, h2): a
    short list, broadcast, of those to be dealt out in parts."""
    part = F.when(F.col("often"), F.pmod("row", F.lit(PARTS)) + 1).otherwise(0)
    dealt = own.join(F.broadcast(common.withColumn("often", F.lit(True))), ["h1", "h2"], "left").withColumn("part", part).drop("often")
    place = ["doc_id", "row", "at"]
    # rank, not row_number: equal places are those of repeated rows
    ranked = dealt.withColumn("nth", F.rank().over(Window.partitionBy("h1", "h2", "part").orderBy(*place)))
    ranked = ranked.where("nth > 1 or part > 0 or at < 0")
    # the firsts of the parts meet by the window, all others stay by themselves
    alone = (F.col("nth") > 1) | (F.col("part") == 0)
    keys = ranked.withColumn("k1", F.when(alone, F.col("row")).otherwise(F.col("h1"))).withColumn("k2", F.when(alone, F.col("at")).otherwise(F.col("h2")))
    again = keys.withColumn("nth2", F.rank().over(Window.partitionBy("k1", "k2").orderBy(*place)))
    return again.where("nth > 1 or nth2 > 1 or at < 0").select("doc_id", "row", "at")


def dedup_lines(docs: DataFrame, wrap: int = WRAP) -> DataFrame:
    """docs with the covered lines out of `text`, n_lines (long), how many lines it had, and n_removed (long), how many went.

    A row is known by its doc_id and text: of rows that repeat both, each loses only what the first place elsewhere covers,
    so repeated rows stay alike. A null doc_id comes before all others. A null or empty text stays as it is, without lines;
    a document whose lines all go keeps an empty text. Blank windows cover nothing. A text of any length is one row's work.
    All other columns stay, whatever their names; earlier n_lines and n_removed are replaced.
    """
    rows = docs.select(F.struct(*docs.columns).alias("d"), "doc_id", F.xxhash64("doc_id", "text", F.lit(7)).alias("row"))
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(7)).alias("row"))
    some = windows(texts.where(F.pmod("row", F.lit(SAMPLE)) == 0), wrap).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    common = some.orderBy(F.desc("n"), "h1", "h2").limit(COMMON).select("h1", "h2")
    found = later_places(windows(texts, wrap), common).groupBy("doc_id", "row")
    found = found.agg(F.collect_set(F.when(F.col("at") > 0, F.col("at"))).alias("at"), (-1 - F.min("at")).alias("n_lines"))
    # which lines go is worked out before the join, so that the lambda below only looks it up
    each = F.flatten(F.transform("at", lambda s: F.sequence(s - 1, s + (WINDOW - 2))))
    found = found.select(F.col("doc_id").alias("id"), F.col("row").alias("key"), "n_lines", F.array_distinct(each).alias("gone"))
    joined = rows.join(found, (F.col("row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    left = F.array_join(F.filter(lines_of(F.col("d.text"), wrap), lambda x, i: ~F.array_contains("gone", i)), "")
    text = F.when(F.size("gone") == 0, F.col("d.text")).otherwise(left)
    made = {"text": text, "n_lines": F.col("n_lines").cast("long"), "n_removed": F.size("gone").cast("long")}
    joined = joined.select("d", F.struct(*[c.alias(name) for name, c in made.items()]).alias("made"))
    return joined.select(*[F.col("d")[c].alias(c) for c in docs.columns if c not in made], "made.*")
