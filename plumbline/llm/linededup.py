"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A gram is the least run of lines, from a given line on, with ``GRAM`` words. Of each ``WINDOW`` neighbouring grams the
least hash is a fingerprint, and so is each line that is a gram by itself; hence every repeated run of 2 * GRAM words
or more holds one. Texts that hold a repeated fingerprint are compared whole, by the least runs of ``GRAM`` words from
each of their lines on and back from each: a run's later places, by (doc_id, copy, line), are deleted. Such runs cover any
repeated run of GRAM words or more, whichever text it repeats and whatever else its lines repeat, without aligning texts.
A deleted line equals an earlier one, and the first occurrence of a line always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free, table

GRAM, WINDOW = 25, 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, at, words, hash): arrays over the lines with words of each distinct (doc_id, text).

    ``at`` are their numbers in the text, ``words`` their numbers of words and ``hash`` their hashes.
    """
    count = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))
    each = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("at"), count(x).alias("words"), F.xxhash64(x).alias("hash")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), each.alias("each"))
    full = rows.withColumn("each", F.filter("each", lambda x: x["words"] > 0)).where(F.size("each") > 0)
    return full.select("doc_id", "copy", "each.at", "each.words", "each.hash")


def fingerprints(lines: DataFrame) -> DataFrame:
    """(doc_id, copy, line, size, gram): the chosen grams, where they begin among lines with words, and their lines."""
    n = F.size("words")
    # how many lines from line i on have GRAM words; 0 if the text ends before
    reach = lambda i: F.aggregate(
        F.slice("words", i + 1, GRAM),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("count")),
        lambda a, w: F.when(a["sum"] >= GRAM, a).otherwise(
            F.struct((a["sum"] + w).alias("sum"), (a["count"] + 1).alias("count"))
        ),
        lambda a: F.when(a["sum"] >= GRAM, a["count"]).otherwise(0),
    )
    sizes = lines.withColumn("reach", F.transform(F.sequence(F.lit(0), n - 1), reach))
    gram = lambda k, i: F.when(k > 0, F.xxhash64(F.slice("hash", i + 1, k)))
    grams = sizes.withColumn("gram", F.transform("reach", gram))
    # the last of the least hashes of each window; a window at an end has fewer grams
    far = F.lit((1 << 63) - 1)
    at = lambda i: F.coalesce(F.get("gram", i), far)

    def least(first: Column) -> Column:
        best = first
        for k in range(1, WINDOW):
            best = F.when(at(first + k) <= at(best), first + k).otherwise(best)
        return best

    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), least)
    alone = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("reach", i) == 1)
    chosen = grams.withColumn("line", F.explode(F.array_distinct(F.concat(windows, alone))))
    return chosen.select(
        "doc_id", "copy", "line", F.get("reach", F.col("line")).alias("size"), F.get("gram", F.col("line")).alias("gram")
    ).where("gram is not null")


def spans(lines: DataFrame) -> DataFrame:
    """(doc_id, copy, lo, hi, prev, gram): the least runs of GRAM words from each line on and back from each, as line numbers.

    ``prev`` is the line with words before the run, if there is one.
    """
    n = F.size("words")

    def reach(words: Column, i: Column) -> Column:
        return F.aggregate(
            F.slice(words, i + 1, GRAM),
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("count")),
            lambda a, w: F.when(a["sum"] >= GRAM, a).otherwise(F.struct((a["sum"] + w).alias("sum"), (a["count"] + 1).alias("count"))),
            lambda a: F.when(a["sum"] >= GRAM, a["count"]).otherwise(0),
        )

    each = F.sequence(F.lit(0), n - 1)
    both = lines.withColumn("back", F.reverse("words"))
    on = F.transform(each, lambda i: F.struct(i.alias("i"), reach(F.col("words"), i).alias("k")))
    back = F.transform(each, lambda i: F.struct(i.alias("i"), reach(F.col("back"), n - 1 - i).alias("k")))
    both = both.withColumn("on", on).withColumn("to", F.transform(back, lambda x: F.struct((x["i"] - x["k"] + 1).alias("i"), x["k"].alias("k"))))
    whole = F.array_distinct(F.filter(F.concat("on", "to"), lambda x: x["k"] > 0))
    made = F.transform(
        whole,
        lambda x: F.struct(
            F.get("at", x["i"]).alias("lo"), F.get("at", x["i"] + x["k"] - 1).alias("hi"), F.get("at", x["i"] - 1).alias("prev"),
            F.xxhash64(F.slice("hash", x["i"] + 1, x["k"])).alias("gram"),
        ),
    )
    return both.select("doc_id", "copy", F.explode(made).alias("x")).select("doc_id", "copy", "x.lo", "x.hi", "x.prev", "x.gram")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, runs): of each text with later repeats, the disjoint (lo, hi) line numbers to delete, ascending."""
    lines = checkpointed(line_tables(docs).distinct())
    marks = fingerprints(lines).select("doc_id", "copy", "gram")
    again = marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    texts = marks.join(again, "gram").select(F.col("doc_id").alias("d"), F.col("copy").alias("c")).distinct()
    some = lines.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left_semi")
    grams = spans(some)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy", "lo")
    first = grams.groupBy("gram").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = grams.join(first.select("gram", "first"), "gram").where(place > F.col("first"))
    found = later.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "prev"))).alias("runs"))
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<struct<lo:int,hi:int>>").alias("runs"))

    def add(a: Column, x: Column) -> Column:
        # blank lines between runs that meet go with them
        lo = F.when((x["lo"] <= a["reach"]) | (x["prev"] <= a["reach"]), a["reach"] + 1).otherwise(x["lo"])
        rest = F.struct(lo.alias("lo"), x["hi"].alias("hi"))
        return F.when(x["hi"] <= a["reach"], a).otherwise(F.struct(x["hi"].alias("reach"), F.concat(a["runs"], F.array(rest)).alias("runs")))

    return found.select("doc_id", "copy", F.aggregate("runs", start, add, lambda a: a["runs"]).alias("runs"))


def dedup_lines(docs: DataFrame, removed: str = "n_removed") -> DataFrame:
    """The rows of ``docs``, all columns, with later repeated runs of lines deleted from ``text``, and column ``removed``.

    It counts deleted lines and takes the place of a column of that name. Blank lines inside a deleted run go with it. A
    null text stays null. Rows that repeat a doc_id and text are one document: they neither repeat each other nor differ
    in what they lose. ``doc_id`` is cast to long.
    """
    c = free("k_", docs)
    runs = repeated_runs(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias(f"{c}id"), F.col("copy").alias(f"{c}copy"), F.col("runs").alias(f"{c}runs")
    )
    own = docs.withColumn(f"{c}own", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{c}id")) & (F.col(f"{c}own") == F.col(f"{c}copy"))
    both = own.join(runs, same, "left")
    some = F.col(f"{c}runs").isNotNull()
    # columns of their own, so that a text is split once and not for each line
    both = both.withColumn(f"{c}lines", F.when(some, _lines(F.col("text").cast("string"))))
    lines = F.col(f"{c}lines")
    gone = F.flatten(F.transform(f"{c}runs", lambda r: F.sequence(r["lo"], r["hi"])))
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    both = both.withColumn(f"{c}kept", F.when(some, F.transform(at, lambda i: F.get(lines, i))))
    text = F.coalesce(F.array_join(f"{c}kept", "\n"), F.col("text").cast("string"))
    count = F.coalesce(F.size(lines) - F.size(f"{c}kept"), F.lit(0)).cast("int")
    own_columns = [x for x in docs.columns if x.lower() != removed.lower()]
    return both.select(*(text.alias("text") if x == "text" else F.col(f"`{x}`") for x in own_columns), count.alias(removed))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its later repeated runs of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_removed", "text")
