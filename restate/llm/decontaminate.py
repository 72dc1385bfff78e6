"""Benchmark decontamination by winnowing: DataFrame operations only.

A *window* is 13 consecutive words of a benchmark item (an item of fewer words is
one window).  Texts are fingerprinted: every word is hashed, k neighbouring words
make a k-gram hash, and of each run of w k-grams the least hash is kept.  A window
of k + w - 1 words has exactly one such least hash, the same one wherever the
window stands, so a document that holds a window holds the window's fingerprint:
joining the distinct fingerprints of both sides misses none.

Only the documents that were hit are read again.  At the places whose fingerprint
was hit the k-gram is extended to the whole window, as text, and joined with the
benchmark's windows; each document's words under matching windows are counted once.

K-gram hashes and sliding minima are built by doubling: arrays are zipped with
themselves, shifted, log2(k) and log2(w) times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restate.llm.common import store, text_key
from restate.llm.url_filter import LOWER, UPPER

WINDOW = 13
#: Words of a k-gram; a window of L words then spans L - GRAM + 1 of them.
GRAM = 6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NOT_WORD), "")


def _shifted(col: str, by: int) -> Column:
    return F.slice(col, by + 1, F.greatest(F.size(col) - by, F.lit(0)))


def _spans(df: DataFrame, base: str, size: int, join: Callable[[Column, Column], Column], overlap: bool, tag: str) -> tuple[DataFrame, str]:
    """Adds columns that combine ``size`` neighbours of ``base``; what reaches beyond the end is left to the caller.

    ``overlap``: the two halves may overlap (a minimum); else they are laid end to end."""
    power, name = 1, base
    names = {1: base}
    while power * 2 <= size:
        name = f"{tag}{power * 2}"
        df = df.withColumn(name, F.zip_with(names[power], _shifted(names[power], power), join))
        power *= 2
        names[power] = name
    rest = size - power
    while rest:
        step = power if overlap else max(p for p in names if p <= rest)
        done = size - rest
        new = f"{tag}{size}_{rest}"
        df = df.withColumn(new, F.zip_with(name, _shifted(names[step], size - step if overlap else done), join))
        name, rest = new, 0 if overlap else rest - step
    return df, name


def fingerprints(df: DataFrame, words_col: str, length: int, out: str) -> DataFrame:
    """Adds ``out``: for each window of ``length`` words, in order, its fingerprint."""
    k = min(GRAM, length)
    tag = f"{out}_"
    df = df.withColumn(f"{tag}h", F.transform(words_col, lambda x: F.xxhash64(x)))
    df, grams = _spans(df, f"{tag}h", k, lambda x, y: F.xxhash64(x, y), False, f"{tag}g")
    count = F.greatest(F.size(words_col) - (k - 1), F.lit(0))
    df = df.withColumn(f"{tag}k", F.slice(grams, F.lit(1), count))
    df, least = _spans(df, f"{tag}k", length - k + 1, lambda x, y: F.least(x, y), True, f"{tag}m")
    df = df.withColumn(out, F.slice(least, F.lit(1), F.greatest(F.size(words_col) - (length - 1), F.lit(0))))
    return df.drop(*[c for c in df.columns if c.startswith(tag)])


def _window_text(words_col: str, at: Column, length: int) -> Column:
    return F.array_join(F.slice(words_col, at + 1, length), " ")


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: length, window (text), fp, items (ids that have it, as strings)."""
    base = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    base = base.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(WINDOW)))
    base = store(base, "benchmark-words")
    out = None
    for length in lengths_of(base):
        rows = fingerprints(base.where(F.col("length") == length), "w", length, "fp").select(
            "item", F.transform("fp", lambda m, i: F.struct(m.alias("fp"), _window_text("w", i, length).alias("window"))).alias("all"))
        rows = store(rows, "item-windows").select("item", F.explode("all").alias("x"))
        rows = rows.select(F.lit(length).alias("length"), "item", "x.fp", "x.window")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = base.select("length", "item", F.lit(0).cast("long").alias("fp"), F.lit("").alias("window"))
    return out.groupBy("length", "window", "fp").agg(F.collect_set("item").alias("items"))


def lengths_of(rows: DataFrame) -> list[int]:
    """Lengths of windows that occur: at most WINDOW values."""
    return sorted(r["length"] for r in rows.select("length").distinct().collect())


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, text_key, n_words, n_hit, items (sorted ids, as strings), spans.

    ``n_hit`` counts the words under any occurrence of a window, each once;
    ``spans`` are the merged runs of hit words (start, end; from 0, end excluded).

    Null or wordless texts have no words and are never hit; items without words
    have no window.  Items with one id count once; a null item id is named by the
    empty string.  Rows that repeat an id, or a whole row, each get their own
    result; a null id is an id like others.  Empty tables: no rows, or no hits.
    Other columns are left out.
    """
    windows = store(benchmark_windows(items, item_col, item_text_col), "benchmark-windows")
    lengths = lengths_of(windows)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.withColumn("key", text_key("text"))

    prints, columns = base.select("id", "key", words(F.col("text")).alias("w")), []
    for length in lengths:
        prints = fingerprints(prints, "w", length, f"fp{length}")
        columns.append(F.array_distinct(f"fp{length}").alias(f"fp{length}"))
    prints = store(prints.select("id", "key", F.size("w").cast("long").alias("n_words"), *columns), "document-prints")
    hits = matched = None
    known = windows.select(F.col("length").alias("b_length"), F.col("fp").alias("b_fp")).distinct()
    for length in lengths:
        rows = prints.select("id", "key", F.explode(f"fp{length}").alias("fp"))
        rows = rows.join(known.where(F.col("b_length") == length), F.col("fp") == F.col("b_fp"), "left_semi")
        rows = rows.groupBy("id", "key").agg(F.collect_set("fp").alias("hit")).withColumn("length", F.lit(length))
        hits = rows if hits is None else hits.unionByName(rows)
    all_rows = prints.select("id", "key", "n_words")
    if hits is None:
        return all_rows.select("id", F.col("key").alias("text_key"), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"),
                               F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    hits = store(hits, "document-hits").select(F.col("id").alias("h_id"), F.col("key").alias("h_key"), "hit", "length")
    for length in lengths:
        rows = base.join(hits.where(F.col("length") == length), (F.col("key") == F.col("h_key")) & F.col("id").eqNullSafe(F.col("h_id")))
        # of the hit texts only; stored, as Spark would put the splitting of a text into each step over its words
        # and dealt anew: long texts may all lie in few files
        rows = store(rows.select("id", "key", "hit", "length", words(F.col("text")).alias("w")).repartition(F.xxhash64("id", "key")), "hit-words")
        rows = fingerprints(rows, "w", length, "fp")
        places = F.filter(F.transform("fp", lambda m, i: F.when(F.array_contains("hit", m), F.struct(
            i.alias("at"), _window_text("w", i, length).alias("window")))), lambda x: x.isNotNull())
        # stored before it is exploded: Spark would infer that the list is not empty and compute all of it once more to filter by that
        rows = store(rows.select("id", "key", "length", places.alias("places")), "hit-places").select("id", "key", "length", F.explode("places").alias("p"))
        matched = rows if matched is None else matched.unionByName(rows)
    exact = windows.select(F.col("length").alias("b_length"), F.col("window").alias("b_window"), "items")
    matched = matched.select("id", "key", "length", "p.at", "p.window").join(
        exact, (F.col("window") == F.col("b_window")) & (F.col("length") == F.col("b_length")))
    found = matched.groupBy("id", "key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.select(F.col("id").alias("f_id"), F.col("key").alias("f_key"), "items", _merged("runs").alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return all_rows.join(found, (F.col("key") == F.col("f_key")) & F.col("id").eqNullSafe(F.col("f_id")), "left").select(
        "id", F.col("key").alias("text_key"), "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def _merged(runs: str) -> Column:
    """Sorted (start, end) runs with those that touch or overlap made one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, run: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                          F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= run["start"]), joined).otherwise(F.concat(acc, F.array(run)))

    return F.aggregate(runs, empty, add)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)
