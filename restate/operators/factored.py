"""Overlaps in factorised form: as many rows as there are requests, however many pairs those make.

*Classes.*  Requests of a group with equal filters overlap the same others, so they are one class.

*Nodes.*  Two requests overlap exactly when they agree on the filters both set.  So all overlaps of two
signatures with equal values on the filters they share are one node: every class on its one side overlaps
every class on the other.  Every overlapping pair lies in one node, and a node says how many
pairs it holds and names one of them.

A request whose group is NULL overlaps nothing.  Counts and first partners come from classes and nodes; ``expand`` lists the pairs of chosen requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restate.operators.asof import asof_join
from restate.operators.overlap import _against, _norm, _sig, _signatures, overlap_pairs
from restate.operators.shape import row_numbers
from restate.session import cut_lineage


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def with_class(headers: DataFrame, dims, group_cols, out_col: str = "class_id") -> DataFrame:
    """``out_col``: the class of each request, a hash of its group and filters."""
    parts = [F.col(g).alias(f"g{i}") for i, g in enumerate(group_cols)] + [_norm(F.col(c)).alias(f"d{i}") for i, c in enumerate(dims)]
    return headers.withColumn(out_col, F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})))


def overlap_classes(headers: DataFrame, id_col: str, dims, group_cols, created_col: str) -> DataFrame:
    """A row a class: its group and filters, ``members`` and its two oldest requests (``first``, ``second``: created, id)."""
    order = F.struct(F.col(created_col).alias("created"), F.col(id_col).alias("id"))
    rows = with_class(headers.select(id_col, created_col, *group_cols, *[_norm(F.col(c)).alias(c) for c in dims]), dims, group_cols)
    first = rows.groupBy("class_id", *group_cols, *dims).agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("first"))
    rest = rows.join(first.select(F.col("class_id").alias("_c"), F.col("first.id").alias("_first")),
                     (F.col("class_id") == F.col("_c")) & (F.col(id_col) != F.col("_first")))
    second = rest.groupBy(F.col("class_id").alias("_c")).agg(F.min(order).alias("second"))
    return first.join(second, F.col("class_id") == F.col("_c"), "left").drop("_c")


def _sides(classes: DataFrame, dims, group_cols) -> tuple[DataFrame, list[str]]:
    """Every class once for each signature it may meet, with the node it then lies in."""
    sides = _against(classes, list(dims), "x_", _signatures(classes, list(dims)))
    return sides, ["x_" + g for g in group_cols]


def overlap_nodes(classes: DataFrame, dims, group_cols) -> DataFrame:
    """A row a node: group, ``sig_a`` <= ``sig_b``, ``key``, requests on both sides, ``pairs``, and the pair of the
    oldest requests (``rep_a``, ``rep_b``).  Nodes without a pair are left out."""
    sides, groups = _sides(classes, dims, group_cols)
    per = sides.groupBy(*groups, "_x_own", "_x_other", "_x_key").agg(F.sum("x_members").alias("n"), F.min("x_first").alias("first"),
                                                                  F.min("x_second").alias("second"))
    # one signature with itself: the two oldest are the first of the class and the next one, which may be of that class
    own = sides.where("_x_own = _x_other").groupBy(*groups, "_x_own", "_x_key").agg(F.min("x_first").alias("f"), F.min("x_second").alias("s"))
    a = per.where("_x_own < _x_other").select(*groups, "_x_own", "_x_other", "_x_key", "n", "first")
    b = per.where("_x_own > _x_other").select(*[F.col(c).alias("y" + c) for c in [*groups, "_x_own", "_x_other", "_x_key"]], F.col("n").alias("m"), F.col("first").alias("last"))
    both = a.join(b, _all([F.col(g) == F.col("y" + g) for g in groups] + [
        F.col("_x_own") == F.col("y_x_other"), F.col("_x_other") == F.col("y_x_own"), F.col("_x_key") == F.col("y_x_key")]))
    out = [F.col(x).alias(g) for x, g in zip(groups, group_cols)]
    both = both.select(*out, F.col("_x_own").alias("sig_a"), F.col("_x_other").alias("sig_b"), F.col("_x_key").alias("key"),
                       "n", "m", (F.col("n") * F.col("m")).alias("pairs"), F.col("first.id").alias("rep_a"), F.col("last.id").alias("rep_b"))
    # of one signature all filters are shared: the node is the class
    same = per.where("_x_own = _x_other AND n > 1").join(own.select(*[F.col(c).alias("y" + c) for c in [*groups, "_x_own", "_x_key"]], "f", "s"), _all(
        [F.col(g) == F.col("y" + g) for g in groups] + [F.col("_x_own") == F.col("y_x_own"), F.col("_x_key") == F.col("y_x_key")]))
    same = same.select(*out, F.col("_x_own").alias("sig_a"), F.col("_x_own").alias("sig_b"), F.col("_x_key").alias("key"), "n", F.col("n").alias("m"),
                       (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.col("f.id").alias("rep_a"), F.col("s.id").alias("rep_b"))
    return both.unionByName(same)


def overlap_links(headers: DataFrame, id_col: str, dims, group_cols, created_col: str) -> DataFrame:
    """(id, class_id, members, links): each request with its class and how many others it overlaps; a row a request."""
    classes = cut_lineage(overlap_classes(headers, id_col, dims, group_cols, created_col))
    sides, groups = _sides(classes, dims, group_cols)
    n = sides.groupBy(*groups, "_x_own", "_x_other", "_x_key").agg(F.sum("x_members").alias("n"))
    n = n.select(*[F.col(c).alias("y" + c) for c in [*groups, "_x_own", "_x_other", "_x_key"]], "n")
    met = sides.join(n, _all([F.col(g) == F.col("y" + g) for g in groups] + [
        F.col("_x_own") == F.col("y_x_other"), F.col("_x_other") == F.col("y_x_own"), F.col("_x_key") == F.col("y_x_key")]), "left")
    # a class meets itself; one without a group meets nothing
    links = F.greatest(F.coalesce(F.sum("n"), F.lit(0)) - 1, F.lit(0)).alias("links")
    links = met.groupBy(F.col("x_class_id").alias("_c")).agg(links, F.first("x_members").alias("members"))
    members = with_class(headers.select(id_col, *group_cols, *dims), dims, group_cols)
    return members.join(links, F.col("class_id") == F.col("_c")).select(id_col, "class_id", "members", "links")


def expand(headers: DataFrame, chosen: DataFrame, id_col: str, dims, group_cols) -> DataFrame:
    """(a_id, b_id): every overlap of the requests whose ids ``chosen`` holds; as many rows as those have links."""
    wanted = chosen.select(F.col(id_col).alias("_w")).distinct()
    cols = headers.select(id_col, *group_cols, *dims)
    a = cols.join(wanted, F.col(id_col) == F.col("_w"), "left_semi")
    pairs = overlap_pairs(a, cols, id_col, dims, group_cols, order_pairs=False, extra_cond=F.col("a_" + id_col) != F.col("b_" + id_col))
    return pairs.select(F.col("a_" + id_col).alias("a_id"), F.col("b_" + id_col).alias("b_id"))


def narrower_links(a: DataFrame, b: DataFrame, id_col: str, dims, group_cols, created_col: str) -> DataFrame:
    """Each ``a`` with how many older ``b`` of its group have filters no wider (see ``narrower_pairs``), and the
    oldest and newest of them; a row a request that has any, no pair is listed.

    Each b is numbered by age among those of a node; the last one before an a, carried forward to it,
    says by its number how many there are."""
    dims, nulls = list(dims), {"ignoreNullFields": "false"}

    def node(mask: Column, own: Column) -> Column:
        values = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col(c).cast("string")).alias(f"d{i}") for i, c in enumerate(dims)]
        return F.md5(F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group_cols)], own.alias("s"), *values), nulls))

    has_group = _all([F.col(g).isNotNull() for g in group_cols])
    sigs = _signatures(a, dims)
    left = a.where(has_group).select(id_col, created_col, _sig(dims).alias("_own"), *group_cols, *dims)
    left = left.select(id_col, created_col, node(F.col("_own"), F.col("_own")).alias("node"))
    right = b.where(has_group).withColumn("_own", _sig(dims)).withColumn("_other", F.explode(F.array(*[F.lit(x) for x in sigs]).cast("array<int>")))
    right = right.where(F.col("_own").bitwiseAND(F.col("_other")) == F.col("_other"))
    right = right.select(node(F.col("_other"), F.col("_other")).alias("node"), F.col(created_col).cast("timestamp").alias("made"), F.col(id_col).alias("other"))
    numbered = row_numbers(right.where(F.col("made").isNotNull()), ["node"], ["made", "other"], "nth")
    later = numbered.withColumn("after", F.timestamp_micros(F.unix_micros("made") + 1))
    met = asof_join(left, later, {"node": "node"}, created_col, "after", None, {"older": "nth", "newest": "other"}, order_cols=["nth"])
    first = numbered.where("nth = 1").select(F.col("node").alias("_n"), F.col("other").alias("oldest"))
    return met.where("older IS NOT NULL").join(first, F.col("node") == F.col("_n")).select(id_col, "older", "oldest", "newest")


# -- value lists -------------------------------------------------------------

def _values(col: str) -> Column:
    """A list as text: sorted, without NULLs and repeats; a NULL list is empty."""
    texts = F.transform(F.coalesce(F.col(col), F.array()), lambda x: x.cast("string"))
    return F.array_sort(F.array_distinct(F.filter(texts, lambda x: x.isNotNull())))


def list_classes(a: DataFrame, id_col: str, list_cols, group_cols) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of requests with value lists; requests of a group with equal lists are one class.

    Members: id, class_id.  Classes: class_id, group, lists (text, sorted, distinct), ``open`` (bits of the lists that
    are empty and so match anything), members."""
    lists = [f"l{i}" for i in range(len(list_cols))]
    rows = a.select(id_col, *group_cols, *[_values(c).alias(n) for c, n in zip(list_cols, lists)])
    rows = rows.withColumn("class_id", F.md5(F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group_cols)], *lists), {"ignoreNullFields": "false"})))
    bits = reduce(lambda x, y: x + y, [F.when(F.size(n) == 0, 1 << i).otherwise(0) for i, n in enumerate(lists)])
    classes = rows.groupBy("class_id").agg(*[F.first(g).alias(g) for g in group_cols], *[F.first(n).alias(n) for n in lists],
                                           F.count(F.lit(1)).alias("members")).withColumn("open", bits)
    return rows.select(id_col, "class_id"), classes


def list_class_pairs(classes: DataFrame, list_cols, group_cols) -> DataFrame:
    """(class_a, class_b, common_0, ...): classes that share a value in every list that both have closed, both ways round.

    An inverted index: a class posts the values of the first list that it and the other have closed.  Pairs
    without such a list need no index (``open_nodes``)."""
    n = len(list_cols)
    masks = sorted(r[0] for r in classes.select("open").distinct().collect())  # at most 2 ** lists
    if not masks:
        masks = [0]
    posts = []
    for other in masks:
        for at in range(n):
            # the first list closed in both is number ``at``
            mine = (F.col("open").bitwiseOR(F.lit(other)).bitwiseAND(F.lit((1 << (at + 1)) - 1)) == F.lit((1 << at) - 1)) if at else (
                F.col("open").bitwiseOR(F.lit(other)).bitwiseAND(F.lit(1)) == F.lit(0))
            posts.append(classes.where(mine).select("*", F.lit(other).alias("_other"), F.lit(at).alias("_at"), F.explode(f"l{at}").alias("_v")))
    index = reduce(DataFrame.unionByName, posts)
    a, b = (index.select(*[F.col(c).alias(p + c) for c in index.columns]) for p in ("a", "b"))
    met = a.join(b, _all([F.col("a" + g) == F.col("b" + g) for g in group_cols] + [
        F.col("a_v") == F.col("b_v"), F.col("a_at") == F.col("b_at"), F.col("aopen") == F.col("b_other"), F.col("bopen") == F.col("a_other")]))
    # a pair meets once for each value it shares in that list: the least one stands for it
    once = met.where(F.col("a_v") == F.get(F.array_intersect(*[F.element_at(F.array(*[F.col(f"{p}l{i}") for i in range(n)]), F.col("a_at") + 1) for p in "ab"]), F.lit(0)))
    common = [F.when((F.size(f"al{i}") > 0) & (F.size(f"bl{i}") > 0), F.size(F.array_intersect(f"al{i}", f"bl{i}")).cast("long")).alias(f"common_{i}") for i in range(n)]
    once = once.select(F.col("aclass_id").alias("class_a"), F.col("bclass_id").alias("class_b"), F.col("amembers").alias("n_a"), F.col("bmembers").alias("n_b"), *common)
    return once.where(_all([F.coalesce(F.col(f"common_{i}") > 0, F.lit(True)) for i in range(n)]))


def open_nodes(classes: DataFrame, list_cols, group_cols) -> DataFrame:
    """(group, open_a, open_b, n_a, n_b): sides of which every list is open on one of both: all of them overlap.

    Counts of a group by open lists, at most 2 ** lists of them, meet; requests do not."""
    full = (1 << len(list_cols)) - 1
    per = classes.groupBy(*group_cols, "open").agg(F.sum("members").alias("n"))
    b = per.select(*[F.col(g).alias("y" + g) for g in group_cols], F.col("open").alias("open_b"), F.col("n").alias("n_b"))
    met = per.join(b, _all([F.col(g) == F.col("y" + g) for g in group_cols] + [F.col("open").bitwiseOR(F.col("open_b")) == F.lit(full)]))
    return met.select(*group_cols, F.col("open").alias("open_a"), "open_b", F.col("n").alias("n_a"), "n_b")


def list_links(a: DataFrame, id_col: str, list_cols, group_cols) -> DataFrame:
    """(id, class_id, members, links): each request and how many others its lists meet on every list; a row a request."""
    members, classes = list_classes(a, id_col, list_cols, group_cols)
    classes = cut_lineage(classes)
    closed = list_class_pairs(classes, list_cols, group_cols).groupBy(F.col("class_a").alias("_p")).agg(F.sum("n_b").alias("_closed"))
    opened = open_nodes(classes, list_cols, group_cols).groupBy(*[F.col(g).alias("o" + g) for g in group_cols], "open_a").agg(F.sum("n_b").alias("_open"))
    j = classes.join(closed, F.col("class_id") == F.col("_p"), "left").join(
        opened, _all([F.col(g) == F.col("o" + g) for g in group_cols] + [F.col("open") == F.col("open_a")]), "left")
    # a class meets itself, by its values or by being open; a request is not its own link
    links = F.greatest(F.coalesce("_closed", F.lit(0)) + F.coalesce("_open", F.lit(0)) - 1, F.lit(0)).cast("long")
    per = j.select(F.col("class_id").alias("_c"), "members", links.alias("links"))
    return members.join(per, F.col("class_id") == F.col("_c")).select(id_col, "class_id", "members", "links")


def expand_lists(a: DataFrame, id_col: str, list_cols, group_cols, chosen: DataFrame | None = None) -> DataFrame:
    """(a_id, b_id, common_0, ...): the pairs behind ``list_links`` with a_id < b_id (or of ``chosen`` ids only, with any other id);
    the number of common values is NULL where a list of the two is open."""
    members, classes = list_classes(a, id_col, list_cols, group_cols)
    classes = cut_lineage(classes)
    n = len(list_cols)
    common = [f"common_{i}" for i in range(n)]
    by_value = list_class_pairs(classes, list_cols, group_cols).select("class_a", "class_b", *common)
    full = (1 << n) - 1
    x, y = (classes.select(*[F.col(c).alias(p + c) for c in ("class_id", "open", *group_cols)]) for p in "xy")
    free = x.join(y, _all([F.col("x" + g) == F.col("y" + g) for g in group_cols] + [F.col("xopen").bitwiseOR(F.col("yopen")) == F.lit(full)]))
    by_open = free.select(F.col("xclass_id").alias("class_a"), F.col("yclass_id").alias("class_b"), *[F.lit(None).cast("long").alias(c) for c in common])
    left = members if chosen is None else members.join(chosen.select(F.col(id_col).alias("_w")).distinct(), F.col(id_col) == F.col("_w"), "left_semi")
    pairs = by_value.unionByName(by_open)
    pairs = left.select(F.col(id_col).alias("a_id"), F.col("class_id").alias("class_a")).join(pairs, "class_a").join(
        members.select(F.col(id_col).alias("b_id"), F.col("class_id").alias("class_b")), "class_b")
    return pairs.where(F.col("a_id") < F.col("b_id") if chosen is None else F.col("a_id") != F.col("b_id")).select("a_id", "b_id", *common)

