"""Folder trees as parent tables, and questions about them by interval labels.

A depth-first walk numbers the nodes of each tree (``labels``): what lies below a node has the numbers of one interval. So "below" is
a comparison of two rows, sets of nodes below others are running maxima over the numbers, and counts are differences of running sums; no
table of pairs is stored. The numbers come from an Euler tour of the inner nodes, a linked list that is ranked by pointer doubling between a
sample of its members (rulers), then for the rulers alone, so a chain of 100,000 nodes takes as few rounds as a bushy tree.

Orphans and nodes that are their own parent are roots. Nodes of a cycle are roots of depth 0, too; each of them has the whole cycle, and all that hangs on it, below it.
"""

from __future__ import annotations

import unicodedata
from sys import maxunicode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.sources.staging import staged


def rooted(nodes: DataFrame) -> DataFrame:
    """Nodes with parent null where the parent is missing or the node itself."""
    ids = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
    own = F.when(F.col("_there") & (F.col("parent_id") != F.col("node_id")), F.col("parent_id"))
    return nodes.join(ids, "parent_id", "left").withColumn("parent_id", own).drop("_there").select(*nodes.columns)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance) for every node and all above it, itself included at 0.

    Pairs of a distance up to 2^k give those up to 2^(k+1). A cycle's pairs repeat and the smallest distance stays, so it ends.
    """
    up = rooted(nodes.select("node_id", "parent_id").distinct())
    self_ = up.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    pairs = staged(self_.unionAll(up.filter("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1))).groupBy("node_id", "ancestor_id").agg(F.min("distance").alias("distance")))
    n = pairs.count()
    while True:
        upper = pairs.select(F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("over"), F.col("distance").alias("more"))
        longer = pairs.join(upper, "ancestor_id").select("node_id", F.col("over").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs = staged(longer.groupBy("node_id", "ancestor_id").agg(F.min("distance").alias("distance")))
        now = pairs.count()
        if now == n:
            return pairs
        n = now


#: Links that are ranked at once, outside Spark; one in so many members of a longer list is a ruler; rows of a partition that a running sum is taken over.
AT_ONCE, RULERS, PART = 1 << 16, 8, 1 << 18


def _reached(up: DataFrame) -> tuple[DataFrame, int]:
    """(node_id, at, depth, done): every node's root and its distance, by pointers that reach twice as far each round. And how many reach none."""
    now = staged(up.select("node_id", F.coalesce("parent_id", "node_id").alias("at"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.col("parent_id").isNull().alias("done")))
    left = None
    while True:
        far = now.select(F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_more"), F.col("done").alias("_done"))
        now = staged(now.join(far, "at").select("node_id", F.col("_at").alias("at"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_done").alias("done")))
        open_ = now.filter(~F.col("done")).count()
        if not open_ or open_ == left:
            return now, open_
        left = open_


def forest(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, root_id, depth, loop): the trees that the nodes form. Of a cycle the smallest id is the root, the others stand below it with depth 0; ``loop``: node of a cycle."""
    up = rooted(nodes.select("node_id", "parent_id").distinct())
    now, open_ = _reached(up)
    if not open_:
        return staged(up.join(now, "node_id").select("node_id", "parent_id", F.col("at").alias("root_id"), "depth", F.lit(False).alias("loop")))
    # after as many steps as there are open nodes a pointer is on a cycle, and the smallest id it has met on a cycle's way is that of the whole cycle
    ring = staged(up.join(now.filter(~F.col("done")).select("node_id"), "node_id", "left_semi"))
    walk, reach = ring.select("node_id", F.col("parent_id").alias("at"), F.least("node_id", "parent_id").alias("least")), 1
    while reach < open_:
        far = walk.select(F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        walk, reach = staged(walk.join(far, "at").select("node_id", F.col("_at").alias("at"), F.least("least", "_least").alias("least"))), 2 * reach
    heads = walk.join(walk.select(F.col("at").alias("node_id")).distinct(), "node_id", "left_semi").select("node_id", F.col("least").alias("head"))
    cut = staged(up.join(heads, "node_id", "left"))
    now, _ = _reached(cut.select("node_id", F.when(F.col("head").isNull(), F.col("parent_id")).alias("parent_id")))
    of = now.select("node_id", F.col("at").alias("root_id"), "depth").join(heads.select(F.col("node_id").alias("root_id"), F.col("head").alias("_root")), "root_id", "left")
    parent = F.when(F.col("head").isNull(), F.col("parent_id")).when(F.col("head") != F.col("node_id"), F.col("head"))
    return staged(cut.join(of, "node_id").select("node_id", parent.alias("parent_id"), F.coalesce("_root", "root_id").alias("root_id"), "depth", F.col("head").isNotNull().alias("loop")))


def _running(rows: DataFrame, key: list[str], order: list[Column | str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running sums and maxima (this row included) within each key.

    More than ``PART`` rows are dealt by ranges of key and order first, so that no key is ever the work of one task: the running value is that
    within the range, and on top what the ranges before have.
    """
    sums, maxima = sums or {}, maxima or {}
    parts = -(-rows.count() // PART)
    if parts <= 1:
        upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *(F.sum(c).over(upto).cast("long").alias(n) for n, c in sums.items()), *(F.max(c).over(upto).alias(n) for n, c in maxima.items()))
    names = rows.columns
    rows = staged(rows.repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()))
    whole = rows.groupBy(*key, "_part").agg(*(F.sum(c).alias(f"_b_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_b_{n}") for n, c in maxima.items()))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*(F.col(k).alias(f"_k_{k}") for k in key), F.col("_part").alias("_p"), *(F.sum(f"_b_{n}").over(earlier).alias(f"_b_{n}") for n in sums), *(F.max(f"_b_{n}").over(earlier).alias(f"_b_{n}") for n in maxima))
    upto = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(c).over(upto).alias(f"_w_{n}") for n, c in sums.items()), *(F.max(c).over(upto).alias(f"_w_{n}") for n, c in maxima.items()))
    on = F.col("_part") == F.col("_p")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = [(F.col(f"_w_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).cast("long").alias(n) for n in sums] + [F.greatest(f"_w_{n}", f"_b_{n}").alias(n) for n in maxima]
    return rows.join(whole, on).select(*names, *out)


def _ranked(links: DataFrame) -> DataFrame:
    """(id, rest) of linked lists (id, next, w): the sum of all w from a member to its list's end."""
    levels = []
    links = staged(links.select("id", F.col("next").alias("at"), "w"))
    while links.count() > AT_ONCE:
        level = len(levels)
        ruler = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(RULERS)) == 0  # noqa: E731, B023
        now = links.withColumn("done", F.col("at").isNull() | ruler("at"))
        while True:
            far = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("w").alias("_w"), F.col("done").alias("_done"))
            step = now.filter(~F.col("done")).drop("done").join(far, "at").select("id", F.col("_at").alias("at"), (F.col("w") + F.col("_w")).alias("w"), F.col("_done").alias("done"))
            now = staged(now.filter("done").unionByName(step))
            if now.filter(~F.col("done")).isEmpty():
                break
        levels.append(now.drop("done"))
        links = staged(now.filter(ruler("id")).drop("done"))
    rows = {r["id"]: (r["at"], r["w"]) for r in links.collect()}  # at most AT_ONCE
    rest: dict = {}
    for member in rows:
        way = []
        while member is not None and member not in rest:
            way.append(member)
            member = rows[member][0]
        for m in reversed(way):
            at, w = rows[m]
            rest[m] = w + (rest[at] if at is not None else 0)
    ranked = links.sparkSession.createDataFrame(list(rest.items()), "id string, rest long")
    for pointers in reversed(levels):
        far = ranked.select(F.col("id").alias("at"), F.col("rest").alias("_rest"))
        ranked = staged(pointers.join(far, "at", "left").select("id", (F.col("w") + F.coalesce("_rest", F.lit(0))).alias("rest")))
    return ranked


def labels(nodes: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """(node_id, root_id, depth, pre, low, high): in a depth-first walk a node has the number ``pre`` of its tree, from 0, and what lies below it (itself included) those from ``low`` to below ``high``.

    ``order``: of the children of a node, by columns of ``nodes``; inner nodes (folders, where there is a type, and whatever has children) come before the others.
    """
    order = [*(order or []), "node_id"]
    extra = [c for c in nodes.columns if c not in ("node_id", "parent_id", "root_id", "depth", "loop", "inner")]
    f = forest(nodes).join(nodes.select("node_id", *extra).dropDuplicates(["node_id"]), "node_id")
    has = f.select(F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct().withColumn("_has", F.lit(True))
    folder = F.col("type") == "folder" if "type" in extra else F.lit(False)
    f = staged(f.join(has, "node_id", "left").withColumn("inner", F.coalesce(F.col("_has"), F.lit(False)) | F.coalesce(folder, F.lit(False))).drop("_has"))
    child = staged(_running(f.filter("parent_id is not null"), ["parent_id", "inner"], order, sums={"k": F.lit(1)}).select("node_id", "parent_id", "inner", "k"))
    size = child.groupBy(F.col("parent_id").alias("node_id")).agg(F.max(F.when(F.col("inner"), F.col("k"))).alias("inners"), F.max(F.when(~F.col("inner"), F.col("k"))).alias("leaves"))
    inner = staged(f.filter("inner").select("node_id", "root_id").join(size, "node_id", "left").na.fill(0, ["inners", "leaves"]))
    enter, leave = lambda c: F.concat(F.col(c).cast("string"), F.lit("+")), lambda c: F.concat(F.col(c).cast("string"), F.lit("-"))
    kids = child.filter("inner").select(F.col("parent_id").alias("_p"), F.col("k").alias("_k"), F.col("node_id").alias("_n"))
    first = inner.join(kids.filter("_k = 1"), F.col("node_id") == F.col("_p"), "left")
    into = first.select(enter("node_id").alias("id"), F.coalesce(enter("_n"), leave("node_id")).alias("next"), (F.when(F.col("_n").isNull(), F.col("leaves")).otherwise(0) + 1).alias("w"))
    own = inner.select("node_id").join(child.select("node_id", "parent_id", "k"), "node_id", "left").join(size.select(F.col("node_id").alias("parent_id"), F.coalesce("leaves", F.lit(0)).alias("_l")), "parent_id", "left")
    own = own.join(kids, (F.col("parent_id") == F.col("_p")) & (F.col("k") + 1 == F.col("_k")), "left")
    out = own.select(leave("node_id").alias("id"), F.coalesce(enter("_n"), leave("parent_id")).alias("next"), F.when(F.col("_n").isNull(), F.coalesce("_l", F.lit(0))).otherwise(0).alias("w"))
    rest = _ranked(into.unionAll(out).withColumn("w", F.col("w").cast("long")))
    placed = inner.withColumns({"_e": enter("node_id"), "_x": leave("node_id"), "_r": enter("root_id")})
    for key in ("_e", "_x", "_r"):
        placed = placed.join(rest.select(F.col("id").alias(key), F.col("rest").alias(f"n{key}")), key)
    placed = staged(placed.select("node_id", (F.col("n_r") - F.col("n_e")).alias("pre"), (F.col("n_r") - F.col("n_x")).alias("high"), "leaves"))
    leaf = child.filter(~F.col("inner")).join(placed.select(F.col("node_id").alias("parent_id"), F.col("high").alias("_h"), F.col("leaves").alias("_l")), "parent_id")
    leaf = leaf.select("node_id", (F.col("_h") - F.col("_l") + F.col("k") - 1).alias("pre")).withColumn("high", F.col("pre") + 1)
    own = placed.select("node_id", "pre", "high").unionByName(leaf)
    all_ = f.select("node_id", "root_id", "depth", "loop").join(own, "node_id", "left").na.fill({"pre": 0, "high": 1})
    whole = all_.filter("loop and node_id = root_id").select("root_id", F.col("high").alias("_high"))
    all_ = all_.join(whole, "root_id", "left")
    return staged(all_.select("node_id", "root_id", "depth", "pre", F.when(F.col("loop"), 0).otherwise(F.col("pre")).cast("long").alias("low"), F.when(F.col("loop"), F.col("_high")).otherwise(F.col("high")).alias("high")))


def closure(nodes: DataFrame, picked: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Picked nodes (node_id) and all below them, once each: those whose number lies before the farthest end of the intervals begun so far."""
    labelled = labels(nodes) if labelled is None else labelled
    rows = labelled.join(picked.select("node_id", F.lit(True).alias("mine")).distinct(), "node_id", "left")
    begun = rows.filter("mine").select("root_id", F.col("low").alias("pre"), "high", F.lit(None).cast(labelled.schema["node_id"].dataType).alias("node_id"), F.lit(0).alias("second"))
    rows = begun.unionByName(rows.select("root_id", "pre", F.lit(None).cast("long").alias("high"), "node_id", F.lit(1).alias("second")))
    return _running(rows, ["root_id"], ["pre", "second"], maxima={"to": F.col("high")}).filter("node_id is not null and to > pre").select("node_id")


def with_depth(nodes: DataFrame) -> DataFrame:
    """Nodes with depth; nodes without a parent and those of a cycle are roots at 0."""
    return nodes.join(forest(nodes).select("node_id", "depth"), "node_id", "left")


def paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path): names from the root down to the node, put together from pieces twice as long each round."""
    named = nodes.select("node_id", "name").dropDuplicates(["node_id"])
    up = forest(nodes).select("node_id", F.when(~F.col("loop"), F.col("parent_id")).alias("at")).join(named, "node_id")
    now = staged(up.select("node_id", "at", F.array("name").alias("path")))
    while not now.filter("at is not null").isEmpty():
        far = now.select(F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("path").alias("_path"))
        now = staged(now.join(far, "at", "left").select("node_id", F.col("_at").alias("at"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")))
    return now.select("node_id", "path")


def _below(labelled: DataFrame, what: dict[str, Column]) -> DataFrame:
    """``labelled`` with sums over each node's interval: the difference of two running sums."""
    run = staged(_running(labelled, ["root_id"], ["pre"], sums=what))
    end = run.select(F.col("root_id").alias("_root"), F.col("pre").alias("_pre"), *(F.col(n).alias(f"_to_{n}") for n in what))
    start = run.select(F.col("root_id").alias("_root2"), F.col("pre").alias("_pre2"), *(F.col(n).alias(f"_from_{n}") for n in what))
    j = run.drop(*what).join(end, (F.col("root_id") == F.col("_root")) & (F.col("high") - 1 == F.col("_pre")))
    j = j.join(start, (F.col("root_id") == F.col("_root2")) & (F.col("low") - 1 == F.col("_pre2")), "left")
    return j.select(*(c for c in run.columns if c not in what), *((F.col(f"_to_{n}") - F.coalesce(f"_from_{n}", F.lit(0))).alias(n) for n in what))


def found(nodes: DataFrame, query: str, labelled: DataFrame | None = None) -> DataFrame:
    """T4: (node_id): matches by name, all above them, and all below matching folders. A blank query finds everything."""
    if not query.strip():
        return nodes.select("node_id")
    labelled = labels(nodes) if labelled is None else labelled
    hits = staged(nodes.filter(F.contains(F.lower("name"), F.lit(query.strip().lower()))).select("node_id", "type"))
    marked = labelled.join(hits.select("node_id", F.lit(1).alias("hit")).distinct(), "node_id", "left")
    above = _below(marked, {"hits": F.coalesce("hit", F.lit(0))}).filter("hits > 0").select("node_id")
    return above.unionAll(closure(nodes, hits.filter(F.col("type") == "folder"), labelled)).distinct()


def descendant_counts(nodes: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """T5: folders and files below each node."""
    labelled = labels(nodes) if labelled is None else labelled
    rows = labelled.join(nodes.select("node_id", "type").dropDuplicates(["node_id"]), "node_id")
    own = lambda kind: F.when(F.col("type") == kind, 1).otherwise(0)
    return _below(rows, {"folders": own("folder"), "files": own("file")}).select("node_id", (F.col("folders") - own("folder")).alias("folders"), (F.col("files") - own("file")).alias("files"))


def delete_summary(nodes: DataFrame, picked: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row: folders and files picked, further ones below them by kind, and all, each node once."""
    mine = picked.select("node_id", F.lit(True).alias("_picked")).distinct()
    rows = closure(nodes, picked, labelled).join(nodes.select("node_id", "type"), "node_id").join(mine, "node_id", "left")
    count = lambda kind, own: F.count(F.when((F.col("type") == kind) & (F.col("_picked").isNotNull() if own else F.col("_picked").isNull()), 1))
    return rows.agg(count("folder", True).alias("folders"), count("file", True).alias("files"), count("folder", False).alias("more_folders"), count("file", False).alias("more_files"), F.count("*").alias("total"))


def moves_checked(nodes: DataFrame, moves: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Moves (node_id, to_id) with reason: unknown, self, not_folder, section, descendant, current, or null for allowed."""
    labelled = labels(nodes) if labelled is None else labelled
    a = nodes.select("node_id", "parent_id", F.col("section").alias("_s")).join(labelled.select("node_id", F.col("root_id").alias("_r"), "low", "high"), "node_id")
    b = nodes.select(F.col("node_id").alias("to_id"), F.col("type").alias("_t"), F.col("section").alias("_ts")).join(labelled.select(F.col("node_id").alias("to_id"), F.col("root_id").alias("_tr"), F.col("pre").alias("_tp")), "to_id")
    j = moves.join(a, "node_id", "left").join(b, "to_id", "left")
    below = (F.col("_r") == F.col("_tr")) & (F.col("_tp") >= F.col("low")) & (F.col("_tp") < F.col("high"))
    reason = F.when(F.col("_t").isNull() | F.col("_s").isNull(), "unknown").when(F.col("node_id") == F.col("to_id"), "self").when(F.col("_t") != "folder", "not_folder").when(F.col("_s") != F.col("_ts"), "section").when(below, "descendant").when(F.col("parent_id") == F.col("to_id"), "current")
    return j.select("node_id", "to_id", reason.alias("reason"))


# Fixed value: the name of the top of a section.
TOP = "(최상위)"


def move_targets(nodes: DataFrame, moving: DataFrame, section: str) -> DataFrame:
    """Where a set of nodes (``moving``: node_id) can go: (place, node_id, name, depth, reason), in the order of the tree.

    Place 0 is the top (node_id null). Then come all folders of the section (a folder without one counts), of which those whose parent is no such
    folder stand at the top. ``reason``: self for a moving node, descendant below one, current where all moving nodes are in this very folder; null: allowed.
    """
    mine = moving.select("node_id").distinct().join(nodes, "node_id", "left_semi")
    parents = nodes.join(mine, "node_id", "left_semi").agg(F.countDistinct("parent_id").alias("n"), F.count(F.when(F.col("parent_id").isNull(), 1)).alias("tops"), F.count("*").alias("all"), F.max("parent_id").alias("id")).first()
    current = parents["id"] if parents["n"] == 1 and not parents["tops"] else None
    folders = staged(nodes.filter((F.col("type") == "folder") & (F.coalesce("section", F.lit(section)) == section)))
    order = [name_order(F.col("name")), F.col("name")]
    rows = labels(folders, order).join(folders.select("node_id", "name").dropDuplicates(["node_id"]), "node_id")
    roots = _running(rows.filter("pre = 0").select("root_id", "name", "high", F.lit(0).alias("one")), ["one"], [name_order(F.col("name")), F.col("name"), F.col("root_id")], sums={"upto": F.col("high")})
    rows = rows.join(roots.select("root_id", (F.col("upto") - F.col("high")).alias("before")), "root_id")
    # below a moving node in the whole tree, not only by way of folders of the section
    gone = closure(nodes, mine).withColumn("_below", F.lit(True))
    rows = rows.join(gone, "node_id", "left").join(mine.select("node_id", F.lit(True).alias("_self")), "node_id", "left")
    reason = F.when(F.col("_self"), "self").when(F.col("_below"), "descendant").when(F.col("node_id") == F.lit(current), "current")
    top = nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"), F.lit(TOP).alias("name"), F.lit(0).alias("depth"), F.lit("current" if parents["all"] and parents["tops"] == parents["all"] else None).cast("string").alias("reason"))
    return top.unionByName(rows.select((F.col("before") + F.col("pre") + 1).alias("place"), "node_id", "name", "depth", reason.alias("reason")))


#: Decimal digits of all scripts, and the digits they stand for.
_DIGITS = [(chr(c), str(unicodedata.digit(chr(c)))) for c in range(0x80, maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]


def name_key(name: Column) -> Column:
    """A text in which numbers stand in the order of their values, however long: leading zeros go, and each number stands behind its count of digits, and that behind its own count (two digits)."""
    plain = F.translate(name, "".join(a for a, _ in _DIGITS), "".join(b for _, b in _DIGITS))
    bare = F.regexp_replace(plain, r"(?<![0-9])0+(?=[0-9])", "")
    size = lambda p: F.char_length(p).cast("string")
    pieces = F.regexp_extract_all(bare, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(size(size(p)), 2, "0"), size(p), p)).otherwise(p)), "")


def name_order(name: Column) -> Column:
    """Sorts as Korean does, Hangul first, whatever the case and accents of letters, with numbers by their value."""
    return F.collate(name_key(name), "ko_CI_AI")


def tree_order(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Nodes with place, from 1 in each group of ``by`` (as a rule the parent): folders first, then as ``name_order`` sorts; names that are equal for it go by code points, then by id."""
    kind = F.when(F.col("type") == "folder", 0).otherwise(1)
    return _running(nodes, by, [kind, name_order(F.col("name")), F.col("name"), F.col("node_id")], sums={"place": F.lit(1)})
