"""Versioned edits: renames that cascade, snapshots, reverts, upserts and merges, all as joins that give a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of the same key."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def removed(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys of both; where both have a value the new one wins."""
    side = new.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    return old.join(side, key, "full").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in old.columns if c != key])


def added(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key the table lacks; applying it twice changes nothing."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def next_version(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def rename_plan(slots: DataFrame, renames: DataFrame) -> DataFrame:
    """(vt_id, slot_index, before, after): which slot each rename (vt_id, before, after and perhaps slot_index) takes.

    Only extended slots. By name, the renames of one name take the slots of that name in turn, in order of after and slot_index; with a
    slot_index that slot is taken whatever its name. Of renames that take the same slot the one by index counts.
    """
    ours = slots.where(F.col("origin") == "extended").select("vt_id", "slot_index", F.col("name").alias("before"))
    place = lambda *order: F.row_number().over(Window.partitionBy("vt_id", "before").orderBy(*order))
    exact = None
    if "slot_index" in renames.columns:
        exact = renames.where("slot_index is not null").join(ours.select("vt_id", "slot_index"), ["vt_id", "slot_index"]).groupBy("vt_id", "slot_index").agg(F.min(F.struct("after", "before")).alias("r"))
        exact = exact.select("vt_id", "slot_index", "r.before", "r.after")
        ours, renames = ours.join(exact.select("vt_id", "slot_index"), ["vt_id", "slot_index"], "left_anti"), renames.where("slot_index is null")
    asked = renames.select("vt_id", "before", "after").distinct().withColumn("turn", place("after"))
    found = ours.withColumn("turn", place("slot_index")).join(asked, ["vt_id", "before", "turn"]).select("vt_id", "slot_index", "before", "after")
    return found if exact is None else found.unionByName(exact)


def renamed(slots: DataFrame, renames: DataFrame) -> DataFrame:
    """Slots (vt_id, slot_index, name, origin, ...) after the renames of a batch, all applied to the state before it: a to b together with b to c doesn't chain."""
    plan = rename_plan(slots, renames).select("vt_id", "slot_index", "after")
    return slots.join(plan, ["vt_id", "slot_index"], "left").withColumn("name", F.coalesce("after", "name")).select(*slots.columns)


def cascaded(table: DataFrame, renames: DataFrame, columns: list[str]) -> DataFrame:
    """The same renames in several columns of a table with vt_id; each value is mapped once, and of several renames of a name the first counts."""
    first = renames.groupBy("vt_id", "before").agg(F.min("after").alias("__after"))
    for c in columns:
        table = table.join(first.withColumnRenamed("before", c), ["vt_id", c], "left").withColumn(c, F.coalesce("__after", c)).drop("__after")
    return table


def touched_by(table: DataFrame, renames: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of which any of the columns has a name that is renamed."""
    names = renames.select("vt_id", "before").distinct().groupBy("vt_id").agg(F.collect_set("before").alias("__names"))
    rows = table.join(names, "vt_id")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.array_contains("__names", F.col(c)), F.lit(False))
    return rows.where(hit).select(*table.columns)


def cascade(slots: DataFrame, results: DataFrame, reviews: DataFrame, renames: DataFrame, version: int, columns: list[str]) -> dict[str, DataFrame]:
    """One batch of renames everywhere at once: slots, the named columns of results, and the decided slots of reviews.

    Gives the three tables after it, the log (version, vt_id, slot_index or -1 where no slot was taken, before, after), the rows of results and
    reviews before it, and the tallies (what, n). With the log and these rows all of it can be reverted.
    """
    plan = rename_plan(slots, renames)
    log = renames.select("vt_id", "before", "after").join(plan, ["vt_id", "before", "after"], "left").select(F.lit(version).alias("version"), "vt_id", F.coalesce("slot_index", F.lit(-1)).alias("slot_index"), "before", "after")
    old, seen = touched_by(results, renames, columns), touched_by(reviews, renames, ["decision_slot"])
    tally = lambda rows, what: rows.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return {
        "slots": renamed(slots, renames), "results": cascaded(results, renames, columns), "reviews": cascaded(reviews, renames, ["decision_slot"]), "log": log,
        "results_before": old, "reviews_before": seen, "tallies": tally(plan, "slots").unionByName(tally(old, "results")).unionByName(tally(seen, "reviews")),
    }


def rename_log(before: DataFrame, after: DataFrame, version: int) -> DataFrame:
    """What changed, by slot_index: the before-image that a revert needs."""
    side = after.select("vt_id", "slot_index", F.col("name").alias("after"))
    rows = before.join(side, ["vt_id", "slot_index"]).where(F.col("name") != F.col("after"))
    return rows.select(F.lit(version).alias("version"), "vt_id", "slot_index", F.col("name").alias("before"), "after")


def reverted(slots: DataFrame, log: DataFrame, to_version: int) -> DataFrame:
    """Slots with all logged renames after to_version undone, whatever their order: of each slot the oldest before-image counts."""
    oldest = log.where(F.col("version") > to_version).groupBy("vt_id", "slot_index").agg(F.min_by("before", "version").alias("before"))
    return slots.join(oldest, ["vt_id", "slot_index"], "left").withColumn("name", F.coalesce("before", "name")).select(*slots.columns)


def promoted(slots: DataFrame, library: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, library): members (vt_id, name, base_name) become references to a base slot; role and place stay. Base names that are new join the library with the first member's role."""
    side = members.select("vt_id", "name", "base_name")
    out = slots.join(side, ["vt_id", "name"], "left")
    hit = F.col("base_name").isNotNull() & (F.col("origin") == "extended")
    new = out.where(hit).groupBy(F.col("base_name").alias("name")).agg(F.min_by("role", F.struct("vt_id", "slot_index")).alias("role")).join(library.select("name"), "name", "left_anti")
    out = out.withColumns({"origin": F.when(hit, "base").otherwise(F.col("origin")), "name": F.when(hit, F.col("base_name")).otherwise(F.col("name"))})
    return out.select(*slots.columns), library.unionByName(new, allowMissingColumns=True)


def snapshot(table: DataFrame, touched: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The rows that an edit is about to touch, under its version."""
    return table.join(touched.select(*keys).distinct(), keys, "left_semi").withColumn("version", F.lit(version))


def restored(table: DataFrame, shots: DataFrame, keys: list[str], after_version: int) -> DataFrame:
    """The table with every key that was touched after a version as it was before; the oldest snapshot of a key counts."""
    later = shots.where(F.col("version") > after_version)
    first = later.groupBy(*keys).agg(F.min("version").alias("version"))
    old = later.join(first, [*keys, "version"]).drop("version")
    return removed(table, first, keys).unionByName(old.select(*table.columns))


def synced(slots: DataFrame, seeds: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Manual rows stay and beat seeds of the same key; in touched topics old seeds go for the new ones; other topics are left alone."""
    scope = touched.select("vt_id").distinct()
    outside = slots.join(scope, "vt_id", "left_anti")
    manual = slots.join(scope, "vt_id", "left_semi").where(F.col("source") == "manual")
    return outside.unionByName(manual).unionByName(seeds.join(scope, "vt_id", "left_semi").join(manual.select(*keys), keys, "left_anti").select(*slots.columns))


def backfill(mapped: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, comment, outcome): reviewed columns that are added, whose empty comment is filled, or that are there already."""
    old, new = mapped.select(*keys, F.col("comment").alias("old"), F.lit(1).alias("there")), reviewed.select(*keys, F.col("comment").alias("new"), F.lit(1).alias("asked"))
    empty = F.coalesce(F.trim("old"), F.lit("")) == ""
    kind = F.when(F.col("there").isNull(), "added").when(F.col("asked").isNull(), "kept").when(empty & F.col("new").isNotNull(), "filled").otherwise("same")
    return old.join(new, keys, "full").select(*keys, F.when(kind == "added", F.col("new")).when(kind == "filled", F.col("new")).otherwise(F.col("old")).alias("comment"), kind.alias("outcome"))


def backfilled(mapped: DataFrame, reviewed: DataFrame, slots: DataFrame) -> DataFrame:
    """(vt_id, slot, table, field, comment, outcome) of mapped and reviewed columns (vt_id, slot, table, field, comment) against slots (vt_id, name).

    A reviewed column whose topic or slot isn't there changes nothing: missing topic, missing slot. The others are added, fill an empty comment, or are the same; what
    wasn't reviewed is kept. Counting the outcomes gives the counters of the edit. Repeats of a key count once, by their least comment.
    """
    keys = ["vt_id", "slot", "table", "field"]
    once = lambda df: df.groupBy(*keys).agg(F.min("comment").alias("comment"))
    topics, names = slots.select("vt_id").distinct().withColumn("_topic", F.lit(True)), slots.select("vt_id", F.col("name").alias("slot")).distinct().withColumn("_slot", F.lit(True))
    asked = once(reviewed).join(topics, "vt_id", "left").join(names, ["vt_id", "slot"], "left")
    lost = asked.where("_slot is null").select(*keys, "comment", F.when(F.col("_topic").isNull(), "missing topic").otherwise("missing slot").alias("outcome"))
    return backfill(once(mapped), asked.where("_slot").select(*keys, "comment"), keys).unionByName(lost)


def absorbed(bridge: DataFrame, merges: DataFrame) -> DataFrame:
    """(vt_id, table, ord) after merges (primary, absorbed): the primary's tables first, then those of the absorbed that it lacks."""
    moved = bridge.join(merges.select(F.col("absorbed").alias("vt_id"), "primary"), "vt_id", "left")
    rows = moved.select(F.coalesce("primary", "vt_id").alias("vt_id"), "table", F.struct(F.col("primary").isNotNull().alias("late"), F.col("vt_id").alias("was"), "ord").alias("place"))
    return rows.groupBy("vt_id", "table").agg(F.min("place").alias("place")).select("vt_id", "table", "place.late", "place.was", "place.ord")


def category_renamed(scaffold: DataFrame, level: int, before: str, after: str) -> DataFrame:
    """l2_path with one level renamed."""
    at = level - 1
    path = F.col("l2_path")
    return scaffold.withColumn("l2_path", F.transform(path, lambda x, i: F.when((i == at) & (x == before), F.lit(after)).otherwise(x)))


def anchored(rows: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Names (the last of keys) of reviewed columns as further aliases of their slot, for all columns but the reviewed one itself. The names of a slot are gathered once."""
    alias = keys[-1]
    names = reviewed.groupBy("vt_id", "slot", F.col(alias).alias("_alias")).agg(F.count("*").alias("_n")).groupBy("vt_id", "slot").agg(F.array_sort(F.collect_list(F.struct("_alias", "_n"))).alias("_names"))
    own = reviewed.groupBy(*keys, "vt_id", "slot").agg(F.count("*").alias("_own"))
    found = rows.join(names, ["vt_id", "slot"], "left").join(own, [*keys, "vt_id", "slot"], "left")
    others = F.filter("_names", lambda x: (x["_alias"] != F.col(alias)) | (x["_n"] > F.coalesce("_own", F.lit(0))))
    more = F.coalesce(F.transform(others, lambda x: x["_alias"]), F.array().cast("array<string>"))
    return found.withColumn("aliases", F.array_distinct(F.concat("aliases", more))).select(*rows.columns)


def decided(results: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Review decisions over computed ones: take and new set the slot, noise and skip the status; the computed score stays."""
    d = F.col("decision")
    rows = results.join(reviews.select(*keys, "decision", "decision_slot"), keys, "left")
    status: Column = F.when(d.isin("take_top1", "take_top2", "take_top3"), "manual").when(d == "new_slot", "manual_new").when(d.isin("noise", "skip"), d).otherwise(F.col("status"))
    return rows.withColumn("slot", F.when(d.isin("noise", "skip"), F.lit(None)).otherwise(F.coalesce("decision_slot", "slot"))).withColumn("status", status).drop("decision", "decision_slot")


def extra_candidates(columns: DataFrame, bridge: DataFrame, slots: DataFrame, library: DataFrame, reviews: DataFrame, taken: list[str], matched: DataFrame | None = None) -> DataFrame:
    """(vt_id, table, field) of the columns that a topic may need further slots for.

    columns (table, field, comment) are those that are used, not empty and no noise; they belong to the topics of their table. What a review has
    taken (decision in `taken`) goes, and what `matched` (vt_id, table, field) lists, where it is given. So does a column that is covered: its name or comment
    holds, in any case and with two characters at least, a name, alias or library label of the topic's slots, or the name or comment of a taken column.
    """
    from tessera.operators.containment import containing

    key = ["vt_id", "table", "field"]
    confirmed = reviews.where(F.col("decision").isin(*taken)).select(*key).distinct()
    rows = columns.select("table", "field", F.lower("field").alias("_name"), F.lower(F.trim("comment")).alias("_comment")).join(bridge.select("vt_id", "table").distinct(), "table")
    known = slots.select("vt_id", "origin", "name", "aliases").join(library.select("name", F.col("label").alias("_label")), "name", "left")
    label = F.when(F.col("origin") == "base", F.col("_label"))
    parts = known.select("vt_id", F.explode(F.concat(F.array(F.col("name"), label), "aliases")).alias("part"))
    seeds = confirmed.join(columns.select("table", "field", "comment"), ["table", "field"], "left").select("vt_id", F.explode(F.array("field", "comment")).alias("part"))
    parts = parts.unionByName(seeds).select("vt_id", F.lower("part").alias("part")).where(F.length("part") >= 2).distinct()
    texts = rows.select(*key, F.explode(F.array("_name", "_comment")).alias("text")).where("text is not null")
    covered = texts.join(containing(texts, parts), "text").join(parts, ["vt_id", "part"], "left_semi").select(*key).distinct()
    left = rows.select(*key).distinct().join(covered, key, "left_anti").join(confirmed, key, "left_anti")
    return left if matched is None else left.join(matched.select(*key).distinct(), key, "left_anti")


def slot_errors(new: DataFrame, library: DataFrame) -> DataFrame:
    """(vt_id, slot_index, error) of slots that can't replace a topic's: no name, a repeated name, an unknown origin, a base name the library lacks."""
    rows = new.withColumn("times", F.count("*").over(Window.partitionBy("vt_id", "name"))).join(library.select("name", F.lit(True).alias("known")), "name", "left")
    error = F.when(F.coalesce("name", F.lit("")) == "", "no name").when(F.col("times") > 1, "repeated").when(~F.col("origin").isin("base", "extended"), "origin").when((F.col("origin") == "base") & F.col("known").isNull(), "unknown base")
    return rows.withColumn("error", error).where("error is not null").select("vt_id", "slot_index", "error")


def checked(ops: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """ops with `error`: the first rule that an edit breaks; null for an edit that may be applied."""
    error = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        error = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(error)
    return ops.withColumn("error", error)


def with_mark(ops: DataFrame, table: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """ops with a boolean column: whether the table has their keys. Nulls equal nulls."""
    side = table.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__there", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return ops.join(side, same, "left").withColumn(mark, F.col("__there").isNotNull()).drop("__there", *[f"__{k}" for k in keys])


def categories_edited(scaffold: DataFrame, categories: DataFrame, ops: DataFrame) -> DataFrame:
    """ops (action, name, new_name) on first-level categories, each with its error: a rename needs a new name that isn't there, a delete a category that no topic has."""
    rows = with_mark(with_mark(ops, categories, ["name"], "there"), scaffold.select(F.col("l1").alias("name")), ["name"], "used")
    taken = categories.select(F.col("name").alias("__new")).distinct().withColumn("taken", F.lit(True))
    rows = rows.join(taken, F.col("new_name") == F.col("__new"), "left")
    rename, delete = F.col("action") == "rename", F.col("action") == "delete"
    return checked(rows, [(~F.col("there"), "missing"), (rename & (F.coalesce("new_name", F.lit("")).isin("") | (F.col("new_name") == F.col("name"))), "no new name"), (rename & F.col("taken"), "name taken"), (delete & F.col("used"), "in use")]).select(*ops.columns, "error")


def rules_edited(rules: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, ops with error) for ops (action add or remove, kind, value, table_en). Kinds are exact, glob and pair; a pair needs a table. What is there isn't added again."""
    keys = ["kind", "value", "table_en"]
    rows = with_mark(ops, rules, keys, "there")
    add, remove = F.col("action") == "add", F.col("action") == "remove"
    rows = checked(rows, [(~F.col("kind").isin("exact", "glob", "pair"), "unknown kind"), (F.coalesce("value", F.lit("")) == "", "no value"), ((F.col("kind") == "pair") & F.col("table_en").isNull(), "no table"), (add & F.col("there"), "there already"), (remove & ~F.col("there"), "missing")]).drop("there")
    fine = rows.where("error is null")
    left = with_mark(rules.select(*keys), fine.where(F.col("action") == "remove"), keys, "gone").where(~F.col("gone")).drop("gone")
    return left.unionByName(fine.where(F.col("action") == "add").select(*keys).distinct()), rows


TABLE_TYPES = ("entity", "fact", "aggregate", "dictionary")


def topics_edited(scaffold: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scaffold, audit) for ops (action create, edit or delete, vt_id, topic, table_type, l1, l2): one op a topic.

    A null of an edit leaves the old value. Creating takes a free id, a topic and a path; a type must be one of TABLE_TYPES. The audit has each op's
    error, or the topic before and after it; an edit that goes through clears the topic's review_hint, if the table has one.
    """
    fields = ["topic", "table_type", "l1", "l2"]
    old = scaffold.select("vt_id", *[F.col(c).alias(f"old_{c}") for c in fields], F.lit(True).alias("there"))
    rows = ops.join(old, "vt_id", "left")
    there, create = F.col("there").isNotNull(), F.col("action") == "create"
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = checked(rows, [
        (create & there, "there already"), (~create & ~there, "missing"), ((F.col("action") != "delete") & ~F.coalesce(F.col("table_type").isin(*TABLE_TYPES), ~create), "unknown type"), (create & empty("topic"), "no topic"),
        ((create & empty("l1")) | ((F.col("action") == "edit") & (F.trim("l1") == "")), "no path"),
    ])
    fine = rows.where("error is null")
    said = lambda cols: F.concat_ws("/", *[F.coalesce(c, F.lit("-")) for c in cols])
    new = {c: F.when(F.col("action") == "delete", F.lit(None)).otherwise(F.coalesce(c, f"old_{c}")) for c in fields}
    audit = rows.select("action", "vt_id", "error", F.when(F.col("error").isNull() & there, said([f"old_{c}" for c in fields])).alias("before"), F.when(F.col("error").isNull() & (F.col("action") != "delete"), said(list(new.values()))).alias("after"))
    kept = removed(scaffold, fine, ["vt_id"])
    others = scaffold.select("vt_id", *[c for c in scaffold.columns if c not in ("vt_id", "review_hint", *fields)])
    made = fine.where("action <> 'delete'").select("vt_id", *[x.alias(c) for c, x in new.items()]).join(others, "vt_id", "left")
    return kept.unionByName(made, allowMissingColumns=True).select(*scaffold.columns), audit


def library_edited(library: DataFrame, slots: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(library, ops with error) for ops (action create, alias or delete, name, role, label): names are snake_case and unique, what slots refer to stays."""
    rows = with_mark(with_mark(ops, library, ["name"], "there"), slots.where(F.col("origin") == "base"), ["name"], "used")
    create = F.col("action") == "create"
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = checked(rows, [(create & ~F.coalesce(F.col("name").rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.lit(False)), "bad name"), (create & F.col("there"), "there already"), (~create & ~F.col("there"), "missing"), ((create | (F.col("action") == "alias")) & none("label"), "no label"), (create & none("role"), "no role"), ((F.col("action") == "delete") & F.col("used"), "in use")]).drop("there", "used")
    fine = rows.where("error is null")
    left = removed(library, fine.where("action = 'delete'"), ["name"]).join(fine.where("action = 'alias'").select("name", F.col("label").alias("__label")), "name", "left").withColumn("label", F.coalesce("__label", "label")).drop("__label")
    return left.select(*library.columns).unionByName(fine.where("action = 'create'").select("name", "role", "label"), allowMissingColumns=True), rows


def slots_replaced(slots: DataFrame, scaffold: DataFrame, library: DataFrame, reviews: DataFrame, new: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slots, reviews, refused (vt_id, error)) after whole slot lists of topics, new (vt_id, slot_index, name, origin, role), have replaced the old ones.

    A topic is replaced whole or not at all: it is refused for the least of the errors of its slots, or as unknown where the scaffold lacks it. One that only the
    scaffold knows gets its first slots. Names are trimmed. Reviews of replaced topics that decided on a slot that is gone go; those without a slot stay. seeds (table, field, vt_id,
    decision_slot) of replaced topics become reviews (use_slot) in place of those of the same column, if their slot is in the new list.
    """
    new = new.withColumn("name", F.trim("name"))
    unknown = new.select("vt_id").distinct().join(scaffold.select("vt_id"), "vt_id", "left_anti").withColumn("error", F.lit("unknown topic"))
    refused = slot_errors(new, library).select("vt_id", "error").unionByName(unknown).groupBy("vt_id").agg(F.min("error").alias("error"))
    fine = new.join(refused, "vt_id", "left_anti")
    scope, valid = fine.select("vt_id").distinct(), fine.select("vt_id", F.col("name").alias("decision_slot"))
    kept = removed(slots, scope, ["vt_id"])
    inside = reviews.join(scope, "vt_id", "left_semi")
    lost = inside.where(F.coalesce(F.trim("decision_slot"), F.lit("")) != "").join(valid, ["vt_id", "decision_slot"], "left_anti")
    key = ["table", "field", "vt_id"]
    sown = seeds.join(valid, ["vt_id", "decision_slot"], "left_semi").groupBy(*key).agg(F.min("decision_slot").alias("decision_slot")).withColumn("decision", F.lit("use_slot"))
    left = removed(reviews, lost.select(*key, "decision_slot"), [*key, "decision_slot"])
    return kept.unionByName(fine.select(*[c for c in slots.columns if c in fine.columns]), allowMissingColumns=True).select(*slots.columns), upsert(left, sown, key).select(*reviews.columns), refused


def proposals_applied(proposals: DataFrame, base: DataFrame, domain: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(proposals, base, domain, log) after decisions (proposal_id, decision, renamed_to, target) on pending proposals (proposal_id, name, label, role, scope, status, renamed_to).

    accept and rename put the proposal into the library of its target, or scope if none is given: base, domain, or vt_local, which changes no library. reject
    only ends it. The log has each decision with where it was applied, or its error: an unknown decision, a missing proposal, one that isn't pending, a rename without a
    name, an unknown target, a name that the library has, or a second decision on a proposal or name of the batch (the first by id and decision counts).
    """
    known = proposals.select("proposal_id", "name", "label", "role", "scope", F.col("status").alias("was"), F.lit(True).alias("there"))
    rows = decisions.join(known, "proposal_id", "left").withColumns({"target": F.coalesce("target", "scope"), "final": F.when(F.col("decision") == "rename", F.trim("renamed_to")).otherwise(F.col("name"))})
    takes = F.col("decision").isin("accept", "rename")
    held = base.select(F.col("name").alias("final"), F.lit("base").alias("target")).unionByName(domain.select(F.col("name").alias("final"), F.lit("domain").alias("target"))).distinct().withColumn("taken", F.lit(True))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("proposal_id", "decision", F.col("renamed_to"), F.col("target")))
    rows = rows.join(held, ["target", "final"], "left")
    rows = checked(rows, [
        (~F.col("decision").isin("accept", "reject", "rename"), "unknown decision"), (F.col("there").isNull(), "missing"), (F.col("was") != "pending", "not pending"), ((F.col("decision") == "rename") & (F.coalesce("final", F.lit("")) == ""), "no new name"),
        (takes & ~F.coalesce(F.col("target").isin("base", "domain", "vt_local"), F.lit(False)), "unknown target"), (takes & F.col("taken"), "name taken"),
    ])
    rows = rows.withColumn("_turn", first("proposal_id", F.col("error").isNull())).withColumn("error", F.when(F.col("error").isNull() & (F.col("_turn") > 1), "decided already").otherwise(F.col("error")))
    library = takes & F.col("target").isin("base", "domain")
    rows = rows.withColumn("_turn", first("target", "final", F.col("error").isNull() & library)).withColumn("error", F.when(F.col("error").isNull() & library & (F.col("_turn") > 1), "name taken").otherwise(F.col("error")))
    fine = rows.where("error is null")
    status = F.when(F.col("decision") == "accept", "accepted").when(F.col("decision") == "rename", "renamed").otherwise("rejected")
    said = fine.select("proposal_id", status.alias("_status"), F.when(F.col("decision") == "rename", F.col("final")).alias("_name"))
    after = proposals.join(said, "proposal_id", "left").withColumns({"status": F.coalesce("_status", "status"), "renamed_to": F.coalesce("_name", "renamed_to")}).select(*proposals.columns)
    made = lambda target: fine.where(takes & (F.col("target") == target)).select(F.col("final").alias("name"), "label", "role")
    log = rows.select("proposal_id", "decision", F.when(F.col("error").isNull(), F.when(takes, F.col("target")).otherwise("none")).alias("applied_to"), "error")
    return after, base.unionByName(made("base"), allowMissingColumns=True), domain.unionByName(made("domain"), allowMissingColumns=True), log


def categories_applied(scaffold: DataFrame, categories: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scaffold, categories, ops with error): accepted renames in the categories (name) and in l1 of all their topics, accepted deletes from the categories. Renames of a batch don't chain; of two of one name the lesser new name counts."""
    rows = categories_edited(scaffold, categories, ops)
    renames = rows.where("error is null and action = 'rename'").groupBy("name").agg(F.min("new_name").alias("_new"))
    gone = rows.where("error is null and action = 'delete'")
    left = removed(categories, gone, ["name"]).join(renames, "name", "left").withColumn("name", F.coalesce("_new", "name")).select(*categories.columns).distinct()
    moved = scaffold.join(renames.withColumnRenamed("name", "l1"), "l1", "left").withColumn("l1", F.coalesce("_new", "l1")).select(*scaffold.columns)
    return moved, left, rows


def topics_merged(scaffold: DataFrame, bridge: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scaffold, bridge, merges) after the pending merges (primary, absorbed, status) between topics that are there: absorbed topics go, their tables that the
    primary lacks follow its own, and the merge is merged. A merge whose topics aren't both there, or whose primary is absorbed itself, stays pending."""
    there = scaffold.select("vt_id")
    pending = merges.where("status = 'pending' and primary <> absorbed").join(there.withColumnRenamed("vt_id", "primary"), "primary", "left_semi").join(there.withColumnRenamed("vt_id", "absorbed"), "absorbed", "left_semi")
    pending = pending.groupBy("absorbed").agg(F.min("primary").alias("primary"))
    done = pending.join(pending.select(F.col("absorbed").alias("primary")), "primary", "left_anti")
    tables = absorbed(bridge, done.select("primary", "absorbed"))
    order = Window.partitionBy("vt_id").orderBy("late", "was", "ord", "table")
    tables = tables.withColumn("ord", F.row_number().over(order) - 1).select(*bridge.columns)
    log = merges.join(done.withColumn("_done", F.lit(True)), ["primary", "absorbed"], "left").withColumn("status", F.when(F.col("_done") & (F.col("status") == "pending"), "merged").otherwise(F.col("status"))).select(*merges.columns)
    return removed(scaffold, done.select(F.col("absorbed").alias("vt_id")), ["vt_id"]), tables, log
