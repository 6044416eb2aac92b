"""Exact and near duplicates by letters and digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import BLANK, col, fingerprint, hashed, kept_runs, once, strip, tokens_of_runs
from gazette.operators.folders import shared_folder


def fingerprint_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fingerprint, primary: the least id with the same non-empty fingerprint. The group is aggregated, not collected.

    Fingerprints go to the shared folder first: both sides of the join, and what it filters, read them and not the texts.
    """
    hashed_texts, path = df.select(F.col(id_col), fingerprint(text_col).alias("fingerprint")), shared_folder(df.sparkSession, "fingerprints")
    hashed_texts.write.parquet(path)
    marked = df.sparkSession.read.schema(hashed_texts.schema).parquet(path)
    least = marked.groupBy("fingerprint").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("many"))
    none = F.col("fingerprint") == ""
    return marked.join(least, "fingerprint", "left").select(id_col, "fingerprint", F.when(none, F.col(id_col)).otherwise(F.col("least")).alias("primary"), F.when(none, 1).otherwise(F.col("many")).alias("copies"))


# Critical dates and amounts, and how far one type of source is trusted over another.
CRITICAL = (
    r"[0-9]{4}\s*[.\-/년]\s*[0-9]{1,2}\s*[.\-/월]\s*[0-9]{1,2}|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일|[0-9]{1,2}\s*[./]\s*[0-9]{1,2}",
    r"[0-9][0-9,]*\s*원",
)
MIN_CHARS, MIN_TOKENS = 120, 40
#: Any character that is no white space: told at the first one, without a trimmed copy.
FILLED = "[^" + BLANK[1:]
TYPE_PRIORITY = {"attachment_hwp": 90, "attachment_hwpx": 88, "attachment_pdf": 82, "html_body": 70, "direct_file": 65, "attachment_xlsx": 60, "attachment_image": 50, "inline_image": 45, "attachment": 35}


def critical_numbers(text: Column) -> Column:
    """The digit runs within dates and amounts of money; commas in numbers are left out."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p.replace(r"\s", BLANK)), F.lit(0)) for p in CRITICAL])
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.regexp_extract_all(F.replace(x, F.lit(","), F.lit("")), F.lit("[0-9]+"), F.lit(0)))))


def profile(text: Column | str, own_fingerprint: Column | None = None) -> Column:
    """What the comparison of two sources needs of each text, computed once."""
    text = col(text)
    numbers = F.array_distinct(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit("[0-9]+"), F.lit(0)))

    def judged(runs: Column) -> Column:
        own = hashed(F.array_join(runs, "")) if own_fingerprint is None else own_fingerprint
        return F.struct(own.alias("fingerprint"), tokens_of_runs(runs).alias("tokens"), F.char_length(strip(text)).alias("chars"), critical_numbers(text).alias("critical"), numbers.alias("numbers"))

    return once(kept_runs(text), judged)


def is_duplicate(a: Column, b: Column) -> Column:
    """Whether two profiles are of one content: equal fingerprints; texts of 120 characters or more that are similar to
    0.9 by tokens; or the smaller set, of 40 tokens or more, held to 0.85 by the larger, unless only it has a critical number."""
    same = (a["fingerprint"] != "") & (a["fingerprint"] == b["fingerprint"])
    a_smaller, least, both = F.size(a["tokens"]) <= F.size(b["tokens"]), F.least(F.size(a["tokens"]), F.size(b["tokens"])), F.size(a["tokens"]) + F.size(b["tokens"])
    lost = lambda x, y: F.size(F.array_except(x["critical"], y["numbers"])) > 0

    def by_tokens(common: Column) -> Column:
        either = both - common  # tokens are distinct
        similar = (a["chars"] >= MIN_CHARS) & (b["chars"] >= MIN_CHARS) & (either > 0) & (common * 10 >= either * 9)
        return similar | ((least >= MIN_TOKENS) & (common * 20 >= least * 17) & ~F.when(a_smaller, lost(a, b)).otherwise(lost(b, a)))

    return F.coalesce(same, F.lit(False)) | once(F.size(F.array_intersect(a["tokens"], b["tokens"])), by_tokens)


def duplicate_pairs(items: Column | str) -> Column:
    """Array of struct of a and b: orders of the pairs of a group's sources, a before b, that are duplicates. items: array of struct of i (order) and p (profile)."""
    return F.flatten(F.transform(items, lambda a: F.transform(F.filter(items, lambda b: (a["i"] < b["i"]) & is_duplicate(a["p"], b["p"])), lambda b: F.struct(a["i"].alias("a"), b["i"].alias("b")))))


def assign_roles(sources: DataFrame, group: str = "notice_id", order: str = "order_index", text: str = "raw_text", kind: str = "source_type", status: str = "status", priority: dict[str, int] | None = None) -> DataFrame:
    """Add source_role, duplicate_of (an order) and place of each source: greedy groups, their best member, and the order of the bests.

    Each source joins the first group that has a duplicate of it; groups are never merged, which makes this a fold
    over the sources of a notice in their order. Of each group the best stands for it: among texts of 0.9 of the longest
    or more a body, else the highest priority, then the longest. Sources of other groups' notices never meet. Each
    text is read once; its profile goes to its notice's row, where the pairs are judged.
    """
    ok = col(text).isNotNull() & col(text).rlike(FILLED) & col(status).isin("success", "partial_success")
    ranks = F.coalesce(F.create_map(*[F.lit(x) for kv in (priority or TYPE_PRIORITY).items() for x in kv])[F.col(kind)], F.lit(0))
    rows = sources.withColumn("_ok", ok)
    item = F.struct(F.col(order).alias("i"), ranks.alias("rank"), F.char_length(text).alias("n"), (F.col(kind) == "html_body").alias("body"), profile(text).alias("p"))
    items = rows.where("_ok").groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("_items")).withColumn("_pairs", duplicate_pairs("_items"))
    none = F.array().cast("array<array<int>>")

    def place(groups: Column, x: Column) -> Column:
        linked = lambda g: F.exists("_pairs", lambda p: (p["b"] == x["i"]) & F.array_contains(g, p["a"]))
        at = F.aggregate(F.sequence(F.lit(0), F.size(groups)), F.lit(-1), lambda found, k: F.when((found < 0) & (k < F.size(groups)) & F.coalesce(linked(F.get(groups, k)), F.lit(False)), k).otherwise(found))
        added = F.transform(groups, lambda g, k: F.when(k == at, F.concat(g, F.array(x["i"]))).otherwise(g))
        return F.when(at < 0, F.concat(groups, F.array(F.array(x["i"])))).otherwise(added)

    grouped = items.withColumn("_groups", F.aggregate("_items", none, place))

    def best(g: Column) -> Column:
        mine = F.filter("_items", lambda x: F.array_contains(g, x["i"]))
        near = F.filter(mine, lambda x: x["n"] >= F.array_max(F.transform(mine, lambda y: y["n"])) * 0.9)
        body = F.filter(near, lambda x: x["body"])
        chosen = F.array_max(F.transform(near, lambda x: F.struct(x["rank"].alias("rank"), x["n"].alias("n"), (-x["i"]).alias("back"))))
        return F.when(F.size(body) > 0, F.get(body, F.lit(0))["i"]).otherwise(-chosen["back"])

    heads = grouped.select(group, "_items", F.transform("_groups", lambda g: F.struct(g.alias("members"), best(g).alias("best"))).alias("_heads"))
    bests = F.filter("_items", lambda x: F.exists("_heads", lambda h: h["best"] == x["i"]))
    ranked = F.array_sort(F.transform(bests, lambda x: F.struct((-x["rank"]).alias("r"), (-x["n"]).alias("n"), x["i"].alias("i"))))
    out = rows.join(heads.withColumn("_ranked", ranked).drop("_items"), group, "left")
    mine = F.get(F.filter("_heads", lambda h: F.array_contains(h["members"], F.col(order))), F.lit(0))["best"]
    role = F.when(~F.col("_ok"), "excluded").when(mine == F.col(order), "primary").otherwise("duplicate")
    at = F.array_position(F.transform("_ranked", lambda x: x["i"]), F.col(order))
    return out.select(*sources.columns, role.alias("source_role"), F.when(F.col("_ok") & (mine != F.col(order)), mine).alias("duplicate_of"), F.when(F.col("_ok") & (mine == F.col(order)), at).alias("place"))
