"""Fuzzy linkage: ranked candidates for people, one-to-one matching for titles, master merge."""
from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cells import strip
from ..functions.text import hospital_key, name_tokens, title_key
from .lineage import checkpointed
from .ordering import numbered, smallest_per_key
from .similarity import (
    TOKEN_RATIO, by_shuffle, matching_tokens, ratio_column, spread,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TITLE_RATIO = 0.78
#: Titles are matched at these ratios first; what they settle is not compared at lower ones.
BANDS = (0.9,)


def _people(df, id_col, name_col, hospital_col):
    tokens = F.array_sort(name_tokens(df[name_col]))
    return df.select(
        F.col(id_col).alias("id"), tokens.alias("tokens"),
        F.array_join(tokens, " ").alias("name"),
        hospital_key(df[hospital_col]).alias("hospital")).where(F.size("tokens") > 0)


def _vocabulary(sets):
    return sets.select(F.explode("tokens").alias("token")).distinct()


#: Pairs of names beyond which a word's pairs are counted by class; see ``fuzzy_candidates``.
COMMON = 100_000


def _names(people: DataFrame, key: str) -> DataFrame:
    """Each distinct name with its words and a number."""
    return checkpointed(people.groupBy("name").agg(F.any_value("tokens").alias("tokens"))
                        .withColumn(key, F.monotonically_increasing_id()))


def _classes(names: DataFrame, key: str, held: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Names with their class, and the classes: how many words, and which common ones (``held``)."""
    of_key = held.groupBy(key).agg(F.array_sort(F.collect_set("left_token")).alias("common"))
    empty = F.array().cast("array<string>")
    told = checkpointed(names.select("name", key, F.size("tokens").alias("size")).join(
        of_key, key, "left").withColumn("common", F.coalesce("common", empty)))
    classes = checkpointed(told.select("common", "size").distinct()
                           .withColumn(name, F.monotonically_increasing_id()))
    return checkpointed(told.join(classes, ["common", "size"])), classes


def fuzzy_candidates(left: DataFrame, right: DataFrame, id_col: str, name_col: str,
                     hospital_col: str, top: int = 3, min_name: float = 0.0,
                     method: str = "sequence", token_ratio: float = TOKEN_RATIO,
                     common: int = COMMON) -> DataFrame:
    """The ``top`` right-hand candidates of every left record, never auto-accepted.

    A candidate has a near word in common with the record's name, or the same hospital number. Its
    score is the mean of the name score (the share of the longer name's words that have a near match
    in the other name) and the hospital-number score (1 equal, 0 different, 0.5 when either side has
    no usable number). Equal scores rank by id, and ``ties`` says how many candidates share the
    score. ``min_name`` only hides listed candidates, after ranking.

    Names are compared once per distinct spelling, and one by one only if they share a rare word. A
    word is common if the left names that hold it times the right names near it are more than
    ``common``. What names share in common words follows from their classes (number of words, and
    common words held or met), so whole classes are scored, and all records of a hospital number
    at once where no word is shared. Such a score is the least that a record of the class can have.
    So the best ``top`` by class and by name together, each record at its highest score, are the best
    of all, and names that were compared are taken out of their class's count: the result is exact.

    For one left name and hospital number, only a name's or class's smallest ids with the same
    number, with no number, and with any number can make the list, so those short lists stand in
    for all its records.
    """
    people, others = _people(left, id_col, name_col, hospital_col), \
        _people(right, id_col, name_col, hospital_col)
    left_names, right_names = _names(people, "a"), _names(others, "b")
    matches = checkpointed(matching_tokens(
        _vocabulary(left_names), _vocabulary(right_names), method, token_ratio))
    words = left_names.select("a", F.explode("tokens").alias("left_token"))
    used = right_names.select("b", F.explode("tokens").alias("right_token"))
    uses = used.groupBy("right_token").agg(F.count(F.lit(1)).alias("_uses"))
    met = matches.join(by_shuffle(uses), "right_token").groupBy("left_token").agg(F.sum("_uses").alias("_met"))
    frequent = checkpointed(
        words.groupBy("left_token").agg(F.count(F.lit(1)).alias("_held")).join(by_shuffle(met), "left_token")
        .where(F.col("_held") * F.col("_met") > common).select("left_token"))

    left_told, left_classes = _classes(
        left_names, "a", words.join(by_shuffle(frequent), "left_token"), "lc")
    right_told, right_classes = _classes(
        right_names, "b", matches.join(frequent, "left_token").join(by_shuffle(used), "right_token"), "rc")
    asked = checkpointed(people.select("name", F.col("hospital").alias("h")).distinct().join(
        by_shuffle(left_told), "name").drop("name"))
    records = checkpointed(
        others.select("name", F.col("hospital").alias("h"), "id").join(
            by_shuffle(right_told.select("name", "b", "rc")), "name").drop("name")
        .withColumn("_r", F.monotonically_increasing_id()))

    # classes that share a common word, and all records of a number
    shared = left_classes.select("lc", F.col("size").alias("_na"), F.explode("common").alias("_x")) \
        .join(right_classes.select("rc", F.col("size").alias("_nb"), F.explode("common").alias("_x")),
              "_x").groupBy("lc", "rc", "_na", "_nb").agg(F.count(F.lit(1)).alias("_hits"))
    class_keys = asked.select(F.col("lc").alias("k"), "h").distinct()
    by_class = _entries(
        class_keys.join(shared.select(
            F.col("lc").alias("k"), F.col("rc").alias("g"),
            (F.col("_hits") / F.greatest("_na", "_nb")).alias("name_score"),
            F.lit(0.0).alias("least")), "k"),
        _short_lists(records.withColumnRenamed("rc", "g"), top))
    numbers = records.where(F.col("h").isNotNull())
    listed = smallest_per_key(numbers, ["h"], [F.col("id"), F.col("_r")], top).groupBy("h").agg(
        F.collect_list(F.struct("id", "_r")).alias("ids"))
    by_number = class_keys.join(
        numbers.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(listed, "h"), "h").select(
        "k", F.col("h").alias("_h"), F.lit(0.0).alias("name_score"), F.lit(0.5).alias("score"),
        F.lit(None).cast("double").alias("least"), "n", "ids", F.lit(0.5).alias("_s"))
    by_class = checkpointed(by_class.unionByName(by_number.select(by_class.columns)))
    best_of_class = checkpointed(_best(_listed(by_class), top))
    enough = best_of_class.where(F.col("_rank") == top).select(
        F.col("k").alias("lc"), "_h", F.col("_s").alias("_enough"))

    # names that share a rare word; what scores less than the class's list cannot change the result
    near = words.join(frequent, "left_token", "left_anti").join(by_shuffle(matches), "left_token").join(
        by_shuffle(used), "right_token").groupBy("a", "b").agg(F.count_distinct("left_token").alias("_hits"))
    keys = asked.withColumn("_h", F.coalesce("h", F.lit(""))).join(enough, ["lc", "_h"], "left")
    longest = F.greatest("_na", "_nb")
    in_common = F.size(F.array_intersect("_ca", "_cb"))
    pairs = near.join(keys.select("a", F.col("a").alias("k"), "h", F.col("size").alias("_na"),
                                  F.col("common").alias("_ca"), "_enough"), "a") \
        .join(right_told.select("b", F.col("b").alias("g"), F.col("size").alias("_nb"),
                                F.col("common").alias("_cb")), "b") \
        .select("k", "h", "g", "_enough", ((F.col("_hits") + in_common) / longest).alias("name_score"),
                (in_common / longest).alias("least"))
    by_name = checkpointed(_entries(
        pairs, _short_lists(records.withColumnRenamed("b", "g"), top), "_enough").where(
            F.col("_enough").isNull() | (F.col("_s") >= F.col("_enough"))).drop("_enough"))

    of_key = keys.select(F.col("a").alias("k"), "lc", "_h")
    inherited = best_of_class.drop("_rank").withColumnRenamed("k", "lc").join(of_key, ["lc", "_h"]) \
        .drop("lc")
    ranked = _best(_listed(by_name).unionByName(inherited), top)
    answer = ranked.join(of_key, ["k", "_h"]) \
        .join(_levels(by_class).select(F.col("k").alias("lc"), "_h", "_s", F.col("n").alias("_nc")),
              ["lc", "_h", "_s"], "left") \
        .join(_levels(by_name), ["k", "_h", "_s"], "left") \
        .select(F.col("k").alias("a"), "_h", F.col("id").alias("candidate_id"), "name_score", "score",
                (F.coalesce("_nc", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("ties"),
                F.col("_rank").alias("rank"))
    return people.select("id", "name", F.coalesce("hospital", F.lit("")).alias("_h")) \
        .join(by_shuffle(left_told.select("name", "a")), "name").join(by_shuffle(answer), ["a", "_h"]) \
        .where(F.col("name_score") >= min_name).select(
        "id", "candidate_id", "name_score", "score", "ties", "rank")


def _short_lists(records: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Record counts and the smallest ids of each group ``g``: by number ``h``, and in all.

    Records without an id are counted; only a number unlike the one asked with lists them."""
    by_number = records.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))
    keyed = records.select("g", "h", "id", "_r", F.col("id").isNull().alias("_none"))
    first = smallest_per_key(keyed, ["g", "h", "_none"], [F.col("id"), F.col("_r")], top)
    ids = F.collect_list(F.struct("id", "_r"))
    numbered_ids, named = first.where(F.col("h").isNotNull()), first.where(~F.col("_none"))
    same = by_number.where(F.col("h").isNotNull()).withColumnRenamed("n", "n_same").join(
        named.where(F.col("h").isNotNull()).groupBy("g", "h").agg(ids.alias("ids_same")),
        ["g", "h"], "left")
    # dealt over the numbers where ids are missing, so that leaving one number out leaves enough
    with_number = smallest_per_key(
        numbered_ids.withColumnRenamed("_rank", "_turn"), ["g", "_none"],
        [F.col("id"), F.col("_turn"), F.col("h"), F.col("_r")], 2 * top).groupBy("g").agg(
        F.collect_list(F.struct("id", "_r", "h")).alias("ids_with"))
    without = named.where(F.col("h").isNull()).groupBy("g").agg(ids.alias("ids_without"))
    per_group = by_number.groupBy("g").agg(
        F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(0)).alias("n_without"),
        F.sum(F.when(F.col("h").isNotNull(), F.col("n")).otherwise(0)).alias("n_with")) \
        .join(with_number, "g", "left").join(without, "g", "left")
    return same, per_group


def _entries(wanted: DataFrame, lists: tuple[DataFrame, DataFrame], *carried: str) -> DataFrame:
    """For every key ``k``, number ``h`` and group ``g`` that share a word: score, number of records
    and smallest ids by what the numbers say; ``least`` is the score these records have already been
    counted at, by a wider group, or null."""
    same, per_group = lists
    rows = wanted.join(same, ["g", "h"], "left").join(per_group, "g")  # the wider lists last, no shuffle carries them
    has, none = F.col("h").isNotNull(), F.array().cast(_type_of(same, "ids_same"))
    n_same = F.coalesce("n_same", F.lit(0))
    plain = lambda x: F.struct(x["id"], x["_r"])
    ids_with = F.coalesce(F.transform("ids_with", plain), none)
    ids_without = F.coalesce("ids_without", none)
    different = F.coalesce(F.transform(
        F.filter("ids_with", lambda x: x["h"] != F.col("h")), plain), none)

    def entry(part, n, ids):
        counted = F.lit(True) if part == 1.0 else F.col("least") > 0
        return F.struct(((F.col("name_score") + part) / 2).alias("score"),
                        F.when(counted, (F.col("least") + part) / 2).alias("least"),
                        n.cast("long").alias("n"), ids.cast(none_type).alias("ids"))

    none_type = _type_of(same, "ids_same")
    kinds = F.when(has, F.array(
        entry(1.0, n_same, F.coalesce("ids_same", none)),
        entry(0.0, F.col("n_with") - n_same, different),
        entry(0.5, F.col("n_without"), ids_without))).otherwise(F.array(
            entry(0.5, F.col("n_with") + F.col("n_without"), F.concat(ids_with, ids_without))))
    return rows.select("k", F.coalesce("h", F.lit("")).alias("_h"), "name_score", *carried,
                       F.explode(kinds).alias("_e")).where(F.col("_e.n") > 0) \
        .select("k", "_h", "name_score", *carried, "_e.*", F.round("_e.score", 9).alias("_s"))


def _listed(entries: DataFrame) -> DataFrame:
    return entries.select("k", "_h", "_s", "name_score", "score", F.explode("ids").alias("_i")) \
        .select("k", "_h", "_s", "name_score", "score", "_i.*")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` records of each key, with ``_rank``. A record may come twice, at its own score
    and at a lower one, but at most ``top`` rows of a key are such repeats."""
    order = [F.desc("_s"), F.col("id"), F.col("_r")]
    few = smallest_per_key(rows, ["k", "_h"], order, 2 * top).drop("_rank")
    once = smallest_per_key(few, ["k", "_h", "_r"], [F.desc("_s")], 1).drop("_rank")
    return smallest_per_key(once, ["k", "_h"], order, top)


def _levels(entries: DataFrame) -> DataFrame:
    """How many records have each score, less those that a wider group counted there."""
    counted = entries.select("k", "_h", "_s", "n").unionByName(
        entries.where(F.col("least").isNotNull()).select(
            "k", "_h", F.round("least", 9).alias("_s"), (-F.col("n")).alias("n")))
    return counted.groupBy("k", "_h", "_s").agg(F.sum("n").alias("n"))


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _numbered_pieces(key, size: int):
    """The runs of ``size`` letters of a text, each with which occurrence it is, as a set."""
    runs = F.when(F.length(key) >= size, F.transform(
        F.sequence(F.lit(1), F.length(key) - (size - 1)), lambda i: F.substring(key, i, size))) \
        .otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda x, i: F.concat(x, F.lit("\u001f"), F.size(
        F.filter(F.slice(runs, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def _shared_pairs_needed(n, m, min_ratio: float, method: str):
    """Least number of letter pairs that texts of ``n`` and ``m`` letters at the ratio share.

    Sequence ratio: at least M = r (n + m) / 2 letters match, in blocks with an unmatched letter
    between any two, so in at most 1 + n + m - 2M of them, and a block of L letters holds L - 1
    pairs. Levenshtein: one edit spoils at most two of the longer text's pairs.
    """
    slack = F.lit(1e-9)
    if method == "sequence":
        return F.ceil((1.5 * min_ratio - 1) * (n + m) - 1 - slack)
    longest = F.greatest(n, m)
    return longest - 1 - 2 * F.floor((1 - min_ratio) * longest + slack)


#: Titles up to this length, and those whose bound asks for no common letter pair, are also looked
#: up by letters: they may reach the ratio without a common pair, but not without a common letter.
TINY = 6


def title_pairs(left: DataFrame, right: DataFrame, min_ratio: float, method: str) -> DataFrame:
    """All pairs of titles (``a``, ``b``, ``ratio``) that reach the ratio.

    Inputs have ``key``, distinct title keys. Titles are compared if they share one of the rarest
    letter pairs of each: of a title's pairs so many are looked up that a partner which shared none
    of them could not share enough. Length and shared-letter bounds come before any alignment.
    """
    if method == "sequence" and min_ratio <= 2 / 3:
        raise ValueError("ratios of 2/3 or less have no candidate rule")
    if method == "levenshtein" and min_ratio <= 0.5:
        raise ValueError("ratios of one half or less have no candidate rule")
    shortest = min_ratio / (2 - min_ratio) if method == "sequence" else min_ratio

    def pieces(titles):
        n = F.length("key")
        return titles.select("key", n.alias("n"), _numbered_pieces(F.col("key"), 2).alias("pairs"),
                             _numbered_pieces(F.col("key"), 1).alias("letters"))

    sides = checkpointed(pieces(left).withColumn("side", F.lit("a")).unionByName(
        pieces(right).withColumn("side", F.lit("b"))))
    uses = sides.select(F.explode("pairs").alias("p")).groupBy("p").agg(
        F.count(F.lit(1)).alias("uses"))
    least = F.ceil(F.col("n") * shortest - 1e-9)
    # the fewest that any partner may share; the edit bound does not always grow with the length
    bound = (_shared_pairs_needed(F.col("n"), least, min_ratio, method) if method == "sequence" else
             F.array_min(F.transform(
                 F.sequence(F.col("n"), F.floor(F.col("n") / shortest + 1e-9).cast("int")),
                 lambda m: _shared_pairs_needed(m, m, min_ratio, method))))
    needed = F.greatest(F.lit(1), bound)
    ranked = sides.select("side", "key", "n", F.explode("pairs").alias("p")).join(uses, "p") \
        .groupBy("side", "key", "n").agg(
            F.sort_array(F.collect_list(F.struct("uses", "p"))).alias("by_use"))
    probes = ranked.select("side", "key", "n", F.explode(F.transform(
        F.slice("by_use", F.lit(1), F.greatest(F.size("by_use") - needed + 1, F.lit(0)).cast("int")),
        lambda r: r["p"])).alias("p"))
    probes = probes.unionByName(sides.where((F.col("n") <= TINY) | (bound < 1)).select(
        "side", "key", "n", F.explode("letters").alias("p")))
    side = lambda s, k, n: probes.where(F.col("side") == s).select(
        F.col("key").alias(k), F.col("n").alias(n), "p")
    met = side("a", "a", "_n").join(side("b", "b", "_m"), "p").where(
        F.least("_n", "_m") >= F.greatest("_n", "_m") * shortest - 1e-9).select("a", "b").distinct()
    full = lambda s, k, x: sides.where(F.col("side") == s).select(
        F.col("key").alias(k), F.col("n").alias(f"_n{x}"), F.col("pairs").alias(f"_p{x}"),
        F.col("letters").alias(f"_l{x}"))
    near = met.join(full("a", "a", "a"), "a").join(full("b", "b", "b"), "b")
    common = lambda x: F.size(F.array_intersect(f"_{x}a", f"_{x}b"))
    near = near.where(common("p") >= _shared_pairs_needed(
        F.col("_na"), F.col("_nb"), min_ratio, method))
    if method == "sequence":
        near = spread(near.where(2 * common("l") >= (F.col("_na") + F.col("_nb")) * min_ratio - 1e-9)
                      .select("a", "b"), "a", "b")
    ratio = ratio_column(F.col("a"), F.col("b"), method, min_ratio)
    return near.select("a", "b", ratio.alias("ratio")).where(F.col("ratio") >= min_ratio)


def _allocate(pairs: DataFrame, left_cap: DataFrame, right_cap: DataFrame) -> DataFrame:
    """Best pair first over titles with capacities; returns (a, b, ratio, round, quantity).

    Each round takes every pair that is the best remaining one for both of its titles, which is
    what working down the sorted pair list would take. The best pair overall always qualifies,
    so rounds go on until no pair is left; there is no limit on their number. A round is one
    checkpoint of the pairs still open, and only pairs whose titles have records left stay in.
    Equal ratios are ordered by a hash of the two titles, so that many equal pairs settle in a few
    rounds rather than one after another.
    """
    rank = F.struct((-F.col("ratio")).alias("r"),
                    F.md5(F.concat_ws("\u001f", "a", "b")).alias("t"), "a", "b")
    # The ratios are costly and every round reads the pairs three times.
    state = checkpointed(pairs.join(left_cap, "a").join(right_cap, "b").select(
        "a", "b", "ratio", "left_n", "right_n"))
    done, turn = [], 0
    while True:
        best_of_left = state.groupBy("a").agg(F.min(rank).alias("_bl"))
        best_of_right = state.groupBy("b").agg(F.min(rank).alias("_br"))
        mutual = (F.col("_bl") == rank) & (F.col("_br") == rank)
        marked = checkpointed(
            state.join(best_of_left, "a").join(best_of_right, "b").select(
                "a", "b", "ratio", "left_n", "right_n",
                F.when(mutual, F.least("left_n", "right_n")).alias("quantity")))
        taken = marked.where(F.col("quantity").isNotNull())
        if taken.isEmpty():
            break
        done.append(taken.select("a", "b", "ratio", F.lit(turn + 1).alias("round"), "quantity"))
        spent = lambda side, name: taken.select(side, F.col("quantity").alias(name))
        left_over = lambda n, used: (F.col(n) - F.coalesce(used, F.lit(0))).alias(n)
        state = marked.where(F.col("quantity").isNull()).drop("quantity") \
            .join(spent("a", "_ua"), "a", "left").join(spent("b", "_ub"), "b", "left") \
            .select("a", "b", "ratio", left_over("left_n", "_ua"), left_over("right_n", "_ub")) \
            .where((F.col("left_n") > 0) & (F.col("right_n") > 0))
        turn += 1
    if not done:
        return marked.select("a", "b", "ratio", F.lit(1).alias("round"), "quantity")
    return reduce(lambda x, y: x.unionByName(y), done)


def _remaining(cap: DataFrame, dealt: DataFrame, side: str) -> DataFrame:
    """The titles of one side that still have records, with how many."""
    n = f"{'left' if side == 'a' else 'right'}_n"
    used = dealt.groupBy(side).agg(F.sum("quantity").alias("_used"))
    return cap.join(used, side, "left").select(
        side, (F.col(n) - F.coalesce("_used", F.lit(0))).alias(n)).where(F.col(n) > 0)


def match_titles(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                 left_title: str, right_title: str, manual: DataFrame | None = None,
                 min_ratio: float = TITLE_RATIO, method: str = "sequence",
                 bands: tuple[float, ...] = BANDS) -> DataFrame:
    """One-to-one title matches (``left_id``, ``right_id``, ``ratio``, ``how``).

    Manual pairs come first. Then the best remaining pair is taken, over and over: highest ratio,
    then a hash of the two titles, then id. Equal titles, which come first of all, are settled by one
    join; only titles with records left are compared. They are compared in ``bands``, from the
    highest ratio down to ``min_ratio``: pairs of a band come before all pairs below it, so the
    result is the same with any bands, while titles that a band uses up are looked up and aligned
    in no lower one. Records with the same title are
    interchangeable up to their id order, so titles are matched once with the number of records
    behind them and the records are dealt out by rank.
    """
    a = left.select(F.col(left_id).alias("left_id"), title_key(left_title).alias("key"))
    b = right.select(F.col(right_id).alias("right_id"), title_key(right_title).alias("key"))
    fixed = None
    if manual is not None:
        fixed = manual.select(F.col(manual.columns[0]).alias("left_id"),
                              F.col(manual.columns[1]).alias("right_id"))
        a = a.join(fixed.select("left_id"), "left_id", "left_anti")
        b = b.join(fixed.select("right_id"), "right_id", "left_anti")
    a, b = a.where(F.col("key") != ""), b.where(F.col("key") != "")
    lcap = a.groupBy(F.col("key").alias("a")).agg(F.count(F.lit(1)).alias("left_n"))
    rcap = b.groupBy(F.col("key").alias("b")).agg(F.count(F.lit(1)).alias("right_n"))
    caps = checkpointed(lcap.join(rcap, F.col("a") == F.col("b"), "full_outer"))
    equal = caps.where("a = b").select("a", "b", F.lit(1.0).alias("ratio"), F.lit(0).alias("round"),
                                       F.least("left_n", "right_n").alias("quantity"),
                                       F.lit(0).alias("band"))
    over = lambda n, m: F.col(n) - F.coalesce(m, F.lit(0))
    lcap = caps.select("a", over("left_n", "right_n").alias("left_n")).where("left_n > 0")
    rcap = caps.select("b", over("right_n", "left_n").alias("right_n")).where("right_n > 0")
    dealt = equal
    steps = sorted({min_ratio, *(x for x in bands if x > min_ratio)}, reverse=True)
    for band, ratio in enumerate(steps, start=1):
        pairs = title_pairs(lcap.select(F.col("a").alias("key")),
                            rcap.select(F.col("b").alias("key")), ratio, method)
        taken = _allocate(pairs, lcap, rcap)
        dealt = dealt.unionByName(taken.withColumn("band", F.lit(band)))
        if ratio > min_ratio:
            lcap, rcap = (checkpointed(_remaining(lcap, taken, "a")),
                          checkpointed(_remaining(rcap, taken, "b")))

    # Deal the records out: the k-th of a title goes to the slot that covers k.
    spans = _spans(_spans(dealt, "a"), "b")
    ranked_a = numbered(a, ["left_id"], "_k", ["key"])
    ranked_b = numbered(b, ["right_id"], "_k", ["key"])
    slot = lambda side: (F.col("_k") > F.col(f"_from_{side}")) & (
        F.col("_k") <= F.col(f"_from_{side}") + F.col("quantity"))
    placed_a = ranked_a.join(spans, ranked_a["key"] == spans["a"]).where(slot("a")).select(
        "left_id", "a", "b", "ratio", (F.col("_k") - F.col("_from_a")).alias("_slot"))
    placed_b = ranked_b.join(spans, ranked_b["key"] == spans["b"]).where(slot("b")).select(
        "right_id", "a", "b", (F.col("_k") - F.col("_from_b")).alias("_slot"))
    out = placed_a.join(placed_b, ["a", "b", "_slot"]).select(
        "left_id", "right_id", "ratio", F.lit("title").alias("how"))
    if fixed is None:
        return out
    return fixed.select("left_id", "right_id", F.lit(None).cast("double").alias("ratio"),
                        F.lit("manual").alias("how")).unionByName(out)


def _spans(dealt: DataFrame, side: str) -> DataFrame:
    """Where each allocation starts among its title's records, by band and round.

    A title gets at most one partner per round, so a window holds no more rows than rounds.
    """
    upto = F.sum("quantity").over(Window.partitionBy(side).orderBy("band", "round"))
    return dealt.withColumn(f"_from_{side}", upto - F.col("quantity"))


def merge_master(existing: DataFrame, incoming: DataFrame, matches: DataFrame,
                 existing_id: str, incoming_id: str) -> DataFrame:
    """Every record of both sides once, as ``create``, ``update`` or ``sir-only``."""
    pairs = matches.select("left_id", "right_id")
    old = existing.select(F.col(existing_id).alias("left_id"))
    new = incoming.select(F.col(incoming_id).alias("right_id"))
    joined = old.join(pairs, "left_id", "left").join(new.withColumn("_new", F.lit(True)),
                                                     "right_id", "full_outer")
    return joined.select(
        F.col("left_id").alias(existing_id), F.col("right_id").alias(incoming_id),
        F.when(F.col("left_id").isNull(), "create")
        .when(F.col("right_id").isNull(), "sir-only").otherwise("update").alias("kind"))


def number_targets(records: DataFrame, bucket: str, project: str, tie: list[str],
                   name: str = "target_id") -> DataFrame:
    """Consecutive numbers over (bucket, numeric project id); no project id sorts last."""
    pid = strip(project)
    keyed = records.withColumn("_pid", F.when(pid.rlike("^[0-9]{1,18}$"), pid.cast("long"))
                               .otherwise(F.lit(10**18)))
    return numbered(keyed, [bucket, "_pid", *tie], name).drop("_pid")


def same_title(records: DataFrame, title: str) -> DataFrame:
    """Q12: records whose title key occurs more than once; a warning, not a duplicate verdict."""
    keyed = records.withColumn("title_key", title_key(title)).where(F.col("title_key") != "")
    repeated = keyed.groupBy("title_key").agg(F.count(F.lit(1)).alias("records")) \
        .where(F.col("records") > 1)
    return keyed.join(repeated, "title_key").withColumn("severity", F.lit("warn"))


def renumber_duplicates(records: DataFrame, id_col: str, order: list[str],
                        name: str = "new_id") -> DataFrame:
    """The second and later rows of an id get the next free integers, in input order.

    ``order`` must be a total order of the input. Rows that keep their id have ``renumbered``
    false. An id that is no whole number is kept as it is on its first row, with no ``name``; its
    repeats are numbered like any other.
    """
    first = records.groupBy(F.col(id_col).alias("_id")).agg(
        F.min(F.struct(*order)).alias("_first"))
    marked = records.join(first, records[id_col] == first["_id"]).withColumn(
        "renumbered", F.struct(*order) != F.col("_first")).drop("_id", "_first")
    top = records.agg(F.max(strip(id_col).try_cast("long"))).first()[0] or 0
    moved = numbered(marked.where("renumbered"), order, "_n").withColumn(
        name, F.lit(top) + F.col("_n")).drop("_n")
    kept = marked.where(~F.col("renumbered")).withColumn(
        name, strip(id_col).try_cast("long"))
    return kept.unionByName(moved)
