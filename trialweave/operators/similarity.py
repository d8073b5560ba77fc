"""Text similarity and the candidate pairs it is worth measuring.

Nothing here pairs up all members of a group. Words are compared through shared deletions, and
word sets through their rarest words, so the work follows the number of near matches.
"""
from __future__ import annotations

import sys
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# Workers get these small functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN_RATIO = 0.85
# Words up to this length are matched through deletions, longer pairs through pieces.
SHORT = 10
# Pairs of words up to this length are aligned many at a time.
NARROW = 32
METHODS = ("sequence", "levenshtein")


def _check(method: str):
    if method not in METHODS:
        raise ValueError(f"similarity {method!r} is none of {METHODS}")


def sequence_ratio(a: str, b: str, at_least: float = 0.0) -> float:
    """matching-block ratio; depends on the argument order.

    Pairs whose upper bounds already fall short of ``at_least`` give 0 without being aligned.
    """
    matcher = SequenceMatcher(None, a, b)
    if matcher.real_quick_ratio() < at_least or matcher.quick_ratio() < at_least:
        return 0.0
    return matcher.ratio()


def ratio_column(a: Column, b: Column, method: str, at_least: float = 0.0) -> Column:
    """Similarity of two texts between 0 and 1; see ``sequence_ratio`` for ``at_least``."""
    _check(method)
    if method == "sequence":
        @F.pandas_udf("double")
        def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([sequence_ratio(p, q, at_least) for p, q in zip(x, y)],
                             dtype="float64")
        # else a filter on the ratio would move below the joins and bounds that come before it
        return ratio.asNondeterministic()(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt evenly over the cluster before work that costs far more than its bytes suggest.

    A stated number of partitions also keeps adaptive execution from merging them by size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A frame that joins do not broadcast. Spark takes exploded arrays and the columns of a compressed file
    for far smaller than they are, and would collect them on the driver."""
    return df.hint("merge")


def _percent(threshold: float) -> int:
    return round(threshold * 100)


def deletions_allowed(length: int, percent: int, method: str) -> int:
    """Most letters a word of this length can lose and still match some partner.

    Levenshtein: the distance is at most (100-p)% of the longer word, whose length is at most
    length/p. Sequence ratio: matches M satisfy 2M >= p(n+m), and M <= m bounds m from below.
    """
    if method == "levenshtein":
        return (100 - percent) * (length * 100 // percent) // 100
    shortest = -(-percent * length // (200 - percent))
    keep = -(-percent * (length + shortest) // 200)
    return max(0, length - keep)


def letters_kept(n: int, m: int, percent: int, method: str) -> int:
    """Least length of a common subsequence of matching words with ``n`` and ``m`` letters."""
    if method == "levenshtein":
        return max(n, m) - max(n, m) * (100 - percent) // 100
    return -(-percent * (n + m) // 200)


def _letters(words: np.ndarray) -> np.ndarray:
    """Code points of the words, a row for each place and a column for each word; 0 past a word's end."""
    held = words.astype(str)
    return np.ascontiguousarray(held.view(np.uint32).reshape(len(held), -1).T)


def matched_letters(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Letters in the matching blocks that ``SequenceMatcher`` finds for many pairs of short words.

    ``a`` and ``b`` are code points as in ``_letters``, ``n`` and ``m`` the lengths. Every pair takes its
    longest common run, of equal ones the first in ``a`` and then in ``b``, and goes on with what is left
    and right of it, all pairs at once.
    """
    total = np.zeros(len(n), np.int64)
    # longest first, then by place in a, then in b: 6 bits for the length and 5 for each place
    places = np.arange(len(b), dtype=np.int8)[:, None]
    turn = (NARROW - 1 - places).astype(np.uint16)
    pair, start, end, first, last = np.arange(len(n)), np.zeros(len(n), np.int8), n.astype(np.int8), \
        np.zeros(len(n), np.int8), m.astype(np.int8)
    while len(pair):
        x, y = np.take(a, pair, axis=1), np.take(b, pair, axis=1)
        inside = (places >= first) & (places < last)
        run = np.zeros((len(b) + 1, len(pair)), np.uint16)
        best, key = np.zeros(len(pair), np.uint16), np.empty_like(run[1:])
        for i in range(start.min(), end.max()):
            equal = y == x[i]
            equal &= inside
            equal &= (start <= i) & (i < end)
            run[1:] = run[:-1] + np.uint16(1)  # length of the common run that ends here
            run[1:] *= equal
            np.left_shift(run[1:], 10, out=key)
            key += turn
            at = key.max(axis=0)
            at += np.uint16((NARROW - 1 - i) << 5)
            np.maximum(best, at, out=best)
        found = np.flatnonzero(best >= 1 << 10)
        best, pair = best[found], pair[found]
        start, end, first, last = (v[found] for v in (start, end, first, last))
        size = (best >> 10).astype(np.int8)
        i, j = ((NARROW - (best >> k & 31)).astype(np.int8) - size for k in (5, 0))
        total += np.bincount(pair, size, len(total)).astype(np.int64)
        sides = ((pair, start, i, first, j), (pair, i + size, end, j + size, last))
        pair, start, end, first, last = (np.concatenate(v) for v in zip(*sides))
        left = np.flatnonzero((start < end) & (first < last))
        pair, start, end, first, last = (v[left] for v in (pair, start, end, first, last))
    return total


def word_ratios(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``SequenceMatcher``'s ratio for many pairs of words."""
    n, m = (np.fromiter(map(len, v), np.int32, len(v)) for v in (x, y))
    out = np.ones(len(x))
    narrow = np.flatnonzero((np.maximum(n, m) <= NARROW) & (n + m > 0))
    if len(narrow):
        k, l = n[narrow], m[narrow]
        out[narrow] = 2.0 * matched_letters(_letters(x[narrow]), _letters(y[narrow]), k, l) / (k + l)
    for i in np.flatnonzero(np.maximum(n, m) > NARROW):
        out[i] = SequenceMatcher(None, x[i], y[i]).ratio()
    return out


def word_ratio(a: Column, b: Column) -> Column:
    """``sequence_ratio`` of words."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(word_ratios(x.to_numpy(object), y.to_numpy(object)))
    return ratio.asNondeterministic()(a, b)


def matching_tokens(left: DataFrame, right: DataFrame, method: str,
                    threshold: float = TOKEN_RATIO) -> DataFrame:
    """Pairs of words (``left_token``, ``right_token``) at or above the ratio.

    Input columns are both ``token`` and must be distinct. Candidates come from two equi-joins
    that between them miss no pair:

    * when one word has at most ``SHORT`` letters, both share a form reached by deleting letters
      from each, since they have a long common subsequence. How long follows from both lengths, so
      a form is looked up for each length that a partner may have;
    * when both are longer, few differences leave a common run of three letters, so they share a
      three-letter piece. For Levenshtein an edit spoils at most three pieces, so only the
      ``3k + 1`` rarest pieces of a word are looked up.

    Both facts need a ratio of 0.85 or more.
    """
    _check(method)
    if threshold < TOKEN_RATIO:
        raise ValueError(f"word ratios below {TOKEN_RATIO} have no exact candidate rule")
    percent = _percent(threshold)
    longest_partner = SHORT * (200 - percent) // percent

    def forms(side):
        @F.pandas_udf("array<string>")
        def found(words: pd.Series) -> pd.Series:
            out = []
            for word in words:
                n, seen = len(word), set()
                for m in range(1, (longest_partner if n <= SHORT else SHORT) + 1):
                    keep = letters_kept(n, m, percent, method)
                    if keep <= min(n, m):
                        lengths = f"{n} {m} " if side == "left" else f"{m} {n} "
                        seen.update(lengths + "".join(kept) for kept in combinations(word, keep))
                out.append(sorted(seen))
            return pd.Series(out, dtype="object")
        return found

    def by_form(words, side):
        small = words.where(F.length("token") <= longest_partner)
        return spread(small, "token").select(F.col("token").alias(f"{side}_token"),
                            F.explode(forms(side)("token")).alias("_form"))

    def by_piece(words, name):
        big = words.where(F.length("token") > SHORT)
        pieces = F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("token") - 2), lambda i: F.substring("token", i, 3)))
        return big.select(F.col("token").alias(name), F.explode(pieces).alias("_piece"))

    short = by_form(left, "left").join(by_shuffle(by_form(right, "right")), "_form")
    probe, index = by_piece(left, "left_token"), by_piece(right, "right_token")
    if method == "levenshtein":
        uses = index.groupBy("_piece").agg(F.count(F.lit(1)).alias("_uses"))
        ranked = probe.join(by_shuffle(uses), "_piece").groupBy("left_token").agg(
            F.sort_array(F.collect_list(F.struct("_uses", "_piece"))).alias("_ranked"))
        edits = F.floor(F.floor(F.length("left_token") * 100 / percent) * (100 - percent) / 100)
        probe = ranked.select("left_token", F.explode(
            F.slice("_ranked", F.lit(1), (edits * 3 + 1).cast("int"))).alias("_r")).select(
            "left_token", F.col("_r._piece").alias("_piece"))
    long = probe.join(by_shuffle(index), "_piece")
    pairs = short.select("left_token", "right_token").unionByName(
        long.select("left_token", "right_token"))
    longest = F.greatest(F.length("left_token"), F.length("right_token"))
    shortest = F.least(F.length("left_token"), F.length("right_token"))
    if method == "levenshtein":
        limit = F.floor(longest * (100 - percent) / 100)
        return pairs.where(longest - shortest <= limit).distinct().where(
            F.levenshtein("left_token", "right_token") <= limit)
    sized = pairs.where(shortest * (200 - percent) >= longest * percent).distinct()
    return spread(sized, "left_token", "right_token").where(
        word_ratio(F.col("left_token"), F.col("right_token")) >= threshold)


def overlapping_sets(left: DataFrame, right: DataFrame, percent: int,
                     matches: DataFrame | None = None) -> DataFrame:
    """Set pairs that may share at least ``percent`` of the larger set: (``a``, ``b``) candidates.

    Inputs have ``key`` (unique) and ``tokens`` (distinct words). If ``h`` words of a set must be
    hit, at least one of any ``n - h + 1`` of them is, so only a set's words with the fewest
    right-hand occurrences are looked up; words that half the table uses are looked up only by
    sets that have nothing rarer. ``matches`` widens a word to its near matches.
    """
    postings = right.select(
        F.col("key").alias("b"), F.size("tokens").alias("_nb"), F.explode("tokens").alias("_y"))
    words = left.select(
        F.col("key").alias("a"), F.size("tokens").alias("_na"), F.explode("tokens").alias("_x"))
    used = postings.groupBy("_y").agg(F.count(F.lit(1)).alias("_uses"))
    if matches is None:
        reach = words.join(used.withColumnRenamed("_y", "_x"), "_x", "left")
        reach = reach.select("a", "_na", "_x", F.coalesce("_uses", F.lit(0)).alias("_uses"))
    else:
        cost = matches.join(used, matches["right_token"] == used["_y"]).groupBy("left_token").agg(
            F.sum("_uses").alias("_uses"))
        reach = words.join(cost, words["_x"] == cost["left_token"], "left").select(
            "a", "_na", "_x", F.coalesce("_uses", F.lit(0)).alias("_uses"))
    # A set's own words, rarest first; a set is one row, so this array is one row's size.
    ranked = reach.groupBy("a", "_na").agg(
        F.sort_array(F.collect_list(F.struct("_uses", "_x"))).alias("_ranked"))
    need = F.ceil(F.col("_na") * percent / 100).cast("int")
    probe = ranked.select(
        "a", "_na", F.explode(F.slice("_ranked", F.lit(1), F.col("_na") - need + 1)).alias("_r"))
    probe = probe.select("a", "_na", F.col("_r._x").alias("_x"))
    if matches is None:
        probe = probe.withColumnRenamed("_x", "_y")
    else:
        probe = probe.join(matches, probe["_x"] == matches["left_token"]).select(
            "a", "_na", F.col("right_token").alias("_y")).distinct()
    # Sizes that can reach the share go into the join key, which splits the postings of one word.
    sizes = F.sequence(F.ceil(F.col("_na") * percent / 100).cast("int"),
                       F.floor(F.col("_na") * 100 / percent).cast("int"))
    probe = probe.select("a", "_y", F.explode(sizes).alias("_nb"))
    return probe.join(postings, ["_y", "_nb"]).select("a", "b").distinct()
