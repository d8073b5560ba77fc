"""Fuzzy operators against plain loops over every pair."""
import hashlib
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trialweave.operators import matching as M
from trialweave.operators import similarity as S

RANDOM = random.Random(7)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def near(a, b, method):
    if method == "sequence":
        return SequenceMatcher(None, a, b).ratio() >= 0.85
    return lev(a, b) <= max(len(a), len(b)) * 15 // 100


def words(n, low, high, letters="abc0"):
    base = ["".join(RANDOM.choice(letters) for _ in range(RANDOM.randint(low, high)))
            for _ in range(n)]
    out = set(base)
    for w in base:
        for _ in range(2):
            i = RANDOM.randrange(len(w))
            out.add(w[:i] + RANDOM.choice(letters) + w[i + RANDOM.randint(0, 1):])
    return sorted(out)


@pytest.mark.parametrize("method", S.METHODS)
@pytest.mark.parametrize("low, high", [(1, 6), (7, 12), (9, 22)])
def test_matching_tokens_misses_nothing(spark, method, low, high):
    left, right = words(40, low, high), words(40, low, high)
    right = sorted(set(right) | set(left[::2]))
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    got = {tuple(r) for r in S.matching_tokens(frame(left), frame(right), method).collect()}
    assert got == {(a, b) for a in left for b in right if near(a, b, method)}


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=13), st.text("ab", min_size=1, max_size=13))
def test_deletion_bound_covers_every_match(a, b):
    for method in S.METHODS:
        if near(a, b, method):
            common = 0
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y \
                        else max(table[i][j + 1], table[i + 1][j])
            common = table[-1][-1]
            assert len(a) - common <= S.deletions_allowed(len(a), 85, method)
            assert len(b) - common <= S.deletions_allowed(len(b), 85, method)


@pytest.mark.parametrize("method", S.METHODS)
def test_forms_and_pieces_are_not_broadcast(spark, tmp_path, method):
    """A small file of words has many times its size in forms; the driver must not collect them."""
    some = words(60, 6, 14)
    spark.createDataFrame([(w,) for w in some], "token string").write.parquet(str(tmp_path / "words"))
    df = spark.read.parquet(str(tmp_path / "words"))
    got = S.matching_tokens(df, df, method)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in some for b in some if near(a, b, method)}


def test_many_ratios_equal_those_one_by_one():
    pairs = []
    for letters, high in (("ab", 12), ("0123456789", 9), ("abc\u00e9\U0001f600\x00", S.NARROW + 3)):
        for _ in range(700):
            x = "".join(RANDOM.choices(letters, k=RANDOM.randint(0, high)))
            pairs += [(x, "".join(RANDOM.choices(letters, k=RANDOM.randint(0, high)))), (x, x[:3] + x[4:])]
    x, y = (np.array(v, object) for v in zip(*pairs))
    assert S.word_ratios(x, y).tolist() == [SequenceMatcher(None, *p).ratio() for p in pairs]


def test_low_ratio_is_refused(spark):
    df = spark.createDataFrame([("a",)], "token string")
    with pytest.raises(ValueError):
        S.matching_tokens(df, df, "sequence", 0.7)


def _people(n, offset):
    """A third of the people share one name and number, and the rest are near it or each other."""
    first, last = ["ada", "adaora", "bisi", "chike", "funmilola"], ["okafor", "okafer", "bello", "wuraola"]
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((offset + i, "Ada Okafor", "H-77"))
        else:
            name = " ".join([RANDOM.choice(first), RANDOM.choice(last)]
                            + ([RANDOM.choice(first)] if i % 5 == 0 else []))
            out.append((offset + i, name, RANDOM.choice(["NYR", "", "h77", "0012", "12", "-999"])))
    return out


@pytest.mark.parametrize("method", S.METHODS)
@pytest.mark.parametrize("top", [1, 3])
def test_fuzzy_candidates_equal_brute_force(spark, method, top):
    left, right = _people(40, 0), _people(50, 1000)
    schema = "id long, name string, hospital string"
    got = sorted(
        (r.id, r.candidate_id, round(r.name_score, 6), round(r.score, 6), r.ties, r["rank"])
        for r in M.fuzzy_candidates(
            spark.createDataFrame(left, schema), spark.createDataFrame(right, schema),
            "id", "name", "hospital", top=top, method=method).collect())

    def key(h):
        h = "".join(c for c in h.lower() if c.isalnum()).lstrip("0")
        return None if h in ("", "nyr", "666", "777", "888", "999") else h

    want = []
    for i, a, h in left:
        ta = sorted(set(a.lower().split()))
        scored = []
        for j, b, g in right:
            tb = sorted(set(b.lower().split()))
            hits = sum(any(near(x, y, method) for y in tb) for x in ta)
            longest = max(len(ta), len(tb))
            part = 0.5 if key(h) is None or key(g) is None else float(key(h) == key(g))
            if not hits and part < 1:
                continue
            scored.append((-round((hits / longest + part) / 2, 9), j, hits / longest))
        scored.sort()
        for rank, (s, j, n) in enumerate(scored[:top], 1):
            ties = sum(1 for x in scored if x[0] == s)
            want.append((i, j, round(n, 6), round(-s, 6), ties, rank))
    assert got == sorted(want)


@pytest.mark.parametrize("method", S.METHODS)
@pytest.mark.parametrize("common", [0, 3, 40, 400])
def test_fuzzy_candidates_by_class_equal_those_by_name(spark, method, common):
    """Common words and numbers counted by class, down to every word; ids that repeat."""
    schema = "id long, name string, hospital string"
    left = spark.createDataFrame(_people(40, 0) + [(1, "zita", None), (2, "ada", "999x")], schema)
    right = spark.createDataFrame(_people(60, 1000) + _people(9, 1003) + [(7, "Zoe", "h77")], schema)
    table = lambda **k: sorted(tuple(round(x, 9) for x in r) for r in M.fuzzy_candidates(
        left, right, "id", "name", "hospital", method=method, **k).collect())
    plain = table(common=1 << 60)
    assert len(plain) > 100
    ranks = lambda rows: [(r[0], *r[3:]) for r in rows]
    got = table(common=common)
    assert ranks(got) == ranks(plain) and [r[:2] for r in got] == [r[:2] for r in plain]


def test_common_words_and_numbers_do_not_pair_names(spark, monkeypatch):
    """One word in every name and one number on every record: no row for each pair of names."""
    n, sizes, plain = 400, [], M.checkpointed

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out
    monkeypatch.setattr(M, "checkpointed", counted)
    letters = "abcdefghijklmnopqrst"
    word = lambda i: letters[i // 20] * 4 + letters[i % 20] * 4
    people = spark.createDataFrame([(i, f"clinic {word(i)}", "12") for i in range(n)],
                                   "id long, name string, hospital string")
    got = M.fuzzy_candidates(people, people, "id", "name", "hospital", method="levenshtein").collect()
    assert len(got) == 3 * n and {(r.id, r.candidate_id) for r in got if r["rank"] == 1} == {
        (i, i) for i in range(n)}
    assert {r.ties for r in got if r["rank"] > 1} == {n - 1}
    assert max(sizes) < 10 * n


@settings(max_examples=300, deadline=None)
@given(st.text("ab0", min_size=1, max_size=13), st.text("ab0", min_size=1, max_size=13))
def test_matching_words_keep_as_many_letters_as_their_lengths_ask(a, b):
    for method in S.METHODS:
        if near(a, b, method):
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y \
                        else max(table[i][j + 1], table[i + 1][j])
            assert table[-1][-1] >= S.letters_kept(len(a), len(b), 85, method)


def _greedy(left, right, manual=()):
    import re
    norm = lambda t: " ".join(re.sub("[^a-z0-9]+", " ", t.lower()).split())
    out = [(a, b, "manual") for a, b in manual]
    used_l, used_r = {a for a, _ in manual}, {b for _, b in manual}
    pairs = []
    for i, a in left:
        for j, b in right:
            x, y = norm(a), norm(b)
            if not x or not y:
                continue
            ratio = SequenceMatcher(None, x, y).ratio()
            if ratio >= 0.78:
                tie = hashlib.md5(f"{x}\x1f{y}".encode()).hexdigest()
                pairs.append((-ratio, tie, x, y, i, j))
    # Best title pair first; within one title pair, ids in order on both sides.
    for r, t, x, y, i, j in sorted(pairs):
        if i not in used_l and j not in used_r:
            used_l.add(i); used_r.add(j); out.append((i, j, "title"))
    return sorted(out)


@pytest.mark.parametrize("seed, bands", [
    (1, M.BANDS), (2, M.BANDS), (3, M.BANDS), (1, ()), (2, (0.95, 0.9, 0.85, 0.8)), (3, (0.8, 0.7))])
def test_title_matching_equals_greedy(spark, seed, bands):
    rnd = random.Random(seed)
    vocab = ["outcomes", "of", "colorectal", "surgery", "study", "breast", "cancer", "in", "lagos"]
    title = lambda: " ".join(rnd.sample(vocab, rnd.randint(3, 6)))
    pool = [title() for _ in range(12)]
    make = lambda n, off: [(off + i, "A hot study: of colorectal surgery" if i % 3 == 0
                            else rnd.choice(pool + [title()])) for i in range(n)]
    left, right = make(30, 0), make(25, 100)
    manual = [(1, 101), (4, 105)]
    frame = lambda d, c: spark.createDataFrame(d, f"{c} long, title string")
    got = sorted((r.left_id, r.right_id, r.how) for r in M.match_titles(
        frame(left, "l"), frame(right, "r"), "l", "r", "title", "title",
        manual=spark.createDataFrame(manual, "a long, b long"), bands=bands).collect())
    assert got == _greedy(left, right, manual)


def test_settled_titles_are_not_compared_in_lower_bands(spark, monkeypatch):
    seen, plain = [], M.title_pairs

    def watched(left, right, ratio, method):
        seen.append((ratio, {r.key for r in left.collect()}, {r.key for r in right.collect()}))
        return plain(left, right, ratio, method)
    monkeypatch.setattr(M, "title_pairs", watched)
    frame = lambda ts, c: spark.createDataFrame(list(enumerate(ts)), f"{c} long, title string")
    left = ["equal title", "outcomes of colorectal surgery", "breast cancer in lagos"]
    right = ["equal title", "outcomes of colorectal surgerys", "breast cancer trial lagos"]
    got = {(r.l, r.r) for r in M.match_titles(
        frame(left, "l"), frame(right, "r"), "l", "r", "title", "title").selectExpr(
            "left_id as l", "right_id as r").collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}
    assert seen == [(0.9, set(left[1:]), set(right[1:])), (0.78, {left[2]}, {right[2]})]


@pytest.mark.parametrize("method", S.METHODS)
@pytest.mark.parametrize("low, high", [(1, 4), (3, 9), (8, 30)])
def test_title_pairs_miss_nothing(spark, method, low, high):
    left, right = words(30, low, high, "abc "), words(30, low, high, "abc ")
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "key string")
    got = {(r.a, r.b) for r in M.title_pairs(frame(left), frame(right), 0.78, method).collect()}
    if method == "sequence":
        good = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.78
    else:
        good = lambda a, b: 1 - lev(a, b) / max(len(a), len(b)) >= 0.78
    assert got == {(a, b) for a in left for b in right if good(a, b)}


def test_bounds_come_before_alignment(spark):
    """The ratio's filter must not move below the joins that find and bound the candidates."""
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "key string")
    pairs = M.title_pairs(frame(words(9, 8, 30, "abc ")), frame(words(9, 8, 30, "abc ")), 0.78,
                          "sequence")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ratio(") and plan.rindex("ratio(") < plan.index("Join")


def test_titles_with_few_words_in_common_match(spark):
    frame = lambda t, c: spark.createDataFrame([(1, t)], f"{c} long, title string")
    got = M.match_titles(frame("oncolgy studies on breast cancers", "l"),
                         frame("oncology study of breast cancer", "r"), "l", "r", "title", "title")
    assert got.count() == 1


def test_equal_ratios_settle_in_few_rounds(spark):
    side = lambda x: spark.createDataFrame(
        [(f"{x}{i:03d}",) for i in range(40)], "t string")
    pairs = side("l").crossJoin(side("r").withColumnRenamed("t", "b")).select(
        F.col("t").alias("a"), "b", F.lit(0.9).alias("ratio"))
    got = M._allocate(pairs, side("l").select(F.col("t").alias("a"), F.lit(1).alias("left_n")),
                      side("r").select(F.col("t").alias("b"), F.lit(1).alias("right_n"))).collect()
    assert len(got) == 40 and max(r["round"] for r in got) < 20


def test_merge_classes(spark, rows):
    old = spark.createDataFrame([(1,), (2,)], "e long")
    new = spark.createDataFrame([(10,), (11,)], "n long")
    pairs = spark.createDataFrame([(1, 10)], "left_id long, right_id long")
    got = M.merge_master(old, new, pairs, "e", "n").select("kind", F.coalesce("e", F.lit(0)))
    assert rows(got) == [("create", 0), ("sir-only", 2), ("update", 1)]


@pytest.mark.parametrize("method,ratio,a,b", [
    ("sequence", 0.7, "axbcydezfg", "abucdvefwg"),
    ("levenshtein", 0.55, "abcdefg", "axcyezg"),
])
def test_titles_without_a_common_letter_pair_meet(spark, method, ratio, a, b):
    left, right = (spark.createDataFrame([(k,)], "key string") for k in (a, b))
    got = M.title_pairs(left, right, ratio, method).select("a", "b").collect()
    assert [tuple(r) for r in got] == [(a, b)]
