"""License scans against a plain loop over every place, and against SQL."""
import math
import random
import re

import pytest
from compare import compare, connect
from conftest import prose

from trialweave.llm import catalogue, licenses

SF = "/root/testdata/sf0.001"
BASE = {label for label, _ in licenses.BASE}


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute(texts):
    """The digest of every text by comparing every phrase at every place."""
    every = [_words(t) for t in texts]
    idf = {w: math.floor(1000 * math.log((2 * len(every) + 2) / (2 * sum(w in e for e in every) + 1)))
           for t in licenses.TEMPLATES for w in t.words}
    out = []
    for words in every:
        labels, places, score = set(), [], 0.0
        for t in licenses.TEMPLATES:
            starts = [[s for s in range(len(words)) if tuple(words[s:s + b - a]) == t.words[a:b]]
                      for a, b in t.phrases]
            blocks = [{(s - a) // 32 + e for s in found for e in (0, 1)}
                      for found, (a, _) in zip(starts, t.phrases)]
            both = set.intersection(*blocks)
            if not both:
                continue
            labels.add(t.label)
            places += [s for found in starts for s in found] if t.label in BASE else []
            rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[:6]
            held = [w for w in rare if any({(i - t.words.index(w)) // 32, (i - t.words.index(w)) // 32 + 1}
                                           & both for i, x in enumerate(words) if x == w)]
            score = max(score, sum(idf[w] for w in held) / sum(idf[w] for w in rare))
        out.append((len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(labels & BASE)), ",".join(sorted(labels)), round(score, 9)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    whole = [" ".join(t.words) for t in licenses.TEMPLATES]
    out = [None, "", "MIT License", "mit-license mit license", "mit the license", "CC BY-NC 4.0", "cc  by", ".", "  a",
           "Kelvin GNU\tGeneral\nPublic, License!", "é mit licensé", "apache license " * 400]
    for text in whole:
        words = text.split()
        out += [text.upper(), f"{prose(len(words), 40)} {text}, {prose(3, 30)} {text}"]
        out += [" ".join(w for w in words if rng.random() < 0.9) for _ in range(3)]
        out += [" ".join(x for w in words for x in ([w] if rng.random() < 0.9 else [w, "year", "holder"]))
                for _ in range(3)]
    out += [" and ".join(" ".join(t.words[a:b]) for a, b in t.phrases) for t in licenses.TEMPLATES]
    return out + [prose(9, 30_000) + " mit license"] + [out[2]] * 5


def test_against_every_place(spark, texts):
    rows = [(i, t, 1.0, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words double, hits string").repartition(3)
    got = licenses.digest(licenses.find_licenses(df, licenses.TEMPLATES), BASE)
    found = {r["doc_id"]: (*r[1:-1], round(r[-1], 9)) for r in got.collect()}
    want = _brute(texts)
    assert found == dict(enumerate(want))
    assert {x for w in want for x in w[5].split(",")} >= {t.label for t in licenses.TEMPLATES}
    assert any(0 < w[6] < 1 for w in want)


def test_hard_documents(spark, docs, empty, pairs):
    got = licenses.digest(licenses.find_licenses(docs, licenses.TEMPLATES), BASE)
    assert sorted((str(r[0]), r["n_words"], r["n_base"]) for r in got.collect()) == sorted(
        (str(i), len(_words(t)), 0) for i, t in pairs)
    assert licenses.find_licenses(empty, licenses.TEMPLATES).count() == 0


def test_a_template_needs_a_phrase():
    with pytest.raises(ValueError):
        licenses.read_template("x", "no phrase here")
    with pytest.raises(ValueError):
        licenses.read_template("x", "[\u212a]")


def test_main_path_is_native(spark):
    plan = catalogue.op13_licenses(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


def test_query(spark):
    assert compare(spark, connect(SF), SF, catalogue.op13_licenses, catalogue.ORACLES["op13_licenses"]) is None
