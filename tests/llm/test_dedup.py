"""Exact and near duplicates against brute force, and the awkward inputs."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import exact_dedup, near_dedup
from maskwright.llm.components import components

SCHEMA = "doc_id long, text string, kept string, keep_id string, a int, source string"
WS = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "s") for i, t in rows], SCHEMA)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 3 + 1, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.integers(0, 20_000))
def test_fingerprints_combine(data, at):
    a, b = data[:at], data[at:]
    assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == exact_dedup.fingerprint(data)


def test_fingerprint_is_the_polynomial():
    data = bytes(random.Random(3).randrange(256) for _ in range(3 * exact_dedup.CHUNK + 17))
    want = []
    for p, r in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True):
        x = 0
        for c in data:
            x = (x * r + c + 1) % p
        want.append(x)
    assert exact_dedup.fingerprint(data) == tuple(want)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1cab\u00a0é", max_size=40))
def test_normalised(text):
    assert exact_dedup.normalised(text.encode()).decode() == WS.sub(" ", text)


def brute_exact(rows):
    norm = [(i, WS.sub(" ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        ids = [j for j in same if j is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("collide", [False, True])
def test_exact_against_brute_force(spark, monkeypatch, collide):
    rows = corpus(1, 60) + [(900, None), (901, ""), (902, " "), (903, "\t \n"), (1, "again"), (7, "again"), (7, "again"), (None, "again"), (None, "alone"), (905, "x " * 60_000), (906, "x  " * 60_000)]
    if collide:  # every fingerprint equal: groups must fall back on the texts
        monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: (0, 0))
        monkeypatch.setattr(exact_dedup, "COMPARE", 64)
        rows = [(i, t) for i, t in rows if i is not None and i < 905]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


def test_exact_large_group_and_empty_table(spark):
    rows = [(i, "one  text") for i in range(40)] + [(99, "other")]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert {r.keep_id for r in got if r.doc_id < 40} == {0} and {r.group_size for r in got} == {40, 1}
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_drop_exact_keeps_columns_and_one_row(spark):
    docs = frame(spark, [(5, "a b"), (3, "a  b"), (3, "a  b"), (3, "other"), (None, "n"), (8, None)])
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, "a  b"), (3, "other"), (None, "n"), (8, None)], key=repr)


def test_pieces_of_a_document(spark):
    data = bytes(range(256)) * 50
    rows = [(1, k, bytearray(data[k * 1000 : (k + 1) * 1000])) for k in range(13)] + [(2, 0, None)]
    got = {r.doc_id: r for r in exact_dedup.combine_pieces(spark.createDataFrame(rows, "doc_id long, k int, b binary"), "doc_id", "k", "b").collect()}
    assert (got[1].n_bytes, (got[1].fp1, got[1].fp2)) == (len(data), exact_dedup.fingerprint(data))
    assert got[2].n_bytes == 0


def shingles(text, width):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in WS.split(words) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_near(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("width,short,block", [(2, 48, 1024), (5, 48, 1024), (2, 3, 4)])
def test_near_against_brute_force(spark, monkeypatch, width, short, block):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1 if short < 10 else 4)
    rows = corpus(width, 150) + [(900, None), (901, ""), (902, " \n"), (903, "solo"), (904, "Solo"), (905, "w1 " * 9000), (906, "w1 w2"), (907, "w2 w1")]
    got = near_dedup.near_duplicates(frame(spark, rows), width, 80).collect()
    assert sorted(tuple(r) for r in got) == brute_near(rows, width, 80)


def test_near_awkward_inputs(spark):
    assert near_dedup.near_duplicates(frame(spark, []), 2).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (2, "A B  C"), (None, "a b c"), (None, "z")]
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows), 2).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, True), (None, 1, None, True)], key=repr)
    kept = near_dedup.drop_near_duplicates(frame(spark, rows), 2)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(1, "a b c"), (None, "z")]


def test_drop_near_tells_rows_apart_by_text(spark):
    """Ids that are null or repeated link nothing: only texts do."""
    rng = random.Random(11)
    base = [[f"t{k}w{rng.randrange(500)}" for _ in range(60)] for k in range(5)]
    near = [" ".join([*b[:-1], "changed"]) for b in base]
    text = [" ".join(b) for b in base]
    rows = [(5, text[0]), (5, text[1]), (6, near[0]), (7, near[1]), (None, text[2]), (None, near[2]), (None, text[3]), (3, near[3]), (5, text[4]), (5, near[4]), (5, near[4]), (8, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, "s") for i, t in rows], "doc_id long, text string, mark string, key_id string, row int, key_mark string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert [x for x in got if x[0] in (5, 6, 7) and x[1] in (text[0], near[0], text[1], near[1])] == [(5, text[0]), (5, text[1])]
    assert len([x for x in got if x[1] in (text[2], near[2])]) == 1
    assert [x for x in got if x[1] in (text[3], near[3])] == [(3, near[3])]
    assert len([x for x in got if x[1] in (text[4], near[4])]) == 1
    assert len([x for x in got if not x[1]]) == 2  # one of each (id, text)


def test_drop_exact_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z"), (2, "a  b", "x", "y", "z"), (None, "a b", "x", "y", "z"), (None, "c", "x", "y", "z"), (None, "c", "x", "y", "z"), (4, "d", "x", "y", "z")], "doc_id long, text string, __id string, mark string, key_id string")
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(1, "a b"), (4, "d"), (None, "c")]


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
