"""The other corpus operators against brute force, round trips and held-out accuracy."""

import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import decontaminate, exchange, language_id, license_scan, mixing_coder, ngram_lm, packing, token_store, toxicity, url_filter

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, score double, rule string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0.5, None) for i, t, g in rows], SCHEMA)


# -- language model


def brute_lm(rows, order, mu):
    def toks(t):
        return [w for w in WS.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["</s>"]

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter()
    n = 0
    uni = Counter()
    for i, t in rows:
        if not held[i]:
            s = ["<s>"] + toks(t)
            n += len(s) - 1
            uni.update(s[1:])
            for k in range(1, order + 1):
                counts.update(tuple(s[j : j + k]) for j in range(len(s) - k + 1))
    v = len(uni)

    def p(w, h):
        if not h:
            return (uni[w] + 0.1) / (n + 0.1 * (v + 1))
        return (counts[(*h, w)] + mu * p(w, h[1:])) / (counts[h] + mu)

    out = []
    for i, t in rows:
        s = ["<s>"] + toks(t)
        score = sum(math.log10(p(s[j], tuple(s[max(0, j - order + 1) : j]))) for j in range(1, len(s)))
        base = sum(math.log10(p(w, ())) for w in s[1:])
        out.append((i, held[i], len(s) - 1, sum(uni[w] > 0 for w in s[1:]), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("order,block,fan", [(1, 1 << 20, 256), (2, 300, 256), (2, 300, 4), (3, 500, 3), (4, 1 << 20, 256)])
def test_lm_against_brute_force(spark, monkeypatch, order, block, fan):
    monkeypatch.setattr(exchange, "SHARD_KEYS", 200)
    monkeypatch.setattr(exchange, "FAN", fan)
    assert exchange.Plan(7000).hops == {256: 1, 4: 3, 3: 4}[fan]
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("the of And a b c d É".split()) for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(200, None), (201, ""), (202, "  \n"), (203, "x y " * 3000), (204, "new1 new2 the of")]
    docs = frame(spark, [(i, t, None) for i, t in rows])
    got = sorted(tuple(r) for r in ngram_lm.score(docs, ngram_lm.fold("doc_id", 10) != 0, order=order, block_bytes=block).collect())
    want = brute_lm(rows, order, ngram_lm.MU)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_lm_empty(spark):
    assert ngram_lm.lm_scores(frame(spark, [])).count() == 0
    got = ngram_lm.score(frame(spark, [(None, "a b", None)]), ngram_lm.F.lit(False)).collect()
    assert got[0].base_score == 0 and got[0].score == pytest.approx(0)


# -- license scan


def test_license_phrases_against_regex(spark):
    rng = random.Random(5)
    pool = "under the MIT License apache version 2 2.0 cc by nc-by NC é . , \n".split(" ")
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 80)))) for i in range(150)] + [(900, None), (901, ""), (902, "CC BY NC cc-by-nc " * 2000), (903, "Under the MIT\nLicense, Apache License, Version 2")]
    got = {r.doc_id: r for r in license_scan.license_report(frame(spark, [(i, t, None) for i, t in rows])).collect()}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert r.first_word == min((k for k, _ in hits), default=None) and r.last_word == max((k for k, _ in hits), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.license_report(frame(spark, [])).count() == 0


def test_matching_statistics_by_brute_force():
    rng = random.Random(9)
    seqs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(12)] for _ in range(3)]
    auto = license_scan.SuffixAutomaton(seqs)
    factors = {tuple(s[i:j]): None for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for f in factors:
        s = auto.walk(list(f))
        assert auto.ends[s] == sorted({(n, j) for n, q in enumerate(seqs) for j in range(len(f), len(q) + 1) if tuple(q[j - len(f) : j]) == f})


def test_license_spans_survive_edits():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    label, text = license_scan.TEMPLATES[2]
    words = text.split()
    words[12:13] = ["somewhat", "changed"]
    spans = scanner.scan(("intro words here " + " ".join(words) + " and more").encode())["spans"]
    assert [s[0] for s in spans] == [label] and spans[0][1] == 3 and spans[0][3] > 0.9
    assert scanner.scan(b"this software and the license of the copyright")["spans"] == []


def test_license_chains_have_no_limit():
    """A template whose words repeat places each match in many spots; the chain still finds its way."""
    run = "all copies of the software must keep this notice"
    body = " ".join(f"{run} part{i}" for i in range(100))
    scanner = license_scan.Scanner([("many", body)], [])
    text = " ".join(f"{run} other{i}" for i in range(100))
    (span,) = scanner.scan(text.encode())["spans"]
    assert span[0] == "many" and span[1:3] == (0, 999) and span[3] == pytest.approx(0.9)


# -- language id


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcé ß.1İ\n", max_size=60), st.integers(1, 9))
def test_ngrams_do_not_depend_on_slices(text, size):
    old = language_id.SLICE
    whole = language_id.ngrams(text)
    try:
        language_id.SLICE = size
        parts = language_id.ngrams(text)
    finally:
        language_id.SLICE = old
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    words = "".join(c if c.isalpha() else " " for c in low).split()
    want = Counter()
    for w in words:
        want.update(w)
    line = " " + "".join(w + " " for w in words)
    for i in range(len(line) - 1):
        want[line[i : i + 2]] += 1
        if i + 2 < len(line) and line[i + 1] != " ":
            want[line[i : i + 3]] += 1
    if not words:
        want.clear()
    number = {sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)): n for g, n in want.items()}
    assert dict(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == number


def test_language_id(spark):
    rng = random.Random(2)
    pools = {"xx": "alpha beta gamma delta".split(), "yy": "öder über straße ähnlich".split()}
    rows = [(i, " ".join(rng.choice(pools[g]) for _ in range(12)), g) for i in range(80) for g in [rng.choice(["xx", "yy"])]] + [(900, None, "xx"), (901, "", None), (902, "12 34 !", "yy"), (903, "beta alpha", None)]
    got = {r.doc_id: r for r in language_id.language_id(frame(spark, rows)).collect()}
    assert all(got[i].lang_pred == g for i, t, g in rows if i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert language_id.language_id(frame(spark, [])).count() == 0
    assert language_id.language_id(frame(spark, [(1, "abc", None)])).first().lang_pred == "und"


def test_language_distance_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    known = {g: np.array(rng.sample(range(40), rng.randrange(0, 12)), np.int64) for g in ("b", "a", "c", "dd")}
    for _ in range(50):
        mine = np.array(rng.sample(range(45), rng.randrange(1, 15)), np.int64)
        far = {g: sum(abs(i - list(p).index(x)) if x in p else 12 for i, x in enumerate(mine)) for g, p in known.items()}
        assert language_id.Nearest(known, 12)(mine) == min((d, g) for g, d in far.items())
    pools = {f"l{i:02}": [chr(0x4E00 + 5 * i + j) for j in range(5)] for i in range(9)}
    rows = [(i, "".join(rng.choice(pools[g]) for _ in range(30)), g) for i in range(120) for g in [rng.choice(list(pools))]] + [(900, chr(0x30010) * 5, None), (901, "x " * 300_000, None), (950, "12", None), (None, "ab", None), (None, "ab", None)]
    whole = sorted(language_id.language_id(frame(spark, rows)).collect(), key=repr)
    monkeypatch.setattr(language_id, "LANGUAGES", 2)  # blocks of languages give the same
    assert sorted(language_id.language_id(frame(spark, rows)).collect(), key=repr) == whole
    by = {r.doc_id: r.lang_pred for r in whole}
    assert all(by[i] == g for i, _, g in rows if g and i < 900)
    assert by[900] != "und" and by[901] != "und" and len(whole) == len(rows)


# -- URL filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "", "block"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("B.com", "/X/y/", "allow")]


def test_url_rules_against_brute_force_and_parted(spark, monkeypatch):
    rng = random.Random(4)
    hosts = ["example.org", "www.example.org", "notexample.org", "a.com", "b.A.com", "b.com", "x.net", "", "org"]
    paths = ["", "/", "/es/", "/es", "/en/12/3", "/en/", "/x", "/xy/z", "/X/y/z", "//", "?q=/es/", "#/es/"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}{rng.choice(['', '?a=b://c', '#top'])}" for h in hosts for p in paths] + [None, "", "no scheme/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    monkeypatch.setattr(url_filter, "URLS", 5)
    joined = {r.page_id: r for r in url_filter.judge(pages, RULES, max_rules=2).collect()}
    assert len(joined) == len(urls)
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        rest = re.match(r"[^?#]*", rest)[0]
        host, path = re.match(r"[^/]*", rest)[0].lower(), re.sub(r"^[^/]*", "", rest)
        fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        want = max(fits) if fits else (0, 0, 0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, want[3], want[4])
        assert tuple(joined[i]) == tuple(got[i])
    assert url_filter.judge(pages.limit(0), RULES).count() == 0 and url_filter.judge(pages, []).where("verdict = 'allow'").count() == len(urls)


# -- decontamination


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é", min_size=1, max_size=24), st.text(alphabet="ab é", max_size=60), st.sampled_from([0.0, 0.1, 0.25]))
def test_matcher_against_brute_force(item, text, rate):
    m = decontaminate.Matcher([(1, item)], rate)
    k = int(rate * len(item))
    far = distance(item, text)
    got = m.find(text)
    assert bool(got) == (far <= k and bool(text))
    assert not got or far <= got[0][1] <= k


def test_decontamination(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and then it runs far away"
    rows = [(1, f"before {item.upper()} after", None), (2, "x\n" + item.replace("fox", "fix").replace(" ", "\n\t") + " y", None), (3, "nothing here", None), (4, None, None), (5, "", None), (6, "word " * 40_000 + item, None), (None, item, None)]
    bench = spark.createDataFrame([(7, item, "t"), (8, None, "t"), (9, "", "t"), (10, item, "t")], "item_id long, text string, doc_id string")
    for block in (1 << 20, 10):  # in one block, and one item a block
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = {r.doc_id: (r.item_ids, r.distances) for r in decontaminate.matches(frame(spark, rows), bench).collect()}
        assert got == {1: ([7, 10], [0, 0]), 2: ([7, 10], [1, 1]), 3: ([], []), 4: ([], []), 5: ([], []), 6: ([7, 10], [0, 0]), None: ([7, 10], [0, 0])}
        kept = decontaminate.drop_contaminated(frame(spark, rows), bench)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and "rule" in kept.columns
    assert decontaminate.matches(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.matches(frame(spark, []), bench).count() == 0


def test_short_items_have_their_budget():
    item = "nine and thirty letters are in this it."
    assert len(item) == 39
    for edited, far in ((item, 0), (item.replace("thirty", "thirsty"), 1), (item.replace("and", "bnb"), 2), (item.replace("letters", "lXttXXs"), 3), (item.replace("letters", "lXXXXXs"), None)):
        got = decontaminate.Matcher([(1, item)]).find(f"some text before {edited} and behind")
        assert bool(got) == (far is not None) and (far is None or got[0][1] <= 3)


def test_decontamination_judges_rows_by_their_text(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and then it runs far away"
    rows = [(None, item), (None, "clean"), (5, item), (5, "clean"), (5, "clean"), (6, None)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, __id string, judged_text string, h int")
    bench = spark.createDataFrame([(1, item), (2, "another item that is nowhere to be found in any of the texts")], "item_id long, text string")
    for block in (1 << 20, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        kept = decontaminate.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(5, "clean"), (5, "clean"), (6, None), (None, "clean")]
        got = sorted(((r.doc_id, r.contaminated) for r in decontaminate.matches(docs, bench).collect()), key=repr)
        assert got == [(5, False), (5, False), (5, True), (6, False), (None, False), (None, True)]


# -- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 4), st.integers(0, 6)), max_size=40))
def test_best_fit_against_plain_search(rows):
    rows = sorted(((n, 1 << s, 1 << c) for n, s, c in rows), key=lambda x: -x[0])
    got = packing.best_fit(rows, 20)
    bins: list = []
    for (n, s, c), b in zip(rows, got, strict=True):
        fits = [(room, i) for i, (room, ss, cc) in enumerate(bins) if room >= n and not ss & s and not cc & c]
        if fits:
            assert b == min(fits)[1]
            room, ss, cc = bins[b]
            bins[b] = (room - n, ss | s, cc | c)
        else:
            assert b == len(bins)
            bins.append((20 - n, s, c))


def test_packing(spark):
    rows = [(i, "w " * (i % 9), None) for i in range(60)] + [(900, None, None), (901, "x " * 95, None), (None, "a b", None), (None, "a b", None)]
    docs = frame(spark, rows).withColumn("source", packing.F.when(packing.F.col("doc_id") % 3 == 0, "hot").otherwise(packing.F.col("doc_id").cast("string")))
    got = packing.pack(docs, capacity=20, cluster=packing.text_cluster(), shard_rows=30).collect()
    by_bin: dict = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r)
    for rs in by_bin.values():
        assert sum(r.n_tokens for r in rs) == rs[0].bin_fill <= 20
        assert sorted((r.bin_start, r.n_tokens) for r in rs)[0][0] == 0
        names = [r.source for r in rs if r.source]
        assert len(names) == len(set(names))
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == Counter({i: len((t or "").split()) + 1 for i, t, _ in rows if i is not None} | {None: 6})
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_deals_repeated_rows_and_fills_bins(spark):
    """Rows without id and with one text are spread over shards; shards cost little fill beside one search over all."""
    rng = random.Random(7)
    rows = [(None, "same " * 9, "s")] * 300 + [(i, "w " * rng.randrange(1, 900), str(i)) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").withColumn("source", packing.F.when(packing.F.col("doc_id").isNotNull(), packing.F.col("source")))
    shards = packing.pack(docs, shard_rows=500).collect()
    assert max(Counter(r.bin_id.split("-")[0] for r in shards if r.doc_id is None).values()) < 150
    total = sum(r.n_tokens for r in shards)
    fill = total / (2048 * len({r.bin_id for r in shards}))
    sizes = sorted((r.n_tokens for r in shards), reverse=True)
    best = total / (2048 * (1 + max(packing.best_fit([(n, 0, 0) for n in sizes], 2048))))
    assert best - 0.02 < fill <= best


# -- token store


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 30), st.integers(0, 2**32 - 1)), max_size=300), st.integers(1, 90))
def test_coder_round_trip(ids, block):
    blocks = mixing_coder.encode(np.array(ids, np.int64), block)
    assert [x for b in mixing_coder.decode(blocks) for x in b.tolist()] == ids


@pytest.mark.parametrize("n,lanes", [(20_000, 64), (129, 2048), (4096, 1), (40_001, 7)])
def test_coder_stretches(monkeypatch, n, lanes):
    monkeypatch.setattr(mixing_coder, "LANES", lanes)
    monkeypatch.setattr(mixing_coder, "REFRESH", 500)
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 60_000, n), np.arange(n) % 50)
    blocks = mixing_coder.encode(ids)
    assert (np.concatenate(mixing_coder.decode(blocks)) == ids).all()


def test_coder_learns_each_order():
    """Sequences that one order alone predicts cost far less than their entropy without it."""
    rng = np.random.default_rng(1)
    n = 60_000
    skewed = rng.geometric(0.4, n)
    follows = rng.permutation(3000)
    one = np.empty(n, np.int64)
    one[0] = 0
    for i in range(1, n):
        one[i] = follows[one[i - 1]] if rng.random() < 0.9 else rng.integers(3000)
    cost = lambda ids: 8 * sum(map(len, mixing_coder.encode(ids))) / n
    assert cost(skewed) < 3.2  # entropy 2.43 bits; an even code of its 13 ids costs 3.7. Guesses that miss waste the rest.
    assert cost(one) < 4  # without order 1: 11.6 bits
    two = [1, 2]
    while len(two) < n:
        two.append((3 * two[-1] + 5 * two[-2] + 1) % 41)
    assert cost(np.array(two)) < 1.5  # without order 2: 5.4 bits


def test_coder_many_distinct_and_damaged():
    ids = np.random.default_rng(0).permutation(70_000)
    blocks = mixing_coder.encode(ids)
    assert len(blocks) > 2 and (np.concatenate(mixing_coder.decode(blocks)) == ids).all()
    block = mixing_coder.encode(np.arange(9000) % 700)[0]
    for at in range(0, len(block), 7):
        with pytest.raises(ValueError):
            mixing_coder.decode([block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :]])
    with pytest.raises(ValueError):
        mixing_coder.decode([block[:-3]])
    with pytest.raises(ValueError):
        mixing_coder.encode(np.array([2**32]))


P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  a", "a  b ", "x\n y", "\u00a0 b", "it's 'tis  we'll\t\tgo ", "a<|endoftext|> b", "é漢 字\u3000x", "\n\n \n a", "a " * 50, "\0end", "\0"]


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab 1.'\n\té漢\u00a0\u3000", max_size=30))
def test_encoder_equals_tokenizer(text):
    e = _encoder()
    texts = [text, *ODD]
    ids, sizes = e(texts)
    want = [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert [len(x) for x in e([])] == [0, 0]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_store, "STRETCHES", 3)
    e = token_store.Encoder(P.path("byte_bpe_50k.json"))
    for t in ("a b c d", "b c", "e f g a b"):
        assert e([t])[0].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


@given(st.text(alphabet="ab Z9.'<|\n\t\x1f\x85éÑ×÷ɏɐ²ª漢🙂\u0301\u200b", max_size=12))
def test_encoder_cuts_at_line_feeds(text):
    e = _encoder()
    for t in (text, text + "\n" + text, f"é{text}\nÀ"):
        assert e([t])[0].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_encoder_meets_words_at_line_feeds_once():
    assert token_store.Encoder.stretches("on.\nWas on.\nAn on.\nWas") == [("on.",), "\nWas", "on.", "\nAn", "on.", "\nWas"]
    e = token_store.Encoder(P.path("byte_bpe_50k.json"))
    e(["a été.\nÀ b été.\nIci"])
    pieces = set(e.pieces)
    assert pieces == {"a", " été", ".", "\n", "À", " b", "Ici"}
    e.forget()
    assert set(e.pieces) == pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé ,.\n\x01\x1c\xa0'1漢", max_size=14), max_size=4))
def test_encoder_cuts_off_marks(texts):
    e = _encoder()
    texts = [*texts, "ab, a. b", "ab,. a", " ,a", " \x01, a", "\x01.", "a,", ".", "\na, b", "a\u0301, b", "it's, we'll."]
    ids, sizes = e(texts)
    want = [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_encoder_meets_words_before_marks_once():
    e = token_store.Encoder(P.path("byte_bpe_50k.json"))
    e(["On and, on and. Été, été on.\nOn été"])
    names = {n for n in e.known if n and isinstance(n, str)}
    assert names == {"and", "on", "Été", "été", "\nOn", "\x01,", "\x01."}  # with their marks they were stretches of their own


def _encoder(cache=[]):  # noqa: B006
    if not cache:
        cache.append(token_store.Encoder(P.path("byte_bpe_50k.json")))
    return cache[0]


def test_token_store(spark, monkeypatch):
    rows = [(i, "some words here and there " * (i % 7), None) for i in range(40, 0, -1)] + [(100, None, None), (101, "long " * 9000, None), (7, "twice", None), (7, "twice", None), (None, "no id", None)]
    store = token_store.write(frame(spark, rows), P.path("byte_bpe_50k.json"))
    got = token_store.read(store).collect()
    e, start = _encoder(), 0
    assert len(got) == len(rows)
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        by.setdefault(r.doc_id, []).append(list(struct.unpack(f"<{r.n_tokens}I", r.ids)))
    assert list(by)[0] is None and list(by)[1:] == sorted(list(by)[1:])
    for i, t, _ in rows:
        assert e([t or ""])[0].tolist() in by[i]
    assert len(by[7]) == 3
    # The index of each file lists the segments that the table lists, and a segment reads on its own.
    for path in {r.path for r in store.collect()}:
        assert token_store.read_index(path) == [(r.offset, r.bytes, r.n_ids) for r in store.where(store.path == path).orderBy("segment").collect()]
    one = store.first()
    names, sizes, ids = token_store.read_segment(one.path, one.offset, one.bytes)
    assert len(names) == len(sizes) == one.n_docs and len(ids) == one.n_ids
    with pytest.raises((ValueError, OSError)):
        token_store.read_segment(one.path, one.offset + 1, one.bytes)
    monkeypatch.setattr(mixing_coder, "BLOCK_IDS", 100)
    texts = spark.createDataFrame([("b", "x y z " * 99), ("a", None)], "name string, body string")
    named = token_store.read(token_store.write(texts, P.path("byte_bpe_50k.json"), id_col="name", text_col="body"), "string").orderBy("start").collect()
    assert [r.doc_id for r in named] == ["a", "b"] and named[0].n_tokens == 1
    assert token_store.token_report(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


# -- toxicity


def test_toxicity_learns_and_catches_misspellings(spark):
    rng = random.Random(1)
    pool = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit") for b in ("um", "or", "et", "am")]
    bad = ["blargface", "snorkhead", "vilewort"]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(pool) for _ in range(rng.randrange(5, 120))]
        y = int(rng.random() < 0.3)
        if y:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), None))
        labels.append((i, y))
    rows += [(900, None, None), (901, "", None), (902, "lorum ipsor blargfacce sitam", None)]
    labels += [(900, None), (5000, 1)]
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    truth = dict(labels)
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert got[902].score > got[901].score == got[900].score == 0
    none = toxicity.toxicity(frame(spark, rows[:3]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}
    kept = toxicity.drop_toxic(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and 300 < kept.count() < 400


def test_toxicity_gradients_by_differences():
    rng = np.random.default_rng(3)
    emb, out, bias = rng.normal(size=(9, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    row = np.array([0, 0, 0, 1, 2, 2])
    sub, weight, target = np.array([1, 3, 1, 8, 0, 3]), rng.random(6), np.array([1, 0, 1])
    loss = lambda: toxicity.gradients(emb, out, bias, sub, row, weight, target)[0]
    _, buckets, d_emb, d_out, d_bias = toxicity.gradients(emb, out, bias, sub, row, weight, target)
    whole = np.zeros_like(emb)
    whole[buckets] = d_emb
    for values, slopes in ((emb, whole), (out, d_out), (bias, d_bias)):
        for i in np.ndindex(values.shape):
            old = values[i]
            values[i] = old + 1e-6
            up = loss()
            values[i] = old - 1e-6
            down = loss()
            values[i] = old
            assert slopes[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_toxicity_score_by_brute_force():
    """A document's score is that of the passage whose mean over words of the mean over subwords is largest."""
    rng = random.Random(4)
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), -0.4, 1.7, 0.2)
    for n in (1, 5, 32, 47, 48, 49, 100, 20_000):
        found = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
        values = []
        for w in found:
            marked = f"<{w}>"
            grams = [marked[i : i + k] for k in (3, 4, 5) for i in range(len(marked) - k + 1)]
            values.append(np.mean([model.weights[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in ["=" + w, *grams]]))
        cuts = list(range(0, n, 32))
        if len(cuts) > 1 and n - cuts[-1] < 16:
            cuts.pop()
        best = max(np.mean(values[a:b]) for a, b in zip(cuts, [*cuts[1:], n], strict=True))
        assert toxicity.Scorer(model)(" ".join(found).replace("a", "A").encode()) == pytest.approx(1 / (1 + math.exp(-(1.7 * (best - 0.4) + 0.2))))


def test_toxicity_awkward_rows(spark):
    """Null and repeated ids are judged by their own text; labels without documents don't shrink the fit; columns may clash."""
    rng = random.Random(2)
    bad, pool = "blargface snorkhead vilewort", ["lorum", "ipsor", "dolam", "sitet", "conum"]
    rows, labels = [], []
    for i in range(300):
        y = i % 3 == 0
        rows.append((i, " ".join([*(rng.choice(pool) for _ in range(20)), *([bad] if y else [])]), "x", "y"))
        labels.append((i, int(y)))
    planted = [(None, bad), (None, "lorum ipsor " * 9), (5, bad + " " + bad), (5, "lorum ipsor " * 9), (5, "lorum ipsor " * 9), (7000, "lorum ipsor dolam sitet conum " * 10_000)]
    rows += [(i, t, "x", "y") for i, t in planted]
    docs = spark.createDataFrame(rows, "doc_id long, text string, judged_text string, __id string")
    marks = spark.createDataFrame(labels + [(i, 0) for i in range(10_000, 40_000)] + [(None, 1)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert [x for x in planted if x in got] == [x for x in planted if bad not in x[1]]
    assert got.count(planted[3]) == 2
    assert {r.toxic for r in marks.join(kept, "doc_id").collect()} == {0}
