"""Queries without SQL against plain Python versions of what they say, on the smallest tables."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from seqloom.llm import byte_cnn, language_id, mixing, queries, toxicity, urls
from seqloom.llm.common import CODE

M64 = (1 << 64) - 1


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash64(*values):
    """Spark's xxhash64 of integers (a literal int is ("i", n)) and texts."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return signed(seed)


@pytest.fixture(scope="module")
def tables(sf_dir):
    return {t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist() for t in ("documents", "labels", "pages")}


def rows_of(spark, sf_dir, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


# ---------------------------------------------------------------- word fields


def letter(b):
    return 65 <= b <= 90 or 97 <= b <= 122 or b >= 128


def words(text):
    """(start, end, lowered bytes) of the runs of letters, over the bytes."""
    raw = bytearray((text or "").encode())
    low = bytearray(b + 32 if 65 <= b <= 90 else b for b in raw)
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
            low[i] += 0x20
    out, at = [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and letter(low[end]):
            end += 1
        if end > at:
            out.append((at, end, bytes(low[at:end])))
        at = end + 1 if end == at else end
    return out


def word_hash(word):
    x, p = 0, 1
    for b in word:
        x = (x + int(CODE[b]) * p) & M64
        p = p * 0x9E3779B97F4A7C15 & M64
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def features(word):
    framed = b" " + word + b" "
    out = [framed[i] | framed[i + 1] << 8 for i in range(len(framed) - 1)]
    for i in range(len(framed) - 2):
        three = (framed[i] | framed[i + 1] << 8) * 40503 + framed[i + 2] * 2654435
        out.append((three ^ three >> 15) & 0xFFFF | 1 << 16)
        if i + 3 < len(framed):
            four = (three * 31 + framed[i + 3] * 7368787) >> 7
            out.append((four ^ four >> 19) & 0x1FFFF | 1 << 17)
    return [*out, word_hash(word) >> 46 | 1 << 18]


def marginals(model, text, cache):
    """Forward-backward word by word, in log space."""
    found, k = words(text), len(model.start)
    for _, _, w in found:
        if w not in cache:
            cache[w] = [sum(float(model.weights[f, s]) for f in features(w)) for s in range(k)]
    emit = [cache[w] for _, _, w in found]

    def lse(xs):
        m = max(xs)
        return m + math.log(sum(math.exp(x - m) for x in xs))

    trans, a, b = model.trans.tolist(), [], []
    for i, e in enumerate(emit):
        a.append([e[s] + (float(model.start[s]) if not i else lse([a[-1][t] + trans[t][s] for t in range(k)])) for s in range(k)])
    for i in reversed(range(len(emit))):
        b.insert(0, [0.0] * k if i == len(emit) - 1 else [lse([trans[s][t] + emit[i + 1][t] + b[0][t] for t in range(k)]) for s in range(k)])
    z = lse(a[-1]) if emit else 0.0
    return found, [[math.exp(x + y - z) for x, y in zip(p, q)] for p, q in zip(a, b)]


def short(tables, most=6000):
    """Every document but the longest, which plain Python takes too long for."""
    return [r for r in tables["documents"] if len(r["text"] or "") <= most]


def test_language_query(spark, sf_dir, tables):
    learnable = [r for r in tables["documents"] if r["lang"] is not None and r["text"] is not None and fold(r["doc_id"], 3) != 1]
    chosen = []
    for lang in {r["lang"] for r in learnable}:
        chosen += sorted((r for r in learnable if r["lang"] == lang), key=lambda r: hash64(r["doc_id"]))[:200]
    model = language_id.LanguageModel.train([(r["text"].encode(), r["lang"]) for r in sorted(chosen, key=lambda r: r["doc_id"])])
    got, cache = rows_of(spark, sf_dir, "op4_language_id"), {}
    assert set(got) == {r["doc_id"] for r in tables["documents"]}
    for r in short(tables):
        found, p = marginals(model.model, r["text"], cache)
        g = got[r["doc_id"]]
        assert g["held_out"] == (fold(r["doc_id"], 3) == 1)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (g["lang_pred"], g["score"]) == ("und", 0)
            continue
        share = [sum(x[s] for x in p) / len(found) for s in range(len(model.langs))]
        assert g["score"] == pytest.approx(max(share), abs=1e-4)
        assert share[model.langs.index(g["lang_pred"])] == pytest.approx(max(share), abs=1e-4)


def labelled(tables, label, folds=5):
    texts = {r["doc_id"]: r["text"] or "" for r in tables["documents"]}
    return [(texts[i], y) for i, y in sorted((r["doc_id"], r[label]) for r in tables["labels"] if r[label] in (0, 1) and fold(r["doc_id"], folds)) if i in texts]


def test_toxicity_query(spark, sf_dir, tables):
    rows = labelled(tables, "toxic")
    counts = Counter(y for _, y in rows)
    model = toxicity.ToxicModel.train(rows, [counts[0], counts[1]])
    got, cache = rows_of(spark, sf_dir, "op3_toxicity"), {}
    assert set(got) == {r["doc_id"] for r in tables["documents"]}
    for r in short(tables):
        _, p = marginals(model.model, r["text"], cache)
        q = [x[1] for x in p]
        top = min(max([*q, 0.0]), 1 - 1e-4)
        top = max(top, 1e-4)
        z = sum(c * x for c, x in zip(model.calibration, (1.0, math.log(sum(q) + 0.05), math.log(top / (1 - top)))))
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)
        assert g["held_out"] == (fold(r["doc_id"], 5) == 0) and g["predicted"] == int(g["score"] >= 0.5)


def test_quality_query(spark, sf_dir, tables):
    rows = labelled(tables, "quality")
    counts = Counter(y for _, y in rows)
    net = byte_cnn.QualityModel.train(rows, [counts[0], counts[1]]).network
    got, taps, reach = rows_of(spark, sf_dir, "op5_quality_cnn"), byte_cnn.TAPS, byte_cnn.TAPS[-1]
    assert set(got) == {r["doc_id"] for r in tables["documents"]}
    for r in short(tables):
        raw = (r["text"] or "").encode()
        symbols, before, run = list(raw), None, 0
        for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
            run = run + 1 if m.group() == before else 0
            before = m.group()
            for i in range(*m.span()):
                symbols[i] += 256 * min(run, 2)
        halves = -(-(len(raw) + reach) // 256)
        symbols += [0] * (halves * 256 + reach - len(raw))
        x = np.array(symbols)
        # a filter's response at a byte, of whose taps none lies behind the padding
        responses = sum(net.p["taps"][k][x[t : t + halves * 256 - reach]] for k, t in enumerate(taps))
        pools = [responses[256 * h : 256 * h + 512].max(0) for h in range(max(halves - 1, 1))]
        hidden = [np.maximum(np.maximum(p + net.p["bias"], 0) @ net.p["into"] + net.p["hid"], 0) for p in pools]
        z = np.concatenate([np.mean(hidden, 0), np.max(hidden, 0)]) @ net.p["out"] + net.p["end"][0]
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-float(z))), abs=2e-3)
        assert g["held_out"] == (fold(r["doc_id"], 5) == 0) and g["predicted"] == int(g["score"] >= 0.3)


# ---------------------------------------------------------------- mixing


def test_mixing_query(spark, sf_dir, tables):
    docs = [(r["doc_id"], r["source"], len([w for w in re.split(r"[ \t-\r]+", r["text"] or "") if w])) for r in tables["documents"]]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, t, n in docs if t == s) for s in names}
    goal, free, left = {}, [s for s in names if size[s]], sum(size.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while free:  # round by round: who is above the bound gets the bound
        over = [s for s in free if left * weight[s] / sum(weight[t] for t in free) > 3 * size[s]]
        if not over:
            goal |= {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
            break
        goal |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free = [s for s in free if s not in over]
    block = {s: 256 if goal.get(s, 0) >= 200 * 256 else 8 if goal.get(s, 0) >= 1600 else 1 for s in names}
    shards = defaultdict(list)
    for i, s, n in docs:
        parts = max(1, -(-sum(1 for d in docs if d[1] == s) // 1000))
        shards[s, hash64(("i", 7), i, n) % parts].append((hash64(("i", 8), i), i, n))
    words = {k: sum(n for *_, n in v) for k, v in shards.items()}
    blocks = {k: max(1, round(words[k] / block[k[0]])) for k in shards if words[k]}

    def seats(votes, caps, total):
        won = dict.fromkeys(votes, 0)
        for _ in range(min(total, sum(caps.values()))):
            best = max((s for s in votes if won[s] < caps[s]), key=lambda s: votes[s] / (2 * won[s] + 1))
            won[best] += 1
        return won

    taken = {}
    for size_of_block in set(block.values()):
        mine = [s for s in names if block[s] == size_of_block and goal.get(s)]
        whole = {s: sum(b for k, b in blocks.items() if k[0] == s) for s in mine}
        wanted = {s: goal[s] * whole[s] / size[s] for s in mine}
        won = seats(wanted, {s: 3 * whole[s] for s in mine}, round(sum(wanted.values())))
        for s in mine:
            keys = sorted(k for k in blocks if k[0] == s)
            quota = seats({k: blocks[k] for k in keys}, {k: 3 * blocks[k] for k in keys}, won[s])
            for k in keys:
                n, c, at = blocks[k], (7 * 7919 + 31 * k[1]) % blocks[k], 0
                cuts = [j * words[k] // n for j in range(n + 1)]
                times = [quota[k] // n + ((j + c) % n < quota[k] % n) for j in range(n)]
                per_word = [t for j, t in enumerate(times) for _ in range(cuts[j], cuts[j + 1])]
                for _, i, length in sorted(shards[k]):
                    taken[i] = sum(per_word[at : at + length])
                    at += length
    got = rows_of(spark, sf_dir, "op7_mixing")
    assert {i: g["taken"] for i, g in got.items()} == {i: taken.get(i, 0) for i, _, _ in docs}
    assert all(got[i]["target"] == pytest.approx(goal.get(s, 0.0)) and got[i]["source_size"] == size[s] and got[i]["size"] == n for i, s, n in docs)
    assert mixing.sainte_lague(np.array([3.0, 1]), np.array([9, 9]), 4).tolist() == [3, 1]


# ---------------------------------------------------------------- URLs


def witten_bell(texts, order):
    count, total, kinds = Counter(), Counter(), Counter()
    for t in texts:
        raw = t.encode() + b"\0"
        for i in range(len(raw)):
            for k in range(min(i, order) + 1):
                c = raw[i - k : i]
                kinds[c] += not count[c, raw[i]]
                count[c, raw[i]] += 1
                total[c] += 1

    def log_p(text):
        raw, out = text.encode() + b"\0", 0.0
        for i in range(len(raw)):
            p = 1 / 256
            for k in range(min(i, order) + 1):
                c = raw[i - k : i]
                if total[c]:
                    p = (count[c, raw[i]] + kinds[c] * p) / (total[c] + kinds[c])
            out += math.log(p)
        return out

    return log_p


def ratio(good, bad, order=5):
    a, b = witten_bell(good, order), witten_bell(bad, order)
    return lambda t: (a(t) - b(t)) / (len(t.encode()) + 1)


def rule_of(host, path):
    best = (None, None)
    for what, rule in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[1] or ""):
            best = (what, rule)
    return best


def test_url_query(spark, sf_dir, tables):
    want = {}
    for r in tables["pages"]:
        url = r["url"] or ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1] if "://" in url else "", re.S)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m.group(1))
        want[r["page_id"]] = (url, host, m.group(2), *rule_of(host, m.group(2)))
    lists = {v: sorted({w[0] for w in want.values() if w[3] == v}, key=lambda u: hash64(u)) for v in ("allow", "block")}
    good, bad = lists["allow"], lists["block"]
    held = ratio([t for i, t in enumerate(good) if i % 4], [t for i, t in enumerate(bad) if i % 4])
    g, b = [held(t) for t in good[::4]], [held(t) for t in bad[::4]]
    cuts = sorted({*g, *b})
    error = [sum(x < c for x in g) / len(g) + sum(x >= c for x in b) / len(b) for c in cuts]
    best = [i for i, e in enumerate(error) if e <= min(error) + 1e-12]
    at = best[len(best) // 2]
    threshold, model = (cuts[at] + cuts[at - 1]) / 2 if at else cuts[at], ratio(good, bad)
    got, judged = rows_of(spark, sf_dir, "op9_url_filters", "page_id"), 0
    assert set(got) == set(want)
    for i, (url, host, path, verdict, rule) in want.items():
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule is None:
            judged += 1
            score = model(url) - threshold
            assert r["score"] == pytest.approx(score, abs=1e-6)
            verdict = "allow" if score >= 0 else "block"
        assert r["verdict"] == verdict
    assert judged > 0


def test_url_models_learn_from_all_ruled_urls(spark, monkeypatch):
    """More than 20000 urls a class, one of them long, in one part and task and in many: as fitted on lists of them all."""
    good = [f"http://a.com/{i * 7919 % 100003}/p{i % 13}" for i in range(21000)] + ["http://a.com/" + "long/" * 1000]
    bad = [f"http://b.net/es/{i * 104729 % 100019}-q{i % 11}" for i in range(20500)] + [f"http://b.net/fr/{i}" for i in range(5)]
    asked = ["http://c.org/77/p5", "http://c.org/fr/9-q3", "long/long/", "", "é\0", "http://c.org/" + "4/p" * 3000]
    want = urls.train(sorted(good, key=hash64), sorted(bad, key=hash64)).score(asked)
    pages = spark.createDataFrame([(u,) for u in [*good, *bad, *asked, *good[:3000]]], "url string").repartition(3)

    def scores():
        got = {r["url"]: r["score"] for r in urls.judge(pages).where("rule is null").collect()}
        return [got[u] for u in asked]

    assert scores() == pytest.approx(list(want), abs=1e-9)
    for name, few in (("PART_GRAMS", 20_000), ("HELD_BYTES", 50), ("PLACED_ROWS", 6000)):
        monkeypatch.setattr(urls, name, few)
    assert scores() == pytest.approx(list(want), abs=1e-9)


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 9), (3, 1), (4, 2)])
def test_url_threshold_is_of_least_error(spark, monkeypatch, seed, n):
    rng = np.random.default_rng(seed)
    g, b = (rng.integers(0, 12, n) + shift for shift in (2, 0))
    cuts = sorted({*g, *b})
    error = [np.mean(g < c) + np.mean(b >= c) for c in cuts]
    best = [i for i, e in enumerate(error) if e <= min(error) + 1e-12]
    at = best[len(best) // 2]
    rows = [("allow", float(x)) for x in g] + [("block", float(x)) for x in b]
    scores = spark.createDataFrame(rows, "verdict string, score double")
    for placed in (50_000, 2):
        monkeypatch.setattr(urls, "PLACED_ROWS", placed)
        assert urls.calibrated(scores, urls.Scratch(spark, "t")) == ((cuts[at] + cuts[at - 1]) / 2 if at else cuts[at])
