"""License scans, quality rules, URL filters, language, toxicity and quality models."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import byte_cnn, language_id, licenses, quality_rules, queries, toxicity, urls
from seqloom.llm.chain import marginals
from seqloom.llm.common import flat
from seqloom.llm.word_crf import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "\n".join("The " + " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(12)) + " end." for i in range(5))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and an extra column with a clashing name."""
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word " * 20000, "en"), (5, GOOD, "en"), (5, GOOD, "en"), (None, GOOD, "en"), (6, "!!!", "fr"), (7, "日本語 ünï", "en")]
    out = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)
    return out.withColumns({"score": F.lit("extra"), "kept": F.lit(3), "licenses": F.lit(1), "words": F.lit(0)})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 0
    assert sorted(map(tuple, got[columns].astype(str).to_numpy())) == sorted(map(tuple, want[columns].astype(str).to_numpy()))


# ---------------------------------------------------------------- licences


def test_license_rules_take_the_longest_run(spark):
    apache = ". ".join(["Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the License", "You may obtain a copy of the License at", licenses.SENTENCES["ApacheUnless"], licenses.SENTENCES["ApacheSee"]])
    texts = [apache, "Intro.\nLicensed under CC BY-NC 4.0.\nMore. Released under the MIT License!", "See the GNU General Public License for more details.", "Copyright (c) 2020 A Holder. All rights reserved.", "A licence to kill, permitted.", "Licensed under the MIT License. Licensed under the MIT License."]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert got[0]["licenses"] == ["Apache-2.0"] and got[0]["n_known"] == 5
    assert sorted(got[1]["licenses"]) == ["CC-BY-NC-4.0", "MIT"]
    assert got[2]["licenses"] == [] and got[2]["unused"] == [" GplSee "] or [u.strip() for u in got[2]["unused"]] == ["GplSee"]
    assert got[3]["licenses"] == ["Proprietary"] and not got[3]["unused"]
    assert got[4]["n_known"] == 0
    assert got[5]["licenses"] == ["MIT", "MIT"]


#: published notices, each a line, and what they grant
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD2 = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
BSD3 = BSD2.replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS")
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2").replace("program. If not", "program; if not")
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
FULL = {APACHE: "Apache-2.0", MIT: "MIT", BSD2: "BSD-2-Clause", BSD3: "BSD-3-Clause", ISC: "ISC", GPL3: "GPL-3.0-or-later", GPL2: "GPL-2.0-or-later", MPL: "MPL-2.0"}
SHORT = {"SPDX-License-Identifier: " + w: n for w, n in {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD-3-Clause", "GPL-3.0-or-later": "GPL-3.0-or-later"}.items()}
SHORT |= {"Licensed under the BSD License.": "BSD", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "This is free and unencumbered software released into the public domain.": "Unlicense"}


def check_licenses(spark, notices):
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, list(notices))).collect()}
    for i, (text, name) in enumerate(notices.items()):
        assert (got[i]["licenses"], got[i]["unused"]) == ([name], []), text


def test_license_notices_with_marks_inside(spark):
    first = {GPL3.split(". ")[0] + ".": "GPL-3.0-or-later", GPL2.split(". ")[0] + ".": "GPL-2.0-or-later", MPL.split(" If ")[0]: "MPL-2.0"}
    check_licenses(spark, FULL | SHORT | first)


@pytest.mark.parametrize("marker", ["", "# ", " * ", "// ", "REM ", "dnl "])
def test_license_files_with_wrapped_lines(spark, marker):
    import textwrap

    wrap = lambda text, width, end: end.join(marker + line for line in textwrap.wrap(text, width, break_on_hyphens=False))
    items = {BSD3.replace(": 1. ", ": 1) ").replace(" 2. ", " 2) ").replace(" 3. ", " 3) "): "BSD-3-Clause"}
    lines = {"\n".join(wrap(part, 72, "\n") for part in t.replace(" 1) ", "\n1) ").replace(" 2) ", "\n2) ").replace(" 3) ", "\n3) ").split("\n")): n for t, n in items.items()}
    check_licenses(spark, lines | {wrap(t, 76, "\r\n"): n for t, n in FULL.items()} | {"prose without an end\n" + wrap(t, 70, "\n") + "\nprose": n for t, n in (FULL | SHORT).items()})


def test_license_words_parted_by_other_blanks(spark):
    texts = ["This work is in the public  domain.", "This work is in the public\tdomain.", "this work is in the public-domain", "This work is in the public\u00a0domain."]
    check_licenses(spark, {t: "Public-Domain" for t in texts} | {"Licensed under CC_BY 4.0": "CC-BY-4.0"})


def test_license_files_with_title_and_copyright(spark):
    import textwrap

    fill = lambda t: "\n".join(textwrap.wrap(t, 78))
    epl = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    bsd = lambda t: fill("Copyright (c) 2020, A Holder") + "\nAll rights reserved.\n\n" + fill(t)
    files = {"MIT License\n\nCopyright (c) 2020 A Holder\n\n" + fill(MIT): "MIT", "The MIT License\n\nCopyright (c) 2019-2021 A Holder\n\n" + fill(MIT): "MIT", bsd(BSD3): "BSD-3-Clause", bsd(BSD2): "BSD-2-Clause", "Copyright 2020 A Holder\n\n" + fill(ISC): "ISC", epl: "EPL-2.0", epl + "\n\nSPDX-License-Identifier: EPL-2.0\n": "EPL-2.0", "/*\n * " + fill(epl).replace("\n", "\n * ") + "\n */": "EPL-2.0"}
    check_licenses(spark, files)


def test_known_sentences_survive_the_cut(spark):
    got = licenses.scan(docs(spark, list(licenses.SENTENCES.values()))).orderBy("doc_id").collect()
    assert [r["sentence_ids"] for r in got] == [[i] for i in licenses.SENTENCES]


def test_license_odd_rows(spark, odd):
    assert licenses.digest(odd).count() == odd.count()
    assert licenses.digest(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- quality rules


def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(hit)


def test_quality_base_figures(spark):
    rng = np.random.default_rng(0)
    texts = ["a b c a b c d", "x x x x", "a b", GOOD, "q\nq\n\nq r\x0b#|s"] + [" ".join(rng.choice(list("abc"), 30)) for _ in range(10)]
    for r in quality_rules.judge(docs(spark, texts)).collect():
        words = texts[r["doc_id"]].replace("\x0b", " ").split()
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_repeat_words"] == brute_repeats(words)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    assert got[4]["n_dup_lines"] == 1 and got[4]["n_symbols"] == 2
    assert got[3]["kept"] and not got[3]["base_failed"]


def test_quality_lines_go_and_documents_that_lose_too_much(spark):
    shout = " ".join(f"LOUD{i}!!" for i in range(20))
    bar = " | ".join(f"menu{i}" for i in range(20))
    texts = [GOOD + "\n" + bar + "\nWe use a cookie policy here.", GOOD + "\n" + "\n".join(shout + str(i) for i in range(20)), "\n".join(" ".join(f"w{i}x{j}%%%" for j in range(12)) for i in range(6))]
    got = {r["doc_id"]: r["text"] for r in quality_rules.clean(docs(spark, texts)).collect()}
    assert got == {0: GOOD}


def test_quality_long_lines_may_mention_a_phrase(spark):
    one = GOOD.replace("\n", " ") + " You may read more of this in the privacy policy. " + " ".join(f"more{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(12))
    footer = " ".join(quality_rules.PHRASES)
    got = {r["doc_id"]: r["text"] for r in quality_rules.clean(docs(spark, [one, GOOD + "\n" + footer, GOOD + "\nClick here to read more."])).collect()}
    assert got == {0: one, 1: GOOD, 2: GOOD}


def test_quality_odd_rows(spark, odd):
    got = quality_rules.judge(odd)
    assert got.count() == odd.count() and got.where("kept").select("doc_id").distinct().count() == 2
    assert quality_rules.clean(odd).columns == odd.columns
    assert quality_rules.judge(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- URLs


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://WWW.Example.com/en/a?b#c", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?x=/en/", "a.com", "", None, None),
        ("a.com/b", "", "", None, None),
        (None, "", "", None, None),
        ("http://É.com/x", "É.com", "/x", "com/", "allow"),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    r = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert r["verdict"] == (verdict or "allow")


def test_url_models_judge_held_out_urls():
    rng = np.random.default_rng(3)
    make = lambda words, n: ["-".join(rng.choice(words, 3)) + ".org/" + str(rng.integers(1000)) for _ in range(n)]
    good, bad = ["garden", "history", "science", "letters"], ["casino", "pills", "bets", "winner"]
    model = urls.train(make(good, 200), make(bad, 200))
    assert (model.score(make(good, 100)) >= 0).mean() > 0.95 and (model.score(make(bad, 100)) < 0).mean() > 0.95
    data, position, off = urls.bytes_of(["ab", "abc"])
    p = urls.Markov.fit(data, position, 3)
    assert np.all(np.exp(p.log_p(data, position)) <= 1)


def test_url_probabilities_sum_to_one():
    m = urls.Markov.fit(*urls.bytes_of(["banana", "bandana"])[:2], 2)
    data, position = np.zeros(256 * 3, np.uint64), np.tile([0, 1, 2], 256)
    data[0::3], data[1::3], data[2::3] = ord("b"), ord("a"), np.arange(256)
    assert np.exp(m.log_p(data, position))[2::3].sum() == pytest.approx(1)


def test_url_models_judge_the_whole_url(spark):
    good, bad = ["garden", "history", "science", "letters"], ["casino", "pills", "bets", "winner"]
    rows = [f"http://a{i}.com/p?q={good[i % 4]}-{good[i % 3]}" for i in range(120)] + [f"http://b{i}.net/es/p?q={bad[i % 4]}-{bad[i % 3]}" for i in range(120)]
    asked = {"http://site.org/?q=history-garden": "allow", "http://site.org/?q=casino-pills": "block", "site.org/?q=history-garden": "allow", "site.org/?q=casino-pills": "block"}
    got = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate([*rows, *asked, None])], "page_id long, url string"))
    by_url = {r["url"]: r for r in got.where("rule is null").collect()}
    assert {u: by_url[u]["verdict"] for u in asked} == asked
    assert by_url[None]["score"] is not None and by_url[None]["host"] == ""


def test_url_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, host int, score string")).count() == 0


# ---------------------------------------------------------------- word CRF


def test_chain_marginals_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([1, 0, 0, 1, 0, 1, 0], bool)
    p, xi = marginals(emit, first, trans, start, True)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for lo, hi in ((0, 3), (3, 5), (5, 7)):
        total, w, x = 0.0, np.zeros((hi - lo, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=hi - lo):
            s = np.exp(start[path[0]] + sum(emit[lo + i, t] for i, t in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += s
            for i, t in enumerate(path):
                w[i, t] += s
            for a, b in zip(path, path[1:]):
                x[a, b] += s
        want[lo:hi], pairs = w / total, pairs + x / total
    assert np.allclose(p, want) and np.allclose(xi, pairs)
    assert marginals(np.zeros((0, 2)), np.zeros(0, bool), np.zeros((2, 2)), np.zeros(2)).shape == (0, 2)


def test_words_do_not_depend_on_the_batch():
    both = words_of(*flat(pa.array(["Ab cÉ", "x ab"])))
    one = words_of(*flat(pa.array(["x ab"])))
    assert both.hashes[both.kind[2:]].tolist() == one.hashes[one.kind].tolist()
    assert both.hashes[both.kind[0]] == both.hashes[both.kind[3]]


def held_out(spark, sf_dir, name, label):
    docs_, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return queries.QUERIES[name](spark, sf_dir).join(docs_.select("doc_id", "lang").join(labels, "doc_id", "left"), "doc_id").where("held_out").toPandas().dropna(subset=[label])


def test_language_on_the_held_out_fold(spark, sf_dir):
    got = held_out(spark, sf_dir, "op4_language_id", "lang")
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_word_by_word():
    rows = [(b"the house is on the hill and the river is there", "en"), (b"la maison est dans la rue avec une porte", "fr")] * 8
    m = language_id.LanguageModel.train(rows, epochs=8)
    w, p = m.labels(pa.array(["the river is there la maison est dans une rue"]))
    assert [m.langs[i] for i in p.argmax(1)] == ["en"] * 4 + ["fr"] * 6


def test_language_odd_rows(spark, odd):
    got = {(r["doc_id"], r["text"] and r["text"][:5]): r for r in language_id.identify(odd, per_class=5).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["lang_score"] == 0 for k in got if k[0] in (1, 2, 3, 6))
    assert all(got[k]["lang_pred"] in ("en", "fr") for k in got if k[0] in (4, 5, 7, None))
    assert language_id.identify(odd.limit(0)).count() == 0
    assert language_id.keep_identified(odd).columns == odd.columns


def test_toxicity_finds_spans():
    rng = np.random.default_rng(1)
    words = [f"w{i}o" for i in range(50)]
    rows = [(" ".join(rng.choice(words, 30)), 0) for _ in range(60)]
    rows += [(" ".join([*rng.choice(words, 15), rng.choice(["idiot", "moron"]), *rng.choice(words, 15)]), 1) for _ in range(60)]
    m = toxicity.ToxicModel.train(rows, [600, 60])
    score, spans = m.spans(pa.array(["É w1o w2o idiot, w3o", "w1o w2o w3o", "", None]))
    assert spans[0] == [(10, 15)] and not spans[1] and score[0] > 0.5 > score[1] and score[2] == score[3] < 0.5
    one = toxicity.ToxicModel.train([("a", 0)], [5, 0])
    assert 0 < one.score(pa.array(["x"]))[0][0] < 0.5


def test_rare_words_of_explained_documents_are_not_chosen():
    h = lambda *x: np.array(sorted(x), np.uint64)
    seen = [h(1, 7), h(1, 7), h(1, 7), h(1, 8), h(2, 3)]
    assert toxicity.explaining_words(seen, np.array([1.0, 1, 1, 1, 0])).tolist() == [1]


def test_toxicity_on_the_held_out_fold(spark, sf_dir):
    got = held_out(spark, sf_dir, "op3_toxicity", "toxic")
    assert ((got["score"] >= 0.5) == got["predicted"].astype(bool)).all()
    assert (got["predicted"] == got["toxic"]).mean() > 0.85


def test_network_gradient_and_score():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 110, n)) for n in (5, 300, 900, 40)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    net, y, w = byte_cnn.Network(4, 3), np.array([0.0, 1, 1, 0]), np.ones(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at = byte_cnn.encode(data, off)

    def loss():
        p = net.score(data, off)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(x, at, y, w)
    for k in ("out", "into", "bias", "taps"):
        flat_ = net.p[k].reshape(-1)
        i = int(np.abs(g[k]).argmax())
        flat_[i] += 1e-5
        up = loss()
        flat_[i] -= 2e-5
        down = loss()
        flat_[i] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(float(g[k].reshape(-1)[i]), rel=2e-2, abs=1e-5)
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(alone, net.score(data, off))


def test_repeats_are_an_input_plane():
    x, _ = byte_cnn.encode(*flat(pa.array(["ab ab ab", "ab"])))
    assert (x[:8] // 256).tolist() == [0, 0, 0, 1, 1, 0, 2, 2] and x[256] // 256 == 0


def test_quality_network_on_the_held_out_fold(spark):
    got = held_out(spark, "/root/testdata/sf0.01", "op5_quality_cnn", "quality")
    assert (got["predicted"] == got["quality"]).mean() > 0.85
    assert ((got["score"] >= 0.3) == got["predicted"].astype(bool)).all()


def test_models_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    for got, name in ((byte_cnn.score(odd, byte_cnn.learn(odd, labels, epochs=1)), "quality_score"), (toxicity.score(odd, toxicity.learn(odd, labels)), "toxic_score")):
        assert got.count() == odd.count() and got.where(f"{name} is null or {name} < 0 or {name} > 1").count() == 0
    nothing = odd.limit(0)
    assert byte_cnn.score(nothing, byte_cnn.learn(nothing, labels.limit(0))).count() == 0
    assert toxicity.score(nothing, toxicity.learn(nothing, labels.limit(0))).count() == 0
