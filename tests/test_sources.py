import random

import pytest

from seqloom.functions.text import UNIVERSAL_TAGS
from seqloom.sources import text_files as S


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_conll_keeps_the_last_sentence(spark, tmp_path):
    path = put(tmp_path, "a.conll", "1\tThe\tthe\tD\tDT\n2\tdog\tdog\tN\tNN\n\n1\tRuns\trun\tV\tVB")
    got = sorted(tuple(r) for r in S.read_conll(spark, path).collect())
    assert got == [(0, 0, 0, "The", "DT"), (0, 0, 1, "dog", "NN"), (0, 1, 0, "Runs", "VB")]
    assert S.read_conll(spark, path, legacy=True).count() == 2
    assert S.read_conll(spark, f"{path},{path}").select("fold").distinct().count() == 2


def test_blocks_and_alphabet(spark, tmp_path):
    path = put(tmp_path, "b", "a\tb\nX\tY\n0\t1\n\nc\nZ\n0\n\n")
    rows = S.read_blocks(spark, path)
    assert sorted((r["sent_id"], r["pos"], r["token"], r["tag"]) for r in rows.collect()) == [(0, 0, "a", "X"), (0, 1, "b", "Y"), (1, 0, "c", "Z")]
    assert sorted(r["tag"] for r in S.tag_alphabet(rows).collect()) == ["X", "Y", "Z"]


def test_tag_map_takes_the_later_row(spark, tmp_path):
    path = put(tmp_path, "u", "NN\tNOUN\nNN\tVERB\nJJ\tBAD\n")
    assert [tuple(r) for r in S.read_tag_map(spark, path, UNIVERSAL_TAGS).collect()] == [("NN", "VERB")]


def test_letters(spark, tmp_path):
    path = put(tmp_path, "l", "1\tb\t2\t1\t0\t9\t0\t1\n2\ta\t-1\t1\t1\t9\t1\t0\n")
    g = S.read_letters(spark, path)
    assert {(r["node_id"], r["letter"], r["next_id"], r["fold"]) for r in g.collect()} == {(0, 1, 1, 1), (1, 0, -2, 1)}
    r = S.letter_sequences(g).first()
    assert (r["tags"], r["nodes"], r["pixels"]) == ([1, 0], [0, 1], [[0, 1], [1, 0]])


def test_graph_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 0.5), (1, 0, -1.0)], "src long, dst long, weight double")
    S.write_graph(e, str(tmp_path / "g"))
    assert [tuple(r) for r in S.read_graph(spark, str(tmp_path / "g")).collect()] == [(0, 1, 0.5)]
    bad = put(tmp_path, "bad", "1\t2\n1\t2\t0.25\nx\ty\tz\n")
    assert [tuple(r) for r in S.read_graph(spark, bad).collect()] == [(0, 1, 0.25)]


def test_index_predictions_suffixes(spark, tmp_path):
    S.write_ngram_index(spark.createDataFrame([(0, "a b c"), (1, "b c d")], "node long, ngram string"), str(tmp_path / "i"))
    assert sorted(tuple(r) for r in S.read_ngram_index(spark, str(tmp_path / "i")).collect()) == [(0, "a b c"), (1, "b c d")]
    S.write_predictions(spark.createDataFrame([(7, [2, 0])], "seq_id long, pred array<int>"), str(tmp_path / "p"))
    assert sorted(tuple(r) for r in S.read_predictions(spark, str(tmp_path / "p")).collect()) == [(7, 0, 2), (7, 1, 0)]
    path = put(tmp_path, "s", "English\t-ing\nenglish\tly\nfrench\tment\nenglish\ta\tb\n")
    assert sorted(r["suffix"] for r in S.read_suffixes(spark, path, "ENGLISH").collect()) == ["ing", "ly"]
    dump = put(tmp_path, "d", "English\t-ed\tSuffix\nEnglish\tdog\tNoun\nFrench\t-er\tSuffix\n")
    assert [r["suffix"] for r in S.read_dictionary_dump(spark, dump, "english").collect()] == ["ed"]


def test_stream_of_ngrams(spark, tmp_path):
    from seqloom.streaming import ngram_counts

    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"])], "seq_id long, tokens array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ngram_counts.start(ngram_counts.counts(stream), "grams", str(tmp_path / "c"), once=True).awaitTermination(120)
    assert {tuple(r) for r in spark.table("grams").collect()} == {("<s0> a b", 2), ("a b </s0>", 2)}


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "7"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    text = [f"line {i}" + " x" * (i % 9) for i in range(300)]
    text[17] = text[299] = ""
    path = put(tmp_path, "a", "\r\n".join(text) + "\r\n")
    rows = S.lines(spark, f"{path},{path}")
    assert rows.rdd.getNumPartitions() > 10
    got = {(r["fold"], r["line_no"]): r["line"] for r in rows.collect()}
    assert got == {(f, i): x for f in (0, 1) for i, x in enumerate(text)}
    (tmp_path / "latin").write_bytes("é\nü".encode("latin-1"))
    assert [r["line"] for r in S.lines(spark, str(tmp_path / "latin"), "ISO-8859-1").orderBy("line_no").collect()] == ["é", "ü"]
    (tmp_path / "wide").write_bytes("é\nü\n".encode("utf-16"))
    assert [r["line"] for r in S.lines(spark, str(tmp_path / "wide"), "UTF-16").orderBy("line_no").collect()] == ["é", "ü"]
    assert S.lines(spark, put(tmp_path, "none", "")).count() == 0


@pytest.mark.parametrize("stretch", [1, 3, 1 << 20])
def test_sentences_across_splits_and_stretches(spark, tmp_path, small_splits, monkeypatch, stretch):
    rng, lines, want, now = random.Random(stretch), [], [], []
    for i in range(200):
        if rng.random() < 0.3:
            lines.append("")
            want += [now] if now else []
            now = []
        else:
            lines.append(f"{i}\tw{i}\t_\t_\tT{i % 3}")
            now.append((f"w{i}", f"T{i % 3}"))
    path = put(tmp_path, "a", "\n".join(lines))
    monkeypatch.setattr(S.numbered, "__defaults__", (stretch,))
    for legacy in (False, True):
        got = {}
        for r in S.read_conll(spark, path, legacy=legacy).orderBy("sent_id", "pos").collect():
            got.setdefault(r["sent_id"], []).append((r["token"], r["tag"]))
        whole = want if legacy or not now else [*want, now]
        assert [got[i] for i in range(len(got))] == whole


def test_letters_stop_at_a_long_sequence(spark, tmp_path):
    words, lines, node = ["ab", "abc", "a", "abcd", "ab"], [], 1
    for w, word in enumerate(words):
        for i, ch in enumerate(word):
            lines.append("\t".join(map(str, [node, ch, -1 if i + 1 == len(word) else node + 1, w + 1, i, 3, 1])))
            node += 1
    lines.append("\t".join(map(str, [node, "z", node + 1, 9, 0, 3, 1])))  # never ends
    g = S.read_letters(spark, put(tmp_path, "l", "\n".join(lines)))
    count = lambda most: S.letters_until(g, most).groupBy("seq_id").count().count()
    assert [count(m) for m in (1, 3, 4, 99)] == [1, 2, 4, 5]
    assert S.letters_until(g, 4).columns == g.columns


def test_small_tables_are_dealt(spark, tmp_path):
    from seqloom.session import DEALT_PART, dealt

    rows = spark.range(60_000).selectExpr("id", "sha2(cast(id as string), 512) t")
    one, many, tiny = (str(tmp_path / n) for n in ("one", "many", "tiny"))
    rows.coalesce(1).write.parquet(one)
    cores = spark.sparkContext.defaultParallelism
    rows.repartition(cores).write.parquet(many)
    rows.limit(DEALT_PART // 1024).coalesce(1).write.parquet(tiny)
    table = spark.read.parquet(one)
    got = dealt(table)
    assert got.rdd.getNumPartitions() == cores and max(got.rdd.glom().map(len).collect()) < 60_000
    assert got.exceptAll(table).isEmpty() and table.exceptAll(got).isEmpty()
    for path in (many, tiny):
        assert "Exchange" not in dealt(spark.read.parquet(path))._jdf.queryExecution().toString()
