import random

from seqloom.config import Config
from seqloom.plans import jobs


def corpus(path, seed):
    rng, lines = random.Random(seed), []
    for _ in range(30):
        for i in range(rng.randint(2, 4)):
            lines += [f"{i}\t{rng.choice(['the', 'a'])}\t_\tD\tDT", f"{i}\t{rng.choice(['dog', 'cat', 'barking'])}\t_\tN\tNN", f"{i}\t{rng.choice(['runs', 'sits'])}\t_\tV\tVB"]
        lines.append("")
    path.write_text("\n".join(lines))
    return str(path)


def test_graph_then_tagger(spark, tmp_path):
    (tmp_path / "umap").write_text("DT\tDET\nNN\tNOUN\n")
    (tmp_path / "suffix").write_text("english\t-ing\n")
    c = Config(data_path=corpus(tmp_path / "a", 1), graph_path=str(tmp_path / "g"), ngram_path=str(tmp_path / "n"), umap_path=str(tmp_path / "umap"), suffix_path=str(tmp_path / "suffix"), neighbors=5, labels=10, folds=2, order=1, em_iterations=2, e_iterations=1, m_iterations=6, scale_features=True)
    edges, index = jobs.build_graph(spark, c)
    assert edges.count() > 0 and index.count() > 10
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    assert all((b, a) in pairs for a, b in pairs)
    _, metrics = jobs.train_tagger(spark, c)
    rows = metrics.orderBy("iter").collect()
    assert len(rows) == 2 and rows[-1]["test_acc"] > 0.9


def test_letters(spark, tmp_path):
    rng, lines, node = random.Random(2), [], 1
    for word in range(20):
        for i, ch in enumerate(rng.choice(["ab", "ba", "cab"])):
            pixels = [int(ch == x or rng.random() < 0.1) for x in "abc"]
            lines.append("\t".join(map(str, [node, ch, -1, word + 1, i, word % 10, *pixels])))
            node += 1
    (tmp_path / "l").write_text("\n".join(lines) + "\n")
    (tmp_path / "g").write_text("1\t2\t0.5\n2\t1\t0.5\n")
    _, metrics = jobs.train_letters(spark, Config(data_path=str(tmp_path / "l"), graph_path=str(tmp_path / "g"), labels=8, folds=1, order=2, m_iterations=6))
    assert metrics.first()["test_acc"] > 0.7


def test_tagger_rows_prune_draw_and_take_an_extractor(spark, tmp_path):
    from pyspark.sql import functions as F

    from seqloom.operators import sampling

    lines = []
    for i in range(12):
        lines += [f"1\tword{i}\t_\tN\tNOUN", "2\t.\t_\tP\t.", ""]
    (tmp_path / "c").write_text("\n".join(lines))
    c = Config(data_path=str(tmp_path / "c"), labels=3, folds=2, fold=1)
    corpus = jobs.read_corpus(spark, c)
    rows, tags, n = jobs.tagger_rows(spark, c, corpus)
    got = {r["seq_id"]: r for r in rows.collect()}
    assert tags == [".", "NOUN"] and len(got) == 12
    assert all(r["allowed"] == [None, [0]] and r["tags"] == [1, 0] for r in got.values())
    assert {i for i, r in got.items() if r["is_labeled"]} == set(sampling.draw(list(range(12)), 6)[3:])
    free, _, _ = jobs.tagger_rows(spark, Config(data_path=c.data_path, labels=3, folds=2, prune=False), corpus)
    assert free.where(F.exists("allowed", lambda x: x.isNotNull())).count() == 0
    first = lambda kinds: kinds.select("token", F.left("token", F.lit(1)).alias("name"))
    own, _, n = jobs.tagger_rows(spark, c, corpus, first)
    assert n == 2 and {tuple(map(tuple, r["obs"])) for r in own.collect()} == {((1,), (0,))}
