"""Feature strings of sequence models: transitions, emissions, pixels, counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains, is_capitalised, is_numerical, is_punctuation, suffix_of

START, START2, END = "<t0>", "<t00>", "</t0>"


def transitions(tokens: DataFrame) -> DataFrame:
    """(seq_id, pos, s, sp, spp) of tag rows, with a last row per sequence for the end state."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    end = tokens.groupBy("seq_id").agg((F.max("pos") + 1).alias("pos")).select("seq_id", "pos", F.lit(END).alias("tag"))
    rows = tokens.select("seq_id", "pos", "tag").unionByName(end)
    sp = F.coalesce(F.lag("tag", 1).over(w), F.lit(START))
    spp = F.when(F.col("pos") == 0, START2).when(F.col("pos") == 1, START).otherwise(F.lag("tag", 2).over(w))
    return rows.select("seq_id", "pos", F.col("tag").alias("s"), sp.alias("sp"), spp.alias("spp"))


def transition_features(s: Column, sp: Column, spp: Column | None = None, join: str = " ") -> Column:
    """Feature strings of one context: three of a first-order model, seven of a second-order one."""
    pair = lambda name, *tags: F.concat(F.lit(f"{name}="), *[x for t in tags for x in (F.lit(join), t)][1:])
    out = [pair("S-1", sp), pair("S-0", s), pair("S-10", sp, s)]
    if spp is not None:
        out = [pair("S-2", spp), *out, pair("S-20", spp, s), pair("S-1-2", spp, sp), pair("S-1-20", spp, sp, s)]
    return F.array(*out)


def contexts(tags: list[str], order: int) -> list[tuple[str, ...]]:
    """Every (s, sp[, spp]) that a chain can meet; the tag alphabet is small and known."""
    if order == 1:
        return [(END, t) for t in tags] + [(t, START) for t in tags] + [(a, b) for a in tags for b in tags]
    return [(t, START, START2) for t in tags] + [(END, t, START) for t in tags] + [(a, b, START) for a in tags for b in tags] + [(END, a, b) for a in tags for b in tags] + [(a, b, c) for a in tags for b in tags for c in tags]


def emission_templates(token: Column, second_order: bool = True, language: str = "english") -> Column:
    """Observation features of a token, without offset and tag: (template, value); absent ones are left out."""
    one = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("template"), value.alias("value")))
    none = F.lit("")
    parts = ([one("Tk", token)] if second_order else []) + [
        one("LTk", F.lower(token)),
        one("Cap", none, is_capitalised(token)),
        one("Dig", none, is_numerical(token)),
        one("Pun", none, is_punctuation(token, language)),
        one("has=-", none, contains(token, "-")),
        one("has=.", none, contains(token, ".")),
        *[one("Suf", suffix_of(token, n), F.length(token) > n) for n in (2, 3, 4)],
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def emission_string(offset: Column, template: Column, value: Column, tag: Column, second_order: bool = True) -> Column:
    """The feature's name: words join their tag by a blank, other templates by a bar (first order: some by =)."""
    bar = F.concat(F.when(template == "Suf", F.concat(template, F.lit("="), value)).otherwise(template), F.lit(" | "), tag)
    plain = F.concat(template, F.lit("="), value, F.lit(" "), tag)
    name = F.when(template.isin("Tk", "LTk"), plain).otherwise(bar)
    if not second_order:
        name = F.when(template.isin("Cap", "Dig", "Pun"), F.concat(template, F.lit("="), tag)).otherwise(name)
    return F.concat(F.lit("P"), offset.cast("string"), name)


def pixel_features(glyphs: DataFrame, tags: list[str]) -> DataFrame:
    """(node, feature) for every lit pixel, tag and offset of ``glyphs(node, pixels)``."""
    lit = glyphs.select("node", F.posexplode("pixels").alias("i", "v")).where("v > 0")
    names = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(t).alias("t")) for o in range(3) for t in tags])).alias("x")
    return lit.select("node", "i", names).select("node", F.concat(F.lit("P"), F.col("x.o").cast("string"), F.lit("="), F.col("x.t"), F.col("i").cast("string")).alias("feature"))


def token_emissions(tokens: DataFrame, second_order: bool = False) -> DataFrame:
    """(seq_id, pos, tag, feature) of gold tags: each position with its previous, own and next token, and the end with the last."""
    near = tokens.select("seq_id", "pos", "tag", "token")
    w = Window.partitionBy("seq_id").orderBy("pos")
    near = near.withColumns({"nt": F.coalesce(F.lead("tag").over(w), F.lit(END)), "pt": F.lag("tag").over(w)})
    seen = F.filter(F.array(F.struct(F.lit(0).alias("o"), (F.col("pos") + 1).alias("at"), F.col("nt").alias("tag")), F.struct(F.lit(1).alias("o"), F.col("pos").alias("at"), F.col("tag")), F.when(F.col("pt").isNotNull(), F.struct(F.lit(2).alias("o"), (F.col("pos") - 1).alias("at"), F.col("pt").alias("tag")))), lambda x: x.isNotNull())
    rows = near.select("seq_id", "token", F.explode(seen).alias("x")).select("seq_id", "token", "x.*")
    rows = rows.select("seq_id", "o", "at", "tag", F.explode(emission_templates(F.col("token"), second_order)).alias("f"))
    return rows.select("seq_id", F.col("at").alias("pos"), "tag", emission_string(F.col("o"), F.col("f.template"), F.col("f.value"), F.col("tag"), second_order).alias("feature"))


def empirical_counts(tokens: DataFrame, order: int = 1) -> DataFrame:
    """(feature, n) over gold sequences; emissions and transitions are counted in one pass each."""
    t = transitions(tokens)
    spp = F.col("spp") if order == 2 else None
    edges = t.select(F.explode(transition_features(F.col("s"), F.col("sp"), spp)).alias("feature"))
    return edges.unionByName(token_emissions(tokens, order == 2).select("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def scaling(tokens: DataFrame, order: int = 2) -> DataFrame:
    """One row: emission_mass, transition_mass, scaling.

    """
    n = F.size(emission_templates(F.col("token"), order == 2))
    # a token is seen as previous by its successor or the end, as itself, and as next by its predecessor
    w = Window.partitionBy("seq_id").orderBy("pos")
    seen = tokens.withColumn("times", F.lit(2) + F.lag("pos").over(w).isNotNull().cast("int"))
    mass = seen.agg(F.sum(n * F.col("times")).alias("emission_mass"))
    per = 7 if order == 2 else 3
    steps = tokens.agg((F.count("*") + F.count_distinct("seq_id")).alias("c"))
    return mass.join(F.broadcast(steps)).select("emission_mass", (F.col("c") * per).alias("transition_mass"), (F.col("emission_mass") / (F.col("c") * per)).alias("scaling"))


def node_scores(tokens: DataFrame, tags: list[str], weight, second_order: bool = False) -> DataFrame:
    """(seq_id, pos, state, score): theta f over the previous, own and next token; the end state sees the last token.

    ``weight`` maps a feature column to its parameter.  Scores are made once a distinct token, then looked up.
    """
    kinds = tokens.select("token").distinct()
    states = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(t).alias("state")) for o in range(3) for t in [*tags, END] if t != END or o == 0])).alias("x")
    rows = kinds.select("token", F.explode(emission_templates(F.col("token"), second_order)).alias("f"), ).select("token", "f", states)
    name = emission_string(F.col("x.o"), F.col("f.template"), F.col("f.value"), F.col("x.state"), second_order)
    table = rows.groupBy("token", F.col("x.o").alias("o"), F.col("x.state").alias("state")).agg(F.sum(weight(name)).alias("w"))
    w = Window.partitionBy("seq_id").orderBy("pos")
    placed = tokens.select("seq_id", "pos", "token", F.lead("token").over(w).isNull().alias("last"))
    at = F.filter(F.array(F.struct(F.lit(0).alias("o"), (F.col("pos") + 1).alias("at")), F.struct(F.lit(1).alias("o"), F.col("pos").alias("at")), F.struct(F.lit(2).alias("o"), (F.col("pos") - 1).alias("at"))), lambda x: x["at"] >= 0)
    seen = placed.select("seq_id", "token", "last", "pos", F.explode(at).alias("y"))
    joined = seen.join(table, (seen["token"] == table["token"]) & (F.col("y.o") == table["o"]))
    # the end state stands behind the last token only, where no tag stands
    right = F.when((F.col("y.o") == 0) & F.col("last"), F.col("state") == END).otherwise(F.col("state") != END)
    return joined.where(right).groupBy("seq_id", F.col("y.at").alias("pos"), "state").agg(F.sum("w").alias("score"))
