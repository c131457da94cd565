"""Line-first cleaning in SQL functions only: no Python, no shuffle, one pass over the text.

Every line is judged by itself: shouting punctuation, symbols, navigation bars, boilerplate phrases,
lines that say the same word over and over.  A boilerplate phrase fails a short line, or one that
phrases make up half of; a long line that mentions one is text.  Failing lines are removed, and a document is rejected
when it loses too much of its text, or fails the base rules on words and repeated windows.

Null and empty texts have no words and fail; an empty table gives none.  Repeated rows and rows without an id are
judged row by row; a share that is exactly a rule's bound passes.  A long text is held as its words and its lines,
about ten times its size, for one row at a time.  All columns pass through ``clean``, whatever their names; ``judge``
adds its own, which replace columns of the same names (_text, _words and _lines too).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: fixed phrases of boilerplate lines, lower case
PHRASES = ("cookie policy", "accept all cookies", "enable javascript", "terms of use", "terms of service", "privacy policy", "all rights reserved", "click here", "sign up for our", "subscribe to our", "lorem ipsum", "skip to content", "back to top", "share this", "read more")
#: words that stand alone between the entries of a navigation bar
BARS = ("|", ">", "/", "»", "·", "-")


@dataclass(frozen=True)
class Rules:
    """Percentages are of the line's words, or of its characters in words."""

    marks: int = 30  # words ending in two marks of !?
    symbols: int = 10  # characters of SYMBOLS
    bars: int = 20  # words of BARS
    again: int = 40  # words equal to the one before
    phrase_words: int = 20  # a longer line fails only if phrases are phrase_share of its characters
    phrase_share: int = 50
    lost: int = 50  # of a document's characters in words, in removed lines
    least_words: int = 50
    repeats: int = 50


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value, which is computed once a row and not at each mention."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: only blanks of ASCII part words; translate beats a regular expression here
_BLANKS = "translate({}, '\\t\\n\\u000b\\u000c\\r', '     ')"


def words_of(text: str) -> str:
    return f"filter(split({_BLANKS.format(text)}, ' +'), w -> w <> '')"


def line_fails(line: str, rules: Rules) -> str:
    """Whether a line with a word fails; each value that a lambda needs is bound outside it."""
    bars = ", ".join(map(_sql, BARS))
    phrases = " or ".join(f"contains(low, {_sql(p)})" for p in PHRASES)
    marks = "size(filter(w, x -> endswith(x, '!!') or endswith(x, '??') or endswith(x, '!?')))"
    again = "size(filter(w, (x, i) -> i > 0 and x = w[i - 1]))"
    by_char = bound("array_join(w, '')", "c", f"100 * (length(c) - length(translate(c, {_sql(SYMBOLS)}, ''))) > {rules.symbols} * length(c)")
    by_word = f"100 * {marks} > {rules.marks} * size(w) or 100 * size(filter(w, x -> x in ({bars}))) > {rules.bars} * size(w) or (size(w) >= 4 and 100 * {again} > {rules.again} * size(w))"
    # a long line is rare among those with a phrase, so its share is only then computed
    mostly = f"size(w) <= {rules.phrase_words} or 100 * (length(low) - length(regexp_replace(low, {_sql('|'.join(PHRASES))}, ''))) >= {rules.phrase_share} * length(low)"
    by_phrase = bound(f"lower({line})", "low", f"({phrases}) and ({mostly})")
    return f"({bound(words_of(line), 'w', f'{by_word} or {by_char} or {by_phrase}')})"


#: words inside 3-word windows that occur twice or more: windows sorted, equal neighbours found, their spans united
_REPEATED = bound(
    "sort_array(transform(sequence(0, size(v) - 3), i -> struct(concat_ws(' ', v[i], v[i + 1], v[i + 2]) as g, i as i)))",
    "s",
    "aggregate(array_sort(transform(filter(s, (x, j) -> (j > 0 and x.g = s[greatest(j - 1, 0)].g) or (j < size(s) - 1 and x.g = s[least(j + 1, size(s) - 1)].g)), x -> x.i)), named_struct('last', -3, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)), a -> a.n)",
)


def judge(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the cleaned text."""
    blank = "rlike '[^ \\\\t-\\\\r]'"
    chars = "length(translate(j.line, ' \\t\\n\\u000b\\u000c\\r', ''))"
    # one value for the words and one for the lines; extracting their fields costs nothing
    words = bound(words_of("_text"), "v", f"struct(cast(size(v) as long) as n, cast(length(array_join(v, '')) as long) as chars, if(size(v) < 3, 0L, {_REPEATED}) as again)")
    judged = f"transform(split(_text, '\\n'), l -> named_struct('line', l, 'word', l {blank}, 'fails', l {blank} and ({line_fails('l', rules)})))"
    lines = bound(judged, "a", f"struct({bound('transform(filter(a, j -> j.word), j -> j.line)', 'u', 'cast(size(u) - size(array_distinct(u)) as long)')} as dups, cast(aggregate(filter(a, j -> j.fails), 0, (n, j) -> n + {chars}) as long) as lost, array_join(transform(filter(a, j -> not j.fails), j -> j.line), '\\n') as text)")
    out = documents.withColumn("_text", F.expr("coalesce(text, '')")).withColumns({"_words": F.expr(words), "_lines": F.expr(lines)})
    out = out.withColumns(
        {
            "n_words": F.col("_words.n"),
            "word_chars": F.col("_words.chars"),
            "n_symbols": F.expr(f"cast(length(_text) - length(translate(_text, {_sql(SYMBOLS)}, '')) as long)"),
            "n_dup_lines": F.col("_lines.dups"),
            "n_repeat_words": F.col("_words.again"),
            "lost_chars": F.col("_lines.lost"),
            "clean_text": F.col("_lines.text"),
        }
    )
    out = out.withColumn("base_failed", F.expr(f"n_words < {rules.least_words} or 100 * n_repeat_words > {rules.repeats} * n_words"))
    return out.withColumn("kept", F.expr(f"not base_failed and 100 * lost_chars <= {rules.lost} * word_chars")).drop("_text", "_words", "_lines")


def clean(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, without their failing lines."""
    names = documents.columns
    # the row's own columns travel in one, so that no name meets another
    rest = F.struct(*([c for c in names if c not in ("text", "n_chars")] or [F.lit(0).alias("_")])).alias("row")
    # a generator, for a filter would be pushed below and judge twice
    out = judge(documents.select(rest, "text"), rules).withColumn("text", F.explode(F.expr("if(kept, array(clean_text), array())")))
    chars = documents.schema["n_chars"].dataType if "n_chars" in names else None
    own = {"text": F.col("text"), "n_chars": F.length("text").cast(chars or "long")}
    return out.select(*[own[c].alias(c) if c in own else F.col("row").getField(c).alias(c) for c in names])


def oracle(rules: Rules = Rules()) -> str:
    """The registered query in DuckDB."""
    q = lambda text: "'" + text.replace("'", "''") + "'"
    blank = r"'[ \t\n\x0B\f\r]+'"
    words = f"list_filter(string_split_regex({{}}, {blank}), lambda x: x <> '')"
    count = lambda test: f"len(list_filter(w, lambda x: {test}))"
    phrases = " or ".join(f"contains(lower(line), {q(p)})" for p in PHRASES)
    symbols = f"length(regexp_replace({{}}, '[^{SYMBOLS}]', '', 'g'))"
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, {words.format("coalesce(text, '')")} ws from documents),
lines as (select r, unnest(string_split(t, chr(10))) line from d),
split as (select r, line, {words.format('line')} w from lines),
judged as (select r, line, list_aggregate(list_transform(w, lambda x: length(x)), 'sum') chars,
   100 * {count("ends_with(x, '!!') or ends_with(x, '??') or ends_with(x, '!?')")} > {rules.marks} * len(w)
   or 100 * {count(f"x in ({', '.join(map(q, BARS))})")} > {rules.bars} * len(w)
   or (len(w) >= 4 and 100 * len(list_filter(list_zip(w[2:], w[:-2]), lambda z: z[1] = z[2])) > {rules.again} * len(w))
   or 100 * {symbols.format('line')} > {rules.symbols} * list_aggregate(list_transform(w, lambda x: length(x)), 'sum')
   or {phrases} fails from split where len(w) > 0),
by_line as (select r, count(*) - count(distinct line) dups, coalesce(sum(chars) filter (where fails), 0) lost from judged group by r),
windows as (select r, unnest(range(1, len(ws) - 1)) i, ws from d where len(ws) >= 3),
grams as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from windows),
often as (select r, i from (select r, i, count(*) over (partition by r, g) n from grams) where n > 1),
spans as (select r, least(3, i - coalesce(lag(i) over (partition by r order by i), i - 3)) n from often),
again as (select r, sum(n) n from spans group by r),
base as (select d.doc_id, len(ws)::bigint n_words, coalesce(list_aggregate(list_transform(ws, lambda x: length(x)), 'sum'), 0)::bigint word_chars,
   {symbols.format('t')}::bigint n_symbols, coalesce(dups, 0)::bigint n_dup_lines, coalesce(again.n, 0)::bigint n_repeat_words, coalesce(lost, 0) lost
   from d left join by_line using (r) left join again using (r)),
failed as (select *, n_words < {rules.least_words} or 100 * n_repeat_words > {rules.repeats} * n_words base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost <= {rules.lost} * word_chars kept from failed"""
