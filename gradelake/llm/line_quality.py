"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import cut

SPACE = " \t\n\x0b\f\r"
#: A table of frequent lines of so many rows (16 bytes each) is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")


def n_repeat_words(words: str, size: str) -> tuple[Column, Column, Column]:
    """Three steps (to be selected one after the other): bits of a place; sorted keys of all 3-word windows, hash above place; words covered by windows found again.

    A key keeps 64 - bits of the hash, so that two different windows of one text of n words share it with a chance of about n^2 / 2^(65 - bits).
    """
    bits = F.length(F.bin(F.col(size)))
    keys = F.expr(f"case when {size} < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, {size} - 3), i -> shiftleft(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)), __bits) | cast(i as bigint))) end")
    again = """
        aggregate(
            sort_array(transform(
                filter(__keys, (x, j) -> (j > 0 and shiftrightunsigned(get(__keys, j - 1), __bits) = shiftrightunsigned(x, __bits))
                                      or (j < size(__keys) - 1 and shiftrightunsigned(get(__keys, j + 1), __bits) = shiftrightunsigned(x, __bits))),
                x -> x & (shiftleft(1L, __bits) - 1))),
            named_struct('last', -3L, 'n', 0L),
            (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)),
            a -> a.n)
    """
    return bits, keys, F.expr(again)


def judge(
    docs: DataFrame, least_docs: int = 10, share: float = 0.02, depleted: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and n_frequent_words (words in removed lines).

    Lines are normalised (lower case, white space as one space, trimmed) and hashed with their host. A line that is in more than max(least_docs, share of the host's
    documents) documents of its host is removed everywhere in that host; a document of which more than the `depleted` share of words goes is rejected, and so is one
    that fails the base rules (n_words < 50 or 100 * n_repeat_words > 50 * n_words). Each row is a document: copies of one text count as many, a line twice in one of them once.
    A null text is empty (0 words: fails); a null host is a host of its own. Repeated rows and null ids are judged like others. An empty table gives no rows. Further
    columns, whatever their names, are not looked at. Lines are counted with partial aggregation; a line in any share of the documents is one counter a task. Very long texts are read
    whole, as one row; equal counts need no order.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("-"))
    rows = docs.select(F.col(id_col), text.alias("__t"), F.xxhash64(host).alias("__h"), F.xxhash64(host, text).alias("__k1"), F.xxhash64(F.lit(1), host, text).alias("__k2"))

    lines = F.split(F.lower(F.regexp_replace("__t", "[ \\x09\\x0B-\\x0D]+", " ")), "\n")
    numbered = rows.select("__h", "__k1", "__k2", F.posexplode(lines).alias("pos", "raw")).select("__h", "__k1", "__k2", "pos", F.trim("raw").alias("line")).where("line <> ''")
    numbered = numbered.select("__h", "__k1", "__k2", "pos", F.xxhash64("__h", "line").alias("l"), F.size(F.split("line", " ")).alias("words"))
    docs_of = rows.groupBy(F.col("__h").alias("g")).agg(F.count(F.lit(1)).alias("docs"))
    kinds = F.array_distinct(F.transform(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64("__h", x)))
    counted = rows.select("__h", F.explode(kinds).alias("l")).groupBy("__h", "l").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs)
    frequent = cut(counted.join(docs_of, F.col("__h") == F.col("g")).where(F.col("n") > share * F.col("docs")).select(F.col("l").alias("f")), "frequent-lines")
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    gone = numbered.join(frequent, F.col("l") == F.col("f"), "left_semi").groupBy("__k1", "__k2", "pos").agg(F.max("words").alias("words"))
    gone = cut(gone.groupBy("__k1", "__k2").agg(F.sum("words").alias("n_frequent_words")).withColumnsRenamed({"__k1": "g1", "__k2": "g2"}), "frequent-words")

    bits, keys, again = n_repeat_words("__w", "n_words")
    raw = F.filter(F.split("__t", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    base = (
        rows.select("*", word_array(F.col("__t")).alias("__w"))
        .select("*", F.size("__w").cast("long").alias("n_words"), raw.alias("__lines"))
        .select(
            id_col, "__k1", "__k2", "__w", "n_words", F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
            (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), bits.alias("__bits"),
        )
        .withColumn("__keys", keys)
        .select(id_col, "__k1", "__k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", again.alias("n_repeat_words"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = base.join(gone, (F.col("__k1") == F.col("g1")) & (F.col("__k2") == F.col("g2")), "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_frequent_words") <= depleted * F.col("n_words"))).alias("kept"), "n_frequent_words",
    )


#: The same in DuckDB's SQL, over the table documents.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') t, coalesce('=' || source, '-') h from documents),
lines as (select h, t, pos, line, length(line) - length(replace(line, ' ', '')) + 1 words from (
    select h, t, generate_subscripts(l, 1) pos, trim(unnest(l), ' ') line from (select distinct h, t, string_split(lower(regexp_replace(t, '[ \t\x0B-\x0D]+', ' ', 'g')), chr(10)) l from d)) where line <> ''),
texts as (select h, t, count(*) m from d group by h, t),
hosts as (select h, count(*) n from d group by h),
frequent as (select h, line from (select h, line, sum(m) k from (select distinct h, t, line from lines) join texts using (h, t) group by h, line) join hosts using (h) where k > 10 and k > 0.02 * n),
gone as (select h, t, sum(words) n from lines semi join frequent using (h, line) group by h, t),
words as (select t, list_filter(regexp_split_to_array(t, '[ \t-\x0D]+'), lambda x: x <> '') w from (select distinct t from d)),
win as (select t, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select t, w, unnest(range(1, len(w) - 1)) i from words)),
hit as (select t, i from (select t, i, count(*) over (partition by t, g) n from win) where n > 1),
rep as (select t, count(distinct i + k) n from hit, (select unnest(range(3)) k) group by t),
base as (select doc_id, h, t, len(w) n_words, length(regexp_replace(t, '[ \t-\x0D]+', '', 'g')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    (select len(x) - len(list_distinct(x)) from (select list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\x0D]')) x)) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
    from d join words using (t) left join rep using (t))
select doc_id, cast(n_words as bigint) n_words, word_chars, n_symbols, cast(n_dup_lines as bigint) n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(gone.n, 0) <= 0.5 * n_words kept, cast(coalesce(gone.n, 0) as bigint) n_frequent_words
from base left join gone using (h, t)
"""
