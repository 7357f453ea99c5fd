"""Quality rules by distribution divergence, in DataFrame functions only.

A text's histogram of character classes and of its language's common words is held
against the mean histogram of the documents of that language, by Jensen-Shannon
divergence. Short texts are guarded: the divergence that sampling alone explains,
(k - 1) / (8 n ln 2) bits for k cells and n draws, is taken off first, and the word test
needs a minimum number of words.

Defined cases: a null text is an empty one (no words, so base_failed). A language that is
null or has no list of common words is compared by character classes only. With no document
that passes the base rules there is no reference, and the base rules decide alone.
Repeated rows are judged alike; a divergence that ties with its limit is kept. A very long text is
read whole, its repeated windows found exactly. An empty table gives no rows. Other columns may have
any names: judge() ignores them, keep() returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, spread, whole, words

#: Frequent function words of four languages.
COMMON = {
    "en": "the of and to a in is that for it was on with as be at by this are from".split(),
    "de": "der die und in den von zu sich das mit auf des für ist im nicht dem ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur au pas par avec".split(),
    "es": "de la que el en y los se del las un por con no una su para al es lo".split(),
}
#: The symbols that the base rules count, and marks of ordinary prose.
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-"

MIN_WORDS = 50
REPEAT_PERCENT = 50
CHAR_LIMIT = 0.09
WORD_LIMIT = 0.08
WORD_GUARD = 100
BROADCAST_LANGUAGES = 10_000
CHAR_CELLS = ("lower", "upper", "digit", "space", "mark", "symbol", "other")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: _doc (all its columns), base counts, character-class counts, common-word counts.

    A 3-word window is held as the high bits of its 64-bit hash with its position in the low
    ones, so one primitive sort brings equal windows together; those that meet are then compared word
    by word, as different windows of a long text may share these bits.
    """
    lang = F.col(lang_col)
    lists = F.lit(None).cast("array<string>")
    for name, common in COMMON.items():
        lists = F.when(lang == name, F.array(*map(F.lit, common))).otherwise(lists)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = spread(docs).select(whole(docs).alias("_doc"), F.col(id_col).alias("doc_id"), lang.alias("lang"), text.alias("_t"), words(F.col(text_col)).alias("_w"), lists.alias("_c"))
    base = base.select(
        "*",
        F.size("_w").alias("_n"),
        F.array_join("_w", "").alias("_joined"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_lines"),
        F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" ")).alias("_spaced"),
    )
    base = base.select(
        "*",
        F.expr("(1L << cast(ceil(log2(_n + 1.0D)) as int)) - 1L").alias("_mask"),
        F.length("_joined").cast("long").alias("word_chars"),
        F.regexp_replace("_joined", r"\p{Ll}+", "").alias("_rest"),
        F.lower("_spaced").alias("_low"),
    )
    base = base.select(
        "*",
        F.expr("case when _n >= 3 then sort_array(transform(sequence(0, _n - 3), i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & ~_mask) | i)) else cast(array() as array<bigint>) end").alias("_s"),
        F.regexp_replace("_rest", r"\p{Lu}+", "").alias("_rest2"),
    )
    base = base.select(
        "*",
        F.expr("sort_array(transform(filter(_s, (x, j) -> coalesce((x ^ get(_s, j - 1)) between 0 and _mask, false) or coalesce((x ^ get(_s, j + 1)) between 0 and _mask, false)), x -> struct(_w[cast(x & _mask as int)] as a, _w[cast(x & _mask as int) + 1] as b, _w[cast(x & _mask as int) + 2] as c, x & _mask as i)))").alias("_m"),
        F.regexp_replace("_rest2", r"\p{Nd}+", "").alias("_rest3"),
        F.length(F.translate("_rest2", SYMBOLS, "")).alias("_nosym"),
    )
    same = "coalesce(x.a = get(_m, j {0}).a and x.b = get(_m, j {0}).b and x.c = get(_m, j {0}).c, false)"
    base = base.withColumn("_p", F.expr(f"sort_array(transform(filter(_m, (x, j) -> {same.format('- 1')} or {same.format('+ 1')}), x -> x.i))"))
    size = lambda c: F.length(c).cast("long")
    marks = size(F.col("_rest3")) - size(F.translate("_rest3", MARKS, ""))
    symbols = size(F.col("_rest2")) - F.col("_nosym").cast("long")
    return base.select(
        "_doc",
        "doc_id",
        "lang",
        F.col("_n").cast("long").alias("n_words"),
        "word_chars",
        symbols.alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(_p, (x, j) -> least(3L, coalesce(get(_p, j + 1) - x, 3L))), 0L, (a, b) -> a + b)").alias("n_repeat_words"),
        F.array(
            F.col("word_chars") - size("_rest"),
            size("_rest") - size("_rest2"),
            size("_rest2") - size("_rest3"),
            size("_t") - F.col("word_chars"),
            marks,
            symbols,
            size("_rest3") - marks - symbols,
        ).alias("chars"),
        F.expr("transform(_c, x -> cast((octet_length(_low) - octet_length(replace(_low, ' ' || x || ' ', ''))) div (octet_length(x) + 2) as bigint))").alias("common"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def _divergence(p: str, q: str) -> Column:
    """Jensen-Shannon divergence of two share arrays, in bits."""
    part = "case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0D end"
    return F.expr(f"0.5D * aggregate(zip_with({p}, {q}, (a, b) -> {part.format(a='a', b='b')} + {part.format(a='b', b='a')}), 0D, (x, y) -> x + y)")


def references(feats: DataFrame) -> DataFrame:
    """Mean histograms by language over the documents that pass the base rules; small: a row a language."""
    good = feats.where(~F.col("base_failed"))
    n_char, n_word = len(CHAR_CELLS), len(next(iter(COMMON.values())))
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
    rows = good.select("lang", _shares(F.col("chars"), total).alias("c"), _shares(F.col("common"), F.col("n_words").cast("double")).alias("w"))
    mean = rows.groupBy("lang").agg(*[F.avg(F.col("c")[i]).alias(f"c{i}") for i in range(n_char)], *[F.avg(F.col("w")[i]).alias(f"w{i}") for i in range(n_word)])
    word_cells = F.array(*[F.col(f"w{i}") for i in range(n_word)])
    return mean.select(F.col("lang").alias("_lang"), F.array(*[F.col(f"c{i}") for i in range(n_char)]).alias("_qc"), F.when(F.col("w0").isNotNull(), word_cells).alias("_qw"))


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, word_guard: int = WORD_GUARD, **cols) -> DataFrame:
    """doc_id, base counts, base_failed, kept, char_divergence and word_divergence for every row of docs.

    The features, about two hundred bytes a document, are checkpointed, so that texts are read
    once for both the references and the verdicts.
    """
    feats = cut(features(docs, **cols).drop("_doc"))
    return verdicts(feats, char_limit, word_limit, word_guard).drop("lang")


def verdicts(feats: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, word_guard: int = WORD_GUARD) -> DataFrame:
    """Stored features, with kept, char_divergence and word_divergence in place of the histograms; references, a row a language, are broadcast."""
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
    known = cut(references(feats))
    known = F.broadcast(known) if known.count() <= BROADCAST_LANGUAGES else known
    rows = feats.join(known, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        *feats.columns, "_qc", "_qw", total.alias("_total"), _shares(F.col("chars"), total).alias("_pc"), _shares(F.col("common"), F.col("n_words").cast("double")).alias("_pw")
    )
    rest = "concat({0}, array(greatest(0D, 1D - aggregate({0}, 0D, (a, b) -> a + b))))"
    rows = rows.select("*", F.expr(rest.format("_pw")).alias("_pw1"), F.expr(rest.format("_qw")).alias("_qw1"))
    noise = lambda k, n: F.lit((k - 1) / (8 * 0.6931471805599453)) / F.greatest(n, F.lit(1.0))
    rows = rows.select(
        "*",
        F.greatest(F.lit(0.0), _divergence("_pc", "_qc") - noise(len(CHAR_CELLS), F.col("_total"))).alias("char_divergence"),
        F.greatest(F.lit(0.0), _divergence("_pw1", "_qw1") - noise(21, F.col("n_words").cast("double"))).alias("word_divergence"),
    )
    odd = (F.coalesce(F.col("char_divergence"), F.lit(0.0)) > char_limit) | ((F.col("n_words") >= word_guard) & (F.coalesce(F.col("word_divergence"), F.lit(0.0)) > word_limit))
    given = [c for c in feats.columns if c not in ("chars", "common")]
    return rows.select(*given, (~F.col("base_failed") & ~odd).alias("kept"), "char_divergence", "word_divergence")


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs, all columns, whose text the rules keep; rows are checkpointed with their features and no text is shuffled."""
    return verdicts(cut(features(docs)), **limits).where("kept").select("_doc.*")


def oracle(char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, word_guard: int = WORD_GUARD) -> str:
    """The same in DuckDB SQL, over the view documents; words repeat by their own text, not by hashes."""
    listed = " ".join(f"when '{k}' then [{', '.join(repr(x) for x in v)}]" for k, v in COMMON.items())
    share = lambda a, n: f"list_transform({a}, lambda x: x / greatest({n}, 1)::double)"
    jsd = lambda p, q: f"0.5::double * list_sum(list_transform(list_zip({p}, {q}), lambda z: (case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0 end) + (case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0 end)))"
    noise = lambda k, n: f"{(k - 1) / (8 * 0.6931471805599453)!r}::double / greatest({n}, 1)"
    n_char, n_word = len(CHAR_CELLS), len(next(iter(COMMON.values())))
    return f"""with d as (select row_number() over () as id, doc_id, lang, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
e as (select *, len(w)::bigint as n_words, array_to_string(w, '') as j, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as lines from d),
g as (select id, p, count(*) over (partition by id, w3) as c from (select id, p, [w[p], w[p + 1], w[p + 2]] as w3 from (select id, w, unnest(range(1, len(w) - 1)) as p from e where len(w) > 2))),
r as (select id, count(distinct p + k)::bigint as n from g, (values (0), (1), (2)) o(k) where c > 1 group by id),
f as (select e.id, doc_id, lang, n_words, length(j)::bigint as word_chars, length(t)::bigint as n_chars, coalesce(r.n, 0) as n_repeat_words, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  regexp_replace(j, '\\p{{Ll}}+', '', 'g') as j1, list_transform(case lang {listed} end, lambda c: len(list_filter(w, lambda x: lower(x) = c))) as common from e left join r on r.id = e.id),
f2 as (select *, regexp_replace(j1, '\\p{{Lu}}+', '', 'g') as j2 from f), f3 as (select *, regexp_replace(j2, '\\p{{Nd}}+', '', 'g') as j3, length(j2) - length(translate(j2, '{SYMBOLS}', '')) as n_symbols from f2),
f4 as (select *, length(j3) - length(translate(j3, '{MARKS.replace("'", "''")}', '')) as marks, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from f3),
f5 as (select *, {share(f"[word_chars - length(j1), length(j1) - length(j2), length(j2) - length(j3), n_chars - word_chars, marks, n_symbols, length(j3) - marks - n_symbols]", "n_chars")} as pc, {share("common", "n_words")} as pw from f4),
q as (select lang, [{', '.join(f'avg(pc[{i + 1}])' for i in range(n_char))}] as qc, case when avg(pw[1]) is not null then [{', '.join(f'avg(pw[{i + 1}])' for i in range(n_word))}] end as qw from f5 where not base_failed group by lang),
z as (select f5.*, qc, list_append(pw, greatest(0, 1 - list_sum(pw))) as pw1, list_append(qw, greatest(0, 1 - list_sum(qw))) as qw1 from f5 left join q on f5.lang is not distinct from q.lang)
select doc_id, n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (coalesce({jsd("pc", "qc")} - {noise(n_char, "n_chars")}, 0) > {char_limit} or n_words >= {word_guard} and coalesce({jsd("pw1", "qw1")} - {noise(n_word + 1, "n_words")}, 0) > {word_limit}) as kept from z"""
