"""The queries of the library's own operators, each over whole tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import abbrs, bayes, clusters, graph, labels, phrases, sents, spans, titles
from ..operators.matcher import match, match_native
from ..operators.rules import RuleSet
from ..sources import dumps, store
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, words."""
    return tx.tokenize(store.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Tokens


@query(f"with {o.WORDS} select doc_id, cast(len(words) as integer) as n_tokens from words_of")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.size("words").alias("n_tokens"))


_FLAG_SQL = f"with {o.WORDS}, t as (select doc_id, unnest(words) as t from words_of), v as (select t, count(*) as n from t group by t)\n" + "\nunion all\n".join(
    f"select '{f}' as flag, cast(coalesce(sum(case when {o.flag(f)} then n else 0 end), 0) as bigint) as n from v" for f in tx.FLAGS
)


@query(_FLAG_SQL)
def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that have each lexical flag; flags are evaluated on distinct tokens."""
    counts = tx.explode_tokens(documents(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n"))
    sums = counts.agg(*(F.coalesce(F.sum(F.when(tx.flag(f, F.col("token")), F.col("n"))), F.lit(0)).alias(f) for f in tx.FLAGS))
    return sums.select(F.explode(F.create_map(*(x for f in tx.FLAGS for x in (F.lit(f), F.col(f))))).alias("flag", "n"))


_SHAPE = "regexp_replace(regexp_replace(regexp_replace(t, '\\p{Lu}', chr(1), 'g'), '\\p{Nd}', chr(2), 'g'), '\\p{L}', 'x', 'g')"
_SHAPE = f"replace(replace({_SHAPE}, chr(1), 'X'), chr(2), 'd')"
for _mark in "Xxd":
    _SHAPE = f"regexp_replace({_SHAPE}, '{_mark}{{4,}}', '{_mark * 4}', 'g')"
_SHAPE = f"case when length(t) >= 100 then 'LONG' else {_SHAPE} end"


@query(f"with {o.WORDS}, t as (select unnest(words) as t from words_of) select {_SHAPE} as shape, count(*) as n from t group by 1")
def token_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tx.explode_tokens(documents(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n"))
    return counts.groupBy(tx.shape(F.col("token")).alias("shape")).agg(F.sum("n").alias("n"))


@query(f"with {o.WORDS}, t as (select unnest(words) as t from words_of) select left(t, 1) as prefix, right(t, 3) as suffix, count(*) as n from t group by 1, 2")
def token_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tx.explode_tokens(documents(spark, sf_dir))
    return tokens.groupBy(tx.prefix(F.col("token")).alias("prefix"), tx.suffix(F.col("token")).alias("suffix")).agg(F.count("*").alias("n"))


_STARTS = f"""with pieces as (select doc_id, text, regexp_extract_all(text, '\\s*(?:{o.TOKEN})') as p, regexp_extract_all(text, '{o.TOKEN}') as w from documents where text is not null),
flat as (select doc_id, text, unnest(range(len(p))) as i, unnest(p) as p, unnest(w) as w from pieces),
placed as (select doc_id, text, i, sum(length(p)) over (partition by doc_id order by i) - length(w) as place from flat)"""


@query(f"{_STARTS} select doc_id, cast(sum(case when place <= length(text) // 2 then 1 else 0 end) - 1 as integer) as token from placed group by doc_id")
def idx2i_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token at the middle character of each document that has tokens."""
    docs = documents(spark, sf_dir).select("doc_id", F.size("words").alias("n"), tx.starts_until("text", "words", F.expr("length(text) div 2").cast("int")).alias("until"))
    return docs.where("n > 0").select("doc_id", (F.col("until") - 1).alias("token"))


@query(
    f"""{_STARTS}, b as (select doc_id, max(length(text)) as n, max(length(text)) // 4 as b, max(length(text)) // 2 as e, count(*) as k,
  sum(case when place <= length(text) // 4 then 1 else 0 end) - 1 as s, sum(case when place < length(text) // 2 then 1 else 0 end) as f from placed group by doc_id)
select doc_id, cast(greatest(s, 0) as integer) as start, cast(greatest(case when e >= n then k else f end, greatest(s, 0) + 1) as integer) as "end" from b"""
)
def char_span_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token range of the second quarter of each document's characters."""
    docs = documents(spark, sf_dir).withColumn("n", F.length("text"))
    until, before = tx.starts_until("text", "words", F.expr("n div 4").cast("int")), tx.starts_before("text", "words", F.expr("n div 2").cast("int"))
    got = docs.select("doc_id", "n", F.size("words").alias("k"), until.alias("until"), before.alias("before")).where("k > 0")
    start = F.greatest(F.lit(0), F.col("until") - 1)
    return got.select("doc_id", start.alias("start"), F.greatest(F.when(F.expr("n div 2 >= n"), F.col("k")).otherwise(F.col("before")), start + 1).alias("end"))


# Patterns

_THE = ["the", "of", "de", "und"]
_LOW = f"lower(t) in ({o.quoted(_THE)})"
_ALPHA = o.flag("IS_ALPHA")


def _matches(spark: SparkSession, sf_dir: str, *patterns: list[dict], rules: RuleSet | None = None) -> DataFrame:
    return match(documents(spark, sf_dir), rules or RuleSet().add("rule", list(patterns))).select("doc_id", "start", "end")


DETERMINED = [{"LOWER": {"IN": ["the", "of"]}}, {"IS_ALPHA": True, "OP": "+"}, {"TEXT": "."}]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases from "the" or "of" up to a full stop, with their texts."""
    return match(documents(spark, sf_dir), RuleSet().add("determined", [DETERMINED]), text=True)


def _pattern_query(name: str, patterns: list[list[dict]], tests: list[str], template: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _matches(spark, sf_dir, *patterns)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = o.match(tests, template)


_pattern_query("match_exact", [[{"TEXT": "the"}, {"TEXT": "of"}]], ["t = 'the'", "t = 'of'"], "{0}{1}")
_pattern_query("match_lower", [[{"LOWER": "the"}]], ["lower(t) = 'the'"], "{0}")
_pattern_query("match_in", [[{"LOWER": {"IN": _THE}}, {"IS_ALPHA": True}]], [_LOW, _ALPHA], "{0}{1}")
_pattern_query("match_not_in", [[{"LOWER": {"IN": _THE}}, {"TEXT": {"NOT_IN": [".", ",", "the"]}, "OP": "+"}, {"TEXT": ","}]], [_LOW, "t not in ('.', ',', 'the')", "t = ','"], "{0}{1}+{2}")
_pattern_query("match_attr_regex", [[{"TEXT": {"REGEX": "^[A-Z][a-z]+$"}}, {"LOWER": {"REGEX": "th"}}]], ["regexp_matches(t, '^(?:[A-Z][a-z]+)$')", "regexp_matches(lower(t), 'th')"], "{0}{1}")
_pattern_query("match_shape_regex", [[{"SHAPE": {"REGEX": "^[^x]+$"}}, {"TEXT": "."}]], [f"not contains({_SHAPE}, 'x') and not contains(t, chr(10))", "t = '.'"], "{0}{1}")
_pattern_query("match_any_token", [[{"LOWER": "the"}, {}, {"TEXT": "."}]], ["lower(t) = 'the'", "t = '.'"], "{0}{any}{1}")
_pattern_query("match_any_lazy", [[{"LOWER": "the"}, {"OP": "+"}, {"TEXT": "."}]], ["lower(t) = 'the'", "t = '.'"], "{0}{any}+?{1}")
_pattern_query("match_optional", [[{"LOWER": {"IN": _THE}}, {"TEXT": ",", "OP": "?"}, {"IS_TITLE": True}]], [_LOW, "t = ','", o.flag("IS_TITLE")], "{0}{1}?{2}")
_pattern_query("match_plus", [DETERMINED], ["lower(t) in ('the', 'of')", _ALPHA, "t = '.'"], "{0}{1}+{2}")
_pattern_query("match_star", [[{"IS_TITLE": True}, {"IS_LOWER": True, "OP": "*"}, {"TEXT": ","}]], [o.flag("IS_TITLE"), o.flag("IS_LOWER"), "t = ','"], "{0}{1}*{2}")
_pattern_query("match_negate", [[{"LOWER": "the"}, {"IS_PUNCT": True, "OP": "!"}, {"IS_PUNCT": True, "OP": "!"}, {"IS_PUNCT": True}]], ["lower(t) = 'the'", f"not {o.flag('IS_PUNCT')}", o.flag("IS_PUNCT")], "{0}{1}{1}{2}")
_pattern_query("match_multi_attr", [[{"IS_TITLE": True, "LENGTH": {">=": 4}}, {"LOWER": {"NOT_IN": ["the"]}, "IS_ALPHA": True, "LENGTH": {"<": 6}, "OP": "+"}]], [f"({o.flag('IS_TITLE')} and length(t) >= 4)", f"(lower(t) <> 'the' and {_ALPHA} and length(t) < 6)"], "{0}{1}+")
_pattern_query("match_literal_tokens", [[{"LOWER": "of the"}, {"IS_ALPHA": True}]], ["lower(t) = 'of'", "lower(t) = 'the'", _ALPHA], "(?:{0}{1}){2}")
_pattern_query("match_greedy_pair", [[{"IS_LOWER": True, "OP": "+"}, {"IS_STOP": True, "OP": "*"}, {"TEXT": "."}]], [o.flag("IS_LOWER"), o.flag("IS_STOP"), "t = '.'"], "{0}+{1}*{2}")


_LENGTHS = {"==": "=", "!=": "<>", ">=": ">=", "<=": "<=", ">": ">", "<": "<"}


@query(
    f"with {o.WORDS}, t as (select unnest(words) as t from words_of), v as (select length(t) as k, count(*) as n from t group by 1)\n"
    + "\nunion all\n".join(f"select '{op}' as op, cast(coalesce(sum(n), 0) as bigint) as n from v where k {sql} 6" for op, sql in _LENGTHS.items())
)
def match_length_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of one token by each comparison of its length with 6."""
    rules = RuleSet()
    for op in _LENGTHS:
        rules.add(op, [[{"LENGTH": {op: 6}}]])
    found = match(documents(spark, sf_dir), rules).groupBy(F.col("rule").alias("op")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(op,) for op in _LENGTHS], "op string")
    return every.join(found, "op", "left").select("op", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""with {o.WORDS}, f as (select doc_id, words, unnest(range(len(words) - 1)) as i from words_of where len(words) > 1)
select doc_id, cast(i as integer) as start, cast(i + 2 as integer) as "end" from f where words[i + 1] = 'the' and regexp_matches(words[i + 2], '^[a-z]+$')"""
)
def match_raw_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""A token-level regular expression over the raw text: ``the`` and the lower-case word after it."""
    return _matches(spark, sf_dir, [{"REGEX": r"(?<![\p{L}\p{N}])the\s+[a-z]+(?![\p{L}\p{N}])"}])


@query(f"""with {o.WORDS}, s as (select doc_id, words, len(words) as n, list_transform(words, lambda t: length(t) % 3 = 0) as odd from words_of),
f as (select doc_id, words, odd, unnest(range(n - 1)) as i from s where n > 1)
select doc_id, cast(i as integer) as start, cast(i + 2 as integer) as "end" from f where odd[i + 1] and lower(words[i + 2]) = 'the'""")
def match_ext_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over an attribute of the caller's own: any array column with a value for each token."""
    docs = documents(spark, sf_dir).withColumn("thirds", F.transform("words", lambda w: F.length(w) % 3 == 0))
    return match(docs, RuleSet().add("rule", [[{"_": {"thirds": True}}, {"LOWER": "the"}]])).select("doc_id", "start", "end")


@query(o.match(["lower(t) in ('the', 'of')", _ALPHA, "t = '.'"], "{0}{1}+{2}"))
def match_native_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_plus in built-in expressions alone."""
    return match_native(documents(spark, sf_dir), DETERMINED)


@query(o.match(["t = ','", _ALPHA, "t = '.'"], "{0}{1}+{2}?"))
def match_suppress_same_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppression of matches with the same end, as an operator on a table of spans."""
    raw = match(documents(spark, sf_dir), RuleSet().add("rule", [[{"TEXT": ","}, {"IS_ALPHA": True, "OP": "+"}, {"TEXT": ".", "OP": "?"}]])).select("doc_id", "start", "end")
    return spans.suppress_same_end(raw, ["doc_id"])


@query(
    f"""with {o.WORDS}, {o.match_steps("a", ["lower(t) = 'the'", _ALPHA], "{0}{1}")}, {o.match_steps("b", ["regexp_matches(t, '^[tT]he$')", _ALPHA], "{0}{1}")},
{o.match_steps("c", [o.flag("IS_TITLE"), "t = ','"], "{0}{1}")}
select 'article' as rule, doc_id, start, "end" from (select * from a union select * from b) union all select 'title' as rule, doc_id, start, "end" from c"""
)
def match_multi_rule_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules, one of two patterns with the same matches."""
    rules = RuleSet().add("article", [[{"LOWER": "the"}, {"IS_ALPHA": True}], [{"TEXT": {"REGEX": "^[tT]he$"}}, {"IS_ALPHA": True}]]).add("title", [[{"IS_TITLE": True}, {"TEXT": ","}]])
    return match(documents(spark, sf_dir), rules).select("rule", "doc_id", "start", "end")


@query(f"with {o.WORDS}, t as (select doc_id, unnest(words) as t from words_of) select lower(t) as rule, count(*) as n, count(distinct doc_id) as n_docs from t where lower(t) in ({o.quoted(tx.STOP_WORDS)}) group by 1")
def match_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a hundred rules in one pass: a rule for each stop word."""
    rules = RuleSet()
    for w in tx.STOP_WORDS:
        rules.add(w, [[{"LOWER": w}]])
    return match(documents(spark, sf_dir), rules).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_THOUSAND = "select distinct lower(t) as rule from (select unnest(words) as t from words_of) where regexp_matches(lower(t), '^[a-z]{3,}$') order by md5(lower(t)), 1 limit 1000"


@query(f"with {o.WORDS}, t as (select doc_id, lower(unnest(words)) as rule from words_of), r as ({_THOUSAND}) select rule, count(*) as n, count(distinct doc_id) as n_docs from t join r using (rule) group by rule")
def match_1000_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rules in one pass (their number is the point): one for each of a thousand words of the documents, chosen by their hashes."""
    docs = documents(spark, sf_dir)
    words = docs.select(F.explode(F.array_distinct(F.transform("words", F.lower))).alias("rule")).where(F.col("rule").rlike("^[a-z]{3,}$")).distinct().orderBy(F.md5("rule"), "rule").limit(1000)
    rules = RuleSet()
    for r in words.collect():
        rules.add(r.rule, [[{"LOWER": r.rule}]])
    return match(docs, rules).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""with {o.WORDS}, {o.match_steps("m", ["lower(t) = 'the'"], "{0}")} select doc_id, 'the' as rule, min(start) as start, min("end") as "end", count(*) as n from m group by doc_id""")
def match_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's callback transforms its matches: here to the first match of each document and their number."""
    first = lambda m: m.groupBy("doc_id", "rule").agg(F.min("start").alias("start"), F.min("end").alias("end"), F.count("*").alias("n"))
    return match(documents(spark, sf_dir), RuleSet().add("the", [[{"LOWER": "the"}]], first)).select("doc_id", "rule", "start", "end", "n")


@query(f"with {o.WORDS}, f as (select doc_id, words, unnest(range(len(words) - 1)) as i from words_of where len(words) > 1) select doc_id, cast(i as integer) as start, cast(i + 2 as integer) as \"end\" from f where words[i + 1] = 'the' and not starts_with(words[i + 2], 'th') and not starts_with(words[i + 2], 'on')")
def match_compat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion by prefix, in the compatible mode."""
    return match(documents(spark, sf_dir), RuleSet(compat=True).add("rule", [[{"TEXT": "the"}, {"TEXT": {"NOT_IN": ["th", "on"]}}]])).select("doc_id", "start", "end")


# Spans and labels

_SPANS = f"""{o.WORDS}, {o.match_steps("a", [o.flag("IS_TITLE"), o.flag("IS_LOWER")], "{0}{1}*")}, {o.match_steps("b", [o.flag("IS_STOP"), _ALPHA, "t = ','"], "{0}{1}{2}?")}, {o.match_steps("c", [_ALPHA, "t = '.'"], "{0}{1}")},
s as (select doc_id, start, "end", 'A' as label from a union select doc_id, start, "end", 'B' from b union select doc_id, start, "end", 'C' from c)"""


_LABELS = ["A", "B", "C"]


def _label_spans(spark: SparkSession, sf_dir: str, packed: Callable) -> DataFrame:
    rules = (
        RuleSet().add("A", [[{"IS_TITLE": True}, {"IS_LOWER": True, "OP": "*"}]]).add("B", [[{"IS_STOP": True}, {"IS_ALPHA": True}, {"TEXT": ",", "OP": "?"}]])
        .add("C", [[{"IS_ALPHA": True}, {"TEXT": "."}]])
    )
    return match(documents(spark, sf_dir), rules, packed=packed)


@query(f"""with {_SPANS}, m as (select *, max("end") over (partition by doc_id order by start, "end" desc rows between unbounded preceding and 1 preceding) as most from (select distinct doc_id, start, "end" from s)) select doc_id, start, "end" from m where "end" > coalesce(most, 0)""")
def phrase_running_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.outermost(_label_spans(spark, sf_dir, spans.pack_outer))


_CONTAINED = """((x.start > y.start and x."end" <= y."end") or (x.start >= y.start and x."end" < y."end"))"""


@query(f"""with {_SPANS}, x as (select distinct doc_id, start, "end" from s) select doc_id, start, "end" from x where not exists (select 1 from x y where x.doc_id = y.doc_id and {_CONTAINED})""")
def span_drop_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.outermost(_label_spans(spark, sf_dir, spans.pack_outer))


_LONGEST = f"""c as (select x.*, y.start as ys, y."end" as ye, y.label as yl,
    case when {_CONTAINED} then 'drop' when x.start < y.start then 'head' else 'tail' end as does,
    row_number() over (partition by x.doc_id, x.start, x."end", x.label order by y.start, y."end" desc, y.label) as k
  from s x join s y on x.doc_id = y.doc_id and x.start < y."end" and y.start < x."end"
    and ({_CONTAINED} or (x.start < y.start and x."end" < y."end") or (x.start > y.start and x."end" > y."end"))),
d as (select s.*, c.ys, c.ye, c.yl, c.does from s left join c on c.k = 1 and s.doc_id = c.doc_id and s.start = c.start and s."end" = c."end" and s.label = c.label)
select distinct doc_id, case when does = 'tail' then ys else start end as start, case when does = 'head' then ye else "end" end as "end", case when does = 'head' then yl else label end as label
from d where does is null or does <> 'drop'"""


@query(f"with {_SPANS.replace('c as (select doc_id, cast', 'c_ as (select doc_id, cast').replace('from c)', 'from c_)')}, {_LONGEST}")
def span_first_conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.only_longest_packed(_label_spans(spark, sf_dir, spans.pack), _LABELS)


@query(f"""with {_SPANS}, t as (select doc_id, label, unnest(range(start, "end")) as i from s) select doc_id, cast(i as integer) as i, array_to_string(list_sort(list(distinct label)), ',') as labels from t group by doc_id, i""")
def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.token_labels_packed(_label_spans(spark, sf_dir, spans.pack), _LABELS, joined=",")


#: Pairs of texts that stand for abbreviations with their long forms: a word with a capital, and the word after it.
_PAIRED = f"""p as (select doc_id, i as short_start, i + 1 as short_end, i + 1 as long_start, i + 2 as long_end, words[i + 1] as short_text, words[i + 2] as long_text
  from (select doc_id, words, unnest(range(len(words) - 1)) as i from words_of where len(words) > 1) where {o.flag("IS_TITLE", "words[i + 1]")} and {o.flag("IS_ALPHA", "words[i + 2]")})"""


@query(
    f"""with {o.WORDS}, {_PAIRED}, {o.match_steps("m", ["regexp_matches(lower(t), '^th')"], "{0}")},
l as (select m.doc_id, start, "end", 'TH' as label, words[start + 1] as text from m join words_of w on m.doc_id = w.doc_id),
k as (select distinct doc_id, text, label from l),
b as (select p.*, s.label as sl, g.label as gl from p left join k s on p.doc_id = s.doc_id and p.short_text = s.text left join k g on p.doc_id = g.doc_id and p.long_text = g.text)
select doc_id, cast(start as integer) as start, cast("end" as integer) as "end", label, text from l
union all select doc_id, cast(short_start as integer), cast(short_end as integer), gl, short_text from b where sl is null and gl is not null
union all select doc_id, cast(long_start as integer), cast(long_end as integer), sl, long_text from b where gl is null and sl is not null"""
)
def label_abbr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = labels.labelled(docs, labels.label_rules([("TH", [[{"LOWER": {"REGEX": "^th.*"}}]])]))
    # An outer explode, as another one has the texts cut into tokens once more for its condition.
    x = docs.select("doc_id", "words", F.posexplode_outer("words").alias("i", "w")).where(tx.flag("IS_TITLE", F.col("w"))).select("doc_id", "i", "w", F.get("words", F.col("i") + 1).alias("next"))
    i = F.col("i")
    pairs = x.where(tx.flag("IS_ALPHA", F.col("next"))).select("doc_id", i.alias("short_start"), (i + 1).alias("short_end"), (i + 1).alias("long_start"), (i + 2).alias("long_end"), F.col("w").alias("short_text"), F.col("next").alias("long_text"))
    return labels.pass_through_abbreviations(found, pairs)


# Phrases and sentences


def _tag_sql(t: str = "t") -> str:
    closed = " ".join(f"when lower({t}) in ({o.quoted(m.split())}) then '{tag}'" for tag, m in reversed(phrases.CLOSED.items()))
    return f"""case {closed} when regexp_matches({t}, '^\\p{{N}}[\\p{{N}}.,]*$') then 'NUM' when regexp_matches({t}, '^[^\\p{{L}}\\p{{N}}]') then 'PUNCT' when regexp_matches({t}, '^\\p{{Lu}}') then 'PROPN'
  when regexp_matches(lower({t}), '^.{{2,}}(?:ly)$') then 'ADV' when regexp_matches(lower({t}), '^.{{2,}}(?:ous|ful|able|ible|al|ive)$') then 'ADJ' when regexp_matches(lower({t}), '^.{{2,}}(?:ed|ing)$') then 'VERB' else 'NOUN' end"""


_TAGGED = f"{o.WORDS}, tagged as (select doc_id, list_transform(words, lambda t: {_tag_sql()}) as words from words_of)"


def _phrase_sql(pattern: list[dict]) -> str:
    tests = [f"t in ({o.quoted(s['POS']['IN'])})" for s in pattern]
    template = "".join(f"{{{k}}}{s.get('OP', '')}" for k, s in enumerate(pattern))
    return f"""with {_TAGGED}, {o.match_steps("m", tests, template, "tagged")},
r as (select *, max("end") over (partition by doc_id order by start, "end" desc rows between unbounded preceding and 1 preceding) as most from m), x as (select doc_id, start, "end" from r where "end" > coalesce(most, 0))
select doc_id, start, "end" from x where not exists (select 1 from x y where x.doc_id = y.doc_id and {_CONTAINED})"""


@query(_phrase_sql(phrases.NOUN_PHRASE))
def np_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noun phrases on tags of the closed-class lexicon, which is no tagger."""
    return phrases.noun_phrases(phrases.tag_by_lexicon(documents(spark, sf_dir)))


@query(_phrase_sql(phrases.VERB_PHRASE))
def vp_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.verb_phrases(phrases.tag_by_lexicon(documents(spark, sf_dir)))


_SAFE = f"{sents.SAFE_ACRONYM}|{sents.SAFE_ABBREVIATION}"
_SENTENCES = f"""{o.WORDS}, f as (select doc_id, unnest(range(len(words))) as i, unnest(words) as t from words_of),
g as (select doc_id, i, t, lag(t) over w as p, lag({_tag_sql()}) over w as tag, row_number() over w as k from f window w as (partition by doc_id order by i)),
h as (select doc_id, i, coalesce(regexp_matches(t, '{sents.STARTER}') and tag in ({o.quoted(sents.BEFORE_STARTER)}), false) as split,
  p is not null and regexp_matches(t, '{sents.ENDS.replace(chr(39), chr(39) * 2)}') and not regexp_matches(t, '{_SAFE}') and not regexp_matches(coalesce(p, ''), '{_SAFE}') as raw from g),
j as (select *, raw and not split as c from h),
q as (select *, sum(case when c then 0 else 1 end) over (partition by doc_id order by i) as run from j),
r as (select *, c and row_number() over (partition by doc_id, run, c order by i) % 2 = 1 as b from q),
starts as (select doc_id, i from (select *, coalesce(lag(b) over (partition by doc_id order by i), true) as s from r) where split or s)"""


def _with_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sents.with_sentences(phrases.tag_by_lexicon(documents(spark, sf_dir)))


@query(f"with {_SENTENCES} select doc_id, cast(i as integer) as start from starts")
def sent_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sentences(spark, sf_dir).select("doc_id", F.explode("sent_starts").alias("start"))


@query(f"with {_SENTENCES} select doc_id, count(*) as n_sentences from starts group by doc_id")
def sent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sentences(spark, sf_dir).where("size(sent_starts) > 0").select("doc_id", F.size("sent_starts").cast("long").alias("n_sentences"))


# Abbreviations


@query(
    f"""with {o.WORDS}, f as (select doc_id, words, unnest(range(len(words))) as i, unnest(words) as t from words_of),
c as (select doc_id, i, t, words[i + 2] as nx, min(case when t in (')', ']') then i end) over (partition by doc_id order by i rows between 1 following and unbounded following) as e from f)
select distinct doc_id, cast(start as integer) as start, cast("end" as integer) as "end" from (
  select doc_id, i as start, i + 1 as "end" from f where length(t) > 1 and {o.flag("IS_ALPHA")} and {o.flag("IS_UPPER")}
  union all select doc_id, i + 1, e from c where t in ('(', '[') and e > i + 1 and nx not in ('(', '['))"""
)
def abbr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that may be short or long forms: upper-case words, and what stands in brackets."""
    return documents(spark, sf_dir).select("doc_id", F.explode(abbrs.candidates_column("words")).alias("s")).select("doc_id", "s.start", "s.end")


@query()
def abbr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations of all documents, with an introduced one appended to each that has tokens: its first two words of letters, their initials, and a later use."""
    docs = documents(spark, sf_dir)
    # Made once, and of the first words where they do.
    letters = lambda of: F.slice(F.filter(of, lambda w: w.rlike(r"^\p{L}{2,}$")), 1, 2)
    docs = docs.withColumn("alpha", letters(F.slice("words", 1, 64)))
    docs = docs.withColumn("alpha", F.when((F.size("alpha") < 2) & (F.size("words") > 64), letters(F.col("words"))).otherwise(F.col("alpha")))
    alpha = F.col("alpha")
    initials = F.upper(F.concat(F.left(alpha[0], F.lit(1)), F.left(alpha[1], F.lit(1))))
    said = F.concat(F.array(alpha[0], alpha[1], F.lit("("), initials, F.lit(")"), F.lit(","), F.lit("as"), initials), "words")
    return abbrs.abbreviations(docs.withColumn("words", F.when(F.size(alpha) >= 2, said).otherwise(F.col("words"))))


@query(
    f"""with {o.WORDS}, f as (select doc_id, unnest(range(len(words))) as i, unnest(words) as t from words_of),
d as (select doc_id, i as since from f where {o.flag("IS_TITLE")}), h as (select doc_id, i as at from f where t = ',')
select h.doc_id, cast(h.at as integer) as at, cast(max(d.since) as integer) as definition from h join d on h.doc_id = d.doc_id and d.since <= h.at group by h.doc_id, h.at"""
)
def abbr_asof_lone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join that gives a lone form its latest definition: here each comma the latest title-case word."""
    found = match(documents(spark, sf_dir), RuleSet().add("hit", [[{"TEXT": ","}]]).add("definition", [[{"IS_TITLE": True}]]), packed=spans.pack)
    return spans.as_of_packed(found).select("doc_id", "at", F.col("since").alias("definition"))


# The graph of the star schema: regions, nations, brands and types are categories with articles of the same titles; customers and parts are articles

_KINDS = ("select 1 as kind, cast(r_regionkey as bigint) as k, r_name as title from {region} union all select 2, cast(n_nationkey as bigint), n_name from {nation} "
          "union all select 3, row_number() over (order by p_brand), p_brand from (select distinct p_brand from {part}) b union all select 4, row_number() over (order by p_type), p_type from (select distinct p_type from {part}) t")  # fmt: skip
_PART_TITLE = "concat(replace(p_name, ' ', '_'), '_(', cast({k} as varchar(20)), ')')"
RAW = {
    "page": f"select '14' as ns, kind * 1000000000000 + k as id, title, kind * 1000000000000 + k as ord from ({_KINDS}) c union all "
    f"select '0', (10 + kind) * 1000000000000 + k, title, (10 + kind) * 1000000000000 + k from ({_KINDS}) a where kind <> 3 or k % 2 = 0 union all "
    "select '0', 20000000000000 + c_custkey, c_name, 20000000000000 + c_custkey from {customer} union all "
    f"select '0', 30000000000000 + p_partkey, {_PART_TITLE.format(k='p_partkey')}, 30000000000000 + p_partkey from {{part}} union all select '1', 40000000000000 + c_custkey, c_name, 0 from {{customer}}",
    "props": "select 20000000000000 + c_custkey as id, 'noindex' as prop, '' as value, 1 as ord from {customer} where c_acctbal < 0 union all select 3000000000013, 'hiddencat', '', 1 union all "
    "select 30000000000000 + p_partkey, 'disambiguation', '', 1 from {part} where p_partkey % 10 = 5 union all select 30000000000000 + p_partkey, 'disambiguation', 'again', 2 from {part} where p_partkey % 10 = 5",
    "redirect": f"select 30000000000000 + p_partkey as source_id, {_PART_TITLE.format(k='q')} as target_title, p_partkey as ord from (select *, p_partkey - 1 as q from {{part}}) p where p_partkey % 8 <> 0 and p_partkey % 10 <> 5",
    "links": "select 'page' as type, 20000000000000 + c_custkey as source_id, n_name as target_title from {customer} join {nation} on c_nationkey = n_nationkey union all "
    "select 'page', 30000000000000 + p_partkey, p_brand from {part} union all select 'page', 30000000000000 + p_partkey, p_type from {part} union all select 'file', 30000000000000 + p_partkey, p_type from {part} union all "
    "select 'subcat', 2000000000000 + n_nationkey, r_name from {nation} join {region} on n_regionkey = r_regionkey",
}
_STAR = ("region", "nation", "customer", "part")
_GRAPH_SQL = ", ".join(f"{name} as ({sql.format(**{t: t for t in _STAR})})" for name, sql in RAW.items())
# A redirect's source has no p_name but its own: the target has the name of the part before it.
_GRAPH_SQL = f"""{_GRAPH_SQL},
kept as (select * from page where ns in ('0', '14') and id not in (select id from props where prop in ('hiddencat', 'noindex'))),
art as (select title, max_by(id, ord) as id from kept where ns = '0' group by title),
cat as (select 'Category:' || title as title, max_by(id, ord) as id from kept where ns = '14' group by 1),
dis as (select title, min_by(id, ord) as id from kept where id in (select id from props where prop = 'disambiguation') group by title),
red1 as (select k.title, min_by(a.id, r.ord) as target_id from redirect r join kept k on k.ns = '0' and k.id = r.source_id join art a on a.title = r.target_title group by k.title),
edge as (select distinct l.source_id as src, c.id as dst from links l join cat c on c.title = 'Category:' || l.target_title
  where l.type in ('page', 'subcat') and l.target_title in (select title from art) and (l.type = 'subcat' or l.source_id in (select id from kept where ns = '0')))"""
_GRAPH_ALL = f"""recursive {_GRAPH_SQL},
walk as (select title, target_id, 0 as depth from red1 union all select w.title, r.target_id, w.depth + 1 from walk w join art a on a.id = w.target_id join red1 r on r.title = a.title where w.depth < 64),
red as (select title, max_by(target_id, depth) as target_id from walk group by title),
pag as (select * from art where title not in (select title from dis) and title not in (select title from red)),
names as (select id, min(title) as title, 1 as k from pag group by id union all select id, min(title), 2 from cat group by id union all select id, min(title), 3 from dis group by id),
named as (select id, min_by(title, k) as title from names group by id),
lookups as (select title, id, 1 as k from pag union all select title, target_id, 2 from red union all select title, id, 3 from cat union all select title, id, 4 from dis),
ids as (select title, min_by(id, k) as id from lookups group by title)"""


def raw_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four dump tables that the star schema stands for."""
    star = {t: table(spark, sf_dir, t) for t in _STAR}
    return {name: spark.sql(sql, **{t: d for t, d in star.items() if f"{{{t}}}" in sql}) for name, sql in RAW.items()}


_graphs: dict[tuple[str, str], graph.PageGraph] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> graph.PageGraph:
    """Built once for each application and folder, then asked; its tables are checkpoints."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs.clear()
        raw = raw_graph(spark, sf_dir)
        _graphs[key] = graph.build(raw["page"], raw["props"], raw["redirect"], raw["links"])
    return _graphs[key]


@query(f"with {_GRAPH_SQL} select id, prop, min_by(value, ord) as value from props group by id, prop")
def graph_props_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.props_by_page(raw_graph(spark, sf_dir)["props"])


@query(f"with {_GRAPH_SQL} select ns, id, title from kept")
def graph_hidden_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_graph(spark, sf_dir)
    return graph.kept_pages(raw["page"], raw["props"]).select("ns", "id", "title")


@query(f"with {_GRAPH_SQL} select src, dst from edge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).edges


@query(f"with {_GRAPH_SQL} select title, target_id from red1")
def graph_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_graph(spark, sf_dir)
    kept = graph.kept_pages(raw["page"], raw["props"])
    return graph.resolved_redirects(raw["redirect"], kept, graph.article_pages(kept))


@query(f"with {_GRAPH_ALL} select title, target_id from red")
def graph_redirect_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).redirects


@query(f"with {_GRAPH_ALL} select title, id from dis")
def graph_disambiguations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).disambiguations


@query(f"with {_GRAPH_ALL} select title, id from pag")
def graph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).pages


@query(f"with {_GRAPH_ALL} select title, id from cat")
def graph_category_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).categories


@query(f"with {_GRAPH_ALL} select title from pag union all select title from red union all select title from dis")
def graph_pages_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.all_pages(star_graph(spark, sf_dir), True, True)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles of the dump, with and without the category's prefix, and one that no page has."""
    page = raw_graph(spark, sf_dir)["page"].select("title")
    return page.unionByName(page.select(F.concat(F.lit("Category:"), F.col("title")).alias("title"))).unionByName(spark.createDataFrame([("No such page",)], "title string")).distinct()


_ASKED = "asked as (select title from page union select 'Category:' || title from page union select 'No such page')"


@query(f"with {_GRAPH_ALL}, {_ASKED} select a.title, i.id from asked a left join ids i using (title)")
def graph_id_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.id_of_page(star_graph(spark, sf_dir), _asked(spark, sf_dir))


@query(f"with {_GRAPH_ALL} select p.id, n.title from (select distinct id from page) p left join named n using (id)")
def graph_page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_of_id(star_graph(spark, sf_dir), raw_graph(spark, sf_dir)["page"].select("id").distinct())


@query(f"with {_GRAPH_ALL}, {_ASKED} select a.title, case when r.target_id is null then a.title else n.title end as target from asked a left join red r using (title) left join named n on n.id = r.target_id")
def graph_redirect_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.redirect(star_graph(spark, sf_dir), _asked(spark, sf_dir))


@query(
    f"""with {_GRAPH_ALL}, {_ASKED}, t as (select a.title, case when r.target_id is null then a.title else n.title end as target from asked a left join red r using (title) left join named n on n.id = r.target_id)
select title, title in (select title from red) as is_redirect, coalesce(target in (select title from dis), false) as is_disambiguation, title in (select title from cat) as is_category from t"""
)
def graph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kinds(star_graph(spark, sf_dir), _asked(spark, sf_dir))


def _hops_sql(distance: int, both: bool) -> str:
    edges = "step as (select src, dst from edge union select dst, src from edge)" if both else "step as (select src, dst from edge)"
    hops = ", ".join(f"h{k} as (select distinct h.start, s.dst as id from {'st' if k == 1 else f'h{k - 1}'} h join step s on s.src = h.{'start' if k == 1 else 'id'})" for k in range(1, distance + 1))
    union = " union ".join(f"select start, id from h{k}" for k in range(1, distance + 1))
    return f"""with {_GRAPH_ALL}, {_ASKED}, {edges},
t as (select a.title, case when r.target_id is null then a.title else n.title end as target from asked a left join red r using (title) left join named n on n.id = r.target_id),
st0 as (select t.title, i.id as start from t join ids i on i.title = t.target), st as (select distinct start from st0), {hops}, reach as ({union})
select st0.title, reach.id, named.title as reached from st0 join reach on reach.start = st0.start left join named on named.id = reach.id"""


def _hops(name: str, ask: Callable[..., DataFrame], distance: int, both: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ask(star_graph(spark, sf_dir), _asked(spark, sf_dir), distance)

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, _hops_sql(distance, both)


_hops("graph_categories_k1", graph.categories_of, 1, False)
_hops("graph_categories_k2", graph.categories_of, 2, False)
_hops("graph_neighbours_k1", graph.neighbours_of, 1, True)
_hops("graph_neighbours_k2", graph.neighbours_of, 2, True)


# Titles

_CLEAN = "regexp_replace(title, '^(.*?)_\\([^)]*\\)', '\\1')"


@query(f"with {_GRAPH_SQL} select title, {_CLEAN} as cleaned from page")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_graph(spark, sf_dir)["page"].select("title", titles.clean_title(F.col("title")).alias("cleaned"))


#: Titles are the targets of the links of all pages, all benchmark items as a whole, and the names of nations and parts.
_TITLES = f"""links_of as (select unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) as title from pages), whole as (select regexp_extract_all(text, '{o.TOKEN}') as w from benchmark where text is not null),
titles as (select distinct title, title as ord from (select title from links_of union select array_to_string(w, '_') from whole union select n_name from nation union select p_name from part)),
keyed as (select ord, title, list_filter(regexp_extract_all(case when lower({_CLEAN}) = '' then lower(title) else lower({_CLEAN}) end, '{o.TOKEN}'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) as tokens from titles where title <> ''),
idx as (select array_to_string(tokens, ' ') as key, max(len(tokens)) as n_tokens, list(title order by ord) as titles from keyed where len(tokens) > 0 group by 1)"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("title"))
    whole = tx.tokenize(table(spark, sf_dir, "benchmark")).where("words is not null").select(F.array_join("words", "_").alias("title"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")))
    return links.unionByName(whole).unionByName(names).distinct().withColumn("ord", F.col("title"))


@query(f"with {_TITLES} select key, cast(n_tokens as integer) as n_tokens, array_to_string(titles, '|') as titles from idx")
def title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.title_index(page_titles(spark, sf_dir)).select("key", "n_tokens", F.array_join("titles", "|").alias("titles"))


_ALL = f"""{_TITLES}, {o.WORDS}, tok as (select doc_id, i, t, row_number() over (partition by doc_id order by i) as k from (select doc_id, unnest(range(len(words))) as i, unnest(list_transform(words, lambda x: lower(x))) as t from words_of) where regexp_matches(t, '[\\p{{L}}\\p{{N}}]')),
arr as (select doc_id, list(t order by k) as ts, list(i order by k) as places from tok group by doc_id),
opened as (select doc_id, i, k, key, n_tokens, titles from tok join idx on split_part(key, ' ', 1) = t),
found as (select o.doc_id, o.i as start, arr.places[o.k + n_tokens - 1] + 1 as "end", key, titles from opened o join arr using (doc_id) where len(ts) >= o.k + n_tokens - 1 and array_to_string(ts[o.k : o.k + n_tokens - 1], ' ') = key)"""
_SCAN = f"""{_ALL}, best as (select doc_id, start, max("end") as "end" from found group by doc_id, start),
hop as (select b.doc_id, b.start, b."end", n.start as nxt from best b asof left join best n on b.doc_id = n.doc_id and b."end" <= n.start),
walk as (select doc_id, start, "end", nxt from (select *, row_number() over (partition by doc_id order by start) as r from hop) where r = 1 union all select h.doc_id, h.start, h."end", h.nxt from walk w join hop h on h.doc_id = w.doc_id and h.start = w.nxt)"""


@query(f"""with recursive {_SCAN} select f.doc_id, cast(f.start as integer) as start, cast(f."end" as integer) as "end", array_to_string(f.titles, '|') as titles from walk w join found f on f.doc_id = w.doc_id and f.start = w.start and f."end" = w."end" """)
def title_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = titles.scan(documents(spark, sf_dir), titles.title_index(page_titles(spark, sf_dir)))
    return found.withColumn("titles", F.array_join("titles", "|"))


@query(f"""with recursive {_SCAN} select distinct f.doc_id, cast(f.start as integer) as start, cast(f."end" as integer) as "end", array_to_string(f.titles, '|') as titles from walk w join found f on f.doc_id = w.doc_id and f.start >= w.start and f."end" <= w."end" """)
def title_submatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = titles.sub_matches(documents(spark, sf_dir), titles.title_index(page_titles(spark, sf_dir)))
    return found.withColumn("titles", F.array_join("titles", "|"))


# Dumps


def _dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page dump of the customers, a line for each nation, with quotes, brackets and commas in its titles, and a line that isn't an INSERT."""
    quote = F.lit("'")
    row = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(","), F.when(F.col("c_custkey") % 3 == 0, "14").otherwise("0"), F.lit(","), quote, F.lit("O\\'Brien_\\\"(x),_"), F.col("c_name"), quote, F.lit(",NULL,'',0.5)"))
    lines = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(row), ",").alias("rows")).select(F.concat(F.lit("INSERT INTO `page` VALUES "), F.col("rows"), F.lit(";")).alias("line"), F.col("c_nationkey").cast("long").alias("ord"))
    return lines.unionByName(spark.createDataFrame([("-- (1,0,'no',NULL,'',1)", -1)], "line string, ord long"))


@query("select c_custkey as id, case when c_custkey % 3 = 0 then '14' else '0' end as ns, 'O\\''Brien_\\\"(x),_' || c_name as raw_title, 'NULL' as f3, '' as f4, '0.5' as f5 from customer")
def dump_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda k: F.get("fields", F.lit(k))
    rows = dumps.parse_lines(_dump_lines(spark, sf_dir))
    return rows.select(f(0).cast("long").alias("id"), f(1).alias("ns"), f(2).alias("raw_title"), f(3).alias("f3"), f(4).alias("f4"), f(5).alias("f5"))


@query("select case when c_custkey % 3 = 0 then '14' else '0' end as ns, c_custkey as id, 'O''Brien_\"(x),_' || c_name as title from customer")
def dump_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.page_rows(dumps.parse_lines(_dump_lines(spark, sf_dir))).select("ns", "id", "title")


# Neighbours and clusters


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")


_SIM = """e as (select vec_id as key, cast(embedding as double[]) as v from embeddings),
s as (select a.key, b.key as other, list_cosine_similarity(a.v, b.v) as sim from e a join e b on a.key <> b.key),
r as (select *, row_number() over (partition by key order by sim desc, other) as rank from s), knn as (select * from r where rank <= 30)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose ids are divisible by 100 ask all vectors."""
    return _vectors(spark, sf_dir).where("key % 100 = 0")


@query(f"with {_SIM} select key, other, round(sim, 6) as sim, cast(rank as integer) as rank from knn where key % 100 = 0")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.nearest(_vectors(spark, sf_dir), queries=_queries(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query(f"with {_SIM}, b as (select key as other, sim as best from knn where rank = 1) select key, round(least(max(sim), (sum(best) + max(sim)) / (count(*) + 1) - 0.1), 6) as min_score from knn join b using (other) where key % 100 = 0 group by key")
def knn_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.default_score(_vectors(spark, sf_dir), _queries(spark, sf_dir)).withColumn("min_score", F.round("min_score", 6))


def _document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, as chunks of documents of 50."""
    return _vectors(spark, sf_dir).select(F.expr("key div 50").alias("doc"), "key", "vec")


@query()
def ball_single_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balls around the first vector of each document."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        made = clusters.Group(pdf["key"].tolist(), np.stack(pdf["vec"].to_list()).astype(np.float64))
        found = [made.names(b) for b in made.balls(0)]
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]] * len(found), "ball": range(len(found)), "members": found})

    return _document_vectors(spark, sf_dir).groupBy("doc").applyInPandas(run, "doc bigint, ball int, members array<bigint>")


@query()
def ball_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged balls of all roots of each document."""
    return clusters.cluster(_document_vectors(spark, sf_dir), "doc")


@query("select label, d - 1 as d, round(avg(v[d]), 6) as x from (select label, cast(embedding as double[]) as v, unnest(range(1, len(embedding) + 1)) as d from embeddings) group by label, d")
def chunk_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of chunks: a chunk for each label, whose words are the ids of its vectors."""
    e = table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vec"))
    chunks = e.groupBy("label").agg(F.collect_list(F.col("vec_id").cast("string")).alias("words"))
    return clusters.chunk_vectors(chunks, vectors, ["label"]).select("label", F.posexplode("vec").alias("d", "x")).select("label", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


# Naive Bayes


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, word, next: each full stop with the words around it, over all documents."""
    # An outer explode, as another one has the texts cut into tokens once more for its condition.
    x = documents(spark, sf_dir).select("doc_id", "words", F.posexplode_outer("words").alias("i", "w")).where("w = '.'")
    before = F.when(F.col("i") > 0, F.get("words", F.col("i") - 1))
    return x.select("doc_id", "i", F.concat(F.coalesce(before, F.lit("")), F.lit(".")).alias("word"), F.get("words", F.col("i") + 1).alias("next"))


def _word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As large as the vocabulary; it is joined twice."""
    return store.cut(bayes.word_counts(documents(spark, sf_dir)))


_NB = rf"""{o.WORDS}, f as (select doc_id, unnest(range(len(words))) as i, unnest(words) as t from words_of),
n as (select *, lag(t) over w as p, lead(t) over w as nx from f window w as (partition by doc_id order by i)),
cnt as (select t as word, sum(case when nx is not distinct from '.' then 0 else 1 end) as non_abbr, sum(case when {o.flag("IS_LOWER")} then 1 else 0 end) as low from n group by t),
c as (select doc_id, i, regexp_replace(regexp_replace(regexp_replace(coalesce(p, '') || '.', '[.,\d]*\d', '<NUM>', 'g'), '[^a-zA-Z0-9.<>\-'' ]', '', 'g'), '^.+?-', '') as c1,
  regexp_replace(regexp_replace(regexp_replace(coalesce(nx, ''), '[.,\d]*\d', '<NUM>', 'g'), '[^a-zA-Z0-9.<>\-'' ]', '', 'g'), '-.+?$', '') as c2 from n where t = '.'),
d as (select c.*, regexp_matches(replace(c1, '.', ''), '^\p{{L}}+$') as a1, regexp_matches(replace(c2, '.', ''), '^\p{{L}}+$') as a2, coalesce(x.non_abbr, 0) as na, coalesce(y.low, 0) as lo, case when regexp_matches(c2, '^\p{{Lu}}') then 'True' else 'False' end as up
  from c left join cnt x on x.word = substr(c1, 1, length(c1) - 1) left join cnt y on y.word = lower(c2)),
feats as (select doc_id, i, unnest([
  'w1_' || c1, 'w2_' || c2, 'both_' || c1 || '_' || c2, case when a1 then 'w1length_' || least(10, length(regexp_replace(c1, '\W', '', 'g'))) end, case when a1 then 'w1abbr_' || cast(floor(ln(1 + na)) as bigint) end,
  case when a2 then 'w2cap_' || up end, case when a2 then 'w2lower_' || cast(floor(ln(1 + lo)) as bigint) end, case when a2 then 'w1w2upper_' || c1 || '_' || up end]) as feat from d),
seen as (select feats.*, quality as label from feats join labels using (doc_id) where feat is not null),
k as (select feat, sum(case when label = 0 then 1 else 0 end) as c0, sum(case when label = 1 then 1 else 0 end) as c1 from seen group by feat),
tot as (select sum(c0) + 0.1 * count(*) as t0, sum(c1) + 0.1 * count(*) as t1 from k),
model as (select feat, (c0 + 0.1) / t0 as p0, (c1 + 0.1) / t1 as p1 from k cross join tot union all select null, t0 / (t0 + t1), t1 / (t0 + t1) from tot)"""


@query(f"with {_NB} select feat, count(*) as n from feats where feat is not null group by feat")
def nb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = bayes.boundary_pairs(_boundaries(spark, sf_dir), _word_counts(spark, sf_dir), [F.count("*").alias("n")])
    return features.groupBy("feat").agg(F.sum("n").alias("n"))


def _labelled_features(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """(pair, feat, n0, n1, n_labels): with a left join also the pairs that no labelled document has."""
    known = _boundaries(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", how)
    sums = [F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
    return bayes.boundary_pairs(known, _word_counts(spark, sf_dir), [*sums, F.count("label").alias("n_labels")])


@query(f"with {_NB} select feat, round(p0, 9) as p0, round(p1, 9) as p1 from model")
def nb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.train_pairs(_labelled_features(spark, sf_dir, "inner")).select("feat", F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"))


@query(
    f"""with {_NB}, pr as (select 4 * ln(p0) as b0, 4 * ln(p1) as b1 from model where feat is null),
sc as (select doc_id, i, coalesce(sum(ln(p0)), 0) as s0, coalesce(sum(ln(p1)), 0) as s1 from feats left join model using (feat) where feats.feat is not null group by doc_id, i)
select doc_id, i, round(1 / (1 + exp(s0 + b0 - s1 - b1)), 5) as p1 from sc cross join pr"""
)
def nb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As large as the distinct pairs; read for the model, and again for their probabilities.
    features = store.cut(_labelled_features(spark, sf_dir, "left"))
    told = bayes.classify(features, bayes.train_pairs(features), "pair").select("pair.word", "pair.next", F.round("p1", 5).alias("p1"))
    items, told = _boundaries(spark, sf_dir), told.withColumnRenamed("next", "_next").withColumnRenamed("word", "_word")
    return items.join(told, (F.col("word") == F.col("_word")) & F.col("next").eqNullSafe(F.col("_next"))).select("doc_id", F.col("i").cast("long").alias("i"), "p1")


@query("select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint)) as k from events group by event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").cast("decimal(38,0)").alias("k"))
