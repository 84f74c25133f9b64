"""Secret scans over a trigram inverted index, with DataFrame functions alone.

From each rule's expression a Boolean query over trigrams is derived. The index holds posting lists for the trigrams
that those queries name, keyed by (range of documents, trigram): a range has about RANGE documents, so the list of a
trigram that every document has is no longer than that. In each range the lists are intersected and united as the
queries say; the documents left are a rule's candidates, and only those are verified by its expression. A rule without
mandatory trigrams runs over every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import text_or_empty
from framewell.llm.trigrams import matching, trigram_query, trigrams
from framewell.plans.joins import small
from framewell.session import materialise


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. A match counts if its group has `least` characters; any_case: letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def regex(self) -> str:
        return "(?i)" * self.any_case + self.pattern


#: The contract's three.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a longest run from its first character: the same as [0-9a-f]+ of 24 or more
)
#: What is found besides.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


#: Documents of a range about, candidates that are broadcast at most, and elements that running values pass one by one.
RANGE, BROADCAST_ROWS, RUN = 4096, 1_000_000, 64
_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def postings(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, trigram): the place in the vocabulary of each trigram that the lower-cased text has; key is the id's hash."""
    low = F.lower(text_or_empty(text_col))
    rows = docs.select(F.xxhash64(id_col).alias("key"), low.alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(vocabulary)]))
    return rows.select("key", F.explode(has).alias("trigram"))


def posting_lists(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, trigram, keys): the inverted index. Rows that repeat an id are one entry."""
    ranges = max(1, -(-docs.count() // RANGE))
    found = postings(docs, vocabulary, id_col, text_col)
    return found.groupBy(F.pmod("key", F.lit(ranges)).alias("range"), "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, rules): the places of the rules whose trigram queries the document satisfies; none: no row."""
    queries = {k: q for k, q in ((k, trigram_query(r.pattern)) for k, r in enumerate(rules)) if q is not True}
    vocabulary = sorted(set().union(*map(trigrams, queries.values()), set()))
    if not vocabulary:
        return docs.select(F.lit(0).cast("long").alias("key"), F.array(F.lit(0)).alias("rules")).limit(0)
    index = posting_lists(docs, vocabulary, id_col, text_col)
    lists = index.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    of = {t: F.coalesce(F.try_element_at("lists", F.lit(k)), F.array().cast("array<long>")) for k, t in enumerate(vocabulary)}

    def named(rule: int, query: object) -> Column:
        return F.transform(matching(query, of), lambda key: F.struct(F.lit(rule).alias("rule"), key.alias("key")))

    found = lists.select(F.explode(F.concat(*[named(k, q) for k, q in queries.items()])).alias("f"))
    return found.groupBy("f.key").agg(F.collect_set("f.rule").alias("rules"))


def _running(values: Column, step, start: int = 0) -> Column:
    """For each element what `step` makes of all before it. Values pass through RUN elements at a time and then through the
    runs' results, so long arrays are not copied for each of their elements."""
    none = F.array().cast("array<int>")

    def through(part: Column, first: Column) -> Column:
        pair = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(part, pair, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))), lambda k: F.slice(values, k * RUN + 1, RUN))
    ends = F.transform(parts, lambda p: F.aggregate(p, F.lit(None).cast("int"), lambda acc, x: F.when(acc.isNull(), x).otherwise(step(acc, x))))
    return F.flatten(F.zip_with(parts, through(ends, F.lit(start)), through))


def _rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Its spans in the text, in order: leftmost non-overlapping matches, then those whose group is long enough."""
    found = F.struct(
        F.split(text, rule.regex, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)).alias("parts"),
    )

    def spans(f: Column) -> Column:
        gaps = F.slice(f["gaps"], 1, F.size(f["hits"]))
        both = F.zip_with(gaps, f["hits"], lambda g, h: F.length(g) + F.length(h))
        zipped = F.arrays_zip(_running(both, lambda at, x: at + x).alias("at"), gaps.alias("gap"), f["hits"].alias("hit"), f["parts"].alias("part"))
        long = F.filter(zipped, lambda x: F.length(x["part"]) >= rule.least)
        start = lambda x: x["at"] + F.length(x["gap"])
        return F.transform(long, lambda x: F.struct(start(x).alias("start"), F.lit(order).alias("ord"), (start(x) + F.length(x["hit"])).alias("end"), F.lit(rule.kind).alias("kind"))).cast(_SPANS)

    # the arrays are made once, as the only element of an array that is transformed
    return F.when(text.rlike(rule.regex), F.flatten(F.transform(F.array(found), spans))).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: the columns in keep, id, text, spans (array of start, ord, end, kind; code points, end exclusive).

    A null text is an empty one. A null id is an id like any other; rows that repeat an id are scanned each on its own.
    The spans come by start, then by rule as listed, then by end; a text without one has an empty array.
    """
    found = materialise(candidates(docs, rules, id_col, text_col).select(F.col("key").alias("_scan_key"), F.col("rules").alias("_scan_rules")), "candidates")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *[F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep])
    # where candidates are few enough the texts stay where they are
    rows = rows.join(small(found, BROADCAST_ROWS), F.xxhash64("_id") == F.col("_scan_key"), "left")
    each = []
    for k, r in enumerate(rules):
        spans = _rule_spans(F.col("_text"), r, k)
        full = trigram_query(r.pattern) is True
        each.append(spans if full else F.when(F.array_contains("_scan_rules", F.lit(k)), spans).otherwise(F.array().cast(_SPANS)))
    return rows.select(*[F.col(f"`_keep_{c}`").alias(c) for c in keep], F.col("_id").alias("id"), F.col("_text").alias("text"), F.array_sort(F.concat(*each)).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with a mark in place of each run of overlapping spans; the spans come by start.

    Each RUN spans are cut from the part of the text that they stand in, so no span searches the text from its start.
    """
    seen = _running(F.transform(spans, lambda s: s["end"]), lambda at, x: F.greatest(at, x))  # where the text is told up to
    cuts = F.zip_with(spans, seen, lambda s, at: F.struct(s["start"].alias("start"), at.alias("at")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int")), lambda k: F.slice(cuts, k * RUN + 1, RUN))

    def piece(run: Column) -> Column:
        first, last = F.get(run, F.lit(0)), F.get(run, F.size(run) - 1)
        part = F.struct(first["at"].alias("from"), F.substring(text, first["at"] + 1, F.greatest(last["start"] - first["at"], F.lit(0))).alias("body"), run.alias("cuts"))
        cut = lambda p: F.array_join(F.transform(p["cuts"], lambda c: F.when(c["start"] >= c["at"], F.concat(F.substring(p["body"], c["at"] - p["from"] + 1, c["start"] - c["at"]), F.lit(mark))).otherwise("")), "")
        return F.array_join(F.transform(F.array(part), cut), "")

    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(runs, piece), ""), rest))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def _sql_rule(k: int, r: Rule) -> str:
    p = r.regex.replace("'", "''")
    return f"""SELECT rid, {k} AS ord, '{r.kind}' AS kind, string_split_regex(t, '{p}') AS gaps,
      regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {r.group}) AS parts, {r.least} AS least FROM d"""


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_rule(k, r) for k, r in enumerate(RULES))}),
u AS (SELECT rid, ord, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT rid, ord, kind, length(parts[i]) >= least AS ok, length(hits[i]) AS n,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a FROM u),
f AS (SELECT rid, ord, a, a + n AS z, concat(kind, ':', a::BIGINT, ':', (a + n)::BIGINT) AS span FROM s WHERE ok),
g AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
      string_agg(span, ',' ORDER BY a, ord, z) FILTER (ord < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, ord, z) AS spans FROM f GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
