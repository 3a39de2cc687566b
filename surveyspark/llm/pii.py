"""Personal data: base patterns, and terms that reveal who they belong to. SQL functions only.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of each kind that pass
their check. The patterns below match the same spans as the plain forms: possessive, and tied to
the start of a run, so that no text makes the matcher go back and forth.

Information-theoretic step: a protected entity is a personal value (its kind and normalised text).
With df over all documents, ``PMI(e; t) = log2(df(e, t) * N / (df(e) * df(t)))`` and
``IC(e) = log2(N / df(e))``, a term t discloses the share ``PMI / IC`` of e. A share counts only if it
is no chance: when the words of every document frequency fell on documents by their numbers of
distinct words, ``T(df(t)) * L ** a / a!`` of the ``T(df(t))`` words with that frequency would meet e
in ``a`` different texts, ``L = df(t) *`` (share of all distinct words that lie in e's documents);
that number must be at most ``CHANCE``. So a plain rare word in a document of a rare entity doesn't
pass, and a word that does pass may have met an entity seen once. Every occurrence of such a term in
the documents that hold e is removed from ``REMOVE`` on and generalised to its word class from
``GENERALISE`` on: documents without personal data stay as they are.

Scale: words are counted once per document with partial aggregation; only words rare enough for a
share of ``GENERALISE`` meet entities; they are broadcast behind a check of their number, beyond it
joined.

Defined results: null text is empty; rows that repeat id and text get equal spans; a null id is a
document like any other; an empty table gives an empty result. Positions are code points, end
exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import staged

#: kinds in their fixed order with their matching forms (fixed values)
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
NO_WORD = r"[^\p{L}\p{N}]+"
CHANCE = 0.05
GENERALISE, REMOVE = 0.7, 0.9
BROADCAST_ROWS = 200_000
SPAN = "array<struct<start:int,kind:int,end:int,value:string,label:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        d = F.reverse(_digits(value))
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(
            i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                                     F.substr(d, i, F.lit(1)).cast("int") + 1)).otherwise(F.substr(d, i, F.lit(1)).cast("int")))
        return total % 10 == 0
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,value>> of all matches: lengths of the pieces between them, summed up."""
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["s"])
        end = begin + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(
            F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("value")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _of_kind(text: Column, i: int, kind: str, pattern: str) -> Column:
    ok = F.filter(_located(text, pattern), lambda s: _passes(kind, s["value"]))
    shaped = F.transform(ok, lambda s: F.struct(
        s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
        F.lit(f"[{kind.upper()}]").alias("label")))
    return F.when(text.rlike(pattern), shaped.cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans that pass, by start, then kind."""
    return F.array_sort(F.concat(*[_of_kind(text, i, k, p) for i, (k, p) in enumerate(PATTERNS.items())]))


def _entity(span: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["kind"] + 1)
    value = F.when(span["kind"].isin(2, 3), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(kind, F.lit(":"), value)


def _replaced(text: Column, spans: Column, label) -> Column:
    """The text with every span replaced by its label; spans that overlap become one gap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), label(s))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))


def _words(text: Column) -> Column:
    """The distinct words of a text that have a letter."""
    return F.filter(F.array_distinct(F.split(text, NO_WORD)), lambda w: w.rlike(r"\p{L}"))


def disclosing_words(docs: DataFrame, hits: DataFrame, n_docs: int) -> DataFrame:
    """(llm_key, word, share): words of a document that disclose one of its entities, as they are written there."""
    own = hits.select("llm_key", F.xxhash64("llm_text").alias("text_hash"), F.size(_words(F.lower("llm_text"))).alias("size"),
                      F.explode(F.array_distinct(F.transform("llm_base", _entity))).alias("entity"))
    own = staged(own, "pii-entities")
    seen = own.groupBy("entity").agg(F.count("*").alias("df_e"), F.sum("size").alias("mass")).filter(F.col("df_e") < n_docs)
    seen = staged(seen, "pii-seen")
    most = seen.agg(F.max("df_e")).first()[0]
    none = hits.select("llm_key", F.lit("").alias("word"), F.lit(0.0).alias("share")).limit(0)
    if most is None:
        return none
    df_t = staged(docs.select(F.explode_outer(_words(F.lower("llm_text"))).alias("term")).filter(F.col("term").isNotNull())
                  .groupBy("term").agg(F.count("*").alias("df_t")), "pii-terms")
    total = df_t.agg(F.sum("df_t")).first()[0]
    if not total:
        return none
    # PMI is at most log2(N / df(t)), so more frequent words can't reach the share
    most_t = lambda df_e: F.pow(F.lit(float(n_docs)), F.lit(1 - GENERALISE)) * F.pow(df_e, F.lit(GENERALISE)) * (1 + 1e-9)
    # d different frequencies add up to at least d^2 / 2, so they are at most the root of twice the words
    alike = F.broadcast(df_t.groupBy("df_t").agg(F.count("*").alias("alike")))
    rare = staged(df_t.filter(F.col("df_t") <= most_t(F.lit(float(most)))).join(alike, "df_t"), "pii-rare")
    if rare.count() <= BROADCAST_ROWS:
        rare = F.broadcast(rare)
    outside = _replaced(F.col("llm_text"), F.col("llm_base"), lambda s: F.lit(" "))
    words = (hits.select("llm_key", "llm_text", F.explode_outer(_words(outside)).alias("word"))
             .select("llm_key", "word", F.lower("word").alias("term")).join(rare, "term"))
    words = staged(words.distinct(), "pii-words")
    entities = own.join(seen, "entity")
    met = (words.select("llm_key", "term", "df_t", "alike").distinct().join(entities, "llm_key")
           .filter(F.col("df_t") <= most_t(F.col("df_e"))))
    pairs = met.groupBy("entity", "term").agg(
        F.count("*").alias("df_et"), F.countDistinct("text_hash").alias("texts"),
        *[F.first(c).alias(c) for c in ("df_e", "mass", "df_t", "alike")])
    ic = F.log2(F.lit(float(n_docs)) / F.col("df_e"))
    pmi = F.log2(F.col("df_et") * F.lit(float(n_docs)) / (F.col("df_e") * F.col("df_t")))
    expected = F.log(F.col("alike")) + F.col("texts") * F.log(F.col("df_t") * F.col("mass") / F.lit(float(total)))
    # log of a! by Stirling's lower bound, so chance is never counted too low
    a = F.col("texts").cast("double")
    chance = expected - (a * F.log(a) - a + 0.5 * F.log(2 * math.pi * a))
    shares = pairs.filter(chance <= math.log(CHANCE)).select("entity", "term", (pmi / ic).alias("share"))
    shares = staged(shares.filter(F.col("share") >= GENERALISE), "pii-shares")
    return (own.select("llm_key", "entity").distinct().join(shares, "entity").groupBy("llm_key", "term").agg(F.max("share").alias("share"))
            .join(words, ["llm_key", "term"]).select("llm_key", "word", "share"))


def spans_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``llm_base`` and ``llm_extra`` arrays of spans and ``llm_text`` (the text, never null)."""
    docs = docs.withColumn("llm_text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("llm_text")
    hit = text.rlike("|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "card", "phone"))) | text.rlike(PATTERNS["email"])
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text), 256)
    hits = staged(docs.filter(hit).withColumn("llm_base", base_spans(text)).withColumn("llm_key", key), "pii-hits")
    word_class = F.when(F.col("word").rlike(r"\p{N}"), "[CODE]").when(F.col("word").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    label = F.when(F.col("share") >= REMOVE, F.lit("")).otherwise(word_class)
    found = (disclosing_words(docs, hits, docs.count()).groupBy("llm_key")
             .agg(F.map_from_entries(F.collect_list(F.struct("word", label.alias("label")))).alias("llm_labels")))
    # words are letters and digits only, so they stand for themselves in a pattern
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys("llm_labels"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    free = F.filter(_located(text, pattern), lambda w: ~F.exists("llm_base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    extra = F.transform(free, lambda w: F.struct(w["start"].alias("start"), F.lit(4).alias("kind"), w["end"].alias("end"),
                                                 w["value"].alias("value"), F.element_at("llm_labels", w["value"]).alias("label"))).cast(SPAN)
    none = F.array().cast(SPAN)
    with_hits = (hits.join(found, "llm_key", "left")
                 .withColumn("llm_extra", F.when(F.col("llm_labels").isNotNull(), extra).otherwise(none)).drop("llm_key", "llm_labels"))
    without = docs.filter(~hit).withColumn("llm_base", none).withColumn("llm_extra", none)
    return with_hits.unionByName(without)


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans() -> Column:
    return F.array_sort(F.concat("llm_base", "llm_extra"))


def sanitised() -> Column:
    """The text with every span replaced by its label."""
    text = F.col("llm_text")
    return F.when(F.size(F.concat("llm_base", "llm_extra")) == 0, text).otherwise(_replaced(text, all_spans(), lambda s: s["label"]))


def report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every document."""
    def n_of(i: int) -> Column:
        return F.size(F.filter("llm_base", lambda s: s["kind"] == i)).cast("long")

    return spans_of(docs.select("doc_id", "text")).select(
        "doc_id", *[n_of(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)], F.sha2(_written(F.col("llm_base")), 256).alias("base_sha256"),
        _written(all_spans()).alias("spans"), F.size("llm_extra").cast("long").alias("n_term"))


def sanitise_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every text with its personal data and disclosing terms replaced.

    ``n_chars`` follows the new text where the table has it; null texts stay null.
    """
    columns = docs.columns
    out = spans_of(docs).withColumn("llm_new", F.when(F.col("text").isNotNull(), sanitised()))
    if "n_chars" in columns:
        same = F.size(F.concat("llm_base", "llm_extra")) == 0
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("llm_new")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("llm_new")).select(*columns)
