"""Personal data: fixed patterns, and terms that disclose the found entities by corpus co-occurrence.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch, let, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  Possessive repeats and a left boundary give the same matches as the plain ones in linear time: no part
#: of an address can be followed by what its own repeat takes, and a start within a run fails where the run's own start does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
#: A term is generalised from this share of an entity's information on, removed from the other, or if none of its
#: beginnings tells less.
GENERALISE, REMOVE = 0.8, 0.95
#: Documents' worth of the corpus mixed into what is counted of an entity: few documents then tell less than many.
PRIOR = 1.0

_SPANS = "array<struct<start:int,end:int,value:string>>"
_TERMS = "array<struct<start:int,end:int,term:string,disclosure:double,general:string>>"
#: Letters kept of a generalised term: the most for which the beginning is common enough.
BEGINNINGS = (4, 3, 2, 1)


#: Elements of a block of running().
BLOCK = 256


def running(steps: Column, block: int = BLOCK) -> Column:
    """For each element of an int array the sum of those before it.

    A fold that collects copies what it has at every step, so the sums are taken within blocks and then over the blocks.
    """

    def ahead(x: Column) -> Column:  # one element more than x: its sum
        return F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    def summed(own: Column) -> Column:
        before = ahead(F.transform(own, lambda x: F.element_at(x, -1)))
        return let(before, lambda at: F.flatten(F.transform(own, lambda x, k: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + F.get(at, k)))))

    def blocks(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(x) - 1, F.lit(block))
        return let(F.transform(starts, lambda i: ahead(F.slice(x, i + 1, block))), summed)

    return let(steps, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(F.array().cast("array<int>")))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches in text, in code points from 0, end exclusive."""

    def placed(found: Column) -> Column:
        def spans(gaps: Column, before: Column) -> Column:
            start = lambda i: F.get(before, i) + F.length(F.get(gaps, i))
            return F.transform(found, lambda f, i: F.struct(start(i).alias("start"), (start(i) + F.length(f)).alias("end"), f.alias("value")))

        def walked(gaps: Column) -> Column:
            return let(running(F.transform(found, lambda f, i: F.length(f) + F.length(F.get(gaps, i)))), lambda before: spans(gaps, before))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), walked)).otherwise(F.array().cast(_SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # leading zeros don't count; three digits fit an int
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind as listed, then start."""

    def of(kind: str, t: Column) -> Column:
        return F.transform(F.filter(match_spans(t, PATTERNS[kind]), lambda s: _valid(kind, s["value"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return let(text, lambda t: F.concat(F.when(F.contains(t, F.lit("@")), of("email", t)).otherwise(none), F.when(t.rlike("[0-9]"), F.concat(*(of(k, t) for k in KINDS[1:]))).otherwise(none)))


def terms_of(text: Column) -> Column:
    """The distinct terms of text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def occurrences(text: Column, told: Column, base: Column) -> Column:
    """array<struct<start, end, term, disclosure, general>>: every place of the terms of told that touches no span of base."""
    clear = lambda begin, end: ~F.exists(base, lambda b: (b["start"] < end) & (begin < b["end"]))

    def told_of(spans: Column, terms: Column) -> Column:
        def put(p: Column) -> Column:
            known = F.get(told, F.array_position(terms, F.lower(p["value"])).cast("int") - 1)
            return F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lower(p["value"]).alias("term"), known["disclosure"].alias("disclosure"), known["general"].alias("general"))

        return F.transform(F.filter(spans, lambda p: F.array_contains(terms, F.lower(p["value"])) & clear(p["start"], p["end"])), put)

    return let(F.transform(told, lambda x: x["term"]), lambda terms: told_of(match_spans(text, TERM), terms)).cast(_TERMS)


def disclosures(work: Scratch, found: DataFrame, docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, prior: float = PRIOR) -> DataFrame:
    """(row, term, disclosure, general): the terms of each row of found that disclose at least `generalise` of one of its
    entities, and what each may be generalised to.

    With document frequencies over all of docs: information of entity c is log2(N / df(c)), what term t tells of it is their
    pointwise mutual information log2(P(t | c) / P(t)), with P(t) = df(t) / N and P(t | c) = (df(c, t) + prior P(t)) /
    (df(c) + prior), t standing anywhere in df(c, t) of c's documents; disclosure is their ratio, at most 1.

    As P(t | c) is at most 1, only terms with df(t) <= N^(1 - generalise) df(c)^generalise can reach `generalise`; no others
    are paired.  Entities that stand in the same documents, told by two sums of hashes, have the same answer and are one.

    A term's generalisations are its beginnings.  One stands in as many documents as the commonest term that begins so, at
    least, so it tells at most log2(N / df) of an entity; `general` is the longest that stays under `generalise` for all
    entities of the row, null if none does.
    """
    n = float(docs.count())
    entities = found.select("row", F.explode(F.array_distinct(F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))).alias("x")).select("row", "x.*")
    places = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(20,0)"))
    entity = entities.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("df_c"), places(1).alias("a"), places(2).alias("b"))
    group = entities.join(entity.where(F.col("df_c") < n), ["kind", "value"]).select("row", "df_c", "a", "b").distinct()
    term = work.table(docs.select(F.explode(terms_of(text_of(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t")), "terms")
    held = found.select("row", F.explode(terms_of(F.col("text"))).alias("term")).join(term, "term")
    rare = F.col("df_t") <= F.pow(F.lit(n), 1 - generalise) * F.pow("df_c", F.lit(generalise)) * (1 + 1e-9)
    pairs = work.table(held.join(group, "row").where(rare), "pairs")
    share = F.col("df_t") / n
    told = F.log2((F.col("df_ct") + prior * share) / (F.col("df_c") + prior) / share) / F.log2(n / F.col("df_c"))
    pair = pairs.groupBy("df_c", "a", "b", "term", "df_t").agg(F.count(F.lit(1)).alias("df_ct")).withColumn("disclosure", F.least(F.lit(1.0), told))
    hit = pairs.join(pair.where(F.col("disclosure") >= generalise).select("df_c", "a", "b", "term", "disclosure"), ["df_c", "a", "b", "term"])
    told = work.table(hit.groupBy("row", "term").agg(F.max("disclosure").alias("disclosure")), "told")

    begins = lambda: F.explode(F.array_compact(F.array(*(F.when(F.length("term") > k, F.substring("term", 1, k)) for k in BEGINNINGS)))).alias("begin")
    common = term.select("df_t", begins()).groupBy("begin").agg(F.max("df_t").alias("df_b"))
    needs = told.join(group.groupBy("row").agg(F.max("df_c").alias("df_c")), "row").select("row", "term", "df_c", begins())
    fits = F.col("df_b") > F.pow(F.lit(n), 1 - generalise) * F.pow("df_c", F.lit(generalise)) * (1 + 1e-9)
    general = needs.join(common, "begin").where(fits).groupBy("row", "term").agg(F.max_by("begin", F.length("begin")).alias("general"))
    return told.join(general, ["row", "term"], "left")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, prior: float = PRIOR) -> DataFrame:
    """One row per row of docs: id, key, base (spans), terms (spans with their disclosure and generalisation).

    Base: email, ip, card and phone by fixed patterns.  Method: information-theoretic sanitisation.  Terms that disclose an
    entity, see disclosures(), are marked wherever they stand in each document that holds the entity.

    Defined results: a null text counts as empty and has no spans; an empty table gives no rows; repeated rows get the same
    answer each; an entity in every document tells nothing, so nothing discloses it; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("base", base_spans(F.col("text")))
    key = F.when(F.size("base") > 0, F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "text"), 256))
    held = F.when(F.size("base") > 0, F.col("text"))
    work = Scratch(docs.sparkSession, "pii")
    found = work.table(rows.select("id", key.alias("key"), "base", held.alias("text"), F.monotonically_increasing_id().alias("row")), "found")
    some, none_found = found.where("key is not null"), found.where("key is null")

    told = disclosures(work, some, docs, text_col, generalise, prior).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("term", "disclosure", "general"))).alias("told"))
    empty = F.array().cast(_TERMS)
    terms = F.when(F.col("told").isNull(), empty).otherwise(occurrences(F.col("text"), F.col("told"), F.col("base")))
    out = some.join(told, "row", "left").select("id", "key", "base", terms.alias("terms"))
    return work.result(out.unionByName(none_found.select("id", "key", "base", empty.alias("terms"))).withColumnRenamed("id", id_col))


def is_removed(term: Column, remove: float = REMOVE) -> Column:
    return (term["disclosure"] >= remove) | term["general"].isNull()


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE) -> DataFrame:
    """docs with base spans replaced by their kind, and disclosing terms by their generalisation (a beginning and a star), or
    by nothing from `remove` on and where no beginning will do.

    Defined results: null and empty texts stay as they are; repeated rows get the same answer each; an empty table gives no
    rows; other columns stay, whatever their names.
    """
    found = find_pii(docs, id_col, text_col).where(F.size("base") > 0).select("key", "base", "terms").dropDuplicates(["key"])
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_of(text_col)), 256)

    def rewritten(text: Column, base: Column, terms: Column) -> Column:
        marks = F.array_sort(F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")).alias("by"))),
            F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(is_removed(t, remove), "").otherwise(F.concat(t["general"], F.lit("*"))).alias("by"))),
        ))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda a, m: F.when(m["start"] >= a["at"], F.struct(m["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, m["start"] - a["at"]), m["by"]).alias("out"))).otherwise(F.struct(F.greatest(a["at"], m["end"]).alias("at"), a["out"].alias("out")))
        return let(F.aggregate(marks, zero, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    marked = docs.withColumn("__key", key).join(found.withColumnRenamed("key", "__key").withColumnRenamed("base", "__base").withColumnRenamed("terms", "__terms"), "__key", "left")
    text = F.when(F.col("__base").isNull(), F.col(text_col)).otherwise(rewritten(F.col(text_col), F.col("__base"), F.col("__terms")))
    return marked.withColumn(text_col, text).select(*docs.columns)


def listed(spans: Column, kind: Column | None = None) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"].cast("string"), s["end"].cast("string"))), ",")
