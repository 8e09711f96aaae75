"""Personal data and the terms that give it away (operator 2, DataFrame functions only).

Base spans are found by pattern, leftmost and not overlapping within a kind, and checked (parts of an
address, Luhn, number of digits); what fails is dropped. Protected entities are the values of the
base spans. A term is a word of any length outside them, anywhere in the text. Over all
documents, the information a term gives on an entity is their pointwise mutual
information, ``log(N n_ct / (n_c n_t))``; the entity's own information content is
``log(N / n_c)``. A term that gives ``share`` of it or more, seen with the entity in
``support`` documents at least, discloses the entity; wherever it stands, in any document, it is a span of kind ``term``. Counts
cover the whole corpus and are pre-aggregated before any shuffle; the shuffle of term counts carries distinct terms of
a task, not words. Pairs are only counted where the term's and the entity's own counts allow that it discloses it:
``support <= n_t <= N (n_c / N) ** share``, which follows from ``n_ct <= n_c``.

Null and empty texts have no spans. Texts are searched whole, with patterns linear in the text. Repeated rows are
documents of their own. The result carries the id and what is found, so other columns don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.rows import text_of
from holdfast.storage import spread, written

#: The kinds in their order, each with its pattern. Possessive forms of the contract's patterns; a match
#: starts at the start of its run of characters or where the last match ended, as any other start in the run fails likewise.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}+"
NOTHING = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, wanted=None) -> Column:
    """All matches in order, or those whose value is ``wanted``: start and end in code points, and the value."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    leads = F.slice(F.split(text, pattern, -1), 1, F.size(hits))  # what stands before each hit
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NOTHING).alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["lead"])
        end = begin + F.length(x["hit"])
        more = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("value"))))
        out = more if wanted is None else F.when(wanted(x["hit"]), more).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    both = F.zip_with(hits, leads, lambda hit, lead: F.struct(hit.alias("hit"), lead.alias("lead")))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def worth(i):
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def good(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits(value)).between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _checked(found: Column, kind: str, rank: int) -> Column:
    held = F.filter(found, lambda m: good(kind, m["value"]))
    return F.transform(held, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end, kind, value) by start, then kind."""
    signs = {"email": "@", "ip": ".", "phone": "+"}
    all_kinds = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        there = F.contains(text, F.lit(signs[kind])) if kind in signs else F.lit(True)
        there = there if kind == "email" else there & text.rlike("[0-9]")
        found = F.when(there, matches(text, pattern)).otherwise(F.array().cast(NOTHING))
        all_kinds.append(_checked(found, kind, rank))
    return F.array_sort(F.concat(*all_kinds))


def outside(text: Column) -> Column:
    """The text with blanks in place of e-mail addresses, the only base spans that hold letters."""
    hits = F.regexp_extract_all(text, F.lit(f"({PATTERNS['email']})"), F.lit(0))
    parts = F.zip_with(F.split(text, PATTERNS["email"], -1), hits, lambda lead, hit: F.concat(
        lead, F.repeat(F.lit(" "), F.coalesce(F.length(hit), F.lit(0)))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(parts, "")).otherwise(text)


def words(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    found = F.array_distinct(F.regexp_extract_all(outside(text), F.lit(f"({TERM})"), F.lit(0)))
    return F.array_distinct(F.transform(found, F.lower))


def disclosing(found: DataFrame, texts: DataFrame, share: float, support: int) -> DataFrame:
    """Terms that disclose an entity. found: key, base and words of the texts with base spans; texts: all texts."""
    names = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
    held = written(found.where(F.size("base") > 0).select("key", names.alias("entities"), "words").groupBy("key").agg(
        F.first("entities").alias("entities"), F.first("words").alias("words"), F.count("*").alias("copies")), "held-texts")
    total = found.agg(F.count("*").alias("n"))  # one row
    most = F.col("n") * F.pow(F.col("n_c") / F.col("n"), F.lit(share)) * (1 + 1e-9)
    entities = written(held.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(F.sum("copies").alias("n_c"))
                       .where(F.col("n_c") >= support).join(F.broadcast(total)).withColumn("most", most), "entities")
    counts = texts.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    highest = entities.agg(F.max("most").alias("highest"))  # one row; null, so no terms, without entities
    terms = counts.where(F.col("n_t") >= support).join(F.broadcast(highest), F.col("n_t") <= F.col("highest")).select("term", "n_t")
    asked = held.select("key", F.explode("entities").alias("entity")).join(entities, "entity") \
        .groupBy("key").agg(F.collect_list(F.struct("entity", "n", "n_c", "most")).alias("asked"))
    rare = held.join(asked.select("key"), "key", "left_semi").select("key", "copies", F.explode("words").alias("term")).join(terms, "term") \
        .groupBy("key", "copies").agg(F.collect_list(F.struct("term", "n_t")).alias("rare"))
    pairs = asked.join(rare, "key").select("rare", "copies", F.inline("asked")) \
        .select("entity", "n", "n_c", "copies", F.inline(F.filter("rare", lambda t: t["n_t"] <= F.col("most")))) \
        .groupBy("entity", "n", "n_c", "term", "n_t").agg(F.sum("copies").alias("n_ct")).where(F.col("n_ct") >= support)
    pmi = F.log(F.col("n") * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    return pairs.where(pmi >= share * F.log(F.col("n") / F.col("n_c"))).select("term").distinct()


def find(docs: DataFrame, share: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key (of the text), base and spans (base and term spans), arrays by start, then kind."""
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    base = texts.select("doc_id", F.md5("text").alias("key"), "text", base_spans(F.col("text")).alias("base"))
    found = written(base.select(
        "doc_id", "key", "base", F.when(F.size("base") > 0, words(F.col("text"))).alias("words")), "base-spans")
    terms = written(disclosing(found, texts, share, support), "disclosing")
    keyed = texts.select(F.md5("text").alias("key"), "text")
    told = keyed.select("key", F.explode(words(F.col("text"))).alias("term")).join(terms, "term") \
        .groupBy("key").agg(F.collect_set("term").alias("terms"))
    once = keyed.join(told, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("terms").alias("terms"))
    places = matches(outside(F.col("text")), TERM, lambda word: F.array_contains("terms", F.lower(word)))
    term_spans = once.select("key", F.transform(places, lambda m: F.struct(
        m["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), m["end"].alias("end"), F.lit("term").alias("kind"),
        F.lower(m["value"]).alias("value"))).alias("terms"))
    empty = F.array().cast(found.schema["base"].dataType)
    return found.select("doc_id", "key", "base").join(term_spans, "key", "left").select(
        "doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("terms", empty))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by its kind: removed values, generalised terms."""
    reach = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"), lambda out, s: F.when(
        (F.size(out) > 0) & (s["start"] < F.element_at(out, F.when(F.size(out) > 0, -1).otherwise(1))["end"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
            F.element_at(out, -1)["start"].alias("start"),
            F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"),
            F.element_at(out, -1)["kind"].alias("kind"))))).otherwise(
        F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    parts = F.transform(reach, lambda s, i: F.concat(
        F.substring(text, F.when(i > 0, F.get(reach, i - 1)["end"]).otherwise(0) + 1,
                    s["start"] - F.when(i > 0, F.get(reach, i - 1)["end"]).otherwise(0)),
        F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.element_at(reach, -1)["end"]
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text))))
