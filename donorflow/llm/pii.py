"""Personal data by pattern, and terms that disclose it by corpus co-occurrence. Built of DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.llm.common import WORD, checkpointed, packed, small, unpacked

# Kinds in the order of ties. The patterns equal the plain ones in what they match; possessive repeats and look-behinds only
# keep them from trying the same characters again, so that long texts without a match take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "phone": "+"}  # a text without its mark can't match
KINDS = list(PATTERNS)
SPAN = "array<struct<start:int,ord:int,kind:string,stop:int>>"
COVERED = "\ue000base-5d1c27f94be83a06\ue000"  # stands for a base span while words are cut; no text holds it
SEPARATORS = r"[\x20\x09-\x0D]+"


def _luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits ends in its check digit."""
    back = F.reverse(digits)

    def added(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(back, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), added)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(found, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int") <= 255).otherwise(False))
    digits = F.regexp_replace(found, "[^0-9]", "")
    return _luhn(digits) if kind == "card" else F.length(digits).between(9, 15)


def _is_valid(kind: str):
    return lambda x: _valid(kind, x["m"])


def _entity(kind: str, found: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(found) if kind == "email" else F.regexp_replace(found, "[^0-9]", ""))


def _places(matches: Column, gaps: Column) -> Column:
    """Start and stop of each match, counted through the gaps between matches."""

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.element_at(gaps, i))
        stop = start + F.length(F.element_at(matches, i))
        return F.struct(stop.alias("at"), F.array_append(state["places"], F.struct(start.alias("start"), stop.alias("stop"))).alias("places"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("places"))
    return F.aggregate(F.sequence(F.lit(1), F.size(matches)), empty, step, lambda s: s["places"])


def with_matches(rows: DataFrame, text: str = "text") -> DataFrame:
    """Columns m_<kind>: matches, leftmost and not overlapping, valid or not."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = {k: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    none = F.array().cast("array<string>")
    return rows.withColumns({f"m_{k}": F.when(F.contains(t, F.lit(MARKS[k])), e).otherwise(none) if k in MARKS else e for k, e in found.items()})


def any_match() -> Column:
    total = F.lit(0)
    for k in KINDS:
        total = total + F.size(f"m_{k}")
    return total > 0


def base_spans(text: str = "text") -> Column:
    """Valid matches of all kinds as spans, by start and then kind. Reads the columns of with_matches."""
    spans = []
    for i, kind in enumerate(KINDS):
        matches = F.col(f"m_{kind}")
        places = _places(matches, F.split(F.col(text), PATTERNS[kind], -1))
        spans.append(F.when(F.size(matches) > 0, F.transform(
            F.filter(F.zip_with(places, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), _is_valid(kind)), _as_span(kind, i),
        )).otherwise(F.array()).cast(SPAN))
    return F.array_sort(F.concat(*spans))


def _as_span(kind: str, number: int):
    return lambda x: F.struct(x["p"]["start"].alias("start"), F.lit(number).alias("ord"), F.lit(kind).alias("kind"), x["p"]["stop"].alias("stop"))


def entities() -> Column:
    """The distinct values of the valid matches. Reads the columns of with_matches."""
    values = []
    for kind in KINDS:
        valid = F.filter(F.col(f"m_{kind}"), lambda m: _valid(kind, m))
        values.append(F.transform(valid, lambda m: _entity(kind, m)))
    return F.array_distinct(F.concat(*values))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), lambda w: w != ""))


def contexts(hits: DataFrame) -> DataFrame:
    """(did, th, entities, words, covered) of texts with `base_spans`: distinct words that stand free of these, and the other words."""
    found = hits.filter(F.size("base_spans") > 0)
    free = F.filter(words_of(redacted("text", F.col("base_spans"), COVERED)), lambda w: ~F.contains(w, F.lit(COVERED)))
    found = found.select("did", "th", "text", entities().alias("entities"), free.alias("words"))
    return found.select("did", "th", "entities", "words", F.array_except(words_of(F.col("text")), F.col("words")).alias("covered"))


def term_counts(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(term, with_term): documents that hold the term free of base spans."""
    again = checkpointed(rows.groupBy("did").count().filter("count > 1").select("did"))
    few = again.count()
    every = rows.select("did", "th", words_of(F.col("text")).alias("w"), F.lit(1).alias("n"))
    every = every.unionByName(near.select("did", "th", F.col("covered").alias("w"), F.lit(-1).alias("n")))
    lone = every.join(small(again, few), "did", "left_anti") if few else every
    counts = lone.select(F.explode("w").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("with_term"))
    if few:  # rows of one document count once
        rest = every.join(small(again, few), "did").select("did", "th", F.explode("w").alias("term"), "n").distinct()
        rest = rest.groupBy("did", "th", "term").agg(F.sum("n").alias("n")).filter("n > 0").select("did", "term").distinct()
        counts = counts.unionByName(rest.groupBy("term").agg(F.count(F.lit(1)).alias("with_term")))
        counts = counts.groupBy("term").agg(F.sum("with_term").alias("with_term"))
    return counts


def disclosing_terms(rows: DataFrame, near: DataFrame, documents: int, support: int, generalise: float, remove: float) -> DataFrame:
    """(entity, term, removed): terms that reveal an entity. rows: (did, th, text) of all documents; near: of contexts().

    A term's disclosure is the share of the entity's information that it carries, PMI(term; entity) / IC(entity), over
    documents of the whole corpus. Pairs seen in fewer than `support` different texts are no evidence, so only entities in
    as many texts meet the words of their texts.
    """
    held = near.select("did", "th", F.explode("entities").alias("entity"))
    known = held.groupBy("entity").agg(F.countDistinct("did").alias("with_entity"), F.countDistinct("th").alias("texts")).filter(F.col("texts") >= support)
    known = checkpointed(known.drop("texts"))
    met = near.select("did", "th", "words", F.explode("entities").alias("entity")).join(small(known, known.count()), "entity")
    pairs = met.select("did", "th", "entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.countDistinct("did").alias("both"), F.countDistinct("th").alias("texts"))
    pairs = checkpointed(pairs.filter(F.col("texts") >= support))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(True).alias("removed"))
    weighed = pairs.join(known, "entity").join(term_counts(rows, near), "term")
    ic = F.log2(F.lit(float(documents)) / F.col("with_entity"))
    pmi = F.log2(F.lit(float(documents)) * F.col("both") / (F.col("with_term").cast("double") * F.col("with_entity")))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    return weighed.select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("removed"))


def term_spans(text: str, terms: str, kind: str) -> Column:
    """Spans of whole words among the array column `terms`."""
    quoted = F.concat_ws("|", F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))))
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), quoted, F.lit(r")(?![^\x20\x09-\x0D])"))
    matches = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    places = F.when(F.size(matches) > 0, _places(matches, F.split(F.col(text), pattern, F.lit(-1)))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    spans = F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(len(KINDS) + (kind == "removed")).alias("ord"), F.lit(kind).alias("kind"), p["stop"].alias("stop")))
    return F.when(F.size(terms) > 0, spans).otherwise(F.array()).cast(SPAN)


def redacted(text: str, spans: Column | str, instead: str | None = None) -> Column:
    """The text with each span replaced by its kind in brackets, removed terms by nothing, or each by `instead`; of overlapping spans the first names the kind."""

    def step(state: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        mark = mark if instead is None else F.lit(instead)
        fresh = F.concat(state["out"], F.substr(F.col(text), state["at"] + 1, s["start"] - state["at"]), mark)
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substr(F.col(text), s["at"] + 1, F.length(text))))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def sanitise(
    docs: DataFrame, text: str = "text", key: str = "doc_id", support: int = 3, generalise: float = 0.8, remove: float = 0.95,
) -> DataFrame:
    """Every input row with `base_spans`, `term_spans` (start, ord, kind, stop; in characters) and `sanitised`, the text without them.

    Base spans are emails, addresses, cards and phone numbers. Words anywhere in the same texts, free of base spans, that occur
    with the same value in at least `support` different texts are weighed by the co-occurrence of the whole corpus; those that
    carry at least `generalise` of a value's information become a general mark, those that carry `remove` of it go, in every
    text that holds the value.

    Null texts stay null and have no spans; repeated rows are treated alike, and count as one document if their ids are
    equal (a null id: if their texts are); no rows: no rows. Input columns of our names are replaced. Only texts with a match
    meet the terms by a shuffle; pairs number the distinct words of a text for each value in it that `support` texts hold.
    """
    rows = packed(docs, text=F.col(text), id=F.col(key)).withColumn("th", F.xxhash64("text"))
    rows = rows.withColumn("did", F.when(F.col("id").isNull(), F.col("th")).otherwise(F.xxhash64("id")))
    documents = rows.agg(F.countDistinct("did")).first()[0]
    light = with_matches(rows.select("did", "th", "text"))
    near = checkpointed(contexts(light.filter(any_match()).withColumn("base_spans", base_spans())))
    terms = disclosing_terms(rows.select("did", "th", "text"), near, documents, support, generalise, remove)
    terms = checkpointed(terms.groupBy("entity").agg(
        F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"), F.collect_set(F.when(~F.col("removed"), F.col("term"))).alias("general")))
    mine = near.select("th", "words", F.explode("entities").alias("entity")).join(small(terms, terms.count()), "entity")
    mine = mine.select("th", *[F.array_intersect("words", c).alias(c) for c in ("gone", "general")]).groupBy("th").agg(
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("gone", "general")])
    matched = with_matches(rows)
    none = F.array().cast(SPAN)
    plain = matched.filter(~any_match()).select("row", none.alias("base_spans"), none.alias("term_spans"), F.col("text").alias("sanitised"))
    hits = matched.filter(any_match()).withColumn("base_spans", base_spans()).drop(*[f"m_{k}" for k in KINDS])
    hits = hits.join(mine, "th", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("gone", "general")})
    hits = hits.withColumn("general", F.array_except("general", "gone"))
    hits = hits.withColumn("term_spans", F.concat(term_spans("text", "general", "term"), term_spans("text", "gone", "removed")))
    clear = lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    hits = hits.withColumn("term_spans", F.array_sort(F.filter("term_spans", clear)))
    hits = hits.withColumn("every", F.array_sort(F.concat("base_spans", "term_spans")))
    hits = hits.select("row", "base_spans", "term_spans", redacted("text", "every").alias("sanitised"))
    return unpacked(plain.unionByName(hits), "base_spans", "term_spans", "sanitised")
