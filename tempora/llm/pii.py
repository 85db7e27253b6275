"""Personal data: patterns find it, and what the corpus says about the words around it decides which of
those give it away. Built-in functions only; no Python runs on rows.

A protected entity is the value of an e-mail address, IP address, card or phone number. A term is a word
with a letter in it, up to ``WINDOW`` words before or after an entity; its general form is ``abc*`` for a
term of six letters or more. With document counts n, a term t leaves ``-log2 p(e|t) = IC(e) - PMI(e;t)``
bits of uncertainty about entity e, where p(e|t) = n(e, t) / n(t). It discloses e if at most
``RESIDUAL_BITS`` are left, if it tells ``GAIN_BITS`` about e at least (PMI), and if that rests on
``SUPPORT`` documents with two different texts or more. A disclosing term is replaced by its general form
where that doesn't disclose e, else removed, in all places of the documents in which it stands near e.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, materialize

WINDOW, RESIDUAL_BITS, GAIN_BITS, SUPPORT = 10, 1.0, 3.0, 3
#: Rows of one text, or of one entity and term, are dealt to this many groups where they meet others.
SALTS = 16
_CHUNK = 32

#: Possessive forms and lookbehinds give the leftmost matches in linear time: a run of characters is
#: tried from its start only, or from where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: What a text with any entity has.
_LIKELY = r"[0-9](?:\.[0-9]|(?:[\x20-]?[0-9]){12})"
TERM = r"(?<![0-9])[0-9]*+[A-Za-z\x{80}-\x{10FFFF}][0-9A-Za-z\x{80}-\x{10FFFF}]*+"

_SEP = "\x01"
SPANS = "array<struct<start:int,end:int,value:string>>"
TERMS = "array<struct<term:string,general:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` names it more than once."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places in code points, in time linear in the text: lengths of
    matches and of what lies between them are added up, chunk by chunk."""
    step = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("gap"), F.coalesce(F.length(v), F.lit(0)).alias("n")))

    def placed(chunk: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            return F.struct((start + x["n"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["v"].alias("value"))).alias("out"))

        return F.aggregate(chunk, zero, add)["out"]

    def all_of(chunks: Column) -> Column:
        sums = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["n"])))
        return F.flatten(F.filter(F.zip_with(chunks, sums, placed), lambda x: x.isNotNull()))

    cut = let(step, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _CHUNK).cast("int")), lambda c: F.slice(z, c * _CHUNK + 1, _CHUNK)))
    return F.filter(let(cut, all_of), lambda x: x["value"].isNotNull())


def is_likely(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("@")) | F.contains(text, F.lit("+")) | text.rlike(_LIKELY), F.lit(False))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_valid(kind: str, value: Column) -> Column:
    """Does a match of the kind's pattern pass its check?"""
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "card":
        twice = F.transform(F.split(F.reverse(digits(value)), ""), lambda d, i: d.cast("int") * (1 + i % 2))
        return F.aggregate(twice, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid spans of a kind in order, as start, end and value; none for null."""
    likely = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    has = F.contains(text, F.lit(likely)) if likely else text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    return F.when(has, F.filter(spans_of(text, PATTERNS[kind]), lambda x: is_valid(kind, x["value"]))).otherwise(F.array().cast(SPANS))


def without_emails(text: Column) -> Column:
    """The text with a blank for each character of an e-mail address."""
    pattern = PATTERNS["email"]
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.array(g, F.repeat(F.lit(" "), F.length(v))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(F.flatten(parts), "")).otherwise(text)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def general(term: Column) -> Column:
    """The general form of a term, null if it has none."""
    return F.when(F.length(term) >= 6, F.concat(F.left(term, F.lit(3)), F.lit("*")))


def _features(words: Column) -> Column:
    """Lower-cased words and general forms, each once."""
    return let(F.transform(F.array_distinct(words), lower_ascii), lambda w: F.array_distinct(F.concat(w, F.filter(F.transform(w, general), lambda g: g.isNotNull()))))


def _evidence(text: Column, kind: str) -> Column:
    """Entity and feature of a text, joined by ``_SEP``: each entity with an empty feature and with those
    around it."""
    pattern = PATTERNS[kind]
    edges = F.transform(F.split(text, pattern, -1), lambda g: let(_words(g), lambda w: F.struct(
        F.slice(w, F.lit(1), F.lit(WINDOW)).alias("first"), F.slice(w, F.greatest(F.size(w) - (WINDOW - 1), F.lit(1)), F.lit(WINDOW)).alias("last"))))
    found = let(edges, lambda g: F.zip_with(
        F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), g, lambda v, a: F.struct(v.alias("v"), a["last"].alias("near"))),
        F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), lambda x, b: F.struct(x["v"].alias("v"), F.concat(x["near"], b["first"]).alias("near"))))
    good = F.filter(found, lambda x: x["v"].isNotNull() & is_valid(kind, x["v"]))
    value = lower_ascii if kind in ("email", "ip") else digits
    pairs = F.transform(good, lambda x: let(F.concat(F.lit(f"{kind}:"), value(x["v"])), lambda e: F.transform(
        F.concat(F.array(F.lit("")), _features(x["near"])), lambda f: F.concat(e, F.lit(_SEP), f))))
    return F.flatten(pairs)


def disclosing(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``h, terms``: for the md5 of each text with terms that disclose one of its entities, these in
    order, with the general form to put in their place or null where they are to go.

    Counts are over all rows of ``docs`` (text); copies count as documents, but copies of one text alone
    are no evidence. Frequent words are compared once with the entity that they tell most about.
    """
    likely = docs.select("text").where(is_likely(F.col("text"))).select(F.md5(F.col("text").cast("binary")).alias("h"), "text", without_emails(F.col("text")).alias("t"))
    pairs = F.array_distinct(F.concat(*[_evidence(F.col("text" if k == "email" else "t"), k) for k in KINDS]))
    near = scratch(likely.select("h", F.explode(pairs).alias("p")).select("h", F.substring_index("p", _SEP, 1).alias("e"), F.substring_index("p", _SEP, -1).alias("f")), "near")
    both = scratch(near.groupBy("e", "f").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most")), "both")
    often = both.where((F.col("f") != "") & (F.col("n") >= SUPPORT) & (F.col("least") < F.col("most"))).select("e", "f", "n")
    words = docs.select(F.explode(_features(_words(F.col("text")))).alias("f"))
    counts = words.groupBy("f").agg(F.count("*").alias("nf"))
    telling = often.groupBy("f").agg(F.max("n").alias("most")).join(counts, "f").where(F.col("most") * 2**RESIDUAL_BITS >= F.col("nf")).select("f", "nf")
    entities = both.where("f = ''").select("e", F.col("n").alias("ne"))
    pmi = F.log2(F.col("n") * F.lit(docs.count()) / (F.col("ne") * F.col("nf")))
    shown = scratch(
        often.join(telling, "f").where(F.col("n") * 2**RESIDUAL_BITS >= F.col("nf")).join(entities, "e").where(pmi >= GAIN_BITS).select("e", "f"), "shown")
    forms = shown.where("f like '%*'").select("e", F.col("f").alias("g"), F.lit(True).alias("known"))
    terms = shown.where("f not like '%*'").withColumn("g", general(F.col("f"))).join(forms, ["e", "g"], "left").select("e", "f", F.when(F.col("known").isNull(), F.col("g")).alias("g"))
    salt = F.pmod(F.xxhash64("h"), F.lit(SALTS))
    salted = terms.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = near.where("f <> ''").withColumn("s", salt).join(salted, ["e", "f", "s"]).select("h", "f", "g")
    # a term that two entities of a text share goes where it must go for either
    return met.groupBy("h", "f").agg(F.when(F.count("*") == F.count("g"), F.min("g")).alias("g")).groupBy("h").agg(
        F.array_sort(F.collect_list(F.struct(F.col("f").alias("term"), F.col("g").alias("general")))).cast(TERMS).alias("terms"))


def _looked_up(terms: Column, word: Column) -> Column:
    """The entry of a sorted list of terms for a word, or null, by halving."""
    at = F.aggregate(F.array(*[F.lit(1 << k) for k in range(23, -1, -1)]), F.lit(0), lambda i, step: F.when(F.get(terms, i + step - 1)["term"] <= word, i + step).otherwise(i))
    return let(F.get(terms, at - 1), lambda x: F.when(x["term"] == word, x))


def found(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, whatever else) with a struct ``found``: an array of base spans (start, end,
    value) for each kind, and ``term``: start, end and the general form, null for a term to remove.

    A null or empty text has none; rows that repeat are found alike; an empty table gives none. Columns
    keep their names, as all is in one struct; a column ``found`` is replaced. A text of any length takes
    linear time. Only texts that may hold an entity meet the table of terms; it is broadcast only where
    Spark knows it to be small.
    """
    base = docs.drop("found")
    with Scratch() as scratch:
        terms = materialize(disclosing(base, scratch), "terms")
    arrays = {k: F.array().cast(SPANS) for k in (*KINDS, "term")}
    likely = is_likely(F.col("text"))
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row")
    rest = base.where(~likely).select(row, F.struct(*[a.alias(k) for k, a in arrays.items()]).alias("found"))
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS)) if "doc_id" not in base.columns else F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = base.where(likely).select(row, F.col("text").alias("_t"), F.md5(F.col("text").cast("binary")).alias("h"), salt.alias("s"))
    met = some.join(terms.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "s"], "left")
    places = F.filter(F.transform(spans_of(lower_ascii(without_emails(F.col("_t"))), TERM), lambda x: let(_looked_up(F.col("terms"), x["value"]), lambda k: F.when(
        k.isNotNull(), F.struct(x["start"].alias("start"), x["end"].alias("end"), k["general"].alias("value"))))), lambda x: x.isNotNull())
    hidden = F.when(F.col("terms").isNull(), arrays["term"]).otherwise(places).cast(SPANS)
    out = met.select("row", F.struct(*[base_spans(F.col("_t"), k).alias(k) for k in KINDS], hidden.alias("term")).alias("found"))
    return out.unionByName(rest).select("row.*", "found")


def listed(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with the text in which ``[email]`` and so on stands for what was found, general forms for
    terms that have one and ``[removed]`` for the others. Where spans overlap, the first, and of those the
    longest, stands for all. Null stays null."""
    def parts_of(kind: str) -> Column:
        put = lambda x: F.coalesce(x["value"], F.lit("[removed]")) if kind == "term" else F.lit(f"[{kind}]")
        return F.transform(F.col("found")[kind], lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), put(x).alias("put")))

    parts = [parts_of(k) for k in (*KINDS, "term")]
    # a span is left out if one that starts no later reaches beyond its start
    chars = F.split("text", "")
    edges = F.array_sort(F.concat(*parts))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int,put:string>>").alias("out"))
    steps = F.aggregate(edges, zero, lambda a, x: F.when(x["start"] >= a["at"], F.struct((-x["less"]).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("from"), x["start"].alias("to"), x["put"].alias("put"))).alias("out"))).otherwise(
        F.struct(F.greatest(a["at"], -x["less"]).alias("at"), a["out"].alias("out"))))
    text = let(F.struct(chars.alias("c"), steps.alias("s")), lambda v: F.concat(
        F.array_join(F.flatten(F.transform(v["s"]["out"], lambda o: F.array_append(F.slice(v["c"], o["from"] + 1, o["to"] - o["from"]), o["put"]))), ""),
        F.array_join(F.slice(v["c"], v["s"]["at"] + 1, F.size(v["c"])), "")))
    none = F.aggregate(F.array(*[F.size(F.col("found")[k]) for k in (*KINDS, "term")]), F.lit(0), lambda a, b: a + b) == 0
    return found(docs).withColumn("text", F.when(none, F.col("text")).otherwise(text)).drop("found")
