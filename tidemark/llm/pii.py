"""Personal data: base patterns, and terms that reveal a protected entity.

Base spans are the leftmost non-overlapping matches of each kind; matches that fail their kind's
check are dropped without another try.  Runs of letters with digits between them whose own entropy is
that of a key (SECRET_BITS) are spans of the kind ``secret``.  What these spans hold is protected, as entities
of three levels: the value, the group that it shares with others (mail domain, network, number
prefix), and the kind as such, i.e. that a text holds one.

A term t discloses an entity e of its document when the corpus says that it gives most of e's
information away: PMI(e; t) >= DISCLOSURE * IC(e), with IC(e) = log(N / df(e)) and PMI(e; t) =
log(N df(e, t) / (df(e) df(t))), and e and t occur together in at least SUPPORT different texts.
Its occurrences in documents that hold e, outside of protected spans, are spans of the kind
``term``.  Sanitised texts have each span generalised to its kind.

All counts are of documents, over all of them; a pair also needs SUPPORT different texts, so
copies of one text prove nothing.  Null and
empty texts have no spans.  Repeated rows get the same spans.  Offsets are code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import apart, cut, keyed

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.  Those of the contract, written without repeated groups where Java's would recurse.  A match
#: begins where its first run of characters does, or at the end of the match before: what fails from a run's
#: start fails from everywhere in it, and no place of a run is tried but the first.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
#: On a text whose blanks and hyphens before anything but a digit are masked.
CARD, MASKED = r"[0-9][\x20\-0-9]+", r"[\x20\-](?![0-9])"
PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_SOUND = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
TERM = r"[\p{L}]{4,}"
#: Candidates of secrets, and the bits that one has at least: its length times the entropy of its characters.
SECRET, SECRET_BITS = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+(?![A-Za-z0-9])", 64.0
#: Terms of pairs that are broadcast at most.
FEW = 1_000_000
#: Least number of different texts for a pair, and share of the entity's information that may not be given away.
SUPPORT, DISCLOSURE = 3, 0.9
SPAN = "struct<start:int,end:int,s:string>"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _placed(text: Column, pattern: str | Column) -> Column:
    """Matches of a pattern with their code point offsets: lengths of the pieces between them, added up.

    The pieces are taken in blocks of about the root of their number, first the blocks' lengths and
    then the pieces of each block, as an array that grows by one is copied each time.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    walk = F.zip_with(pieces, found, lambda gap, s: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(s), F.lit(0)).alias("n"), s.alias("s")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["n"]
        span = F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s"))
        return F.when(x["s"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    def spans_of(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def by_blocks(w: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(w))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(w), size), lambda i: F.slice(w, i, size))
        lengths = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["n"]))
        starts = lambda ls: F.aggregate(ls, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return _let(blocks, lambda bs: _let(starts(lengths(bs)), lambda at: F.flatten(F.zip_with(bs, F.slice(at, F.lit(1), F.size(bs)), spans_of))))

    return _let(walk, by_blocks)


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def base(text: Column) -> dict[str, Column]:
    """Arrays of sound spans (start, end, s) by kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def kind(gate: Column, placed: Column, sound) -> Column:
        return F.when(gate, F.filter(placed, sound)).otherwise(none)

    masked = F.regexp_replace(text, MASKED, "\u0001")
    number = F.regexp_like(text, F.lit("[0-9][0-9 \\-]{14}"))
    return {
        "email": kind(F.contains(text, F.lit("@")), _placed(text, EMAIL), lambda x: F.lit(True)),
        "ip": kind(F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), _placed(text, IP), lambda x: F.regexp_like(x["s"], F.lit(IP_SOUND))),
        "card": kind(number, _placed(masked, CARD), lambda x: F.when(F.length(_digits(x["s"])).between(16, 19), _luhn(_digits(x["s"]))).otherwise(False)),
        "phone": kind(F.contains(text, F.lit("+")), _placed(text, PHONE), lambda x: F.length(_digits(x["s"])).between(8, 15)),
    }


def _bits(s: Column) -> Column:
    """Length times the entropy of the characters, in bits."""
    n = F.length(s)
    times = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return n * F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda a, c: a - times(c) * F.log2(times(c)))


def _secrets(text: Column) -> Column:
    mixed = lambda s: F.regexp_like(s, F.lit("[0-9][A-Za-z]+[0-9]"))
    found = F.filter(_placed(text, SECRET), lambda x: mixed(x["s"]) & (_bits(x["s"]) >= SECRET_BITS))
    return F.when(F.regexp_like(text, F.lit("[A-Za-z0-9]{20}")), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans(documents: DataFrame) -> DataFrame:
    """__id, __th, doc_id, text and the protected spans by kind."""
    d = keyed(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return apart(d, **base(F.col("text")), secret=_secrets(F.col("text")))


def _holds_any() -> Column:
    return sum((F.size(k) for k in (*KINDS, "secret")), F.lit(0)) > 0


def _named(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def entities(found: DataFrame) -> DataFrame:
    """__id, __th, entity: what a document holds, at each level."""

    def levels(kind: str, value, group) -> Column:
        some = lambda *parts: F.concat(F.lit(f"{kind}:"), *parts)
        one = F.transform(kind, lambda x: F.array(some(F.lit("value:"), value(x["s"])), *([] if group is None else [some(F.lit("group:"), group(x["s"]))])))
        return F.when(F.size(kind) > 0, F.concat(F.flatten(one), F.array(F.lit(kind)))).otherwise(F.array().cast("array<string>"))

    every = F.concat(
        levels("email", F.lower, lambda s: F.lower(F.substring_index(s, "@", -1))),
        levels("ip", lambda s: s, lambda s: F.substring_index(s, ".", 2)),
        levels("card", _digits, lambda s: F.substring(_digits(s), 1, 6)),
        levels("phone", _digits, lambda s: F.substring(_digits(s), 1, 4)),
        levels("secret", lambda s: s, None),
    )
    return found.select("__id", "__th", F.explode(F.array_distinct(every)).alias("entity"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing(documents: DataFrame, found: DataFrame) -> DataFrame:
    """__th, terms: the disclosing terms of each text that has any; ``found`` are the documents with protected spans."""
    held = entities(found)
    by_text = held.groupBy("entity", "__th").agg(F.count(F.lit(1)).alias("times"))
    df_entity = by_text.groupBy("entity").agg(F.sum("times").alias("df_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT).drop("texts")
    outside = F.regexp_replace(F.regexp_replace("text", f"(?:{EMAIL})|(?:{IP})", " "), SECRET, " ")
    texts = found.groupBy("__th").agg(F.min("text").alias("text")).select("__th", _words(outside).alias("words"))
    pairs = cut(texts.join(by_text.join(df_entity, "entity"), "__th").select("__th", "entity", "df_e", "times", F.explode("words").alias("term")))
    together = pairs.groupBy("entity", "df_e", "term").agg(F.sum("times").alias("df_et"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    df_all = documents.where("text IS NOT NULL").select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    n = F.lit(documents.where("text IS NOT NULL").count())
    scored = together.join(df_all, "term")
    information = F.log(n / F.col("df_e"))
    pmi = F.log(n * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    revealing = cut(scored.where((information > 0) & (pmi >= DISCLOSURE * information)).select("entity", "term"))
    revealing = F.broadcast(revealing) if revealing.count() <= FEW else revealing
    return pairs.join(revealing, ["entity", "term"], "left_semi").groupBy("__th").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def all_spans(documents: DataFrame) -> DataFrame:
    """__id, __th, the protected spans by kind and ``term``, of the documents that have any; one row for each (__id, __th)."""
    found = cut(spans(documents).where(_holds_any()))
    terms = disclosing(documents, found)
    each = found.dropDuplicates(["__id", "__th"]).join(terms, "__th", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    each = apart(each, protected=F.concat(*(F.transform(k, lambda x: F.struct(x["start"], x["end"])) for k in (*KINDS, "secret"))), pattern=pattern)
    placed = F.when(F.col("terms").isNotNull(), _placed(F.col("text"), F.col("pattern"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    free = F.filter(placed, lambda x: ~F.exists("protected", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return each.withColumn("term", free).select("__id", "__th", *KINDS, "secret", "term")


def _listed(kind: str, name: str) -> Column:
    return F.transform(F.array_sort(F.transform(name, lambda x: F.struct(x["start"], x["end"]))), lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def report(documents: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of the base spans, and all spans."""
    none = F.array().cast(f"array<{SPAN}>")
    d = keyed(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("text").join(all_spans(documents.select("doc_id", "text")), ["__id", "__th"], "left")
    d = d.withColumns({k: F.coalesce(k, none) for k in (*KINDS, "secret", "term")})
    own = F.concat(*(_listed(k, k) for k in KINDS))
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(own, ","), 256).alias("base_sha256"), F.array_join(F.concat(own, _listed("secret", "secret"), _listed("term", "term")), ",").alias("spans"), *(F.size(k).cast("long").alias(f"n_{k}") for k in ("secret", "term")))


def sanitise(documents: DataFrame) -> DataFrame:
    """The documents with each span generalised to its kind; where spans overlap, the first one counts."""
    found = all_spans(documents.select("doc_id", "text"))
    every = F.array_sort(F.concat(*(F.transform(k, _named(k)) for k in (*KINDS, "secret", "term"))))
    d = keyed(documents.withColumn("__text", F.coalesce("text", F.lit(""))), "__text").join(found.select("__id", "__th", every.alias("__spans")), ["__id", "__th"], "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], F.substr("__text", a["at"] + 1, x["start"] - a["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), more.alias("out")))

    clean = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substr("__text", a["at"] + 1, F.length("__text"))))
    return d.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))).select(*documents.columns)
