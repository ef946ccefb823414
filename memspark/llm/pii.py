"""Personal data: base detectors and information-theoretic sanitisation, in DataFrame expressions only.

Detectors find protected entities (e-mail addresses, IP addresses, card numbers, phone numbers, and
assigned secrets) with positions in code points. The corpus then tells which words reveal them. An entity
is known to the corpus in two ways: by its class, with which every word of a document that holds the class
co-occurs, and by its value, with which the words of its context (``REACH`` code points on each side)
co-occur. With n documents, n_c with the entity c, n_t with the word t and n_ct with both, the disclosure
of c by t is PMI = log2(n n_ct / (n_c n_t)), at most the entity's own information IC = log2(n / n_c).
A word discloses c if PMI is ``SHARE`` x IC or more and k x PMI, the bits that k different contexts of c
give, exceeds ``DOUBT`` bits and the logarithm of the number of pairs tested (copies, and near copies with
the same surroundings, are one context). The words that a pattern itself asks for (``OWN``) are no evidence. Every occurrence of such a word, in every document that holds
the entity, becomes a span of kind ``term``. ``sanitise`` generalises entities to their kind and removes
disclosing words.

Patterns are written so that a match takes linear time: a run is only entered at its start, or where
the last match ended, and repeats are possessive; the spans equal those of the plain patterns.

Scale: one pass finds entities and their contexts, one counts document frequencies with partial
aggregation; only documents with an entity are joined (each gives its words at most once for each class,
not for each entity). Nothing is collected or broadcast by hand but two counts.

Edge cases: null text is empty and has no spans; a null or repeated id is an ordinary row; equal rows
get equal results; copies of a text are one context; spans that start together are ordered by kind; very
long texts with many matches are placed in runs of ``RUN``, so that time stays in proportion; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare, scratch, text_of, written

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE = 4
#: Part of an entity's information that a word must give, and bits of evidence beyond chance among all pairs tested.
SHARE, DOUBT = 0.75, 4.0
#: Code points on each side of an entity that are the context of its value.
REACH = 200
#: Matches that are placed together.
RUN = 64
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<=(?:token|secret|password|passwd|api_key|apikey|access_key)[ ]{0,3}[=:][ ]{0,3}[\"']?)[A-Za-z0-9_+/.=-]{16,}+",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "secret": r"(?:token|secret|password|passwd|api_key|apikey|access_key)[ ]{0,3}[=:]"}
TERM = r"\p{L}{3,}"
#: Words that a pattern itself asks for disclose nothing beyond it.
OWN = {"secret": ("token", "secret", "password", "passwd", "api", "apikey", "key", "access")}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
    "secret": lambda v: F.lit(True),
}


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _placed(text: Column, pattern: Column, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's matches; positions from 0."""
    empty = F.array().cast(_SPANS)
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit")), lambda p: p["hit"].isNotNull())

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def run(some, k):  # the spans of a run of matches from its own start, and its length
        return F.aggregate(F.slice(some, k * RUN + 1, RUN), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)

    def join(acc, part):
        starts = F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("at"), part["spans"].alias("spans"))))
        return F.struct((acc["at"] + part["at"]).alias("at"), starts.alias("parts"))

    none = F.array().cast(f"array<struct<at:int,spans:{_SPANS}>>")
    moved = lambda p: F.transform(p["spans"], lambda s: F.struct((s["start"] + p["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + p["at"]).alias("end"), s["value"].alias("value")))

    def placed(some):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / RUN).cast("int")), lambda k: run(some, k))
        parts = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("parts")), join, lambda acc: acc["parts"])
        return F.when(F.size(some) > 0, F.flatten(F.transform(parts, moved))).otherwise(empty)

    # the one element of an array is a variable: the pattern is matched once
    return F.element_at(F.transform(F.array(pairs), placed), 1)


def found(text: Column, kind: str) -> Column:
    """The spans of a kind's valid matches."""
    spans = _placed(text, F.lit(PATTERNS[kind]), KINDS.index(kind))
    return F.when(text.rlike(NEEDS[kind]), F.filter(spans, lambda s: VALID[kind](s["value"]))).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def entities(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, id, text_key, entities and hash of each row; the text of rows that have any entity, or of all."""
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", "text", F.array_sort(F.concat(*[found(F.col("text"), k) for k in KINDS[:-1]])).alias("spans"))
    some = F.size("spans") > 0
    return rows.select("doc_id", id_text().alias("id"), F.md5(F.col("text").cast("binary")).alias("text_key"), "spans", (F.col("text") if whole else F.when(some, F.col("text"))).alias("text"), F.when(~some, F.sha2(F.col("text").cast("binary"), 256)).alias("plain_sha256"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosures(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, text_key, terms: the disclosing words of each row that has any."""
    held = rows.where(F.size("spans") > 0).select("id", "text_key", "text", F.explode("spans").alias("s"))
    left = F.substring("text", F.greatest(F.col("s.start") - REACH, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(REACH)))
    right = F.substring("text", F.col("s.end") + 1, F.lit(REACH))
    # a word that the reach cuts is not whole
    left = F.when(F.col("s.start") > REACH, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length("text") > F.col("s.end") + REACH, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    context = F.concat(left, F.lit(" "), right)
    value = F.when(F.col("s.kind").isin(2, 3), _digits(F.col("s.value"))).otherwise(F.lower("s.value"))
    each = held.select("id", "text_key", F.col("s.kind").alias("kind"), F.concat_ws(":", "s.kind", value).alias("entity"), context.alias("context"))
    near = each.select("id", "text_key", "entity", F.xxhash64("context").alias("place"), F.explode(_terms(F.col("context"))).alias("term"))
    classes = each.groupBy("id", "text_key", F.col("kind").cast("string").alias("entity")).agg(F.min(F.xxhash64("context")).alias("place"))
    texts = rows.where(F.size("spans") > 0).select("id", "text_key", "text").dropDuplicates(["id", "text_key"])
    wide = classes.join(texts, ["id", "text_key"]).select("id", "text_key", "entity", "place", F.explode(_terms(F.col("text"))).alias("term"))
    own = F.lit(False)
    for kind, words in OWN.items():
        own = own | ((F.substring_index("entity", ":", 1) == str(KINDS.index(kind))) & F.col("term").isin(*words))
    near, wide = near.where(~own), wide.where(~own)
    seen = near.unionAll(wide).groupBy("entity", "term", "place", "id", "text_key").agg(F.lit(1).alias("one"))
    pairs = written(seen.groupBy("entity", "term", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("k")), "pairs")
    of_value = each.select("id", "text_key", "entity").distinct()
    by_value = of_value.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    by_class = F.broadcast(classes.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")))  # a row for each kind at most
    of_term = docs.select(F.explode(_terms(text_of())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n, tested = float(rows.count()), max(1, pairs.count())
    counted = pairs.where("k > 1 and entity like '%:%'").join(by_value, "entity").unionByName(pairs.where("k > 1 and entity not like '%:%'").join(by_class, "entity"))
    judged = counted.join(of_term, "term")
    pmi = F.log2(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    strong = judged.where((pmi >= SHARE * F.log2(n / F.col("n_c"))) & (F.col("k") * pmi >= F.lit(DOUBT) + F.log2(F.lit(float(tested))))).select("entity", "term")
    # a value's words are marked in all of its documents, wherever they stand
    hits = of_value.join(strong.where("entity like '%:%'"), "entity").select("id", "text_key", "term").unionAll(wide.join(strong, ["entity", "term"]).select("id", "text_key", "term"))
    return hits.groupBy("id", "text_key").agg(F.collect_set("term").alias("terms"))


def detect(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, found (entities), added (disclosing words), sanitised text (of rows without an entity only if
    ``whole``) and its hash."""
    prepare(docs.sparkSession)
    rows = written(entities(docs, whole), "entities", keep=True)
    with scratch(docs.sparkSession):
        extra = written(disclosures(docs, rows), "terms", keep=True)
    none = F.array().cast(_SPANS)
    some = rows.where(F.size("spans") > 0).join(extra, ["id", "text_key"], "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(r")(?!\p{L})"))
    words = F.when(F.col("terms").isNotNull(), _placed(F.col("text"), pattern, KINDS.index("term"))).otherwise(none)
    # a word inside an entity is already covered
    words = F.filter(words, lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    some = some.select("doc_id", F.col("spans").alias("found"), words.alias("added"), "text")
    some = some.withColumn("sanitised", _sanitised(F.col("text"), F.array_sort(F.concat("found", "added"))))
    some = some.select("doc_id", "found", "added", "sanitised", F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"))
    plain = rows.where(F.size("spans") == 0).select("doc_id", F.col("spans").alias("found"), none.alias("added"), F.col("text").alias("sanitised"), F.col("plain_sha256").alias("sanitised_sha256"))
    return some.unionAll(plain)


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with entities generalised to their kind and disclosing words removed; of overlapping spans the first stands."""
    label = F.array(*[F.lit("" if k == "term" else f"[{k.upper()}]") for k in KINDS])

    def step(acc, s):
        part = F.struct(acc["at"].alias("a"), F.greatest(s["start"], acc["at"]).alias("b"), F.when(s["start"] >= acc["at"], F.element_at(label, s["kind"] + 1)).otherwise("").alias("label"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,label:string>>").alias("parts"))
    pieces = F.aggregate(spans, start, step, lambda acc: F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("a"), F.length(text).alias("b"), F.lit("").alias("label")))))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.substring(text, p["a"] + 1, p["b"] - p["a"]), p["label"])), "")


def query(docs: DataFrame) -> DataFrame:
    rows = detect(docs)
    base = F.filter("found", lambda s: s["kind"] < BASE)

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(5)]
    n_spans = (F.size("found") + F.size("added")).cast("long").alias("n_spans")
    return rows.select("doc_id", *counts[:BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("found", "added")).alias("spans"), counts[4], F.size("added").cast("long").alias("n_term"), n_spans, "sanitised_sha256")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, sanitised: texts with entities generalised to their kind and disclosing words removed."""
    return detect(docs, whole=True).select("doc_id", "sanitised")
