"""Personal data: base patterns, and terms that reveal a protected entity by their co-occurrence.

Native: DataFrame functions only.

Information-theoretic sanitisation follows C-sanitized privacy (Sanchez and Batet, "C-sanitized: a
privacy model for document redaction and sanitization", JASIST 2016). The base patterns find personal
values; a protected entity is such a value, or what it belongs to: the domain or the name of an e-mail
address, the network of an IP address, the issuer of a card, the exchange of a phone number, or the
kind itself (``LEVELS``). The information of an entity e is IC(e) = -log2 p(e); a term t reveals
PMI(t; e) = log2 (p(t, e) / (p(t) p(e))) of it. All three are shares of documents, counted over all of
them. A term of a document that holds e is disclosing if PMI(t; e) >= IC(e) / alpha, that is
p(e | t) >= p(e) ^ (1 - 1 / alpha), if ``min_together`` documents hold both, and if that is no chance
meeting: by Chernoff's bound, so many of n documents meet with a probability of 2 ^ (-n KL(p(e|t) || p(e)))
at most, which must stay under ``chance`` over all pairs of an entity and a term that were counted.
Copies of a document are a common case: words that stand in them alone lead from one whose address was
removed to the others.

A term is a run of ``MIN_LENGTH`` or more letters that touches no digit, ``@``, ``%``, ``+``, ``-``, ``_`` or
inner point, so that it lies outside of all base spans; case doesn't count. Every occurrence of a disclosing
term in a document that holds its entity becomes a span of kind ``term``. ``sanitize`` replaces it by the
first more general term of a given hierarchy that is not disclosing for the document's entities
itself, and removes it if there is none.

Entities in fewer than ``min_together`` documents are left out of the pair counts: nothing can be told of
them. A pair row is an entity and a term of its document, combined before the shuffle.

Defined results: null text counts as empty and has no spans; an empty table gives an empty result;
repeated rows are each scanned and counted; further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
# Same matches as the plain patterns. The look-behind with \G starts each run of local-part
# characters or digits only once, and possessive groups neither backtrack nor recurse, which keeps
# the scan linear and the stack flat on very long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
EMPTY_SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"
MIN_LENGTH = 4
#: A letter run that touches nothing of an address or number; the point of a sentence end may follow.
TERM = rf"(?<![\p{{L}}0-9@._%+-])\p{{L}}{{{MIN_LENGTH},}}+(?![0-9@_%+-]|\.[\p{{L}}0-9])"
#: Matches whose places are summed up together: a prefix sum in two steps stays linear.
BLOCK = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    each = F.transform(
        backwards,
        lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) - F.when(c >= "5", 9).otherwise(0)).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda total, x: total + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is kept."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: in the body of a lambda it would be for each element."""
    return F.transform(F.array(value), use)[0]


def prefix_sums(values: Column) -> Column:
    """Sums of an array's values up to each one, block by block of ``BLOCK``: linear in its length."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda t, x: t + x)

    def step(acc: Column, own: Column) -> Column:
        sums = F.transform(own, lambda _, i: acc["before"] + total(F.slice(own, F.lit(1), i + 1)))
        return F.struct((acc["before"] + total(own)).alias("before"), F.concat(acc["out"], F.array(sums)).alias("out"))

    def run(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        first = F.struct(zero.alias("before"), F.array().cast("array<array<long>>").alias("out"))
        return F.aggregate(blocks, first, step, lambda acc: F.flatten(acc["out"]))

    return bound(values, run)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as ``(kind, start, end, value)`` with code points. One pass
    sets each match between two marks; what lies between the marks gives the places."""
    mark = "\x00"
    marked = F.regexp_replace(F.translate(text, mark, "\x01"), pattern, f"{mark}$0{mark}")

    def run(parts: Column) -> Column:  # before, value, before, value, ..., rest
        ends = prefix_sums(F.transform(parts, lambda x: F.length(x).cast("long")))
        found = F.filter(F.zip_with(parts, ends, lambda v, e: F.struct(v.alias("v"), e.alias("e"))), lambda _, i: i % 2 == 1)
        spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), (x["e"] - F.length(x["v"])).alias("start"), x["e"].alias("end"), x["v"].alias("value")))
        return F.when(F.size(parts) > 1, spans).otherwise(F.array().cast(EMPTY_SPANS))

    return bound(F.split(marked, mark, -1), run)


def _only(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def base_spans(text: Column) -> Column:
    """Kept spans of the four kinds, by start, then kind in the order of ``KINDS``."""
    found = []
    for kind in KINDS:
        spans = _only(kind, matches(text, PATTERNS[kind], kind))
        if NEEDS[kind]:
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(EMPTY_SPANS))
        found.append(spans)
    return F.concat(*found)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), kind)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), _rank(s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, spans, held)``: base spans of every row; ``held`` is the text where it has any.
    ``key`` is a hash of the text, so that rows that repeat an id stay apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = rows.withColumn("spans", base_spans(F.col("text")))
    return spans.select("doc_id", F.xxhash64("text").alias("key"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("held"))


def entities_of(spans: Column) -> Column:
    """Distinct entities of a document's base spans, on all ``LEVELS``."""

    def levels(s: Column) -> Column:
        value, digits = F.lower(s["value"]), _digits(s["value"])
        part = (
            F.when(s["kind"] == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
            .when(s["kind"] == "ip", F.concat(F.lit("network:"), F.substring_index(value, ".", 3)))
            .when(s["kind"] == "card", F.concat(F.lit("issuer:"), F.substring(digits, 1, 6)))
            .otherwise(F.concat(F.lit("exchange:"), F.substr(digits, F.lit(1), F.length(digits) - 4)))
        )
        exact = F.concat_ws(":", s["kind"], F.when(s["kind"].isin("email", "ip"), value).otherwise(digits))
        name = F.when(s["kind"] == "email", F.concat(F.lit("name:"), F.substring_index(value, "@", 1)))
        return F.array(exact, part, name, F.concat(F.lit("kind:"), s["kind"]))

    return F.array_distinct(F.filter(F.flatten(F.transform(spans, levels)), lambda e: e.isNotNull()))


def holders_of(scanned: DataFrame) -> DataFrame:
    """``(row, doc_id, key, entities, held)`` of the rows with personal data, as a table: ``row`` is a number."""
    found = scanned.where("held is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", entities_of(F.col("spans")).alias("entities"), "held")
    return materialize(found, "pii-holders")


#: From the value itself to what it belongs to.
LEVELS = ("value", "domain, name, network, issuer, exchange", "kind")


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0))


def _chernoff_bits(n: Column, q: Column, p: Column) -> Column:
    """Bits by which ``n`` trials of chance ``p`` are unlikely to hit in the share ``q >= p``."""
    rest = F.when(q < 1, (1 - q) * (F.log2(F.greatest(1 - q, F.lit(1e-300))) - F.log2(F.greatest(1 - p, F.lit(1e-300))))).otherwise(0.0)
    return n * (q * (F.log2(q) - F.log2(p)) + rest)


class Groups(NamedTuple):
    """Entities that stand in the same documents: they lead to the same terms, so one stands for all.
    ``members`` is ``(entity, group)``, ``sizes`` ``(group, n_e, size)``, ``rows`` ``(row, groups)``."""

    members: DataFrame
    sizes: DataFrame
    rows: DataFrame


def grouped(holders: DataFrame, min_together: int) -> Groups:
    """Entities of ``min_together`` documents or more by their set of documents: its size and two 64-bit sums of
    hashes of its rows, which are distinct numbers. A document of thousands of entities that it shares with the
    same others is in a few groups, so that it meets its terms a few times, not thousands of times."""
    found = holders.select("row", F.explode("entities").alias("entity"))
    marks = [F.hex(F.bit_xor(F.xxhash64("row", F.lit(k)))) for k in (1, 2)]
    sets = found.groupBy("entity").agg(F.count("*").alias("n_e"), *[m.alias(f"_{k}") for k, m in enumerate(marks)]).where(F.col("n_e") >= min_together)
    members = materialize(sets.select("entity", F.concat_ws("-", F.col("n_e").cast("string"), "_0", "_1").alias("group"), "n_e"), "pii-entities")
    sizes = members.groupBy("group").agg(F.first("n_e").alias("n_e"), F.count("*").alias("size"))
    rows = found.join(members.select("entity", "group"), "entity").groupBy("row").agg(F.collect_set("group").alias("groups"))  # of one document
    return Groups(members.select("entity", "group"), materialize(sizes, "pii-groups"), materialize(rows, "pii-rows"))


def disclosures(
    docs: DataFrame, holders: DataFrame, alpha: float, min_together: int, chance: float, text_col: str = "text", general: DataFrame | None = None
) -> DataFrame:
    """``(entity, term, n_et, n_e, n_t, pmi, ic)`` of the pairs that exceed the threshold, from counts over
    all documents. With ``general(term, parent)``, each term stands for its parents instead."""
    groups = grouped(holders, min_together)
    return telling_terms(docs, holders, groups, alpha, min_together, chance, text_col, general).join(groups.members, "group").drop("group")


def telling_terms(
    docs: DataFrame, holders: DataFrame, groups: Groups, alpha: float, min_together: int, chance: float, text_col: str = "text", general: DataFrame | None = None
) -> DataFrame:
    """``disclosures`` with ``group`` for ``entity``: a row holds for each of the group's entities."""
    total = F.lit(float(max(docs.count(), 1)))

    def lifted(rows: DataFrame, keys: list[str]) -> DataFrame:
        if general is None:
            return rows
        return rows.join(general, "term").select(*keys, F.col("parent").alias("term")).distinct()

    # a text travels once, with the groups of its entities
    met = holders.join(groups.rows, "row").select("row", "groups", F.explode(terms_of(F.col("held"))).alias("term"))
    met = lifted(met, ["row", "groups"]).select("term", F.explode("groups").alias("group"))
    pairs = materialize(met.groupBy("group", "term").agg(F.count("*").alias("n_et")), "pii-pairs")
    tried = pairs.groupBy("group").agg(F.count("*").alias("n")).join(groups.sizes, "group").agg(F.sum(F.col("n") * F.col("size"))).first()[0]  # pairs of entity and term
    bits = F.lit(math.log2(max(tried or 0, 1) / chance))
    share = F.col("n_e") / total
    # n_t is n_et at least: what chance may explain even so is left out before the corpus is counted
    hopeful = pairs.where(F.col("n_et") >= min_together).join(groups.sizes.drop("size"), "group").where(F.col("n_et") * -F.log2(share) >= bits)
    wanted = hopeful.select("term").distinct()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.explode(terms_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term"))
    if general is None:  # counted within each task before terms travel
        counts = texts.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")
    else:
        below = general.join(wanted.withColumnRenamed("term", "parent"), "parent", "left_semi")
        met_at = texts.join(below.select("term").distinct(), "term", "left_semi").join(below, "term")
        counts = met_at.select("row", F.col("parent").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    scored = hopeful.join(counts, "term").withColumn("ic", -F.log2(share)).withColumn("pmi", F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t"))))
    sure = _chernoff_bits(F.col("n_t"), F.col("n_et") / F.col("n_t"), share) >= bits
    out = scored.where((F.col("ic") > 0) & (F.col("pmi") >= F.col("ic") / alpha) & sure).select("group", "term", "n_et", "n_e", "n_t", "pmi", "ic")
    return materialize(out, "pii-disclosures")


def term_spans(holders: DataFrame, groups: Groups, telling: DataFrame) -> DataFrame:
    """``(doc_id, key, terms)`` of the documents that hold an entity with disclosing terms: all of their
    occurrences there. A document meets the terms that stand in it, not all of its entities' terms. Terms meet
    by a hash; their words then select the occurrences, so a hash that two terms share adds none."""
    known = telling.select("group", "term", F.xxhash64("term").alias("hash"))
    words = holders.select("row", F.explode(terms_of(F.col("held"))).alias("word")).select("row", F.xxhash64("word").alias("hash"))
    words = words.join(known.select("hash").distinct(), "hash", "left_semi")
    owned = groups.rows.select("row", F.explode("groups").alias("group"))
    told = words.join(owned, "row").join(known, ["group", "hash"]).groupBy("row").agg(F.collect_set("term").alias("told"))  # of one document
    spans = F.filter(matches(F.col("held"), TERM, "term"), lambda s: F.array_contains(F.col("told"), F.lower(s["value"])))
    found = holders.join(told, "row").select("doc_id", "key", F.explode(spans).alias("s"))
    return found.groupBy("doc_id", "key").agg(F.collect_set("s").alias("terms"))  # of one document


def find_spans(
    docs: DataFrame, alpha: float = 1.25, min_together: int = 2, chance: float = 0.01, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, key, spans, terms)`` for every row: base spans and disclosing terms, each an array of
    ``(kind, start, end, value)``."""
    scanned = materialize(scan(docs, id_col, text_col), "pii-scan")
    holders = holders_of(scanned)
    groups = grouped(holders, min_together)
    return _found(scanned, holders, groups, telling_terms(docs, holders, groups, alpha, min_together, chance, text_col))


def _found(scanned: DataFrame, holders: DataFrame, groups: Groups, telling: DataFrame) -> DataFrame:
    terms = term_spans(holders, groups, telling).withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    return scanned.join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select(
        "doc_id", "key", "spans", F.coalesce("terms", F.array().cast(EMPTY_SPANS)).alias("terms")
    )


def generalised(docs: DataFrame, holders: DataFrame, groups: Groups, telling: DataFrame, hierarchy: DataFrame, levels: int, **bounds) -> DataFrame:
    """``(doc_id, key, term, instead)``: for each disclosing term of a document the nearest ancestor in
    ``hierarchy(term, parent)`` that discloses none of the document's entities; none within ``levels``
    steps: no row."""
    step = hierarchy.select(F.lower("term").alias("term"), F.lower("parent").alias("parent")).where("term is not null and parent is not null and term <> parent").distinct()
    above = step.withColumn("steps", F.lit(1))
    every = above
    for n in range(2, levels + 1):
        above = above.join(step.toDF("parent", "_up"), "parent").select("term", F.col("_up").alias("parent"), F.lit(n).alias("steps"))
        every = every.unionAll(above)
    every = materialize(every.where("term <> parent").groupBy("term", "parent").agg(F.min("steps").alias("steps")), "pii-hierarchy")
    # an ancestor stands for all terms below it, and for itself
    meant = every.select("term", "parent").unionAll(every.select(F.col("parent").alias("term"), "parent")).distinct()
    bad = telling_terms(docs, holders, groups, general=meant, **bounds).select("group", F.col("term").alias("parent"))
    owned = groups.rows.select("row", F.explode("groups").alias("group"))
    words = holders.select("row", "doc_id", "key", F.explode(terms_of(F.col("held"))).alias("term")).join(telling.select("term").distinct(), "term", "left_semi")
    open_ = words.join(owned, "row").join(telling.select("group", "term"), ["group", "term"], "left_semi").select("row", "doc_id", "key", "term").distinct()
    tried = open_.join(every, "term")
    risky = tried.select("row", "parent").distinct().join(owned, "row").join(bad, ["group", "parent"], "left_semi").select("row", "parent").distinct()
    return tried.join(risky, ["row", "parent"], "left_anti").groupBy("doc_id", "key", "term").agg(F.min_by("parent", F.struct("steps", "parent")).alias("instead"))


def sanitize(
    docs: DataFrame, hierarchy: DataFrame | None = None, levels: int = 3, alpha: float = 1.25, min_together: int = 2, chance: float = 0.01,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with base spans replaced by ``[KIND]`` and disclosing terms by ``[ANCESTOR]`` from
    ``hierarchy(term, parent)``, or by nothing where no ancestor is safe. Null texts stay null."""
    scanned = materialize(scan(docs, id_col, text_col), "pii-scan")
    bounds = {"alpha": alpha, "min_together": min_together, "chance": chance, "text_col": text_col}
    holders = holders_of(scanned)
    groups = grouped(holders, min_together)
    telling = telling_terms(docs, holders, groups, **bounds)
    found = _found(scanned, holders, groups, telling).dropDuplicates(["doc_id", "key"])
    found = found.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.concat("spans", "terms").alias("_s"))
    if hierarchy is None:
        found = found.withColumn("_g", F.create_map().cast("map<string,string>"))
    else:
        general = generalised(docs, holders, groups, telling, hierarchy, levels, **bounds).groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("term", "instead"))).alias("_g"))
        general = general.withColumnsRenamed({"doc_id": "_d2", "key": "_k2"})
        found = found.join(general, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_k") == F.col("_k2")), "left").drop("_d2", "_k2")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_k")), "left")
    ordered = F.array_sort(F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def step(acc: Column, s: Column) -> Column:
        instead = F.try_element_at(F.col("_g"), F.lower(s["value"]))
        mark = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.coalesce(F.concat(F.lit("["), F.upper(instead), F.lit("]")), F.lit("")))
        start = F.greatest(s["start"], acc["at"])
        skip = s["end"] <= acc["at"]  # inside a span already replaced
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int")), mark)
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(ordered, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col(text_col).isNull() | (F.size("_s") == 0), F.col(text_col)).otherwise(clean)
    return joined.withColumn(text_col, new).select(*docs.columns)


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.concat("spans", "terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
