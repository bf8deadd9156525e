"""Text triage, the entry rubric, described sizes and plain-text predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the published rubric.
TITLE_BOWL = r"(?i)\bbowl\s+barrow\b"
TITLE_NON_TARGET = (
    r"(?i)\b(?:long|bell|disc|saucer|platform|pond|oval|bank)\s+barrows?\b|\bcairns?\b|\bring\s+ditches?\b|\bcropmarks?\b"
)
TITLE_MULTIPLE = (
    r"(?i)\b(?:two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|"
    r"pair\s+of|group\s+of)\b.{0,80}\bbarrows?\b|\b(?:bowl|round|long|bell|disc|saucer|platform|pond|oval|bank)\s+barrows\b"
    r"|\bbarrow\s+(?:cemetery|cemeteries|group|field)\b"
)
TITLE_SURVIVAL = r"(?i)\b(?:destroyed|levelled|flattened|ploughed|cropmark(?:s)?(?:\s+only)?|reconstructed|restored)\b"
TITLE_CONTEXT = r"(?i)\b(?:and|including|containing|with|within|part\s+of|forming\s+part\s+of)\b"
ENTRY_CAIRN = r"(?i)\b(?:is|comprises|includes)\s+(?:an?\s+)?(?:(?:round|circular|sub-circular)\s+)?cairn\b"
ENTRY_MULTIPLE = (
    r"(?is)\bmonument\s+includes\s+(?:the\s+remains\s+of\s+)?(?:two|three|four|five|six|seven|eight|nine|ten|a\s+pair\s+of)\s+(?:bowl\s+)?barrows?\b"
)
ENTRY_COMPOUND = (
    r"(?is)\bmonument\s+includes\b.{0,220}\b(?:and|together with)\b.{0,40}\b(?:another|second|settlement|field system|enclosure|cross|cairn)\b"
)
ENTRY_DESTROYED = (
    r"(?i)\b(?:reconstructed|wholly removed|completely removed|(?:wholly|completely|entirely) destroyed|has been destroyed)\b"
)
ENTRY_LEVELLED = r"(?i)\b(?:completely |wholly |entirely )?(?:levelled|flattened)\b|\bno longer visible as (?:an? )?(?:earthwork|mound)\b"
ENTRY_CROPMARK = r"(?i)\b(?:visible|survives?|identified)\s+(?:only\s+)?as\s+(?:a\s+)?cropmark\b"
ENTRY_RELIEF = (
    r"(?is)\b(?:survives?|visible|stands?|measures?|rises?|remains?)\b.{0,100}\b(?:mound|earthwork|rise|[0-9]+(?:\.[0-9]+)?m\s+high)\b|"
    r"\b(?:mound|earthwork)\b.{0,100}\b(?:survives?|visible|[0-9]+(?:\.[0-9]+)?m\s+high)\b|\b[0-9]+(?:\.[0-9]+)?m\s+high\b"
)
DIAMETERS = (
    r"(?i)(?:diameter(?: of)?|measur(?:e|es|ing)|dimensions? of)[^.;]{0,90}?(\d+(?:\.\d+)?)\s*m\b",
    r"(?i)\b(\d+(?:\.\d+)?)\s*m\s+(?:in\s+)?(?:maximum\s+)?diameter\b",
    r"(?i)\b(\d+(?:\.\d+)?)\s*m\s+across\b",
)
#: Outcomes of a title: the first rule that holds, in this order. Each is (all of, category, reason).
TITLE_RULES = (
    ("bowl multiple", "manual_review_required", "possible multiple monument"),
    ("bowl other", "manual_review_required", "mixed monument types"),
    ("bowl survival", "manual_review_required", "survival warning"),
    ("bowl context", "manual_review_required", "compound or contextual title"),
    ("bowl", "probable_bowl_candidate", "explicit singular bowl-barrow title"),
    ("other", "clear_title_exclusion", "explicit non-target barrow type"),
    ("multiple", "clear_title_exclusion", "explicit multiple monuments"),
    ("survival", "clear_title_exclusion", "explicit survival warning"),
    ("", "manual_review_required", "generic or ambiguous barrow title"),
)
#: Outcomes of an entry: rule, status, identity, single, relief (``?``: as the text says), reason, last code.
ENTRY_RULES = (
    ("unnamed", "rejected", "no", "uncertain", "uncertain", "not_bowl_barrow", "identity:not_explicit"),
    ("cairn", "rejected", "no", "yes", "?", "cairn", "type:described_as_cairn"),
    ("several", "rejected", "yes", "no", "?", "compound_or_multiple", "monument:not_single"),
    ("destroyed", "rejected", "yes", "yes", "no", "destroyed_or_reconstructed", "relief:destroyed_or_reconstructed"),
    ("levelled", "rejected", "yes", "yes", "no", "no_upstanding_relief", "relief:levelled"),
    ("cropmark", "rejected", "yes", "yes", "no", "cropmark_only", "relief:cropmark_only"),
    ("faint", "uncertain", "yes", "yes", "uncertain", "insufficient_evidence", "relief:insufficient_evidence"),
    ("", "needs_geometry_review", "yes", "yes", "yes", None, "relief:upstanding_supported"),
)
OPENING = 700  # characters of an entry's details that the several-monument rules see
BLOCKED_TEXT = r"(?i)[<>\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|https?://|file:|\.\./|\.\.\\"


def squeeze(text: Column) -> Column:
    """White space runs, Unicode ones too, to one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cascade(rules: list[tuple[Column | None, Column]]) -> Column:
    """Value of the first rule that holds; a rule without a condition always does."""
    out = None
    for condition, value in rules:
        if condition is None:
            return value if out is None else out.otherwise(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def triage_title(title: Column) -> Column:
    """``struct(category, reason)``; NULL for a title without ``barrow``."""
    t = squeeze(title)
    flags = {
        "bowl": t.rlike(TITLE_BOWL), "multiple": t.rlike(TITLE_MULTIPLE), "other": t.rlike(TITLE_NON_TARGET),
        "survival": t.rlike(TITLE_SURVIVAL), "context": t.rlike(TITLE_CONTEXT),
    }
    rules = []
    for names, category, reason in TITLE_RULES:
        condition = None
        for n in names.split():
            condition = flags[n] if condition is None else condition & flags[n]
        rules.append((condition, F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))))
    return F.when(F.contains(F.lower(t), F.lit("barrow")), cascade(rules))


def assess_entry(reasons: Column, details: Column) -> Column:
    """``struct(status, identity, single, relief, reason, codes)`` of an entry's two texts."""
    r, d = squeeze(F.coalesce(reasons, F.lit(""))), squeeze(F.coalesce(details, F.lit("")))
    opening = F.substring(d, 1, OPENING)
    relief = d.rlike(ENTRY_RELIEF)
    flags = {
        "unnamed": ~F.concat_ws(" ", r, d).rlike(TITLE_BOWL), "cairn": d.rlike(ENTRY_CAIRN),
        "several": opening.rlike(ENTRY_MULTIPLE) | opening.rlike(ENTRY_COMPOUND), "destroyed": d.rlike(ENTRY_DESTROYED),
        "levelled": d.rlike(ENTRY_LEVELLED), "cropmark": d.rlike(ENTRY_CROPMARK) & ~relief, "faint": ~relief,
    }
    rules = []
    for name, status, identity, single, shown, reason, last in ENTRY_RULES:
        codes = []
        if name != "unnamed":
            codes.append("identity:explicit_bowl_barrow")
        if name not in ("unnamed", "cairn", "several"):
            codes.append("monument:single_supported")
        seen = F.when(relief, "yes").otherwise("uncertain") if shown == "?" else F.lit(shown)
        rules.append((
            flags.get(name),
            F.struct(
                F.lit(status).alias("status"), F.lit(identity).alias("identity"), F.lit(single).alias("single"), seen.alias("relief"),
                F.lit(reason).cast("string").alias("reason"), F.lit(";".join([*codes, last])).alias("codes"),
            ),
        ))
    return cascade(rules)


def described_diameter(details: Column, low: float = 1, high: float = 80) -> Column:
    """Largest plausible size in metres named in a sentence on a mound or barrow; NULL if none is."""
    sentences = F.filter(F.split(details, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lit("mound")) | F.contains(F.lower(s), F.lit("barrow")))
    sizes = F.flatten(F.transform(sentences, lambda s: F.concat(*[F.regexp_extract_all(s, F.lit(p), 1) for p in DIAMETERS])))
    numbers = F.filter(F.transform(sizes, lambda v: v.cast("double")), lambda v: (v >= low) & (v <= high))
    return F.array_max(numbers)


def safe_plain_text(text: Column) -> Column:
    return ~text.rlike(BLOCKED_TEXT)


def opaque_reference(text: Column, kind: str) -> Column:
    """Whether a text is an id of the kind, for example ``prj``."""
    return text.rlike(f"^{kind}_[a-z0-9]{{12}}$")


def split_list(text: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, sep), lambda s: F.trim(s)), lambda s: s != "")


def code_set(text: Column) -> Column:
    """``;``-joined codes as a sorted array, to compare as sets."""
    return F.array_sort(F.array_distinct(F.split(text, ";")))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0))


def line_digest(text: Column) -> Column:
    """SHA-256 that does not depend on the kind of line ends."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def iso_utc(milliseconds: Column) -> Column:
    """Milliseconds since 1970 as an ISO time with offset, to the second; NULL stays NULL."""
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(F.floor(milliseconds / 1000)).cast("timestamp_ntz"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def date_prefix(iso: Column) -> Column:
    return F.substring(iso, 1, 10)
