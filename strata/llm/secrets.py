"""Secret scan: candidates by pattern, false positives removed by a random forest.

Native: DataFrame functions and Spark ML only.

A candidate is the value of an assignment to a name such as ``password`` or ``token``, or a run of key
characters with a digit, ``MIN_LENGTH`` characters or longer. Its features are its length, the shares
of character classes, class and consonant-vowel transitions, distinct characters, dictionary
coverage, the look of a path, address, identifier or date, and the words before and after it. A random
forest trained on labelled findings ``(before, value, after, label)`` scores each candidate; those of
``threshold`` or more are findings. Private key blocks always are.

The dictionary is the corpus: a value is cut into words at marks, digits and changes of case, and those
that ``WORD_DOCS`` or more documents hold as words count as covered, with the words of placeholders below.
Counts cover all documents; only words that stand in a candidate travel.

Findings of one's own are the training table of choice. ``labelled_findings`` makes the default one by
rule (``TRAIN_ROWS`` rows, a documented bound): keys of known and unknown shape in assignments against
commit ids, checksums, identifiers, addresses, paths, placeholders and numbers. The tests hold the forest
against shapes that the rules don't make.

Defined results: null text counts as empty and has no findings; repeated rows are each scanned; an
empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .pii import matches

MIN_LENGTH = 12
REACH = 32
TRAIN_ROWS = 6_000
TREES = 24
DEPTH = 7
SEED = 3
#: Documents that hold a word of the dictionary, and its fewest letters.
WORD_DOCS = 10
WORD_LETTERS = 3
NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)"
RUN = r"[A-Za-z0-9_/+=.@-]"
# A name may have a prefix (DB_PASSWORD, client_secret): what ends in one of NAMES is assigned to.
NAMED = rf"[A-Za-z0-9_/+.@-]*+(?<={NAMES})[\"']?\s{{0,3}}+[:=]\s{{0,3}}+[\"']?"
# Both branches start at the beginning of a run only; possessive parts keep long runs linear.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?<!{RUN})(?:{NAMED}[^\s\"',;]{{6,}}+|[A-Za-z_/+=.@-]*+[0-9]{RUN}*+)"
)
#: Words of placeholders; a value made of them is no secret, whatever the corpus holds.
DICTIONARY = (
    "example sample test demo dummy fake placeholder changeme default value your here insert none null true false undefined password passwd secret token "
    "public index page section chapter article image photo file data user name admin guest login home main content release version build module package "
    "request response handler factory service manager server client config lib usr src bin http https www com net org html"
).split()
SECRET_WORDS = r"(?i)(pass(word|wd)?|pwd|secret|token|key|credential|auth|bearer)"
HASH_WORDS = r"(?i)^(commit|revision|sha-?(1|256|512)?|md5|checksum|digest|integrity|etag|hash|uuid|guid|id|ref|blob|tree|version|build|serial|order|invoice|isbn)$"
FEATURES = "length digits upper lower symbols classes vowels distinct repeats dictionary hexlike path address uuid dated known assigned quoted secret_before hash_before word_after".split()


def parted(run: Column) -> tuple[Column, Column]:
    """Name and value of a candidate; the name is empty if nothing is assigned."""
    pattern = rf"^({NAMED}|[A-Za-z_.-]+[=:])(.+)$"
    name = F.regexp_extract(run, pattern, 1)
    return name, F.when(name != "", F.regexp_extract(run, pattern, 2)).otherwise(run)


def words_of(value: Column) -> Column:
    """Words of a value in lower case: letters between marks, digits and changes of case."""
    return F.transform(F.regexp_extract_all(value, F.lit(rf"\p{{Lu}}?\p{{Ll}}{{{WORD_LETTERS - 1},}}+|\p{{Lu}}{{{WORD_LETTERS},}}+"), 0), F.lower)


def covered_letters(rows: DataFrame, docs: DataFrame, text_col: str = "text", word_docs: int = WORD_DOCS) -> DataFrame:
    """Adds ``covered`` to rows with ``value``: letters in words that ``word_docs`` documents hold."""
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    pieces = numbered.select("_row", F.explode(words_of(F.col("value"))).alias("word"))
    texts = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}]+"))).alias("word"))
    texts = texts.where(F.length("word") >= WORD_LETTERS).groupBy("word").agg(F.count("*").alias("n"))  # counted within tasks before words travel
    known = texts.where(F.col("n") >= word_docs).join(pieces.select("word").distinct(), "word", "left_semi").select("word")
    covered = pieces.join(known, "word").groupBy("_row").agg(F.sum(F.length("word")).alias("covered"))
    return numbered.join(covered, "_row", "left").withColumn("covered", F.coalesce("covered", F.lit(0))).drop("_row")


def features(rows: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to rows with ``before, value, after`` and, from the corpus, ``covered``."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(v, pattern, ""))) / n

    shape = v
    for pattern, mark in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^aA0]", "-")):
        shape = F.regexp_replace(shape, pattern, mark)
    low = F.lower(v)
    placeholders = n - F.length(F.regexp_replace(low, "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))
    covered = F.greatest(placeholders, F.col("covered")) if "covered" in rows.columns else placeholders
    tail = F.regexp_extract(F.col("before"), r"([A-Za-z0-9_.-]+)[^A-Za-z0-9]*$", 1)
    columns = {
        "length": F.least(n, F.lit(200.0)),
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "symbols": share("[A-Za-z0-9]") * -1 + 1,
        "classes": (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / n,
        "vowels": F.regexp_count(low, F.lit("[b-df-hj-np-tv-z][aeiou]")) / n,
        "distinct": F.size(F.array_distinct(F.split(F.substring(v, 1, 200), ""))) / F.least(n, F.lit(200.0)),
        "repeats": (n - F.length(F.regexp_replace(v, r"(.)\1{3,}", ""))) / n,
        "dictionary": covered / n,
        "hexlike": low.rlike("^[0-9a-f]+$").cast("double"),
        "path": (F.regexp_count(v, F.lit("/[A-Za-z][A-Za-z0-9_.-]*")) / F.lit(4.0)),
        "address": (low.rlike(r"@[a-z0-9-]+\.") | low.rlike(r"^(\d+\.){3}\d+$") | low.rlike(r"\.(com|net|org|html?|py|js|json|txt|png|jpg)\b")).cast("double"),
        "uuid": low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").cast("double"),
        "dated": v.rlike(r"^v?\d{1,4}([-./:T]\d{1,4})+").cast("double"),
        "known": v.rlike(r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|sk_live_|AIza|eyJ|glpat-)").cast("double"),
        "assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": F.col("before").rlike(r"[\"']$").cast("double"),
        "secret_before": tail.rlike(SECRET_WORDS).cast("double"),
        "hash_before": tail.rlike(HASH_WORDS).cast("double"),
        "word_after": F.col("after").rlike(r"^[\"']?\s+[A-Za-z]{2,}").cast("double"),
    }
    return rows.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(before, value, after, label)``: the default training table, made by rule from a hash of the row."""
    h = F.sha2(F.concat(F.lit("finding:"), F.col("id").cast("string")), 256)
    h2 = F.sha2(F.concat(F.lit("other:"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(h))
    upper = F.upper(F.translate(F.base64(F.unhex(h2)), "+/=", "QZ"))

    def pick(words: list[str], salt: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    def size(low: int, high: int) -> Column:
        return (F.pmod(F.xxhash64("id", F.lit(99)), F.lit(high - low + 1)) + low).cast("int")

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    names = pick(["token", "password", "secret", "api_key", "access_key", "auth_token", "client_secret", "pwd"], 1)
    sign = pick([" = \"", "=", ": ", "=\"", ": '", " = "], 2)
    prose = pick(["the", "of", "and", "see", "page", "with", "in", "by", "from", "which", "under", "about"], 3)
    digits = F.translate(h, "abcdef", "012345")
    word = pick(["section", "chapter", "image", "release", "handler", "module", "package", "article", "photo", "version"], 4)
    kinds: list[tuple[int, Column, Column]] = [
        (1, text(names, sign), F.substring(h, 1, 40)),
        (1, text(names, sign), F.substr(h2, F.lit(1), size(12, 40))),
        (1, text(names, sign), F.substr(b64, F.lit(1), size(14, 43))),
        (1, text(names, sign), F.substr(F.translate(b64, "+/=", "-_"), F.lit(1), size(10, 30))),
        (1, text(prose, " "), text("AKIA", F.substring(upper, 1, 16))),
        (1, text(names, sign), text("AKIA", F.substring(upper, 5, 16))),
        (1, text(prose, " "), text(pick(["ghp_", "xoxb-", "sk-", "sk_live_", "AIza", "glpat-"], 5), F.substring(F.translate(b64, "+/=", "aZ9"), 1, 36))),
        (1, text(names, sign), F.substr(F.translate(b64, "+/=AEIOU", "!#%"), F.lit(1), size(12, 24))),
        (0, text(pick(["commit ", "revision ", "sha1 ", "sha1: ", "ref ", "blob ", "tree "], 6)), F.substring(h, 1, 40)),
        (0, text(pick(["md5 ", "md5: ", "checksum ", "checksum: ", "digest=", "etag=\"", "hash "], 6)), F.substring(h, 1, 32)),
        (0, text(pick(["sha256:", "sha256 ", "integrity=", "digest "], 6)), h),
        (0, text(pick(["id ", "uuid: ", "the ", "with "], 7)), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))),
        (0, text(prose, " "), F.substr(digits, F.lit(1), size(12, 19))),
        (0, text(prose, " "), F.concat_ws(".", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(256)).cast("string") for k in (21, 22, 23, 24)])),
        (0, text(prose, " "), text(prose, ".", F.substring(digits, 1, 2), "@mail", F.substring(digits, 3, 1), ".example.com")),
        (0, text(prose, " "), text("/usr/lib/", word, F.substring(digits, 1, 1), "/", prose, "/", word, ".py")),
        (0, text(names, sign), text(pick(["example", "changeme", "your_token_here", "password", "test_secret", "dummy_value", "placeholder", "default"], 8), F.substring(digits, 1, 3))),
        (0, text(prose, " "), text(F.initcap(word), "Request", F.initcap(prose), "Handler", F.substring(digits, 1, 1))),
        (0, text(prose, " "), text(word, "-", F.substring(digits, 1, 2), "-", prose, "-overview")),
        (0, text(prose, " "), text("20", F.substring(digits, 1, 2), "-0", F.substring(digits, 3, 1), "-1", F.substring(digits, 4, 1), "T1", F.substring(digits, 5, 1), ":2", F.substring(digits, 6, 1))),
        (0, text(prose, " "), text("www.", prose, "-site.example.com/page", F.substring(digits, 1, 2), "/", word, ".html")),
        (0, text(prose, " "), text(F.repeat(F.substring(h, 1, 1), 8), F.repeat(F.substring(digits, 2, 1), 8))),
        (0, text(names, sign), F.repeat(F.substring(digits, 2, 1), 14)),
        (0, text(prose, " "), text("v", F.substring(digits, 1, 1), ".", F.substring(digits, 2, 2), ".", F.substring(digits, 4, 1), "-beta.", F.substring(digits, 5, 2))),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))

    def choose(i: int) -> Column:
        out = F.lit(None)
        for k, c in reversed(list(enumerate(kinds))):
            out = F.when(kind == k, c[i] if i else F.lit(c[0])).otherwise(out)
        return out

    made = spark.range(0, rows, 1, 1).select(text(prose, " ", choose(1)).alias("before"), choose(2).alias("value"), choose(0).alias("label"))
    after = F.when(F.col("before").rlike("\"$"), F.lit("\" ")).when(F.col("before").rlike("'$"), F.lit("' ")).otherwise(F.lit(" "))
    return made.select("before", "value", F.concat(after, F.lit("the")).alias("after"), F.col("label").cast("double").alias("label"))


def fit(findings: DataFrame) -> RandomForestClassificationModel:
    """Trains the forest on labelled findings."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings.where("value is not null and label is not null")))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(rows)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, before, value, after)`` of every candidate; code points, end exclusive."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "spans", F.filter(matches(F.col("text"), CANDIDATE, "run"), lambda s: s["end"] - s["start"] >= 8)
    )
    cut = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("run"),
            F.substring(F.col("text"), (F.greatest(s["start"] - REACH, F.lit(0)) + 1).cast("int"), (s["start"] - F.greatest(s["start"] - REACH, F.lit(0))).cast("int")).alias("left"),
            F.substring(F.col("text"), (s["end"] + 1).cast("int"), F.lit(REACH)).alias("after"),
        ),
    )
    rows = found.where(F.size("spans") > 0).select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*")
    name, value = parted(F.col("run"))
    rows = rows.select(
        "doc_id", "end", F.concat("left", name).alias("before"), F.regexp_replace(value, r"[.=\"']+$", "").alias("value"), "after",
        (F.col("start") + F.length(name)).alias("start"),
    )
    block = F.col("value").startswith("-----BEGIN")
    long_enough = (F.length("value") >= MIN_LENGTH) | (F.col("before").rlike(rf"{NAMES}[\"']?\s*[:=]\s*[\"']?$") & (F.length("value") >= 6))
    return rows.where(block | long_enough).select("doc_id", "start", (F.col("start") + F.length("value")).alias("end"), "before", "value", "after")


def secrets(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, value, score)`` of the candidates that the forest keeps."""
    rows = features(covered_letters(candidates(docs, id_col, text_col), docs, text_col))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    score = F.when(F.col("value").startswith("-----BEGIN"), F.lit(1.0)).otherwise(vector_to_array("probability")[1])
    return scored.withColumn("score", score).where(F.col("score") >= threshold).select("doc_id", "start", "end", "value", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(labelled_findings(spark))
    found = secrets(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score")
