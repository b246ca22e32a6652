"""Secrets in texts: candidates by form, judged by a random forest. DataFrame functions only.

A candidate is a *core* of a token, that is of a run without blanks: a run of letters, digits and ``_+/=-`` that has
``MIN_CHARS`` characters or more and a digit. A token has any number of them; ``part`` numbers its cores. Its features:

* length, shares of digits, capitals, hexadecimal digits and vowels, distinct characters,
* transitions between kinds of characters, per character,
* dictionary coverage: the share of its characters in letter runs that are words of the corpus (of
  ``MIN_WORD`` letters or more, found at least ``MIN_COUNT`` times in all texts),
* the path: its depth, whether it names tests or samples, and a hash bucket,
* the neighbours: an assignment before it or quotes around it, a keyword in it, between it and the core before it, or
  in the two neighbours before it, and hash buckets of the neighbours before and after it. Neighbours are the token's
  other cores and beyond these the other tokens.

The forest learns from labelled findings: candidates of a known format are positive, wherever they stand in a core, numbers,
addresses and dictionary words negative; all others are unlabelled, and the forest decides. It is fitted on a bounded
sample, up to ``SAMPLE / 2`` distinct labelled candidates of each kind, chosen by hash, that no held-out document
contributes to; every candidate of every text is then judged.

Words are counted with map-side sums, candidates' letter runs are reduced to distinct candidates before
they meet the word counts, and a candidate that many texts share is one row until it is joined back, where
adaptive execution splits its rows.

Defined results: null and empty texts have no candidates; a null path counts as an empty one; each row is
scanned alone, so repeated rows give repeated findings; without labelled findings of both kinds, known
formats have probability 1 and all others 0; empty tables give an empty result; further columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import stored

MIN_CHARS = 16
MIN_WORD = 3
MIN_COUNT = 5
SAMPLE = 20_000
TREES = 30
DEPTH = 8
BUCKETS = 32

# Formats of issued keys, and words that announce a secret.
KNOWN_FORMATS = [
    r"^AKIA[0-9A-Z]{16}$",
    r"^gh[pousr]_[0-9A-Za-z]{36}$",
    r"^xox[abprs]-[0-9A-Za-z-]{10,}$",
    r"^sk_live_[0-9A-Za-z]{16,}$",
    r"^(?i)(?:password|passwd|secret|token|api_?key)=[0-9a-f]{16,}$",
]
KEYWORDS = "token|secret|passw|pwd|api_?key|apikey|auth|bearer|credential|private"
SAMPLE_PATHS = "test|example|sample|fixture|mock"

# The formats inside a longer core, as in NAME=value.
_INSIDE = [f"(?<![0-9A-Za-z])(?:{x.removeprefix('^').removesuffix('$')})(?![0-9A-Za-z])" for x in KNOWN_FORMATS]

_CORE = f"[A-Za-z0-9_+/=-]{{{MIN_CHARS},}}"
_BLANKS = r"[\x20\x09-\x0D]+"

FEATURES = [
    "n_chars", "digits", "capitals", "hexadecimal", "vowels", "distinct", "transitions", "coverage",
    "path_depth", "path_sample", "path_bucket", "assigned", "quoted", "keyword", "before_bucket", "after_bucket",
]


def held_out(doc_id: Column) -> Column:
    """Documents whose findings the forest does not learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: ``doc_id, path, position, part, core, lead, tail, before, earlier, after``."""
    tokens = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(path), F.lit("")).alias("path"),
        F.split(F.coalesce(F.col(text), F.lit("")), _BLANKS).alias("tokens"),
    )

    def token(i: Column) -> Column:
        return F.coalesce(F.get("tokens", i), F.lit(""))

    places = F.filter(
        F.transform("tokens", lambda t, i: F.when((F.length(t) >= MIN_CHARS) & t.rlike(_CORE) & t.rlike("[0-9]"), i)),
        lambda i: i.isNotNull(),
    )
    found = tokens.select("doc_id", "path", "tokens", F.explode(places).alias("position"))
    at = F.col("position")
    found = found.select(
        "doc_id", "path", "position", token(at).alias("token"),
        token(at - 1).alias("before"), token(at - 2).alias("earlier"), token(at + 1).alias("after"),
    )
    cores, gaps = F.regexp_extract_all("token", F.lit(f"({_CORE})")), F.split("token", _CORE)
    n = F.size(cores)
    # What belongs to one core, side by side, so that no row keeps a long token.
    sides = {
        "core": cores,
        "lead": F.slice(gaps, 1, n),
        "tail": F.slice(gaps, 2, n),
        "before": F.slice(F.concat(F.array("before"), cores), 1, n),
        "earlier": F.slice(F.concat(F.array("earlier", "before"), cores), 1, n),
        "after": F.concat(F.slice(cores, 2, n), F.array("after")),
    }
    found = found.select("doc_id", "path", "position", *(v.alias(k) for k, v in sides.items()))
    found = found.select("doc_id", "path", "position", F.posexplode(F.arrays_zip(*sides)).alias("part", "near"))
    return found.select("doc_id", "path", "position", "part", "near.*").filter(F.col("core").rlike("[0-9]"))


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words of letters that the texts have at least ``MIN_COUNT`` times."""
    words = docs.select(F.explode(F.split(F.col(text), _BLANKS)).alias("word"))
    words = words.filter(F.col("word").rlike(f"^[A-Za-z]{{{MIN_WORD},}}$")).select(F.lower("word").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT).select("word")


def coverage(cores: DataFrame, words: DataFrame) -> DataFrame:
    """``core, covered``: characters of each distinct core in letter runs that are words."""
    pieces = cores.select("core").distinct()
    runs = F.regexp_extract_all(F.lower("core"), F.lit(f"([a-z]{{{MIN_WORD},}})"))
    found = pieces.select("core", F.explode(runs).alias("word")).join(words, "word")
    return found.groupBy("core").agg(F.sum(F.length("word")).alias("covered"))


def features(found: DataFrame, covered: DataFrame) -> DataFrame:
    """The candidates with the columns of ``FEATURES``."""
    n = F.length("core")
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = F.translate("core", lower + upper + "0123456789+/=_-", "a" * 26 + "A" * 26 + "9" * 10 + "-" * 5)

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace("core", pattern, "")) / n

    def bucket(value: Column) -> Column:
        return F.pmod(F.hash(F.lower(value)), F.lit(BUCKETS)).cast("double")

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    near = F.lower(F.concat_ws(" ", "earlier", "before", "lead"))
    joined = found.join(covered, "core", "left")
    return joined.withColumns(
        {
            "n_chars": n.cast("double"),
            "digits": share("[^0-9]"),
            "capitals": share("[^A-Z]"),
            "hexadecimal": share("[^0-9A-Fa-f]"),
            "vowels": share("[^aeiouAEIOU]"),
            "distinct": F.size(F.array_distinct(F.split("core", ""))) / n,
            "transitions": F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) / n,
            "coverage": F.coalesce("covered", F.lit(0)) / n,
            "path_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
            "path_sample": flag(F.lower("path").rlike(SAMPLE_PATHS)),
            "path_bucket": bucket(F.col("path")),
            "assigned": flag(near.rlike(r"[=:]\W*$")),
            "quoted": flag(F.concat("lead", "core", "tail").rlike("""["'`].*["'`]""")),
            "keyword": flag(F.concat_ws(" ", near, F.lower("core")).rlike(KEYWORDS)),
            "before_bucket": bucket(F.col("before")),
            "after_bucket": bucket(F.col("after")),
        }
    )


def rule_label(found: DataFrame) -> DataFrame:
    """The column ``label``: 1 for known formats, 0 for what is surely none, null for all others."""
    known = F.lit(False)
    for pattern in _INSIDE:
        known = known | F.col("core").rlike(pattern)
    assigned = (F.col("assigned") == 1) | F.col("core").contains("=")
    issued = F.col("core").rlike("^(?i)(?:.*=)?[0-9a-f]{32,64}$") & (F.col("keyword") == 1) & assigned
    number = F.col("core").rlike("^[0-9_+/=-]+$")
    address = F.concat("lead", "core", "tail").rlike(r"[\w.+-]+@[\w-]+\.\w+|^\W*https?://")
    none = number | address | (F.col("coverage") >= 0.5)
    return found.withColumn("label", F.when(known | issued, 1.0).when(none, 0.0)).withColumn("known", known | issued)


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Candidates with ``probability`` and ``is_secret``.

    ``labelled`` gives findings as ``doc_id, position, part, label``; without it known formats label them. If it has no
    ``part``, a label is that of a token's only candidate, and 0 also that of several.
    """
    found = candidates(docs, doc_id, text, path)
    covered = coverage(found, dictionary(docs, text))
    judged = stored(rule_label(features(found, covered)))
    if labelled is not None:
        keys = ["doc_id", "position", *(c for c in labelled.columns if c == "part")]
        own = labelled.select(*keys, F.col("label").cast("double").alias("label"))
        if "part" not in keys:
            several = judged.groupBy(*keys).agg(F.count_distinct("part").alias("n")).filter("n > 1").select(*keys)
            own = own.filter("label = 0").unionByName(own.filter("label = 1").join(several, keys, "left_anti"))
        judged = stored(judged.drop("label").join(own, keys, "left"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    vectors = assembler.transform(judged)
    learnable = judged.filter(~held_out(F.col("doc_id")) & F.col("label").isNotNull()).select("core", *FEATURES, "label").distinct()
    kinds = {r.label for r in learnable.select("label").distinct().limit(3).collect()}
    if len(kinds) < 2:
        probability = F.col("known").cast("double")
        scored = vectors.withColumn("probability", probability)
    else:
        drawn = [learnable.filter(F.col("label") == k).orderBy(F.xxhash64("core", *FEATURES)).limit(SAMPLE // 2) for k in sorted(kinds)]
        sample = stored(reduce(DataFrame.unionByName, drawn).coalesce(1))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11).fit(assembler.transform(sample))
        scored = forest.transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "position", "part", "core", "known", "label", *FEATURES, F.round("probability", 6).alias("probability"),
        (F.col("probability") >= 0.5).alias("is_secret"),
    )
