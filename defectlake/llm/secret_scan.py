"""Secret scan with a random forest that removes false positives, in DataFrame functions and Spark's own forest.

Candidates are long runs of key characters with a digit, and values of any length and signs that are assigned to the name of a secret or follow it. Their features are the length, changes between kinds of
characters, the share of letters in words of the corpus, the path, and words before and after. The forest is fitted to
labelled findings and gives every candidate the probability that it is a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_LENGTH = 16
TREES, DEPTH, SEED = 40, 8, 42
MAX_TRAINING = 50_000
DICTIONARY_SHARE = 0.001  # of documents that hold a word: bounds the dictionary by the mean number of words of a text
RUN = f"[A-Za-z0-9+/_\\-]{{{MIN_LENGTH},}}"

# Words beside secrets, words beside other long tokens, and paths of tests.
SECRET_WORDS = "token|password|passwd|pwd|secret|api.?key|access.?key|private.?key|auth|bearer|credential"
HARMLESS_WORDS = "sha|md5|hash|checksum|digest|commit|revision|uuid|guid|build|etag|example|sample|dummy|placeholder|changeme|xxxx"
TEST_PATHS = "test|example|sample|mock|fixture|demo|docs?"

FEATURES = ("length", "letter_digit", "case_changes", "digit_share", "upper_share", "hex_share", "distinct_share", "longest_letters", "coverage", "separators", "in_url", "path_depth", "path_test", "assigned", "quoted", "secret_before", "secret_near", "harmless_near")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, word_no, part_no, value, word, before, before2, after, path)`` of all candidates in whole texts.

    ``word_no`` counts the words of the text from 0, ``part_no`` the runs of a word and then its values that are no run. ``path`` names a column, if any.
    """
    place = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter(F.col("text").cast("string").rlike(f"{RUN}|(?i:{SECRET_WORDS})")).select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("path"), F.split(text, r"[\x20\x09-\x0D]+", -1).alias("words"))
    # Not only keys: what fits is told from the words around it, so these are gathered before words are told apart.
    near = lambda i, by: F.coalesce(F.get("words", i + by), F.lit(""))
    each = F.transform("words", lambda w, i: F.when((w.rlike(RUN) & w.rlike("[0-9]")) | F.concat_ws(" ", near(i, -2), near(i, -1), w).rlike(f"(?i){SECRET_WORDS}"), F.struct(i.alias("word_no"), w.alias("word"), near(i, -1).alias("before"), near(i, -2).alias("before2"), near(i, 1).alias("after"))))
    found = rows.select("doc_id", "path", F.inline(F.filter(each, lambda s: s.isNotNull())))
    # Values in the word of the name itself, or in the word after the name, with a sign of assignment between or none.
    inside = F.regexp_extract_all("word", F.lit(f"(?i)(?:{SECRET_WORDS})[\\w.\\-]*[\"'\\])]*(?:[:=]+>?)[\"']*([^\"']+)"), F.lit(1))
    named = f"(?i)(?:{SECRET_WORDS})[\\w.\\-]*[\"'\\])]*"
    follows = (F.col("before").rlike(f"{named}(?:[:=]+>?)?$") | (F.col("before").rlike("^[:=]+>?$") & F.col("before2").rlike(f"{named}$"))) & ~F.col("word").rlike("^[:=]+>?$")
    own = F.regexp_replace("word", "^[\"'(\\[{<]+", "")
    own = F.when(F.size(inside) == 0, F.when(follows, F.array(F.regexp_extract(own, "^[^\"']*", 0))))
    trimmed = F.transform(F.concat(inside, F.coalesce(own, F.array().cast("array<string>"))), lambda v: F.regexp_replace(v, "[,;.)\\]}>]+$", ""))
    found = found.withColumn("runs", F.regexp_extract_all("word", F.lit(RUN), F.lit(0))).withColumn("named", F.array_distinct(F.filter(trimmed, lambda v: v != "")))
    parts = F.transform("runs", lambda v, i: F.struct(i.alias("part_no"), v.alias("value"), (v.rlike("[0-9]") | F.array_contains("named", v)).alias("kept")))
    more = F.transform(F.array_except("named", "runs"), lambda v, i: F.struct((F.size("runs") + i).alias("part_no"), v.alias("value"), F.lit(True).alias("kept")))
    return found.select("doc_id", "word_no", "word", "before", "before2", "after", "path", F.inline(F.concat(parts, more))).filter("kept").drop("kept")


def dictionary(docs: DataFrame) -> DataFrame:
    """``(term)``: words of at least three letters that a share of all documents hold."""
    least = max(2, int(docs.count() * DICTIONARY_SHARE))
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 3))
    terms = docs.select(F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("term")


def _share(value: Column, kind: str) -> Column:
    return F.char_length(F.regexp_replace(value, f"[^{kind}]", "")) / F.char_length(value)


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``; ``words(term)`` is the dictionary, hashes of words."""
    value, word = F.col("value"), F.col("word")
    around = F.lower(F.concat_ws(" ", "before2", "before", word, "after"))
    # The key is what stands before the value in its word, or the words before a lone sign of assignment.
    lead = F.lower(F.expr("substring_index(word, value, 1)"))
    assigned = lead.rlike("[:=][\"']?$") | (lead.rlike("^[\"']?$") & F.col("before").rlike("[:=]$"))
    key = F.concat_ws(" ", F.when(F.col("before").rlike("^[:=]+$"), F.lower("before2")), F.when(F.col("before").rlike("[:=]$"), F.lower("before")), lead)
    longest = F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda x: F.char_length(x)))
    rows = found.select("*",
        F.char_length(value).cast("double").alias("length"),
        (F.regexp_count(value, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) / F.greatest(F.char_length(value) - 1, F.lit(1))).alias("letter_digit"),
        (F.regexp_count(value, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / F.greatest(F.char_length(value) - 1, F.lit(1))).alias("case_changes"),
        _share(value, "0-9").alias("digit_share"), _share(value, "A-Z").alias("upper_share"), _share(value, "0-9a-fA-F").alias("hex_share"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.char_length(value)).alias("distinct_share"), longest.cast("double").alias("longest_letters"), _share(value, "+/_\\-").alias("separators"),
        F.contains(word, F.lit("://")).cast("double").alias("in_url"), F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"), F.lower("path").rlike(TEST_PATHS).cast("double").alias("path_test"),
        assigned.cast("double").alias("assigned"), F.contains(word, F.concat(F.lit('"'), value)).cast("double").alias("quoted"),
        key.rlike(SECRET_WORDS).cast("double").alias("secret_before"), around.rlike(SECRET_WORDS).cast("double").alias("secret_near"), around.rlike(HARMLESS_WORDS).cast("double").alias("harmless_near"))
    # Dictionary coverage: letters in runs that are words of the corpus; each different run is looked up once.
    run = rows.select("value").distinct().select("value", F.explode(F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: F.char_length(w) >= 3)).alias("run"))
    covered = run.join(words, F.xxhash64("run") == F.col("term")).groupBy("value").agg(F.sum(F.char_length("run")).alias("covered"))
    rows = rows.join(covered, "value", "left")
    return rows.withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / F.char_length("value")).drop("covered")


def weak_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label``, null where neither rule holds: 1 for a value assigned to a name of a secret, 0 for one far from any such name or beside
    words of digests and examples. This stands in for findings labelled by hand, which the tables do not hold."""
    yes = (F.col("assigned") == 1) & (F.col("secret_before") == 1) & (F.col("harmless_near") == 0)
    no = (F.col("secret_near") == 0) | (F.col("harmless_near") == 1)
    return rows.withColumn("label", F.when(yes, 1.0).when(no, 0.0))


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector", handleInvalid="keep").transform(rows.fillna(0.0, list(FEATURES)))


def train(labelled: DataFrame, max_training: int = MAX_TRAINING) -> RandomForestClassificationModel | None:
    """Forest of labelled findings (columns of ``FEATURES`` and ``label``); a seeded hash picks about ``max_training`` of
    them, which is the documented bound. None where labels are of one kind only."""
    labelled = labelled.filter("label is not null")
    kinds = labelled.agg(F.count("*").alias("n"), F.countDistinct("label").alias("kinds")).first()
    if kinds["kinds"] < 2:
        return None
    sample = labelled.filter(F.pmod(F.xxhash64("value", "doc_id", "word_no", "part_no"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_training / kinds["n"])) + 1)
    if sample.agg(F.countDistinct("label")).first()[0] < 2:
        sample = labelled
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(_vector(sample))


def scan(docs: DataFrame, path: str | None = None, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """Candidates of all texts with their features, ``probability`` of a secret and ``secret`` (0.5 or more).

    Without ``model`` a forest is fitted to the weak labels of the candidates themselves. Where these are of one kind only,
    the label is the probability. Null and empty texts have no candidates; null and repeated doc_ids are scanned like
    others; other columns are not read.
    """
    rows = staged(weak_labels(features(staged(candidates(docs, path), "candidates"), staged(dictionary(docs), "dictionary"))), "features")
    model = model or train(rows)
    if model is None:
        return rows.withColumn("probability", F.coalesce("label", F.lit(0.0))).withColumn("secret", F.col("probability") >= 0.5)
    out = model.transform(_vector(rows)).withColumn("probability", vector_to_array("probability")[1])
    return out.drop("vector", "rawPrediction", "prediction").withColumn("secret", F.col("probability") >= 0.5)
