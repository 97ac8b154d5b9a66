"""Secret scans: a random forest drops false positives among candidate strings, in DataFrame functions only.

Candidates are long runs of key-like characters that hold a digit, or are very long, and whatever is assigned to a word that
announces a credential: all that stands between quotes, or up to the next blank, of at least ``LEAST_ASSIGNED`` characters.
A forest over the candidate's
length, its character transitions, its dictionary coverage, its path and its neighbouring words is trained from
labelled findings and scores every distinct candidate.

Corpus statistics cover all documents: word counts give the dictionary (the ``DICTIONARY`` most frequent words) and
the log-probabilities of transitions between adjacent letters. Only the labelled findings that the forest is fitted on are
a bounded sample (``MAX_FINDINGS``, the first by hash); every candidate is scored.

Defined results: a NULL or empty text has no candidates; a NULL path counts as an empty one. The same string in the
same surroundings is one row per document, with its number of occurrences. Repeated rows add occurrences. NULL ids are
a document of their own. If findings of both classes are missing, nothing can be learnt and every candidate is
kept with probability NULL. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.llm.scratch import stored

KEYISH = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{KEYISH}])(?:(?=[{KEYISH}]*[0-9])[{KEYISH}]{{16,}}+|[{KEYISH}]{{28,}}+)"
#: Words that announce a credential: fixed values.
TELLING_WORDS = r"(?:pass(?:word|wd)?|secret|token|api_?key|access_?key|auth|credential)"
LEAST_ASSIGNED = 6
#: What is assigned to a telling word: quoted, or up to a blank, less the signs that close a statement.
ASSIGNED = (
    rf"(?<![A-Za-z_])(?=[A-Za-z_]{{0,30}}?(?i:{TELLING_WORDS}))([A-Za-z_]{{1,30}})[\"']?[ \t]{{0,3}}[:=]>?[ \t]{{0,3}}"
    rf"(?:\"([^\"\r\n]{{{LEAST_ASSIGNED},}}+)\"|'([^'\r\n]{{{LEAST_ASSIGNED},}}+)'|([^\s\"']\S{{{LEAST_ASSIGNED - 2},}}[^\s\"',;)\]}}>]))"
)
#: A candidate with the word before it, an assignment between them, and the character after it.
IN_CONTEXT = rf"(?:([A-Za-z_]{{1,30}})[ \t\"']{{0,3}}([:=]?)[ \t\"']{{0,3}})?({CANDIDATE})(=*+)"
DICTIONARY = 20_000
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 6, 7
PIECES = (3, 4, 5, 6, 7, 8)
#: Path patterns where findings are likely noise, and words that announce a credential: fixed values.
NOISY_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"
TELLING = rf"(?i){TELLING_WORDS}"
FEATURES = (
    "length", "classes", "transitions", "digit_share", "upper_share", "distinct_share",
    "surprise", "coverage", "noisy_path", "telling_word", "assigned", "word_before",
)


def found(docs: DataFrame, path: Column) -> DataFrame:
    """``doc_id, path, candidate, before, assigned, n``: candidates of every whole text."""
    per_text = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), "text").filter(
        F.regexp_like("text", F.lit(CANDIDATE)) | F.regexp_like("text", F.lit(ASSIGNED))
    )
    either = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(IN_CONTEXT), 0), lambda h: _parts(h)),
        # A key-like run that is found as such is not listed again.
        F.filter(
            F.transform(F.regexp_extract_all("text", F.lit(ASSIGNED), 0), lambda h: _assigned_parts(h)),
            lambda c: ~F.regexp_like(c["candidate"], F.lit(rf"^(?:{CANDIDATE})=*$")),
        ),
    )
    hit = per_text.select("doc_id", "path", F.explode(either).alias("hit")).select("doc_id", "path", "hit.*")
    return hit.groupBy("doc_id", "path", "candidate", "before", "assigned").agg(F.count("*").alias("n"))


def _parts(hit: Column) -> Column:
    return F.struct(
        F.regexp_extract(hit, IN_CONTEXT, 3).alias("candidate"),
        F.lower(F.regexp_extract(hit, IN_CONTEXT, 1)).alias("before"),
        (F.regexp_extract(hit, IN_CONTEXT, 2) != "").alias("assigned"),
    )


def _assigned_parts(hit: Column) -> Column:
    return F.struct(
        F.concat(*(F.regexp_extract(hit, ASSIGNED, k) for k in (2, 3, 4))).alias("candidate"),
        F.lower(F.regexp_extract(hit, ASSIGNED, 1)).alias("before"),
        F.lit(True).alias("assigned"),
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of the letter runs of all texts, lower-cased."""
    letters = F.split(F.lower("text"), r"[^\p{L}]+")
    return docs.select(F.explode(letters).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def transitions(counts: DataFrame) -> DataFrame:
    """``pair, logp``: how likely a letter is after another, from all words."""
    pairs = (
        counts.filter(F.length("word") > 1)
        .select("n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))")).alias("pair"))
        .filter(F.regexp_like("pair", F.lit("^[a-z]{2}$")))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .withColumn("first", F.substring("pair", 1, 1))
    )
    totals = pairs.groupBy("first").agg(F.sum("n").alias("total"))
    return pairs.join(F.broadcast(totals), "first").select("pair", F.log(F.col("n") / F.col("total")).alias("logp"))


def features(candidates: DataFrame, counts: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """``candidates`` with the columns of ``FEATURES``; the string's own ones are computed once per distinct string."""
    strings = candidates.select("candidate").distinct().withColumn("low", F.lower("candidate"))
    moves = F.broadcast(transitions(counts))  # at most 26 * 26 rows
    words = F.broadcast(  # at most ``dictionary`` rows
        counts.filter("n > 1").filter(F.length("word").between(min(PIECES), max(PIECES))).orderBy(F.desc("n"), "word").limit(dictionary).select("word")
    )
    surprise = (
        strings.select("candidate", F.explode(F.expr("transform(sequence(1, length(low) - 1), i -> substr(low, i, 2))")).alias("pair"))
        .join(moves, "pair", "left")
        .groupBy("candidate")
        .agg(F.avg(-F.coalesce("logp", F.lit(-12.0))).alias("surprise"))
    )
    covered = (
        strings.select("candidate", "low", F.explode(F.array(*map(F.lit, PIECES))).alias("k"))
        .filter("length(low) >= k")
        .select("candidate", "k", F.posexplode(F.expr("transform(sequence(1, length(low) - k + 1), i -> substr(low, i, k))")).alias("at", "word"))
        .join(words, "word")
        .select("candidate", F.explode(F.expr("sequence(at, at + k - 1)")).alias("place"))
        .groupBy("candidate")
        .agg(F.count_distinct("place").alias("n_covered"))
    )
    n = F.length("candidate")
    runs = F.regexp_count("candidate", F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"))
    own = (
        strings.join(surprise, "candidate", "left")
        .join(covered, "candidate", "left")
        .select(
            "candidate",
            n.cast("double").alias("length"),
            F.expr("cast(candidate RLIKE '[a-z]' AS double) + cast(candidate RLIKE '[A-Z]' AS double) + cast(candidate RLIKE '[0-9]' AS double) + cast(candidate RLIKE '[^A-Za-z0-9]' AS double)").alias("classes"),
            ((runs - 1) / (n - 1)).alias("transitions"),
            (F.regexp_count("candidate", F.lit("[0-9]")) / n).alias("digit_share"),
            (F.regexp_count("candidate", F.lit("[A-Z]")) / n).alias("upper_share"),
            (F.size(F.array_distinct(F.split("candidate", ""))) / n).alias("distinct_share"),
            F.coalesce("surprise", F.lit(12.0)).alias("surprise"),
            (F.coalesce("n_covered", F.lit(0)) / n).alias("coverage"),
        )
    )
    return (
        candidates.join(own, "candidate")
        .withColumn("noisy_path", F.regexp_like("path", F.lit(NOISY_PATH)).cast("double"))
        .withColumn("telling_word", F.regexp_like("before", F.lit(TELLING)).cast("double"))
        .withColumn("assigned", F.col("assigned").cast("double"))
        .withColumn("word_before", (F.col("before") != "").cast("double"))
    )


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train(rows: DataFrame, label: Column, limit: int = MAX_FINDINGS) -> RandomForestClassificationModel | None:
    """A forest on at most ``limit`` distinct labelled findings; ``label`` is 1, 0 or NULL for unlabelled rows."""
    findings = (
        rows.withColumn("label", label.cast("double"))
        .filter("label IS NOT NULL")
        .dropDuplicates(["candidate", "before", "label"])
        .orderBy(F.xxhash64("candidate", "before"), "candidate", "before")
        .limit(limit)
    )
    findings = stored(findings, "findings")
    if findings.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(_vectors(findings))


def scored(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    if model is None:
        return rows.withColumn("probability", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    out = model.transform(_vectors(rows)).withColumn("p", vector_to_array("probability")[1])
    return out.drop("probability", "rawPrediction", "prediction", "features").withColumnRenamed("p", "probability").withColumn(
        "is_secret", F.col("probability") >= 0.5
    )


def scan(docs: DataFrame, path: Column, label: Column, dictionary: int = DICTIONARY, limit: int = MAX_FINDINGS) -> DataFrame:
    """``doc_id, path, candidate, before, n, probability, is_secret`` of every candidate.

    ``label`` is an expression over the columns of ``features`` that says what is known of a finding.
    """
    candidates = stored(found(docs, path), "candidates")
    counts = stored(word_counts(docs), "words")
    rows = stored(features(candidates, counts, dictionary), "features")
    return scored(rows, train(rows, label, limit)).select("doc_id", "path", "candidate", "before", "n", "probability", "is_secret")
