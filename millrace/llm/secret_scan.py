"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

Everything is a DataFrame expression. Texts that can hold a candidate are found by a cheap test;
only those are split at the candidates, so that each candidate has the text before and after it
and its offset. The forest (the library's own, trained on labelled findings) reads the candidate's
length, character classes and transitions, its cover by dictionary words, path and URL shapes, and
the words beside it. Its training set is bounded by ``findings`` rows and does not come from the
corpus.

Defined cases: null and empty texts have no findings; texts are scanned whole; a candidate that
occurs twice is two findings; rows that repeat are scanned each; a null doc_id is kept; only
``doc_id`` and ``text`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import runtime
from millrace.llm import secret_findings as known

_NAMES = r"passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|credentials?|bearer|auth|private[_-]?key"
#: What known kinds of keys begin with; these need no digit.
_PREFIXES = r"(?:AKIA|ASIA)[A-Z2-7]{16}|(?:gh[opsur]_|github_pat_|sk-|[prs]k_(?:live|test)_|xox[abeprs]-|glpat-|npm_|AIza|eyJ)[A-Za-z0-9_-]{12}"
#: A private key, a value assigned to a telling name (or behind one on a command line or in a
#: header), or a long token with a digit or a known beginning. Each search is linear in the text.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?>[\s\S]*?(?=-----(?:BEGIN|END) ))-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?<=[\s\"'=:>])(?:(?<=(?i:" + _NAMES + r")[\"']?\s{0,4}[=:]{1,2}>?\s{0,4}[\"']?)|(?<=(?i:\bbearer|\bauth|--?(?:token|password|secret|api-key))\s{1,2}[\"']?)(?=[^\s\"']*?(?:[0-9@#%&*$_]|[a-z0-9][A-Z]))|(?<=\s-u\s{0,2}[\"']?[^\s:\"']{1,64}:))"
    r"(?![=:>]|-----BEGIN)[^\s\"']{8,}?(?=[.,;)\]}]*+(?:[\s\"']|$|</[A-Za-z]|&[A-Za-z_]{1,30}=))"
    r"|(?<![A-Za-z0-9_+/-])(?=" + _PREFIXES + r"|[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"
)
_POSSIBLE = r"[0-9]|(?i:" + _NAMES + r")|PRIVATE KEY|\s-u|" + _PREFIXES
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def features() -> dict[str, Column]:
    """The forest's inputs, from columns ``before``, ``cand`` and ``after``."""
    c, low = F.col("cand"), F.lower("cand")
    near = F.lower(F.substring(F.col("before"), -40, 40))
    close = F.lower(F.substring(F.col("before"), -24, 24))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    words = "|".join(sorted({w for w in known.DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w)))
    return {
        "length": F.least(n, F.lit(300.0)),
        "digits": _count(c, "[0-9]") / n,
        "upper": _count(c, "[A-Z]") / n,
        "lower": _count(c, "[a-z]") / n,
        "transitions": _count(c, "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]") / n,
        "pairs": _count(low, f"(?=(?:{_PAIRS}))") / n,
        "distinct": F.size(F.array_distinct(F.split(F.substring(c, 1, 128), ""))).cast("double") / F.least(n, F.lit(128.0)),
        "runs": _count(c, r"(.)\1\1") / n,
        "dictionary": (n - F.length(F.regexp_replace(low, words, ""))) / n,
        "hex": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "uuid": c.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "number": c.rlike("^[0-9_+/=-]+$").cast("double"),
        "pem": c.startswith("-----BEGIN").cast("double"),
        "slashes": _count(c, "/") / n,
        "dashes": _count(c, "[-_]") / n,
        "path": (F.col("before").rlike(r"[/\\.]$") | F.col("after").rlike(r"^(?:/|\.[a-z]{1,5}\b)")).cast("double"),
        "url": near.rlike(r"://[^\s]*$").cast("double"),
        "named": close.rlike(_NAMES).cast("double"),
        "assigned": close.rlike(r"[=:]\s{0,3}[\"'`]?$").cast("double"),
        "harmless": near.rlike(r"\b(?:" + "|".join(known.HARMLESS_NAMES) + r")\b|base64,").cast("double"),
        "placeholder": low.rlike("example|sample|dummy|your|insert|placeholder|xxxx|changeme|1234567890").cast("double"),
        "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
    }


_trained: dict[tuple, RandomForestClassificationModel] = {}


def train(spark: SparkSession, rows: list[dict] | None = None, *, findings: int = 1600, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, cand, after, label); composed ones unless given."""
    key = (spark.sparkContext.applicationId, findings, trees, depth)
    if rows is None and key in _trained:
        return _trained[key]
    source = rows or known.labelled(findings)
    kind = "array<struct<before: string, cand: string, after: string, label: double>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(source)), kind)))
    names = list(features())
    frame = table.select("label", *[v.alias(k) for k, v in features().items()])
    frame = VectorAssembler(inputCols=names, outputCol="features").transform(frame).select("label", "features").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8).fit(frame)
    if rows is None:
        _trained[key] = model
    return model


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, th (xxhash64 of the text), place, start, end (code points, end exclusive), before, cand, after."""
    docs = runtime.pick(documents, doc_id="long", text="string").where(F.col("text").rlike(_POSSIBLE) & F.col("text").rlike(CANDIDATE))
    parts = docs.select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("cands"),
        F.split("text", CANDIDATE, -1).alias("between"),
    )
    each = F.transform("cands", lambda c, i: F.struct(F.length(F.col("between")[i]).alias("gap"), F.length(c).alias("size"), F.substring(F.col("between")[i], -60, 60).alias("before"), c.alias("cand"), F.substring(F.col("between")[i + 1], 1, 30).alias("after")))
    rows = parts.select("doc_id", "th", "row", F.posexplode(each).alias("place", "x")).select("doc_id", "th", "row", "place", "x.*")
    return _placed(rows)


def _placed(rows: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).drop("row", "gap", "size")


def scan(documents: DataFrame, model: RandomForestClassificationModel | None = None, *, threshold: float = 0.5) -> DataFrame:
    """Every candidate: doc_id, th, start, end, cand, probability, is_secret."""
    forest = model or train(documents.sparkSession)
    found = candidates(documents)
    inputs = found.select("doc_id", "th", "start", "end", "cand", *[v.alias(f"f_{k}") for k, v in features().items()])
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in features()], outputCol="features").transform(inputs)
    judged = forest.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "th", "start", "end", "cand", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(documents: DataFrame, model: RandomForestClassificationModel | None = None, *, mark: str = "<SECRET>", threshold: float = 0.5) -> DataFrame:
    """``documents`` with each secret in ``text`` replaced by ``mark``; all other rows and columns as they are."""
    found = scan(documents, model, threshold=threshold).where("is_secret")
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))), asc=False).alias("_spans"))
    text = F.col("text")
    cut = F.aggregate("_spans", text, lambda t, x: F.concat(t.substr(F.lit(1), x["s"].cast("int")), F.lit(mark), t.substr(x["e"].cast("int") + 1, F.length(t))))
    joined = documents.withColumn("_th0", F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th0") == F.col("_th")), "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), text).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])
