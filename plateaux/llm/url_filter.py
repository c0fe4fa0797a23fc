"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Only DataFrame functions and Spark's own tree learner are used. The trees learn from labelled URLs, which are those that a
rule decides, at most ``SAMPLE`` of each verdict, the first by a hash of the URL. Features: lengths of URL, host and path,
host labels, path depth, share of digits, entropy of characters, parameters, fragment, hyphens, scheme, and for the host's
last label and the path's first segment the smoothed share of blocked labelled URLs, for a labelled URL counted over the
other folds only (folds by host). The labels are the rules' own verdicts, so what the trees say of other hosts carries the
rules' habits over to them; no table holds an independent truth to measure that by. ``held_out_accuracy`` measures how well
the trees tell the rules' verdicts on hosts of a fold that they did not see.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no rule, and is judged by the trees. Repeated
rows are judged each on its own, very long URLs whole. With labelled URLs of one verdict or none, what no rule decides is allowed. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, stored

#: The rules, as (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SAMPLE = 5000
TREES, DEPTH = 20, 4
FEATURES = ["url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "params", "fragment", "hyphens", "https", "suffix_rate", "segment_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(found(1), string.ascii_uppercase, string.ascii_lowercase), found(2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule stands before shorter ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc + F.when((c == "") | (share(c) <= 0), 0.0).otherwise(-share(c) * F.log2(share(c))))


def lexical(pages: DataFrame) -> DataFrame:
    """The row's keys, host, path, rule and verdict of the rules, and features that need only the URL."""
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(F.col("host"), F.col("path"))
    url = F.col("url")
    after = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    number = lambda c: c.cast("double")
    return split.withColumns({
        "rule": rule, "ruled": verdict,
        "url_length": number(F.length("url")), "host_length": number(F.length("host")), "path_length": number(F.length("path")),
        "labels": number(F.size(F.split("host", r"\."))), "depth": number(F.length(F.regexp_replace("path", "[^/]", ""))),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)), "entropy": _entropy(url),
        "params": F.when(after == "", 0.0).otherwise(number(F.length(F.regexp_replace(after, "[^&]", "")) + 1)), "fragment": number(url.contains("#")),
        "hyphens": number(F.length(F.regexp_replace("host", "[^-]", ""))), "https": number(url.startswith("https:")),
        "suffix": F.substring_index("host", ".", -1), "segment": F.regexp_extract("path", "^/?([^/]*)", 1),
    })


FOLDS = 5


def _fold() -> Column:
    """The fold of a URL, by its host, so that URLs of one host share it."""
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """For each value of a key with at least ten labelled URLs the smoothed shares of blocked ones: over all (``rate``),
    and without each fold (``others``)."""
    blocked = (F.col("ruled") == "block").cast("double")
    per_fold = [(F.sum(F.when(_fold() == k, blocked)), F.count(F.when(_fold() == k, 1))) for k in range(FOLDS)]
    share = lambda b, n: (b + 1) / (n + 2)
    none = F.lit(0.0)
    b, n = F.sum(blocked), F.count("*")
    found = labelled.groupBy(key).agg(n.alias("n"), share(b, n).alias("rate"), F.array(*[share(b - F.coalesce(x, none), n - y) for x, y in per_fold]).alias("others"))
    return stored(found.where("n >= 10").drop("n"), f"{key}-rates")


def judge(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of block (null where a rule decides)."""
    scored = _scored(lexical(pages), F.lit(True), sample)
    decided = F.when(F.col("block") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", decided).alias("verdict"), F.when(F.col("rule").isNull(), F.col("block")).alias("block_score"))


def held_out_accuracy(pages: DataFrame, sample: int = SAMPLE) -> float | None:
    """The share of the rules' verdicts on the first fold's hosts that trees fitted on the other folds give."""
    rows = lexical(pages)
    held = _fold() == 0
    seen = rows.withColumn("ruled", F.when(~held, F.col("ruled")))
    truth = rows.where(held & F.col("ruled").isNotNull()).select("page_id", F.col("ruled").alias("truth"))
    found = _scored(seen, ~held, sample).where(held).join(truth, "page_id")
    return found.agg(F.avg(((F.col("block") >= 0.5) == (F.col("truth") == "block")).cast("double"))).first()[0]


def _scored(rows: DataFrame, usable: Column, sample: int) -> DataFrame:
    """The rows with the trees' probability of block; they learn from usable rows that a rule decides."""
    labelled = rows.where(usable & F.col("ruled").isNotNull())
    full = rows
    for key in ("suffix", "segment"):
        rates = _rates(labelled, key)
        full = full.join(F.broadcast(rates) if fits_broadcast(rates, 128) else rates, key, "left")
        # a labelled URL sees only what other folds say of its suffix and segment
        own = F.when(F.col("ruled").isNotNull(), F.element_at("others", _fold() + 1)).otherwise(F.col("rate"))
        full = full.withColumn(f"{key}_rate", F.coalesce(own, F.lit(0.5))).drop("rate", "others")
    full = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)
    known = full.where(usable & F.col("ruled").isNotNull()).select((F.col("ruled") == "block").cast("double").alias("label"), "features", "url")
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(sample) for k in (0.0, 1.0)]
    train = stored(picked[0].union(picked[1]).select("label", "features"), "labelled-urls")
    if train.select("label").distinct().count() < 2:
        scored = full.withColumn("block", F.lit(0.0))
    else:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, maxMemoryInMB=64).fit(train)
        scored = model.transform(full).withColumn("block", vector_to_array("probability")[1])
    return scored
