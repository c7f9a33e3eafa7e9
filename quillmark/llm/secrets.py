"""Secret scan with a random forest that removes false positives.

1. Candidates, with position and the text around them: whatever a credential name assigns (behind ``=`` or ``:``, up to
   the closing quote, or to white space where there is none), of any length; and runs of key characters, at least 20
   long, or 12 with a digit.  A run ``name=value`` is a candidate ``value`` whose name belongs to the context.
2. Features of every candidate: length; character classes, changes between
   them and the mean log-probability of its character transitions in prose;
   share covered by dictionary words; signs of a path, address or number; signs
   of neighbouring words (credential names, assignment, quotes, and how much the
   word before speaks for a secret among the labelled findings).
3. A random forest trained on labelled findings scores every candidate.

Only DataFrame and SQL functions and the JVM-side ML library are used.

Labelled findings are a table (doc_id, start, label).  ``confirmed`` derives one
from the candidates themselves where no hand labels exist: a finding whose
format leaves no doubt is labelled, everything else is left to the forest.

Bounds: the forest, the transition table, the dictionary and the word evidence are
fitted on at most ``sample`` labelled findings a class (those with the smallest
hash); every candidate of every text is scored.

Defined cases: a null or empty text has no candidate; a null ``doc_id`` is
kept; repeated rows give repeated findings; a text of any length is scanned in time that grows with it, each of its
candidates being a row of its own; extra columns are left out of a scan, whatever their names; without labels of both kinds
nothing can be trained and a finding is a secret if ``confirmed`` says so; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import stage

# Characters of keys, names of credentials, formats beyond doubt.
KEY = "A-Za-z0-9+/_=@:.-"
CREDENTIAL = (r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|"
              r"private[_-]?key|client[_-]?id)")
SPACE = " \\t\\n\\x0B\\f\\r"
NAMED = (rf"[A-Za-z0-9_.-]{{0,32}}?(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|"
         rf"private[_-]?key|client[_-]?id)(?:s|[A-Z0-9_-][A-Za-z0-9_-]{{0,32}})?[\"']?[ \t]{{0,4}}[=:]{{1,2}}[ \t]{{0,4}}")
VALUE = rf"(?:\"[^\"\n]++|'[^'\n]++|[^{SPACE}\"'=:][^{SPACE}\"']*+)"
CANDIDATE = f"(?<![{KEY}])(?:{NAMED}{VALUE}|[{KEY}]{{20,}}+|(?=[A-Za-z+/_=@:.-]*[0-9])[{KEY}]{{12,}}+)"
ASSIGNED = CREDENTIAL + r"[A-Za-z0-9_-]*[\"']?[ \t]*[=:]+[ \t]*[\"']?$"
PASSWORD = r"(?i)(pass(word|wd|phrase)?|pwd|secret)[\"']?[ \t]*[=:]+[ \t]*[\"']?$"
VENDOR = (r"^((AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|"
          r"AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{24,})$")
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}(:\d+)?|[^@]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|https?:.*|[+(]?\d[\d.()-]*)$"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
CONTEXT = 64

FEATURES = ["length", "digits", "uppers", "lowers", "others", "hex", "changes", "case_changes", "transitions",
            "distinct", "dictionary", "slashes", "dots", "address", "path_before", "named", "assigned", "quoted",
            "evidence"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, start, value, before, after): every candidate; ``start`` counts code points from 0.

    Every candidate is a row with its own length and its gap's; a window over the text's candidates adds them up to places.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.monotonically_increasing_id().alias("row"),
                       F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("runs"),
                       F.split("text", CANDIDATE, -1).alias("gaps"))
    rows = rows.select("doc_id", "rid", "row", "runs", F.expr(f"""transform(gaps, g -> struct(
        char_length(g) AS n, right(g, {CONTEXT}) AS tail, left(g, {CONTEXT}) AS head))""").alias("gaps"))
    # an outer explode: no filter on the runs is pushed below it, which would scan every text twice
    rows = rows.select("doc_id", "rid", "row", F.posexplode_outer(F.expr("""
        transform(runs, (r, i) -> struct(r AS run, gaps[i].tail AS before, gaps[i + 1].head AS after, gaps[i].n AS gap))
        """)).alias("k", "c")).where("c is not null")
    rows = stage(rows.select("doc_id", "rid", "row", "k", "c.*"), "secret_runs")
    upto = F.sum(F.col("gap") + F.char_length("run")).over(Window.partitionBy("row").orderBy("k"))
    name = F.coalesce(F.regexp_extract("run", f"^({NAMED}[\"']?)(?=.)", 1), F.lit(""))
    name = F.when(name != "", name).otherwise(F.regexp_extract("run", r"^([A-Za-z_][A-Za-z_-]*[=:]+)(?=.{6})", 1))
    rows = rows.select("doc_id", "rid", (upto - F.char_length("run")).alias("place"), "run", "before", "after", name.alias("name"))
    value = F.regexp_replace(F.expr("substring(run, char_length(name) + 1)"), r"[.:=,;)]+$", "")
    found = rows.select("doc_id", "rid", (F.col("place") + F.char_length("name")).cast("long").alias("start"),
                        value.alias("value"), F.concat("before", "name").alias("before"), "after")
    return found.where("value <> ''")


def confirmed(found: DataFrame) -> DataFrame:
    """Labels of findings whose format leaves no doubt: vendor keys, assigned high-entropy values and what a password's or
    secret's name assigns in quotes or at length, against plain words, numbers and addresses that nothing assigns.
    (doc_id, start, label)"""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.char_length("value") >= 16)
    assigned, quoted = F.col("before").rlike(ASSIGNED), F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")
    word = F.col("before").rlike(PASSWORD) & ~F.col("value").rlike(ADDRESS) & (quoted | (F.char_length("value") >= 8))
    secret = F.col("value").rlike(VENDOR) | (mixed & assigned) | word
    plain = (F.col("value").rlike("^([A-Za-z]?[a-z]+|[A-Z]+)$") | F.col("value").rlike(ADDRESS)) & ~F.col("before").rlike(ASSIGNED)
    return found.withColumn("label", F.when(secret, 1).when(plain, 0)).where("label is not null").select(
        "doc_id", "start", "label")


def _codes(value: Column) -> Column:
    """1..36 for letters and digits, 0 for everything else, one number per character."""
    known = F.lit(ALPHABET)
    return F.transform(F.split(F.lower(value), ""), lambda c: F.when(c == "", 0).otherwise(F.instr(known, c)))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.char_length(value), F.lit(1))


class Prose:
    """What the labelled findings' surroundings say about prose: transitions, dictionary, word evidence."""

    def __init__(self, labelled: DataFrame, words: int = 300):
        around = labelled.select(F.concat_ws(" ", "before", "after").alias("text"))
        pairs = (around.select(_codes(F.col("text")).alias("c"))
                 .select(F.explode(F.arrays_zip(F.expr("slice(c, 1, greatest(size(c) - 1, 0))").alias("a"),
                                                F.expr("slice(c, 2, greatest(size(c) - 1, 0))").alias("b"))).alias("p"))
                 .groupBy("p.a", "p.b").count().collect())
        n = len(ALPHABET) + 1
        count = [[1.0] * n for _ in range(n)]
        for r in pairs:
            count[r["a"]][r["b"]] += r["count"]
        self.transitions = [math.log(c / sum(row)) for row in count for c in row]
        word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
        self.words = [r["w"] for r in around.select(word.alias("w")).groupBy("w").count()
                      .orderBy(F.desc("count"), "w").limit(words).collect()]
        before = labelled.groupBy(_word_before().alias("w")).agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
        self.evidence = {r["w"]: math.log((r["yes"] + 0.5) / (r["n"] - r["yes"] + 0.5)) for r in before.collect()
                         if r["w"]}


def _word_before() -> Column:
    return F.lower(F.regexp_extract("before", "([A-Za-z_]+)[^A-Za-z_]*$", 1))


def features(found: DataFrame, prose: Prose) -> DataFrame:
    """Adds the columns of ``FEATURES``."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    n = len(ALPHABET) + 1
    found = found.withColumn("_c", _codes(v)).withColumn("_w", _word_before())
    table = F.lit(prose.transitions)
    pair = F.zip_with(F.expr("slice(_c, 1, greatest(size(_c) - 1, 0))"),
                      F.expr("slice(_c, 2, greatest(size(_c) - 1, 0))"), lambda a, b: a * n + b)
    likely = F.aggregate(pair, F.lit(0.0), lambda s, i: s + F.element_at(table, i + 1))
    covered = F.regexp_replace(F.lower(v), "|".join(sorted(prose.words, key=lambda w: (-len(w), w))) or "^$", "")
    length = F.greatest(F.char_length(v), F.lit(1))
    weights = found.sparkSession.createDataFrame(list(prose.evidence.items()), "_w string, evidence double")
    values = {
        "length": F.log1p(F.char_length(v)), "digits": _share(v, "[0-9]"), "uppers": _share(v, "[A-Z]"),
        "lowers": _share(v, "[a-z]"), "others": _share(v, "[^A-Za-z0-9]"), "hex": _share(v, "[0-9a-f]"),
        "changes": _share(v, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"), "case_changes": _share(v, "(?<=[a-z])[A-Z]"),
        "transitions": likely / F.greatest(F.size("_c") - 1, F.lit(1)),
        "distinct": F.size(F.array_distinct("_c")) / length, "dictionary": 1 - F.char_length(covered) / length,
        "slashes": _share(v, "/"), "dots": _share(v, "[.]"), "address": v.rlike(ADDRESS).cast("double"),
        "path_before": before.rlike(r"(://|[/\\\\@.])[^ ]*$").cast("double"),
        "named": before.rlike(CREDENTIAL).cast("double"), "assigned": before.rlike("[=:] *[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
    }
    found = found.withColumns({k: x.cast("double") for k, x in values.items()}).drop("_c")
    # at most one row per word of the bounded labelled sample
    return (found.join(F.broadcast(weights), "_w", "left").drop("_w")
            .withColumn("evidence", F.coalesce("evidence", F.lit(0.0))))


def train(found: DataFrame, labels: DataFrame, sample: int = 5000, trees: int = 40, depth: int = 8,
          seed: int = 5) -> tuple[Prose, RandomForestClassificationModel] | None:
    """Forest and prose tables from at most ``sample`` labelled findings of each class; ``None`` without both classes.

    Conflicting labels of one finding are left out.
    """
    known = (labels.where("doc_id is not null").groupBy("doc_id", "start")
             .agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))
    known = found.join(known, ["doc_id", "start"])
    order = F.xxhash64(F.lit(seed), "doc_id", "start", "value")
    both = [known.where(F.col("label") == k).orderBy(order, "doc_id", "start").limit(sample) for k in (0, 1)]
    labelled = stage(both[0].union(both[1]), "secret_labels")
    if labelled.select("label").distinct().count() < 2:
        return None
    prose = Prose(labelled)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(labelled, prose))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return prose, forest.fit(rows.orderBy("doc_id", "start"))


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """One row per candidate: doc_id, rid, start, value, score (0 to 1), is_secret."""
    found = stage(candidates(docs), "secret_candidates")
    labels = confirmed(found) if labels is None else labels
    model = train(found, labels, **options)
    if model is None:
        sure = stage(confirmed(found).distinct(), "secret_labels")
        score = F.coalesce(F.col("label"), F.lit(0)).cast("double")
        scored = found.join(sure, ["doc_id", "start"], "left").withColumn("score", score)
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(found, model[0]))
        scored = model[1].transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "rid", "start", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every secret value replaced by ``mark``; all rows and columns stay."""
    rid = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    values = (scan(docs.select("doc_id", "text"), **options).where("is_secret")
              .groupBy("rid").agg(F.sort_array(F.collect_set("value"), asc=False).alias("found")))
    rows = docs.select(F.struct("*").alias("row"), rid.alias("rid")).join(values, "rid", "left")
    clean = F.aggregate("found", F.col("row.text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return rows.select(F.when(F.col("found").isNull(), F.col("row"))
                       .otherwise(F.col("row").withField("text", clean)).alias("row")).select("row.*")
