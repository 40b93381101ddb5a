"""Secret scans: regular-expression candidates, false positives removed by a random forest.

Everything that runs over the corpus is SQL functions: a text is cut at its candidates, so that each
candidate comes with the text before and after it, and features are expressions on those three strings:
length, changes between character classes, share of ordinary letter pairs, coverage by dictionary words,
the path, and neighbouring words. The dictionary is the whole words of a public vocabulary file (``words``), a
broadcast of at most ``WORDS`` rows. The forest is Spark ML's; it is trained on labelled findings, at most
``SAMPLE`` of them, in one partition and in a fixed order so that a run can be repeated.

Labelled findings come from the caller (``labels``: doc_id, start, is_secret). Without them the forest learns from
``examples``: seeded texts of which it is known by construction which value is a secret, as their writer put it
there; no label is read off a candidate's form or neighbours, and none off the corpus. ``held_out`` measures it on
kinds of values it has not seen.

Defined results: null and empty texts have no finding; a text is searched whole, however long; findings don't
overlap, the leftmost is taken, then the first branch of ``CANDIDATE``; repeated rows give repeated findings; a null
doc_id stays null; a null path counts as empty; with findings of one label only all get that label, without any
labelled finding all count as secret; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.common import prepare

SAMPLE, WORDS = 20_000, 40_000
VOCABULARY = "byte_bpe_50k.json"
TREES, DEPTH, SEED = 24, 6, 7
AROUND = 48  # characters of context

#: A private key block, a value assigned to a secret's word (as in ASSIGNED), a web token of three parts, a run of
#: at least 12 key characters with a digit, or one of at least 20 with small and capital letters.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?<=[=:\s\"'])(?<=(?i:token|secret|password|passwd|pwd|api_?key|access_?key|auth)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"'=]{6,}={0,2}"
    r"|(?<![A-Za-z0-9_+/-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Z0-9_+/-]*[a-z])(?=[a-z0-9_+/-]*[A-Z])[A-Za-z0-9_+/-]{20,}={0,2}"
)

KEYWORDS = "token secret password passwd pwd apikey api_key access_key auth credential private".split()
HARMLESS = "example sample test dummy placeholder hash sha1 sha256 md5 commit checksum uuid digest phone card iban".split()
#: Ordinary letter pairs of the four languages. Fixed values.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = ("length", "changes", "digits", "uppers", "distinct", "pairs", "dictionary", "marks", "keyword", "assigned", "harmless", "quoted", "in_path", "path_test", "path_depth")


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, path, start (characters before it), finding, before, after."""
    text = F.coalesce(F.col("text"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE).alias("between"),
    ).where(F.size("found") > 0)
    # an array of (text before, finding, text after); sums of what each gains give the starts
    paired = F.arrays_zip("found", "between", F.slice("between", F.lit(2), F.size("found")).alias("follow"))
    one = cut.select("doc_id", "path", "row", F.posexplode(paired).alias("k", "x")).where("x.found is not null")
    short = one.select(  # not the text between
        "doc_id", "path", "row", "k", (F.length("x.between") + F.length("x.found")).alias("gained"), F.col("x.found").alias("finding"),
        F.expr(f"right(x.between, {AROUND})").alias("before"), F.expr(f"left(x.follow, {AROUND})").alias("after"),
    ).checkpoint()  # a row's number stays what it is from here on
    up_to = W.partitionBy("row").orderBy("k")  # the findings of one document
    return short.select("doc_id", "path", "row", "k", (F.sum("gained").over(up_to) - F.length("finding")).cast("long").alias("start"), "finding", "before", "after")


def words(spark: SparkSession, path: str | None = None) -> DataFrame:
    """word: the whole words of at least three letters of a vocabulary file, lower case; at most WORDS, the first ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    whole = [t[1:].lower() for t in sorted(vocabulary, key=vocabulary.get) if t[0] == "\u0120" and t[1:].isalpha() and t[1:].isascii() and len(t) > 3]
    taken = " ".join(dict.fromkeys(whole[:WORDS]))
    return spark.range(1).select(F.explode(F.split(F.lit(taken), " ")).alias("word"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _any(words: list[str]) -> str:
    return "(?i)(" + "|".join(words) + ")"


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add the columns of FEATURES. ``found``: as ``candidates`` gives it; ``dictionary``: word, at most WORDS rows."""
    runs = found.select("row", "k", F.explode(F.regexp_extract_all(F.col("finding"), F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))).alias("run")).where(F.length("run") > 2)
    covered = runs.join(F.broadcast(dictionary), F.lower("run") == F.col("word")).groupBy("row", "k").agg(F.sum(F.length("run")).alias("covered"))
    f, n = F.col("finding"), F.length("finding").cast("double")
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    values = {
        "length": n,
        "changes": _count(f, changes) / n,
        "digits": _count(f, "[0-9]") / n,
        "uppers": _count(f, "[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(f, ""))).cast("double") / n,
        "pairs": _count(f, "(?=" + _any(PAIRS) + ")") / n,
        "dictionary": F.coalesce("covered", F.lit(0)) / n,
        "marks": _count(f, "[^A-Za-z0-9]") / n,
        "keyword": _count(F.col("before"), _any(KEYWORDS)),
        "assigned": F.col("before").rlike(r"[=:]\s{0,2}[\"']?$").cast("double"),
        "harmless": _count(F.concat("before", F.lit(" "), "after"), _any(HARMLESS)),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "in_path": (F.col("before").rlike(r"([/\\@.]|https?:\S*)$") | F.col("after").rlike(r"^[/\\@]|^\.[a-z]")).cast("double"),
        "path_test": F.col("path").rlike(_any(["test", "example", "sample", "fixture", "mock", "doc"])).cast("double"),
        "path_depth": _count(F.col("path"), "/"),
    }
    return found.join(covered, ["row", "k"], "left").withColumns({f"f_{k}": v for k, v in values.items()}).drop("covered")


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _values(rng: random.Random) -> tuple[dict, dict]:
    """A secret and a harmless value of each kind."""
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, base = DIGITS + "abcdef", LETTERS + LETTERS.upper() + DIGITS
    word = lambda: rng.choice("build release index report image summary module backup session branch article customer table section volume archive".split())
    secret = {
        "hex": some(hexes, rng.choice((32, 40, 64))), "base": some(base, rng.randint(24, 44)), "base_marks": some(base + "+/", 40), "cloud": "AKIA" + some(LETTERS.upper() + DIGITS, 16), "forge": "ghp_" + some(base, 36),
        "pay": "sk_live_" + some(base, 24), "web": f"eyJ{some(base, 20)}.eyJ{some(base, 40)}.{some(base, 30)}", "phrase": some(LETTERS, 4) + some(DIGITS, 2) + some("!%&#", 1) + some(base, 4), "block": "-----BEGIN RSA PRIVATE KEY-----",
    }
    plain = {
        "digits": some(DIGITS, rng.randint(12, 19)), "date": f"20{some(DIGITS, 2)}-0{rng.randint(1, 9)}-1{some(DIGITS, 1)}-{some(DIGITS, 4)}", "uuid": "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)), "digest": some(hexes, rng.choice((32, 40, 64))),
        "name": "_".join((word(), word(), some(DIGITS, rng.randint(1, 4)))), "camel": "".join(word().title() for _ in range(4)) + some(DIGITS, 1), "folder": "/".join((word(), word(), word())) + some(DIGITS, 2), "account": some(LETTERS.upper(), 2) + some(DIGITS, 20),
        "placeholder": rng.choice(("changeme123", "your_token_here_1", "example12345678", "xxxxxxxxxxxx1234", "dummy-password-1", "placeholder_key_2")), "long_word": word() + word() + word() + some(DIGITS, 2),
    }
    return secret, plain


#: Texts that values stand in: for secrets, for harmless values of any kind, and for those of one kind. Fixed values.
SECRET_IN = ('token = "{}"', "password: {}", "api_key={}", "Authorization: Bearer {}", "export SECRET_ACCESS_KEY={}", "auth_token: '{}'", 'client_secret="{}",', "{}", "my key is {} so")
PLAIN_IN = ("order no. {}", "see https://site.org/{}", "file {}.txt", "id={}", "the {} of", "{}", "version: {}", "ref '{}'", "phone {}", "name = \"{}\"")
DIGEST_IN = ("commit {}", "sha256: {}", "md5 = {}", "checksum {} ok")
PLACEHOLDER_IN = ('password = "{}"', "token: {}", "api_key={}", "secret='{}'")


def examples(spark: SparkSession, each: int = 60, seed: int = SEED) -> DataFrame:
    """doc_id, text, source, kind, start, end, is_secret: ``each`` texts of every kind of value, among other words."""
    rng, rows = random.Random(seed), []
    for _ in range(each):
        for label, values in zip((1, 0), _values(rng), strict=True):
            for kind, value in values.items():
                inside = rng.choice(SECRET_IN if label else DIGEST_IN if kind == "digest" else PLACEHOLDER_IN if kind == "placeholder" else PLAIN_IN)
                before = " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(0, 9))) + rng.choice((" ", "\n", ". "))
                text = before + inside.format(value) + rng.choice(("", " ", "\n", ". ")) + rng.choice(("and so on", "", "then it goes on"))
                start = len(before) + inside.index("{")
                rows.append({"doc_id": len(rows), "text": text, "source": rng.choice(("src", "app/main", "docs/a", "test/b")), "kind": kind, "start": start, "end": start + len(value), "is_secret": label})
    kinds = "array<struct<doc_id:long,text:string,source:string,kind:string,start:long,end:long,is_secret:int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kinds)))


def labelled_examples(spark: SparkSession, dictionary: DataFrame, **options) -> DataFrame:
    """The examples' findings with their features, kind and label; what lies beside the planted value is left out."""
    own = examples(spark, **options).checkpoint()
    said = own.select(F.col("doc_id").alias("of"), "kind", F.col("start").alias("a"), F.col("end").alias("b"), F.col("is_secret").alias("label"))
    found = features(candidates(own), dictionary)
    return found.join(said, (F.col("of") == F.col("doc_id")) & (F.col("start") < F.col("b")) & (F.col("start") + F.length("finding") > F.col("a"))).drop("of", "a", "b")


def held_out(spark: SparkSession, kinds: tuple[str, ...] = ("base", "pay", "uuid", "account", "name"), path: str | None = None) -> tuple[float, float]:
    """(precision, recall) on kinds of values that the forest was not trained on, from another seed."""
    prepare(spark)
    dictionary = words(spark, path)
    model = train(labelled_examples(spark, dictionary).where(~F.col("kind").isin(*kinds)))
    test = score(labelled_examples(spark, dictionary, seed=SEED + 1).where(F.col("kind").isin(*kinds)), model)
    r = test.agg(F.sum(F.when((F.col("score") >= 0.5) & (F.col("label") == 1), 1).otherwise(0)), F.count_if(F.col("score") >= 0.5), F.count_if(F.col("label") == 1)).first()
    return r[0] / max(r[1], 1), r[0] / max(r[2], 1)


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A fitted forest, or the one label that there is (secret if there is none). ``labelled``: features and ``label``."""
    names = [f"f_{k}" for k in FEATURES]
    key = F.xxhash64("finding", "before", "after")
    # of each label at most half, each finding with its context once
    kinds = labelled.where("label is not null").select(*names, "label", key.alias("key")).dropDuplicates(["key", "label"])
    parts = [kinds.where(F.col("label") == y).orderBy("key").limit(sample // 2) for y in (0, 1)]
    taken = parts[0].unionByName(parts[1]).coalesce(1).sortWithinPartitions("key", "label").checkpoint()
    seen = {r["label"] for r in taken.select("label").distinct().collect()}
    if len(seen) < 2:
        return seen.pop() if seen else 1
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=1)
    return forest.fit(VectorAssembler(inputCols=names, outputCol="x").transform(taken))


def score(found: DataFrame, model) -> DataFrame:
    """Add ``score`` to findings with their features."""
    if isinstance(model, int):
        return found.withColumn("score", F.lit(float(model)))
    assembled = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="x").transform(found)
    return model.transform(assembled).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, labels: DataFrame | None = None, path: str | None = "source", threshold: float = 0.5, sample: int = SAMPLE, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, finding, score, is_secret: one row a candidate. Keep ``is_secret`` rows to drop false positives."""
    spark = prepare(docs.sparkSession)
    dictionary = words(spark, vocabulary)
    found = features(candidates(docs, path), dictionary)
    if labels is None:
        labelled = labelled_examples(spark, dictionary)
    else:
        found = found.checkpoint()
        said = labels.groupBy("doc_id", "start").agg(F.min(F.col("is_secret").cast("int")).alias("label"), F.max(F.col("is_secret").cast("int")).alias("other")).where("label = other")
        labelled = found.join(said.select("doc_id", "start", "label"), ["doc_id", "start"])
    scored = score(found, train(labelled, sample))
    return scored.select("doc_id", "start", "finding", F.col("score").cast("double").alias("score"), (F.col("score") >= threshold).alias("is_secret"))
