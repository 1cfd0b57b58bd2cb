"""Secret scans with a random forest that removes false positives.

Everything on the way from text to findings is DataFrame and SQL functions:
candidates are long tokens, features describe their length, the transitions
between their characters, how much of them a dictionary covers, their path and
their neighbouring words, and a forest from Spark ML tells secrets from
identifiers, digests, numbers and placeholders.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.storage import materialize

#: A candidate: a run of so many of the characters that tokens and keys are written in, or a shorter one with letters and figures.
LONG, SHORT = 16, 8
_SIGNS = "A-Za-z0-9_+/=-"
CANDIDATE = rf"(?<![{_SIGNS}])(?:[{_SIGNS}]{{{LONG},}}|(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[{_SIGNS}]{{{SHORT},}})"
#: A part of a run that is a candidate of its own; parts end behind equals signs: name=, value, base64==.
VALUE = rf"^(?:[A-Za-z0-9_+/-]{{{LONG},}}|(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{{{SHORT},}})"
#: Words on each side of a candidate that count as its neighbours.
NEIGHBOURS = 3
#: The dictionary: words that make up at least this share of all words, so at most 100 000, whatever the corpus.
DICTIONARY_SHARE = 1e-5
#: Labelled findings of each class that are made for training, and words of the dictionary that their prose is made of.
LABELLED_ROWS, LABEL_WORDS = 3000, 200
TREES, DEPTH, SEED = 40, 10, 7

SECRET_WORDS = r"token|secret|passw(or)?d|pwd|passphrase|api.?key|access.?key|auth|bearer|credential|private"
HARMLESS_WORDS = r"example|sample|dummy|placeholder|uuid|guid|commit|sha1|sha256|md5|checksum|digest|etag|revision|hash|order|invoice|isbn|card|phone|build|request.?id|trace.?id|session.?id"
#: How tokens of well-known issuers begin.
ISSUERS = r"^(ghp_|gho_|ghs_|github_pat_|glpat-|AKIA|ASIA|AIza|xox[abpr]-|sk-|sk_live_|rk_live_|npm_|pypi-|eyJ|SG\.)"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: The word right before a candidate, up to an assignment.
_NEXT = r"(^|[^a-z0-9])[a-z0-9_.]*({})[a-z0-9_]*[\"'`]?\s*(is\s+)?[=:]*\s*[\"'`(\[<]*$"
TEST_PATH = r"test|example|sample|fixture|mock|doc"
CONFIG_PATH = r"\.(env|ini|conf|cfg|ya?ml|json|toml|properties)$|config|settings"


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, path, word_index, place, candidate, before, after, quoted): a row per candidate; no shuffle.

    ``word_index`` counts the words between white space, ``place`` the
    candidates in a word. ``before`` holds the words before it and what stands
    ahead of it in its own word, from the run before.
    """
    around = lambda ws, begin, end: F.array_join(F.slice(ws, begin, F.greatest(end - begin, F.lit(0))), " ")

    def found(ws: Column) -> Column:
        index = F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: (F.length(F.element_at(ws, i)) >= SHORT) & F.element_at(ws, i).rlike(CANDIDATE))
        return F.transform(
            index,
            lambda i: F.struct(
                (i - 1).alias("word_index"),
                F.element_at(ws, i).alias("word"),
                around(ws, F.greatest(i - NEIGHBOURS, F.lit(1)), i).alias("before"),
                around(ws, i + 1, i + 1 + NEIGHBOURS).alias("after"),
            ),
        )

    # The split is the value of a lambda variable, so it is made once a row.
    words = F.transform(F.array(F.split("text", r"\s+")), found)[0]
    path = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    rows = documents.where(F.col("text").rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.explode(words).alias("w"))
    every = rows.select("doc_id", "path", "w.*", F.posexplode(_parts(F.col("w.word"))).alias("place", "part"))
    before = F.concat_ws(" ", F.nullif("before", F.lit("")), F.nullif("part.ahead", F.lit("")))
    return every.select("doc_id", "path", "word_index", "place", "part.candidate", before.alias("before"), "after", F.col("word").rlike("[\"'`]").alias("quoted"))


def _parts(word: Column) -> Column:
    """The candidates of a word, each with what stands ahead of it in the word.

    A run that holds name=value is parted behind its equals signs, where a part
    is long enough for a candidate; another run is one candidate.
    """
    held = lambda value, use: F.transform(F.array(value), use)[0]

    def of_run(runs: Column, gaps: Column, run: Column, k: Column) -> Column:
        ahead = F.concat(F.coalesce(F.get(runs, k - 1), F.lit("")), F.get(gaps, k))

        def of_parts(parts: Column) -> Column:
            values = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).rlike(VALUE))
            one = lambda i: F.struct(F.get(parts, i).alias("candidate"), F.concat(ahead, F.coalesce(F.get(parts, i - 1), F.lit(""))).alias("ahead"))
            return F.when(F.size(values) > 0, F.transform(values, one)).otherwise(F.array(F.struct(run.alias("candidate"), ahead.alias("ahead"))))

        return held(F.split(run, "(?<==)(?=[^=])"), of_parts)

    of_word = lambda runs, gaps: F.flatten(F.transform(runs, lambda run, k: of_run(runs, gaps, run, k)))
    return held(F.regexp_extract_all(word, F.lit(f"({CANDIDATE})"), F.lit(1)), lambda runs: held(F.split(word, CANDIDATE), lambda gaps: of_word(runs, gaps)))


def dictionary(documents: DataFrame, share: float = DICTIONARY_SHARE) -> DataFrame:
    """The words of at least four letters that make up at least ``share`` of all such words: at most 1 / share, so they may be broadcast."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), F.lit(1))).alias("word"))
    counted = materialize(words.groupBy("word").count())
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return materialize(counted.crossJoin(F.broadcast(total)).where(F.col("count") >= share * F.col("total")).select("word"))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _runs(classes: Column) -> Column:
    return F.length(F.regexp_replace(classes, r"(.)\1*", "$1"))


def with_features(found: DataFrame, known_words: DataFrame) -> DataFrame:
    """Add the FEATURES to candidates."""
    c = F.col("candidate")
    n = F.length(c)
    kinds = F.translate(c, _DIGITS + _LOWER + _UPPER, "0" * 10 + "a" * 26 + "A" * 26)
    lower = F.lower(c)
    sounds = F.translate(lower, _LOWER, "".join("v" if x in "aeiouy" else "c" for x in _LOWER))
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    path = F.lower(F.coalesce("path", F.lit("")))
    rows = found.withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows)
    parts = rows.select("_id", F.explode(F.regexp_extract_all(lower, F.lit(r"([a-z]{4,})"), F.lit(1))).alias("word"))
    covered = parts.join(F.broadcast(known_words), "word").groupBy("_id").agg(F.sum(F.length("word")).alias("_covered"))
    return rows.join(covered, "_id", "left").select(
        *found.columns,
        n.cast("double").alias("length"),
        share("[^0-9]").alias("digits"), share("[^A-Z]").alias("capitals"), share("[A-Za-z0-9]").alias("signs"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        flag(c.rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"), flag(c.rlike("^[0-9]+$")).alias("numeric"),
        ((_runs(kinds) - 1) / n).alias("kind_transitions"), ((_runs(sounds) - 1) / n).alias("sound_transitions"), (_runs(c) / n).alias("unequal_transitions"),
        (F.coalesce("_covered", F.lit(0)) / n).alias("dictionary"),
        flag(path.rlike(TEST_PATH)).alias("test_path"), flag(path.rlike(CONFIG_PATH)).alias("config_path"),
        flag(F.lower("before").rlike(SECRET_WORDS)).alias("secret_before"), flag(near.rlike(HARMLESS_WORDS)).alias("harmless_near"),
        flag(F.lower("before").rlike(_NEXT.format(SECRET_WORDS))).alias("secret_next"), flag(F.lower("before").rlike(_NEXT.format(HARMLESS_WORDS))).alias("harmless_next"),
        flag(c.rlike(ISSUERS)).alias("issuer"), flag(c.rlike(UUID)).alias("uuid"), flag(F.col("before").rlike(r"://[^/ ]*:$")).alias("in_address"),
        flag(lower.rlike(r"example|your|placeholder|xxxx|1234|abcd|changeme")).alias("placeholder"),
        flag(F.col("before").rlike(r"[=:]\s*[\"'`]*$") & ~c.startswith("//")).alias("assigned"), flag(F.col("quoted")).alias("in_quotes"),
    )


FEATURES = (
    "length", "digits", "capitals", "signs", "distinct", "hexadecimal", "numeric", "kind_transitions", "sound_transitions", "unequal_transitions",
    "dictionary", "test_path", "config_path", "secret_before", "harmless_near", "secret_next", "harmless_next", "issuer", "uuid", "in_address", "placeholder", "assigned", "in_quotes",
)


#: Ways to write a finding: name, separator and what closes it, around @; the names come from the lists below.
FORMS = ("{name} = \"@\"", "{name}: '@'", "{name}=@", "{\"{name}\":\"@\"}", "--{name} @", "export {name}=@", "- {name}: @", "{name} is @", "{name} @", "?{name}=@", "{name} := `@`")
SECRET_NAMES = ("token", "secret", "password", "api_key", "access_key", "auth", "Bearer", "PASSWORD", "API_TOKEN", "db_passwd", "client_secret", "private_key", "AWS_SECRET_ACCESS_KEY")
HARMLESS_NAMES = ("commit", "sha256", "md5", "checksum", "revision", "uuid", "etag", "build", "request_id", "trace_id", "token commit", "secret checksum", "digest")
BARE = "@"


def labelled_findings(spark: SparkSession, known_words: DataFrame, rows: int = LABELLED_ROWS, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """Findings with a ``label``: ``rows`` secrets (1) and ``rows`` others (0), written by rule from a hash of their number.

    Secrets are random strings, or words and figures, behind the names of secrets in any of ``forms``,
    in the credentials of an address, or with an issuer's prefix and no name.
    Others are words of the dictionary put together, numbers, digests and
    identifiers named as such or not at all, identifiers behind names of
    secrets, and placeholders. They are made as texts, in which ``candidates``
    then finds them.
    """
    words = F.array(*(F.lit(r["word"]) for r in known_words.orderBy("word").limit(LABEL_WORDS).collect() or [{"word": "word"}]))
    i = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n))
    word = lambda salt: F.element_at(words, (draw(salt, 1 << 30) % F.size(words) + 1).cast("int"))
    pick = lambda salt, *options: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (draw(salt, len(options)) + 1).cast("int"))
    hexadecimal = F.sha2(i.cast("string").cast("binary"), 256)
    base64 = F.translate(F.base64(F.unhex(hexadecimal)), "=", "")
    some = lambda salt, least, most: F.substring(F.translate(base64, "+/", "xy"), F.lit(1), (draw(salt, most - least) + least).cast("int"))
    issued = F.concat(pick(1, "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "AKIA", "AIza", "xoxb-", "npm_", "eyJ"), some(2, 20, 36))
    password = F.concat(F.substring(F.translate(base64, "+/0123456789", "ab"), 1, 6), F.lpad(draw(3, 10_000).cast("string"), 4, "0"))
    worded = F.concat(word(40), draw(41, 10).cast("string"), F.substring(word(42), 1, 4), F.lpad(draw(43, 100).cast("string"), 2, "0"))
    password = pick(44, password, worded)
    secret = pick(4, F.substring(hexadecimal, 1, 32), F.substring(hexadecimal, 1, 40), hexadecimal, base64, some(5, 20, 42), issued, password)
    number = F.conv(F.substring(hexadecimal, 1, 15), 16, 10)
    joint = pick(6, "", "_", "-", "/")
    compound = F.concat_ws("", word(8), joint, word(9), joint, word(10), joint, word(11), joint, word(12))
    uuid = F.concat_ws("-", *(F.substring(hexadecimal, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    digest = pick(13, F.substring(hexadecimal, 1, 40), hexadecimal, F.substring(hexadecimal, 1, 32), uuid)
    placeholder = pick(14, "xxxxxxxxxxxxxxxxxxxxxxxx", "your_api_key_goes_here", "EXAMPLE_TOKEN_PLACEHOLDER", "1234567890123456789", "abcdabcdabcdabcdabcd", "changeme12345")
    dull = F.repeat(pick(15, "-", "=", "_", "0", "ha"), 24)
    named = lambda salt, *names: pick(salt, *names)

    def written(salt: int, name: Column, value: Column) -> Column:
        """A finding in one of the forms."""
        forms_of = F.element_at(F.array(*map(F.lit, forms)), (draw(salt, len(forms)) + 1).cast("int"))
        return F.replace(F.replace(forms_of, F.lit("{name}"), name), F.lit("@"), value)

    kind = draw(16, 10)
    prose = lambda salt: F.concat_ws(" ", word(salt), word(salt + 100), word(salt + 200))
    positive = (
        F.when(kind == 0, issued).when(kind == 1, F.concat(F.lit("https://"), word(17), F.lit(":"), secret, F.lit("@host.example.net/"), word(18)))
        .when(kind == 2, F.concat(F.lit("https://host.net/"), word(17), F.lit("?"), named(19, *SECRET_NAMES), F.lit("="), secret, F.lit("&n=1"))).otherwise(written(20, named(21, *SECRET_NAMES), secret))
    )
    negative = (
        F.when(kind <= 1, written(20, named(22, *HARMLESS_NAMES), digest)).when(kind == 2, digest).when(kind == 3, written(20, named(21, *SECRET_NAMES), pick(23, uuid, placeholder, compound)))
        .when(kind == 4, compound).when(kind == 5, pick(24, F.concat(number, number), F.concat(word(25), number), dull)).when(kind == 6, F.upper(compound)).when(kind == 7, written(20, word(26), pick(27, digest, compound, number)))
        .when(kind == 8, F.concat(F.lit("https://host.net/"), compound, F.lit("/"), digest)).otherwise(F.concat(word(28), F.lit("."), compound))
    )
    path = pick(29, "src1", "src2/app.py", "config/settings.yaml", "tests/test_login.py", "docs/readme.md", ".env", "web")
    base = lambda label: spark.range(rows).withColumn("id", i * 2 + label)
    text = lambda finding: F.concat_ws(" ", prose(30), finding, prose(31))
    made = base(1).select(i.alias("doc_id"), text(positive).alias("text"), path.alias("source"), secret.alias("_value"), issued.alias("_issued")).union(base(0).select(i.alias("doc_id"), text(negative).alias("text"), path.alias("source"), F.lit(""), F.lit("")))
    found = candidates(materialize(made.select("doc_id", "text", "source")))
    truth = materialize(made.select("doc_id", "_value", "_issued"))
    # In the text of a secret other strings may be candidates too: those are none.
    is_secret = (F.col("doc_id") % 2 == 1) & (F.contains(F.col("candidate"), F.rtrim("_value", F.lit("="))) | F.contains(F.col("candidate"), F.col("_issued")))
    return found.join(truth, "doc_id").select(is_secret.cast("double").alias("label"), *found.columns)


def train(labelled: DataFrame, known_words: DataFrame) -> RandomForestClassificationModel:
    """Fit the forest on findings with a ``label``; their number is bounded by LABELLED_ROWS."""
    # One ordered partition of a bounded number of rows, so the forest is the same each time.
    rows = materialize(with_features(labelled, known_words)).coalesce(1).sortWithinPartitions("label", "doc_id", "word_index", "place")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_assembled(rows))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)


def judge(found: DataFrame, model: RandomForestClassificationModel, known_words: DataFrame) -> DataFrame:
    """The findings with the forest's probability and decision."""
    judged = model.transform(_assembled(with_features(found, known_words)))
    score = F.round(vector_to_array("probability")[1], 6)
    return judged.select("doc_id", "word_index", "place", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.length("candidate").alias("length"), score.alias("score"), (score >= 0.5).alias("secret"))


def scan(documents: DataFrame) -> DataFrame:
    """Candidates of every text of ``documents`` (doc_id, text, source if any) and whether each is a secret.

    The forest is trained on ``labelled_findings``. Candidates are runs of at
    least LONG signs, or of SHORT with letters and figures; other signs end a run,
    so a password with such signs is seen in parts. Null, empty and short texts
    have no candidates; null doc_ids and sources pass; repeated rows are judged
    alike; other columns are left out; an empty table gives no rows.
    """
    known_words = dictionary(documents)
    model = train(labelled_findings(documents.sparkSession, known_words), known_words)
    return judge(candidates(documents), model, known_words)
