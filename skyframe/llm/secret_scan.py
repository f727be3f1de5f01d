"""Secret scans with a random forest that removes false positives (operator 4, DataFrame functions and JVM learning only).

Candidates come from patterns over whole texts. What tells secrets from look-alikes is learnt: how
usual a value's character transitions are comes from a table of letter pairs, and how much of it
is words from a dictionary, both counted over all texts that are scanned; the forest, on length,
transitions, dictionary coverage, path and neighbouring words, is fitted on labelled findings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spool import discard
from .common import save, table, unused, with_row_numbers

#: Names that announce a secret.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|authorization|bearer|credential"
#: Characters of a value that stands anywhere, and of one behind a name.
VALUE, NAMED_VALUE = "[A-Za-z0-9+/_~-]", r"[^\s\"'`,;<>(){}\[\]\x00-\x1F]"
_BEHIND = rf"(?:(?:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?|bearer\s{{1,2}})"
#: A candidate is a run, however long, of 16 or more value characters with a digit in it and any further runs of 8 or more behind dots,
#: or 8 or more characters of nearly any kind after a name, quoted or not, and a sign of assignment.
CANDIDATE = (
    rf"(?<!{VALUE})(?=[A-Za-z+/_~-]*+[0-9]){VALUE}{{16,}}+(?:\.{VALUE}{{8,}}+)*+={{0,2}}(?!{VALUE})"
    rf"|(?<=[=:]\s{{0,2}}[\"']?|[rR]\s{{1,2}})(?={NAMED_VALUE}{{8}})(?i:(?<={_BEHIND})){NAMED_VALUE}*(?<![.:!?])"
)
#: The same behind more white space around the sign than a look-behind may hold: the name is matched with it.
SPACED = rf"((?i:(?:{NAMES})[\"']?(?:\s{{3,}}+[=:]\s*+|\s{{0,2}}[=:]\s{{3,}}+)|bearer\s{{3,}}+)[\"']?)((?={NAMED_VALUE}{{8}}){NAMED_VALUE}*(?<![.:!?]))"
DIGEST_WORDS = r"(?i)\b(sha1|sha256|sha512|md5|digest|checksum|commit|revision|etag|uuid|guid|hash|integrity|trace|request|session|build|version|isbn|card|order|invoice|phone|account)\b[^\n]{0,12}$"
TEST_PATH = r"(?i)(test|spec|example|sample|fixture|mock|demo|docs?)([/_.-]|$)"
MARK = "\u0001"
#: Letters of the table of transitions: a to z, other letters, digits, anything else.
ALPHABET = "abcdefghijklmnopqrstuvwxyz#0."
#: Segments whose starts are summed at a time.
SUMMED = 512
#: Times that a word must occur to be in the dictionary, and its least letters.
TIMES, LETTERS = 5, 3
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "changes", "letter_digit", "digit_letter", "distinct", "hex", "padded", "transitions", "rare_transitions",
    "dictionary", "longest_letters", "test_path", "named", "assigned", "quoted", "digest_before", "digest_after", "dashed_groups", "only_digits",
)


def segments(text: Column) -> Column:
    """The text cut at its candidates: odd places (from 0) are candidates, even ones what lies between; the mark of a cut becomes a space in the text."""
    clean = F.translate(F.coalesce(text, F.lit("")), MARK, " ")
    return F.split(F.regexp_replace(clean, f"({CANDIDATE})|{SPACED}", f"$2{MARK}$1$3{MARK}"), MARK, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: inside another lambda an expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(cut: Column) -> Column:
    """Where each segment starts, in code points: sums over blocks, then inside them, so that a block is all that is ever copied."""
    zero, size = F.lit(0).cast("long"), F.lit(SUMMED)

    def sums(lengths: Column, start: Column) -> Column:
        return F.aggregate(lengths, F.array(start), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def of(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), lambda b: F.slice(lengths, b * size + 1, size))

        def placed(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, n: a + n))
            return let(sums(totals, zero), lambda before: F.flatten(F.transform(blocks, lambda b, i: F.slice(sums(b, F.get(before, i)), 1, F.size(b)))))

        return let(blocks, placed)

    return let(F.transform(cut, lambda x: F.length(x).cast("long")), of)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, place, start, value, before, after: each candidate of the whole texts with up to 64 characters on either side.

    ``place`` counts segments; ``start`` counts code points. Null and empty texts have none.
    """
    cut = docs.select("doc_id", F.col(path).alias("path"), segments(F.col("text")).alias("_cut")).where(F.size("_cut") > 1)
    places = lambda starts: F.transform(F.sequence(F.lit(1), F.size("_cut") - 1, F.lit(2)), lambda i: F.struct(
        i.alias("place"), F.get(starts, i).alias("start"), F.get("_cut", i).alias("value"), F.get("_cut", i - 1).alias("before"), F.get("_cut", i + 1).alias("after")
    ))
    each = cut.select("doc_id", "path", F.explode(let(_starts(F.col("_cut")), places)).alias("c"))
    return each.select("doc_id", "path", "c.place", "c.start", "c.value", F.right("c.before", F.lit(64)).alias("before"), F.left("c.after", F.lit(64)).alias("after"))


def learn_words(docs: DataFrame) -> tuple[DataFrame, list[float]]:
    """The dictionary (word) of ``docs`` as a table, and log chances of one letter after another, row by row of ALPHABET.

    Words are runs of letters between anything else but digits, in lower case, over whole texts;
    the dictionary has those that occur TIMES or more. Transitions are counted over all words.
    """
    pieces = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    words = docs.select(F.explode(pieces).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    counted = save(words.groupBy("word").agg(F.count("*").alias("n")), "secret-words")
    pairs = counted.select("n", F.explode(_neighbours(_spelled(F.concat(F.lit("."), "word", F.lit("."))), lambda a, b: F.concat(a, b))).alias("pair"))
    seen = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    rows = {a: sum(seen.get(a + b, 0) + 1 for b in ALPHABET) for a in ALPHABET}
    dictionary = save(counted.where((F.col("n") >= TIMES) & (F.length("word") >= LETTERS)).select("word"), "secret-dictionary")
    discard(counted)
    return dictionary, [math.log((seen.get(a + b, 0) + 1) / rows[a]) for a in ALPHABET for b in ALPHABET]


def _spelled(value: Column) -> Column:
    """``value`` in the letters of ALPHABET."""
    other = F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), r"[^a-z0\p{L}]", ".")
    return F.regexp_replace(other, r"[^a-z0.]", "#")


def _neighbours(spelled: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` each two letters that follow each other, in time that grows with the length; a single letter has none."""
    pairs = lambda letters: F.zip_with(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), of)
    return let(F.split(spelled, ""), pairs)


def with_features(found: DataFrame, dictionary: DataFrame, chances: list[float]) -> DataFrame:
    """``found`` (a table of id, value, before, after, path) with the columns of FEATURES: length, character transitions, dictionary coverage, path and neighbouring words."""
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    times = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    says = lambda column, pattern: F.coalesce(F.col(column), F.lit("")).rlike(pattern).cast("double")
    turns = "[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"
    # Words of a value: letters between anything else, cut where a capital follows a small letter.
    parts = F.split(F.lower(F.regexp_replace(value, r"(\p{Ll})(\p{Lu})", "$1 $2")), r"[^\p{L}]+")
    each = found.select("id", F.explode(parts).alias("word")).where(F.length("word") >= LETTERS)
    known = each.select("word").distinct().join(dictionary, "word", "left_semi")
    covered = each.join(known, "word").groupBy("id").agg(F.sum(F.length("word")).alias("covered"))
    # Element i is the chance of letter i + 1 after letter i.
    table_ = F.array(*map(F.lit, chances))
    at = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    chance = _neighbours(_spelled(value), lambda a, b: F.get(table_, len(ALPHABET) * at(a) + at(b)))
    chance = F.when(F.length("value") > 1, chance).otherwise(F.array(F.lit(0.0)))
    rows = found.join(covered, "id", "left").withColumn("chance", chance)
    total = F.aggregate("chance", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumns(
        {
            "length": F.length("value").cast("double"), "digits": times("[0-9]") / n, "uppers": times("[A-Z]") / n, "lowers": times("[a-z]") / n, "others": times("[^A-Za-z0-9]") / n,
            "changes": times(turns) / n, "letter_digit": times("[A-Za-z](?=[0-9])") / n, "digit_letter": times("[0-9](?=[A-Za-z])") / n, "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
            "hex": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "padded": value.rlike("=$").cast("double"),
            "transitions": total / F.size("chance"), "rare_transitions": F.size(F.filter("chance", lambda x: x < -4.5)) / F.size("chance"),
            "dictionary": F.coalesce("covered", F.lit(0)) / n, "longest_letters": F.array_max(F.transform(F.split(value, r"[^\p{L}]+"), F.length)).cast("double"),
            "test_path": says("path", TEST_PATH), "named": says("before", rf"(?i)({NAMES})[\s\"'=:>-]*$"), "assigned": says("before", r"[=:]\s*[\"']?$"), "quoted": says("before", r"[\"'`]$"),
            "digest_before": says("before", DIGEST_WORDS), "digest_after": says("after", r"(?i)^[\"'\s]{0,3}(\.(png|jpg|js|css|html)|checksum|digest)"),
            "dashed_groups": value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"), "only_digits": value.rlike("^[0-9_~+/-]+$").cast("double"),
        }
    ).drop("chance", "covered")


def labelled_findings(dictionary: DataFrame, rows: int = 4096) -> DataFrame:
    """Stand-in findings with label 1 for secrets and 0 for look-alikes: ``rows`` rows made from row numbers, labelled by how they were made.

    Secrets are random draws from an alphabet (hex, base 32, base 64, any printable characters),
    whole or behind a short prefix, in one to three dotted runs, at any length; look-alikes are put
    together from words of the corpus (256 of its dictionary), numbers, UUIDs and digests. Half of
    each stand behind a name of secrets, the others behind words or, digests, behind their name.
    Give ``scan`` findings of your own, of the same columns, to learn from them instead.
    """
    spark = dictionary.sparkSession
    known = [r.word for r in dictionary.where(F.col("word").rlike("^[a-z]+$")).orderBy(F.xxhash64("word"), "word").limit(256).collect()] or ["the", "of", "and", "to"]
    draw = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of)).cast("int")
    hashed = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 512)
    pick = lambda salt, *of: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), draw(salt, len(of)))
    # 128 random bytes as two hashes; each pair of hex digits picks a character of an alphabet.
    noise = F.concat(hashed("v"), hashed("w"))

    def random_text(alphabet: str, length: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.substr(F.lit(alphabet), F.pmod(F.conv(F.substr(noise, 2 * i + 1, F.lit(2)), 16, 10).cast("int"), F.lit(len(alphabet))) + 1, F.lit(1)))
        return F.array_join(pairs, "")

    lower, upper, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = 16 + draw("n", 33)
    base64 = random_text(upper + lower + ten + "+/", some)
    secret = pick(
        "s", F.substr(noise, F.lit(1), some), F.substr(noise, F.lit(1), some), F.substr(noise, F.lit(1), pick("d", 32, 40, 64).cast("int")), random_text(upper + ten[2:8], some), random_text(lower + ten, some), base64,
        F.concat(random_text(upper, F.lit(4)), random_text(upper + ten, F.lit(16))), F.concat(random_text(lower, F.lit(3)), F.lit("_"), random_text(upper + lower + ten, some)),
        F.concat(base64, F.lit("."), F.reverse(base64), F.lit("."), F.substr(base64, F.lit(3), F.lit(12))), random_text(lower + upper + ten + "!#$%&*-@^_?", 8 + draw("n", 13)),
    )
    word = lambda salt: pick(salt, *known)
    number = F.regexp_replace(noise, "[a-f]", "")
    digest = F.substr(noise, F.lit(1), pick("d", 32, 40, 64).cast("int"))
    plain = pick(
        "p", F.substring(number, 1, 16), F.concat(F.lit("202"), F.substring(number, 1, 14)), F.concat_ws("-", *[F.substring(noise, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.concat_ws("_", word("1"), word("2"), word("3"), F.substring(number, 1, 3)), F.concat_ws("-", word("1"), word("2"), word("3"), F.substring(number, 1, 2)), F.concat(word("1"), F.initcap(word("2")), F.initcap(word("3")), F.substring(number, 1, 2)),
        F.concat_ws("/", word("1"), word("2"), F.substring(number, 1, 4), word("3")), F.concat(word("5"), F.lit("_"), word("1"), F.lit("_"), word("2")), F.concat(F.repeat(F.substring(noise, 1, 1), 16), F.substring(number, 1, 2)),
        F.concat(F.substring(number, 1, 2), F.lit("-"), word("1"), F.lit("-"), word("2"), F.lit("-"), F.substring(number, 3, 2), F.lit("."), word("3"), word("4")),
    )
    name = pick("m", 'password=', 'password: "', 'token = "', "secret: ", "api_key=", "apikey: '", "Authorization: Bearer ", "access_key = ", "pwd=", "client_secret=", "export SECRET_TOKEN=")
    words = F.concat(word("4"), F.lit(" "), word("6"), F.lit(" "))
    base = spark.range(rows).withColumn("label", F.pmod("id", F.lit(2)).cast("double"))
    is_secret, is_digest, behind = F.col("label") == 1, (F.col("label") == 0) & (draw("k", 8) < 2), draw("b", 2) == 0
    value = F.when(is_secret, secret).when(is_digest, digest).otherwise(plain)
    # Hex and lower-case draws look like any digest: only a name or the want of one tells them apart, so unnamed ones are left to the digests.
    plainly = value.rlike("^[0-9a-f]+$|^.{1,15}$")
    before = F.when(is_secret & (behind | plainly), F.concat(words, name)).when(is_digest, F.concat(words, pick("g", "sha256: ", "commit ", "md5=", "etag: ", "checksum ", "revision ")))
    before = before.when((F.col("label") == 0) & behind & ~value.rlike("^[0-9]+$|^[0-9a-f-]{36}$"), F.concat(words, name)).otherwise(words)
    path = F.when((F.col("label") == 0) & (draw("t", 8) == 0), "tests/fixtures/a.py").otherwise(pick("q", "src/main.py", "src0", "config/app.yaml", "notes.txt", "src17"))
    return save(base.select("id", "label", value.alias("value"), before.alias("before"), F.concat(F.lit(" "), word("6")).alias("after"), path.alias("path")), "secret-findings")


def train(findings: DataFrame, dictionary: DataFrame, chances: list[float], trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest on labelled findings (id, label, value, before, after, path), a table that someone labelled and so small."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(with_features(findings.where("value is not null"), dictionary, chances))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(rows.select("label", "features"))


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Candidates of ``docs`` (doc_id, text and ``path``) with ``score``, the share of the forest's vote for a secret, and ``is_secret``.

    Whole texts, whatever their length. Rows that repeat a document repeat its findings; a null
    text has none, a null path is empty, a null doc_id stays null; other columns are left behind.
    An empty table gives no findings.
    """
    dictionary, chances = learn_words(docs)
    labelled = labelled_findings(dictionary) if findings is None else save(findings.drop("id").withColumn("id", F.monotonically_increasing_id()), "secret-findings")
    model = train(labelled, dictionary, chances)
    found = save(candidates(docs, path).withColumn("id", F.monotonically_increasing_id()), "secret-candidates")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(with_features(found, dictionary, chances))
    scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "path", "place", "start", "value", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))


def _replaced(cut: Column, places: Column, stand_in: str) -> Column:
    """The text of the segments with ``stand_in`` at the given places, in order; each segment is touched once."""

    def joined(s: Column) -> Column:
        cut, at, n = s["cut"], s["at"], F.size(s["at"])
        begin = lambda j: F.when(j == 0, 0).otherwise(F.get(at, j - 1) + 1)
        end = lambda j: F.when(j == n, F.size(cut)).otherwise(F.get(at, j))
        part = lambda j: F.concat(F.array_join(F.slice(cut, begin(j) + 1, end(j) - begin(j)), ""), F.when(j == n, "").otherwise(stand_in))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), part), "")

    return let(F.struct(cut.alias("cut"), places.alias("at")), joined)


def redact(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", stand_in: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced in its text, and n_chars, where there is such a column, counted anew for the texts changed.

    Only rows with secrets are touched, each by what was found in its own text, whatever its
    doc_id: null and repeated ids are rows like any other. Columns keep their names, whatever they
    are. An empty table gives no rows.
    """
    numbered, row = with_row_numbers(docs, "secret-docs")
    secrets = unused("secrets_of_row", numbered)
    found = scan(numbered.select(F.col(row).alias("doc_id"), F.col(path).alias("path"), "text"), findings, "path")
    # All places of a value that is a secret somewhere in the row.
    values = found.groupBy(F.col("doc_id").alias(row), "value").agg(F.max("is_secret").alias("any"), F.collect_list("place").alias("places")).where("any")
    places = values.groupBy(row).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias(secrets))
    changed = numbered.join(places, row, "left").withColumn("text", F.when(F.col(secrets).isNull(), F.col("text")).otherwise(_replaced(segments(F.col("text")), F.col(secrets), stand_in)))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(secrets).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(*docs.columns)


def op4_secrets_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in all documents with the forest's score and verdict."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").cast("int").alias("length"), "value", "score", "is_secret")
