"""Secret scans: candidates by a pattern, false positives removed by a random forest.

A text is cut at its candidates, so each candidate stands between two contexts, and the whole scan, redaction included,
is a projection of the row: nothing is exploded, shuffled or sent to Python. The forest is trained by Spark ML on
labelled findings and then spelled out as conditions, one for each tree; the dictionary is that of the corpus itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidates: private keys from BEGIN to END (or the header alone), credentials in a URL, values of six or more
#: characters assigned to a secret word, and runs of 16 or more key characters with a digit or 16 capitals in a row.
CANDIDATE = (
    r"-----BEGIN (?:[A-Z0-9]++ )*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END (?:[A-Z0-9]++ )*PRIVATE KEY-----)?+"
    r"|://[^\s/:@]++:[^\s/:@]{3,}+@"
    r"|(?<=[=:][\"' ]{0,2})(?<=(?i:pass(?:wor[dt]|wd|phrase)?|pwd|secret|token|key|credential)s?[\"']?\s?[=:][\"' ]{0,2})[^\s\"'<>,;&()\[\]{}]{5,}[A-Za-z0-9+/=!@#$%^*_\-]"
    r"|(?<![A-Za-z0-9_+/\-])(?:(?=[A-Za-z_+/\-]*+[0-9])|(?=[A-Z]{16}))[A-Za-z0-9_+/\-]{16,}+={0,2}"
)
#: Words of the dictionary: the commonest of the corpus, by the number of documents with them; and their letters.
DICTIONARY_WORDS = 256
WORD_LETTERS = (3, 12)
#: The dictionary where a corpus has no words.
NO_CORPUS = ["about", "and", "are", "for", "from", "that", "the", "this", "was", "with"]
#: Characters of context on either side.
CONTEXT = 48
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Bound of the generated labelled findings that the forest is trained on.
FINDINGS = 4800
TREES, DEPTH, SEED = 15, 6, 7
#: Findings whose lengths are summed together.
SUMMED = 64

_SECRET_WORD = r"(?i)(?:pass(?:wor[dt]|phrase)?|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private)\W{0,12}$"
_OTHER_WORD = r"(?i)(?:commit|sha[0-9-]*|md5|checksum|digest|hash|integrity|base64|build|version|uuid|guid|id|etag|revision|isbn|order|card|phone|tel|page|file|src|path)\W{0,12}$"
_SECRET_NEAR = r"(?i)(?:pass(?:wor[dt]|phrase)|passwd|secret|token|api[ _-]?key|access[ _-]?key|bearer|credential|private)"
_OTHER_RIGHT = r"(?i)^\W{0,3}(?:bytes|commits?|checksum|digest|hash|pages?|html?|png|jpe?g|gif|svg|css|js|pdf)\b"
_ASSIGNED = r"[=:]\s*[\"']?$"
_PREFIX = r"^(?:-----BEGIN|://|AKIA[A-Z0-9]{16}$|ASIA[A-Z0-9]{16}$|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ|glpat-)"
_OTHER_PREFIX = r"^(?:sha[0-9]{1,3}-|iVBORw0KGgo|R0lGOD|/9j/)"
_PLACEHOLDER = r"(?i)x{6}|\*{4}|placeholder|changeme|example|dummy|fake|sample|your"
_TEST_PATH = r"(?i)(?:^|[/._\-])(?:tests?|fixtures?|examples?|samples?|mocks?|docs?)(?:$|[/._\-])"
#: Classes of characters, for the transitions between them.
_CLASSES = {"small": "[a-z]", "capital": "[A-Z]", "digit": "[0-9]", "mark": "[^a-zA-Z0-9]"}
_TRANSITIONS = [(a, b) for a in _CLASSES for b in _CLASSES if a != b]

FEATURES = [
    "length", "digits", "capitals", "smalls", "variety", *[f"{a}_{b}" for a, b in _TRANSITIONS], "covered", "hex", "known_prefix", "other_prefix", "uuid", "placeholder",
    "test_path", "secret_left", "other_left", "secret_near", "assigned", "quoted", "other_right", "joined_right",
]


def learn_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The ``words`` words of ASCII letters that the most documents have, ties by the word; counted over all texts."""
    low, high = WORD_LETTERS
    own = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w).between(low, high))
    counts = docs.select(F.explode(F.array_distinct(own)).alias("word")).groupBy("word").count()
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(words).collect()] or NO_CORPUS


def feature_struct(candidate: Column, left: Column, right: Column, path: Column, dictionary: list[str]) -> Column:
    """The forest's features of a candidate, its contexts and the document's path (null paths count as empty)."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")) / n
    flag = lambda c, pattern: F.coalesce(F.regexp_like(c, F.lit(pattern)), F.lit(False)).cast("double")
    # Longer words first, so that they are not covered in part.
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    values = [
        F.least(n, F.lit(200.0)), share("[^0-9]"), share("[^A-Z]"), share("[^a-z]"), F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(40.0)),
        *[F.regexp_count(candidate, F.lit(f"{_CLASSES[a]}(?={_CLASSES[b]})")) / n for a, b in _TRANSITIONS],
        1 - F.length(F.regexp_replace(F.lower(candidate), words, "")) / n,
        flag(candidate, "^[0-9a-f]+$"), flag(candidate, _PREFIX), flag(candidate, _OTHER_PREFIX), flag(candidate, "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), flag(candidate, _PLACEHOLDER),
        flag(path, _TEST_PATH), flag(left, _SECRET_WORD), flag(left, _OTHER_WORD), flag(F.concat(left, F.lit("\n"), right), _SECRET_NEAR),
        flag(left, _ASSIGNED), flag(right, "^[\"']"), flag(right, _OTHER_RIGHT), flag(right, "^[./@][A-Za-z0-9]"),
    ]
    return F.struct(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in zip(FEATURES, values, strict=True)])


def labelled_findings(spark: SparkSession, dictionary: list[str], n: int = FINDINGS, first: int = 0) -> DataFrame:
    """``n`` labelled findings (candidate, left, right, path, label) from number ``first`` on, by hashes of the numbers.

    Half are keys as they leak: random hexadecimal, base64 or prefixed ones, short passwords, credentials of a URL,
    whole private keys. The others only look so: checksums, ids, card numbers, placeholders, paths, shouted words of the
    dictionary, plain words behind a secret word, hashes of lock files, images as text, build stamps, and identifiers of
    every case, half of them of words that are not in the dictionary (its words with other vowels). Either kind occurs in test folders, the others more often.
    """
    lit, concat = F.lit, F.concat
    h, g = F.sha2(concat(lit("finding-"), F.col("id").cast("string")), 512), F.sha2(concat(lit("other-"), F.col("id").cast("string")), 512)
    piece = lambda c, a, k: F.substring(c, a, k)
    base32 = F.translate(F.upper(h), "0189", "XYZW")
    base64 = F.regexp_replace(F.translate(F.base64(F.unhex(h)), "\r\n=", ""), "[+/]", "q")
    digits = F.translate(h, "abcdef", "135790")
    listed = F.array(*map(lit, dictionary))
    word = lambda k: F.element_at(listed, (1 + F.pmod(F.xxhash64("id", lit(k)), lit(len(dictionary)))).cast("int"))
    mixed = F.translate(piece(base64, 11, 10), "aeiou", "!$#.-")
    strange = lambda k: F.translate(word(k), "aeiou", "eioua")
    camel = lambda *parts: concat(*[F.initcap(x) for x in parts])
    before, after = concat(word(1), lit(" "), word(2), F.element_at(F.array(*map(lit, [" ", ". ", "\n", ", "])), (1 + F.pmod("id", lit(4))).cast("int"))), concat(lit(" "), word(3), lit(" "), word(4))
    key = "-----BEGIN RSA PRIVATE KEY-----"
    keys = [
        (piece(h, 1, 40), lit('token = "'), lit('"')), (concat(lit("AKIA"), piece(base32, 5, 16)), before, after), (piece(h, 1, 18), lit("password="), after),
        (concat(lit("ghp_"), piece(base64, 1, 36)), before, after), (concat(lit("sk-"), piece(base64, 1, 48)), lit("key: "), after),
        (piece(base64, 3, 40), lit("aws_secret_access_key = "), lit("\n")), (piece(h, 9, 32), lit('api_key: "'), lit('",')),
        (concat(lit(key + "\n"), base64, lit("\n" + key.replace("BEGIN", "END"))), before, after), (lit(key), before, after),
        (piece(base64, 5, 24), lit("password: "), after), (piece(h, 20, 40), lit("Authorization: Bearer "), after),
        (concat(lit("AKIA"), piece(base32, 9, 16)), lit("key = "), after), (piece(base64, 7, 32), lit('secret="'), lit('"')),
        (mixed, lit("password="), after), (piece(mixed, 1, 8), lit("pwd: '"), lit("'")), (concat(lit("://"), word(5), lit(":"), piece(base64, 2, 12), lit("@")), lit("https"), word(6)),
        (concat(lit("://"), word(5), lit(":"), strange(6), piece(digits, 1, 2), lit("@")), lit("postgres"), word(7)), (concat(lit("://"), piece(word(5), 1, 1), lit(":"), word(6), piece(digits, 3, 1), lit("@")), concat(before, lit("mysql")), lit("db")),
    ]
    others = [
        (piece(digits, 1, 16), before, after), (piece(h, 1, 40), lit("commit "), after), (piece(h, 1, 64), lit("sha256:"), after),
        (F.concat_ws("-", piece(h, 1, 8), piece(h, 9, 4), piece(h, 13, 4), piece(h, 17, 4), piece(h, 21, 12)), lit("id: "), after),
        (concat(lit("your_token_"), word(5), lit("_"), piece(digits, 1, 4)), lit('token = "'), lit('"')),
        (F.concat_ws("/", word(5), word(6), piece(digits, 1, 4), word(7), piece(digits, 5, 2)), lit("src="), lit(".html")),
        (F.upper(piece(concat(word(5), word(6), word(7), word(8), word(9), word(10)), 1, 18)), before, lit("!! ")), (concat(lit("xxxxxxxxxxxxxxxx"), piece(digits, 1, 2)), lit("password="), after),
        (concat(lit("ORDER-"), piece(digits, 1, 8), lit("-"), piece(digits, 9, 4)), lit("order "), after),
        (F.concat_ws("_", word(5), word(6), word(7), piece(digits, 1, 3)), lit("name: "), after),
        (piece(h, 1, 32), lit("md5 checksum "), after), (concat(piece(digits, 1, 4), lit("-"), piece(digits, 5, 4), lit("-"), piece(digits, 9, 8)), lit("card "), after),
        (concat(word(5), word(6)), lit("password: "), after), (F.concat_ws("_", word(5), word(6), word(7)), lit("token = "), after),
        (concat(lit("://"), word(5), lit(":"), word(6), lit("example@")), lit("https"), word(7)), (concat(word(5), lit("-"), word(6), lit("-"), piece(digits, 2, 6)), lit('key="'), lit('.png"')),
        (concat(lit("sha512-"), base64, lit("==")), lit('"integrity": "'), lit('"')), (concat(lit("sha384-"), piece(base64, 1, 64)), lit('integrity="'), lit('"')),
        (piece(h, 1, 40), concat(lit("/-/"), word(5), lit("-1.0.2.tgz#")), lit('"')), (concat(lit("iVBORw0KGgo"), base64, base64), lit("data:image/png;base64,"), lit(")")),
        (concat(strange(5), camel(word(6), strange(7), word(8)), piece(digits, 1, 2)), before, after), (concat(camel(strange(5), strange(6), strange(7), strange(8)), piece(digits, 1, 1), camel(strange(9))), before, lit("(")),
        (camel(strange(5), word(6), strange(7)), lit("token="), lit("(")), (concat(word(5), camel(strange(6), word(7)), piece(digits, 1, 1)), lit("key: "), lit(",")),
        (concat(lit("build-20"), piece(digits, 1, 6), lit("-"), piece(h, 1, 8)), before, after), (F.concat_ws("_", F.upper(strange(5)), F.upper(word(6)), F.upper(strange(7)), piece(digits, 1, 2)), lit("const "), lit(" = ")),
    ]
    k = F.pmod("id", lit(len(keys) + len(others)))
    pick = lambda i: F.element_at(F.array(*[x[i] for x in [*keys, *others]]), (k + 1).cast("int"))
    in_tests = F.pmod(F.xxhash64("id", lit("path")), F.when(k < len(keys), 12).otherwise(3)) == 0
    return spark.range(first, first + n).select(
        pick(0).alias("candidate"), pick(1).alias("left"), pick(2).alias("right"), F.when(in_tests, "tests/fixtures/data").otherwise("src0").alias("path"), (k < len(keys)).cast("int").alias("label")
    )


def parse_forest(described: str) -> list[list]:
    """Trees of a forest's description as [feature, limit, at most, above] with leaves 0 or 1."""
    trees: list[list] = []
    lines: list[str] = []
    texts = []
    for line in described.split("\n")[1:]:
        if re.match(r"\s*Tree \d+ ", line):
            lines = []
            texts.append(lines)
        elif line.strip():
            lines.append(line.strip())

    def node(at: int, own: list[str]):
        m = re.match(r"Predict: ([\d.]+)", own[at])
        if m:
            return int(float(m[1])), at + 1
        m = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", own[at])
        low, at = node(at + 1, own)
        high, at = node(at + 1, own)  # past the Else line
        return [int(m[1]), float(m[2]), low, high], at

    for own in texts:
        trees.append(node(0, own)[0])
    return trees


def train_forest(findings: DataFrame, dictionary: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """A random forest of (candidate, left, right, path, label) rows; all of one label gives that label, none gives no."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    features = feature_struct(F.col("candidate"), F.col("left"), F.col("right"), F.col("path"), dictionary)
    rows = findings.select(features.alias("f"), F.col("label").cast("double").alias("label")).where("label IS NOT NULL").select("f.*", "label").coalesce(1)
    labels = [r[0] for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return [int(labels[0]) if labels else 0]
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(vectors)
    return parse_forest(model.toDebugString)


def forest_score(features: Column, trees: list) -> Column:
    """Share of the trees that take the finding for a secret."""

    def walk(tree) -> Column:
        if not isinstance(tree, list):
            return F.lit(float(tree))
        feature, limit, low, high = tree
        return F.when(features[FEATURES[feature]] <= limit, walk(low)).otherwise(walk(high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + walk(tree)
    return total / F.lit(float(len(trees)))


def _scanned(rows: DataFrame, dictionary: list[str], forest: list, threshold: float) -> DataFrame:
    """(row, findings, redacted) of rows (row, text, path)."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn("found", F.coalesce(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), none))
    # One more context than candidates: what stands before, between and after them.
    rows = rows.withColumn("between", F.when(F.size("found") > 0, F.split("text", CANDIDATE, -1)).otherwise(none))
    at, some = F.sequence(F.lit(1), F.size("found")), F.size("found") > 0
    found, between = lambda i: F.element_at("found", i), lambda i: F.element_at("between", i)
    features = F.transform(at, lambda i: feature_struct(found(i), F.right(between(i), F.lit(CONTEXT)), F.left(between(i + 1), F.lit(CONTEXT)), F.col("path"), dictionary))
    rows = rows.withColumn("features", F.when(some, features))
    rows = rows.withColumn("score", F.coalesce(F.transform("features", lambda f: forest_score(f, forest)), F.array().cast("array<double>")))
    # Offsets by sums of blocks and within a block, so that a text with very many findings is no square of them.
    add: Callable = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    rows = rows.withColumn("sizes", F.when(some, F.transform(at, lambda i: F.length(between(i)) + F.length(found(i)))))
    rows = rows.withColumn("sums", F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / SUMMED).cast("int")), lambda b: add(F.slice("sizes", b * SUMMED + 1, SUMMED))))
    rows = rows.withColumn("earlier", F.transform("sums", lambda x, b: add(F.slice("sums", F.lit(1), b))))
    block = lambda i: F.floor((i - 1) / SUMMED).cast("int")
    # Both arrays are read twice, which keeps them columns of their own: inlined, they would be made again for each finding.
    summed = lambda i: F.element_at("earlier", block(i) + 1) + add(F.slice("sizes", block(i) * SUMMED + 1, i - 1 - block(i) * SUMMED)) + F.length(between(i))
    begin = lambda i: F.when((F.size("earlier") > 0) & (F.size("sizes") > 0), summed(i))
    score = lambda i: F.element_at("score", i)
    finding = lambda i: F.struct(begin(i).alias("begin"), found(i).alias("candidate"), score(i).alias("score"), (score(i) >= threshold).alias("secret"))
    kind = "array<struct<begin:int,candidate:string,score:double,secret:boolean>>"
    findings = F.when(some, F.transform(at, finding)).otherwise(F.array()).cast(kind)
    shown = lambda i: F.concat(between(i), F.when(score(i) >= threshold, F.lit(MASK)).otherwise(found(i)))
    redacted = F.when(some, F.concat(F.array_join(F.transform(at, shown), ""), between(-1))).otherwise(F.col("text"))
    return rows.select("row", findings.alias("findings"), redacted.alias("redacted"))


def _trained(docs: DataFrame, dictionary: list[str] | None, trees: list | None) -> tuple[list[str], list]:
    dictionary = learn_dictionary(docs) if dictionary is None else dictionary
    return dictionary, train_forest(labelled_findings(docs.sparkSession, dictionary), dictionary) if trees is None else trees


def _rows(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """The kept columns as one struct, so that no name of theirs meets one of the scan's."""
    place = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("text").alias("text"), place.alias("path"))


def scan_secrets(
    docs: DataFrame, trees: list | None = None, path: str = "source", threshold: float = THRESHOLD, keep: list[str] | None = None, dictionary: list[str] | None = None
) -> DataFrame:
    """Find and mask the secrets of every whole text.

    ``path`` names the column with the document's place; without it, places count as unknown. A null text stays null
    and has no findings, an empty one none. Each row is judged apart, whatever its id; no rows give no rows. ``keep``
    names the columns to carry (doc_id only by default); one called ``findings`` or ``redacted`` gives way to the
    scan's own. Without ``trees``, the forest is trained on generated findings with the corpus's own dictionary.

    Returns these columns, findings (begin, candidate, score, secret; begin counts characters from 0) and redacted.
    """
    dictionary, forest = _trained(docs, dictionary, trees)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in ("findings", "redacted")]
    found = _scanned(_rows(docs, keep, path), dictionary, forest, threshold)
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], "findings", "redacted")


def mask_secrets(docs: DataFrame, trees: list | None = None, path: str = "source", threshold: float = THRESHOLD, dictionary: list[str] | None = None) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and, where a text changed, ``n_chars`` counted anew; all columns stay.

    Rows are judged as by ``scan_secrets``.
    """
    dictionary, forest = _trained(docs, dictionary, trees)
    found = _scanned(_rows(docs, docs.columns, path), dictionary, forest, threshold)
    changed = F.exists("findings", lambda f: f["secret"])
    count = lambda c: F.when(changed, F.length("redacted").cast(docs.schema[c].dataType)).otherwise(F.col("row").getField(c))
    return found.select(*[(F.col("redacted") if c == "text" else count(c) if c == "n_chars" else F.col("row").getField(c)).alias(c) for c in docs.columns])
