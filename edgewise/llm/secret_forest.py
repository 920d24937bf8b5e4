"""Secret scan with a random forest against false positives; DataFrame operations only.

Candidates are runs of at least 16 key characters, and runs of at least 8
right after a word that announces a secret, which are mixed or follow a colon or equals
sign. All runs of a blank-separated word are looked at, each with its own surroundings. Each
has features of its length, its character classes, the transitions between them and its
pairs of letters, the share that dictionary words cover, path and address marks, and the
words before and after it. A random forest of Spark's own library, trained on labelled
findings, scores them; what it finds false is returned with its score and no secret.

The labelled findings are a parameter (word, before, after, label); by default they are
made from a rule (:func:`labelled_findings`), a fixed number at any size of the corpus.

Defined cases: null and empty texts have no candidates; a text without a long run
or an announcing word is passed over; repeated rows are scanned one by one, equal candidates
of a text are separate findings; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"[A-Za-z0-9_+/=.~-]{16,}"
SHORT = r"[A-Za-z0-9_+/=.~!@^-]{8,}"
ANNOUNCE = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)s?['\"]?\s*[:=]*>?$"
KEYWORD = r"(?i)(pass|pwd|secret|token|key|auth|bearer|credential)"
#: Words of identifiers and file names, and words that stand by what is no secret.
WORDS = "access|account|address|admin|api|apache|backup|base|build|bucket|card|class|client|code|com|commit|config|content|data|date|default|demo|dev|document|dummy|example|field|file|function|hash|hello|html|http|https|image|img|index|info|item|json|key|license|list|local|mail|main|message|method|module|name|node|null|number|object|order|page|password|path|phone|photo|prod|public|report|request|sample|secret|server|service|string|system|table|test|time|token|type|update|url|user|value|version|www|your"
BENIGN = r"(?i)\b(commit|sha1|sha256|md5|checksum|digest|revision|uuid|guid|card|visa|iban|isbn|phone|tel|call|order|invoice|tracking|version|example|sample|dummy|placeholder|fake|test)\b"
PLACEHOLDER = r"(?i)(x{4,}|0{6,}|1234567|abcdef|example|sample|dummy|your[_-]?|changeme|placeholder|test)"
#: The most frequent pairs of letters of English, French, German and Spanish words.
PAIRS = "al|an|ar|as|at|ch|co|de|di|ea|ed|en|er|es|ha|he|hi|ic|ie|il|in|io|is|it|la|le|li|ma|me|nd|ne|ng|nt|on|or|ou|qu|ra|re|ri|ro|se|si|st|te|th|ti|to|ue|un|ur|ve"
FINDINGS = 9000
TREES, TREE_DEPTH, SEED = 24, 7, 3
FEATURES = ["size", "digits", "upper", "lower", "marks", "hex", "runs", "longest", "vowels", "variety", "rises", "falls", "to_digit", "from_digit", "pairs", "words", "path", "address", "prefix", "number", "uuid", "placeholder", "announced", "benign", "quoted"]


def features(word: Column, before: Column, after: Column) -> list[Column]:
    """The FEATURES of a candidate with its surroundings (blank-separated texts)."""
    core = F.regexp_extract(word, SHORT, 0)
    n = F.greatest(F.length(core), F.lit(1))
    share = lambda chars: F.length(F.regexp_replace(core, f"[^{chars}]", "")) / n
    classes = core
    for chars, mark in (("A-Z", "U"), ("a-z", "l"), ("0-9", "0"), ("^Ul0", "-")):
        classes = F.regexp_replace(classes, f"[{chars}]+", mark) if mark != "-" else classes
    letters = F.greatest(F.length(F.regexp_replace(core, "[^A-Za-z]", "")), F.lit(1))
    longest = F.expr("0") + F.coalesce(F.array_max(F.transform(F.regexp_extract_all(core, F.lit("([A-Za-z]+)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = [
        n, share("0-9"), share("A-Z"), share("a-z"), share("_+/=.~!@^-"), share("0-9a-fA-F"), F.length(classes) / n, longest / n,
        F.length(F.regexp_replace(core, "[^aeiouAEIOU]", "")) / letters,
        F.size(F.array_distinct(F.split(core, ""))) / n,
        *(F.size(F.regexp_extract_all(core, F.lit(f"(?=({x}))"), F.lit(1))) / n for x in ("[a-z][A-Z]", "[A-Z][a-z]", "[A-Za-z][0-9]", "[0-9][A-Za-z]")),
        F.size(F.regexp_extract_all(F.lower(core), F.lit(f"(?=({PAIRS}))"), F.lit(1))) / letters,
        1 - F.length(F.regexp_replace(F.lower(core), f"({WORDS})", "")) / n,
        flag(word.rlike(r"/.*/|\\|\.(jpg|png|html?|js|css|py|txt|pdf|zip|xml|json|csv)\b")), flag(word.rlike(r"(?i)://|www\.|@.*\.")),
        flag(core.rlike(r"^(AKIA|ASIA|gh[pousr]_|github_pat_|xox[abp]-|sk[-_]|pk[-_]|AIza|eyJ|glpat-|npm_)")),
        flag(core.rlike(r"^[0-9.-]+$")), flag(core.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")), flag(core.rlike(PLACEHOLDER)),
        flag(F.concat_ws(" ", before, F.regexp_extract(word, r"^(.*?)[=:]", 1)).rlike(ANNOUNCE)), flag(F.concat_ws(" ", before, after).rlike(BENIGN)), flag(word.rlike("['\"]")),
    ]
    return [c.cast("double").alias(name) for name, c in zip(FEATURES, out, strict=True)]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n findings (word, before, after, label) made by rule: half secrets of common forms, half other
    long strings: numbers, digests of files, identifiers, paths, addresses and placeholders."""
    hex_ = lambda tag, k: f"substr(sha2(concat('{tag}', id), 256), 1, {k})"
    b64 = lambda tag, k: f"substr(regexp_replace(base64(unhex(sha2(concat('{tag}', id), 512))), '[=/+]', 'q'), 1, {k})"
    pick = lambda tag, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(pmod(xxhash64('{tag}', id), {len(xs)}) AS int) + 1)"
    syllables = ["un", "ter", "neh", "men", "ver", "ant", "wort", "tion", "ment", "con", "sti", "tu", "re", "pre", "sen", "ta", "the", "ing", "lich", "keit", "ci", "on", "al", "eur"]
    word = lambda tag, k: "initcap(concat(" + ", ".join(pick(f"{tag}{j}", *syllables) for j in range(2 + k)) + "))"
    letters = lambda tag, k: f"substr(regexp_replace(base64(unhex(concat(sha2(concat('{tag}', id), 512), sha2(concat('{tag}2', id), 512)))), '[=/+0-9]', ''), 1, {k})"
    says = pick("s", "token =", "api_key :", "secret =", "password:", "access_key =", "auth", "the token", "key: secret =")
    plain = pick("p", "the and of", "to in is", "with for", "der die und", "le la de", "see also", "of this")
    digits = "lpad(cast(pmod(xxhash64('d', id), 10000000000000000) AS string), 16, '4')"
    secret = [
        (f"""concat('"', {hex_('a', 40)}, '"')""", says), (f"concat('AKIA', upper({hex_('b', 16)}))", f"if(id % 3 = 0, {plain}, {says})"), (f"concat('ghp_', {b64('c', 36)})", plain),
        (b64("e", 40), says), (f"concat({b64('f', 7)}, '!', {hex_('f', 5)})", "'password ='"), (f"concat('eyJ', {b64('g', 50)})", plain), (hex_("h", 32), says), (f"concat('token=', {b64('i', 24)})", plain),
        (letters("r", 40), says), (letters("s", 20), "'password ='"), (f"concat({word('t', 3)}, {word('u', 3)}, {word('v', 3)})", "'password:'"), (f"concat('sk_live_', {b64('w', 24)})", plain),
    ]
    other = [
        (digits, plain), (digits, pick("c", "card", "visa", "the order", "number")), (hex_("j", 40), pick("h", "commit", "sha1", "revision of")), (hex_("k", 32), "'md5 checksum'"),
        (f"concat_ws('-', {hex_('l', 8)}, {hex_('m', 4)}, {hex_('n', 4)}, {hex_('o', 4)}, {hex_('p', 12)})", plain),
        (f"concat('http://www.example.com/item/', {hex_('q', 6)}, '?page=', id)", plain), (f"concat('images/photo_2024', id, '_sample_page.jpg')", plain),
        (f"concat('user.name', id, '@mail.example.com')", plain), ("concat('your_api_key_', id, '_example')", says), ("concat('xxxxxxxxxxxxxxxx', id)", says),
        (f"concat('order-list-item-', id, '-version-', pmod(id, 9))", plain), (f"concat('thereisinthat', id, 'ofandthe')", plain),
        (f"lower(concat({word('x', 1)}, {word('y', 1)}, {word('z', 1)}, {word('A', 1)}))", plain), (f"concat(lower({word('B', 1)}), {word('C', 1)}, {word('D', 1)})", plain), (f"upper(concat_ws('_', {word('E', 1)}, {word('F', 1)}, {word('G', 1)}))", plain),
        (f"lower(concat_ws('-', {word('H', 1)}, 'of', {word('I', 1)}, {word('J', 1)}))", plain), (f"lower(concat('/usr/', {word('K', 1)}, '/', {word('L', 1)}, '/', {word('M', 1)}))", plain), (f"lower(concat_ws('_', {word('N', 1)}, {word('O', 1)}, {word('P', 1)}))", plain),
        (f"upper(concat({word('Q', 1)}, {word('R', 1)}, {word('S', 1)}))", plain), (f"lower(concat({word('T', 1)}, {word('U', 1)}))", pick("V", "the token", "a secret", "of the password", "key")),
    ]
    ids = spark.range(0, n, 1, 1)
    case = lambda rows, k: " ".join(f"WHEN {i} THEN {r[k]}" for i, r in enumerate(rows))
    form = lambda k: f"CASE WHEN id % 2 = 0 THEN CASE cast(id div 2 AS int) % {len(secret)} {case(secret, k)} END ELSE CASE cast(id div 2 AS int) % {len(other)} {case(other, k)} END END"
    return ids.selectExpr(f"{form(0)} AS word", f"{form(1)} AS before", f"{plain} AS after", "cast(1 - id % 2 AS double) AS label")


def train(findings: DataFrame):
    """A forest from labelled findings (word, before, after, label)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select("label", *features(F.col("word"), F.col("before"), F.col("after")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, featuresCol="_features", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features"), forest]).fit(rows.coalesce(1))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, run, word, before, after): candidates of ``docs`` (doc_id, text) by word number and
    number of the run in its word; ``word`` is the run with the character on either side of it."""
    text, digit = F.col("text"), lambda x: x.rlike("[0-9]")
    likely = docs.select("doc_id", "text").where(text.rlike(RUN) | text.rlike(KEYWORD))
    words = likely.select("doc_id", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("words"))
    said = lambda i: F.array_join(F.slice(F.col("words"), F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
    worth = lambda x, i: x.rlike(SHORT) & (x.rlike(RUN) | x.rlike(KEYWORD) | said(i).rlike(ANNOUNCE))
    hits = F.filter(F.transform("words", lambda x, i: F.when(worth(x, i), i)), lambda i: i.isNotNull())
    out = words.select("doc_id", "words", F.explode(hits).alias("place"))
    whole = F.get("words", F.col("place"))
    out = out.select(
        "doc_id", "place", F.when(F.col("place") > 0, said(F.col("place"))).otherwise("").alias("said"),
        F.array_join(F.slice("words", F.col("place") + 2, 3), " ").alias("next"),
        F.regexp_extract_all(whole, F.lit(SHORT), F.lit(0)).alias("runs"), F.split(whole, SHORT).alias("gaps"),
    )
    # Gap i stands before run i and gap i + 1 after it.
    near = lambda name, i: F.coalesce(F.get(name, i), F.lit(""))
    out = out.select("doc_id", "place", "said", "next", "runs", "gaps", F.posexplode("runs").alias("run", "core"))
    k = F.col("run")
    lead, tail = F.concat(near("runs", k - 1), near("gaps", k)), F.concat(near("gaps", k + 1), near("runs", k + 1))
    out = out.select(
        "doc_id", "place", "said", "run", "core", F.regexp_replace(F.trim(F.concat_ws(" ", "said", lead)), r"['\"\s]+$", "").alias("before"),
        F.trim(F.concat_ws(" ", tail, "next")).alias("after"), F.right(near("gaps", k), F.lit(1)).alias("left"), F.left(near("gaps", k + 1), F.lit(1)).alias("right"),
        F.regexp_extract_all("core", F.lit(RUN), F.lit(0)).alias("long"),
    )
    core = F.col("core")
    heard = F.concat_ws(" ", "before", F.regexp_extract(core, "^([^=]*=)", 1))
    announced = ((F.col("said").rlike(ANNOUNCE) & (k == 0)) | F.col("before").rlike(ANNOUNCE) | F.rtrim(heard).rlike(ANNOUNCE)) & ((digit(core) & core.rlike("[A-Za-z]")) | F.rtrim(heard).rlike("[:=]>?$"))
    one = F.array(F.concat("left", "core", "right"))
    # The marks of short runs may join two long ones.
    found = F.when(F.size("long") > 1, F.col("long")).when((F.size("long") == 1) | announced, one)
    return out.select("doc_id", "place", "run", F.explode(found).alias("word"), "before", "after")


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, place, run, word, score, secret) of every candidate in ``docs`` (doc_id, text)."""
    from pyspark.ml.functions import vector_to_array

    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs)
    rows = found.select("doc_id", "place", "run", "word", *features(F.col("word"), F.col("before"), F.col("after")))
    score = vector_to_array(F.col("_probability"))[1]
    return model.transform(rows).select("doc_id", "place", "run", "word", score.alias("score"), (score >= least).alias("secret"))
