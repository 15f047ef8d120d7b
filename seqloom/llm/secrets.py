"""Secret scans with a random forest that removes false positives; SQL expressions only.

Candidates are what CANDIDATE matches: keys with a known prefix, private keys in PEM form as a whole, values assigned to a
telling name (whatever comes before it in a longer name), passwords in URLs, long tokens with a digit (but in data URLs), very long ones without,
and long last parts of paths. Each candidate is described by its length, its character transitions (changes between lower case,
upper case, digits and signs, and the share of different characters), how much of it dictionary words cover, signs of a path, and
the words beside it. A random forest, trained from labelled findings, gives the share of its trees' leaves for a secret.

The dictionary is the WORDS most frequent words of the documents themselves, counted over all of them, beside a few fixed ones.
The forest is fitted by MLlib on the findings (a bounded table: ``findings`` labels, by default a stated set made by
rule), and then written out as one SQL expression. So a document is scanned, judged and redacted within its row: no
Python, no shuffle but the word counts', and nothing to gather but a document's own candidates.

Defined results: a null or empty text has no findings and stays as it is; whole texts are scanned at any length; equal
findings are findings each; repeated rows are scanned alike; an empty table gives an empty result; other columns take no
part and are kept by ``redact``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import table

TREES, DEPTH, SEED, FINDINGS = 15, 6, 9, 9000
#: Words of the documents that the dictionary holds, and how often each stands there at least.
WORDS, OFTEN = 300, 5
MASK = "[SECRET]"

#: Names that a secret is assigned to, and prefixes of keys.
NAMES = (
    r"(?i:password|passwort|kennwort|contrase[n\u00f1]a|mot[ _-]de[ _-]passe|passphrase|passwd|(?<![a-z])pass|pwd|secret|geheimnis|token|jeton|webhook|credentials?"
    r"|(?:api|access|auth|private|signing|encryption|client|account|service)[_-]?key)(?i:[_-](?:key|value|string|token|base64))?"
)
#: A name ends a run of the prefix's characters; that the run ends before a sign is seen first, which keeps the search linear.
ASSIGNED = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]*+(?: de passe|\u00f1a)?[\x22\x27]?\s{0,3}[:=])[A-Za-z0-9+/_.-]*?" + NAMES + r"[\x22\x27]?\s{0,3}[:=]\s{0,3}[\x22\x27]?(?=[^\s\x22\x27<>,;]{6})"
#: A user's name in a URL, before the password.
USER = r"://[^\s:/@\x22\x27]{1,64}:"
LOGIN = USER + r"(?=[^\s/@\x22\x27]{3,128}@)"
#: To the END line; without one, to the last of the lines of base64 that follow.
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-(?!----)[^-]*+){0,64}-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----|(?:\s{1,4}[A-Za-z0-9+/=]{40,}){0,200}(?:\s{1,4}[A-Za-z0-9+/]{2,39}={1,2})?)"
KEYS = (
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|https://(?:hooks\.[a-z.]{3,40}/[A-Za-z0-9/_-]{20,}|[a-z.]{3,40}/api/webhooks/[A-Za-z0-9/_-]{20,})"
)
KNOWN = KEYS + "|" + PEM
#: What a data URL holds is an image or a font, not a token.
TOKEN = r"(?<!;base64,)(?<![A-Za-z\u00c0-\u024f0-9+/_=.-])(?:(?=[A-Za-z+/_-]{0,40}[0-9])[A-Za-z0-9+/_-]{20,}|[A-Za-z0-9+/_-]{36,}+(?![\u00c0-\u024f]))={0,2}|(?<=/)(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{24,}(?![A-Za-z0-9_/.-])"
BEFORE = "(?:" + ASSIGNED + "|" + USER + ")"
CANDIDATE = "(?:" + PEM + "|(?<![A-Za-z0-9])(?:" + KEYS + ")|" + ASSIGNED + "(?:" + PEM + r"|[^\s\x22\x27<>,;]{6,})|" + LOGIN + r"[^\s/@\x22\x27]{3,128}|" + TOKEN + ")"
#: Words that secrets don't hold, and words that tell of something else beside a token.
DICTIONARY = (
    r"password|passwd|secret|token|example|sample|change|dummy|default|placeholder|public|private|access|user|admin|login|your|here|test|demo|none|null|true|false|value|string|name|field|index|table|column|config|setting|server|client"
    r"|request|response|service|module|class|function|object|data|file|path|image|page|html|http|https|www|version|release|build|debug|error|message|number|length|width|height|color|style|north|south|street|house|water|world|people|there|which"
    r"|about|would|these|other|after|first|every|under|where|never|before|again|still|while|might|would|could|should|thing|place|point|group|state|system|order|right|small|large|great|night|light|white|black|green|change"
)
OTHER = r"(?i)(commit|sha-?(1|256|512)?|md5|checksum|digest|hash|uuid|guid|etag|integrity|revision|build|version|isbn|invoice|order|phone|card|account|iban|tracking|id)[^A-Za-z0-9]{0,6}$"
EXAMPLE = r"(?i)example|sample|dummy|placeholder|your|change|xxxx|test|demo|fake|insert|redacted|\*\*\*|<|\$\{|\{\{"


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body, with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: By name, of value v, the text before it b, and after it a.
FEATURES = {
    "length": "length(v)",
    "transitions": f"(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, {_q('[a-z]')}, 'a'), {_q('[A-Z]')}, 'B'), {_q('[0-9]')}, '1'), {_q(r'(.)\1+')}, '$1')) - 1) / (length(v) + 1.0)",
    "different": "size(array_distinct(split(v, ''))) / (length(v) + 1.0)",
    "digits": f"regexp_count(v, {_q('[0-9]')}) / (length(v) + 1.0)",
    "upper": f"regexp_count(v, {_q('[A-Z]')}) / (length(v) + 1.0)",
    "vowels": f"regexp_count(v, {_q('[aeiouAEIOU]')}) / (length(v) + 1.0)",
    "repeats": f"(length(v) - length(regexp_replace(v, {_q(r'(.)\1+')}, '$1'))) / (length(v) + 1.0)",
    "hex": f"int(v RLIKE {_q('^([0-9a-f]+|[0-9A-F]+)$')})",
    "uuid": f"int(v RLIKE {_q('^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')})",
    "dictionary": f"(length(v) - length(regexp_replace(v, {_q('(?i)DICTIONARY')}, ''))) / (length(v) + 1.0)",
    "known": f"int(v RLIKE {_q('^(' + KNOWN + ')')})",
    "slashes": f"regexp_count(v, {_q('[/]')})",
    "path": f"int(v RLIKE {_q(r'^[./~]|[.](html?|js|css|png|jpe?g|py|txt|json|xml|pdf)$|(/[a-z_-]{3,}){2}')} OR right(b, 60) RLIKE {_q(r'(://|[/\\])[^\s]*$')})",
    "named": f"int(right(b, 60) RLIKE {_q(NAMES + r'[^A-Za-z0-9]{0,12}$')})",
    "named_near": f"int(right(b, 60) RLIKE {_q(NAMES)})",
    "login": f"int(right(b, 70) RLIKE {_q(r'://[^\s:/@]{1,64}:$')})",
    "data": f"int(right(b, 60) RLIKE {_q(r'data:[a-z0-9/+.-]{3,40};base64,$')})",
    "letters": f"int(v RLIKE {_q('^[A-Za-z]+$')})",
    "slug": f"int(v RLIKE {_q('^([A-Za-z]{1,12}|[0-9]{1,4})([-_/]([A-Za-z]{1,12}|[0-9]{1,4})){2,}$')})",
    "other": f"int(right(b, 24) RLIKE {_q(OTHER)})",
    "example": f"int(concat(right(b, 30), ' ', v, ' ', left(a, 12)) RLIKE {_q(EXAMPLE)})",
}


def default_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings by rule: b, v, a, label (1: a secret). Values come from md5 of the number, so they are the same each time."""
    d = spark.range(0, n, 1, 2).selectExpr("id", "md5(concat('finding ', id)) AS m", "md5(concat('more ', id)) AS o", "cast(pmod(xxhash64(id), 42) AS int) AS k", "cast(pmod(xxhash64(id, 1), 6) AS int) AS w")
    mixed = "replace(replace(replace(base64(unhex(concat(m, o))), '+', 'x'), '/', 'Q'), '=', '')"
    capital = "substring(translate(upper(concat(m, o)), '0123456789ABCDEF', 'QW3RT6YU9PAS2FGH'), 1, 16)"
    near = "element_at(array('the ', 'and so on. ', 'use this: ', 'for it, ', 'export ', '// '), w + 1)"
    words = "element_at(array('readRequestFromClientObject', 'table_of_service_names_version', 'north-street-house-number', 'getUserNameFieldLength', 'page-style-color-default', 'there-is-nothing-to-see-here'), w + 1)"
    lines = "array_join(transform(sequence(1, 3 + 4 * w), i -> left(regexp_replace(base64(unhex(sha2(concat(m, i), 512))), '[^A-Za-z0-9+/]', ''), 64)), '\\n')"
    kind = "element_at(array('RSA ', 'EC ', '', 'OPENSSH ', 'ENCRYPTED ', 'DSA '), w + 1)"
    pem = lambda body: f"concat('-----BEGIN ', {kind}, 'PRIVATE KEY-----\\n', {body}, '\\n-----END ', {kind}, 'PRIVATE KEY-----')"
    plain = "translate(concat(m, o), '0123456789', 'ghijklmnop')"
    rules = [
        (1, f"concat({near}, 'token = \"')", "concat(m, left(o, 8))", "'\" and'"),
        (1, f"concat({near}, 'password=')", "left(m, 12 + 2 * w)", "' or'"),
        (1, near, f"concat('AKIA', {capital})", "' then'"),
        (1, f"concat({near}, 'api_key: ')", f"left({mixed}, 32)", "''"),
        (1, f"concat({near}, 'secret = \"')", f"left({mixed}, 24 + w)", "'\"'"),
        (1, near, f"concat('ghp_', left({mixed}, 36))", "' '"),
        (1, f"concat({near}, 'access_key=')", f"concat('AKIA', {capital})", "' then'"),
        (1, f"concat({near}, 'passwd: ')", f"concat(left({mixed}, 7), '!', left(o, 3 + w))", "' then'"),
        (0, f"concat({near}, 'commit ')", "concat(m, left(o, 8))", "' and'"),
        (0, f"concat({near}, 'sha256: ')", "concat(m, o)", "'.'"),
        (0, f"concat({near}, 'id ')", "concat_ws('-', left(m, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), left(o, 12))", "' is'"),
        (0, near, f"concat({words}, w)", "' in'"),
        (0, f"concat({near}, 'https://host/')", f"concat('static/image/', {words}, w, '/page')", "'.html'"),
        (0, f"concat({near}, 'token = \"')", "element_at(array('your-token-here', 'example_token_1', 'changeme123', 'xxxxxxxxxxxxxxxx', 'INSERT_TOKEN', 'null-or-none'), w + 1)", "'\"'"),
        (0, f"concat({near}, 'password: ')", "element_at(array('password1', 'changeme', '********', 'required', 'string', 'default-value'), w + 1)", "' and'"),
        (0, f"concat({near}, 'key ')", "concat('AKIA', 'EXAMPLE', left('EXAMPLEEXAMPLE', 9))", "' then'"),
        (0, f"concat({near}, 'order ')", "translate(concat(m, left(o, w)), 'abcdef', '123456')", "' was'"),
        (0, f"concat({near}, 'token=')", f"left({words}, 18)", "' '"),
        (0, near, f"concat('/usr/share/', {words}, w)", "' '"),
        (1, near, pem(lines), "''"),
        (1, f"concat({near}, 'private_key = \"')", pem(lines), "'\"'"),
        (0, near, pem("'your private key here'"), "''"),
        (1, f"concat({near}, 'AWS_ACCESS_KEY_ID=')", f"concat('AKIA', {capital})", "' then'"),
        (1, f"concat({near}, 'DB_PASSWORD=')", "left(m, 12 + 2 * w)", "' or'"),
        (1, f"concat({near}, 'mongodb://root:')", f"left({mixed}, 8 + 2 * w)", "'@db.host:27017/x'"),
        (1, f"concat({near}, 'postgres://app_user:')", "left(m, 6 + w)", "'@10.0.0.1/x'"),
        (1, f"concat({near}, 'DB_PASS=')", f"left({mixed}, 9 + w)", "' or'"),
        (1, f"concat({near}, 'SECRET_KEY=')", f"left({mixed}, 30 + w)", "'\n'"),
        (1, f"concat({near}, 'Passwort: ')", f"concat(left({mixed}, 8), '#', w)", "' und'"),
        (1, near, f"concat('https://hooks.slack.com/services/T0', upper(left(m, 8)), '/B0', upper(left(o, 8)), '/', left({mixed}, 24))", "' then'"),
        (1, near, f"left({plain}, 40 + 3 * w)", "' and'"),
        (1, near, f"left(translate({mixed}, '0123456789', 'qWeRtYuIoP'), 36 + w)", "' and'"),
        (1, near, f"left({mixed}, 32 + w)", "' and'"),
        (1, f"concat({near}, 'https://host.example/reset/')", f"left({mixed}, 28 + w)", "' now'"),
        (0, f"concat({near}, 'data:image/png;base64,')", f"concat('iVBORw0KGgo', {mixed}, {mixed})", "'\"'"),
        (0, f"concat({near}, 'https://host.example/a/commit/')", "concat(m, left(o, 8))", "' in'"),
        (0, f"concat({near}, 'sha1=')", "concat(m, left(o, 8))", "' in'"),
        (0, near, f"concat(replace({words}, '_', ''), replace({words}, '-', ''))", "' in'"),
        (0, f"concat({near}, 'https://host/')", f"concat('2020/11/some-', {words}, '-of-the-week')", "' in'"),
        (0, f"concat({near}, 'call ')", "concat('00', left(translate(m, 'abcdef', '314159'), 2), '-', left(translate(o, 'abcdef', '271828'), 2), '-', left(translate(o, 'abcdef', '161803'), 16 + w))", "' at'"),
        (0, near, f"concat({words}, lower(replace(replace({words}, '_', ''), '-', '')), 'gesellschaft')", "' ist'"),
        (0, f"concat({near}, 'pass: ')", "element_at(array('through', 'the-gate', 'Saturday', 'first-class', 'mountain', 'between'), w + 1)", "' and'"),
    ]
    case = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {r[i]}" for k, r in enumerate(rules)) + " END"
    return d.selectExpr(f"{case(1)} AS b", f"{case(2)} AS v", f"{case(3)} AS a", f"double({case(0)}) AS label")


def dictionary(docs: DataFrame, text: str, most: int = WORDS, often: int = OFTEN) -> str:
    """A pattern of the fixed words and the documents' ``most`` most frequent words of four letters or more, the longest first."""
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z\u00df-\u00ff]{4,12}"), 0)).alias("w")
    top = docs.select(word).groupBy("w").count().filter(F.col("count") >= often).orderBy(F.desc("count"), "w").limit(most)
    return "|".join(sorted({*DICTIONARY.split("|"), *(r.w for r in top.collect())}, key=lambda w: (-len(w), w)))


def described(words: str) -> dict[str, str]:
    """FEATURES with the dictionary put in."""
    return {k: x.replace("(?i)DICTIONARY", "(?i)" + words) for k, x in FEATURES.items()}


def train(findings: DataFrame, words: str = DICTIONARY, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """The forest as an SQL expression over a struct f of FEATURES: the mean share of secrets in the leaves."""
    d = findings.selectExpr("label", *(f"double({x}) AS `{k}`" for k, x in described(words).items()))
    d = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(d)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(d)
    names = list(FEATURES)

    def written(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / max(1e-9, sum(stats)):.4f}D" if len(stats) > 1 else "0D"
        split = node.split()
        return f"CASE WHEN f.`{names[split.featureIndex()]}` <= {split.threshold()!r}D THEN {written(node.leftChild())} ELSE {written(node.rightChild())} END"

    return "(" + " + ".join(written(t._java_obj.rootNode()) for t in model.trees) + f") / {len(model.trees)}"


def _found(forest: str, words: str, line: float) -> str:
    """An array of the text's findings: what was matched, the value in it, the share, and whether it is a secret."""
    one = "struct(" + ", ".join(f"double({x}) AS `{k}`" for k, x in described(words).items()) + ")"
    # l: the match, its value, and what is before and after
    parts = f"struct(get(_m, i) AS m, regexp_replace(get(_m, i), {_q('^' + BEFORE)}, '') AS v, right(get(_s, i), 60) AS b, left(get(_s, i + 1), 40) AS a)"
    feature = one
    for name in ("v", "b", "a"):
        feature = _bound(feature, name, f"x.{name}")
    judged = _let("struct(l.v AS v, concat(l.b, left(l.m, length(l.m) - length(l.v))) AS b, l.a AS a)", "x", _let(feature, "f", forest))
    body = _let(parts, "l", f"struct(i + 1 AS finding, l.m AS m, l.v AS v, {judged} AS probability)")
    return f"transform(CASE WHEN size(_m) > 0 THEN sequence(0, size(_m) - 1) ELSE array() END, i -> {_let(body, 'r', f'struct(r.finding, r.m, r.v, r.probability, r.probability >= {line} AS is_secret)')})"


def _bound(sql: str, name: str, to: str) -> str:
    """sql with a bare one-letter name replaced, outside literals."""
    out, inside, i = [], False, 0
    while i < len(sql):
        c = sql[i]
        if inside:
            inside = c != "'"
            out.append(c)
        elif c == "'":
            inside = True
            out.append(c)
        elif c == name and not (i and (sql[i - 1].isalnum() or sql[i - 1] in "_.`")) and not (i + 1 < len(sql) and (sql[i + 1].isalnum() or sql[i + 1] in "_`'")):
            out.append(to)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def learned(docs: DataFrame, text: str, findings: DataFrame | None) -> tuple[str, str]:
    """The dictionary and the forest."""
    words = dictionary(docs, text)
    return words, train(default_findings(docs.sparkSession) if findings is None else findings, words)


def _scanned(docs: DataFrame, text: str, words: str, forest: str, line: float) -> DataFrame:
    """_m (matches), _s (what stands between them) and _found of docs, beside the columns that it has."""
    d = docs.withColumn("_m", F.expr(f"coalesce(regexp_extract_all(`{text}`, {_q(CANDIDATE)}, 0), array())"))
    d = d.withColumn("_s", F.expr(f"CASE WHEN size(_m) > 0 THEN split(`{text}`, {_q(CANDIDATE)}, -1) END"))
    return d.withColumn("_found", F.expr(_found(forest, words, line)))


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", keep=("doc_id",), line: float = 0.5) -> DataFrame:
    """A row per finding: the columns of keep, finding (its number in the text, from 1), rule, n_chars, value_sha256, probability, is_secret."""
    d = docs.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text"))
    d = _scanned(d, "_text", *learned(d, "_text", findings), line).filter("size(_m) > 0").select("_row.*", F.explode("_found").alias("r"))
    rule = F.expr(f"CASE WHEN r.v RLIKE {_q('^(' + KNOWN + ')')} THEN 'known' WHEN length(r.m) > length(r.v) THEN 'assigned' ELSE 'token' END")
    return d.select(*keep, "r.finding", rule.alias("rule"), F.length("r.v").cast("long").alias("n_chars"), F.sha2("r.v", 256).alias("value_sha256"), "r.probability", "r.is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", line: float = 0.5, mask: str = MASK) -> DataFrame:
    """docs, each secret in the text replaced by mask."""
    d = docs.select(F.col(text).alias("_text"), F.struct("*").alias("_row"))
    d = _scanned(d, "_text", *learned(d, "_text", findings), line)
    piece = f"concat(get(_s, i), CASE WHEN i >= size(_m) THEN '' WHEN get(_found, i).is_secret THEN concat(left(get(_m, i), length(get(_m, i)) - length(get(_found, i).v)), '{mask}') ELSE get(_m, i) END)"
    new = F.expr(f"CASE WHEN size(_m) > 0 THEN array_join(transform(sequence(0, size(_m)), i -> {piece}), '') ELSE _text END")
    return d.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op9_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_forest_secrets": op9_forest_secrets}
ORACLE: dict[str, str] = {}
