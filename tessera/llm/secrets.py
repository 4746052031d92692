"""Secret scanning with a random forest that removes false positives.

Candidates come from one pattern: private-key blocks, assignments to names such
as ``password``, ``DB_PASS`` or ``token``, also in the attributes of an element (a quoted value goes to its closing quote, past quotes with a backslash before them), passwords
in URLs, and tokens of 16 or more characters with a prefix that vendors publish or
with a digit. No run of characters in it has an upper bound and none gives anything
back, so a value is whole however long it is, and the search is linear. A key block goes to its END line, whatever stands
between (headers of encrypted keys, armour, line ends written as ``\\n``); a URL's password to the last ``@``.
The text is split by the same pattern, so each candidate is known with its place
and with what stands before and after it. Features are length, transitions
between character classes, distinct characters, coverage by dictionary words,
marks of paths and addresses, and words nearby. The dictionary is counted over the
whole corpus (:func:`dictionary`). A random forest, trained in numpy from labelled
findings on the driver, is then written out as a column expression of nested conditions.

All of a row's work is done in that row with built-in functions; nothing is
shuffled but the dictionary's counts and no Python runs on executors. A document may hold any number of
candidates: they are an array of its own row until :func:`findings` explodes it.

Defined cases: null or empty text has no findings and stays as it is; equal
values in a text are separate findings; where several kinds fit at one place the
first in the order above is taken; repeated rows are treated one by one; very long
texts and values are searched to their end (of a value's distinct characters the
first 512 are a feature); an empty table has no dictionary but the fixed words;
:func:`redact` keeps all other columns, whatever their names, as it adds none.
"""

from __future__ import annotations

import functools
import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret(?:[_-]?key)?|(?:access[_-]?|auth[_-]?|refresh[_-]?|bot[_-]?)?token|api[_-]?key|apikey|access[_-]?key(?:[_-]?id)?|private[_-]?key|client[_-]?secret|credentials?)"
#: Also from a quoted name to the next attribute, ``value``.
SEPARATED = r"(?:[\"']?[^\S\r\n]*+(?:=>|:=|==|[:=])|[\"'][^\S\r\n]++(?i:value)[^\S\r\n]*+=)[^\S\r\n]*+"
ASSIGN = rf"(?i:{NAMES}){SEPARATED}"
#: Where a name may begin: not amid letters but at a change of case or in capitals (``dbPassword``, ``PGPASSWORD``); ``pass`` alone needs a name before it (``DB_PASS``).
STARTS = r"(?=[aAbBcCpPrRsStT])(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z]{4}))(?:(?!(?i:pass)[^A-Za-z])|(?<=[_-]))"
#: A quoted value goes to the first quote without a backslash before it.
VALUE = r"(?![\"']?-----BEGIN )(?:\"(?:[^\"\\\r\n]|\\[^\r\n]){6,}+(?=\")|'(?:[^'\\\r\n]|\\[^\r\n]){6,}+(?=')|[\"']?[^\s\"',;<>|]{6,}+)"
PRIVATE, PRIVATE_END = (rf"-----{w} [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----" for w in ("BEGIN", "END"))
#: Whatever stands before the END line, with up to 64 single dashes or runs of fewer than five; without such a line what looks like a body.
PRIVATE_BODY = rf"(?:(?:[^-]++-{{1,4}}+(?!-)){{0,64}}+[^-]*+{PRIVATE_END}|[A-Za-z0-9+/=\s]*+)"
#: Prefixes that vendors of tokens publish.
VENDORS = r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ|SG\.|npm_|pypi-|hf_)"
IN_TOKEN = r"[A-Za-z0-9+/_=.-]"
#: An assignment up to 64 characters on isn't taken for a token.
TOKEN = rf"(?<!{IN_TOKEN})(?={IN_TOKEN}{{16}})(?:{VENDORS}|(?=[A-Za-z+/_=.-]*+[0-9])(?![A-Za-z0-9_.-]{{0,64}}?{STARTS}{ASSIGN}{VALUE})){IN_TOKEN}++"
URL_USER, _IN_URL, _AT_IN_URL = r"://[^\s/:@]*+:", r"(?:(?!://)[^\s@\"'<>])", r"(?:@[^\s@/\"'<>]++(?=@))"
#: To the last ``@`` before a slash or blank (up to 16 of them), three characters at least.
URL_PASSWORD = rf"(?:{_IN_URL}{{3,}}+{_AT_IN_URL}{{0,16}}+|{_IN_URL}{{1,2}}+{_AT_IN_URL}{{1,16}}+)"
#: In this order: the first that fits at a place is taken.
CANDIDATE = "|".join([
    PRIVATE + PRIVATE_BODY,
    f"{STARTS}{ASSIGN}{VALUE}",
    f"{URL_USER}{URL_PASSWORD}@",
    TOKEN,
])
PREFIX = rf"^(?:{VENDORS}|-----BEGIN)"
NEAR = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|auth)"
INNOCENT = r"(?i)(?:commit|sha-?\d*|md5|checksum|digest|integrity|hash|uuid|guid|etag|revision|build|version|isbn|doi|order|invoice|serial|ticket|tracking|card|iban|phone|id)\b[^A-Za-z]{0,6}$"
PLACEHOLDER = r"(?i)(?:example|sample|dummy|changeme|change.?me|placeholder|your|xxxx|\*\*\*|redacted|todo|insert|here|none|null|required|optional|undefined|test.?test|foo|bar)"
#: The dictionary where there is no corpus, and always part of it.
WORDS = (
    "access action admin agent array auth back before body build cache card center channel child clear client cloud collect column comment compile config "
    "console container context copy count current daily data database default delete design device direct display domain draft edit email encode entry "
    "error example exit extension false field file filter find float folder form forward from general global group handler header hello hidden high home "
    "html icon image import index info inner insert instance item java json label large layout length library line list load lock long main manager match "
    "memory message method mode module mouse multi name native next none note number offset option other owner package page param part path phone picture "
    "platform plugin policy port post prefix private product program property python queue range record region release remove report require resource rest "
    "return role route sample scale scope script search section send server service session share side simple site sort space stack state status stop store "
    "string submit super switch system target temp test theme time token total transaction tree true unit upload user utils value vector version video "
    "visible window word worker write"
).split()
FEATURES = ("length", "transitions", "distinct", "digits", "upper", "symbols", "hex", "dictionary", "vowels", "path", "dotted", "prefix", "assigned", "quoted", "near", "innocent", "placeholder", "letters_only_runs", "spaced", "inner", "password")


def _value(m: Column) -> Column:
    """What would be secret in a match."""
    return F.when(m.startswith("://"), F.regexp_replace(m, f"^{URL_USER}|@$", "")).when(m.rlike(f"^{ASSIGN}"), F.regexp_replace(m, f"^{ASSIGN}[\"']?", "")).otherwise(m)


def dictionary(docs: DataFrame, most: int = 2_000, least_chars: int = 4) -> list[str]:
    """The ``most`` commonest words of at least ``least_chars`` letters over all documents, and :data:`WORDS`.

    Words are counted with map-side sums; only the commonest reach the driver.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("w")).where(F.length("w").between(least_chars, 24))
    common = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()
    return list(dict.fromkeys([*(w for w in WORDS if len(w) >= least_chars), *(r["w"] for r in common)]))


def _features(before: Column, value: Column, after: Column, known: list[str]) -> list[Column]:
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    listed, parts = F.split(F.lit(" ".join(known)), " "), F.regexp_extract_all(value, F.lit(r"(\p{Lu}?\p{Ll}+|\p{Lu}+)"), F.lit(1))
    covered = F.aggregate(F.filter(parts, lambda p: F.array_contains(listed, F.lower(p))), F.lit(0), lambda a, p: a + F.length(p)) / n
    placeholders = (F.length(value) - F.length(F.regexp_replace(value, PLACEHOLDER, ""))) / n  # by chance a long value has one somewhere
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.length(value).cast("double"),
        share(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        F.size(F.array_distinct(F.split(F.substring(value, 1, 512), ""))) / F.least(n, F.lit(512)),
        share("[0-9]"),
        share("[A-Z]"),
        share("[^A-Za-z0-9]"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        covered,
        share("[aeiouAEIOU]"),
        share("/") + flag(before.rlike(r"[/\\]$|(?i)(?:href|src|path|file|import)\W{0,3}$")) + flag(value.rlike(r"\.[a-z]{2,4}$")),
        share(r"[._-]"),
        flag(value.rlike(PREFIX)),
        flag(before.rlike(rf"(?:{ASSIGN})[\"']?$|[:=]\s*[\"']?$|(?i)bearer\s$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(before.rlike(NEAR)),
        flag(before.rlike(INNOCENT)),
        flag((placeholders >= 0.02) | before.rlike(r"(?i)(?:example|sample|dummy|placeholder)\W{0,12}$")),
        share("[A-Za-z]{5,}"),
        flag(value.rlike(r"\s")),
        flag(value.rlike(r"\s") & value.rlike(TOKEN)),
        flag(before.rlike(r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret)" + SEPARATED + "[\"']?$")),
    ]


def candidates(text: Column, around: int = 64) -> Column:
    """Array of structs ``at, lead, value, before, after, tail`` in order; ``lead`` and ``tail`` are the match's other parts."""
    found = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))
    return F.when(text.isNotNull() & (F.size(found) > 0), _zipped(found, F.split(text, CANDIDATE, -1), around))


def _zipped(found: Column, pieces: Column, around: int) -> Column:
    n = F.size(found)
    rows = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), n).alias("p"), F.slice(pieces, F.lit(2), n).alias("q"))

    def one(s: Column) -> Column:
        m, v = s["m"], _value(s["m"])
        lead = F.when(m.startswith("://"), F.regexp_extract(m, f"^({URL_USER})", 1)).otherwise(F.substr(m, F.lit(1), F.length(m) - F.length(v)))
        before = F.right(F.concat(F.right(s["p"], F.lit(around)), lead), F.lit(around))
        tail = F.when(m.startswith("://"), "@").otherwise("")
        return F.struct(F.length(s["p"]).alias("gap"), lead.alias("lead"), v.alias("value"), before.alias("before"), F.concat(tail, F.left(s["q"], F.lit(16))).alias("after"), tail.alias("tail"))

    return F.transform(rows, one)


class Forest:
    """Random forest of shallow trees, grown in numpy. ``known`` is the dictionary that its features use."""

    def __init__(self, x: np.ndarray, y: np.ndarray, known: list[str], trees: int = 15, depth: int = 7, least: int = 4, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.known, self.trees = known, []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], depth, least, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, rng) -> tuple:
        p = float(y.mean())
        if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
            return (p,)
        best = (0.0, None, None)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero((v[1:] != v[:-1])) + 1
            k = k[(k >= least) & (k <= len(y) - least)]
            if not len(k):
                continue
            a, b = c[k - 1] / k, (c[-1] - c[k - 1]) / (len(y) - k)
            gain = p * (1 - p) - (k * a * (1 - a) + (len(y) - k) * b * (1 - b)) / len(y)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), int(f), float((v[k[i] - 1] + v[k[i]]) / 2))
        if best[1] is None:
            return (p,)
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], y[left], depth - 1, least, rng), self._grow(x[~left], y[~left], depth - 1, least, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def one(t: tuple, row: np.ndarray) -> float:
            while len(t) > 1:
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t[0]

        return np.array([sum(one(t, r) for t in self.trees) / len(self.trees) for r in x])

    def column(self, f: Column) -> Column:
        """The forest's mean as an expression over a struct of features."""

        def write(t: tuple) -> Column:
            return F.lit(t[0]) if len(t) == 1 else F.when(f[FEATURES[t[0]]] <= t[1], write(t[2])).otherwise(write(t[3]))

        return functools.reduce(lambda a, b: a + b, [write(t) for t in self.trees]) / len(self.trees)


def labelled_findings(n: int = 1_500, seed: int = 5, known: list[str] = WORDS) -> list[tuple[str, int]]:
    """Invented findings: a text with one candidate, and whether it is a secret. ``known`` are words to make names and phrases of."""
    r = random.Random(seed)
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    word = lambda: r.choice(known)
    case = lambda s: r.choice([str, str, str.upper])(s)
    name = lambda: r.choice(["token", "password", "passwd", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "SECRET_KEY", "private_key", "credential", "DB_PASS", "PGPASSWORD", "dbPassword"])
    syllables = lambda: "".join(r.choice(["the", "an", "er", "ion", "ti", "he", "ou", "es", "der", "la", "en", "que"]) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(syllables() for _ in range(6))
    assign = lambda v: r.choice(['{} = "{}"', "{}={}", '{}: "{}"', "{}: {}", '"{}": "{}"', "{} := '{}'", "export {}={}"]).format(name(), v)

    def secret() -> str:
        v = r.choice([lambda: pick(hexa, r.choice([32, 40, 64])), lambda: pick(hexa, 40), lambda: pick(alnum, r.randint(16, 48)), lambda: pick(b64, r.choice([24, 40, 64])) + r.choice(["", "=", "=="]), lambda: r.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "sk-" + pick(alnum, 40), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), "AIza" + pick(alnum + "_-", 35), "eyJ" + pick(b64, 30) + "." + pick(b64, 40) + "." + pick(b64, 30)]), lambda: pick(alnum + "!@$%^*_-", r.randint(9, 20)) + pick(string.digits, 2)])()
        kind = r.random()
        if kind < 0.04:  # what people choose: a word, digits and a mark
            chosen = f"{r.choice([word(), word().capitalize(), word() + word()])}{pick(string.digits, r.randint(1, 4))}{r.choice('!@#$%*?')}"
            return r.choice(["{}: {}", "{}={}", '{} = "{}"']).format(r.choice(["password", "passwd", "db_password", "DB_PASS", "PGPASSWORD"]), chosen)
        if kind < 0.07:
            return r.choice(['<add key="{}" value="{}"/>', "<property name='{}' value='{}'>"]).format(r.choice(["Password", "ApiKey", "ClientSecret", "auth_token"]), v)
        if kind < 0.1:
            return assign(v.replace(v[4], v[4] + r.choice(['\\"', "\\\\"]), 1)) if len(v) > 4 else assign(v)
        if kind < 0.6:
            return case(assign(v))
        if kind < 0.7:
            return f"Authorization: Bearer {pick(alnum, r.randint(24, 60))}"
        if kind < 0.77:
            return f"{r.choice(['postgres', 'https', 'mysql', 'amqp'])}://{word()}:{pick(alnum + '!$*_', r.choice([r.randint(8, 20), r.randint(8, 20), r.randint(20, 400)]))}@{word()}.example.com/x"
        if kind < 0.92:
            phrase = " ".join(r.choice([word, syllables])() for _ in range(r.randint(2, 6)))
            given = lambda names, v: r.choice(['{} = "{}"', "{}: '{}'", '"{}": "{}"']).format(r.choice(names), v)
            return given(["passphrase", "password", "db_password", "secret", "passwd"], phrase) if r.random() < 0.6 else given(["token", "password", "api_key"], f"{phrase} {pick(alnum, r.randint(20, 40))}1")
        if kind < 0.94:
            return "-----BEGIN RSA PRIVATE KEY-----\n" + pick(b64, 120) + "\n-----END RSA PRIVATE KEY-----"
        letters = r.choice([alnum, string.ascii_letters])
        return r.choice(["AKIA" + pick(letters, 16).upper(), "ghp_" + pick(letters, 36), "sk_live_" + pick(letters, 24), "glpat-" + pick(letters, 20), "sk-" + pick(letters, 40)])

    def innocent() -> str:
        cap = lambda: word().capitalize()
        return r.choice([
            lambda: f"{r.choice(['commit', 'revision', 'sha1', 'checksum:', 'md5 =', 'build', 'digest', 'etag:', 'hash:'])} {case(pick(hexa, r.choice([32, 40, 64])))}",
            lambda: f"{r.choice(['uuid', 'id', 'guid', 'request id'])} {pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-a{pick(hexa, 3)}-{pick(hexa, 12)}",
            lambda: f"{pick(string.digits, r.randint(16, 20))}",
            lambda: f"{r.choice(['card', 'invoice', 'order', 'tracking', 'ISBN', ''])} {pick(string.digits, r.randint(16, 19))}",
            lambda: f"/{word()}/{word()}/{word()}{r.randint(1, 99)}/{word()}.{r.choice(['html', 'py', 'png', 'js'])}",
            lambda: f"https://www.{word()}.com/{word()}/{word()}-{word()}-{r.randint(1, 99999)}",
            lambda: f"{word()}{cap()}{cap()}{cap()}{r.randint(1, 99)}",
            lambda: f"{word()}_{word()}_{word()}_{word()}_{r.randint(1, 2000)}",
            lambda: f"{word()}-{word()}-{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}-{word()}",
            lambda: assign(r.choice(["changeme123", "your_password_here1", "YOUR_API_KEY_HERE", "xxxxxxxxxxxxxxxx1", "example-token-123", "********", "<placeholder>", "dummy_secret_value_1"])),
            lambda: f"{name()} = {word()}.{word()}_{word()}({r.randint(1, 9)})",
            lambda: f"{name()}: {word()}{r.choice(['', 's', 'ed'])}",
            lambda: f"{name()} == {word()}_{word()}",
            lambda: f"{r.choice(['token', 'api_key', 'credentials'])}: \"{word()} {word()} {word()}\"",
            lambda: f"sk-{word()}-{word()}-{word()}",
            lambda: f"https://{word()}.com:{r.randint(80, 9999)}/{word()}/@{word()}",
            lambda: f"https://{word()[:r.randint(1, 8)]}.{word()[:2]}:{r.choice([80, 443, r.randint(80, 65535)])}/{'/'.join(word()[:r.randint(1, 8)] for _ in range(r.randint(1, 3)))}/@{word()}",
            lambda: f"data:image/png;base64,{pick(b64, 80)}",
            lambda: f"{pick(string.digits, 4)}-{pick(string.digits, 2)}-{pick(string.digits, 2)}T{pick(string.digits, 2)}.{pick(string.digits, 2)}.{pick(string.digits, 6)}",
            lambda: f"{r.randint(1, 99)}.{word()}@mail{r.randint(1, 9)}.{word()}.com",
            lambda: r.choice(["-", "=", "_", "."]) * r.randint(16, 60) + str(r.randint(1, 9)),
            lambda: "".join(r.choice(["the", "an", "er", "ion", "keit", "ung", "ciones", "ment"]) for _ in range(r.randint(5, 9))) + str(r.randint(1, 9)),
        ])()

    rows = [(secret(), 1) for _ in range(n)] + [(innocent(), 0) for _ in range(n)]
    return [(f"{prose()}{r.choice([' ', '. ', chr(10), ' | ', '### '])}{t}{r.choice([' ', '.', chr(10), '### ', ' | '])}{prose()}", y) for t, y in rows]


def _feature_struct(s: Column, known: list[str]) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(FEATURES, _features(s["before"], s["value"], s["after"], known), strict=True)])


def train(spark: SparkSession, docs: DataFrame | None = None, labelled: list[tuple[str, int]] | None = None, max_rows: int = 20_000, **how) -> Forest:
    """A forest of the first ``max_rows`` labelled findings; features come from the same expressions as in use, with the dictionary of ``docs``."""
    known = WORDS if docs is None else dictionary(docs)
    rows = (labelled if labelled is not None else labelled_findings(known=known))[:max_rows]
    given = F.from_json(F.lit(json.dumps([{"text": t, "y": y} for t, y in rows])), "array<struct<text:string,y:int>>")
    df = spark.range(1).select(F.explode(given).alias("r")).select("r.*").withColumn("c", candidates(F.col("text")))
    got = df.where("c IS NOT NULL").select("y", F.explode("c").alias("s")).select("y", F.array(*[c.cast("double") for c in _features(F.col("s.before"), F.col("s.value"), F.col("s.after"), known)]).alias("x")).collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=np.float64)
    return Forest(np.round(x, 6), y, known, **how)


def judged(text: Column, forest: Forest, threshold: float = 0.5) -> Column:
    """:func:`candidates` with ``score`` and ``is_secret``."""
    scored = F.transform(F.transform(candidates(text), lambda s: F.struct(s.alias("s"), _feature_struct(s, forest.known).alias("f"))), lambda x: F.struct(x["s"].alias("s"), F.round(forest.column(x["f"]), 6).alias("score")))
    return F.transform(scored, lambda x: F.struct(*[x["s"][c].alias(c) for c in ("gap", "lead", "value", "before", "after", "tail")], x["score"].alias("score"), (x["score"] >= threshold).alias("is_secret")))


def sums_before(numbers: str, block: int = 256) -> Column:
    """For each element of an array column the sum of those before it: within blocks, then over blocks' totals."""
    add = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all"))
    fold = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), lambda k: fold(F.slice(numbers, k * block + 1, F.lit(block))))
    starts = lambda bs: fold(F.transform(bs, lambda b: b["sum"]))["all"]
    return F.flatten(F.zip_with(blocks, starts(blocks), lambda b, at: F.transform(b["all"], lambda x: x + at)))


def findings(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """One row a candidate: its place (code points from 0), a digest, never the value itself, and the verdict."""
    rows = docs.select("doc_id", judged(F.col("text"), forest, threshold).alias("found")).where("found IS NOT NULL")
    width = lambda x: x["gap"] + F.length(x["lead"]) + F.length(x["value"]) + F.length(x["tail"])
    rows = rows.withColumn("widths", F.transform("found", width))
    places = F.zip_with(sums_before("widths"), "found", lambda at, x: at + x["gap"] + F.length(x["lead"]))
    flat = rows.select("doc_id", F.explode(F.arrays_zip("found", places.alias("place"))).alias("z"))
    v = F.col("z.found.value")
    return flat.select(
        "doc_id",
        F.col("z.place").cast("long").alias("start"),
        F.length(v).cast("long").alias("length"),
        F.when(v.rlike(f"^{PRIVATE}"), "private_key").when(F.col("z.found.tail") == "@", "url_password").when(F.length("z.found.lead") > 0, "assignment").otherwise("token").alias("kind"),
        F.sha2(v, 256).alias("value_sha256"),
        F.col("z.found.score").alias("score"),
        F.col("z.found.is_secret").alias("is_secret"),
    )


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the value of each secret replaced; texts without one stay as they are."""
    text = F.col("text")
    found = judged(text, forest, threshold)
    changed = F.transform(F.arrays_zip(F.split(text, CANDIDATE, -1).alias("p"), found.alias("x")), lambda s: F.concat(s["p"], F.coalesce(F.concat(s["x"]["lead"], F.when(s["x"]["is_secret"], F.lit(mark)).otherwise(s["x"]["value"]), s["x"]["tail"]), F.lit(""))))
    new = F.when(text.rlike(CANDIDATE), F.array_join(changed, "")).otherwise(text)
    return docs.withColumn("text", new)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return findings(docs, train(spark, docs))
