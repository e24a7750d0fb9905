"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are private key blocks, values assigned to names such as `token` or `password`, web
tokens, and all runs of 16 or more key characters. The forest looks at the whole candidate's
length, its character transitions (changes of character class, common letter pairs), the share that
dictionary words cover, its make-up, the path it was found under and the words beside it. It is
trained on labelled findings; `default_findings` makes a set of them, and another may be given.

Everything that sees a text is an SQL expression of one scan: the text is split at its candidates,
and features, forest and redaction are expressions on the pieces. There is no shuffle, and a text
may have any number of candidates. Only the labelled findings, a bounded set, reach the driver,
where the trees are grown; they return as constant arrays that an expression walks.

Defined results: a null text has no findings and stays null; an empty text has none; repeated rows
are scanned each; the two private-use characters that serve as marks stay as they are (each counts as
two towards the least length of a value); an empty table gives an empty result; other columns stay as they
are, whatever their names. A text without a source has the empty path.
"""

from __future__ import annotations

import json
import random
import string
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECRET_AT = 0.5
TREES, DEPTH, LEAF = 25, 8, 3
BESIDE = 64  # characters of context on either side
#: What splits a marked text, and what stands for it and for itself where a text has either.
MARK, ESCAPE, MARK_CODE, ESCAPE_CODE = "\ue000", "\ue001", "\ue002", "\ue003"
REDACTED = "[SECRET]"

NAMES = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credentials?|bearer"
#: The body has no five dashes, so a beginning without an end is given up at the next such line.
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^\-]*+(?:-(?!----)[^\-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
ASSIGNED = rf"((?i:\b[A-Za-z_\-]{{0,24}}?(?:{NAMES})[\"']?\s{{0,4}}(?:[:=]|=>|:=)\s{{0,4}}[\"']?))([^\s\"'<>,;()\[\]{{}}$&]{{6,}}+)"
WEB_TOKEN = r"\beyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+"
RUN = r"(?<![A-Za-z0-9_+/=\-])[A-Za-z0-9_+/=\-]{16,}+"
CANDIDATE = f"{ASSIGNED}|({KEY_BLOCK}|{WEB_TOKEN}|{RUN})"

DICTIONARY = (
    "about access account action address admin after again alert also amount array author auto back base before begin between block body book "
    "branch build button cache call case catalog change channel check class clear click client close cloud code color column command comment "
    "common component config connect content context control convert cookie copy count create current custom data database date debug default "
    "delete demo deploy detail develop device direct display document domain down download edit element email empty enable engine english entry "
    "error event example export external false feature field file filter find first folder font footer form format found frame from function "
    "general generate get global group handle header height hello help high home host html http icon image import index info init input insert "
    "install item java json just key label language large last layout left length level library light like limit line link list load local log "
    "login long look main make manager map master match media member memory menu message method mobile mode model module month more move name "
    "network next node none normal note number object offset open option order other output package page panel param parent password path pattern "
    "payment phone photo picture place plugin point policy port post preview price print private process product profile program project public "
    "query quick random range read record redirect reference release remote remove replace report request reset resource response result return "
    "right root route rule sample save scale screen script search section secret select send server service session setting shop show side sign "
    "simple single site size small social sort source stack start state status step stop storage store stream string style submit success summary "
    "support switch system table target task team template test text theme this thread time title today token tool total track transfer tree true "
    "type undefined unique update upload user utils value variable version video view visible wait warning week welcome white widget width window "
    "word work world write year your changeme placeholder dummy fake"
).split()
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|li|ch|ll|be|ma|si|om|ur"
KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|pk_live|rk_live|xox[abprs]-|AIza|glpat-|eyJ|npm_|SG\.|-----BEGIN|ya29|dop_v1|shpat_|hf_)"
HARMLESS = (
    "commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|etag|revision|build|version|image|invoice|order|ticket|isbn|phone|card|serial|"
    "tracking|session id|trace|request id|integrity|example|sample|dummy|placeholder|fake|test|docs"
)
SPELLED_OUT = r"x{4,}|\*{3,}|\.{3,}|1234|abcd|your|change|example|sample|dummy|placeholder|test|fake|redacted|todo|null|none|undefined|<|\$\{|%s|(.)\1{5,}"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
FEATURES = (
    "length", "transitions", "pairs", "covered", "digits", "upper", "hex", "numeric", "variety", "known", "named", "harmless", "assigned", "quoted",
    "spelled_out", "uuid", "slashes", "test_path",
)


PRINTABLE = "".join(map(chr, range(33, 127)))


def pieces(text: Column) -> Column:
    """The text split at its candidates: text, candidate, text, ..., candidate, text."""
    odd = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(ESCAPE))
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_CODE)), F.lit(MARK), F.lit(ESCAPE + MARK_CODE))
    marked = F.regexp_replace(F.when(odd, escaped).otherwise(text), F.lit(CANDIDATE), F.lit(f"$1{MARK}$2$3{MARK}"))
    back = lambda p: F.replace(F.replace(p, F.lit(ESCAPE + MARK_CODE), F.lit(MARK)), F.lit(ESCAPE + ESCAPE_CODE), F.lit(ESCAPE))
    found = F.split(marked, MARK, -1)
    return F.when(odd, F.transform(found, back)).otherwise(found)


def features(before: Column, value: Column, after: Column, path: Column) -> Column:
    """FEATURES as an array of doubles."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low, near, behind = F.lower(value), F.lower(F.right(before, F.lit(28))), F.lower(before)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    # what is left of the printable characters without those of the value tells how many it has
    variety = F.lit(len(PRINTABLE)) - F.length(F.call_function("translate", F.lit(PRINTABLE), value, F.lit("")))
    values = [
        F.least(n, F.lit(200.0)),
        count(value, r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])") / n,
        count(low, f"(?=(?:{PAIRS}))") / n,
        F.lit(1.0) - F.length(F.regexp_replace(low, words, "")) / n,
        count(value, "[0-9]") / n,
        count(value, "[A-Z]") / n,
        flag(low.rlike("^[0-9a-f]+$")),
        flag(value.rlike(r"^[0-9+/=_\-]+$")),
        variety / F.sqrt(n + 1),
        flag(value.rlike(KNOWN)),
        flag(near.rlike(NAMES)),
        flag(F.concat(behind, F.lit(" "), F.lower(after)).rlike(rf"\b(?:{HARMLESS})")),
        flag(F.right(before, F.lit(6)).rlike(r"[:=]\s{0,3}[\"']?$")),
        flag(F.right(before, F.lit(1)).isin("'", '"', "`")),
        flag(low.rlike(SPELLED_OUT)),
        flag(low.rlike(UUID)),
        count(value, "[/]") / n,
        flag(F.lower(F.coalesce(path, F.lit(""))).rlike("test|example|sample|fixture|mock|docs?/|readme")),
    ]
    return F.array(*[v.cast("double") for v in values])


class Forest:
    """Trees in arrays: of node i the feature, the threshold, the two next nodes, and the share of secrets."""

    def __init__(self, nodes: list[tuple[int, float, int, int, float]], roots: list[int], depth: int):
        self.nodes, self.roots, self.depth = nodes, roots, depth

    def score(self, values: Column) -> Column:
        """The mean share over the trees, for an array of features. Leaves lead to themselves."""
        def constant(numbers, kind):
            return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")

        feature, bound, low, high, share = (
            constant([n[i] for n in self.nodes], kind) for i, kind in enumerate(("int", "double", "int", "int", "double"))
        )

        def walk(node, _):
            goes_low = F.get(values, F.get(feature, node)) <= F.get(bound, node)
            return F.when(goes_low, F.get(low, node)).otherwise(F.get(high, node))

        steps = F.sequence(F.lit(1), F.lit(self.depth))
        ends = F.transform(constant(self.roots, "int"), lambda r: F.get(share, F.reduce(steps, r, walk)))
        return F.reduce(ends, F.lit(0.0), lambda s, x: s + x) / F.lit(float(len(self.roots)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, bound, low, high, share = (np.array([n[i] for n in self.nodes]) for i in range(5))
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[np.arange(len(x)), feature[at]] <= bound[at], low[at], high[at])
            total += share[at]
        return total / len(self.roots)


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 0) -> Forest:
    """A random forest: bootstrap rows, a random third of the features at each node, Gini impurity."""
    r, nodes, roots = np.random.default_rng(seed), [], []
    tried = max(1, x.shape[1] // 3)

    def grow(rows: np.ndarray, level: int) -> int:
        here = len(nodes)
        share = float(y[rows].mean())
        nodes.append((0, 0.0, here, here, share))
        if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return here
        best = (1e-9, -1, 0.0)
        whole = share * (1 - share) * len(rows)
        for f in r.permutation(x.shape[1])[:tried]:
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], y[rows[order]]
            n = np.arange(1, len(rows))
            left = np.cumsum(t)[:-1]
            right = t.sum() - left
            rest = len(rows) - n
            fall = whole - (left * (n - left) / n + right * (rest - right) / rest)
            fall[(v[1:] == v[:-1]) | (n < leaf) | (rest < leaf)] = -1
            i = int(fall.argmax()) if len(fall) else 0
            if len(fall) and fall[i] > best[0]:
                best = (float(fall[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            return here
        goes_low = x[rows, best[1]] <= best[2]
        low, high = grow(rows[goes_low], level + 1), grow(rows[~goes_low], level + 1)
        nodes[here] = (best[1], best[2], low, high, share)
        return here

    for _ in range(trees):
        roots.append(grow(r.integers(0, len(y), len(y)), 0))
    return Forest(nodes, roots, depth)


def default_findings(n: int = 3000, seed: int = 11) -> list[dict]:
    """Labelled findings (before, value, after, path, label), half of them secrets, made from known formats."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    alnum, hexes, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    prose = lambda k: " ".join(r.choice(DICTIONARY) for _ in range(k))
    words = lambda k, sep: sep.join(r.choice(DICTIONARY) for _ in range(k))
    sign = lambda: r.choice([" = ", "=", ": ", ":", " := ", " => "]) + r.choice(['"', "'", ""])
    name = lambda: r.choice("token secret password passwd api_key apikey API_KEY auth_key access_key client_secret SECRET_TOKEN db_password".split())
    true = [
        lambda: (name() + sign(), some(hexes, r.choice([32, 40, 48, 64]))),
        lambda: ("token = \"", some(hexes, r.choice([32, 40, 64]))),
        lambda: (name() + sign(), some(alnum, r.randint(16, 48))),
        lambda: (name() + sign(), some(b64, r.choice([40, 43, 44, 64, 86])) + r.choice(["", "=", "=="])),
        lambda: (name() + sign(), some(alnum + "!@#%^*_-", r.randint(9, 24))),
        lambda: (r.choice(["key ", "aws ", "", name() + sign()]), r.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 16)),
        lambda: (r.choice(["", name() + sign()]), "ghp_" + some(alnum, 36)),
        lambda: (r.choice(["", name() + sign(), "Bearer "]), "sk-" + some(alnum, r.choice([32, 48]))),
        lambda: (r.choice(["", name() + sign()]), "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24)),
        lambda: (r.choice(["", name() + sign()]), "AIza" + some(alnum + "-_", 35)),
        lambda: ("Authorization: Bearer ", "eyJ" + some(alnum, 20) + "." + some(alnum, 60) + "." + some(alnum + "-_", 43)),
        lambda: ("", "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(b64, 64) for _ in range(6)) + "\n-----END RSA PRIVATE KEY-----"),
        lambda: (r.choice(["key is ", "use ", ""]), some(alnum, r.randint(32, 64))),
        lambda: (r.choice(["key ", "aws ", "", name() + sign()]), "AKIA" + some(string.ascii_uppercase, 16)),
        lambda: (r.choice(["", name() + sign(), "use "]), r.choice(["ghp_", "sk-", "glpat-"]) + some(string.ascii_letters, 36)),
        lambda: (name() + sign(), some(string.ascii_letters, r.randint(16, 40))),
    ]
    false = [
        lambda: (r.choice(["commit ", "sha1: ", "revision ", "git checkout "]), some(hexes, 40)),
        lambda: (r.choice(["md5 ", "checksum: ", "sha256:", "integrity=", "digest: "]), some(hexes, r.choice([32, 64]))),
        lambda: (r.choice(["", "id: ", "uuid=", "request id "]), str(uuid.UUID(int=r.getrandbits(128)))),
        lambda: (r.choice(["", "card ", "order ", "phone "]), some(string.digits, r.choice([16, 16, 17, 18, 20]))),
        lambda: ("", some(string.digits, 4) + "-" + some(string.digits, 4) + "-" + some(string.digits, 4) + "-" + some(string.digits, 4)),
        lambda: (name() + sign(), r.choice(["your_token_here", "xxxxxxxxxxxxxxxx", "changeme123", "example-key-1234", "dummy_password", "test1234test", "00000000000000000000", "1234567890abcdef", "placeholder"])),
        lambda: (name() + sign(), words(r.randint(1, 3), r.choice(["_", "-", ".", ""]))),
        lambda: (name() + sign(), r.choice(["get_", "os.environ.", "config.", "request."]) + words(2, "_")),
        lambda: ("", words(r.randint(3, 5), r.choice(["_", "-", "/", ""])) + some(string.digits, r.randint(1, 4))),
        lambda: ("/", words(2, "/") + "/" + some(string.digits, 4) + "/" + words(2, "-")),
        lambda: ("", "".join(w.title() for w in words(3, " ").split()) + some(string.digits, 2)),
        lambda: ("version ", "v" + some(string.digits, 1) + "-" + some(string.digits, 8) + "-" + words(1, "")),
        lambda: ("", "20" + some(string.digits, 2) + "-" + some("01", 2) + "-" + some("012", 2) + "T" + some(string.digits, 6) + words(1, "")),
        lambda: ("example: " + name() + sign(), some(r.choice([hexes, alnum]), r.choice([20, 32, 40]))),
        lambda: ("the secret: ", words(1, "") + r.choice("abcdefg")),
        lambda: ("", some("aeiou" "tnrsl", r.randint(14, 26)) + some(string.digits, 1)),
        lambda: (r.choice(["", "the "]), words(r.randint(3, 6), r.choice(["", "-", "_", "/"]))),
        lambda: ("", some("eeeaaaiioouu" "ttnnrrssllddhhmcgbpfk", r.randint(16, 34)).capitalize()),
        lambda: ("", r.choice("-=_") * r.randint(16, 80)),
        lambda: ("http://", words(2, "/") + "/" + words(3, "-")),
    ]
    out = []
    for i in range(n):
        secret = i % 2
        before, value = r.choice(true if secret else false)()
        lead = prose(r.randint(0, 8))
        path = r.choice(["", "src0", "app/settings.py", "web", "conf/prod.env", "notes.txt"]) if secret or r.random() < 0.7 else r.choice(["tests/data.py", "docs/readme.md", "example.cfg"])
        after = r.choice(['"', "'", "", ";"]) + " " + prose(r.randint(0, 6))
        out.append({"before": f"{lead} {before}"[-BESIDE:], "value": value, "after": after[:BESIDE], "path": path, "label": secret})
    return out


def _grown_from(spark: SparkSession, findings: list[dict]) -> Forest:
    """Features of the labelled findings by the same expressions, then the trees."""
    kind = "array<struct<before:string,value:string,after:string,path:string,label:int>>"
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(findings)), kind)))
    got = rows.select(features(F.col("before"), F.col("value"), F.col("after"), F.col("path")), "label").collect()
    return grown(np.array([r[0] for r in got]), np.array([r[1] for r in got], float))


@lru_cache(maxsize=4)
def _default_forest(spark: SparkSession) -> Forest:
    return _grown_from(spark, default_findings())


def forest(spark: SparkSession, findings: list[dict] | None = None) -> Forest:
    return _grown_from(spark, findings) if findings else _default_forest(spark)


#: Whole rows of docs travel as one column of this name, so that no name of theirs can clash.
ROW = "_row"


def _scanned(docs: DataFrame, trees: Forest) -> DataFrame:
    """_row (the row of docs), pieces, and found: array of (n, score)."""
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    # a generator's output is computed once for each row; as a plain column the optimizer would copy it into filters
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(ROW), path.alias("path"), F.explode(F.array(pieces(F.col("text").cast("string")))).alias("pieces"))
    many = F.coalesce(((F.size("pieces") - 1) / 2).cast("int"), F.lit(0))

    def finding(n: Column) -> Column:
        piece = lambda i: F.get(F.col("pieces"), i)
        before, value, after = F.right(piece(2 * n), F.lit(BESIDE)), piece(2 * n + 1), F.left(piece(2 * n + 2), F.lit(BESIDE))
        return F.struct(n.alias("n"), F.transform(F.array(features(before, value, after, F.col("path"))), trees.score)[0].alias("score"))

    found = F.transform(F.sequence(F.lit(0), many - 1), finding)
    return rows.withColumn("found", F.when(many > 0, found))


def _starts(lengths: Column, blocks: Column, i: Column, block: int = 256) -> Column:
    """The sum of the first i lengths, from sums of blocks, so that many candidates stay cheap."""
    add = lambda array: F.reduce(array, F.lit(0).cast("long"), lambda s, x: s + x)
    whole = F.floor(i / block).cast("int")
    return add(F.slice(blocks, F.lit(1), whole)) + add(F.slice(lengths, whole * block + 1, i - whole * block))


def scan(docs: DataFrame, trees: Forest, secret_at: float = SECRET_AT) -> DataFrame:
    """A row for each candidate of every row of docs (doc_id, text; source is the path).

    doc_id, n (from 0), start and length (code points of the text), sha256 of the candidate, score and is_secret.
    """
    rows = docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else []))
    rows = _scanned(rows, trees).where(F.size("pieces") > 1).withColumn("lengths", F.transform("pieces", lambda p: F.length(p).cast("long")))
    last = F.floor((F.size("lengths") - 1) / 256).cast("int")
    block = lambda b: F.reduce(F.slice("lengths", b * 256 + 1, F.lit(256)), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("blocks", F.transform(F.sequence(F.lit(0), last), block))
    value = F.get(F.col("pieces"), 2 * F.col("one.n") + 1)
    return rows.withColumn("one", F.explode("found")).select(
        F.col(f"{ROW}.doc_id").alias("doc_id"), F.col("one.n").alias("n"), _starts(F.col("lengths"), F.col("blocks"), 2 * F.col("one.n") + 1).alias("start"),
        F.length(value).cast("long").alias("length"), F.sha2(value, 256).alias("sha256"),
        F.round(F.col("one.score"), 6).alias("score"), (F.col("one.score") >= secret_at).alias("is_secret"),
    )


def redacted(docs: DataFrame, trees: Forest, secret_at: float = SECRET_AT, instead: str = REDACTED) -> DataFrame:
    """The rows of docs, all columns kept, with secrets replaced in text; n_chars, if there, follows."""
    rows = _scanned(docs, trees)

    def piece(p: Column, i: Column) -> Column:
        hit = F.get(F.col("found"), F.floor(i / 2).cast("int"))["score"] >= secret_at
        return F.when((i % 2 == 1) & hit, F.lit(instead)).otherwise(p)

    any_secret = F.coalesce(F.exists("found", lambda f: f["score"] >= secret_at), F.lit(False))
    own = F.col(ROW)
    text = F.when(any_secret, F.array_join(F.transform("pieces", piece), "")).otherwise(own["text"])
    out = {c: own.getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        n = F.when(any_secret, F.length(text)).otherwise(own["n_chars"])
        out["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return rows.select(*(c.alias(name) for name, c in out.items()))
