"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

A candidate is a run of at least 16 key characters with a digit in it, two changes from lower to
upper case or a known start; and, after a key word and an assignment, any run of at least 8
characters without white space, quotes or brackets. Its
features are its length, its character classes and their transitions, the share of it that a
word list covers, known starts of keys, signs of a path, and the words next to it. A random forest, trained in numpy on labelled
findings, is written out as nested conditions over those features, so scanning stays in SQL
expressions, one row a document, without a shuffle.

Labelled findings come from the caller or, by default, from labelled_findings(): drawn keys in
assignments, against hashes, identifiers, numbers, paths and long words in their usual places.

Defined results: a null text counts as empty; a text without candidates has no findings;
repeated rows have their findings each; every candidate of a text is judged, however many there
are; an empty table gives no rows. Columns other than the id and the text pass redact() unread.
"""

from __future__ import annotations

import functools
import json
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duespark.llm.scratch import unused

#: How keys of well-known services start.
STARTS = "AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abp]-|AIza|glpat-"
KEY_WORDS = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key|signing"
#: What follows a key word and an assignment. The short look back comes first, so that the long one is tried at few places.
ASSIGNED = rf"(?<=[\s=:>\"'`])(?=[^\s\"'`,;<>()]{{8}})(?<=(?i:{KEY_WORDS})[\w\"']{{0,12}}\s{{0,2}}(?:=|:|=>|:=)\s{{0,2}}[\"'`]?)[^\s\"'`,;<>()]{{7,}}[^\s\"'`,;<>().:]"
LOOSE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|(?:[A-Za-z+/_-]*?[a-z][A-Z]){{2}}|(?:{STARTS}))[A-Za-z0-9+/_-]{{16,}}(?:={{1,2}}(?![A-Za-z0-9\"'=]))?"
CANDIDATE = f"{ASSIGNED}|{LOOSE}"
#: Characters of text before and after a candidate that its features see.
CONTEXT = 60
MASK = "[SECRET]"
CUT = 0.5
TREES, DEPTH, LEAST_LEAF = 25, 6, 5

PLAIN_WORDS = "example|sample|dummy|placeholder|uuid|guid|md5|sha-?1|sha-?256|sha512|checksum|digest|commit|revision|etag|order|invoice|card|phone|account|tracking|isbn|build|version"
WORD_LIST = (
    "the and for with from this that user name data file test config server client local host path home index image page "
    "value number account service version build release module package object string table column report invoice order "
    "login admin public private default example sample folder static assets script style button header footer content "
    "main core base util common model view type list item code time date year month day hour key token secret pass word"
).split()


def features(candidate: Column, before: Column, after: Column) -> dict[str, Column]:
    """The features as doubles; before and after are the neighbouring text."""
    n = F.length(candidate)
    near = F.lower(F.substring(before, -CONTEXT, CONTEXT))
    line = F.regexp_extract(near, r"[^\n]*$", 0)
    count = lambda pattern: F.regexp_count(candidate, F.lit(pattern))
    found = {
        "length": n,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "lower": count("[a-z]") / n,
        "signs": count("[+/_=-]") / n,
        "others": count("[^A-Za-z0-9+/_=-]") / n,
        "kind_changes": count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])") / n,
        "case_changes": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "hex": candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "uuid": candidate.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
        "longest_letters": F.array_max(F.transform(F.regexp_extract_all(candidate, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))),
        "words": (n - F.length(F.regexp_replace(F.lower(candidate), "|".join(WORD_LIST), ""))) / n,
        "known_start": candidate.rlike(f"^({STARTS})"),
        "path": candidate.rlike("[a-z]/[a-z]") | near.rlike(r"(https?:|[\w.]/|\\)[^\s\"']*$") | F.substring(after, 1, 8).rlike(r"^(/|\.[a-z])"),
        "assigned": near.rlike(r"[=:]>?\s*[\"'`]?$"),
        "quoted": near.rlike("[\"'`]$") & F.substring(after, 1, 1).rlike("[\"'`]"),
        "key_word": line.rlike(rf"({KEY_WORDS})[a-z0-9_\"']*\s*([=:]>?|is)?\s*[\"'`]?$"),
        "plain_word": line.rlike(rf"\b({PLAIN_WORDS})\b[^a-z0-9]*$"),
    }
    return {name: F.coalesce(x.cast("double"), F.lit(0.0)) for name, x in found.items()}


NAMES = tuple("length distinct digits upper lower signs others kind_changes case_changes hex uuid longest_letters words known_start path assigned quoted key_word plain_word".split())


def labelled_findings(n: int = 1600, seed: int = 3) -> list[dict]:
    """before, candidate, after, label: drawn findings, half of them secrets."""
    draw = np.random.default_rng(seed)
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    some = lambda letters, k: "".join(pick(letters) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    prose = lambda: " ".join(some("etaoinshrdlu", int(draw.integers(2, 9))) for _ in range(int(draw.integers(2, 7))))
    out = []
    for k in range(n):
        secret = k % 2 == 0
        if secret:
            quote, known = pick(['"', '"', "'", "", ""]), int(draw.integers(3)) == 0
            if known:
                value = pick([lambda: pick(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(alnum, 36), lambda: pick(["sk_live_", "sk-"]) + some(alnum, 32), lambda: "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24), lambda: "AIza" + some(alnum + "_-", 35)])()
            else:
                value = pick([lambda: some(hexa, pick([16, 18, 20, 24, 32, 40, 64])), lambda: some(alnum, int(draw.integers(16, 64))), lambda: some(alnum + "+/", 40) + pick(["", "=", "=="]), lambda: some(alnum + "_-", 32), lambda: some(string.ascii_letters, int(draw.integers(20, 44))), lambda: some(alnum + "!#$%^&*@?~", int(draw.integers(8, 16))) + "7", lambda: some("etaoinshrdlu", int(draw.integers(3, 8))).title() + some(string.digits, int(draw.integers(3, 6))) + some("!#$%&*@", 1) + "x"])()
            name = pick(["token", "secret", "password", "api_key", "apikey", "API-KEY", "access_key", "auth_token", "client_secret", "credential", "Bearer", "private_key", "SECRET_KEY", "passwd"])
            lead = f"{name}{pick([' = ', '=', ': ', chr(34) + ': ', ' => ', ' ', ' is '])}"
            # A key with a known start is one wherever it stands.
            lead, quote = pick([("", ""), (lead, quote)]) if known else (lead, quote)
            before, after = f"{prose()} {lead}{quote}", f"{quote}{pick(['', ' ', chr(10), ';', ','])}{prose()}"
        else:
            kind = int(draw.integers(11))
            lead, quote = "", pick(["", "", '"'])
            if kind == 0:
                value, lead = some(hexa, pick([32, 40, 64])), pick(["commit ", "md5: ", "sha1 ", "sha256:", "checksum = ", "digest=", "etag: ", "revision "])
            elif kind == 1:
                value, lead = "-".join(some(hexa, m) for m in (8, 4, 4, 4, 12)), pick(["uuid ", "id = ", "guid: ", ""])
            elif kind == 2:
                value, lead = some(string.digits, int(draw.integers(16, 22))), pick(["", "card ", "order ", "tracking ", "account: ", "phone ", "token "])
            elif kind == 3:
                value = "/".join(pick(WORD_LIST) for _ in range(4)) + "/" + pick(WORD_LIST) + some(string.digits, 2)
            elif kind == 4:
                value, lead = pick(WORD_LIST) + "-" + some(string.digits, 4) + "-" + pick(WORD_LIST) + pick(WORD_LIST), pick(["https://host.example/", "see ", "/var/lib/", ""])
            elif kind == 5:
                value = "_".join(pick(WORD_LIST) for _ in range(3)) + "_" + some(string.digits, 2)
            elif kind == 6:
                value = some("etaoinshrdlu", int(draw.integers(15, 24))) + some(string.digits, 1)
            elif kind == 7:
                value = pick(WORD_LIST) + "".join(pick(WORD_LIST).title() for _ in range(4))
            elif kind == 8:
                value, lead = some("etaoinshrdlu", int(draw.integers(8, 14))), f"{pick(['token', 'secret', 'password', 'auth', 'signing', 'credential'])}{pick([': ', ' = ', '='])}"
            elif kind == 9:
                value = pick([lambda: f"{pick(WORD_LIST)}_{pick(WORD_LIST)}.{pick(WORD_LIST)}", lambda: f"https://{pick(WORD_LIST)}.example/{pick(WORD_LIST)}/{pick(WORD_LIST)}", lambda: f"${{{pick(WORD_LIST).upper()}_{pick(WORD_LIST).upper()}}}", lambda: "x" * int(draw.integers(8, 20)), lambda: f"<{pick(WORD_LIST)}-{pick(WORD_LIST)}>".strip("<>") + "-here"])()
                lead = f"{pick(['token', 'secret', 'password', 'api_key', 'auth', 'access_key'])}{pick([': ', ' = ', '='])}"
            else:
                value, lead = pick(["2024-01-05_build-", "release-2023-", "version-1-2-3-"]) + pick(WORD_LIST) + some(string.digits, 4), pick(["", "build ", "token ", "file: "])
            before, after = f"{prose()} {lead}{quote}", f"{quote} {prose()}"
        out.append({"before": before, "candidate": value, "after": after, "label": int(secret)})
    return out


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list:
    """Trees as nested (feature, cut, left, right) tuples with the share of label 1 in the leaves."""
    draw = np.random.default_rng(seed)
    several = max(1, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows, level):
        share = float(y[rows].mean())
        if level == depth or len(rows) < 2 * LEAST_LEAF or share in (0.0, 1.0):
            return round(share, 4)
        best = None
        for f in draw.choice(x.shape[1], several, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(LEAST_LEAF, len(order) - LEAST_LEAF + 1)
            k = k[v[k - 1] < v[k]]
            if len(k):
                left, right, total = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(order) - k), len(order)
                gini = (k * left * (1 - left) + (total - k) * right * (1 - right)) / total
                at = int(np.argmin(gini))
                if best is None or gini[at] < best[0]:
                    best = (gini[at], int(f), round(float((v[k[at] - 1] + v[k[at]]) / 2), 6))
        if best is None:
            return round(share, 4)
        _, f, cut = best
        low = x[rows, f] <= cut
        return f, cut, grow(rows[low], level + 1), grow(rows[~low], level + 1)

    n = len(y)
    return [grow(draw.integers(0, n, n), 0) for _ in range(trees)]


def forest_score(forest: list, value) -> Column:
    """The mean of the trees' leaves; value(name) gives a feature's column."""

    def tree(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, cut, low, high = node
        return F.when(value(NAMES[f]) <= F.lit(cut), tree(low)).otherwise(tree(high))

    return functools.reduce(lambda a, b: a + b, map(tree, forest)) / F.lit(float(len(forest)))


def train(spark: SparkSession, labelled: list[dict] | None = None) -> list:
    """A forest from labelled findings, a bounded list; their features come from the same expressions as in a scan."""
    rows = labelled_findings() if labelled is None else labelled
    schema = "array<struct<before string, candidate string, after string, label int>>"
    df = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("r")).select("r.*")
    found = features(F.col("candidate"), F.col("before"), F.col("after"))
    table = np.array([list(r) for r in df.select(*[found[name] for name in NAMES], F.col("label").cast("double")).collect()])
    return grow_forest(table[:, :-1], table[:, -1])


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once; a column of its own could be inlined and computed for each candidate."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_findings(docs: DataFrame, forest: list, text_col: str, cut: float, pieces_col: str, found_col: str) -> DataFrame:
    """docs with pieces_col (the text between candidates) and found_col: array<struct<candidate, start, score, secret>>; start counts code points from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {k: unused(docs, f"__{k}") for k in ("candidates", "seen")}
    df = docs.withColumn(names["candidates"], F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumn(pieces_col, F.when(F.size(names["candidates"]) > 0, F.split(text, CANDIDATE, -1)))
    pieces, candidates = F.col(pieces_col), F.col(names["candidates"])
    # Offsets are sums over whole blocks of candidates and within one: their cost grows with n times its root, not with its square.
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    step = F.greatest(F.floor(F.sqrt(F.size(candidates))), F.lit(1)).cast("int")
    whole = lambda k: (k / step).cast("int")
    lengths = F.transform(candidates, lambda c, k: F.length(F.get(pieces, k)) + F.length(c))
    blocks = lambda ls: F.transform(F.sequence(F.lit(0), whole(F.size(candidates))), lambda k: total(F.slice(ls, k * step + 1, step)))
    offset = lambda ls, bs, k: total(F.slice(bs, F.lit(1), whole(k))) + total(F.slice(ls, whole(k) * step + 1, k - whole(k) * step)) + F.length(F.get(pieces, k))
    # A candidate's neighbourhood goes on through the candidate before it and that after it.
    before = lambda k: F.concat(F.substring(F.when(k > 0, F.get(candidates, k - 1)).otherwise(F.lit("")), -CONTEXT, CONTEXT), F.substring(F.get(pieces, k), -CONTEXT, CONTEXT))
    after = lambda k: F.concat(F.substring(F.get(pieces, k + 1), 1, CONTEXT), F.substring(F.coalesce(F.get(candidates, k + 1), F.lit("")), 1, CONTEXT))
    found = lambda c, start, near: F.struct(c.alias("candidate"), start.alias("start"), *[x.alias(name) for name, x in features(c, near["before"], near["after"]).items()])
    each = lambda ls, bs: F.transform(candidates, lambda c, k: _bound(F.struct(before(k).alias("before"), after(k).alias("after")), lambda near: found(c, offset(ls, bs, k), near)))
    df = df.withColumn(names["seen"], _bound(lengths, lambda ls: _bound(blocks(ls), lambda bs: each(ls, bs))))
    scored = F.transform(names["seen"], lambda s: F.struct(s["candidate"].alias("candidate"), s["start"].alias("start"), forest_score(forest, lambda name: s[name]).alias("score")))
    return df.withColumn(found_col, F.transform(scored, lambda s: F.struct(s["candidate"].alias("candidate"), s["start"].alias("start"), s["score"].alias("score"), (s["score"] >= cut).alias("secret")))).drop(*names.values())


def scan(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row a candidate: doc_id, start, length, candidate, score, secret."""
    df = with_findings(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), forest, "text", cut, "pieces", "found")
    # Of an inner explode the optimizer would push "not empty" below the columns it is made from, and run the patterns for each candidate.
    df = df.select("doc_id", F.explode_outer("found").alias("x")).filter("x IS NOT NULL")
    return df.select("doc_id", F.col("x.start").cast("bigint").alias("start"), F.length("x.candidate").cast("bigint").alias("length"), "x.candidate", "x.score", "x.secret")


def redact(docs: DataFrame, forest: list, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with each secret replaced by MASK; a null text becomes empty."""
    names = unused(docs, "__pieces"), unused(docs, "__found")
    df = with_findings(docs, forest, text_col, cut, *names)
    pieces, found = map(F.col, names)
    joined = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(found, lambda s, k: F.concat(F.when(s["secret"], F.lit(MASK)).otherwise(s["candidate"]), F.get(pieces, k + 1))), ""))
    return df.withColumn(text_col, F.when(F.exists(found, lambda s: s["secret"]), joined).otherwise(F.coalesce(F.col(text_col), F.lit("")))).drop(*names)
