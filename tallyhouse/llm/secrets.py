"""Secret scans: candidates by a pattern, false positives out by a random forest.

A candidate is a run of at least 16 letters, digits or ``+ / _ -`` with a digit
in it (and up to two ``=`` at its end), whatever of six characters or more is
assigned to a name of a credential (after any blanks, on the next line if alone
there, or between tags), the password of a URL, a private key from its first line
to its last, or a key of a published form. The forest looks at its length, its
character classes and their transitions, how much of it a dictionary covers,
and at the path and the words beside it. It learns from labelled findings, equal
ones as one of their weight. Private keys and published forms need no vote. The
trees are laid out as SQL, so that a text is scanned and masked within its row:
nothing is shuffled, whichever source or copy a text belongs to; repeated rows
each have their findings. An empty table gives no rows.

What the driver holds is bounded: the sample of findings and the dictionary
have sizes of their own. If all labelled findings are of one class, so are all
others. Null texts are empty ones; texts without candidates, and all texts if no
findings could be learnt from, keep every character.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import column, texts, written

#: Characters before and after a candidate that count as beside it.
BESIDE = 80
CREDENTIAL = r"token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer"
ASSIGNED = r"[:=]>?\s*(?:\\\s+)?[\"'`]?$"
#: A name with such a word in it, whose part ends there: a secretary is no secret, an
#: author no credential. Names are tried from their beginning and once, so that
#: very long texts stay linear; repetition is possessive, so that nothing recurses.
_NAMED = (
    rf"(?=[\w\-]*?(?i:{CREDENTIAL})(?!(?i:ors?\b|ored\b|orship))s?+(?![a-z]))[\w\-]++"
)
#: What stands before an assigned value: a name, a sign, blanks or a line end
#: before a value alone on its line, and a quote.
_ASSIGNED_TO = (
    rf"(?<![\w\-])(?=[\w\-]++[\"'`]?+[ \t]*+[:=]){_NAMED}[\"'`]?+[ \t]*+(?::=|=>|==?|:)[ \t]*+"
    r"(?:\\?\r?\n[ \t]*+(?=\S++[ \t]*+(?:[\r\n]|$)))?+[\"'`]?+"
)
_TAGGED = rf"<(?:\w++:)?+{_NAMED}(?:\s[^<>\r\n]*+)?+>[ \t]*+"
#: user: of a URL with user:password@host; a user that may be a key is no prefix.
_KEY_LIKE = r"[A-Za-z0-9+/_\-]{16}"
_URL_USER = rf"://(?!{_KEY_LIKE})[^\s/:@\"'`]*+:"
_PEM_NAME = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: Forms of keys that tell what they are, as their issuers publish them.
KNOWN_FORMS = [
    r"gh[pousr]_[A-Za-z0-9]{36,}+",
    r"github_pat_[A-Za-z0-9_]{22,}+",
    r"glpat-[A-Za-z0-9_\-]{20,}+",
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9_\-]{35}",
    r"xox[abeoprs]-[A-Za-z0-9\-]{10,}+",
    r"[sr]k_live_[A-Za-z0-9]{16,}+",
    r"npm_[A-Za-z0-9]{36}",
    r"SG\.[A-Za-z0-9_\-]{16,}+\.[A-Za-z0-9_\-]{16,}+",
    r"eyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]++",
]
#: A private key from its first line to its last, or as far as it goes.
_PEM = (
    rf"-----BEGIN {_PEM_NAME}(?:(?:[^\-]++|-(?!----))*+-----END {_PEM_NAME}|(?:\s*+[A-Za-z0-9+/=]{{16,}}+)++)"
)
_KNOWN = rf"(?<![A-Za-z0-9+/_\-])(?:{'|'.join(KNOWN_FORMS)})(?![A-Za-z0-9+/_\-])"
#: A character of a value without quotes, which ends at a space, a quote or the next parameter.
_BARE = r"(?:[^\s\"'`&,;]|[,;]++(?=[^\s\"'`,;])|&(?!\w++=))"
#: What a candidate is assigned to comes first in a match; ``_PREFIX`` takes it off.
CANDIDATE = (
    rf"{_PEM}|{_ASSIGNED_TO}(?!-----BEGIN)(?:(?<=\")[^\"\r\n]{{6,}}+(?=\")|(?<=')[^'\r\n]{{6,}}+(?=')|(?<=`)[^`\r\n]{{6,}}+(?=`)"
    rf"|(?<![\"'`])(?={_BARE}{{6}}){_BARE}++)"
    rf"|{_TAGGED}[^\s<>][^<>\r\n]{{5,}}+(?=</)"
    # such a user is one value with its password
    rf"|://(?={_KEY_LIKE})[^\s/:@\"'`]++:[^\s/@\"'`]++(?=@)"
    rf"|{_URL_USER}[^\s/@\"'`]++(?=@)"
    rf"|{_KNOWN}"
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
)
_PREFIX = rf"^(?:{_ASSIGNED_TO}|{_TAGGED}|{_URL_USER}|://)"
_BARE_RUN = r"^[A-Za-z0-9+/_\-]+={0,2}$"
TRANSITION = (
    r"(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
)
#: Values that stand for a secret to come, or are read from elsewhere.
PLACEHOLDER = (
    r"(?i)^(?:required|optional|undefined|string|boolean|example|changeme|hidden|redacted|invalid|missing|x{6,}|\*{6,}"
    r"|<.*>|\$[({].*|\{\{.*|(?:[a-z_]\w*\.)+[a-z_]\w*[(\[].*)$"
)
MASK = "[SECRET]"


@dataclass(frozen=True)
class Settings:
    """``findings``: about so many labelled findings are learnt from.
    ``dictionary``: words kept, the most frequent beside candidates."""

    findings: int = 20_000
    dictionary: int = 2_000
    trees: int = 20
    depth: int = 5
    least_score: float = 0.5


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _lower_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), 0)


def features(value: Column, before: Column, after: Column, dictionary: list[str]) -> dict[str, Column]:
    """What the forest looks at, by name."""
    known = F.array(*[F.lit(w) for w in dictionary]).cast("array<string>")
    covered = F.aggregate(
        F.array_intersect(_lower_runs(value), known), F.lit(0), lambda n, w: n + F.length(w)
    )
    return {
        "length": F.least(F.length(value), F.lit(512)).cast("double"),
        "digits": _share(value, "[0-9]"),
        "upper": _share(value, "[A-Z]"),
        "lower": _share(value, "[a-z]"),
        "transitions": _share(value, TRANSITION),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "hex": value.rlike(r"^[0-9a-fA-F]+$").cast("double"),
        "dictionary": covered / F.length(value),
        "path": _share(value, r"[/_\-]"),
        "path_before": before.rlike(r"[/\\.:@#?&]$").cast("double"),
        "assigned": before.rlike(f"{ASSIGNED}|{_TAGGED}$").cast("double"),
        "quoted": before.rlike(r"[\"'`]$").cast("double"),
        # a URL's password is assigned to its user
        "credential": (before.rlike(f"(?i:{CREDENTIAL})") | _of_url(value, before)).cast("double"),
        "words_beside": F.size(F.array_intersect(_lower_runs(F.concat_ws(" ", before, after)), known)).cast(
            "double"
        ),
    }


def _of_url(value: Column, before: Column) -> Column:
    """Whether a value is the password of a URL, or its user and password."""
    return before.rlike(_URL_USER + "$") | (before.endswith("://") & value.contains(":"))


def known_form(value: Column) -> Column:
    """Whether a value is a private key, or has the form of an issuer's keys."""
    return value.startswith("-----BEGIN ") | value.rlike(f"^(?:{'|'.join(KNOWN_FORMS)})$")


def label(value: Column, before: Column) -> Column:
    """1 for a value of a known form, or assigned to a name of a credential, 0 for
    what is plainly a number, a UUID, a part of a path, a placeholder, or text; null
    for findings nobody can tell. Passwords of URLs are 1."""
    credential = before.rlike(
        rf"(?i:{CREDENTIAL})[\w\-]*+[\"'`]?+\s*+[:=]?{ASSIGNED}|{_TAGGED}$"
    )
    uuid = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
    placeholder = value.rlike(PLACEHOLDER)
    plain = (
        placeholder
        | value.rlike(r"^[0-9+/_\-]+$")
        | value.rlike(uuid)
        | before.rlike(r"(?:://|/|\\)[^\s\"']*$")
        | (~before.rlike(ASSIGNED) & value.rlike("[A-Za-z]{8,}"))
    )
    told = known_form(value) | _of_url(value, before) | (credential & ~value.rlike(r"^[0-9]+$"))
    return F.when(told & ~placeholder, 1.0).when(plain, 0.0)


def with_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, ``gaps`` (the texts between candidates) and ``candidates``
    (value, before, after)."""
    found = texts(docs, id_col, text_col).withColumn("any", F.col("text").rlike(CANDIDATE))
    found = found.select(
        "doc_id",
        "text",
        F.when(F.col("any"), F.split("text", CANDIDATE, -1)).alias("between"),
        F.transform(
            F.when(F.col("any"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0)),
            lambda m: F.struct(
                m.alias("match"),
                F.when(m.rlike(_BARE_RUN), "").otherwise(F.regexp_extract(m, _PREFIX, 0)).alias("prefix"),
            ),
        ).alias("matches"),
    )
    # a prefix belongs to the text before its value
    found = found.withColumn(
        "gaps",
        F.transform(
            "between",
            lambda g, i: F.concat(g, F.coalesce(F.get(F.col("matches"), i)["prefix"], F.lit(""))),
        ),
    )
    beside = F.transform(
        F.col("matches"),
        lambda m, i: F.struct(
            F.substring(m["match"], F.length(m["prefix"]) + 1, F.length(m["match"])).alias("value"),
            F.right(
                F.get(F.col("gaps"), i), F.greatest(F.lit(BESIDE), F.length(m["prefix"]))
            ).alias("before"),
            F.left(F.get(F.col("gaps"), i + 1), F.lit(BESIDE)).alias("after"),
        ),
    )
    return found.select("doc_id", "text", "gaps", beside.alias("candidates"))


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, threshold, left, right) or a leaf's class."""

    names: tuple[str, ...]
    trees: tuple
    dictionary: tuple[str, ...]
    least_score: float

    def score(self, known: dict[str, Column]) -> Column:
        """Share of the trees that vote for a secret."""

        def vote(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(known[self.names[feature]] <= threshold, vote(left)).otherwise(vote(right))

        if not self.trees:
            return F.lit(0.0)
        return reduce(lambda a, b: a + b, [vote(t) for t in self.trees]) / len(self.trees)


def parse_tree(lines: list[str], at: int = 0) -> tuple[object, int]:
    """A tree from the lines of its printed form, and the line after it."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1]), at + 1
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left, at = parse_tree(lines, at + 1)
    right, at = parse_tree(lines, at + 1)  # the line between them is the Else
    return (int(feature), float(threshold), left, right), at


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    labels: Callable[[Column, Column], Column] = label,
) -> Forest:
    """Learns from the labelled findings of all texts. ``labels`` gives a
    finding's label from its value and the text before it."""
    findings = with_candidates(docs, id_col, text_col).select(F.explode("candidates").alias("c"))
    findings = findings.select("c.*").withColumn("label", labels(F.col("value"), F.col("before")))
    # only what the forest needs of the texts: a few hundred characters a finding
    findings = written(findings.withColumn("value", F.left("value", F.lit(512))), "findings")
    beside = F.array_distinct(_lower_runs(F.concat_ws(" ", "before", "after")))
    dictionary = tuple(
        r["word"]
        for r in findings.select(F.explode(beside).alias("word"))
        .filter(~F.col("word").rlike(f"^(?:{CREDENTIAL})$"))
        .groupBy("word")
        .count()
        .orderBy(F.desc("count"), "word")
        .limit(settings.dictionary)
        .collect()
    )
    # equal findings are one example of their number, so that copies cannot swell the sample
    labelled = (
        findings.filter("label IS NOT NULL")
        .groupBy("value", "before", "after", "label")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    known = features(F.col("value"), F.col("before"), F.col("after"), list(dictionary))
    names = tuple(known)
    if len(sizes) < 2:
        # one class is the verdict on all findings; none, without labels
        return Forest(names, tuple(sizes), dictionary, settings.least_score)
    share = min(1.0, settings.findings / sum(sizes.values()))
    place = F.pmod(F.xxhash64("value", "before", "after"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(place < share).select(*[c.alias(n) for n, c in known.items()], "label", "weight")
    rows = VectorAssembler(inputCols=list(names), outputCol="features").transform(sample)
    model = RandomForestClassifier(
        numTrees=settings.trees,
        maxDepth=settings.depth,
        featureSubsetStrategy="onethird",
        weightCol="weight",
        seed=7,
    ).fit(rows.select("features", "label", "weight"))
    trees = tuple(parse_tree(t.toDebugString.strip().split("\n")[1:])[0] for t in model.trees)
    return Forest(names, trees, dictionary, settings.least_score)


def scan(
    docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``findings`` (start, end, value, score,
    secret; code points, end exclusive) and the text with secrets masked."""

    def scored(c: Column) -> Column:
        known = features(c["value"], c["before"], c["after"], list(forest.dictionary))
        # forms of keys need no vote
        score = F.when(known_form(c["value"]), 1.0).otherwise(forest.score(known))
        return F.struct(c["value"].alias("value"), score.alias("score"))

    rows = with_candidates(docs, id_col, text_col).withColumn(
        "scored", F.transform("candidates", scored)
    )
    # running end of the candidate before, as a list
    ends = F.aggregate(
        F.transform("scored", lambda c, i: F.length(F.get("gaps", i)) + F.length(c["value"])),
        F.array(F.lit(0)),
        lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n)),
    )
    rows = rows.withColumn("ends", F.when(F.col("scored").isNotNull(), ends))
    findings = F.transform(
        "scored",
        lambda c, i: F.struct(
            (F.get("ends", i + 1) - F.length(c["value"])).alias("start"),
            F.get("ends", i + 1).alias("end"),
            c["value"].alias("value"),
            c["score"].alias("score"),
            (c["score"] >= forest.least_score).alias("secret"),
        ),
    )
    masked = F.concat(
        F.array_join(
            F.transform(
                "scored",
                lambda c, i: F.concat(
                    F.get("gaps", i),
                    F.when(c["score"] >= forest.least_score, MASK).otherwise(c["value"]),
                ),
            ),
            "",
        ),
        F.element_at("gaps", -1),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,value:string,score:double,secret:boolean>>")
    return rows.select(
        "doc_id",
        F.coalesce(findings, nothing).alias("findings"),
        F.coalesce(masked, F.col("text")).alias("masked"),
    )


def masked_rows(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the secrets of their text masked. Texts without
    secrets stay as they are, null ones too."""
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(text_col).alias("text"))
    found = scan(whole, forest, "row", "text").select(F.col("doc_id").alias("row"), "findings", "masked")
    any_secret = F.exists("findings", lambda f: f["secret"])
    return found.select(
        *[
            F.when(any_secret, F.col("masked")).otherwise(F.col("row")[c]).alias(c)
            if c == text_col
            else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )
