"""Generated, minified, vendored and data files among sources, by a random forest.

Labels come from notices on any line ("generated by", "vendored from", licence banners of libraries, lock
files). Data held as code never carry one; files whose lines are nearly all literals are labelled as such.
Notices and the share of literal lines are hidden from the features: compression ratio, token entropy,
identifier lengths, comment density, line shapes and, counted over the whole corpus, how many repositories
hold the same body. Many files without a label are of the same kinds, so the forest is fitted in rounds on
one example of every distinct body, part by part: what its trees, each judging only bodies it was not fitted on, find as
likely as a fraction of the labelled ones counts as labelled in the next round. The last forest alone
decides, also for files with a label.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.syntax import file_text
from lodeweave.llm.trees import Ensemble, Forests, out_of_bag, random_forest
from lodeweave.runtime import cut, ship

#: Distinct bodies of a part, which grows its share of the forest's trees; larger parts if there were more than so many of them.
SAMPLE, MOST_PARTS, TREES = 20_000, 300, 60
#: Rounds of fitting; the part of the labelled bodies' mean probability, and the probability, from which a body counts as labelled next.
ROUNDS, LIKELY, LEAST_LIKELY = 12, 0.3, 0.25
#: Share of literal lines, of at least so many lines, from which a file is data held as code.
DATA_SHARE, DATA_LINES = 0.8, 10

# Notices of tools, of third parties and of bundlers.
_NOTICE = re.compile(
    r"(?i)\bcode generated (?:by|from)\b|@generated\b|<auto-?generated|\bauto-?generated (?:file|by|from|code)\b|\bautomatically (?:generated|created|produced)\b|\bgenerated (?:by|from|with|using) [\w./-]+[^.]*(?:do not|version|v?\d)|\bmachine[- ](?:written|generated|made)\b|\bfile (?:was|is) (?:auto\w*[- ])?(?:generated|produced|created|written) by\b|automatisch (?:erzeugt|generiert|erstellt)|généré automatiquement|automatiquement généré|generado automáticamente|@(?:javax|jakarta)\.annotation\.(?:processing\.)?Generated|@Generated\("
    r"|\bvendored (?:from|copy)\b|\bcopied from (?:upstream|https?:)|\bupstream project\b|\bthe [\w-]+ (?:contributors|authors|developers)\b|\bcopy of [\w-]+ v?\d+\.\d+|\bthird[- ]party (?:code|library|source)\b|^\s*(?://|#|/?\*|--)\s*[\w.-]+ - https?://|^\s*(?://|#|/?\*+!?|--)\s*[\w.-]+ v\d+(?:\.\d+)*\s*(?:\*/)?\s*$"
    r"|^\s*\"lock(?:file)?_?[vV]ersion\"\s*:|\bsourceMappingURL="
)
_NOT_NOTICE = re.compile(r"(?i)written by hand|by hand\b|not generated|reads? generated|no longer generated|used to be generated")
_OPENING = re.compile(r"/\*|<!--|(?<![:\w\"'/])//[#@]?|(?<![\w&\"'])#(?!\w)|(?<!\S)--(?=\s)|^\s*\*")
_SIGNS = " \t\r/*#-<>!;"
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|!)|/\*|\*|--|<!--|;)")
# Literals one after the other, never taken back, so that long lines take time in proportion.
_LITERAL = re.compile(r"""^\s*+[\[({]*+\s*+(?:(?>[-+]?(?:0[xX][0-9a-fA-F]++|\d++(?:\.\d++)?)(?:[LU]|F(?!alse))?|true|false|null|None|["'][^"']*+["'])\s*+[,;+\]\)}]*+\s*+)++\\?$|^\s*+["'`][A-Za-z0-9+/=\\]{24,}+["'`]?[,;+)\s]*+$|^\s*+INSERT\s++INTO\s++\S++\s++(?:\([^)]*+\)\s*+)?VALUES\s*+\((?:\s*+(?>-?[\d.]++|'(?:''|[^'])*+'|NULL|TRUE|FALSE)\s*+,?+)++\)\s*+;?\s*+$""", re.I)
_VALUES = re.compile(r"^\s*+(?:INSERT\s++INTO\b.*?)?\(?VALUES?\s*+\(", re.I)
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d+|\S")
FEATURES = [
    "compression", "char_entropy", "token_entropy", "identifier_length", "identifier_short", "identifier_variety", "comments", "log_lines", "log_chars", "line_mean", "line_max", "line_sd", "blank",
    "digits", "signs", "shape_variety", "shape_top", "numbered_names", "log_owners", "listed_lines", "is_sql", "is_config",
]


def _without_notices(line: str) -> str | None:
    """The line without its notices, each with its comment, or the statement it is in; None if it has no notice."""
    rest, done, at, found = [], 0, 0, False
    while m := _NOTICE.search(line, at):
        opened = None
        for opened in _OPENING.finditer(line, at, m.start()):
            pass
        opened = opened or _OPENING.match(line, m.start() + len(m.group()) - len(m.group().lstrip()))
        closing = "*/" if opened and opened.group().startswith("/*") else "-->" if opened and opened.group() == "<!--" else ""
        if opened and closing and 0 <= line.find(closing, opened.end()) < m.start():
            opened = None  # that comment was over
        # what a match takes in beyond the comment or statement it begins in does not belong to it
        if opened:
            begin, k = opened.start(), line.find(closing, max(m.start(), opened.end())) if closing else -1
            end = k + len(closing) if k >= 0 else len(line)
        else:
            begin, after = 1 + max(line.rfind(c, at, m.start()) for c in ";{}"), [k for c in ";{}" if (k := line.find(c, m.start())) >= 0]
            begin, end = max(begin, at), min(after) + 1 if after else len(line)
        if not _NOT_NOTICE.search(line[begin:end]):
            rest.append(line[done:begin])
            done, found = end, True
        at = end
    return "".join(rest) + line[done:] if found else None


def body_of(text: str) -> tuple[bool, list[str]]:
    """(has a notice on any line, lines without the header comment and without notices)."""
    lines = text.split("\n")
    noticed, kept, header = False, [], True
    for line in lines:
        rest = _without_notices(line)
        if rest is not None:
            noticed, line = True, rest
            if not rest.strip(_SIGNS):
                continue
        header = header and (not line.strip() or bool(_COMMENT.match(line)))
        if not header:
            kept.append(line)
    return noticed, kept


def is_literal(line: str) -> bool:
    """The line is literals only, a string of encoded data, or rows of values."""
    if _LITERAL.match(line):
        return True
    m = _VALUES.match(line)
    return bool(m) and line[m.end() :][: -1 if line[-1] in ",;" else None].rstrip().endswith(")")


def literal_share(lines: list[str]) -> float:
    """Share of the lines that are not blank which hold literals only."""
    full = [s for s in lines if s.strip()]
    return sum(map(is_literal, full)) / max(1, len(full))


def _entropy(counts) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0


def features(path: str, lines: list[str]) -> list[float]:
    """The feature row of one file, but for the number of owners; zeros where there is nothing to count."""
    text = "\n".join(lines)
    data = text.encode("utf-8", "replace")
    n = max(1, len(text))
    full = [s for s in lines if s.strip()]
    k = max(1, len(full))
    words = _WORD.findall(text)
    tokens = _TOKEN.findall(text)
    lengths = [len(s) for s in full] or [0]
    shapes = Counter(re.sub(r"\w+", "w", s) for s in full)
    name = path.lower().rsplit("/", 1)[-1]
    return [
        len(zlib.compress(data, 6)) / max(1, len(data)), _entropy(Counter(text).values()), _entropy(Counter(tokens).values()),
        sum(map(len, words)) / max(1, len(words)), sum(len(w) < 3 for w in words) / max(1, len(words)), len(set(words)) / max(1, len(words)),
        sum(bool(_COMMENT.match(s)) for s in full) / k, math.log1p(len(full)), math.log1p(len(text)), sum(lengths) / k, max(lengths), float(np.std(lengths)), 1 - len(full) / max(1, len(lines)),
        sum(map(str.isdigit, text)) / n, sum(not (c.isalnum() or c.isspace() or c == "_") for c in text) / n,
        len(shapes) / k, shapes.most_common(1)[0][1] / k if shapes else 0.0, sum(w[-1].isdigit() for w in words) / max(1, len(words)), 0.0,
        sum(len(s) > 60 and s.count(":") + s.count("=") > 2 for s in full) / k,
        float(name.endswith(".sql")), float(name.endswith((".json", ".xml", ".yaml", ".yml", ".properties", ".toml"))),
    ]


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for fid, repo, path, text in zip(b["file_id"], b["repo"], b["relpath"], b["text"]):
            noticed, lines = body_of(text or "")
            is_data = sum(bool(s.strip()) for s in lines) >= DATA_LINES and literal_share(lines) >= DATA_SHARE
            body = "\n".join(s for s in lines if not _COMMENT.match(s)).strip()
            rows.append((fid, repo, noticed or is_data, blake2b(body.encode("utf-8", "replace"), digest_size=16).hexdigest() if body else None, features(path or "", lines)))
        yield pd.DataFrame(rows, columns=["file_id", "repo", "labelled", "body", "x"])


def describe(files: DataFrame) -> DataFrame:
    """(file_id, labelled, body, x): label, digest of the body and features of every scan, with corpus-wide owner counts.

    A body without anything but comments has a null digest and no owners but its own.
    """
    ship(files.sparkSession)
    source = files.select("file_id", "repo", "relpath", file_text().alias("text")).where("text is not null")
    described = cut(source.mapInPandas(_describe, "file_id bigint, repo string, labelled boolean, body string, x array<double>"))
    owners = described.where("body is not null").select("body", "repo").distinct().groupBy("body").agg(F.count("*").alias("owners")).where("owners > 1")
    at = FEATURES.index("log_owners")
    return described.join(owners, "body", "left").select("file_id", "labelled", "body", F.transform("x", lambda v, i: F.when(i == at, F.log1p(F.coalesce("owners", F.lit(1)) - 1)).otherwise(v)).alias("x"))


def _fit(x: np.ndarray, labelled: np.ndarray, n_trees: int, seed: int = 0) -> Ensemble | None:
    """The forest of one part of the bodies; None if fewer than three are labelled."""
    if labelled.sum() < 3:
        return None
    y = labelled
    for r in range(ROUNDS):
        p = out_of_bag(x, y, seed=11 + seed + r)
        more = labelled | (p >= max(LEAST_LIKELY, LIKELY * p[labelled].mean()))
        if (more == y).all():
            break
        y = more
    return random_forest(x, y, n_trees, seed=13 + seed)


def fit(described: DataFrame, sample: int = SAMPLE) -> Forests | Ensemble:
    """Fit the forest on all distinct bodies; one is labelled if any of its files is.

    Files are dealt into parts of about ``sample`` bodies, at most MOST_PARTS, and every part grows its share of the
    trees, at least one, from the distinct bodies of its files: a body of one file is in one part, a library that
    thousands of files hold is in all of them, however many bodies there are. Parts in which fewer than three bodies
    are labelled grow none.
    """
    spark = described.sparkSession
    ship(spark)
    own = described.where("body is not null")
    parts = min(MOST_PARTS, max(1, math.ceil(own.select("body").distinct().count() / sample)))
    one = own.groupBy("body").agg(F.max("labelled").alias("labelled"), F.min_by("x", "file_id").alias("x"), F.collect_set(F.pmod(F.xxhash64("file_id"), F.lit(parts)).cast("int")).alias("parts"))
    n_trees = math.ceil(TREES / parts)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("body")
        x, labelled = np.array(b["x"].tolist(), float).reshape(len(b), len(FEATURES)), b["labelled"].to_numpy(bool)
        part = int(b["part"].iloc[0])
        return pd.DataFrame({"part": [part], "n": [len(b)], "labelled": [int(labelled.sum())], "forest": [pickle.dumps(_fit(x, labelled, n_trees, 100 * part))]})

    dealt = one.select("body", "labelled", "x", F.explode("parts").alias("part")).repartition(parts, "part")
    got = dealt.groupBy("part").applyInPandas(run, "part int, n bigint, labelled bigint, forest binary").toPandas().sort_values("part")
    forests = [f for f in map(pickle.loads, got["forest"]) if f]
    return Forests(forests) if forests else Ensemble(np.zeros((len(FEATURES), 1)), float(got["labelled"].sum() / max(1, got["n"].sum())), 0.0, [])


def find_generated(files: DataFrame) -> DataFrame:
    """(file_id, probability, labelled, is_generated) for every scan of a file.

    Files whose lines are null are not judged (no row). The forest decides, with or without a label; only
    where comments and notices are all there is, so that it has nothing to judge, the notice decides, and
    empty files are hand-written. Repeated scans each give a row; extra columns are ignored.
    """
    spark = files.sparkSession
    described = cut(describe(files))
    shared = spark.sparkContext.broadcast(fit(described))  # bounded by the number and depth of trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), float).reshape(len(b), len(FEATURES))
            p = np.where(b["body"].notna(), shared.value.predict(x), b["labelled"].astype(float))
            yield pd.DataFrame({"file_id": b["file_id"], "probability": p, "labelled": b["labelled"], "is_generated": p >= 0.5})

    return described.mapInPandas(run, "file_id bigint, probability double, labelled boolean, is_generated boolean")
