"""Commit history: the text of ``git log`` as rows, merged into commits and changed files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions.text import author_id

#: One header line a commit; fields are parted by unit separators, which no name holds.
HEADER = "\x1e%H\x1f%h\x1f%an\x1f%ae\x1f%aI\x1f%cn\x1f%ce\x1f%cI\x1f%P\x1f%s"
_FIELDS = ["hash", "short", "author_name", "author_email", "authored_at", "committer_name", "committer_email", "committed_at", "parents", "message"]


#: Lines of a log of counts and of one of states.
_STAT, _STATUS = "^(\\d+|-)\t(\\d+|-)\t", "^[A-Z]\\d*\t"
#: Commits that one task asks git for.
CHUNK = 50_000


def _git(repo_path: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo_path, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def read_log(spark: SparkSession, repo_path: str, mode: str, since: str = "", limit: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(line_no, line) of ``git log --numstat`` or ``--name-status``.

    The driver only counts the commits; every task runs git over a chunk of them, in a working copy that all
    executors see. Line numbers grow from chunk to chunk, and every chunk begins with a commit.
    """
    span = [f"{since}..HEAD"] if since else ["--all"]
    n = int(_git(repo_path, "rev-list", "--count", *span))
    n = min(n, limit) if limit else n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                lines = _git(repo_path, "log", f"--{mode}", f"--format={HEADER}", f"--skip={k * chunk}", f"--max-count={min(chunk, n - k * chunk)}", *span).split("\n")
                yield pd.DataFrame({"line_no": range((k << 32), (k << 32) + len(lines)), "line": lines})

    parts = -(-n // chunk)
    return spark.range(0, parts, 1, max(1, parts)).mapInPandas(run, "line_no bigint, line string")


def log_rows(log: DataFrame, *by: str) -> DataFrame:
    """Log lines with the fields of the commit header above them carried forward; ``by`` tells logs apart.

    Lines are ordered within blocks of line numbers, and the last header of a block goes on into the next, so
    that a log is not ordered in one task.
    """
    w = Window.partitionBy(*by, "block").orderBy("line_no")
    blocked = log.withColumn("block", F.floor(F.col("line_no") / 100_000))
    mine = F.last(F.when(F.col("line").startswith("\x1e"), F.col("line")), ignorenulls=True)
    inside = blocked.withColumn("header", mine.over(w))
    lasts = inside.groupBy(*by, "block").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line_no"))).alias("end"))
    over = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    before = lasts.select(*by, "block", F.last("end", ignorenulls=True).over(over).alias("before"))
    full = inside.join(before, [*by, "block"]).withColumn("header", F.coalesce("header", "before"))
    parts = F.split(F.expr("substring(header, 2)"), "\x1f")
    return full.where("header is not null").select(*by, "line_no", "line", *[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(_FIELDS)])


def _by(df: DataFrame) -> list[str]:
    """The repository, where a frame holds the logs of several."""
    return [c for c in ("repo",) if c in df.columns]


def normal_path(p: str | Column, keep_prefix: bool = True) -> Column:
    """The new path of a rename: ``a/{b => c}/d`` is ``a/c/d``, ``a => b`` is ``b``.

    With ``keep_prefix`` off, what stands before the braces is lost, as in older extracts.
    """
    p = F.col(p) if isinstance(p, str) else p
    braces = F.regexp_replace(F.regexp_replace(p, r"\{[^{}]* => ([^{}]*)\}" if keep_prefix else r"^.*\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    return F.when(~p.contains(" => "), p).when(p.contains("{"), braces).otherwise(F.regexp_replace(p, r"^.* => ", ""))


def numstat(rows: DataFrame) -> DataFrame:
    """(hash, path, insertions, deletions); binary files count 0."""
    part = F.split("line", "\t")
    n = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("int"), F.lit(0))
    return rows.where(F.rlike("line", F.lit(_STAT))).select(*_by(rows), "hash", normal_path(F.get(part, F.lit(2))).alias("path"), n(0).alias("insertions"), n(1).alias("deletions"))


def name_status(rows: DataFrame) -> DataFrame:
    """(hash, path, change_type): the first letter of the status and the new path."""
    part = F.split("line", "\t")
    return rows.where(F.rlike("line", F.lit(_STATUS))).select(*_by(rows), "hash", F.element_at(part, -1).alias("path"), F.substring("line", 1, 1).alias("change_type"))


def changed_files(stat: DataFrame, status: DataFrame) -> DataFrame:
    """Both logs merged by (hash, path); what only one names has changeType M or no counts."""
    keys = [*_by(stat), "hash", "path"]
    return stat.join(status, keys, "full_outer").select(*keys, F.coalesce("change_type", F.lit("M")).alias("change_type"), F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


def commits(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row a commit with its sums over files; parents as an array."""
    keys = [*_by(rows), "hash"]
    head = rows.where(F.col("line").startswith("\x1e")).select(*_by(rows), *_FIELDS).dropDuplicates(keys).withColumn("parents", F.filter(F.split("parents", " "), lambda x: x != ""))
    per = files.groupBy(*keys).agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count("*").alias("files_changed"))
    return head.join(per, keys, "left").fillna(0, ["insertions", "deletions", "files_changed"])


def parsed_entries(entries: DataFrame) -> DataFrame:
    """Logs of which every row is a commit: (header, stat, status), the lines of both logs below its header.

    Gives the fields of the header and ``changes``: both logs merged by path as in ``changed_files``. No row meets
    another, so a commit of many files, or a repository of many commits, is neither moved nor ordered. Where both
    logs name the same paths in the same order, as git does, they are laid side by side, else looked up by path.
    """
    parts = F.split(F.expr("substring(header, 2)"), "\x1f")
    n = lambda x, i: F.when(F.get(x, F.lit(i)) == "-", 0).otherwise(F.coalesce(F.get(x, F.lit(i)).try_cast("int"), F.lit(0)))
    cells = lambda c, form: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.rlike(x, F.lit(form))), lambda x: F.split(x, "\t"))
    stat = F.transform(cells("stat", _STAT), lambda x: F.struct(normal_path(F.get(x, F.lit(2))).alias("path"), n(x, 0).alias("insertions"), n(x, 1).alias("deletions")))
    status = F.transform(cells("status", _STATUS), lambda x: F.struct(F.element_at(x, -1).alias("path"), F.substring(F.get(x, F.lit(0)), 1, 1).alias("change_type")))
    e = entries.where(F.col("header").startswith("\x1e")).select("*", stat.alias("_a"), status.alias("_b"))
    one = lambda path, kind, i, d: F.struct(path.alias("path"), kind.alias("change_type"), i.alias("insertions"), d.alias("deletions"))
    beside = F.zip_with("_a", "_b", lambda x, y: one(x["path"], y["change_type"], x["insertions"], x["deletions"]))
    kinds = lambda x: F.transform(F.filter("_b", lambda y: y["path"] == x["path"]), lambda y: one(x["path"], y["change_type"], x["insertions"], x["deletions"]))
    known = F.flatten(F.transform("_a", lambda x: F.when(F.array_contains("_b.path", x["path"]), kinds(x)).otherwise(F.array(one(x["path"], F.lit("M"), x["insertions"], x["deletions"])))))
    alone = F.transform(F.filter("_b", lambda y: ~F.array_contains("_a.path", y["path"])), lambda y: one(y["path"], y["change_type"], F.lit(0), F.lit(0)))
    changes = F.when(F.col("_a.path") == F.col("_b.path"), beside).otherwise(F.concat(known, alone))
    fields = [F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(_FIELDS)]
    return e.select(*_by(entries), *fields, changes.alias("changes")).withColumn("parents", F.filter(F.split("parents", " "), lambda x: x != ""))


def entry_commits(parsed: DataFrame) -> DataFrame:
    """One row a commit of ``parsed_entries`` with its sums over files, as ``commits`` gives it; a commit is one entry."""
    total = lambda c: F.aggregate("changes", F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    return parsed.select(*_by(parsed), *_FIELDS, total("insertions").alias("insertions"), total("deletions").alias("deletions"), F.size("changes").cast("bigint").alias("files_changed"))


def entry_changes(parsed: DataFrame, *also: str) -> DataFrame:
    """One row a changed file of ``parsed_entries``, as ``changed_files`` gives it, with the header's fields ``also``."""
    keys = [*_by(parsed), "hash"]
    # outer, as a plain explode adds a filter that merges both logs a second time
    return parsed.select(*keys, *also, F.explode_outer("changes").alias("c")).where("c is not null").select(*keys, "c.path", "c.change_type", "c.insertions", "c.deletions", *also)


def authors(c: DataFrame) -> DataFrame:
    """(id, name, email): authors overwrite committers of the same id."""
    one = lambda n, e, p: c.select(author_id(e, n).alias("id"), F.struct(F.lit(p), F.col("authored_at"), F.col(n).alias("name"), F.col(e).alias("email")).alias("r"))
    best = one("author_name", "author_email", 1).union(one("committer_name", "committer_email", 0)).where("id is not null").groupBy("id").agg(F.max("r").alias("r"))
    return best.select("id", "r.name", "r.email")


def refs(lines: DataFrame) -> DataFrame:
    """(kind, name, commit) of ``for-each-ref`` lines 'refname objectname peeled': branches without remote HEADs, peeled tags."""
    part = F.split("line", " ")
    ref, obj, peeled = (F.get(part, F.lit(i)) for i in range(3))
    r = lines.select(*_by(lines), F.when(ref.startswith("refs/tags/"), "tag").otherwise("branch").alias("kind"), F.regexp_replace(ref, r"^refs/(?:heads|remotes/[^/]+|tags)/", "").alias("name"), F.coalesce(F.nullif(peeled, F.lit("")), obj).alias("commit"), ref.startswith("refs/heads/").alias("own"))
    return r.where("name <> 'HEAD' and commit is not null").groupBy(*_by(lines), "kind", "name").agg(F.max_by("commit", "own").alias("commit"))


def marks(stored: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, since): the stored mark (repo, mark) of every repository, '' (everything) where no commit (repo, hash) is it."""
    held = known.select("repo", F.col("hash").alias("mark")).distinct().withColumn("held", F.lit(True))
    return stored.join(held, ["repo", "mark"], "left").select("repo", F.when(F.col("held"), F.col("mark")).otherwise("").alias("since"))


def head_commit(repo_path: str) -> str:
    """The commit that HEAD names; '' where there is none."""
    try:
        return _git(repo_path, "rev-parse", "--verify", "HEAD").strip()
    except subprocess.CalledProcessError:
        return ""


def commit_exists(repo_path: str, commit: str) -> bool:
    return bool(commit) and subprocess.run(["git", "-C", repo_path, "cat-file", "-e", f"{commit}^{{commit}}"], capture_output=True).returncode == 0


def changed_paths(spark: SparkSession, repo_path: str, since: str) -> DataFrame:
    """(relpath) of what changed since a commit, deleted files left out; everything tracked if it is not known."""
    known = commit_exists(repo_path, since)
    out = _git(repo_path, "diff", "--name-only", "--diff-filter=d", "-z", f"{since}..HEAD") if known else _git(repo_path, "ls-files", "-z")
    return spark.createDataFrame([(x,) for x in out.split("\0") if x], "relpath string")


def ref_lines(spark: SparkSession, repo_path: str) -> DataFrame:
    """(line) of branches and tags, as ``refs`` reads them."""
    out = _git(repo_path, "for-each-ref", "--format=%(refname) %(objectname) %(*objectname)", "refs/heads", "refs/remotes", "refs/tags")
    return spark.createDataFrame([(x,) for x in out.split("\n") if x], "line string")


def resolve_since(wanted: str, stored: str | None, known: DataFrame) -> str:
    """The commit to continue after: an explicit one, or with 'auto' the stored mark; '' (everything) if it is not known."""
    mark = stored if wanted == "auto" else wanted
    if not mark or known.where(F.col("hash") == mark).limit(1).count() == 0:
        return ""
    return mark
