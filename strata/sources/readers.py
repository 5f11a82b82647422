"""Version-control dumps and JSON results as tables: Spark's text and JSON readers, column functions, no Python code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.lines import skip_flags, skipped_rows
from strata.functions.paths import detect_lang, resolve_rename
from strata.operators.clean import materialize


def _records(spark: SparkSession, path: str, start: str) -> DataFrame:
    """One row a record of a dump in which records begin with `start` at the start of a line, with the file's stem as repo."""
    rows = spark.read.option("lineSep", "\n" + start).text(path)
    repo = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    record = F.when(F.col("value").startswith(start), F.substr("value", F.lit(len(start) + 1))).otherwise(F.col("value"))
    return rows.where("value <> ''").select(repo.alias("repo"), F.regexp_replace(record, "\n+$", "").alias("record"))


def _headed(spark: SparkSession, path: str, email: bool) -> DataFrame:
    """(repo, commit_id, author, committed_at, subject, body); records with fewer header fields are dropped."""
    n = 5 if email else 4
    rows = _records(spark, path, "COMMIT:").withColumn("head", F.split(F.substring_index("record", "\n", 1), r"\|", n))
    rows = rows.where(F.size("head") == n)
    at = F.try_to_timestamp(F.col("head")[n - 2], F.lit("yyyy-MM-dd HH:mm:ss Z"))
    body = F.substr("record", F.length(F.substring_index("record", "\n", 1)) + 2)
    return rows.select("repo", F.col("head")[0].alias("commit_id"), F.col("head")[1].alias("author"), at.alias("committed_at"), F.col("head")[n - 1].alias("subject"), body.alias("body"))


def read_commit_log(spark: SparkSession, path: str, email: bool = False) -> tuple[DataFrame, DataFrame]:
    """A `log --numstat [-p]` dump -> (commits, file_changes); with diffs, code files count lines without comments."""
    rows = _headed(spark, path, email)
    commits = rows.select("repo", "commit_id", "author", "committed_at", "subject", F.lit(False).alias("is_merge"))
    head = F.substring_index("body", "\ndiff --git ", 1)
    head = F.when(F.col("body").startswith("diff --git "), F.lit("")).otherwise(head)
    stat = rows.select("repo", "commit_id", F.explode(F.split(head, "\n")).alias("line")).select("repo", "commit_id", F.split("line", "\t").alias("f"))
    count = lambda i: F.coalesce(F.col("f")[i].try_cast("bigint"), F.lit(0))
    changes = stat.where(F.size("f") == 3).select("repo", "commit_id", resolve_rename(F.col("f")[2]).alias("path"), count(0).alias("insertions"), count(1).alias("deletions"))
    diffs = diff_line_counts(rows.select("repo", "commit_id", "body"))
    both = changes.join(diffs, ["repo", "commit_id", "path"], "left")
    return commits, both.select(
        "repo", "commit_id", "path", F.coalesce("diff_insertions", "insertions").alias("insertions"), F.coalesce("diff_deletions", "deletions").alias("deletions")
    )


def _rest(parts: Column) -> Column:
    """All elements of a nonempty array but the first."""
    return F.slice(parts, F.lit(2), F.size(parts))


def diff_line_counts(records: DataFrame) -> DataFrame:
    """records(repo, commit_id, body with diffs) -> (repo, commit_id, path, diff_insertions, diff_deletions) of code
    files with a hunk: added and removed lines but for blanks and comments. Comment state starts anew at each hunk."""
    files = records.select("repo", "commit_id", F.explode(_rest(F.split(F.concat(F.lit("\n"), "body"), "\ndiff --git "))).alias("diff"))
    parts = F.split("diff", "\n@@")
    head = F.split(parts[0], "\n")
    renamed = F.try_element_at(F.filter(head, lambda x: x.startswith("+++ b/") & (F.length(x) > 6)), F.lit(-1))
    path = F.coalesce(F.substr(renamed, F.lit(7)), F.substring_index(head[0], " b/", -1))
    hunks = files.where(F.size(parts) > 1).select("repo", "commit_id", path.alias("path"), F.explode(_rest(parts)).alias("hunk"))
    lines = F.filter(_rest(F.split("hunk", "\n")), lambda x: x.startswith("+") | x.startswith("-"))
    rows = hunks.select("repo", "commit_id", "path", lines.alias("lines")).withColumn("lang", detect_lang(F.col("path"))).where(~F.col("lang").isin("prose", "unknown"))
    flags = skip_flags(F.col("lang"), F.transform("lines", lambda x: F.substr(x, F.lit(2))))
    kept = F.filter(F.arrays_zip(F.col("lines").alias("x"), flags.alias("s")), lambda r: ~r["s"])
    n = lambda sign: F.sum(F.size(F.filter(kept, lambda r: r["x"].startswith(sign))))
    return rows.groupBy("repo", "commit_id", "path").agg(n("+").cast("long").alias("diff_insertions"), n("-").cast("long").alias("diff_deletions"))


def read_merge_log(spark: SparkSession, path: str, email: bool = False) -> DataFrame:
    rows = _headed(spark, path, email)
    return rows.select("repo", "commit_id", "author", "committed_at", "subject", F.lit(True).alias("is_merge"))


def read_reverts(spark: SparkSession, path: str) -> DataFrame:
    """(repo, revert_id, reverted): the first hash (maybe short) that a commit's message says it reverts."""
    rows = _records(spark, path, "REVERT_RECORD:")
    target = F.regexp_extract("record", "This reverts commit ([0-9a-f]{7,40})", 1)
    return rows.select("repo", F.substring_index("record", "\n", 1).alias("revert_id"), target.alias("reverted")).where("reverted <> ''")


def resolve_hashes(reverts: DataFrame, commits: DataFrame) -> DataFrame:
    """reverts with short hashes -> (repo, revert_id, reverted_id); the join runs on the first seven digits."""
    c = commits.select("repo", F.col("commit_id").alias("reverted_id"), F.substring("commit_id", 1, 7).alias("k"))
    rows = reverts.withColumn("k", F.substring("reverted", 1, 7)).join(c, ["repo", "k"]).where(F.col("reverted_id").startswith(F.col("reverted")))
    return rows.select("repo", "revert_id", "reverted_id")


def read_blame(spark: SparkSession, path: str) -> DataFrame:
    """Line-porcelain dumps (a file each) -> (repo, path, author, committed_at), a row a source line that is code.

    A dump is read by all tasks that its splits go to (one, if its compression can't be split)."""
    repo = F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1)
    rows = spark.read.text(path).select(
        repo.alias("repo"), F.col("_metadata.file_path").alias("dump"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("pos"), "value"
    )
    return _blame_lines(rows)


def parse_blame(dumps: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """dumps(repo, value) -> blame lines; comment lines are dropped file by file, in order."""
    rows = materialize(dumps.select("repo", "value", F.monotonically_increasing_id().cast("string").alias("dump")))
    rows = rows.select("repo", "dump", F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return _blame_lines(rows.withColumn("chunk", F.floor(F.col("pos") / chunk)))


#: Lines of a file that are folded at once by the comment filter, counted in kept lines of the dump.
_FOLD = 16_384


def _blame_lines(rows: DataFrame) -> DataFrame:
    """rows(repo, dump, chunk, pos, value), the lines of dumps in order of chunk and pos -> blame lines.

    The header before a source line holds its author, time and file. A line's values are the last ones seen before it
    in its dump (author: since the source line before). Each chunk is summed up by the values it ends with; a scan of
    these summaries, a row a chunk, gives what each chunk begins with, and inside a chunk values come from windows. So
    no key takes in a dump, and the comment filter none that takes in a file."""
    heads = {"author": "author ", "at": "committer-time ", "path": "filename "}
    text = F.col("value").startswith("\t")
    cells = {c: F.when(F.col("value").startswith(m), F.substr("value", F.lit(len(m) + 1))) for c, m in heads.items()}
    cells["at"] = cells["at"].try_cast("bigint")
    part = ["repo", "dump", "chunk"]
    rows = rows.select(*part, "pos", F.when(text, F.substr("value", F.lit(2))).alias("line"), *(v.alias(c) for c, v in cells.items()))
    rows = rows.where(F.coalesce(F.col("line").isNotNull() | F.col("author").isNotNull() | F.col("at").isNotNull() | F.col("path").isNotNull(), F.lit(False)))
    # What a chunk ends with; an author line counts for the one source line that follows it.
    end = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("pos", c)))
    ends = rows.groupBy(*part).agg(F.count("*").alias("n"), *(end(c).alias(c) for c in ("line", *heads)))
    pending = F.when(F.col("author").isNotNull() & (F.col("line").isNull() | (F.col("author.pos") > F.col("line.pos"))), F.struct(F.col("author.author").alias("v")))
    pending = pending.when(F.col("line").isNotNull(), F.struct(F.lit(None).cast("string").alias("v")))
    before = Window.partitionBy("repo", "dump").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*part, "n", pending.alias("author"), F.col("at.at").alias("at"), F.col("path.path").alias("path"))
    carried = {f"_{c}": F.last(c, ignorenulls=True).over(before) for c in heads}
    starts = ends.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), *(v.alias(c) for c, v in carried.items()))
    here = Window.partitionBy(*part).orderBy("pos")
    last = lambda c: F.last(c, ignorenulls=True).over(here)
    at = lambda c, w: F.last(F.when(F.col(c).isNotNull(), F.col("pos")), ignorenulls=True).over(w)
    rows = rows.withColumns({
        "author": last("author"), "author_pos": at("author", here), "text_pos": at("line", here.rowsBetween(Window.unboundedPreceding, -1)),
        "at": last("at"), "path": last("path"), "i": F.row_number().over(here),
    }).where("line is not null")
    rows = rows.join(starts, part)
    inside = F.when(F.col("text_pos").isNull() | (F.col("author_pos") > F.col("text_pos")), F.col("author"))
    author = F.when(F.col("author_pos").isNull() & F.col("text_pos").isNull(), F.col("_author.v")).otherwise(inside)
    path = F.coalesce("path", "_path", F.lit(""))
    rows = rows.select("repo", "dump", path.alias("path"), (F.col("_n") + F.col("i")).alias("line_no"), author.alias("author"), F.coalesce("at", "_at").alias("at"), "line")
    rows = rows.where("author <> ''").withColumn("lang", detect_lang(F.col("path")))
    code = skipped_rows(rows, ("repo", "dump", "path"), "line_no", _FOLD, ("author", "at")).where(~F.col("skipped"))
    return code.select("repo", "path", "author", F.timestamp_seconds("at").alias("committed_at"))


def read_fix_blame(spark: SparkSession, path: str) -> DataFrame:
    """Blame at the parents of fixes, a dump `<fix commit>` each -> (fix_commit_id, path, orig_author)."""
    return read_blame(spark, path).select(F.col("repo").alias("fix_commit_id"), "path", F.col("author").alias("orig_author"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """`path` or `size<TAB>path` lines -> (repo, path, size_bytes); a size of - is unknown."""
    rows = spark.read.text(path).where("value <> ''").select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("repo"), F.split("value", "\t").alias("f"))
    return rows.select("repo", F.element_at("f", -1).alias("path"), F.when(F.size("f") > 1, F.element_at(F.split(F.trim(F.element_at("f", -2)), r"\s+"), -1).try_cast("bigint")).alias("size_bytes"))


def read_changed_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw diff-tree rows -> (repo, path); submodules (mode 160000) are dropped."""
    rows = spark.read.text(path).where(F.col("value").contains("\t") & ~F.col("value").contains(" 160000 "))
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("repo"), F.substring_index("value", "\t", -1).alias("path"))


_MEMBER = "member: string, impact: double, production: double, quality: double, survival: double, robust_survival: double, dormant_survival: double, design: double, breadth: double, debt_cleanup: double, indispensability: double, gravity: double, role: string, style: string, state: string, commits: bigint"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Result files -> engineers, the file's stem as repo; timeline files are skipped."""
    schema = f"domains array<struct<domain: string, members: array<struct<{_MEMBER}>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("repo", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    rows = rows.where(~F.col("repo").contains("timeline")).select("repo", F.explode("domains").alias("d")).select("repo", F.col("d.domain").alias("domain"), F.explode("d.members").alias("m"))
    return rows.select("repo", "domain", F.col("m.member").alias("author"), "m.*").drop("member")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Contributor files -> (repo, rank, login, contributions, release_authors, architect_candidates); users only, ranked
    by their place in the list."""
    schema = "top_contributors array<struct<login: string, contributions: bigint, type: string>>, release_authors array<string>, architect_candidates array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("repo", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    users = F.filter("top_contributors", lambda c: c["type"] == "User")
    rows = rows.select("repo", F.posexplode(users).alias("pos", "c"), "release_authors", "architect_candidates")
    return rows.select("repo", (F.col("pos") + 1).alias("rank"), "c.login", "c.contributions", "release_authors", "architect_candidates")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline files -> (author, period, pos, impact, gravity, role, style, state), a row an author and period."""
    cell = "struct<label: string, impact: double, gravity: double, commits: bigint, role: string, style: string, state: string>"
    schema = f"periods array<struct<label: string, start: string, end: string>>, authors array<struct<author: string, periods: array<{cell}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("authors").alias("a"))
    rows = rows.select("a.author", F.posexplode("a.periods").alias("pos", "p"))
    return rows.select("author", F.col("p.label").alias("period"), "pos", "p.impact", "p.gravity", "p.commits", "p.role", "p.style", "p.state")

