"""Author aliases, exclusions, duplicate repositories and reverted commits."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.paths import glob_to_regex, matches_any, norm_name


def resolve_authors(df: DataFrame, aliases: DataFrame, author: str = "author") -> DataFrame:
    """author -> canonical, one hop; authors without an alias stay. The alias table is as small as a settings file."""
    named = aliases.select(F.col("alias").alias("_alias"), "canonical").dropDuplicates(["_alias"])
    joined = df.join(named, F.col(author) == F.col("_alias"), "left")
    return joined.withColumn(author, F.coalesce("canonical", author)).drop("_alias", "canonical")


def exclude_authors(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("author"), "author", "left_anti")


def exclude_repos(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("repo"), "repo", "left_anti")


def dedupe_repos(repos: DataFrame) -> DataFrame:
    """repos(repo, real_path, ordinal): of repositories with one real path the first stays."""
    first = Window.partitionBy("real_path").orderBy("ordinal", "repo")
    return repos.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def exclude_files(df: DataFrame, patterns) -> DataFrame:
    return df.where(~matches_any(F.col("path"), patterns))


def effectively_reverted(reverts: DataFrame) -> DataFrame:
    """reverts(repo, revert_id, reverted_id) -> (repo, commit_id) of commits that some standing commit reverts.

    A commit falls when a commit that reverts it stands, and stands when all that revert it have fallen; cycles, and
    what hangs on them alone, stay undecided and count as not reverted.

    Each checkpointed round decides what it can, and shortens the rest: a commit with one open reverter is the opposite
    of that, so links to it go straight to its reverter with the sign turned. Chains halve in a round, so the rounds
    grow with the logarithm of their length."""
    edges = reverts.select("repo", F.col("reverted_id").alias("x"), F.col("revert_id").alias("r"), F.lit(False).alias("flip")).distinct()
    known = edges.select("repo", F.col("r").alias("x")).distinct().join(edges.select("repo", "x").distinct(), ["repo", "x"], "left_anti").withColumn("stands", F.lit(True))
    edges, known = _cut(edges), _cut(known)
    idle = 0
    while True:
        seen = edges.join(known.select("repo", F.col("x").alias("r"), "stands"), ["repo", "r"], "left")
        hit = F.coalesce(F.max(F.col("stands") != F.col("flip")), F.lit(False))
        per = seen.groupBy("repo", "x").agg(hit.alias("hit"), F.count_if(F.col("stands").isNull()).alias("open"))
        new = _cut(per.where(F.col("hit") | (F.col("open") == 0)).select("repo", "x", (~F.col("hit")).alias("stands")))
        left = seen.where(F.col("stands").isNull()).drop("stands").join(new, ["repo", "x"], "left_anti")
        one = left.join(per.where((F.col("open") == 1) & ~F.col("hit")).select("repo", "x"), ["repo", "x"], "left_semi")
        one = one.select("repo", F.col("x").alias("r"), F.col("r").alias("next"), F.col("flip").alias("turn"))
        left = left.join(one, ["repo", "r"], "left")
        further = F.col("next").isNotNull()
        left = left.select("repo", "x", F.when(further, F.col("next")).otherwise(F.col("r")).alias("r"), F.when(further, F.col("flip") == F.col("turn")).otherwise(F.col("flip")).alias("flip"))
        edges, known = _cut(left.distinct()), known.union(new)
        idle = idle + 1 if new.isEmpty() else 0
        # By then every chain that is left would have reached its end: what stays leads into cycles.
        if idle > edges.count().bit_length():
            break
    return known.where("not stands").select("repo", F.col("x").alias("commit_id"))


def shared_root(spark) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset a local one, but only if
    driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.gettempdir()
    return at.rstrip("/")


def shared_folder(spark) -> str:
    """A fresh name in the shared folder."""
    return f"{shared_root(spark)}/strata-{uuid.uuid4().hex}"


#: Spark removes a query's shuffle files at its end where this is set, and not only when the driver's garbage goes.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: read often, computed once, kept if executors go.

    What was shuffled for it goes at once, so a job of several such steps needs the disk of its largest one."""
    spark = df.sparkSession
    at, before = shared_folder(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Commits of a line that one row of the last join stands for before it becomes a row a commit.
_BLOCK = 1024
#: Commits of a line whose links are followed first; four times as many in each step after.
_STEP = 8


def first_parent_lines(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parents(repo, commit_id, pos, parent_id, parent_order) -> the commits that are parents, as lines, and the links
    between lines.

    A line follows first parents; where several commits have one first parent, the line goes on to the child with the
    latest descendant, so the main line stays whole. (repo, commit_id, line, p, at): p counts from the line's oldest
    commit; (repo, line, p, to_line, to_p, to_at): a parent in another line. Both come from pointers whose reach doubles
    in each checkpointed round, so the rounds grow with the logarithm of the longest line."""
    at = parents.groupBy("repo", F.col("parent_id").alias("commit_id")).agg(F.max("parent_order").alias("at"))
    first = parents.where("pos = 1").groupBy("repo", "commit_id").agg(F.min("parent_id").alias("up"))
    nodes = materialize(at.join(first, ["repo", "commit_id"], "left"))
    rows = nodes.withColumn("best", F.col("at"))
    while not rows.where("up is not null").isEmpty():
        above = rows.select("repo", F.col("commit_id").alias("up"), F.col("up").alias("further"))
        below = rows.where("up is not null").groupBy("repo", F.col("up").alias("commit_id")).agg(F.max("best").alias("below"))
        rows = rows.join(above, ["repo", "up"], "left").join(below, ["repo", "commit_id"], "left")
        rows = materialize(rows.select("repo", "commit_id", F.col("further").alias("up"), F.greatest("best", "below").alias("best")))
    heirs = nodes.join(rows.select("repo", "commit_id", "best"), ["repo", "commit_id"]).where("up is not null")
    heirs = heirs.groupBy("repo", F.col("up").alias("next")).agg(F.max(F.struct("best", "commit_id"))["commit_id"].alias("commit_id"))
    rows = materialize(nodes.select("repo", "commit_id").join(heirs, ["repo", "commit_id"], "left").select(
        "repo", "commit_id", F.coalesce("next", "commit_id").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("p"), F.col("next").isNotNull().alias("on")
    ))
    while not rows.where("on").isEmpty():
        ahead = rows.select("repo", F.col("commit_id").alias("to"), F.col("to").alias("further"), F.col("p").alias("more"), F.col("on").alias("still"))
        rows = materialize(rows.join(ahead, ["repo", "to"]).select("repo", "commit_id", F.col("further").alias("to"), (F.col("p") + F.col("more")).alias("p"), (F.col("on") & F.col("still")).alias("on")))
    lines = materialize(rows.select("repo", "commit_id", F.col("to").alias("line"), "p").join(nodes.select("repo", "commit_id", "at"), ["repo", "commit_id"]))
    to = lines.select("repo", F.col("commit_id").alias("parent_id"), F.col("line").alias("to_line"), F.col("p").alias("to_p"), F.col("at").alias("to_at"))
    links = parents.select("repo", "commit_id", "parent_id").join(lines.drop("at"), ["repo", "commit_id"]).join(to, ["repo", "parent_id"])
    # A parent further down the same line is on the way anyway.
    return lines, materialize(links.where("line <> to_line").select("repo", "line", "p", "to_line", "to_p", "to_at").distinct())


def merge_branches(merges: DataFrame, parents: DataFrame) -> DataFrame:
    """merges(repo, commit_id), parents(repo, commit_id, pos, parent_id, parent_order) -> (repo, root, commit_id): what
    each merge (root) brought in, reachable from it but not from its first parent; the merge itself too.

    parent_order never falls from parents to children (a date or generation). What is reached of a line is all below
    its newest reached commit, so both sides are a row a line and not a row a commit. Each round follows the links that
    leave a stretch of each line, newest stretches first: the side waits while the first parent's side has newer commits
    left, and that one stops below the oldest commit that it has not met. So the walk covers the branch and not the
    history, and rounds grow with how deep branches nest and with the logarithm of their lines' length."""
    lines, links = first_parent_lines(parents)
    key = ["repo", "root", "line"]
    place = lines.select("repo", F.col("commit_id").alias("parent_id"), "line", "p")
    roots = merges.select("repo", "commit_id").distinct()
    starts = roots.join(parents, ["repo", "commit_id"]).join(place, ["repo", "parent_id"])
    starts = starts.select("repo", F.col("commit_id").alias("root"), "line", F.when(F.col("pos") == 1, 1).otherwise(0).alias("main"), F.col("p").alias("hi"), F.col("p").alias("lo"))
    # A link is held at each power of 16 of places, so a stretch of any length is looked up by a few keys.
    longest = lines.agg(F.max("p")).first()[0] or 0
    levels = range(1, max(1, (longest.bit_length() + 3) // 4) + 1)
    block = lambda c, level: f"shiftright({c}, 4 * {level})"
    held = links.withColumnRenamed("p", "from_p").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    held = materialize(held.withColumn("block", F.expr(block("from_p", "level"))))

    def state(rows):
        """A row a line: newest places reached by the side and the first parent's (s, m; -1: none), down to where their
        links were followed (s_to, m_to), and how old the next commits are: of the side's part that the other has not
        met (s_at: still to follow, open_at: in any case) and of the first parent's side (m_at)."""
        at_most = lambda of: F.coalesce(F.min(F.when(F.col("main") == of, F.struct((-F.col("hi")).alias("hi"), "lo"))), F.struct(F.lit(1).cast("long").alias("hi"), F.lit(-1).cast("long").alias("lo")))
        rows = rows.groupBy(*key).agg(at_most(0).alias("s"), at_most(1).alias("m"))
        rows = rows.select(*key, (-F.col("s.hi")).alias("s"), F.col("s.lo").alias("s_to"), (-F.col("m.hi")).alias("m"), F.col("m.lo").alias("m_to"))
        rows = rows.withColumns({"s_p": F.when(F.col("s_to") > F.col("m"), F.col("s_to")).when(F.col("s") > F.col("m"), F.col("m") + 1), "m_p": F.when(F.col("m_to") >= 0, F.col("m_to"))})
        asked = rows.select("*", F.explode_outer(F.filter(F.array(F.struct(F.lit(0).alias("of"), F.col("s_p").alias("p")), F.struct(F.lit(1).alias("of"), F.col("m_p").alias("p"))), lambda x: x["p"].isNotNull())).alias("ask"))
        asked = asked.select(*rows.columns, "ask.of", "ask.p").join(lines.select("repo", "line", "p", "at"), ["repo", "line", "p"], "left")
        found = asked.groupBy(*key, "s", "s_to", "m", "m_to").agg(F.max(F.when(F.col("of") == 0, F.col("at"))).alias("open_at"), F.max(F.when(F.col("of") == 1, F.col("at"))).alias("m_at"))
        return materialize(found.withColumn("s_at", F.when(F.col("s_to") > F.col("m"), F.col("open_at"))))

    # Tables and not checkpoints: those carry the constraints of all rounds before along, which slows planning down.
    rows, ended = state(starts.select(*key, "main", "hi", "lo")), []
    while True:
        per = rows.groupBy("repo", "root").agg(F.min("open_at").alias("oldest"), F.max("s_at").alias("s_next"), F.max("m_at").alias("m_next"))
        per = per.withColumn("on", F.col("s_next").isNotNull() | F.coalesce(F.col("m_next") >= F.col("oldest"), F.lit(False)))
        rows = rows.join(per, ["repo", "root"])
        ended.append(rows.where("not on and s > m").select(*key, "s", "m"))
        rows = rows.where("on")
        if rows.isEmpty():
            break
        down = lambda top, to: F.greatest(top - F.greatest(F.lit(_STEP).cast("long"), 4 * (top - to)), F.lit(-1).cast("long"))
        s_goes = F.col("s_at").isNotNull() & (F.col("m_next").isNull() | (F.col("s_at") >= F.col("m_next")))
        m_goes = F.coalesce(F.col("m_at") >= F.col("oldest"), F.lit(False))
        sides = [
            F.struct(F.lit(0).alias("main"), F.col("s").alias("hi"), F.col("s_to").alias("to"), F.when(s_goes, down(F.col("s"), F.col("s_to"))).otherwise(F.col("s_to")).alias("lo"), F.when(s_goes, F.greatest(down(F.col("s"), F.col("s_to")), "m")).alias("above")),
            F.struct(F.lit(1).alias("main"), F.col("m").alias("hi"), F.col("m_to").alias("to"), F.when(m_goes, down(F.col("m"), F.col("m_to"))).otherwise(F.col("m_to")).alias("lo"), F.when(m_goes, down(F.col("m"), F.col("m_to"))).alias("above")),
        ]
        sides = rows.select(*key, F.explode(F.array(*sides)).alias("x")).select(*key, "x.*").where("hi >= 0")
        level = F.coalesce(*(F.when(F.col("to") - F.col("above") <= 16**i, i) for i in levels), F.lit(levels[-1]))
        asked = sides.where("above < to").withColumn("level", level)
        asked = asked.select("repo", "root", "main", "line", "above", "to", "level", F.explode(F.expr(f"sequence({block('(above + 1)', 'level')}, {block('to', 'level')})")).alias("block"))
        met = asked.join(held, ["repo", "line", "level", "block"]).where("from_p > above and from_p <= to")
        met = met.groupBy("repo", "root", F.col("to_line").alias("line"), "main").agg(F.max("to_p").alias("hi")).withColumn("lo", F.col("hi"))
        rows = state(sides.select(*key, "main", "hi", "lo").union(met.select(*key, "main", "hi", "lo")))
    side = ended[0]
    for more in ended[1:]:
        side = side.union(more)
    block = lambda c: F.floor(F.col(c) / _BLOCK)
    parts = side.select("repo", "root", "line", "s", "m", F.explode(F.sequence(F.floor((F.col("m") + 1) / _BLOCK), block("s"))).alias("block"))
    parts = parts.select("repo", "root", "line", F.explode(F.sequence(F.greatest(F.col("m") + 1, F.col("block") * _BLOCK), F.least("s", F.col("block") * _BLOCK + _BLOCK - 1))).alias("p"))
    parts = parts.join(lines.select("repo", "line", "p", "commit_id"), ["repo", "line", "p"])
    return parts.select("repo", "root", "commit_id").union(roots.select("repo", F.col("commit_id").alias("root"), "commit_id"))


def expand_merge(merges: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo, commit_id): the commits of merge_branches(), each once."""
    return merge_branches(merges, parents).select("repo", "commit_id").distinct()


def exclude_reverted(commits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drops the excluded commits; the reverting commits stay."""
    return commits.join(excluded.select("repo", "commit_id").distinct(), ["repo", "commit_id"], "left_anti")


def configured_domain(repos: DataFrame, domains: DataFrame) -> DataFrame:
    """repos(repo), domains(domain, repo_pattern glob) -> (repo, domain): the first matching domain by name, else null."""
    rows = domains.where(F.col("repo_pattern").isNotNull()).collect()  # a settings table
    hits = [F.when(F.col("repo").rlike("^" + glob_to_regex(r.repo_pattern) + "$"), F.lit(r.domain)) for r in rows]
    return repos.select("repo").distinct().withColumn("domain", F.array_min(F.array_compact(F.array(*hits))) if hits else F.lit(None).cast("string"))


def merge_aliases(own: DataFrame, external: DataFrame) -> DataFrame:
    """(alias, canonical) of both, lower-cased; own entries win, canonical names map to themselves."""
    both = own.select(norm_name(F.col("alias")).alias("alias"), "canonical", F.lit(0).alias("p")).union(
        external.select(norm_name(F.col("alias")), "canonical", F.lit(1))
    )
    both = both.union(both.select(norm_name(F.col("canonical")), "canonical", F.lit(2)))
    best = Window.partitionBy("alias").orderBy("p", "canonical")
    return both.withColumn("n", F.row_number().over(best)).where("n = 1").select("alias", "canonical")


def fuzzy_aliases(names: DataFrame, members: DataFrame) -> DataFrame:
    """names(name), members(member, ordinal) -> (name, canonical, how): equal names first (case aside), else the first
    member whose words contain the name's or lie within them (two words or more each), else the name itself."""
    split = lambda c: F.array_distinct(F.filter(F.split(norm_name(F.col(c)), r"\s+"), lambda w: w != ""))
    n = names.select("name").distinct().withColumn("nw", split("name"))
    m = members.select("member", "ordinal").withColumn("mw", split("member"))
    exact = n.join(m, norm_name(F.col("name")) == norm_name(F.col("member"))).select("name", "member", "ordinal", F.lit(0).alias("p"))
    # The words of one lie within the other's only if its rarest word does: each name and member is looked up by that
    # one word among all words of the other side, so a word that very many have is a key for those alone whose words are
    # all as common.
    n_words, m_words = (df.withColumn("w", F.explode(c)) for df, c in ((n, "nw"), (m, "mw")))
    often = n_words.select("w").union(m_words.select("w")).groupBy("w").agg(F.count("*").alias("often"))
    rarest = lambda df, key: df.join(often, "w").groupBy(*key).agg(F.min_by("w", F.struct("often", "w")).alias("w"))
    within_member = rarest(n_words, ["name", "nw"]).join(m_words, "w")
    within_name = rarest(m_words, ["member", "ordinal", "mw"]).join(n_words, "w")
    shared = within_member.unionByName(within_name).drop("w").dropDuplicates(["name", "member", "ordinal"])
    within = (F.size(F.array_except("nw", "mw")) == 0) | (F.size(F.array_except("mw", "nw")) == 0)
    loose = shared.where((F.size("nw") >= 2) & (F.size("mw") >= 2) & within).select("name", "member", "ordinal", F.lit(1).alias("p"))
    first = Window.partitionBy("name").orderBy("p", "ordinal", "member")
    best = exact.union(loose).withColumn("n", F.row_number().over(first)).where("n = 1")
    how = F.when(F.col("p") == 0, "exact").when(F.col("p") == 1, "words").otherwise("none")
    return n.select("name").join(best, "name", "left").select("name", F.coalesce("member", "name").alias("canonical"), how.alias("how"))
