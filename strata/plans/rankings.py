"""The author ranking as one lazy plan: every axis, the score and its labels, for a whole domain or per group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import Config
from strata.functions.paths import has_extension, is_fix
from strata.operators import axes, clean
from strata.operators.scoring import raw_scores, score_authors


@dataclass
class Relations:
    """commits(repo, commit_id, author, committed_at, subject, is_merge), changes(repo, commit_id, path, insertions,
    deletions), blame(repo, path, author, committed_at) or its line_groups, files(repo, path, size_bytes)."""

    commits: DataFrame
    changes: DataFrame
    blame: DataFrame
    files: DataFrame
    domains: DataFrame | None = None  # (repo, domain), for scores by domain

    def grouped(self) -> Relations:
        """The same relations with equal blame lines as one row with their number, which the axes read instead."""
        lines = self.blame if "lines" in self.blame.columns else axes.line_groups(self.blame)
        return Relations(self.commits, self.changes, lines, self.files, self.domains)

    def staged(self) -> Relations:
        """grouped(), written to the shared folder now, for callers that read the relations in several queries."""
        r = self.grouped()
        return Relations(*map(clean.materialize, (r.commits, r.changes, r.blame, r.files)), r.domains)

    def cleaned(self, cfg: Config, reverted: DataFrame | None = None) -> Relations:
        """Aliases resolved, listed authors and repositories and reverted commits gone, blame narrowed to source files."""
        spark = self.commits.sparkSession
        dims = cfg.tables(spark)

        def authors(df: DataFrame) -> DataFrame:
            df = clean.resolve_authors(df, dims["aliases"]) if cfg.aliases else df
            return clean.exclude_authors(df, dims["excluded_authors"]) if cfg.exclude_authors else df

        def repos(df: DataFrame) -> DataFrame:
            return clean.exclude_repos(df, dims["excluded_repos"]) if cfg.exclude_repos else df

        commits = repos(authors(self.commits))
        commits = clean.exclude_reverted(commits, reverted) if reverted is not None else commits
        blame = repos(authors(self.blame)).where(has_extension(F.col("path"), cfg.blame_extensions))
        return Relations(commits, repos(self.changes), blame, repos(self.files), self.domains)


def fix_files(commits: DataFrame, changes: DataFrame, by=()) -> DataFrame:
    fixes = commits.where(is_fix(F.col("subject")) & ~F.col("is_merge"))
    # The changes of other commits go before equal rows are sought.
    fixed = changes.select("repo", "commit_id", "path").join(fixes.select("repo", "commit_id"), ["repo", "commit_id"], "left_semi").distinct()
    return fixes.select(*by, "repo", "commit_id", F.col("author").alias("fixer"), F.col("committed_at").alias("fix_at")).join(fixed, ["repo", "commit_id"])


def enriched_lines(r: Relations, cfg: Config, keep=lambda df: df) -> DataFrame:
    """Blame lines with pressure, threshold and tested flag, as survival() takes them."""
    pressure = keep(axes.change_pressure(axes.commit_modules(r.changes), r.blame))
    limits = keep(axes.pressure_threshold(r.blame, pressure, cfg.min_substantial_lines))
    lines = axes.enrich_blame(r.blame, pressure, keep(axes.file_tested(r.files)))
    return lines.join(limits.select("repo", "threshold"), "repo", "left")


def author_axes(r: Relations, cfg: Config, as_of, by=(), keep=lambda df: df) -> list[DataFrame]:
    """All axes of one wide row an author and group; by=() scores all repositories together, ("repo",) and ("domain",)
    each by itself. keep: what is done with each axis and with what it needs of modules, such as to stage it."""
    if by == ("domain",):
        per = r.domains  # a row a repository
        in_domain = lambda df: df.join(per, "repo")
        r = Relations(in_domain(r.commits), in_domain(r.changes), in_domain(r.blame), r.files, r.domains)
    else:
        in_domain = lambda df: df
    own = r.commits.where(~F.col("is_merge"))
    changes = r.changes.join(own.select("repo", "commit_id", "author", "committed_at"), ["repo", "commit_id"])
    unit = tuple(dict.fromkeys((*by, "repo")))
    quality = axes.quality(r.commits, unit)
    debt = axes.debt_score(axes.debt_events(fix_files(r.commits, r.changes), r.blame, keep=keep), cfg.debt_threshold)
    if by == ("repo",) or cfg.breadth_unit == "module":
        units = axes.author_unit_commits(changes, by)
    else:
        units = own.groupBy(*unit, "author").agg(F.count("*").alias("commits"))
    found = [
        axes.lines_changed(changes, cfg.exclude_files, by),
        axes.author_activity(r.commits, by),
        axes.mean_over(quality, "quality", by),
        axes.survival(enriched_lines(r, cfg, keep), as_of, cfg, by),
        axes.design(changes, cfg.architecture, by),
        axes.breadth(units, cfg.breadth_min_commits, by),
        axes.mean_over(in_domain(debt), "debt_cleanup", by),
        axes.indispensability(in_domain(axes.bus_factor(r.blame, cfg)), by),
    ]
    return [keep(axis) for axis in found]


def author_scores(r: Relations, cfg: Config, as_of, by=(), keep=lambda df: df) -> DataFrame:
    """keep: what the caller does with each axis and the wide rows, which are read several times, such as to stage them."""
    return score_authors(keep(raw_scores(author_axes(r, cfg, as_of, by, keep), by)), cfg, as_of, by)
