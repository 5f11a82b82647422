"""Queries over source text, streams and report documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import lines, paths, sql
from strata.operators import axes, modules, scoring, teams, timelines
from strata.operators.clean import shared_folder
from strata.plans import blame_queries, score_queries, timeline_queries
from strata.plans.registry import SQL_IS_FIX, H, L, N, query, rounded, sql_conf, sql_module
from strata.sources import writers
from strata.streaming import activity as live


def text_lines(spark, sf_dir):
    """Document texts under .py and .md names and pages under .html names, as arrays of lines; a null text has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".md"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    lines_ = lambda c: F.coalesce(F.split(c, "\n"), F.array().cast("array<string>")).alias("lines")
    return docs.select(name.alias("path"), lines_("text")).union(pages.select(page, lines_("html")))


def comment_filter(v, s, d):
    lang = paths.detect_lang(F.col("path"))
    return text_lines(s, d).select("path", lang.alias("lang"), F.size("lines").alias("n_lines"), lines.count_code_lines(lang, F.col("lines")).alias("n_code"))


def _code_lines(marks: list[tuple[str, str]], line_mark: str | None) -> str:
    """A fold over trimmed lines x with the closing mark e and the number n of code lines so far, as SQL."""
    quoted = lambda t: t.replace("'", "''")
    blank = "[ \\t\\n\\x0B\\f\\r]"
    after = "CASE WHEN s.e = '' THEN t.x ELSE ltrim(substr(t.x, position(s.e IN t.x) + length(s.e)), ' ') END"
    rest = f"regexp_replace({after}, '^(?:(?:{'|'.join(f'{quoted(a)}.*?{quoted(z)}' for a, z in marks)}){blank}*)+', '')"
    inside = "(s.e <> '' AND position(s.e IN t.x) = 0)"
    comment = f"starts_with({rest}, '{line_mark}')" if line_mark else "FALSE"
    opens = "CASE WHEN " + comment + " THEN '' " + " ".join(f"WHEN starts_with({rest}, '{quoted(a)}') THEN '{quoted(z)}'" for a, z in reversed(marks)) + " ELSE '' END"
    skip = f"(t.x = '' OR {inside} OR {rest} = '' OR {comment} OR {opens} <> '')"
    step = f"{{'e': CASE WHEN t.x = '' OR {inside} THEN s.e ELSE {opens} END, 'n': s.n + CASE WHEN {skip} THEN 0 ELSE 1 END, 'x': ''}}"
    rows = f"list_transform(list_transform(lines, lambda l: regexp_replace(l, '^{blank}+|{blank}+$', '', 'g')), lambda l: {{'e': '', 'n': 0, 'x': l}})"
    return f"list_reduce(list_concat([{{'e': '', 'n': 0, 'x': ''}}], {rows}), lambda s, t: {step}).n"


query("comment_filter", comment_filter,
      "SELECT path, lang, CAST(len(lines) AS INTEGER) AS n_lines, CAST(CASE lang WHEN 'python' THEN " + _code_lines([('"""', '"""'), ("'''", "'''")], "#") + " WHEN 'html' THEN " + _code_lines([("<!--", "-->")], None) + " ELSE len(lines) END AS INTEGER) AS n_code FROM "
      "(SELECT CONCAT('docs/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END) AS path, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'prose' END AS lang, coalesce(string_split(text, chr(10)), []) AS lines FROM documents "
      "UNION ALL SELECT CONCAT('pages/', page_id, '.html'), 'html', coalesce(string_split(html, chr(10)), []) FROM pages)")


def sql_functions(v, s, d):
    sql.register(s)
    grid = v("score_grid").select("author", *(F.expr(f"{f}(quality)").alias(f) for f in ("highness", "lowness", "not_low")))
    commits = v("c").groupBy(F.expr("is_fix(subject)").alias("is_fix")).agg(F.count("*").alias("n"))
    modules_ = v("p").groupBy(F.expr("module_of(path)").alias("module")).agg(F.count("*").alias("n"))
    facts = commits.select(F.concat(F.lit("fix "), F.col("is_fix").cast("string")).alias("key"), F.col("n").cast("double").alias("value"))
    facts = facts.union(modules_.select("module", F.col("n").cast("double")))
    return facts.union(grid.select("author", F.col("highness") + F.col("lowness") * 10 + F.col("not_low") * 100)).withColumn("value", F.round("value", 4))


query("sql_functions", sql_functions,
      f"SELECT CONCAT('fix ', CAST({SQL_IS_FIX} AS VARCHAR)) AS key, CAST(COUNT(*) AS DOUBLE) AS value FROM c GROUP BY 1 UNION ALL SELECT {sql_module()}, CAST(COUNT(*) AS DOUBLE) FROM p GROUP BY 1 "
      f"UNION ALL SELECT author, ROUND({H('quality')} + {L('quality')} * 10 + {N('quality')} * 100, 4) FROM score_grid", "c p score_grid")

# --- streams: each runs to the end of what there is; periods and sessions are out once the watermark passes them ---------

EV = "e AS (SELECT CONCAT('repo', CAST(user_id % 4 AS STRING)) AS repo, event_id AS commit_id, CONCAT('dev', CAST(user_id % 8 AS STRING)) AS author, ts, event_type = 'error' AS is_fix, CAST(trunc(coalesce(value, 0)) AS BIGINT) AS lines FROM events)"
query("stream_period_axes",
      lambda v, s, d: live.drain(live.period_axes(live.stream_activity(s, d)), "append", "axes").select(F.date_format("period_start", "yyyy-MM-dd").alias("period"), "author", "production", "commits", F.round("quality", 4).alias("quality")),
      "SELECT strftime(w, '%Y-%m-%d') AS period, author, CAST(SUM(lines) AS BIGINT) AS production, COUNT(*) AS commits, ROUND(100 - COUNT(*) FILTER (is_fix) / CAST(COUNT(*) AS DOUBLE) * 100, 4) AS quality FROM (SELECT *, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS w FROM e) "
      "WHERE w + INTERVAL 7 DAYS <= (SELECT MAX(ts) FROM e) - INTERVAL 1 DAY GROUP BY w, author", "", EV)
query("stream_dedup", lambda v, s, d: live.drain(live.deduplicated(live.stream_activity(s, d)), "append", "dedup").groupBy("repo", "author").agg(F.count("*").alias("n")),
      "SELECT repo, author, COUNT(*) AS n FROM (SELECT DISTINCT repo, commit_id, author FROM e) GROUP BY repo, author", "", EV)
query("stream_sessions", lambda v, s, d: live.drain(live.sessions(live.stream_activity(s, d)), "append", "sessions").groupBy("author").agg(F.count("*").alias("sessions"), F.sum("commits").alias("commits")),
      "SELECT author, COUNT(*) AS sessions, CAST(SUM(n) AS BIGINT) AS commits FROM (SELECT author, k, COUNT(*) AS n, MAX(ts) AS last FROM (SELECT author, ts, SUM(new) OVER (PARTITION BY author ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT author, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY author ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM e)) GROUP BY author, k) "
      "WHERE last + INTERVAL 30 MINUTE <= (SELECT MAX(ts) FROM e) - INTERVAL 1 DAY GROUP BY author", "", EV)
query("stream_last_seen", lambda v, s, d: live.latest_seen(s, live.timed_activity(s, d, 4, F.concat(F.lit("user"), F.col("user_id").cast("string"))), 0.25),
      "SELECT CONCAT('user', CAST(user_id AS VARCHAR)) AS author, epoch_us(MAX(ts)) // 1000 AS last_ms, epoch_us(MAX(ts)) // 1000 + 21600000 > epoch_us((SELECT MAX(ts) FROM events)) // 1000 - 86400000 AS active FROM events GROUP BY user_id")


def ledger_periods(v, s, d):
    """Complete periods by repository in a ledger, entered by two runs of which the second begins from nothing."""
    at = shared_folder(s)
    rows = live.period_axes(live.timed_activity(s, d), by=("repo",))
    for run in ("first", "again"):
        live.write_complete_periods(rows, f"{at}/periods", f"{at}/checkpoint-{run}", ("period_start", "repo")).awaitTermination()
    found = live.KeyLedger(s, f"{at}/periods", ("period_start", "repo")).read(rows.schema)
    return found.select(F.date_format("period_start", "yyyy-MM-dd").alias("period"), "repo", "author", "production", "commits", F.round("quality", 4).alias("quality"))


query("stream_period_complete", ledger_periods,
      "SELECT strftime(w, '%Y-%m-%d') AS period, repo, author, CAST(SUM(lines) AS BIGINT) AS production, COUNT(*) AS commits, ROUND(100 - COUNT(*) FILTER (is_fix) / CAST(COUNT(*) AS DOUBLE) * 100, 4) AS quality FROM (SELECT *, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS w FROM e) "
      "WHERE w + INTERVAL 7 DAYS <= (SELECT MAX(ts) FROM e) - INTERVAL 1 DAY GROUP BY w, repo, author", "", EV)
query("last_activity", lambda v, s, d: live.activity(s.read.parquet(f"{d}/events.parquet")).groupBy("author").agg(F.max("ts").alias("last")).select("author", F.date_format("last", "yyyy-MM-dd").alias("last_day")),
      "SELECT author, strftime(MAX(ts), '%Y-%m-%d') AS last_day FROM e GROUP BY author", "", EV)

# --- report documents -------------------------------------------------------------------------------------------------


def team_rows(s, d):
    return teams.team_warnings(score_queries.labelled_teams(s, d))


def timeline_rows(s, d):
    tl = timeline_queries.label_timeline(s, d)
    return tl, timelines.transitions(tl, "author", ("role", "style"), "idx")


def report(v, s, d):
    cfg, by = score_queries.fixture_config(s, d), F.lit("BE").alias("domain")
    keep = score_queries.materialize  # each part by itself, so that the disk is that of the largest
    r = score_queries.relations(v).cleaned(cfg).staged()
    scores = scoring.rank_by_impact(score_queries.author_scores(r, cfg, score_queries.AS_OF, keep=keep))
    named = lambda df: keep(df).select("*", by)
    cover = keep(axes.test_coverage(axes.file_tested(v("files")), "BE"))
    pairs = modules.significant_pairs(blame_queries.pairs(v), 2, 0.01)
    return writers.domain_report(*map(named, (scores, axes.bus_factor(v("b"), cfg))), cover, *map(named, (pairs, axes.ownership(v("b")), blame_queries.module_scores(v))))


#: What the domain report's oracle reads: the ranking, then modules, ownership, coupling and coverage.
DOMAIN_CTES = tuple(dict.fromkeys([
    score_queries.FC, score_queries.QUALITY, *blame_queries.ALL, *blame_queries.INDS, score_queries.BF, score_queries.rk(), blame_queries.ACT, blame_queries.LBL,
]))


def json_number(c: str) -> str:
    """A double of at most four decimals as Spark's JSON has it."""
    return f"CASE WHEN {c} <> 0 AND abs({c}) < 0.001e0 THEN CONCAT(CAST(round({c} * 10000) AS BIGINT), '.0E-4') ELSE CAST({c} AS VARCHAR) END"


def json_object(**fields: tuple[str, str]) -> str:
    """SQL for a JSON object of (kind, expression) fields: s(tring), n(umber as it is), d(ouble), j(SON)."""
    as_text = {"s": lambda x: f"'\"', {x}, '\"'", "n": lambda x: f"CAST({x} AS VARCHAR)", "d": json_number, "j": lambda x: x}
    return "CONCAT('{', " + ", ',', ".join(f"'\"{k}\":', {as_text[t](x)}" for k, (t, x) in fields.items()) + ", '}')"


def json_list(item: str, order: str) -> str:
    return f"CONCAT('[', string_agg({item}, ',' ORDER BY {order}), ']')"


_R1 = lambda c: ("d", f"ROUND({c}, 1)")
DOMAIN_PARTS = {
    "members": (json_list(json_object(rank=("n", "rank"), member=("s", "author"), total_commits=("n", "total_commits"), **{a: _R1(a) for a in writers.AXES}, role=("s", "rl.n"), style=("s", "sy.n"), state=("s", "se.n")), "rank"),
                "(SELECT *, row_number() OVER (ORDER BY impact DESC, author) AS rank FROM rr)"),
    "bus_factor": (json_list(json_object(module=("s", "module"), author=("s", "author"), share=_R1("share * 100"), level=("s", "level")), "module, author, ROUND(share * 100, 1), level"), "bf"),
    "test_coverage": (json_object(files=("n", "COUNT(*)"), tests=("n", "COUNT(*) FILTER (is_test)"), ratio=("d", "ROUND(COUNT(*) FILTER (is_test) / CAST(COUNT(*) AS DOUBLE), 4)")), "ft"),
    "cochange": (json_list(json_object(module_a=("s", "module_a"), module_b=("s", "module_b"), together=("n", "together"), coupling=("d", "ROUND(coupling, 4)")), "module_a, module_b, together, ROUND(coupling, 4)"), "cc WHERE together >= 2 AND coupling >= 0.01e0"),
    "ownership": (json_list(json_object(module=("s", "module"), repo=("s", "repo"), authors=("n", "authors"), top_author=("s", "top_author"), level=("s", "level")), "module, repo"), "owl"),
    "modules": (json_list(json_object(module=("s", "module"), coupling=("s", "k.n"), vitality=("s", "vt.n"), ownership=("s", "o.n")), "module"), "lb"),
}
query("sink_domain_json", report,
      "SELECT 'BE' AS domain, " + json_object(domain=("s", "'BE'"), **{k: ("j", f"(SELECT {x} FROM {of})") for k, (x, of) in DOMAIN_PARTS.items()}) + " AS report",
      "c fc b files", *DOMAIN_CTES)
# What prints with a fixed number of digits rounds halves up, and a null prints as 0.
text = lambda c, digits=1, name=None: f"printf('%.{digits}f', round(CAST(coalesce({c}, 0) AS DOUBLE), {digits})) AS {name or c}"
LABELS = ", ".join(f"{x}.n AS {a}, printf('%.2f', {sql_conf(x)}) AS {a}_conf" for a, x in (("role", "rl"), ("style", "sy"), ("state", "se")))
query("sink_rankings_csv", lambda v, s, d: writers.rankings_csv(scoring.rank_by_impact(score_queries.grid(s, d).withColumns({"domain": F.lit("BE"), "lines_added": F.col("n"), "lines_deleted": F.lit(None).cast("long")}))),
      "SELECT 'BE' AS domain, CAST(row_number() OVER (ORDER BY impact DESC, author) AS VARCHAR) AS rank, author AS member, CAST(recently_active AS VARCHAR) AS active, CAST(total_commits AS VARCHAR) AS commits, CAST(n AS VARCHAR) AS lines_added, '0' AS lines_deleted, "
      + ", ".join(text(a) for a in writers.AXES) + f", {LABELS} FROM sl", "score_grid", score_queries.GRID, score_queries.SL)
TEAM_TEXT = "CAST(core_members AS VARCHAR) AS core_members, CAST(effective_members AS VARCHAR) AS effective_members, CAST(total_members AS VARCHAR) AS total_members, ch.n AS character, structure_name AS structure, culture_name AS culture, phase_name AS phase, risk_name AS risk, "
query("sink_team_csv", lambda v, s, d: writers.team_csv(score_queries.labelled_teams(s, d)),
      f"SELECT team, 'BE' AS domain, '5' AS repos, {TEAM_TEXT}" + ", ".join([*(text(f"avg_{a}") for a in teams.AVERAGES), *(text(h, 2 if h in ("aar", "anchor_density", "architecture_coverage") else 1) for h in writers.HEALTH)]) + " FROM tch",
      "score_grid", *score_queries.TEAM_CTES, timeline_queries.TEAM_CH)
_TEAM_LABELS = {"character": ("ch.n", sql_conf("ch")), **{a: (f"{a}_name", f"{a}_conf") for a in ("structure", "culture", "phase", "risk")}}
TEAM_LABELS = {a: ("j", json_object(name=("s", n), conf=("d", c))) for a, (n, c) in _TEAM_LABELS.items()}
TEAM_SIZES = {c: ("n", c) for c in ("core_members", "effective_members", "total_members")}
query("sink_team_json", lambda v, s, d: writers.team_json(team_rows(s, d), score_queries.members(s, d)),
      "SELECT team, " + json_object(team=("s", "team"), domain=("s", "'BE'"), **TEAM_SIZES, classification=("j", json_object(**TEAM_LABELS)), health=("j", json_object(**{h: ("d", f"ROUND({h}, 4)") for h in writers.HEALTH})), warnings=("j", "coalesce(w.x, '[]')"), members=("j", "m.x")) + " AS report "
      f"FROM tch JOIN (SELECT team, {json_list(json_object(author=('s', 'author'), tier=('s', 'tier'), impact=_R1('impact'), role=('s', 'rl.n'), style=('s', 'sy.n'), state=('s', 'se.n')), 'author')} AS x FROM tm GROUP BY team) m USING (team) "
      f"""LEFT JOIN (SELECT team, {json_list("CONCAT('\"', warning, '\"')", 'o, o2')} AS x FROM ww GROUP BY team) w USING (team)""",
      "score_grid", *score_queries.TEAM_CTES, score_queries.WARN, timeline_queries.TEAM_CH)
query("sink_timeline_csv", lambda v, s, d: writers.timeline_csv(timeline_rows(s, d)[0]),
      "SELECT author, period, " + ", ".join(text(c) for c in ("impact", "gravity", "production", "quality", "survival", "design")) + ", role, style FROM tg", "score_grid", timeline_queries.TLG)
_NUMBERS = ", ".join(f"',\"{c}\":', CAST({c} AS VARCHAR)" for c in ("gravity", "impact", "production", "quality", "survival", "design"))
_LABEL = lambda c: f"CASE WHEN {c} IS NULL THEN '' ELSE CONCAT(',\"{c}\":\"', {c}, '\"') END"  # noqa: E731 - a null leaves its field out
query("sink_timeline_json", lambda v, s, d: writers.timeline_json(*timeline_rows(s, d), order="idx"),
      "SELECT author, CONCAT('{\"author\":\"', author, '\",\"periods\":[', p.x, ']', CASE WHEN t.x IS NULL THEN '' ELSE CONCAT(',\"transitions\":[', t.x, ']') END, '}') AS report FROM "
      f"(SELECT author, string_agg(CONCAT('{{\"idx\":', idx, ',\"period\":\"', period, '\"', {_LABEL('role')}, {_LABEL('style')}, {_NUMBERS}, ',\"at\":\"', strftime(make_timestamp(idx * 1000000), '%Y-%m-%dT%H:%M:%S.000Z'), '\"}}'), ',' ORDER BY idx) AS x FROM tg GROUP BY author) p "
      f"LEFT JOIN (SELECT author, string_agg(CONCAT('{{\"period\":\"', period, '\",\"axis\":\"', axis, '\",\"before\":\"', before, '\",\"after\":\"', after, '\"}}'), ',' ORDER BY period, axis, before, after) AS x FROM ({timeline_queries.TR.format(k='author')}) GROUP BY author) t USING (author)",
      "score_grid", timeline_queries.TLG)
query("sink_team_timeline_csv", lambda v, s, d: writers.team_timeline_csv(timeline_queries.team_periods(s, d)),
      f"SELECT split_part(team, '~', 1) AS team, 'BE' AS domain, split_part(team, '~', 2) AS period, {TEAM_TEXT}" + ", ".join(text(c) for c in writers.TEAM_PERIOD) + " FROM tch", "score_grid", *timeline_queries.TEAM_PERIODS)


def team_timeline_json(v, s, d):
    columns = ["team", "period", "core_members", "effective_members", "total_members", *writers.TEAM_PERIOD]
    rows = rounded(timeline_queries.team_periods(s, d))
    return writers.timeline_json(rows.select(*columns, *timeline_queries.LABEL_AXES), timeline_queries.team_changes(s, d), key="team", order="period")


_CHANGE = json_object(**{k: ("s", k) for k in ("period", "axis", "before", "after")})
query("sink_team_timeline_json", team_timeline_json,
      "SELECT team, CONCAT('{\"team\":\"', team, '\",\"periods\":', p.x, CASE WHEN t.x IS NULL THEN '' ELSE CONCAT(',\"transitions\":', t.x) END, '}') AS report FROM "
      f"(SELECT split_part(team, '~', 1) AS team, {json_list(json_object(period=('s', 'period'), **TEAM_SIZES, **{c: ('d', f'ROUND({c}, 4)') for c in writers.TEAM_PERIOD}, **TEAM_LABELS), 'period')} AS x FROM (SELECT *, split_part(team, '~', 2) AS period FROM tch) GROUP BY 1) p "
      f"LEFT JOIN (SELECT team, {json_list(_CHANGE, 'period, axis')} AS x FROM ({timeline_queries.TEAM_TR}) GROUP BY team) t USING (team)",
      "score_grid", *timeline_queries.TEAM_PERIODS)
query("sink_validation_json", lambda v, s, d: writers.validation_report(timeline_queries.validation.global_gravity(timeline_queries.engineers(s, d)), rounded(timeline_queries.validated(s, d))),
      "SELECT " + json_object(**{"global": ("j", "a.x"), "repos": ("j", "b.x")}) + " AS report FROM "
      f"(SELECT {json_list(json_object(repo=('s', 'repo'), author=('s', 'author'), adjusted_gravity=('d', 'ROUND(g, 4)'), size=('n', 'size')), 'g DESC, repo, author')} AS x FROM (SELECT * FROM ({timeline_queries.ADJUSTED}) ORDER BY g DESC, repo, author LIMIT 100)) a, "
      f"(SELECT {json_list(json_object(repo=('s', 'repo'), **{c: (t, f'ROUND({c}, 4)' if t == 'd' else c) for c, t in timeline_queries.VALIDATED.items()}), 'repo')} AS x FROM rv) b",
      *timeline_queries.V, timeline_queries.CONC, timeline_queries.RV)
